"""The corpus pipeline: quality, near duplicates, repeated passages, packing.

Each stage works on all that the stage before it kept, and leaves columns of any name as
they are. Null texts count as empty; rows of equal doc_id are documents of their own;
an empty table runs through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardspark.llm import jaccard, packing, quality, suffixes
from hazardspark.llm.common import materialize, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score of 0.5 and more).

    Repeated rows get one score; a null or empty text is scored like any other.
    """
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    held = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return quality.score(held, model).where("predicted = 1").select("row.*")


def keep_one_of_alike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the smallest doc_id, of the smallest text hash where that repeats.

    Rows are grouped by their text, whatever their doc_id; a row without doc_id stays only
    where its whole group has none. Texts without words are linked with nothing: all stay.
    """
    words = F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    held = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("key"), words.alias("words"))
    found = jaccard.components(docs.where(words).select(F.xxhash64("text").alias("doc_id"), "text")).groupBy(F.col("doc_id").alias("key")).agg(F.min("component_id").alias("group"))
    first = F.min(F.struct(F.col("id").isNull().alias("lacks"), "id", "key")).alias("first")
    kept = held.where("words").select("id", "key").join(found, "key").groupBy("group").agg(first).select(F.col("first.id").alias("first_id"), F.col("first.key").alias("first_key"))
    one = held.where("words").join(kept, (F.col("key") == F.col("first_key")) & F.col("id").eqNullSafe(F.col("first_id")), "left_semi").dropDuplicates(["id", "key"])
    return one.unionByName(held.where("NOT words")).select("row.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand in a document of smaller doc_id; n_chars, where it is there, is that of what is left.

    Rows of equal doc_id do not take from each other; a null doc_id counts as the largest.
    """
    left = suffixes.without_repeats(docs)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenized pieces, packed into sequences; an empty text is one piece, its end id."""
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_alike),
    ("suffix-array dedup", cut_repeats),
    ("best-fit packing", pack),
]

#: A trained network and token ids cannot be had in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    *most, (_, last) = STAGES
    for name, stage in most:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return last(spark, docs, sf_dir)
