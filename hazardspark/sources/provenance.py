"""Where a data file came from: names and hashes in a registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "arquivo string, hash string, origem string, linhas long, ano_inicial int, ano_final int"
UNKNOWN = "desconhecida"


def hashes(spark: SparkSession, path: str) -> DataFrame:
    """arquivo, path and SHA-256 of every file under a path (files of up to 2 GB)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("arquivo"), "path", F.sha2("content", 256).alias("hash"))


def register(found: DataFrame, origin: str, rows: int, first: int, last: int) -> DataFrame:
    if origin not in ("real", "sintetico"):
        raise ValueError("origin must be real or sintetico")
    return found.select("arquivo", "hash", F.lit(origin).alias("origem"), F.lit(rows).cast("long").alias("linhas"), F.lit(first).alias("ano_inicial"), F.lit(last).alias("ano_final"))


def write_registry(entries: DataFrame, path: str, registry: DataFrame | None = None) -> None:
    """``registry`` with ``entries`` in place of those of the same file name, as JSON lines at a new path."""
    kept = entries if registry is None else registry.join(entries.select("arquivo"), "arquivo", "left_anti").unionByName(entries)
    kept.write.json(path)


def synthetic(origin: Column) -> Column:
    """Whether a file is known to be made; what is unknown is not."""
    return F.coalesce(origin == "sintetico", F.lit(False))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Registry lines (JSON); a line that cannot be read names nothing."""
    raw = spark.read.text(path).select(F.from_json("value", ENTRY).alias("e")).select("e.*")
    return raw.where("arquivo IS NOT NULL AND hash IS NOT NULL AND origem IS NOT NULL")


def identify(found: DataFrame, registry: DataFrame) -> DataFrame:
    """origem of each file: of the entry with the same name and the same hash, or unknown."""
    known = registry.groupBy("arquivo", "hash").agg(F.max("origem").alias("origem"))
    return found.join(known, ["arquivo", "hash"], "left").withColumn("origem", F.coalesce("origem", F.lit(UNKNOWN)))
