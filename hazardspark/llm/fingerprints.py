"""Document fingerprints by winnowing, in SQL functions alone.

A text's words are hashed in runs of ``RUN``; of every ``SPAN`` runs in a row the one
with the least hash is kept, the rightmost of equals, with its position. Any passage of
at least ``RUN + SPAN - 1`` words that two texts share thus has a kept run in common at
the same place in both. A shorter text has one run; a text without words has none.

A kept run is one long: the hash's upper 40 bits, then 24 bits that count down with the
position, so that the least long of a window is the rightmost run of least hash (past
2^24 words the count starts anew, which leaves only the choice among equal hashes open).

``with_next`` gives each row the row after it without a global sort. Rows follow each
other by descending doc_id, then by descending xxhash64 of the text, then by descending
text. They are dealt into ranges of doc_id (by quantiles, so far ids do no harm), and
each range ends with a copy of the first row of the range after it. A doc_id, or null, of
more rows than a range should hold has ranges of its own, by the hash of the text; its
repeated texts are counted first and stand there once, with their number, and what they
give is repeated at the end. There are at most ``RANGES`` ranges and as many for such
ids, so borders, such ids and first rows have a fixed bound.

Defined results: null text counts as empty; two texts without words have likeness 1,
one without and one with words 0; rows of equal doc_id follow each other by the hash of
their texts, as above; null doc_ids come last; a single row follows itself; columns of the input beyond
doc_id and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazardspark.llm.blocks import MOST, block_of
from hazardspark.llm.common import let, materialize, table

RUN, SPAN = 5, 8
ROWS, RANGES = 2000, 100_000
PLACES = (1 << 24) - 1
#: Repeated rows that one step gives back.
TURN = 1 << 16


def runs(words: Column, run: int = RUN) -> Column:
    """Hash and place of each run of words, packed."""
    pack = lambda h, i: h.bitwiseAND(F.lit(~PLACES)).bitwiseOR(F.lit(PLACES) - i.cast("long").bitwiseAND(F.lit(PLACES)))
    n = F.size(words)
    return F.when(
        n > run, F.transform(F.sequence(F.lit(1), n - (run - 1)), lambda i: pack(F.xxhash64(F.slice(words, i, run)), i))
    ).when(n > 0, F.array(pack(F.xxhash64(words), F.lit(1)))).otherwise(F.array().cast("array<bigint>"))


def winnow(text: Column, run: int = RUN, span: int = SPAN) -> Column:
    """The kept runs of a text, packed, in order."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), "\\s+"), "")
    least = lambda g: F.when(
        F.size(g) > span, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(g) - (span - 1)), lambda i: F.array_min(F.slice(g, i, span))))
    ).when(F.size(g) > 0, F.array(F.array_min(g))).otherwise(g)
    return let(words, lambda w: let(runs(w, run), least))


def hashes(kept: Column) -> Column:
    return F.array_distinct(F.transform(kept, lambda x: F.shiftright(x, 24)))


def marks(kept: Column) -> Column:
    """Kept runs as (hash, position of the run's first word, from 0)."""
    return F.transform(kept, lambda x: F.struct(F.shiftright(x, 24).alias("hash"), (F.lit(PLACES - 1) - x.bitwiseAND(F.lit(PLACES))).alias("position")))


def digest(kept: Column) -> Column:
    """A fingerprint as a short string: of its hashes and their positions."""
    return F.md5(F.array_join(kept.cast("array<string>"), ","))


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes as a part of all hashes of two fingerprints."""
    both = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(both / (total - both))


def _dealt(docs: DataFrame, rows: int) -> tuple[DataFrame, bool]:
    """doc_id, text, range_no (ascending as the order of rows descends from it) and copies; whether any id was split."""
    total = docs.count()
    size = max(rows, -(-total // RANGES))
    count = max(1, -(-total // size))
    split = docs.groupBy("doc_id").count().where(F.col("count") > size)
    heavy = [(r.doc_id, -(-r["count"] // size)) for r in split.collect()] if count > 1 else []  # fewer than ``count``
    cuts = [i / count for i in range(1, count)]
    found = docs.where("doc_id IS NOT NULL").approxQuantile("doc_id", cuts, 0.1 / count) if count > 1 else []
    borders = {min(int(x), MOST) for x in found}  # doubles: the highest ids round up
    borders |= {x for h, _ in heavy if h is not None for x in (h, h + 1) if x < MOST}
    of_id = F.when(F.col("doc_id").isNull(), -1).otherwise(block_of(F.col("doc_id"), sorted(borders))).cast("long")
    docs = docs.withColumn("range_no", F.shiftleft(of_id, 32))
    if not heavy:
        return docs.withColumn("copies", F.lit(1).cast("long")), False
    parts = F.broadcast(docs.sparkSession.createDataFrame(heavy, "heavy_id long, parts long"))
    same = F.col("doc_id").eqNullSafe(F.col("heavy_id"))
    below = F.floor((0.5 - F.xxhash64("text").cast("double") / 2.0**64) * F.col("parts"))  # 0 for the highest hashes
    part = F.col("parts") - 1 - F.least(F.col("parts") - 1, F.greatest(F.lit(0), below))
    own = docs.join(parts, same).select("doc_id", "text", (F.col("range_no") + part).alias("range_no"))
    own = materialize(own.groupBy("doc_id", "text", "range_no").agg(F.count("*").alias("copies")), "repeated")
    return docs.join(parts, same, "left_anti").withColumn("copies", F.lit(1).cast("long")).unionByName(own), True


def with_next(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """doc_id, text, kept and next_text, next_kept: of the next row.

    Where ids were split there is a column ``copies`` too: how many equal rows a row stands for.
    """
    docs, split = _dealt(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")), rows)
    sign = F.xxhash64("text")
    heads = docs.groupBy("range_no").agg(F.max(F.struct("doc_id", sign.alias("sign"))).alias("head"))
    order = Window.orderBy("range_no")  # over at most 4 x RANGES rows
    goes = F.coalesce(F.lead("range_no").over(order), F.min("range_no").over(Window.partitionBy()))
    heads = F.broadcast(heads.select(F.col("range_no").alias("from_no"), "head", goes.alias("goes_to")))
    met = (F.col("range_no") == F.col("from_no")) & F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (sign == F.col("head.sign"))
    firsts = docs.join(heads, met).groupBy("goes_to").agg(F.max("text").alias("text"))
    firsts = firsts.select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("goes_to").alias("range_no"), F.lit(0).cast("long").alias("copies"))
    kept = winnow(F.col("text")).alias("kept")
    both = docs.unionByName(firsts).select("doc_id", "text", "range_no", "copies", kept)
    w = Window.partitionBy("range_no").orderBy(F.col("copies") == 0, F.desc_nulls_last("doc_id"), F.desc(sign), F.desc("text"))
    found = both.select("doc_id", "text", "kept", "copies", F.lead("text").over(w).alias("next_text"), F.lead("kept").over(w).alias("next_kept")).where("copies > 0")
    if not split:
        return found.drop("copies")
    last = F.struct("next_text", "next_kept", F.lit(1).cast("long").alias("copies"))
    others = F.struct(F.col("text").alias("next_text"), F.col("kept").alias("next_kept"), (F.col("copies") - 1).alias("copies"))
    return found.select("doc_id", "text", "kept", F.inline(F.when(F.col("copies") > 1, F.array(last, others)).otherwise(F.array(last))))


def repeated(rows: DataFrame) -> DataFrame:
    """Each row as often as ``copies`` says, in steps that are dealt over all tasks."""
    turns = rows.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / TURN))))
    turns = turns.repartition("doc_id", "fingerprint", "turn")
    times = F.least(F.lit(TURN), F.col("copies") - F.col("turn") * TURN).cast("int")
    return turns.select("*", F.explode(F.array_repeat(F.lit(0), times)).alias("copy")).drop("copies", "turn", "copy")


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited form and of the next, and their likeness."""
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    found = with_next(docs)
    copies = [c for c in found.columns if c == "copies"]
    rows = found.select("doc_id", n.cast("long").alias("n_chars"), "kept", "next_kept", edited.alias("edited"), *copies)
    rows = rows.select("*", F.sha2("edited", 256).alias("edited_sha256"), winnow(F.col("edited")).alias("edited_kept"))
    sets = F.struct(hashes(F.col("kept")).alias("own"), hashes(F.col("edited_kept")).alias("edited"), hashes(F.col("next_kept")).alias("next"))
    near = let(sets, lambda s: F.struct(likeness(s["own"], s["edited"]).alias("edited"), likeness(s["own"], s["next"]).alias("next")))
    rows = rows.select("doc_id", "n_chars", "edited_sha256", digest(F.col("kept")).alias("fingerprint"), digest(F.col("edited_kept")).alias("edited_fingerprint"), near.alias("near"), F.size("kept").alias("n_kept"), *copies)
    if copies:
        rows = repeated(rows)
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", F.col("near.edited").alias("near_edited"), F.col("near.next").alias("near_next"), "n_kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare(table(spark, sf_dir, "documents"))
