"""Multi-party perspective rotation of dialogues, in SQL functions alone.

For every participant of a dialogue (each speaker but the system), the dialogue is
rendered once with that speaker as assistant, the others as named users and the system
as it is; the mask has the character spans that the assistant said, each with its end
mark: what a model is to learn.

A dialogue is one row for each perspective, whatever the number of its turns, up to
``WHOLE`` characters, more than any model reads at once. A longer one goes on in further
rows: a turn is in part floor(characters before it / ``WHOLE``), counted with every
speaker as a named user, so that all perspectives are cut at the same turns; each row has
its own text, and spans counted from that text's start. A row thus holds ``WHOLE``
characters and one turn at most, and no group is larger than that.

The characters before a turn are sums by range of turn numbers, by turn number, by the
first digits of the turns' digests and by turn, each within the one before, so no window
holds a whole dialogue either. Equal turns (by their digest
of 256 bits) are one row with a count until they are shown.

Defined results: a null role is the speaker ``unknown``, an empty one has an empty name,
null text is empty; turns are ordered by turn, those without number first, then by the
SHA-256 of role and text, so repeated turns all stay; rows without conv_id are one dialogue;
a dialogue of the system alone has no participants and gives no rows; ``<|`` in a text is
written ``< |``; in a role ``\\``, line ends and ``<|`` are written with a ``\\``, so
different roles stay different and marks come from the template alone; part numbers skip
where one turn is longer than ``WHOLE``; other columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazardspark.llm.common import table

WHOLE, SYSTEM = 1 << 20, "system"
#: Turn numbers of a range, as bits; digits of a digest that divide the turns of one number.
RANGE, DIGITS = 12, 3
#: What tells turns apart, from coarse to fine.
TURN = ["conv", "range", "number", "digits", "tie"]
UNNUMBERED = -(1 << 63)
START, END = "<|im_start|>", "<|im_end|>"


def _role(role: Column) -> Column:
    role = F.coalesce(role.cast("string"), F.lit("unknown"))
    for sign, written in (("\\", "\\\\"), ("\r", "\\r"), ("\n", "\\n"), ("<|", "<\\|")):
        role = F.replace(role, F.lit(sign), F.lit(written))
    return role


def _name(role: Column) -> Column:
    return F.when(role == SYSTEM, F.lit(SYSTEM)).otherwise(F.concat(F.lit("user name="), role))


def _starts(rows: DataFrame, keys: list[str], order: list[str], above: DataFrame | None = None) -> DataFrame:
    """``rows`` with at: the sizes before each, in order within its group, which begins where ``above`` says."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0)))
    if above is None:
        return rows
    above = above.select(*keys, F.col("at").alias("begin"))
    return rows.join(above, keys).withColumn("at", F.col("at") + F.col("begin")).drop("begin")


def _places(rows: DataFrame, whole: int) -> DataFrame:
    """Where each different turn goes: a row for each part with copies of it, those from ``a`` to before ``b``."""
    levels = [TURN[:i] for i in range(1, len(TURN) + 1)]
    sums = [rows.groupBy(TURN).agg(F.sum("size").alias("size"), F.first("size").alias("each"))]
    for keys in reversed(levels[1:-1]):
        sums.insert(0, sums[0].groupBy(keys).agg(F.sum("size").alias("size")))
    at = None
    for keys, own, total in zip(levels, TURN[1:], sums, strict=False):
        at = _starts(total, keys, [own], at)
    at = at.withColumn("part", F.explode(F.sequence(F.expr(f"at div {whole}"), F.expr(f"(at + size - each) div {whole}"))))
    a = F.expr(f"greatest(0L, (part * {whole} - at + each - 1) div each)")
    b = F.expr(f"least(size div each, ((part + 1) * {whole} - at + each - 1) div each)")
    return at.withColumns({"a": a, "b": b}).where("a < b").drop("size")


def _parts(rows: DataFrame, places: DataFrame) -> DataFrame:
    """conv, part, conv_id and turns: (role, text, at) in order."""
    said = rows.groupBy(TURN).agg(*(F.first(c).alias(c) for c in ("conv_id", "role", "text"))).join(places, TURN)
    turn = F.struct("number", "tie", "role", "text", "at", "each", "a", "b")
    parts = said.groupBy("conv", "part").agg(F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list(turn)).alias("turns"))
    copies = lambda t: F.transform(
        F.sequence(t["a"], t["b"] - 1), lambda i: F.struct(t["role"].alias("role"), t["text"].alias("text"), (t["at"] + i * t["each"]).alias("at"))
    )
    return parts.withColumn("turns", F.flatten(F.transform("turns", copies)))


def rotate(turns: DataFrame, whole: int = WHOLE) -> DataFrame:
    """conv_id, part, perspective, n_turns, text, mask."""
    rows = turns.select(
        "conv_id", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv"),
        F.coalesce(F.col("turn").cast("long"), F.lit(UNNUMBERED)).alias("number"), _role(F.col("role")).alias("role"),
        F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
    )
    signs = F.length("text") + F.length(_name(F.col("role"))) + len(START) + len(END) + 2
    rows = rows.withColumns({"range": F.shiftright("number", RANGE), "tie": F.sha2(F.concat_ws("\n", "role", "text"), 256), "size": signs.cast("long")})
    rows = rows.withColumn("digits", F.substring("tie", 1, DIGITS))
    speakers = rows.where(F.col("role") != SYSTEM).select("conv", F.col("role").alias("perspective")).distinct()
    places = _places(rows, whole)
    # perspectives meet parts by their keys: texts are not dealt by dialogue
    seen = _parts(rows, places).join(places.select("conv", "part").distinct().join(speakers, "conv"), ["conv", "part"])
    who = F.col("perspective")
    shown = F.transform("turns", lambda t: F.concat(
        F.lit(START), F.when(t["role"] == who, F.lit("assistant")).otherwise(_name(t["role"])), F.lit("\n"), t["text"], F.lit(END + "\n")
    ))
    # each turn of one's own is shorter by what "user name=" and the name have more than "assistant"
    less = F.length(who) + len("user name=") - len("assistant")

    def span(t: Column, before: Column) -> Column:
        start = t["at"] - F.col("turns")[0]["at"] - before * less + len(START + "assistant\n")
        return F.struct(start.cast("int").alias("start"), (start + F.length(t["text"]) + len(END)).cast("int").alias("end"))

    mask = F.transform(F.filter("turns", lambda t: t["role"] == who), span)
    return seen.select("conv_id", "part", "perspective", F.size("turns").alias("n_turns"), F.array_join(shown, "").alias("text"), mask.alias("mask"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rotate(table(spark, sf_dir, "conversations"))
    spelled = F.array_join(F.transform("mask", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return rows.withColumn("mask", spelled)


ORACLE_SQL = r"""
WITH q AS (SELECT conv_id, turn, replace(replace(replace(replace(coalesce(role, 'unknown'), '\', '\\'), chr(13), '\r'), chr(10), '\n'), '<|', '<\|') AS role,
                  replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
z AS (SELECT *, sha256(role || chr(10) || text) AS tie, length(text) + 24 + CASE WHEN role = 'system' THEN 6 ELSE 10 + length(role) END AS size FROM q),
r AS (SELECT *, CAST(sum(size) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, tie, role, text ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS before FROM z),
s AS (SELECT DISTINCT conv_id AS conv, role AS perspective FROM r WHERE role <> 'system'),
t AS (SELECT r.*, before // 1048576 AS part, s.perspective,
             row_number() OVER (PARTITION BY conv_id, before // 1048576, perspective ORDER BY turn NULLS FIRST, tie, role, text, before) AS n,
             '<|im_start|>' || CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user name=' || role END || chr(10) AS head,
             text || '<|im_end|>' AS body
      FROM r JOIN s ON r.conv_id IS NOT DISTINCT FROM s.conv),
u AS (SELECT *, CAST(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, part, perspective ORDER BY n ROWS UNBOUNDED PRECEDING) AS BIGINT) - length(body) - 1 AS a FROM t)
SELECT conv_id, part, perspective, CAST(count(*) AS INTEGER) AS n_turns,
       string_agg(head || body || chr(10), '' ORDER BY n) AS text,
       coalesce(string_agg(CASE WHEN role = perspective THEN CAST(a AS VARCHAR) || '-' || CAST(a + length(body) AS VARCHAR) END, ',' ORDER BY n), '') AS mask
FROM u GROUP BY conv_id, part, perspective
"""
