"""Merkle manifest of a table: leaf digests, a tree for each group, one root, and proofs.

Leaves are numbered within their group without a task that holds a group: rows are range
partitioned by group and order, a row's place in its range is known from the sort, and the
counts of the ranges give the rest. Every level is then an equijoin of the nodes with
themselves at computed sibling indices (XOR 1 for binary trees, slot offsets otherwise);
the rows of slot zero emit the parents. Levels are written to the shared folder, which cuts
the lineage; they halve in size. Proofs go down the same levels: a node's path is its own
siblings and then its parent's path, so each level is one equijoin with the level above and
a path is shuffled once for each family, not once for each descendant.

Digests are 32 bytes at rest and lowercase hex where they are hashed. What goes to the
driver is one root, the size of the largest tree, and one count for each range.

Defined results: a null field counts as ``-`` and an empty text as ``0:``; rows without
doc_id come first in their group and are never tampered; rows of equal group and doc_id
are leaves of their own, in the order of their digests; a null group is a tree of its own,
the first; a lone leaf is its own subroot and a lone subroot the root, so that its proof
has no sibling; texts of any length are hashed whole; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazardspark.llm.common import materialize, table

FIELDS, ARITY, TAMPER = ("doc_id", "source", "lang", "n_chars", "text"), 2, 7
#: A step of a path: how many siblings stand before and after, then their digests. The counts 255, 255 announce the subroot.
SUBROOT = b"\xff\xff"


def framed(values: list[Column]) -> Column:
    """The hex digest of values: ``-`` for null, else byte count, colon, value."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def digest_of(content: Column) -> Column:
    """SHA-256, as bytes, of the hex text of digests that stand one after the other."""
    return F.unhex(F.sha2(F.lower(F.hex(content)), 256))


def tampered(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % TAMPER == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, lang, digest, and the digest after tampering where a row is tampered with."""
    columns = {c: F.col(c) for c in FIELDS}
    changed = columns | {"n_chars": F.col("n_chars") + 1}
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "lang", F.unhex(framed(list(columns.values()))).alias("digest"),
        F.when(tampered(), F.unhex(framed(list(changed.values())))).alias("changed"),
    )


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` with tree (one number for each group), idx (from 0, by ``order``) and size (rows of the group).

    Equal rows are told apart by the place they were written at, so a row that repeats
    without end is no single range.
    """
    held = materialize(rows.withColumn("_written", F.monotonically_increasing_id()), "merkle-rows")
    by = [F.col(c).asc_nulls_first() for c in (*group, *order, "_written")]
    placed = held.repartitionByRange(*by).sortWithinPartitions(*by).drop("_written").withColumn("_m", F.monotonically_increasing_id())
    placed = materialize(placed, "merkle-ranges").withColumn("_part", F.shiftright("_m", 33))
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))  # over ranges, not rows
    parts = placed.groupBy(*group, "_part").agg(F.min("_m").alias("_first"), F.count("*").alias("_n"))
    parts = parts.select(
        *(F.col(c).alias(f"_g{i}") for i, c in enumerate(group)), F.col("_part").alias("_p"), "_first",
        (F.sum("_n").over(whole.orderBy("_first")) - F.col("_n")).alias("_before"), F.min("_first").over(whole).alias("tree"), F.sum("_n").over(whole).alias("size"),
    )
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group)), F.col("_part") == F.col("_p"))
    return placed.join(parts, same).select(*rows.columns, "tree", (F.col("_m") - F.col("_first") + F.col("_before")).alias("idx"), "size")


def _siblings(nodes: DataFrame, arity: int, carried: list[str]) -> DataFrame:
    """``nodes`` with the digests of their run that stand before and after them."""
    slot = F.col("idx") % arity
    out = nodes
    for d in range(1, arity):
        # the node that this one is the d-th sibling of
        target = F.col("idx").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("idx") - slot + (slot + arity - d) % arity
        shifted = nodes.where("size > 1").select(F.col("tree"), target.alias("idx"), F.col("digest").alias(f"_s{d}"))
        out = out.join(shifted, ["tree", "idx"], "left")
    none = F.lit(b"")
    side = lambda d, first: F.when((slot + d >= arity) == F.lit(first), F.coalesce(f"_s{d}", none)).otherwise(none)
    return out.select("tree", "idx", "size", "digest", *carried, F.concat(*(side(d, True) for d in range(1, arity))).alias("before"), F.concat(*(side(d, False) for d in range(1, arity))).alias("after"))


def _parents(level: DataFrame, arity: int) -> DataFrame:
    """The nodes of the next level, from the rows of slot zero."""
    size = F.ceil(F.col("size") / arity).cast("long")
    return level.where((F.col("size") > 1) & (F.col("idx") % arity == 0)).select("tree", F.expr(f"idx div {arity}").alias("idx"), size.alias("size"), digest_of(F.concat("before", "digest", "after")).alias("digest"))


def build(nodes: DataFrame, arity: int = ARITY, carried: list[str] | None = None) -> tuple[list[DataFrame], DataFrame]:
    """The levels of all trees, and their roots (tree, height, digest).

    ``nodes``: tree, idx, size, digest. The first level has all nodes, with the columns
    ``carried``; those above have the nodes of the trees that still have several.
    """
    levels = [materialize(_siblings(nodes, arity, carried or []), "merkle-level")]
    most = levels[0].agg(F.max("size")).first()[0] or 0
    roots = [levels[0].where("size = 1").select("tree", F.lit(0).alias("height"), "digest")]
    while most > 1:
        parents = _parents(levels[-1], arity)
        roots.append(parents.where("size = 1").select("tree", F.lit(len(levels)).alias("height"), "digest"))
        most = -(-most // arity)
        if most > 1:
            levels.append(materialize(_siblings(parents.where("size > 1"), arity, []), "merkle-level"))
    return levels, materialize(reduce(DataFrame.union, roots), "merkle-roots")


def descend(levels: list[DataFrame], tops: DataFrame, arity: int = ARITY) -> DataFrame:
    """The rows of the first level with path: steps up to the root, then the path of the root.

    ``tops``: tree, height, path, one row for each tree.
    """
    count = lambda c: F.lpad(F.hex(F.expr(f"octet_length({c}) div 32")), 2, "0")
    step = F.when(F.col("size") > 1, F.concat(F.unhex(F.concat(count("before"), count("after"))), "before", "after")).otherwise(F.lit(b""))
    above = tops.where(F.col("height") >= len(levels)).select("tree", F.lit(0).cast("long").alias("up"), "path")
    for i in reversed(range(len(levels))):
        level = levels[i].withColumns({"step": step, "up": F.expr(f"idx div {arity}")})
        if i == 0:
            above = above.unionByName(tops.where("height = 0").select("tree", F.lit(0).cast("long").alias("up"), "path"))
        found = level.join(above, ["tree", "up"]).withColumn("path", F.concat("step", "path"))
        if i == 0:
            return found.drop("step", "up", "before", "after")
        here = tops.where(F.col("height") == i).select("tree", F.lit(0).cast("long").alias("up"), "path")
        above = found.select("tree", F.col("idx").alias("up"), "path").unionByName(here)


def manifest(docs: DataFrame, arity: int = ARITY) -> tuple[DataFrame, bytes | None]:
    """doc_id, digest, changed and path of each row, and the root of all."""
    placed = numbered(leaves(docs), ["lang"], ["doc_id", "digest"])
    levels, roots = build(placed, arity, ["doc_id", "lang", "changed"])
    names = levels[0].where("idx = 0").select("tree", "lang")
    subroots = numbered(roots.join(names, "tree").select(F.col("tree").alias("of"), "height", "digest", "lang"), [], ["lang"])
    upper, top = build(subroots, arity, ["of", F.col("height").alias("below")])
    paths = descend(upper, top.select("tree", "height", F.lit(b"").alias("path")), arity)
    paths = paths.select(F.col("of").alias("tree"), F.col("below").alias("height"), F.concat(F.lit(SUBROOT), "digest", "path").alias("path"))
    root = top.first()
    return descend(levels, materialize(paths, "merkle-paths"), arity), bytes(root.digest) if root else None


def steps(path: bytes):
    """(siblings before, siblings after) of each level from below; the subroot comes as (digest, None)."""
    at = 0
    while at < len(path):
        if path[at : at + 2] == SUBROOT:
            yield path[at + 2 : at + 34], None
            at += 34
        else:
            first = at + 2 + 32 * path[at]
            end = first + 32 * path[at + 1]
            yield path[at + 2 : first], path[first:end]
            at = end


def fold(leaf: bytes, path: bytes) -> tuple[bytes, bytes, str]:
    """The root that a leaf gives with the siblings of its path, the subroot that the path states, and the digest of the siblings."""
    subroot, proof = b"", hashlib.sha256()
    for before, after in steps(path):
        if after is None:
            subroot = before
        else:
            proof.update((before + after).hex().encode())
            leaf = hashlib.sha256((before + leaf + after).hex().encode()).digest()
    return leaf, subroot, proof.hexdigest()


def verified(rows: DataFrame, root: bytes | None) -> DataFrame:
    """The proof of each row of a manifest, folded from the tampered leaf where there is one."""

    def run(batches):
        for batch in batches:
            ids, digests, changed, paths = (batch.column(i) for i in range(4))
            folded = [fold(c or d, p) for d, c, p in zip(digests.to_pylist(), changed.to_pylist(), paths.to_pylist(), strict=True)]
            columns = [[d.hex() for d in digests.to_pylist()], [s.hex() for _, s, _ in folded], [root.hex()] * len(folded), [p for *_, p in folded], [f.hex() for f, *_ in folded], [f == root for f, *_ in folded]]
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, columns)], names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return rows.select("doc_id", "digest", "changed", "path").mapInArrow(run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified(*manifest(table(spark, sf_dir, "documents")))


_FRAMED = "sha256({doc} || {source} || {lang} || {n} || {text})"
_TEXT = "coalesce(strlen({0}) || ':' || {0}, '-')"
_PARTS = {"doc": _TEXT.format("CAST(doc_id AS VARCHAR)"), "source": _TEXT.format("source"), "lang": _TEXT.format("lang"), "text": _TEXT.format("text")}
_STEP = "sha256(CASE WHEN s.h IS NULL THEN f.h WHEN f.i % 2 = 1 THEN s.h || f.h ELSE f.h || s.h END)"
ORACLE_SQL = f"""
WITH RECURSIVE leaf AS (
  SELECT doc_id, lang, {_FRAMED.format(**_PARTS, n=_TEXT.format("CAST(n_chars AS VARCHAR)"))} AS h,
    {_FRAMED.format(**_PARTS, n=_TEXT.format("CAST(n_chars + 1 AS VARCHAR)"))} AS changed,
    xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda z: CAST(0 AS BIGINT))), lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END))) AS crc
  FROM documents),
t AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaf),
up(level, g, i, n, h) AS (SELECT CAST(0 AS BIGINT), g, i, n, h FROM t
  UNION ALL SELECT level + 1, g, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY level, g, i // 2, n),
sub AS (SELECT g, h, count(*) OVER () AS n FROM up WHERE n = 1),
top(level, i, n, h) AS (SELECT CAST(0 AS BIGINT), g, n, h FROM sub
  UNION ALL SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY level, i // 2, n),
sib AS (SELECT g, CAST(NULL AS BIGINT) AS top, level, i, h FROM up UNION ALL SELECT NULL, 1, level, i, h FROM top),
proof AS (SELECT t.g, t.i, string_agg(x.h, '' ORDER BY x.high, x.level) AS siblings FROM t JOIN (
    SELECT t.g, t.i, 0 AS high, u.level, u.h FROM t JOIN up u ON u.g = t.g AND u.n > 1 AND u.i = xor(t.i // CAST(pow(2, u.level) AS BIGINT), 1)
    UNION ALL SELECT t.g, t.i, 1, u.level, u.h FROM t JOIN top u ON u.n > 1 AND u.i = xor(t.g // CAST(pow(2, u.level) AS BIGINT), 1)) x ON x.g = t.g AND x.i = t.i GROUP BY ALL),
fold(g, leaf, i, n, level, h) AS (SELECT g, i, i, n, CAST(0 AS BIGINT), CASE WHEN crc % 7 = 0 THEN changed ELSE h END FROM t
  UNION ALL SELECT f.g, f.leaf, f.i // 2, (f.n + 1) // 2, f.level + 1, {_STEP}
  FROM fold f LEFT JOIN up s ON s.g = f.g AND s.level = f.level AND s.i = xor(f.i, 1) WHERE f.n > 1),
high(g, leaf, i, n, level, h) AS (SELECT f.g, f.leaf, f.g, (SELECT count(*) FROM sub), CAST(0 AS BIGINT), f.h FROM fold f WHERE f.n = 1
  UNION ALL SELECT f.g, f.leaf, f.i // 2, (f.n + 1) // 2, f.level + 1, {_STEP}
  FROM high f LEFT JOIN top s ON s.level = f.level AND s.i = xor(f.i, 1) WHERE f.n > 1)
SELECT t.doc_id, t.h AS leaf, sub.h AS subroot, r.h AS root, sha256(coalesce(p.siblings, '')) AS proof_sha256, k.h AS folded_root, k.h = r.h AS verified
FROM t JOIN sub ON sub.g = t.g JOIN high k ON k.g = t.g AND k.leaf = t.i AND k.n = 1 LEFT JOIN proof p ON p.g = t.g AND p.i = t.i, (SELECT h FROM top WHERE n = 1) r
"""
