"""Exact top-k search by integer inner product, pruned by segment statistics.

A vector is cut into segments, at several resolutions; of each segment the mean and the
deviation are kept. Two vectors' distance is at least the distance of these statistics
(each weighted by the segment's length), so their inner product is at most the inner
product of the statistics. Coarse to fine, candidates whose bound lies below a query's
k-th best score so far fall out; for the survivors the exact score is computed.

Every query first meets one block of candidates; the k-th best score found there is its
floor, and goes with it to all other blocks. Only survivors are scored, pair by pair.

Queries and candidates are dealt into blocks of about ``BLOCK_Q`` and ``BLOCK_C`` rows;
each pair of blocks is one small group, so memory is bounded by two blocks and no row
set is broadcast. Every group gives its k best for each query, and a last window
keeps the k best of those, before its shuffle and after; what moves is rows x blocks, never pairs.

Defined results: vectors that are null, empty, or hold a null or non-finite component
take no part, nor do rows without vec_id; of rows with the same vec_id, one counts (the
smallest vector in array order); vectors of different lengths are not compared; other
columns are ignored; an empty table gives no rows. Scores are exact where they fit a
long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazardspark.llm.common import table

K, SCALE, EVERY = 20, 64, 20
BLOCK_Q, BLOCK_C, STEP, PAIRS = 2048, 8192, 1024, 1 << 14
#: Segments of each resolution, coarse to fine.
LEVELS = (4, 16, 32)


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Weighted means and deviations: inner products of these bound those of ``x``."""
    parts = np.array_split(np.arange(x.shape[1]), min(segments, x.shape[1]))
    out = []
    for p in parts:
        part = x[:, p[0] : p[-1] + 1]
        out += [part.mean(1) * np.sqrt(len(p)), part.std(1) * np.sqrt(len(p))]
    return np.stack(out, 1)


def _keep(row: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row, best first, ties to smaller ids."""
    order = np.lexsort((ids, -scores, row))
    row = row[order]
    kept = np.arange(len(row)) - np.searchsorted(row, np.arange(rows))[row] < k
    order = order[kept]
    return row[kept], ids[order], scores[order]


def search(queries: np.ndarray, own: np.ndarray, candidates: np.ndarray, ids: np.ndarray, k: int = K, levels: tuple[int, ...] = LEVELS, floor: np.ndarray | None = None):
    """(query rows, ids, scores) of each query's k best that reach its ``floor``, and how many pairs were scored exactly.

    ``own`` ids do not count for their query. Of each step of candidates, a query that has
    no k-th best yet scores the k of the highest bound first; then every candidate whose
    bound reaches the k-th best is scored, and no other.
    """
    ids, order = np.unique(ids, return_index=True)
    candidates = candidates[order]
    big = float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * queries.shape[1]
    kind = np.float32 if big < 2.0**23 else np.float64 if big < 2.0**52 else np.int64  # whole numbers are exact in each
    exact_q, exact_c = queries.astype(kind), candidates.astype(kind)
    q, c = queries.astype(np.float64), candidates.astype(np.float64)
    bounds = [(statistics(q, s), statistics(c, s)) for s in levels if s < q.shape[1]]
    least = np.full(len(q), -np.inf) if floor is None else floor.astype(np.float64)
    best = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, kind)
    scored = 0

    def score(r: np.ndarray, at: np.ndarray) -> None:
        nonlocal best, scored
        scored += len(r)
        found = [best]
        for a in range(0, len(r), PAIRS):
            rows, cols = r[a : a + PAIRS], at[a : a + PAIRS]
            values = np.einsum("ij,ij->i", exact_q[rows], exact_c[cols])
            good = values >= least[rows]
            found.append((rows[good], ids[cols[good]], values[good]))
        best = _keep(*(np.concatenate(x) for x in zip(*found, strict=True)), k, len(q))
        full = np.flatnonzero(np.bincount(best[0], minlength=len(q)) == k)
        least[full] = best[2][np.searchsorted(best[0], full, "right") - 1]

    for a in range(0, len(c), STEP):
        b = min(a + STEP, len(c))
        alive = ids[None, a:b] != own[:, None]
        bound = np.full(alive.shape, np.inf)
        for sq, sc in bounds:
            rows = np.flatnonzero(alive.any(1))
            bound[rows] = sq[rows] @ sc[a:b].T
            bound[rows] += 1e-9 * (np.abs(bound[rows]) + 1)
            alive[rows] &= bound[rows] >= least[rows, None]
        new = np.flatnonzero(np.isneginf(least))
        if len(new) and bounds and b - a > k:
            first = np.argpartition(np.where(alive[new], -bound[new], np.inf), k - 1, axis=1)[:, :k]
            r, at = np.repeat(new, k), first.ravel()
            found = alive[r, at]
            score(r[found], at[found] + a)
            alive[r, at] = False
            alive &= bound >= least[:, None]
        r, at = np.nonzero(alive)
        score(r, at + a)
    return (*best, scored)


def prepare(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and the whole-number vector of each row that takes part."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    sound = F.forall("v", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    whole = F.transform("v", lambda v: F.floor(v * F.lit(float(scale))).cast("long"))
    kept = vectors.select(F.col("vec_id").cast("long"), x.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & sound)
    return kept.select("vec_id", whole.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("width", F.size("v"))


def _matrix(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    v = rows.column("v").combine_chunks()
    v = v.chunk(0) if isinstance(v, pa.ChunkedArray) else v
    return rows.column("vec_id").to_numpy(), v.flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)


def _run(k: int, levels: tuple[int, ...], seed: bool):
    """Of a group of queries and one of candidates: each query's k best, or (``seed``) the queries with their k-th best as floor."""

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        own, x = _matrix(q) if q.num_rows else (np.empty(0, np.int64), None)
        row, near, scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        if q.num_rows and c.num_rows:
            ids, y = _matrix(c)
            floor = q.column("floor").to_pandas().to_numpy(dtype=np.float64, na_value=-np.inf)  # exact to 2^53, below in ``top_k``
            row, near, scores, _ = search(x, own, y, ids, k, levels, floor)
        if not seed:
            return pa.table({"query_id": pa.array(own[row], pa.int64()), "vec_id": pa.array(near, pa.int64()), "score": pa.array(scores.astype(np.int64))})
        last = np.flatnonzero(np.bincount(row, minlength=q.num_rows) == k)
        floors = np.zeros(q.num_rows, np.int64)
        floors[last] = scores[np.searchsorted(row, last, "right") - 1].astype(np.int64)
        return q.select(["vec_id", "v", "width"]).append_column("floor", pa.array(floors, pa.int64(), mask=~np.isin(np.arange(q.num_rows), last)))

    return run


def top_k(vectors: DataFrame, queries, k: int = K, scale: int = SCALE, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """``queries``: a condition on vec_id that marks the query rows."""
    rows = prepare(vectors, scale)
    counts = rows.agg(F.count("*").alias("c"), F.count_if(queries).alias("q")).first()
    blocks_q, blocks_c = max(1, -(-counts["q"] // BLOCK_Q)), max(1, -(-counts["c"] // BLOCK_C))
    block = lambda blocks: F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    over = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    others = rows.select(*(F.col(c).alias(c) for c in ("vec_id", "v", "width")))  # names of their own, so that cogroup keeps both sides
    left = rows.where(queries).withColumn("bq", block(blocks_q)).withColumn("floor", F.lit(None).cast("long"))
    if blocks_c > 1:
        sample = others.where(block(blocks_c) == 0).withColumn("bq", over(blocks_q))
        seeded = left.groupBy("bq", "width").cogroup(sample.groupBy("bq", "width")).applyInArrow(_run(k, levels, True), "vec_id long, v array<long>, width int, floor long")
        left = seeded.withColumn("bq", block(blocks_q)).withColumn("floor", F.when(F.abs("floor") < 2**53, F.col("floor")))
    left = left.withColumn("bc", over(blocks_c))
    right = others.withColumn("bc", block(blocks_c)).withColumn("bq", over(blocks_q))
    keys = ["bq", "bc", "width"]
    part = left.groupBy(keys).cogroup(right.groupBy(keys)).applyInArrow(_run(k, levels, False), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # Spark keeps each task's k best before the shuffle
    return part.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


ORACLE_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
