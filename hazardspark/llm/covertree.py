"""Hard-negative mining by cover trees over norm-augmented vectors.

Candidates get one component more, which brings all of them to the norm of the longest;
a query gets 0 there. Inner products are what they were, and now fall with distance. A
block of candidates is held as a cover tree: the children of a node of one level lie more
than half its radius apart and cover its points within that half; each node keeps its
covering radius, so every point below it has an inner product within bounds around that of
the node's own point. Search goes best first: of the nodes that wait, the one that may
hold the best score within a window of scores is opened next; a node whose bounds lie outside all
windows, or below what a window holds already, is skipped with all its points; the points
of leaves are scored exactly.

Two searches run over the same trees, which are built once and written. The first finds
each anchor's best rows of the same label, its positives; each of them sets a window of
scores. The second finds the best rows of other labels in all windows of an anchor at once.

Rows are dealt by hash over blocks of about ``BLOCK_C`` candidates and ``BLOCK_A`` anchors;
each pair of blocks is one small group, and gives at most k rows for each anchor and
window. A vector or label that most rows share is spread over all blocks; no row set is
broadcast; what moves is rows x blocks, never pairs.

Defined results: vectors that are null, empty, or hold a null or non-finite component take
no part, nor do rows without label or vec_id; of rows with the same vec_id, one counts (the
smallest vector in array order, then the smallest label); vectors of different lengths are not compared; an anchor without
another row of its label, or a positive without a row in its window, gives no rows; other
columns are ignored; an empty table gives no rows. Scores are exact where they fit a long.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazardspark.llm.common import materialize, table

SCALE, EVERY, POSITIVES, NEGATIVES, LOW, HIGH = 256, 50, 5, 3, 50, 95
RELABEL, LABELS = 7, 10
BLOCK_A, BLOCK_C, LEAF, OPENED = 1024, 4096, 32, 64
NO_WINDOW = (-(2**63) + 1, 2**63 - 1)


class Tree:
    """A cover tree of one block; the points below a node are a stretch of ``ids``."""

    ARRAYS = ("ids", "labels", "centre", "radius", "start", "stop", "child", "children", "least", "most")

    def __init__(self, x: np.ndarray, **arrays: np.ndarray):
        self.x = x
        for name in self.ARRAYS:
            setattr(self, name, arrays[name])
        self.flat = x.astype(np.float64)
        squares = np.einsum("ij,ij->i", self.flat, self.flat)
        self.longest = float(squares.max(initial=0.0))
        self.largest = float(np.abs(self.flat).max(initial=0.0))

    @staticmethod
    def augmented(x: np.ndarray) -> np.ndarray:
        flat = x.astype(np.float64)
        squares = np.einsum("ij,ij->i", flat, flat)
        return np.column_stack([flat, np.sqrt(squares.max(initial=0.0) - squares)])

    @classmethod
    def build(cls, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> Tree:
        order = np.argsort(ids, kind="stable")
        ids, labels, x = ids[order], labels[order], x[order]
        points = cls.augmented(x)
        far = lambda at, c: np.sqrt(np.square(points[at] - points[c]).sum(1))
        everything = np.arange(len(ids))
        nodes = [(everything, 0, float(far(everything, 0).max(initial=0.0)))]
        child, children = [], []
        for members, centre, radius in nodes:  # grows while it is read, level after level
            child.append(len(nodes))
            if len(members) > LEAF and radius > 0:
                half = 2.0 ** np.ceil(np.log2(radius)) / 2
                half = half if half < radius else radius / 2
                rest, c = members, centre
                while len(rest):
                    d = far(rest, c)
                    near = d <= half
                    nodes.append((rest[near], c, float(d[near].max())))
                    rest = rest[~near]
                    c = rest[0] if len(rest) else c
            children.append(len(nodes) - child[-1])
        # the leaves, in the order of the tree, are the stretches of points
        child, children = np.array(child), np.array(children)
        start, stop, placed = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64), []
        at, waiting = 0, [0]
        while waiting:
            i = waiting.pop()
            start[i], stop[i] = at, at + len(nodes[i][0])
            if children[i]:
                inside = at
                for j in range(child[i], child[i] + children[i]):
                    start[j], stop[j] = inside, inside + len(nodes[j][0])
                    inside = int(stop[j])
                for j in range(child[i] + children[i] - 1, child[i] - 1, -1):
                    waiting.append(j)
            else:
                placed.append(nodes[i][0])
                at += len(nodes[i][0])
        perm = np.concatenate(placed)
        back = np.empty(len(perm), np.int64)
        back[perm] = np.arange(len(perm))
        least, most = (np.array([f(labels[m]) for m, *_ in nodes]) for f in (np.min, np.max))
        return cls(
            x[perm], ids=ids[perm], labels=labels[perm], centre=back[[c for _, c, _ in nodes]], radius=np.array([r for *_, r in nodes]) * (1 + 1e-9),
            start=start, stop=stop, child=child, children=children, least=least, most=most,
        )

    def bounds(self, nodes: np.ndarray, q: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest inner product of ``q`` with the points below nodes."""
        at = self.flat[self.centre[nodes]] @ q
        r, total = self.radius[nodes], size + self.longest
        d = np.sqrt(np.maximum(total - 2 * at, 0))
        slack = 1e-6 * (total + 1)
        low = np.maximum(at - np.sqrt(size) * r, (total - np.square(d + r)) / 2) - slack
        high = np.minimum(at + np.sqrt(size) * r, (total - np.square(np.maximum(d - r, 0))) / 2) + slack
        return low, high

    def search(self, query: np.ndarray, own: int, label: int, same: bool, windows: list[tuple[int, int]], k: int) -> tuple[list[list[tuple[int, int]]], int]:
        """Each window's k best (score, id) of the rows of the ``same`` label or of others, and how many points were scored."""
        q = query.astype(np.float64)
        size = float(q @ q)
        exact = np.float64 if float(np.abs(q).max(initial=0.0)) * self.largest * len(q) < 2.0**52 else np.int64  # whole numbers are exact in both
        points, sought = self.flat if exact is np.float64 else self.x.astype(np.int64), query.astype(exact)
        lows, highs = np.array(windows, dtype=np.int64).T
        floors, best = lows.copy(), [[] for _ in windows]
        scored = 0

        def open_nodes(nodes: np.ndarray):
            """Those of ``nodes`` that reach a window, and the best score that each may add."""
            fits = (self.least[nodes] <= label) & (self.most[nodes] >= label) if same else (self.least[nodes] != label) | (self.most[nodes] != label)
            nodes = nodes[fits]
            low, high = self.bounds(nodes, q, size)
            reach = (high[:, None] >= floors) & (low[:, None] <= highs)
            may = np.where(reach, np.minimum(high[:, None], highs), -np.inf).max(1)
            alive = reach.any(1)
            return nodes[alive], may[alive]

        def score(leaves: np.ndarray):
            nonlocal scored
            at = np.concatenate([np.arange(self.start[n], self.stop[n]) for n in leaves])
            at = at[((self.labels[at] == label) == same) & (self.ids[at] != own)]
            scored += len(at)
            values, ids = points[at] @ sought, self.ids[at]
            for j, (floor, high) in enumerate(zip(floors, highs, strict=True)):
                good = np.flatnonzero((values >= floor) & (values <= high))
                if len(good):
                    first = good[np.lexsort((ids[good], -values[good]))[:k]]
                    best[j] = sorted(best[j] + [(int(values[i]), int(ids[i])) for i in first], key=lambda f: (-f[0], f[1]))[:k]
                    if len(best[j]) == k:
                        floors[j] = max(lows[j], best[j][-1][0])

        waiting = []
        number = 0

        def push(nodes: np.ndarray):
            """Inner nodes wait one by one, leaves in handfuls of like promise."""
            nonlocal number
            nodes, may = open_nodes(nodes)
            leaf = self.children[nodes] == 0
            for n, m in zip(nodes[~leaf], may[~leaf], strict=True):
                heapq.heappush(waiting, (-m, number, False, np.array([n])))
                number += 1
            order = np.argsort(-may[leaf], kind="stable")
            leaves, may = nodes[leaf][order], may[leaf][order]
            for a in range(0, len(leaves), OPENED):
                heapq.heappush(waiting, (-may[a], number, True, leaves[a : a + OPENED]))
                number += 1

        if len(self.ids):
            push(np.array([0]))
        while waiting:
            may, _, leaf, nodes = heapq.heappop(waiting)
            if -may < floors.min():
                break
            nodes, _ = open_nodes(nodes)
            if len(nodes):
                score(nodes) if leaf else push(np.arange(self.child[nodes[0]], self.child[nodes[0]] + self.children[nodes[0]]))
        return best, scored

    def pack(self) -> dict[str, bytes]:
        kind = next(k for k in (np.int16, np.int32, np.int64) if self.largest <= np.iinfo(k).max)
        return {"x": self.x.astype(kind).tobytes(), "wide": np.dtype(kind).itemsize, **{n: getattr(self, n).astype(np.float64 if n == "radius" else np.int64).tobytes() for n in self.ARRAYS}}

    @classmethod
    def unpack(cls, row: dict) -> Tree:
        arrays = {n: np.frombuffer(row[n], np.float64 if n == "radius" else np.int64) for n in cls.ARRAYS}
        return cls(np.frombuffer(row["x"], f"i{row['wide']}").reshape(len(arrays["ids"]), -1).astype(np.int64), **arrays)


INDEX = "bc int, width int, wide int, x binary, " + ", ".join(f"{n} binary" for n in Tree.ARRAYS)


def _matrix(rows: pa.Table) -> np.ndarray:
    return rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)


def index(rows: DataFrame, blocks: int) -> DataFrame:
    """One row for each block of candidates: its cover tree."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        tree = Tree.build(group.column("vec_id").to_numpy(), group.column("label").to_numpy(), _matrix(group))
        return pa.Table.from_pylist([{"bc": key[0].as_py(), "width": key[1].as_py(), **tree.pack()}], _arrow_schema())

    return rows.withColumn("bc", _block(blocks)).groupBy("bc", "width").applyInArrow(run, INDEX)


def _arrow_schema() -> pa.Schema:
    whole = {"bc": pa.int32(), "width": pa.int32(), "wide": pa.int32()}
    return pa.schema([(n, whole.get(n, pa.binary())) for n in ("bc", "width", "wide", "x", *Tree.ARRAYS)])


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")


FOUND = "anchor_id long, positive_id long, positive_score long, found_id long, score long"


def _search(anchors: DataFrame, trees: DataFrame, blocks_a: int, blocks_c: int, same: bool, k: int) -> DataFrame:
    """Every anchor against every tree of its width; ``windows`` of an anchor: (positive_id, positive_score, low, high), or none for all scores."""
    over = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = anchors.withColumn("ba", _block(blocks_a)).withColumn("bc", over(blocks_c))
    right = trees.withColumn("ba", over(blocks_a))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            tree = Tree.unpack(right.to_pylist()[0])
            for q, own, label, windows in zip(_matrix(left), left.column("vec_id").to_pylist(), left.column("label").to_pylist(), left.column("windows").to_pylist(), strict=True):
                sought = [(w["low"], w["high"]) for w in windows] if windows else [NO_WINDOW]
                best, _ = tree.search(q, own, label, same, sought, k)
                for w, found in zip(windows or [{"positive_id": None, "positive_score": None}], best, strict=True):
                    out += [(own, w["positive_id"], w["positive_score"], i, s) for s, i in found]
        columns = zip(*out, strict=True) if out else [[]] * 5
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["anchor_id", "positive_id", "positive_score", "found_id", "score"])

    keys = ["ba", "bc", "width"]
    found = left.groupBy(keys).cogroup(right.groupBy(keys)).applyInArrow(run, FOUND)
    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "found_id")  # Spark keeps each task's k best before the shuffle
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def prepare(vectors: DataFrame, label: Column, scale: int = SCALE) -> DataFrame:
    """vec_id, whole-number vector, width and label of each row that takes part."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    sound = F.forall("v", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    whole = F.transform("v", lambda v: F.floor(v * F.lit(float(scale))).cast("long"))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("v"), label.cast("long").alias("label"))
    kept = kept.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & sound)
    one = kept.select("vec_id", F.struct(whole.alias("v"), "label").alias("r")).groupBy("vec_id").agg(F.min("r").alias("r"))
    return one.select("vec_id", "r.v", "r.label", F.size("r.v").alias("width"))


def mine(vectors: DataFrame, anchors: Column, label: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """Negatives of each anchor and positive: the best rows of another label that score ``low`` to ``high`` percent of the positive.

    ``anchors``: a condition on vec_id; ``label``: the label of a row of ``vectors``.
    """
    rows = materialize(prepare(vectors, label, scale), "hard-negatives-rows")
    counts = rows.agg(F.count("*").alias("c"), F.count_if(anchors).alias("a")).first()
    blocks_a, blocks_c = max(1, -(-counts["a"] // BLOCK_A)), max(1, -(-counts["c"] // BLOCK_C))
    trees = materialize(index(rows, blocks_c), "hard-negatives-trees")
    asked = rows.where(anchors)
    none = F.lit(None).cast("array<struct<positive_id: bigint, positive_score: bigint, low: bigint, high: bigint>>")
    near = _search(asked.withColumn("windows", none), trees, blocks_a, blocks_c, True, positives)
    # low * positive <= 100 * score <= high * positive, in whole numbers
    score = F.col("score").cast("decimal(38,0)")
    whole = lambda e: e.cast("long")
    window = F.struct(F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"), whole(F.ceil(score * low / 100)).alias("low"), whole(F.floor(score * high / 100)).alias("high"))
    windows = near.select(F.col("anchor_id").alias("vec_id"), window.alias("w")).where("w.low <= w.high").groupBy("vec_id").agg(F.collect_list("w").alias("windows"))  # at most ``positives`` each
    found = _search(asked.join(windows, "vec_id"), trees, blocks_a, blocks_c, False, negatives)
    return found.select("anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % RELABEL == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0, label)


ORACLE_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i])) AS BIGINT) AS score
      FROM e a JOIN e c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE same) WHERE n <= 5),
r AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 3
"""
