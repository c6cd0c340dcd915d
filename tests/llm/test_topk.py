import numpy as np
import pytest
from pyspark.sql import functions as F

from hazardspark.llm import topk


def brute(vectors, every, k):
    whole = {}
    for i, v in vectors:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            w = [int(np.floor(64 * float(np.float32(x)))) for x in v]
            whole[i] = min(whole.get(i, w), w)
    out = []
    for q in (i for i in whole if i % every == 0):
        scored = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 3e6])
def test_equals_brute_force(spark, monkeypatch, scale):
    monkeypatch.setattr(topk, "BLOCK_Q", 7)
    monkeypatch.setattr(topk, "BLOCK_C", 50)
    monkeypatch.setattr(topk, "STEP", 16)
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x * scale)) for x in rng.normal(size=20)]) for i in range(200)]
    rows += [(300 + i, rows[i % 3][1]) for i in range(30)]  # ties
    rows += [(5, rows[5][1]), (5, rows[6][1]), (None, rows[0][1]), (400, None), (401, []), (402, [None] * 20), (403, [float("nan")] * 20), (404, [float("inf")] * 20), (420, [1.0, 2.0]), (440, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "0 AS score", "1 AS width")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, k=9).collect())
    assert got == brute(rows, 20, 9)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(3)
    x, y = rng.integers(-60, 60, (50, 64)).astype(float), rng.integers(-60, 60, (80, 64)).astype(float)
    for s in topk.LEVELS:
        assert (topk.statistics(x, s) @ topk.statistics(y, s).T + 1e-6 >= x @ y.T).all()


def _scored(x, q, floor=None):
    row, ids, scores, scored = topk.search(x[:q], np.arange(q), x, np.arange(len(x)), 5, topk.LEVELS, floor)
    exact = x[:q] @ x.T
    np.fill_diagonal(exact, -(10**9))
    order = np.argsort(-exact, axis=1, kind="stable")[:, :5]
    wanted = np.take_along_axis(exact, order, 1)
    if floor is None:
        assert (ids.reshape(q, 5) == order).all() and (scores.reshape(q, 5) == wanted).all()
    else:
        assert sorted(zip(row, ids, scores)) == sorted((r, i, s) for r in range(q) for i, s in zip(order[r], wanted[r]) if s >= floor[r])
    return scored / (q * len(x))


def test_share_of_pairs_scored_falls_on_clustered_vectors():
    rng = np.random.default_rng(4)
    loose = rng.integers(-20, 20, (4000, 64))
    level = np.repeat(rng.integers(-40, 40, (8, 8)), 8, axis=1)
    tight = level[rng.integers(0, 8, 4000)] + rng.integers(-3, 4, (4000, 64))
    assert _scored(tight, 60) < 0.2 and _scored(tight, 60) < _scored(loose, 60) < 1
    floor = np.sort(loose[:60] @ loose.T, axis=1)[:, -8].astype(float)
    assert _scored(loose, 60, floor) < _scored(loose, 60)
