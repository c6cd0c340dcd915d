import numpy as np
import pytest
from pyspark.sql import functions as F

from hazardspark.llm import covertree
from hazardspark.llm.covertree import NO_WINDOW, Tree


def brute(rows, every, positives=5, negatives=3):
    sound = {}
    for i, v, l in rows:
        if i is not None and l is not None and v and all(x is not None and np.isfinite(x) for x in v):
            one = ([int(np.floor(256 * float(np.float32(x)))) for x in v], (l + 1) % 10 if i % 7 == 0 else l)
            sound[i] = min(sound.get(i, one), one)
    out = []
    for a in (i for i in sound if i % every == 0):
        v, l = sound[a]
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, m) for i, (w, m) in sound.items() if i != a and len(w) == len(v))
        for s, p, _ in [f for f in scored if f[2] == l][:positives]:
            hard = [f for f in scored if f[2] != l and 50 * -s <= 100 * -f[0] <= 95 * -s]
            out += [(a, p, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(hard[:negatives])]
    return sorted(out)


def mined(df, every):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return covertree.mine(df, F.col("vec_id") % every == 0, label)


@pytest.mark.parametrize("scale", [1.0, 1e6])  # above 2^53
def test_equals_brute_force(spark, monkeypatch, scale):
    monkeypatch.setattr(covertree, "BLOCK_A", 9)
    monkeypatch.setattr(covertree, "BLOCK_C", 70)
    monkeypatch.setattr(covertree, "LEAF", 4)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(4, 12))
    rows = [(i, [float(np.float32(x * scale)) for x in centres[i % 4] + rng.normal(0, 0.4, 12)], int(rng.integers(0, 4))) for i in range(260)]
    rows += [(300 + i, rows[3][1], i % 3) for i in range(120)]  # one vector of a third of the rows
    rows += [(10, rows[10][1], rows[10][2]), (10, rows[11][1], 9), (None, rows[0][1], 1), (500, None, 1), (510, [], 1), (520, [None] * 12, 1), (530, [float("nan")] * 12, 1), (540, [float("inf")] * 12, 1)]
    rows += [(550, rows[5][1], None), (560, [1.0, 2.0], 1), (570, [0.5, 0.5], 1), (571, [0.4, 0.5], 2), (580, [0.0] * 12, 2), (590, rows[5][1], 77)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "0 AS score", "1 AS width", "2 AS rank", "'w' AS windows")
    got = sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in mined(df, 10).collect())
    assert got == brute(rows, 10) and len(got) > 100
    assert mined(df.limit(0), 10).count() == 0


def test_tree_covers_and_separates():
    rng = np.random.default_rng(1)
    x = rng.integers(-99, 99, (900, 6))
    x[100:300] = x[0]
    tree = Tree.build(np.arange(900), np.zeros(900, np.int64), x)
    points = Tree.augmented(tree.x)
    assert sorted(tree.ids) == list(range(900)) and (tree.x == x[tree.ids]).all()
    for n in range(len(tree.centre)):
        below = points[tree.start[n] : tree.stop[n]]
        assert np.linalg.norm(below - points[tree.centre[n]], axis=1).max() <= tree.radius[n] + 1e-9
        if tree.children[n]:
            kids = np.arange(tree.child[n], tree.child[n] + tree.children[n])
            assert tree.centre[n] in tree.centre[kids] and tree.start[kids[0]] == tree.start[n] and tree.stop[kids[-1]] == tree.stop[n]
            gaps = np.linalg.norm(points[tree.centre[kids]][:, None] - points[tree.centre[kids]][None], axis=2) + np.eye(len(kids)) * 1e9
            half = 2.0 ** np.ceil(np.log2(tree.radius[n] / (1 + 1e-9))) / 2
            assert gaps.min() > min(half, tree.radius[n] / 2) and (tree.radius[kids] <= half * (1 + 1e-6)).all()
    q = rng.integers(-99, 99, 6).astype(float)
    low, high = tree.bounds(np.arange(len(tree.centre)), q, float(q @ q))
    for n in range(len(tree.centre)):
        at = tree.x[tree.start[n] : tree.stop[n]] @ q
        assert low[n] <= at.min() and at.max() <= high[n]
    again = Tree.unpack(tree.pack())
    assert (again.x == tree.x).all() and all((getattr(again, a) == getattr(tree, a)).all() for a in Tree.ARRAYS)


def test_windows_skip_most_points_of_clustered_vectors():
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 100, (40, 16))
    x = np.round(centres[rng.integers(0, 40, 4000)] + rng.normal(0, 4, (4000, 16))).astype(np.int64)
    labels = rng.integers(0, 5, 4000)
    tree = Tree.build(np.arange(4000), labels, x)
    share = []
    for i in range(0, 4000, 100):
        exact = x @ x[i]
        for same, window in ((True, NO_WINDOW), (False, (int(exact.max() * 0.2), int(exact.max() * 0.3)))):
            ((found,), scored) = tree.search(x[i], i, labels[i], same, [window], 5)
            right = [(int(exact[j]), j) for j in range(4000) if j != i and (labels[j] == labels[i]) == same and window[0] <= exact[j] <= window[1]]
            assert found == sorted(right, key=lambda f: (-f[0], f[1]))[:5]
            share.append(scored / 4000)
    assert np.mean(share) < 0.1
