import zlib

import numpy as np

from hazardspark.llm import quality


def corpus(n=160):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    rows = []
    for i in range(n):
        ws = list(rng.choice(words, 60))
        good = i % 3 > 0
        rows.append((i, " ".join(ws if good else [w.upper() + "!!" for w in ws]), int(good)))
    return rows


def test_held_out_accuracy_and_odd_rows(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, None), (1001, ""), (None, rows[0][1]), (3, rows[3][1]), (1002, "x " * 50_000)], "doc_id long, text string").selectExpr("*", "1D AS score", "'a' AS label")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None), (5, rows[5][2])], "doc_id long, quality int")
    model = quality.learn(docs, labels)
    got = quality.score(docs, model).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted").collect()
    assert len(got) == len(rows) + 5
    truth = {i: y for i, _, y in rows}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    kept_out = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in kept_out]) > 0.95
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert len(by[3]) == 1 and by[1000] == by[1001] and by[None] == by[0]
    assert quality.score(docs.limit(0), model).count() == 0


def test_labels_held_out_do_not_matter(spark):
    rows = corpus(60)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    flip = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, _, y in rows]
    a = quality.learn(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int"))
    b = quality.learn(docs, spark.createDataFrame(flip, "doc_id long, quality int"))
    assert all(np.array_equal(x, y) for x, y in zip(a.layers, b.layers, strict=True))


def test_repeated_doc_id_is_one_text(spark):
    rows = corpus(60)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    once = [(i, t) for i, t, _ in rows]
    often = next((i, t) for i, t in once if zlib.crc32(str(i).encode()) % 3 != 1)
    more = once + [often] * 300 + [(often[0], None), (often[0], often[1] + " and a later version")]
    a, b = (quality.learn(spark.createDataFrame(r, "doc_id long, text string"), labels) for r in (once, more))
    assert all(np.array_equal(x, y) for x, y in zip(a.layers, b.layers, strict=True))


def test_one_kind_of_label_gives_the_share():
    assert quality.fit(["a", "b"], [1, 1]).prior == 1.0 and quality.fit([], []).prior == 0.5
    assert quality.fit(["a", "b"], [1, 1]).layers is None


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    z = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-z))).astype(float)
    assert 2.5 < quality._temperature(z * 3, y) < 3.5
