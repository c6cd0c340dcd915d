import zlib

import numpy as np
import pytest

from hazardspark.llm import langid

LETTERS = {"a": "abcdefgh", "b": "efghijkl", "c": "ijklmnéß"}


def corpus(n=300):
    rng = np.random.default_rng(3)
    out = []
    for i in range(n):
        lang = "abc"[i % 3]
        out.append((i, " ".join("".join(rng.choice(list(LETTERS[lang]), rng.integers(2, 7))) for _ in range(rng.integers(3, 40))) + ". 12", lang))
    return out


def brute(text):
    """Buckets of a text's subwords, by hand."""
    text = "\n" + text.lower() + "\n" * 4
    counts = np.zeros(langid.BUCKETS, int)
    for at in range(len(text)):
        for n in range(1, langid.LONGEST + 1):
            gram = [ord(c) if c.isalpha() else 0 for c in text[at : at + n]]
            if len(gram) < n or not any(gram) or 0 in gram[1:-1]:
                continue
            h = 0
            for c in gram:
                h = (h * 0x01000193 + c) % 2**32
            counts[((h + n) * 0x9E3779B1) % 2**32 // (2**32 // langid.BUCKETS)] += 1
    return counts


TEXTS = ["Ünder the Straße, 3 times!", "", "…", "a", "日本語 テキスト", "don't  stop\nnow", "x" * 30]


def test_counts_equal_subwords_by_hand(monkeypatch):
    reader = langid.Reader()
    counts, letters = reader.counts(TEXTS)
    assert all((counts[i] == brute(t)).all() and letters[i] == sum(map(str.isalpha, t.lower())) for i, t in enumerate(TEXTS))
    monkeypatch.setattr(langid, "PIECE", 7)
    long = " ".join(TEXTS) * 3
    counts, letters = reader.counts([long])
    assert (counts[0] == brute(long)).all() and letters[0] == sum(map(str.isalpha, long.lower()))
    seen = [(a, b, c.sum(), alone.sum()) for a, b, c, alone in reader.batches([*TEXTS, long])]
    assert [s[0] for s in seen] == [0, *(s[1] for s in seen[:-1])] and sum(s[2] for s in seen) == sum(brute(t).sum() for t in [*TEXTS, long])


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, v) for i, t, v in corpus()]
    rows += [(1000, None, "a"), (1001, "", "b"), (1002, "12 ... 3", "c"), (None, rows[0][1], "zz"), (3, rows[3][1], "a"), (1003, rows[4][1] * 5000, None)] + [(1007, "abc abc", "a")] * 50
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1D AS score", "'x' AS rejected", "2 AS counts")


def test_held_out_accuracy_and_odd_rows(spark, docs):
    model = langid.learn(docs)
    assert model.languages == ["a", "b", "c"] and 0 <= model.least <= 1
    got = langid.predict(docs, model)
    assert set(got.columns) == set(docs.columns) | {"lang_pred"}
    got = got.select("doc_id", "lang", "lang_pred", "score", "rejected", langid.held_out().alias("held_out")).collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.lang == r.lang_pred for r in got if r.held_out and r.doc_id < 300]) > 0.95
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.lang_pred, r.score, r.rejected))
    assert all(by[i] == {("und", 0.0, True)} for i in (1000, 1001, 1002))
    assert by[None] == by[0] and len(by[3]) == 1 and {v[0] for v in by[1003]} == {v[0] for v in by[4]}
    assert all(0 < r.score <= 1 and r.lang_pred in "abc" for r in got if r.lang_pred != "und")
    assert langid.predict(docs.limit(0), model).count() == 0


def test_held_out_labels_do_not_matter(spark, docs):
    other = docs.selectExpr("doc_id", "CASE WHEN crc32(binary(string(doc_id))) % 4 = 2 THEN 'nothing' ELSE text END AS text", "CASE WHEN crc32(binary(string(doc_id))) % 4 = 2 THEN 'q' ELSE lang END AS lang")
    a, b = langid.learn(docs), langid.learn(other)
    assert a.languages == b.languages and np.array_equal(a.weights, b.weights) and (a.temperature, a.least) == (b.temperature, b.least)


def test_few_labels(spark, docs):
    none = langid.learn(docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang"))
    assert {(r.lang_pred, r.score, r.rejected) for r in langid.predict(docs, none).collect()} == {("und", 0.0, True)}
    one = langid.predict(docs, langid.learn(docs.selectExpr("doc_id", "text", "'only' AS lang"))).collect()
    assert {(r.lang_pred, r.score) for r in one} == {("und", 0.0), ("only", 1.0)}


def test_sample_is_bounded_and_even(spark, docs):
    chosen = [r.lang for r in langid.sampled(docs, 60).collect()]
    assert 30 <= len(chosen) <= 60 and all(chosen.count(v) >= 8 for v in "abc")
    assert {r.lang for r in langid.sampled(docs, 60, 2).collect()} <= {"a", "b", "c"} and langid.sampled(docs, 60, 2).select("lang").distinct().count() == 2


def test_temperature_and_rejection_calibrate():
    rng = np.random.default_rng(0)
    z = rng.normal(0, 2, (6000, 3))
    p = langid.softmax(z)
    y = (p.cumsum(1) > rng.random((6000, 1))).argmax(1)
    temperature, least = langid.calibrate(z * 3, y, 0.95)
    assert 2.6 < temperature < 3.4
    p = langid.softmax(z * 3 / temperature)
    taken = p.max(1) >= least
    assert 0.2 < taken.mean() < 0.9 and (p.argmax(1) == y)[taken].mean() >= 0.95
    assert langid.calibrate(z, (z.argmax(1) + 1) % 3, 0.95)[1] == 1.0
