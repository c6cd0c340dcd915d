import math
import random
from collections import Counter

import numpy as np
import pytest

from hazardspark.llm import lm


def grams(words):
    return [(tuple(words[i - n + 1 : i + 1])) for n in range(1, lm.ORDER + 1) for i in range(n - 1, len(words))]


def brute(rows):
    docs = [(t or "").lower().split(" ") if t else [] for _, t in rows]
    docs = [[w for w in d if w] for d in docs]
    total = Counter(g for d in docs for g in grams(d))
    n = sum(map(len, docs))
    out = []
    for (doc_id, _), words in zip(rows, docs, strict=True):
        own = Counter(grams(words))
        c = lambda g: total[g] - own[g]  # noqa: B023, E731
        rest, s = n - len(words), 0.0
        for i in range(len(words)):
            top = min(i + 1, lm.ORDER)
            for k in range(top, 0, -1):
                g = tuple(words[i - k + 1 : i + 1])
                if c(g) > 0:
                    s += math.log(lm.ALPHA) * (top - k) + math.log(c(g) / (rest if k == 1 else c(g[:-1])))
                    break
            else:
                s += math.log(lm.ALPHA) * lm.ORDER - math.log(rest + 1)
        out.append((doc_id, len(words), s))
    return out


@pytest.mark.parametrize("size", [8 << 20, 700])
def test_equals_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(lm, "BLOCK", size)
    rng = random.Random(9)
    words = [f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(3000)]
    rows = [(i, " ".join(words[rng.randrange(2000) :][: rng.randint(0, 40)])) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "alone"), (503, "Unseen Words Here"), (3, rows[3][1]), (None, rows[4][1]), (504, "the " * 2000), (505, "the " * 700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS size")
    got = sorted(((r.doc_id, r.n_tokens, round(r.score, 6)) for r in lm.score(docs).collect()), key=str)
    assert got == sorted(((d, n, round(s, 6)) for d, n, s in brute(rows)), key=str)
    assert lm.score(docs.limit(0)).count() == 0
    assert all((r.mean_score is None) == (r.n_tokens == 0) for r in lm.score(docs).collect())


def test_ngrams_with_equal_low_bits_stay_apart(spark):
    # hashes of these two trigrams are equal in the low 40 bits and in the bucket, of 16
    rows = [(1, "one two w13730028"), (2, "three four w7431788"), (3, "other words")]
    got = sorted((r.doc_id, r.n_tokens, round(r.score, 6)) for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted((d, n, round(s, 6)) for d, n, s in brute(rows))


def test_keys_travel_whole():
    keys = np.unique(np.concatenate([np.random.default_rng(1).integers(0, 1 << 64, 5000, dtype=np.uint64), np.array([0, 1, (1 << 64) - 1], np.uint64)]))
    counts = np.where(np.arange(len(keys)) % 7 == 0, 1 << 40, 1)
    got = lm._received(lm._sent(keys, counts), len(keys))
    assert np.array_equal(got[0], keys) and np.array_equal(got[1], counts)
