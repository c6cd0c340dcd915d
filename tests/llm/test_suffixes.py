import hashlib
import random

import numpy as np
import pytest

from hazardspark.llm import blocks, suffixes


def brute(rows, length=suffixes.LENGTH):
    seen = {}
    big = (1 << 63) - 1
    for i, t in rows:
        raw = (t or "").encode()
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            seen[s] = min(seen.get(s, big), big if i is None else i)
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            if seen[raw[p : p + length]] < (big if i is None else i):
                gone[p : p + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((i, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows():
    rng = random.Random(3)
    words = ["the", "of", "é日本", "running", "x", "passage", "ab", "cd", "zebra", "\n"]
    say = lambda n: " ".join(rng.choices(words, k=n))
    shared = [say(30), "#" * 120, "ab " * 60, say(9)[:49].ljust(49, "q"), say(11)[:50].ljust(50, "q")]
    out = [(100 - i, " ".join([say(rng.randint(0, 60)), rng.choice(shared), say(rng.randint(0, 60)), rng.choice(shared + [""])])) for i in range(60)]
    out += [(200 + i, out[i % 4][1]) for i in range(12)]  # copies
    out += [(7, out[3][1]), (7, out[3][1]), (None, out[5][1]), (None, say(40)), (300, None), (301, ""), (302, "#" * 3000), (303, shared[3]), (304, shared[3] + "!"), (305, out[0][1][:70] + "?" + out[0][1][70:])]
    return out


@pytest.mark.parametrize("size,stretch,hot,weak", [(8 << 20, 1 << 20, 32, None), (1500, 97, 32, None), (1500, 97, 3, None), (1500, 1 << 20, 32, 0xFF << 40), (1500, 97, 2, 0)])
def test_equals_brute_force(spark, monkeypatch, size, stretch, hot, weak):
    monkeypatch.setattr(suffixes, "STRETCH", stretch)
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "AT_ONCE", 50)
    if weak is not None:  # leads of equal hash by the hundred: the bytes decide
        full = suffixes._hashes
        monkeypatch.setattr(suffixes, "_hashes", lambda raw, n: full(raw, n) & np.uint64(weak))
    monkeypatch.setattr(suffixes, "BLOCK", size)
    docs = spark.createDataFrame(rows(), "doc_id long, text string").selectExpr("*", "1 AS block", "2 AS bucket")
    got = suffixes.remove_repeats(docs)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows())
    assert suffixes.remove_repeats(docs.limit(0)).count() == 0


def test_multikey_sorts_like_bytes():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 3, (500, 18)).astype(np.uint8) * 127
    rows[:, :6] = rows[0, :6]
    order, new = suffixes.multikey(suffixes._words(rows))
    made = [rows[i].tobytes() for i in order]
    assert made == sorted(r.tobytes() for r in rows)
    assert new.tolist() == [i == 0 or made[i] != made[i - 1] for i in range(len(made))]


def test_kept_text(spark):
    passage = "a passage of some length that stands in both of these documents here"
    docs = spark.createDataFrame([(1, f"one {passage} x"), (2, f"two {passage} y")], "doc_id long, text string").selectExpr("7 AS n_chars", "*", "'a' AS lang", "9 AS block", "8 AS rest", "'b' AS _", "1 AS packed")
    got = suffixes.without_repeats(docs)
    assert got.columns == docs.columns
    assert {r.doc_id: r.text for r in got.collect()} == {1: f"one {passage} x", 2: "twoy"}


def test_block_of(spark):
    for splitters in ([], [5], [1, 5, 9], list(range(0, 100, 7))):
        df = spark.range(-3, 110).select("id", blocks.block_of(__import__("pyspark").sql.functions.col("id"), splitters).alias("b"))
        assert all(r.b == sum(s <= r.id for s in splitters) for r in df.collect())
