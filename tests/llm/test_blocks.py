import random

import pytest

from hazardspark.llm import blocks, jaccard, lm, suffixes
from tests.llm import test_lm, test_suffixes

SIZE = 2000


def rows():
    """Ids with a third of the rows each, of equal and of different texts; and neighbours with long texts."""
    rng = random.Random(5)
    say = lambda n: " ".join(f"w{rng.randrange(90)}" for _ in range(n))
    out = [(40, say(12)) for _ in range(120)] + [(40, "the same text in all of these rows, of more than fifty bytes")] * 120
    out += [(None, say(12)) for _ in range(120)] + [(i, say(4)) for i in range(200)] + [(i, say(100)) for i in range(300, 340)]
    out += [(41 + i, out[i * 7][1]) for i in range(40)] + [(39, out[3][1]), (None, out[3][1])]
    rng.shuffle(out)
    return out


def test_blocks_are_bounded(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string")
    held = {}
    for r in blocks.with_blocks(docs, SIZE).collect():
        part = blocks.unpack(__import__("pyarrow").table({"packed": [r.packed]}))
        held.setdefault(r.block, []).extend(part.select(["doc_id", "text"]).to_pylist())
    assert sorted(((x["doc_id"], x["text"]) for v in held.values() for x in v), key=str) == sorted(rows(), key=str)
    assert max(sum(len(x["text"]) for x in v) for v in held.values()) < 2.5 * SIZE
    order = [sorted(blocks.MOST if x["doc_id"] is None else x["doc_id"] for x in held[b]) for b in sorted(held)]
    assert all(a[-1] <= b[0] for a, b in zip(order, order[1:], strict=False))


def test_results_with_heavy_ids(spark, monkeypatch):
    cut = blocks.with_blocks
    monkeypatch.setattr(blocks, "with_blocks", lambda d, size=0, carried=(): cut(d, SIZE, carried))
    docs = spark.createDataFrame(rows(), "doc_id long, text string")
    assert sorted((tuple(r) for r in suffixes.remove_repeats(docs).collect()), key=str) == test_suffixes.brute(rows())
    got = sorted(((r.doc_id, r.n_tokens, pytest.approx(r.score, abs=1e-5)) for r in lm.score(docs).collect()), key=lambda x: (str(x[0]), x[1], x[2].expected))
    assert got == sorted(test_lm.brute(rows()), key=lambda x: (str(x[0]), x[1], x[2]))


def test_numbers_above_32_bits(spark, monkeypatch):
    monkeypatch.setattr(blocks, "PART", 34)
    cut = blocks.with_blocks
    monkeypatch.setattr(blocks, "with_blocks", lambda d, size=0, carried=(): cut(d, SIZE, carried))
    docs = spark.createDataFrame(rows(), "doc_id long, text string")
    numbers = [r.block for r in blocks.with_blocks(docs).select("block").distinct().collect()]
    assert max(numbers) > 2**36 and min(numbers) >= 0
    assert sorted((tuple(r) for r in suffixes.remove_repeats(docs).collect()), key=str) == test_suffixes.brute(rows())
    got = sorted(((r.doc_id, r.n_tokens, pytest.approx(r.score, abs=1e-5)) for r in lm.score(docs).collect()), key=lambda x: (str(x[0]), x[1], x[2].expected))
    assert got == sorted(test_lm.brute(rows()), key=lambda x: (str(x[0]), x[1], x[2]))
    few = [(i, t) for i, t in rows() if i is not None and i > 40][:200]
    narrow = spark.createDataFrame(few, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in jaccard.components(narrow).select("doc_id", "component_id").collect()}
    monkeypatch.setattr(blocks, "with_blocks", cut)
    assert found == {r.doc_id: r.component_id for r in jaccard.components(narrow).select("doc_id", "component_id").collect()}
