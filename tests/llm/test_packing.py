import cProfile
import json
import pstats
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hazardspark.llm import packing


@pytest.mark.parametrize("seed", range(6))
def test_bins_hold_what_they_say(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(rng.geometric(0.01, 3000), 256) if seed else np.array([256] * 5 + [1] * 3)
    bins, offsets = packing.two_fit(lengths, 256)
    for b in np.unique(bins):
        rows = np.flatnonzero(bins == b)
        rows = rows[np.argsort(offsets[rows])]
        assert offsets[rows].tolist() == np.concatenate([[0], np.cumsum(lengths[rows])[:-1]]).tolist()
        assert lengths[rows].sum() <= 256
    assert bins.max() + 1 <= -(-lengths.sum() // 256) + 1 + seed


def test_replacing_the_smallest_beats_greedy():
    # greedy fills 10 with 6 and 3; 6 and 2 and 2 leave no gap
    bins, _ = packing.two_fit(np.array([6, 3, 2, 2]), 10)
    assert bins[0] == bins[2] == bins[3] != bins[1]


def plain_two_fit(lengths, limit):
    """Sizes of each bin, by trying every piece and every pair."""
    left, out = sorted(lengths, reverse=True), []

    def greedy(held, gap):
        while (fits := [x for x in left if x <= gap]):
            held.append(fits[0])
            left.remove(fits[0])
            gap -= fits[0]
        return gap

    while left:
        held = []
        gap = greedy(held, limit)
        if gap and len(held) > 1:
            room = gap + held[-1]
            pairs = [(a, b) for i, b in enumerate(left) for a in left[i + 1 :] if held[-1] < a + b <= room]
            if pairs:
                a, b = min(pairs, key=lambda p: (-sum(p), p[0]))
                left.append(held.pop())
                left.remove(a)
                left.remove(b)
                left.sort(reverse=True)
                held += [a, b]
                greedy(held, room - a - b)
        out.append(sorted(held))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_bins_are_those_of_the_plain_form(seed):
    rng = np.random.default_rng(seed)
    limit = int(rng.integers(5, 60))
    lengths = np.minimum(rng.geometric(rng.choice([0.03, 0.1, 0.3]), int(rng.integers(1, 70))), limit)
    bins, _ = packing.two_fit(lengths, limit)
    assert [sorted(lengths[bins == b].tolist()) for b in range(bins.max() + 1)] == plain_two_fit(lengths.tolist(), limit)


def test_ids_are_those_of_the_library(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["", None, "Ab, cd  é\n\tÉ don't 123 <|endoftext|> x<|startoftext|>y", " x　y z\x1cq\x85", "é ́a", "word " * 5000, "x" * 3000, "İstanbul ΑΣ σ", "🙂 a🙂b", "twice", "twice"]
    rows = [(i if i else None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "9 AS piece", "9 AS length", "'x' AS group_no")
    got = packing.pack(packing.pieces(docs)).collect()
    want = {}
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            cut = np.array(ids[start : start + 2048], "<u4").tobytes()
            want[i, piece] = (start, len(cut) // 4, zlib.crc32(cut))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(packing.pieces(docs.limit(0))).count() == 0


def test_merges_equal_the_library():
    rng = random.Random(6)
    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        encoder = packing.Encoder(f.read())
    library = Tokenizer.from_file(path)
    alphabet = [*"abcdehinorst" * 6, *map(chr, range(33, 127)), *map(chr, range(160, 256)), "ā", "日", "\t", "\x1c", "İ"]
    words = ["".join(rng.choices(alphabet, k=rng.randint(1, 30))) for _ in range(6000)] + ["aaaa" * 7, "they'll", "it's", "x" * 400, "ªº²½µßÿ"]
    got = encoder.encode([" ".join(words[i : i + 50]) for i in range(0, len(words), 50)])
    for i, ids in zip(range(0, len(words), 50), got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(" ".join(words[i : i + 50]), add_special_tokens=False).ids


def test_equal_rows_are_dealt_over_groups(spark):
    parts = spark.range(4000).selectExpr("cast(7 AS long) AS doc_id", "0 AS piece", "cast(0 AS long) AS start", "cast(100 AS long) AS length", "cast(5 AS long) AS ids_crc32").repartition(3)
    got = packing.pack(parts, 2048, 500).selectExpr("sequence_id >> 40 AS g", "sequence_id").collect()
    held = {}
    for r in got:
        held.setdefault(r.g, []).append(r.sequence_id)
    assert len(got) == 4000 and len(held) == 8 and max(map(len, held.values())) < 700
    assert len({r.sequence_id for r in got}) <= 200 + 8


@pytest.fixture(scope="module")
def vocabulary():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def same_as_library(encoder, vocabulary, texts):
    library = Tokenizer.from_str(vocabulary)
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_plain_words_cost_no_call_each(vocabulary):
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choices("abcdefghé", k=7)) for _ in range(50)) for _ in range(400)]
    encoder, profile = packing.Encoder(vocabulary), cProfile.Profile()
    profile.runcall(encoder.encode, texts)
    assert pstats.Stats(profile).total_calls < 50 * len(texts) / 4
    same_as_library(encoder, vocabulary, texts[:20])


@pytest.mark.parametrize("remembered", [30, 300_000])
def test_units_are_cut_as_the_library_does(vocabulary, monkeypatch, remembered):
    monkeypatch.setattr(packing, "REMEMBERED", remembered)
    rng = random.Random(4)
    encoder = packing.Encoder(vocabulary)
    same_as_library(encoder, vocabulary, ["", "it's 'st 'llama x''s ''re'd 5't't5 a' 'S", "'", "\n \n", "", "<|endoftext|> a<|b <| |", "½²ª1x"])
    for alphabet in (list("abdstmrevl''' 1,\nSTLé"), [*map(chr, range(300)), *" " * 40]):
        for _ in range(15):
            same_as_library(encoder, vocabulary, ["".join(rng.choices(alphabet, k=rng.randint(0, 150))) for _ in range(rng.randint(1, 30))])
    assert encoder.encode([]) == []


def test_remembered_units_are_bounded(vocabulary, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 1000)
    rng = random.Random(5)
    encoder = packing.Encoder(vocabulary)
    for _ in range(10):
        texts = [" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(500))]
        same_as_library(encoder, vocabulary, texts)
        assert len(encoder.units) == len(encoder.sizes) <= 1000
        assert len(encoder.ids) == encoder.sizes.sum()


def test_a_long_text_goes_in_stretches(vocabulary, monkeypatch):
    text = "Some words, wïth 日本 in them.\nIt's " * 40 + "x" * 200
    monkeypatch.setattr(packing, "STRETCH", 100)
    assert "".join(packing._stretches(text)) == text and max(map(len, packing._stretches(text))) < 400
    same_as_library(packing.Encoder(vocabulary), vocabulary, [text])


def test_vocabularies_of_other_units_are_refused(vocabulary):
    content = json.loads(vocabulary)
    content["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = "[^ ]+"
    with pytest.raises(ValueError):
        packing.Encoder(json.dumps(content))


def test_remembered_words_of_the_library_are_bounded(vocabulary, monkeypatch):
    monkeypatch.setattr(packing, "STRETCH", 3000)
    rng = random.Random(6)
    encoder = packing.Encoder(vocabulary)
    for _ in range(12):
        same_as_library(encoder, vocabulary, ["".join(rng.choices("日本語文字", k=900))])
        assert sum(map(len, encoder.others)) == encoder.held <= 3000 + 900
