import base64
import hashlib
import random

import public_tokenizers
import tiktoken

from hazardspark.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(5)
    odd = ["", " ", "a", "\n\n  x", "don't we'll  go", "é" * 300, "a" * 5000, "ab" * 3000, " " * 900, " x\x1cy\x85z", "日本語テキスト", "🙂🙂 ok", "1234567 89", "<|endoftext|>"]
    alphabet = "ab eé\n\t'st,.!日0 7Zü​\x1f"
    return odd + ["".join(rng.choices(alphabet, k=rng.randint(1, 400))) for _ in range(300)]


def test_replay_equals_the_library():
    with open(PATH, "rb") as f:
        codec = byte_bpe.ByteBPE(f.read(), public_tokenizers.PATTERN)
    library = reference()
    for text, ids in zip(texts(), codec.encode(texts()), strict=True):
        assert ids == library.encode_ordinary(text), text[:60]
        assert codec.decode(ids) == text.encode()


def test_white_space_is_that_of_the_library():
    with open(PATH, "rb") as f:
        codec = byte_bpe.ByteBPE(f.read(), public_tokenizers.PATTERN)
    library = reference()
    every = ["a" + chr(c) + chr(c) + "b1" for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    wrong = [t for t, ids in zip(every, codec.encode(every), strict=True) if ids != library.encode_ordinary(t)]
    assert not wrong, wrong[:20]


def test_round_trip_rows(spark):
    rows = [(i, t) for i, t in enumerate(texts()[:60])] + [(7, "twice"), (7, "twice"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS n_tokens")
    library = reference()
    got = sorted((r.doc_id is None, r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.round_trip(docs).collect())
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i is None, i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert byte_bpe.round_trip(docs.limit(0)).count() == 0


def test_encode_then_decode(spark):
    docs = spark.createDataFrame([(1, "ab cd"), (2, None)], "doc_id long, text string").selectExpr("9 AS ids", "*", "8 AS decoded")
    rows = {r.doc_id: bytes(r.decoded) for r in byte_bpe.decode(byte_bpe.encode(docs)).collect()}
    assert rows == {1: b"ab cd", 2: b""}


def test_other_patterns_are_matched_whole():
    with open(PATH, "rb") as f:
        codec = byte_bpe.ByteBPE(f.read(), r"[ab ]+|[^ab ]+")
    text = "a b  ab xyz ab\n"
    library = tiktoken.Encoding("own", pat_str=r"[ab ]+|[^ab ]+", mergeable_ranks=dict(codec.ranks), special_tokens={})
    assert codec.encode([text]) == [library.encode_ordinary(text)]
