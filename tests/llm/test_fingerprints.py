import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F

from hazardspark.llm import fingerprints as fp


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def run_hash(words):
    seed = 42
    for w in words:
        seed = xxhash.xxh64_intdigest(w.encode(), seed=seed)
    return signed(seed)


def winnow(text, run=fp.RUN, span=fp.SPAN):
    """(hash, place) of the kept runs, by the definition."""
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text or "") if w]
    if not words:
        return []
    grams = [run_hash(words[i : i + run]) >> 24 for i in range(len(words) - run + 1)] or [run_hash(words) >> 24]
    kept = []
    for a in range(max(1, len(grams) - span + 1)):
        window = list(enumerate(grams))[a : a + span]
        best = min(window, key=lambda x: (x[1], -x[0]))
        if (best[1], best[0]) not in kept:
            kept.append((best[1], best[0]))
    return kept


def like(a, b):
    a, b = {x for x, _ in winnow(a)}, {x for x, _ in winnow(b)}
    return len(a & b) / len(a | b) if a | b else 1.0


def texts():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdeé日", k=rng.randint(1, 4))) for _ in range(40)]
    return ["", None, " ", "one", "a b c d e", "x " * 60, "same same\nsame"] + [" ".join(rng.choices(words, k=rng.randint(1, 90))) for _ in range(60)]


def test_equals_the_definition(spark, monkeypatch):
    monkeypatch.setattr(fp, "ROWS", 7)
    rows = [(i * 3 - 20, t) for i, t in enumerate(texts())]
    rows += [(4, rows[8][1]), (4, rows[8][1]), (10**6, "far off"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS kept", "2 AS range_no", "3 AS edited")
    got = [tuple(r)[:7] for r in fp.compare(docs).collect()]
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    want = []
    pack = lambda t: hashlib.md5(",".join(str((h << 24) | (fp.PLACES - 1 - p)) for h, p in winnow(t)).encode()).hexdigest()
    for at, (i, t) in enumerate(order):
        after = order[(at + 1) % len(order)][1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), pack(t), pack(edited), like(t, edited), like(t, after)))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_marks_and_the_guarantee(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(500)]
    passage = rng.sample(words, fp.RUN + fp.SPAN - 1)
    a, b = rng.sample(words, 30) + passage + rng.sample(words, 40), rng.sample(words, 11) + passage + rng.sample(words, 9)
    rows = spark.createDataFrame([(" ".join(a),), (" ".join(b),)], "text string").select(fp.marks(fp.winnow(F.col("text"))).alias("m")).collect()
    x, y = ({(m.hash, m.position - at) for m in r.m} for r, at in zip(rows, (30, 11), strict=True))
    assert x & y
    assert [(m.hash, m.position) for m in rows[0].m] == winnow(" ".join(a))


def test_few_rows(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert fp.compare(docs).first().near_next == 1.0
    assert fp.compare(docs.limit(0)).count() == 0


def test_ranges_are_even_whatever_the_ids(spark, monkeypatch):
    monkeypatch.setattr(fp, "ROWS", 100)
    docs = spark.range(2000).selectExpr("id AS doc_id", "concat('word ', id) AS text").union(spark.range(1).selectExpr("cast(4000000000000 AS long)", "'far'"))
    ranges = {}
    monkeypatch.setattr(fp, "winnow", lambda text: F.array(F.col("range_no")))
    for r in fp.with_next(docs, 100).select("kept").collect():
        ranges[r.kept[0]] = ranges.get(r.kept[0], 0) + 1
    assert len(ranges) >= 15 and max(ranges.values()) < 200


def test_heavy_and_null_ids_are_split(spark, monkeypatch):
    monkeypatch.setattr(fp, "ROWS", 20)
    monkeypatch.setattr(fp, "TURN", 16)
    rng = random.Random(12)
    some = lambda: " ".join(f"w{rng.randrange(90)}" for _ in range(rng.randint(0, 40)))
    rows = [(i, some()) for i in range(300)]
    rows += [(77, some()) for _ in range(200)] + [(77, "one text for many rows, of more than five words")] * 150
    rows += [(None, some()) for _ in range(100)] + [(None, None)] * 60 + [((1 << 63) - 1, some()) for _ in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS copies", "2 AS heavy_id", "3 AS parts")
    sign = lambda t: signed(xxhash.xxh64_intdigest(t.encode(), seed=42))
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, sign(r[1]), r[1]), reverse=True)
    want = []
    for at, (i, t) in enumerate(order):
        after = order[(at + 1) % len(order)][1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), like(t, edited), like(t, after)))
    got = [(r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in fp.compare(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    dealt, split = fp._dealt(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), 20)
    assert split
    assert max(r["count"] for r in dealt.groupBy("range_no").count().collect()) <= 45  # two ranges and a bit, where one id has 350 rows


def test_a_very_long_text(spark):
    rng = random.Random(2)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(60_000))
    rows = [(1, long), (2, long + " end"), (3, "short one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in fp.compare(docs).collect()}
    assert got[2].near_next > 0.99 and got[1].near_next < 0.01
    assert got[1].n_chars == len(long)
    assert got[2].near_edited > 0.3
