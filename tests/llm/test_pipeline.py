import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from hazardspark.llm import quality
from tests.llm.test_jaccard import brute as components
from tests.llm.test_suffixes import brute as repeats


def corpus():
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(300)]
    passage = " ".join(rng.choices(words, k=70))
    docs = []
    for i in range(150):
        ws = rng.choices(words, k=rng.randint(20, 90))
        text = " ".join(w.upper() + "!!" for w in ws) if i % 4 == 0 else " ".join(ws)
        docs.append((i, text))
    docs += [(200 + i, docs[4 * i + 1][1] + " extra") for i in range(10)]
    docs += [(300 + i, " ".join(rng.choices(words, k=30)) + " " + passage) for i in range(8)]
    docs += [(400, None), (401, "")]
    labels = [(i, int(i % 4 > 0), 0) for i in range(150)]
    return docs, labels


def test_equals_brute_force(spark, tmp_path):
    docs, labels = corpus()
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    good = corpus_pipeline.keep_good(spark, table, str(tmp_path))
    assert good.columns == table.columns
    model = quality.learn(table, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    reader = quality.Reader(model)
    left = []
    for i, t in docs:
        z = quality._forward(reader.pooled(t or "")[None].astype(float), model.layers)[1][0]
        if z >= 0:
            left.append((i, t))
    assert sorted(r.doc_id for r in good.collect()) == sorted(i for i, _ in left)
    assert not {i for i, _ in left if i < 150 and i % 4 == 0}
    kept = {d for d, n, c in components(left) if n == 0 or d == c}
    left = [(i, t) for i, t in left if i in kept]
    assert 200 not in kept and 1 in kept
    removed = {r[0]: r for r in repeats(left)}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in left)
    lengths = {r.doc_id: r.length for r in got}
    for i, t in left:
        if removed[i][2] == 0:
            assert lengths[i] == len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
    assert sum(removed[i][2] > 400 for i in range(301, 308)) == 7 and max(lengths[i] for i in range(301, 308)) < lengths[300]
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(np.cumsum([0, *(n for _, n in sorted(v))])[:-1].tolist() == [o for o, _ in sorted(v)] for v in by.values())


def test_empty_and_repeated_rows(spark, tmp_path):
    docs, labels = corpus()
    rows = [(i, t, "en", "s", 0) for i, t in [*docs[:40], docs[1], docs[1], (None, docs[2][1]), (None, "a b c d e f g h i")]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("cls", __import__("pyspark").sql.functions.lit(1))
    one = corpus_pipeline.keep_one_of_alike(spark, table, str(tmp_path)).collect()
    ids = [r.doc_id for r in one]
    assert ids.count(1) == 1 and ids.count(2) + ids.count(None) == 2
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, table.limit(0), str(tmp_path)).count() == 0


def test_odd_rows_in_every_stage(spark, tmp_path):
    docs, labels = corpus()
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = docs[:60] + [docs[1], docs[1], (1, docs[1][1] + " extra"), (7, docs[1][1] + " extra"), (None, docs[2][1]), (None, None), (900, "long " * 30_000), (901, None), (902, "")]
    clash = ["block", "bucket", "_key", "_text", "_score", "_predicted", "row", "rest", "score", "predicted", "key", "id", "first_id", "cls", "piece", "length", "at"]
    made = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("'en' AS lang", "*", *(f"{i} AS `{c}`" for i, c in enumerate(clash)))
    kept = made
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.materialize(stage(spark, kept, str(tmp_path)), "stage")
        assert kept.schema.simpleString() == made.schema.simpleString()
        assert all([r[c] for c in clash] == list(range(len(clash))) for r in kept.collect())
    assert corpus_pipeline.pack(spark, kept, str(tmp_path)).count() >= kept.count()
    one = corpus_pipeline.keep_one_of_alike(spark, made, str(tmp_path)).collect()
    ids = [r.doc_id for r in one]
    assert ids.count(1) == 1 and 7 in ids and [r.text for r in one if r.doc_id == 7] == [docs[7][1]]
    assert sum(r.text is None or r.text == "" for r in one) == 3 and ids.count(None) == 1 and ids.count(2) == 1
