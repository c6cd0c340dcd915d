"""Quality classifier: random-indexing word vectors, pooled, under a two-layer network.

A document's words are read twice: as content (the word without case and outer marks)
and as form (its case and the marks after it, and whether its pair with the word before
it has come up in the document already). Each token has a sparse random index vector,
and a token's vector is its own index vector plus the normed sum of those that stood
near it. A document is the mean of its tokens' vectors; a network of two layers gives
the probability, whose temperature is set on labelled rows kept out of the fit.

The model is fitted on at most ``SAMPLE`` labelled documents (whole texts), chosen by
the hash of doc_id; its size is bounded (``VOCABULARY`` x ``WIDTH``), so it is broadcast.
Scoring needs no shuffle and reads every text whole.

Defined results: null text is scored like an empty one; rows are scored one by one, so
repeated rows get equal scores; a null doc_id is not held out and never a label; a
document labelled more than once counts by its largest label; without labels of both
kinds every score is the share of label 1 (0.5 without labels); other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardspark.llm.common import kept, release, table

SAMPLE, VOCABULARY, FORMS, WIDTH, NONZERO, NEAR = 6000, 30_000, 4000, 64, 6, 2
HIDDEN, EPOCHS, RATE, DECAY, BATCH, SEED = 32, 60, 0.01, 1e-4, 128, 7
REMEMBERED = 200_000
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())


def content(word: str) -> str:
    return word.strip(MARKS).lower()


def form(word: str) -> str:
    body = word.strip(MARKS)
    kind = "none" if not body else "digit" if not body.isalpha() and any(map(str.isdigit, body)) else "lower" if body.islower() else "upper" if body.isupper() and len(body) > 1 else "title" if body[:1].isupper() and (len(body) == 1 or body[1:].islower()) else "mixed"
    size = "long" if len(body) > 24 else ""
    tail = word[len(word.rstrip(MARKS)) :]
    return f"{kind}{size} {tail[:3]}"


def index_vectors(names: list[str]) -> np.ndarray:
    """A sparse vector of +1 and -1 for each name, from the name alone."""
    out = np.zeros((len(names), WIDTH), np.float32)
    for row, name in enumerate(names):
        draw = np.random.default_rng(zlib.crc32(name.encode()))
        out[row, draw.choice(WIDTH, NONZERO, replace=False)] = draw.choice((-1.0, 1.0), NONZERO)
    return out


@dataclass
class Model:
    contents: dict[str, int]
    forms: dict[str, int]
    content_vectors: np.ndarray
    form_vectors: np.ndarray
    state_vectors: np.ndarray  # of fresh and repeated pairs, and of lengths
    layers: tuple | None
    prior: float
    temperature: float = 1.0


class _Ids(dict):
    """Content and form of each word met, as one number."""

    def __init__(self, model: Model):
        super().__init__()
        self.contents, self.forms = model.contents, model.forms

    def __missing__(self, word: str) -> int:
        found = self[word] = self.contents.get(content(word), 0) << 16 | self.forms.get(form(word), 0)
        return found


class Reader:
    """Documents as pooled vectors."""

    def __init__(self, model: Model):
        self.model, self.known = model, _Ids(model)

    def ids(self, words: list[str]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def pooled(self, text: str) -> np.ndarray:
        m, words = self.model, text.split()
        n = len(words)
        out = np.zeros(3 * WIDTH, np.float32)
        if n:
            ids = self.ids(words)
            contents = ids >> 16
            out[:WIDTH] = m.content_vectors[contents[contents > 0]].sum(0) / n
            out[WIDTH : 2 * WIDTH] = np.bincount(ids & 0xFFFF, minlength=len(m.form_vectors)).astype(np.float32) @ m.form_vectors / n
        if n > 1:
            seen = np.fromiter(map(hash, words), np.int64, n)
            fresh = len(np.unique(seen[:-1] * 1_000_003 + seen[1:])) / (n - 1)
            out[2 * WIDTH :] = fresh * m.state_vectors[0] + (1 - fresh) * m.state_vectors[1]
        out[2 * WIDTH :] += m.state_vectors[2 + min(n.bit_length(), 29)]
        return out


def _context(rows: list[np.ndarray], index: np.ndarray) -> np.ndarray:
    """Index vectors plus the normed sum of those that stood near."""
    total = np.zeros_like(index)
    for ids in rows:
        for gap in range(1, NEAR + 1):
            for a, b in ((ids[gap:], ids[:-gap]), (ids[:-gap], ids[gap:])):
                for at in range(0, len(a), 100_000):
                    x, y = a[at : at + 100_000], b[at : at + 100_000]
                    order = np.argsort(x, kind="stable")
                    x, starts = np.unique(x[order], return_index=True)
                    if len(x):
                        total[x] += np.add.reduceat(index[y[order]], starts)
    size = np.linalg.norm(total, axis=1, keepdims=True)
    own = index / np.sqrt(NONZERO)
    vectors = own + np.divide(total, size, out=np.zeros_like(total), where=size > 0)
    vectors[0] = 0  # words outside the vocabulary
    return vectors


def _forward(x, layers):
    centre, spread, w1, b1, w2, b2 = layers
    hidden = np.tanh((x - centre) / spread @ w1 + b1)
    return hidden, hidden @ w2 + b2


def _train(x: np.ndarray, y: np.ndarray) -> tuple:
    rng = np.random.default_rng(SEED)
    centre, spread = x.mean(0), x.std(0) + 1e-3
    z = (x - centre) / spread
    w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(z))
        rate = RATE * (1 - epoch / EPOCHS)
        for at in range(0, len(z), BATCH):
            rows = order[at : at + BATCH]
            a, t = z[rows], y[rows]
            h = np.tanh(a @ w[0] + w[1])
            p = 1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -40, 40)))
            d = (p - t) / len(rows)
            dh = np.outer(d, w[2]) * (1 - h * h)
            grads = [a.T @ dh + DECAY * w[0], dh.sum(0), h.T @ d + DECAY * w[2], d.sum(keepdims=True)]
            step += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] = w[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return (centre, spread, *w)


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The one of a fine grid with the least log loss."""
    grid = np.exp(np.linspace(-1.5, 2.5, 161))
    z = logits[None, :] / grid[:, None]
    loss = (np.logaddexp(0, z) - y * z).mean(1)
    return float(grid[np.argmin(loss)])


def fit(texts: list[str], labels: list[int]) -> Model:
    """A model from labelled texts; every fifth text sets the temperature."""
    words = Counter(chain.from_iterable(map(str.split, texts)))
    contents: Counter = Counter()
    forms: Counter = Counter()
    for word, n in words.items():
        contents[content(word)] += n
        forms[form(word)] += n
    del words
    ranked = lambda c, n: [w for w, k in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:n] if k > 1]
    content_names, form_names = ["", *(w for w in ranked(contents, VOCABULARY) if w)], ["", *ranked(forms, FORMS)]
    model = Model(
        {w: i for i, w in enumerate(content_names) if i}, {w: i for i, w in enumerate(form_names) if i},
        index_vectors(content_names), index_vectors(form_names), index_vectors([f"state {i}" for i in range(32)]) / np.float32(np.sqrt(NONZERO)), None, float(np.mean(labels)) if labels else 0.5,
    )
    if len(set(labels)) < 2:
        return model
    reader = Reader(model)
    ids = [reader.ids(t.split()).astype(np.int32) for t in texts]
    model.content_vectors = _context([i >> 16 for i in ids], model.content_vectors)
    model.form_vectors = _context([i & 0xFFFF for i in ids], model.form_vectors)
    x, y = np.stack([reader.pooled(t) for t in texts]).astype(np.float64), np.array(labels, float)
    kept = np.arange(len(y)) % 5 == 4
    if len(set(y[~kept])) < 2 or not kept.any():
        kept[:] = False
    model.layers = _train(x[~kept], y[~kept])
    if kept.any():
        model.temperature = _temperature(_forward(x[kept], model.layers)[1], y[kept])
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on the labelled documents that are not held out; of a doc_id's texts, on the least."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # at most ``sample`` short rows: broadcast
    each = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    rows = each.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "label").collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.text))
    return fit([r.text for r in rows], [int(r.label) for r in rows])


def score(docs: DataFrame, model: Model, text: str = "text", into: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with the score and the label predicted, in two columns that replace any of these names."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)
    rest = [i for i, c in enumerate(docs.columns) if c not in into]
    names = [docs.columns[i] for i in rest]
    schema = docs.select(*names).withColumn(into[0], F.lit(0.0)).withColumn(into[1], F.lit(0)).schema

    def run(batches):
        kept(None, None)
        m = sent.value
        reader = Reader(m)
        for batch in batches:
            texts = [x or "" for x in batch.column(at).to_pylist()]
            if m.layers is None or not texts:
                p = np.full(len(texts), m.prior)
            else:
                z = _forward(np.stack([reader.pooled(t) for t in texts]).astype(np.float64), m.layers)[1] / m.temperature
                p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*names, *into])
        del reader
        release(None)

    return docs.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"))
    scored = score(docs.select(F.col("doc_id").cast("long"), "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
