"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's subwords are the runs of one to four signs within its words, in lower case, with
the gap before and after a word as a sign of its own; all else than letters is a gap. Each
subword is hashed to one of ``BUCKETS`` embeddings; a text is the average of its subwords'
embeddings, and a linear softmax over it gives the languages. Embeddings and softmax are
trained together by stochastic gradient descent. Every fifth labelled text is kept out of
the fit: on these the temperature of the probabilities is set, and the least confidence
from which on predictions are right as often as ``PRECISION`` asks. What lies below is
marked as rejected.

The model is fitted on at most ``SAMPLE`` labelled documents (whole texts, dealt evenly
over at most ``LANGUAGES`` languages, the most frequent ones), chosen by the hash of
doc_id. Executors count their subwords; the driver gets at most ``BUCKETS`` numbers for
each of them, never texts. The model is BUCKETS x languages numbers, so it is broadcast.
Scoring needs no shuffle and reads every text whole, long ones in pieces.

Defined results: null texts and texts without a letter are ``und`` with score 0, and
rejected; rows are predicted one by one, so repeated rows get equal results; a null doc_id
is not held out and never a label, nor is a null lang; of a doc_id's labelled rows of one
language the least text counts; without any labelled text every row is ``und``, and with
one language every text with a letter is of that language; equal probabilities go to the
language that comes first bytewise; other columns are kept, columns named like the results
give way; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardspark.llm.common import kept, release, slices, table

SAMPLE, LANGUAGES, BUCKETS, LONGEST, WIDTH = 4000, 200, 1 << 13, 4, 16
EPOCHS, RATE, BATCH, DECAY, SEED = 20, 4.0, 64, 1e-6, 11
PRECISION, UNKNOWN = 0.99, "und"
PIECE, TOGETHER = 1 << 18, 64  # signs and texts at once
SHARES = 1 << 30


def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


class Reader:
    """Texts as counts of subwords by bucket."""

    def __init__(self):
        self.letters = letters()

    def _count(self, parts: list[str], limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Of each part, how often each bucket comes up among the subwords that begin before ``limit``; and how many letters."""
        gap = "\n" * LONGEST
        codes = np.frombuffer((gap.join(parts) + gap).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(len(parts)), [len(p) + LONGEST for p in parts])
        letter = self.letters[codes]
        signs = np.where(letter, codes, np.uint32(0))
        mixed, some, inner, found = signs, letter, None, []
        for n in range(1, LONGEST + 1):
            size = len(codes) - n + 1
            if n > 1:
                mixed = mixed[:size] * np.uint32(0x01000193) + signs[n - 1 :]
                some = some[:size] | letter[n - 1 :]
            if n > 2:  # only the ends may be gaps
                middle = letter[n - 2 : n - 2 + size]
                inner = middle if inner is None else inner[:size] & middle
            at = np.flatnonzero(some if inner is None else inner)
            at = at if limit is None else at[: np.searchsorted(at, limit)]
            bucket = (mixed[at] + np.uint32(n)) * np.uint32(0x9E3779B1) >> np.uint32(33 - BUCKETS.bit_length())
            found.append(owner[at] * BUCKETS + bucket)
        counts = np.bincount(np.concatenate(found), minlength=len(parts) * BUCKETS).reshape(len(parts), BUCKETS)
        return counts, np.bincount(found[0] // BUCKETS, minlength=len(parts))

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Counts by bucket, and letters, of each text; a long text goes in pieces that reach over their ends."""
        whole = ["\n" + t.lower() for t in texts]
        if len(whole) > 1 or len(whole[0]) <= PIECE:
            return self._count(whole)
        pieces = (self._count([whole[0][a : a + PIECE + LONGEST - 1]], PIECE) for a in range(0, len(whole[0]), PIECE))
        return tuple(sum(x) for x in zip(*pieces, strict=True))

    def batches(self, texts: list[str]):
        """(first, last, counts, letters) of stretches of texts."""
        for a, b in slices(list(map(len, texts)), PIECE):
            for c in range(a, b, TOGETHER):
                d = min(c + TOGETHER, b)
                yield c, d, *self.counts(texts[c:d])


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # buckets x languages: embeddings times softmax
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def logits(self, counts: np.ndarray) -> np.ndarray:
        return (counts.astype(np.float32) @ self.weights) / np.maximum(counts.sum(1, keepdims=True), 1) + self.bias

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        return softmax(self.logits(counts).astype(np.float64) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, languages: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (embeddings times softmax) and bias, by stochastic gradient descent over (buckets, shares) of each text."""
    rng = np.random.default_rng(SEED)
    embedding = rng.normal(0, 1, (BUCKETS, WIDTH)).astype(np.float32)
    out, bias = np.zeros((WIDTH, languages), np.float32), np.zeros(languages, np.float32)
    for epoch in range(EPOCHS):
        order, rate = rng.permutation(len(rows)), np.float32(RATE * (1 - epoch / EPOCHS))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            x = np.zeros((len(chosen), BUCKETS), np.float32)
            for i, row in enumerate(chosen):
                x[i, rows[row][0]] = rows[row][1]
            mean = x @ embedding
            error = softmax(mean @ out + bias)
            error[np.arange(len(chosen)), y[chosen]] -= 1
            error /= np.float32(len(chosen))
            back = error @ out.T
            out -= rate * (mean.T @ error + np.float32(DECAY) * out)
            bias -= rate * error.sum(0)
            embedding -= rate * 8 * (x.T @ back)
    return embedding @ out, bias


def calibrate(logits: np.ndarray, y: np.ndarray, precision: float = PRECISION) -> tuple[float, float]:
    """The temperature of least log loss, and the least confidence from which on ``precision`` is held (1 where none is)."""
    z, own = logits.astype(np.float64), np.arange(len(y))
    grid = np.exp(np.linspace(-3, 3, 121))
    temperature = float(min(grid, key=lambda t: -np.log(np.maximum(softmax(z / t)[own, y], 1e-12)).mean()))
    p = softmax(z / temperature)
    sure, right = p.max(1), p.argmax(1) == y
    order = np.argsort(-sure, kind="stable")
    held = np.flatnonzero(np.cumsum(right[order]) >= precision * np.arange(1, len(order) + 1))
    return temperature, float(sure[order[held[-1]]]) if len(held) else 1.0


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[str]) -> Model:
    """A model from (buckets, counts) of labelled texts; every fifth text calibrates it."""
    languages = sorted(set(labels), key=str.encode)
    model = Model(languages, np.zeros((BUCKETS, len(languages)), np.float32), np.zeros(len(languages), np.float32))
    if len(languages) < 2:
        return model
    y = np.array([languages.index(v) for v in labels])
    shares = [(b, (c / max(c.sum(), 1)).astype(np.float32)) for b, c in rows]
    apart = np.arange(len(y)) % 5 == 4
    if len(set(y[~apart])) < len(languages):
        apart[:] = False
    fitted, held = np.flatnonzero(~apart), np.flatnonzero(apart)
    model.weights, model.bias = train([shares[i] for i in fitted], y[fitted], len(languages))
    if len(held):
        logits = np.stack([shares[i][1] @ model.weights[shares[i][0]] for i in held]) + model.bias
        model.temperature, model.least = calibrate(logits, y[held])
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sampled(docs: DataFrame, sample: int = SAMPLE, languages: int = LANGUAGES) -> DataFrame:
    """At most ``sample`` (doc_id, lang), about the same number of each of the most frequent languages."""
    known = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out()).select("doc_id", "lang").distinct()
    sizes = known.groupBy("lang").agg(F.count("*").alias("_n"))
    most = sizes.orderBy(F.desc("_n"), "lang").limit(languages)  # at most ``languages`` rows: broadcast
    share = F.pmod(F.xxhash64("doc_id"), F.lit(SHARES)) * F.col("_n") / SHARES  # about the place among its language's
    placed = known.join(F.broadcast(most), "lang").crossJoin(F.broadcast(most.agg(F.count("*").alias("_all")))).withColumn("_at", share)  # one row
    return placed.where(F.col("_at") < F.lit(float(sample)) / F.col("_all")).orderBy("_at", "doc_id", "lang").limit(sample).select("doc_id", "lang")


def learn(docs: DataFrame, sample: int = SAMPLE, languages: int = LANGUAGES) -> Model:
    """Fit on labelled documents that are not held out: executors count, the driver gets counts."""
    docs = docs.select("doc_id", "lang", "text")
    chosen = docs.join(F.broadcast(sampled(docs, sample, languages)), ["doc_id", "lang"])  # at most ``sample`` short rows
    each = chosen.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).where("text IS NOT NULL")

    def run(batches):
        kept(None, None)
        reader = Reader()
        for batch in batches:
            out = []
            for text in batch.column(2).to_pylist():
                (counts,), (alone,) = reader.counts([text])
                at = np.flatnonzero(counts)
                out.append((at.astype(np.uint16).tobytes(), counts[at].astype(np.float32).tobytes()) if alone else (b"", b""))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.binary()) for c in zip(*out, strict=True))] if out else [pa.array([], t) for t in (pa.int64(), pa.string(), pa.binary(), pa.binary())], names=["doc_id", "lang", "buckets", "counts"])
        del reader
        release(None)

    rows = each.select(F.col("doc_id").cast("long"), "lang", "text").mapInArrow(run, "doc_id long, lang string, buckets binary, counts binary").where("octet_length(buckets) > 0").collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.lang))
    return fit([(np.frombuffer(r.buckets, np.uint16), np.frombuffer(r.counts, np.float32)) for r in rows], [r.lang for r in rows])


RESULTS = {"lang_pred": "string", "score": "double", "rejected": "boolean"}


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and rejected, which replace columns of these names."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)
    rest = [i for i, c in enumerate(docs.columns) if c not in RESULTS]
    names = [docs.columns[i] for i in rest]
    schema = docs.select(*names, *(F.lit(None).cast(t).alias(c) for c, t in RESULTS.items())).schema

    def run(batches):
        kept(None, None)
        m, reader = sent.value, Reader()
        for batch in batches:
            texts = [x or "" for x in batch.column(at).to_pylist()]
            best, sure = np.full(len(texts), -1), np.zeros(len(texts))
            for a, b, counts, alone in reader.batches(texts) if m.languages else ():
                p = m.probabilities(counts)
                best[a:b] = np.where(alone > 0, p.argmax(1), -1)
                sure[a:b] = np.where(alone > 0, p.max(1), 0.0)
            said = [m.languages[i] if i >= 0 else UNKNOWN for i in best.tolist()]
            rejected = (best < 0) | (sure < m.least)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), pa.array(said, pa.string()), pa.array(sure), pa.array(rejected)], names=[*names, *RESULTS])
        del reader
        release(None)

    return docs.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs.select(F.col("doc_id").cast("long"), "text"), learn(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
