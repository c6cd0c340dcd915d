"""Language-model scores by stupid backoff, from counts of the whole corpus.

A word's score given the words before it is the share of its n-gram among the
occurrences of its context; where the n-gram is not known, ``ALPHA`` times the score
with one word less of context, down to the word's share of all words. A document does
not speak for itself: its own occurrences are taken off every count first.

The counts are tables of n-gram hashes partitioned by hash. Blocks of documents (see
``blocks``) count their distinct n-grams first, so a frequent word or pair is one entry
for each block; the tables sum the blocks' counts; and the sums are joined back to the
exploded n-grams of each block, where scores are added up for each document. Everything
that moves is proportional to the distinct n-grams of blocks.

Words are parted by white space, A-Z in lower case; n-grams are 64-bit hashes, and all
64 bits travel, as differences of sorted keys (``_sent``). Two n-grams of equal hash
would be counted as one: about one pair is expected among 6 billion. A context that is
then left without occurrences is passed over.

Defined results: null text, or one without words, has score 0 and mean null; the first
words of a document have shorter contexts; a word that no other document has scores
``ALPHA**ORDER`` over one more than the words of the others; rows are documents of their
own, so repeated rows, equal and null doc_ids count as others to each other; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardspark.llm import blocks
from hazardspark.llm.common import table
from hazardspark.llm.jaccard import REMEMBERED, _mix, _Words

ORDER, ALPHA, BLOCK = 3, 0.4, 6 << 20
#: Bytes of a difference between neighbouring keys that are sent as they are; those above are mostly 0.
RAW = 5
_A = np.uint64(0x9E3779B97F4A7C15)
OUT = "doc_id long, n_tokens long, score double, mean_score double"


def _small(counts: np.ndarray) -> bytes:
    """Counts in one byte each, those from 255 on in eight more at the end."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<u8").tobytes()


def _wide(packed: bytes, size: int) -> np.ndarray:
    out = np.frombuffer(packed, np.uint8, size).astype(np.int64)
    out[out == 255] = np.frombuffer(packed, "<u8", offset=size).astype(np.int64)
    return out


def _less(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _more(less: bytes) -> bytes:
    return pa.decompress(less[8:], decompressed_size=int.from_bytes(less[:8], "little"), codec="zstd", asbytes=True)


def _sent(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys, whole, and their counts."""
    apart = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    return apart[:RAW].tobytes() + _less(apart[RAW:].tobytes() + _small(counts))


def _received(sent: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    rest = _more(sent[RAW * size :])
    apart = np.empty((size, 8), np.uint8)
    apart[:, :RAW] = np.frombuffer(sent, np.uint8, RAW * size).reshape(RAW, size).T
    apart[:, RAW:] = np.frombuffer(rest, np.uint8, (8 - RAW) * size).reshape(8 - RAW, size).T
    return np.cumsum(apart.reshape(-1).view("<u8"), dtype=np.uint64), _wide(rest[(8 - RAW) * size :], size)


class Block:
    """A block's n-grams: for each order, of each word, the n-gram that ends there."""

    def __init__(self, packed: pa.Table):
        rows = blocks.unpack(packed)
        self.shown = rows.column("doc_id")
        known, hashes = _Words(), []
        for text in rows.column("text").to_pylist():
            if len(known) > REMEMBERED:
                known.clear()
            words = text.encode().lower().split()
            hashes.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
        self.sizes = np.array([len(h) for h in hashes])
        self.doc = np.repeat(np.arange(len(hashes)), self.sizes)
        word = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        gram = _mix(word + _A)
        self.grams = [gram]
        for order in range(2, ORDER + 1):
            # the n-gram that ends at i, from the one that ends before it; it lacks where the document has no n words before
            gram = np.concatenate([[np.uint64(0)], _mix(gram[:-1] * _A + word[1:] + np.uint64(order))]) if len(word) else word
            self.grams.append(gram)
        starts = np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.depth = np.arange(len(word)) - starts  # words before, in the document

    def valid(self, order: int) -> np.ndarray:
        return self.depth >= order - 1

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct n-grams of all orders, and their counts; key 0 counts all words."""
        every = np.concatenate([g[self.valid(k + 1)] for k, g in enumerate(self.grams)])
        keys, counts = np.unique(every, return_counts=True)
        return np.concatenate([[np.uint64(0)], keys]), np.concatenate([[len(self.doc)], counts])

    def scores(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum of log scores of each document, given the corpus' counts of ``tables``."""
        words = sums[0] - self.sizes[self.doc]
        at = [np.flatnonzero(self.valid(k + 1)) for k in range(ORDER)]
        every = np.concatenate([g[a] for g, a in zip(self.grams, at, strict=True)])
        order = np.argsort(every, kind="stable")  # equal n-grams stay in the order of documents
        ordered, doc = every[order], self.doc[np.concatenate(at)][order]
        del every
        key = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(ordered) else np.empty(0, bool)
        pair = np.concatenate([[True], key[1:] | (doc[1:] != doc[:-1])]) if len(ordered) else key
        own = np.diff(np.append(np.flatnonzero(pair), len(ordered)))
        rest = np.empty(len(ordered), np.int64)
        rest[order] = sums[1:][np.cumsum(key) - 1] - own[np.cumsum(pair) - 1]
        others, begin = [], 0
        for a in at:
            left = np.zeros(len(self.doc), np.int64)
            left[a] = rest[begin : begin + len(a)]
            begin += len(a)
            others.append(left)
        out = np.log(ALPHA) * ORDER - np.log(words + 1.0)
        done = np.zeros(len(self.doc), bool)
        for n in range(ORDER, 0, -1):
            has = ~done & self.valid(n) & (others[n - 1] > 0)
            base = words if n == 1 else np.concatenate([[0], others[n - 2][:-1]])
            has &= base > 0
            highest = np.minimum(self.depth + 1, ORDER)[has]
            out[has] = np.log(ALPHA) * (highest - n) + np.log(others[n - 1][has] / base[has])
            done |= has
        return np.bincount(self.doc, out, len(self.sizes)), self.sizes


def score(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, score (sum of natural logs), mean_score."""
    base = blocks.with_blocks(docs, BLOCK)
    count = blocks.buckets(docs)
    grouped = base.groupBy("block")

    def first(rows: pa.Table) -> pa.Table:
        keys, counts = Block(rows).tables()
        number, ends = rows.column("block")[0].as_py(), blocks._ends(keys, count)
        full = [(b, ends[b], ends[b + 1]) for b in range(count) if ends[b] < ends[b + 1]]
        sent = [_sent(keys[a:z], counts[a:z]) for _, a, z in full]
        return pa.table({"block": pa.array([number] * len(full), pa.int64()), "bucket": pa.array([b for b, *_ in full], pa.int32()), "size": pa.array([z - a for _, a, z in full], pa.int32()), "sent": pa.array(sent, pa.binary())})

    def summed(rows: pa.Table) -> pa.Table:
        sizes = rows.column("size").to_pylist()
        parts = [_received(x, n) for x, n in zip(rows.column("sent").to_pylist(), sizes, strict=True)]
        keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        order = np.argsort(keys)
        ordered = keys[order]
        starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        out = np.empty(len(keys), np.int64)
        out[order] = np.repeat(np.add.reduceat(counts[order], starts), np.diff(np.append(starts, len(keys))))
        ends = np.cumsum([0, *sizes])
        back = [_less(_small(out[a:b])) for a, b in zip(ends, ends[1:], strict=False)]
        return pa.table({"block": rows.column("block"), "bucket": rows.column("bucket"), "size": rows.column("size"), "sent": pa.array(back, pa.binary())})

    def second(rows: pa.Table, found: pa.Table) -> pa.Table:
        held = Block(rows)
        back = sorted(zip(*(found.column(c).to_pylist() for c in ("bucket", "size", "sent")), strict=True))
        total, sizes = held.scores(np.concatenate([_wide(_more(s), n) for _, n, s in back]))
        mean = pa.array(total / np.maximum(sizes, 1), mask=sizes == 0)
        return pa.table({"doc_id": held.shown, "n_tokens": pa.array(sizes, pa.int64()), "score": pa.array(total), "mean_score": mean})

    kind = "block long, bucket int, size int, sent binary"
    sums = grouped.applyInArrow(first, kind).groupBy("bucket").applyInArrow(summed, kind)
    return grouped.cogroup(sums.groupBy("block")).applyInArrow(second, OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores to six decimals: sums of doubles depend on their order beyond that."""
    rows = score(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_tokens", F.round("score", 6).alias("score"), F.round("mean_score", 6).alias("mean_score"))


# The n-grams as texts: o1, o2, o3 count what other documents have of the word, pair and
# triple that end at a place; the contexts of a pair and a triple end one place before.
ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
w AS (SELECT r, generate_subscripts(words, 1) AS i, unnest(words) AS c FROM d),
g AS (SELECT r, i, c, lag(c, 1) OVER here AS b, lag(c, 2) OVER here AS a FROM w WINDOW here AS (PARTITION BY r ORDER BY i)),
o AS (
  SELECT r, i,
         count(*) OVER () - count(*) OVER (PARTITION BY r) AS o0,
         count(*) OVER (PARTITION BY c) - count(*) OVER (PARTITION BY r, c) AS o1,
         CASE WHEN i >= 2 THEN count(*) OVER (PARTITION BY b, c) - count(*) OVER (PARTITION BY r, b, c) ELSE 0 END AS o2,
         CASE WHEN i >= 3 THEN count(*) OVER (PARTITION BY a, b, c) - count(*) OVER (PARTITION BY r, a, b, c) ELSE 0 END AS o3
  FROM g),
l AS (SELECT *, lag(o1) OVER here AS p1, lag(o2) OVER here AS p2 FROM o WINDOW here AS (PARTITION BY r ORDER BY i)),
s AS (
  SELECT r, CASE WHEN o3 > 0 THEN ln(o3 / p2)
                 WHEN o2 > 0 THEN (least(i, 3) - 2) * ln(0.4) + ln(o2 / p1)
                 WHEN o1 > 0 THEN (least(i, 3) - 1) * ln(0.4) + ln(o1 / o0)
                 ELSE 3 * ln(0.4) - ln(o0 + 1) END AS x
  FROM l),
t AS (SELECT r, sum(x) AS x FROM s GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_tokens, round(coalesce(x, 0), 6) AS score,
       CASE WHEN len(words) > 0 THEN round(x / len(words), 6) END AS mean_score
FROM d LEFT JOIN t USING (r)
"""
