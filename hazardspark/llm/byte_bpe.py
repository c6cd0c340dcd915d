"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct pieces of a stretch of the corpus are laid out in one token sequence. An
inverted index leads from each mergeable token pair (named by the token it makes) to
the positions where it stands. Merges are replayed in rank order, each over all its
positions at once; only the pairs of the two touched neighbours are renewed. The work
is linear in the distinct pieces, and no row leaves its task: there is no shuffle, a
hot document or source only means more equal pieces, which are encoded once.

Defined results: null text counts as empty; an empty text has no ids; each row is
encoded by itself, so repeated rows and repeated or null ids give repeated results;
columns of the input that are not asked for stay as they are (``encode``, ``decode``) or
are ignored; a column that has the name of the result is replaced.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections import defaultdict
from itertools import accumulate, chain

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardspark.llm.common import kept, slices, table

#: Entries that a worker remembers between stretches, and characters in a stretch.
REMEMBERED, STRETCH = 700_000, 4_000_000


class Ranks(dict):
    """Ranks by bytes; beside them the bytes by rank, and what each mergeable pair of ranks makes."""

    def __init__(self, content: bytes):
        super().__init__((base64.b64decode(a), int(b)) for a, b in map(bytes.split, content.splitlines()) if a)
        self.names = {v: k for k, v in self.items()}
        self.width = max(self.names, default=0) + 2
        get = self.get
        self.pairs = {
            left * self.width + right: rank
            for name, rank in self.items() for at in range(1, len(name))
            if (left := get(name[:at])) is not None and (right := get(name[at:])) is not None
        }
        self.bytes = [get(bytes([b]), -1) for b in range(256)]


def replay(words: list[bytes], ranks: Ranks) -> list[tuple[int, ...]]:
    """The ids of each word, by merges in rank order over all words together."""
    width, made = ranks.width, ranks.pairs.get
    token = list(map(ranks.bytes.__getitem__, b"".join(words)))
    size = len(token)
    ends = list(accumulate(map(len, words)))
    word_of = [i for i, word in enumerate(words) for _ in word]
    right = list(range(1, size + 1))
    left = list(range(-1, size - 1))
    index: dict[int, list[int]] = defaultdict(list)
    last = dict.fromkeys(end - 1 for end in ends)
    for p, rank in enumerate(made(a * width + b) for a, b in zip(token, token[1:], strict=False)):
        if rank is not None and p not in last:
            index[rank].append(p)
    heap = list(index)
    heapq.heapify(heap)
    while heap:
        rank = heapq.heappop(heap)
        held = -1  # a word in which a merge of lower rank has come up
        for p in sorted(index.pop(rank, ())):
            q = right[p]
            word = word_of[p]
            if q >= size or word_of[q] != word or token[p] < 0 or made(token[p] * width + token[q]) != rank:
                continue
            if word == held:
                if rank not in index:
                    heapq.heappush(heap, rank)
                index[rank].append(p)
                continue
            token[p], token[q] = rank, -2
            after = right[p] = right[q]
            if after < size:
                left[after] = p
                if word_of[after] == word and (r := made(rank * width + token[after])) is not None:
                    if r not in index:
                        heapq.heappush(heap, r)
                    index[r].append(p)
                    held = word if r <= rank else held
            before = left[p]
            if before >= 0 and word_of[before] == word and (r := made(token[before] * width + rank)) is not None:
                if r not in index:
                    heapq.heappush(heap, r)
                index[r].append(before)
                held = word if r <= rank else held
    return [tuple(t for t in token[a:b] if t != -2) for a, b in zip([0, *ends], ends, strict=False)]


class ByteBPE:
    def __init__(self, content: bytes, pattern: str):
        self.ranks = Ranks(content)
        self.names = self.ranks.names
        self.find = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def encode(self, texts: list[str]) -> list[list[int]]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        pieces = [self.find(text) for text in texts]
        known, new, spelled = self.known, [], []
        for piece in set(chain.from_iterable(pieces)).difference(known):
            raw = piece.encode()
            if (whole := self.ranks.get(raw)) is not None:
                known[piece] = (whole,)
            else:
                new.append(piece)
                spelled.append(raw)
        known.update(zip(new, replay(spelled, self.ranks), strict=True))
        return [list(chain.from_iterable(map(known.__getitem__, p))) for p in pieces]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.names.__getitem__, ids))


def _codec(content, pattern: str) -> ByteBPE:
    """One codec for each worker process."""
    return kept(("byte_bpe", content.value, pattern), lambda: ByteBPE(content.value, pattern))


def _vocabulary(spark: SparkSession, path: str | None):
    """The rank file, broadcast: its size is fixed (under 1 MB) whatever the corpus."""
    with open(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _texts(column) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def encode(df: DataFrame, text: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN, ids: str = "ids") -> DataFrame:
    """``df`` with an array of token ids for each row's text, in place of a column of that name."""
    vocabulary, at = _vocabulary(df.sparkSession, path), df.columns.index(text)
    rest = [i for i, c in enumerate(df.columns) if c != ids]
    names = [*(df.columns[i] for i in rest), ids]
    schema = df.select(*names[:-1]).withColumn(ids, F.lit(None).cast("array<int>")).schema

    def run(batches):
        codec = _codec(vocabulary, pattern)
        for batch in batches:
            found = _texts(batch.column(at))
            for a, b in slices([len(x) for x in found], STRETCH):
                rows = batch.slice(a, b - a)
                column = pa.array(codec.encode(found[a:b]), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in rest), column], names=names)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", path: str | None = None, text: str = "decoded") -> DataFrame:
    """``df`` with the bytes that the ids of each row stand for (null ids: empty), in place of a column of that name."""
    vocabulary, at = _vocabulary(df.sparkSession, path), df.columns.index(ids)
    rest = [i for i, c in enumerate(df.columns) if c != text]
    names = [*(df.columns[i] for i in rest), text]
    schema = df.select(*names[:-1]).withColumn(text, F.lit(None).cast("binary")).schema

    def run(batches):
        codec = _codec(vocabulary, public_tokenizers.PATTERN)
        for batch in batches:
            column = pa.array([codec.decode(x or []) for x in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), column], names=names)

    return df.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Encode and decode each text in one pass; of both, the digests."""
    vocabulary = _vocabulary(docs.sparkSession, path)

    def run(batches):
        codec = _codec(vocabulary, pattern)
        spelled = {i: str(i) for i in codec.names}
        for batch in batches:
            found = _texts(batch.column(1))
            for a, b in slices([len(x) for x in found], STRETCH):
                counts, packed, restored = [], [], []
                for ids in codec.encode(found[a:b]):
                    counts.append(len(ids))
                    packed.append(hashlib.sha256(",".join(map(spelled.__getitem__, ids)).encode()).hexdigest())
                    restored.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(counts, pa.int64()), pa.array(packed), pa.array(restored)],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
