"""Suffix-array dedup of repeated passages, over bytes.

Every byte goes that is covered by a string of ``LENGTH`` bytes which also starts in a
document of smaller doc_id. Suffixes are sampled, range-partitioned, sorted and compared:

1. Texts that stand whole in a block of smaller doc_ids go at once (by 128-bit hashes).
   Of each string of ``LENGTH`` bytes in the others one suffix is drawn by its content
   alone (the least hash of its ``RUN`` leading bytes, the rightmost of equals), so equal
   strings draw suffixes at equal places. Suffixes whose lead no other text's suffixes
   have are out; hashes decide only that.
2. The suffixes in play travel as bytes: the ``LENGTH`` bytes from the suffix on, the
   bytes before it as far as strings that drew it reach, and how far that is. Splitters
   sampled from the texts deal them into buckets, ranges of their leading bytes, so no
   equal leads lie on two sides of a border. A bucket sorts its suffixes by multikey
   quicksort over words of bytes (ties of one word alone are sorted by the next).
   Suffixes equal in all bytes have all their strings in common; of different ones
   with equal leads the strings themselves are sorted. The least doc_id of each string
   decides; what goes back is one bit for each string. A block sends equal suffixes
   once, under its least doc_id.

A lead that ``HOT`` blocks and more have (a very common line) would fill a bucket: its
strings are sent one by one, dealt by a hash of all their bytes, and compared in the
same way; a lead thus never brings more than ``HOT`` blocks into one bucket.

Documents lie in blocks (ranges of doc_id from sampled splitters), and long texts are
worked on in stretches, so no task holds more than a block or a bucket.

Defined results: null text is empty; texts shorter than ``LENGTH`` keep all; rows of
equal doc_id do not take from each other; a null doc_id counts as larger than any other;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardspark.llm import blocks
from hazardspark.llm.common import partitions, release, table

LENGTH, RUN, STRETCH, WIDTH = 50, 24, 1 << 19, 6
#: Bytes of text in a block, blocks that make a lead hot, suffixes drawn for each bucket to find splitters, windows sorted at once.
BLOCK, HOT, DRAWN, AT_ONCE = 4 << 20, 32, 64, 1 << 17
#: Strings that one suffix may stand for, bytes before it in the farthest, words of a suffix as sent.
SPAN = LENGTH - RUN + 1
BACK, WORDS = SPAN - 1, -(-(LENGTH + SPAN + 1) // 8)
#: In place of the strings' range: a string that travels by itself.
ALONE = 255
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_PLACES = np.uint64((1 << 26) - 1)
_SENT = np.uint64((1 << 8 * WIDTH) - 1)
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a * _B
    out += b
    out ^= out >> np.uint64(29)
    out *= _C
    out ^= out >> np.uint64(32)
    return out


def _hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every run of ``size`` bytes, by joining halves."""
    powers = {1: (raw.astype(np.uint64) + np.uint64(1)) * _A}
    while 2 * max(powers) <= size:
        n = max(powers)
        powers[2 * n] = _joined(powers[n][:-n], powers[n][n:])
    got, have = None, 0
    for n in sorted(powers, reverse=True):
        if size - have >= n:
            part = powers[n][have : len(raw) - size + have + 1]
            got = part if got is None else _joined(got, part)
            have += n
    return got


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """The least of every ``span`` values in a row."""
    n = 1
    while 2 * n <= span:
        values = np.minimum(values[:-n], values[n:])
        n *= 2
    rest = span - n
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def multikey(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by their words, and where a row in that order differs from the one before it.

    Multikey quicksort by words in place of letters: only rows that tie in all words so
    far, and not in the next, are sorted by the next. Equal rows keep their order.
    """
    order = np.argsort(words[:, 0], kind="stable")
    new = _first(words[order, 0])
    for at in range(1, words.shape[1]):
        group = np.cumsum(new) - 1
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(tied):
            break
        word, of = words[order[tied], at], group[tied]
        differ = np.flatnonzero((word[1:] != word[:-1]) & (of[1:] == of[:-1]))
        mixed = np.zeros(len(order) and group[-1] + 1, bool)
        mixed[of[differ]] = True
        some = mixed[of]
        tied, word, of = tied[some], word[some], of[some]
        sub = np.lexsort((word, of))
        order[tied] = order[tied][sub]
        word = word[sub]
        new[tied[1:]] |= word[1:] != word[:-1]
    return order, new


def _first(values: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before it."""
    return np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.empty(0, bool)


def _words(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as words that compare like the bytes do."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    return wide.view(">u8").astype(np.uint64)


def covered(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each suffix as sent, the strings (one bit for each place) that a smaller id among ``ids`` has."""
    out = np.zeros(len(words), np.uint32)
    if not len(words):
        return out
    order, new = multikey(words)
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(order)))
    least = np.minimum.reduceat(ids[order], starts)
    out[order] = np.where(ids[order] > np.repeat(least, sizes), np.uint32((1 << SPAN) - 1), np.uint32(0))
    # different suffixes of equal lead: their strings are sorted
    kinds = words[order[starts]]
    lead = np.concatenate([[True], (kinds[1:, : RUN // 8] != kinds[:-1, : RUN // 8]).any(axis=1)])
    tied = np.flatnonzero(~(lead & np.append(lead[1:], True)))
    raw = kinds[tied].astype(">u8").view(np.uint8).reshape(len(tied), 8 * WORDS)
    tied, raw = tied[raw[:, LENGTH + BACK] != ALONE], raw[raw[:, LENGTH + BACK] != ALONE]
    whole = np.concatenate([raw[:, LENGTH : LENGTH + BACK], raw[:, :LENGTH]], axis=1)
    low, count = raw[:, LENGTH + BACK].astype(np.int64), raw[:, LENGTH + BACK + 1].astype(np.int64) - raw[:, LENGTH + BACK] + 1
    cuts = np.flatnonzero(lead[tied])  # a lead's strings are sorted together
    masks = np.zeros(len(starts), np.uint32)
    a = 0
    ends = np.cumsum(count)
    while a < len(tied):
        b = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + AT_ONCE, side="right"))
        after = cuts[np.searchsorted(cuts, max(b, a + 1)) :]
        b = int(after[0]) if len(after) else len(tied)
        of = np.repeat(np.arange(a, b), count[a:b])
        place = np.arange(len(of)) - np.repeat(ends[a:b] - count[a:b] - ends[a] + count[a], count[a:b]) + low[of]
        strings, found = multikey(_words(sliding_window_view(whole, LENGTH, axis=1)[of, BACK - place]))
        begin = np.flatnonzero(found)
        own = least[tied[of[strings]]]
        first = np.repeat(np.minimum.reduceat(own, begin), np.diff(np.append(begin, len(own))))
        hit = own > first
        np.bitwise_or.at(masks, tied[of[strings[hit]]], np.uint32(1) << place[strings[hit]].astype(np.uint32))
        a = b
    out[order] |= np.repeat(masks, sizes)
    return out


class Block:
    """A block's documents in ascending order, each different text once."""

    def __init__(self, packed: pa.Table, found: pa.Table | None = None):
        rows = blocks.unpack(packed)
        ids = [blocks.MOST if x is None else x for x in rows.column("doc_id").to_pylist()]
        texts = [x.encode() for x in rows.column("text").to_pylist()]
        order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.rows = rows.take(pa.array(order, pa.int64()))
        self.ids = np.array([ids[i] for i in order], np.int64)
        first: dict[bytes, int] = {}
        self.owner = []  # of each row, the row with the same text that comes first
        self.texts = []
        for n, i in enumerate(order):
            self.owner.append(first.setdefault(texts[i], n))
            self.texts.append(texts[i])
        own = [n for n, o in enumerate(self.owner) if n == o and len(self.texts[n]) >= LENGTH]
        hashes = np.frombuffer(b"".join(xxhash.xxh3_128_digest(self.texts[n]) for n in own), "<u8").reshape(-1, 2)
        self.whole, at = np.unique(hashes, axis=0, return_inverse=True)  # keys of the texts
        before = answers(found, 0, "?")[at] if found is not None and len(own) else np.zeros(len(own), bool)
        self.copies = {n for n, gone in zip(own, before, strict=True) if gone}
        self.own = [n for n in own if n not in self.copies]

    def stretches(self):
        """(document, start, stop) of parts that are worked on together: a part has up to STRETCH strings."""
        parts, total = [], 0
        for n in self.own:
            size = len(self.texts[n])
            for start in range(0, size - LENGTH + 1, STRETCH):
                stop = min(start + STRETCH + LENGTH - 1, size)
                if parts and total + stop - start > STRETCH:
                    yield parts
                    parts, total = [], 0
                parts.append((n, start, stop))
                total += stop - start
        if parts:
            yield parts

    def drawn(self, parts):
        """The bytes of parts, and of each suffix drawn: its document, place, key, first and last string, and what to add to make these places of the document."""
        raw = np.frombuffer(b"".join(memoryview(self.texts[n])[a:b] for n, a, b in parts), np.uint8)
        sizes = np.array([b - a for _, a, b in parts])
        ends = np.cumsum(sizes)
        whole = np.ones(len(raw) - LENGTH + 1, bool)
        for end in ends[:-1]:
            whole[end - LENGTH + 1 : end] = False
        at = np.flatnonzero(whole)
        keys = _hashes(raw, RUN)
        places = np.arange(len(keys), dtype=np.uint64) & _PLACES
        least = _least((keys & ~_PLACES) | (_PLACES - places), SPAN)[at]
        sample = at + ((_PLACES - (least & _PLACES)).astype(np.int64) - (at & int(_PLACES))) % (int(_PLACES) + 1)
        new = np.flatnonzero(_first(sample))
        part = np.searchsorted(ends, at[new], side="right")
        docs, bases = np.array([n for n, _, _ in parts]), np.array([a for _, a, _ in parts]) - (ends - sizes)
        return raw, docs[part], sample[new], keys[sample[new]], at[new], at[np.append(new[1:], len(at)) - 1], bases[part]

    def samples(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct keys of leads, and whether two texts of this block have each."""
        found = [self.drawn(parts)[1:4:2] for parts in self.stretches()]
        if not found:
            return np.empty(0, np.uint64), np.empty(0, bool)
        d, k = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((d, k))
        k, d = k[order], d[order]
        starts = np.flatnonzero(_first(k))
        return k[starts], np.minimum.reduceat(d, starts) != np.maximum.reduceat(d, starts)

    def suffixes(self, found: pa.Table) -> "Suffixes":
        """The suffixes in play."""
        shared, hot = _shared(found)
        out = []
        for parts in self.stretches() if len(shared) else ():
            raw, doc, at, key, first, last, base = self.drawn(parts)
            asked = key & _SENT
            where = np.minimum(np.searchsorted(shared, asked), len(shared) - 1)
            kept = np.flatnonzero(shared[where] == asked)
            doc, at, first, last, base, hot_ = doc[kept], at[kept], first[kept], last[kept], base[kept], hot[where[kept]]
            around = np.zeros(len(raw) + BACK + LENGTH, np.uint8)
            around[BACK : BACK + len(raw)] = raw
            low, high = at - last, at - first
            rows = np.zeros((len(at), 8 * WORDS), np.uint8)
            whole, column = sliding_window_view(around, BACK + LENGTH)[at], np.arange(BACK + LENGTH)
            whole *= (column >= (BACK - high)[:, None]) & (column < (BACK - low + LENGTH)[:, None])
            rows[:, :LENGTH], rows[:, LENGTH : LENGTH + BACK] = whole[:, BACK:], whole[:, :BACK]
            rows[:, LENGTH + BACK], rows[:, LENGTH + BACK + 1] = low, high
            cold = ~hot_
            out.append((_words(rows[cold]), doc[cold], (first + base)[cold], high[cold], (high - low + 1)[cold]))
            if hot_.any():
                of = np.repeat(np.flatnonzero(hot_), (high - low + 1)[hot_])
                start = np.concatenate([np.arange(a, b + 1) for a, b in zip(first[hot_], last[hot_], strict=True)])
                rows = np.zeros((len(of), 8 * WORDS), np.uint8)
                rows[:, :LENGTH], rows[:, LENGTH + BACK] = sliding_window_view(raw, LENGTH)[start], ALONE
                out.append((_words(rows), doc[of], start + base[of], np.zeros(len(of), np.int64), np.ones(len(of), np.int64)))
        empty = np.empty(0, np.int64)
        return Suffixes(self.ids, *(np.concatenate(x) for x in zip(*(out or [(np.empty((0, WORDS), np.uint64), empty, empty, empty, empty)]), strict=True)))

    def kept(self, docs: np.ndarray, places: np.ndarray) -> list[tuple[int, int, bytes]]:
        """Bytes removed, spans and what is kept of each row, given the windows that go."""
        order = np.lexsort((places, docs))
        docs, places = docs[order], places[order]
        edges = np.searchsorted(docs, np.arange(len(self.texts) + 1))
        out: list[tuple[int, int, bytes]] = []
        for n, content in enumerate(self.texts):
            first, at = self.owner[n], places[edges[n] : edges[n + 1]]
            if n in self.copies:
                out.append((len(content), 1, b""))
            elif first != n:
                whole = len(content) >= LENGTH and self.ids[n] > self.ids[first]
                out.append((len(content), 1, b"") if whole else out[first])
            elif not len(at):
                out.append((0, 0, content))
            else:
                new = np.concatenate([[True], at[1:] > at[:-1] + LENGTH])
                begin, end = at[new], np.append(at[:-1][new[1:]], at[-1]) + LENGTH
                parts = [content[a:b] for a, b in zip([0, *end.tolist()], [*begin.tolist(), len(content)], strict=True)]
                out.append((int((end - begin).sum()), len(begin), b"".join(parts)))
        return out


class Suffixes:
    """Suffixes in play of a block: equal ones are sent once, under the least doc_id."""

    def __init__(self, ids, words, doc, place, high, count):
        self.words, self.doc, self.place, self.high, self.count = words, doc, place, high, count
        self.id = ids[doc]
        by_id = np.argsort(self.id, kind="stable")
        order, new = multikey(words[by_id])
        self.order, self.new = by_id[order], new
        self.heads = self.order[new]

    def buckets(self, splitters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The heads in order of their buckets, and these."""
        words = self.words[self.heads]
        bucket = np.searchsorted(splitters, words[:, 0], side="right")
        alone = (words[:, (LENGTH + BACK) // 8] >> np.uint64(56 - 8 * ((LENGTH + BACK) % 8))) & np.uint64(255) == ALONE
        mixed = np.zeros(int(alone.sum()), np.uint64)
        for at in range(WORDS):
            mixed = _joined(mixed, words[alone, at])
        bucket[alone] = (mixed >> np.uint64(32)) % np.uint64(len(splitters) + 1)
        order = np.argsort(bucket, kind="stable")
        return order, bucket[order]

    def send(self, block: int, splitters: np.ndarray) -> pa.Table:
        order, bucket = self.buckets(splitters)
        heads = self.heads[order]
        starts = np.flatnonzero(_first(bucket))
        sent = [_packed(self.words[heads[a:b]], self.id[heads[a:b]]) for a, b in zip(starts, np.append(starts, len(bucket))[1:], strict=True)]
        return pa.table({"block": pa.array([block] * len(starts), pa.int64()), "bucket": pa.array(bucket[starts].astype(np.int32)), "sent": pa.array(sent, pa.binary())})

    def gone(self, masks: np.ndarray, splitters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document and place of each string that goes, given what came back for the heads."""
        of_head = np.empty(len(self.heads), np.uint32)
        of_head[self.buckets(splitters)[0]] = masks
        mask, least = np.empty(len(self.order), np.uint32), np.empty(len(self.order), np.int64)
        group = np.cumsum(self.new) - 1
        mask[self.order], least[self.order] = of_head[group], self.id[self.heads][group]
        mask[self.id > least] = (1 << SPAN) - 1
        at = np.flatnonzero(mask)
        of = np.repeat(at, self.count[at])
        step = np.arange(len(of)) - np.repeat(np.cumsum(self.count[at]) - self.count[at], self.count[at])
        hit = mask[of] >> (self.high[of] - step).astype(np.uint32) & np.uint32(1) == 1
        return self.doc[of[hit]], self.place[of[hit]] + step[hit]


def _packed(words: np.ndarray, ids: np.ndarray) -> bytes:
    raw = words.astype(">u8").tobytes() + ids.astype("<i8").tobytes()
    return len(ids).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(sent: bytes) -> tuple[np.ndarray, np.ndarray]:
    size = int.from_bytes(sent[:4], "little")
    raw = pa.decompress(sent[4:], decompressed_size=size * 8 * (WORDS + 1), codec="zstd", asbytes=True)
    return np.frombuffer(raw, ">u8", size * WORDS).reshape(size, WORDS).astype(np.uint64), np.frombuffer(raw, "<i8", offset=8 * size * WORDS)


def splitters_of(docs: DataFrame, count: int) -> np.ndarray:
    """Borders between ``count`` buckets, from leading words of suffixes drawn in ``DRAWN`` texts for each bucket.

    What is collected grows with the buckets, not with the corpus; borders decide only
    where a suffix is sorted.
    """
    docs = docs.select("text").where(F.octet_length("text") >= LENGTH)
    share = min(1.0, DRAWN * count / max(1, docs.count()))

    def run(batches):
        rng = np.random.default_rng(5)
        for batch in batches:
            found = []
            for text in batch.column(0).to_pylist():
                raw = np.frombuffer(text.encode(), np.uint8)
                at = rng.integers(0, len(raw) - LENGTH + 1)
                found.append(int.from_bytes(raw[at : at + 8].tobytes(), "big") >> 1)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["lead"])

    leads = np.sort(np.array([r.lead for r in docs.sample(share, 11).mapInArrow(run, "lead long").collect()], np.uint64) << np.uint64(1))
    return leads[np.linspace(0, len(leads), count + 1)[1:-1].astype(int)] if len(leads) >= count else leads


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document."""
    return _removed(docs.select("doc_id", "text"), OUT, _digests)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with what is kept of each text; of a character cut in parts nothing stays.

    All other columns come back as they are, whatever their names.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    held = docs.select("doc_id", "text", F.struct(F.lit(0).alias("at"), *(F.col(c).alias(f"at{i}") for i, c in enumerate(rest))).alias("rest"))
    schema = held.select(F.col("doc_id").cast("long"), "text", "rest").schema
    back = _removed(held, schema, _texts)
    return back.select(*(F.col("rest")[f"at{rest.index(c)}"].alias(c) if c in rest else F.col(c).cast(docs.schema[c].dataType) for c in docs.columns))


def _removed(docs: DataFrame, schema, results) -> DataFrame:
    base = blocks.with_blocks(docs, size=BLOCK, carried=["rest"] if results is _texts else [])
    count = blocks.buckets(docs)
    splitters = splitters_of(docs, partitions(docs.sparkSession))
    grouped = base.groupBy("block")

    def zero(rows: pa.Table) -> pa.Table:
        held = Block(rows)
        bucket = ((held.whole[:, 0] >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int32)
        starts = np.flatnonzero(_first(bucket))
        return pa.table({
            "block": pa.array([_number(rows)] * len(starts), pa.int64()), "bucket": pa.array(bucket[starts], pa.int32()),
            "sent": pa.array([held.whole[a:b].tobytes() for a, b in zip(starts, np.append(starts, len(bucket))[1:], strict=True)], pa.binary()),
        })

    def first(rows: pa.Table, found: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return blocks.send(0, np.empty(0, np.uint64), count, WIDTH)
        keys, here = Block(rows, found).samples()
        # keys that two texts of the block have go under a number below 0, which no block has
        return release(pa.concat_tables([blocks.send(_number(rows), keys[~here], count, WIDTH), blocks.send(~_number(rows), keys[here], count, WIDTH)]))

    def second(rows: pa.Table, found: pa.Table) -> pa.Table:
        return release(Block(rows, found).suffixes(found).send(_number(rows) if rows.num_rows else 0, splitters))

    def third(rows: pa.Table, found: pa.Table) -> pa.Table:
        held = Block(rows, found)
        return release(results(held, held.kept(*held.suffixes(found).gone(answers(found, 2, "<u4"), splitters))))

    def round_(rows: DataFrame, number: int) -> DataFrame:
        return rows.withColumn("round", F.lit(number))

    known = round_(grouped.applyInArrow(zero, blocks.SENT).groupBy("bucket").applyInArrow(_copies, blocks.SENT), 0)
    one = grouped.cogroup(known.groupBy("block")).applyInArrow(first, blocks.SENT)
    known = known.unionByName(round_(one.groupBy("bucket").applyInArrow(_met, blocks.SENT), 1))
    two = grouped.cogroup(known.groupBy("block")).applyInArrow(second, blocks.SENT)
    known = known.unionByName(round_(two.groupBy("bucket").applyInArrow(_compared, blocks.SENT), 2))
    return grouped.cogroup(known.groupBy("block")).applyInArrow(third, schema)


def _number(rows: pa.Table) -> int:
    return rows.column("block")[0].as_py()


def answers(found: pa.Table, number: int, dtype: str) -> np.ndarray:
    return blocks.answers_in(found, number, dtype)


def _copies(rows: pa.Table) -> pa.Table:
    """Whether each whole text (by 128 bits) is in a block of smaller doc_ids."""
    sent = rows.column("sent").to_pylist()
    sizes = np.array([len(x) // 16 for x in sent])
    keys = np.frombuffer(b"".join(sent), "<u8").reshape(-1, 2)
    ranges = np.repeat(np.unique(rows.column("block").to_numpy() >> blocks.PART, return_inverse=True)[1].astype(np.int32), sizes)
    order, new = multikey(keys)
    starts = np.flatnonzero(new)
    least = np.minimum.reduceat(ranges[order], starts)
    out = np.empty(len(keys), bool)
    out[order] = ranges[order] > np.repeat(least, np.diff(np.append(starts, len(keys))))
    return _back(rows, out, sizes)


def _compared(rows: pa.Table) -> pa.Table:
    """For each suffix of a bucket, the strings that a smaller doc_id has."""
    parts = [_unpacked(x) for x in rows.column("sent").to_pylist()]
    words, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
    sizes = [len(p[1]) for p in parts]
    del parts
    return release(_back(rows, covered(words, ids), sizes))


def _back(rows: pa.Table, out: np.ndarray, sizes) -> pa.Table:
    at = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
    return pa.table({"block": rows.column("block"), "bucket": rows.column("bucket"), "sent": pa.array([out[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary())})


def _shared(found: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The sorted keys, as sent, that a block shares, and which are hot."""
    raw = np.frombuffer(b"".join(found.filter(pc.equal(found.column("round"), 1)).column("sent").to_pylist()), np.uint8).reshape(-1, WIDTH + 1)
    keys = np.zeros((len(raw), 8), np.uint8)
    keys[:, :WIDTH] = raw[:, :WIDTH]
    keys = keys.reshape(-1).view("<u8")
    order = np.argsort(keys, kind="stable")
    return keys[order], raw[order, WIDTH] > 0


def _met(rows: pa.Table) -> pa.Table:
    """Of each block's keys, those that another block or another text has, each with a byte that is 1 if it is hot."""
    numbers, sent = rows.column("block").to_numpy(), rows.column("sent").to_pylist()
    met = blocks.answers_of(blocks.meet(rows, blocks.how_many, "u1", WIDTH))
    out: dict[int, list[bytes]] = {}
    for number, raw, many in zip(numbers.tolist(), sent, met, strict=True):
        keys = np.concatenate([np.frombuffer(raw, np.uint8).reshape(-1, WIDTH), (many >= HOT)[:, None].astype(np.uint8)], axis=1)
        shared = keys if number < 0 else keys[many > 1]
        if len(shared):
            out.setdefault(max(number, ~number), []).append(shared.tobytes())
    bucket = rows.column("bucket")[0].as_py()
    return pa.table({"block": pa.array(list(out), pa.int64()), "bucket": pa.array([bucket] * len(out), pa.int32()), "sent": pa.array([b"".join(v) for v in out.values()], pa.binary())})


def _digests(held: Block, kept: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table({
        "doc_id": held.rows.column("doc_id"),
        "n_bytes": pa.array([len(t) for t in held.texts], pa.int64()),
        "n_removed": pa.array([k[0] for k in kept], pa.int64()),
        "n_spans": pa.array([k[1] for k in kept], pa.int64()),
        "kept_sha256": pa.array([hashlib.sha256(k[2]).hexdigest() for k in kept], pa.string()),
    })


def _texts(held: Block, kept: list[tuple[int, int, bytes]]) -> pa.Table:
    at = held.rows.schema.get_field_index("text")
    rows = held.rows.set_column(at, "text", pa.array([k[2].decode("utf-8", "ignore") for k in kept], pa.string()))
    return rows.select(["doc_id", "text", "rest"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
