"""Best-two-fit packing of tokenized documents into sequences of a fixed length.

Documents are tokenized where they lie; only documents longer than a sequence are cut.
Pieces that fill a sequence are done. The others are dealt by a hash into groups of
bounded size (``GROUP`` pieces on average), and each group is packed by itself: fill a
sequence greedily with the largest piece that fits; then take out its smallest piece
and, if two pieces not yet packed fill the widened gap more tightly, put those in. A
group leaves about one sequence part empty, so the loss against one packing of all
pieces is at most one sequence for each group. What is shuffled is one short row for
each piece, never a text.

Defined results: null text counts as empty, an empty document is one piece that holds
the end id alone; each row is a document of its own, so repeated rows and null ids are
packed like any other; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hazardspark.llm.common import kept, materialize, slices, table

LIMIT, END, GROUP = 2048, 0, 50_000
REMEMBERED, STRETCH = 300_000, 4_000_000


def _byte_names() -> list[str]:
    """The character by which a byte-level vocabulary writes each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs, one run after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class Merges:
    """The vocabulary's merges over many short units at once."""

    LONGEST, CHUNK = 64, 8192
    WIDTHS = (4, 6, 8, 10, 12, 16, 24, LONGEST)
    NONE = np.iinfo(np.int64).max

    def __init__(self, content: str):
        model = json.loads(content)["model"]
        vocabulary, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.inner = np.array([vocabulary[c] for c in _byte_names()], np.int64)
        self.final = np.array([vocabulary[c + suffix] for c in _byte_names()], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocabulary[x] << 32 | vocabulary[y] for x, y in pairs], np.int64)
        makes = np.array([vocabulary[x + y] for x, y in pairs], np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], self.NONE)
        self.steps = np.append((np.arange(len(pairs)) << 32 | makes)[order], self.NONE)

    def _step(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank (upper half) and product (lower half) of each pair's merge."""
        key = a << 32 | b
        found = np.searchsorted(self.keys, key)
        return np.where(self.keys[found] == key, self.steps[found], self.NONE)

    def _merge(self, token: np.ndarray) -> np.ndarray:
        """Tokens (place x unit, -1 behind a unit's last): every unit's leftmost pair of least rank is merged, time and again."""
        out = np.full(token.shape, -1, np.int64)
        unit = np.arange(token.shape[1])
        step = self._step(token[:-1], token[1:])
        while True:
            best = step.min(axis=0, initial=self.NONE)
            open_ = best < self.NONE
            out[: len(token), unit[~open_]] = token[:, ~open_]
            if not open_.any():
                return out
            token, step, unit, best = token[:, open_], step[:, open_], unit[open_], best[open_]
            at, column = (step == best).argmax(axis=0), np.arange(len(unit))
            token[at, column] = best & 0xFFFFFFFF
            token = np.where(np.arange(len(token) - 1)[:, None] > at, token[1:], token[:-1])
            step = np.where(np.arange(len(step) - 1)[:, None] >= at, step[1:], step[:-1])
            if len(step):
                for place in (np.maximum(at - 1, 0), np.minimum(at, len(step) - 1)):
                    step[place, column] = self._step(token[place, column], token[place + 1, column])

    def encode(self, signs: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of units of signs below U+0100, unit after unit, and how many each unit has."""
        sizes = sizes + np.add.reduceat(signs >= 128, np.cumsum(sizes) - sizes, dtype=np.int64)
        raw = np.frombuffer(signs.tobytes().decode("latin-1").encode(), np.uint8)
        starts, counts, made, low = np.cumsum(sizes) - sizes, np.zeros(len(sizes), np.int64), [], 0
        for width in self.WIDTHS:
            alike, low = np.flatnonzero((sizes > low) & (sizes <= width)), width
            for i in range(0, len(alike), self.CHUNK):
                units, places = alike[i : i + self.CHUNK], np.arange(width)[:, None]
                last = sizes[units] - 1
                token = self.inner[raw[np.minimum(starts[units] + places, len(raw) - 1)]]
                token[places > last] = -1
                token[last, np.arange(len(units))] = self.final[raw[starts[units] + last]]
                out = self._merge(token).T
                counts[units] = (out >= 0).sum(axis=1)
                made.append((units, out[out >= 0]))
        first = np.cumsum(counts) - counts
        ids = np.zeros(counts.sum(), "<u4")
        for units, got in made:
            ids[_runs(first[units], counts[units])] = got
        return ids, counts


PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PART, LETTER, NUMBER, OTHER, STRANGE = range(5)


def _kind(sign: str) -> int:
    if sign in " \n":
        return PART
    if not sign.isprintable():
        return STRANGE
    return LETTER if sign.isalpha() else NUMBER if sign.isnumeric() else OTHER


KINDS = np.array([*map(_kind, map(chr, range(256))), STRANGE], np.uint8)  # the last is for all signs from U+0100 on
LOWER = np.array([*(ord(chr(i).lower()) for i in range(256)), 0], np.uint8)


def _stretches(text: str):
    """``text`` in stretches parted at blanks."""
    start = 0
    for blank in re.finditer("[ \n]", text):
        if blank.end() - start >= STRETCH:
            yield text[start : blank.end()]
            start = blank.end()
    yield text[start:]


class Encoder:
    """The ids of the tokenizers library as little-endian 32-bit words.

    A blank or line end always parts words. Printable words of Latin letters are cut into
    the vocabulary's units, all at once, and each distinct unit takes the vectorised merges;
    all other words take the library itself. Unit 0 closes a text, unit 1 stands for a word
    of the library.
    """

    def __init__(self, content: str):
        if json.loads(content)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] != PATTERN:
            raise ValueError("a vocabulary of other units")
        self.tokenizer = Tokenizer.from_str(content)
        self.merges = Merges(content)
        self.units = pa.array([b"\x00", b"\x01"], pa.binary())
        self.ids, self.sizes = np.zeros(0, "<u4"), np.zeros(2, np.int64)
        self.others: dict[str, bytes] = {}
        self.held = 0  # signs of the words in ``others``

    def _cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Signs of all texts' units in lower case, where each unit starts, and the words for the library."""
        joined = "\n".join([*texts, ""])
        signs = np.minimum(np.frombuffer(joined.encode("utf-32-le"), "<u4"), 256).astype(np.uint16)
        kind, lower = KINDS[signs], LOWER[signs]
        part = kind == PART
        start = ~part
        start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        self._shorten(signs, kind, lower, start)
        keep = ~part
        closing = np.cumsum([len(text) + 1 for text in texts], dtype=np.int64) - 1
        start[closing], keep[closing], lower[closing] = True, True, 0

        strange = kind == STRANGE
        strange[:-1] |= (signs[:-1] == ord("<")) & (signs[1:] == ord("|"))
        ends = np.flatnonzero(part)
        firsts = np.append(0, ends[:-1] + 1)
        other = ends - firsts > Merges.LONGEST // 2
        other[np.searchsorted(ends, np.flatnonzero(strange))] = True
        firsts, ends = firsts[other], ends[other]
        inside = _runs(firsts, ends - firsts)
        start[inside] = keep[inside] = False
        start[firsts], keep[firsts], lower[firsts] = True, True, 1
        words = [joined[a:b] for a, b in zip(firsts.tolist(), ends.tolist(), strict=True)]
        return lower[keep], np.flatnonzero(start[keep]), words

    @staticmethod
    def _shorten(signs: np.ndarray, kind: np.ndarray, lower: np.ndarray, start: np.ndarray) -> None:
        """An apostrophe that starts a unit goes with s, t, m, d, re, ve or ll behind it."""
        at = np.flatnonzero((signs == ord("'")) & start)
        one, two = (lower[np.minimum(at + n, len(lower) - 1)].astype(np.int64) for n in (1, 2))
        size = np.isin(one, list(b"stmd")) + 2 * np.isin(one << 8 | two, [int.from_bytes(x) for x in (b"re", b"ve", b"ll")])
        at, size = at[size > 0], size[size > 0]
        start[at + 1] = start[at + size] = False
        behind = at + size + 1
        start[behind[kind[behind] == LETTER]] = True

    def _known(self, signs: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The number of each unit among those remembered; new ones are merged."""
        cuts = np.append(starts, len(signs)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(signs)]).dictionary_encode()
        found = pc.index_in(coded.dictionary, value_set=self.units)
        fresh = coded.dictionary.filter(pc.is_null(found))
        number = np.array(found.fill_null(-1), np.int64)
        number[number < 0] = len(self.units) + np.arange(len(fresh))
        if len(fresh):
            sizes = pc.binary_length(fresh).to_numpy().astype(np.int64)
            ids, counts = self.merges.encode(np.frombuffer(b"".join(fresh.to_pylist()), np.uint8), sizes)
            self.units = pa.concat_arrays([self.units, fresh])
            self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, counts])
        if len(self.units) > REMEMBERED:  # the units of this stretch stay
            used = np.union1d(number, [0, 1])
            self.ids = self.ids[_runs((np.cumsum(self.sizes) - self.sizes)[used], self.sizes[used])]
            self.units, self.sizes = self.units.take(pa.array(used)), self.sizes[used]
            number = np.searchsorted(used, number)
        return number[coded.indices.to_numpy()]

    def _encode(self, texts: list[str]) -> list[bytes]:
        signs, starts, words = self._cut(texts)
        number = self._known(signs, starts)
        if len(self.others) > REMEMBERED or self.held > STRETCH:
            self.others.clear()
            self.held = 0
        new = list(set(words).difference(self.others))
        self.held += sum(map(len, new))
        for word, got in zip(new, self.tokenizer.encode_batch(new, add_special_tokens=False), strict=True):
            self.others[word] = np.array(got.ids, "<u4").tobytes()
        there = [self.others[word] for word in words]
        closing = number == 0
        number[number == 1] = len(self.sizes) + np.arange(len(words))
        sizes = np.concatenate([self.sizes, np.array([len(x) // 4 for x in there], np.int64)])
        ids = np.concatenate([self.ids, np.frombuffer(b"".join(there), "<u4")])
        counts = sizes[number]
        packed = ids[_runs((np.cumsum(sizes) - sizes)[number], counts)].tobytes()
        cuts = (4 * np.cumsum(counts)[closing]).tolist()
        return [packed[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(texts) == 1 and len(texts[0]) > STRETCH:
            return [b"".join(self._encode([part])[0] for part in _stretches(texts[0]))]
        return self._encode(texts) if texts else []


def _encoder(content) -> Encoder:
    return kept(("packing", content.value), lambda: Encoder(content.value))


def pieces(docs: DataFrame, path: str | None = None, limit: int = LIMIT, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's pieces."""
    with open(path or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())  # under 2 MB whatever the corpus
    last = np.array([end], "<u4").tobytes()

    def run(batches):
        encoder = _encoder(vocabulary)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for a, b in slices([len(x) for x in texts], STRETCH):
                rows = []
                for doc_id, packed in zip(ids[a:b], encoder.encode(texts[a:b]), strict=True):
                    packed += last
                    total = len(packed) // 4
                    for piece, start in enumerate(range(0, total, limit)):
                        cut = packed[4 * start : 4 * (start + limit)]
                        rows.append((doc_id, piece, start, len(cut) // 4, zlib.crc32(cut)))
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def two_fit(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """For each length, its bin and its place there."""
    order = np.argsort(lengths, kind="stable")
    first = np.searchsorted(lengths[order], np.arange(limit + 2))
    left = np.diff(first)  # unpacked pieces of each length
    taken = np.zeros(limit + 1, np.int64)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    grid = np.arange(limit + 1)
    # below[x]: the largest length of at most x that is there, 0 if none
    below = np.maximum.accumulate(np.where(left > 0, grid, 0))

    def change(size: int, by: int) -> None:
        left[size] += by
        if left[size] == 0 and by < 0:
            upto = np.searchsorted(below, size, side="right")
            below[size:upto] = below[size - 1] if size else 0
        elif left[size] == by and by > 0:
            np.maximum(below[size:], size, out=below[size:])

    done = number = 0
    while done < len(lengths):
        held, gap = [], limit
        while gap and (size := int(below[gap])):
            held.append(size)
            change(size, -1)
            gap -= size
        if gap and len(held) > 1:
            smallest = held[-1]
            room = gap + smallest
            one = np.flatnonzero(left[: room + 1] > 0)
            two = below[room - one]
            same = (two == one) & (left[one] < 2)
            two[same] = below[np.maximum(one[same] - 1, 0)]
            sums = np.where(two > 0, one + two, 0)
            if len(sums) and (best := int(np.argmax(sums))) >= 0 and sums[best] > smallest:
                change(smallest, 1)
                held[-1:] = [int(one[best]), int(two[best])]
                for size in held[-2:]:
                    change(size, -1)
                gap = room - int(sums[best])
                while gap and (size := int(below[gap])):
                    held.append(size)
                    change(size, -1)
                    gap -= size
        place = 0
        for size in held:
            row = order[first[size] + taken[size]]
            taken[size] += 1
            bins[row], offsets[row] = number, place
            place += size
        done += len(held)
        number += 1
    return bins, offsets


def pack(parts: DataFrame, limit: int = LIMIT, group: int = GROUP) -> DataFrame:
    """``parts`` (with length from 1 to ``limit``) with sequence_id and offset."""
    parts = materialize(parts, "pieces")  # rows have a place from here on: equal rows go to different groups
    groups = max(1, -(-parts.count() // group))
    dealt = parts.withColumn("group_no", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(groups)))
    schema = parts.select("*").withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).schema

    def run(rows: pa.Table) -> pa.Table:
        number = rows.column("group_no")[0].as_py()
        bins, offsets = two_fit(rows.column("length").to_numpy(), limit)
        return rows.drop_columns(["group_no"]).append_column("sequence_id", pa.array((number << 40) + bins, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    return dealt.groupBy("group_no").applyInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents")))
