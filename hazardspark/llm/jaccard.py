"""N-gram Jaccard join by PartEnum signatures.

Sets of word shingles that are alike to ``NUM``/``DEN`` or more, and the components of
these links. Equal sets are one class; everything below is about classes.

Signatures. Sizes are cut into narrow bands, each a quarter wide at 0.75, so that alike
sets lie in one band or in neighbours; a pair is met in the band of its smaller set.
Sets of the band differ in at most ``k`` shingles. The domain of shingle hashes is cut
into ``n1`` first-level parts, and each of these into ``SECOND`` second-level parts; of
each first-level part every choice of ``SECOND - DIRTY`` second-level parts is one
signature (the shingles that lie there). k differing shingles cannot spoil more than
``DIRTY`` second-level parts of each first-level part, if there are more than k / 2
first-level parts, so alike sets share a signature. There are ``SLACK`` % more
parts than that, so that they share a known number (``need``), even without those that
are empty. Of a set with too many empty ones (a ``weak`` one, mostly tiny sets), every
shingle is a signature too, so two weak partners meet by shingles. No link is lost.

Signatures meet between blocks of the corpus as sorted arrays of hashes (``blocks``).
A set that shares fewer than ``need`` is out; of the others' shared signatures only the
rarest go on as rows, all but ``need - 1`` of them: of the signatures that two partners
have in common, the rarest is among these on both sides.

Sets that are joined by signatures, directly or through others, are a group. Each set
goes to its group once; groups of up to ``CHUNK`` bytes are searched inside one task,
which compares whole sets and gives one row for each set: its component. A larger group
is cut into chunks by hash. Each chunk is searched by itself; then representatives of
the chunks' components; then every set outside its group's largest component is held
against each chunk. Nothing that moves grows with the pairs of a group: chunks give at
most one link for each row they read. Inside tasks, parity sketches whose differing
bits never exceed the differing shingles spare most comparisons of whole sets, and
sets that are in one component already are not compared.

Shingles are 64-bit hashes of five words, a class is a 64-bit hash of its set.

Defined results: null text, or a text without words, has an empty set and is linked
with nothing; rows of equal text are one class, so repeated rows, equal and null doc_ids
are no special case (a null is never a component_id unless all doc_ids of the component
are null; an unlinked row has its own doc_id); other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardspark.llm import blocks
from hazardspark.llm.common import materialize, release, slices, table
from hazardspark.llm.components import connected

WORDS, NUM, DEN = 5, 75, 100
REMEMBERED = 200_000
#: Second-level parts, how many of them may be spoiled, and first-level parts above those that are needed.
SECOND, DIRTY, SLACK = 3, 1, 15
#: Bytes of sets that are searched in one task; shingles that are signed at once.
CHUNK, AT_ONCE = 8 << 20, 1 << 17
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: Odd factors, one for each word of a shingle.
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
FOUND = "kind int, doc_id long, cls long, n int, sig long, shingles binary"
KINDS = {"doc_id": pa.int64(), "cls": pa.int64(), "n": pa.int32(), "sig": pa.int64(), "shingles": pa.binary()}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def shingles(text: str, known: dict) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = text.encode().lower().split()
    n = len(words)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    if n >= WORDS:
        out = h[: n - WORDS + 1] * _FACTORS[0]
        for i in range(1, WORDS):
            out += h[i : n - WORDS + 1 + i] * _FACTORS[i]
        return np.unique(_mix(out))
    if not n:
        return h
    out = h[:1] * _C + np.uint64(n)
    for i in range(1, n):
        out = _mix(out * _A + h[i : i + 1])
    return _mix(out)


def class_of(found: np.ndarray) -> int:
    total = _mix(found + _A).sum(keepdims=True) + np.array([len(found)], np.uint64) * _B
    return int(_mix(total).view(np.int64)[0])


def differing(a: int, b: int) -> int:
    """How many shingles two alike sets of these sizes may differ in."""
    return (DEN - NUM) * (a + b) // (DEN + NUM)


@lru_cache(maxsize=1)
def tops() -> list[int]:
    """The largest size of each band; a band's smallest set may be alike to all sets of the band."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append((out[-1] + 1) * DEN // NUM)
    return out


@lru_cache(maxsize=1 << 16)
def bands(n: int) -> tuple[tuple[int, int, int], ...]:
    """(band, first-level parts, signatures to agree at least) where a set of ``n`` may have partners."""
    largest = tops()
    own = int(np.searchsorted(largest, n))
    out = []
    for band in (own - 1, own):
        if band < 0 or (band < own and NUM * n > DEN * largest[band]):
            continue
        k = differing(largest[band], DEN * largest[band] // NUM)
        parts = ((k + 1) * (100 + SLACK) + 100 * (DIRTY + 1) - 1) // (100 * (DIRTY + 1))
        differ = differing(n, DEN * n // NUM) if band == own else differing(n, largest[band])
        # the first differing shingle of a part spoils all choices but one, the second all
        spoiled = (SECOND - 1) * min(differ, parts) + min(max(differ - parts, 0), parts)
        out.append((band, parts, SECOND * parts - spoiled))
    return tuple(out)


class Signed:
    """The signatures of sets: an entry for each band of a set, with its set and its ``need``; for each signature its entry."""

    def __init__(self, hashes: np.ndarray, sizes: np.ndarray):
        parts = [_signed(hashes, sizes, slice(a, b)) for a, b in slices(sizes.tolist(), AT_ONCE)] or [_signed(hashes, sizes, slice(0, 0))]
        before = 0
        for part in parts:
            part[3][:] += before
            before += len(part[0])
        self.set, self.need, self.sig, self.entry, self.single = (np.concatenate(x) for x in zip(*parts, strict=True))


def _signed(hashes: np.ndarray, sizes: np.ndarray, rows: slice) -> tuple[np.ndarray, ...]:
    """set, need of each entry; sig, entry and whether it is a single shingle, of each signature."""
    found = [(i, *band) for i, n in enumerate(sizes[rows].tolist(), rows.start) for band in bands(n)]
    of, band, parts, least = np.array(found, np.int64).reshape(-1, 4).T
    size, cells = sizes[of], SECOND * parts
    stop, offset = np.cumsum(size), np.cumsum(cells) - cells
    h = hashes[np.arange(size.sum()) + np.repeat((np.cumsum(sizes) - sizes)[of] - (stop - size), size)]
    cell = ((h >> np.uint64(32)) * np.repeat(cells, size).astype(np.uint64) >> np.uint64(32)).astype(np.int64) + np.repeat(offset, size)
    mixed = _mix(h + _B)
    starts = np.flatnonzero(np.diff(cell, prepend=-1))
    sums, filled = np.zeros(int(cells.sum()), np.uint64), np.zeros(int(cells.sum()), bool)
    if len(starts):
        sums[cell[starts]], filled[cell[starts]] = np.add.reduceat(mixed, starts), True
    sums, filled = sums.reshape(-1, SECOND), filled.reshape(-1, SECOND)
    owner = np.repeat(np.arange(len(of)), parts)
    number = (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)).astype(np.uint64)
    salt = number * _A + band[owner].astype(np.uint64) * _C
    sigs, entries, agree = [], [], least.copy()
    for turn, kept in enumerate(combinations(range(SECOND), SECOND - DIRTY)):
        some = filled[:, kept].any(axis=1)
        whole = sums[:, kept[0]].copy()
        for part in kept[1:]:
            whole += sums[:, part]
        sigs.append(_mix((whole[some] ^ salt[some]) + np.uint64(turn + 1)))
        entries.append(owner[some])
        agree -= np.bincount(owner[~some], minlength=len(of))
    normal = sum(map(len, sigs))
    weak = np.repeat(agree < 1, size)
    sigs.append(_mix(mixed[weak] ^ (_C + np.repeat(band, size)[weak].astype(np.uint64))))
    entries.append(np.repeat(np.arange(len(of)), size)[weak])
    single = np.zeros(normal + len(sigs[-1]), bool)
    single[normal:] = True
    return of, agree, np.concatenate(sigs), np.concatenate(entries).astype(np.int32), single


def rarest(signed: Signed, sizes: np.ndarray, met: np.ndarray, blocks_with: np.ndarray) -> np.ndarray:
    """The signatures that go on: of those that others have (``met``), the rarest that partners cannot all miss.

    A weak set's signatures by parts all go on, since its partners cut theirs by their
    own need; two weak partners share NUM / DEN of their shingles at least.
    """
    at = np.flatnonzero(met)
    entry, single = signed.entry[at], signed.single[at]
    weak = signed.need < 1
    least = np.where(single, -(-NUM * sizes[signed.set[entry]] // DEN), np.where(weak[entry], 1, signed.need[entry]))
    group = 2 * entry + single
    order = np.lexsort((signed.sig[at], blocks_with[at], group))
    group, least = group[order], least[order]
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    count = np.diff(np.append(starts, len(group)))
    place = np.arange(len(group)) - np.repeat(starts, count)
    return at[order[place <= np.repeat(count, count) - least]]


class Block:
    """The different sets of a block, with their signatures.

    Texts that stand in a smaller block (``found``) leave their signatures to that block.
    """

    def __init__(self, packed: pa.Table, found: pa.Table | None = None):
        rows = blocks.unpack(packed)
        ids, texts = rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()
        self.texts, at = np.unique(np.array([xxhash.xxh3_64_intdigest(t) for t in texts], np.uint64), return_inverse=True)
        if found is None:
            return
        copied = blocks.answers_in(found, 0, "?")
        self.rows, self.sets, known = [], {}, _Words()
        seen: dict[int, tuple[int, int]] = {}
        for doc_id, text, k in zip(ids, texts, at.tolist(), strict=True):
            if k not in seen:
                if len(known) > REMEMBERED:
                    known.clear()
                one = shingles(text, known)
                seen[k] = class_of(one), len(one)
                if len(one) and not copied[k]:
                    self.sets.setdefault(seen[k][0], one)
            self.rows.append((doc_id, *seen[k]))
        del texts, known
        self.sizes = np.array([len(x) for x in self.sets.values()], np.int64)
        self.signed = Signed(np.concatenate([*self.sets.values(), np.empty(0, np.uint64)]), self.sizes)


def _candidates(docs: DataFrame) -> DataFrame:
    """Rows of three kinds: 0 documents, 1 signatures that go on, 2 sets that have such."""
    base = blocks.with_blocks(docs)
    count = blocks.buckets(docs)
    grouped = base.groupBy("block")

    def zero(rows: pa.Table) -> pa.Table:
        return blocks.send(rows.column("block")[0].as_py(), Block(rows).texts, count)

    def first(rows: pa.Table, found: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return blocks.send(0, np.empty(0, np.uint64), count, 6)
        return release(blocks.send(rows.column("block")[0].as_py(), np.unique(Block(rows, found).signed.sig), count, 6))

    def second(rows: pa.Table, found: pa.Table) -> pa.Table:
        held = Block(rows, found)
        signed = held.signed
        _, inverse, here = np.unique(signed.sig, return_inverse=True, return_counts=True)
        there = blocks.answers_in(found, 1, "u1")
        chosen = rarest(signed, held.sizes, ((here > 1) | (there > 1))[inverse], there[inverse])
        classes = np.fromiter(held.sets, np.int64, len(held.sets))
        owners = signed.set[signed.entry[chosen]]
        out = np.unique(owners)
        sets = list(held.sets.values())
        ids, own, sizes = zip(*held.rows, strict=True) if held.rows else ((), (), ())
        rows_of = lambda kind, many, **columns: pa.table([pa.array(np.full(many, kind, np.int32)), *(columns.get(k, pa.nulls(many, t)) for k, t in KINDS.items())], names=["kind", *KINDS])
        return release(pa.concat_tables([
            rows_of(0, len(ids), doc_id=pa.array(ids, pa.int64()), cls=pa.array(own, pa.int64()), n=pa.array(sizes, pa.int32())),
            rows_of(1, len(chosen), cls=pa.array(classes[owners]), sig=pa.array(signed.sig[chosen].view(np.int64))),
            rows_of(2, len(out), cls=pa.array(classes[out]), n=pa.array(held.sizes[out].astype(np.int32)), shingles=pa.array([sets[i].tobytes() for i in out], pa.binary())),
        ]))

    texts = grouped.applyInArrow(zero, blocks.SENT).groupBy("bucket").applyInArrow(lambda r: blocks.meet(r, blocks.in_smaller, "?"), blocks.SENT)
    known = texts.withColumn("round", F.lit(0))
    sent = grouped.cogroup(known.groupBy("block")).applyInArrow(first, blocks.SENT)
    met = sent.groupBy("bucket").applyInArrow(lambda r: blocks.meet(r, blocks.how_many, "u1", 6), blocks.SENT)
    known = known.unionByName(met.withColumn("round", F.lit(1)))
    return grouped.cogroup(known.groupBy("block")).applyInArrow(second, FOUND)


def sketches(sets: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """Parity of each set's shingles by bit: two sketches differ in no more bits than their sets in shingles."""
    bits = 64 << max(0, int(np.median(sizes)).bit_length() - 4)
    out = np.zeros((len(sets), bits), np.uint8)
    for row, x in zip(out, sets, strict=True):
        row += (np.bincount((x & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(out, axis=1).view(np.uint64)


def search(sets: list[np.ndarray], labels: np.ndarray, centres: np.ndarray, others: np.ndarray | None = None, every: bool = False):
    """Linked pairs (places in ``sets``), of centres with ``others`` (None: with the centres after them).

    Without ``every``, only pairs that join what ``labels`` holds apart; labels are merged on the way.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    sketch = sketches(sets, sizes) if len(sets) > 8 else None
    pairs: list[tuple[int, int]] = []
    for turn, c in enumerate(centres):
        near = centres[turn + 1 :] if others is None else others[others != c]
        near = near[(DEN * np.minimum(sizes[near], sizes[c]) >= NUM * np.maximum(sizes[near], sizes[c])) & (every | (labels[near] != labels[c]))]
        if sketch is not None:
            differ = np.bitwise_count(sketch[near] ^ sketch[c]).sum(1, dtype=np.int64)
            near = near[differ * (DEN + NUM) <= (DEN - NUM) * (sizes[near] + sizes[c])]
        for a, b in slices(sizes[near].tolist(), AT_ONCE):
            some = near[a:b]
            flat = np.concatenate([sets[i] for i in some])
            hit = sets[c][np.minimum(np.searchsorted(sets[c], flat), sizes[c] - 1)] == flat
            both = np.add.reduceat(hit, np.cumsum(sizes[some]) - sizes[some], dtype=np.int64)
            linked = some[DEN * both >= NUM * (sizes[some] + sizes[c] - both)]
            if every:
                pairs += [(int(c), int(x)) for x in linked]
                continue
            new, first = np.unique(labels[linked], return_index=True)
            apart = new != labels[c]
            pairs += [(int(c), int(x)) for x in linked[first[apart]]]
            if apart.any():
                labels[np.isin(labels, new[apart])] = labels[c]
        if not every and others is None and pairs and (labels == labels[0]).all():
            break
    return pairs


def _members(rows: pa.Table):
    """Classes, labels and sets of each group in a chunk, each class once."""
    if not rows.num_rows:
        return
    comp, cls, label = (rows.column(k).to_numpy() for k in ("comp", "cls", "label"))
    order = np.lexsort((cls, comp))
    new = np.diff(cls[order], prepend=cls[order[:1]] - 1) != 0
    new |= np.diff(comp[order], prepend=comp[order[:1]] - 1) != 0
    order = order[new]
    held = rows.column("shingles").combine_chunks()
    starts = np.flatnonzero(np.diff(comp[order], prepend=comp[order[:1]] - 1))
    for a, b in zip(starts, np.append(starts, len(order))[1:], strict=True):
        at = order[a:b]
        yield int(comp[at[0]]), cls[at], label[at], [np.frombuffer(held[int(i)].as_buffer(), np.uint64) for i in at]


def _least(labels: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """For each row, the least of the marks of the rows that have its label."""
    _, inverse = np.unique(labels, return_inverse=True)
    out = np.full(inverse.max(initial=-1) + 1, np.iinfo(np.int64).max)
    np.minimum.at(out, inverse, marks)
    return out[inverse]


def _within(placed: DataFrame) -> DataFrame:
    """comp, cls, label and joined (least label it is linked with) within each chunk, a row for each class."""

    def run(rows: pa.Table) -> pa.Table:
        out = [(np.empty(0, np.int64),) * 4]
        for comp, cls, label, sets in _members(rows):
            merged = label.copy()
            search(sets, merged, np.arange(len(sets)))
            out.append((np.full(len(cls), comp), cls, label, _least(merged, label)))
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["comp", "cls", "label", "joined"])

    return placed.groupBy("group", "part").applyInArrow(run, "comp long, cls long, label long, joined long")


def _across(cells: DataFrame) -> DataFrame:
    """a, b: labels that are linked between the two sides of a cell (``open``: those held against the others)."""

    def run(rows: pa.Table) -> pa.Table:
        left, right = (list(_members(rows.filter(pc.equal(rows.column("open"), side)))) for side in (True, False))
        found: set[tuple[int, int]] = set()
        if left and right:
            (_, _, one, p), (_, _, two, q) = left[0], right[0]
            label = np.concatenate([one, two])
            pairs = search(p + q, label.copy(), np.arange(len(p)), np.arange(len(p), len(label)))
            found = {(int(label[i]), int(label[j])) for i, j in pairs}
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return cells.groupBy("comp", "c", "d").applyInArrow(run, "a long, b long")


def _groups(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Documents (doc_id, cls, n); sets (cls, n, shingles); groups (cls, comp, chunks: null up to one chunk); chunks of all."""
    found = materialize(_candidates(docs), "candidates")
    rows = found.where("kind = 0").select("doc_id", "cls", "n")
    signed = found.where("kind = 1").select("sig", "cls")
    low = signed.groupBy("sig").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low < high").select("sig", "low")
    # the ends of a set's signatures are joined to the least of them: as connected, and in a large group the same few pairs for all its sets
    ends = signed.join(low, "sig").groupBy("cls").agg(F.collect_set("low").alias("lows")).select(F.explode(F.array_union("lows", F.array("cls"))).alias("a"), F.array_min("lows").alias("b"))
    comps = connected(ends).select(F.col("node").alias("cls"), F.col("label").alias("comp"))
    sets = found.where("kind = 2").select("cls", "n", "shingles")
    size = materialize(sets.select("cls", "n").join(comps, "cls").groupBy("comp").agg(F.sum(F.col("n") * 8 + 64).alias("bytes")), "groups")
    total = size.agg(F.sum("bytes")).first()[0] or 0
    large = size.where(F.col("bytes") > CHUNK).select("comp", F.ceil(F.col("bytes") / CHUNK).cast("int").alias("chunks"))
    return rows, sets, comps.join(large, "comp", "left"), max(1, -(-total // CHUNK))


def _part(key: str, count) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(1)), count).cast("int")


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, cls, n), and every linked pair of different classes (a < b), checked by whole sets.

    Rows of one class are linked with each other besides. No pair is left out for being
    in one component already, so a group of many alike gives the square of its classes.
    """
    rows, sets, groups, usual = _groups(docs)
    placed = sets.join(groups, "cls").withColumn("group", F.when(F.col("chunks").isNull(), -1).otherwise(F.col("comp")))
    own, other = _part("cls", F.col("chunks")), F.explode(F.sequence(F.lit(0), F.coalesce(F.col("chunks"), F.lit(1)) - 1))
    placed = placed.withColumn("own", F.when(F.col("chunks").isNull(), _part("comp", F.lit(usual))).otherwise(own)).withColumn("other", other)
    other = F.when(F.col("chunks").isNull(), F.col("own")).otherwise(F.col("other"))
    placed = placed.select("group", "comp", "cls", F.lit(0).cast("long").alias("label"), "shingles", "own", F.least("own", other).alias("c"), F.greatest("own", other).alias("d"))

    def run(held: pa.Table) -> pa.Table:
        c, d = held.column("c")[0].as_py(), held.column("d")[0].as_py()
        found: list[tuple[int, int]] = []
        sides = [held] if c == d else [held.filter(pc.equal(held.column("own"), x)) for x in (c, d)]
        if c == d:
            for _, cls, label, p in _members(held):
                found += [(cls[i], cls[j]) for i, j in search(p, label, np.arange(len(p)), every=True)]
        elif all(side.num_rows for side in sides):
            (_, x, _, p), (_, y, _, q) = (next(_members(side)) for side in sides)
            cls, at = np.concatenate([x, y]), len(p)
            found += [(cls[i], cls[j]) for i, j in search(p + q, np.zeros(len(cls), np.int64), np.arange(at), np.arange(at, len(cls)), every=True)]
        return pa.table({"a": pa.array([min(p) for p in found], pa.int64()), "b": pa.array([max(p) for p in found], pa.int64())})

    return rows, placed.groupBy("group", "c", "d").applyInArrow(run, "a long, b long")


def join(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, cls, n), and the component of each class that may have links (cls, label)."""
    rows, sets, groups, usual = _groups(docs)
    groups = materialize(groups, "places")
    placed = sets.join(groups, "cls").select("comp", "cls", F.col("cls").alias("label"), "shingles", F.when(F.col("chunks").isNull(), -1).otherwise(F.col("comp")).alias("group"), F.when(F.col("chunks").isNull(), _part("comp", F.lit(usual))).otherwise(_part("cls", F.col("chunks"))).alias("part"))
    local = materialize(_within(placed).select("comp", "cls", F.col("joined").alias("label")), "within")
    if groups.where("chunks IS NOT NULL").isEmpty():
        return rows, local.select("cls", "label")
    large = local.join(groups.where("chunks IS NOT NULL").select("cls", "chunks"), "cls")

    def merged(members: DataFrame, found: DataFrame) -> DataFrame:
        """``members`` with labels joined by ``found`` (a, b)."""
        to = connected(found).select(F.col("node").alias("label"), F.col("label").alias("to"))
        return members.join(to, "label", "left").withColumn("label", F.coalesce("to", "label")).drop("to")

    # two representatives of each chunk's component, held against each other
    ends = large.groupBy("comp", "label").agg(F.min("cls").alias("p"), F.max("cls").alias("q"), F.first("chunks").alias("chunks"))
    counts = ends.groupBy("comp").agg(F.count("*").alias("components"))
    sizes = large.groupBy("comp").agg(F.count("*").alias("members"))
    share = F.ceil(F.least(F.lit(1.0), 2 * F.col("components") / F.col("members")) * F.col("chunks"))  # about CHUNK bytes
    ends = ends.join(counts, "comp").join(sizes, "comp").select("comp", "label", F.explode(F.array_distinct(F.array("p", "q"))).alias("cls"), F.col("comp").alias("group"), _part("label", share).alias("part"))
    found = materialize(_within(ends.join(sets.select("cls", "shingles"), "cls")).where("label <> joined").select(F.col("label").alias("a"), F.col("joined").alias("b")).distinct(), "links")
    large = materialize(merged(large, found), "large")

    # whatever is outside its group's largest component, against each chunk
    count = large.groupBy("comp", "label").agg(F.count("*").alias("members"))
    largest = count.groupBy("comp").agg(F.max(F.struct("members", "label")).alias("top"), F.sum("members").alias("members"))
    largest = largest.select("comp", F.col("top.label").alias("top"), F.col("members"), (F.col("members") - F.col("top.members")).alias("outside")).where("outside > 0")
    spread = F.ceil(F.col("outside") / F.col("members") * F.col("chunks")).cast("int")  # chunks of those outside
    every = large.join(largest, "comp").select("comp", "cls", "label", "chunks", "top", spread.alias("spread"))
    held = every.select("comp", "cls", "label", F.lit(False).alias("open"), _part("cls", F.col("chunks")).alias("c"), F.explode(F.sequence(F.lit(0), F.col("spread") - 1)).alias("d"))
    outside = every.where("label <> top").select("comp", "cls", "label", F.lit(True).alias("open"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("c"), _part("cls", F.col("spread")).alias("d"))
    more = materialize(_across(held.unionByName(outside).join(sets.select("cls", "shingles"), "cls")).distinct(), "links")
    local = local.select("cls", "label").join(merged(large, more).select("cls", F.col("label").alias("wider")), "cls", "left")
    return rows, local.select("cls", F.coalesce("wider", "label").alias("label"))


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    rows, labels = join(docs)
    classes = rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"))
    classes = classes.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    whole = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = classes.join(whole, "label").select("cls", "component_id")
    return rows.join(classes, "cls", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r(doc, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc),
c AS (SELECT doc, min(root) AS component_id FROM r GROUP BY doc)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc = d.doc_id
"""
