"""Meeting of keys between ranges of a corpus, two small shuffles instead of one large one.

A corpus is cut into blocks: ranges of doc_id of about equal bytes, found from splitters
of rows drawn by their bytes; a doc_id (or null) whose rows fill a block and more is a
range of its own, dealt row by row to several blocks. Texts travel there compressed. A block's distinct keys (64-bit hashes) are sorted and sent in buckets by
their leading bits, one binary row for each block and bucket. Where a bucket's rows
meet, each key learns of the same key in other blocks, and the answer goes back as an
array in the order of the keys sent. A key that a third of all documents share is sent
once by each block, so no bucket is hot and no pair of documents is ever formed.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardspark.llm.common import kept, materialize, partitions

#: Bytes of text in a block.
BLOCK = 8 << 20
#: Rows drawn for each block, to find splitters; low bits of a block's number, those above number its range.
DRAWN, PART = 256, 12
MOST = (1 << 63) - 1
SENT = "block long, bucket int, sent binary"


def block_of(key: Column, splitters: list[int]) -> Column:
    """How many splitters are at most ``key``, by halving; null keys go last."""
    if not splitters:
        return F.lit(0)
    levels = len(splitters).bit_length()
    padded = F.lit(list(splitters) + [MOST] * ((1 << levels) - len(splitters)))
    steps = F.array(*(F.lit(1 << b) for b in reversed(range(levels))))
    found = F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.element_at(padded, low + step) <= key, low + step).otherwise(low))
    return F.when(key.isNull(), F.lit(len(splitters))).otherwise(found)


def with_blocks(docs: DataFrame, size: int = BLOCK, carried: list[str] = ()) -> DataFrame:
    """block and packed: doc_id, text (null: empty) and the carried columns (see ``unpack``)."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), *carried)
    weight = F.octet_length("text") + 16
    total, least = docs.agg(F.sum(weight), F.min("doc_id")).first()
    count = max(1, -(-(total or 0) // size))
    if count == 1:
        return _packed(docs.withColumn("block", F.lit(0).cast("long")))
    times = F.floor(weight * (DRAWN / size) + F.rand(7)).cast("int")
    drawn = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.explode(F.array_repeat(F.lit(0), times)))
    several = drawn.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("row").alias("a"), F.max("row").alias("b")).where((F.col("n") >= DRAWN) & (F.col("a") < F.col("b")))
    heavy = {r.doc_id: min(-(-r.n // DRAWN), 1 << PART) for r in several.collect()}  # fewer than blocks
    cuts = [i / count for i in range(1, count)]
    splitters = {int(x) for x in drawn.where("doc_id IS NOT NULL").approxQuantile("doc_id", cuts, 0.1 / count)} if least is not None else set()
    splitters |= {x for h in heavy if h is not None for x in (h, h + 1) if x < MOST}
    ordered = sorted(splitters)
    number = block_of(F.col("doc_id"), ordered).cast("long")  # 64 bits: ranges and parts of 100 TB fit
    if not heavy:
        return _packed(docs.withColumn("block", F.shiftleft(number, PART)))
    number = F.when(F.col("doc_id").isNull(), len(ordered) + 1).otherwise(number)
    parts = F.coalesce(*(F.when(F.col("doc_id").eqNullSafe(F.lit(h)), n) for h, n in heavy.items()), F.lit(1))
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), parts).cast("int")
    # rows dealt by their place must not be dealt anew: these blocks are written once
    return materialize(_packed(docs.withColumn("block", F.shiftleft(number, PART) + part)), "blocks")


def _packed(rows: DataFrame) -> DataFrame:
    """Each task's rows of a block as one compressed stream of Arrow batches: block, packed."""

    def run(batches):
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            numbers = batch.column("block").to_numpy()
            order = np.argsort(numbers, kind="stable")
            cuts = np.flatnonzero(np.concatenate([[True], np.diff(numbers[order]) != 0])) if len(order) else []
            out: list[tuple[int, bytes]] = []
            for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
                part = batch.take(pa.array(order[a:b], pa.int64()))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=options) as stream:
                    stream.write_batch(part)
                out.append((int(numbers[order[a]]), sink.getvalue().to_pybytes()))
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], names=["block", "packed"])

    return rows.mapInArrow(run, "block long, packed binary")


def unpack(rows: pa.Table) -> pa.Table:
    """The rows of a block: doc_id, text, the carried columns and block; none without rows."""
    kept(None, None)  # what other operators left in this worker
    parts = [pa.ipc.open_stream(x).read_all() for x in rows.column("packed").to_pylist()]
    return pa.concat_tables(parts) if parts else pa.table({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string()), "block": pa.array([], pa.int64())})


def buckets(docs: DataFrame) -> int:
    return 4 * partitions(docs.sparkSession)


def _ends(keys: np.ndarray, count: int) -> np.ndarray:
    leading = (keys >> np.uint64(40)) * np.uint64(count) >> np.uint64(24)
    return np.searchsorted(leading, np.arange(count + 1, dtype=np.uint64))


def send(block: int, keys: np.ndarray, count: int, width: int = 8) -> pa.Table:
    """The rows that carry a block's sorted distinct keys, each in ``width`` bytes."""
    raw = np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])
    ends = _ends(keys, count)
    full = [b for b in range(count) if ends[b] < ends[b + 1]]
    return pa.table({"block": pa.array([block] * len(full), pa.int64()), "bucket": pa.array(full, pa.int32()), "sent": pa.array([raw[ends[b] : ends[b + 1]].tobytes() for b in full], pa.binary())})


def meet(rows: pa.Table, answer: Callable, dtype: str, width: int = 8) -> pa.Table:
    """``answer(keys, blocks, starts)``: over keys sorted by key and block, the result of each.

    Blocks stand there by their place among the blocks of this bucket, in 4 bytes for each key.
    """
    places = np.unique(rows.column("block").to_numpy(), return_inverse=True)[1].astype(np.int32)
    sent = rows.column("sent").to_pylist()
    sizes = np.array([len(s) // width for s in sent])
    raw = np.zeros((int(sizes.sum()), 8), np.uint8)
    raw[:, :width] = np.frombuffer(b"".join(sent), np.uint8).reshape(-1, width)
    keys, owners = raw.reshape(-1).view("<u8"), np.repeat(places, sizes)
    order = np.lexsort((owners, keys))
    ordered = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.empty(0, np.int64)
    out = np.empty(len(keys), dtype)
    out[order] = answer(ordered, owners[order], starts)
    at = np.concatenate([[0], np.cumsum(sizes)])
    answers = [out[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)]
    return pa.table({"block": rows.column("block"), "bucket": rows.column("bucket"), "sent": pa.array(answers, pa.binary())})


def how_many(keys: np.ndarray, blocks: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """In how many blocks each key is (255: that many or more)."""
    counts = np.diff(np.append(starts, len(keys)))
    return np.repeat(np.minimum(counts, 255), counts)


def in_smaller(keys: np.ndarray, blocks: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether each key is in a block of smaller number."""
    out = np.ones(len(keys), bool)
    out[starts] = False
    return out


def answers_of(met: pa.Table) -> list[np.ndarray]:
    """One-byte answers of each row of a bucket."""
    return [np.frombuffer(x, np.uint8) for x in met.column("sent").to_pylist()]


def answers(rows: pa.Table, dtype: str) -> np.ndarray:
    """What came back for a block, in the order of its sorted keys."""
    parts = sorted(zip(rows.column("bucket").to_pylist(), rows.column("sent").to_pylist(), strict=True))
    return np.frombuffer(b"".join(p for _, p in parts), dtype)


def answers_in(found: pa.Table, number: int, dtype: str) -> np.ndarray:
    """``answers`` of the rows of one round."""
    return answers(found.filter(pc.equal(found.column("round"), number)), dtype)
