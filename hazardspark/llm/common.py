"""What the operators of this subpackage share: tables, shared storage, let-bindings."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local session (tests) gets a temporary folder; a cluster is
    refused, since a machine-local folder would lose data there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = tempfile.mkdtemp(prefix="spark-shared-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    The lineage ends there, so a lost executor costs a reread and not a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """``body`` over ``value``, with ``value`` computed once for each row."""
    return F.transform(F.array(value), body)[0]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release(result):
    """``result``, after what a task has freed went back to the system: workers are reused, and would hold it."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)
    return result


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # other C libraries
    _trim = None


_kept: dict = {}


def kept(key, make):
    """What a worker keeps between tasks, of one operator at a time; None drops it."""
    if key not in _kept:
        if _kept:
            _kept.clear()
            release(None)
        if key is None:
            return None
        _kept[key] = make()
    return _kept[key]


def slices(sizes, limit: int):
    """(start, stop) of consecutive rows whose sizes add up to about ``limit``."""
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)
