"""Intermediate tables in the folder that every executor sees."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a local session gets a temporary folder and a cluster is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = tempfile.mkdtemp(prefix="spark-shared-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def fresh(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` written as Parquet and read back: computed once, and lineage ends here."""
    path = fresh(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def put(files: DataFrame, folder: str) -> None:
    """(path, content) as single files under ``folder``, each written by the task that holds its row; a file gets its name when it is whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder if "://" in folder else folder.removeprefix("file:"))
        made, n = set(), 0
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                place, _, name = f"{root}/{path}".rpartition("/")
                if place not in made:
                    system.create_dir(place, recursive=True)
                    made.add(place)
                unready = f"{place}/.{name}-{uuid.uuid4().hex}"  # readers pass over names that begin so
                with system.open_output_stream(unready) as out:
                    out.write(content.as_buffer())
                system.move(unready, f"{place}/{name}")
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    files.select("path", "content").mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()
