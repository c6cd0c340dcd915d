"""Prepared tables: reading behind the checks, writing by year, replacing what is new by its own keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardspark import contract
from hazardspark.operators import quality


def read_dataset(spark: SparkSession, path: str, checked: bool = True, with_target: bool = True) -> DataFrame:
    """A prepared CSV by the contract's types; errors of the checks stop it."""
    raw = spark.read.csv(path, header=True)
    if checked:
        errors = quality.validate(raw, with_target).where("severidade = 'erro'").collect()
        if errors:
            raise ValueError("; ".join(f"{e.check} {e.coluna} {e.detalhe} ({e.n})" for e in errors))
    known = {f.name: f.dataType for f in contract.dataset_schema()}
    return raw.select(*(F.col(c).cast(known[c]) if c in known else F.col(c) for c in raw.columns))


def write_dataset(rows: DataFrame, path: str, csv: bool = False) -> None:
    """Ordered by year, month and municipality; Parquet by year, or CSV."""
    ordered = rows.repartitionByRange("ano", "mes").sortWithinPartitions("ano", "mes", "codigo_ibge")
    if csv:
        ordered.write.mode("overwrite").csv(path, header=True)
    else:
        ordered.write.mode("overwrite").partitionBy("ano").parquet(path)


#: Each kept table: what it is replaced by, and the order of its rows within.
KEPT = {
    "ocorrencias": (("ano",), ("mes", "codigo_ibge", "grupo_desastre")),
    "clima_mensal": (("ano", "mes"), ()),
    "normais": (("mes",), ()),
}


def replace_partitions(rows: DataFrame, path: str, keys: tuple[str, ...], order: tuple[str, ...] = ()) -> None:
    """Write ``rows`` in place of the partitions of ``path`` that they have rows of; all others stay.

    Files are staged apart and partitions change when the job commits: a job that fails, or
    loses executors, leaves the table as it was. Of a partition a reader gets all old or all
    new files; a reader whose files went while it read has an error, never a mixture. A
    partition of any size is written by several tasks. Rows without a key are a partition of
    their own; ``rows`` without rows replace nothing. ``rows`` may be read from ``path``
    itself only where it was written out before.
    """
    dealt = rows.repartitionByRange(*keys, *order, F.xxhash64(*rows.columns)).sortWithinPartitions(*keys, *order)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_kept(rows: DataFrame, path: str, table: str) -> None:
    """Replace by its own keys: cleaned occurrences by year, monthly climate by month, normals by calendar month."""
    replace_partitions(rows, path, *KEPT[table])


def read_kept(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A kept table with the types and column order of ``like``."""
    return spark.read.schema(like.schema).parquet(path).select(*like.columns)
