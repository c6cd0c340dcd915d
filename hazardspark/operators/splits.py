"""Splits of a dataset, by time and at random."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def three(rows: DataFrame, validation: int, test: int) -> DataFrame:
    """``rows`` with parte: treino, validacao or teste by year; an empty part is an error."""
    if validation >= test:
        raise ValueError("validation must begin before test")
    out = rows.withColumn("parte", F.when(F.col("ano") < validation, "treino").when(F.col("ano") < test, "validacao").otherwise("teste"))
    if out.select("parte").distinct().count() < 3:
        raise ValueError("a part of the split is empty")
    return out


def two(rows: DataFrame, test: int = 2022) -> DataFrame:
    return rows.withColumn("parte", F.when(F.col("ano") < test, "treino").otherwise("teste"))


def windows(rows: DataFrame, least: int = 8, last: int | None = None) -> DataFrame:
    """Expanding windows: treino_ate, ano_teste, of the years that are there."""
    order = Window.orderBy("ano")  # over distinct years
    years = rows.select("ano").distinct().withColumns({"n": F.row_number().over(order), "antes": F.lag("ano").over(order)})
    found = years.where(F.col("n") > least)
    if found.isEmpty():
        raise ValueError("too few years for a window")
    found = found.select(F.col("antes").alias("treino_ate"), F.col("ano").alias("ano_teste"))
    return found if last is None else found.orderBy(F.desc("ano_teste")).limit(last)


def stratified(rows: DataFrame, share: float, key: list[str], label: str = "nivel_risco", seed: int = 42) -> DataFrame:
    """``rows`` with parte: of each class, teste the first round(share * n) by a hash of the key.

    The order within a class is had in two steps, by the hash's leading digits and within
    those, so that no class is one task.
    """
    hashed = rows.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in key)))).withColumn("_d", F.substring("_h", 1, 3))
    counts = hashed.groupBy(label, "_d").agg(F.count("*").alias("_n"))
    by = Window.partitionBy(label)  # over at most 4096 counts a class
    counts = counts.withColumns({"_before": F.sum("_n").over(by.orderBy("_d")) - F.col("_n"), "_all": F.sum("_n").over(by)})
    ranked = hashed.join(F.broadcast(counts), [label, "_d"]).withColumn("_r", F.row_number().over(Window.partitionBy(label, "_d").orderBy("_h", *key)) + F.col("_before"))
    test = F.col("_r") <= F.round(F.col("_all") * share)
    return ranked.withColumn("parte", F.when(test, "teste").otherwise("treino")).drop("_h", "_d", "_n", "_before", "_all", "_r")
