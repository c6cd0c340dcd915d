"""Occurrences by month, labels, and the sampled dataset of described months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardspark.functions.months import month_index, month_of, year_of
from hazardspark.operators import history

SERIES = ["codigo_ibge", "grupo_desastre"]


def by_month(occurrences: DataFrame) -> DataFrame:
    """One row for each municipality, group and month: flags by any, damages by sum."""
    names = [F.min(c).alias(c) for c in ("municipio", "uf", "regiao")]
    sums = [F.sum(c).alias(c) for c in ("mortos", "afetados", "prejuizo")]
    rows = occurrences.groupBy("codigo_ibge", "grupo_desastre", "ano", "mes").agg(*names, F.bool_or("reconhecido").alias("reconhecido"), *sums)
    return rows.withColumn("indice_mes", month_index(F.col("ano"), F.col("mes")))


def risk(recognised: Column, deaths: Column, occurred: Column | None = None) -> Column:
    """alto: recognised or with deaths; medio: any other occurrence; baixo: none."""
    level = F.when(recognised | (deaths > 0), "alto").otherwise("medio")
    return level if occurred is None else F.when(occurred, level).otherwise("baixo")


def identity(monthly: DataFrame) -> DataFrame:
    """Each municipality's latest names."""
    latest = F.max_by(F.struct("municipio", "uf", "regiao"), F.struct("indice_mes", "grupo_desastre")).alias("v")
    return monthly.groupBy("codigo_ibge").agg(latest).select("codigo_ibge", "v.municipio", "v.uf", "v.regiao")


def free_months(monthly: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Months of the period without an occurrence, of every series that has one in the period."""
    if first_year > last_year:
        raise ValueError("the period is empty")
    inside = monthly.where(F.col("ano").between(first_year, last_year))
    months = F.sequence(F.lit((first_year - 1900) * 12), F.lit((last_year - 1900) * 12 + 11))
    every = inside.select(*SERIES).distinct().withColumn("indice_mes", F.explode(months))
    return every.join(inside.select(*SERIES, "indice_mes"), [*SERIES, "indice_mes"], "left_anti")


def sample(rows: DataFrame, size: int, seed: int, keys: list[str]) -> DataFrame:
    """Exactly ``size`` rows (or all), the first by the hash of seed and keys.

    No global sort: rows are counted by the hash's first four digits, all rows below the
    digits in which the last one falls are in, and only among those is there an order.
    """
    hashed = rows.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))).withColumn("_d", F.substring("_h", 1, 4))
    counts = sorted((r["_d"], r["count"]) for r in hashed.groupBy("_d").count().collect())  # at most 65 536 rows
    before, edge = 0, None
    for digits, n in counts:
        if before + n > size:
            edge = digits
            break
        before += n
    if edge is None:
        return hashed.drop("_h", "_d")
    order = Window.partitionBy("_d").orderBy("_h", *keys)
    last = hashed.where(F.col("_d") == edge).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= size - before).drop("_n")
    return hashed.where(F.col("_d") < edge).unionByName(last).drop("_h", "_d")


def build(occurrences: DataFrame, first_year: int = 2010, last_year: int = 2025, ratio: int = 3, seed: int = 42) -> DataFrame:
    """The labelled dataset: months with an occurrence and sampled months without one."""
    monthly = by_month(occurrences)
    inside = monthly.where(F.col("ano").between(first_year, last_year))
    positives = inside.select(*SERIES, "indice_mes", "reconhecido", "mortos", F.lit(True).alias("houve"))
    if (n := positives.count()) == 0:
        raise ValueError("no occurrence in the period")
    free = sample(free_months(monthly, first_year, last_year), ratio * n, seed, [*SERIES, "indice_mes"])
    targets = positives.unionByName(free.select(*SERIES, "indice_mes", F.lit(False).alias("reconhecido"), F.lit(0.0).alias("mortos"), F.lit(False).alias("houve")))
    rows = history.features(monthly, targets)
    rows = rows.withColumn("nivel_risco", risk(F.col("reconhecido"), F.col("mortos"), F.col("houve"))).drop("reconhecido", "mortos", "houve")
    rows = rows.join(identity(monthly), "codigo_ibge", "left")
    return rows.withColumns({"ano": year_of(F.col("indice_mes")), "mes": month_of(F.col("indice_mes"))})
