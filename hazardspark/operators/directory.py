"""Summaries of the dataset and the register, for all municipalities at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardspark.functions.text import strip_accents


def profile(rows: DataFrame) -> DataFrame:
    """Years, municipalities and states of a dataset; one row."""
    return rows.agg(F.count("*").alias("linhas"), F.min("ano").alias("ano_inicial"), F.max("ano").alias("ano_final"), F.countDistinct("codigo_ibge").alias("municipios"), F.countDistinct("uf").alias("ufs"))


def shares(rows: DataFrame, column: str) -> DataFrame:
    """Rows and share of each value of a column."""
    n = rows.groupBy(column).agg(F.count("*").alias("n"))
    return n.withColumn("fracao", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))  # over distinct values


def municipalities(occurrences: DataFrame) -> DataFrame:
    """Last names and number of occurrences of each municipality."""
    last = F.max_by(F.struct("municipio", "uf", "regiao"), F.struct("ano", "mes", "municipio")).alias("v")
    return occurrences.groupBy("codigo_ibge").agg(last, F.count("*").alias("ocorrencias")).select("codigo_ibge", "v.municipio", "v.uf", "v.regiao", "ocorrencias")


def past(occurrences: DataFrame) -> DataFrame:
    """Occurrences, deaths, affected and last year of each municipality and group, with its rank."""
    rows = occurrences.groupBy("codigo_ibge", "grupo_desastre").agg(F.count("*").alias("ocorrencias"), F.sum("mortos").alias("mortos"), F.sum("afetados").alias("afetados"), F.max("ano").alias("ultimo_ano"))
    return rows.withColumn("posicao", F.row_number().over(Window.partitionBy("codigo_ibge").orderBy(F.desc("ocorrencias"), "grupo_desastre")))


def totals(occurrences: DataFrame) -> DataFrame:
    return occurrences.groupBy("codigo_ibge").agg(F.count("*").alias("total"), F.min("ano").alias("primeiro_ano"), F.max("ano").alias("ultimo_ano"))


def search(directory: DataFrame, part: str | None = None, state: str | None = None, limit: int = 500) -> tuple[DataFrame, DataFrame]:
    """Municipalities whose name holds ``part`` (marks and case aside): the first by state and name, and how many."""
    rows = directory if state is None else directory.where(F.col("uf") == state.upper())
    if part:
        rows = rows.where(F.contains(F.lower(strip_accents(F.col("municipio"))), F.lower(strip_accents(F.lit(part)))))
    return rows.orderBy("uf", "municipio", "codigo_ibge").limit(limit), rows.agg(F.count("*").alias("total"))


def positive_rate(rows: DataFrame) -> DataFrame:
    """Share of months with an occurrence, by municipality and group."""
    return rows.groupBy("codigo_ibge", "grupo_desastre").agg(F.avg((F.col("nivel_risco") != "baixo").cast("double")).alias("taxa"))
