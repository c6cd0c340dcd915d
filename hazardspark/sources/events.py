"""The register of disaster events: reading and cleaning."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardspark import contract
from hazardspark.functions.text import from_cp850, title_case


def newest(paths: list[str]) -> str:
    """The file whose name sorts last."""
    if not paths:
        raise FileNotFoundError("no register file")
    return max(paths, key=lambda p: p.rsplit("/", 1)[-1])


def read_register(spark: SparkSession, path: str) -> DataFrame:
    """The columns needed of a register file (code page 850, ``;``), as text."""
    raw = spark.read.csv(path, sep=";", header=True, encoding="iso-8859-1")
    if missing := [c for c in contract.REGISTER_COLUMNS if c not in raw.columns]:
        raise ValueError(f"the register lacks the columns {missing}")
    return raw.select(*(from_cp850(F.col(c)).alias(c) for c in contract.REGISTER_COLUMNS))


def number(c: Column) -> Column:
    return F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast("double")


def damage(c: Column) -> Column:
    """A loss: nothing or less than nothing is 0."""
    return F.greatest(F.coalesce(number(c), F.lit(0.0)), F.lit(0.0))


def clean(raw: DataFrame) -> DataFrame:
    """Occurrences: typed columns, known groups, valid dates and codes alone."""
    groups = F.create_map(*map(F.lit, chain.from_iterable(contract.TYPOLOGIES.items())))
    day = F.try_to_date("Data_Evento", "dd/MM/yyyy")
    rows = raw.select(
        number(F.col("Cod_IBGE_Mun")).cast("long").alias("codigo_ibge"), F.col("Nome_Municipio").alias("municipio"), F.upper(F.trim("Sigla_UF")).alias("uf"),
        title_case(F.col("regiao")).alias("regiao"), F.year(day).alias("ano"), F.month(day).alias("mes"), groups[F.col("descricao_tipologia")].alias("grupo_desastre"),
        F.coalesce(F.col("Status") == contract.RECOGNISED, F.lit(False)).alias("reconhecido"), damage(F.col("DH_MORTOS")).alias("mortos"),
        damage(F.col("DH_total_danos_humanos_diretos")).alias("afetados"), damage(F.col("PE_PLePR")).alias("prejuizo"),
    )
    return rows.where("ano IS NOT NULL AND grupo_desastre IS NOT NULL AND codigo_ibge IS NOT NULL")
