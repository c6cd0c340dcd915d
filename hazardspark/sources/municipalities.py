"""The list of municipalities, from nested JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardspark.functions.text import normalise

SCHEMA = """id long, nome string,
`regiao-imediata` struct<id: long, `regiao-intermediaria`: struct<id: long, UF: struct<id: long, sigla: string>>>,
microrregiao struct<mesorregiao: struct<UF: struct<id: long, sigla: string>>>"""


def read(spark: SparkSession, path: str) -> DataFrame:
    """codigo_ibge, municipio, nome_busca, uf and both regions; a state must be found for all."""
    raw = spark.read.schema(SCHEMA).json(path, multiLine=True)
    near = F.col("`regiao-imediata`")
    rows = raw.select(
        F.col("id").alias("codigo_ibge"), F.col("nome").alias("municipio"), normalise(F.col("nome")).alias("nome_busca"),
        F.coalesce(near["regiao-intermediaria"]["UF"]["sigla"], F.col("microrregiao.mesorregiao.UF.sigla")).alias("uf"),
        near["id"].alias("regiao_imediata"), near["regiao-intermediaria"]["id"].alias("regiao_intermediaria"),
    )
    if n := rows.where("uf IS NULL").count():
        raise ValueError(f"{n} municipalities have no state")
    return rows
