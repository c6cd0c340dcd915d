"""Stations to municipalities, and readings spread through wider and wider regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardspark.functions.storage import written
from hazardspark.functions.text import normalise

LEVELS = ["municipio", "regiao_imediata", "regiao_intermediaria", "uf"]
MEANS = ["chuva_total_mm", "dias_com_chuva", "temperatura_media_c", "umidade_media_pct"]
PEAKS = ["chuva_max_dia_mm", "rajada_max_kmh"]


def match(stations: DataFrame, towns: DataFrame) -> DataFrame:
    """``stations`` with the codigo_ibge of their municipality: of equal name, or else of
    the longest name that begins the station's; null if none does."""
    named = stations.withColumn("nome_busca", normalise(F.col("estacao")))
    known = towns.select(F.col("codigo_ibge").alias("_code"), F.col("nome_busca").alias("_name"), F.col("uf").alias("_uf"))
    equal = known.groupBy("_name", "_uf").agg(F.min("_code").alias("_equal"))
    rows = named.join(equal, (F.col("nome_busca") == F.col("_name")) & (F.col("uf") == F.col("_uf")), "left").drop("_name", "_uf")
    # a name's beginnings at its blanks are few: each is an equi-join key, not a theta join
    words = F.split("nome_busca", " ")
    starts = rows.where("_equal IS NULL").select("estacao", "uf", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: F.array_join(F.slice(words, 1, i), " "))).alias("_name"), "nome_busca")
    starts = starts.where(F.length("_name") < F.length("nome_busca")).join(known.withColumnRenamed("_uf", "uf"), ["_name", "uf"])
    best = Window.partitionBy("estacao", "uf").orderBy(F.length("_name").desc(), "_code")
    prefix = starts.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("estacao", "uf", F.col("_code").alias("_prefix"))
    return rows.join(prefix, ["estacao", "uf"], "left").withColumn("codigo_ibge", F.coalesce("_equal", "_prefix")).drop("_equal", "_prefix")


def spread(months: DataFrame, matched: DataFrame, towns: DataFrame) -> DataFrame:
    """Monthly climate of every municipality that any level serves, with its source; an error if none does.

    Whether a level serves a municipality is decided over all months; the state's level
    takes every station of the state, matched or not. All four levels are rolled up at
    once and written; the level of a municipality is then a matter of the keys alone.
    """
    places = towns.select("codigo_ibge", _keys(towns).alias("_keys"))
    own = months.join(matched.select("estacao", "uf", "codigo_ibge").distinct(), ["estacao", "uf"], "left")
    own = own.join(towns.select("codigo_ibge", "regiao_imediata", "regiao_intermediaria"), "codigo_ibge", "left")
    each = own.withColumn("_k", F.explode(_keys(own))).where("_k.chave IS NOT NULL")
    rolled = each.groupBy("_k", "ano", "mes").agg(*(F.avg(c).alias(c) for c in MEANS), *(F.max(c).alias(c) for c in PEAKS), F.countDistinct("estacao", "uf").alias("estacoes_usadas"))
    rolled = written(rolled, "levels")
    if rolled.isEmpty():
        raise ValueError("no station serves a municipality or a state")
    served = places.withColumn("_k", F.explode("_keys")).join(rolled.select("_k").distinct(), "_k").groupBy("codigo_ibge").agg(F.min("_k").alias("_k"))
    return served.join(rolled, "_k").withColumn("fonte_clima", F.element_at(F.lit(LEVELS), F.col("_k.nivel"))).drop("_k")


def _keys(rows: DataFrame) -> Column:
    """A row's key at each level, the narrowest first."""
    keys = ("codigo_ibge", "regiao_imediata", "regiao_intermediaria", "uf")
    return F.array(*(F.struct(F.lit(i).alias("nivel"), F.col(k).cast("string").alias("chave")) for i, k in enumerate(keys, 1)))


def unserved(climate: DataFrame, towns: DataFrame) -> DataFrame:
    """How many municipalities no level serves."""
    return towns.join(climate.select("codigo_ibge").distinct(), "codigo_ibge", "left_anti").agg(F.count("*").alias("sem_clima"))


def coverage(matched: DataFrame, towns: DataFrame) -> DataFrame:
    """Stations, unmatched ones, and municipalities that each level of matched stations reaches."""
    hit = matched.where("codigo_ibge IS NOT NULL").select("codigo_ibge").distinct().join(towns, "codigo_ibge")
    counts = matched.agg(F.count("*").alias("estacoes"), F.count_if(F.col("codigo_ibge").isNull()).alias("sem_municipio"))
    total = towns.agg(F.count("*").alias("total_municipios"))
    out = counts.crossJoin(total)  # one row each
    for level in ("codigo_ibge", "regiao_imediata", "regiao_intermediaria", "uf"):
        name = "municipio" if level == "codigo_ibge" else level
        out = out.crossJoin(towns.join(hit.select(level).distinct(), level, "left_semi").agg(F.count("*").alias(f"via_{name}")))  # one row each
    return out


def sources(climate: DataFrame) -> DataFrame:
    """Rows and share of each source."""
    n = climate.groupBy("fonte_clima").agg(F.count("*").alias("n"))
    return n.withColumn("fracao", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))  # over four rows
