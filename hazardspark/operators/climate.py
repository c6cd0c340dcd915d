"""Hourly readings to monthly climate, and the climate known before a month."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardspark.functions.months import month_index, month_of, previous_month

MISSING, WET, KMH, VALID = -9998.0, 1.0, 3.6, 0.5
NORMAL = (2000, 2009)
#: Monthly measure -> its name in the dataset, one month later.
BEFORE = {
    "chuva_total_mm": "chuva_mes_anterior_mm", "chuva_max_dia_mm": "chuva_max_dia_mes_anterior_mm", "dias_com_chuva": "dias_com_chuva_mes_anterior",
    "temperatura_media_c": "temperatura_mes_anterior_c", "umidade_media_pct": "umidade_mes_anterior_pct", "rajada_max_kmh": "rajada_mes_anterior_kmh",
}


def without_sentinel(readings: DataFrame, columns: tuple[str, ...] = ("precipitacao", "temperatura", "umidade", "rajada")) -> DataFrame:
    """Missing values as null; rain is at least 0 where there is any."""
    kept = {c: F.when(F.col(c) > MISSING, F.col(c).cast("double")) for c in columns}
    kept["precipitacao"] = F.when(F.col("precipitacao") > MISSING, F.greatest(F.col("precipitacao").cast("double"), F.lit(0.0)))
    return readings.withColumns(kept)


def daily(readings: DataFrame, keys: list[str]) -> DataFrame:
    """Each key's days: rain (0 where there is none), sums and counts of the means, strongest gust, hours."""
    return readings.groupBy(*keys, F.to_date("data").alias("dia")).agg(
        F.coalesce(F.sum("precipitacao"), F.lit(0.0)).alias("chuva"), F.sum("precipitacao").alias("chuva_ou_nada"), F.sum("temperatura").alias("t"), F.count("temperatura").alias("tn"),
        F.sum("umidade").alias("u"), F.count("umidade").alias("un"), F.max("rajada").alias("rajada"), F.count("*").alias("horas"), F.count("precipitacao").alias("validas"),
    )


def monthly(readings: DataFrame, station: list[str] = ("estacao", "uf", "codigo_estacao")) -> DataFrame:
    """Monthly measures of each station: first by day, then by month, one shuffle for both."""
    keys = [*station, "ano", "mes"]
    rows = readings.withColumns({"ano": F.year("data"), "mes": F.month("data")})
    rolled = daily(rows, keys).groupBy(*keys).agg(
        F.coalesce(F.sum("chuva_ou_nada"), F.lit(0.0)).alias("chuva_total_mm"), F.max("chuva").alias("chuva_max_dia_mm"), F.count_if(F.col("chuva") >= WET).alias("dias_com_chuva"),
        (F.sum("t") / F.nullif(F.sum("tn"), F.lit(0))).alias("temperatura_media_c"), (F.sum("u") / F.nullif(F.sum("un"), F.lit(0))).alias("umidade_media_pct"),
        (F.max("rajada") * KMH).alias("rajada_max_kmh"), F.sum("horas").alias("horas_registradas"), F.sum("validas").alias("horas_validas"),
    )
    return rolled.withColumn("fracao_valida", F.col("horas_validas") / F.greatest("horas_registradas", F.lit(1)))


def sound(months: DataFrame, least: float = VALID) -> tuple[DataFrame, DataFrame]:
    """Months with enough valid hours, and a row that counts kept and discarded ones."""
    kept = months.where(F.col("fracao_valida") >= least)
    return kept, months.agg(F.count_if(F.col("fracao_valida") >= least).alias("mantidos"), F.count_if(F.col("fracao_valida") < least).alias("descartados"))


def normals(months: DataFrame, keys: list[str], first: int = NORMAL[0], last: int = NORMAL[1]) -> DataFrame:
    """Mean rain of each calendar month in the reference years."""
    inside = months.where(F.col("ano").between(first, last))
    return inside.groupBy(*keys, "mes").agg(F.avg("chuva_total_mm").alias("chuva_normal_mm"), F.countDistinct("ano").alias("anos_na_normal"))


def known_before(targets: DataFrame, climate: DataFrame, normal: DataFrame | None = None) -> DataFrame:
    """``targets`` with the climate of the months before, their rain against the normal.

    Climate and targets are seen together through range frames by municipality, so gaps
    in the months are gaps in the frames; a municipality has few months, whatever the
    number of targets, and the targets join the frames' rows of distinct months.
    """
    held = [*BEFORE.values(), "chuva_3_meses_anteriores_mm", "anomalia_chuva_pct", "meses_de_clima_disponiveis"]
    targets = targets.drop(*held)
    asked = targets.select("codigo_ibge", "indice_mes").distinct()
    readings = climate.select("codigo_ibge", month_index(F.col("ano"), F.col("mes")).alias("indice_mes"), *(F.col(c).cast("double").alias(c) for c in BEFORE), F.lit(True).alias("_read"))
    w = Window.partitionBy("codigo_ibge").orderBy("indice_mes")
    one, three = w.rangeBetween(-1, -1), w.rangeBetween(-3, -1)
    rows = readings.unionByName(asked, allowMissingColumns=True).withColumns(
        {name: F.max(c).over(one) for c, name in BEFORE.items()}
        | {"chuva_3_meses_anteriores_mm": F.sum("chuva_total_mm").over(three), "meses_de_clima_disponiveis": F.count("chuva_total_mm").over(three)}
    )
    rows = rows.where("_read IS NULL").select("codigo_ibge", "indice_mes", *BEFORE.values(), "chuva_3_meses_anteriores_mm", "meses_de_clima_disponiveis")
    if normal is None:
        rows = rows.withColumn("anomalia_chuva_pct", F.lit(None).cast("double"))
    else:
        rows = rows.withColumn("_mes", previous_month(month_of(F.col("indice_mes"))))
        rows = rows.join(normal.select("codigo_ibge", F.col("mes").alias("_mes"), "chuva_normal_mm"), ["codigo_ibge", "_mes"], "left")
        usable = F.col("chuva_mes_anterior_mm").isNotNull() & (F.col("chuva_normal_mm") > 0) & (F.col("chuva_normal_mm") < float("inf"))
        gap = (F.col("chuva_mes_anterior_mm") / F.col("chuva_normal_mm") - 1) * 100
        rows = rows.withColumn("anomalia_chuva_pct", F.when(usable, F.least(F.greatest(gap, F.lit(-100.0)), F.lit(500.0)))).drop("_mes", "chuva_normal_mm")
    return targets.join(rows, ["codigo_ibge", "indice_mes"], "left").withColumn("meses_de_clima_disponiveis", F.coalesce("meses_de_clima_disponiveis", F.lit(0)))


def coverage(rows: DataFrame) -> DataFrame:
    """How many rows know rain, anomaly and all three months."""
    return rows.agg(
        F.count("*").alias("linhas"), F.count("chuva_mes_anterior_mm").alias("com_chuva"), F.count("anomalia_chuva_pct").alias("com_anomalia"),
        F.round(F.count("chuva_mes_anterior_mm") / F.greatest(F.count("*"), F.lit(1)), 4).alias("fracao_com_chuva"), F.count_if(F.col("meses_de_clima_disponiveis") == 3).alias("com_tres_meses"),
    )
