"""Features of the past, strictly before the month described.

Events and described months are united for each key and seen through integer range
frames that end one month before; there is no join between events and months.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SERIES = ["codigo_ibge", "grupo_desastre"]
WEIGHTS = {"mortos": "mortos_historico", "afetados": "afetados_historico", "prejuizo": "_prejuizo", "reconhecido": "reconhecimentos_historico"}


def series(monthly: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets`` with counts, sums and distances over the earlier events of their series."""
    carried = [c for c in targets.columns if c not in (*SERIES, "indice_mes")]
    weights = [F.col(c).cast("double").alias(f"_w_{c}") for c in WEIGHTS]
    events = monthly.select(*SERIES, "indice_mes", F.lit(1).alias("_event"), *weights)
    asked = targets.select(*SERIES, "indice_mes", F.lit(0).alias("_event"), F.struct(F.lit(1).alias("_one"), *carried).alias("_carried"))
    rows = events.unionByName(asked, allowMissingColumns=True)
    w = Window.partitionBy(*SERIES).orderBy("indice_mes")
    past = w.rangeBetween(Window.unboundedPreceding, -1)
    count = lambda over: F.coalesce(F.sum("_event").over(over), F.lit(0))
    month = F.when(F.col("_event") == 1, F.col("indice_mes"))
    same = Window.partitionBy(*SERIES, F.pmod("indice_mes", F.lit(12))).orderBy("indice_mes").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns(
        {f"ocorrencias_{k}m": count(w.rangeBetween(-k, -1)) for k in (12, 24, 60)}
        | {"ocorrencias_total_historico": count(past), "_last": F.max(month).over(past), "_first": F.min(month).over(past)}
        | {name: F.coalesce(F.sum(f"_w_{c}").over(past), F.lit(0.0)) for c, name in WEIGHTS.items()}
    ).withColumn("ocorrencias_mesmo_mes_historico", count(same))
    rows = rows.where("_event = 0")
    return rows.select(
        *SERIES, "indice_mes", *(F.col(f"_carried.{c}").alias(c) for c in carried), "ocorrencias_12m", "ocorrencias_24m", "ocorrencias_60m", "ocorrencias_total_historico",
        F.coalesce(F.col("indice_mes") - F.col("_last"), F.lit(-1)).alias("meses_desde_ultima_ocorrencia"), (F.col("ocorrencias_total_historico") > 0).cast("int").alias("ja_ocorreu"),
        F.coalesce((F.col("indice_mes") - F.col("_first")) / 12, F.lit(0.0)).alias("anos_de_historico"), "ocorrencias_mesmo_mes_historico",
        *(n for n in WEIGHTS.values() if n != "_prejuizo"), F.log1p("_prejuizo").alias("prejuizo_historico_log"),
    )


def _recent(events: DataFrame, asked: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Of each distinct key and month asked for, the events of the twelve months before."""
    rows = events.groupBy(*keys, "indice_mes").agg(F.count("*").alias("_n")).unionByName(asked.select(*keys, "indice_mes").distinct(), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("indice_mes").rangeBetween(-12, -1)
    counted = rows.withColumn(name, F.coalesce(F.sum("_n").over(w), F.lit(0)))
    return counted.where("_n IS NULL").drop("_n")


def states(monthly: DataFrame) -> DataFrame:
    """Each municipality's state: that of its first row by group, year and month."""
    return monthly.groupBy("codigo_ibge").agg(F.min_by("uf", F.struct("grupo_desastre", "ano", "mes")).alias("_uf"))


def context(monthly: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets`` with the last twelve months of their municipality, and of their state and group.

    Both are counted on one row for each key and month, never on the targets themselves,
    so a state that holds most targets is no large window.
    """
    town = _recent(monthly, targets, ["codigo_ibge"], "ocorrencias_municipio_12m")
    known = states(monthly)
    rows = targets.join(town, ["codigo_ibge", "indice_mes"], "left").join(known, "codigo_ibge", "left")
    events = monthly.join(known, "codigo_ibge").select("_uf", "grupo_desastre", "indice_mes")
    state = _recent(events, rows.where("_uf IS NOT NULL"), ["_uf", "grupo_desastre"], "ocorrencias_uf_grupo_12m")
    rows = rows.join(state, ["_uf", "grupo_desastre", "indice_mes"], "left").drop("_uf")
    return rows.withColumn("ocorrencias_uf_grupo_12m", F.coalesce("ocorrencias_uf_grupo_12m", F.lit(0)))


def features(monthly: DataFrame, targets: DataFrame) -> DataFrame:
    return context(monthly, series(monthly, targets))
