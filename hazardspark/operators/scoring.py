"""Scores in bulk: shaping, requests, the country map and the season's profile."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazardspark import contract
from hazardspark.functions.months import month_index, month_of, year_of
from hazardspark.operators import climate as climate_
from hazardspark.operators import features, history, metrics, monthly
from hazardspark.sources import tables

ASKED = 1200
MAP_KEYS = ("grupo_desastre", "ano", "mes")
MAP_SCHEMA = "codigo_ibge long, municipio string, uf string, nivel string, prob_baixo double, prob_medio double, prob_alto double, cor string, grupo_desastre string, ano int, mes int"
MAP = [f.split()[0] for f in MAP_SCHEMA.split(", ")]


def shape(rows: DataFrame, probability: Column | None = None) -> DataFrame:
    """prob_baixo, prob_medio, prob_alto to four places, the level of the largest (ties: the
    milder class), its probability and colour. Ties go by class order everywhere."""
    p = vector_to_array("probability") if probability is None else probability
    rows = rows.withColumns({f"prob_{c}": F.round(p[i], 4) for i, c in enumerate(contract.CLASSES)})
    low, mid, high = (F.col(f"prob_{c}") for c in contract.CLASSES)
    level = F.when((low >= mid) & (low >= high), "baixo").when(mid >= high, "medio").otherwise("alto")
    colours = F.create_map(*[F.lit(x) for pair in contract.COLOURS.items() for x in pair])
    return rows.withColumn("nivel", level).withColumns({"confianca": F.greatest(low, mid, high), "cor": colours[F.col("nivel")]})


def requested(occurrences: DataFrame, requests: DataFrame, climate: DataFrame | None = None) -> DataFrame:
    """Features of (codigo_ibge, grupo_desastre, ano, mes), by the same function as the dataset's.

    Requests for a municipality without any history are left out.
    """
    months = monthly.by_month(occurrences)
    names = monthly.identity(months)
    targets = requests.withColumn("indice_mes", month_index(F.col("ano"), F.col("mes"))).join(names, "codigo_ibge")
    rows = history.features(months, targets)
    if climate is None:
        empty = {c: F.lit(None).cast("double") for c in (r.name for r in contract.CLIMATE)}
        rows = rows.withColumns({**empty, "meses_de_clima_disponiveis": F.lit(0)})
    else:
        rows = climate_.known_before(rows, climate, climate_.normals(climate, ["codigo_ibge"]))
    return features.derive(rows)


def country(occurrences: DataFrame, months: DataFrame) -> DataFrame:
    """Requests of every municipality for every group it has a history of, at the months (ano, mes) given.

    The months are at most ``ASKED``, as values of the plan: more are an error.
    """
    asked = sorted({(r["ano"], r["mes"]) for r in months.select("ano", "mes").where("ano IS NOT NULL AND mes BETWEEN 1 AND 12").distinct().limit(ASKED + 1).collect()})
    if len(asked) > ASKED:
        raise ValueError(f"more than {ASKED} months are asked for at once")
    known = occurrences.select("codigo_ibge", "grupo_desastre").distinct()
    if not asked:
        return known.select("*", F.lit(0).alias("ano"), F.lit(0).alias("mes")).where("false")
    each = F.array(*(F.struct(F.lit(y).cast("int").alias("ano"), F.lit(m).cast("int").alias("mes")) for y, m in asked))
    return known.select("*", F.inline(each))


def season(pairs: DataFrame, year: int) -> DataFrame:
    """Requests for the twelve months of a year of each (codigo_ibge, grupo_desastre)."""
    return pairs.withColumns({"ano": F.lit(year), "mes": F.explode(F.sequence(F.lit(1), F.lit(12)))})


def scored(model, rows: DataFrame) -> DataFrame:
    """``rows`` with the model's shaped scores, for a vector or an array of probabilities."""
    out = model.transform(rows)
    return shape(out, None if dict(out.dtypes)["probability"] == "vector" else F.col("probability")).drop("probability", "previsto")


def write_map(model, occurrences: DataFrame, months: DataFrame, path: str, climate: DataFrame | None = None) -> None:
    """The scored map of every group at every month asked for, written by group and month.

    One batch of requests, features and scores for all maps. A map that was written before
    is replaced; the rows of a large group are dealt over tasks by municipality.
    """
    rows = scored(model, requested(occurrences, country(occurrences, months), climate))
    typed = [F.col(n).cast(t).alias(n) for n, t in (f.split() for f in MAP_SCHEMA.split(", "))]  # a model may hold its inputs as doubles
    tables.replace_partitions(rows.select(*typed), path, MAP_KEYS, ("codigo_ibge",))


def read_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MAP_SCHEMA).parquet(path).select(*MAP)


def map_summary(maps: DataFrame) -> DataFrame:
    """Municipalities of each level, and in all, by map."""
    counts = metrics.levels(maps, list(MAP_KEYS), "nivel")
    return counts.withColumn("total", reduce(lambda a, b: a + b, (F.col(c) for c in contract.CLASSES)))


def season_profile(model, occurrences: DataFrame, year: int, climate: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """The twelve months of a year of each (codigo_ibge, grupo_desastre), scored in one batch.

    altura: the probability of alto over the year's largest (0.01 at least); pico: whether
    it is that one.
    """
    pairs = (occurrences if pairs is None else pairs).select("codigo_ibge", "grupo_desastre").distinct()
    rows = scored(model, requested(occurrences, season(pairs, year), climate))
    most = F.max("prob_alto").over(Window.partitionBy("codigo_ibge", "grupo_desastre"))  # twelve rows
    rows = rows.withColumns({"altura": F.col("prob_alto") / F.greatest(most, F.lit(0.01)), "pico": F.col("prob_alto") == most})
    return rows.select("codigo_ibge", "grupo_desastre", F.col("ano").cast("int").alias("ano"), F.col("mes").cast("int").alias("mes"), "nivel", *(f"prob_{c}" for c in contract.CLASSES), "altura", "pico")


def calendar(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"ano": year_of(F.col("indice_mes")), "mes": month_of(F.col("indice_mes"))})
