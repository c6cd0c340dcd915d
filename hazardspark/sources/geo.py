"""Boundary meshes and scored points as GeoJSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RING = "array<array<double>>"
MESH = "type string, features array<struct<type: string, properties: struct<codarea: string>, geometry: struct<type: string, coordinates: string>>>"


def _rounded(ring: Column, places: int) -> Column:
    return F.transform(ring, lambda point: F.transform(point, lambda x: F.round(x, places)))


def read_mesh(spark: SparkSession, path: str, places: int = 3) -> DataFrame:
    """codigo_ibge and geometry (JSON text, coordinates rounded) of every feature of every state's file."""
    features = spark.read.schema(MESH).json(path, multiLine=True).select(F.explode("features").alias("f"))
    kind, raw = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    single = F.transform(F.from_json(raw, f"array<{RING}>"), lambda ring: _rounded(ring, places))
    many = F.transform(F.from_json(raw, f"array<array<{RING}>>"), lambda polygon: F.transform(polygon, lambda ring: _rounded(ring, places)))
    shape = F.when(kind == "MultiPolygon", F.to_json(F.struct(kind.alias("type"), many.alias("coordinates")))).otherwise(F.to_json(F.struct(kind.alias("type"), single.alias("coordinates"))))
    return features.select(F.col("f.properties.codarea").cast("long").alias("codigo_ibge"), shape.alias("geometry"))


def mesh_with_scores(mesh: DataFrame, scores: DataFrame) -> DataFrame:
    """Every polygon with its score's level and colour; polygons without are ``sem-dado``."""
    rows = mesh.join(scores.select("codigo_ibge", "nivel", "cor"), "codigo_ibge", "left")
    return rows.withColumns({"nivel": F.coalesce("nivel", F.lit("sem-dado")), "cor": F.coalesce("cor", F.lit("#BDBDBD"))})


def points(scored: DataFrame, properties: list[str]) -> DataFrame:
    """A GeoJSON feature (text) for each scored row, coordinates as longitude, latitude."""
    place = F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates"))
    return scored.select(F.to_json(F.struct(F.lit("Feature").alias("type"), place.alias("geometry"), F.struct(*properties).alias("properties"))).alias("value"))
