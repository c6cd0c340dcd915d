"""Checks, cleaning, gates, provenance, meshes and the entry point."""

import hashlib
import importlib
import json

import pytest
from pyspark.sql import functions as F

from hazardspark import contract
from hazardspark.operators import directory, quality
from hazardspark.sources import geo, provenance, tables


@pytest.fixture()
def good(spark):
    base = {r.name: 1.0 for r in contract.NUMERIC} | {"uf": "RJ", "regiao": "Sudeste", "grupo_desastre": "GRANIZO", "municipio": "Cidade"}
    rows = [base | {"codigo_ibge": 1000000 + i, "ano": 2000 + i % 20, "mes": float(i % 12 + 1), "nivel_risco": contract.CLASSES[i % 3]} for i in range(60)]
    return spark.createDataFrame(rows).select(contract.REQUIRED)


def found(rows):
    return {(r.check, r.coluna, r.severidade): (r.n, r.detalhe) for r in quality.validate(rows).collect()}


def test_checks(good):
    assert found(good) == {}
    assert ("colunas", "uf", "erro") in found(good.drop("uf"))
    assert found(good.withColumn("extra", F.lit(1)))[("colunas", "extra", "aviso")] == (1, "a mais")
    assert found(good.limit(0))[("linhas", "", "erro")][0] == 1
    bad = good.withColumn("nivel_risco", F.when(F.col("codigo_ibge") == 1000000, "altissimo").otherwise(F.col("nivel_risco")))
    assert found(bad)[("alvo_invalido", "nivel_risco", "erro")][0] == 1
    bad = good.withColumn("uf", F.when(F.col("codigo_ibge") % 2 == 0, "ZZ").otherwise(F.col("uf")))
    assert found(bad)[("fora_do_dominio", "uf", "aviso")] == (1, "ZZ")
    assert found(good.union(good.limit(4)))[("repetidas", "codigo_ibge,ano,mes,grupo_desastre", "aviso")][0] == 4
    assert found(good.withColumn("ocorrencias_12m", F.lit(201.0)))[("acima_do_maximo", "ocorrencias_12m", "aviso")][0] == 60
    assert found(good.withColumn("ocorrencias_12m", F.lit("muito")))[("nao_numerico", "ocorrencias_12m", "erro")][0] == 60
    assert found(good.withColumn("municipio", F.lit(None).cast("string")))[("nulos", "municipio", "aviso")] == (60, "mais de 30%")
    assert found(good.withColumn("temperatura_mes_anterior_c", F.lit(None).cast("double"))) == {}
    assert found(good.where("nivel_risco <> 'alto'"))[("classe_ausente", "nivel_risco", "erro")] == (1, "alto")
    few = good.where("nivel_risco <> 'alto' OR codigo_ibge < 1000009")
    assert found(few)[("classe_rara", "nivel_risco", "aviso")] == (3, "alto")


def test_dataset_file(spark, good, tmp_path):
    tables.write_dataset(good, str(tmp_path / "csv"), csv=True)
    back = tables.read_dataset(spark, str(tmp_path / "csv"))
    assert back.count() == 60 and dict(back.dtypes)["codigo_ibge"] == "bigint"
    tables.write_dataset(good, str(tmp_path / "parquet"))
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 60
    good.drop("uf").coalesce(1).write.csv(str(tmp_path / "bad"), header=True)
    with pytest.raises(ValueError):
        tables.read_dataset(spark, str(tmp_path / "bad"))


def test_partitions_are_replaced_by_their_own_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(y, m, i, float(i)) for y in (2020, 2021, None) for m in (1, 2) for i in range(50)], "ano int, mes int, k int, v double")
    tables.replace_partitions(rows, path, ("ano", "mes"), ("k",))
    read = lambda: {(r.ano, r.mes): (r.n, r.s) for r in tables.read_kept(spark, path, rows).groupBy("ano", "mes").agg(F.count("*").alias("n"), F.sum("v").alias("s")).collect()}
    first = read()
    assert len(first) == 6 and set(first.values()) == {(50, 1225.0)}
    tables.replace_partitions(rows.where("ano = 2021 AND mes = 2 AND k < 3").withColumn("v", F.lit(7.0)), path, ("ano", "mes"))
    assert read() == first | {(2021, 2): (3, 21.0)}
    tables.replace_partitions(rows.limit(0), path, ("ano", "mes"))
    assert read() == first | {(2021, 2): (3, 21.0)}
    failing = rows.where("ano = 2020").withColumn("v", F.when(F.col("k") == 49, F.raise_error(F.lit("lost")).cast("double")).otherwise(0.0))
    with pytest.raises(Exception, match="lost"):
        tables.replace_partitions(failing, path, ("ano", "mes"))
    assert read() == first | {(2021, 2): (3, 21.0)}
    big = spark.range(20_000).selectExpr("2022 AS ano", "1 AS mes", "CAST(id AS INT) AS k", "1D AS v")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tables.replace_partitions(big, path, ("ano", "mes"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = {r[0] for r in spark.read.parquet(path).where("ano = 2022").select(F.input_file_name()).distinct().collect()}
    assert len(files) > 1 and read()[2022, 1] == (20_000, 20_000.0)


def test_cleaning(spark):
    rows = [(i, 10.0 if i < 8 else None if i == 8 else 1e6, "a" if i % 2 else None) for i in range(10)] + [(0, 10.0, "b")] * 4
    df = spark.createDataFrame(rows, "k int, v double, c string").withColumn("o", F.monotonically_increasing_id())
    got = quality.clean(df, ["v"], ["c"], ["k"], ["o"]).collect()
    assert len(got) == 10 and {r.v for r in got if r.k == 8} == {10.0} and all(r.c is not None for r in got)


def test_gate(spark):
    df = spark.createDataFrame([(1, "RJ", 5.0, -20.0), (2, None, 5.0, None), (3, "??", 500.0, 10.0)], "k int, uf string, ocorrencias_12m double, latitude double")
    rules = [contract.Rule("ocorrencias_12m", 0, 200), contract.Rule("latitude", -34, 6, True)]
    got = {r.k: r.motivos for r in quality.gate(df, ["uf"], rules).collect()}
    assert got == {1: [], 2: ["falta uf"], 3: ["latitude fora da faixa", "ocorrencias_12m fora da faixa"]}


def test_provenance(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.csv").write_text("one")
    files = provenance.hashes(spark, str(tmp_path / "d"))
    assert files.first().hash == hashlib.sha256(b"one").hexdigest()
    entry = provenance.register(files, "real", 10, 2000, 2001)
    entry.write.json(str(tmp_path / "r"))
    (tmp_path / "r" / "broken.json").write_text("{nonsense\n")
    registry = provenance.read_registry(spark, str(tmp_path / "r"))
    assert provenance.identify(files, registry).first().origem == "real"
    (tmp_path / "d" / "a.csv").write_text("other")
    assert provenance.identify(provenance.hashes(spark, str(tmp_path / "d")), registry).first().origem == "desconhecida"
    with pytest.raises(ValueError):
        provenance.register(files, "made up", 1, 1, 1)


def test_mesh_and_points(spark, tmp_path):
    ring = [[-43.12345, -22.98765], [-43.0, -22.0], [-43.12345, -22.98765]]
    features = [{"type": "Feature", "properties": {"codarea": "3303906"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}, {"type": "Feature", "properties": {"codarea": "1"}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}}]
    (tmp_path / "rj.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    mesh = geo.read_mesh(spark, str(tmp_path / "rj.json"))
    got = {r.codigo_ibge: json.loads(r.geometry) for r in mesh.collect()}
    assert got[3303906]["coordinates"][0][0] == [-43.123, -22.988] and len(got[1]["coordinates"]) == 2 and got[1]["type"] == "MultiPolygon"
    scores = spark.createDataFrame([(1, "alto", "#C62828")], "codigo_ibge long, nivel string, cor string")
    assert {r.codigo_ibge: r.nivel for r in geo.mesh_with_scores(mesh, scores).collect()} == {1: "alto", 3303906: "sem-dado"}
    df = spark.createDataFrame([(7, -43.1, -22.5, "alto")], "codigo_ibge long, longitude double, latitude double, nivel string")
    assert json.loads(geo.points(df, ["codigo_ibge", "nivel"]).first().value) == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [-43.1, -22.5]}, "properties": {"codigo_ibge": 7, "nivel": "alto"}}


def test_search(spark):
    df = spark.createDataFrame([(1, "São José", "SP"), (2, "Sao Jorge", "PR"), (3, "Exu", "PE")], "codigo_ibge long, municipio string, uf string")
    first, total = directory.search(df, "sÃo j", None, 1)
    assert first.first().codigo_ibge == 2 and total.first().total == 2
    assert directory.search(df, "sao", "sp")[1].first().total == 1


def test_entry():
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(names) >= 60
    assert "w1_w6_history_features" in names
