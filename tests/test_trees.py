"""The forest as a relation, against the forest."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from hazardspark.operators import trees, training
from tests.test_selection import SCHEMA, rows_of


@pytest.fixture(scope="module")
def fitted(spark):
    rows = spark.createDataFrame(rows_of(), SCHEMA).withColumn("k", F.monotonically_increasing_id())
    model = training.Forest.fit(rows.where("ano < 2022"), 7, 6, 2, numeric=["x1", "mes"], categorical=["grupo_desastre", "regiao"])
    return rows, model, trees.nodes(model, spark)


def test_nodes_are_trees(fitted):
    _, model, table = fitted
    rows = table.collect()
    assert len(rows) == model.model.totalNumNodes and {r.arvore for r in rows} == set(range(7))
    by = {(r.arvore, r.no): r for r in rows}
    for r in rows:
        assert (r.esquerda is None) == (r.direita is None) == (r.variavel is None) and sum(r.votos) == pytest.approx(1)
        if r.esquerda is not None:
            kids = by[r.arvore, r.esquerda], by[r.arvore, r.direita]
            assert sum(k.peso for k in kids) == pytest.approx(r.peso) and (r.limiar is None) != (r.categorias is None)
            assert r.ganho > 0 and r.impureza > 0
    assert {r.variavel for r in rows} <= {"x1", "mes", "grupo_desastre", "regiao", None}


def test_votes_equal_transform(fitted):
    rows, model, table = fitted
    odd = rows.where("ano >= 2022").withColumn("x1", F.when(F.col("k") % 3 > 0, F.col("x1"))).withColumn("grupo_desastre", F.when(F.col("k") % 5 > 0, F.col("grupo_desastre")).otherwise("NEVER"))
    own = model.model.transform(model.encoding.transform(model.filled(odd))).select("k", vector_to_array("rawPrediction").alias("own"))
    both = trees.votes(model, table, odd, ["k"]).join(own, "k").collect()
    assert len(both) == 160 and all(r.votos == pytest.approx(r.own, abs=1e-9) for r in both)
    assert trees.leaves(model, table, odd, ["k"]).join(table.where("esquerda IS NULL"), trees.PLACE).count() == 160 * 7


def test_importance_equals_the_models(fitted):
    _, model, table = fitted
    own = {r.variavel: r.importancia for r in model.importance().collect() if r.importancia}
    found = {r.variavel: r.importancia for r in trees.importance(table).collect()}
    assert set(found) == set(own) and all(found[v] == pytest.approx(own[v], abs=1e-9) for v in own) and sum(found.values()) == pytest.approx(1)


def test_trees_without_a_split(spark):
    rows = spark.createDataFrame(rows_of(each=6), SCHEMA).withColumns({"k": F.monotonically_increasing_id(), "x1": F.lit(1.0), "grupo_desastre": F.lit("EROSAO")})
    model = training.Forest.fit(rows, 2, 3, 2, numeric=["x1"], categorical=["grupo_desastre"])
    table = trees.nodes(model, spark)
    assert table.count() == 2 and trees.importance(table).count() == 0
    assert {round(sum(r.votos), 9) for r in trees.votes(model, table, rows, ["k"]).collect()} == {2.0}


def test_shares_of_a_fit():
    assert training.shares(100, 20, 5, 117_000, 8) == ([12, 13, 12, 13, 12, 13, 12, 13], 1)
    assert training.shares(100, 20, 5, 900_000, 8) == ([25] * 4, 2)
    assert training.shares(100, 20, 5, 9_000_000, 8) == ([100], 8) and training.shares(10, 6, 5, 117_000, 8) == ([10], 8)


def test_forests_side_by_side_are_one(spark, tmp_path, monkeypatch):
    """Seven trees in four fits, met in many small groups of trees and rows."""
    monkeypatch.setattr(training, "FEW", 0)
    monkeypatch.setattr(trees, "NODES", 20)
    monkeypatch.setattr(trees, "ROWS", 30)
    rows = spark.createDataFrame(rows_of(), SCHEMA).withColumn("k", F.monotonically_increasing_id())
    model = training.Forest.fit(rows.where("ano < 2022"), 7, 6, 2, numeric=["x1", "mes"], categorical=["grupo_desastre", "regiao"])
    assert [p.getNumTrees for p in model.model.parts] == [1, 2, 2, 2]
    table, tried = trees.nodes(model, spark), rows.where("ano >= 2022")
    assert table.count() == model.model.totalNumNodes and table.select("arvore").distinct().count() == 7
    own = model.model.transform(model.encoding.transform(model.filled(tried))).select("k", *(vector_to_array(c).alias(c) for c in ("rawPrediction", "probability")), "prediction")
    both = trees.votes(model, table, tried, ["k"]).join(own, "k").collect()
    assert len(both) == 160 and all(r.votos == pytest.approx(r.rawPrediction, abs=1e-9) and sum(r.probability) == pytest.approx(1) for r in both)
    assert all(r.rawPrediction[int(r.prediction)] == max(r.rawPrediction) for r in both)
    summed = {r.variavel: r.importancia for r in trees.importance(table).collect()}
    assert {r.variavel: r.importancia for r in model.importance().collect() if r.importancia} == pytest.approx(summed, abs=1e-9)
    model.save(str(tmp_path / "m"))
    again = training.Forest.load(spark, str(tmp_path / "m"))
    said = lambda m: {r.k: (r.previsto, r.probability.toArray().tolist()) for r in m.transform(tried).collect()}
    assert said(again) == said(model) and len(again.model.parts) == 4
    assert trees.leaves(model, table, tried, ["k"]).join(table.where("esquerda IS NULL"), trees.PLACE).count() == 160 * 7


def test_nodes_that_list_categories():
    table = pa.table({"arvore": [3, 3, 3], "no": [0, 1, 2], "posicao": pa.array([1, None, None], pa.int32()), "limiar": pa.array([None] * 3, pa.float64()), "categorias": pa.array([[0.0, 4.0], None, None], pa.list_(pa.float64())), "esquerda": pa.array([1, None, None], pa.int32()), "direita": pa.array([2, None, None], pa.int32())})
    (tree, no, here), = trees._paths(table, np.array([[9.0, 4.0], [0.0, 1.0], [0.0, 0.0], [4.0, np.nan]]))
    assert tree == 3 and no[here].tolist() == [1, 2, 1, 2]
