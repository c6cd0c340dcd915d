"""Splits, measures, choice, forests, odds ratios and scores, against known numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazardspark import contract
from hazardspark.operators import features, frequency, inference, metrics, scoring, selection, splits, training


@pytest.fixture(scope="module")
def yearly(spark):
    rng = np.random.default_rng(3)
    rows = []
    for year in range(2010, 2026):
        for i in range(60):
            level = contract.CLASSES[i % 3]
            rows.append((i, year, i % 12 + 1, "GRANIZO", float(i % 3 + rng.normal(0, 0.3)), float(rng.normal()), level))
    return spark.createDataFrame(rows, "codigo_ibge long, ano int, mes int, grupo_desastre string, x1 double, x2 double, nivel_risco string").persist()


def fit(rows, trees=5, depth=4, leaf=2, seed=42):
    return training.Forest.fit(rows, trees, depth, leaf, seed, numeric=["x1", "x2"], categorical=["grupo_desastre"])


def test_windows_and_parts(yearly):
    w = sorted(map(tuple, splits.windows(yearly).collect()))
    assert w == [(y, y + 1) for y in range(2017, 2025)]
    assert sorted(map(tuple, splits.windows(yearly, last=3).collect())) == w[-3:]
    with pytest.raises(ValueError):
        splits.windows(yearly.where("ano < 2013"))
    parts = {r.parte: r["count"] for r in splits.three(yearly, 2020, 2022).groupBy("parte").count().collect()}
    assert parts == {"treino": 600, "validacao": 120, "teste": 240}
    for cut in ((2022, 2020), (2020, 2050)):
        with pytest.raises(ValueError):
            splits.three(yearly, *cut)


def test_stratified(yearly):
    parts = splits.stratified(yearly, 0.3, ["codigo_ibge", "ano"])
    got = {(r.nivel_risco, r.parte): r["count"] for r in parts.groupBy("nivel_risco", "parte").count().collect()}
    assert got == {(c, p): n for c in contract.CLASSES for p, n in (("teste", 96), ("treino", 224))}


GOLDEN = {"baixo": (30761, 997, 3217), "medio": (4604, 1475, 944), "alto": (3968, 365, 5538)}


def test_measures_of_the_published_matrix(spark):
    rows = [(r, p, n) for r, ns in GOLDEN.items() for p, n in zip(contract.CLASSES, ns, strict=True)]
    counts = spark.createDataFrame(rows, "real string, previsto string, n long")
    s = metrics.summary(counts).first()
    assert [round(x, 4) for x in (s.acuracia, s.acuracia_balanceada, s.f1_macro)] == [0.7283, 0.5502, 0.5644]
    each = {r.classe: r for r in metrics.by_class(counts).collect()}
    assert [round(x, 4) for x in (each["medio"].precisao, each["medio"].recall, each["medio"].f1)] == [0.5199, 0.21, 0.2992]
    assert s.alto_como_baixo == 3968 and s.linhas == 51869 and each["alto"].suporte == 9871
    assert [tuple(r)[2:] for r in metrics.matrix(counts).orderBy("ordem").collect()] == list(GOLDEN.values())
    never = metrics.by_class(spark.createDataFrame([("baixo", "medio", 5)], "real string, previsto string, n long")).collect()
    assert {r.classe: (r.precisao, r.recall, r.f1) for r in never} == {"baixo": (0, 0, 0), "medio": (0, 0, 0)}


def test_published_walk_forward(spark):
    balanced = [0.5843, 0.6420, 0.4738, 0.5440, 0.5815, 0.5580, 0.5303, 0.5870]
    rows = [(2017 + i, 2018 + i, b, b, b) for i, b in enumerate(balanced)]
    s = selection.walk_summary(spark.createDataFrame(rows, "treino_ate int, ano_teste int, acuracia_balanceada double, f1_macro double, recall_alto double")).where("medida = 'f1_macro'").first()
    assert [round(x, 4) for x in (s.media, s.desvio, s.pior)] == [0.5626, 0.0493, 0.4738]


def test_published_choice(spark):
    rows = [(12, 10, 0.5056), (16, 5, 0.5055), (20, 5, 0.5113), (28, 3, 0.5159), (None, 5, 0.5151)]
    df = spark.createDataFrame(rows, "profundidade int, folha int, f1_macro double")
    assert tuple(selection.parsimonious(df).first())[:2] == (20, 5)
    assert selection.parsimonious(df, 1.0).first().profundidade == 12


def test_diagnosis(spark):
    assert [metrics.diagnosis(*x) for x in ((0.9, 0.7), (0.4, 0.35), (0.6, 0.55))] == ["overfitting", "underfitting", "equilibrado"]
    df = spark.createDataFrame([(0.9, 0.7), (0.4, 0.35), (0.6, 0.55)], "treino double, teste double")
    assert [r.diagnostico for r in metrics.diagnose(df).collect()] == ["overfitting", "underfitting", "equilibrado"]
    assert metrics.majority(spark.createDataFrame([("a",), ("a",), ("b",)], "nivel_risco string")).first()[0] == pytest.approx(2 / 3)


def test_forest(spark, yearly, tmp_path):
    train, test = yearly.where("ano < 2022"), yearly.where("ano >= 2022")
    model = fit(train)
    odd = test.withColumn("x2", F.lit(None).cast("double")).withColumn("grupo_desastre", F.lit("NEVER"))
    for rows in (test, odd, test.drop("x2")):
        shaped = scoring.shape(model.transform(rows))
        assert shaped.where("abs(prob_baixo + prob_medio + prob_alto - 1) > 0.001").isEmpty()
    assert training.evaluate(model, test).first().acuracia_balanceada > 0.6
    importance = {r.variavel: r.importancia for r in model.importance().collect()}
    assert sum(importance.values()) == pytest.approx(1) and set(importance) == {"x1", "x2", "grupo_desastre"} and importance["x1"] == max(importance.values())
    facts = training.facts_of(train)
    assert (facts["linhas"], facts["ano_inicial"], facts["ano_final"], facts["grupos"]) == (720, 2010, 2021, ["GRANIZO"]) and facts["classes"] == {c: 240 for c in contract.CLASSES}
    assert training.facts_of(train.orderBy("x1"))["dados_hash"] == facts["dados_hash"] != training.facts_of(train.withColumn("x2", F.col("x2") + 1))["dados_hash"]
    assert training.facts_of(train.limit(0))["linhas"] == 0
    model.save(str(tmp_path / "m"), origem="teste", **facts)
    again = training.Forest.load(spark, str(tmp_path / "m"))
    assert again.facts["origem"] == "teste" and {k: again.facts[k] for k in facts} == facts
    a, b = (sorted((r.codigo_ibge, r.ano, r.previsto, tuple(r.probability)) for r in m.transform(test).collect()) for m in (model, again))
    assert a == b


def test_a_model_of_another_contract_is_refused(spark, yearly, tmp_path, monkeypatch):
    fit(yearly, trees=1).save(str(tmp_path / "m"))
    monkeypatch.setattr(contract, "MODEL_NUMERIC", ["other"])
    with pytest.raises(ValueError):
        training.Forest.load(spark, str(tmp_path / "m"))


def test_derived(spark):
    df = spark.createDataFrame([(3, 0, 0.0, 0.0, 0.0, 1, 3, 2), (12, 4, 2.0, 6.0, 8.0, 1, 3, 2)], "mes int, ocorrencias_total_historico long, anos_de_historico double, reconhecimentos_historico double, afetados_historico double, ocorrencias_12m long, ocorrencias_24m long, ocorrencias_60m long")
    a, b = features.bands(features.derive(df)).orderBy("mes").collect()
    assert (a.ocorrencias_por_ano, a.proporcao_reconhecidas, a.gravidade_media_historica) == (0, 0, 0) and a.mes_seno == pytest.approx(1)
    assert (b.ocorrencias_por_ano, b.proporcao_reconhecidas, b.gravidade_media_historica) == (2, 1, 2)
    assert (b.ocorrencias_13_a_24m, b.ocorrencias_25_a_60m) == (2, 0)


def test_odds_ratio_of_a_two_by_two_table(spark):
    rows = [(float(e), float(y)) for e, y, n in ((1, 1, 500), (1, 0, 500), (0, 1, 200), (0, 0, 800)) for _ in range(n)]
    df = spark.createDataFrame(rows, "exposto double, _event double")
    coefficients, scored = inference.fit(df, ["exposto"], "_event")
    r = inference.table(coefficients, spark).first()
    assert r.odds_ratio == pytest.approx(4, rel=0.02) and r.ic95_inferior < 4 < r.ic95_superior and r.significativo and r.confiavel and r.p_valor < 1e-6
    expected = math.sqrt(1 / 500 + 1 / 500 + 1 / 200 + 1 / 800)
    assert r.erro_padrao == pytest.approx(expected, rel=0.01)
    auc = metrics.auc(scored.withColumn("e", F.col("_event") == 1), "_p", "e").first()[0]
    assert auc == pytest.approx((500 / 700) * (800 / 1300) + 0.5 * ((500 / 700) * (500 / 1300) + (200 / 700) * (800 / 1300)), abs=1e-6)


def test_score_equations_tell_a_fit_from_none(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 3))
    y = rng.random(3000) < 1 / (1 + np.exp(-(x @ [1.0, -0.5, 0.0] - 0.3)))
    df = spark.createDataFrame([(*map(float, r), float(e)) for r, e in zip(x, y, strict=True)], "a double, b double, c double, _event double").repartition(5)
    coefficients, scored = inference.fit(df, ["a", "b", "c"], "_event")
    got = {r.variavel: r for r in inference.score_equations(scored, ["a", "b", "c"], "_event").collect()}
    assert all(abs(got[n].gradiente) < 1e-6 and got[n].erro_padrao == pytest.approx(e, rel=1e-4) for n, _, e in coefficients)
    off = inference.score_equations(scored.withColumn("_p", F.col("_p") * 0.9), ["a", "b", "c"], "_event").collect()
    assert max(abs(r.gradiente) for r in off) > 1e-3


def test_collinear_columns_go(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=400), rng.normal(size=400)
    df = spark.createDataFrame([(float(x), float(y), float(x + e), 1.0) for x, y, e in zip(a, b, rng.normal(0, 0.05, 400), strict=True)], "a double, b double, c double, k double")
    kept, dropped = inference.without_collinear(df, ["a", "b", "c", "k"])
    assert "b" in kept and "k" not in kept and len(kept) == 2
    assert dropped[0] == ("k", math.inf) and dropped[1][0] in "ac" and dropped[1][1] > 10
    exact = inference.vif(np.array([[1.0, 0.5], [0.5, 1.0]]), np.array([False, False]))
    assert exact == pytest.approx([4 / 3, 4 / 3])


def test_separation_is_flagged_and_finite(spark):
    rng = np.random.default_rng(1)
    rows = [(float(rng.normal()), 1.0 if i >= 392 else 0.0, "alto" if i >= 392 or i % 5 == 0 else "baixo", "GRANIZO" if i >= 392 else "ENXURRADA", "Sul" if i % 2 else "Norte") for i in range(400)]
    df = spark.createDataFrame(rows, "x double, z double, nivel_risco string, grupo_desastre string, regiao string")
    found = inference.odds(df, "gravidade", numeric=["x"])
    t = {r.variavel: r for r in found["tabela"].collect()}
    assert all(math.isfinite(v) for r in t.values() for v in (r.odds_ratio, r.ic95_inferior, r.ic95_superior))
    assert not t["grupo_desastre_GRANIZO"].significativo
    assert found["n_amostras"] == 400 and found["n_eventos"] == sum(r[2] == "alto" for r in rows) and 0.5 <= found["auc"] <= 1
    with pytest.raises(ValueError):
        inference.odds(df.where("nivel_risco = 'baixo'"), "gravidade", numeric=["x"])
    words = {r.variavel: r.frase for r in inference.sentences(found["tabela"], found["desvios_padrao"]).collect()}
    assert "sem efeito" in words["grupo_desastre_GRANIZO"]
    assert inference.export(found["tabela"], 1).count() == 1


def test_design_keeps_the_first_level_out(spark):
    df = spark.createDataFrame([(1.0, "B", None), (3.0, "A", 1.0), (5.0, "C", 1.0)], "x double, regiao string, y double")
    rows, names, spread = inference.design(df, ["x", "y"])
    assert names == ["x", "y", "regiao_B", "regiao_C"] and spread["x"] == pytest.approx(math.sqrt(8 / 3)) and spread["y"] == 1.0
    whole, kept, lost = inference.complete(rows, names)
    assert lost == 1 and whole.count() == 2 and kept == names


def test_shape_breaks_ties_mildly(spark):
    df = spark.createDataFrame([([0.4, 0.4, 0.2],), ([0.1, 0.45, 0.45],), ([0.33334, 0.33333, 0.33333],)], "p array<double>")
    assert [r.nivel for r in scoring.shape(df, F.col("p")).collect()] == ["baixo", "medio", "baixo"]
