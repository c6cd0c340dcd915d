"""Scored maps and seasons against scores of single requests."""

import pytest
from pyspark.sql import functions as F

from hazardspark import contract
from hazardspark.operators import frequency, monthly, scoring, training
from tests.test_events import register_rows


@pytest.fixture(scope="module")
def occurrences(spark):
    return spark.createDataFrame(register_rows(), contract.OCCURRENCES).persist()


@pytest.fixture(scope="module", params=["cells", "forest"])
def model(request, occurrences):
    rows = monthly.build(occurrences, 2015, 2025, 2, 7)
    if request.param == "cells":
        return frequency.Frequent.fit(rows, 3, 2)
    return training.Forest.fit(rows, 3, 4, 2, numeric=["mes", "ocorrencias_12m"], categorical=["grupo_desastre", "regiao"])


def test_the_map_has_the_scores_of_its_requests(spark, occurrences, model, tmp_path):
    path, months = str(tmp_path / "map"), spark.createDataFrame([(2026, 1), (2026, 2), (2025, 11), (2026, 2), (2026, 13), (None, 1)], "ano int, mes int")
    scoring.write_map(model, occurrences, months, path)
    maps = {(r.codigo_ibge, r.grupo_desastre, r.ano, r.mes): r for r in scoring.read_map(spark, path).collect()}
    pairs = {(r[0], r[6]) for r in register_rows()}
    assert set(maps) == {(*p, y, m) for p in pairs for y, m in ((2026, 1), (2026, 2), (2025, 11))}
    asked = spark.createDataFrame([(3303906, "DESLIZAMENTO", 2026, 2), (4202404, "INUNDACAO", 2025, 11)], "codigo_ibge long, grupo_desastre string, ano int, mes int")
    for r in scoring.scored(model, scoring.requested(occurrences, asked)).collect():
        on = maps[r.codigo_ibge, r.grupo_desastre, r.ano, r.mes]
        assert (on.nivel, on.cor, on.municipio, on.prob_alto) == (r.nivel, r.cor, r.municipio, r.prob_alto)
    counts = {(r.grupo_desastre, r.ano, r.mes): r for r in scoring.map_summary(scoring.read_map(spark, path)).collect()}
    assert len(counts) == 9 and all(r.total == r.baixo + r.medio + r.alto == 1 for r in counts.values())
    scoring.write_map(model, occurrences.where("grupo_desastre = 'INUNDACAO'"), months.where("mes = 11"), path)
    assert scoring.read_map(spark, path).count() == len(maps)


def test_season_is_twelve_requests(spark, occurrences, model):
    rows = scoring.season_profile(model, occurrences, 2026).collect()
    assert len(rows) == 12 * len({(r[0], r[6]) for r in register_rows()})
    for r in rows:
        year = [x.prob_alto for x in rows if (x.codigo_ibge, x.grupo_desastre) == (r.codigo_ibge, r.grupo_desastre)]
        assert len(year) == 12 and r.altura == pytest.approx(r.prob_alto / max(*year, 0.01)) and r.pico == (r.prob_alto == max(year))


def test_months_asked_for_are_bounded(spark, occurrences, monkeypatch):
    monkeypatch.setattr(scoring, "ASKED", 5)
    months = spark.range(6).select(F.lit(2026).alias("ano"), (F.col("id") + 1).cast("int").alias("mes"))
    with pytest.raises(ValueError):
        scoring.country(occurrences, months)
    assert scoring.country(occurrences, months.limit(0)).count() == 0
