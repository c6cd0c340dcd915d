"""Occurrences, history, sampling and the dataset, on the hand-made register."""

import pytest
from pyspark.sql import functions as F

from hazardspark import contract
from hazardspark.functions.months import month_index, month_of, year_of
from hazardspark.functions.text import normalise, title_case
from hazardspark.operators import history, monthly, scoring
from hazardspark.sources import events


def register_rows():
    rows = []
    base = dict(reconhecido=False, mortos=0.0, afetados=100.0, prejuizo=1000.0)

    def add(place, group, year, month, **more):
        rows.append((*place, year, month, group, *(base | more).values()))

    petropolis, quixada, blumenau = (3303906, "Petropolis", "RJ", "Sudeste"), (2311306, "Quixada", "CE", "Nordeste"), (4202404, "Blumenau", "SC", "Sul")
    for year in range(2012, 2026):
        add(petropolis, "DESLIZAMENTO", year, 2, reconhecido=True, mortos=3.0, afetados=5000.0, prejuizo=2e6)
        if year % 2 == 0:
            add(petropolis, "DESLIZAMENTO", year, 3, afetados=800.0)
        else:
            add(blumenau, "INUNDACAO", year, 11, afetados=12000.0, prejuizo=8e6)
        for month in (8, 9, 10):
            add(quixada, "ESTIAGEM_SECA", year, month, reconhecido=month == 9, afetados=20000.0, prejuizo=5e5)
    return rows


@pytest.fixture(scope="module")
def occurrences(spark):
    return spark.createDataFrame(register_rows(), contract.OCCURRENCES).persist()


@pytest.fixture(scope="module")
def dataset(occurrences):
    return monthly.build(occurrences, 2015, 2025, 2, 7).persist()


def test_dataset_is_what_the_events_say(dataset):
    rows = dataset.collect()
    seen = {(r[0], r[6], (r[4] - 1900) * 12 + r[5] - 1) for r in register_rows()}
    assert len({(r.codigo_ibge, r.grupo_desastre, r.indice_mes) for r in rows}) == len(rows)
    assert {r.nivel_risco for r in rows} == set(contract.CLASSES)
    for r in rows:
        earlier = [i for c, g, i in seen if (c, g) == (r.codigo_ibge, r.grupo_desastre) and i < r.indice_mes]
        assert r.ocorrencias_total_historico == len(earlier)
        assert r.ocorrencias_12m == sum(i >= r.indice_mes - 12 for i in earlier)
        assert r.ocorrencias_mesmo_mes_historico == sum(i % 12 == r.indice_mes % 12 for i in earlier)
        assert r.meses_desde_ultima_ocorrencia == (r.indice_mes - max(earlier) if earlier else -1)
        assert (r.nivel_risco == "baixo") == ((r.codigo_ibge, r.grupo_desastre, r.indice_mes) not in seen)
        if r.codigo_ibge == 3303906 and r.mes == 2:
            assert r.nivel_risco == "alto"
    positives = sum(r.nivel_risco != "baixo" for r in rows)
    assert len(rows) == 3 * positives


def test_dataset_is_reproducible(occurrences, dataset):
    again = monthly.build(occurrences, 2015, 2025, 2, 7)
    assert again.exceptAll(dataset).isEmpty() and dataset.exceptAll(again).isEmpty()


def test_positive_rate_differs_between_series(occurrences):
    rows = monthly.build(occurrences, 2015, 2025, 3, 7).groupBy("codigo_ibge").agg(F.avg((F.col("nivel_risco") != "baixo").cast("double")).alias("r")).collect()
    rates = {r.codigo_ibge: r.r for r in rows}
    assert rates[2311306] == max(rates.values()) and max(rates.values()) - min(rates.values()) > 0.05


def test_sample_is_exact(spark):
    rows = spark.range(500).withColumnRenamed("id", "k")
    for size in (0, 1, 77, 499, 500, 900):
        assert monthly.sample(rows, size, 3, ["k"]).count() == min(size, 500)


def test_empty_period_is_an_error(occurrences):
    with pytest.raises(ValueError):
        monthly.build(occurrences, 1800, 1801)
    with pytest.raises(ValueError):
        monthly.free_months(monthly.by_month(occurrences), 2001, 2000)


def test_queries_see_the_same_features(occurrences, dataset, spark):
    asked = dataset.select("codigo_ibge", "grupo_desastre", "ano", "mes")
    names = ["ocorrencias_12m", "ocorrencias_60m", "ocorrencias_total_historico", "mortos_historico", "ocorrencias_municipio_12m", "ocorrencias_uf_grupo_12m"]
    keys = ["codigo_ibge", "grupo_desastre", "ano", "mes"]
    a = {tuple(r[k] for k in keys): tuple(r[n] for n in names) for r in scoring.requested(occurrences, asked).collect()}
    assert a == {tuple(r[k] for k in keys): tuple(r[n] for n in names) for r in dataset.collect()}
    never = spark.createDataFrame([(3303906, "GRANIZO", 2026, 5), (9999999, "GRANIZO", 2026, 5)], "codigo_ibge long, grupo_desastre string, ano int, mes int")
    r = scoring.requested(occurrences, never).collect()
    assert len(r) == 1 and (r[0].ocorrencias_total_historico, r[0].ja_ocorreu, r[0].meses_desde_ultima_ocorrencia) == (0, 0, -1)
    assert scoring.country(occurrences, never).count() == 3
    assert scoring.season(never, 2026).count() == 24


def test_state_context_counts_other_towns(spark):
    rows = [(1, "a", "X", "Sul", 2020, 1, "G", False, 0.0, 0.0, 0.0), (2, "b", "X", "Sul", 2020, 3, "G", False, 0.0, 0.0, 0.0), (2, "b", "X", "Sul", 2020, 3, "H", False, 0.0, 0.0, 0.0)]
    m = monthly.by_month(spark.createDataFrame(rows, contract.OCCURRENCES))
    asked = spark.createDataFrame([(1, "G", (120) * 12 + 5), (7, "G", 120 * 12 + 5)], "codigo_ibge long, grupo_desastre string, indice_mes int")
    got = {r.codigo_ibge: (r.ocorrencias_municipio_12m, r.ocorrencias_uf_grupo_12m) for r in history.context(m, asked).collect()}
    assert got == {1: (1, 2), 7: (0, 0)}


def test_register_file(spark, tmp_path):
    head = ";".join([*contract.REGISTER_COLUMNS, "Outra"])
    lines = [
        "São João; sp ;CENTRO-OESTE;05/03/2020;Inundações;3549102,0;Reconhecido;2;1000;1234,5;x",
        "Exu;PE;nordeste;31/02/2020;Granizo;2605301;Registro;;;;x",
        "Exu;PE;nordeste;01/02/2020;Tornado;2605301;Registro;-3;;;x",
        "Exu;PE;nordeste;01/02/2020;Outros;2605301;Registro;;;;x",
        "Exu;PE;nordeste;01/02/2020;Erosão;;Registro;;;;x",
    ]
    path = tmp_path / "v1.csv"
    path.write_bytes("\n".join([head, *lines]).encode("cp850"))
    got = sorted(map(tuple, events.clean(events.read_register(spark, str(path))).collect()))
    assert got == [(2605301, "Exu", "PE", "Nordeste", 2020, 2, "VENDAVAL_CICLONE", False, 0.0, 0.0, 0.0), (3549102, "São João", "SP", "Centro-Oeste", 2020, 3, "INUNDACAO", True, 2.0, 1000.0, 1234.5)]
    (tmp_path / "bad.csv").write_text("a;b\n1;2")
    with pytest.raises(ValueError):
        events.read_register(spark, str(tmp_path / "bad.csv"))
    assert events.newest(["/x/a_v1.csv", "/x/a_v2.csv"]) == "/x/a_v2.csv"


def test_text_and_months(spark):
    df = spark.createDataFrame([("Mogi-Guaçu",), ("D'Oeste",), ("  SÃO   PAULO",), ("é",)], "t string")
    assert [r.n for r in df.select(normalise(F.col("t")).alias("n")).collect()] == ["mogi guacu", "d oeste", "sao paulo", "e"]
    assert [r.n for r in df.select(title_case(F.col("t")).alias("n")).collect()][0] == "Mogi-Guaçu"
    got = spark.range(1, 2000).select(F.col("id").cast("int").alias("i")).select("i", month_index(year_of(F.col("i")), month_of(F.col("i"))).alias("j"))
    assert got.where("i <> j").isEmpty()
