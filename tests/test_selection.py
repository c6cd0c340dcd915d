"""The fit protocols: no future, one opening of the test part, rows computed once, the plain model by hand."""

import threading
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazardspark import contract
from hazardspark.operators import frequency, selection, splits, training
from hazardspark.operators.costs import COST

SCHEMA = "codigo_ibge long, ano int, mes int, grupo_desastre string, regiao string, x1 double, nivel_risco string"


def rows_of(first=2010, last=2025, each=40):
    rng = np.random.default_rng(8)
    rows = []
    for year in range(first, last + 1):
        for i in range(each):
            level = contract.CLASSES[int(rng.integers(0, 3))]
            group = "GRANIZO" if level == "alto" or rng.random() < 0.3 else "EROSAO"
            rows.append((i, year, i % 4 + 1, group, None if i % 9 == 0 else "Sul" if i % 2 else "Norte", float(contract.CLASSES.index(level) + rng.normal(0, 0.2)), level))
    return rows


@pytest.fixture(scope="module")
def yearly(spark):
    return spark.createDataFrame(rows_of(), SCHEMA)


class Spy:
    """Fits the plain model, and keeps which years each fit and each trial saw."""

    def __init__(self):
        self.fits, self.trials, self.lock = [], [], threading.Lock()

    def years(self, rows):
        return frozenset(r[0] for r in rows.select("ano").distinct().collect())

    def __call__(self, rows, depth=1, leaf=1):
        years, model, spy = self.years(rows), frequency.Frequent.fit(rows, depth, leaf), self
        with self.lock:
            self.fits.append((depth, years))

        class Watched:
            def transform(self, tried):
                with spy.lock:
                    spy.trials.append((years, spy.years(tried)))
                return model.transform(tried)

        return Watched()


def by_hand(train, rows, depth, leaf):
    keys = lambda r, d: tuple("" if v is None else str(v) for v in (r[3], r[4], r[2])[:d])
    cells = Counter((keys(r, d), r[6]) for r in train for d in range(depth + 1))
    sizes = Counter(keys(r, d) for r in train for d in range(depth + 1))
    out = []
    for r in rows:
        d = next(d for d in range(depth, -1, -1) if sizes[keys(r, d)] >= (leaf if d else 1))
        out.append(max(contract.CLASSES, key=lambda c: (cells[keys(r, d), c] * COST[c], -contract.CLASSES.index(c))))
    return out


@pytest.mark.parametrize("depth,leaf", [(0, 1), (1, 5), (3, 1), (3, 12), (None, 30)])
def test_plain_model_by_hand(spark, yearly, depth, leaf):
    rows = [*rows_of(), (1, 2030, 99, "NEVER", "Sul", 0.0, "baixo"), (1, 2030, 1, None, None, 0.0, "baixo")]
    train = rows_of(last=2020)
    model = frequency.Frequent.fit(spark.createDataFrame([*train, (1, 2010, 1, "GRANIZO", "Sul", 0.0, None)], SCHEMA), depth, leaf)
    got = model.transform(spark.createDataFrame(rows, SCHEMA)).select("codigo_ibge", "ano", "mes", "previsto", "probability").collect()
    want = Counter((r[0], r[1], r[2], p) for r, p in zip(rows, by_hand(train, rows, 3 if depth is None else depth, leaf), strict=True))
    assert Counter((r.codigo_ibge, r.ano, r.mes, r.previsto) for r in got) == want
    assert all(sum(r.probability) == pytest.approx(1) for r in got)


def test_plain_model_refuses_nothing_to_learn_from(spark, yearly):
    with pytest.raises(ValueError):
        frequency.Frequent.fit(yearly.limit(0), 2)
    table = frequency.Frequent.fit(yearly, 2, 1).table().collect()
    assert sum(r.n for r in table if r.nivel == 0) == 640 == sum(r.n for r in table if r.nivel == 2)


def test_shelved_rows_are_read_by_year(yearly):
    held = selection.shelved(yearly.unionByName(yearly.limit(3).withColumn("ano", F.lit(None).cast("int"))))
    assert held.count() == 643 and held.columns == yearly.columns and held.where("ano IS NULL").count() == 3
    assert held.exceptAll(yearly).count() == 3
    plan = held.where("ano <= 2012")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ano" in plan and "(ano" in plan.split("PartitionFilters")[1][:80]


def test_walk_forward_sees_no_future(yearly):
    spy = Spy()
    found = selection.walk_forward(yearly, spy, last=3).orderBy("ano_teste").collect()
    assert [(r.treino_ate, r.ano_teste) for r in found] == [(2022, 2023), (2023, 2024), (2024, 2025)]
    assert [(r.linhas_treino, r.linhas_teste, r.classes_treino, r.classes_teste) for r in found] == [(40 * (r.treino_ate - 2009), 40, 3, 3) for r in found]
    assert all(0 <= r[m] <= 1 for r in found for m in selection.MEASURES)
    assert sorted(len(y) for _, y in spy.fits) == [13, 14, 15] and all(tried == {max(known) + 1} for known, tried in spy.trials) and len(spy.trials) == 3
    alone = selection.walk_forward(yearly, spy, last=3, together=1).orderBy("ano_teste").collect()
    assert alone == found
    by_measure = {r.medida: r for r in selection.walk_summary(selection.walk_forward(yearly, spy, last=3)).collect()}
    values = [r.f1_macro for r in found]
    assert by_measure["f1_macro"].pior == min(values) and by_measure["f1_macro"].desvio == pytest.approx(np.std(values, ddof=1))


def test_walk_forward_leaves_out_windows_of_one_class(yearly):
    one = yearly.withColumn("nivel_risco", F.when(F.col("ano") < 2021, "baixo").otherwise(F.col("nivel_risco")))
    assert [r.ano_teste for r in selection.walk_forward(one, Spy()).orderBy("ano_teste").collect()] == [2022, 2023, 2024, 2025]
    with pytest.raises(ValueError):
        selection.walk_forward(yearly.withColumn("nivel_risco", F.lit("baixo")), Spy())


def test_rows_upstream_are_computed_once(spark, yearly):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    watched = yearly.repartition(3).mapInArrow(count, yearly.schema)
    selection.walk_forward(watched, Spy(), last=3)
    assert seen.value <= 2 * 640  # written once; the range partitioning draws its sample before
    selection.select_and_refit(watched, 2020, 2022, Spy(), [(0, 1), (1, 1)])
    assert seen.value <= 4 * 640


def test_protocol_opens_the_test_part_once(yearly):
    spy = Spy()
    found = selection.select_and_refit(yearly, 2020, 2022, spy, [(0, 1), (1, 5), (3, 1)])
    early, valid, late = (frozenset(y) for y in (range(2010, 2020), (2020, 2021), range(2022, 2026)))
    assert [y for _, y in spy.fits[:3]] == [early] * 3 and [y for _, y in spy.fits[3:]] == [early | valid, early | valid | late]
    assert spy.trials[:3] == [(early, valid)] * 3 and spy.trials[3:] == [(early | valid, late)]
    assert [d for d, _ in spy.fits[3:]] == [found.chosen[0]] * 2
    trials = found.trials.collect()
    assert sum(r.escolhido for r in trials) == 1 and len(trials) == 3
    best = max(r.f1_macro for r in trials)
    near = [r for r in trials if r.f1_macro >= best - selection.TOLERANCE]
    assert found.chosen == min(((r.profundidade, r.folha) for r in near), key=lambda c: (c[0], -c[1]))
    assert found.rows == {"treino": 400, "validacao": 80, "teste": 160} and found.test().first().linhas == 160
    report = {r.etapa: r for r in found.report().where("escolhido").collect()}
    assert (report["teste"].linhas_ajuste, report["final"].linhas_ajuste, report["validacao"].linhas_prova) == (480, 640, 80) and report["final"].f1_macro is None


def test_parsimony_takes_the_plainest_of_a_tie(yearly):
    found = selection.select_and_refit(yearly, 2020, 2022, Spy(), [(3, 1), (None, 2), (0, 1), (0, 9)], tolerance=1.0)
    assert found.chosen == (0, 9)
    (marked,) = found.trials.where("escolhido").collect()
    assert marked.por_parcimonia == (marked.f1_macro < found.trials.agg(F.max("f1_macro")).first()[0])


def test_seal(yearly):
    sealed = selection.Sealed(yearly)
    with pytest.raises(RuntimeError):
        sealed.open(None)
    assert sealed.open((1, 2)).count() == 640
    with pytest.raises(RuntimeError):
        sealed.open((1, 2))
    for cut in ((2022, 2020), (2020, 2050)):
        with pytest.raises(ValueError):
            selection.select_and_refit(yearly, *cut, Spy(), [(0, 1)])


def test_comparisons(yearly):
    plain = lambda rows: frequency.Frequent.fit(rows, 1, 1)
    shares = selection.compare_shares(yearly, plain, (0.5, 0.2)).collect()
    assert min(r.diferenca for r in shares) == 0 and all(0 <= r.acuracia_balanceada <= 1 for r in shares)
    timed = selection.compare_in_time(yearly, plain, 2023).collect()
    assert {r.divisao for r in timed} == {"aleatoria", "temporal"} and len({r.inflacao for r in timed}) == 1


def test_protocol_with_forests(yearly):
    make = selection.forest(3, numeric=["x1"], categorical=["grupo_desastre"])
    found = selection.select_and_refit(yearly, 2020, 2022, make, [(2, 5), (4, 3)])
    assert isinstance(found.final, training.Forest) and found.test().first().acuracia_balanceada > 0.8
    assert splits.three(yearly, 2020, 2022).count() == 640
