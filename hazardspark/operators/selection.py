"""Honest trials of models: walk-forward, choice on validation rows, a test part that opens once, comparison of splits.

Every trial works on rows written once by year (``shelved``), so that a window reads the
files of its own years and nothing upstream is computed again; fills, encodings and models
are learnt from the training rows of each window alone. Trials that do not wait for each
other run side by side, ``TOGETHER`` at a time. What goes to the driver is a count for
each year and class, and a few measures for each trial.

A model here is what ``make`` returns: an object whose ``transform`` adds previsto.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardspark import contract
from hazardspark.functions.storage import fresh
from hazardspark.operators import metrics, splits
from hazardspark.operators.training import Forest, evaluate

# Depth and smallest leaf of the candidates, and the gap of scores that counts as a tie.
CANDIDATES = [(12, 10), (16, 5), (20, 5), (28, 3), (None, 5)]
TOLERANCE = 0.01
TOGETHER = 3
MEASURES = ("acuracia_balanceada", "f1_macro", "recall_alto")
WINDOWS = "treino_ate int, ano_teste int, linhas_treino long, linhas_teste long, classes_treino int, classes_teste int, acuracia_balanceada double, f1_macro double, recall_alto double"
TRIALS = "profundidade int, folha int, acuracia_balanceada double, f1_macro double, recall_alto double"


def shelved(rows: DataFrame) -> DataFrame:
    """``rows`` written by year, each year in even parts, and read back: a range of years is a range of folders."""
    path = fresh(rows.sparkSession, "by-year")
    rows.repartitionByRange("ano", F.xxhash64(*rows.columns)).write.partitionBy("ano").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path).select(*rows.columns)


def side_by_side(work: Callable, items: Iterable, together: int = TOGETHER) -> list:
    """``work`` of each item, in order; up to ``together`` at a time."""
    items = list(items)
    if together < 2 or len(items) < 2:
        return [work(i) for i in items]
    with ThreadPoolExecutor(together) as pool:
        return list(pool.map(inheritable_thread_target(SparkSession.active())(work), items))


def _measures(model, rows: DataFrame) -> tuple[float, float, float]:
    found = evaluate(model, rows).first()
    return tuple(found[m] for m in MEASURES)


def walk_forward(rows: DataFrame, make: Callable[[DataFrame], Any], least: int = 8, last: int | None = None, together: int = TOGETHER) -> DataFrame:
    """A new model for each window, fitted on the years before and tried on the next.

    A window whose training rows have fewer than two classes is left out; none left is an
    error.
    """
    held = shelved(rows)
    seen: dict[int, dict[str, int]] = {}
    for r in held.groupBy("ano", contract.TARGET).count().collect():  # years x classes
        seen.setdefault(r["ano"], {})[r[contract.TARGET]] = r["count"]

    def counted(years: list[int]) -> tuple[int, int]:
        classes = {c for y in years for c in seen[y] if c is not None}
        return sum(n for y in years for n in seen[y].values()), len(classes)

    def window(w) -> tuple:
        test = held.where(F.col("ano") == w.ano_teste)
        known, tried = counted([y for y in seen if y is not None and y <= w.treino_ate]), counted([w.ano_teste])
        model = make(held.where(F.col("ano") <= w.treino_ate))
        return (w.treino_ate, w.ano_teste, known[0], tried[0], known[1], tried[1], *_measures(model, test))

    found = sorted(splits.windows(held.where("ano IS NOT NULL"), least, last).collect())
    usable = [w for w in found if counted([y for y in seen if y is not None and y <= w.treino_ate])[1] > 1]
    if not usable:
        raise ValueError("no window could be tried")
    return rows.sparkSession.createDataFrame(side_by_side(window, usable, together), WINDOWS)


def walk_summary(found: DataFrame) -> DataFrame:
    """Mean, sample deviation and worst of each measure."""
    lines = found.select(F.explode(F.array(*(F.struct(F.lit(c).alias("medida"), F.col(c).alias("v")) for c in MEASURES))).alias("x")).select("x.medida", "x.v")
    return lines.groupBy("medida").agg(F.avg("v").alias("media"), F.stddev_samp("v").alias("desvio"), F.min("v").alias("pior"))


def parsimonious(candidates: DataFrame, tolerance: float = TOLERANCE, measure: str = "f1_macro") -> DataFrame:
    """Of the candidates within ``tolerance`` of the best, the least complex: the shallowest (no limit last), then that of the largest leaf."""
    best = candidates.agg(F.max(measure).alias("_best"))
    near = candidates.crossJoin(best).where(F.col(measure) >= F.col("_best") - tolerance).drop("_best")  # one row
    return near.orderBy(F.coalesce("profundidade", F.lit(999)), -F.col("folha")).limit(1)


def choose(train: DataFrame, validation: DataFrame, make: Callable[..., Any] | None = None, candidates=None, together: int = TOGETHER) -> DataFrame:
    """Each candidate's measures on the validation rows."""
    make = make or forest()

    def trial(candidate: tuple[int | None, int]) -> tuple:
        return (*candidate, *_measures(make(train, *candidate), validation))

    return train.sparkSession.createDataFrame(side_by_side(trial, candidates or CANDIDATES, together), TRIALS)


def forest(trees: int = 100, seed: int = 42, depth: int | None = 20, leaf: int = 5, **more) -> Callable[..., Forest]:
    """A ``make`` that fits forests, of this depth and leaf where a trial names none."""
    return lambda rows, depth=depth, leaf=leaf: Forest.fit(rows, trees, depth, leaf, seed, **more)


class Sealed:
    """Rows that can be had once, and only for a choice that has been made."""

    def __init__(self, rows: DataFrame):
        self._rows, self.opened_for = rows, None

    def open(self, choice) -> DataFrame:
        if choice is None:
            raise RuntimeError("the test part stays closed until the choice is made")
        if self.opened_for is not None:
            raise RuntimeError(f"the test part has been used already, for {self.opened_for}")
        self.opened_for = choice
        return self._rows


@dataclass
class Selection:
    """What the protocol gives: all trials, the choice, its one test, and two models."""

    trials: DataFrame  # the candidates on the validation rows, with escolhido and por_parcimonia
    chosen: tuple[int | None, int]
    confusion: DataFrame  # of the one test
    tested: Any  # fitted on training and validation rows
    final: Any  # fitted on all rows
    rows: dict[str, int]  # of each part

    def test(self) -> DataFrame:
        return metrics.summary(self.confusion)

    def report(self) -> DataFrame:
        """etapa, candidate, rows fitted and tried, measures: the trials, the test, the final fit (which nothing is left to try on)."""
        parts, spark = self.rows, self.trials.sparkSession
        trials = self.trials.select(F.lit("validacao").alias("etapa"), "profundidade", "folha", F.lit(parts["treino"]).alias("linhas_ajuste"), F.lit(parts["validacao"]).alias("linhas_prova"), *MEASURES, "escolhido")
        names = [F.lit(v).cast("int").alias(n) for v, n in zip(self.chosen, ("profundidade", "folha"), strict=True)]
        test = self.test().select(F.lit("teste").alias("etapa"), *names, F.lit(parts["treino"] + parts["validacao"]).alias("linhas_ajuste"), F.lit(parts["teste"]).alias("linhas_prova"), *MEASURES, F.lit(True).alias("escolhido"))
        final = spark.range(1).select(F.lit("final").alias("etapa"), *names, F.lit(sum(parts.values())).alias("linhas_ajuste"), F.lit(0).alias("linhas_prova"), *(F.lit(None).cast("double").alias(m) for m in MEASURES), F.lit(True).alias("escolhido"))
        return trials.union(test).union(final).withColumns({n: F.col(n).cast("long") for n in ("linhas_ajuste", "linhas_prova")})


def select_and_refit(rows: DataFrame, validation: int, test: int, make: Callable[..., Any] | None = None, candidates=None, tolerance: float = TOLERANCE, together: int = TOGETHER) -> Selection:
    """Choose on the validation years, refit on all years before the test, test once, refit on everything.

    ``make(rows, depth, leaf)`` fits a new model. The test part is sealed: it is handed out
    once, after the choice; a part without rows or a wrong order of years is an error.
    """
    make = make or forest()
    held = splits.three(shelved(rows), validation, test)
    part = lambda *names: held.where(F.col("parte").isin(*names)).drop("parte")
    sizes = {r["parte"]: r["count"] for r in held.groupBy("parte").count().collect()}  # three
    sealed = Sealed(part("teste"))
    trials = choose(part("treino"), part("validacao"), make, candidates, together)
    best = parsimonious(trials, tolerance).first()
    chosen = (best.profundidade, best.folha)
    marked = F.col("profundidade").eqNullSafe(F.lit(chosen[0])) & (F.col("folha") == chosen[1])
    top = trials.agg(F.max("f1_macro")).first()[0]
    trials = trials.withColumn("escolhido", marked).withColumn("por_parcimonia", marked & F.lit(best.f1_macro < top))
    tested = make(part("treino", "validacao"), *chosen)
    found = metrics.confusion(tested.transform(sealed.open(chosen)).select(F.col(contract.TARGET).alias("real"), "previsto")).collect()  # at most classes squared
    confusion = rows.sparkSession.createDataFrame([tuple(r) for r in found], "real string, previsto string, n long")
    return Selection(trials, chosen, confusion, tested, make(held.drop("parte"), *chosen), sizes)


def compare_shares(rows: DataFrame, make: Callable[[DataFrame], Any] | None = None, shares: tuple[float, ...] = (0.5, 0.3, 0.2), together: int = TOGETHER) -> DataFrame:
    """Random stratified splits at several test shares, with the gap to the best; below 0.02 it is negligible."""
    make, held = make or forest(), shelved(rows)

    def trial(share: float) -> tuple:
        parts = splits.stratified(held, share, contract.KEY)
        return (share, *_measures(make(parts.where("parte = 'treino'")), parts.where("parte = 'teste'"))[:2])

    found = side_by_side(trial, shares, together)
    best = max(m for _, m, _ in found)
    return rows.sparkSession.createDataFrame([(s, b, f, best - b, best - b < 0.02) for s, b, f in found], "proporcao_teste double, acuracia_balanceada double, f1_macro double, diferenca double, desprezivel boolean")


def compare_in_time(rows: DataFrame, make: Callable[[DataFrame], Any] | None = None, test: int = 2022, together: int = TOGETHER) -> DataFrame:
    """A random and a temporal split of the same test share, and how much the random one flatters; above 0.02 that counts."""
    make, held = make or forest(), shelved(rows)
    timed = splits.two(held, test)
    share = timed.agg(F.avg((F.col("parte") == "teste").cast("double"))).first()[0]

    def trial(named: tuple[str, DataFrame]) -> tuple:
        name, parts = named
        return (name, *_measures(make(parts.where("parte = 'treino'")), parts.where("parte = 'teste'"))[:2])

    found = side_by_side(trial, (("aleatoria", splits.stratified(held, share, contract.KEY)), ("temporal", timed)), together)
    gap = found[0][1] - found[1][1]
    return rows.sparkSession.createDataFrame([(*f, gap, gap > 0.02) for f in found], "divisao string, acuracia_balanceada double, f1_macro double, inflacao double, relevante boolean")
