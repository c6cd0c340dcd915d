"""Measures of predictions, all from one table of counts by real and predicted class."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardspark.contract import CLASSES
from hazardspark.functions.storage import written


def confusion(rows: DataFrame) -> DataFrame:
    """real, previsto, n."""
    return rows.groupBy("real", "previsto").agg(F.count("*").alias("n"))


def by_class(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class that is real or predicted; 0 for 0/0."""
    real = counts.groupBy(F.col("real").alias("classe")).agg(F.sum("n").alias("suporte"))
    said = counts.groupBy(F.col("previsto").alias("classe")).agg(F.sum("n").alias("previstos"))
    right = counts.where("real = previsto").select(F.col("real").alias("classe"), F.col("n").alias("certos"))
    rows = real.join(said, "classe", "full").join(right, "classe", "left").fillna(0, ["suporte", "previstos", "certos"])
    ratio = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    rows = rows.withColumns({"precisao": ratio("certos", "previstos"), "recall": ratio("certos", "suporte")})
    f1 = F.coalesce(2 * F.col("precisao") * F.col("recall") / F.nullif(F.col("precisao") + F.col("recall"), F.lit(0.0)), F.lit(0.0))
    return rows.withColumn("f1", f1).select("classe", "precisao", "recall", "f1", "suporte")


def summary(counts: DataFrame) -> DataFrame:
    """Accuracy, balanced accuracy, macro and weighted means, what became of alto; one row."""
    each = by_class(counts)
    total = F.sum("suporte")
    means = each.agg(
        F.avg(F.when(F.col("suporte") > 0, F.col("recall"))).alias("acuracia_balanceada"), F.avg("f1").alias("f1_macro"), F.avg("precisao").alias("precisao_macro"), F.avg("recall").alias("recall_macro"),
        (F.sum(F.col("f1") * F.col("suporte")) / total).alias("f1_ponderado"), (F.sum(F.col("precisao") * F.col("suporte")) / total).alias("precisao_ponderada"),
        (F.sum(F.col("recall") * F.col("suporte")) / total).alias("acuracia"), F.coalesce(F.max(F.when(F.col("classe") == "alto", F.col("recall"))), F.lit(0.0)).alias("recall_alto"),
    )
    missed = counts.agg(F.coalesce(F.sum(F.when((F.col("real") == "alto") & (F.col("previsto") == "baixo"), F.col("n"))), F.lit(0)).alias("alto_como_baixo"), F.sum("n").alias("linhas"))
    return means.crossJoin(missed)  # one row each


def matrix(counts: DataFrame, classes: list[str] = CLASSES) -> DataFrame:
    """A row for each real class, a column for each predicted one, in class order."""
    base = counts.sparkSession.createDataFrame([(i, c) for i, c in enumerate(classes)], "ordem int, real string")
    wide = counts.groupBy("real").pivot("previsto", classes).agg(F.sum("n"))
    return base.join(wide, "real", "left").fillna(0, classes).select("ordem", "real", *classes)


def majority(rows: DataFrame, label: str = "nivel_risco") -> DataFrame:
    """The share of the most frequent class."""
    return rows.groupBy(label).count().agg((F.max("count") / F.sum("count")).alias("fracao_maioria"))


def diagnosis(train: float, test: float) -> str:
    """overfitting, underfitting or equilibrado, by balanced accuracies."""
    return "overfitting" if train - test > 0.15 else "underfitting" if test < 0.40 else "equilibrado"


def diagnose(rows: DataFrame) -> DataFrame:
    """``rows`` (treino, teste) with diagnostico."""
    gap = F.col("treino") - F.col("teste")
    return rows.withColumn("diagnostico", F.when(gap > 0.15, "overfitting").when(F.col("teste") < 0.40, "underfitting").otherwise("equilibrado"))


def levels(rows: DataFrame, keys: list[str], label: str = "nivel_risco", classes: list[str] = CLASSES) -> DataFrame:
    """Rows of each class (0 for none), by keys."""
    return rows.groupBy(*keys).agg(*(F.count_if(F.col(label) == c).alias(c) for c in classes))


def ranged(counts: DataFrame, score: str = "s") -> DataFrame:
    """``counts`` with part: ranges of the score between splitters that are drawn from the scores themselves, written once."""
    return written(counts.repartitionByRange(score).withColumn("part", F.spark_partition_id()), "score-ranges")


def auc(rows: DataFrame, score: str, positive: str) -> DataFrame:
    """Exact area under the curve by rank sums, equal scores at their mean rank; null where a class lacks.

    Rows of equal score are one count first, so a score that most rows share is one row.
    The counts are dealt into ranges by splitters drawn from them, and written; the sums of
    the ranges before and the running sum within give each score's rank: no step sorts all
    scores in one task, however they are spread. A null or NaN score is an error, a null
    outcome counts as negative.
    """
    s = F.col(score).cast("double")
    sound = F.when(s.isNull() | F.isnan(s), F.raise_error(F.lit("a score is null or NaN")).cast("double")).otherwise(s)
    hit = F.coalesce(F.col(positive), F.lit(False))
    counts = rows.select(sound.alias("s"), hit.alias("_hit")).groupBy("s").agg(F.count_if("_hit").alias("p"), F.count_if(~F.col("_hit")).alias("q"))
    counts = ranged(counts)
    parts = counts.groupBy("part").agg(F.sum("q").alias("kq"))
    parts = parts.select("part", (F.sum("kq").over(Window.orderBy("part")) - F.col("kq")).alias("before"))  # a row for each range
    ranked = counts.join(parts, "part").withColumn("below", F.col("before") + F.sum("q").over(Window.partitionBy("part").orderBy("s")) - F.col("q"))
    wins = F.sum(F.col("p") * (F.col("below") + F.col("q") / 2))
    return ranked.agg((wins / F.nullif(F.sum("p") * F.sum("q"), F.lit(0))).alias("auc"))
