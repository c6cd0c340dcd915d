"""Weighted forests: fitting, scoring, importance, saved models."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.pipeline import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardspark import contract
from hazardspark.operators import features, metrics
from hazardspark.operators.costs import COST

DEEPEST = 30  # of the forests here; stands for no limit
#: Rows that one task holds of a training slice, and nodes up to which one fit grows all trees: every task sends a histogram for every node.
SLICE, FEW = 500_000, 100_000


def shares(trees: int, depth: int, leaf: int, rows: int, cores: int) -> tuple[list[int], int]:
    """Trees of each fit that runs side by side with the others, and the tasks of each.

    The work of a fit is nodes x tasks: each fit takes as few tasks as the rows allow, and
    as many fits run as the cores allow; what has few nodes, or many rows, is one fit.
    """
    tasks = max(1, -(-rows // SLICE))
    fits = min(trees, cores // tasks) if trees * min(2**depth, rows // max(leaf, 1)) > FEW else 1
    if fits < 2:
        return [trees], cores
    return [trees * (i + 1) // fits - trees * i // fits for i in range(fits)], tasks


class Grove:
    """Forests that were fitted side by side, as one: all votes are summed, every tree weighs the same."""

    def __init__(self, parts: list[RandomForestClassificationModel]):
        self.parts, self.numClasses, self.numFeatures = parts, parts[0].numClasses, parts[0].numFeatures
        self.getNumTrees, self.totalNumNodes = sum(p.getNumTrees for p in parts), sum(p.totalNumNodes for p in parts)

    @property
    def featureImportances(self) -> np.ndarray:
        """The parts' importances, each by its trees that have a split; sums to 1."""
        summed = sum(p.featureImportances.toArray() * sum(t.depth > 0 for t in p.trees) for p in self.parts)
        return summed / (summed.sum() or 1.0)

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` with rawPrediction, probability and prediction, as one forest gives them."""
        names = [f"_raw{i}" for i in range(len(self.parts))]
        out = rows
        for part, name in zip(self.parts, names, strict=True):
            out = part.copy().setRawPredictionCol(name).setProbabilityCol("").setPredictionCol("").transform(out)
        held = [vector_to_array(n) for n in names]
        out = out.withColumn("_votes", F.array(*(sum((v[c] for v in held[1:]), held[0][c]) for c in range(self.numClasses)))).drop(*names)
        said = (F.array_position("_votes", F.array_max("_votes")) - 1).cast("double")
        share = F.transform("_votes", lambda v: v / self.getNumTrees)
        return out.withColumns({"rawPrediction": array_to_vector("_votes"), "probability": array_to_vector(share), "prediction": said}).drop("_votes")


def parts_of(model: RandomForestClassificationModel | Grove) -> list[RandomForestClassificationModel]:
    return model.parts if isinstance(model, Grove) else [model]


def side_by_side(work, items: list) -> list:
    with ThreadPoolExecutor(len(items)) as pool:
        return list(pool.map(inheritable_thread_target(SparkSession.active())(work), items))


class Forest:
    """Fills, encoding and forest, fitted together on a training slice."""

    def __init__(self, numeric: list[str], categorical: list[str], fills: dict, encoding: PipelineModel, model: RandomForestClassificationModel | Grove):
        self.numeric, self.categorical, self.fills, self.encoding, self.model = numeric, categorical, fills, encoding, model
        self.facts: dict = {}

    @staticmethod
    def _filled(rows: DataFrame, numeric: list[str], fills: dict) -> DataFrame:
        missing = {c: F.lit(None).cast("double" if c in numeric else "string") for c in fills if c not in rows.columns}
        rows = rows.withColumns(missing) if missing else rows
        return rows.withColumns({c: F.col(c).cast("double") for c in numeric}).fillna(fills)

    @classmethod
    def fit(cls, rows: DataFrame, trees: int = 100, depth: int | None = 20, leaf: int = 5, seed: int = 42, numeric: list[str] | None = None, categorical: list[str] | None = None) -> Forest:
        if numeric is None or categorical is None:
            numeric, categorical = features.default_inputs(rows)
        fills = features.Fills(rows, numeric, categorical).values
        filled = cls._filled(rows, numeric, fills)
        encoding = features.encoder(categorical, numeric).fit(filled)
        label = F.array_position(F.lit(contract.CLASSES), F.col(contract.TARGET)) - 1
        weight = F.create_map(*[F.lit(x) for pair in COST.items() for x in pair])[F.col(contract.TARGET)]
        ready = encoding.transform(filled).select("features", label.cast("double").alias("_label"), weight.alias("_weight")).where("_label >= 0").persist()
        try:
            deepest = min(depth or DEEPEST, DEEPEST)
            fits, tasks = shares(trees, deepest, leaf, ready.count(), rows.sparkSession.sparkContext.defaultParallelism)
            slices = ready.coalesce(tasks) if len(fits) > 1 else ready

            def grown(i: int) -> RandomForestClassificationModel:
                forest = RandomForestClassifier(labelCol="_label", weightCol="_weight", numTrees=fits[i], maxDepth=deepest, minInstancesPerNode=leaf, seed=seed + i, maxBins=64, cacheNodeIds=True)
                return forest.fit(slices)

            models = side_by_side(grown, list(range(len(fits))))
            return cls(numeric, categorical, fills, encoding, models[0] if len(models) == 1 else Grove(models))
        finally:
            ready.unpersist()

    def filled(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the fills of the training slice for what lacks."""
        return self._filled(rows, self.numeric, self.fills)

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` with probability and previsto."""
        raw = self.model.transform(self.encoding.transform(self.filled(rows)))
        said = F.element_at(F.lit(contract.CLASSES), F.col("prediction").cast("int") + 1)
        kept = [F.col(c) for c in rows.columns if c not in ("probability", "previsto")]
        return raw.withColumn("previsto", said).select(*kept, "probability", "previsto")

    def importance(self) -> DataFrame:
        """Importance folded back to the source columns."""
        spark = SparkSession.getActiveSession()
        names = features.slots(self.encoding, self.categorical, self.numeric)
        found = self.model.featureImportances if isinstance(self.model, Grove) else self.model.featureImportances.toArray()
        rows = [(n, float(v)) for n, v in zip(names, found, strict=True)]
        return spark.createDataFrame(rows, "variavel string, importancia double").groupBy("variavel").agg(F.sum("importancia").alias("importancia")).orderBy(F.desc("importancia"), "variavel")

    def save(self, path: str, **facts) -> None:
        """Pipeline, forest, and one row of what is known of them; ``facts`` as ``facts_of`` gives, or any other."""
        spark = SparkSession.getActiveSession()
        self.encoding.write().overwrite().save(f"{path}/encoding")
        parts = parts_of(self.model)
        for i, part in enumerate(parts):
            part.write().overwrite().save(f"{path}/forest{i or ''}")
        known = {"partes": len(parts), "assinatura": contract.signature(), "numericas": self.numeric, "categoricas": self.categorical, "preenchimento": self.fills, **facts}
        spark.createDataFrame([(json.dumps(known, sort_keys=True, default=str),)], "metadados string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Forest:
        known = json.loads(spark.read.text(f"{path}/metadata").first()[0])
        if known["assinatura"] != contract.signature():
            raise ValueError("the model was trained under another data contract")
        parts = [RandomForestClassificationModel.load(f"{path}/forest{i or ''}") for i in range(known.get("partes", 1))]
        model = cls(known["numericas"], known["categoricas"], known["preenchimento"], PipelineModel.load(f"{path}/encoding"), parts[0] if len(parts) == 1 else Grove(parts))
        model.facts = known
        return model


def facts_of(rows: DataFrame) -> dict:
    """What a saved model says of its training rows: how many, the years, each class, the groups, and a hash that the order of rows does not change.

    One pass; the groups are a handful by contract.
    """
    row = F.xxhash64(*sorted(rows.columns))
    found = rows.agg(
        F.count("*").alias("linhas"), F.min("ano").alias("ano_inicial"), F.max("ano").alias("ano_final"), *(F.count_if(F.col(contract.TARGET) == c).alias(f"_{c}") for c in contract.CLASSES),
        F.array_sort(F.collect_set("grupo_desastre")).alias("grupos"), F.coalesce(F.bit_xor(row), F.lit(0)).alias("_x"), F.coalesce(F.sum(F.shiftright(row, 16)), F.lit(0)).alias("_s"),
    ).first().asDict()
    classes = {c: found.pop(f"_{c}") for c in contract.CLASSES}
    return {"dados_hash": f"{found.pop('_x') & (2**64 - 1):016x}{found.pop('_s') & (2**64 - 1):016x}", "classes": classes, **found}


def evaluate(model: Forest, rows: DataFrame) -> DataFrame:
    return metrics.summary(metrics.confusion(model.transform(rows).select(F.col(contract.TARGET).alias("real"), "previsto")))
