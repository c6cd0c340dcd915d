"""A forest as a relation: its nodes as rows, votes by descent through them, importance by sums over nodes.

The pipeline's own ``transform`` is the fast way to score. The relation is for what it
does not give: which nodes a row passes, which split weighs how much, and a check of one
against the other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardspark.functions.storage import fresh, written
from hazardspark.operators import features
from hazardspark.operators.training import Forest, parts_of, side_by_side

PLACE = ["arvore", "no"]
#: Rows and nodes that meet in one task, about; a tree is never parted.
ROWS, NODES = 1 << 15, 1 << 18


def nodes(forest: Forest, spark: SparkSession | None = None) -> DataFrame:
    """One row for each node, read from the saved model, so that no tree passes the driver.

    arvore, no (0: the root), variavel and posicao (source column and place in the vector
    of what is split), limiar (values up to it go left) or categorias (these go left),
    esquerda and direita (null in leaves), votos (shares of the classes), peso (weighted
    training rows), impureza, ganho.
    """
    spark = spark or SparkSession.getActiveSession()
    path, parts = fresh(spark, "forest"), parts_of(forest.model)
    side_by_side(lambda i: parts[i].write().save(f"{path}/{i}"), list(range(len(parts))))
    first = np.cumsum([0, *(p.getNumTrees for p in parts)]).tolist()
    saved = [spark.read.parquet(f"{path}/{i}/data").select((F.col("treeID") + first[i]).alias("treeID"), "nodeData") for i in range(len(parts))]
    n, split = "nodeData", "nodeData.split"
    inner, graded = F.col(f"{n}.leftChild") >= 0, F.col(f"{split}.numCategories") < 0
    names = features.slots(forest.encoding, forest.categorical, forest.numeric)
    weight = F.aggregate(F.col(f"{n}.impurityStats"), F.lit(0.0), lambda a, v: a + v)
    at = F.col(f"{split}.featureIndex")
    return written(
        reduce(DataFrame.unionByName, saved).select(
            F.col("treeID").alias("arvore"), F.col(f"{n}.id").alias("no"), F.when(inner, at).alias("posicao"), F.when(inner, F.element_at(F.lit(names), at + 1)).alias("variavel"),
            F.when(inner & graded, F.col(f"{split}.leftCategoriesOrThreshold")[0]).alias("limiar"), F.when(inner & ~graded, F.col(f"{split}.leftCategoriesOrThreshold")).alias("categorias"),
            F.when(inner, F.col(f"{n}.leftChild")).alias("esquerda"), F.when(inner, F.col(f"{n}.rightChild")).alias("direita"),
            F.transform(f"{n}.impurityStats", lambda v: v / weight).alias("votos"), weight.alias("peso"), F.col(f"{n}.impurity").alias("impureza"), F.when(inner, F.col(f"{n}.gain")).alias("ganho"),
        ),
        "nodes",
    )


def _paths(held: pa.Table, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each tree, the numbers of its nodes, and for each row of ``x`` the place of its leaf among ``held``."""
    column = lambda name, lacks: held[name].combine_chunks().fill_null(lacks).to_numpy(zero_copy_only=False)
    tree, no, at = column("arvore", 0).astype(np.int64), column("no", 0).astype(np.int64), column("posicao", 0)
    whole = (tree << 32) + no
    order = np.argsort(whole)
    leaf = held["esquerda"].combine_chunks().is_null().to_numpy(zero_copy_only=False)
    place = lambda name: np.where(leaf, -1, order[np.searchsorted(whole[order], (tree << 32) + column(name, 0)).clip(max=len(order) - 1)])
    left, right, most = place("esquerda"), place("direita"), column("limiar", np.nan)
    lists = held["categorias"].combine_chunks()
    graded = lists.is_null().to_numpy(zero_copy_only=False)
    wide = float(1 << 20)  # above every number of a category
    listed = np.sort(np.repeat(np.arange(len(tree)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)) * wide + lists.flatten().to_numpy(zero_copy_only=False))
    for root in np.flatnonzero(no == 0):
        here, going = np.full(len(x), root), np.arange(len(x))
        while len(going := going[left[here[going]] >= 0]):
            n = here[going]
            value = x[going, at[n]]
            goes = value <= most[n]
            if len(ungraded := np.flatnonzero(~graded[n])):
                key = n[ungraded] * wide + value[ungraded]
                goes[ungraded] = listed[np.searchsorted(listed, key).clip(max=len(listed) - 1)] == key
            here[going] = np.where(goes, left[n], right[n])
        yield int(tree[root]), no, here


def _met(forest: Forest, table: DataFrame, rows: DataFrame, key: list[str], run: Callable, more: list[T.StructField]) -> DataFrame:
    """What ``run`` says of each group of trees and each group of rows: no task holds all rows or all trees."""
    x = vector_to_array("features").alias("_x")
    at = written(forest.encoding.transform(forest.filled(rows)).select(*key, x), "encoded")
    groups, deals = min(forest.model.getNumTrees, -(-table.count() // NODES)), max(1, -(-at.count() // ROWS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    trees = table.select("*", F.pmod("arvore", F.lit(groups)).alias("_group"), every(deals).alias("_deal"))
    dealt = at.select("*", F.pmod(F.xxhash64(*key), F.lit(deals)).cast("int").alias("_deal"), every(groups).alias("_group"))

    def each(nodes_: pa.Table, some: pa.Table) -> pa.Table:
        width = len(some["_x"][0]) if len(some) else 0
        return run(nodes_, some.select(key), some["_x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(some), width))

    pair = ["_group", "_deal"]
    return trees.groupBy(*pair).cogroup(dealt.groupBy(*pair)).applyInArrow(each, T.StructType([*(at.schema[k] for k in key), *more]))


def leaves(forest: Forest, table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The leaf (arvore, no) that each row of ``rows``, by its key, falls into in each tree."""

    def run(held: pa.Table, keys: pa.Table, x: np.ndarray) -> pa.Table:
        found = [(tree, no[here]) for tree, no, here in _paths(held, x)]
        out = pa.concat_tables([keys] * len(found))
        out = out.append_column("arvore", pa.array(np.repeat([t for t, _ in found], len(x)), pa.int32()))
        return out.append_column("no", pa.array(np.concatenate([n for _, n in found]), pa.int32()))

    return _met(forest, table, rows, key, run, [T.StructField(n, T.IntegerType()) for n in PLACE])


def votes(forest: Forest, table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """key and votos: the sum over all trees of the class shares of a row's leaves. ``key`` names a row."""
    classes = forest.model.numClasses

    def run(held: pa.Table, keys: pa.Table, x: np.ndarray) -> pa.Table:
        share = held["votos"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(held), classes)
        total = np.zeros((len(x), classes))
        for _, _, here in _paths(held, x):
            total += share[here]
        return keys.append_column("votos", pa.ListArray.from_arrays(np.arange(0, total.size + 1, classes, dtype=np.int32), total.ravel()))

    found = _met(forest, table, rows, key, run, [T.StructField("votos", T.ArrayType(T.DoubleType()))])
    return found.groupBy(*key).agg(F.array(*(F.sum(F.col("votos")[i]) for i in range(classes))).alias("votos"))


def importance(table: DataFrame) -> DataFrame:
    """variavel, importancia: the decrease of impurity by each source column's splits, every tree weighing the same; sums to 1."""
    gains = table.where("esquerda IS NOT NULL").groupBy("arvore", "variavel").agg(F.sum(F.col("ganho") * F.col("peso")).alias("g"))
    tree = F.sum("g").over(Window.partitionBy("arvore"))  # a row for each source column
    shares = gains.withColumn("s", F.coalesce(F.col("g") / F.nullif(tree, F.lit(0.0)), F.lit(0.0))).groupBy("variavel").agg(F.sum("s").alias("s"))
    total = F.sum("s").over(Window.partitionBy(F.lit(0)))  # a row for each source column
    return shares.select("variavel", (F.col("s") / total).alias("importancia"))
