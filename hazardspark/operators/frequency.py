"""A plain model to hold forests against: classes by how often, and how dearly, they came up in like rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardspark import contract
from hazardspark.functions.storage import written
from hazardspark.operators.costs import COST

KEYS = ("grupo_desastre", "regiao", "mes")


def votes(target: str = contract.TARGET) -> Column:
    """Rows of each class times what a miss of it costs, in class order; an aggregate."""
    return F.array(*(F.count_if(F.col(target) == c) * F.lit(COST[c]) for c in contract.CLASSES))


class Frequent:
    """Cells of the first ``depth`` keys; a cell of fewer than ``leaf`` rows leaves its rows to the cell of one key less.

    The cells are one rollup of the training rows, written once. A null key is a value of
    its own; classes of equal weight go to the milder one.
    """

    def __init__(self, keys: tuple[str, ...], cells: DataFrame):
        self.keys, self.cells = keys, cells

    @staticmethod
    def _keyed(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        return rows.withColumns({f"_k{i}": F.coalesce(F.col(k).cast("string"), F.lit("")) for i, k in enumerate(keys)}) if keys else rows

    @classmethod
    def fit(cls, rows: DataFrame, depth: int | None = None, leaf: int = 5, keys: tuple[str, ...] = KEYS) -> Frequent:
        """Fit on ``rows``; those without a known class do not count. No such row at all is an error."""
        keys = keys[: len(keys) if depth is None else depth]
        names = [f"_k{i}" for i in range(len(keys))]
        known = cls._keyed(rows.where(F.col(contract.TARGET).isin(*contract.CLASSES)), keys)
        sums = (F.count("*").alias("n"), votes().alias("votos"))
        if keys:
            level = len(keys) - F.bit_count(F.grouping_id())
            cells = known.rollup(*names).agg(level.cast("int").alias("nivel"), *sums)
        else:
            cells = known.groupBy().agg(F.lit(0).alias("nivel"), *sums)
        model = cls(keys, written(cells.where((F.col("n") >= leaf) | ((F.col("nivel") == 0) & (F.col("n") > 0))), "cells"))
        if model.cells.where("nivel = 0").isEmpty():
            raise ValueError("there is no row to learn from")
        return model

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` with probability (an array in class order) and previsto."""
        kept = [c for c in rows.columns if c not in ("probability", "previsto")]
        out = self._keyed(rows.select(*kept), self.keys)
        found = []
        for level in range(len(self.keys), -1, -1):
            names = [f"_k{i}" for i in range(level)]
            cells = self.cells.where(F.col("nivel") == level).select(*names, F.col("votos").alias(f"_v{level}"))
            out = out.join(cells, names, "left") if names else out.crossJoin(F.broadcast(cells))  # one row
            found.append(F.col(f"_v{level}"))
        out = out.withColumn("_v", F.coalesce(*found))
        total = F.aggregate("_v", F.lit(0.0), lambda a, v: a + v)
        said = F.element_at(F.lit(contract.CLASSES), F.array_position("_v", F.array_max("_v")).cast("int"))
        return out.select(*kept, F.transform("_v", lambda v: v / total).alias("probability"), said.alias("previsto"))

    def table(self) -> DataFrame:
        """The cells by key: null where a cell does not look at it."""
        said = F.element_at(F.lit(contract.CLASSES), F.array_position("votos", F.array_max("votos")).cast("int"))
        return self.cells.select("nivel", *(F.col(f"_k{i}").alias(k) for i, k in enumerate(self.keys)), "n", said.alias("previsto"))

