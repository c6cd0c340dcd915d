"""Derived columns, and the preparation of model inputs."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardspark import contract
from hazardspark.operators import quantiles

#: Disjoint band -> (wider count, narrower count).
BANDS = {"ocorrencias_13_a_24m": ("ocorrencias_24m", "ocorrencias_12m"), "ocorrencias_25_a_60m": ("ocorrencias_60m", "ocorrencias_24m")}


def derive(rows: DataFrame) -> DataFrame:
    """Cyclic month, occurrences a year, share recognised, mean severity."""
    angle = F.col("mes") * (2 * math.pi / 12)
    total = F.nullif("ocorrencias_total_historico", F.lit(0))
    share = F.least(F.greatest(F.col("reconhecimentos_historico") / total, F.lit(0.0)), F.lit(1.0))
    return rows.withColumns({
        "mes_seno": F.sin(angle), "mes_cosseno": F.cos(angle),
        "ocorrencias_por_ano": F.col("ocorrencias_total_historico") / F.greatest("anos_de_historico", F.lit(1.0)),
        "proporcao_reconhecidas": F.coalesce(share, F.lit(0.0)), "gravidade_media_historica": F.coalesce(F.col("afetados_historico") / total, F.lit(0.0)),
    })


def bands(rows: DataFrame) -> DataFrame:
    return rows.withColumns({name: F.greatest(F.col(wide) - F.col(narrow), F.lit(0)).cast("double") for name, (wide, narrow) in BANDS.items()})


class Fills:
    """Exact medians and modes of a training slice, put in for nulls."""

    def __init__(self, rows: DataFrame, numeric: list[str], categorical: list[str]):
        found = quantiles.fills(rows, numeric, categorical)
        self.numeric, self.categorical = numeric, categorical
        self.values = {c: found[c] if found[c] is not None else (0.0 if c in numeric else "") for c in found}

    def apply(self, rows: DataFrame) -> DataFrame:
        missing = {c: F.lit(None).cast("double" if c in self.numeric else "string") for c in [*self.numeric, *self.categorical] if c not in rows.columns}
        rows = rows.withColumns(missing) if missing else rows
        return rows.withColumns({c: F.col(c).cast("double") for c in self.numeric}).fillna(self.values)


def encoder(categorical: list[str], numeric: list[str]) -> Pipeline:
    """One-hot categories (unseen: all zero) and numbers in one vector."""
    index = StringIndexer(inputCols=categorical, outputCols=[f"_i_{c}" for c in categorical], handleInvalid="keep", stringOrderType="alphabetAsc")
    hot = OneHotEncoder(inputCols=[f"_i_{c}" for c in categorical], outputCols=[f"_h_{c}" for c in categorical], dropLast=True, handleInvalid="error")
    return Pipeline(stages=[index, hot, VectorAssembler(inputCols=[*numeric, *(f"_h_{c}" for c in categorical)], outputCol="features")])


def slots(model: PipelineModel, categorical: list[str], numeric: list[str]) -> list[str]:
    """The source column of each place of the vector."""
    labels = model.stages[0].labelsArray
    return [*numeric, *(c for c, ls in zip(categorical, labels, strict=True) for _ in ls)]


def default_inputs(rows: DataFrame) -> tuple[list[str], list[str]]:
    return [c for c in contract.MODEL_NUMERIC if c in rows.columns], [c for c in contract.MODEL_CATEGORICAL if c in rows.columns]
