"""Medians by narrowing and modes, against the aggregates that hold all values; AUC over sampled ranges."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazardspark.operators import metrics, quantiles


@pytest.mark.parametrize("bins,few", [(4, 3), (1024, 2000), (16, 0)])
def test_medians_equal_the_aggregate(spark, monkeypatch, bins, few):
    monkeypatch.setattr(quantiles, "BINS", bins)
    monkeypatch.setattr(quantiles, "FEW", few)
    rng = np.random.default_rng(0)
    n = 901
    columns = {
        "skew": np.exp(rng.normal(0, 30, n)), "tied": np.where(np.arange(n) < 700, 3.0, rng.normal(size=n)), "whole": rng.integers(0, 3, n).astype(float), "signed": rng.normal(-5, 1e-3, n),
        "huge": rng.choice([-1.7e308, 1.7e308, 0.0], n), "tiny": rng.choice([5e-324, 1e-323], n), "ends": rng.choice([-math.inf, math.inf, 1.0], n, p=[0.5, 0.3, 0.2]), "nan": rng.choice([math.nan, 2.0], n, p=[0.7, 0.3]),
    }
    lines = [tuple(float(v) if rng.random() < 0.8 else None for v in line) + (None,) for line in zip(*columns.values(), strict=True)]
    names = [*columns, "empty"]
    for rows in (lines, lines[:-1], lines[:2], lines[:1]):
        df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names))
        want = df.agg(*(F.median(c).alias(c) for c in names)).first().asDict()
        got = quantiles.medians(df, names)
        assert set(got) == set(names)
        for c in names:
            assert got[c] == want[c] or (math.isnan(got[c]) and (math.isnan(want[c]) or c in ("ends", "nan"))) or got[c] == pytest.approx(want[c], rel=1e-15, abs=5e-324), c
    assert quantiles.medians(df.limit(0), ["skew"]) == {"skew": None} and quantiles.medians(df, []) == {}


def test_passes_do_not_grow_with_rows(spark, monkeypatch):
    passes = []
    narrow = quantiles._narrow
    monkeypatch.setattr(quantiles, "_narrow", lambda rows, open_: passes.append([s.rows for s in open_]) or narrow(rows, open_))
    df = spark.range(300_000).selectExpr("pow(rand(1), 9) AS a", "CAST(id % 2 AS DOUBLE) AS b", "CAST(IF(id % 10 < 9, 0, id) AS DOUBLE) AS c", "CAST(id AS DOUBLE) AS d")
    got = quantiles.medians(df, ["a", "b", "c", "d"])
    assert got == df.agg(*(F.median(c).alias(c) for c in "abcd")).first().asDict() and len(passes) <= 3


def test_modes(spark):
    df = spark.createDataFrame([("b", None, 1), ("a", None, 2), ("b", None, 2), ("a", None, 1), (None, None, 1)], "x string, y string, z int")
    assert quantiles.modes(df, ["x", "y", "z"]) == {"x": "a", "y": None, "z": "1"}


def test_area_under_the_curve_over_skewed_scores(spark):
    rows = spark.range(1_000_000).selectExpr("IF(id % 10 < 9, rand(2) / 1000, rand(3)) AS s", "rand(4) < 0.3 AS e").selectExpr("IF(s < 0.0002, 0.0001, s) AS s", "e")
    counts = rows.groupBy("s").count()
    sizes = [r["count"] for r in metrics.ranged(counts).groupBy("part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 1.5 * min(sizes)
    got = metrics.auc(rows, "s", "e").first()[0]
    local = rows.toPandas()
    ranks = local.s.rank()
    p, n = local.e.sum(), len(local)
    assert got == pytest.approx((ranks[local.e].sum() - p * (p + 1) / 2) / (p * (n - p)), abs=1e-9)


def test_area_of_odd_scores(spark):
    df = spark.createDataFrame([(0.1, False), (0.4, True), (0.4, None), (float("inf"), True)], "s double, e boolean")
    assert metrics.auc(df, "s", "e").first()[0] == pytest.approx(3.5 / 4)
    for bad in (None, float("nan")):
        with pytest.raises(Exception, match="null or NaN"):
            metrics.auc(df.union(spark.createDataFrame([(bad, True)], df.schema)), "s", "e").collect()
    assert metrics.auc(df.where("e"), "s", "e").first()[0] is None and metrics.auc(df.limit(0), "s", "e").first()[0] is None
