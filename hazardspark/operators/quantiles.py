"""Exact medians and modes of many columns at once, without an aggregate that holds their values.

A median is found by narrowing: one pass counts the values of every column in ``BINS``
equal bins of the interval that still holds its middle, with the least and the largest
value of each bin; the next interval is the bin of the middle rank. All columns are
narrowed in the same passes. A bin of one value ends it, whatever its rows; bins of at most
``FEW`` rows are fetched together, as values with counts. Each pass cuts an interval to a
``BINS``-th or less, whatever the distribution. Building these results runs jobs.

Defined results: nulls do not count; infinities count as the ends, NaN as larger than all;
of an even number of values the two middle ones are averaged; a column without a value has
no median and no mode; of equally frequent values the smallest is the mode.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardspark.functions.storage import written

BINS, FEW = 1024, 2000
INFINITE = float("inf")


@dataclass
class _Interval:
    """Where values of some ranks (from 1) of a column lie, after ``below`` smaller ones."""

    column: str
    ranks: set[int]
    low: float
    high: float
    rows: int
    below: int
    found: dict[int, float] = field(default_factory=dict)


def _spread(rows: DataFrame, open_: list[_Interval]) -> DataFrame:
    """i, v, low and high of every value of each interval."""
    pairs = F.array(*(F.struct(F.lit(i).alias("i"), F.col(s.column).alias("v"), F.lit(s.low).alias("low"), F.lit(s.high).alias("high")) for i, s in enumerate(open_)))
    return rows.select(F.explode(pairs).alias("p")).select("p.*").where("v BETWEEN low AND high")


def _narrow(rows: DataFrame, open_: list[_Interval]) -> list[_Interval]:
    """One pass: every interval's ranks go on in their bins."""
    width = F.col("high") / 2 - F.col("low") / 2  # halves, so that it stays finite
    at = F.least(F.floor((F.col("v") / 2 - F.col("low") / 2) / width * BINS), F.lit(BINS - 1))
    counts = _spread(rows, open_).groupBy("i", at.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    by: dict[int, list] = {}
    for r in counts.collect():  # at most BINS for each interval
        by.setdefault(r["i"], []).append(r)
    out = []
    for i, s in enumerate(open_):
        below = s.below
        for r in sorted(by[i], key=lambda r: r["low"]):
            ranks = {k for k in s.ranks if below < k <= below + r["n"]}
            if ranks:
                stuck = (r["low"], r["high"]) == (s.low, s.high)  # neighbours among the numbers
                out.append(_Interval(s.column, ranks, r["low"], r["high"], 0 if stuck else r["n"], below))
            below += r["n"]
    return out


def _fetch(rows: DataFrame, open_: list[_Interval]) -> dict[tuple[str, int], float]:
    """The values of intervals of few rows."""
    found, by = {}, {}
    for r in _spread(rows, open_).groupBy("i", "v").count().collect():  # at most FEW for each interval
        by.setdefault(r["i"], []).append((r["v"], r["count"]))
    for i, s in enumerate(open_):
        below = s.below
        for v, n in sorted(by[i]):
            found |= {(s.column, k): v for k in s.ranks if below < k <= below + n}
            below += n
    return found


def medians(rows: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """The exact median of each column, as a double."""
    if not columns:
        return {}
    rows = written(rows.select(*(F.col(c).cast("double").alias(c) for c in columns)), "medians")
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < INFINITE), F.col(c))
    facts = {"n": F.count, "nan": lambda c: F.count_if(F.isnan(c)), "least": lambda c: F.count_if(F.col(c) == -INFINITE), "most": lambda c: F.count_if(F.col(c) == INFINITE), "low": lambda c: F.min(finite(c)), "high": lambda c: F.max(finite(c))}
    seen = rows.agg(*(f(c).alias(f"{name}{i}") for i, c in enumerate(columns) for name, f in facts.items())).first()
    found: dict[tuple[str, int], float] = {}
    ranks: dict[str, tuple[int, int]] = {}
    open_ = []
    for i, c in enumerate(columns):
        s = {name: seen[f"{name}{i}"] for name in facts}
        if not s["n"]:
            continue
        ranks[c] = ((s["n"] + 1) // 2, s["n"] // 2 + 1)
        top = s["n"] - s["nan"] - s["most"]
        for k in ranks[c]:
            if k <= s["least"] or k > top:
                found[c, k] = -INFINITE if k <= s["least"] else INFINITE if k <= s["n"] - s["nan"] else float("nan")
        inside = {k for k in ranks[c] if s["least"] < k <= top}
        if inside:
            open_.append(_Interval(c, inside, s["low"], s["high"], top - s["least"], s["least"]))
    while open_:
        found |= {(s.column, k): s.low for s in open_ if s.low == s.high for k in s.ranks}
        open_ = [s for s in open_ if s.low != s.high]
        if few := [s for s in open_ if s.rows <= FEW]:
            found |= _fetch(rows, few)
        open_ = [s for s in open_ if s.rows > FEW]
        open_ = _narrow(rows, open_) if open_ else []
    return {c: found[c, ranks[c][0]] / 2 + found[c, ranks[c][1]] / 2 if c in ranks else None for c in columns}


def modes(rows: DataFrame, columns: list[str]) -> dict[str, str | None]:
    """The most frequent value of each column, as text: counted once for all columns, by value, so that no task holds a column."""
    if not columns:
        return {}
    pairs = F.array(*(F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v")) for i, c in enumerate(columns)))
    counts = rows.select(F.explode(pairs).alias("p")).select("p.*").where("v IS NOT NULL").groupBy("i", "v").count()
    most = counts.groupBy("i").agg(F.max("count").alias("n"))
    first = counts.join(F.broadcast(most), "i").where(F.col("count") == F.col("n")).groupBy("i").agg(F.min("v").alias("v"))  # ``most``: a row for each column
    found = {r["i"]: r["v"] for r in first.collect()}
    return {c: found.get(i) for i, c in enumerate(columns)}


def fills(rows: DataFrame, numeric: list[str], categorical: list[str]) -> dict[str, float | str | None]:
    """Median of numbers and mode of categories."""
    return medians(rows, numeric) | modes(rows, categorical)
