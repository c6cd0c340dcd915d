"""Months as whole numbers: January 1900 is 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_index(year: Column, month: Column) -> Column:
    return ((year - 1900) * 12 + month - 1).cast("int")


def year_of(index: Column) -> Column:
    return (F.floor(index / 12) + 1900).cast("int")


def month_of(index: Column) -> Column:
    return (F.pmod(index, F.lit(12)) + 1).cast("int")


def previous_month(month: Column) -> Column:
    return (F.pmod(month - 2, F.lit(12)) + 1).cast("int")
