"""YYYYMM months as integers, and small numeric rules. Null in, null out."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def yyyymm(ts: Column) -> Column:
    return (F.year(ts) * 100 + F.month(ts)).cast("int")


def month_index(date: Column) -> Column:
    """Months since year 0, so that differences count calendar months."""
    return (F.floor(date / 100) * 12 + date % 100).cast("int")


def index_month(index: Column) -> Column:
    return (F.floor((index - 1) / 12) * 100 + (index - 1) % 12 + 1).cast("int")


def month_of(date: Column) -> Column:
    return (date % 100).cast("int")


def year_of(date: Column) -> Column:
    return F.floor(date / 100).cast("int")


def quarter_of(date: Column) -> Column:
    return F.floor((date % 100 + 2) / 3).cast("int")


def month_sin(date: Column) -> Column:
    return F.sin(F.lit(2 * math.pi) * month_of(date) / 12)


def month_cos(date: Column) -> Column:
    return F.cos(F.lit(2 * math.pi) * month_of(date) / 12)


def clip_low(x: Column, low: float = 0) -> Column:
    """greatest() skips nulls, so they are kept by hand."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(low).cast("long") if isinstance(low, int) else F.lit(low)))


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def bucket(x: Column, limits: list[float], labels: list[str]) -> Column:
    """Half-open buckets (limit[i-1], limit[i]]; the last label takes what is above all limits."""
    out = None
    for limit, label in zip(limits, labels, strict=False):
        out = F.when(x <= limit, label) if out is None else out.when(x <= limit, label)
    return F.when(x.isNotNull(), out.otherwise(labels[len(limits)]))
