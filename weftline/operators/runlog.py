"""Counters of a run, taken while its rows pass: no second scan."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class RunLog:
    """Counts named conditions of the rows of a DataFrame as it is written; lines() tells rate and shares afterwards."""

    def __init__(self, name: str):
        self.name, self.began, self.seen = name, time.time(), Observation(name)

    def watch(self, df: DataFrame, **conditions: Column) -> DataFrame:
        return df.observe(self.seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(n) for n, c in conditions.items()])

    def lines(self) -> list[str]:
        got, took = self.seen.get, max(time.time() - self.began, 1e-9)
        rows = got["rows"]
        out = [f"{self.name}: {rows} rows in {took:.1f} s, {rows / took:.1f} a second"]
        return out + [f"{self.name}: {k} {v} ({v / rows:.1%})" if rows else f"{self.name}: {k} {v}" for k, v in got.items() if k != "rows"]
