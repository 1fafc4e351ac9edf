"""Dense item x warehouse x month panels and roll-ups.

Facts are reduced to the panel's grain before they are joined, so keys cannot fan out; the month table has one row
per month of the window and is the only side that is broadcast by hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import calendar as cal

KEYS = ["date", "item", "wh"]


def sales_facts(rows: DataFrame) -> DataFrame:
    """rows (date, item, wh, qty, is_return) -> one row per key with net_sales, returns and positive_sales."""
    signed = F.when(F.col("is_return"), -F.col("qty")).otherwise(F.col("qty"))
    got = rows.groupBy(*KEYS).agg(F.sum(signed).alias("net_sales"), F.sum(F.when(F.col("is_return"), F.col("qty")).otherwise(F.lit(0).cast("long"))).alias("returns"))
    return got.withColumn("positive_sales", cal.clip_low(F.col("net_sales")))


def collapse_duplicates(rows: DataFrame, keys: list[str], value: str, flag: str) -> DataFrame:
    """One row per key: the largest value, and whether any row was flagged."""
    return rows.groupBy(*keys).agg(F.max(value).alias(value), F.bool_or(F.col(flag)).alias(flag))


def dense_months(dates: DataFrame) -> DataFrame:
    """(date, t): distinct months numbered in order; one row per month."""
    return dates.select("date").distinct().withColumn("t", F.row_number().over(Window.orderBy("date")))


def dense_grid(pairs: DataFrame, months: DataFrame) -> DataFrame:
    return pairs.crossJoin(F.broadcast(months))


def dense_panel(sales: DataFrame, outage: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """Every (item, wh) seen in either table in every month of the sales, zero where nothing was recorded.

    ``segments`` (item, attributes) is joined to all warehouses of an item; an item with two of them raises an error.
    """
    pairs = sales.select("item", "wh").unionByName(outage.select("item", "wh")).distinct()
    grid = dense_grid(pairs, dense_months(sales))
    zero = F.lit(0).cast("long")
    out = grid.join(sales, KEYS, "left").join(outage.select(*KEYS, "outage"), KEYS, "left")
    out = out.select(*KEYS, "t", *[F.coalesce(c, zero).alias(c) for c in ("net_sales", "returns", "positive_sales")], F.coalesce("outage", F.lit(0)).alias("outage"))
    return out if segments is None else with_attributes(out, segments, ["item"])


def facts(rows: DataFrame) -> DataFrame:
    """rows (date, item, wh, qty, is_return, is_out) -> sales and outages of a key together, in one aggregation."""
    signed = F.when(F.col("is_return"), -F.col("qty")).otherwise(F.col("qty"))
    returned = F.when(F.col("is_return"), F.col("qty")).otherwise(F.lit(0).cast("long"))
    return rows.groupBy(*KEYS).agg(F.sum(signed).alias("net_sales"), F.sum(returned).alias("returns"), F.max(F.col("is_out").cast("int")).alias("outage"))


def dense_from_facts(table: DataFrame) -> DataFrame:
    """The dense panel from facts(): one shuffle by (item, wh), which the windows over these keys need anyway.

    A pair's months are gathered in one map (as many entries as there are months at most) and looked up for every month.
    """
    months = table.agg(F.array_sort(F.collect_set("date")).alias("months"))  # one row
    cell = F.struct("net_sales", "returns", "outage")
    pairs = table.groupBy("item", "wh").agg(F.map_from_entries(F.collect_list(F.struct("date", cell))).alias("cells"))
    grid = pairs.crossJoin(F.broadcast(months)).select("item", "wh", "cells", F.posexplode("months").alias("at", "date"))
    found = grid.select("date", "item", "wh", (F.col("at") + 1).cast("int").alias("t"), F.element_at("cells", F.col("date")).alias("c"))
    value = lambda c, zero: F.coalesce(F.col("c")[c], zero).alias(c)
    out = found.select(*KEYS, "t", value("net_sales", F.lit(0).cast("long")), value("returns", F.lit(0).cast("long")), value("outage", F.lit(0)))
    return out.select(*KEYS, "t", "net_sales", "returns", cal.clip_low(F.col("net_sales")).alias("positive_sales"), "outage")


def with_calendar(df: DataFrame, date: str = "date") -> DataFrame:
    d = F.col(date)
    return df.withColumns({"year": cal.year_of(d), "month": cal.month_of(d), "quarter": cal.quarter_of(d), "month_sin": cal.month_sin(d), "month_cos": cal.month_cos(d)})


def item_month(panel: DataFrame) -> DataFrame:
    """Panel rolled up to (item, date)."""
    got = panel.groupBy("item", "date", "t").agg(
        F.sum("net_sales").alias("sales"), F.sum("positive_sales").alias("positive_sales"), F.sum("returns").alias("returns"), F.avg("outage").alias("mean_outage"),
        F.max("outage").alias("any_outage"), F.count_distinct("wh").alias("n_wh"), F.count_if(F.col("outage") > 0).alias("wh_affected"),
    )
    return got.withColumn("pct_wh_affected", F.col("wh_affected") / F.col("n_wh"))


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Distinct on keys with a stated order, unlike dropDuplicates."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that occur more than once; empty where a join on them cannot fan out."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def unique_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key with its other columns; a key that occurs twice raises an error when it is read."""
    rest = [c for c in df.columns if c not in keys]
    name = F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    got = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *[F.first(c).alias(c) for c in rest])
    checked = F.when(F.col("__n") == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("key occurs more than once: "), name)).cast("boolean"))
    return got.filter(checked).drop("__n")


def with_attributes(df: DataFrame, attributes: DataFrame, keys: list[str]) -> DataFrame:
    """df with the attributes of its keys, null where there are none; the attributes' keys must be unique."""
    return df.join(unique_rows(attributes, keys), keys, "left")


def pivoted(df: DataFrame, keys: list[str], period: str, value: str, periods, *more) -> DataFrame:
    """One row per key with a column t<k> for each of the periods, and further aggregates, in one aggregation.

    A key that has a period twice raises an error.
    """
    columns = [F.max(F.when(F.col(period) == k, F.col(value))).alias(f"t{k}") for k in periods]
    got = df.groupBy(*keys).agg(F.count(period).alias("__n"), F.size(F.collect_set(period)).alias("__distinct"), *more, *columns)
    checked = F.when(F.col("__n") == F.col("__distinct"), F.lit(True)).otherwise(F.raise_error(F.lit("a key has a period twice")).cast("boolean"))
    return got.filter(checked).drop("__n", "__distinct")
