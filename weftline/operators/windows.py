"""Window features of a panel. Features over the same keys share one shuffle and one sort where a query takes them together.

Lags mean the previous observed period. Features of a period only use earlier periods.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def series(keys: list[str], t: str = "t") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(t)


def lags(df: DataFrame, w: WindowSpec, columns: list[str], upto: int = 3) -> DataFrame:
    return df.withColumns({f"{c}_lag{k}": F.lag(c, k).over(w) for c in columns for k in range(1, upto + 1)})


def before(w: WindowSpec, k: int) -> WindowSpec:
    return w.rowsBetween(-k, -1)


def past(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def until(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def rolling(df: DataFrame, w: WindowSpec, c: str) -> DataFrame:
    """Means and sample deviations of 2 and 3 periods, extremes and median of 3; short histories use what there is."""
    out = {f"{c}_mean{k}": F.avg(c).over(before(w, k)) for k in (2, 3)} | {f"{c}_std{k}": F.stddev_samp(c).over(before(w, k)) for k in (2, 3)}
    out |= {f"{c}_max3": F.max(c).over(before(w, 3)), f"{c}_min3": F.min(c).over(before(w, 3)), f"{c}_median3": F.percentile(F.col(c), F.lit(0.5)).over(before(w, 3))}
    return df.withColumns(out)


def trends(df: DataFrame, w: WindowSpec, c: str) -> DataFrame:
    a, b = F.lag(c, 1).over(w), F.lag(c, 2).over(w)
    return df.withColumns({f"{c}_momentum": a - b, f"{c}_growth": F.try_divide(a, b + 1), f"{c}_trend": F.avg(c).over(before(w, 3)) - F.avg(c).over(before(w, 2))})


def streak_before(df: DataFrame, w: WindowSpec, flag: Column, name: str) -> DataFrame:
    """Length of the run of true flags that ends at the previous row; null on the first row."""
    # Rows since the last false row, up to each row: row number minus that of the last break.
    row = F.row_number().over(w)
    df = df.withColumn("__row", row).withColumn("__flag", flag)
    broke = F.coalesce(F.last(F.when(~F.col("__flag"), F.col("__row")), ignorenulls=True).over(until(w)), F.lit(0))
    df = df.withColumn("__run", F.col("__row") - broke)
    return df.withColumn(name, F.lag("__run", 1).over(w).cast("long")).drop("__row", "__flag", "__run")


def trailing_streak(df: DataFrame, keys: list[str], flag: Column, name: str, t: str = "t") -> DataFrame:
    """Per key: the run of true flags that ends with its last period."""
    last, broke = F.max(t), F.coalesce(F.max(F.when(~flag, F.col(t))), F.min(t) - 1)
    return df.groupBy(*keys).agg((last - broke).cast("long").alias(name))


def since_last(w: WindowSpec, t: str, flag: Column) -> Column:
    """Periods since the last earlier row with the flag."""
    return F.col(t) - F.last(F.when(flag, F.col(t)), ignorenulls=True).over(past(w))


def frequency_before(w: WindowSpec, flag: Column) -> Column:
    return F.avg(flag.cast("int")).over(past(w))


def ever_before(w: WindowSpec, flag: Column) -> Column:
    return F.coalesce(F.max(flag.cast("int")).over(past(w)), F.lit(0))


def smoothed(df: DataFrame, keys: list[str], c: str, out: str = "ses", alpha: float = 0.3, t: str = "t") -> DataFrame:
    """df with the simple exponential smoothing of the earlier values of c, started at the first; null in the first period.

    A key's series is gathered once, scanned in the order of t and laid out again, so a step costs one pass.
    """
    rest = [x for x in df.columns if x not in [*keys, t]]
    rows = F.array_sort(F.collect_list(F.struct(F.col(t), F.struct(*rest).alias("rest"))))
    value = lambda r: r["rest"][c].cast("double")
    state = F.struct(F.lit(None).cast("double").alias("level"), F.array().cast("array<double>").alias("levels"))
    step = lambda s, r: F.struct(F.coalesce(F.lit(1 - alpha) * s["level"] + F.lit(alpha) * value(r), value(r)).alias("level"), F.concat(s["levels"], F.array(s["level"])).alias("levels"))
    series_ = df.groupBy(*keys).agg(rows.alias("__rows"))
    each = series_.select(*keys, F.explode(F.arrays_zip(F.col("__rows").alias("r"), F.aggregate("__rows", state, step, lambda s: s["levels"]).alias("s"))).alias("__e"))
    return each.select(*keys, F.col("__e.r")[t].alias(t), *[F.col("__e.r.rest")[x].alias(x) for x in rest], F.col("__e.s").alias(out)).select(*df.columns, out)


def share_of_total(part: Column, total: Column) -> Column:
    return F.when(F.coalesce(total, F.lit(0)) > 0, part / total).otherwise(F.lit(0.0))


def aggregate_lags(panel: DataFrame, keys: list[str], prefix: str, aggregates: dict[str, Column], t: str = "t") -> DataFrame:
    """Aggregates by (keys, t), lagged by 1 and 2, with growth and a mean of 3, joined back to the rows."""
    w = series(keys, t)
    got = panel.groupBy(*keys, t).agg(*[c.alias(f"{prefix}_{n}") for n, c in aggregates.items()])
    main = f"{prefix}_{next(iter(aggregates))}"
    out = {f"{prefix}_{n}_lag{k}": F.lag(f"{prefix}_{n}", k).over(w) for n in aggregates for k in (1, 2)}
    a, b = F.lag(main, 1).over(w), F.lag(main, 2).over(w)
    out |= {f"{main}_growth": F.try_divide(a - b, b + 1), f"{main}_mean3": F.avg(main).over(before(w, 3))}
    return panel.join(got.withColumns(out).drop(*[f"{prefix}_{n}" for n in aggregates]), [*keys, t], "left")


def batches(df: DataFrame, order: list[str], size: int = 15, coarse: Column | None = None) -> DataFrame:
    """batch and id in batch (0-based), rows taken by (coarse, order).

    Rows are numbered inside each value of coarse and offset by the counts before it, so no task sorts all rows; by
    default coarse is one of 1,024 hash classes, a coarse part of the order itself keeps the order global. The offsets come
    from one row per value of coarse, in one task, so coarse should have thousands of values, not millions.
    """
    part = coarse if coarse is not None else F.pmod(F.xxhash64(*order), F.lit(1024))
    df = df.withColumn("__part", part)
    counts = df.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    offset = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    row = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1 + F.col("__offset")
    df = df.join(counts.select("__part", offset.alias("__offset")), "__part").withColumn("__row", row)
    return df.withColumn("batch", F.floor(F.col("__row") / size).cast("long")).withColumn("id", (F.col("__row") % size).cast("int")).drop("__part", "__offset", "__row")
