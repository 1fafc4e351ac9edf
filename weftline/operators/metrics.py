"""Forecast accuracy: tolerance metric, errors, buckets, blending and leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.calendar import bucket

#: Volume buckets.
LIMITS, LABELS = [0.5, 5.5, 20.5, 100.5], ["0", "1-5", "6-20", "21-100", "100+"]
TOLERANCE = 0.2


def correct(actual: Column, forecast: Column, tolerance: float = TOLERANCE) -> Column:
    """The forecast, rounded half to even, is within the tolerance; zero must be met exactly."""
    r = F.rint(forecast)
    return F.when(actual == 0, r == 0).otherwise(F.abs(r - actual) <= F.lit(tolerance) * actual)


def business_accuracy(actual: Column, forecast: Column) -> Column:
    return F.avg(correct(actual, forecast).cast("int")) * 100


def errors(df: DataFrame, keys: list[str], actual: str, forecast: str) -> DataFrame:
    """MAE, RMSE, WAPE and R2 per key, in one pass; R2 is null without variance."""
    e, y = F.col(forecast) - F.col(actual), F.col(actual).cast("double")
    got = df.groupBy(*keys).agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (F.try_divide(F.sum(F.abs(e)), F.sum(F.abs(y))) * 100).alias("wape"),
        F.sum(e * e).alias("__res"), (F.var_pop(y) * F.count(y)).alias("__tot"),
    )
    return got.withColumn("r2", F.when(F.col("__tot") > 0, 1 - F.col("__res") / F.col("__tot"))).drop("__res", "__tot")


def volume_bucket(x: Column) -> Column:
    return bucket(x, LIMITS, LABELS)


def stable(mean3: Column, std3: Column, volume: float | Column = 50.0, cutoff: float | Column = 0.5) -> Column:
    """Rows whose last period is a good forecast: large, or steady relative to their mean."""
    v = volume if isinstance(volume, Column) else F.lit(volume)
    c = cutoff if isinstance(cutoff, Column) else F.lit(cutoff)
    m = F.coalesce(mean3, F.lit(-1.0))
    cov = F.coalesce(std3 / F.nullif(mean3, F.lit(0.0)), F.lit(float("inf")))
    return (m > v) | ((m > 0) & (cov < c))


def long_predictions(wide: DataFrame, keys: list[str], actual: str, models: list[str]) -> DataFrame:
    """(keys, actual, model, predicted, abs_error, correct): abs_error of the rounded, correct of the raw forecast."""
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).cast("double").alias("predicted")) for m in models])).alias("p")
    out = wide.select(*keys, F.col(actual).alias("actual"), rows).select(*keys, "actual", "p.*").filter(F.col("predicted").isNotNull())
    return out.withColumn("abs_error", F.abs(F.rint("predicted") - F.col("actual"))).withColumn("correct", correct(F.col("actual"), F.col("predicted")))


def fit_counts(predictions: DataFrame) -> DataFrame:
    got = predictions.groupBy("model", "fold").agg(F.count_if("correct").alias("fits"), F.count_if(~F.col("correct")).alias("incorrect"), F.count(F.lit(1)).alias("total"))
    return got.withColumn("pct_fit", F.round(F.col("fits") / F.col("total") * 100, 2))


def leaderboard(predictions: DataFrame, folds: list[int]) -> DataFrame:
    """Accuracy per model and fold, pivoted, and the mean of the folds' means."""
    got = predictions.groupBy("model").pivot("fold", folds).agg(F.avg(F.col("correct").cast("int")) * 100)
    got = got.withColumnsRenamed({str(f): f"fold_{f}" for f in folds})
    parts = [F.col(f"fold_{f}") for f in folds]
    return got.withColumn("mean_accuracy", sum(parts[1:], parts[0]) / len(folds))


def sweep(df: DataFrame, actual: str, model: str, lag: str, mean3: str, std3: str, volumes: list[float], cutoffs: list[float]) -> DataFrame:
    """Accuracy of the blend for every pair of thresholds: the few pairs are exploded onto the rows."""
    grid = F.explode(F.array(*[F.struct(F.lit(float(v)).alias("volume"), F.lit(float(c)).alias("cutoff")) for v in volumes for c in cutoffs])).alias("g")
    rows = df.select("*", grid)
    use = F.when(stable(F.col(mean3), F.col(std3), F.col("g.volume"), F.col("g.cutoff")), F.col(lag)).otherwise(F.col(model))
    return rows.withColumn("__p", use).groupBy("g.volume", "g.cutoff").agg(business_accuracy(F.col(actual), F.col("__p")).alias("accuracy"))


def best_of(results: DataFrame, metric: str, order: list[str]) -> DataFrame:
    """The row of the highest metric; the first in the stated order on ties."""
    return results.orderBy(F.desc(metric), *order).limit(1)
