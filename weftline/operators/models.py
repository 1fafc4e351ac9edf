"""Walk-forward forecasting with MLlib: boosted trees, a total times share model and a hurdle model.

Early stopping and choices use the last training period, never the test period.
"""

from __future__ import annotations

import random

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import SQLTransformer, StringIndexer, TargetEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators import metrics

FOLDS = [(1, 5, 6), (2, 6, 7), (3, 7, 8)]
SMOOTHING = 20.0


def last_folds(n: int) -> list[tuple[int, int, int]]:
    """Three expanding folds (number, last training period, test period) that end with period n; FOLDS for n = 8."""
    return [(k, n - 4 + k, n - 3 + k) for k in (1, 2, 3)]


def with_folds(df: DataFrame, folds: list[tuple[int, int, int]] = FOLDS, t: str = "t") -> DataFrame:
    """Rows with (fold, is_test) for every expanding fold (number, last training period, test period) they are in."""
    of = F.explode(F.filter(F.array(*[F.struct(F.lit(n).alias("fold"), F.lit(last).alias("last"), F.lit(test).alias("test")) for n, last, test in folds]), lambda f: (F.col(t) <= f["last"]) | (F.col(t) == f["test"]))).alias("f")
    return df.select("*", of).withColumn("fold", F.col("f.fold")).withColumn("is_test", F.col(t) == F.col("f.test")).drop("f")


def pipeline(features: list[str], categories: list[str], label: str, loss: str = "absolute", trees: int = 12, depth: int = 4, seed: int = 42, entities: tuple[str, ...] = ()) -> Pipeline:
    """Small categories are indexed; entities, which may have any number of values, become their mean label in training, drawn
    towards the mean of all by SMOOTHING rows (an unseen one gets that mean).
    """
    stages = [StringIndexer(inputCol=c, outputCol=f"__{c}", handleInvalid="keep") for c in (*categories, *entities)]
    if entities:
        stages.append(TargetEncoder(inputCols=[f"__{c}" for c in entities], outputCols=[f"__{c}_mean" for c in entities], labelCol=label, targetType="continuous", smoothing=SMOOTHING, handleInvalid="keep"))
        levels = ", ".join(f"`__{c}_mean` + 0D AS `__{c}_level`" for c in entities)  # a sum has no category marks, which trees would go by
        stages.append(SQLTransformer(statement=f"SELECT *, {levels} FROM __THIS__"))
    stages.append(VectorAssembler(inputCols=[*features, *(f"__{c}" for c in categories), *(f"__{c}_level" for c in entities)], outputCol="__features", handleInvalid="keep"))
    if loss == "huber":
        stages.append(LinearRegression(featuresCol="__features", labelCol=label, predictionCol="__prediction", loss="huber", maxIter=trees))
    else:
        stages.append(GBTRegressor(featuresCol="__features", labelCol=label, predictionCol="__prediction", lossType=loss, maxIter=trees, maxDepth=depth, maxBins=64, seed=seed, validationIndicatorCol="__valid"))
    return Pipeline(stages=stages)


def prepared(df: DataFrame, features: list[str]) -> DataFrame:
    """Missing features as -1, which trees can split off."""
    return df.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(-1.0)) for f in features})


def forecast(train: DataFrame, test: DataFrame, features: list[str], categories: list[str], target: str, out: str, t: str = "t", log: bool = True, **options) -> DataFrame:
    """test with the forecast of a model fitted on train; the last training period decides when boosting stops."""
    label = F.log1p(F.greatest(F.col(target).cast("double"), F.lit(0.0))) if log else F.col(target).cast("double")
    last = train.agg(F.max(t)).first()[0]
    fit = pipeline(features, categories, "__label", **options).fit(prepared(train, features).withColumn("__label", label).withColumn("__valid", F.col(t) == last))
    got = fit.transform(prepared(test, features))
    value = F.expm1("__prediction") if log else F.col("__prediction")
    return got.withColumn(out, F.greatest(value, F.lit(0.0))).select(*test.columns, out)


def walk_forward(df: DataFrame, features: list[str], categories: list[str], target: str, folds: list[tuple[int, int, int]] = FOLDS, t: str = "t", **options) -> DataFrame:
    out = None
    for n, last, test in folds:  # a fixed, small number of folds
        got = forecast(df.filter(F.col(t) <= last), df.filter(F.col(t) == test), features, categories, target, "predicted", t, **options).withColumn("fold", F.lit(n))
        out = got if out is None else out.unionByName(got)
    return out


def hierarchical(df: DataFrame, total: DataFrame, features: list[str], total_features: list[str], target: str, keys: list[str], last: int, test: int, t: str = "t", **options) -> DataFrame:
    """Forecast of the total per key times the forecast share of each row, shares clipped to [0, 1]."""
    share = df.withColumn("__share", F.when(F.col("__total") > 0, F.col(target) / F.col("__total")).otherwise(0.0))
    shares = forecast(share.filter(F.col(t) <= last), share.filter(F.col(t) == test), features, [], "__share", "share_hat", t, log=False, **options)
    totals = forecast(total.filter(F.col(t) <= last), total.filter(F.col(t) == test), total_features, [], "__total", "total_hat", t, **options)
    out = shares.join(totals.select(*keys, t, "total_hat"), [*keys, t], "left")
    return out.withColumn("predicted", F.least(F.col("share_hat"), F.lit(1.0)) * F.col("total_hat"))


def hurdle(df: DataFrame, features: list[str], target: str, last: int, test: int, t: str = "t", seed: int = 42) -> DataFrame:
    """P(target > 0), a size model of the positive rows, their product and the 0.5-threshold form."""
    ready = prepared(df, features).withColumn("__positive", (F.col(target) > 0).cast("double"))
    assemble = VectorAssembler(inputCols=features, outputCol="__features", handleInvalid="keep")
    classifier = Pipeline(stages=[assemble, GBTClassifier(featuresCol="__features", labelCol="__positive", maxIter=10, maxDepth=4, seed=seed)])
    fit = classifier.fit(ready.filter(F.col(t) <= last))
    scored = fit.transform(ready.filter(F.col(t) == test)).withColumn("p_positive", vector_to_array("probability")[1])
    scored = scored.select(*df.columns, "p_positive")
    sized = forecast(df.filter((F.col(t) <= last) & (F.col(target) > 0)), scored, features, [], target, "size_hat", t)
    return sized.withColumn("expected", F.col("p_positive") * F.col("size_hat")).withColumn("thresholded", F.when(F.col("p_positive") >= 0.5, F.col("size_hat")).otherwise(0.0))


def search(df: DataFrame, features: list[str], target: str, last: int, trials: int = 4, seed: int = 42, t: str = "t") -> tuple[dict, float]:
    """Random search over boosting options, judged on the last training period by business accuracy."""
    draw, best = random.Random(seed), ({}, -1.0)
    df = df.persist()  # every trial reads it
    for _ in range(trials):
        options = {"trees": draw.choice([8, 12, 20]), "depth": draw.choice([3, 4, 5]), "loss": draw.choice(["absolute", "squared"])}
        got = forecast(df.filter(F.col(t) < last), df.filter(F.col(t) == last), features, [], target, "predicted", t, **options)
        score = got.agg(metrics.business_accuracy(F.col(target), F.col("predicted"))).first()[0]
        if score > best[1]:
            best = (options, score)
    df.unpersist()
    return best


def permuted(df: DataFrame, feature: str, seed: int = 42, groups: int = 32) -> DataFrame:
    """df with the feature's values dealt anew inside random groups, so no task sorts all rows."""
    own, other = F.xxhash64(*df.columns), F.xxhash64(*df.columns, F.lit(seed))
    keyed = df.withColumn("__g", F.pmod(F.xxhash64(*df.columns, F.lit(-seed)), F.lit(groups)))
    keyed = keyed.withColumn("__i", F.row_number().over(Window.partitionBy("__g").orderBy(own))).withColumn("__j", F.row_number().over(Window.partitionBy("__g").orderBy(other)))
    donors = keyed.select("__g", F.col("__j").alias("__i"), F.col(feature).alias("__v"))
    return keyed.join(donors, ["__g", "__i"]).withColumn(feature, F.col("__v")).select(*df.columns)


def permutation_importance(predict, df: DataFrame, features: list[str], actual: str, seed: int = 42) -> DataFrame:
    """(feature, rise of the mean absolute error when its values are dealt anew); predict adds ``predicted``."""
    error = lambda d: predict(d).agg(F.avg(F.abs(F.col("predicted") - F.col(actual)))).first()[0]
    base, groups = error(df), max(1, min(32, df.count() // 64))  # few rows share one group, else most would be alone in theirs
    return df.sparkSession.createDataFrame([(f, float(error(permuted(df, f, seed, groups)) - base)) for f in features], "feature string, importance double")


def fitted(train: DataFrame, features: list[str], target: str, t: str = "t", log: bool = True, **options):
    """(model, predict): the fitted pipeline, which can be saved, and the function from rows to rows with ``predicted``."""
    label = F.log1p(F.greatest(F.col(target).cast("double"), F.lit(0.0))) if log else F.col(target).cast("double")
    last = train.agg(F.max(t)).first()[0]
    model = pipeline(features, [], "__label", **options).fit(prepared(train, features).withColumn("__label", label).withColumn("__valid", F.col(t) == last))

    def predict(df: DataFrame) -> DataFrame:
        value = F.expm1("__prediction") if log else F.col("__prediction")
        return model.transform(prepared(df, features)).withColumn("predicted", F.greatest(value, F.lit(0.0))).select(*df.columns, "predicted")

    return model, predict
