from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from weftline.operators import models
from weftline.plans import panel_queries


def test_all_folds_features_and_trials(spark, small_dir, monkeypatch):
    assert sorted(r.fold for r in panel_queries.gbt_walkforward(spark, small_dir).collect()) == [1, 2, 3]
    assert sorted(r.feature for r in panel_queries.feature_importance(spark, small_dir).collect()) == sorted(panel_queries.FEATURES)
    seen = {}
    monkeypatch.setattr(models, "search", lambda df, features, target, last, trials: (seen.update(features=features, trials=trials), ({"depth": 3}, 1.0))[1])
    assert panel_queries.tuning_search(spark, small_dir).count() == 1
    assert seen == {"features": panel_queries.FEATURES, "trials": 40}


def test_importance_deals_few_rows_anew(spark):
    df = spark.range(25).select("id", F.col("id").cast("double").alias("x"), F.col("id").cast("double").alias("y"))
    got = models.permutation_importance(lambda d: d.withColumn("predicted", F.col("x")), df, ["x"], "y").first()
    assert got.importance > 4  # about 8 where all rows move


def test_rows_with_encoded_entities(spark, small_dir):
    assert sorted(r.fold for r in panel_queries.gbt_rows_walkforward(spark, small_dir).collect()) == [1, 2, 3]


def test_entity_means_come_from_training(spark):
    df = spark.createDataFrame([(t, item, 10.0 if item == "a" else 200.0) for t in range(1, 41) for item in ("a", "b")], "t int, item string, y double").withColumn("x", F.lit(0.0))
    test = spark.createDataFrame([(41, "a", 0.0), (41, "b", 0.0), (41, "new", 0.0), (41, None, 0.0)], "t int, item string, x double").withColumn("y", F.lit(0.0))
    got = {r.item: r.predicted for r in models.forecast(df, test, ["x"], [], "y", "predicted", log=False, loss="squared", trees=3, entities=("item",)).collect()}
    assert got["a"] < 60 < 150 < got["b"]
    assert len(got) == 4 and all(v is not None for v in got.values())


def test_model_is_saved_and_loaded(spark, tmp_path):
    df = spark.range(60).select((F.col("id") % 6 + 1).cast("int").alias("t"), F.col("id").cast("double").alias("x"), (F.col("id") * 2).cast("double").alias("y"))
    model, predict = models.fitted(df, ["x"], "y", trees=3)
    model.write().save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model"))
    ready = models.prepared(df, ["x"])
    first = {r.x: r["__prediction"] for r in model.transform(ready).collect()}
    assert first == {r.x: r["__prediction"] for r in again.transform(ready).collect()}
    assert predict(df).count() == 60
