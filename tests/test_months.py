import re

import duckdb
import pytest
from pyspark.sql import functions as F

from weftline.operators import models, panel
from weftline.plans import catalogue, panel_queries

PANEL_NAMES = sorted(n for n, sql in panel_queries.ORACLES.items() if "li AS" in sql)


def test_no_sql_cuts_the_months():
    assert len(PANEL_NAMES) > 28 and not [n for n, sql in panel_queries.ORACLES.items() if "TIMESTAMP '" in sql or n.endswith("_all_months")]


def test_panel_has_every_month_and_all_sales(spark, small_dir):
    table = f"'{small_dir}/lineitem.parquet'"
    months, returns, parts = duckdb.sql(f"SELECT count(DISTINCT year(l_shipdate) * 100 + month(l_shipdate)), sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END), count(DISTINCT l_partkey) FROM {table}").fetchall()[0]
    got = catalogue.queries()["panel_dense_grid"](spark, small_dir).agg(F.count_distinct("date"), F.max("t"), F.sum("returns"), F.count_distinct("item")).first()
    assert tuple(got) == (months, months, returns, parts) and months > 8


@pytest.mark.parametrize("name", ["panel_dense_grid", "lag_features", "trailing_streak_pivot", "historical_share", "flagship_panel_accuracy", "item_month_rollup"])
def test_lineitem_is_read_once_and_the_panel_is_dealt_once(spark, small_dir, monkeypatch, name):
    reads = []
    real = panel_queries.read_table
    monkeypatch.setattr(panel_queries, "read_table", lambda s, d, t: (reads.append(t), real(s, d, t))[1])
    df = catalogue.queries()[name](spark, small_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert reads.count("lineitem") == 1 and "l_partkey" not in plan
    by_pair = re.findall(r"Exchange hashpartitioning\(item#\d+L?, wh#\d+L?, \d+\)", plan)
    assert len(by_pair) == 1, plan


def test_facts_reach_the_panel_as_two_tables_do(spark):
    rows = spark.createDataFrame([(199801, 1, 1, 5, False, True), (199803, 1, 1, 3, True, False), (199803, 2, 4, 2, False, False), (199803, 2, 4, 2, True, True)], "date int, item long, wh long, qty long, is_return boolean, is_out boolean")
    out = panel.collapse_duplicates(rows.filter("is_out").select("date", "item", "wh", F.lit(1).alias("outage"), F.lit(True).alias("seen")), ["date", "item", "wh"], "outage", "seen")
    two = panel.dense_panel(panel.sales_facts(rows), out)
    one = panel.dense_from_facts(panel.facts(rows))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.select(*one.columns).collect())) and one.count() == 4


def test_guards_raise(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 1, 6), (2, 1, 7)], "item int, t int, x int")
    with pytest.raises(Exception, match="occurs more than once"):
        panel.with_attributes(df, df.select("item", "x"), ["item"]).collect()
    with pytest.raises(Exception, match="period twice"):
        panel.pivoted(df, ["item"], "t", "x", [1]).collect()
    fine = panel.pivoted(df.filter("x <> 6"), ["item"], "t", "x", [1, 2]).orderBy("item").collect()
    assert [tuple(r) for r in fine] == [(1, 5, None), (2, 7, None)]


def test_last_folds():
    assert models.last_folds(8) == models.FOLDS
    assert models.last_folds(83) == [(1, 80, 81), (2, 81, 82), (3, 82, 83)]


@pytest.mark.parametrize("n", [11])
def test_folds_come_from_the_months_found(spark, n):
    df = spark.createDataFrame([(t,) for t in range(1, n + 1)], "t int")
    tests = models.with_folds(df, models.last_folds(n)).filter("is_test").select("fold", "t").collect()
    assert sorted(tuple(r) for r in tests) == [(1, 9), (2, 10), (3, 11)]
