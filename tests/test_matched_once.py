"""The matching queries at larger sizes: what is matched or read once only, and steps that run at the same time."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import adjudicate, matching, reshape
from weftline.plans import text_queries
from weftline.sources.shared import together


def searches(df):
    return df._jdf.queryExecution().toString().count("CoGroup")


@pytest.fixture(scope="module")
def copies(spark, small_dir, tmp_path_factory):
    """The parts three times, keys shifted by 1,000."""
    at = str(tmp_path_factory.mktemp("copies"))
    part = spark.read.parquet(f"{small_dir}/part.parquet")
    again = part.crossJoin(spark.range(3).select((F.col("id") * 1000).alias("shift"))).withColumn("p_partkey", F.col("p_partkey") + F.col("shift")).drop("shift")
    again.write.parquet(f"{at}/part.parquet")
    return at


def test_adjudication_reads_its_undecided_names_from_a_table(spark, small_dir, monkeypatch):
    pools = []
    monkeypatch.setattr(adjudicate, "requests", lambda pool, *a, f=adjudicate.requests: pools.append(pool) or f(pool, *a))
    text_queries.QUERIES["adjudication_loop"](spark, small_dir)
    assert [searches(p) for p in pools] == [0]


def test_tiers_are_counted_from_a_table(spark, small_dir, monkeypatch):
    tiers = []
    monkeypatch.setattr(reshape, "shares", lambda df, *a, f=reshape.shares: tiers.append(df) or f(df, *a))
    text_queries.QUERIES["tier_distribution"](spark, small_dir)
    assert [searches(t) for t in tiers] == [0]


def test_names_of_copies_are_matched_once(spark, small_dir, copies, monkeypatch):
    asked = []
    for name in ("sparse_topk", "dense_topk"):
        monkeypatch.setattr(matching, name, lambda c, q, *a, f=getattr(matching, name): asked.append(q.count()) or f(c, q, *a))
    query = text_queries.QUERIES["token_sort_ratio_best"]
    got, one = query(spark, copies).collect(), query(spark, small_dir).collect()
    names = len({r.name for r in one})
    assert asked == [names] * 4
    assert len(got) == 3 * len(one)
    assert sorted(set(r[1:] for r in got)) == sorted(set(r[1:] for r in one))
    assert sorted(r.query_id % 1000 for r in got) == sorted(3 * [r.query_id for r in one])


def test_sides_are_built_at_the_same_time(spark, small_dir, monkeypatch):
    both = threading.Barrier(2, timeout=60)
    monkeypatch.setattr(text_queries, "written", lambda *a, f=text_queries.written: both.wait() is None or f(*a))
    c, q = text_queries.sides(spark, small_dir)
    assert c.columns == ["id", "name"] and q.columns == ["query_id", "name"]


def test_together_keeps_order_and_raises(spark):
    assert together(spark, lambda: 1, lambda: spark.range(5).count(), lambda: 3) == [1, 5, 3]
    with pytest.raises(ZeroDivisionError):
        together(spark, lambda: 1, lambda: 1 // 0)


@pytest.mark.parametrize("exclude_self", [False, True])
def test_dense_with_scores_that_single_precision_confuses(spark, monkeypatch, exclude_self):
    draw = np.random.default_rng(7)
    base = draw.random(24)
    v = base + draw.normal(0, 1, (600, 24)) * draw.choice([1e-7, 1e-5, 1e-3, 1], (600, 1))
    c = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    q = c.filter("id % 50 = 0").withColumnRenamed("id", "query_id")
    for name, value in (("BLOCK_ROWS", 300), ("TURN_QUERIES", 8), ("BATCH_QUERIES", 5), ("SEED_ROWS", 32)):
        monkeypatch.setattr(matching, name, value)
    got = {(r.query_id, r.rank): (r.id, r.score) for r in matching.dense_topk(c, q, "id", "query_id", "v", exclude_self=exclude_self).collect()}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for a in range(0, 600, 50):
        want = sorted((-round(float(unit[a] @ unit[b]), 6), b) for b in range(600) if not exclude_self or b != a)[:8]
        assert [(b, -s) for s, b in want] == [(got[a, r][0], pytest.approx(got[a, r][1], abs=1e-9)) for r in range(1, 9)]
