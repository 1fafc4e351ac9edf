"""The retrievers at larger sizes: what they shuffle, copies, ties, keys of other types."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import text as tx
from weftline.operators import matching
from weftline.operators.nearest import Best
from weftline.plans import text_queries

WORDS = ["tablet", "cream", "syrup", "brand", "old", "new", "red", "blue", "mg", "ml", "7", "12"]


def shuffled(spark, run):
    """(result, records written to shuffles by the stages of run)"""
    store, sc = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext
    none = lambda: store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    seen = {(s.stageId(), s.attemptId()) for s in map(none().apply, range(none().size()))}
    got = run()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = none()
    return got, sum(s.shuffleWriteRecords() for s in map(stages.apply, range(stages.size())) if (s.stageId(), s.attemptId()) not in seen)


def names(n, seed, at_most=6):
    draw = random.Random(seed)
    return [(i, " ".join(draw.choices(WORDS, k=draw.randint(1, at_most)))) for i in range(n)]


def test_sparse_shuffles_rows_not_pairs(spark):
    c = spark.createDataFrame(names(2000, 1), "id long, name string")
    q = spark.createDataFrame([(i * 10 + j, n) for i, n in names(50, 2) for j in range(10)], "query_id long, name string")
    got, records = shuffled(spark, lambda: matching.sparse_topk(c, q, "id", "query_id", "name").collect())
    assert len(got) == 500 * 8
    assert records < 20 * (2000 + 500)  # a join on grams writes a record for each of the 1,000,000 pairs
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.id, r.score))
    assert all(sorted(by[x]) == sorted(by[x - x % 10]) for x in by)


def test_sparse_over_many_blocks(spark, monkeypatch):
    c = spark.createDataFrame(names(700, 3), "id long, name string")
    q = spark.createDataFrame(names(60, 4), "query_id long, name string")
    found = lambda: sorted(map(tuple, matching.sparse_topk(c, q, "id", "query_id", "name").collect()))
    whole = found()
    for name, value in (("SPARSE_ROWS", 90), ("TURN_QUERIES", 17), ("BATCH_QUERIES", 5), ("SEED_ROWS", 16), ("BATCH_CELLS", 40)):
        monkeypatch.setattr(matching, name, value)
    parted = found()
    assert [(x[0], x[1], x[3]) for x in parted] == [(x[0], x[1], x[3]) for x in whole]
    assert np.allclose([x[2] for x in parted], [x[2] for x in whole], atol=1e-9)


def test_sparse_text_keys_and_repeated_keys(spark):
    c = spark.createDataFrame([("b", "red cream"), ("a", "cream red"), ("c", "old"), ("c", "syrup"), ("d", "")], "id string, name string")
    q = spark.createDataFrame([("x", "red cream"), ("y", "old syrup")], "query_id string, name string")
    got = {(r.query_id, r.rank): r.id for r in matching.sparse_topk(c, q, "id", "query_id", "name", k=2).filter("score > 0.9").collect()}
    assert got == {("x", 1): "a", ("x", 2): "b", ("y", 1): "c"}


@pytest.mark.parametrize("word", ["a", "ab", "abc", "abcd", "ünïcode7", "😀x"])
def test_grams_of_a_word(spark, word):
    df = spark.createDataFrame([(word,)], "w string").select(tx.char_ngrams(F.col("w")))
    assert sorted(df.first()[0]) == sorted(tx.word_ngrams(word))


@pytest.mark.parametrize("seed", range(6))
def test_best_of_columns(seed):
    draw = np.random.default_rng(seed)
    s = np.round(draw.random((400, 7)) * 12) / 12 + draw.integers(-1, 2, (400, 7)) * 3e-7  # many ties, some only after rounding
    best = Best(7, 5, 6, 0.0)
    step = [1, 3, 64, 400][seed % 4]
    for a in range(0, 400, step):
        best.add(s[a : a + step], np.arange(a, min(400, a + step)))
    column, row, score = best.found()
    for c in range(7):
        want = sorted((-np.round(s[r, c], 6), r) for r in range(400) if s[r, c] > 0)[:5]
        assert [(-x, r) for x, r in zip(score[column == c], row[column == c], strict=True)] == want


@pytest.mark.parametrize("name", ["hybrid_candidates", "token_sort_ratio_best", "tier_distribution"])
def test_names_are_built_once(spark, small_dir, monkeypatch, name):
    calls = []
    monkeypatch.setattr(text_queries, "part_names", lambda *a, f=text_queries.part_names: calls.append(1) or f(*a))
    text_queries.QUERIES[name](spark, small_dir)
    assert len(calls) == 2  # catalog and queries


def test_dense_with_many_ties(spark, monkeypatch):
    draw = random.Random(5)
    rows = [(i, [float(draw.randint(0, 2)) for _ in range(4)]) for i in range(500)]
    c = spark.createDataFrame(rows, "id long, v array<double>")
    q = c.filter("id % 9 = 0").withColumnRenamed("id", "query_id")
    for name, value in (("BLOCK_ROWS", 70), ("TURN_QUERIES", 20), ("BATCH_QUERIES", 6), ("SEED_ROWS", 16)):
        monkeypatch.setattr(matching, name, value)
    got = {(r.query_id, r.rank): (r.id, r.score) for r in matching.dense_topk(c, q, "id", "query_id", "v", exclude_self=True).collect()}
    unit = [np.array(v) / (np.linalg.norm(v) or 1) for _, v in rows]
    for a in range(0, 500, 9):
        want = sorted((-round(float(unit[a] @ unit[b]), 6), b) for b in range(500) if b != a)[:8]
        assert [(b, -s) for s, b in want] == [(got[a, r][0], pytest.approx(got[a, r][1], abs=1e-9)) for r in range(1, 9)]


def test_dense_leaves_out_vectors_that_are_not_finite(spark):
    c = spark.createDataFrame([(1, [1.0, 0.0]), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, [0.0, 1.0])], "id long, v array<double>")
    got = matching.dense_topk(c, c.filter("id = 1").withColumnRenamed("id", "query_id"), "id", "query_id", "v").collect()
    assert sorted((r.rank, r.id, r.score) for r in got) == [(1, 1, 1.0), (2, 4, 0.0)]


def test_adjudication_of_undecided_names(spark, small_dir, monkeypatch):
    calls = []
    monkeypatch.setattr(text_queries, "part_names", lambda *a, f=text_queries.part_names: calls.append(1) or f(*a))
    monkeypatch.setattr(text_queries, "log", lambda *a, f=text_queries.log: f(*a).filter("false"))
    got = text_queries.QUERIES["adjudication_loop"](spark, small_dir).collect()
    assert len(calls) == 2  # catalog and queries
    assert sorted(r.key for r in got) == ["K0", "K100"]
    assert all(r.decision in ("CONFIRM", "NO_MATCH") and r.model_used == "rule" for r in got)
