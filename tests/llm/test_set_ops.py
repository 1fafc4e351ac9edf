import math
import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
from test_text_ops import DOCS, HARD, docs, frame  # noqa: E402

from weftline.llm import mixing, ngram_join, topk, toxicity  # noqa: E402


def near_copies(seed, n, sizes):
    """Texts in groups: each group's members are its base with a few words changed."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(3))
    shared = [word() for _ in range(60)]
    out = []
    while len(out) < n:
        base = [word() for _ in range(r.choice(sizes))]
        if r.random() < 0.3:
            base[3:3] = shared
        for _ in range(r.choice([1, 1, 2, 5, 12])):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                k = r.randrange(len(t) + 1)
                t[k : k + r.choice([0, 1])] = [word() for _ in range(r.choice([0, 1]))]
            out.append(" ".join(t))
    return out[:n]


@pytest.mark.parametrize("sizes", [[5, 6, 7, 8, 9, 10, 12], [15, 20, 30, 40], [80, 150, 300]])
def test_ngram_join_against_all_pairs(spark, sizes):
    rows = list(enumerate(near_copies(sizes[0], 260, sizes)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.assign(docs(spark, rows)).collect()}
    want = {d: (len(brute.shingles(t)), c) for (d, t), c in zip(rows, brute.components(rows), strict=True)}
    assert got == want


def test_ngram_join_hard_rows(spark):
    rows = [*HARD, (30, "one two three four five six"), (31, "ONE two three four five six"), (30, "one two three four five six"), (40, "x y"), (41, "X  y")]
    got = sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in ngram_join.assign(docs(spark, rows).withColumnRenamed("lang", "cls")).collect())
    assert got == sorted(str((d, len(brute.shingles(t)), c)) for (d, t), c in zip(rows, brute.components(rows), strict=True))
    assert ngram_join.assign(docs(spark, [])).count() == 0
    kept = ngram_join.deduplicate(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    assert sorted(r.doc_id for r in kept.filter("doc_id >= 30").collect()) == [30, 40]


def test_ngram_signatures_meet(spark):
    """Pairs at the threshold share a signature, over many sizes."""
    r = np.random.default_rng(1)
    for n in [*range(1, 60), 100, 333, 1000]:
        for _ in range(12):
            a = np.unique(r.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
            grow = r.integers(0, n // 4 + 1)
            drop = min(len(a) - 1, (n // 4 - grow) * 4 // 5) if grow < n // 4 else 0
            b = np.unique(np.concatenate((a[r.permutation(len(a))[: len(a) - drop]], r.integers(0, 2**63, grow).astype(np.uint64))))
            common = len(np.intersect1d(a, b))
            if 100 * common >= 80 * (len(a) + len(b) - common):
                assert len(np.intersect1d(ngram_join.signatures(a), ngram_join.signatures(b))), (n, grow, drop)


def test_mixing(spark):
    r = random.Random(2)
    rows = [(i, " ".join("w" * r.randint(1, 3) for _ in range(r.randint(0, 120))), "en", r.choice(["a", "b", "c", "d", "é", None, "big", "big", "big"]), 1) for i in range(900)]
    rows += [(3, "dup dup dup", "en", "a", 1)] * 3 + [(None, None, None, "a", None), (5, "", "x", "only-empty", 0)]
    thin, goal = mixing.units(frame(spark, rows))
    got = mixing.choose(thin, goal, block=64).collect()
    sizes = {}
    for _, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(brute.WORDS.findall(t or ""))
    want = brute.targets(sizes)
    assert {x.source: round(x.target, 6) for x in goal.collect()} == {s: round(v, 6) for s, v in want.items()}
    assert len(got) == len(rows) and all(0 <= x.copies <= 2 for x in got)
    for s, v in want.items():
        assert abs(sum(x.copies * x.size for x in got if x.source == s) - v) <= max(3.0, 0.002 * v)
    again = mixing.choose(*mixing.units(frame(spark, rows[::-1])), block=64)
    assert sorted(map(str, got)) == sorted(map(str, again.collect()))
    mixed = mixing.mix(frame(spark, rows))
    assert mixed.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    plan = mixing.choose(*mixing.units(frame(spark, rows)))
    assert mixed.count() == plan.agg(F.sum("copies")).first()[0]
    assert mixing.mix(frame(spark, [])).count() == 0
    assert mixing.mix(docs(spark, HARD)).groupBy("doc_id", "text").count().agg(F.max("count")).first()[0] <= 4


def test_cube_keeps_totals():
    r = np.random.default_rng(3)
    z = r.integers(1, 400, 500)
    for seed in range(20):
        p = np.full(500, 0.37)
        x = np.array(mixing.flight(p, z, random.Random(seed)))
        assert abs((x - p).sum()) < 1e-6 and abs(((x - p) * z).sum()) < 1e-3 and ((x > 0) & (x < 1)).sum() <= 2


def test_topk(spark):
    r = random.Random(4)
    rows = [(i, [r.uniform(-1, 1) for _ in range(6)]) for i in range(700)] + [(1000 + i, [0.5] * 6) for i in range(300)]
    rows += [(2000, None), (2050, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2100, [float("nan")] * 6), (2150, [float("inf")] * 6), (None, [0.1] * 6), (50, rows[50][1]), (2200, [9.0] * 6), (2201, [1.0])]
    schema = "vec_id long, embedding array<float>, label int, cell int"
    vectors = spark.createDataFrame([(a, b, 0, 1) for a, b in rows], schema)
    got = sorted((x.query_id, x.rank, x.vec_id, x.score) for x in topk.search(vectors, vectors.filter("vec_id % 50 = 0")).collect())
    ints = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v and len(v) == 6 and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in {i: v for i, v in ints if i % 50 == 0}.items():
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ints if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert topk.search(vectors.limit(0), vectors.limit(0)).count() == 0
    few = vectors.filter("vec_id in (0, 1, 2)")
    assert topk.search(few, few.filter("vec_id = 0")).count() == 2


def nearest(rows, k=5, every=50):
    """Brute force with whole numbers; vectors meet those of their own length."""
    ints = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows]
    out = []
    for q, v in {i: v for i, v in sorted(ints, key=lambda r: r[1], reverse=True) if i % every == 0}.items():
        scores = [(max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(v, w, strict=True)))), i) for i, w in ints if i != q and len(w) == len(v)]
        out += [(q, r + 1, i, s) for r, (s, i) in enumerate(sorted(scores, key=lambda x: (-x[0], x[1]))[:k])]
    return sorted(out)


@pytest.mark.parametrize("case", ["lengths", "large", "huge", "beyond"])
def test_topk_lengths_and_magnitudes(spark, case):
    r = random.Random(case)
    if case == "lengths":
        rows = [(i, [r.uniform(-1, 1) for _ in range((2, 3, 3, 7)[i % 4])]) for i in range(420)] + [(450, [0.5] * 11), (500, [1.0, 2.0, 3.0])]
    else:
        size = {"large": 1e7, "huge": 3e38, "beyond": 1e200}[case]
        rows = [(i, [r.uniform(-1, 1) * (size if i % 7 == 0 else 1.0) for _ in range(5)]) for i in range(260)]
        rows += [(300, [size] * 5), (301, [-size] * 5), (302, [0.0] * 5), (303, [size] * 5)]
    frame_ = spark.createDataFrame(rows + [(600, []), (650, None)], "vec_id long, embedding array<double>")
    got = sorted((x.query_id, x.rank, x.vec_id, x.score) for x in topk.search(frame_, frame_.filter("vec_id % 50 = 0")).collect())
    assert got == nearest(rows)


def test_topk_turns_and_blocks(spark, monkeypatch):
    """Many queries at a block are dealt into turns; a third of the rows are one vector."""
    monkeypatch.setattr(topk, "TURN_QUERIES", 20)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 64)
    monkeypatch.setattr(topk, "PIVOT_ROWS", 40)
    r = random.Random(9)
    rows = [(i, [r.uniform(-1, 1) for _ in range(4)] if i % 3 else [0.25] * 4) for i in range(1200)]
    frame_ = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((x.query_id, x.rank, x.vec_id, x.score) for x in topk.search(frame_, frame_.filter("vec_id % 10 = 0")).collect())
    assert got == nearest(rows, every=10)


def test_isotonic_and_trees():
    r = np.random.default_rng(5)
    x = r.normal(size=(600, toxicity.N_FEATURES))
    y = (x[:, 1] + 0.3 * r.normal(size=600) > 0.8).astype(float)
    m = toxicity.fit_trees(x, y).margin(x)
    assert ((m > 0) == (y == 1)).mean() > 0.95
    xs, ys = toxicity.fit_isotonic(m, y)
    assert (np.diff(xs) >= 0).all() and (np.diff(ys) >= 0).all() and 0 <= ys.min() <= ys.max() <= 1


def test_toxicity(spark):
    base = "/root/testdata/sf0.01"
    documents, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(documents, labels)
    scored = toxicity.score(documents, model)
    assert scored.columns == [*documents.columns, "score"] and scored.count() == documents.count()
    held = scored.join(labels, "doc_id").filter(toxicity.remainder(F.col("doc_id")) == 0)
    assert held.agg(F.avg(((F.col("score") >= 0.5) == (F.col("toxic") == 1)).cast("int"))).first()[0] > 0.93
    hard = toxicity.score(docs(spark, HARD).withColumnRenamed("lang", "score"), model)
    assert hard.count() == len(HARD) and hard.filter("score is null or score < 0 or score > 1").count() == 0
    none = toxicity.train(frame(spark, []), labels)
    assert [x.score for x in toxicity.score(docs(spark, [(1, "idiot")]), none).collect()] == [0.0]
    mixed = spark.createDataFrame([(1, None, 1), (2, None, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.train(docs(spark, [(1, "a"), (2, "b")]), mixed).share in (0.0, 0.5, 1.0)
    assert DOCS
