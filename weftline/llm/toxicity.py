"""Toxicity scores from gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text: density of lexicon words and lexicon stems, their summed and largest weights, second-person
words near a hit, capitals, punctuation, obfuscation (symbols between letters) and length. The lexicons are learned
from labelled texts: terms whose log odds of a toxic document are high even at the lower confidence bound. Training
is two-fold: features of one half use the lexicons of the other, and the calibration sees margins of trees that did
not see the row.

Parameter with a bound: training uses at most TRAIN_ROWS labelled rows, those with the least hash of doc_id; only
counts of their terms and their feature rows reach the driver. Rows with crc32(doc_id) mod 5 = 0 are never trained
on. All texts are scored, whole.

Defined results: a null text is an empty one and gets the score of its features like any other; without both
classes among the training rows the score is the share of toxic ones (0 without rows); a document labelled twice
counts as toxic if any label says so, null labels are ignored; of rows that repeat a labelled id the least text is
trained on; repeated rows are scored each; an empty table gives
an empty table; all columns of the documents stay in ``score``, but one named like the score's column, which is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import table, written

TRAIN_ROWS = 20_000
#: A lexicon has at most so many terms, those of the highest lower bound.
TERMS = 4_000
STEM = 4
#: Least lower bound of a term's log odds, in units of 1.5 standard errors below the estimate.
LEAST_ODDS, ERRORS = 1.0, 1.5
TREES, DEPTH, RATE, BINS, RIDGE = 60, 3, 0.2, 32, 1.0
NEAR = 5
#: Second-person words.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes".split())
WORD = re.compile(r"[^\W\d_]+")
#: Classes of bytes: 1 lower-case letter or a byte of a longer character, 2 capital, 3 symbol or digit, 0 the rest.
CLASSES = np.zeros(256, np.uint8)
CLASSES[97:123] = 1
CLASSES[128:] = 1
CLASSES[65:91] = 2
CLASSES[[*range(33, 65), *range(91, 97), *range(123, 127)]] = 3
N_FEATURES = 10


@dataclass
class Lexicon:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)


def terms_of(text: str) -> set[str]:
    """Words, and as ``prefix*`` the stems of longer ones."""
    words = set(WORD.findall(text.lower()))
    return words | {w[:STEM] + "*" for w in words if len(w) > STEM}


def features(text: str, lexicon: Lexicon) -> list[float]:
    words = WORD.findall(text.lower())
    n = len(words) or 1
    known, stems = lexicon.words, lexicon.stems
    hits = [known[w] for w in words if w in known]
    stemmed = [stems[s] for s in [w[:STEM] for w in words if len(w) > STEM] if s in stems]
    near = 0
    if hits:
        at = [i for i, w in enumerate(words) if w in known]
        near = sum(1 for i in at if not SECOND_PERSON.isdisjoint(words[max(0, i - NEAR) : i + NEAR + 1]))
    kinds = CLASSES[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
    size = max(1, len(kinds))
    count = np.bincount(kinds, minlength=4)
    mixed = 0
    if len(kinds) > 2:
        letter = (kinds == 1) | (kinds == 2)
        mixed = int(np.count_nonzero(letter[:-2] & (kinds[1:-1] == 3) & letter[2:]))
    return [len(hits) / n, sum(hits) / n, max(hits, default=0.0), len(stemmed) / n, sum(stemmed) / n, max(stemmed, default=0.0), near / n, count[2] / size, count[3] / size, mixed / n]


# -- trees and calibration, on the bounded training rows ---------------------------------------------------------


@dataclass
class Trees:
    """Complete trees of one depth: at node k of a level go right if x[feature] > cut."""

    start: float
    nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.nodes:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += leaf[at - (2**DEPTH - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray) -> Trees:
    share = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
    model = Trees(float(np.log(share / (1 - share))))
    cuts = [np.unique(np.quantile(x[:, j][x[:, j] != x[:, j].min()] if (x[:, j] != x[:, j].min()).any() else x[:, j], np.linspace(0, 1, BINS - 1))) for j in range(x.shape[1])]
    cuts = [np.unique(np.append(x[:, j].min(), c))[: BINS] for j, c in enumerate(cuts)]
    bins = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    margin, width = np.full(len(y), model.start), BINS + 1
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-9)
        feature, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf)
        at = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, nodes = 2**level - 1, 2**level
            best = np.full(nodes, 1e-6)
            split = np.full(nodes, width)
            for j in range(x.shape[1]):
                cell = (at - first) * width + bins[:, j]
                g = np.bincount(cell, grad, nodes * width).reshape(nodes, width).cumsum(1)
                h = np.bincount(cell, hess, nodes * width).reshape(nodes, width).cumsum(1)
                gain = g**2 / (h + RIDGE) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + RIDGE) - g[:, -1:] ** 2 / (h[:, -1:] + RIDGE)
                gain = gain[:, : len(cuts[j])]
                k = gain.argmax(1)
                better = gain[np.arange(nodes), k] > best
                best = np.where(better, gain[np.arange(nodes), k], best)
                feature[first : first + nodes] = np.where(better, j, feature[first : first + nodes])
                cut[first : first + nodes] = np.where(better, cuts[j][k], cut[first : first + nodes])
                split = np.where(better, k, split)
            own = feature[at]
            at = 2 * at + 1 + (bins[np.arange(len(y)), own] > split[at - first])
        leaf_of = at - (2**DEPTH - 1)
        g, h = np.bincount(leaf_of, grad, 2**DEPTH), np.bincount(leaf_of, hess, 2**DEPTH)
        leaf = -RATE * g / (h + RIDGE)
        model.nodes.append((feature, cut, leaf))
        margin += leaf[leaf_of]
    return model


def fit_isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; (margins, shares) to interpolate between."""
    order = np.argsort(margin, kind="stable")
    m, t = margin[order], y[order].astype(float)
    values, first = np.unique(m, return_index=True)
    weight = np.diff(np.append(first, len(m))).astype(float)
    mean = np.add.reduceat(t, first) / weight
    pools: list[list[float]] = []
    for v, w, a in zip(mean.tolist(), weight.tolist(), values.tolist(), strict=True):
        pools.append([v, w, a, a])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, c = pools.pop(), pools.pop()
            pools.append([(b[0] * b[1] + c[0] * c[1]) / (b[1] + c[1]), b[1] + c[1], c[2], b[3]])
    xs = np.array([e for p in pools for e in (p[2], p[3])])
    ys = np.array([p[0] for p in pools for _ in range(2)])
    return xs, ys


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    xs: np.ndarray
    ys: np.ndarray
    share: float

    def score(self, texts: list[str]) -> np.ndarray:
        if self.trees is None or not texts:
            return np.full(len(texts), self.share)
        margin = self.trees.margin(np.array([features(t, self.lexicon) for t in texts], float).reshape(-1, N_FEATURES))
        plain = 1 / (1 + np.exp(-margin))
        # A little of the plain probability keeps an order inside the steps of the calibration.
        return np.clip(0.98 * np.interp(margin, self.xs, self.ys) + 0.02 * plain, 0.0, 1.0)


# -- training ----------------------------------------------------------------------------------------------------


def remainder(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, toxic, half) of at most ``rows`` labelled rows outside the held-out fifth."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id")) != 0))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # bounded, so it can be broadcast
    got = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    got = got.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic")  # one row per id, so the bound holds for rows too
    half = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int")
    return got.withColumn("half", half)


def learn_lexicons(rows: DataFrame) -> tuple[list[Lexicon], list[tuple[int, int]]]:
    """Lexicons of half 0, half 1 and all; and each half's (toxic, clean) documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [terms_of(t) for t in batch.column(0).to_pylist()]
            sizes = [len(f) for f in found]
            take = pa.array(np.repeat(np.arange(len(found)), sizes))
            yield pa.RecordBatch.from_arrays([pa.array([t for f in found for t in f], pa.string()), batch.column(1).take(take), batch.column(2).take(take)], names=["term", "toxic", "half"])

    counts = {(r["half"], r["toxic"]): r["n"] for r in rows.groupBy("half", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = [(counts.get((h, 1), 0), counts.get((h, 0), 0)) for h in (0, 1)]
    terms = rows.select("text", "toxic", "half").mapInArrow(work, "term string, toxic int, half int").groupBy("term").agg(
        *[F.count_if((F.col("half") == h) & (F.col("toxic") == y)).alias(f"c{h}{y}") for h in (0, 1) for y in (0, 1)]
    )
    terms = written(terms, "toxicity-terms")  # read by each of the three lexicons
    out = []
    for halves in ((0,), (1,), (0, 1)):
        c1, c0 = (sum((F.col(f"c{h}{y}") for h in halves), F.lit(0)) for y in (1, 0))
        n1, n0 = (sum(n[h][i] for h in halves) for i in (0, 1))
        odds = F.log((c1 + 0.5) / (n1 + 1.0)) - F.log((c0 + 0.5) / (n0 + 1.0))
        low = odds - ERRORS * F.sqrt(1 / (c1 + 0.5) + 1 / (c0 + 0.5))
        found = terms.select("term", odds.alias("odds"), low.alias("low")).filter((F.col("low") >= LEAST_ODDS)).orderBy(F.desc("low"), "term").limit(TERMS).collect()
        out.append(Lexicon({r["term"]: r["odds"] for r in found if not r["term"].endswith("*")}, {r["term"][:-1]: r["odds"] for r in found if r["term"].endswith("*")}))
    return out, n


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    got = written(training_rows(docs, labels, rows), "toxicity-train")
    lexicons, n = learn_lexicons(got)
    toxic, clean = (sum(h[i] for h in n) for i in (0, 1))
    share = toxic / (toxic + clean) if toxic + clean else 0.0
    none = np.array([0.0])
    if not toxic or not clean:
        return Model(lexicons[2], None, none, none, share)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            halves = batch.column(2).to_pylist()
            x = [features(t, lexicons[1 - h]) for t, h in zip(batch.column(0).to_pylist(), halves, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(3), pa.array(x, pa.list_(pa.float64())), batch.column(1), batch.column(2)], names=["doc_id", "x", "toxic", "half"])

    dense = got.select("text", "toxic", "half", "doc_id").mapInArrow(work, "doc_id long, x array<double>, toxic int, half int").orderBy("doc_id", "x").toPandas()
    x, y, half = np.array(dense["x"].tolist(), float), dense["toxic"].to_numpy(float), dense["half"].to_numpy()
    apart = np.zeros(len(y))
    for h in (0, 1):
        other = half != h
        apart[half == h] = fit_trees(x[other], y[other]).margin(x[half == h]) if 0 < y[other].sum() < other.sum() else 0.0
    xs, ys = fit_isotonic(apart, y)
    return Model(lexicons[2], fit_trees(x, y), xs, ys, share)


def score(docs: DataFrame, model: Model, text: str = "text", score_col: str = "score") -> DataFrame:
    """docs with the score of each text; all columns stay (one that is named like score_col is replaced)."""
    kept = [c for c in docs.columns if c != score_col]
    one = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(kept)])  # plain names, whatever the columns are called
    fields = [T.StructField(c, f.dataType, f.nullable) for c, f in zip(kept, one.schema.fields, strict=True)]
    at = kept.index(text)
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # at most TERMS terms and TREES trees

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = shipped.value.score([t or "" for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], names=[*kept, score_col])

    return one.mapInArrow(work, T.StructType([*fields, T.StructField(score_col, T.DoubleType())]))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return got.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLES: dict[str, str] = {}
