"""Exact top-k inner products through a pivot-distance index.

Vectors are turned into integers and lifted by one coordinate sqrt(M - |v|^2) (M the largest squared norm), which
makes all norms equal, so that the largest inner product is the least distance. Each vector is keyed by its nearest
pivot and its distance to it; a pivot's distances are cut into annuli, and those into blocks of bounded size by a hash
of the row, so that many equal vectors do not meet in one task. A query first searches its own block, which gives it a
k-th score to beat. It then goes to the annuli that can still hold a better score by the triangle inequality: for pivot
distance d of the query and an annulus from r1 to r2, no vector inside is nearer than max(d - r2, r1 - d, 0). Inside a
block the rows are sorted by distance and searched in narrow annuli, the nearest first; what is found raises the score
to beat, and the search stops where no annulus can reach it. Scores are exact integers.

Vectors of different lengths have no inner product: each length has pivots of its own and is searched among its own.
Where many queries come to a block they are dealt into turns of about TURN_QUERIES, each with a copy of the block's rows.

Parameter with a bound: pivots come from the SAMPLE rows of least hash, shared by the lengths in proportion to their
rows (LEAST rows of a length at least); their number grows with the rows up to MOST_PIVOTS, and annuli are cut at the
sample's quantiles. Every row is indexed, and the answer is exact whatever the pivots are.

Defined results: vectors that are null, empty, or hold null or non-finite components (or ones that are not finite once
multiplied), and rows without an id take no part; scores that a long cannot hold count as the nearest long; a query's
own id is no candidate; rows that repeat id and vector count as candidates each; ties go to the smaller id; with fewer
than k candidates all are returned; of query rows that repeat an id the one with the least vector asks; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import table, written

SCALE = 256
SAMPLE, LEAST = 4_000, 16
#: Pivots of a length: one for each so many rows, between these two numbers; and annuli of each.
PIVOT_ROWS, FEWEST_PIVOTS, MOST_PIVOTS, ANNULI = 8_192, 16, 256, 6
#: Rows of a block, queries that travel together, and queries that meet a block's rows in one task.
BLOCK_ROWS, QUERY_ROWS, TURN_QUERIES = 4_096, 256, 16_384
#: Rows of the annuli that a block is searched by.
RING = 512
K, EVERY = 5, 50
#: Scores are longs; the least one stands for none.
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def integers(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(key, v): floor(scale * component), as doubles, of the rows that take part."""
    v = F.transform(F.col(vector), lambda x: x.cast("double") * scale)
    sound = F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.coalesce(sound, F.lit(False))
    # Doubles beyond 2^53 are integers already, and a long may not hold them.
    whole = F.transform(v, lambda x: F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x))
    return vectors.filter(sound).select(F.col(key).cast("long").alias("vec_id"), whole.alias("v"))


class Pivots:
    """Pivots in lifted coordinates, and each one's annulus limits."""

    def __init__(self, sample: np.ndarray, most: float, pivots: int = FEWEST_PIVOTS, annuli: int = ANNULI):
        # Distances of lifted vectors are off by so much at most, for all roundings of their squares together.
        self.slack = math.sqrt(16.0 * (sample.shape[1] + 2) * 2.3e-16 * most) + 1e-9
        self.bounded = math.isfinite(most * 8.0)
        self.kind = np.int32 if most < 2.0**61 else np.float64  # what a component is stored as
        if not self.bounded:  # squares overflow: one cell, nothing is pruned
            self.most, self.at, self.limits = most, np.zeros((1, sample.shape[1] + 1)), [np.empty(0)]
            return
        x = self.lift(sample, most)
        chosen = [0]
        far = np.linalg.norm(x - x[0], axis=1)
        while len(chosen) < min(pivots, len(x)):  # the farthest next; stops early where all the rest are copies
            k = int(far.argmax())
            if far[k] <= 0:
                break
            chosen.append(k)
            far = np.minimum(far, np.linalg.norm(x - x[k], axis=1))
        self.most, self.at = most, x[chosen]
        for _ in range(5):  # a few rounds of k-means draw the pivots into the data
            near = self.distances(x).argmin(1)
            self.at = np.stack([x[near == p].mean(0) if (near == p).any() else self.at[p] for p in range(len(self.at))])
        d = self.distances(x)
        near = d.argmin(1)
        self.limits = [np.unique(np.quantile(d[near == p, p], np.linspace(0, 1, annuli + 1)[1:-1])) if (near == p).any() else np.empty(0) for p in range(len(self.at))]

    @staticmethod
    def lift(v: np.ndarray, most: float) -> np.ndarray:
        return np.hstack([v, np.sqrt(np.maximum(most - (v * v).sum(1), 0.0))[:, None]])

    def distances(self, lifted: np.ndarray) -> np.ndarray:
        if not self.bounded:
            return np.zeros((len(lifted), 1))
        return np.sqrt(np.maximum((lifted**2).sum(1)[:, None] + (self.at**2).sum(1)[None, :] - 2 * lifted @ self.at.T, 0.0))

    def cells(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell = pivot * 64 + annulus, distance) of each vector."""
        d = self.distances(self.lift(v, self.most))
        p = d.argmin(1)
        r = d[np.arange(len(v)), p]
        a = np.array([np.searchsorted(self.limits[i], x, "left") for i, x in zip(p.tolist(), r.tolist(), strict=True)], np.int64)
        return p * 64 + a, r

    def reach(self, d: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The highest inner product of queries at distance d with what lies from low to high, rounding included.

        |q - v|^2 = 2 * most - 2 q.v for lifted vectors.
        """
        if not self.bounded:
            return np.full((len(d), len(low)), np.inf)
        least = np.maximum(np.maximum(d - high[None, :], low[None, :] - d) - 2 * self.slack, 0.0)
        return (2 * self.most - least**2) / 2 + 1.0 + 1e-12 * self.most


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of each row's k highest scores, ties to the smaller id, the row's own id left out."""
    lowest = LOWEST
    by_id = np.argsort(ids, kind="stable")
    scores, ids = scores[:, by_id], ids[by_id]
    scores = np.where(ids[None, :] == own[:, None], lowest, scores)
    if scores.shape[1] > k:
        edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k : scores.shape[1] - k + 1]
        rows, cols = np.nonzero(scores >= np.maximum(edge, lowest + 1))
    else:
        rows, cols = np.nonzero(scores > lowest)
    got = scores[rows, cols]
    order = np.lexsort((cols, ~got, rows))
    rows, cols, got = rows[order], cols[order], got[order]
    first = np.searchsorted(rows, np.arange(len(scores)))
    keep = np.arange(len(rows)) - first[rows] < k
    return rows[keep], ids[cols[keep]], got[keep]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products as longs, the nearest where a long cannot hold one; in floating point while that is exact."""
    if not len(a) or not len(b):
        return np.empty((len(a), len(b)), np.int64)
    most_a, most_b, width = np.abs(a).max(1), np.abs(b).max(1), float(a.shape[1])
    if width * float(most_a.max()) * float(most_b.max()) < 2**53:
        return (a @ b.T).astype(np.int64)
    room = math.sqrt(2.0**62 / width)
    out = np.zeros((len(a), len(b)), np.int64)
    small_a, small_b = np.flatnonzero(most_a < room), np.flatnonzero(most_b < room)
    out[np.ix_(small_a, small_b)] = a[small_a].astype(np.int64) @ b[small_b].astype(np.int64).T
    for rows, cols in ((np.flatnonzero(most_a >= room), np.arange(len(b))), (small_a, np.flatnonzero(most_b >= room))):
        if len(rows) and len(cols):
            whole = lambda m: np.array([[int(x) for x in row] for row in m.tolist()], object)
            out[np.ix_(rows, cols)] = np.clip(whole(a[rows]) @ whole(b[cols]).T, LOWEST + 1, HIGHEST).astype(np.int64)
    return out


def matrix(column: list[bytes], own: Pivots, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), own.kind).reshape(-1, width).astype(float)


HITS = "query_id long, vec_id long, score long"


def pivots_of(base: DataFrame, asked: DataFrame) -> dict[int, Pivots]:
    """Pivots for each length that has vectors; the driver gets a row per length and the bounded sample."""
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    facts = base.groupBy(F.size("v").alias("width")).agg(F.max(norm).alias("most"), F.count(F.lit(1)).alias("n"))
    rows = {r["width"]: (r["most"], r["n"]) for r in facts.collect()}
    asking = {r["width"]: r["most"] for r in asked.groupBy(F.size("v").alias("width")).agg(F.max(norm).alias("most")).collect()}
    total = sum(n for _, n in rows.values())
    drawn = Window.partitionBy("width").orderBy("hash", "vec_id")
    one = base.select("vec_id", "v", F.size("v").alias("width"), F.xxhash64("vec_id", "v").alias("hash"))
    share = F.lit(LEAST)
    for width, (_, n) in rows.items():
        share = F.when(F.col("width") == width, max(LEAST, SAMPLE * n // total)).otherwise(share)
    sample = one.withColumn("nth", F.row_number().over(drawn)).filter(F.col("nth") <= SAMPLE).filter(F.col("nth") <= share).select("width", "v").toPandas() if rows else None
    out = {}
    for width, (most, n) in rows.items():
        mine = sample["v"][sample["width"] == width]
        out[width] = Pivots(np.stack([np.array(v, float) for v in mine]), max(most, asking.get(width, 0.0)), min(MOST_PIVOTS, max(FEWEST_PIVOTS, n // PIVOT_ROWS)))
    return out


def search(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products among the vectors."""
    spark = vectors.sparkSession
    base = written(integers(vectors, key, vector), "vectors")
    asked = integers(queries, key, vector).groupBy("vec_id").agg(F.min("v").alias("v"))
    pivots = pivots_of(base, asked)
    if not pivots:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    shipped = spark.sparkContext.broadcast(pivots)  # MOST_PIVOTS vectors of each length at most

    def key_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for width in np.unique(widths).tolist():
                if width in shipped.value:  # a query of a length that no vector has finds nothing
                    rows = batch.take(pa.array(np.flatnonzero(widths == width)))
                    v = np.array(rows.column(1).flatten().to_numpy(zero_copy_only=False), float).reshape(-1, width)
                    cell, r = shipped.value[width].cells(v)
                    yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.full(len(v), width), pa.int32()), pa.array(cell, pa.int64()), pa.array(r, pa.float64()), pa.array([x.tobytes() for x in v.astype(shipped.value[width].kind)], pa.binary())], names=["vec_id", "width", "cell", "r", "v"])

    keyed = "vec_id long, width int, cell long, r double, v binary"
    index = written(base.select("vec_id", "v").mapInArrow(key_cells, keyed), "pivot-index")
    # One row per cell: at most MOST_PIVOTS * ANNULI of each length, so it may reach the driver and every task.
    cells = index.groupBy("width", "cell").agg(F.min("r").alias("low"), F.max("r").alias("high"), F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / BLOCK_ROWS).cast("int"))
    cells = written(cells, "pivot-cells")
    index = index.join(F.broadcast(cells.select("width", "cell", "parts")), ["width", "cell"]).withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")).cast("int")).drop("parts")
    asked = written(asked.mapInArrow(key_cells, keyed), "queries")
    turns = max(1, -(-asked.count() // TURN_QUERIES))
    table_of = {w: g.sort_values("cell", ignore_index=True) for w, g in cells.toPandas().groupby("width")}
    none = LOWEST

    def pack(rows: pd.DataFrame, width: int, cell: int, part: int, turn: int, floor: np.ndarray) -> tuple:
        return (width, cell, part, turn, rows["vec_id"].to_numpy(np.int64).tobytes(), b"".join(rows["v"]), floor.astype(np.int64).tobytes())

    packed = "width int, cell long, part int, turn int, ids binary, vs binary, floors binary"
    names = [c.split()[0] for c in packed.split(", ")]

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each query to one part of its own cell, or of the nearest cell that has rows."""
        for batch in batches:
            out = []
            for width, q in batch.groupby("width"):
                has, parts = table_of[width]["cell"].to_numpy(), table_of[width]["parts"].to_numpy()
                at = np.searchsorted(has, q["cell"].to_numpy()) % len(has)
                at = np.where(has[at] == q["cell"].to_numpy(), at, 0)
                part, turn = q["vec_id"].to_numpy() % parts[at], q["vec_id"].to_numpy() // 64 % turns
                out += [pack(g, width, c, p, t, np.full(len(g), none)) for (c, p, t), g in q.groupby([has[at], part, turn])]
            yield pd.DataFrame(out, columns=names)

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        """The queries of a turn that came to a block against its rows: annuli of RING rows, nearest first, until none can hold more."""
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3, names=["query_id", "vec_id", "score"])
        width, pivot = left["width"][0].as_py(), int(left["cell"][0].as_py()) // 64
        own = shipped.value[width]
        r = right["r"].to_numpy()
        order = np.argsort(r, kind="stable")
        ids, r = right["vec_id"].to_numpy()[order], r[order]
        v = matrix(right["v"].to_pylist(), own, width)[order]
        starts = np.arange(0, len(ids), RING)
        low, high = r[starts], r[np.minimum(starts + RING, len(r)) - 1]
        out: list[tuple] = []
        for q_ids, q_vs, floors in zip(*(left[c].to_pylist() for c in ("ids", "vs", "floors")), strict=True):
            all_q, all_v, all_f = np.frombuffer(q_ids, np.int64), matrix([q_vs], own, width), np.frombuffer(floors, np.int64)
            d = own.distances(own.lift(all_v, own.most))[:, pivot]
            near_first = np.argsort(d, kind="stable")  # queries of like distance share their nearest annuli
            for a in range(0, len(all_q), QUERY_ROWS):
                b = near_first[a : a + QUERY_ROWS]
                q, qv, floor = all_q[b], all_v[b], all_f[b].copy()
                found = np.full((len(q), k), none)
                bound = own.reach(d[b][:, None], low, high)
                for ring in np.argsort(-bound.max(0), kind="stable").tolist():
                    asks = np.flatnonzero(bound[:, ring] >= floor)
                    if not len(asks):
                        continue
                    rows = slice(starts[ring], starts[ring] + RING)
                    at, hit, score = best(products(qv[asks], v[rows]), ids[rows], q[asks], k)
                    good = score >= floor[asks][at]
                    at, hit, score = asks[at[good]], hit[good], score[good]
                    out.append((q[at], hit, score))
                    # What was found raises the floor: the k-th best score of each query so far.
                    place = np.arange(len(at)) - np.searchsorted(at, at)
                    fresh = np.full((len(q), k), none)
                    fresh[at, place] = score
                    found = np.sort(np.concatenate((found, fresh), axis=1), axis=1)[:, ::-1][:, :k]
                    floor = np.maximum(floor, found[:, k - 1])
        cols = [np.concatenate([o[i] for o in out]) if out else np.empty(0, np.int64) for i in range(3)]
        return pa.table([pa.array(x, pa.int64()) for x in cols], names=["query_id", "vec_id", "score"])

    place = ["width", "cell", "part", "turn"]

    def visit(asks: DataFrame, label: str) -> DataFrame:
        rows = index.withColumn("turn", F.lit(0))
        if turns > 1:  # a block's rows go to the turns that ask for it, and to no other
            asks = written(asks, label)
            rows = index.join(written(asks.select(*place).distinct(), f"{label}-places"), place[:3])
        return asks.groupBy(*place).cogroup(rows.select(*place, "vec_id", "r", "v").groupBy(*place)).applyInArrow(answer, HITS)

    first = written(visit(asked.mapInPandas(near, packed), "asks-near"), "hits-near")
    floors = first.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list("score"), False), 1, k).alias("top"))
    floors = floors.select(F.col("query_id").alias("vec_id"), F.when(F.size("top") == k, F.element_at("top", k)).alias("floor"))
    second = asked.join(floors, "vec_id", "left").select("vec_id", "width", "v", F.coalesce("floor", F.lit(none)).alias("floor"))

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The cells that can still hold a score as high as the k-th so far; a query's first part is among them again."""
        for batch in batches:
            out = []
            for width, q in batch.groupby("width"):
                own, has = shipped.value[width], table_of[width]
                at, parts = has["cell"].to_numpy(), has["parts"].to_numpy()
                v = matrix(q["v"].tolist(), own, width)
                d = own.distances(own.lift(v, own.most))[:, at // 64]
                floor, ids, turn = q["floor"].to_numpy(np.int64), q["vec_id"].to_numpy(np.int64), q["vec_id"].to_numpy() // 64 % turns
                asks = reach_cells(own, d, has) >= floor[:, None]
                for j in np.flatnonzero(asks.any(0)).tolist():
                    for t in np.unique(turn[asks[:, j]]).tolist():
                        rows = np.flatnonzero(asks[:, j] & (turn == t))
                        some = ids[rows].tobytes(), v[rows].astype(own.kind).tobytes(), floor[rows].tobytes()
                        out += [(width, int(at[j]), p, t, *some) for p in range(int(parts[j]))]
            yield pd.DataFrame(out, columns=names)

    hits = visit(second.mapInPandas(expand, packed), "asks")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def reach_cells(own: Pivots, d: np.ndarray, cells: pd.DataFrame) -> np.ndarray:
    """The highest inner product of each query with what lies in each cell; d has a column per cell."""
    low, high = cells["low"].to_numpy(), cells["high"].to_numpy()
    return np.hstack([own.reach(d[:, j : j + 1], low[j : j + 1], high[j : j + 1]) for j in range(len(low))])


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))


QUERIES = {"op8_exact_topk": op8_exact_topk}
ORACLES = {
    "op8_exact_topk": f"""
    WITH v AS (SELECT vec_id, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND c.vec_id <> q.vec_id),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
    """
}
