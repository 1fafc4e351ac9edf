"""Mixing sources to target weights by cube-method balanced sampling.

Targets come from water filling: sources (by code point, null last) weigh 5, 2, 1, repeating, and share 150% of all
words; none is above 2 times its source's words. A document of a source with inclusion number p = target / words is
taken floor(p) times for certain and once more with probability p - floor(p). Those fractional probabilities go
through the flight phase of the cube method, whose moves keep each source's expected words and documents: blocks of
a source move on their own until at most two units stay fractional, and the units left over are dealt into blocks again
until they are one block. The flight of that last block ends while a dozen units, spread over the sizes, are still
fractional. They land by the linear programme of the cube method: among all distributions over the 0/1 choices that keep
every unit's inclusion probability, the one of least expected miss in words and documents, from which one choice is drawn.

Blocks take the largest documents first, so what is left for landing is small. Every source goes its own way, so what
is taken of one does not depend on how large another is. Every draw comes from a generator
seeded with the source and block, and units are sorted before they move, so reruns agree.

Defined results: a null source is a source, last in order; a null text has no words; rows that repeat all of
doc_id, source and text are units of their own; a source without words has target 0 and each of its documents is
taken 0 times; an empty table gives an empty table; further columns, whatever their names and types, are kept by ``mix``
and do not matter here; of rows that repeat doc_id, source and text the extra copies go to those of least hash (maps do not count).
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import repeated, row_order, table, unused, word_count, written

#: Fixed values of the mix.
WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
CEILING = 2
BLOCK = 4096
#: A fraction nearer than this to 0 or 1 is settled.
TINY = 1e-9
SEED = 20
#: Units of a source that land together, and the weight of a mean document's words against one document there.
LANDING, WORDS_FIRST = 12, 50.0


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = SHARE_PERCENT, ceiling: int = CEILING) -> DataFrame:
    """(source, source_size, n_rows, target) from rows (source, size): one row per source.

    Capped sources are those whose cap per weight is under the water level; the level that leaves the exact sum
    follows from running sums over sources in that order. The windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w).cast("double") for w in weights]), ((F.row_number().over(rank) - 1) % len(weights)) + 1)
    per = per.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * ceiling).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    budget = F.sum("source_size").over(everything) * (percent / 100.0)
    left_cap = budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    left_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", left_cap / left_weight)
    # The level of the first source that it does not fill holds for all; beyond that the running sums mean nothing.
    per = per.withColumn("place", F.row_number().over(order))
    first = F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct("place", "level"))).over(everything)
    level = F.coalesce(first["level"], F.lit(float("inf")))
    return per.select("source", "source_size", "n_rows", F.least(F.col("weight") * level, F.col("cap")).alias("target"))


def flight(p: np.ndarray, size: np.ndarray, draw: random.Random) -> list[float]:
    """Moves fractions along the null-space of (1, size) until at most two are left; returns the new fractions."""
    x, z = p.tolist(), size.tolist()
    held: list[int] = []
    uniform = draw.random
    for k in range(len(x)):
        if x[k] <= TINY or x[k] >= 1 - TINY:
            x[k] = float(round(x[k]))
            continue
        held.append(k)
        while len(held) == 3 or (len(held) == 2 and z[held[0]] == z[held[1]]):
            if len(held) == 2:
                i, j = held
                moves = ((i, 1.0), (j, -1.0))
            else:
                a, b, c = held
                if z[a] == z[b] == z[c]:
                    moves = ((a, 1.0), (b, -1.0))
                else:
                    moves = ((a, float(z[b] - z[c])), (b, float(z[c] - z[a])), (c, float(z[a] - z[b])))
            up = down = float("inf")
            for i, u in moves:
                if u > 0:
                    up, down = min(up, (1 - x[i]) / u), min(down, x[i] / u)
                elif u < 0:
                    up, down = min(up, x[i] / -u), min(down, (1 - x[i]) / -u)
            step = up if uniform() * (up + down) < down else -down
            for i, u in moves:
                x[i] += step * u
                if x[i] <= TINY:
                    x[i] = 0.0
                elif x[i] >= 1 - TINY:
                    x[i] = 1.0
            held = [i for i in held if 0.0 < x[i] < 1.0]
    return x


def least_design(p: np.ndarray, cost: np.ndarray, choices: np.ndarray) -> np.ndarray:
    """Probabilities of the 0/1 choices that keep the inclusion probabilities p at the least expected cost: simplex method.

    One row per unit and one for the sum; artificial variables of a high cost start it, and Bland's rule ends any cycle.
    """
    rows = len(p) + 1
    a = np.hstack([np.vstack([choices.T.astype(float), np.ones(len(choices))]), np.eye(rows)])
    b = np.append(p, 1.0)
    c = np.append(cost, np.full(rows, 1e4 * (1.0 + float(cost.max()))))
    basis = np.arange(len(choices), len(choices) + rows)
    for turn in range(5_000):
        x = np.linalg.solve(a[:, basis], b)
        less = c - np.linalg.solve(a[:, basis].T, c[basis]) @ a
        less[basis] = 0.0
        better = np.flatnonzero(less < -1e-9 * c[-1] / 1e4)
        if not len(better):
            break
        enter = int(better[0] if turn > 500 else better[np.argmin(less[better])])
        step = np.linalg.solve(a[:, basis], a[:, enter])
        falls = np.flatnonzero(step > 1e-10)
        ratio = np.maximum(x[falls], 0.0) / step[falls]
        ties = falls[ratio <= ratio.min() + 1e-12]
        basis[ties[np.argmin(basis[ties])]] = enter
    out = np.zeros(len(choices))
    real = basis < len(choices)
    out[basis[real]] = np.maximum(np.linalg.solve(a[:, basis], b)[real], 0.0)
    return out / out.sum()


def land(x: list[float], size: np.ndarray, draw: random.Random) -> list[float]:
    """Settles the few fractions left by a draw that keeps each one's probability and misses words and documents least."""
    open_ = [k for k, v in enumerate(x) if 0.0 < v < 1.0]
    if not open_:
        return x
    choices = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
    p = np.array([x[k] for k in open_])
    change = choices - p
    words = np.abs(change @ size[open_].astype(float)) / max(1.0, float(size.mean()))
    design = least_design(p, WORDS_FIRST * words + np.abs(change.sum(axis=1)), choices)
    chosen = choices[min(int(np.searchsorted(np.cumsum(design), draw.random(), "right")), len(design) - 1)]
    for k, v in zip(open_, chosen.tolist(), strict=True):
        x[k] = float(v)
    return x


def last_flight(p: np.ndarray, size: np.ndarray, draw: random.Random) -> list[float]:
    """Flight of a source's last block until LANDING units, spread over the sizes, are fractional at most; then the landing."""
    late = np.unique(np.linspace(0, len(p) - 1, min(LANDING - 2, len(p))).astype(int))
    early = np.setdiff1d(np.arange(len(p)), late)
    x = p.astype(float)
    x[early] = flight(p[early], size[early], draw)
    return land(x.tolist(), size, draw)


UNIT = "doc_id long, no_id boolean, source string, size long, ident long, n long, nth long, base long, p double"


def mover(turn: int, seed: int):
    """What moves one block of one source; ``last`` says that it is the source's only one."""

    def move(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", "ident", "nth"], ascending=[False, True, True, True], ignore_index=True)
        size = pdf["size"].to_numpy(np.int64)
        draw = random.Random(f"{seed}/{pdf['source'].iloc[0]}/{turn}/{pdf['block'].iloc[0]}")
        pdf["p"] = (last_flight if pdf["last"].iloc[0] else flight)(pdf["p"].to_numpy(float), size, draw)
        return pdf.drop(columns=["block", "last"])

    return move


def identity() -> Column:
    """What tells units of one source apart: a hash of doc_id, source and text."""
    return F.xxhash64("doc_id", "source", F.coalesce(F.col("text"), F.lit("")))


def units(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The thin table (doc_id, source, size, ident, n) and the targets; rows equal in all of these are counted in n."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), identity().alias("ident"))
    thin = written(rows.groupBy("doc_id", "source", "size", "ident").agg(F.count(F.lit(1)).alias("n")), "mix-units")
    return thin, written(targets(thin.select("source", (F.col("size") * F.col("n")).alias("size"))), "mix-targets")


def choose(thin: DataFrame, goal: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, ident, n, nth, copies): how many times each unit is taken."""
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    base = F.floor(ratio + TINY).cast("long")
    # One row per source on the other side: Spark broadcasts it while it is small and splits a hot source beyond that.
    rows = thin.join(goal.select(F.col("source").alias("__s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("__s")))
    rows = repeated(rows, "n", "nth").select(F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"), F.isnull("doc_id").alias("no_id"), "source", "size", "ident", "n", "nth", base.alias("base"), F.greatest(ratio - base, F.lit(0.0)).alias("p"))
    fractional = (F.col("p") > TINY) & (F.col("p") < 1 - TINY)
    out, left, turn = rows.filter(~fractional), rows.filter(fractional), 0
    while True:
        counts = left.groupBy("source").agg(F.count(F.lit(1)).alias("open"))
        if not counts.limit(1).count():
            break
        blocks = counts.select(F.col("source").alias("__s"), F.ceil(F.col("open") / block).alias("__blocks"))
        dealt = left.join(blocks, F.col("source").eqNullSafe(F.col("__s"))).withColumn("block", F.pmod(F.xxhash64("doc_id", "ident", "nth", F.lit(turn)), F.col("__blocks"))).withColumn("last", F.col("__blocks") == 1)
        moved = written(dealt.drop("__s", "__blocks").groupBy("source", "block").applyInPandas(mover(turn, seed), UNIT), "mix-round")
        out, left, turn = out.unionByName(moved.filter(~fractional)), moved.filter(fractional), turn + 1
    return out.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "source", "size", "ident", "n", "nth", (F.col("base") + F.round("p").cast("long")).alias("copies"))


def mix(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as many times as the mix takes it; all columns stay."""
    thin, goal = units(docs)
    key, ident, doc, source, n, copies, rank, copy = unused(docs.columns, "__key", "__ident", "__doc", "__source", "__n", "__copies", "__rank", "__copy")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    plan = choose(thin, goal).groupBy("ident", "doc_id", "source").agg(F.max("n").alias(n), F.sum("copies").alias(copies)).filter(F.col(copies) > 0)
    plan = plan.select(F.col("ident").alias(ident), F.col("doc_id").alias(doc), F.col("source").alias(source), n, copies)
    keyed = docs.withColumn(key, identity())
    joined = keyed.join(plan, (F.col(key) == F.col(ident)) & F.col("doc_id").eqNullSafe(F.col(doc)) & F.col("source").eqNullSafe(F.col(source)))
    once = joined.filter(F.col(n) == 1).select(*columns, copies)
    same = Window.partitionBy(ident, doc, source).orderBy(row_order(docs))
    share = F.floor(F.col(copies) / F.col(n)) + F.when(F.col(rank) <= F.col(copies) % F.col(n), 1).otherwise(0)
    several = joined.filter(F.col(n) > 1).withColumn(rank, F.row_number().over(same)).withColumn(copies, share)
    return repeated(once.union(several.select(*columns, copies)), copies, copy).select(*columns)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    thin, goal = units(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    got = choose(thin, goal)
    joined = got.join(goal.select(F.col("source").alias("__s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("__s")))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


QUERIES = {"op3_mixing": op3_mixing}
ORACLES: dict[str, str] = {}
