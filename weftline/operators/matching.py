"""Candidate retrieval and re-ranking for entity matching.

Both retrievers, by n-grams and by vectors, search blocks of catalog rows for turns of queries; no pair leaves a task but the
best of each block. Ties always go to the smaller catalog id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as tx
from weftline.operators.nearest import Best, Ragged, gram_sets, spelled, words
from weftline.sources.shared import together, written

DIGITS = 6
HIGH, MEDIUM = 90, 70
BLOCK_ROWS, TURN_QUERIES = 16_384, 4096
#: Rows and words of a catalog block in the search by n-grams; for both searches the rows that meet a batch of queries at once and
#: the queries of a batch; the numbers that a batch's table by words may hold (with more words, batches are smaller).
SPARSE_ROWS, SPARSE_WORDS, SEED_ROWS, BATCH_QUERIES, BATCH_CELLS = 32_768, 262_144, 512, 256, 2**22


def gram_counts(rows: DataFrame, key: str, name: str) -> DataFrame:
    return rows.select(F.col(key), F.explode(tx.char_ngrams(F.col(name))).alias("gram")).groupBy(key, "gram").agg(F.count(F.lit(1)).alias("tf"))


def tfidf(catalog: DataFrame, queries: DataFrame, key: str, query_key: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(key, gram, weight) of both sides: smooth idf of the catalog, rows scaled to length 1."""
    counts = written(gram_counts(catalog, key, name), "gram-counts")  # read for both sides
    total = catalog.select(F.countDistinct(key).alias("total"))  # one row
    idf = counts.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(total)).select("gram", (F.log((F.col("total") + 1) / (F.col("df") + 1)) + 1).alias("idf"))

    def scaled(c: DataFrame, k: str) -> DataFrame:
        w = c.join(idf, "gram").withColumn("raw", F.col("tf") * F.col("idf"))
        return w.withColumn("weight", F.col("raw") / F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(k)))).select(k, "gram", "weight")

    return scaled(counts, key), scaled(gram_counts(queries, query_key, name), query_key)


def top(scores: DataFrame, query_key: str, key: str, k: int) -> DataFrame:
    w = Window.partitionBy(query_key).orderBy(F.desc("score"), F.asc(key))
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def word_bags(rows: DataFrame, key: str, name: str) -> DataFrame:
    """(key, words): the lower-case words of all rows of a key, sorted."""
    found = F.filter(F.split(F.lower(F.col(name)), r"\s+"), lambda w: F.length(w) > 0)
    one = rows.filter(F.col(key).isNotNull()).select(key, F.coalesce(found, F.array().cast("array<string>")).alias("words"))
    return one.groupBy(key).agg(F.array_sort(F.flatten(F.collect_list("words"))).alias("words"))


def dealt(bags: DataFrame, key: str, rows: int, words: int) -> tuple[DataFrame, int, int]:
    """(bags with a part, number of parts, number of bags): parts of about that many rows and words at most."""
    n = bags.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("words")).first()
    parts = max(1, -(-n["rows"] // rows), -(-n["words"] // words))
    return bags.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")), parts, n["rows"]


def gram_rows(bags: DataFrame) -> DataFrame:
    """(part, gram, n): how many of the part's bags have the gram."""

    def count(t: pa.Table) -> pa.Table:
        vocabulary, rows = words(t["words"])
        grams = {g: i for i, g in enumerate(dict.fromkeys(g for w in vocabulary for g in tx.word_ngrams(w)))}
        n = np.zeros(len(grams), np.int64)
        for _, _, gram, _ in gram_sets(rows, spelled(vocabulary, grams), max(1, len(grams))):
            n += np.bincount(gram, minlength=len(grams))
        return pa.table({"part": pa.array([t["part"][0].as_py()] * len(grams), pa.int32()), "gram": pa.array(list(grams), pa.string()), "n": n})

    return bags.groupBy("part").applyInArrow(count, "part int, gram string, n long")


def measured(bags: DataFrame, grams: DataFrame, key: str) -> DataFrame:
    """bags with ``norm``, the length of their tf-idf vector over the grams (part, gram, idf); bags without such a gram are left out."""

    def measure(t: pa.Table, g: pa.Table) -> pa.Table:
        idf, (vocabulary, rows) = g["idf"].to_numpy(), words(t["words"])
        norm = np.zeros(t.num_rows)
        for a, row, gram, tf in gram_sets(rows, spelled(vocabulary, {x: i for i, x in enumerate(g["gram"].to_pylist())}), max(1, len(idf))):
            n = min(4096, t.num_rows - a)
            norm[a : a + n] = np.sqrt(np.bincount(row, (tf * idf[gram]) ** 2, n))
        return t.select([key, "words", "part"]).append_column("norm", pa.array(norm)).filter(pa.array(norm > 0))

    kind = bags.schema[key].dataType.simpleString()
    return bags.select(key, "words", "part").groupBy("part").cogroup(grams.groupBy("part")).applyInArrow(measure, f"`{key}` {kind}, words array<string>, part int, norm double")


def sparse_topk(catalog: DataFrame, queries: DataFrame, key: str, query_key: str, name: str, k: int = 8) -> DataFrame:
    """(query_key, key, score, rank) by cosine of tf-idf vectors; rows without a common gram never count.

    Grams lie inside words, so a score is the sum, over the words of the catalog row, of what the word's grams are worth to the query.
    That worth is worked out once for each word of a block and each query; a row then costs one addition a word, not one a gram.
    Blocks of catalog rows are searched for turns of queries, SEED_ROWS rows at a time against the best scores so far. Queries of the
    same words are asked once. Exact: every query meets every row of the catalog.
    """
    def of_catalog() -> tuple:
        c, blocks, total = dealt(written(word_bags(catalog, key, name), "sparse-rows"), key, SPARSE_ROWS, SPARSE_WORDS)
        grams = written(gram_rows(c), "sparse-grams")
        idf = grams.groupBy("gram").agg((F.log(F.lit(total + 1.0) / (F.sum("n") + 1)) + 1).alias("idf"))
        return c, blocks, idf, written(grams.join(idf, "gram").select("part", "gram", "idf"), "sparse-idf")

    def of_queries() -> tuple:
        asked = written(word_bags(queries, query_key, name), "sparse-queries")
        same = asked.groupBy("words").agg(F.min(query_key).alias("__as"))
        return asked, same, *dealt(written(same, "sparse-asked"), "__as", TURN_QUERIES, SPARSE_WORDS)

    (c, blocks, idf, c_grams), (asked, same, q, turns, _) = together(catalog.sparkSession, of_catalog, of_queries)
    q_grams = gram_rows(q).join(idf, "gram").select("part", "gram", "idf")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # A block's side of a search: its rows, and its grams with their idf in place of a norm.
    both = measured(c, c_grams, key).withColumn("gram", F.lit(None).cast("string")).unionByName(c_grams.select("part", "gram", F.col("idf").alias("norm")), allowMissingColumns=True)
    left = both.withColumnRenamed("part", "block").withColumn("turn", each(turns))
    right = measured(q, q_grams, "__as").withColumnRenamed("part", "turn").withColumn("block", each(blocks))
    chunk, most, cells, digits = SEED_ROWS, BATCH_QUERIES, BATCH_CELLS, DIGITS

    def search(q: pa.Table, c: pa.Table) -> pa.Table:
        marks, rows = c.filter(pc.is_valid(c["gram"])), c.filter(pc.is_null(c["gram"]))
        rows = rows.take(pc.sort_indices(rows, [(key, "ascending")]))
        index, idf = {g: i for i, g in enumerate(marks["gram"].to_pylist())}, marks["norm"].to_numpy()
        (c_words, c_rows), (q_words, q_rows) = words(rows["words"]), words(q["words"])
        c_spelled, q_grams = spelled(c_words, index), q_rows.inside(spelled(q_words, index))
        scale, q_scale = 1 / rows["norm"].to_numpy()[:, None], 1 / q["norm"].to_numpy()
        size = max(1, min(most, cells // max(1, len(c_words))))
        column, row, score = [], [], []
        for a in range(0, q.num_rows if rows.num_rows else 0, size):
            some = q_grams.part(a, a + size)
            n, by = len(some.lens), some.owner()
            used, local = np.unique(some.flat, return_inverse=True)
            worth = np.bincount(local * n + by, idf[some.flat] ** 2 * q_scale[a + by], len(used) * n).reshape(len(used), n)
            here = np.full(len(idf), -1)
            here[used] = np.arange(len(used))
            there = here[c_spelled.flat]
            order, by_word = Ragged(there[there >= 0], np.bincount(c_spelled.owner()[there >= 0], minlength=len(c_words))).sums(worth)
            table = np.empty_like(by_word)
            table[order] = by_word
            best = Best(n, k, digits, 0.0)
            for b in range(0, rows.num_rows, chunk):
                order, s = c_rows.part(b, b + chunk).sums(table)
                s *= scale[b + order]
                best.add(s, b + order)
            x, y, z = best.found()
            column.append(a + x)
            row.append(y)
            score.append(z)
        cat = lambda xs, t: np.concatenate(xs) if xs else np.empty(0, t)
        return pa.Table.from_arrays([q["__as"].take(pa.array(cat(column, np.int64))), rows[key].take(pa.array(cat(row, np.int64))), pa.array(cat(score, float))], names=["__as", key, "score"])

    kinds = f"__as {queries.schema[query_key].dataType.simpleString()}, `{key}` {catalog.schema[key].dataType.simpleString()}, score double"
    got = right.groupBy("block", "turn").cogroup(left.groupBy("block", "turn")).applyInArrow(search, kinds)
    best = top(got, "__as", key, k)
    return asked.join(same, "words").select(query_key, "__as").join(best, "__as").select(query_key, key, "score", "rank")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def dense_topk(catalog: DataFrame, queries: DataFrame, key: str, query_key: str, vector: str, k: int = 8, exclude_self: bool = False) -> DataFrame:
    """(query_key, key, score, rank) by cosine: turns of at most about TURN_QUERIES queries visit each block of catalog rows,
    matrix by matrix, so neither side of a task grows with the tables. A batch of queries meets the block's rows in chunks, against the
    best scores so far; a vector with non-finite components is near to nothing. Products in single precision tell which pairs may be
    above them, by the bound of their error; those alone are worked out in double precision, or the whole chunk where they are many.
    """
    batch, chunk, digits = BATCH_QUERIES, SEED_ROWS, DIGITS
    rows, asked_rows = together(catalog.sparkSession, catalog.count, queries.count)
    blocks, turns = max(1, -(-rows // BLOCK_ROWS)), max(1, -(-asked_rows // TURN_QUERIES))
    one = lambda df, c, own, many, other: df.select(F.col(c).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.pmod(F.xxhash64(c), F.lit(many[0])).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(many[1] - 1))).alias(other))
    left, right = one(catalog, key, "block", (blocks, turns), "turn"), one(queries, query_key, "turn", (turns, blocks), "block")

    def unit(x: pa.ChunkedArray) -> np.ndarray:
        m = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in x.chunks]).astype(float).reshape(len(x), -1)
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(norm > 0, norm, 1.0)

    def search(q: pa.Table, c: pa.Table) -> pa.Table:
        ids, scores, asked = [], [], []
        if q.num_rows and c.num_rows:
            order = np.argsort(c["id"].to_numpy())
            cid, cv, qid, qv = c["id"].to_numpy()[order], unit(c["v"])[order], q["id"].to_numpy(), unit(q["v"])
            c_single, q_single = cv.astype(np.float32), qv.astype(np.float32)
            error = (cv.shape[1] + 4) * 2.0**-23  # of a product of unit vectors in single precision, twice its bound
            for a in range(0, len(qid), batch):
                some = qid[a : a + batch]
                best = Best(len(some), k, digits, -1.5)
                for b in range(0, len(cid), chunk):
                    if best.floor.min() > -1:
                        near = (c_single[b : b + chunk] @ q_single[a : a + batch].T) > (best.floor - error).astype(np.float32)
                        if np.count_nonzero(near) * 32 <= near.size:
                            x, y = np.nonzero(near)
                            s = np.einsum("ij,ij->i", cv[b + x], qv[a + y])
                            over = s > best.floor[y]
                            if exclude_self:
                                over &= cid[b + x] != some[y]
                            best.put(b + x[over], y[over], s[over])
                            continue
                    s = cv[b : b + chunk] @ qv[a : a + batch].T
                    if exclude_self:
                        s[cid[b : b + chunk, None] == some[None, :]] = -2.0
                    best.add(s, np.arange(b, b + len(s)))
                column, row, score = best.found()
                asked.append(some[column])
                ids.append(cid[row])
                scores.append(score)
        cat = lambda xs, t: np.concatenate(xs) if xs else np.empty(0, t)
        return pa.table([pa.array(cat(asked, np.int64), pa.int64()), pa.array(cat(ids, np.int64), pa.int64()), pa.array(cat(scores, float), pa.float64())], names=[query_key, key, "score"])

    got = right.groupBy("block", "turn").cogroup(left.groupBy("block", "turn")).applyInArrow(search, f"{query_key} long, {key} long, score double")
    return top(got, query_key, key, k)


def union_candidates(*found: DataFrame, query_key: str, key: str) -> DataFrame:
    """Distinct (query, candidate) of several retrievers, as a sorted array per query."""
    both = found[0].select(query_key, key)
    for f in found[1:]:
        both = both.unionByName(f.select(query_key, key))
    return both.distinct().groupBy(query_key).agg(F.sort_array(F.collect_list(key)).alias("candidates"))


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over a."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    every = (1 << len(a)) - 1
    s = every
    for c in b:
        u = s & where.get(c, 0)
        s = (s + u | s - u) & every
    return len(a) - s.bit_count()


def token_sort_ratio(a: Column, b: Column) -> Column:
    """100 * 2 * LCS / (sum of lengths) of the texts with their words sorted; 100 for two empty texts."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else 100.0 if not p and not q else 200.0 * lcs(p, q) / (len(p) + len(q)) for p, q in zip(x, y, strict=True)], dtype="float64")

    return ratio(tx.sorted_tokens(a), tx.sorted_tokens(b))


def tier(score: Column, high: float = HIGH, medium: float = MEDIUM) -> Column:
    s = F.coalesce(score, F.lit(0.0))
    return F.when(s >= high, "HIGH_AUTO_ACCEPT").when(s >= medium, "MEDIUM_LLM_REVIEW").otherwise("LOW_NO_MATCH")


def rerank(queries: DataFrame, catalog: DataFrame, candidates: DataFrame, query_key: str, key: str, name: str, keep: int = 3) -> DataFrame:
    """Per query: best_match, best_score, tier and its ``keep`` best candidates; without candidates score 0 and the low tier."""
    pairs = candidates.select(query_key, F.explode("candidates").alias(key))
    pairs = pairs.join(queries.select(query_key, F.col(name).alias("__q")), query_key).join(catalog.select(key, F.col(name).alias("__c")), key)
    scored = top(pairs.withColumn("score", token_sort_ratio(F.col("__q"), F.col("__c"))), query_key, key, keep)
    best = scored.groupBy(query_key).agg(
        F.min_by("__c", "rank").alias("best_match"), F.min_by("score", "rank").alias("best_score"),
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "__c", "score"))), lambda s: F.struct(s["__c"].alias("name"), s["score"].alias("score"))).alias("top_candidates"),
    )
    out = queries.select(query_key, name).join(best, query_key, "left")
    return out.withColumn("best_score", F.coalesce("best_score", F.lit(0.0))).withColumn("tier", tier(F.col("best_score")))


def dedup_catalog(rows: DataFrame, row_id: str, name: str) -> DataFrame:
    """One row per normalised name: the first spelling, all row ids, in order of first appearance."""
    normal = tx.normalize_name(F.col(name))
    return rows.withColumn("name_normalized", normal).groupBy("name_normalized").agg(F.min_by(F.col(name), F.col(row_id)).alias("first_name"), F.sort_array(F.collect_list(row_id)).alias("row_ids"), F.min(row_id).alias("first_row"))
