"""Exact dedup against a persistent digest index.

The index is a table bucketed and sorted by the digest of the normalised text. A batch is first reduced to one row
per digest (partial aggregation, so a group of copies costs one row per task), then the digests that the index
lacks are found by a sort-merge anti-join and appended; texts themselves are never shuffled for this.

Groups are told to their rows by a sort-merge join with the index. Rows of hot digests, those of more than a
HOT_SHARE-th of the batch, do not go through it: there are at most HOT_SHARE of them, so their index rows are broadcast.

Defined results: a null text is an empty one; texts are equal when identical after lower-casing A-Z; within a
batch the largest doc_id stays (a null doc_id only where no other exists); of rows that repeat doc_id and text one
stays (which one is settled by the other columns, but for maps); across batches the row indexed first stays; empty
tables give empty tables. Further columns, whatever their names and types, stay in ``deduplicate`` and are ignored by ``assign``.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import LOWER, UPPER, ascii_lower, new_path, repeated, row_order, table, unused, written

#: Least number of buckets, and digests of a bucket beyond which there are more.
BUCKETS, BUCKET_ROWS = 32, 1_000_000
#: A digest is hot from this share of a batch's rows on, and from HOT_ROWS rows on.
HOT_SHARE, HOT_ROWS = 10_000, 5_000


def buckets_for(rows: int) -> int:
    """Buckets of an index that starts with so many rows."""
    n = BUCKETS
    while n * BUCKET_ROWS < rows:
        n *= 2
    return n


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256))


class DigestIndex:
    """digest -> (keep_id, group_size, batch), kept under path; a later session opens the same path again."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        """``buckets`` counts for a new index only; one that exists tells its own number by an empty file."""
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        marks = list(fs.globStatus(at(f"{path}/_buckets-*")) or [])
        if marks:
            buckets = int(marks[0].getPath().getName().split("-")[1])
        else:
            fs.create(at(f"{path}/_buckets-{buckets}")).close()
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = "digest_index_" + hashlib.sha256(path.encode()).hexdigest()[:24]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, group_size BIGINT, batch INT) "
            f"USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, groups: DataFrame, batch: int = 0) -> None:
        """Adds the rows (digest, keep_id, group_size) whose digest the index lacks."""
        fresh = groups.hint("merge").join(self.table().select("digest"), "digest", "left_anti")
        rows = fresh.select("digest", "keep_id", "group_size", F.lit(batch).alias("batch"))
        rows.repartition(self.buckets, "digest").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(digest, id, copies): the batch's rows, those that repeat key and text counted."""
    return written(docs.select(digest(F.col(text)).alias("digest"), F.col(key).cast("long").alias("id")).groupBy("digest", "id").agg(F.count(F.lit(1)).alias("copies")), "digests")


def group(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.max("id").alias("keep_id"), F.sum("copies").alias("group_size"))


def with_groups(rows: DataFrame, index: DigestIndex) -> DataFrame:
    """The batch's rows with the index's row of their digest; hot digests are joined without a shuffle."""
    n = rows.count()
    known = index.table().withColumnRenamed("batch", "first_batch")
    hot = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max(HOT_ROWS, n // HOT_SHARE)).select("digest")  # at most HOT_SHARE rows
    hot = written(hot, "hot-digests")
    hot_known = written(known.join(F.broadcast(hot), "digest", "left_semi"), "hot-groups")
    cold = rows.join(F.broadcast(hot), "digest", "left_anti")
    return cold.hint("merge").join(known, "digest").unionByName(rows.join(F.broadcast(hot_known), "digest"))


def assign(docs: DataFrame, index: DigestIndex, batch: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Appends docs to the index; returns a row per document: key, keep_id, group_size, kept, digest."""
    rows = digests(docs, key, text)
    index.append(group(rows), batch)
    each = repeated(with_groups(rows, index), "copies", "copy")
    kept = (F.col("first_batch") == batch) & F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return each.select(F.col("id").alias(key), "keep_id", "group_size", kept.alias("kept"), "digest")


def deduplicate(docs: DataFrame, index: DigestIndex, batch: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The whole rows of docs that stay, and their index entries appended. Joins are on digest and key, so no group is hot."""
    rows = digests(docs, key, text)
    index.append(group(rows), batch)
    own, keep, pick = unused(docs.columns, "__digest", "__keep", "__row")
    winners = index.table().filter(F.col("batch") == batch).select("digest", F.col("keep_id").alias("keep"))
    wanted = rows.join(winners, (rows["digest"] == winners["digest"]) & rows["id"].eqNullSafe(winners["keep"]), "left_semi")
    wanted = written(wanted.select(F.col("digest").alias(own), F.col("id").alias(keep), "copies"), "winners")
    keyed = docs.withColumn(own, digest(F.col(text)))

    def rows_of(some: DataFrame) -> DataFrame:
        return keyed.join(some, (keyed[own] == some[own]) & keyed[key].cast("long").eqNullSafe(some[keep]), "left_semi")

    # A row that repeats key and text goes through the second branch, where one of its copies is picked.
    columns = [F.col(f"`{c}`") for c in docs.columns]
    single = rows_of(wanted.filter("copies = 1").select(own, keep)).select(*columns)
    again = rows_of(wanted.filter("copies > 1").select(own, keep))
    picked = again.groupBy(own).agg(F.min_by(F.struct(*columns), row_order(docs)).alias(pick))
    return single.union(picked.select(*[F.col(pick)[c].alias(c) for c in docs.columns]))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = DigestIndex(spark, new_path(spark, "digest-index"), buckets_for(docs.count()))
    return assign(docs, index).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


QUERIES = {"op5_exact_dedup": op5_exact_dedup}
ORACLES = {
    "op5_exact_dedup": f"""
    WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS h FROM documents),
         g AS (SELECT h, max(doc_id) AS keep_id, CAST(count(*) AS BIGINT) AS group_size FROM t GROUP BY h)
    SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.h AS text_sha256
    FROM t JOIN g ON t.h = g.h
    """
}
