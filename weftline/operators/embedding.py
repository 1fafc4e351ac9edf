"""Embedding of texts by an injected client, in batches that shrink on failure and recover, and a guarded cache.

The client is a function from a list of texts to a list of vectors. Calls run in the tasks that hold the texts.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.sources.shared import new_path
from weftline.sources.tables import content_hash

#: Texts of a request, the least number it is halved to, attempts beyond the first, and seconds of each wait.
BATCH, LEAST, RETRIES, PAUSE = 150, 5, 4, 1.5


def adaptive(texts: list[str], client: Callable[[list[str]], list[list[float]]], batch: int = BATCH, wait: Callable[[float], None] = time.sleep) -> Iterator[tuple[int, list[list[float]]]]:
    """(texts in the request, their vectors): a failed request is halved and tried again, a successful one lets the next double."""
    at, size = 0, batch
    while at < len(texts):
        attempt = 0
        while True:
            some = texts[at : at + size]
            try:
                got = client(some)
                if len(got) != len(some):
                    raise ValueError(f"{len(got)} vectors for {len(some)} texts")
                break
            except Exception as error:  # noqa: BLE001 - the service may raise anything
                attempt += 1
                if attempt > RETRIES or size <= LEAST:
                    raise RuntimeError(f"embedding failed for good at text {at} with {size} texts a request: {error}") from error
                size = max(LEAST, size // 2)
                wait(PAUSE * attempt)
        yield len(some), got
        at += len(some)
        size = min(batch, size * 2)


def embed(df: DataFrame, key: str, text: str, client: Callable[[list[str]], list[list[float]]], batch: int = BATCH, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """(key, embedding) of every row; a null text is an empty one."""
    one = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("__text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            done = 0
            for n, vectors in adaptive(rows.column(1).to_pylist(), client, batch, wait):
                yield pa.RecordBatch.from_arrays([rows.column(0).slice(done, n), pa.array(vectors, pa.list_(pa.float32()))], names=[key, "embedding"])
                done += n

    return one.mapInArrow(work, f"`{key}` {one.schema[key].dataType.simpleString()}, embedding array<float>")


def cached(df: DataFrame, key: str, text: str, client: Callable[[list[str]], list[list[float]]], path: str, model: str, **options) -> DataFrame:
    """The embeddings of df from the newest table under path, if it was made from the same texts by the same model, else from
    the client; what is made anew is a new version with its guard (content hash, count, model) beside it.
    """
    spark = df.sparkSession
    now = content_hash(df, text).select("n", "content_hash", F.lit(model).alias("model")).first()
    guards = spark.read.schema("n long, content_hash string, model string, vectors string, at double").json(path) if exists(df, path) else None
    if guards is not None:
        same = guards.filter((F.col("n") == now["n"]) & (F.col("content_hash") == now["content_hash"]) & (F.col("model") == model)).orderBy(F.desc("at")).first()
        if same is not None:
            found = spark.read.parquet(same["vectors"])
            if found.count() == now["n"]:
                return found
    vectors = new_path(spark, "embeddings")
    embed(df, key, text, client, **options).write.parquet(vectors)
    guard = {"n": now["n"], "content_hash": now["content_hash"], "model": model, "vectors": vectors, "at": time.time()}
    spark.range(0, 1, 1, 1).select(*[F.lit(v).alias(k) for k, v in guard.items()]).write.mode("append").json(path)
    return spark.read.parquet(vectors)


def exists(df: DataFrame, path: str) -> bool:
    context = df.sparkSession.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(context._jsc.hadoopConfiguration()).exists(at)


def letter_counts(texts: list[str]) -> list[list[float]]:
    """Stands in for a model: how often each of A-Z and 0-9 occurs."""
    return [[float(t.count(c)) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"] for t in texts]
