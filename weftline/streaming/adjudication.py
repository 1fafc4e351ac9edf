"""The adjudication loop as a stream: new pool files are decided once each, across restarts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.operators import adjudicate


def run_available(spark: SparkSession, pool_dir: str, schema: str, log_dir: str, checkpoint: str, client: Callable[[str], str], model: str, size: int = 15):
    """Processes the pool files that are there now and stops; the checkpoint keeps what is done."""

    def decide(batch: DataFrame, _: int) -> None:
        log = spark.read.schema(adjudicate.LOG).json(log_dir)
        _, todo = adjudicate.split_by_cache(batch, log)
        adjudicate.call(adjudicate.requests(todo, ["key"], size), client, model).write.mode("append").json(log_dir)

    stream = spark.readStream.schema(schema).json(pool_dir)
    return stream.writeStream.foreachBatch(decide).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
