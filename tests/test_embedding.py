import pytest
from pyspark.sql import functions as F

from weftline.operators import adjudicate, embedding


def test_batches_shrink_and_recover():
    sizes = []

    def client(texts):
        sizes.append(len(texts))
        if len(texts) > 40:
            raise RuntimeError("too many")
        return [[float(len(t))] for t in texts]

    waits = []
    got = [v for _, vs in embedding.adaptive(["x" * i for i in range(200)], client, 150, waits.append) for v in vs]
    assert got == [[float(i)] for i in range(200)] and sizes[:3] == [150, 75, 37] and 74 in sizes and waits[:2] == [1.5, 3.0]


def test_failure_for_good():
    def client(texts):
        raise RuntimeError("down")

    with pytest.raises(RuntimeError, match="for good at text 0"):
        list(embedding.adaptive(["a"] * 10, client, 150, lambda s: None))
    with pytest.raises(RuntimeError, match="for good"):
        list(embedding.adaptive(["a"] * 10, lambda t: [[1.0]], 150, lambda s: None))


def test_cache_is_guarded(spark, tmp_path):
    df = spark.createDataFrame([(1, "AB"), (2, None), (3, "B1")], "id long, name string")
    path = f"file://{tmp_path}/guard"

    def vectors(rows, model="m"):
        return {r.id: sum(r.embedding) for r in embedding.cached(rows, "id", "name", embedding.letter_counts, path, model).collect()}

    versions = lambda: spark.read.json(path).count()
    assert vectors(df) == {1: 2.0, 2: 0.0, 3: 2.0} and versions() == 1
    assert vectors(df.orderBy(F.desc("id"))) == {1: 2.0, 2: 0.0, 3: 2.0} and versions() == 1  # the same texts
    assert vectors(df.filter("id < 3")) == {1: 2.0, 2: 0.0} and versions() == 2  # other texts
    assert vectors(df, "other") == {1: 2.0, 2: 0.0, 3: 2.0} and versions() == 3  # another model


def test_purge_keeps_the_log_and_has_a_dry_run(spark, tmp_path):
    log = spark.createDataFrame([("a", "CONFIRM"), ("b", adjudicate.FAILED), ("c", None)], "key string, decision string")
    log.write.json(f"{tmp_path}/log")
    assert adjudicate.purge_log(spark, f"{tmp_path}/log", f"{tmp_path}/new", dry_run=True) == (1, 3) and not (tmp_path / "new").exists()
    assert adjudicate.purge_log(spark, f"{tmp_path}/log", f"{tmp_path}/new") == (1, 3)
    read = lambda p: sorted(r.key for r in spark.read.schema(adjudicate.LOG).json(f"{tmp_path}/{p}").collect())
    assert read("log") == ["a", "b", "c"] and read("new") == ["a", "c"]
