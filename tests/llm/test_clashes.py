"""Further columns of any name and type, repeated rows, nulls and empty tables, for what keeps whole rows."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline  # noqa: E402
from weftline.llm import chat_format, exact_dedup, licenses, mixing, ngram_join  # noqa: E402
from weftline.llm.common import new_path, repeated, unused  # noqa: E402

NAMES = ["__key", "__digest", "__score", "__copies", "__text", "__row", "__id", "__keep", "digest", "copies", "n", "rows", "root", "cls", "id"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES) + ", tags map<string,int>, deep array<struct<m:map<string,string>>>, `a.b` int"


def rows():
    words = " ".join(f"w{i}" for i in range(40))
    texts = [(1, words), (2, words.upper()), (3, words + " more"), (4, None), (5, ""), (6, "one two"), (6, "one two"), (6, "one two"), (None, "x y z"), (None, None), (8, " ".join(f"v{i}" for i in range(30)))]
    return [(d, t, "en", "s" if (d or 0) % 2 else None, 1, *(f"{n}{k}" for n in NAMES), {"k": k}, [({"x": str(k)},)], k) for k, (d, t) in enumerate(texts)]


def table_of(spark, given):
    return spark.createDataFrame(given, SCHEMA)


def intact(df, given):
    """Every row of df is one of the given ones, all columns together."""
    known = {(r[5], r[-3]["k"], r[-1]) for r in given}
    assert df.columns == ["doc_id", "text", "lang", "source", "n_chars", *NAMES, "tags", "deep", "a.b"]
    got = df.collect()
    assert all((r["__key"], r["tags"]["k"], r["a.b"]) in known and r["deep"][0]["m"]["x"] == str(r["a.b"]) for r in got)
    return got


def test_exact_dedup_keeps_clashing_columns(spark):
    got = intact(exact_dedup.deduplicate(table_of(spark, rows()), exact_dedup.DigestIndex(spark, new_path(spark, "t"))), rows())
    assert sorted((str(r.doc_id), (r.text or "")[:5].lower()) for r in got) == [("2", "w0 w1"), ("3", "w0 w1"), ("5", ""), ("6", "one t"), ("8", "v0 v1"), ("None", "x y z")]


def test_ngram_join_keeps_clashing_columns(spark):
    got = intact(ngram_join.deduplicate(table_of(spark, rows())), rows())
    assert sorted(str(r.doc_id) for r in got) == sorted(["1", "4", "5", "6", "8", "None", "None"])


def test_near_copies_that_share_an_id_leave_one_row(spark):
    base = [f"w{i}" for i in range(60)]
    near = [" ".join([*base, f"end{k}"]) for k in range(4)]
    given = [(d, t, "en", "s", 1, *NAMES, {"k": 0}, [({"x": "0"},)], 0) for d, t in zip((7, 7, None, None), near, strict=True)]
    assert [r.doc_id for r in ngram_join.deduplicate(table_of(spark, given)).collect()] == [7]
    nameless = [(None, *g[1:]) for g in given]
    assert ngram_join.deduplicate(table_of(spark, nameless)).count() == 1


def test_mix_keeps_clashing_columns(spark):
    got = intact(mixing.mix(table_of(spark, rows())), rows())
    plan = mixing.choose(*mixing.units(table_of(spark, rows()))).agg(F.sum("copies")).first()[0]
    assert len(got) == plan > 0


def test_hot_digests_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", 20)
    given = [(i, "same" if i % 3 else f"t{i}") for i in range(300)] + [(1, "same")] * 5
    docs = spark.createDataFrame(given, "doc_id long, text string")
    index = exact_dedup.DigestIndex(spark, new_path(spark, "t"), 4)
    got = exact_dedup.assign(docs, index).collect()
    assert len(got) == 305 and {(r.keep_id, r.group_size) for r in got if r.doc_id % 3} == {(299, 205)} and sum(r.kept for r in got) == 101
    assert exact_dedup.DigestIndex(spark, index.path, 64).buckets == 4
    again = exact_dedup.assign(docs, index, batch=1)
    assert again.filter("kept").count() == 0
    assert exact_dedup.buckets_for(10) == 32 and exact_dedup.buckets_for(100_000_000) == 128


@pytest.mark.parametrize("empty", [False, True])
def test_stages_with_nulls_repeats_and_clashes(spark, tmp_path, empty):
    given = [] if empty else rows()
    labels = spark.createDataFrame([] if empty else [(1, None, 0), (2, None, 1), (8, 1, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = table_of(spark, given)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        docs = out
    assert set(corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).columns) == {"doc_id", "n_tokens", "round_trip", "ids"}
    assert docs.count() >= 0


def test_chats_and_licences_ignore_further_columns(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hi", "a", {"k": 1})], "conv_id long, turn long, role string, text string, formatted string, parsed map<string,int>")
    assert chat_format.digest_columns(chat_format.format_chats(turns)).first().n_turns == 1
    docs = table_of(spark, rows()).withColumnRenamed("lang", "license").withColumnRenamed("cls", "notices")
    assert licenses.scan(docs).count() == len(rows())


def test_helpers(spark):
    assert unused(["A", "a_"], "a", "b") == ["a__", "b"]
    df = spark.createDataFrame([(1, 0), (2, 3), (3, 20_000)], "k int, n long")
    got = {r.k: (r.c, r.m) for r in repeated(df, "n", "i").groupBy("k").agg(F.count("i").alias("c"), F.max("i").alias("m")).collect()}
    assert got == {2: (3, 3), 3: (20_000, 20_000)}
