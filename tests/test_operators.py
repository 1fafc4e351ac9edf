import math

import pytest
from pyspark.sql import functions as F

from weftline.functions import calendar as cal
from weftline.functions import text as tx
from weftline.operators import adjudicate, asof, matching, metrics, panel, reshape, windows
from weftline.sources import tables


def column(df, name):
    return [r[name] for r in df.collect()]


GOLDEN = [
    ("Panadol Extra 24 Tablets", "Tablet", "24", "Tablet", "Panadol Extra", 1.0),
    ("BRAND SEAS SYRUP 120 ML", "Syrup", "120", "Bottle", "BRAND SEAS", 1.0),
    ("VIAGRA 50 MG 8 TAB", "Tablet", "8", "Tablet", "VIAGRA", 1.0),
    ("HAEMOJET 100MG IM 6 AMP", "Ampoule", "6", "Ampoule", "HAEMOJET IM", 1.0),
    ("ANISOL 20CAP", "Capsule", "20", "Capsule", "ANISOL", 1.0),
    ("MOVICOL ADULT 20 SACHETS", "Sachet", "20", "Sachet", "MOVICOL ADULT", 1.0),
    ("ALECO CARE CREAM 60GRAM", "Cream", "60", "Tube", "ALECO CARE", 1.0),
    ("BETADINE 10% ANTISEPTIC SOL 200ML", "Solution", "200", "Bottle", "BETADINE 10% ANTISEPTIC", 1.0),
    ("PENCITARD 1.2MIU VIAL", "Vial", None, "Vial", "PENCITARD 1.2MIU", 0.7),
    ("SYNTOCINON", None, None, None, "SYNTOCINON", 0.3),
    ("POVIDIN ANTISEPTIC 10% 100ML", None, None, None, "POVIDIN ANTISEPTIC 10% 100ML", 0.3),
    (None, None, None, None, None, None),
]


def test_extract_fields(spark):
    got = tx.extract_fields(spark.createDataFrame([(g[0],) for g in GOLDEN], "name string"), "name").collect()
    assert {(r.name, r.dosage_form, r.pack_size, r.unit_of_measure, r.trade_name, r.confidence) for r in got} == set(GOLDEN)
    assert [r.needs_review for r in got if r.name == "SYNTOCINON"] == [True]


def test_normalize_keeps_other_scripts(spark):
    df = spark.createDataFrame([("  a-b  (c) ",), ("بنادول اكسترا",), (None,)], "x string")
    assert column(df.select(tx.normalize_name(F.col("x")).alias("y")), "y") == ["A B C", "بنادول اكسترا", None]


def test_char_ngrams(spark):
    df = spark.createDataFrame([("ab c",)], "x string")
    assert sorted(column(df.select(F.explode(tx.char_ngrams(F.col("x"))).alias("g")), "g")) == sorted([" a", "ab", "b ", " ab", "ab ", " ab ", " c", "c ", " c "])


def test_tolerance_metric(spark):
    rows = [(10, 8.0, True), (10, 12.4, True), (10, 12.6, False), (0, 0.5, True), (0, 0.6, False), (2, 2.5, True)]
    df = spark.createDataFrame(rows, "y int, p double, want boolean")
    assert df.filter(metrics.correct(F.col("y"), F.col("p")) != F.col("want")).count() == 0


def test_errors_without_variance(spark):
    df = spark.createDataFrame([("m", 2.0, 3.0), ("m", 2.0, 1.0)], "model string, y double, p double")
    r = metrics.errors(df, ["model"], "y", "p").first()
    assert (r.mae, r.rmse, r.wape, r.r2) == (1.0, 1.0, 50.0, None)


def series(spark, values):
    return spark.createDataFrame([("a", i + 1, v) for i, v in enumerate(values)], "item string, t int, x long")


def test_smoothing_and_streaks(spark):
    w = windows.series(["item"])
    got = column(windows.smoothed(series(spark, [3, 0, 9, 4, 4]), ["item"], "x", "s").orderBy("t"), "s")
    assert got[0] is None and [round(v, 6) for v in got[1:]] == [3, 2.1, 4.17, 4.119]
    df = windows.streak_before(series(spark, [0, 0, 5, 0, 0, 0]), w, F.col("x") == 0, "n")
    assert column(df.orderBy("t"), "n") == [None, 1, 2, 0, 1, 2]
    assert windows.trailing_streak(series(spark, [0, 0, 5, 0, 0, 0]), ["item"], F.col("x") == 0, "n").first().n == 3


@pytest.mark.parametrize("changed", [3, 5])
def test_no_feature_sees_its_own_period(spark, changed):
    w = windows.series(["item"])

    def features(values):
        df = windows.trends(windows.rolling(windows.lags(series(spark, values), w, ["x"]), w, "x"), w, "x")
        df = windows.streak_before(df, w, F.col("x") > 0, "n").withColumn("f", windows.frequency_before(w, F.col("x") > 2)).withColumn("l", windows.since_last(w, "t", F.col("x") > 0))
        df = windows.smoothed(df, ["item"], "x", "s")
        return [tuple(r)[3:] for r in df.filter(F.col("t") <= changed).orderBy("t").collect()]

    base = [1, 0, 3, 2, 0, 6]
    other = [v if i + 1 != changed else 99 for i, v in enumerate(base)]
    assert features(base) == features(other)


def test_gap_classes(spark):
    events = spark.createDataFrame([(1, 3, "A"), (1, 6, "B")], "item int, month int, seg string")
    probes = spark.createDataFrame([(i, m) for i in (1, 2) for m in range(1, 9)], "item int, month int")
    got = {(r.item, r.month): (r.gap_class, r.filled) for r in asof.classify_gaps(probes, events, "item", "month", "seg").collect()}
    assert [got[1, m][0] for m in (1, 2)] == ["not_yet_launched"] * 2 and [got[1, m] for m in (4, 5)] == [("carried_forward", "A")] * 2
    assert got[1, 7] == ("carried_forward", "B") and got[1, 3] == ("recorded", "A") and {got[2, m][0] for m in range(1, 9)} == {"never_tracked"}


def test_rekey(spark):
    rows = spark.createDataFrame([("500001",), (" 500009 ",), ("EXP500001",), ("EXP653370",), ("Y90006",)], "code string")
    known = spark.createDataFrame([("500001",), ("500001",)], "item string")
    got = {r.code: (r.kept, r.item_code, r.is_flagged) for r in reshape.rekey(rows, "code", known, "item").collect()}
    assert got == {"500001": (True, "500001", False), " 500009 ": (True, "500009", False), "EXP500001": (True, "500001", True), "EXP653370": (False, None, True), "Y90006": (False, None, False)}


def test_blocks_report_what_they_reject(spark):
    cells = [["A"], ["q1", "n1"], [], ["B"], ["p > x > y"], ["A"], ["q2"], [], ["C"], ["z"], ["A"], ["q3"]]
    sheet = spark.createDataFrame(list(enumerate(cells)), "row_idx long, cells array<string>")
    records, rejected = reshape.blocks(sheet, "A", "B", {"qty": 0, "name": 1, "far": 9}, {"path": 0})
    assert [tuple(r) for r in records.collect()] == [(0, "q1", "n1", None, "p > x > y")]
    assert {r.row_idx: r.reason for r in rejected.collect()} == {5: "expected the second anchor, got C", 10: "block runs past the end"}


def test_panel_is_pairs_times_months(spark):
    sales = spark.createDataFrame([(199801, "a", 1, 5, False), (199802, "b", 1, 3, True), (199801, "a", 1, 1, True)], "date int, item string, wh int, qty long, is_return boolean")
    out = spark.createDataFrame([(199802, "c", 2, 1)], "date int, item string, wh int, outage int")
    facts = panel.sales_facts(sales)
    df = panel.dense_panel(facts, out)
    assert df.count() == 3 * 2 and df.agg(F.sum("net_sales")).first()[0] == 1 and panel.require_unique(df, ["date", "item", "wh"]).count() == 0
    assert {r.positive_sales for r in facts.filter("item = 'b'").collect()} == {0}


def test_calendar(spark):
    df = spark.createDataFrame([(199812,), (200001,), (None,)], "d int")
    assert column(df.select(cal.index_month(cal.month_index(F.col("d"))).alias("x")), "x") == [199812, 200001, None]
    assert column(df.select(cal.quarter_of(F.col("d")).alias("x")), "x") == [4, 1, None]
    assert math.isclose(df.select(cal.month_sin(F.lit(199803))).first()[0], 1.0)


@pytest.mark.parametrize(("a", "b"), [("", ""), ("abc", "abc"), ("abcd", "acbd"), ("xyz", "abc"), ("aab", "aba"), ("a" * 70, "ab" * 40)])
def test_lcs(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    assert matching.lcs(a, b) == d[-1][-1]


def test_rerank_without_candidates(spark):
    q = spark.createDataFrame([(1, "AB CD"), (2, "ZZ")], "q long, name string")
    c = spark.createDataFrame([(7, "CD AB"), (8, "AB CE")], "id long, name string")
    found = spark.createDataFrame([(1, [7, 8])], "q long, candidates array<long>")
    got = {r.q: (r.best_match, r.best_score, r.tier) for r in matching.rerank(q, c, found, "q", "id", "name").collect()}
    assert got == {1: ("CD AB", 100.0, "HIGH_AUTO_ACCEPT"), 2: (None, 0.0, "LOW_NO_MATCH")}


def test_adjudication_retries_and_fails(spark):
    pool = spark.createDataFrame([("k1", "n1", ["A"]), ("k2", "n2", ["B"])], "key string, name string, candidates array<string>")
    asked = adjudicate.requests(pool, ["key"])
    good = lambda r: '```json\n[{"id":0,"decision":"CONFIRM","chosen_match":"A"},{"id":1,"decision":"NO_MATCH"}]```'
    assert {r.key: r.decision for r in adjudicate.call(asked, good, "m").collect()} == {"k1": "CONFIRM", "k2": "NO_MATCH"}
    bad = lambda r: '[{"id":0,"decision":"CONFIRM","chosen_match":"Z"},{"id":1,"decision":"NO_MATCH"}]'
    assert {r.decision for r in adjudicate.call(asked, bad, "m").collect()} == {"LLM_FAILED"}


def test_stream_decides_each_key_once(spark, tmp_path):
    from weftline.streaming.adjudication import run_available

    client = lambda r: '[{"id":0,"decision":"NO_MATCH"}]'
    pool, log = tmp_path / "pool", tmp_path / "log"
    log.mkdir()
    row = '{"key":"k1","name":"n","candidates":["A"]}\n'
    for n in ("a", "b"):
        pool.mkdir(exist_ok=True)
        (pool / f"{n}.json").write_text(row)
        run_available(spark, str(pool), "key string, name string, candidates array<string>", str(log), str(tmp_path / "ck"), client, "m").awaitTermination()
    assert spark.read.schema(adjudicate.LOG).json(str(log)).count() == 1


def test_sources(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"key":"a","id":1,"timestamp":"1"}\n\nbroken\n{"key":"a","id":2,"timestamp":"2"}\n')
    got = adjudicate.last_wins(tables.read_log(spark, str(tmp_path / "log.jsonl"), "key string, id int, timestamp string"))
    assert [(r.key, r.id) for r in got.collect()] == [("a", 2)]
    (tmp_path / "x.csv").write_text("Item,Qty\n007,3\n")
    assert tables.read_csv(spark, str(tmp_path / "x.csv"), "Item string, Qty long").first().Item == "007"
    (tmp_path / "s.txt").write_text("A,,c\n\nB\n")
    sheet = tables.read_sheet(spark, str(tmp_path / "s.txt"))
    assert [(r.row_idx, r.cells) for r in sheet.collect()] == [(0, ["A", None, "c"]), (1, [None]), (2, ["B"])]
    df = spark.createDataFrame([(1, True), (2, False)], "x int, kept boolean")
    assert tables.write_split(df, "kept", str(tmp_path / "split")) == 1
    assert tables.check_contract(df, ["x", "y"], 3) == ["missing column y", "expected 3 rows, found 2"]
    with pytest.raises(ValueError, match="missing column y"):
        tables.require_contract(df, ["y"])
    one = spark.createDataFrame([("a",), ("b",)], "n string")
    assert tables.content_hash(one, "n").first() == tables.content_hash(one.orderBy(F.desc("n")), "n").first()


def test_workbooks(spark, tmp_path):
    from weftline.sources import xlsx

    path = str(tmp_path / "book.xlsx")
    df = spark.createDataFrame([("007", None, "a <b> & c"), ("x", "2", " ")], "code string, n string, t string")
    xlsx.write_workbook({"first": df, "second": df.limit(1)}, path)
    spark.dataSource.register(xlsx.SheetSource)
    sheet = spark.read.format("sheet").option("sheet", "first").load(path)
    assert [(r.row_idx, r.cells) for r in sheet.orderBy("row_idx").collect()] == [(0, ["code", "n", "t"]), (1, ["007", None, "a <b> & c"]), (2, ["x", "2", " "])]
    assert sorted(map(tuple, xlsx.with_header(sheet).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    with pytest.raises(ValueError, match="more than 1 rows"):
        xlsx.write_workbook({"first": df}, path, most_rows=1)


def test_run_log(spark):
    from weftline.operators.runlog import RunLog

    log = RunLog("decisions")
    log.watch(spark.range(10), even=F.col("id") % 2 == 0).write.format("noop").mode("overwrite").save()
    assert "10 rows" in log.lines()[0] and "even 5 (50.0%)" in log.lines()[1]


def test_permutation_keeps_the_values(spark):
    from weftline.operators.models import permuted

    df = spark.range(200).selectExpr("id", "id * 3 AS x")
    got = permuted(df, "x").collect()
    assert sorted(r.x for r in got) == [3 * i for i in range(200)] and sorted(r.id for r in got) == list(range(200)) and any(r.x != 3 * r.id for r in got)


def test_seeded_sample_does_not_depend_on_the_layout(spark):
    df = spark.range(500).select(F.col("id").alias("k"))
    draw = lambda d, seed=42: sorted(r.k for r in reshape.seeded_sample(d, "k", 40, seed).collect())
    assert draw(df) == draw(df.repartition(7)) and len(draw(df)) == 40 and draw(df) != draw(df, 43)
    assert len(draw(df.filter("k < 10"))) == 10 and draw(df.filter("k < 0")) == []
    twice = df.unionByName(spark.createDataFrame([(None,), (None,)], "k long"))
    assert len(reshape.seeded_sample(twice, "k", 600).collect()) == 502
