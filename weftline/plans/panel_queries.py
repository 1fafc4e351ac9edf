"""Panel, window, as-of and accuracy queries over the bundled tables, with their SQL.

Items are parts, warehouses the regions of the suppliers; the panel has every month of lineitem and grows with it. Facts
are aggregated once, in one scan of lineitem, to a table in the shared folder. Folds, pivot columns and the next period
count from the last month found. Models take the same panel rolled up to brands and nations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import calendar as cal
from weftline.operators import asof, metrics, models, panel, windows
from weftline.sources.shared import written
from weftline.sources.tables import read_table

KEYS = ["date", "item", "wh"]
W = ["item", "wh"]
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


# -- sources -----------------------------------------------------------------------------------------------------


def lines(spark: SparkSession, d: str) -> DataFrame:
    """(date, item, wh, qty, is_return, is_out) of every line; only the columns used reach the scans."""
    li = read_table(spark, d, "lineitem").filter(F.col("l_shipdate").isNotNull())
    supp = read_table(spark, d, "supplier").join(read_table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    li = li.join(supp.select("s_suppkey", "n_regionkey"), F.col("s_suppkey") == F.col("l_suppkey"))
    flag = F.col("l_returnflag")
    return li.select(cal.yyyymm(F.col("l_shipdate")).alias("date"), F.col("l_partkey").alias("item"), F.col("n_regionkey").alias("wh"), F.col("l_quantity").cast("long").alias("qty"), (flag == "R").alias("is_return"), (flag == "A").alias("is_out"))


def brand_lines(spark: SparkSession, d: str) -> DataFrame:
    """The same lines by brand and nation, the grain of the models."""
    li = read_table(spark, d, "lineitem").filter(F.col("l_shipdate").isNotNull())
    part, supp = read_table(spark, d, "part").select("p_partkey", "p_brand"), read_table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    li = li.join(part, F.col("p_partkey") == F.col("l_partkey")).join(supp, F.col("s_suppkey") == F.col("l_suppkey"))
    flag = F.col("l_returnflag")
    return li.select(cal.yyyymm(F.col("l_shipdate")).alias("date"), F.col("p_brand").alias("item"), F.col("s_nationkey").alias("wh"), F.col("l_quantity").cast("long").alias("qty"), (flag == "R").alias("is_return"), (flag == "A").alias("is_out"))


class Panel:
    """The facts, once, and what follows from them."""

    def __init__(self, spark: SparkSession, d: str, of=lines):
        self.facts = written(panel.facts(of(spark, d)), "panel-facts")

    def dense(self) -> DataFrame:
        return panel.dense_from_facts(self.facts)

    def items(self) -> DataFrame:
        return panel.item_month(self.dense())

    def last(self) -> int:
        """The number of the last period."""
        return self.facts.select("date").distinct().count()


def dense(spark: SparkSession, d: str) -> DataFrame:
    return Panel(spark, d).dense()


def baselines(spark: SparkSession, d: str) -> DataFrame:
    """Item months with naive forecasts of the positive sales: last period, means, smoothing; tests are the last three periods."""
    w, of = windows.series(["item"]), Panel(spark, d)
    df, n = windows.smoothed(of.items(), ["item"], "positive_sales"), of.last()
    df = df.withColumns({"lag1": F.lag("positive_sales", 1).over(w).cast("double"), "mean2": F.avg("positive_sales").over(windows.before(w, 2)), "mean3": F.avg("positive_sales").over(windows.before(w, 3)), "std3": F.stddev_samp("positive_sales").over(windows.before(w, 3))})
    return df.filter(F.col("t") >= n - 2).withColumn("fold", (F.col("t") - (n - 3)).cast("int"))


LI = """li AS (SELECT CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INT) AS date, l_partkey AS item, n_regionkey AS wh, CAST(l_quantity AS BIGINT) AS qty, l_returnflag AS flag
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE l_shipdate IS NOT NULL)"""
PANEL = LI + """,
sales AS (SELECT date, item, wh, CAST(sum(CASE WHEN flag = 'R' THEN -qty ELSE qty END) AS BIGINT) AS net_sales, CAST(sum(CASE WHEN flag = 'R' THEN qty ELSE 0 END) AS BIGINT) AS returns FROM li GROUP BY ALL),
outage AS (SELECT date, item, wh, 1 AS outage FROM li WHERE flag = 'A' GROUP BY ALL),
months AS (SELECT date, CAST(row_number() OVER (ORDER BY date) AS INT) AS t FROM (SELECT DISTINCT date FROM sales)),
pairs AS (SELECT item, wh FROM sales UNION SELECT item, wh FROM outage),
panel AS (SELECT m.date, p.item, p.wh, m.t, coalesce(s.net_sales, 0) AS net_sales, coalesce(s.returns, 0) AS returns, greatest(coalesce(s.net_sales, 0), 0) AS positive_sales, coalesce(o.outage, 0) AS outage
  FROM pairs p CROSS JOIN months m LEFT JOIN sales s USING (date, item, wh) LEFT JOIN outage o USING (date, item, wh))"""
W_SQL = "PARTITION BY item, wh ORDER BY t"
ITEM = PANEL + """,
im AS (SELECT item, date, t, CAST(sum(net_sales) AS BIGINT) AS sales, CAST(sum(positive_sales) AS BIGINT) AS positive_sales, CAST(sum(returns) AS BIGINT) AS returns, avg(outage) AS mean_outage, max(outage) AS any_outage,
  CAST(count(DISTINCT wh) AS BIGINT) AS n_wh, CAST(count(*) FILTER (outage > 0) AS BIGINT) AS wh_affected FROM panel GROUP BY ALL)"""
BASE = ITEM + """,
base0 AS (SELECT *, CAST(lag(positive_sales) OVER w AS DOUBLE) AS lag1, avg(positive_sales) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS mean2, avg(positive_sales) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS mean3,
  stddev_samp(positive_sales) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS std3, list(CAST(positive_sales AS DOUBLE)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS history FROM im WINDOW w AS (PARTITION BY item ORDER BY t)),
base AS (SELECT *, list_reduce(history, lambda a, x: 0.7 * a + 0.3 * x) AS ses, CAST(t - (SELECT max(t) FROM months) + 3 AS INT) AS fold FROM base0 WHERE t >= (SELECT max(t) FROM months) - 2)"""


def r6(*names: str) -> list:
    return [F.round(F.col(n), 6).alias(n) for n in names]


def s6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


# -- panel -------------------------------------------------------------------------------------------------------


@query("panel_dense_grid", f"WITH {PANEL} SELECT date, item, wh, t, net_sales, returns, positive_sales, outage, CAST(date // 100 AS INT) AS year, CAST(date % 100 AS INT) AS month, CAST((date % 100 + 2) // 3 AS INT) AS quarter FROM panel")
def panel_dense_grid(spark, d):
    df = panel.with_calendar(dense(spark, d))
    return df.select(*KEYS, "t", "net_sales", "returns", "positive_sales", "outage", "year", "month", "quarter")


@query("panel_excluded_month", "WITH m AS (SELECT CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INT) AS date, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY ALL) SELECT date, n, date = (SELECT max(date) FROM m) AS excluded FROM m")
def panel_excluded_month(spark, d):
    """Rows per month; the last month of an extract may be cut off and is excluded."""
    m = read_table(spark, d, "lineitem").groupBy(cal.yyyymm(F.col("l_shipdate")).alias("date")).agg(F.count(F.lit(1)).alias("n"))
    last = m.agg(F.max("date").alias("last"))  # one row
    return m.crossJoin(F.broadcast(last)).select("date", "n", (F.col("date") == F.col("last")).alias("excluded"))


@query("panel_cyclic_calendar", """WITH m AS (SELECT DISTINCT CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INT) AS date FROM orders)
  SELECT date, CAST((date // 100) * 12 + date % 100 AS INT) AS month_index, date AS back, CAST(date // 100 AS INT) AS year, CAST(date % 100 AS INT) AS month, CAST((date % 100 + 2) // 3 AS INT) AS quarter,
  round(sin(2 * pi() * (date % 100) / 12), 6) + 0.0 AS month_sin, round(cos(2 * pi() * (date % 100) / 12), 6) + 0.0 AS month_cos FROM m""")
def panel_cyclic_calendar(spark, d):
    m = read_table(spark, d, "orders").select(cal.yyyymm(F.col("o_orderdate")).alias("date")).distinct()
    m = panel.with_calendar(m).withColumn("month_index", cal.month_index(F.col("date")))
    return m.select("date", "month_index", cal.index_month(F.col("month_index")).alias("back"), "year", "month", "quarter", *[(F.round(c, 6) + 0.0).alias(c) for c in ("month_sin", "month_cos")])  # no negative zero


@query("panel_dup_collapse", f"WITH {LI} SELECT date, item, wh, max(qty) AS qty, bool_or(flag = 'A') AS seen FROM li GROUP BY ALL")
def panel_dup_collapse(spark, d):
    return panel.collapse_duplicates(lines(spark, d).select(*KEYS, "qty", F.col("is_out").alias("seen")), KEYS, "qty", "seen")


# -- windows -----------------------------------------------------------------------------------------------------


def _lag_sql(c: str) -> str:
    return ", ".join(f"lag({c}, {k}) OVER ({W_SQL}) AS {c}_lag{k}" for k in (1, 2, 3))


@query("lag_features", f"WITH {PANEL} SELECT date, item, wh, {_lag_sql('net_sales')}, {_lag_sql('positive_sales')}, {_lag_sql('returns')}, {_lag_sql('outage')} FROM panel")
def lag_features(spark, d):
    cols = ["net_sales", "positive_sales", "returns", "outage"]
    df = windows.lags(dense(spark, d), windows.series(W), cols)
    return df.select(*KEYS, *[f"{c}_lag{k}" for c in cols for k in (1, 2, 3)])


def _frame(f: str, c: str, k: int, name: str) -> str:
    return f"round({f}({c}) OVER ({W_SQL} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING), 6) AS {name}"


@query("rolling_mean_std", f"WITH {PANEL} SELECT date, item, wh, " + ", ".join(_frame(f, c, k, f"{c}_{n}{k}") for c in ("positive_sales", "outage") for f, n in (("avg", "mean"), ("stddev_samp", "std")) for k in (2, 3)) + " FROM panel")
def rolling_mean_std(spark, d):
    w, df = windows.series(W), dense(spark, d)
    for c in ("positive_sales", "outage"):
        df = windows.rolling(df, w, c)
    return df.select(*KEYS, *r6(*[f"{c}_{n}{k}" for c in ("positive_sales", "outage") for n in ("mean", "std") for k in (2, 3)]))


@query("rolling_max_min_median", f"WITH {PANEL} SELECT date, item, wh, " + ", ".join(_frame(f, "positive_sales", 3, f"positive_sales_{n}3") for f, n in (("max", "max"), ("min", "min"), ("median", "median"))) + " FROM panel")
def rolling_max_min_median(spark, d):
    df = windows.rolling(dense(spark, d), windows.series(W), "positive_sales")
    return df.select(*KEYS, *[F.round(f"positive_sales_{n}3", 6).alias(f"positive_sales_{n}3") for n in ("max", "min", "median")])


@query("trend_features", f"""WITH {PANEL}, l AS (SELECT *, lag(positive_sales, 1) OVER w AS a, lag(positive_sales, 2) OVER w AS b, avg(positive_sales) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS m2, avg(positive_sales) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS m3 FROM panel WINDOW w AS ({W_SQL}))
  SELECT date, item, wh, a - b AS momentum, round(a / (b + 1), 6) AS growth, round(m3 - m2, 6) AS trend FROM l""")
def trend_features(spark, d):
    df = windows.trends(dense(spark, d), windows.series(W), "positive_sales")
    return df.select(*KEYS, F.col("positive_sales_momentum").alias("momentum"), F.round("positive_sales_growth", 6).alias("growth"), F.round("positive_sales_trend", 6).alias("trend"))


def _streak_sql(flag: str, name: str) -> str:
    # the number of rows after the last break among the earlier rows
    return f"CASE WHEN t = min(t) OVER (PARTITION BY item, wh) THEN NULL ELSE CAST(t - 1 - coalesce(max(CASE WHEN NOT ({flag}) THEN t END) OVER ({W_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) END AS {name}"


FLAGS = {"zero_streak": "positive_sales = 0", "positive_streak": "positive_sales > 0", "outage_streak": "outage > 0"}


@query("streak_zero_positive", f"WITH {PANEL} SELECT date, item, wh, {', '.join(_streak_sql(f, n) for n, f in FLAGS.items())}, CAST(row_number() OVER ({W_SQL}) - 1 AS INT) AS nth FROM panel")
def streak_zero_positive(spark, d):
    w, df = windows.series(W), dense(spark, d)
    for name, flag in FLAGS.items():
        df = windows.streak_before(df, w, F.expr(flag), name)
    return df.select(*KEYS, *FLAGS, (F.row_number().over(w) - 1).cast("int").alias("nth"))


@query("trailing_streak_pivot", f"""WITH {PANEL},
  ends AS (SELECT item, wh, CAST((SELECT max(t) FROM months) - coalesce(max(CASE WHEN positive_sales <> 0 THEN t END), 0) AS BIGINT) AS zero_streak, CAST(max(CASE WHEN positive_sales > 0 THEN t END) AS INT) AS last_positive FROM panel GROUP BY item, wh)
  SELECT * FROM ends JOIN (PIVOT (SELECT item, wh, 't' || t AS k, positive_sales FROM panel) ON k USING CAST(max(positive_sales) AS BIGINT) GROUP BY item, wh) wide USING (item, wh)""")
def trailing_streak_pivot(spark, d):
    """One aggregation gives the streak, the last sale and a column per period."""
    of, y, t = Panel(spark, d), F.col("positive_sales"), F.col("t")
    broke = F.coalesce(F.max(F.when(y != 0, t)), F.min(t) - 1)
    ends = [(F.max(t) - broke).cast("long").alias("zero_streak"), F.max(F.when(y > 0, t)).alias("last_positive")]
    return panel.pivoted(of.dense(), W, "t", "positive_sales", range(1, of.last() + 1), *ends)


@query("months_since_last_sale", f"WITH {PANEL} SELECT date, item, wh, t - max(CASE WHEN positive_sales > 0 THEN t END) OVER ({W_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS since FROM panel")
def months_since_last_sale(spark, d):
    return dense(spark, d).select(*KEYS, windows.since_last(windows.series(W), "t", F.col("positive_sales") > 0).alias("since"))


PAST = f"OVER ({W_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query("event_frequency_ever", f"WITH {PANEL} SELECT date, item, wh, round(avg(CASE WHEN outage > 0 THEN 1 ELSE 0 END) {PAST}, 6) AS outage_frequency, coalesce(max(CASE WHEN outage > 0 THEN 1 ELSE 0 END) {PAST}, 0) AS outage_before FROM panel")
def event_frequency_ever(spark, d):
    w, flag = windows.series(W), F.col("outage") > 0
    return dense(spark, d).select(*KEYS, F.round(windows.frequency_before(w, flag), 6).alias("outage_frequency"), windows.ever_before(w, flag).alias("outage_before"))


@query("ses_baseline", f"WITH {PANEL}, h AS (SELECT *, list(CAST(positive_sales AS DOUBLE)) {PAST} AS history FROM panel) SELECT date, item, wh, round(list_reduce(history, lambda a, x: 0.7 * a + 0.3 * x), 6) AS ses FROM h")
def ses_baseline(spark, d):
    return windows.smoothed(dense(spark, d).select(*KEYS, "t", "positive_sales"), W, "positive_sales").select(*KEYS, F.round("ses", 6).alias("ses"))


def _lagged(keys: str, prefix: str, aggs: dict[str, str]) -> str:
    main = next(iter(aggs))
    w = f"PARTITION BY {keys} ORDER BY t"
    cols = [f"lag(g_{n}, {k}) OVER ({w}) AS {prefix}_{n}_lag{k}" for n in aggs for k in (1, 2)]
    cols += [f"(lag(g_{main}, 1) OVER ({w}) - lag(g_{main}, 2) OVER ({w})) / (lag(g_{main}, 2) OVER ({w}) + 1) AS {prefix}_{main}_growth", f"avg(g_{main}) OVER ({w} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS {prefix}_{main}_mean3"]
    names = [f"{prefix}_{n}_lag{k}" for n in aggs for k in (1, 2)] + [f"{prefix}_{main}_growth", f"{prefix}_{main}_mean3"]
    return f"""WITH {PANEL}, g AS (SELECT {keys}, t, {', '.join(f'{a} AS g_{n}' for n, a in aggs.items())} FROM panel GROUP BY {keys}, t), l AS (SELECT {keys}, t, {', '.join(cols)} FROM g)
      SELECT date, item, wh, {', '.join(f'round(CAST({n} AS DOUBLE), 6) AS {n}' for n in names)} FROM panel JOIN l USING ({keys}, t)"""


NATIONAL = {"sales": "CAST(sum(positive_sales) AS DOUBLE)", "active": "CAST(count(*) FILTER (positive_sales > 0) AS DOUBLE)"}
WAREHOUSE = {"sales": "CAST(sum(positive_sales) AS DOUBLE)", "mean": "avg(positive_sales)", "items": "CAST(count(DISTINCT CASE WHEN positive_sales > 0 THEN item END) AS DOUBLE)"}


def _rounded(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*KEYS, *[F.round(F.col(c).cast("double"), 6).alias(c) for c in df.columns if c.startswith(prefix)])


@query("national_aggregates_lagged", _lagged("item", "nat", NATIONAL))
def national_aggregates_lagged(spark, d):
    aggs = {"sales": F.sum("positive_sales").cast("double"), "active": F.count_if(F.col("positive_sales") > 0).cast("double")}
    return _rounded(windows.aggregate_lags(dense(spark, d), ["item"], "nat", aggs), "nat_")


@query("warehouse_aggregates_lagged", _lagged("wh", "wh", WAREHOUSE))
def warehouse_aggregates_lagged(spark, d):
    active = F.count_distinct(F.when(F.col("positive_sales") > 0, F.col("item"))).cast("double")
    aggs = {"sales": F.sum("positive_sales").cast("double"), "mean": F.avg("positive_sales"), "items": active}
    return _rounded(windows.aggregate_lags(dense(spark, d), ["wh"], "wh", aggs), "wh_")


@query("historical_share", f"""WITH {PANEL}, l AS (SELECT *, lag(positive_sales) OVER ({W_SQL}) AS a FROM panel), n AS (SELECT *, sum(a) OVER (PARTITION BY item, t) AS total, sum(positive_sales) OVER (PARTITION BY item, t) AS now FROM l)
  SELECT date, item, wh, round(CASE WHEN coalesce(total, 0) > 0 THEN a / total ELSE 0 END, 6) AS share_before, round(CASE WHEN now > 0 THEN positive_sales / now ELSE 0 END, 6) AS share_now FROM n""")
def historical_share(spark, d):
    df = dense(spark, d).withColumn("a", F.lag("positive_sales", 1).over(windows.series(W)))
    group = Window.partitionBy("item", "t")
    return df.select(*KEYS, F.round(windows.share_of_total(F.col("a"), F.sum("a").over(group)), 6).alias("share_before"), F.round(windows.share_of_total(F.col("positive_sales"), F.sum("positive_sales").over(group)), 6).alias("share_now"))


@query("item_month_rollup", f"WITH {ITEM}, st AS (SELECT p_partkey AS item, min(p_type) AS type FROM part GROUP BY 1) SELECT im.item, date, sales, positive_sales, returns, round(mean_outage, 6) AS mean_outage, any_outage, n_wh, wh_affected, round(wh_affected / n_wh, 6) AS pct_wh_affected, type FROM im LEFT JOIN st ON st.item = im.item")
def item_month_rollup(spark, d):
    static = panel.first_by(read_table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_type").alias("type")), ["item"], [F.col("type")])
    df = panel.with_attributes(Panel(spark, d).items(), static, ["item"])
    return df.select("item", "date", "sales", "positive_sales", "returns", *r6("mean_outage"), "any_outage", "n_wh", "wh_affected", *r6("pct_wh_affected"), "type")


#: The state of an item in a month, from the share of its warehouses that had outages; ROFF stands for no sale so far.
STATE_SQL = "CASE WHEN ever = 0 THEN 'ROFF' WHEN wh_affected = 0 THEN 'AVAL' WHEN wh_affected * 2 >= n_wh THEN 'RARE' ELSE 'SHTG' END"
SEVERITY = {"AVAL": 0, "NEW": 1, "SHTG": 2, "RARE": 3, "ROFF": 4}
SEVERITY_SQL = "CASE segment " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SEVERITY.items()) + " END"


def severity(segment) -> F.Column:
    """The order of the states; one that is not listed has none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair]), segment)


def item_states(items: DataFrame) -> DataFrame:
    """Item months with segment, severity, months since the first sale and whether anything was recorded."""
    w = windows.series(["item"])
    df = items.withColumns({"ever": F.max((F.col("sales") != 0).cast("int")).over(windows.until(w)), "first": F.min(F.when(F.col("sales") != 0, F.col("t"))).over(windows.until(w))})
    segment = F.when(F.col("ever") == 0, "ROFF").when(F.col("wh_affected") == 0, "AVAL").when(F.col("wh_affected") * 2 >= F.col("n_wh"), "RARE").otherwise("SHTG")
    df = df.withColumns({"segment": segment, "age": F.when(F.col("ever") == 1, F.col("t") - F.col("first")), "has_record": ((F.col("sales") != 0) | (F.col("any_outage") > 0)).cast("int")})
    return df.withColumn("severity", severity(F.col("segment")))


STATES_SQL = f"""s0 AS (SELECT *, max(CASE WHEN sales <> 0 THEN 1 ELSE 0 END) OVER w AS ever, min(CASE WHEN sales <> 0 THEN t END) OVER w AS first FROM im WINDOW w AS (PARTITION BY item ORDER BY t)),
  s1 AS (SELECT *, {STATE_SQL} AS segment, CASE WHEN ever = 1 THEN t - first END AS age, CASE WHEN sales <> 0 OR any_outage > 0 THEN 1 ELSE 0 END AS has_record FROM s0),
  ist AS (SELECT *, {SEVERITY_SQL} AS severity FROM s1)"""


@query("interaction_severity", f"""WITH {ITEM}, {STATES_SQL}, l AS (SELECT *, lag(positive_sales) OVER w AS a, lag(mean_outage) OVER w AS o FROM ist WINDOW w AS (PARTITION BY item ORDER BY t))
  SELECT item, date, segment, severity, round(o * severity, 6) AS outage_x_segment, round(a * o, 6) AS sales_x_outage, CAST(age * severity AS BIGINT) AS age_x_segment, has_record * severity AS record_x_segment FROM l""")
def interaction_severity(spark, d):
    """The products of the item-month table: last outage, last sales, age and record, by the order of the item's state."""
    w = windows.series(["item"])
    df = item_states(Panel(spark, d).items()).withColumns({"a": F.lag("positive_sales", 1).over(w), "o": F.lag("mean_outage", 1).over(w)})
    s = F.col("severity")
    return df.select("item", "date", "segment", "severity", F.round(F.col("o") * s, 6).alias("outage_x_segment"), F.round(F.col("a") * F.col("o"), 6).alias("sales_x_outage"), (F.col("age") * s).cast("long").alias("age_x_segment"), (F.col("has_record") * s).alias("record_x_segment"))


@query("interaction_rows", f"""WITH {ITEM}, {STATES_SQL}, n AS (SELECT item, t, lag(positive_sales) OVER (PARTITION BY item ORDER BY t) AS national FROM im),
  v0 AS (SELECT wh, t, sum(positive_sales) AS volume FROM panel GROUP BY ALL), v AS (SELECT wh, t, lag(volume) OVER (PARTITION BY wh ORDER BY t) AS volume FROM v0),
  r AS (SELECT *, lag(positive_sales) OVER w AS a, lag(outage) OVER w AS o FROM panel WINDOW w AS ({W_SQL}))
  SELECT r.date, r.item, r.wh, r.o * severity AS outage_x_segment, CAST(r.a * r.o AS BIGINT) AS sales_x_outage, CAST(age * severity AS BIGINT) AS age_x_segment, CAST(national * volume AS BIGINT) AS national_x_warehouse, has_record * severity AS record_x_segment
  FROM r JOIN ist ON ist.item = r.item AND ist.t = r.t JOIN n ON n.item = r.item AND n.t = r.t JOIN v ON v.wh = r.wh AND v.t = r.t""")
def interaction_rows(spark, d):
    """The products of the row-level panel, with the last total of the item and of the warehouse."""
    of, w = Panel(spark, d), windows.series(["item"])
    states_ = item_states(of.items()).withColumn("national", F.lag("positive_sales", 1).over(w)).select("item", "t", "severity", "age", "has_record", "national")
    volume = of.dense().groupBy("wh", "t").agg(F.sum("positive_sales").alias("volume")).withColumn("volume", F.lag("volume", 1).over(windows.series(["wh"])))
    rows = of.dense().withColumns({"a": F.lag("positive_sales", 1).over(windows.series(W)), "o": F.lag("outage", 1).over(windows.series(W))})
    df, s = rows.join(states_, ["item", "t"]).join(volume, ["wh", "t"]), F.col("severity")
    return df.select(*KEYS, (F.col("o") * s).alias("outage_x_segment"), (F.col("a") * F.col("o")).cast("long").alias("sales_x_outage"), (F.col("age") * s).cast("long").alias("age_x_segment"), (F.col("national") * F.col("volume")).cast("long").alias("national_x_warehouse"), (F.col("has_record") * s).alias("record_x_segment"))


IM_W = "PARTITION BY item ORDER BY t"
IM_PAST = f"OVER ({IM_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _item_streak(flag: str, name: str) -> str:
    return f"CASE WHEN t = min(t) OVER (PARTITION BY item) THEN NULL ELSE CAST(t - 1 - coalesce(max(CASE WHEN NOT ({flag}) THEN t END) {IM_PAST}, 0) AS BIGINT) END AS {name}"


ITEM_FEATURES = {
    "lag1": "lag(positive_sales, 1)", "lag2": "lag(positive_sales, 2)", "lag3": "lag(positive_sales, 3)", "net_lag1": "lag(sales, 1)", "returns_lag1": "lag(returns, 1)",
    "outage_lag1": "lag(mean_outage, 1)", "outage_lag2": "lag(mean_outage, 2)", "outage_lag3": "lag(mean_outage, 3)", "affected_lag1": "lag(wh_affected / n_wh, 1)",
}
ITEM_FRAMES = {
    **{f"{n}{k}": (f, "positive_sales", k) for n, f in (("mean", "avg"), ("std", "stddev_samp")) for k in (2, 3)}, "max3": ("max", "positive_sales", 3), "min3": ("min", "positive_sales", 3), "median3": ("median", "positive_sales", 3),
    "outage_mean2": ("avg", "mean_outage", 2), "outage_mean3": ("avg", "mean_outage", 3),
}
ITEM_FLAGS = {"zero_streak": "positive_sales = 0", "positive_streak": "positive_sales > 0", "outage_streak": "mean_outage > 0"}
ITEM_COLUMNS = [*ITEM_FEATURES, *ITEM_FRAMES, "momentum", "growth", "mean_delta", "since", "outage_frequency", "ever_outage", *ITEM_FLAGS]


def item_features_sql(source: str) -> str:
    """The features of every month of an item-month table, as SQL."""
    lag = [f"{e} OVER ({IM_W}) AS {n}" for n, e in ITEM_FEATURES.items()]
    frame = [f"{f}({c}) OVER ({IM_W} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) AS {n}" for n, (f, c, k) in ITEM_FRAMES.items()]
    more = [
        f"t - max(CASE WHEN positive_sales > 0 THEN t END) {IM_PAST} AS since", f"avg(CASE WHEN mean_outage > 0 THEN 1 ELSE 0 END) {IM_PAST} AS outage_frequency",
        f"coalesce(max(CASE WHEN mean_outage > 0 THEN 1 ELSE 0 END) {IM_PAST}, 0) AS ever_outage", *[_item_streak(f, n) for n, f in ITEM_FLAGS.items()],
    ]
    return f"(SELECT *, lag1 - lag2 AS momentum, lag1 / (lag2 + 1) AS growth, mean3 - mean2 AS mean_delta FROM (SELECT item, date, t, {', '.join([*lag, *frame, *more])} FROM {source}))"


def item_features(items: DataFrame) -> DataFrame:
    """(item, date, t, ITEM_COLUMNS): every feature of a month comes from earlier months; one shuffle by item."""
    w = windows.series(["item"])
    source = {"lag": "positive_sales", "net_lag": "sales", "returns_lag": "returns", "outage_lag": "mean_outage", "affected_lag": "pct_wh_affected"}
    df = items.withColumns({n: F.lag(source[n[:-1]], int(n[-1])).over(w) for n in ITEM_FEATURES})
    how = {"avg": F.avg, "stddev_samp": F.stddev_samp, "max": F.max, "min": F.min, "median": lambda c: F.percentile(F.col(c), F.lit(0.5))}
    df = df.withColumns({n: how[f](c).over(windows.before(w, k)) for n, (f, c, k) in ITEM_FRAMES.items()})
    out, sold = F.col("mean_outage") > 0, F.col("positive_sales") > 0
    df = df.withColumns({"since": windows.since_last(w, "t", sold), "outage_frequency": windows.frequency_before(w, out), "ever_outage": windows.ever_before(w, out)})
    for name, flag in ITEM_FLAGS.items():
        df = windows.streak_before(df, w, F.expr(flag), name)
    df = df.withColumns({"momentum": F.col("lag1") - F.col("lag2"), "growth": F.try_divide(F.col("lag1"), F.col("lag2") + 1), "mean_delta": F.col("mean3") - F.col("mean2")})
    return df.select("item", "date", "t", *ITEM_COLUMNS)


def _rounded_features() -> list:
    return [F.round(F.col(c).cast("double"), 6).alias(c) for c in ITEM_COLUMNS]


ROUNDED_SQL = ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in ITEM_COLUMNS)


@query("item_month_features", f"WITH {ITEM} SELECT item, date, {ROUNDED_SQL} FROM {item_features_sql('im')}")
def item_month_features(spark, d):
    return item_features(Panel(spark, d).items()).select("item", "date", *_rounded_features())


@query("panel_segment_join", f"WITH {PANEL}, sg AS (SELECT p_partkey AS item, CASE WHEN p_size <= 10 THEN 'small' WHEN p_size <= 30 THEN 'medium' ELSE 'large' END AS segment FROM part) SELECT date, panel.item, wh, positive_sales, segment FROM panel LEFT JOIN sg ON sg.item = panel.item")
def panel_segment_join(spark, d):
    """An attribute of the item on all its warehouses, with the guard that an item has one."""
    size = F.col("p_size")
    segments = read_table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.when(size <= 10, "small").when(size <= 30, "medium").otherwise("large").alias("segment"))
    return panel.with_attributes(dense(spark, d), segments, ["item"]).select(*KEYS, "positive_sales", "segment")


@query("filtered_group_sum", f"WITH {PANEL} SELECT item, CAST(sum(positive_sales) AS BIGINT) AS actual FROM panel WHERE t = (SELECT max(t) FROM months) GROUP BY item")
def filtered_group_sum(spark, d):
    """The actual sales of the last month."""
    of = Panel(spark, d)
    return of.dense().filter(F.col("t") == of.last()).groupBy("item").agg(F.sum("positive_sales").alias("actual"))


@query("panel_quality", f"WITH {PANEL} SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (net_sales IS NULL) AS BIGINT) AS null_sales, round(avg(CASE WHEN positive_sales = 0 THEN 1 ELSE 0 END), 6) AS zero_share, CAST((SELECT count(*) FROM lineitem) - (SELECT count(*) FROM li) AS BIGINT) AS dropped_rows FROM panel")
def panel_quality(spark, d):
    """Rows, nulls and zeros of the panel, and how many lines did not reach it; one-row aggregates."""
    one = dense(spark, d).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("net_sales").isNull()).alias("null_sales"), F.round(F.avg((F.col("positive_sales") == 0).cast("int")), 6).alias("zero_share"))
    kept = lines(spark, d).agg(F.count(F.lit(1)).alias("kept"))
    every = read_table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("every"))
    return one.crossJoin(F.broadcast(kept)).crossJoin(F.broadcast(every)).select("n_rows", "null_sales", "zero_share", (F.col("every") - F.col("kept")).alias("dropped_rows"))


# -- as-of and life of a state -----------------------------------------------------------------------------------


def states(spark, d) -> DataFrame:
    e = read_table(spark, d, "events").select(F.col("user_id").alias("item"), F.to_date("ts").alias("day"), "event_type", "event_id")
    return asof.daily_state(e, "item", "day", "event_type", "event_id").withColumnRenamed("event_type", "state")


def probes(spark, d) -> DataFrame:
    """Every user and one that never had an event, on every day of the log."""
    e = read_table(spark, d, "events")
    users = e.select(F.col("user_id").alias("item")).distinct().unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("item")))
    days = e.agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("b")).select(F.explode(F.sequence(F.date_sub("a", 1), F.col("b"))).alias("day"))
    return users.crossJoin(F.broadcast(days))  # a row per day of the log


STATES = """st AS (SELECT user_id AS item, CAST(ts AS DATE) AS day, arg_max(event_type, event_id) AS state FROM events GROUP BY ALL),
days AS (SELECT CAST(unnest(generate_series(min(ts)::DATE - INTERVAL 1 DAY, max(ts)::DATE, INTERVAL 1 DAY)) AS DATE) AS day FROM events),
pr AS (SELECT item, day FROM (SELECT DISTINCT user_id AS item FROM events UNION ALL SELECT -1) CROSS JOIN days)"""


@query("asof_backward", f"WITH {STATES} SELECT pr.item, CAST(pr.day AS VARCHAR) AS day, st.state FROM pr ASOF LEFT JOIN st ON pr.item = st.item AND pr.day >= st.day")
def asof_backward(spark, d):
    return asof.asof(probes(spark, d), states(spark, d), "item", "day", "state").select("item", F.col("day").cast("string").alias("day"), "state")


@query("asof_forward", f"WITH {STATES} SELECT pr.item, CAST(pr.day AS VARCHAR) AS day, st.state FROM pr ASOF LEFT JOIN st ON pr.item = st.item AND pr.day <= st.day")
def asof_forward(spark, d):
    return asof.asof(probes(spark, d), states(spark, d), "item", "day", "state", "forward").select("item", F.col("day").cast("string").alias("day"), "state")


GAPS = f"""{STATES}, b AS (SELECT pr.item, pr.day, st.state AS back FROM pr ASOF LEFT JOIN st ON pr.item = st.item AND pr.day >= st.day),
f AS (SELECT pr.item, pr.day, st.state AS ahead FROM pr ASOF LEFT JOIN st ON pr.item = st.item AND pr.day <= st.day),
g AS (SELECT b.item, b.day, CASE WHEN st.state IS NOT NULL THEN 'recorded' WHEN back IS NOT NULL THEN 'carried_forward' WHEN ahead IS NOT NULL THEN 'not_yet_launched' ELSE 'never_tracked' END AS gap_class,
  coalesce(st.state, back) AS filled, CAST(st.state IS NOT NULL AS INT) AS has_record FROM b JOIN f USING (item, day) LEFT JOIN st USING (item, day))"""


@query("gap_classification_locf", f"WITH {GAPS} SELECT * REPLACE (CAST(day AS VARCHAR) AS day) FROM g")
def gap_classification_locf(spark, d):
    return asof.classify_gaps(probes(spark, d), states(spark, d), "item", "day", "state").select("item", F.col("day").cast("string").alias("day"), "gap_class", "filled", "has_record")


@query("state_lifecycle", f"""WITH {STATES}, s AS (SELECT pr.item, pr.day, datediff('day', DATE '1970-01-01', pr.day) AS t, state FROM pr LEFT JOIN st USING (item, day)),
  a AS (SELECT *, last_value(state IGNORE NULLS) OVER w AS filled FROM s WINDOW w AS (PARTITION BY item ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  b AS (SELECT *, lag(filled) OVER (PARTITION BY item ORDER BY t) AS prev, min(CASE WHEN filled IS NOT NULL THEN t END) OVER (PARTITION BY item) AS first FROM a),
  c AS (SELECT *, max(CASE WHEN filled IS DISTINCT FROM prev THEN t END) OVER (PARTITION BY item ORDER BY t) AS since, sum(CASE WHEN prev IS NOT NULL AND filled <> prev THEN 1 ELSE 0 END) OVER (PARTITION BY item ORDER BY t) AS transitions,
    max(CASE WHEN filled = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY item ORDER BY t) AS ever_click, sum(CASE WHEN filled = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY item ORDER BY t) AS time_click FROM b)
  SELECT item, CAST(day AS VARCHAR) AS day, filled, CAST(CASE WHEN t >= first THEN t - first END AS INT) AS age, CAST(CASE WHEN filled IS NOT NULL THEN t - since + 1 END AS INT) AS run_length, CAST(transitions AS BIGINT) AS transitions, CAST(ever_click AS INT) AS ever_click, CAST(time_click AS BIGINT) AS time_click FROM c""")
def state_lifecycle(spark, d):
    dense_states = probes(spark, d).join(states(spark, d), ["item", "day"], "left").withColumn("t", F.datediff("day", F.lit("1970-01-01").cast("date")))
    return asof.lifecycle(dense_states, "item", "t", "state", ["click"]).select("item", F.col("day").cast("string").alias("day"), "filled", "age", "run_length", "transitions", "ever_click", "time_click")


# -- accuracy ----------------------------------------------------------------------------------------------------

MODELS = ["lag1", "mean2", "mean3", "ses"]
CORRECT = "CASE WHEN positive_sales = 0 THEN round_even({p}, 0) = 0 ELSE abs(round_even({p}, 0) - positive_sales) <= 0.2::DOUBLE * positive_sales END"
LONG = f"{BASE}, lp AS (" + " UNION ALL ".join(f"SELECT item, date, fold, positive_sales, '{m}' AS model, {m} AS predicted FROM base WHERE {m} IS NOT NULL" for m in MODELS) + f"), p AS (SELECT *, {CORRECT.format(p='predicted')} AS correct, abs(round_even(predicted, 0) - positive_sales) AS abs_error FROM lp)"


@query("flagship_panel_accuracy", f"""WITH {PANEL}, l AS (SELECT *, lag(positive_sales) OVER w AS lag1, avg(positive_sales) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS mean3, {_streak_sql('positive_sales = 0', 'zero_streak')} FROM panel WINDOW w AS ({W_SQL}))
  SELECT date, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN {CORRECT.format(p='lag1')} THEN 1 ELSE 0 END) * 100, 4) AS lag1_accuracy, round(avg(mean3), 4) AS mean3, CAST(max(zero_streak) AS BIGINT) AS longest_zero_streak FROM l WHERE lag1 IS NOT NULL GROUP BY date""")
def flagship_panel_accuracy(spark, d):
    w = windows.series(W)
    df = dense(spark, d).withColumns({"lag1": F.lag("positive_sales", 1).over(w).cast("double"), "mean3": F.avg("positive_sales").over(windows.before(w, 3))})
    df = windows.streak_before(df, w, F.col("positive_sales") == 0, "zero_streak").filter("lag1 IS NOT NULL")
    return df.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.round(metrics.business_accuracy(F.col("positive_sales"), F.col("lag1")), 4).alias("lag1_accuracy"), F.round(F.avg("mean3"), 4).alias("mean3"), F.max("zero_streak").alias("longest_zero_streak"))


def predictions(spark, d) -> DataFrame:
    return metrics.long_predictions(baselines(spark, d), ["item", "date", "fold"], "positive_sales", MODELS)


@query("predictions_long", f"WITH {LONG} SELECT item, date, fold, CAST(positive_sales AS BIGINT) AS actual, model, round(predicted, 6) AS predicted, abs_error, correct FROM p")
def predictions_long(spark, d):
    return predictions(spark, d).withColumn("predicted", F.round("predicted", 6))


@query("error_metrics", f"""WITH {LONG} SELECT model, fold, round(avg(abs(predicted - positive_sales)), 4) AS mae, round(sqrt(avg((predicted - positive_sales) ** 2)), 4) AS rmse, round(sum(abs(predicted - positive_sales)) / sum(positive_sales) * 100, 4) AS wape,
  round(1 - sum((predicted - positive_sales) ** 2) / (count(*) * var_pop(positive_sales)), 4) AS r2 FROM p GROUP BY ALL""")
def error_metrics(spark, d):
    got = metrics.errors(predictions(spark, d), ["model", "fold"], "actual", "predicted")
    return got.select("model", "fold", *[F.round(c, 4).alias(c) for c in ("mae", "rmse", "wape", "r2")])


@query("business_accuracy", f"WITH {LONG} SELECT model, fold, round(avg(CASE WHEN correct THEN 1 ELSE 0 END) * 100, 4) AS accuracy FROM p GROUP BY ALL")
def business_accuracy(spark, d):
    p = predictions(spark, d)
    return p.groupBy("model", "fold").agg(F.round(metrics.business_accuracy(F.col("actual"), F.col("predicted")), 4).alias("accuracy"))


BUCKET = "CASE WHEN x <= 0.5 THEN '0' WHEN x <= 5.5 THEN '1-5' WHEN x <= 20.5 THEN '6-20' WHEN x <= 100.5 THEN '21-100' ELSE '100+' END"


@query("bucket_accuracy", f"""WITH {PANEL}, l AS (SELECT positive_sales, CAST(lag(positive_sales) OVER w AS DOUBLE) AS lag1, avg(positive_sales) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS mean3, positive_sales AS x, t FROM panel WINDOW w AS ({W_SQL})),
  b AS (SELECT {BUCKET} AS bucket, CAST(count(*) AS BIGINT) AS n, avg(CASE WHEN {CORRECT.format(p='lag1')} THEN 1 ELSE 0 END) * 100 AS a, avg(CASE WHEN {CORRECT.format(p='mean3')} THEN 1 ELSE 0 END) * 100 AS m FROM l WHERE t >= (SELECT max(t) FROM months) - 2 GROUP BY ALL)
  SELECT bucket, n, round(a, 4) AS lag1_accuracy, round(m, 4) AS mean3_accuracy, round(m - a, 4) AS delta FROM b""")
def bucket_accuracy(spark, d):
    w, of = windows.series(W), Panel(spark, d)
    df = of.dense().withColumns({"lag1": F.lag("positive_sales", 1).over(w).cast("double"), "mean3": F.avg("positive_sales").over(windows.before(w, 3))}).filter(F.col("t") >= of.last() - 2)
    y = F.col("positive_sales")
    got = df.groupBy(metrics.volume_bucket(y).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), metrics.business_accuracy(y, F.col("lag1")).alias("a"), metrics.business_accuracy(y, F.col("mean3")).alias("m"))
    return got.select("bucket", "n", F.round("a", 4).alias("lag1_accuracy"), F.round("m", 4).alias("mean3_accuracy"), F.round(F.col("m") - F.col("a"), 4).alias("delta"))


STABLE = "(coalesce(mean3, -1) > {v} OR (coalesce(mean3, -1) > 0 AND coalesce(std3 / nullif(mean3, 0), 'inf'::DOUBLE) < {c}))"


@query("stability_blend", f"WITH {BASE} SELECT item, date, {STABLE.format(v=3000, c=0.5)} AS stable, round(CASE WHEN {STABLE.format(v=3000, c=0.5)} THEN lag1 ELSE ses END, 6) AS blended FROM base")
def stability_blend(spark, d):
    df = baselines(spark, d).withColumn("stable", metrics.stable(F.col("mean3"), F.col("std3"), 3000.0, 0.5))
    return df.select("item", "date", "stable", F.round(F.when(F.col("stable"), F.col("lag1")).otherwise(F.col("ses")), 6).alias("blended"))


SWEEP = f"{BASE}, grid AS (SELECT * FROM (VALUES (50.0), (100.0), (200.0), (500.0), (1e9)) v(volume) CROSS JOIN (VALUES (0.1), (0.3), (0.5), (0.75), (1.0)) c(cutoff)), b AS (SELECT CAST(volume AS DOUBLE) AS volume, CAST(cutoff AS DOUBLE) AS cutoff, positive_sales, CASE WHEN {STABLE.format(v='volume', c='cutoff')} THEN lag1 ELSE ses END AS p FROM base CROSS JOIN grid), sw AS (SELECT volume, cutoff, round(avg(CASE WHEN {CORRECT.format(p='p')} THEN 1 ELSE 0 END) * 100, 4) AS accuracy FROM b GROUP BY ALL)"


def _sweep(spark, d) -> DataFrame:
    got = metrics.sweep(baselines(spark, d), "positive_sales", "ses", "lag1", "mean3", "std3", [50, 100, 200, 500, 1e9], [0.1, 0.3, 0.5, 0.75, 1.0])
    return got.withColumn("accuracy", F.round("accuracy", 4))


@query("threshold_sweep", f"WITH {SWEEP} SELECT * FROM sw")
def threshold_sweep(spark, d):
    return _sweep(spark, d)


@query("threshold_best", f"WITH {SWEEP} SELECT * FROM sw ORDER BY accuracy DESC, volume, cutoff LIMIT 1")
def threshold_best(spark, d):
    return metrics.best_of(_sweep(spark, d), "accuracy", ["volume", "cutoff"])


@query("fit_counts", f"WITH {LONG} SELECT model, fold, CAST(count(*) FILTER (correct) AS BIGINT) AS fits, CAST(count(*) FILTER (NOT correct) AS BIGINT) AS incorrect, CAST(count(*) AS BIGINT) AS total, round(100.0 * count(*) FILTER (correct) / count(*), 2) AS pct_fit FROM p GROUP BY ALL")
def fit_counts(spark, d):
    return metrics.fit_counts(predictions(spark, d))


@query("leaderboard", f"""WITH {LONG}, f AS (SELECT model, fold, avg(CASE WHEN correct THEN 1 ELSE 0 END) * 100 AS a FROM p GROUP BY ALL),
  w AS (SELECT model, max(CASE WHEN fold = 1 THEN a END) AS fold_1, max(CASE WHEN fold = 2 THEN a END) AS fold_2, max(CASE WHEN fold = 3 THEN a END) AS fold_3 FROM f GROUP BY model)
  SELECT model, {s6('fold_1', 'fold_2', 'fold_3')}, round((fold_1 + fold_2 + fold_3) / 3, 6) AS mean_accuracy, round((fold_1 + fold_2 + fold_3) / 3 - (SELECT (fold_1 + fold_2 + fold_3) / 3 FROM w WHERE model = 'lag1'), 6) AS over_lag1 FROM w""")
def leaderboard(spark, d):
    board = metrics.leaderboard(predictions(spark, d), [1, 2, 3])
    base = board.filter("model = 'lag1'").select(F.col("mean_accuracy").alias("base"))  # one row
    return board.crossJoin(F.broadcast(base)).select("model", *r6("fold_1", "fold_2", "fold_3", "mean_accuracy"), F.round(F.col("mean_accuracy") - F.col("base"), 6).alias("over_lag1"))


@query("walkforward_folds", f"WITH {ITEM}, f AS (SELECT k AS fold, (SELECT max(t) FROM months) - 4 + k AS last, (SELECT max(t) FROM months) - 3 + k AS test FROM (VALUES (1), (2), (3)) v(k)) SELECT fold, t = test AS is_test, CAST(count(*) AS BIGINT) AS n, CAST(sum(positive_sales) AS BIGINT) AS sales FROM im JOIN f ON t <= last OR t = test GROUP BY ALL")
def walkforward_folds(spark, d):
    of = Panel(spark, d)
    return models.with_folds(of.items(), models.last_folds(of.last())).groupBy("fold", "is_test").agg(F.count(F.lit(1)).alias("n"), F.sum("positive_sales").alias("sales"))


# -- models ------------------------------------------------------------------------------------------------------

FEATURES = ["positive_sales_lag1", "positive_sales_lag2", "positive_sales_mean3", "positive_sales_std3", "mean_outage_lag1", "month"]
TRIALS = 40  # the largest count of the reference's three searches


def features(df: DataFrame, keys: list[str]) -> DataFrame:
    w = windows.series(keys)
    cols = ["positive_sales", "mean_outage"] if "mean_outage" in df.columns else ["positive_sales"]
    df = windows.rolling(windows.lags(df, w, cols, 2), w, "positive_sales")
    return df.withColumn("month", cal.month_of(F.col("date")))


@query("gbt_walkforward")
def gbt_walkforward(spark, d):
    of = Panel(spark, d, brand_lines)
    df = features(of.items(), ["item"]).withColumn("segment", F.when(F.col("mean_outage_lag1") > 0.3, "SHTG").otherwise("AVAL")).persist()  # item months, read by every fold
    got = models.walk_forward(df, FEATURES, ["segment"], "positive_sales", folds=models.last_folds(of.last()), trees=6, depth=3, entities=("item",))
    return got.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.round(metrics.business_accuracy(F.col("positive_sales"), F.col("predicted")), 4).alias("accuracy"))


@query("gbt_rows_walkforward")
def gbt_rows_walkforward(spark, d):
    """One row per item, warehouse and month; the item, the warehouse and the segment are features."""
    of = Panel(spark, d, brand_lines)
    df = features(of.dense(), W).withColumn("segment", F.when(F.col("positive_sales_lag1") > 0, "AVAL").otherwise("RARE")).persist()  # read by every fold
    got = models.walk_forward(df, [f for f in FEATURES if f in df.columns], ["segment"], "positive_sales", folds=models.last_folds(of.last()), trees=6, depth=3, entities=tuple(W))
    return got.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.round(metrics.business_accuracy(F.col("positive_sales"), F.col("predicted")), 4).alias("accuracy"))


@query("hierarchical")
def hierarchical(spark, d):
    of = Panel(spark, d, brand_lines)
    df, n = of.dense(), of.last()
    total = df.groupBy("item", "t", "date").agg(F.sum("positive_sales").alias("positive_sales"))
    named = features(total, ["item"]).withColumn("__total", F.col("positive_sales").cast("double"))
    rows = features(df, W).join(total.select("item", "t", F.col("positive_sales").cast("double").alias("__total")), ["item", "t"])
    base = ["positive_sales_lag1", "positive_sales_mean3", "month"]
    got = models.hierarchical(rows, named, base, base, "positive_sales", ["item"], n - 2, n - 1, trees=4, depth=3)
    return got.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("predicted"), 3).alias("predicted"))


@query("hurdle")
def hurdle(spark, d):
    of = Panel(spark, d, brand_lines)
    n = of.last()
    base = ["positive_sales_lag1", "positive_sales_mean3", "month"]
    got = models.hurdle(features(of.dense(), W), base, "positive_sales", n - 2, n - 1)
    y = F.col("positive_sales")
    return got.agg(F.count(F.lit(1)).alias("n"), F.avg(((F.col("p_positive") >= 0.5) == (y > 0)).cast("int")).alias("classifier_accuracy"), F.avg((y > 0).cast("int")).alias("base_rate"), metrics.business_accuracy(y, F.col("thresholded")).alias("threshold_accuracy"), metrics.business_accuracy(y, F.col("expected")).alias("expectation_accuracy"))


@query("holdout_features", f"""WITH {ITEM}, n AS (SELECT max(t) AS n, max(date) AS last FROM months),
  spine AS (SELECT item, date, t, sales, positive_sales, returns, mean_outage, n_wh, wh_affected FROM im
    UNION ALL SELECT DISTINCT item, CAST(CASE WHEN last % 100 = 12 THEN last + 89 ELSE last + 1 END AS INT), n + 1, 0, 0, 0, 0, 1, 0 FROM im CROSS JOIN n)
  SELECT item, date, {ROUNDED_SQL} FROM {item_features_sql('spine')} WHERE t = (SELECT n + 1 FROM n)""")
def holdout_features(spark, d):
    """Features of the month after the last: its spine rows go through the same windows as all others."""
    of = Panel(spark, d)
    items = of.items().select("item", "date", "t", "sales", "positive_sales", "returns", "mean_outage", "pct_wh_affected")
    n = of.last()
    ahead = F.broadcast(of.facts.agg(cal.index_month(cal.month_index(F.max("date")) + 1).alias("date")))  # one row
    zero = {c: F.lit(0).cast(items.schema[c].dataType) for c in items.columns if c not in ("item", "date", "t")}
    spine = of.facts.select("item").distinct().crossJoin(ahead).withColumns({"t": F.lit(n + 1), **zero}).select(*items.columns)
    return item_features(items.unionByName(spine)).filter(F.col("t") == n + 1).select("item", "date", *_rounded_features())


@query("loss_comparison")
def loss_comparison(spark, d):
    """Losses and target forms on one fold: squared, absolute and Huber, log and raw."""
    of = Panel(spark, d, brand_lines)
    df, n = features(of.items(), ["item"]), of.last()
    out = None
    for loss, log in (("squared", True), ("absolute", True), ("huber", True), ("absolute", False)):
        got = models.forecast(df.filter(F.col("t") <= n - 2), df.filter(F.col("t") == n - 1), FEATURES, [], "positive_sales", "predicted", loss=loss, log=log, trees=5, depth=3)
        row = got.agg(F.lit(loss).alias("loss"), F.lit("log1p" if log else "raw").alias("target"), F.round(F.avg(F.abs(F.col("predicted") - F.col("positive_sales"))), 3).alias("mae"), F.round(metrics.business_accuracy(F.col("positive_sales"), F.col("predicted")), 4).alias("accuracy"))
        out = row if out is None else out.unionByName(row)
    return out


@query("feature_importance")
def feature_importance(spark, d):
    of = Panel(spark, d, brand_lines)
    df, n = features(of.items(), ["item"]), of.last()
    _, predict = models.fitted(df.filter(F.col("t") <= n - 2), FEATURES, "positive_sales", trees=5, depth=3)
    return models.permutation_importance(predict, df.filter(F.col("t") == n - 1), FEATURES, "positive_sales")


@query("tuning_search")
def tuning_search(spark, d):
    of = Panel(spark, d, brand_lines)
    df, n = features(of.items(), ["item"]), of.last()
    options, score = models.search(df.filter(F.col("t") <= n - 1), FEATURES, "positive_sales", n - 1, trials=TRIALS)
    return spark.createDataFrame([(k, str(v), float(score)) for k, v in sorted(options.items())], "option string, value string, accuracy double")
