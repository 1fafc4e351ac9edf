"""Matching, reshaping, set and log queries over the bundled tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as tx
from weftline.operators import adjudicate, embedding, matching, reshape, windows
from weftline.sources import tables
from weftline.sources.shared import new_path, together, written
from weftline.sources.tables import read_table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


# -- keys and sets -----------------------------------------------------------------------------------------------


def codes(spark: SparkSession, d: str) -> DataFrame:
    """Order keys dressed as codes: plain, padded, prefixed with a known or an unknown customer, or foreign."""
    o = read_table(spark, d, "orders")
    k = F.col("o_custkey").cast("string")
    kind = F.col("o_orderkey") % 5
    code = F.when(kind == 0, k).when(kind == 1, F.concat(F.lit(" "), k, F.lit(" "))).when(kind == 2, F.concat(F.lit("EXP"), k)).when(kind == 3, F.concat(F.lit("EXP9"), k, F.lit("9999"))).otherwise(F.concat(F.lit("Y"), k))
    return o.select("o_orderkey", code.alias("code"))


CODES = """c AS (SELECT o_orderkey, trim(CASE o_orderkey % 5 WHEN 0 THEN o_custkey::VARCHAR WHEN 1 THEN ' ' || o_custkey || ' ' WHEN 2 THEN 'EXP' || o_custkey WHEN 3 THEN 'EXP9' || o_custkey || '9999' ELSE 'Y' || o_custkey END) AS code FROM orders),
k AS (SELECT *, regexp_replace(code, '^EXP', '') AS bare, regexp_matches(code, '^EXP[0-9]+$') AS is_flagged FROM c),
r AS (SELECT *, regexp_matches(code, '^[0-9]+$') OR (is_flagged AND bare IN (SELECT c_custkey::VARCHAR FROM customer)) AS kept FROM k)"""


def _rekeyed(spark, d) -> DataFrame:
    return reshape.rekey(codes(spark, d), "code", read_table(spark, d, "customer"), "c_custkey")


@query("rekey_split_kept", f"WITH {CODES} SELECT o_orderkey, bare AS item_code, is_flagged FROM r WHERE kept")
def rekey_split_kept(spark, d):
    return _rekeyed(spark, d).filter("kept").select("o_orderkey", "item_code", "is_flagged")


@query("rekey_split_excluded", f"WITH {CODES} SELECT o_orderkey, code FROM r WHERE NOT kept")
def rekey_split_excluded(spark, d):
    return _rekeyed(spark, d).filter("NOT kept").select("o_orderkey", F.trim("code").alias("code"))


@query("set_union", "SELECT l_partkey AS part, l_suppkey AS supp FROM lineitem WHERE l_returnflag = 'R' UNION SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A'")
def set_union(spark, d):
    li = read_table(spark, d, "lineitem")
    side = lambda f: li.filter(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"))
    return side("R").unionByName(side("A")).distinct()


@query("set_intersect", "SELECT DISTINCT l_partkey AS part FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def set_intersect(spark, d):
    li = read_table(spark, d, "lineitem")
    side = lambda f: li.filter(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("part"))
    return side("R").intersect(side("A"))


@query("union_all_tagged", "SELECT tag, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'orders' AS tag FROM orders UNION ALL SELECT 'customer' FROM customer) GROUP BY tag")
def union_all_tagged(spark, d):
    tag = lambda t: read_table(spark, d, t).select(F.lit(t).alias("tag"))
    return tag("orders").unionByName(tag("customer")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query("semi_anti_membership", """SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS ordered FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)
  UNION ALL SELECT c_custkey, false FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def semi_anti_membership(spark, d):
    c, o = read_table(spark, d, "customer").select("c_custkey"), read_table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").withColumn("ordered", F.lit(True)).unionByName(c.join(o, "c_custkey", "left_anti").withColumn("ordered", F.lit(False)))


@query("distinct_profile", " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER ({c} IS NULL) AS BIGINT) AS n_null, CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct, round(1 - count(*) FILTER ({c} IS NULL) / count(*), 6) AS fill_rate FROM part" for c in ("p_name", "p_brand", "p_type", "p_size")))
def distinct_profile(spark, d):
    return reshape.profile(read_table(spark, d, "part"), ["p_name", "p_brand", "p_type", "p_size"])


@query("value_shares", "SELECT c_mktsegment AS value, CAST(count(*) AS BIGINT) AS n, round(count(*) / (SELECT count(*) FROM customer), 6) AS share FROM customer GROUP BY 1")
def value_shares(spark, d):
    return reshape.shares(read_table(spark, d, "customer"), "c_mktsegment")


@query("summary_report", """SELECT 'customers' AS metric, CAST(count(*) AS VARCHAR) AS value FROM customer UNION ALL SELECT 'segments', CAST(count(DISTINCT c_mktsegment) AS VARCHAR) FROM customer
  UNION ALL SELECT 'largest balance', CAST(CAST(floor(max(c_acctbal)) AS BIGINT) AS VARCHAR) FROM customer""")
def summary_report(spark, d):
    one = read_table(spark, d, "customer").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("c_mktsegment").alias("s"), F.floor(F.max("c_acctbal")).alias("b"))
    row = lambda name, c: F.struct(F.lit(name).alias("metric"), F.col(c).cast("string").alias("value"))
    return one.select(F.explode(F.array(row("customers", "n"), row("segments", "s"), row("largest balance", "b"))).alias("r")).select("r.*")


@query("seeded_sample", "SELECT o_orderkey, o_custkey FROM orders ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 500")
def seeded_sample(spark, d):
    """A sample of 500 orders; its size is the feature."""
    return reshape.seeded_sample(read_table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 500)


@query("top_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_rows(spark, d):
    return read_table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


# -- names -------------------------------------------------------------------------------------------------------


def part_names(spark, d) -> DataFrame:
    name = F.concat_ws(" ", "p_name", "p_brand", "p_type", F.col("p_size").cast("string"))
    return read_table(spark, d, "part").select("p_partkey", name.alias("name"))


NORMAL = "trim(regexp_replace(regexp_replace(upper({x}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
PART_NAMES = "n AS (SELECT p_partkey, concat_ws(' ', p_name, p_brand, p_type, p_size::VARCHAR) AS name FROM part)"


@query("normalize_names", f"WITH {PART_NAMES} SELECT p_partkey, {NORMAL.format(x='name')} AS normalized FROM n")
def normalize_names(spark, d):
    return part_names(spark, d).select("p_partkey", tx.normalize_name(F.col("name")).alias("normalized"))


@query("placeholder_nulls_fallback", """WITH t AS (SELECT p_partkey, trim(CASE p_partkey % 7 WHEN 0 THEN ' N/A ' WHEN 1 THEN 'none' WHEN 2 THEN '-' WHEN 3 THEN ' ' WHEN 4 THEN 'NaN' ELSE p_name END) AS english, p_brand AS other FROM part)
  SELECT p_partkey, coalesce(CASE WHEN NOT regexp_matches(english, '(?i)^(none|nan|n/?a|null|-|blank)?$') THEN english END, other) AS name, CASE WHEN NOT regexp_matches(english, '(?i)^(none|nan|n/?a|null|-|blank)?$') THEN english END AS english FROM t""")
def placeholder_nulls_fallback(spark, d):
    k = F.col("p_partkey") % 7
    raw = F.when(k == 0, " N/A ").when(k == 1, "none").when(k == 2, "-").when(k == 3, " ").when(k == 4, "NaN").otherwise(F.col("p_name"))
    df = reshape.clean_placeholders(read_table(spark, d, "part").select("p_partkey", raw.alias("english"), F.col("p_brand").alias("other")))
    return df.select("p_partkey", F.coalesce("english", "other").alias("name"), "english")


@query("dedup_catalog", f"SELECT {NORMAL.format(x='p_name')} AS name_normalized, arg_min(p_name, p_partkey) AS first_name, array_to_string(list(p_partkey ORDER BY p_partkey), ',') AS row_ids, min(p_partkey) AS first_row FROM part GROUP BY 1")
def dedup_catalog(spark, d):
    got = matching.dedup_catalog(read_table(spark, d, "part"), "p_partkey", "p_name")
    return got.withColumn("row_ids", F.array_join("row_ids", ","))


#: Names of the usual shapes: a number before the form, an amount after it, a strength, a flavour, noise, no form at all.
NAMES = ["Alphadol Plus 24 Tablets", "BRAND HILLS SYRUP 120 ML", "BETAGRA 50 MG 8 TAB", "GAMMAJET 100MG IM 6 AMP", "DELTOL 20CAP", "EPSICOL JUNIOR 20 SACHETS", "ZETA CARE CREAM 60GRAM", "ETADINE 10% CLEAN SOL 200ML", "THETARD 1.2MIU VIAL", "IOTACINON", "KAPPIDIN CLEAN 10% 100ML", "LAMBDA MINT LOZENGES 12", "MUVIT ORANGE EFF TAB 15 /// X9 20% OFF"]


def product_names(spark, d) -> DataFrame:
    """Part names as product names, a form and a pack size derived from the row, and the literal ones under negative keys."""
    literal = spark.createDataFrame([(-i - 1, n) for i, n in enumerate(NAMES)], "p_partkey long, name string")
    forms = F.array(*[F.lit(x) for x in ("TAB", "SYRUP 120 ML", "CREAM 60GRAM", "VIAL", "MINT LOZENGES", "")])
    made = part_names(spark, d).withColumn("name", F.concat_ws(" ", F.upper("name"), F.concat(F.col("p_partkey") % 500, F.lit("MG")), (F.col("p_partkey") % 30 + 1).cast("string"), F.get(forms, (F.col("p_partkey") % 6).cast("int"))))
    return literal.unionByName(made)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _before(x: str, pattern: str) -> str:
    """Position of a pattern's first match in SQL, 0 where there is none."""
    return f"CASE WHEN regexp_matches({x}, {pattern}) THEN length(regexp_extract({x}, '(?is)^(.*?)' || {pattern}, 1)) + 1 ELSE 0 END"


def _cut(x: str, at: str, length: str) -> str:
    return f"trim(substr({x}, 1, {at} - 1) || ' ' || substr({x}, {at} + {length}))"


def parser_sql() -> str:
    """The field parser by joining every name with the table of forms and keeping the leftmost."""
    noise = "name"
    for pattern in tx.NOISE:
        noise = f"regexp_replace({noise}, {_quoted(pattern)}, ' ', 'g')"
    forms = ", ".join(f"({i}, {_quoted(n)}, {_quoted(f'(?i){tx.NUMBER}' + chr(92) + f's*(?:{sp})' + chr(92) + 'b')}, {_quoted('(?i)' + chr(92) + f'b(?:{sp})' + chr(92) + 'b')}, {_quoted(u)}, {str(m).lower()})" for i, (n, sp, u, m) in enumerate(tx.FORMS))
    measured, strength, words = _quoted(tx.MEASURED), _quoted(tx.STRENGTH), _quoted("(?i)" + chr(92) + "b(" + "|".join(tx.FLAVOURS) + ")" + chr(92) + "b")
    made = "upper(name) || ' ' || (p_partkey % 500) || 'MG ' || (p_partkey % 30 + 1) || ' ' || ['TAB', 'SYRUP 120 ML', 'CREAM 60GRAM', 'VIAL', 'MINT LOZENGES', ''][p_partkey % 6 + 1]"
    literal = ", ".join(f"({-i - 1}, {_quoted(n)})" for i, n in enumerate(NAMES))
    first_cut = f"CASE WHEN by_measure THEN {_cut('x', 'm_at', 'length(m_text)')} WHEN by_tail THEN {_cut('x', 'pos', 'size + length(tail)')} WHEN form IS NOT NULL THEN {_cut('x', 'pos', 'size')} ELSE x END"
    return f"""{PART_NAMES}, named AS (SELECT * FROM (VALUES {literal}) v(p_partkey, name) UNION ALL SELECT p_partkey, {made} FROM n),
    clean AS (SELECT p_partkey, trim({noise}) AS x FROM named), forms AS (SELECT * FROM (VALUES {forms}) f(ord, form, numbered, bare, unit, measured)),
    hits AS (SELECT p_partkey, ord, form, bare, unit, measured, regexp_matches(x, numbered) AS has, CASE WHEN regexp_matches(x, numbered) THEN {_before('x', 'numbered')} ELSE {_before('x', 'bare')} END AS pos,
      CASE WHEN regexp_matches(x, numbered) THEN regexp_extract(x, numbered, 0) ELSE regexp_extract(x, bare, 0) END AS hit, CASE WHEN regexp_matches(x, numbered) THEN regexp_extract(x, numbered, 1) END AS amount
      FROM clean CROSS JOIN forms WHERE regexp_matches(x, numbered) OR regexp_matches(x, bare)),
    leftmost AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY pos, ord) = 1),
    f0 AS (SELECT clean.p_partkey, x, form, bare, unit, measured, pos, length(hit) AS size, amount, {_before('x', measured)} AS m_at, regexp_extract(x, {measured}, 0) AS m_text, regexp_extract(x, {measured}, 1) AS m_amount,
      nullif(regexp_extract(substr(x, pos + length(hit), 6), '^\\s*\\d+(?:\\.\\d+)?', 0), '') AS tail FROM clean LEFT JOIN leftmost USING (p_partkey)),
    f1 AS (SELECT *, coalesce(measured AND m_at > 0, false) AS by_measure, coalesce(NOT measured AND amount IS NULL AND tail IS NOT NULL, false) AS by_tail FROM f0),
    f2 AS (SELECT *, CASE WHEN by_measure THEN m_amount WHEN NOT measured THEN coalesce(amount, trim(tail)) END AS pack_size, {first_cut} AS cut FROM f1),
    f3 AS (SELECT *, regexp_replace(CASE WHEN (by_measure OR by_tail) AND regexp_matches(cut, bare) THEN {_cut('cut', '(' + _before('cut', 'bare') + ')', 'length(regexp_extract(cut, bare, 0))')} ELSE cut END, {strength}, ' ', 'g') AS rest FROM f2),
    f4 AS (SELECT *, nullif(regexp_extract(rest, {words}, 1), '') AS fl, CASE WHEN regexp_matches(rest, {words}) THEN {_cut('rest', '(' + _before('rest', words) + ')', f'length(regexp_extract(rest, {words}, 0))')} ELSE rest END AS nm FROM f3),
    f5 AS (SELECT *, nullif(regexp_replace(regexp_replace(regexp_replace(nm, '[\\-/,]+\\s*$|^\\s*[\\-/,]+', ' ', 'g'), '\\s+', ' ', 'g'), '^[ \\-/,]+|[ \\-/,]+$', '', 'g'), '') AS trade_name,
      array_to_string(list_transform(string_split(lower(fl), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS flavour FROM f4),
    f6 AS (SELECT *, CASE WHEN form IS NOT NULL THEN 4 ELSE 0 END + CASE WHEN pack_size IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN length(trade_name) >= 2 THEN 3 ELSE 0 END AS points FROM f5)"""


@query("extract_fields_regex", f"WITH {parser_sql()} SELECT p_partkey, trade_name, form AS dosage_form, pack_size, unit AS unit_of_measure, flavour, points / 10.0::DOUBLE AS confidence, points < 7 AS needs_review FROM f6")
def extract_fields_regex(spark, d):
    got = tx.extract_fields(product_names(spark, d), "name")
    return got.select("p_partkey", "trade_name", "dosage_form", "pack_size", "unit_of_measure", "flavour", "confidence", "needs_review")


@query("path_second_segment", "SELECT page_id, nullif(trim(string_split(replace(regexp_replace(url, '^[a-z]+://', ''), '/', ' > '), '>')[2]), NULL) AS segment FROM pages")
def path_second_segment(spark, d):
    path = F.replace(F.regexp_replace("url", "^[a-z]+://", ""), F.lit("/"), F.lit(" > "))
    return read_table(spark, d, "pages").select("page_id", tx.path_segment(path, 1).alias("segment"))


@query("block_reshape", """WITH s AS (SELECT conv_id, turn AS row_idx, role, text, lead(text, 1) OVER w AS a, lead(role, 3) OVER w AS h, lead(text, 4) OVER w AS b, lead(turn, 1) OVER w AS t1, lead(turn, 3) OVER w AS t3, lead(turn, 4) OVER w AS t4 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
  g AS (SELECT * FROM s WHERE role = 'user')
  SELECT conv_id, row_idx, CASE WHEN t4 IS NULL THEN 'block runs past the end' WHEN h <> 'assistant' THEN 'expected the second anchor, got ' || h END AS reason, CASE WHEN t4 IS NOT NULL AND h = 'assistant' THEN md5(a) END AS a, CASE WHEN t4 IS NOT NULL AND h = 'assistant' THEN md5(b) END AS b FROM g""")
def block_reshape(spark, d):
    """Conversations as sheets: a user row starts a block, the row three on must be the assistant's."""
    sheet = read_table(spark, d, "conversations").select("conv_id", F.col("turn").alias("row_idx"), F.array("role", "text").alias("cells"))
    records, rejected = reshape.blocks(sheet, "user", "assistant", {"a": 1}, {"b": 1}, ["conv_id"])
    md5 = records.select("conv_id", "row_idx", F.lit(None).cast("string").alias("reason"), F.md5(F.col("a").cast("binary")).alias("a"), F.md5(F.col("b").cast("binary")).alias("b"))
    return md5.unionByName(rejected, allowMissingColumns=True)


# -- matching ----------------------------------------------------------------------------------------------------


def catalog(spark, d) -> DataFrame:
    """Distinct part names, normalised, under their first key."""
    spelt = part_names(spark, d).groupBy("name").agg(F.min("p_partkey").alias("p_partkey"))  # each spelling is normalised once
    got = matching.dedup_catalog(spelt, "p_partkey", "name")
    return got.select(F.col("first_row").alias("id"), F.col("name_normalized").alias("name"))


def asked(spark, d) -> DataFrame:
    """Names to match: those of the parts whose key is divisible by 100, their words in another order and one changed."""
    p = part_names(spark, d).withColumn("name", tx.normalize_name(F.col("name"))).filter(F.col("p_partkey") % 100 == 0)
    words = F.reverse(F.split("name", " "))
    return p.select(F.col("p_partkey").alias("query_id"), F.concat_ws(" ", F.slice(words, 2, 20), F.lit("NEW")).alias("name"))


CATALOG = f"{PART_NAMES}, nn AS (SELECT p_partkey, {NORMAL.format(x='name')} AS name FROM n), cat AS (SELECT min(p_partkey) AS id, name FROM nn GROUP BY name), q AS (SELECT p_partkey AS query_id, array_to_string(list_reverse(string_split(name, ' '))[2:21], ' ') || ' NEW' AS name FROM nn WHERE p_partkey % 100 = 0)"


def _grams(table: str, key: str) -> str:
    word = f"(SELECT {key}, ' ' || w || ' ' AS w FROM (SELECT {key}, unnest(string_split(lower(name), ' ')) AS w FROM {table}) WHERE length(w) > 0)"
    return f"(SELECT {key}, substring(w, i, n) AS gram FROM {word} CROSS JOIN (VALUES (2), (3), (4)) v(n) CROSS JOIN range(1, 60) r(i) WHERE (length(w) > n AND i <= length(w) - n + 1) OR (length(w) = n AND i = 1))"


@query("char_ngrams", f"WITH {CATALOG} SELECT id, gram, CAST(count(*) AS BIGINT) AS tf FROM {_grams('cat', 'id')} GROUP BY ALL")
def char_ngrams(spark, d):
    return matching.gram_counts(catalog(spark, d), "id", "name")


TFIDF = f"""{CATALOG}, cg AS (SELECT id, gram, count(*) AS tf FROM {_grams('cat', 'id')} GROUP BY ALL), qg AS (SELECT query_id, gram, count(*) AS tf FROM {_grams('q', 'query_id')} GROUP BY ALL),
  idf AS (SELECT gram, ln((1 + (SELECT count(*) FROM cat)) / (1 + count(*))) + 1 AS idf FROM cg GROUP BY gram),
  cw AS (SELECT id, gram, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY id)) AS w FROM cg JOIN idf USING (gram)), qw AS (SELECT query_id, gram, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY query_id)) AS w FROM qg JOIN idf USING (gram)),
  sc AS (SELECT query_id, id, round(sum(cw.w * qw.w), 6) AS score FROM qw JOIN cw USING (gram) GROUP BY ALL), sparse AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM sc)"""


@query("tfidf_topk", f"WITH {TFIDF} SELECT * FROM sparse WHERE rank <= 8")
def tfidf_topk(spark, d):
    return matching.sparse_topk(catalog(spark, d), asked(spark, d), "id", "query_id", "name")


DENSE = "dn AS (SELECT q.vec_id AS query_id, c.vec_id AS id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS score FROM embeddings q JOIN embeddings c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id), dense AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM dn)"


def _dense(spark, d) -> DataFrame:
    e = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return matching.dense_topk(e, e.filter("id % 100 = 0").withColumnRenamed("id", "query_id"), "id", "query_id", "embedding", exclude_self=True)


@query("embedding_topk", f"WITH {DENSE} SELECT * FROM dense WHERE rank <= 8")
def embedding_topk(spark, d):
    return _dense(spark, d)


@query("cosine_pairs", "SELECT q.vec_id AS a, c.vec_id AS b, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS score FROM embeddings q JOIN embeddings c ON c.vec_id = q.vec_id + 1")
def cosine_pairs(spark, d):
    e = read_table(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("v"))
    return e.join(b, F.col("vec_id") == F.col("a")).select("a", "b", F.round(matching.cosine(F.col("embedding"), F.col("v")), 6).alias("score"))


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
EMBEDDED = f"""{TFIDF}, lt AS (SELECT string_split('{LETTERS}', '') AS letters),
  ce AS (SELECT id, list_transform(letters, lambda c: CAST(length(name) - length(replace(name, c, '')) AS DOUBLE)) AS v FROM cat CROSS JOIN lt), qe AS (SELECT query_id, list_transform(letters, lambda c: CAST(length(name) - length(replace(name, c, '')) AS DOUBLE)) AS v FROM q CROSS JOIN lt),
  es AS (SELECT query_id, id, round(list_cosine_similarity(qe.v, ce.v), 6) AS score FROM qe CROSS JOIN ce), near AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM es),
  u AS (SELECT query_id, id FROM sparse WHERE rank <= 8 UNION SELECT query_id, id FROM near WHERE rank <= 8)"""


def sides(spark, d) -> tuple[DataFrame, DataFrame]:
    """Catalog and queries as tables, for the queries that read them more than once."""
    return tuple(together(spark, lambda: written(catalog(spark, d), "catalog"), lambda: written(asked(spark, d), "asked")))


def embedded(c: DataFrame, q: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Catalog and queries with vectors from the injected client; the catalog's are cached under a guard."""
    vectors = lambda: embedding.cached(c, "id", "name", embedding.letter_counts, new_path(c.sparkSession, "embedding-guard"), "letters")
    return tuple(together(c.sparkSession, vectors, lambda: written(embedding.embed(q, "query_id", "name", embedding.letter_counts), "asked-vectors")))


@query("name_embedding_topk", f"WITH {EMBEDDED} SELECT query_id, id, score, rank FROM near WHERE rank <= 8")
def name_embedding_topk(spark, d):
    c, q = embedded(*sides(spark, d))
    return matching.dense_topk(c, q, "id", "query_id", "embedding")


def candidates(c: DataFrame, q: DataFrame) -> DataFrame:
    sparse, dense = together(c.sparkSession, lambda: matching.sparse_topk(c, q, "id", "query_id", "name"), lambda: matching.dense_topk(*embedded(c, q), "id", "query_id", "embedding"))
    return matching.union_candidates(sparse, dense, query_key="query_id", key="id")


@query("hybrid_candidates", f"WITH {EMBEDDED} SELECT query_id, array_to_string(list(id ORDER BY id), ',') AS candidates FROM u GROUP BY query_id")
def hybrid_candidates(spark, d):
    """Both retrievers for the same names; their union is what the re-ranking reads."""
    return candidates(*sides(spark, d)).select("query_id", F.array_join("candidates", ",").alias("candidates"))


def matched(spark, d) -> DataFrame:
    """The best match of every query; queries of the same name are matched once, under the first of their keys."""
    c, q = sides(spark, d)
    one = written(q.groupBy("name").agg(F.min("query_id").alias("query_id")), "asked-once")
    found = matching.rerank(one, c, candidates(c, one), "query_id", "id", "name")
    return q.join(found.drop("query_id"), "name")


_SORTED = "array_to_string(list_sort(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: length(w) > 0)), ' ')"
# The longest common subsequence row by row: rows are lists, each further element of the list is one character of the other text.
_STEP = "list_transform(range(1, len(a) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda i: greatest(acc[i], coalesce(acc[i - 1], 0) + CASE WHEN a[i] = x[1] THEN 1 ELSE 0 END))))"
RERANKED = f"""{EMBEDDED}, pr AS (SELECT u.query_id, u.id, cat.name AS cname, {_SORTED.format(x='q.name')} AS qs, {_SORTED.format(x='cat.name')} AS cs FROM u JOIN q ON q.query_id = u.query_id JOIN cat ON cat.id = u.id),
  ch AS (SELECT *, list_transform(string_split(qs, ''), lambda c: unicode(c)) AS a, list_transform(string_split(cs, ''), lambda c: [unicode(c)]) AS b FROM pr),
  rt AS (SELECT query_id, id, cname, 200.0::DOUBLE * list_reduce(list_concat([list_transform(a, lambda c: 0)], b), lambda acc, x: {_STEP})[-1] / (len(a) + len(b)) AS score FROM ch),
  rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM rt),
  bst AS (SELECT query_id, arg_min(cname, rank) AS best_match, arg_min(score, rank) AS best_score, array_to_string(list(cname ORDER BY rank), '|') AS top_names FROM rk WHERE rank <= 3 GROUP BY query_id),
  mt AS (SELECT q.query_id, q.name, best_match, coalesce(best_score, 0) AS best_score, top_names, CASE WHEN coalesce(best_score, 0) >= 90 THEN 'HIGH_AUTO_ACCEPT' WHEN coalesce(best_score, 0) >= 70 THEN 'MEDIUM_LLM_REVIEW' ELSE 'LOW_NO_MATCH' END AS tier FROM q LEFT JOIN bst USING (query_id))"""


@query("token_sort_ratio_best", f"WITH {RERANKED} SELECT query_id, name, best_match, round(best_score, 4) AS best_score, tier, top_names FROM mt")
def token_sort_ratio_best(spark, d):
    names = F.array_join(F.transform("top_candidates", lambda c: c["name"]), "|")
    return matched(spark, d).select("query_id", "name", "best_match", F.round("best_score", 4).alias("best_score"), "tier", names.alias("top_names"))


@query("tier_distribution", f"WITH {RERANKED} SELECT tier AS value, CAST(count(*) AS BIGINT) AS n, round(count(*) / (SELECT count(*) FROM mt), 6) AS share FROM mt GROUP BY tier")
def tier_distribution(spark, d):
    return reshape.shares(written(matched(spark, d).select("tier"), "tiers"), "tier")  # read for the counts and for their total


# -- JSON, logs, decisions ---------------------------------------------------------------------------------------


@query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    return read_table(spark, d, "events").select("event_id", F.from_json("props", "struct<k:bigint>")["k"].alias("k"))


RESPONSES = [
    (1, 2, '[{"id":0,"decision":"CONFIRM","chosen_match":"A"},{"id":1,"decision":"NO_MATCH"}]'),
    (2, 2, '```json\n[{"id":0,"decision":"CONFIRM","chosen_match":"A"},{"id":1,"decision":"NO_MATCH"}]\n```'),
    (3, 2, '{"results":[{"id":0,"decision":"CONFIRM","chosen_match":"A"},{"id":1,"decision":"NO_MATCH"}]}'),
    (4, 2, '[{"id":0,"decision":"CONFIRM","chosen_match":"A"}]'),
    (5, 2, '[{"id":0,"decision":"MAYBE"},{"id":1,"decision":"NO_MATCH"}]'),
    (6, 2, '[{"id":0,"decision":"CONFIRM","chosen_match":"Z"},{"id":1,"decision":"NO_MATCH"}]'),
    (7, 2, '[{"id":0,"decision":"NO_MATCH"},{"id":0,"decision":"NO_MATCH"}]'),
    (8, 2, '[{"id":0,"decision":"NO_MATCH"},{"id":7,"decision":"NO_MATCH"}]'),
    (9, 2, "no JSON here"),
]
RESPONSE_ROWS = ", ".join(f"({i}, {n}, {_quoted(r)})" for i, n, r in RESPONSES).replace(chr(10), "' || chr(10) || '")


@query("response_validation", f"""WITH r AS (SELECT * FROM (VALUES {RESPONSE_ROWS}) v(id, size, response)),
  j AS (SELECT id, size, nullif(regexp_extract(response, '(?s)\\[.*\\]', 0), '') AS body FROM r),
  e AS (SELECT j.id, j.size, unnest(CAST(body AS JSON[])) AS a FROM j WHERE json_valid(body)),
  c AS (SELECT id, size, CAST(a->>'id' AS INT) AS k, a->>'decision' AS decision, a->>'chosen_match' AS chosen FROM e),
  v AS (SELECT id, count(*) = any_value(size) AND count(DISTINCT k) = any_value(size) AND bool_and(k >= 0 AND k < size AND decision IN ('CONFIRM', 'CORRECTED_MATCH', 'NO_MATCH') AND (chosen IS NULL OR coalesce(list_contains([['A', 'B'], ['C']][k + 1], chosen), false))) AS valid FROM c GROUP BY id)
  SELECT r.id, coalesce(v.valid, false) AS valid FROM r LEFT JOIN v USING (id)""")
def response_validation(spark, d):
    df = spark.createDataFrame(RESPONSES, "id int, size int, response string")
    options = F.array(F.array(F.lit("A"), F.lit("B")), F.array(F.lit("C")))
    return df.select("id", adjudicate.valid_response(adjudicate.response_array(F.col("response")), F.col("size"), options).alias("valid"))


@query("batching", "WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS n FROM part) SELECT p_partkey, CAST(n // 15 AS BIGINT) AS batch, CAST(n % 15 AS INT) AS id FROM r")
def batching(spark, d):
    return windows.batches(read_table(spark, d, "part").select("p_partkey"), ["p_partkey"], coarse=F.floor(F.col("p_partkey") / 500))


@query("batch_requests", f"""WITH {CATALOG}, r AS (SELECT id, name, row_number() OVER (ORDER BY id) - 1 AS n FROM cat)
  SELECT CAST(n // 15 AS BIGINT) AS batch, CAST(count(*) AS INT) AS size, '[' || string_agg('{{"id":' || (n % 15) || ',"name":"' || replace(name, '"', chr(92) || '"') || '","candidates":["A","B"]}}', ',' ORDER BY n) || ']' AS request FROM r GROUP BY 1""")
def batch_requests(spark, d):
    pool = catalog(spark, d).select("id", F.col("name").alias("key"), "name", F.array(F.lit("A"), F.lit("B")).alias("candidates"))
    return adjudicate.requests(pool.withColumnRenamed("id", "order"), ["order"], coarse=F.floor(F.col("order") / 500)).select("batch", "size", "request")


def log(spark, d) -> DataFrame:
    """Events as a decision log: several records per key, later ones win."""
    e = read_table(spark, d, "events")
    decision = F.when(F.col("event_id") % 6 == 0, adjudicate.FAILED).when(F.col("event_id") % 6 < 3, "CONFIRM").when(F.col("event_id") % 6 < 5, "NO_MATCH").otherwise("CORRECTED_MATCH")
    return e.select(F.concat(F.lit("K"), F.col("user_id")).alias("key"), (F.col("event_id") % 15).cast("int").alias("id"), decision.alias("decision"), F.when(F.col("event_id") % 6 == 5, F.concat(F.lit("M"), F.col("event_id"))).alias("chosen_match"), F.lit(None).cast("string").alias("reasoning"), F.lit(None).cast("string").alias("self_reported_confidence"), F.lit("m").alias("model_used"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("timestamp"))


LOG = """lg AS (SELECT 'K' || user_id AS key, event_id, CASE WHEN event_id % 6 = 0 THEN 'LLM_FAILED' WHEN event_id % 6 < 3 THEN 'CONFIRM' WHEN event_id % 6 < 5 THEN 'NO_MATCH' ELSE 'CORRECTED_MATCH' END AS decision, CASE WHEN event_id % 6 = 5 THEN 'M' || event_id END AS chosen_match FROM events),
lw AS (SELECT key, arg_max(decision, event_id) AS decision, max(event_id) AS event_id FROM lg GROUP BY key), last AS (SELECT lw.key, lw.decision, lg.chosen_match FROM lw JOIN lg ON lg.key = lw.key AND lg.event_id = lw.event_id)"""


@query("decision_log_last_wins", f"WITH {LOG} SELECT key, decision, chosen_match FROM last")
def decision_log_last_wins(spark, d):
    return adjudicate.last_wins(log(spark, d)).select("key", "decision", "chosen_match")


@query("purge_failed", f"WITH {LOG} SELECT decision, CAST(count(*) AS BIGINT) AS n, (SELECT CAST(count(*) AS BIGINT) FROM lg WHERE decision = 'LLM_FAILED') AS failed FROM lg WHERE decision <> 'LLM_FAILED' GROUP BY decision")
def purge_failed(spark, d):
    kept, counts = adjudicate.purge_failed(log(spark, d))
    return kept.groupBy("decision").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(counts.select("failed")))


@query("cache_split", f"WITH {LOG} SELECT c_custkey, 'K' || c_custkey IN (SELECT key FROM last) AS decided FROM customer")
def cache_split(spark, d):
    pool = read_table(spark, d, "customer").select("c_custkey", F.concat(F.lit("K"), F.col("c_custkey")).alias("key"))
    done, todo = adjudicate.split_by_cache(pool, log(spark, d))
    return done.select("c_custkey", F.lit(True).alias("decided")).unionByName(todo.select("c_custkey", F.lit(False).alias("decided")))


TIERS = "CASE c_custkey % 3 WHEN 0 THEN 'HIGH_AUTO_ACCEPT' WHEN 1 THEN 'LOW_NO_MATCH' ELSE 'MEDIUM_LLM_REVIEW' END"


@query("merge_decisions_status", f"""WITH {LOG}, m AS (SELECT c_custkey, 'K' || c_custkey AS key, {TIERS} AS tier, c_name AS best_match FROM customer)
  SELECT c_custkey, tier, CASE WHEN tier = 'HIGH_AUTO_ACCEPT' THEN 'AUTO_ACCEPTED' WHEN tier = 'LOW_NO_MATCH' THEN 'NO_MATCH' WHEN decision IS NULL THEN 'Unresolved' WHEN decision = 'LLM_FAILED' THEN 'LLM_FAILED' WHEN decision = 'NO_MATCH' THEN 'LLM_REJECTED' ELSE 'LLM_CONFIRMED' END AS final_status,
  CASE WHEN tier = 'MEDIUM_LLM_REVIEW' AND decision = 'NO_MATCH' THEN NULL WHEN tier = 'MEDIUM_LLM_REVIEW' AND decision IN ('CONFIRM', 'CORRECTED_MATCH') THEN coalesce(chosen_match, best_match) ELSE best_match END AS best_match FROM m LEFT JOIN last ON m.key = last.key""")
def merge_decisions_status(spark, d):
    k = F.col("c_custkey") % 3
    m = read_table(spark, d, "customer").select("c_custkey", F.concat(F.lit("K"), F.col("c_custkey")).alias("key"), F.when(k == 0, "HIGH_AUTO_ACCEPT").when(k == 1, "LOW_NO_MATCH").otherwise("MEDIUM_LLM_REVIEW").alias("tier"), F.col("c_name").alias("best_match"))
    return adjudicate.final_status(m, log(spark, d)).select("c_custkey", "tier", "final_status", "best_match")


@query("merge_parse_fields", f"""WITH {LOG}, p AS (SELECT c_custkey, 'K' || c_custkey AS key, c_custkey % 2 = 0 AS needs_review, c_name AS chosen_match FROM customer)
  SELECT c_custkey, CASE WHEN needs_review AND last.key IS NOT NULL AND decision <> 'LLM_FAILED' THEN coalesce(last.chosen_match, p.chosen_match) ELSE p.chosen_match END AS chosen_match,
  CASE WHEN NOT needs_review THEN 'Regex' WHEN last.key IS NULL THEN 'Unresolved' WHEN decision = 'LLM_FAILED' THEN 'LLM_FAILED' ELSE 'LLM' END AS parse_source FROM p LEFT JOIN last ON p.key = last.key""")
def merge_parse_fields(spark, d):
    p = read_table(spark, d, "customer").select("c_custkey", F.concat(F.lit("K"), F.col("c_custkey")).alias("key"), (F.col("c_custkey") % 2 == 0).alias("needs_review"), F.col("c_name").alias("chosen_match"))
    return adjudicate.merge_parsed(p, log(spark, d), ["chosen_match"]).select("c_custkey", "chosen_match", "parse_source")


def rule_client(request: str) -> str:
    """Stands in for the service: confirms names that share a first letter with a candidate."""
    import json

    out = []
    for i in json.loads(request):
        hit = next((c for c in i["candidates"] if c[:1] == i["name"][:1]), None)
        out.append({"id": i["id"], "decision": "CONFIRM" if hit else "NO_MATCH", "chosen_match": hit, "reasoning": "first letter", "self_reported_confidence": "high"})
    return json.dumps(out)


@query("adjudication_loop")
def adjudication_loop(spark, d):
    m = matched(spark, d).filter("size(top_candidates) > 0")
    # Keys are those of the log, which has decided the even ones' users already; the calls are written once before they are read.
    pool = m.select(F.concat(F.lit("K"), F.col("query_id") % 200).alias("key"), "name", F.transform("top_candidates", lambda c: c["name"]).alias("candidates"))
    _, todo = adjudicate.split_by_cache(pool, log(spark, d).filter("event_id % 2 = 0"))
    undecided = written(todo, "undecided")  # read for the batches and for their offsets
    decided = written(adjudicate.call(adjudicate.requests(undecided, ["key"]), rule_client, "rule"), "decisions")
    return decided.select("key", "id", "decision", "chosen_match", "model_used")


MESSAGES = [*(f"call failed: {m.upper()} x" for m in adjudicate.NETWORK_MARKERS), "bad request", "400 invalid", ""]
_MARKS = " OR ".join(f"contains(lower(message), '{m}')" for m in adjudicate.NETWORK_MARKERS)


@query("network_errors", f"SELECT message, {_MARKS} AS is_network FROM (VALUES {', '.join(f'({_quoted(m)})' for m in MESSAGES)}) v(message)")
def network_errors(spark, d):
    df = spark.createDataFrame([(m,) for m in MESSAGES], "message string")
    return df.select("message", adjudicate.is_network_error(F.col("message")).alias("is_network"))


@query("contract_check", """SELECT * FROM (SELECT 'part' AS table_name, CASE WHEN count(*) FILTER (column_name IN ('p_partkey', 'p_name')) = 2 THEN 'ok' ELSE 'missing' END AS finding FROM (DESCRIBE part)
  UNION ALL SELECT 'orders', 'missing column ' || w FROM (VALUES ('o_orderkey'), ('no_such_column')) n(w) WHERE w NOT IN (SELECT column_name FROM (DESCRIBE orders))
  UNION ALL SELECT 'region', CASE WHEN (SELECT count(*) FROM region) = 5 THEN 'ok' ELSE 'expected 5 rows, found ' || (SELECT count(*) FROM region) END
  UNION ALL SELECT 'nation', CASE WHEN (SELECT count(*) FROM nation) = 24 THEN 'ok' ELSE 'expected 24 rows, found ' || (SELECT count(*) FROM nation) END)""")
def contract_check(spark, d):
    rows = []
    for name, columns, n in (("part", ["p_partkey", "p_name"], None), ("orders", ["o_orderkey", "no_such_column"], None), ("region", ["r_regionkey"], 5), ("nation", ["n_nationkey"], 24)):
        rows += [(name, p) for p in tables.check_contract(read_table(spark, d, name), columns, n)] or [(name, "ok")]
    return spark.createDataFrame(rows, "table_name string, finding string")


@query("content_hash", """WITH h AS (SELECT sha256(coalesce(p_name, '')) AS h FROM part), p AS (SELECT i, sum(CAST(CAST('0x' || substr(h, CAST(1 + 8 * i AS INT), 8) AS UBIGINT) AS HUGEINT)) AS s FROM h CROSS JOIN range(4) r(i) GROUP BY i)
  SELECT CAST((SELECT count(*) FROM part) AS BIGINT) AS n, sha256(string_agg(CAST(s AS VARCHAR), '/' ORDER BY i)) AS content_hash FROM p""")
def content_hash(spark, d):
    return tables.content_hash(read_table(spark, d, "part"), "p_name")
