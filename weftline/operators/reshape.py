"""Positional block exports, re-keying with an audit trail, table profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as tx


def blocks(sheet: DataFrame, anchor: str, second_anchor: str, fields_a: dict[str, int], fields_b: dict[str, int], group: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, rejected) of a sheet (row_idx, cells): an anchor row, its data one row on, a second header three on
    (which must hold second_anchor), its data four on.

    Blocks are assembled by joining rows on their index, so no global order is needed; ``group`` names further
    columns that separate sheets.
    """
    on = [*(group or []), "row_idx"]
    cell = lambda c, i: F.get(F.col(c), F.lit(i))
    heads = sheet.filter(cell("cells", 0) == anchor).select(*on)

    def at(offset: int, name: str) -> DataFrame:
        return sheet.select(*(group or []), (F.col("row_idx") - offset).alias("row_idx"), F.col("cells").alias(name))

    got = heads.join(at(1, "a"), on, "left").join(at(3, "h"), on, "left").join(at(4, "b"), on, "left")
    short = F.col("a").isNull() | F.col("h").isNull() | F.col("b").isNull()
    wrong = ~cell("h", 0).eqNullSafe(F.lit(second_anchor))
    got = got.withColumn("reason", F.when(short, "block runs past the end").when(wrong, F.concat(F.lit("expected the second anchor, got "), F.coalesce(cell("h", 0), F.lit("null")))))
    records = got.filter("reason IS NULL").select(*on, *[cell("a", i).alias(n) for n, i in fields_a.items()], *[cell("b", i).alias(n) for n, i in fields_b.items()])
    return records, got.filter("reason IS NOT NULL").select(*on, "reason")


def rekey(rows: DataFrame, code: str, known: DataFrame, known_key: str, prefix: str = "EXP") -> DataFrame:
    """Adds item_code, is_flagged and kept: numeric codes stay; prefixed ones stay without it if the rest is known."""
    trimmed = F.trim(F.col(code))
    bare = tx.strip_prefix(trimmed, prefix)
    keys = known.select(F.col(known_key).cast("string").alias("__known")).distinct()
    prefixed = trimmed.rlike(rf"^{prefix}\d+$")
    out = rows.withColumn("__bare", bare).join(keys, F.col("__bare") == F.col("__known"), "left")
    kept = trimmed.rlike(r"^\d+$") | (prefixed & F.col("__known").isNotNull())
    return out.withColumn("is_flagged", prefixed).withColumn("kept", F.coalesce(kept, F.lit(False))).withColumn("item_code", F.when(F.col("kept"), F.col("__bare"))).drop("__bare", "__known")


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_rows, n_null, n_distinct, fill_rate): one aggregate over the table, unpivoted."""
    aggs = [F.count(F.lit(1)).alias("n")] + [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns] + [F.count_distinct(F.col(c)).alias(f"distinct_{c}") for c in columns]
    one = df.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("n").alias("n_rows"), F.col(f"null_{c}").alias("n_null"), F.col(f"distinct_{c}").alias("n_distinct")) for c in columns])).alias("r")
    return one.select(rows).select("r.*").withColumn("fill_rate", F.round(1 - F.try_divide(F.col("n_null"), F.col("n_rows")), 6))


def shares(df: DataFrame, column: str) -> DataFrame:
    """(value, n, share)."""
    got = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total"))  # one row
    return got.crossJoin(F.broadcast(total)).select("value", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def clean_placeholders(df: DataFrame) -> DataFrame:
    """All string columns trimmed, placeholders to null."""
    return df.withColumns({f.name: tx.null_placeholders(F.col(f.name)) for f in df.schema if f.dataType.simpleString() == "string"})


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The n rows whose keys have the smallest digests under the seed, ties by key: the same ones however the table is laid out.

    n is meant to fit one task; each task hands over its own n smallest rows, so the table is not shuffled.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    return df.orderBy(digest, F.col(key)).limit(n)
