"""Readers, writers and contracts. Inputs are never overwritten: changes are written as new versions."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """CSV with a header and a stated schema, so that keys stay strings."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_log(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines; blank and broken lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_sheet(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """A headerless export as (row_idx, cells), empty cells null; rows are numbered once, here, over the file order."""
    lines = spark.read.text(path)
    cells = F.transform(F.split("value", separator), lambda c: F.nullif(F.trim(c), F.lit("")))
    numbered = lines.rdd.map(lambda r: r[0]).zipWithIndex()
    return spark.createDataFrame(numbered, "value string, row_idx long").select("row_idx", cells.alias("cells"))


def read_params(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_split(df: DataFrame, kept: str, path: str) -> int:
    """Kept and excluded rows as two tables; the excluded one only where there are any. Returns their number."""
    df.filter(F.col(kept)).drop(kept).write.parquet(f"{path}/kept")
    rest = df.filter(~F.col(kept))
    n = rest.count()
    if n:
        rest.drop(kept).write.parquet(f"{path}/excluded")
    return n


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """A directory of named CSV tables; one name can be written anew without touching the others."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def content_hash(df: DataFrame, column: str) -> DataFrame:
    """One row (n, content_hash) that does not depend on row order or on gathering the values."""
    h = F.sha2(F.coalesce(F.col(column), F.lit("")), 256)
    part = lambda i: F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(part(i)).alias(f"s{i}") for i in range(4)]).select("n", F.sha2(F.concat_ws("/", *[F.coalesce(F.col(f"s{i}").cast("string"), F.lit("0")) for i in range(4)]), 256).alias("content_hash"))


def check_contract(df: DataFrame, columns: list[str], rows: int | None = None) -> list[str]:
    """All problems of a table against its contract; empty if it holds."""
    problems = [f"missing column {c}" for c in columns if c not in df.columns]
    if rows is not None and (n := df.count()) != rows:
        problems.append(f"expected {rows} rows, found {n}")
    return problems


def require_contract(df: DataFrame, columns: list[str], rows: int | None = None) -> DataFrame:
    if problems := check_contract(df, columns, rows):
        raise ValueError("; ".join(problems))
    return df
