"""Helpers that the corpus operators share: table access, tables in the shared folder, text rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.sources.shared import new_path, shared_dir, written  # noqa: F401 - the operators take them from here

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Word separators of every word rule here: space and U+0009..U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only. Texts in ASCII take the byte-wise built-in, the others a character map."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def word_count(text: Column) -> Column:
    """Number of maximal runs of non-separators; null counts as empty."""
    one = F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS + "+", " ")
    body = F.trim(one)
    return F.when(body == "", F.lit(0).cast("long")).otherwise((F.char_length(body) - F.char_length(F.replace(body, F.lit(" "), F.lit(""))) + 1).cast("long"))


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each changed until no column has it (columns differ by more than case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def holds_map(kind: T.DataType) -> bool:
    """Whether values of the type have no order and no hash: maps, anything with one inside, and variants."""
    if isinstance(kind, T.StructType):
        return any(holds_map(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.MapType, T.VariantType)) or (isinstance(kind, T.ArrayType) and holds_map(kind.elementType))


def row_order(df: DataFrame) -> Column:
    """A hash that settles which of several rows is taken; columns that cannot be hashed do not count."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if not holds_map(f.dataType)])


def repeated(df: DataFrame, count: str, number: str, step: int = 8_192) -> DataFrame:
    """Each row ``count`` times with a number from 1; in two steps, so that no array is long."""
    start = unused(df.columns, "__start")[0]
    begun = df.filter(F.col(count) > 0).withColumn(start, F.explode(F.sequence(F.lit(1).cast("long"), F.col(count).cast("long"), F.lit(step).cast("long"))))
    return begun.withColumn(number, F.explode(F.sequence(F.col(start), F.least(F.col(start) + (step - 1), F.col(count).cast("long"))))).drop(start)


class Scratch:
    """Tables in the shared folder that are dropped once what was made from them is a table itself."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def written(self, df: DataFrame, label: str) -> DataFrame:
        path = new_path(self.spark, label)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        while self.paths:
            drop_path(self.spark, self.paths.pop())
