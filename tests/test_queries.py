import math
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from weftline.plans import catalogue  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(catalogue.oracle_sql())


@pytest.fixture(scope="module")
def duck(small_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small_dir}/{t}.parquet'")
    return c


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: None if v is None else f"{float(v):.5f}" if isinstance(v, float) and not math.isnan(v) else str(v)
    return sorted(columns), sorted([tuple(plain(r[i]) for i in order) for r in found], key=str)


@pytest.mark.parametrize("name", NAMES)
def test_query_against_sql(spark, duck, small_dir, name):
    df = catalogue.queries()[name](spark, small_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = duck.sql(catalogue.oracle_sql()[name])
    assert got == rows(rel.columns, rel.fetchall())


def test_entry():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert set(catalogue.queries()) <= set(names) and set(__spark_entry__.oracle_sql()) <= set(names)
