"""The package without its corpus part."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
PROGRAM = """
import sys
from pyspark.sql import SparkSession
import __spark_entry__ as e
names = set(e.queries())
assert names and not [n for n in names if n.startswith("op") and n[2:3].isdigit()] and "pipeline" not in names, names
assert set(e.oracle_sql()) <= names
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert e.queries()["value_shares"](spark, "/root/testdata/sf0.001").count() > 0
print("fine")
"""


@pytest.mark.parametrize("also", [(), ("corpus_pipeline.py",)])
def test_everything_else_works_without_the_corpus_part(tmp_path, also):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", *also))
    got = subprocess.run([sys.executable, "-c", PROGRAM], cwd=copy, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy), "HOME": str(tmp_path)} | {k: v for k, v in __import__("os").environ.items() if k.startswith(("JAVA", "SPARK"))}, capture_output=True, text=True, timeout=300)
    assert got.stdout.strip().endswith("fine"), got.stderr[-2000:]


def test_a_missing_dependency_is_no_removal(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    if not (copy / "weftline" / "llm" / "registry.py").exists():
        pytest.skip("removed")
    with (copy / "weftline" / "llm" / "registry.py").open("a") as f:
        f.write("\nimport no_such_module_anywhere\n")
    got = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=copy, capture_output=True, text=True, timeout=300)
    assert "no_such_module_anywhere" in got.stderr and got.returncode
