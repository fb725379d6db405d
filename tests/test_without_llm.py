"""The library without the subpackage of training-text operators."""

import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import __spark_entry__ as entry
from pyspark.sql import SparkSession
names = entry.queries()
assert "structured_query" in names and "pipeline" not in names and not any(n.startswith("op") and n[2].isdigit() for n in names)
assert set(entry.oracle_sql()) <= set(names)
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
assert names["grouped_counts"](spark, "/root/testdata/sf0.001").count() > 0 and entry.entry(spark).columns
"""


def test_entry_without_the_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "recordmill"):
        at = os.path.join(REPO, name)
        if os.path.isdir(at):
            shutil.copytree(at, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif os.path.exists(at):
            shutil.copy(at, tmp_path / name)
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
