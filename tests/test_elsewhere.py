"""The library outside the folder in which it lies."""

from __future__ import annotations

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {here!r}).config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("ROWS", __spark_entry__.queries()["rate_limit_admitted"](spark, "/root/testdata/sf0.001").count())
"""


def test_workers_import_the_library(tmp_path):
    """Executors start in folders of their own and have no path to the repository."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"SPARK_WORKER_DIR": str(tmp_path / "work"), "SPARK_LOCAL_DIRS": str(tmp_path / "local")}
    run = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT, here=f"{tmp_path}/shared")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in run.stdout, run.stderr[-2000:]
