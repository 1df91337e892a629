"""Queries whose tasks run this package's Python code, from another folder."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest

from tests.test_queries import SF_DIR

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
import __spark_entry__ as driver
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").getOrCreate())
for name in ("convert", "export_tree", "discover_files"):
    assert driver.queries()[name](spark, {data!r}).count() > 0
print("all ran")
"""


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")
def test_workers_find_the_package(tmp_path):
    repo = str(Path(__file__).resolve().parent.parent)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(repo=repo, data=SF_DIR)],
        cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300,
    )
    assert "all ran" in done.stdout, done.stderr[-2000:]
