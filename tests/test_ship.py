from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.checkpoint.dir", "file://" + {folder!r}).getOrCreate()
import __spark_entry__ as e
print("ROWS", e.queries()["p3_found"](spark, "/root/testdata/sf0.001").count())
"""


def test_workers_need_no_path(tmp_path):
    """Queries run where the workers don't have the repository on their path, in the set folder."""
    repo = str(Path(__file__).parents[1])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=repo, folder=str(tmp_path / "shared"))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in out.stdout, out.stderr[-2000:]
    assert any((tmp_path / "shared").iterdir())
