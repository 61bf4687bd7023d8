"""A driver that starts in an empty folder: the workers get the package from it."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
RUN = """
import importlib.util, sys
spec = importlib.util.spec_from_file_location("__spark_entry__", {root!r} + "/__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
for name in {names!r}:
    if name in entry.queries():
        print(name, entry.queries()[name](spark, {sf!r}).count() > 0)
"""


@pytest.mark.parametrize("names", [["transcript_score", "op9_html"]])
def test_workers_find_the_package(tmp_path, sf_dir, names):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", RUN.format(root=ROOT, names=names, sf=sf_dir)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert out.returncode == 0, out.stderr[-2000:]
    assert "transcript_score True" in out.stdout and "False" not in out.stdout
