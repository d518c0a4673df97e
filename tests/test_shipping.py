"""The package reaches workers that start in another folder and have no PYTHONPATH."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = f"""
import sys, zipfile
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
import __spark_entry__ as entry
for name in ("ts_mpid_dynamic", "ts_polation_cubic_spline", "knearest_neighbors_classifier", *sys.argv[1:]):
    entry.queries()[name](spark, "/root/testdata/sf0.001").count()
    print("ran", name)
"""


def run(tmp_path, *names):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT, *names], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    return [line[4:] for line in done.stdout.splitlines() if line.startswith("ran ")], done.stderr[-2000:]


def test_workers_import_the_package(tmp_path):
    ran, said = run(tmp_path)
    assert ran == ["ts_mpid_dynamic", "ts_polation_cubic_spline", "knearest_neighbors_classifier"], said
