"""Every text query and the pipeline where neither the folder nor the environment of executors has the package."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
import __spark_entry__ as entry
wanted = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit() or n == "pipeline"]
for name in wanted:
    print("DONE", name, entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0, flush=True)
print("ALL", len(wanted))
"""


def test_all_queries_start_elsewhere(tmp_path):
    repo = str(Path(__file__).resolve().parents[2])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=repo)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert "ALL 14" in run.stdout, run.stdout[-500:] + run.stderr[-1500:]
    assert run.stdout.count("True") == 14
