"""Python functions travel with the plan: workers need no copy of the package."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
import datetime as dt
from pyspark.sql import SparkSession
from runlens.operators import shifts
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
values = [100 + i % 5 for i in range(20)] + [160 + i % 5 for i in range(20)]
rows = [("k", dt.datetime(2026, 1, 1) + dt.timedelta(minutes=i), i, float(v)) for i, v in enumerate(values)]
df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, id long, v double")
print("FOUND", len(shifts.shift_report(df, ["k"], "ts", ["id"], "v", "id").collect()))
"""


def test_reports_run_without_the_package_on_the_workers_path(tmp_path):
    repo = str(Path(__file__).parent.parent)
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_ENV_LOADED")}
    said = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=repo)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "FOUND 1" in said.stdout, said.stderr[-2000:]
