"""Executor Python workers must import the package even when the driver runs
from another directory (the package is shipped with addPyFile)."""

import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
import __spark_entry__ as E
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]")
         .config("spark.sql.shuffle.partitions", "4").getOrCreate())
n = E.queries()["bpe_encode"](spark, "/root/testdata/sf0.001").count()
assert n > 0, n
assert E.entry(spark).count() > 0
print("OK", n)
"""


def test_queries_run_from_foreign_cwd():
    cwd = tempfile.mkdtemp(prefix="loomtext-cwd-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    r = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env,
                       capture_output=True, text=True, timeout=600)
    assert "OK" in r.stdout, r.stderr[-3000:]
