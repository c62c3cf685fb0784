"""Operators on workers that can't import the package: what runs there travels with the job."""

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[2]
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
         .config("spark.driver.memory", "3g").config("spark.sql.warehouse.dir", "warehouse").config("spark.local.dir", ".").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")


def importable(_):
    try:
        import colloquy
        return True
    except ImportError:
        return False


assert not any(spark.sparkContext.parallelize(range(4), 4).map(importable).collect())
import __spark_entry__
from colloquy.llm.queries import QUERIES
queries = __spark_entry__.queries()
for name in [*QUERIES, "pipeline"]:
    print(name, queries[name](spark, {sf!r}).count(), flush=True)
"""


def test_workers_without_the_package(tmp_path, sf):
    """Every query of the subpackage and the pipeline; only the driver has the package on its path."""
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_SUBMIT_ARGS", "SPARK_LOCAL_DIRS")}
    script = SCRIPT.format(repo=str(REPO), sf=sf)
    run = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert run.returncode == 0, run.stderr[-3000:]
    counts = dict(line.split() for line in run.stdout.splitlines())
    assert len(counts) == 14 and all(int(n) > 0 for name, n in counts.items() if name != "op7_decontamination")
