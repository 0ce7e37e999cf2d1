"""Plan-shape guards over every registered query, and the driver scenario (entry() run
from another working directory, so executors must import the shipped package)."""

from __future__ import annotations

import os
import subprocess
import sys

from conftest import SF_SMALL

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


def test_no_cross_joins_or_row_udfs(spark, queries):
    q, _ = queries
    bad = {}
    for name in sorted(q):
        plan = q[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        hits = [k for k in FORBIDDEN if k in plan]
        if hits:
            bad[name] = hits
    assert bad == {}


def test_entry_from_other_cwd(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        "import importlib.util, sys\n"
        f"spec = importlib.util.spec_from_file_location('e', {os.path.join(repo, '__spark_entry__.py')!r})\n"
        "m = importlib.util.module_from_spec(spec); spec.loader.exec_module(m)\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "n = m.entry(s).count()\n"
        "print('ROWS', n)\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    r = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "ROWS" in r.stdout, r.stderr[-3000:]
    assert int(r.stdout.split("ROWS")[1].split()[0]) > 0


def test_pushdown_and_pruning(spark, queries):
    q, _ = queries
    # counting memories by type never reads the document text
    plan = q["stats_by_type"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "ReadSchema" in line]
    assert scans and all("text" not in s for s in scans)
