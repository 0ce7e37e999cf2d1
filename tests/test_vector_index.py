"""Vectors by pivot cells: the same top-k as a full scan, with cells left unopened; approximate search with measured recall."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from memlake.operators import search as S
from memlake.operators import vector_index as V

DDL = "hash string, vec array<double>, sensitivity string, project string, owner_id string"


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(30):  # tight groups
        centre = rng.normal(size=24)
        for _ in range(40):
            v = centre + 0.15 * rng.normal(size=24)
            rows.append((v / np.linalg.norm(v)).tolist())
    rows += [rows[0]] * 5 + [[0.0] * 24, None, [1.0, 0.0], [0.6, 0.8]]
    rows = [(f"{i:06x}", v, ["public", "internal", "secret"][i % 3], ["p", "q", None][i % 7 % 3], ["a", "b"][i % 2]) for i, v in enumerate(rows)]
    mem = spark.createDataFrame(rows, DDL)
    asked = [(i, rows[37 * i][1]) for i in range(30)] + [(50, [0.0] * 24), (51, [0.8, 0.6]), (52, (-np.array(rows[3][1])).tolist()), (53, [1.0, 0.0, 0.0])]
    q = spark.createDataFrame(asked, "query_id long, vec array<double>")
    return mem, q, V.create_vectors(mem, pivots=40)


def answer(df):
    return sorted((r.query_id, r["rank"], r.hash, round(r.sim, 9)) for r in df.collect())


def test_exact_search_equals_a_full_scan(spark, data):
    mem, q, index = data
    from memlake.functions.visibility import visible
    for who in ({}, {"owner": "a", "project": "p"}):
        seen = mem.where(visible(who.get("project"), who.get("owner")))
        assert answer(V.topk(index, q, 7, **who)) == answer(S.vector_topk(spark, seen, q, k=7))


def test_scoped_callers(spark, data):
    mem, q, index = data
    asks = q.withColumn("scope_project", F.when(F.col("query_id") % 3 == 0, "p")).withColumn("owner", F.when(F.col("query_id") % 2 == 0, "a"))
    assert answer(V.topk(index, asks, 5, scoped=True)) == answer(S.vector_topk(spark, mem, asks, k=5, scoped=True))


def test_most_cells_stay_closed(spark, data):
    _, q, index = data
    some = q.where("query_id < 30")
    from pyspark.sql import Window
    ranked = V.bounds(index, some).withColumn("_i", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "cell")))
    hits = V._open(index, some, ranked.where("_i <= 4"), 7, index.vectors, False)
    rest = V.remaining(ranked, hits, 7).count()
    assert 30 * 4 + rest < 0.5 * 30 * index.cells.count()


def test_approximate_recall(spark, data):
    _, q, index = data
    exact = V.topk(index, q.where("query_id < 30"), 10)
    near = V.topk(index, q.where("query_id < 30"), 10, probes=6)
    assert V.recall(exact, near).agg(F.avg("recall")).first()[0] >= 0.9
    assert V.recall(exact, exact).agg(F.min("recall")).first()[0] == 1.0


def test_memories_are_not_copied_per_query(spark, data):
    mem, q, _ = data
    plan = S.vector_topk(spark, mem, q, k=3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("explode") == 2  # queries over memory blocks, and one part of the queries
