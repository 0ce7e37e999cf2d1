"""Poisson mixing: shares, exact inversion, edge cases (the SQL gives the rows of the query)."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import functions as F

from memlake.llm import mixing as M


def copies(key, rate):
    u = int(hashlib.md5(f"{M.SEED}:{key}".encode()).hexdigest()[:13], 16) / 2**52
    k, p, cdf = 0, math.exp(-rate), math.exp(-rate)
    while cdf <= u:
        k += 1
        p *= rate / k
        cdf += p
    return k


def test_counts_match_inversion(spark):
    rows = [(i, "t", "big" if i % 3 else None, 1) for i in range(3000)] + [(None, "no id", "big", 1), (None, None, "big", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, copy int")
    weights = spark.createDataFrame([("big", 1.0), (None, 3.0), ("absent", 6.0)], "source string, weight double")
    out = M.mix_sources(docs, weights, total=4000)
    assert out.columns == ["doc_id", "text", "source", "copy"]
    got = {(r["source"], r["doc_id"]): r["n"] for r in out.where("doc_id is not null").groupBy("source", "doc_id").agg(F.count("*").alias("n")).collect()}
    rate = {None: 0.75 * 4000 / 1000, "big": 0.25 * 4000 / 2002}
    for d, _, s, _ in rows[:3000]:
        assert got.get((s, d), 0) == copies(d, rate[s])
    n = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(n[None] - 3000) < 200 and abs(n["big"] - 1000) < 120


def test_large_rate_does_not_underflow(spark):
    docs = spark.createDataFrame([(i, "t", "s") for i in range(40)], "doc_id bigint, text string, source string")
    out = M.mix_sources(docs, spark.createDataFrame([("s", 1.0)], "source string, weight double"), total=40 * 2000)
    assert abs(out.count() - 80_000) < 2000


def test_zero_weight_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "t", "s"), (2, "t", "u")], "doc_id bigint, text string, source string")
    weights = spark.createDataFrame([("s", 0.0), ("u", None)], "source string, weight double")
    assert M.mix_sources(docs, weights).count() == 0
    assert M.mix_sources(docs.limit(0)).count() == 0


def test_same_rows_whatever_the_partitioning(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    a = M.mix_sources(docs).select("doc_id", "copy").collect()
    b = M.mix_sources(docs.repartition(7)).select("doc_id", "copy").collect()
    assert sorted(a) == sorted(b) and [r.doc_id for r in a] != sorted(r.doc_id for r in a)
