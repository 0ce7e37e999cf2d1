"""Inputs that cost a lot (embeddings, searches) are worked out once, however often a job reads them."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.operators import search as S
from memlake.operators import vector_index as V


def counted(spark, df):
    """`df`, and an accumulator of the rows that were worked out."""
    n = spark.sparkContext.accumulator(0)

    def each(batches):
        for pdf in batches:
            n.add(len(pdf))
            yield pdf
    return df.mapInPandas(each, df.schema), n


def test_vectors_are_embedded_once(spark):
    rows = spark.range(60).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("hash"), F.array(F.col("id") / 60.0, F.lit(1.0)).alias("vec"),
                                  F.lit("public").alias("sensitivity"), F.lit("p").alias("project"), F.lit("o").alias("owner_id"))
    mem, n = counted(spark, rows)
    index = V.create_vectors(mem, pivots=4)
    assert index.vectors.count() == 60 and n.value == 60


def test_fallback_searches_once(spark):
    sem = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 1)], "query_id long, hash string, rank int")
    fts = spark.createDataFrame([(1, "c", 1), (3, "d", 1)], "query_id long, hash string, pos int")
    found, n = counted(spark, sem)
    got = {tuple(r) for r in S.with_fallback(found, fts).collect()}
    assert got == {(1, "a", 1, "semantic"), (1, "b", 2, "semantic"), (2, "a", 1, "semantic"), (3, "d", 1, "fulltext")}
    assert n.value == 3
