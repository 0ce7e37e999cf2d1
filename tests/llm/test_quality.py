"""Ordinal classifier: held-out accuracy and edge cases."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from memlake.llm import quality as Q


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    grades = Q.grades_from_labels(spark.read.parquet(f"{sf}/labels.parquet"))
    model = Q.train(docs, grades.where("doc_id % 2 = 0"))
    assert list(model.thresholds) == sorted(model.thresholds)
    rows = (Q.score_documents(docs, model).join(grades.where("doc_id % 2 = 1"), "doc_id")
            .select("grade", "kept", "expected_grade").collect())
    kept = {g: np.mean([r.kept for r in rows if r.grade == g]) for g in range(3)}
    assert kept[2] > 0.98 and kept[1] < 0.06 and kept[0] < 0.06
    mean = [np.mean([r.expected_grade for r in rows if r.grade == g]) for g in range(3)]
    assert mean == sorted(mean)


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, "good words here"), (2, None), (3, ""), (None, "good words here"), (1, "good words here"), (4, "bad " * 50_000)],
                                 "doc_id bigint, text string").withColumn("kept", F.lit(5)).withColumn("grade", F.lit(6))
    ratings = spark.createDataFrame([(1, 2), (2, 0), (3, None), (None, 1), (4, 0), (4, 1)], "doc_id bigint, grade int")
    out = Q.score_documents(docs, Q.train(docs, ratings)).collect()
    assert len(out) == 6 and all(0 <= r.expected_grade <= 2 for r in out)
    assert len({r.expected_grade for r in out if r.doc_id in (1, None)}) == 1
    none = Q.score_documents(docs, Q.train(docs, ratings.limit(0))).collect()
    assert len(none) == 6 and all(r.kept and r.expected_grade is None for r in none)
    assert Q.score_documents(docs.limit(0), None).count() == 0


def test_grades(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1), (4, None, 0), (5, 0, 1)], "doc_id bigint, quality int, toxic int")
    assert {r.doc_id: r.grade for r in Q.grades_from_labels(labels).collect()} == {1: 2, 2: 1, 3: 0, 5: 0}


def test_sample_holds_rated_documents_only_and_is_bounded_by_texts(spark):
    ratings = spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("int").alias("grade"))
    docs = spark.range(3000).select((F.col("id") % 3 + 7).alias("doc_id"), F.concat(F.lit("word "), F.chr(F.col("id") % 24 + 97)).alias("text"))
    seen = []

    def fit(words, grades, real=Q.fit):
        seen.append((len(words), sorted(set(grades.tolist()))))
        return real(words, grades)
    old, Q.fit = Q.fit, fit
    try:
        for most in (12, 100):
            assert Q.train(docs, ratings, max_rated=most) is not None
    finally:
        Q.fit = old
    assert seen == [(12, seen[0][1]), (24, [0, 1, 2])]
