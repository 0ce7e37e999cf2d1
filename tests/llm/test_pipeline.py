"""The pipeline against a row-at-a-time version of every stage, and its edge cases."""

from __future__ import annotations

import base64

import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as P
from memlake.llm import packing as K
from memlake.llm import quality as Q
from memlake.llm.common import materialize
from llm.test_mixing import copies
from llm.test_packing import unpack
from llm.test_simhash import brute_classes


@pytest.fixture(scope="module")
def stages(spark, sf_check):
    docs = spark.read.parquet(f"{sf_check}/documents.parquet")
    out = [docs]
    for _, stage in P.STAGES:
        out.append(materialize(stage(spark, out[-1], sf_check), "test_pipeline"))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_return_the_columns_of_documents(stages):
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes


def test_quality_stage(spark, stages, sf_check):
    docs = rows(stages[0])
    model = Q.train(stages[0], Q.grades_from_labels(spark.read.parquet(f"{sf_check}/labels.parquet")))
    import numpy as np
    want = {d for d, r in docs.items() if model.tails(np.array([model.score(r.text)]))[0, -1] >= Q.MIN_TAIL}
    assert rows(stages[1]) == {d: docs[d] for d in want}
    labels = spark.read.parquet(f"{sf_check}/labels.parquet").collect()
    clean = [r.doc_id for r in labels if r.quality == 1 and r.toxic == 0]
    assert sum(d in want for d in clean) >= 0.99 * len(clean)
    assert sum(r.doc_id in want for r in labels if r.toxic == 1) <= 0.1 * sum(r.toxic == 1 for r in labels)


def test_near_duplicate_stage(stages):
    before = rows(stages[1])
    want = {d for d, _, c in brute_classes([(r.doc_id, r.text) for r in before.values()]) if d == c}
    assert rows(stages[2]) == {d: before[d] for d in want}
    assert len(want) < len(before)


def test_leak_stage(spark, stages, sf_check):
    before = rows(stages[2])
    items = [" ".join(r.text.split()) for r in spark.read.parquet(f"{sf_check}/benchmark.parquet").collect()]
    whole = {d for d, r in before.items() if any(i in " ".join(r.text.split()) for i in items)}
    grams = {g for i in items for w in [i.split()] for g in (" ".join(w[k:k + 6]) for k in range(len(w) - 5))}
    after = rows(stages[3])
    assert whole and not whole & set(after)
    for d in set(before) - set(after):  # nothing goes without a part of a passage
        words = before[d].text.split()
        assert any(" ".join(words[k:k + 6]) in grams for k in range(len(words)))


def test_mixing_stage(stages):
    before = rows(stages[3])
    n, out = {}, {}
    for r in before.values():
        n[r.source] = n.get(r.source, 0) + 1
    whole = sum(c ** 0.5 for c in n.values())
    for d, r in before.items():
        k = copies(d, n[r.source] ** 0.5 / whole * len(before) / n[r.source])
        if k:
            out[d] = k
    got = {r.doc_id: r.k for r in stages[4].groupBy("doc_id").agg(F.count("*").alias("k")).collect()}
    assert got == out
    assert all(before[r.doc_id] == r for r in stages[4].collect())


def test_packing_stage(stages):
    with open(K.VOCABULARY, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}
    bpe = tiktoken.Encoding("own", pat_str=K.PATTERN, mergeable_ranks=table, special_tokens={})
    pieces = unpack(stages[5].collect())
    for r in stages[4].collect():
        ids = bpe.encode_ordinary(r.text) + [K.END_ID] if r.text else []
        for at in range(0, len(ids), K.ROW_TOKENS):
            pieces.remove((r.doc_id, at, ids[at:at + K.ROW_TOKENS]))
    assert pieces == []


def test_run_is_the_stages(spark, stages, sf_check):
    got = P.run(spark, sf_check)
    assert got.dtypes == stages[5].dtypes
    assert got.agg(F.sum("n_tokens")).first()[0] == stages[5].agg(F.sum("n_tokens")).first()[0]


EDGE = [(1, None, "en", "a", 0), (2, "", None, None, None), (None, "no id at all here", "en", "a", 1), (None, None, None, None, None),
        (3, "same words here today", "en", "b", 2), (3, "same words here today", "en", "b", 2), (4, "same words here today", "en", "b", 2),
        (5, "long " * 40_000, "en", "a", 3)]


def test_edge_rows_pass_every_stage(spark, sf_small):
    docs = (spark.createDataFrame(EDGE, "doc_id bigint, text string, lang string, source string, n_chars bigint")
            .withColumn("kept", F.lit(1)).withColumn("fp", F.lit("x")).withColumn("h", F.lit(2.0)).withColumn("row", F.lit(3)))
    for table in (docs, docs.limit(0)):
        for i, (_, stage) in enumerate(P.STAGES):
            out = stage(spark, table, sf_small)
            if i < len(P.STAGES) - 1:
                assert out.dtypes == table.dtypes
            out.collect()
    left = [r.doc_id for r in P.drop_near_duplicates(spark, docs, sf_small).collect()]
    # the empty texts of 1, 2 and a row without id are one class, the rows 3, 3 and 4 another
    assert sorted(left, key=repr) == sorted([1, None, 3, 5], key=repr)


def test_near_duplicates_with_null_and_repeated_ids(spark, sf_small):
    same, other = "one two three four five six seven", "a quite different text about nothing much at all here"
    rows = [(7, same, "b"), (7, same, "a"), (7, other, "c"), (2, same, "d"), (None, same, "e"), (None, other, "f"), (None, "alone " * 30, "g"),
            (None, "alone " * 30, "g"), (-5, "below zero stands this text today", "h"), (3, "below zero stands this text today", "i")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    left = sorted(((r.doc_id, r.text, r.source) for r in P.drop_near_duplicates(spark, docs, sf_small).collect()), key=repr)
    assert left == sorted([(2, same, "d"), (7, other, "c"), (None, "alone " * 30, "g"), (-5, rows[8][1], "h")], key=repr)
