"""Exact dedup against a dictionary, and the filter it screens with."""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from memlake.llm import exact_dedup as E
from memlake.llm import fuse


def brute(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(d)
    out = []
    for body, ids in groups.items():
        known = [d for d in ids if d is not None]
        keep = min(known) if known else None
        first = True
        for d in sorted(ids, key=lambda d: (d is None, d or 0)):
            out.append((d, keep, len(ids), d == keep and first, hashlib.sha256(body.encode()).hexdigest()))
            first = False
    return sorted(out, key=repr)


ROWS = [(5, "a  b"), (3, "a\tb"), (9, "a b"), (9, "a b"), (2, " a b"), (None, "a b"), (7, None), (8, ""), (None, "only null"), (None, "only null"),
        (10, "x" * 200_000), (11, "x" * 200_000 + "y"), (12, "x" * 200_000), (4, "a b"), (1, "\n")]


def run(spark, rows, split=6, digest=None):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("digest", F.lit(1)).withColumn("kept", F.lit(2))
    texts = E.text_rows(df) if digest is None else E.text_rows(df, digest=digest)
    out = E.exact_dedup(texts, F.col("doc_id") <= split)
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex()) for r in out.collect()), key=repr)


def test_against_dictionary(spark):
    for split in (-1, 6, 100):
        assert run(spark, ROWS, split) == brute(ROWS)


def test_hot_group_and_empty_table(spark):
    rows = [(i, "hot") for i in range(500)] + [(1000 + i, f"cold {i}") for i in range(300)]
    assert run(spark, rows, 400) == brute(rows)
    assert run(spark, []) == []


def test_digest_collisions_are_parted_by_bytes(spark):
    weak = lambda c: F.unhex(F.sha2(F.length(c).cast("string"), 256))  # noqa: E731  equal lengths collide
    rows = [(1, "aa"), (2, "bb"), (3, "aa"), (4, "cc"), (5, "bb"), (6, "d"), (7, "bb"), (8, "aa")]
    got = [r[:4] for r in run(spark, rows, 4, weak)]
    assert got == [r[:4] for r in brute(rows)]


def test_fuse_filter_has_no_false_negatives():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 10, 1000, 40_000):
        keys = rng.integers(0, 2**64, n, dtype=np.uint64)
        blob = fuse.build(keys)
        assert fuse.contains(blob, keys).all()
        others = rng.integers(0, 2**64, 50_000, dtype=np.uint64)
        assert fuse.contains(blob, others).mean() < 0.01
        assert n < 1000 or len(blob) < 1.5 * n
