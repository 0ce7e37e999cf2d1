"""Substring dedup against a dictionary of all windows."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from memlake.llm import repeats as R


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows, w=13):
    first = {}
    for d, t in rows:
        ws = words_of(t)
        for i in range(len(ws) - w + 1):
            key = tuple(ws[i:i + w])
            d_ = R.LAST if d is None else d
            first[key] = min(first.get(key, d_), d_)
    out = []
    for d, t in rows:
        ws = words_of(t)
        gone = set()
        for i in range(len(ws) - w + 1):
            if first[tuple(ws[i:i + w])] < (R.LAST if d is None else d):
                gone |= set(range(i, i + w))
        kept = " ".join(x for i, x in enumerate(ws) if i not in gone)
        out.append((d, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows, **over):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("h", F.lit(1)).withColumn("words", F.lit("x"))
    out = R.remove_repeats(df, **over).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))
    return sorted((tuple(r) for r in out.collect()), key=repr)


def made(seed, docs=60, vocabulary=12):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(vocabulary)]
    passages = [[rng.choice(pool) for _ in range(rng.randint(8, 40))] for _ in range(6)]
    rows = []
    for d in range(docs):
        ws = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            ws += p[a:] if rng.random() < 0.5 else p
            ws += [rng.choice(pool) for _ in range(rng.randint(0, 9))]
        rows.append((rng.choice([None, *range(30)]), rng.choice([" ", "\n", " \t "]).join(ws)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_dictionary(spark, seed):
    rows = made(seed) + [(1, None), (2, ""), (3, " \n"), (4, "é x " * 40), (5, "é x " * 40), (6, "a " * 30_000), (7, "a " * 13), (8, "a " * 12)]
    assert run(spark, rows) == brute(rows)


def test_hot_anchors_go_window_by_window(spark, monkeypatch):
    rng = random.Random(9)
    line = " ".join(f"common{i}" for i in range(16))
    rows = [(i, " ".join(f"r{rng.randrange(10**6)}" for _ in range(20)) + " " + line + " " +
             " ".join(f"r{rng.randrange(10**6)}" for _ in range(20))) for i in range(80)]
    want = brute(rows)
    monkeypatch.setattr(R, "HOT_CONTENTS", 5)
    assert run(spark, rows) == want


def test_real_documents(spark, sf_check):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_check}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in R.op4_substring_dedup(spark, sf_check).collect()), key=repr)
    want = brute(rows)
    assert got == want and sum(r[2] for r in want) > 0


@pytest.mark.parametrize("key", [None, 7])
def test_many_texts_of_one_id_have_arrays_of_their_own(spark, key):
    line = [" ".join(f"line{k}word{i}" for i in range(20)) for k in range(40)]
    rows = [(1, " ".join(line))] + [(key, f"{line[k]} only here {k}") for k in range(40)] + [(key, f"{line[3]} only here 3")]
    texts = R.text_rows(spark.createDataFrame(rows, "doc_id bigint, text string"))
    shared = R.shared_anchors(R.anchors(texts, R.WINDOW)).collect()
    assert len(shared) == 41 and all(len(r.hs) <= 8 for r in shared if r.oid != 1)
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_automaton_finds_every_window():
    rng = random.Random(4)
    for _ in range(60):
        texts = [[rng.randrange(3) for _ in range(rng.randint(0, 30))] for _ in range(6)]
        automaton = R.SuffixAutomaton()
        for i, t in enumerate(texts):
            want = [next((j for j in range(i) if any(texts[j][k:k + 4] == t[a:a + 4] for k in range(len(texts[j]) - 3))), -1)
                    for a in range(len(t) - 3)]
            assert automaton.first_owners(t, 4) == want
            automaton.add(t, i)


def test_word_hashes_depend_on_the_word_only():
    starts, h = R.word_hashes("ab  cd\nab é cd\tabc".encode())
    assert h[0] == h[2] and h[1] == h[4] and len(np.unique(h)) == 4 and starts.tolist() == [0, 4, 7, 10, 13, 16]


def test_spans_are_maximal():
    assert R.spans_of([5, 0, 13, 40], 13) == [(0, 26), (40, 53)]
