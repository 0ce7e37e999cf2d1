"""SimHash near-dedup against all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from memlake.llm import simhash as S


def brute_fingerprint(text, k=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(rows, bits=4):
    fps = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    arr = np.array(fps, np.uint64)
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(arr[i + 1:] ^ arr[i]) <= bits) + i + 1:
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, fps[i], least.get(root(i))) for i, (d, _) in enumerate(rows)), key=repr)


def run(spark, rows, extra=()):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for c in extra:
        df = df.withColumn(c, F.lit("x"))
    return sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in S.near_duplicates(df).collect()), key=repr)


def test_edge_cases_and_chains(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(300)]
    rows = [(90, None), (7, ""), (8, " \t\n"), (None, ""), (5, "Two words"), (6, "two  WORDS"), (6, "two words"), (4, "É é"), (3, "é é"),
            (2, "solo"), (None, "a row without an id")]
    for i in range(40):  # a drifting text: neighbours are near, the ends are not
        base[rng.randrange(300)] = rng.choice(words)
        rows.append((100 + i, " ".join(base)))
    rows.append((200, " ".join(words) * 30))
    assert run(spark, rows, ("fp", "hi", "lo")) == brute_classes(rows)


def test_real_documents(spark, sf_small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    got = sorted(((r.doc_id, int(r.fingerprint, 16), r.component_id)
                  for r in S.op9_simhash_neardup(spark, sf_small).collect()), key=repr)
    assert got == brute_classes(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


@pytest.mark.parametrize("bits", [2, 4])
def test_links_find_every_pair_of_planted_fingerprints(spark, bits):
    rng = np.random.default_rng(bits)
    centres = rng.integers(0, 2**64, 30, dtype=np.uint64)
    fps = []
    for c in centres:
        fps.append(c)
        for _ in range(4):
            flip = sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False))
            fps.append(c ^ np.uint64(flip))
    fps = np.unique(np.array(fps, np.uint64))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp bigint")
    pairs = [(r.hi, r.lo) for r in S.contract(S.link_fingerprints(df, bits)).collect()]
    root = dict(pairs)
    got = {}
    for x in fps.view(np.int64):
        got.setdefault(root.get(int(x), int(x)), set()).add(int(x))
    seen, want = set(), []
    signed = fps.view(np.int64)
    for i in range(len(fps)):
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            near = set(np.flatnonzero(np.bitwise_count(fps ^ fps[todo.pop()]) <= bits)) - group
            group |= near
            todo += near
        seen |= group
        want.append({int(signed[g]) for g in group})
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))
