"""Phrase collocations against plain counting."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from memlake.llm import collocations as C

DDL = "doc_id bigint, text string, lang string"


def brute(rows, min_count, max_words=4, hiding=80, top=2000):
    grams, totals = {}, Counter()
    for _, text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            key = "und" if lang is None else lang
            totals[key] += len(w)
            for n in range(1, max_words + 1):
                grams.setdefault(key, Counter()).update(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in grams.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        best = []
        for p, a in cand.items():
            if any(100 * b >= hiding * a and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            s, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            best.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(best)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


def texts(seed, n, vocabulary=30):
    rng = random.Random(seed)
    words = [rng.choice("abcdefgh") + str(i) for i in range(vocabulary)] + ["É", "İx", "a b", "tab", "x" * 300]
    fixed = [" ".join(rng.choice(words) for _ in range(m)) for m in (2, 3, 4, 5) for _ in range(3)]
    out = []
    for i in range(n):
        parts = [rng.choice(fixed) if rng.random() < .5 else rng.choice(words).upper() for _ in range(rng.randrange(60))]
        out.append((i, "".join(p + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "?"]) for p in parts), rng.choice(["en", "de", None, ""])))
    return out


def run(spark, rows, parts=3, **kw):
    df = spark.createDataFrame(rows, DDL).repartition(parts).selectExpr("*", "'x' AS phrase", "1 AS f", "2 AS a")
    return sorted(tuple(r) for r in C.collocations(df, **kw).collect())


@pytest.mark.parametrize("hidden", [80, 40])
def test_against_plain_counts(spark, hidden):
    rows = texts(1, 150)
    rows += [(None, None, "en"), (3, "", "en"), (3, " .,;\n", None), (5, "a0 " * 3000, "long"), (5, "a0 " * 3000, "long")]
    got = run(spark, rows, min_count=5, hiding=hidden)
    assert got == brute(rows, 5, hiding=hidden) and len(got) > 50


def test_top_rows_and_ties(spark):
    rows = texts(2, 120, vocabulary=12)
    assert run(spark, rows, min_count=3, top=7) == brute(rows, 3, top=7)


def test_tiny_filter_and_constant_spilling_change_nothing(spark, monkeypatch):
    rows = texts(3, 80)
    want = brute(rows, 4)
    for name, value in (("FILTER_SHARE", 1), ("MAX_FILTER_BITS", 9), ("RUN_KEYS", 300), ("SLICE_BYTES", 500), ("TRIE_ENTRIES", 40), ("TASK_WORDS", 25), ("BURST", 3), ("PREFIX_BYTES", 300), ("RUN_ENTRIES", 20), ("FEED_WORDS", 50)):
        monkeypatch.setattr(C, name, value)
    counted = {(r.lang, r.phrase): r.f for r in C.phrase_counts(spark.createDataFrame(rows, DDL).repartition(2), 4, 4).collect()}
    assert all(counted[(la, p)] == a for la, _, p, a, *_ in want)
    assert run(spark, rows, min_count=4) == want


def test_exact_arithmetic_beyond_64_bits(spark):
    expr = f"{C._exact('a')} * CAST(2000000 AS DECIMAL(7, 0)) DIV ({C._exact('l')} + {C._exact('r')}) AS s"
    a, left, right = 9 * 10**17 + 1, 9 * 10**17 + 7, 9 * 10**18
    got = spark.sql(f"SELECT {a}L AS a, {left}L AS l, {right}L AS r").selectExpr(expr).first()["s"]
    assert got == 2000000 * a // (left + right)


def test_empty_table(spark):
    assert run(spark, [], min_count=2) == []


def test_trie_bursts_and_spills_whole_subtrees():
    rng, trie, want = random.Random(4), C.HatTrie(burst=4), Counter()
    runs = []
    for _ in range(3000):
        path = b"".join(rng.randrange(6).to_bytes(4, "big") for _ in range(rng.randrange(1, 5)))
        trie.add(path, 2)
        want[path] += 2
        if trie.entries > 200:
            runs += trie.spill(100)
            assert trie.entries <= 100
    assert any(type(c) is list for c in trie.kids.values())
    runs += trie.spill()
    assert trie.entries == 0 and not trie.kids
    assert all(len({p[:4] for p, _ in r}) == 1 for r in runs)
    got = Counter()
    for r in runs:
        for p, n in r:
            got[p] += n
    assert got == want


def test_real_documents(spark, sf_small):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in C.op13_phrase_collocations(spark, sf_small).collect()) == brute(rows, 30)


def test_nothing_is_broadcast_by_its_file_size(spark):
    """The counted phrases are few compressed bytes, and many rows once their salts and spans are exploded."""
    rows = texts(6, 100)
    df = C.collocations(spark.createDataFrame(rows, DDL).repartition(2), min_count=4)
    plan = df._jdf.queryExecution().executedPlan()
    planned = plan.toString()
    got = sorted(tuple(r) for r in df.collect())
    for text in (planned, plan.toString()):  # as first planned, and as it ran
        assert "BroadcastExchange" not in text and "BroadcastHashJoin" not in text
    assert got == brute(rows, 4) and got
