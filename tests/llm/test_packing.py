"""Packing: exact round trip, best fit against a plain search, edge cases."""

from __future__ import annotations

import base64
import random

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from memlake.llm import packing as K


@pytest.fixture(scope="module")
def bpe():
    with open(K.VOCABULARY, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}
    return tiktoken.Encoding("own", pat_str=K.PATTERN, mergeable_ranks=table, special_tokens={})


def plain_best_fit(lengths, size):
    rows, room = [], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [r for r in range(len(rows)) if room[r] >= lengths[i]]
        if fits:
            r = min(fits, key=lambda r: room[r])
        else:
            rows.append([])
            room.append(size)
            r = len(rows) - 1
        rows[r].append(i)
        room[r] -= lengths[i]
    return rows, room


def test_best_fit_matches_plain_search():
    rng = random.Random(5)
    for size in (1, 2, 7, 64, 100):
        lengths = [rng.randint(1, size) for _ in range(400)]
        got = K.pack(lengths, size)
        want, room = plain_best_fit(lengths, size)
        assert sorted(i for r in got for i in r) == list(range(400))
        assert sorted(size - sum(lengths[i] for i in r) for r in got) == sorted(room)
        assert len(got) == len(want)


def unpack(rows):
    """The ids of every document copy from the packed rows, and checks of each row."""
    pieces = []
    for r in rows:
        ids, pos = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        ends = r.cu_seqlens
        assert len(ids) == len(pos) and ends[0] == 0 and ends[-1] == r.n_tokens <= len(ids)
        assert (ids[r.n_tokens:] == K.END_ID).all()
        for doc, start, a, b in zip(r.doc_ids, r.doc_starts, ends[:-1], ends[1:], strict=True):
            assert (pos[a:b] == np.arange(b - a)).all()
            pieces.append((doc, start, ids[a:b].tolist()))
    return pieces


TEXTS = [(1, "hello world"), (2, ""), (3, None), (None, "no id"), (4, "word " * 9000 + "x"), (4, "same id"), (5, "hello world"),
         (5, "hello world"), (6, "  lead  and\n\n trail  "), (7, "é\U0001F600 \t mixed"), (2**60 + 1, "large id")]


def test_round_trip(spark, bpe):
    df = spark.createDataFrame(TEXTS, "doc_id bigint, text string").withColumn("body", F.lit(1)).coalesce(1)
    rows = K.pack_documents(df, size=64).collect()
    assert len({r.pack_id for r in rows}) == len(rows)
    pieces = unpack(rows)
    for doc, text in TEXTS:
        if not text:
            continue
        want = bpe.encode_ordinary(text) + [K.END_ID]
        for at in range(0, len(want), 64):
            pieces.remove((doc, at, want[at:at + 64]))
    assert pieces == []


def test_real_documents_round_trip(spark, sf_small, bpe):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    rows = K.op3_token_packing(spark, sf_small).collect()
    got = {}
    for doc, start, ids in sorted(unpack(rows)):
        assert len(got.setdefault(doc, [])) == start
        got[doc] += ids
    assert all(got[d][-1] == K.END_ID and got[d][:-1] == bpe.encode_ordinary(t) for d, t in docs.items())
    assert set(got) == {d for d, t in docs.items() if t}
    assert sum(r.n_tokens for r in rows) > 0.95 * K.ROW_TOKENS * len(rows)


def test_blocks_bound_memory_and_empty_table(spark):
    df = spark.createDataFrame([(i, "some words " * 30) for i in range(300)], "doc_id bigint, text string").coalesce(1)
    rows = K.pack_documents(df, size=128, block_tokens=500).collect()
    assert sum(r.n_tokens for r in rows) == sum(r.n_tokens for r in K.pack_documents(df, size=128).collect())
    assert K.pack_documents(df.limit(0)).count() == 0


def test_many_tiny_texts_and_one_without_spaces_stay_small():
    """Memory of the kernel's parts: 10^5 one-word texts as one block, and words that are too long to remember."""
    import tracemalloc

    import numpy as np

    from memlake.llm import packing
    tracemalloc.start()
    block = packing._Block()
    for i in range(100_000):
        block.add(i if i % 7 else None, np.array([i % 50_000, packing.END_ID], np.uint16), 2048)
    held = tracemalloc.get_traced_memory()[0]
    rows = segments = 0
    for b in block.batches(2048, packing.END_ID, 5):
        assert b.nbytes < 2 * packing.OUT_BYTES and b.column("pack_id")[0].as_py() == 5 + rows
        rows += b.num_rows
        segments += len(b.column("doc_ids").flatten())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (rows, segments) == (98, 100_000) and held < 4 << 20 and peak < 60 << 20
    words = packing._Words(lambda w: b"xx" * len(w))
    for i in range(300):
        assert len(words["y" * 10_000 + str(i)]) > 20_000
    assert not words
    for i in range(400_000):
        words[f"w{i}"]
    assert words.bytes < packing.CACHE_BYTES + 1000
