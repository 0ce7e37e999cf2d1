"""The Merkle manifest against a plain recursive model."""

from __future__ import annotations

import hashlib
import zlib

import pytest

from memlake.llm import manifest as M

DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def H(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(digests):
    """(root, path of every leaf): a path is a list of (left, right)."""
    paths, level, place = [[] for _ in digests], list(digests), list(range(len(digests)))
    while len(level) > 1:
        for i, p in enumerate(place):
            run = p // 16 * 16
            paths[i].append(("".join(level[run:p]), "".join(level[p + 1:run + 16])))
        level = [H("".join(level[i:i + 16])) for i in range(0, len(level), 16)]
        place = [p // 16 for p in place]
    return level[0], paths


def brute(rows):
    """{result rows} of (doc_id, text, lang, source, n_chars) rows."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    by = {}
    for d, t, la, s, n in rows:
        tampered = d is not None and zlib.crc32(str(d).encode()) % 5 == 0
        forged = leaf_of(d, s, la, n, t.translate(lower) if t is not None else None) if tampered else None
        by.setdefault(s, []).append((d, leaf_of(d, s, la, n, t), forged))
    out, sources = [], sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subs = {}
    for s in sources:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        subs[s] = tree([x[1] for x in by[s]])
    root, tops = tree([subs[s][0] for s in sources]) if sources else ("", [])
    for s, top in zip(sources, tops, strict=True):
        for (d, leaf, forged), path in zip(by[s], subs[s][1], strict=True):
            whole = path + top
            f = forged or leaf
            for left, right in whole:
                f = H(left + f + right)
            out.append((d, leaf, subs[s][0], root, H("".join(a + b for a, b in whole)), f, f == root))
    return sorted(out, key=repr)


def run(spark, tmp_path, rows, extra=()):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, DDL)
    for c in extra:
        df = df.withColumn(c, F.lit("x"))
    df.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    cols = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r[c] for c in cols) for r in M.op11_merkle_manifest(spark, str(tmp_path)).collect()), key=repr)


def rows_of(n, source, start=0):
    return [(start + i, f"Text {i} of A Source", "en", source, i) for i in range(n)]


EDGES = [(1, None, None, None, None), (None, "x", "de", None, 3), (None, "x", "de", None, 3), (None, "A", None, "s", None),
         (7, "", "", "", 0), (7, "", "", "", 0), (7, "Äé ß Z", "fr", "", 5), (15, "ABC " * 50_000, "en", "long", 200_000),
         (-4, "n", "en", "é", 1), (9, "z", "en", "Z", 1)]


@pytest.mark.parametrize("rows", [EDGES, [], rows_of(1, "a"), rows_of(1, "a") + rows_of(1, "b", 9), rows_of(16, None),
                                  rows_of(17, "a") + rows_of(256, "b", 100) + rows_of(257, "c", 1000),
                                  [(i, "T", "en", f"s{i:04d}", 1) for i in range(300)]],
                         ids=["edges", "empty", "one", "two", "run", "levels", "sources"])
def test_against_model(spark, tmp_path, rows):
    assert run(spark, tmp_path, rows, ("digest", "rank", "path", "block", "kids")) == brute(rows)


def test_several_blocks_and_a_source_over_many_partitions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_DIGITS", 1)
    monkeypatch.setattr(M, "RANGE_ROWS", 100)
    rows = rows_of(900, "hot") + rows_of(40, None, 5000) + rows_of(33, "zz", 9000) + [(3, "same", "en", "copies", 1)] * 350
    assert run(spark, tmp_path, rows) == brute(rows)


def test_full_and_second_block(spark, tmp_path):
    rows = rows_of(4096, "full") + rows_of(4097, "more", 10_000)
    assert run(spark, tmp_path, rows) == brute(rows)


def test_tampered_rows_fail(spark, sf_small):
    rows = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()
    got = sorted((tuple(r) for r in M.op11_merkle_manifest(spark, sf_small).collect()), key=repr)
    assert got == brute([tuple(r) for r in rows])
    assert 0 < sum(not r[-1] for r in got) < len(got)
