"""Embedding near-dedup against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from memlake.llm import embedding_dedup as E

DDL = "vec_id bigint, embedding array<float>, label int"


def brute(rows, threshold=0.95):
    vecs = [None if v is None else np.array(v, np.float64) for _, v, *_ in rows]
    ok = [v is not None and len(v) > 0 and np.isfinite(v).all() and bool((v != 0).any()) for v in vecs]
    unit = [v / np.sqrt((v * v).sum()) if k else None for v, k in zip(vecs, ok, strict=True)]
    near = [[j for j in range(len(rows)) if j != i and ok[i] and ok[j] and len(unit[i]) == len(unit[j])
             and float(unit[i] @ unit[j]) >= threshold] for i in range(len(rows))]
    out, seen = [None] * len(rows), set()
    for i in range(len(rows)):
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            new = set(near[todo.pop()]) - group
            group |= new
            todo += new
        seen |= group
        ids = [rows[g][0] for g in group if rows[g][0] is not None]
        for g in group:
            c = min(ids, default=None)
            out[g] = (rows[g][0], len(near[g]), c, rows[g][0] is not None and rows[g][0] == c)
    return sorted(out, key=repr)


def run(spark, rows, ddl=DDL, threshold=0.95):
    df = spark.createDataFrame(rows, ddl).selectExpr("*", "'x' AS row", "1 AS tile", "0 AS size")
    return sorted((tuple(r) for r in E.near_duplicates(df, threshold=threshold).collect()), key=repr)


def cluster(rng, dim, n, spread, start, centre=None):
    c = rng.normal(size=dim) if centre is None else centre
    return [(start + i, (c + spread * rng.normal(size=dim) * np.linalg.norm(c) / dim ** .5).astype(np.float32).tolist(), 0) for i in range(n)]


def some_rows(seed, dim=16):
    rng = np.random.default_rng(seed)
    rows = cluster(rng, dim, 60, 0.0, 0) + cluster(rng, dim, 60, 0.1, 100) + cluster(rng, dim, 80, 0.23, 200) + cluster(rng, dim, 40, 3, 300)
    walk = rng.normal(size=dim)
    for i in range(40):  # a chain: neighbours are near, the ends are not
        walk = walk + 0.2 * rng.normal(size=dim)
        rows.append((400 + i, walk.astype(np.float32).tolist(), 1))
    return rows


def test_against_all_pairs(spark):
    assert run(spark, some_rows(1)) == brute(some_rows(1))


def test_many_small_tiles_and_blocks(spark, monkeypatch):
    for name, value in (("TILE", 16), ("BLOCK_ROWS", 40), ("PIVOTS", 5)):
        monkeypatch.setattr(E, name, value)
    rows = some_rows(2)
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, threshold=0.8) == brute(rows, 0.8)


def test_edge_cases(spark):
    nan, inf, big = float("nan"), float("inf"), 3e38
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, -0.0], 0), (4, [1.0, None], 0), (5, [nan, 1.0], 0), (6, [inf, 1.0], 0), (7, [1.0, 2.0], None),
            (None, [2.0, 4.0], 1), (None, [9.0, -9.0], 1), (None, None, 1), (8, [1.0, 2.0, 0.0], 1), (9, [2.0, 4.0], 1), (9, [1.0, 2.0], 1), (9, [-1.0, -2.0], 1),
            (10, [big, big], 0), (11, [1e-38, 1e-38], 0), (12, [5.0], 0), (13, [1.0], 0), (2**60 + 1, [1.0, 0.1], 3), (2**60 + 2, [1.0, 0.1], 3)]
    as_brute = [(i, None if v is None else [np.nan if x is None else x for x in v], la) for i, v, la in rows]
    assert run(spark, rows) == brute(as_brute)
    assert run(spark, [], DDL) == []
    assert run(spark, rows[:6]) == brute(as_brute[:6])


def test_doubles_and_pairs_at_the_threshold(spark):
    rng, rows = np.random.default_rng(5), []
    for i in range(40):  # pairs a hair above and below
        a = rng.normal(size=8)
        a /= np.linalg.norm(a)
        b = rng.normal(size=8)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        c = 0.95 + (1e-7 if i % 2 else -1e-7)
        rows += [(2 * i, a.tolist(), 0), (2 * i + 1, (7 * (c * a + (1 - c * c) ** .5 * b)).tolist(), 0)]
    ddl = "vec_id bigint, embedding array<double>, label int"
    assert run(spark, rows, ddl) == brute(rows) and sum(r[1] for r in brute(rows)) >= 40


@pytest.mark.parametrize("dim", [4, 64, 1500])
def test_error_bound_holds(dim):
    rng = np.random.default_rng(dim)
    _, by = E.unit_rows(rng.normal(size=(60, dim)) * rng.exponential(size=(60, dim)) ** 3)
    u = by[dim][1]
    q, scale, err = E.quantise(u)
    near = (q.astype(float) @ q.T.astype(float)) * scale[:, None] * scale[None]
    assert (np.abs(u @ u.T - near) <= err[:, None] + err[None] + err[:, None] * err[None]).all()


def test_long_vectors(spark):
    rng = np.random.default_rng(9)
    rows = cluster(rng, 1500, 12, 0.2, 0) + cluster(rng, 1500, 12, 0.33, 50)
    assert run(spark, rows) == brute(rows)


def test_real_embeddings(spark, sf_small):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_small}/embeddings.parquet").collect()]
    assert sorted((tuple(r) for r in E.op12_embedding_neardup(spark, sf_small).collect()), key=repr) == brute(rows)
