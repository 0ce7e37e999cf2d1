"""Changes by bucket, stored sessions, recall answers and k-means over several vector sizes."""

from __future__ import annotations

import os
import random

import numpy as np
from conftest import memories_df, memory_row
from pyspark.sql import functions as F

from memlake.operators import buckets as B
from memlake.operators import changes as W
from memlake.operators import clusters as K
from memlake.operators import recall as R
from memlake.operators import records as RC


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def rows_of(df):
    return sorted((r.hash, r.importance) for r in df.select("hash", "importance").collect())


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = f"{tmp_path}/memories"
    data = [memory_row(hash=f"{i:06x}", importance=float(i % 5)) for i in range(400)]
    mem = memories_df(spark, data)
    B.write_table(mem, path, buckets=16)
    before = files(path)
    changed = memories_df(spark, [memory_row(hash="000003", importance=9.0), memory_row(hash="new", importance=8.0)]).withColumn("arrival", F.lit(1))
    touched = B.change_table(spark, path, changed, W.upsert, buckets=16)
    after = files(path)
    same = [f for f in before if not any(f"bucket={b}/" in f for b in touched)]
    assert len(touched) <= 2 and len(same) >= 14 and all(after.get(f) == before[f] for f in same)
    assert not any(f in after for f in before if f not in same)
    assert rows_of(B.read_table(spark, path)) == rows_of(W.upsert(mem, changed))
    # nothing to do, a key that is not there, and a bucket that becomes empty
    assert B.change_table(spark, path, changed.limit(0), W.upsert, buckets=16) == []
    B.change_table(spark, path, spark.createDataFrame([("nobody",)], "hash string"), W.delete, buckets=16)
    gone = [r["hash"] for r in data if r["hash"] != "000003"] + ["new"]
    B.change_table(spark, path, spark.createDataFrame([(h,) for h in gone], "hash string"), W.delete, buckets=16)
    assert rows_of(B.read_table(spark, path)) == [("000003", 9.0)]
    log = spark.createDataFrame([("000003", 5), ("000003", 2_000_000_000), ("nobody", 1)], "hash string, ts long")
    B.change_table(spark, path, log, W.touch_rollup, buckets=16)
    row = B.read_table(spark, path).first()
    assert (row.hash, row.last_accessed, row.access_count) == ("000003", 2_000_000_000, 2)


TURNS = "conv_id long, turn int, role string, content string, title string, memory_hash string, project string, logged_at long, timestamp long, arrival int"


def test_two_logs_of_one_session_leave_one(spark):
    def log(conv, n, arrival, stamp=None, title="T"):
        return [(conv, i, "user", f"c{i} of log {arrival}", title, None, "p", 100 + conv, stamp, arrival) for i in range(n)]
    batch = spark.createDataFrame(log(1, 3, 1) + log(1, 2, 2, 77) + log(2, 1, 1), TURNS)
    stored = RC.build_sessions(spark.createDataFrame(log(1, 5, 0) + log(3, 2, 0), TURNS))
    rows = sorted((len(r.turns), r.turns[0].content, r.turns[0].timestamp) for r in RC.store_sessions(stored, RC.build_sessions(batch, "arrival"), "arrival").collect())
    assert rows == [(1, "c0 of log 1", None), (2, "c0 of log 0", None), (2, "c0 of log 2", 77)]


def test_session_without_times(spark):
    t = spark.createDataFrame([(1, 0, "user", "hi", "T", None, None, 5, None, 1)], TURNS).drop("timestamp")
    row = RC.build_sessions(t).first()
    assert row.turns[0].timestamp is None and row.token_count == round(len('[{"role":"user","content":"hi"}]') / 4 + 1e-9)


def test_recall_answers_every_request(spark):
    mem = memories_df(spark, [memory_row(hash="abcd12", context_log="x"), memory_row(hash="abcd34"), memory_row(hash="ffff00", sensitivity="secret")])
    req = spark.createDataFrame([(1, "ABCD"), (2, "abcd3"), (3, "abc"), (4, None), (5, ""), (6, "ffff"), (7, "zzzz"), (8, "abcd12345"), (9, "aaaa")], "request_id long, prefix string")
    got = {r.request_id: (r.status, r.hash) for r in R.recall_answers(mem, req, 1_700_000_000).collect()}
    assert got == {1: ("found", "abcd12"), 2: ("found", "abcd34"), 3: ("too_short", None), 4: ("too_short", None), 5: ("too_short", None),
                   6: ("not_found", None), 7: ("not_found", None), 8: ("not_found", None), 9: ("not_found", None)}
    notes = {r.request_id: r.note for r in R.recall_answers(mem, req, 1_700_000_000).collect()}
    assert notes[1] is None and '"zzzz"' in notes[7] and "4 characters" in notes[3]


def test_prefixes_against_a_plain_search(spark):
    rng = random.Random(3)
    ids = sorted({"".join(rng.choice("abé\U0001f600") for _ in range(rng.randrange(4, 9))) for _ in range(3000)})
    prefixes = [i[:rng.randrange(4, 8)] for i in rng.sample(ids, 200)] + ["aaaaaaaaaaaa", "éééééééééé", "0000", "zzzz"]
    want = {p: next((i for i in ids if i.startswith(p)), None) for p in prefixes}
    df = spark.createDataFrame([(i,) for i in ids], "hash string").repartition(5)
    got = {r._p: r.hash for r in R.first_with_prefix(df, spark.createDataFrame([(p,) for p in set(prefixes)], "_p string")).collect()}
    assert got == {p: h for p, h in want.items() if h}
    assert R.first_with_prefix(df.limit(0), spark.createDataFrame([("abcd",)], "_p string")).collect() == []


def test_kmeans_keeps_sizes_apart(spark):
    from test_clusters_streams import model_kmeans
    rng = np.random.default_rng(1)
    items = [(f"{i:04d}", rng.normal(size=6 if i % 3 else 3).tolist(), ["t"]) for i in range(90)]
    df = spark.createDataFrame(items + [("x1", None, []), ("x2", [], [])], "hash string, vec array<double>, tags array<string>")
    got, cent, _ = K.lloyd_sizes(spark, df, 4)
    got = {r.hash: (r.size, r.cluster_id) for r in got.collect()}
    for d in (3, 6):
        own = [(h, v) for h, v, _ in items if len(v) == d]
        want = model_kmeans([h for h, _ in own], [v for _, v in own], 4)
        want = want[0] if isinstance(want, tuple) else want
        want = want if isinstance(want, dict) else dict(zip([h for h, _ in own], want, strict=True))
        assert {h: got[h] for h, _ in own} == {h: (d, int(want[h])) for h, _ in own}
    one, _, _ = K.lloyd(spark, df, 4)
    by_cluster = {}
    for r in one.collect():
        by_cluster.setdefault(r.cluster_id, set()).add(len(r.vec))
    assert all(len(s) == 1 for s in by_cluster.values()) and len(got) == 90
