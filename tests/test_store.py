"""The reference's store-level cases: candidate order, project filter, recall, touch,
keyword search, retention, statistics; plus upsert idempotence and gc partition."""

from __future__ import annotations

from pyspark.sql import functions as F

from conftest import memories_df, memory_row
from memlake.operators import candidates as C
from memlake.operators import changes as W
from memlake.operators import recall as R
from memlake.operators import search as S

NOW = 1_700_000_000


def test_importance_order(spark):
    m = memories_df(spark, [memory_row(hash="a" * 16, importance=5.0), memory_row(hash="b" * 16, importance=2.0),
                            memory_row(hash="c" * 16, importance=4.0)])
    assert [r["importance"] for r in C.top_candidates(m, 10).collect()] == [5.0, 4.0, 2.0]


def test_project_filter(spark):
    m = memories_df(spark, [memory_row(hash="a" * 16, project="alpha"), memory_row(hash="b" * 16, project="alpha"),
                            memory_row(hash="c" * 16, project="beta")])
    assert C.top_candidates(m, 10, project="alpha").count() == 2


def test_visibility_rules(spark):
    m = memories_df(spark, [
        memory_row(hash="p" * 16, sensitivity="public", project="x"),
        memory_row(hash="i" * 16, sensitivity="internal", project="x"),
        memory_row(hash="s" * 16, sensitivity="secret", owner_id="u1", project="x"),
        memory_row(hash="t" * 16, sensitivity="secret", owner_id="u2", project="y")])
    ids = lambda df: sorted(r["hash"][0] for r in df.collect())
    assert ids(C.top_candidates(m, 10)) == ["i", "p"]                       # legacy: no secrets
    assert ids(C.top_candidates(m, 10, owner="u1")) == ["p", "s"]           # internal needs a project
    assert ids(C.top_candidates(m, 10, project="x", owner="u1")) == ["i", "p", "s"]


def test_recall_hit_and_miss(spark):
    m = memories_df(spark, [memory_row(hash="abcdef1234567890", now=NOW - 3600)])
    req = spark.createDataFrame([(1, "ABCDEF"), (2, "zzzz99"), (3, "abc")], "request_id long, prefix string")
    got = {r["request_id"]: r for r in R.recall_by_prefix(m, req, NOW).collect()}
    assert got[1]["hash"] == "abcdef1234567890" and got[1]["access_count"] == 1 and got[1]["last_accessed"] == NOW
    assert 2 not in got and 3 not in got


def test_touch(spark):
    m = memories_df(spark, [memory_row(hash="t" * 16, last_accessed=NOW - 3600, access_count=0)])
    log = spark.createDataFrame([("t" * 16, NOW)], "hash string, ts bigint")
    r = W.touch_rollup(m, log).first()
    assert r["last_accessed"] == NOW and r["access_count"] == 1


def test_keyword_search(spark):
    m = memories_df(spark, [
        memory_row(hash="fts_1" + "0" * 11, summary_text="Authentication flow using JWT tokens", essence_text="JWT auth",
                   tags=["auth", "security"]),
        memory_row(hash="fts_2" + "0" * 11, summary_text="Database schema design for users", essence_text="DB schema",
                   tags=["database"])])
    q = spark.createDataFrame([(1, "JWT")], "query_id long, query string")
    hits = S.bm25_top(m, q, 20).orderBy("pos").collect()
    assert hits and hits[0]["hash"].startswith("fts_1")


def test_phrase_and_all_terms(spark):
    m = memories_df(spark, [memory_row(hash="a" * 16, summary_text="red apple pie", essence_text="", tags=[]),
                            memory_row(hash="b" * 16, summary_text="apple red pie", essence_text="", tags=[])])
    q = spark.createDataFrame([(1, "red-apple"), (2, "pie apple"), (3, "pie banana")], "query_id long, query string")
    got = {}
    for r in S.bm25_top(m, q, 20).collect():
        got.setdefault(r["query_id"], set()).add(r["hash"][0])
    assert got[1] == {"a"}            # a quoted token with punctuation is a phrase
    assert got[2] == {"a", "b"}       # every token must occur
    assert 3 not in got


def test_gc(spark):
    old = NOW - 60 * 24 * 3600
    m = memories_df(spark, [memory_row(hash="o1" + "0" * 14, importance=1.0, last_accessed=old),
                            memory_row(hash="o2" + "0" * 14, importance=2.0, last_accessed=old),
                            memory_row(hash="im" + "0" * 14, importance=4.0, last_accessed=old),
                            memory_row(hash="sv" + "0" * 14, importance=1.0, last_accessed=old, explicit_save=True)])
    removed = {r["hash"][:2] for r in W.gc_removed(m, NOW).collect()}
    kept = {r["hash"][:2] for r in W.gc_survivors(m, NOW).collect()}
    assert removed == {"o1", "o2"} and kept == {"im", "sv"}


def test_stats(spark):
    m = memories_df(spark, [memory_row(hash="s1" + "0" * 14, project="alpha", memory_type="decision"),
                            memory_row(hash="s2" + "0" * 14, project="alpha", memory_type="knowledge"),
                            memory_row(hash="s3" + "0" * 14, project="beta", memory_type="decision"),
                            memory_row(hash="s4" + "0" * 14, project=None, memory_type="decision")])
    assert C.stats_total(m).first()["total"] == 4
    bp = {r["project"]: r["n"] for r in C.stats_by_project(m).collect()}
    assert bp == {"alpha": 2, "beta": 1, "_untagged": 1}
    bt = {r["memory_type"]: r["n"] for r in C.stats_by_type(m).collect()}
    assert bt == {"decision": 3, "knowledge": 1}


def test_upsert_idempotent_and_latest(spark):
    old = memories_df(spark, [memory_row(hash="a" * 16, importance=1.0), memory_row(hash="b" * 16, importance=2.0)])
    chg = memories_df(spark, [memory_row(hash="a" * 16, importance=5.0), memory_row(hash="a" * 16, importance=4.0),
                              memory_row(hash="c" * 16, importance=3.0)])
    chg = chg.withColumn("arrival", F.when(F.col("importance") == 5.0, 1).otherwise(2).cast("bigint"))
    once = W.upsert(old, chg)
    twice = W.upsert(once, chg)
    a = {r["hash"][0]: r["importance"] for r in once.collect()}
    assert a == {"a": 4.0, "b": 2.0, "c": 3.0}
    assert sorted(once.collect()) == sorted(twice.collect())


def test_partial_update_sets_null(spark):
    old = memories_df(spark, [memory_row(hash="a" * 16, project="x"), memory_row(hash="b" * 16, project="y")])
    upd = spark.createDataFrame([("a" * 16, ["project"], None, 1), ("b" * 16, [], "z", 1)],
                                "hash string, set_cols array<string>, project string, arrival int")
    got = {r["hash"][0]: r["project"] for r in W.partial_update(old, upd).collect()}
    assert got == {"a": None, "b": "y"}


def test_robust_inputs_under_ansi(spark):
    """Malformed importance in a vault file and an empty allowed-project list do not fail."""
    from memlake.functions.visibility import scope_clamp
    from memlake.operators import records as RC
    files = spark.createDataFrame([("x.md", "---\nhash: abc\nimportance: high\ntags: []\n---\n\n## Summary\nS\n")],
                                  "path string, content string")
    r = RC.parse_vault(files).first()
    assert r["hash"] == "abc" and r["importance"] is None and r["summary_text"] == "S"
    req = spark.createDataFrame([("p", [])], "project string, allowed array<string>")
    assert req.select(scope_clamp("project", "allowed").alias("s")).first()["s"] is None


def test_fallback_to_fulltext_when_no_embedding(spark):
    from memlake.functions.embed import with_embedding
    m = memories_df(spark, [memory_row(hash="n" * 16, summary_text="kubernetes rollout notes", essence_text="",
                                       tags=[])])
    idx = S.build_index(m, vectors=True).withColumn("vec", F.lit(None).cast("array<double>"))
    q = spark.createDataFrame([(1, "kubernetes")], "query_id long, query string")
    qv = with_embedding(q, "query", out="vec").select("query_id", "vec")
    sem, fts = S.hybrid(spark, idx, q, qv)
    assert sem.count() == 0
    res = S.with_fallback(sem, fts).collect()
    assert [(r["hash"], r["source"]) for r in res] == [("n" * 16, "fulltext")]


def test_retention_partitions_input(spark):
    """gc survivors and removed rows are disjoint and together the whole table."""
    from conftest import SF_CHECK
    from memlake.sources import fixtures as FX
    m = FX.memories(spark, SF_CHECK)
    kept = {r["hash"] for r in W.gc_survivors(m, 1709251200).select("hash").collect()}
    gone = {r["hash"] for r in W.gc_removed(m, 1709251200).select("hash").collect()}
    allh = {r["hash"] for r in m.select("hash").collect()}
    assert kept.isdisjoint(gone) and kept | gone == allh and gone


def test_kernel_visibility_mask_matches_predicate(spark):
    """The numpy mask used inside the vector kernel equals the Column predicate."""
    import random
    import numpy as np
    from memlake.functions.visibility import visible
    import pandas as pd
    from memlake.operators.search import _visible_matrix
    rnd = random.Random(2)
    sens = ["public", "internal", "secret"]
    rows = [(i, rnd.choice(sens), rnd.choice(["p1", "p2", None]), rnd.choice(["u1", "u2"])) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, sensitivity string, project string, owner_id string")
    mem = pd.DataFrame(rows, columns=["id", "sensitivity", "project", "owner_id"], dtype=object)
    asks = [(qp, qo) for qp in ("p1", "p2", None, "") for qo in ("u1", "u2", None, "")]
    mask = _visible_matrix(mem, pd.DataFrame(asks, columns=["scope_project", "owner"], dtype=object))
    for (qp, qo), row in zip(asks, mask):
        got = {r["id"] for r in df.filter(visible(qp, qo)).collect()}
        assert {rows[i][0] for i in np.nonzero(row)[0]} == got, (qp, qo)


def test_vector_topk_batches_equal_single(spark):
    """Splitting the query set into bounded broadcast batches gives the same answer."""
    from conftest import SF_SMALL
    from memlake.functions.embed import with_embedding
    from memlake.sources import fixtures as FX
    idx = S.build_index(FX.memories(spark, SF_SMALL), vectors=True).select("hash", "vec")
    q = FX.search_requests(spark, SF_SMALL)
    qv = with_embedding(q, "query", out="vec").select("query_id", "vec")
    one = sorted(S.vector_topk(spark, idx, qv, k=5).select("query_id", "hash", "rank").collect())
    many = sorted(S.vector_topk(spark, idx, qv, k=5, query_block=7, memory_block=3).select("query_id", "hash", "rank").collect())
    assert one == many and len(one) > 0


def test_vault_round_trip_fields(spark):
    """Export then parse gives back the stored fields (texts without '## ' headings)."""
    from memlake.operators import records as RC
    rows = [memory_row(hash="0123456789abcdef", importance=4.0, tags=["a b", "c"], project=None,
                       context_log="why\nwe did it", created_at=1709251200, last_accessed=1709254800,
                       access_count=3, memory_type="decision", sensitivity="internal"),
            memory_row(hash="1e23456789012345", tags=[], project="p-1")]
    m = memories_df(spark, rows)
    files = RC.vault_markdown(m).select("path", "content")
    got = {r["hash"]: r for r in RC.parse_vault(files).collect()}
    for src in rows:
        r = got[src["hash"]]
        for f in ("importance", "memory_type", "sensitivity", "project", "session_id", "created_at",
                  "last_accessed", "access_count", "tags", "summary_text", "full_text", "context_log"):
            assert r[f] == src[f], (f, r[f], src[f])


def test_vault_round_trip_with_headings(spark):
    """Texts containing '## ' lines (and already-escaped ones) survive export + import, and
    the SQL oracle's escape agrees with the Spark one."""
    import duckdb
    from memlake.operators import records as RC
    from memlake.plans.record_queries import _esc, _unesc
    full = "intro\n## Summary\nfake heading\n\\## kept as typed\n## Context Log\nnot the log"
    rows = [memory_row(hash="fedcba9876543210", full_text=full, summary_text="## s1\nline",
                       context_log="## step 1\nok")]
    m = memories_df(spark, rows)
    r = RC.parse_vault(RC.vault_markdown(m).select("path", "content")).first()
    assert (r["full_text"], r["summary_text"], r["context_log"]) == (full, "## s1\nline", "## step 1\nok")
    samples = [full, "## a", "\\\\## b", "x\n\\## c", "no heading"]
    sp = spark.createDataFrame([(t,) for t in samples], "t string")
    got = [x["e"] for x in sp.select(RC.escape_headings(F.col("t")).alias("e")).collect()]
    con = duckdb.connect()
    for t, e in zip(samples, got):
        assert con.execute(f"SELECT {_esc('?')}", [t]).fetchall()[0][0] == e
        assert con.execute(f"SELECT {_unesc('?')}", [e]).fetchall()[0][0] == t
