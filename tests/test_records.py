"""Hand-made cases for snapshots, renames, sessions and usage counters."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from conftest import memories_df, memory_row
from memlake.operators import changes as W
from memlake.operators import records as RC

NOW = 1_700_000_000
SNAP = ("hash string, path string, project string, summary string, essence string, size_bytes long, "
        "file_hash string, captured_at long, last_seen long")
ARR = "path string, project string, summary string, essence string, size_bytes long, file_hash string"


def test_snapshot_statuses(spark):
    stored = spark.createDataFrame([("h" * 16, "/a", "p", "old sum", "old ess", 10, "X", 1, 1),
                                    ("g" * 16, "/b", "p", "b sum", "b ess", 10, "Y", 1, 1)], SNAP)
    arr = spark.createDataFrame([("/a", None, "new sum", "new ess", 11, "X"),
                                 ("/b", "q", "changed", "ch", 12, "Z"),
                                 ("/c", "p", "c sum", "c ess", 5, "W")], ARR)
    got = {r["path"]: r for r in RC.snapshot_changes(stored, arr, NOW).collect()}
    assert got["/a"]["status"] == "cached" and got["/a"]["summary"] == "old sum" and got["/a"]["hash"] == "h" * 16
    assert got["/b"]["status"] == "changed" and got["/b"]["summary"] == "changed" and got["/b"]["hash"] == "g" * 16
    assert got["/c"]["status"] == "new" and len(got["/c"]["hash"]) == 16
    table = {r["path"]: r for r in RC.snapshot_upsert(stored, arr, NOW).collect()}
    assert table["/b"]["project"] == "p" and table["/b"]["captured_at"] == 1 and table["/b"]["last_seen"] == NOW
    assert table["/c"]["captured_at"] == NOW and table["/a"]["file_hash"] == "X"


def test_rename_untagged_and_merge(spark):
    m = memories_df(spark, [memory_row(hash="a" * 16, project=None), memory_row(hash="b" * 16, project="src3"),
                            memory_row(hash="c" * 16, project="keep")])
    rmap = spark.createDataFrame([("_untagged", "inbox"), ("src3", "src2")], "old_project string, new_project string")
    got = {r["hash"][0]: (r["project"], r["renamed"]) for r in W.rename_projects(m, rmap).collect()}
    assert got == {"a": ("inbox", True), "b": ("src2", True), "c": ("keep", False)}


def test_session_token_estimate_matches_json_model(spark):
    turns = [(1, 0, "user", 'hi "there"\nline', "t", None, "p", NOW),
             (1, 1, "assistant", "tab\there \\ back ümlaut", "t", None, "p", NOW),
             (1, 2, "system", "ctl\x01", "t", None, "p", NOW)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, content string, title string, "
                                      "memory_hash string, project string, logged_at long")
    r = RC.session_rollup(df).first()
    js = json.dumps([{"role": t[2], "content": t[3]} for t in turns], ensure_ascii=False, separators=(",", ":"))
    assert r["turns_json_len"] == len(js)
    assert r["token_count"] == int(len(js) / 4 + 0.5) and r["turns_count"] == 3


def test_embed_usage_counts(spark):
    rows = [("2024-01-01 00:00:00", "remote", 10), ("2024-01-02 00:00:00", "remote", 7),
            ("2024-01-03 00:00:00", "fallback", 99)]
    calls = spark.createDataFrame(rows, "ts string, kind string, chars long").withColumn("ts", F.to_timestamp("ts"))
    r = RC.embed_usage(calls).first()
    assert (r["remote_calls"], r["remote_chars"], r["tokens_est"], r["fallback_calls"]) == (2, 17, 4, 1)
    assert r["last_call_at"] == "2024-01-02T00:00:00.000Z"


def test_context_downgrade_and_stop(spark):
    from memlake.operators import context as X
    big = "x" * 500
    rows = [memory_row(hash="a" * 16, importance=5.0, full_text=big, summary_text="s" * 50, now=NOW, project="p"),
            memory_row(hash="b" * 16, importance=4.0, full_text=big, summary_text="t" * 400, essence_text="e" * 30,
                       now=NOW, project="p"),
            memory_row(hash="c" * 16, importance=3.0, full_text=big, summary_text="u" * 400, essence_text="f" * 400,
                       now=NOW, project="p")]
    items = X.packed_items(memories_df(spark, rows), NOW, budget=700).orderBy("pos").collect()
    # a: hot block (~540 chars) fits; b: hot and warm too long, cool fits; c: nothing fits -> stop
    assert [(r["hash"][0], r["tier"]) for r in items] == [("a", "hot"), ("b", "cool")]
    assert sum(r["block_len"] for r in items) <= 700


def test_recall_respects_visibility(spark):
    from memlake.operators import recall as R
    m = memories_df(spark, [memory_row(hash="abcd000000000000", sensitivity="secret", owner_id="u1"),
                            memory_row(hash="abce000000000000", sensitivity="public")])
    req = spark.createDataFrame([(1, "abcd"), (2, "abce")], "request_id long, prefix string")
    assert {r["request_id"] for r in R.recall_by_prefix(m, req, NOW).collect()} == {2}
    assert {r["request_id"] for r in R.recall_by_prefix(m, req, NOW, owner="u1").collect()} == {1, 2}


def test_visible_counts_match_brute_force(spark):
    import random
    from memlake.functions.visibility import visible
    from memlake.operators import recall as R
    rnd = random.Random(9)
    rows = [memory_row(hash=f"{i:016x}", sensitivity=rnd.choice(["public", "internal", "secret"]),
                       project=rnd.choice(["p1", "p2", None]), owner_id=rnd.choice(["u1", "u2"]),
                       importance=float(rnd.randint(1, 5))) for i in range(80)]
    m = memories_df(spark, rows)
    reqs = [(i, p, o) for i, (p, o) in enumerate([(p, o) for p in ("p1", "p2", None) for o in ("u1", "u2", None)])]
    rq = spark.createDataFrame(reqs, "request_id long, project string, owner string")
    got = {r["request_id"]: (r["n_visible"], r["importance_sum"]) for r in R.visible_counts(rq, m).collect()}
    for i, p, o in reqs:
        v = m.filter(visible(p, o)).agg(F.count("*").alias("n"), F.sum("importance").alias("s")).first()
        assert got[i] == (v["n"], v["s"] or 0.0), (p, o)


def test_duplicate_arrivals_collapse(spark):
    stored = spark.createDataFrame([("h" * 16, "/a", "p", "s", "e", 10, "X", 1, 1)], SNAP)
    arr = spark.createDataFrame([("/a", None, "v1", "e1", 11, "Y"), ("/a", None, "v2", "e2", 12, "Z"),
                                 ("/n", "p", "n1", "n", 1, "A"), ("/n", "p", "n2", "n", 1, "B")], ARR)
    table = RC.snapshot_upsert(stored, arr, NOW).collect()
    assert sorted(r["path"] for r in table) == ["/a", "/n"]
    got = {r["path"]: r for r in table}
    assert got["/a"]["file_hash"] == "Z" and got["/a"]["summary"] == "v2" and got["/n"]["file_hash"] == "B"


def test_rename_map_with_repeated_key(spark):
    m = memories_df(spark, [memory_row(hash="a" * 16, project="old")])
    rmap = spark.createDataFrame([("old", "n1"), ("old", "n2")], "old_project string, new_project string")
    out = W.rename_projects(m, rmap).collect()
    assert len(out) == 1 and out[0]["project"] == "n2"


def test_attach_embeddings_one_vector_per_memory(spark):
    m = memories_df(spark, [memory_row(hash="a" * 16), memory_row(hash="b" * 16)])
    v = spark.createDataFrame([("a" * 16, [1.0, 0.0], 1), ("a" * 16, [0.0, 1.0], 2)],
                              "hash string, embedding array<double>, arrival int")
    got = {r["hash"][0]: r["embedding"] for r in W.attach_embeddings(m, v).collect()}
    assert got == {"a": [0.0, 1.0], "b": None}


# ---------------------------------------------------------------- vault texts, orders, feeds


HARD_TEXTS = ["plain", "note\n## Full Detail\nquoted", "see ## Full Detail\nmid line", "## Summary\nfake\n## Context Log\n_x_\n\ny",
              "\\## Links\n\\\\## Summary", "a: b\n- dash\n\"quoted\" 'single'", "tail\n## ", "# one\n### three", "tabs\tand \\n"]


def test_vault_round_trip_of_hard_texts(spark):
    """Export then import gives the same trimmed texts, tags and scalars, whatever headings or marks they hold."""
    import itertools
    from memlake.operators import records as RC
    rows = []
    tags = [["a: b", "- dash", "c#"], ['"quoted"', "it's", "back\\slash"], ["true", "12", "plain tag"], [], ["x, y", "[z]", "{w}"]]
    for i, (s, f, e) in enumerate(itertools.product(HARD_TEXTS, HARD_TEXTS, HARD_TEXTS[:4])):
        rows.append(memory_row(hash=f"{i:016x}", summary_text=s, full_text=f, essence_text=e, tags=tags[i % 5],
                               project=["p: q", "none of it", "'single'", None][i % 4], session_id=["s", "a\nb", "#c", "0x1"][i % 4],
                               context_log=[None, HARD_TEXTS[i % 9]][i % 2]))
    files = RC.vault_markdown(memories_df(spark, rows)).select("path", "content")
    got = {r["hash"]: r for r in RC.parse_vault(files).collect()}
    for r in rows:
        g = got[r["hash"]]
        assert (g.summary_text, g.full_text, g.tags) == (r["summary_text"].strip(), r["full_text"].strip(), r["tags"]), r
        assert (g.project, g.session_id) == (r["project"], r["session_id"])
        assert g.context_log == (r["context_log"].strip() if r["context_log"] else None)


def test_vault_front_matter_as_people_write_it(spark):
    from memlake.operators import records as RC
    head = "---\nhash: 0123456789abcdef\n{}\n---\n\n# t\n\n## Summary\ns\n\n## Full Detail\nf\n"
    cases = {"tags: [one, two]": ["one", "two"], "tags: [\"a, b\", 'it''s', c]": ["a, b", "it's", "c"], "tags:\n- x\n- 'y z'": ["x", "y z"],
             "tags: []": [], "project: 'single'": [], "tags: scalar": None}
    files = spark.createDataFrame([(str(i), head.format(k)) for i, k in enumerate(cases)], "path string, content string")
    got = {r.path: r for r in RC.parse_vault(files).collect()}
    for i, want in enumerate(cases.values()):
        assert got[str(i)].tags == want
    assert got["4"].project == "single"
    stored = memories_df(spark, [memory_row(hash="0123456789abcdef", tags=["kept"])])
    merged = RC.vault_merge(stored, RC.parse_vault(files.filter("path = '5'"))).first()
    assert merged.tags == ["kept"] and merged.full_text == "f"


def test_null_and_equal_orders(spark):
    from memlake.operators import changes as W
    from memlake.operators import records as RC
    old = spark.createDataFrame([("k1", 1.0), ("k2", 2.0)], "hash string, v double")
    new = spark.createDataFrame([("k1", 5.0, None), ("k3", 3.0, 7), ("k3", 4.0, 7), ("k2", 8.0, None), ("k2", 9.0, 1)],
                                "hash string, v double, arrival bigint")
    runs = [sorted(map(tuple, W.upsert(old, new.repartition(n)).collect())) for n in (1, 5)]
    assert runs[0] == runs[1]
    got = dict(runs[0])
    assert got["k1"] == 5.0 and got["k2"] == 9.0 and got["k3"] in (3.0, 4.0)
    upd = spark.createDataFrame([("k1", ["v"], 6.0, None)], "hash string, set_cols array<string>, v double, arrival bigint")
    assert dict(map(tuple, W.partial_update(old, upd).collect())) == {"k1": 6.0, "k2": 2.0}
    one = RC.one_arrival_per_path(spark.createDataFrame([("p", None, 5)], "path string, file_hash string, size_bytes bigint")).first()
    assert (one.path, one.file_hash, one.size_bytes) == ("p", None, 5)


def test_snapshot_feed_advances_and_resumes(spark, tmp_path):
    from memlake.operators import records as RC
    from memlake.streaming import jobs as J
    ddl = "path string, project string, summary string, essence string, size_bytes bigint, file_hash string"
    stored = spark.createDataFrame([], "hash string, " + ddl + ", captured_at bigint, last_seen bigint").select(*RC.SNAPSHOT_COLUMNS)
    feed, out = str(tmp_path / "in"), str(tmp_path / "out")

    def arrive(*rows):
        spark.createDataFrame([(p, "x", "s", "e", 1, h) for p, h in rows], ddl).coalesce(1).write.mode("append").parquet(feed)
        stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(feed)
        J.run_snapshot_feed(spark, stream, stored, 1_700_000_000, out)
        return sorted((r.batch_id, r.path, r.status) for r in spark.read.parquet(f"{out}/changes").collect())
    assert arrive(("a", "1"), ("b", "1")) == [(0, "a", "new"), (0, "b", "new")]
    assert arrive(("a", "1"), ("b", "2")) == [(0, "a", "new"), (0, "b", "new"), (1, "a", "cached"), (1, "b", "changed")]
    assert arrive(("b", "2"), ("c", None))[4:] == [(2, "b", "cached"), (2, "c", "new")]
    assert arrive(("c", None))[-1][:2] == (3, "c")


def test_empty_requester_fields_ask_for_nothing(spark):
    from pyspark.sql import functions as F
    from memlake.functions.visibility import scope_clamp, visible
    rows = spark.createDataFrame([("public", "p", "u"), ("internal", "p", "u"), ("secret", "p", "u")], "sensitivity string, project string, owner_id string")
    for p in ("", None, "p"):
        for o in ("", None, "u"):
            a = rows.filter(visible(p, o)).count()
            assert a == rows.filter(visible(F.lit(p).cast("string"), F.lit(o).cast("string"))).count(), (p, o)
    req = spark.createDataFrame([("", ["x"]), ("", None), ("x", ["x"])], "project string, allowed array<string>")
    assert [r[0] for r in req.select(scope_clamp()).collect()] == ["x", None, "x"]


def test_file_paths_are_as_named(spark, tmp_path):
    from memlake.sources import files as S
    for name in ("My Notes.md", "a+b%20c.md", "ü/x.txt", "no.pdf"):
        f = tmp_path / name
        f.parent.mkdir(exist_ok=True)
        f.write_text("x")
    assert {r.path for r in S.read_documents(spark, str(tmp_path)).collect()} == {"/My Notes.md", "/a+b%20c.md", "/ü/x.txt"}
    assert [r.path for r in S.document_rejects(spark, str(tmp_path)).collect()] == ["/no.pdf"]


def test_search_finds_words_deep_in_a_text(spark):
    from memlake.operators import search as S
    deep = "start " + "filler " * 400 + "needle"
    m = memories_df(spark, [memory_row(hash="a" * 16, summary_text=deep), memory_row(hash="b" * 16)])
    q = spark.createDataFrame([(1, "needle"), (2, "needle missing"), (3, "needle needle")], "query_id long, query string")
    hits = S.bm25_top(m, q, 5).collect()
    assert [(r.query_id, r.hash[0]) for r in sorted(hits)] == [(1, "a"), (3, "a")]


def test_bm25_reads_the_index_three_times(spark, monkeypatch):
    """The index is a written table; its scans are counted over all plans of one call."""
    from memlake.operators import search as S
    m = memories_df(spark, [memory_row(hash=f"{i:016x}", summary_text=f"word{i} common text") for i in range(50)])
    index = S.build_index(m)
    name = index.inputFiles()[0].rsplit("/", 2)[-2]
    reads = []
    real = S._materialize
    monkeypatch.setattr(S, "_materialize", lambda df, n: (reads.append(_scans(df, name)), real(df, n))[1])
    q = spark.createDataFrame([(i, f"word{i} common") for i in range(20)], "query_id long, query string")
    out = S.bm25_top(index, q, 5)
    assert sum(reads) + _scans(out, name) + 1 <= 3  # one more for the size and mean length
    assert len(out.collect()) == 20


def test_phrases_of_one_and_of_several_terms_are_found_in_one_read(spark):
    from memlake.operators import search as S
    m = memories_df(spark, [memory_row(hash="a" * 16, summary_text="red-hot red hot hot", essence_text="hot", tags=["red"]),
                            memory_row(hash="b" * 16, summary_text="hot red", essence_text="hot", tags=[])])
    index = S.build_index(m)
    found = S.phrase_frequencies(index, spark.createDataFrame([("hot",), ("red hot",), ("hot red",), ("hot hot",)], "phrase string"))
    assert _scans(found, index.inputFiles()[0].rsplit("/", 2)[-2]) == 1
    assert sorted((r.hash[0], r.phrase, r.f) for r in found.collect()) == [
        ("a", "hot", 4), ("a", "hot hot", 1), ("a", "hot red", 1), ("a", "red hot", 2), ("b", "hot", 2), ("b", "hot red", 1)]


def _scans(df, name):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("FileScan" in line and name in line for line in plan.split("\n"))
