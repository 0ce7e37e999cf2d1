"""The kept full-text index: same answers as an index built anew, after every kind of change, with fewer blocks opened."""

from __future__ import annotations

import os
import random

import pytest
from conftest import memories_df, memory_row

from memlake.operators import search as S
from memlake.operators import text_index as T
from pyspark.sql import functions as F


def rows(seed, n, start=0):
    rng = random.Random(seed)
    words = ["the"] * 30 + [f"w{i}" for i in range(40)] + ["foo-bar", "foo", "bar", "É", "x1"]
    out = []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))
        out.append(memory_row(hash=f"{start + i:05x}{rng.randrange(16 ** 6):06x}", summary_text=text if rng.random() < .9 else None,
                              essence_text=rng.choice([None, "", "the essence w1"]), tags=rng.choice([[], ["w2", "tag"], None, ["foo", "bar"]]),
                              sensitivity=rng.choice(["public", "internal", "secret"]), project=rng.choice(["p", "q", None]),
                              owner_id=rng.choice(["a", "b"])))
    return out


def queries(spark):
    texts = ["the", "w1", "the w1", "w2 w3 the", "foo-bar", "foo bar", "bar-foo the", "nothing", "the nothing", "", "  ", "w1 w1 w4", "É", "the foo-bar w5", "tag"]
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def answer(df):
    return sorted((r.query_id, r.hash, round(r.score, 6), r.pos) for r in df.collect())


def rebuilt(spark, mem_rows, limit, **kw):
    return answer(S.bm25_top(S.build_index(memories_df(spark, mem_rows)), queries(spark), limit, **kw))


@pytest.fixture(scope="module")
def base(spark):
    data = rows(1, 300)
    return data, T.create_index(memories_df(spark, data), buckets=8, range_docs=20)


@pytest.mark.parametrize("who", [{}, {"owner": "a"}, {"owner": "a", "project": "p"}, {"project": "q"}])
def test_same_answers_as_rebuilt(spark, base, who):
    data, index = base
    want = rebuilt(spark, data, 5, **who)
    assert answer(T.search_top(index, queries(spark), 5, **who)) == want and len(want) > 20
    assert answer(T.search_top(index, queries(spark), 5, prune=False, **who)) == want


def test_scoped_callers(spark, base):
    data, index = base
    scope = spark.createDataFrame([(i, ["p", None][i % 2], ["a", None, "b"][i % 3]) for i in range(15)], "query_id long, scope_project string, owner string")
    assert answer(T.search_top(index, queries(spark), 4, scope=scope)) == rebuilt(spark, data, 4, scope=scope)


def test_null_fields_are_found(spark):
    data = [memory_row(hash="a", summary_text="apple"), memory_row(hash="b", summary_text="apple", tags=None),
            memory_row(hash="c", summary_text="apple", essence_text=None), memory_row(hash="d", summary_text=None, essence_text="pear")]
    q = spark.createDataFrame([(1, "apple")], "query_id long, query string")
    mem = memories_df(spark, data)
    for hits in (T.search_top(T.create_index(mem), q, 9), S.bm25_top(S.build_index(mem), q, 9)):
        assert {r.hash for r in hits.collect()} == {"a", "b", "c"}


def test_changes_match_a_rebuilt_index(spark):
    data = {r["hash"]: r for r in rows(2, 200)}
    index = T.create_index(memories_df(spark, list(data.values())), buckets=4, range_docs=30)
    rng = random.Random(5)
    for step in range(3):
        ids = sorted(data)
        replaced = [dict(r, hash=h) for r, h in zip(rows(10 + step, 20), rng.sample(ids, 20), strict=True)]
        fresh = rows(20 + step, 15, start=1000 * (step + 1))
        gone = rng.sample(ids, 10)
        changed = [r for r in replaced + fresh if r["hash"] not in gone]
        index = T.apply_changes(index, memories_df(spark, changed), spark.createDataFrame([(g,) for g in [*gone, "unknown"]], "hash string"))
        data.update((r["hash"], r) for r in changed)
        for g in gone:
            data.pop(g, None)
    want = rebuilt(spark, list(data.values()), 6)
    assert index.n_docs == len(data) and len(index.segments) == 4
    assert answer(T.search_top(index, queries(spark), 6)) == want
    assert answer(T.search_top(T.open_index(spark, *index.paths), queries(spark), 6)) == want
    aside = T.apply_changes(index, memories_df(spark, rows(30, 5, start=9000)), path=f"{index.paths[0]}-aside")
    assert aside.n_docs == len(data) + 5 and T.open_index(spark, *index.paths).n_docs == len(data)
    small = T.compact(index)
    assert len(small.segments) == 1 and answer(T.search_top(small, queries(spark), 6)) == want
    only_deletes = T.apply_changes(small, deleted=spark.createDataFrame([(h,) for h in data], "hash string"))
    assert only_deletes.n_docs == 0 and answer(T.search_top(only_deletes, queries(spark), 6)) == []


def test_only_the_buckets_of_the_terms_are_read(spark, base):
    _, index = base
    term = spark.createDataFrame([("w1",)], "term string")
    one = index.in_buckets("postings", term)
    folders = {r[0] for r in one.select("bucket").distinct().collect()}
    assert len(folders) == 1
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1]
    read = sum(1 for _ in one.select(F.col("_metadata.file_path")).distinct().collect())
    every = sum(1 for _ in index.part("postings").select(F.col("_metadata.file_path")).distinct().collect())
    assert read * 4 <= every


def test_bounds_open_fewer_blocks_for_the_same_answer(spark):
    rng = random.Random(7)
    data = []
    for i in range(2000):  # a common word, strong in few rows
        n = 200 if i % 10 else 6
        data.append(memory_row(hash=f"{rng.randrange(16 ** 12):012x}", summary_text=" ".join(["apple"] * (5 if i % 100 == 0 else 1) + ["pad"] * n), tags=[]))
    index = T.create_index(memories_df(spark, data), range_docs=10)
    q = spark.createDataFrame([(1, "apple"), (2, "apple pad")], "query_id long, query string")
    prepared = T.prepare(index, q.where("query_id = 1"))
    first, rest, _ = T.two_steps(prepared, 5, first_ranges=8)
    entries = lambda ranges: T.opened(prepared, ranges).agg(F.sum("n")).first()[0] or 0
    assert entries(first.select("query_id", "rng").unionByName(rest.select("query_id", "rng"))) < 0.5 * entries(prepared.ranges)
    assert answer(T.search_top(index, q, 5)) == answer(T.search_top(index, q, 5, prune=False)) == answer(
        S.bm25_top(S.build_index(memories_df(spark, data)), q, 5))


def test_kept_index_is_built_once_per_state(spark, tmp_path):
    data = memories_df(spark, rows(3, 20))
    a = T.kept_index(spark, data, f"state-{tmp_path.name}-1")
    b = T.kept_index(spark, data, f"state-{tmp_path.name}-1")
    c = T.kept_index(spark, data.limit(5), f"state-{tmp_path.name}-2")
    assert a.paths == b.paths != c.paths and a.n_docs == 20 and c.n_docs == 5
    folder = f"{tmp_path}/t"
    data.select("hash").write.parquet(folder)
    before = T.table_state(spark, folder)
    assert before == T.table_state(spark, folder)
    data.select("hash").write.mode("append").parquet(folder)
    assert before != T.table_state(spark, folder)


def test_empty_table(spark):
    index = T.create_index(memories_df(spark, []))
    assert answer(T.search_top(index, queries(spark), 3)) == []


def written(folder):
    return set(os.listdir(f"{folder.removeprefix('file:')}/tables"))


def test_scoring_shuffles_blocks_not_entries(spark, base):
    _, index = base
    prepared = T.prepare(index, queries(spark))
    plan = T.score(prepared, prepared.ranges)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "explode" not in plan


def test_changes_do_not_shuffle_the_terms_of_the_index(spark, base):
    """The terms of a memory are written once, and only those of lost memories are read again."""
    _, index = base
    folder = spark.conf.get("spark.checkpoint.dir", None) or T.ensure_checkpoint_dir(spark)
    before = written(folder)
    T.apply_changes(index, memories_df(spark, rows(40, 5, start=7000)), path=f"{index.paths[0]}-terms-once")
    new = {n.rsplit("-", 1)[0] for n in written(folder) - before}
    assert "index_gone" in new and "index_terms" not in new
    assert "entries" in index.part("docs").columns


def test_hybrid_over_the_kept_index_equals_hybrid_over_a_rebuilt_one(spark, base):
    data, index = base
    mem, q = memories_df(spark, data), queries(spark)
    own = S.build_index(mem, vectors=True)
    qvec = S.with_embedding(q, "query", out="vec").select("query_id", "vec")
    kept, fts = S.hybrid(spark, own, q, qvec, limit=3, fulltext=lambda n: T.search_top(index, q, n))
    want, _ = S.hybrid(spark, own, q, qvec, limit=3)
    pick = lambda df: sorted((r.query_id, r.hash, r["rank"]) for r in df.collect())
    assert pick(kept) == pick(want) and fts.count() > 10


def test_rebuilt_search_keeps_the_phrases_of_a_memory_in_one_row(spark, monkeypatch):
    """No entry (phrase, memory) is shuffled once more to be paired with a query: what is written has a row per memory."""
    seen, write = {}, S._materialize

    def spy(df, name):
        seen[name] = write(df, name)
        return seen[name]
    monkeypatch.setattr(S, "_materialize", spy)
    data = [memory_row(hash=f"h{i}", summary_text="apple pear foo-bar plum" if i % 2 else "apple pear") for i in range(40)]
    q = spark.createDataFrame([(1, "apple pear"), (2, "foo-bar apple"), (3, "apple nothing"), (4, "plum pear apple")], "query_id long, query string")
    got = S.bm25_top(S.build_index(memories_df(spark, data)), q, 50).collect()
    assert seen["phrase_frequencies"].count() == 40
    assert {i: sum(r.query_id == i for r in got) for i in (1, 2, 3, 4)} == {1: 40, 2: 20, 3: 0, 4: 20}
