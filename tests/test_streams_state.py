"""Streams that go on where they ended: touched buckets only, replayed batches, late rows."""

from __future__ import annotations

import os

from conftest import SF_SMALL

from memlake.operators import records as RC
from memlake.sources import fixtures as FX
from memlake.streaming import jobs as J


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_touch_state_is_one_row_per_memory_and_rewrites_few_files(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    rows = [(f"h{i:03d}", 100 + i) for i in range(300)]
    ddl = "hash string, ts long"

    def stream():
        return spark.readStream.schema(ddl).parquet(src)
    spark.createDataFrame(rows, ddl).write.parquet(src)
    J.run_access_rollup(spark, stream(), out)
    before = files(f"{out}/touch_state")
    spark.createDataFrame([("h001", 900), ("h001", 50), ("new", 7)], ddl).write.mode("append").parquet(src)
    J.run_access_rollup(spark, stream(), out)  # a new run of the same stream
    after = files(f"{out}/touch_state")
    assert len(before - after) <= 2 and len(after - before) <= 2
    got = {r.hash: (r.last_touch, r.touches) for r in J.touch_state(spark, out).collect()}
    want = {h: (t, 1) for h, t in rows} | {"h001": (900, 3), "new": (7, 1)}
    assert got == want and J.touch_state(spark, out).count() == len(want)


def test_snapshot_feed_goes_on_and_keeps_untouched_files(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    stored = FX.stored_snapshots(spark, SF_SMALL)
    arrivals = FX.snapshot_arrivals(spark, SF_SMALL)
    arrivals.coalesce(1).write.parquet(src)

    def stream():
        return spark.readStream.schema(arrivals.schema).parquet(src)
    J.run_snapshot_feed(spark, stream(), stored, 1_800_000_000, out)
    before = files(f"{out}/table")
    one = arrivals.limit(1).withColumn("file_hash", FX.F.lit("edited again"))
    one = J.materialize(one, "one_arrival")
    one.write.mode("append").parquet(src)
    J.run_snapshot_feed(spark, stream(), stored, 1_800_000_100, out)
    after = files(f"{out}/table")
    assert len(before - after) == 1 == len(after - before)
    want = RC.snapshot_upsert(J.materialize(RC.snapshot_upsert(stored, arrivals, 1_800_000_000), "first"), one, 1_800_000_100)
    cols = want.columns
    assert sorted(map(tuple, J.snapshot_state(spark, out).select(cols).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    last = spark.read.parquet(f"{out}/changes").filter("batch_id = 1").collect()
    assert [r.status for r in last] == ["changed"]


def test_late_rows_are_kept_apart(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    ddl = "key string, ts long"

    def send(rows):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(src)
        J.run_windows(spark, spark.readStream.schema(ddl).parquet(src), 10, 20, out)
    send([("a", 100), ("a", 3), ("b", 105), ("a", None)])
    assert [(r.key, r.ts) for r in J.late_rows(spark, out).collect()] == [("a", None)]
    send([("a", 85), ("a", 84), ("b", 205)])
    send([("a", 184), ("a", 185), ("b", 300)])
    assert sorted((r.start, r.key, r.n) for r in J.window_counts(spark, out).collect()) == [
        (0, "a", 1), (80, "a", 1), (100, "a", 1), (100, "b", 1), (180, "a", 1), (200, "b", 1), (300, "b", 1)]
    assert sorted((r.key, r.ts, r.batch_id) for r in J.late_rows(spark, out).collect() if r.ts) == [("a", 84, 1), ("a", 184, 2)]


def folder_tables(spark, root):
    """documents and pages as folders of several files, as a cluster writes them."""
    docs = [(i, f"line one {i}\n" + f"word{i % 3} text\n" * 40, "en", f"src{i % 2}", 9) for i in range(12)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{root}/documents.parquet")
    pages = [(i, f"https://h{i}.example.com/{i}", f"<title>t{i}</title>") for i in range(20)]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3).write.parquet(f"{root}/pages.parquet")
    return str(root)


def test_ingest_stream_reads_a_folder_table(spark, queries, tmp_path):
    sf = folder_tables(spark, tmp_path)
    got, want = ([tuple(r) for r in queries[0][n](spark, sf).collect()] for n in ("stream_ingest", "ingest_documents"))
    assert sorted(got) == sorted(want) and len(got) >= 12


def test_snapshot_feed_reads_a_folder_table(spark, queries, tmp_path):
    sf = folder_tables(spark, tmp_path)
    got, want = ([tuple(r) for r in queries[0][n](spark, sf).collect()] for n in ("stream_snapshot_changes", "snapshot_change_detection"))
    assert sorted(got) == sorted(want) and len(got) >= 4
