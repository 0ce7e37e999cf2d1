"""Registered queries: the streaming jobs, run to completion (availableNow) over the tables.

Each returns the table its stream produced and is checked with the oracle of its batch
counterpart: a stream must give exactly the batch answer.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.config import NOW
from memlake.plans.common import ORACLE, register
from memlake.sources import fixtures as FX
from memlake.sources.tables import read_table
from memlake.streaming import jobs as J


@register("stream_touch_rollup")
def q_stream_touch_rollup(spark, sf):
    """ST1: events stream -> per-memory touch state -> memories with touches applied."""
    n_docs = read_table(spark, sf, "documents").count()
    ids = FX.memories_with_doc(spark, sf).select("doc_id", "hash")
    ev = J.table_stream(spark, sf, "events")
    accesses = (ev.select((F.col("event_id") % n_docs).alias("doc_id"),
                          F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"))
                .join(ids, "doc_id").select("hash", "ts"))
    out = J.run_access_rollup(spark, accesses)
    t = J.apply_touch_state(FX.memories(spark, sf), J.touch_state(spark, out))
    return t.select("hash", "last_accessed", "access_count")


@register("stream_ingest")
def q_stream_ingest(spark, sf):
    """ST2: document stream -> chunk, id, summarise, embed -> ingested table."""
    files = FX.documents_as_files(J.table_stream(spark, sf, "documents"))
    out = J.run_ingest(spark, files, NOW, 500, r"\n+")
    rows = spark.read.parquet(f"{out}/ingested")
    ws = F.aggregate("embedding_sparse", F.lit(0.0), lambda a, e: a + e["w"])
    return rows.select("path", "chunk_index", "hash", "project", "summary_text", "essence_text",
                       F.array_join("tags", ",").alias("tags"), "importance", "memory_type", "session_id",
                       F.size("embedding_sparse").cast("bigint").alias("emb_nnz"), F.round(ws, 6).alias("emb_sum"))


@register("stream_snapshot_changes")
def q_stream_snapshot_changes(spark, sf):
    """ST3: page stream -> change detection against the stored snapshots -> change feed."""
    arrivals = FX.arrivals_from_pages(FX.pages_as_files(J.table_stream(spark, sf, "pages")))
    out = J.run_snapshot_feed(spark, arrivals, FX.stored_snapshots(spark, sf), NOW)
    c = spark.read.parquet(f"{out}/changes")
    return c.select("path", "status", "hash", "project", "summary", "essence")


LATE_AFTER = 3600 * 24 * 7


@register("stream_windows", f"""
ev AS (SELECT event_type AS key, CAST(epoch_us(CAST(ts AS TIMESTAMP)) // 1000000 AS BIGINT) AS ts, event_id % 4 = 0 AS second FROM events),
mark AS (SELECT max(ts) - {LATE_AFTER} AS m FROM ev WHERE NOT second),
judged AS (SELECT key, ts, second AND ts < m AS late FROM ev CROSS JOIN mark)
SELECT 'window' AS kind, ts - ts % 3600 AS start, key, count(*) AS n FROM judged WHERE NOT late GROUP BY ALL
UNION ALL SELECT 'late', NULL, key, count(*) FROM judged WHERE late GROUP BY key""")
def q_stream_windows(spark, sf):
    """ST4: events in two micro-batches; hourly counts per type, and the late rows of the second batch apart."""
    ev = read_table(spark, sf, "events").select("event_id", F.col("event_type").alias("key"),
                                                F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"))
    folder = J.work_dir(spark, "window_input")
    for part in (ev.filter("event_id % 4 <> 0"), ev.filter("event_id % 4 = 0")):  # one file each, in this order
        part.select("key", "ts").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("key string, ts long").option("maxFilesPerTrigger", 1).parquet(folder)
    out = J.run_windows(spark, stream, 3600, LATE_AFTER)
    windows = J.window_counts(spark, out).select(F.lit("window").alias("kind"), "start", "key", "n")
    late = J.late_rows(spark, out).groupBy("key").agg(F.count("*").alias("n"))
    return windows.unionByName(late.select(F.lit("late").alias("kind"), F.lit(None).cast("long").alias("start"), "key", "n"))


def _share_oracles():
    for stream, batch in (("stream_touch_rollup", "touch_rollup"), ("stream_ingest", "ingest_documents"),
                          ("stream_snapshot_changes", "snapshot_change_detection")):
        if batch in ORACLE:
            ORACLE[stream] = ORACLE[batch]


_share_oracles()
