"""Structured Streaming forms of the incremental jobs.

ST1 access-log rollup: events -> (hash, ts) -> stateful groupBy(hash) max/count in update
    mode -> foreachBatch puts the changed rows into a bucketed table, of which only the touched buckets are
    rewritten. The rows are cumulative, so a replayed batch puts the same rows there again.
ST2 continuous ingest: new document rows -> chunk / id / summarise / embed (all stateless)
    -> append sink.
ST3 snapshot change feed: arriving file rows -> foreachBatch change detection against the bucketed
    snapshot table -> change rows under the batch's number, then the touched buckets of the table. A replayed batch whose
    change rows are complete keeps them and only puts its rows into the table again.
ST4 event-time windows: access counts per window; rows behind the watermark are counted and kept apart.

State, checkpoints and sink tables live in one folder: the caller's (`out`; a later run with the same folder
goes on where the last one ended) or a fresh one under `spark.checkpoint.dir`.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.operators import buckets as B
from memlake.operators import changes as W
from memlake.operators import documents as D
from memlake.operators import records as RC
from memlake.session import ensure_checkpoint_dir, materialize


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint dir, for a run that names no folder of its own."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:12]}"


def table_stream(spark: SparkSession, sf_dir: str, table: str, max_files: int | None = None) -> DataFrame:
    """A file-source stream over `<sf_dir>/<table>.parquet`, a file or a folder of files (declared schema, no inference)."""
    path = f"{sf_dir.rstrip('/')}/{table}.parquet"
    r = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    # as a glob: a plain path becomes the stream's base path, which must be a folder
    return r.parquet(f"{path[:-1]}[{path[-1]}]")


def _run(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


# ---------------------------------------------------------------- ST1


def access_rollup_stream(spark: SparkSession, accesses: DataFrame, out_dir: str, dedupe_watermark: str | None = None):
    """Start ST1 on a streaming (hash, ts) DataFrame; returns the StreamingQuery.

    With `dedupe_watermark` (e.g. "1 hour") duplicate access events (same hash and ts)
    within the watermark are dropped first.
    """
    a = accesses
    if dedupe_watermark:
        a = (a.withColumn("_evt", F.timestamp_seconds("ts")).withWatermark("_evt", dedupe_watermark)
             .dropDuplicatesWithinWatermark(["hash", "ts"]).drop("_evt"))
    agg = a.groupBy("hash").agg(F.max("ts").alias("last_touch"), F.count("*").alias("touches"))

    def sink(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("arrival", F.lit(batch_id).cast("long"))
        put(spark, f"{out_dir}/touch_state", rows, W.upsert, "hash")

    return (agg.writeStream.outputMode("update").foreachBatch(sink)
            .option("checkpointLocation", f"{out_dir}/_checkpoint").trigger(availableNow=True).start())


def exists(spark: SparkSession, path: str) -> bool:
    try:
        return spark.read.parquet(path).limit(1).count() >= 0
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return False
        raise


def put(spark: SparkSession, path: str, rows: DataFrame, job, key: str) -> None:
    """Apply a batch to the bucketed table at `path`, which begins with the first one."""
    if exists(spark, path):
        B.change_table(spark, path, rows, job, key)
    else:
        B.write_table(rows, path, key)


def touch_state(spark: SparkSession, out_dir: str) -> DataFrame:
    """Cumulative (hash, last_touch, touches) written by ST1: one row per memory."""
    return B.read_table(spark, f"{out_dir}/touch_state").select("hash", "last_touch", "touches")


def apply_touch_state(mem: DataFrame, state: DataFrame) -> DataFrame:
    j = mem.join(state, "hash", "left")
    return j.select(*[
        F.greatest("last_accessed", F.coalesce("last_touch", "last_accessed")).cast("bigint").alias(c)
        if c == "last_accessed" else
        (F.col("access_count") + F.coalesce("touches", F.lit(0))).cast("bigint").alias(c)
        if c == "access_count" else F.col(c) for c in mem.columns])


def run_access_rollup(spark: SparkSession, accesses: DataFrame, out: str | None = None) -> str:
    out = out or work_dir(spark, "access_rollup")
    _run(access_rollup_stream(spark, accesses, out))
    return out


# ---------------------------------------------------------------- ST2


def ingest_stream(spark: SparkSession, files: DataFrame, out_dir: str, now: int, size: int, separator: str):
    """Start ST2 on a streaming (path, project, content) DataFrame."""
    rows = D.ingest_files(files, now, size=size, separator=separator)
    return (rows.writeStream.format("parquet").outputMode("append")
            .option("path", f"{out_dir}/ingested").option("checkpointLocation", f"{out_dir}/_checkpoint")
            .trigger(availableNow=True).start())


def run_ingest(spark: SparkSession, files: DataFrame, now: int, size: int, separator: str, out: str | None = None) -> str:
    out = out or work_dir(spark, "ingest")
    _run(ingest_stream(spark, files, out, now, size, separator))
    return out


# ---------------------------------------------------------------- ST3


def snapshot_feed(spark: SparkSession, arrivals: DataFrame, stored: DataFrame, out_dir: str, now: int):
    """Start ST3: change detection of each micro-batch of arrivals; `stored` is the table before the first."""
    table, feed, done = f"{out_dir}/table", f"{out_dir}/changes", f"{out_dir}/done"
    if not exists(spark, table):
        B.write_table(stored, table, "path")

    def sink(batch: DataFrame, batch_id: int) -> None:
        seen = materialize(RC.one_arrival_per_path(batch), "feed_arrivals")  # the batch is read once
        if not (exists(spark, done) and spark.read.parquet(done).filter(F.col("batch_id") == batch_id).count()):
            now_there = B.read_table(spark, table, "path").join(seen.select("path"), "path", "left_semi")
            (RC.snapshot_changes(now_there, seen, now).withColumn("batch_id", F.lit(batch_id))
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(feed))
            spark.createDataFrame([(batch_id,)], "batch_id long").coalesce(1).write.mode("append").parquet(done)
        B.change_table(spark, table, seen, lambda old, arrived: RC.snapshot_upsert(old, arrived, now), "path")

    return (arrivals.writeStream.foreachBatch(sink).option("checkpointLocation", f"{out_dir}/_checkpoint")
            .trigger(availableNow=True).start())


def run_snapshot_feed(spark: SparkSession, arrivals: DataFrame, stored: DataFrame, now: int, out: str | None = None) -> str:
    out = out or work_dir(spark, "snapshot_feed")
    _run(snapshot_feed(spark, arrivals, stored, out, now))
    return out


def snapshot_state(spark: SparkSession, out: str) -> DataFrame:
    """The snapshot table as ST3 left it."""
    return B.read_table(spark, f"{out}/table", "path")


# ---------------------------------------------------------------- ST4


def window_stream(spark: SparkSession, accesses: DataFrame, out_dir: str, window_s: int, delay_s: int):
    """Start ST4 on a streaming (key, ts) DataFrame (ts in epoch seconds).

    The watermark of a batch is the latest time of all batches before it, less `delay_s`; rows before it are late: they go to
    `late`, the others are counted per (window start, key) in `windows`. Every batch writes its own partitions and
    its watermark, so a replayed batch replaces what it wrote. Rows without a time are late."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        rows = materialize(batch.select("key", F.col("ts").cast("long").alias("ts")), "window_rows")
        marks = f"{out_dir}/marks"
        before = None
        if exists(spark, marks):
            before = spark.read.parquet(marks).filter(F.col("batch_id") < batch_id).agg(F.max("latest")).first()[0]
        late = F.col("ts").isNull() if before is None else F.col("ts").isNull() | (F.col("ts") < before - delay_s)
        start = (F.col("ts") - F.pmod("ts", F.lit(window_s))).alias("start")
        own = {"windows": rows.filter(~late).groupBy(start, "key").agg(F.count("*").alias("n")), "late": rows.filter(late),
               "marks": rows.agg(F.max("ts").alias("latest"))}
        for name, part in own.items():
            (part.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{out_dir}/{name}"))

    return (accesses.writeStream.foreachBatch(sink).option("checkpointLocation", f"{out_dir}/_checkpoint")
            .trigger(availableNow=True).start())


def run_windows(spark: SparkSession, accesses: DataFrame, window_s: int, delay_s: int, out: str | None = None) -> str:
    out = out or work_dir(spark, "windows")
    _run(window_stream(spark, accesses, out, window_s, delay_s))
    return out


def window_counts(spark: SparkSession, out: str) -> DataFrame:
    """(start, key, n) over all batches, without late rows."""
    return spark.read.parquet(f"{out}/windows").groupBy("start", "key").agg(F.sum("n").alias("n"))


def late_rows(spark: SparkSession, out: str) -> DataFrame:
    """(key, ts, batch_id) of the rows that came too late."""
    return spark.read.schema("key string, ts long, batch_id long").parquet(f"{out}/late")
