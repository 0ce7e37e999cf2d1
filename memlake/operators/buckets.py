"""Table changes that rewrite only the buckets they touch.

A table is written in folders by a hash of its key (plain Parquet partitions). A change batch reads the buckets of its keys, applies
one of the jobs of `operators.changes` to them and overwrites those folders alone (dynamic partition overwrite); all other files
stay as they are. The new rows are written aside first, so that a lost executor never meets a half-replaced folder. A
bucket that a change leaves empty keeps one row without a key, which readers skip.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.session import materialize

BUCKETS = 64    # folders of a table; a batch of few keys rewrites as many at most


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_table(df: DataFrame, path: str, key: str = "hash", buckets: int = BUCKETS) -> None:
    """Write `df` (no NULL keys) in folders by bucket of its key. A row without a key keeps the columns of an empty table."""
    blank = df.sparkSession.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields], F.lit(0).alias("bucket"))
    rows = df.withColumn("bucket", bucket_of(key, buckets)).unionByName(blank)
    rows.repartition("bucket").write.partitionBy("bucket").parquet(path)


def read_table(spark: SparkSession, path: str, key: str = "hash") -> DataFrame:
    return spark.read.parquet(path).where(F.col(key).isNotNull()).drop("bucket")


def change_table(spark: SparkSession, path: str, changes: DataFrame, job: Callable[[DataFrame, DataFrame], DataFrame],
                 key: str = "hash", buckets: int = BUCKETS) -> list[int]:
    """Apply `job(rows, changes)` (an upsert, a partial update, a delete, a touch) to the buckets of the changed keys.

    Returns the buckets that were rewritten. A row that is not changed must not depend on changes of other keys."""
    batch = materialize(changes, "bucket_changes")
    touched = sorted(r[0] for r in batch.where(F.col(key).isNotNull()).select(bucket_of(key, buckets)).distinct().collect())
    if not touched:
        return []
    stored = spark.read.parquet(path)
    old = stored.where(F.col("bucket").isin(touched) & F.col(key).isNotNull()).drop("bucket")
    new = materialize(job(old, batch).select(*old.columns).withColumn("bucket", bucket_of(key, buckets)), "bucket_rows")
    full = {r[0] for r in new.select("bucket").distinct().collect()}
    empty = [(b,) for b in touched if b not in full]
    if empty:
        blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in old.schema.fields]
        new = new.unionByName(spark.createDataFrame(empty, "bucket int").select(*blank, "bucket"))
    (new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path))
    spark.catalog.refreshByPath(path)
    return touched
