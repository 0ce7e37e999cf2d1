"""Spark session helpers.

`get_spark` is for tests, the bench and local runs. On a cluster the session comes from the
launcher; library code only reads settings from it (see `ensure_checkpoint_dir`).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, app: str = "memlake", shuffle_partitions: int = 8,
              extra: dict | None = None) -> SparkSession:
    master = master or os.environ.get("MEMLAKE_MASTER", "local[8]")
    b = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("MEMLAKE_DRIVER_MEMORY", "16g"))
    )
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare_session(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make `memlake` importable in executor Python workers (as --py-files would).

    Arrow-batched kernels are pickled by reference to their module; the package is zipped
    once per application and added with SparkContext.addPyFile, so workers find it whatever
    their working directory is."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="memlake-pkg-"), "memlake.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)


def prepare_session(spark: SparkSession) -> None:
    """Checkpoint folder (read from the session, set only when unset) and code shipping."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the session's `spark.checkpoint.dir`; only when unset (local tests) make one."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        existing = spark.sparkContext.getCheckpointDir()
        if existing:
            return existing
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="memlake-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by writing `df` once as a Parquet table in the shared checkpoint folder
    and reading it back (later reads get column pruning and filter pushdown).

    Unlike an eager Dataset.checkpoint(), which evaluates the plan once to trigger the
    checkpoint and again to write it, the plan runs exactly once."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex[:12]}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)

