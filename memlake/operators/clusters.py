"""Cosine k-means over memory vectors, cluster sizes, top tags and sample members.

Items are (hash, vec, tags). Centroids (k x d, k small) are the only thing broadcast. One
Lloyd iteration is one pass over the items: a `mapInPandas` kernel assigns each row once to its
most similar centroid (strict >, so ties go to the lowest cluster id) and emits per-partition partial
sums per cluster; the run ends when the centroids stay where they are. Only k partial rows per partition leave the task, so a cluster holding a
third of all items costs nothing extra. Iterations read the same materialised items (a
Parquet table in spark.checkpoint.dir), so lineage does not grow with the iterations.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.config import KMEANS_K, KMEANS_MAX_ITER
from memlake.functions.text import short_id
from memlake.session import materialize as _materialize


#: Centroids that move by no more than this stand still (the order of summation moves them by less).
SETTLED = 1e-12


def _matrix(vecs, dim: int) -> tuple[np.ndarray, np.ndarray]:
    m = np.zeros((len(vecs), dim))
    ok = np.zeros(len(vecs), dtype=bool)
    for i, v in enumerate(vecs):
        if v is not None and len(v) == dim:
            m[i] = v
            ok[i] = True
    return m, ok


def assign(m: np.ndarray, ok: np.ndarray, cent: np.ndarray | None) -> np.ndarray:
    """Index of the most similar centroid (first on ties); rows that are not `ok` (no vector of this size) -> 0."""
    if cent is None:
        return np.zeros(m.shape[0], dtype=np.int64)
    mn = np.linalg.norm(m, axis=1)
    cn = np.linalg.norm(cent, axis=1)
    den = mn[:, None] * cn[None, :]
    dots = m @ cent.T
    sims = np.divide(dots, den, out=np.zeros_like(dots), where=den > 0)
    sims[~ok] = 0.0
    return np.argmax(sims, axis=1).astype(np.int64)


def initial_centroids(items: DataFrame, k: int) -> tuple[np.ndarray, int]:
    """Seeded start: the vectors of the k items with the smallest hash (bounded: k rows)."""
    first = items.orderBy("hash").limit(k).select("vec").collect()
    if not first:
        return np.zeros((0, 0)), 0
    dim = len(first[0]["vec"])
    rows = [r["vec"] for r in first if len(r["vec"]) == dim]
    return np.array(rows, dtype=np.float64), dim


def _by_size(vecs) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vectors of each size: (places, matrix)."""
    sizes = np.array([0 if v is None else len(v) for v in vecs])
    return {int(d): (at, np.stack([np.asarray(vecs[i], np.float64) for i in at]))
            for d in np.unique(sizes[sizes > 0]) for at in [np.flatnonzero(sizes == d)]}


def _partial_kernel(bc):
    """Per partition: sums and counts per (size, cluster) under the current centroids, one row each at the end."""
    def kernel(it):
        cents = bc.value
        sums = {d: np.zeros_like(c) for d, c in cents.items()}
        counts = {d: np.zeros(len(c), dtype=np.int64) for d, c in cents.items()}
        for pdf in it:
            for d, (_, m) in _by_size(pdf["vec"].to_numpy()).items():
                a = assign(m, np.ones(len(m), bool), cents[d])
                np.add.at(sums[d], a, m)
                counts[d] += np.bincount(a, minlength=len(cents[d]))
        for d, c in cents.items():
            yield pd.DataFrame({"size": d, "cluster_id": np.arange(len(c), dtype=np.int64), "n": counts[d], "s": list(sums[d])})
    return kernel


def assign_to(spark: SparkSession, items: DataFrame, cent: np.ndarray, dim: int) -> DataFrame:
    """Add `cluster_id` for fixed centroids (Arrow-batched; other columns stay in the JVM)."""
    bc = spark.sparkContext.broadcast((cent, dim))

    @F.pandas_udf("long")
    def _assign(vecs: pd.Series) -> pd.Series:
        c, d = bc.value
        m, ok = _matrix(vecs.to_numpy(), d)
        return pd.Series(assign(m, ok, c))

    return items.withColumn("cluster_id", _assign(F.col("vec")))


def lloyd_sizes(spark: SparkSession, items: DataFrame, k: int = KMEANS_K, max_iter: int = KMEANS_MAX_ITER,
                checkpoint: bool = True) -> tuple[DataFrame, dict[int, np.ndarray], int]:
    """kMeansClusters with a seeded start, for vectors of any sizes: those of one size are clustered among themselves, all sizes in
    the same passes. Returns (rows with `size` and `cluster_id` from 0 within the size, centroids per size, iterations run)."""
    valid = items.filter(F.col("vec").isNotNull() & (F.size("vec") > 0)).select("hash", "vec", "tags", F.size("vec").alias("size"))
    if checkpoint:
        valid = _materialize(valid, "kmeans_items")   # written once to spark.checkpoint.dir
    w = Window.partitionBy("size").orderBy("hash")
    first = valid.select("size", "hash", "vec").withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= k).orderBy("size", "hash").collect()
    cur = {d: np.array([r["vec"] for r in first if r["size"] == d], dtype=np.float64) for d in sorted({r["size"] for r in first})}
    if k <= 0 or not cur:
        return valid.withColumn("cluster_id", F.lit(0).cast("long")), {}, 0
    used, iters = cur, 0
    for _ in range(max_iter):
        iters += 1
        bc = spark.sparkContext.broadcast(cur)
        part = valid.select("vec").mapInPandas(_partial_kernel(bc), "size long, cluster_id long, n long, s array<double>")
        # element-wise reduction in Spark: only sums of k vectors per size reach the driver
        red = (part.select("size", "cluster_id", "n", F.posexplode("s").alias("pos", "x"))
               .groupBy("size", "cluster_id", "pos").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect())
        bc.destroy()
        new = {d: c.copy() for d, c in cur.items()}
        for r in red:
            if r["n"]:
                new[r["size"]][r["cluster_id"], r["pos"]] = r["x"] / r["n"]
        used, settled = cur, all(np.allclose(new[d], cur[d], rtol=0, atol=SETTLED) for d in cur)
        cur = new
        if settled:
            break
    bc = spark.sparkContext.broadcast(used)

    @F.pandas_udf("long")
    def nearest(vecs: pd.Series) -> pd.Series:
        out = np.zeros(len(vecs), np.int64)
        for d, (at, m) in _by_size(vecs.to_numpy()).items():
            out[at] = assign(m, np.ones(len(m), bool), bc.value[d])
        return pd.Series(out)
    return valid.withColumn("cluster_id", nearest(F.col("vec"))), cur, iters


def lloyd(spark: SparkSession, items: DataFrame, k: int = KMEANS_K, max_iter: int = KMEANS_MAX_ITER,
          checkpoint: bool = True) -> tuple[DataFrame, np.ndarray, int]:
    """kMeansClusters with a seeded start. Returns (assignments, centroids of the smallest size, iterations run). Clusters of larger
    vectors are numbered after those of smaller ones, so no cluster holds vectors of two sizes."""
    assigned, cent, iters = lloyd_sizes(spark, items, k, max_iter, checkpoint)
    if not cent:
        return assigned.drop("size"), np.zeros((0, 0)), iters
    before, offset = 0, F.lit(0)
    for d, c in cent.items():
        offset = F.when(F.col("size") == d, F.lit(before)).otherwise(offset)
        before += len(c)
    return assigned.withColumn("cluster_id", F.col("cluster_id") + offset).drop("size"), next(iter(cent.values())), iters


def centroid_means(assigned: DataFrame) -> DataFrame:
    """(cluster_id, pos, value): element-wise mean of member vectors (partial aggregation)."""
    return (assigned.select("cluster_id", F.posexplode("vec").alias("pos", "x"))
            .groupBy("cluster_id", "pos").agg(F.avg(F.col("x").cast("double")).alias("value")))


def cluster_sizes(assigned: DataFrame) -> DataFrame:
    return (assigned.groupBy("cluster_id").agg(F.count("*").alias("size"))
            .orderBy(F.desc("size"), "cluster_id"))


def top_tags(assigned: DataFrame, n: int = 5) -> DataFrame:
    """Per cluster: the n most frequent tags (ties by tag)."""
    c = (assigned.select("cluster_id", F.explode("tags").alias("tag"))
         .groupBy("cluster_id", "tag").agg(F.count("*").alias("cnt")))
    w = Window.partitionBy("cluster_id").orderBy(F.desc("cnt"), "tag")
    return c.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def sample_members(assigned: DataFrame, n: int = 5) -> DataFrame:
    """Per cluster: the first n member ids (by hash), shown as short ids."""
    w = Window.partitionBy("cluster_id").orderBy("hash")
    return (assigned.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)
            .select("cluster_id", "rn", short_id("hash").alias("short_id")))


def mllib_kmeans(items: DataFrame, k: int = KMEANS_K, max_iter: int = KMEANS_MAX_ITER, seed: int = 42) -> DataFrame:
    """The scalable library form: MLlib KMeans with cosine distance (zero vectors excluded)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    v = (items.filter(F.col("vec").isNotNull() & (F.size("vec") > 0))
         .filter(F.aggregate("vec", F.lit(0.0), lambda a, x: a + F.abs(x)) > 0)
         .select("hash", array_to_vector(F.col("vec").cast("array<double>")).alias("features")))
    km = KMeans(k=k, maxIter=max_iter, seed=seed, distanceMeasure="cosine", initMode="random")
    model = km.fit(v)
    return model.transform(v).select("hash", F.col("prediction").cast("long").alias("cluster_id"))
