"""Vectors kept by pivot cells: exact top-k that skips cells, and approximate top-k with a probe count.

Every unit vector belongs to the cell of its nearest pivot (of its own size); a cell knows the smallest and largest angle of its vectors
to the pivot. By the triangle inequality of angles no vector of a cell is nearer to a query than
max(0, angle(q, pivot) - largest, smallest - angle(q, pivot)). The exact search opens the cells of each query's nearest pivots
first and then only cells whose bound reaches the k-th similarity found; the approximate one opens the first `probes` cells
and nothing else. Queries travel to the cells they open, a cell's vectors are read once and in blocks of bounded size.

Pivots are PIVOTS vectors with the smallest hash of their id (a bounded sample); every vector is in the index.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.functions.visibility import visible
from memlake.operators.search import MEMORY_BLOCK, SIM_RESOLUTION, _block_topk
from memlake.session import ensure_checkpoint_dir, materialize

PIVOTS = 128            # cells of one vector size, at most
FIRST_CELLS = 4         # cells of a query that are opened before the others
ANGLE_SLACK = 1e-6      # for rounding: cells are opened rather than skipped
ATTRIBUTES = ["sensitivity", "project", "owner_id"]


def _unit(vectors) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in vectors])


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


class VectorIndex:
    """`vectors(cell, angle, hash, vec, sensitivity, project, owner_id)` in folders per cell, and one row per cell."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.cells = spark.read.parquet(f"{path}/cells")
        # folder names are read as ints; both sides of a grouping need one type
        self.vectors = spark.read.parquet(f"{path}/vectors").withColumn("cell", F.col("cell").cast("long"))


def create_vectors(mem_vec: DataFrame, path: str | None = None, pivots: int = PIVOTS) -> VectorIndex:
    """Write `mem_vec(hash, vec, sensitivity, project, owner_id)` (unit vectors) by pivot cells. Rows without a vector, or with a zero
    one, are kept in cell -1, which every search opens."""
    spark = mem_vec.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/vector_index-{uuid.uuid4().hex[:12]}"
    # written once: the vectors may be computed from texts, and both the pivots and the cells need them
    rows = materialize(mem_vec.select("hash", "vec", *ATTRIBUTES).withColumn("size", F.coalesce(F.size("vec"), F.lit(0))), "vector_rows")
    good = F.exists("vec", lambda x: x != 0)
    w = Window.partitionBy("size").orderBy(F.xxhash64("hash"))
    sample = rows.where(good).select("size", "hash", "vec").withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= pivots).collect()
    marks, first = {}, 0
    for size in sorted({r["size"] for r in sample}):
        own = np.unique(_unit([r["vec"] for r in sample if r["size"] == size]), axis=0)
        marks[size] = (first, own)
        first += len(own)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cell, angle = np.full(len(pdf), -1), np.zeros(len(pdf))
            for size in set(pdf["size"]) & set(marks):
                at = np.array([i for i, (s, v) in enumerate(zip(pdf["size"], pdf["vec"], strict=True)) if s == size and np.any(v)], np.int64)
                if len(at):
                    turn = _angles(_unit([pdf["vec"].iloc[i] for i in at]), marks[size][1])
                    cell[at], angle[at] = marks[size][0] + turn.argmin(axis=1), turn.min(axis=1)
            yield pdf[["hash"]].assign(cell=cell, angle=angle)
    cells = rows.select("hash", "vec", "size").mapInPandas(place, "hash string, cell long, angle double")
    placed = materialize(rows.join(cells, "hash"), "vector_cells")
    placed.repartition("cell", F.pmod(F.xxhash64("hash"), F.lit(8))).sortWithinPartitions("cell", "angle").write.partitionBy("cell").parquet(f"{path}/vectors")
    known = spark.createDataFrame([(first + i, v.tolist()) for first, own in marks.values() for i, v in enumerate(own)], "cell long, pivot array<double>")
    stats = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("near"), F.max("angle").alias("far"))
    stats.join(known, "cell", "left").coalesce(1).write.parquet(f"{path}/cells")
    return VectorIndex(spark, path)


def bounds(index: VectorIndex, qvec: DataFrame) -> DataFrame:
    """(query_id, cell, bound, pivot_sim): the largest cosine that a vector of the cell can have with the query, and its pivot's.

    A cell of another vector size scores 0; one without a pivot comes first."""
    rows = index.cells.collect()  # at most PIVOTS per vector size
    by: dict[int, list] = {}
    rest = [r["cell"] for r in rows if r["pivot"] is None]
    for r in rows:
        if r["pivot"] is not None:
            by.setdefault(len(r["pivot"]), []).append(r)

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for q, v in zip(pdf["query_id"], pdf["vec"], strict=True):
                size = 0 if v is None else len(v)
                cell, bound, near_to = [*rest], [0.0] * len(rest), [2.0] * len(rest)
                for other, own in by.items():
                    cell += [r["cell"] for r in own]
                    if other != size:
                        bound += [0.0] * len(own)
                        near_to += [0.0] * len(own)
                        continue
                    turn = _angles(np.asarray(v, np.float64)[None], _unit([r["pivot"] for r in own]))[0]
                    far, near = np.array([r["far"] for r in own]), np.array([r["near"] for r in own])
                    least = np.maximum(0, np.maximum(turn - far, near - turn) - ANGLE_SLACK)
                    # a zero query vector scores 0 everywhere
                    bound += (np.cos(least) if np.any(v) else np.zeros(len(own))).tolist()
                    near_to += np.cos(turn).tolist()
                yield pd.DataFrame({"query_id": q, "cell": cell, "bound": bound, "pivot_sim": near_to})
    return qvec.select("query_id", "vec").mapInPandas(reach, "query_id long, cell long, bound double, pivot_sim double")


def _open(index: VectorIndex, qvec: DataFrame, pairs: DataFrame, k: int, rows_of: DataFrame, scoped: bool) -> DataFrame:
    """Best k of each (query, cell) pair's cell and block: (query_id, hash, sim, sim_key)."""
    sizes = index.cells.select("cell", F.ceil(F.col("n") / MEMORY_BLOCK).cast("int").alias("blocks"))
    mem = rows_of.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("hash"), F.col("blocks")).cast("int"))
    mem = mem.join(pairs.select("cell").distinct(), "cell", "left_semi").select("cell", "block", "hash", "vec", *(ATTRIBUTES if scoped else []))
    ask = ["scope_project", "owner"] if scoped else []
    qry = (pairs.select("query_id", "cell").join(qvec.select("query_id", "vec", *ask), "query_id").join(sizes, "cell")
           .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks"))

    def kernel(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _block_topk(a, b, k, None, scoped)
    return mem.groupBy("cell", "block").cogroup(qry.groupBy("cell", "block")).applyInPandas(kernel, "query_id long, hash string, sim double, sim_key double")


def topk(index: VectorIndex, qvec: DataFrame, k: int, owner=None, project=None, scoped: bool = False, probes: int | None = None,
         first_cells: int = FIRST_CELLS) -> DataFrame:
    """(query_id, hash, sim, sim_key, rank): the best `k` visible memories per query.

    Exact; with `probes`, approximate: only the `probes` cells with the nearest pivots are opened for each query. With `scoped`, `qvec` also has
    (scope_project, owner) and every query sees what its requester may see."""
    rows = index.vectors if scoped else index.vectors.where(visible(project, owner))
    qvec = materialize(qvec, "index_queries")
    # the nearest pivots first: a wide cell has a high bound and few near vectors
    w = Window.partitionBy("query_id").orderBy(F.desc("pivot_sim"), "cell")
    ranked = materialize(bounds(index, qvec).withColumn("_i", F.row_number().over(w)), "cell_bounds")
    hits = materialize(_open(index, qvec, ranked.where(F.col("_i") <= (probes or first_cells)), k, rows, scoped), "cell_hits")
    if probes is None:
        hits = hits.unionByName(_open(index, qvec, remaining(ranked, hits, k, first_cells), k, rows, scoped))
    best = Window.partitionBy("query_id").orderBy(F.desc("sim_key"), "hash")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def remaining(ranked: DataFrame, hits: DataFrame, k: int, first_cells: int = FIRST_CELLS) -> DataFrame:
    """The (query, cell) pairs beyond the first cells that can still hold one of the best k."""
    best = Window.partitionBy("query_id").orderBy(F.desc("sim_key"), "hash")
    floor = hits.withColumn("_r", F.row_number().over(best)).where(F.col("_r") == k).select("query_id", F.col("sim_key").alias("floor"))
    return (ranked.where(F.col("_i") > first_cells).join(floor, "query_id", "left")
            .where(F.col("floor").isNull() | (F.col("bound") + 2 * 10.0 ** -SIM_RESOLUTION >= F.col("floor"))))


def recall(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """(query_id, recall): the share of a query's exact results that the approximate search returned."""
    found = approximate.select("query_id", "hash", F.lit(1).alias("found"))
    return exact.select("query_id", "hash").join(found, ["query_id", "hash"], "left").groupBy("query_id").agg(
        F.avg(F.coalesce("found", F.lit(0))).alias("recall"))
