"""Embedding near-dedup by int8 quantised tile products with rigorous error bounds.

Quantisation. A unit vector u is kept as s * q with q in int8 and the exact norm e of what that loses. For two vectors
|<u, v> - s s' <q, q'>| <= e + e' + e e', so the integer product (exact in float32) decides most pairs: those whose upper bound is
below the threshold are no links, those whose lower bound is above it are links, and only the rest is computed from the vectors
themselves in double precision.

Tiles. Vectors are ordered by (size, nearest pivot, angle to it) with a range exchange and packed into tiles of at most TILE
vectors, each with its centre and radius. The tiles form blocks of about BLOCK_ROWS vectors. First only the tiles' heads meet, block
by block: by the triangle inequality of angles a pair of tiles has no link (centres too far apart), nothing but links (both
radii and the distance within the threshold's angle, so a group of copies of any size is settled here, without products) or is open. Then the
blocks that have open pairs meet with their vectors. No pair of vectors becomes a row: tasks return counts per vector and
a spanning forest of the links, which is contracted to classes.

Cost: all open pairs of tiles are multiplied, which for vectors without any cluster is every pair, N * N / 2 products of int8.

Bounds: a task holds two blocks (BLOCK_ROWS vectors each); the driver gets PIVOTS vectors and the number of rows.

Defined cases: a vector that is null, empty, zero or has a null or non-finite component links with nothing and is its own class. Vectors of
different sizes are not compared. Rows that repeat a vector or an id are vectors of their own. A null id does not count for the
smallest id; a row with a null id, or in a class with only null ids, is not kept. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from memlake.llm.common import materialize, register
from memlake.llm.simhash import contract
from memlake.sources.tables import read_table

#: Least cosine of a link.
THRESHOLD = 0.95
#: Vectors in a tile and, about, in a block; least number of blocks; vectors that order the others.
TILE, BLOCK_ROWS, MIN_BLOCKS, PIVOTS = 512, 32_768, 8, 128
#: Dimensions in one product: 1,024 * 127 * 127 < 2 ** 24, so float32 sums of integers are exact.
EXACT_DIMS = 1024
#: Slack for rounding: of angles, and of sums in double precision.
ANGLE_SLACK, SUM_SLACK = 1e-6, 1e-9
#: What a row of the tasks' answers is: a pair of blocks to multiply, a count, tiles that are linked as wholes, a link.
OPEN, COUNT, WHOLE, LINK = range(4)


def unit_rows(vectors) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Sizes of the usable vectors (0: not usable), and per size (places, unit vectors)."""
    values = [np.asarray([] if v is None else v, np.float64) for v in vectors]
    sizes, out = np.array([len(v) for v in values], np.int64), {}
    for size in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == size)
        x = np.stack([values[i] for i in at])
        top = np.abs(x).max(axis=1)
        good = np.isfinite(top) & (top > 0)
        sizes[at[~good]] = 0
        x = x[good] / top[good, None]
        out[int(size)] = at[good], x / np.sqrt((x * x).sum(axis=1))[:, None]
    return sizes, out


def quantise(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 values, scales, norms of what they lose)."""
    scale = np.abs(u).max(axis=1) / 127
    q = np.rint(u / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(u - scale[:, None] * q, axis=1) + 1e-12


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


def quantised(vectors: DataFrame, id_col: str, vec_col: str, pivots: list) -> DataFrame:
    """(row, vec_id, size, cell, angle, q, scale, err, raw): the rows in the form that the tiles take; size 0: not usable."""
    _, marks = unit_rows(pivots)
    kind = "<f4" if isinstance(vectors.schema[vec_col].dataType.elementType, FloatType) else "<f8"

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()  # a null component becomes NaN
            vectors = [flat[x:y] if ok else None for x, y, ok in zip(ends[:-1], ends[1:], lists.is_valid().to_pylist(), strict=True)]
            sizes, by = unit_rows(vectors)
            n = len(vectors)
            cell, angle, scale, err = np.full(n, -1), np.zeros(n), np.zeros(n), np.zeros(n)
            packed, raw = [None] * n, [None] * n
            for size, (at, u) in by.items():
                q, scale[at], err[at] = quantise(u)
                if size in marks and len(at) and len(marks[size][1]):
                    turn = angles(u, marks[size][1])
                    cell[at], angle[at] = turn.argmin(axis=1), turn.min(axis=1)
                for i, place in enumerate(at):
                    packed[place], raw[place] = q[i].tobytes(), vectors[place].astype(kind).tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("vec_id"), *map(pa.array, (sizes, cell, angle)), pa.array(packed, pa.binary()),
                 pa.array(scale), pa.array(err), pa.array(raw, pa.binary())],
                names=["row", "vec_id", "size", "cell", "angle", "q", "scale", "err", "raw"])
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("vec_id"), F.col(vec_col).alias("v"))
    return rows.mapInArrow(kernel, "row bigint, vec_id bigint, size bigint, cell bigint, angle double, q binary, scale double, "
                                   "err double, raw binary")


def tiles(rows: DataFrame, parts: int) -> DataFrame:
    """Packed tiles of the usable rows, in the order of (size, cell, angle)."""
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, made, held = TaskContext.get().partitionId(), 0, []

        def tile(some: list) -> pd.DataFrame:
            nonlocal made
            size = int(some[0].size)
            raw = b"".join(r.raw for r in some)
            u = unit_rows(_matrix(raw, len(some), size))[1][size][1]
            centre = u.mean(axis=0)
            norm = np.linalg.norm(centre)
            centre = centre / norm if norm > 1e-9 else u[0]
            made += 1
            return pd.DataFrame({
                "tile": [part << 32 | made], "part": [part], "size": [size], "n": [len(some)],
                "rows": [np.array([r.row for r in some], np.int64).tobytes()], "q": [b"".join(r.q for r in some)],
                "scale": [np.array([r.scale for r in some]).tobytes()], "err": [np.array([r.err for r in some]).tobytes()],
                "raw": [raw], "centre": [centre.tobytes()], "radius": [float(angles(u, centre[None]).max())]})
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                new = held and (r.size != held[0].size or len(held) == TILE or (r.cell != held[0].cell and len(held) >= TILE // 8))
                if new:
                    yield tile(held)
                    held = []
                held.append(r)
        if held:
            yield tile(held)
    order = ["size", "cell", "angle", "row"]
    dealt = rows.where("size > 0").select(*order, "q", "scale", "err", "raw").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return dealt.mapInPandas(pack, "tile bigint, part bigint, size bigint, n bigint, rows binary, q binary, scale binary, err binary, "
                                   "raw binary, centre binary, radius double")


def _matrix(raw: bytes, n: int, size: int) -> np.ndarray:
    return np.frombuffer(raw, "<f4" if len(raw) == 4 * n * size else "<f8").reshape(n, size).astype(np.float64)


def settle(a: pd.DataFrame, b: pd.DataFrame, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """(open, linked): for each pair of heads whether it needs products, or consists of links only."""
    open_, linked = np.zeros((len(a), len(b)), bool), np.zeros((len(a), len(b)), bool)
    for size in set(a["size"]) & set(b["size"]):
        i, j = np.flatnonzero(a["size"] == size), np.flatnonzero(b["size"] == size)
        ca, cb = (np.frombuffer(b"".join(x["centre"].iloc[k]), np.float64).reshape(-1, size) for x, k in ((a, i), (b, j)))
        apart = angles(ca, cb)
        reach = a["radius"].to_numpy()[i][:, None] + b["radius"].to_numpy()[j][None, :]
        linked[np.ix_(i, j)] = apart + reach <= limit - ANGLE_SLACK
        open_[np.ix_(i, j)] = (apart - reach <= limit + ANGLE_SLACK) & (apart + reach > limit - ANGLE_SLACK)
    return open_, linked


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) over the links a-b, without the smallest nodes themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            moved = label != np.arange(len(nodes))
            return nodes[moved], nodes[label[moved]]
        label = new


def _spanning(link: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links (a boolean matrix) between rows a and rows b."""
    some, other = link.any(axis=1), link.any(axis=0)
    a, b, link = a[some], b[other], link[np.ix_(some, other)]
    if link.all():
        return np.concatenate([a, b[1:]]), np.concatenate([np.repeat(b[:1], len(a)), np.repeat(a[:1], len(b) - 1)])
    i, j = np.nonzero(link)
    return forest(a[i], b[j])


class Tile:
    """A tile's arrays, unpacked when a product needs them."""

    def __init__(self, r):
        self.id, self.n, self.size, self.radius = r.tile, int(r.n), int(r.size), r.radius
        self.rows = np.frombuffer(r.rows, np.int64)
        self.q = np.frombuffer(r.q, np.int8).reshape(self.n, self.size).astype(np.float32)
        self.scale, self.err = np.frombuffer(r.scale), np.frombuffer(r.err)
        self.raw, self._unit = r.raw, None

    @property
    def unit(self) -> np.ndarray:
        if self._unit is None:
            self._unit = unit_rows(_matrix(self.raw, self.n, self.size))[1][self.size][1]
        return self._unit


def links_between(a: Tile, b: Tile, threshold: float) -> np.ndarray | None:
    """The links of two tiles as a boolean matrix (None: no link)."""
    dot = a.q[:, :EXACT_DIMS] @ b.q[:, :EXACT_DIMS].T
    for k in range(EXACT_DIMS, a.size, EXACT_DIMS):
        dot = dot.astype(np.float64) + a.q[:, k:k + EXACT_DIMS] @ b.q[:, k:k + EXACT_DIMS].T
    ea, eb = a.err.max(), b.err.max()
    least = (threshold - ea - eb - ea * eb - SUM_SLACK) / (a.scale.max() * b.scale.max())
    if least > 0 and dot.max() < least * (1 - 1e-6):
        return None
    i, j = np.nonzero(dot >= least * (1 - 1e-6)) if least > 0 else np.nonzero(np.ones(dot.shape, bool))
    near = dot[i, j].astype(np.float64) * a.scale[i] * b.scale[j]
    loss = a.err[i] + b.err[j] + a.err[i] * b.err[j] + SUM_SLACK
    sure = near - loss >= threshold
    maybe = np.flatnonzero(~sure & (near + loss >= threshold))
    for k in range(0, len(maybe), 8192):  # full precision
        m = maybe[k:k + 8192]
        sure[m] = (a.unit[i[m]] * b.unit[j[m]]).sum(axis=1) >= threshold
    link = np.zeros(dot.shape, bool)
    link[i[sure], j[sure]] = True
    return link if sure.any() else None


def _meet(blocks: DataFrame, columns: list[str], pairs: DataFrame) -> DataFrame:
    """The tiles of both blocks of every pair (bi, bj), with the side each is on."""
    sides = (pairs.select("bi", "bj", F.col("bi").alias("block"), F.lit(0).alias("side"))
             .unionByName(pairs.where("bi <> bj").select("bi", "bj", F.col("bj").alias("block"), F.lit(1).alias("side"))))
    return blocks.select("block", "tile", *columns).join(sides, "block").drop("block")


def _two_sides(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, bool]:
    pdf = pdf.sort_values("tile")
    a, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
    same = pdf["bi"].iloc[0] == pdf["bj"].iloc[0]
    return a, a if same else b, same


def link_vectors(packed: DataFrame, blocks: int, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(row, n) counts of links, several rows a vector, and (hi, lo) links that connect what all links connect."""
    limit = float(np.arccos(threshold))
    spark = packed.sparkSession
    last = packed.agg(F.max("part")).first()[0] or 0
    placed = packed.withColumn("block", F.floor(F.col("part") * blocks / (last + 1)).cast("bigint"))
    pairs = spark.range(blocks).select(F.col("id").alias("bi"), F.explode(F.sequence(F.col("id"), F.lit(blocks - 1))).alias("bj"))

    def heads(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, same = _two_sides(pdf)
        open_, linked = settle(a, b, limit)
        upper = np.triu(np.ones(open_.shape, bool)) if same else np.ones(open_.shape, bool)
        out = [pd.DataFrame({"kind": OPEN, "x": a["tile"].iloc[:1], "y": a["tile"].iloc[:1]})] if (open_ & upper).any() else []
        na, nb = a["n"].to_numpy(), b["n"].to_numpy()
        if same:  # the diagonal is a tile with itself
            n = linked @ nb - np.diag(linked)
            out.append(pd.DataFrame({"kind": COUNT, "x": a["tile"], "y": n})[n > 0])
        else:
            for t, n in ((a["tile"], linked @ nb), (b["tile"], linked.T @ na)):
                out.append(pd.DataFrame({"kind": COUNT, "x": t, "y": n})[n > 0])
        i, j = np.nonzero(linked & upper)
        ids_a, ids_b = a["tile"].to_numpy()[i], b["tile"].to_numpy()[j]
        if len(i):
            x, y = forest(ids_a, ids_b)
            x, y = np.concatenate([x, ids_a[ids_a == ids_b]]), np.concatenate([y, ids_b[ids_a == ids_b]])
            out.append(pd.DataFrame({"kind": WHOLE, "x": x, "y": y}))
        out = [o.assign(bi=pdf["bi"].iloc[0], bj=pdf["bj"].iloc[0]) for o in out]
        return (pd.concat(out) if out else pd.DataFrame(columns=["kind", "bi", "bj", "x", "y"], dtype=np.int64))[["kind", "bi", "bj", "x", "y"]]
    settled = materialize(_meet(placed, ["size", "n", "centre", "radius"], pairs).groupBy("bi", "bj").applyInPandas(
        heads, "kind bigint, bi bigint, bj bigint, x bigint, y bigint"), "embedding_heads")

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, same = _two_sides(pdf)
        open_, _ = settle(a, b, limit)
        ta = [Tile(r) for r in a.itertuples(index=False)]
        tb = ta if same else [Tile(r) for r in b.itertuples(index=False)]
        counts = {t.id: np.zeros(t.n, np.int64) for t in [*ta, *tb]}
        hi, lo = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i, j in zip(*np.nonzero(open_), strict=True):
            if same and j < i:
                continue
            x, y = ta[i], tb[j]
            link = links_between(x, y, threshold)
            if link is None:
                continue
            if x is y:
                np.fill_diagonal(link, False)
                if not link.any():
                    continue
                counts[x.id] += link.sum(axis=1)
            else:
                counts[x.id] += link.sum(axis=1)
                counts[y.id] += link.sum(axis=0)
            p, q = _spanning(link, x.rows, y.rows)
            hi.append(p)
            lo.append(q)
            if len(hi) > 256:
                p, q = forest(np.concatenate(hi), np.concatenate(lo))
                hi, lo = [p], [q]
        p, q = forest(np.concatenate(hi), np.concatenate(lo))
        rows = {t.id: t.rows for t in [*ta, *tb]}
        row = np.concatenate([rows[k][c > 0] for k, c in counts.items()])
        n = np.concatenate([c[c > 0] for c in counts.values()])
        return pd.DataFrame({"kind": np.repeat([COUNT, LINK], [len(row), len(p)]), "x": np.concatenate([row, p]), "y": np.concatenate([n, q])})
    still = settled.where(F.col("kind") == OPEN).select("bi", "bj").distinct()
    found = materialize(_meet(placed, ["size", "n", "rows", "q", "scale", "err", "raw", "centre", "radius"], still)
                        .groupBy("bi", "bj").applyInPandas(products, "kind bigint, x bigint, y bigint"), "embedding_products")

    # what was settled for whole tiles holds for their rows
    by_tile = settled.where(F.col("kind") == COUNT).groupBy(F.col("x").alias("tile")).agg(F.sum("y").alias("n"))
    whole = settled.where(F.col("kind") == WHOLE).select(F.col("x").alias("tile"), F.col("y").alias("other")).distinct()

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rows, n in zip(pdf["rows"], pdf["n"], strict=True):
                rows = np.frombuffer(rows, np.int64)
                yield pd.DataFrame({"row": rows, "n": n, "first": rows[0]})
    members = "row bigint, n bigint, first bigint"
    settled_counts = placed.select("tile", "rows").join(by_tile, "tile").select("rows", "n").mapInPandas(spread, members).select("row", "n")
    # all rows of a tile that takes part are linked through the other tile
    part = whole.select("tile").unionByName(whole.select(F.col("other").alias("tile"))).distinct()
    inside = (placed.select("tile", "rows", F.lit(0).cast("bigint").alias("n")).join(part, "tile").select("rows", "n")
              .mapInPandas(spread, members).where("row <> first").select(F.col("row").alias("a"), F.col("first").alias("b")))
    firsts = placed.join(part, "tile").select("tile", "rows").mapInPandas(
        lambda it: (pd.DataFrame({"tile": p["tile"], "first": [np.frombuffer(r, np.int64)[0] for r in p["rows"]]}) for p in it), "tile bigint, first bigint")
    firsts = materialize(firsts, "embedding_firsts")
    across = (whole.where("tile <> other").join(firsts, "tile").withColumnRenamed("first", "a")
              .join(firsts.select(F.col("tile").alias("other"), F.col("first").alias("b")), "other").select("a", "b"))
    ends = found.where(F.col("kind") == LINK).select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(inside).unionByName(across)
    links = ends.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    counts = found.where(F.col("kind") == COUNT).select(F.col("x").alias("row"), F.col("y").alias("n")).unionByName(settled_counts)
    return counts, links


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    sample = (vectors.where(F.col(vec_col).isNotNull()).orderBy(F.xxhash64(id_col, vec_col))
              .select(F.col(vec_col).alias("v")).limit(PIVOTS).collect())
    rows = materialize(quantised(vectors, id_col, vec_col, [r["v"] for r in sample]), "embedding_rows")
    blocks = max(MIN_BLOCKS, -(-rows.where("size > 0").count() // BLOCK_ROWS))
    packed = materialize(tiles(rows, 4 * blocks), "embedding_tiles")
    counts, links = link_vectors(packed, blocks, threshold)
    total = counts.groupBy("row").agg(F.sum("n").alias("n_links"))
    stars = contract(links)
    linked = rows.select("row", "vec_id").join(total, "row", "left").join(stars.select(F.col("hi").alias("row"), "lo"), "row", "left")
    linked = materialize(linked.select("row", "vec_id", "n_links", F.coalesce("lo", "row").alias("root")), "embedding_linked")
    # alone in its class: no grouping needed
    alone = linked.where("n_links IS NULL").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    together = linked.where("n_links IS NOT NULL")
    least = together.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    # a class may hold a third of all rows: its one row is copied per salt
    salts = 32
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    classed = together.withColumn("salt", F.pmod("row", F.lit(salts)).cast("int")).join(least, ["root", "salt"])
    out = classed.select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


@register("op12_embedding_neardup", f"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id JOIN c ON c.a = e.vec_id""")
def op12_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings: links at cosine 0.95 or more and their classes, whatever the labels."""
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))
