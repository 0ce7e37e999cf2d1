"""Merkle manifest of a dataset: leaves, subroots per source, one root, and a proof for every row.

Method (nested-struct rollup). A row's rank among its source's rows is written as base-16 digits. Inside blocks of
16 ** BLOCK_DIGITS consecutive ranks the digits are grouped away one after the other, lowest first: the nodes of a run
become an array of child structs inside their parent, so a block ends as one row that holds its whole subtree. The blocks'
digests are the leaves of the next rollup, in blocks again, until a source has one block; the sources' subroots are rolled up
in the same way. On the way back every block gets the path above it, and exploding its nested children level by level emits
the paths of its leaves; no leaf meets its siblings in a join.

Ranks: the leaves are written once (digests, not texts) and range-partitioned by (source, id, digest), so a source that
holds a third of all rows is dealt over many tasks. A partition knows the place of a row in its run of equal sources; only a
partition's first source can have begun in an earlier one, so one number per partition turns places into ranks.

Bounds: a block holds at most 4,096 leaves in one row; the driver gets one row per range partition (RANGE_ROWS rows).

Defined cases: a null field counts as `-`, an empty text as `0:`; ids ascend with nulls first, rows of equal source
and id by their digest (equal rows are alike); a source with one row has that leaf as its subroot, one source has its subroot
as root; a null source is a source, the first; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.common import materialize, register
from memlake.sources.tables import read_table

#: Children of a node (a power of two) and bits of a digit.
ARITY, DIGIT_BITS = 16, 4
#: Digits grouped away inside one block.
BLOCK_DIGITS = 3
#: Rows of a range partition, about.
RANGE_ROWS = 50_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAF_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(c: Column) -> Column:
    """`-` for null, else byte count, colon and value."""
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_hash(**changed: Column) -> Column:
    """The digest of a document row, with the given columns in place of its own."""
    return F.sha2(F.concat(*[field(changed.get(c, F.col(c))) for c in LEAF_FIELDS]), 256)


def ranked(nodes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows of the written table `nodes` with `rank` (from 0) among the rows of equal `keys`, by `order`."""
    spark = nodes.sparkSession
    by = [F.col(c).asc_nulls_first() for c in [*keys, *order]]
    parts = max(1, -(-nodes.count() // RANGE_ROWS))
    # rows that are alike in every key still spread over the partitions
    dealt = (nodes.withColumn("_tie", F.monotonically_increasing_id())
             .repartitionByRange(parts, *by, "_tie").sortWithinPartitions(*by, "_tie").drop("_tie"))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, run, at, last = TaskContext.get().partitionId(), -1, 0, None
        for b in batches:
            if not b.num_rows:
                continue
            key = [tuple(x) for x in zip(*(b.column(c).to_pylist() for c in keys), strict=True)]
            runs, places = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
            for i, k in enumerate(key):
                if k != last:
                    run, at, last = run + 1, 0, k
                runs[i], places[i] = run, at
                at += 1
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.full(len(key), part, np.int64)), pa.array(runs), pa.array(places)],
                names=[*b.schema.names, "_part", "_run", "_place"])
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)
    placed = materialize(dealt.mapInArrow(places, f"{columns}, _part bigint, _run bigint, _place bigint"), "manifest_places")

    runs = placed.groupBy("_part", "_run").agg(F.count("*").alias("n"), F.first(F.struct(*keys)).alias("key"))
    edges = (runs.groupBy("_part").agg(F.min_by(F.struct("key", "n"), "_run").alias("head"),
                                       F.max_by(F.struct("key", "n"), "_run").alias("tail"),
                                       F.max("_run").alias("runs")).orderBy("_part").collect())
    skips, key, seen = [], None, 0
    for e in edges:  # `seen`: rows of the last source of the partitions before
        head = seen if e["head"]["key"] == key else 0
        skips.append((e["_part"], head))
        key, seen = e["tail"]["key"], e["tail"]["n"] + (head if e["runs"] == 0 else 0)
    skip = spark.createDataFrame(skips, "_part bigint, _skip bigint")
    return (placed.join(skip, "_part").withColumn("rank", F.col("_place") + F.when(F.col("_run") == 0, F.col("_skip")).otherwise(0))
            .drop("_part", "_run", "_place", "_skip"))


def _digest(kids: str, hashed: Column) -> Column:
    joined = F.array_join(F.transform(kids, lambda k: k["digest"]), "")
    return F.when(hashed, F.sha2(joined, 256)).otherwise(F.element_at(kids, 1)["digest"])


def nest(nodes: DataFrame, keys: list[str], carry: list[str]) -> DataFrame:
    """(*keys, block, kids, hashed, digest): one row per block of ranks with its subtree in nested structs.

    A lone node goes up as it is (`hashed` false); that is so only where it is the only one of its keys."""
    digits = [F.shiftright("rank", DIGIT_BITS * i).bitwiseAND(ARITY - 1).cast("int").alias(f"_d{i}") for i in range(BLOCK_DIGITS)]
    level = nodes.select(*keys, F.shiftright("rank", DIGIT_BITS * BLOCK_DIGITS).alias("block"), *digits,
                         F.struct("digest", "rank", *carry).alias("node"))
    level = level.repartition(*keys, "block")  # the one exchange: later groupings keep these columns
    for i in range(BLOCK_DIGITS):
        above = [f"_d{j}" for j in range(i + 1, BLOCK_DIGITS)]
        level = level.groupBy(*keys, "block", *above).agg(
            F.array_sort(F.collect_list(F.struct(F.col(f"_d{i}").alias("digit"), F.col("node")))).alias("kids"))
        level = level.withColumn("kids", F.transform("kids", lambda k: k["node"]))
        hashed = F.size("kids") > 1
        for c in ["block", *above]:
            hashed = hashed | (F.col(c) > 0)
        level = level.withColumn("hashed", hashed)
        level = level.withColumn("node", F.struct(_digest("kids", F.col("hashed")).alias("digest"), "hashed", "kids"))
    return level.select(*keys, "block", "kids", "hashed", F.col("node.digest").alias("digest"))


def climb(nodes: DataFrame, keys: list[str], carry: list[str]) -> list[DataFrame]:
    """The block tables from the leaves up, each written; the last has one block per value of `keys`."""
    stages = []
    while True:
        stages.append(materialize(nest(nodes, keys, carry if not stages else []), f"manifest_blocks{len(stages)}"))
        if not stages[-1].agg(F.max("block")).first()[0]:
            return stages
        nodes = stages[-1].select(*keys, F.col("block").alias("rank"), "digest")


def emit(blocks: DataFrame, above: DataFrame, keys: list[str], tops: list[str]) -> DataFrame:
    """The blocks' leaves with their `path`: (left, right) siblings' digests per level, lowest level first.

    `above(*keys, block, path, *tops)` has one row per block; the two rows of a block meet in a grouping."""
    blank = [F.lit(None).cast(above.schema[c].dataType).alias(c) for c in ["path", *tops]]
    both = blocks.select(*keys, "block", "kids", "hashed", *blank).unionByName(
        above.select(*keys, "block", "path", *tops), allowMissingColumns=True)
    rows = both.groupBy(*keys, "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ["kids", "hashed", "path", *tops]])
    for depth in range(BLOCK_DIGITS, 0, -1):
        rows = (rows.withColumn("sums", F.transform("kids", lambda k: k["digest"]))
                .select(*keys, "hashed", "path", *tops, "sums", F.posexplode("kids").alias("at", "kid")))
        own = F.struct(F.array_join(F.slice("sums", 1, F.col("at")), "").alias("left"),
                       F.array_join(F.slice("sums", F.col("at") + 2, ARITY), "").alias("right"))
        path = F.when(F.col("hashed"), F.concat(F.array(own), F.col("path"))).otherwise(F.col("path"))
        below = ["kid.hashed", "kid.kids"] if depth > 1 else ["kid.*"]
        rows = rows.select(*keys, path.alias("path"), *tops, *below)
    return rows


def manifest(leaves: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(source, doc_id, digest, *carry, rank, path, subroot, root) for every row of `leaves(source, doc_id, digest, *carry)`.

    `path`: per level, from the leaf to the root, the digests of the siblings left and right of the way (joined)."""
    own = materialize(leaves.select("source", "doc_id", "digest", *carry), "manifest_leaves")
    stages = climb(ranked(own, ["source"], ["doc_id", "digest"]), ["source"], ["doc_id", *carry])
    tops = materialize(stages[-1].select(F.lit(0).alias("whole"), "source", "digest"), "manifest_subroots")
    upper = climb(ranked(tops, ["whole"], ["source"]), ["whole"], ["source"])
    no_path = F.lit([]).cast("array<struct<left:string,right:string>>")
    above = upper[-1].select("whole", "block", no_path.alias("path"), F.col("digest").alias("root"))
    for blocks in reversed(upper):
        rows = emit(blocks, above, ["whole"], ["root"])
        above = rows.select("whole", F.col("rank").alias("block"), "path", "root")
    above = rows.select("source", F.lit(0).cast("bigint").alias("block"), "path", F.col("digest").alias("subroot"), "root")
    above = materialize(above, "manifest_tops")
    for i, blocks in reversed(list(enumerate(stages))):
        rows = emit(blocks, above, ["source"], ["subroot", "root"])
        if i:
            above = materialize(rows.select("source", F.col("rank").alias("block"), "path", "subroot", "root"), f"manifest_above{i}")
    return rows


def fold(path: Column, leaf: Column) -> Column:
    """The root that a leaf's digest gives along a path."""
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def proof_hash(path: Column) -> Column:
    """The digest of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def _sql() -> str:
    """The manifest with unrolled levels: 16 ** 7 rows a source, 16 ** 5 sources."""
    def enc(c):
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"

    def leaf(text):
        return "sha256(" + " || ".join(f"({enc(c if c != 'text' else text)})" for c in LEAF_FIELDS) + ")"

    def levels(p, key, n):
        out = []
        for k in range(n):
            out.append(f"""{p}c{k} AS (SELECT *, count(*) OVER (PARTITION BY {key}) AS c FROM {p}{k}),
{p}s{k} AS (
  SELECT a.{key}, a.i, a.c, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS lft,
         coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS rgt
  FROM {p}c{k} a JOIN {p}c{k} b ON a.{key} = b.{key} AND a.i // 16 = b.i // 16 GROUP BY a.{key}, a.i, a.c),
{p}{k + 1} AS (
  SELECT {key}, i // 16 AS i, CASE WHEN c = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h
  FROM {p}c{k} GROUP BY {key}, i // 16, c)""")
        return ",\n".join(out)

    def folds(p, key, n, start, rank):
        out, last = [], start
        for k in range(n):
            out.append(f"""{p}f{k} AS (
  SELECT x.* REPLACE (x.proof || s.lft || s.rgt AS proof,
                      CASE WHEN s.c = 1 THEN x.f ELSE sha256(s.lft || x.f || s.rgt) END AS f)
  FROM {last} x JOIN {p}s{k} s ON s.{key} = x.{key} AND s.i = x.{rank} // {16 ** k})""")
            last = f"{p}f{k}"
        return ",\n".join(out), last
    deep, wide = 7, 5
    low, after_low = folds("n", "key", deep, "start", "r")
    top, after_top = folds("m", "one", wide, "seated", "sr")
    crc = ("xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), "
           "lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) "
           "WHEN acc % 2 = 1 THEN xor(acc // 2, 3988292384) ELSE acc // 2 END), 4294967295)")
    return f"""WITH d AS (SELECT *, translate(text, '{_UPPER}', '{_LOWER}') AS low_text, {crc} AS crc,
             CASE WHEN source IS NULL THEN '' ELSE 'x' || source END AS key FROM documents),
l AS (SELECT doc_id, key, {leaf('text')} AS leaf, CASE WHEN crc % 5 = 0 THEN {leaf('low_text')} END AS forged FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r FROM l),
n0 AS (SELECT key, r AS i, leaf AS h FROM r),
{levels('n', 'key', deep)},
m0 AS (SELECT 1 AS one, key, row_number() OVER (ORDER BY key) - 1 AS i, h FROM n{deep}),
{levels('m', 'one', wide)},
start AS (SELECT *, '' AS proof, coalesce(forged, leaf) AS f FROM r),
{low},
seated AS (SELECT x.*, m0.one, m0.i AS sr, m0.h AS subroot FROM {after_low} x JOIN m0 ON m0.key = x.key),
{top}
SELECT doc_id, leaf, subroot, m{wide}.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = m{wide}.h AS verified
FROM {after_top} x JOIN m{wide} ON m{wide}.one = x.one"""


@register("op11_merkle_manifest", _sql())
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: leaf, subroot, root and proof; a fifth of the rows are folded with a tampered leaf."""
    docs = read_table(spark, sf_dir, "documents")
    forged = leaf_hash(text=F.translate("text", _UPPER, _LOWER))
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    leaves = docs.select("source", "doc_id", leaf_hash().alias("digest"), F.when(tampered, forged).alias("forged"))
    rows = manifest(leaves, ("forged",))
    folded = rows.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof_hash(F.col("path")).alias("proof_sha256"),
                         fold(F.col("path"), F.coalesce("forged", "digest")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
