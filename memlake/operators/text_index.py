"""A kept full-text index: written once, changed by segments, searched with score bounds.

Layout below the index folder, all plain Parquet, one sub-folder per segment:

* `postings/seg=s/bucket=b`: one row per (term, range): the memories of that range which hold the term, with frequency,
  length and positions, and the block's largest frequency and smallest length. A bucket is a hash of the term, a range a hash
  of the memory id; ranges hold about RANGE_DOCS memories, so a block is bounded however common its term is.
* `terms/seg=s/bucket=b`: document frequency of each term, as a change to the earlier segments.
* `docs/seg=s`: id, length, visibility columns and distinct terms with their places of each memory; the postings are made from it.
* `gone/seg=s`: ids whose rows in earlier segments no longer count.
* `totals/seg=s`: changes of the number of memories and of the sum of lengths; written last, a segment without it is not read.

A change batch (inserts, replacements, deletes) becomes one new segment that holds the batch's own postings and, read from
`docs`, what the replaced and deleted rows take away. Readers merge the segments; `compact` writes them as one.

Search reads the buckets of the queries' terms only. Top-k is pruned exactly with block bounds (the block-max idea of Ding and Suel,
2011): a query's score in a range is at most the sum of its terms' bounds there, and a range in which a term is missing has no match. The
most promising ranges of each query are scored first; ranges whose bound is below the k-th score found are never opened. The blocks of a range
are brought together once, whole, and a kernel scores its queries there; only matches leave it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.config import BM25_B, BM25_K1, IDF_FLOOR
from memlake.functions.visibility import visible
from memlake.operators.search import SIM_RESOLUTION, SMALL_ROWS, doc_terms, query_phrases
from memlake.session import ensure_checkpoint_dir, materialize

BUCKETS = 64            # folders of postings; raise with the vocabulary
RANGE_DOCS = 512        # memories in a range, about
SLOT_RANGES = 2048      # ranges that one writing task takes of a bucket when an index is compacted
PART_RANGES = 8         # ranges that one task finds the terms of, about
ENTRIES_AT_ONCE = 1 << 20   # entries of whole ranges that are made into blocks together, about
FIRST_RANGES = 4        # ranges of a query that are scored before the others
SORTED_BYTES = 16 << 20 # bytes of stored terms whose blocks one task sorts, about: more would be sorted on disk
CODEC = "zstd"          # of the large parts
DOC_COLUMNS = ["hash", "sensitivity", "project", "owner_id"]


# ------------------------------------------------------------------ the index


@dataclass
class TextIndex:
    """The segments of an index folder as they were when it was opened."""

    spark: SparkSession
    paths: list[str]  # folders that hold the segments, oldest first
    segments: list[int]
    buckets: int
    ranges: int
    n_docs: int
    sum_dl: int

    @property
    def avgdl(self) -> float:
        return self.sum_dl / self.n_docs if self.n_docs and self.sum_dl else 1.0

    def part(self, name: str) -> DataFrame:
        # declared: a part without rows has no file to infer its columns from
        parts = [self.spark.read.schema(f"{PARTS[name]}, seg int").parquet(f"{p}/{name}") for p in self.paths]
        return reduce(DataFrame.unionByName, parts).where(F.col("seg").isin(self.segments))

    def gone(self) -> DataFrame | None:
        """(hash, dead): rows of `hash` in segments before `dead` do not count; None in a fresh index."""
        if len(self.segments) == 1:
            return None
        return self.part("gone").groupBy("hash").agg(F.max("seg").alias("dead"))

    def alive(self, rows: DataFrame) -> DataFrame:
        """The rows (hash, seg, ...) that no later segment has replaced or deleted."""
        gone = self.gone()
        if gone is None:
            return rows
        return rows.join(gone, "hash", "left").where("dead IS NULL OR seg >= dead").drop("dead")

    def docs(self) -> DataFrame:
        return self.alive(self.part("docs").select(*DOC_COLUMNS, "dl", F.col("entries.term").alias("terms"), "seg"))

    def in_buckets(self, name: str, terms: DataFrame) -> DataFrame:
        """A part's rows in the buckets of `terms(term)`: other folders are not listed or read."""
        own = [r[0] for r in terms.select(_bucket(F.col("term"), self.buckets)).distinct().collect()]  # at most `buckets` numbers
        return self.part(name).where(F.col("bucket").isin(own))


def _small(keys: DataFrame) -> DataFrame:
    """Written short keys, sent to every task where they are few, so that what meets them is not shuffled."""
    return F.broadcast(keys) if keys.count() <= SMALL_ROWS else keys


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _range(ranges: int) -> Column:
    return F.pmod(F.xxhash64("hash"), F.lit(ranges)).cast("int")


def _write_blocks(entries: DataFrame, path: str) -> None:
    """One row per (term, range), in folders per bucket; a task takes SLOT_RANGES ranges of a bucket."""
    cols = ("hash", "tf", "dl", "at")
    entries = entries.withColumn("slot", (F.col("rng") / SLOT_RANGES).cast("int")).repartition("bucket", "slot")
    blocks = entries.groupBy("bucket", "slot", "term", "rng").agg(
        F.array_sort(F.collect_list(F.struct(*cols))).alias("e"), F.count("*").alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"))
    blocks = blocks.select("bucket", "term", "rng", "n", "max_tf", "min_dl", *[F.col(f"e.{c}").alias(c) for c in cols])
    blocks.sortWithinPartitions("bucket", "term", "rng").write.option("compression", CODEC).partitionBy("bucket").parquet(path)


def _invert(docs: pa.Table) -> pa.RecordBatch:
    """The blocks of some memories (hash, rng, dl, entries) in the order of their ranges: one row per (term, range)."""
    docs = docs.combine_chunks()
    lists = docs["entries"].combine_chunks()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    terms, ats = lists.flatten().flatten()
    coded = terms.dictionary_encode()
    code, doc = coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(code * max(1, len(sizes)) + doc)
    code, doc, ats = code[order], doc[order], ats.take(pa.array(order))
    rng, dl = docs["rng"].to_numpy()[doc], docs["dl"].to_numpy()[doc].astype(np.int32)
    tf = pc.list_value_length(ats).to_numpy(zero_copy_only=False).astype(np.int32)
    first = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(rng, prepend=-1) != 0))
    edges = pa.array(np.append(first, len(code)).astype(np.int32))

    def per_block(values):
        return pa.ListArray.from_arrays(edges, values)
    most, least = (ufunc.reduceat(x, first) if len(first) else x for ufunc, x in ((np.maximum, tf), (np.minimum, dl)))
    hashes = docs["hash"].combine_chunks().take(pa.array(doc))
    columns = [coded.dictionary.take(pa.array(code[first])), pa.array(rng[first]), pa.array(np.diff(edges.to_numpy()), pa.int64()), pa.array(most),
               pa.array(least), per_block(hashes), per_block(pa.array(tf)), per_block(pa.array(dl)), per_block(ats)]
    return pa.RecordBatch.from_arrays(columns, ["term", "rng", "n", "max_tf", "min_dl", "hash", "tf", "dl", "at"])


BLOCK_SCHEMA = ("term string, rng int, n long, max_tf int, min_dl int, hash array<string>, tf array<int>, dl array<int>, "
                "at array<array<long>>")


PARTS = {"postings": f"{BLOCK_SCHEMA}, bucket int", "terms": "term string, df long, bucket int", "gone": "hash string",
         "docs": "hash string, rng int, sensitivity string, project string, owner_id string, dl long, entries array<struct<term:string,at:array<long>>>"}


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of memories that come range by range. Whole ranges are taken together, up to a bounded number of entries."""
    held, size = [], 0
    for batch in batches:
        rng = batch["rng"].to_numpy()
        starts = [0, *(np.flatnonzero(np.diff(rng)) + 1).tolist(), len(rng)]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            part = batch.slice(a, b - a)
            other = held and held[-1]["rng"][-1].as_py() != rng[a]
            if held and (size >= ENTRIES_AT_ONCE if other else size >= 8 * ENTRIES_AT_ONCE):
                yield _invert(pa.Table.from_batches(held))
                held, size = [], 0
            held.append(part)
            size += pc.sum(pc.list_value_length(part["entries"])).as_py() or 0
    if held:
        yield _invert(pa.Table.from_batches(held))


def _write_segment(rows: DataFrame, gone: DataFrame, lost: DataFrame, path: str, seg: int, buckets: int, ranges: int) -> None:
    """One segment: postings of `rows`, ids `gone`, and the stored docs `lost` that they take away.

    The memories are dealt out by range before their terms are found, so that the blocks of a range are made where its
    memories are: entries are not shuffled."""
    spark = rows.sparkSession
    dealt = (rows.select("hash", "summary_text", "essence_text", "tags", *DOC_COLUMNS[1:], _range(ranges).alias("rng"))
             .repartition(max(1, ranges // PART_RANGES), "rng").sortWithinPartitions("rng", "hash"))
    doc_terms(dealt, "rng", *DOC_COLUMNS[1:]).write.option("compression", CODEC).parquet(f"{path}/docs/seg={seg}")
    own = spark.read.schema(PARTS["docs"]).parquet(f"{path}/docs/seg={seg}")
    blocks = (own.select("hash", "rng", "dl", "entries").mapInArrow(_blocks, BLOCK_SCHEMA)
              .withColumn("bucket", _bucket(F.col("term"), buckets)))
    blocks = blocks.sortWithinPartitions("bucket", "term", "rng")
    usual = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", SORTED_BYTES)
    try:
        blocks.write.option("compression", CODEC).partitionBy("bucket").parquet(f"{path}/postings/seg={seg}")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", usual)
    taken = lost.select(F.explode("terms").alias("term"), F.lit(-1).cast("long").alias("df"))
    written = spark.read.schema(f"{BLOCK_SCHEMA}, bucket int").parquet(f"{path}/postings/seg={seg}")
    df = (written.select("term", F.col("n").alias("df")).unionByName(taken)
          .withColumn("bucket", _bucket(F.col("term"), buckets)).groupBy("bucket", "term").agg(F.sum("df").alias("df")).where("df <> 0"))
    df.repartition("bucket").sortWithinPartitions("term").write.partitionBy("bucket").parquet(f"{path}/terms/seg={seg}")
    gone.select("hash").distinct().write.parquet(f"{path}/gone/seg={seg}")
    n, dl = own.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    n0, dl0 = lost.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    total = spark.createDataFrame([(n - n0, dl - dl0, buckets, ranges)], "n_docs long, sum_dl long, buckets int, ranges int")
    total.coalesce(1).write.parquet(f"{path}/totals/seg={seg}")


def fresh_folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/text_index-{uuid.uuid4().hex[:12]}"


def _no_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "hash string, dl long, terms array<string>")


def create_index(mem: DataFrame, path: str | None = None, buckets: int = BUCKETS, range_docs: int = RANGE_DOCS) -> TextIndex:
    """Write the index of `mem` (one row per hash) into a new folder and open it."""
    spark = mem.sparkSession
    path = path or fresh_folder(spark)
    ranges = max(1, -(-mem.select("hash").count() // range_docs))
    _write_segment(mem, mem.select("hash").limit(0), _no_docs(spark), path, 0, buckets, ranges)
    return open_index(spark, path)


def open_index(spark: SparkSession, *paths: str) -> TextIndex:
    """The index as of its last complete segment; later folders hold later segments."""
    rows = [r for p in paths for r in spark.read.parquet(f"{p}/totals").collect()]  # one row per segment
    return TextIndex(spark, list(paths), sorted(r["seg"] for r in rows), rows[0]["buckets"], rows[0]["ranges"],
                     sum(r["n_docs"] for r in rows), sum(r["sum_dl"] for r in rows))


def apply_changes(index: TextIndex, changed: DataFrame | None = None, deleted: DataFrame | None = None,
                  path: str | None = None) -> TextIndex:
    """Add a segment: `changed` memory rows (one per hash) are inserted or replace their hash, `deleted(hash)` go.

    The segment goes into the index's own folder or, with `path`, into another one, so that the index as it was stays as it is."""
    if changed is None and deleted is None:
        return index
    gone = [d.select("hash") for d in (changed, deleted) if d is not None]
    gone = materialize((gone[0] if len(gone) == 1 else gone[0].unionByName(gone[1])).distinct(), "index_gone")
    if changed is None:
        schema = "hash string, summary_text string, essence_text string, tags array<string>, sensitivity string, project string, owner_id string"
        changed = index.spark.createDataFrame([], schema)
    lost = materialize(index.docs().join(_small(gone), "hash", "left_semi").select("hash", "dl", "terms"), "index_lost")
    paths = index.paths if path in (None, index.paths[-1]) else [*index.paths, path]
    _write_segment(changed, gone, lost, paths[-1], index.segments[-1] + 1, index.buckets, index.ranges)
    return open_index(index.spark, *paths)


def compact(index: TextIndex, path: str | None = None) -> TextIndex:
    """The same index as one segment in a new folder: live entries regrouped, no text read again."""
    spark = index.spark
    path = path or f"{index.paths[0]}-{uuid.uuid4().hex[:8]}"
    entries = index.alive(_entries(index.part("postings"), "bucket"))
    _write_blocks(entries, f"{path}/postings/seg=0")
    df = index.part("terms").groupBy("bucket", "term").agg(F.sum("df").alias("df")).where("df > 0")
    df.repartition("bucket").sortWithinPartitions("term").write.partitionBy("bucket").parquet(f"{path}/terms/seg=0")
    index.alive(index.part("docs")).drop("seg").write.option("compression", CODEC).parquet(f"{path}/docs/seg=0")
    index.part("gone").limit(0).select("hash").write.parquet(f"{path}/gone/seg=0")
    spark.createDataFrame([(index.n_docs, index.sum_dl, index.buckets, index.ranges)],
                          "n_docs long, sum_dl long, buckets int, ranges int").coalesce(1).write.parquet(f"{path}/totals/seg=0")
    return open_index(spark, path)


def _entries(blocks: DataFrame, *keep: str, places: bool = True) -> DataFrame:
    """(term, rng, seg, hash, tf, dl[, at]): the blocks' entries; without `places` that column is not read."""
    cols = ["hash", "tf", "dl", *(["at"] if places else [])]
    return blocks.select(*keep, "term", "rng", "seg", F.explode(F.arrays_zip(*cols)).alias("_e")).select(
        *keep, "term", "rng", "seg", *[F.col(f"_e.{c}").alias(c) for c in cols])


# ------------------------------------------------------------------ search


@dataclass
class Search:
    """A batch of queries prepared against an index: phrases, their weights, and the ranges that can hold matches."""

    index: TextIndex
    known: DataFrame      # (query_id, phrase, times, idf, n_phrases, lead): queries all of whose phrases occur
    blocks: DataFrame     # the postings of the queries' terms
    several: DataFrame    # (phrase, rng, seg, hash, tf, dl) of the phrases of several terms
    ranges: DataFrame     # (query_id, rng, bound)


def _saturated(tf, dl, avgdl: float, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.lit(avgdl)))


def prepare(index: TextIndex, queries: DataFrame, k1: float = BM25_K1, b: float = BM25_B) -> Search:
    """Phrases, document frequencies and range bounds of `queries(query_id, query)`; no entry of a one-term phrase is opened."""
    asked = materialize(query_phrases(queries), "query_phrases")
    phrases = asked.select("phrase").distinct().withColumn("pieces", F.split("phrase", " "))
    terms = materialize(phrases.select(F.explode("pieces").alias("term")).distinct(), "query_terms")
    blocks = index.in_buckets("postings", terms).join(terms, "term", "left_semi")
    df = (index.in_buckets("terms", terms).join(terms, "term", "left_semi").groupBy(F.col("term").alias("phrase"))
          .agg(F.sum("df").alias("df")).where("df > 0"))

    # phrases of several terms: adjacent places, counted exactly
    parts = phrases.where("size(pieces) > 1").select("phrase", F.size("pieces").alias("np"), F.posexplode("pieces").alias("j", "term"))
    wanted = parts.select("term").distinct()
    places = index.alive(_entries(blocks.join(wanted, "term", "left_semi")))
    starts = (places.select("term", "rng", "seg", "hash", "dl", F.explode("at").alias("at")).join(parts, "term")
              .groupBy("phrase", "np", "rng", "seg", "hash", "dl", (F.col("at") - F.col("j")).alias("start")).agg(F.count("*").alias("c"))
              .where("c = np"))
    several = materialize(starts.groupBy("phrase", "rng", "seg", "hash", "dl").agg(F.count("*").cast("int").alias("tf")), "phrase_entries")
    one_word = asked.join(phrases.where("size(pieces) = 1").select("phrase"), "phrase", "left_semi")
    more = asked.join(phrases.where("size(pieces) > 1").select("phrase"), "phrase", "left_semi")
    weights = (one_word.join(df, "phrase", "left")
               .unionByName(more.join(several.groupBy("phrase").agg(F.count("*").alias("df")), "phrase", "left")))
    raw = F.log((F.lit(index.n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = weights.withColumn("idf", F.when(raw <= 0, F.lit(IDF_FLOOR)).otherwise(raw))
    per_query = (weights.groupBy("query_id").agg(F.count("*").alias("n_phrases"), F.count("df").alias("n_known"),
                                                 F.min_by("phrase", F.struct("df", "phrase")).alias("lead"))
                 .where("n_known = n_phrases").drop("n_known"))
    known = materialize(weights.join(per_query, "query_id"), "query_weights")

    # bounds: only the numbers of a block are read
    tops = (blocks.groupBy(F.col("term").alias("phrase"), "rng").agg(F.max("max_tf").alias("tf"), F.min("min_dl").alias("dl"))
            .unionByName(several.groupBy("phrase", "rng").agg(F.max("tf").alias("tf"), F.min("dl").alias("dl"))))
    tops = tops.select("phrase", "rng", _saturated(F.col("tf"), F.col("dl"), index.avgdl, k1, b).alias("top"))
    ranges = (known.join(tops, "phrase").groupBy("query_id", "rng", "n_phrases")
              .agg(F.sum(F.col("times") * F.col("idf") * F.col("top")).alias("bound"), F.count("*").alias("n"))
              .where("n = n_phrases").select("query_id", "rng", "bound"))
    return Search(index, known, blocks, several, materialize(ranges, "query_ranges"))


def _need(search: Search, ranges: DataFrame) -> DataFrame:
    """(term, rng): the blocks that scoring the (query_id, rng) pairs opens."""
    pairs = ranges.select("query_id", "rng").join(search.known.select("query_id", F.col("phrase").alias("term")), "query_id")
    return pairs.select("term", "rng").distinct()


def opened(search: Search, ranges: DataFrame) -> DataFrame:
    """The blocks of one-term phrases that scoring the (query_id, rng) pairs opens."""
    return search.blocks.join(_need(search, ranges), ["term", "rng"], "left_semi")


def _score_range(blocks: pd.DataFrame, asks: pd.DataFrame, avgdl: float, k1: float, b: float) -> pd.DataFrame:
    """(query_id, hash, seg, score): the matches of a range's queries among its blocks (term, seg, hash, tf, dl)."""
    columns = ["query_id", "hash", "seg", "score"]
    if not len(blocks) or not len(asks):
        return pd.DataFrame([], columns=columns)
    code, terms = pd.factorize(blocks["term"])
    blocks = blocks.iloc[np.argsort(code, kind="stable")]
    sizes = blocks["hash"].map(len).to_numpy(np.int64)
    edges = np.concatenate([[0], np.cumsum(np.bincount(np.sort(code), weights=sizes).astype(np.int64))])
    names, segs = np.concatenate(blocks["hash"].to_list()), np.repeat(blocks["seg"].to_numpy(), sizes)
    doc, pairs = pd.factorize(pd.factorize(names)[0] * (segs.max() + 1) + segs)  # a memory of another segment is another one
    first = np.zeros(len(pairs), np.int64)
    first[doc[::-1]] = np.arange(len(doc))[::-1]
    tf, dl = (np.concatenate(blocks[c].to_list()).astype(float) for c in ("tf", "dl"))
    part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
    out = []
    for query_id, lead, phrases, weights in zip(asks["query_id"], asks["lead"], asks["phrases"], asks["weights"], strict=True):
        at = terms.get_indexer([lead, *phrases])
        if (at < 0).any():
            continue
        spans = [slice(edges[t], edges[t + 1]) for t in at]
        n, score = np.zeros(len(pairs), np.int64), np.zeros(len(pairs))
        for span, weight in zip(spans[1:], weights, strict=True):
            np.add.at(n, doc[span], 1)
            np.add.at(score, doc[span], weight * part[span])
        starts = np.bincount(doc[spans[0]], minlength=len(pairs))
        hit = np.flatnonzero((starts * n == len(phrases)) & (starts > 0))
        out.append(pd.DataFrame({"query_id": query_id, "hash": names[first[hit]], "seg": segs[first[hit]], "score": (starts * score)[hit]}))
    return pd.concat(out) if out else pd.DataFrame([], columns=columns)


def score(search: Search, ranges: DataFrame, k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """(query_id, hash, score) of the memories of these (query_id, rng) pairs that match every phrase.

    The blocks of a range and its queries meet in one task: entries are not exploded or shuffled, only matches are."""
    index, known, avgdl = search.index, search.known, float(search.index.avgdl)
    need = materialize(_need(search, ranges), "query_need")
    few = need.count() <= SMALL_ROWS
    # more pairs are not worth a shuffle of the blocks of their own: the ranges' blocks of all known phrases are sent
    blocks = (search.blocks.join(F.broadcast(need), ["term", "rng"], "left_semi") if few else
              search.blocks.join(known.select(F.col("phrase").alias("term")).distinct(), "term", "left_semi"))
    several = (search.several.groupBy(F.col("phrase").alias("term"), "rng", "seg").agg(F.collect_list(F.struct("hash", "tf", "dl")).alias("e"))
               .select("term", "rng", "seg", "e.hash", "e.tf", "e.dl"))
    # an id of NULL is no memory's
    whole = F.filter(F.arrays_zip("hash", "tf", "dl"), lambda e: e["hash"].isNotNull())
    blocks = (blocks.select("term", "rng", "seg", "hash", "tf", "dl").unionByName(several).withColumn("e", whole).where("size(e) > 0")
              .select("term", "rng", "seg", "e.hash", "e.tf", "e.dl"))
    each = known.groupBy("query_id", "lead").agg(F.collect_list(F.struct("phrase", (F.col("times") * F.col("idf")).alias("weight"))).alias("p"))
    asks = ranges.select("query_id", "rng").join(each, "query_id").select("query_id", "rng", "lead", F.col("p.phrase").alias("phrases"),
                                                                          F.col("p.weight").alias("weights"))

    def kernel(there: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        return _score_range(there, asked, avgdl, k1, b)
    hits = blocks.groupBy("rng").cogroup(asks.groupBy("rng")).applyInPandas(
        kernel, f"query_id {known.schema['query_id'].dataType.simpleString()}, hash string, seg int, score double")
    return index.alive(hits).select("query_id", "hash", "score")


def _seen(search: Search, hits: DataFrame, owner, project, scope: DataFrame | None) -> DataFrame:
    """The hits their requester may see."""
    rows = hits.join(search.index.docs().select(*DOC_COLUMNS), "hash")
    if scope is None:
        rows = rows.where(visible(project, owner))
    else:
        own = scope.select("query_id", F.col("scope_project").alias("_sp"), F.col("owner").alias("_so"))
        rows = rows.join(own, "query_id").where(visible(F.col("_sp"), F.col("_so")))
    return rows.select("query_id", "hash", "score")


def search_top(index: TextIndex, queries: DataFrame, limit: int, owner=None, project=None, scope: DataFrame | None = None,
               prune: bool = True, first_ranges: int = FIRST_RANGES) -> DataFrame:
    """(query_id, hash, score, rank, pos): the best `limit` visible matches of every query (rank = -score, then hash).

    With `prune`, the ranges with the best bounds are scored first and the others only where their bound reaches the score
    at place `limit` among those; the answer is the same."""
    search = prepare(index, queries)
    if prune:
        first, rest, hits = two_steps(search, limit, owner, project, scope, first_ranges)
        hits = hits.unionByName(_seen(search, score(search, rest), owner, project, scope))
    else:
        hits = _seen(search, score(search, search.ranges), owner, project, scope)
    w = Window.partitionBy("query_id").orderBy(F.round("rank", SIM_RESOLUTION), "hash")
    return (hits.withColumn("rank", -F.col("score")).withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= limit)
            .select("query_id", "hash", "score", "rank", "pos"))


def two_steps(search: Search, limit: int, owner=None, project=None, scope: DataFrame | None = None,
              first_ranges: int = FIRST_RANGES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ranges scored first, ranges still to score, visible hits of the first)."""
    w = Window.partitionBy("query_id").orderBy(F.desc("bound"), "rng")
    ranked = search.ranges.withColumn("_i", F.row_number().over(w))
    first = ranked.where(F.col("_i") <= first_ranges).drop("_i")
    hits = materialize(_seen(search, score(search, first), owner, project, scope), "first_hits")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"))
    floor = hits.withColumn("_i", F.row_number().over(best)).where(F.col("_i") == limit).select("query_id", F.col("score").alias("floor"))
    # scores are ranked at 1e-9: a bound that is equal at that resolution is opened too
    rest = (ranked.where(F.col("_i") > first_ranges).join(floor, "query_id", "left")
            .where(F.col("floor").isNull() | (F.col("bound") + 2 * 10.0 ** -SIM_RESOLUTION >= F.col("floor"))).select("query_id", "rng", "bound"))
    return first, materialize(rest, "rest_ranges"), hits


# ------------------------------------------------------------------ kept beside a table


def table_state(spark: SparkSession, path: str) -> str:
    """A name for the present state of a table's files (paths, sizes, times); no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    file = F.concat_ws(":", "path", F.col("length").cast("string"), F.col("modificationTime").cast("string"))
    return files.agg(F.sha2(F.concat_ws("|", F.array_sort(F.collect_list(file))), 256)).first()[0][:16]


def kept(spark: SparkSession, name: str, last: str, build) -> str:
    """A complete folder of this name below the shared checkpoint folder, made by `build(folder)` where there is none.

    `last` is the table that `build` writes last: a folder without it is another run's unfinished one and not read."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/kept/{name}"
    try:
        done = spark.read.parquet(f"{base}/*/{last}").select(F.min("_metadata.file_path")).first()[0]
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = None
    if done:
        return f"{base}/{done.split(f'/kept/{name}/')[1].split('/')[0]}"
    path = f"{base}/{uuid.uuid4().hex[:12]}"
    build(path)
    return path


def kept_index(spark: SparkSession, mem: DataFrame, state: str) -> TextIndex:
    """The index of `mem` for this `state` of its source: built at the first call, opened at later ones."""
    return open_index(spark, kept(spark, f"text_index-v2-{state}", "totals", lambda path: create_index(mem, path)))
