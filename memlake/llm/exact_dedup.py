"""Exact dedup: binary-fuse filters of an immutable snapshot screen a new batch.

1. Rows become (digest, doc_id, copies), pre-aggregated before the shuffle; copies of one text
   collapse to one (digest, smallest id, count) group per side.
2. The snapshot's digests are dealt into blocks of bounded size; each block builds one static
   binary-fuse filter. The batch's distinct digests meet the filter of their block.
3. A negative is certainly new: its copies are grouped within the batch alone. Positives join the
   snapshot's exact digests.
4. Every group of two or more rows is checked byte by byte against its representative's text.
   The representative is repeated once per CHUNK members, so a hot group spreads over tasks.
   Rows whose bytes differ (a digest collision) leave the group and are grouped by whole text.

Defined cases: a null text counts as empty; an empty text is a text like any other. A row without
an id takes part, is kept only when no row of its group has an id, and then has keep_id null. Of rows that
repeat both id and text one stays. Of an empty table the result is empty. Other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm import fuse
from memlake.llm.common import materialize, register, text_of
from memlake.sources.tables import read_table

#: Keys of one filter block; a block is built by one task.
KEYS_PER_FILTER = 1 << 15
#: Members of a group that are compared with one copy of its representative.
CHUNK = 64
#: ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(doc_id, body, digest): the text with every run of white space as one space, and its digest."""
    return (docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                        F.regexp_replace(text_of(text_col), SPACE, " ").alias("body"))
            .withColumn("digest", digest(F.col("body"))))


def digest_counts(rows: DataFrame) -> DataFrame:
    """(digest, doc_id, copies): the rows without their texts."""
    return rows.groupBy("digest", "doc_id").agg(F.count("*").alias("copies"))


def digest_groups(counts: DataFrame) -> DataFrame:
    """(digest, keep_id, members): partial aggregation collapses hot digests before the shuffle."""
    return counts.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("members"))


def _keys(digests) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(d)[:8].ljust(8, b"\0") for d in digests), np.uint64)


def with_block(groups: DataFrame, blocks: int) -> DataFrame:
    return groups.withColumn("block", F.pmod(F.xxhash64("digest"), F.lit(blocks)))


def build_filters(snapshot: DataFrame, blocks: int) -> DataFrame:
    """One binary-fuse filter (block, filter) per block of the snapshot's distinct digests."""
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "filter": [fuse.build(_keys(pdf["digest"]))]})
    return (with_block(snapshot.select("digest"), blocks).groupBy("block")
            .applyInPandas(one, "block bigint, filter binary"))


def screen(batch: DataFrame, filters: DataFrame, blocks: int) -> DataFrame:
    """The batch's distinct digests with `maybe`: false only where the snapshot lacks the digest."""
    def probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        hit = (fuse.contains(right["filter"].iloc[0], _keys(left["digest"])) if len(right) and len(left)
               else np.zeros(len(left), bool))
        return left[["digest", "keep_id", "members"]].assign(maybe=hit)
    schema = "digest binary, keep_id bigint, members bigint, maybe boolean"
    return (with_block(batch, blocks).groupBy("block").cogroup(filters.groupBy("block"))
            .applyInPandas(probe, schema))


def merge_batch(snapshot: DataFrame, batch: DataFrame, keys_per_filter: int = KEYS_PER_FILTER) -> DataFrame:
    """Digest groups of snapshot and batch together: (digest, keep_id, members).

    `snapshot` and `batch` are digest groups. Negatives of the screen skip the join."""
    blocks = max(1, -(-snapshot.count() // keys_per_filter))
    screened = materialize(screen(batch, build_filters(snapshot, blocks), blocks), "exact_screen")
    hits = screened.where("maybe").select("digest", F.col("keep_id").alias("new_id"), F.col("members").alias("more"))
    known = (snapshot.join(hits, "digest", "full")
             .select("digest", F.least("keep_id", "new_id").alias("keep_id"),
                     (F.coalesce("members", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("members")))
    return known.unionByName(screened.where(~F.col("maybe")).select("digest", "keep_id", "members"))


def byte_mismatches(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(digest, doc_id, body) of the rows whose bytes differ from their group's representative."""
    several = groups.where("members > 1").withColumn("chunks", F.ceil(F.col("members") / CHUNK))
    bucket = materialize(rows.join(several, "digest")
                         .withColumn("slot", F.pmod(F.xxhash64("doc_id"), "chunks")), "exact_bucket")
    first = (bucket.where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
             .groupBy("digest").agg(F.first("body").alias("first_body"), F.first("chunks").alias("chunks"))
             .select("digest", "first_body", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("slot")))
    return (bucket.select("digest", "slot", "doc_id", "body")
            .join(first.withColumn("slot", F.col("slot").cast("bigint")), ["digest", "slot"])
            .where("body <> first_body").select("digest", "doc_id", "body"))


def exact_dedup(rows: DataFrame, is_snapshot: Column) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, digest.

    `rows` is `text_rows`; `is_snapshot` tells from doc_id whether a row belongs to the stored
    snapshot (true) or to the new batch (false or null)."""
    counts = materialize(digest_counts(rows), "exact_counts")
    old = F.coalesce(is_snapshot, F.lit(False))
    snapshot = materialize(digest_groups(counts.where(old)), "exact_snapshot")
    groups = materialize(merge_batch(snapshot, digest_groups(counts.where(~old))), "exact_groups")
    odd = materialize(byte_mismatches(rows, groups), "exact_odd")

    # rows with other bytes than their group leave it; they form groups by whole text
    gone = odd.groupBy("digest", "doc_id").agg(F.count("*").alias("gone"))
    less = gone.groupBy("digest").agg(F.sum("gone").alias("less"))
    main = (counts.join(gone, (counts["digest"] == gone["digest"]) & counts["doc_id"].eqNullSafe(gone["doc_id"]), "left")
            .select(counts["digest"], counts["doc_id"],
                    (F.col("copies") - F.coalesce("gone", F.lit(0))).alias("copies"))
            .where("copies > 0"))
    sizes = (groups.join(less, "digest", "left")
             .select("digest", "keep_id", (F.col("members") - F.coalesce("less", F.lit(0))).alias("group_size")))
    odd_counts = odd.groupBy("digest", "body", "doc_id").agg(F.count("*").alias("copies"))
    odd_sizes = odd_counts.groupBy("digest", "body").agg(F.min("doc_id").alias("keep_id"),
                                                         F.sum("copies").alias("group_size"))
    columns = ["doc_id", "keep_id", "group_size", "copies", "digest"]
    every = (main.join(sizes, "digest").select(*columns)
             .unionByName(odd_counts.join(odd_sizes, ["digest", "body"]).select(*columns)))
    return (every.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
            .select("doc_id", "keep_id", "group_size",
                    (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "digest"))


@register("op1_exact_dedup", r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
""")
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against the others: the lower half of the id range is the stored snapshot,
    the upper half the incoming batch."""
    docs = read_table(spark, sf_dir, "documents")
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    middle = None if low is None else (low + high) // 2
    return (exact_dedup(text_rows(docs), F.col("doc_id") <= F.lit(middle).cast("bigint"))
            .withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest"))
