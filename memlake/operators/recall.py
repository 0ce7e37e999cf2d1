"""Lookups by key and by id prefix, and per-request visibility counts."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.config import CONTEXT_LOG_NOTE, NOT_FOUND_NOTE, TOO_SHORT_NOTE
from memlake.functions.decay import decay_score
from memlake.functions.visibility import asked, visible
from memlake.session import materialize

MIN_PREFIX = 4   # shorter recall prefixes are not looked up


def lookup(mem: DataFrame, keys: DataFrame, key: str = "hash") -> DataFrame:
    """getByHash for many keys: a semi join (keys are deduplicated by the join itself)."""
    return mem.join(keys.select(key), key, "left_semi")


def recall_by_prefix(mem: DataFrame, req: DataFrame, now: int, owner=None) -> DataFrame:
    """Recall request for many requests `(request_id, prefix)`.

    Prefixes of at least 4 chars are looked up in the sorted ids (see `first_with_prefix`); one match per request
    (smallest hash), whose row is then fetched. Returns the pre-touch score and the
    touched last_accessed / access_count (the reheat). Visibility is applied to recall as well.
    """
    r = req.withColumn("_p", F.lower(F.col("prefix"))).filter(F.length("_p") >= MIN_PREFIX)
    seen = mem.filter(visible(None, owner))
    first = (first_with_prefix(seen.select("hash"), r.select("_p").distinct())
             .join(r.select("request_id", "_p"), "_p").select("request_id", "hash"))
    hits = first.join(seen.select("hash", "importance", "last_accessed", "access_count", "project",
                                  "full_text", "summary_text", "context_log", "tags"), "hash")
    return hits.select(
        "request_id", "hash", "importance",
        decay_score(now=now).alias("score"),
        "project", "tags", "full_text", "summary_text",
        F.when(F.col("context_log").isNotNull(),
               F.lit(CONTEXT_LOG_NOTE)).alias("context_log"),
        F.lit(now).cast("bigint").alias("last_accessed"),
        (F.col("access_count") + 1).cast("bigint").alias("access_count"),
        F.lit(True).alias("reheated"))


def first_with_prefix(ids: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(_p, hash): for every distinct prefix `_p` the smallest id that starts with it.

    The ids are range-partitioned and written once, whatever the lengths of the prefixes; a prefix goes to the one partition that
    holds the first id not before it, and is found there by binary search. The driver knows the last id of each partition."""
    parts = ids.repartitionByRange("hash").select("hash", F.spark_partition_id().cast("long").alias("part"))
    parts = materialize(parts, "recall_ids")
    ends = parts.groupBy("part").agg(F.max("hash").alias("last")).orderBy("last").collect()  # one row per partition
    lasts, numbers = [e["last"] for e in ends], [e["part"] for e in ends]

    @F.pandas_udf("long")
    def part_of(p: pd.Series) -> pd.Series:
        return pd.Series([numbers[i] if (i := bisect_left(lasts, x)) < len(lasts) else -1 for x in p], dtype="int64")

    def search(own: pd.DataFrame, asked_for: pd.DataFrame) -> pd.DataFrame:
        own, found = sorted(own["hash"]), []
        for p in asked_for["_p"]:
            i = bisect_left(own, p)
            if i < len(own) and own[i].startswith(p):
                found.append((p, own[i]))
        return pd.DataFrame({"_p": [f[0] for f in found], "hash": [f[1] for f in found]}, dtype=object)
    wanted = prefixes.select("_p", part_of("_p").alias("part"))
    return parts.groupBy("part").cogroup(wanted.groupBy("part")).applyInPandas(search, "_p string, hash string")


def recall_answers(mem: DataFrame, req: DataFrame, now: int, owner=None) -> DataFrame:
    """An answer for every request `(request_id, prefix)`: status `found`, `not_found` or `too_short`, what a found memory shows, and
    the sentence that the others get."""
    hits = recall_by_prefix(mem, req, now, owner)
    r = req.select(F.col("request_id").alias("_r"), "prefix")
    short = F.length(F.coalesce("prefix", F.lit(""))) < MIN_PREFIX
    status = F.when(F.col("hash").isNotNull(), "found").when(short, "too_short").otherwise("not_found")
    note = (F.when(F.col("hash").isNotNull(), F.lit(None)).when(short, F.lit(TOO_SHORT_NOTE))
            .otherwise(F.concat(F.lit(NOT_FOUND_NOTE[0]), F.col("prefix"), F.lit(NOT_FOUND_NOTE[1]))))
    j = r.join(hits, F.col("_r") == F.col("request_id"), "left")
    return j.select(F.col("_r").alias("request_id"), status.alias("status"), note.alias("note"), *[c for c in hits.columns if c != "request_id"])


def visible_counts(req: DataFrame, mem: DataFrame) -> DataFrame:
    """Per request (request_id, project, owner): how many memories it may see, and their
    importance sum, without pairing every request with every row.

    Memories are first reduced: non-secret ones per project, secret ones per (project, owner). With a
    project asked, a request meets one row of each by equality. Without one, public rows
    (or all non-secret rows in legacy mode) are one global figure - a scalar subquery - and
    secret rows join on owner.
    """
    g = (mem.groupBy("sensitivity", "project", "owner_id")
         .agg(F.count("*").alias("n"), F.sum("importance").alias("imp")))
    rp = req.select("request_id", asked(F.col("project")).alias("r_project"), asked(F.col("owner")).alias("r_owner"))

    known = F.col("sensitivity").isin("public", "internal")
    open_rows = (g.filter(F.col("sensitivity") != "secret").groupBy("project")
                 .agg(F.sum("n").alias("an"), F.sum("imp").alias("aimp"), F.sum(F.when(known, F.col("n"))).alias("kn"),
                      F.sum(F.when(known, F.col("imp"))).alias("kimp")))
    own_rows = g.filter(F.col("sensitivity") == "secret").select(
        F.col("project").alias("s_project"), F.col("owner_id").alias("s_owner"), F.col("n").alias("pn"), F.col("imp").alias("pimp"))

    def total(legacy, known, own):
        return F.when(F.col("r_owner").isNull(), F.coalesce(legacy, F.lit(0))).otherwise(F.coalesce(known, F.lit(0)) + F.coalesce(own, F.lit(0)))
    with_p = (rp.filter(F.col("r_project").isNotNull())
              .join(open_rows, F.col("project") == F.col("r_project"), "left")
              .join(own_rows, (F.col("s_project") == F.col("r_project")) & (F.col("s_owner") == F.col("r_owner")), "left")
              .select("request_id", total("an", "kn", "pn").alias("n"), total("aimp", "kimp", "pimp").alias("imp")))

    pub = g.filter(F.col("sensitivity") == "public")
    non_secret = g.filter(F.col("sensitivity") != "secret")
    pub_n, pub_imp = pub.agg(F.sum("n")).scalar(), pub.agg(F.sum("imp")).scalar()
    ns_n, ns_imp = non_secret.agg(F.sum("n")).scalar(), non_secret.agg(F.sum("imp")).scalar()
    secret_by_owner = (g.filter(F.col("sensitivity") == "secret")
                       .groupBy("owner_id").agg(F.sum("n").alias("sn"), F.sum("imp").alias("simp")))
    no_p = (rp.filter(F.col("r_project").isNull())
            .join(secret_by_owner, F.col("owner_id") == F.col("r_owner"), "left")
            .select("request_id",
                    F.when(F.col("r_owner").isNull(), F.coalesce(ns_n, F.lit(0)))
                     .otherwise(F.coalesce(pub_n, F.lit(0)) + F.coalesce("sn", F.lit(0))).alias("n"),
                    F.when(F.col("r_owner").isNull(), F.coalesce(ns_imp, F.lit(0.0)))
                     .otherwise(F.coalesce(pub_imp, F.lit(0.0)) + F.coalesce("simp", F.lit(0.0))).alias("imp")))

    counts = with_p.unionByName(no_p)
    return (rp.select("request_id").join(counts, "request_id", "left")
            .select("request_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_visible"),
                    F.coalesce("imp", F.lit(0.0)).cast("double").alias("importance_sum")))
