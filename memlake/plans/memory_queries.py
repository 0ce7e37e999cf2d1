"""Registered queries: scoring, visibility, candidates, statistics and table changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.config import NOW, UNTAGGED
from memlake.functions.decay import decay_score, hours_since, threshold_scale
from memlake.functions.text import content_id, utf16_length
from memlake.functions.visibility import scope_clamp, visible
from memlake.operators import candidates as C
from memlake.operators import changes as W
from memlake.operators import recall as R
from memlake.plans.common import joined, r6, register
from memlake.sources import fixtures as FX
from memlake.sources.tables import read_table

SCORE_SQL = "importance * exp(-0.01 * greatest(0.0, ({now} - last_accessed) / 3600.0::DOUBLE))".format(now=NOW)
TIER_SQL = """CASE WHEN {s} >= 2.0 THEN 'hot' WHEN {s} >= 1.0 THEN 'warm' WHEN {s} >= 0.3 THEN 'cool'
  WHEN {s} >= 0.01 THEN 'faded' ELSE 'gone' END"""
LEGACY = "sensitivity <> 'secret'"


def tier_sql(expr: str) -> str:
    return TIER_SQL.format(s=expr)


# ---------------------------------------------------------------- P1 / P2 / P3 / P5


@register("decay_score", f"""
SELECT hash, importance, round(({NOW} - last_accessed) / 3600.0::DOUBLE, 6) AS hours_since,
       round({SCORE_SQL}, 6) AS score
FROM memories""")
def q_decay_score(spark, sf):
    m = FX.memories(spark, sf)
    return m.select("hash", "importance", r6(hours_since(now=NOW)).alias("hours_since"),
                    r6(decay_score(now=NOW)).alias("score"))


@register("fidelity", f"""
SELECT hash, round({SCORE_SQL}, 6) AS score, {tier_sql(SCORE_SQL)} AS fidelity FROM memories""")
def q_fidelity(spark, sf):
    m = C.scored(FX.memories(spark, sf), NOW)
    return m.select("hash", r6("score").alias("score"), "fidelity")


@register("hot_hours", """
SELECT hash, importance, CAST(floor(ln(importance / 2.0) / 0.01 + 0.5) AS BIGINT) AS hot_hours
FROM memories""")
def q_hot_hours(spark, sf):
    return C.with_hot_hours(FX.memories(spark, sf))


EFF_SQL_LEN = "(length(essence_text) + length(regexp_replace(essence_text, '[\\x{0}-\\x{FFFF}]', '', 'g')))"


@register("effective_thresholds", f"""
b AS (SELECT coalesce(project, '{UNTAGGED}') AS project, CAST(sum({EFF_SQL_LEN}) AS BIGINT) AS budget
      FROM memories GROUP BY 1),
s AS (SELECT project, budget, 1.0 / greatest(0.1, budget / 8000.0::DOUBLE) AS k FROM b)
SELECT project, budget, round(2.0 * k, 6) AS hot, round(1.0 * k, 6) AS warm,
       round(0.3 * k, 6) AS cool, round(0.01 * k, 6) AS faded FROM s""")
def q_effective_thresholds(spark, sf):
    """Thresholds scaled for a per-project budget (sum of essence lengths) against 8000."""
    m = FX.memories(spark, sf)
    b = (m.groupBy(F.coalesce("project", F.lit(UNTAGGED)).alias("project"))
         .agg(F.sum(utf16_length("essence_text")).cast("bigint").alias("budget")))
    k = threshold_scale("budget", F.lit(8000.0))
    return b.select("project", "budget", r6(k * 2.0).alias("hot"), r6(k * 1.0).alias("warm"),
                    r6(k * 0.3).alias("cool"), r6(k * 0.01).alias("faded"))


# ---------------------------------------------------------------- F1 - F4


@register("visible_legacy", f"SELECT hash, sensitivity FROM memories WHERE {LEGACY}")
def q_visible_legacy(spark, sf):
    return FX.memories(spark, sf).filter(visible()).select("hash", "sensitivity")


VIS_PRED = """(CASE WHEN r.owner IS NULL THEN m.sensitivity <> 'secret'
   ELSE coalesce(m.sensitivity = 'public' OR (m.sensitivity = 'internal' AND m.project = r.project)
                 OR (m.sensitivity = 'secret' AND m.owner_id = r.owner), false) END)
  AND (r.project IS NULL OR coalesce(m.project = r.project, false))"""


@register("visible_with_owner", f"""
SELECT r.request_id, count(m.hash) AS n_visible, coalesce(sum(m.importance), 0.0) AS importance_sum
FROM requests r LEFT JOIN memories m ON {VIS_PRED}
GROUP BY r.request_id""")
def q_visible_with_owner(spark, sf):
    return R.visible_counts(FX.requests(spark, sf), FX.memories(spark, sf))


@register("scope_clamp", """
SELECT request_id, CASE WHEN allowed IS NULL THEN project
  WHEN project IS NOT NULL AND list_contains(allowed, project) THEN project
  ELSE allowed[1] END AS scoped_project
FROM requests""")
def q_scope_clamp(spark, sf):
    r = FX.requests(spark, sf)
    return r.select("request_id", scope_clamp("project", "allowed").alias("scoped_project"))


# ---------------------------------------------------------------- T1 / A1 - A5


@register("top_candidates", f"""
SELECT hash, importance, last_accessed, round({SCORE_SQL}, 6) AS score, {tier_sql(SCORE_SQL)} AS fidelity
FROM memories WHERE {LEGACY}
ORDER BY importance DESC, last_accessed DESC, hash LIMIT 50""")
def q_top_candidates(spark, sf):
    t = C.scored(C.top_candidates(FX.memories(spark, sf), 50), NOW)
    return t.select("hash", "importance", "last_accessed", r6("score").alias("score"), "fidelity")


@register("top_candidates_per_project", f"""
SELECT project, row_number() OVER (PARTITION BY project ORDER BY importance DESC, last_accessed DESC, hash) AS rank,
       hash, importance, last_accessed
FROM memories WHERE {LEGACY} AND project IS NOT NULL
QUALIFY rank <= 50""")
def q_top_candidates_per_project(spark, sf):
    t = C.top_candidates_per_project(FX.memories(spark, sf), 50)
    return t.select("project", "rank", "hash", "importance", "last_accessed")


@register("stats_total", "SELECT count(*) AS total FROM memories")
def q_stats_total(spark, sf):
    return C.stats_total(FX.memories(spark, sf))


@register("stats_by_project", f"SELECT coalesce(project, '{UNTAGGED}') AS project, count(*) AS n FROM memories GROUP BY 1")
def q_stats_by_project(spark, sf):
    return C.stats_by_project(FX.memories(spark, sf))


@register("stats_by_type", "SELECT memory_type, count(*) AS n FROM memories GROUP BY 1")
def q_stats_by_type(spark, sf):
    return C.stats_by_type(FX.memories(spark, sf))


@register("distinct_projects", f"""
SELECT coalesce(project, '{UNTAGGED}') AS project, count(*) AS n FROM memories GROUP BY 1 ORDER BY n DESC, project""")
def q_distinct_projects(spark, sf):
    return C.distinct_projects(FX.memories(spark, sf))


TIERS_SQL = "tiers AS (SELECT * FROM (VALUES ('hot'), ('warm'), ('cool'), ('faded'), ('gone')) t(fidelity))"


@register("fidelity_distribution_top100", f"""
{TIERS_SQL},
top AS (SELECT {tier_sql(SCORE_SQL)} AS fidelity FROM memories WHERE {LEGACY}
        ORDER BY importance DESC, last_accessed DESC, hash LIMIT 100)
SELECT t.fidelity, CAST(count(top.fidelity) AS BIGINT) AS n FROM tiers t LEFT JOIN top USING (fidelity) GROUP BY t.fidelity""")
def q_fidelity_distribution_top100(spark, sf):
    return C.fidelity_distribution_top(spark, FX.memories(spark, sf), NOW, 100)


@register("fidelity_distribution_all", f"""
{TIERS_SQL},
a AS (SELECT {tier_sql(SCORE_SQL)} AS fidelity FROM memories WHERE {LEGACY})
SELECT t.fidelity, CAST(count(a.fidelity) AS BIGINT) AS n FROM tiers t LEFT JOIN a USING (fidelity) GROUP BY t.fidelity""")
def q_fidelity_distribution_all(spark, sf):
    m = FX.memories(spark, sf).filter(visible())
    return C.fidelity_distribution(spark, m, NOW)


# ---------------------------------------------------------------- S1 / S2 / P7


MEM_OUT_SQL = """hash, created_at, last_accessed, access_count, importance, explicit_save, memory_type,
  sensitivity, project, session_id, owner_id, array_to_string(tags, ',') AS tags"""
MEM_OUT = ["hash", "created_at", "last_accessed", "access_count", "importance", "explicit_save",
           "memory_type", "sensitivity", "project", "session_id", "owner_id"]


def mem_out(df):
    return df.select(*MEM_OUT, joined("tags").alias("tags"))


@register("scan_all", f"SELECT {MEM_OUT_SQL} FROM memories ORDER BY created_at DESC")
def q_scan_all(spark, sf):
    return mem_out(FX.memories(spark, sf).orderBy(F.desc("created_at"), "hash"))


LOOKUP_KEYS_SQL = """keys AS (
  SELECT m.hash FROM labels l JOIN memories_d m USING (doc_id)
  UNION ALL SELECT concat('0000', lpad(CAST(doc_id AS VARCHAR), 12, '0')) FROM labels)"""


def lookup_keys(spark, sf):
    lab = read_table(spark, sf, "labels").select("doc_id")
    hit = lab.join(FX.memories_with_doc(spark, sf).select("doc_id", "hash"), "doc_id").select("hash")
    miss = lab.select(F.concat(F.lit("0000"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("hash"))
    return hit.unionByName(miss)


@register("lookup_by_hash", f"""
{LOOKUP_KEYS_SQL}
SELECT hash, importance, project FROM memories WHERE hash IN (SELECT hash FROM keys)""")
def q_lookup_by_hash(spark, sf):
    m = FX.memories(spark, sf)
    return R.lookup(m, lookup_keys(spark, sf)).select("hash", "importance", "project")


@register("content_ids", f"""
SELECT d.doc_id,
  substr(sha256(concat('{NOW}', ':', d.text)), 1, 16) AS store_id,
  substr(sha256(concat('{NOW * 1000}', ':', f.path)), 1, 16) AS snapshot_id,
  substr(sha256(concat(f.path, ':chunk0:', '{NOW}')), 1, 16) AS chunk0_id
FROM documents d JOIN document_files f ON f.path = concat('/docs/', d.source, '/doc_', CAST(d.doc_id AS VARCHAR), '.md')""")
def q_content_ids(spark, sf):
    d = read_table(spark, sf, "documents")
    path = F.concat(F.lit("/docs/"), F.col("source"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".md"))
    return d.select(
        "doc_id",
        content_id(str(NOW), ":", F.col("text")).alias("store_id"),
        content_id(str(NOW * 1000), ":", path).alias("snapshot_id"),
        content_id(path, ":chunk0:", str(NOW)).alias("chunk0_id"))


# ---------------------------------------------------------------- W1 - W7, W13, W14, P11

BUILD_SQL = f"""built AS (
  SELECT request_id,
    substr(sha256(concat('{NOW}', ':', content)), 1, 16) AS hash,
    CAST({NOW} AS BIGINT) AS created_at, CAST({NOW} AS BIGINT) AS last_accessed,
    CAST(0 AS BIGINT) AS access_count, importance, false AS explicit_save,
    content AS full_text, summary AS summary_text, essence AS essence_text,
    CASE WHEN context_log = '' THEN NULL ELSE context_log END AS context_log,
    coalesce(tags, []) AS tags, coalesce(memory_type, 'conversation') AS memory_type,
    coalesce(sensitivity, 'public') AS sensitivity,
    CASE WHEN project = '' THEN NULL ELSE project END AS project,
    'session_{NOW}' AS session_id,
    CASE WHEN coalesce(owner_id, '') = '' THEN 'default' ELSE owner_id END AS owner_id
  FROM store_requests)"""


@register("build_memories", f"""
{BUILD_SQL}
SELECT request_id, hash, importance, memory_type, sensitivity, project, owner_id, session_id,
       context_log IS NULL AS no_context, array_to_string(tags, ',') AS tags
FROM built""")
def q_build_memories(spark, sf):
    b = W.build_memories(FX.store_requests(spark, sf), NOW, keep=["request_id"])
    return b.select("request_id", "hash", "importance", "memory_type", "sensitivity", "project",
                    "owner_id", "session_id", F.col("context_log").isNull().alias("no_context"),
                    joined("tags").alias("tags"))
