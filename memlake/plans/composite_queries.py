"""Registered queries for the end-user requests built from several operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.config import NOW, TIERS
from memlake.functions.decay import half_life_hours, hot_hours
from memlake.functions.embed import with_embedding
from memlake.functions.format import format_memory
from memlake.functions.visibility import visible
from memlake.operators import candidates as C
from memlake.operators import changes as W
from memlake.operators import clusters as K
from memlake.operators import records as RC
from memlake.plans.cluster_queries import lloyd_sql
from memlake.plans.common import register
from memlake.plans.context_queries import TEXT_SQL
from memlake.plans.document_queries import MEM_TEXT_SQL, embed_sql, memory_text
from memlake.plans.memory_queries import BUILD_SQL, SCORE_SQL, tier_sql
from memlake.plans.memory_more import GC_SQL
from memlake.plans.record_queries import vault_files
from memlake.sources import fixtures as FX
from memlake.sources.tables import read_table
from memlake.session import materialize


@register("store_memories", f"""
{BUILD_SQL},
valid AS (
  SELECT b.* FROM built b JOIN store_requests r USING (request_id)
  WHERE r.importance BETWEEN 1 AND 5
    AND (r.memory_type IS NULL OR r.memory_type IN ('conversation', 'knowledge', 'learning', 'decision', 'architecture'))
    AND (r.sensitivity IS NULL OR r.sensitivity IN ('public', 'internal', 'secret'))
    AND r.content IS NOT NULL AND r.summary IS NOT NULL AND r.essence IS NOT NULL),
src AS (SELECT request_id, concat(summary_text, ' ', essence_text, ' ', array_to_string(tags, ' ')) AS t FROM valid),
{embed_sql('src', 'request_id', 't', 'se')},
nz AS (SELECT id, count(*) AS nnz FROM se_sparse GROUP BY id)
SELECT r.request_id, v.request_id IS NOT NULL AS stored, v.hash,
       CASE WHEN v.request_id IS NOT NULL THEN CAST(floor(ln(v.importance / 2.0) / 0.01 + 0.5) AS BIGINT) END AS hot_hours,
       CASE WHEN v.request_id IS NOT NULL THEN CAST(coalesce(nz.nnz, 0) AS BIGINT) END AS emb_nnz
FROM store_requests r LEFT JOIN valid v USING (request_id) LEFT JOIN nz ON nz.id = r.request_id""")
def q_store_memories(spark, sf):
    """store request for every request: validate, build, embed summary+essence+tags, report."""
    req = FX.store_requests(spark, sf)
    checked = W.validate_store_requests(req)
    built = W.build_memories(checked.filter("ok"), NOW, keep=["request_id"])
    built = with_embedding(memory_text(built), "embed_text", out="embedding", as_float=True)
    res = built.select("request_id", "hash", hot_hours("importance").alias("hot_hours"),
                       F.size("embedding_sparse").cast("bigint").alias("emb_nnz"))
    return (req.select("request_id").join(res, "request_id", "left")
            .select("request_id", F.col("hash").isNotNull().alias("stored"), "hash", "hot_hours", "emb_nnz"))


@register("status_summary", f"""
top AS (SELECT {tier_sql(SCORE_SQL)} AS f FROM memories WHERE sensitivity <> 'secret'
        ORDER BY importance DESC, last_accessed DESC, hash LIMIT 100)
SELECT (SELECT count(*) FROM memories) AS total_memories,
       (SELECT count(DISTINCT coalesce(project, '_untagged')) FROM memories) AS n_projects,
       (SELECT count(DISTINCT memory_type) FROM memories) AS n_types,
       (SELECT string_agg(concat(p, '=', n), ',' ORDER BY p) FROM (
          SELECT coalesce(project, '_untagged') AS p, count(*) AS n FROM memories GROUP BY 1)) AS by_project,
       (SELECT string_agg(concat(t, '=', n), ',' ORDER BY t) FROM (
          SELECT memory_type AS t, count(*) AS n FROM memories GROUP BY 1)) AS by_type,
       {', '.join(f"count(*) FILTER (WHERE f = '{t}') AS {t}" for t in TIERS)},
       CAST({half_life_hours()} AS BIGINT) AS half_life_hours
FROM top""")
def q_status_summary(spark, sf):
    """Status request: totals, tier mix of the top-100 sample, half-life."""
    m = FX.memories(spark, sf)
    tiers = C.fidelity_distribution_top(spark, m, NOW).agg(
        *[F.coalesce(F.sum(F.when(F.col("fidelity") == t, F.col("n"))), F.lit(0)).cast("bigint").alias(t) for t in TIERS])
    # one pass; the answer itself lists every project and type with its count
    groups = m.groupBy(F.coalesce("project", F.lit("_untagged")).alias("p"), F.col("memory_type").alias("t")).agg(F.count("*").alias("n"))

    def listed(df, key):
        return df.groupBy(key).agg(F.sum("n").alias("n")).agg(F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct(key, "n"))), lambda s: F.concat_ws("=", s[key], s["n"].cast("string"))), ",")).scalar()
    totals = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_memories"), F.countDistinct("p").alias("n_projects"),
                        F.countDistinct("t").alias("n_types"), F.first(listed(groups, "p")).alias("by_project"),
                        F.first(listed(groups, "t")).alias("by_type"))
    sample = tiers.first()  # one row of five counts
    return totals.select("total_memories", "n_projects", "n_types", "by_project", "by_type", *[F.lit(sample[t]).alias(t) for t in TIERS],
                         F.lit(half_life_hours()).cast("bigint").alias("half_life_hours"))


@register("sync_counts", f"""
live AS (SELECT hash FROM memories WHERE NOT {GC_SQL})
SELECT (SELECT count(*) FROM memories WHERE sensitivity <> 'secret') AS exported,
       (SELECT count(*) FROM memories WHERE {GC_SQL}) AS gc_removed,
       (SELECT count(DISTINCT hash) FROM memories WHERE sensitivity <> 'secret' AND NOT {GC_SQL}) AS synced""")
def q_sync_counts(spark, sf):
    """Counts reported by sync (exported / synced) and retention (removed)."""
    m = FX.memories(spark, sf)
    live = W.gc_survivors(m, NOW)
    exported = RC.vault_export(m).agg(F.count("*").alias("exported"))
    synced = (RC.vault_merge(live, RC.parse_vault(materialize(vault_files(spark, sf), "vault_files")))
              .agg(F.countDistinct("hash")).scalar())
    removed = W.gc_removed(m, NOW).agg(F.count("*")).scalar()
    return exported.select("exported", removed.alias("gc_removed"), synced.alias("synced"))


def clusters_sql(where: str, k: int) -> str:
    return f"""msrc AS (SELECT hash, {MEM_TEXT_SQL} AS t FROM memories WHERE {where}),
{embed_sql('msrc', 'hash', 't', 'me')},
items AS MATERIALIZED (
  SELECT g.hash, list(coalesce(s.w, 0.0) ORDER BY g.b) AS vec
  FROM (SELECT hash, unnest(range(128)) AS b FROM msrc) g LEFT JOIN me_sparse s ON s.id = g.hash AND s.b = g.b GROUP BY g.hash),
{lloyd_sql("items", k)},
asg AS (SELECT a.hash, a.c AS cluster_id, m.tags FROM kmeans_end a JOIN memories m USING (hash)),
tc AS (SELECT cluster_id, tag, count(*) AS cnt FROM (SELECT cluster_id, unnest(tags) AS tag FROM asg) GROUP BY 1, 2),
tt AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY cnt DESC, tag) AS rank FROM tc QUALIFY rank <= 5),
sm AS (SELECT cluster_id, hash, row_number() OVER (PARTITION BY cluster_id ORDER BY hash) AS rn FROM asg QUALIFY rn <= 5)
SELECT CAST(z.cluster_id AS BIGINT) AS cluster_id, z.size, t.top_tags, s.sample_ids, (SELECT count(*) FROM asg) AS total,
       (SELECT count(DISTINCT cluster_id) FROM asg) AS n_clusters
FROM (SELECT cluster_id, count(*) AS size FROM asg GROUP BY 1) z
JOIN (SELECT cluster_id, string_agg(tag, ',' ORDER BY rank) AS top_tags FROM tt GROUP BY 1) t USING (cluster_id)
JOIN (SELECT cluster_id, string_agg(substr(hash, 1, 7), ',' ORDER BY rn) AS sample_ids FROM sm GROUP BY 1) s USING (cluster_id)"""


@register("memory_clusters", clusters_sql("sensitivity <> 'secret'", 5))
def q_memory_clusters(spark, sf):
    """Clusters request: k-means (k=5) over the visible memories' own embeddings, with size,
    top-5 tags and 5 sample ids per cluster."""
    return clusters(spark, FX.memories(spark, sf))


@register("caller_clusters", clusters_sql("""coalesce(sensitivity = 'public' OR (sensitivity = 'internal' AND project = 'src3')
  OR (sensitivity = 'secret' AND owner_id = 'user_3'), false) AND project = 'src3'""", 3))
def q_caller_clusters(spark, sf):
    """Clusters request of one caller: asked project src3 (allowed), owner user_3, k=3."""
    return clusters(spark, FX.memories(spark, sf), "src3", "user_3", 3)


def clusters(spark, mem, project=None, owner=None, k=5):
    """Per cluster of the memories the caller may see: size, top-5 tags, 5 sample ids; total and number of clusters."""
    items = with_embedding(memory_text(mem.filter(visible(project, owner))), "embed_text", out="vec").select("hash", "vec", "tags")
    assigned, _, _ = K.lloyd(spark, items, k)
    a = assigned.select("hash", "cluster_id", "tags")
    tags = (K.top_tags(a).groupBy("cluster_id")
            .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "tag"))), lambda x: x["tag"]), ",")
                 .alias("top_tags")))
    samples = (K.sample_members(a).groupBy("cluster_id")
               .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "short_id"))),
                                             lambda x: x["short_id"]), ",").alias("sample_ids")))
    sizes = K.cluster_sizes(a)
    return (sizes.join(tags, "cluster_id", "left").join(samples, "cluster_id", "left")
            .withColumn("total", sizes.agg(F.sum("size")).scalar()).withColumn("n_clusters", sizes.agg(F.count("*")).scalar()))


@register("validate_turns", """
SELECT conv_id, turn, role IN ('user', 'assistant', 'system') AS role_ok FROM conversations""")
def q_validate_turns(spark, sf):
    """Turn roles of logged sessions must be user / assistant / system."""
    return W.validate_roles(read_table(spark, sf, "conversations")).select("conv_id", "turn", "role_ok")


BROWSE_SQL = """rq AS (
  SELECT request_id, owner,
    CASE WHEN allowed IS NULL THEN project
         WHEN project IS NOT NULL AND list_contains(allowed, project) THEN project
         ELSE allowed[1] END AS sp
  FROM requests),
vis AS (
  SELECT r.request_id, m.*,
         row_number() OVER (PARTITION BY r.request_id ORDER BY m.importance DESC, m.last_accessed DESC, m.hash) AS rank
  FROM rq r JOIN memories m ON
    (CASE WHEN r.owner IS NULL THEN m.sensitivity <> 'secret'
      ELSE coalesce(m.sensitivity = 'public' OR (m.sensitivity = 'internal' AND m.project = r.sp)
                    OR (m.sensitivity = 'secret' AND m.owner_id = r.owner), false) END)
    AND (r.sp IS NULL OR coalesce(m.project = r.sp, false))
  QUALIFY rank <= {limit})"""


@register("browse_memories", BROWSE_SQL.format(limit=10) + f"""
SELECT request_id, rank, hash, round(score, 6) AS score, fidelity, {TEXT_SQL} AS text
FROM (SELECT *, {SCORE_SQL} AS score, {tier_sql(SCORE_SQL)} AS fidelity FROM vis)""")
def q_browse_memories(spark, sf):
    """Query request without text for every caller: scope clamp, visibility, top 10 by
    importance and recency, decay score and tier."""
    from memlake.functions.visibility import scope_clamp
    req = FX.requests(spark, sf).select("request_id", scope_clamp("project", "allowed").alias("scope_project"), "owner")
    c = C.scored(C.candidates_for_requests(FX.memories(spark, sf), req, 10), NOW)
    return c.select("request_id", "rank", "hash", F.round("score", 6).alias("score"), "fidelity",
                    format_memory("fidelity").alias("text"))


def _context_oracle() -> str:
    from memlake.plans.context_queries import CONTEXT_TEXT_SQL, pack_sql
    return (BROWSE_SQL.format(limit=50)
            + ",\ncand AS (SELECT *, request_id AS g, rank AS crank FROM vis),\n" + pack_sql()
            + f"\nSELECT g AS request_id, {CONTEXT_TEXT_SQL}\nFROM sel GROUP BY g")


@register("context_for_requests", _context_oracle())
def q_context_for_requests(spark, sf):
    """Context request for every caller: scope clamp, the caller's 50 best visible memories,
    packed into an 8000-char context block."""
    from memlake.functions.visibility import scope_clamp
    from memlake.operators import context as X
    req = FX.requests(spark, sf).select("request_id", scope_clamp("project", "allowed").alias("scope_project"), "owner")
    cands = C.candidates_for_requests(FX.memories(spark, sf), req, 50)
    return X.context_blocks(X.pack(cands, "request_id", NOW), group="request_id")
