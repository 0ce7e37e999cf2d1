"""Registered queries: term statistics, BM25, embedding scan, cosine top-k, hybrid search."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.config import NOW
from memlake.functions.embed import with_embedding
from memlake.functions.format import format_memory
from memlake.functions.text import JS_SPACE, content_id
from memlake.functions.visibility import visible
from memlake.operators import candidates as C
from memlake.operators import search as S
from memlake.operators import text_index as T
from memlake.operators import vector_index as V
from memlake.plans.common import joined, r6, register
from memlake.plans.context_queries import TEXT_SQL
from memlake.plans.document_queries import MEM_TEXT_SQL, embed_sql, memory_text
from memlake.plans.memory_queries import SCORE_SQL, tier_sql
from memlake.sources import fixtures as FX
from memlake.sources.tables import read_table

TERM = r"[\p{L}\p{N}]+"

BM25_TMPL = """f AS (
  SELECT hash, 0 AS field, regexp_extract_all(lower(summary_text), '{TERM}') AS toks FROM memories
  UNION ALL SELECT hash, 1, regexp_extract_all(lower(essence_text), '{TERM}') FROM memories
  UNION ALL SELECT hash, 2, regexp_extract_all(lower(array_to_string(tags, ' ')), '{TERM}') FROM memories),
post AS (SELECT hash, field, unnest(toks) AS term, unnest(range(len(toks))) AS pos FROM f),
dl AS (SELECT hash, sum(len(toks)) AS dl FROM f GROUP BY hash),
bstats AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM dl),
qtok AS (
  SELECT query_id, unnest(t) AS tok, unnest(range(len(t))) AS ph
  FROM (SELECT query_id, string_split_regex(regexp_replace(query, '^{JS_SPACE}+|{JS_SPACE}+$', '', 'g'), '{JS_SPACE}+') AS t
        FROM search_requests)),
qp AS (SELECT query_id, ph, regexp_extract_all(lower(tok), '{TERM}') AS p FROM qtok),
pieces AS (SELECT query_id, ph, len(p) AS np, unnest(p) AS term, unnest(range(len(p))) AS j FROM qp WHERE len(p) > 0),
nph AS (SELECT query_id, count(DISTINCT ph) AS nph FROM pieces GROUP BY query_id),
occ AS (
  SELECT pc.query_id, pc.ph, po.hash FROM pieces pc JOIN post po ON po.term = pc.term
  GROUP BY pc.query_id, pc.ph, po.hash, po.field, po.pos - pc.j HAVING count(*) = max(pc.np)),
freq AS (SELECT query_id, ph, hash, count(*) AS f FROM occ GROUP BY 1, 2, 3),
nhit AS (SELECT query_id, ph, count(*) AS n FROM freq GROUP BY 1, 2),
bm AS (
  SELECT fr.query_id, fr.hash,
    sum(CASE WHEN ln((s.n_docs - h.n + 0.5) / (h.n + 0.5)) <= 0 THEN 1e-6 ELSE ln((s.n_docs - h.n + 0.5) / (h.n + 0.5)) END
        * fr.f * 2.2 / (fr.f + 1.2 * (1 - 0.75 + 0.75 * d.dl / s.avgdl))) AS score,
    count(*) AS nm
  FROM freq fr JOIN nhit h USING (query_id, ph) JOIN dl d USING (hash) CROSS JOIN bstats s
  GROUP BY 1, 2),
bm_match AS (SELECT b.query_id, b.hash, b.score, -b.score AS rank FROM bm b JOIN nph USING (query_id) WHERE b.nm = nph.nph),
{FTS}"""

FTS_LEGACY = """fts AS (
  SELECT query_id, hash, rank, row_number() OVER (PARTITION BY query_id ORDER BY round(rank, 9), hash) AS pos
  FROM bm_match WHERE hash IN (SELECT hash FROM memories WHERE sensitivity <> 'secret')
  QUALIFY pos <= 20)"""

BM25_SQL = BM25_TMPL.format(TERM=TERM, JS_SPACE=JS_SPACE, FTS=FTS_LEGACY)

SIM_SQL = f"""msrc AS (SELECT hash, {MEM_TEXT_SQL} AS t FROM memories WHERE sensitivity <> 'secret'),
{embed_sql('msrc', 'hash', 't', 'me')},
{embed_sql('search_requests', 'query_id', 'query', 'qe')},
dots AS (SELECT q.id AS query_id, m.id AS hash, sum(q.w * m.w) AS d FROM qe_sparse q JOIN me_sparse m ON q.b = m.b GROUP BY 1, 2),
sims AS (
  SELECT r.query_id, m.hash, coalesce(d.d, 0.0) AS cos_raw, round(coalesce(d.d, 0.0), 9) AS cos
  FROM search_requests r CROSS JOIN (SELECT hash FROM memories WHERE sensitivity <> 'secret') m
  LEFT JOIN dots d ON d.query_id = r.query_id AND d.hash = m.hash)"""


def _queries(spark, sf):
    return FX.search_requests(spark, sf)


def _index(spark, sf):
    """The kept full-text index of the memories made from this state of `documents`."""
    return T.kept_index(spark, FX.memories(spark, sf), T.table_state(spark, f"{sf.rstrip('/')}/documents.parquet"))


CHANGED_SQL = """changed AS (
  SELECT hash, summary_text, essence_text, tags, sensitivity FROM memories_d
  WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1 OR toxic = 1)
  UNION ALL SELECT hash, concat('v2 ', summary_text), essence_text, tags, sensitivity FROM memories_d
  WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
  UNION ALL SELECT substr(sha256(concat('bench:', CAST(item_id AS VARCHAR))), 1, 16), text, NULL, ['bench'], 'public' FROM benchmark)"""


def _changes(spark, sf):
    """(changed rows, deleted ids): good labelled memories get a new summary, toxic ones go, benchmark items come in."""
    lab = read_table(spark, sf, "labels").join(FX.memories_with_doc(spark, sf), "doc_id")
    none = F.lit(None).cast("string")
    cols = ["hash", "summary_text", "essence_text", "tags", "sensitivity", "project", "owner_id"]
    edited = lab.where("quality = 1 AND toxic = 0").withColumn("summary_text", F.concat(F.lit("v2 "), F.col("summary_text")))
    added = read_table(spark, sf, "benchmark").select(
        content_id("bench:", F.col("item_id").cast("string")).alias("hash"), F.col("text").alias("summary_text"), none.alias("essence_text"),
        F.array(F.lit("bench")).alias("tags"), F.lit("public").alias("sensitivity"), none.alias("project"), F.lit("default").alias("owner_id"))
    return edited.select(*cols).dropDuplicates(["hash"]).unionByName(added), lab.where("toxic = 1").select("hash")


@register("bm25_after_changes", f"""
{CHANGED_SQL},
{BM25_SQL.replace("FROM memories", "FROM changed")}
SELECT query_id, hash, round(rank, 6) AS rank, pos FROM fts""")
def q_bm25_after_changes(spark, sf):
    """Full-text search over the kept index with one more segment: replaced, deleted and inserted memories."""
    changed, gone = _changes(spark, sf)
    index = T.apply_changes(_index(spark, sf), changed, gone, path=T.fresh_folder(spark))
    t = T.search_top(index, _queries(spark, sf), 20)
    return t.select("query_id", "hash", r6("rank").alias("rank"), "pos")


def _mem_vectors(spark, sf):
    """Vectors of the rows that anyone may see: hidden rows are left out before the embedding."""
    m = with_embedding(memory_text(FX.memories(spark, sf).filter(visible())), "embed_text", out="vec")
    return m.select("hash", "vec")


def _query_vectors(spark, sf):
    return with_embedding(_queries(spark, sf), "query", out="vec").select("query_id", "vec")


@register("term_stats", f"""
{BM25_SQL.split(",\nqtok AS")[0]}
SELECT term, count(DISTINCT hash) AS df, count(*) AS cf FROM post GROUP BY term""")
def q_term_stats(spark, sf):
    return S.term_stats(FX.memories(spark, sf))


@register("bm25_search", f"""
{BM25_SQL}
SELECT query_id, hash, round(rank, 6) AS rank, pos FROM fts""")
def q_bm25_search(spark, sf):
    """Full-text search over the kept index: best 20 visible rows by BM25 rank for every query."""
    t = T.search_top(_index(spark, sf), _queries(spark, sf), 20)
    return t.select("query_id", "hash", r6("rank").alias("rank"), "pos")


@register("bm25_search_rebuilt", f"""
{BM25_SQL}
SELECT query_id, hash, round(rank, 6) AS rank, pos FROM fts""")
def q_bm25_search_rebuilt(spark, sf):
    """The same search over an index that is built for this call and scores every match."""
    t = S.bm25_top(S.build_index(FX.memories(spark, sf)), _queries(spark, sf), 20)
    return t.select("query_id", "hash", r6("rank").alias("rank"), "pos")


@register("embedding_scan", f"""
msrc AS (SELECT hash, {MEM_TEXT_SQL} AS t FROM memories
         WHERE coalesce(sensitivity = 'public' OR (sensitivity = 'internal' AND project = 'src3')
                        OR (sensitivity = 'secret' AND owner_id = 'user_3'), false) AND project = 'src3'),
{embed_sql('msrc', 'hash', 't', 'me')},
nz AS (SELECT id, count(*) AS nnz FROM me_sparse GROUP BY id)
SELECT m.hash, m.importance, m.last_accessed, array_to_string(m.tags, ',') AS tags, CAST(coalesce(nz.nnz, 0) AS BIGINT) AS emb_nnz
FROM memories m JOIN msrc USING (hash) LEFT JOIN nz ON nz.id = m.hash""")
def q_embedding_scan(spark, sf):
    """getAllWithEmbeddings(project='src3', owner='user_3'): five columns, visibility-filtered."""
    m = FX.memories(spark, sf).filter(visible("src3", "user_3"))
    m = with_embedding(memory_text(m), "embed_text", out="embedding")
    return m.select("hash", "importance", "last_accessed", joined("tags").alias("tags"),
                    F.size("embedding_sparse").cast("bigint").alias("emb_nnz"))


def _kept_vectors(spark, sf):
    """The kept vectors (local embeddings) of the memories made from this state of `documents`, by pivot cells."""
    mem = with_embedding(memory_text(FX.memories(spark, sf)), "embed_text", out="vec").select("hash", "vec", *V.ATTRIBUTES)
    state = T.table_state(spark, f"{sf.rstrip('/')}/documents.parquet")
    return V.VectorIndex(spark, T.kept(spark, f"vectors-v1-{state}", "cells", lambda path: V.create_vectors(mem, path)))


@register("vector_topk_pruned", f"""
{SIM_SQL}
SELECT query_id, hash, round(cos_raw, 6) AS sim, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, hash) AS rank
FROM sims QUALIFY rank <= 10""")
def q_vector_topk_pruned(spark, sf):
    """Exact cosine top-10 over the kept vectors: cells that cannot hold one of the best are not opened."""
    t = V.topk(_kept_vectors(spark, sf), _query_vectors(spark, sf), k=10)
    return t.select("query_id", "hash", r6("sim").alias("sim"), "rank")


@register("vector_topk_approximate", f"""
{SIM_SQL},
best AS (SELECT query_id FROM sims QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, hash) <= 10)
SELECT query_id, count(*) AS hits, true AS recall_reached FROM best GROUP BY query_id""")
def q_vector_topk_approximate(spark, sf):
    """Approximate cosine top-10 (48 cells a query): hits, and whether the mean recall against the exact search is 0.9 or more."""
    index = _kept_vectors(spark, sf)
    near = S._materialize(V.topk(index, _query_vectors(spark, sf), k=10, probes=48), "approximate_hits")
    recall = S._materialize(V.recall(V.topk(index, _query_vectors(spark, sf), k=10), near), "approximate_recall")
    hits = near.groupBy("query_id").agg(F.count("*").alias("hits"))
    return hits.join(recall, "query_id").select("query_id", "hits", (recall.agg(F.avg("recall")).scalar() >= 0.9).alias("recall_reached"))


@register("semantic_topk", f"""
{SIM_SQL}
SELECT query_id, hash, round(cos_raw, 6) AS sim, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, hash) AS rank
FROM sims QUALIFY rank <= 10""")
def q_semantic_topk(spark, sf):
    """Cosine top-10 per query over visible memories (local embeddings)."""
    t = S.vector_topk(spark, S._materialize(_mem_vectors(spark, sf), "memory_vectors"),
                      S._materialize(_query_vectors(spark, sf), "query_vectors"), k=10)
    return t.select("query_id", "hash", r6("sim").alias("sim"), "rank")


HYBRID_SQL = f"""{BM25_SQL},
{SIM_SQL},
boosted AS (
  SELECT s.query_id, s.hash, s.cos_raw + CASE WHEN f.hash IS NOT NULL THEN 0.5 ELSE 0.0 END AS sim,
         round(s.cos_raw + CASE WHEN f.hash IS NOT NULL THEN 0.5 ELSE 0.0 END, 9) AS sim_key
  FROM sims s LEFT JOIN fts f ON f.query_id = s.query_id AND f.hash = s.hash),
sem AS (
  SELECT query_id, hash, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim_key DESC, hash) AS rank
  FROM boosted WHERE sim_key > 0.25 QUALIFY rank <= 10),
res AS (
  SELECT query_id, hash, rank, 'semantic' AS source FROM sem
  UNION ALL
  SELECT query_id, hash, pos AS rank, 'fulltext' AS source FROM fts
  WHERE pos <= 10 AND query_id NOT IN (SELECT query_id FROM sem))"""


def _hybrid(spark, sf):
    """Both branches over the kept indexes."""
    index, q = _index(spark, sf), _queries(spark, sf)
    return S.hybrid(spark, _kept_vectors(spark, sf).vectors, q, _query_vectors(spark, sf),
                    fulltext=lambda limit: T.search_top(index, q, limit))


@register("hybrid_search", f"""
{HYBRID_SQL}
SELECT query_id, hash, round(sim, 6) AS sim, rank FROM sem""")
def q_hybrid_search(spark, sf):
    """Cosine + 0.5 for full-text hits, above 0.25, best 10 per query."""
    sem, _ = _hybrid(spark, sf)
    return sem.select("query_id", "hash", r6("sim").alias("sim"), "rank")


@register("search_with_fallback", f"""
{HYBRID_SQL}
SELECT query_id, hash, rank, source, substr(hash, 1, 7) AS short_id, round(score, 6) AS score, fidelity, project,
       array_to_string(tags, ',') AS tags, {TEXT_SQL} AS text
FROM (SELECT r.query_id, r.rank, r.source, m.*, {SCORE_SQL} AS score, {tier_sql(SCORE_SQL)} AS fidelity
      FROM res r JOIN memories m USING (hash))""")
def q_search_with_fallback(spark, sf):
    """Query request end to end: hybrid results, full-text fallback, decay score, tier and the text at that tier."""
    sem, fts = _hybrid(spark, sf)
    res = S.with_fallback(sem, fts)
    # only the winners' rows are fetched with their texts
    out = C.scored(res.join(FX.memories(spark, sf), "hash"), NOW)
    return out.select("query_id", "hash", "rank", "source", F.substring("hash", 1, 7).alias("short_id"),
                      r6("score").alias("score"), "fidelity", "project", joined("tags").alias("tags"),
                      format_memory("fidelity").alias("text"))


# ---------------------------------------------------------------- per-caller scope

SCOPE_SQL = """sq AS (
  SELECT s.query_id, s.query,
    CASE WHEN r.allowed IS NULL THEN r.project
         WHEN r.project IS NOT NULL AND list_contains(r.allowed, r.project) THEN r.project
         ELSE r.allowed[1] END AS sp,
    r.owner AS so, s.query_id % 13 + 1 AS lim
  FROM search_requests s JOIN requests r ON r.request_id = s.query_id // 10000)"""

PAIR_VIS = """(CASE WHEN q.so IS NULL THEN m.sensitivity <> 'secret'
   ELSE coalesce(m.sensitivity = 'public' OR (m.sensitivity = 'internal' AND m.project = q.sp)
                 OR (m.sensitivity = 'secret' AND m.owner_id = q.so), false) END)
  AND (q.sp IS NULL OR coalesce(m.project = q.sp, false))"""

FTS_SCOPED = f"""fts AS (
  SELECT b.query_id, b.hash, b.rank, row_number() OVER (PARTITION BY b.query_id ORDER BY round(b.rank, 9), b.hash) AS pos
  FROM bm_match b JOIN sq q ON q.query_id = b.query_id JOIN memories m ON m.hash = b.hash
  WHERE {PAIR_VIS}
  QUALIFY pos <= 2 * q.lim)"""

SCOPED_SQL = f"""{SCOPE_SQL},
{BM25_TMPL.format(TERM=TERM, JS_SPACE=JS_SPACE, FTS=FTS_SCOPED)},
msrc AS (SELECT hash, {MEM_TEXT_SQL} AS t FROM memories),
{embed_sql('msrc', 'hash', 't', 'me')},
{embed_sql('search_requests', 'query_id', 'query', 'qe')},
dots AS (SELECT q.id AS query_id, m.id AS hash, sum(q.w * m.w) AS d FROM qe_sparse q JOIN me_sparse m ON q.b = m.b GROUP BY 1, 2),
sims AS (
  SELECT q.query_id, m.hash, coalesce(d.d, 0.0) AS cos_raw
  FROM sq q JOIN memories m ON {PAIR_VIS}
  LEFT JOIN dots d ON d.query_id = q.query_id AND d.hash = m.hash),
boosted AS (
  SELECT s.query_id, s.hash, round(s.cos_raw + CASE WHEN f.hash IS NOT NULL THEN 0.5 ELSE 0.0 END, 9) AS sim_key
  FROM sims s LEFT JOIN fts f ON f.query_id = s.query_id AND f.hash = s.hash),
sem AS (
  SELECT b.query_id, b.hash, row_number() OVER (PARTITION BY b.query_id ORDER BY b.sim_key DESC, b.hash) AS rank
  FROM boosted b JOIN sq q USING (query_id) WHERE sim_key > 0.25 QUALIFY rank <= q.lim),
res AS (
  SELECT query_id, hash, rank, 'semantic' AS source FROM sem
  UNION ALL
  SELECT f.query_id, f.hash, f.pos AS rank, 'fulltext' AS source FROM fts f JOIN sq q USING (query_id)
  WHERE f.pos <= q.lim AND f.query_id NOT IN (SELECT query_id FROM sem))"""


@register("scoped_search", f"""
{SCOPED_SQL}
SELECT query_id, hash, rank, source, round(score, 6) AS score, fidelity, {TEXT_SQL} AS text
FROM (SELECT r.query_id, r.rank, r.source, m.*, {SCORE_SQL} AS score, {tier_sql(SCORE_SQL)} AS fidelity
      FROM res r JOIN memories m USING (hash))""")
def q_scoped_search(spark, sf):
    """Query request where every query has its own caller (project, owner, allowed projects):
    scope clamp, per-caller visibility on both branches, hybrid ranking, fallback, the caller's own limit."""
    from memlake.functions.visibility import scope_clamp
    req = FX.scoped_search_requests(spark, sf)
    scope = req.select("query_id", scope_clamp("project", "allowed").alias("scope_project"), "owner")
    index, q = _index(spark, sf), req.select("query_id", "query")
    qv = with_embedding(req.select("query_id", "query"), "query", out="vec").select("query_id", "vec")
    limits = req.select("query_id", "limit")
    sem, fts = S.hybrid(spark, _kept_vectors(spark, sf).vectors, q, qv, scope=scope, limits=limits,
                        fulltext=lambda limit: T.search_top(index, q, limit, scope=scope))
    res = S.with_fallback(sem, fts, limits=limits)
    out = C.scored(res.join(FX.memories(spark, sf), "hash"), NOW)
    return out.select("query_id", "hash", "rank", "source", r6("score").alias("score"), "fidelity",
                      format_memory("fidelity").alias("text"))


# ---------------------------------------------------------------- stored vectors

STORED_SQL = f"""msrc AS (SELECT hash, {MEM_TEXT_SQL} AS t FROM memories_d WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)),
{embed_sql('msrc', 'hash', 't', 'me')},
local_vec AS (
  SELECT g.hash, list(coalesce(s.w, 0.0) ORDER BY g.b) AS vec
  FROM (SELECT hash, unnest(range(128)) AS b FROM msrc) g LEFT JOIN me_sparse s ON s.id = g.hash AND s.b = g.b GROUP BY g.hash),
stored AS (
  SELECT m.hash, list_transform(e.embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(e.embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS vec
  FROM memories_d m JOIN embeddings e ON e.vec_id = m.doc_id
  UNION ALL SELECT hash, vec FROM local_vec)"""


def _stored(spark, sf):
    """Memories with their stored vectors: the `embeddings` row of their document, where there is one."""
    vec = (read_table(spark, sf, "embeddings").select("vec_id", "embedding")
           .join(FX.memories_with_doc(spark, sf).select(F.col("doc_id").alias("vec_id"), "hash"), "vec_id").drop("vec_id"))
    return S.stored_vectors(FX.memories(spark, sf), vec)


@register("embedding_scan_stored", f"""
{STORED_SQL}
SELECT s.hash, m.importance, m.last_accessed, array_to_string(m.tags, ',') AS tags, CAST(pos AS BIGINT) AS pos, round(x, 6) AS value
FROM (SELECT hash, unnest(vec) AS x, unnest(range(len(vec))) AS pos FROM stored) s JOIN memories m USING (hash)
WHERE m.sensitivity <> 'secret' AND m.project = 'src3'""")
def q_embedding_scan_stored(spark, sf):
    """Embedding scan of a project over stored vectors: every component of every vector, one row each."""
    v = _stored(spark, sf).filter(visible("src3"))
    return v.select("hash", "importance", "last_accessed", joined("tags").alias("tags"), F.posexplode("vec").alias("pos", "x")).select(
        "hash", "importance", "last_accessed", "tags", F.col("pos").cast("bigint").alias("pos"), r6("x").alias("value"))


@register("stored_vector_topk", f"""
{STORED_SQL},
asked AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 50 = 0),
sims AS (
  SELECT q.query_id, s.hash, CASE WHEN len(s.vec) = len(q.embedding) THEN list_cosine_similarity(s.vec, q.embedding::DOUBLE[]) ELSE 0.0 END AS sim
  FROM asked q CROSS JOIN stored s JOIN memories m USING (hash) WHERE m.sensitivity <> 'secret')
SELECT query_id, hash, round(sim, 6) AS sim, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, hash) AS rank
FROM sims QUALIFY rank <= 10""")
def q_stored_vector_topk(spark, sf):
    """Cosine top-10 over stored vectors of two sizes (other sizes than the query's score 0); the queries are the
    vectors whose id is divisible by 50."""
    asked = (read_table(spark, sf, "embeddings").filter(F.col("vec_id") % 50 == 0)
             .select(F.col("vec_id").alias("query_id"), S.unit(F.col("embedding")).alias("vec")))
    mem = S._materialize(_stored(spark, sf).filter(visible()).select("hash", "vec"), "stored_vectors")
    t = S.vector_topk(spark, mem, asked, k=10)
    return t.select("query_id", "hash", r6("sim").alias("sim"), "rank")
