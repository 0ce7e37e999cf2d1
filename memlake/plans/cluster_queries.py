"""Registered queries: k-means, centroids, cluster summaries, project-name resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.config import UNTAGGED
from memlake.functions.text import JS_SPACE, NAME_JUNK, normalize_name
from memlake.operators import clusters as K
from memlake.operators import projects as P
from memlake.plans.common import r6, register
from memlake.sources import fixtures as FX
from memlake.sources.tables import read_table

ASSIGN_SQL = """items AS (SELECT hash, vec, tags FROM cluster_items WHERE vec IS NOT NULL AND len(vec) > 0),
init AS (SELECT vec AS cvec, row_number() OVER (ORDER BY hash) - 1 AS c FROM items ORDER BY hash LIMIT 5),
sims AS (SELECT i.hash, i.tags, i.vec, c.c,
                coalesce(list_cosine_similarity(i.vec::DOUBLE[], c.cvec::DOUBLE[]), 0.0) AS s
         FROM items i CROSS JOIN init c),
asg AS (SELECT hash, tags, vec, c AS cluster_id FROM sims
        QUALIFY row_number() OVER (PARTITION BY hash ORDER BY s DESC, c) = 1)"""


def _assigned_once(spark, sf):
    items = FX.cluster_items(spark, sf)
    valid = items.filter(F.col("vec").isNotNull() & (F.size("vec") > 0))
    cent, dim = K.initial_centroids(valid, 5)
    return K.assign_to(spark, valid, cent, dim)


@register("kmeans_assign_once", f"{ASSIGN_SQL}\nSELECT hash, CAST(cluster_id AS BIGINT) AS cluster_id FROM asg")
def q_kmeans_assign_once(spark, sf):
    """One assignment step from the seeded centroids (the 5 smallest ids)."""
    return _assigned_once(spark, sf).select("hash", "cluster_id")


@register("centroids", f"""{ASSIGN_SQL}
SELECT CAST(cluster_id AS BIGINT) AS cluster_id, CAST(pos - 1 AS BIGINT) AS pos, round(avg(x::DOUBLE), 6) AS value
FROM (SELECT cluster_id, unnest(vec) AS x, unnest(range(1, len(vec) + 1)) AS pos FROM asg)
GROUP BY 1, 2""")
def q_centroids(spark, sf):
    """Mean update after one assignment: element-wise mean per cluster."""
    c = K.centroid_means(_assigned_once(spark, sf))
    return c.select("cluster_id", F.col("pos").cast("bigint").alias("pos"), r6("value").alias("value"))


@register("cluster_sizes", f"{ASSIGN_SQL}\nSELECT CAST(cluster_id AS BIGINT) AS cluster_id, count(*) AS size FROM asg GROUP BY 1")
def q_cluster_sizes(spark, sf):
    return K.cluster_sizes(_assigned_once(spark, sf))


@register("cluster_top_tags", f"""{ASSIGN_SQL},
tc AS (SELECT cluster_id, tag, count(*) AS cnt FROM (SELECT cluster_id, unnest(tags) AS tag FROM asg) GROUP BY 1, 2)
SELECT CAST(cluster_id AS BIGINT) AS cluster_id, tag, cnt,
       row_number() OVER (PARTITION BY cluster_id ORDER BY cnt DESC, tag) AS rank
FROM tc QUALIFY rank <= 5""")
def q_cluster_top_tags(spark, sf):
    return K.top_tags(_assigned_once(spark, sf)).select("cluster_id", "tag", "cnt", "rank")


@register("cluster_sample_members", f"""{ASSIGN_SQL}
SELECT CAST(cluster_id AS BIGINT) AS cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY hash) AS rn,
       substr(hash, 1, 7) AS short_id
FROM asg QUALIFY rn <= 5""")
def q_cluster_sample_members(spark, sf):
    return K.sample_members(_assigned_once(spark, sf))


def lloyd_sql(items: str, k: int = 5, iterations: int = 20) -> str:
    """The seeded k-means unrolled: views c0, a1, c1, ... and kmeans_end (hash, c). Once settled, further
    rounds change nothing, so a fixed number of rounds gives the same end as stopping early."""
    parts = [f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY hash) - 1 AS c, vec::DOUBLE[] AS v FROM {items} QUALIFY row_number() OVER (ORDER BY hash) <= {k})"""]
    for i in range(1, iterations + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT i.hash, c.c FROM {items} i CROSS JOIN c{i - 1} c
  QUALIFY row_number() OVER (PARTITION BY i.hash ORDER BY coalesce(list_cosine_similarity(i.vec::DOUBLE[], c.v), 0.0) DESC, c.c) = 1)""")
        parts.append(f"""c{i} AS MATERIALIZED (
  SELECT o.c, coalesce(n.v, o.v) AS v FROM c{i - 1} o LEFT JOIN (
    SELECT c, list(x ORDER BY p) AS v FROM (
      SELECT c, p, avg(x) AS x FROM (
        SELECT a.c, unnest(i.vec::DOUBLE[]) AS x, unnest(range(len(i.vec))) AS p FROM a{i} a JOIN {items} i USING (hash))
      GROUP BY c, p) GROUP BY c) n USING (c))""")
    return ",\n".join([*parts, f"kmeans_end AS (SELECT hash, c FROM a{iterations})"])


@register("kmeans_lloyd", f"""items AS MATERIALIZED (SELECT hash, vec FROM cluster_items WHERE vec IS NOT NULL AND len(vec) > 0),
{lloyd_sql("items")}
SELECT hash, CAST(c AS BIGINT) AS cluster_id FROM kmeans_end""")
def q_kmeans_lloyd(spark, sf):
    """Full k-means (k=5, <= 20 iterations, seeded) over the embeddings table."""
    a, _, _ = K.lloyd(spark, FX.cluster_items(spark, sf))
    return a.select("hash", "cluster_id")


def two_sizes(spark, sf):
    """Cluster items of two vector sizes: odd ones keep their first 32 components."""
    odd = F.col("hash").cast("long") % 2 == 1
    return FX.cluster_items(spark, sf).withColumn("vec", F.when(odd, F.slice("vec", 1, 32)).otherwise(F.col("vec")))


@register("kmeans_two_sizes", f"""full_items AS MATERIALIZED (SELECT hash, vec FROM cluster_items WHERE CAST(hash AS BIGINT) % 2 = 0),
half_items AS MATERIALIZED (SELECT hash, vec[1:32] AS vec FROM cluster_items WHERE CAST(hash AS BIGINT) % 2 = 1),
full_end AS (WITH {lloyd_sql("full_items")} SELECT * FROM kmeans_end),
half_end AS (WITH {lloyd_sql("half_items")} SELECT * FROM kmeans_end)
SELECT hash, CAST(64 AS BIGINT) AS size, CAST(c AS BIGINT) AS cluster_id FROM full_end
UNION ALL SELECT hash, CAST(32 AS BIGINT), CAST(c AS BIGINT) FROM half_end""")
def q_kmeans_two_sizes(spark, sf):
    """K-means over vectors of two sizes at once: each size has its own clusters, both iterate in the same passes."""
    a, _, _ = K.lloyd_sizes(spark, two_sizes(spark, sf))
    return a.select("hash", "size", "cluster_id")


@register("kmeans_ml")
def q_kmeans_ml(spark, sf):
    """MLlib cosine k-means (k=5, 20 iterations, seed 42) over the embeddings table."""
    return K.mllib_kmeans(FX.cluster_items(spark, sf))


# ---------------------------------------------------------------- names


def incoming_names(spark, sf):
    """Names as users type them: each source as is, upper-cased, letter-dashed, with a typo,
    padded, blanked; plus every distinct word of every benchmark text."""
    src = read_table(spark, sf, "documents").select("source").distinct()
    s = F.col("source")
    variants = [s, F.upper(s), F.concat_ws("-", F.split(s, "")), F.concat(s, F.lit("x")),
                F.concat(F.lit(" "), s, F.lit(" ")), F.regexp_replace(s, ".", " ")]
    out = None
    for v in variants:
        part = src.select(v.alias("incoming"))
        out = part if out is None else out.unionByName(part)
    words = (read_table(spark, sf, "benchmark")
             .select(F.explode(F.split(F.col("text"), r"\s+")).alias("incoming"))
             .filter(F.col("incoming") != "").select(F.lower("incoming").alias("incoming")).distinct())
    return out.unionByName(words)


INCOMING_SQL = """src AS (SELECT DISTINCT source FROM documents),
incoming_names AS (
  SELECT source AS incoming FROM src
  UNION ALL SELECT upper(source) FROM src
  UNION ALL SELECT array_to_string(string_split(source, ''), '-') FROM src
  UNION ALL SELECT concat(source, 'x') FROM src
  UNION ALL SELECT concat(' ', source, ' ') FROM src
  UNION ALL SELECT regexp_replace(source, '.', ' ', 'g') FROM src
  UNION ALL SELECT DISTINCT lower(w) FROM (SELECT unnest(string_split_regex(text, '\\s+')) AS w FROM benchmark) WHERE w <> '')"""

NAMES_SQL = f"names AS (SELECT project AS name, count(*) AS cnt FROM memories WHERE project IS NOT NULL AND project <> '{UNTAGGED}' GROUP BY 1)"


def _norm_sql(x: str) -> str:
    return f"regexp_replace(lower({x}), '{NAME_JUNK}', '', 'g')"


@register("normalize_project", f"""{INCOMING_SQL},
{NAMES_SQL}
SELECT DISTINCT name, {_norm_sql('name')} AS normalized
FROM (SELECT name FROM names UNION ALL SELECT incoming FROM incoming_names)""")
def q_normalize_project(spark, sf):
    names = P.known_names(FX.memories(spark, sf)).select("name")
    allnames = names.unionByName(incoming_names(spark, sf).select(F.col("incoming").alias("name"))).distinct()
    return allnames.select("name", normalize_name("name").alias("normalized"))


@register("resolve_projects", f"""{INCOMING_SQL},
{NAMES_SQL},
inc AS (SELECT DISTINCT incoming, regexp_replace(incoming, '^{JS_SPACE}+|{JS_SPACE}+$', '', 'g') AS t FROM incoming_names),
cands AS (
  SELECT i.incoming, i.t, n.name, n.cnt,
    CASE WHEN i.t = n.name THEN 1 WHEN lower(i.t) = lower(n.name) THEN 2
         WHEN {_norm_sql('i.t')} = {_norm_sql('n.name')} THEN 3 ELSE 4 END AS sr,
    levenshtein(lower(i.t), lower(n.name)) AS lev
  FROM inc i CROSS JOIN names n WHERE i.t <> ''),
ok AS (SELECT *, CASE WHEN sr < 4 THEN 0 ELSE lev END AS d FROM cands
       WHERE sr < 4 OR (lev > 0 AND lev <= CASE WHEN length(t) <= 4 THEN 1 WHEN length(t) <= 10 THEN 2 ELSE 3 END)),
best AS (SELECT incoming, name, sr FROM ok QUALIFY row_number() OVER (PARTITION BY incoming ORDER BY sr, d, cnt DESC, name) = 1)
SELECT i.incoming, CASE WHEN i.t = '' THEN i.incoming ELSE coalesce(b.name, i.t) END AS resolved,
       coalesce(b.sr IN (2, 3, 4), false) AS corrected,
       CASE b.sr WHEN 1 THEN 'exact' WHEN 2 THEN 'case-insensitive' WHEN 3 THEN 'normalized' WHEN 4 THEN 'levenshtein' END AS strategy
FROM inc i LEFT JOIN best b USING (incoming)""")
def q_resolve_projects(spark, sf):
    """Resolve every incoming name against the memory table's project names."""
    return P.resolve(incoming_names(spark, sf), P.known_names(FX.memories(spark, sf)))
