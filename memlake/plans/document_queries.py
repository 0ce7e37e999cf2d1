"""Registered queries: chunking, chunk summaries, ingestion and the local embedding."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.config import NOW
from memlake.functions.embed import TOKEN_PATTERN, memory_embed_text, with_embedding
from memlake.functions.text import JS_SPACE
from memlake.operators import documents as D
from memlake.plans.common import joined, r6, register
from memlake.sources import fixtures as FX
from memlake.sources.tables import read_table


def js_trim_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{JS_SPACE}+|{JS_SPACE}+$', '', 'g')"


def chunks_sql(src: str, id_cols: str, text: str, size: int, sep: str) -> str:
    """DuckDB CTEs `folded`/`chunked`: the same paragraph fold with list_reduce."""
    step = (f"lambda acc, p: CASE WHEN length(acc.cur) + length(p) + 2 > {size} AND length(acc.cur) > 0 "
            f"THEN {{'out': list_append(acc.out, {js_trim_sql('acc.cur')}), 'cur': p}} "
            f"ELSE {{'out': acc.out, 'cur': concat(acc.cur, CASE WHEN acc.cur <> '' THEN chr(10) || chr(10) ELSE '' END, p)}} END")
    return f"""folded AS (
  SELECT {id_cols}, {text} AS _t,
    list_reduce(string_split_regex({text}, E'{sep}'), {step}, {{'out': []::VARCHAR[], 'cur': ''}}) AS st
  FROM {src}),
chunked AS (
  SELECT {id_cols}, _t, list_filter(CASE WHEN length(_t) <= {size} THEN [_t]
      ELSE (CASE WHEN {js_trim_sql('st.cur')} <> '' THEN list_append(st.out, {js_trim_sql('st.cur')}) ELSE st.out END) END,
    lambda c: c <> '') AS chunks
  FROM folded),
chunk_rows AS (
  SELECT {id_cols}, _t, CAST(len(chunks) AS BIGINT) AS n_chunks,
         unnest(range(len(chunks))) AS chunk_index, unnest(chunks) AS chunk
  FROM chunked)"""


def embed_sql(src: str, id_col: str, text: str, prefix: str = "e") -> str:
    """DuckDB CTE `<prefix>_sparse(id, b, w)`: normalised bucket weights."""
    return f"""{prefix}_tok AS (
  SELECT {id_col} AS id, unnest(regexp_extract_all(lower({text}), '{TOKEN_PATTERN}')) AS tok FROM {src}),
{prefix}_cs AS (SELECT id, list_transform(string_split(tok, ''), lambda c: unicode(c)) AS cs FROM {prefix}_tok),
{prefix}_ent AS (
  SELECT id, list_reduce(cs, lambda h, c: (h * 31 + c) % 128, 0) AS b, 1.0::DOUBLE AS w FROM {prefix}_cs
  UNION ALL
  SELECT id, (cs[i] * 31 + cs[i + 1]) % 128 AS b, 0.5::DOUBLE AS w
  FROM (SELECT id, cs, unnest(range(1, len(cs))) AS i FROM {prefix}_cs)),
{prefix}_agg AS (SELECT id, b, sum(w) AS w FROM {prefix}_ent GROUP BY id, b),
{prefix}_sparse AS (SELECT id, CAST(b AS BIGINT) AS b, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM {prefix}_agg)"""


MEM_TEXT_SQL = "concat(summary_text, ' ', essence_text, ' ', array_to_string(tags, ' '))"


def memory_text(df):
    """Text the store request embeds: summary, essence and tags."""
    return df.withColumn("embed_text", memory_embed_text())


# ---------------------------------------------------------------- V7 / P14


@register("chunk_documents", f"""
{chunks_sql('documents', 'doc_id', 'text', 2000, '\\n\\n+')}
SELECT doc_id, n_chunks, chunk_index, chunk FROM chunk_rows""")
def q_chunk_documents(spark, sf):
    """Chunking with the default size (2000) and separator (blank lines)."""
    d = read_table(spark, sf, "documents")
    return D.chunk_documents(d).select("doc_id", "n_chunks", "chunk_index", "chunk")


@register("chunk_documents_lines", f"""
{chunks_sql('documents', 'doc_id', 'text', 500, '\\n+')}
SELECT doc_id, n_chunks, chunk_index, chunk FROM chunk_rows""")
def q_chunk_documents_lines(spark, sf):
    """Chunking with size 500 and single newlines as the paragraph separator."""
    d = read_table(spark, sf, "documents")
    return D.chunk_documents(d, size=500, separator=r"\n+").select("doc_id", "n_chunks", "chunk_index", "chunk")


SUMMARY_SQL = (f"concat({js_trim_sql('replace(substr(chunk, 1, 150), chr(10), chr(32))')}, "
               f"CASE WHEN length(chunk) > 150 THEN '...' ELSE '' END)")


def essence_sql(name: str) -> str:
    return (f"concat('[', {name}, ':', CAST(chunk_index + 1 AS VARCHAR), '/', CAST(n_chunks AS VARCHAR), '] ', "
            f"replace(substr(chunk, 1, 50), chr(10), chr(32)))")


@register("chunk_summaries", f"""
{chunks_sql('document_files', 'path', 'content', 500, '\\n+')}
SELECT path, chunk_index, {SUMMARY_SQL} AS summary, {essence_sql("regexp_extract(path, '([^/]+)$', 1)")} AS essence
FROM chunk_rows""")
def q_chunk_summaries(spark, sf):
    ch = D.chunk_documents(FX.document_files(spark, sf), "content", 500, r"\n+", keep=("path",))
    ch = ch.withColumn("file_name", D.file_name("path"))
    return ch.select("path", "chunk_index", D.chunk_summary().alias("summary"), D.chunk_essence().alias("essence"))


# ---------------------------------------------------------------- V3


@register("local_embed_sparse", f"""
src AS (SELECT hash, {MEM_TEXT_SQL} AS t FROM memories),
{embed_sql('src', 'hash', 't')}
SELECT id AS hash, b AS bucket, round(w, 6) AS weight FROM e_sparse""")
def q_local_embed_sparse(spark, sf):
    m = with_embedding(memory_text(FX.memories(spark, sf)), "embed_text", keep_dense=False)
    return (m.select("hash", F.explode("emb_sparse").alias("e"))
            .select("hash", F.col("e.b").cast("bigint").alias("bucket"), r6("e.w").alias("weight")))


@register("local_embed_dense", f"""
src AS (SELECT hash, {MEM_TEXT_SQL} AS t FROM memories),
{embed_sql('src', 'hash', 't')},
s AS (SELECT id, sum(w * (b + 1)) AS cs, sum(w * w) AS sq, max(b) AS mb FROM e_sparse GROUP BY id)
SELECT m.hash, CAST(128 AS BIGINT) AS dim, round(coalesce(s.cs, 0.0), 6) AS checksum,
       round(coalesce(s.sq, 0.0), 6) AS norm_sq, s.mb AS max_bucket
FROM memories m LEFT JOIN s ON s.id = m.hash""")
def q_local_embed_dense(spark, sf):
    """Dense 128-float vectors, checked by a position-weighted checksum and squared norm."""
    m = with_embedding(memory_text(FX.memories(spark, sf)), "embed_text", as_float=False)
    cs = F.aggregate(F.transform("emb", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    sq = F.aggregate("emb", F.lit(0.0), lambda a, v: a + v * v)
    mb = F.array_max(F.transform("emb_sparse", lambda e: e["b"])).cast("bigint")
    return m.select("hash", F.size("emb").cast("bigint").alias("dim"), r6(cs).alias("checksum"),
                    r6(sq).alias("norm_sq"), mb.alias("max_bucket"))


# ---------------------------------------------------------------- V9 / A10


def _ingest(spark, sf):
    return D.ingest_files(FX.document_files(spark, sf), NOW, size=500, separator=r"\n+")


@register("ingest_documents", f"""
{chunks_sql('document_files', 'path, project', 'content', 500, '\\n+')},
rows AS (
  SELECT path, project, chunk_index, n_chunks, chunk,
    substr(sha256(concat(path, ':chunk', CAST(chunk_index AS VARCHAR), ':', '{NOW}')), 1, 16) AS hash,
    regexp_extract(path, '([^/]+)$', 1) AS fname
  FROM chunk_rows),
{embed_sql('rows', 'hash', 'chunk')},
s AS (SELECT id, count(*) AS nnz, sum(w) AS ws FROM e_sparse GROUP BY id)
SELECT r.path, r.chunk_index, r.hash, r.project, {SUMMARY_SQL} AS summary_text,
  {essence_sql('r.fname')} AS essence_text,
  array_to_string(['document', 'rag', r.fname], ',') AS tags, 2.0::DOUBLE AS importance,
  'knowledge' AS memory_type, 'ingest_{NOW}' AS session_id,
  CAST(coalesce(s.nnz, 0) AS BIGINT) AS emb_nnz, round(coalesce(s.ws, 0.0), 6) AS emb_sum
FROM rows r LEFT JOIN s ON s.id = r.hash""")
def q_ingest_documents(spark, sf):
    """Ingest every document file: chunk (500 chars, line separator), ids, summaries, embed."""
    i = _ingest(spark, sf)
    ws = F.aggregate("embedding_sparse", F.lit(0.0), lambda a, e: a + e["w"])
    return i.select("path", "chunk_index", "hash", "project", "summary_text", "essence_text",
                    joined("tags").alias("tags"), "importance", "memory_type", "session_id",
                    F.size("embedding_sparse").cast("bigint").alias("emb_nnz"), r6(ws).alias("emb_sum"))


@register("ingest_summary", f"""
{chunks_sql('document_files', 'path', 'content', 500, '\\n+')},
ids AS (SELECT path, chunk_index, n_chunks, length(_t) AS total_chars,
          substr(sha256(concat(path, ':chunk', CAST(chunk_index AS VARCHAR), ':', '{NOW}')), 1, 7) AS h7
        FROM chunk_rows)
SELECT path, max(n_chunks) AS chunks, CAST(max(total_chars) AS BIGINT) AS total_chars,
  CAST(floor(max(total_chars) / 4.0 + 0.5) AS BIGINT) AS token_estimate,
  string_agg(h7, ',' ORDER BY chunk_index) AS chunk_hashes
FROM ids GROUP BY path""")
def q_ingest_summary(spark, sf):
    return D.ingest_summary(FX.document_files(spark, sf), NOW, size=500, separator=r"\n+")
