"""DuckDB definitions of the stand-in inputs (same rules as memlake.sources.fixtures).

Each oracle query is `WITH <these views> <query>`; DuckDB only evaluates the views a query
references.
"""

from __future__ import annotations

from memlake.config import NOW
from memlake.functions.text import JS_SPACE
from memlake.sources.fixtures import SNAPSHOT_OLD_TIME

INPUT_VIEWS = f"""
mem_doc AS (
  SELECT doc_id, text, lang, source,
         {NOW} - ((doc_id * 37) % 800) * 3600 AS la,
         {NOW} - ((doc_id * 37) % 800) * 3600 - (doc_id % 50) * 3600 AS ca
  FROM documents),
memories_d AS (
  SELECT doc_id,
    substr(sha256(concat(CAST(ca AS VARCHAR), ':', text)), 1, 16) AS hash,
    CAST(ca AS BIGINT) AS created_at, CAST(la AS BIGINT) AS last_accessed,
    CAST(doc_id % 7 AS BIGINT) AS access_count,
    CAST(doc_id % 5 + 1 AS DOUBLE) AS importance,
    doc_id % 11 = 0 AS explicit_save,
    text AS full_text,
    replace(text, chr(10), ' ') AS summary_text,
    split_part(text, chr(10), 1) AS essence_text,
    CAST(NULL AS VARCHAR) AS context_log,
    [lang, concat('g', CAST(doc_id % 10 AS VARCHAR))] AS tags,
    (['conversation', 'knowledge', 'learning', 'decision', 'architecture'])[doc_id % 5 + 1] AS memory_type,
    CASE WHEN doc_id % 10 < 6 THEN 'public' WHEN doc_id % 10 < 9 THEN 'internal' ELSE 'secret' END AS sensitivity,
    CASE WHEN doc_id % 13 = 0 THEN NULL ELSE source END AS project,
    concat('session_', CAST(la AS VARCHAR)) AS session_id,
    concat('user_', CAST(doc_id % 4 AS VARCHAR)) AS owner_id
  FROM mem_doc),
memories AS (SELECT * EXCLUDE (doc_id) FROM memories_d),
access_log AS (
  SELECT m.hash, CAST(epoch_us(e.ts) // 1000000 AS BIGINT) AS ts
  FROM events e JOIN memories_d m ON e.event_id % (SELECT count(*) FROM documents) = m.doc_id),
store_requests AS (
  SELECT concat(CAST(conv_id AS VARCHAR), '-', CAST(turn AS VARCHAR)) AS request_id,
    text AS content,
    replace(text, chr(10), ' ') AS summary,
    split_part(text, chr(10), 1) AS essence,
    CAST((conv_id + turn) % 7 AS DOUBLE) AS importance,
    ['chat', concat('c', CAST(conv_id AS VARCHAR))] AS tags,
    CASE WHEN conv_id % 9 = 0 THEN NULL ELSE concat('src', CAST(conv_id % 20 AS VARCHAR)) END AS project,
    (['conversation', 'knowledge', 'learning', 'decision', 'architecture', 'note'])[turn % 6 + 1] AS memory_type,
    (['public', 'internal', 'secret', 'private'])[conv_id % 4 + 1] AS sensitivity,
    CASE WHEN conv_id % 3 = 0 THEN NULL ELSE concat('user_', CAST(conv_id % 4 AS VARCHAR)) END AS owner_id,
    CASE WHEN turn % 4 = 1 THEN text ELSE NULL END AS context_log,
    conv_id * 1000 + turn + 10 AS arrival
  FROM conversations),
search_requests AS (
  SELECT query_id, regexp_replace(query, '^{JS_SPACE}+|{JS_SPACE}+$', '', 'g') AS query FROM (
    SELECT item_id * 10000 + unnest(range(len(s))) AS query_id, unnest(s) AS query
    FROM (SELECT item_id, regexp_extract_all(text, '[^.!?]+[.!?]*') AS s FROM benchmark))
  WHERE regexp_replace(query, '^{JS_SPACE}+|{JS_SPACE}+$', '', 'g') <> ''),
requests AS (
  SELECT item_id AS request_id,
    CASE WHEN item_id % 4 = 0 THEN NULL ELSE concat('src', CAST(item_id % 20 AS VARCHAR)) END AS project,
    CASE WHEN item_id % 5 = 0 THEN NULL ELSE concat('user_', CAST(item_id % 4 AS VARCHAR)) END AS owner,
    CASE WHEN item_id % 3 = 0 THEN NULL
         ELSE [concat('src', CAST((item_id + 1) % 20 AS VARCHAR)),
               concat('src', CAST((item_id + item_id % 2) % 20 AS VARCHAR))] END AS allowed
  FROM benchmark),
snapshot_pages AS (
  SELECT page_id, url AS path, regexp_extract(url, '([a-z0-9-]+)\\.example\\.', 1) AS project, html
  FROM pages),
stored_snapshots AS (
  SELECT substr(sha256(concat(CAST({SNAPSHOT_OLD_TIME * 1000} AS VARCHAR), ':', path)), 1, 16) AS hash,
    path, project,
    regexp_extract(html, '<title>([^<]*)</title>', 1) AS summary,
    regexp_extract(html, '<title>([^<]*)</title>', 1) AS essence,
    CAST(octet_length(encode(html)) AS BIGINT) AS size_bytes,
    sha256(html) AS file_hash,
    CAST({SNAPSHOT_OLD_TIME} AS BIGINT) AS captured_at, CAST({SNAPSHOT_OLD_TIME} AS BIGINT) AS last_seen
  FROM snapshot_pages),
arrival_pages AS (
  SELECT path, project,
    CASE WHEN page_id % 3 = 0 THEN concat(html, '<!-- edited -->') ELSE html END AS html
  FROM snapshot_pages WHERE page_id % 7 <> 0
  UNION ALL
  SELECT concat(path, '#moved') AS path, project, html FROM snapshot_pages WHERE page_id % 5 = 0),
snapshot_arrivals AS (
  SELECT path, project,
    regexp_extract(html, '<title>([^<]*)</title>', 1) AS summary,
    regexp_extract(html, '<title>([^<]*)</title>', 1) AS essence,
    CAST(octet_length(encode(html)) AS BIGINT) AS size_bytes,
    sha256(html) AS file_hash
  FROM arrival_pages),
session_heads AS (
  SELECT f.conv_id, replace(f.text, chr(10), ' ') AS title, m.hash AS memory_hash,
    CASE WHEN f.conv_id % 9 = 0 THEN NULL ELSE concat('src', CAST(f.conv_id % 20 AS VARCHAR)) END AS project,
    CAST({NOW} - f.conv_id * 600 AS BIGINT) AS logged_at
  FROM (SELECT conv_id, min_by(text, turn) AS text FROM conversations GROUP BY conv_id) f
  LEFT JOIN memories_d m ON m.doc_id = f.conv_id),
chat_session_inputs AS (
  SELECT c.conv_id, c.turn, c.role, c.text AS content, h.title, h.memory_hash, h.project, h.logged_at
  FROM conversations c JOIN session_heads h ON c.conv_id = h.conv_id),
embed_call_log AS (
  SELECT ts, CASE WHEN event_type = 'error' THEN 'fallback' ELSE 'remote' END AS kind,
    CAST(floor(value + 0.5) AS BIGINT) AS chars
  FROM events),
document_files AS (
  SELECT concat('/docs/', source, '/doc_', CAST(doc_id AS VARCHAR), '.md') AS path,
    source AS project, text AS content
  FROM documents),
cluster_items AS (
  SELECT lpad(CAST(vec_id AS VARCHAR), 8, '0') AS hash, embedding AS vec,
    [concat('label', CAST(label AS VARCHAR))] AS tags
  FROM embeddings)
"""


def with_inputs(body: str) -> str:
    return "WITH " + INPUT_VIEWS.strip() + ",\n" + body.strip()
