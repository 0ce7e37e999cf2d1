"""Registered queries: file snapshots, chat sessions, vault sync and embedding usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.config import NOW
from memlake.functions.text import JS_SPACE
from memlake.operators import changes as W
from memlake.operators import records as RC
from memlake.plans.common import joined, register
from memlake.sources import fixtures as FX
from memlake.sources.tables import read_table
from memlake.session import materialize

# ---------------------------------------------------------------- snapshots

CHANGES_SQL = f"""chg AS (
  SELECT a.path, CASE WHEN s.hash IS NULL THEN 'new' WHEN s.file_hash = a.file_hash THEN 'cached' ELSE 'changed' END AS status,
    coalesce(s.hash, substr(sha256(concat('{NOW * 1000}', ':', a.path)), 1, 16)) AS hash,
    coalesce(a.project, s.project) AS project,
    CASE WHEN s.file_hash = a.file_hash THEN s.summary ELSE a.summary END AS summary,
    CASE WHEN s.file_hash = a.file_hash THEN s.essence ELSE a.essence END AS essence,
    a.size_bytes, a.file_hash, s.captured_at
  FROM snapshot_arrivals a LEFT JOIN stored_snapshots s USING (path))"""

UPSERT_SQL = f"""{CHANGES_SQL},
upserted AS (
  SELECT coalesce(s.hash, c.hash) AS hash, coalesce(s.path, c.path) AS path,
    CASE WHEN c.status = 'new' THEN c.project ELSE s.project END AS project,
    CASE WHEN c.status IS NOT NULL THEN c.summary ELSE s.summary END AS summary,
    CASE WHEN c.status IS NOT NULL THEN c.essence ELSE s.essence END AS essence,
    CASE WHEN c.status IS NOT NULL THEN c.size_bytes ELSE s.size_bytes END AS size_bytes,
    CASE WHEN c.status IS NOT NULL THEN c.file_hash ELSE s.file_hash END AS file_hash,
    CASE WHEN c.status = 'new' THEN CAST({NOW} AS BIGINT) ELSE s.captured_at END AS captured_at,
    CASE WHEN c.status IS NOT NULL THEN CAST({NOW} AS BIGINT) ELSE s.last_seen END AS last_seen
  FROM stored_snapshots s FULL OUTER JOIN chg c ON s.path = c.path)"""


def _upserted(spark, sf):
    return RC.snapshot_upsert(FX.stored_snapshots(spark, sf), FX.snapshot_arrivals(spark, sf), NOW)


@register("snapshot_change_detection", f"""{CHANGES_SQL}
SELECT path, status, hash, project, summary, essence FROM chg""")
def q_snapshot_change_detection(spark, sf):
    """Snapshot request for every arriving page: cached / changed / new."""
    c = RC.snapshot_changes(FX.stored_snapshots(spark, sf), FX.snapshot_arrivals(spark, sf), NOW)
    return c.select("path", "status", "hash", "project", "summary", "essence")


@register("snapshot_upsert", f"""{UPSERT_SQL}
SELECT * FROM upserted""")
def q_snapshot_upsert(spark, sf):
    """The file_snapshots table after the batch (upsert on path)."""
    return _upserted(spark, sf).select(*RC.SNAPSHOT_COLUMNS)


@register("snapshot_lookup", """
SELECT s.hash, s.path, s.file_hash, s.last_seen FROM stored_snapshots s
WHERE s.path IN (SELECT path FROM snapshot_arrivals)""")
def q_snapshot_lookup(spark, sf):
    """getSnapshot for every arriving path (semi join)."""
    s = FX.stored_snapshots(spark, sf)
    return (s.join(FX.snapshot_arrivals(spark, sf).select("path"), "path", "left_semi")
            .select("hash", "path", "file_hash", "last_seen"))


@register("snapshots_by_project", f"""{UPSERT_SQL}
SELECT project, path, last_seen
FROM upserted WHERE project IS NOT NULL""")
def q_snapshots_by_project(spark, sf):
    return RC.snapshots_by_project(_upserted(spark, sf)).select("project", "path", "last_seen")


# ---------------------------------------------------------------- sessions

SESSIONS_SQL = """roll AS (
  SELECT conv_id, count(*) AS turns_count,
    sum(length(CAST(to_json({'role': role, 'content': content}) AS VARCHAR))) AS obj_len,
    first(title) AS title, first(memory_hash) AS memory_hash, first(project) AS project, first(logged_at) AS created_at
  FROM chat_session_inputs GROUP BY conv_id),
sessions AS (
  SELECT conv_id, substr(sha256(concat(CAST(created_at * 1000 AS VARCHAR), ':', title)), 1, 16) AS id,
    memory_hash, project, title, turns_count,
    CAST(floor((2 + obj_len + turns_count - 1) / 4.0 + 0.5) AS BIGINT) AS token_count,
    CAST(2 + obj_len + turns_count - 1 AS BIGINT) AS turns_json_len, CAST(created_at AS BIGINT) AS created_at
  FROM roll)"""


def _sessions(spark, sf):
    return RC.session_rollup(FX.chat_session_inputs(spark, sf))


@register("session_rollup", f"""{SESSIONS_SQL}
SELECT id, memory_hash, project, title, turns_count, token_count, turns_json_len, created_at FROM sessions""")
def q_session_rollup(spark, sf):
    """Log-session request for every conversation: id, turn count, token estimate."""
    return _sessions(spark, sf).drop("conv_id")


def _logs(spark, sf):
    """Two logs of the sessions: all turns, and for every third conversation once more, later, its first two turns with times."""
    t = FX.chat_session_inputs(spark, sf)
    once = t.select("*", F.lit(None).cast("bigint").alias("timestamp"), F.lit(1).alias("arrival"))
    again = t.filter("conv_id % 3 = 0 AND turn < 2").select("*", (F.col("logged_at") + F.col("turn")).alias("timestamp"), F.lit(2).alias("arrival"))
    return once.filter("conv_id % 5 <> 0").unionByName(again), once.filter("conv_id % 2 = 0")


@register("store_sessions", f"""{SESSIONS_SQL},
logs AS (
  SELECT conv_id, turn, role, content, NULL::BIGINT AS ts, 1 AS arrival FROM chat_session_inputs WHERE conv_id % 5 <> 0
  UNION ALL SELECT conv_id, turn, role, content, logged_at + turn, 2 FROM chat_session_inputs WHERE conv_id % 3 = 0 AND turn < 2
  UNION ALL SELECT conv_id, turn, role, content, NULL, 0 FROM chat_session_inputs WHERE conv_id % 2 = 0),
kept AS (SELECT * FROM logs QUALIFY arrival = max(arrival) OVER (PARTITION BY conv_id))
SELECT s.id, any_value(s.title) AS title, count(*) AS n_turns, count(k.ts) AS n_times,
  sha256(string_agg(concat(k.role, ':', k.content, ':', coalesce(CAST(k.ts AS VARCHAR), '')), '|' ORDER BY k.turn)) AS turns_hash,
  CAST(floor((1 + count(*) + sum(length(CAST(to_json({{'role': k.role, 'content': k.content}}) AS VARCHAR))
    + CASE WHEN k.ts IS NULL THEN 0 ELSE length(concat(',"timestamp":', CAST(k.ts AS VARCHAR))) END)) / 4.0 + 0.5) AS BIGINT) AS token_count
FROM kept k JOIN sessions s USING (conv_id) GROUP BY s.id""")
def q_store_sessions(spark, sf):
    """Log-session request into a stored table: nested turns, replacement on id, two logs of one id in a batch leave one."""
    batch, before = _logs(spark, sf)
    s = RC.store_sessions(RC.build_sessions(before), RC.build_sessions(batch, "arrival"), "arrival")
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["content"], F.lit(":"),
                                                                F.coalesce(t["timestamp"].cast("string"), F.lit("")))), "|")
    return s.select("id", "title", F.size("turns").alias("n_turns"), F.size(F.filter("turns", lambda t: t["timestamp"].isNotNull())).alias("n_times"),
                    F.sha2(text, 256).alias("turns_hash"), "token_count")


@register("session_lookup", f"""{SESSIONS_SQL}
SELECT s.id, s.title, s.token_count, c.turn, c.role, c.content
FROM sessions s JOIN chat_session_inputs c USING (conv_id) WHERE conv_id IN (SELECT doc_id FROM labels)""")
def q_session_lookup(spark, sf):
    """The sessions of labelled conversations with their turns; the turns are narrowed to them first."""
    wanted = read_table(spark, sf, "labels").select(F.col("doc_id").alias("conv_id"))
    turns = FX.chat_session_inputs(spark, sf).join(wanted, "conv_id", "left_semi")
    heads = RC.session_rollup(turns).select("id", "title", "token_count")
    return heads.join(RC.session_turns(turns), "id").select("id", "title", "token_count", "turn", "role", "content")


@register("sessions_by_project", f"""{SESSIONS_SQL}
SELECT id, memory_hash, project, title, token_count, created_at,
       row_number() OVER (PARTITION BY project ORDER BY created_at DESC, id) AS rank
FROM sessions WHERE project IS NOT NULL QUALIFY rank <= 20""")
def q_sessions_by_project(spark, sf):
    return RC.sessions_by_project(_sessions(spark, sf))


@register("sessions_recent", f"""{SESSIONS_SQL}
SELECT id, memory_hash, project, title, token_count, created_at FROM sessions ORDER BY created_at DESC, id LIMIT 50""")
def q_sessions_recent(spark, sf):
    return RC.recent_sessions(_sessions(spark, sf))


@register("sessions_with_memory", f"""{SESSIONS_SQL}
SELECT s.id, s.memory_hash, m.importance AS memory_importance, m.project AS memory_project
FROM sessions s LEFT JOIN memories m ON m.hash = s.memory_hash""")
def q_sessions_with_memory(spark, sf):
    j = RC.sessions_with_memory(_sessions(spark, sf), FX.memories(spark, sf))
    return j.select("id", "memory_hash", "memory_importance", "memory_project")


# ---------------------------------------------------------------- vault

NUMLIKE = r"^([-+]?(\.[0-9]+|[0-9]+(\.[0-9]*)?)([eE][-+]?[0-9]+)?|true|false|null|~|)$"


PLAIN = r"^[A-Za-z0-9_./@+]([A-Za-z0-9_./@+ -]*[A-Za-z0-9_./@+-])?$"


def _y(x: str) -> str:
    return (f"CASE WHEN regexp_matches({x}, '{PLAIN}') AND NOT regexp_matches({x}, '{NUMLIKE}') THEN {x} "
            f"ELSE concat('\"', replace(replace({x}, '\\', '\\\\'), '\"', '\\\"'), '\"') END")


def _esc(x: str) -> str:
    return f"regexp_replace({x}, '(?m)^(\\\\*)## ', '\\\\\\1## ', 'g')"


def _unesc(x: str) -> str:
    return f"regexp_replace({x}, '(?m)^\\\\(\\\\*)## ', '\\1## ', 'g')"


def _iso(x: str) -> str:
    return f"strftime(make_timestamp({x} * 1000000), '%Y-%m-%dT%H:%M:%S.000Z')"


VAULT_MD_SQL = f"""vault_md AS (
  SELECT hash, sensitivity, created_at,
    concat(strftime(make_timestamp(created_at * 1000000), '%Y-%m-%d'), '_', substr(hash, 1, 7), '_',
           CASE WHEN len(tags) > 0 THEN regexp_replace(tags[1], '[^a-zA-Z0-9-]', '-', 'g') ELSE memory_type END, '.md') AS path,
    concat('---', chr(10),
      'hash: ', {_y('hash')}, chr(10),
      'importance: ', CASE WHEN importance = floor(importance) THEN CAST(CAST(floor(importance) AS BIGINT) AS VARCHAR) ELSE CAST(importance AS VARCHAR) END, chr(10),
      'memory_type: ', {_y('memory_type')}, chr(10),
      'sensitivity: ', {_y('sensitivity')}, chr(10),
      CASE WHEN len(tags) > 0 THEN concat('tags:', chr(10), array_to_string(list_transform(tags, lambda t: concat('  - ', {_y('t')})), chr(10)))
           ELSE 'tags: []' END, chr(10),
      'project: ', {_y("coalesce(CASE WHEN project <> '' THEN project END, 'none')")}, chr(10),
      'session_id: ', {_y('session_id')}, chr(10),
      'created_at: ', {_iso('created_at')}, chr(10),
      'last_accessed: ', {_iso('last_accessed')}, chr(10),
      'access_count: ', CAST(access_count AS VARCHAR), chr(10),
      '---', chr(10), chr(10), '# ', {_esc('essence_text')}, chr(10), chr(10), '## Summary', chr(10), {_esc('summary_text')},
      chr(10), chr(10), '## Full Detail', chr(10), {_esc('full_text')},
      CASE WHEN context_log IS NOT NULL AND context_log <> '' THEN concat(chr(10), chr(10), '## Context Log', chr(10),
           '_Full conversation / reasoning trail that led to this memory:_', chr(10), chr(10), {_esc('context_log')}) ELSE '' END,
      CASE WHEN project IS NOT NULL AND project <> '' THEN concat(chr(10), chr(10), '## Links', chr(10), '- Project: [[', project, ']]',
           array_to_string(list_transform(tags, lambda t: concat(chr(10), '- Tag: [[', t, ']]')), '')) ELSE '' END,
      chr(10)) AS content
  FROM memories)"""


@register("vault_paths", f"""{VAULT_MD_SQL}
SELECT hash, path FROM vault_md WHERE sensitivity <> 'secret'""")
def q_vault_paths(spark, sf):
    m = FX.memories(spark, sf).filter(F.col("sensitivity") != "secret")
    return m.select("hash", RC.vault_path().alias("path"))


@register("vault_export", f"""{VAULT_MD_SQL}
SELECT path, content FROM vault_md WHERE sensitivity <> 'secret'""")
def q_vault_export(spark, sf):
    """Table -> vault: the Markdown file of every non-secret memory."""
    return RC.vault_export(FX.memories(spark, sf))


def vault_files(spark, sf):
    """The vault as users left it: the export of the memory table, then edited by hand."""
    v = RC.vault_markdown(FX.memories(spark, sf).filter(F.col("sensitivity") != "secret"))
    first = F.substring("hash", 1, 1)
    c = F.col("content")
    edited = (F.when(first.isin("0", "1", "2", "3"), F.replace(c, F.lit("## Summary\n"), F.lit("## Summary\nEdited: ")))
              .when(first.isin("4", "5", "6", "7"), F.regexp_replace(c, r"(?m)^importance: .*$", "importance: 5"))
              .when(first == "8", F.regexp_replace(c, r"(?m)^tags:(\n  - .*)*", "tags: []"))
              .when(first == "9", F.regexp_replace(c, r"(?m)^tags:(\n  - .*)*", "tags: [flow one, \"two: x\", 'three']"))
              .when(first.isin("a", "b"), F.concat(c, F.lit("\n## Context Log\n_note:_\n\nadded in the vault\n")))
              .otherwise(c))
    files = v.select("hash", "path", edited.alias("content"))
    dups = (files.filter(first == "f")
            .select("hash", F.concat("path", F.lit(".dup.md")).alias("path"),
                    F.replace(F.col("content"), F.lit("## Summary\n"), F.lit("## Summary\nDuplicate: ")).alias("content")))
    return files.unionByName(dups).select("path", "content")


VAULT_FILES_SQL = f"""{VAULT_MD_SQL},
vf AS (
  SELECT hash, path, CASE
      WHEN substr(hash, 1, 1) IN ('0', '1', '2', '3') THEN replace(content, concat('## Summary', chr(10)), concat('## Summary', chr(10), 'Edited: '))
      WHEN substr(hash, 1, 1) IN ('4', '5', '6', '7') THEN regexp_replace(content, '(?m)^importance: .*$', 'importance: 5', 'g')
      WHEN substr(hash, 1, 1) = '8' THEN regexp_replace(content, '(?m)^tags:(\\n  - .*)*', 'tags: []', 'g')
      WHEN substr(hash, 1, 1) = '9' THEN regexp_replace(content, '(?m)^tags:(\\n  - .*)*', 'tags: [flow one, "two: x", ''three'']', 'g')
      WHEN substr(hash, 1, 1) IN ('a', 'b') THEN concat(content, chr(10), '## Context Log', chr(10), '_note:_', chr(10), chr(10), 'added in the vault', chr(10))
      ELSE content END AS content
  FROM vault_md WHERE sensitivity <> 'secret'),
vault_files AS (
  SELECT path, content FROM vf
  UNION ALL
  SELECT concat(path, '.dup.md'), replace(content, concat('## Summary', chr(10)), concat('## Summary', chr(10), 'Duplicate: '))
  FROM vf WHERE substr(hash, 1, 1) = 'f')"""


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{JS_SPACE}+|{JS_SPACE}+$', '', 'g')"


def _sec(title: str) -> str:
    return _trim(_unesc(f"split_part(regexp_extract(body, '## {title}\\n([\\s\\S]*)', 1), concat(chr(10), '## '), 1)"))


def _fmv(key: str) -> str:
    v = f"regexp_extract(fm, '(?m)^{key}: (.*)$', 1)"
    return f"CASE WHEN regexp_matches({v}, '^\".*\"$') THEN regexp_replace(substr({v}, 2), '\"$', '') ELSE {v} END"


PARSE_SQL = f"""{VAULT_FILES_SQL},
pv0 AS (
  SELECT path, regexp_extract(content, '^---\\n([\\s\\S]+?)\\n---', 0) AS head,
         regexp_extract(content, '^---\\n([\\s\\S]+?)\\n---', 1) AS fm, content
  FROM vault_files),
pv1 AS (SELECT path, fm, substr(content, length(head) + 1) AS body FROM pv0 WHERE head <> ''),
parsed AS (
  SELECT path, {_fmv('hash')} AS hash,
    CASE WHEN {_fmv('importance')} <> '' THEN CAST({_fmv('importance')} AS DOUBLE) END AS importance,
    list_filter(list_transform(CASE WHEN regexp_matches(fm, '(?m)^tags: \\[') THEN string_split(regexp_extract(fm, '(?m)^tags: \\[(.*)\\]$', 1), ', ')
                               ELSE string_split(regexp_extract(fm, '(?m)^tags:((?:\\n  - .*)*)', 1), concat(chr(10), '  - ')) END,
                               lambda t: regexp_replace(t, '^["'']|["'']$', '', 'g')), lambda t: t <> '') AS tags,
    {_sec('Summary')} AS summary_text, {_sec('Full Detail')} AS full_text,
    CASE WHEN regexp_matches(body, '\\n## Context Log\\n_[^_]*_\\n\\n')
         THEN {_trim(_unesc("split_part(regexp_extract(body, '\\n## Context Log\\n_[^_]*_\\n\\n([\\s\\S]*)', 1), concat(chr(10), '## '), 1)"))} END AS context_log
  FROM pv1)"""


def _ts(key: str) -> str:
    return f"CAST(floor(epoch(try_strptime({_fmv(key)}, '%Y-%m-%dT%H:%M:%S.%gZ'))) AS BIGINT)"


@register("vault_parse", f"""{PARSE_SQL},
meta AS (
  SELECT path,
    coalesce(CASE WHEN {_fmv('memory_type')} <> '' THEN {_fmv('memory_type')} END, 'conversation') AS memory_type,
    coalesce(CASE WHEN {_fmv('sensitivity')} <> '' THEN {_fmv('sensitivity')} END, 'public') AS sensitivity,
    CASE WHEN {_fmv('project')} IN ('none', '') THEN NULL ELSE {_fmv('project')} END AS project,
    CASE WHEN {_fmv('session_id')} <> '' THEN {_fmv('session_id')} END AS session_id,
    {_ts('created_at')} AS created_at, {_ts('last_accessed')} AS last_accessed,
    coalesce(TRY_CAST({_fmv('access_count')} AS BIGINT), 0) AS access_count
  FROM pv1)
SELECT p.path, p.hash, p.importance, m.memory_type, m.sensitivity, m.project, m.session_id, m.created_at,
       m.last_accessed, m.access_count, array_to_string(p.tags, ',') AS tags, p.summary_text,
       CAST(length(p.full_text) AS BIGINT) AS full_len, p.context_log
FROM parsed p JOIN meta m USING (path) WHERE p.hash <> ''""")
def q_vault_parse(spark, sf):
    """S6: every vault document (edited export) parsed into a partial memory row."""
    p = RC.parse_vault(materialize(vault_files(spark, sf), "vault_files"))
    return p.select("path", "hash", "importance", "memory_type", "sensitivity", "project", "session_id",
                    "created_at", "last_accessed", "access_count", F.array_join("tags", ",").alias("tags"),
                    "summary_text", F.length("full_text").cast("bigint").alias("full_len"), "context_log")


@register("vault_merge", f"""{PARSE_SQL},
live AS (SELECT * FROM memories WHERE NOT (NOT explicit_save AND importance < 3 AND last_accessed < {NOW - 30 * 24 * 3600})),
lastv AS (SELECT * FROM parsed WHERE hash <> '' QUALIFY row_number() OVER (PARTITION BY hash ORDER BY path DESC) = 1)
SELECT m.hash, coalesce(v.importance, m.importance) AS importance,
  CASE WHEN length(v.summary_text) > 0 THEN v.summary_text ELSE m.summary_text END AS summary_text,
  length(CASE WHEN length(v.full_text) > 0 THEN v.full_text ELSE m.full_text END) AS full_len,
  array_to_string(v.tags, ',') AS tags, coalesce(v.context_log, m.context_log) AS context_log
FROM live m JOIN lastv v USING (hash)""")
def q_vault_merge(spark, sf):
    """Vault -> table after retention: parse the edited vault, merge into live memories."""
    live = W.gc_survivors(FX.memories(spark, sf), NOW)
    # the vault is stored input: materialise the stand-in files once (a written table)
    files = materialize(vault_files(spark, sf), "vault_files")
    merged = RC.vault_merge(live, RC.parse_vault(files))
    return merged.select("hash", "importance", "summary_text", F.length("full_text").cast("bigint").alias("full_len"),
                         joined("tags").alias("tags"), "context_log")


@register("vault_orphans", f"""{VAULT_MD_SQL},
live AS (SELECT hash FROM memories WHERE NOT (NOT explicit_save AND importance < 3 AND last_accessed < {NOW - 30 * 24 * 3600}))
SELECT path FROM vault_md WHERE sensitivity <> 'secret'
  AND regexp_extract(path, '_([0-9a-f]{{7}})_', 1) NOT IN (SELECT substr(hash, 1, 7) FROM live)""")
def q_vault_orphans(spark, sf):
    """Vault files left behind by retention (their memory is gone)."""
    files = RC.vault_export(FX.memories(spark, sf))
    return RC.vault_orphans(files, W.gc_survivors(FX.memories(spark, sf), NOW))


# ---------------------------------------------------------------- usage


@register("embed_usage", """
SELECT count(*) FILTER (WHERE kind = 'remote') AS remote_calls,
  CAST(coalesce(sum(chars) FILTER (WHERE kind = 'remote'), 0) AS BIGINT) AS remote_chars,
  CAST(floor(coalesce(sum(chars) FILTER (WHERE kind = 'remote'), 0) / 4.0 + 0.5) AS BIGINT) AS tokens_est,
  count(*) FILTER (WHERE kind = 'fallback') AS fallback_calls,
  strftime(max(ts) FILTER (WHERE kind = 'remote'), '%Y-%m-%dT%H:%M:%S.%gZ') AS last_call_at
FROM embed_call_log""")
def q_embed_usage(spark, sf):
    """Embedding usage counters over the call log (events)."""
    return RC.embed_usage(FX.embed_call_log(spark, sf))
