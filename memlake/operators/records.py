"""File snapshots, chat sessions, the Markdown vault and embedding usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.operators.changes import latest_per_key
from memlake.functions.text import content_id, iso_utc, js_number, js_trim, short_id, token_estimate

# ------------------------------------------------------------------ file snapshots

SNAPSHOT_COLUMNS = ["hash", "path", "project", "summary", "essence", "size_bytes", "file_hash",
                    "captured_at", "last_seen"]


def one_arrival_per_path(arrivals: DataFrame) -> DataFrame:
    """Several sightings of one path in a batch collapse to one: the latest by `arrival` when
    that column exists, else a deterministic pick (largest file hash; NULL is least, ties go by
    a row hash) - an aggregate with partial merge, so a hot path is no single-task hot spot."""
    by = F.col("arrival") if "arrival" in arrivals.columns else F.col("file_hash")
    cols = [c for c in arrivals.columns if c != "path"]
    order = F.struct(by.isNotNull(), by, F.xxhash64(*cols))
    return (arrivals.groupBy("path").agg(F.max_by(F.struct(*cols), order).alias("_a"))
            .select("path", "_a.*"))


def snapshot_changes(stored: DataFrame, arrivals: DataFrame, now: int) -> DataFrame:
    """Snapshot request for a batch of files (one arrival per path is kept, see
    `one_arrival_per_path`).

    status: cached (same file hash: the stored summary/essence are kept), changed, or new.
    A changed file keeps its stored id (the id the table really holds); a new file gets the
    id of `{now ms}:{path}`.
    """
    arrivals = one_arrival_per_path(arrivals)
    s = stored.select("path", F.col("hash").alias("s_hash"), F.col("file_hash").alias("s_file_hash"),
                      F.col("summary").alias("s_summary"), F.col("essence").alias("s_essence"),
                      F.col("project").alias("s_project"), "captured_at")
    j = arrivals.join(s, "path", "left")
    status = (F.when(F.col("s_hash").isNull(), "new")
              .when(F.col("s_file_hash") == F.col("file_hash"), "cached").otherwise("changed"))
    cached = status == "cached"
    return j.select(
        "path", status.alias("status"),
        F.coalesce("s_hash", content_id(str(now * 1000), ":", F.col("path"))).alias("hash"),
        F.coalesce(F.col("project"), F.col("s_project")).alias("project"),
        F.when(cached, F.col("s_summary")).otherwise(F.col("summary")).alias("summary"),
        F.when(cached, F.col("s_essence")).otherwise(F.col("essence")).alias("essence"),
        "size_bytes", "file_hash", "captured_at")


def snapshot_upsert(stored: DataFrame, arrivals: DataFrame, now: int) -> DataFrame:
    """New file_snapshots table: upsert on path. On conflict only summary, essence, size,
    file hash and last_seen change (id, project and capture time are kept)."""
    ch = snapshot_changes(stored, arrivals, now)
    t = F.lit(now).cast("bigint")
    upd = ch.select(
        "path", F.col("hash").alias("u_hash"), F.col("project").alias("u_project"),
        F.col("summary").alias("u_summary"), F.col("essence").alias("u_essence"),
        F.col("size_bytes").alias("u_size"), F.col("file_hash").alias("u_fh"),
        F.col("status").alias("u_status"))
    j = stored.join(upd, "path", "full_outer")
    new = F.col("u_status") == "new"
    seen = F.col("u_status").isNotNull()
    return j.select(
        F.coalesce("hash", "u_hash").alias("hash"), "path",
        F.when(new, F.col("u_project")).otherwise(F.col("project")).alias("project"),
        F.when(seen, F.col("u_summary")).otherwise(F.col("summary")).alias("summary"),
        F.when(seen, F.col("u_essence")).otherwise(F.col("essence")).alias("essence"),
        F.when(seen, F.col("u_size")).otherwise(F.col("size_bytes")).alias("size_bytes"),
        F.when(seen, F.col("u_fh")).otherwise(F.col("file_hash")).alias("file_hash"),
        F.when(new, t).otherwise(F.col("captured_at")).alias("captured_at"),
        F.when(seen, t).otherwise(F.col("last_seen")).alias("last_seen"))


def snapshots_by_project(snaps: DataFrame) -> DataFrame:
    """All snapshots of every project, newest sighting first: one range sort over (project, last_seen,
    path), which cuts a large project over many tasks."""
    return snaps.filter(F.col("project").isNotNull()).orderBy("project", F.desc("last_seen"), "path")


# ------------------------------------------------------------------ chat sessions


def session_rollup(turns: DataFrame) -> DataFrame:
    """Log-session request for many conversations.

    `turns(conv_id, turn, role, content, title, memory_hash, project, logged_at)`. The token
    estimate is round(len(JSON of the turn list) / 4); the JSON length is additive over turns
    (2 brackets + each turn object + n-1 commas), so it is an ordinary aggregate with a
    map-side partial step - a conversation holding a third of all turns is no hot spot.
    """
    tj = F.length(F.to_json(F.struct("role", "content")))
    g = (turns.groupBy("conv_id")
         .agg(F.count("*").alias("turns_count"), F.sum(tj).alias("obj_len"),
              F.first("title").alias("title"), F.first("memory_hash").alias("memory_hash"),
              F.first("project").alias("project"), F.first("logged_at").alias("created_at")))
    json_len = F.lit(2) + F.col("obj_len") + F.col("turns_count") - 1
    return g.select(
        "conv_id",
        content_id((F.col("created_at") * 1000).cast("string"), ":", F.col("title")).alias("id"),
        "memory_hash", "project", "title", "turns_count",
        token_estimate(json_len).alias("token_count"), json_len.cast("bigint").alias("turns_json_len"),
        F.col("created_at").cast("bigint").alias("created_at"))


def session_turns(turns: DataFrame) -> DataFrame:
    """The stored turns of every session: (id, turn, role, content). The id is worked out in the row."""
    return turns.select(content_id((F.col("logged_at") * 1000).cast("string"), ":", F.col("title")).alias("id"),
                        "turn", "role", "content")


def build_sessions(turns: DataFrame, *keep: str) -> DataFrame:
    """Log-session requests as session rows with nested turns: (id, memory_hash, project, title, turns, token_count, created_at, *keep).

    `turns` as for `session_rollup`, with an optional `timestamp` per turn; `keep` names columns that tell the logs of one
    conversation apart (an arrival number). The id is that of `{logged_at ms}:{title}`, so the same log sent twice has one id."""
    stamp = F.col("timestamp") if "timestamp" in turns.columns else F.lit(None)
    turn = F.struct("turn", "role", "content", stamp.cast("bigint").alias("timestamp"))
    g = turns.groupBy("conv_id", *keep).agg(
        F.array_sort(F.collect_list(turn)).alias("t"), F.first("title").alias("title"), F.first("memory_hash").alias("memory_hash"),
        F.first("project").alias("project"), F.first("logged_at").alias("created_at"))
    g = g.withColumn("turns", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"), x["timestamp"].alias("timestamp"))))
    return g.select(content_id((F.col("created_at") * 1000).cast("string"), ":", F.col("title")).alias("id"), "memory_hash", "project", "title",
                    "turns", token_estimate(F.length(F.to_json("turns"))).alias("token_count"), F.col("created_at").cast("bigint").alias("created_at"), *keep)


def store_sessions(stored: DataFrame, new: DataFrame, order_col: str | None = None) -> DataFrame:
    """Sessions after a log-session batch: insert or replace on id. Several logs of one id in the batch leave one session, the
    latest by `order_col` (ties and a missing column: a deterministic pick)."""
    order_col = order_col or "created_at"
    latest = latest_per_key(new, "id", order_col).select(*stored.columns)
    return stored.join(latest.select("id"), "id", "left_anti").unionByName(latest)


def recent_sessions(sessions: DataFrame, limit: int = 50) -> DataFrame:
    return (sessions.select("id", "memory_hash", "project", "title", "token_count", "created_at")
            .orderBy(F.desc("created_at"), "id").limit(limit))


def sessions_by_project(sessions: DataFrame, limit: int = 20) -> DataFrame:
    w = Window.partitionBy("project").orderBy(F.desc("created_at"), "id")
    return (sessions.filter(F.col("project").isNotNull())
            .select("id", "memory_hash", "project", "title", "token_count", "created_at")
            .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit))


def sessions_with_memory(sessions: DataFrame, mem: DataFrame) -> DataFrame:
    m = mem.select(F.col("hash").alias("memory_hash"), F.col("importance").alias("memory_importance"),
                   F.col("project").alias("memory_project"))
    return sessions.join(m, "memory_hash", "left")


# ------------------------------------------------------------------ vault

VAULT_LABEL_JUNK = r"[^a-zA-Z0-9-]"
YAML_NUMBERLIKE = r"^([-+]?(\.[0-9]+|[0-9]+(\.[0-9]*)?)([eE][-+]?[0-9]+)?|true|false|null|~|)$"
#: Scalars that every YAML reader takes as they stand.
YAML_PLAIN = r"^[A-Za-z0-9_./@+]([A-Za-z0-9_./@+ -]*[A-Za-z0-9_./@+-])?$"


def vault_path(created_at="created_at", hash_col="hash", tags="tags", memory_type="memory_type"):
    """{UTC date}_{id7}_{first tag with [^a-zA-Z0-9-] -> '-', or the memory type}.md"""
    label = F.when(F.size(tags) > 0, F.regexp_replace(F.try_element_at(tags, F.lit(1)), VAULT_LABEL_JUNK, "-")) \
        .otherwise(F.col(memory_type))
    return F.concat(F.date_format(F.timestamp_seconds(F.col(created_at)), "yyyy-MM-dd"), F.lit("_"),
                    short_id(hash_col), F.lit("_"), label, F.lit(".md"))


def _yaml_scalar(c):
    """Plain scalar, double-quoted with escapes unless a YAML reader takes it as the same plain text."""
    text = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, escaped in _YAML_ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    plain = F.regexp_like(c, F.lit(YAML_PLAIN)) & ~F.regexp_like(c, F.lit(YAML_NUMBERLIKE))
    return F.when(plain, c).otherwise(F.concat(F.lit('"'), text, F.lit('"')))


_YAML_ESCAPES = (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"))


def _yaml_text(c):
    """The text of a plain, single- or double-quoted scalar."""
    hold = "\ue000"
    double = F.replace(F.substr(c, F.lit(2), F.length(c) - 2), F.lit("\\\\"), F.lit(hold))
    for raw, escaped in _YAML_ESCAPES:
        double = F.replace(double, F.lit(escaped), F.lit(raw))
    double = F.replace(F.replace(double, F.lit('\\"'), F.lit('"')), F.lit(hold), F.lit("\\"))
    single = F.replace(F.substr(c, F.lit(2), F.length(c) - 2), F.lit("''"), F.lit("'"))
    return (F.when(F.regexp_like(c, F.lit(r'^"[\s\S]*"$')) & (F.length(c) > 1), double)
            .when(F.regexp_like(c, F.lit(r"^'[\s\S]*'$")) & (F.length(c) > 1), single).otherwise(c))


# A text line starting with (backslashes and) "## " would end its section on import; export
# adds one backslash to such lines and import removes it again, so texts round-trip exactly.
HEADING_LINE = r"(?m)^(\\*)## "


def escape_headings(c):
    return F.regexp_replace(c, HEADING_LINE, r"\\$1## ")


def unescape_headings(c):
    return F.regexp_replace(c, r"(?m)^\\(\\*)## ", "$1## ")


def vault_markdown(mem: DataFrame) -> DataFrame:
    """(hash, path, content): front matter, heading, Summary, Full Detail, optional Context
    Log, Links when a project is set."""
    tags_yaml = F.when(F.size("tags") > 0,
                       F.concat(F.lit("tags:\n"), F.array_join(F.transform("tags", lambda t: F.concat(F.lit("  - "), _yaml_scalar(t))), "\n"))
                       ).otherwise(F.lit("tags: []"))
    fm = F.concat_ws(
        "\n",
        F.concat(F.lit("hash: "), _yaml_scalar(F.col("hash"))),
        F.concat(F.lit("importance: "), js_number("importance")),
        F.concat(F.lit("memory_type: "), _yaml_scalar(F.col("memory_type"))),
        F.concat(F.lit("sensitivity: "), _yaml_scalar(F.col("sensitivity"))),
        tags_yaml,
        F.concat(F.lit("project: "), _yaml_scalar(F.coalesce(F.when(F.col("project") != "", F.col("project")), F.lit("none")))),
        F.concat(F.lit("session_id: "), _yaml_scalar(F.col("session_id"))),
        F.concat(F.lit("created_at: "), iso_utc("created_at")),
        F.concat(F.lit("last_accessed: "), iso_utc("last_accessed")),
        F.concat(F.lit("access_count: "), F.col("access_count").cast("string")),
    )
    ctx = F.when(F.col("context_log").isNotNull() & (F.col("context_log") != ""),
                 F.concat(F.lit("\n\n## Context Log\n_Full conversation / reasoning trail that led to this memory:_\n\n"),
                          escape_headings(F.col("context_log")))).otherwise(F.lit(""))
    links = F.when(F.col("project").isNotNull() & (F.col("project") != ""),
                   F.concat(F.lit("\n\n## Links\n- Project: [["), F.col("project"), F.lit("]]"),
                            F.array_join(F.transform("tags", lambda t: F.concat(F.lit("\n- Tag: [["), t, F.lit("]]"))), ""))
                   ).otherwise(F.lit(""))
    content = F.concat(F.lit("---\n"), fm, F.lit("\n---\n\n# "), escape_headings(F.col("essence_text")),
                       F.lit("\n\n## Summary\n"), escape_headings(F.col("summary_text")),
                       F.lit("\n\n## Full Detail\n"), escape_headings(F.col("full_text")), ctx, links, F.lit("\n"))
    return mem.select("hash", vault_path().alias("path"), content.alias("content"))


def vault_export(mem: DataFrame) -> DataFrame:
    """Table -> vault: every non-secret memory as (path, content)."""
    return vault_markdown(mem.filter(F.col("sensitivity") != "secret")).select("path", "content")


def _after(text, marker: str):
    """Text after the first `marker` (NULL when absent)."""
    p = F.locate(marker, text)
    return F.when(p > 0, F.substr(text, p + F.lit(len(marker))))


def _section(rest):
    """The section that starts `rest`, up to the next heading at a line start, trimmed and unescaped."""
    cut = F.substring_index(F.concat(F.lit("\n"), rest), "\n## ", 1)
    return js_trim(unescape_headings(cut))


def _fm_value(fm, key: str):
    return _yaml_text(js_trim(F.regexp_extract(fm, f"(?m)^{key}: (.*)$", 1)))


def _tags(fm):
    """Tags as a block list or a flow list; [] without the key; NULL when written in a way this does not read."""
    block = F.regexp_extract(fm, r"(?m)^tags:[ \t]*((?:\n[ \t]*- .*)+)", 1)
    flow = F.regexp_extract(fm, r"(?m)^tags:[ \t]*(\[.*\])[ \t]*$", 1)
    items = F.regexp_extract_all(F.substr(flow, F.lit(2), F.length(flow) - 2),
                                 F.lit(r'"(?:[^"\\]|\\.)*"|\'(?:[^\']|\'\')*\'|[^,]+'), F.lit(0))
    lines = F.regexp_extract_all(block, F.lit(r"\n[ \t]*- (.*)"), F.lit(1))
    raw = F.when(block != "", lines).when(flow != "", items).when(~F.regexp_like(fm, F.lit(r"(?m)^tags:[ \t]*\S")), F.array().cast("array<string>"))
    return F.filter(F.transform(raw, lambda t: _yaml_text(js_trim(t))), lambda t: t != "")


def parse_vault(files: DataFrame) -> DataFrame:
    """Vault documents (path, content) -> partial memory rows; files without front matter or
    without a hash are dropped. Known front-matter keys only (no general YAML): defaults
    conversation / public / [] / 0, `project: none` -> NULL, ISO dates -> epoch seconds,
    essence left empty (it lives in the heading).

    Front matter is the text between a leading '---' line and the next '\n---' (at least one
    char); the body is what follows. Located with plain string search, not regex scans.
    """
    c = F.col("content")
    k = F.locate("\n---", c, 6)                       # 1-based start of the closing marker
    ok = F.startswith(c, F.lit("---\n")) & (k > 0)
    fm = F.substring(c, 5, k - 5)
    body = F.substr(c, k + 4)
    staged = files.select("path", ok.alias("_ok"), fm.alias("_fm"), body.alias("_body")).filter("_ok")
    staged = staged.withColumn("_summary", _after(F.concat(F.lit("\n"), F.col("_body")), "\n## Summary\n"))
    staged = staged.withColumn("_full", _after(F.concat(F.lit("\n"), F.coalesce("_summary", "_body")), "\n## Full Detail\n"))
    fm, body = F.col("_fm"), F.col("_body")
    # headings count at a line start only, and in their order (texts have theirs escaped)
    after_summary = F.col("_summary")
    after_full = F.col("_full")
    rest = F.coalesce(after_full, after_summary, body)
    ctx_pos = F.locate("\n## Context Log\n", F.concat(F.lit("\n"), rest))
    ctx_tail = F.substr(F.concat(F.lit("\n"), rest), ctx_pos + 1)
    ctx_raw = F.regexp_extract(ctx_tail, r"^## Context Log\n_[^_]*_\n\n([\s\S]*)", 1)
    has_ctx = (ctx_pos > 0) & F.regexp_like(ctx_tail, F.lit(r"^## Context Log\n_[^_]*_\n\n"))
    imp = _fm_value(fm, "importance")
    proj = _fm_value(fm, "project")

    def nonempty(c):
        return F.when(c != "", c)

    def epoch(key):
        ts = F.try_to_timestamp(_fm_value(fm, key), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSX"))
        return F.unix_seconds(ts)

    return staged.select(
        "path",
        _fm_value(fm, "hash").alias("hash"),
        F.when(imp != "", imp.try_cast("double")).alias("importance"),
        F.coalesce(nonempty(_fm_value(fm, "memory_type")), F.lit("conversation")).alias("memory_type"),
        F.coalesce(nonempty(_fm_value(fm, "sensitivity")), F.lit("public")).alias("sensitivity"),
        _tags(fm).alias("tags"),
        F.when((proj == "none") | (proj == ""), F.lit(None)).otherwise(proj).alias("project"),
        nonempty(_fm_value(fm, "session_id")).alias("session_id"),
        epoch("created_at").alias("created_at"),
        epoch("last_accessed").alias("last_accessed"),
        F.coalesce(_fm_value(fm, "access_count").try_cast("bigint"), F.lit(0).cast("bigint")).alias("access_count"),
        F.coalesce(_section(after_summary), F.lit("")).alias("summary_text"),
        F.coalesce(_section(after_full), F.lit("")).alias("full_text"),
        F.when(has_ctx, js_trim(unescape_headings(F.substring_index(ctx_raw, "\n## ", 1)))).alias("context_log"),
        F.lit("").alias("essence_text"),
    ).filter(F.col("hash") != "")


def vault_merge(mem: DataFrame, parsed: DataFrame) -> DataFrame:
    """Vault -> table: update rows whose hash exists. Non-empty summary / full text, a
    present context log and importance are taken; tags are taken unless unreadable (NULL). For duplicate
    hashes the last file in path order wins. Returns the updated rows."""
    last = (parsed.groupBy("hash")
            .agg(F.max_by(F.struct("importance", "tags", "summary_text", "full_text", "context_log"),
                          F.col("path")).alias("v"))
            .select("hash", "v.*"))
    v = last.select("hash", *[F.col(c).alias(f"v_{c}") for c in last.columns if c != "hash"])
    j = mem.join(v, "hash")
    return j.select(*[
        F.when(F.length("v_summary_text") > 0, F.col("v_summary_text")).otherwise(F.col("summary_text")).alias(c)
        if c == "summary_text" else
        F.when(F.length("v_full_text") > 0, F.col("v_full_text")).otherwise(F.col("full_text")).alias(c)
        if c == "full_text" else
        F.coalesce("v_context_log", "context_log").alias(c) if c == "context_log" else
        F.coalesce("v_tags", "tags").alias(c) if c == "tags" else
        F.coalesce("v_importance", "importance").alias(c) if c == "importance" else
        F.col(c) for c in mem.columns])


def vault_orphans(vault_files: DataFrame, live: DataFrame) -> DataFrame:
    """Vault files whose 7-char id no longer names a live memory (to delete)."""
    f = vault_files.select("path", F.regexp_extract("path", r"_([0-9a-f]{7})_", 1).alias("h7"))
    return f.join(live.select(short_id("hash").alias("h7")), "h7", "left_anti").select("path")


# ------------------------------------------------------------------ embedding usage


def embed_usage(calls: DataFrame) -> DataFrame:
    """Counters of remote embedding calls and local fallbacks (each fallback counted once)."""
    remote = F.col("kind") == "remote"
    return calls.agg(
        F.count_if(remote).alias("remote_calls"),
        F.coalesce(F.sum(F.when(remote, F.col("chars"))), F.lit(0)).cast("bigint").alias("remote_chars"),
        F.count_if(F.col("kind") == "fallback").alias("fallback_calls"),
        F.max(F.when(remote, F.col("ts"))).alias("_last"),
    ).select("remote_calls", "remote_chars", token_estimate("remote_chars").alias("tokens_est"), "fallback_calls",
             F.date_format("_last", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("last_call_at"))
