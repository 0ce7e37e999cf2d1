"""Document chunking and ingestion.

Chunking is a left fold over a document's paragraphs with state (chunks so far, current
buffer), expressed with `aggregate` so it runs inside one projection per document: no
Python, no shuffle. The fold copies the chunk array when it appends, which is quadratic in
the number of chunks of one document; that stays small for the document sizes this engine
targets (a 128k-char document split at 500 chars gives ~260 chunks).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.config import (CHUNK_SEPARATOR, CHUNK_SIZE, ESSENCE_CHARS, INGEST_IMPORTANCE,
                            SUMMARY_CHARS)
from memlake.functions.embed import with_embedding
from memlake.functions.text import content_id, js_trim, short_id, token_estimate


def chunk_array(text: str, size: int = CHUNK_SIZE, separator: str = CHUNK_SEPARATOR):
    """array<string> of chunks of column `text`.

    Short text (length <= size) is returned whole and untrimmed. Otherwise paragraphs are
    appended to a buffer joined by a blank line; before a paragraph that would push the
    buffer past `size` (counting the 2-char joiner) a non-empty buffer is flushed trimmed.
    A paragraph longer than `size` is not split. Empty chunks (a whitespace-only buffer)
    are dropped.
    """
    t = F.col(text)
    paras = F.split(t, separator)
    init = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))

    def step(acc, p):
        flush = (F.length(acc["cur"]) + F.length(p) + 2 > size) & (F.length(acc["cur"]) > 0)
        out = F.when(flush, F.array_append(acc["out"], js_trim(acc["cur"]))).otherwise(acc["out"])
        cur0 = F.when(flush, F.lit("")).otherwise(acc["cur"])
        cur = F.concat(cur0, F.when(cur0 != "", F.lit("\n\n")).otherwise(F.lit("")), p)
        return F.struct(out.alias("out"), cur.alias("cur"))

    def finish(acc):
        last = js_trim(acc["cur"])
        return F.when(last != "", F.array_append(acc["out"], last)).otherwise(acc["out"])

    folded = F.aggregate(paras, init, step, finish)
    chunks = F.when(F.length(t) <= size, F.array(t)).otherwise(folded)
    return F.filter(chunks, lambda c: c != "")


def chunk_documents(docs: DataFrame, text: str = "text", size: int = CHUNK_SIZE,
                    separator: str = CHUNK_SEPARATOR, keep=("doc_id",)) -> DataFrame:
    """One row per chunk: kept columns, chunk_index (0-based), n_chunks, chunk.

    The chunk array is bound once (transform over a one-element array) so the optimizer
    cannot inline the fold into both the count and the explode."""
    bound = F.element_at(F.transform(F.array(chunk_array(text, size, separator)),
                                     lambda cs: F.transform(cs, lambda c, i: F.struct(
                                         i.alias("chunk_index"), F.size(cs).alias("n_chunks"), c.alias("chunk")))), 1)
    return docs.select(*keep, F.inline(bound)).select(*keep, "n_chunks", "chunk_index", "chunk")


def file_name(path: str = "path"):
    return F.regexp_extract(F.col(path), r"([^/\\]+)$", 1)


def chunk_summary(chunk: str = "chunk"):
    """First 150 chars, newlines to spaces, trimmed, '...' when the chunk is longer."""
    c = F.col(chunk)
    return F.concat(js_trim(F.replace(F.substring(c, 1, SUMMARY_CHARS), F.lit("\n"), F.lit(" "))),
                    F.when(F.length(c) > SUMMARY_CHARS, F.lit("...")).otherwise(F.lit("")))


def chunk_essence(chunk: str = "chunk", name: str = "file_name", index: str = "chunk_index",
                  total: str = "n_chunks"):
    """'[<file>:<i+1>/<n>] ' followed by the first 50 chars, newlines to spaces."""
    return F.concat(F.lit("["), F.col(name), F.lit(":"), (F.col(index) + 1).cast("string"), F.lit("/"),
                    F.col(total).cast("string"), F.lit("] "),
                    F.replace(F.substring(F.col(chunk), 1, ESSENCE_CHARS), F.lit("\n"), F.lit(" ")))


def ingest_files(files: DataFrame, now: int, size: int = CHUNK_SIZE, separator: str = CHUNK_SEPARATOR,
                 embed: bool = True) -> DataFrame:
    """Ingest request for many files `(path, project, content)`: chunk, id, summarise, embed.

    Returns memory rows (plus path, chunk_index, n_chunks, total_chars); with `embed`, the
    local embedding of each chunk as `embedding` (dense float) and `embedding_sparse`.
    """
    ch = chunk_documents(files.withColumn("total_chars", F.length("content")), "content", size,
                         separator, keep=("path", "project", "total_chars"))
    ch = ch.withColumn("file_name", file_name("path"))
    out = ch.select(
        "path", "chunk_index", "n_chunks", "total_chars",
        content_id(F.col("path"), ":chunk", F.col("chunk_index").cast("string"), ":", str(now)).alias("hash"),
        F.lit(now).cast("bigint").alias("created_at"),
        F.lit(now).cast("bigint").alias("last_accessed"),
        F.lit(0).cast("bigint").alias("access_count"),
        F.lit(INGEST_IMPORTANCE).alias("importance"),
        F.lit(False).alias("explicit_save"),
        F.col("chunk").alias("full_text"),
        chunk_summary("chunk").alias("summary_text"),
        chunk_essence("chunk").alias("essence_text"),
        F.lit(None).cast("string").alias("context_log"),
        F.array(F.lit("document"), F.lit("rag"), F.col("file_name")).alias("tags"),
        F.lit("knowledge").alias("memory_type"),
        F.lit("public").alias("sensitivity"),
        F.col("project"),
        F.lit(f"ingest_{now}").alias("session_id"),
        F.lit("default").alias("owner_id"),
    )
    if embed:
        out = with_embedding(out, "full_text", out="embedding", as_float=True)
    return out


def ingest_summary(files: DataFrame, now: int, size: int = CHUNK_SIZE, separator: str = CHUNK_SEPARATOR) -> DataFrame:
    """Per file `(path, content)`: chunk count, original length, token estimate, short chunk ids in order. All from
    the file's own row, so nothing is shuffled; files without a chunk give no row."""
    n = files.select("path", F.length("content").alias("total_chars"), F.size(chunk_array("content", size, separator)).alias("chunks"))
    ids = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda i: short_id(
        content_id(F.col("path"), ":chunk", i.cast("string"), ":", str(now))))
    return n.filter(F.col("chunks") > 0).select(
        "path", "chunks", F.col("total_chars").cast("bigint").alias("total_chars"),
        token_estimate("total_chars").alias("token_estimate"), F.array_join(ids, ",").alias("chunk_hashes"))
