"""Registered queries over real files: stand-in files are written from the tables into a
fresh folder under spark.checkpoint.dir, then read back through the file sources.

`ingest_from_files` and `vault_roundtrip` must equal `ingest_documents` and `vault_merge`
(same oracles): the file round trip may not change a single row.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.config import NOW
from memlake.operators import changes as W
from memlake.operators import documents as D
from memlake.operators import records as RC
from memlake.plans.common import ORACLE, register
from memlake.plans.record_queries import vault_files
from memlake.sources import files as FS
from memlake.sources import fixtures as FX
from memlake.sources.tables import read_table
from memlake.streaming.jobs import work_dir


def _write_document_folder(spark, sf) -> str:
    """Every document as /docs/<source>/doc_<id>.md; labelled ones also as an unsupported .pdf."""
    root = work_dir(spark, "docs")
    d = read_table(spark, sf, "documents")
    lab = read_table(spark, sf, "labels").select("doc_id")
    pdf = d.join(lab, "doc_id", "left_semi").select(
        F.concat(F.lit("/docs/"), F.col("source"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"),
        F.col("text").alias("content"))
    FS.write_text_files(FX.document_files(spark, sf).select("path", "content").unionByName(pdf), root)
    return root


@register("ingest_from_files")
def q_ingest_from_files(spark, sf):
    """S4 + V9: ingest a folder of document files (project = the folder below /docs)."""
    root = _write_document_folder(spark, sf)
    docs = FS.read_documents(spark, root)
    docs = docs.withColumn("project", F.regexp_extract("path", r"^/docs/([^/]+)/", 1))
    i = D.ingest_files(docs, NOW, size=500, separator=r"\n+")
    ws = F.aggregate("embedding_sparse", F.lit(0.0), lambda a, e: a + e["w"])
    return i.select("path", "chunk_index", "hash", "project", "summary_text", "essence_text",
                    F.array_join("tags", ",").alias("tags"), "importance", "memory_type", "session_id",
                    F.size("embedding_sparse").cast("bigint").alias("emb_nnz"), F.round(ws, 6).alias("emb_sum"))


@register("document_rejects", """
SELECT concat('/docs/', source, '/doc_', CAST(doc_id AS VARCHAR), '.pdf') AS path,
       'Unsupported file type: .pdf. Supported: .md, .txt' AS reason
FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""")
def q_document_rejects(spark, sf):
    """S4: files of unsupported types found in the document folder."""
    return FS.document_rejects(spark, _write_document_folder(spark, sf))


@register("vault_roundtrip")
def q_vault_roundtrip(spark, sf):
    """W11 + S5 + S6 + W10: write the (edited) vault as .md files, read the folder back,
    parse and merge into the live memories."""
    root = work_dir(spark, "vault")
    FS.write_text_files(vault_files(spark, sf), root + "/memories")
    files = FS.read_vault(spark, root + "/memories").withColumn("path", F.regexp_replace("path", "^/", ""))
    live = W.gc_survivors(FX.memories(spark, sf), NOW)
    merged = RC.vault_merge(live, RC.parse_vault(files))
    return merged.select("hash", "importance", "summary_text", F.length("full_text").cast("bigint").alias("full_len"),
                         F.array_join("tags", ",").alias("tags"), "context_log")


for _q, _b in (("ingest_from_files", "ingest_documents"), ("vault_roundtrip", "vault_merge")):
    if _b in ORACLE:
        ORACLE[_q] = ORACLE[_b]
