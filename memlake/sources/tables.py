"""Parquet table readers with declared column lists (no inference at query time)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLE_COLUMNS = {
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "conversations": ["conv_id", "turn", "role", "text"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "embeddings": ["vec_id", "embedding", "label"],
    "pages": ["page_id", "url", "html"],
    "benchmark": ["item_id", "text"],
    "labels": ["doc_id", "quality", "toxic"],
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read `<sf_dir>/<name>.parquet`; Catalyst prunes columns and pushes filters to the scan."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    cols = TABLE_COLUMNS.get(name)
    return df.select(*cols) if cols else df
