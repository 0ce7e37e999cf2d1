"""The corpus pipeline: documents to packed rows of token ids.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame that is written as
Parquet and read again as the next stage's `docs`. All but the last return the columns of `docs`.

Defined cases: the stages share those of their operators. Of each class of near-duplicates exactly one row stays, also where
ids are null or repeat: rows are told by id and text, rows with an id stay before rows without. For leaks a document is
told by its id and text. Empty tables give empty results.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.common import materialize
from memlake.llm.decontaminate import find_leaks
from memlake.llm.mixing import mix_sources
from memlake.llm.packing import pack_documents
from memlake.llm.quality import grades_from_labels, score_documents, train
from memlake.llm.simhash import MAX_BITS, SHINGLE_WORDS, near_duplicates
from memlake.session import prepare_session
from memlake.sources.tables import read_table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the best grade suffices."""
    model = train(docs, grades_from_labels(read_table(spark, sf_dir, "labels")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    scored = score_documents(rows, model, text_col="row.text", keep=["row"])
    return scored.where("kept").select("row.*")


def row_key(doc_id: Column, text: Column) -> Column:
    """A key by id and text that sorts by id, rows without id last; bytewise equal keys are rows of equal id and text."""
    number = F.lpad((doc_id.cast("decimal(20,0)") + F.lit(str(2 ** 63)).cast("decimal(20,0)")).cast("string"), 20, "0")
    return F.concat(F.coalesce(number, F.lit("~")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates one row: the one with the smallest id, of equal ids that with the smallest text digest,
    of rows with equal id and text that with the smallest digest of all columns."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    keyed = rows.select(row_key(F.col("row.doc_id"), F.col("row.text")).alias("key"), "row")
    classes = near_duplicates(keyed, id_col="key", text_col="row.text", shingle=SHINGLE_WORDS, max_bits=MAX_BITS)
    # marked: keys that go, and keys of several rows of which one stays; all others stay as they are
    marks = materialize(classes.groupBy(F.col("doc_id").alias("marked")).agg(
        (F.first("component_id") != F.col("doc_id")).alias("gone"), F.count("*").alias("n")).where("gone or n > 1"), "pipeline_marks")
    single = keyed.join(marks, F.col("key") == F.col("marked"), "left_anti").select("row")
    several = (keyed.join(marks.where("not gone"), F.col("key") == F.col("marked"))
               .groupBy("key").agg(F.min_by("row", F.sha2(F.to_json("row"), 256)).alias("row")).select("row"))
    return single.unionByName(several).select("row.*")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit(""))))
    keyed = docs.withColumn("__leak_key", key)
    leaks = find_leaks(keyed, read_table(spark, sf_dir, "benchmark"), id_col="__leak_key")
    gone = materialize(leaks.select(F.col("doc_id").alias("__leaked")).distinct(), "pipeline_leaks")
    return keyed.join(gone, F.col("__leak_key") == F.col("__leaked"), "left_anti").drop("__leak_key")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated (or left out) so that sources meet their target shares."""
    return mix_sources(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of token ids."""
    return pack_documents(docs)


def _ready(stage):
    """The stage on a session whose executors have the package."""
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        prepare_session(spark)
        return stage(spark, docs, sf_dir)
    return run_stage


STAGES = [("quality classifier", _ready(keep_good)), ("SimHash near-dedup", _ready(drop_near_duplicates)),
          ("benchmark decontamination", _ready(drop_leaks)), ("mixing sources", _ready(mix)), ("token packing", _ready(pack))]

#: SQL can express neither the classifier nor the tokeniser; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline_" + name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
