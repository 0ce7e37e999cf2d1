"""Quality classifier: ordinal cumulative-link regression on hashed text.

Ratings have GRADES ordered grades. One weight vector over hashed words and surface marks gives a
score; P(grade <= k) = sigmoid(threshold_k - score) with ordered thresholds. From it follow the
expected grade and the tail probabilities P(grade >= k), by which documents are selected.

Training uses at most MAX_RATED rated documents, those with the smallest hash of their id: a bounded
sample, whose hashed words are brought to the driver and fitted there. Scoring reads every
document's whole text in Arrow batches; the weights (2 ** HASH_BITS floats) are broadcast.

Defined cases: a null text counts as empty and is scored by its marks alone. Rows that repeat an id
are each scored alike; a document with several ratings takes its lowest grade. Ratings with a null
are left out. Without any rating nothing is known: grades are null and every document is kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.common import register, text_of
from memlake.sources.tables import read_table

#: Ordered grades: 0 abusive, 1 poor, 2 good.
GRADES = 3
#: Rated documents used for training, at most.
MAX_RATED = 10_000
#: log2 of the number of hash buckets.
HASH_BITS = 20
#: Training documents in which a bucket must occur to get a weight.
MIN_DOCS = 3
#: A document is kept if P(grade >= GRADES - 1) reaches this.
MIN_TAIL = 0.5
EPOCHS, RATE, DECAY = 300, 0.05, 1e-4
_MASK = (1 << HASH_BITS) - 1

#: Letters lower-cased, ASCII punctuation and digits to spaces; other bytes stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_UPPER, _MARK, _DIGIT = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = _DIGIT[48:58] = True
_MARK[[ord(c) for c in "!#$%&*|~^<>{}[]=+\\@_"]] = True


def _share(count: int, total: int) -> int:
    """A share in steps that double: 0 none, 1 under 1/128, ... 8 at least 1/2."""
    return 0 if count == 0 else max(1, 8 + int(np.floor(np.log2(2 * count / max(total, 1)))))


def buckets(text: str) -> np.ndarray:
    """The distinct hash buckets of a whole text: its words, and marks of its surface."""
    raw = text.encode()
    words = raw.translate(_FOLD).split()
    distinct = set(words)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, w = len(raw), len(words)
    runs = sum(map(bytes.__eq__, words, words[1:]))
    marks = [f"\x00upper{_share(int(counts[_UPPER].sum()), n)}", f"\x00mark{_share(int(counts[_MARK].sum()), n)}",
             f"\x00digit{_share(int(counts[_DIGIT].sum()), n)}", f"\x00run{_share(runs, w)}",
             f"\x00new{_share(len(distinct), w)}", f"\x00size{w.bit_length()}"]
    hashed = np.fromiter(map(zlib.crc32, distinct), np.uint32, len(distinct))
    extra = np.array([zlib.crc32(m.encode()) for m in marks], np.uint32)
    return np.unique(np.concatenate([hashed, extra]) & np.uint32(_MASK))


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


class OrdinalModel:
    """Shared weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights.astype(np.float32), thresholds

    def score(self, text: str) -> float:
        return float(self.weights[buckets(text)].sum())

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. GRADES - 1, a column each."""
        return 1.0 - _sigmoid(self.thresholds[None, :] - scores[:, None])


def _telling(flat: np.ndarray, grade: np.ndarray, grades: np.ndarray, size: int) -> np.ndarray:
    """Buckets that occur in enough documents and whose share of low grades is no chance at some cut: it
    differs by more standard errors than the largest of so many chance deviations would, sqrt(2 ln m)."""
    found = np.bincount(flat, minlength=size)
    least = np.sqrt(2 * np.log(max((found >= MIN_DOCS).sum(), 2)))
    out = np.zeros(size, bool)
    for k in range(int(grades.max())):
        p = (grades <= k).mean()
        low = np.bincount(flat[grade <= k], minlength=size)
        out |= np.abs(low - found * p) >= least * np.sqrt(np.maximum(found * p * (1 - p), 1e-9))
    return out & (found >= MIN_DOCS)


def fit(rows: list[np.ndarray], grades: np.ndarray, grades_n: int = GRADES) -> OrdinalModel:
    """Maximum penalised likelihood by Adam over all rows; the order of rows fixes the result."""
    size = 1 << HASH_BITS
    lengths = np.array([len(r) for r in rows])
    flat = np.concatenate(rows).astype(np.int64)
    common = np.flatnonzero(_telling(flat, np.repeat(grades, lengths), grades, size))
    column = np.full(size, -1)
    column[common] = np.arange(len(common))
    use = column[flat] >= 0
    owner, flat = np.repeat(np.arange(len(rows)), lengths)[use], column[flat][use]
    w = np.zeros(len(common))
    share = np.array([(grades <= k).mean() for k in range(grades_n - 1)]).clip(1e-3, 1 - 1e-3)
    cuts = np.log(share / (1 - share))
    theta = np.concatenate([cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-2))])  # first cut, log gaps
    m = v = np.zeros(len(w) + len(theta))
    n = len(rows)
    for t in range(1, EPOCHS + 1):
        s = np.bincount(owner, weights=w[flat], minlength=n)
        gaps = np.exp(theta[1:])
        cut = theta[0] + np.concatenate([[0.0], np.cumsum(gaps)])
        upper = np.concatenate([cut, [np.inf]])[grades]
        lower = np.concatenate([[-np.inf], cut])[grades]
        a = np.where(np.isinf(upper), 1.0, _sigmoid(np.where(np.isinf(upper), 0, upper) - s))
        b = np.where(np.isinf(lower), 0.0, _sigmoid(np.where(np.isinf(lower), 0, lower) - s))
        p = np.maximum(a - b, 1e-9)
        da, db = a * (1 - a) / p, b * (1 - b) / p  # derivatives of log p by upper, minus lower cut
        g_s = (da - db) / n
        g_cut = np.array([db[grades == k + 1].sum() - da[grades == k].sum() for k in range(grades_n - 1)]) / n
        g_theta = np.concatenate([[g_cut.sum()], [g_cut[j + 1:].sum() * gaps[j] for j in range(grades_n - 2)]])
        g = np.concatenate([np.bincount(flat, weights=g_s[owner], minlength=len(w)) + DECAY * w, g_theta])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = RATE * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
        w, theta = w - step[:len(w)], theta - step[len(w):]
    weights = np.zeros(size)
    weights[common] = w
    return OrdinalModel(weights, theta[0] + np.concatenate([[0.0], np.cumsum(np.exp(theta[1:]))]))


def grades_from_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from quality and toxic marks: 0 toxic, 1 poor, 2 good."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    return labels.where("quality is not null and toxic is not null").select("doc_id", grade.alias("grade"))


def train(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          max_rated: int = MAX_RATED) -> OrdinalModel | None:
    """A model from at most `max_rated` rated documents; None without any.

    Ratings of documents that are not there take no place in the sample. What reaches the driver is at most `max_rated`
    different texts, however many rows repeat a rated id."""
    ids = docs.select(F.col(id_col).alias("rated_id"))
    sample = (ratings.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))
              .select(F.col("doc_id").alias("rated_id"), "grade").join(ids, "rated_id", "left_semi")
              .orderBy(F.xxhash64("rated_id"), "rated_id").limit(max_rated))
    texts = (docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("body"))
             .join(F.broadcast(sample), F.col("id") == F.col("rated_id")))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "grade": pdf["grade"],
                                "words": [buckets(t).astype(np.uint32).tobytes() for t in pdf["body"]]})
    # copies of one text would pass for evidence: of equal words the smallest id counts
    rows = (texts.select("id", "grade", "body").mapInPandas(hashed, "id bigint, grade int, words binary")
            .groupBy("words").agg(F.min(F.struct("id", "grade")).alias("least")).select("words", "least.id", "least.grade")
            .orderBy(F.xxhash64("id"), "id", "words").limit(max_rated).collect())
    if not rows:
        return None
    rows.sort(key=lambda r: (r["id"], r["grade"], bytes(r["words"])))
    return fit([np.frombuffer(bytes(r["words"]), np.uint32) for r in rows], np.array([r["grade"] for r in rows]))


def score_documents(docs: DataFrame, model: OrdinalModel | None, id_col: str = "doc_id", text_col: str = "text",
                    keep: list[str] | None = None, min_tail: float = MIN_TAIL) -> DataFrame:
    """The id (and the columns `keep`) with expected_grade, p_at_least_1, p_at_least_2 and kept."""
    columns = [F.col(id_col)] if keep is None else [F.col(f"`{c}`") for c in keep]
    names = [f"p_at_least_{k}" for k in range(1, GRADES)]
    if model is None:
        return docs.select(*columns, *[F.lit(None).cast("double").alias(c) for c in ["expected_grade", *names]],
                           F.lit(True).alias("kept"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for texts in batches:
            yield pd.Series([m.score(t) for t in texts])
    cuts = [float(c) for c in model.thresholds]
    tails = [F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(c) - F.col("__quality"))) for c in cuts]
    scored = docs.select(*columns, score(text_of(text_col)).alias("__quality"))
    out = scored.select(*[c for c in scored.columns if c != "__quality"],
                        sum(tails[1:], tails[0]).alias("expected_grade"),
                        *[t.alias(c) for t, c in zip(tails, names, strict=True)])
    return out.withColumn("kept", F.col(names[-1]) >= min_tail)


@register("op5_ordinal_quality")
def op5_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades of all documents; documents that are probably good are kept."""
    docs = read_table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, grades_from_labels(read_table(spark, sf_dir, "labels"))))
