"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

A source with `n` rows and target share `w` of `total` output rows has the repetition rate
w * total / n. Every row draws a uniform number from a seeded hash of its id and inverts the
Poisson distribution with its source's rate: the number of copies is the number of values of the cumulative
distribution that do not exceed the draw. Rows are exploded by their count and dealt to the
partitions by a hash of (id, copy), then sorted by it: a global shuffle with one exchange.
The draw depends on nothing but the row, so a lost task repeats itself exactly.

Defined cases: a null source is a source of its own; a row without an id draws by its text (null:
empty). Rows that repeat an id and source draw alike. A source without a target weight, or with weight null or not above
zero, gives no rows. Of an empty table the result is empty. Other columns travel along; a column named `copy`
is replaced (in any case of letters), and the working columns carry a prefix no table should use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.common import materialize, register, text_of
from memlake.sources.tables import read_table

#: Seed of the draw and of the shuffle.
SEED = 17
#: Sources up to which the rates are broadcast (a row holds some hundred bytes); beyond, they are joined.
BROADCAST_SOURCES = 20_000


def source_counts(docs: DataFrame, source_col: str = "source") -> DataFrame:
    return docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))


def tempered_weights(counts: DataFrame, power: float = 0.5) -> DataFrame:
    """Target weights (source, weight): the source's size to the power `power`."""
    return counts.select("source", F.pow(F.col("n").cast("double"), F.lit(power)).alias("weight"))


def poisson_cumulative(rate: Column) -> Column:
    """[P(X <= 0), P(X <= 1), ...] up to twelve deviations above the mean, in logarithms so that
    no rate underflows."""
    steps = F.sequence(F.lit(1), F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int"))
    start = F.struct((-rate).alias("lp"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("cdf"))

    def step(acc: Column, j: Column) -> Column:
        lp = acc["lp"] + F.log(rate / j)
        total = acc["sum"] + F.exp(lp)
        return F.struct(lp.alias("lp"), total.alias("sum"),
                        F.concat(acc["cdf"], F.array(total)).alias("cdf"))
    return F.when(rate > 0, F.aggregate(steps, start, step, lambda acc: acc["cdf"]))


def rates(counts: DataFrame, weights: DataFrame, total: float | None = None) -> DataFrame:
    """(source, rate, cdf) of each source; `total` output rows are expected (default: as many as come in)."""
    w = weights.select(F.col("source").alias("w_source"), F.greatest(F.col("weight"), F.lit(0.0)).alias("weight"))
    both = counts.join(w, F.col("source").eqNullSafe(F.col("w_source")), "left").drop("w_source")
    all_weight, all_n = both.agg(F.sum("weight"), F.sum("n")).first()
    expected = float(total if total is not None else all_n or 0)
    share = F.coalesce(F.col("weight"), F.lit(0.0)) / F.lit(float(all_weight or 1.0))
    return (both.withColumn("rate", share * F.lit(expected) / F.col("n"))
            .select("source", "rate", poisson_cumulative(F.col("rate")).alias("cdf")))


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) with 52 bits from the MD5 of seed and key."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(2 ** 52))


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, total: float | None = None,
                seed: int = SEED, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source") -> DataFrame:
    """The columns of `docs` and `copy` (1 to the drawn count), in a global random order.

    `weights` has (source, weight); default: the square root of the source's size."""
    counts = materialize(source_counts(docs, source_col), "mix_counts")
    table = materialize(rates(counts, tempered_weights(counts) if weights is None else weights, total), "mix_rates")
    table = table.select(F.col("source").alias("__mix_source"), F.col("cdf").alias("__mix_cdf")).where("__mix_cdf is not null")
    if table.count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    names = [c for c in docs.columns if c.lower() != "copy"]
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.md5(text_of(text_col))))
    drawn = (docs.select(*[F.col(f"`{c}`") for c in names], key.alias("__mix_key"))
             .join(table, F.col(source_col).eqNullSafe(F.col("__mix_source")))
             .withColumn("__mix_draw", uniform(F.col("__mix_key"), seed))
             .withColumn("__mix_count", F.size(F.filter("__mix_cdf", lambda c: c <= F.col("__mix_draw"))))
             .where("__mix_count > 0"))
    copies = drawn.select(*[F.col(f"`{c}`") for c in names], "__mix_key",
                          F.explode(F.sequence(F.lit(1), F.col("__mix_count"))).alias("copy"))
    order = F.xxhash64(F.lit(seed), "__mix_key", "copy")
    return (copies.withColumn("__mix_order", order).repartition("__mix_order")
            .sortWithinPartitions("__mix_order").select(*names, F.col("copy").cast("bigint").alias("copy")))


@register("op8_poisson_mixing", f"""
WITH RECURSIVE n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, sqrt(n::DOUBLE) / sum(sqrt(n::DOUBLE)) OVER () * (sum(n) OVER ())::DOUBLE / n AS rate FROM n),
c AS (
  SELECT source, rate, 0 AS j, -rate AS lp, exp(-rate) AS cdf FROM r
  UNION ALL
  SELECT source, rate, j + 1, lp + ln(rate / (j + 1)), cdf + exp(lp + ln(rate / (j + 1))) FROM c
  WHERE j < ceil(rate + 12 * sqrt(rate) + 20)),
l AS (SELECT source, list(cdf) AS cdf FROM c GROUP BY source),
d AS (
  SELECT d.*, len(list_filter(l.cdf, lambda x: x <=
    ('0x' || substr(md5('{SEED}:' || d.doc_id::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)) AS k
  FROM documents d JOIN l ON d.source IS NOT DISTINCT FROM l.source)
SELECT doc_id, text, lang, source, n_chars, unnest(range(1, k + 1)) AS copy FROM d
""")
def op8_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed to shares that follow the square root of each source's size."""
    return mix_sources(read_table(spark, sf_dir, "documents"))
