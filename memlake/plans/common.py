"""Registry plumbing shared by the query catalogs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.plans.oracle_inputs import INPUT_VIEWS

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: register a (spark, sf_dir) -> DataFrame query and its DuckDB oracle."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return widen_ints(fn(spark, sf_dir))
        run.__doc__, run.__name__ = fn.__doc__, fn.__name__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = with_inputs(sql)
        return fn
    return deco


def widen_ints(df: DataFrame) -> DataFrame:
    """Report integer columns as bigint (the oracle's integer type)."""
    from pyspark.sql.types import ByteType, IntegerType, ShortType
    if not any(isinstance(f.dataType, (ByteType, ShortType, IntegerType)) for f in df.schema.fields):
        return df
    return df.select(*[F.col(f.name).cast("bigint").alias(f.name)
                       if isinstance(f.dataType, (ByteType, ShortType, IntegerType)) else F.col(f.name)
                       for f in df.schema.fields])


def with_inputs(body: str) -> str:
    body = body.strip()
    sep = "\n" if body[:6].upper() == "SELECT" else ",\n"
    return "WITH " + INPUT_VIEWS.strip() + sep + body


def r6(c) -> Column:
    """Doubles are compared rounded to 6 places in both engines."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def joined(c, sep: str = ",") -> Column:
    """Arrays are compared as joined text."""
    return F.array_join(F.col(c) if isinstance(c, str) else c, sep)
