"""Cleaning keyed measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def coerce(df: DataFrame, column: str) -> DataFrame:
    """Text to numbers rounded half-even to ten decimals; rows without a finite number go."""
    df = df.withColumn(column, F.expr(f"try_cast(`{column}` AS double)"))
    return df.where(finite(column)).withColumn(column, F.bround(column, 10))


def conflicts(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one distinct value."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(value).alias("n_values")).where("n_values > 1")


def drop_conflicts(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The first row by ``order`` of each key whose rows agree on the value.

    One shuffle by key: agreement and the first row are aggregates of the same
    groups, so no anti-join and no window over a hot key is needed.
    """
    rest = [c for c in df.columns if c not in (key, value, order)]
    out = df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.min(value).alias("low_"), F.max(value).alias(value), F.min(F.struct(order, *rest)).alias("row_"))
    out = out.where(F.col("low_").eqNullSafe(F.col(value)))
    return out.select(*[F.col(c) if c in (key, value) else F.col(f"row_.{c}").alias(c) for c in df.columns])
