"""Label quality: error metrics, recalibration, leave-one-out, paired tests, bootstrap."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.operators import streams


def error_metrics(truth: Column, pred: Column) -> list[Column]:
    e = pred - truth
    return [F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("mean_signed")]


def line_fit(y: str, x: str) -> list[Column]:
    return [F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept")]


def leave_one_out(df: DataFrame, y: str, x: str) -> DataFrame:
    """Adds loo: what the line through all other rows predicts, from residual and leverage in one aggregate.

    Null where the other rows give no line: fewer than two of them, or all of
    one x.
    """
    s = df.agg(F.count(F.lit(1)).alias("n_"), F.avg(x).alias("mx_"), F.regr_sxx(y, x).alias("sxx_"), *[c.alias(a) for c, a in zip(line_fit(y, x), ("b_", "a_"), strict=True)])
    out = df.crossJoin(F.broadcast(s))  # one row
    residual = F.col(y) - (F.col("a_") + F.col("b_") * F.col(x))
    left = 1 - F.try_divide(F.lit(1.0), "n_") - F.try_divide(F.pow(F.col(x) - F.col("mx_"), 2), F.col("sxx_"))
    return out.withColumn("loo", F.when(left > 1e-12, F.col(y) - F.try_divide(residual, left))).drop("n_", "mx_", "sxx_", "a_", "b_")


def two_sided_p(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t for whole degrees of freedom, by the finite series in the angle atan(t / sqrt(df))."""
    angle = F.atan(F.abs(t) / F.sqrt(df))
    sine, cosine, odd = F.sin(angle), F.cos(angle), df % 2
    # terms from cos ** odd on; each is the one before times cos ** 2 and a ratio of neighbouring whole numbers
    first = F.struct(F.when(odd == 1, cosine).otherwise(1.0).alias("term"), F.lit(0.0).alias("sum"))

    def add(s: Column, k: Column) -> Column:
        nxt = s["term"] * cosine * cosine * (2 * k - 1 + odd) / (2 * k + odd)
        return F.struct(nxt.alias("term"), (s["sum"] + s["term"]).alias("sum"))

    terms = F.floor((df - odd) / 2).cast("int")
    series = sine * F.aggregate(F.slice(F.sequence(F.lit(0), terms), 2, terms), first, add)["sum"]
    return F.when(df >= 1, F.greatest(1 - F.when(odd == 1, (angle + series) * 2 / np.pi).otherwise(series), F.lit(0.0)))


def paired_test(d: str) -> list[Column]:
    """Mean, all-same-sign and two-sided p of a paired t-test over n differences (n - 1 degrees of freedom; null for one)."""
    m, sd, n = F.avg(d), F.stddev_samp(d), F.count(d)
    t = F.try_divide(m, sd / F.sqrt(n))
    p = F.when(sd == 0, F.when(m != 0, 0.0)).otherwise(two_sided_p(t, n - 1))
    return [m.alias("mean_diff"), p.alias("p"), (F.bool_and(F.col(d) > 0) | F.bool_and(F.col(d) < 0)).alias("agree")]


def hash_draws(df: DataFrame, draws: int) -> DataFrame:
    """(draw, slot, pick): for each draw as many picks of a row number as df has rows, with replacement, by md5."""
    n = df.count()
    grid = df.sparkSession.range(draws * n).select(F.expr(f"id div {max(n, 1)}").alias("draw"), (F.col("id") % max(n, 1)).alias("slot"))
    pick = F.conv(F.substring(F.md5(F.concat_ws("|", "draw", "slot")), 1, 8), 16, 10).cast("long") % max(n, 1)
    return grid.withColumn("pick", pick)


def stream_means(df: DataFrame, row: str, value: str, seed: int, means: int) -> DataFrame:
    """(draw, m): the mean of as many picks as df has rows, with replacement, from the serial stream of a seed.

    Rows are numbered from 0 by ``row``.  An empty table has no draws; null
    values do not count, and a draw of nothing else has a null mean.
    """
    n = df.count()
    if not n:
        return df.select(F.lit(0).cast("long").alias("draw"), F.col(value).cast("double").alias("m")).limit(0)
    picks = streams.draws(df.sparkSession, seed, n, n * means)
    rows = df.select(F.col(row).alias("row_"), F.col(value).alias("value_"))
    return picks.join(rows, F.col("pick") == F.col("row_")).groupBy(F.expr(f"pos div {n}").alias("draw")).agg(F.avg("value_").alias("m"))
