"""Exact quantiles of groups of any size, by narrowing brackets.

``percentile`` keeps all distinct values of a group in one task.  Here

1. a mergeable sketch gives for each group a bracket around each wanted rank,
   some four times the sketch's error wide;
2. one more pass counts the rows below a bracket and keeps the distinct
   values inside it with their counts, both combined before the shuffle: for
   a sketch of error 1 / 10,000, about one row in 2,500 is kept;
3. while a bracket still holds more than ``limit`` distinct values, further
   sketches of what it holds narrow it;
4. running counts over the rest name the values of the two ranks beside the
   quantile, and it is interpolated between them.

The counts say whether a bracket holds its ranks; where it does not, the
bracket is widened to all values, so an unlucky sketch costs time only.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.operators.ordering import checkpointed

#: Splits of a bracket in one round of narrowing.
SPLITS = 64
#: Brackets that are broadcast; beyond that rows are dealt by their keys.
FEW = 100_000


def _keyed(rows: DataFrame, few: DataFrame, keys: list[str], join: str) -> DataFrame:
    """rows with the columns of the rows of ``few`` for their keys, by a hash of few: rows are many, so they are never sorted."""
    other = few.withColumnsRenamed({k: f"{k}_of" for k in keys})
    on = functools.reduce(lambda x, y: x & y, [rows[k].eqNullSafe(other[f"{k}_of"]) for k in keys], F.lit(True))
    return (rows.join(other.hint(join), on) if keys else rows.crossJoin(F.broadcast(other))).drop(*[f"{k}_of" for k in keys])  # without keys, one row for each quantile


def _held(rows: DataFrame, brackets: DataFrame, keys: list[str], join: str) -> DataFrame:
    """(keys, j_, rank_, v_, c_): counts of the distinct values inside a bracket, and of all rows below it, where v_ is null."""
    inside = _keyed(rows, brackets, keys, join).where("v_ <= high_")
    return inside.groupBy(*keys, "j_", "rank_", F.when(F.col("v_") >= F.col("low_"), F.col("v_")).alias("v_")).agg(F.sum("c_").alias("c_"))


def _narrowed(held: DataFrame, keys: list[str], limit: int, accuracy: int, join: str) -> DataFrame:
    """held with brackets of more than ``limit`` distinct values cut to the split that holds both ranks."""
    group = [*keys, "j_"]
    while True:
        size = held.groupBy(*group).agg(F.count("v_").alias("n_"))
        wide = size.where(F.col("n_") > limit).select(*group)
        if wide.isEmpty():
            return held
        rows = _keyed(held, wide, group, join)
        shares = [(i + 1) / SPLITS for i in range(SPLITS - 1)]
        cuts = rows.groupBy(*group).agg(F.percentile_approx("v_", shares, accuracy).alias("cuts_"))
        # the split of a value is the number of cuts at or below it; what lies below the bracket comes first
        split = F.when(F.col("v_").isNull(), -1).otherwise(F.size(F.filter("cuts_", lambda x: x <= F.col("v_"))))
        rows = checkpointed(_keyed(rows, cuts, group, join).withColumn("s_", split).drop("cuts_"))
        w = Window.partitionBy(*group).orderBy("s_")
        before = rows.groupBy(*group, "rank_", "s_").agg(F.sum("c_").alias("n_")).withColumn("upto_", F.sum("n_").over(w))
        # the splits of the rank and of the next one, and all between them
        ends = before.groupBy(*group).agg(F.min(F.when(F.col("upto_") > F.col("rank_"), F.col("s_"))).alias("from_"), F.coalesce(F.min(F.when(F.col("upto_") > F.col("rank_") + 1, F.col("s_"))), F.max("s_")).alias("to_"))
        cut = _keyed(rows, ends, group, join).where("s_ <= to_").groupBy(*group, "rank_", F.when(F.col("s_") >= F.col("from_"), F.col("v_")).alias("v_")).agg(F.sum("c_").alias("c_"))
        rest = held.join(wide.withColumnsRenamed({k: f"{k}_of" for k in group}), functools.reduce(lambda x, y: x & y, [held[k].eqNullSafe(F.col(f"{k}_of")) for k in group]), "left_anti")
        held = checkpointed(rest.unionByName(cut))


def exact_quantiles(df: DataFrame, value: str | Column, probs: list[float], *keys: str, accuracy: int = 10_000, limit: int = 1_000_000) -> DataFrame:
    """(keys, n, q): the number of values of each group and its quantiles, in the order of ``probs``, linear between two ranks.

    Nulls and NaN are left out; a group without values has n = 0 and a null
    q.  Null keys are a group.  Without keys there is one row, also for an
    empty table.  A bracket has at most ``limit`` distinct values where it is
    put in order by one task.
    """
    keys = list(keys)
    c = F.col(value) if isinstance(value, str) else value
    rows = df.select(*keys, F.when(~F.isnan(c), c.cast("double")).alias("v_"))
    shares = sorted({min(max(p + e / accuracy, 0.0), 1.0) for p in probs for e in (-2, 2)})
    whole = rows.groupBy(*keys).agg(F.count("v_").alias("n_"), F.min("v_").alias("min_"), F.max("v_").alias("max_"), F.percentile_approx("v_", shares, accuracy).alias("at_"))
    whole = checkpointed(whole)
    # a checkpoint has no size of its own, so Spark would deal all rows by their keys and sort them
    join = "broadcast" if whole.count() * len(probs) <= FEW else "shuffle_hash"

    def bracket(j: int, p: float) -> Column:
        low, high = (shares.index(min(max(p + e / accuracy, 0.0), 1.0)) for e in (-2, 2))
        edge = lambda i, end: F.when(F.lit(shares[i] in (0.0, 1.0)), F.col(end)).otherwise(F.col("at_")[i])
        place = F.lit(float(p)) * (F.col("n_") - 1)
        return F.struct(F.lit(j).alias("j_"), F.floor(place).cast("long").alias("rank_"), edge(low, "min_").alias("low_"), edge(high, "max_").alias("high_"))

    brackets = whole.where("n_ > 0").select(*keys, F.explode(F.array(*[bracket(j, p) for j, p in enumerate(probs)])).alias("b")).select(*keys, "b.*")
    counted = rows.where("v_ IS NOT NULL").withColumn("c_", F.lit(1).cast("long"))
    held = checkpointed(_held(counted, brackets, keys, join))
    # a bracket holds a rank and the next one, or it is taken anew over all values
    n = whole.select(*keys, "n_", "min_", "max_")
    sums = held.groupBy(*keys, "j_", "rank_").agg(F.coalesce(F.sum(F.when(F.col("v_").isNull(), F.col("c_"))), F.lit(0)).alias("below_"), F.sum("c_").alias("upto_"))
    missed = _keyed(sums, n, keys, join).where("below_ > rank_ OR upto_ < least(rank_ + 2, n_)").select(*keys, "j_", "rank_", F.col("min_").alias("low_"), F.col("max_").alias("high_"))
    missed = checkpointed(missed)
    if not missed.isEmpty():
        gone = missed.select(*[F.col(k).alias(f"{k}_of") for k in [*keys, "j_"]])
        kept = held.join(gone, functools.reduce(lambda x, y: x & y, [held[k].eqNullSafe(gone[f"{k}_of"]) for k in [*keys, "j_"]]), "left_anti")
        held = checkpointed(kept.unionByName(_held(counted, missed, keys, join)))
    held = _narrowed(held, keys, limit, accuracy, join)

    w = Window.partitionBy(*keys, "j_").orderBy(F.col("v_").asc_nulls_first())
    placed = held.withColumn("upto_", F.sum("c_").over(w))
    ends = placed.groupBy(*keys, "j_", "rank_").agg(F.min(F.when(F.col("upto_") > F.col("rank_"), F.col("v_"))).alias("x_"), F.min(F.when(F.col("upto_") > F.col("rank_") + 1, F.col("v_"))).alias("y_"))
    place = F.array(*[F.lit(float(p)) for p in probs])[F.col("j_")] * (F.col("n_") - 1)
    t = place - F.col("rank_")
    # the rank itself where the quantile falls on it; else between it and the next
    between = F.when((t == 0) | F.col("y_").isNull(), F.col("x_")).otherwise(F.col("x_") + (F.col("y_") - F.col("x_")) * t)
    found = _keyed(ends, n, keys, join).groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("j_", between.alias("q_")))), lambda s: s["q_"]).alias("q"))
    found = found.withColumnsRenamed({k: f"{k}_of" for k in keys})
    on = functools.reduce(lambda x, y: x & y, [n[k].eqNullSafe(found[f"{k}_of"]) for k in keys], F.lit(True))
    return n.join(found, on, "left").select(*keys, F.col("n_").alias("n"), F.when(F.col("n_") > 0, F.col("q")).alias("q"))
