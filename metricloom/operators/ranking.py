"""Ranking methods and telling which differences are resolved."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metricloom.operators.stats import paired_test

CELL = ("split", "train_size")


def summary(runs: DataFrame) -> DataFrame:
    stats = [f(c).alias(f"{n}_{c}") for c in ("mae", "rmse", "r2") for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return runs.where("status = 'ok'").groupBy("split", "train_size", "method_id").agg(F.count_distinct("seed").alias("n_seeds"), *stats)


def ranked(summ: DataFrame) -> DataFrame:
    """Adds the rank by mean error within a cell; a cell holds one row for each method."""
    return summ.withColumn("rnk", F.row_number().over(Window.partitionBy(*CELL).orderBy("mean_mae", "method_id")))


def seed_pairs(runs: DataFrame) -> DataFrame:
    """(cell, m1, m2, seed, d): differences of each unordered pair of methods, by seed.

    Methods of a (cell, seed) come together once, as a sorted array; pairs are
    taken from it, so the fact table is shuffled once and never self-joined.
    """
    cells = runs.groupBy(*CELL, "seed").agg(F.sort_array(F.collect_list(F.struct("method_id", "mae"))).alias("xs"))
    a = cells.select(*CELL, "seed", "xs", F.posexplode("xs").alias("i", "x"))
    b = a.select(*CELL, "seed", "x", F.explode(F.expr("slice(xs, i + 2, size(xs))")).alias("y"))
    return b.select(*CELL, "seed", F.col("x.method_id").alias("m1"), F.col("y.method_id").alias("m2"), (F.col("x.mae") - F.col("y.mae")).alias("d"))


def adjacent(rank: DataFrame) -> DataFrame:
    w = Window.partitionBy(*CELL).orderBy("rnk")
    nxt = rank.withColumns({"worse": F.lead("method_id").over(w), "worse_mae": F.lead("mean_mae").over(w)}).where("worse IS NOT NULL")
    return nxt.withColumn("rank_pair", F.format_string("%d-%d", "rnk", F.col("rnk") + 1)).withColumnRenamed("method_id", "better")


def resolved_pairs(tests: DataFrame, level: float = 0.05) -> DataFrame:
    """Both orders of each tested pair, resolved if significant and all seeds agree."""
    t = tests.withColumn("resolved", F.coalesce((F.col("p") < level) & F.col("agree"), F.lit(False)))
    names = [c for c in t.columns if c not in ("m1", "m2")]
    return t.unionByName(t.select(F.col("m2").alias("m1"), F.col("m1").alias("m2"), *names))


def top_groups(rank: DataFrame, resolved: DataFrame) -> DataFrame:
    """The best method of each cell with all that are not resolved from it."""
    best = rank.where("rnk = 1").select(*CELL, F.col("method_id").alias("m1"), F.col("mean_mae").alias("best_mae"))
    tied = best.join(resolved.where("NOT resolved"), [*CELL, "m1"], "left").join(rank.select(*CELL, F.col("method_id").alias("m2"), "rnk"), [*CELL, "m2"], "left")
    out = tied.groupBy(*CELL, "m1", "best_mae").agg(F.sort_array(F.collect_list(F.struct("rnk", "m2"))).alias("t"))
    return out.select(*CELL, F.col("m1").alias("rank1"), "best_mae", F.concat(F.array("m1"), F.expr("transform(filter(t, x -> x.m2 IS NOT NULL), x -> x.m2)")).alias("top_group"))


def standings(runs: DataFrame) -> DataFrame:
    """(cell, method_id, mean_mae, rnk, by_seed): the methods of each cell by rank, each with its (seed, mae) pairs.

    Runs are dealt by cell once; means, ranks and what is told of pairs of
    methods below need no further shuffle.
    """
    dealt = runs.where("status = 'ok'").repartition(*CELL)
    rows = dealt.groupBy(*CELL, "method_id").agg(F.avg("mae").alias("mean_mae"), F.collect_list(F.struct("seed", "mae")).alias("by_seed"))
    return ranked(rows)


def _tested(rows: DataFrame, *keep: str) -> DataFrame:
    """The paired test of method x against y, arrays (seed, mae), over the seeds that both have; columns of ``keep`` name a row."""
    seeds = F.map_from_entries("y")
    pairs = rows.withColumn("x", F.explode_outer("x")).withColumn("d", F.col("x.mae") - seeds[F.col("x.seed")])
    out = pairs.groupBy(*CELL, *keep).agg(*paired_test("d"))
    return out.withColumn("resolved", F.coalesce((F.col("p") < 0.05) & F.col("agree"), F.lit(False)))


def adjacent_tests(table: DataFrame) -> DataFrame:
    """(cell, rank_pair, better, worse, mean_diff, p, agree, resolved) of neighbouring ranks of ``standings``."""
    w = Window.partitionBy(*CELL).orderBy("rnk")
    nxt = table.select(*CELL, "rnk", F.col("method_id").alias("better"), F.lead("method_id").over(w).alias("worse"), F.col("by_seed").alias("x"), F.lead("by_seed").over(w).alias("y")).where("worse IS NOT NULL")
    out = _tested(nxt, "rnk", "better", "worse").where("mean_diff IS NOT NULL")
    return out.withColumn("rank_pair", F.format_string("%d-%d", "rnk", F.col("rnk") + 1)).drop("rnk")


def top_of(table: DataFrame) -> DataFrame:
    """(cell, rank1, best_mae, top_group): the best method of each cell of ``standings`` with all that are not resolved from it, by rank.

    A method without a seed in common with the best is not tested, and not in
    the group.
    """
    w = Window.partitionBy(*CELL).orderBy("rnk").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best = F.first(F.struct("method_id", "mean_mae", "by_seed")).over(w)
    rows = table.select(*CELL, "rnk", "method_id", F.col("by_seed").alias("x"), best.alias("b")).select(*CELL, "rnk", "method_id", "x", F.col("b.method_id").alias("rank1"), F.col("b.mean_mae").alias("best_mae"), F.col("b.by_seed").alias("y"))
    tests = _tested(rows, "rnk", "method_id", "rank1", "best_mae")
    tied = (F.col("rnk") == 1) | (~F.col("resolved") & F.col("mean_diff").isNotNull())
    out = tests.groupBy(*CELL, "rank1", "best_mae").agg(F.sort_array(F.collect_list(F.when(tied, F.struct("rnk", "method_id")))).alias("t"))
    return out.select(*CELL, "rank1", "best_mae", F.transform("t", lambda x: x["method_id"]).alias("top_group"))
