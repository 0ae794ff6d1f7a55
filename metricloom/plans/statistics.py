"""Queries over groups of any size: the published random stream, exact quantiles, bootstraps and user-defined aggregates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from metricloom.operators import stats, streams
from metricloom.operators.aggregates import Mean, Range, TrimmedMean, aggregate
from metricloom.operators.ordering import checkpointed, dense_id
from metricloom.operators.quantiles import exact_quantiles
from metricloom.operators.resampling import poisson_bootstrap, weights_sql
from metricloom.plans.catalogue import LOO, PAIRS, RUNS, query, r6
from metricloom.sources.tables import pairs, runs, table

#: The published seed of all bootstraps (a fixed value).
SEED = 20260925
MEANS = 20_000
DRAWS = 2000


@query(f"""WITH RECURSIVE {PAIRS}, loo AS ({LOO.format(t="pairs").replace("round(", "").replace(", 4)", "")}), e AS (SELECT row_number() OVER (ORDER BY k) - 1 AS r, abs(loo - y) AS e FROM pairs JOIN loo USING (k)),
 {streams.draws_sql(SEED, 25, 25 * MEANS + 64)}, means AS (SELECT pos // 25 AS draw, avg(e) AS m FROM picks JOIN e ON pick = r WHERE pos < {25 * MEANS} GROUP BY 1)
 SELECT count(*) AS draws, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM means""")
def stream_interval(spark, d):
    """The middle 95 % of the mean leave-one-out error of the nations' pairs over 20,000 draws of the published stream.

    The stream is drawn below the number of pairs, 25 nations; its SQL is
    written for that number.
    """
    p = stats.leave_one_out(pairs(spark, d), "y", "x").select("k", F.abs(F.col("loo") - F.col("y")).alias("e"))
    rows = dense_id(p, "k", name="row")
    means = checkpointed(stats.stream_means(rows, "row", "e", SEED, MEANS))
    q = exact_quantiles(means, "m", [0.025, 0.975])
    return q.select(F.col("n").alias("draws"), *[F.round(F.col("q")[i], 6).alias(k) for i, k in enumerate(("lo", "hi"))])


@query(f"""WITH RECURSIVE {RUNS}, cells AS (SELECT split, method_id, train_size, mae, dense_rank() OVER (ORDER BY split, method_id) - 1 AS c, dense_rank() OVER (ORDER BY train_size) - 1 AS s, dense_rank() OVER (ORDER BY seed) - 1 AS i FROM runs),
 {streams.draws_sql(SEED, 5, 10 * DRAWS * 35 + 256)}
 SELECT split, method_id, CAST(pos % {35 * DRAWS} // 35 AS INTEGER) AS draw, train_size - 1994 AS n, round(avg(mae), 6) AS y FROM picks JOIN cells ON c = pos // {35 * DRAWS} AND s = pos % 35 // 5 AND i = pick WHERE pos < {10 * DRAWS * 35} GROUP BY 1, 2, 3, 4""")
def stream_curves(spark, d):
    """For each curve 2,000 draws of five seeds at each of seven sizes, averaged: one stream over curves, draws, sizes and seeds, in this order."""
    cells = runs(spark, d).select("split", "method_id", "train_size", "seed", "mae")
    rank = lambda *c: F.dense_rank().over(Window.orderBy(*c)) - 1
    # a cell for each curve, size and seed: a few hundred
    cells = cells.withColumns({"c": rank("split", "method_id"), "s": rank("train_size"), "i": rank("seed")})
    picks = streams.draws(spark, SEED, 5, 10 * DRAWS * 35)
    at = picks.select("pick", F.expr(f"pos div {35 * DRAWS}").alias("c"), F.expr(f"pos % {35 * DRAWS} div 35").cast("int").alias("draw"), F.expr("pos % 35 div 5").alias("s"))
    y = at.join(cells, (at["c"] == cells["c"]) & (at["s"] == cells["s"]) & (at["pick"] == cells["i"])).groupBy("split", "method_id", "draw", "train_size").agg(F.avg("mae").alias("y"))
    return y.select("split", "method_id", "draw", (F.col("train_size") - 1994).alias("n"), *r6("y"))


@query("SELECT l_returnflag, count(l_extendedprice) AS n, round(quantile_cont(l_extendedprice, 0.025), 6) AS low, round(median(l_extendedprice), 6) AS med, round(quantile_cont(l_extendedprice, 0.975), 6) AS high FROM lineitem GROUP BY 1")
def price_quantiles(spark, d):
    """Exact quantiles of three groups that hold all line items."""
    q = exact_quantiles(table(spark, d, "lineitem"), "l_extendedprice", [0.025, 0.5, 0.975], "l_returnflag")
    return q.select("l_returnflag", "n", *[F.round(F.col("q")[i], 6).alias(k) for i, k in enumerate(("low", "med", "high"))])


@query(f"""WITH e AS (SELECT l_returnflag, l_orderkey, sum(abs(l_discount - l_tax)) AS s, count(*) AS c FROM lineitem GROUP BY 1, 2), {weights_sql("e", "l_orderkey", DRAWS)},
 m AS (SELECT l_returnflag, draw, sum(w * c) AS weight, sum(w * s) / sum(w * c) AS mean FROM weighted GROUP BY 1, 2)
 SELECT l_returnflag, count(mean) AS draws, CAST(sum(weight) AS BIGINT) AS weight, round(quantile_cont(mean, 0.025), 6) AS lo, round(quantile_cont(mean, 0.975), 6) AS hi FROM m GROUP BY 1""")
def cluster_bootstrap(spark, d):
    """The middle 95 % of a mean error over all line items in 2,000 draws, orders drawn as a whole."""
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_orderkey", F.abs(F.col("l_discount") - F.col("l_tax")).alias("e"))
    means = checkpointed(poisson_bootstrap(rows, "e", "l_orderkey", "l_returnflag", draws=DRAWS))
    weight = means.groupBy("l_returnflag").agg(F.sum("weight").cast("long").alias("weight"))
    q = exact_quantiles(means, "mean", [0.025, 0.975], "l_returnflag").join(weight, "l_returnflag")
    return q.select("l_returnflag", F.col("n").alias("draws"), "weight", *[F.round(F.col("q")[i], 6).alias(k) for i, k in enumerate(("lo", "hi"))])


@query("""WITH r AS (SELECT l_linestatus, l_extendedprice AS v, row_number() OVER (PARTITION BY l_linestatus ORDER BY l_extendedprice) AS up, row_number() OVER (PARTITION BY l_linestatus ORDER BY l_extendedprice DESC) AS down FROM lineitem)
 SELECT l_linestatus, round(max(v) - min(v), 4) AS spread, round(avg(v), 4) AS mean, round(avg(v) FILTER (WHERE up > 10 AND down > 10), 4) AS trimmed FROM r GROUP BY 1""")
def user_aggregates(spark, d):
    """Three user-defined aggregates of prices; one group holds half of the rows."""
    made = {"spread": (Range(), "l_extendedprice"), "mean": (Mean(), "l_extendedprice"), "trimmed": (TrimmedMean(10), "l_extendedprice")}
    return aggregate(table(spark, d, "lineitem"), made, "l_linestatus").select("l_linestatus", *[F.round(k, 4).alias(k) for k in made])
