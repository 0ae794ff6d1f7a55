"""Learning curves a N^-b + c: fit by a grid over b, evaluate, and find where two cross."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.operators.ordering import checkpointed


def predict(n, a, b, c):
    return a * F.pow(n, -b) + c


def _best(points: DataFrame, keys: tuple[str, ...], x: str, y: str) -> DataFrame:
    """(keys, a, b, c, ssr) of the best b among those beside each point: the line in N^-b with 0 <= c <= min y and a >= 0."""
    p = points.withColumn("z", F.pow(F.col(x), -F.col("b")))
    fits = p.groupBy(*keys, "b").agg(F.regr_intercept(y, "z").alias("c0"), F.min(y).alias("low"), F.sum(F.col("z") * F.col(y)).alias("zy"), F.sum("z").alias("sz"), F.sum(F.col("z") * F.col("z")).alias("zz"), F.sum(F.col(y) * F.col(y)).alias("yy"), F.sum(y).alias("sy"), F.count(F.lit(1)).alias("m"))
    fits = fits.withColumn("c", F.least(F.greatest("c0", F.lit(0.0)), "low")).withColumn("a", F.greatest((F.col("zy") - F.col("c") * F.col("sz")) / F.col("zz"), F.lit(0.0)))
    ssr = F.expr("yy + a*a*zz + m*c*c - 2*a*zy - 2*c*sy + 2*a*c*sz")
    best = fits.withColumn("ssr", ssr).groupBy(*keys).agg(F.min_by(F.struct("a", "b", "c", "ssr"), F.struct(F.round("ssr", 12), "b")).alias("f"))
    return best.select(*keys, "f.*")


def fit_grid(points: DataFrame, *keys: str, x: str = "n", y: str = "y", steps: int = 400) -> DataFrame:
    """(keys, a, b, c, ssr): the best b of a grid on [0.01, 2], with its line; equal fits (to 12 decimals) go to the least b."""
    grid = points.sparkSession.range(steps).select((0.01 + F.col("id") * (1.99 / (steps - 1))).alias("b"))
    return _best(points.crossJoin(F.broadcast(grid)), keys, x, y)  # the grid has a fixed size


def refine(fit: DataFrame, points: DataFrame, *keys: str, x: str = "n", y: str = "y", rounds: int = 6) -> DataFrame:
    """Finer grids around the best b, each a tenth as wide; every round is one aggregate."""
    width = 1.99 / 399
    for _ in range(rounds):
        near = F.transform(F.sequence(F.lit(-10), F.lit(10)), lambda i: F.least(F.greatest(F.col("b") + i * (width / 10), F.lit(0.01)), F.lit(2.0)))
        grid = fit.select(*keys, F.explode(F.array_distinct(near)).alias("b"))
        fit = _best(points.join(grid, list(keys)), keys, x, y)
        width /= 10
    return fit


def crossover(curves: DataFrame, *keys: str, low: float = 500, high: float = 10_000, points: int = 4000) -> DataFrame:
    """(keys, crossover): the last grid point before the first change of sign of curve 1 less curve 2; null without one or with null parameters."""
    x = lambda i: low * F.pow(F.lit(high / low), i / (points - 1))
    grid = curves.sparkSession.range(points - 1).select(x(F.col("id")).alias("x"), x(F.col("id") + 1).alias("next"))

    def sign(at: str):
        return F.signum(predict(F.col(at), F.col("a1"), F.col("b1"), F.col("c1")) - predict(F.col(at), F.col("a2"), F.col("b2"), F.col("c2")))

    s = curves.crossJoin(F.broadcast(grid))  # the grid has a fixed size
    return s.groupBy(*keys).agg(F.min(F.when(sign("x") != sign("next"), F.col("x"))).alias("crossover"))


def fitted(points: DataFrame, *keys: str, parts: int = 64) -> DataFrame:
    """Refined fits of many curves (keys, n, y), dealt into ``parts`` so that grids and fits of a curve stay in one task."""
    points = checkpointed(points).repartition(parts, *keys)
    return checkpointed(refine(fit_grid(points, *keys), points, *keys))


def fit_report(point: DataFrame, draws: DataFrame, observed: DataFrame, at: float) -> DataFrame:
    """A row for each (split, method_id): its curve, middle 95 % of b and c over the draws, share of draws whose c is the largest, fit and observation at ``at``.

    point and draws are fits (split, method_id, a, b, c), draws one for each
    draw; a draw without a fit does not count.  observed is (split, method_id, n, y).
    """
    keys = ["split", "method_id"]
    ok = draws.where("a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND NOT isnan(a + b + c)")
    most = ok.groupBy(*keys).agg(F.max("c").alias("top"))
    near = (F.abs(F.col("c") - F.col("top")) <= 1e-8 + 1e-5 * F.abs("top")).cast("double")
    q = lambda c: F.percentile(c, F.array(F.lit(0.025), F.lit(0.975)))
    spread = ok.join(F.broadcast(most), keys).groupBy(*keys).agg(q("b").alias("qb"), q("c").alias("qc"), F.avg(near).alias("c_at_upper_bound"))  # one row for each curve
    seen = observed.where(F.col("n") == at).select(*keys, F.col("y").alias("observed"))
    ends = [F.col(f"q{k}")[i].alias(f"{k}_{e}") for k in "bc" for i, e in enumerate(("lo", "hi"))]
    out = point.join(spread, keys, "left").join(seen, keys, "left")
    return out.select(*keys, "a", "b", "c", *ends, "c_at_upper_bound", predict(F.lit(float(at)), F.col("a"), F.col("b"), F.col("c")).alias("fit"), "observed")


def paired_fits(fits: DataFrame, pairs: list[tuple[str, str]], *keys: str) -> DataFrame:
    """(keys, m1, m2, a1 .. c2): both curves of each named pair of methods."""
    named = F.broadcast(fits.sparkSession.createDataFrame(pairs, "m1 string, m2 string"))  # as long as the caller's list
    one = fits.join(named, fits["method_id"] == named["m1"]).select(*keys, "m1", "m2", *[F.col(c).alias(f"{c}1") for c in "abc"])
    two = fits.select(*keys, F.col("method_id").alias("m2"), *[F.col(c).alias(f"{c}2") for c in "abc"])
    return one.join(two, [*keys, "m2"])


def bootstrap_crossovers(draws: DataFrame, pairs: list[tuple[str, str]], low: float, high: float, points: int = 4000, parts: int = 64) -> DataFrame:
    """(split, m1, m2, found, lo, hi): share of draws in which a pair's curves cross, and the middle 95 % of where.

    draws has fits (split, method_id, draw, a, b, c).  The interval is null
    unless more than 20 draws cross.
    """
    keys = ("split", "draw", "m1", "m2")
    x = crossover(paired_fits(draws, pairs, "split", "draw").repartition(parts, *keys), *keys, low=low, high=high, points=points)
    x = x.groupBy("split", "m1", "m2").agg(F.avg(F.col("crossover").isNotNull().cast("double")).alias("found"), F.count("crossover").alias("n"), F.percentile("crossover", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return x.select("split", "m1", "m2", "found", *[F.when(F.col("n") > 20, F.col("q")[i]).alias(k) for i, k in enumerate(("lo", "hi"))])
