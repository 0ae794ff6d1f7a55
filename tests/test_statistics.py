"""The published stream, exact quantiles, the mergeable bootstrap and user-defined aggregates."""

from __future__ import annotations

import collections
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from metricloom.operators import quantiles, resampling, stats, streams
from metricloom.operators.aggregates import Mean, Range, TrimmedMean, aggregate
from metricloom.operators.quantiles import exact_quantiles
from metricloom.operators.resampling import LEVELS, PRIME, offsets, poisson_bootstrap, weights
from test_goldens import LOO_INTERVAL, MATCHED


@pytest.mark.parametrize("seed, n", [(20260925, 62), (1, 5), (7, 3_000_000_000), (3, (1 << 32) - 1), (2, 1 << 31)])
def test_draws_equal_the_serial_stream_in_any_number_of_slices(spark, seed, n):
    count = 5001
    want = np.random.default_rng(seed).integers(0, n, count).tolist()
    for parts in (1, 7, 64):
        rows = streams.draws(spark, seed, n, count, slice_words=-(-2 * count // parts)).collect()
        assert [r.pick for r in sorted(rows)] == want and sorted(r.pos for r in rows) == list(range(count))


def test_draws_go_on_over_calls_and_know_their_edges(spark):
    rng = np.random.default_rng(5)
    want = np.concatenate([rng.integers(0, 5, size=(8, 5)).ravel() for _ in range(30)]).tolist()
    assert [r.pick for r in streams.draws(spark, 5, 5, 1200).orderBy("pos").collect()] == want
    assert streams.draws(spark, 5, 5, 0).count() == 0
    assert [r.pick for r in streams.draws(spark, 5, 1, 3).collect()] == [0, 0, 0]
    with pytest.raises(ValueError):
        streams.draws(spark, 5, 0, 3)


@pytest.mark.parametrize("seed, n, words", [(20260925, 62, 1001), (7, 3_000_000_000, 3000), (1, 5, 1), (3, 4, 9)])
def test_draws_in_sql(seed, n, words):
    got = duckdb.sql(f"WITH RECURSIVE {streams.draws_sql(seed, n, words)} SELECT pick FROM picks ORDER BY pos").fetchall()
    assert [r[0] for r in got] == np.concatenate(list(streams.accepted(seed, n, 0, words))).tolist()


def test_the_published_interval(spark):
    rows = spark.createDataFrame([(i, abs(p - y)) for i, (y, _, p) in enumerate(MATCHED)], "row long, e double")
    means = stats.stream_means(rows, "row", "e", 20260925, 20_000)
    got = exact_quantiles(means, "m", [0.025, 0.975]).first()
    assert got.n == 20_000 and got.q == pytest.approx(LOO_INTERVAL, abs=1e-9)
    assert stats.stream_means(rows.limit(0), "row", "e", 1, 10).count() == 0


def of(values, p):
    x = sorted(v for v in values if v is not None and v == v)
    return None if not x else float(np.quantile(x, p))


@pytest.mark.parametrize("accuracy, limit", [(10_000, 1_000_000), (50, 20), (10, 3)])
def test_quantiles_equal_sorted_ones(spark, accuracy, limit):
    rng = random.Random(accuracy)
    rows = [(rng.choice(["hot"] * 6 + ["b", "c", None]), rng.choice([rng.gauss(0, 1), float(rng.randrange(4)), rng.lognormvariate(0, 40), None, float("nan")])) for _ in range(4000)]
    rows += [("one", 2.5), ("none", None), ("none", float("nan")), ("two", 1.0), ("two", 4.0)] + [("ties", 7.0)] * 50 + [("ties", 8.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    probs = [0.0, 0.025, 0.5, 0.975, 1.0]
    got = {r.g: r for r in exact_quantiles(df, "v", probs, "g", accuracy=accuracy, limit=limit).collect()}
    groups = collections.defaultdict(list)
    for g, v in rows:
        groups[g].append(v)
    assert set(got) == set(groups)
    for g, values in groups.items():
        want = [of(values, p) for p in probs]
        assert got[g].n == sum(v is not None and v == v for v in values)
        assert (got[g].q or [None] * 5) == [None if w is None else pytest.approx(w, rel=1e-12, abs=1e-12) for w in want], g
    whole = exact_quantiles(df, "v", [0.3], accuracy=accuracy, limit=limit).collect()
    assert len(whole) == 1 and whole[0].q == [pytest.approx(of([v for _, v in rows], 0.3), rel=1e-12)]
    empty = exact_quantiles(df.limit(0), "v", [0.5]).collect()
    assert [(r.n, r.q) for r in empty] == [(0, None)] and exact_quantiles(df.limit(0), "v", [0.5], "g").count() == 0


def test_a_million_distinct_values_in_one_group(spark, monkeypatch):
    """Equal to the exact percentile, and no task gets more than a small share of the group."""
    df = spark.range(1_000_000).select(F.lit("g").alias("g"), F.pow(F.pmod(F.col("id") * 7919, F.lit(1_000_000)) / 1e6, 3).alias("v"))
    seen = []
    whole = quantiles._held
    monkeypatch.setattr(quantiles, "_held", lambda *a: seen.append(whole(*a)) or seen[-1])
    got = exact_quantiles(df, "v", [0.025, 0.5], "g").first()
    want = df.agg(F.percentile("v", F.array(F.lit(0.025), F.lit(0.5)))).first()[0]
    assert got.q == want
    assert len(seen) == 1 and seen[0].count() < 5000  # distinct values near the two ranks


@pytest.mark.parametrize("few, join", [(100_000, "BroadcastHashJoin"), (0, "ShuffledHashJoin")])
def test_rows_of_a_hot_group_are_not_sorted(spark, monkeypatch, few, join):
    """A group's rows pass by a hash of the brackets, not through a sort of one task, also with too many groups to broadcast."""
    df = spark.range(300_000, numPartitions=8).select(F.when(F.col("id") % 10 > 0, "hot").alias("g"), (F.col("id") * 7919 % 300_000).cast("double").alias("v"))
    seen = []
    whole = quantiles._held
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "_held", lambda *a: seen.append(whole(*a)) or seen[-1])
    size = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(size)
    spark.conf.set(size, "-1")  # as for a large table
    try:
        got = {r.g: r.q for r in exact_quantiles(df, "v", [0.025, 0.5], "g", limit=50).collect()}
    finally:
        spark.conf.set(size, before)
    want = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("v", F.array(F.lit(0.025), F.lit(0.5))).alias("q")).collect()}
    assert got == {g: pytest.approx(q, rel=1e-12) for g, q in want.items()}
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert join in plan and "SortMergeJoin" not in plan and "Sort [" not in plan


def test_narrowing_finds_the_ranks_of_a_wide_bracket(spark):
    df = spark.range(30_000).select(F.pmod(F.col("id") * 7919, F.lit(30_000)).cast("double").alias("v"))
    assert exact_quantiles(df, "v", [0.25, 0.75], accuracy=20, limit=10).first().q == [7499.75, 22499.25]


def test_poisson_bootstrap_equals_a_loop(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "b", None]), rng.randrange(60), rng.choice([rng.random(), rng.random(), None, float("nan")])) for _ in range(500)] + [("a", None, 1.0), ("z", 3, None)]
    df = spark.createDataFrame(rows, "g string, k long, v double").repartition(5)

    def five(x):
        return pow(x, 5, PRIME)

    def weight(k, d, seed):
        x = five((five((k + seed) % PRIME) + five((d * 48271 + 1) % PRIME)) % PRIME)
        return sum(x >= v for v in LEVELS)

    want = collections.defaultdict(lambda: [0, 0.0])
    for g, k, v in rows:
        if v is not None and v == v and k is not None:
            for d in range(40):
                w = weight(k, d, 9)
                want[g, d][0] += w
                want[g, d][1] += w * v
    got = poisson_bootstrap(df, "v", "k", "g", draws=40, seed=9).collect()
    assert {(r.g, r.draw): (r.weight, r["mean"]) for r in got} == {k: (w, pytest.approx(s / w) if w else None) for k, (w, s) in want.items()}
    assert poisson_bootstrap(df, "v", "k", draws=3).count() == 3 and poisson_bootstrap(df.limit(0), "v", "k", draws=3).count() == 0


def test_poisson_weights_equal_the_hash_in_whole_numbers():
    """Also at the ends of 64 bits and of the modulus, for keys and draws whose hash is 0, and beside each level."""
    offset = offsets(np.arange(300))
    keys = [0, 1, -1, PRIME - 2, PRIME - 1, PRIME, -PRIME, (1 << 63) - 1, -(1 << 63), *np.random.default_rng(4).integers(-(1 << 63), (1 << 63) - 1, 500).tolist()]
    for seed in (0, 1, 20260925):
        own = [pow((k % PRIME + seed) % PRIME, 5, PRIME) for k in keys]
        want = [[sum(pow(x + int(o), 5, PRIME) >= v for v in LEVELS) for o in offset] for x in own]
        assert weights(np.array(keys), offset, seed).tolist() == want
    # offsets that bring a key's hash to a level, just below it, and to both ends
    root = pow(5, -1, PRIME - 1)
    aim = [0, 1, PRIME - 1, *LEVELS, *[v - 1 for v in LEVELS]]
    own = pow(7, 5, PRIME)
    shift = np.array([(pow(x, root, PRIME) - own) % PRIME for x in aim])
    assert weights(np.array([7]), shift, 0).tolist() == [[sum(x >= v for v in LEVELS) for x in aim]]


def test_groups_of_a_key_share_its_weights(spark, monkeypatch):
    """Weights are made once for a key, not once for each of its groups; the groups are sent on in parts."""
    calls = spark.sparkContext.accumulator(0)
    whole = resampling.weights

    def counted(keys, *more):
        calls.add(len(keys))
        return whole(keys, *more)

    monkeypatch.setattr(resampling, "weights", counted)
    monkeypatch.setattr(resampling, "HELD", 3)
    df = spark.range(4000).select((F.col("id") % 400).alias("k"), F.expr("id div 400").alias("g"), F.lit(1.0).alias("v")).repartition(5)
    got = resampling.poisson_bootstrap(df, "v", "k", "g", draws=20).collect()
    want = whole(np.arange(400), offsets(np.arange(20)), 1).sum(0)
    assert {(r.g, r.draw): r.weight for r in got} == {(g, d): want[d] for g in range(10) for d in range(20)}
    assert calls.value == 400


def test_poisson_weights_are_spread_as_they_should():
    w = weights(np.arange(4000), offsets(np.arange(500)), 1)
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.01)
    assert (w == 0).mean() == pytest.approx(np.exp(-1), abs=2e-3)
    assert np.abs(np.corrcoef(w[:, :50], rowvar=False) - np.eye(50)).max() < 0.08  # draws
    assert np.abs(np.corrcoef(w[:50]) - np.eye(50)).max() < 0.25  # clusters, over 500 draws
    # the spread of bootstrap means of 4,000 numbers is that of their mean
    x = np.random.default_rng(0).normal(size=4000)
    assert ((x @ w) / w.sum(0)).std() == pytest.approx(x.std() / 4000**0.5, rel=0.12)


def test_user_aggregates_equal_loops(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([rng.gauss(0, 9), None])) for _ in range(3000)] + [(9, None), (8, 5.0)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(9)
    made = {"range": (Range(), "v"), "mean": (Mean(), "v"), "trimmed": (TrimmedMean(10), "v")}
    got = {r.k: r for r in aggregate(df, made, "k").collect()}
    groups = collections.defaultdict(list)
    for k, v in rows:
        groups[k] += [v] * (v is not None)
    assert set(got) == set(groups)
    for k, v in groups.items():
        v = sorted(v)
        want = (v[-1] - v[0], sum(v) / len(v), sum(v[10:-10]) / (len(v) - 20) if len(v) > 20 else None) if v else (None,) * 3
        assert (got[k]["range"], got[k]["mean"], got[k]["trimmed"]) == tuple(None if w is None else pytest.approx(w) for w in want)
    assert aggregate(df, {"m": (Mean(), "v")}).first().m == pytest.approx(sum(map(sum, groups.values())) / sum(map(len, groups.values())))
    assert aggregate(df.limit(0), made, "k").count() == 0
