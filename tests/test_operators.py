from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricloom.functions.text import key_parts, list_length, normaliser
from metricloom.operators import clean, curves, ranking, splits, stats
from metricloom.operators.ordering import dense_id, sum_before
from metricloom.plans import catalogue
from metricloom.sources import sinks, tables
from metricloom.sources.tables import constants, optional_column, require_columns, require_complete, scan_csv, scan_json
from metricloom.streaming.events import windowed_counts


def test_coerce_drops_what_is_not_finite(spark):
    df = spark.createDataFrame([(x,) for x in ("abc", "", None, "inf", "nan", "1e3", "0.12345678901")], "v string")
    assert sorted(r.v for r in clean.coerce(df, "v").collect()) == [0.123456789, 1000.0]


def test_conflicts_drop_and_first_row_stays(spark):
    rows = [("a", 1.0, 3, "x"), ("a", 1.0, 1, "y"), ("b", 1.0, 2, "z"), ("b", 2.0, 4, "w"), (None, 1.0, 5, "v"), ("c", 5.0, 6, "u")]
    df = spark.createDataFrame(rows, "k string, v double, i int, t string")
    out = sorted(tuple(r) for r in clean.drop_conflicts(df, "k", "v", "i").collect())
    assert out == [("a", 1.0, 1, "y"), ("c", 5.0, 6, "u")]


def test_dense_id_counts_from_zero_in_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(7)
    out = sorted((r.id, r.x) for r in dense_id(df, "x").collect())
    assert out == [(i, i) for i in range(1000)]


@pytest.mark.parametrize("text, n", [("[]", 0), ("[1.0, 2.0]", 2), ("1.5", 1), ("not a list", 1), ("[1.0, nan]", 1), (None, 1)])
def test_list_length(spark, text, n):
    assert spark.createDataFrame([(text,)], "t string").select(list_length(F.col("t")).alias("n")).first().n == n


def test_normalisers_turn_failures_into_nulls(spark):
    df = spark.createDataFrame([("A",), (None,), ("!",)], "s string")
    f = normaliser(lambda s: {"A": "a"}[s])
    assert [r[0] for r in df.select(f("s")).collect()] == ["a", None, None]
    g = key_parts(lambda s: {"A": ("a", "b", "c")}[s])
    assert [tuple(r.k) for r in df.select(g("s").alias("k")).collect()] == [("a", "b", "c"), (None,) * 3, (None,) * 3]


def test_random_split_partitions_ids_and_prefixes_nest(spark):
    df = spark.range(200).withColumnRenamed("id", "k")
    s = splits.random_split(df, "k", [1, 2])
    counts = {(r.seed, r.split_role): r["count"] for r in s.groupBy("seed", "split_role").count().collect()}
    assert counts == {(x, r): n for x in (1, 2) for r, n in (("test", 40), ("val", 20), ("train", 140))}
    assert s.select("seed", "k").distinct().count() == 400
    p = splits.nested_prefixes(s, [5, 50])
    five = {(r.seed, r.k) for r in p.where("target_train_size = 5").collect()}
    fifty = {(r.seed, r.k) for r in p.where("target_train_size = 50").collect()}
    assert len(five) == 10 and five < fifty and len(fifty) == 100


def test_running_sums_in_order_with_ties_and_nulls(spark):
    rows = [(i, (i * 37) % 5, None if i % 50 == 0 else i % 7) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, k int, v long").repartition(6)
    got = {r.i: r.b for r in sum_before(df, "v", F.desc("k"), "i", name="b").collect()}
    total = 0
    for i, _, v in sorted(rows, key=lambda r: (-r[1], r[0])):
        assert got[i] == total
        total += v or 0
    assert sum_before(df.limit(0), "v", "i", name="b").count() == 0 and dense_id(df.limit(0), "i").count() == 0


def test_hot_values_spread_over_partitions(spark):
    df = spark.range(5000).select(F.lit("same").alias("h"), F.col("id").alias("x")).repartition(9)
    out = dense_id(df, "h", "x", name="n").where("n <> x")
    assert out.count() == 0


def test_group_split_fills_greedily(spark):
    rng = np.random.default_rng(1)
    sizes = [(f"g{i}", int(n)) for i, n in enumerate(rng.integers(1, 9, 60))]
    out = splits.group_split(spark.createDataFrame(sizes, "g string, size long"), "g", 5, 100).collect()
    train = sorted((r["size"] for r in out if r.split_role == "train"), reverse=True)
    assert sum(train) >= 100 and sum(train) - train[-1] < 100
    rest = sum(n for _, n in sizes) - sum(train)
    val = sum(r["size"] for r in out if r.split_role == "val")
    assert round(rest / 3) <= val < round(rest / 3) + 9
    assert len(out) == 60


def test_leave_one_out_equals_refits(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=30), rng.normal(size=30)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "i int, x double, y double")
    got = {r.i: r.loo for r in stats.leave_one_out(df, "y", "x").collect()}
    for i in range(30):
        m = np.arange(30) != i
        slope, intercept = np.polyfit(x[m], y[m], 1)
        assert got[i] == pytest.approx(slope * x[i] + intercept, abs=1e-9)


def test_paired_test_against_numeric_integration(spark):
    def p_of(d):
        df = spark.createDataFrame([(float(v),) for v in d], "d double")
        return df.agg(*stats.paired_test("d")).first()

    d = np.array([0.1, 0.3, 0.2, 0.25, 0.4])
    t = abs(d.mean() / (d.std(ddof=1) / np.sqrt(5)))
    grid = np.linspace(t, 3000, 3_000_001)
    density = 0.375 * (1 + grid**2 / 4) ** -2.5
    assert p_of(d).p == pytest.approx(2 * np.trapezoid(density, grid), abs=1e-6)
    assert p_of(d).agree
    assert p_of([1, 1, 1, 1, 1]).p == 0.0
    zero = p_of([0, 0, 0, 0, 0])
    assert zero.p is None and not zero.agree
    assert not p_of([1, -1, 2, 3, 4]).agree


@pytest.mark.parametrize("d", [[0.1, 0.2, 0.35], [0.1, 0.3], [0.5, -0.1, 0.2, 0.4], [0.3, 0.1, 0.2, -0.05, 0.4, 0.2, 0.1], [0.01 * i for i in range(1, 13)]])
def test_paired_test_of_any_number_of_seeds(spark, d):
    p = spark.createDataFrame([(float(v),) for v in d], "d double").agg(*stats.paired_test("d")).first().p
    x, v = np.array(d), len(d) - 1
    t = abs(x.mean() / (x.std(ddof=1) / np.sqrt(len(d))))
    angle = np.linspace(np.arctan(t / np.sqrt(v)), np.pi / 2, 2_000_001)  # in u = sqrt(v) tan(angle) the density is cos ** (v - 1)
    whole = np.trapezoid(np.cos(np.linspace(0, np.pi / 2, 2_000_001)) ** (v - 1), dx=np.pi / 4e6)
    assert p == pytest.approx(np.trapezoid(np.cos(angle) ** (v - 1), angle) / whole, abs=1e-9)


def test_paired_test_of_one_seed_has_no_p(spark):
    r = spark.createDataFrame([(0.5,)], "d double").agg(*stats.paired_test("d")).first()
    assert r.p is None and r.agree and r.mean_diff == 0.5


@pytest.mark.parametrize("xs, want", [([1.0], [None]), ([1.0, 2.0], [None, None]), ([3.0, 3.0, 3.0], [None] * 3), ([1.0, 1.0, 4.0], [7.0, 4.0, None])])
def test_leave_one_out_without_a_line(spark, xs, want):
    rows = [(i, x, y) for i, (x, y) in enumerate(zip(xs, (4.0, 7.0, 1.0), strict=False))]
    got = stats.leave_one_out(spark.createDataFrame(rows, "i int, x double, y double"), "y", "x").orderBy("i").collect()
    assert [r.loo for r in got] == [None if w is None else pytest.approx(w) for w in want]
    assert stats.leave_one_out(spark.createDataFrame([], "i int, x double, y double"), "y", "x").count() == 0


def test_gaps_in_a_grid_are_an_error(spark):
    grid = constants(spark, [("a", 1), ("a", 2)], "s string, n int")
    rows = constants(spark, [("a", 1, 0.5), ("a", 1, 0.6)], "s string, n int, v double")
    with pytest.raises(ValueError, match="'a', 2"):
        require_complete(grid, rows, "s", "n")
    assert require_complete(grid.where("n = 1"), rows, "s", "n").count() == 2


def test_fit_finds_known_curves_and_clamps(spark):
    n = [500, 1000, 2000, 3000, 5000, 7000, 8000, 10000]
    rows = [("k", x, 0.9 * x**-0.4 + 0.05) for x in n] + [("flat", x, 0.2) for x in n] + [("zero", x, 0.5 * x**-0.2) for x in n]
    pts = spark.createDataFrame([(k, float(a), float(b)) for k, a, b in rows], "g string, n double, y double")
    fit = {r.g: r for r in curves.refine(curves.fit_grid(pts, "g"), pts, "g", rounds=4).collect()}
    assert (fit["k"].a, fit["k"].b, fit["k"].c) == pytest.approx((0.9, 0.4, 0.05), abs=2e-3)
    assert fit["zero"].c == pytest.approx(0, abs=1e-3) and fit["zero"].c >= 0
    assert fit["flat"].a * 500 ** -fit["flat"].b + fit["flat"].c == pytest.approx(0.2, abs=1e-3)


#: Two fitted curves of the published summary and where they cross.
def test_crossover_point_of_published_fits(spark):
    rows = [("x", 0.643021, 0.278311, 0.0198123, 1.116038, 0.309424, 0.0), ("none", 1.0, 0.3, 0.0, 2.0, 0.3, 0.0), ("null", None, 0.3, 0.0, 1.0, 0.2, 0.0)]
    got = {r.k: r.crossover for r in curves.crossover(spark.createDataFrame(rows, "k string, a1 double, b1 double, c1 double, a2 double, b2 double, c2 double"), "k").collect()}
    assert got["x"] == pytest.approx(5068.95, rel=2e-3)
    assert got["none"] is None and got["null"] is None


def test_bootstrap_crossovers_against_a_loop(spark):
    rng = np.random.default_rng(3)
    n = np.arange(1.0, 8.0)
    rows = []
    for split, crossing in (("often", 25), ("seldom", 15)):
        for draw in range(30):
            a2, b2 = (1.2, 0.8) if draw < crossing else (2.0, 0.3)
            for m, y in (("base", 1.0 * n**-0.4 + 0.05), ("m", a2 * n**-b2 + 0.05)):
                rows += [(split, m, draw, x, v) for x, v in zip(n.tolist(), (y + rng.normal(0, 1e-3, 7)).tolist(), strict=True)]
    points = spark.createDataFrame(rows, "split string, method_id string, draw int, n double, y double")
    fits = curves.fitted(points, "split", "method_id", "draw", parts=4)
    got = {r.split: r for r in curves.bootstrap_crossovers(fits, [("base", "m")], 1, 7, parts=4).collect()}

    def fit(y):
        low, high = 0.01, 2.0
        for _ in range(6):
            b = np.linspace(low, high, 400)
            z = n ** -b[:, None]
            d = z - z.mean(1, keepdims=True)
            c = np.clip(y.mean() - (d * (y - y.mean())).sum(1) / (d * d).sum(1) * z.mean(1), 0, y.min())
            a = np.maximum(((y - c[:, None]) * z).sum(1) / (z * z).sum(1), 0)
            i = ((y - a[:, None] * z - c[:, None]) ** 2).sum(1).argmin()
            best, step = (a[i], b[i], c[i]), (high - low) / 399
            low, high = max(b[i] - step, 0.01), min(b[i] + step, 2.0)
        return best

    ys = {}
    for split, m, draw, _, y in rows:
        ys.setdefault((split, m, draw), []).append(y)
    grid = np.geomspace(1, 7, 4000)
    for split in ("often", "seldom"):
        at = []
        for draw in range(30):
            one, two = ((lambda a, b, c: a * grid**-b + c)(*fit(np.array(ys[split, m, draw]))) for m in ("base", "m"))
            at += list(grid[np.flatnonzero(np.diff(np.sign(one - two)))[:1]])
        assert got[split].found == pytest.approx(len(at) / 30)
        want = np.quantile(at, [0.025, 0.975]) if len(at) > 20 else [None, None]
        assert [got[split].lo, got[split].hi] == (want if len(at) <= 20 else pytest.approx(want, rel=2e-3))
    assert got["often"].lo is not None and got["seldom"].lo is None


#: Mean errors published for one cell; the order is known.
def test_ranks_of_a_published_cell(spark):
    cell = {"rdkit_rf": 0.1463508287, "rdkit_xgb": 0.1417843655, "rdkit_mlp": 0.1334915265, "morgan_rf": 0.1951530973, "morgan_xgb": 0.1951533407, "morgan_mlp": 0.2124003440, "gine": 0.1324619591}
    df = spark.createDataFrame([("scaffold", 2000, k, v) for k, v in cell.items()], "split string, train_size int, method_id string, mean_mae double")
    got = [r.method_id for r in ranking.ranked(df).orderBy("rnk").collect()]
    assert got == ["gine", "rdkit_mlp", "rdkit_xgb", "rdkit_rf", "morgan_rf", "morgan_xgb", "morgan_mlp"]


def test_top_group_compares_with_the_winner_only(spark):
    rank = spark.createDataFrame([("s", 1, "a", 0.1, 1), ("s", 1, "b", 0.2, 2), ("s", 1, "c", 0.3, 3)], "split string, train_size int, method_id string, mean_mae double, rnk int")
    tests = spark.createDataFrame([("s", 1, "a", "b", -0.1, 0.2, True), ("s", 1, "a", "c", -0.2, 0.01, True), ("s", 1, "b", "c", -0.1, 0.5, True)], "split string, train_size int, m1 string, m2 string, mean_diff double, p double, agree boolean")
    out = ranking.top_groups(rank, ranking.resolved_pairs(tests)).first()
    assert out.top_group == ["a", "b"]


def test_scans_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿name,v\r\n"x, ""y""",1.5\r\nz,NaN\r\n'.encode())
    assert [tuple(r) for r in scan_csv(spark, str(tmp_path / "a.csv"), "name string, v double").collect()] == [('x, "y"', 1.5), ("z", None)]
    (tmp_path / "a.json").write_text('[{"k": {"1": 2.0}}, {"k": null}]')
    assert [r.k for r in scan_json(spark, str(tmp_path / "a.json"), "k map<string,double>").collect()] == [{"1": 2.0}, None]
    df = constants(spark, [("a", 1, [1.0, 2.0]), ("b", 2, None)], "s string, n int, xs array<double>")
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert scan_csv(spark, str(tmp_path / "csv"), "s string, n int, xs string").where("s = 'a'").first().xs == "[1.0,2.0]"
    sinks.write_partitioned(df.drop("xs"), str(tmp_path / "by"), "n")
    assert sorted(p.name for p in (tmp_path / "by").iterdir() if p.is_dir()) == ["n=1", "n=2"]
    sinks.write_json(df.withColumn("d", F.lit(1 / 3)), str(tmp_path / "json"), decimals=10)
    assert spark.read.json(str(tmp_path / "json")).first().d == 0.3333333333
    with pytest.raises(ValueError):
        require_columns(df, "s", "gone")
    assert df.select(optional_column(df, "gone").alias("g")).first().g is None


def test_doubles_at_any_depth_are_rounded(spark, tmp_path):
    df = spark.sql("SELECT named_struct('a', 1 / 3D, 'b', array(2 / 3D, NULL)) AS s, map('k', 1 / 3D) AS m, CAST(NULL AS struct<a: double>) AS z, 1 / 3D AS d")
    sinks.write_json(df, str(tmp_path / "j"), decimals=10)
    assert spark.read.json(str(tmp_path / "j")).first().asDict(True) == {"s": {"a": 0.3333333333, "b": [0.6666666667, None]}, "m": {"k": 0.3333333333}, "d": 0.3333333333}
    sinks.write_report(df, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first().z is None
    sinks.write_params(df.select("d"), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).first().d == 1 / 3


def test_split_files_by_split_seed_and_size(spark, tmp_path):
    df = spark.range(100).withColumnRenamed("id", "k")
    s = splits.random_split(df, "k", [1, 2])
    files = splits.nested_prefixes(s, [5, 50]).withColumn("split", F.lit("random"))
    sinks.write_partitioned(files.select("split", "seed", "target_train_size", "k", "split_role"), str(tmp_path / "s"), "split", "seed", "target_train_size")
    for seed in (1, 2):
        for n in (5, 50):
            assert spark.read.csv(str(tmp_path / "s" / "split=random" / f"seed={seed}" / f"target_train_size={n}"), header=True).count() == n


def test_windows_on_a_stream_equal_those_of_the_table(spark, tmp_path):
    rows = [(i, f"2024-01-01 {i // 60:02d}:{i % 60:02d}:00", "ab"[i % 2], float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id long, t string, event_type string, value double").withColumn("ts", F.col("t").cast("timestamp_ntz")).drop("t")
    df.write.parquet(str(tmp_path / "in"))
    stream = windowed_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("seen").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("seen").collect())) == sorted(map(tuple, windowed_counts(df).collect()))


def test_the_curves_read_line_items_once_and_deal_them_once(spark, monkeypatch):
    """Fits and draws come from one relation of runs; customers join the orders, not the line items."""
    read, d = [], "/root/testdata/sf0.001"
    whole = tables.table
    monkeypatch.setattr(tables, "table", lambda s, at, name: read.append(name) or whole(s, at, name))
    fits = {k: F.lit(x) for k, x in zip("abc", (1.0, 0.5, 0.1), strict=True)}
    monkeypatch.setattr(curves, "fitted", lambda points, *keys, parts=1: points.select(*keys).distinct().withColumns(fits))
    for query in (catalogue.crossover_bootstrap, catalogue.curve_fit_report):
        read.clear()
        query(spark, d)
        assert read.count("lineitem") == 1
    size = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(size)
    spark.conf.set(size, "-1")  # as for large tables
    try:
        plan = tables.runs(spark, d)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(size, before)
    dealt = plan.split("hashpartitioning(o_custkey")
    assert len(dealt) == 2 and "l_" not in dealt[1].split("hashpartitioning(")[0]
