"""Neighbours and top groups from one relation of cells against the joins of tested pairs."""

from __future__ import annotations

import random

from metricloom.operators import ranking, stats


def test_standings_equal_joined_tests(spark):
    rng = random.Random(4)
    rows = []
    for split in "rs":
        for size in (1, 2, 3, 4):
            for m in "abcdef":
                base = rng.choice([0.1, 0.12, 0.3])
                for seed in (11, 22, 33, 44, 55):
                    if rng.random() < 0.9:  # some seeds are missing
                        rows.append((split, size, m, seed, base + rng.gauss(0, 0.02), "ok"))
    rows += [("r", 1, "a", 66, 9.0, "failed"), ("z", 1, "only", 11, 0.5, "ok"), ("y", 1, "a", 11, 0.5, "ok"), ("y", 1, "b", 22, 0.6, "ok"), ("t", 1, "a", 1, 0.5, "ok"), ("t", 1, "b", 1, 0.5, "ok")]
    runs = spark.createDataFrame([(*r[:4], r[4], r[4], r[4], r[5]) for r in rows], "split string, train_size int, method_id string, seed int, mae double, rmse double, r2 double, status string")
    tests = ranking.seed_pairs(runs.where("status = 'ok'")).groupBy(*ranking.CELL, "m1", "m2").agg(*stats.paired_test("d"))
    both, rank = ranking.resolved_pairs(tests), ranking.ranked(ranking.summary(runs))
    near = ranking.adjacent(rank).join(both.withColumnsRenamed({"m1": "better", "m2": "worse"}), ["split", "train_size", "better", "worse"])
    told = lambda df: sorted((r.split, r.train_size, r.rank_pair, r.better, r.worse, round(abs(r.mean_diff), 9), r.p if r.p is None else round(r.p, 9), r.agree, r.resolved) for r in df.collect())
    table = ranking.standings(runs)
    assert told(ranking.adjacent_tests(table)) == told(near)
    groups = lambda df: {(r.split, r.train_size): (r.rank1, round(r.best_mae, 9), r.top_group) for r in df.collect()}
    assert groups(ranking.top_of(table)) == groups(ranking.top_groups(rank, both))
    assert ranking.top_of(ranking.standings(runs.limit(0))).count() == 0
