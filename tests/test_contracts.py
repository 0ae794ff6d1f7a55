"""Contracts in the pass that reads the data, unknown JSON keys, group pools and the command line."""

from __future__ import annotations

import collections
import csv
import hashlib
import json
import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricloom.operators import splits
from metricloom.sources.tables import complete, constants, json_paths, watched


def test_gaps_fail_the_job_that_reads_and_rows_are_read_once(spark, tmp_path):
    grid = constants(spark, [("a", 1), ("a", 2), (None, 3)], "s string, n int")
    constants(spark, [("a", 1, 0.5), ("a", 1, 0.6), ("a", 2, 0.1), (None, 3, 1.0), ("z", 9, 2.0)], "s string, n int, v double").write.parquet(str(tmp_path / "r"))
    rows = spark.read.parquet(str(tmp_path / "r"))
    whole = complete(grid, rows, "s", "n")
    assert sorted(map(tuple, whole.collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)
    assert whole._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1
    lacking = complete(grid, rows.where("n <> 3"), "s", "n")
    with pytest.raises(Exception, match=r"no rows for \(null, 3\)"):
        lacking.count()


def test_counts_come_with_the_action(spark, tmp_path):
    rows = [(1, 0.5, "x"), (None, float("nan"), None), (3, None, "y"), (4, float("nan"), "z")]
    df, seen = watched(spark.createDataFrame(rows, "k int, v double, s string"), "rows of a scan")
    df.write.parquet(str(tmp_path / "out"))
    assert seen.get == {"rows": 4, "null_k": 1, "null_v": 1, "null_s": 1, "nan_v": 2}


def test_paths_of_nested_texts(spark):
    texts = ['{"a": 1, "b": {"c": [1, "x", null, {"d": true}]}}', '{"a": "s", "b": {}}', "[1.5, 2]", "null", "not json", None, "{}", '{"a": 1, "b": {"c": []}}']
    want = collections.Counter()

    def walk(path, v):
        kind = {dict: "OBJECT", list: "ARRAY", int: "BIGINT", float: "DECIMAL", str: "STRING", bool: "BOOLEAN", type(None): "VOID"}[type(v)]
        want[path, kind] += 1
        for k, x in v.items() if isinstance(v, dict) else (("[*]", x) for x in v) if isinstance(v, list) else ():
            walk(path + (k if k == "[*]" else f".{k}"), x)

    for t in texts:
        if t == "not json":
            want["$", "INVALID"] += 1
        elif t is not None:
            walk("$", json.loads(t))
    got = json_paths(spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect()
    assert {(r.path, r.type): r.n for r in got} == dict(want)
    assert json_paths(spark.createDataFrame([], "t string"), "t").count() == 0


def test_group_pool_shuffles_members_within_their_role(spark):
    rng = np.random.default_rng(3)
    rows = [(None if i % 97 == 0 else f"g{rng.integers(0, 30)}" if i % 3 else "hot", i) for i in range(900)]
    members = spark.createDataFrame(rows, "g string, m long").repartition(5)
    sizes = members.where("g IS NOT NULL").groupBy("g").agg(F.count(F.lit(1)).alias("size"))
    roles = splits.group_split(sizes, "g", 11, 500)
    role = {r.g: r.split_role for r in roles.collect()}
    got = splits.group_pool(members, roles, "g", "m", 11)
    seen = collections.defaultdict(list)
    for r in got.orderBy("pos").collect():
        seen[r.split_role].append((r.pos, r.m))
    for name, pool in seen.items():
        want = sorted((m for g, m in rows if role.get(g) == name), key=lambda m: hashlib.md5(f"11|{m}".encode()).hexdigest())
        assert pool == list(enumerate(want, 1))
    assert len(seen["train"]) >= 500 and set(seen) == {"train", "val", "test"}
    prefixes = splits.nested_prefixes(got, [10, 50])
    assert {r.target_train_size: r["count"] for r in prefixes.groupBy("target_train_size").count().collect()} == {10: 10, 50: 50}


def test_the_command_line(tmp_path):
    env = os.environ | {"SPARK_LOCAL_IP": "127.0.0.1"}
    run = lambda *a: subprocess.run([sys.executable, "-m", "metricloom", *a], cwd=Path(__file__).resolve().parent.parent, env=env, capture_output=True, text=True, timeout=300)
    text = "SELECT n_regionkey, count(*) AS n FROM IDENTIFIER(:from) WHERE n_nationkey >= CAST(:least AS int) GROUP BY 1"
    done = run("sql", "--sql", text, "--table", "nation", "--param", "from=nation", "--param", "least=5", "--in", "/root/testdata/sf0.001", "--out", f"{tmp_path}/out.csv", "--format", "csv", "--order", "n_regionkey")
    assert done.returncode == 0, done.stderr
    with open(tmp_path / "out.csv", encoding="utf-8-sig") as f:
        rows = list(csv.DictReader(f))
    assert [r["n_regionkey"] for r in rows] == ["0", "1", "2", "3", "4"] and sum(int(r["n"]) for r in rows) == 20
    assert "no query 'nope'" in run("nope", "--in", "x", "--out", "y").stderr
