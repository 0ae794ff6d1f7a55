"""What sinks write, scans read back: odd texts, hot keys, null keys, empty relations, gaps."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from metricloom.plans import catalogue, exchange  # noqa: F401
from metricloom.sources import sinks
from metricloom.sources.tables import scan_csv

TEXTS = [None, "", " ", "  led", "trailed \t", "﻿mark", 'said "so"', '"', '""', "a,b", "one\ntwo", "one\r\ntwo", "one\rtwo", "back\\slash", 'back\\"both', "\\", "NaN", "null", "'", "#no comment", "über 😀", "x" * 100_000, "\n", "\r", ",", "-", "a b", "tab\tin"]


def test_csv_keeps_every_text(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, None), (3, "  led"), (3, "  led")]
    sinks.write_csv(spark.createDataFrame(rows, "i long, t string"), str(tmp_path / "c"))
    got = [tuple(r) for r in scan_csv(spark, str(tmp_path / "c"), "i long, t string", exact=True).collect()]
    assert sorted(got, key=repr) == sorted(rows, key=repr)


def test_folders_by_key_keep_every_text_and_null_keys(spark, tmp_path):
    rows = [(t, i, k) for i, t in enumerate(TEXTS) for k in ("a", "b c", None)]
    df = spark.createDataFrame(rows, "t string, i int, k string")
    sinks.write_partitioned(df, str(tmp_path / "c"), "k")
    got = [tuple(r) for r in scan_csv(spark, str(tmp_path / "c"), "t string, i int, k string", exact=True).collect()]
    assert sorted(got, key=repr) == sorted(rows, key=repr)
    # an only column keeps its rows, a null as an empty text
    sinks.write_partitioned(df.drop("i"), str(tmp_path / "o"), "k")
    got = [tuple(r) for r in scan_csv(spark, str(tmp_path / "o"), "t string, k string", exact=True).collect()]
    assert sorted(got, key=repr) == sorted(((t or "", k) for t, _, k in rows), key=repr)
    sinks.write_csv(df.select("i").withColumn("i", F.nullif("i", F.lit(0))), str(tmp_path / "n"))
    assert scan_csv(spark, str(tmp_path / "n"), "i int").where("i IS NULL").count() == 3


def test_a_key_with_many_rows_is_written_by_several_tasks(spark, tmp_path):
    df = spark.range(400_000, numPartitions=16).selectExpr("CASE WHEN id % 4 = 0 THEN 'rare' || id % 3 ELSE 'hot' END AS k", "id", "sha2(string(id), 512) AS t")
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "4m")
    try:
        sinks.write_params(df, str(tmp_path / "p"), "k")
    finally:
        spark.conf.set(size, before)
    files = {k.name: len(list(k.glob("*.parquet"))) for k in (tmp_path / "p").iterdir() if k.is_dir()}
    assert files["k=hot"] > 1
    assert sorted(files) == ["k=hot", "k=rare0", "k=rare1", "k=rare2"]
    back = sinks.scan_params(spark, str(tmp_path / "p"), "k string, id long, t string")
    assert back.exceptAll(df.select(*back.columns)).isEmpty() and back.count() == 400_000


def test_rows_of_a_large_key_are_not_sorted_by_its_task(spark, tmp_path):
    """What a task holds does not grow with the rows of its keys; keys beyond the open files are written too."""
    sc, name = spark.sparkContext, "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    big = spark.range(300_000, numPartitions=8).selectExpr("CASE WHEN id % 3 > 0 THEN 'hot' ELSE 'b' END AS k", "id")
    for write, at in ((sinks.write_partitioned, "c"), (sinks.write_params, "p")):
        sc.setJobGroup(at, at)
        try:
            write(big, str(tmp_path / at), "k")
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup(at)]
        assert jobs and all(sc._jsc.sc().statusStore().lastStageAttempt(s).peakExecutionMemory() == 0 for j in jobs for s in j.stageIds)
    keys = spark.range(3000).selectExpr("string(id % 300) AS k", "id")
    sinks.write_partitioned(keys, str(tmp_path / "many"), "k")
    sinks.write_params(keys, str(tmp_path / "many_p"), "k")
    for back in (scan_csv(spark, str(tmp_path / "many"), "k string, id long", exact=True), sinks.scan_params(spark, str(tmp_path / "many_p"), "k string, id long")):
        assert sorted(map(tuple, back.select("k", "id").collect())) == sorted((str(i % 300), i) for i in range(3000))
    assert spark.conf.get(name) == before


def _tables(spark, folder, con, **relations):
    for name, df in relations.items():
        df.write.parquet(f"{folder}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")


def test_round_trips_equal_their_sql_on_odd_rows(spark, tmp_path):
    con = duckdb.connect()
    docs = spark.createDataFrame([(i % 20 if i else None, t, "en", "web") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string")
    orders = spark.createDataFrame([(1, "O", 1.0), (1, "O", 1.0), (2, None, None), (None, "", 123456.78)], "o_orderkey long, o_orderstatus string, o_totalprice double")
    line = spark.createDataFrame([(1, 1, 7, 1.0, 10.0, "A", "F"), (1, 1, 7, 2.0, 30.0, "A", "F"), (2, 1, None, None, 1.0, None, None), (3, 2, 8, 4.0, None, "R", "O")], "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string")
    _tables(spark, tmp_path, con, documents=docs, orders=orders, lineitem=line)
    for name in ("csv_round_trip", "folders_by_key", "json_round_trip", "params_round_trip"):
        got = catalogue.QUERIES[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalogue.ORACLE[name]})").fetchall()
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr), name


def test_round_trips_of_empty_tables(spark, tmp_path):
    empty = {"documents": "doc_id long, text string, lang string, source string", "orders": "o_orderkey long, o_orderstatus string, o_totalprice double"}
    for name, schema in empty.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert catalogue.QUERIES["csv_round_trip"](spark, str(tmp_path)).isEmpty()
    assert catalogue.QUERIES["json_round_trip"](spark, str(tmp_path)).isEmpty()


def test_a_gap_among_the_runs_is_named(spark, tmp_path):
    day = "timestamp_ntz'{}-05-01 00:00:00'"
    customers = spark.sql("SELECT id AS c_custkey, element_at(array('A', 'B'), int(id)) AS c_mktsegment FROM range(1, 3)")
    orders = spark.sql("SELECT id AS o_orderkey, id AS o_custkey FROM range(1, 3)")
    rows = [(1, 1996), (2, 1996), (1, 1997)]
    line = " UNION ALL ".join(f"SELECT bigint({k}) AS l_orderkey, bigint(0) AS l_suppkey, 0.1D AS l_discount, 0.05D AS l_tax, 'F' AS l_linestatus, {day.format(y)} AS l_shipdate" for k, y in rows)
    for name, df in {"customer": customers, "orders": orders, "lineitem": spark.sql(line)}.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    with pytest.raises(SparkRuntimeException, match=r"no rows for \(B, random, 1997, 11\)"):
        catalogue.QUERIES["complete_runs"](spark, str(tmp_path)).collect()
