"""Queries over what the sinks write and the scans read back: whole tables through CSV, folders by key, JSON and parameter files, and contracts on a grid."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from metricloom.operators.ordering import checkpointed, shared_folder
from metricloom.plans.catalogue import RUNS, query, r6
from metricloom.sources import sinks
from metricloom.sources.tables import complete, runs, scan_csv, table


def _folder(spark, name: str) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT doc_id, text, lang, source FROM documents")
def csv_round_trip(spark, d):
    """All documents as CSV and back: line breaks, quotes and commas in texts, null and empty texts apart."""
    at = _folder(spark, "csv")
    sinks.write_csv(table(spark, d, "documents").select("doc_id", "text", "lang", "source"), at)
    return scan_csv(spark, at, "doc_id long, text string, lang string, source string", exact=True)


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, l_linestatus FROM lineitem")
def folders_by_key(spark, d):
    """All line items as CSV in a folder for each return flag and line status, keys read back from the folders' names."""
    at, keys = _folder(spark, "keys"), ["l_returnflag", "l_linestatus"]
    sinks.write_partitioned(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", *keys), at, *keys)
    return scan_csv(spark, at, "l_orderkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string", exact=True)


@query("SELECT o_orderkey, o_orderstatus, round(o_totalprice / 7000000, 10) AS share FROM orders")
def json_round_trip(spark, d):
    """All orders as JSON records with ten decimals, and back."""
    at = _folder(spark, "json")
    sinks.write_json(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", (F.col("o_totalprice") / 7_000_000).alias("share")), at, decimals=10)
    return spark.read.schema("o_orderkey long, o_orderstatus string, share double").json(at)


@query("SELECT l_linestatus, l_suppkey, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, count(*) AS n FROM lineitem GROUP BY 1, 2")
def params_round_trip(spark, d):
    """A line for each line status and supplier as a parameter file by status, and back with exact numbers."""
    at = _folder(spark, "params")
    fits = table(spark, d, "lineitem").groupBy("l_linestatus", "l_suppkey").agg(F.regr_slope("l_extendedprice", "l_quantity").alias("slope"), F.count(F.lit(1)).alias("n"))
    sinks.write_params(fits, at, "l_linestatus")
    return sinks.scan_params(spark, at, "l_linestatus string, l_suppkey long, slope double, n long").withColumn("slope", F.round("slope", 4))


@query(f"WITH {RUNS} SELECT split, method_id, train_size, seed, round(mae, 6) AS mae FROM runs")
def complete_runs(spark, d):
    """The runs, if every method has every split, size and seed that any method has; else the job fails and names a gap."""
    rows = checkpointed(runs(spark, d))
    # methods, and keys of their runs: a few hundred of each at any scale
    grid = rows.select("method_id").distinct().crossJoin(rows.select("split", "train_size", "seed").distinct())
    return complete(grid, rows, "method_id", "split", "train_size", "seed").select("split", "method_id", "train_size", "seed", *r6("mae"))
