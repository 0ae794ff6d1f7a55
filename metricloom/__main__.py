"""Run a registered query or an SQL text over a folder of tables: ``python -m metricloom NAME --in DIR --out DIR``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from metricloom.plans import catalogue, exchange, statistics  # noqa: F401  (the other two register their queries in the catalogue)
from metricloom.sources.files import write_csv_file, write_json_array


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="metricloom", description=__doc__)
    p.add_argument("query", help="a registered query, or 'sql'")
    p.add_argument("--in", dest="source", required=True, help="the folder of the tables, TABLE.parquet each")
    p.add_argument("--out", required=True, help="a folder for parquet, a file for csv and json")
    p.add_argument("--format", choices=["parquet", "csv", "json"], default="parquet")
    p.add_argument("--order", action="append", default=[], help="columns that order a csv or json file")
    p.add_argument("--sql", help="the text of 'sql': parameters as :name, tables as IDENTIFIER(:name) or by their own names")
    p.add_argument("--table", action="append", default=[], help="a table that the text names")
    p.add_argument("--param", action="append", default=[], metavar="NAME=VALUE", help="a parameter of the text, as text")
    return p.parse_args(argv)


def relation(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    if a.query != "sql":
        if a.query not in catalogue.QUERIES:
            raise SystemExit(f"no query {a.query!r}; there are {', '.join(sorted(catalogue.QUERIES))}")
        return catalogue.QUERIES[a.query](spark, a.source)
    for name in a.table:
        spark.read.parquet(f"{a.source}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(a.sql, args=dict(x.split("=", 1) for x in a.param))


def main(argv: list[str] | None = None) -> None:
    a = arguments(argv)
    spark = SparkSession.builder.appName(f"metricloom {a.query}").getOrCreate()
    df = relation(spark, a)
    if a.format == "csv":
        write_csv_file(df, a.out, *a.order)
    elif a.format == "json":
        write_json_array(df, a.out, *a.order)
    else:
        df.write.mode("overwrite").parquet(a.out)
    spark.stop()


if __name__ == "__main__":
    main()
