"""Scans: explicit schemas, missing numbers as nulls, records from JSON and constants."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from metricloom.operators.ordering import checkpointed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan_csv(spark: SparkSession, path: str, schema: str, exact: bool = False) -> DataFrame:
    """CSV with a header; a byte order mark, CRLF and doubled quotes are read as meant, NaN as null.

    An empty text in quotes is null too, and line breaks in texts become
    those of the file.  With ``exact`` lines end in \n, as the library's own
    sinks write them, and every text is read as written, empty ones too.
    """
    # a missing text is the null value, so one that no text has keeps empty texts apart from it
    kept = {"lineSep": "\n", "nullValue": "\0"} if exact else {}
    df = spark.read.schema(schema).options(**kept).csv(path, header=True, escape='"', multiLine=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return nan_to_null(df)


def scan_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object, or an array of records."""
    return spark.read.schema(schema).json(path, multiLine=True)


def nan_to_null(df: DataFrame) -> DataFrame:
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None)) for c in doubles})


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def optional_column(df: DataFrame, name: str, kind: str = "double") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def constants(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small inline relation; callers may broadcast it, its size is written in the code."""
    return spark.createDataFrame(rows, schema)


def require_complete(grid: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """rows, if they have every key of the grid; else an error at once that names some of the gaps, by a job of its own."""
    gaps = grid.join(rows.select(*keys).distinct(), list(keys), "left_anti").limit(5).collect()
    if gaps:
        raise ValueError(f"no rows for {', '.join(str(tuple(g)) for g in gaps)}")
    return rows


def complete(grid: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """rows, if they have every key of the grid; else the job that reads them fails with an error that names a gap.

    The check is part of the plan: rows are read once.  Null keys are equal
    to null ones; rows that repeat and rows outside the grid stay.
    """
    names = {k: f"{k}_of_grid" for k in keys}
    want = grid.select(*[F.col(k).alias(n) for k, n in names.items()]).distinct()
    on = functools.reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    both = rows.withColumn("there_", F.lit(True)).join(want, on, "full")
    gap = F.concat(F.lit("no rows for ("), F.concat_ws(", ", *[F.coalesce(F.col(n).cast("string"), F.lit("null")) for n in names.values()]), F.lit(")"))
    return both.where(F.when(F.col("there_").isNull(), F.raise_error(gap).cast("boolean")).otherwise(True)).select(*rows.columns)


def watched(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """df, and counts of its rows, nulls and NaN by column (``rows``, ``null_x``, ``nan_x``), known when an action has read it: no job of their own."""
    seen = Observation(name)
    counts = [F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"null_{c}") for c in df.columns]]
    counts += [F.count_if(F.isnan(f"`{f.name}`")).alias(f"nan_{f.name}") for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.observe(seen, *counts), seen


def json_paths(df: DataFrame, column: str) -> DataFrame:
    """(path, type, n): how often each path of a column of JSON texts holds a value of each type.

    The keys need not be known ahead: texts are parsed to variants and opened
    level by level, as deep as they go.  Elements of an array share the path
    ``[*]``.  Types are OBJECT, ARRAY, BIGINT, DECIMAL, DOUBLE, STRING,
    BOOLEAN and VOID (a JSON null); a text that is not JSON counts as INVALID
    at ``$``; null texts do not count.
    """
    level = df.where(F.col(column).isNotNull()).select(F.lit("$").alias("path"), F.try_parse_json(column).alias("v"))
    out = None
    while True:
        kind = F.coalesce(F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0), F.lit("INVALID"))
        level = checkpointed(level.withColumn("type", kind)) if out is not None else level.withColumn("type", kind)
        counts = checkpointed(level.groupBy("path", "type").agg(F.count(F.lit(1)).alias("n")))
        out = counts if out is None else out.unionByName(counts)
        if counts.where("type IN ('OBJECT', 'ARRAY')").isEmpty():
            return out
        inner = level.where("type IN ('OBJECT', 'ARRAY')")
        opened = inner.lateralJoin(inner.sparkSession.tvf.variant_explode(F.col("v").outer()).select(F.col("key").alias("key_"), F.col("value").alias("value_")))
        step = F.when(F.col("type") == "ARRAY", F.lit("[*]")).otherwise(F.concat(F.lit("."), F.col("key_")))
        level = opened.select(F.concat("path", step).alias("path"), F.col("value_").alias("v"))


def geomspace(spark: SparkSession, low: float, high: float, n: int) -> DataFrame:
    """(i, x): n points from low to high with equal ratios."""
    return spark.range(n).select(F.col("id").alias("i"), (low * F.pow(F.lit(high / low), F.col("id") / (n - 1))).alias("x"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of each (method_id, split, train_size, seed), from line items and their customers' segments: a few hundred rows at any scale.

    Line items are dealt once, cut to what the keys and errors need; orders
    find their segments before.  What reads the rows more than once should
    keep them in a checkpoint.
    """
    line = table(spark, sf_dir, "lineitem").where("l_shipdate >= timestamp_ntz'1995-01-01' AND l_shipdate < timestamp_ntz'2002-01-01'")
    line = line.select(
        "l_orderkey",
        F.coalesce(F.col("l_linestatus") == "F", F.lit(False)).alias("random_"),
        F.year("l_shipdate").alias("train_size"),
        (11 * (1 + F.col("l_suppkey") % 5)).cast("int").alias("seed"),
        (F.col("l_discount") - F.col("l_tax")).alias("e"),
        "l_tax",
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("method_id"))
    segments = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "method_id")
    rows = line.join(segments, F.col("l_orderkey") == F.col("o_orderkey"))
    keys = ["method_id", F.when(F.col("random_"), "random").otherwise("scaffold").alias("split"), "train_size", "seed"]
    return rows.groupBy(*keys).agg(
        F.avg(F.abs("e")).alias("mae"),
        F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"),
        (1 - F.try_divide(F.sum(F.col("e") * F.col("e")), F.var_pop("l_tax") * F.count(F.lit(1)))).alias("r2"),
    ).withColumn("status", F.lit("ok"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, x, y, n, n_y): mean balance of a nation's customers against its suppliers'."""
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.avg("c_acctbal").alias("x"), F.count(F.lit(1)).alias("n"))
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.avg("s_acctbal").alias("y"), F.count(F.lit(1)).alias("n_y"))
    return c.join(s, "k")
