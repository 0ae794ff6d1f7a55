"""Sinks: CSV, one folder for each key tuple, JSON records and one nested object, Parquet parameters (with their scan)."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Texts keep blanks at their ends, doubled quotes are the only escape, and lines end in \n.
_CSV = {"header": True, "escape": '"', "lineSep": "\n", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


#: Files of keys that a task keeps open at a time; a writer of CSV holds little, one of Parquet a block of columns.
OPEN = {"csv": 64, "parquet": 8}


@contextmanager
def _open_files(spark: SparkSession, kind: str) -> Iterator[None]:
    """Rows go to the file of their key as they come; only those of keys beyond the open files are sorted by a task."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, OPEN[kind])
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _kept(df: DataFrame, *keys: str) -> DataFrame:
    """df, but nulls of an only column (beside the keys) as empty texts: a line of nothing is no row to any reader."""
    only = [c for c in df.columns if c not in keys]
    return df.withColumn(only[0], F.coalesce(F.col(f"`{only[0]}`").cast("string"), F.lit(""))) if len(only) == 1 else df


def write_csv(df: DataFrame, path: str) -> None:
    """Arrays, maps and structs go out as JSON text; there is no byte order mark.

    Null is nothing between commas, an empty text two quotes; ``scan_csv``
    with ``exact`` reads back every text, but for the nulls of an only column,
    which are written as empty texts.
    """
    nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
    _kept(df.withColumns({c: F.to_json(c) for c in nested})).write.mode("overwrite").options(**_CSV).csv(path)


def write_partitioned(df: DataFrame, path: str, *keys: str) -> None:
    """A folder for each key tuple: of one file, or of several where the key's shuffle partition is too large for one task."""
    with _open_files(df.sparkSession, "csv"):
        _kept(df, *keys).hint("rebalance", *keys).write.mode("overwrite").partitionBy(*keys).options(**_CSV).csv(path)


def _rounded(c: Column, kind: T.DataType, decimals: int) -> Column:
    """c with every double in it rounded, also within structs, arrays and maps."""
    if isinstance(kind, T.DoubleType):
        return F.round(c, decimals)
    if isinstance(kind, T.StructType):
        inner = F.struct(*[_rounded(c[f.name], f.dataType, decimals).alias(f.name) for f in kind.fields])
        return F.when(c.isNotNull(), inner)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _rounded(x, kind.elementType, decimals))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: _rounded(v, kind.valueType, decimals))
    return c


def write_json(df: DataFrame, path: str, decimals: int | None = None) -> None:
    """JSON lines; doubles at any depth rounded to the given decimals."""
    if decimals is not None:
        df = df.select(*[_rounded(F.col(f"`{f.name}`"), f.dataType, decimals).alias(f.name) for f in df.schema.fields])
    df.write.mode("overwrite").json(path)


def write_report(df: DataFrame, path: str) -> None:
    """The one row of df as one nested JSON object, nulls written out."""
    df.limit(1).coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_params(df: DataFrame, path: str, *keys: str) -> None:
    """Fitted parameters as rows, a folder for each key, so that a reader of one curve reads its files only."""
    writer = df.hint("rebalance", *keys).write.partitionBy(*keys) if keys else df.write
    with _open_files(df.sparkSession, "parquet"):
        writer.mode("overwrite").parquet(path)


def scan_params(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What ``write_params`` wrote, with types as named (keys in folder names have none of their own)."""
    return spark.read.schema(schema).parquet(path)
