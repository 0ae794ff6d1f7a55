"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that a task works on at a time; a longer text is one chunk of its own.
CHUNK_CHARS = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only a local session without one (tests on one machine) gets a temporary folder.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    if named and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named or sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fold(doc_id: str | Column, k: int) -> Column:
    """crc32 of the id's decimal text, modulo k; null ids have null folds."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")) % k


def thinned(df: DataFrame, n: int, most: int, *keys: str) -> DataFrame:
    """About ``most`` of the ``n`` rows of df, picked by a hash of the keys."""
    if n <= most:
        return df
    return df.where(F.pmod(F.xxhash64(*keys), F.lit(1_000_003)) < int(1_000_003 * most / n))


def slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of a batch with at most ``limit`` bytes of text (or one row), with their texts; null reads as empty."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    at = 0
    while at < len(sizes):
        to, total = at, 0
        while to < len(sizes) and (to == at or total + sizes[to] <= limit):
            total += sizes[to]
            to += 1
        part = batch.slice(at, to - at)
        yield part, [x or "" for x in part.column(column).to_pylist()]
        at = to


def map_texts(df: DataFrame, work: Callable[[], Callable[[pa.RecordBatch, list[str]], pa.RecordBatch | None]], schema: str, column: str = "text") -> DataFrame:
    """Apply a function to parts of df's Arrow batches.

    ``work()`` runs once in each task and returns the function, so that what
    is costly to set up (tables, tokenizers) is set up once a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = None
        for batch in batches:
            each = each or work()
            for part, texts in slices(batch, column):
                out = each(part, texts)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    return batch.set_column(batch.schema.get_field_index(name), pa.field(name, values.type), values)


def wider(schema: T.StructType, **more: str) -> T.StructType:
    """A copy of the schema with further nullable columns, given as name and type."""
    return T.StructType([*schema.fields, *[T.StructField(k, T._parse_datatype_string(v)) for k, v in more.items()]])


def fresh(df: DataFrame, prefix: str) -> str:
    """The prefix, lengthened until no column of df starts with it."""
    while any(c.lower().startswith(prefix.lower()) for c in df.columns):
        prefix += "_"
    return prefix
