"""Numbers and running sums in a sorted order, without sorting in one task.

Rows are range-partitioned and sorted, so a place in the order is a partition
and a row in it.  Both are kept in a checkpoint: sampled range bounds and
coalesced partitions may differ between two runs of a plan.  A partition's
numbers are then shifted by those of the partitions before, one row for each
partition.  Order columns that hold a hot value need a tie-breaker behind it.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of the session's checkpoints, in ``spark.checkpoint.dir``; without that setting only a local session gets a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _placed(df: DataFrame, order: tuple[str | Column, ...]) -> DataFrame:
    """df with part_ and at_: the partition of the sorted rows, and the row's place in it from 0."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place_", F.monotonically_increasing_id())
    rows = checkpointed(rows)
    # the id holds the partition above 33 bits of the row's number
    return rows.withColumns({"part_": F.shiftright("place_", 33), "at_": F.col("place_").bitwiseAND((1 << 33) - 1)}).drop("place_")


def _base(per_part: DataFrame) -> DataFrame:
    """(part_, base_): the sum of n_ over the partitions before; per_part has one row for each partition."""
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(per_part.select("part_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("base_")))


def dense_id(df: DataFrame, *order: str | Column, name: str = "id") -> DataFrame:
    """Numbers from 0 in sorted order; ties get numbers in any order."""
    rows = _placed(df, order)
    sizes = rows.groupBy("part_").agg(F.count(F.lit(1)).alias("n_"))
    return rows.join(_base(sizes), "part_").withColumn(name, F.col("base_") + F.col("at_")).drop("part_", "at_", "base_")


def sum_before(df: DataFrame, value: str, *order: str | Column, name: str) -> DataFrame:
    """The sum of ``value`` over all rows before, 0 for the first."""
    rows = _placed(df, order)
    sums = rows.groupBy("part_").agg(F.sum(value).alias("n_"))
    within = Window.partitionBy("part_").orderBy("at_").rowsBetween(Window.unboundedPreceding, -1)
    inner = rows.withColumn(name, F.coalesce(F.sum(value).over(within), F.lit(0)))
    return inner.join(_base(sums), "part_").withColumn(name, F.col(name) + F.col("base_")).drop("part_", "at_", "base_")
