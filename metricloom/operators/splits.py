"""Seeded splits: by row, by group, and nested training prefixes.

Orders come from md5 of the seed and the key, so they do not depend on
partitions and any engine can repeat them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.operators.ordering import dense_id, sum_before


def shuffled(seed: Column, key: Column) -> Column:
    return F.md5(F.concat_ws("|", seed.cast("string"), key.cast("string")))


def random_split(df: DataFrame, key: str, seeds: list[int], test: float = 0.2, val: float = 0.1) -> DataFrame:
    """(seed, key, pos, split_role): floor(test n) rows, then floor(val n), then the training pool; pos counts within the pool.

    Seeds are numbered together, as one sorted order; each has n rows of it.
    """
    n = df.count()
    n_test, n_val = int(n * test), int(n * val)
    rows = df.select(key).withColumn("seed", F.explode(F.array(*[F.lit(s) for s in sorted(set(seeds))])))
    rows = dense_id(rows.withColumn("h_", shuffled(F.col("seed"), F.col(key))), "seed", "h_", key, name="id_")
    rows = rows.withColumn("rn", F.col("id_") % max(n, 1) + 1)
    role = F.when(F.col("rn") <= n_test, "test").when(F.col("rn") <= n_test + n_val, "val").otherwise("train")
    return rows.select("seed", key, (F.col("rn") - n_test - n_val).cast("long").alias("pos"), role.alias("split_role"))


def nested_prefixes(pool: DataFrame, sizes: list[int]) -> DataFrame:
    """Each training row once for every size whose prefix of the pool holds it."""
    reach = F.filter(F.array(*[F.lit(s) for s in sizes]), lambda s: F.col("pos") <= s)
    return pool.where("split_role = 'train'").select("*", F.explode(reach).alias("target_train_size"))


def groups(df: DataFrame, key: str, member: str) -> DataFrame:
    """Groups with their size, first and last member; a group may hold most rows, so members are not gathered in a list."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("size"), F.min(member).alias("first_id"), F.max(member).alias("last_id"))


def group_members(df: DataFrame, key: str, member: str) -> DataFrame:
    """(key, member, size): the groups' members, a row each."""
    rows = df.where(F.col(key).isNotNull()).select(key, member)
    return rows.join(rows.groupBy(key).agg(F.count(F.lit(1)).alias("size")), key)


def group_split(sizes: DataFrame, key: str, seed: int, cap: int) -> DataFrame:
    """Whole groups to train while fewer than ``cap`` rows are there, then to val up to a third of the rest, then to test.

    The greedy fill equals a running sum before each group.  sizes holds one
    row (key, size) for each group.
    """
    rows = sizes.select(key, "size", shuffled(F.lit(seed), F.col(key)).alias("h_"), shuffled(F.lit(seed + 1), F.col(key)).alias("g_"))
    filled = sum_before(rows, "size", F.desc("size"), "h_", key, name="before_")
    train = filled.where(F.col("before_") < cap).select(key, "size", F.lit("train").alias("split_role"))
    rest = filled.where(F.col("before_") >= cap)
    target = round((rest.agg(F.sum("size")).first()[0] or 0) / 3)
    rest = sum_before(rest.select(key, "size", "g_"), "size", "g_", key, name="seen_")
    return train.unionByName(rest.select(key, "size", F.when(F.col("seen_") < target, "val").otherwise("test").alias("split_role")))


def group_pool(members: DataFrame, roles: DataFrame, key: str, member: str, seed: int) -> DataFrame:
    """(member, split_role, pos): every row of ``members`` with its group's role and its place, from 1, in the shuffled rows of that role.

    Places come from one sorted order of all rows (role, md5 of seed and
    member, member), so no task holds a role or a group.  Rows of null groups
    have no role and go.
    """
    # a role's rows follow each other in the order, so a place within it is the number less that of the role's first row
    rows = members.select(key, member).join(roles.select(key, "split_role"), key).withColumn("h_", shuffled(F.lit(seed), F.col(member)))
    rows = dense_id(rows.select(member, "split_role", "h_"), "split_role", "h_", member, name="id_")
    first = rows.groupBy("split_role").agg(F.min("id_").alias("first_"))
    return rows.join(F.broadcast(first), "split_role").select(member, "split_role", (F.col("id_") - F.col("first_") + 1).alias("pos"))  # a row for each role
