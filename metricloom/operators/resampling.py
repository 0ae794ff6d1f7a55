"""A bootstrap over tables of any size: all draws are accumulated at once.

Every (cluster, draw) gets a Poisson(1) weight from a hash of its key and the
draw, so weights do not depend on partitions or order and any engine can
repeat them.  Rows are summed by cluster before the shuffle that spreads
clusters over the tasks, where all groups of a key share its weights.  A task keeps a sum of weights and of weighted values
for each group and draw, and sends groups x draws of them, whatever the number
of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The modulus of the hash: a prime, so that x -> x ** 5 has no two equal results (5 does not divide PRIME - 1).
PRIME = (1 << 31) - 1
#: Distribution function of Poisson(1) at 0, 1, ...; beyond the last the weight is 9, with a chance of about 1e-7.
LEVELS = [int(PRIME * x) for x in (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.999998874797402)]
#: Weights that are made at a time (their arrays stay small enough to be reused by the allocator), and groups that a task holds before it sends them on.
BLOCK, HELD = 131_072, 256
#: Bits of the lower half of a hash, and levels that are compared for all weights (beyond them, for about one in 270).
HALF, DENSE = 16, 4


def folded(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME up to PRIME itself, in place: 2 ** 31 is 1, so the upper bits add to the lower ones; faster than a division."""
    for _ in range(2):
        upper = x >> 31
        x &= PRIME
        x += upper
    return x


def fifth(x: np.ndarray) -> np.ndarray:
    square = folded(x * x)
    square *= square
    square = folded(square)
    square *= x
    return folded(square)


def offsets(draws: np.ndarray) -> np.ndarray:
    return fifth((draws.astype(np.int64) * 48271 + 1) % PRIME) % PRIME


def _powers(x: np.ndarray) -> list[np.ndarray]:
    """x ** 0 to x ** 5 modulo PRIME, of whole numbers from 0 to PRIME - 1."""
    out = [np.ones_like(x)]
    for _ in range(5):
        out.append(out[-1] * x % PRIME)
    return out


def _centred(x: np.ndarray, modulus: int) -> np.ndarray:
    """x modulo an even or odd modulus, as a number of least size."""
    return (x + modulus // 2) % modulus - modulus // 2


def of_draws(offset: np.ndarray) -> np.ndarray:
    """What ``weights`` needs of the draws: by the binomial theorem (own + offset) ** 5 is a sum over powers of own, here its factors, for upper and lower halves of the powers."""
    powers = _powers(offset)
    factors = [c * powers[5 - i] % PRIME for i, c in enumerate((1, 5, 10, 10, 5, 1))]
    rows = [_centred(f * h % PRIME, PRIME) for f in factors[1:] for h in (1 << HALF, 1)]
    # half a unit keeps quotients by PRIME off whole numbers
    return np.stack([*rows, _centred(factors[0], PRIME) + 0.5]).astype(float)


def weights(keys: np.ndarray, offset: np.ndarray, seed: int, factors: np.ndarray | None = None) -> np.ndarray:
    """(keys x draws) Poisson(1) weights of whole-numbered keys; a draw shifts the hashed keys by its offset before they are hashed again.

    The hash is a product of matrices of whole numbers under 2 ** 50, which
    doubles hold exactly.  Its remainder by PRIME is only compared: parts of
    quotients are 2 ** -32 or more away from each level and their error is
    under 2 ** -34.  ``factors`` is ``of_draws(offset)``, if at hand.
    """
    own = fifth((keys.astype(np.int64) % PRIME + seed) % PRIME) % PRIME
    halves = []
    for power in _powers(own)[1:]:
        lower = _centred(power, 1 << HALF)
        halves += [(power - lower) >> HALF, lower]
    x = np.stack([*halves, np.ones_like(own)], axis=1).astype(float) @ (of_draws(offset) if factors is None else factors)
    x *= 1 / PRIME
    x -= np.floor(x)
    out = (x >= LEVELS[0] / PRIME).view(np.int8)
    for level in LEVELS[1:DENSE]:
        out += (x >= level / PRIME).view(np.int8)
    rare = np.flatnonzero(x >= LEVELS[DENSE] / PRIME)
    out.ravel()[rare] = DENSE + np.searchsorted(np.array(LEVELS[DENSE:]) / PRIME, x.ravel()[rare], side="right")
    return out.astype(float)


def poisson_bootstrap(df: DataFrame, value: str, key: str, *groups: str, draws: int = 2000, seed: int = 1) -> DataFrame:
    """(groups, draw, weight, mean): the weighted mean of each group in each draw; null where all weights are 0.

    ``key`` is a whole number that names what is drawn: rows that share it are
    drawn together (a cluster bootstrap).  Rows with a null value, a NaN or a
    null key do not count; null groups are a group.  A group has a row for
    each draw.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value) & F.col(key).isNotNull()).select(*groups, F.col(key).cast("long").alias("key_"), F.col(value).cast("double").alias("value_"))
    names = [f"g{i}_" for i in range(len(groups))]
    rows = rows.withColumnsRenamed(dict(zip(groups, names, strict=True)))
    # a key is weighted once for all groups; its weights cost far more than a row of a shuffle or sort, so keys are spread over all tasks
    rows = rows.groupBy(*names, "key_").agg(F.sum("value_").alias("total_"), F.count("value_").alias("count_"))
    rows = rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key_").sortWithinPartitions("key_")
    kinds = [rows.schema[n].dataType for n in names]
    schema = ", ".join([*[f"{n} {k.simpleString()}" for n, k in zip(names, kinds, strict=True)], "w array<double>", "s array<double>"])
    offset = offsets(np.arange(draws))
    factors = of_draws(offset)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        kept: list[pa.Schema] = []

        def sent() -> pa.RecordBatch:
            columns = [pa.array([g[i] for g in held], kept[0].field(n).type) for i, n in enumerate(names)]
            sums = [pa.array([x[i].tolist() for x in held.values()], pa.list_(pa.float64())) for i in (0, 1)]
            return pa.RecordBatch.from_arrays([*columns, *sums], [*names, "w", "s"])

        for batch in batches:
            kept[:] = [batch.schema]
            if not batch.num_rows:
                continue
            of = list(zip(*[batch[n].to_pylist() for n in names], strict=True)) if names else [()] * batch.num_rows
            places = {g: i for i, g in enumerate(dict.fromkeys(of))}
            group = np.array([places[g] for g in of])
            total, count, keys = (batch[c].to_numpy(zero_copy_only=False) for c in ("total_", "count_", "key_"))
            order = np.argsort(keys, kind="stable")
            group, total, count, keys = (x[order] for x in (group, total, count, keys))
            fresh = np.append(True, keys[1:] != keys[:-1])
            first, place = np.flatnonzero(fresh), np.cumsum(fresh) - 1
            known, step = list(places), max(BLOCK // max(draws, 1), 1)
            for i in range(0, len(first), step):
                mine = first[i : i + step]
                w = weights(keys[mine], offset, seed, factors)
                low, high = mine[0], first[i + step] if i + step < len(first) else len(keys)
                here, of_group = np.unique(group[low:high], return_inverse=True)
                for j in range(0, len(here), HELD):
                    # the counts and values of each group of the block, by key: all groups share the weights
                    at = low + np.flatnonzero((of_group >= j) & (of_group < j + HELD))
                    some = here[j : j + HELD]
                    spread = np.zeros((2, len(some), len(mine)))
                    for k, x in enumerate((count, total)):
                        np.add.at(spread[k], (of_group[at - low] - j, place[at] - i), x[at])
                    got = (spread.reshape(-1, len(mine)) @ w).reshape(2, len(some), draws)
                    for k, g in enumerate(some):
                        sums = held.setdefault(known[g], np.zeros((2, draws)))
                        sums += got[:, k]
                    if len(held) >= HELD:
                        yield sent()
                        held.clear()
        if held:
            yield sent()

    parts = rows.mapInArrow(work, schema)
    each = parts.select(*names, F.posexplode(F.arrays_zip("w", "s")).alias("draw", "x")).groupBy(*names, "draw").agg(F.sum("x.w").alias("weight"), F.sum("x.s").alias("s_"))
    return each.select(*[F.col(n).alias(g) for n, g in zip(names, groups, strict=True)], "draw", "weight", F.try_divide("s_", "weight").alias("mean"))


def weights_sql(source: str, key: str, draws: int, seed: int = 1) -> str:
    """Common table expressions that end in weighted: the rows of ``source`` for each draw, with their weight w, in SQL over 64-bit integers."""
    p = PRIME
    five = lambda x: f"({x} * {x} % {p}) * ({x} * {x} % {p}) % {p} * {x} % {p}"
    level = " + ".join(f"(x >= {v})::INTEGER" for v in LEVELS)
    return f"""h0 AS (SELECT *, (CAST({key} AS BIGINT) % {p} + {seed}) % {p} AS x FROM {source}), h1 AS (SELECT * EXCLUDE (x), {five("x")} AS own FROM h0),
 d0 AS (SELECT draw, (draw * 48271 + 1) % {p} AS x FROM range({draws}) r(draw)), d1 AS (SELECT draw, {five("x")} AS shift FROM d0),
 h2 AS (SELECT *, (own + shift) % {p} AS x FROM h1, d1), h3 AS (SELECT * EXCLUDE (x, own, shift), {five("x")} AS x FROM h2), weighted AS (SELECT * EXCLUDE (x), {level} AS w FROM h3)"""
