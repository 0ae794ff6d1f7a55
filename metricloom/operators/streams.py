"""The draws of one serial random stream, made in any number of tasks.

NumPy's default generator is PCG64: a 128-bit state x -> a x + c, from which
each step gives 64 bits, used as two words of 32, the low one first.  The
state can be jumped ahead, so a task goes straight to its own words.  A draw
below n takes the upper half of word x n and passes over words whose lower
half is under 2 ** 32 mod n (Lemire's rule).  Whether a word is passed over
depends on that word alone, so the draws are the accepted words in order:
tasks count theirs, the counts before a slice are summed, and a second pass
numbers the draws.  They equal those of ``default_rng(seed).integers(0, n)``
called in turn, whatever the number of slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words that a task makes at a time.
CHUNK = 1 << 16
#: Words of a slice, an even number.
SLICE = 1 << 20


def accepted(seed: int, n: int, first: int, last: int) -> Iterator[np.ndarray]:
    """The draws below n from words first (even) to last of the stream, in chunks."""
    bits = np.random.PCG64(seed).advance(first // 2)
    least = (1 << 32) % n
    for at in range(first, last, CHUNK):
        words = min(CHUNK, last - at)
        m = bits.random_raw((words + 1) // 2).astype("<u8").view("<u4")[:words].astype(np.uint64) * np.uint64(n)
        kept = m if not least else m[(m & np.uint64(0xFFFFFFFF)) >= least]
        yield (kept >> np.uint64(32)).astype(np.int64)


def _slices(spark: SparkSession, words: int, size: int) -> DataFrame:
    """(id, first, last): the slices of so many words, one in each task."""
    n = max(-(-words // size), 1)
    rows = spark.range(0, n, 1, n)
    return rows.select("id", (F.col("id") * size).alias("first"), F.least((F.col("id") + 1) * size, F.lit(words)).alias("last"))


def draws(spark: SparkSession, seed: int, n: int, count: int, slice_words: int = SLICE) -> DataFrame:
    """(pos, pick): the first ``count`` draws below n, numbered from 0.

    n is from 1 to 2 ** 32 - 1; without draws or for n = 1 the picks are none
    or all 0, and n = 1 takes no word of the stream, as in NumPy.
    """
    if not 0 < n < 1 << 32 or count < 0:
        raise ValueError(f"cannot draw {count} numbers below {n}")
    if n == 1 or not count:
        return spark.range(count).select(F.col("id").alias("pos"), F.lit(0).cast("long").alias("pick"))
    size = slice_words + slice_words % 2

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [sum(map(len, accepted(seed, n, lo, hi))) for lo, hi in zip(b["first"].to_pylist(), b["last"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b["id"], b["first"], b["last"], pa.array(got, pa.int64())], ["id", "first", "last", "got"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, at in zip(b["first"].to_pylist(), b["last"].to_pylist(), b["base"].to_pylist(), strict=True):
                for picks in accepted(seed, n, lo, hi):
                    picks = picks[: max(count - at, 0)]
                    if len(picks):
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(picks))), pa.array(picks)], ["pos", "pick"])
                    at += len(picks)

    share = 1 - ((1 << 32) % n) / (1 << 32)
    words = int(count / share) + 8 * int((count * (1 - share)) ** 0.5) + 64
    while True:
        tallied = _slices(spark, words, size).mapInArrow(tally, "id long, first long, last long, got long")
        # one row for each slice of a million words
        based = tallied.withColumn("base", F.coalesce(F.sum("got").over(Window.orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        if (tallied.agg(F.sum("got")).first()[0] or 0) >= count:
            break
        words *= 2
    return based.repartition(max(-(-words // size), 1), "id").mapInArrow(number, "pos long, pick long")


#: The multiplier of PCG64 (a fixed value of the published generator).
MULTIPLIER = 0x2360ED051FC65DA44385DF649FCCF645


def jumps(seed: int, steps: int) -> tuple[int, list[tuple[int, int]]]:
    """The state before the first word, and (a, c) of a jump by 2 ** k states for each k below ``steps``."""
    state = np.random.PCG64(seed).state["state"]
    a, c, out = MULTIPLIER, state["inc"], []
    for _ in range(steps):
        out.append((a, c))
        a, c = a * a % (1 << 128), (a + 1) * c % (1 << 128)
    return state["state"], out


def draws_sql(seed: int, n: int, words: int) -> str:
    """Common table expressions that end in picks(pos, pick), the accepted draws below n of so many words, in ANSI SQL with 128-bit integers.

    A recursion of about log2(words) rounds halves the distance between known
    states; numbers of 128 bits are kept as two halves.
    """
    depth = max((max(words + 1, 2) // 2 - 1).bit_length(), 1)
    state, steps = jumps(seed, depth)
    two = lambda x: f"{x >> 64}::UHUGEINT, {x & (1 << 64) - 1}::UHUGEINT"
    one = f"{1 << 64}::UHUGEINT"
    first = (state * MULTIPLIER + steps[0][1]) % (1 << 128)  # a step comes before each output
    table = ", ".join(f"({depth - 1 - k}, {1 << k}, {two(a)}, {two(c)})" for k, (a, c) in enumerate(steps))
    return f"""jump(level, far, ah, al, ch, cl) AS (VALUES {table}),
 states(level, k, hi, lo) AS (SELECT 0, 0::BIGINT, {two(first)} UNION ALL
  SELECT s.level + 1, k + side * far, CASE WHEN side = 0 THEN hi ELSE (((lo * al) // {one}) + (hi * al) % {one} + (lo * ah) % {one} + ch + (((lo * al) % {one} + cl) // {one})) % {one} END,
   CASE WHEN side = 0 THEN lo ELSE ((lo * al) % {one} + cl) % {one} END
  FROM states s JOIN jump ON jump.level = s.level, (VALUES (0), (1)) v(side) WHERE s.level < {depth}),
 mixed AS (SELECT k, xor(hi::UBIGINT, lo::UBIGINT)::UHUGEINT AS x, hi // {1 << 58}::UHUGEINT AS turn FROM states WHERE level = {depth} AND k < {(words + 1) // 2}),
 outputs AS (SELECT k, CASE WHEN turn = 0 THEN x ELSE x // (1::UHUGEINT << turn) + x * (1::UHUGEINT << (64 - turn)) % {one} END AS u FROM mixed),
 words AS (SELECT 2 * k AS w, (u % {1 << 32}::UHUGEINT)::BIGINT AS v FROM outputs UNION ALL SELECT 2 * k + 1, (u // {1 << 32}::UHUGEINT)::BIGINT FROM outputs),
 picks AS (SELECT row_number() OVER (ORDER BY w) - 1 AS pos, CAST(v::HUGEINT * {n} // {1 << 32} AS BIGINT) AS pick FROM words WHERE w < {words} AND v::HUGEINT * {n} % {1 << 32} >= {(1 << 32) % n})"""
