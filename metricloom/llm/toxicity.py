"""Toxicity scores from class-conditional Kneser-Ney models.

Two models of characters, one of toxic and one of ordinary text, give the
last of four characters its probability after the first three.  Each is
interpolated Kneser-Ney: what a class has not seen falls back to shared
lower orders, built from continuation counts over both classes, so rare
expressions weigh the same on both sides and cancel out.  What is compared is
the difference of the two log-likelihoods divided by the length: of the whole
text, and of its windows of WINDOW characters, of which the most toxic ones and
the share of toxic ones count, for a few words of abuse drown in a long text's
mean.  A logistic curve turns these statistics into a score.  It is fitted on
all labelled rows outside the held-out fold, each with statistics from models
that lack the row's own part of them (FOLDS parts); the models that score have
the counts of all parts.

Counts come from every labelled row outside the held-out fold, by shuffles
of 4-gram counts that grow with the labelled text.  Only the evaluated
differences travel to the tasks, in two hashed arrays of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metricloom.llm.codes import alnum, encode, mix
from metricloom.llm.common import checkpointed, fold, map_texts, slices

ORDER = 4
CHAR = 12  # bits of a folded character
FOLD_BIT = ORDER * CHAR  # where a key tells its fold while it is counted
SLOTS = 21  # bits of the array of n-grams, contexts have one less
DISCOUNT = 0.9
FLUSH = 1 << 20
FOLDS = 3
WINDOW, STEP = 8, 4  # characters
HIGH = 3.0  # the log-likelihood difference of a toxic window
TOPS = (1, 4, 10)  # windows whose mean is a statistic
#: Labels up to this number are broadcast to the texts; more are joined by a shuffle.
BROADCAST_LABELS = 2_000_000


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Four folded characters as one key, and the text that each belongs to.

    Runs of other characters than letters and digits are one space; a text
    starts with three spaces and ends with one.
    """
    codes, starts, ends = encode([" " + x for x in texts])
    letters = alnum(codes)
    keep = letters | np.concatenate(([True], letters[:-1]))  # the first of each run of others
    row = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(np.append(starts, len(codes)))) if len(texts) else np.zeros(0, np.int32)
    folded = np.where(letters, (codes ^ (codes >> np.uint32(CHAR))) & np.uint32((1 << CHAR) - 1), 0).astype(np.uint64)[keep]
    row = row[keep]
    key, first = np.zeros(len(folded), np.int64), np.ones(len(row), bool)
    first[1:] = row[1:] != row[:-1]
    since = np.arange(len(row)) - np.maximum.accumulate(np.where(first, np.arange(len(row)), 0))
    for back in range(ORDER):  # characters of the text before count as spaces
        moved = np.zeros(len(folded), np.uint64)
        moved[back:] = folded[: len(folded) - back] if back else folded
        moved[since < back] = 0
        key |= (moved << np.uint64(CHAR * back)).astype(np.int64)
    drop = first & (key == 0)
    return key[~drop], row[~drop]


def slot(key: np.ndarray, bits: int) -> np.ndarray:
    return (mix(key.astype(np.uint64) + np.uint64(0xA5)) >> np.uint64(64 - bits)).astype(np.int64)


def count_ngrams(labelled: DataFrame) -> DataFrame:
    """(fold, key, ct, co): how often each 4-gram stands in toxic and ordinary rows of each fold of (text, label, fold)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def merged() -> list[np.ndarray]:
            key, ct, co = (np.concatenate(x) for x in zip(*held, strict=True))
            unique, at = np.unique(key, return_inverse=True)
            return [unique, np.bincount(at, ct).astype(np.int64), np.bincount(at, co).astype(np.int64)]

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["key", "ct", "co"])

        for batch in batches:
            for part, texts in slices(batch, "text"):
                label, part_of = (np.array(part.column(c).to_pylist(), np.int64) for c in ("label", "fold"))
                key, row = ngrams(texts)
                key |= part_of[row] << FOLD_BIT
                toxic = label[row] == 1
                unique, at = np.unique(key, return_inverse=True)
                ct = np.bincount(at[toxic], minlength=len(unique))
                held.append([unique, ct, np.bincount(at, minlength=len(unique)) - ct])
                if len(held) >= 32:
                    held = [merged()]
                    if len(held[0][0]) >= FLUSH:
                        yield out()
                        held = []
        if held:
            held = [merged()]
            yield out()

    parts = labelled.select("text", "label", "fold").mapInArrow(run, "key long, ct long, co long")
    sums = parts.groupBy("key").agg(F.sum("ct").alias("ct"), F.sum("co").alias("co"))
    return sums.select(F.shiftright("key", FOLD_BIT).alias("fold"), F.col("key").bitwiseAND((1 << FOLD_BIT) - 1).alias("key"), "ct", "co")


def without(counts: DataFrame, fold_: int | None = None) -> DataFrame:
    """(key, ct, co) over all folds but one."""
    kept = counts if fold_ is None else counts.where(F.col("fold") != fold_)
    return kept.groupBy("key").agg(F.sum("ct").alias("ct"), F.sum("co").alias("co"))


def _mask(n: int) -> int:
    return (1 << (CHAR * n)) - 1


def differences(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Log-probability differences of the n-grams, and those of unseen n-grams after each context.

    Shared orders: p3(w|2 before) and p2(w|1 before) from continuation
    counts, then equal shares of the characters.  The class models stand on
    p3.
    """
    d = DISCOUNT
    three = counts.groupBy(F.col("key").bitwiseAND(_mask(3)).alias("k3")).agg(F.count(F.lit(1)).alias("n3"))
    two = three.groupBy(F.col("k3").bitwiseAND(_mask(2)).alias("k2")).agg(F.count(F.lit(1)).alias("n2"))
    share = 1.0 / 256
    w2, w3, w4 = (Window.partitionBy(F.shiftright(k, CHAR)) for k in ("k2", "k3", "key"))
    p2 = two.select("k2", ((F.greatest(F.col("n2") - d, F.lit(0.0)) + d * F.count(F.lit(1)).over(w2) * share) / F.sum("n2").over(w2)).alias("p2"))
    three = three.withColumns({"k2": F.col("k3").bitwiseAND(_mask(2)), "all3": F.sum("n3").over(w3), "types3": F.count(F.lit(1)).over(w3)})
    p3 = three.join(p2, "k2").select("k3", ((F.greatest(F.col("n3") - d, F.lit(0.0)) + d * F.col("types3") * F.col("p2")) / F.col("all3")).alias("p3"))
    each = counts.withColumns({"k3": F.col("key").bitwiseAND(_mask(3)), "ht": F.sum("ct").over(w4), "ho": F.sum("co").over(w4), "tt": F.sum((F.col("ct") > 0).cast("long")).over(w4), "to": F.sum((F.col("co") > 0).cast("long")).over(w4)})

    def p(count: str, total: str, types: str):
        # a class that lacks the context has the shared probability
        return F.when(F.col(total) == 0, F.col("p3")).otherwise((F.greatest(F.col(count) - d, F.lit(0.0)) + d * F.col(types) * F.col("p3")) / F.greatest(F.col(total), F.lit(1)))

    def rest(total: str, types: str):
        return F.when(F.col(total) == 0, 1.0).otherwise(d * F.col(types) / F.greatest(F.col(total), F.lit(1)))

    seen = each.join(p3, "k3").select("key", (F.col("ct") + F.col("co")).alias("n"), F.log(p("ct", "ht", "tt") / p("co", "ho", "to")).alias("x"))
    contexts = each.groupBy(F.shiftright("key", CHAR).alias("key")).agg(F.max("ht").alias("ht"), F.max("ho").alias("ho"), F.max("tt").alias("tt"), F.max("to").alias("to"))
    contexts = contexts.select("key", (F.col("ht") + F.col("ho")).alias("n"), F.log(rest("ht", "tt") / rest("ho", "to")).alias("x"))
    return seen, contexts


def hashed(rows: DataFrame, bits: int) -> np.ndarray:
    """An array of 2**bits numbers: for each slot the mean of x, weighted by n; NaN where no key falls.

    What comes to the driver is at most one row for each slot.
    """

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column("n").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(slot(b.column("key").to_numpy(zero_copy_only=False), bits)), pa.array(n * b.column("x").to_numpy(zero_copy_only=False)), b.column("n")], ["slot", "nx", "n"])

    sums = rows.mapInArrow(slots, "slot long, nx double, n long").groupBy("slot").agg((F.sum("nx") / F.sum("n")).cast("float").alias("x")).toArrow()
    out = np.full(1 << bits, np.nan, np.float32)
    out[sums.column("slot").to_numpy()] = sums.column("x").to_numpy()
    return out


def statistics(tables: tuple[np.ndarray, np.ndarray], texts: list[str]) -> np.ndarray:
    """A row of STATISTICS for each text: the length-normalised difference of the log-likelihoods of the whole text, of its most toxic windows, the share of toxic windows, and the length."""
    key, row = ngrams(texts)
    x = tables[0][slot(key, SLOTS)]
    missing = np.flatnonzero(np.isnan(x))
    if len(missing):
        x[missing] = np.nan_to_num(tables[1][slot(key[missing] >> CHAR, SLOTS - 1)])
    n = np.bincount(row, minlength=len(texts))
    out = np.zeros((len(texts), STATISTICS))
    out[:, 0] = np.bincount(row, x, len(texts)) / np.maximum(n, 1)
    out[:, -1] = n
    first = np.cumsum(n) - n
    many = np.where(n > 0, np.maximum(n - WINDOW, 0) // STEP + 1, 0)  # a shorter text is one window
    of = np.repeat(np.arange(len(texts)), many)
    begin = first[of] + STEP * (np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many))
    sums = np.concatenate(([0.0], np.cumsum(x, dtype=np.float64)))
    value = sums[np.minimum(begin + WINDOW, (first + n)[of])] - sums[begin]
    order = np.lexsort((-value, of))
    rank = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    for i, top in enumerate(TOPS, 1):
        out[:, i] = np.bincount(of[rank < top], value[order][rank < top], len(texts)) / np.maximum(np.minimum(many, top), 1)
    out[:, len(TOPS) + 1] = np.bincount(of, value > HIGH, len(texts)) / np.maximum(many, 1)
    return out


STATISTICS = len(TOPS) + 3


def _inputs(x: np.ndarray) -> np.ndarray:
    mean = np.clip(x[:, 0], -0.5, 0.5) * 100
    return np.column_stack([np.ones(len(x)), mean, np.minimum(mean, 0), np.clip(x[:, 1:-2], -20, 20) / 4, np.minimum(x[:, -2], 0.5) * 20, np.log1p(x[:, -1]) - 7])


def logistic(rows: DataFrame, ridge: float = 1.0, steps: int = 50) -> np.ndarray | None:
    """The curve's weights from all rows of (x, label), by Newton steps; None without both labels.

    The two labels weigh the same in sum: toxic rows are rare, and 0.5 should
    be where a row is as likely under either model of the statistics.

    Each step is one pass in which a task sends a gradient and a curvature.
    """
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("toxic")).first()
    if not seen["n"] or not 0 < seen["toxic"] < seen["n"]:
        return None
    heavy = np.array([seen["n"] / (2 * (seen["n"] - seen["toxic"])), seen["n"] / (2 * seen["toxic"])])
    size = STATISTICS + 2
    w = np.zeros(size)
    for _ in range(steps):

        def sums(batches: Iterator[pa.RecordBatch], w: np.ndarray = w) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size * (size + 1))
            for b in batches:
                y = b.column("label").to_numpy(zero_copy_only=False)
                x = _inputs(b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, STATISTICS))
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                v = heavy[y.astype(int)]
                total += np.concatenate([x.T @ (v * (p - y)), ((x * (v * p * (1 - p))[:, None]).T @ x).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["sums"])

        total = np.sum([r["sums"] for r in rows.mapInArrow(sums, "sums array<double>").collect()], axis=0)
        step = np.linalg.solve(total[size:].reshape(size, size) + ridge * np.eye(size), total[:size] + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-10:
            break
    return np.round(w, 9)  # tasks add in different orders


def with_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, label) of the labelled rows outside the held-out fold, plus the fold that each calibrates in."""
    known = labels.where((fold("doc_id", 3) != 1) & F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").alias("label"), F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).alias("fold"))
    small = known.count() <= BROADCAST_LABELS
    return docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(known) if small else known, "doc_id")


def arrays(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    seen, contexts = differences(counts)
    return hashed(seen, SLOTS), hashed(contexts, SLOTS - 1)


def calibration(rows: DataFrame, tables: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(x, label): statistics of each row of (text, label)."""
    sent = rows.sparkSession.sparkContext.broadcast(tables)

    def work():
        known = sent.value

        def each(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
            x = statistics(known, texts)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * STATISTICS), pa.array(x.ravel()))
            return pa.RecordBatch.from_arrays([flat, batch.column("label")], ["x", "label"])

        return each

    return map_texts(rows.select("text", F.col("label").cast("int").alias("label")), work, "x array<double>, label int")


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """The curve from all labelled rows, each part of them with counts of the others; then the counts of all of them."""
    rows = with_labels(docs, labels)
    counts = checkpointed(count_ngrams(rows))
    points = None
    for k in range(FOLDS):
        seen = calibration(rows.where(F.col("fold") == k), arrays(without(counts, k)))
        points = seen if points is None else points.unionByName(seen)
    weights = logistic(checkpointed(points))
    return {"tables": arrays(without(counts)), "weights": np.array([-3.0, 1.0] + [0.0] * STATISTICS) if weights is None else weights}


def score(model: dict, texts: list[str]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_inputs(statistics(model["tables"], texts)) @ model["weights"], -30, 30)))


def rate(docs: DataFrame, model: dict, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs.

    Null and empty texts have length 0 and the score of a difference of 0.
    Repeated rows and null ids give a row each (held_out is null for a null
    id).  An empty table gives none.  Other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        known = sent.value

        def each(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
            s = score(known, texts)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

        return each

    rows = docs.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "text")
    return map_texts(rows, work, "doc_id long, held_out boolean, score double, predicted int")
