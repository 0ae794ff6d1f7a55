"""Quality classification with supervised subword embeddings.

Each word and each character n-gram of 3 to 5 characters (spaces and marks
included, case kept) hashes to a learned vector; a document is the mean of
its vectors, a softmax over two outputs gives the class.  Vectors and outputs
are trained together by stochastic gradient descent in numpy on a bounded
sample of labelled rows (``max_train``).  Scoring needs of each vector only
its part in the two outputs, so the trained model that travels to the tasks
is one number for each bucket: a fixed size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.codes import encode, mix, owners, words
from metricloom.llm.common import fold, map_texts, thinned

ORDERS = (3, 4, 5)
BUCKETS = 16  # bits
REPEATED = 1  # the bucket of a word that repeats the one before


def features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of (text number, bucket), ascending by text: the words, the pairs of words, then each order of n-grams."""
    codes, _, ends = encode(texts, lower=False)
    starts, stops, hashes = words(codes)
    word_of = owners(starts, ends)
    out = [(word_of, (mix(hashes + np.uint64(99)) >> np.uint64(64 - BUCKETS)).astype(np.int32))]
    # pairs of neighbouring words; a word that repeats the one before is one n-gram whatever the word
    pair = mix(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]) >> np.uint64(64 - BUCKETS)
    pair[hashes[:-1] == hashes[1:]] = REPEATED
    near = word_of[:-1] == word_of[1:]
    out.append((word_of[1:][near], pair[near].astype(np.int32)))
    sizes = np.diff(np.concatenate(([0], ends + (len(codes) - ends[-1])))) if len(ends) else ends
    row = np.repeat(np.arange(len(ends), dtype=np.int32), sizes)
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        shifted = np.zeros(len(codes), np.uint64)
        shifted[: len(codes) - n + 1] = codes[n - 1 :]
        h = (h + shifted + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)
        h ^= h >> np.uint64(32)
        if n in ORDERS:
            inside = codes != 0
            tail = (ends[:, None] - np.arange(1, n)).reshape(-1)
            inside[tail[tail >= 0]] = False
            at = np.flatnonzero(inside)
            out.append((row[at], (mix(h[at]) >> np.uint64(64 - BUCKETS)).astype(np.int32)))
    return out


def means(texts: list[str], table: np.ndarray) -> np.ndarray:
    """The mean of the table's numbers over each text's features; 0 for a text without any."""
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    for row, bucket in features(texts):
        total += np.bincount(row, table[bucket], len(texts))
        count += np.bincount(row, minlength=len(texts))
    return total / np.maximum(count, 1)


def fit(texts: list[str], labels: list[int], dim: int = 8, epochs: int = 6, rate: float = 0.2, seed: int = 7) -> dict:
    """Train on labelled texts; without both classes the score is the share of label 1 (0.5 for none)."""
    y = np.array(labels, int)
    prior = float(y.mean()) if len(y) else 0.5
    if not len(y) or y.min() == y.max():
        p = min(max(prior, 0.01), 0.99)
        return {"table": np.zeros(1 << BUCKETS, np.float32), "bias": float(np.log(p / (1 - p)))}
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1, 1, (1 << BUCKETS, dim)) / dim
    output = np.zeros((dim, 2))
    bias = np.log(np.array([1 - prior, prior]))
    rows = []
    for text in texts:
        buckets = np.concatenate([b for _, b in features([text])])
        ids, n = np.unique(buckets, return_counts=True)
        rows.append((ids.astype(np.int32), (n / max(1, len(buckets))).astype(np.float32)))
    weight = 0.5 / np.where(y == 1, prior, 1 - prior)
    steps = epochs * len(rows)
    for step, i in enumerate(np.concatenate([rng.permutation(len(rows)) for _ in range(epochs)])):
        ids, share = rows[i]
        hidden = share @ vectors[ids]
        score = hidden @ output + bias
        p = np.exp(score - score.max())
        p /= p.sum()
        p[y[i]] -= 1
        p *= rate * (1 - step / steps) * min(weight[i], 5)
        back = output @ p
        output -= np.outer(hidden, p)
        bias -= 0.1 * p
        # divided by the share's square, a step moves the mean itself by ``rate`` times its gradient
        vectors[ids] -= np.outer(share / (share @ share), back)
    return {"table": (vectors @ (output[:, 1] - output[:, 0])).astype(np.float32), "bias": float(bias[1] - bias[0])}


def score(model: dict, texts: list[str]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(means(texts, model["table"]) + model["bias"], -40, 40)))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, folds: int, held: int, most: int) -> list:
    """About ``most`` labelled rows outside the held-out fold, in a fixed order.

    The ids of the sample are chosen from ``labels`` first; they are bounded
    by ``most``, so the join to the texts broadcasts them.
    """
    known = labels.where((fold("doc_id", folds) != held) & F.col(column).isNotNull()).select("doc_id", F.col(column).alias("label"))
    ids = thinned(known, known.count(), most, "doc_id")
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").collect()
    return sorted(rows, key=lambda r: (r["doc_id"], r["text"] or "", r["label"]))


def train(docs: DataFrame, labels: DataFrame, max_train: int = 2000) -> dict:
    rows = labelled_sample(docs, labels, "quality", 5, 0, max_train)
    return fit([r["text"] or "" for r in rows], [int(r["label"]) for r in rows])


def classify(docs: DataFrame, model: dict, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs.

    Null and empty texts have no features and get the model's bias as their
    score.  Repeated rows and null ids give a row each (held_out is null for
    a null id).  An empty table gives none.  Other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        known = sent.value

        def each(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
            s = score(known, texts)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

        return each

    rows = docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "text")
    return map_texts(rows, work, "doc_id long, held_out boolean, score double, predicted int")
