"""Language identification with string kernels.

A text is the set of its character n-grams of 1 to 4 characters (the blended
spectrum, presence only).  Two texts are alike by the number of n-grams that
both have, over the root of the product of their numbers.  A few hundred
training texts are landmarks; the Nyström map of a text's kernel values
against them feeds a ridge regression of each language against the rest.  All
of it folds into two matrices, so that a batch is scored by two products.

Sizes are parameters: the fit sees at most ``max_train`` texts, taken evenly
from the languages, and the spectrum is kept to the ``vocabulary`` n-grams
that most of each language's training texts have.  Scoring reads every
character of every text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.codes import encode, mix
from metricloom.llm.common import fold, map_texts

ORDERS = (1, 2, 3, 4)
SLOTS = 20  # bits
ROWS = 512


def spectrum(codes: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """For each order the slot of the n-gram at each position; -1 where it would leave its text."""
    out, h = [], np.zeros(len(codes), np.uint64)
    gaps = np.ones(len(codes), bool)
    gaps[:] = codes == 0
    for n in ORDERS:
        shifted = np.zeros(len(codes), np.uint64)
        shifted[: len(codes) - n + 1] = codes[n - 1 :]
        h = (h + shifted + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        slot = (mix(h) >> np.uint64(64 - SLOTS)).astype(np.int32)
        if n > 1:
            tail = ends - (n - 1)
            gaps[tail[tail >= 0]] = True
        slot[gaps] = -1
        out.append(slot)
    return out


def presence(texts: list[str], column_of: np.ndarray, width: int) -> np.ndarray:
    """A 0/1 row for each text over the kept n-grams."""
    codes, starts, ends = encode(texts)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(np.append(starts, len(codes)))) if len(texts) else np.zeros(0, np.int32)
    out = np.zeros((len(texts), width + 1), np.uint8)
    flat = out.reshape(-1)
    for slot in spectrum(codes, ends):
        flat[row * (width + 1) + column_of[slot]] = 1
    return out[:, :width].astype(np.float32)


def kernel(p: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    a, b = np.sqrt(np.maximum(p.sum(1), 1)), np.sqrt(np.maximum(landmarks.sum(1), 1))
    return (p @ landmarks.T) / a[:, None] / b


def fit(texts: list[str], langs: list[str], vocabulary: int = 4096, landmarks: int = 256, ridge: float = 1e-2) -> dict:
    """The model of some labelled texts; with none of them, a model that knows no language."""
    names = sorted(set(langs))
    if not names:
        return {"names": [], "column_of": np.zeros((1 << SLOTS) + 1, np.int32), "marks": np.zeros((0, 1), np.float32), "weights": np.zeros((1, 0), np.float32)}
    tops = []  # one language at a time: memory does not grow with the number of labels times the slots
    for name in names:
        found = np.zeros(1 << SLOTS, np.int32)
        for text in (t for t, lang in zip(texts, langs, strict=True) if lang == name):
            codes, _, ends = encode([text])
            slots = np.concatenate(spectrum(codes, ends))
            found[np.unique(slots[slots >= 0])] += 1
        top = np.argsort(-found, kind="stable")[:vocabulary]
        tops.append(top[found[top] > 0])
    kept: dict[int, int] = {}
    for rank in range(vocabulary):  # the languages take turns
        for top in tops:
            if len(kept) < vocabulary and rank < len(top):
                kept.setdefault(int(top[rank]), len(kept))
    width = max(1, len(kept))
    column_of = np.full((1 << SLOTS) + 1, width, np.int32)  # the last entry serves slot -1
    column_of[list(kept)] = list(kept.values())
    x = np.concatenate([presence(texts[i : i + ROWS], column_of, width) for i in range(0, len(texts), ROWS)])
    y = np.where(np.array(langs)[:, None] == np.array(names), 1.0, -1.0)
    turn = np.argsort(np.argsort(np.array(langs), kind="stable") % max(1, len(langs) // landmarks), kind="stable")[:landmarks]
    marks = x[turn]
    values, vectors = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
    keep = values > 1e-6 * max(values.max(), 1e-12)
    root = vectors[:, keep] / np.sqrt(values[keep])
    z = kernel(x, marks) @ root
    z1 = np.column_stack([z, np.ones(len(z))])
    share_y = np.maximum(np.bincount(y.argmax(1), minlength=len(names)), 1)
    w = (1 / share_y)[y.argmax(1)]
    beta = np.linalg.solve(z1.T @ (z1 * w[:, None]) + ridge * np.eye(z1.shape[1]) / len(z1) , z1.T @ (y * w[:, None]))
    weights = np.vstack([root @ beta[:-1], beta[-1:]]).astype(np.float32)
    return {"names": names, "column_of": column_of, "marks": marks, "weights": weights}


def predict(model: dict, texts: list[str]) -> tuple[list[str], np.ndarray]:
    names = model["names"]
    lang, score = ["und"] * len(texts), np.zeros(len(texts))
    for at in range(0, len(texts), ROWS):
        rows = [i for i in range(at, min(at + ROWS, len(texts))) if next(filter(str.isalpha, texts[i]), None) is not None]
        if not rows or not names:
            continue
        p = presence([texts[i] for i in rows], model["column_of"], model["marks"].shape[1])
        margin = kernel(p, model["marks"]) @ model["weights"][:-1] + model["weights"][-1]
        e = np.exp(4 * (margin - margin.max(1, keepdims=True)))
        for i, k, s in zip(rows, margin.argmax(1), e.max(1) / e.sum(1), strict=True):
            lang[i], score[i] = names[k], float(s)
    return lang, score


def train(docs: DataFrame, max_train: int = 2400, **sizes: int) -> dict:
    """Fit on at most about ``max_train`` rows outside the held-out fold, as many of each language where there are."""
    known = docs.where((fold("doc_id", 5) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return fit([], [], **sizes)
    each = max(1, max_train // len(counts))
    rate = F.when(F.lit(False), 0)
    for lang, n in counts.items():
        rate = rate.when(F.col("lang") == lang, int(1_000_003 * min(1, each / n)))
    rows = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < rate.otherwise(0)).select("doc_id", "lang", "text").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return fit([r["text"] for r in rows], [r["lang"] for r in rows], **sizes)


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of docs.

    Null texts, empty texts and texts without a letter get ``und`` and score
    0.  Repeated rows and null ids give a row each (held_out is null for a
    null id).  Ties go to the first language by name.  An empty table gives
    none.  Columns other than doc_id and text are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        known = sent.value

        def each(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
            lang, score = predict(known, texts)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

        return each

    rows = docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "text")
    return map_texts(rows, work, "doc_id long, held_out boolean, lang_pred string, score double")
