"""Line deduplication against a sharded minimal perfect hash.

Lines are keyed by their trimmed, lower-cased bytes (128-bit hash).  One
shuffle counts in how many documents each key stands.  The keys found in
enough documents go into an index: shards of bounded size, each a minimal
perfect hash (levels of bit arrays, as in BBHash) that maps a key to a place
in compact arrays of fingerprints (64 bits) and counts.  Rarer lines cannot be
dropped and are not in the index; the fingerprint tells them apart.

Documents probe the arrays.  An index up to ``broadcast_bytes`` is sent to
every task; a larger one stays distributed: line hashes travel to their shard
(salted, so that neither a common line nor a repeated text meets in one task), stream past that
shard's arrays, and only the dropped hashes of each text travel back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.codes import mix
from metricloom.llm.common import checkpointed, fresh, map_texts, slices, wider, with_column

BLANK = " \t\n\x0b\x0c\r"
SHARD_KEYS = 1 << 15
SALTS = 64
TEXT_SALTS = 8  # tasks that share the rows of one text that repeats
RANK_BLOCK = 128  # slots
FLUSH = 1 << 18


def key_of(line: str) -> bytes:
    return line.strip(BLANK).encode("utf-8", "surrogatepass").lower()  # bytes.lower() changes A-Z only


def hash_of(key: bytes) -> tuple[int, int]:
    """Two signed 64-bit halves of the key's hash."""
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h >> 64, h & 0xFFFFFFFFFFFFFFFF
    return a - ((a >> 63) << 64), b - ((b >> 63) << 64)


class Lookup:
    """A minimal perfect hash over 64-bit keys, with fingerprints and counts at each place."""

    def __init__(self, levels: list[np.ndarray], fingerprints: np.ndarray, counts: np.ndarray, extra: np.ndarray | None = None):
        """extra: rows (key, fingerprint, count) of keys that share their 64 bits with one that has a place."""
        self.levels, self.fingerprints, self.counts = levels, fingerprints, counts
        self.extra = np.zeros((0, 3), np.int64) if extra is None else extra
        self.before = np.cumsum([0, *[int(x.sum()) for x in levels]])
        # the rank of a slot: that of its block, and within the block one byte
        self.ranks, self.within = [], []
        for x in levels:
            blocks = np.pad(x, (0, -len(x) % RANK_BLOCK)).reshape(-1, RANK_BLOCK)
            sums = np.cumsum(blocks, axis=1, dtype=np.uint8)
            self.ranks.append(np.cumsum(np.append(0, sums[:, -1].astype(np.int64)))[:-1])
            self.within.append((sums - blocks).reshape(-1))

    @staticmethod
    def places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, fingerprints: np.ndarray, counts: np.ndarray) -> Lookup:
        keys, first, of = np.unique(keys, return_index=True, return_inverse=True)
        more = first[of] != np.arange(len(of))
        extra = np.stack([keys[of[more]].view(np.int64), fingerprints[more], counts[more]], axis=1)
        fingerprints, counts = fingerprints[first], counts[first]
        levels, left = [], keys
        while len(left):
            size = 2 * len(left) + 1
            at = cls.places(left, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        out = cls(levels, np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), extra)
        at = out.find(keys)
        out.fingerprints[at], out.counts[at] = fingerprints, counts
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key; -1 for keys that no level holds."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for i, alone in enumerate(self.levels):
            at = self.places(keys[left], i, len(alone))
            hit = alone[at]
            out[left[hit]] = self.before[i] + self.ranks[i][at[hit] // RANK_BLOCK] + self.within[i][at[hit]]
            left = left[~hit]
        return out

    def count(self, keys: np.ndarray, fingerprints: np.ndarray) -> np.ndarray:
        """In how many documents each key stands; 0 for what is not in the index."""
        at = self.find(keys)
        ok = (at >= 0) & (len(self.counts) > 0)
        out = np.zeros(len(keys), np.int64)
        same = self.fingerprints[at[ok]] == fingerprints[ok]
        out[ok] = np.where(same, self.counts[at[ok]], 0)
        for h, f, n in self.extra:
            out[(keys.view(np.int64) == h) & (fingerprints == f)] = n
        return out

    def pack(self) -> dict:
        return {"sizes": [len(x) for x in self.levels], "bits": [np.packbits(x).tobytes() for x in self.levels], "fingerprints": self.fingerprints.tobytes(), "counts": np.minimum(self.counts, 2**32 - 1).astype("<u4").tobytes(), "extra": self.extra.tobytes()}

    @classmethod
    def unpack(cls, row: dict) -> Lookup:
        levels = [np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for n, b in zip(row["sizes"], row["bits"], strict=True)]
        return cls(levels, np.frombuffer(row["fingerprints"], np.int64), np.frombuffer(row["counts"], "<u4").astype(np.int64), np.frombuffer(row["extra"], np.int64).reshape(-1, 3))


INDEX = "shard int, sizes array<long>, bits array<binary>, fingerprints binary, counts binary, extra binary"


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (keys.view(np.int64) % shards).astype(np.int32)


def count_lines(docs: DataFrame, text: str, min_chars: int) -> DataFrame:
    """(h, f, n): the documents that hold each line key; a row of docs counts once for each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], int] = {}

        def out() -> pa.RecordBatch:
            h, f = (np.array(x, np.int64) for x in zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(f), pa.array(list(held.values()), pa.int64())], ["h", "f", "n"])

        for batch in batches:
            for _, texts in slices(batch, text):
                for body in texts:
                    keys = {key_of(x) for x in body.split("\n")}
                    for k in keys:
                        if k and len(k.decode("utf-8", "surrogatepass")) >= min_chars:
                            h = hash_of(k)
                            held[h] = held.get(h, 0) + 1
                if len(held) >= FLUSH:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return docs.select(text).mapInArrow(run, "h long, f long, n long").groupBy("h", "f").agg(F.sum("n").alias("n"))


def build_index(docs: DataFrame, text: str = "text", min_docs: int = 10, min_chars: int = 1) -> tuple[DataFrame, int, int]:
    """The shards of the index, how many there are, and how many keys they hold."""
    common = checkpointed(count_lines(docs, text, min_chars).where(F.col("n") >= min_docs))
    n = common.count()
    shards = max(1, -(-n // SHARD_KEYS))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        keys = rows["h"].to_numpy().view(np.uint64)
        packed = Lookup.build(keys, rows["f"].to_numpy(), rows["n"].to_numpy()).pack()
        return pd.DataFrame([{"shard": int(shard_of(keys[:1], shards)[0])} | packed])

    return common.groupBy(F.pmod("h", F.lit(shards)).alias("shard")).applyInPandas(build, INDEX), shards, n


def sift(texts: list[str], dropped) -> tuple[list[int], list[int], list[str]]:
    """Lines before, lines dropped and the text that stays, given a function from hash arrays to booleans."""
    split = [x.split("\n") for x in texts]
    keys: dict[bytes, int] = {}
    each = [[keys.setdefault(key_of(x), len(keys)) for x in lines] for lines in split]
    hashes = [hash_of(k) if k else (0, 0) for k in keys]
    drop = np.zeros(len(keys), bool)
    full = np.array([bool(k) for k in keys], bool)
    if full.any():
        h, f = np.array([x for x, k in zip(hashes, full, strict=True) if k], np.int64).T
        drop[full] = dropped(h.view(np.uint64), f)
    total, gone, kept = [], [], []
    for lines, at in zip(split, each, strict=True):
        stay = [x for x, k in zip(lines, at, strict=True) if not drop[k]]
        total.append(len(lines))
        gone.append(len(lines) - len(stay))
        kept.append("\n".join(stay))
    return total, gone, kept


class Index:
    """All shards in one task."""

    def __init__(self, rows: list[dict], shards: int, min_docs: int):
        self.shards, self.min_docs = shards, min_docs
        self.of = {r["shard"]: Lookup.unpack(r) for r in rows}

    def __call__(self, h: np.ndarray, f: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), bool)
        shard = shard_of(h, self.shards)
        for k, lookup in self.of.items():
            at = np.flatnonzero(shard == k)
            out[at] = lookup.count(h[at], f[at]) >= self.min_docs
        return out


def _far_drops(docs: DataFrame, index: DataFrame, shards: int, min_docs: int, text: str) -> DataFrame:
    """(t1, t2, drops): the hashes that a text loses, by the text's own hash; found where the shards are."""

    def explode(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        rows = []
        for body in dict.fromkeys(texts):
            t = hash_of(body.encode("utf-8", "surrogatepass"))
            rows += [(*t, *hash_of(k)) for k in {key_of(x) for x in body.split("\n")} if k]
        a = np.array(rows, np.int64).reshape(-1, 4)
        shard = shard_of(np.ascontiguousarray(a[:, 2]).view(np.uint64), shards)
        # by the text and its place in the task: neither a common line nor a text that repeats meets in one task
        salt = (mix(a[:, 0].astype(np.uint64) + np.arange(len(a), dtype=np.uint64)) % np.uint64(SALTS)).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(shard), pa.array(salt), *[pa.array(a[:, i].copy()) for i in range(4)]], ["shard", "salt", "t1", "t2", "h", "f"])

    probes = map_texts(docs.select(text), lambda: explode, "shard int, salt int, t1 long, t2 long, h long, f long", text)
    arrays = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    both = arrays.unionByName(probes, allowMissingColumns=True).withColumn("probe", F.col("h").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, lookup = None, None
        for batch in batches:
            probe = batch.column("probe").to_numpy(zero_copy_only=False)
            shard_col = batch.column("shard").to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], (~probe[1:]) | (shard_col[1:] != shard_col[:-1]) | (~probe[:-1]))))
            for a, b in zip(cuts, [*cuts[1:], len(probe)], strict=True):
                if not probe[a]:
                    shard, lookup = shard_col[a], Lookup.unpack(batch.slice(a, 1).select(["sizes", "bits", "fingerprints", "counts", "extra"]).to_pylist()[0])
                elif shard_col[a] == shard and lookup is not None:
                    t1, t2, h, f = (batch.column(c).slice(a, b - a).to_numpy() for c in ("t1", "t2", "h", "f"))
                    hit = lookup.count(np.ascontiguousarray(h).view(np.uint64), f) >= min_docs
                    if hit.any():
                        yield pa.RecordBatch.from_arrays([pa.array(x[hit]) for x in (t1, t2, h, f)], ["t1", "t2", "h", "f"])

    found = both.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "probe").mapInArrow(run, "t1 long, t2 long, h long, f long")
    # a text that repeats is found by many tasks: each line once, before the lists are gathered
    return found.distinct().groupBy("t1", "t2").agg(F.collect_list(F.struct("h", "f")).alias("drops"))


def drop_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text: str = "text", broadcast_bytes: int = 64 << 20, prefix: str = "l_") -> DataFrame:
    """docs with the sifted text, and prefixed columns n_lines and n_dropped.

    A null or empty text is one empty line, which has no key: it stays, as an
    empty text.  Rows that repeat count as documents of their own.  Equal keys
    share one verdict, whatever the order of rows.  All other columns stay.
    """
    index, shards, n = build_index(docs, text, min_docs, min_chars)
    schema = wider(docs.schema, **{f"{prefix}n_lines": "long", f"{prefix}n_dropped": "long"})

    def grown(batch: pa.RecordBatch, texts: list[str], dropped) -> pa.RecordBatch:
        total, gone, kept = sift(texts, dropped)
        batch = with_column(batch, text, pa.array(kept, pa.string()))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], [*batch.schema.names, f"{prefix}n_lines", f"{prefix}n_dropped"])

    if n * 13 <= broadcast_bytes:
        sent = docs.sparkSession.sparkContext.broadcast([r.asDict() for r in index.collect()])

        def work():
            look = Index(sent.value, shards, min_docs)
            return lambda batch, texts: grown(batch, texts, look)

        return map_texts(docs, work, schema, text)

    p = fresh(docs, "x_")
    t1, t2, salt, gone = (p + c for c in ("t1", "t2", "salt", "drops"))
    drops = _far_drops(docs, index, shards, min_docs, text).withColumnsRenamed({"t1": t1, "t2": t2, "drops": gone})
    drops = drops.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(TEXT_SALTS - 1))))

    def text_hash(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        h = np.array([hash_of(x.encode("utf-8", "surrogatepass")) for x in texts], np.int64).reshape(-1, 2)
        deal = (np.arange(len(texts)) + h[:, 1]) % TEXT_SALTS
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(deal.astype(np.int32))], [*batch.schema.names, t1, t2, salt])

    hashed = map_texts(docs, lambda: text_hash, wider(docs.schema, **{t1: "long", t2: "long", salt: "int"}), text)
    names = docs.columns
    joined = hashed.join(drops, [t1, t2, salt], "left")

    def apply():
        def each(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
            lists = batch.column(gone).to_pylist()
            out = []
            for i, body in enumerate(texts):
                drop = {(d["h"], d["f"]) for d in lists[i] or ()}
                out.append(sift([body], lambda h, f, drop=drop: np.array([x in drop for x in zip(h.view(np.int64).tolist(), f.tolist(), strict=True)], bool)))
            total, dropped, kept = ([x[k][0] for x in out] for k in range(3))
            rows = with_column(batch.select(names), text, pa.array(kept, pa.string()))
            return pa.RecordBatch.from_arrays([*rows.columns, pa.array(total, pa.int64()), pa.array(dropped, pa.int64())], [*rows.schema.names, f"{prefix}n_lines", f"{prefix}n_dropped"])

        return each

    return map_texts(joined.select(*names, gone), apply, schema, text)


def digests(docs: DataFrame, **how: int) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) for each row of docs."""
    out = drop_lines(docs.select("doc_id", "text"), **how)
    return out.select("doc_id", F.col("l_n_lines").alias("n_lines"), F.col("l_n_dropped").alias("n_dropped"), F.sha2(F.col("text"), 256).alias("kept_sha256"))


def stage(docs: DataFrame, **how: int) -> DataFrame:
    """docs with the common lines gone; n_chars, where there is one, follows the text."""
    out = drop_lines(docs, prefix=fresh(docs, "l_"), **how)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
