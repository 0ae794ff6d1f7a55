"""SimHash near-duplicates by covering locality-sensitive hashing.

1. A document's fingerprint: words in three-word shingles, XXH64 of each; a
   bit is 1 if it is set in over half of them.
2. Covering masks: each of the 64 bits gets one of the 2^(r+1) - 1 non-zero
   vectors of r + 1 bits.  Table v keeps the bits whose vector has an odd
   product with v.  The vectors of r differing bits span no more than r
   dimensions, so some v is orthogonal to all of them, and its table keeps
   none of the differing bits: every pair within radius r shares a bucket
   there, without exception.
3. Equal fingerprints are one from the start.  In each bucket all of them are
   compared to one leader.  A bucket whose fingerprints are connected by then
   is done.  In the others those outside the leader's component are compared
   to the rest in blocks, and only links that join two components are kept.
4. Connected fingerprints are components, named by their least id.

No step emits all pairs of a bucket, and rows of a hot bucket are dealt over
many tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.common import checkpointed, fresh, map_texts
from metricloom.llm.near_dedup import components, dealt_join

SHINGLE = 3
RADIUS = 3
#: Bytes of a text whose words are held as a list at a time.
PIECE = 1 << 20
#: Fingerprints on each side of a comparison of blocks.
BLOCK = 2048


def words(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text in lists of bounded size."""
    at = 0
    while at < len(data):
        cut = len(data)
        if at + PIECE < len(data):
            blank = re.compile(rb"[ \t-\r]").search(data, at + PIECE)
            cut = blank.start() if blank else cut
        yield data[at:cut].split()
        at = cut


def fingerprint(text: str) -> int:
    """The 64-bit fingerprint: a bit is 1 if it is set in over half of the shingles, repeats counted."""
    ones, n, kept = np.zeros(64, np.int64), 0, []
    size = 0  # words so far
    # bytes.lower() and bytes.split() know ASCII letters and blanks only, as meant here
    for part in words(text.encode().lower()):
        run = kept + part
        size += len(part)
        hashes = [xxhash.xxh64_intdigest(b" ".join(run[i : i + SHINGLE]), 42) for i in range(len(run) - SHINGLE + 1)]
        kept = run[-(SHINGLE - 1) :]
        ones, n = ones + set_bits(hashes), n + len(hashes)
    if 0 < size < SHINGLE:
        ones, n = set_bits([xxhash.xxh64_intdigest(b" ".join(kept), 42)]), 1
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist()))


def set_bits(hashes: list[int]) -> np.ndarray:
    """How many of the hashes have each bit set."""
    h = np.array(hashes, "<u8")
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) if len(h) else np.zeros(64, np.int64)


def masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The bits that each table keeps."""
    tables = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(bits) if ((i % tables + 1) & v).bit_count() % 2) for v in range(1, tables + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, f): each row's fingerprint as a signed number."""

    def work():
        def each(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([signed(fingerprint(x)) for x in texts], pa.int64())], ["doc_id", "f"])

        return each

    return map_texts(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), work, "doc_id long, f long")


def _within(members: DataFrame, roots: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) between components that meet in a bucket of three fingerprints or more.

    members has a row (a, leader b, table, value) for each fingerprint of a
    bucket, roots (node, root) for what is connected so far.  Links lie
    between a fingerprint outside the leader's component and one of any other
    component; both sides are dealt into blocks by a hash, so that a pair of
    blocks is one group of about 2 * BLOCK fingerprints.
    """
    bucket = ["table", "value"]
    known = members.join(roots, F.col("a") == F.col("node"), "left").select("a", *bucket, F.coalesce("root", "a").alias("own"), (F.col("a") == F.col("b")).alias("leads"))
    # fingerprints outside the leader's component: with one or none of them, the leader has seen all that can be linked
    per = known.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n"), F.min("own").alias("low"), F.max("own").alias("high"), F.max(F.when(F.col("leads"), F.col("own"))).alias("first"))
    rows = checkpointed(dealt_join(known, per.where("low <> high AND n > 2").select(*bucket, "n", "first"), bucket, "a"))
    outside = rows.where("own <> first")
    m = outside.groupBy(*bucket).agg(F.count(F.lit(1)).alias("m"))
    outside, rows = dealt_join(outside, m, bucket, "a"), dealt_join(rows, m, bucket, "a")

    def blocks(c: str):
        return F.ceil(F.col(c) / BLOCK).cast("int")

    def one(c: str):
        return F.pmod(F.xxhash64("a", F.lit(c)), blocks(c)).cast("int")

    def every(c: str):
        return F.explode(F.sequence(F.lit(0), blocks(c) - 1))

    dealt = outside.select("a", "own", *bucket, one("m").alias("i"), every("n").alias("j"), F.lit(True).alias("left"))
    dealt = dealt.unionByName(rows.select("a", "own", *bucket, every("m").alias("i"), one("n").alias("j"), F.lit(False).alias("left")))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        x, y = rows[rows["left"]], rows[~rows["left"]]
        root: dict[int, int] = {}

        def find(v: int) -> int:
            while root.get(v, v) != v:
                root[v] = root.get(root[v], root[v])
                v = root[v]
            return v

        out = []
        names, right = y["own"].to_numpy(), y["a"].to_numpy().view(np.uint64)
        for a, own in zip(x["a"].to_numpy(), x["own"].to_numpy(), strict=True):
            near = (np.bitwise_count(right ^ a.view(np.uint64)) <= radius) & (names != own)
            for k in np.flatnonzero(near).tolist():
                u, v = find(int(own)), find(int(names[k]))
                if u != v:
                    root[max(u, v)] = min(u, v)
                    out.append((int(own), int(names[k])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return dealt.groupBy(*bucket, "i", "j").applyInPandas(compare, "a long, b long").distinct()


def connected(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(node, root) for fingerprints (f), all distinct, that are linked to another; the others have no row."""
    tables = F.explode(F.array(*[F.struct(F.lit(i).alias("table"), F.col("f").bitwiseAND(F.lit(signed(m))).alias("value")) for i, m in enumerate(masks(radius))]))
    spread = prints.select("f", tables.alias("x")).select("f", "x.*")
    # the leader is any one of the bucket, the same for each run
    lead = spread.groupBy("table", "value").agg(F.count(F.lit(1)).alias("n"), F.min_by("f", F.xxhash64("f")).alias("b")).where("n > 1").select("table", "value", "b")
    members = checkpointed(dealt_join(spread, lead, ["table", "value"], "f").select(F.col("f").alias("a"), "b", "table", "value"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    roots = checkpointed(components(members.where(near & (F.col("a") != F.col("b"))).select("a", "b")))
    more = components(_within(members, roots, radius))
    more = more.select(F.col("node").alias("root"), F.col("root").alias("to_"))
    first = dealt_join(roots, more, ["root"], "node", "left").select("node", F.coalesce("to_", "root").alias("root"))
    # what the second round names was a root before or stood alone, so it has no row in the first
    return first.unionByName(more.select(F.col("root").alias("node"), F.col("to_").alias("root")))


def classes(docs: DataFrame, radius: int = RADIUS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs.

    Fingerprints with at most ``radius`` differing bits are linked.
    component_id is the least id reachable, the row's own included; a
    component whose ids are all null has none.  A null or blank text has no
    word and the fingerprint zero, which links like any other; a text of
    fewer words than a shingle is one shingle.  Rows that repeat an id and
    differ in text keep their own fingerprints and components, since links
    are between fingerprints.  Whole texts count, however long, in pieces of
    bounded size.  Other columns are neither read nor returned; an empty
    table gives no rows.
    """
    rows = checkpointed(fingerprints(docs, text, key))
    prints = rows.groupBy("f").agg(F.min("doc_id").alias("least"))
    prints = checkpointed(prints)
    named = dealt_join(prints, connected(prints.select("f"), radius).withColumnRenamed("node", "f"), ["f"], "f", "left").withColumn("root", F.coalesce("root", "f"))
    named = checkpointed(named)
    called = named.groupBy("root").agg(F.min("least").alias("component_id"))
    called = dealt_join(named, called, ["root"], "f").select("f", "component_id")
    out = dealt_join(rows, called, ["f"], "doc_id")
    return out.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs without the rows whose component has a smaller id; rows with a null id stay, and of rows that repeat an id one stays."""
    mark = fresh(docs, "kept_")
    ids = classes(docs, radius).where("doc_id = component_id").select(F.col("doc_id").alias(mark)).distinct()
    one = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    return one.join(ids, F.col("doc_id") == F.col(mark), "left_semi").unionByName(docs.where("doc_id IS NULL"))
