"""Best-fit packing of documents into sequences, as a tree of residual bins.

Tasks tokenise their documents.  A document longer than a sequence is cut into
full sequences behind a shorter first piece; full pieces are sequences of their
own.  The numbers of the other pieces (not their texts) are dealt by a hash
into groups of about ``GROUP`` pieces, so a group holds short and long ones
whatever the order of the table, and each group packs best-fit decreasing.
Nearly full bins are emitted.  The others move up a tree: neighbouring groups
pack their underfull bins, now items themselves, into each other, round by
round, until one group is left.

Best fit leaves at most one bin in a group that is half full or less, for two
such bins would have become one.  So a node of the tree can place at most
FAN_IN small bins, each into a bin that no other one needs, and the emptiest
bins serve as well as any.  The FAN_IN emptiest bins for each level of the tree
are therefore all that can still change; the rest is emitted at once.  That
bounds what a node gathers without a loss of merges.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.common import checkpointed, slices

END = 0  # the id that ends a document
FAN_IN = 8
GROUP = 1 << 17
#: Characters whose classes both tokenizer libraries know alike; other texts take the slower library.
_PLAIN = re.compile("[^\x00-ɏ‐-‧]")
#: A run of blanks at which the faster library's pattern, which goes back step by step, would overflow its stack.
_BLANKS = re.compile(r"(?<!\s)\s{100000}")

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"
#: Pieces at their place in a bin of a group.
PLACED = f"{PIECES}, part int, bin long, at int, open boolean"


def tokenizer(path: str):
    """A function from a text to its ids.

    The vocabulary file is a byte-level BPE of the ``tokenizers`` library.
    The same merges run faster in ``tiktoken``, which gives equal ids for
    texts of common characters; texts with others, with a special token's
    string or with a very long run of blanks go through ``tokenizers`` itself.
    """
    import json

    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    byte_of = {chr(b if b in kept else next(other)): b for b in range(256)}
    special = [x["content"] for x in made["added_tokens"]]
    ranks = {bytes(byte_of[c] for c in word): i for word, i in made["model"]["vocab"].items() if word not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(text: str) -> list[int]:
        if _PLAIN.search(text) or any(x in text for x in special) or _BLANKS.search(text):
            return exact.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return ids


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Item numbers by bin: largest items first, each into the fullest bin that it fits."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by what is left in them
    rooms = 0  # a bit for each list that is not empty
    bins: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = rooms >> sizes[i]
        if fits:
            left = sizes[i] + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                rooms &= ~(1 << left)
            bins[b].append(i)
        else:
            left, b = capacity, len(bins)
            bins.append([i])
        left -= sizes[i]
        room[left].append(b)
        rooms |= 1 << left
    return bins


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int) -> DataFrame:
    """A row of PIECES for each piece of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = None
        for batch in batches:
            ids_of = ids_of or tokenizer(tokenizer_path)
            for rows, texts in slices(batch, "text"):
                out = []
                for doc_id, text in zip(rows.column("doc_id").to_pylist(), texts, strict=True):
                    ids = np.array([*ids_of(text), END], "<u4")
                    first = len(ids) % capacity or capacity
                    for k, b in enumerate(range(first, len(ids) + 1, capacity)):
                        a = max(b - capacity, 0)
                        out.append((doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def _packed(rows: pa.Table, item: np.ndarray, at: np.ndarray, part: int, capacity: int, slack: int, carry: int) -> pa.Table:
    """rows of PIECES packed by item, given their places within their items; items are numbered from 0."""
    sizes = np.bincount(item, rows["length"].to_numpy()).astype(np.int64)
    bins = best_fit(sizes.tolist(), capacity)
    bin_of, shift, fill = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), np.zeros(len(bins), np.int64)
    for b, items in enumerate(bins):
        bin_of[items] = b
        shift[items] = np.cumsum([0, *sizes[items[:-1]]])
        fill[b] = sizes[items].sum()
    opened = np.zeros(len(bins), bool)
    opened[np.argsort(fill, kind="stable")[:carry]] = True
    opened &= fill < capacity - slack
    b = bin_of[item]
    out = [*(rows[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(np.full(len(b), part, np.int32)), pa.array(b), pa.array((at + shift[item]).astype(np.int32)), pa.array(opened[b])]
    return pa.Table.from_arrays(out, ["doc_id", "piece", "start", "length", "ids_crc32", "part", "bin", "at", "open"])


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, slack: int = 4, group: int = GROUP) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece.

    A null or empty text is the end id alone: one piece of length 1.  Rows
    that repeat, and rows with a null id, are packed each for itself.  Equal
    sizes go by doc_id, piece and checksum.  A text is tokenised whole, one at
    a time, however long.  An empty table gives no rows.  Columns other than
    doc_id and text are not read.
    """
    pieces = checkpointed(pieces_of(docs, tokenizer_path, capacity))
    full = pieces.where(F.col("length") == capacity)
    rest = pieces.where(F.col("length") < capacity)
    parts = max(1, -(-rest.count() // group))
    levels, width = 1, parts
    while width > 1:
        levels, width = levels + 1, -(-width // FAN_IN)
    carry = FAN_IN * levels

    def local(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        return _packed(rows, np.arange(rows.num_rows), np.zeros(rows.num_rows, np.int64), rows["part"][0].as_py(), capacity, slack, carry if parts > 1 else 0)

    def merge(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("part", "ascending"), ("bin", "ascending"), ("at", "ascending")])
        part, b = rows["part"].to_numpy(), rows["bin"].to_numpy()
        item = np.cumsum(np.concatenate(([False], (part[1:] != part[:-1]) | (b[1:] != b[:-1]))))
        return _packed(rows, item, rows["at"].to_numpy(), int(part[0]) // FAN_IN, capacity, slack, carry)

    # rows of one document that repeats are dealt apart by their numbers
    dealt = rest.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id(), "doc_id", "piece"), F.lit(parts)).cast("int"))
    bins = checkpointed(dealt.groupBy("part").applyInArrow(local, PLACED))
    done, level = [], 0
    while parts > 1:
        done.append(bins.where("NOT open").withColumn("level", F.lit(level)))
        level, parts = level + 1, -(-parts // FAN_IN)
        grouped = bins.where("open").groupBy(F.expr(f"part div {FAN_IN}").alias("g"))
        bins = checkpointed(grouped.applyInArrow(merge, PLACED))
    out = bins.withColumn("level", F.lit(level))
    for x in done:
        out = out.unionByName(x)
    number = F.shiftleft(F.col("level").cast("long"), 58) + F.shiftleft(F.col("part").cast("long"), 32) + F.col("bin")
    columns = ["doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32"]
    packed = out.select(*columns, number.alias("sequence_id"), F.col("at").cast("long").alias("offset"))
    alone = full.select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)
