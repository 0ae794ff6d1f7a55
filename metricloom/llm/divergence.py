"""Source divergence audit: term shares of each (lang, source) against the other sources and the lang.

1. Tasks count terms by group and how many documents hold them, combined
   before the one shuffle by (lang, term).  Terms in enough documents of
   their lang are kept, with the lang's count beside the group's.
2. The matrix of groups and terms of a lang is cut into tiles: blocks of
   groups by blocks of terms (by a hash), of bounded size.
3. A tile is a K-squared tree (k = 2): for each level one bitmap with four
   bits for each quadrant that is not empty; ranks in it lead to the
   children.  All pairs of groups are traversed at once: a step takes a pair
   of row quadrants and a column quadrant and halves all three.  Where both
   sides are empty each cell has the share of a count of zero, so the
   quadrant's price is its width times one constant.  Other quadrants go down
   to their cells.
4. Columns that a tile does not hold are priced likewise, once for a pair.

Shares and values are whole numbers throughout.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.llm.common import checkpointed
from metricloom.llm.near_dedup import dealt_join

#: Bytes of letters: ASCII ones, lower-cased before, and all of other characters.
TERM = re.compile(rb"[a-z\x80-\xff]+")
#: Bytes of a text whose terms are listed at a time.
PIECE = 1 << 20
#: Counts that a task holds before it sends them on.
HELD = 500_000
#: Groups in a block of rows, and about how many cells a tile holds.
ROWS, CELLS = 64, 1 << 16
#: Quadrants that a step of the traversal takes at most.
STEP = 1 << 16
ONE = 1_000_000_000


def terms(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, in order, in lists of bounded size; A-Z are lower-cased."""
    data, at = text.encode().lower(), 0
    while at < len(data):
        cut = len(data)
        if at + PIECE < len(data):
            gap = re.compile(rb"[^a-z\x80-\xff]").search(data, at + PIECE)
            cut = gap.start() if gap else cut
        yield TERM.findall(data, at, cut)
        at = cut


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs) from docs (text, lang, source) without nulls; a task may give several rows of one key."""
    names = ["lang", "source", "term", "count", "docs"]

    def batches_of(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, docs) in held.items():
            if counts:
                n = len(counts)
                columns = [pa.array([lang] * n), pa.array([source] * n), pa.array([t.decode() for t in counts]), pa.array(counts.values(), pa.int64()), pa.array([docs[t] for t in counts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
        size = 0
        for batch in batches:
            for text, lang, source in zip(batch.column("text"), batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True):
                counts, docs = held[lang, source]
                before, own = len(counts), set()
                for part in terms(text.as_py()):
                    counts.update(part)
                    own.update(part)
                docs.update(own)
                size += len(counts) - before
                if size >= HELD:
                    yield from batches_of(held)
                    held.clear()
                    size = 0
        yield from batches_of(held)

    return docs.select("text", "lang", "source").mapInArrow(count, "lang string, source string, term string, count long, docs long")


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (n + 2 v)), exact for any count; null without terms."""
    wide = (count + 2).cast("decimal(19,0)") * F.lit(ONE).cast("decimal(10,0)")
    return F.when(v > 0, 1 + F.call_function("div", wide, (n + 2 * v).cast("decimal(19,0)")))


def cells(docs: DataFrame, least_docs: int) -> DataFrame:
    """(lang, source, term, count, total, first): counts of kept terms in groups that hold them and in the lang; first marks one row of each term of a lang."""
    rows = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    w = Window.partitionBy("lang", "term")
    rows = rows.withColumns({"total": F.sum("count").over(w), "held": F.sum("docs").over(w), "first": F.col("source") == F.min("source").over(w)})
    return rows.where(F.col("held") >= least_docs).select("lang", "source", "term", "count", "total", "first")


class Tree:
    """A K-squared tree over cells (row, column), k = 2, of 2 ** levels rows and columns."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, levels: int):
        code = np.zeros(len(row), np.int64)
        for bit in range(levels):
            code |= ((row >> bit & 1) << (2 * bit + 1)) | ((column >> bit & 1) << (2 * bit))
        order = np.argsort(code)
        code, self.value = code[order], value[order]
        self.bits: list[np.ndarray] = [np.zeros(0, bool)]
        self.rank: list[np.ndarray] = [np.zeros(0, np.int64)]
        below = code
        for _ in range(levels):
            nodes = np.unique(below >> 2)
            bits = np.zeros(4 * len(nodes), bool)
            bits[4 * np.searchsorted(nodes, below >> 2) + (below & 3)] = True
            self.bits.append(bits)
            self.rank.append(np.cumsum(bits) - 1)
            below = nodes
        self.root = 0 if len(code) else -1

    def child(self, level: int, node: np.ndarray, quadrant: int) -> np.ndarray:
        """The nodes one level below, -1 where a quadrant is empty or the node is."""
        if not len(self.bits[level]):
            return np.full(len(node), -1)
        at = 4 * np.maximum(node, 0) + quadrant
        return np.where((node >= 0) & self.bits[level][at], self.rank[level][at], -1)


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def pair_sums(a: Tree, b: Tree, zero_a: np.ndarray, zero_b: np.ndarray, columns: int, levels: int, same: bool) -> np.ndarray:
    """Sums of prices over all columns, for each row of a (zero_a: what an absent cell is) and of b; with ``same`` only where a's row is before b's."""
    na, nb = len(zero_a), len(zero_b)
    out = np.zeros(na * nb)  # whole numbers far below 2 ** 53
    empty = [np.zeros((-(-na >> s), -(-nb >> s)), np.int64) for s in range(levels + 1)]
    stack = [(levels, *[np.array([x]) for x in (0, 0, 0, a.root, b.root)])]
    while stack:
        level, ra, rb, c, x, y = stack.pop()
        if len(ra) > STEP:
            half = len(ra) // 2
            stack += [(level, *[v[:half] for v in (ra, rb, c, x, y)]), (level, *[v[half:] for v in (ra, rb, c, x, y)])]
            continue
        zero = (x < 0) & (y < 0)
        if zero.any():
            width = np.minimum((c[zero] + 1) << level, columns) - (c[zero] << level)
            np.add.at(empty[level], (ra[zero], rb[zero]), width)
            ra, rb, c, x, y = (v[~zero] for v in (ra, rb, c, x, y))
        if not level:
            p = np.where(x >= 0, a.value[x], zero_a[ra]) if len(a.value) else zero_a[ra]
            q = np.where(y >= 0, b.value[y], zero_b[rb]) if len(b.value) else zero_b[rb]
            out += np.bincount(ra * nb + rb, price(p, q), na * nb)
            continue
        level -= 1
        parts = []
        for k in (0, 1):
            left, right = [a.child(level + 1, x, 2 * i + k) for i in (0, 1)], [b.child(level + 1, y, 2 * j + k) for j in (0, 1)]
            for i in (0, 1):
                for j in (0, 1):
                    u, v, w = 2 * ra + i, 2 * rb + j, 2 * c + k
                    there = (u << level < na) & (v << level < nb) & (w << level < columns)
                    if same:  # the quadrant has a row of a before one of b
                        there &= (u << level) < np.minimum((v + 1) << level, nb) - 1
                        there &= u <= v
                    parts.append([z[there] for z in (u, v, w, left[i], right[j])])
        stack.append((level, *[np.concatenate(z) for z in zip(*parts, strict=True)]))
    zeros = np.zeros((na, nb), np.int64)
    for s, e in enumerate(empty):
        zeros += np.repeat(np.repeat(e, 1 << s, 0)[:na], 1 << s, 1)[:, :nb]
    return out.astype(np.int64).reshape(na, nb) + zeros * price(zero_a[:, None], zero_b[None, :])


def _tile(rows: pd.DataFrame, height: int) -> pd.DataFrame:
    """(lang, a, b, total, width, zero, v) for the pairs of groups of a tile; rows without a term are its groups."""
    lang, i, j = rows["lang"].iloc[0], rows["i"].iloc[0], rows["j"].iloc[0]
    groups = rows[rows["term"].isna()].sort_values("row")
    held = rows[rows["term"].notna()]
    column, names = pd.factorize(held["term"])
    r, p = held["row"].to_numpy(np.int64), held["p"].to_numpy(np.int64)
    levels = max(len(names) - 1, height - 1, 1).bit_length()
    v = int(groups["v"].iloc[0])
    sides = []
    for block in (i, j):
        mine, own = groups[groups["row"] // height == block], r // height == block
        sides.append((mine, Tree(r[own] - block * height, column[own].astype(np.int64), p[own], levels)))
    (ga, ta), (gb, tb) = sides
    za, zb = (g["p"].to_numpy(np.int64) for g in (ga, gb))
    first, second = np.triu_indices(len(ga), 1) if i == j else (x.ravel() for x in np.indices((len(ga), len(gb))))
    if v:
        total, zero = pair_sums(ta, tb, za, zb, len(names), levels, i == j), price(za[:, None], zb[None, :])
    else:
        total = zero = np.zeros((len(ga), len(gb)), np.int64)
    sources = ga["source"].to_numpy(), gb["source"].to_numpy()
    return pd.DataFrame({"lang": lang, "a": sources[0][first], "b": sources[1][second], "total": total[first, second], "width": len(names), "zero": zero[first, second], "v": v})


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10, height: int = ROWS, size: int = CELLS, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` sets a group beside each other source of its lang, part ``term`` lists the terms that it has more of.

    Null text, lang and source read as empty.  Each row counts as a document,
    so rows that repeat count again.  A lang without kept terms gives pairs of
    value 0 and no terms; a lang of one source gives no pairs; an empty table
    gives no rows.  Ties rank by the item's bytes.  Whole texts count, however
    long, in pieces of bounded size.  Other columns are not read.  A tile has
    up to ``height`` groups on a side and about ``size`` cells.
    """
    docs = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(k) for k, c in (("text", text), ("lang", lang), ("source", source))])
    found = checkpointed(cells(docs, least_docs))
    langs = found.groupBy("lang").agg(F.count_if("first").alias("v"), F.sum("count").alias("n_lang"), F.ceil(F.count(F.lit(1)) / size).cast("int").alias("blocks"))
    sizes = found.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = docs.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "v", "n_lang")], F.coalesce("blocks", F.lit(1)).alias("blocks"))
    # one row for each group; the pairs that are asked for are the square of a lang's
    numbered = Window.partitionBy("lang").orderBy("source")
    groups = groups.withColumns({"row": F.row_number().over(numbered) - 1, "n_rows": F.count(F.lit(1)).over(Window.partitionBy("lang"))})
    groups = checkpointed(groups)
    priced = dealt_join(found, groups, ["lang", "source"], "term").select(
        "lang", "source", "term", "row", "n_rows", "blocks", "v", share(F.col("count"), F.col("n"), F.col("v")).alias("p"), share(F.col("total"), F.col("n_lang"), F.col("v")).alias("q"))
    priced = checkpointed(priced)

    most = priced.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    most = most.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)

    # a block of rows meets itself and every other one
    block, last = F.expr(f"row div {height}").cast("int"), F.expr(f"(n_rows - 1) div {height}").cast("int")
    meets = F.explode(F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(F.least(k, block).alias("i"), F.greatest(k, block).alias("j"))))
    tiles = priced.select("lang", F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("part"), meets.alias("m"), "row", "term", "p", "v", F.lit(None).cast("string").alias("source"))
    zero = F.coalesce(share(F.lit(0), F.col("n"), F.col("v")), F.lit(0))
    own = groups.select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), "row", "n_rows", zero.alias("p"), "v", "source")
    own = own.select("lang", "part", meets.alias("m"), "row", F.lit(None).cast("string").alias("term"), "p", "v", "source")
    tiles = tiles.unionByName(own).select("lang", "part", "m.*", "row", "term", "p", "v", "source")
    sums = tiles.groupBy("lang", "part", "i", "j").applyInPandas(lambda rows: _tile(rows, height), "lang string, a string, b string, total long, width long, zero long, v long")
    sums = sums.groupBy("lang", "a", "b").agg((F.sum("total") + (F.max("v") - F.sum("width")) * F.max("zero")).alias("value"))
    both = F.explode(F.array(*[F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in (("a", "b"), ("b", "a"))]))
    pairs = sums.select("lang", both.alias("x"), "value").select("lang", "x.source", "x.item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(ranked))
    return pairs.withColumn("part", F.lit("pair")).unionByName(most.withColumn("part", F.lit("term"))).select("lang", "source", "part", "item", "value", "rank")
