"""Benchmark decontamination by the q-gram lemma.

A text region within k edits of a benchmark item of m characters shares at
least m - q + 1 - k q of the item's q-grams, and shares them along diagonals
that lie within k of each other.  So shared q-grams are counted in bands of
diagonals, 2 k + 1 wide and overlapping by half or more; bands that reach the
bound are regions to verify, by an alignment over the band's diagonals alone.
The edit budget k is a tenth of the item (``edits``), or less where the bound
would drop to nothing.  Only letters and digits count, lower case, so marks,
line breaks and spaces are free.

The benchmark is a query set against all documents.  Its q-grams are sent to
the tasks in blocks of at most ``block_chars`` characters of items, one pass
over a batch for each block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.codes import alnum, encode
from metricloom.llm.common import map_texts

Q = 8
SLOTS = 20
POSTINGS = 1 << 20  # of shared q-grams that are listed at a time


def normal(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """Letters and digits of all texts with Q zeros behind each; where each text starts and ends; what tells source places."""
    codes, starts, ends = encode(texts)
    keep = alnum(codes)
    for k in range(Q):
        keep[ends + k] = True  # encode leaves at least Q zeros behind a text
    if not len(starts):
        return codes, starts, ends, (keep, starts, ends)
    stops = np.cumsum(np.add.reduceat(keep, starts, dtype=np.int64))
    return codes[keep], np.concatenate(([0], stops[:-1])), stops - Q, (keep, starts, ends)


def grams(codes: np.ndarray) -> np.ndarray:
    """The Q = 8 characters from each place on, folded to a byte each, as one number; 0 where a text ends within them."""
    n = len(codes)
    h = np.where(codes == 0, 0, np.maximum((codes ^ (codes >> np.uint32(8))) & np.uint32(255), 1)).astype(np.uint64)
    bad = codes == 0
    for k in (1, 2, 4):  # windows of 1, 2, 4 characters double
        h[: n - k] |= h[k:] << np.uint64(8 * k)
        bad[: n - k] |= bad[k:]
        bad[n - k :] = True
    h[bad] = 0
    return h


def slot(h: np.ndarray) -> np.ndarray:
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)).astype(np.int64)


def _spaced(item: np.ndarray, h: np.ndarray, offset: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Which postings to keep, of those sorted by (q-gram, item, offset).

    Of a q-gram that an item repeats, an offset between two others less than
    a band apart falls to the band of one of them wherever the text's q-gram
    is, so it tells nothing and goes.
    """
    keep = np.ones(len(item), bool)
    same = (item[1:] == item[:-1]) & (h[1:] == h[:-1])
    last = 0
    for i in np.flatnonzero(same[:-1] & same[1:]) + 1:  # those with one before and one behind
        before = i - 1 if keep[i - 1] else last  # the last one kept
        if offset[i + 1] - offset[before] < step[i]:
            keep[i], last = False, before
    return keep


class Benchmark:
    """The q-grams of some items, and the search of texts for them."""

    def __init__(self, items: list[tuple[int, str]], edits: float = 0.1):
        self.ids = [i for i, _ in items]
        codes, starts, ends, _ = normal([t or "" for _, t in items])
        self.items = [codes[a:b] for a, b in zip(starts, ends, strict=True)]
        m = np.array([len(x) for x in self.items], np.int64)
        self.budget = np.maximum(np.minimum((m * edits).astype(np.int64), (m - Q) // Q), 0)
        self.bound = m - Q + 1 - self.budget * Q
        h = grams(codes)
        at = np.flatnonzero(h != 0)
        item = np.searchsorted(ends, at, side="right")
        order = np.argsort(h[at], kind="stable")
        hashes, item = h[at][order], item[order]
        offset = (at[order] - starts[item]) if len(at) else at
        keep = _spaced(item, hashes, offset, 2 * self.budget[item] + 1)
        self.hash, self.item, self.offset = hashes[keep], item[keep], offset[keep]
        self.maybe = np.zeros(1 << SLOTS, bool)
        self.maybe[slot(self.hash)] = True

    def _cells(self, at: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, band, count) for the text places ``at`` of one text, whose q-grams have n postings from lo on; a place counts once in a band."""
        place = np.repeat(at, n)
        post = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        item = self.item[post]
        # bands of 4 k + 2 diagonals that start at every 2 k + 1 hold each run of 2 k + 1 diagonals whole
        band = (place - self.offset[post]) // (2 * self.budget[item] + 1)
        if len(post) > 1:
            new = np.ones(len(post), bool)
            new[1:] = (place[1:] != place[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])
            item, band = item[new], band[new]
        order = np.lexsort((band, item))
        item, band = item[order], band[order]
        first = np.ones(len(item), bool)
        first[1:] = (item[1:] != item[:-1]) | (band[1:] != band[:-1])
        begin = np.flatnonzero(first)
        return item[begin], band[begin], np.diff(np.append(begin, len(item)))

    def regions(self, codes: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, lowest diagonal, highest, count) of the bands with enough shared q-grams; a diagonal is the text's place (in codes) less the item's.

        Texts go one by one where they share q-grams, and a text's postings by
        POSTINGS at most, so that frequent q-grams cost time, not memory.
        """
        h = grams(codes)
        at = np.flatnonzero(self.maybe[slot(h)])
        at = at[h[at] != 0]
        lo, hi = np.searchsorted(self.hash, h[at]), np.searchsorted(self.hash, h[at], side="right")
        n = hi - lo
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        out: list[tuple[int, int, int, int, int]] = []
        if not len(at):
            return out
        text = np.searchsorted(ends, at, side="right")
        cuts = np.append(np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1]))), len(at))
        least = self.bound[self.bound > 0].min()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a < least:
                continue  # a place counts once for an item's band, so no item can reach its bound
            parts = np.append(np.searchsorted(np.cumsum(n[a:b]) // POSTINGS, np.arange((int(n[a:b].sum()) // POSTINGS) + 1)), b - a) + a
            held = [self._cells(at[x:y], lo[x:y], n[x:y]) for x, y in zip(parts[:-1], parts[1:], strict=True) if y > x]
            item, band, count = held[0]
            if len(held) > 1:
                item, band, count = (np.concatenate(x) for x in zip(*held, strict=True))
                order = np.lexsort((band, item))
                item, band, count = item[order], band[order], count[order]
                begin = np.flatnonzero(np.concatenate(([True], (item[1:] != item[:-1]) | (band[1:] != band[:-1]))))
                item, band, count = item[begin], band[begin], np.add.reduceat(count, begin)
            # band b counts what falls to b and to b + 1; the one before the first of a run counts that alone
            follows = np.append((item[1:] == item[:-1]) & (band[1:] == band[:-1] + 1), False)
            pair = count + np.where(follows, np.append(count[1:], 0), 0)
            leads = ~np.concatenate(([False], follows[:-1]))
            item, band, pair = np.append(item, item[leads]), np.append(band, band[leads] - 1), np.append(pair, count[leads])
            good = np.flatnonzero(pair >= self.bound[item])
            for k in good[np.lexsort((band[good], item[good]))].tolist():
                i, step = int(item[k]), 2 * int(self.budget[item[k]]) + 1
                out.append((int(text[a]), i, int(band[k]) * step, (int(band[k]) + 2) * step - 1, int(pair[k])))
        return out

    def search(self, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        """For each text its matches (item id, start, end, edits), in source characters; the best of each item."""
        codes, starts, ends, (keep, first, last) = normal(texts)
        best: list[dict[int, tuple]] = [{} for _ in texts]
        for t, i, low, high, shared in self.regions(codes, ends):
            old = best[t].get(i)
            k = old[0] - 1 if old else int(self.budget[i])
            if k < 0 or shared < len(self.items[i]) - Q + 1 - k * Q:
                continue  # nothing closer than what is known can be here
            found = nearest(self.items[i], codes, int(starts[t]), int(ends[t]), low, high, k)
            if found:
                d, s, e = found
                place = np.flatnonzero(keep[first[t] : last[t]])
                s, e = s - int(starts[t]), e - int(starts[t])
                best[t][i] = (d, int(place[s]), int(place[e - 1]) + 1)
        return [[(self.ids[i], s, e, d) for i, (d, s, e) in sorted(x.items())] for x in best]


def nearest(item: np.ndarray, codes: np.ndarray, start: int, end: int, low: int, high: int, k: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the part of codes[start:end] closest to the item on the diagonals low to high, if within k edits.

    First the equal part; else alignment row by row, a row for each character
    of the item and a cell for each diagonal: time and memory follow the band,
    not the text.  Within a row, insertions are a running minimum.  Of equal
    costs the later start, then the earlier end is given.
    """
    m, width = len(item), high - low + 1
    a, b = max(start, low), min(end, high + m + 1)
    if b - a < m - k:
        return None
    raw, part = codes[a:b].tobytes(), item.tobytes()
    at = raw.find(part)
    while at >= 0 and at % 4:
        at = raw.find(part, at + 1)
    if at >= 0:
        return 0, a + at // 4, a + at // 4 + m
    if not k:
        return None
    # the characters that row i meets on diagonal d stand at d + i - 1; those outside the text fit nothing and cannot be read
    seen = np.zeros(width + m, np.uint32)
    seen[max(a - low, 0) : max(b - low, 0)] = codes[a:b]
    outside = np.ones(width + m, bool)
    outside[max(a - low, 0) : max(b - low, 0)] = False
    scale = np.int64(width + 1)  # cost and start travel in one number: ties prefer the later start
    never = scale << np.int64(40)
    steps = np.arange(width, dtype=np.int64) * scale
    row = np.arange(width, 0, -1, dtype=np.int64)  # cost 0, start = low + width - row
    places = low + np.arange(width)
    row[(places < start) | (places > end)] = never
    for i, c in enumerate(item, 1):
        new = row + np.where(outside[i - 1 : i - 1 + width], never, scale * (seen[i - 1 : i - 1 + width] != c))
        np.minimum(new[:-1], row[1:] + scale, out=new[:-1])
        row = np.minimum.accumulate(new - steps) + steps
        row[max(end - low - i + 1, 0) :] = never
        if row.min() // scale > k:
            return None
    d = int(np.argmin(row // scale))
    cost, back = divmod(int(row[d]), int(scale))
    return (cost, low + width - back, low + d + m) if cost <= k else None


def blocks(benchmark: DataFrame, block_chars: int) -> list[DataFrame]:
    """The items in parts of about ``block_chars`` characters at most."""
    total = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // block_chars) or 1
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) if n > 1 else items for i in range(n)]


def _sent(docs: DataFrame, part: DataFrame, edits: float):
    """A block's items, sent to the tasks: one block at a time is in the driver's memory, the others are files of its broadcasts."""
    rows = sorted((r["item_id"], r["text"]) for r in part.collect())
    return docs.sparkSession.sparkContext.broadcast(rows), edits


def find(docs: DataFrame, benchmark: DataFrame, edits: float = 0.1, block_chars: int = 4_000_000) -> DataFrame:
    """(doc_id, item_id, match_start, match_end, edits) for each item that a row of docs holds.

    Only contaminated rows appear.  Null and empty texts hold nothing; items
    of fewer than 8 letters and digits are too short to tell and match
    nothing.  Of an item's places in a text the closest, then the first in
    the text's order of bands is given.  Rows that repeat are reported each.
    """
    out = None
    for part in blocks(benchmark, block_chars):
        sent, share = _sent(docs, part, edits)

        def work(sent=sent, share=share):
            known = Benchmark(sent.value, share)

            def each(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
                found = known.search(texts)
                row = [i for i, x in enumerate(found) for _ in x]
                flat = [y for x in found for y in x]
                ids = batch.column("doc_id").take(pa.array(row, pa.int64()))
                return pa.RecordBatch.from_arrays([ids, *[pa.array([y[k] for y in flat], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int32()))]], ["doc_id", "item_id", "match_start", "match_end", "edits"])

            return each

        rows = map_texts(docs.select(F.col("doc_id").cast("long"), "text"), work, "doc_id long, item_id long, match_start long, match_end long, edits int")
        out = rows if out is None else out.unionByName(rows)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, edits: float = 0.1, block_chars: int = 4_000_000) -> DataFrame:
    """The rows of docs, with its columns, that hold no item."""
    for part in blocks(benchmark, block_chars):
        sent, share = _sent(docs, part, edits)

        def work(sent=sent, share=share):
            known = Benchmark(sent.value, share)
            return lambda batch, texts: batch.filter(pa.array([not x for x in known.search(texts)], pa.bool_()))

        docs = map_texts(docs, work, docs.schema)
    return docs
