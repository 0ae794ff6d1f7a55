"""Near-duplicate classes by consistent weighted sampling over TF-IDF shingles.

1. Shingles are five successive words (letters and digits, lower case).  Their
   document frequencies are counted over all documents in a hashed array of
   fixed size; what other shingles add to a slot on average is taken off.  A
   shingle weighs its count in the text times its damped inverse document
   frequency, (1 + log((1 + n) / (1 + df))) ** DAMPING.
2. Improved consistent weighted sampling draws for each text samples that
   agree between two texts with a probability equal to their weighted Jaccard
   similarity.  Bands of three samples put texts into buckets.
3. Equal texts are one from the start.  In each bucket every text is compared
   to the bucket's leader, the text whose shingles are the most frequent on
   average (the origin of a group of copies has more of them than any copy).
4. Texts connected so far are components.  A bucket whose texts are all of one
   component is done; in the others, texts outside the leader's component are
   compared to those of other components and of a total weight within the
   threshold of their own, in blocks of bounded size.
5. Similarity is the exact weighted Jaccard similarity of the two whole texts.
   Connected texts become classes.

No step emits all pairs of a large group, and only the array of frequencies,
of fixed size, is sent to the tasks.  Rows of a hot bucket or class are dealt
over SALTS tasks for each join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.codes import encode, mix, owners, words
from metricloom.llm.common import checkpointed, map_texts, slices

WORDS = 5
SLOTS = 20  # bits of the array of document frequencies
BLOCK = 14  # bits of a part of it that travels as one row
BANDS, ROWS = 10, 3
#: Undamped weights let a few edited words outweigh all that the copies of a large group share.
DAMPING = 0.25
BLOCK_TEXTS = 128
SALTS = 8
#: About so many members of a bucket meet one copy of their leader's text.
LED_ROWS = 64
#: Candidate ids up to this number are broadcast to pick their texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle, count), ascending by text, for the distinct shingles of each text.

    A text of fewer words than a shingle has one shingle of all its words; a
    text without words has none.
    """
    codes, _, ends = encode(texts)
    starts, _, h = words(codes)
    row = owners(starts, ends)
    n = np.bincount(row, minlength=len(texts))
    first = np.cumsum(n) - n
    total = np.zeros(len(h), np.uint64)
    left = (first + n)[row] - np.arange(len(h))  # words from here to the text's end
    for k in range(WORDS):
        moved = np.zeros(len(h), np.uint64)
        moved[: len(h) - k] = h[k:] if k else h
        moved[left <= k] = 0
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + moved)
    keep = (left >= WORDS) | (np.arange(len(h)) == first[row])
    # the text in the top bits and 44 bits of the hash are one sortable number
    key = (row[keep].astype(np.uint64) << np.uint64(44)) | (total[keep] >> np.uint64(20))
    unique, count = np.unique(key, return_counts=True)
    return (unique >> np.uint64(44)).astype(np.int64), unique & np.uint64((1 << 44) - 1), count


def slot(shingle: np.ndarray) -> np.ndarray:
    return (mix(shingle) >> np.uint64(64 - SLOTS)).astype(np.int64)


def frequencies(docs: DataFrame, text: str) -> np.ndarray:
    """The idf weight and the document frequency of each slot.  One row for each part of the array comes to the driver, whatever the input."""
    parts = 1 << (SLOTS - BLOCK)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, seen = np.zeros(1 << SLOTS, np.int64), 0, 0
        for batch in batches:
            for _, texts in slices(batch, text):
                s = shingles(texts)[1]
                total += np.bincount(slot(s), minlength=1 << SLOTS)
                n, seen = n + len(texts), seen + len(s)
        if n:
            rows = total.astype("<i4").reshape(parts, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([n] * parts, pa.int64()), pa.array([seen] * parts, pa.int64()), pa.array([np.ascontiguousarray(r).tobytes() for r in rows], pa.binary())], ["part", "n", "seen", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for part, n, seen, counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                wide = np.frombuffer(counts, "<i4" if len(counts) == 4 << BLOCK else "<i8").astype(np.int64)
                if part in sums:
                    old = sums[part]
                    sums[part] = [old[0] + n, old[1] + seen, old[2] + wide]
                else:
                    sums[part] = [n, seen, wide]
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x[0] for x in sums.values()], pa.int64()), pa.array([x[1] for x in sums.values()], pa.int64()), pa.array([x[2].astype("<i8").tobytes() for x in sums.values()], pa.binary())], ["part", "n", "seen", "counts"])

    schema = "part int, n long, seen long, counts binary"
    rows = docs.select(text).mapInArrow(count, schema).repartition(parts, "part").mapInArrow(add, schema).collect()
    counts = np.zeros(1 << SLOTS)
    n = rows[0]["n"] if rows else 0
    seen = rows[0]["seen"] if rows else 0
    for r in rows:
        counts[r["part"] << BLOCK : (r["part"] + 1) << BLOCK] = np.frombuffer(r["counts"], "<i8")
    df = np.maximum(counts - seen / (1 << SLOTS), 1)
    return np.stack([(1 + np.log((1 + n) / (1 + df))).clip(0.1) ** DAMPING, df]).astype(np.float32)


def _draws() -> tuple[np.ndarray, np.ndarray]:
    """Tables of the sampling scheme's two Gamma(2, 1) variables: one as it is, of the other the logarithm."""
    rng = np.random.default_rng(20)
    return rng.gamma(2, 1, 1 << 14).astype(np.float32), np.log(rng.gamma(2, 1, 1 << 14)).astype(np.float32)


def signatures(texts: list[str], idf: np.ndarray, draws: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(texts x bands) hashes, the mean frequency of each text's shingles, and their total weight (0 without any)."""
    row, s, count = shingles(texts)
    sizes = np.bincount(row, minlength=len(texts))
    full = sizes > 0
    out = np.zeros((len(texts), BANDS), np.int64)
    centre = np.zeros(len(texts), np.float32)
    if not len(s):
        return out, centre, np.zeros(len(texts))
    at = slot(s)
    weight = count * idf[0][at].astype(np.float64)
    total = np.bincount(row, weight, len(texts))
    log_weight = np.log(weight).astype(np.float32)
    centre = (np.bincount(row, idf[1][at], len(texts)) / np.maximum(sizes, 1)).astype(np.float32)
    begin = (np.cumsum(sizes) - sizes)[full]
    lengths = sizes[full]
    gamma, log_gamma = draws
    index = np.arange(len(s))
    for band in range(BANDS):
        h = np.zeros(len(lengths), np.uint64)
        for k in range(ROWS):
            u = mix(s + np.uint64((band * ROWS + k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
            r = gamma[(u & np.uint64(0x3FFF)).astype(np.int64)]
            beta = (u >> np.uint64(40)).astype(np.float32) * np.float32(2**-24)
            t = np.floor(log_weight / r + beta)
            a = log_gamma[((u >> np.uint64(14)) & np.uint64(0x3FFF)).astype(np.int64)] - r * (t - beta + 1)
            least = np.minimum.reduceat(a, begin)
            hit = np.flatnonzero(a == np.repeat(least, lengths))
            which = hit[np.searchsorted(hit, begin)]  # the first of equal ones
            h = mix(h * np.uint64(31) + s[index[which]] + (t[which].astype(np.int64).astype(np.uint64) << np.uint64(45)))
        out[full, band] = h.view(np.int64)
    return out, centre, total


class Weights:
    """Weighted shingle sets of texts, and their similarity."""

    def __init__(self, idf: np.ndarray):
        self.idf = idf

    def sets(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        row, s, count = shingles(texts)
        w = count * self.idf[0][slot(s)].astype(np.float64)
        cut = np.searchsorted(row, np.arange(len(texts) + 1))
        return [(s[a:b], w[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]

    @staticmethod
    def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
        if not len(a[0]) or not len(b[0]):
            return 0.0
        at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
        both = b[0][at] == a[0]
        least = np.minimum(a[1][both], b[1][at[both]]).sum()
        return float(least / (a[1].sum() + b[1].sum() - least))


def dealt_join(rows: DataFrame, few: DataFrame, keys: list[str], deal: str, how: str = "inner") -> DataFrame:
    """rows joined to few, which has one row for each key: few is repeated SALTS times, and a hot key's rows are dealt over that many tasks."""
    few = few.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt_", F.pmod(F.xxhash64(deal, F.lit(7)), F.lit(SALTS)).cast("int"))
    return rows.join(few, [*keys, "salt_"], how).drop("salt_")


def _led(members: DataFrame) -> DataFrame:
    """Buckets of two texts or more: a row (a, b, total, band, value, n) for each member a, with the leader b."""
    lead = members.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n"), F.max_by("t", "centre").alias("b")).where("n > 1")
    return dealt_join(members, lead, ["band", "value"], "t").select(F.col("t").alias("a"), "b", "total", "band", "value", "n")


class _Block:
    """Some texts' weighted shingles, as one inverted index."""

    def __init__(self, sets: list[tuple[np.ndarray, np.ndarray]]):
        self.n = len(sets)
        s = np.concatenate([x[0] for x in sets])
        order = np.argsort(s, kind="stable")
        self.s, self.w = s[order], np.concatenate([x[1] for x in sets])[order]
        self.d = np.repeat(np.arange(self.n), [len(x[0]) for x in sets])[order]
        self.total = np.array([x[1].sum() for x in sets])

    def similarities(self, x: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        lo, hi = np.searchsorted(self.s, x[0]), np.searchsorted(self.s, x[0], side="right")
        n = hi - lo
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        least = np.bincount(self.d[at], np.minimum(self.w[at], np.repeat(x[1], n)), self.n)
        return least / (x[1].sum() + self.total - least)


def _within(led: DataFrame, roots: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """Links (a, b) between components that meet in a bucket; roots holds (node, root) for what is connected so far.

    Texts outside the leader's component are the left side, all texts of the
    bucket the right.  Alike texts have totals within the threshold of each
    other, so sides meet by classes of totals, own or next.  Both are dealt
    into blocks; a pair of blocks is one group of about twice BLOCK_TEXTS
    texts at most.
    """
    bucket = ["band", "value"]
    known = led.join(roots, F.col("a") == F.col("node"), "left").select("a", "total", *bucket, F.coalesce("root", "a").alias("own"), (F.col("a") == F.col("b")).alias("leads"))
    mixed = known.groupBy(*bucket).agg(F.min("own").alias("low"), F.max("own").alias("high"), F.max(F.when(F.col("leads"), F.col("own"))).alias("first")).where("low <> high").select(*bucket, "first")
    rows = checkpointed(dealt_join(known, mixed, bucket, "a").withColumn("size", F.floor(F.log("total") / (1e-3 - np.log(threshold))).cast("int")))
    if rows.isEmpty():
        return rows.select("a", F.col("own").alias("b")).limit(0)
    left = rows.where("own <> first")
    right = rows.withColumn("size", F.explode(F.array(*[F.col("size") + i for i in (-1, 0, 1)])))
    m = left.groupBy(*bucket, "size").agg(F.count(F.lit(1)).alias("m"))
    right = dealt_join(right, m, [*bucket, "size"], "a")
    n = right.groupBy(*bucket, "size").agg(F.count(F.lit(1)).alias("n"))
    left = dealt_join(dealt_join(left, m, [*bucket, "size"], "a"), n, [*bucket, "size"], "a")
    right = dealt_join(right, n, [*bucket, "size"], "a")

    def blocks(c: str):
        return F.ceil(F.col(c) / BLOCK_TEXTS).cast("int")

    def one(c: str):
        return F.pmod(F.xxhash64("a", F.lit(c)), blocks(c)).cast("int")

    def every(c: str):
        return F.explode(F.sequence(F.lit(0), blocks(c) - 1))

    cell = [F.col("a").alias("t"), *bucket, "size", "own"]
    dealt = left.select(*cell, one("m").alias("i"), every("n").alias("j"), F.lit(True).alias("left"))
    dealt = dealt.unionByName(right.select(*cell, every("m").alias("i"), one("n").alias("j"), F.lit(False).alias("left"))).join(texts, "t")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        weights = Weights(idf.value)
        x, y = rows[rows["left"]], rows[~rows["left"]]
        out: list[tuple[int, int]] = []
        if len(x) and len(y):
            root: dict[int, int] = {}

            def find(v: int) -> int:
                while root.get(v, v) != v:
                    root[v] = root.get(root[v], root[v])
                    v = root[v]
                return v

            names = y["own"].to_numpy()
            block = _Block([z for i in range(0, len(y), 32) for z in weights.sets(y["text"].iloc[i : i + 32].tolist())])
            for a, text in zip(x["own"].tolist(), x["text"], strict=True):
                for k in np.flatnonzero((names != a) & (block.similarities(weights.sets([text])[0]) >= threshold)).tolist():
                    u, v = find(a), find(int(names[k]))
                    if u != v:
                        root[max(u, v)] = min(u, v)
                        out.append((a, int(names[k])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return dealt.groupBy(*bucket, "size", "i", "j").applyInPandas(compare, "a long, b long").distinct()


def _verified(texts: DataFrame, pairs: DataFrame, idf, threshold: float) -> DataFrame:
    """(a, b, alike) for distinct pairs (a, leader b, n members of their bucket); texts holds (t, text).

    A leader's text is repeated for every LED_ROWS members, which are dealt
    out among its copies: no task gathers all of a large group.
    """

    def work():
        weights = Weights(idf.value)

        def each(batch: pa.RecordBatch, left: list[str]) -> pa.RecordBatch:
            right = batch.column("text_b").to_pylist()
            names = dict.fromkeys(right)
            sets = dict(zip(names, weights.sets(list(names)), strict=True))
            ok = [weights.similarity(x, sets[y]) >= threshold for x, y in zip(weights.sets(left), right, strict=True)]
            return pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], ["a", "b", "alike"])

        return each

    a = texts.select(F.col("t").alias("a"), "text")
    parts = F.ceil(F.col("n") / LED_ROWS).cast("int")
    leaders = pairs.groupBy("b").agg(F.max("n").alias("n")).select("b", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    b = texts.select(F.col("t").alias("b"), F.col("text").alias("text_b")).join(leaders, "b")
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("a"), parts).cast("int").alias("part"))
    joined = dealt.join(a, "a").join(b, ["b", "part"]).select("a", "b", "text", "text_b")
    return map_texts(joined, work, "a long, b long, alike boolean")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each connected component of edges (a, b).

    Alternates two steps until nothing changes: every node hands the least
    node it knows to its larger, then to its smaller neighbours.  Both keep
    the graph's size and halve long chains.
    """
    pairs = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    last = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(pairs.join(least, "a").select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b")))
        pairs = checkpointed(small.where("a <> b").distinct())
        now = tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == last or not now[0]:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = now


def _same_id(docs: DataFrame, body: DataFrame, reps: DataFrame, key: str) -> DataFrame | None:
    """Links (a, b) between different texts that stand under one id; None where no id repeats."""
    often = docs.groupBy(F.col(key).cast("long").alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 AND id IS NOT NULL").select("id")
    often = checkpointed(often)
    if often.isEmpty():
        return None
    rows = dealt_join(body.select("id", "h1", "h2"), often, ["id"], "h1").distinct()
    named = checkpointed(rows.join(reps.select("h1", "h2", "t"), ["h1", "h2"]).select("id", "t"))
    least = named.groupBy("id").agg(F.min("t").alias("least"))
    return dealt_join(named, least, ["id"], "t").where("t <> least").select(F.col("t").alias("a"), F.col("least").alias("b"))


def classes(docs: DataFrame, threshold: float = 0.8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, class_id, copies) for each row of docs.

    class_id is the least doc_id of the texts that are connected by a
    similarity of at least ``threshold``; copies says in how many rows the
    row's own text stands, letter by letter.  A text without words is alike
    only to equal texts; null texts are classes of empty text.  Rows that
    repeat are copies.  doc_id names a document: rows that share one share a
    class, whatever their texts.  Classes whose ids are all null are named by
    a negative number.  An empty table gives no rows; other columns are not
    read.  Whole texts count, however long: a text is one row of a task.
    """
    h = [F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h1"), F.xxhash64(F.lit("second"), F.coalesce(F.col(text), F.lit(""))).alias("h2")]
    body = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *h)
    idf = docs.sparkSession.sparkContext.broadcast(frequencies(body, "text"))
    names = [f"v{i}" for i in range(BANDS)]

    def work():
        table, draws = idf.value, _draws()

        def each(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
            bands, centre, total = signatures(texts, table, draws)
            return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h1"), batch.column("h2"), pa.array(centre), pa.array(total), *[pa.array(np.ascontiguousarray(bands[:, i])) for i in range(BANDS)]], ["id", "h1", "h2", "centre", "total", *names])

        return each

    signed = map_texts(body, work, "id long, h1 long, h2 long, centre float, total double, " + ", ".join(f"{v} long" for v in names))
    firsts = [F.first(c).alias(c) for c in ("centre", "total", *names)]
    grouped = signed.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), *firsts)
    # t numbers the different texts; the checkpoint keeps the numbers as they are
    reps = checkpointed(grouped.withColumn("t", F.monotonically_increasing_id()))
    bands = F.explode(F.array(*[F.struct(F.lit(i).alias("band"), F.col(v).alias("value")) for i, v in enumerate(names)]))
    members = reps.where("total > 0").select("t", "centre", "total", bands.alias("x")).select("t", "centre", "total", "x.band", "x.value")
    led = checkpointed(_led(members))
    pairs = checkpointed(led.where("a <> b").groupBy("a", "b").agg(F.max("n").alias("n")))
    n = 2 * pairs.count()
    edges = _same_id(docs, body, reps, key)
    if n:
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("t")).distinct()
        wanted = reps.select("t", "h1", "h2", F.col("id").alias("first")).join(F.broadcast(wanted) if n <= BROADCAST_IDS else wanted, "t")
        found = body.join(F.broadcast(wanted) if n <= BROADCAST_IDS else wanted, ["h1", "h2"])
        # one row of each text, of those with its least id
        texts = found.where(F.col("id").eqNullSafe(F.col("first"))).select("t", "text").dropDuplicates(["t"])
        alike = _verified(texts, pairs, idf, threshold).where("alike").select("a", "b")
        edges = alike if edges is None else alike.unionByName(edges)
    named = reps.select("t", "h1", "h2", "id", "copies", F.col("t").alias("root"))
    if edges is not None:
        roots = components(edges)
        named = _rooted(named, roots)
        if n:
            more = components(_within(led, roots, texts, idf, threshold))
            named = _rooted(named, more)
    # a class is named by its least id, or a negative number where it has none
    own = F.coalesce("id", -1 - F.abs(F.col("h1") % (1 << 62)))
    called = named.groupBy("root").agg(F.coalesce(F.min("id"), F.min(own)).alias("name"), F.count(F.lit(1)).alias("n")).where("n > 1").select("root", "name")
    named = dealt_join(named, called, ["root"], "t", "left").select("h1", "h2", F.coalesce("name", own).alias("class_id"), "copies")
    return docs.select(F.col(key), *h).join(named, ["h1", "h2"]).select(key, "class_id", "copies")


def _rooted(named: DataFrame, roots: DataFrame) -> DataFrame:
    """named with each root replaced by the root that it got."""
    roots = roots.select(F.col("node").alias("root"), F.col("root").alias("to_"))
    return dealt_join(named, roots, ["root"], "t", "left").withColumn("root", F.coalesce("to_", "root")).drop("to_")


def keep_one(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """docs without the rows whose text is alike to one of a smaller id: one document of each class stays.

    Of rows that repeat an id, one stays; rows with a null id stay only if
    no row with an id is in their class.
    """
    found = checkpointed(classes(docs, threshold))
    kept = found.where(F.col("doc_id") == F.col("class_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_"))
    kept = checkpointed(kept)
    def rows_of(ids: DataFrame) -> DataFrame:
        ids = ids.select(F.col("doc_id").alias("kept_id"))
        return docs.join(ids, docs["doc_id"] == ids["kept_id"], "left_semi")

    out = rows_of(kept.where("n_ = 1"))
    if not kept.where("n_ > 1").isEmpty():
        out = out.unionByName(rows_of(kept.where("n_ > 1")).dropDuplicates(["doc_id"]))
    if not docs.where("doc_id IS NULL").isEmpty():
        alone = found.where("doc_id IS NULL AND class_id < 0").select("class_id").distinct()
        name = -1 - F.abs(F.xxhash64(F.coalesce(docs["text"], F.lit(""))) % (1 << 62))
        lone = docs.where("doc_id IS NULL")
        out = out.unionByName(lone.join(alone, name == alone["class_id"], "left_semi").dropDuplicates(["text"]))
    return out
