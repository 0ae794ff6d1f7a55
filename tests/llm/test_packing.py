"""Packing: order of rows, the tree against packing without bounds, ids."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from metricloom.llm import packing
from metricloom.llm.queries import tokenizer_path


def packed(docs, **how):
    out = packing.pack(docs, tokenizer_path(), **how).toPandas()
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert (s.offset.values == np.cumsum([0, *s.length.values[:-1]])).all() and s.length.sum() <= how["capacity"]
    return out


def test_sequences_do_not_depend_on_the_order_of_rows(spark):
    # a word a token: 300 long and 300 short documents, by length over the partitions and shuffled
    rows = [(i, "\n" * n) for i, n in enumerate([149] * 300 + [49] * 300)]
    ids = packing.tokenizer(tokenizer_path())
    lengths = [len(ids(t)) + 1 for _, t in rows]
    capacity = max(lengths) + min(lengths) + 2
    least = -(-sum(lengths) // capacity)
    counts = []
    for order in (rows, random.Random(1).sample(rows, len(rows))):
        docs = spark.createDataFrame(order, "doc_id long, text string").coalesce(4)
        out = packed(docs, capacity=capacity, slack=1, group=50)
        assert len(out) == 600 and out.length.sum() == sum(lengths)
        counts.append(out.sequence_id.nunique())
    assert max(counts) <= 1.01 * min(counts) and min(counts) >= least


def merged(sizes, parts, capacity, carry):
    """The number of bins of a tree of groups, with at most ``carry`` bins that go up from a node."""
    groups = [sizes[i::parts] for i in range(parts)]
    tables = [pa.table({"doc_id": np.arange(len(g)), "piece": np.zeros(len(g), np.int32), "start": np.zeros(len(g), np.int64), "length": np.array(g, np.int32), "ids_crc32": np.zeros(len(g), np.int64)}) for g in groups]
    nodes = [packing._packed(t, np.arange(t.num_rows), np.zeros(t.num_rows, np.int64), i, capacity, 4, carry) for i, t in enumerate(tables)]
    total = 0
    while len(nodes) > 1:
        up = []
        for k in range(0, len(nodes), packing.FAN_IN):
            opened = []
            for x in nodes[k : k + packing.FAN_IN]:
                b, o = x["bin"].to_numpy(), x["open"].to_numpy()
                total += len(np.unique(b[~o]))
                opened.append(x.filter(pa.array(o)))
            rows = pa.concat_tables(opened)
            part, b = rows["part"].to_numpy(), rows["bin"].to_numpy()
            item = np.unique(part.astype(np.int64) << 32 | b, return_inverse=True)[1]
            up.append(packing._packed(rows, item, rows["at"].to_numpy(), k // packing.FAN_IN, capacity, 4, carry))
        nodes = up
    return total + len(np.unique(nodes[0]["bin"].to_numpy()))


def test_what_stays_below_in_the_tree_costs_no_sequence():
    rng = random.Random(2)
    for kind in range(6):
        draw = [lambda: rng.randrange(1, 100), lambda: rng.randrange(51, 100), lambda: rng.choice([10, 60, 95]), lambda: rng.randrange(40, 60), lambda: 34, lambda: rng.choice([51, 49, 52])][kind]
        sizes = [draw() for _ in range(3000)]
        assert merged(sizes, 64, 100, packing.FAN_IN * 3) == merged(sizes, 64, 100, 10**6)


def test_best_fit_leaves_at_most_one_bin_half_full():
    rng = random.Random(3)
    for _ in range(200):
        sizes = [rng.randrange(1, 100) for _ in range(rng.randrange(1, 80))]
        fills = [sum(sizes[i] for i in b) for b in packing.best_fit(sizes, 100)]
        assert sum(f <= 50 for f in fills) <= 1 and sum(fills) == sum(sizes) and max(fills) <= 100


def test_ids_beyond_doubles_nulls_and_repeats_stay_apart(spark):
    big = 2**62 + 1
    rows = [(big, "a"), (big, "a"), (None, "b"), (None, None), (3, ""), (4, "long text " * 500)]
    out = packed(spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, part int, at int").repartition(3), capacity=64, group=4)
    assert sorted(out[out.piece == 0].doc_id.fillna(-1).tolist()) == sorted([float(big), float(big), -1, -1, 3, 4])
    ids = [r.doc_id for r in packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_path(), capacity=64, group=4).collect()]
    assert ids.count(big) == 2 and ids.count(None) == 2 and ids.count(4) > 10
