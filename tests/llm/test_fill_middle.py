"""Fill-in-the-middle against loops, and its edge cases."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from metricloom.llm import fill_middle

SCHEMA = "doc_id long, text string, form string, n int"


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def by_loops(doc_id, text, rate=90, spm=20, seed=1):
    text = text or ""
    parts = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    h = [int(sha(f"{seed}:{'' if doc_id is None else doc_id}")[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(parts) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (parts[:a], parts[a:b], parts[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, len(parts), "plain", None, None, text
    if h[3] % 100 < spm:
        return doc_id, len(parts), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(parts), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_equals_loops_and_reads_back(spark):
    rng = random.Random(1)
    pieces = ["a", "Word", "é", "\n", "\r\n", " ", "$1", "\\", "😀", "<", "<S", ">", "S>", "\x00", "{", "}", "ß", "0", " ", "P", "M>"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 40))) for _ in range(1500)]
    texts += [None, "", "a<P>b", "x<S>", "<M>", "z", "\n", "$", "ab\n"]
    rows = [(i, x, "clash", 7) for i, x in enumerate(texts)] + [(None, "null id here", "c", 1), (5, texts[5], "c", 1), (5, "another text", "c", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = fill_middle.transform(df)
    want = [by_loops(i, x) for i, x, *_ in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert {w[2] for w in want} == {"plain", "spm", "psm"}
    out = fill_middle.digests(df).collect()
    assert sorted((r.output_sha256, r.restored_sha256) for r in out) == sorted((sha(w[5]), sha(x or "")) for w, (_, x, *_) in zip(want, rows, strict=True))
    assert fill_middle.digests(df.limit(0)).count() == 0
    assert {r.form for r in fill_middle.transform(df, rate=100, suffix_first=100).collect()} == {"plain", "spm"}


@pytest.mark.parametrize("text", ["a b\n" * 500_000, "x" * 3_000_000, "\n" * 1_000_000, "é!" * 700_000])
def test_long_texts(spark, text):
    df = spark.createDataFrame([(i, text) for i in (1, 2, 4, 8)], "doc_id long, text string").repartition(4)
    want = sorted((w[0], w[1], w[2], w[3], w[4], sha(w[5]), sha(text)) for w in (by_loops(i, text) for i in (1, 2, 4, 8)))
    assert sorted(map(tuple, fill_middle.digests(df).collect())) == want


def test_both_ways_of_counting_agree(spark):
    df = spark.createDataFrame([("abc d1\n\né😀z",), ("",), ("\x00\r\n",), ("ABC",)], "t string")
    got = df.select(fill_middle.units(F.col("t")).alias("a"), fill_middle.units(F.col("t"), -1).alias("b")).collect()
    assert [tuple(r) for r in got] == [(9, 9), (0, 0), (3, 3), (1, 1)]
