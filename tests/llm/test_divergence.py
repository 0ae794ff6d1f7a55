"""The divergence audit against loops over whole numbers."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pytest

from metricloom.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, count int, rank int"


def by_loops(rows, least, top=10):
    docs = [(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")), la or "", s or "") for t, la, s in rows]
    out = []
    for lang in {d[1] for d in docs}:
        mine = [d for d in docs if d[1] == lang]
        held = collections.Counter(t for d in mine for t in set(d[0]))
        kept = [t for t, n in held.items() if n >= least]
        counts = {s: collections.Counter(t for d in mine if d[2] == s for t in d[0]) for s in {d[2] for d in mine}}
        whole = collections.Counter(t for d in mine for t in d[0])

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in counts if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                for k, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, k))
    return sorted(out)


def rows_of(seed, n, sources, words):
    rng = random.Random(seed)
    vocabulary = [rng.choice(["Wort", "élan", "x", "ÉÜ", "naïve", "中文"]) + chr(97 + i % 26) * (i // 26 + 1) for i in range(words)]
    out = []
    for _ in range(n):
        s = 0 if rng.random() < 0.3 else rng.randrange(sources)
        own = vocabulary[s % 7 :: 3] + vocabulary[:5]
        out.append((rng.choice([" ", "-", "1 "]).join(rng.choice(own) for _ in range(rng.randrange(30))), rng.choice(["de", "en", None]), f"s{s}"))
    return out + [(None, "en", "s1"), ("", "en", None), ("lonely words", "fr", "s1"), ("none kept", "xx", "a"), ("nor here", "xx", "b"), ("12 34", "yy", "é"), ("", "yy", "z"), ("tie", "en", "s1"), ("tie", "en", "s1")]


@pytest.mark.parametrize("sources, height, size", [(5, 64, 1 << 16), (9, 4, 50), (23, 5, 200), (3, 1, 10)])
def test_equals_loops(spark, sources, height, size):
    rows = rows_of(sources, 250, sources, 40)
    df = spark.createDataFrame([(i, *r, "t", 1, 2) for i, r in enumerate(rows)], SCHEMA).repartition(6)
    got = sorted(map(tuple, divergence.audit(df, least_docs=4, height=height, size=size).collect()))
    want = by_loops(rows, 4)
    assert got == want
    assert {w[2] for w in want} == {"pair", "term"} and 0 in {w[4] for w in want}


def test_repeated_rows_count_again_and_edges(spark):
    rows = [("a b", "en", "s")] * 9 + [("a b c", "en", "t")]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert sorted(map(tuple, divergence.audit(df).collect())) == by_loops(rows, 10)
    assert divergence.audit(df.limit(0)).count() == 0
    assert [tuple(r) for r in divergence.audit(df.where("source = 't'")).collect()] == []


def test_terms_come_in_pieces(monkeypatch):
    text = "aÉé Bc,d\n" * 50 + "x" * 40
    want = [t for part in divergence.terms(text) for t in part]
    assert want[:3] == ["aÉé".encode(), b"bc", b"d"]
    for piece in (1, 3, 10):
        monkeypatch.setattr(divergence, "PIECE", piece)
        assert [t for part in divergence.terms(text) for t in part] == want


@pytest.mark.parametrize("same", [True, False])
def test_quadtree_sums_against_dense_ones(monkeypatch, same):
    rng = np.random.default_rng(4)
    for step, na, nb, columns, filled in ((1 << 16, 7, 5, 300, 0.05), (10, 6, 9, 40, 0.3), (1, 3, 2, 1, 1.0), (100, 5, 4, 17, 0.0)):
        monkeypatch.setattr(divergence, "STEP", step)
        nb = na if same else nb
        levels = max(columns - 1, na - 1, nb - 1, 1).bit_length()
        zero = [rng.integers(1, 1000, n) for n in (na, nb)]
        there = [rng.random((n, columns)) < filled for n in (na, nb)]
        value = [rng.integers(1, 10**9, (n, columns)) for n in (na, nb)]
        if same:
            zero, there, value = ([x[0]] * 2 for x in (zero, there, value))
        trees = [divergence.Tree(*np.nonzero(t), v[t], levels) for t, v in zip(there, value, strict=True)]
        p, q = (np.where(t, v, z[:, None]).astype(object) for t, v, z in zip(there, value, zero, strict=True))
        want = np.array([[sum((x - y) ** 2 // (x + y) for x, y in zip(a, b, strict=True)) for b in q] for a in p], dtype=object)
        got = divergence.pair_sums(*trees, *zero, columns, levels, same)
        keep = np.triu(np.ones((na, nb), bool), 1) if same else np.ones((na, nb), bool)
        assert (got[keep] == want[keep]).all()
