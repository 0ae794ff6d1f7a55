"""SimHash components against all pairs, and that the masks cover."""

from __future__ import annotations

import collections
import itertools
import random

import numpy as np
import pytest
import xxhash

from metricloom.llm import simhash

SCHEMA = "doc_id long, text string, f long, fingerprint int"


def print_of(text):
    words = [w for w in "".join(c if c not in " \t\n\x0b\f\r" else " " for c in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")).split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def components(prints, radius):
    """Least position reachable, by all pairs."""
    root = list(range(len(prints)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= radius:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_masks_cover_every_pair_within_the_radius(radius):
    masks, rng = simhash.masks(radius), random.Random(radius)
    assert len(masks) == 2 ** (radius + 1) - 1 and all(20 < m.bit_count() < 48 for m in masks)
    sets = itertools.combinations(range(64), radius) if radius < 4 else (rng.sample(range(64), radius) for _ in range(20_000))
    for bits in sets:
        apart = sum(1 << b for b in bits)
        assert any(not m & apart for m in masks)


def texts_of(rng, n):
    words = [f"w{i}" for i in range(300)]
    out = []
    for _ in range(n):
        t = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 8, 200]))]
        out += [" ".join(t)] * rng.choice([1, 1, 3])
        for _ in range(rng.randrange(6)):
            if len(t) > 50:
                t = t[:]
                t[rng.randrange(len(t))] = rng.choice(words)
                out.append(" ".join(t))
    return out


def test_components_against_all_pairs(spark):
    rng = random.Random(3)
    texts = texts_of(rng, 60) + [None, "", " \n ", "One", "one", "ONE two", "Ünï Code\x0btext", "\x1c", "a\x1cb c"]
    rows = [(i, t, 9, 9) for i, t in enumerate(texts)]
    got = sorted(map(tuple, simhash.classes(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()))
    prints = [print_of(t) for t in texts]
    assert got == [(i, f"{p:016x}", c) for i, (p, c) in enumerate(zip(prints, components(prints, 3), strict=True))]
    assert len({c for *_, c in got}) < len(set(prints))


@pytest.mark.parametrize("block", [4, 2048])
def test_hot_buckets_of_fingerprints_that_no_leader_connects(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(5)
    prints = set()
    for _ in range(3):  # chains and clouds around three points
        at = rng.getrandbits(64)
        for _ in range(80):
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 4])):
                at ^= 1 << b
            prints.add(at)
        prints |= {at ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7))) for _ in range(80)}
    prints = sorted(prints)
    # all within a few bits of each other: one bucket of many fingerprints, components of all sizes
    tight = [x ^ y for x in (0, 0b1111 << 10, 0b1111 << 30) for y in (0, 1, 3, 7, 15, 31)]
    prints = sorted({*prints, *tight})
    df = spark.createDataFrame([(simhash.signed(p),) for p in prints], "f long").repartition(3)
    root = {r.node: r.root for r in simhash.connected(df).collect()}
    got = collections.defaultdict(set)
    for p in prints:
        got[root.get(simhash.signed(p), simhash.signed(p))].add(p)
    want = collections.defaultdict(set)
    for p, c in zip(prints, components(prints, 3), strict=True):
        want[c].add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_edges_of_the_table(spark):
    same = "a b c d e f g"
    rows = [(None, same), (7, same), (7, same), (7, "quite another text of words"), (9, None), (4, ""), (None, "only null ids have this text")]
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    f = lambda t: f"{print_of(t):016x}"
    want = [(None, f(same), 7), (7, f(same), 7), (7, f(same), 7), (7, f(rows[3][1]), 7), (9, "0" * 16, 4), (4, "0" * 16, 4), (None, f(rows[6][1]), None)]
    assert got == sorted(want, key=repr)
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id for r in kept), key=repr) == [4, 7, None, None]
    assert simhash.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_texts_count_in_pieces(monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choice(["aé ", "B\n", "long-word\t", "x", "  "]) for _ in range(3000))
    want = simhash.fingerprint(text)
    assert want == print_of(text)
    for piece in (1, 2, 7, 100):
        monkeypatch.setattr(simhash, "PIECE", piece)
        assert simhash.fingerprint(text) == want
    assert simhash.fingerprint("word " * 300_000) == print_of("word word word")
    assert np.array_equal(simhash.set_bits([3, 1]), [2, 1] + [0] * 62)
