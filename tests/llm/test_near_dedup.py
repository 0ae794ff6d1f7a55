"""Near-duplicate classes: repeated ids, large mixed buckets, weights."""

from __future__ import annotations

import random

import numpy as np

from metricloom.llm import near_dedup


def words(rng, n: int) -> list[str]:
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def changed(rng, base: list[str], n: int) -> str:
    out = list(base)
    for p in rng.sample(range(len(base)), n):
        out[p] = f"x{rng.randrange(10**6)}"
    return " ".join(out)


def named(edges, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_different_texts_under_one_id_lose_no_link(spark):
    rng = random.Random(1)
    a, b = words(rng, 200), words(rng, 200)
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, changed(rng, a, 1)), (3, changed(rng, b, 1)), (4, " ".join(words(rng, 200))), (None, changed(rng, b, 1)), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id or 0, r.class_id) for r in near_dedup.classes(docs).collect())
    assert got == [(0, 1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (5, 4)]
    assert sorted(r.doc_id for r in near_dedup.keep_one(docs).collect()) == [1, 4]


def test_a_mixed_bucket_of_many_texts_against_all_pairs(spark):
    rng = random.Random(2)
    groups = [words(rng, n) for n in (60, 60, 90, 300)]
    texts = [changed(rng, groups[i % 4], rng.randrange(5)) for i in range(320)] + [" ".join(words(rng, 60)) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "t long, text string").repartition(5)
    idf = near_dedup.frequencies(docs, "text")
    weights = near_dedup.Weights(idf)
    sets = weights.sets(texts)
    led = spark.createDataFrame([(i, 0, float(x[1].sum()), 0, 0, len(texts)) for i, x in enumerate(sets)], "a long, b long, total double, band int, value long, n long")
    want = named([(i, j) for i in range(len(texts)) for j in range(i) if weights.similarity(sets[i], sets[j]) >= 0.8], range(len(texts)))
    assert 34 < len(set(want.values())) < 250
    for known in ([], [(4, 0), (8, 0), (5, 1)]):
        known = [(a, b) for a, b in known if want[a] == want[b]]
        roots = spark.createDataFrame(known, "node long, root long")
        edges = near_dedup._within(led, roots, docs, spark.sparkContext.broadcast(idf), 0.8)
        assert named([*known, *[tuple(r) for r in edges.collect()]], range(len(texts))) == want


def test_common_shingles_weigh_less_and_never_nothing(spark):
    rng = random.Random(3)
    shared = " ".join(words(rng, 20))
    docs = spark.createDataFrame([(i, f"{shared} {' '.join(words(rng, 20))}") for i in range(100)], "doc_id long, text string")
    idf = near_dedup.frequencies(docs, "text")
    own, common = (idf[0][near_dedup.slot(near_dedup.shingles([t])[1])] for t in (" ".join(docs.first().text.split()[20:]), shared))
    assert np.allclose(common, 1, atol=0.01) and np.allclose(own, (1 + np.log(101 / 2)) ** near_dedup.DAMPING, atol=0.02)


def test_a_group_of_a_third_of_the_rows_stays_one(spark):
    rng = random.Random(4)
    base = words(rng, 300)
    rows = [(i, changed(rng, base, rng.randrange(4))) for i in range(200)] + [(200 + i, " ".join(words(rng, 80))) for i in range(400)]
    got = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == (0 if i < 200 else i) for i in got)
