"""Decontamination against edit distance by loops."""

from __future__ import annotations

import random

import pytest

from metricloom.llm import decontamination
from metricloom.llm.decontamination import Benchmark


def distances(item: str, text: str, anywhere: bool) -> int:
    """Edits from the item to the text, or to the closest part of it."""
    row = [0 if anywhere else j for j in range(len(text) + 1)]
    for i, c in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row) if anywhere else row[-1]


def plain(text: str) -> str:
    return "".join(c for c in text.replace("İ", "i").lower() if c.isalnum())


def edited(rng, text: str) -> str:
    out = list(text)
    for _ in range(rng.randrange(6)):
        p, k = rng.randrange(len(out) + 1), rng.randrange(3)
        if k == 0:
            out.insert(p, rng.choice("xyz"))
        elif p < len(out):
            out[p : p + 1] = [rng.choice("xyz")] if k == 1 else []
    return "".join(out)


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", "a"])
@pytest.mark.parametrize("postings", [1 << 20, 5])
def test_matches_places_and_edits_against_loops(monkeypatch, letters, postings):
    monkeypatch.setattr(decontamination, "POSTINGS", postings)
    rng = random.Random(letters)

    def any_text(n: int, more: str) -> str:
        return "".join(rng.choice(letters + more) for _ in range(n))

    found = 0
    for _ in range(25):
        items = [(i, any_text(rng.randrange(8, 60), " ")) for i in range(3)]
        texts = [any_text(rng.randrange(50), "İ .") + edited(rng, rng.choice(items)[1]) + any_text(rng.randrange(30), "İ ") for _ in range(4)]
        for text, got in zip(texts, Benchmark(items).search(texts), strict=True):
            got = {i: (a, b, d) for i, a, b, d in got}
            for i, item in items:
                m = plain(item)
                least = distances(m, plain(text), True)
                if len(m) >= 8 and least <= max(0, min(len(m) // 10, (len(m) - 8) // 8)):
                    a, b, d = got[i]
                    assert d == least == distances(m, plain(text[a:b]), False)
                    found += 1
                else:
                    assert i not in got
    assert found > 50


def test_many_items_and_texts_at_once():
    rng = random.Random(3)
    items = [(i, "".join(rng.choice("abcdefghijklmnop") for _ in range(40))) for i in range(90_000)]
    got = Benchmark(items).search(["xyz"] * 9000 + [items[7][1]])
    assert got[-1] == [(7, 0, 40, 0)] and not any(got[:-1])


def test_repetitive_text_and_item_stay_small():
    import tracemalloc

    known = Benchmark([(1, "abcdefghij" * 400)])
    assert len(known.hash) < 200  # of about 4,000 postings
    tracemalloc.start()
    assert known.search(["abcdefghij" * 20_000])[0] == [(1, 0, 4000, 0)]
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()


def test_tables_with_nothing_in_them(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (2, "", "y"), (None, "a b", "z")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (4, "long enough to be found")], "item_id long, text string")
    assert decontamination.find(docs, bench).count() == 0
    kept = decontamination.keep_clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == 4
    assert decontamination.keep_clean(docs.limit(0), bench).count() == 0
    assert decontamination.find(docs.limit(0), bench.limit(0)).count() == 0
    twice = spark.createDataFrame([(5, "x long enough, to be FOUND x")] * 2, "doc_id long, text string")
    assert [tuple(r) for r in decontamination.find(twice, bench).collect()] == [(5, 4, 2, 26, 0)] * 2
