"""The pipeline from end to end against plain Python, stage by stage."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from metricloom.llm import packing
from metricloom.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, t1 int, l_n_lines int, q_n_words string"
LINE = "The Common Line of every page"
ITEM = "which of these nineteen rivers flows through seven different capitals before it ends in the northern sea"


def prose(rng, n: int) -> str:
    return " ".join(f"w{rng.randrange(10**5)}" + ("\n" if i % 17 == 16 else "") for i in range(n)).replace("\n ", "\n")


def tables(spark, path, rows) -> str:
    full = [(i, t, "en", "s", None if t is None else len(t), 1, 2, "x") for i, t in rows]
    spark.createDataFrame(full, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in rows if i is not None], "doc_id long, quality int, toxic int").dropDuplicates(["doc_id"]).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def staged(spark, sf_dir):
    """The rows after each stage, by the stages' own functions, each over its predecessor's written rows."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        kept = stage(spark, docs, sf_dir)
        assert i == 4 or kept.columns == docs.columns, name
        kept.write.parquet(f"{sf_dir}/after-{i}")
        docs = spark.read.parquet(f"{sf_dir}/after-{i}")
        out[name] = docs
    return out


def key(line: str) -> bytes:
    return line.strip(" \t\n\x0b\x0c\r").encode().lower()


def base_fails(text: str) -> bool:
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = collections.Counter(windows)
    again = {i + k for i, x in enumerate(windows) if seen[x] > 1 for k in range(3)}
    return len(w) < 50 or 100 * len(again) > 50 * len(w)


def test_every_stage_against_loops(spark, tmp_path):
    rng = random.Random(1)
    origin = prose(rng, 200)
    near = [" ".join(w if k != 60 + i else "changed" for k, w in enumerate(origin.split(" "))) for i in range(5)]
    rows = [(i, prose(rng, 120) + (f"\n  {LINE.upper() if i % 2 else LINE} " if i < 15 else "")) for i in range(40)]
    rows += [(100, origin), (101, origin), *[(110 + i, t) for i, t in enumerate(near)]]
    rows += [(200, prose(rng, 80) + " " + ITEM.upper().replace("RIVERS", "RIVRES") + " " + prose(rng, 80)), (201, None), (202, ""), (203, "too short"), (204, "same old words " * 60), (205, prose(rng, 9000))]
    rows += [(None, prose(rng, 90)), (206, prose(rng, 90)), (206, prose(rng, 90))]
    sf_dir = tables(spark, tmp_path / "t", rows)
    got = staged(spark, sf_dir)

    want = [(i, t) for i, t in rows if t is not None and not base_fails(t)]
    assert {(i, t) for i, t in want} == {(r.doc_id, r.text) for r in got["quality rules"].collect()}

    held = collections.Counter(k for _, t in want for k in {key(x) for x in t.split("\n")} if k)
    want = [(i, "\n".join(x for x in t.split("\n") if held[key(x)] < 10)) for i, t in want]
    lines = got["line dedup"].collect()
    assert {(r.doc_id, r.text) for r in lines} == set(want) and all(r.n_chars == len(r.text) for r in lines)
    assert not any(LINE.lower() in t.lower() for _, t in want)

    gone = {101, *range(110, 115)}
    ids = sorted(-1 if r.doc_id is None else r.doc_id for r in got["near dedup"].collect())
    assert ids == sorted({-1 if i is None else i for i, _ in want} - gone)

    clean = got["decontamination"].collect()
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in clean) == [i for i in ids if i != 200]

    ids_of = packing.tokenizer(tokenizer_path())
    pieces = got["packing"].toPandas()
    assert pieces.length.sum() == sum(len(ids_of(r.text)) + 1 for r in clean) and pieces.groupby("sequence_id").length.sum().max() <= 2048
    for _, s in pieces.sort_values("offset").groupby("sequence_id"):
        assert (s.offset.values == np.cumsum([0, *s.length.values[:-1]])).all()

    whole = corpus_pipeline.run(spark, sf_dir).toPandas()
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole[columns].fillna(-1).values.tolist())) == sorted(map(tuple, pieces[columns].fillna(-1).values.tolist()))


@pytest.mark.parametrize("rows", [[], [(1, None), (None, None), (2, "")]])
def test_nothing_to_keep(spark, tmp_path, rows):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path / "t", rows)).count() == 0
