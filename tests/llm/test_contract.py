"""Registered queries and their SQL on tables of odd rows."""

from __future__ import annotations

import random
import re

import duckdb
import pytest

from metricloom.llm import chat, line_dedup, packing
from metricloom.llm.queries import ORACLE, QUERIES, tokenizer_path

ROLES = ["user", "assistant", "system", "System x", "", "a\\\nb", "</s>", "[INST", "x:3", "ü", "A_1", "[\n", "Assistant"]
PIECES = ["<", "[", "\\", "/", "|", "s", ">", "]", "\n", "\r", "INST", "[/USER]", "</s>", "é", " ", ":", "3"]


def text_of(rng):
    return "".join(rng.choice(PIECES) for _ in range(rng.randrange(9)))


def test_every_turn_reads_back():
    rng = random.Random(1)
    for i in range(60_000):
        role, text = ROLES[i % len(ROLES)], text_of(rng)
        pieces = chat.render(role, text)
        assert chat.parse([("".join(x for x, _ in pieces), False)]) == (role, text)
        assert chat.unescape(pieces[1][0]) == text
        # nothing but the template's own tags could be read as a control string
        assert not re.search(r"</s>|\[/?[A-Z]", pieces[1][0])
    for text in ("[\n", "see [\\\n", "<\\", "[", "\n", "a[\\\\\n"):
        assert chat.parse(chat.render("user", text)) == ("user", text)


def both(spark, tmp_path, name, table, df):
    df.write.parquet(str(tmp_path / f"{table}.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    rel = con.sql(ORACLE[name])
    got = QUERIES[name](spark, str(tmp_path)).select(*rel.columns).collect()
    return sorted(map(tuple, got), key=repr), sorted(rel.fetchall(), key=repr)


def test_chat_equals_its_sql_on_odd_turns(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randrange(30), rng.choice([0, 1, 2, 3, None]), rng.choice([*ROLES, None]), rng.choice([text_of(rng), text_of(rng), None, text_of(rng) * 150])) for _ in range(600)]
    rows += [(100, 0, "user", "see [\n"), (None, None, None, None), (None, 1, "assistant", "x"), (101, None, "user", "b"), (101, None, "user", "a"), (101, 0, "user", "c")]
    got, want = both(spark, tmp_path, "op8_chat_format", "conversations", spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3))
    assert got == want


def test_the_log_holds_every_kind_of_event(spark):
    log = chat.as_events(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"), delta_chars=256, drafts=4)
    kinds = {r.kind: r["count"] for r in log.groupBy("kind").count().collect()}
    assert set(kinds) == {"message", "delta", "edit", "regenerate"} and min(kinds.values()) > 0


def test_lines_equal_their_sql_on_repeated_and_null_ids(spark, tmp_path):
    rng = random.Random(3)
    lines = [" The Line ", "the line", "x", "", "  ", "É", "é", "a\x0bb"]
    rows = [(7, "x\nown")] * 10 + [(None, "the line\nz")] * 4 + [(i % 20, "\n".join(rng.choice([*lines, f"own {rng.randrange(30)}"]) for _ in range(rng.randrange(6)))) for i in range(60)] + [(3, None), (None, None), (5, "")]
    got, want = both(spark, tmp_path, "op10_line_dedup", "documents", spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert got == want and len(got) == len(rows)


def test_fill_middle_and_divergence_equal_their_sql_on_odd_rows(spark, tmp_path):
    rng = random.Random(4)
    words = ["Straße", "the", "THE", "x1y", "naïve", "<P>", "<S>", "é", "\n", "12", "-"]
    rows = [(rng.choice([None, i, i % 9]), rng.choice([None, "", " ".join(rng.choice(words) for _ in range(12)), " ".join(rng.choice(words) for _ in range(5))]), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for k, name in enumerate(("op11_fill_middle", "op13_source_divergence")):
        (tmp_path / str(k)).mkdir()
        got, want = both(spark, tmp_path / str(k), name, "documents", df)
        assert got == want, name


@pytest.mark.parametrize("blank", [" ", "\n", " \n\t"])
def test_packing_survives_long_runs_of_blanks(spark, blank):
    from tokenizers import Tokenizer

    run = blank * (3_000_000 // len(blank))
    docs = spark.createDataFrame([(1, run), (2, f"a{run}b"), (3, "short")], "doc_id long, text string")
    out = packing.pack(docs, tokenizer_path()).collect()
    exact = Tokenizer.from_file(tokenizer_path())
    for doc_id, text in ((1, run), (2, f"a{run}b"), (3, "short")):
        assert sum(r.length for r in out if r.doc_id == doc_id) == len(exact.encode(text, add_special_tokens=False).ids) + 1


def test_keys_that_share_their_first_half_keep_both_verdicts():
    import numpy as np

    keys, prints, counts = np.array([5, 9, 5, 5], np.uint64), np.array([1, 2, 3, 4]), np.array([10, 20, 30, 40])
    look = line_dedup.Lookup.unpack(line_dedup.Lookup.build(keys, prints, counts).pack())
    assert look.count(keys, prints).tolist() == [10, 20, 30, 40]
    assert look.count(np.array([5, 9, 6], np.uint64), np.array([2, 1, 7])).tolist() == [0, 0, 0]
