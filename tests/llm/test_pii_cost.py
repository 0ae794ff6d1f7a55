"""Personal data in long texts, and the map of places against a plain one."""

from __future__ import annotations

import random
import time

import pytest

from metricloom.llm import pii


@pytest.mark.parametrize("text", ["at dot" + " " * 1_000_000, "at [" + " " * 1_000_000 + "dot ]", "a at b dot one" + " ,-" * 300_000, "[ at" * 200_000, "1 dot " * 150_000, "@" * 300_000 + " at dot ", "one " * 200_000 + "dot", "х" * 300_000 + "@a.b"])
def test_time_grows_with_the_text_only(text):
    began = time.process_time()
    pii.spans(text)
    assert time.process_time() - began < 8  # seconds; quadratic ones take minutes


def test_blanks_take_less_than_a_second():
    began = time.process_time()
    assert pii.spans("at dot" + " " * 1_000_000) == []
    assert time.process_time() - began < 1


def test_places_against_a_map_of_every_character():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 30)))
        n = pii.Normal(text)
        source = [(i, i + 1, False) for i in range(len(text))]  # start, end, rewritten
        for _ in range(3):
            cuts = sorted(rng.sample(range(len(n.text) + 1), min(4, len(n.text) + 1) // 2 * 2))
            edits = [(a, b, rng.choice(["", "X", "YZ"])) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
            new, at = [], 0
            for a, b, to in edits:
                new += source[at:a] + [(source[a][0], source[b - 1][1], True)] * len(to)
                at = b
            source = new + source[at:]
            n.rewrite(edits)
            assert len(source) == len(n.text)
            assert [(n.start(i), n.end(i + 1)) for i in range(len(source))] == [x[:2] for x in source]
            for _ in range(5):
                if len(source) > 1:
                    a, b = sorted(rng.sample(range(len(source) + 1), 2))
                    assert n.touched(a, b) == (any(x[2] for x in source[a:b]) or source[b - 1][1] - source[a][0] != b - a)
            if not n.text:
                break


@pytest.mark.parametrize("text", ["j @ " * 250_000, "a b c d e f " * 80_000 + "@ x . com", "plus 1 " * 150_000, "4111_" * 200_000, "1 . " * 250_000, "1l " * 300_000, "+1 / " * 200_000, "a_at_b_dot_" * 90_000, "a AT b." * 140_000, "[.]" * 300_000, "𝐣" * 300_000, "+1 one " * 140_000, "x@y,com " * 120_000])
def test_time_of_further_forms_grows_with_the_text_only(text):
    began = time.process_time()
    pii.spans(text)
    assert time.process_time() - began < 12
