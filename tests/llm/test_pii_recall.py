"""Recall of disguised identifiers by kind, in sentences, and clean text without new spans."""

from __future__ import annotations

import collections
import random

from metricloom.llm import pii


def luhn_card(rng):
    d = [4] + [rng.randrange(10) for _ in range(14)]
    total = sum(sum(divmod(2 * x, 10)) if i % 2 == 0 else x for i, x in enumerate(d))
    return "".join(map(str, [*d, -total % 10]))


WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]


def wide(x):
    return "".join(chr(ord(c) + 0xFEE0) if c.isalnum() else c for c in x)


def bold(x):
    return "".join(chr(0x1D41A + ord(c) - 97) if c.islower() else chr(0x1D7CE + int(c)) if c.isdigit() else c for c in x)


def hidden(rng, x):
    at = rng.randrange(1, len(x) - 1)
    return x[:at] + rng.choice("​⁠﻿") + x[at:]


def letters(rng, x):
    digits = [i for i, c in enumerate(x) if c in "10"]
    for i in rng.sample(digits, min(2, len(digits))):
        x = x[:i] + {"1": rng.choice("lI"), "0": "O"}[x[i]] + x[i + 1 :]
    return x


def planted(rng):
    name, host, end = rng.choice(["john", "mary.smith", "x99"]), rng.choice(["example", "my-mail", "corp7"]), rng.choice(["com", "org", "de"])
    plain = f"{name}@{host}.{end}"
    for a, d in (("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), ("[@]", "[.]"), ("@", "[.]"), ("&#64;", "."), ("%40", "."), (" AT ", "."), (" @ ", " . "), ("@", ","), ("{at}", "{dot}")):
        yield "email", f"{name}{a}{host}{d}{end}"
    yield "email", "jane_AT_example_DOT_" + end
    yield "email", "jane -at- example -dot- " + end
    yield "email", " ".join("jane") + " @ example . " + end
    yield "email", plain.replace("a", "а").replace("e", "е").replace("o", "о")
    yield "email", wide(plain)
    yield "email", bold(plain)
    yield "email", hidden(rng, plain)
    ip = [rng.choice([10, 192, 172, 81, 101]), rng.randrange(100, 256), rng.randrange(1, 256), rng.randrange(10, 256)]
    for d in ("[.]", " . ", " dot ", "(dot)", "[dot]", "․"):
        yield "ip", d.join(map(str, ip))
    yield "ip", " dot ".join(" ".join(WORDS[int(c)] for c in str(x)) for x in ip)
    yield "ip", wide(".".join(map(str, ip)))
    yield "ip", bold(".".join(map(str, ip)))
    yield "ip", hidden(rng, ".".join(map(str, ip)))
    yield "ip", letters(rng, ".".join(map(str, [192, 101, *ip[2:]])))
    card = luhn_card(rng)
    four = [card[i : i + 4] for i in range(0, 16, 4)]
    for d in (".", "_", "/"):
        yield "card", d.join(four)
    yield "card", " ".join(WORDS[int(c)] for c in card)
    yield "card", wide(" ".join(four))
    yield "card", bold(card)
    yield "card", hidden(rng, " ".join(four))
    yield "card", letters(rng, "4111 1111 1111 1111")
    group = f"{rng.randrange(100, 999)} {rng.randrange(1000000, 9999999)}"
    yield "phone", f"plus 49 {group}"
    yield "phone", f"+49 {' '.join(WORDS[int(c)] for c in group[:3])} {group[4:]}"
    yield "phone", f"plus {' '.join(WORDS[int(c)] for c in '49' + group.replace(' ', ''))}"
    yield "phone", f"+49 (0){group[:3]} / {group[4:]}"
    yield "phone", wide(f"+49 {group}")
    yield "phone", bold(f"+49 {group}")
    yield "phone", hidden(rng, f"+49 {group}")
    yield "phone", letters(rng, "+1 202 555 0100")


def test_recall_by_kind():
    rng = random.Random(1)
    seen, found = collections.Counter(), collections.Counter()
    for _ in range(60):
        for kind, form in planted(rng):
            text = f"{rng.choice(['Please note', 'so', 'Hier ist'])}: {form} {rng.choice(['thanks', 'ok', 'und Ende'])}"
            seen[kind] += 1
            found[kind] += any(k == kind and text[a:b] == form for k, a, b, _ in pii.spans(text))
    share = {k: found[k] / seen[k] for k in seen}
    print(share)
    assert set(share) == set(pii.KINDS) and min(share.values()) >= 0.9, share


def test_clean_text_gets_no_new_span():
    for text in ["look at example.com now", "I was AT HOME. yes", "see 3.14 / 2.71 and 1 . 2", "a lIl 10l 2O", "user @ home", "10 plus 20 equals 30", "50% of 40", "A+ / B-", "C++ and/or +1", "room 1O1", "1 . 2 . 3", "2024/2025/2026", "the look-at-me dot dot", "meet at [.] or (.)", "[...]", "x@y, com", "i @ 5 . no", "O1 l2 I3 O4", "plus 3 minus 2", "one at a time, two dot dot", "&#64; is a sign, %40 too", "a/b/c 1234/5678"]:
        assert [x for x in pii.spans(text) if not x[3]] == [], text
