"""Personal data, also in disguise, at its place in the source.

Emails, IP addresses, card and phone numbers are found by patterns and checks.
A text with signs of disguise also passes a chain of transducers: look-alike
letters and digits of other scripts become plain ones, zero-width characters
go, spelled digits become digits, also with ``dot`` between them, and ``at``
and ``dot`` in brackets or between the words of an address become their
characters.  Each rewritten piece remembers its place, so that what the same
patterns find in the normal form maps back to source characters.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.common import map_texts

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile("[0-9]")
# A run of digits that fails from its first digit fails from any other, so only the first is tried.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_OTHER = re.compile("[^0-9]+")

# Letters and signs of other scripts that look like ASCII.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ѕ": "S", "Ј": "J",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "․": ".", "。": ".", "‐": "-", "‑": "-", "–": "-", "−": "-", "﹫": "@",
}
# Mathematical, circled, raised and lowered letters and digits, by their compatibility forms.
LOOKALIKES |= {c: k for c in map(chr, [*range(0x1D400, 0x1D800), *range(0x2460, 0x2469), *range(0x24B6, 0x24EA), *range(0x2070, 0x208A)]) if len(k := unicodedata.normalize("NFKC", c)) == 1 and k.isascii() and k.isalnum()}
LOOKALIKES |= {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}  # full width
LOOKALIKES |= {chr(z + d): str(d) for z in (0x660, 0x6F0, 0x966, 0x9E6, 0xE50) for d in range(10)}  # decimal digits of other scripts
HIDDEN = "​‌‍⁠﻿­"
DIGITS = {"zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
SPELLED = 4  # digit words in a row, at least

# a set of single characters beyond U+FFFF is slow, a range is not
_ODD = re.compile("[" + re.escape("".join(c for c in LOOKALIKES if c < "\U00010000")) + HIDDEN + "\U0001D400-\U0001D7FF]")
_WORD = "(?:" + "|".join(DIGITS) + ")"
_NUMBER = re.compile(rf"(?i)(?:\bplus[\s-]+|\+\s*)?\b{_WORD}(?:[\s,-]+(?:{_WORD}|[0-9]+)){{{SPELLED - 1},}}\b")
_TOKEN = re.compile(rf"(?i)\bplus\b|{_WORD}|[0-9]+|\+")
#: The same with ``dot`` between the digits.
_DOTTED = re.compile(rf"(?i)(?:\bplus[\s-]+|\+\s*)?\b{_WORD}(?:[\s,-]+(?:dot[\s,-]+)?(?:{_WORD}|[0-9]+)){{{SPELLED - 1},}}\b")
_DOTTED_TOKEN = re.compile(rf"(?i)\bplus\b|{_WORD}|[0-9]+|\+|dot")
#: Four numbers, in digits or up to three digit words, with dots of any form between them.
_PART = rf"(?:(?<![0-9])[0-9]+|\b{_WORD}(?:[\s,-]+{_WORD}){{0,2}}\b)"
_QUAD = re.compile(rf"(?i){_PART}(?:(?:\s+dot\s+|\.){_PART}){{3}}")
_QUAD_TOKEN = re.compile(rf"(?i)({_WORD})[\s,-]+(?={_WORD})|({_WORD})|\s+dot\s+")
#: Looked for from the bracket on; blanks around it are added by hand, for a pattern that starts with them is tried at each one.
_BRACKET = {"at": re.compile(r"(?i)[\[({<]\s*(?:at|@)\s*[\])}>]"), "dot": re.compile(r"(?i)[\[({<]\s*(?:dot|\.)\s*[\])}>]")}
#: Bare words count only as name at name dot name, with more dots behind.
_BARE = re.compile(r"(?i)(?<=[a-z0-9_])(\s+at\s+|@)[a-z0-9-]+((?:\s+dot\s+[a-z0-9-]+)+)\b")
_BARE_DOT = re.compile(r"(?i)\s+dot\s+")
#: The same words between hyphens or underscores.
_JOINED = re.compile(r"(?i)(?<=[a-z0-9])([\s_-]+at[\s_-]+)[a-z0-9]+((?:[\s_-]+dot[\s_-]+(?!dot)[a-z0-9]{2,})+)(?![a-z0-9])")
_JOINED_DOT = re.compile(r"(?i)[\s_-]+dot[\s_-]+")
#: An AT in capitals between a name that is not and a domain.
_CAPITAL = re.compile(r"(?<=[a-z0-9])\s+AT\s+(?=[a-z0-9-]+(?:\.[a-z0-9-]+)+)")
#: Signs written as entities, in percent code, or a comma before a common ending (fixed values).
_CODED = re.compile(r"(?i)(?<=[a-z0-9])(?:(&#0*64;|&#x0*40;|&commat;|%40)|(&#0*46;|&#x0*2e;|&period;|%2e))(?=[a-z0-9])")
_COMMA = re.compile(r"(?i)(?<=@)([a-z0-9-]+),(?=(?:com|org|net|edu|gov|info|io|co|de|fr|es|it|uk|eu)\b)")
#: Blanks around the dots of four numbers, and around the sign and the dots of an address from its sign on.
_SPACED_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?: {1,2}\. {1,2}[0-9]{1,3}){3}(?![0-9])")
_SPACED_MAIL = re.compile(r"(?i) {0,2}@ {0,2}[0-9-]{0,64}[a-z][a-z0-9-]*(?: {0,2}\. {0,2}[a-z0-9-]+){0,9} {0,2}\. {0,2}[a-z]{2,}")
_SPACED_NAME = re.compile(r"(?i)(?<![a-z0-9])[a-z0-9](?: [a-z0-9._-]){1,40}$")
#: Card numbers with other signs between their groups, and letters among digits.
_PARTED = re.compile(r"(?<![0-9])[0-9]{4}([._/])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9])")
_LETTERS = re.compile(r"(?<![A-Za-z0-9])[0-9lIO](?:[ .-]?[0-9lIO]){6,22}(?![A-Za-z0-9])")
_LETTER = {"l": "1", "I": "1", "O": "0"}
#: Phone numbers: plus as a word before digits, digits before words, a slash between groups.
_PLUS = re.compile(r"(?i)\bplus[ -]{1,2}(?=[0-9][ ().0-9-]{6,24}[0-9])")
_MIXED = re.compile(rf"(?i)(?:\bplus[\s-]+|\+\s?)[0-9]+(?:[\s,-]+(?:{_WORD}|[0-9]+)){{{SPELLED - 1},}}\b")
_SLASHED = re.compile(r"\+[0-9][ ().0-9-]{1,20}/[ ().0-9-]{1,20}[0-9]")
#: In lower case: what could be a dot or a number in disguise without any ``at``.
_HINT = re.compile(rf"[\[({{<]\s*dot\s*[\])}}>]|\.{_WORD}|{_WORD}\.[0-9a-z]")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the address pattern, in time linear in the text: each is looked for around its @."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", m.end() if m else at + 1)
    return out


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by the patterns alone, by kind as listed and then by start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) < 256 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = _OTHER.sub("", m[0])
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_OTHER.sub("", m[0])) <= 15]
    return out


class Normal:
    """A text in normal form, and for each of its characters the source characters behind it.

    The map is kept as runs: what stands between two rewritten places is one
    run of characters moved by the same distance, a rewritten one has its
    source's start and end.  So a map is as long as the edits, not the text.
    """

    def __init__(self, text: str):
        self.text = text
        #: (start in the normal form, start in the source, end in the source, rewritten), in order
        self.runs: list[tuple[int, int, int, bool]] = [(0, 0, len(text), False)]

    @property
    def changed(self) -> bool:
        return len(self.runs) > 1 or self.runs[0][3]

    def _run(self, place: int) -> tuple[int, int, int, bool]:
        return self.runs[bisect_right(self.runs, place, key=lambda r: r[0]) - 1]

    def start(self, place: int) -> int:
        at, a, _, rewritten = self._run(place)
        return a if rewritten else a + place - at

    def end(self, place: int) -> int:
        """Where the source of the character before ``place`` ends."""
        at, a, b, rewritten = self._run(place - 1)
        return b if rewritten else a + place - at

    def touched(self, a: int, b: int) -> bool:
        """Whether a rewritten character stands in the normal form from a to b, or a deleted one was there."""
        k = bisect_right(self.runs, a, key=lambda r: r[0]) - 1
        while k < len(self.runs) and self.runs[k][0] < b:
            if self.runs[k][3]:
                return True
            k += 1
        return self.end(b) - self.start(a) != b - a

    def _between(self, a: int, b: int, to: int) -> list[tuple[int, int, int, bool]]:
        """The runs of the normal form from a to b, moved to start at ``to``."""
        out = []
        for k in range(bisect_right(self.runs, a, key=lambda r: r[0]) - 1, len(self.runs)):
            at, x, y, rewritten = self.runs[k]
            if at >= b:
                break
            stop = self.runs[k + 1][0] if k + 1 < len(self.runs) else len(self.text)
            low, high = max(at, a), min(stop, b)
            if low < high:
                out.append((to + low - a, x, y, True) if rewritten else (to + low - a, x + low - at, x + high - at, False))
        return out

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace (start, end, new) parts; each new character stands for the whole part."""
        if not edits:
            return
        parts, runs, at, size = [], [], 0, 0
        for a, b, new in [*edits, (len(self.text), len(self.text), "")]:
            runs += self._between(at, a, size)
            parts += [self.text[at:a], new]
            size += a - at
            if new:
                runs.append((size, self.start(a), self.end(b), True))
            size += len(new)
            at = b
        self.text, self.runs = "".join(parts), runs or [(0, 0, 0, True)]


def lookalikes(n: Normal) -> None:
    n.rewrite([(m.start(), m.end(), LOOKALIKES.get(m[0], "" if m[0] in HIDDEN else m[0])) for m in _ODD.finditer(n.text)])


def spelled(n: Normal, dotted: bool = False) -> None:
    edits = []
    for m in [x for p in ((_DOTTED,) if dotted else (_NUMBER, _MIXED)) for x in p.finditer(n.text)]:
        if edits and m.start() < edits[-1][1]:
            continue  # told already
        for t in (_DOTTED_TOKEN if dotted else _TOKEN).finditer(n.text, *m.span()):
            word = t[0].lower()
            new = "+" if word in ("plus", "+") else "." if word == "dot" else DIGITS.get(word, word)
            to = t.end()
            while to < m.end() and (n.text[to].isspace() or n.text[to] in ",-"):
                to += 1  # what stands between the digits goes with them
            if to == m.end() or n.text[to : to + 1]:
                edits.append((t.start(), to if to < m.end() else t.end(), new))
    n.rewrite(edits)


def _bracketed(text: str, name: str, sign: str) -> list[tuple[int, int, str]]:
    """Edits for a bracketed word with the blanks around it, where it stands within the text."""
    out, free = [], 0
    for m in _BRACKET[name].finditer(text):
        a, b = m.span()
        while a > free and text[a - 1].isspace():
            a -= 1
        while b < len(text) and text[b].isspace():
            b += 1
        if a and b < len(text):
            out.append((a, b, sign))
            free = b
    return out


def signs(n: Normal) -> None:
    for name, sign in (("at", "@"), ("dot", ".")):
        n.rewrite(_bracketed(n.text, name, sign))
    edits = []
    for m in _BARE.finditer(n.text):
        if m[1] != "@":
            edits.append((m.start(1), m.end(1), "@"))
        edits += [(d.start(), d.end(), ".") for d in _BARE_DOT.finditer(n.text, m.start(2), m.end(2))]
    n.rewrite(edits)
    edits = []
    for m in _QUAD.finditer(n.text):
        edits += [(t.start(), t.end(), DIGITS.get((t[1] or t[2]).lower(), t[0]) if t[1] or t[2] else ".") for t in _QUAD_TOKEN.finditer(n.text, *m.span())]
    n.rewrite(edits)


def loosened(n: Normal) -> None:
    """Spaced, joined, coded and mixed forms; each rule looks only where its signs are."""
    low = n.text.lower()
    if "&" in low or "%" in low:
        n.rewrite([(m.start(), m.end(), "@" if m[1] else ".") for m in _CODED.finditer(n.text)])
    if "at" in low and "dot" in low:
        edits = []
        for m in _JOINED.finditer(n.text):
            edits.append((m.start(1), m.end(1), "@"))
            edits += [(d.start(), d.end(), ".") for d in _JOINED_DOT.finditer(n.text, m.start(2), m.end(2))]
        n.rewrite(edits)
    if " AT " in n.text:
        n.rewrite([(m.start(), m.end(), "@") for m in _CAPITAL.finditer(n.text)])
    if "@" in n.text:
        n.rewrite([(m.end(1), m.end(1) + 1, ".") for m in _COMMA.finditer(n.text)])
        edits = []
        for m in _SPACED_MAIL.finditer(n.text):
            low_end = edits[-1][1] if edits else 0
            name = _SPACED_NAME.search(n.text, max(m.start() - 82, low_end), m.start())
            blanks = [(name.start() + i, name.start() + i + 1, "") for i, c in enumerate(name[0]) if c == " "] if name else []
            edits += blanks + [(m.start() + x.start(), m.start() + x.end(), "") for x in re.finditer(" +", m[0])]
        n.rewrite(edits)
    if " . " in n.text:
        n.rewrite([(m.start() + x.start(), m.start() + x.end(), ".") for m in _SPACED_IP.finditer(n.text) for x in re.finditer(r" +\. +", m[0])])
    if _DIGIT.search(n.text):
        n.rewrite([(m.start() + x.start(), m.start() + x.end(), "-") for m in _PARTED.finditer(n.text) for x in re.finditer(r"[._/]", m[0])])
        found = [m for m in _LETTERS.finditer(n.text) if re.search("[lIO]", m[0]) and len(re.findall("[0-9]", m[0])) >= 6]
        n.rewrite([(m.start() + x.start(), m.start() + x.end(), _LETTER[x[0]]) for m in found for x in re.finditer("[lIO]", m[0])])
        if "plus" in low:
            n.rewrite([(m.start(), m.end(), "+") for m in _PLUS.finditer(n.text)])
    if "+" in n.text and "/" in n.text:
        n.rewrite([(m.start() + m[0].index("/"), m.start() + m[0].index("/") + 1, "-") for m in _SLASHED.finditer(n.text)])


_SIGN_IN_BRACKETS = re.compile(r"[\[({<]\s*[@.]\s*[\])}>]")
_GROUPS = re.compile(r"[0-9]{4}[._/][0-9]{4}[._/][0-9]{4}")
_AMONG = re.compile(r"[0-9][ .-]?[lIO][0-9lIO .-]|[lIO][ .-]?[0-9][ .-]?[0-9lIO]")
_WORDS_BEHIND = re.compile(rf"(?i)\+\s?[0-9]+[ ,-]+{_WORD}")


def loose(text: str, low: str) -> bool:
    """Whether a text has signs of the forms of ``loosened``; plain text is told by a few searches for fixed strings."""
    return bool(
        "_at_" in low or "-at-" in low or " AT " in text or "&#" in text or "%40" in text or "%2e" in low or "&commat;" in low or "&period;" in low
        or "@ " in text or " @" in text or ("@" in text and "," in text and _COMMA.search(text))
        or (("@" in text or "." in text) and _SIGN_IN_BRACKETS.search(text)) or (" . " in text and _SPACED_IP.search(text))
        or ("plus" in low and _PLUS.search(text)) or ("+" in text and (_SLASHED.search(text) if "/" in text else False)) or ("+" in text and _WORDS_BEHIND.search(text))
        or _GROUPS.search(text) or _AMONG.search(text)
    )


def disguised_spans(text: str, plain: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans that only a normal form shows, in source characters; none lies within a plain one of its kind."""
    low = text.lower()
    odd = _ODD.search(text) is not None
    words = sum(map(low.count, DIGITS)) >= SPELLED if any(d in low for d in DIGITS) else False
    dots = low.count("dot")
    mixed = loose(text, low)
    if not (odd or mixed or words or dots >= 3 or (dots and ("at" in low or "@" in low)) or "at" in low and re.search(r"[\[({<]\s*at\s*[\])}>]", low) or _HINT.search(low)):
        return []
    found: set[tuple[str, int, int]] = set()
    for dotted in (False, True) if odd or (words and dots) else (False,):
        n = Normal(text)
        if odd:
            lookalikes(n)
        if odd or mixed:
            loosened(n)
        spelled(n, dotted)
        signs(n)
        if n.changed:
            found |= {(kind, n.start(a), n.end(b)) for kind, a, b in plain_spans(n.text) if n.touched(a, b)}
    taken: dict[str, list[tuple[int, int]]] = {}
    for kind, a, b in plain:
        taken.setdefault(kind, []).append((a, b))
    out = []
    for kind, a, b in sorted(found):
        old = taken.get(kind, [])
        i = bisect_right(old, a, key=lambda x: x[0])
        if not (i and old[i - 1][1] >= b):
            out.append((kind, a, b))
    return out


def spans(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, plain) of all spans, by kind as listed and then by start."""
    base = plain_spans(text)
    more = disguised_spans(text, base)
    return sorted([(*x, True) for x in base] + [(*x, False) for x in more], key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


SPAN = "struct<kind: string, start: long, end: long, plain: boolean>"


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for each row of docs; spans in code points, end exclusive.

    Null and empty texts hold none.  Rows that repeat and null ids give a row
    each; an empty table gives none.  Other columns are not read.  A disguised
    span that lies within a plain one of its kind is not told again; one that
    reaches further stands beside it, so spans may overlap.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("plain", pa.bool_())]))

    def each(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        found = [[{"kind": k, "start": a, "end": b, "plain": p} for k, a, b, p in spans(t)] for t in texts]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])

    return map_texts(docs.select("doc_id", "text"), lambda: each, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans array<{SPAN}>")


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span replaced by its kind in angle brackets; overlapping spans of several kinds become one."""

    def one(text: str) -> str:
        out, at = [], 0
        for k, a, b, _ in sorted(spans(text), key=lambda x: (x[1], -x[2])):
            if a >= at:
                out += [text[at:a], f"<{k.upper()}>"]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def each(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        null = batch.column("text").is_null().to_pylist()
        i = batch.schema.get_field_index("text")
        return batch.set_column(i, "text", pa.array([None if n else one(t) for n, t in zip(null, texts, strict=True)], pa.string()))

    return map_texts(docs, lambda: each, docs.schema)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, a count for each kind, base_sha256, spans): counts and hash of the plain spans, text of all."""
    found = detect(docs)

    def joined(name: str) -> str:
        return f"array_join(transform({name}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"

    base = "filter(spans, x -> x.plain)"
    counts = [F.expr(f"cast(size(filter(spans, x -> x.plain AND x.kind = '{k}')) AS long)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(F.expr(joined(base)), 256).alias("base_sha256"), F.expr(joined("spans")).alias("spans"))
