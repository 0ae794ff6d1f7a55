"""Quality rules: a learned decision list over text statistics, DataFrame functions only.

``statistics`` turns a text into a handful of numbers.  ``learn`` grows an
ordered list of rules from a bounded sample of labelled rows by sequential
covering: each rule is a conjunction of thresholds, grown on one part of the
sample by the gain of information of the low-quality rows, pruned on the
other, and kept if it is precise there; the rows it covers are put aside
before the next rule grows.  ``verdict`` turns the list into one ordered
``CASE WHEN`` expression.  Only the sample's numbers come to the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.llm.common import fold, fresh, thinned

SPACE = r"\x20\x09-\x0D"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Positions covered by three-word windows that occur twice or more.  Each
#: window is one long: its hash above, its place in the low bits; sorting the
#: longs puts equal windows side by side without sorting structs.
_REPEATS = """
CASE WHEN size(ws) < 4 THEN 0L ELSE
  element_at(transform(array(sort_array(
    transform(sequence(0, size(ws) - 3), i -> shiftleft(xxhash64(ws[i], ws[i + 1], ws[i + 2]), bits) + i))),
    s -> element_at(transform(array(filter(s, (x, i) ->
        (i > 0 AND shiftright(x, bits) = shiftright(s[greatest(i - 1, 0)], bits)) OR
        (i < size(s) - 1 AND shiftright(x, bits) = shiftright(s[least(i + 1, size(s) - 1)], bits)))),
      r -> CASE WHEN size(r) = 0 THEN 0L ELSE cast(size(array_distinct(flatten(transform(r, x ->
        transform(sequence(0, 2), k -> cast(x & (shiftleft(1L, bits) - 1) AS int) + k))))) AS long) END), 1)), 1)
END
"""


def statistics(docs: DataFrame, text: str = "text", prefix: str = "q_") -> DataFrame:
    """docs plus prefixed columns with the statistics of each whole text.

    Null and empty texts have no words and zeros everywhere.  The columns of
    docs stay as they are; the prefix keeps the new names apart.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    p = prefix

    def left(pattern: str) -> Column:
        return F.length(F.regexp_replace(body, pattern, ""))

    words = F.expr(f"filter(split(coalesce(`{text}`, ''), '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w != '')")
    lines = F.split(body, "\n", -1)
    full = F.filter(lines, lambda x: x.rlike(f"[^{SPACE}]"))
    out = docs.withColumns({f"{p}ws": words, f"{p}full": full, f"{p}length": F.length(body).cast("long")})
    ws, fulls = F.col(f"{p}ws"), F.col(f"{p}full")
    out = out.withColumn(f"{p}bits", F.greatest(F.ceil(F.log2(F.size(ws) + 1)), F.lit(1)).cast("int"))
    repeats = _REPEATS.replace("ws", f"`{p}ws`").replace("bits", f"`{p}bits`")
    numbers = {
        "n_words": F.size(ws),
        "word_chars": F.length(F.array_join(ws, "")),
        "n_symbols": F.col(f"{p}length") - left(r"[#*$%&|<>]+"),
        "n_dup_lines": F.size(fulls) - F.size(F.array_distinct(fulls)),
        "n_repeat_words": F.expr(repeats),
        "n_distinct": F.size(F.array_distinct(ws)),
        "n_lines": F.size(fulls),
        "n_upper": F.col(f"{p}length") - left(r"\p{Lu}+"),
        "n_marks": F.col(f"{p}length") - left(r"[!?]+"),
        "n_digits": F.col(f"{p}length") - left(r"[0-9]+"),
    }
    # Behind a generator, a later filter on a statistic is not pushed below the
    # split, where it would split the text again for each element it looks at.
    one = F.inline(F.array(F.struct(*[c.cast("long").alias(f"{p}{k}") for k, c in numbers.items()])))
    return out.select(*docs.columns, one)


def ratios(p: str = "q_") -> dict[str, Column]:
    """What the rules look at, from the statistics."""
    n = F.greatest(F.col(f"{p}n_words"), F.lit(1))
    chars = F.greatest(F.col(f"{p}word_chars"), F.lit(1))
    return {
        "n_words": F.col(f"{p}n_words").cast("double"),
        "word_length": F.col(f"{p}word_chars") / n,
        "symbols": F.col(f"{p}n_symbols") / n,
        "dup_lines": F.col(f"{p}n_dup_lines") / F.greatest(F.col(f"{p}n_lines"), F.lit(1)),
        "repeats": F.col(f"{p}n_repeat_words") / n,
        "distinct": F.col(f"{p}n_distinct") / n,
        "upper": F.col(f"{p}n_upper") / chars,
        "marks": F.col(f"{p}n_marks") / n,
        "digits": F.col(f"{p}n_digits") / chars,
    }


def base_failed(p: str = "q_") -> Column:
    return (F.col(f"{p}n_words") < 50) | (100 * F.col(f"{p}n_repeat_words") > 50 * F.col(f"{p}n_words"))


Condition = tuple[str, str, float]  # feature, "<=" or ">", threshold


def _holds(row: dict, rule: list[Condition]) -> bool:
    return all(row[f] <= t if op == "<=" else row[f] > t for f, op, t in rule)


def _counts(rows: list[dict], rule: list[Condition]) -> tuple[int, int]:
    covered = [r["low"] for r in rows if _holds(r, rule)]
    return sum(covered), len(covered) - sum(covered)


def _grow(rows: list[dict], cuts: dict[str, list[float]], longest: int) -> list[Condition]:
    rule: list[Condition] = []
    left = rows
    while len(rule) < longest:
        p0 = sum(r["low"] for r in left)
        n0 = len(left) - p0
        if not p0 or not n0:
            break
        best, gain = None, 0.0
        for f, values in cuts.items():
            ordered = sorted((r[f], r["low"]) for r in left)
            at = p = n = 0
            for t in values:
                while at < len(ordered) and ordered[at][0] <= t:
                    p, n, at = p + ordered[at][1], n + 1 - ordered[at][1], at + 1
                for op, a, b in (("<=", p, n), (">", p0 - p, n0 - n)):
                    g = a * (math.log2(a / (a + b)) - math.log2(p0 / (p0 + n0))) if a else 0.0
                    if g > gain + 1e-9:
                        best, gain = (f, op, t), g
        if best is None:
            break
        rule.append(best)
        left = [r for r in left if _holds(r, [best])]
    return rule


def cover(rows: list[dict], max_rules: int = 12, longest: int = 3, precision: float = 0.95, least: int = 3, bins: int = 48) -> list[list[Condition]]:
    """The decision list for rows of features with ``low`` (1 for low quality): rules that reject, in order."""
    features = sorted(k for k in (rows[0] if rows else {}) if k != "low")
    grow, prune = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if i % 3 == 0]
    rules: list[list[Condition]] = []
    while len(rules) < max_rules and sum(r["low"] for r in grow) >= least:
        cuts = {}
        for f in features:
            values = sorted({r[f] for r in grow})
            low = sorted({r[f] for r in grow if r["low"]})
            middles = [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)]
            ends = [m for m in middles if low and (low[0] - 1e-9 <= m <= low[-1] + 1e-9)] or middles
            cuts[f] = sorted({m[i * (len(m) - 1) // max(1, bins - 1)] for m in (middles, ends) if m for i in range(bins)})
        rule = _grow(grow, cuts, longest)
        if not rule:
            break

        def worth(r: list[Condition]) -> float:
            p, n = _counts(prune, r)
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        p, n = _counts(rows, rule)
        pp, pn = _counts(prune, rule)
        if p < least or p / (p + n) < precision or (pp + pn and pp / (pp + pn) < precision):
            break
        rules.append(rule)
        grow = [r for r in grow if not _holds(r, rule)]
        prune = [r for r in prune if not _holds(r, rule)]
        rows = [r for r in rows if not _holds(r, rule)]
    return rules


def learn(docs: DataFrame, labels: DataFrame, max_train: int = 6000, **how: float) -> list[list[Condition]]:
    """Rules from at most about ``max_train`` labelled rows (fold 0 of 5 left out)."""
    known = labels.where((fold("doc_id", 5) != 0) & F.col("quality").isNotNull()).select("doc_id", (1 - F.col("quality")).cast("int").alias("low"))
    ids = thinned(known, known.count(), max_train, "doc_id")
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    seen = statistics(rows).where(~base_failed())
    got = [r.asDict() for r in seen.select("doc_id", "low", *[c.alias(k) for k, c in ratios().items()]).collect()]
    got.sort(key=lambda r: tuple(r.values()))
    for r in got:
        r.pop("doc_id")
    return cover(got, **how)


def verdict(rules: list[list[Condition]], p: str = "q_") -> Column:
    """True for a row to keep: the rules in order, the first that fits rejects."""
    seen = ratios(p)
    out = None
    for rule in rules:
        fits = F.lit(True)
        for f, op, t in rule:
            fits = fits & ((seen[f] <= t) if op == "<=" else (seen[f] > t))
        out = F.when(fits, False) if out is None else out.when(fits, False)
    return F.lit(True) if out is None else out.otherwise(True)


def judge(docs: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """(doc_id, n_words, the four counts, base_failed, kept) for each row of docs.

    Null and empty texts have no words and fail the base.  Repeated rows and
    null ids give a row each; an empty table gives none.  Other columns are
    not read.
    """
    out = statistics(docs.select("doc_id", "text"))
    return out.select("doc_id", *[F.col(f"q_{c}").alias(c) for c in BASE], base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"))


def keep_good(docs: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """The rows of docs, with its columns, that the base and the rules keep."""
    p = fresh(docs, "q_")
    return statistics(docs, prefix=p).where(~base_failed(p) & verdict(rules, p)).select(*docs.columns)
