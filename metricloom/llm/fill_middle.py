"""Fill-in-the-middle by a counted pattern, in the JVM without a shuffle.

A unit is a run of ASCII letters or any other single code point.
``regexp_count`` gives a text's number of units n.  Two hashes of the id say
after how many units, a and then b, the text is cut.  A pattern made for the
row, with the units counted by possessive quantifiers, takes prefix, middle
and suffix in one match, and its replacement writes them in the order of the
row's form.  Possessive groups are matched in a loop: a lazy or greedy one
would recurse for each unit and overflow the stack on a long text.

The markers do not stand in a text that is transformed, and no marker's end
begins another, so the first marker of its kind is the one that was written:
the output and the form give the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = "[A-Za-z]+|[^A-Za-z]"
#: ``regexp_count`` keeps all matches of a text at once, some 70 bytes each; a longer text is counted by shrinking its runs of letters to one.
COUNTED_CHARS = 4_000_000


def units(text: Column, counted_chars: int = COUNTED_CHARS) -> Column:
    """How many units a text has; both ways of counting agree."""
    shrunk = F.length(F.regexp_replace(text, "[A-Za-z]+", "a"))
    return F.when(F.length(text) <= counted_chars, F.regexp_count(text, F.lit(UNIT))).otherwise(shrunk).cast("long")


def draw(key: Column, k: int, seed: int = 1) -> Column:
    """The k-th group (from 1) of eight hex digits of sha256 of seed, colon and the key's decimal text, as a number; a null key has no text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def cut_pattern(a: Column, b: Column) -> Column:
    """Prefix of a units, middle up to unit b, suffix, as three groups of one match over the whole text."""
    unit = "(?:[A-Za-z]++|[^A-Za-z])"
    return F.concat(F.lit(rf"(?s)\A({unit}{{"), a.cast("string"), F.lit(f"}}+)({unit}{{"), (b - a).cast("string"), F.lit(r"}+)(.*)\z"))


def rebuilt(output: Column, form: Column) -> Column:
    """The text behind an output of a given form."""
    psm = F.regexp_replace(output, rf"(?s)\A{PREFIX}(.*?){SUFFIX}(.*?){MIDDLE}(.*)\z", "$1$3$2")
    spm = F.regexp_replace(output, rf"(?s)\A{SUFFIX}(.*?){PREFIX}(.*?){MIDDLE}(.*)\z", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def transform(docs: DataFrame, rate: int = 90, suffix_first: int = 20, seed: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for each row of docs.

    ``rate`` of a hundred texts are transformed, of these ``suffix_first`` of
    a hundred suffix first.  Null texts are empty; an empty text and one that
    holds a marker stay plain.  Rows that repeat give rows that repeat, rows
    of one id and of different texts are cut by the same draws, and a null id
    draws as an id without digits.  Lengths are code points, null for plain
    texts.  Other columns are neither read nor returned; an empty table gives
    no rows.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumns({"n": units(F.col("text")), **{f"h{k}": draw(F.col("doc_id"), k, seed) for k in (1, 2, 3, 4)}})
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("text") == "") | (F.col("h3") % 100 >= rate) | marked
    form = F.when(plain, "plain").when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm")
    cuts = [F.col(h) % (F.col("n") + 1) for h in ("h1", "h2")]
    rows = rows.select("doc_id", "text", "n", form.alias("form"), F.least(*cuts).alias("a"), F.greatest(*cuts).alias("b"))
    order = F.when(F.col("form") == "spm", f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2").otherwise(f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2")
    output = F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace("text", cut_pattern(F.col("a"), F.col("b")), order))
    rows = rows.select("doc_id", "n", "form", output.alias("output"))
    # a marker is three characters; places count from 1
    at = {m: F.locate(m, F.col("output")) for m in (PREFIX, SUFFIX, MIDDLE)}
    prefix = F.when(F.col("form") == "psm", at[SUFFIX] - 4).when(F.col("form") == "spm", at[MIDDLE] - at[PREFIX] - 3)
    middle = F.when(F.col("form") != "plain", F.length("output") - at[MIDDLE] - 2)
    return rows.select("doc_id", "n", "form", prefix.cast("long").alias("prefix_chars"), middle.cast("long").alias("middle_chars"), "output")


def digests(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``transform`` with the digests of the output and of the text rebuilt from output and form."""
    rows = transform(docs, **options)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(rebuilt(F.col("output"), F.col("form"))).alias("restored_sha256"))
