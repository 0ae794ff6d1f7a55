"""Brute-force versions, round trips and edge cases of the training-data operators."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricloom.llm import chat, decontamination, language_id, line_dedup, near_dedup, packing, pii, quality_classifier, quality_rules, toxicity
from metricloom.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, q_x int, l_n_lines int"
WORDS = ["the", "cat", "sat", "on", "a", "mat", "und", "der", "hund", "ist", "hier", "nicht"]


def made(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, ties, clashing column names."""
    rows = [(1, None, None, None, None, 1, 1), (2, "", "en", "s", 0, 1, 1), (None, "no id here", "en", "s", 3, 1, 1), (3, made(1, 300), "en", "s", 1, 1, 1), (3, made(1, 300), "en", "s", 1, 1, 1), (4, made(1, 300), "en", "s", 1, 1, 1), (5, "x " * 30000, "de", "s", 1, 1, 1), (6, "123 !!!", "de", None, 1, 1, 1)]
    return spark.createDataFrame(rows, SCHEMA)


def test_language(spark, odd):
    rng = random.Random(4)
    en, de = (["the", "with", "thing", "house"], ["der", "nicht", "schule", "ist"])
    texts = [(" ".join(rng.choice(w) for _ in range(20)), k) for k, w in (("en", en), ("de", de)) for _ in range(40)]
    model = language_id.fit([t for t, _ in texts], [k for _, k in texts], vocabulary=256, landmarks=16)
    lang, score = language_id.predict(model, ["the thing with house", "der ist nicht schule", "", "12 !"])
    assert lang == ["en", "de", "und", "und"] and 0 <= min(score) and max(score) <= 1
    out = language_id.identify(odd, model).collect()
    assert len(out) == 8 and {r.doc_id: r.lang_pred for r in out}[6] == "und"
    assert language_id.identify(odd.limit(0), language_id.train(odd.limit(0))).count() == 0


def test_quality_classifier_learns_marks(spark, odd):
    good = [made(i, 40) for i in range(60)]
    bad = [re.sub(" ", "### ", t) for t in good]
    model = quality_classifier.fit(good[:40] + bad[:40], [1] * 40 + [0] * 40)
    assert quality_classifier.score(model, good[40:]).min() > 0.5 > quality_classifier.score(model, bad[40:]).max()
    out = quality_classifier.classify(odd, model).collect()
    assert len(out) == 8 and all(0 <= r.score <= 1 for r in out)


def test_toxicity_separates_and_counts_are_exact(spark, odd):
    rows = [(i, made(i, 50) + (" vile scoundrel" * 4 if i % 3 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    s = toxicity.score(model, ["a vile scoundrel sat here vile scoundrel", made(999, 50)])
    assert s[0] > 0.7 > s[1]
    out = toxicity.rate(odd, model).collect()
    assert len(out) == 8 and all(0 <= r.score <= 1 for r in out)
    got = {(r.fold, r.key): (r.ct, r.co) for r in toxicity.count_ngrams(spark.createDataFrame([("ab", 1, 0), ("ab", 0, 0), ("b", 0, 1)], "text string, label int, fold int")).collect()}
    # a text's characters and the space that ends it
    assert sum(a for a, _ in got.values()) == 3 and sum(b for _, b in got.values()) == 3 + 2 and {f for f, _ in got} == {0, 1}


def test_toxicity_counts_and_curve_use_all_labelled_rows(spark):
    ids = spark.range(900).withColumnRenamed("id", "doc_id")
    part = {r.doc_id: r.f for r in ids.withColumn("f", F.expr(f"pmod(xxhash64(doc_id), {toxicity.FOLDS})")).collect()}
    rows = [(i, made(i, 50) + (" vile scoundrel" * 4 if i % 3 == 0 else "") + (" qzjx" if i % 3 == 0 and part[i] == 1 else "")) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    key, _ = toxicity.ngrams(["qzjx"])
    place = toxicity.slot(key[3:4], toxicity.SLOTS)
    assert (model["tables"][0][place] > 0.5).all()

    known = toxicity.with_labels(docs, labels)
    counts = toxicity.count_ngrams(known)
    tables = [toxicity.arrays(toxicity.without(counts, k)) for k in range(toxicity.FOLDS)]
    # a part's own words are not in the models that rate it
    assert np.isnan(tables[1][0][place]).all() and not np.isnan(tables[0][0][place]).any()
    x, y = [], []
    for k, t in enumerate(tables):
        for r in known.where(f"fold = {k}").collect():
            x.append(toxicity.statistics(t, [r.text])[0])
            y.append(r.label)
    assert len(y) == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i, _ in rows)
    x, y, w = toxicity._inputs(np.array(x)), np.array(y), np.zeros(toxicity.STATISTICS + 2)
    v = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))  # both labels weigh the same
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (v * p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (v * (p - y)) + w)
    assert model["weights"] == pytest.approx(w, abs=1e-5)


def kneser_ney(rows, text):
    """For each character of the text (number of n-gram, log difference), by dictionaries and loops."""
    n, d = toxicity.ORDER, toxicity.DISCOUNT

    def grams(t):
        s = " " * (n - 1) + re.sub(r"[\W_]+", " ", " " + t.lower()).lstrip() + ("" if re.search(r"[\W_]$", t) else " ")
        return [s[i : i + n] for i in range(len(s) - n + 1)]

    counts = [collections.Counter(g for t, y in rows if y == k for g in grams(t)) for k in (0, 1)]
    three = collections.Counter(g[1:] for g in {*counts[0], *counts[1]})
    two = collections.Counter(g[1:] for g in three)

    def smoothed(c, g, lower):
        total, types = sum(v for k, v in c.items() if k[:-1] == g[:-1]), sum(k[:-1] == g[:-1] for k in c)
        return (max(c[g] - d, 0) + d * types * lower) / total if total else lower

    def difference(g):
        if g not in counts[0] and g not in counts[1]:
            return None
        p = smoothed(three, g[1:], smoothed(two, g[2:], 1 / 256))
        return np.log(smoothed(counts[1], g, p) / smoothed(counts[0], g, p))

    return [difference(g) for g in grams(text)]


def test_toxicity_against_kneser_ney_by_loops(spark):
    rows = [(f"{made(i, 4)} {'vile' if i % 2 else 'kind'}", i % 2) for i in range(12)]
    counts = toxicity.count_ngrams(spark.createDataFrame([(t, y, i % 2) for i, (t, y) in enumerate(rows)], "text string, label int, fold int"))
    tables = toxicity.arrays(toxicity.without(counts))
    text = f"{rows[3][0]} zz {rows[4][0]}"
    want = kneser_ney(rows, text)
    key, _ = toxicity.ngrams([text])
    got = tables[0][toxicity.slot(key, toxicity.SLOTS)]
    assert len(got) == len(want) and sum(w is not None for w in want) > 8
    for g, w in zip(got, want, strict=True):
        assert np.isnan(g) if w is None else g == pytest.approx(w, abs=1e-5)


def test_toxicity_windows_by_loops():
    rng = np.random.default_rng(1)
    tables = (rng.normal(size=1 << toxicity.SLOTS).astype(np.float32), np.zeros(1 << (toxicity.SLOTS - 1), np.float32))
    texts = ["", "a", "short", made(1, 30), "x" * 8, "y z " * 50]
    for text, got in zip(texts, toxicity.statistics(tables, texts), strict=True):
        x = tables[0][toxicity.slot(toxicity.ngrams([text])[0], toxicity.SLOTS)].astype(float)
        windows = sorted((x[i : i + 8].sum() for i in range(0, max(len(x) - 8, 0) + 1, 4) if len(x)), reverse=True)
        want = [x.mean() if len(x) else 0, *[np.mean(windows[:k]) if windows else 0 for k in (1, 4, 10)], np.mean([w > 3 for w in windows]) if windows else 0, len(x)]
        assert got == pytest.approx(want, abs=1e-4)


def test_packing_is_exact_and_gapless(spark, odd):
    docs = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    out = packing.pack(docs, tokenizer_path(), capacity=128).toPandas()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    for r in docs.collect():
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        mine = out[out.doc_id == r.doc_id].sort_values("piece")
        assert mine.length.sum() == len(ids) and (mine.length.values[1:] == 128).all()
        assert all(zlib.crc32(ids[a : a + n].tobytes()) == c for a, n, c in zip(mine.start, mine.length, mine.ids_crc32, strict=True))
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert (s.offset.values == np.cumsum([0, *s.length.values[:-1]])).all() and s.length.sum() <= 128
    assert packing.pack(odd.limit(0), tokenizer_path()).count() == 0


def test_tokenizers_agree_on_odd_texts():
    from tokenizers import Tokenizer

    exact, mine = Tokenizer.from_file(tokenizer_path()), packing.tokenizer(tokenizer_path())
    for text in ["", "  two  spaces ", "tab\t\n\n x", "it's we'll", "ñandú Ärger", "日本語 <|endoftext|>", "<|endoftext|>", "…— ", "a\x00b", "\x85\x1c"]:
        assert mine(text) == exact.encode(text, add_special_tokens=False).ids, repr(text)


def weighted_components(docs, threshold=0.8):
    idf = near_dedup.frequencies(docs, "text")
    w = near_dedup.Weights(idf)
    rows = sorted({(r.doc_id, r.text or "") for r in docs.collect()})
    sets = w.sets([t for _, t in rows])
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][1] == rows[j][1] or w.similarity(sets[i], sets[j]) >= threshold:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}


def test_near_copies_against_all_pairs(spark):
    rng = random.Random(5)
    rows = []
    for base in range(12):
        words = made(base + 50, 120).split()
        for _ in range(8):
            copy = list(words)
            for _ in range(rng.randrange(5)):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + i, t) for i, t in enumerate([None, "", "one", "One!", "solo text of few"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()}
    assert got == weighted_components(docs)
    assert {r.doc_id for r in near_dedup.keep_one(docs).collect()} == set(got.values())


def test_near_dedup_edges(spark, odd):
    out = near_dedup.classes(odd).collect()
    assert len(out) == 8
    assert {(r.doc_id, r.class_id) for r in out if r.doc_id in (3, 4)} == {(3, 3), (4, 3)}
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 3, 5, 6]
    assert near_dedup.classes(odd.limit(0)).count() == 0


def base_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = collections.Counter(win)
    cov = {i + k for i, x in enumerate(win) if c[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cov)


def test_quality_statistics_against_loops(spark, odd):
    rng = random.Random(6)
    texts = ["".join(rng.choice(["a", "b c ", "a b ", "\n", "#", "é", " ", "\t", "\x0b"]) for _ in range(rng.randrange(120))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules.judge(docs, []).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_counts(texts[r.doc_id]), repr(texts[r.doc_id])
        assert r.kept == (not r.base_failed)
    assert quality_rules.judge(odd, []).count() == 8
    assert quality_rules.keep_good(odd, [[("symbols", ">", 0.5)]]).columns == odd.columns


def test_cover_finds_planted_rules():
    rng = random.Random(7)
    rows = [{"a": rng.random(), "b": rng.random()} for _ in range(600)]
    rows = [r | {"low": int(r["a"] > 0.7 and r["b"] < 0.4)} for r in rows]
    rules = quality_rules.cover(rows)
    hit = [any(quality_rules._holds(r, x) for x in rules) for r in rows]
    assert sum(h != bool(r["low"]) for h, r in zip(hit, rows, strict=True)) < 12
    assert quality_rules.cover([]) == []


def test_decontamination_finds_edited_items_only(spark, odd):
    rng = random.Random(8)
    items = [(i, made(i + 500, 30)) for i in range(10)]
    rows = []
    for i, text in items:
        chars = list(text)
        for _ in range(int(0.07 * len(text))):
            chars[rng.randrange(len(chars))] = rng.choice("xyz")
        rows.append((i, made(i + 900, 60) + " " + "".join(chars).upper() + " " + made(i + 950, 60)))
    rows += [(100 + i, made(i + 2000, 150)) for i in range(20)] + [(200, None), (201, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (4_000_000, 300):
        assert {(r.doc_id, r.item_id) for r in decontamination.find(docs, bench, block_chars=block).collect()} == {(i, i) for i in range(10)}
    assert sorted(r.doc_id for r in decontamination.keep_clean(docs, bench).collect()) == [*range(100, 120), 200, 201]
    assert decontamination.keep_clean(odd, bench.limit(0)).count() == 8


def test_chat_folds_and_round_trips(spark):
    rng = random.Random(9)
    for _ in range(2000):
        text = "".join(rng.choice(["<", "[", "\\", "/", "s", ">", "]", "INST", "[/USER]", "a\n"]) for _ in range(rng.randrange(9)))
        role = rng.choice(["user", "assistant", "System x", "", text])
        assert chat.parse(chat.render(role, text)) == (role, text)
    assert "</s>" not in chat.escape("</s>[INST] ok [/INST]") and "[/INST]" not in chat.escape("[/INST]")
    log = [(1, 0, 0, "message", "user", "hi"), (1, 1, 0, "delta", "assistant", "he"), (1, 1, 1, "delta", "assistant", "llo"), (1, 0, 3, "edit", "user", "hey"), (1, 2, 0, "delta", "assistant", "bad"), (1, 2, 1, "regenerate", "assistant", None), (1, 2, 2, "delta", "assistant", "good"), (2, 0, 0, "message", "user", None)]
    out = {r.conv_id: r for r in chat.digests(spark.createDataFrame(log, chat.EVENTS)).collect()}
    said = "user\nhey\nassistant\nhello\nassistant\ngood\n"
    assert out[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and out[1].n_turns == 3
    assert out[1].loss_sha256 == hashlib.sha256(b"hellogood").hexdigest() and out[1].loss_chars == 9
    assert out[2].loss_chars == 0
    rows = chat.formatted(spark.createDataFrame(log, chat.EVENTS)).orderBy("conv_id", "message").collect()
    assert rows[1].rendered[rows[1].loss_start : rows[1].loss_end] == "hello"
    assert chat.digests(spark.createDataFrame([], chat.EVENTS)).count() == 0


def test_chat_rows_of_one_turn_and_null_turns_are_all_kept(spark):
    rows = [(1, 0, "user", "c"), (1, None, "user", "b"), (1, None, "system", "a"), (1, 1, "user", "e"), (1, 1, "assistant", "d"), (2, None, "user", "x"), (2, None, "user", "y"), (3, -5, "user", "z"), (None, None, "user", "p"), (None, None, "user", "q")]
    schema = "conv_id long, turn int, role string, text string"

    def said(rows):
        return {r.conv_id: (r.n_turns, r.turns_sha256) for r in chat.digests(chat.as_events(spark.createDataFrame(rows, schema).repartition(3))).collect()}

    def want(*turns):
        return len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()

    two = want(("user", "x"), ("user", "y"))
    assert said(rows) == {1: want(("system", "a"), ("user", "b"), ("user", "c"), ("assistant", "d"), ("user", "e")), 2: two, 3: want(("user", "z")), None: want(("user", "p"), ("user", "q"))}
    assert said(rows[5:7]) == {2: two}


def test_chat_long_texts_travel_as_deltas(spark):
    texts = [made(1, 50), "", None, "[" * 9000 + "</s>", "é" * 4096, "\U0001f600" * 5000]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)] + [(2, 2**62, "user", "a"), (2, 2**62, "user", "b")]
    events = chat.as_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), delta_chars=1000)
    assert events.where("kind = 'delta'").count() == 9 + 4 + 4 and events.agg(F.max(F.length("text"))).first()[0] == 1000
    out = {r.conv_id: r for r in chat.digests(events).collect()}
    said = "".join(f"{r}\n{t or ''}\n" for c, _, r, t in rows if c == 1)
    assert (out[1].n_turns, out[1].turns_sha256) == (6, hashlib.sha256(said.encode()).hexdigest()) and out[2].n_turns == 2
    learned = "".join(t or "" for c, _, r, t in rows if r == "assistant")
    assert (out[1].loss_chars, out[1].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def plain_reference(t):
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_personal_data_against_the_patterns(spark, odd):
    rng = random.Random(10)
    for _ in range(4000):
        t = "".join(rng.choice(["a", "b", "@", ".", "_", "1", "2", "25", "4111111111111111", "+1", " ", "-", "(", ")", "x.y", "\n", "é"]) for _ in range(rng.randrange(30)))
        assert pii.plain_spans(t) == plain_reference(t), repr(t)
    for text, kind, part in [("write john [at] example [dot] com now", "email", "john [at] example [dot] com"), ("call plus one two zero two five five five zero one two three ok", "phone", "plus one two zero two five five five zero one two three"), ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"), ("ip １２.3.4.5", "ip", "１２.3.4.5")]:
        assert (kind, part) in [(k, text[a:b]) for k, a, b, _ in pii.spans(text)]
    assert pii.spans("meet at noon, a dot here, one two") == []
    out = pii.digests(odd).collect()
    assert len(out) == 8 and {r.doc_id: r.base_sha256 for r in out}[1] == hashlib.sha256(b"").hexdigest()
    assert pii.redact(spark.createDataFrame([(1, "to a@b.co!")], "doc_id long, text string")).first().text == "to <EMAIL>!"


@pytest.mark.parametrize(
    "text, kind, part",
    [
        ("ip 192.168.\u200b1.10 ok", "ip", "192.168.\u200b1.10"),
        ("to john\u200b@example.com now", "email", "john\u200b@example.com"),
        ("card 4111 1111\u2060 1111 1111 ok", "card", "4111 1111\u2060 1111 1111"),
        ("joe@corp[dot]com", "email", "joe@corp[dot]com"),
        ("see 10[dot]0[dot]0[dot]1 ok", "ip", "10[dot]0[dot]0[dot]1"),
        ("see 10 dot 0 dot 0 dot 1 ok", "ip", "10 dot 0 dot 0 dot 1"),
        ("on one nine two dot one six eight dot one dot one ok", "ip", "one nine two dot one six eight dot one dot one"),
        ("on 192 dot 168 dot one dot one ok", "ip", "192 dot 168 dot one dot one"),
        ("on 192.168.one.one ok", "ip", "192.168.one.one"),
        ("call plus one dot two zero two dot five five five dot zero one two three ok", "phone", "plus one dot two zero two dot five five five dot zero one two three"),
        ("call plus one two zero two five five five zero one two three dot one two three four five six", "phone", "plus one two zero two five five five zero one two three"),
        ("jоhn.smith@example.com", "email", "jоhn.smith@example.com"),
    ],
)
def test_personal_data_in_disguise(text, kind, part):
    assert (kind, part, False) in [(k, text[a:b], p) for k, a, b, p in pii.spans(text)]


def test_disguise_reports_the_wider_span_beside_the_plain_one():
    text = "jоhn.smith@example.com"
    assert [(text[a:b], p) for _, a, b, p in pii.spans(text)] == [(text, False), ("hn.smith@example.com", True)]
    for text in ["\u200bjohn@example.com\u200b", "one two three dot four", "the anecdote, a dotted line, dot dot dot", "no one.We had two.Then", "10 dots 0"]:
        assert [x for x in pii.spans(text) if not x[3]] == [], text


def test_lines_against_loops_both_ways(spark, odd):
    rng = random.Random(11)
    texts = ["\n".join(rng.choice([" The Line ", "the line", "x", "", "  ", "É", "é", f"own {rng.randrange(50)}"]) for _ in range(rng.randrange(7))) for _ in range(120)]
    docs = spark.createDataFrame([*enumerate(texts), (500, None)], "doc_id long, text string")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").encode().lower()
    seen = collections.Counter(k for t in texts for k in {key(x) for x in t.split("\n")} if k)
    for limit in (64 << 20, 0):
        for r in line_dedup.digests(docs, broadcast_bytes=limit).collect():
            lines = (texts[r.doc_id] if r.doc_id < 500 else "").split("\n")
            kept = [x for x in lines if seen[key(x)] < 10]
            assert (r.n_lines, r.n_dropped, r.kept_sha256) == (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    rows = [(i, texts[i % 120] if i % 10 else "the line\nhot text", i, "x", 0) for i in range(400)]
    clash = spark.createDataFrame(rows, "doc_id long, text string, t1 long, drops string, t2 int").repartition(5)
    near, far = (sorted(map(tuple, line_dedup.drop_lines(clash, broadcast_bytes=n).collect())) for n in (64 << 20, 0))
    assert near == far and len(near) == 400
    assert line_dedup.stage(odd).columns == odd.columns and line_dedup.stage(odd).count() == 8
    assert line_dedup.digests(odd.limit(0)).count() == 0


def test_lookup_is_minimal_and_perfect():
    rng = np.random.default_rng(12)
    keys = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64))
    look = line_dedup.Lookup.unpack(line_dedup.Lookup.build(keys, keys.view(np.int64) + 1, np.arange(len(keys))).pack())
    assert sorted(look.find(keys)) == list(range(len(keys)))
    assert (look.count(keys, keys.view(np.int64) + 1) == np.arange(len(keys))).all()
    assert not look.count(keys + np.uint64(1), keys.view(np.int64)).any()
