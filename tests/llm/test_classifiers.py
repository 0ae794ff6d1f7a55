"""Quality classifier and language kernels against plain loops."""

from __future__ import annotations

import random

import numpy as np
import pytest

from metricloom.llm import language_id, quality_classifier
from metricloom.llm.codes import encode


def test_words_that_repeat_share_one_feature():
    rng = random.Random(1)

    def text(repeats: bool) -> str:
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(20)]
        return " ".join(w for w in words for _ in range(3 if repeats else 1))

    good, bad = [text(False) for _ in range(80)], [text(True) for _ in range(80)]
    model = quality_classifier.fit(good[:60] + bad[:60], [1] * 60 + [0] * 60)
    assert quality_classifier.score(model, good[60:]).min() > 0.5 > quality_classifier.score(model, bad[60:]).max()
    pairs = quality_classifier.features(["aa aa bb", "", "cc cc", "dd"])[1]
    assert [(int(t), int(b) == quality_classifier.REPEATED) for t, b in zip(*pairs, strict=True)] == [(0, True), (0, False), (2, True)]


def test_descent_against_loops_over_characters():
    texts, labels = ["ab ab", "abc d", "xyz", "ab xyz q"], [1, 0, 1, 0]
    model = quality_classifier.fit(texts, labels, dim=3, epochs=2)
    rng = np.random.default_rng(7)
    vectors, output, bias = rng.uniform(-1, 1, (1 << quality_classifier.BUCKETS, 3)) / 3, np.zeros((3, 2)), np.log([0.5, 0.5])
    bags = [[int(b) for _, x in quality_classifier.features([t]) for b in x] for t in texts]
    step = 0
    for i in np.concatenate([rng.permutation(4) for _ in range(2)]):
        hidden = np.mean([vectors[b] for b in bags[i]], axis=0)
        z = hidden @ output + bias
        g = np.exp(z) / np.exp(z).sum() - np.eye(2)[labels[i]]
        g *= 0.2 * (1 - step / 8)
        back, share = output @ g, {b: bags[i].count(b) / len(bags[i]) for b in bags[i]}
        output -= np.outer(hidden, g)
        bias -= 0.1 * g
        size = sum(v * v for v in share.values())
        for b, v in share.items():
            vectors[b] -= v / size * back
        step += 1
    for text in [*texts, "", "ab q xyz"]:
        bag = [int(b) for _, x in quality_classifier.features([text]) for b in x]
        z = (np.mean([vectors[b] for b in bag], axis=0) @ output if bag else 0) + bias
        assert quality_classifier.score(model, [text])[0] == pytest.approx(np.exp(z)[1] / np.exp(z).sum(), abs=1e-5)


def test_language_score_against_an_explicit_kernel():
    rng = random.Random(2)
    words = {"en": ["the", "with", "thing", "house"], "de": ["der", "nicht", "schule", "ist"], "fr": ["le", "avec", "maison", "est"]}
    rows = [(" ".join(rng.choice(w) for _ in range(rng.randrange(4, 20))), k) for k, w in words.items() for _ in range(30)]
    texts, langs = zip(*rows, strict=True)
    model = language_id.fit(texts, langs, vocabulary=4096, landmarks=90)  # every text is a landmark, no n-gram is left out

    def grams(t):
        codes, _, ends = encode([t])
        slots = np.concatenate(language_id.spectrum(codes, ends))
        return {int(s) for s in slots if s >= 0 and model["column_of"][s] < model["marks"].shape[1]}

    def k(a, b):
        return len(a & b) / np.sqrt(max(len(a), 1) * max(len(b), 1))

    sets = [grams(t) for t in texts]
    assert all(len({s[i : i + n] for n in (1, 2, 3, 4) for i in range(len(s) - n + 1)}) == len(g) for s, g in zip(texts, sets, strict=True))
    names, turn = sorted(words), np.argsort(np.argsort(np.array(langs), kind="stable") % 1, kind="stable")[:90]
    marks = [sets[i] for i in turn]
    gram = np.array([[k(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(gram)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    z = np.column_stack([np.array([[k(a, b) for b in marks] for a in sets]) @ root, np.ones(len(sets))])
    y = np.where(np.array(langs)[:, None] == np.array(names), 1.0, -1.0)
    beta = np.linalg.solve(z.T @ z / 30 + 1e-2 / len(z) * np.eye(z.shape[1]), z.T @ y / 30)
    for t in ["the house with der", "nicht ist", "avec le thing", "q"]:
        margin = np.append(np.array([k(grams(t), b) for b in marks]) @ root, 1) @ beta
        lang, score = language_id.predict(model, [t])
        e = np.exp(4 * (margin - margin.max()))
        assert lang == [names[int(margin.argmax())]] and score[0] == pytest.approx(e.max() / e.sum(), abs=2e-3)
