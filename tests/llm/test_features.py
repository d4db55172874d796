"""What the two ordinal models learn from, held against plain versions: features and ratings of quality, grades of severity."""

import random
import re
import statistics
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framewright.llm import quality
from framewright.llm.text import grams, mix64, split_words
from framewright.llm.toxicity import BITS, distinct_words, severity

WORDS = rb"[^\x20\x09-\x0d]+"


def hashes(words):
    """Hashes of lower-cased words and of neighbouring pairs, as the library makes them."""
    (w,) = split_words(pa.array([b" ".join(words)], pa.binary()))
    h = w.hashes(lower=True)
    pairs, inside = grams(h, w.offsets, 2)
    return h.tolist(), pairs[inside].tolist()


def number(code):
    return int(mix64(np.array([code], np.uint64))[0] >> np.uint64(64 - quality.BITS))


def plain_features(text):
    words = re.findall(WORDS, text.encode())
    n, out = len(words), Counter()
    h, pairs = hashes(words) if words else ([], [])
    share = 1 / max(n, 1)
    kind = lambda b: 1 if b >= 128 or chr(b).islower() else 2 if chr(b).isupper() else 3 if chr(b).isdigit() else b
    for w in words:
        last = [kind(w[-1 - k]) if len(w) > k else 0 for k in range(3)]
        ending = last[0] | last[1] << 8 | last[2] << 16
        out[number(ending)] += share
        out[number(ending | kind(w[0]) << 24 | min(len(w), 8) << 32 | 1 << 40)] += share
    known = {number(x ^ 1 << 50) for x in h}
    for feature in [*known, *{number(x) for x in pairs}]:
        out[feature] += share**0.5
    same = sum(a == b for a, b in zip(h, h[1:]))
    for step, mark in ((min(same * share * 20, 19), 1), (min(len(known) * share * 20, 19), 2), (np.log2(n + 1), 3)):
        out[number(int(step) | mark << 48)] += 1
    return out


def test_quality_features_against_a_plain_version():
    rng = random.Random(12)
    vocabulary = ["the", "The", "THE", "river", "a1", "42", "x.", "(note)", "é", "ünï", "漢字", "-", "longerthaneight", "ab"]
    texts = ["", " \n", "one", "same same same same", *(" ".join(rng.choices(vocabulary, k=rng.randrange(1, 60))) for _ in range(60)), "word " * 5000]
    row = 0
    for offsets, features, values in quality.text_features(pa.array([*texts, None], pa.string())):
        for a, b in zip(offsets, offsets[1:]):
            want = plain_features(([*texts, None][row]) or "")
            assert dict(zip(features[a:b].tolist(), values[a:b].tolist())) == pytest.approx(dict(want))
            row += 1
    assert row == len(texts) + 1


def test_ratings_against_a_plain_version(spark):
    rng = random.Random(13)
    texts = ["", None, "\n\n", "a", *("\n".join(rng.choices(["a line", "another", "third one", " ", ""] + [f"own {i}" for i in range(30)], k=rng.randrange(1, 40))) for _ in range(80))]
    rows = [(i, t, rng.choice((0, 1, 1))) for i, t in enumerate(texts)]
    got = {r.i: r.r for r in spark.createDataFrame(rows, "i int, text string, grade int").withColumn("text", F.coalesce("text", F.lit(""))).select("i", quality.rating().alias("r")).collect()}
    for i, text, grade in rows:
        lines = [x for x in (text or "").split("\n") if x.strip()]
        clean = 10 * (len(lines) - len(set(lines))) < max(len(lines), 1)
        assert got[i] == (0 if not grade else 2 if clean else 1), text
    assert set(got.values()) == {0, 1, 2}


def plain_severity(sets, toxic):
    """Grades by marked words, each half judged by the other half's."""
    grades, many = [], []
    for h in (0, 1):
        other = [i for i in range(len(sets)) if i % 2 != h]
        bad, good = [i for i in other if toxic[i]], [i for i in other if not toxic[i]]
        n_bad, n_good = max(len(bad), 1), max(len(good), 1)
        marked = set()
        for f in set().union(*sets):
            b, g = sum(f in sets[i] for i in bad) / n_bad, sum(f in sets[i] for i in good) / n_good
            if b >= 0.005 and b >= 10 * (g + 0.5 / n_good):
                marked.add(f)
        many += [(i, len(sets[i] & marked)) for i in range(len(sets)) if i % 2 == h]
    many = dict(many)
    middle = statistics.median(many[i] for i in range(len(sets)) if toxic[i]) if any(toxic) else 0
    for i, bad in enumerate(toxic):
        grades.append(1 + (many[i] > middle) if bad else 0)
    return grades


def test_severity_grades_against_a_plain_version():
    rng = random.Random(14)
    texts, toxic = [], []
    for i in range(240):
        bad = i % 3 == 0
        words = rng.choices([f"plain{k}" for k in range(80)], k=20) + rng.choices(["vile", "nasty", "rotten", "foul", "grim"], k=rng.randrange(1, 5)) * bad
        texts.append(" ".join(words))
        toxic.append(int(bad))
    ((offsets, features, _),) = distinct_words(pa.array(texts))
    sets = [set(features[a:b].tolist()) for a, b in zip(offsets, offsets[1:])]
    assert all(len(s) == b - a for s, a, b in zip(sets, offsets, offsets[1:])) and features.max() < 1 << BITS
    got = severity(offsets, features, np.array(toxic)).tolist()
    assert got == plain_severity(sets, toxic) and set(got) == {0, 1, 2}
    assert severity(offsets, features, np.zeros(240)).tolist() == [0] * 240
