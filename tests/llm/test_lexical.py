"""Ranked search against a plain count of terms."""

import math
import random
import re
from collections import Counter

import pytest

from vacantic.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id bigint, text string, score string", "item_id bigint, text string, rank string"


def split(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    found = [(i, Counter(split(t))) for i, t in docs]
    found = [(i, c) for i, c in found if c]
    n_docs, n_terms, df = len(found), sum(sum(c.values()) for _, c in found), Counter(t for _, c in found for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(split(t))
    out = []
    for item, ts in wanted.items():
        scores = []
        for i, c in found:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in ts if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, rank, None if unknown else i, -s) for rank, (s, unknown, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def made(spark, docs, items, parts=5, **more):
    d = spark.createDataFrame([(i, t, "own") for i, t in docs], DOCS).repartition(parts)
    return sorted(map(tuple, lexical.search(d, spark.createDataFrame([(i, t, "own") for i, t in items], ITEMS), **more).collect()), key=str)


@pytest.mark.parametrize("k, block_bytes", [(50, lexical.BLOCK_BYTES), (3, 400)])
def test_equals_plain_scores(spark, monkeypatch, k, block_bytes):
    rng = random.Random(k)
    vocabulary = [f"w{i}" for i in range(60)] + ["ÜBER", "über", "漢字", "Straße", "a", "ab", "abc", "İ", "x1y", "🙂", "é"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "-", "\n", "_", "\x00"]) for _ in range(rng.randint(0, n)))
    docs = [(i, text(40)) for i in range(400)] + [(None, "ab abc"), (None, "ab abc"), (2**60 + 1, "ab abc"), (7, "ab ABC"), (500, None), (501, ""), (502, "--"), (503, text(30000))]
    items = [(i, text(12)) for i in range(25)] + [(3, "ab"), (None, "abc w1"), (None, "w2"), (90, None), (91, ""), (92, "nowhere"), (2**60 + 3, "AB ab Ab")]
    assert made(spark, docs, items, k=k, block_bytes=block_bytes) == plain(docs, items, k)


def test_only_whole_terms(spark):
    docs = [(1, "cat"), (2, "concatenate cats"), (3, "cat-cat_cat"), (4, "Cat cat dog"), (5, "caté écat"), (6, "dog")]
    got = made(spark, docs, [(1, "cat cat")])
    assert got == plain(docs, [(1, "cat")], 50) and {r[2] for r in got} == {1, 3, 4}


def test_small_buffers_keep_the_best(spark, monkeypatch):
    best = lexical.Best(2, 3)
    best.most = 4
    import numpy as np
    for a in range(0, 30, 5):
        ids = np.arange(a, a + 5)
        best.add(np.stack([ids % 7, 100 - ids], axis=1), ids, np.zeros(5, bool))
    item, score, _, ids = best.cut()
    assert list(zip(item, score, ids)) == [(0, 6, 6), (0, 6, 13), (0, 6, 20), (1, 100, 0), (1, 99, 1), (1, 98, 2)]


def test_empty_tables(spark):
    assert made(spark, [], [(1, "a")]) == [] and made(spark, [(1, "a")], []) == []
    assert made(spark, [(1, None)], [(1, None)]) == [] and made(spark, [(1, "b")], [(1, "a")]) == []
