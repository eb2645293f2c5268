"""Toxicity scores: learning, misspellings, plain recomputation, edge cases."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vacantic.llm import toxicity
from vacantic.llm.queries import op12_toxicity

SYLLABLES = ["th", "an", "er", "on", "re", "in", "ou", "ble", "sti", "mo", "la", "ke", "vi", "gra"]
BAD = ["moron", "scumbag", "worthless", "pathetic", "idiotic", "disgusting"]


def corpus(seed, n=700, bad=BAD):
    rng, out = random.Random(seed), []
    for i in range(n):
        words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 120))]
        toxic = int(rng.random() < 0.25)
        for _ in range(2 * toxic):
            words.insert(rng.randrange(len(words) + 1), rng.choice(bad) + rng.choice(["", ",", "!"]))
        out.append((i, " ".join(words).capitalize(), toxic))
    return out


@pytest.fixture(scope="module")
def model():
    rows = corpus(1)
    return toxicity.train([toxicity.words_of(t) for _, t, _ in rows], [y for *_, y in rows])


def test_new_texts_and_misspellings(model):
    rows = corpus(2)
    got, want = toxicity.scores(model, [t for _, t, _ in rows]) >= 0.5, np.array([y for *_, y in rows]) == 1
    assert (got == want).mean() >= 0.99
    clean = " ".join(t for _, t, y in rows if not y)
    assert toxicity.scores(model, [clean])[0] < 0.5  # some ten thousand clean words
    assert toxicity.scores(model, [clean + " you moron"])[0] >= 0.5  # one word at the end of a long text
    for odd in ("worthles", "patthetic", "disgustng", "scumbags"):
        bad, plain = toxicity.scores(model, [f"thanre {odd}", "thanre stibleke"])
        assert bad > plain + 0.2, odd


def test_equals_plain_sums(model):
    weights, text = model.weights, "Moron, thanre STIBLE é 漢字 scumbag! 12 --"
    odds = []
    for w in ("moron", "thanre", "stible", "é", "漢字", "scumbag"):
        ids, count = toxicity.ngram_buckets([w], len(weights))
        marked = f"<{w}>"
        assert count.tolist() == [sum(len(marked) - n + 1 for n in (3, 4, 5) if n <= len(marked))] and len(ids) == count[0]
        odds.append(sum(weights[i] for i in ids) / count[0])
    worst = max((a + b) / 2 for a, b in zip(odds, odds[1:])) + model.bias
    assert toxicity.scores(model, [text])[0] == pytest.approx(1 / (1 + math.exp(-worst)))
    alone, _ = toxicity.ngram_buckets(["moron"], 1 << 18)
    both, sizes = toxicity.ngram_buckets(["a", "moron", "漢字"], 1 << 18)
    assert both[sizes[0]:sizes[0] + sizes[1]].tolist() == alone.tolist()  # a word's n-grams don't depend on its neighbours


def test_slope_is_that_of_the_loss():
    """One round moves every parameter against the numerical slope."""
    texts, labels = [["ab", "cd"], ["ef", "cd", "gh"], ["ab"]], [1, 0, 0]
    options = dict(buckets=64, dim=2, decay=0.0, keep=1.0, rate=0.0, sharpest=0.0)
    start = toxicity.train(texts, labels, rounds=1, **options)
    moved = toxicity.train(texts, labels, rounds=1, **(options | {"rate": 1e-3}))

    def loss(m):
        total = 0.0
        for t, y, share in zip(texts, labels, (0.5, 0.25, 0.25)):  # each label weighs a half
            of_word = [m.weights[toxicity.ngram_buckets([w], 64)[0]].mean() for w in t]
            passages = [of_word[k:k + 2] for k in range(max(1, len(of_word) - 1))]
            odds = [np.mean(p) + m.bias for p in passages]
            total += share * np.mean([math.log(1 + math.exp(-z if y else z)) for z in odds])
        return total

    assert loss(moved) < loss(start)
    for i in np.ndindex(start.embeddings.shape):
        up = toxicity.Model(start.embeddings.copy(), start.softmax, start.bias, 2)
        up.embeddings[i] += 0.01
        slope, step = loss(up) - loss(start), moved.embeddings[i] - start.embeddings[i]
        assert abs(slope) < 1e-6 or np.sign(step) == -np.sign(slope)


def test_rows_and_columns(spark, model):
    texts = [None, "", " \n", "12 34 !!", "moron", "you MORON!", "fine", "fine", "a" * 50_000, "thanre " * 30_000 + "idiotic moron"]
    table = spark.createDataFrame([(None if i == 4 else 2**60 + 1, t, "mine") for i, t in enumerate(texts)], "doc_id bigint, text string, Score string")
    out = toxicity.detect(table.repartition(3), model)
    assert out.columns == ["doc_id", "text", "score", "predicted"]
    got = {r.text: r for r in out.collect()}
    assert len(got) == 9 and got[None].score == got[""].score == got["12 34 !!"].score == 0.0
    assert got["moron"].doc_id is None and got["moron"].predicted == 1 and got["you MORON!"].predicted == 1 and got["fine"].predicted == 0
    assert got[texts[-1]].predicted == 1
    empty = spark.createDataFrame([], table.schema)
    assert toxicity.detect(empty, model).count() == 0


def test_fit_bounds_and_odd_labels(spark):
    rows = corpus(3, 300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(5, None), (None, "scumbag"), (7, "a")] + [(9, "repeated idiotic")] * 50, "doc_id bigint, text string")
    marks = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (1, None), (2, 7), (10_000, 1)], "doc_id bigint, toxic int")
    def sample(docs, marks, rows, chars):
        return [tuple(r) for r in toxicity.sample(docs, marks, "toxic", rows, chars).collect()]

    pairs = sample(docs, marks, (40, 20), 10**9)
    assert 15 <= sum(y for _, y in pairs) <= 20 and 35 <= sum(1 - y for _, y in pairs) <= 40
    assert pairs == sample(docs.repartition(5), marks.repartition(3), (40, 20), 10**9)
    few = sample(docs, marks, (4000, 2000), 3000)
    assert sum(len(t) for t, y in few if y) <= 3000 and sum(len(t) for t, y in few if not y) <= 3000 and few
    for only, share in ((0, 0.0), (1, 1.0)):
        m = toxicity.fit(docs, marks.where(F.col("toxic") == only))
        assert toxicity.scores(m, ["some words", None]).tolist() == [share, 0.0]
    nothing = toxicity.fit(docs, marks.limit(0))
    assert toxicity.scores(nothing, ["some words"]).tolist() == [0.0]
    assert toxicity.fit(docs.limit(0), marks).constant == 0.0


def test_held_out_rows_of_the_table(spark):
    sf = "/root/testdata/sf0.01"
    out = op12_toxicity(spark, sf)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = out.collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    unseen = [(r.score, marks[r.doc_id]) for r in rows if r.held_out and r.doc_id in marks]
    pairs = [(a, b) for a, y in unseen if y for b, z in unseen if not z]
    assert sum(a > b for a, b in pairs) >= 0.95 * len(pairs)
