"""Toxicity: subword-bag embeddings averaged into a linear softmax, learned jointly in numpy.

A word is the bag of its hashed character n-grams (with marks at both ends), each with an embedding; a passage of a few
consecutive words is the mean of its words' means, and a linear softmax over it gives the probability of label 1.  An
unseen misspelling shares most n-grams with the word it comes from, and so its vector.

A text is as toxic as its worst passage, wherever it is and however long the text: labels stand on texts, so a text's
passages are weighted by how toxic they look, evenly at first and ever more sharply while embeddings and softmax are
learned (multiple-instance learning).  Scoring is linear in the words: one number per distinct word, running means, a maximum.

While learning, some n-grams are left out at random in every round, so that no single one carries a word.  The model is
learned in one task from a sample of the labelled rows with a bound in rows and code points for each label, taken in the
order of a hash of the key; everything else reads all rows and whole texts.  Only the model comes to the driver.

Defined results: a text without a word (null, empty, no letter) gets the score 0; label rows with null key or a label other
than 0 and 1 are not used; a key with both labels counts once with each, a key with several texts with the smallest one;
where the sample lacks one of the labels, every text with a word gets the share of label 1 (0 without any label); rows may
repeat and each gets its score; other columns stay, and columns named like an added one (`score`, `predicted`) are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantic.llm.common import by_chars, free_name, process_cache

EDGES = ".,;:!?()[]{}<>\"'`*#%&$-_~^/\\|+=…¿¡«»„“”‘’"
LETTER = re.compile(r"[^\W\d_]")
SHORTEST, LONGEST = 3, 5
SLICE_CHARS = 1_000_000
WORDS_KEPT = 300_000
WORDS_AT_ONCE = 50_000


@dataclass
class Model:
    """`weights[g]`: what n-gram bucket g adds to the log-odds of label 1 (embedding times softmax difference)."""

    embeddings: np.ndarray
    softmax: np.ndarray
    bias: float
    passage: int
    constant: float | None = None

    @property
    def weights(self) -> np.ndarray:
        return (self.embeddings @ (self.softmax[:, 1] - self.softmax[:, 0])).astype(np.float64)


def words_of(text: str | None) -> list[str]:
    """Lower-case words between blanks, without marks around them; a word has a letter."""
    return [w for w in (x.strip(EDGES) for x in text.lower().split()) if w.isalpha() or LETTER.search(w)] if text else []


def ngram_buckets(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams (lengths 3 to 5) of <word>, word by word, and their number per word (one at least)."""
    marked = [f"<{w}>".encode("utf-32-le", "surrogatepass") for w in words]
    size = np.fromiter((len(m) >> 2 for m in marked), np.int64, len(marked))
    codes = np.frombuffer(b"".join(marked), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words), dtype=np.int32), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(codes))  # symbols from here to the word's end
    hashed, found, owners = np.zeros(len(codes), np.uint64), [], []
    with np.errstate(over="ignore"):
        for n in range(1, LONGEST + 1):
            shifted = np.append(codes[n - 1:], np.zeros(min(n - 1, len(codes)), np.uint64))
            hashed = (hashed ^ (hashed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + shifted + np.uint64(n)
            if n >= SHORTEST:
                whole = left >= n
                spread = (hashed[whole] ^ (hashed[whole] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                found.append(((spread >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32))
                owners.append(owner[whole])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(found)[order], np.bincount(owner, minlength=len(words))


def _means(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Mean of consecutive runs of values (no run is empty)."""
    return np.add.reduceat(values, np.cumsum(counts) - counts) / counts


def _passages(sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, word after the last one, and text of every run of `width` words (of a shorter text: the whole of it)."""
    number = np.maximum(sizes - width + 1, 1)
    text = np.repeat(np.arange(len(sizes), dtype=np.int32), number)
    shift = np.cumsum(sizes) - sizes - (np.cumsum(number) - number)
    first = np.arange(len(text), dtype=np.int32) + shift.astype(np.int32)[text]
    return first, first + np.minimum(sizes, width).astype(np.int32)[text], text


def _within(last: np.ndarray, first: np.ndarray, values: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0.0], np.cumsum(values)))
    return sums[last] - sums[first]


def train(texts: list[list[str]], labels: list[int], passage: int = 2, buckets: int = 1 << 18, dim: int = 8, rounds: int = 40,
          rate: float = 0.05, decay: float = 0.01, sharpest: float = 3.0, keep: float = 0.8, seed: int = 1) -> Model:
    """Learn from texts (lists of words) and labels 0 or 1: Adam over all passages, embeddings and softmax together.

    `sharpest`: how strongly the last rounds prefer a text's worst passage; `keep`: share of n-grams used in a round.
    """
    rng = np.random.default_rng(seed)
    kept = [(t, y) for t, y in zip(texts, labels) if t]
    y = np.array([y for _, y in kept], dtype=np.int64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros((1, dim), np.float32), np.zeros((dim, 2), np.float32), 0.0, passage, float(np.mean(labels)) if labels else 0.0)
    names: dict[str, int] = {}
    flat = np.fromiter((names.setdefault(w, len(names)) for t, _ in kept for w in t), np.int32)
    parts = [ngram_buckets(list(names)[a:a + WORDS_AT_ONCE], buckets) for a in range(0, len(names), WORDS_AT_ONCE)]
    grams, per_word = (np.concatenate(x) for x in zip(*parts))
    words = len(names)
    del names, parts
    first, last, text = _passages(np.fromiter((len(t) for t, _ in kept), np.int64, len(kept)), passage)
    length, starts = (last - first).astype(np.float32), np.searchsorted(text, np.arange(len(kept)))
    del kept
    share = (0.5 / np.bincount(y, minlength=2))[y]  # both labels weigh the same
    out = [rng.uniform(-0.5 / dim, 0.5 / dim, (buckets, dim)).astype(np.float32), rng.normal(0, 0.5, (dim, 2)).astype(np.float32), np.zeros(2, np.float32)]
    mean, square = [np.zeros_like(p) for p in out], [np.zeros_like(p) for p in out]
    for step in range(1, rounds + 1):
        embeddings, softmax, bias = out
        here = (rng.random(buckets) < keep).astype(np.float32) / np.float32(keep)
        of_word = _means((embeddings @ (softmax[:, 1] - softmax[:, 0]) * here)[grams], per_word)
        odds = _within(last, first, of_word[flat]).astype(np.float32) / length + (bias[1] - bias[0])
        heat = odds * np.float32(sharpest * (step - 1) / rounds)
        weight = np.exp(heat - np.maximum.reduceat(heat, starts)[text])
        weight *= (share / np.add.reduceat(weight, starts)).astype(np.float32)[text]
        # slope of the loss by the logit of label 1; label 0 has its negative
        miss = (1 / (1 + np.exp(-np.clip(odds, -50, 50))) - y.astype(np.float32)[text]) * weight
        per = miss / length
        by_place = np.cumsum(np.bincount(first, per, len(flat) + 1) - np.bincount(last, per, len(flat) + 1))[:-1]
        by_word = (np.bincount(flat, by_place, words) / per_word).astype(np.float32)
        by_gram = np.bincount(grams, np.repeat(by_word, per_word), buckets).astype(np.float32) * here
        slope = np.stack([-by_gram, by_gram], axis=1)
        total = np.float32(miss.sum())
        embeddings *= 1 - decay
        for p, g, m, s in zip(out, (slope @ softmax.T, embeddings.T @ slope, np.array([-total, total])), mean, square):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-8)
    return Model(out[0], out[1], float(out[2][1] - out[2][0]), passage)


def scores(model: Model, texts: Iterable[str | None], memory: dict | None = None, weights: np.ndarray | None = None) -> np.ndarray:
    """Probability of label 1 of each text's worst passage; `memory` keeps numbers of words between calls."""
    split = [words_of(t) for t in texts]
    out = np.zeros(len(split))
    if model.constant is not None:
        out[[bool(t) for t in split]] = model.constant
        return out
    memory, weights = {} if memory is None else memory, model.weights if weights is None else weights
    if len(memory) > WORDS_KEPT:
        memory.clear()
    new = list({w for t in split for w in t if w not in memory})
    if new:
        grams, per_word = ngram_buckets(new, len(weights))
        memory.update(zip(new, _means(weights[grams], per_word).tolist()))
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    full = np.flatnonzero(sizes)
    if len(full):
        values = np.fromiter((memory[w] for t in split for w in t), np.float64, int(sizes.sum()))
        first, last, text = _passages(sizes[full], model.passage)
        odds = _within(last, first, values) / (last - first) + model.bias
        out[full] = 1 / (1 + np.exp(-np.clip(np.maximum.reduceat(odds, np.searchsorted(text, np.arange(len(full)))), -500, 500)))
    return out


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: tuple[int, int], chars: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(t, y): text and label of the first rows of each label by the hash of the key, at most `rows[label]` and `chars` code points
    each, in that order in one partition."""
    pairs = labels.select(F.col(key).cast("bigint").alias("k"), F.col(label).cast("int").alias("y")).where("k IS NOT NULL AND y IN (0, 1)").distinct()
    by_hash = [F.xxhash64("k"), F.col("k")]
    ids = [tuple(r) for y in (0, 1) for r in pairs.where(F.col("y") == y).orderBy(*by_hash).limit(rows[y]).collect()]
    wanted = F.broadcast(docs.sparkSession.createDataFrame(ids, "k bigint, y int"))  # rows[0] + rows[1] rows at most
    found = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull()).join(wanted, "k") \
        .groupBy("k", "y").agg(F.min("t").alias("t"))
    so_far = Window.partitionBy("y").orderBy(*by_hash).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bounded = found.withColumn("n", F.sum(F.char_length("t")).over(so_far)).where(F.col("n") <= chars)
    return bounded.repartition(1).sortWithinPartitions("y", *by_hash).select("t", "y")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: tuple[int, int] = (4000, 2000), chars: int = 12_000_000, **options) -> Model:
    """Learn `label` (0 or 1) of the labelled keys from their texts; `rows` and `chars` bound the sample of each label."""
    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts, labels = [], []
        for frame in frames:
            texts += [words_of(t) for t in frame["t"]]
            labels += frame["y"].tolist()
        m = train(texts, labels, **options)
        yield pd.DataFrame({"e": [m.embeddings.tobytes()], "s": [m.softmax.tobytes()], "bias": [m.bias], "passage": [m.passage], "constant": [m.constant]})

    got = sample(docs, labels, label, rows, chars).mapInPandas(learn, "e binary, s binary, bias double, passage int, constant double").first()
    if got is None:
        return train([], [], **options)
    softmax = np.frombuffer(got["s"], np.float32).reshape(-1, 2)
    return Model(np.frombuffer(got["e"], np.float32).reshape(-1, len(softmax)), softmax, got["bias"], got["passage"], got["constant"])


def toxicity(model: Model, text: Column, spark) -> Column:
    """Score of a text column."""
    shared = spark.sparkContext.broadcast((model, model.weights))

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        model, weights = shared.value
        memory = process_cache("toxicity").setdefault("toxicity", {})
        if memory.get("model") is not shared:
            memory.clear()
            memory.update(model=shared, words={})
        found, values = np.zeros(len(texts)), texts.tolist()
        for a, b in by_chars(values, SLICE_CHARS):
            found[a:b] = scores(model, values[a:b], memory["words"], weights)
        return pd.Series(found)

    return run(text)


def detect(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add `score` (0 to 1) and `predicted` (1 from 0.5 on) to every row."""
    tmp = free_name(docs, "_toxicity")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("score", "predicted")]
    return docs.withColumn(tmp, toxicity(model, F.col(f"`{text}`"), docs.sparkSession)) \
        .select(*kept, F.col(tmp).alias("score"), (F.col(tmp) >= 0.5).cast("int").alias("predicted"))
