"""Language identification with hyperdimensional profiles.

Every symbol (a lower-case letter, or the blank around words) owns a random vector of +1 and -1.  An n-gram is the
product of its letters' vectors, each permuted (rotated) by its place, so that order counts; a text is the sum of
its n-grams' vectors, a language the sum of its texts.  A text gets the language with the largest cosine.

Defined results: null text and text without a letter get `und` and score 0; two languages at the same cosine give the
one that sorts first; a table without any labelled text yields an empty model, and then every text gets `und`;
rows may repeat (each counts); columns named like an added one are replaced, all others are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantic.functions.text import small_batches
from vacantic.llm.common import by_chars, free_name, mix64, process_cache

UNKNOWN = "und"
BLOCK = 4096  # n-gram vectors held at once
BATCH_CHARS = 300_000  # code points whose n-grams are held at once


@dataclass
class Model:
    """Prototypes: one unit vector per language, in the order of the names."""

    languages: list[str]
    prototypes: np.ndarray
    n: int
    dim: int


def _is_letter() -> np.ndarray:
    cache = process_cache("langid")
    if "letters" not in cache:
        cache["letters"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return cache["letters"]


def symbol_vectors(codes: np.ndarray, dim: int) -> np.ndarray:
    """Random +1/-1 vectors that depend on the code points only."""
    words = np.arange((dim + 63) // 64, dtype=np.uint64)
    with np.errstate(over="ignore"):
        seeds = codes.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + words * np.uint64(0xD1B54A32D192ED03)
    bits = np.unpackbits(mix64(mix64(seeds + np.uint64(1))).view(np.uint8), axis=1)[:, :dim]
    return bits.astype(np.int8) * 2 - 1


def _ngrams(texts: list, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Alphabet (code points), and for every n-gram occurrence its text and its letters as one number in base |alphabet|."""
    marked = [" " + t.lower() + " " for t in texts]
    lens = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _is_letter()[codes]
    keep = letter.copy()
    keep[:-1] |= letter[1:]  # the blank before a word
    keep[np.cumsum(lens) - 1] = True  # and the one after the last
    owner = np.repeat(np.arange(len(marked)), lens)[keep]
    symbols = np.where(letter, codes, 32)[keep]
    present = np.zeros(0x110000, dtype=bool)
    present[symbols] = True
    alphabet = np.flatnonzero(present)
    place = np.zeros(0x110000, dtype=np.int64)
    place[alphabet] = np.arange(len(alphabet))
    ids, size = place[symbols], len(symbols) - n + 1
    if size <= 0:
        return alphabet, np.zeros(0, np.int64), np.zeros(0, np.int64)
    number = np.zeros(size, dtype=np.int64)
    for k in range(n):
        number = number * len(alphabet) + ids[k:k + size]
    whole = owner[:size] == owner[n - 1:]
    return alphabet, owner[:size][whole], number[whole]


def _compact(numbers: np.ndarray, space: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers, and the place of each occurrence among them."""
    if space <= 1 << 22:
        used = np.flatnonzero(np.bincount(numbers, minlength=space))
        place = np.zeros(space, dtype=np.int64)
        place[used] = np.arange(len(used))
        return used, place[numbers]
    return np.unique(numbers, return_inverse=True)


def _bundles(owner: np.ndarray, groups: int, numbers: np.ndarray, alphabet: np.ndarray, n: int, dim: int) -> np.ndarray:
    """Sum of the n-gram vectors of each group of texts."""
    out = np.zeros((groups, dim), dtype=np.float32)
    if not len(numbers):
        return out
    used, place = _compact(numbers, len(alphabet) ** n)
    letters = symbol_vectors(alphabet, dim)
    rolled = [np.roll(letters, n - 1 - k, axis=1) for k in range(n)]
    order = np.argsort(place >> 12, kind="stable") if len(used) > BLOCK else None
    cells, place = (owner, place) if order is None else (owner[order], place[order])
    for start in range(0, len(used), BLOCK):
        block = used[start:start + BLOCK]
        vectors, rest = None, block
        for k in range(n - 1, -1, -1):  # last letter first
            part = rolled[k][rest % len(alphabet)]
            vectors = part if vectors is None else vectors * part
            rest = rest // len(alphabet)
        a, b = np.searchsorted(place >> 12, (start >> 12, (start >> 12) + 1)) if order is not None else (0, len(place))
        counts = np.bincount(cells[a:b] * len(block) + place[a:b] - start, minlength=groups * len(block))
        out += counts.astype(np.float32).reshape(groups, len(block)) @ vectors.astype(np.float32)
    return out


def fit(docs: DataFrame, label: str = "lang", text: str = "text", n: int = 3, dim: int = 1024,
        max_languages: int = 2000) -> Model:
    """Learn one prototype per label from every row with a label and a text.

    The sums travel per partition and label and are added by Spark; only the prototypes (labels x dim numbers) come to
    the driver.  More labels than `max_languages` raise an error, as the model is shipped to every task.
    """
    def sums(frames):
        total: dict[str, np.ndarray] = {}
        for pdf in frames:
            texts, labels = pdf["t"].tolist(), pdf["l"].tolist()
            for a, b in by_chars(texts, BATCH_CHARS):
                names = sorted(set(labels[a:b]))
                number = {x: i for i, x in enumerate(names)}
                alphabet, owner, grams = _ngrams(texts[a:b], n)
                groups = np.array([number[x] for x in labels[a:b]], dtype=np.int64)
                part = _bundles(groups[owner], len(names), grams, alphabet, n, dim)
                for x, i in number.items():
                    total[x] = total.get(x, 0) + part[i].astype(np.int64)
        for x, v in total.items():
            yield pd.DataFrame({"l": x, "pos": np.arange(dim, dtype=np.int32), "v": v})

    small_batches()
    rows = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("t"), F.col(label).alias("l"))
    added = rows.mapInPandas(sums, "l string, pos int, v bigint").groupBy("l", "pos").agg(F.sum("v").alias("v")) \
        .groupBy("l").agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("v"))
    found = sorted((r["l"], [x["v"] for x in r["v"]]) for r in added.limit(max_languages + 1).collect())
    if len(found) > max_languages:
        raise ValueError(f"more than {max_languages} labels: not a set of languages")
    raw = np.array([v for _, v in found], dtype=np.float64).reshape(len(found), dim)
    norm = np.linalg.norm(raw, axis=1, keepdims=True)
    return Model([x for x, _ in found], (raw / np.where(norm == 0, 1, norm)).astype(np.float32), n, dim)


def scores(model: Model, texts: list) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, cosine and number of n-grams of each text (None allowed)."""
    pred, score, size_of = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    for a, b in by_chars(texts, BATCH_CHARS):
        part = [t or "" for t in texts[a:b]]
        alphabet, owner, grams = _ngrams(part, model.n)
        if not model.languages or not len(grams):
            continue
        size_of[a:b] = np.bincount(owner, minlength=len(part))
        size = len(alphabet) ** model.n
        rows = max(1, (16 << 20) // min(size, max(1, len(grams))))
        for s in range(0, len(part), rows):
            e = min(len(part), s + rows)
            x, y = np.searchsorted(owner, (s, e))
            doc = _bundles(owner[x:y] - s, e - s, grams[x:y], alphabet, model.n, model.dim)
            norm = np.linalg.norm(doc, axis=1, keepdims=True)
            cos = (doc / np.where(norm == 0, 1, norm)).astype(np.float64) @ model.prototypes.T.astype(np.float64)
            best = cos.argmax(axis=1)
            for i in np.flatnonzero(size_of[a + s:a + e]):
                pred[a + s + i] = model.languages[best[i]]
                score[a + s + i] = min(1.0, max(0.0, float(cos[i, best[i]])))
    return pred, score, size_of


def language(model: Model, text: Column) -> Column:
    """Struct (lang_pred, score, n_grams) of a text column."""
    small_batches()

    @F.pandas_udf("lang_pred string, score double, n_grams bigint")
    def run(batches: pd.Series) -> pd.DataFrame:
        pred, score, size = scores(model, batches.tolist())
        return pd.DataFrame({"lang_pred": pred, "score": score, "n_grams": size})

    return run(text)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add `lang_pred` and `score` to every row."""
    tmp = free_name(docs, "_language")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    return docs.withColumn(tmp, language(model, F.col(f"`{text}`"))).select(*kept, f"{tmp}.lang_pred", f"{tmp}.score")


def reject(docs: DataFrame, model: Model, text: str = "text", min_score: float = 0.3, min_grams: int = 200) -> DataFrame:
    """Drop the rows without a known language; columns stay as they are.

    These are rows without a letter, and rows of at least `min_grams` n-grams whose cosine stays below `min_score`, as
    no prose of a learned language does.  The cosine of a shorter text says little, so short texts stay.
    """
    tmp = free_name(docs, "_language")
    unlike = (F.col(f"{tmp}.n_grams") >= min_grams) & (F.col(f"{tmp}.score") < min_score)
    return docs.withColumn(tmp, language(model, F.col(f"`{text}`"))).where((F.col(f"{tmp}.lang_pred") != UNKNOWN) & ~unlike).drop(tmp)
