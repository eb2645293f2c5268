"""Scores by cross-entropy difference of two character n-gram models.

The target model counts the n-grams of the chosen documents, the background model those of all others; both cover every
document, share one vocabulary (the characters met in either) and the same smoothing.  A character's loss is the
negative logarithm of

    (count(context, character) + weight * p(character)) / (count(context) + weight)

with p(character) = (count(character) + 1) / (characters + vocabulary).  A document's score is its mean loss under the
target model minus that under the background model: negative for documents like the target.

Documents are dealt into blocks.  A block counts its own distinct n-grams; the counts meet per context in Spark, which
yields every n-gram's two losses; each block gets back the losses of its own n-grams only and adds them up per
document.  So nothing that grows with the corpus is broadcast or held by one task.

Defined results: null and empty texts have no characters and null losses and score; without a target (or a background)
document that model gives each vocabulary character the same probability; characters before a text's beginning are
blanks; a row that repeats counts again; a null id is allowed and is never a target; other columns are not carried.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vacantic.llm.common import by_chars, nullable_ids, stored

N = 4  # three characters of context fill one 64-bit number
BITS = 21


def _grams(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, context and character of every position; a text is led by N - 1 blanks."""
    lead = " " * (N - 1)
    padded = [lead + t for t in texts]
    lens = np.fromiter(map(len, padded), dtype=np.int64, count=len(padded))
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(padded)), lens)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(lens) - lens, lens)
    at = np.flatnonzero(place >= N - 1)
    context = np.zeros(len(at), dtype=np.int64)
    for k in range(N - 1, 0, -1):
        context = (context << BITS) | codes[at - k]
    return owner[at], context, codes[at]


def _distinct(context: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (context, character), sorted, and the place of each position among them."""
    contexts, c = np.unique(context, return_inverse=True)
    both, place = np.unique(c * (1 << BITS) + char, return_inverse=True)
    return contexts[both >> BITS], both & ((1 << BITS) - 1), place


def _texts(pdf: pd.DataFrame) -> list:
    return [t or "" for t in pdf["text"]]


def score(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", weight: float = 5.0,
          block_chars: int = 8_000_000) -> DataFrame:
    """(key, n_chars, loss_target, loss_background, score) of every row; `target` holds the keys of the target documents."""
    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("text"))
    chars, n = rows.agg(F.sum(F.char_length("text")), F.count("*")).first()
    blocks = max(1, min(n, math.ceil((chars or 0) / block_chars)))
    block = F.pmod(F.xxhash64("id", F.when(F.col("id").isNull(), F.xxhash64("text"))), F.lit(blocks)).cast("int")
    dealt = rows.withColumn("block", block).withColumn("no_id", F.col("id").isNull()).withColumn("id", F.coalesce("id", F.lit(0)))
    chosen = target.select(F.col(f"`{key}`").cast("bigint").alias("id")).where("id is not null").distinct().withColumn("text", F.lit(None).cast("string")) \
        .withColumn("block", block).select("block", "id")

    def count(_, part: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        inside = part["id"].isin(set(wanted["id"])).to_numpy() & ~part["no_id"].to_numpy(dtype=bool)
        texts, total = _texts(part), {}
        for a, b in by_chars(texts, 2_000_000):
            owner, context, char = _grams(texts[a:b])
            ctx, ch, place = _distinct(context, char)
            mine = inside[a:b][owner]
            t, g = np.bincount(place, mine, len(ctx)), np.bincount(place, ~mine, len(ctx))
            total.setdefault("c", []).append(ctx), total.setdefault("h", []).append(ch)
            total.setdefault("t", []).append(t), total.setdefault("g", []).append(g)
        if not total:
            return pd.DataFrame({"block": [], "context": [], "char": [], "t": [], "g": []}).astype("int64")
        ctx, ch, place = _distinct(np.concatenate(total["c"]), np.concatenate(total["h"]))
        t, g = (np.bincount(place, np.concatenate(total[x]), len(ctx)).astype(np.int64) for x in "tg")
        number = int(part["block"].iloc[0]) if len(part) else 0
        return pd.DataFrame({"block": number, "context": ctx, "char": ch, "t": t, "g": g})

    counted = stored(dealt.groupBy("block").cogroup(chosen.groupBy("block")).applyInPandas(
        count, "block int, context bigint, char int, t bigint, g bigint"))
    # one table per (context, character) and per context; a context has at most as many rows as there are characters
    sums = counted.groupBy("context", "char").agg(F.sum("t").alias("t"), F.sum("g").alias("g"))
    letters = sums.groupBy("char").agg(F.sum("t").alias("char_t"), F.sum("g").alias("char_g"))
    whole = letters.agg(F.sum("char_t").alias("all_t"), F.sum("char_g").alias("all_g"), F.count("*").alias("size")).withColumn("one", F.lit(1))
    # at most as many rows as Unicode has characters, about 25 MB
    prior = F.broadcast(letters.withColumn("one", F.lit(1)).join(whole, "one").select(
        "char", *[((F.col(f"char_{m}") + 1) / (F.col(f"all_{m}") + F.col("size"))).alias(f"p_{m}") for m in "tg"]))
    w = Window.partitionBy("context")
    modelled = sums.withColumns({f"ctx_{m}": F.sum(m).over(w) for m in "tg"}).join(prior, "char").select("context", "char", *[
        (-F.log((F.col(m) + weight * F.col(f"p_{m}")) / (F.col(f"ctx_{m}") + weight))).alias(f"loss_{m}") for m in "tg"])
    losses = counted.select("block", "context", "char").join(modelled, ["context", "char"])

    def add(_, part: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        texts = _texts(part)
        order = np.lexsort((known["char"].to_numpy(), known["context"].to_numpy()))
        context, char = known["context"].to_numpy()[order], known["char"].to_numpy()[order]
        first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if len(context) else np.zeros(0, np.int64)
        joint = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(context)))) * (1 << BITS) + char
        loss = {m: known[f"loss_{m}"].to_numpy()[order] for m in "tg"}
        n_chars, sums_ = np.zeros(len(texts), np.int64), {m: np.zeros(len(texts)) for m in "tg"}
        for a, b in by_chars(texts, 2_000_000):
            owner, ctx, ch = _grams(texts[a:b])
            if len(owner):
                at = np.searchsorted(joint, np.searchsorted(context[first], ctx) * (1 << BITS) + ch)
                n_chars[a:b] = np.bincount(owner, minlength=b - a)
                for m in "tg":
                    sums_[m][a:b] = np.bincount(owner, loss[m][at], b - a)
        size = np.where(n_chars, n_chars, np.nan)
        out = pd.DataFrame({"id": nullable_ids(part["id"], part["no_id"]), "n_chars": n_chars, "loss_target": sums_["t"] / size, "loss_background": sums_["g"] / size})
        out["score"] = out["loss_target"] - out["loss_background"]
        return out.astype({c: "Float64" for c in ("loss_target", "loss_background", "score")})

    scored = dealt.groupBy("block").cogroup(losses.groupBy("block")).applyInPandas(
        add, "id bigint, n_chars bigint, loss_target double, loss_background double, score double")
    return scored.select(F.col("id").alias(key), "n_chars", *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in ("loss_target", "loss_background", "score")])
