"""Removal of repeated word windows, with super-k-mer partitioning.

A window is `width` consecutive words.  Its minimiser is the m-mer (m consecutive words) with the smallest hash in it,
the leftmost of equal ones; consecutive windows with the same minimiser form a super-k-mer.  Equal windows have equal
minimisers, so a window can only be repeated where its minimiser is.

1. Super-k-mers of all texts are listed as numbers (minimiser, row, place) and minimisers counted.  A window reaches at least
   half of its other words beyond its minimiser on one side; so of a minimiser that is not frequent only those places
   are kept whose words up to there, on the left or on the right, occur again (as hashes).
2. These are cut out of their texts and travel, as one string of words each, to the
   bucket of the minimiser; there all windows are sorted, and equal neighbours are repeated windows.  The words
   themselves are compared, so the result does not rest on hashes.
3. A minimiser with more than `bucket_rows` places never meets in one task.  Equal strings of it become one with a
   count; if more than `bucket_rows` are left, they are cut into super-k-mers again, by the smallest m-mer of another
   hash, and sorted in the buckets of both minimisers, and so on for LEVELS hashes.  Windows of what is then still
   frequent are counted by a combining aggregate.  The runs found go back to the places by a join.
4. Every word under a marked window goes.

Defined results: null text has no words; texts below `width` words are never changed; two rows with the same key and
text are two texts (each repeats the other); null keys are allowed; an empty table yields no rows; columns named like
an added one (`n_words`, `n_removed`, `kept`) are replaced, others are kept.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vacantic.functions.text import small_batches
from vacantic.llm.common import FULL, mix64, scope, sifted, stored, word_hashes

LEVELS = 3  # hashes that split a frequent minimiser, one after the other


def _beside(mers: np.ndarray, at: np.ndarray, reach: int, m: int, side: int) -> np.ndarray:
    """32-bit hashes, never 0, of the m-mers `at` some places with the `reach` words before (side -1) or after them (1); 0 where there are fewer."""
    inside = (at >= reach) if side < 0 else (at + reach < len(mers))
    x = mers[at]
    with np.errstate(over="ignore"):
        for step in [*range(m, reach, m), reach] if reach else []:  # m-mers that cover these words
            x = mix64(x) + mers[np.where(inside, at + side * step, at)]
    return np.where(inside, (mix64(x) >> np.uint64(32)) | np.uint64(1), np.uint64(0)).astype(np.uint32).view(np.int32)


def super_kmers(words: list, width: int, m: int, level: int = 0, sides: bool = False) -> tuple[np.ndarray, ...]:
    """Minimiser hash, first window and number of windows of each super-k-mer, in the order of the text; every level has a hash of its own.

    With `sides` also hashes of the minimiser with the words that a window holds at least on its left, or on its right.
    """
    windows = len(words) - width + 1
    if windows < 1:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.int32),) * (2 * sides)
    h, count = word_hashes(words), len(words) - m + 1
    mers = np.zeros(count, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(m):
            mers = mers * np.uint64(0x9E3779B97F4A7C15) + h[j:j + count]
        mers = mix64(mers + np.uint64(level) * np.uint64(0xD1B54A32D192ED03))
    # upper half of the hash, then the place: the smallest such number is the leftmost smallest m-mer
    low = (mers & np.uint64(0xFFFFFFFF00000000)) | np.arange(count, dtype=np.uint64)
    span, step = width - m + 1, 1
    while 2 * step <= span:  # smallest of 2, 4, 8 ... neighbours
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    low = np.minimum(low[:windows], low[span - step:span - step + windows])
    at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    reach = (width - m + 1) // 2
    beside = tuple(_beside(mers, at[first], reach, m, side) for side in (-1, 1)) if sides else ()
    return mers[at[first]].view(np.int64), first, np.diff(np.append(first, windows)), *beside


def _words(text) -> list:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _spans(marks: list) -> list[tuple[int, int]]:
    """Runs (first, last) of sorted window numbers."""
    out: list[list[int]] = []
    for w in marks:
        if out and w <= out[-1][1] + 1:
            out[-1][1] = max(w, out[-1][1])
        else:
            out.append([w, w])
    return [tuple(x) for x in out]


def _windows(packed: str, width: int) -> list[str]:
    """All windows of a packed string, as its substrings."""
    ends, at = [], 0
    for w in packed.split(" "):
        at += len(w) + 1
        ends.append(at)
    starts = [0, *ends[:-1]]
    return [packed[starts[i]:ends[i + width - 1] - 1] for i in range(len(ends) - width + 1)]


PIECE = "bucket bigint, key bigint, mark bigint, first int, packed string, n bigint"
RUN = "key bigint, mark bigint, first int, last int"


def _sorted_in_buckets(pieces: DataFrame, width: int) -> DataFrame:
    """Runs of windows that occur again in their bucket, of at most `bucket_rows` strings; `n` is the number of a string's copies."""
    def run(frames):
        def stream():
            for pdf in frames:
                yield from zip(pdf["bucket"], pdf["key"], pdf["mark"], pdf["first"], pdf["packed"], pdf["n"])
        out = []
        for _, bucket in groupby(stream(), key=lambda r: r[0]):
            bucket = list(bucket)
            if len(bucket) > 1 or bucket[0][5] > 1:
                marks: dict[int, list] = {}
                found = sorted((w, i, j) for i, r in enumerate(bucket) for j, w in enumerate(_windows(r[4], width)))
                for _, same in groupby(found, key=lambda x: x[0]):
                    same = list(same)
                    if len(same) > 1 or bucket[same[0][1]][5] > 1:
                        for _, i, j in same:
                            marks.setdefault(i, []).append(int(bucket[i][3]) + j)
                out += [(bucket[i][1], bucket[i][2], a, b) for i, w in marks.items() for a, b in _spans(sorted(w))]
            if len(out) > 50_000:
                yield _frame(out, ["key", "mark", "first", "last"])
                out = []
        if out:
            yield _frame(out, ["key", "mark", "first", "last"])
    return pieces.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(run, RUN)


def _split(pieces: DataFrame, width: int, m: int, level: int) -> DataFrame:
    """Strings cut into the super-k-mers of another hash; a bucket is named by all its minimisers so far."""
    def run(frames):
        for pdf in frames:
            out = []
            for bucket, key, mark, first, packed, n in zip(pdf["bucket"], pdf["key"], pdf["mark"], pdf["first"], pdf["packed"], pdf["n"]):
                words = packed.split(" ")
                mini, at, count = super_kmers(_words(packed), width, m, level)
                inner = mix64(mini.view(np.uint64) ^ np.uint64(int(bucket) & FULL)).view(np.int64)
                out += [(x, key, mark, first + a, " ".join(words[a:a + c + width - 1]), n) for x, a, c in zip(inner.tolist(), at.tolist(), count.tolist())]
                if len(out) > 20_000:
                    yield _frame(out, ["bucket", "key", "mark", "first", "packed", "n"])
                    out = []
            if out:
                yield _frame(out, ["bucket", "key", "mark", "first", "packed", "n"])
    return pieces.mapInPandas(run, PIECE)


def _counted(pieces: DataFrame, width: int) -> DataFrame:
    """Windows that occur again, as runs of one, by a combining aggregate over the windows themselves."""
    def run(frames):
        for pdf in frames:
            out = [(k, mark, f + j, w, n) for k, mark, f, p, n in zip(pdf["key"], pdf["mark"], pdf["first"], pdf["packed"], pdf["n"])
                   for j, w in enumerate(_windows(p, width))]
            for s in range(0, len(out), 20_000):
                yield pd.DataFrame(out[s:s + 20_000], columns=["key", "mark", "first", "window", "n"])
    windows = pieces.mapInPandas(run, "key bigint, mark bigint, first int, window string, n bigint")
    twice = stored(windows.groupBy("window").agg(F.sum("n").alias("times")).where("times > 1").select("window"))
    return windows.join(twice, "window").select("key", "mark", "first", F.col("first").alias("last"))


def _frequent(places: DataFrame, width: int, m: int, bucket_rows: int) -> DataFrame:
    """(key, mark, first, last): runs of repeated windows of stored places (mini, key, mark, first, packed) whose minimisers are frequent."""
    parts = stored(places.groupBy("mini", "packed").agg(F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()))
    pieces = parts.select(F.col("mini").alias("bucket"), F.col("id").alias("key"), F.lit(0).cast("bigint").alias("mark"), F.lit(0).alias("first"), "packed", "n")
    found = []
    for level in range(LEVELS + 1):
        large = stored(pieces.groupBy("bucket").agg(F.count("*").alias("strings")).where(F.col("strings") > bucket_rows).select("bucket"))
        found.append(_sorted_in_buckets(pieces.join(large, "bucket", "left_anti"), width))
        rest = pieces.join(large, "bucket", "left_semi")
        if large.isEmpty():
            break
        if level == LEVELS:
            found.append(_counted(rest, width))
        else:
            pieces = stored(_split(rest, width, m, level + 1))
    runs = found[0]
    for f in found[1:]:
        runs = runs.unionByName(f)
    runs = runs.groupBy("key").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    # stored: the join with the places can split a string that a large part of them holds
    runs = stored(parts.select("mini", "packed", "id").join(runs, F.col("id") == runs["key"]).select("mini", "packed", "runs"))
    return places.join(runs, ["mini", "packed"]).select("key", "mark", "first", F.explode("runs").alias("run")) \
        .select("key", "mark", (F.col("first") + F.col("run.first")).alias("first"), (F.col("first") + F.col("run.last")).alias("last"))


def repeated_spans(rows: DataFrame, width: int, m: int, bucket_rows: int) -> DataFrame:
    """(key, mark, spans): runs of repeated windows per row; `rows` has key, mark (hash of the text) and text, none of the first two null."""
    def cut(frames):
        for pdf in frames:
            found = [super_kmers(_words(t), width, m, sides=True) for t in pdf["text"]]
            sizes = [len(x[0]) for x in found]
            if sum(sizes):
                yield pd.DataFrame({
                    "mini": np.concatenate([x[0] for x in found]), "key": pdf["key"].repeat(sizes).array,
                    "mark": pdf["mark"].repeat(sizes).array, "first": np.concatenate([x[1] for x in found]).astype(np.int32),
                    "n": np.concatenate([x[2] for x in found]).astype(np.int32),
                    "before": np.concatenate([x[3] for x in found]), "after": np.concatenate([x[4] for x in found])})

    with scope(rows.sparkSession) as keep:
        with scope(rows.sparkSession) as hand:  # the lists go before texts move
            listed = stored(rows.mapInPandas(cut, "mini bigint, key bigint, mark bigint, first int, n int, before int, after int"))
            again = stored(listed.groupBy("mini").agg(F.count("*").alias("places")).where("places > 1"))  # stored: the joins below can split a hot minimiser
            near = sifted(listed, again, "mini")  # the others need not travel
            twice = [(F.col(side) != 0) & (F.count("*").over(Window.partitionBy("mini", side)) > 1) for side in ("before", "after")]
            place = ["key", "mark", F.struct("first", "n", "mini", (F.col("places") > bucket_rows).alias("hot")).alias("place")]
            few = near.join(again.where(F.col("places") <= bucket_rows), "mini").withColumn("twice", twice[0] | twice[1]).where("twice").select(*place)
            many = near.join(again.where(F.col("places") > bucket_rows), "mini").select(*place)
            asked = hand(few.unionByName(many).groupBy(F.col("key").alias("k2"), F.col("mark").alias("m2")).agg(F.collect_set("place").alias("asked"))
                        .withColumn("row", F.xxhash64("k2", "m2")))

        def pack(frames):
            for pdf in frames:
                out = []
                for k, mark, text, asked in zip(pdf["key"], pdf["mark"], pdf["text"], pdf["asked"]):
                    words = [w.decode("utf-8", "surrogatepass") for w in _words(text)]
                    out += [(r["mini"], r["hot"], k, mark, r["first"], " ".join(words[r["first"]:r["first"] + r["n"] + width - 1])) for r in asked]
                    if len(out) > 20_000:
                        yield _frame(out, ["mini", "hot", "key", "mark", "first", "packed"])
                        out = []
                if out:
                    yield _frame(out, ["mini", "hot", "key", "mark", "first", "packed"])

        # stored: the texts with such places move once for frequent and other minimisers
        texts = sifted(rows.withColumn("row", F.xxhash64("key", "mark")), asked, "row")
        places = stored(texts.join(asked.drop("row"), (texts["key"] == F.col("k2")) & (texts["mark"] == F.col("m2")))
                        .select("key", "mark", "text", "asked").mapInPandas(pack, "mini bigint, hot boolean, key bigint, mark bigint, first int, packed string"))
        cold = _sorted_in_buckets(places.where("not hot").select(F.col("mini").alias("bucket"), "key", "mark", "first", "packed", F.lit(1).cast("bigint").alias("n")), width)
        hot = _frequent(places.where("hot"), width, m, bucket_rows)
        return keep(cold.unionByName(hot).groupBy("key", "mark").agg(F.collect_set(F.struct("first", "last")).alias("spans")))


def _frame(rows: list, columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns)


def drop_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 35, m: int = 6,
                 bucket_rows: int = 1000) -> DataFrame:
    """Add `n_words`, `n_removed` and `kept` (the remaining words joined by one blank) to every row."""
    if not 0 < m <= width:
        raise ValueError("0 < m <= width is needed")
    small_batches()
    named = [c for c in docs.columns if c.lower() not in ("n_words", "n_removed", "kept")]
    rest = [c for c in named if c not in (key, text)]
    ident, words = F.col(f"`{key}`").cast("bigint"), F.col(f"`{text}`")
    # rows are told apart by (key, 64-bit hash of the text), rows without a key by 128 bits of their text; neither is ever null
    every = docs.select(F.coalesce(ident, F.xxhash64(F.lit("no key"), words)).alias("key"), F.xxhash64(words).alias("mark"), ident.alias("ident"),
                        words.alias("text"), *([F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest")] if rest else []))
    spans = repeated_spans(every.select("key", "mark", "text"), width, m, bucket_rows)

    @F.pandas_udf("n_words bigint, n_removed bigint, kept string")
    def clean(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        total, removed, kept = [], [], []
        for t, spans_ in zip(texts, found):
            words = _words(t)
            n = len(words)
            if spans_ is not None:
                gone = np.zeros(n + 1, dtype=np.int64)
                for s in spans_:
                    gone[s["first"]] += 1
                    gone[s["last"] + width] -= 1
                words = [w for w, g in zip(words, np.cumsum(gone[:n])) if not g]
            total.append(n)
            removed.append(n - len(words))
            kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
        return pd.DataFrame({"n_words": total, "n_removed": removed, "kept": kept})

    every = every.withColumn("row", F.xxhash64("key", "mark"))
    found = spans.select(F.col("key").alias("k2"), F.col("mark").alias("m2"), "spans")
    repeating = sifted(every, spans.select(F.xxhash64("key", "mark").alias("row")), "row")  # other texts need not travel
    joined = repeating.join(found, (repeating["key"] == F.col("k2")) & (repeating["mark"] == F.col("m2")), "left").drop("k2", "m2").unionByName(
        sifted(every, spans.select(F.xxhash64("key", "mark").alias("row")), "row", rest=True).withColumn("spans", F.lit(None).cast(found.schema["spans"].dataType)))
    done = joined.withColumn("clean", clean(F.col("text"), F.col("spans")))
    back = {key: F.col("ident"), text: F.col("text")} | {c: F.col(f"rest.`{c}`") for c in rest}
    return done.select(*[back[c].alias(c) for c in named], "clean.n_words", "clean.n_removed", "clean.kept")
