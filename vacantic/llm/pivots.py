"""Near-duplicate vectors by cosine, with a pivot-permutation index.

Pivots are a bounded sample of the vectors.  Every vector is described by its nearest pivots in their order and stands
in the inverted lists of all pairs of them, so that two vectors meet if they share at least two of their nearest
pivots.  Vectors that meet are verified by their cosine in double precision.  A pair that shares more than two pivots
meets in several lists; it is counted only in the list of its two smallest shared pivots, so that links are
counted in the tasks and no pairs are ever written out.  Lists longer than `block` are split into pairs of blocks.

The sample: the `pivots` vectors with the smallest hashes of their id, by default twice the square root of the number of
distinct vectors, 64 at least and 4096 at most.  Every vector is indexed.  Equal vectors are one entry with a count.

Defined results: vectors that are null, empty, zero, hold null or non-finite components, or have another length than
the most frequent one of the sample link with nothing (n_links 0, their own component, kept); rows that repeat an id
are separate vectors with one id; a null id is allowed; an empty table yields no rows; other columns are not
carried.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantic.llm.common import free_name, stored
from vacantic.llm.components import components, forest, in_blocks
from vacantic.operators.scale import durable

MOST_PIVOTS = 4096
MOST_LENGTHS = 100


def _valid(v: str):
    """True for vectors that can be compared."""
    def bad(x):
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(v) > 0) & ~F.exists(v, lambda x: bad(x)) & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision (scaled first, so that squares cannot overflow or vanish)."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def nearest(rows: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """Numbers of the nearest pivots of unit vectors, nearest first."""
    cos = rows @ pivots.T
    length = min(length, len(pivots))
    some = np.argpartition(-cos, length - 1, axis=1)[:, :length]
    order = np.argsort(-np.take_along_axis(cos, some, axis=1), axis=1, kind="stable")
    return np.take_along_axis(some, order, axis=1)


def linked(vectors: np.ndarray, lists: np.ndarray, high: int, least: float, own: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (x, y) of one list with cosine >= least whose two smallest shared pivots are the list's (the larger: high)."""
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    xs, ys = [], []
    small = np.where(lists <= high, lists, -1)
    for s in range(0, len(left), 256):
        x = left[s:s + 256]
        near = vectors[x] @ vectors[right].T >= least
        a, b = np.nonzero(near)
        a, b = x[a], right[b]
        keep = a < b if i == j else np.ones(len(a), bool)
        a, b = a[keep], b[keep]
        for t in range(0, len(a), 50_000):
            p, q = small[a[t:t + 50_000]], small[b[t:t + 50_000]]
            first = ((p[:, :, None] == q[:, None, :]) & (p[:, :, None] >= 0)).sum(axis=(1, 2)) == 2
            xs.append(a[t:t + 50_000][first])
            ys.append(b[t:t + 50_000][first])
    return (np.concatenate(xs), np.concatenate(ys)) if xs else (np.zeros(0, int), np.zeros(0, int))


def near_duplicates(table: DataFrame, least: float = 0.9, key: str = "vec_id", vector: str = "embedding", length: int = 8,
                    pivots: int | None = None, block: int = 1024) -> DataFrame:
    """(key, n_links, component_id, kept) of every row; vectors of different lengths are never linked, each length has an index of its own."""
    size = free_name(table, "_size")
    sized = table.select(F.col(f"`{key}`").cast("bigint").alias(key), F.col(f"`{vector}`").cast("array<double>").alias(vector))
    sized = sized.withColumn(size, F.when(_valid(vector), F.size(vector)))
    sizes = sorted(r[0] for r in sized.where(F.col(size).isNotNull()).select(size).distinct().limit(MOST_LENGTHS + 1).collect())
    if len(sizes) > MOST_LENGTHS:
        raise ValueError(f"vectors of more than {MOST_LENGTHS} lengths: not a table of embeddings")
    if len(sizes) < 2:
        return _of_one_length(table, least, key, vector, length, pivots, block)
    out = sized.where(F.col(size).isNull()).select(key, F.lit(0).cast("bigint").alias("n_links"), F.col(key).alias("component_id"), F.lit(True).alias("kept"))
    for n in sizes:
        out = out.unionByName(_of_one_length(sized.where(F.col(size) == n), least, key, vector, length, pivots, block))
    return out


def _of_one_length(table: DataFrame, least: float, key: str, vector: str, length: int, pivots: int | None, block: int) -> DataFrame:
    """The join of the vectors of one length; all others in the table link with nothing."""
    rows = table.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).withColumn("ok", _valid("v"))
    # equal vectors are one entry; its number is a hash of the vector
    entry = F.when(F.col("ok"), F.xxhash64("v"))
    members = rows.select("id", entry.alias("entry"))
    entries = stored(rows.where("ok").groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("copies")).withColumn("entry", F.xxhash64("v")))
    total = entries.count()
    wanted = pivots or max(64, min(MOST_PIVOTS, math.ceil(2 * math.sqrt(total))))
    sample = [r["v"] for r in entries.orderBy(F.xxhash64("entry"), "entry").limit(min(wanted, MOST_PIVOTS)).select("v").collect()]
    if not sample:
        return members.select(F.col("id").alias(key), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    dim = Counter(map(len, sample)).most_common(1)[0][0]
    centres = unit(np.array([v for v in sample if len(v) == dim]))
    length = min(length, len(centres))

    def describe(frames):
        for pdf in frames:
            if len(pdf):
                u = unit(np.stack(pdf["v"].to_numpy()).astype(np.float64))
                yield pd.DataFrame({"entry": pdf["entry"], "copies": pdf["copies"], "unit": [x.tobytes() for x in u],
                                    "near": list(nearest(u, centres, length).astype(np.int32))})

    described = stored(entries.where(F.size("v") == dim).select("v", "entry", "copies")
                       .mapInPandas(describe, "entry bigint, copies bigint, unit binary, near array<int>"))
    if length < 2:
        lists = described.select("entry", F.get("near", F.lit(0)).cast("bigint").alias("list"))
    else:
        sides = F.sort_array("near")
        pairs = F.flatten(F.transform(sides, lambda x, i: F.transform(F.slice(sides, i + 2, length), lambda y: x.cast("bigint") * MOST_PIVOTS + y)))
        lists = described.select("entry", F.explode(pairs).alias("list"))
    spread = in_blocks(lists, "list", "entry", block).join(described, "entry").select("list", "_i", "_j", "_own", "entry", "copies", "unit", "near")

    def verify(frames):
        def stream():
            for pdf in frames:
                yield from zip(pdf["list"], pdf["_i"], pdf["_j"], pdf["_own"], pdf["entry"], pdf["copies"], pdf["unit"], pdf["near"])
        ones, others, counts, size = [], [], [], 0
        for (number, i, j), group in groupby(stream(), key=lambda r: r[:3]):
            cols = list(zip(*group))
            vectors = np.frombuffer(b"".join(cols[6]), dtype=np.float64).reshape(-1, dim)
            near = np.array(cols[7])
            x, y = linked(vectors, near, int(number) % MOST_PIVOTS if length > 1 else MOST_PIVOTS, least, np.array(cols[3]), i, j)
            if not len(x):
                continue
            entry_, copies = np.array(cols[4]), np.array(cols[5])
            found = np.bincount(x, copies[y], len(entry_)) + np.bincount(y, copies[x], len(entry_))
            some = np.flatnonzero(found)
            node, root = forest(entry_[x], entry_[y])
            ones += [entry_[some], node]
            others += [np.full(len(some), -1), root]
            counts += [found[some].astype(np.int64), np.zeros(len(node), np.int64)]
            size += len(some) + len(node)
            if size > 100_000:
                yield pd.DataFrame({"entry": np.concatenate(ones), "other": np.concatenate(others), "links": np.concatenate(counts)})
                ones, others, counts, size = [], [], [], 0
        if size:
            yield pd.DataFrame({"entry": np.concatenate(ones), "other": np.concatenate(others), "links": np.concatenate(counts)})

    found = stored(spread.repartition("list", "_i", "_j").sortWithinPartitions("list", "_i", "_j")
                   .mapInPandas(verify, "entry bigint, other bigint, links bigint"))
    links = found.groupBy("entry").agg(F.sum("links").alias("links"))
    label = durable(components(found.where("links = 0").select(F.col("entry").alias("a"), F.col("other").alias("b"))))
    usable = entries.where(F.size("v") == dim).select("entry", "copies")
    known = usable.join(links, "entry", "left").join(label.withColumnRenamed("node", "entry"), "entry", "left") \
        .select("entry", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "entry").alias("label"))
    full = members.join(known, "entry", "left")
    lowest = full.where("label is not null").groupBy("label").agg(F.min("id").alias("low"))
    out = full.join(lowest, "label", "left").withColumn("component_id", F.coalesce("low", "id"))
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), "component_id",
                      F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
