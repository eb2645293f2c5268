"""Connected components of a link table, and splitting of large groups into pairs of blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vacantic.llm.common import stored


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of the links a[i] - b[i]: (node, smallest node of its component) for all other nodes."""
    nodes, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = place[:len(a)], place[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        if (root == before).all():
            break
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def _contract(links: DataFrame) -> DataFrame:
    """Links of each partition replaced by its spanning stars."""
    def run(frames):
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for pdf in frames:
            a, b = forest(np.concatenate((a, pdf["a"].to_numpy(np.int64))), np.concatenate((b, pdf["b"].to_numpy(np.int64))))
        yield pd.DataFrame({"a": a, "b": b})
    return links.mapInPandas(run, "a bigint, b bigint")


def _lowest(links: DataFrame) -> DataFrame:
    """Every link seen from each end, with the smallest neighbour of that end."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("u"), F.least("a", "low").alias("low"))
    return both.join(low, both["a"] == low["u"]).drop("u")


TASK_LINKS = 500_000  # links whose spanning stars one task finds at once, some 8 MB


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every linked node that is not the smallest of its component; `links` has bigints a, b.

    Each task first replaces up to TASK_LINKS links by the stars that span them; if one task held all links, these are
    the components.  Otherwise alternating star steps follow: every node hands its larger neighbours, then its smaller
    ones, to its smallest neighbour.  The number of rounds grows with the logarithm of the component size; no node
    gathers its neighbours.
    """
    distinct = stored(links.where("a <> b").select(F.least("a", "b").cast("bigint").alias("a"), F.greatest("a", "b").cast("bigint").alias("b")).distinct())
    tasks = 1 + distinct.count() // TASK_LINKS
    e = stored(_contract(distinct.coalesce(tasks)))
    if tasks == 1:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    before = None
    while True:
        state = tuple(e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first())
        if state == before or not state[0]:
            break
        before = state
        large = _lowest(e).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("u"), "low")
        joined = down.join(low, down["a"] == low["u"])
        small = joined.select("a", F.col("low").alias("b")).union(joined.select(F.col("b").alias("a"), F.col("low").alias("b"))) \
            .where("a <> b").distinct()
        e = stored(_contract(small).distinct())
    return e.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")


def in_blocks(rows: DataFrame, key: str, node: str, block: int) -> DataFrame:
    """Rows of the keys that occur more than once, spread over pairs of blocks of about `block` rows.

    Adds `_i` <= `_j` and `_own`, the row's own block.  Within (key, _i, _j) every pair of rows of blocks _i and _j
    meets; keys of one block have _i = _j = 0.  A pair is to be looked at where one row's own block is _i and the
    other's is _j.
    """
    sized = rows.withColumn("_count", F.count("*").over(Window.partitionBy(key))).where("_count > 1")
    k = F.ceil(F.col("_count") / block).cast("int")
    own = sized.withColumn("_k", k).withColumn("_own", F.pmod(F.xxhash64(F.col(node)), F.col("_k")).cast("int"))
    spread = own.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    return spread.withColumn("_i", F.least("_own", "_with")).withColumn("_j", F.greatest("_own", "_with")).drop("_with", "_k", "_count")
