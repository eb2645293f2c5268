"""Helpers that keep hot groups out of single tasks."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def checkpoint_dir(spark) -> str:
    """The folder the session names; only where none is set and Spark runs locally, a private one that goes with the process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="vacantic-checkpoint-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so lost executors do not change the rows."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for heavy per-row work when the input has fewer splits than the cluster has cores.

    Large tables have more splits than cores and pass through unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def side_by_side(*frames: DataFrame) -> DataFrame:
    """One-row summaries as one row (equality join on a constant; every input is a global aggregate)."""
    out = frames[0].withColumn("_one", F.lit(1))
    for f in frames[1:]:
        out = out.join(f.withColumn("_one", F.lit(1)), "_one")
    return out.drop("_one")


def group_rank(df: DataFrame, keys: list[str], order: list[Column], name: str, parts: int | None = None) -> DataFrame:
    """Exact row_number per key (or over all rows, without keys), also when one key holds most of the rows.

    The table is range-partitioned by (keys, order), which spreads a hot key over many partitions; the sorted ranges are
    written out once, each row with its place in its range, and places are shifted by the summed sizes of the key's earlier
    ranges.  Rows move once for the sort; without keys the shifts are one small row per range.  `order` must end in a unique
    column.  Give it slim rows and join the number back to wide ones.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*[F.col(k) for k in keys], *order]
    # the upper bits of the number are the range, the lower 33 the place in it
    cut = durable(df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_place", F.monotonically_increasing_id()))
    cut = cut.withColumn("_range", F.shiftright("_place", 33))
    before = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # at most one row per key and range
    offsets = cut.groupBy(*keys, "_range").agg(F.count("*").alias("_n"), F.min("_place").alias("_first")) \
        .withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1)
    if not keys:
        offsets = F.broadcast(offsets)  # as many rows as ranges; nothing else bounds the shuffle the planner would choose
    left, right = cut.alias("l"), offsets.alias("r")
    on = F.col("l._range") == F.col("r._range")
    for k in keys:
        on = on & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    joined = left.join(right, on).select("l.*", F.col("r._shift").alias("_shift"))
    return joined.withColumn(name, (F.col("_place") + F.col("_shift")).cast("int")).drop("_range", "_place", "_shift")
