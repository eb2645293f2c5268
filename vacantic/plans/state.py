"""State tables in hash buckets: a run reads and writes only the buckets it touches.

A table is a set of bucket folders written by Spark's partitioned writer; the pointer file of a version (see
`sources.seeds`) names the folder that holds each bucket.  A commit writes the touched buckets anew, names them beside
the untouched ones and publishes the next pointer, so a reader sees one version or the next, never a mix.  Folders that
neither the current nor the previous pointer names are removed after a commit.  Appended tables (events, run reports)
have one folder per run; a reader takes the runs up to the pointer's.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantic.sources.seeds import _files, current_snapshot, current_version, publish_pointer

BUCKETS = 256


@dataclass(frozen=True)
class Layout:
    """Bucket of a row: by `key`; with `within`, a key's rows are spread over `spread` neighbouring buckets by that column."""

    key: str
    within: str | None = None
    spread: int = 1

    def bucket(self, buckets: int) -> Column:
        place = F.pmod(F.xxhash64(F.col(self.key)), F.lit(buckets))
        if self.within:
            place = place + F.pmod(F.xxhash64(F.col(self.within)), F.lit(self.spread))
        return F.pmod(place, F.lit(buckets)).cast("int")

    def touched(self, keys: DataFrame, buckets: int) -> list[int]:
        """Buckets that can hold rows of the keys; at most `buckets` numbers come to the driver."""
        first = F.pmod(F.xxhash64(F.col(self.key)), F.lit(buckets))
        every = F.explode(F.sequence(first, first + (self.spread if self.within else 1) - 1))
        return sorted(r[0] for r in keys.select(every.alias("b")).select(F.pmod("b", F.lit(buckets)).cast("int")).distinct().collect())


def read_table(spark: SparkSession, path: str, name: str, buckets: Iterable[int] | None = None) -> DataFrame | None:
    """Rows of a table, or of some of its buckets, in the current version; None where the table does not exist yet."""
    now = current_snapshot(spark, path)
    known = (now or {}).get("bucketed", {}).get(name)
    if known is None:
        return None
    schema = T.StructType.fromJson(known["schema"])
    wanted = known["folders"] if buckets is None else {str(b): known["folders"][str(b)] for b in buckets if str(b) in known["folders"]}
    if not wanted:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{folder}" for _, folder in sorted(wanted.items())])


def read_appended(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """Rows of an appended table of all runs up to the current version, with their run number `run`."""
    now = current_snapshot(spark, path)
    if now is None or name not in now.get("appended", {}):
        return None
    schema = T.StructType.fromJson(now["appended"][name]).add("run", T.IntegerType())
    return spark.read.schema(schema).parquet(f"{path}/{name}").where(F.col("run") <= current_version(spark, path))


def _written_buckets(spark: SparkSession, folder: str) -> dict[str, str]:
    p, fs = _files(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return {n.removeprefix("bucket="): n for n in names if n.startswith("bucket=")}


def commit(spark: SparkSession, path: str, changes: dict[str, tuple[DataFrame, Layout, list[int] | None]],
           appended: dict[str, DataFrame] | None = None, marks: dict | None = None, buckets: int = BUCKETS) -> dict:
    """Write the touched buckets (None: all) of each table and the appended tables, then publish the next version.

    `changes[name]`: all rows of the touched buckets.  `marks` is kept in the pointer (what the version stands for).
    """
    version = current_version(spark, path)
    before = current_snapshot(spark, path) or {}
    buckets = before.get("buckets", buckets)
    stamp = f"v{version + 1:09d}-{uuid.uuid4().hex[:8]}"
    tables = {k: dict(v) for k, v in before.get("bucketed", {}).items()}
    for name, (rows, layout, touched) in changes.items():
        folder = f"{name}/{stamp}"
        rows.withColumn("bucket", layout.bucket(buckets)).hint("rebalance", F.col("bucket")) \
            .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{folder}")
        old = tables.get(name, {}).get("folders", {})
        kept = {} if touched is None else {b: f for b, f in old.items() if int(b) not in set(touched)}
        found = {b: f"{folder}/{n}" for b, n in _written_buckets(spark, f"{path}/{folder}").items()}
        if set(kept) & set(found):
            raise ValueError(f"{name}: rows outside the touched buckets {sorted(set(kept) & set(found))[:5]}")
        tables[name] = {"schema": rows.schema.jsonValue(), "folders": kept | found}
    schemas = dict(before.get("appended", {}))
    for name, rows in (appended or {}).items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}/run={version + 1}")
        schemas[name] = rows.schema.jsonValue()
    pointer = {"buckets": buckets, "bucketed": tables, "appended": schemas, "marks": marks or {}}
    publish_pointer(spark, path, pointer)
    remove_unnamed(spark, path, version + 1, [pointer, before])
    return pointer


def remove_unnamed(spark: SparkSession, path: str, version: int, pointers: list[dict]) -> list[str]:
    """Remove the bucket folders up to `version` that none of the pointers names; a later writer's folders stay."""
    gone = []
    named = {f for p in pointers for t in p.get("bucketed", {}).values() for f in t["folders"].values()}
    for name in {n for p in pointers for n in p.get("bucketed", {})}:
        top, fs = _files(spark, f"{path}/{name}")
        for stamp in [s.getPath() for s in fs.listStatus(top)] if fs.exists(top) else []:
            if not stamp.getName().startswith("v") or int(stamp.getName()[1:10]) > version:
                continue
            there = [s.getPath() for s in fs.listStatus(stamp) if s.getPath().getName().startswith("bucket=")]
            dead = [p for p in there if f"{name}/{stamp.getName()}/{p.getName()}" not in named]
            for p in [stamp] if len(dead) == len(there) else dead:
                fs.delete(p, True)
                gone.append(f"{name}/{stamp.getName()}" if p is stamp else f"{name}/{stamp.getName()}/{p.getName()}")
    return gone
