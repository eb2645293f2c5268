"""Small helpers of the corpus operators."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame

from vacantic.operators.scale import checkpoint_dir

FULL = (1 << 64) - 1


def process_cache(owner: str) -> dict:
    """A dictionary that lives as long as the Python worker; only things that can be made again go into it.

    It goes when the worker, which Spark keeps from stage to stage, serves another owner.
    """
    kept = sys.__dict__.setdefault("_vacantic_llm_cache", {})
    if owner not in kept:
        kept.clear()
        kept[owner] = {}
    return kept[owner]


def free_name(df: DataFrame, base: str) -> str:
    """A column name that the table does not use (names are compared without case)."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name += "_"
    return name


def mix64(x):
    """Splitmix finaliser on a numpy array of uint64: a bijection that spreads every bit."""
    import numpy as np
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash, remembered for the words met so far; emptied when it has grown large."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        import xxhash
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def word_hashes(words: list):
    """The words' hashes as a numpy array of uint64."""
    import numpy as np
    cache = process_cache("words").setdefault("words", WordHashes())
    return np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))


def exact_id(name: str) -> list:
    """Columns `id` (0 for null) and `no_id` of a nullable 64-bit column: pandas would turn a column with nulls into doubles."""
    from pyspark.sql import functions as F
    c = F.col(f"`{name}`").cast("bigint")
    return [F.coalesce(c, F.lit(0)).alias("id"), c.isNull().alias("no_id")]


def nullable_ids(ids, no_id):
    """The ids as a nullable integer array."""
    import numpy as np
    import pandas as pd
    return pd.arrays.IntegerArray(np.asarray(ids, dtype=np.int64), np.asarray(no_id, dtype=bool))


def by_chars(texts: list, budget: int) -> list[tuple[int, int]]:
    """Slices of consecutive texts of about `budget` code points; a longer text is a slice of its own."""
    out, start, size = [], 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 1
        if i > start and size + n > budget:
            out.append((start, i))
            start, size = i, 0
        size += n
    if start < len(texts):
        out.append((start, len(texts)))
    return out


_folders: ContextVar[list | None] = ContextVar("folders of the innermost open scope", default=None)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _write(df: DataFrame, folders: list | None) -> DataFrame:
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    if folders is not None:
        folders.append(path)
    # nothing reads the shuffle files of this write again: Spark deletes them at its end, not when the driver collects its garbage
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame) -> DataFrame:
    """Write a table once into the shared checkpoint folder and read it back: columnar and compressed, with no lineage.

    Inside a `scope` it goes when the scope ends.
    """
    return _write(df, _folders.get())


@contextmanager
def scope(spark) -> Iterator:
    """Tables that are `stored` inside the block are deleted at its end, also after an error.

    Yields `keep`, which stores a table for longer: until the scope around this one ends, or for good.  What leaves the
    block must have gone through it.
    """
    outer, mine = _folders.get(), []
    token = _folders.set(mine)
    try:
        yield lambda df: _write(df, outer)
    finally:
        _folders.reset(token)
        for folder in mine:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sifted(rows: DataFrame, wanted: DataFrame, key: str, bits: int = 1 << 24, rest: bool = False) -> DataFrame:
    """The rows whose key may be one of `wanted`: all that are, and few others, so that a join moves little.

    The hashed keys of `wanted` are broadcast as a bitmap, at most `bits` bits in pieces of 4 KB; with more keys than
    that it holds nothing back, and stays right.  With `rest` it returns exactly the rows that it would leave out.
    """
    from pyspark.sql import functions as F
    place = F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(bits))
    piece, at, bitmap = (free_name(rows, f"_{x}") for x in ("piece", "at", "bitmap"))
    maps = wanted.select(F.bitmap_bucket_number(place).alias(piece), F.bitmap_bit_position(place).alias(at)) \
        .groupBy(piece).agg(F.bitmap_construct_agg(at).alias(bitmap))
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(F.col(at) / 8) + 1, F.lit(1))), 16, 10).cast("int")
    held = F.getbit(byte, F.col(at) % 8) == 1
    return rows.withColumn(piece, F.bitmap_bucket_number(place)).join(F.broadcast(maps), piece, "left" if rest else "inner") \
        .withColumn(at, F.bitmap_bit_position(place)) \
        .where(~F.coalesce(held, F.lit(False)) if rest else held).select(*[F.col(f"`{c}`") for c in rows.columns])


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
