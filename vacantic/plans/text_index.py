"""An inverted index of character trigrams beside the postings, so that a keyword search reads what can match.

`rows/` holds the postings partitioned by hash bucket, `grams/` lists (gram, bucket, part, rows): for each trigram of the
searched text the hashed ids of the rows that hold it.  Rows are listed where they are read, in slices of at most
`LIST_ROWS` rows of one bucket, so nothing is shuffled and a frequent trigram is many lists; a file of the index covers
some slices, sorted by gram in small row groups.  The text ends in two marks, so that its last two characters begin a
trigram too and a token of two characters is a range of trigrams.

A search reads the row groups of its tokens' trigrams, keeps the ids that every trigram lists, reads only the buckets they
are in, and runs the plain search on those rows: the substring test stays the judge, hashes only choose candidates.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantic.functions.ids import bucket
from vacantic.operators.filters import query_tokens
from vacantic.operators.scale import spread
from vacantic.operators.search import FilterSpec, haystack, search
from vacantic.rules import HASH_BUCKETS

END = "\x00\x00"
GRAMS = "gram string, bucket int, part int, rows array<int>"
LIST_ROWS = 10_000
GROUP_BYTES = 1 << 20  # a row group of the index


def _row_id(job_id: Column) -> Column:
    # rows with equal hashes are candidates together, nothing else
    return F.hash(job_id)


def trigrams(text: Column) -> Column:
    """Distinct trigrams of a text with its end marks; none for null."""
    marked = F.concat(text, F.lit(END))
    return F.when(text.isNotNull(), F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.greatest(F.char_length(marked) - 2, F.lit(1))), lambda i: F.substr(marked, i, F.lit(3)))))


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{path}/schema").schema).parquet(f"{path}/rows")


def write_text_index(postings: DataFrame, path: str, buckets: int = HASH_BUCKETS, group_bytes: int = GROUP_BYTES) -> None:
    """Write postings and their index; rows without a job id fall into the bucket of the empty one."""
    spark = postings.sparkSession
    placed = postings.withColumn("bucket", bucket(F.coalesce("job_id", F.lit("")), buckets))
    placed.hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows")
    spark.createDataFrame([], placed.schema).write.mode("overwrite").parquet(f"{path}/schema")  # an empty table has no file of rows
    rows = spread(_rows(spark, path)).select("bucket", _row_id(F.col("job_id")).alias("row"), trigrams(haystack()).alias("grams"))
    rows.mapInArrow(_lists, GRAMS).sortWithinPartitions("gram", "bucket", "part") \
        .write.mode("overwrite").option("parquet.block.size", group_bytes).parquet(f"{path}/grams")


def _lists(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lists of every slice of rows of one bucket, as they come; `part` numbers the slices of a task."""
    part = 0
    for batch in batches:
        buckets = batch.column("bucket").to_numpy(zero_copy_only=False)
        for b in np.unique(buckets):
            mine = np.flatnonzero(buckets == b)
            for low in range(0, len(mine), LIST_ROWS):
                own = batch.take(pa.array(mine[low:low + LIST_ROWS]))
                yield _slice_lists(own.column("row").to_numpy(), own.column("grams"), int(b), part)
                part += 1


def _slice_lists(rows: np.ndarray, grams: pa.ListArray, bucket_number: int, part: int) -> pa.RecordBatch:
    """One list of sorted, distinct row ids per trigram."""
    names = grams.flatten().dictionary_encode()
    code = names.indices.to_numpy().astype(np.int64)
    held = np.repeat(rows, grams.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
    pairs = np.unique((code << 32) | (held & 0xFFFFFFFF))  # one number per trigram and row
    code, held = pairs >> 32, (pairs & 0xFFFFFFFF).astype(np.uint32).view(np.int32)
    ends = np.searchsorted(code, np.arange(len(names.dictionary) + 1)).astype(np.int32)
    n = len(names.dictionary)
    return pa.RecordBatch.from_arrays(
        [names.dictionary, pa.array(np.full(n, bucket_number, np.int32)), pa.array(np.full(n, part, np.int32)),
         pa.ListArray.from_arrays(pa.array(ends), pa.array(held))], names=["gram", "bucket", "part", "rows"])


def _keys(tokens: list[str]) -> list[str]:
    """What a row has to hold: the trigrams of the longer tokens, and the tokens of two characters."""
    return sorted({t[i:i + 3] for t in tokens for i in range(len(t) - 2)} | {t for t in tokens if len(t) == 2})


def candidates(spark: SparkSession, path: str, query: str) -> DataFrame | None:
    """(bucket, row) of the rows that hold every trigram of the query; None where the query has no token."""
    keys = _keys(query_tokens(query))
    if not keys:
        return None
    wanted = F.lit(False)
    for k in keys:
        wanted = wanted | (F.col("gram") == k if len(k) == 3 else F.col("gram").startswith(k))
    served = F.filter(F.array(*[F.when(F.col("gram").startswith(k), F.lit(i)) for i, k in enumerate(keys)]), lambda i: i.isNotNull())
    lists = spark.read.schema(GRAMS).parquet(f"{path}/grams").where(wanted)
    # a row may be listed often for a key (a short token, an id that repeats): the keys a row holds are bits
    held = lists.select("bucket", served.alias("keys"), F.explode("rows").alias("row"))
    words = [keys[i:i + 60] for i in range(0, len(keys), 60)]

    def bits(low: int) -> Column:
        of = F.transform(F.filter("keys", lambda k: (k >= low) & (k < low + 60)), lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k - low))
        return F.bit_or(F.aggregate(of, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x)))

    found = held.groupBy("bucket", "row").agg(*[bits(60 * i).alias(f"b{i}") for i in range(len(words))])
    for i, w in enumerate(words):
        found = found.where(F.col(f"b{i}") == (1 << len(w)) - 1)
    return found.select("bucket", "row")


def matching_rows(spark: SparkSession, path: str, query: str) -> DataFrame:
    """Rows that can match a query; only the buckets of candidates are read."""
    rows, found = _rows(spark, path), candidates(spark, path, query)
    if found is None:
        return rows
    buckets = [r["bucket"] for r in found.select("bucket").distinct().collect()]  # at most the number of buckets
    return rows.where(F.col("bucket").isin(buckets)).withColumn("row", _row_id(F.col("job_id"))) \
        .join(found, ["bucket", "row"], "left_semi").drop("row")


def search_indexed(spark: SparkSession, path: str, spec: FilterSpec, **options) -> DataFrame:
    """The search over an index written by `write_text_index`; same rows as `search` over the postings."""
    return search(matching_rows(spark, path, spec.q).drop("bucket"), spec, **options)
