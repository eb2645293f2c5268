"""Publishing: shards, index, feeds, archive, meta, state."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantic.functions.ids import bucket
from vacantic.functions.times import posted_at
from vacantic.operators.scale import checkpoint_dir, durable, group_rank, side_by_side
from vacantic.operators.search import newest_n
from vacantic.rules import HASH_BUCKETS, MAX_FEED_ITEMS, MAX_SHARD_BYTES, MAX_SHARD_ROWS
from vacantic.sources.seeds import current_snapshot, publish_pointer

# rows of one order-contiguous piece of a bucket; a bucket of any size is cut into such pieces
SEGMENT_ROWS = 100_000


# --- greedy files -------------------------------------------------------------------------------------
def _next_start(sizes: np.ndarray, max_rows: int, max_bytes: int) -> np.ndarray:
    """For every row: where the next file starts if a file starts here (a JSON array: brackets and commas count)."""
    n = len(sizes)
    fill = np.concatenate([[0], np.cumsum(sizes + 1)])
    ends = np.searchsorted(fill, fill[:-1] + max_bytes - 1, side="right") - 1
    here = np.arange(n)
    return np.maximum(here + 1, np.minimum(np.minimum(ends, here + max_rows), n))


def chunk_by_budget(df: DataFrame, keys: list[str], order: list[Column], size: Column,
                    max_rows: int = MAX_SHARD_ROWS, max_bytes: int = MAX_SHARD_BYTES,
                    segment: int | None = None, parts: int | None = None) -> DataFrame:
    """Adds `chunk`: greedy files by row and byte cap, in order, exact for groups of any size.

    Greedy filling is sequential, but a file never spans more than `max_rows`
    rows.  So each piece of a group is solved on its own for every possible
    entry row (its first `max_rows` rows), which gives a small step function
    entry -> exit; chaining those functions over the pieces of a group touches a
    few rows per piece, and the pieces are then filled in parallel.
    """
    segment = max(segment or SEGMENT_ROWS, max_rows)
    ranked = group_rank(df.withColumn("_size", size), keys, order, "_pos", parts).withColumn("_pos", F.col("_pos") - 1)
    slim = ranked.select(*keys, F.col("_pos").cast("long").alias("_pos"), F.col("_size").cast("long").alias("_size")) \
        .withColumn("_seg", F.floor(F.col("_pos") / segment).cast("long"))
    key_types = ", ".join(f"{k} {slim.schema[k].dataType.simpleString()}" for k in keys)
    halo = slim.where((F.col("_seg") > 0) & (F.col("_pos") % segment < max_rows)).withColumn("_seg", F.col("_seg") - 1)
    pieces = slim.unionByName(halo)
    # small pieces share a task's call: a block has at most SEGMENT_ROWS rows and as many of the pieces after its own
    block = F.floor(F.col("_seg") / max(1, SEGMENT_ROWS // segment)).alias("_block")

    def each_piece(pdf: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, int, int, int, np.ndarray]]:
        """The pieces of a block: sorted rows, where the piece begins, its number, how many rows are its own, next starts."""
        pdf = pdf.sort_values(["_seg", "_pos"])
        segs, pos, sizes = (pdf[c].to_numpy() for c in ("_seg", "_pos", "_size"))
        numbers, begins = np.unique(segs, return_index=True)
        for seg, low, high in zip(numbers.tolist(), begins.tolist(), [*begins[1:].tolist(), len(pdf)]):
            own = int(np.searchsorted(pos[low:high], (seg + 1) * segment))
            yield pdf, low, seg, own, _next_start(sizes[low:high], max_rows, max_bytes)

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, _, seg, own, nxt in each_piece(pdf):
            nxt, out, files = nxt.tolist(), [0] * own, [0] * own
            for i in range(own - 1, -1, -1):
                j = nxt[i]
                out[i], files[i] = (j - own, 1) if j >= own else (out[j], files[j] + 1)
            found += [(seg, i, out[i], files[i]) for i in range(min(own, max_rows))
                      if i == 0 or out[i] != out[i - 1] or files[i] != files[i - 1]]
        steps = pd.DataFrame(found, columns=["_seg", "lo", "exit", "files"])
        for k in keys:
            steps[k] = pdf[k].iloc[0]
        return steps[[*keys, "_seg", "lo", "exit", "files"]]

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_seg", "lo"])
        entry, first, rows = 0, 0, []
        for seg, part in pdf.groupby("_seg", sort=True):
            rows.append((seg, entry, first))
            at = part[part["lo"] <= entry].iloc[-1]
            entry, first = int(at["exit"]), first + int(at["files"])
        out = pd.DataFrame(rows, columns=["_seg", "_entry", "_first"])
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "_seg", "_entry", "_first"]]

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        done = []
        for rows, low, _, own, nxt in each_piece(pdf):
            i, number = (int(rows[c].iloc[low]) for c in ("_entry", "_first"))
            chunk = np.full(own, number - 1, dtype=np.int64)
            while i < own:
                chunk[i:min(nxt[i], own)] = number
                i, number = nxt[i], number + 1
            done.append((low, chunk))
        at = np.concatenate([np.arange(low, low + len(c)) for low, c in done])
        return rows.iloc[at].assign(chunk=np.concatenate([c for _, c in done]))[[*keys, "_pos", "chunk"]]

    long_groups = (slim.agg(F.max("_seg")).first()[0] or 0) > 0
    if long_groups:
        steps = pieces.groupBy(*keys, block).applyInPandas(exits, f"{key_types}, _seg long, lo long, exit long, files long")
        entries = steps.groupBy(*keys).applyInPandas(chain, f"{key_types}, _seg long, _entry long, _first long")
        pieces = pieces.join(entries, [*keys, "_seg"])
    else:
        pieces = pieces.withColumn("_entry", F.lit(0)).withColumn("_first", F.lit(0))
    numbered = pieces.groupBy(*keys, block).applyInPandas(fill, f"{key_types}, _pos long, chunk long")
    return ranked.join(numbered, [*keys, "_pos"]).withColumn("chunk", F.col("chunk").cast("int")) \
        .withColumnRenamed("_size", "row_bytes").withColumnRenamed("_pos", "position")


def bucket_balance(df: DataFrame, key: str = "job_id", buckets: int = HASH_BUCKETS) -> DataFrame:
    """F8: rows per bucket."""
    return df.groupBy(bucket(F.col(key), buckets).alias("bucket")).agg(F.count("*").alias("rows"))


def row_bytes(df: DataFrame) -> Column:
    """Size of a row as compact JSON."""
    return F.octet_length(F.to_json(F.struct(*[F.col(c) for c in df.columns])))


def plan_shards(public: DataFrame, buckets: int = HASH_BUCKETS, max_rows: int = MAX_SHARD_ROWS,
                max_bytes: int = MAX_SHARD_BYTES, segment: int | None = None) -> DataFrame:
    """B1: bucket and chunk of every public row, newest first."""
    base = public.withColumn("bucket", bucket(F.col("job_id"), buckets))
    return chunk_by_budget(base, ["bucket"], [F.col("last_seen_at").desc(), F.col("job_id")], row_bytes(public),
                           max_rows, max_bytes, segment)


def shard_manifest(planned: DataFrame) -> DataFrame:
    """B1: one row per file: bucket, chunk, name, rows and bytes of the JSON array."""
    files = planned.groupBy("bucket", "chunk").agg(
        F.count("*").alias("job_count"), (F.sum("row_bytes") + F.count("*") + 1).alias("byte_size"))
    name = F.concat(F.lit("jobs-bucket-"), F.lpad(F.col("bucket").cast("string"), 2, "0"), F.lit("-"), F.col("chunk").cast("string"))
    return files.select("bucket", "chunk", name.alias("filename"), "job_count", "byte_size")


def write_shards(public: DataFrame, path: str, **options) -> DataFrame:
    """B1: one JSON-lines file per (bucket, chunk); returns the manifest.

    Rows are hashed by (bucket, chunk), so a big bucket is written by many tasks.
    """
    planned = durable(plan_shards(public, **options))
    cols = public.columns
    (planned.repartition("bucket", "chunk").sortWithinPartitions("bucket", "chunk", "position")
     .select(*cols, "bucket", "chunk").write.mode("overwrite").partitionBy("bucket", "chunk").json(path))
    manifest = shard_manifest(planned)
    manifest.write.mode("overwrite").parquet(path.rstrip("/") + "_manifest")
    return public.sparkSession.read.parquet(path.rstrip("/") + "_manifest")


def write_index(public: DataFrame, path: str | None = None, buckets: int = HASH_BUCKETS) -> DataFrame:
    """B2: id, company, title, bucket, sorted by id."""
    index = public.select("job_id", "company_id", "title",
                          F.lpad(bucket(F.col("job_id"), buckets).cast("string"), 2, "0").alias("bucket")).orderBy("job_id")
    if path:
        index.write.mode("overwrite").json(path)
    return index


def write_dims(companies: DataFrame, sources: DataFrame, path: str) -> DataFrame:
    """All companies and all sources as JSON lines; returns rows per table."""
    companies.write.mode("overwrite").json(f"{path}/companies")
    sources.write.mode("overwrite").json(f"{path}/sources")
    return count_tables({"companies": companies, "sources": sources})


def count_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table, one aggregation each."""
    out = None
    for name, t in tables.items():
        one = t.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def write_meta(public: DataFrame, tracked: DataFrame, companies: DataFrame, sources: DataFrame, events: DataFrame,
               generated_at: Column, path: str | None = None, version: int = 1) -> DataFrame:
    """Five counts and the versions on one row."""
    counts = count_tables({"job_count": public, "tracked_job_count": tracked, "company_count": companies,
                           "source_count": sources, "event_count": events})
    names = ["job_count", "tracked_job_count", "company_count", "source_count", "event_count"]
    meta = counts.agg(*[F.max(F.when(F.col("table") == n, F.col("rows"))).alias(n) for n in names]).select(
        *names, generated_at.alias("generated_at"), F.lit(version).alias("schema_version"))
    if path:
        meta.coalesce(1).write.mode("overwrite").json(path)
    return meta


# --- feeds ---------------------------------------------------------------------------------------------------
def feed_rows(public: DataFrame, n: int = MAX_FEED_ITEMS) -> DataFrame:
    """The newest rows with the columns feeds use."""
    return newest_n(public, n).select(
        "job_id", "job_url", "title", "summary", "company_name", "last_seen_at",
        posted_at(F.col("source_posted_at"), F.col("first_seen_at")).alias("posted"))


def _xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _mail_date(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))


def _tag(name: str, value: Column, attrs: str = "") -> Column:
    return F.concat(F.lit(f"<{name}{attrs}>"), _xml(F.coalesce(value, F.lit(""))), F.lit(f"</{name}>"))


def _link(url: Column) -> Column:
    return F.concat(F.lit('<link href="'), F.replace(_xml(url), F.lit('"'), F.lit("&quot;")), F.lit('"/>'))


def feed_documents(public: DataFrame, title: str, home: str, description: str, generated_at: Column,
                   n: int = MAX_FEED_ITEMS) -> DataFrame:
    """Rows (format, items, document) with a JSON Feed, an Atom and an RSS document.

    At most `n` rows reach the aggregation; that bound is the feature.
    """
    c = F.col
    home_json = json.dumps(home)
    item = F.to_json(F.struct(
        c("job_id").alias("id"), c("job_url").alias("url"), c("title"), c("summary").alias("content_text"),
        F.date_format("posted", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date_published"),
        F.array(F.struct(c("company_name").alias("name"))).alias("authors")))
    entry = F.concat(F.lit("<entry>"), _tag("title", c("title")), _link(c("job_url")), _tag("id", c("job_id")),
                     _tag("updated", _mail_date(c("last_seen_at"))), _tag("summary", c("summary")),
                     F.lit("<author>"), _tag("name", c("company_name")), F.lit("</author></entry>"))
    about = F.when(F.coalesce("summary", F.lit("")) != "", _tag("description", _xml(c("summary")))).otherwise(F.lit(""))
    node = F.concat(F.lit("<item>"), _tag("title", c("title")), _tag("link", c("job_url")),
                    _tag("guid", c("job_id"), ' isPermaLink="false"'), _tag("pubDate", _mail_date(c("posted"))), about, F.lit("</item>"))
    rows = feed_rows(public, n).select("posted", "job_id", item.alias("json"), entry.alias("atom"), node.alias("rss"))
    order = F.struct((-F.unix_micros("posted")).alias("o"), "job_id", "json", "atom", "rss")
    all_rows = rows.agg(F.array_sort(F.collect_list(order)).alias("r"), F.count("*").alias("items"))

    def joined(kind: str, sep: str) -> Column:
        return F.array_join(F.transform("r", lambda x: x[kind]), sep)

    when = _mail_date(generated_at)
    head = '<?xml version="1.0" encoding="utf-8"?>\n'
    json_doc = F.concat(F.lit(
        '{"version":"https://jsonfeed.org/version/1.1","title":' + json.dumps(title) + ',"home_page_url":' + home_json
        + ',"feed_url":' + json.dumps(home.rstrip("/") + "/feeds/jobs.json") + ',"description":' + json.dumps(description)
        + ',"items":['), joined("json", ","), F.lit("]}"))
    atom_doc = F.concat(F.lit(head + '<feed xmlns="http://www.w3.org/2005/Atom">'), _tag("title", F.lit(title)),
                        _link(F.lit(home)), _tag("id", F.lit(home)), _tag("updated", when), joined("atom", ""), F.lit("</feed>"))
    rss_doc = F.concat(F.lit(head + '<rss version="2.0"><channel>'), _tag("title", F.lit(title)), _tag("link", F.lit(home)),
                       _tag("description", F.lit(description)), _tag("lastBuildDate", when), joined("rss", ""), F.lit("</channel></rss>"))
    docs = F.array(*[F.struct(F.lit(k).alias("format"), F.col("items"), d.alias("document"))
                     for k, d in (("json", json_doc), ("atom", atom_doc), ("rss", rss_doc))])
    return all_rows.select(F.inline(docs))


def write_feeds(public: DataFrame, path: str, title: str, home: str, description: str, generated_at: Column,
                n: int = MAX_FEED_ITEMS) -> DataFrame:
    """The three documents as text files; returns (format, items)."""
    docs = feed_documents(public, title, home, description, generated_at, n)
    docs.select("format", F.col("document").alias("value")).write.mode("overwrite").partitionBy("format") \
        .option("lineSep", "\n").text(path)
    return docs.select("format", "items")


# --- archive and state --------------------------------------------------------------------------------------------
def archive_month(table: DataFrame, path: str, when: Column) -> DataFrame:
    """Rows into their month's partition, replacing only the months at hand; returns the list of archives."""
    spark = table.sparkSession
    table.withColumn("month", F.date_format(when, "yyyy-MM")).write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
    return list_archives(spark, path)


def list_archives(spark: SparkSession, path: str) -> DataFrame:
    """Months of an archive and their rows (read from file footers)."""
    return spark.read.parquet(path).groupBy(F.col("month").cast("string").alias("month")).agg(F.count("*").alias("rows"))


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder next to the session's checkpoints (shared by all executors)."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def save_state(spark: SparkSession, path: str, tables: dict[str, DataFrame], batch_id: int | None = None) -> dict:
    """Write a new snapshot, then publish a pointer to it; a reader sees the old or the new one, never a mix.

    With a batch id the call is repeatable: a batch that is already current is skipped.
    """
    now = current_snapshot(spark, path)
    if now is not None and batch_id is not None and now.get("batch_id") is not None and now["batch_id"] >= batch_id:
        return now
    stamp = f"batch-{batch_id}" if batch_id is not None else uuid.uuid4().hex[:12]
    folders = {}
    for name, table in tables.items():
        folders[name] = f"snapshots/{stamp}-{uuid.uuid4().hex[:6]}/{name}"
        table.write.mode("overwrite").parquet(f"{path}/{folders[name]}")
    pointer = {"tables": folders, "batch_id": batch_id}
    publish_pointer(spark, path, pointer)
    return pointer


def state_counts(public: DataFrame, tracked: DataFrame, companies: DataFrame, sources: DataFrame) -> DataFrame:
    """The six numbers of the status report on one row."""
    a = public.agg(F.count("*").alias("open_jobs"))
    b = tracked.agg(F.count("*").alias("total_jobs"))
    c = companies.agg(F.count("*").alias("companies"))
    d = sources.agg(F.count_if("enabled").alias("sources"),
                    F.count_if(F.col("enabled") & (F.col("health_status") == "healthy")).alias("healthy_sources"),
                    F.countDistinct(F.when(F.col("enabled"), F.col("adapter"))).alias("adapters"))
    return side_by_side(a, b, c, d)
