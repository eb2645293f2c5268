"""Incremental tracking of landed snapshots.

Landing rows: one per listed posting of a poll, `(source_id, poll_ts, outcome,
posting_id, content_hash)`, with `health_status` where the source's health gates
closing; a poll without postings, or one that failed, is a row with a null
posting_id.

State holds the polls that count, the sightings as they came, and per posting its
first and last sighting.  Nothing in it depends on the number of a poll: numbers are
an order statistic of the polls (polls per day and source, summed up, plus the place
within the day) taken when the state is read.  So polls and parts of polls may come
in any order and however late; a late poll shifts the numbers after it without a
rewrite, and a batch touches only the sources and postings it lists.
"""

from __future__ import annotations

from collections.abc import Iterable, MutableMapping

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vacantic.operators.lifecycle import lifecycle_state, telling
from vacantic.operators.scale import spread
from vacantic.plans.state import BUCKETS, Layout, commit, read_appended, read_table
from vacantic.rules import MISSES_CLOSED, MISSES_SUSPECTED
from vacantic.sources.seeds import current_snapshot

LANDING = "source_id string, poll_ts timestamp, outcome string, posting_id string, content_hash string"
POLLS = "source_id string, poll_ts timestamp"
SIGHTINGS = "source_id string, posting_id string, poll_ts timestamp, content_hash string"
POSTINGS = "source_id string, posting_id string, first_seen_at timestamp, last_seen_at timestamp, content_hash string"
BY_SOURCE, BY_POSTING = Layout("source_id"), Layout("source_id", within="posting_id", spread=8)


def empty_state(spark: SparkSession) -> dict[str, DataFrame]:
    return {"polls": spark.createDataFrame([], POLLS), "sightings": spark.createDataFrame([], SIGHTINGS), "postings": spark.createDataFrame([], POSTINGS)}


def new_rows(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Polls of a batch that count, and its sightings (one per posting and poll)."""
    good = telling(batch).where(F.col("source_id").isNotNull() & F.col("poll_ts").isNotNull())
    seen = good.where(F.col("posting_id").isNotNull()).groupBy("source_id", "posting_id", "poll_ts").agg(F.max("content_hash").alias("content_hash"))
    return good.select("source_id", "poll_ts").distinct(), seen


def merge_polls(known: DataFrame, polls: DataFrame) -> DataFrame:
    return known.unionByName(polls).distinct()


def merge_postings(known: DataFrame, seen: DataFrame) -> DataFrame:
    """First and last sighting per posting; the content is that of the last one."""
    last = F.max(F.struct("poll_ts", "content_hash"))
    new = seen.groupBy("source_id", "posting_id").agg(F.min("poll_ts").alias("first_seen_at"), last.alias("_l")).select(
        "source_id", "posting_id", "first_seen_at", F.col("_l.poll_ts").alias("last_seen_at"), F.col("_l.content_hash").alias("content_hash"))
    return known.unionByName(new).groupBy("source_id", "posting_id").agg(
        F.min("first_seen_at").alias("first_seen_at"), F.max(F.struct("last_seen_at", "content_hash")).alias("_l")).select(
        "source_id", "posting_id", "first_seen_at", "_l.last_seen_at", "_l.content_hash")


def apply_batch(state: dict[str, DataFrame], batch: DataFrame) -> dict[str, DataFrame]:
    """K1: state after one micro-batch of landed snapshots, in any order of polls."""
    polls, seen = new_rows(batch)
    return {"polls": merge_polls(state["polls"], polls), "sightings": state["sightings"].unionByName(seen),
            "postings": merge_postings(state["postings"], seen)}


def number_by_slices(polls: DataFrame) -> DataFrame:
    """`poll_no` of distinct (source_id, poll_ts), and `polls`, the number of the source's last one.

    A number is the polls of earlier days plus the place within the day.  The windows hold a source's days and a day's
    polls, never a source's history.
    """
    day = polls.withColumn("_day", F.to_date("poll_ts"))
    counts = day.groupBy("source_id", "_day").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("source_id").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    slices = counts.select("source_id", "_day", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
                           F.sum("_n").over(Window.partitionBy("source_id")).alias("polls"))
    place = F.row_number().over(Window.partitionBy("source_id", "_day").orderBy("poll_ts"))
    return day.withColumn("_place", place).join(slices, ["source_id", "_day"]).select(
        "source_id", "poll_ts", (F.col("_before") + F.col("_place")).cast("long").alias("poll_no"), F.col("polls").cast("long").alias("polls"))


def current_lifecycle(state: dict[str, DataFrame], suspected: int = MISSES_SUSPECTED, closed: int = MISSES_CLOSED) -> DataFrame:
    """State, miss count and times per posting: misses from its last sighting's number, returns from the gaps of its sightings."""
    numbers = number_by_slices(state["polls"])
    by_posting = Window.partitionBy("source_id", "posting_id").orderBy("poll_no")
    steps = state["sightings"].groupBy("source_id", "posting_id", "poll_ts").agg(F.max("content_hash").alias("content_hash")) \
        .join(numbers.select("source_id", "poll_ts", "poll_no"), ["source_id", "poll_ts"]) \
        .withColumn("_prev", F.lag("poll_no").over(by_posting)).withColumn("_hash", F.lag("content_hash").over(by_posting))
    back = F.col("poll_no") - F.col("_prev") - 1 >= suspected
    moved = F.col("_prev").isNotNull() & ~F.col("_hash").eqNullSafe(F.col("content_hash"))
    history = steps.groupBy("source_id", "posting_id").agg(
        F.max(F.when(back, F.col("poll_ts"))).alias("reopened_at"), F.count_if(F.coalesce(back, F.lit(False))).alias("times_reopened"),
        F.max(F.when(moved, F.col("poll_ts"))).alias("last_changed_at"))
    last = state["postings"].join(numbers.withColumnRenamed("poll_ts", "last_seen_at"), ["source_id", "last_seen_at"])
    misses = (F.col("polls") - F.col("poll_no")).cast("long")
    return last.join(history, ["source_id", "posting_id"]).select(
        "source_id", "posting_id", "first_seen_at", "last_seen_at", misses.alias("miss_count"),
        lifecycle_state(misses, suspected, closed).alias("state"), "reopened_at", "times_reopened", "last_changed_at", "content_hash")


def read_tracked(spark: SparkSession, path: str) -> dict[str, DataFrame] | None:
    """The tables of the current version of a tracked state, or None when there is none yet."""
    if current_snapshot(spark, path) is None:
        return None
    return {"polls": read_table(spark, path, "polls"), "postings": read_table(spark, path, "postings"),
            "sightings": read_appended(spark, path, "sightings").drop("run")}


def track_stream(spark: SparkSession, landing: str, state_path: str, checkpoint: str, fmt: str = "parquet",
                 files_per_batch: int | None = None, buckets: int = BUCKETS):
    """K1: follow a landing folder; every batch becomes a new version of the state, exactly once.

    Only the buckets of the sources and postings a batch lists are read and written; its sightings are appended.
    """
    reader = spark.readStream.schema(LANDING).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    stream = reader.load(landing)

    def step(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        now = current_snapshot(session, state_path) or {}
        if now.get("marks", {}).get("batch_id", -1) >= batch_id:
            return  # replay of a batch whose version is already current
        batch = spread(batch).persist()
        polls, seen = new_rows(batch)
        n, empty = now.get("buckets", buckets), empty_state(session)
        by_source = BY_SOURCE.touched(polls.select("source_id"), n)
        first = F.pmod(F.xxhash64("source_id"), F.lit(n)) + F.pmod(F.xxhash64("posting_id"), F.lit(BY_POSTING.spread))
        by_posting = sorted(r[0] for r in seen.select(F.pmod(first, F.lit(n)).cast("int")).distinct().collect())
        known = {name: read_table(session, state_path, name, touched) for name, touched in (("polls", by_source), ("postings", by_posting))}
        known = {name: empty[name] if table is None else table for name, table in known.items()}
        commit(session, state_path, {"polls": (merge_polls(known["polls"], polls), BY_SOURCE, by_source),
                                     "postings": (merge_postings(known["postings"], seen), BY_POSTING, by_posting)},
               {"sightings": seen}, {"batch_id": batch_id}, n)
        batch.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals_stream(landing: DataFrame, key: str = "posting_id", watermark: str | None = None) -> DataFrame:
    """K9: first landing of every posting, in batch or streaming; a watermark bounds the kept keys."""
    rows = landing.where(F.col(key).isNotNull())
    if watermark:
        return rows.withWatermark("poll_ts", watermark).dropDuplicatesWithinWatermark([key])
    return rows.dropDuplicates([key])


# --- per-key state machines --------------------------------------------------------------------------------
LIFECYCLE_OUT = "source_id string, posting_id string, state string, miss_count long, at_micros long"


def lifecycle_step(number: int, before: set, listed: set, down: MutableMapping, due: MutableMapping,
                   suspected: int = MISSES_SUSPECTED, closed: int = MISSES_CLOSED) -> Iterable[tuple[str, str, int]]:
    """State changes (posting, state, misses) of poll `number`, which lists `listed` after the last one listed `before`.

    `down`: number of the last sighting of each posting that is not listed now.  `due`: postings whose decisive miss falls
    on a poll number, if they are not seen until then.  Only postings that come, go or are due are looked up.
    """
    for name in listed - before:
        last = down.get(name)
        if last is None:
            yield name, "open", 0
        else:
            del down[name]
            if number - last - 1 >= suspected:
                yield name, "reopened", 0
    gone = sorted(before - listed)
    for name in gone:
        down[name] = number - 1
    if gone:
        for misses in (suspected, closed):
            at = number - 1 + misses
            if at > number:
                due[at] = [*(due.get(at) or []), *gone]
    waiting = due.get(number)
    for name in sorted({*(waiting or []), *(gone if 1 in (suspected, closed) else [])}):
        last = down.get(name)
        state = {closed: "closed", suspected: "suspected_closed"}.get(number - last) if last is not None else None
        if state:
            yield name, state, number - last
    if waiting is not None:
        del due[number]


class _MapView(MutableMapping):
    """A state map with one key and one value column as a mapping; it is never walked.

    Every access to the state is a call into the JVM, so a key is read once, and written once if it changed (`flush`).
    """

    def __init__(self, state):
        self.state, self.stored, self.now = state, {}, {}

    def get(self, key, default=None):
        if key not in self.now:
            value = self.state.getValue((key,))
            self.stored[key] = self.now[key] = value[0] if value is not None else None
        value = self.now[key]
        return default if value is None else value

    __getitem__ = get

    def __setitem__(self, key, value):
        self.now[key] = value

    def __delitem__(self, key):
        self.now[key] = None

    def flush(self) -> None:
        for key, value in self.now.items():
            if key in self.stored and self.stored[key] == value:
                continue
            if value is not None:
                self.state.updateValue((key,), (value,))
            elif key in self.stored:
                self.state.removeKey((key,))

    def __iter__(self):
        raise TypeError("not walked")

    __len__ = None


def lifecycle_processor(suspected: int = MISSES_SUSPECTED, closed: int = MISSES_CLOSED):
    """K2 for low latency: emits every state change as its poll arrives, by poll numbers per (source, part).

    A poll that is not newer than the part's last one is not counted.  Postings with a decisive miss ahead are those that
    went within the last few polls, so they are kept with the last listing.
    """
    from pyspark.sql.streaming import StatefulProcessor

    names = T.ArrayType(T.StringType())
    waiting = T.ArrayType(T.StructType([T.StructField("number", T.LongType()), T.StructField("postings", names)]))

    class Lifecycle(StatefulProcessor):
        def init(self, handle) -> None:
            self.last = handle.getValueState("last", T.StructType([T.StructField("number", T.LongType()), T.StructField("at", T.LongType()),
                                                                   T.StructField("listed", names), T.StructField("due", waiting)]))
            self.down = handle.getMapState("down", "posting_id string", "number long")

        def handleInputRows(self, key, rows, timerValues):
            polls: dict[int, set] = {}
            for row in rows:
                listed = polls.setdefault(row["poll_micros"], set())
                if row["posting_id"] is not None:
                    listed.add(row["posting_id"])
            number, newest, before, ahead = self.last.get() or (0, None, [], [])
            before, due, down = set(before), {n: list(p) for n, p in ahead}, _MapView(self.down)
            for at in sorted(polls):
                if newest is not None and at <= newest:
                    continue
                number, newest = number + 1, at
                for name, state, misses in lifecycle_step(number, before, polls[at], down, due, suspected, closed):
                    yield Row(source_id=key[0], posting_id=name, state=state, miss_count=misses, at_micros=at)
                before = polls[at]
            down.flush()
            if newest is not None:
                self.last.update((number, newest, sorted(before), sorted(due.items())))

        def close(self) -> None:
            pass

    return Lifecycle()


def lifecycle_changes(landing: DataFrame, parts: int = 16, watermark: str | None = None) -> DataFrame:
    """K2, K3 as a stateful stream; the rows of one poll have to land in one batch.

    A source's postings are spread over `parts` keys by hash, and each poll is
    announced once to every part, so a source with a third of all postings does
    not sit in one task.  A watermark bounds the remembered polls.
    """
    good = telling(landing)
    own = good.where(F.col("posting_id").isNotNull()).withColumn("part", F.pmod(F.hash("posting_id"), F.lit(parts)))
    once = good.select("source_id", "poll_ts")
    if watermark:
        once = once.withWatermark("poll_ts", watermark).dropDuplicatesWithinWatermark(["source_id", "poll_ts"])
    else:
        once = once.dropDuplicates(["source_id", "poll_ts"])
    ticks = once.withColumn("posting_id", F.lit(None).cast("string")) \
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    cols = ["source_id", F.unix_micros("poll_ts").alias("poll_micros"), "posting_id", F.col("part").cast("int").alias("part")]
    keyed = own.select(*cols).unionByName(ticks.select(*cols))
    out = keyed.groupBy("source_id", "part").transformWithState(
        lifecycle_processor(), LIFECYCLE_OUT, outputMode="Update", timeMode="None")
    return out.select("source_id", "posting_id", "state", "miss_count", F.timestamp_micros("at_micros").alias("at"))
