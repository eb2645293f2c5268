"""Source and adapter health over a `polls` fact.

polls(source_id, adapter, poll_ts, poll_id, outcome, message); outcome is ok,
not_modified, error or unsupported.  Streaks at the end of history need no
window: they are counts after the last success.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantic.operators.scale import side_by_side
from vacantic.rules import (ADAPTER_CRITICAL_RATE, ADAPTER_FAILURE_THRESHOLD, ADAPTER_MIN_SAMPLES,
                            DEFAULT_TIER_MINUTES, MAX_SOURCES_PER_RUN, POLL_TIER_MINUTES)

# fixed values
DEGRADED_AFTER = 3
FAILING_AFTER = 10
ERROR_SAMPLES = 5
ERROR_CHARS = 500


def failure_streak(polls: DataFrame) -> DataFrame:
    """Failed polls since the last success, per source."""
    at = F.struct("poll_ts", "poll_id")
    good = polls.groupBy("source_id").agg(F.max(F.when(F.col("outcome").isin("ok", "not_modified"), at)).alias("_ok"))
    after = polls.join(good, "source_id") \
        .withColumn("_after", F.col("_ok").isNull() | (at > F.col("_ok")))
    return after.groupBy("source_id").agg(
        F.count_if(F.col("_after") & (F.col("outcome") == "error")).alias("consecutive_failures"),
        F.count_if(F.col("_after") & (F.col("outcome") == "unsupported")).alias("unsupported_since"),
        F.max_by("outcome", at).alias("last_outcome"),
        F.max(F.when(F.col("outcome").isin("ok", "not_modified"), F.col("poll_ts"))).alias("last_success_at"),
        F.max(F.when(F.col("outcome") == "error", F.col("poll_ts"))).alias("last_failure_at"))


def source_health(polls: DataFrame) -> DataFrame:
    """K6: status of every source: healthy, degraded from 3 failures, disabled from 10, unsupported."""
    f = F.col("consecutive_failures")
    status = (F.when(F.col("last_outcome") == "unsupported", "unsupported")
              .when(f >= FAILING_AFTER, "failing").when(f >= DEGRADED_AFTER, "degraded")
              .when(F.col("unsupported_since") > 0, "unsupported").otherwise("healthy"))
    out = failure_streak(polls).withColumn("health_status", status)
    dead = (F.col("health_status") == "failing") & (f >= FAILING_AFTER)
    return out.select("source_id", "consecutive_failures", "last_success_at", "last_failure_at",
                      F.when(dead, "disabled").otherwise(F.col("health_status")).alias("health_status"),
                      (~dead).alias("enabled"))


def adapter_health(polls: DataFrame) -> DataFrame:
    """successes, failures, rate, last failure and the last five errors per adapter.

    The five errors come from a rank limit, which Spark applies before the
    shuffle too, so a busy adapter never gathers its whole error log.
    """
    counts = polls.groupBy("adapter").agg(
        F.count_if(F.col("outcome") == "ok").alias("success_count"),
        F.count_if(F.col("outcome") == "error").alias("failure_count"),
        F.max(F.when(F.col("outcome") == "error", F.col("poll_ts"))).alias("last_failure_at"))
    newest = Window.partitionBy("adapter").orderBy(F.col("poll_ts").desc(), F.col("poll_id").desc())
    errors = polls.where((F.col("outcome") == "error") & (F.coalesce("message", F.lit("")) != "")) \
        .select("adapter", "poll_ts", "poll_id", F.substring("message", 1, ERROR_CHARS).alias("message")) \
        .withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= ERROR_SAMPLES)
    samples = errors.groupBy("adapter").agg(F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("o"), "message"))).alias("_e")) \
        .select("adapter", F.transform("_e", lambda e: e["message"]).alias("sample_errors"))
    total = F.col("success_count") + F.col("failure_count")
    return counts.join(samples, "adapter", "left").select(
        "adapter", "success_count", "failure_count",
        F.when(total > 0, F.col("success_count") / total).otherwise(0.0).alias("success_rate"), "last_failure_at",
        F.coalesce("sample_errors", F.array().cast("array<string>")).alias("sample_errors"))


def health_regressions(polls: DataFrame, threshold: float = ADAPTER_FAILURE_THRESHOLD,
                       min_samples: int = ADAPTER_MIN_SAMPLES) -> DataFrame:
    """adapters with enough samples and too many failures; critical from 0.8."""
    counts = polls.groupBy("adapter").agg(
        F.count_if(F.col("outcome") == "ok").alias("success_count"),
        F.count_if(F.col("outcome") == "error").alias("failure_count"))
    total = F.col("success_count") + F.col("failure_count")
    rate = F.col("failure_count") / total
    return counts.where((total >= min_samples) & (rate >= threshold)).select(
        "adapter", "success_count", "failure_count", F.round(rate, 3).alias("failure_rate"),
        F.when(rate >= ADAPTER_CRITICAL_RATE, "critical").otherwise("warning").alias("severity"))


def apply_adapter_health(sources: DataFrame, regressions: DataFrame) -> DataFrame:
    """Sources of regressed adapters become degraded."""
    bad = regressions.select("adapter").distinct().withColumn("_bad", F.lit(True))
    return sources.join(bad, "adapter", "left").withColumn(
        "health_status", F.when(F.col("_bad"), "degraded").otherwise(F.col("health_status"))).drop("_bad")


def run_summary(polls: DataFrame) -> DataFrame:
    """poll outcomes of a run on one row."""
    return polls.agg(
        F.count("*").alias("sources_due"), F.count_if(F.col("outcome") == "ok").alias("fetched"),
        F.count_if(F.col("outcome") == "not_modified").alias("not_modified"),
        F.count_if(F.col("outcome").isin("error", "unsupported")).alias("failures"))


def run_report(polls: DataFrame, changes: DataFrame, moves: DataFrame, promoted: DataFrame) -> DataFrame:
    """the whole run on one row: polls, inserted and updated rows, closed, reopened, promoted boards."""
    parts = [
        run_summary(polls),
        changes.agg(F.count_if(F.col("change") == "inserted").alias("new_jobs"),
                    F.count_if(F.col("change") == "updated").alias("updated_jobs")),
        moves.agg(F.count_if(F.col("event") == "CLOSED").alias("closed"),
                  F.count_if(F.col("event") == "REOPENED").alias("reopened")),
        promoted.agg(F.count("*").alias("promoted_boards")),
    ]
    return side_by_side(*parts)


# --- polling ------------------------------------------------------------------------------------------------
def next_due(polled_at: Column, tier: Column) -> Column:
    """K7: poll time plus the minutes of the tier."""
    minutes = F.lit(DEFAULT_TIER_MINUTES)
    for name, m in POLL_TIER_MINUTES.items():
        minutes = F.when(tier == name, F.lit(m)).otherwise(minutes)
    return F.timestamp_micros(F.unix_micros(polled_at) + minutes.cast("long") * 60_000_000)


def due_sources(sources: DataFrame, adapters: list[str] | None = None) -> DataFrame:
    """Enabled sources that are not blocked, disabled or unsupported."""
    out = sources.where(F.col("enabled") & ~F.col("health_status").isin("blocked", "disabled", "unsupported"))
    return out.where(F.col("adapter").isin(adapters)) if adapters is not None else out


def cap_due(sources: DataFrame, limit: int = MAX_SOURCES_PER_RUN, adapters: list[str] | None = None) -> DataFrame:
    """H4: listing feeds first, then never polled, then the oldest due; one top-k."""
    feed_first = F.when(F.col("adapter") == "simplify", 0).otherwise(1)
    return due_sources(sources, adapters).orderBy(
        feed_first, F.col("next_due_at").asc_nulls_first(), F.col("source_id")).limit(limit)
