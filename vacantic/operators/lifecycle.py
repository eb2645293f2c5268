"""Tracking: upserts, miss streaks, open / suspected / closed / reopened.

A posting is *absent* in every successful poll of its source that does not list
it.  Instead of building postings x polls, polls get a running number per source
and each sighting stores that number: the miss count is then a difference of two
numbers, and a transition is a gap between two sightings.  Work is linear in the
sightings, never in absences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantic.operators.scale import durable, group_rank
from vacantic.rules import CLOSE_STATUS_CODES, MISSES_CLOSED, MISSES_SUSPECTED

SRC, POST, POLL = "source_id", "posting_id", "poll_ts"


def lifecycle_state(misses: Column, suspected: int = MISSES_SUSPECTED, closed: int = MISSES_CLOSED) -> Column:
    """K2: state from the number of consecutive misses."""
    return F.when(misses >= closed, "closed").when(misses >= suspected, "suspected_closed").otherwise("open")


def telling(polls: DataFrame) -> DataFrame:
    """K2: the polls whose silence about a posting counts: answered with a body, source healthy (null: not judged)."""
    good = polls.where(F.col("outcome") == "ok") if "outcome" in polls.columns else polls
    if "health_status" in polls.columns:
        good = good.where(F.coalesce("health_status", F.lit("healthy")) == "healthy")
    return good


def number_polls(polls: DataFrame) -> DataFrame:
    """Successful polls with a body, numbered from 1 within their source.

    Errors, unsupported and not-modified polls say nothing about absence and get no number; nor do polls of a source
    that was not healthy then (column `health_status`, where there is one).  `source_polls` is the number of the
    source's last poll; it stands on the polls, so that sightings get it with their number, on (source, poll).
    """
    good = telling(polls)
    numbered = group_rank(good.select(SRC, POLL).distinct(), [SRC], [F.col(POLL)], "poll_no")
    last = numbered.groupBy(SRC).agg(F.max("poll_no").alias("source_polls"))
    return numbered.join(last, SRC)


def number_sightings(sightings: DataFrame, numbered: DataFrame) -> DataFrame:
    """Distinct (source, posting, poll number); at most one row per posting and poll."""
    seen = sightings.select(SRC, POST, POLL).distinct()
    return seen.join(numbered, [SRC, POLL])


def miss_streak(sightings: DataFrame, polls: DataFrame) -> DataFrame:
    """G7 + K2: current miss count and state per posting; two aggregations and one join."""
    numbered = durable(number_polls(polls))
    seen = number_sightings(sightings, numbered).groupBy(SRC, POST).agg(
        F.max("source_polls").alias("source_polls"), F.min(POLL).alias("first_seen_at"), F.max(POLL).alias("last_seen_at"),
        F.max("poll_no").alias("last_no"), F.count("*").alias("times_seen"))
    out = seen.withColumn("miss_count", (F.col("source_polls") - F.col("last_no")).cast("long"))
    return out.select(SRC, POST, "first_seen_at", "last_seen_at", "times_seen", "miss_count",
                      lifecycle_state(F.col("miss_count")).alias("state"))


def _gaps(sightings: DataFrame, numbered: DataFrame) -> DataFrame:
    """Per sighting: how many polls until the posting is seen again, or until now."""
    w = Window.partitionBy(SRC, POST).orderBy("poll_no")
    seen = number_sightings(sightings, numbered)
    with_next = seen.withColumn("next_no", F.lead("poll_no").over(w)).withColumn("next_ts", F.lead(POLL).over(w))
    return with_next.withColumn(
        "gap", F.coalesce(F.col("next_no") - F.col("poll_no") - 1, F.col("source_polls") - F.col("poll_no")))


def transitions(sightings: DataFrame, polls: DataFrame, suspected: int = MISSES_SUSPECTED,
                closed: int = MISSES_CLOSED) -> DataFrame:
    """K2, K3: every state change as a row (source, posting, event, at)."""
    numbered = durable(number_polls(polls))
    gaps = _gaps(sightings, numbered).where(F.col("gap") >= suspected)
    events = F.filter(F.array(
        F.struct(F.lit("SUSPECTED_CLOSED").alias("event"), (F.col("poll_no") + suspected).alias("at_no")),
        F.when(F.col("gap") >= closed, F.struct(F.lit("CLOSED").alias("event"), (F.col("poll_no") + closed).alias("at_no"))),
        F.when(F.col("next_no").isNotNull(), F.struct(F.lit("REOPENED").alias("event"), F.col("next_no").alias("at_no")))),
        lambda e: e.isNotNull())
    rows = gaps.select(SRC, POST, F.inline(events))
    when = numbered.select(SRC, F.col("poll_no").alias("at_no"), F.col(POLL).alias("at"))
    return rows.join(when, [SRC, "at_no"]).select(SRC, POST, "event", "at")


def lifecycle_table(sightings: DataFrame, polls: DataFrame,
                    suspected: int = MISSES_SUSPECTED, closed: int = MISSES_CLOSED) -> DataFrame:
    """K2, K3: state, miss count, closed_at and reopened_at per posting.

    Being seen again clears `closed_at` and sets `reopened_at`; the state is then
    open.  One pass over the numbered sightings gives everything but the time of
    closing, which is the poll `closed` numbers after the last sighting.
    """
    numbered = durable(number_polls(polls))
    back = (F.col("gap") >= suspected) & F.col("next_no").isNotNull()
    per_posting = _gaps(sightings, numbered).groupBy(SRC, POST).agg(
        F.min(POLL).alias("first_seen_at"), F.max(POLL).alias("last_seen_at"),
        F.max("poll_no").alias("_last"), F.max("source_polls").alias("_polls"),
        F.max(F.when(back, F.col("next_ts"))).alias("reopened_at"), F.count_if(back).alias("times_reopened"))
    misses = (F.col("_polls") - F.col("_last")).cast("long")
    now = per_posting.withColumn("miss_count", misses).withColumn("_at", F.when(misses >= closed, F.col("_last") + closed))
    when = numbered.select(SRC, F.col("poll_no").alias("_at"), F.col(POLL).alias("closed_at"))
    return now.join(when, [SRC, "_at"], "left").select(
        SRC, POST, "first_seen_at", "last_seen_at", "miss_count",
        lifecycle_state(F.col("miss_count"), suspected, closed).alias("state"), "closed_at", "reopened_at", "times_reopened")


def reopened(sightings: DataFrame, polls: DataFrame) -> DataFrame:
    """K3: postings that came back after being suspected closed or closed."""
    return transitions(sightings, polls).where(F.col("event") == "REOPENED").groupBy(SRC, POST).agg(
        F.max("at").alias("reopened_at"), F.count("*").alias("times_reopened"))


def lifecycle_totals(sightings: DataFrame, polls: DataFrame) -> DataFrame:
    """How many postings are in each state and how many misses they carry."""
    return miss_streak(sightings, polls).groupBy("state").agg(
        F.count("*").alias("postings"), F.sum("miss_count").alias("misses"))


# --- one run at a time ---------------------------------------------------------------------------------
def join_misses(state: DataFrame, seen: DataFrame, polled: DataFrame) -> DataFrame:
    """State rows of sources polled in this run get their new miss count; others stay as they are.

    `seen(source_id, posting_id)`, `polled(source_id)`: sources that answered with a body; with a column
    `health_status` in it, those that are not healthy count as not polled.
    """
    hit = seen.select(SRC, POST).distinct().withColumn("_seen", F.lit(True))
    answered = telling(polled).select(SRC).distinct().withColumn("_polled", F.lit(True))
    out = state.join(hit, [SRC, POST], "left").join(answered, SRC, "left")
    count = F.when(F.col("_polled").isNull(), F.col("miss_count")).when(F.col("_seen"), F.lit(0)) \
        .otherwise(F.coalesce("miss_count", F.lit(0)) + 1)
    return out.withColumn("miss_count", count.cast("long"))


def advance_lifecycle(state: DataFrame, seen: DataFrame, polled: DataFrame, now: Column) -> DataFrame:
    """K2, K3: one run: misses move rows towards closed, a sighting opens them again."""
    base = join_misses(state, seen, polled)
    was_down = F.col("state").isin("suspected_closed", "closed")
    back = F.coalesce(F.col("_seen"), F.lit(False)) & F.coalesce(F.col("_polled"), F.lit(False))
    missed = F.coalesce(F.col("_polled"), F.lit(False)) & ~back
    next_state = (F.when(back, "open").when(missed & (F.col("state") == "closed"), "closed")
                  .when(missed & (F.col("miss_count") >= MISSES_SUSPECTED), lifecycle_state(F.col("miss_count")))
                  .otherwise(F.col("state")))
    out = base.withColumn("_next", next_state).withColumn(
        "closed_at", F.when(back, F.lit(None)).when((F.col("_next") == "closed") & (F.col("state") != "closed"), now)
        .otherwise(F.col("closed_at")))
    out = out.withColumn("reopened_at", F.when(back & was_down, now).otherwise(F.col("reopened_at")))
    out = out.withColumn("last_seen_at", F.when(back, now).otherwise(F.col("last_seen_at")))
    return out.withColumn("state", F.col("_next")).drop("_next", "_seen", "_polled")


def close_on_status(postings: DataFrame, statuses: DataFrame, now: Column,
                    codes: tuple[int, ...] = CLOSE_STATUS_CODES, key: str = "job_id") -> DataFrame:
    """K4: postings whose own page answers 404 or 410 close at once."""
    gone = statuses.where(F.col("status_code").isin(list(codes))).select(key).distinct().withColumn("_gone", F.lit(True))
    out = postings.join(gone, key, "left")
    hit = F.col("_gone").isNotNull()
    return out.withColumn("closed_at", F.when(hit, now).otherwise(F.col("closed_at"))) \
        .withColumn("lifecycle", F.when(hit, "closed").otherwise(F.col("lifecycle"))).drop("_gone")


# --- snapshot against state -------------------------------------------------------------------------------
# refreshed on every sighting; reported as changed when they differ
ALWAYS = ["career_level", "career_level_confidence", "academic_term"]
SILENT = ["disciplines", "eligibility", "mobility"]
# taken over only when the content hash differs
ON_CHANGE = ["title", "compensation", "locations"]
ON_CHANGE_SILENT = ["skills", "workplace_type", "remote_scope"]


def upsert_postings(state: DataFrame, snapshot: DataFrame, now: Column, key: str = "job_id",
                    always: list[str] | None = None, on_change: list[str] | None = None) -> DataFrame:
    """Full outer join on the id; `change` says inserted, updated, unchanged or absent.

    First-seen times stay; classification is always refreshed; content fields move
    only with a new content hash; an empty new summary or date never overwrites.
    """
    cols = [c for c in snapshot.columns if c != key]
    missing = [c for c in state.columns if c not in snapshot.columns]
    always = [c for c in (always or ALWAYS) if c in cols]
    on_change = [c for c in (on_change or ON_CHANGE) if c in cols]
    s, n = state.alias("s"), snapshot.alias("n")
    has_s, has_n = F.col(f"s.{key}").isNotNull(), F.col(f"n.{key}").isNotNull()
    both = has_s & has_n
    moved = ~F.col("s.content_hash").eqNullSafe(F.col("n.content_hash"))

    def differs(c: str) -> Column:
        return ~F.col(f"s.{c}").eqNullSafe(F.col(f"n.{c}"))

    marks = [F.when(differs(c), F.lit(c)) for c in always]
    if "summary" in cols:
        marks.append(F.when((F.coalesce(F.col("n.summary"), F.lit("")) != "") & differs("summary"), F.lit("summary")))
    marks += [F.when(moved & differs(c), F.lit(c)) for c in on_change]
    changed = F.filter(F.array(*marks), lambda m: m.isNotNull()) if marks else F.array().cast("array<string>")

    def value(c: str) -> Column:
        old, new = F.col(f"s.{c}"), F.col(f"n.{c}")
        if c == "first_seen_at":
            kept = old
        elif c == "last_seen_at":
            kept = now
        elif c == "summary":
            kept = F.when(F.coalesce(new, F.lit("")) != "", new).when(moved, new).otherwise(old)
        elif c == "source_posted_at":
            kept = F.coalesce(new, old)
        elif c in always or c in SILENT or c == "content_hash":
            kept = new
        elif c in on_change or c in ON_CHANGE_SILENT:
            kept = F.when(moved, new).otherwise(old)
        elif c in state.columns:
            kept = old
        else:
            kept = new
        if c not in state.columns:
            return F.when(has_n, new).alias(c)
        return F.when(both, kept).when(has_n, new).otherwise(old).alias(c)

    out = s.join(n, F.col(f"s.{key}") == F.col(f"n.{key}"), "full_outer").select(
        F.coalesce(f"s.{key}", f"n.{key}").alias(key), *[value(c) for c in cols],
        *[F.col(f"s.{c}").alias(c) for c in missing if c not in ("last_changed_at",)],
        F.when(both & moved, now).otherwise(
            F.col("s.last_changed_at") if "last_changed_at" in state.columns else F.lit(None)).cast("timestamp")
        .alias("last_changed_at"),
        F.when(both, changed).otherwise(F.array().cast("array<string>")).alias("changed_fields"),
        F.col("s.content_hash").alias("previous_hash"),
        F.when(~has_s, "inserted").when(~has_n, "absent").when(F.size(changed) > 0, "updated")
        .otherwise("unchanged").alias("change"))
    return out


def change_events(state: DataFrame, snapshot: DataFrame, now: Column, key: str = "job_id", **options) -> DataFrame:
    """K5: OPENED and UPDATED events with changed fields and hashes."""
    merged = upsert_postings(state, snapshot, now, key, **options).where(F.col("change").isin("inserted", "updated"))
    return merged.select(
        F.when(F.col("change") == "inserted", "OPENED").otherwise("UPDATED").alias("event_type"), key,
        F.when(F.col("change") == "inserted", F.col("first_seen_at")).otherwise(now).alias("timestamp"),
        "changed_fields", "previous_hash", F.col("content_hash").alias("new_hash"))


def run_events(before: DataFrame, after: DataFrame, now: Column, key: str = "job_id") -> DataFrame:
    """K5: OPENED, UPDATED, CLOSED and REOPENED of one run in one schema, from the state before and after it.

    Both states hold key, lifecycle, content_hash, first_seen_at, closed_at and reopened_at; `changed_fields` of the
    later one, where it has it, says what an update changed.
    """
    changed = F.col("n.changed_fields") if "changed_fields" in after.columns else F.array().cast("array<string>")
    b, n = before.alias("b"), after.alias("n")
    fresh, old_hash, new_hash = F.col(f"b.{key}").isNull(), F.col("b.content_hash"), F.col("n.content_hash")
    none = F.array().cast("array<string>")

    def event(test: Column, name: str, at: Column, fields: Column = none) -> Column:
        return F.when(test, F.struct(F.lit(name).alias("event_type"), at.cast("timestamp").alias("timestamp"), fields.alias("changed_fields"),
                                     F.when(~fresh, old_hash).alias("previous_hash"), new_hash.alias("new_hash")))

    down = F.coalesce(F.col("b.lifecycle").isin("suspected_closed", "closed"), F.lit(False))
    moved = ~fresh & ((F.size(changed) > 0) | ~old_hash.eqNullSafe(new_hash))
    events = F.filter(F.array(
        event(fresh, "OPENED", F.col("n.first_seen_at")), event(moved, "UPDATED", now, changed),
        event((F.col("n.lifecycle") == "closed") & ~F.coalesce(F.col("b.lifecycle") == "closed", F.lit(False)), "CLOSED", F.col("n.closed_at")),
        event((F.col("n.lifecycle") == "open") & down, "REOPENED", F.coalesce("n.reopened_at", now))), lambda e: e.isNotNull())
    return n.join(b, F.col(f"b.{key}") == F.col(f"n.{key}"), "left").select(F.col(f"n.{key}").alias(key), F.inline(events))
