"""K1: the whole incremental run over landed polls: ingest, enrich, resolve, upsert, miss, close, promote, report.

Landing: the payload rows of `sources.boards` (one row per landed response page) with `outcome` (ok, not_modified, error,
unsupported) and `run_at`, the time of the run they belong to.  State lives in hash buckets (`plans.state`): `sources` by
source, `companies` by company, `postings` by source (a source's postings spread over some buckets); `events` and `runs`
are appended.  A run reads and rewrites only the buckets of the sources and companies it polls or finds, however large the
state is.

Defined results: pages of one source in one run are one poll, and a failed page makes it a failed one; polls of disabled,
blocked or unsupported sources are ignored; polls of a source that are not newer than its last one are ignored and counted
as `late`; a polled source that is not known is added as the payload names it; a posting listed twice in a run counts once
(the largest content hash); a board that a listing names in this run and that is polled in it at once counts as promoted;
an empty run changes nothing but the report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantic.functions import ids
from vacantic.functions.text import canonical_text
from vacantic.operators.companies import SOURCE_FIELDS, merge_seeds, resolve_company, retire_sources, with_company_key
from vacantic.operators.discovery import boards_from_postings, promotable
from vacantic.operators.health import DEGRADED_AFTER, FAILING_AFTER, next_due
from vacantic.operators.lifecycle import lifecycle_state, upsert_postings
from vacantic.operators.scale import durable, spread
from vacantic.plans.normalize import normalize
from vacantic.plans.state import BUCKETS, Layout, commit, read_table
from vacantic.rules import MISSES_SUSPECTED, RuleSet
from vacantic.sources.boards import READERS, SOURCE_COLUMNS, union_sources
from vacantic.sources.seeds import current_snapshot, seeds_to_companies, seeds_to_sources

LANDING = ", ".join([f"{c} {'timestamp' if c == 'fetched_at' else 'string'}" for c in SOURCE_COLUMNS]
                    + ["outcome string", "payload string", "page_url string", "run_at timestamp"])
SOURCES, COMPANIES = Layout("source_id"), Layout("company_id")
POSTINGS = Layout("source_id", within="job_id", spread=8)
SOURCE_STATE = ["source_id", *SOURCE_FIELDS, "last_polled_at", "last_success_at", "last_failure_at"]
COMPANY_STATE = ["company_id", "name", "normalized_name", "canonical_domain", "aliases", "careers_urls", "ats_sources",
                 "first_seen_at", "last_seen_at", "active_job_count"]
IDLE = ["blocked", "disabled", "unsupported"]


def _no_time() -> Column:
    return F.lit(None).cast("timestamp")


def _source_state(rows: DataFrame) -> DataFrame:
    return rows.select("source_id", *SOURCE_FIELDS, *[_no_time().alias(c) for c in SOURCE_STATE if c.startswith("last_") and c != "last_validated_at"])


def _landed_sources(polls: DataFrame, now: Column) -> DataFrame:
    """Source rows as the payloads name them, for sources that are not known."""
    host = F.regexp_extract("careers_url", r"^https?://(?:www\.)?([^/?#:]+)", 1)
    return _source_state(polls.select(
        "source_id", "company_id", "company_name", F.lower(host).alias("company_domain"), "careers_url", "adapter", "adapter_tenant",
        F.lit("landing").alias("discovered_via"), F.lit(1.0).alias("discovery_confidence"), now.alias("first_discovered_at"), now.alias("last_validated_at"),
        F.lit(0).alias("consecutive_failures"), F.lit("warm").alias("poll_tier"), _no_time().alias("next_due_at"), F.lit("healthy").alias("health_status"),
        F.lit(True).alias("enabled")))


def polls_of(landed: DataFrame) -> DataFrame:
    """One row per polled source: its outcome and what the payload says about the source."""
    bad = [F.max(F.col("outcome") == o) for o in ("error", "unsupported", "ok")]
    about = F.struct(*[c for c in SOURCE_COLUMNS if c not in ("source_id", "fetched_at")])
    return landed.groupBy("source_id").agg(
        F.when(bad[0], "error").when(bad[1], "unsupported").when(bad[2], "ok").otherwise("not_modified").alias("outcome"),
        F.max(about).alias("_about")).select("source_id", "outcome", "_about.*")


def poll_sources(known: DataFrame, polls: DataFrame, now: Column) -> DataFrame:
    """Sources after their polls: health, failures, next poll; `polled` is the outcome where the poll counts, `late` where it is too old."""
    s = known.join(polls.select("source_id", "outcome"), "source_id", "left")
    late = F.col("outcome").isNotNull() & F.coalesce(F.col("last_polled_at") >= now, F.lit(False))
    due = F.col("enabled") & ~F.col("health_status").isin(IDLE) & ~late
    s = s.withColumn("late", late).withColumn("polled", F.when(due, F.col("outcome")))
    good, bad, no = F.col("polled").isin("ok", "not_modified"), F.col("polled") == "error", F.col("polled") == "unsupported"
    failures = F.when(good, 0).when(bad, F.col("consecutive_failures") + 1).otherwise(F.col("consecutive_failures"))
    s = s.withColumn("consecutive_failures", failures.cast("int"))
    n = F.col("consecutive_failures")
    health = (F.when(good, "healthy").when(no, "unsupported").when(bad & (n >= FAILING_AFTER), "disabled")
              .when(bad & (n >= DEGRADED_AFTER), "degraded").otherwise(F.col("health_status")))
    took = F.col("polled").isNotNull()
    return s.withColumns({
        "health_status": health, "enabled": F.col("enabled") & ~F.coalesce(bad & (n >= FAILING_AFTER), F.lit(False)),
        "last_polled_at": F.when(took, now).otherwise(F.col("last_polled_at")),
        "last_success_at": F.when(good, now).otherwise(F.col("last_success_at")),
        "last_failure_at": F.when(bad, now).otherwise(F.col("last_failure_at")),
        "last_validated_at": F.when(good, now).otherwise(F.col("last_validated_at")),
        "next_due_at": F.when(took, next_due(now, F.col("poll_tier"))).otherwise(F.col("next_due_at"))})


def snapshot_of(raw: DataFrame, rules: RuleSet | None = None) -> DataFrame:
    """Normalized postings of a run, one row per id."""
    rows = normalize(raw, rules=rules).drop("last_changed_at")
    one = rows.groupBy(F.col("job_id").alias("_id")).agg(F.max_by(F.struct(*rows.columns), F.struct("content_hash", "source_id", "title", "job_url")).alias("_r"))
    return one.select("_r.*").withColumn("miss_count", F.lit(0).cast("bigint"))


def advance(state: DataFrame | None, snapshot: DataFrame, polled: DataFrame, now: Column) -> DataFrame:
    """Postings of the touched buckets after the run, with `change`, `changed_fields`, `previous_hash` and `was`, the lifecycle before it.

    `polled(source_id)`: sources whose silence about a posting counts.
    """
    if state is None:
        state = snapshot.withColumn("last_changed_at", _no_time()).limit(0)
    at = F.when(F.lit(True), now)
    first = snapshot.withColumns({"first_seen_at": at, "last_seen_at": at})
    merged = upsert_postings(state.withColumn("was", F.col("lifecycle")), first, now)
    merged = merged.join(polled.select("source_id").distinct().withColumn("_polled", F.lit(True)), "source_id", "left")
    seen = F.col("change") != "absent"
    missed = ~seen & F.coalesce("_polled", F.lit(False))
    merged = merged.withColumn("miss_count", F.when(seen, 0).when(missed, F.col("miss_count") + 1).otherwise(F.col("miss_count")).cast("bigint"))
    after = F.when(seen, "open").when(missed & (F.col("was") != "closed") & (F.col("miss_count") >= MISSES_SUSPECTED), lifecycle_state(F.col("miss_count"))) \
        .otherwise(F.col("was"))
    down = F.coalesce(F.col("was").isin("suspected_closed", "closed"), F.lit(False))
    closing = (F.col("lifecycle") == "closed") & ~F.coalesce(F.col("was") == "closed", F.lit(False))
    return merged.withColumn("lifecycle", after).withColumns({
        "closed_at": F.when(seen, _no_time()).when(closing, now).otherwise(F.col("closed_at")),
        "reopened_at": F.when(seen & down, now).otherwise(F.col("reopened_at"))}).drop("_polled")


def events_of(merged: DataFrame, now: Column) -> DataFrame:
    """K5: OPENED, UPDATED, CLOSED and REOPENED of the run, from the merged rows alone."""
    fresh, down = F.col("change") == "inserted", F.coalesce(F.col("was").isin("suspected_closed", "closed"), F.lit(False))
    moved = (F.col("change") == "updated") | ((F.col("change") == "unchanged") & ~F.col("previous_hash").eqNullSafe(F.col("content_hash")))
    none = F.array().cast("array<string>")

    def event(test: Column, name: str, fields: Column = none) -> Column:
        return F.when(test, F.struct(F.lit(name).alias("event_type"), now.cast("timestamp").alias("at"), fields.alias("changed_fields"),
                                     F.col("previous_hash"), F.col("content_hash").alias("new_hash")))

    found = F.filter(F.array(
        event(fresh, "OPENED"), event(moved, "UPDATED", F.col("changed_fields")),
        event((F.col("lifecycle") == "closed") & ~F.coalesce(F.col("was") == "closed", F.lit(False)), "CLOSED"),
        event((F.col("lifecycle") == "open") & down, "REOPENED")), lambda e: e.isNotNull())
    return merged.select("job_id", "source_id", "company_id", F.inline(found))


def _active(column: str) -> Column:
    return F.coalesce(F.col(column).isin("open", "reopened"), F.lit(False)).cast("bigint")


def advance_companies(known: DataFrame, raw: DataFrame, sources: DataFrame, merged: DataFrame, promoted: DataFrame, now: Column) -> DataFrame:
    """Companies after the run: employers of listings, companies of polled and promoted sources, active postings by difference."""
    met = resolve_company(raw, known.drop("active_job_count"), now)
    own = sources.where(F.col("polled") == "ok").select("company_id", F.col("company_name").alias("company"), F.col("company_domain").alias("domain"), "adapter", "source_id") \
        .unionByName(promoted.select("company_id", F.col("company_name").alias("company"), F.col("company_domain").alias("domain"), "adapter", "source_id"))
    new = seeds_to_companies(own, now).withColumnsRenamed({c: f"n_{c}" for c in COMPANY_STATE if c not in ("company_id", "active_job_count")})
    no = F.array().cast("array<string>")
    out = met.join(new, "company_id", "full_outer").select(
        "company_id", F.coalesce("name", "n_name").alias("name"),
        F.coalesce("normalized_name", F.replace(canonical_text(F.col("n_name")), F.lit(" "), F.lit("-"))).alias("normalized_name"),
        F.coalesce("canonical_domain", "n_canonical_domain").alias("canonical_domain"), F.coalesce("aliases", no).alias("aliases"),
        F.coalesce("careers_urls", "n_careers_urls").alias("careers_urls"),
        F.array_sort(F.array_union(F.coalesce("ats_sources", no), F.coalesce("n_ats_sources", no))).alias("ats_sources"),
        F.coalesce("first_seen_at", "n_first_seen_at").alias("first_seen_at"),
        F.greatest("last_seen_at", "n_last_seen_at").alias("last_seen_at"))
    moved = merged.groupBy("company_id").agg(F.sum(_active("lifecycle") - _active("was")).alias("_d"))
    return out.join(known.select("company_id", "active_job_count"), "company_id", "left").join(moved, "company_id", "left") \
        .withColumn("active_job_count", F.coalesce("active_job_count", F.lit(0)) + F.coalesce("_d", F.lit(0))).select(*COMPANY_STATE)


def _empty(spark: SparkSession, like: DataFrame) -> DataFrame:
    return spark.createDataFrame([], like.schema)


def apply_run(spark: SparkSession, path: str, landed: DataFrame, at, seeds: DataFrame | None = None, marks: dict | None = None,
              rules: RuleSet | None = None, buckets: int = BUCKETS) -> dict:
    """One run at time `at` over the landed rows of that run; returns the pointer of the version it made."""
    now = F.lit(at).cast("timestamp")
    buckets = (current_snapshot(spark, path) or {}).get("buckets", buckets)
    landed = landed.where(F.col("source_id").isNotNull())
    polls = durable(polls_of(landed))
    seeded = seeds_to_sources(seeds, now) if seeds is not None else None

    # sources: stored ones of the touched buckets, seeds, and landed ones that are not known
    asked = polls.select("source_id") if seeded is None else polls.select("source_id").unionByName(seeded.select("source_id"))
    source_buckets = SOURCES.touched(asked, buckets)
    known = read_table(spark, path, "sources", None if seeded is not None else source_buckets)
    if known is None:
        known = _empty(spark, _landed_sources(polls.limit(0), now))
    if seeded is not None:
        merged = retire_sources(merge_seeds(known.select("source_id", *SOURCE_FIELDS), seeded).drop("seed_change"), seeded)
        known = merged.join(known.select("source_id", "last_polled_at", "last_success_at", "last_failure_at"), "source_id", "left").select(*SOURCE_STATE)
        source_buckets = None
    unknown = _landed_sources(polls, now).join(known.select("source_id"), "source_id", "left_anti")
    polled = durable(poll_sources(known.unionByName(unknown), polls, now))

    ok = polled.where(F.col("polled") == "ok").select("source_id")
    formats = {r["adapter"] for r in polls.select("adapter").where(F.col("adapter").isin(sorted(READERS))).distinct().collect()}
    readers = {a: r for a, r in READERS.items() if a in formats} or {"simplify": READERS["simplify"]}
    raw = durable(union_sources(landed.where(F.col("outcome") == "ok").drop("outcome", "run_at").join(ok, "source_id", "left_semi"), readers))
    listing = with_company_key(raw.where(F.col("adapter") == "simplify"))
    candidates = boards_from_postings(listing.select(F.coalesce("apply_url", "job_url").alias("apply_url"), F.col("employer_name").alias("company_name"),
                                                     F.col("metadata.company_domain").alias("company_domain")))
    promoted = durable(promotable(candidates, "simplify", now))
    touched = SOURCES.touched(promoted.select("source_id"), buckets)
    more, other = [], None
    if source_buckets is not None:
        more = sorted(set(touched) - set(source_buckets))
        other = read_table(spark, path, "sources", more)
        if more and other is not None:
            polled = polled.unionByName(other.withColumns({"outcome": F.lit(None).cast("string"), "late": F.lit(False), "polled": F.lit(None).cast("string")}))
        source_buckets = sorted({*source_buckets, *more})
    # boards that were not known before this run; those that are polled in it already have a row as the payload names them
    news = promoted.join(known.select("source_id"), "source_id", "left_anti")
    if more and other is not None:
        news = news.join(other.select("source_id"), "source_id", "left_anti")
    news = durable(news)
    about = ["discovered_via", "discovery_confidence", "poll_tier", "careers_url"]
    named = polled.join(news.select("source_id", *[F.col(c).alias(f"_{c}") for c in about]), "source_id", "left")
    polled = durable(named.withColumns({c: F.coalesce(f"_{c}", c) for c in about}).drop(*[f"_{c}" for c in about]))
    found = _source_state(news).join(polled.select("source_id"), "source_id", "left_anti")
    sources = polled.select(*SOURCE_STATE).unionByName(found.select(*SOURCE_STATE))

    # postings: only the buckets of the sources that answered
    telling = polled.where((F.col("polled") == "ok") & (F.col("health_status") == "healthy")).select("source_id")
    posting_buckets = POSTINGS.touched(telling, buckets)
    merged = durable(advance(read_table(spark, path, "postings", posting_buckets), snapshot_of(raw, rules), telling, now))
    postings = merged.drop("change", "changed_fields", "previous_hash", "was")

    employers = with_company_key(raw).select(F.col("employer_id").alias("company_id")).unionByName(
        polled.where("polled IS NOT NULL").select("company_id")).unionByName(promoted.select("company_id")).where("company_id IS NOT NULL").distinct()
    moved = merged.where(_active("lifecycle") != _active("was")).select("company_id").distinct()
    company_buckets = COMPANIES.touched(employers.unionByName(moved), buckets)
    have = read_table(spark, path, "companies", company_buckets)
    if have is None:
        have = spark.createDataFrame([], "company_id string, name string, normalized_name string, canonical_domain string, aliases array<string>, "
                                     "careers_urls array<string>, ats_sources array<string>, first_seen_at timestamp, last_seen_at timestamp, active_job_count bigint")
    companies = advance_companies(have, raw, polled, merged, promoted, now)

    events = durable(events_of(merged, now))
    report = polled.agg(
        F.count_if(F.col("polled") == "ok").alias("fetched"), F.count_if(F.col("polled") == "not_modified").alias("not_modified"),
        F.count_if(F.col("polled").isin("error", "unsupported")).alias("failures"), F.count_if("late").alias("late")).first()
    by_kind = {r["event_type"]: r["n"] for r in events.groupBy("event_type").agg(F.count("*").alias("n")).collect()}
    runs = spark.createDataFrame(
        [(at, *[report[c] for c in ("fetched", "not_modified", "failures", "late")], *[by_kind.get(k, 0) for k in ("OPENED", "UPDATED", "CLOSED", "REOPENED")], news.count())],
        "run_at timestamp, fetched bigint, not_modified bigint, failures bigint, late bigint, opened bigint, updated bigint, closed bigint, reopened bigint, promoted bigint")
    changes = {"sources": (sources, SOURCES, source_buckets)}
    if posting_buckets:
        changes["postings"] = (postings, POSTINGS, posting_buckets)
    if company_buckets:
        changes["companies"] = (companies, COMPANIES, company_buckets)
    return commit(spark, path, changes, {"events": events, "runs": runs}, marks, buckets)


def apply_batch(spark: SparkSession, path: str, batch: DataFrame, batch_id: int, seeds: DataFrame | None = None,
                rules: RuleSet | None = None, buckets: int = BUCKETS) -> None:
    """The runs of a micro-batch in time order, one version each; runs of a replayed batch that are committed already are skipped."""
    times = sorted(r[0] for r in batch.select("run_at").where("run_at IS NOT NULL").distinct().collect())
    done = ((current_snapshot(spark, path) or {}).get("marks") or {"batch_id": -1, "runs": 0})
    if done["batch_id"] > batch_id:
        return
    for i, at in enumerate(times):
        if done["batch_id"] == batch_id and i < done["runs"]:
            continue
        apply_run(spark, path, batch.where(F.col("run_at") == F.lit(at)).drop("run_at"), at, seeds, {"batch_id": batch_id, "runs": i + 1}, rules, buckets)


def track_runs(spark: SparkSession, landing: str, path: str, checkpoint: str, fmt: str = "parquet", files_per_batch: int | None = None,
               seeds: DataFrame | None = None, rules: RuleSet | None = None, buckets: int = BUCKETS):
    """K1: follow a folder of landed polls; every run becomes one version of the state, exactly once."""
    reader = spark.readStream.schema(LANDING).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def step(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        batch = spread(batch).persist()  # a landed file is one split, and a run parses and normalizes its payloads where they are
        apply_batch(session, path, batch, batch_id, seeds, rules, buckets)
        batch.unpersist()

    return reader.load(landing).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
