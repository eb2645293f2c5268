"""Bindings of tracking, health, joins and aggregates."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantic.bindings import tables as t
from vacantic.bindings.registry import GRID, LINKS, POLLS, POSTINGS, SOURCES, query
from vacantic.functions import ids
from vacantic.operators import companies, health, lifecycle, search
from vacantic.operators.scale import durable
from vacantic.plans.publish import scratch_folder
from vacantic.streaming import track


def stamp(c: str) -> Column:
    return F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias(c)


def _ts(c: str, name: str | None = None) -> str:
    return f"coalesce(strftime({c}, '%Y-%m-%d %H:%M:%S'), '') AS {name or c}"


# --- lifecycle ----------------------------------------------------------------------------------------------
@query("miss_streak", f"""
WITH {GRID} SELECT source_id, posting_id, arg_max(misses, d) AS miss_count, arg_max(state, d) AS state, sum(hit)::BIGINT AS times_seen,
  {_ts('max(d) FILTER (WHERE hit = 1)', 'last_seen_at')} FROM st GROUP BY ALL""")
def miss_streak(spark, sf):
    return lifecycle.miss_streak(t.sightings(spark, sf), t.day_polls(spark, sf)).select(
        "source_id", "posting_id", "miss_count", "state", "times_seen", stamp("last_seen_at"))


@query("lifecycle_totals", f"""
WITH {GRID}, now AS (SELECT source_id, posting_id, arg_max(misses, d) AS misses, arg_max(state, d) AS state FROM st GROUP BY ALL)
SELECT state, count(*) AS postings, sum(misses)::BIGINT AS misses FROM now GROUP BY state""")
def lifecycle_totals(spark, sf):
    return lifecycle.lifecycle_totals(t.sightings(spark, sf), t.day_polls(spark, sf))


_LIFE = f"""
WITH {GRID}, back AS (SELECT source_id, posting_id, max(d) AS reopened_at, count(*) AS times FROM st WHERE hit = 1 AND before >= 2 GROUP BY ALL),
shut AS (SELECT source_id, posting_id, max(d) AS closed_at FROM st WHERE misses = 4 GROUP BY ALL),
now AS (SELECT source_id, posting_id, arg_max(misses, d) AS miss_count, arg_max(state, d) AS state FROM st GROUP BY ALL)
SELECT n.source_id, n.posting_id, n.miss_count, n.state, {_ts('b.reopened_at', 'reopened_at')}, {_ts("CASE WHEN n.state = 'closed' THEN s.closed_at END", 'closed_at')},
  coalesce(b.times, 0) AS times_reopened
FROM now n LEFT JOIN back b USING (source_id, posting_id) LEFT JOIN shut s USING (source_id, posting_id)"""


@query("advance_lifecycle", _LIFE)
def advance_lifecycle(spark, sf):
    return lifecycle.lifecycle_table(t.sightings(spark, sf), t.day_polls(spark, sf)).select(
        "source_id", "posting_id", "miss_count", "state", stamp("reopened_at"), stamp("closed_at"), "times_reopened")


def _gated(health: str) -> str:
    return GRID.replace("AS d FROM events)", f"AS d FROM events WHERE {health} = 'healthy')", 1)


_HEALTH = "CASE dayofmonth(ts) % 5 WHEN 2 THEN 'degraded' WHEN 4 THEN 'failing' ELSE 'healthy' END"


@query("lifecycle_health", _LIFE.replace(GRID, _gated(_HEALTH)))
def lifecycle_health(spark, sf):
    """Polls of a source that is degraded or failing on that day move nothing towards closed."""
    day = F.dayofmonth("poll_ts") % 5
    polls = t.day_polls(spark, sf).withColumn("health_status", F.when(day == 2, "degraded").when(day == 4, "failing").otherwise("healthy"))
    return lifecycle.lifecycle_table(t.sightings(spark, sf), polls).select(
        "source_id", "posting_id", "miss_count", "state", stamp("reopened_at"), stamp("closed_at"), "times_reopened")


@query("lifecycle_events", f"""
WITH {GRID} SELECT source_id, posting_id, 'SUSPECTED_CLOSED' AS event, {_ts('d', 'at')} FROM st WHERE misses = 2
UNION ALL SELECT source_id, posting_id, 'CLOSED', {_ts('d', 'at')} FROM st WHERE misses = 4
UNION ALL SELECT source_id, posting_id, 'REOPENED', {_ts('d', 'at')} FROM st WHERE hit = 1 AND before >= 2""")
def lifecycle_events(spark, sf):
    return lifecycle.transitions(t.sightings(spark, sf), t.day_polls(spark, sf)).select("source_id", "posting_id", "event", stamp("at"))


@query("reopen", f"""
WITH {GRID} SELECT source_id, posting_id, {_ts('max(d)', 'reopened_at')}, count(*) AS times_reopened FROM st WHERE hit = 1 AND before >= 2 GROUP BY ALL""")
def reopen(spark, sf):
    return lifecycle.reopened(t.sightings(spark, sf), t.day_polls(spark, sf)).select("source_id", "posting_id", stamp("reopened_at"), "times_reopened")


_RUN = """
s AS (SELECT DISTINCT user_id::VARCHAR AS source_id, event_type AS posting_id, ts >= TIMESTAMP '2024-01-30' AS late FROM events),
old AS (SELECT source_id, posting_id, CASE posting_id WHEN 'click' THEN 1 WHEN 'view' THEN 3 WHEN 'purchase' THEN 5 ELSE 0 END AS n FROM s WHERE NOT late),
run AS (SELECT o.*, h.source_id IS NOT NULL AS hit, p.source_id IS NOT NULL AS polled,
    CASE WHEN n >= 4 THEN 'closed' WHEN n >= 2 THEN 'suspected_closed' ELSE 'open' END AS was
  FROM old o LEFT JOIN (SELECT * FROM s WHERE late) h USING (source_id, posting_id) LEFT JOIN (SELECT DISTINCT source_id FROM s WHERE late) p USING (source_id))
"""


def _run_state(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """State before the last day, postings listed on the last day, sources polled on it."""
    e = t.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("source_id"), F.col("event_type").alias("posting_id"), "ts")
    late = F.col("ts") >= t.ts("2024-01-30 00:00:00")
    n = F.when(F.col("posting_id") == "click", 1).when(F.col("posting_id") == "view", 3).when(F.col("posting_id") == "purchase", 5).otherwise(0)
    null = F.lit(None).cast("timestamp")
    old = e.where(~late).groupBy("source_id", "posting_id").agg(F.max("ts").alias("last_seen_at")).select(
        "source_id", "posting_id", n.cast("long").alias("miss_count"), lifecycle.lifecycle_state(n).alias("state"), "last_seen_at",
        null.alias("closed_at"), null.alias("reopened_at"))
    seen = e.where(late).select("source_id", "posting_id").distinct()
    return old, seen, seen.select("source_id").distinct()


@query("join_misses", f"""WITH {_RUN} SELECT source_id, posting_id, (CASE WHEN NOT polled THEN n WHEN hit THEN 0 ELSE n + 1 END)::BIGINT AS miss_count FROM run""")
def join_misses(spark, sf):
    return lifecycle.join_misses(*_run_state(spark, sf)).select("source_id", "posting_id", "miss_count")


@query("lifecycle_run", f"""
WITH {_RUN}, r2 AS (SELECT *, (CASE WHEN NOT polled THEN n WHEN hit THEN 0 ELSE n + 1 END)::BIGINT AS m FROM run),
r3 AS (SELECT *, CASE WHEN NOT polled THEN was WHEN hit THEN 'open' WHEN was = 'closed' OR m >= 4 THEN 'closed' WHEN m >= 2 THEN 'suspected_closed' ELSE was END AS state FROM r2)
SELECT source_id, posting_id, m AS miss_count, state, CASE WHEN state = 'closed' AND was <> 'closed' THEN '2024-01-31 00:00:00' ELSE '' END AS closed_at,
  CASE WHEN polled AND hit AND was <> 'open' THEN '2024-01-31 00:00:00' ELSE '' END AS reopened_at FROM r3""")
def lifecycle_run(spark, sf):
    return lifecycle.advance_lifecycle(*_run_state(spark, sf), t.ts(t.EVENTS_AS_OF)).select(
        "source_id", "posting_id", "miss_count", "state", stamp("closed_at"), stamp("reopened_at"))


@query("close_on_status", """
SELECT event_id AS job_id, CASE WHEN event_type = 'error' AND (user_id % 2) = 0 THEN 'closed' ELSE 'open' END AS lifecycle,
  CASE WHEN event_type = 'error' AND (user_id % 2) = 0 THEN '2024-01-31 00:00:00' ELSE '' END AS closed_at FROM events""")
def close_on_status(spark, sf):
    e = t.table(spark, sf, "events")
    posts = e.select(F.col("event_id").alias("job_id"), F.lit("open").alias("lifecycle"), F.lit(None).cast("timestamp").alias("closed_at"))
    status = e.select(F.col("event_id").alias("job_id"), F.when(F.col("event_type") != "error", 200).when(F.col("user_id") % 4 == 0, 404)
                      .when(F.col("user_id") % 2 == 0, 410).otherwise(500).alias("status_code"))
    return lifecycle.close_on_status(posts, status, t.ts(t.EVENTS_AS_OF)).select("job_id", "lifecycle", stamp("closed_at"))


# --- snapshot against state ------------------------------------------------------------------------------------
_UPSERT = f"""
WITH {POSTINGS}, old AS (SELECT *, sha256(title) AS h FROM post WHERE o_orderstatus <> 'P'),
new AS (SELECT *, CASE WHEN visa THEN title || ' II' ELSE title END AS t2, CASE WHEN relocation THEN 'fellowship' ELSE career_level END AS l2,
  sha256(CASE WHEN visa THEN title || ' II' ELSE title END) AS h2, CASE WHEN airfare THEN '' ELSE summary || CASE WHEN housing THEN '.' ELSE '' END END AS s2 FROM post WHERE o_orderstatus <> 'F'),
j AS (SELECT coalesce(o.job_id, n.job_id) AS job_id, o.job_id IS NOT NULL AS a, n.job_id IS NOT NULL AS b, o.title AS t1, n.t2, o.career_level AS l1, n.l2, o.h, n.h2,
    o.summary AS s1, n.s2, coalesce(o.visa, n.visa) AS visa FROM old o FULL JOIN new n ON o.job_id = n.job_id),
merged AS (SELECT *, concat_ws(',', CASE WHEN a AND b AND l1 <> l2 THEN 'career_level' END, CASE WHEN a AND b AND s2 <> '' AND s1 <> s2 THEN 'summary' END,
    CASE WHEN a AND b AND h <> h2 AND t1 <> t2 THEN 'title' END) AS changed_fields FROM j)
"""


def _versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Open and closed orders as state; open and pending orders as snapshot, with retitled and reclassified rows."""
    p = t.postings(spark, sf).select("job_id", "title", "summary", "career_level", "career_level_confidence", "academic_term", "mobility",
                                     "source_posted_at", "first_seen_at", "last_seen_at", "lifecycle")

    def on(claim: str) -> Column:
        return F.col(f"mobility.{claim}.status") == "confirmed"

    old = p.where(F.col("lifecycle") != "suspected_closed").withColumn("content_hash", F.sha2("title", 256))
    new = (p.where(F.col("lifecycle") != "closed")
           .withColumn("title", F.when(on("visa_sponsorship"), F.concat("title", F.lit(" II"))).otherwise(F.col("title")))
           .withColumn("career_level", F.when(on("relocation_assistance"), "fellowship").otherwise(F.col("career_level")))
           .withColumn("summary", F.when(on("airfare"), "").when(on("housing_provided"), F.concat("summary", F.lit("."))).otherwise(F.col("summary")))
           .withColumn("content_hash", F.sha2("title", 256)))
    return old, new


@query("upsert_postings", _UPSERT + """
SELECT job_id, CASE WHEN NOT a THEN 'inserted' WHEN NOT b THEN 'absent' WHEN changed_fields <> '' THEN 'updated' ELSE 'unchanged' END AS change, changed_fields,
  coalesce(CASE WHEN a AND b AND h <> h2 THEN t2 WHEN a THEN t1 ELSE t2 END, '') AS title, coalesce(l2, l1) AS career_level,
  CASE WHEN a AND b AND s2 = '' AND h = h2 THEN s1 WHEN b THEN s2 ELSE s1 END AS summary FROM merged""")
def upsert_postings(spark, sf):
    old, new = _versions(spark, sf)
    return lifecycle.upsert_postings(old, new, t.ts(t.AS_OF)).select(
        "job_id", "change", F.array_join("changed_fields", ",").alias("changed_fields"), "title", "career_level", "summary")


@query("change_events", _UPSERT + """
SELECT job_id, CASE WHEN NOT a THEN 'OPENED' ELSE 'UPDATED' END AS event_type, changed_fields, coalesce(h, '') AS previous_hash, h2 AS new_hash
FROM merged WHERE b AND (NOT a OR changed_fields <> '')""")
def change_events(spark, sf):
    old, new = _versions(spark, sf)
    return lifecycle.change_events(old, new, t.ts(t.AS_OF)).select(
        "job_id", "event_type", F.array_join("changed_fields", ",").alias("changed_fields"), F.coalesce("previous_hash", F.lit("")).alias("previous_hash"), "new_hash")


@query("join_index", f"WITH {POSTINGS} SELECT job_id, title FROM post WHERE lifecycle = 'open'")
def join_index(spark, sf):
    p = t.postings(spark, sf)
    index = search.project_search(p.where(F.col("lifecycle") == "open"))
    return search.join_index(p, index).select("job_id", "title")


@query("new_arrivals", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def new_arrivals(spark, sf):
    known = t.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return search.new_arrivals(t.table(spark, sf, "orders"), known, "o_orderkey").select("o_orderkey")


# --- health ---------------------------------------------------------------------------------------------------
_STREAK = f"""
WITH {POLLS}, ok AS (SELECT source_id, max(poll_ts) AS last_ok FROM polls WHERE outcome <> 'error' GROUP BY source_id),
f AS (SELECT source_id, count(*) FILTER (WHERE outcome = 'error' AND (last_ok IS NULL OR poll_ts > last_ok)) AS failures, any_value(last_ok) AS last_ok,
  max(poll_ts) FILTER (WHERE outcome = 'error') AS last_error FROM polls LEFT JOIN ok USING (source_id) GROUP BY source_id)
"""


@query("failure_streak", _STREAK + f"SELECT source_id, failures AS consecutive_failures, {_ts('last_ok', 'last_success_at')}, {_ts('last_error', 'last_failure_at')} FROM f")
def failure_streak(spark, sf):
    return health.failure_streak(t.polls(spark, sf)).select("source_id", "consecutive_failures", stamp("last_success_at"), stamp("last_failure_at"))


@query("source_health", _STREAK + """
SELECT source_id, failures AS consecutive_failures, CASE WHEN failures >= 10 THEN 'disabled' WHEN failures >= 3 THEN 'degraded' ELSE 'healthy' END AS health_status, failures < 10 AS enabled FROM f""")
def source_health(spark, sf):
    return health.source_health(t.polls(spark, sf)).select("source_id", "consecutive_failures", "health_status", "enabled")


@query("adapter_health", f"""
WITH {POLLS}, e AS (SELECT adapter, message, row_number() OVER (PARTITION BY adapter ORDER BY poll_ts DESC, poll_id DESC) AS n FROM polls WHERE outcome = 'error'),
s AS (SELECT adapter, string_agg(message, '|' ORDER BY n DESC) AS samples FROM e WHERE n <= 5 GROUP BY adapter)
SELECT adapter, count(*) FILTER (WHERE outcome = 'ok') AS success_count, count(*) FILTER (WHERE outcome = 'error') AS failure_count,
  round(count(*) FILTER (WHERE outcome = 'ok') / count(*) FILTER (WHERE outcome IN ('ok', 'error'))::DOUBLE, 6) AS success_rate,
  {_ts("max(poll_ts) FILTER (WHERE outcome = 'error')", 'last_failure_at')}, any_value(samples) AS samples FROM polls LEFT JOIN s USING (adapter) GROUP BY adapter""")
def adapter_health(spark, sf):
    return health.adapter_health(t.polls(spark, sf)).select(
        "adapter", "success_count", "failure_count", F.round("success_rate", 6).alias("success_rate"), stamp("last_failure_at"),
        F.array_join("sample_errors", "|").alias("samples"))


_REG = f"""
WITH {POLLS}, r AS (SELECT adapter, count(*) FILTER (WHERE outcome = 'ok') AS success_count, count(*) FILTER (WHERE outcome = 'error') AS failure_count FROM polls GROUP BY adapter),
reg AS (SELECT *, failure_count / (success_count + failure_count)::DOUBLE AS rate FROM r WHERE success_count + failure_count >= 10)
"""


@query("health_regressions", _REG + """
SELECT adapter, success_count, failure_count, round(rate, 3) AS failure_rate, CASE WHEN rate >= 0.8 THEN 'critical' ELSE 'warning' END AS severity FROM reg WHERE rate >= 0.25""")
def health_regressions(spark, sf):
    return health.health_regressions(t.polls(spark, sf), threshold=0.25)


@query("apply_adapter_health", f"""{_REG}, {SOURCES} SELECT source_id, CASE WHEN 'adapter-' || (s_suppkey % 7) IN (SELECT adapter FROM reg WHERE rate >= 0.25) THEN 'degraded' ELSE health_status END AS health_status FROM src""")
def apply_adapter_health(spark, sf):
    bad = health.health_regressions(t.polls(spark, sf), threshold=0.25)
    src = t.sources(spark, sf).withColumn("adapter", F.concat(
        F.lit("adapter-"), (F.regexp_extract("adapter_tenant", r"(\d+)", 1).cast("int") % 7).cast("string")))
    return health.apply_adapter_health(src, bad).select("source_id", "health_status")


@query("run_summary", f"""
WITH {POLLS} SELECT count(*) AS sources_due, count(*) FILTER (WHERE outcome = 'ok') AS fetched, count(*) FILTER (WHERE outcome = 'not_modified') AS not_modified,
  count(*) FILTER (WHERE outcome = 'error') AS failures FROM polls""")
def run_summary(spark, sf):
    return health.run_summary(t.polls(spark, sf))


@query("run_report", f"""{_UPSERT}, {POLLS}, {GRID}
SELECT (SELECT count(*) FROM polls WHERE outcome = 'ok') AS fetched, (SELECT count(*) FROM polls WHERE outcome = 'error') AS failures,
  (SELECT count(*) FROM merged WHERE NOT a) AS new_jobs, (SELECT count(*) FROM merged WHERE changed_fields <> '') AS updated_jobs,
  (SELECT count(*) FROM st WHERE misses = 4) AS closed, (SELECT count(*) FROM st WHERE hit = 1 AND before >= 2) AS reopened, (SELECT count(*) FROM supplier) AS promoted_boards""")
def run_report(spark, sf):
    old, new = _versions(spark, sf)
    return health.run_report(t.polls(spark, sf), lifecycle.upsert_postings(old, new, t.ts(t.AS_OF)),
                             lifecycle.transitions(t.sightings(spark, sf), t.day_polls(spark, sf)), t.sources(spark, sf)).select(
        "fetched", "failures", "new_jobs", "updated_jobs", "closed", "reopened", "promoted_boards")


@query("next_due", f"""
WITH {SOURCES} SELECT source_id, strftime(TIMESTAMP '2001-12-31' + to_minutes(CASE poll_tier WHEN 'hot' THEN 2 WHEN 'warm' THEN 5 WHEN 'cold' THEN 8 WHEN 'dormant' THEN 20 ELSE 60 END), '%Y-%m-%d %H:%M:%S') AS next_due_at FROM src""")
def next_due(spark, sf):
    s = t.sources(spark, sf).withColumn("next_due_at", health.next_due(t.ts(t.AS_OF), F.col("poll_tier")))
    return s.select("source_id", stamp("next_due_at"))


@query("cap_due", f"""
WITH {SOURCES} SELECT source_id, adapter FROM src WHERE enabled AND health_status <> 'disabled'
ORDER BY CASE WHEN adapter = 'simplify' THEN 0 ELSE 1 END, next_due_at ASC NULLS FIRST, source_id LIMIT 20""")
def cap_due(spark, sf):
    return health.cap_due(t.sources(spark, sf), 20).select("source_id", "adapter")


# --- companies and seeds -----------------------------------------------------------------------------------------
@query("resolve_company", """
WITH have AS (SELECT left(sha256('company|c-' || (c_custkey % 100) || '.example.com'), 16) AS company_id, arg_min(c_name, c_custkey) AS name FROM customer WHERE c_custkey % 100 < 60 GROUP BY 1),
feed AS (SELECT left(sha256('company|c-' || (c_custkey % 100) || '.example.com'), 16) AS company_id, c_custkey % 100 AS g, c_mktsegment AS nm, max(c_custkey) AS last FROM customer GROUP BY ALL),
f AS (SELECT company_id, arg_max(nm, lpad(last::VARCHAR, 12, '0')) AS newest FROM feed GROUP BY company_id),
names AS (SELECT company_id, name AS nm FROM have UNION SELECT company_id, nm FROM feed),
a AS (SELECT company_id, count(*) AS n, string_agg(nm, '|' ORDER BY nm) AS alls FROM names GROUP BY company_id)
SELECT a.company_id, newest AS name, CASE WHEN n > 1 THEN alls ELSE '' END AS aliases, CASE WHEN h.company_id IS NULL THEN 'simplify' ELSE 'greenhouse,simplify' END AS adapters
FROM a JOIN f USING (company_id) LEFT JOIN have h USING (company_id)""")
def resolve_company(spark, sf):
    """customer: a hundred domains; the segment is the employer name a feed gives."""
    c = t.table(spark, sf, "customer")
    dom = F.concat(F.lit("c-"), (F.col("c_custkey") % 100).cast("string"), F.lit(".example.com"))
    now = t.ts(t.AS_OF)
    have = c.where(F.col("c_custkey") % 100 < 60).groupBy(ids.company_id(dom).alias("company_id"), dom.alias("canonical_domain")).agg(
        F.min_by("c_name", "c_custkey").alias("name"))
    no = F.array().cast("array<string>")
    have = have.select("company_id", "name", F.lower("name").alias("normalized_name"), "canonical_domain", no.alias("aliases"), no.alias("careers_urls"),
                       F.array(F.lit("greenhouse")).alias("ats_sources"), now.alias("first_seen_at"), now.alias("last_seen_at"))
    raw = c.select(F.lit("simplify").alias("adapter"), F.lit("x").alias("company_id"), F.lit("Feed").alias("company_name"),
                   F.lpad(F.col("c_custkey").cast("string"), 12, "0").alias("source_job_id"),
                   F.struct(F.col("c_mktsegment").alias("company_name"), F.upper(dom).alias("company_domain")).alias("metadata"))
    return companies.resolve_company(raw, have, now).select(
        "company_id", "name", F.array_join("aliases", "|").alias("aliases"), F.array_join(F.array_sort("ats_sources"), ",").alias("adapters"))


@query("active_count", f"""
WITH {POSTINGS} SELECT company_id, count(*) FILTER (WHERE lifecycle IN ('open', 'reopened')) AS active_job_count, count(*) AS historical_job_count FROM post GROUP BY company_id""")
def active_count(spark, sf):
    o = t.table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("company_id"), t.case(F.col("o_orderstatus"), t.STATES).alias("lifecycle"))
    return companies.active_count(o)


_SEEDS = f"""
WITH {SOURCES}, seed AS (SELECT source_id, CASE WHEN s_suppkey % 3 = 0 THEN 'T2-' || s_suppkey ELSE tenant END AS tenant, dom, adapter, s_suppkey FROM src WHERE s_acctbal < 5000)
"""


def _seeded(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Sources with more than a small balance are known; those below 5000 are seeds, every third with a new tenant."""
    src = t.sources(spark, sf)
    bal = t.table(spark, sf, "supplier").select(F.col("s_name").alias("company_name"), "s_acctbal", "s_suppkey")
    both = src.join(bal, "company_name")
    seeds = both.where(F.col("s_acctbal") < 5000).withColumn("adapter_tenant", F.when(
        F.col("s_suppkey") % 3 == 0, F.concat(F.lit("T2-"), F.col("s_suppkey").cast("string"))).otherwise(F.col("adapter_tenant")))
    seeds = seeds.withColumn("health_status", F.lit("healthy")).withColumn("consecutive_failures", F.lit(0)).withColumn("enabled", F.lit(True))
    return both.where(F.col("s_acctbal") >= 1000).select(*src.columns), seeds.select(*src.columns)


@query("merge_seeds", _SEEDS + """
SELECT source_id, CASE WHEN s.s_acctbal < 1000 THEN 'added' WHEN d.source_id IS NULL THEN 'kept' WHEN d.tenant <> s.tenant THEN 'moved' ELSE 'refreshed' END AS seed_change,
  coalesce(d.tenant, s.tenant) AS adapter_tenant, CASE WHEN s.s_acctbal >= 1000 AND d.tenant IS NOT DISTINCT FROM s.tenant OR d.source_id IS NULL THEN health_status ELSE 'healthy' END AS health_status,
  CASE WHEN d.source_id IS NOT NULL AND (s.s_acctbal < 1000 OR d.tenant <> s.tenant OR health_status <> 'disabled') THEN true ELSE enabled END AS enabled
FROM src s LEFT JOIN seed d USING (source_id) WHERE s.s_acctbal >= 1000 OR d.source_id IS NOT NULL""")
def merge_seeds(spark, sf):
    return companies.merge_seeds(*_seeded(spark, sf)).select("source_id", "seed_change", "adapter_tenant", "health_status", "enabled")


@query("retire_sources", f"""
WITH {SOURCES}, seed AS (SELECT * FROM src WHERE s_acctbal < 5000)
SELECT source_id, v AS variant, CASE WHEN v = 'old' AND s_acctbal < 5000 THEN 'disabled' ELSE health_status END AS health_status,
  CASE WHEN v = 'old' AND s_acctbal < 5000 THEN false ELSE enabled END AS enabled
FROM (SELECT source_id, 'own' AS v, s_acctbal, health_status, enabled FROM src UNION ALL SELECT 'old-' || source_id, 'old', s_acctbal, health_status, enabled FROM src)""")
def retire_sources(spark, sf):
    """Every source also exists as an old variant of the same domain."""
    src = t.sources(spark, sf)
    bal = t.table(spark, sf, "supplier").select(F.col("s_name").alias("company_name"), "s_acctbal")
    seeds = src.join(bal.where(F.col("s_acctbal") < 5000), "company_name", "left_semi")
    every = src.withColumn("variant", F.lit("own")).unionByName(
        src.withColumn("source_id", F.concat(F.lit("old-"), "source_id")).withColumn("variant", F.lit("old")))
    return companies.retire_sources(every, seeds).select("source_id", "variant", "health_status", "enabled")


# --- streaming ------------------------------------------------------------------------------------------------------
def land(spark: SparkSession, sf: str, folder: str) -> Iterator[None]:
    """events as landed snapshots, a third of the month at a time; a stream follows each before the next one lands."""
    rows = t.sightings(spark, sf).select("source_id", "poll_ts", F.lit("ok").alias("outcome"), "posting_id", F.sha2("posting_id", 256).alias("content_hash"))
    for low, high in (("2000-01-01", "2024-01-11"), ("2024-01-11", "2024-01-21"), ("2024-01-21", "2100-01-01")):
        rows.where((F.col("poll_ts") >= low) & (F.col("poll_ts") < high)).write.mode("append").parquet(folder)
        yield


@query("track_stream", f"""
WITH {GRID}, back AS (SELECT source_id, posting_id, max(d) AS reopened_at, count(*) AS times FROM st WHERE hit = 1 AND before >= 2 GROUP BY ALL),
now AS (SELECT source_id, posting_id, arg_max(misses, d) AS miss_count, arg_max(state, d) AS state FROM st GROUP BY ALL)
SELECT n.source_id, n.posting_id, n.miss_count, n.state, {_ts('b.reopened_at', 'reopened_at')}, coalesce(b.times, 0) AS times_reopened
FROM now n LEFT JOIN back b USING (source_id, posting_id)""")
def track_stream(spark, sf):
    """The incremental run over three landed batches, one micro-batch each."""
    root = scratch_folder(spark, "track")
    for _ in land(spark, sf, f"{root}/landing"):
        track.track_stream(spark, f"{root}/landing", f"{root}/state", f"{root}/offsets").awaitTermination()
    return track.current_lifecycle(track.read_tracked(spark, f"{root}/state")).select(
        "source_id", "posting_id", "miss_count", "state", stamp("reopened_at"), "times_reopened")


@query("track_split_polls", f"""
WITH {GRID}, back AS (SELECT source_id, posting_id, max(d) AS reopened_at, count(*) AS times FROM st WHERE hit = 1 AND before >= 2 GROUP BY ALL),
now AS (SELECT source_id, posting_id, arg_max(misses, d) AS miss_count, arg_max(state, d) AS state FROM st GROUP BY ALL)
SELECT n.source_id, n.posting_id, n.miss_count, n.state, {_ts('b.reopened_at', 'reopened_at')}, coalesce(b.times, 0) AS times_reopened, 0 AS late
FROM now n LEFT JOIN back b USING (source_id, posting_id)""")
def track_split_polls(spark, sf):
    """Every poll's rows come in two batches; the second ones find the numbers of their polls."""
    rows = t.sightings(spark, sf).select("source_id", "poll_ts", F.lit("ok").alias("outcome"), "posting_id", F.sha2("posting_id", 256).alias("content_hash"))
    state = track.empty_state(spark)
    half = F.pmod(F.xxhash64("posting_id"), F.lit(2))
    for low, high in (("2000-01-01", "2024-01-16"), ("2024-01-16", "2100-01-01")):
        for part in (0, 1):
            polls = rows.select("source_id", "poll_ts", "outcome").distinct().withColumns({"posting_id": F.lit(None).cast("string"), "content_hash": F.lit(None).cast("string")})
            batch = rows.where(half == part).unionByName(polls).where((F.col("poll_ts") >= low) & (F.col("poll_ts") < high))
            state = {k: durable(v) for k, v in track.apply_batch(state, batch).items()}
    return track.current_lifecycle(state).select("source_id", "posting_id", "miss_count", "state", stamp("reopened_at"), "times_reopened") \
        .withColumn("late", F.lit(state["sightings"].join(state["polls"], ["source_id", "poll_ts"], "left_anti").count()))


@query("track_late_polls", f"""
WITH {GRID}, back AS (SELECT source_id, posting_id, max(d) AS reopened_at, count(*) AS times FROM st WHERE hit = 1 AND before >= 2 GROUP BY ALL),
now AS (SELECT source_id, posting_id, arg_max(misses, d) AS miss_count, arg_max(state, d) AS state FROM st GROUP BY ALL)
SELECT n.source_id, n.posting_id, n.miss_count, n.state, {_ts('b.reopened_at', 'reopened_at')}, coalesce(b.times, 0) AS times_reopened
FROM now n LEFT JOIN back b USING (source_id, posting_id)""")
def track_late_polls(spark, sf):
    """Polls land in random order: four batches chosen by a hash of source and poll, so that most polls come after later ones."""
    root = scratch_folder(spark, "late")
    rows = t.sightings(spark, sf).select("source_id", "poll_ts", F.lit("ok").alias("outcome"), "posting_id", F.sha2("posting_id", 256).alias("content_hash"))
    for part in range(4):
        rows.where(F.pmod(F.xxhash64("source_id", "poll_ts"), F.lit(4)) == part).write.mode("append").parquet(f"{root}/landing")
        track.track_stream(spark, f"{root}/landing", f"{root}/state", f"{root}/offsets").awaitTermination()
    return track.current_lifecycle(track.read_tracked(spark, f"{root}/state")).select(
        "source_id", "posting_id", "miss_count", "state", stamp("reopened_at"), "times_reopened")


@query("run_events", _UPSERT + """, s AS (SELECT o_orderkey, job_id, title, h, o_orderstatus FROM old), n AS (SELECT job_id, h2 FROM new)
SELECT n.job_id, 'OPENED' AS event_type, '' AS previous_hash, h2 AS new_hash FROM n LEFT JOIN s USING (job_id) WHERE s.job_id IS NULL
UNION ALL SELECT job_id, 'UPDATED', h, h2 FROM n JOIN s USING (job_id) WHERE h <> h2
UNION ALL SELECT job_id, 'CLOSED', h, h FROM s LEFT JOIN n USING (job_id) WHERE n.job_id IS NULL AND o_orderkey % 2 = 0
UNION ALL SELECT job_id, 'REOPENED', h, h2 FROM n JOIN s USING (job_id) WHERE o_orderkey % 3 = 0""")
def run_events(spark, sf):
    """State before a run (a third of the kept rows closed) against the state after it: all four kinds of events."""
    old, new = _versions(spark, sf)
    number = t.table(spark, sf, "orders").select(F.sha2(F.concat(F.lit("orders:tpch:"), F.col("o_orderkey").cast("string")), 256).alias("job_id"), "o_orderkey")
    cols = ["job_id", "content_hash", "first_seen_at", "lifecycle", F.lit(None).cast("timestamp").alias("closed_at"), F.lit(None).cast("timestamp").alias("reopened_at")]
    gone = old.join(new, "job_id", "left_anti").join(number, "job_id")
    kept = old.join(new.select("job_id"), "job_id").join(number, "job_id").withColumn("lifecycle", F.when(F.col("o_orderkey") % 3 == 0, "closed").otherwise("open"))
    before = kept.select(*cols).unionByName(gone.withColumn("lifecycle", F.lit("open")).select(*cols))
    after = new.withColumn("lifecycle", F.lit("open")).select(*cols).unionByName(
        gone.withColumn("lifecycle", F.when(F.col("o_orderkey") % 2 == 0, "closed").otherwise("suspected_closed")).select(*cols))
    return lifecycle.run_events(before, after, t.ts(t.AS_OF)).select("job_id", "event_type", F.coalesce("previous_hash", F.lit("")).alias("previous_hash"), "new_hash")


@query("lifecycle_stream", f"""
WITH {GRID} SELECT source_id, posting_id, 'suspected_closed' AS state, {_ts('d', 'at')} FROM st WHERE misses = 2
UNION ALL SELECT source_id, posting_id, 'closed', {_ts('d', 'at')} FROM st WHERE misses = 4
UNION ALL SELECT source_id, posting_id, 'reopened', {_ts('d', 'at')} FROM st WHERE hit = 1 AND before >= 2
UNION ALL SELECT source_id, posting_id, 'open', {_ts('min(d)', 'at')} FROM st GROUP BY source_id, posting_id""")
def lifecycle_stream(spark, sf):
    """Every state change as a stateful stream emits it."""
    root = scratch_folder(spark, "lifecycle")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for _ in land(spark, sf, f"{root}/landing"):
            rows = spark.readStream.schema(track.LANDING).parquet(f"{root}/landing")
            q = (
                track.lifecycle_changes(rows, parts=4).writeStream.outputMode("update").foreachBatch(
                    lambda b, n: b.write.mode("append").parquet(f"{root}/out")))
            q.option("checkpointLocation", f"{root}/offsets").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.parquet(f"{root}/out").select("source_id", "posting_id", "state", stamp("at"))


@query("arrivals", "SELECT event_type AS posting_id FROM events GROUP BY event_type")
def arrivals(spark, sf):
    root = scratch_folder(spark, "arrivals")
    for _ in land(spark, sf, f"{root}/landing"):
        rows = spark.readStream.schema(track.LANDING).parquet(f"{root}/landing")
        track.arrivals_stream(rows).select("posting_id").writeStream.format("parquet").option("path", f"{root}/out") \
            .option("checkpointLocation", f"{root}/offsets").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out")
