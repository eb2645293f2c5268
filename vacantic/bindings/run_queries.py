"""Bindings of the whole incremental run: customers are postings, nations are boards, one nation is a listing feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantic.bindings import tables as t
from vacantic.bindings.registry import query
from vacantic.functions import ids
from vacantic.plans.publish import scratch_folder
from vacantic.plans.state import read_appended, read_table
from vacantic.streaming import run

FEED, RUNS, PAGE = 24, 6, 400
# which of the six runs list a customer, by c_custkey % 8
_LISTED = {0: "true", 1: "k = 0", 2: "k IN (0, 1, 5)", 3: "k IN (0, 5)", 4: "true", 5: "k >= 3", 6: "k % 2 = 0", 7: "true"}
_LIST_SQL = "CASE c_custkey % 8 " + " ".join(f"WHEN {c} THEN {rule}" for c, rule in _LISTED.items()) + " END"
_OUTCOME = "CASE WHEN {n} % 6 = 1 AND k = 2 OR {n} % 6 = 3 AND k IN (1, 2, 3) THEN 'error' WHEN {n} % 6 = 2 AND k = 1 THEN 'not_modified' ELSE 'ok' END"
_TITLE = "CASE WHEN c_custkey % 8 = 4 AND k >= 2 THEN 'Lead ' ELSE '' END || c_mktsegment || ' analyst'"


def _time(k: Column) -> Column:
    return F.timestamp_seconds(F.lit(1704067200) + k * 3600)


def landed_polls(spark: SparkSession, sf: str) -> DataFrame:
    """Six runs over all customers: a board per nation, one of them a feed that names employers, and ten of those employers' own boards."""
    c = t.table(spark, sf, "customer").join(F.broadcast(spark.range(RUNS).select(F.col("id").alias("k"))))
    e = (F.col("c_custkey") % 40).cast("string")
    c = c.select("*", F.expr(_LIST_SQL).alias("listed"), F.expr(_TITLE).alias("title"), e.alias("e"), F.col("c_custkey").cast("string").alias("key"))
    employer, tenant = F.concat(F.lit("Employer "), "e"), F.concat(F.lit("t"), "e")
    url = F.concat(F.lit("https://boards.greenhouse.io/"), tenant, F.lit("/jobs/"), "key")

    def job(ident: Column) -> Column:
        return F.when(F.col("listed"), F.struct(
            ident.alias("id"), F.col("title"), F.concat(F.lit("https://jobs.example.com/"), ident).alias("absolute_url"),
            F.struct(F.col("c_name").alias("name")).alias("location"), F.lit("<p>Work with data</p>").alias("content")))

    def pages(rows: DataFrame, source: dict[str, Column], outcome: Column, payload: Column) -> DataFrame:
        return rows.groupBy(*[v.alias(n) for n, v in source.items()], "k", outcome.alias("outcome"), F.floor(F.col("c_custkey") / PAGE).alias("page")).agg(
            payload.alias("payload")).withColumn("payload", F.when(F.col("outcome") == "ok", F.col("payload")))

    n = F.col("c_nationkey").cast("string")
    nation = {"source_id": F.concat(F.lit("nation-"), n), "company_id": F.concat(F.lit("c-"), n), "company_name": F.concat(F.lit("Nation "), n),
              "adapter": F.when(n == str(FEED), "simplify").otherwise("greenhouse"), "adapter_tenant": F.concat(F.lit("n"), n),
              "careers_url": F.concat(F.lit("https://nation-"), n, F.lit(".example.com/careers"))}
    outcome = F.expr(_OUTCOME.format(n="c_nationkey"))
    boards = pages(c.where(F.col("c_nationkey") != FEED), nation, outcome, F.to_json(F.struct(F.collect_list(job(F.col("key"))).alias("jobs"))))
    row = F.when(F.col("listed"), F.struct(F.col("key").alias("id"), F.col("title"), employer.alias("company_name"), url.alias("url")))
    feed = pages(c.where(F.col("c_nationkey") == FEED), nation, outcome, F.to_json(F.collect_list(row)))
    domain = F.concat(F.lit("employer-"), "e", F.lit(".com"))
    own = {"source_id": ids.source_id(domain, F.lit("greenhouse"), tenant), "company_id": ids.company_id(domain), "company_name": employer,
           "adapter": F.lit("greenhouse"), "adapter_tenant": tenant, "careers_url": F.concat(F.lit("https://"), domain, F.lit("/careers"))}
    direct = pages(c.where((F.col("c_nationkey") == FEED) & (F.col("c_custkey") % 40 < 10) & (F.col("k") >= 2)), own, F.lit("ok"),
                   F.to_json(F.struct(F.collect_list(job(F.concat(F.lit("b"), "key"))).alias("jobs"))))
    every = boards.unionByName(feed).unionByName(direct)
    return every.select(*nation, _time(F.col("k")).alias("fetched_at"), "outcome", "payload", F.lit(None).cast("string").alias("page_url"), _time(F.col("k")).alias("run_at"))


def _hours(c: Column | str) -> Column:
    return ((F.unix_seconds(c) - 1704067200) / 3600).cast("int").cast("string")


_RUN_SQL = f"""
WITH runs AS (SELECT unnest(range({RUNS})) AS k),
job AS (
  SELECT c_custkey, c_mktsegment, 'nation-' || c_nationkey AS src, c_nationkey AS n, 0 AS from_k,
    CASE WHEN c_nationkey = {FEED} THEN 'simplify:n{FEED}:' || c_custkey ELSE 'greenhouse:n' || c_nationkey || ':' || c_custkey END AS ident,
    CASE WHEN c_nationkey = {FEED} THEN left(sha256('company|employer-' || c_custkey % 40 || '.com'), 16) ELSE 'c-' || c_nationkey END AS company_id FROM customer
  UNION ALL SELECT c_custkey, c_mktsegment, left(sha256('source|employer-' || c_custkey % 40 || '.com|greenhouse|t' || c_custkey % 40), 16), 0, 2,
    'greenhouse:t' || c_custkey % 40 || ':b' || c_custkey, left(sha256('company|employer-' || c_custkey % 40 || '.com'), 16)
  FROM customer WHERE c_nationkey = {FEED} AND c_custkey % 40 < 10),
poll AS (SELECT job.*, k, ({_LIST_SQL})::INT AS hit, {_TITLE} AS title FROM job JOIN runs ON k >= from_k WHERE {_OUTCOME.format(n='n')} = 'ok'),
grid AS (SELECT * FROM poll JOIN (SELECT ident, min(k) AS f FROM poll WHERE hit = 1 GROUP BY ident) USING (ident) WHERE k >= f),
isl AS (SELECT *, sum(hit) OVER (PARTITION BY ident ORDER BY k) AS g FROM grid),
m AS (SELECT *, sum(1 - hit) OVER (PARTITION BY ident, g ORDER BY k)::BIGINT AS misses FROM isl),
st AS (SELECT *, lag(misses) OVER (PARTITION BY ident ORDER BY k) AS before, lag(title) OVER (PARTITION BY ident, hit ORDER BY k) AS old_title FROM m),
ev AS (SELECT ident, k, 'OPENED' AS e FROM st WHERE k = f UNION ALL SELECT ident, k, 'CLOSED' FROM st WHERE misses = 4
  UNION ALL SELECT ident, k, 'REOPENED' FROM st WHERE hit = 1 AND before >= 2 UNION ALL SELECT ident, k, 'UPDATED' FROM st WHERE hit = 1 AND old_title <> title),
evs AS (SELECT ident, string_agg(e || '@' || k, ',' ORDER BY k, e) AS events FROM ev GROUP BY ident),
now AS (SELECT ident, src, company_id, f, max(k) FILTER (WHERE hit = 1) AS last_k, arg_max(title, k) FILTER (WHERE hit = 1) AS title, arg_max(misses, k) AS misses,
    max(k) FILTER (WHERE misses = 4) AS closed_k, max(k) FILTER (WHERE hit = 1 AND before >= 2) AS reopened_k FROM st GROUP BY ALL),
life AS (SELECT *, CASE WHEN misses >= 4 THEN 'closed' WHEN misses >= 2 THEN 'suspected_closed' ELSE 'open' END AS state FROM now),
feed AS (SELECT c_custkey % 40 AS e, min(f) AS f FROM life JOIN job USING (ident) WHERE life.src = 'nation-{FEED}' GROUP BY ALL),
company AS (SELECT 'c-' || c_nationkey AS company_id, 'Nation ' || c_nationkey AS name FROM customer GROUP BY ALL
  UNION ALL SELECT left(sha256('company|employer-' || e || '.com'), 16), 'Employer ' || e FROM feed
  UNION ALL SELECT DISTINCT left(sha256('company|employer-' || c_custkey % 40 || '.com'), 16), 'Employer ' || c_custkey % 40 FROM customer
    WHERE c_nationkey = {FEED} AND c_custkey % 40 < 10 AND c_custkey % 40 NOT IN (SELECT e FROM feed))
SELECT 'posting' AS kind, sha256(ident) AS id, concat_ws(' ', company_id, title, state, misses, f, last_k, 'closed', CASE WHEN state = 'closed' THEN closed_k END, 'reopened', reopened_k, events) AS detail
FROM life JOIN evs USING (ident)
UNION ALL SELECT 'company', company.company_id, name || ' ' || count(l.ident) FROM company LEFT JOIN life l ON l.company_id = company.company_id AND state = 'open' GROUP BY company.company_id, name
UNION ALL SELECT 'source', 'nation-' || c_nationkey, 'landing healthy 0 true ' || max(CASE WHEN c_nationkey % 6 = 3 THEN 3 WHEN c_nationkey % 6 = 1 THEN 2 ELSE -1 END) FROM customer GROUP BY c_nationkey
UNION ALL SELECT 'source', left(sha256('source|employer-' || e || '.com|greenhouse|t' || e), 16), CASE WHEN e < 10 AND f > 2 THEN 'landing' ELSE 'simplify' END || ' healthy 0 true -1' FROM feed
UNION ALL SELECT DISTINCT 'source', left(sha256('source|employer-' || c_custkey % 40 || '.com|greenhouse|t' || c_custkey % 40), 16), 'landing healthy 0 true -1' FROM customer
  WHERE c_nationkey = {FEED} AND c_custkey % 40 < 10 AND c_custkey % 40 NOT IN (SELECT e FROM feed)
UNION ALL SELECT 'run', k::VARCHAR, concat_ws(' ', (SELECT count(*) FROM ev WHERE ev.k = runs.k AND e = 'OPENED'), (SELECT count(*) FROM ev WHERE ev.k = runs.k AND e = 'UPDATED'),
  (SELECT count(*) FROM ev WHERE ev.k = runs.k AND e = 'CLOSED'), (SELECT count(*) FROM ev WHERE ev.k = runs.k AND e = 'REOPENED'),
  (SELECT count(DISTINCT c_nationkey) FROM customer WHERE {_OUTCOME.format(n='c_nationkey')} = 'error'),
  (SELECT count(*) FROM feed WHERE f = runs.k AND NOT (e < 10 AND f > 2))) FROM runs
"""


@query("track_run", _RUN_SQL)
def track_run(spark, sf):
    """The whole run, three landed batches of two runs each: postings with their events, companies, sources and reports."""
    root = scratch_folder(spark, "runs")
    polls = landed_polls(spark, sf)
    for low in range(0, RUNS, 2):
        polls.where((F.col("run_at") >= _time(F.lit(low))) & (F.col("run_at") < _time(F.lit(low + 2)))).write.mode("append").parquet(f"{root}/landing")
        run.track_runs(spark, f"{root}/landing", f"{root}/state", f"{root}/offsets", buckets=32).awaitTermination()
    state = f"{root}/state"
    events = read_appended(spark, state, "events").groupBy("job_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("at", "event_type"))), lambda e: F.concat(e["event_type"], F.lit("@"), _hours(e["at"]))), ",").alias("events"))
    postings = read_table(spark, state, "postings").join(events, "job_id").select(F.lit("posting").alias("kind"), F.col("job_id").alias("id"), F.concat_ws(
        " ", "company_id", "title", "lifecycle", F.col("miss_count").cast("string"), _hours("first_seen_at"), _hours("last_seen_at"), F.lit("closed"), _hours("closed_at"),
        F.lit("reopened"), _hours("reopened_at"), "events").alias("detail"))
    companies = read_table(spark, state, "companies").select(F.lit("company"), "company_id", F.concat_ws(" ", "name", F.col("active_job_count").cast("string")))
    sources = read_table(spark, state, "sources").select(F.lit("source"), "source_id", F.concat_ws(
        " ", "discovered_via", "health_status", F.col("consecutive_failures").cast("string"), F.col("enabled").cast("string"), F.coalesce(_hours("last_failure_at"), F.lit("-1"))))
    reports = read_appended(spark, state, "runs").select(F.lit("run"), _hours("run_at"), F.concat_ws(
        " ", *[F.col(c).cast("string") for c in ("opened", "updated", "closed", "reopened", "failures", "promoted")]))
    return postings.union(companies).union(sources).union(reports)

