"""Bindings of discovery on links made from the page URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantic.bindings import tables as t
from vacantic.bindings.registry import LINKS, SOURCES, query
from vacantic.functions import urls
from vacantic.operators import discovery

_HOST = "lower(regexp_extract(url, '^https?://([^/?#]+)', 1))"
_VALID = f"""
WITH {LINKS}, cand AS (SELECT *, {_HOST} AS dom, CASE WHEN page_id % 10 = 8 THEN 0 WHEN page_id % 10 = 7 THEN 0.5 WHEN page_id % 10 = 9 THEN 0.55 WHEN page_id % 10 = 3 THEN 0.8 ELSE 0.85 END::DOUBLE AS conf FROM found),
val AS (SELECT *, CASE WHEN page_id % 10 = 8 THEN 'aggregator_denylist' WHEN page_id % 10 = 7 THEN 'below_promotion_threshold' ELSE 'accepted' END AS reason,
  CASE WHEN tenant IS NOT NULL THEN left(sha256('source|' || dom || '|' || platform || '|' || tenant), 16) END AS source_id FROM cand),
prom AS (SELECT source_id, max(conf) AS conf, min(url) AS careers_url, any_value(platform) AS adapter, any_value(tenant) AS tenant, any_value(dom) AS dom FROM val
  WHERE reason = 'accepted' AND source_id IS NOT NULL GROUP BY source_id)
"""
NOW = t.AS_OF


def _valid(spark: SparkSession, sf: str) -> DataFrame:
    return discovery.validate_candidates(t.board_links(spark, sf).select("page_id", "url"))


@query("detect_platform", f"""
WITH {LINKS} SELECT page_id, platform, tenant, 0.95::DOUBLE AS confidence, platform <> 'teamtailor' AS supported,
  coalesce(CASE platform WHEN 'greenhouse' THEN 'https://boards.greenhouse.io/' || tenant WHEN 'lever' THEN 'https://jobs.lever.co/' || tenant WHEN 'ashby' THEN 'https://jobs.ashbyhq.com/' || tenant
    WHEN 'smartrecruiters' THEN 'https://careers.smartrecruiters.com/' || tenant WHEN 'workable' THEN 'https://apply.workable.com/' || tenant END, '') AS careers_url
FROM found WHERE platform IS NOT NULL""")
def detect_platform(spark, sf):
    df = t.board_links(spark, sf).select("page_id", urls.detect_platform(F.col("url")).alias("d")).where(F.col("d").isNotNull())
    return df.select("page_id", "d.platform", "d.tenant", "d.confidence", "d.supported", F.coalesce("d.careers_url", F.lit("")).alias("careers_url"))


@query("detect_platform_html", f"""
WITH {LINKS} SELECT page_id, CASE WHEN page_id % 10 < 8 THEN platform WHEN page_id % 3 = 0 THEN 'json_ld' ELSE '' END AS platform,
  CASE WHEN page_id % 10 < 8 THEN tenant ELSE '' END AS tenant FROM found""")
def detect_platform_html(spark, sf):
    """The page's first board link, after other links, with punctuation behind it; else a posting in JSON-LD."""
    node = F.when(F.col("page_id") % 3 == 0, F.lit('<script>{"@type": "JobPosting"}</script>')).otherwise(F.lit(""))
    html = F.concat(F.col("html"), F.lit(" https://example.org/x?u=jobs.lever.co "), node, F.lit(" (see "), F.col("url"), F.lit(").</p>"))
    df = t.board_links(spark, sf).select("page_id", urls.detect_platform_page(None, html).alias("d"))
    return df.select("page_id", F.coalesce("d.platform", F.lit("")).alias("platform"), F.coalesce("d.tenant", F.lit("")).alias("tenant"))


@query("score_candidates", f"""
WITH {LINKS} SELECT page_id, CASE WHEN page_id % 13 = 0 THEN 1.0 ELSE least(1.0, round(greatest(0.3 + (page_id % 6) / 10.0, CASE WHEN tenant IS NOT NULL THEN 0.8 ELSE 0 END,
  CASE WHEN page_id % 4 = 0 THEN 0.7 ELSE 0 END) + CASE WHEN url LIKE 'https:%' THEN 0.05 ELSE 0 END, 3)) END::DOUBLE AS confidence FROM found""")
def score_candidates(spark, sf):
    p = t.board_links(spark, sf).select("page_id", "url")
    d = urls.detect_platform(F.col("url"))
    df = p.select("page_id", "url", d["platform"].alias("platform"), d["tenant"].alias("tenant"), (F.lit(0.3) + (F.col("page_id") % 6) / 10.0).alias("base_confidence"),
                  (F.col("page_id") % 4 == 0).alias("has_json_ld"), (F.col("page_id") % 13 == 0).alias("is_seed"))
    return discovery.score_candidates(df).select("page_id", "confidence")


@query("validate_candidates", _VALID + """
SELECT page_id, reason = 'accepted' AS accepted, reason, conf AS confidence, CASE WHEN page_id % 10 < 8 THEN platform ELSE '' END AS adapter, dom AS company_domain, coalesce(source_id, '') AS source_id,
  CASE page_id % 10 WHEN 8 THEN 'Domain www.linkedin.com is denylisted' WHEN 7 THEN 'ATS platform teamtailor is not fully supported' ELSE '' END AS issues FROM val""")
def validate_candidates(spark, sf):
    return _valid(spark, sf).select("page_id", "accepted", "reason", "confidence", F.coalesce("adapter", F.lit("")).alias("adapter"), "company_domain",
                                    F.coalesce("source_id", F.lit("")).alias("source_id"), F.array_join("issues", "; ").alias("issues"))


def _known(spark: SparkSession, sf: str) -> DataFrame:
    """Boards of the English pages are known already, disabled and degraded."""
    english = _valid(spark, sf).where(F.col("url").contains("/en/"))
    found = discovery.promotable(english, "crawl", t.ts(NOW))
    return found.withColumn("discovery_confidence", F.lit(0.9)).withColumn("enabled", F.lit(False)).withColumn("health_status", F.lit("degraded")) \
        .withColumn("consecutive_failures", F.lit(5)).unionByName(t.sources(spark, sf).select(*found.columns))


_KNOWN = """, known AS (SELECT DISTINCT source_id FROM val WHERE reason = 'accepted' AND source_id IS NOT NULL AND contains(url, '/en/'))"""


@query("already_tracked", _VALID + _KNOWN + "SELECT page_id, source_id FROM val WHERE source_id IS NOT NULL AND source_id NOT IN (SELECT source_id FROM known)")
def already_tracked(spark, sf):
    return discovery.already_tracked(_valid(spark, sf).where(F.col("source_id").isNotNull()), _known(spark, sf)).select("page_id", "source_id")


@query("promote", f"""{_VALID}{_KNOWN}, {SOURCES}
SELECT source_id, CASE WHEN source_id IN (SELECT source_id FROM known) THEN 'refreshed' ELSE 'promoted' END AS promotion,
  CASE WHEN source_id IN (SELECT source_id FROM known) THEN greatest(conf, 0.9) ELSE conf END AS confidence, true AS enabled, 'healthy' AS health_status FROM prom
UNION ALL SELECT source_id, 'kept', 0.6, enabled, health_status FROM src""")
def promote(spark, sf):
    return discovery.promote_sources(_valid(spark, sf), _known(spark, sf), "crawl", t.ts(NOW)).select(
        "source_id", "promotion", F.col("discovery_confidence").alias("confidence"), "enabled", "health_status")


@query("promote_companies", _VALID + """
SELECT left(sha256('company|' || d), 16) AS company_id, d AS canonical_domain, count(DISTINCT careers_url) AS careers, string_agg(DISTINCT adapter, ',' ORDER BY adapter) AS adapters
FROM (SELECT *, regexp_replace(dom, '^www\\.', '') AS d FROM prom) GROUP BY d""")
def promote_companies(spark, sf):
    none = spark.createDataFrame([], "company_id string, name string, normalized_name string, canonical_domain string, careers_urls array<string>, ats_sources array<string>, "
                                     "first_seen_at timestamp, last_seen_at timestamp")
    return discovery.promote_companies(_valid(spark, sf), none, "crawl", t.ts(NOW)).select(
        "company_id", "canonical_domain", F.size("careers_urls").cast("long").alias("careers"), F.array_join("ats_sources", ",").alias("adapters"))


_BOARDS = f"""
WITH {LINKS}, b AS (SELECT *, lower(site) || '.com' AS dom FROM found WHERE platform IN ('greenhouse', 'lever', 'ashby')),
ids AS (SELECT DISTINCT left(sha256('source|' || dom || '|' || platform || '|' || tenant), 16) AS source_id, dom, platform, tenant, page_id % 2 = 0 AS even FROM b)
"""


def _applied(spark: SparkSession, sf: str) -> DataFrame:
    return t.board_links(spark, sf).select("page_id", F.col("url").alias("apply_url"), F.col("site").alias("company_name"),
                                           F.when(F.col("page_id") % 4 == 0, F.lit("www.lever.co")).alias("company_domain"))


def _tracked(spark: SparkSession, sf: str) -> DataFrame:
    """Boards behind links with an even page id are tracked already."""
    return discovery.promotable(discovery.boards_from_postings(_applied(spark, sf).where(F.col("page_id") % 2 == 0)), "simplify", t.ts(NOW))


@query("promote_from_postings", _BOARDS + """
SELECT DISTINCT source_id, dom AS company_domain, platform AS adapter, tenant AS adapter_tenant, 0.9::DOUBLE AS confidence, 'hot' AS poll_tier FROM ids
WHERE source_id NOT IN (SELECT source_id FROM ids WHERE even)""")
def promote_from_postings(spark, sf):
    return discovery.promote_from_postings(_applied(spark, sf), _tracked(spark, sf), t.ts(NOW)).select(
        "source_id", "company_domain", "adapter", "adapter_tenant", F.col("discovery_confidence").alias("confidence"), "poll_tier")


@query("promotion_feedback", _BOARDS + """
SELECT source_id, NOT bool_or(even) AS found_in_run FROM ids GROUP BY source_id""")
def promotion_feedback(spark, sf):
    return discovery.promotion_feedback(_applied(spark, sf), _tracked(spark, sf), t.ts(NOW)).select("source_id", "found_in_run")


@query("discovery_counts", _VALID + _KNOWN + """
SELECT CASE WHEN source_id IN (SELECT source_id FROM known) THEN 'already_tracked' WHEN reason = 'accepted' THEN 'promoted' ELSE 'quarantined' END AS outcome, count(*) AS candidates FROM val GROUP BY 1""")
def discovery_counts(spark, sf):
    return discovery.discovery_counts(_valid(spark, sf), _known(spark, sf))


def _rejected(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """An old list with every candidate of the denied hosts, and today's rejects."""
    v = _valid(spark, sf)
    old = discovery.quarantine_rows(v.where(F.col("reason") == "aggregator_denylist"), "crawl", F.timestamp_seconds(F.lit(1000000000) + F.col("page_id")))
    new = discovery.quarantine_rows(v.where(F.col("reason") == "below_promotion_threshold"), "search", F.timestamp_seconds(F.lit(1000000000) + F.col("page_id")))
    return old, new.unionByName(old.withColumn("quarantined_at", F.timestamp_micros(F.unix_micros("quarantined_at") - 1000000)))


_QUAR = _VALID + """, q AS (SELECT url, arg_max(reason, page_id) AS reason, max(page_id) AS page_id FROM val WHERE reason <> 'accepted' GROUP BY url)"""


@query("quarantine", _QUAR + "SELECT url, reason, epoch(make_timestamp((1000000000 + page_id) * 1000000))::BIGINT AS at FROM q")
def quarantine(spark, sf):
    return discovery.quarantine(*_rejected(spark, sf)).select("url", "reason", F.unix_seconds("quarantined_at").alias("at"))


@query("latest_n_by_url", _QUAR + "SELECT url, reason FROM q ORDER BY page_id DESC, url LIMIT 20")
def latest_n_by_url(spark, sf):
    return discovery.latest_n_by_url(*_rejected(spark, sf), n=20).select("url", "reason")
