"""Bindings of column functions: text, URLs, ids, times, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantic.bindings import tables as t
from vacantic.bindings.registry import LINKS, POSTINGS, SOURCES, fold_sql, line_sql, plain_sql, query
from vacantic.functions import ids, text, times, urls
from vacantic.operators import companies, search
from vacantic.operators.scale import spread
from vacantic.plans.normalize import employment_type

# SQL of the page cleaning, written from the definition: entities, block ends, tags, blanks, lines
_DECODED = "replace(replace(replace(replace(html, '&amp;', '&'), '&copy;', '©'), '&middot;', '·'), '&quot;', '\"')"


def _strip(c: str) -> str:
    return (f"regexp_replace(regexp_replace({c}, '(?is)</(?:p|div|li|h[1-6]|tr|section|article|br)|<br\\s*/?>', chr(10), 'g'), "
            f"'<[^>]+>', ' ', 'g')")


_PAGE_TEXT = f"""
one AS (SELECT page_id, html, {_strip(_DECODED)} AS a FROM pages),
two AS (SELECT page_id, html, CASE WHEN contains(a, '<') AND contains(a, '>') THEN {_strip("a")} ELSE a END AS b FROM one),
txt AS (SELECT page_id, html, coalesce({plain_sql("regexp_replace(b, '[^\\S\\n]+', ' ', 'g')")}, '') AS plain FROM two)
"""


@query("normalize_ws", f"SELECT doc_id, {line_sql('text')} AS line FROM documents")
def normalize_ws(spark, sf):
    return t.documents(spark, sf).select("doc_id", text.normalize_ws(F.col("text")).alias("line"))


@query("html_to_text", f"WITH {_PAGE_TEXT} SELECT page_id, plain FROM txt")
def html_to_text(spark, sf):
    return spread(t.table(spark, sf, "pages")).select("page_id", text.html_to_text(F.col("html")).alias("plain"))


@query("canonical_text", f"SELECT doc_id, {fold_sql('text')} AS canon FROM documents")
def canonical_text(spark, sf):
    return t.documents(spark, sf).select("doc_id", text.canonical_text(F.col("text")).alias("canon"))


@query("canonical_page_text", f"WITH {_PAGE_TEXT} SELECT page_id, {fold_sql('plain')} AS canon FROM txt")
def canonical_page_text(spark, sf):
    return spread(t.table(spark, sf, "pages")).select("page_id", text.canonical_text(F.col("html")).alias("canon"))


@query("truncate_summary", """
SELECT doc_id, CASE WHEN length(s) <= 2000 THEN s ELSE regexp_replace(regexp_replace(left(s, 1999), '\\s+$', ''), ' [^ ]*$', '') || '…' END AS summary
FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS s FROM documents)""")
def truncate_summary(spark, sf):
    return t.documents(spark, sf).select("doc_id", text.truncate_summary(F.col("text")).alias("summary"))


@query("richest_text", """
SELECT doc_id, CASE WHEN length(text) >= length(other) THEN text ELSE other END AS richest
FROM (SELECT doc_id, text, repeat(source || ' ', 40) AS other FROM documents)""")
def richest_text(spark, sf):
    d = t.documents(spark, sf)
    return d.select("doc_id", text.richest_text(F.col("text"), F.repeat(F.concat("source", F.lit(" ")), F.lit(40))).alias("richest"))


@query("clean_summary", f"""
WITH one AS (SELECT page_id, {_strip("regexp_replace(regexp_replace(html, '(?i)&amp;', '&', 'g'), '(?i)&quot;', chr(34), 'g')")} AS a FROM pages),
two AS (SELECT page_id, CASE WHEN contains(a, '<') AND contains(a, '>') THEN {_strip("regexp_replace(regexp_replace(a, '(?i)&amp;', '&', 'g'), '(?i)&quot;', chr(34), 'g')")} ELSE a END AS b FROM one),
c AS (SELECT page_id, coalesce({plain_sql("b")}, '') AS s FROM two)
SELECT page_id, CASE WHEN (length(s) - length(regexp_replace(s, '[<>&]', '', 'g'))) / greatest(length(s), 1)::DOUBLE > 0.08 THEN '' ELSE s END AS summary FROM c""")
def clean_summary(spark, sf):
    return spread(t.table(spark, sf, "pages")).select("page_id", text.clean_summary(F.col("html")).alias("summary"))


@query("canonical_url", """
SELECT page_id, s || '://' || h || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN q = '' THEN '' ELSE '?' || q END AS canon FROM (
  SELECT page_id, regexp_extract(url, '^(\\w+)', 1) AS s, regexp_extract(url, '^\\w+://([^/?#]+)', 1) AS h,
    regexp_replace('/a%20b' || regexp_extract(url, '^\\w+://[^/?#]+([^?#]*)', 1), '/+$', '') AS p,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1) || '&b=2&a=1', '&'), lambda x: x <> '')), '&') AS q FROM pages)""")
def canonical_url(spark, sf):
    """Messy spelling of every page URL: upper-case host, default port, dot segments, unsorted query."""
    u = F.col("url")
    port = F.when(u.startswith("https"), F.lit(":443")).otherwise(F.lit(":80"))
    messy = F.concat(F.upper(urls.scheme(u)), F.lit("://"), F.upper(urls.authority(u)), port, F.lit("/x/../a b/./"), urls.path(u),
                     F.lit("?"), urls.query(u), F.lit("&b=2&a=1#frag"))
    return t.table(spark, sf, "pages").select("page_id", urls.canonical_url(messy).alias("canon"))


@query("canonical_url_join", """
SELECT page_id, regexp_extract(url, '^\\w+://[^/?#]+', 0) || regexp_replace(regexp_extract(url, '^\\w+://[^/?#]+([^?#]*)', 1), '[^/]*$', '') || 'jobs/1?x=2' AS canon FROM pages""")
def canonical_url_join(spark, sf):
    return t.table(spark, sf, "pages").select("page_id", urls.canonical_http_url(F.lit("./up/../jobs/1?x=2#t"), F.col("url")).alias("canon"))


@query("url_hosts", """
SELECT page_id, regexp_extract(url, '^\\w+://([^/?#]+)', 1) AS host, regexp_replace(regexp_extract(url, '^\\w+://([^/?#]+)', 1), '^www\\.', '') AS domain FROM pages""")
def url_hosts(spark, sf):
    return t.table(spark, sf, "pages").select("page_id", urls.hostname(F.col("url")).alias("host"), urls.domain(F.col("url")).alias("domain"))


@query("slug", "SELECT c_custkey, trim(regexp_replace(lower(c_name || ' / ' || c_mktsegment || '!'), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM customer")
def slug(spark, sf):
    c = t.table(spark, sf, "customer")
    return c.select("c_custkey", ids.slug(F.concat("c_name", F.lit(" / "), "c_mktsegment", F.lit("!"))).alias("slug"))


@query("deterministic_id", """
SELECT o_orderkey, left(sha256('order|' || o_orderkey || '|' || lower(o_orderpriority)), 16) AS short_id, sha256('orders:tpch:' || o_orderkey) AS job_id FROM orders""")
def deterministic_id(spark, sf):
    k = F.col("o_orderkey").cast("string")
    return t.table(spark, sf, "orders").select(
        "o_orderkey", ids.deterministic_id(F.lit(" Order "), k, F.lit(""), F.col("o_orderpriority")).alias("short_id"),
        ids.job_id(F.lit("orders"), F.lit("tpch"), k).alias("job_id"))


@query("bucket", "SELECT o_orderkey, (('0x' || left(sha256(o_orderkey::VARCHAR), 8))::BIGINT % 32)::INT AS bucket FROM orders")
def bucket(spark, sf):
    return t.table(spark, sf, "orders").select("o_orderkey", ids.bucket(F.col("o_orderkey").cast("string")).alias("bucket"))


@query("parse_time", """
SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS iso, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS day,
  strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS ms, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS auto_ms,
  strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS auto_s, '' AS bad FROM events""")
def parse_time(spark, sf):
    e = t.table(spark, sf, "events")
    sec = F.unix_seconds("ts")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    shown = {"iso": times.parse_iso(iso), "day": times.parse_iso(F.date_format("ts", "yyyy-MM-dd")), "ms": times.parse_epoch_ms((sec * 1000).cast("string")),
             "auto_ms": times.parse_epoch_auto((sec * 1000).cast("string")), "auto_s": times.parse_epoch_auto(sec.cast("string")),
             "bad": times.parse_iso(F.col("event_type"))}
    return e.select("event_id", *[F.coalesce(F.date_format(v, "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias(k) for k, v in shown.items()])


@query("employment_type", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'full_time' WHEN '2-HIGH' THEN 'part_time' WHEN '3-MEDIUM' THEN 'contract' ELSE 'unknown' END AS employment FROM orders""")
def employment(spark, sf):
    """The enum mapping, bound to the priorities."""
    mapping = {"1-urgent": "full_time", "2-high": "part_time", "3-medium": "contract"}
    return t.table(spark, sf, "orders").select(
        "o_orderkey", employment_type(text.canonical_text(F.col("o_orderpriority")), mapping).alias("employment"))


@query("posted_at", f"WITH {POSTINGS} SELECT job_id, strftime(posted, '%Y-%m-%d') AS posted FROM post")
def posted_at(spark, sf):
    p = t.postings(spark, sf)
    return p.select("job_id", F.date_format(times.posted_at(F.col("source_posted_at"), F.col("first_seen_at")), "yyyy-MM-dd").alias("posted"))


@query("freshness_tier", """
SELECT event_id, CASE WHEN a < 2 THEN 'hot' WHEN a < 24 THEN 'warm' ELSE 'cool' END AS tier FROM (
  SELECT event_id, least(epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts), epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts) + 3600000000) / 3600000000.0 AS a FROM events)""")
def freshness_tier(spark, sf):
    e = t.table(spark, sf, "events")
    earlier = F.timestamp_micros(F.unix_micros("ts") - 3_600_000_000)
    return e.select("event_id", times.freshness_tier(earlier, F.col("ts"), t.ts(t.EVENTS_AS_OF)).alias("tier"))


@query("project_search", f"""
WITH {POSTINGS} SELECT job_id, company_id, trim(regexp_replace(lower(company_name), '[^a-z0-9]+', '-', 'g'), '-') AS company_slug, lower(title) AS title_lower,
  discipline, lower(concat_ws(', ', country, nullif(raw, ''))) AS location_text, concat_ws(',', CASE WHEN visa THEN 'visa' END, CASE WHEN relocation THEN 'relocation' END,
  CASE WHEN housing THEN 'housing' END, CASE WHEN airfare THEN 'airfare' END) AS flags, (('0x' || left(sha256(job_id), 8))::BIGINT % 32)::INT AS bucket FROM post""")
def project_search(spark, sf):
    return search.project_search(t.postings(spark, sf)).select(
        "job_id", "company_id", "company_slug", "title_lower", "discipline", "location_text", F.array_join("mobility_flags", ",").alias("flags"), "bucket")


@query("company_domain", f"""
WITH {SOURCES}, {LINKS} SELECT page_id, CASE WHEN page_id % 10 = 9 THEN regexp_replace(lower(host), '^www\\.', '') WHEN page_id % 10 = 7 THEN 'teamtailor.com'
  WHEN page_id % 10 = 8 THEN 'linkedin.com'
  WHEN page_id % 10 = 1 THEN 'v1.com' WHEN page_id % 10 IN (0, 2, 3) THEN lower(site) || '.com' ELSE '' END AS domain FROM links""")
def company_domain(spark, sf):
    null = F.lit(None).cast("string")
    rows = t.board_links(spark, sf).select("page_id", F.col("site").alias("company_name"), null.alias("careers_url"), null.alias("source_url"),
                                           F.col("url").alias("job_url"), F.col("url").alias("apply_url"))
    from vacantic.sources.seeds import load_seeds
    out = companies.company_domain(rows, load_seeds(t.seeds_raw(spark, sf)))
    return out.select("page_id", F.coalesce("domain", F.lit("")).alias("domain"))


@query("company_domain_seeded", f"""
WITH {SOURCES} SELECT s_name AS company_name, dom AS domain FROM src""")
def company_domain_seeded(spark, sf):
    from vacantic.sources.seeds import load_seeds
    s = load_seeds(t.seeds_raw(spark, sf))
    null = F.lit(None).cast("string")
    rows = s.select(F.upper("company").alias("company_name"), null.alias("careers_url"), null.alias("source_url"),
                    F.lit("https://example.invalid/nope").alias("job_url"), F.lit("https://example.invalid/nope").alias("apply_url"), "company")
    return companies.company_domain(rows, s).select(F.col("company").alias("company_name"), "domain")


@query("board_tenant", f"""
WITH {LINKS} SELECT page_id, CASE page_id % 10 WHEN 7 THEN 'json_ld' WHEN 8 THEN 'json_ld' WHEN 9 THEN 'json_ld' ELSE platform END AS platform,
  CASE WHEN page_id % 10 = 5 THEN 'acme.wd5.myworkdayjobs.com/' || site WHEN page_id % 10 = 9 THEN lower(regexp_extract(url, '^https://[^/]+/([^/]+)', 1)) ELSE site END AS tenant FROM found""")
def board_tenant(spark, sf):
    return t.board_links(spark, sf).select("page_id", urls.board_tenant(F.col("url")).alias("b")).select("page_id", "b.platform", "b.tenant")


@query("board_url", f"""
WITH {SOURCES} SELECT source_id, CASE adapter WHEN 'greenhouse' THEN 'https://boards-api.greenhouse.io/v1/boards/' || tenant || '/jobs'
  WHEN 'lever' THEN 'https://api.lever.co/v0/postings/' || tenant WHEN 'ashby' THEN 'https://api.ashbyhq.com/posting-api/job-board/' || tenant
  WHEN 'smartrecruiters' THEN 'https://api.smartrecruiters.com/v1/companies/' || tenant || '/postings' WHEN 'workday' THEN 'https://x.wd1.myworkdayjobs.com/wday/cxs/x/' || tenant || '/jobs'
  WHEN 'workable' THEN 'https://apply.workable.com/api/v1/widget/accounts/' || tenant WHEN 'simplify' THEN 'https://raw.githubusercontent.com/SimplifyJobs/' || tenant || '/dev/.github/scripts/listings.json'
  ELSE '' END AS api_url FROM src""")
def board_url(spark, sf):
    s = t.sources(spark, sf)
    tenant = F.when(F.col("adapter") == "workday", F.concat(F.lit("x.wd1.myworkdayjobs.com/"), "adapter_tenant")).otherwise(F.col("adapter_tenant"))
    return s.select("source_id", F.coalesce(urls.board_urls(F.col("adapter"), tenant)["api_url"], F.lit("")).alias("api_url"))


@query("display_location", f"""
WITH {POSTINGS} SELECT job_id, coalesce(country, nullif(raw, ''), 'Location not specified') || CASE WHEN country IS NOT NULL THEN ' +1' ELSE '' END AS shown FROM post""")
def display_location(spark, sf):
    p = t.postings(spark, sf)
    two = F.concat("locations", "locations")
    return p.select("job_id", search.display_location(F.transform(two, lambda x: x.withField("raw", F.nullif(x["raw"], F.lit(""))))).alias("shown"))


@query("discipline_label", """
SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'Promotion' ELSE array_to_string(list_transform(string_split(lower(p_type) || '_' || p_name, '_'),
  lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') END AS label FROM part""")
def discipline_label(spark, sf):
    p = t.table(spark, sf, "part")
    ident = F.when(F.col("p_type") == "PROMO", F.lit("promo")).otherwise(F.concat(F.lower("p_type"), F.lit("_"), "p_name"))
    return p.select("p_partkey", search.discipline_label(ident, {"promo": "Promotion"}).alias("label"))
