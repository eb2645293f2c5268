"""Bindings of the readers. Payloads are built row by row from the tables: one landed response per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantic import rules
from vacantic.bindings import tables as t
from vacantic.bindings.registry import LINKS, POSTINGS, SOURCES, plain_sql, query
from vacantic.operators.scale import spread
from vacantic.plans.publish import scratch_folder
from vacantic.sources import boards, crawl, seeds


def _payloads(df: DataFrame, adapter: str, payload: Column, tenant: str = "acme", page_url: Column | None = None) -> DataFrame:
    cols = [F.lit("s-" + adapter).alias("source_id"), F.lit("c-acme").alias("company_id"), F.lit("Acme").alias("company_name"),
            F.lit(adapter).alias("adapter"), F.lit(tenant).alias("adapter_tenant"), F.lit("https://acme.example.com/careers").alias("careers_url"),
            t.ts(t.AS_OF).alias("fetched_at"), payload.alias("payload")]
    if page_url is not None:
        cols.append(page_url.alias("page_url"))
    return df.select(*cols)


def _iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _show(df: DataFrame, *extra: Column) -> DataFrame:
    return df.select(
        "source_job_id", "title", "job_url", "apply_url", F.array_join("locations_raw", "; ").alias("places"),
        F.coalesce(F.sha2("description_text", 256), F.lit("")).alias("text_hash"), F.coalesce("department", F.lit("")).alias("department"),
        F.coalesce("employment_type", F.lit("")).alias("employment"),
        F.coalesce(F.date_format("posted_at", "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("posted"), *extra)


_DOC_TIME = "strftime(TIMESTAMP '2024-01-01' + to_seconds(doc_id), '%Y-%m-%d %H:%M:%S')"


def _doc_ts() -> Column:
    return F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id"))


def greenhouse_payloads(spark: SparkSession, sf: str) -> DataFrame:
    d = t.documents(spark, sf)
    good = F.struct(
        F.col("doc_id").alias("id"), F.concat(F.lit(" Role "), F.col("doc_id").cast("string")).alias("title"),
        F.concat(F.lit("https://boards.greenhouse.io/acme/jobs/"), F.col("doc_id").cast("string")).alias("absolute_url"),
        F.struct(F.col("source").alias("name")).alias("location"), F.concat(F.lit("<p>"), F.col("text"), F.lit("<br>")).alias("content"),
        F.col("lang").alias("department"), _iso(_doc_ts()).alias("first_published"))
    bad = F.struct(
        F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("title"), F.lit("https://x.example.com").alias("absolute_url"),
        F.struct(F.col("source").alias("name")).alias("location"), F.lit("").alias("content"), F.col("lang").alias("department"),
        F.lit("").alias("first_published"))
    wrapped, bare = F.to_json(F.struct(F.array(good, bad).alias("jobs"))), F.to_json(F.array(good, bad))
    return _payloads(d, "greenhouse", F.when(F.col("doc_id") % 2 == 0, wrapped).otherwise(bare))


@query("ingest_greenhouse", f"""
SELECT doc_id::VARCHAR AS source_job_id, 'Role ' || doc_id AS title, 'https://boards.greenhouse.io/acme/jobs/' || doc_id AS job_url,
  'https://boards.greenhouse.io/acme/jobs/' || doc_id AS apply_url, source AS places, sha256({plain_sql('text')}) AS text_hash,
  lang AS department, '' AS employment, {_DOC_TIME} AS posted FROM documents""")
def ingest_greenhouse(spark, sf):
    return _show(boards.ingest_greenhouse(greenhouse_payloads(spark, sf)))


def lever_payloads(spark: SparkSession, sf: str) -> DataFrame:
    d = t.documents(spark, sf)
    good = F.struct(
        F.concat(F.lit("lv-"), F.col("doc_id").cast("string")).alias("id"), F.concat(F.lit("Role "), F.col("lang")).alias("text"),
        F.concat(F.lit("https://jobs.lever.co/acme/"), F.col("doc_id").cast("string")).alias("hostedUrl"),
        F.struct(F.col("source").alias("location"), F.col("lang").alias("department"), F.lit("Full-time").alias("commitment")).alias("categories"),
        F.col("text").alias("descriptionPlain"), F.col("text").alias("descriptionBodyPlain"), F.col("source").alias("additionalPlain"),
        F.array(F.struct(F.lit("Language").alias("text"), F.col("lang").alias("content"))).alias("lists"),
        (F.unix_micros(_doc_ts()) / 1000).cast("long").alias("createdAt"))
    return _payloads(d, "lever", F.to_json(F.array(good)))


@query("ingest_lever", f"""
SELECT 'lv-' || doc_id AS source_job_id, 'Role ' || lang AS title, 'https://jobs.lever.co/acme/' || doc_id AS job_url,
  'https://jobs.lever.co/acme/' || doc_id AS apply_url, source AS places,
  sha256({plain_sql('text')} || chr(10) || chr(10) || source || chr(10) || chr(10) || 'Language' || chr(10) || lang) AS text_hash,
  lang AS department, 'Full-time' AS employment, {_DOC_TIME} AS posted FROM documents""")
def ingest_lever(spark, sf):
    return _show(boards.ingest_lever(lever_payloads(spark, sf)))


def ashby_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """String and object forms alternate with the size of the text."""
    d = t.documents(spark, sf)
    odd = F.col("n_chars") % 2 == 1
    flat = F.to_json(F.struct(F.array(F.struct(
        F.col("doc_id").cast("string").alias("id"), F.lit("Analyst").alias("title"), F.concat(F.lit("https://a.example.com/"), F.col("doc_id").cast("string")).alias("jobUrl"),
        F.col("source").alias("location"), F.col("lang").alias("department"), F.col("text").alias("descriptionPlain"),
        _iso(_doc_ts()).alias("publishedAt"))).alias("jobs")))
    nested = F.to_json(F.struct(F.array(F.struct(
        F.col("doc_id").cast("string").alias("id"), F.lit("Analyst").alias("title"), F.concat(F.lit("https://a.example.com/"), F.col("doc_id").cast("string")).alias("applyUrl"),
        F.struct(F.col("source").alias("name")).alias("location"), F.struct(F.col("lang").alias("name")).alias("department"),
        F.concat(F.lit("<div>"), F.col("text"), F.lit("<br/>")).alias("descriptionHtml"), _iso(_doc_ts()).alias("publishedAt"))).alias("jobs")))
    return _payloads(d, "ashby", F.when(odd, flat).otherwise(nested))


@query("ingest_ashby", f"""
SELECT doc_id::VARCHAR AS source_job_id, 'Analyst' AS title, 'https://a.example.com/' || doc_id AS job_url, 'https://a.example.com/' || doc_id AS apply_url,
  source AS places, sha256({plain_sql('text')}) AS text_hash, lang AS department, '' AS employment, {_DOC_TIME} AS posted FROM documents""")
def ingest_ashby(spark, sf):
    return _show(boards.ingest_ashby(ashby_payloads(spark, sf)))


def _order_time() -> Column:
    return F.col("o_orderdate").cast("timestamp")


_ORDER_TIME = "strftime(o_orderdate::TIMESTAMP, '%Y-%m-%d %H:%M:%S')"


def smartrecruiters_payloads(spark: SparkSession, sf: str) -> DataFrame:
    o = spread(t.table(spark, sf, "orders"))
    urgent = F.col("o_orderpriority") == "1-URGENT"
    item = F.struct(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("Order "), F.col("o_orderpriority")).alias("name"),
        F.struct(F.lit("Berlin").alias("city"), F.when(urgent, F.lit("BE")).alias("region"), F.lit("Germany").alias("country")).alias("location"),
        F.struct(F.col("o_orderstatus").alias("label")).alias("typeOfEmployment"), F.col("o_orderpriority").alias("department"),
        F.struct(F.concat(F.lit("T"), F.col("o_custkey").cast("string")).alias("identifier")).alias("company"),
        F.when(urgent, F.concat(F.lit("https://p.example.com/"), F.col("o_orderkey").cast("string"))).alias("postingUrl"),
        _iso(_order_time()).alias("releasedDate"))
    return _payloads(o, "smartrecruiters", F.to_json(F.struct(F.lit(1).alias("totalFound"), F.array(item).alias("content"))))


@query("ingest_smartrecruiters", f"""
SELECT o_orderkey::VARCHAR AS source_job_id, 'Order ' || o_orderpriority AS title, url AS job_url, url AS apply_url,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'Berlin, BE, Germany' ELSE 'Berlin, Germany' END AS places, '' AS text_hash,
  o_orderpriority AS department, o_orderstatus AS employment, {_ORDER_TIME} AS posted
FROM (SELECT *, CASE WHEN o_orderpriority = '1-URGENT' THEN 'https://p.example.com/' || o_orderkey
  ELSE 'https://careers.smartrecruiters.com/T' || o_custkey || '/' || o_orderkey END AS url FROM orders)""")
def ingest_smartrecruiters(spark, sf):
    return _show(boards.ingest_smartrecruiters(smartrecruiters_payloads(spark, sf)))


def workday_payloads(spark: SparkSession, sf: str) -> DataFrame:
    o = spread(t.table(spark, sf, "orders"))
    long_bullet = F.repeat(F.lit("long "), F.lit(20))
    item = F.struct(
        F.col("o_orderpriority").alias("title"), F.concat(F.lit("/job/Berlin/R-"), F.col("o_orderkey").cast("string"), F.lit("/")).alias("externalPath"),
        F.lit(" Berlin ").alias("locationsText"), F.array(F.lit("Berlin"), F.col("o_orderstatus"), F.lit("12345"), long_bullet).alias("bulletFields"),
        F.when(F.col("o_orderstatus") == "O", _iso(_order_time())).otherwise(F.lit("Posted 3 Days Ago")).alias("postedOn"))
    return _payloads(o, "workday", F.to_json(F.struct(F.array(item).alias("jobPostings"))), "acme.wd5.myworkdayjobs.com/Careers")


@query("ingest_workday", f"""
SELECT 'R-' || o_orderkey AS source_job_id, o_orderpriority AS title, 'https://acme.wd5.myworkdayjobs.com/Careers/job/Berlin/R-' || o_orderkey || '/' AS job_url,
  'https://acme.wd5.myworkdayjobs.com/Careers/job/Berlin/R-' || o_orderkey || '/' AS apply_url, 'Berlin; ' || o_orderstatus AS places,
  '' AS text_hash, '' AS department, '' AS employment, CASE WHEN o_orderstatus = 'O' THEN {_ORDER_TIME} ELSE '' END AS posted FROM orders""")
def ingest_workday(spark, sf):
    return _show(boards.ingest_workday(workday_payloads(spark, sf)))


def workable_payloads(spark: SparkSession, sf: str) -> DataFrame:
    d = t.documents(spark, sf)
    named = F.col("doc_id") % 3 == 0
    item = F.struct(
        F.concat(F.lit("W"), F.col("doc_id").cast("string")).alias("shortcode"), F.lit("Clerk").alias("title"),
        F.when(named, F.col("lang")).alias("city"), F.when(named, F.col("source")).alias("country"),
        F.array(F.struct(F.col("source").alias("city"))).alias("locations"), F.col("text").alias("full_description"), F.col("lang").alias("department"),
        F.date_format(_doc_ts(), "yyyy-MM-dd").alias("published_on"))
    return _payloads(d, "workable", F.to_json(F.struct(F.array(item).alias("jobs"))))


@query("ingest_workable", f"""
SELECT 'W' || doc_id AS source_job_id, 'Clerk' AS title, 'https://apply.workable.com/acme/j/W' || doc_id || '/' AS job_url,
  'https://apply.workable.com/acme/j/W' || doc_id || '/' AS apply_url, CASE WHEN doc_id % 3 = 0 THEN lang || ', ' || source ELSE source END AS places,
  sha256({plain_sql('text')}) AS text_hash, lang AS department, lang AS employment,
  strftime(date_trunc('day', TIMESTAMP '2024-01-01' + to_seconds(doc_id)), '%Y-%m-%d %H:%M:%S') AS posted FROM documents""")
def ingest_workable(spark, sf):
    return _show(boards.ingest_workable(workable_payloads(spark, sf)))


def jsonld_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """pages with a JSON-LD script added: bare object, list, or member of a graph, by page."""
    p = spread(t.table(spark, sf, "pages"))
    node = F.struct(
        F.lit("JobPosting").alias("@type"), F.concat(F.lit("Page "), F.col("page_id").cast("string")).alias("title"),
        F.struct(F.concat(F.lit("P"), F.col("page_id").cast("string")).alias("value")).alias("identifier"),
        F.concat(F.lit("/roles/"), F.col("page_id").cast("string")).alias("url"), F.lit("2024-05-06").alias("datePosted"),
        F.struct(F.lit("Place").alias("@type"), F.struct(F.lit("Toronto").alias("addressLocality"), F.lit("CA").alias("addressCountry")).alias("address")).alias("jobLocation"),
        F.struct(F.lit("Acme").alias("name")).alias("hiringOrganization"), F.lit("FULL_TIME").alias("employmentType"))
    other = F.to_json(F.struct(F.lit("WebSite").alias("@type"), F.lit("x").alias("title")))
    one = F.to_json(node)
    body = F.when(F.col("page_id") % 3 == 0, one).when(F.col("page_id") % 3 == 1, F.concat(F.lit("["), other, F.lit(","), one, F.lit("]"))) \
        .otherwise(F.concat(F.lit('{"@graph":['), one, F.lit(","), other, F.lit("]}")))
    html = F.concat(F.col("html"), F.lit('<script type="application/ld+json">'), body, F.lit("</script>"))
    return _payloads(p, "json_ld", html, page_url=F.col("url"))


@query("extract_jsonld", """
SELECT 'P' || page_id AS source_job_id, 'Page ' || page_id AS title, o || '/roles/' || page_id AS job_url, o || '/roles/' || page_id AS apply_url,
  'Toronto, CA' AS places, '' AS text_hash, 'Acme' AS department, 'FULL_TIME' AS employment, '2024-05-06 00:00:00' AS posted
FROM (SELECT page_id, regexp_extract(url, '^https?://[^/?#]+', 0) AS o FROM pages)""")
def extract_jsonld(spark, sf):
    return _show(boards.extract_jsonld(jsonld_payloads(spark, sf)))


def listing_payloads(spark: SparkSession, sf: str) -> DataFrame:
    p = t.board_links(spark, sf)
    category = F.when(F.col("page_id") % 4 == 3, F.lit("Cooking")).when(F.col("page_id") % 4 == 2, F.lit("")).otherwise(F.lit("Software"))
    item = F.struct(
        F.concat(F.lit("L"), F.col("page_id").cast("string")).alias("id"), F.lit("Intern").alias("title"), F.col("site").alias("company_name"),
        (F.col("page_id") % 7 != 0).alias("active"), (F.col("page_id") % 11 != 0).alias("is_visible"), category.alias("category"),
        F.col("url"), F.array(F.lit(" Rome ")).alias("locations"), F.array(F.lit("Summer 2026"), F.lit("Fall 2026")).alias("terms"),
        (F.lit(1704067200) + F.col("page_id")).cast("long").alias("date_posted"),
        ((F.lit(1704067200) + F.col("page_id")) * 1000).cast("long").alias("date_updated"), F.lit("Offers Sponsorship").alias("sponsorship"))
    return _payloads(p, "simplify", F.to_json(F.array(item)), "summer2026-internships")


@query("ingest_listing_feed", f"""
WITH {LINKS}
SELECT 'L' || page_id AS source_job_id, 'Intern' AS title, url AS job_url, url AS apply_url, 'Rome' AS places, '' AS text_hash,
  CASE WHEN page_id % 4 = 2 THEN '' ELSE 'Software' END AS department, 'Internship' AS employment,
  strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id), '%Y-%m-%d %H:%M:%S') AS posted,
  CASE WHEN page_id % 10 = 9 THEN regexp_replace(lower(host), '^www\\.', '') WHEN page_id % 10 = 7 THEN 'jobs.teamtailor.com'
    ELSE trim(regexp_replace(lower(site), '[^a-z0-9]+', '-', 'g'), '-') || '.com' END AS employer,
  strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id), '%Y-%m-%d %H:%M:%S') AS updated,
  concat_ws(' — ', 'Intern', site, CASE WHEN page_id % 4 <> 2 THEN 'Software' END, 'Summer 2026 · Fall 2026', 'Offers Sponsorship') AS summary
FROM links WHERE page_id % 7 <> 0 AND page_id % 11 <> 0 AND page_id % 4 <> 3 AND page_id % 10 <> 8""")
def ingest_listing_feed(spark, sf):
    df = boards.ingest_listing_feed(listing_payloads(spark, sf))
    return _show(df, F.col("metadata.company_domain").alias("employer"),
                 F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated"), F.col("summary"))


def all_payloads(spark: SparkSession, sf: str) -> DataFrame:
    made = [greenhouse_payloads, lever_payloads, ashby_payloads, smartrecruiters_payloads, workday_payloads, workable_payloads,
            jsonld_payloads, listing_payloads]
    out = made[0](spark, sf).withColumn("page_url", F.lit(None).cast("string"))
    for m in made[1:]:
        out = out.unionByName(m(spark, sf), allowMissingColumns=True)
    return out


@query("union_sources", """
SELECT 'greenhouse' AS adapter, count(*) AS postings, count(DISTINCT doc_id) AS ids FROM documents UNION ALL
SELECT 'lever', count(*), count(DISTINCT doc_id) FROM documents UNION ALL SELECT 'ashby', count(*), count(DISTINCT doc_id) FROM documents UNION ALL
SELECT 'workable', count(*), count(DISTINCT doc_id) FROM documents UNION ALL
SELECT 'smartrecruiters', count(*), count(DISTINCT o_orderkey) FROM orders UNION ALL SELECT 'workday', count(*), count(DISTINCT o_orderkey) FROM orders UNION ALL
SELECT 'json_ld', count(*), count(DISTINCT page_id) FROM pages UNION ALL
SELECT 'simplify', count(*), count(DISTINCT page_id) FROM pages WHERE page_id % 7 <> 0 AND page_id % 11 <> 0 AND page_id % 4 <> 3 AND page_id % 10 <> 8""")
def union_sources(spark, sf):
    return boards.union_sources(all_payloads(spark, sf)).groupBy("adapter").agg(
        F.count("*").alias("postings"), F.countDistinct("source_job_id").alias("ids"))


# --- seeds, rules, state -----------------------------------------------------------------------------------
@query("load_seeds", f"WITH {SOURCES} SELECT source_id, company_id, s_name AS company, dom AS domain, adapter, tenant FROM src")
def load_seeds(spark, sf):
    return seeds.require_unique_seeds(seeds.load_seeds(t.seeds_raw(spark, sf)))


@query("seed_problems", """
SELECT 'missing_company' AS problem, 0::BIGINT AS entries UNION ALL SELECT 'invalid_domain', 0 UNION ALL SELECT 'unsupported_adapter', 0
UNION ALL SELECT 'invalid_tenant', 0 UNION ALL SELECT 'denied_domain', 0 UNION ALL
SELECT 'duplicate_source', count(*) - count(DISTINCT s_suppkey) FROM supplier""")
def seed_problems(spark, sf):
    return seeds.seed_problems(t.seeds_raw(spark, sf))


@query("seeds_to_dims", f"""
WITH {SOURCES} SELECT company_id, s_name AS name, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '-') AS normalized_name,
  'https://' || dom || '/careers' AS careers_url, source_id, adapter, tenant AS adapter_tenant, 1.0::DOUBLE AS confidence FROM src""")
def seeds_to_dims(spark, sf):
    s = seeds.load_seeds(t.seeds_raw(spark, sf))
    now = t.ts(t.AS_OF)
    comp = seeds.seeds_to_companies(s, now).select("company_id", "name", "normalized_name")
    src = seeds.seeds_to_sources(s, now).select(
        "company_id", "careers_url", "source_id", "adapter", "adapter_tenant", F.col("discovery_confidence").alias("confidence"))
    return comp.join(src, "company_id")


@query("load_rules", """
SELECT o_orderpriority AS label, CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '5-LOW' THEN 'unknown' ELSE 'later' END AS level, count(*) AS orders
FROM orders GROUP BY ALL""")
def load_rules(spark, sf):
    """Rules written out as rows, shuffled, read back and applied: every priority gets its level."""
    stored = rules.RuleSet(career_levels=[("urgent", ["1-URGENT"]), ("later", ["4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH"])], senior_phrases=["5-LOW"])
    back = rules.rule_set_from(rules.load_rules(spark, stored).repartition(7, "pattern"))
    level = {p: k for k, phrases in back.career_levels for p in phrases} | dict.fromkeys(back.senior_phrases, "unknown")
    o = t.table(spark, sf, "orders")
    return o.select(F.col("o_orderpriority").alias("label"), rules.lookup(level, F.col("o_orderpriority")).alias("level")) \
        .groupBy("label", "level").agg(F.count("*").alias("orders"))


@query("read_state", """
SELECT count(*) AS postings, count(DISTINCT o_custkey) AS companies, sum(o_orderkey)::BIGINT AS key_sum FROM orders""")
def read_state(spark, sf):
    from vacantic.plans.publish import save_state
    path = scratch_folder(spark, "state")
    o = t.table(spark, sf, "orders")
    save_state(spark, path, {"postings": o.where(F.col("o_orderstatus") == "F")})
    save_state(spark, path, {"postings": o})
    return seeds.read_state(spark, path)["postings"].agg(
        F.count("*").alias("postings"), F.countDistinct("o_custkey").alias("companies"), F.sum("o_orderkey").alias("key_sum"))


@query("bootstrap_sources", f"""
WITH {SOURCES} SELECT source_id, adapter, 'healthy' AS health_status, 'warm' AS poll_tier, true AS enabled FROM src""")
def bootstrap_sources(spark, sf):
    path = scratch_folder(spark, "no-state")
    df = seeds.load_or_bootstrap(spark, path, seeds.load_seeds(t.seeds_raw(spark, sf)), t.ts(t.AS_OF))
    return df.select("source_id", "adapter", "health_status", "poll_tier", "enabled")


@query("read_buckets", f"""
WITH {POSTINGS}, one AS (SELECT min(job_id) AS a, max(job_id) AS b FROM post)
SELECT job_id, company_id, title, (('0x' || left(sha256(job_id), 8))::BIGINT % 32)::INT AS bucket FROM post, one WHERE job_id IN (a, b)""")
def read_buckets(spark, sf):
    from vacantic.functions.ids import bucket
    posts = t.postings(spark, sf).select("job_id", "company_id", "title")
    path = scratch_folder(spark, "buckets")
    posts.withColumn("bucket", bucket(F.col("job_id"))).repartition("bucket").write.partitionBy("bucket").parquet(path)
    ends = posts.agg(F.min("job_id"), F.max("job_id")).first()
    return seeds.read_buckets(spark, path, [e for e in ends if e])


@query("newest_snapshot", """
SELECT dataset, path, strftime(generated_at, '%Y-%m-%d %H:%M:%S.%f') AS generated_at, copies FROM (
  SELECT event_type AS dataset, arg_max('copy-' || event_id, ts) AS path, max(ts) AS generated_at, count(*) AS copies FROM events GROUP BY event_type)""")
def newest_snapshot(spark, sf):
    e = t.table(spark, sf, "events").select(
        F.col("event_type").alias("dataset"), F.concat(F.lit("copy-"), F.col("event_id").cast("string")).alias("path"), F.col("ts").alias("generated_at"))
    return seeds.newest_snapshot(e).withColumn("generated_at", F.date_format("generated_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


# --- discovery sources ---------------------------------------------------------------------------------------
_CRAWL = f"""
WITH {LINKS}, hit AS (SELECT url, min(page_id) AS page_id, any_value(site) AS site FROM links WHERE page_id % 10 IN (0, 2, 3, 4) GROUP BY url)
"""


def _index(spark: SparkSession, sf: str) -> DataFrame:
    return t.board_links(spark, sf).select(
        F.concat(F.col("url"), F.lit("#top")).alias("url"), F.lpad(F.col("page_id").cast("string"), 12, "0").alias("timestamp"))


@query("scan_crawl_index", _CRAWL + """
SELECT url, CASE page_id % 10 WHEN 0 THEN 'greenhouse' WHEN 2 THEN 'lever' WHEN 3 THEN 'ashby' ELSE 'smartrecruiters' END AS platform,
  lower(site) AS tenant, 0.95::DOUBLE AS base_confidence FROM hit""")
def scan_crawl_index(spark, sf):
    return crawl.scan_crawl_index(_index(spark, sf), total=None).select("url", "platform", "tenant", "base_confidence")


@query("crawl_quota", _CRAWL + """
SELECT url, page_id % 10 AS pattern FROM (SELECT *, row_number() OVER (PARTITION BY page_id % 10 ORDER BY page_id, url) AS n FROM hit) WHERE n <= 10""")
def crawl_quota(spark, sf):
    """The per-pattern quota of a crawl scan is the feature here."""
    df = crawl.scan_crawl_index(_index(spark, sf), total=50)
    nth = F.when(F.col("platform") == "greenhouse", 0).when(F.col("platform") == "lever", 2).when(F.col("platform") == "ashby", 3).otherwise(4)
    return df.select("url", nth.cast("long").alias("pattern"))


@query("mine_tenants", f"""
WITH {LINKS} SELECT DISTINCT platform, tenant FROM (
  SELECT CASE page_id % 10 WHEN 2 THEN 'lever' WHEN 3 THEN 'ashby' ELSE 'greenhouse' END AS platform, trim(lower(site), '-_') AS tenant
  FROM links WHERE page_id % 10 IN (0, 1, 2, 3) AND regexp_matches(lower(site), '^[a-z0-9][a-z0-9_-]{{1,64}}')) WHERE length(tenant) >= 2""")
def mine_tenants(spark, sf):
    texts = t.board_links(spark, sf).select(F.concat(F.col("html"), F.lit(" see "), F.col("url"), F.lit(" there")).alias("text"))
    return crawl.mine_tenants(texts, "text")


@query("merge_candidates", f"""
WITH {SOURCES}, {LINKS}, cand AS (
  SELECT trim(s_name) AS company, dom AS domain, adapter, tenant FROM src UNION ALL
  SELECT DISTINCT site, site || '.com', 'lever', lower(site) FROM links)
SELECT min(company) AS company, arg_min(domain, company) AS domain, adapter, tenant FROM cand
WHERE (adapter, tenant) NOT IN (SELECT (adapter, tenant) FROM src WHERE enabled) GROUP BY adapter, tenant""")
def merge_candidates(spark, sf):
    raw = t.seeds_raw(spark, sf)
    src = t.sources(spark, sf).where("enabled").select(
        F.col("company_name").alias("company"), F.col("company_domain").alias("domain"), "adapter", F.col("adapter_tenant").alias("tenant"))
    found = t.board_links(spark, sf).select(
        F.col("site").alias("company"), F.concat("site", F.lit(".com")).alias("domain"), F.lit("Lever").alias("adapter"), F.col("site").alias("tenant"))
    return seeds.merge_candidates(src, raw.unionByName(found))


@query("scan_code_search", f"""
WITH {LINKS} SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://boards.greenhouse.io/' || site WHEN 1 THEN 'https://jobs.lever.co/' || site
    WHEN 2 THEN 'https://jobs.ashbyhq.com/' || site ELSE 'https://careers.smartrecruiters.com' END AS url,
  CASE page_id % 4 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'ashby' ELSE 'smartrecruiters' END AS platform,
  CASE WHEN page_id % 4 < 3 THEN lower(site) ELSE '' END AS tenant, CASE WHEN page_id % 4 < 3 THEN 0.95::DOUBLE ELSE 0.7::DOUBLE END AS base_confidence FROM links""")
def scan_code_search(spark, sf):
    names = ["boards.greenhouse.io", "jobs.lever.co", "jobs.ashbyhq.com", "careers.smartrecruiters.com"]
    hits = t.board_links(spark, sf).select(
        F.get(F.array(*[F.lit(n) for n in names]), (F.col("page_id") % 4).cast("int")).alias("pattern"),
        F.concat(F.lit("https://code.example.com/r/"), F.col("site"), F.lit(".md")).alias("html_url"), F.lit("r").alias("repository"),
        F.col("page_id").cast("string").alias("path"))
    return crawl.scan_code_search(hits).select(F.col("path").cast("long").alias("page_id"), "url", "platform",
                                               F.coalesce("tenant", F.lit("")).alias("tenant"), "base_confidence")


@query("inspect_sites", f"""
WITH {LINKS}, sig AS (SELECT lower(host) AS domain, page_id, page_id % 3 = 0 AS posting,
    CASE WHEN page_id % 2 = 0 AND page_id % 10 < 8 AND page_id % 10 <> 9 THEN CASE WHEN page_id % 10 = 1 THEN 0.95 ELSE 0.95 END
      WHEN page_id % 3 = 0 THEN 0.6 END AS conf FROM found)
SELECT domain, count(*) AS pages, bool_or(posting) AS has_json_ld_jobs,
  greatest(coalesce(max(conf), 0), CASE WHEN bool_or(posting) THEN 0.65 ELSE 0 END, 0.5)::DOUBLE AS confidence FROM sig GROUP BY domain""")
def inspect_sites(spark, sf):
    """Every second page links to its board, every third carries a posting in JSON-LD."""
    p = t.board_links(spark, sf)
    link = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<a href="'), F.col("url"), F.lit('">x</a>'))).otherwise(F.lit(""))
    node = F.when(F.col("page_id") % 3 == 0, F.lit('<script type="application/ld+json">{"@type":"JobPosting"}</script>')).otherwise(F.lit(""))
    pages = p.select(F.col("host").alias("domain"), F.concat(F.lit("https://"), F.col("host")).alias("url"), F.concat("html", link, node).alias("html"))
    return crawl.inspect_sites(pages).select("domain", "pages", "has_json_ld_jobs", "confidence")


@query("sitemap_urls", """
SELECT DISTINCT host AS domain, 'https://' || host || '/' || w || '/' || page_id AS url FROM (
  SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages), (VALUES ('careers'), ('jobs'), ('join-us')) AS v(w)""")
def sitemap_urls(spark, sf):
    p = t.board_links(spark, sf)

    def loc(word: str) -> Column:
        return F.concat(F.lit("<url><LOC>https://"), F.col("host"), F.lit(f"/{word}/"), F.col("page_id").cast("string"), F.lit("</LOC></url>"))

    return crawl.sitemap_urls(p.select(F.col("host").alias("domain"), F.concat(
        loc("careers"), loc("about"), loc("jobs"), loc("press"), loc("join-us")).alias("body")))
