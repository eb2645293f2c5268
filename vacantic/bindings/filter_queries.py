"""Bindings of predicates and contract checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantic.bindings import tables as t
from vacantic.bindings.registry import LINKS, POSTINGS, SOURCES, fold_sql, query
from vacantic.functions import times
from vacantic.functions.denylist import denied_url
from vacantic.functions.text import canonical_text
from vacantic.operators import contracts, filters, health
from vacantic.operators.search import FilterSpec, filter_postings

# the public filter bound to words of the sample tables
_PUBLIC = dict(disciplines=["economy", "promo"], relevant=r"(?i)\b(ring|bolt)\b", noise=r"(?i)\b(large plate|old)\b")


@query("is_public", f"""
WITH {POSTINGS} SELECT job_id, title, career_level FROM post WHERE lifecycle IN ('open', 'reopened') AND career_level <> 'unknown' AND career_level_confidence >= 0.55
  AND NOT regexp_matches(title, '\\b(large plate|old)\\b') AND (discipline IN ('economy', 'promo') OR regexp_matches(title, '\\b(ring|bolt)\\b'))
  AND NOT contains(lower(title || ' ' || summary), 'position is filled')""")
def is_public(spark, sf):
    return filters.publishable(t.postings(spark, sf), **_PUBLIC).select("job_id", "title", "career_level")


@query("applications_open", f"""
SELECT doc_id, NOT regexp_matches({fold_sql('x')}, 'no longer accepting|position (has been|is) filled') AS is_open FROM (
  SELECT doc_id, CASE lang WHEN 'de' THEN text || ' This position  has been FILLED.' WHEN 'fr' THEN 'We are no longer accepting ' || text ELSE text END AS x FROM documents)""")
def applications_open(spark, sf):
    d = t.documents(spark, sf)
    x = F.when(F.col("lang") == "de", F.concat("text", F.lit(" This position  has been FILLED."))) \
        .when(F.col("lang") == "fr", F.concat(F.lit("We are no longer accepting "), "text")).otherwise(F.col("text"))
    base = d.select("doc_id", canonical_text(x).alias("c"))
    return base.select("doc_id", filters.applications_open(F.col("c"), F.lit("https://a"), F.lit("https://b")).alias("is_open"))


@query("is_relevant", """
SELECT p_partkey, NOT regexp_matches(p_name, '\\b(large plate|old)\\b') AND (lower(p_type) IN ('economy', 'promo') OR regexp_matches(p_name, '\\b(ring|bolt)\\b')) AS relevant FROM part""")
def is_relevant(spark, sf):
    return t.table(spark, sf, "part").select("p_partkey", filters.is_relevant(F.col("p_name"), F.col("p_type"), **_PUBLIC).alias("relevant"))


@query("first_party", f"WITH {LINKS} SELECT page_id, url FROM links WHERE page_id % 10 <> 8")
def first_party(spark, sf):
    return filters.first_party(t.board_links(spark, sf), "url").select("page_id", "url")


@query("denied_urls", f"""
WITH {LINKS} SELECT page_id, CASE WHEN page_id % 10 = 8 THEN 'domain' ELSE 'pattern' END AS reason,
  CASE WHEN page_id % 10 = 8 THEN 'www.linkedin.com' ELSE 'utm_source=indeed' END AS matched FROM links WHERE page_id % 10 IN (8, 9)""")
def denied_urls(spark, sf):
    p = t.board_links(spark, sf)
    u = F.when(F.col("page_id") % 10 == 9, F.concat("url", F.lit("?z=1&UTM_source=Indeed"))).otherwise(F.col("url"))
    return p.select("page_id", denied_url(u).alias("d")).where(F.col("d").isNotNull()).select("page_id", "d.reason", "d.matched")


@query("match_query", f"""
SELECT doc_id FROM documents WHERE contains(lower(text), 'tion') AND contains(lower(text), 'er th')""".replace("'er th'", "'the'"))
def match_query(spark, sf):
    d = t.documents(spark, sf)
    return d.where(filters.match_query(F.lower("text"), " TION  a the ")).select("doc_id")


@query("facet_filters", f"""
WITH {POSTINGS} SELECT job_id FROM post WHERE career_level IN ('internship', 'co_op') AND discipline IN ('promo', 'economy', 'small') AND workplace_type IN ('remote', 'hybrid')
  AND academic_term IN ('summer', 'fall')""")
def facet_filters(spark, sf):
    spec = FilterSpec(career_levels=["internship", "co_op"], disciplines=["promo", "economy", "small"], workplace_types=["remote", "hybrid"],
                      academic_terms=["summer", "fall"])
    return filter_postings(t.postings(spark, sf), spec).select("job_id")


@query("fresh_within", """
SELECT event_id, ts >= TIMESTAMP '2024-01-30' AS day, ts >= TIMESTAMP '2024-01-24' AS week, ts >= TIMESTAMP '2024-01-01' AS month,
  ts > TIMESTAMP '2024-01-20' AS visit FROM events""")
def fresh_within(spark, sf):
    as_of, visit = t.ts(t.EVENTS_AS_OF), t.ts("2024-01-20 00:00:00")
    windows = {"day": "24h", "week": "7d", "month": "30d", "visit": "new_since_visit"}
    return t.table(spark, sf, "events").select(
        "event_id", *[times.within_window(F.col("ts"), w, as_of, visit).alias(n) for n, w in windows.items()])


@query("has_benefits", f"WITH {POSTINGS} SELECT job_id FROM post WHERE visa AND housing")
def has_benefits(spark, sf):
    return t.postings(spark, sf).where(filters.has_benefits(F.col("mobility"), ["visa", "housing"])).select("job_id")


@query("open_to_origin", f"""
WITH {POSTINGS} SELECT job_id, NOT allows_ca AND NOT excludes_us AS us, NOT (allows_ca AND false) AS ca, NOT allows_ca AS de FROM post""")
def open_to_origin(spark, sf):
    a, x = F.col("eligibility.explicit_allowed_countries"), F.col("eligibility.explicit_excluded_countries")
    return t.postings(spark, sf).select("job_id", *[filters.open_to_origin(a, x, o).alias(n) for n, o in
                                                    (("us", "United States"), ("ca", " canada "), ("de", "de"))])


@query("in_region", """
SELECT n_nationkey, CASE r_name WHEN 'AMERICA' THEN 'na' WHEN 'EUROPE' THEN 'eu' WHEN 'ASIA' THEN 'asia' WHEN 'MIDDLE EAST' THEN 'asia,remote' ELSE '' END AS regions
FROM nation JOIN region ON r_regionkey = n_regionkey""")
def in_region(spark, sf):
    """America by continent name, Europe by country code, Asia by continent, the Middle East by wording."""
    n = t.table(spark, sf, "nation").join(t.table(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    r = F.col("r_name")
    loc = F.array(F.struct(
        F.when(r == "MIDDLE EAST", F.concat(F.lit("Remote, India, "), F.col("n_name"))).otherwise(F.col("n_name")).alias("raw"),
        F.col("n_name").alias("country"), F.when(r == "EUROPE", F.lit("de")).alias("country_code"),
        F.when(r == "AMERICA", F.lit("North America")).when(r == "ASIA", F.lit("Asia")).alias("continent")))
    return n.select("n_nationkey", F.array_join(filters.regions(F.lit("onsite"), loc), ",").alias("regions"))


@query("saved_and_dismissed", """
SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')
  AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def saved_and_dismissed(spark, sf):
    """Saved: orders of one segment; dismissed: orders with a returned line."""
    o = t.table(spark, sf, "orders")
    saved = o.join(t.table(spark, sf, "customer").where(F.col("c_mktsegment") == "MACHINERY"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey")
    gone = t.table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("o_orderkey"))
    return filters.hide_dismissed(filters.saved_only(o, saved, "o_orderkey"), gone, "o_orderkey").select("o_orderkey")


@query("due_sources", f"WITH {SOURCES} SELECT source_id, adapter FROM src WHERE enabled AND health_status <> 'disabled' AND adapter IN ('lever', 'ashby', 'workday')")
def due_sources(spark, sf):
    return health.due_sources(t.sources(spark, sf), ["lever", "ashby", "workday"]).select("source_id", "adapter")


@query("watch_match", """
SELECT doc_id FROM documents WHERE (contains(lower(text), 'tion') OR contains(lower(text), 'und')) AND (contains(lower(text), 'the') OR contains(lower(text), 'que'))""")
def watch_match(spark, sf):
    return t.documents(spark, sf).where(filters.watch_match(F.col("text"), ["tion", "und"], ["the", "que"])).select("doc_id")


@query("is_new", """
SELECT event_id, ts > TIMESTAMP '2024-01-30' OR ts > TIMESTAMP '2024-01-25 12:00:00' AS is_new FROM events""")
def is_new(spark, sf):
    return t.table(spark, sf, "events").select(
        "event_id", times.is_new(F.lit(None).cast("timestamp"), F.col("ts"), t.ts(t.EVENTS_AS_OF), t.ts("2024-01-25 12:00:00")).alias("is_new"))


@query("is_startup", "SELECT s_suppkey, s_suppkey IN (1, 5, 7) AS startup FROM supplier")
def is_startup(spark, sf):
    names = ["Supplier 000000001", "supplier#000000005", "Supplier, #000000007!"]
    return t.table(spark, sf, "supplier").select("s_suppkey", filters.is_startup(F.col("s_name"), names).alias("startup"))


# --- contracts -----------------------------------------------------------------------------------------------
@query("check_contract", f"""
WITH {POSTINGS}, n AS (SELECT count(*) AS rows FROM post) SELECT rule, violations, rows FROM n, (
  SELECT 'id is 64 hex' AS rule, count(*) FILTER (WHERE NOT regexp_matches(job_id, '^[0-9a-f]{{64}}$')) AS violations FROM post UNION ALL
  SELECT 'level is known', count(*) FILTER (WHERE career_level NOT IN ('internship', 'co_op', 'new_grad')) FROM post UNION ALL
  SELECT 'confidence at least 0.1', count(*) FILTER (WHERE career_level_confidence < 0.1) FROM post UNION ALL
  SELECT 'posted date is set', count(*) FILTER (WHERE source_posted_at IS NULL) FROM post UNION ALL
  SELECT 'title length', count(*) FILTER (WHERE length(title) > 8) FROM post)""")
def check_contract(spark, sf):
    rules = {
        "id is 64 hex": F.col("job_id").rlike("^[0-9a-f]{64}$"), "level is known": contracts.one_of("career_level", ["internship", "co_op", "new_grad"]),
        "confidence at least 0.1": F.col("career_level_confidence") >= 0.1, "posted date is set": contracts.required("source_posted_at"),
        "title length": contracts.at_most("title", 8)}
    return contracts.check_contract(t.postings(spark, sf), rules)


@query("check_event_contract", """
SELECT 'event_type is known' AS rule, count(*) FILTER (WHERE event_type <> 'signup') AS violations, count(*) AS rows FROM events UNION ALL
SELECT 'job_id is filled', 0, count(*) FROM events UNION ALL SELECT 'timestamp is set', 0, count(*) FROM events""")
def check_event_contract(spark, sf):
    e = t.table(spark, sf, "events").select(
        F.when(F.col("event_type") == "signup", "OPENED").otherwise(F.col("event_type")).alias("event_type"),
        F.col("event_id").alias("job_id"), F.col("ts").alias("timestamp"))
    return contracts.check_contract(e, contracts.event_rules())


@query("check_text_invariants", """
SELECT 'normalize_ws is idempotent' AS rule, 0::BIGINT AS violations, count(*) AS rows FROM documents UNION ALL
SELECT 'canonical_text is idempotent', 0, count(*) FROM documents""")
def check_text_invariants(spark, sf):
    return contracts.check_text_invariants(t.documents(spark, sf), "text")


@query("check_bucket_invariants", f"""
WITH {POSTINGS} SELECT count(*) AS rows, count(*) AS sharded, 0::BIGINT AS bad_ids, 0::BIGINT AS bad_buckets,
  count(DISTINCT ('0x' || left(sha256(job_id), 8))::BIGINT % 32) AS buckets_used FROM post""")
def check_bucket_invariants(spark, sf):
    return contracts.check_bucket_invariants(t.postings(spark, sf).select("job_id"))
