"""Query registry: name -> DataFrame function, and the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


# --- SQL fragments -----------------------------------------------------------------------------
def plain_sql(c: str) -> str:
    """Text without markup: lines trimmed, runs of blanks to one, empty lines gone."""
    return (f"list_aggregate(list_filter(list_transform(string_split({c}, chr(10)), "
            f"lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), 'string_agg', chr(10))")


def line_sql(c: str) -> str:
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def fold_sql(c: str) -> str:
    """Case folding of the alphabets in the sample texts."""
    return f"replace(lower({line_sql(c)}), 'ß', 'ss')"


def phrase_sql(text: str, phrase: str) -> str:
    safe = "".join("\\" + ch if ch in r"\.^$*+?{}[]|()" else ch for ch in phrase).replace("'", "''")
    return f"regexp_matches({text}, '(^|[^\\p{{L}}\\p{{N}}_]){safe}([^\\p{{L}}\\p{{N}}_]|$)')"


POSTINGS = """
li AS (SELECT l_orderkey, min(l_partkey) AS p_partkey FROM lineitem GROUP BY l_orderkey),
post AS (
  SELECT o_orderkey, sha256('orders:tpch:' || o_orderkey) AS job_id, o_orderkey::VARCHAR AS source_job_id,
    o_custkey::VARCHAR AS company_id, coalesce(c_name, '') AS company_name, coalesce(p_name, 'untitled') AS title,
    concat_ws(' ', p_name, p_type, o_orderpriority) AS summary,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'internship' WHEN '2-HIGH' THEN 'co_op' WHEN '3-MEDIUM' THEN 'new_grad'
      WHEN '4-NOT SPECIFIED' THEN 'entry_level' WHEN '5-LOW' THEN 'unknown' END AS career_level,
    least(o_totalprice / 500000.0::DOUBLE, 1.0::DOUBLE) AS career_level_confidence,
    coalesce(lower(p_type), 'other') AS discipline,
    concat_ws(', ', n_name, r_name) AS raw, n_name AS country,
    CASE WHEN r_name = 'AMERICA' THEN 'North America' ELSE r_name END AS continent,
    CASE WHEN p_size % 3 = 0 THEN 'remote' WHEN p_size % 3 = 1 THEN 'onsite' ELSE 'hybrid' END AS workplace_type,
    CASE WHEN month(o_orderdate) IN (6, 7, 8) THEN 'summer' WHEN month(o_orderdate) IN (9, 10, 11) THEN 'fall'
      WHEN month(o_orderdate) IN (12, 1, 2) THEN 'winter' ELSE 'unknown' END AS academic_term,
    o_totalprice > 300000 AS visa, o_totalprice > 400000 AS relocation, coalesce(p_size > 40, false) AS housing,
    coalesce(p_size > 45, false) AS airfare, coalesce(p_size % 5 = 0, false) AS allows_ca, coalesce(p_size % 7 = 0, false) AS excludes_us,
    CASE WHEN o_orderstatus <> 'P' THEN o_orderdate::TIMESTAMP END AS source_posted_at,
    o_orderdate::TIMESTAMP AS first_seen_at, o_orderdate::TIMESTAMP + INTERVAL 30 DAY AS last_seen_at,
    o_orderdate::TIMESTAMP AS posted,
    CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'suspected_closed' WHEN 'F' THEN 'closed' END AS lifecycle, o_orderstatus
  FROM orders LEFT JOIN li ON l_orderkey = o_orderkey LEFT JOIN part USING (p_partkey)
  LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey
  LEFT JOIN region ON r_regionkey = n_regionkey)
"""
LINKS = """
links AS (
  SELECT page_id, site, host, html,
    CASE WHEN page_id % 10 = 9 THEN 'https://' || host || path ELSE
      CASE page_id % 10 WHEN 0 THEN 'https://boards.greenhouse.io/' WHEN 1 THEN 'https://boards-api.greenhouse.io/v1/boards/'
        WHEN 2 THEN 'https://jobs.lever.co/' WHEN 3 THEN 'http://jobs.ashbyhq.com/' WHEN 4 THEN 'https://careers.smartrecruiters.com/'
        WHEN 5 THEN 'https://acme.wd5.myworkdayjobs.com/' WHEN 6 THEN 'https://apply.workable.com/'
        WHEN 7 THEN 'https://jobs.teamtailor.com/' ELSE 'https://www.linkedin.com/' END || site || path END AS url
  FROM (SELECT page_id, html, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host,
          list_extract(string_split(regexp_extract(url, '^https?://([^/?#]+)', 1), '.'), -3) AS site,
          regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM pages)),
found AS (
  SELECT *, CASE page_id % 10 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'greenhouse' WHEN 2 THEN 'lever' WHEN 3 THEN 'ashby'
      WHEN 4 THEN 'smartrecruiters' WHEN 5 THEN 'workday' WHEN 6 THEN 'workable' WHEN 7 THEN 'teamtailor' END AS platform,
    CASE WHEN page_id % 10 = 1 THEN 'v1' WHEN page_id % 10 < 8 THEN lower(site) END AS tenant
  FROM links)
"""
GRID = """
s AS (SELECT DISTINCT user_id::VARCHAR AS source_id, event_type AS posting_id, date_trunc('day', ts) AS d FROM events),
p AS (SELECT DISTINCT source_id, d FROM s),
k AS (SELECT source_id, posting_id, min(d) AS f FROM s GROUP BY ALL),
grid AS (SELECT k.source_id, k.posting_id, p.d, (s.d IS NOT NULL)::INT AS hit
  FROM k JOIN p ON p.source_id = k.source_id AND p.d >= k.f
  LEFT JOIN s ON s.source_id = k.source_id AND s.posting_id = k.posting_id AND s.d = p.d),
isl AS (SELECT *, sum(hit) OVER (PARTITION BY source_id, posting_id ORDER BY d) AS g FROM grid),
m AS (SELECT *, sum(1 - hit) OVER (PARTITION BY source_id, posting_id, g ORDER BY d)::BIGINT AS misses FROM isl),
st AS (SELECT *, CASE WHEN misses >= 4 THEN 'closed' WHEN misses >= 2 THEN 'suspected_closed' ELSE 'open' END AS state,
  lag(misses) OVER (PARTITION BY source_id, posting_id ORDER BY d) AS before FROM m)
"""
POLLS = """
polls AS (SELECT user_id::VARCHAR AS source_id, 'adapter-' || (user_id % 7) AS adapter, ts AS poll_ts, event_id AS poll_id,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'not_modified' ELSE 'ok' END AS outcome,
  CASE WHEN event_type = 'error' THEN props END AS message FROM events)
"""
_ADAPTER = ("list_extract(['greenhouse','lever','ashby','smartrecruiters','workday','workable','json_ld','simplify'], "
            "(s_nationkey % 8) + 1)")
SOURCES = f"""
src AS (SELECT *, left(sha256('source|' || dom || '|' || adapter || '|' || tenant), 16) AS source_id,
    left(sha256('company|' || dom), 16) AS company_id FROM (
  SELECT s_suppkey, s_name, s_acctbal, 'supplier-' || s_suppkey || '.example.com' AS dom, {_ADAPTER} AS adapter, 'tenant' || s_suppkey AS tenant,
    CASE WHEN s_acctbal < 0 THEN 12 WHEN s_acctbal < 2000 THEN 4 ELSE 0 END AS consecutive_failures,
    list_extract(['hot','warm','cold','dormant','other'], (s_suppkey % 5)::INT + 1) AS poll_tier,
    CASE WHEN s_suppkey % 4 <> 0 THEN make_timestamp((978307200 + floor(s_acctbal)::BIGINT * 60) * 1000000) END AS next_due_at,
    CASE WHEN s_acctbal < 0 THEN 'disabled' WHEN s_acctbal < 2000 THEN 'degraded' ELSE 'healthy' END AS health_status,
    s_suppkey % 10 <> 0 AS enabled FROM supplier))
"""
