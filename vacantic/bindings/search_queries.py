"""Bindings of search, aggregates, ranking, sorting and publishing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantic.bindings import tables as t
from vacantic.bindings.registry import POSTINGS, SOURCES, query
from vacantic.operators import search
from vacantic.operators.scale import group_rank
from vacantic.operators.search import FilterSpec
from vacantic.plans import publish, state, text_index

_STARTUPS = ["Customer#000000001", "Customer 000000005", "customer-000000010"]
_SLUG = "trim(regexp_replace(lower(company_name), '[^a-z0-9]+', '-', 'g'), '-')"
_BUCKET = "(('0x' || left(sha256(job_id), 8))::BIGINT % 32)::INT"


def _open(spark: SparkSession, sf: str) -> DataFrame:
    return t.postings(spark, sf).where(F.col("lifecycle") == "open")


# --- aggregates ---------------------------------------------------------------------------------------------
@query("facet_counts", f"""
WITH {POSTINGS}, f AS (
  SELECT 'discipline' AS facet, discipline AS value FROM post WHERE discipline <> 'other' UNION ALL SELECT 'career_level', career_level FROM post
  UNION ALL SELECT 'workplace_type', workplace_type FROM post UNION ALL SELECT 'academic_term', academic_term FROM post WHERE academic_term <> 'unknown'
  UNION ALL SELECT 'mobility', 'visa' FROM post WHERE visa UNION ALL SELECT 'mobility', 'relocation' FROM post WHERE relocation
  UNION ALL SELECT 'mobility', 'housing' FROM post WHERE housing UNION ALL SELECT 'mobility', 'airfare' FROM post WHERE airfare
  UNION ALL SELECT 'region', 'remote' FROM post WHERE workplace_type = 'remote' UNION ALL SELECT 'region', 'na' FROM post WHERE continent = 'North America'
  UNION ALL SELECT 'region', 'eu' FROM post WHERE continent = 'EUROPE' UNION ALL SELECT 'region', 'asia' FROM post WHERE continent = 'ASIA'
  UNION ALL SELECT 'startup', 'startup' FROM post WHERE {_SLUG} IN ('customer-000000001', 'customer-000000005', 'customer-000000010'))
SELECT facet, value, count(*) AS postings FROM f WHERE value IS NOT NULL GROUP BY facet, value""")
def facet_counts(spark, sf):
    return search.facet_counts(t.postings(spark, sf), _STARTUPS)


@query("company_summary", f"WITH {POSTINGS} SELECT company_id, arg_min(company_name, job_id) AS name, arg_min({_SLUG}, job_id) AS slug, count(*) AS job_count FROM post GROUP BY company_id")
def company_summary(spark, sf):
    return search.company_summary(t.postings(spark, sf))


@query("site_stats", f"""
WITH {POSTINGS} SELECT count(*) AS total_jobs, count(DISTINCT company_id) AS total_companies, count(*) FILTER (WHERE visa) AS with_visa,
  count(*) FILTER (WHERE relocation) AS with_relocation, count(*) FILTER (WHERE workplace_type = 'remote') AS remote_count,
  count(*) FILTER (WHERE posted > TIMESTAMP '2000-06-01') AS new_since_visit FROM post""")
def site_stats(spark, sf):
    return search.site_stats(t.postings(spark, sf), t.ts("2000-06-01 00:00:00"))


@query("bucket_balance", f"WITH {POSTINGS} SELECT {_BUCKET} AS bucket, count(*) AS rows FROM post GROUP BY 1")
def bucket_balance(spark, sf):
    return publish.bucket_balance(t.postings(spark, sf).select("job_id"))


@query("company_pages", f"WITH {POSTINGS} SELECT DISTINCT {_SLUG} AS slug FROM post WHERE lifecycle = 'open' AND {_SLUG} <> ''")
def company_pages(spark, sf):
    return search.company_pages(_open(spark, sf))


# --- order, pages, search ---------------------------------------------------------------------------------------
_DIVERSE = f"""
WITH {POSTINGS}, r AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY posted DESC, job_id) AS company_rank,
  max(posted) OVER (PARTITION BY company_id) AS top FROM post)
"""


# what ranks and sort orders read: ranks write their rows out, so they get no others
_ORDERED = ["job_id", "company_id", "company_name", "title", "source_posted_at", "first_seen_at"]


@query("diversify", _DIVERSE + "SELECT job_id, company_id, company_rank::BIGINT AS company_rank, strftime(top, '%Y-%m-%d') AS top FROM r")
def diversify(spark, sf):
    return search.diversify(t.postings(spark, sf).select(*_ORDERED)).select(
        "job_id", "company_id", F.col("company_rank").cast("long").alias("company_rank"), F.date_format("company_top", "yyyy-MM-dd").alias("top"))


@query("diversify_hot_groups", _DIVERSE + "SELECT job_id, company_id, company_rank::BIGINT AS company_rank FROM r")
def diversify_hot_groups(spark, sf):
    """The same rank by the way that cuts hot companies into ranges."""
    return search.diversify(t.postings(spark, sf), parts=16).select("job_id", "company_id", F.col("company_rank").cast("long").alias("company_rank"))


@query("sort_postings", f"""
WITH {POSTINGS}, r AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY posted DESC, job_id) AS cr, max(posted) OVER (PARTITION BY company_id) AS top FROM post)
SELECT job_id, row_number() OVER (ORDER BY posted DESC, job_id) AS newest, row_number() OVER (ORDER BY company_name, title, job_id) AS by_company,
  row_number() OVER (ORDER BY title, company_name, job_id) AS by_title, row_number() OVER (ORDER BY cr, top DESC, company_name, company_id, job_id) AS diverse FROM r""")
def sort_postings(spark, sf):
    """Position of every posting under each sort mode, by the exact distributed rank."""
    df = search.diversify(t.postings(spark, sf).select(*_ORDERED))
    # a rank writes its rows out: columns that no later order reads go; the first rank settles ties of rows with one id
    for mode, name, tie, done in (("newest", "newest", [], ["source_posted_at", "first_seen_at"]), ("company", "by_company", [F.col("newest").desc()], []),
                                  ("title", "by_title", [F.col("newest")], ["title"]), ("diverse", "diverse", [F.col("newest")], [])):
        df = group_rank(df, [], [*search.sort_keys(mode), *tie], name).drop(*done)
    return df.select("job_id", *[F.col(c).cast("long").alias(c) for c in ("newest", "by_company", "by_title", "diverse")])


@query("page", f"WITH {POSTINGS} SELECT job_id, title FROM post ORDER BY posted DESC, job_id LIMIT 25 OFFSET 50")
def page(spark, sf):
    return search.page(t.postings(spark, sf), search.sort_keys("newest"), 3, 25).select("job_id", "title")


@query("page_count", f"WITH {POSTINGS} SELECT count(*) AS rows, greatest(1, ceil(count(*) / 25.0))::BIGINT AS pages FROM post WHERE lifecycle = 'open'")
def page_count(spark, sf):
    return search.page_count(_open(spark, sf), 25)


@query("newest_n", f"WITH {POSTINGS} SELECT job_id, strftime(posted, '%Y-%m-%d') AS posted FROM post ORDER BY post.posted DESC, job_id LIMIT 500")
def newest_n(spark, sf):
    return search.newest_n(t.postings(spark, sf), 500).select("job_id", F.date_format("first_seen_at", "yyyy-MM-dd").alias("posted"))


_FIND = f"""
WITH {POSTINGS}, hit AS (SELECT * FROM post WHERE career_level IN ('internship', 'co_op', 'new_grad') AND workplace_type IN ('remote', 'hybrid')
  AND (workplace_type = 'remote' OR continent IN ('EUROPE')) AND posted >= TIMESTAMP '2001-12-31' - INTERVAL 30 DAY - INTERVAL 1500 DAY
  AND contains(lower(title) || ' ' || lower(company_name) || ' ' || lower(concat_ws(', ', country, nullif(raw, ''))) || ' ' || discipline, 'r')
  AND contains(lower(title) || ' ' || lower(company_name) || ' ' || lower(concat_ws(', ', country, nullif(raw, ''))) || ' ' || discipline, 'in') AND NOT excludes_us AND NOT allows_ca),
"""


@query("search", _FIND + """
r AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY posted DESC, job_id) AS cr, max(posted) OVER (PARTITION BY company_id) AS top FROM hit)
SELECT job_id, title, company_name FROM r ORDER BY cr, top DESC, company_name, company_id, job_id LIMIT 25""")
def run_search(spark, sf):
    """Filters, round robin over companies, first page."""
    spec = FilterSpec(q="in R", career_levels=["internship", "co_op", "new_grad"], workplace_types=["remote", "hybrid"], regions=["remote", "eu"],
                      origin_country="USA", sort="diverse")
    base = t.postings(spark, sf).where(F.col("first_seen_at") >= t.ts(t.AS_OF) - F.expr("INTERVAL 1530 DAYS"))
    return search.search(base, spec).select("job_id", "title", "company_name")


_HAY = "lower(title) || ' ' || lower(company_name) || ' ' || lower(concat_ws(', ', country, nullif(raw, ''))) || ' ' || discipline"


@query("search_indexed", f"""
WITH {POSTINGS}, hit AS (SELECT *, {_HAY} AS hay FROM post),
a AS (SELECT 'ring 0001' AS q, * FROM (SELECT job_id, title FROM hit WHERE contains(hay, 'ring') AND contains(hay, '0001') ORDER BY posted DESC, job_id LIMIT 40)),
b AS (SELECT 'ia 99 Customer' AS q, * FROM (SELECT job_id, title FROM hit WHERE contains(hay, 'ia') AND contains(hay, '99') AND contains(hay, 'customer') AND workplace_type = 'remote' ORDER BY title, company_name, job_id LIMIT 40)),
c AS (SELECT 'nowhere' AS q, job_id, title FROM hit WHERE contains(hay, 'nowhere')),
d AS (SELECT 'x' AS q, * FROM (SELECT job_id, title FROM hit ORDER BY posted DESC, job_id LIMIT 5))
SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM d""")
def search_indexed(spark, sf):
    """Keyword searches over the trigram index: two tokens, tokens of two characters, no hit, no token."""
    path = publish.scratch_folder(spark, "index")
    text_index.write_text_index(t.postings(spark, sf), path)
    specs = [FilterSpec(q="ring 0001", sort="newest", page_size=40), FilterSpec(q="ia 99 Customer", sort="title", workplace_types=["remote"], page_size=40),
             FilterSpec(q="nowhere", sort="newest", page_size=40), FilterSpec(q="x", sort="newest", page_size=5)]
    found = [text_index.search_indexed(spark, path, s).select(F.lit(s.q).alias("q"), "job_id", "title") for s in specs]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


@query("search_newest", f"""
WITH {POSTINGS} SELECT job_id, title FROM post WHERE posted >= TIMESTAMP '2001-08-05' - INTERVAL 30 DAY ORDER BY posted DESC, job_id LIMIT 10 OFFSET 10""")
def search_newest(spark, sf):
    return search.search(t.postings(spark, sf), FilterSpec(freshness="30d", sort="newest", page=2, page_size=10), as_of=t.ts("2001-08-05 00:00:00")).select("job_id", "title")


@query("company_search", f"""
WITH {POSTINGS} SELECT job_id, title FROM post WHERE {_SLUG} = 'customer-000000007' AND workplace_type <> 'hybrid' ORDER BY title, company_name, job_id LIMIT 25""")
def company_search(spark, sf):
    return search.company_search(t.postings(spark, sf), "customer-000000007", FilterSpec(workplace_types=["remote", "onsite"], sort="title")).select("job_id", "title")


@query("point_lookup", f"WITH {POSTINGS} SELECT job_id, title, company_id, {_BUCKET} AS bucket FROM post WHERE job_id = sha256('orders:tpch:1')")
def point_lookup(spark, sf):
    import hashlib

    from vacantic.functions.ids import bucket
    rows = t.postings(spark, sf).select("job_id", "title", "company_id").withColumn("bucket", bucket(F.col("job_id")))
    return search.point_lookup(rows, hashlib.sha256(b"orders:tpch:1").hexdigest())


# --- publishing -----------------------------------------------------------------------------------------------------
def _public(spark: SparkSession, sf: str) -> DataFrame:
    return _open(spark, sf).select("job_id", "company_id", "company_name", "title", "job_url", "summary", "career_level", "source_posted_at",
                                   "first_seen_at", "last_seen_at")


_ROW = """(2 + length('"job_id":') + 2 + length(job_id) + 1 + length('"company_id":') + 2 + length(company_id) + 1 + length('"title":') + 2 + length(title))"""
_CHUNKS = f"""
WITH RECURSIVE {POSTINGS}, pub AS (SELECT job_id, {_BUCKET} AS bucket, {_ROW} AS size, row_number() OVER (PARTITION BY {_BUCKET} ORDER BY last_seen_at DESC, job_id) AS n
  FROM post WHERE lifecycle = 'open'),
walk AS (SELECT bucket, job_id, n, size, 0 AS chunk, 1 AS rows_in, size + 2 AS bytes_in FROM pub WHERE n = 1
  UNION ALL SELECT p.bucket, p.job_id, p.n, p.size, CASE WHEN is_full THEN chunk + 1 ELSE chunk END, CASE WHEN is_full THEN 1 ELSE rows_in + 1 END, CASE WHEN is_full THEN p.size + 2 ELSE bytes_in + p.size + 1 END
  FROM (SELECT w.*, w.rows_in + 1 > 7 OR w.bytes_in + q.size + 1 > 900 AS is_full FROM walk w JOIN pub q ON q.bucket = w.bucket AND q.n = w.n + 1) w JOIN pub p ON p.bucket = w.bucket AND p.n = w.n + 1)
"""


def _slim(spark: SparkSession, sf: str) -> DataFrame:
    return _open(spark, sf).select("job_id", "company_id", "title", "last_seen_at")


def _chunked(spark: SparkSession, sf: str, **options) -> DataFrame:
    from vacantic.functions.ids import bucket
    df = _slim(spark, sf).withColumn("bucket", bucket(F.col("job_id")))
    size = F.octet_length(F.to_json(F.struct("job_id", "company_id", "title")))
    return publish.chunk_by_budget(df, ["bucket"], [F.col("last_seen_at").desc(), F.col("job_id")], size, 7, 900, **options)


@query("chunk_by_budget", _CHUNKS + "SELECT bucket, job_id, chunk::INT AS chunk FROM walk")
def chunk_by_budget(spark, sf):
    """Seven rows or 900 bytes per file, so that both caps bind on the sample."""
    return _chunked(spark, sf).select("bucket", "job_id", "chunk")


@query("chunk_by_budget_segments", _CHUNKS + "SELECT bucket, job_id, chunk::INT AS chunk FROM walk")
def chunk_by_budget_segments(spark, sf):
    """The same files with buckets cut into small pieces, as a huge bucket is."""
    return _chunked(spark, sf, segment=40, parts=16).select("bucket", "job_id", "chunk")


@query("write_shards", f"WITH {POSTINGS} SELECT {_BUCKET} AS bucket, count(*) AS job_count FROM post WHERE lifecycle = 'open' GROUP BY 1")
def write_shards(spark, sf):
    """Rows per bucket as read back from the written files."""
    path = publish.scratch_folder(spark, "shards")
    publish.write_shards(_public(spark, sf), path, max_rows=200)
    return spark.read.json(path).groupBy(F.col("bucket").cast("int").alias("bucket")).agg(F.count("*").alias("job_count"))


@query("shard_manifest", f"WITH {POSTINGS} SELECT sum(job_count)::BIGINT AS jobs, count(*) AS shards, true AS within_caps FROM (SELECT count(*) AS job_count FROM post WHERE lifecycle = 'open' GROUP BY {_BUCKET})")
def shard_manifest(spark, sf):
    m = publish.write_shards(_public(spark, sf), publish.scratch_folder(spark, "shards"))
    per_bucket = m.groupBy("bucket").agg(F.sum("job_count").alias("job_count"), F.max("job_count").alias("most"), F.max("byte_size").alias("bytes"))
    return per_bucket.agg(F.sum("job_count").alias("jobs"), F.count("*").alias("shards"),
                          ((F.max("most") <= 2000) & (F.max("bytes") <= 2_097_152)).alias("within_caps"))


@query("write_index", f"WITH {POSTINGS} SELECT job_id, company_id, title, lpad({_BUCKET}::VARCHAR, 2, '0') AS bucket FROM post WHERE lifecycle = 'open'")
def write_index(spark, sf):
    path = publish.scratch_folder(spark, "index")
    publish.write_index(_public(spark, sf), path)
    return spark.read.schema("job_id string, company_id string, title string, bucket string").json(path)


@query("write_dims", "SELECT 'companies' AS \"table\", count(*) AS rows FROM customer UNION ALL SELECT 'sources', count(*) FROM supplier")
def write_dims(spark, sf):
    return publish.write_dims(t.table(spark, sf, "customer"), t.sources(spark, sf), publish.scratch_folder(spark, "dims"))


@query("write_meta", f"""
WITH {POSTINGS} SELECT (SELECT count(*) FROM post WHERE lifecycle = 'open') AS job_count, (SELECT count(*) FROM orders) AS tracked_job_count, (SELECT count(*) FROM customer) AS company_count,
  (SELECT count(*) FROM supplier) AS source_count, (SELECT count(*) FROM events) AS event_count""")
def write_meta(spark, sf):
    path = publish.scratch_folder(spark, "meta")
    publish.write_meta(_open(spark, sf), t.table(spark, sf, "orders"), t.table(spark, sf, "customer"), t.table(spark, sf, "supplier"),
                       t.table(spark, sf, "events"), t.ts(t.AS_OF), path)
    return spark.read.json(path).select("job_count", "tracked_job_count", "company_count", "source_count", "event_count")


@query("write_feeds", f"""
WITH {POSTINGS}, f AS (SELECT * FROM post WHERE lifecycle = 'open' ORDER BY posted DESC, job_id LIMIT 500), n AS (SELECT count(*) AS items FROM f),
i AS (SELECT string_agg('<item><title>' || title || '</title><link>https://jobs.example.com/' || source_job_id || '</link><guid isPermaLink="false">' || job_id || '</guid><pubDate>'
    || strftime(posted, '%a, %d %b %Y %H:%M:%S +0000') || '</pubDate><description>' || summary || '</description></item>', '' ORDER BY posted DESC, job_id) AS items,
  string_agg('<entry><title>' || title || '</title><link href="https://jobs.example.com/' || source_job_id || '"/><id>' || job_id || '</id><updated>'
    || strftime(last_seen_at, '%a, %d %b %Y %H:%M:%S +0000') || '</updated><summary>' || summary || '</summary><author><name>' || company_name || '</name></author></entry>', '' ORDER BY posted DESC, job_id) AS entries,
  string_agg('{{"id":"' || job_id || '","url":"https://jobs.example.com/' || source_job_id || '","title":"' || title || '","content_text":"' || summary || '","date_published":"'
    || strftime(posted, '%Y-%m-%dT%H:%M:%SZ') || '","authors":[{{"name":"' || company_name || '"}}]}}', ',' ORDER BY posted DESC, job_id) AS json FROM f)
SELECT 'rss' AS format, n.items, sha256('<?xml version="1.0" encoding="utf-8"?>' || chr(10) || '<rss version="2.0"><channel><title>Roles</title><link>https://x.example.com</link><description>New roles</description><lastBuildDate>Mon, 31 Dec 2001 00:00:00 +0000</lastBuildDate>'
  || i.items || '</channel></rss>') AS digest FROM n, i UNION ALL
SELECT 'atom', n.items, sha256('<?xml version="1.0" encoding="utf-8"?>' || chr(10) || '<feed xmlns="http://www.w3.org/2005/Atom"><title>Roles</title><link href="https://x.example.com"/><id>https://x.example.com</id><updated>Mon, 31 Dec 2001 00:00:00 +0000</updated>'
  || i.entries || '</feed>') FROM n, i UNION ALL
SELECT 'json', n.items, sha256('{{"version":"https://jsonfeed.org/version/1.1","title":"Roles","home_page_url":"https://x.example.com","feed_url":"https://x.example.com/feeds/jobs.json","description":"New roles","items":[' || json || ']}}') FROM n, i""")
def write_feeds(spark, sf):
    docs = publish.feed_documents(_public(spark, sf), "Roles", "https://x.example.com", "New roles", t.ts(t.AS_OF))
    return docs.select("format", "items", F.sha2("document", 256).alias("digest"))


@query("archive_month", "SELECT strftime(ts, '%Y-%m') AS month, count(*) AS rows FROM events GROUP BY 1")
def archive_month(spark, sf):
    return publish.archive_month(t.table(spark, sf, "events"), publish.scratch_folder(spark, "archive"), F.col("ts"))


@query("save_state", "SELECT event_type, count(*) AS rows FROM events GROUP BY event_type")
def save_state(spark, sf):
    """Two batches and a replay: the replay changes nothing."""
    from vacantic.sources.seeds import read_state
    path = publish.scratch_folder(spark, "state")
    e = t.table(spark, sf, "events")
    publish.save_state(spark, path, {"events": e.where(F.col("ts") < t.ts("2024-01-15 00:00:00"))}, batch_id=0)
    publish.save_state(spark, path, {"events": e}, batch_id=1)
    publish.save_state(spark, path, {"events": e.where(F.lit(False))}, batch_id=1)
    return read_state(spark, path)["events"].groupBy("event_type").agg(F.count("*").alias("rows"))


@query("save_buckets", "SELECT user_id::VARCHAR AS source_id, count(*) AS rows, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id")
def save_buckets(spark, sf):
    """Three batches of events into a state in hash buckets: each reads and rewrites the buckets of its own users only."""
    path = publish.scratch_folder(spark, "buckets")
    e = t.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("source_id"), "event_id", "event_type", "ts")
    layout = state.Layout("source_id", within="event_id", spread=2)
    for low, high in (("2000-01-01", "2024-01-11"), ("2024-01-11", "2024-01-21"), ("2024-01-21", "2100-01-01")):
        batch = e.where((F.col("ts") >= t.ts(f"{low} 00:00:00")) & (F.col("ts") < t.ts(f"{high} 00:00:00")))
        touched = layout.touched(batch.select("source_id"), 64)
        known = state.read_table(spark, path, "events", touched)
        state.commit(spark, path, {"events": (batch if known is None else known.unionByName(batch), layout, touched)}, buckets=64)
    return state.read_table(spark, path, "events").groupBy("source_id").agg(F.count("*").alias("rows"), F.countDistinct("event_type").alias("kinds"))


@query("state_counts", f"""
WITH {POSTINGS}, {SOURCES} SELECT (SELECT count(*) FROM post WHERE lifecycle = 'open') AS open_jobs, (SELECT count(*) FROM post) AS total_jobs, (SELECT count(*) FROM customer) AS companies,
  count(*) FILTER (WHERE enabled) AS sources, count(*) FILTER (WHERE enabled AND health_status = 'healthy') AS healthy_sources, count(DISTINCT adapter) FILTER (WHERE enabled) AS adapters FROM src""")
def state_counts(spark, sf):
    return publish.state_counts(_open(spark, sf), t.postings(spark, sf), t.table(spark, sf, "customer"), t.sources(spark, sf))
