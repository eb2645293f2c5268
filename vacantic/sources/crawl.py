"""Discovery sources: crawl listings, code search hits, text corpora, landed career pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vacantic.functions.urls import detect_platform, detect_platform_page, hostname
from vacantic.rules import CRAWL_URLS_PER_RUN, DISCOVERY_PATTERNS, TENANT_PATTERNS, TENANT_STOPWORDS
from vacantic.sources.boards import is_job_posting, jsonld_nodes


def scan_crawl_index(index: DataFrame, patterns: list[str] | None = None, total: int | None = CRAWL_URLS_PER_RUN,
                     default_confidence: float = 0.55) -> DataFrame:
    """Listing rows -> candidates: fragment off, duplicates off, platform tagged, quota per pattern.

    A row counts for the first pattern its host is under.  The quota is a rank
    limit, which Spark applies before the shuffle as well.
    """
    names = patterns if patterns is not None else DISCOVERY_PATTERNS
    host = hostname(F.col("url"))
    rank = F.coalesce(*[F.when((host == p) | host.endswith("." + p), F.lit(i)) for i, p in enumerate(names)]) \
        if names else F.lit(0)
    base = index.where(F.col("url").isNotNull()).withColumn("pattern_no", rank).where(F.col("pattern_no").isNotNull()) \
        .withColumn("url", F.regexp_replace("url", r"#.*$", ""))
    one = base.groupBy("url").agg(F.min(F.struct("pattern_no", "timestamp")).alias("_m")) \
        .select("url", "_m.pattern_no", "_m.timestamp")
    if total is not None:
        quota = max(1, total // max(1, len(names)))
        w = Window.partitionBy("pattern_no").orderBy("timestamp", "url")
        one = one.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= quota).drop("_n")
    hit = detect_platform(F.col("url"))
    return one.withColumn("_d", hit).select(
        "url", "timestamp", F.col("_d.platform").alias("platform"), F.col("_d.tenant").alias("tenant"),
        F.coalesce("_d.confidence", F.lit(default_confidence)).alias("base_confidence"))


def mine_tenants(texts: DataFrame, column: str, patterns: list[tuple[str, str]] = TENANT_PATTERNS,
                 stopwords: list[str] = TENANT_STOPWORDS) -> DataFrame:
    """Distinct (platform, tenant) named by board URLs anywhere in a text corpus."""
    low = F.lower(F.col(column))

    def pairs(name: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(low, F.lit(pattern), F.lit(1)), lambda t: F.struct(
            F.lit(name).alias("platform"), F.btrim(t, F.lit("-_")).alias("tenant")))

    found = F.flatten(F.array(*[pairs(name, p) for name, p in patterns]))
    return (texts.select(F.inline(found))
            .where(~F.col("tenant").isin(stopwords) & (F.length("tenant") >= 2)).distinct())


def url_from_hit(pattern: Column, html_url: Column) -> Column:
    """Board URL a code-search hit stands for."""
    last = F.element_at(F.split(html_url, "/"), -1)
    hint = F.replace(F.replace(last, F.lit(".md"), F.lit("")), F.lit(".html"), F.lit(""))
    return (F.when(pattern.startswith("https://"), pattern)
            .when(pattern.startswith("http"), F.concat(F.lit("https://"), pattern))
            .when(pattern.contains("greenhouse.io"), F.concat(F.lit("https://boards.greenhouse.io/"), hint))
            .when(pattern.contains("lever.co"), F.concat(F.lit("https://jobs.lever.co/"), hint))
            .when(pattern.contains("ashbyhq.com"), F.concat(F.lit("https://jobs.ashbyhq.com/"), hint))
            .otherwise(F.concat(F.lit("https://"), pattern)))


def scan_code_search(hits: DataFrame, limit: int | None = None) -> DataFrame:
    """hits(pattern, html_url, repository, path) -> candidates, confidence 0.5 without a platform."""
    base = hits.withColumn("url", url_from_hit(F.col("pattern"), F.col("html_url")))
    out = base.withColumn("_d", detect_platform(F.col("url"))).select(
        "url", "repository", "path", F.col("_d.platform").alias("platform"), F.col("_d.tenant").alias("tenant"),
        F.coalesce("_d.confidence", F.lit(0.5)).alias("base_confidence"))
    return out.orderBy("repository", "path", "url").limit(limit) if limit is not None else out


def has_posting_jsonld(html: Column) -> Column:
    return F.exists(jsonld_nodes(html), is_job_posting)


def inspect_sites(pages: DataFrame) -> DataFrame:
    """pages(domain, url, html) -> best platform per domain.

    The strongest page wins, the smallest URL on a tie; a posting in JSON-LD is
    worth 0.65; any page at all gives 0.5.
    """
    base = pages.select(F.lower(F.trim("domain")).alias("domain"), "url", "html") \
        .withColumn("_jsonld", has_posting_jsonld(F.col("html"))) \
        .withColumn("_d", detect_platform_page(F.col("url"), F.col("html")))
    slim = base.select("domain", "url", "_jsonld", "_d")
    agg = slim.groupBy("domain").agg(
        F.count("*").alias("pages"), F.bool_or("_jsonld").alias("has_json_ld_jobs"),
        F.min(F.when(F.col("_d").isNotNull(), F.struct(
            (-F.col("_d.confidence")).alias("o"), F.col("url"), F.col("_d.platform").alias("platform"),
            F.col("_d.tenant").alias("tenant")))).alias("_b"))
    strength = -F.col("_b.o")
    jsonld = F.col("has_json_ld_jobs")
    beaten = jsonld & (F.coalesce(strength, F.lit(0.0)) <= 0.65)
    return agg.select(
        "domain", "pages", "has_json_ld_jobs",
        F.when(beaten, F.lit("json_ld")).otherwise(F.col("_b.platform")).alias("platform"),
        F.when(~beaten, F.col("_b.tenant")).alias("tenant"),
        F.greatest(F.coalesce(strength, F.lit(0.0)), F.when(jsonld, F.lit(0.65)).otherwise(F.lit(0.0)), F.lit(0.5))
        .alias("confidence"))


def sitemap_urls(files: DataFrame, per_file: int = 10) -> DataFrame:
    """Sitemap files(domain, body) -> distinct `<loc>` URLs about careers, the first ten of each file."""
    # fixed values: words that mark a career URL
    words = ["career", "job", "join"]
    locs = F.regexp_extract_all(F.col("body"), F.lit(r"(?i)<loc>([^<]+)</loc>"), F.lit(1))

    def about_careers(u: Column) -> Column:
        low = F.lower(u)
        return low.contains(words[0]) | low.contains(words[1]) | low.contains(words[2])

    return files.select("domain", F.explode(F.slice(F.filter(locs, about_careers), 1, per_file)).alias("url")).distinct()
