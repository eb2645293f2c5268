"""Search over postings: rows, filters, facets, sorting, paging, statistics."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantic.functions.ids import bucket, slug
from vacantic.functions.times import posted_at, within_window
from vacantic.operators.filters import (confirmed_flags, has_benefits, hide_dismissed, in_region, is_startup,
                                        match_query, one_of, open_to_origin, regions, saved_only)
from vacantic.operators.scale import durable, group_rank
from vacantic.rules import DISCIPLINES, HASH_BUCKETS, STARTUPS, lookup

# above this many leading rows a page is cut by rank instead of by a driver-side top-k
DEEP_PAGE_ROWS = 100_000


@dataclass(frozen=True)
class FilterSpec:
    """What a search asks for; empty values ask for nothing."""

    q: str = ""
    career_levels: list[str] = field(default_factory=list)
    disciplines: list[str] = field(default_factory=list)
    regions: list[str] = field(default_factory=list)
    workplace_types: list[str] = field(default_factory=list)
    academic_terms: list[str] = field(default_factory=list)
    company_ids: list[str] = field(default_factory=list)
    startups_only: bool = False
    freshness: str = "all"
    mobility: list[str] = field(default_factory=list)
    origin_country: str = ""
    saved_only: bool = False
    hide_dismissed: bool = False
    sort: str = "diverse"
    page: int = 1
    page_size: int = 25
    startups: list[str] = field(default_factory=lambda: STARTUPS)


# --- rows ------------------------------------------------------------------------------------------
def location_text(locations: Column) -> Column:
    def one(p: Column) -> Column:
        parts = F.filter(F.array(p["city"], p["region"], p["country"], p["raw"]),
                         lambda x: F.coalesce(x, F.lit("")) != "")
        return F.array_join(parts, ", ")

    return F.lower(F.array_join(F.transform(locations, one), " | "))


def project_search(postings: DataFrame, buckets: int = HASH_BUCKETS) -> DataFrame:
    """C14: one flat, lower-cased row per posting for matching."""
    return postings.select(
        "job_id", "company_id", "company_name", slug(F.col("company_name")).alias("company_slug"), "title",
        F.lower("title").alias("title_lower"), "career_level", F.col("disciplines.primary").alias("discipline"),
        location_text(F.col("locations")).alias("location_text"), "workplace_type",
        posted_at(F.col("source_posted_at"), F.col("first_seen_at")).alias("posted_at"), "first_seen_at",
        confirmed_flags(F.col("mobility")).alias("mobility_flags"), bucket(F.col("job_id"), buckets).alias("bucket"))


def display_location(locations: Column) -> Column:
    """First place and how many more."""
    none = F.lit("Location not specified")
    first = F.get(locations, F.lit(0))
    parts = F.filter(F.array(first["city"], first["region"], first["country"]),
                     lambda x: F.coalesce(x, F.lit("")) != "")
    more = F.when(F.size(locations) > 1, F.concat(F.lit(" +"), (F.size(locations) - 1).cast("string"))) \
        .otherwise(F.lit(""))
    return F.when(F.coalesce(F.size(locations), F.lit(0)) <= 0, none) \
        .when(F.size(parts) > 0, F.concat(F.array_join(parts, ", "), more)).otherwise(F.coalesce(first["raw"], none))


def discipline_label(ident: Column, labels: dict[str, str] | None = None) -> Column:
    """Display label of a discipline id; unknown ids are spelled out."""
    table = labels or {i: label for i, label, _ in DISCIPLINES}
    words = F.filter(F.split(ident, "_"), lambda w: w != "")
    spelled = F.array_join(F.transform(words, lambda w: F.concat(
        F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), " ")
    return F.coalesce(lookup(table, ident), spelled)


def haystack() -> Column:
    """The text that D5 searches: title, employer, places and discipline of a posting."""
    return F.concat_ws(" ", F.lower("title"), F.lower("company_name"), location_text(F.col("locations")), F.col("disciplines.primary"))


# --- filter ----------------------------------------------------------------------------------------
def predicate(spec: FilterSpec, as_of: Column | None = None, last_visit: Column | None = None) -> Column:
    """L1: one Boolean column; cheap equality tests come first, text tests last."""
    c = F.col
    posted = posted_at(c("source_posted_at"), c("first_seen_at"))
    tests = [one_of(c("career_level"), spec.career_levels),
             one_of(c("disciplines.primary"), spec.disciplines),
             one_of(c("workplace_type"), spec.workplace_types),
             one_of(c("academic_term"), spec.academic_terms),
             one_of(c("company_id"), spec.company_ids)]
    if spec.freshness != "all":
        tests.append(within_window(posted, spec.freshness, as_of if as_of is not None else F.lit(None), last_visit))
    if spec.mobility:
        tests.append(has_benefits(c("mobility"), spec.mobility))
    if spec.origin_country:
        tests.append(open_to_origin(c("eligibility.explicit_allowed_countries"),
                                    c("eligibility.explicit_excluded_countries"), spec.origin_country))
    if spec.startups_only:
        tests.append(is_startup(c("company_name"), spec.startups))
    if spec.regions:
        tests.append(in_region(regions(c("workplace_type"), c("locations")), spec.regions))
    if spec.q.strip():
        tests.append(match_query(haystack(), spec.q))
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def filter_postings(postings: DataFrame, spec: FilterSpec, as_of: Column | None = None,
                    last_visit: Column | None = None, saved: DataFrame | None = None,
                    dismissed: DataFrame | None = None) -> DataFrame:
    """L1 without the sort."""
    out = postings.where(predicate(spec, as_of, last_visit))
    if spec.hide_dismissed and dismissed is not None:
        out = hide_dismissed(out, dismissed)
    if spec.saved_only:
        out = saved_only(out, saved) if saved is not None else out.where(F.lit(False))
    return out


def join_index(postings: DataFrame, index: DataFrame) -> DataFrame:
    """Only rows that are in the search index."""
    return postings.join(index.select("job_id"), "job_id", "left_semi")


# --- order and pages ----------------------------------------------------------------------------------
def diversify(postings: DataFrame, parts: int | None = None) -> DataFrame:
    """Adds `company_rank` and `company_top`: the n-th newest posting of every company before any n+1-th.

    Every row gets one rank, also rows with a null or repeated job id: ranks join back by a row number, written out first.
    """
    posted = posted_at(F.col("source_posted_at"), F.col("first_seen_at"))
    rows = durable(postings.withColumn("_row", F.monotonically_increasing_id()))
    slim = rows.select("company_id", "job_id", posted.alias("_posted"), "_row")
    ranked = group_rank(slim, ["company_id"], [F.col("_posted").desc(), F.col("job_id"), F.col("_row")], "company_rank", parts)
    top = ranked.where("company_rank = 1").select(F.col("company_id").alias("_c"), F.col("_posted").alias("company_top"))
    placed = ranked.join(top, F.col("company_id").eqNullSafe(F.col("_c"))).select("_row", "company_rank", "company_top")
    return rows.join(placed, "_row").drop("_row")


def sort_keys(mode: str, collation: str | None = None) -> list[Column]:
    """H1: sort columns of a mode; the job id makes every order total."""
    def name(c: str) -> Column:
        return F.collate(F.col(c), collation) if collation else F.col(c)

    newest = posted_at(F.col("source_posted_at"), F.col("first_seen_at")).desc()
    return {
        "company": [name("company_name"), name("title"), F.col("job_id")],
        "title": [name("title"), name("company_name"), F.col("job_id")],
        "newest": [newest, F.col("job_id")],
        "diverse": [F.col("company_rank"), F.col("company_top").desc(), name("company_name"), F.col("company_id"),
                    F.col("job_id")],
    }[mode]


def sort_postings(postings: DataFrame, mode: str = "diverse", collation: str | None = None) -> DataFrame:
    """H1: newest, company, title or diverse; binary order unless a collation is named."""
    base = diversify(postings) if mode == "diverse" else postings
    return base.orderBy(*sort_keys(mode, collation))


def page(df: DataFrame, keys: list[Column], number: int, size: int) -> DataFrame:
    """H2: page `number` (from 1) of `size` rows in the order of `keys`.

    A shallow page is a top-k.  A deep one is cut by an exact distributed rank,
    so its leading rows never gather in one place.
    """
    start = (max(1, number) - 1) * size
    if start + size <= DEEP_PAGE_ROWS:
        return df.orderBy(*keys).offset(start).limit(size)
    ranked = group_rank(df, [], keys, "_n")
    return ranked.where(F.col("_n").between(start + 1, start + size)).orderBy("_n").drop("_n")


def page_count(df: DataFrame, size: int) -> DataFrame:
    """H2: number of rows and pages, one page at least."""
    return df.agg(F.count("*").alias("rows")).select(
        "rows", F.greatest(F.lit(1), F.ceil(F.col("rows") / size)).cast("long").alias("pages"))


def newest_n(postings: DataFrame, n: int) -> DataFrame:
    """H3: the n newest rows, one top-k."""
    return postings.orderBy(*sort_keys("newest")).limit(n)


def search(postings: DataFrame, spec: FilterSpec, as_of: Column | None = None, last_visit: Column | None = None,
           saved: DataFrame | None = None, dismissed: DataFrame | None = None) -> DataFrame:
    """L1: filter, sort, one page."""
    found = filter_postings(postings, spec, as_of, last_visit, saved, dismissed)
    if spec.sort == "diverse":
        found = diversify(found)
    return page(found, sort_keys(spec.sort), spec.page, spec.page_size)


def company_search(postings: DataFrame, company_slug: str, spec: FilterSpec, **options) -> DataFrame:
    """L3: the same search within one company."""
    return search(postings.where(slug(F.col("company_name")) == company_slug), spec, **options)


def point_lookup(table: DataFrame, ident: str, key: str = "job_id", buckets: int = HASH_BUCKETS) -> DataFrame:
    """L2: one row by id; with a `bucket` partition column only that partition is read."""
    out = table.where(F.col(key) == ident)
    if "bucket" in table.columns:
        import hashlib
        wanted = int(hashlib.sha256(ident.encode()).hexdigest()[:8], 16) % buckets
        out = out.where(F.col("bucket") == wanted)
    return out


# --- aggregates ------------------------------------------------------------------------------------------
def facet_counts(postings: DataFrame, startups: list[str] = STARTUPS) -> DataFrame:
    """rows (facet, value, postings) in one aggregation over exploded facet values."""
    def cell(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("facet"), value.alias("value"))

    singles = F.array(
        cell("discipline", F.when(F.coalesce(F.col("disciplines.primary"), F.lit("other")) != "other",
                                  F.col("disciplines.primary"))),
        cell("career_level", F.col("career_level")), cell("workplace_type", F.col("workplace_type")),
        cell("academic_term", F.when(F.col("academic_term") != "unknown", F.col("academic_term"))),
        cell("startup", F.when(is_startup(F.col("company_name"), startups), F.lit("startup"))))
    areas = F.transform(regions(F.col("workplace_type"), F.col("locations")), lambda r: cell("region", r))
    flags = F.transform(confirmed_flags(F.col("mobility")), lambda f: cell("mobility", f))
    cells = F.filter(F.concat(singles, areas, flags), lambda s: s["value"].isNotNull())
    return postings.select(F.inline(cells)).groupBy("facet", "value").agg(F.count("*").alias("postings"))


def company_summary(postings: DataFrame) -> DataFrame:
    """postings per company, with slug, by name; the name of the smallest job id wins."""
    return (postings.groupBy("company_id")
            .agg(F.min_by("company_name", "job_id").alias("name"), F.count("*").alias("job_count"))
            .select("company_id", "name", slug(F.col("name")).alias("slug"), "job_count").orderBy("name", "company_id"))


def site_stats(postings: DataFrame, last_visit: Column | None = None) -> DataFrame:
    """totals of the published set, one row."""
    posted = posted_at(F.col("source_posted_at"), F.col("first_seen_at"))
    fresh = F.count_if(posted > last_visit) if last_visit is not None else F.lit(0).cast("long")
    return postings.agg(
        F.count("*").alias("total_jobs"), F.countDistinct("company_id").alias("total_companies"),
        F.count_if(F.col("mobility.visa_sponsorship.status") == "confirmed").alias("with_visa"),
        F.count_if(F.col("mobility.relocation_assistance.status") == "confirmed").alias("with_relocation"),
        F.count_if(F.col("workplace_type") == "remote").alias("remote_count"), fresh.alias("new_since_visit"))


def company_pages(postings: DataFrame) -> DataFrame:
    """distinct company slugs of public rows."""
    return postings.select(slug(F.col("company_name")).alias("slug")).where(F.col("slug") != "").distinct()


def new_arrivals(current: DataFrame, known: DataFrame, key: str = "job_id") -> DataFrame:
    """Ids that were not known before."""
    return current.join(known.select(key).distinct(), key, "left_anti")
