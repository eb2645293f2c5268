"""Predicates: what is published, and what a search asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantic.functions.denylist import denied_url
from vacantic.functions.ids import slug
from vacantic.functions.text import canonical_text
from vacantic.rules import (BENEFIT_FLAGS, CLOSED_APPLICATIONS, EARLY_LEVELS, MIN_PUBLIC_CONFIDENCE, NOISE_TITLE,
                            ORIGIN_ALIASES, PUBLIC_DISCIPLINES, REGION_CODES, REGION_CONTINENTS, REGION_WORDS,
                            RELEVANT_TITLE, STARTUPS, lookup)


# --- publication ----------------------------------------------------------------------------------
def applications_open(canon_text: Column, apply_url: Column, job_url: Column) -> Column:
    """Both URLs are there and the text does not say that applications are closed."""
    has_urls = (F.coalesce(apply_url, F.lit("")) != "") & (F.coalesce(job_url, F.lit("")) != "")
    return has_urls & ~canon_text.rlike(CLOSED_APPLICATIONS)


def is_relevant(title: Column, primary: Column, disciplines: list[str] = PUBLIC_DISCIPLINES,
                relevant: str = RELEVANT_TITLE, noise: str = NOISE_TITLE) -> Column:
    """D3: no noise title, and a listed discipline or a matching title."""
    t = F.coalesce(title, F.lit(""))
    return ~t.rlike(noise) & (F.lower(F.coalesce(primary, F.lit(""))).isin(disciplines) | t.rlike(relevant))


def publishable(df: DataFrame, min_confidence: float = MIN_PUBLIC_CONFIDENCE, levels: list[str] = EARLY_LEVELS,
                disciplines: list[str] = PUBLIC_DISCIPLINES, relevant: str = RELEVANT_TITLE,
                noise: str = NOISE_TITLE) -> DataFrame:
    """Public rows. Column tests run first and reach the scan; only survivors get the text test."""
    cheap = df.where(
        F.col("lifecycle").isin("open", "reopened") & F.col("career_level").isin(levels)
        & (F.col("career_level_confidence") >= min_confidence)
        & (F.coalesce(F.col("apply_url"), F.lit("")) != "") & (F.coalesce(F.col("job_url"), F.lit("")) != "")
        & is_relevant(F.col("title"), F.col("disciplines.primary"), disciplines, relevant, noise))
    blob = canonical_text(F.concat_ws(" ", F.col("title"), F.coalesce(F.col("summary"), F.lit(""))))
    return (cheap.withColumn("_blob", blob)
            .where(applications_open(F.col("_blob"), F.col("apply_url"), F.col("job_url"))).drop("_blob"))


def first_party(df: DataFrame, url: str) -> DataFrame:
    """Rows whose URL is not an aggregator's."""
    return df.where(denied_url(F.col(url)).isNull())


# --- search -------------------------------------------------------------------------------------------
def query_tokens(query: str) -> list[str]:
    return [t for t in query.lower().split() if len(t) >= 2]


def match_query(haystack: Column, query: str) -> Column:
    """Every token of two or more characters occurs in the lower-cased text."""
    out = F.lit(True)
    for t in query_tokens(query):
        out = out & haystack.contains(t)
    return out


def one_of(column: Column, values: list | tuple | None) -> Column:
    """Facet filter; an empty list lets everything through."""
    return column.isin(list(values)) if values else F.lit(True)


def confirmed_flags(mobility: Column, flags: dict[str, str] = BENEFIT_FLAGS) -> Column:
    """Search flags whose claim is confirmed, in flag order."""
    cells = [F.when(mobility[claim]["status"] == "confirmed", F.lit(flag)) for flag, claim in flags.items()]
    return F.filter(F.array(*cells), lambda f: f.isNotNull())


def has_benefits(mobility: Column, asked: list[str], flags: dict[str, str] = BENEFIT_FLAGS) -> Column:
    """Every asked flag is confirmed."""
    out = F.lit(True)
    for a in asked:
        out = out & F.coalesce(mobility[flags[a]]["status"] == "confirmed", F.lit(False))
    return out


def origin_code(value: Column) -> Column:
    v = F.trim(value)
    return F.coalesce(lookup(ORIGIN_ALIASES, F.lower(v)), F.upper(v))


def origin_code_of(value: str) -> str:
    v = value.strip()
    return ORIGIN_ALIASES.get(v.lower(), v.upper())


def open_to_origin(allowed: Column, excluded: Column, origin: str) -> Column:
    """The country is not excluded, and allowed when there is an allow list."""
    if not origin.strip():
        return F.lit(True)
    code = F.lit(origin_code_of(origin))
    no = F.array().cast("array<string>")
    a = F.transform(F.coalesce(allowed, no), origin_code)
    x = F.transform(F.coalesce(excluded, no), origin_code)
    return ~F.array_contains(x, code) & ((F.size(a) == 0) | F.array_contains(a, code))


def regions(workplace: Column, locations: Column) -> Column:
    """Search regions of a posting (na, eu, asia, remote) from code, continent or wording."""
    def of_place(p: Column) -> Column:
        code = F.upper(F.coalesce(p["country_code"], F.lit("")))
        continent = F.lower(F.coalesce(p["continent"], F.lit("")))
        blob = F.lower(F.concat_ws(" ", F.coalesce(p["country"], F.lit("")), F.coalesce(p["raw"], F.lit(""))))
        by_code = [F.when(code.isin(REGION_CODES[r]) | continent.contains(REGION_CONTINENTS[r]), F.lit(r))
                   for r in REGION_CODES]
        by_word = []
        for r, words in REGION_WORDS.items():
            test = F.lit(False)
            for w in words:
                test = test | blob.contains(w)
            by_word.append(F.when(test, F.lit(r)))
        return F.array(F.coalesce(*by_code, *by_word), F.when(blob.contains("remote"), F.lit("remote")))

    found = F.coalesce(F.flatten(F.transform(locations, of_place)), F.array().cast("array<string>"))
    everything = F.concat(F.array(F.when(workplace == "remote", F.lit("remote"))), found)
    return F.array_distinct(F.filter(everything, lambda r: r.isNotNull()))


def in_region(found: Column, asked: list[str]) -> Column:
    if not asked:
        return F.lit(True)
    return F.arrays_overlap(found, F.array(*[F.lit(r) for r in asked]))


def saved_only(df: DataFrame, saved: DataFrame, key: str = "job_id") -> DataFrame:
    """Keep saved rows (left semi join)."""
    return df.join(saved.select(key), key, "left_semi")


def hide_dismissed(df: DataFrame, dismissed: DataFrame, key: str = "job_id") -> DataFrame:
    """Drop dismissed rows (left anti join)."""
    return df.join(dismissed.select(key), key, "left_anti")


def watch_match(text: Column, keywords: list[str], places: list[str]) -> Column:
    """Any keyword and any place in the lower-cased text; empty lists ask for nothing."""
    low = F.lower(text)

    def some(words: list[str]) -> Column:
        if not words:
            return F.lit(True)
        out = F.lit(False)
        for w in words:
            out = out | low.contains(w)
        return out

    return some(keywords) & some(places)


def startup_slugs(names: list[str] = STARTUPS) -> list[str]:
    import re
    return sorted({re.sub(r"[^a-z0-9]+", "-", n.lower()).strip("-") for n in names})


def is_startup(company_name: Column, names: list[str] = STARTUPS) -> Column:
    """The company's slug is in the curated set (a bounded list, so no join)."""
    return slug(company_name).isin(startup_slugs(names))
