"""First-party test: aggregator hosts and URL patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantic.functions.let import let
from vacantic.functions.urls import canonical_url, host_suffixes, hostname
from vacantic.rules import DENIED_DOMAINS, DENIED_PATTERNS, literal


def denied_host(host: Column, domains: list[str] = DENIED_DOMAINS) -> Column:
    """Matched entry for the host itself, without `www.` or with it; null when allowed."""
    def match(h: Column) -> Column:
        bare = F.regexp_replace(h, r"^www\.", "")
        www = F.concat(F.lit("www."), bare)
        return F.when(h.isin(domains), h).when(bare.isin(domains), bare).when(www.isin(domains), www)

    return let(F.regexp_replace(F.lower(F.trim(host)), r"\.+$", ""), match)


def denied_url(url: Column, domains: list[str] = DENIED_DOMAINS,
               patterns: list[str] = DENIED_PATTERNS) -> Column:
    """struct(reason, matched) when the URL points to an aggregator, else null."""
    def match(canon: Column) -> Column:
        host = denied_host(hostname(canon), domains)
        low = F.lower(canon)
        hit = F.coalesce(*[F.when(low.contains(p.lower()), F.lit(p)) for p in patterns])
        return let(F.struct(host.alias("h"), hit.alias("p")), lambda s: (
            F.when(s["h"].isNotNull(), F.struct(F.lit("domain").alias("reason"), s["h"].alias("matched")))
            .when(s["p"].isNotNull(), F.struct(F.lit("pattern").alias("reason"), s["p"].alias("matched")))))

    return let(canonical_url(url), match)


def domain_blocked(host: Column, domains: list[str] = DENIED_DOMAINS) -> Column:
    """Discovery rule: the host or any parent domain is on the list."""
    return F.coalesce(F.arrays_overlap(host_suffixes(F.lower(host)), literal(domains, "array<string>")),
                      F.lit(False))
