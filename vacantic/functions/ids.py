"""Identifiers, slugs and buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantic.rules import HASH_BUCKETS


def slug(name: Column) -> Column:
    """Lower case, runs of other characters become one hyphen, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "-"), F.lit("-"))


def deterministic_id(*parts: Column, length: int = 16) -> Column:
    """First hex digits of sha256 over the lower-cased, trimmed, non-empty parts."""
    kept = F.filter(F.array(*parts), lambda p: F.coalesce(p, F.lit("")) != "")
    cleaned = F.transform(kept, lambda p: F.lower(F.trim(p)))
    return F.substring(F.sha2(F.array_join(cleaned, "|"), 256), 1, length)


def company_id(domain: Column) -> Column:
    return deterministic_id(F.lit("company"), domain)


def source_id(domain: Column, adapter: Column, tenant: Column) -> Column:
    return deterministic_id(F.lit("source"), domain, adapter, tenant)


def job_id(adapter: Column, tenant: Column, source_job_id: Column) -> Column:
    """sha256 of adapter:tenant:source id."""
    return F.sha2(F.concat_ws(":", adapter, tenant, source_job_id), 256)


def bucket(ident: Column, buckets: int = HASH_BUCKETS) -> Column:
    """First eight hex digits of sha256, modulo the number of buckets."""
    head = F.conv(F.substring(F.sha2(ident, 256), 1, 8), 16, 10).cast("long")
    return F.pmod(head, F.lit(buckets).cast("long")).cast("int")
