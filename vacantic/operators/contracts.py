"""Contract checks as single aggregations: how many rows break which rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantic.functions.ids import bucket
from vacantic.functions.text import canonical_text, html_to_text, normalize_ws
from vacantic.operators.scale import side_by_side
from vacantic.rules import EARLY_LEVELS, HASH_BUCKETS, SUMMARY_MAX_CHARS

# fixed values: allowed values of the coded columns
LIFECYCLES = ["open", "suspected_closed", "closed", "reopened", "quarantined"]
EMPLOYMENT = ["full_time", "part_time", "contract", "temporary", "internship", "unknown"]
WORKPLACES = ["onsite", "hybrid", "remote", "unknown"]
TERMS = ["winter", "spring", "summer", "fall", "rolling", "off_cycle", "unknown"]
EVENT_TYPES = ["OPENED", "UPDATED", "CLOSED", "REOPENED"]


def required(name: str) -> Column:
    return F.col(name).isNotNull()


def filled(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) != ""


def one_of(name: str, values: list) -> Column:
    return F.coalesce(F.col(name).isin(values), F.lit(False))


def at_most(name: str, n: int) -> Column:
    return F.col(name).isNull() | (F.length(name) <= n)


def between(name: str, low: float, high: float) -> Column:
    return F.coalesce(F.col(name).between(low, high), F.lit(False))


def posting_rules() -> dict[str, Column]:
    return {
        "job_id is 64 hex": F.coalesce(F.col("job_id").rlike("^[0-9a-f]{64}$"), F.lit(False)),
        "title is filled": filled("title"), "company_id is filled": filled("company_id"),
        "job_url is filled": filled("job_url"), "first_seen_at is set": required("first_seen_at"),
        "last_seen_at is set": required("last_seen_at"),
        "career_level is known": one_of("career_level", [*EARLY_LEVELS, "unknown"]),
        "confidence in [0,1]": between("career_level_confidence", 0.0, 1.0),
        "employment_type is known": one_of("employment_type", EMPLOYMENT),
        "workplace_type is known": one_of("workplace_type", WORKPLACES),
        "academic_term is known": one_of("academic_term", TERMS), "lifecycle is known": one_of("lifecycle", LIFECYCLES),
        "summary length": at_most("summary", SUMMARY_MAX_CHARS),
        "currency length": at_most("compensation.currency", 3),
        "country code length": F.coalesce(F.forall("locations", lambda p: p["country_code"].isNull() | (F.length(p["country_code"]) <= 2)), F.lit(True)),
    }


def event_rules() -> dict[str, Column]:
    return {"event_type is known": one_of("event_type", EVENT_TYPES), "job_id is filled": filled("job_id"),
            "timestamp is set": required("timestamp")}


def check_contract(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Q1: rows (rule, violations, rows); one pass over the table, however many rules there are."""
    one = df.agg(F.count("*").alias("_n"), *[F.count_if(~test).alias(f"_r{i}") for i, test in enumerate(rules.values())])
    cells = [F.struct(F.lit(name).alias("rule"), F.col(f"_r{i}").alias("violations"), F.col("_n").alias("rows"))
             for i, name in enumerate(rules)]
    return one.select(F.inline(F.array(*cells)))


def check_text_invariants(df: DataFrame, column: str) -> DataFrame:
    """Q2: cleaning twice is cleaning once."""
    base = df.select(normalize_ws(F.col(column)).alias("n"), canonical_text(F.col(column)).alias("c"),
                     html_to_text(F.col(column)).alias("p"))
    twice = base.select("n", "c", normalize_ws(F.col("n")).alias("n2"), canonical_text(F.col("c")).alias("c2"))
    return check_contract(twice, {"normalize_ws is idempotent": F.col("n") == F.col("n2"),
                                  "canonical_text is idempotent": F.col("c") == F.col("c2")})


def check_bucket_invariants(df: DataFrame, key: str = "job_id", buckets: int = HASH_BUCKETS) -> DataFrame:
    """Q2: ids are 64 hex digits, every row has one bucket, bucket counts add up to the total."""
    total = df.agg(F.count("*").alias("rows"), F.count_if(~F.col(key).rlike("^[0-9a-f]{64}$")).alias("bad_ids"))
    shards = df.groupBy(bucket(F.col(key), buckets).alias("bucket")).agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("sharded"), F.count("*").alias("buckets_used"),
        F.coalesce(F.count_if((F.col("bucket") < 0) | (F.col("bucket") >= buckets)), F.lit(0)).alias("bad_buckets"))
    return side_by_side(total, shards).select("rows", "sharded", "bad_ids", "bad_buckets", "buckets_used")
