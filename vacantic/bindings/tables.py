"""The sample tables read as postings, companies, sources, polls, texts and URLs.

Nothing is made up: every row is a row of the given tables under other column
names, or is aggregated from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantic.functions import ids
from vacantic.operators.scale import spread

AS_OF = "2001-12-31 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"
# o_orderpriority -> career level, p_type -> discipline
LEVELS = {"1-URGENT": "internship", "2-HIGH": "co_op", "3-MEDIUM": "new_grad", "4-NOT SPECIFIED": "entry_level", "5-LOW": "unknown"}
STATES = {"O": "open", "P": "suspected_closed", "F": "closed"}
ADAPTERS = ["greenhouse", "lever", "ashby", "smartrecruiters", "workday", "workable", "json_ld", "simplify"]


def ts(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    # times without a zone are UTC, as everywhere in the data model
    zoned = {f.name: F.col(f.name).cast("timestamp") for f in df.schema if f.dataType.typeName() == "timestamp_ntz"}
    return df.withColumns(zoned) if zoned else df


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """documents, spread over all cores: text work is heavy and the sample is a single split."""
    return spread(table(spark, sf, "documents"))


def case(column: Column, mapping: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in mapping.items():
        out = F.when(column == k, F.lit(v)).otherwise(out)
    return out


def order_parts(spark: SparkSession, sf: str) -> DataFrame:
    """One row per order: its first line's part gives title and discipline."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("p_partkey"))
    orders = table(spark, sf, "orders")
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_size")
    return orders.join(li, orders.o_orderkey == li.l_orderkey, "left").drop("l_orderkey").join(part, "p_partkey", "left")


def postings(spark: SparkSession, sf: str) -> DataFrame:
    """orders + lineitem + part + customer + nation + region as postings."""
    c = F.col
    base = order_parts(spark, sf)
    cust = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    place = table(spark, sf, "nation").join(table(spark, sf, "region"), c("n_regionkey") == c("r_regionkey"), "left")
    place = place.select("n_nationkey", "n_name", "r_name")
    df = base.join(cust, c("o_custkey") == c("c_custkey"), "left").join(place, c("c_nationkey") == c("n_nationkey"), "left")

    def claim(test: Column) -> Column:
        return F.struct(F.when(test, "confirmed").otherwise("unknown").alias("status"))

    key = c("o_orderkey")
    return df.select(
        ids.job_id(F.lit("orders"), F.lit("tpch"), key.cast("string")).alias("job_id"), key.cast("string").alias("source_job_id"),
        c("o_custkey").cast("string").alias("company_id"), F.coalesce("c_name", F.lit("")).alias("company_name"),
        F.coalesce("p_name", F.lit("untitled")).alias("title"),
        F.concat(F.lit("https://jobs.example.com/"), key.cast("string")).alias("job_url"),
        F.concat(F.lit("https://jobs.example.com/"), key.cast("string"), F.lit("/apply")).alias("apply_url"),
        F.concat_ws(" ", c("p_name"), c("p_type"), c("o_orderpriority")).alias("summary"),
        case(c("o_orderpriority"), LEVELS).alias("career_level"), (F.least(c("o_totalprice") / 500000.0, F.lit(1.0))).alias("career_level_confidence"),
        F.when(c("p_size") % 2 == 0, "full_time").otherwise("internship").alias("employment_type"),
        F.struct(F.coalesce(F.lower("p_type"), F.lit("other")).alias("primary")).alias("disciplines"),
        F.array(F.struct(
            F.concat_ws(", ", "n_name", "r_name").alias("raw"), F.lit(None).cast("string").alias("city"),
            F.lit(None).cast("string").alias("region"), c("n_name").alias("country"), F.lit(None).cast("string").alias("country_code"),
            F.when(c("r_name") == "AMERICA", "North America").otherwise(F.col("r_name")).alias("continent"))).alias("locations"),
        F.when(c("p_size") % 3 == 0, "remote").when(c("p_size") % 3 == 1, "onsite").otherwise("hybrid").alias("workplace_type"),
        F.when(F.month("o_orderdate").isin(6, 7, 8), "summer").when(F.month("o_orderdate").isin(9, 10, 11), "fall")
        .when(F.month("o_orderdate").isin(12, 1, 2), "winter").otherwise("unknown").alias("academic_term"),
        F.struct(claim(c("o_totalprice") > 300000).alias("visa_sponsorship"), claim(c("o_totalprice") > 400000).alias("relocation_assistance"),
                 claim(c("p_size") > 40).alias("housing_provided"), claim(c("p_size") > 45).alias("airfare")).alias("mobility"),
        F.struct(F.when(c("p_size") % 5 == 0, F.array(F.lit("Canada"))).otherwise(F.array().cast("array<string>")).alias("explicit_allowed_countries"),
                 F.when(c("p_size") % 7 == 0, F.array(F.lit("usa"))).otherwise(F.array().cast("array<string>")).alias("explicit_excluded_countries")).alias("eligibility"),
        F.when(c("o_orderstatus") != "P", c("o_orderdate").cast("timestamp")).alias("source_posted_at"),
        c("o_orderdate").cast("timestamp").alias("first_seen_at"), F.date_add(c("o_orderdate").cast("date"), 30).cast("timestamp").alias("last_seen_at"),
        case(c("o_orderstatus"), STATES).alias("lifecycle"), key)


def sightings(spark: SparkSession, sf: str) -> DataFrame:
    """events: a user is a source, a day is a poll, an event type is a posting."""
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").cast("string").alias("source_id"), F.col("event_type").alias("posting_id"),
                    F.date_trunc("day", "ts").cast("timestamp").alias("poll_ts"))


def day_polls(spark: SparkSession, sf: str) -> DataFrame:
    return sightings(spark, sf).select("source_id", "poll_ts").distinct()


def polls(spark: SparkSession, sf: str) -> DataFrame:
    """events: every event is a poll of its user's source; `error` events failed."""
    e = table(spark, sf, "events")
    return e.select(
        F.col("user_id").cast("string").alias("source_id"), F.concat(F.lit("adapter-"), (F.col("user_id") % 7).cast("string")).alias("adapter"),
        F.col("ts").alias("poll_ts"), F.col("event_id").alias("poll_id"),
        F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "not_modified").otherwise("ok").alias("outcome"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("message"))


def seeds_raw(spark: SparkSession, sf: str) -> DataFrame:
    """supplier as hand-kept seed entries."""
    s = table(spark, sf, "supplier")
    names = F.array(*[F.lit(a) for a in ADAPTERS])
    return s.select(
        F.concat(F.lit("  "), F.col("s_name"), F.lit(" ")).alias("company"),
        F.concat(F.lit("Supplier-"), F.col("s_suppkey").cast("string"), F.lit(".Example.com")).alias("domain"),
        F.upper(F.get(names, (F.col("s_nationkey") % 8).cast("int"))).alias("adapter"),
        F.concat(F.lit("Tenant"), F.col("s_suppkey").cast("string")).alias("tenant"))


def sources(spark: SparkSession, sf: str) -> DataFrame:
    """supplier as polled sources."""
    s = table(spark, sf, "supplier")
    names = F.array(*[F.lit(a) for a in ADAPTERS])
    tiers = F.array(*[F.lit(t) for t in ("hot", "warm", "cold", "dormant", "other")])
    dom = F.concat(F.lit("supplier-"), F.col("s_suppkey").cast("string"), F.lit(".example.com"))
    adapter = F.get(names, (F.col("s_nationkey") % 8).cast("int"))
    tenant = F.concat(F.lit("tenant"), F.col("s_suppkey").cast("string"))
    bal = F.col("s_acctbal")
    return s.select(
        ids.source_id(dom, adapter, tenant).alias("source_id"), ids.company_id(dom).alias("company_id"), F.col("s_name").alias("company_name"),
        dom.alias("company_domain"), F.concat(F.lit("https://"), dom, F.lit("/careers")).alias("careers_url"), adapter.alias("adapter"),
        tenant.alias("adapter_tenant"), F.lit("seed").alias("discovered_via"), F.lit(0.6).alias("discovery_confidence"),
        ts(AS_OF).alias("first_discovered_at"), ts(AS_OF).alias("last_validated_at"),
        F.when(bal < 0, 12).when(bal < 2000, 4).otherwise(0).alias("consecutive_failures"),
        F.get(tiers, (F.col("s_suppkey") % 5).cast("int")).alias("poll_tier"),
        F.when(F.col("s_suppkey") % 4 != 0, F.timestamp_seconds(F.lit(978307200) + F.floor(bal).cast("long") * 60)).alias("next_due_at"),
        F.when(bal < 0, "disabled").when(bal < 2000, "degraded").otherwise("healthy").alias("health_status"),
        (F.col("s_suppkey") % 10 != 0).alias("enabled"))


def page_urls(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", "url")


def board_links(spark: SparkSession, sf: str) -> DataFrame:
    """pages as links to boards: each page's site name becomes a tenant on a platform chosen by its id."""
    p = spread(table(spark, sf, "pages"))
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    site = F.element_at(F.split(host, r"\."), -3)
    path = F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1)
    heads = ["https://boards.greenhouse.io/", "https://boards-api.greenhouse.io/v1/boards/", "https://jobs.lever.co/",
             "http://jobs.ashbyhq.com/", "https://careers.smartrecruiters.com/", "https://acme.wd5.myworkdayjobs.com/",
             "https://apply.workable.com/", "https://jobs.teamtailor.com/", "https://www.linkedin.com/", "https://"]
    head = F.get(F.array(*[F.lit(h) for h in heads]), (F.col("page_id") % 10).cast("int"))
    link = F.when(F.col("page_id") % 10 == 9, F.concat(head, host, path)).otherwise(F.concat(head, site, path))
    return p.select("page_id", link.alias("url"), site.alias("site"), host.alias("host"), "html")
