"""Seeds and state tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantic.functions import ids
from vacantic.functions.denylist import domain_blocked
from vacantic.operators.companies import merge_seeds, retire_sources
from vacantic.rules import HASH_BUCKETS, SEED_ADAPTERS, SEED_DOMAIN, SEED_TENANT

SEED_SCHEMA = "company string, domain string, adapter string, tenant string"


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """A10: seed rows from a JSON-lines or CSV folder, or from a hand-kept YAML list (a small file)."""
    if path.endswith((".yml", ".yaml")):
        import yaml
        text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).limit(1).collect())
        rows = [{k: str(e.get(k, "")) for k in ("company", "domain", "adapter", "tenant")}
                for e in yaml.safe_load(text) or [] if isinstance(e, dict)]
        return spark.createDataFrame([tuple(r.values()) for r in rows], SEED_SCHEMA)
    if path.endswith(".csv"):
        return spark.read.schema(SEED_SCHEMA).option("header", True).csv(path)
    return spark.read.schema(SEED_SCHEMA).json(path)


def load_seeds(raw: DataFrame) -> DataFrame:
    """A10: trimmed, lower-cased, complete seeds with their ids."""
    t = raw.select(F.trim("company").alias("company"), *[F.lower(F.trim(c)).alias(c) for c in ("domain", "adapter", "tenant")])
    full = t.where((F.coalesce("company", F.lit("")) != "") & (F.coalesce("domain", F.lit("")) != "")
                   & (F.coalesce("adapter", F.lit("")) != "") & (F.coalesce("tenant", F.lit("")) != ""))
    return full.select(ids.source_id(F.col("domain"), F.col("adapter"), F.col("tenant")).alias("source_id"),
                       ids.company_id(F.col("domain")).alias("company_id"), "company", "domain", "adapter", "tenant")


def seed_problems(raw: DataFrame) -> DataFrame:
    """A10: format, adapter, denylist and duplicate checks; rows (problem, entries)."""
    t = raw.select(*[F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in ("company", "domain", "adapter", "tenant")])
    t = t.select("company", *[F.lower(c).alias(c) for c in ("domain", "adapter", "tenant")])
    checks = {
        "missing_company": F.col("company") == "", "invalid_domain": ~F.col("domain").rlike(SEED_DOMAIN),
        "unsupported_adapter": ~F.col("adapter").isin(SEED_ADAPTERS), "invalid_tenant": ~F.col("tenant").rlike(SEED_TENANT),
        "denied_domain": domain_blocked(F.col("domain")),
    }
    one = t.agg(*[F.count_if(test).alias(name) for name, test in checks.items()])
    unpivot = one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("problem"), F.col(n).alias("entries")) for n in checks])))
    twice = load_seeds(raw).groupBy("source_id").agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum(F.greatest(F.col("n") - 1, F.lit(0))), F.lit(0)).cast("long").alias("entries"))
    return unpivot.unionByName(twice.select(F.lit("duplicate_source").alias("problem"), "entries"))


def require_unique_seeds(seeds: DataFrame) -> DataFrame:
    """A10: fail when two seeds share a source id."""
    twice = seeds.groupBy("source_id").agg(F.count("*").alias("n")).where(F.col("n") > 1).limit(1).collect()
    if twice:
        raise ValueError(f"duplicate source id {twice[0].source_id}")
    return seeds


def _careers(domain: Column) -> Column:
    return F.concat(F.lit("https://"), domain, F.lit("/careers"))


def seeds_to_companies(seeds: DataFrame, now: Column) -> DataFrame:
    """Company rows; adapters of all seeds of a company are gathered."""
    no = F.array().cast("array<string>")
    return seeds.groupBy("company_id").agg(
        F.min_by("company", "source_id").alias("name"), F.min("domain").alias("canonical_domain"),
        F.array_sort(F.collect_set("adapter")).alias("ats_sources")).select(
        "company_id", "name", ids.slug(F.col("name")).alias("normalized_name"), "canonical_domain", no.alias("aliases"),
        F.array(_careers(F.col("canonical_domain"))).alias("careers_urls"), "ats_sources",
        now.alias("first_seen_at"), now.alias("last_seen_at"))


def seeds_to_sources(seeds: DataFrame, now: Column, tier: str = "warm") -> DataFrame:
    """Source rows; seeds are fully trusted."""
    return seeds.select(
        "source_id", "company_id", F.col("company").alias("company_name"), F.col("domain").alias("company_domain"),
        _careers(F.col("domain")).alias("careers_url"), "adapter", F.col("tenant").alias("adapter_tenant"),
        F.lit("seed").alias("discovered_via"), F.lit(1.0).alias("discovery_confidence"),
        now.alias("first_discovered_at"), now.alias("last_validated_at"), F.lit(0).alias("consecutive_failures"),
        F.lit(tier).alias("poll_tier"), F.lit(None).cast("timestamp").alias("next_due_at"),
        F.lit("healthy").alias("health_status"), F.lit(True).alias("enabled"))


def merge_candidates(known: DataFrame, found: DataFrame) -> DataFrame:
    """New (adapter, tenant) pairs with company and domain; the smallest company name stands for a pair."""
    def keyed(df: DataFrame) -> DataFrame:
        return df.select(F.trim("company").alias("company"), *[F.lower(F.trim(c)).alias(c) for c in ("domain", "adapter", "tenant")])

    new = keyed(found).where((F.col("adapter") != "") & (F.col("tenant") != "") & (F.col("company") != "") & (F.col("domain") != ""))
    fresh = new.join(keyed(known).select("adapter", "tenant").distinct(), ["adapter", "tenant"], "left_anti")
    return fresh.groupBy("adapter", "tenant").agg(F.min(F.struct("company", "domain")).alias("_r")).select(
        "_r.company", "_r.domain", "adapter", "tenant")


# --- state --------------------------------------------------------------------------------------------------
def _files(spark: SparkSession, path: str):
    """Hadoop path and file system: works for any store the cluster reads."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def current_version(spark: SparkSession, path: str) -> int:
    """Number of the newest pointer of a state folder, 0 when there is none."""
    folder, fs = _files(spark, f"{path}/_versions")
    if not fs.exists(folder):
        return 0
    return max([int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit()] or [0])


def current_snapshot(spark: SparkSession, path: str) -> dict | None:
    """The newest pointer: which folder holds the current snapshot of each table."""
    version = current_version(spark, path)
    if version == 0:
        return None
    rows = spark.read.text(f"{path}/_versions/{version}", wholetext=True).limit(1).collect()
    return json.loads(rows[0].value)


def publish_pointer(spark: SparkSession, path: str, pointer: dict) -> None:
    """Make a snapshot current by creating the next pointer file; creation fails if another writer was first."""
    target, fs = _files(spark, f"{path}/_versions/{current_version(spark, path) + 1}")
    out = fs.create(target, False)
    out.write(bytearray(json.dumps(pointer).encode()))
    out.close()


def read_state(spark: SparkSession, path: str) -> dict[str, DataFrame] | None:
    """Tables of the current snapshot, or None when there is no state yet."""
    now = current_snapshot(spark, path)
    if now is None:
        return None
    return {name: spark.read.parquet(f"{path}/{folder}") for name, folder in now["tables"].items()}


def bootstrap_sources(seeds: DataFrame, now: Column) -> DataFrame:
    """First source table, straight from the seeds."""
    return seeds_to_sources(seeds, now)


def load_or_bootstrap(spark: SparkSession, path: str, seeds: DataFrame, now: Column) -> DataFrame:
    """Sources of the stored state with the seeds merged in, or the seeds alone."""
    state = read_state(spark, path)
    fresh = seeds_to_sources(seeds, now)
    if state is None:
        return fresh
    return retire_sources(merge_seeds(state["sources"], fresh).drop("seed_change"), fresh)


def read_buckets(spark: SparkSession, path: str, job_ids: list[str], buckets: int = HASH_BUCKETS) -> DataFrame:
    """Only the partitions that can hold the wanted ids are read."""
    import hashlib
    wanted = sorted({int(hashlib.sha256(i.encode()).hexdigest()[:8], 16) % buckets for i in job_ids})
    return spark.read.parquet(path).where(F.col("bucket").isin(wanted) & F.col("job_id").isin(list(job_ids)))


def newest_snapshot(copies: DataFrame, key: str = "dataset") -> DataFrame:
    """Of several copies of a dataset the one generated last (smallest path on a tie)."""
    return copies.groupBy(key).agg(
        F.max("generated_at").alias("generated_at"), F.count("*").alias("copies"),
        F.min(F.struct((-F.unix_micros("generated_at")).alias("o"), F.col("path"))).alias("_p")).select(
        key, F.col("_p.path").alias("path"), "generated_at", "copies")
