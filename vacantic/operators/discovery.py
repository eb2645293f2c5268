"""Discovery: score, validate, promote or quarantine candidate boards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantic.functions import ids
from vacantic.functions.denylist import domain_blocked
from vacantic.functions.let import in_place, let
from vacantic.functions.text import canonical_text
from vacantic.functions.urls import detect_platform, domain, hostname, scheme
from vacantic.operators.companies import SOURCE_FIELDS
from vacantic.rules import (DENIED_DOMAINS, FAST_PLATFORMS, MAX_QUARANTINE, PLATFORM_DOMAIN_TOKENS,
                            PROMOTION_MIN_CONFIDENCE, QUARANTINE_BELOW_CONFIDENCE)


def score(url: Column, platform: Column, tenant: Column, base: Column, has_json_ld: Column, is_seed: Column) -> Column:
    """Best of base, platform with tenant 0.8, platform 0.65, JSON-LD 0.7; https adds 0.05; a seed is 1.0."""
    signals = (F.when(platform.isNotNull() & tenant.isNotNull(), F.lit(0.8))
               .when(platform.isNotNull(), F.lit(0.65)).otherwise(F.lit(0.0)))
    best = F.greatest(base, signals, F.when(has_json_ld, F.lit(0.7)).otherwise(F.lit(0.0)))
    bonus = F.when(scheme(url) == "https", F.lit(0.05)).otherwise(F.lit(0.0))
    return F.when(is_seed, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.round(best + bonus, 3)))


def _optional(df: DataFrame, name: str, kind: str, default=None) -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(default).cast(kind)


def score_candidates(df: DataFrame, url: str = "url") -> DataFrame:
    """J14 as a job: adds `confidence` from the candidate's own columns."""
    return df.withColumn("confidence", score(
        F.col(url), _optional(df, "platform", "string"), _optional(df, "tenant", "string"),
        F.coalesce(_optional(df, "base_confidence", "double", 0.5), F.lit(0.5)),
        F.coalesce(_optional(df, "has_json_ld", "boolean", False), F.lit(False)),
        F.coalesce(_optional(df, "is_seed", "boolean", False), F.lit(False))))


def validate_candidates(df: DataFrame, url: str = "url", denied: list[str] = DENIED_DOMAINS,
                        promote_at: float = PROMOTION_MIN_CONFIDENCE,
                        quarantine_below: float = QUARANTINE_BELOW_CONFIDENCE) -> DataFrame:
    """Accepted or a reason with issues, in one pass without joins.

    Optional input columns: company_domain, platform, tenant, base_confidence,
    has_json_ld, is_seed, private_address.
    """
    c, u = F.col, F.col(url)
    base = df.select(
        "*", scheme(u).alias("_scheme"), hostname(u).alias("_host"), detect_platform(u).alias("_det"),
        _optional(df, "platform", "string").alias("_p"), _optional(df, "tenant", "string").alias("_t"),
        _optional(df, "company_domain", "string").alias("_d"),
        F.coalesce(_optional(df, "base_confidence", "double", 0.5), F.lit(0.5)).alias("_b"),
        F.coalesce(_optional(df, "has_json_ld", "boolean", False), F.lit(False)).alias("_j"),
        F.coalesce(_optional(df, "is_seed", "boolean", False), F.lit(False)).alias("_s"),
        F.coalesce(_optional(df, "private_address", "boolean", False), F.lit(False)).alias("_private"))
    base = base.select("*", F.coalesce("_p", "_det.platform").alias("_adapter"), F.coalesce("_t", "_det.tenant").alias("_tenant"),
                       F.coalesce("_d", "_host").alias("_domain"))
    raw = score(u, c("_adapter"), c("_tenant"), c("_b"), c("_j"), c("_s"))
    weak = F.coalesce(~c("_det.supported"), F.lit(False))
    base = base.withColumn("_conf", F.when(weak, F.least(raw, F.lit(0.5))).otherwise(raw))
    issues = F.filter(F.array(
        F.when(c("_private"), "hostname resolves to private/reserved address"),
        F.when(weak, F.concat(F.lit("ATS platform "), c("_det.platform"), F.lit(" is not fully supported")))),
        lambda i: i.isNotNull())

    def some(default: str) -> Column:
        return F.when(F.size(issues) > 0, issues).otherwise(F.array(F.lit(default)))

    bad_scheme = ~c("_scheme").isin("http", "https")
    no_host, blocked = c("_host") == "", domain_blocked(c("_host"), denied)
    early = bad_scheme | no_host | blocked
    reason = (F.when(bad_scheme, "invalid_scheme").when(no_host, "missing_hostname").when(blocked, "aggregator_denylist")
              .when(c("_conf") < quarantine_below, "low_confidence")
              .when(c("_conf") < promote_at, "below_promotion_threshold")
              .when(F.size(issues) > 0, "validation_warnings").otherwise("accepted"))
    why = (F.when(bad_scheme, F.array(F.lit("URL must use http or https")))
           .when(no_host, F.array(F.lit("URL missing hostname")))
           .when(blocked, F.array(F.concat(F.lit("Domain "), c("_host"), F.lit(" is denylisted"))))
           .when(c("_conf") < quarantine_below, some("Confidence below quarantine threshold"))
           .when(c("_conf") < promote_at, some("Confidence below promotion threshold")).otherwise(issues))
    keep = [x for x in df.columns if x not in ("platform", "tenant", "company_domain", "base_confidence",
                                                "has_json_ld", "is_seed", "private_address", "confidence")]
    return base.select(
        *keep, (reason == "accepted").alias("accepted"), reason.alias("reason"),
        F.when(early, F.lit(0.0)).otherwise(c("_conf")).alias("confidence"),
        F.when(~early, c("_adapter")).alias("adapter"), F.when(~early, c("_tenant")).alias("tenant"),
        F.when(bad_scheme | no_host, F.lit(None)).otherwise(c("_domain")).alias("company_domain"),
        F.when(~early & c("_adapter").isNotNull() & c("_tenant").isNotNull(),
               ids.source_id(c("_domain"), c("_adapter"), c("_tenant"))).alias("source_id"),
        u.alias("candidate_url"), why.alias("issues"))


def already_tracked(candidates: DataFrame, sources: DataFrame) -> DataFrame:
    """Candidates that are not sources yet."""
    return candidates.join(sources.select("source_id").distinct(), "source_id", "left_anti")


def name_from_domain(d: Column) -> Column:
    label = F.substring_index(F.regexp_replace(F.lower(d), r"^www\.", ""), ".", 1)
    return F.initcap(F.replace(label, F.lit("-"), F.lit(" ")))


def promotable(validated: DataFrame, discovered_via: str, now: Column) -> DataFrame:
    """Accepted candidates as source rows, one per source id (best confidence, smallest URL on a tie)."""
    ok = validated.where(F.col("accepted") & F.col("adapter").isNotNull() & F.col("tenant").isNotNull()
                         & F.col("company_domain").isNotNull())
    dom = F.regexp_replace(F.lower("company_domain"), r"^www\.", "")
    given = F.col("company_name") if "company_name" in validated.columns else F.lit(None).cast("string")
    rows = ok.select(
        F.coalesce("source_id", ids.source_id(dom, F.col("adapter"), F.col("tenant"))).alias("source_id"),
        ids.company_id(dom).alias("company_id"), F.coalesce(given, name_from_domain(dom)).alias("company_name"),
        dom.alias("company_domain"), F.col("candidate_url").alias("careers_url"), "adapter",
        F.col("tenant").alias("adapter_tenant"), "confidence")
    payload = F.struct("company_id", "company_name", "company_domain", "careers_url", "adapter", "adapter_tenant")
    best = rows.groupBy("source_id").agg(
        F.min_by(payload, F.struct((-F.col("confidence")).alias("o"), F.col("careers_url"))).alias("p"),
        F.max("confidence").alias("discovery_confidence"))
    return best.select(
        "source_id", "p.*", F.lit(discovered_via).alias("discovered_via"), "discovery_confidence",
        now.alias("first_discovered_at"), now.alias("last_validated_at"), F.lit(0).alias("consecutive_failures"),
        F.lit("hot").alias("poll_tier"), F.lit(None).cast("timestamp").alias("next_due_at"),
        F.lit("healthy").alias("health_status"), F.lit(True).alias("enabled"))


def promote_sources(validated: DataFrame, sources: DataFrame, discovered_via: str, now: Column) -> DataFrame:
    """Source table after promotion; a known source is re-enabled, keeps its best confidence, and heals."""
    s, n = sources.alias("s"), promotable(validated, discovered_via, now).alias("n")
    has_s, has_n = F.col("s.source_id").isNotNull(), F.col("n.source_id").isNotNull()
    both = has_s & has_n
    sick = F.col("s.health_status").isin("failing", "degraded", "unsupported")

    def value(c: str) -> Column:
        old, new = F.col(f"s.{c}"), F.col(f"n.{c}")
        kept = {
            "last_validated_at": F.when(has_n, now).otherwise(old),
            "discovery_confidence": F.when(has_n, F.greatest(old, new)).otherwise(old),
            "enabled": F.when(has_n, True).otherwise(old),
            "health_status": F.when(both & sick, "healthy").otherwise(old),
            "consecutive_failures": F.when(both & sick, 0).otherwise(old),
        }.get(c, old)
        return F.when(has_s, kept).otherwise(new).alias(c)

    return s.join(n, F.col("s.source_id") == F.col("n.source_id"), "full_outer").select(
        F.coalesce("s.source_id", "n.source_id").alias("source_id"), *[value(c) for c in SOURCE_FIELDS],
        F.when(~has_s, "promoted").when(both, "refreshed").otherwise("kept").alias("promotion"))


def promote_companies(validated: DataFrame, companies: DataFrame, discovered_via: str, now: Column) -> DataFrame:
    """Company table after promotion; careers URLs and adapters are added once."""
    rows = promotable(validated, discovered_via, now)
    core = rows.groupBy("company_id").agg(
        F.min_by("company_name", "source_id").alias("n_name"), F.min("company_domain").alias("n_domain"))
    lists = rows.select("company_id", "careers_url", "adapter").distinct().groupBy("company_id").agg(
        F.array_sort(F.collect_set("careers_url")).alias("n_urls"), F.array_sort(F.collect_set("adapter")).alias("n_adapters"))
    new = core.join(lists, "company_id").withColumn("n_norm", F.replace(canonical_text(F.col("n_name")), F.lit(" "), F.lit("-")))
    no = F.array().cast("array<string>")
    out = companies.join(new, "company_id", "full_outer")
    known = F.col("n_name").isNotNull()
    return out.select(
        "company_id", F.coalesce("name", "n_name").alias("name"), F.coalesce("normalized_name", "n_norm").alias("normalized_name"),
        F.coalesce("canonical_domain", "n_domain").alias("canonical_domain"),
        F.array_union(F.coalesce("careers_urls", no), F.coalesce("n_urls", no)).alias("careers_urls"),
        F.array_union(F.coalesce("ats_sources", no), F.coalesce("n_adapters", no)).alias("ats_sources"),
        F.coalesce("first_seen_at", now).alias("first_seen_at"),
        F.when(known, now).otherwise(F.col("last_seen_at")).alias("last_seen_at"))


def boards_from_postings(postings: DataFrame, platforms: tuple[str, ...] = FAST_PLATFORMS) -> DataFrame:
    """Apply URLs -> board candidates on the three fast platforms, ready for promotion.

    Reads apply_url, company_name, company_domain.
    """
    base = postings.withColumn("_m", detect_platform(F.col("apply_url"))) \
        .where(F.col("_m.platform").isin(list(platforms)) & F.col("_m.supported") & F.col("_m.tenant").isNotNull())
    name = F.coalesce(F.nullif(F.trim("company_name"), F.lit("")), F.col("_m.tenant"))
    # in place: the domain made of it is filtered on, and a Python call copied into a filter may stay where Spark cannot evaluate it
    base = base.withColumn("_name", name).withColumn("_norm", in_place(F.replace(canonical_text(name), F.lit(" "), F.lit("-"))))
    given = F.regexp_replace(F.lower(F.trim(F.coalesce("company_domain", F.lit("")))), r"^www\.", "")
    hosted = "^$|" + "|".join(token.replace(".", r"\.") for token in PLATFORM_DOMAIN_TOKENS)
    own = F.concat(F.coalesce(F.nullif(F.col("_norm"), F.lit("")), F.col("_m.tenant")), F.lit(".com"))
    base = base.withColumn("_dom", let(given, lambda g: F.when(g.rlike(hosted), own).otherwise(g)))
    return base.select(
        F.lit(True).alias("accepted"), F.lit(0.9).alias("confidence"), F.col("_m.platform").alias("adapter"),
        F.col("_m.tenant").alias("tenant"), F.col("_dom").alias("company_domain"), F.col("_name").alias("company_name"),
        F.coalesce("_m.careers_url", "apply_url").alias("candidate_url"),
        ids.source_id(F.col("_dom"), F.col("_m.platform"), F.col("_m.tenant")).alias("source_id"))


def promote_from_postings(postings: DataFrame, sources: DataFrame, now: Column, discovered_via: str = "simplify") -> DataFrame:
    """Only boards that are not tracked yet, as source rows."""
    return already_tracked(promotable(boards_from_postings(postings), discovered_via, now), sources)


def promotion_feedback(postings: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """K8: sources to poll in this run: the known ones and the boards the run itself found."""
    found = promote_from_postings(postings, sources, now)
    return sources.select("source_id", *SOURCE_FIELDS).withColumn("found_in_run", F.lit(False)) \
        .unionByName(found.select("source_id", *SOURCE_FIELDS).withColumn("found_in_run", F.lit(True)))


def quarantine_rows(validated: DataFrame, discovered_via: str, now: Column) -> DataFrame:
    """Rejected candidates with reason and time."""
    return validated.where(~F.col("accepted")).select(
        F.col("candidate_url").alias("url"), "reason", "confidence", "adapter", "tenant", "company_domain",
        F.lit(discovered_via).alias("discovered_via"), "issues", now.alias("quarantined_at"))


def quarantine(current: DataFrame, rejected: DataFrame) -> DataFrame:
    """Upsert by URL; the newest entry per URL stays."""
    every = current.unionByName(rejected)
    row = F.struct(*[F.col(c) for c in every.columns])
    return every.groupBy(F.col("url").alias("_u")).agg(
        F.max_by(row, F.struct("quarantined_at", "reason", "confidence")).alias("_r")).select("_r.*")


def latest_n_by_url(current: DataFrame, rejected: DataFrame, n: int = MAX_QUARANTINE) -> DataFrame:
    """H5: the quarantine list, newest `n` URLs."""
    return quarantine(current, rejected).orderBy(F.col("quarantined_at").desc(), F.col("url")).limit(n)


def discovery_counts(validated: DataFrame, sources: DataFrame) -> DataFrame:
    """candidates by outcome: already tracked, promoted, quarantined."""
    known = sources.select("source_id").distinct().withColumn("_known", F.lit(True))
    out = validated.join(known, "source_id", "left")
    outcome = F.when(F.col("_known"), "already_tracked").when(F.col("accepted"), "promoted").otherwise("quarantined")
    return out.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("candidates"))
