"""Duplicates: by id, by fingerprint, by content.

Group sizes are unbounded (one posting may be copied everywhere), so nothing
here collects a group: canonical rows come from `min_by`, which combines
map-side, and members stay rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantic.functions.text import canonical_text, canonical_text_list
from vacantic.operators.scale import durable


def _digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def fingerprint(canon_company: Column, canon_title: Column, canon_places: Column) -> Column:
    """sha256 of company, title and sorted places, all canonical."""
    places = F.array_sort(F.filter(canon_places, lambda p: F.coalesce(p, F.lit("")) != ""))
    return _digest(canon_company, canon_title, F.array_join(places, "|"))


def place_names(df: DataFrame, places: str) -> Column:
    """Array of place texts: the column itself, or the raw text of each place struct."""
    struct = "struct" in dict(df.dtypes)[places]
    texts = F.transform(F.col(places), lambda p: F.coalesce(p["raw"] if struct else p, F.lit("")))
    return F.coalesce(texts, F.array().cast("array<string>"))


def primary_place(df: DataFrame, places: str = "locations") -> Column:
    """The first place: its raw text, else its city, else its country code; empty without places."""
    first = F.get(places, 0)
    if "struct" not in dict(df.dtypes)[places]:
        return F.coalesce(first, F.lit(""))
    options = [F.when(first[c] != "", first[c]) for c in ("raw", "city", "country_code") if f"{c}:" in dict(df.dtypes)[places]]
    return F.coalesce(*options, F.lit(""))


def with_fingerprint(df: DataFrame, company: str = "company_name", title: str = "title", places: str | Column = "locations",
                     name: str = "fingerprint") -> DataFrame:
    """I2 as a job; `places` is a column of strings or of place structs, or an array of texts."""
    texts = place_names(df, places) if isinstance(places, str) else places
    base = df.select("*", canonical_text(F.col(company)).alias("_c"), canonical_text(F.col(title)).alias("_t"),
                     canonical_text_list(texts).alias("_p"))
    return base.withColumn(name, fingerprint(F.col("_c"), F.col("_t"), F.col("_p"))).drop("_c", "_t", "_p")


# fixed values: fields of the two content hashes, in key order
RAW_HASH_FIELDS = ["apply_url", "company_name", "department", "description", "employment_type", "job_url",
                   "locations", "source_job_id", "summary", "title"]
POSTING_HASH_FIELDS = ["apply_url", "career_level", "company_name", "employment_type", "job_url", "locations",
                       "primary_discipline", "skills", "source_job_id", "summary", "title"]


def posting_fields(df: DataFrame) -> dict[str, Column]:
    """The fields of a posting's content hash, by name."""
    special = {"locations": lambda: F.array_join(place_names(df, "locations"), "|"), "primary_discipline": lambda: F.col("disciplines.primary"),
               "skills": lambda: F.array_join("skills", ",")}
    return {k: special[k]() if k in special else F.col(k) for k in POSTING_HASH_FIELDS}


def content_hash(fields: dict[str, Column]) -> Column:
    """sha256 of compact JSON with sorted keys over canonical text fields."""
    cells = [F.coalesce(fields[k], F.lit("")).alias(k) for k in sorted(fields)]
    return F.sha2(F.to_json(F.struct(*cells)), 256)


def with_content_hash(df: DataFrame, fields: dict[str, str | Column] | None = None, name: str = "content_hash") -> DataFrame:
    """I3 as a job: `fields` maps hash field -> column, by default the eleven of a posting; values are made canonical in one pass."""
    chosen = {k: F.col(c) if isinstance(c, str) else c for k, c in (fields or posting_fields(df)).items()}
    base = df.select("*", *[canonical_text(c.cast("string")).alias(f"_h_{k}") for k, c in chosen.items()])
    return base.withColumn(name, content_hash({k: F.col(f"_h_{k}") for k in chosen})).drop(*[f"_h_{k}" for k in chosen])


def group_by_id(df: DataFrame, key: str = "job_id") -> DataFrame:
    """One row per id with its copies counted and its canonical time."""
    return df.groupBy(key).agg(F.count("*").alias("copies"), F.min("first_seen_at").alias("first_seen_at"),
                               F.max("last_seen_at").alias("last_seen_at"))


def pick_canonical(df: DataFrame, keys: list[str]) -> DataFrame:
    """The row first seen earliest, then the smallest id, per group."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*keys).agg(F.min_by(row, F.struct("first_seen_at", "job_id")).alias("_r")).select("_r.*")


SALTS = 16


def merge_group(df: DataFrame, keys: list[str], salts: int = SALTS) -> DataFrame:
    """I4: canonical row, union of skills, latest last_seen, earliest first_seen.

    Two aggregations over one lineage: first per (group, salt), where skill lists
    shrink to their distinct names, then per group.  A hot group is spread over
    `salts` tasks and its last step sees at most `salts` rows.
    """
    others = [c for c in df.columns if c not in ("skills", "first_seen_at", "last_seen_at")]
    group = [f"_k_{k}" for k in keys]
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_set("skills")))).alias("skills")  # at most one list per distinct set
    order = F.struct("first_seen_at", F.col("job_id").isNull().alias("no_id"), "job_id")
    salted = df.withColumns({**{f"_k_{k}": F.col(k) for k in keys},
                             "_salt": F.pmod(F.xxhash64("job_id", "first_seen_at", "last_seen_at"), F.lit(salts))})
    part = salted.groupBy(*group, "_salt").agg(
        F.min_by(F.struct(*others), order).alias("_r"), F.min(order).alias("_o"), F.max("last_seen_at").alias("last_seen_at"),
        F.count("*").alias("_n"), names)
    out = part.groupBy(*group).agg(
        F.min_by("_r", "_o").alias("_r"), F.min("_o.first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"),
        F.sum("_n").alias("merged_rows"), names)
    return out.select(*[F.col(f"_r.{c}").alias(c) for c in others], "skills", "first_seen_at", "last_seen_at", "merged_rows")


def dedupe(df: DataFrame, company: str = "company_name", title: str = "title", places: str = "locations",
           hash_fields: dict[str, str | Column] | None = None) -> DataFrame:
    """Merge by id, then by fingerprint, then by content hash.

    By default the fingerprint holds company, title and all places, the content hash the eleven fields of a posting;
    narrower keys have to be asked for.  Both keys are computed once, right after the first merge, and only ids, keys,
    times and skills go through the later merges; the wide rows join back at the end by a row number.  Rows without an
    id are no copies of each other by id, but may be by the other two keys; a row with an id is canonical before them.
    """
    fields = hash_fields or posting_fields(df)
    apart = F.when(F.col("job_id").isNull(), F.monotonically_increasing_id())
    one = merge_group(df.withColumn("_apart", apart), ["job_id", "_apart"]).drop("merged_rows", "_apart")
    # skills change while rows merge, so they take part in the content key as they are by then
    stable = {k: c for k, c in fields.items() if k != "skills" and not (isinstance(c, str) and c == "skills")}
    keyed = durable(with_content_hash(with_fingerprint(one, company, title, places), stable, "_content").withColumn("_row", F.monotonically_increasing_id()))
    slim = keyed.select("_row", "job_id", "fingerprint", "_content", "first_seen_at", "last_seen_at", "skills")
    two = merge_group(slim, ["fingerprint"]).drop("merged_rows")
    if len(stable) < len(fields):
        two = two.withColumn("_content", F.sha2(F.concat_ws("|", "_content", F.array_join("skills", ",")), 256))
    three = merge_group(two, ["_content"]).select("_row", "first_seen_at", "last_seen_at", "skills")
    return keyed.drop("fingerprint", "_content", "first_seen_at", "last_seen_at", "skills").join(three, "_row").drop("_row")


def find_duplicates(df: DataFrame, company: str = "company_name", title: str = "title",
                    place: str | Column | None = None) -> DataFrame:
    """Rows (stage, canonical_job_id, job_id, copies), one per member of a group of two or more.

    Rows with one company, title and primary place are duplicates; `place` names another column or expression.
    Linear: each stage is one aggregation and one join on the group key, which carries ids and hashes only.  The
    canonical id is the smallest of the group.
    """
    by_id = df.groupBy("job_id").agg(F.count("*").alias("copies")).where(F.col("copies") > 1) \
        .select(F.lit("job_id").alias("stage"), F.col("job_id").alias("canonical_job_id"), "job_id", "copies")
    where = primary_place(df) if place is None else F.col(place) if isinstance(place, str) else place
    # ids and hashes only: written once, read by both the grouping and the join
    marked = durable(with_fingerprint(df, company, title, F.array(where)).select("job_id", "fingerprint").distinct())
    groups = marked.groupBy("fingerprint").agg(F.min("job_id").alias("canonical_job_id"),
                                               F.count("*").alias("copies")).where(F.col("copies") > 1)
    members = marked.join(groups, "fingerprint").select(
        F.lit("fingerprint").alias("stage"), "canonical_job_id", "job_id", "copies")
    return by_id.unionByName(members)


def distinct_urls(df: DataFrame, url: str, order: str) -> DataFrame:
    """Fragment stripped; the first row per URL wins by `order`."""
    base = df.withColumn("clean_url", F.regexp_replace(F.col(url), r"#.*$", ""))
    row = F.struct(*[F.col(c) for c in base.columns])
    return base.groupBy("clean_url").agg(F.min_by(row, F.col(order)).alias("_r")).select("_r.*")
