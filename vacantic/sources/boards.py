"""Readers: landed board payloads -> one raw posting shape.

Input (`payloads`): one row per landed response with columns
`source_id, company_id, company_name, adapter, adapter_tenant, careers_url,
fetched_at, payload` and optionally `page_url`.  Land the table partitioned by
`adapter`: then `union_sources` reads every file once, because each reader's
filter prunes to its own partition.
Every reader is a narrow job: parse, explode, filter; there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantic.functions.denylist import denied_url
from vacantic.functions.ids import slug
from vacantic.functions.let import filled, in_place, let
from vacantic.functions.text import TAG, html_list_to_text, html_to_text, small_methods
from vacantic.functions.times import parse_epoch_auto, parse_epoch_ms, parse_iso
from vacantic.functions.urls import hostname, join_url, workday_parts
from vacantic.rules import LISTING_CATEGORIES, LISTING_PLATFORM_HOST

SOURCE_COLUMNS = ["source_id", "company_id", "company_name", "adapter", "adapter_tenant", "careers_url",
                  "fetched_at"]
# known metadata keys and their types
METADATA = {
    "company_name": "string", "company_domain": "string", "internal_job_id": "string", "team": "string",
    "experience_level": "string", "careers_url": "string", "source_url": "string", "compensation": "string",
    "salary": "string", "pay_range": "string", "terms": "array<string>", "category": "string",
    "sponsorship": "string", "feed": "string", "feed_source": "string", "external_path": "string",
    "shortcode": "string", "identifier": "string", "first_party_verified": "boolean",
}
FIELDS = {
    "source_job_id": "string", "requisition_id": "string", "title": "string", "job_url": "string",
    "apply_url": "string", "locations_raw": "array<string>", "description_text": "string",
    "summary": "string", "employment_type": "string", "department": "string",
    "posted_at": "timestamp", "updated_at": "timestamp", "application_deadline": "timestamp",
}


# --- access to loosely typed JSON -------------------------------------------------------------
def _raw(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _of_kind(v: Column, kind: str) -> Column:
    """OBJECT, ARRAY, STRING, ...; no name of a type begins with another one's."""
    return F.schema_of_variant(v).startswith(kind)


def _is(v: Column, path: str, kind: str) -> Column:
    return F.coalesce(_of_kind(_raw(v, path), kind), F.lit(False))


def _text(v: Column, path: str) -> Column:
    """Non-empty scalar as string; objects and lists count as missing."""
    return let(F.try_variant_get(v, path, "string"), lambda t: _scalar(t, v, path))


def _scalar(t: Column, v: Column, path: str) -> Column:
    # only text that looks like an object or a list needs a look at its type; a look for what is missing is dear, and
    # `null & x` takes a look at x
    raw = _raw(v, path)
    nested = (t.startswith("{") & _of_kind(raw, "OBJECT")) | (t.startswith("[") & _of_kind(raw, "ARRAY"))
    return F.when(t != "", F.when(~nested, t))


def _string(v: Column, path: str) -> Column:
    """Non-empty value only if it is a JSON string."""
    return F.when(_is(v, path, "STRING"), filled(F.try_variant_get(v, path, "string")))




def _list(v: Column, path: str) -> Column:
    return F.when(_is(v, path, "ARRAY"), F.try_variant_get(v, path, "array<variant>"))


def _clean(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _items(payload: Column, key: str | None) -> Column:
    """Elements of the payload's list: under `key`, or of a bare list when key is None."""
    bare = F.from_json(payload, "array<variant>")
    if key is None:
        return F.when(F.ltrim(payload).startswith("["), bare)
    return F.when(~F.ltrim(payload).startswith("["), F.from_json(payload, f"{key} array<variant>")[key])


def _one(value: Column) -> Column:
    return F.when(value.isNotNull(), F.array(value)).otherwise(F.array().cast("array<string>"))


def _strings(values: Column) -> Column:
    """Trimmed, non-empty string elements of a list of variants."""
    names = F.transform(values, lambda e: F.when(_of_kind(e, "STRING"), _clean(e.try_cast("string"))))
    return F.coalesce(F.filter(names, lambda s: s.isNotNull()), F.array().cast("array<string>"))


def _rows(df: DataFrame, adapter: str, items: Column, *members: str) -> DataFrame:
    """One row per object `v`; the named members (`a` or `a.b`) are read from it at once, as text, for `_member`."""
    keep = SOURCE_COLUMNS + [c for c in ("page_url",) if c in df.columns]
    inner: dict[str, list[str]] = {}
    for outer, _, name in (m.partition(".") for m in members if "." in m):
        inner.setdefault(outer, []).append(name)
    shapes = {"o": [f"`{m}`:string" for m in members if "." not in m],
              "i": [f"`{k}`:struct<{','.join(f'`{n}`:string' for n in names)}>" for k, names in inner.items()]}
    # in place: a filter on a member must not open the object again
    opened = [in_place(F.try_variant_get("v", "$", f"struct<{','.join(fields)}>")).alias(name) for name, fields in shapes.items() if fields]
    return (df.where(F.col("adapter") == adapter)
            .select(*keep, F.explode(items).alias("v"))
            .where(_of_kind(F.col("v"), "OBJECT")).select("*", *opened))


def _member(name: str) -> Column:
    """As `_text`, of a member that `_rows` has read."""
    return _scalar(F.col(("i." if "." in name else "o.") + ".".join(f"`{n}`" for n in name.split("."))), F.col("v"), f"$.{name}")


def _label(name: str, *keys: str) -> Column:
    """A string, or an object that carries the string under one of `keys`."""
    return F.coalesce(*[_member(f"{name}.{k}") for k in keys], _member(name))


def _string_member(name: str) -> Column:
    """As `_string`, of a member that `_rows` has read."""
    t = F.col(f"o.`{name}`")
    return F.when(t != "", F.when(_of_kind(_raw(F.col("v"), f"$.{name}"), "STRING"), t))


def _shape(df: DataFrame, fields: dict[str, Column], metadata: dict[str, Column]) -> DataFrame:
    """The common raw posting shape; rows without id, title or URL are dropped."""
    meta = F.struct(*[metadata.get(k, F.lit(None)).cast(t).alias(k) for k, t in METADATA.items()])
    # cleaned text has been through Python; what reads it may go there again
    fields = {k: in_place(v) if k == "description_text" else v for k, v in fields.items()}
    cols = [fields.get(k, F.lit(None)).cast(t).alias(k) for k, t in FIELDS.items()]
    out = df.select(*SOURCE_COLUMNS, *cols, meta.alias("metadata"))
    return out.where(F.col("source_job_id").isNotNull() & F.col("title").isNotNull() & F.col("job_url").isNotNull())


# --- readers -----------------------------------------------------------------------------------
def ingest_greenhouse(payloads: DataFrame) -> DataFrame:
    """A1: `{jobs: [...]}` or a bare list; offices stand in for a missing location.

    Metadata comes as an object or as a list of name/value entries; both are read.
    """
    p, v = F.col("payload"), F.col("v")
    df = _rows(payloads, "greenhouse", F.coalesce(_items(p, "jobs"), _items(p, None)), "department", "location.name", "absolute_url",
               "requisition_id", "title", "content", "first_published", "updated_at", "internal_job_id", "metadata")
    known = F.col("o.metadata").isNotNull()

    def of_object(key: str) -> Column:
        lst = F.transform(_list(v, f"$.metadata.{key}"), lambda e: e.try_cast("string"))
        return F.coalesce(_string(v, f"$.metadata.{key}"), F.get(lst, F.lit(0)))

    def of_list(*names: str) -> Column:
        hit = F.filter(_list(v, "$.metadata"), lambda e: F.lower(F.try_variant_get(e, "$.name", "string")).isin(*names))
        return F.try_variant_get(F.get(hit, F.lit(0)), "$.value", "string")

    department = F.coalesce(F.when(known, F.coalesce(of_object("department"), of_object("departments"), of_object("team"),
                                                     of_list("department", "departments", "team"))), _member("department"))
    offices = F.coalesce(
        _one(F.when(known, F.coalesce(_string(v, "$.metadata.office"), _string(v, "$.metadata.offices")))),
        F.array().cast("array<string>"))
    office_list = F.coalesce(_strings(F.when(known, F.coalesce(_list(v, "$.metadata.office"), _list(v, "$.metadata.offices")))),
                             F.array().cast("array<string>"))
    place = F.when(_is(v, "$.location", "OBJECT"), _member("location.name"))
    places = (F.when(place.isNotNull(), F.array(place)).when(F.size(offices) > 0, offices).otherwise(office_list))
    url = _member("absolute_url")
    return _shape(df, {
        "source_job_id": F.try_variant_get(v, "$.id", "string"),
        "requisition_id": _member("requisition_id"), "title": _clean(_member("title")),
        "job_url": url, "apply_url": url, "locations_raw": places,
        "description_text": filled(html_to_text(_member("content"))),
        "department": department, "posted_at": parse_iso(_member("first_published")),
        "updated_at": parse_iso(_member("updated_at")),
    }, {"internal_job_id": _member("internal_job_id"), "company_name": F.col("company_name")})


def ingest_lever(payloads: DataFrame) -> DataFrame:
    """A2: bare list; text is every distinct fragment in order, blank line between."""
    v = F.col("v")
    # fixed values: text fields in reading order
    keys = ["descriptionPlain", "descriptionBodyPlain", "openingPlain", "additionalPlain", "description"]
    df = _rows(payloads, "lever", _items(F.col("payload"), None), "hostedUrl", "id", "text", "applyUrl", "categories.location",
               "categories.commitment", "categories.department", "categories.team", "createdAt", "updatedAt", *keys)
    sections = F.transform(
        F.filter(_list(v, "$.lists"), lambda e: _of_kind(e, "OBJECT")),
        lambda e: F.concat_ws("\n", _string(e, "$.text"), _string(e, "$.content")))
    parts = F.concat(F.array(*[_string_member(k) for k in keys]),
                     F.coalesce(sections, F.array().cast("array<string>")))
    plain = html_list_to_text(F.filter(parts, lambda s: s.isNotNull() & (F.trim(s) != "")))
    text = F.array_join(F.array_distinct(F.filter(plain, lambda s: s != "")), "\n\n")
    url = _member("hostedUrl")
    return _shape(df, {
        "source_job_id": _member("id"), "title": _clean(_member("text")), "job_url": url,
        "apply_url": F.coalesce(_member("applyUrl"), url),
        "locations_raw": _one(_member("categories.location")),
        "description_text": filled(text),
        "employment_type": _member("categories.commitment"),
        "department": _member("categories.department"),
        "posted_at": parse_epoch_ms(_member("createdAt")),
        "updated_at": parse_epoch_ms(_member("updatedAt")),
    }, {"team": _member("categories.team"), "company_name": F.col("company_name")})


def ingest_ashby(payloads: DataFrame) -> DataFrame:
    """A3: `{jobs}`; place and department are a string or an object."""
    df = _rows(payloads, "ashby", _items(F.col("payload"), "jobs"), "jobUrl", "applyUrl", "id", "title", "location.name",
               "location.location", "location", "employmentType", "publishedAt", "updatedAt", "team", "descriptionPlain",
               "descriptionHtml", "department.name", "department")
    url = F.coalesce(_member("jobUrl"), _member("applyUrl"))
    body = F.coalesce(_string_member("descriptionPlain"), _string_member("descriptionHtml"))
    return _shape(df, {
        "source_job_id": _member("id"), "title": _clean(_member("title")), "job_url": url,
        "apply_url": F.coalesce(_member("applyUrl"), url),
        "locations_raw": _one(F.coalesce(_member("location.name"), _member("location.location"),
                                         _string_member("location"))),
        "description_text": filled(html_to_text(body)),
        "employment_type": _member("employmentType"),
        "department": _label("department", "name"),
        "posted_at": parse_iso(_member("publishedAt")), "updated_at": parse_iso(_member("updatedAt")),
    }, {"team": _member("team"), "company_name": F.col("company_name")})


def ingest_smartrecruiters(payloads: DataFrame) -> DataFrame:
    """A4: `{content}`; city, region, country joined; a missing URL is built."""
    df = _rows(payloads, "smartrecruiters", _items(F.col("payload"), "content"), "company.identifier", "slug", "uuid", "id",
               "postingUrl", "ref", "refNumber", "name", "jobAdTitle", "applyUrl", "releasedDate", "createdOn", "updatedOn",
               "location.city", "location.region", "location.country", "typeOfEmployment.label", "typeOfEmployment",
               "department.label", "department", "experienceLevel.label", "experienceLevel.id", "experienceLevel.name", "experienceLevel")
    place = F.concat_ws(", ", *[_member(f"location.{k}") for k in ("city", "region", "country")])
    tenant = F.coalesce(_member("company.identifier"), F.col("adapter_tenant"))
    tail = F.coalesce(_member("slug"), _member("uuid"), _member("id"))
    url = F.coalesce(_member("postingUrl"),
                     F.concat(F.lit("https://careers.smartrecruiters.com/"), tenant, F.lit("/"), tail))
    return _shape(df, {
        "source_job_id": _member("id"),
        "requisition_id": F.coalesce(_member("ref"), _member("refNumber")),
        "title": _clean(F.coalesce(_member("name"), _member("jobAdTitle"))),
        "job_url": url, "apply_url": F.coalesce(_member("applyUrl"), url),
        "locations_raw": _one(F.nullif(place, F.lit(""))),
        "employment_type": _label("typeOfEmployment", "label"),
        "department": _label("department", "label"),
        "posted_at": parse_iso(F.coalesce(_member("releasedDate"), _member("createdOn"))),
        "updated_at": parse_iso(_member("updatedOn")),
    }, {"experience_level": _label("experienceLevel", "label", "id", "name"),
        "company_name": F.col("company_name")})


def ingest_workday(payloads: DataFrame) -> DataFrame:
    """A5: `{jobPostings}`; short bullets count as places; relative dates give null."""
    v = F.col("v")
    dates = ("postedOn", "postedDate", "firstSeen", "timePosted")
    df = _rows(payloads, "workday", _items(F.col("payload"), "jobPostings"), "externalPath", "title", "locationsText", *dates)
    ext = _clean(_member("externalPath"))
    main = _one(_clean(_string_member("locationsText")))
    bullets = F.filter(_strings(_list(v, "$.bulletFields")), lambda s: (F.length(s) < 80) & s.rlike(r"\p{L}"))
    site = workday_parts(F.col("adapter_tenant"))
    rooted = F.when(ext.startswith("/"), ext).otherwise(F.concat(F.lit("/"), ext))
    url = F.coalesce(F.concat(F.lit("https://"), site["host"], F.lit("/"), site["site"], rooted), ext)
    posted = F.coalesce(*[_member(k) for k in dates])
    last = F.nullif(F.element_at(F.split(F.regexp_replace(ext, r"/+$", ""), "/"), -1), F.lit(""))
    return _shape(df, {
        "source_job_id": F.coalesce(last, ext), "title": _clean(_member("title")),
        "job_url": url, "apply_url": url, "locations_raw": F.array_distinct(F.concat(main, bullets)),
        "posted_at": parse_iso(F.when(posted.contains("T"), posted)),
    }, {"company_name": F.col("company_name"), "external_path": ext})


def ingest_workable(payloads: DataFrame) -> DataFrame:
    """`{jobs}`; city, state, country, else the list of places."""
    v = F.col("v")
    df = _rows(payloads, "workable", _items(F.col("payload"), "jobs"), "id", "shortcode", "city", "state", "country", "url",
               "application_url", "title", "employment_type", "department", "published_on", "created_at", "updated_at",
               "description", "full_description")
    ident = F.coalesce(_member("id"), _member("shortcode"))
    code = F.coalesce(_member("shortcode"), ident)
    joined = F.concat_ws(", ", _member("city"), _member("state"), _member("country"))
    listed = F.transform(_list(v, "$.locations"), lambda e: F.when(_of_kind(e, "OBJECT"), F.coalesce(
        _text(e, "$.city"), _text(e, "$.location"), _text(e, "$.country")))
        .when(_of_kind(e, "STRING"), _clean(e.try_cast("string"))))
    listed = F.coalesce(F.filter(listed, lambda s: s.isNotNull()), F.array().cast("array<string>"))
    url = F.coalesce(_member("url"), _member("application_url"), F.concat(
        F.lit("https://apply.workable.com/"), F.col("adapter_tenant"), F.lit("/j/"), code, F.lit("/")))
    body = F.coalesce(_string_member("description"), _string_member("full_description"))
    return _shape(df, {
        "source_job_id": ident, "title": _clean(_member("title")), "job_url": url,
        "apply_url": F.coalesce(_member("application_url"), url),
        "locations_raw": F.when(joined != "", F.array(joined)).otherwise(listed),
        "description_text": filled(html_to_text(body)),
        "employment_type": F.coalesce(_member("employment_type"), _member("department")),
        "department": _member("department"),
        "posted_at": parse_iso(F.coalesce(_member("published_on"), _member("created_at"))),
        "updated_at": parse_iso(_member("updated_at")),
    }, {"company_name": F.col("company_name"), "shortcode": code})


JSONLD_SCRIPT = r"(?is)<script[^>]*type\s*=\s*[\"']?application/ld\+json[^>]*>(.*?)</script>"


def jsonld_nodes(html: Column) -> Column:
    """Objects of all JSON-LD scripts of a page, `@graph` members included."""
    bodies = F.regexp_extract_all(html, F.lit(JSONLD_SCRIPT), 1)
    nodes = F.flatten(F.transform(bodies, lambda b: F.coalesce(
        F.when(F.ltrim(b).startswith("["), F.from_json(b, "array<variant>"))
        .otherwise(F.array(F.try_parse_json(b))), F.array().cast("array<variant>"))))
    nodes = F.filter(nodes, lambda n: F.coalesce(_of_kind(n, "OBJECT"), F.lit(False)))
    members = F.flatten(F.transform(nodes, lambda n: F.coalesce(
        _list(n, '$["@graph"]'), F.array().cast("array<variant>"))))
    return F.concat(nodes, F.filter(members, lambda n: _of_kind(n, "OBJECT")))


def is_job_posting(node: Column) -> Column:
    one = F.lower(F.try_variant_get(node, '$["@type"]', "string")) == "jobposting"
    many = F.exists(F.try_variant_get(node, '$["@type"]', "array<string>"), lambda t: F.lower(t) == "jobposting")
    return F.coalesce(one, F.lit(False)) | F.coalesce(many, F.lit(False))


def _jsonld_places(node: Column) -> Column:
    entries = F.when(_is(node, "$.jobLocation", "ARRAY"), F.try_variant_get(node, "$.jobLocation", "array<variant>")) \
        .when(_raw(node, "$.jobLocation").isNotNull(), F.array(_raw(node, "$.jobLocation")))
    keys = ("streetAddress", "addressLocality", "addressRegion", "addressCountry")

    def of_entry(e: Column) -> Column:
        parts = F.nullif(F.concat_ws(", ", *[_text(e, f"$.address.{k}") for k in keys]), F.lit(""))
        address = F.when(_is(e, "$.address", "STRING"), F.try_variant_get(e, "$.address", "string")).otherwise(parts)
        return F.when(_of_kind(e, "STRING"), F.array(e.try_cast("string"))) \
            .when(_of_kind(e, "OBJECT"), F.array(address, _text(e, "$.name"))) \
            .otherwise(F.array().cast("array<string>"))

    found = F.filter(F.flatten(F.transform(entries, of_entry)), lambda s: s.isNotNull())
    return F.coalesce(found, F.array().cast("array<string>"))


def extract_jsonld(payloads: DataFrame) -> DataFrame:
    """HTML pages -> JobPosting rows; relative URLs are resolved against the page."""
    v = F.col("v")
    df = _rows(payloads, "json_ld", jsonld_nodes(F.col("payload")), "url", "directApply", "description", "employmentType",
               "identifier.value", "title", "hiringOrganization.name", "datePosted", "validThrough").where(is_job_posting(v))
    base = F.coalesce(F.col("page_url"), F.col("careers_url")) if "page_url" in df.columns else F.col("careers_url")
    url = join_url(base, F.coalesce(_member("url"), base))
    direct = F.when(~_is(v, "$.directApply", "BOOLEAN"), _member("directApply"))
    text = filled(html_to_text(F.regexp_replace(_member("description"), TAG, "\n")))
    kind = F.coalesce(F.get(F.try_variant_get(v, "$.employmentType", "array<string>"), F.lit(0)),
                      _member("employmentType"))
    ident = F.coalesce(_member("identifier.value"), F.nullif(
        F.try_variant_get(v, "$.identifier", "string"), F.lit("")), _member("url"), url)
    return _shape(df, {
        "source_job_id": ident, "title": _clean(_member("title")), "job_url": url,
        "apply_url": F.when(direct.isNotNull(), join_url(base, direct)).otherwise(url),
        "locations_raw": _jsonld_places(v), "description_text": text, "summary": F.substring(text, 1, 1000),
        "employment_type": kind, "department": _member("hiringOrganization.name"),
        "posted_at": parse_iso(_member("datePosted")),
        "application_deadline": parse_iso(_member("validThrough")),
    }, {"identifier": F.try_variant_get(v, "$.identifier", "string"), "company_name": F.col("company_name")})


def listing_domain(company: Column, url: Column) -> Column:
    """Employer domain of a listing: its own host, or `<company slug>.com` for hosted boards."""
    host = F.regexp_replace(hostname(url), r"^www\.", "")
    own = (host != "") & ~host.rlike(LISTING_PLATFORM_HOST) & ~host.contains("simplify")
    name = F.coalesce(F.nullif(slug(F.trim(company)), F.lit("")), F.lit("unknown"))
    return F.when(own, host).otherwise(F.concat(name, F.lit(".com")))


def ingest_listing_feed(payloads: DataFrame) -> DataFrame:
    """Curated feed; inactive, hidden, incomplete, denied and off-topic rows are dropped."""
    v = F.col("v")
    df = _rows(payloads, "simplify", _items(F.col("payload"), None), "url", "company_name", "category", "title", "id",
               "date_posted", "date_updated", "source", "sponsorship")
    url, company = _clean(_member("url")), _member("company_name")
    category = _string_member("category")
    off = F.coalesce(F.try_variant_get(v, "$.active", "boolean") == F.lit(False), F.lit(False)) \
        | F.coalesce(F.try_variant_get(v, "$.is_visible", "boolean") == F.lit(False), F.lit(False))
    on_topic = _member("category").isNull() | F.lower(F.trim(_member("category"))).isin(LISTING_CATEGORIES)
    df = df.where(~off & company.isNotNull() & url.startswith("http") & denied_url(url).isNull()
                  & ~F.lower(url).contains("simplify.jobs") & ~F.lower(url).contains("swelist.com") & on_topic)
    grad = F.lower(F.col("adapter_tenant")).contains("new-grad")
    terms = _strings(_list(v, "$.terms"))
    sponsor = _string_member("sponsorship")
    summary = F.concat_ws(
        " — ", _clean(_member("title")), _clean(company), category,
        F.when(F.size(terms) > 0, F.array_join(terms, " · ")),
        F.when(~F.lower(sponsor).isin("other", "n/a", "na"), sponsor))
    return _shape(df, {
        "source_job_id": _member("id"), "title": _clean(_member("title")), "job_url": url, "apply_url": url,
        "locations_raw": _strings(_list(v, "$.locations")), "summary": summary,
        "employment_type": F.when(grad, "Full-time").otherwise("Internship"), "department": category,
        "posted_at": parse_epoch_auto(_member("date_posted")),
        "updated_at": parse_epoch_auto(_member("date_updated")),
    }, {"company_name": _clean(company), "company_domain": listing_domain(company, url),
        "feed": F.col("adapter_tenant"), "category": category, "terms": terms, "sponsorship": sponsor,
        "feed_source": _member("source"),
        "experience_level": F.when(grad, "New Grad").otherwise("Internship")})


Reader = Callable[[DataFrame], DataFrame]
READERS: dict[str, Reader] = {
    "greenhouse": ingest_greenhouse, "lever": ingest_lever, "ashby": ingest_ashby,
    "smartrecruiters": ingest_smartrecruiters, "workday": ingest_workday, "workable": ingest_workable,
    "json_ld": extract_jsonld, "simplify": ingest_listing_feed,
}


def union_sources(payloads: DataFrame, readers: dict[str, Reader] | None = None) -> DataFrame:
    """All formats as one raw table; the adapter name picks the reader."""
    small_methods()
    tables = [reader(payloads) for _, reader in sorted((READERS if readers is None else readers).items())]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def unknown_adapters(payloads: DataFrame, readers: dict[str, Reader] | None = None) -> DataFrame:
    """Payload counts per adapter that no reader handles."""
    return (payloads.where(~F.col("adapter").isin(sorted(readers or READERS)))
            .groupBy("adapter").agg(F.count("*").alias("payloads")))
