"""URL functions, all JVM expressions (no Python per row, no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantic.functions.let import let
from vacantic.rules import PLATFORM_HOST, PLATFORMS, literal, literal_map

# generic URI grammar (RFC 3986, appendix B): scheme, authority, path, query
_URI = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _part(url: Column, index: int) -> Column:
    return F.regexp_extract(url, _URI, index)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def authority(url: Column) -> Column:
    return _part(url, 2)


def path(url: Column) -> Column:
    return _part(url, 3)


def query(url: Column) -> Column:
    return _part(url, 4)


def hostname(url: Column) -> Column:
    """Lower-cased host without user info and port; empty when there is none."""
    bare = F.regexp_replace(authority(url), r"^.*@", "")
    return F.lower(F.regexp_replace(bare, r":\d*$", ""))


def domain(url: Column) -> Column:
    """Host without a leading `www.`; a missing scheme is allowed; null when empty."""
    full = F.when(url.contains("://"), url).otherwise(F.concat(F.lit("https://"), url))
    return F.nullif(F.regexp_replace(hostname(full), r"^www\.", ""), F.lit(""))


def segments(p: Column) -> Column:
    """Non-empty path segments."""
    return F.filter(F.split(p, "/"), lambda s: s != "")


# fixed values: characters that stay as they are in a path segment / in a query part
_PATH_SAFE = [("%3A", ":"), ("%40", "@"), ("%26", "&"), ("%3D", "="), ("%2B", "+"), ("%24", "$"),
              ("%2C", ","), ("%3B", ";"), ("%7E", "~"), ("%27", "'"), ("%28", "("), ("%29", ")"),
              ("%21", "!")]


def _decode(part: Column, plus_is_space: bool) -> Column:
    ready = part if plus_is_space else F.replace(part, F.lit("+"), F.lit("%2B"))
    return F.coalesce(F.try_url_decode(ready), part)


def _encode_path(segment: Column) -> Column:
    out = F.replace(F.url_encode(segment), F.lit("+"), F.lit("%20"))
    for code, char in _PATH_SAFE:
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def _encode_query(part: Column) -> Column:
    return F.replace(F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def resolve_dots(parts: Column) -> Column:
    """Drop `.` and empty segments, let `..` remove the segment before it."""
    empty = F.array().cast("array<string>")
    return F.aggregate(parts, empty, lambda acc, s:
                       F.when(s.isin("", "."), acc)
                       .when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
                       .otherwise(F.array_append(acc, s)))


def _canonical_path(p: Column) -> Column:
    p = F.regexp_replace(p, r";[^/]*$", "")
    plain = ~p.rlike(r"[^A-Za-z0-9_.\-~/]")
    quick = F.transform(resolve_dots(F.split(p, "/")), lambda s: s)
    full = F.transform(resolve_dots(F.transform(F.split(p, "/"), lambda s: _decode(s, False))), _encode_path)
    return F.concat(F.lit("/"), F.array_join(F.when(plain, quick).otherwise(full), "/"))


def _canonical_query(q: Column) -> Column:
    pairs = F.transform(
        F.filter(F.split(q, "&"), lambda kv: kv != ""),
        lambda kv: F.struct(
            _decode(F.substring_index(kv, "=", 1), True).alias("k"),
            _decode(F.when(kv.contains("="), F.regexp_extract(kv, r"(?s)^[^=]*=(.*)$", 1)).otherwise(F.lit("")),
                    True).alias("v")))
    coded = F.transform(F.array_sort(pairs),
                        lambda s: F.concat(_encode_query(s["k"]), F.lit("="), _encode_query(s["v"])))
    return F.array_join(coded, "&")


def join_url(base: Column, ref: Column) -> Column:
    """Reference resolution: absolute, scheme-relative, rooted, query-only or relative."""
    ref = F.trim(ref)
    origin = F.concat(_part(base, 1), F.lit("://"), authority(base))
    folder = F.regexp_replace(F.when(path(base) == "", F.lit("/")).otherwise(path(base)), r"[^/]*$", "")
    rel_path = F.concat(folder, F.regexp_extract(ref, r"^([^?#]*)", 1))
    dotted = F.concat(F.lit("/"), F.array_join(resolve_dots(F.split(rel_path, "/")), "/"))
    dotted = F.when(rel_path.endswith("/") & (dotted != "/"), F.concat(dotted, F.lit("/"))).otherwise(dotted)
    tail = F.regexp_extract(ref, r"^[^?#]*(.*)$", 1)
    return (F.when(ref.isNull() | base.isNull(), F.coalesce(ref, base))
            .when(ref == "", base)
            .when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), ref)
            .when(ref.startswith("//"), F.concat(_part(base, 1), F.lit(":"), ref))
            .when(ref.startswith("/"), F.concat(origin, ref))
            .when(ref.startswith("?"), F.concat(origin, path(base), ref))
            .when(ref.startswith("#"), F.concat(F.regexp_replace(base, r"#.*$", ""), ref))
            .otherwise(F.concat(origin, dotted, tail)))


def canonical_url(url: Column, base: Column | None = None) -> Column:
    """One spelling per URL; null when scheme or host is missing."""
    return let(F.trim(join_url(base, url) if base is not None else url), _canonical)


def _canonical(u: Column) -> Column:
    s, host = scheme(u), F.regexp_replace(hostname(u), r"\.+$", "")
    port = F.regexp_extract(authority(u), r":(\d+)$", 1)
    default = ((s == "http") & (port == "80")) | ((s == "https") & (port == "443"))
    user = F.regexp_extract(authority(u), r"^(.*)@", 1)
    q = query(u)
    out = F.concat(
        s, F.lit("://"),
        F.when(user != "", F.concat(user, F.lit("@"))).otherwise(F.lit("")), host,
        F.when((port == "") | default, F.lit("")).otherwise(F.concat(F.lit(":"), port)),
        _canonical_path(path(u)),
        F.when(q == "", F.lit("")).otherwise(F.concat(F.lit("?"), _canonical_query(q))))
    return F.when((s != "") & (host != ""), out)


def canonical_http_url(url: Column, base: Column | None = None) -> Column:
    """As `canonical_url`, but only http(s) and no embedded credentials."""
    def checked(u: Column) -> Column:
        return F.when(scheme(u).isin("http", "https") & ~authority(u).contains("@"), _canonical(u))

    return let(F.trim(join_url(base, url) if base is not None else url), checked)


def url_problem(url: Column) -> Column:
    """Why `canonical_http_url` is null."""
    return (F.when(scheme(url) == "", "missing_scheme").when(hostname(url) == "", "missing_host")
            .when(~scheme(url).isin("http", "https"), "unsupported_scheme")
            .when(authority(url).contains("@"), "credentials"))


# --- platforms -------------------------------------------------------------------------------------
def host_suffixes(host: Column) -> Column:
    """`a.b.c` -> [`a.b.c`, `b.c`, `c`]: turns `is under` into equality tests."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))


def _platform_ranks(platforms: list) -> Column:
    ranks: dict[str, int] = {}
    for rank, p in enumerate(platforms):
        for host in p.hosts:
            ranks.setdefault(host, rank)
    return literal_map(ranks)


def platform_rank(host: Column, platforms: list = PLATFORMS) -> Column:
    """Rule order of the first platform the host belongs to, else null."""
    ranks = _platform_ranks(platforms)
    hits = F.transform(host_suffixes(host), lambda s: F.try_element_at(ranks, s))
    return F.array_min(hits)


def _by_rank(rank: Column, values: list) -> Column:
    return F.get(literal(values, "array<boolean>" if isinstance(values[0], bool) else "array<string>"), rank)


def detect_platform(url: Column, platforms: list = PLATFORMS) -> Column:
    """struct(platform, tenant, confidence, supported, careers_url, api_url) or null.

    The platform table is bounded by the rule file, so it is a literal map:
    the lookup is an equality test per host suffix and needs no join.
    """
    def describe(s: Column) -> Column:
        platform = _by_rank(s["rank"], [p.name for p in platforms])
        segs = s["segs"]
        nth = F.when((platform == "workable") & (F.get(segs, F.lit(0)) == "api") & (F.size(segs) >= 2), 1).otherwise(0)
        return F.struct(s["rank"].alias("rank"), platform.alias("platform"), F.lower(F.get(segs, nth)).alias("tenant"))

    def finish(s: Column) -> Column:
        def template(values: list) -> Column:
            return F.when(s["tenant"].isNotNull(), F.replace(_by_rank(s["rank"], values), F.lit("{tenant}"), s["tenant"]))

        return F.when(s["rank"].isNotNull(), F.struct(
            s["platform"].alias("platform"), s["tenant"].alias("tenant"),
            F.when(s["tenant"].isNull(), F.lit(0.7)).otherwise(F.lit(0.95)).alias("confidence"),
            _by_rank(s["rank"], [p.supported for p in platforms]).alias("supported"),
            template([p.board for p in platforms]).alias("careers_url"),
            template([p.api for p in platforms]).alias("api_url")))

    facts = let(url, lambda u: F.struct(platform_rank(hostname(u), platforms).alias("rank"), segments(path(u)).alias("segs")))
    return let(let(facts, describe), finish)


def embedded_board_url(html: Column, platforms: list = PLATFORMS) -> Column:
    """First URL in a page whose host belongs to a platform: one regular-expression scan."""
    hosts = "|".join(h.replace(".", r"\.") for p in platforms for h in p.hosts)
    stop = r"\s\"'<>"
    pattern = (r"(?i)https?://(?:[^/?#@" + stop + r"]*@)?(?:[^/?#@:." + stop + r"]+\.)*(?:" + hosts + r")"
               r"(?::\d*)?(?:[/?#][^" + stop + r"]*|(?=[.,)]*(?:[" + stop + r"]|$)))")
    hit = F.regexp_extract(html, pattern, 0)
    return F.nullif(F.regexp_replace(hit, r"[.,)]+$", ""), F.lit(""))


def detect_platform_page(url: Column | None, html: Column, platforms: list = PLATFORMS) -> Column:
    """The page's own URL, then the first embedded board URL, then a posting in JSON-LD."""
    inside = detect_platform(embedded_board_url(html, platforms), platforms)
    low = F.lower(html)
    posting = F.when(low.contains('"@type"') & low.contains("jobposting"), F.struct(
        F.lit("json_ld").alias("platform"), F.lit(None).cast("string").alias("tenant"),
        F.lit(0.6).alias("confidence"), F.lit(True).alias("supported"),
        F.lit(None).cast("string").alias("careers_url"), F.lit(None).cast("string").alias("api_url")))
    if url is None:
        return F.coalesce(inside, posting)
    return F.coalesce(detect_platform(url, platforms), inside, posting)


def board_tenant(url: Column) -> Column:
    """C20: struct(platform, tenant); knows API paths and keeps the tenant's case."""
    facts = let(url, lambda u: F.struct(hostname(u).alias("raw"), F.lower(u).alias("low"), segments(path(u)).alias("seg")))
    return let(facts, _board_tenant)


def _board_tenant(facts: Column) -> Column:
    raw, seg, low = facts["raw"], facts["seg"], facts["low"]
    host = F.regexp_replace(raw, r"\.+$", "")
    n = F.size(seg)

    def at(i: int) -> Column:
        return F.get(seg, F.lit(i))

    def hosts(name: str) -> list[str]:
        return next(list(p.hosts) for p in PLATFORMS if p.name == name)

    workday = host.rlike(r"(^|\.)(myworkdayjobs\.com|myworkdaysite\.com)$")
    listing = (host.isin("raw.githubusercontent.com", "cdn.jsdelivr.net") | host.contains("simplifyjobs"))
    feed = (F.when(low.contains("summer2026-internships"), "summer2026-internships")
            .when(low.contains("summer2027-internships"), "summer2027-internships")
            .when(low.contains("new-grad-positions"), "new-grad-positions"))

    def pair(name: str, tenant: Column) -> Column:
        return F.struct(F.lit(name).alias("platform"), tenant.alias("tenant"))

    return (
        F.when(host.isin(hosts("greenhouse")),
               pair("greenhouse", F.when((at(0) == "v1") & (n >= 3) & (at(1) == "boards"), at(2)).otherwise(at(0))))
        .when(host.isin(hosts("lever")),
              pair("lever", F.when((at(0) == "v0") & (n >= 3) & (at(1) == "postings"), at(2)).otherwise(at(0))))
        .when(host.isin(hosts("ashby")),
              pair("ashby", F.when((at(0) == "posting-api") & (n >= 3), at(2)).otherwise(at(0))))
        .when(host.isin(hosts("smartrecruiters")),
              pair("smartrecruiters",
                   F.when((at(0) == "v1") & (n >= 3) & (at(1) == "companies"), at(2)).otherwise(at(0))))
        .when(workday,
              pair("workday", F.when((n >= 4) & (at(0) == "wday") & (at(1) == "cxs"),
                                     F.concat_ws("/", raw, at(2), at(3)))
                   .when(n >= 1, F.concat_ws("/", raw, at(0))).otherwise(raw)))
        .when(host.isin(hosts("workable")),
              pair("workable", F.when((at(0) == "api") & (n >= 4) & (at(3) == "accounts"), at(4)).otherwise(at(0))))
        .when(listing, pair("simplify", feed))
        .when(host != "", pair("json_ld", F.coalesce(at(0), raw))))


def workday_parts(tenant: Column) -> Column:
    """struct(host, cxs, site) of a `host/site` or `host/cxs/site` tenant, else null."""
    raw = F.regexp_replace(F.trim(tenant), r"^https?://", "")
    pattern = r"(?i)^([a-z0-9.-]+\.myworkday(?:jobs|site)\.com)/(?:([^/]+)/)?([^/]+)/?$"
    host = F.lower(F.regexp_extract(raw, pattern, 1))
    named = F.regexp_extract(raw, pattern, 2)
    parts = F.struct(host.alias("host"),
                     F.when(named == "", F.substring_index(host, ".", 1)).otherwise(named).alias("cxs"),
                     F.regexp_extract(raw, pattern, 3).alias("site"))
    return F.when(raw.rlike(pattern), parts)


def board_urls(platform: Column, tenant: Column, platforms: list = PLATFORMS) -> Column:
    """struct(api_url, careers_url) from the platform's templates."""
    def fill(values: dict[str, str]) -> Column:
        return F.replace(F.try_element_at(literal_map(values), platform), F.lit("{tenant}"), tenant)

    wd = workday_parts(tenant)
    wd_api = F.coalesce(F.concat(F.lit("https://"), wd["host"], F.lit("/wday/cxs/"), wd["cxs"], F.lit("/"),
                                 wd["site"], F.lit("/jobs")), F.concat(F.lit("https://"), tenant))
    wd_board = F.concat(F.lit("https://"), wd["host"], F.lit("/"), wd["site"])
    return F.struct(
        F.when(platform == "workday", wd_api)
        .otherwise(fill({p.name: p.api for p in platforms if p.api})).alias("api_url"),
        F.when(platform == "workday", wd_board)
        .otherwise(fill({p.name: p.board for p in platforms if p.board})).alias("careers_url"))


def tenant_in_path(url: Column, host_part: str) -> Column:
    """First path segment that is not a fixed route word, if it looks like a tenant."""
    # fixed values: route words that are not tenants
    words = ["jobs", "job", "boards", "embed", "v2", "api"]
    first = F.get(F.filter(segments(path(url)), lambda s: ~F.lower(s).isin(words)), F.lit(0))
    ok = hostname(url).contains(host_part) & first.rlike(r"(?i)^[a-z0-9-]+$")
    return F.when(ok, F.lower(first))


def logo_domain(d: Column) -> Column:
    return F.lower(F.regexp_replace(d, r"(?i)^(www|about|careers|jobs)\.", ""))


def first_own_domain(urls: list[Column]) -> Column:
    """First URL host that is not a hosting platform."""
    hosts = [domain(u) for u in urls]
    return F.coalesce(*[F.when(h.isNotNull() & ~h.rlike(PLATFORM_HOST), logo_domain(h)) for h in hosts])
