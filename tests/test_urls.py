from urllib.parse import parse_qsl, urlencode

import pytest
from pyspark.sql import functions as F

from vacantic.functions import ids, urls
from vacantic.functions.denylist import denied_url

CASES = {
    "HTTPS://Example.COM/Jobs/?b=2&a=1": "https://example.com/Jobs?a=1&b=2",
    "http://example.com:80/a/./b/../c//d/#frag": "http://example.com/a/c/d",
    "https://example.com:8443": "https://example.com:8443/",
    "https://example.com/a%20b/x y?q=1+2&empty=": "https://example.com/a%20b/x%20y?q=1+2&empty=",
    "https://example.com/%7Euser/caf%C3%A9": "https://example.com/~user/caf%C3%A9",
    "https://example.com/../../x": "https://example.com/x",
    "no-scheme.example.com/x": None,
    "https:///path": None,
}


def test_canonical_url(spark):
    df = spark.createDataFrame([(u,) for u in CASES], "u string")
    got = {r.u: r.c for r in df.select("u", urls.canonical_url(F.col("u")).alias("c")).collect()}
    want = dict(CASES)
    want["https://example.com/a%20b/x y?q=1+2&empty="] = "https://example.com/a%20b/x%20y?" + urlencode(sorted(parse_qsl("q=1+2&empty=", keep_blank_values=True)))
    assert got == want


def test_canonical_url_is_idempotent(spark):
    df = spark.createDataFrame([(u,) for u in CASES], "u string")
    c = urls.canonical_url(F.col("u"))
    rows = df.select(c.alias("c")).select("c", urls.canonical_url(F.col("c")).alias("d")).collect()
    assert all(r.c == r.d for r in rows)


def test_http_only_and_no_credentials(one):
    f = urls.canonical_http_url(F.col("u"))
    assert one(f, u="ftp://example.com/x") is None
    assert one(f, u="https://me:pw@example.com/x") is None
    assert one(urls.url_problem(F.col("u")), u="https://me@example.com/") == "credentials"


@pytest.mark.parametrize("ref,want", [
    ("/b", "https://h.example/b"), ("b", "https://h.example/a/b"), ("../b?x=1", "https://h.example/b?x=1"), ("//o.example/z", "https://o.example/z"),
    ("http://o.example/", "http://o.example/"), ("?q=1", "https://h.example/a/page?q=1"), ("", "https://h.example/a/page")])
def test_join(one, ref, want):
    assert one(urls.join_url(F.lit("https://h.example/a/page"), F.col("r")), r=ref) == want


@pytest.mark.parametrize("url,platform,tenant", [
    ("https://boards.greenhouse.io/Acme/jobs/1", "greenhouse", "acme"), ("https://api.lever.co/v0/postings/acme", "lever", "v0"),
    ("https://acme.wd5.myworkdayjobs.com/en-US/careers", "workday", "en-us"), ("https://notgreenhouse.io/x", None, None),
    ("https://boards.greenhouse.io", "greenhouse", None)])
def test_detect_platform(one, url, platform, tenant):
    d = one(urls.detect_platform(F.col("u")), u=url)
    assert (d.platform, d.tenant) == (platform, tenant) if platform else d is None
    if platform:
        assert d.confidence == (0.95 if tenant else 0.7)


@pytest.mark.parametrize("url,platform,tenant", [
    ("https://boards-api.greenhouse.io/v1/boards/Acme/jobs", "greenhouse", "Acme"), ("https://api.lever.co/v0/postings/acme", "lever", "acme"),
    ("https://api.ashbyhq.com/posting-api/job-board/acme", "ashby", "acme"), ("https://api.smartrecruiters.com/v1/companies/Acme/postings", "smartrecruiters", "Acme"),
    ("https://acme.wd5.myworkdayjobs.com/wday/cxs/acme/Site/jobs", "workday", "acme.wd5.myworkdayjobs.com/acme/Site"),
    ("https://careers.example.com/jobs/1", "json_ld", "jobs")])
def test_board_tenant(one, url, platform, tenant):
    b = one(urls.board_tenant(F.col("u")), u=url)
    assert (b.platform, b.tenant) == (platform, tenant)


def test_workday_parts(one):
    p = one(urls.workday_parts(F.col("t")), t="acme.wd12.myworkdayjobs.com/acme/External_Site")
    assert (p.host, p.cxs, p.site) == ("acme.wd12.myworkdayjobs.com", "acme", "External_Site")
    p = one(urls.workday_parts(F.col("t")), t="https://acme.wd5.myworkdayjobs.com/Site")
    assert (p.host, p.cxs, p.site) == ("acme.wd5.myworkdayjobs.com", "acme", "Site")
    assert one(urls.workday_parts(F.col("t")), t="acme") is None


def test_embedded_board(one):
    html = '<a href="https://example.com/jobs.lever.co">x</a> see https://jobs.lever.co/acme). <a href="https://boards.greenhouse.io/b">y</a>'
    assert one(urls.embedded_board_url(F.col("h")), h=html) == "https://jobs.lever.co/acme"
    assert one(urls.embedded_board_url(F.col("h")), h="https://jobs.lever.co.evil.example/x") is None


def test_denied(one):
    d = denied_url(F.col("u"))
    assert one(d, u="https://www.LinkedIn.com/x").reason == "domain"
    assert one(d, u="https://a.example.com/Jobs/View/1").matched == "/jobs/view/"
    assert one(d, u="https://careers.example.com/x") is None


def test_ids(one):
    import hashlib
    assert one(ids.deterministic_id(F.lit(" Company "), F.lit(""), F.lit("Acme.com"))) == hashlib.sha256(b"company|acme.com").hexdigest()[:16]
    assert one(ids.job_id(F.lit("greenhouse"), F.lit("acme"), F.lit("1"))) == hashlib.sha256(b"greenhouse:acme:1").hexdigest()
    h = hashlib.sha256(b"abc").hexdigest()
    assert one(ids.bucket(F.lit("abc"))) == int(h[:8], 16) % 32
