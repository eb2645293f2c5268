import datetime as dt
import json

from pyspark.sql import functions as F

from vacantic.plans.normalize import normalize
from vacantic.sources import boards

SCHEMA = ("source_id string, company_id string, company_name string, adapter string, adapter_tenant string, careers_url string, "
          "fetched_at timestamp, payload string")


def payload(spark, adapter, body, tenant="acme"):
    body = body if isinstance(body, str) else json.dumps(body)
    row = (f"{adapter}-{tenant}", "c1", "Acme", adapter, tenant, "https://example.com/careers", dt.datetime(2025, 8, 1), body)
    return spark.createDataFrame([row], SCHEMA)


GREENHOUSE = {"jobs": [
    {"id": 71, "title": "Software Engineer, Intern ", "absolute_url": "https://boards.greenhouse.io/acme/jobs/71", "location": {"name": "San Francisco, CA"},
     "metadata": [{"name": "Department", "value": "Engineering"}], "requisition_id": "REQ-1", "content": "<p>Build &amp; ship.<br>Learn</p>",
     "first_published": "2025-07-01T12:00:00Z", "updated_at": "2025-08-15T18:42:11-04:00"},
    {"id": 72, "title": "New Grad", "absolute_url": "https://x.example/72", "location": None, "metadata": {"office": ["Remote - US", "NYC"], "team": "Infra"}},
    {"id": 73, "title": "", "absolute_url": "https://x.example/73"}, {"title": "no id", "absolute_url": "https://x.example/74"}, "junk"]}


def test_greenhouse(spark):
    rows = {r.source_job_id: r for r in boards.ingest_greenhouse(payload(spark, "greenhouse", GREENHOUSE)).collect()}
    assert set(rows) == {"71", "72"}
    a = rows["71"]
    assert (a.title, a.requisition_id, a.locations_raw, a.department) == ("Software Engineer, Intern", "REQ-1", ["San Francisco, CA"], "Engineering")
    assert a.description_text.startswith("Build & ship.\nLearn")
    assert a.posted_at == dt.datetime(2025, 7, 1, 12) and a.updated_at == dt.datetime(2025, 8, 15, 22, 42, 11)
    assert rows["72"].locations_raw == ["Remote - US", "NYC"] and rows["72"].department == "Infra"


def test_greenhouse_bare_list(spark):
    assert boards.ingest_greenhouse(payload(spark, "greenhouse", GREENHOUSE["jobs"])).count() == 2


def test_lever(spark):
    body = [{"id": "a", "text": "Backend Engineer", "hostedUrl": "https://jobs.lever.co/acme/a", "categories": {"commitment": "Full-time", "location": "Berlin", "department": "Eng", "team": "T"},
             "descriptionPlain": "Build APIs.", "descriptionBodyPlain": "Build APIs.", "additionalPlain": "Mission.", "lists": [{"text": "You", "content": "<li>code"}, 5], "createdAt": 1722441600000},
            {"id": "b", "text": "No link"}]
    r = boards.ingest_lever(payload(spark, "lever", body)).collect()
    assert len(r) == 1
    assert r[0].description_text == "Build APIs.\n\nMission.\n\nYou\ncode"
    assert (r[0].employment_type, r[0].department, r[0].apply_url) == ("Full-time", "Eng", "https://jobs.lever.co/acme/a")
    assert r[0].posted_at == dt.datetime(2024, 7, 31, 16)
    assert boards.ingest_lever(payload(spark, "lever", {"jobs": body})).count() == 0


def test_ashby(spark):
    body = {"jobs": [{"id": "a", "title": "Engineer", "department": "Eng", "location": "New York, NY", "jobUrl": "https://a.example/a", "applyUrl": "https://a.example/a/application", "employmentType": "FullTime"},
                     {"id": "b", "title": "Ops", "department": {"name": "Operations"}, "location": {"location": "Paris"}, "applyUrl": "https://a.example/b", "descriptionHtml": "<p>Support it"}]}
    r = {x.source_job_id: x for x in boards.ingest_ashby(payload(spark, "ashby", body)).collect()}
    assert r["a"].apply_url.endswith("/application") and r["a"].locations_raw == ["New York, NY"]
    assert (r["b"].department, r["b"].locations_raw, r["b"].job_url, r["b"].description_text) == ("Operations", ["Paris"], "https://a.example/b", "Support it")


def test_smartrecruiters(spark):
    body = {"content": [{"id": "1", "name": "Graduate", "refNumber": "R1", "location": {"city": "London", "region": "England", "country": "UK"}, "typeOfEmployment": {"label": "Full-time"},
                         "experienceLevel": {"label": "Entry Level"}, "company": {"identifier": "AcmeCorp"}, "slug": "graduate"},
                        {"id": "2", "jobAdTitle": "Intern", "typeOfEmployment": "Internship", "department": "Design"}]}
    r = {x.source_job_id: x for x in boards.ingest_smartrecruiters(payload(spark, "smartrecruiters", body)).collect()}
    assert r["1"].job_url == "https://careers.smartrecruiters.com/AcmeCorp/graduate" and r["1"].locations_raw == ["London, England, UK"]
    assert r["1"].metadata.experience_level == "Entry Level" and r["1"].requisition_id == "R1"
    assert (r["2"].title, r["2"].employment_type, r["2"].job_url) == ("Intern", "Internship", "https://careers.smartrecruiters.com/acme/2")


def test_workday(spark):
    body = {"jobPostings": [{"title": "Analyst", "externalPath": "job/Berlin/R-7", "locationsText": "Berlin", "bulletFields": ["Berlin", "R-7", "123", "x" * 90, 4], "postedOn": "Posted 3 Days Ago"},
                            {"title": "No path"}]}
    r = boards.ingest_workday(payload(spark, "workday", body, "acme.wd5.myworkdayjobs.com/Site")).collect()
    assert len(r) == 1 and r[0].job_url == "https://acme.wd5.myworkdayjobs.com/Site/job/Berlin/R-7"
    assert (r[0].source_job_id, r[0].locations_raw, r[0].posted_at) == ("R-7", ["Berlin", "R-7"], None)


def test_workable(spark):
    body = {"jobs": [{"shortcode": "S1", "title": "Clerk", "city": "Rome", "country": "Italy", "department": "Ops"},
                     {"id": "9", "title": "Cook", "locations": [{"country": "Spain"}, " Lyon ", {}], "application_url": "https://w.example/9", "published_on": "2025-01-02"}]}
    r = {x.source_job_id: x for x in boards.ingest_workable(payload(spark, "workable", body)).collect()}
    assert r["S1"].job_url == "https://apply.workable.com/acme/j/S1/" and r["S1"].locations_raw == ["Rome, Italy"] and r["S1"].employment_type == "Ops"
    assert r["9"].locations_raw == ["Spain", "Lyon"] and r["9"].posted_at == dt.datetime(2025, 1, 2)


def test_jsonld(spark):
    node = {"@type": ["Thing", "jobposting"], "title": "Junior Analyst", "description": "<p>Analyze.</p><p>Report</p>", "identifier": {"value": "EC-1"}, "datePosted": "2025-07-15",
            "employmentType": ["FULL_TIME", "X"], "hiringOrganization": {"name": "Acme"}, "url": "/careers/ja", "directApply": True,
            "jobLocation": [{"@type": "Place", "address": {"addressLocality": "Toronto", "addressRegion": "ON", "addressCountry": "CA"}}, "Remote"]}
    html = ("<html><script type='application/ld+json'>{bad json</script><script TYPE=\"application/ld+json\">" + json.dumps({"@graph": [node, {"@type": "Org"}]})
            + "</script><script>var x</script></html>")
    r = boards.extract_jsonld(payload(spark, "json_ld", html)).collect()
    assert len(r) == 1
    j = r[0]
    assert (j.source_job_id, j.title, j.job_url, j.apply_url) == ("EC-1", "Junior Analyst", "https://example.com/careers/ja", "https://example.com/careers/ja")
    assert j.locations_raw == ["Toronto, ON, CA", "Remote"] and j.employment_type == "FULL_TIME" and j.description_text == "Analyze.\nReport"


LISTING = [
    {"id": "1", "title": "Intern", "company_name": "Acme", "active": True, "is_visible": True, "category": "Software", "url": "https://boards.greenhouse.io/acme/jobs/1", "terms": ["Summer 2026"],
     "locations": ["SF", " "], "date_posted": 1726500000, "sponsorship": "Other"},
    {"id": "2", "title": "Intern", "company_name": "Citadel X", "url": "https://www.citadel.example/careers/x", "category": "", "date_posted": 1726500000000, "sponsorship": "Offers Sponsorship"},
    {"id": "3", "title": "Intern", "company_name": "Blocked", "url": "https://www.linkedin.com/jobs/view/9", "category": "Software"},
    {"id": "4", "title": "Cook", "company_name": "Other", "url": "https://o.example/1", "category": "Other"},
    {"id": "5", "title": "Intern", "company_name": "Closed", "active": False, "url": "https://o.example/2", "category": "Software"},
    {"id": "6", "title": "Intern", "company_name": "Bad", "url": "http://[broken", "category": "Software"}]


def test_listing_feed(spark):
    r = {x.source_job_id: x for x in boards.ingest_listing_feed(payload(spark, "simplify", LISTING, "summer2026-internships")).collect()}
    assert {"1", "2"} <= set(r) and not {"3", "4", "5"} & set(r)
    assert r["1"].metadata.company_domain == "acme.com" and r["2"].metadata.company_domain == "citadel.example"
    assert r["1"].summary == "Intern — Acme — Software — Summer 2026" and r["2"].summary == "Intern — Citadel X — Offers Sponsorship"
    assert r["1"].posted_at == r["2"].posted_at == dt.datetime(2024, 9, 16, 15, 20)
    assert r["1"].metadata.experience_level == "Internship"
    g = boards.ingest_listing_feed(payload(spark, "simplify", LISTING[:1], "new-grad-positions")).first()
    assert (g.metadata.experience_level, g.employment_type) == ("New Grad", "Full-time")


def test_union_and_normalize(spark):
    both = payload(spark, "greenhouse", GREENHOUSE).unionByName(payload(spark, "simplify", LISTING, "summer2026-internships"))
    raw = boards.union_sources(both)
    rows = {r.source_job_id: r for r in normalize(raw, candidate_country="US").collect()}
    a = rows["71"]
    assert (a.career_level, a.disciplines.primary, a.workplace_type) == ("internship", "software", "onsite")
    assert a.locations[0].city == "San Francisco" and a.locations[0].region == "California" and a.locations[0].country_code == "US"
    assert len(a.job_id) == 64 and a.lifecycle == "open" and a.provenance.content_hash == a.content_hash
    assert rows["1"].academic_term == "summer" and rows["1"].company_name == "Acme" and rows["1"].company_id != "c1"
    assert a.eligibility.origin_match == "unknown" and a.mobility.visa_sponsorship.status == "unknown"


def test_cleaned_text_is_not_cleaned_again_in_every_place_that_reads_it(spark):
    raw = boards.ingest_greenhouse(payload(spark, "greenhouse", GREENHOUSE))
    plan = normalize(raw).select("job_id", "summary", "career_level", "workplace_type")._jdf.queryExecution().optimizedPlan().toString()
    readings = [line for line in plan.splitlines() if "$.content" in line]
    # the select that reads the text, and the Python pass before it
    assert len(readings) <= 2 and plan.count("$.content") <= 8, plan.count("$.content")


def test_a_field_is_read_once_where_it_is_named(spark):
    lever = boards.ingest_lever(payload(spark, "lever", [{"id": "x", "text": "[Intern]", "hostedUrl": "{u}", "categories": {"team": {"a": 1}, "department": []}}]))
    r = lever.first()
    assert (r.title, r.job_url, r.metadata.team, r.department) == ("[Intern]", "{u}", None, None)
    plan = lever.select("job_url")._jdf.queryExecution().optimizedPlan().toString()
    # in the test for a missing URL and in the result
    assert plan.count("$.hostedUrl, StringType") <= 2, plan.count("$.hostedUrl, StringType")


def test_unknown_adapters(spark):
    assert boards.unknown_adapters(payload(spark, "carrier-pigeon", [])).collect()[0].payloads == 1


def test_bad_payloads_give_no_rows(spark):
    df = payload(spark, "greenhouse", "x")
    for bad in ["", "not json", "{}", "[]", '{"jobs": 5}', "null"]:
        df = df.unionByName(payload(spark, "greenhouse", bad))
    names = F.array(*[F.lit(n) for n in boards.READERS])
    every = df.drop("adapter").withColumn("adapter", F.explode(names)).select(*df.columns)
    assert boards.union_sources(every).count() == 0


def test_a_member_of_any_kind_reads_as_a_look_at_its_path_does(spark):
    items = ['{"id": "1", "name": 7, "ref": 1.50, "slug": "{a}", "uuid": "[b]", "location": {"city": "Rome", "region": ["x"], "country": null}}',
             '{"id": 2, "name": "B", "ref": {"a": 1}, "slug": [1], "uuid": "", "ID": "other", "location": "Oslo", "department": {"label": "L"}}',
             '{"id": true, "name": "", "jobAdTitle": "C", "location": ["Oslo"], "department": "D", "typeOfEmployment": {"label": {"x": 1}}}', '[1]', 'null']
    p = payload(spark, "smartrecruiters", '{"content": [' + ", ".join(items) + "]}")
    names = ["id", "name", "ref", "slug", "uuid", "location", "location.city", "location.region", "location.country", "department.label",
             "department", "typeOfEmployment.label", "missing", "missing.too"]
    df = boards._rows(p, "smartrecruiters", boards._items(F.col("payload"), "content"), *names)
    got = df.select(*[boards._member(n).alias(f"m{i}") for i, n in enumerate(names)], *[boards._text(F.col("v"), f"$.{n}").alias(f"t{i}") for i, n in enumerate(names)],
                    boards._string_member("name").alias("ms"), boards._string(F.col("v"), "$.name").alias("ts")).collect()
    assert len(got) == 3
    for r in got:
        assert [r[f"m{i}"] for i in range(len(names))] == [r[f"t{i}"] for i in range(len(names))] and r.ms == r.ts
    assert [r.m0 for r in got] == ["1", "2", "true"] and [r.m6 for r in got] == ["Rome", None, None] and [r.m3 for r in got] == ["{a}", None, None]


def test_an_object_is_opened_once_and_missing_members_are_not_looked_for(spark):
    df = boards.ingest_smartrecruiters(payload(spark, "smartrecruiters", {"content": [{"id": 1, "name": "A", "typeOfEmployment": "full"}]}))
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count("StructField(slug,") == 1 and "$.slug, StringType" not in plan
    assert [(r.source_job_id, r.employment_type, r.department) for r in df.collect()] == [("1", "full", None)]


def test_long_expressions_are_kept_out_of_methods_that_are_never_compiled(spark):
    key = "spark.sql.codegen.hugeMethodLimit"
    spark.conf.unset(key)
    none = spark.createDataFrame([], SCHEMA)
    boards.union_sources(none)
    assert spark.conf.get(key) == "8000"
    spark.conf.set(key, "65535")
    boards.union_sources(none)
    assert spark.conf.get(key) == "65535"
    spark.conf.unset(key)
