import pytest
from pyspark.sql import functions as F

from vacantic.operators import classify, places, terms
from vacantic.plans.normalize import employment_type
from vacantic.rules import RuleSet, load_rules, read_rule_files, rule_set_from


def table(spark, rows, schema):
    """Case rows with their position, and a function that returns results in case order."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    return df, lambda out: out.orderBy("i").collect()


LEVELS = [
    ("Software Engineering Intern", "", "", "internship", 0.65, 1), ("Senior Software Engineer", "Not an intern role.", "", "unknown", 0, 0),
    ("Software Engineer II", "We also run an intern program and hire junior teammates.", "", None, 0, 0.5499),
    ("New Grad Software Engineer", "", "", "new_grad", 0.65, 1), ("STEP Intern — Software", "", "", "internship", 0.65, 1),
    ("Jr. Software Engineer", "", "", "entry_level", 0.65, 1), ("Software Engineer I", "", "", "entry_level", 0.65, 1),
    ("Lead Intern, Product Design", "", "", "internship", 0.65, 1), ("Software Engineer", "", "Intern Internship", "internship", 0.78, 0.78),
    ("Software Engineer", "", "New Grad", "new_grad", 0.8, 0.8), ("Software Engineer", "", "New Graduate", "new_grad", 0.8, 0.8),
    ("Tech Lead", "", "", "unknown", 0, 0)]


def test_level(spark):
    df, rows = table(spark, [c[:3] for c in LEVELS], "t string, b string, h string")
    for r, (*_, want, low, high) in zip(rows(classify.enrich_level(df, "t", "b", F.col("h"))), LEVELS):
        assert want is None or r.career_level == want, r
        assert low - 1e-9 <= r.career_level_confidence <= high + 1e-9, r


TERMS = [
    ("Intern - Summer 2027", "", "", None, "summer"), ("Fall Co-op Developer", "", "", None, "fall"), ("New Grad", "", "", None, "unknown"),
    ("Intern", "", "", ["Summer 2026"], "summer"), ("Backend", "", "Build APIs with Spring Boot and Java.", None, "unknown"),
    ("Platform Intern", "", "We are rolling out a new pipeline.", None, "unknown"), ("Fall / Winter 2026 Intern", "", "", None, "fall"),
    ("Intern", "", "Applications on a rolling basis", None, "rolling")]


def test_term(spark):
    df, rows = table(spark, [c[:4] for c in TERMS], "t string, s string, d string, x array<string>")
    assert [r.academic_term for r in rows(classify.enrich_term(df, "t", "s", "d", "x"))] == [c[4] for c in TERMS]


def test_discipline_and_skills(spark):
    df = spark.createDataFrame([("Backend Engineer", "Platform Engineering", "Python, React, C++ and Kubernetes; Go.")], "t string, d string, b string")
    r = classify.enrich_discipline(df, "t", "d", "b").first().disciplines
    assert r.primary == "backend" and r.confidence >= 0.5
    assert classify.enrich_skills(df, "b").first().skills == ["C++", "Go", "Kubernetes", "Python", "React"]
    none = spark.createDataFrame([("Baker", "", "")], "t string, d string, b string")
    r = classify.enrich_discipline(none, "t", "d", "b").first().disciplines
    assert (r.primary, r.secondary, r.confidence) == ("other", [], 0.0)


PLACES = [
    ("San Francisco, CA, USA", "San Francisco", "California", "United States", "US", "North America"), ("San Francisco, CA", "San Francisco", "California", "United States", "US", "North America"),
    ("Toronto, ON, CA", "Toronto", "Ontario", "Canada", "CA", "North America"), ("Paris, TX", "Paris", "Texas", "United States", "US", "North America"),
    ("Paris, Île-de-France, France", "Paris", "Île-de-France", "France", "FR", "Europe"), ("Remote", None, None, None, None, None),
    ("Remote - US", None, None, None, None, None), ("London, England, United Kingdom", "London", "England", "United Kingdom", "GB", "Europe"),
    ("Lagos, Lagos State, Nowhere", "Lagos", "Lagos State", "Nowhere", None, None), ("Tokyo, Japan", "Tokyo", "Japan", "Japan", "JP", "Asia"),
    ("Seattle, WA", "Seattle", "Washington", "United States", "US", "North America"), ("Oslo", "Oslo", None, None, None, None)]


def test_places(spark):
    df, rows = table(spark, [([c[0]],) for c in PLACES], "locations_raw array<string>")
    for r, want in zip(rows(places.enrich_locations(df)), PLACES):
        p = r.locations[0]
        assert (p.raw, p.city, p.region, p.country, p.country_code, p.continent) == want


WORKPLACES = [
    (["Hybrid - New York, NY"], "", "hybrid"), (["Hybrid"], "", "hybrid"), (["Remote - United States"], "", "remote"), (["San Francisco, CA, USA"], "", "onsite"),
    ([], "", "unknown"), (["Berlin, Germany"], "remote possible", "hybrid"), ([], "office based", "onsite")]


def test_workplace(spark):
    df, rows = table(spark, [c[:2] for c in WORKPLACES], "locations_raw array<string>, d string")
    assert [r.workplace_type for r in rows(places.enrich_workplace(df, description="d"))] == [c[2] for c in WORKPLACES]


SCOPES = [
    (["Remote"], "work anywhere in the world", "worldwide", [], []), (["Remote - United States"], "Canada too", "country_limited", ["US", "CA"], []),
    (["Remote"], "EMEA or Europe", "region_limited", [], ["EMEA", "EU"]), (["Remote"], "within pst please", "timezone_limited", [], []),
    (["Remote"], "", "location_limited", [], []), (["Berlin, Germany"], "", "unknown", [], [])]


def test_workplace_gates_keep_every_match(spark):
    df, rows = table(spark, [(t,) for t in ("office based", "in-office role", "in office", "on-site", "on site", "work from home", "wfh", "distributed team",
                                            "anywhere", "telecommute", "remote", "hybrid", "websites", "plain", "")], "t string")
    by_gate = [places._says(F.col("t"), p, g) for p, g in ((places.HYBRID_WORDS, ["hybrid"]), (places.REMOTE_WORDS, places.REMOTE_GATE),
                                                           (places.ONSITE_WORDS, ["site", "office"]))]
    plain = [F.col("t").rlike(p) for p in (places.HYBRID_WORDS, places.REMOTE_WORDS, places.ONSITE_WORDS)]
    assert all(r.a == r.b for r in rows(df.select("i", F.array(*by_gate).alias("a"), F.array(*plain).alias("b"))))


def test_rule_words_from_marks(spark):
    df, rows = table(spark, [("software engineer, c++ intern",), ("",), ("data--science_x new grad",), ("straße café software",)], "t string")
    marked = classify.rule_words(F.col("t"), None, classify.mark_words(F.col("t")))
    assert all(r.a == r.b for r in rows(df.select("i", F.array_sort(F.filter(marked, lambda w: w != "")).alias("a"),
                                                  F.array_sort(F.filter(classify.rule_words(F.col("t")), lambda w: w != "")).alias("b"))))


def test_remote_scope(spark):
    df, rows = table(spark, [c[:2] for c in SCOPES], "locations_raw array<string>, d string")
    for r, (_, _, *want) in zip(rows(places.enrich_remote_scope(df, description="d")), SCOPES):
        assert [r.remote_scope, r.remote_allowed_countries, r.remote_allowed_regions] == want


@pytest.mark.parametrize("text,low,high,currency,period", [
    ("$120,000 - $150,000 per year", 120000, 150000, "USD", "year"), ("€50k to €60k annually", 50000, 60000, "EUR", "year"), ("C$35 /hr", 35, None, "CAD", "hour"),
    ("£1.5M", 1500000, None, "GBP", "unknown"), ("USD 40 hourly in Toronto", 40, None, "USD", "hour"), ("competitive", None, None, None, "unknown")])
def test_pay(one, text, low, high, currency, period):
    p = one(terms.parse_pay(F.col("s")), s=text)
    assert (p.min_amount, p.max_amount, p.currency, p.period) == (low, high, currency, period)


def test_pay_in_text(one):
    text = "We pay well. Salary: $90,000 - $110,000 per year. Compensation: 5"
    p = one(terms.pay_from_text(F.col("s")), s=text)
    assert (p.min_amount, p.max_amount) == (90000, 110000)
    assert one(terms.pay_from_text(F.col("s")), s="no numbers about pay here at all") is None


def test_benefits(spark):
    rows = [("We offer visa sponsorship for qualified candidates.",), ("No visa sponsorship is available for this role.",),
            ("Housing stipend provided. Airfare reimbursement available.",), ("Join us in Austin.",)]
    out = [r.mobility for r in terms.enrich_benefits(spark.createDataFrame(rows, "d string").coalesce(1), "d").collect()]
    assert out[0].visa_sponsorship.status == "confirmed" and out[0].visa_sponsorship.confidence == 0.85
    assert out[1].visa_sponsorship.status == "not_available" and "no visa sponsorship" in out[1].visa_sponsorship.evidence_excerpt
    assert out[2].housing_stipend.status == "confirmed" and out[2].airfare.extraction_rule == "airfare:positive"
    assert out[3].relocation_assistance.status == "unknown" and out[3].relocation_assistance.evidence_excerpt is None


def test_eligibility_and_origin(spark):
    text = "U.S. citizenship is required. Active secret clearance; ITAR. Fluent in English and Spanish."
    df = terms.enrich_eligibility(spark.createDataFrame([(text,)], "d string"), "d")
    e = df.first().eligibility
    assert e.work_authorization == "us_citizen_required" and e.citizenship_requirements == ["US"] and e.security_clearance == "Active secret"
    assert e.export_control_restrictions and e.language_requirements == ["English"]
    assert terms.match_origin(df, "US").first().origin_match == "explicit_match"
    assert terms.match_origin(df, "in").first().origin_match == "explicitly_ineligible"
    assert terms.match_origin(df, "").first().origin_match == "unknown"
    e = terms.enrich_eligibility(spark.createDataFrame([("Must be located in Canada, India and France only.",)], "d string"), "d").first().eligibility
    assert e.explicit_allowed_countries == ["CA", "IN"]  # the phrase runs to the next punctuation, "france only" is no country


def test_employment_type(one):
    assert one(employment_type(F.lit("full-time"))) == "full_time" and one(employment_type(F.lit("odd"))) == "unknown"


def test_reclassify_counts_changes(spark):
    df = spark.createDataFrame([("Software Intern", "x", "unknown", 0.0, "full_time"), ("Baker", "x", "unknown", 0.0, "full_time")],
                               "title string, summary string, career_level string, career_level_confidence double, employment_type string")
    r = classify.reclassify_summary(df).first()
    assert (r.rows, r.changed) == (2, 1)


def test_rules_round_trip(spark):
    rows = load_rules(spark)
    r = rule_set_from(rows)
    assert [x[0] for x in r.career_levels][:2] == ["internship", "co_op"] and len(r.benefits) == 12 and len(r.skills) == 48
    assert len(rows.where("family = 'platform'").collect()) > 20


def test_rules_keep_order_and_case_through_any_shuffle(spark):
    rows = load_rules(spark)
    for seed in (1, 2):
        assert rule_set_from(rows.orderBy(F.rand(seed)).repartition(11, "pattern")) == RuleSet()


def test_rule_files():
    r = read_rule_files("disciplines:\n  - {id: x, label: X Y, aliases: [b, a]}\ncareer_levels:\n  - {id: l, patterns: [p q]}\n", "skills:\n  C++: {aliases: [cpp]}\n  Go:\n")
    assert r.disciplines == [("x", "X Y", ["b", "a"])] and r.career_levels == [("l", ["p q"])] and r.skills == [("C++", ["cpp"]), ("Go", [])]
    assert read_rule_files("", "") == RuleSet()


def test_level_counts_phrases_of_title_and_body_by_the_words_that_start_them(spark):
    rules = RuleSet(career_levels=[("a", ["big co", "c++ lab", "&", "big co"]), ("b", ["lab", "big company"])])
    rows = [("big co", "lab of the big co"), ("x", "big company & c++ lab"), ("nothing", "labs"), ("big", "co"), (None, "lab"), ("lab", None)]
    df = spark.createDataFrame(rows, "t string, b string")
    made = classify.career_level(F.col("t"), F.trim(F.concat_ws(" ", "t", "b")), None, rules)
    got = [(r.l.level, round(r.l.confidence, 2)) for r in df.select(made.alias("l")).collect()]
    assert got == [("a", 0.92), ("a", 0.44), ("unknown", 0.0), ("a", 0.44), ("unknown", 0.0), ("b", 0.82)]
    heads = spark.range(1).select(classify.rule_words(F.lit("lab big lab x co"), rules).alias("w")).first().w
    assert [w for w in heads if w in ("lab", "big")] == ["lab", "big"] and "x" not in heads
    plan = df.select(made.alias("l"))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" not in plan
