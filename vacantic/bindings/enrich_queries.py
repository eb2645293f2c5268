"""Bindings of enrichment, ranking and duplicates. Rules are bound to words that occur in the sample tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantic.bindings import tables as t
from vacantic.bindings.ingest_queries import all_payloads, greenhouse_payloads
from vacantic.bindings.registry import fold_sql, phrase_sql, plain_sql, query
from vacantic.functions.text import canonical_text
from vacantic.operators import classify, dedupe, places, terms
from vacantic.operators.scale import spread
from vacantic.plans.normalize import normalize
from vacantic.rules import RuleSet
from vacantic.sources import boards

LEVEL_RULES = [("internship", ["small ring", "ring", "economy"]), ("co_op", ["bolt", "hot bolt", "promo"]), ("new_grad", ["red", "gear", "standard"])]
DISC_RULES = [("metal", "Bolt", ["ring", "gear", "promo"]), ("round", "Ring", ["ring", "widget", "economy"]), ("colour", "Red", ["blue", "hot", "large"])]
TERM_RULES = [("summer", r"(?i)\bund\b"), ("fall", r"(?i)\bthe\b"), ("winter", r"(?i)\bque\b"), ("spring", r"(?i)\bde\b")]
SKILL_RULES = [("The", []), ("Und", ["der", "die"]), ("Que", ["en", "la"]), ("And", ["of"])]
CLAIM_RULES = [("bread", ["tion", "the"], ["the and", "que"]), ("water", ["und", "and"], ["schon", "en la"]), ("salt", ["er"], [])]
RULES = RuleSet(disciplines=DISC_RULES, career_levels=LEVEL_RULES, senior_phrases=["plate"], skills=SKILL_RULES, precise_terms=TERM_RULES,
                title_terms=[("off_cycle", ["bolt"])], benefits=CLAIM_RULES)


def _total(parts: list[str]) -> str:
    return "(" + " + ".join(f"({p})::INT" for p in parts) + ")"


# --- level ----------------------------------------------------------------------------------------------------
def _level_sql() -> str:
    cols = []
    for name, phrases in LEVEL_RULES:
        th = _total([phrase_sql("ti", p) for p in phrases])
        bh = _total([f"NOT {phrase_sql('ti', p)} AND {phrase_sql('co', p)}" for p in phrases])
        cols.append(f"CASE WHEN {th} > 0 THEN least(0.72::DOUBLE + 0.1::DOUBLE * least({th}, 2) + 0.05::DOUBLE * least({bh}, 2), 0.95::DOUBLE) "
                    f"WHEN {bh} > 0 THEN least(0.45::DOUBLE, 0.28::DOUBLE + 0.08::DOUBLE * least({bh}, 2)) ELSE 0 END AS {name}")
    return f"""
src AS (SELECT p_partkey, p_name AS ti, p_name || ' ' || lower(p_type) AS co, CASE WHEN p_size > 25 THEN 'Junior' ELSE '' END AS hint FROM part),
sc AS (SELECT *, {', '.join(cols)} FROM src),
best AS (SELECT *, greatest(internship, co_op, new_grad) AS top FROM sc),
lv AS (SELECT *, CASE WHEN contains(ti, 'plate') OR contains(ti, 'old') AND false THEN 'unknown' WHEN top < 0.55 AND hint <> '' THEN 'entry_level' WHEN top = 0 THEN 'unknown'
    WHEN internship = top THEN 'internship' WHEN co_op = top THEN 'co_op' ELSE 'new_grad' END AS level,
  CASE WHEN contains(ti, 'plate') THEN 0::DOUBLE WHEN top < 0.55 AND hint <> '' THEN 0.72::DOUBLE ELSE top::DOUBLE END AS conf FROM best)
"""


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    return t.table(spark, sf, "part")


@query("enrich_level", f"WITH {_level_sql()} SELECT p_partkey, level AS career_level, round(conf, 6) AS confidence FROM lv")
def enrich_level(spark, sf):
    hint = F.when(F.col("p_size") > 25, F.lit("Junior")).otherwise(F.lit(""))
    df = classify.enrich_level(_parts(spark, sf), "p_name", "p_type", hint, RULES)
    return df.select("p_partkey", "career_level", F.round("career_level_confidence", 6).alias("confidence"))


@query("best_level", """
SELECT o_orderkey, CASE WHEN a >= b AND a >= c THEN 'internship' WHEN b >= c THEN 'co_op' ELSE 'new_grad' END AS level FROM (
  SELECT o_orderkey, o_orderkey % 5 AS a, o_custkey % 5 AS b, floor(o_totalprice)::BIGINT % 5 AS c FROM orders)""")
def best_level(spark, sf):
    o = t.table(spark, sf, "orders")
    scores = [F.col("o_orderkey") % 5, F.col("o_custkey") % 5, F.floor("o_totalprice") % 5]
    names = ["internship", "co_op", "new_grad"]
    cells = F.array(*[F.struct(s.cast("double").alias("score"), F.lit(i).alias("ord"), F.lit(n).alias("level")) for i, (s, n) in enumerate(zip(scores, names))])
    return o.select("o_orderkey", classify.best_level(cells)["level"].alias("level"))


# --- discipline ---------------------------------------------------------------------------------------------------
def _disc_sql() -> str:
    rows = []
    for ident, label, aliases in DISC_RULES:
        ph = [label.lower(), *aliases]
        h = _total([phrase_sql("co", p) for p in ph])
        th = _total([phrase_sql("ti", p) for p in ph])
        dh = _total([phrase_sql("de", p) for p in ph])
        rows.append(f"SELECT p_partkey, '{ident}' AS id, CASE WHEN {h} > 0 THEN least(0.4::DOUBLE + 0.1::DOUBLE * least({h}, 3) + CASE WHEN {th} > 0 THEN 0.25::DOUBLE ELSE 0 END "
                    f"+ CASE WHEN {dh} > 0 THEN 0.15::DOUBLE ELSE 0 END, 0.98::DOUBLE) END AS score FROM src")
    return f"""
src AS (SELECT p_partkey, p_name AS ti, lower(p_type) AS de, p_name || ' ' || lower(p_type) || ' ' || lower(p_brand) AS co FROM part),
sc AS ({' UNION ALL '.join(rows)}),
rk AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY round(score, 9) DESC, id) AS n FROM sc WHERE score IS NOT NULL)
"""


@query("enrich_discipline", f"""
WITH {_disc_sql()} SELECT s.p_partkey, coalesce(max(id) FILTER (WHERE n = 1), 'other') AS main, coalesce(string_agg(id, ',' ORDER BY n) FILTER (WHERE n BETWEEN 2 AND 4 AND score >= 0.5), '') AS others,
  round(coalesce(max(score) FILTER (WHERE n = 1), 0), 3)::DOUBLE AS confidence FROM src s LEFT JOIN rk r ON r.p_partkey = s.p_partkey GROUP BY s.p_partkey""")
def enrich_discipline(spark, sf):
    df = classify.enrich_discipline(_parts(spark, sf), "p_name", "p_type", "p_brand", RULES)
    d = F.col("disciplines")
    return df.select("p_partkey", d["primary"].alias("main"), F.array_join(d["secondary"], ",").alias("others"), d["confidence"].alias("confidence"))


@query("rank_disciplines", """
WITH s AS (SELECT p_partkey, unnest(['a', 'b', 'c', 'd', 'e']) AS id, unnest([p_size % 7, p_partkey % 7, (p_partkey + p_size) % 7, 5, p_size % 3]) / 10.0::DOUBLE AS score FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, id) AS n FROM s)
SELECT p_partkey, max(id) FILTER (WHERE n = 1) AS main, coalesce(string_agg(id, ',' ORDER BY n) FILTER (WHERE n BETWEEN 2 AND 4 AND score >= 0.5), '') AS others FROM r GROUP BY p_partkey""")
def rank_disciplines(spark, sf):
    k, z = F.col("p_partkey"), F.col("p_size")
    scores = [z % 7, k % 7, (k + z) % 7, F.lit(5), z % 3]
    cells = F.array(*[F.struct((s / F.lit(10.0)).alias("score"), F.lit(i).alias("id")) for s, i in zip(scores, "abcde")])
    return _parts(spark, sf).select("p_partkey", classify.rank_disciplines(cells).alias("d")).select(
        "p_partkey", F.col("d.primary").alias("main"), F.array_join("d.secondary", ",").alias("others"))


# --- term ---------------------------------------------------------------------------------------------------------------
_W = "[^\\p{L}\\p{N}_]"


def _spot(word: str, text: str = "text") -> str:
    return (f"CASE WHEN regexp_matches({text}, '(?i)(^|{_W}){word}({_W}|$)') THEN length(regexp_extract({text}, '(?is)^((?:.*?{_W})??){word}(?:{_W}|$)', 1)) END")


_EARLIEST = f"""
pos AS (SELECT doc_id, text, {_spot('und')} AS a, {_spot('the')} AS b, {_spot('que')} AS c, {_spot('de')} AS d FROM documents),
first AS (SELECT *, least(coalesce(a, 1000000), coalesce(b, 1000000), coalesce(c, 1000000), coalesce(d, 1000000)) AS f FROM pos),
term AS (SELECT *, CASE WHEN f = 1000000 THEN '' WHEN a = f THEN 'summer' WHEN b = f THEN 'fall' WHEN c = f THEN 'winter' ELSE 'spring' END AS term FROM first)
"""


@query("earliest_match", f"WITH {_EARLIEST} SELECT doc_id, term FROM term")
def earliest_match(spark, sf):
    d = t.documents(spark, sf)
    return d.select("doc_id", F.coalesce(classify.earliest_match(F.col("text"), TERM_RULES), F.lit("")).alias("term"))


@query("enrich_term", f"""
WITH {_EARLIEST} SELECT t.doc_id, CASE WHEN d.lang = 'es' THEN 'summer' WHEN d.lang = 'fr' THEN 'off_cycle' WHEN t.term = '' THEN 'unknown' ELSE t.term END AS academic_term
FROM term t JOIN documents d USING (doc_id)""")
def enrich_term(spark, sf):
    """Structured terms for Spanish rows, a bare title word for French ones, the text for all others."""
    d = t.documents(spark, sf).select(
        "doc_id", "text", F.when(F.col("lang") == "fr", F.lit("A Bolt")).otherwise(F.lit("Role")).alias("title"),
        F.when(F.col("lang") == "es", F.array(F.lit("x"), F.lit("Und 2026"))).alias("terms"))
    return classify.enrich_term(d, "title", description="text", structured="terms", rules=RULES).select("doc_id", "academic_term")


@query("first_rule_wins", f"""
SELECT doc_id, CASE WHEN {phrase_sql('lower(text)', 'und')} THEN 'summer' WHEN {phrase_sql('lower(text)', 'the')} THEN 'fall' WHEN {phrase_sql('lower(text)', 'que')} THEN 'winter'
  WHEN {phrase_sql('lower(text)', 'de')} THEN 'spring' ELSE '' END AS label FROM documents""")
def first_rule_wins(spark, sf):
    return t.documents(spark, sf).select("doc_id", F.coalesce(terms.first_rule(F.col("text"), TERM_RULES), F.lit("")).alias("label"))


# --- skills, phrases, benefits -----------------------------------------------------------------------------------------------
def _skill_case() -> str:
    return ", ".join("CASE WHEN " + " OR ".join(phrase_sql("c", p.lower()) for p in [n, *al]) + f" THEN '{n}' END"
                     for n, al in sorted(SKILL_RULES))


@query("enrich_skills", f"WITH x AS (SELECT doc_id, {fold_sql('text')} AS c FROM documents) SELECT doc_id, concat_ws(',', {_skill_case()}) AS skills FROM x")
def enrich_skills(spark, sf):
    return classify.enrich_skills(t.documents(spark, sf), "text", RULES).select("doc_id", F.array_join("skills", ",").alias("skills"))


def _first(phrases: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN contains(c, '{p}') THEN '{p}'" for p in phrases) + " END" if phrases else "NULL"


def _claims_sql() -> str:
    parts = []
    for name, pos, neg in CLAIM_RULES:
        parts.append(f"SELECT doc_id, c, '{name}' AS label, {_first(neg)} AS no, {_first(pos)} AS yes FROM x")
    return f"x AS (SELECT doc_id, {fold_sql('text')} AS c FROM documents), cl AS ({' UNION ALL '.join(parts)})"


@query("match_phrases", f"""
WITH {_claims_sql()} SELECT doc_id, label, 'positive' AS polarity, yes AS phrase FROM cl WHERE yes IS NOT NULL UNION ALL SELECT doc_id, label, 'negative', no FROM cl WHERE no IS NOT NULL""")
def match_phrases(spark, sf):
    return terms.phrase_hits(t.documents(spark, sf), "doc_id", "text", CLAIM_RULES)


@query("enrich_benefits", f"""
WITH {_claims_sql()}, p AS (SELECT *, coalesce(no, yes) AS hit, strpos(c, coalesce(no, yes)) AS s FROM cl)
SELECT doc_id, label, CASE WHEN no IS NOT NULL THEN 'not_available' WHEN yes IS NOT NULL THEN 'confirmed' ELSE 'unknown' END AS status,
  coalesce(label || CASE WHEN no IS NOT NULL THEN ':negative' WHEN yes IS NOT NULL THEN ':positive' END, '') AS rule,
  coalesce(left(trim(substr(c, greatest(1, s - 40), s + length(hit) + 120 - greatest(1, s - 40))), 500), '') AS excerpt FROM p""")
def enrich_benefits(spark, sf):
    df = terms.enrich_benefits(t.documents(spark, sf), "text", CLAIM_RULES)
    cells = F.array(*[F.struct(F.lit(n).alias("label"), F.col(f"mobility.{n}.status").alias("status"),
                               F.coalesce(f"mobility.{n}.extraction_rule", F.lit("")).alias("rule"),
                               F.coalesce(f"mobility.{n}.evidence_excerpt", F.lit("")).alias("excerpt")) for n, _, _ in CLAIM_RULES])
    return df.select("doc_id", F.inline(cells))


# --- places -------------------------------------------------------------------------------------------------------------------
_PLACES = ["Austin, TX", "San Francisco, CA", "Toronto, ON, Canada", "Paris, TX", "Paris, France", "Remote - Germany", "Berlin, Germany", "Hybrid - New York, NY"]


def _addresses(spark: SparkSession, sf: str) -> DataFrame:
    """customer with two place strings: one of the fixed forms by key, and nation with region."""
    n = t.table(spark, sf, "nation").join(t.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = spread(t.table(spark, sf, "customer")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    form = F.get(F.array(*[F.lit(p) for p in _PLACES]), (F.col("c_custkey") % 8).cast("int"))
    return c.select("c_custkey", "c_mktsegment", F.array(form, F.concat_ws(",  ", "n_name", "r_name")).alias("locations_raw"))


_PLACE_SQL = """
form AS (SELECT * FROM (VALUES (0, 'Austin', 'Texas', 'United States', 'US', 'North America'), (1, 'San Francisco', 'California', 'United States', 'US', 'North America'),
  (2, 'Toronto', 'Ontario', 'Canada', 'CA', 'North America'), (3, 'Paris', 'Texas', 'United States', 'US', 'North America'), (4, 'Paris', 'France', 'France', 'FR', 'Europe'),
  (5, '', '', '', '', ''), (6, 'Berlin', 'Germany', 'Germany', 'DE', 'Europe'), (7, 'Hybrid - New York', 'New York', 'United States', 'US', 'North America')) AS f(k, city, region, country, code, continent)),
cust AS (SELECT c_custkey, c_mktsegment, n_name, r_name, c_custkey % 8 AS k FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)
"""


@query("enrich_locations", f"""
WITH {_PLACE_SQL} SELECT c_custkey, 0::INT AS pos, city, region, country, code, continent FROM cust JOIN form USING (k)
UNION ALL SELECT c_custkey, 1, n_name, r_name, '', '', '' FROM cust""")
def enrich_locations(spark, sf):
    df = places.enrich_locations(_addresses(spark, sf))
    rows = df.select("c_custkey", F.posexplode("locations").alias("pos", "p"))
    return rows.select("c_custkey", "pos", *[F.coalesce(F.col(f"p.{c}"), F.lit("")).alias(n) for c, n in
                                             (("city", "city"), ("region", "region"), ("country", "country"), ("country_code", "code"), ("continent", "continent"))])


@query("lookup_country", f"""
SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'FR' WHEN 1 THEN 'US' WHEN 2 THEN 'JP' WHEN 3 THEN 'GB' ELSE '' END AS country_code,
  CASE n_regionkey WHEN 0 THEN 'Europe' WHEN 1 THEN 'North America' WHEN 2 THEN 'Asia' WHEN 3 THEN 'Europe' ELSE '' END AS continent FROM nation""")
def lookup_country(spark, sf):
    n = t.table(spark, sf, "nation")
    spelled = F.get(F.array(F.lit(" france"), F.lit("U.S."), F.lit("JPN"), F.lit("Great Britain")), F.col("n_regionkey"))
    df = places.lookup_country(n.withColumn("spelled", F.coalesce(spelled, F.col("n_name"))), "spelled")
    return df.select("n_nationkey", F.coalesce("country_code", F.lit("")).alias("country_code"), F.coalesce("continent", F.lit("")).alias("continent"))


_WORK = f"""
WITH {_PLACE_SQL}, w AS (SELECT c_custkey, k, c_mktsegment AS seg, k = 7 OR c_mktsegment = 'BUILDING' AS hybrid, k = 5 OR c_mktsegment IN ('MACHINERY', 'FURNITURE') AS remote FROM cust),
x AS (SELECT *, CASE WHEN hybrid OR remote THEN 'hybrid' ELSE 'onsite' END AS workplace FROM w)
"""


def _described(spark: SparkSession, sf: str) -> DataFrame:
    """The segment decides what the description says about where to work."""
    text = {"BUILDING": "Hybrid role, EMEA hours", "MACHINERY": "Work from home in the UK", "FURNITURE": "Anywhere in the world", "HOUSEHOLD": "Come in", "AUTOMOBILE": "PST timezone"}
    return _addresses(spark, sf).withColumn("description", t.case(F.col("c_mktsegment"), text))


@query("enrich_workplace", _WORK + "SELECT c_custkey, workplace AS workplace_type FROM x")
def enrich_workplace(spark, sf):
    return places.enrich_workplace(_described(spark, sf), description="description").select("c_custkey", "workplace_type")


@query("enrich_remote_scope", _WORK + """, y AS (SELECT *, concat_ws(',', CASE WHEN workplace = 'hybrid' THEN CASE k WHEN 2 THEN 'CA' WHEN 4 THEN 'FR' WHEN 5 THEN 'DE' WHEN 6 THEN 'DE' END END,
    CASE WHEN workplace = 'hybrid' AND seg = 'MACHINERY' THEN 'GB' END) AS codes FROM x)
SELECT c_custkey, CASE WHEN workplace = 'onsite' THEN 'unknown' WHEN seg = 'FURNITURE' THEN 'worldwide' WHEN codes <> '' THEN 'country_limited'
    WHEN seg = 'BUILDING' OR europe THEN 'region_limited' WHEN seg = 'AUTOMOBILE' THEN 'timezone_limited' ELSE 'unknown' END AS scope,
  CASE WHEN seg = 'FURNITURE' OR workplace = 'onsite' THEN '' ELSE codes END AS countries,
  CASE WHEN workplace = 'onsite' OR seg = 'FURNITURE' OR codes <> '' THEN '' ELSE concat_ws(',', CASE WHEN europe THEN 'EU' END, CASE WHEN seg = 'BUILDING' THEN 'EMEA' END) END AS regions
FROM y JOIN (SELECT c_custkey, r_name = 'EUROPE' AS europe FROM cust) USING (c_custkey)""")
def enrich_remote_scope(spark, sf):
    df = places.enrich_remote_scope(_described(spark, sf), description="description")
    return df.select("c_custkey", F.col("remote_scope").alias("scope"), F.array_join("remote_allowed_countries", ",").alias("countries"),
                     F.array_join("remote_allowed_regions", ",").alias("regions"))


# --- pay ----------------------------------------------------------------------------------------------------------------------------
_PAY_ROWS = """
pay AS (SELECT o_orderkey, o_orderpriority AS p, (floor(o_totalprice)::BIGINT % 90000) + 10000 AS lo, (o_custkey % 50) + 20 AS k FROM orders),
amt AS (SELECT o_orderkey, CASE p WHEN '1-URGENT' THEN lo::DOUBLE WHEN '2-HIGH' THEN k * 1000.0::DOUBLE WHEN '3-MEDIUM' THEN k::DOUBLE WHEN '4-NOT SPECIFIED' THEN left(lo::VARCHAR, 3)::DOUBLE END AS lo,
    CASE p WHEN '2-HIGH' THEN (k + 5) * 1000.0::DOUBLE END AS hi, CASE p WHEN '1-URGENT' THEN 'USD' WHEN '2-HIGH' THEN 'EUR' WHEN '3-MEDIUM' THEN 'CAD' WHEN '4-NOT SPECIFIED' THEN 'GBP' END AS cur,
    CASE p WHEN '1-URGENT' THEN 'year' WHEN '2-HIGH' THEN 'year' WHEN '3-MEDIUM' THEN 'hour' WHEN '4-NOT SPECIFIED' THEN 'month' END AS per FROM pay)
"""


def _ads(spark: SparkSession, sf: str) -> DataFrame:
    o = spread(t.table(spark, sf, "orders"))
    lo, k = (F.floor("o_totalprice").cast("long") % 90000) + 10000, (F.col("o_custkey") % 50) + 20
    p = F.col("o_orderpriority")
    text = (F.when(p == "1-URGENT", F.concat(F.lit("Join us. Salary: $"), F.format_number(lo, 0), F.lit(" per year. Total care")))
            .when(p == "2-HIGH", F.concat(F.lit("Compensation - €"), k.cast("string"), F.lit("k to "), (k + 5).cast("string"), F.lit("k annually; more")))
            .when(p == "3-MEDIUM", F.concat(F.lit("We pay C$"), k.cast("string"), F.lit(" /hr in Toronto")))
            .otherwise(F.lit("No pay named here.")))
    return o.select("o_orderkey", text.alias("description"), F.when(p == "4-NOT SPECIFIED", F.concat(F.lit(" GBP  "), lo.cast("string"), F.lit(" monthly "))).alias("pay_range"))


# digits in a row count as an amount only three at a time unless commas group them: that is the amount pattern
@query("enrich_pay", f"WITH {_PAY_ROWS} SELECT o_orderkey, coalesce(lo, -1) AS low, coalesce(hi, -1) AS high, coalesce(cur, '') AS currency, coalesce(per, '') AS period FROM amt")
def enrich_pay(spark, sf):
    df = terms.enrich_pay(_ads(spark, sf), "description", ["pay_range"])
    c = F.col("compensation")
    return df.select("o_orderkey", F.coalesce(c["min_amount"], F.lit(-1.0)).alias("low"), F.coalesce(c["max_amount"], F.lit(-1.0)).alias("high"),
                     F.coalesce(c["currency"], F.lit("")).alias("currency"), F.coalesce(c["period"], F.lit("")).alias("period"))


@query("pay_bands", f"""
WITH {_PAY_ROWS} SELECT cur AS currency, per AS period, (floor(lo / 25000) * 25000)::DOUBLE AS band, count(*) AS postings, min(lo) AS lowest, max(coalesce(hi, lo)) AS highest
FROM amt WHERE lo IS NOT NULL GROUP BY ALL""")
def pay_bands(spark, sf):
    return terms.pay_bands(terms.enrich_pay(_ads(spark, sf), "description", ["pay_range"]))


# --- eligibility ----------------------------------------------------------------------------------------------------------------------
_RULE_TEXT = {
    "1-URGENT": "You must be located in Canada, UK and Germany. Fluent in French and keen.",
    "2-HIGH": "U.S. citizenship required; active secret clearance. ITAR applies.",
    "3-MEDIUM": "Not open to candidates in India/France. Native German speaker",
    "4-NOT SPECIFIED": "We are unable to sponsor. You must reside in Australia.",
}


def _rules_of(spark: SparkSession, sf: str) -> DataFrame:
    o = spread(t.table(spark, sf, "orders"))
    return o.select("o_orderkey", "o_orderpriority", F.coalesce(t.case(F.col("o_orderpriority"), _RULE_TEXT), F.lit("")).alias("description"))


# "not open to candidates in X" also contains "candidates in X": by the rules X is named by both lists, and exclusion wins
@query("enrich_eligibility", """
SELECT o_orderkey, CASE o_orderpriority WHEN '2-HIGH' THEN 'us_citizen_required' WHEN '4-NOT SPECIFIED' THEN 'no_sponsorship' ELSE '' END AS auth,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'CA,DE,GB' WHEN '3-MEDIUM' THEN 'FR,IN' ELSE '' END AS allowed, CASE o_orderpriority WHEN '3-MEDIUM' THEN 'FR,IN' ELSE '' END AS excluded,
  CASE o_orderpriority WHEN '2-HIGH' THEN 'US' ELSE '' END AS citizens, CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN 'AU' ELSE '' END AS residents,
  CASE o_orderpriority WHEN '2-HIGH' THEN 'active secret' ELSE '' END AS clearance, o_orderpriority = '2-HIGH' AS export_control,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'French' WHEN '3-MEDIUM' THEN 'German Speaker' ELSE '' END AS languages FROM orders""")
def enrich_eligibility(spark, sf):
    e = F.col("eligibility")

    def joined(name: str) -> Column:
        return F.array_join(e[name], ",")

    return terms.enrich_eligibility(_rules_of(spark, sf), "description").select(
        "o_orderkey", F.coalesce(e["work_authorization"], F.lit("")).alias("auth"), joined("explicit_allowed_countries").alias("allowed"),
        joined("explicit_excluded_countries").alias("excluded"), joined("citizenship_requirements").alias("citizens"),
        joined("residency_requirements").alias("residents"), F.coalesce(e["security_clearance"], F.lit("")).alias("clearance"),
        F.coalesce(e["export_control_restrictions"], F.lit(False)).alias("export_control"), joined("language_requirements").alias("languages"))


@query("match_origin", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'explicit_match' WHEN '2-HIGH' THEN 'explicitly_ineligible' WHEN '3-MEDIUM' THEN 'explicitly_ineligible' WHEN '4-NOT SPECIFIED' THEN 'potential_match' ELSE 'unknown' END AS ca,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'explicitly_ineligible' WHEN '2-HIGH' THEN 'explicit_match' WHEN '3-MEDIUM' THEN 'explicitly_ineligible' ELSE 'unknown' END AS us,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'explicitly_ineligible' WHEN '2-HIGH' THEN 'explicitly_ineligible' WHEN '3-MEDIUM' THEN 'explicitly_ineligible'
    WHEN '4-NOT SPECIFIED' THEN 'potential_match' ELSE 'unknown' END AS in_ FROM orders""")
def match_origin(spark, sf):
    df = terms.enrich_eligibility(_rules_of(spark, sf), "description")
    for country, name in (("ca", "ca"), ("US", "us"), ("IN", "in_")):
        df = terms.match_origin(df, country).withColumnRenamed("origin_match", name)
    return df.select("o_orderkey", "ca", "us", "in_")


# --- whole rows ----------------------------------------------------------------------------------------------------------------------------
@query("reclassify", f"""
WITH {_level_sql()}, nh AS (SELECT * REPLACE ('' AS hint) FROM best) SELECT count(*) AS rows,
  count(*) FILTER (WHERE CASE WHEN contains(ti, 'plate') OR top = 0 THEN 'unknown' WHEN internship = top THEN 'internship' WHEN co_op = top THEN 'co_op' ELSE 'new_grad' END <> 'internship'
    OR abs(CASE WHEN contains(ti, 'plate') THEN 0 ELSE top END - 0.82) > 1e-9) AS changed FROM nh""")
def reclassify(spark, sf):
    p = _parts(spark, sf).select(
        F.col("p_name").alias("title"), F.lower("p_type").alias("summary"), F.lit("internship").alias("career_level"),
        (F.lit(0.72) + F.lit(0.1)).alias("career_level_confidence"), F.lit("full_time").alias("employment_type"))
    return classify.reclassify_summary(p, RULES)


@query("normalize", f"""
WITH x AS (SELECT doc_id, coalesce({plain_sql('text')}, '') AS s FROM documents)
SELECT sha256('greenhouse:acme:' || doc_id) AS job_id, 'Role ' || doc_id AS title, 'c-acme' AS company_id,
  CASE WHEN length(s) <= 2000 THEN s ELSE regexp_replace(regexp_replace(left(s, 1999), '\\s+$', ''), ' [^ ]*$', '') || '…' END AS summary,
  'unknown' AS career_level, 'open' AS lifecycle, 'onsite' AS workplace_type FROM x""")
def run_normalize(spark, sf):
    raw = boards.ingest_greenhouse(greenhouse_payloads(spark, sf))
    return normalize(raw).select("job_id", "title", "company_id", F.coalesce("summary", F.lit("")).alias("summary"), "career_level", "lifecycle", "workplace_type")


@query("normalize_all_sources")
def normalize_all_sources(spark, sf):
    """Every landed format through the whole pipeline; counts per adapter. Checked on fixtures in tests."""
    return normalize(boards.union_sources(all_payloads(spark, sf))).groupBy(F.col("provenance.adapter").alias("adapter"), "career_level", "workplace_type").agg(
        F.count("*").alias("postings"), F.countDistinct("job_id").alias("ids"))


# --- duplicates ---------------------------------------------------------------------------------------------------------------------------------
def _doc_posts(spark: SparkSession, sf: str) -> DataFrame:
    """documents as postings: source is the employer, the text is the title."""
    d = t.documents(spark, sf)
    at = F.timestamp_seconds(F.lit(1704067200) + (F.col("doc_id") * 7919) % 86400)
    return d.select(
        F.sha2(F.col("doc_id").cast("string"), 256).alias("job_id"), F.col("source").alias("company_name"), F.col("text").alias("title"), "lang",
        F.array(F.col("lang")).alias("places"), F.array_sort(F.array("lang", "source")).alias("skills"), at.alias("first_seen_at"),
        F.timestamp_micros(F.unix_micros(at) + 3_600_000_000).alias("last_seen_at"))


_DOCS = f"""
d AS (SELECT doc_id, sha256(doc_id::VARCHAR) AS job_id, source, lang, text, {fold_sql('text')} AS canon, TIMESTAMP '2024-01-01' + to_seconds((doc_id * 7919) % 86400) AS f FROM documents)
"""
_F = "strftime({0}, '%Y-%m-%d %H:%M:%S')"


def _times(df: DataFrame, *cols: str | Column) -> DataFrame:
    return df.select(*cols, *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("first_seen_at", "last_seen_at")])


@query("group_by_id", f"""WITH {_DOCS} SELECT lang AS job_id, count(*) AS copies, {_F.format('min(f)')} AS first_seen_at, {_F.format('max(f) + INTERVAL 1 HOUR')} AS last_seen_at FROM d GROUP BY lang""")
def group_by_id(spark, sf):
    return _times(dedupe.group_by_id(_doc_posts(spark, sf).withColumn("job_id", F.col("lang"))), "job_id", "copies")


@query("fingerprint", f"WITH {_DOCS} SELECT job_id, sha256(source || '|' || canon || '|' || lang) AS fingerprint FROM d")
def fingerprint(spark, sf):
    return dedupe.with_fingerprint(_doc_posts(spark, sf), "company_name", "title", "places").select("job_id", "fingerprint")


@query("content_hash", f"WITH {_DOCS} SELECT job_id, sha256(to_json({{'company_name': source, 'language': lang, 'title': canon}})::VARCHAR) AS content_hash FROM d")
def content_hash(spark, sf):
    return dedupe.with_content_hash(_doc_posts(spark, sf), {"title": "title", "language": "lang", "company_name": "company_name"}).select("job_id", "content_hash")


@query("pick_canonical", f"WITH {_DOCS} SELECT lang, job_id, source FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY f, job_id) AS n FROM d) WHERE n = 1")
def pick_canonical(spark, sf):
    return dedupe.pick_canonical(_doc_posts(spark, sf), ["lang"]).select("lang", "job_id", F.col("company_name").alias("source"))


_MERGED = f"""
g AS (SELECT canon, count(*) AS copies, {_F.format('min(f)')} AS first_seen_at, {_F.format('max(f) + INTERVAL 1 HOUR')} AS last_seen_at FROM d GROUP BY canon),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY canon ORDER BY f, job_id) AS n FROM d) WHERE n = 1),
k AS (SELECT canon, string_agg(s, ',' ORDER BY s) AS skills FROM (SELECT canon, lang AS s FROM d UNION SELECT canon, source FROM d) GROUP BY canon)
"""


@query("merge_group", f"WITH {_DOCS}, {_MERGED} SELECT w.job_id, skills, copies AS merged_rows, first_seen_at, last_seen_at FROM w JOIN g USING (canon) JOIN k USING (canon)")
def merge_group(spark, sf):
    df = _doc_posts(spark, sf).withColumn("canon", canonical_text(F.col("title")))
    return _times(dedupe.merge_group(df, ["canon"]), "job_id", F.array_join("skills", ",").alias("skills"), "merged_rows")


@query("dedupe", f"WITH {_DOCS}, {_MERGED} SELECT w.job_id, skills, first_seen_at, last_seen_at FROM w JOIN g USING (canon) JOIN k USING (canon)")
def run_dedupe(spark, sf):
    df = dedupe.dedupe(_doc_posts(spark, sf), places="places", hash_fields={"title": "title"})
    return _times(df, "job_id", F.array_join("skills", ",").alias("skills"))


def _full_posts(spark: SparkSession, sf: str) -> DataFrame:
    """documents as whole postings: places, level, discipline and skills differ among equal titles."""
    n = F.col("doc_id")
    return t.documents(spark, sf).select(
        F.sha2(n.cast("string"), 256).alias("job_id"), F.col("source").alias("company_name"), F.col("text").alias("title"),
        F.array(F.struct(F.concat(F.lit(" CAFÉ &amp; "), "lang").alias("raw"), F.col("lang").alias("city"), F.lit("").alias("country_code")),
                F.struct(F.when(n % 2 == 0, "Ｂerlin").otherwise("berlin").alias("raw"), F.lit("").alias("city"), F.lit("").alias("country_code")))
        .alias("locations"),
        F.when(n % 3 == 0, "internship").otherwise("unknown").alias("career_level"), F.lit("full_time").alias("employment_type"),
        F.struct(F.when(n % 5 == 0, "data").otherwise("software").alias("primary")).alias("disciplines"),
        F.array_sort(F.array("lang", "source")).alias("skills"), F.concat(F.lit("s"), (n % 2).cast("string")).alias("summary"),
        F.lit("https://x.example/apply").alias("apply_url"), F.lit("https://x.example/job").alias("job_url"), n.cast("string").alias("source_job_id"),
        F.timestamp_seconds(F.lit(1704067200) + (n * 7919) % 86400).alias("first_seen_at"),
        F.timestamp_seconds(F.lit(1704070800) + (n * 7919) % 86400).alias("last_seen_at"))


@query("dedupe_postings", f"""
WITH {_DOCS}, g AS (SELECT source, canon, lang, count(*) AS copies, {_F.format('min(f)')} AS first_seen_at, {_F.format('max(f) + INTERVAL 1 HOUR')} AS last_seen_at FROM d GROUP BY ALL),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, canon, lang ORDER BY f, job_id) AS n FROM d) WHERE n = 1)
SELECT w.job_id, w.lang, g.first_seen_at, g.last_seen_at FROM w JOIN g USING (source, canon, lang)""")
def dedupe_postings(spark, sf):
    """All default keys: postings of one title in two places stay two; spelling of a place does not matter."""
    return _times(dedupe.dedupe(_full_posts(spark, sf)), "job_id", F.col("locations")[0]["city"].alias("lang"))


@query("posting_hash", f"""
WITH {_DOCS} SELECT job_id, sha256(to_json({{'apply_url': 'https://x.example/apply', 'career_level': CASE WHEN doc_id % 3 = 0 THEN 'internship' ELSE 'unknown' END, 'company_name': source,
  'employment_type': 'full_time', 'job_url': 'https://x.example/job', 'locations': 'café & ' || lang || '|berlin', 'primary_discipline': CASE WHEN doc_id % 5 = 0 THEN 'data' ELSE 'software' END,
  'skills': least(lang, source) || ',' || greatest(lang, source), 'source_job_id': doc_id::VARCHAR, 'summary': 's' || (doc_id % 2), 'title': canon}})::VARCHAR) AS content_hash FROM d""")
def posting_hash(spark, sf):
    """The content hash of eleven fields."""
    return dedupe.with_content_hash(_full_posts(spark, sf)).select("job_id", "content_hash")


@query("find_duplicate_postings", f"""
WITH {_DOCS}, g AS (SELECT source, canon, lang, min(job_id) AS canonical_job_id, count(*) AS copies FROM d GROUP BY ALL HAVING count(*) > 1)
SELECT 'fingerprint' AS stage, canonical_job_id, job_id, copies FROM d JOIN g USING (source, canon, lang)""")
def find_duplicate_postings(spark, sf):
    """Company, title and primary place."""
    return dedupe.find_duplicates(_full_posts(spark, sf))


@query("find_duplicates", f"""
WITH {_DOCS}, g AS (SELECT source, canon, min(job_id) AS canonical_job_id, count(*) AS copies FROM d GROUP BY source, canon HAVING count(*) > 1)
SELECT 'fingerprint' AS stage, canonical_job_id, job_id, copies FROM d JOIN g USING (source, canon)""")
def find_duplicates(spark, sf):
    return dedupe.find_duplicates(_doc_posts(spark, sf), place=F.lit(""))


@query("find_duplicate_texts", f"""
WITH {_DOCS}, g AS (SELECT canon, lang, min(job_id) AS canonical_job_id, count(*) AS copies FROM d GROUP BY canon, lang HAVING count(*) > 1)
SELECT 'fingerprint' AS stage, canonical_job_id, job_id, copies FROM d JOIN g USING (canon, lang)""")
def find_duplicate_texts(spark, sf):
    df = _doc_posts(spark, sf).withColumn("company_name", F.lit("one employer"))
    return dedupe.find_duplicates(df, place="lang")


@query("distinct_urls", """
SELECT regexp_replace(url, '#.*$', '') AS clean_url, min(page_id) AS page_id FROM (SELECT page_id, url FROM pages UNION ALL SELECT page_id + 1000000, url || '#copy' FROM pages) GROUP BY 1""")
def distinct_urls(spark, sf):
    p = t.table(spark, sf, "pages").select("page_id", "url")
    twice = p.unionByName(p.select((F.col("page_id") + 1000000).alias("page_id"), F.concat("url", F.lit("#copy")).alias("url")))
    return dedupe.distinct_urls(twice, "url", "page_id").select("clean_url", "page_id")
