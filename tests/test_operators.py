"""Brute-force checks of the operators whose set form differs from a loop."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from vacantic.operators import companies, contracts, dedupe, discovery, filters, health, lifecycle, search
from vacantic.operators.scale import group_rank
from vacantic.plans import publish
from vacantic.sources import crawl, seeds
from vacantic.streaming import track

T0 = dt.datetime(2025, 1, 1)
def at_now():
    return F.lit("2025-06-01 00:00:00").cast("timestamp")


# --- hot groups ------------------------------------------------------------------------------------------------
def test_group_rank_with_a_hot_key(spark):
    rnd = random.Random(3)
    rows = [("hot" if rnd.random() < 0.6 else f"k{rnd.randint(0, 20)}", rnd.randint(0, 30), i) for i in range(2000)] + [(None, 1, 9000), (None, 0, 9001)]
    df = spark.createDataFrame(rows, "k string, v int, i int").repartition(5)
    got = {(r.k, r.i): r.n for r in group_rank(df, ["k"], [F.col("v").desc(), F.col("i")], "n", parts=8).collect()}
    want = {}
    for key in {r[0] for r in rows}:
        for n, r in enumerate(sorted([x for x in rows if x[0] == key], key=lambda x: (-x[1], x[2])), 1):
            want[(key, r[2])] = n
    assert got == want
    total = group_rank(df, [], [F.col("i")], "n", parts=8).orderBy("i").collect()
    assert [r.n for r in total] == list(range(1, len(rows) + 1))


def _greedy(sizes, max_rows, max_bytes):
    out, rows, used, chunk = [], 0, 0, 0
    for s in sizes:
        if rows and (rows + 1 > max_rows or used + s + 1 > max_bytes):
            chunk, rows, used = chunk + 1, 0, 0
        rows, used = rows + 1, (used + s + 1 if rows else s + 2)
        out.append(chunk)
    return out


@pytest.mark.parametrize("segment", [None, 25])
def test_chunks_equal_a_greedy_walk(spark, segment):
    rnd = random.Random(5)
    rows = [("big" if i % 4 else "small", i, rnd.choice([10, 50, 200, 400, 1200])) for i in range(800)]
    df = spark.createDataFrame(rows, "b string, i int, s int")
    out = publish.chunk_by_budget(df, ["b"], [F.col("i")], F.col("s"), 20, 1000, segment=segment, parts=8)
    for key in ("big", "small"):
        got = [r.chunk for r in out.where(F.col("b") == key).orderBy("i").collect()]
        assert got == _greedy([r[2] for r in rows if r[0] == key], 20, 1000)


# --- lifecycle -------------------------------------------------------------------------------------------------------
def _history(seed=7):
    rnd = random.Random(seed)
    polls, seen = [], []
    for s in range(6):
        for d in range(30):
            at = T0 + dt.timedelta(days=d)
            outcome = rnd.choice(["ok"] * 7 + ["error", "not_modified", "unsupported"])
            polls.append((f"s{s}", at, outcome))
            if outcome == "ok":
                seen += [(f"s{s}", f"p{p}", at) for p in range(5) if rnd.random() < 0.35]
    return polls, seen


def _simulate(polls, seen):
    listed = {}
    for s, p, at in seen:
        listed.setdefault((s, at), set()).add(p)
    state, events = {}, []
    for s, at, outcome in sorted(polls, key=lambda x: (x[1], x[0])):
        if outcome != "ok":
            continue
        here = listed.get((s, at), set())
        for (src, p), r in state.items():
            if src != s or p in here:
                continue
            r["misses"] += 1
            if r["misses"] == 2:
                r["state"] = "suspected_closed"
                events.append((s, p, "SUSPECTED_CLOSED", at))
            if r["misses"] == 4:
                r["state"], r["closed"] = "closed", at
                events.append((s, p, "CLOSED", at))
        for p in here:
            r = state.setdefault((s, p), {"misses": 0, "state": "open", "closed": None, "reopened": None, "times": 0})
            if r["state"] != "open":
                r.update(state="open", closed=None, reopened=at, times=r["times"] + 1)
                events.append((s, p, "REOPENED", at))
            r["misses"] = 0
    return state, events


def _frames(spark, polls, seen):
    return (spark.createDataFrame(seen, "source_id string, posting_id string, poll_ts timestamp"),
            spark.createDataFrame(polls, "source_id string, poll_ts timestamp, outcome string"))


def test_lifecycle_equals_a_poll_by_poll_walk(spark):
    polls, seen = _history()
    state, events = _simulate(polls, seen)
    s, p = _frames(spark, polls, seen)
    got = {(r.source_id, r.posting_id): (r.miss_count, r.state, r.closed_at, r.reopened_at, r.times_reopened)
           for r in lifecycle.lifecycle_table(s, p).collect()}
    assert got == {k: (r["misses"], r["state"], r["closed"], r["reopened"], r["times"]) for k, r in state.items()}
    moves = [tuple(r) for r in lifecycle.transitions(s, p).collect()]
    assert sorted(moves) == sorted(events)


def test_stream_state_equals_batch(spark):
    polls, seen = _history(11)
    state, _ = _simulate(polls, seen)
    rows = [(s, at, o, None, None) for s, at, o in polls] + [(s, at, "ok", p, "h") for s, p, at in seen]
    landing = spark.createDataFrame(rows, track.LANDING)
    now = track.empty_state(spark)
    for low in (0, 10, 20):
        cut = (F.col("poll_ts") >= T0 + dt.timedelta(days=low)) & (F.col("poll_ts") < T0 + dt.timedelta(days=low + 10))
        now = {k: spark.createDataFrame(v.collect(), v.schema) for k, v in track.apply_batch(now, landing.where(cut)).items()}
    got = {(r.source_id, r.posting_id): (r.miss_count, r.state, r.reopened_at, r.times_reopened) for r in track.current_lifecycle(now).collect()}
    assert got == {k: (r["misses"], r["state"], r["reopened"], r["times"]) for k, r in state.items()}


def test_single_runs(spark):
    base = spark.createDataFrame([("s", "gone", 1, "open"), ("s", "dead", 3, "suspected_closed"), ("s", "back", 5, "closed"), ("x", "idle", 1, "open")],
                                 "source_id string, posting_id string, miss_count long, state string")
    null = F.lit(None).cast("timestamp")
    base = base.withColumns({"closed_at": F.when(F.col("state") == "closed", at_now()), "reopened_at": null, "last_seen_at": null})
    seen = spark.createDataFrame([("s", "back")], "source_id string, posting_id string")
    out = {r.posting_id: r for r in lifecycle.advance_lifecycle(base, seen, spark.createDataFrame([("s",)], "source_id string"), at_now()).collect()}
    assert (out["gone"].state, out["gone"].miss_count) == ("suspected_closed", 2)
    assert (out["dead"].state, out["dead"].closed_at is not None) == ("closed", True)
    assert (out["back"].state, out["back"].closed_at, out["back"].reopened_at is not None, out["back"].miss_count) == ("open", None, True, 0)
    assert (out["idle"].state, out["idle"].miss_count) == ("open", 1)


# --- health ------------------------------------------------------------------------------------------------------------
def test_source_health_machine(spark):
    seqs = {"ok": "ok ok", "three": "ok error error error", "twelve": "ok " + "error " * 12, "healed": "error error error error ok", "never": "error error",
            "unsup": "ok unsupported", "unsup_then_error": "ok unsupported error", "nm": "error error error not_modified"}
    rows = [(s, "a", T0 + dt.timedelta(minutes=i), i, o, "boom") for s, q in seqs.items() for i, o in enumerate(q.split())]
    df = spark.createDataFrame(rows, "source_id string, adapter string, poll_ts timestamp, poll_id int, outcome string, message string")
    got = {r.source_id: (r.consecutive_failures, r.health_status, r.enabled) for r in health.source_health(df).collect()}
    assert got == {"ok": (0, "healthy", True), "three": (3, "degraded", True), "twelve": (12, "disabled", False), "healed": (0, "healthy", True),
                   "never": (2, "healthy", True), "unsup": (0, "unsupported", True), "unsup_then_error": (1, "unsupported", True), "nm": (0, "healthy", True)}


def test_regressions(spark):
    rows = [("a", "bad", T0, i, "error" if i < 18 else "ok", f"e{i}") for i in range(20)] + [("b", "few", T0, i, "error", "x") for i in range(5)]
    df = spark.createDataFrame(rows, "source_id string, adapter string, poll_ts timestamp, poll_id int, outcome string, message string")
    r = health.health_regressions(df).collect()
    assert [(x.adapter, x.failure_rate, x.severity) for x in r] == [("bad", 0.9, "critical")]
    a = {x.adapter: x for x in health.adapter_health(df).collect()}
    assert a["bad"].sample_errors == ["e13", "e14", "e15", "e16", "e17"] and a["bad"].success_rate == 0.1
    src = spark.createDataFrame([("1", "bad", "healthy"), ("2", "few", "healthy")], "source_id string, adapter string, health_status string")
    assert {x.source_id: x.health_status for x in health.apply_adapter_health(src, health.health_regressions(df)).collect()} == {"1": "degraded", "2": "healthy"}


# --- filters and search ------------------------------------------------------------------------------------------------
def test_public_filter(spark):
    base = dict(title="Software Engineering Intern", career_level="internship", career_level_confidence=0.9, lifecycle="open", apply_url="https://a", job_url="https://b",
                summary="Build it", primary="software")
    cases = [(True, {}), (False, {"career_level": "unknown"}), (False, {"lifecycle": "closed"}), (False, {"career_level_confidence": 0.2}),
             (False, {"summary": "We are no longer accepting applications."}), (False, {"apply_url": ""}), (False, {"title": "Team Member - Guest Experience", "primary": "retail"}),
             (True, {"primary": "other"}), (True, {"title": "Quantitative Trading Intern", "primary": "other"}), (False, {"title": "Technical Support Engineer I"}), (True, {"lifecycle": "reopened"})]
    rows = [dict(base, i=i, **{**base, **c}) if False else {**base, **c, "i": i} for i, (_, c) in enumerate(cases)]
    df = spark.createDataFrame(rows).withColumn("disciplines", F.struct("primary"))
    assert sorted(r.i for r in filters.publishable(df).collect()) == [i for i, (ok, _) in enumerate(cases) if ok]


def test_diverse_order(spark):
    rows = [("a1", "a", "Alpha", dt.datetime(2025, 9, 1)), ("a2", "a", "Alpha", dt.datetime(2025, 8, 1)), ("b1", "b", "Beta", dt.datetime(2025, 9, 2))]
    df = spark.createDataFrame(rows, "job_id string, company_id string, company_name string, first_seen_at timestamp") \
        .withColumn("source_posted_at", F.lit(None).cast("timestamp")).withColumn("title", F.col("job_id"))
    assert [r.job_id for r in search.sort_postings(df, "diverse").collect()] == ["b1", "a1", "a2"]
    assert [r.job_id for r in search.sort_postings(df, "company", "UNICODE").collect()] == ["a1", "a2", "b1"]


def test_diverse_order_of_repeated_and_null_ids(spark):
    at = dt.datetime(2025, 9, 1)
    rows = [("a1", "a", "Alpha", at)] * 3 + [(None, "a", "Alpha", at), (None, "b", "Beta", at), ("b1", "b", "Beta", at), (None, None, None, at)]
    df = spark.createDataFrame(rows, "job_id string, company_id string, company_name string, first_seen_at timestamp") \
        .withColumn("source_posted_at", F.lit(None).cast("timestamp")).withColumn("title", F.col("job_id"))
    got = search.diversify(df).collect()
    assert sorted(str((r.job_id, r.company_id)) for r in got) == sorted(str(r[:2]) for r in rows)
    assert sorted((str(r.company_id), r.company_rank) for r in got) == [("None", 1), ("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 1), ("b", 2)]
    assert search.sort_postings(df, "diverse").count() == 7


def test_deep_page_equals_top_k(spark, monkeypatch):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("v"))
    want = [r.v for r in search.page(df, [F.col("v")], 4, 30).collect()]
    monkeypatch.setattr(search, "DEEP_PAGE_ROWS", 10)
    assert [r.v for r in search.page(df, [F.col("v")], 4, 30).collect()] == want == list(range(90, 120))


# --- dedupe ------------------------------------------------------------------------------------------------------------
def test_dedupe_keeps_rows_without_an_id(spark):
    at = dt.datetime(2025, 9, 1)
    rows = [(None, "Acme", "One", at, at, ["b", "a"]), (None, "Acme", "Two", at, at, None), ("x", "Acme", "Three", at, at, ["c"]),
            ("y", "Acme", "One", at, at, ["c"]), (None, "Beta", "Four", at, at, []), (None, "Beta", "Four", at, at, ["d"])]
    df = spark.createDataFrame(rows, "job_id string, company_name string, title string, first_seen_at timestamp, last_seen_at timestamp, skills array<string>")
    out = dedupe.dedupe(df, places=F.array().cast("array<string>"), hash_fields={"company_name": "company_name", "title": "title"})
    assert out.columns == [c for c in df.columns if c not in ("first_seen_at", "last_seen_at", "skills")] + ["first_seen_at", "last_seen_at", "skills"]
    got = {r.title: (r.job_id, r.skills) for r in out.collect()}
    assert got == {"One": ("y", ["a", "b", "c"]), "Two": (None, []), "Three": ("x", ["c"]), "Four": (None, ["d"])} and out.count() == 4


def test_merge_and_dedupe(spark):
    rows = [("j1", "Acme", "Dev", ["Python"], 1, 5), ("j2", "ACME ", "dev", ["React", "Python"], 2, 9), ("j3", "Other", "Dev", [], 3, 3), ("j1", "Acme", "Dev", ["SQL"], 4, 4)]
    df = spark.createDataFrame([(a, b, c, d, T0 + dt.timedelta(hours=e), T0 + dt.timedelta(hours=f)) for a, b, c, d, e, f in rows],
                               "job_id string, company_name string, title string, skills array<string>, first_seen_at timestamp, last_seen_at timestamp")
    out = {r.job_id: r for r in dedupe.dedupe(df, places=F.array().cast("array<string>"), hash_fields={"company_name": "company_name", "title": "title"}).collect()}
    assert set(out) == {"j1", "j3"}
    assert out["j1"].skills == ["Python", "React", "SQL"] and out["j1"].last_seen_at == T0 + dt.timedelta(hours=9) and out["j1"].first_seen_at == T0 + dt.timedelta(hours=1)
    dup = {(r.stage, r.canonical_job_id, r.job_id) for r in dedupe.find_duplicates(df, place=F.lit("")).collect()}
    assert dup == {("job_id", "j1", "j1"), ("fingerprint", "j1", "j1"), ("fingerprint", "j1", "j2")}


def test_identity_holds_places_and_all_fields(spark):
    """One title in two places stays two postings; spelling of a place does not count; levels and skills merge by fingerprint."""
    fields = "employment_type string, apply_url string, job_url string, source_job_id string, summary string"
    rows = [("a", "Acme", "Dev", [("Berlin",)], "internship", ["x"], 1), ("b", "Acme", "Dev", [("Paris",)], "internship", ["x"], 2),
            ("c", "ACME", "dev", [("Ｂerlin",)], "unknown", ["y"], 3), ("d", "Acme", "Dev", [("Paris",), ("Café &amp; Bar",)], "internship", [], 4),
            ("e", "Acme", "Dev", [("café & bar",), ("paris",)], "internship", [], 5), ("f", "Acme", "Dev", [], "internship", [], 6)]
    df = spark.createDataFrame([(*r[:4], r[4], r[5], ("data",), *["z"] * 5, T0 + dt.timedelta(hours=r[6]), T0 + dt.timedelta(hours=r[6])) for r in rows],
                               "job_id string, company_name string, title string, locations array<struct<raw:string>>, career_level string, skills array<string>, "
                               f"disciplines struct<primary:string>, {fields}, first_seen_at timestamp, last_seen_at timestamp")
    out = {r.job_id: r.skills for r in dedupe.dedupe(df).collect()}
    assert out == {"a": ["x", "y"], "b": ["x"], "d": [], "f": []}
    dup = {(r.canonical_job_id, r.job_id) for r in dedupe.find_duplicates(df).collect()}
    assert dup == {("a", "a"), ("a", "c"), ("b", "b"), ("b", "d")}  # the primary place is the first one
    hashes = {r.job_id: r.content_hash for r in dedupe.with_content_hash(df).collect()}
    assert len(set(hashes.values())) == 6


# --- discovery ------------------------------------------------------------------------------------------------------------
def _sources(spark):
    return discovery.promotable(discovery.validate_candidates(spark.createDataFrame([], "url string")), "seed", at_now())


def test_promotion_is_idempotent_and_skips_other_urls(spark):
    jobs = spark.createDataFrame([("https://jobs.ashbyhq.com/linear/abc", "Linear", "linear.app"), ("https://jobs.ashbyhq.com/Linear/def", "Linear", "linear.app"),
                                  ("https://careers.example.com/jobs/intern", "Example", "example.com")], "apply_url string, company_name string, company_domain string")
    first = discovery.promote_from_postings(jobs, _sources(spark), at_now())
    rows = first.collect()
    assert len(rows) == 1 and (rows[0].adapter, rows[0].adapter_tenant, rows[0].poll_tier, rows[0].company_domain) == ("ashby", "linear", "hot", "linear.app")
    assert discovery.promote_from_postings(jobs, first, at_now()).count() == 0


def _jobs_and_tracked_boards(spark):
    tenant = F.concat(F.lit("T"), (F.col("id") % 4).cast("string"))
    jobs = spark.range(8).repartition(2).select(
        "id", F.concat(F.lit("https://jobs.lever.co/"), tenant).alias("apply_url"),
        F.when(F.col("id") % 4 == 3, "Zürich GmbH").otherwise(F.concat(F.lit("Team "), tenant)).alias("company_name"),
        F.when(F.col("id") % 2 == 0, "www.lever.co").alias("company_domain"))
    return jobs, discovery.promotable(discovery.boards_from_postings(jobs.where("id % 4 < 2")), "simplify", at_now())


def test_boards_of_postings_are_promoted_next_to_tracked_ones(spark):
    found = discovery.promote_from_postings(*_jobs_and_tracked_boards(spark), at_now()).collect()
    assert {r.adapter_tenant: r.company_domain for r in found} == {"t2": "team-t2.com", "t3": "zürich-gmbh.com"}


def test_a_run_polls_tracked_boards_and_those_it_found(spark):
    fed = discovery.promotion_feedback(*_jobs_and_tracked_boards(spark), at_now()).collect()
    assert {(r.adapter_tenant, r.found_in_run) for r in fed} == {("t0", False), ("t1", False), ("t2", True), ("t3", True)}


def test_validation_reasons(spark):
    rows = [("ftp://x.example/", None), ("https:///x", None), ("https://sub.indeed.com/x", None), ("http://x.example/", 0.2), ("http://x.example/", 0.4), ("https://boards.greenhouse.io/a", 0.5),
            ("https://jobs.lever.co/a", 0.5)]
    df = spark.createDataFrame([(i, u, b, i == 6) for i, (u, b) in enumerate(rows)], "i int, url string, base_confidence double, private_address boolean")
    got = {r.i: (r.reason, r.confidence) for r in discovery.validate_candidates(df).collect()}
    assert got == {0: ("invalid_scheme", 0.0), 1: ("missing_hostname", 0.0), 2: ("aggregator_denylist", 0.0), 3: ("low_confidence", 0.2),
                   4: ("below_promotion_threshold", 0.4), 5: ("accepted", 0.85), 6: ("validation_warnings", 0.85)}


def test_inspect_and_sitemaps(spark):
    pages = spark.createDataFrame([("A.com", "https://a.com/careers", "<a href='https://jobs.lever.co/acme'>"), ("a.com", "https://a.com/jobs", "x"),
                                   ("b.com", "https://b.com/jobs", '<script type="application/ld+json">[{"@type":"JobPosting"}]</script>')], "domain string, url string, html string")
    r = {x.domain: x for x in crawl.inspect_sites(pages).collect()}
    assert (r["a.com"].platform, r["a.com"].tenant, r["a.com"].confidence) == ("lever", "acme", 0.95)
    assert (r["b.com"].platform, r["b.com"].confidence, r["b.com"].has_json_ld_jobs) == ("json_ld", 0.65, True)
    body = "".join(f"<loc>https://a.com/jobs/{i}</loc><loc>https://a.com/about/{i}</loc>" for i in range(20))
    assert crawl.sitemap_urls(spark.createDataFrame([("a.com", body)], "domain string, body string")).count() == 10


def test_seed_checks(spark):
    rows = [(" Acme ", "ACME.com", "Lever", "acme"), ("Acme", "acme.com", "lever", "acme"), ("", "x.com", "lever", "x"), ("Bad", "not a domain", "pigeon", "?"), ("L", "linkedin.com", "lever", "l")]
    df = spark.createDataFrame(rows, seeds.SEED_SCHEMA)
    got = {r.problem: r.entries for r in seeds.seed_problems(df).collect()}
    assert got == {"missing_company": 1, "invalid_domain": 1, "unsupported_adapter": 1, "invalid_tenant": 1, "denied_domain": 1, "duplicate_source": 1}
    with pytest.raises(ValueError):
        seeds.require_unique_seeds(seeds.load_seeds(df))


def test_yaml_seeds(spark, tmp_path):
    p = tmp_path / "seeds.yml"
    p.write_text("# seeds\n- { company: Acme, domain: acme.com, adapter: lever, tenant: acme }\n- { company: Half, domain: h.com }\n")
    assert [r.company for r in seeds.load_seeds(seeds.read_seeds(spark, str(p))).collect()] == ["Acme"]


# --- sinks --------------------------------------------------------------------------------------------------------------------
def _public(spark, n=60):
    return spark.range(n).select(F.sha2(F.col("id").cast("string"), 256).alias("job_id"), F.lit("c").alias("company_id"), F.lit("Acme").alias("company_name"),
                                 F.concat(F.lit("Dev <"), F.col("id").cast("string"), F.lit("> & co")).alias("title"), F.lit("https://x.example/?a=1&b=2").alias("job_url"),
                                 F.lit("Sum\"mary").alias("summary"), F.lit(None).cast("timestamp").alias("source_posted_at"),
                                 F.timestamp_seconds(F.lit(1700000000) + F.col("id")).alias("first_seen_at"), F.timestamp_seconds(F.lit(1700000000)).alias("last_seen_at"))


def test_feeds_are_well_formed(spark, tmp_path):
    import xml.etree.ElementTree as ET
    docs = {r.format: r for r in publish.feed_documents(_public(spark), "Roles", "https://h.example", "d", at_now(), 20).collect()}
    assert all(d["items"] == 20 for d in docs.values())
    feed = json.loads(docs["json"].document)
    assert len(feed["items"]) == 20 and feed["items"][0]["title"] == "Dev <59> & co"
    atom, rss = ET.fromstring(docs["atom"].document), ET.fromstring(docs["rss"].document)
    assert len(atom.findall("{http://www.w3.org/2005/Atom}entry")) == 20 and rss.find("channel/item/title").text == "Dev <59> & co"
    publish.write_feeds(_public(spark), str(tmp_path / "feeds"), "Roles", "https://h.example", "d", at_now())
    assert {p.name for p in (tmp_path / "feeds").iterdir() if p.is_dir()} == {"format=json", "format=atom", "format=rss"}


def test_shards_hold_every_row_within_caps(spark, tmp_path):
    pub = _public(spark, 300)
    m = publish.write_shards(pub, str(tmp_path / "s"), buckets=4, max_rows=30, max_bytes=6000).collect()
    assert sum(r.job_count for r in m) == 300 and all(r.job_count <= 30 and r.byte_size <= 6000 for r in m)
    back = spark.read.json(str(tmp_path / "s"))
    assert back.select("job_id").distinct().count() == 300
    files = back.groupBy(F.input_file_name()).count().collect()
    assert len(files) == len(m)


def test_state_is_switched_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "state")
    assert seeds.read_state(spark, path) is None
    publish.save_state(spark, path, {"t": spark.range(3)}, batch_id=0)
    publish.save_state(spark, path, {"t": spark.range(5)}, batch_id=1)
    publish.save_state(spark, path, {"t": spark.range(9)}, batch_id=1)
    assert seeds.read_state(spark, path)["t"].count() == 5


def test_bucket_pruning_reaches_the_scan(spark, tmp_path):
    from vacantic.functions.ids import bucket
    pub = _public(spark).withColumn("bucket", bucket(F.col("job_id")))
    pub.write.partitionBy("bucket").parquet(str(tmp_path / "b"))
    one = pub.first().job_id
    df = seeds.read_buckets(spark, str(tmp_path / "b"), [one])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 1 and "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan


def test_contract_report(spark):
    df = spark.createDataFrame([("a" * 64, 0.5), ("short", 1.5), (None, None)], "job_id string, c double")
    rules = {"id": F.coalesce(F.col("job_id").rlike("^[0-9a-f]{64}$"), F.lit(False)), "c": contracts.between("c", 0.0, 1.0)}
    assert {r.rule: r.violations for r in contracts.check_contract(df, rules).collect()} == {"id": 2, "c": 2}


def test_company_upsert_keeps_old_names(spark):
    now = at_now()
    have = spark.createDataFrame([("x",)], "d string").select(
        companies.ids.company_id(F.lit("acme.com")).alias("company_id"), F.lit("Acme").alias("name"), F.lit("acme").alias("normalized_name"), F.lit("acme.com").alias("canonical_domain"),
        F.array().cast("array<string>").alias("aliases"), F.array(F.lit("u")).alias("careers_urls"), F.array(F.lit("lever")).alias("ats_sources"), now.alias("first_seen_at"), now.alias("last_seen_at"))
    raw = spark.createDataFrame([("simplify", "z", "Feed", "1", ("Acme Inc", "acme.com")), ("simplify", "z", "Feed", "2", ("New Co", None)), ("lever", "k", "Known", "3", (None, None))],
                                "adapter string, company_id string, company_name string, source_job_id string, metadata struct<company_name:string,company_domain:string>")
    out = {r.name: r for r in companies.resolve_company(raw, have, now).collect()}
    assert out["Acme Inc"].aliases == ["Acme", "Acme Inc"] and out["Acme Inc"].ats_sources == ["lever", "simplify"]
    assert out["New Co"].canonical_domain == "new-co.com" and len(out) == 2


# --- split and late polls, health --------------------------------------------------------------------------------------------
def _landing(spark, rows):
    return spark.createDataFrame([("s", T0 + dt.timedelta(days=d), "ok", p, "h") for d, p in rows], track.LANDING)


def test_a_poll_in_two_batches_and_a_late_poll(spark):
    state = track.empty_state(spark)
    for batch in ([(1, "a"), (2, "a")], [(1, "b"), (2, "c"), (4, "a")], [(4, "b"), (3, "z"), (2, "b")]):
        state = {k: spark.createDataFrame(v.collect(), v.schema) for k, v in track.apply_batch(state, _landing(spark, batch)).items()}
    got = {r.posting_id: (r.miss_count, r.first_seen_at, r.last_seen_at, r.state) for r in track.current_lifecycle(state).collect()}
    at = lambda d: T0 + dt.timedelta(days=d)
    # the poll of day 3 came last; it counts as the third one
    assert got == {"a": (0, at(1), at(4), "open"), "b": (0, at(1), at(4), "open"), "c": (2, at(2), at(2), "suspected_closed"), "z": (1, at(3), at(3), "open")}


def test_polls_in_random_order_equal_the_ordered_run(spark):
    import random
    polls, seen = _history(5)
    want, _ = _simulate(polls, seen)
    rows = [(s, at, o, None, None) for s, at, o in polls] + [(s, at, "ok", p, "h") for s, p, at in seen]
    random.Random(2).shuffle(rows)
    state, cut = track.empty_state(spark), len(rows) // 3 + 1
    for i in range(0, len(rows), cut):
        batch = spark.createDataFrame(rows[i:i + cut], track.LANDING)
        state = {k: spark.createDataFrame(v.collect(), v.schema) for k, v in track.apply_batch(state, batch).items()}
    got = {(r.source_id, r.posting_id): (r.miss_count, r.state, r.reopened_at, r.times_reopened) for r in track.current_lifecycle(state).collect()}
    assert got == {k: (r["misses"], r["state"], r["reopened"], r["times"]) for k, r in want.items()}


def test_numbers_by_slices(spark):
    rows = [(s, T0 + dt.timedelta(hours=7 * i)) for s in ("a", "b", None) for i in range(40) if (i + len(s or "")) % 3]
    got = {(r.source_id, r.poll_ts): (r.poll_no, r.polls) for r in track.number_by_slices(spark.createDataFrame(rows[:52], track.POLLS)).collect()}
    for s in ("a", "b"):
        mine = sorted(at for x, at in rows[:52] if x == s)
        assert [got[s, at] for at in mine] == [(i, len(mine)) for i in range(1, len(mine) + 1)]


class Counted(dict):
    """A mapping that counts the keys it is asked for."""

    def __init__(self):
        super().__init__()
        self.touched = 0

    def get(self, key, default=None):
        self.touched += 1
        return super().get(key, default)

    def __iter__(self):
        raise AssertionError("walked")


def test_a_poll_touches_only_postings_that_come_go_or_are_due():
    down, due, before, rng = Counted(), Counted(), set(), __import__("random").Random(4)
    misses, want, got = {}, [], []
    for number in range(1, 60):
        listed = {f"p{i}" for i in range(2000) if rng.random() < (0.999 if i % 50 else 0.6)} if number != 30 else set()
        down.touched, waiting = 0, set(dict.get(due, number) or [])
        moves = list(track.lifecycle_step(number, before, listed, down, due))
        got += [(number, *m) for m in moves]
        changed = len(listed - before) + len(before - listed)
        assert down.touched <= changed + len(waiting)  # 2000 postings are known
        for p in list(misses):
            if p not in listed:
                misses[p] += 1
                if misses[p] in (2, 4):
                    want.append((number, p, "suspected_closed" if misses[p] == 2 else "closed", misses[p]))
        for p in listed:
            if p not in misses or misses[p] >= 2:
                want.append((number, p, "open" if p not in misses else "reopened", 0))
            misses[p] = 0
        before = listed
    assert sorted(got) == sorted(want)


def test_an_unhealthy_source_closes_nothing(spark):
    days = [("s", T0 + dt.timedelta(days=d), "healthy" if d < 2 else h) for d, h in enumerate(["", "", "degraded", "failing", "unsupported", "blocked"])]
    polls = spark.createDataFrame(days, "source_id string, poll_ts timestamp, health_status string")
    seen = spark.createDataFrame([("s", "p", T0)], "source_id string, posting_id string, poll_ts timestamp")
    assert [(r.miss_count, r.state) for r in lifecycle.miss_streak(seen, polls).collect()] == [(1, "open")]
    assert [(r.miss_count, r.state) for r in lifecycle.miss_streak(seen, polls.drop("health_status")).collect()] == [(5, "closed")]
    state = spark.createDataFrame([("s", "p", 3, "suspected_closed", None, None, T0)], "source_id string, posting_id string, miss_count long, state string, "
                                  "closed_at timestamp, reopened_at timestamp, last_seen_at timestamp")
    for health, want in (("degraded", (3, "suspected_closed")), ("healthy", (4, "closed"))):
        polled = spark.createDataFrame([("s", health)], "source_id string, health_status string")
        out = lifecycle.advance_lifecycle(state, seen.limit(0), polled, F.lit(T0)).first()
        assert (out.miss_count, out.state) == want


def test_rank_over_all_rows_moves_them_once(spark):
    """Places in a range are numbered where the range is written; only one small row per range meets the rows again."""
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("v"), "id")
    ranked = group_rank(df, [], [F.col("v").desc(), F.col("id")], "n", parts=8)
    assert [r.n for r in ranked.orderBy(F.col("v").desc(), F.col("id")).collect()] == list(range(1, 1001))
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_state_map_reads_and_writes_a_key_once():
    """Every access to a stream's state is a call into the JVM."""
    class State(dict):
        calls = 0

        def getValue(self, key):
            self.calls += 1
            return self.get(key)

        def updateValue(self, key, value):
            self.calls += 1
            self[key] = value

        def removeKey(self, key):
            self.calls += 1
            del self[key]

    state = State({("a",): (1,), ("b",): (2,)})
    view = track._MapView(state)
    for i in range(10):
        view["c"] = i
        assert view.get("a") == 1 and view.get("c") == i and view.get("d") is None
    del view["a"]
    view["e"] = 1
    del view["e"]
    assert view.get("a", 7) == 7
    view.flush()
    assert dict(state) == {("b",): (2,), ("c",): (9,)} and state.calls == 4  # a and d read, a removed, c written


def test_small_pieces_share_a_call(spark):
    """Pieces of seven rows of one group are solved in a few calls, not one call each; files are those of one pass."""
    df = spark.range(0, 500).select(F.lit(1).alias("bucket"), "id", (F.col("id") * 31 % 17 + 1).alias("w"))
    got = publish.chunk_by_budget(df, ["bucket"], [F.col("id")], F.col("w"), 7, 60, segment=7, parts=4)
    chunks, chunk, rows, size = [], 0, 0, 1
    for i in range(500):
        w = i * 31 % 17 + 1
        if rows and (rows + 1 > 7 or size + w + 1 > 60):
            chunk, rows, size = chunk + 1, 0, 1
        chunks, rows, size = [*chunks, chunk], rows + 1, size + w + 1
    assert [r.chunk for r in got.orderBy("id").collect()] == chunks
    plan = got._jdf.queryExecution().analyzed().toString()
    assert "FlatMapGroupsInPandas [bucket" in plan and "_block" in plan
