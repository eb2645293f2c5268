"""State in hash buckets, and the whole run over it."""

import datetime as dt
import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from vacantic.plans import state
from vacantic.sources.seeds import current_snapshot, current_version
from vacantic.streaming import run

T0 = dt.datetime(2024, 1, 1)
ROWS = "source_id string, job_id string, n long"
LAYOUT = state.Layout("source_id", within="job_id", spread=4)


def _folders(path, name):
    return {os.path.relpath(f, path) for f in glob.glob(f"{path}/{name}/*/bucket=*")}


def test_one_changed_source_rewrites_few_folders(spark, tmp_path):
    path = str(tmp_path)
    rows = spark.createDataFrame([(f"s{i % 40}", f"j{i}", i) for i in range(2000)], ROWS)
    assert state.read_table(spark, path, "postings") is None
    state.commit(spark, path, {"postings": (rows, LAYOUT, None)}, buckets=64)
    first = _folders(path, "postings")
    assert len(first) > 50 and state.read_table(spark, path, "postings").count() == 2000
    touched = LAYOUT.touched(rows.where("source_id = 's7'"), 64)
    assert len(touched) == 4
    old = state.read_table(spark, path, "postings", touched)
    assert old.where("source_id = 's7'").count() == 50 and old.count() < 600
    changed = old.withColumn("n", F.when(F.col("source_id") == "s7", F.col("n") + 10_000).otherwise(F.col("n")))
    state.commit(spark, path, {"postings": (changed, LAYOUT, touched)})
    now = set(current_snapshot(spark, path)["bucketed"]["postings"]["folders"].values())
    assert len(now - first) <= 4 and len(now) == len(first)
    back = {r.job_id: r.n for r in state.read_table(spark, path, "postings").collect()}
    assert back == {f"j{i}": i + (10_000 if i % 40 == 7 else 0) for i in range(2000)}
    # the version before the current one can still be read; older folders go with the next commit
    assert first <= _folders(path, "postings")
    state.commit(spark, path, {"postings": (state.read_table(spark, path, "postings", touched), LAYOUT, touched)})
    assert len(_folders(path, "postings")) == len(first) + len(now - first) and not (first - now) & _folders(path, "postings")


def test_odd_commits(spark, tmp_path):
    path = str(tmp_path)
    rows = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), (None, None, 3)], ROWS)
    state.commit(spark, path, {"t": (rows.limit(0), LAYOUT, None)}, {"log": rows.select("n").limit(0)}, buckets=8)
    assert state.read_table(spark, path, "t").count() == 0 and state.read_table(spark, path, "t", [0, 1]).columns == rows.columns
    state.commit(spark, path, {"t": (rows, LAYOUT, None)}, {"log": rows.select("n")}, {"batch_id": 1})
    assert state.read_table(spark, path, "t").count() == 3 and state.read_appended(spark, path, "log").count() == 3
    with pytest.raises(ValueError):  # rows of buckets that were not announced
        state.commit(spark, path, {"t": (rows, LAYOUT, [])})
    assert current_version(spark, path) == 2 and state.read_table(spark, path, "t").count() == 3
    # a half-written later version is not seen
    rows.write.parquet(f"{path}/log/run=3")
    assert state.read_appended(spark, path, "log").count() == 3 and state.read_appended(spark, path, "none") is None


def _poll(source, jobs, hour, outcome="ok", adapter="greenhouse"):
    at = T0 + dt.timedelta(hours=hour)
    body = None if jobs is None else json.dumps({"jobs": [{"id": i, "title": t, "absolute_url": f"https://x.example.com/{i}", "content": ""} for i, t in jobs]})
    return (source, f"c-{source}", source.title() if source else None, adapter, f"t-{source}", f"https://{source}.example.com/careers", at, outcome, body, None, at)


def _landed(spark, rows):
    return spark.createDataFrame(rows, run.LANDING)


def test_runs_late_polls_pages_and_replays(spark, tmp_path):
    path = str(tmp_path)
    first = [_poll("a", [("1", "Analyst"), ("2", "Data Engineer")], 0), _poll("a", [("3", "Intern"), ("3", "Intern")], 0),
             _poll("b", [("1", "Cook")], 0), _poll(None, [("9", "Nobody")], 0)]
    second = [_poll("a", [("1", "Senior Analyst")], 1), _poll("b", None, 1, "error"), _poll("c", [], 1)]
    run.apply_batch(spark, path, _landed(spark, first + second), 0, buckets=16)
    assert current_version(spark, path) == 2 and current_snapshot(spark, path)["marks"] == {"batch_id": 0, "runs": 2}
    run.apply_batch(spark, path, _landed(spark, first + second), 0, buckets=16)  # a replay
    assert current_version(spark, path) == 2

    def postings():
        return {(r.source_id, r.source_job_id): (r.title, r.lifecycle, r.miss_count) for r in state.read_table(spark, path, "postings").collect()}

    want = {("a", "1"): ("Senior Analyst", "open", 0), ("a", "2"): ("Data Engineer", "open", 1), ("a", "3"): ("Intern", "open", 1), ("b", "1"): ("Cook", "open", 0)}
    assert postings() == want
    sources = {r.source_id: (r.health_status, r.consecutive_failures, r.discovered_via) for r in state.read_table(spark, path, "sources").collect()}
    assert sources == {"a": ("healthy", 0, "landing"), "b": ("healthy", 1, "landing"), "c": ("healthy", 0, "landing")}
    # an old poll of a; pages of b of which one failed
    run.apply_batch(spark, path, _landed(spark, [_poll("a", [("7", "Late")], 0.5), _poll("b", [], 0.5)]), 1, buckets=16)
    assert postings() == want
    run.apply_batch(spark, path, _landed(spark, [_poll("b", [], 2), _poll("b", None, 2, "error")]), 2, buckets=16)
    assert postings() == want
    reports = [tuple(r)[1:] for r in state.read_appended(spark, path, "runs").orderBy("run").drop("run").collect()]
    # fetched, not_modified, failures, late, opened, updated, closed, reopened, promoted
    assert reports == [(2, 0, 0, 0, 4, 0, 0, 0, 0), (2, 0, 1, 0, 0, 1, 0, 0, 0), (0, 0, 0, 2, 0, 0, 0, 0, 0), (0, 0, 1, 0, 0, 0, 0, 0, 0)]
    companies = {r.company_id: r.active_job_count for r in state.read_table(spark, path, "companies").collect()}
    assert companies == {"c-a": 3, "c-b": 1, "c-c": 0}


def test_seeds_choose_the_sources(spark, tmp_path):
    from vacantic.sources.seeds import load_seeds
    seeds = load_seeds(spark.createDataFrame([("Acme", "acme.com", "greenhouse", "acme")], "company string, domain string, adapter string, tenant string"))
    known = seeds.first().source_id
    row = ("greenhouse", "acme", "https://acme.com/careers", T0, "ok", json.dumps({"jobs": [{"id": 1, "title": "Chef", "absolute_url": "https://x.example.com/1"}]}), None, T0)
    landed = _landed(spark, [(known, seeds.first().company_id, "Acme", *row), ("old-acme", "c", "Acme", *row)])
    run.apply_batch(spark, str(tmp_path), landed, 0, seeds=seeds, buckets=8)
    run.apply_batch(spark, str(tmp_path), landed.withColumn("run_at", F.col("run_at") + F.expr("INTERVAL 1 HOUR")), 1, seeds=seeds, buckets=8)
    rows = {r.source_id: (r.enabled, r.health_status, r.poll_tier) for r in state.read_table(spark, str(tmp_path), "sources").collect()}
    assert rows[known] == (True, "healthy", "hot") and rows["old-acme"][:2] == (False, "disabled")  # of a seeded domain, but no seed
    reports = [(r.fetched, r.opened) for r in state.read_appended(spark, str(tmp_path), "runs").orderBy("run").collect()]
    assert reports == [(2, 1), (1, 0)]
