"""The trigram index finds what the plain search finds, and reads little for it."""

import random

import pytest
from pyspark.sql import functions as F

from vacantic.operators.search import FilterSpec, search
from vacantic.plans import text_index


@pytest.fixture(scope="module")
def postings(spark):
    from vacantic.bindings import tables as t
    return t.postings(spark, "/root/testdata/sf0.001")


def test_trigrams_with_end_marks(one):
    assert one(text_index.trigrams(F.col("t")), t="abcab") == ["abc", "bca", "cab", "ab\x00", "b\x00\x00"]
    assert one(text_index.trigrams(F.col("t")), t="") == ["\x00\x00"] and one(text_index.trigrams(F.col("t").substr(9, 1)), t="x") == ["\x00\x00"]


def test_same_rows_as_the_plain_search(spark, postings, tmp_path):
    odd = postings.limit(3).withColumns({"job_id": F.lit(None).cast("string"), "title": F.lit("Unnamed Ring é漢字 99")})
    every = postings.unionByName(odd).unionByName(postings.limit(2).withColumn("title", F.lit(None).cast("string")))
    path = str(tmp_path)
    text_index.write_text_index(every, path, buckets=8)
    rng = random.Random(1)
    hays = [r[0] for r in every.select(text_index.haystack()).collect()]
    queries = ["ring", "é漢字", "RING 99", "x", "", "ri", "00", "nothing at all", "9 9"]
    queries += [" ".join(h[a:a + rng.randint(2, 6)].strip() for a in (rng.randrange(len(h)),) * 2) for h in rng.sample(hays, 4)]
    for q in queries:
        spec = FilterSpec(q=q, sort="newest", page_size=100_000, workplace_types=["remote", "onsite"])
        a, b = ([(r.job_id, r.title) for r in df.select("job_id", "title").collect()] for df in (text_index.search_indexed(spark, path, spec), search(every, spec)))
        assert sorted(a, key=str) == sorted(b, key=str), q


def test_an_empty_table(spark, postings, tmp_path):
    text_index.write_text_index(postings.limit(0), str(tmp_path), buckets=4)
    assert text_index.search_indexed(spark, str(tmp_path), FilterSpec(q="ring", sort="newest")).count() == 0


def test_only_matching_row_groups_are_read(spark, postings, tmp_path):
    path = str(tmp_path)
    text_index.write_text_index(postings, path, buckets=8, group_bytes=4096)
    total = spark.read.parquet(f"{path}/grams").count()
    found = text_index.candidates(spark, path, "customer#000000017")
    assert found.count() >= 1
    df = spark.read.parquet(f"{path}/grams").where("gram = '017'")
    df.collect()
    scan = df._jdf.queryExecution().executedPlan()
    while scan.children().size():
        scan = scan.children().apply(0)
    text = scan.toString()
    assert "PushedFilters" in text and "EqualTo(gram,017)" in text
    read = scan.metrics().apply("numOutputRows").value()
    assert 0 < read < total / 4  # rows of the row groups that hold the trigram
    buckets = {r.bucket for r in found.collect()}
    plan = text_index.matching_rows(spark, path, "customer#000000017")._jdf.queryExecution().executedPlan().toString()
    assert len(buckets) < 8 and "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "[bucket")


def test_lists_of_one_task_need_no_shuffle_and_ids_may_repeat(spark, postings, tmp_path, monkeypatch):
    """Slices of seven rows: a key is counted once however many lists name the row."""
    monkeypatch.setattr(text_index, "LIST_ROWS", 7)
    path = str(tmp_path)
    text_index.write_text_index(postings.unionByName(postings.limit(40)), path, buckets=2)
    lists = spark.read.parquet(f"{path}/grams")
    assert lists.agg(F.max(F.size("rows"))).first()[0] <= 7 and dict(lists.dtypes)["rows"] == "array<int>"
    want = postings.where(text_index.haystack().contains("ring")).select("job_id").distinct().count()
    assert text_index.matching_rows(spark, path, "ring").where(text_index.haystack().contains("ring")).select("job_id").distinct().count() == want > 0
    assert len(text_index._keys(["".join(chr(200 + i) for i in range(70))])) == 68  # more keys than one number has bits
    assert text_index.candidates(spark, path, "".join(chr(200 + i) for i in range(70))).count() == 0
