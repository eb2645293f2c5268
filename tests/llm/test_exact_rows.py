"""Rows stay apart and ids stay whole: large ids next to null ones, equal hashes, lengths of vectors, clashing columns."""

import math

import pytest

import corpus_pipeline
from vacantic.llm import jaccard, lmscore, packing, pivots, substrings
from vacantic.llm.queries import tokenizer

A, B = 2**60 + 1, 2**60 + 3
WORDS = " ".join(f"w{i}" for i in range(40))


def table(spark, rows, schema="doc_id bigint, text string"):
    return spark.createDataFrame(rows, schema).coalesce(1)


def test_large_ids_in_a_batch_with_a_null(spark):
    docs = table(spark, [(A, WORDS), (None, "z"), (B, WORDS), (None, None)])
    removed = {(r.doc_id, r.n_removed) for r in substrings.drop_repeats(docs).collect()}
    assert removed == {(A, 40), (B, 40), (None, 0)}
    joined = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard.join_components(docs).collect())
    assert joined == [(0, 0, None), (0, 1, None), (A, 36, A), (B, 36, A)]
    packed = packing.pack(docs, tokenizer("byte_bpe_50k.json")).collect()
    assert {r.doc_id for r in packed} == {A, B, None}
    target = spark.createDataFrame([(A,)], "doc_id bigint")
    scored = {(r.doc_id, r.n_chars) for r in lmscore.score(docs, target).collect()}
    assert scored == {(A, len(WORDS)), (B, len(WORDS)), (None, 1), (None, 0)}


def test_rows_without_ids_and_with_one_id(spark):
    rows = [(None, f"single {i}") for i in range(20_000)] + [(None, WORDS), (None, WORDS + " end"), (7, WORDS), (7, "x " + WORDS), (7, WORDS)]
    out = substrings.drop_repeats(table(spark, rows).repartition(4)).where("n_words > 2").collect()
    assert sorted((r.n_words, r.n_removed, r.kept) for r in out) == [(40, 40, "")] * 3 + [(41, 40, "end"), (41, 40, "x")]


def test_texts_whose_32_bit_hashes_are_equal(spark):
    """Many rows without an id: some texts share a 32-bit hash, and one of them repeats a window."""
    from pyspark.sql import functions as F
    many = spark.range(120_000).select(F.lit(None).cast("bigint").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    twins = many.withColumn("h", F.hash("text")).groupBy("h").agg(F.count("*").alias("n"), F.min("text").alias("text")).where("n > 1")
    short = twins.select("text", "h").first()
    assert short is not None  # two short texts with one hash; the old key took them for one row
    docs = many.limit(50_000).unionByName(table(spark, [(None, WORDS), (None, WORDS), (None, short.text)]))
    got = substrings.drop_repeats(docs).agg(F.sum("n_removed"), F.count("*")).first()
    assert tuple(got) == (80, 50_003)


def test_each_length_of_vectors_is_indexed(spark):
    rows = [(i, [math.cos(i), math.sin(i)] * 8) for i in range(30)] + [(100, [1.0] * 8), (101, [2.0] * 8), (102, [1.0, 0.0] * 4), (103, [1.0]), (104, [3.0]),
                                                                       (105, None), (106, []), (None, [0.0] * 8), (107, [1.0] * 16), (A, [1.0] * 8)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pivots.near_duplicates(
        spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    assert len(got) == len(rows) and got[100] == (2, 100, True) and got[101] == (2, 100, False) and got[A] == (2, 100, False)
    assert got[102] == (0, 102, True) and got[103] == (1, 103, True) and got[104] == (1, 103, False)
    assert got[105] == (0, 105, True) and got[106] == (0, 106, True) and got[None][0] == 0
    alone = {r.vec_id: (r.n_links, r.component_id) for r in pivots.near_duplicates(
        spark.createDataFrame([r for r in rows if r[1] and len(r[1]) == 16], "vec_id bigint, embedding array<double>")).collect()}
    assert {k: v[:2] for k, v in got.items() if k in alone} == alone


@pytest.mark.parametrize("stage", ["repeats"])
def test_a_stage_keeps_columns_with_the_names_of_results(spark, stage):
    docs = spark.createDataFrame([(1, WORDS + " own", "en", "s", 1, "mine", 7), (2, WORDS, "en", "s", 2, "mine", 7)],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, N_words bigint")
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(tuple(r) for r in out.collect()) == [(1, "own", "en", "s", 3, "mine", 7), (2, "", "en", "s", 0, "mine", 7)]
    assert out.where("false").count() == 0 and dict(corpus_pipeline.STAGES)[stage](spark, docs.limit(0), "").count() == 0
