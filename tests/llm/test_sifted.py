"""What the corpus operators keep and move between stages."""

from pyspark.sql import functions as F

from vacantic.llm import jaccard
from vacantic.llm.common import process_cache, sifted


def test_sifted_keeps_all_wanted_rows_and_few_others(spark):
    rows = spark.range(-5000, 5000).select(F.col("id").alias("k.y"), F.lit("x").alias("_at")).unionByName(
        spark.sql("select cast(null as bigint) as `k.y`, 'n' as _at"))
    wanted = rows.where("`k.y` % 7 = 0 or `k.y` is null").select("`k.y`")
    for bits, most in ((1 << 24, 1500), (1 << 10, 10_001)):
        out = sifted(rows, wanted, "k.y", bits)
        assert out.columns == rows.columns
        got = [r[0] for r in out.collect()]
        assert None in got and {x for x in range(-5000, 5000) if x % 7 == 0} <= set(got)
        assert len(got) == len(set(got)) <= most
    assert sifted(rows, wanted.limit(0), "k.y").count() == 0


def test_texts_that_share_no_entry_do_not_travel(spark):
    """The plan that reads sets back from their texts sifts the texts before it joins them."""
    texts = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(300, texts[7] + " end")], "doc_id bigint, text string")
    rows = docs.select(*jaccard.exact_id("doc_id"), "text")
    chosen = spark.createDataFrame([(7, jaccard.set_key(jaccard.shingles(texts[7], 4)))], "id bigint, node bigint")
    sets = jaccard._sets(rows, chosen, 4)
    assert "bitmap_construct_agg" in sets._jdf.queryExecution().toString()
    assert [r.node for r in sets.collect()] == [r.node for r in chosen.collect()]
    got = {r.doc_id: r.component_id for r in jaccard.join_components(docs, n=4, percent=85).collect()}
    assert got == {i: i for i in range(300)} | {300: 7}


def test_words_of_any_length_and_cut_have_the_same_hashes(monkeypatch):
    words = ["a", "B", "é", "漢字", "x" * 64, "x" * 65, "x" * 200 + "y", "y" + "x" * 200, "\0", "\x85"]
    text = "\x0b ".join(words) + "\r\n"
    one = [int(jaccard.word_hashes(w)[0]) for w in words]
    assert len(set(one)) == len(words) and one[1] == int(jaccard.word_hashes("b")[0])
    for size in (1, 7, 1 << 20):
        monkeypatch.setattr(jaccard, "CHUNK", size)
        assert jaccard.word_hashes(text).tolist() == one
    assert not len(jaccard.word_hashes(" \n")) and not len(jaccard.word_hashes(""))


def test_a_worker_keeps_what_one_operator_needs():
    process_cache("one")["x"] = 1
    assert process_cache("one") == {"x": 1}
    assert process_cache("two") == {} and process_cache("one") == {}
