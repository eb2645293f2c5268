import random
import string

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vacantic.functions import text

PIECES = ["<p>", "</p>", "<br/>", "</div>", "<b x='1'>", "<", ">", "a", "Zed", " ", "\n", "\t", "\x07", "--", "x < y", "</li>", "  \n\n", "'", '"']


def _strings(seed: int, n: int = 400) -> list[str]:
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 14))) for _ in range(n)]


def test_jvm_way_equals_python_way(spark):
    rows = _strings(1) + ["".join(random.Random(i).choices(string.printable, k=40)).replace("&", "+") for i in range(200)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string")
    out = df.select("i", text.normalize_ws(F.col("s")).alias("n"), text.html_to_text(F.col("s")).alias("p"),
                    text.canonical_text(F.col("s")).alias("c")).orderBy("i").collect()
    for r, s in zip(out, rows):
        assert r.n == text._one_line(s), repr(s)
        assert r.p == text._plain(s), repr(s)
        assert r.c == text._one_line(text._one_line(text._plain(s)).casefold()), repr(s)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_one_line_is_idempotent(s):
    once = text._one_line(s)
    assert text._one_line(once) == once
    assert "\n" not in once and once == once.strip()


def test_unicode_and_entities(spark):
    rows = ["“Smart” – ﬁne x", "&lt;div&gt;&lt;h2&gt;About&lt;/h2&gt;&lt;p&gt;Build it.&lt;br&gt;Now&lt;/div&gt;", "STRASSE Straße", "&amp;amp;lt;b&amp;amp;gt; R&amp;D"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string")
    out = [r for r in df.select("i", text.normalize_ws(F.col("s")).alias("n"), text.html_to_text(F.col("s")).alias("p"),
                                text.canonical_text(F.col("s")).alias("c")).orderBy("i").collect()]
    assert out[0].n == '"Smart" - fine x'
    assert "About" in out[1].p and "Build it." in out[1].p and "&lt;" not in out[1].p and "<h2>" not in out[1].p
    assert out[2].c == "strasse strasse"
    assert out[3].p == "R&D"


def test_null_and_empty(one):
    assert one(text.html_to_text(F.lit(None).cast("string"))) == ""
    assert one(text.canonical_text(F.lit(""))) == ""
    assert one(text.truncate_summary(F.lit(""))) is None


def test_truncate_keeps_words(one):
    long = "word " * 1000
    out = one(text.truncate_summary(F.col("s")), s=long)
    assert len(out) <= 2000 and out.endswith("word…")
    assert one(text.truncate_summary(F.col("s")), s="  short  ") == "short"


def test_truncate_as_the_plain_patterns_do(spark):
    rnd = random.Random(5)
    rows = ["".join(rnd.choice(["a", "bc", " ", "  ", "\n", "\u2028", "\u00a0", "é", "\t"]) for _ in range(rnd.randint(0, 30))) for _ in range(500)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string")

    def strip_end(c):
        return F.regexp_replace(c, r"(?U)\s+$", "")

    t = strip_end(F.regexp_replace("s", r"(?U)^\s+", ""))
    cut = F.regexp_replace(strip_end(F.substring(t, 1, 11)), r" [^ ]*$", "")
    want = F.when(F.col("s") != "", F.when(F.length(t) <= 12, t).otherwise(F.concat(cut, F.lit("…"))))
    assert df.where(~want.eqNullSafe(text.truncate_summary(F.col("s"), 12))).count() == 0


def test_markup_soup_is_empty(one):
    assert one(text.clean_summary(F.col("s")), s="<<<>>><<&&& a") == ""
    assert one(text.clean_summary(F.col("s")), s="<b>Real</b> words &amp; more of them") == "Real words & more of them"


def test_word_marks(one):
    m = text.mark_words(F.col("s"), "+#")
    def has(s, p):
        return one(F.contains(m, F.lit(text.marked_phrase(p, "+#"))), s=s)
    assert has("we use c++ here", "c++") and not has("we use c++ here", "c")
    assert has("c, sql", "c") and has("next.js apps", "next.js") and not has("goal", "go")
    assert has("ci/cd", "ci/cd")


def test_batches_of_long_texts_are_bounded_by_bytes(spark):
    """Rows that go to Python come in batches of some megabytes, however many of them a partition holds."""
    from pyspark.sql import types as T

    @F.pandas_udf(T.StringType())
    def held(values):
        return values.map(lambda _: str(values.dropna().map(len).sum()), na_action="ignore")

    rows = spark.range(0, 1000, 1, 1).select(F.concat(F.lit("é"), F.repeat(F.lit("x"), F.lit(20_000))).alias("t"))
    most = rows.select(text._either(F.col("t"), text._ascii, F.trim, held).cast("long").alias("n")).agg(F.max("n")).first()[0]
    assert most <= 4 * text.BATCH_BYTES  # 20 MB in one batch before
