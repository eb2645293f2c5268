"""What the corpus operators leave on disk and move while they run."""

import time

import numpy as np
from pyspark.sql import functions as F

from vacantic.llm import jaccard, substrings
from vacantic.llm.common import CLEANUP, sifted, stored


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (files.apply(i).getName() for i in range(files.size())) if name.startswith("shuffle_")}


def test_shuffle_files_go_with_the_write(spark):
    before, setting = shuffle_files(spark), spark.conf.get(CLEANUP)
    out = stored(spark.range(20_000).groupBy((F.col("id") % 7001).alias("k")).count())
    for _ in range(50):  # they are removed in the background
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert out.count() == 7001 and spark.conf.get(CLEANUP) == setting


def test_the_rest_is_what_sifting_leaves_out(spark):
    rows = spark.range(500).union(spark.sql("select cast(null as bigint)"))
    for wanted in (rows.where("id % 9 = 0"), rows.limit(0), rows.where("id is null")):
        held, rest = (sorted(str(r.id) for r in sifted(rows, wanted, "id", rest=x).collect()) for x in (False, True))
        assert sorted(held + rest) == sorted(str(r.id) for r in rows.collect())
        assert {str(r.id) for r in wanted.collect()} <= set(held)


def test_points_are_kept_without_their_sets(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = spark.createDataFrame([(1, text), (1, text), (1, "another text of this id"), (None, text)], "doc_id bigint, text string") \
        .select(*jaccard.exact_id("doc_id"), "text")
    node = jaccard.set_key(jaccard.shingles(text, 4))
    sets = jaccard._sets(rows, spark.createDataFrame([(1, node)], "id bigint, node bigint"), 4)
    assert sets.columns == ["node", "n", "point"]
    assert [(r.node, r.n) for r in sets.collect()] == [(node, 27)]


def test_equal_windows_agree_beside_their_minimiser():
    rng = np.random.default_rng(3)
    for width, m in ((35, 6), (9, 2), (5, 5), (6, 5), (4, 1)):
        for letters in (2, 3, 40):
            texts = [[b"%d" % x for x in rng.integers(0, letters, width + 30)] for _ in range(4)]
            texts[3][5:5 + width] = texts[0][11:11 + width]
            seen = {}
            for words in texts:
                for mini, first, count, left, right in zip(*substrings.super_kmers(words, width, m, sides=True)):
                    for w in range(first, first + count):
                        seen.setdefault(tuple(words[w:w + width]), []).append((mini, left, right))
            assert any(len(x) > 1 for x in seen.values())
            for places in seen.values():
                for mini, left, right in places:
                    assert all(mini == x and (left == y != 0 or right == z != 0) for x, y, z in places)


def test_a_shared_minimiser_alone_is_no_repeat_beside_it():
    phrase = [b"p%d" % i for i in range(8)]
    one, two = ([b"%s%d" % (c, i) for i in range(40)] + phrase + [b"%s%d" % (c, i) for i in range(40, 80)] for c in (b"a", b"b"))
    found = [{x[0]: x[3:] for x in zip(*substrings.super_kmers(t, 35, 6, sides=True))} for t in (one, two)]
    for mini in set(found[0]) & set(found[1]):
        assert found[0][mini][0] != found[1][mini][0] and found[0][mini][1] != found[1][mini][1]
