"""Tables of an operator go with its scope, also after an error; what is kept stays readable."""

import os

import pytest
from pyspark.sql import functions as F

from vacantic.llm import jaccard, substrings
from vacantic.llm.common import scope, stored
from vacantic.operators.scale import checkpoint_dir


def folders(spark) -> set:
    path = checkpoint_dir(spark).removeprefix("file:") + "/tables"
    return set(os.listdir(path)) if os.path.isdir(path) else set()


def test_scopes_delete_their_tables(spark):
    before = folders(spark)
    with scope(spark) as keep:
        stored(spark.range(3))
        with scope(spark) as keep_inner:
            stored(spark.range(4))
            inner = keep_inner(spark.range(5))
        assert len(folders(spark) - before) == 2 and inner.count() == 5
        out = keep(inner.where("id > 1"))
    assert len(folders(spark) - before) == 1 and out.count() == 3
    with pytest.raises(ZeroDivisionError), scope(spark):
        stored(spark.range(3))
        1 / 0
    assert len(folders(spark) - before) == 1
    stored(spark.range(2))
    assert len(folders(spark) - before) == 2


def test_operators_leave_what_their_result_reads(spark):
    words = [f"w{i}" for i in range(50)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words) + " more"), (3, "alone here"), (None, None)], "doc_id bigint, text string")
    before = folders(spark)
    kept = jaccard.keep_one(docs)
    assert len(folders(spark) - before) == 2
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "None"]
    before = folders(spark)
    out = substrings.drop_repeats(docs)
    assert len(folders(spark) - before) == 1
    assert {r.doc_id: r.n_removed for r in out.select("doc_id", F.col("n_removed")).collect()} == {1: 50, 2: 50, 3: 0, None: 0}
