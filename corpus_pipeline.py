"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of `documents`.
`run` writes every stage's rows to the shared checkpoint folder and reads them back, so a lost executor never costs
more than the stage at work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantic.llm import jaccard, langid, packing, pii, substrings
from vacantic.llm.common import free_name, stored

PSEUDONYM_KEY = "sample key; give your own"
ORACLE_SQL = None  # hyperdimensional profiles, pseudonyms and packing are beyond SQL: tests/llm/test_table_operators.py


def _resized(docs: DataFrame, text, columns: list[str]) -> DataFrame:
    """The columns with a new text, and n_chars anew where the text has changed."""
    size = F.when(text.eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(F.char_length(text).cast("bigint"))
    return docs.select(*[text.alias(c) if c == "text" else size.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language one of the labelled languages explains."""
    return langid.reject(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that share five-word shingles to 80 % or more."""
    return jaccard.keep_one(docs, n=5, percent=80)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of windows that repeat anywhere; a text that loses none stays as it is."""
    own = {c: free_name(docs, f"_own_{c}") for c in docs.columns if c.lower() in ("n_words", "n_removed", "kept")}
    cleaned = substrings.drop_repeats(docs.withColumnsRenamed(own))
    done = _resized(cleaned, F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text")), [own.get(c, c) for c in docs.columns])
    return done.withColumnsRenamed({v: c for c, v in own.items()})


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms for personal numbers, dates and addresses."""
    changed = free_name(docs, "_changed")
    out = pii.pseudonymise(docs, PSEUDONYM_KEY, counter=changed)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(changed) > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return out.drop(changed)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens, with their ids (little-endian, 32 bits each)."""
    import public_tokenizers
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeats", repeats), ("private", private), ("sequences", sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
