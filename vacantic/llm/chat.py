"""Chat formatting: of logged conversations that grow from snapshot to snapshot only the longest ones are rendered.

Turns are numbered within their conversation, and a running hash over the turns so far stands at each of them (two
independent 64-bit hashes of number, role and text, added up by a window; a conversation is sorted in one task).
A conversation whose last hash stands inside another one is a prefix of it: an anti-join drops it.  Of conversations
with the same turns the smallest id stays.  What remains is rendered.

Defined results: turns are ordered by (turn, role, text), nulls first; a row that repeats another one of its
conversation counts once; null role and null text are values of their own (rendered as empty), distinct from ''; rows
without a conversation id form one conversation with a null id; an empty table yields no rows; other columns are not
carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_HALF = (1 << 32) - 1


def _turn_hash(number: str, seed: int) -> Column:
    """A hash that tells null from empty (null columns are skipped by the hash itself)."""
    return F.xxhash64(F.lit(seed), F.col(number), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text"))


def running_hashes(turns: DataFrame) -> DataFrame:
    """Distinct turns of each conversation with `n` (1, 2, ...) and `prefix`, the hash of the turns up to there."""
    w = Window.partitionBy("conv_id").orderBy(*[F.col(c).asc_nulls_first() for c in ("turn", "role", "text")])
    same = F.lit(True)
    for c in ("turn", "role", "text"):
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    rows = turns.select("conv_id", "turn", "role", "text") \
        .withColumn("_first", F.row_number().over(w) == 1).withColumn("_again", same).where("_first or not _again").drop("_first", "_again")
    rows = rows.withColumn("n", F.row_number().over(w))
    sums = []
    for seed in (1, 2):
        h = _turn_hash("n", seed)
        for part in (h.bitwiseAND(F.lit(_HALF)), F.shiftrightunsigned(h, 32)):  # halves: their sums cannot overflow
            sums.append(F.sum(part).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("prefix", F.concat_ws("-", "n", *[s.cast("string") for s in sums])) \
        .withColumn("last", F.lead(F.lit(False), 1, True).over(w))


def maximal(hashed: DataFrame) -> DataFrame:
    """Ids of the conversations that no other one continues."""
    ends = hashed.where("last").groupBy("prefix").agg(F.min("conv_id").alias("conv_id"))
    inside = hashed.where("not last").select("prefix").distinct()
    return ends.join(inside, "prefix", "left_anti").select("conv_id")


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), F.coalesce(role, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit(END + "\n"))


def rendered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, n, text) of every turn of the maximal conversations, as rows: no conversation is put together."""
    hashed = running_hashes(turns)
    ids = maximal(hashed).select(F.col("conv_id").alias("_id"))
    kept = hashed.join(ids, hashed["conv_id"].eqNullSafe(ids["_id"]), "left_semi")
    return kept.select("conv_id", "n", render_turn(F.col("role"), F.col("text")).alias("text"))


def collapse(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, rendered) of every maximal conversation; one string has to fit into a task (see `rendered_turns`)."""
    kept = rendered_turns(turns)
    parts = F.sort_array(F.collect_list(F.struct("n", F.col("text").alias("s"))))
    return kept.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.array_join(F.transform(parts, lambda x: x["s"]), "").alias("rendered"))
