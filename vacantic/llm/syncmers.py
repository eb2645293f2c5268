"""Document fingerprints of closed syncmers, in DataFrame expressions only.

A text is a row of symbols: its runs of up to 12 non-blank characters.  Of all k-mers (k consecutive symbols) those are
anchors whose smallest inner s-mer (by hash) is the first or the last one in them.  This depends on the k symbols
alone, never on what stands around them, so an edit changes only the anchors that overlap it, and equal passages have
equal anchors at matching distances.  k - 1 blanks before the text let its beginning have anchors too.

Defined results: null text is empty; an empty text has no anchor and an empty fingerprint; a text in which no k-mer
is an anchor has one, the hash of all its symbols; the likeness of two texts is the Jaccard index of their distinct
anchors, 1 for two empty ones; rows may repeat (each yields a row; for its neighbours, a repeated id stands once, with
the text that sorts first); a null id sorts after all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantic.functions.let import let
from vacantic.operators.scale import durable

SYMBOL = r"\S{1,12}"
LOW32 = 0xFFFFFFFF


def anchors(text: Column, k: int = 5, s: int = 2) -> Column:
    """Array of (pos, hash) in the order of the text; pos is the k-mer's last symbol, counted from 0."""
    if not 1 < s < k:
        raise ValueError("1 < s < k is needed")
    symbols = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SYMBOL), F.lit(0))
    hashes = F.concat(F.array_repeat(F.lit(0).cast("bigint"), k - 1), F.transform(symbols, lambda x: F.xxhash64(x)))

    def inner(h: Column) -> Column:
        """Hashes of all s-mers."""
        return F.transform(F.sequence(F.lit(0), F.size(h) - s), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(s)]))

    def closed(m: Column, i: Column) -> Column:
        edge = F.least(F.get(m, i), F.get(m, i + (k - s)))
        middle = [F.get(m, i + j) for j in range(1, k - s)]
        return edge <= (F.least(*middle) if len(middle) > 1 else middle[0]) if middle else F.lit(True)

    def picked(h: Column, m: Column) -> Column:
        chosen = F.filter(F.sequence(F.lit(0), F.size(h) - k), lambda i: closed(m, i))
        steps = sorted({*range(0, k - s, s), k - s})  # s-mers that together hold every symbol
        return F.transform(chosen, lambda i: F.struct(
            i.cast("int").alias("pos"), F.hash(*[F.get(m, i + j) for j in steps]).alias("hash")))

    whole = lambda h: F.array(F.struct((F.size(h) - k).cast("int").alias("pos"), F.hash(h).alias("hash")))
    none = F.array().cast("array<struct<pos:int,hash:int>>")
    return let(hashes, lambda h: F.when(F.size(h) < k, none).otherwise(
        let(let(inner(h), lambda m: picked(h, m)), lambda p: F.when(F.size(p) > 0, p).otherwise(whole(h)))))


def fingerprint(found: Column) -> Column:
    """Anchors as one string, eight hexadecimal digits each, in the order of the text."""
    return F.array_join(F.transform(found["hash"], lambda x: F.lpad(F.lower(F.hex(x.cast("bigint").bitwiseAND(F.lit(LOW32)))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of the distinct values of two arrays."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(both / either)


def positional_matches(a: Column, b: Column) -> Column:
    """Array of (pos_a, pos_b): where each anchor that two texts share first stands in either."""
    def first(x: Column, h: Column) -> Column:
        return F.get(x["pos"], F.array_position(x["hash"], h).cast("int") - 1)
    return F.transform(F.array_intersect(a["hash"], b["hash"]), lambda h: F.struct(first(a, h).alias("pos_a"), first(b, h).alias("pos_b")))


def ring(rows: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """Distinct keys in descending order (null last), closed to a ring: each row with `prev`, the key before it, and the
    other columns of that row, named prev_<column>.  No task sees more than its range of keys."""
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    others = [c for c in rows.columns if c != key]
    order = F.col(key).desc_nulls_last()
    ranged = durable(rows.repartitionByRange(parts, order).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy("_range").orderBy(order)
    packed = F.struct(F.col(key).alias("key"), *others)
    numbered = ranged.withColumn("_before", F.lag(packed).over(inside)) \
        .withColumn("_last", F.lead(F.lit(1)).over(inside).isNull())
    # one row per range: its last key is what stands before the first key of the next range
    ends = numbered.where("_last").select("_range", packed.alias("_end"))
    line = Window.orderBy("_range")
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fill = ends.select("_range", F.coalesce(F.lag("_end").over(line), F.last("_end").over(whole)).alias("_fill"))
    return numbered.join(fill, "_range").withColumn("_prev", F.coalesce("_before", "_fill")) \
        .select(*rows.columns, F.col("_prev.key").alias("prev"), *[F.col(f"_prev.{c}").alias(f"prev_{c}") for c in others])


def edited_neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, s: int = 2) -> DataFrame:
    """Compare each text with its edited form and with the next text (descending key, in a ring).

    The edit replaces the last third of the code points by as many from the beginning of the next text (all, if it has
    fewer).  Returns key, text, n_chars, edited, anchors, edited_anchors, near_edited, near_next.  Texts travel by key
    once, and their needed beginnings once more to the row before; anchors travel as 32-bit numbers.
    """
    # a null key is told apart by a flag; all joins and the grouping use the same two columns, so texts are dealt out once
    k_ = F.col(f"`{key}`").cast("bigint")
    rows = docs.select(F.coalesce(k_, F.lit(0)).alias("kk"), k_.isNull().alias("kn"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    sizes = rows.groupBy("kk", "kn").agg(F.max(F.char_length("text")).alias("need"), F.min(F.xxhash64("text")).alias("mark"))
    before = ring(sizes.select(F.when(~F.col("kn"), F.col("kk")).alias("key"), "need", "mark"), "key").select(
        F.coalesce("key", F.lit(0)).alias("kk"), F.col("key").isNull().alias("kn"), "prev", F.floor(F.col("prev_need") / 3).cast("int").alias("prev_need"), "mark")
    # of rows with one key the first text stands for all; not written as an equality, which would become part of the join key
    given = rows.join(before, ["kk", "kn"]).where(F.xxhash64("text").bitwiseXOR(F.col("mark")) == 0).select(
        F.coalesce("prev", F.lit(0)).alias("kk"), F.col("prev").isNull().alias("kn"), F.left("text", F.col("prev_need")).alias("head"),
        anchors(F.col("text"), k, s)["hash"].alias("next_hashes")).dropDuplicates(["kk", "kn"])
    both = rows.join(given, ["kk", "kn"]).withColumn("n_chars", F.char_length("text").cast("bigint"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    both = both.withColumn("edited", F.concat(F.left("text", (F.col("n_chars") - cut).cast("int")), F.left("head", cut))).drop("head")
    both = both.withColumn("anchors", anchors(F.col("text"), k, s)).withColumn("edited_anchors", anchors(F.col("edited"), k, s))
    return both.select(
        F.when(~F.col("kn"), F.col("kk")).alias(key), F.col("text").alias(text), "n_chars", "edited", "anchors", "edited_anchors",
        likeness(F.col("anchors.hash"), F.col("edited_anchors.hash")).alias("near_edited"),
        likeness(F.col("anchors.hash"), F.col("next_hashes")).alias("near_next"))
