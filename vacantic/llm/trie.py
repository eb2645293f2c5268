"""Prefix trie of conversations, built as burst tries.

Every conversation is a sequence of turns; a node of the trie is a distinct sequence of first turns.  Texts don't travel:
a turn is named by the MD5 of role and text and carries its number of words.

1. Equal sequences become one suffix with a number of members.
2. All suffixes start in one container under the root.  A container with more than `container_rows` turns bursts by the
   next turn id, its suffixes go to containers under deeper heads.  From round to round a burst takes twice as many turns
   at once, so a long common beginning costs a logarithmic number of rounds, and only what is still too large is touched.
3. Shards (partitions) receive the remaining containers whole, at most `container_rows` turns each; suffixes are sorted
   and swept with a stack into nodes.  A container of a single suffix is a chain, and its turns become nodes as rows.
4. The heads' trie stays in rows: each container stands for one path of heads, and combining aggregates over paths give the
   heads' counts.  Subtree sums need no walk: a node belongs to the path of its smallest member and adds to its beginnings.

Defined results: turns are ordered by turn (null first), then by the MD5 of role and text; every row is a turn, repeated
rows too; null role and text are empty; rows without a conversation id belong to no conversation and are left out; an
empty table yields no nodes, not even a root; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantic.llm.common import stored
from vacantic.operators.scale import group_rank

NO_ENDS = hashlib.sha256(b"").hexdigest()
CONTAINER_ROWS = 10_000
BLOCK = 4096  # turns of a long sequence summed at a time
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
WORD = r"[^\x20\x09-\x0D]+"


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn_no from 1, turn_id, n_words) of every turn, in the order of its conversation; a conversation of any length."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    slim = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn",
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("turn_id"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("n_words"))
    return group_rank(slim, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("turn_id").asc()], "turn_no").drop("turn")


def regrafted(numbered: DataFrame, family: int, borrowed: Column) -> tuple[DataFrame, DataFrame]:
    """Sequences (conv_id, depth, turn_id, n_words) and their lengths (conv_id, length).

    Conversation c takes its first `borrowed` turns (a function of conv_id) from conversation c - c % family, as many as
    there are, and goes on with its own turns after that number.  Conversations left without a turn have length 0.
    """
    ids = numbered.groupBy("conv_id").agg(F.max("turn_no").alias("_own")).withColumn("_h", borrowed)
    asked = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % family).alias("_from"), "_h").where("_h > 0")
    source = numbered.select(F.col("conv_id").alias("_from"), F.col("turn_no").alias("_i"), "turn_id", "n_words")
    most = asked.agg(F.max("_h")).first()[0] or 0
    lent = asked.join(source.where(F.col("_i") <= most), "_from").where("_i <= _h") \
        .select("conv_id", F.col("_i").cast("bigint").alias("depth"), "turn_id", "n_words")
    sizes = ids.join(lent.groupBy("conv_id").agg(F.count("*").alias("_got")), "conv_id", "left") \
        .select("conv_id", "_h", F.coalesce("_got", F.lit(0)).alias("_got"), "_own")
    rest = numbered.join(sizes.where("_own > _h").select("conv_id", "_h", "_got"), "conv_id").where("turn_no > _h") \
        .select("conv_id", (F.col("turn_no") - F.col("_h") + F.col("_got")).cast("bigint").alias("depth"), "turn_id", "n_words")
    lengths = sizes.select("conv_id", (F.col("_got") + F.greatest(F.col("_own") - F.col("_h"), F.lit(0))).cast("bigint").alias("length"))
    return lent.unionByName(rest), lengths


def _marks() -> list[Column]:
    """Two hashes of a turn at its place; the xor of all of them names a sequence."""
    return [F.xxhash64(F.lit(seed), "depth", "turn_id").alias(f"m{seed}") for seed in (1, 2)]


def _xor(prefix: str = "m") -> list[Column]:
    return [F.expr(f"bit_xor({prefix}{i})").alias(f"x{i}") for i in (1, 2)]


def _sequences_of(frames) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (length, x1, x2, conv_id) to one row per sequence, the members' ids hashed as they come."""
    key, first, count, sha = None, 0, 0, None
    for batch in frames:
        out: list[tuple] = []
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("length", "x1", "x2"))))
        ids = batch.column("conv_id").to_pylist()
        start = 0
        while start < len(keys):
            end = start + 1
            while end < len(keys) and keys[end] == keys[start]:
                end += 1
            text = ",".join(map(str, ids[start:end])).encode()
            if keys[start] == key:
                sha.update(b"," + text)
                count += end - start
            else:
                if key is not None:
                    out.append((first, key[0], count, sha.hexdigest()))
                key, first, count, sha = keys[start], ids[start], end - start, hashlib.sha256(text)
            start = end
        yield _batch(out, SEQUENCE)
    if key is not None:
        yield _batch([(first, key[0], count, sha.hexdigest())], SEQUENCE)


SEQUENCE = pa.schema([("seq", pa.int64()), ("length", pa.int64()), ("members", pa.int64()), ("ends", pa.string())])
SWEPT = pa.schema([*[(c, pa.int64()) for c in NODE[:-1]], ("ends_sha256", pa.string()), ("is_head", pa.bool_())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def distinct_sequences(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """(seq, length, members, ends): smallest member, number of members and hash of the sorted member ids of each sequence.

    Members of one sequence meet as slim rows in one sorted stream, as their ids are hashed in order; nothing is gathered.
    """
    names = rows.select("conv_id", *_marks()).groupBy("conv_id").agg(*_xor())
    named = lengths.join(names, "conv_id", "left").fillna(0, ["x1", "x2"])
    by = ["length", "x1", "x2"]
    return named.repartition(*by).sortWithinPartitions(*by, "conv_id").mapInArrow(
        _sequences_of, "seq bigint, length bigint, members bigint, ends string")


def burst(rows: DataFrame, sequences: DataFrame, container_rows: int) -> DataFrame:
    """The sequences with their heads: `head` turns deep, named (x1, x2); a container has at most `container_rows` turns below its head."""
    key, head, step = ["head", "x1", "x2"], 0, 1
    zero = F.lit(0).cast("bigint")
    todo, done = sequences.select("*", zero.alias("head"), zero.alias("x1"), zero.alias("x2")), []
    while True:
        large = stored(todo.groupBy(*key).agg(F.sum(F.col("length") - F.col("head")).alias("_rows"), F.count("*").alias("_n"))
                       .where((F.col("_rows") > container_rows) & (F.col("_n") > 1)).select(*key))
        done.append(todo.join(large, key, "left_anti"))
        if large.isEmpty():
            break
        todo = todo.join(large, key, "left_semi")
        band = rows.where((F.col("depth") > head) & (F.col("depth") <= head + step)).select(F.col("conv_id").alias("seq"), *_marks())
        moved = band.join(todo.select("seq"), "seq").groupBy("seq").agg(*_xor())
        head, step = head + step, step * 2
        todo = stored(todo.join(moved.withColumnsRenamed({"x1": "_y1", "x2": "_y2"}), "seq", "left").select(
            *sequences.columns, F.least("length", F.lit(head)).cast("bigint").alias("head"),
            *[F.col(f"x{i}").bitwiseXOR(F.coalesce(f"_y{i}", F.lit(0))).alias(f"x{i}") for i in (1, 2)]))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _close(stack: list, nodes: list, down_to: int) -> None:
    """Finish the nodes deeper than `down_to` turns below the head."""
    while len(stack) > down_to + 1:
        at = stack.pop()
        node = nodes[at]
        if not node["children"]:
            node["leaves"] = 1
        node["saved"] += (node["n"] - 1) * node["words"]
        up = nodes[stack[-1]]
        up["n"] += node["n"]
        up["conv"] = min(up["conv"], node["conv"])
        up["children"] += 1
        up["leaves"] += node["leaves"]
        up["saved"] += node["saved"]


def sweep(suffixes: list[tuple[list, list, int, int, str]]) -> list[dict]:
    """Nodes of one container from (turn ids, words, conversation, members, hash of ends); the first one is the head itself."""
    suffixes.sort(key=lambda s: s[0])
    new = {"n": 0, "children": 0, "leaves": 0, "saved": 0, "ends": None}
    nodes: list[dict] = [new | {"depth": 0, "conv": suffixes[0][2], "words": 0, "up": None}]
    stack, before = [0], []
    for ids, words, conv, members, ends in suffixes:
        common = 0
        for a, b in zip(before, ids):
            if a != b:
                break
            common += 1
        _close(stack, nodes, common)
        for depth in range(common, len(ids)):
            nodes.append(new | {"depth": depth + 1, "conv": conv, "words": words[depth], "up": stack[-1]})
            stack.append(len(nodes) - 1)
        last = nodes[stack[-1]]
        last["n"] += members
        last["conv"] = min(last["conv"], conv)
        last["ends"] = ends
        before = ids
    _close(stack, nodes, 0)
    return nodes


def _nodes_of(frames) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (head, x1, x2, seq, depth) to nodes; one container is held at a time."""
    key, head_conv, suffixes, seq = None, 0, [], None

    def finished() -> list[tuple]:
        out, nodes = [], sweep(suffixes)
        for x in nodes[1:]:
            parent = nodes[x["up"]]["conv"] if x["up"] else head_conv
            out.append((x["conv"], key[0] + x["depth"], parent, x["n"], x["children"], x["leaves"], x["saved"], x["ends"] or NO_ENDS, False))
        top = nodes[0]
        out.append((head_conv, key[0], None, top["n"], top["children"], top["leaves"], top["saved"], None, True))
        return out

    for batch in frames:
        out: list[tuple] = []
        columns = [batch.column(c).to_pylist() for c in ("head", "x1", "x2", "head_conv", "seq", "turn_id", "n_words", "members", "ends")]
        for h, x1, x2, conv, s, turn, words, members, ends in zip(*columns):
            if (h, x1, x2) != key:
                if key is not None:
                    out += finished()
                key, head_conv, suffixes, seq = (h, x1, x2), conv, [], None
            if s != seq:
                suffixes.append(([], [], s, members, ends))
                seq = s
            suffixes[-1][0].append(turn)
            suffixes[-1][1].append(words)
        yield _batch(out, SWEPT)
    if key is not None:
        yield _batch(finished(), SWEPT)


def _running(df: DataFrame, key: str, place: str, what: dict[str, tuple[str, str]], backwards: bool = False) -> DataFrame:
    """Add running aggregates (name: (function, column)) by place within a key; blocks of places first, then inside each block.

    A key's window sees one row per block, so no window holds a key's rows.
    """
    block, sign = F.floor(F.col(place) / BLOCK).alias("_block"), (-1 if backwards else 1)
    cut = df.withColumn("_block", block)
    sums = cut.groupBy(key, "_block").agg(*[F.expr(f"{f}({c})").alias(f"_t_{n}") for n, (f, c) in what.items()])
    over = Window.partitionBy(key).orderBy(F.col("_block") * sign).rowsBetween(Window.unboundedPreceding, -1)
    earlier = sums.select(key, "_block", *[F.coalesce(F.expr(f"{f}(_t_{n})").over(over), F.lit(0)).alias(f"_e_{n}") for n, (f, _) in what.items()])
    within = Window.partitionBy(key, "_block").orderBy(F.col(place) * sign).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.join(earlier, [key, "_block"])
    for n, (f, c) in what.items():
        local, shift = F.expr(f"{f}({c})").over(within), F.col(f"_e_{n}")
        out = out.withColumn(n, local.bitwiseXOR(shift) if f == "bit_xor" else local + shift)
    return out.drop("_block", *[f"_e_{n}" for n in what])


def _chains(rows: DataFrame, alone: DataFrame) -> DataFrame:
    """Nodes of the containers with one suffix."""
    below = rows.withColumnRenamed("conv_id", "seq").join(alone.where("length > head").select("seq", "length", "members", "ends", "head"), "seq") \
        .where("depth > head").withColumn("_saves", (F.col("members") - 1) * F.col("n_words"))
    single = below.where("members = 1").withColumn("saved_tokens", F.lit(0).cast("bigint"))
    copies = _running(below.where("members > 1"), "seq", "depth", {"saved_tokens": ("sum", "_saves")}, backwards=True)
    last = F.col("depth") == F.col("length")
    return single.unionByName(copies).select(
        F.col("seq").alias("conv_id"), "depth", F.col("seq").alias("parent_conv_id"), F.col("members").alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("bigint").alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"), "saved_tokens",
        F.when(last, F.col("ends")).otherwise(NO_ENDS).alias("ends_sha256"))


def _heads(rows: DataFrame, containers: DataFrame) -> DataFrame:
    """Nodes of the heads' trie from the containers (head_conv, head, members, ends, below, leaves, saved)."""
    steps = rows.withColumnRenamed("conv_id", "head_conv").join(containers, "head_conv").where("depth <= head") \
        .select("head_conv", "depth", "n_words", *_marks())
    zero = F.lit(0).cast("bigint")
    root = containers.select("head_conv", zero.alias("depth"), zero.alias("n_words"), zero.alias("x1"), zero.alias("x2"))
    named = _running(steps, "head_conv", "depth", {"x1": ("bit_xor", "m1"), "x2": ("bit_xor", "m2")}).drop("m1", "m2").unionByName(root)
    paths = stored(named.join(containers, "head_conv"))
    at_end, node = F.col("depth") == F.col("head"), ["depth", "x1", "x2"]
    nodes = stored(paths.groupBy(*node).agg(
        F.sum("members").alias("n_convs"), F.min("head_conv").alias("conv_id"), F.max("head").alias("deepest"),
        F.max(F.when(at_end, F.col("ends"))).alias("ends_sha256")))
    top = nodes.where("depth = 0").first()  # every path passes the root: it joins as constants
    if top is None:
        return nodes.select("conv_id", "depth", zero.alias("parent_conv_id"), "n_convs", *[zero.alias(c) for c in NODE[4:7]], "ends_sha256")
    at_root = paths.where("depth = 0").select(
        "*", F.lit(top["n_convs"]).alias("n_convs"), F.lit(top["conv_id"]).alias("conv_id"), F.lit(top["deepest"]).alias("deepest"),
        F.lit(top["ends_sha256"]).cast("string").alias("ends_sha256"))
    joined = paths.where("depth > 0").join(nodes.where("depth > 0"), node).unionByName(at_root)
    owner = F.col("conv_id") == F.col("head_conv")
    joined = stored(joined.withColumn("_adds", F.when(owner, (F.col("n_convs") - 1) * F.col("n_words")).otherwise(0)
                                      + F.when(at_end, F.col("saved")).otherwise(0)))
    alone = F.when(F.col("leaves") > 0, F.col("leaves")).when(F.col("deepest") == F.col("head"), 1).otherwise(0)
    path = joined.groupBy("head_conv").agg(
        F.min(F.when(owner, F.col("depth"))).alias("_top"), F.max_by(F.when(~owner, F.col("conv_id")), F.when(~owner, F.col("depth"))).alias("_above"),
        F.max(F.when(at_end, alone)).alias("_leaves"))
    sums = _running(joined, "head_conv", "depth", {"_saved": ("sum", "_adds")}, backwards=True).join(path, "head_conv")
    child = (F.col("depth") < F.col("head")) & (F.col("depth") + 1 >= F.col("_top"))
    return sums.groupBy(*node).agg(
        F.min("conv_id").alias("conv_id"), F.max("n_convs").alias("n_convs"), F.max("ends_sha256").alias("ends_sha256"),
        F.max(F.when(owner, F.when(F.col("depth") > F.col("_top"), F.col("head_conv")).otherwise(F.col("_above")))).alias("parent_conv_id"),
        (F.sum(child.cast("bigint")) + F.max(F.when(at_end, F.col("below")).otherwise(0))).alias("n_children"),
        F.sum("_leaves").alias("n_leaves"), F.sum("_saved").alias("saved_tokens")) \
        .select(*NODE[:-1], F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))


def prefix_trie(rows: DataFrame, lengths: DataFrame, container_rows: int = CONTAINER_ROWS) -> DataFrame:
    """Nodes (columns NODE) of the trie of sequences given as `rows` (conv_id, depth from 1, turn_id, n_words) and `lengths` (conv_id, length)."""
    rows, lengths = stored(rows), stored(lengths)
    heads = stored(burst(rows, stored(distinct_sequences(rows, lengths)), container_rows))
    key = ["head", "x1", "x2"]
    containers = stored(heads.groupBy(*key).agg(
        F.min("seq").alias("head_conv"), F.sum("members").alias("members"), F.count("*").alias("suffixes"), F.max("length").alias("longest"),
        F.max(F.when(F.col("length") == F.col("head"), F.col("ends"))).alias("ends")))
    info = stored(heads.join(containers.select(*key, "head_conv", "suffixes"), key))
    alone = info.where("suffixes = 1")
    shared = rows.withColumnRenamed("conv_id", "seq").join(info.where("suffixes > 1 AND length > head"), "seq").where("depth > head") \
        .withColumn("ends", F.when(F.col("depth") == 1 + F.col("head"), F.col("ends")))
    swept = stored(shared.select(*key, "head_conv", "seq", "depth", "turn_id", "n_words", "members", "ends")
                   .repartition(*key).sortWithinPartitions(*key, "seq", "depth")
                   .mapInArrow(_nodes_of, ", ".join([*[f"{c} bigint" for c in NODE[:-1]], "ends_sha256 string", "is_head boolean"])))
    extra = rows.withColumnRenamed("conv_id", "seq").join(alone.where("members > 1 AND length > head").select("seq", "members", "head"), "seq") \
        .where("depth > head").groupBy("seq").agg(F.sum((F.col("members") - 1) * F.col("n_words")).alias("_saved"))
    chain = (F.col("suffixes") == 1) & (F.col("longest") > F.col("head"))
    totals = swept.where("is_head").select(F.col("conv_id").alias("head_conv"), "n_children", "n_leaves", "saved_tokens")
    containers = containers.join(totals, "head_conv", "left").join(extra.withColumnRenamed("seq", "head_conv"), "head_conv", "left").select(
        "head_conv", "head", "members", "ends", F.when(chain, 1).otherwise(F.coalesce("n_children", F.lit(0))).cast("bigint").alias("below"),
        F.when(chain, 1).otherwise(F.coalesce("n_leaves", F.lit(0))).cast("bigint").alias("leaves"),
        F.coalesce("saved_tokens", "_saved", F.lit(0)).cast("bigint").alias("saved"))
    return swept.where("not is_head").select(*NODE).unionByName(_chains(rows, alone)).unionByName(_heads(rows, stored(containers)))


def conversation_trie(turns: DataFrame, family: int = 20, borrowed: Column | None = None, container_rows: int = CONTAINER_ROWS) -> DataFrame:
    """Nodes of the trie of `turns` (conv_id, turn, role, text), each conversation taking its first turns from its family's first one.

    `borrowed` is the number of turns taken; without it a conversation keeps its own.
    """
    numbered = stored(numbered_turns(turns))
    return prefix_trie(*regrafted(numbered, family, F.lit(0) if borrowed is None else borrowed), container_rows)
