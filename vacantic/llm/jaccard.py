"""Exact Jaccard join of word n-gram sets through group counts.

A document is the set of its distinct n-grams (64-bit hashes).  Hashing n-grams into groups turns it into a point:
its number of n-grams per group.  The overlap of two sets is at most the sum of the smaller coordinates.

Points of unrelated texts of one length lie at nearly the same distance from each other, so the boxes of one tree over
all points would not separate them.  The points are therefore dealt out first, without loss: similar sets differ in at
most d n-grams, so among d + 1 non-empty groups at least one is identical in both.  Each set is listed under the
content of its first d + 1 non-empty groups; only sets that share an entry meet.  Sizes fall into classes by powers of
two; a set is listed in its own class, and in all those below where a smaller partner may be.

* Of each entry, the smallest set is compared with all others (a star, never all pairs), and linked sets are merged.
* Entries that still hold several components get a tree of boxes over their points (leaves of neighbouring points with
  their largest coordinates).  Boxes and then points whose bound is too low are left out; every set asks for its most
  promising partner in another component.  This repeats, with the entries that had one, until no bound leaves a pair open; after `rounds` turns all open
  pairs are asked at once.  So every linked pair is either compared or already in one component.
* Asked pairs that their points leave open are verified on the sets themselves; the texts of these, and no others, travel to
  the asked set, in portions of bounded size.

Defined results: null text and text without words are empty sets, linked with nothing; a text with fewer words than n has
one n-gram, all its words; equal sets are one node, whatever their number; null ids are allowed; repeated rows each get
a row; other columns are not carried.
"""

from __future__ import annotations

import re
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vacantic.functions.text import small_batches
from vacantic.llm.common import exact_id, free_name, mix64, nullable_ids, scope, sifted, stored
from vacantic.llm.components import components, in_blocks

GROUPS = 256  # coordinates of a point
FULL = 255  # stands for this count and all larger ones
LEAF = 32  # points of a leaf
BLOCK = 512  # rows of an entry that meet in one task
PORTION = 500  # sets that are compared with one asked set in one task
RECENT = 1 << 24  # bytes of sets that a task remembers
CHUNK = 1 << 20  # bytes of a text that are hashed at once
PLACES = 64  # places within a word with random numbers of their own
RANDOM = mix64(np.arange(1, 256 * PLACES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))  # by place and byte
WORD_BYTE = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])
_BLANK = re.compile(rb"[\t-\r ]")


def _hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of some bytes: the sum of a random number for each byte at each place, mixed."""
    inside = WORD_BYTE[data]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    if not len(edges):
        return np.zeros(0, np.uint64)
    lens = edges[1::2] - edges[::2]
    first = np.cumsum(lens) - lens
    letters = data[inside]
    place = np.arange(len(letters)) - np.repeat(first, lens)
    terms = RANDOM[((place % PLACES) << 8) + letters]
    if lens.max() > PLACES:
        far = np.flatnonzero(place >= PLACES)
        with np.errstate(over="ignore"):
            terms[far] = mix64(terms[far] + (place[far] // PLACES).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return mix64(np.add.reduceat(terms, first))


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words, capitals A-Z as small letters."""
    data, out, start = text.encode("utf-8", "surrogatepass").lower(), [], 0
    while start < len(data):
        blank = _BLANK.search(data, start + CHUNK) if len(data) - start > CHUNK else None
        end = blank.start() if blank else len(data)
        out.append(_hashes(np.frombuffer(data, np.uint8, end - start, start)))
        start = end
    return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(text, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of the words."""
    h = word_hashes(text) if text else np.zeros(0, np.uint64)
    if not len(h):
        return h
    size = min(n, len(h))
    count, out = len(h) - size + 1, np.full(1, size, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[j:j + count]
    out = np.sort(mix64(out))
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def set_key(s: np.ndarray) -> int:
    """64-bit identity of a set."""
    import xxhash
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


def point(s: np.ndarray) -> np.ndarray:
    """Number of n-grams per group, one byte each."""
    counts = np.bincount((mix64(s ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(56)).astype(np.int64), minlength=GROUPS)
    return np.minimum(counts, FULL).astype(np.uint8)


def read_points(column, sizes: np.ndarray) -> np.ndarray:
    """Points as a matrix; a count that is FULL or more is replaced by the size of the set, which is never less."""
    points = np.frombuffer(b"".join(column), dtype=np.uint8).reshape(-1, GROUPS).astype(np.int32)
    return np.where(points == FULL, np.asarray(sizes)[:, None], points)


def least_overlap(a, b, percent: int):
    """Smallest intersection with 100 * intersection >= percent * union."""
    return -((-percent * (a + b)) // (100 + percent))


def entries(s: np.ndarray, percent: int) -> np.ndarray:
    """Keys under which a set is listed."""
    n, out = len(s), []
    own = n.bit_length() - 1
    for c in range((-(-percent * n // 100)).bit_length() - 1, own + 1):
        top = (1 << (c + 1)) - 1  # largest size of the class
        partner = 100 * n // percent if c == own else top
        d = (100 - percent) * (n + partner) // (100 + percent)
        if not d:
            continue  # only equal sets are similar
        most = (100 - percent) * (top + 100 * top // percent) // (100 + percent)
        m = most + most // 8 + 2
        g = mix64(s + np.uint64(0xA0761D6478BD642F)) % np.uint64(m)
        order = np.argsort(g, kind="stable")
        sorted_g = g[order]
        first = np.flatnonzero(np.concatenate(([True], sorted_g[1:] != sorted_g[:-1])))
        with np.errstate(over="ignore"):
            content = np.add.reduceat(mix64(s[order] ^ np.uint64(0xE7037ED1A0B428DB)), first)
        ids = sorted_g[first]
        if len(ids) > d:
            ids, content = ids[:d + 1], content[:d + 1]
        else:  # too few groups are filled: the empty ones count as well
            every = np.arange(m, dtype=np.uint64)
            full = np.zeros(m, dtype=np.uint64)
            full[ids.astype(np.int64)] = content
            ids, content = every, full
        with np.errstate(over="ignore"):
            out.append(mix64(content + mix64(ids + np.uint64(c + 1) * np.uint64(1 << 40))))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _members(rows: DataFrame, n: int) -> DataFrame:
    def run(frames):
        for pdf in frames:
            sets = [shingles(t, n) for t in pdf["text"]]
            yield pd.DataFrame({"id": nullable_ids(pdf["id"], pdf["no_id"]), "mark": pdf["mark"].array, "node": [set_key(s) for s in sets],
                                "n": [len(s) for s in sets]})
    return rows.mapInPandas(run, "id bigint, mark bigint, node bigint, n bigint")


def _listed(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """(entry, node) of every set; equal sets of a partition are listed once."""
    def run(frames):
        seen = set()
        for pdf in frames:
            keys, nodes, size = [], [], 0
            for t in pdf["text"]:
                s = shingles(t, n)
                node = set_key(s)
                if len(s) and node not in seen:
                    seen.add(node)
                    e = entries(s, percent)
                    keys.append(e)
                    nodes.append(np.full(len(e), node))
                    size += len(e)
                if size > 100_000:
                    yield pd.DataFrame({"entry": np.concatenate(keys).view(np.int64), "node": np.concatenate(nodes)})
                    keys, nodes, size = [], [], 0
            if size:
                yield pd.DataFrame({"entry": np.concatenate(keys).view(np.int64), "node": np.concatenate(nodes)})
    return rows.mapInPandas(run, "entry bigint, node bigint")


def _sets(rows: DataFrame, chosen: DataFrame, n: int) -> DataFrame:
    """(node, n, point) of the nodes in `chosen` (id, node), once each; texts stay where they are read."""
    def run(frames):
        seen = set()
        for pdf in frames:
            out = []
            for text in pdf["text"]:
                s = shingles(text, n)
                node = set_key(s)
                if node not in seen:
                    seen.add(node)
                    out.append((node, len(s), point(s).tobytes()))
            if out:
                yield pd.DataFrame(out, columns=["node", "n", "point"])

    near = sifted(rows, chosen.select(F.coalesce("id", F.lit(0)).alias("id")), "id")  # other texts need no points
    points = near.select("text").mapInPandas(run, "node bigint, n bigint, point binary")
    return points.join(chosen.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])


def _texts(rows: DataFrame, chosen: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of `nodes`, from the rows that `chosen` (node, id, mark) names."""
    wanted = chosen.join(nodes, "node", "left_semi").select(
        F.coalesce("id", F.lit(0)).alias("k"), F.col("id").isNull().alias("no_k"), F.col("mark").alias("m"), "node")
    near = sifted(rows, wanted.select(F.col("k").alias("id")), "id")  # other texts need not travel
    same = (near["id"] == wanted["k"]) & (near["no_id"] == wanted["no_k"]) & (near["mark"] == wanted["m"])
    return near.join(wanted, same).select("node", "text").dropDuplicates(["node"])


def _possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose summed smaller coordinates reach the needed overlap."""
    slim = sets.select("node", "n", "point")
    left = slim.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("point").alias("p_a"))
    right = slim.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("point").alias("p_b"))

    def run(frames):
        for pdf in frames:
            if len(pdf):
                n_a, n_b = pdf["n_a"].to_numpy(), pdf["n_b"].to_numpy()
                bound = np.minimum(read_points(pdf["p_a"], n_a), read_points(pdf["p_b"], n_b)).sum(axis=1)
                need = least_overlap(n_a, n_b, percent)
                yield pdf.loc[bound >= need, ["a", "b"]]
    return pairs.join(left, "a").join(right, "b").mapInPandas(run, "a bigint, b bigint")


def _verify(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The linked ones of pairs (a, b).  Each a's text, shorter than its set, travels to b's portion, where b's text comes first."""
    sizes = pairs.groupBy("b").agg(F.ceil(F.count("*") / PORTION).cast("int").alias("portions"))
    asked = pairs.join(sizes, "b").withColumn("portion", F.pmod(F.xxhash64("a"), "portions").cast("int"))
    guests = asked.join(texts, asked["a"] == texts["node"]).select("b", "portion", F.lit(1).alias("part"), "a", "text")
    hosts = sizes.join(texts, sizes["b"] == texts["node"]).select(
        "b", F.explode(F.sequence(F.lit(0), F.col("portions") - 1)).alias("portion"), F.lit(0).alias("part"), F.col("b").alias("a"), "text")

    def run(frames):
        host, own, recent, size = None, np.zeros(0, np.uint64), {}, 0
        for pdf in frames:
            out = []
            for b, part, a, text in zip(pdf["b"], pdf["part"], pdf["a"], pdf["text"]):
                s = recent.get(a)
                if s is None:
                    s = shingles(text, n)
                    if size + s.nbytes > RECENT:
                        recent, size = {}, 0
                    recent[a], size = s, size + s.nbytes
                if part == 0:
                    host, own = b, s
                elif b == host:
                    at = np.searchsorted(own, s)
                    at[at == len(own)] = 0
                    both = int((own[at] == s).sum()) if len(own) else 0
                    if 100 * both >= percent * (len(own) + len(s) - both):
                        out.append((a, b))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
    return hosts.unionByName(guests).repartition("b", "portion").sortWithinPartitions("b", "portion", "part").mapInPandas(run, "a bigint, b bigint")


def tree_candidates(nodes: np.ndarray, labels: np.ndarray, sizes: np.ndarray, points: np.ndarray, own: np.ndarray, i: int, j: int,
                    asked: list, percent: int, all_pairs: bool) -> list[tuple[int, int]]:
    """Pairs of different components that the bound leaves open: of each point the best one, or all of them.

    Leaves hold neighbouring points (by size, then by coordinates) with their largest coordinates; a pair of leaves
    is opened only if the bound of their boxes reaches the least overlap that their sizes allow.
    """
    order = np.lexsort((points[:, 1], points[:, 0], sizes))
    leaves = [order[x:x + LEAF] for x in range(0, len(order), LEAF)]
    boxes = np.array([points[x].max(axis=0) for x in leaves])
    least = np.array([sizes[x].min() for x in leaves])
    best: dict[int, tuple[int, int]] = {}
    found: list[tuple[int, int]] = []
    for u, x in enumerate(leaves):
        bounds = np.minimum(boxes[u:], boxes[u]).sum(axis=1)
        for v in u + np.flatnonzero(bounds >= least_overlap(least[u:], least[u], percent)):
            y = leaves[v]
            bound = np.minimum(points[x][:, None], points[y][None]).sum(axis=2)
            spare = bound - least_overlap(sizes[x][:, None], sizes[y][None], percent)
            meet = ((own[x] == i)[:, None] & (own[y] == j)[None]) | ((own[x] == j)[:, None] & (own[y] == i)[None])
            for p, q in np.argwhere((spare >= 0) & meet & (labels[x][:, None] != labels[y][None])):
                if u == v and p >= q:
                    continue
                a, b = x[p], y[q]
                if nodes[b] in asked[a] or nodes[a] in asked[b]:
                    continue
                if all_pairs:
                    found.append((int(nodes[a]), int(nodes[b])))
                    continue
                for one, two in ((a, b), (b, a)):
                    if one not in best or spare[p, q] > best[one][0]:
                        best[one] = (int(spare[p, q]), int(nodes[two]))
    return found + [(int(nodes[a]), b) for a, (_, b) in best.items()]


def _open_pairs(listed: DataFrame, labels: DataFrame, tested: DataFrame, sets: DataFrame, percent: int, all_pairs: bool) -> DataFrame:
    """(entry, a, b): untested pairs, a asks b, of different components in one entry."""
    named = listed.join(labels.withColumnRenamed("component", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    w = Window.partitionBy("entry")
    mixed = named.withColumn("_low", F.min("label").over(w)).withColumn("_high", F.max("label").over(w)).where("_low < _high").drop("_low", "_high")
    asked = tested.groupBy("a").agg(F.collect_set("b").alias("asked")).withColumnRenamed("a", "node")
    rows = in_blocks(mixed, "entry", "node", BLOCK).join(sets.select("node", "n", "point"), "node").join(asked, "node", "left")

    def run(frames):
        def stream():
            for pdf in frames:
                yield from zip(pdf["entry"], pdf["_i"], pdf["_j"], pdf["node"], pdf["label"], pdf["n"], pdf["point"], pdf["_own"], pdf["asked"])
        out = []
        for (entry, i, j), group in groupby(stream(), key=lambda r: r[:3]):
            cols = list(zip(*group))
            if len(set(cols[4])) > 1:
                found = tree_candidates(np.array(cols[3]), np.array(cols[4]), np.array(cols[5]), read_points(cols[6], np.array(cols[5])), np.array(cols[7]), i, j,
                                        [set() if x is None else set(x) for x in cols[8]], percent, all_pairs)
                out += [(entry, a, b) for a, b in found]
            if len(out) > 50_000:
                yield pd.DataFrame(out, columns=["entry", "a", "b"], dtype="int64")
                out = []
        yield pd.DataFrame(out, columns=["entry", "a", "b"], dtype="int64")

    return rows.repartition("entry", "_i", "_j").sortWithinPartitions("entry", "_i", "_j").mapInPandas(run, "entry bigint, a bigint, b bigint")


def join_components(docs: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", rounds: int = 4) -> DataFrame:
    """(key, n_shingles, component_id) of every row: size of its set, and the smallest key that links reach."""
    if not 0 < percent <= 100:
        raise ValueError("percent is a share of 1 to 100")
    small_batches()
    with scope(docs.sparkSession) as keep:
        rows = docs.select(*exact_id(key), F.xxhash64(F.col(f"`{text}`")).alias("mark"), F.col(f"`{text}`").alias("text"))
        members = stored(_members(rows, n))
        w = Window.partitionBy("entry")
        listed = stored(_listed(rows, n, percent).withColumn("hub", F.min("node").over(w)).withColumn("_high", F.max("node").over(w))
                        .where("hub < _high").drop("_high").distinct())
        # the nodes that share an entry: one row (id, hash of its text) stands for all equal sets
        chosen = stored(members.join(listed.select("node").distinct(), "node", "left_semi").groupBy("node")
                        .agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("first")).select("node", "first.id", "first.mark"))
        sets = stored(_sets(rows, chosen, n))
        tested = links = None
        labels = None
        for turn in range(rounds + 2):
            if labels is None:
                asked = listed.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
            else:
                # an entry that leaves no pair open now leaves none later: components only grow
                found = stored(_open_pairs(listed, labels, tested, sets, percent, all_pairs=turn > rounds))
                asked = found.select("a", "b").distinct()
            asked = stored(asked)
            if asked.isEmpty():
                break
            if labels is not None:
                listed = stored(listed.join(found.select("entry").distinct(), "entry", "left_semi"))
                # points of other nodes are not asked for any more, and need not travel
                left = stored(listed.select("node").distinct())
                sets = stored(sifted(sets, left, "node").join(left, "node", "left_semi"))
            likely = stored(_possible(asked, sets, percent))
            texts = stored(_texts(rows, chosen, likely.select(F.explode(F.array("a", "b")).alias("node")).distinct()))
            good = stored(_verify(likely, texts, n, percent))
            tested = asked if tested is None else tested.union(asked)
            links = good if links is None else links.union(good)
            labels = stored(components(links))
        if labels is None:
            labels = members.select("node", F.col("node").alias("component")).limit(0)
        named = members.where("n > 0").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        least = named.groupBy("component").agg(F.min("id").alias("component_id"))
        linked = named.join(least, "component").select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id")
        return keep(linked.unionByName(members.where("n = 0").select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, that of the smallest key (nulls last), and all rows with an empty set; columns stay as they are.

    Rows are told apart by a 64-bit hash of key and text, so keys may be null, repeat, or stand on different texts.  Of rows
    with the same key the one with the smallest hash of its text stays, of equal texts any one.  Only rows that go, or
    that stand several times, move.
    """
    tag, same, component, gone, copy = (free_name(docs, f"_{x}") for x in ("tag", "same", "component", "gone", "copy"))
    own, words = F.col(f"`{key}`"), F.col(f"`{text}`")
    tagged = docs.withColumn(tag, F.xxhash64(own.isNull(), own, words.isNull(), words))
    with scope(docs.sparkSession) as keep:
        found = stored(join_components(tagged.select(tag, words.alias(text)), n, percent, tag, text).where("n_shingles > 0")
                       .groupBy(F.col("component_id").alias(component), F.col(tag).alias(same)).agg(F.count("*").alias("copies")))
        marks = tagged.select(tag, own.alias("key"), F.xxhash64(words).alias("hash")).distinct()
        first = found.join(marks, F.col(same) == F.col(tag)).groupBy(component) \
            .agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "hash", F.col(tag).alias("row"))).alias("first"), F.sum("copies").alias("rows")) \
            .where("rows > 1").select(component, "first.row")
        grouped = found.join(first, component).select(F.col(same).alias(tag), (F.col(same) != F.col("row")).alias(gone), "copies")
        others = keep(grouped.where(gone).select(tag, gone))
        repeated = keep(grouped.where(~F.col(gone) & (F.col("copies") > 1)).select(tag, gone))
    fate = others.union(repeated)
    doubtful = sifted(tagged, fate, tag).join(fate.withColumnRenamed(tag, same), F.col(tag) == F.col(same), "left") \
        .where(F.col(gone).isNull() | ~F.col(gone)) \
        .withColumn(copy, F.when(F.col(same).isNull(), F.monotonically_increasing_id()).otherwise(F.lit(0))).dropDuplicates([tag, copy])
    names = [F.col(f"`{c}`") for c in docs.columns]
    return sifted(tagged, fate, tag, rest=True).select(*names).union(doubtful.select(*names))
