"""Chat, scores, joins, repeated windows and the pipeline against brute force and edge cases."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vacantic.llm import chat, components, jaccard, lmscore, pivots, substrings

ODD = [None, "", " ", "\n", "a", "a", "A", "a b c", "漢字 x"]


def docs(spark, texts, **more):
    rows = [(i, t, *more.values()) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, ", ".join(["doc_id bigint", "text string", *[f"{n} string" for n in more]]))


def words(text):
    return (text or "").encode().split()


# --- chat --------------------------------------------------------------------------------------
def test_snapshots_collapse(spark):
    a = [(0, "user", "hi"), (1, "bot", "hello"), (2, "user", "bye")]
    logs = {1: a[:1], 2: a[:2], 3: a, 4: a, 5: [(0, "user", None)], 6: [(0, "user", "")], 7: a[:2] + [(2, "user", "else")],
            8: [(5, "user", "hi"), (9, None, "x")], None: [(0, "user", "nobody"), (1, "bot", "?")], 9: [(1, "user", "hi"), (1, "user", "hi")]}
    rows = [(c, t, r, x, "extra") for c, turns in logs.items() for t, r, x in turns]
    random.Random(1).shuffle(rows)
    got = {r.conv_id: (r.n_turns, r.rendered) for r in chat.collapse(
        spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, n string")).collect()}
    assert set(got) == {3, 5, 6, 7, 8, None}  # 1, 2 and 9 are prefixes, 4 equals 3
    assert got[3] == (3, "<|im_start|>user\nhi<|im_end|>\n<|im_start|>bot\nhello<|im_end|>\n<|im_start|>user\nbye<|im_end|>\n")
    assert got[8][1] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>\nx<|im_end|>\n" and got[None][0] == 2
    assert chat.collapse(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


def test_turns_as_rows(spark):
    rows = [(None, i, "user", f"t{i}") for i in range(300)] + [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "bot", None)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {(r.conv_id, r.n): r.text for r in chat.rendered_turns(table).collect()}
    assert len(got) == 302 and got[None, 300] == "<|im_start|>user\nt299<|im_end|>\n" and got[2, 2] == "<|im_start|>bot\n<|im_end|>\n"
    for r in chat.collapse(table).collect():
        assert r.rendered == "".join(got[r.conv_id, n + 1] for n in range(r.n_turns))


# --- scores ------------------------------------------------------------------------------------
def plain_scores(texts, target, weight):
    grams = [[("   " + (t or ""))[i:i + 4] for i in range(len(t or ""))] for t in texts]
    full, ctx, one = ([Counter(), Counter()] for _ in range(3))
    for i, g in enumerate(grams):
        m = 0 if i in target else 1
        full[m].update(g), ctx[m].update(x[:3] for x in g), one[m].update(x[3] for x in g)
    vocabulary = len(set(one[0]) | set(one[1]))
    loss = lambda m, x: -math.log((full[m][x] + weight * (one[m][x[3]] + 1) / (sum(one[m].values()) + vocabulary)) / (ctx[m][x[:3]] + weight))
    return [tuple(sum(loss(m, x) for x in g) / len(g) for m in (0, 1)) if g else None for g in grams]


@pytest.mark.parametrize("target", [{0, 3, 9}, set()])
def test_scores_equal_plain_models(spark, target):
    rng = random.Random(1)
    texts = [*ODD, *["".join(rng.choice("abc é漢") for _ in range(rng.randint(1, 80))) for _ in range(40)]]
    chosen = spark.createDataFrame([(i,) for i in [*target, *target, 999, None]], "doc_id bigint")
    rows = {r.doc_id: r for r in lmscore.score(docs(spark, texts, score="old", block="x"), chosen, block_chars=300).collect()}
    assert len(rows) == len(texts)
    for i, want in enumerate(plain_scores(texts, target, 5.0)):
        r = rows[i]
        assert r.n_chars == len(texts[i] or "")
        if want is None:
            assert (r.loss_target, r.loss_background, r.score) == (None, None, None)
        else:
            assert abs(r.loss_target - want[0]) < 1e-9 and abs(r.loss_background - want[1]) < 1e-9 and abs(r.score - want[0] + want[1]) < 1e-9
    assert lmscore.score(docs(spark, []), chosen).count() == 0


# --- components --------------------------------------------------------------------------------
def union(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("task_links", [500_000, 40])
def test_components(spark, monkeypatch, task_links):
    monkeypatch.setattr(components, "TASK_LINKS", task_links)
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(300)] + [(rng.randint(1000, 1400), rng.randint(1000, 1400)) for _ in range(220)] + [(-5, x) for x in range(5000, 5200)] + [(7000, 7000)]
    rng.shuffle(pairs)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a bigint, b bigint").repartition(7)).collect()}
    assert got == {x: c for x, c in union(pairs).items() if x != c}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# --- n-gram join -------------------------------------------------------------------------------
def plain_join(texts, n, percent):
    lower = [[w.lower() for w in words(t)] for t in texts]
    sets = [{tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set() for w in lower]
    pairs = [(i, i) for i in range(len(texts))]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                pairs.append((j, i))
    return sets, union(pairs)


def edited(rng, text, share):
    return [rng.choice("pqrstuvw") if rng.random() < share else w for w in text]


@pytest.mark.parametrize("n, percent, rounds", [(4, 85, 4), (5, 80, 0), (2, 60, 4)])
def test_join_equals_all_pairs(spark, n, percent, rounds):
    rng = random.Random(percent)
    texts = list(ODD)
    for size in (3, 6, 12, 40, 90, 130):
        base = [f"w{rng.randint(0, 400)}" for _ in range(size)]
        for _ in range(22):  # around the threshold, so that many pairs miss it while a third one links them
            texts.append(" ".join(edited(rng, base, rng.choice((0, 0.01, 0.02, 0.04, 0.08))) + [f"x{rng.randint(0, 9)}"] * rng.randint(0, 2)))
    texts += [texts[30].upper(), texts[30], texts[60] + " tail"]
    sets, want = plain_join(texts, n, percent)
    rows = {r.doc_id: r for r in jaccard.join_components(docs(spark, texts, node="x").repartition(5), n, percent, rounds=rounds).collect()}
    assert len(rows) == len(texts)
    assert {i: (r.n_shingles, r.component_id) for i, r in rows.items()} == {i: (len(sets[i]), want[i]) for i in rows}
    kept = jaccard.keep_one(docs(spark, texts, node="x"), n, percent)
    assert kept.columns == ["doc_id", "text", "node"] and sorted(r.doc_id for r in kept.collect()) == sorted(i for i in want if want[i] == i)


def test_join_of_nothing_and_of_nulls(spark):
    assert jaccard.join_components(docs(spark, [])).count() == 0
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join_components(docs(spark, [None, "", "x y"])).collect()} == {(0, 0, 0), (1, 0, 1), (2, 1, 2)}
    rows = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, None)], "doc_id bigint, text string")
    assert sorted(str(r.component_id) for r in jaccard.join_components(rows).collect()) == ["4", "4", "4", "4", "None"]


def test_one_row_of_each_group_stays_whatever_its_key(spark):
    long = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcde"]
    rows = [(1, long[0]), (1, long[0]), (None, long[1]), (None, long[1]), (None, long[2]), (2, long[3]), (3, long[4]), (3, long[3] + " tail"), (None, None), (None, None),
            (7, long[1] + " end")]
    table = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(rows)], "doc_id bigint, text string, _row int").repartition(3)
    kept = jaccard.keep_one(table)
    assert kept.columns == table.columns
    got = sorted((str(r.doc_id), r.text or "") for r in kept.collect())
    assert got == sorted([("1", long[0]), ("7", long[1] + " end"), ("None", long[2]), ("2", long[3]), ("3", long[4]), ("None", ""), ("None", "")])
    assert {r.n_removed for r in substrings.drop_repeats(kept.select("doc_id", "text")).collect()} == {0}


def test_entries_of_similar_sets_meet():
    rng = np.random.default_rng(3)
    for percent in (60, 80, 85, 95):
        for _ in range(400):
            n = int(rng.integers(1, 200))
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            drop = int(rng.integers(0, max(1, len(a) // 4)))
            b = np.unique(np.concatenate((a[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, max(1, len(a) // 6)))).astype(np.uint64))))
            both = len(np.intersect1d(a, b))
            if len(b) and 100 * both >= percent * (len(a) + len(b) - both):
                assert np.array_equal(a, b) or set(jaccard.entries(a, percent)) & set(jaccard.entries(b, percent))
                assert np.minimum(*jaccard.read_points([jaccard.point(a).tobytes(), jaccard.point(b).tobytes()], [len(a), len(b)])).sum() >= both >= jaccard.least_overlap(len(a), len(b), percent)


def test_entries_meet_across_classes():
    rng = np.random.default_rng(4)
    for percent in (10, 25, 40):
        for _ in range(100):
            n = int(rng.integers(20, 120))
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            b = np.sort(rng.permutation(a)[:int(rng.integers(-(-percent * n // 100), n))])  # any share above percent
            assert set(jaccard.entries(a, percent)) & set(jaccard.entries(b, percent))


def test_tree_leaves_out_only_what_the_bound_excludes():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 6, (5, jaccard.GROUPS))
    points = np.maximum(0, base[rng.integers(0, 5, 150)] + rng.integers(-1, 2, (150, jaccard.GROUPS)) * (rng.random((150, 1)) < 0.6))
    sizes, labels, nodes = points.sum(axis=1), np.arange(150) // 2, np.arange(150)
    own = rng.integers(0, 2, 150)
    got = set(map(frozenset, jaccard.tree_candidates(nodes, labels, sizes, points, own, 0, 1, [{7}] * 150, 85, True)))
    want = {frozenset((a, b)) for a in range(150) for b in range(a) if own[a] != own[b] and labels[a] != labels[b] and 7 not in (a, b)
            and np.minimum(points[a], points[b]).sum() >= jaccard.least_overlap(int(sizes[a]), int(sizes[b]), 85)}
    assert got == want and len(want) > 50


# --- vectors -----------------------------------------------------------------------------------
def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 24))
    rows = [(i, (base[i % 60] + rng.normal(size=24) * 0.06 * (i % 3)).tolist(), "x") for i in range(240)]
    rows += [(1000 + i, rows[5][1], "x") for i in range(30)]
    odd = [None, [], [0.0] * 24, [float("nan")] + [1.0] * 23, [float("inf")] * 24, [None] + [1.0] * 23, [1.0] * 3]
    rows += [(2000 + i, v, "x") for i, v in enumerate(odd)] + [(3000, [1e-200] + [0.0] * 23, "x"), (3001, [1e200] + [0.0] * 23, "x"), (None, [0.0] * 23 + [2.0], "x")]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, n_links string")
    good = [(i, v) for i, v, _ in rows if i is None or i < 2000 or i >= 3000]
    u = pivots.unit(np.array([v for _, v in good]))
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    comp = union([(a, a) for a in range(len(good))] + [tuple(p) for p in np.argwhere(near)])
    want = {i: (int(near[a].sum()), min(x for x in (good[b][0] for b in comp if comp[b] == comp[a]) if x is not None) if i is not None else None) for a, (i, _) in enumerate(good)}
    for block in (1024, 8):
        got = {r.vec_id: (r.n_links, r.component_id) for r in pivots.near_duplicates(table, block=block).collect()}
        assert len(got) == len(rows) and all(got[2000 + i] == (0, 2000 + i) for i in range(len(odd)))
        right = sum(got[i] == want[i] for i in want)
        assert right >= 0.97 * len(want) and all(got[i][0] <= want[i][0] for i in want)
        assert got[3000] == (1, 3000) and got[3001] == (1, 3000) and got[None] == (0, None)
    assert pivots.near_duplicates(table.limit(0)).count() == 0
    assert [tuple(r) for r in pivots.near_duplicates(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.1])], "vec_id bigint, embedding array<double>")).orderBy("vec_id").collect()] \
        == [(1, 1, 1, True), (2, 1, 1, False)]


def test_recall_on_vectors_near_the_threshold(spark):
    rng = np.random.default_rng(6)
    a = pivots.unit(rng.normal(size=(1500, 64)))
    noise = rng.normal(size=a.shape)
    noise = pivots.unit(noise - (noise * a).sum(axis=1, keepdims=True) * a)
    cos = rng.uniform(0.9, 0.97, size=(1500, 1))
    b = cos * a + np.sqrt(1 - cos ** 2) * noise
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate((a, b)))], "vec_id bigint, embedding array<double>")
    found = pivots.near_duplicates(table).agg(F.sum("n_links")).first()[0] / 2
    assert found >= 0.95 * 1500


# --- repeated windows --------------------------------------------------------------------------
def plain_repeats(texts, width):
    lists = [words(t) for t in texts]
    count = Counter(tuple(w[i:i + width]) for w in lists for i in range(len(w) - width + 1))
    out = []
    for w in lists:
        gone = {p for i in range(len(w) - width + 1) if count[tuple(w[i:i + width])] > 1 for p in range(i, i + width)}
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


@pytest.mark.parametrize("width, m, bucket_rows", [(6, 3, 1000), (6, 3, 2), (6, 3, 1), (35, 8, 1000), (35, 8, 3), (35, 8, 12)])
def test_repeats_equal_brute_force(spark, width, m, bucket_rows):
    rng = random.Random(width)
    passage = [f"p{i}" for i in range(width + 9)]
    texts = [*ODD, "x " * 100, "a b " * 60]
    for i in range(60):
        w = [f"w{rng.randint(0, 9 if i % 5 == 0 else 3000)}" for _ in range(rng.randint(0, 90))]
        if i % 3 == 0:
            at, cut = rng.randint(0, len(w)), rng.choice((0, 0, 5, 12))
            w[at:at] = passage[:len(passage) - cut]
        texts.append(rng.choice((" ", "\n")).join(w))
    texts += [texts[20]] * 4
    rows = substrings.drop_repeats(docs(spark, texts, kept="old", n_words="x", packed="mine").repartition(4), width=width, m=m, bucket_rows=bucket_rows)
    assert rows.columns == ["doc_id", "text", "packed", "n_words", "n_removed", "kept"]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in rows.collect()}
    assert got == dict(enumerate(plain_repeats(texts, width)))
    assert substrings.drop_repeats(docs(spark, [])).count() == 0
    same = spark.createDataFrame([(None, "q " * 40 + "end"), (None, "q " * 40 + "end"), (3, "r s t")], "doc_id bigint, text string")
    assert sorted(r.n_removed for r in substrings.drop_repeats(same, width=35).collect()) == [0, 41, 41]


# --- pipeline ----------------------------------------------------------------------------------
def test_pipeline_equals_plain_steps(spark):
    import corpus_pipeline
    from vacantic.llm import langid, packing
    rng = random.Random(9)
    en = lambda k: " ".join(rng.choice("the of and river house tree walked slowly under bright green morning water stone".split()) + rng.choice(("", "s", "ly")) for _ in range(k))
    passage = en(60)
    texts = [en(150) for _ in range(12)]
    texts += [texts[0], texts[1] + " more", en(80) + "\n" + passage, passage + " " + en(70), "Mail a.b@c.org or +1 (319) 555-5132 now", None, "", "12 34", "zqxj" * 200]
    table = spark.createDataFrame([(i, t, "en" if i < 12 else None, "s", len(t or "")) for i, t in enumerate(texts)],
                                  "doc_id bigint, text string, lang string, source string, n_chars bigint")
    rows = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, "")
        assert rows.columns == table.columns, name
    got = {r.doc_id: r for r in rows.collect()}
    assert set(got) == set(range(17)) - {12, 13}
    plain = plain_repeats([texts[i] for i in sorted(got)], 35)
    for i, (_, removed, kept) in zip(sorted(got), plain):
        if i != 16:
            assert got[i].text == (kept if removed else texts[i]) and got[i].n_chars == len(got[i].text)
    assert plain[sorted(got).index(14)][1] >= 60 and "a.b@c.org" not in got[16].text and "555-5132" not in got[16].text
    pieces = corpus_pipeline.STAGES[-1][1](spark, rows, "").collect()
    ids = defaultdict(bytes)
    for p in sorted(pieces, key=lambda p: p.start):
        ids[p.doc_id] += bytes(p.ids)
    enc = packing.encoder(__import__("public_tokenizers").path("byte_bpe_50k.json"))
    assert dict(ids) == {i: enc.encode([r.text])[0] + b"\0\0\0\0" for i, r in got.items()}
    assert langid.UNKNOWN == "und" and hashlib.sha256(b"").hexdigest().startswith("e3b0")
