"""Language, pieces, packing, pseudonyms and fingerprints against plain Python versions and edge cases."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vacantic.llm import langid, packing, pieces, pii, syncmers

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n", "a", "word " * 30_000, "漢字 and ñandú", "a  b\tc\n\n d ", "ok."]
EN = "the quick brown fox jumps over the lazy dog and then the other dogs run to the river with the fox "
FR = "le renard brun saute par dessus le chien paresseux et les autres chiens courent vers la rivière avec "


def docs(spark, texts, **more):
    names = list(more)
    rows = [(i, t, *[more[n] for n in names]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, ", ".join(["doc_id bigint", "text string", *[f"{n} string" for n in names]]))


# --- language ----------------------------------------------------------------------------------
def plain_profile(text, n, dim):
    low = " " + re.sub(r"[^\W\d_]+|(.)", lambda m: m[0] if not m[1] else " ", text.lower(), flags=re.S) + " "
    low = re.sub(" +", " ", low)
    out = np.zeros(dim, dtype=np.int64)
    if low.strip():
        for i in range(len(low) - n + 1):
            v = np.ones(dim, dtype=np.int64)
            for k, c in enumerate(low[i:i + n]):
                v *= np.roll(langid.symbol_vectors(np.array([ord(c)]), dim)[0].astype(np.int64), n - 1 - k)
            out += v
    return out


def test_language_equals_plain_profiles(spark):
    train = spark.createDataFrame([(EN, "en"), (FR, "fr"), (EN * 2 + "!", "en"), (None, "fr"), (FR, None), ("12", "xx")], "text string, lang string")
    model = langid.fit(train, n=3, dim=256)
    assert model.languages == ["en", "fr", "xx"]
    want = {"en": plain_profile(EN, 3, 256) + plain_profile(EN * 2 + "!", 3, 256), "fr": plain_profile(FR, 3, 256)}
    for i, x in enumerate(("en", "fr")):
        assert np.allclose(model.prototypes[i], want[x] / np.linalg.norm(want[x]), atol=1e-6)
    texts = [*ODD, EN[:40], FR[10:60], "le the", "9 9"]
    rows = langid.identify(docs(spark, texts, score="old", lang_pred="old", n_grams="mine"), model).collect()
    assert [r.doc_id for r in rows] == list(range(len(texts))) and {r.n_grams for r in rows} == {"mine"}
    for r, t in zip(rows, texts):
        p = plain_profile(t or "", 3, 256)
        if not p.any():
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            cos = {x: float(p @ want[x]) / np.linalg.norm(p) / np.linalg.norm(want[x]) for x in want} | {"xx": 0.0}
            assert abs(r.score - max(0, max(cos.values()))) < 1e-4
            assert cos[r.lang_pred] >= max(cos.values()) - 1e-4


def test_language_without_labels_and_rejection(spark):
    empty = langid.fit(docs(spark, []).withColumn("lang", F.lit("x")))
    assert [r.lang_pred for r in langid.identify(docs(spark, ["abc", None]), empty).collect()] == ["und", "und"]
    model = langid.fit(spark.createDataFrame([(EN * 3, "en"), (FR * 3, "fr")], "text string, lang string"))
    kept = langid.reject(docs(spark, [EN * 4, "No.", None, "1 2 3", "zqxj" * 300]), model)
    assert kept.columns == ["doc_id", "text"] and [r.doc_id for r in kept.collect()] == [0, 1]
    with pytest.raises(ValueError):
        langid.fit(spark.createDataFrame([("a", "x"), ("b", "y")], "text string, lang string"), max_languages=1)


def test_language_of_held_out_sample(spark):
    from vacantic.llm.queries import op1_language
    got = op1_language(spark, "/root/testdata/sf0.001")
    truth = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang")
    held = got.join(truth, "doc_id").where("held_out")
    assert held.count() > 20 and held.where("lang = lang_pred").count() >= 0.95 * held.count()


# --- packing -----------------------------------------------------------------------------------
def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer
    plain, rng = Tokenizer.from_file(BPE), random.Random(3)
    bits = ["a", "Foo", "it's", " ", "  ", "\n", ".", ",", "!?", "\t", " ", "x1", "é", "é", "漢", "\0", "<|endoftext|>", "_", "'ll", "3.5"]
    texts = [t or "" for t in ODD if t is None or len(t) < 1000] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(1500)]
    for limit in (5, 100_000):
        enc = packing.Encoder(BPE, limit)
        for _ in range(2):
            got = [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)]
            assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_new_parts_are_encoded_together():
    class Counted:
        def __init__(self, inner):
            self.inner, self.calls, self.texts = inner, 0, 0

        def encode_batch_fast(self, texts, **kw):
            self.calls, self.texts = self.calls + 1, self.texts + len(texts)
            return self.inner.encode_batch_fast(texts, **kw)

    rng = random.Random(8)
    texts = [" ".join("".join(rng.choice("abcdeé漢'7!") for _ in range(rng.randint(1, 9))) for _ in range(300)) for _ in range(20)]
    for limit in (50, 100_000):
        enc = packing.Encoder(BPE, limit)
        plain, enc.tokenizer = enc.tokenizer, Counted(enc.tokenizer)
        got = [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)]
        assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]
        assert enc.tokenizer.texts < 100 and len(enc.known) <= limit
        if limit > 50:
            enc.encode(texts)
            assert enc.tokenizer.texts < 100
        else:
            enc.bytes_of[:] = 7  # a file whose ids can't be dealt out: parts are encoded each on their own
            assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == got


def check_pieces(rows, texts, capacity):
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(BPE)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert r.length > 0 and len(r.ids) == 4 * r.length
    for i, t in enumerate(texts):
        parts = sorted(by_doc[i], key=lambda r: r.start)
        joined = np.frombuffer(b"".join(bytes(r.ids) for r in parts), "<u4").tolist()
        assert joined == plain.encode(t or "", add_special_tokens=False).ids + [0]
        at = 0
        for r in parts:
            assert r.start == at and r.doc_tokens == len(joined)
            at += r.length
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    assert padding == 0


@pytest.mark.parametrize("capacity", [16, 1024])
def test_packing_holds_every_id_once(spark, capacity):
    rng = random.Random(5)
    texts = [t if t is None or len(t) < 5000 else t[:5000] for t in ODD] + [" ".join(rng.choice(EN.split()) for _ in range(rng.randint(0, 400))) for _ in range(120)]
    rows = packing.pack(docs(spark, texts, ids="mine", start="x").repartition(3), BPE, capacity).collect()
    check_pieces(rows, texts, capacity)
    assert packing.pack(docs(spark, []), BPE).count() == 0


def test_levels_choose_the_smallest_sum_of_squares():
    rng, capacity = random.Random(1), 12
    levels, counts = packing.Levels(capacity), [0] * (capacity + 1)
    for _ in range(500):
        size = rng.randint(1, capacity - 1)
        options = {}
        for h in range(capacity - size + 1):
            if h == 0 or counts[h]:
                c = counts[:]
                c[h] -= 1 if h else 0
                if h + size < capacity:
                    c[h + size] += 1
                options[h] = sum(x * x for x in c[1:capacity])
        best = min(options.values())
        window, fill = levels.place(size)
        h = fill - size
        assert options[h] == best
        counts[h] -= 1 if h else 0
        if fill < capacity:
            counts[fill] += 1
            window.append(("d", 0, b"\0\0\0\0" * size, size))
        assert levels.count[1:capacity].tolist() == counts[1:capacity]


# --- pieces ------------------------------------------------------------------------------------
def plain_viterbi(model, word):
    best = [(0.0, 0, [])] + [None] * len(word)
    for i in range(1, len(word) + 1):
        options = [(best[j][0] + model.table[word[j:i]][0], best[j][1] + 1, best[j][2] + [model.table[word[j:i]][1]]) for j in range(i) if word[j:i] in model.table]
        if word[i - 1] not in model.table:
            b = word[i - 1].encode()
            options.append((best[i - 1][0] + model.fallback, best[i - 1][1] + len(b), best[i - 1][2] + [model.bytes[x] for x in b]))
        best[i] = max(options, key=lambda o: (o[0], -o[1]))
    return best[-1]


def test_shared_prefix_walk_equals_plain_viterbi():
    rng = random.Random(2)
    model = pieces.Pieces(PIECES)
    words = {"▁" * rng.randint(0, 2) + "".join(rng.choice("abehtosñ漢🙂1.") for _ in range(rng.randint(1, 9))) for _ in range(800)}
    score = {i: s for s, i in model.table.values()}
    for w, ids in model.segment(list(words)).items():
        ids = np.frombuffer(ids, "<i4").tolist()
        want = plain_viterbi(model, w)
        bytes_ = sum(i in model.bytes for i in ids)
        assert len(ids) == want[1] and sum(i in model.bytes for i in want[2]) == bytes_
        assert abs(sum(score[i] for i in ids if i in score) - sum(score[i] for i in want[2] if i in score)) < 1e-6


def test_encoded_texts_equal_plain_viterbi_over_their_words():
    rng = random.Random(3)
    texts = ["".join(rng.choice("aehnrst  ñ漢²3._\n-▁") for _ in range(rng.randint(0, 60))) for _ in range(300)] + [None, "", "  ", "²." * 3]
    for limit in (100_000, 5):  # a small limit forgets words all the time
        model = pieces.Pieces(PIECES, limit)
        ids = [x.tolist() for t in texts for x in model.encode([t])]
        assert ids == [x.tolist() for x in model.encode(texts)]
        for t, got in zip(texts, ids):
            marked = re.findall("▁+[^▁]*", "▁" + t.replace(" ", "▁")) if t else []
            score = {i: s for s, i in model.table.values()}
            want = [i for w in marked for i in plain_viterbi(model, w)[2]]
            assert len(got) == len(want) and abs(sum(score.get(i, 0) for i in got) - sum(score.get(i, 0) for i in want)) < 1e-6
    assert model.decode([np.array([], "<i4"), None]) == ["", None]


def test_pieces_round_trip_and_library_decode(spark):
    from sentencepiece import SentencePieceProcessor
    sp = SentencePieceProcessor(model_file=PIECES)
    texts = [*ODD, " leading", "two  blanks ", "tab\tand\nline", "🙂" * 50]
    rows = docs(spark, texts, ids="old").withColumn("ids", pieces.encode(F.col("text"), PIECES)) \
        .withColumn("back", pieces.decode(F.col("ids"), PIECES)).orderBy("doc_id").collect()
    for r, t in zip(rows, texts):
        assert r.back == (t or "") and (bool(r.ids) == bool(t))
        assert sp.decode(list(r.ids)) == (t or "")
    both = pieces.coded(docs(spark, texts, ids="old", Decoded="old"), PIECES).orderBy("doc_id").collect()
    assert [(list(r.ids), r.decoded) for r in both] == [(list(r.ids), r.back) for r in rows]
    assert pieces.coded(docs(spark, texts).limit(0), PIECES).count() == 0


# --- pseudonyms --------------------------------------------------------------------------------
def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def test_pseudonyms_keep_formats_and_links(spark):
    texts = ["4799134681044206 4799-1346-8104-4206", "8316107434564120", "+1 (319) 555-5132 or 319-555-5132", "a.b1@c2.org a.b1@c2.org",
             "1984-02-29 29.02.1984 29/2/1984 2/29/1984", "31.02.1984", "123-45-6789 000-12-3456", "10.0.255.1 10.0.256.1 version 2.0.",
             "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "GB00WEST12345698765432", "plain text, 12 of 300.", None, "", "+49 30 901820"]
    out = [r.text for r in pii.pseudonymise(docs(spark, texts, n_changed="old", _new="x", _found="y"), "k", counter="n_changed").orderBy("doc_id").collect()]
    a, b = out[0].split()
    assert a == b.replace("-", "") != "4799134681044206" and luhn(a) and a[0] == "4"
    assert out[1] == texts[1] and out[5] == texts[5] and out[10] == texts[10] and out[11:14] == texts[11:14]
    x, y = out[2].split(" or ")
    assert re.fullmatch(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}", x) and re.sub(r"\D", "", x)[1:] == y.replace("-", "") != "3195555132"
    m, n = out[3].split()
    assert m == n != "a.b1@c2.org" and re.fullmatch(r"[a-z]\.[a-z]\d@[a-z]\d\.org", m)
    iso, dot, slash, month = out[4].split()
    y_, m_, d_ = iso.split("-")
    assert dot == f"{d_}.{m_}.{y_}" and slash == f"{int(d_)}/{int(m_)}/{y_}" and month == f"{int(m_)}/{int(d_)}/{y_}" and iso != "1984-02-29"
    s, bad = out[6].split()
    assert bad == "000-12-3456" and s != "123-45-6789" and re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", s)
    ip = out[7].split()
    assert ip[1:] == ["10.0.256.1", "version", "2.0."] and ip[0] != "10.0.255.1" and all(int(p) < 256 for p in ip[0].split("."))
    for i in (8, 9):
        flat = out[i].replace(" ", "")
        assert out[i] != texts[i] and len(out[i]) == len(texts[i]) and int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1
    assert out[14].startswith("+49 ") and out[14] != texts[14]
    assert pii.pseudonymise(docs(spark, []), "k").count() == 0


def test_phone_numbers_of_any_area_code(spark):
    texts = ["+1 (017) 555-7713", "+1 (132) 555-1352 or 132-555-1352", "(212) 155-1352", "+1 212 5550199 +12125550199 (212)-555-0199", "+1.212.555.0199 2125550199"]
    out = [r.text for r in pii.pseudonymise(docs(spark, texts), "k").orderBy("doc_id").collect()]
    assert re.fullmatch(r"\+1 \([01]\d\d\) [2-9]\d\d-\d{4}", out[0]) and out[0] != texts[0]
    a, b = out[1].split(" or ")
    assert re.sub(r"\D", "", a)[1:] == b.replace("-", "") != "1325551352"
    assert re.fullmatch(r"\([2-9]\d\d\) [01]\d\d-\d{4}", out[2]) and out[2] != texts[2]
    digits = [re.sub(r"\D", "", x)[-10:] for x in re.split(r" (?=[+(])", out[3])]
    assert len(set(digits)) == 1 and digits[0] != "2125550199"
    assert re.sub(r"\D", "", out[4].split()[0]) == "1" + digits[0] and out[4].split()[1] == "2125550199"
    every = spark.range(4000).select(F.format_string("%03d-%03d-0000", (F.col("id") % 400).cast("int"), (F.col("id") / 4).cast("int")).alias("text"))
    assert pii.pseudonymise(every, "k").distinct().count() == every.distinct().count() == 4000


def test_cards_and_ibans_next_to_other_numbers(spark):
    card, grouped, iban = "4799134681044206", "4799 1346 8104 4206", "BE68 5390 0754 7034"
    texts = [card, f"card {card} 12/27", f"paid {card} 30 days", f"no 12 {card} x", f"{grouped} 123", f"{card} {grouped} 4799-1346-8104-4206 1 2 3 4 5 6 7 8 9 10 11",
             f"{card} 2024-05-03", f"{card} 12.05.2024", f"{card} 212 555 0199", f"{card} 7@c2.org", f"{card}- {'7 ' * 5000}{card}", f"ID42 {grouped} {grouped}", "47 99 13 46 81 04 42 06",
             iban, f"{iban} A note", f"{iban} NOTE THIS", f"{iban} {grouped}", "BE68539007547034 30", "9999 9999 9999 9999"]
    rows = pii.pseudonymise(docs(spark, texts), "k", counter="n_changed").orderBy("doc_id").collect()
    out = [r.text for r in rows]
    new, new_iban = out[0], out[13]
    assert luhn(new) and new != card and new_iban != iban
    parted = " ".join(new[i:i + 4] for i in (0, 4, 8, 12))
    assert [r.n_changed for r in rows] == [1, 1, 1, 1, 1, 3, 2, 2, 2, 2, 2, 2, 1, 1, 1, 1, 2, 1, 0]
    assert out[1:6] == [f"card {new} 12/27", f"paid {new} 30 days", f"no 12 {new} x", f"{parted} 123", f"{new} {parted} {parted.replace(' ', '-')} 1 2 3 4 5 6 7 8 9 10 11"]
    assert all(out[i].startswith(new + " ") and len(out[i]) >= len(texts[i]) - 2 for i in (6, 7, 8, 9))
    assert out[10] == f"{new}- {'7 ' * 5000}{new}" and out[11] == f"ID42 {parted} {parted}" and out[12].replace(" ", "") == new
    assert out[14:] == [f"{new_iban} A note", f"{new_iban} NOTE THIS", f"{new_iban} {parted}", new_iban.replace(" ", "") + " 30", "9999 9999 9999 9999"]


def test_permutation_is_one_to_one_and_keyed(spark):
    every = spark.range(2000).select("id", F.array((F.col("id") / 40).cast("int"), (F.col("id") % 40).cast("int")).alias("v"))
    got = {}
    for key in ("a", "b"):
        rows = every.select("id", pii.permute(F.col("v"), F.array(F.lit(50), F.lit(40)), key, "x").alias("p")).collect()
        got[key] = [tuple(r.p) for r in rows]
        assert len(set(got[key])) == 2000 and all(0 <= x < 50 and 0 <= y < 40 for x, y in got[key])
    assert sum(x == y for x, y in zip(got["a"], got["b"])) < 20
    days = spark.range(0, 65536, 7).select(pii._moved(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), "k").alias("d"))
    assert days.distinct().count() == days.count() == 9363 and days.where("d is null").count() == 0


# --- fingerprints ------------------------------------------------------------------------------
def test_anchors_are_closed_syncmers(spark):
    rng = random.Random(4)
    texts = [*ODD, *[" ".join(rng.choice(EN.split()) for _ in range(rng.randint(1, 60))) for _ in range(40)]]
    k, s = 5, 2
    rows = docs(spark, texts).select("text", syncmers.anchors(F.col("text"), k, s).alias("a")).collect()
    words = sorted({w for t in texts for w in re.findall(r"\S{1,12}", t or "")})
    number = {r.w: r.h for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    grams = sorted({(a, b) for t in texts for x in [[0] * (k - 1) + [number[w] for w in re.findall(r"\S{1,12}", t or "")]] for a, b in zip(x, x[1:])})
    pair = {(r.a, r.b): r.h for r in spark.createDataFrame(grams, "a bigint, b bigint").select("a", "b", F.xxhash64("a", "b").alias("h")).collect()}
    for r in rows:
        x = [0] * (k - 1) + [number[w] for w in re.findall(r"\S{1,12}", r.text or "")]
        inner = [pair[a, b] for a, b in zip(x, x[1:])]
        want = [i for i in range(len(x) - k + 1) if min(inner[i:i + k - s + 1]) in (inner[i], inner[i + k - s])]
        if want:
            assert [a.pos for a in r.a] == want
        else:
            assert len(r.a) == (len(x) >= k)


def test_edited_neighbours(spark):
    rng = random.Random(8)
    long = " ".join(rng.choice(EN.split()) + str(rng.randint(0, 99)) for _ in range(90))
    texts = ["", long, FR * 2, long, None, "short", "é" * 10]
    rows = {r.doc_id: r for r in syncmers.edited_neighbours(docs(spark, texts, extra="x")).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[i - 1] or ""  # the next document has the next smaller id; after 0 comes the largest
        cut = len(t) // 3
        assert rows[i].edited == t[:len(t) - cut] + nxt[:cut] and rows[i].n_chars == len(t)
        assert 0 <= rows[i].near_edited <= 1 and 0 <= rows[i].near_next <= 1
    assert rows[1].anchors == rows[3].anchors and rows[0].near_edited == 1.0 and 0.3 < rows[1].near_edited < 0.8
    twice = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "three four"), (None, "five")], "doc_id bigint, text string")
    assert syncmers.edited_neighbours(twice).count() == 4
    assert syncmers.edited_neighbours(docs(spark, [])).count() == 0
    alone = syncmers.edited_neighbours(docs(spark, ["one two three"])).first()
    assert alone.edited == "one two tone " and alone.near_next == 1.0


def test_positional_matches(spark):
    once = " ".join(dict.fromkeys(EN.split()))
    a, b = "x y " + once, once
    row = spark.createDataFrame([(a, b)], "a string, b string").select(
        syncmers.positional_matches(syncmers.anchors(F.col("a")), syncmers.anchors(F.col("b"))).alias("m")).first()
    shifts = [m.pos_a - m.pos_b for m in row.m]
    assert shifts and set(shifts) == {2}
