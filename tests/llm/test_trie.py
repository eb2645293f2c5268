"""The prefix trie of conversations against a plain trie."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from vacantic.llm import trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, n_words string"


def crc(c):
    return zlib.crc32(str(c).encode()) % 4


def plain(rows, family=20, borrowed=crc):
    """Nodes of the trie, one dictionary of first turns."""
    logs = {}
    key = lambda r: (r[1] is not None, r[1] or 0, hashlib.md5(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).digest())
    for r in sorted((r for r in rows if r[0] is not None), key=key):
        logs.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    rebuilt = {}
    for c, own in logs.items():
        h = borrowed(c)
        rebuilt[c] = logs.get(c - (abs(c) % family) * (1 if c >= 0 else -1), [])[:h] + own[h:]
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    def under(p):
        leaves, saved = 0 if p in kids else 1, (len(members[p]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0)
        for k in kids.get(p, []):
            a, b = under(k)
            leaves, saved = leaves + a, saved + b
        return leaves, saved

    out = []
    for p, m in members.items():
        ends = sorted(c for c in m if len(rebuilt[c]) == len(p))
        leaves, saved = under(p)
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves, saved,
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def built(spark, rows, limit, family=20, borrowed=None):
    borrowed = (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int") if borrowed is None else borrowed
    nodes = trie.conversation_trie(spark.createDataFrame(rows, SCHEMA), family, borrowed, container_rows=limit)
    assert nodes.columns == trie.NODE
    return sorted(map(tuple, nodes.collect()), key=str)


def random_logs(seed, convs=150):
    rng, rows = random.Random(seed), []
    for c in range(convs):
        c = c * rng.choice([1, 1, 3]) - 20
        for t in range(rng.randint(1, 9)):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "bot", None]) if t > 2 else "user", rng.choice(["a b", "c", "", None, " x  y\tz "]) if t > 1 else rng.choice("ab"), "other"))
    return rows


@pytest.mark.parametrize("limit", [1, 7, 40, 100_000])
def test_equals_plain_trie(spark, limit):
    rows = random_logs(limit)
    rows += [(1000 + i, t, "user", f"same {t}", "x") for i in range(60) for t in range(6)]  # one conversation many times
    rows += [(2000 + i, t, "user", f"grow {t}", "x") for i in range(1, 40) for t in range(i)]  # snapshots of one that grows
    rows += [(3000, t, "bot", f"long {t}", "x") for t in range(300)] + [(3001, t, "bot", f"long {t % 299}", "x") for t in range(300)]
    rows += [(None, 0, "user", "nobody", "x"), (2**60 + 1, 0, "user", "a", "x"), (-7, 3, None, None, None), (-7, 3, None, None, None)]
    random.Random(3).shuffle(rows)
    assert built(spark, rows, limit) == plain(rows)


def test_own_turns_only_and_long_blocks(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 4)
    rows = random_logs(9, 60) + [(5000 + i, t, "user", f"twin words {t}", "x") for i in range(3) for t in range(30)]
    for limit in (1, 50):
        assert built(spark, rows, limit, borrowed=F.lit(0)) == plain(rows, borrowed=lambda c: 0)


def test_small_tables(spark):
    assert built(spark, [], 10) == []
    assert built(spark, [(None, 1, "a", "b", "c")], 10) == []
    one = [(22, 0, "user", "x", "x")]  # borrows one turn of an absent conversation: nothing is left of it
    assert crc(22) and built(spark, one, 10) == plain(one) and len(plain(one)) == 1
    assert built(spark, one * 5, 1) == plain(one * 5)


def test_roles_and_texts_do_not_run_together(spark):
    rows = [(100, 0, "ab", "c", "x"), (101, 0, "a", "bc", "x"), (102, 0, None, "abc", "x"), (103, 0, "abc", None, "x")]
    got = built(spark, rows, 10, borrowed=F.lit(0))
    assert got == plain(rows, borrowed=lambda c: 0) and len(got) == 5
