"""Encoding and decoding with a SentencePiece vocabulary, by Viterbi over a trie of the words of a batch.

Text is marked as the library does it (blanks become a mark, one more leads) and cut before each run of marks, as no
piece spans such a place; where no piece joins letters, digits and other characters, it is cut between these as well.  The distinct words of a batch are sorted, so that they stand in the depth-first order of
their trie; the forward scores of a word's prefixes stay on a stack, and the next word starts from those of the prefix
that both share.  A word's pieces are those with the largest sum of scores; characters without a piece fall back to
their bytes.  Ties go to fewer pieces, then to the longer last piece.

Scores are those in the file.  For a file made by merging pairs they are merge ranks: the segmentation has the best sum
of ranks, and the library's merging order may cut a word otherwise; both decode to the same text.

Defined results: null and empty text have no ids and decode to the empty text; a mark character in the text
decodes to a blank, as in the library; rows may repeat; an empty table yields no rows; a column named like the added
one is replaced, all others are kept.
"""

from __future__ import annotations

import re
from array import array
from math import inf

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantic.llm.common import by_chars, process_cache

MARK = "▁"
PENALTY = 10.0  # below the worst score, for a character without a piece
_WORD = re.compile(f"{MARK}({MARK}*[^{MARK}]*)")


def words(text) -> list[str]:
    """The words of a text, each without the first of its marks."""
    if not text:
        return []
    if text[0] != " " and "  " not in text and MARK not in text:
        return text.split(" ")
    return _WORD.findall(MARK + text.replace(" ", MARK))


def cutter(pieces) -> re.Pattern:
    """Matches the units of a marked word: its letters, digits and others if no piece spans two of them, else all of it."""
    odd = re.escape("".join(sorted({c for p in pieces for c in p if c.isalnum() and not c.isalpha() and not c.isdecimal()})))
    letters, others = rf"[^\W\d_{odd}]+", rf"(?:[^\w{MARK}]|[_{odd}])+"
    unit = re.compile(rf"{MARK}+(?:{letters}|{others})?|{letters}|\d|{others}")
    return unit if all(map(unit.fullmatch, pieces)) else re.compile("(?s:.+)")


def undominated(pieces: dict[str, tuple[float, int]]) -> dict[str, tuple[float, int]]:
    """The pieces whose text no other pieces make with a better sum of scores: no best segmentation holds another one."""
    kept: dict[str, tuple[float, int]] = {}
    for piece in sorted(pieces, key=len):
        best = [0.0]
        for i in range(1, len(piece) + 1):
            best.append(max((best[j] + kept[piece[j:i]][0] for j in range(i) if piece[j:i] in kept), default=-inf))
        if pieces[piece][0] >= best[-1]:
            kept[piece] = pieces[piece]
    return kept


class Pieces:
    """The vocabulary of a file, and the ids of the words met lately (two generations of some `limit` words).

    The pieces stand in an automaton: its state is the longest end of the text read that begins a piece, and names the
    pieces that end there, the longest first.
    """

    def __init__(self, path: str, limit: int = 80_000):
        from sentencepiece import SentencePieceProcessor
        sp = SentencePieceProcessor(model_file=path)
        self.table: dict[str, tuple[float, int]] = {}
        text: list[bytes] = []
        self.bytes = [0] * 256
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes[value] = i
                text.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i):
                text.append(b"")
            else:
                if MARK in piece.lstrip(MARK):
                    raise ValueError(f"the piece {piece!r} spans two words")
                self.table[piece] = (sp.get_score(i), i)
                text.append(piece.replace(MARK, " ").encode())
        self.blob = np.frombuffer(b"".join(text), dtype=np.uint8)
        self.length = np.array([len(x) for x in text])
        self.start = np.cumsum(self.length) - self.length
        self.fallback = min(s for s, _ in self.table.values()) - PENALTY
        self.cut, table = cutter(self.table), undominated(self.table)
        self.limit = limit
        self.known, self.older = ({}, {}), ({}, {})  # ids of words by the word without its first mark, ids of units within words
        states = {p[:n]: None for p in table for n in range(len(p) + 1)}
        states = {prefix: i for i, prefix in enumerate(sorted(states, key=len))}
        self.step: list[dict] = [{} for _ in states]
        self.back = [0] * len(states)  # state of the longest shorter end that begins a piece
        self.ends: list[tuple] = [()] * len(states)  # (length, score, id) of the pieces that end there
        for prefix, state in states.items():
            if prefix:
                self.step[states[prefix[:-1]]][prefix[-1]] = state
                shorter = self.back[state] = next(states[prefix[i:]] for i in range(1, len(prefix) + 1) if prefix[i:] in states)
                self.ends[state] = (((len(prefix), *table[prefix]),) if prefix in table else ()) + self.ends[shorter]
        self.alone = [not e or e[-1][0] > 1 for e in self.ends]

    def segment(self, words: list[str]) -> dict[str, bytes]:
        """Ids (32-bit) of distinct words, in one depth-first walk over their trie."""
        out, step, back, ends = {}, self.step, self.back, self.ends
        # per prefix length: state, score, pieces so far, length of the last piece, its id
        most = max(map(len, words), default=0) + 1
        state, total, pieces, size, last_id = [0] * most, [0.0] * most, [0] * most, [0] * most, [-1] * most
        last = ""
        for word in sorted(words):
            i = 0
            for x, y in zip(word, last):
                if x != y:
                    break
                i += 1
            now = state[i]
            for char in word[i:]:
                i += 1
                while (then := step[now].get(char)) is None and now:
                    now = back[now]
                now = then or 0
                best, fewest, length, piece = -inf, 0, 0, -1
                for n, score, found in ends[now]:
                    score += total[i - n]
                    if score > best or score == best and pieces[i - n] < fewest:
                        best, fewest, length, piece = score, pieces[i - n], n, found
                fewest += 1
                if self.alone[now]:  # the character is no piece
                    score, count = total[i - 1] + self.fallback, pieces[i - 1] + len(char.encode("utf-8", "surrogatepass"))
                    if score > best or score == best and count < fewest:
                        best, fewest, length, piece = score, count, 1, -1
                state[i], total[i], pieces[i], size[i], last_id[i] = now, best, fewest, length, piece
            last, ids = word, []
            while i:
                if last_id[i] >= 0:
                    ids.append(last_id[i])
                else:
                    ids += [self.bytes[x] for x in reversed(word[i - 1].encode("utf-8", "surrogatepass"))]
                i -= size[i]
            ids.reverse()
            out[word] = array("i", ids).tobytes()
        return out

    def learn(self, fresh: set[str]) -> None:
        """Ids of words that are not known: their units are looked up, and segmented together where they are new as well."""
        (known, inner), (older, older_inner) = self.known, self.older
        cut, units = {}, set()
        for w in fresh:
            if w in older:
                known[w] = older[w]
            elif w.isalpha():  # one unit
                units.add(MARK + w)
            else:
                cut[w] = self.cut.findall(MARK + w)
                units.update(cut[w])
        new = []
        for u in units:  # the first unit of a word is a word of its own
            name, now, before = (u[1:], known, older) if u[0] == MARK else (u, inner, older_inner)
            if name not in now:
                if name in before:
                    now[name] = before[name]
                else:
                    new.append(u)
        for u, ids in self.segment(new).items():
            if u[0] == MARK:
                known[u[1:]] = ids
            else:
                inner[u] = ids
        for w, us in cut.items():
            known[w] = known[us[0][1:]] + b"".join([inner[u] for u in us[1:]])

    def _slice(self, texts: list) -> list[np.ndarray]:
        known = self.known[0]
        cut = [words(t) for t in texts]
        ids = [list(map(known.get, ws)) for ws in cut]
        gaps = [[(i, w) for i, (x, w) in enumerate(zip(xs, ws)) if x is None] for xs, ws in zip(ids, cut)]
        self.learn({w for gap in gaps for _, w in gap})
        for xs, gap in zip(ids, gaps):
            for i, w in gap:
                xs[i] = known[w]
        if max(map(len, self.known)) > self.limit:
            self.known, self.older = ({}, {}), self.known
        return [np.frombuffer(b"".join(xs), dtype="<i4") for xs in ids]

    def encode(self, texts: list) -> list[np.ndarray]:
        return [ids for a, b in by_chars(texts, 3_000_000) for ids in self._slice(texts[a:b])]

    def decode(self, rows: list) -> list:
        """The texts of arrays of ids; null stays null."""
        out: list = []
        sizes = [0 if r is None else len(r) for r in rows]
        for a, b in by_chars([range(n) for n in sizes], 500_000):
            ids = np.concatenate([r for r in rows[a:b] if r is not None] or [np.zeros(0, np.int64)]).astype(np.int64)
            length = self.length[ids]
            end = np.cumsum(length)
            data = self.blob[np.arange(length.sum()) + np.repeat(self.start[ids] - end + length, length)].tobytes()
            at, end = 0, np.concatenate(([0], end))
            for r, n in zip(rows[a:b], sizes[a:b]):
                text = data[end[at]:end[at + n]].decode("utf-8", "replace")
                out.append(None if r is None else text[1:] if text.startswith(" ") else text)
                at += n
        return out


def pieces(path: str) -> Pieces:
    """One vocabulary per Python worker and file."""
    cache = process_cache("pieces")
    if ("pieces", path) not in cache:
        cache["pieces", path] = Pieces(path)
    return cache["pieces", path]


def coded(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """The table with the ids of a text column and the text they decode to; some 1000 rows are in memory at once."""
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in (ids.lower(), decoded.lower())])
    at = [c.lower() for c in kept.columns].index(text.lower())
    schema = T.StructType([*kept.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])

    def run(batches):
        import pyarrow as pa
        model = pieces(path)
        for batch in batches:
            for s in range(0, batch.num_rows, 1000):
                part = batch.slice(s, 1000)
                rows = model.encode(part.column(at).to_pylist())
                ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
                made = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows))), pa.array(model.decode(rows), pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[f.name for f in schema.fields])

    return kept.mapInArrow(run, schema)


def encode(text: Column, path: str) -> Column:
    """Array of ids."""
    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(pieces(path).encode(texts.tolist()), dtype=object)

    return run(text)


def decode(ids: Column, path: str) -> Column:
    """The text of an array of ids; null stays null."""
    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series(pieces(path).decode(rows.tolist()), dtype=object)

    return run(ids)
