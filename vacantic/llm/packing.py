"""Packing token sequences into windows of fixed length by the sum-of-squares rule.

Each partition packs its documents as they come.  A document's whole windows are filled at once; the rest goes to the
fill level for which the sum of squared numbers of open windows per level becomes smallest (a new window is level 0),
which keeps the levels even, so that nearly every size finds a window that it completes.  The numbers stand in an array
by level.  At the end of a partition the open windows are joined and cut into full windows; what then remains, less
than a window, is cut into sequences whose lengths are powers of two, which need no padding.

Defined results: null text is empty and yields the end mark only; repeated rows are packed each on its own; an
empty table yields no piece; other columns are not carried.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantic.functions.text import small_batches
from vacantic.llm.common import exact_id, nullable_ids, process_cache

BATCH_CHARS = 2_000_000  # code points that are encoded at once
SCHEMA = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
_CUT = re.compile(r"(?<=\S) (?=\S)")
_TAIL = re.compile("([,.;:!?])\0(?<=[^\\W_][,.;:!?]\0)")
_OTHER_BLANKS = [chr(c) for c in (0, 9, 11, 12, 13, 28, 29, 30, 31, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def marked(text: str) -> str | None:
    """The text with a zero character between its parts, or null if it holds other or adjacent blanks."""
    if ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n"
            or any(c in text for c in _OTHER_BLANKS)):
        return None
    return _TAIL.sub("\0\\1\0", text.replace(" ", "\0 ").replace("\n", "\0\n\0") + "\0")


def cut(text: str) -> list[str]:
    """Parts that a byte-level tokenizer encodes on their own.

    Between two words one blank leads the second word and one line end stands alone; a punctuation mark between a
    letter or digit and a blank stands alone.  Texts with other or with adjacent blanks are cut at single blanks only.
    """
    plain = marked(text)
    if plain is not None:
        return plain.split("\0")
    parts = _CUT.split(text)
    parts[1:] = [" " + w for w in parts[1:]]
    return parts


def distinct_parts(texts: list) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct parts of all texts, the place of each part among them, and the number of parts of each text."""
    counts, pieces, chunks = np.zeros(len(texts), np.int64), [], []

    def flush():
        if pieces:
            chunks.append(pc.split_pattern(pa.array(["\0".join(pieces)], pa.large_string()), "\0").flatten())
            pieces.clear()

    for i, t in enumerate(texts):
        plain = marked(t) if t else None
        if plain is not None:
            pieces.append(plain)
            counts[i] = plain.count("\0") + 1
        elif t:
            flush()
            chunks.append(pa.array(cut(t), pa.large_string()))
            counts[i] = len(chunks[-1])
    flush()
    if not chunks:
        return [], np.zeros(0, np.int64), counts
    coded = pa.concat_arrays(chunks).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False), counts


class Encoder:
    """Ids of texts by a byte-level BPE file, as little-endian 32-bit numbers.

    Such a tokenizer encodes the parts that `cut` yields on their own, so ids are remembered per part (up to `limit`
    parts; more are encoded each time).  New parts that a blank leads are encoded as one text of `JOINED` parts, and its
    ids are dealt out by the bytes they stand for.
    """

    JOINED = 1000

    def __init__(self, path: str, limit: int = 250_000):
        from tokenizers import Tokenizer
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer, self.limit, self.known = Tokenizer.from_file(path), limit, {}
        names = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(names.values(), default=0) + 1, dtype=np.int64)  # a name has one character per byte
        self.bytes_of[list(names.values())] = list(map(len, names))

    def _each(self, parts: list) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _together(self, parts: list) -> list[bytes]:
        """Ids of parts that a blank leads and that hold no other."""
        text = "".join(parts)
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.cumsum(self.bytes_of[ids])
        sizes = map(len, parts) if text.isascii() else (len(w.encode()) for w in parts)
        wanted = np.cumsum(np.fromiter(sizes, dtype=np.int64, count=len(parts)))
        at = np.searchsorted(ends, wanted)
        if not len(ends) or ends[-1] != wanted[-1] or (ends[at] != wanted).any():
            return self._each(parts)  # a file that joins parts, or whose names are not bytes
        data, cuts = ids.tobytes(), ((at + 1) * 4).tolist()
        return [data[a:b] for a, b in zip([0, *cuts], cuts)]

    def encode(self, texts: list) -> list[bytes]:
        parts, places, counts = distinct_parts(texts)
        known = self.known
        fresh = [w for w in parts if w not in known]
        surplus = []
        if fresh:
            led, other = [], []
            for w in fresh:
                (led if w[:1] == " " and w.split() == [w[1:]] else other).append(w)
            ids = [x for s in range(0, len(led), self.JOINED) for x in self._together(led[s:s + self.JOINED])] + self._each(other)
            words = led + other
            surplus = words[max(0, self.limit - len(known)):]
            known.update(zip(words, ids))
        ids_of = [known[w] for w in parts]
        for w in surplus:
            del known[w]
        ids = np.frombuffer(b"".join(ids_of), dtype="<u4")
        sizes = np.fromiter(map(len, ids_of), dtype=np.int64, count=len(ids_of)) // 4
        taken = sizes[places]
        ends = np.concatenate(([0], np.cumsum(taken)))
        at = np.repeat((np.cumsum(sizes) - sizes)[places] - ends[:-1], taken) + np.arange(ends[-1])
        data, cuts = ids[at].tobytes(), (4 * ends[np.cumsum(counts)]).tolist()
        return [data[a:b] for a, b in zip([0, *cuts], cuts)]


def encoder(path: str) -> Encoder:
    """One encoder per Python worker and file."""
    cache = process_cache("packing")
    if ("bpe", path) not in cache:
        cache["bpe", path] = Encoder(path)
    return cache["bpe", path]


class Levels:
    """Open windows by fill level; `place` returns the window that takes a piece of `size` tokens."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1)
        self.count[capacity] = -0.5  # a full window counts nowhere: its step is 1 - 2 n[h] by the common formula
        self.windows: list[list[list]] = [[] for _ in range(capacity)]

    def place(self, size: int) -> tuple[list, int]:
        """(window, its new fill); the window is removed from the levels once it is full."""
        n, last = self.count, self.capacity - size
        open_ = n[1:last + 1]
        step = np.where(open_ > 0, 2 - 2 * open_ + 2 * n[1 + size:self.capacity + 1], np.inf)
        level = 0
        if len(step):
            best = len(step) - 1 - int(step[::-1].argmin())  # of equal steps the fullest window
            if step[best] <= 1 + 2 * n[size]:
                level = best + 1
        window = []
        if level:
            window = self.windows[level].pop()
            n[level] -= 1
        fill = level + size
        if fill < self.capacity:
            n[fill] += 1
            self.windows[fill].append(window)
        return window, fill

    def rest(self) -> list:
        """All pieces of the windows still open, fullest windows first."""
        return [piece for level in reversed(self.windows) for window in level for piece in window]


def _sequences(docs, capacity: int):
    """Sequences (lists of (doc_id, start, ids, doc_tokens)) of a stream of (doc_id, ids)."""
    levels, width = Levels(capacity), 4
    for doc, ids in docs:
        total = len(ids) // width
        whole = total - total % capacity
        for s in range(0, whole, capacity):
            yield [(doc, s, ids[s * width:(s + capacity) * width], total)]
        if total > whole:
            window, fill = levels.place(total - whole)
            window.append((doc, whole, ids[whole * width:], total))
            if fill == capacity:
                yield window
    left = sum(len(p[2]) for p in levels.rest()) // width
    sizes = [capacity] * (left // capacity) + [1 << k for k in reversed(range(left.bit_length())) if (left % capacity) >> k & 1]
    sequence, room = [], sizes.pop(0) if sizes else 0
    for doc, start, ids, total in levels.rest():
        while ids:
            take = min(room, len(ids) // width)
            sequence.append((doc, start, ids[:take * width], total))
            start, ids, room = start + take, ids[take * width:], room - take
            if not room:
                yield sequence
                sequence, room = [], sizes.pop(0) if sizes else 0


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 0, key: str = "doc_id",
         text: str = "text") -> DataFrame:
    """Pieces of all documents: their sequence, the place in it, and their ids (little-endian 32-bit)."""
    end = int(end_id).to_bytes(4, "little")
    small_batches()

    def stream(frames):
        enc, keys, texts, size = encoder(tokenizer_path), [], [], 0
        for pdf in frames:
            for k, no_id, t in zip(pdf["id"].tolist(), pdf["no_id"].tolist(), pdf["t"].tolist()):
                keys.append(None if no_id else k)
                texts.append(t)
                size += len(t) if t else 1
                if size >= BATCH_CHARS:
                    for k, ids in zip(keys, enc.encode(texts)):
                        yield k, ids + end
                    keys, texts, size = [], [], 0
        for k, ids in zip(keys, enc.encode(texts)):
            yield k, ids + end

    def run(frames):
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 40
        rows, size = [], 0
        for sequence in _sequences(stream(frames), capacity):
            offset = 0
            for doc, start, ids, total in sequence:
                rows.append((doc, start, len(ids) // 4, ids, total, number, offset))
                offset += len(ids) // 4
            number, size = number + 1, size + offset
            if size > 500_000:
                yield _frame(rows)
                rows, size = [], 0
        if rows:
            yield _frame(rows)

    return docs.select(*exact_id(key), F.col(f"`{text}`").alias("t")).mapInPandas(run, SCHEMA)


def _frame(rows: list) -> pd.DataFrame:
    out = pd.DataFrame([r[1:] for r in rows], columns=["start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
    out.insert(0, "doc_id", nullable_ids([r[0] or 0 for r in rows], [r[0] is None for r in rows]))
    return out
