"""Ranked lexical search of items over all documents by an Aho-Corasick scan, without an index of the documents.

The items' distinct terms go into one automaton, each between two guards, so that only whole terms match; a text becomes
lower case with a guard for every byte outside a term, and one walk over it gives the number of occurrences of all terms
of all items.  The automaton's outputs are term numbers, which map to the items that hold them.

Two scans: the first one adds up the corpus figures (documents with a term, terms, documents per item term), the second
one scores each document for all items and keeps the best of its task per item; the tasks' lists meet in two steps.

The items are a stated query set.  They are dealt into blocks of about `block_bytes` of terms, one scan of the documents
per block, so that what a task receives is bounded however many items there are.

Defined results: null text and text without a term has no terms and is not counted; an item without a term and one whose
terms no document holds get no rows; rows with the same item id (null is an id) are one item with all their terms;
documents count by row, whatever their id; equal scores go by ascending doc_id, null last; empty tables yield no rows;
other columns are not read.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vacantic.llm.common import process_cache, stored

BLOCK_BYTES = 4_000_000  # of terms and their entries in a block of items
CELLS = 1 << 20  # (document, item) scores held at once
ENTRIES = 1 << 21  # (document, item, term) products held at once
SALTS = 64
GUARD = 32
#: bytes of a text as bytes of its terms: ASCII letters (small) and digits, every byte of a longer code point; else a guard
FOLD = bytes(b if b >= 128 or chr(b).isalnum() else GUARD for b in range(256)).translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))
WORD_SCHEMA = "item_id bigint, term binary"
NO_DOCUMENTS, NO_TERMS = -1, -2  # rows of the first scan that are not about a term


def terms(text: bytes | None) -> list[bytes]:
    """Terms of a UTF-8 text in order."""
    return text.translate(FOLD).split() if text else []


@dataclass
class Block:
    """Items of one block: their ids, and the items of term t at `items[start[t]:start[t + 1]]`."""

    name: str
    ids: list
    words: list[bytes]
    start: np.ndarray
    items: np.ndarray

    @staticmethod
    def of(entries: list[tuple]) -> Block:
        ids = sorted({i for i, _ in entries}, key=lambda i: (i is None, i or 0))
        words = sorted({w for _, w in entries})
        item_no, word_no = {i: k for k, i in enumerate(ids)}, {w: k for k, w in enumerate(words)}
        pairs = sorted((word_no[w], item_no[i]) for i, w in entries)
        start = np.searchsorted([w for w, _ in pairs], np.arange(len(words) + 1))
        return Block(uuid.uuid4().hex, ids, words, start, np.array([i for _, i in pairs], dtype=np.int64))

    def automaton(self):
        """Made once in each worker process; the last one is kept."""
        import ahocorasick
        cache = process_cache("lexical")
        if cache.get("automaton", ("",))[0] != self.name:
            made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for k, w in enumerate(self.words):
                made.add_word(f" {w.decode('latin-1')} ", k)
            made.make_automaton()
            cache["automaton"] = (self.name, made)
        return cache["automaton"][1]


def _scan(block: Block, texts: list) -> Iterator[tuple[int, Counter]]:
    """Number of terms, and occurrences of each of the block's terms, text by text."""
    walk, term = block.automaton().iter, itemgetter(1)
    for raw in texts:
        if not raw:
            yield 0, Counter()
            continue
        folded = raw.translate(FOLD)
        yield len(folded.split()), Counter(map(term, walk(f" {folded.decode('latin-1')} ")))


def _statistics(block) -> object:
    def run(frames) -> Iterator[pa.RecordBatch]:
        b, docs, all_terms, df = block.value, 0, 0, Counter()
        for batch in frames:
            for n, found in _scan(b, batch.column("text").to_pylist()):
                docs += n > 0
                all_terms += n
                df.update(found.keys())
        df[NO_DOCUMENTS], df[NO_TERMS] = docs, all_terms
        yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.int64()), pa.array(list(df.values()), pa.int64())], ["term", "n"])
    return run


class Best:
    """The best `k` documents of each item so far: higher score first, then smaller id, null ids last."""

    def __init__(self, n_items: int, k: int):
        self.k, self.least, self.parts, self.size = k, np.zeros(n_items, np.int64), [], 0
        self.most = max(1 << 16, 4 * k * n_items)

    def add(self, scores: np.ndarray, ids: np.ndarray, unknown: np.ndarray) -> None:
        """Scores (document x item)."""
        doc, item = np.nonzero((scores > 0) & (scores >= self.least))
        self.parts.append((item, scores[doc, item], unknown[doc], ids[doc]))
        self.size += len(doc)
        if self.size > self.most:
            self.cut()

    def cut(self) -> tuple:
        item, score, unknown, ids = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((ids, unknown, -score, item))
        item, score, unknown, ids = item[order], score[order], unknown[order], ids[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        full = place == self.k - 1
        self.least[item[full]] = score[full]
        keep = place < self.k
        self.parts, self.size = [(item[keep], score[keep], unknown[keep], ids[keep])], int(keep.sum())
        return self.parts[0]


def _add_up(block: Block, docs: int, doc: np.ndarray, term: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Sum of the values of an item's terms: documents x items."""
    out = np.zeros(docs * len(block.ids), np.int64)
    size = block.start[term + 1] - block.start[term]
    entry = np.repeat(block.start[term] - np.cumsum(size) + size, size) + np.arange(size.sum())
    np.add.at(out, np.repeat(doc, size) * len(block.ids) + block.items[entry], np.repeat(value, size))
    return out.reshape(docs, len(block.ids))


def _ranked(block, weights: np.ndarray, docs: int, all_terms: int, k: int) -> object:
    def run(frames) -> Iterator[pa.RecordBatch]:
        b = block.value
        best, fan = Best(len(b.ids), k), np.diff(b.start)
        rows = max(1, CELLS // len(b.ids))
        held: tuple[list, list, list, list] = ([], [], [], [])  # document in the block, term, value, doc_id
        products = 0

        def flush() -> None:
            doc, term, value, who = held
            if who:
                ids = np.array([x or 0 for x in who], dtype=np.int64)
                best.add(_add_up(b, len(who), *(np.concatenate(x) for x in (doc, term, value))), ids, np.array([x is None for x in who]))
            for x in held:
                x.clear()

        for batch in frames:
            ids = batch.column("doc_id").to_pylist()
            for who, (n, found) in zip(ids, _scan(b, batch.column("text").to_pylist())):
                if not found:
                    continue
                long = 100 - 50 + (50 * n * docs) // all_terms
                term, tf = np.fromiter(found.keys(), np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found))
                value = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * long))
                held[0].append(np.full(len(term), len(held[3]), np.int64))
                held[1].append(term)
                held[2].append(value)
                held[3].append(who)
                products += int(fan[term].sum())
                if len(held[3]) >= rows or products >= ENTRIES:
                    flush()
                    products = 0
        flush()
        if best.parts:
            item, score, unknown, ids = best.cut()
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(score, pa.int64()), pa.array(ids, pa.int64(), mask=unknown)],
                                             ["item", "score", "doc_id"])
    return run


def _entries(items: DataFrame) -> DataFrame:
    """Distinct (item_id, term) of the items."""
    def run(frames) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            found = [(i, w) for i, t in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()) for w in set(terms(t))]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([w for _, w in found], pa.binary())], ["item_id", "term"])

    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, WORD_SCHEMA).distinct()


def _search_block(docs: DataFrame, block: Block, k: int) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(block)
    counts = dict(map(tuple, docs.select("text").mapInArrow(_statistics(shared), "term bigint, n bigint").groupBy("term").agg(F.sum("n")).collect()))
    n_docs, n_terms = counts.get(NO_DOCUMENTS, 0), counts.get(NO_TERMS, 0)
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * counts.get(t, 0) + 1))) for t in range(len(block.words))], dtype=np.int64)
    best = docs.mapInArrow(_ranked(shared, weights, n_docs, n_terms, k), "item bigint, score bigint, doc_id bigint")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    some = best.withColumn("_salt", F.spark_partition_id() % SALTS) \
        .withColumn("rank", F.row_number().over(Window.partitionBy("item", "_salt").orderBy(*order))).where(F.col("rank") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(block.ids)), "item bigint, item_id bigint")
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 50, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the `k` best documents (doc_id, text) of each item (item_id, text)."""
    entries = stored(_entries(items))
    size = entries.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    blocks = max(1, math.ceil(2 * size / block_bytes))  # dealt by hash: half full on average
    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    number = F.pmod(F.xxhash64(F.coalesce(F.col("item_id"), F.lit(-1)), F.col("item_id").isNull()), F.lit(blocks))
    out = docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for b in range(blocks):
        mine = [(r["item_id"], bytes(r["term"])) for r in entries.where(number == b).collect()]
        if mine:
            found = _search_block(read, Block.of(mine), k)
            out = found if blocks == 1 else out.unionByName(stored(found))
    return out
