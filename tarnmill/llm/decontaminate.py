"""Benchmark decontamination by greedy string tiling.

A document's words and a benchmark item's words are tiled: of all common runs of words that no tile covers yet, the
longest become tiles, again and again, until none of MIN_TILE words is left; of equally long runs that overlap, the one
that comes first in the document goes first, then the one that comes first in the item. Runs start from seeds, places
where the Karp-Rabin hashes of MIN_TILE words agree; runs are seeds that follow each other on a diagonal. As tiles may lie
in any order, a passage that was cut and reordered is covered like a whole one. An item is in a document if tiles cover at
least COVERAGE of its words.

Up to INDEX_CHARS of items go to every task as an index, and neither side is shuffled. Beyond that, documents and items
are joined on their seeds: documents send those that a bitmap of fixed size allows, pairs that share too few seeds for the
coverage go no further, and only what is left is tiled. Both ways give the same rows.

Defined results: words are runs of letters and digits, lower-cased. Null and empty texts, and items of fewer than three
words, match nothing; items shorter than MIN_TILE words match whole; rows with equal ids are matched each; rows of a
null item_id are items too; other columns are ignored by matches() and kept by drop_matched(); empty tables give an
empty table, or keep all documents. Rows have to come in one order each time they are read, as those of files do.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnmill.llm.common import distinct, free_name, gathered, materialise, slices, tidy

WORD = re.compile(r"[^\W_]+")
MIN_TILE, LEAST_ITEM, COVERAGE = 5, 3, 0.5
#: Characters of items that are sent to each task; slots of the bitmap of seeds.
INDEX_CHARS, SLOTS = 16_000_000, 1 << 24
BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """The Karp-Rabin hash of each k ids in a row."""
    n = len(ids) - k + 1
    h = np.zeros(max(n, 0), np.uint64)
    for j in range(k if n > 0 else 0):
        h = h * BASE + ids[j : j + n].astype(np.uint64)
    return h


class Index:
    """The words and seeds of a block of items."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int | None, np.ndarray, int]] = []
        seeds: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for key, text in items:
            w = words(text)
            if len(w) >= LEAST_ITEM:
                ids = np.array([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w], np.int64)
                k = min(MIN_TILE, len(w))
                seeds[k] += [(int(h), len(self.items), q) for q, h in enumerate(hashes(ids, k).tolist())]
                self.items.append((key, ids, k))
        self.seeds = {}
        for k, rows in seeds.items():
            rows.sort()
            self.seeds[k] = (np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64))

    def candidates(self, ids: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By item the places (in the document, in the item) of equal seeds."""
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k, (keys, item, place) in self.seeds.items():
            at = np.flatnonzero(known[k:] - known[:-k] == k) if len(ids) >= k else np.empty(0, np.int64)
            if not len(at):
                continue
            h = hashes(ids, k)[at]
            low, high = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
            n = high - low
            if not n.any():
                continue
            p = np.repeat(at, n)
            row = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            order = np.argsort(item[row], kind="stable")
            p, row = p[order], row[order]
            cuts = np.flatnonzero(np.diff(item[row])) + 1
            for ps, rs in zip(np.split(p, cuts), np.split(row, cuts)):
                found[int(item[rs[0]])] = (ps, place[rs])
        return found


def tile(doc: np.ndarray, item: np.ndarray, p: np.ndarray, q: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Tiles (place in the document, place in the item, length), longest first, from seeds of k words."""
    equal = np.ones(len(p), bool)
    for j in range(k):  # hashes only suggest
        equal &= doc[p + j] == item[q + j]
    p, q = p[equal], q[equal]
    order = np.lexsort((p, p - q))
    p, q = p[order], q[order]
    free_doc, free_item = np.ones(len(doc), bool), np.ones(len(item), bool)
    tiles = []
    while len(p):
        taken_doc, taken_item = np.concatenate(([0], np.cumsum(~free_doc))), np.concatenate(([0], np.cumsum(~free_item)))
        on = (taken_doc[p + k] == taken_doc[p]) & (taken_item[q + k] == taken_item[q])
        p, q = p[on], q[on]
        if not len(p):
            break
        starts = np.flatnonzero(np.concatenate(([True], (np.diff(p) != 1) | (np.diff(q) != 1))))
        length = np.diff(np.append(starts, len(p))) + k - 1
        longest = int(length.max())
        starts = starts[length == longest]
        for s in starts[np.lexsort((q[starts], p[starts]))].tolist():
            i, j = int(p[s]), int(q[s])
            if free_doc[i : i + longest].all() and free_item[j : j + longest].all():
                free_doc[i : i + longest] = free_item[j : j + longest] = False
                tiles.append((i, j, longest))
    return tiles


def contained(index: Index, text: str | None, coverage: float) -> Iterator[tuple[int | None, int, float, int, int]]:
    """For each item in the text: its id, words covered, their share, the longest tile's words, number of tiles."""
    doc = np.fromiter(map(index.vocabulary.get, words(text), repeat(0)), np.int64)
    for i, (p, q) in index.candidates(doc).items():
        key, item, k = index.items[i]
        least = math.ceil(coverage * len(item))
        if len({*q.tolist()}) * k < least:
            continue
        tiles = tile(doc, item, p, q, k)
        covered = sum(n for _, _, n in tiles)
        if covered >= least and tiles:
            yield key, covered, covered / len(item), tiles[0][2], len(tiles)


MATCH = "item_id long, n_words long, coverage double, longest long, n_tiles long"
MATCHED = ["item_id", "n_words", "coverage", "longest", "n_tiles"]


def whole_index(benchmark: DataFrame, most: int) -> Index | None:
    """The index of all items, if they have at most so many characters."""
    b = benchmark.select(F.col("item_id").cast("long"), "text")
    if (b.agg(F.sum(F.length("text"))).first()[0] or 0) > most:
        return None
    return Index([(r.item_id, r.text) for r in b.where(F.length("text") > 0).collect()])


def word_numbers(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words(text)), np.uint64)


def item_seeds(items: DataFrame, coverage: float) -> DataFrame:
    """seed, item, times (places of the item that have it), need (places that have to be shared at least), of items
    (item, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                found = []
                for item, text in zip(b.column("item").to_pylist(), b.column("text").to_pylist()):
                    ids = word_numbers(text)
                    if len(ids) >= LEAST_ITEM:
                        k = min(MIN_TILE, len(ids))
                        seeds, times = np.unique(hashes(ids, k) * BASE + np.uint64(k), return_counts=True)
                        found += [(int(x), item, int(n), -(-math.ceil(coverage * len(ids)) // k)) for x, n in zip(seeds.view(np.int64), times)]
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(4)], ["seed", "item", "times", "need"])

    return items.select("item", "text").mapInArrow(run, "seed long, item long, times long, need long")


def candidates(docs: DataFrame, items: DataFrame, coverage: float) -> DataFrame:
    """row, item: documents (row, text) and items (item, text) that share enough seeds."""
    seeds = materialise(item_seeds(items, coverage), "seeds")
    bits = np.zeros(SLOTS, bool)
    bits[gathered(seeds.select(F.pmod("seed", F.lit(SLOTS)).cast("int").alias("slot")).distinct(), {"slot": "i4"})[0]] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bits, bitorder="little"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                rows, found = [], []
                for row, text in zip(b.column("row").to_pylist(), b.column("text").to_pylist()):
                    ids = word_numbers(text)
                    own = distinct(np.concatenate([hashes(ids, k) * BASE + np.uint64(k) for k in range(LEAST_ITEM, MIN_TILE + 1)])).view(np.int64)
                    slot = own & (SLOTS - 1)
                    own = own[(shared.value[slot >> 3] >> (slot & 7)) & 1 == 1]
                    found.append(own)
                    rows.append(np.full(len(own), row, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (rows, found)], ["row", "seed"])

    met = docs.select("row", "text").mapInArrow(tidy(run), "row long, seed long").join(seeds, "seed")
    return met.groupBy("row", "item").agg(F.sum("times").alias("n"), F.first("need").alias("need")).where("n >= need").select("row", "item")


def matches_by_join(docs: DataFrame, benchmark: DataFrame, coverage: float) -> DataFrame:
    """row, doc_id and the columns of a match, for docs (row, doc_id, text)."""
    items = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long"), "text")
    pairs = materialise(candidates(docs, items, coverage), "pairs")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                found = []
                for i, (text, item_id, item) in enumerate(zip(*(b.column(c).to_pylist() for c in ("text", "item_id", "item_text")))):
                    found += [(i, *m) for m in contained(Index([(item_id, item)]), text, coverage)]
                yield matched(b, ["row", "doc_id"], found)

    joined = pairs.join(items.withColumnRenamed("text", "item_text"), "item").join(docs, "row").select("row", "doc_id", "text", "item_id", "item_text")
    return joined.mapInArrow(tidy(run), f"row long, doc_id {kind}, {MATCH}")


def matched(b: pa.RecordBatch, keep: list[str], found: list[tuple]) -> pa.RecordBatch:
    """The columns to keep of each match's row, and the match."""
    types = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
    at = pa.array([f[0] for f in found], pa.int64())
    return pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in keep), *(pa.array([f[k + 1] for f in found], t) for k, t in enumerate(types))], [*keep, *MATCHED])


def matches(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, index_chars: int = INDEX_CHARS) -> DataFrame:
    """A row for each document and item in it: doc_id, item_id, words covered, their share, longest tile, tiles."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    index = whole_index(benchmark, index_chars)
    if index is None:
        return matches_by_join(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), benchmark, coverage).drop("row")
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                yield matched(b, ["doc_id"], [(i, *m) for i, text in enumerate(b.column("text").to_pylist()) for m in contained(shared.value, text, coverage)])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, {MATCH}")


def drop_matched(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, index_chars: int = INDEX_CHARS) -> DataFrame:
    """docs without the rows that hold an item. With an index a row is judged where it is; else the rows to go are joined
    back by their place."""
    index = whole_index(benchmark, index_chars)
    if index is None:
        row = free_name(docs, "row")
        placed = docs.withColumn(row, F.monotonically_increasing_id())
        gone = matches_by_join(placed.select(F.col(row).alias("row"), "doc_id", "text"), benchmark, coverage).select(F.col("row").alias(row)).distinct()
        return placed.join(gone, row, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                clean = [next(contained(shared.value, text, coverage), None) is None for text in b.column("text").to_pylist()]
                yield b.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
