"""N-gram Jaccard join: size-banded tiles, bitmap signatures, exact intersection.

Documents with one set of shingles form a class; everything below works on classes.

Tiles. Two sets of the wanted similarity share a shingle among the first few of each, in any order of shingles that both
use: as many as may differ, and one. The order here puts shingles that many documents share last, so tiles stay small.
What is common is told by a bitmap of fixed size, filled from counts over all texts; which shingles it marks changes the
work, not the result. A tile holds the classes that have one such shingle, in order of
size: a class can only match those whose size is within the band that its own size allows.

Needed tiles. Of the first few of the set whose first few end earlier, the other set has all that both share; as what
comes after can't make up for more than its own number, two similar sets meet in at least as many tiles as their overlap
exceeds that number: about half of them if their sizes are equal, one if their sizes are as far apart as can be. Each row
of a tile knows the least number that any class of its band there asks for. A class that has fewer such tiles than each
of them asks for leaves them, which clears away what met by chance, without looking at a single pair. And the first
shingle that two similar sets share can't lie beyond what may differ, so pairs are looked for up to there alone.

Bitmaps. Each class has a signature of four to eight bits a shingle, one to two if it is large, one set for each shingle's hash; of two signatures the
longer one is folded. Bits that one has and the other lacks stand for shingles that are not shared, which bounds the
overlap from above; pairs whose bound is too low go no further.

Intersection. What is left is decided by intersecting the sorted arrays of both sets.

Groups of copies. A class is first compared with one other alone, its hub: of the classes of about its size in its tiles
and of another component, the one that meets most others there, as the original of a group of copies does. That links
large groups by as many pairs as they have members, and is repeated while it links many. Then, only tiles in which more
than one component is left are looked at again, and there only pairs of different components are compared: at first
the few others that a class's bitmap comes nearest to, then more, and at last all that are still apart and not compared
yet. No pair of classes that could join two components is left out, so the components are those of all links.

Words, shingles and classes are told apart by 64-bit hashes. Two of n different ones are taken for one with a chance of
about n^2 / 2^65: below 1e-3 for a hundred million classes; one shingle taken for another can only change a link that
hangs on a single shingle.

Defined results: words are runs of other than space and U+0009 to U+000D, A-Z in lower case; with fewer words than a
shingle the whole sequence is one shingle; a null or empty text, or one of white space alone, has none and is linked
with nothing; repeated rows are linked; a row of a null id keeps the least id of its component, null if there is none;
other columns are ignored by join() and kept by keep_one(), whatever their names; empty tables give empty tables.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnmill.llm.common import ODD, WORD, distinct, forget, free_name, gathered, materialise, mix, partitions, slices, word_hashes, tidy
from tarnmill.llm.components import components

#: The bitmap of common shingles: its slots, the blocks of them, and the count that marks one: so many texts, and so many
#: roots of the count, more than meet a slot by chance.
SLOTS, BLOCKS, OFTEN, SPREAD = 1 << 23, 1 << 11, 3, 4
#: The filter of classes that are needed again, which only spares work: its slots.
FILTER = 1 << 24
#: Pairs of a tile that are compared at once.
BLOCK = 1 << 18
#: Sets up to this size have longer signatures.
FINE = 512
#: Hubs are tried again while one try in so many gives a link.
MANY = 16
#: So many nearest others of a class in a tile are compared in a round; the last round takes all.
ROUNDS = (4, 64, None)


def shingles(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    w = word_hashes(text) if text else np.empty(0, np.uint64)
    if not len(w):
        return w
    n = min(width, len(w))
    h = np.full(len(w) - n + 1, np.uint64(n))
    for j in range(n):
        h = mix(h * ODD + w[j : len(w) - n + 1 + j])
    return distinct(h)


def class_of(s: np.ndarray) -> int:
    """One number for a set, from sums and products that depend on all of it."""
    place = np.arange(1, len(s) + 1, dtype=np.uint64)
    return int(mix(np.array([np.sum(mix(s * ODD + place), dtype=np.uint64) + np.uint64(len(s))]))[0].view(np.int64))


def signature(s: np.ndarray) -> list[int]:
    """Bits by the lowest places of each hash, in 64-bit numbers: a power of two of them, four a shingle or more for sets
    of up to FINE shingles, one a shingle or more beyond."""
    n = 1 << max(1, (max(min(4 * len(s), 4 * FINE), len(s)) - 1).bit_length() - 6)
    bits = np.zeros(n * 64, bool)
    bits[(s & np.uint64(n * 64 - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(np.int64).tolist()


def first_few(s: np.ndarray, percent: int, common: np.ndarray) -> np.ndarray:
    """The shingles of a set by which it can be found: common ones last, else by hash."""
    n = len(s) - (percent * len(s) + 99) // 100 + 1
    mixed = mix(s)
    slot = (s % np.uint64(8 * len(common))).astype(np.int64)
    order = np.lexsort((mixed, (common[slot >> 3] >> (slot & 7)) & 1))
    return s[order[:n]]


def similar(shared: Column, a: Column, b: Column, percent: int) -> Column:
    return shared * 100 >= (a + b - shared) * percent


def sets(b: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """The row's place and set, of rows that have one."""
    for i, text in enumerate(b.column("text")):
        s = shingles(text.as_py(), width)
        if len(s):
            yield i, s


def slot_of() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(FILTER)).cast("long")


def common_shingles(docs: DataFrame, width: int) -> np.ndarray:
    """The bitmap of slots whose shingles many texts have, from counts over all texts in a fixed number of slots. A task
    counts the texts that meet a slot, copies once, and tasks' counts are added up by blocks of slots. What meets a slot by
    chance is told by the median of its block; as counts are only ever too high, a shingle with a count beyond what marks
    is always marked."""
    n_slots, wide = SLOTS, SLOTS // BLOCKS
    names = ["block", "at", "n"]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        counts = np.zeros((n_slots // wide, wide), np.int32)
        flat = counts.reshape(-1)
        for whole in batches:
            for b in slices(whole, "text"):
                for h, text in zip(b.column("h").to_pylist(), b.column("text")):
                    if h not in seen:
                        seen.add(h)
                        flat[(shingles(text.as_py(), width) % np.uint64(n_slots)).astype(np.int64)] += 1
        rows = []
        for block, x in enumerate(counts):
            at = np.flatnonzero(x)
            if len(at):
                n = x[at]
                rows.append((block, at.astype(np.uint16).tobytes(), n.astype(np.uint8 if n.max() < 256 else np.int32).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*zip(*rows)] or [[]] * 3, (pa.int32(), pa.binary(), pa.binary()))], names)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, at, n in zip(*(b.column(c).to_pylist() for c in names)):
                one_byte = len(n) * 2 == len(at)
                sums.setdefault(block, np.zeros(wide, np.int64))[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.uint8 if one_byte else np.int32)
        for block, x in sums.items():
            chance = np.median(x)
            bits = np.packbits(x >= OFTEN + chance + SPREAD * math.sqrt(chance), bitorder="little")
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["block", "bits"])

    counts = docs.select(F.xxhash64("text").alias("h"), "text").mapInArrow(tidy(counted), "block int, at binary, n binary")
    common = np.zeros((n_slots // wide, wide // 8), np.uint8)
    for r in counts.repartition(partitions(docs.sparkSession), "block").mapInArrow(tidy(marked), "block int, bits binary").collect():
        common[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return common.reshape(-1)


def classes(docs: DataFrame, width: int, percent: int, *ids: str) -> DataFrame:
    """The ids, slot (where the filter of rows has doc_id), class (null without shingles), size, and for one row of a
    class a task its bits and keys, the shingles by which it is found."""
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, width))
    keep = [docs.schema[c] for c in ids]
    lists = [T.StructField(c, T.ArrayType(T.LongType())) for c in ("bits", "keys")]
    schema = T.StructType([*keep, T.StructField("slot", T.LongType()), T.StructField("class", T.LongType()), T.StructField("size", T.LongType()), *lists])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for b in slices(whole, "text"):
                what: list[tuple] = [(None, 0, None, None)] * b.num_rows
                for i, s in sets(b, width):
                    c = class_of(s)
                    what[i] = (c, len(s), None, None) if c in seen else (c, len(s), signature(s), first_few(s, percent, shared.value).view(np.int64))
                    seen.add(c)
                columns = [pa.array([w[k] for w in what], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())))]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ids), b.column("slot"), *columns], [*ids, "slot", "class", "size", "bits", "keys"])

    return docs.select(*ids, slot_of().alias("slot"), "text").mapInArrow(tidy(run), schema)


def by_key(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[dict[str, pa.Array]]:
    """Rows that come in order of key, regrouped so that no tile is cut."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        key = np.asarray(b.column("key"))
        start = int(np.searchsorted(key, key[-1]))
        if start or (held and held[-1].column("key")[-1].as_py() != key[0]):
            t = pa.Table.from_batches([*held, b.slice(0, start)]).combine_chunks()
            held = []
            if t.num_rows:
                yield {n: t[n].combine_chunks() for n in names}
        held.append(b.slice(start))
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield {n: t[n].combine_chunks() for n in names}


def overlap(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """How many shingles similar sets of sizes a and b share at least."""
    return -(-percent * (a + b) // (100 + percent))


def meetings(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """In how many tiles similar sets of sizes a and b meet at least, less one for rounding."""
    return np.maximum(1, overlap(a, b, percent) + (-percent * np.maximum(a, b)) // 100)


def band(key: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows in order of key and size: the first and last row of the same key whose size each row's allows."""
    group = np.cumsum(np.concatenate(([False], key[1:] != key[:-1]))) << 40
    place = group + size
    return np.searchsorted(place, group - (-percent * size) // 100), np.searchsorted(place, group + 100 * size // percent, "right") - 1


def tiles(rows: DataFrame, percent: int) -> DataFrame:
    """From key, rank (its place in the class's order), class, size: the keys that two classes of a band have, where the
    class has as many tiles as their bands ask for; and for each row first, whether the key can be the first that the
    class shares, and met, the class's tiles in a million of its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_key(batches, ["key", "rank", "class", "size"]):
            key, rank, who, size = (np.asarray(t[c]) for c in ("key", "rank", "class", "size"))
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (who[1:] != who[:-1])))
            key, rank, who, size = key[new], rank[new], who[new], size[new]
            low, high = band(key, size, percent)
            at = np.flatnonzero(low < high)
            low, high = low[at], high[at]
            # Fewest tiles are asked for by the smallest and the largest other class of the band.
            least, most = size[np.where(low == at, low + 1, low)], size[np.where(high == at, high - 1, high)]
            need = np.minimum(meetings(size[at], least, percent), meetings(size[at], most, percent))
            first = rank[at] <= size[at] - overlap(size[at], least, percent)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (key[at], rank[at], who[at], size[at], need)), pa.array(first)], ["key", "rank", "class", "size", "need", "first"])

    n = partitions(rows.sparkSession)
    met = rows.repartition(n, "key").sortWithinPartitions("key", "size", "class").mapInArrow(tidy(run), "key long, rank long, class long, size long, need long, first boolean")
    of_class = Window.partitionBy("class")
    have = met.withColumn("have", F.row_number().over(of_class.orderBy("need")).cast("long"))
    most = F.max(F.when(F.col("need") <= F.col("have"), F.col("have"))).over(of_class)
    return have.withColumn("most", most).where("need <= most").select("key", "rank", "class", "size", "first", F.expr("most * 1000000 div size").alias("met"))


def hubs(rows: DataFrame, percent: int, shift: float) -> DataFrame:
    """From rows key, class, size, met, label: distinct pairs (u, v), for each class one with a hub of another component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def counted() -> np.ndarray:
            pairs, n = np.unique(np.concatenate([h[:2] for h in held], axis=1), axis=1, return_inverse=True)
            return np.vstack((pairs, np.bincount(n.ravel(), np.concatenate([h[2] for h in held])).astype(np.int64)))

        for t in by_key(batches, ["key", "class", "size", "met", "label"]):
            key, who, size, met, label = (np.asarray(t[c]) for c in ("key", "class", "size", "met", "label"))
            cell = np.floor(np.log(size) / math.log(100 / percent) + shift).astype(np.int64)
            order = np.lexsort((who, -met, cell, key))
            key, who, label, cell = key[order], who[order], label[order], cell[order]
            starts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1]))))
            group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(key))))
            top = starts[group]
            other = np.where(label != label[top], np.arange(len(key)), len(key))
            second = np.minimum.reduceat(other, starts)[group]  # the best of another component than the best one's
            hub = np.where(label != label[top], top, second)
            on = np.flatnonzero(hub < len(key))
            held.append(np.stack((who[on], who[hub[on]], np.ones(len(on), np.int64))))
            if sum(h.shape[1] for h in held) > BLOCK:
                held = [counted()]
                if held[0].shape[1] > BLOCK // 2:
                    yield pa.RecordBatch.from_arrays([*map(pa.array, held.pop())], ["class", "hub", "n"])
        if held:
            yield pa.RecordBatch.from_arrays([*map(pa.array, counted())], ["class", "hub", "n"])

    n = partitions(rows.sparkSession)
    met = rows.repartition(n, "key").sortWithinPartitions("key").mapInArrow(tidy(run), "class long, hub long, n long")
    best = met.groupBy("class", "hub").agg(F.sum("n").alias("n")).groupBy("class").agg(F.max(F.struct("n", "hub")).alias("best"))
    return best.select(F.greatest("class", "best.hub").alias("u"), F.least("class", "best.hub").alias("v")).distinct()


def bound(a: Column, b: Column, size_a: Column, size_b: Column) -> Column:
    """At most so many shingles are shared."""
    fold = lambda x, y: F.when(F.size(x) > F.size(y), F.zip_with(F.slice(x, F.lit(1), F.size(y)), F.slice(x, F.size(y) + 1, F.size(y)), lambda p, q: p.bitwiseOR(q))).otherwise(x)
    only = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q))).cast("long")), F.lit(0).cast("long"), lambda s, n: s + n)
    x, y = fold(a, b), fold(b, a)
    return F.least(size_a - only(x, y), size_b - only(y, x))


def verify(pairs: DataFrame, of_doc: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Of distinct pairs (u, v), those that are similar: first by their bitmaps, then by intersecting their sets. Sets are
    worked out again, for one row of each class that a pair needs; a filter of fixed size tells which rows those are."""
    bits = of_doc.where("bits is not null").groupBy("class").agg(F.first("size").alias("size"), F.first("bits").alias("bits"))
    one = lambda x: bits.select(F.col("class").alias(x), F.col("size").alias(f"{x}_size"), F.col("bits").alias(f"{x}_bits"))
    p = pairs.join(one("u"), "u").join(one("v"), "v")
    # Sizes that no band allows would fold more than once.
    fit = (F.col("u_size") * 100 >= F.col("v_size") * percent) & (F.col("v_size") * 100 >= F.col("u_size") * percent)
    p = materialise(p.where(fit).where(similar(bound(F.col("u_bits"), F.col("v_bits"), F.col("u_size"), F.col("v_size")), F.col("u_size"), F.col("v_size"), percent)).select("u", "v"), "pairs")
    ends = p.select(F.col("u").alias("class")).unionByName(p.select(F.col("v").alias("class"))).distinct()
    slots = of_doc.join(ends, "class").groupBy("class").agg(F.min("slot").alias("slot")).select("slot").distinct()
    marks = np.zeros(FILTER, bool)
    marks[gathered(slots, {"slot": "i8"})[0]] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(marks, bitorder="little"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            slot = np.asarray(whole.column("slot"))
            for b in slices(whole.filter(pa.array((shared.value[slot >> 3] >> (slot & 7)) & 1 == 1)), "text"):
                found = []
                for _, s in sets(b, width):
                    if (c := class_of(s)) not in seen:
                        seen.add(c)
                        found.append((c, s.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.binary())], ["class", "set"])

    needed = docs.select(slot_of().alias("slot"), "text").mapInArrow(tidy(run), "class long, set binary").groupBy("class").agg(F.first("set").alias("set"))

    @F.pandas_udf("long")
    def intersection(a, b):
        import pandas as pd

        return pd.Series([len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(a, b)], dtype="int64")

    both = p.join(needed.select(F.col("class").alias("u"), F.col("set").alias("a")), "u").join(needed.select(F.col("class").alias("v"), F.col("set").alias("b")), "v")
    size = lambda c: (F.octet_length(c) / 8).cast("long")
    links = materialise(both.select("u", "v", intersection("a", "b").alias("n"), size("a").alias("x"), size("b").alias("y")).where(similar(F.col("n"), F.col("x"), F.col("y"), percent)).select("u", "v"), "links")
    forget(p)
    return links


def across(rows: DataFrame, percent: int, nearest: int | None) -> DataFrame:
    """From rows key, rank, class, size, label, bits of tiles with several components: the distinct pairs of different
    components in a tile whose sizes and bitmaps allow a link, for each row those of the highest bounds. A row is
    compared with the rows of its band only, a bounded number of pairs at once."""

    def ends(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs of each row with the rows from low to high, in blocks."""
        n = high - low
        first = 0
        while first < len(n):
            last = first + max(1, int(np.searchsorted(np.cumsum(n[first:]), BLOCK, "right")))
            if last == first + 1 and n[first] > BLOCK:
                for at in range(int(low[first]), int(high[first]), BLOCK):
                    there = np.arange(at, min(at + BLOCK, int(high[first])))
                    yield np.full(len(there), first), there
            else:
                m = n[first:last]
                here = np.repeat(np.arange(first, last), m)
                yield here, np.arange(len(here)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(low[first:last], m)
            first = last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_key(batches, ["key", "rank", "class", "size", "label", "bits"]):
            key, rank, who, size, label = (np.asarray(t[c]) for c in ("key", "rank", "class", "size", "label"))
            flat, at = np.asarray(t["bits"].flatten()).view(np.uint64), np.asarray(t["bits"].offsets)
            at = at - at[0]
            length = np.diff(at)

            def words(row: np.ndarray, n: int, most: int) -> np.ndarray:
                x = flat[at[row][:, None] + np.arange(n)]
                return x if n == most else x[:, :most] | x[:, most:]

            low, high = band(key, size, percent)
            found = []
            for x, y in ends(low, high + 1):
                least = overlap(size[x], size[y], percent)
                may = (label[x] != label[y]) & (rank[x] <= size[x] - least) & (rank[y] <= size[y] - least)
                x, y = x[may], y[may]
                most = np.zeros(len(x), np.int64)
                for n, m in {*zip(length[x].tolist(), length[y].tolist())}:
                    on = np.flatnonzero((length[x] == n) & (length[y] == m))
                    step = max(1, BLOCK * 8 // max(n, m))
                    for i in range(0, len(on), step):
                        j = on[i : i + step]
                        p, q = x[j], y[j]
                        a, b = words(p, n, min(n, m)), words(q, m, min(n, m))
                        most[j] = np.minimum(size[p] - np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64), size[q] - np.bitwise_count(b & ~a).sum(axis=1, dtype=np.int64))
                both = size[x] + size[y]
                ok = most * 100 >= (both - most) * percent
                x, y, near = x[ok], y[ok], (most / (both - most))[ok]
                if nearest is not None and len(x):
                    order = np.lexsort((y, -near, x))
                    x, y = x[order], y[order]
                    starts = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
                    few = np.arange(len(x)) - np.repeat(starts, np.diff(np.append(starts, len(x)))) < nearest
                    x, y = x[few], y[few]
                found.append(np.stack((who[x], who[y])))
                if sum(f.shape[1] for f in found) > BLOCK:
                    found = [np.unique(np.sort(np.concatenate(found, axis=1), axis=0), axis=1)]
            if found:
                pairs = np.unique(np.sort(np.concatenate(found, axis=1), axis=0), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0], pa.int64()), pa.array(pairs[1], pa.int64())], ["u", "v"])

    n = partitions(rows.sparkSession)
    return rows.repartition(n, "key").sortWithinPartitions("key", "size", "class").mapInArrow(tidy(run), "u long, v long").distinct()


def labelled(docs: DataFrame, width: int, percent: int, *ids: str) -> DataFrame:
    """The ids, size and label of every row; rows of one component share the label, which is null without shingles."""
    of_doc = materialise(classes(docs, width, percent, *ids), "classes")
    keys = of_doc.where("keys is not null").select(F.posexplode("keys").alias("rank", "key"), "class", "size").select("key", F.col("rank").cast("long"), "class", "size")
    shared = materialise(tiles(keys, percent), "tiles")
    labels: DataFrame | None = None

    def named(rows: DataFrame) -> DataFrame:
        """A class without links is a component by itself."""
        if labels is None:
            return rows.withColumn("label", F.col("class"))
        return rows.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))

    def linked(links: DataFrame) -> DataFrame:
        """The labels with some more links."""
        stars = links if labels is None else links.unionByName(labels.select(F.col("node").alias("u"), F.col("label").alias("v")).where("u <> v"))
        after = materialise(components(stars), "labels")
        if labels is not None:
            forget(labels)
        forget(links)
        return after

    for turn in itertools.count():
        tried = materialise(hubs(named(shared), percent, 0.5 * (turn % 2)), "hubs")
        links = verify(tried, of_doc, docs, width, percent)
        some = links.count()
        few = some * MANY < tried.count()
        forget(tried)
        labels = linked(links)
        if few or not some:
            break
    bits = of_doc.where("bits is not null").groupBy("class").agg(F.first("bits").alias("bits"))
    tested: DataFrame | None = None
    for nearest in ROUNDS:
        # Tiles that still hold several components.
        left = named(shared.where("first").select("key", "rank", "class", "size"))
        mixed = left.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
        pairs = materialise(across(left.join(mixed, "key", "left_semi").join(bits, "class"), percent, nearest), "pairs")
        if pairs.isEmpty():
            break
        fresh = pairs if tested is None else materialise(pairs.join(tested, ["u", "v"], "left_anti"), "pairs")
        if not fresh.isEmpty():
            labels = linked(verify(fresh, of_doc, docs, width, percent))
        tested = pairs if tested is None else tested.unionByName(pairs)
    forget(shared)
    of_class = of_doc.join(labels.withColumnRenamed("node", "class"), "class", "left")
    return of_class.select(*ids, "size", F.coalesce("label", "class").alias("label"))


def join(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id: the least doc_id that links reach."""
    d = labelled(docs, width, percent, "doc_id")
    least = d.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("least"))
    return d.join(least, "label", "left").select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component, that of the least doc_id, and with all rows that have no words. Texts are
    shuffled once, and only those that have words."""
    names = docs.columns
    row = free_name(docs, "row")
    some = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    content = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.xxhash64("text").cast("string"))
    keyed = docs.where(some).withColumn(row, content)
    d = labelled(keyed.select("doc_id", row, "text"), width, percent, "doc_id", row)
    first = d.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row)).alias("first")).select(F.col("first")[row].alias(row))
    one = keyed.join(first, row).dropDuplicates([row])
    return docs.where(~some).unionByName(one.select(*(F.col(f"`{n}`") for n in names)))
