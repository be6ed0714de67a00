"""Document fingerprints: context-triggered piecewise hashing.

A rolling hash over seven bytes ends a chunk where it falls below a bound, so that boundaries move with the content. The
block size is the smallest power of two at which a text has at most 63 boundaries; a fingerprint has the block size and
a signature, one letter a chunk, for it, its double and its fourfold. Likeness is 1 less the edit distance of two
signatures of the same block size over the longer one's length, the best of all block sizes that both have and at which
their signatures share RUN letters in a row, as a few letters are equal by chance; 0 if none, 1 for equal fingerprints.

Defined results: a null text is empty, its fingerprint has empty signatures and is like an empty text only; equal texts
have equal fingerprints; texts of any length have one row. Documents follow each other by descending doc_id, null ids
last, those of one id by a hash of their place in the input, so that no id is too frequent for a task; after the last
comes the first. Rows have to come in one order each time they are read, as those of files do. Repeated rows stay. Other
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnmill.llm.common import partitions, tidy

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
CODE = np.zeros(128, np.int64)
CODE[[ord(c) for c in LETTERS]] = np.arange(64)
WINDOW, MOST, LEVELS, RUN = 7, 63, 3, 5
#: Bytes of text for a task.
TASK_BYTES = 32_000_000
MULTIPLIER, MIXER = 0x01000193, 0x85EBCA6B
#: Pairs compared at once.
PAIRS = 2048


def rolling(data: bytes) -> np.ndarray:
    """At each byte a well-mixed 32-bit hash of the last seven bytes."""
    x = np.zeros(len(data) + WINDOW - 1, np.uint32)
    x[WINDOW - 1 :] = np.frombuffer(data, np.uint8)
    x += np.uint32(1)
    h = np.zeros(len(data), np.uint32)
    for k in range(WINDOW):
        h *= np.uint32(MULTIPLIER)
        h += x[k : k + len(data)]
    h ^= h >> np.uint32(15)
    h *= np.uint32(MIXER)
    h ^= h >> np.uint32(13)
    return h


def fingerprint(text: str) -> str:
    data = text.encode("utf-8", "surrogatepass")
    h = rolling(data)
    size = 1
    bound = h
    at = np.arange(len(data))
    while len(at) > MOST:
        size *= 2
        keep = bound < (1 << 32) // size
        at, bound = at[keep], bound[keep]
    signatures = []
    for k in range(LEVELS):
        if k:
            keep = bound < (1 << 32) // (size << k)
            at, bound = at[keep], bound[keep]
        cuts = [0, *(at + 1).tolist()]
        if cuts[-1] < len(data):
            cuts.append(len(data))
        signatures.append("".join([LETTERS[zlib.crc32(data[i:j]) >> 26] for i, j in zip(cuts, cuts[1:])]))
    return f"{size}:{':'.join(signatures)}"


def edit_distance(a: list[str], b: list[str]) -> np.ndarray:
    """Levenshtein distances of many pairs of signatures, non-empty and of at most 64 letters, by bit vectors."""
    n, one = len(a), np.uint64(1)
    la, lb = np.array([*map(len, a)]), np.array([*map(len, b)])
    rows = np.arange(n)
    has = np.zeros((n, 65), np.uint64)
    for k in range(la.max(initial=0)):
        on = rows[la > k]
        has[on, CODE[[ord(a[i][k]) for i in on.tolist()]]] |= one << np.uint64(k)
    other = np.full((n, lb.max(initial=0)), 64)
    for i, s in enumerate(b):
        other[i, : len(s)] = CODE[np.frombuffer(s.encode(), np.uint8)]
    up, down, score = np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64), la.copy()
    last = (la - 1).astype(np.uint64)
    for j in range(other.shape[1]):
        eq = has[rows, other[:, j]]
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | ~(xh | up), up & xh
        live = lb > j
        score += np.where(live, ((ph >> last) & one).astype(np.int64) - ((mh >> last) & one).astype(np.int64), 0)
        ph, mh = (ph << one) | one, mh << one
        up, down = mh | ~(xv | ph), ph & xv
    return score


def share_a_run(a: str, b: str) -> bool:
    return not {a[i : i + RUN] for i in range(len(a) - RUN + 1)}.isdisjoint([b[i : i + RUN] for i in range(len(b) - RUN + 1)])


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """0 to 1 for each pair of fingerprints."""
    best = np.array([float(x == y) for x, y in zip(left, right)])
    who, a, b = [], [], []
    for i, (x, y) in enumerate(zip(left, right)):
        if x != y:
            s, *xs = x.split(":")
            t, *ys = y.split(":")
            shift = int(t).bit_length() - int(s).bit_length()
            for k, sig in enumerate(xs):
                if 0 <= k - shift < LEVELS and share_a_run(sig, ys[k - shift]):
                    who.append(i), a.append(sig), b.append(ys[k - shift])
    for i in range(0, len(who), PAIRS):
        x, y = a[i : i + PAIRS], b[i : i + PAIRS]
        longer = np.maximum([*map(len, x)], [*map(len, y)])
        np.maximum.at(best, who[i : i + PAIRS], 1 - edit_distance(x, y) / longer)
    return best


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
NAMES = [x.split()[0] for x in RESULT.split(", ")]


class Buckets:
    """Numbers of runs of neighbours, by descending id and tie. cuts: ids, one as often as runs begin at it; of an id that
    several begin at, and of null ids, each has a range of ties."""

    def __init__(self, cuts: list[int], of_null: int):
        self.cuts, self.times = np.unique(np.array(cuts, np.int64), return_counts=True)
        self.starts = np.concatenate(([0], np.cumsum(self.times[::-1] + 1)))  # of the buckets from the last cut on
        self.of_null = of_null

    def part(self, tie: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """Which of n equal ranges has each tie, the highest first."""
        return np.minimum(((1 - (tie.astype(np.float64) + 2.0**63) / 2.0**64) * n).astype(np.int64), np.asarray(n) - 1)

    def __call__(self, ids: pa.Array, tie: np.ndarray) -> np.ndarray:
        known = np.asarray(ids.is_valid())
        x = np.asarray(ids.fill_null(0))
        above = len(self.cuts) - np.searchsorted(self.cuts, x, side="right")  # cuts beyond x
        n = np.concatenate((self.times[::-1], [1]))[above]
        at = np.concatenate((self.cuts[::-1], [0]))[above]
        split = (above < len(self.cuts)) & (at == x) & (n > 1)
        bucket = self.starts[above] + np.where(split, 1 + self.part(tie, n), 0)
        return np.where(known, bucket, self.starts[-1] + 1 + self.part(tie, max(1, self.of_null)))


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """docs dealt into runs of neighbours: bucket (by descending doc_id and tie), borrowed (true: the first document of
    the next run, lent to this one), doc_id, tie and text. One shuffle; only a few bounds and one id for each run go
    through the driver."""
    docs = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.monotonically_increasing_id()).alias("tie"), F.coalesce("text", F.lit("")).alias("text"))
    n, nulls, cuts = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull()), F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 100 * parts)).first()
    bucket = Buckets(cuts or [], -(-parts * nulls // max(1, n)))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(bucket(b.column(0), np.asarray(b.column(1))), pa.int64()), b.column(0), b.column(1)], ["bucket", "doc_id", "tie"])

    heads = docs.select("doc_id", "tie").mapInArrow(first, "bucket long, doc_id long, tie long").groupBy("bucket").agg(F.max(F.struct("doc_id", "tie")).alias("h"))
    heads = {r.bucket: tuple(r.h) for r in heads.collect()}
    full = sorted(heads)
    lend = {heads[k]: full[i - 1] for i, k in enumerate(full)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ties, n = b.column("doc_id"), b.column("tie"), b.num_rows
            lent = [(i, to) for i, x in enumerate(zip(ids.to_pylist(), ties.to_pylist())) if (to := lend.get(x)) is not None]
            take = pa.array([*range(n), *(i for i, _ in lent)], pa.int64())
            to = np.concatenate([bucket(ids, np.asarray(ties)), np.array([k for _, k in lent], np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array([False] * n + [True] * len(lent)), ids.take(take), ties.take(take), b.column("text").take(take)], ["bucket", "borrowed", "doc_id", "tie", "text"])

    return docs.mapInArrow(deal, "bucket long, borrowed boolean, doc_id long, tie long, text string")


def fingerprint_neighbours(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likenesses; the text half is the next document's. parts:
    how many tasks; by default as many as the texts' size asks for, and the session's number of partitions at least."""
    if parts is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(partitions(docs.sparkSession), -(-size // TASK_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waits: tuple | None = None  # bucket, id, text, fingerprint
        for whole in batches:
            out: list[tuple] = []
            for k, lent, i, text in zip(*(whole.column(c).to_pylist() for c in ("bucket", "borrowed", "doc_id", "text"))):
                if lent and (waits is None or waits[0] != k):
                    continue
                own = fingerprint(text)
                if waits is not None and waits[0] == k:
                    out.append((*waits[1:], text, own))
                waits = None if lent else (k, i, text, own)
                if len(out) >= 1000:
                    yield scored(out)
                    out = []
            if out:
                yield scored(out)

    def scored(rows: list[tuple]) -> pa.RecordBatch:
        ids, texts, own, after, next_own = zip(*rows)
        edited = [t[: len(t) - len(t) // 2] + a[: len(t) // 2] for t, a in zip(texts, after)]
        changed = [fingerprint(t) for t in edited]
        digest = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]
        columns = [pa.array(ids, pa.int64()), pa.array([*map(len, texts)], pa.int64()), pa.array(digest), pa.array(own), pa.array(changed), pa.array(likeness(own, changed)), pa.array(likeness(own, next_own))]
        return pa.RecordBatch.from_arrays(columns, NAMES)

    order = ["bucket", "borrowed", F.col("doc_id").desc_nulls_last(), F.col("tie").desc()]
    return with_next(docs, parts).repartition(parts, "bucket").sortWithinPartitions(*order).mapInArrow(tidy(run), RESULT)
