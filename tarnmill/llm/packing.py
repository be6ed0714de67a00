"""Packing of token ids into sequences of fixed length: bounded-space best fit, online, a partition at a time.

A task keeps a fixed number of open windows. A piece goes to the window that it fills best; if it fits into none and no
more may be opened, the fullest is emitted, and its gap is filled with the piece's head unless it is too short to be worth
a cut. Full stretches of long documents are sequences at once. What is still open at the end of a task is left over;
leftovers of some tasks are packed the same way by fewer tasks, in rounds, until one round has a single group, whose last
sequence is cut at powers of two, which need no padding. Every round is a written table, so a lost executor costs one task.

Defined results: a null or empty text is the end id alone; texts of any length are cut into as many pieces as they need;
repeated rows are packed each; other columns of the input may have any names; an empty table gives no pieces.
"""

from __future__ import annotations

import gc
import os
import re
import struct
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnmill.llm.bpe import LETTERS, NUMBERS, SPACE, byte_letters
from tarnmill.llm.common import materialise, slices, tidy

LENGTH, OPEN, FAN = 2048, 32, 64
#: A gap of fewer tokens is padded: a document isn't cut for it.
SHORTEST = 16
#: Pieces that a worker keeps, twice, and the longest of them; letters of a text that are split at once.
CACHED_PIECES, LONG_PIECE, STRETCH = 300_000, 64, 1 << 20
BLANK = re.compile(r"[\x20\x09-\x0D]")
#: The alternatives of the pre-tokenizer's pattern, below U+0300 but for U+0130, where normal forms change
#: nothing and lower case is one letter for one.
PIECES_OF = re.compile(rf"[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{NUMBERS}]|[^{SPACE}{LETTERS}{NUMBERS}]+")
ASCII_PIECES = re.compile(r"[a-z]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\t-\r a-z0-9]+")
BEYOND = re.compile("[\u0130\u0300-\U0010ffff]")
MIXED = re.compile(rf"[^\x20\x09-\x0D]*{BEYOND.pattern}[^\x20\x09-\x0D]*|'(?:[sS]|[tT]|[rR][eE]|[vV][eE]|[mM]|[lL][lL]|[dD])|[{LETTERS}]+|[{NUMBERS}]|[^{SPACE}{LETTERS}{NUMBERS}]+")
#: sequence_id has the round and the task above these bits.
LOCAL, TASK = 30, 26
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
ALL = PIECES + ", open boolean, task long"


def pieces_of(text: str) -> list[str]:
    """The pieces in which the tokenizer's normalizer and pre-tokenizer leave a text, or words that only the library can
    split: those with letters of which Unicode versions or rules of lower case differ."""
    if text.isascii():
        return ASCII_PIECES.findall(text.lower())
    if not BEYOND.search(text):
        return PIECES_OF.findall(text.lower())
    return [x if BEYOND.search(x) else x.lower() for x in MIXED.findall(text)]


class Known(dict):
    """The ids of pieces, as little-endian 32-bit numbers, worked out when they are first asked for. Two generations are
    kept: what was asked for since the last change of generation, and before it."""

    def __init__(self, library):
        self.library, self.tokenize, self.older = library, library.model.tokenize, {}
        self.letters = dict(enumerate(byte_letters()))

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            if piece.isascii() and piece.isprintable():  # such letters stand for their own bytes
                found = [t.id for t in self.tokenize(piece)]
            elif BEYOND.search(piece):
                found = self.library.encode(piece, add_special_tokens=False).ids
            else:
                found = [t.id for t in self.tokenize(piece.encode().decode("latin-1").translate(self.letters))]
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(piece) <= LONG_PIECE:
            self[piece] = ids
        return ids

    def age(self) -> None:
        if len(self) > CACHED_PIECES:
            self.older = dict(self)
            self.clear()

    def forget(self) -> None:
        self.older = {}
        self.clear()


class Encoder:
    """Ids of texts by the tokenizer file whose words have ends: as no merge reaches beyond a piece, distinct pieces are
    encoded once by the library's model and kept, up to a bound; texts with a special token's string go to it whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one core's; idle threads of the library would spin
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.known = Known(self.library)

    def encode(self, text: str) -> bytes:
        """A text's ids as little-endian 32-bit numbers."""
        if any(s in text for s in self.special):
            ids = self.library.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        out = []
        for part in stretches(text):
            out.append(b"".join(map(self.known.__getitem__, pieces_of(part))))
            self.known.age()
        return b"".join(out)


def stretches(text: str) -> Iterator[str]:
    """A long text in parts that end at white space."""
    i = 0
    while len(text) - i > STRETCH and (blank := BLANK.search(text, i + STRETCH)):
        yield text[i : blank.start()]
        i = blank.start()
    yield text[i:]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(path)


class Packer:
    """The open windows of one task, by gap. A piece is (doc_id, start, ids, doc_tokens); add() and close() give finished
    pieces (doc_id, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, length: int = LENGTH, most: int = OPEN):
        self.length, self.most, self.made = length, most, 0
        self.gaps: list[tuple[int, int]] = []
        self.inside: dict[int, list[tuple]] = {}

    def new(self) -> int:
        self.made += 1
        return self.made - 1

    def put(self, window: int, gap: int, piece: tuple) -> list[tuple]:
        """A piece goes to the end of a window; the window if that fills it."""
        doc, start, ids, total = piece
        held = self.inside.setdefault(window, [])
        held.append((doc, start, ids, total, window, self.length - gap))
        gap -= len(ids) // 4
        if gap:
            insort(self.gaps, (gap, window))
            return []
        return self.inside.pop(window)

    def add(self, doc: int | None, start: int, ids: bytes, total: int) -> Iterator[tuple]:
        size = 4 * self.length
        whole = len(ids) - len(ids) % size
        for i in range(0, whole, size):
            yield doc, start + i // 4, ids[i : i + size], total, self.new(), 0
        start, ids = start + whole // 4, ids[whole:]
        while ids:
            n = len(ids) // 4
            at = bisect_left(self.gaps, (n, -1))
            if at < len(self.gaps):
                gap, window = self.gaps.pop(at)
                yield from self.put(window, gap, (doc, start, ids, total))
                return
            if len(self.gaps) < self.most:
                yield from self.put(self.new(), self.length, (doc, start, ids, total))
                return
            gap, window = self.gaps.pop(0)
            if gap < SHORTEST:
                yield from self.inside.pop(window)
            else:
                yield from self.put(window, gap, (doc, start, ids[: 4 * gap], total))
                start, ids = start + gap, ids[4 * gap :]

    def left(self) -> Iterator[tuple]:
        """The pieces of windows that are open still."""
        for _, window in self.gaps:
            yield from self.inside.pop(window)
        self.gaps = []

    def close(self) -> Iterator[tuple]:
        """All that is open, with as few sequences as can hold it: the fullest windows are filled from the emptiest, and the
        last one is cut at powers of two."""
        fullest = [w for _, w in self.gaps]
        rows = {w: self.inside.pop(w) for w in fullest}
        used = {w: sum(len(r[2]) // 4 for r in rows[w]) for w in fullest}
        self.gaps = []
        while len(fullest) > 1:
            w, last = fullest[0], fullest[-1]
            gap = self.length - used[w]
            if gap < SHORTEST:
                yield from rows.pop(w)
                fullest.pop(0)
                continue
            doc, start, ids, total, _, _ = rows[last].pop()
            n = min(gap, len(ids) // 4)
            if n < len(ids) // 4:  # the head goes, the tail stays where it was
                rows[last].append((doc, start + n, ids[4 * n :], total, last, used[last] - len(ids) // 4))
            rows[w].append((doc, start, ids[: 4 * n], total, w, used[w]))
            used[w] += n
            used[last] -= n
            if not used[last]:
                fullest.pop()
                rows.pop(last)
        for w in fullest:
            yield from self.at_powers(rows[w], used[w])

    def at_powers(self, rows: list[tuple], used: int) -> Iterator[tuple]:
        """The pieces of one window over sequences whose lengths are powers of two, or in one that is nearly full."""
        if self.length - used < SHORTEST:
            yield from rows
            return
        room, window, offset = 1 << used.bit_length() - 1, self.new(), 0
        for doc, start, ids, total, _, _ in rows:
            while ids:
                n = min(room - offset, len(ids) // 4)
                yield doc, start, ids[: 4 * n], total, window, offset
                start, ids, offset, used = start + n, ids[4 * n :], offset + n, used - n
                if offset == room and used:
                    room, window, offset = 1 << used.bit_length() - 1, self.new(), 0


def batch(rows: list[tuple], first: int, open: bool, task: int) -> pa.RecordBatch:
    doc, start, ids, total, window, offset = zip(*rows)
    n = len(rows)
    long = lambda x: pa.array(x, pa.int64())
    columns = [long(doc), long(start), long([len(x) // 4 for x in ids]), long(total), long([first + w for w in window]), long(offset), pa.array(ids, pa.binary()), pa.array([open] * n), long([task] * n)]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in ALL.split(", ")])


def first_id(round: int, task: int) -> int:
    return (round << TASK | task) << LOCAL


def pack_texts(documents: DataFrame, vocabulary: str, end: int, length: int, most: int) -> DataFrame:
    """The first round: texts as ids, packed where they were read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        coder, packer, last = encoder(vocabulary), Packer(length, most), np.array([end], "<u4").tobytes()
        gc.disable()  # millions of pieces, none of which can be in a cycle
        try:
            for whole in batches:
                for b in slices(whole, "text"):
                    texts = [x or "" for x in b.column("text").to_pylist()]
                    out = [row for doc, ids in zip(b.column("doc_id").to_pylist(), map(coder.encode, texts)) for row in packer.add(doc, 0, ids + last, len(ids) // 4 + 1)]
                    if out:
                        yield batch(out, first_id(0, task), False, task)
            if out := [*packer.left()]:
                yield batch(out, first_id(0, task), True, task)
        finally:
            gc.enable()
            coder.known.forget()  # the worker stays, its next task may be another's

    return documents.select("doc_id", "text").mapInArrow(tidy(run), ALL)


def merge(leftovers: DataFrame, round: int, length: int, most: int, last: bool) -> DataFrame:
    """A round over what is left: the windows of FAN tasks, at most FAN * most of them, are packed by one."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        group, packer = key[0].as_py(), Packer(length, most)
        columns = rows.sort_by([("sequence_id", "ascending"), ("offset", "ascending")]).select(["doc_id", "start", "ids", "doc_tokens"]).to_pydict()
        done = [x for piece in zip(*columns.values()) for x in packer.add(*piece)]
        done += packer.close() if last else ()
        return pa.Table.from_batches([batch(x, first_id(round, group), open, group) for x, open in ((done, False), ([*packer.left()], True)) if x])

    return leftovers.withColumn("group", F.floor(F.col("task") / FAN)).groupBy("group").applyInArrow(run, ALL)


def pack(documents: DataFrame, vocabulary: str, end: int, length: int = LENGTH, most: int = OPEN) -> DataFrame:
    """Pieces of documents (doc_id, text) in sequences: doc_id, start (its document's ids before it), length, doc_tokens,
    sequence_id, offset, ids (32-bit little-endian). A document's ids are those of its text and then end."""
    rounds = [materialise(pack_texts(documents, vocabulary, end, length, most), "packed")]
    while (top := rounds[-1].where("open").agg(F.max("task")).first()[0]) is not None:
        rounds.append(materialise(merge(rounds[-1].where("open"), len(rounds), length, most, top < FAN), "packed"))
    return reduce(DataFrame.unionByName, (r.where("not open").drop("open", "task") for r in rounds))
