"""Byte-level BPE: speculate with greedy longest matches, verify every adjacent pair, merge exactly only what fails.

A sequence of tokens is what BPE makes of its bytes exactly if BPE makes each adjacent pair of it of that pair's bytes.
So each distinct word gets its greedy longest-match tokens first; one vectorised pass then tests all adjacent pairs of
all new words, and only words with a failing pair are merged step by step.

Memory: words are taken up by pieces of some PIECE characters, long texts cut before white space, where the pre-tokenizer
always begins a word; words that were seen are kept up to a number of them and of their characters.

Defined results: null and empty texts have no tokens; a text of any length is one row; repeated rows are encoded each;
other columns of the input pass through encode_documents() untouched, but for clashes with its two output columns,
which are replaced. An empty table gives an empty table.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnmill.llm.common import give_back, slices, tidy

#: Below this code point all Unicode versions agree on what is a letter, a number or white space, so a pattern of plain
#: ranges splits words; texts that go beyond are split by the tokenizer library's own pre-tokenizer.
AGREED = 0x558


def ranges(general: str) -> str:
    """The code points below AGREED of a general category, as ranges of a character class."""
    within = [unicodedata.category(chr(i))[0] == general for i in range(AGREED)]
    starts = [i for i in range(AGREED) if within[i] and not within[i - 1]]
    ends = [i for i in range(AGREED) if within[i] and not (i + 1 < AGREED and within[i + 1])]
    return "".join(f"\\u{i:04x}-\\u{j:04x}" for i, j in zip(starts, ends))


#: The alternatives of the byte-level pre-tokenizer's pattern, and its white space below AGREED.
SPACE, LETTERS, NUMBERS = r"\t-\r \x85\xa0", ranges("L"), ranges("N")
WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACE}{LETTERS}{NUMBERS}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
BEYOND = re.compile(f"[{chr(AGREED)}-\U0010ffff]")
CUT = re.compile(rf"(?<=\S)(?=[{SPACE}])")
#: Characters that are split into words at once: each word is an object of some 60 bytes, and more where it is new.
PIECE = 1 << 19
#: Words that a worker keeps, and their characters.
CACHED_WORDS = 200_000
CACHED_LETTERS = 1 << 22
LONG_WORD = 48
#: The rank of a pair that no merge has.
NEVER = 1 << 50


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class Codec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        letters = byte_letters()
        self.to_letters = dict(enumerate(letters))
        to_byte = {c: b for b, c in enumerate(letters)}
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        size = max([*vocab.values(), *self.specials.values()]) + 1
        self.bytes_of = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(map(to_byte.__getitem__, token))
        for token, i in self.specials.items():
            self.bytes_of[i] = token.encode()
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in reversed(list(enumerate(merges)))}
        made = [vocab[a + b] for a, b in merges]
        self.merged = {pair: made[r] for pair, r in self.rank.items()}
        self.born = np.full(size, -1, np.int64)
        self.left = np.arange(size)
        self.right = np.arange(size)
        for (a, b), r in self.rank.items():
            if self.born[made[r]] < 0 or r < self.born[made[r]]:
                self.born[made[r]], self.left[made[r]], self.right[made[r]] = r, a, b
        keys = np.array([a * size + b for a, b in self.rank], np.int64)
        order = np.argsort(keys)
        self.size, self.pair_keys, self.pair_ranks = size, keys[order], np.fromiter(self.rank.values(), np.int64)[order]
        self.merged_of = np.fromiter(self.merged.values(), np.int64)[order]
        # Merges that come before one of their own parts, or parts of them that BPE never yields, void the pair test.
        self.sound = all(r > self.born[a] and r > self.born[b] for (a, b), r in self.rank.items())
        reachable = {t: i for t, i in vocab.items() if self.born[i] >= 0 or len(t) == 1}
        self.proposals = {t: i for t, i in reachable.items() if len(t) == 1 or self.merge([vocab[c] for c in t]) == [i]}
        self.prefixes = {t[:k]: -1 for t in self.proposals for k in range(1, len(t))} | self.proposals
        self.letter_id = {c: vocab[c] for c in letters if c in vocab}
        self.special_cache = {(t,): i.to_bytes(4, "little") for t, i in self.specials.items()}
        self.cache: dict[str | tuple[str], bytes] = {}
        self.forget()

    def forget(self) -> None:
        """Drop the words that were kept."""
        self.cache, self.cached_letters = dict(self.special_cache), 0

    def merge(self, ids: list[int]) -> list[int]:
        """Exact BPE of one word: again and again the leftmost pair of the lowest rank, found by a heap."""
        n, none = len(ids), -1
        ids, before, after = [*ids], [*range(-1, n - 1)], [*range(1, n), -1]
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := self.rank.get((a, b))) is not None]
        heapify(heap)
        while heap:
            r, i, a, b = heappop(heap)
            j = after[i]
            if ids[i] != a or j == -1 or ids[j] != b:
                continue  # one of the two has merged meanwhile
            ids[i], ids[j], after[i] = self.merged[a, b], none, after[j]
            if after[j] != -1:
                before[after[j]] = i
            for k in (before[i], i):
                if k != -1 and after[k] != -1 and (r := self.rank.get((ids[k], ids[after[k]]))) is not None:
                    heappush(heap, (r, k, ids[k], ids[after[k]]))
        return [x for x in ids if x != none]

    def merge_all(self, words: list[str]) -> list[list[int]]:
        """Exact BPE of many words: each round merges, in every word, all pairs of its lowest rank; long words go one
        by one, as their rounds would be many."""
        if not self.sound:
            return [self.merge([self.letter_id[c] for c in w]) for w in words]
        out: list[list[int]] = [[]] * len(words)
        short = [i for i, w in enumerate(words) if len(w) <= LONG_WORD]
        for i in {*range(len(words))}.difference(short):
            out[i] = self.merge([self.letter_id[c] for c in words[i]])
        lengths = np.array([len(words[i]) for i in short], np.int64)
        if not len(lengths):
            return out
        word = np.repeat(np.arange(len(short)), lengths)
        ids = np.array([self.letter_id[c] for i in short for c in words[i]], np.int64)
        done_word, done_id, done_at = [], [], []
        at = np.arange(len(ids))
        while len(ids):
            rank = np.full(len(ids), NEVER)
            same = word[:-1] == word[1:]
            rank[:-1][same] = self.ranks(ids[:-1][same], ids[1:][same])
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            lowest = np.repeat(np.minimum.reduceat(rank, starts), np.diff(starts, append=len(word)))
            over = lowest == NEVER
            if over.any():
                done_word.append(word[over]), done_id.append(ids[over]), done_at.append(at[over])
                word, ids, at, rank, lowest = (x[~over] for x in (word, ids, at, rank, lowest))
            join = rank == lowest
            runs = np.flatnonzero(join & np.concatenate(([False], join[:-1])))
            for i in runs.tolist():  # in a run of overlapping equal pairs every second one stays
                if join[i - 1]:
                    join[i] = False
            i = np.flatnonzero(join)
            ids[i] = self.merged_of[np.searchsorted(self.pair_keys, ids[i] * self.size + ids[i + 1])]
            left = np.ones(len(ids), bool)
            left[i + 1] = False
            word, ids, at = word[left], ids[left], at[left]
        word, ids, at = (np.concatenate(x) for x in (done_word, done_id, done_at))
        order = np.argsort(at, kind="stable")
        pieces = np.split(ids[order], np.flatnonzero(np.diff(word[order])) + 1)
        for i, piece in zip(short, pieces):
            out[i] = piece.tolist()
        return out

    def greedy(self, word: str) -> list[int]:
        known, out, i, n = self.prefixes, [], 0, len(word)
        while i < n:
            k, best, stop = i + 1, -1, i
            while k <= n and (t := known.get(word[i:k])) is not None:
                if t >= 0:
                    best, stop = t, k
                k += 1
            out.append(best)
            i = stop
        return out

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        k = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[k] == key, self.pair_ranks[k], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE leaves each pair as it is: undo the merges of both sides from the last on, and look for a pair
        across the border that would have merged before the border's tokens were merged into larger ones."""
        good = np.ones(len(a), bool)
        at, a, b = np.arange(len(a)), a.copy(), b.copy()
        until_a = np.full(len(a), 1 << 40)
        until_b = until_a.copy()
        while len(at):
            rank = self.ranks(a, b)
            bad = (rank < until_a) & (rank <= until_b)
            good[at[bad]] = False
            born_a, born_b = self.born[a], self.born[b]
            undo_a = born_a > born_b
            on = ~bad & ((born_a >= 0) | (born_b >= 0))
            until_a, until_b = np.where(undo_a, born_a, until_a)[on], np.where(undo_a, until_b, born_b)[on]
            a, b, at = np.where(undo_a, self.right[a], a)[on], np.where(undo_a, b, self.left[b])[on], at[on]
        return good

    def learn(self, words: set[str | tuple[str]]) -> None:
        """Have the cache hold distinct words, as little-endian 32-bit ids; where the new ones don't fit, only these."""
        fresh = words - self.cache.keys()
        size = sum(map(len, fresh))
        if len(self.cache) + len(fresh) > CACHED_WORDS or self.cached_letters + size > CACHED_LETTERS:
            self.forget()
            fresh = words - self.cache.keys()
            size = sum(map(len, fresh))
        if not fresh:
            return
        self.cached_letters += size
        words = list(fresh)
        letters = [w.encode().decode("latin-1").translate(self.to_letters) for w in words]
        ids = [[self.proposals[w]] if w in self.proposals else self.greedy(w) for w in letters]
        ends = np.cumsum([len(x) for x in ids])
        flat = np.fromiter((i for x in ids for i in x), np.int64, ends[-1] if len(ends) else 0)
        if self.sound:
            inside = np.ones(max(0, len(flat) - 1), bool)
            inside[ends[:-1] - 1] = False
            border = np.flatnonzero(inside)
            pairs, which = np.unique(flat[border] * self.size + flat[border + 1], return_inverse=True)
            failed = border[~self.compatible(pairs // self.size, pairs % self.size)[which]]
            redo = np.unique(np.searchsorted(ends, failed, side="right"))
        else:
            redo = np.array([i for i, x in enumerate(ids) if len(x) > 1], np.int64)
        for i, exact in zip(redo.tolist(), self.merge_all([letters[i] for i in redo.tolist()])):
            ids[i] = exact
        self.cache.update((w, np.array(x, "<i4").tobytes()) for w, x in zip(words, ids))

    def words(self, text: str) -> list[str]:
        if not BEYOND.search(text):
            return WORDS.findall(text)
        return [text[i:j] for _, (i, j) in _splitter().pre_tokenize_str(text)]

    def pieces(self, text: str) -> Iterator[list[str | tuple[str]]]:
        """The words of a text, those of some PIECE characters at once; special tokens are tuples."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield from self.plain(text, at, m.start())
            yield [(m[0],)]
            at = m.end()
        yield from self.plain(text, at, len(text))

    def plain(self, text: str, at: int, end: int) -> Iterator[list[str]]:
        while end - at > PIECE and (cut := CUT.search(text, at + PIECE, end)):
            yield self.words(text[at : cut.start()])
            at = cut.start()
        if at < end:
            yield self.words(text[at:end])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit numbers."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str | tuple[str]]]] = []

        def flush() -> None:
            self.learn(set().union(*(words for _, words in held)))
            for i, words in held:
                out[i].append(b"".join(map(self.cache.__getitem__, words)))
            held.clear()

        size = 0
        for i, text in enumerate(texts):
            for words in self.pieces(text):
                held.append((i, words))
                size += sum(map(len, words))
                if size >= PIECE:
                    flush()
                    size = 0
        flush()
        return [b"".join(x) for x in out]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(1)
def _splitter():
    from tokenizers.pre_tokenizers import ByteLevel

    return ByteLevel(add_prefix_space=False)


@lru_cache(2)
def codec(path: str) -> Codec:
    """One for each Python worker."""
    made = Codec(path)
    give_back()  # what was read takes as much again
    return made


def encode_documents(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", decoded: str | None = "decoded", columns: list[str] | None = None) -> DataFrame:
    """docs, or those columns of it, with an array of token ids and the text decoded from them, unless that has no name. No
    shuffle; memory is a few texts a task."""
    keep = [f for f in docs.schema.fields if f.name not in (ids, decoded) and (columns is None or f.name in columns)]
    made = [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False), *([T.StructField(decoded, T.StringType(), False)] if decoded else [])]
    schema = T.StructType([*keep, *made])
    read = [f.name for f in keep] + [text] * (text not in [f.name for f in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for whole in batches:
            for b in slices(whole, text, PIECE):
                coded = c.encode([x or "" for x in b.column(text).to_pylist()])
                ends = np.cumsum([0, *(len(x) // 4 for x in coded)]).astype("i4")
                flat = np.frombuffer(b"".join(coded), "<i4")
                arrays = [*(b.column(f.name) for f in keep), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
                if decoded:
                    arrays.append(pa.array([c.decode(flat[i:j].tolist()) for i, j in zip(ends, ends[1:])], pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, schema.names)
        c.forget()  # the worker stays, its next task may be another's

    return docs.select(*(F.col(f"`{x}`") for x in read)).mapInArrow(tidy(run), schema)


def digests(coded: DataFrame, key: str = "doc_id", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    joined = F.array_join(F.col(ids).cast("array<string>"), ",")
    return coded.select(key, F.size(ids).cast("long").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col(decoded).cast("binary"), 256).alias("decoded_sha256"))
