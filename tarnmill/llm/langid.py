"""Language identification by rank-order profiles.

A profile is a language's most frequent letter n-grams (one to three letters, words padded with blanks) in rank order,
counted over every training document. A document's own most frequent n-grams are ranked the same way, and the language
whose profile has them least out of place wins. N-grams of no profile are as far out of place for every language, so
they are left out of the document's ranks. The score is how much nearer the winner is than the runner-up, relative to
the runner-up's distance.

Defined results: a text that is null or has no letter is `und` with score 0, and so is every text if nothing can be
learned; a text with letters but no known n-gram gets the first language by name, with score 0; ties of n-grams go to
the smaller n-gram, ties of languages to the first by name. Repeated rows stay; other columns are ignored; an empty
table gives an empty table. Rows without language or text aren't learned from. Very long texts are counted
whole, in parts cut at blanks, so memory grows with the longest word and not with the text.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnmill.llm.common import fold, slices, tidy

LONGEST, PROFILE, UNKNOWN = 3, 500, "und"
BLANK = re.compile(r"\s")
#: Tables over all n-grams of an alphabet have so many places at most; larger alphabets are searched.
TABLE = 1 << 24
#: Letters that are looked at together, and n-grams that a task holds before it sends them on.
PIECE, HELD = 1 << 20, 1 << 18


@lru_cache(1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)


def codes(text: str) -> np.ndarray:
    """The lower-cased text's letters as code points, every run of others as one 0, and a 0 at both ends."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(letters()[c], c, 0)
    return c[(c > 0) | np.concatenate(([True], c[:-1] > 0))]


def pieces(text: str) -> Iterator[str]:
    """A text in parts of about PIECE letters, cut at blanks, over which no n-gram and no rule of lower case reaches."""
    at = 0
    while at < len(text):
        blank = BLANK.search(text, at + PIECE)
        to = blank.start() if blank else len(text)
        yield text[at:to]
        at = to


def places(d: np.ndarray, size: int) -> list[np.ndarray]:
    """The places of all n-grams of a text, given as letters from 1 to size - 1 and 0 between words: of one, two and
    three letters, the last two padded with one blank on each side of a word."""
    d = d.astype(np.int64)
    three = (d[:-2] * size + d[1:-1]) * size + d[2:]
    return [d[d > 0], d[:-1] * size + d[1:], three[d[1:-1] > 0]]


def gram(place: int, n: int, size: int, alphabet: list[str]) -> str:
    return "".join(alphabet[place // size**k % size] for k in range(n - 1, -1, -1))


def count_grams(texts: list[str]) -> Counter[str]:
    found: Counter[str] = Counter()
    for part in pieces(" ".join(texts)):
        found.update(count_part(part))
    return found


def count_part(text: str) -> Counter[str]:
    c = codes(text)
    present = np.unique(c)
    size, alphabet = len(present), [" ", *(chr(x) for x in present[1:])]
    found: Counter[str] = Counter()
    for n, x in enumerate(places(np.searchsorted(present, c), size), 1):
        if size**n <= min(TABLE, PIECE + 4 * len(x)):
            counts = np.bincount(x, minlength=size**n)
            at = np.flatnonzero(counts)
            counts = counts[at]
        else:
            at, counts = np.unique(x, return_counts=True)
        found.update({gram(k, n, size, alphabet): m for k, m in zip(at.tolist(), counts.tolist())})
    found.pop("  ", None)
    return found


def learn_profiles(docs: DataFrame, size: int = PROFILE) -> dict[str, dict[str, int]]:
    """For each language its most frequent n-grams and their ranks. Counts cover all of docs; tasks add them up, so that
    only n-grams shuffle; what reaches the driver is size rows a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter[str]] = defaultdict(Counter)
        for b in batches:
            for piece in slices(b, "text"):
                texts: dict[str, list[str]] = defaultdict(list)
                for lang, text in zip(piece.column("lang").to_pylist(), piece.column("text").to_pylist()):
                    texts[lang].append(text)
                for lang, own in texts.items():
                    found[lang].update(count_grams(own))
                if sum(map(len, found.values())) > HELD:
                    yield from sent(found)
                    found.clear()
        yield from sent(found)

    def sent(found: dict[str, Counter[str]]) -> Iterator[pa.RecordBatch]:
        rows = [(lang, g, n) for lang, x in found.items() for g, n in x.items()]
        for i in range(0, len(rows), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[i : i + 100_000]], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "gram", "n"])

    counts = docs.where("lang is not null and text is not null").select("lang", "text").mapInArrow(tidy(count), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= size)
    profiles: dict[str, dict[str, int]] = defaultdict(dict)
    for r in best.select("lang", "gram", "rank").collect():
        profiles[r.lang][r.gram] = r.rank - 1
    return {lang: profiles[lang] for lang in sorted(profiles)}


class Identifier:
    def __init__(self, profiles: dict[str, dict[str, int]], size: int = PROFILE):
        self.size, self.langs = size, [*profiles]
        known = sorted({g for p in profiles.values() for g in p})
        self.known = len(known)
        self.ranks = np.array([[p.get(g, size) for g in known] for p in profiles.values()], np.int64).reshape(len(profiles), len(known))
        # Letters by number: 0 for a blank, the last for all that no profile has.
        alphabet = sorted({c for g in known for c in g} - {" "})
        self.alphabet = len(alphabet) + 2
        self.number = np.full(0x110000, self.alphabet - 1, np.int32)
        self.number[0] = 0
        self.number[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        value = {" ": 0} | {c: i + 1 for i, c in enumerate(alphabet)}
        self.find = []
        for n in range(1, LONGEST + 1):
            ids = [i for i, g in enumerate(known) if len(g) == n]
            at = np.array([sum(value[c] * self.alphabet ** (n - 1 - k) for k, c in enumerate(known[i])) for i in ids], np.int64)
            if self.alphabet**n <= TABLE:
                table = np.full(self.alphabet**n, self.known, np.int32)
                table[at] = ids
                self.find.append((None, table))
            else:
                order = np.argsort(at)
                self.find.append((np.append(at[order], np.iinfo(np.int64).max), np.append(np.array(ids, np.int32)[order], self.known)))

    def __call__(self, text: str | None) -> tuple[str, float]:
        counts, some = np.zeros(self.known + 1, np.int64), False
        for part in pieces(text) if text and self.langs else ():
            c = codes(part)
            some = some or bool(c.any())
            for x, (keys, values) in zip(places(self.number[c], self.alphabet), self.find):
                if keys is None:
                    ids = values[x]
                else:
                    k = np.searchsorted(keys, x)
                    ids = np.where(keys[k] == x, values[k], self.known)
                counts += np.bincount(ids, minlength=self.known + 1)
        if not some:
            return UNKNOWN, 0.0
        counts = counts[: self.known]
        present = np.flatnonzero(counts)
        if not len(present):
            return self.langs[0], 0.0
        top = present[np.argsort(-counts[present], kind="stable")][: self.size]  # equal counts: ids are in order of n-grams
        distance = np.where(self.ranks[:, top] < self.size, np.abs(self.ranks[:, top] - np.arange(len(top))), self.size).sum(axis=1)
        order = np.argsort(distance, kind="stable")
        best = int(distance[order[0]])
        other = int(distance[order[1]]) if len(order) > 1 else self.size * len(top)
        return self.langs[order[0]], (other - best) / other if other else 0.0


def identify(docs: DataFrame, profiles: dict[str, dict[str, int]], key: str = "doc_id", size: int = PROFILE) -> DataFrame:
    """key, lang_pred and score of each row. No shuffle."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who = Identifier(profiles, size)
        for b in batches:
            found = [who(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], [key, "lang_pred", "score"])

    return docs.select(key, "text").mapInArrow(tidy(run), f"`{key}` {kind}, lang_pred string, score double")


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the rows whose fold of three isn't 1."""
    profiles = learn_profiles(docs.where(fold("doc_id", 3) != 1).select("lang", "text"))
    return identify(docs, profiles).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
