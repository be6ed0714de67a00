"""Filter audits, packing and Merkle manifests against brute force, at the edges too."""

import hashlib
import pathlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnmill.llm import audit, merkle, packing
from tarnmill.llm.common import fold
from tarnmill.llm.queries import AUDIT, MERKLE

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, mask int, part string, tree string, pos long, n long, node string, open boolean, task long, step int, filter string, key string, ids string"


def rows_of(spark, rows):
    """documents (doc_id, text, source) with columns whose names clash with those that operators make."""
    return spark.createDataFrame([(i, t, "en" if i else None, s, len(t) if t else None, 1, "p", "t", 2, 3, "x", True, 4, 5, "f", "k", "i") for i, t, s in rows], SCHEMA)


def edges():
    rng = random.Random(3)
    texts = [None, "", " \n\t", "a\nb", "word " * 30_000, "é漢🙂 İΣς ǅ", "CAPS AND # marks", "x" * 5_000, "don't 12 3's \x0b\x0c\x1c\x85  y", "<|endoftext|> in <|startoftext|>x", "plain words\n" * 120]
    rows = [(i, texts[i % len(texts)], [None, "", "s", "hot", "hot", "é"][rng.randrange(6)]) for i in range(260)]
    return rows + [(4, "a\nb", "s"), (4, "a\nb", "s"), (None, "a\nb", "s"), (None, None, None), (900, "only one", "alone")]


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


LABELS = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 200, 3)] + [(3, 0, 1), (4, 1, None), (None, 1, 1)]


def brute_audit(rows, labels):
    good, toxic = ({d for d, q, t in labels if (q, t)[k] == 1 and d is not None} for k in (0, 1))
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    docs = defaultdict(list)
    for d, t, s in rows:
        t = t or ""
        w = t.encode().split()
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t), "E": d is not None and d > least[t]}
        docs[s or ""].append((d, {f for f, x in fails.items() if x}))
    out = Counter()
    for part, of in docs.items():
        total, mine = Counter(), []
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                before = set(order[:k])
                removed = [d for d, x in of if f in x and not x & before]
                kept = sum(not x & (before | {f}) for _, x in of)
                redundant = sum(f in x and bool(x & before) for _, x in of)
                total[f] += len(removed)
                mine.append((part, order, k + 1, kept, len(removed), redundant, sum(x == {f} for _, x in of), sum(d in good for d in removed), sum(d in toxic for d in removed), f))
        out.update((*r[:-1], total[r[-1]]) for r in mine)
    return out


def test_audit_equals_brute_force(spark):
    got = Counter(tuple(r) for r in audit.audit(rows_of(spark, edges()), labels_of(spark, LABELS)).collect())
    assert got == brute_audit(edges(), LABELS)
    assert audit.audit(rows_of(spark, []), labels_of(spark, LABELS)).count() == 0
    some = audit.audit(rows_of(spark, [(1, "", None)]), labels_of(spark, [])).collect()
    assert len(some) == 600 and {(r.part, r.good_lost) for r in some} == {("", 0)}


def test_audit_writes_nothing_on_the_way(spark):
    from tarnmill.llm.common import shared_dir

    at = pathlib.Path(shared_dir(spark).removeprefix("file://"))
    before = {*at.iterdir()}
    rows = [(7, "same", "b"), (3, "same", "a"), (3, "same", "b"), (3, "same", "b"), (None, "same", "a"), (5, "same", "a")]
    cells = audit.masks(rows_of(spark, rows), labels_of(spark, [(3, 1, 0), (5, 1, 1)]))
    assert {tuple(r) for r in cells.collect()} == {("a", 1, 2, 1, 0), ("a", 17, 1, 1, 1), ("b", 1, 2, 2, 0), ("b", 17, 1, 0, 0)}
    assert audit.audit(rows_of(spark, rows), labels_of(spark, [])).count() == 1200
    assert {*at.iterdir()} == before


def test_audit_counts_add_up(spark):
    """Of any number of filters: what a step removes and keeps is what the one before kept, and totals agree."""
    cells = spark.createDataFrame([("a", m, m + 1, m % 2, 0) for m in range(8)], "part string, mask int, n long, good long, toxic long")
    rows = audit.interactions(cells, "XYZ").collect()
    assert len(rows) == 18
    kept = {(r.filter_order, r.step): r.kept for r in rows}
    assert all(r.kept + r.removed == kept.get((r.filter_order, r.step - 1), 36) for r in rows)
    assert {kept[o, 3] for o, s in kept} == {1} and sum(r.removed for r in rows) == 6 * 35


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    t.no_truncation()
    t.no_padding()
    return [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


def hold_pieces(pieces, texts, length):
    """Pieces cut every document into its ids, and sequences are gapless; the padding, in tokens."""
    docs, seqs = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length > 0
        docs[p.doc_id].append((p.start, ids, p.doc_tokens))
        seqs[p.sequence_id].append((p.offset, p.length))
    want = defaultdict(Counter)
    for (d, _), ids in zip(texts, library_ids([t for _, t in texts])):
        want[d][tuple(ids)] += 1
    for d, of in want.items():
        assert {n for _, _, n in docs[d]} == {len(x) for x in of} and sum(len(i) for _, i, _ in docs[d]) == sum(len(x) * n for x, n in of.items())
        if sum(of.values()) == 1:
            joined = []
            for start, ids, _ in sorted(docs[d]):
                assert start == len(joined)
                joined += ids
            assert tuple(joined) == [*of][0]
    padding = 0
    for of in seqs.values():
        end = 0
        for offset, n in sorted(of):
            assert offset == end
            end += n
        assert end <= length
        padding += 0 if end & (end - 1) == 0 else length - end
    return padding


def test_packing_holds_every_id_once(spark):
    rows = [(d, t, s) for d, t, s in edges() if d is not None]
    docs = rows_of(spark, rows).repartition(7)
    for length, most in ((2048, 32), (64, 3)):
        pieces = packing.pack(docs, VOCABULARY, 1, length, most).collect()
        padding = hold_pieces(pieces, [(d, t) for d, t, _ in rows], length)
        assert padding < 0.01 * sum(p.length for p in pieces) or length == 64
    assert packing.pack(rows_of(spark, []), VOCABULARY, 1).count() == 0
    lone = packing.pack(rows_of(spark, [(None, None, None)]), VOCABULARY, 1).collect()
    assert [(p.doc_id, p.start, p.length, p.doc_tokens, p.offset) for p in lone] == [(None, 0, 1, 1, 0)]


def test_packing_merges_in_rounds(spark, monkeypatch):
    """Many tasks, few of which merge at a time."""
    monkeypatch.setattr(packing, "FAN", 3)
    rng = random.Random(5)
    rows = [(i, "one two three " * rng.randrange(400), "s") for i in range(300)]
    pieces = packing.pack(rows_of(spark, rows).repartition(11), VOCABULARY, 1, 512, 4).collect()
    assert hold_pieces(pieces, [(d, t) for d, t, _ in rows], 512) < 0.02 * sum(p.length for p in pieces)
    assert len({p.sequence_id >> (packing.LOCAL + packing.TASK) for p in pieces}) >= 3


def test_long_texts_are_encoded_in_parts(monkeypatch):
    rng = random.Random(7)
    texts = ["".join(rng.choices(["ab", "C'", "'s", " ", "\n", "é", "́", "1", "\x1f", " ", "Σ", "ﬁ", "!?"], k=300)) for _ in range(200)]
    monkeypatch.setattr(packing, "STRETCH", 40)
    monkeypatch.setattr(packing, "CACHED_PIECES", 50)
    got = [*map(packing.Encoder(VOCABULARY).encode, texts)]
    assert [np.frombuffer(x, "<u4").tolist() + [1] for x in got] == library_ids(texts)


def test_best_fit_online():
    p, ids = packing.Packer(100, 2), lambda n: bytes(4 * n)
    assert [*p.add(1, 0, ids(60), 60)] == [] and [*p.add(2, 0, ids(70), 70)] == []
    assert [*p.add(3, 0, ids(25), 25)] == [] and p.gaps == [(5, 1), (40, 0)]  # into the fuller one
    out = [*p.add(4, 0, ids(50), 50)]  # fits none: the fullest, whose gap is not worth a cut, is emitted
    assert [(x[0], x[5]) for x in out] == [(2, 0), (3, 70)] and p.gaps == [(40, 0), (50, 2)]
    out = [*p.add(5, 0, ids(251), 251)]  # two full sequences, and the rest is cut to fill the fullest
    assert [(x[0], x[1], len(x[2]) // 4) for x in out] == [(5, 0, 100), (5, 100, 100), (1, 0, 60), (5, 200, 40)]
    assert sum(len(x[2]) // 4 for x in [*out, *p.close()]) == 60 + 50 + 251


def h(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def brute_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def brute_path(levels, i):
    for level in levels[:-1]:
        run = level[i - i % 3 : i - i % 3 + 3]
        yield run[: i % 3], run[i % 3 + 1 :]
        i //= 3


def brute_manifest(rows):
    def leaf(d, t, s, lang, n):
        return h(b"".join(b"-" if x is None else b"%d:%s" % (len(str(x).encode()), str(x).encode()) for x in (d, s, lang, n, t)))

    of = defaultdict(list)
    for d, t, s in rows:
        lang, n = "en" if d else None, len(t) if t else None
        cut = t and zlib.crc32(str("" if d is None else d).encode()) % 2 == 0
        of[s].append((d, leaf(d, t, s, lang, n), leaf(d, t.replace("\n", "") if cut else t, s, lang, n)))
    names = sorted(of, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        of[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = brute_levels([x[1] for x in of[s]])
    top = brute_levels([trees[s][-1][0] for s in names])
    out = Counter()
    for k, s in enumerate(names):
        for i, (d, own, found) in enumerate(of[s]):
            path = [*brute_path(trees[s], i), *brute_path(top, k)]
            for left, right in path:
                found = h("".join(left) + found + "".join(right))
            out[d, own, trees[s][-1][0], top[-1][0], h("".join(x for a, b in path for x in a + b)), found, found == top[-1][0]] += 1
    return out


def tampered():
    return F.when(fold("doc_id", 2) == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


@pytest.mark.parametrize("case", ["edges", "deep", "lone", "wide"])
def test_merkle_equals_brute_force(spark, case):
    rng = random.Random(11)
    rows = {
        "edges": edges(),
        "deep": [(i, f"t{i}\n", "hot" if rng.random() < 0.9 else f"s{rng.randrange(4)}") for i in range(1_500)],
        "lone": [(1, "x\n", "s")],
        "wide": [(i, "x\ny", f"s{i % 260}") for i in range(600)],
    }[case]
    got = Counter(tuple(r) for r in merkle.digests(merkle.manifest(rows_of(spark, rows).repartition(5), tampered())).collect())
    want = brute_manifest(rows)
    assert got == want
    assert case == "edges" or any(not k[-1] for k in want) == any(zlib.crc32(str(d).encode()) % 2 == 0 for d, _, _ in rows)


def test_merkle_of_nothing_and_without_tampering(spark):
    assert merkle.manifest(rows_of(spark, [])).count() == 0
    assert all(r.verified for r in merkle.manifest(rows_of(spark, edges())).collect())


@pytest.mark.parametrize("name", ["audit", "merkle"])
def test_sql_at_the_edges(spark, tmp_path, name):
    c = duckdb.connect()
    c.sql("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    c.sql("create table labels (doc_id bigint, quality int, toxic int)")
    c.executemany("insert into documents values (?, ?, ?, ?, ?)", [(d, t, "en" if d else None, s, len(t) if t else None) for d, t, s in edges()])
    c.executemany("insert into labels values (?, ?, ?)", LABELS)
    columns = {"audit": "part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley", "merkle": "doc_id, leaf, subroot, root, proof_sha256, folded_root, verified"}[name]
    got = Counter(c.sql(f"select {columns} from ({dict(audit=AUDIT, merkle=MERKLE)[name]})").fetchall())
    assert got == (brute_audit(edges(), LABELS) if name == "audit" else brute_manifest(edges()))
