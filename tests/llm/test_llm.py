"""The corpus operators on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import base64
import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnmill.llm import bpe, ctph, ctw, decontaminate, jaccard, langid, pii, secrets, toxicity, warc
from tarnmill.llm.common import new_path

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (4, "a"), (5, "word " * 30_000), (None, "no id here"), (6, "é漢🙂 <|endoftext|> mixed")]


def edge_docs(spark):
    """Texts at the edges, with columns whose names clash with those that operators add."""
    d = spark.createDataFrame(EDGES, "doc_id long, text string")
    clashing = ["ids", "size", "label", "block", "places", "key", "_key", "row", "_row", "kind", "found", "made", "these", "slot", "class", "bits", "keys", "score", "held_out"]
    return d.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), *(F.lit(i).alias(c) for i, c in enumerate(clashing)))


def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def words(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    random.seed(1)
    rows = [(i, "".join(random.choices("abcdethe  \n'sé漢🙂֐<|>1", k=random.randint(0, 60))) + random.choice(["", "<|endoftext|>", "aaaaaaaaaa" * 9])) for i in range(300)]
    docs = edge_docs(spark).select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = Counter((r.text, tuple(r.ids), r.decoded) for r in bpe.encode_documents(docs, VOCABULARY).collect())
    want = Counter()
    for r in docs.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        want[r.text, tuple(ids), t.decode(ids, skip_special_tokens=False)] += 1
    assert got == want
    assert bpe.digests(bpe.encode_documents(none(spark), VOCABULARY)).count() == 0


def test_bpe_memory_of_long_texts():
    """Words of a long text are taken up by and by, not as a list of all of them."""
    import tracemalloc

    c = bpe.codec(VOCABULARY)
    text = "some words and more of them\n" * 150_000
    tracemalloc.start()
    ids = c.encode([text])[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert c.decode(np.frombuffer(ids, "<i4").tolist()) == text
    assert peak < 20 * len(text) // 2


def test_bpe_pieces_equal_the_library(monkeypatch):
    from tokenizers import Tokenizer

    t, c = Tokenizer.from_file(VOCABULARY), bpe.Codec(VOCABULARY)
    monkeypatch.setattr(bpe, "PIECE", 7)
    monkeypatch.setattr(bpe, "CACHED_LETTERS", 100)
    random.seed(2)
    texts = ["", *("".join(random.choices(["a", "b", "1", " ", "\n", "\t", "\x1c", "\xa0", "\u2003", "\u3000", "'s", "é", "漢", ".", "<|endoftext|>"], weights=[4, 4, 2, 9, 2, 1, 1, 1, 2, 1, 1, 1, 1, 2, 1], k=random.randint(1, 80))) for _ in range(500)), "x" * 300 + " y"]
    for n in (1, 50):
        for i in range(0, len(texts), n):
            assert [np.frombuffer(x, "<i4").tolist() for x in c.encode(texts[i : i + n])] == [t.encode(x, add_special_tokens=False).ids for x in texts[i : i + n]]
            assert sum(map(len, c.cache)) <= max(100, sum(map(len, texts[i : i + n]))) + len(c.special_cache)


def test_bpe_of_some_columns(spark):
    docs = edge_docs(spark)
    got = bpe.encode_documents(docs, VOCABULARY, decoded=None, columns=["doc_id", "lang"])
    assert got.columns == ["doc_id", "lang", "ids"]
    count = lambda d: Counter((r.doc_id, tuple(r.ids)) for r in d.select("doc_id", "ids").collect())
    assert count(got) == count(bpe.encode_documents(docs, VOCABULARY))


def test_secrets(spark):
    token = "aB3dE5gH7jK9mN1pQ3sT"
    rows = [(10, f'user = "bob42" then {token} at https://x.y/z'), (11, f"{token} alone"), (12, 'secret: "abc" password=abcdef token=token=abc12345 AKIA' + "A" * 16 + " " + "0a" * 16 + '🙂passwd:"zzzzzz"'), (13, "AKIAABC deadbeef"), (14, f"user: bob42 {'x ' * 200} {token}")]
    docs = edge_docs(spark).select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    want = Counter()
    for r in docs.collect():
        t = r.text or ""
        s = [(m.start(), 0, m.end()) for m in re.finditer(secrets.ASSIGN, t) if len(m[2]) >= 6]
        s += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        s += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        want[r.doc_id, hashlib.sha256(",".join(f"{secrets.KINDS[k]}:{i}:{j}" for i, k, j in sorted(s)).encode()).hexdigest(), *(sum(k == n for _, k, _ in s) for n in range(3))] += 1
    got = secrets.scan(docs).collect()
    assert Counter((r.doc_id, r.base_sha256, r.n_assign, r.n_access, r.n_hex) for r in got) == want
    linked = {r.doc_id: r.n_linked for r in got}
    assert linked[10] == 3 and linked[11] == 0 and linked[14] == 0
    roles = {20: "AKIA" + "A" * 16 + " at https://x.y/z", 21: "sha " + "0a" * 16 + " see https://x.y/z", 22: "user: bob42 " + "0a" * 16 + " https://x.y/z", 23: f"{token} https://x.y/z", 24: "user: bob42 at https://x.y/z", 25: "AKIA" + "A" * 16 + f" {token}", 26: f"{token} {token}"}
    got = {r.doc_id: r.n_linked for r in secrets.scan(spark.createDataFrame([*roles.items()], "doc_id long, text string")).collect()}
    assert got == {20: 0, 21: 0, 22: 2, 23: 2, 24: 0, 25: 1, 26: 0}
    clean = {r.doc_id: r.text for r in secrets.redact(docs).where("doc_id >= 10").collect()}
    assert clean[11] == f"{token} alone" and "bob42" not in clean[10] and "abcdef" not in clean[12] and "🙂" in clean[12]
    same = secrets.redact(edge_docs(spark))
    assert same.columns == edge_docs(spark).columns and sorted(map(str, same.collect())) == sorted(map(str, edge_docs(spark).collect()))
    assert secrets.scan(none(spark)).count() == 0


def test_secrets_keeps_documents_whose_matches_are_all_too_short(spark):
    texts = {1: "token: yes", 2: "password=abc", 3: "token: no secret=ab passwd=x", 4: "token: yes password=abcdef", 5: "plain"}
    got = {r.doc_id: r for r in secrets.scan(spark.createDataFrame([*texts.items()], "doc_id long, text string")).collect()}
    assert got.keys() == texts.keys()
    empty = hashlib.sha256(b"").hexdigest()
    assert all((got[i].n_assign, got[i].n_access, got[i].n_hex, got[i].n_linked, got[i].base_sha256, got[i].spans) == (0, 0, 0, 0, empty, "") for i in (1, 2, 3, 5))
    assert got[4].spans == "assign:11:26"


def test_secrets_link_as_all_pairs_do(spark):
    """The windows against a comparison of every part with every other part of its document."""
    random.seed(8)
    parts = ["user: bob42", "aB3dE5gH7jK9mN1pQ3sT", "https://x.y/z", "AKIA" + "B" * 16, "0a" * 14, "token=abc12345"]
    texts = [" ".join(x for _ in range(random.randint(1, 8)) for x in (random.choice(parts), "-" * random.choice([1, 20, 90]))) for _ in range(60)]
    roles = {"identifier": "i", "access": "i", "assign": "s", "token": "s", "hex": "h", "endpoint": "e"}
    for scope in (5, 160):
        got = {r.doc_id: r.spans for r in secrets.scan(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), scope=scope).collect()}
        for i, t in enumerate(texts):
            found = sorted((m.start(), k, m.end()) for kind, p in zip(secrets.KINDS, parts_in_order(parts)) for m in re.finditer(re.escape(p), t) for k in [secrets.KINDS.index(kind)])
            want = []
            for a, k, b in found:
                near = {roles[secrets.KINDS[n]] for x, n, y in found if (x, n) != (a, k) and x - b <= scope and a - y <= scope}
                role = roles[secrets.KINDS[k]]
                if k < secrets.STRONG or (k == 5 and near & {"i", "e"}) or (role == "i" and near & {"s", "h"}) or (role == "e" and ("s" in near or {"h", "i"} <= near)):
                    want.append(f"{secrets.KINDS[k]}:{a}:{b}")
            assert got[i] == ",".join(want), (t, scope)


def parts_in_order(parts):
    """The fixture's parts in the order of the kinds: assign, access, hex, identifier, endpoint, token."""
    return [parts[i] for i in (5, 3, 4, 0, 2, 1)]


def components(rows, width, percent):
    sets = {}
    for k, (d, t) in enumerate(rows):
        w = words(t)
        sets[k] = frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()
    up = {k: k for k in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    having = defaultdict(list)
    for k, s in sets.items():
        for g in s:
            having[g].append(k)
    for k, s in sets.items():
        shared = Counter(e for g in s for e in having[g] if e < k)
        for e, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[e]) - n):
                up[top(k)] = top(e)
    least = {}
    for k in sets:
        ids = [rows[j][0] for j in sets if top(j) == top(k) and rows[j][0] is not None]
        least[k] = min(ids, default=None) if sets[k] else rows[k][0]
    return Counter((rows[k][0], len(sets[k]), least[k]) for k in sets)


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_jaccard_join_against_brute_force(spark, width, percent):
    random.seed(width)
    rows = list(EDGES)
    for g in range(3):
        base = [f"w{random.randint(0, 300)}" for _ in range((12, 60, 150)[g])]
        for i in range(40):
            b = [f"x{random.randint(0, 40)}" if random.random() < 0.02 else w for w in base]
            rows.append((100 + 50 * g + i, " ".join(b[: len(b) - random.randint(0, len(b) // 12)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, jaccard.join(docs, width, percent).collect())) == components(rows, width, percent)


def test_common_shingles_are_counted_over_all_texts(spark, monkeypatch):
    """A phrase of a few texts is common however little a share of all texts those are, or would be drawn."""
    monkeypatch.setattr(jaccard, "FILLED", 1 << 34, raising=False)  # once, a count took one text in so many
    random.seed(2)
    own = [" ".join(str(random.getrandbits(60)) for _ in range(40)) for _ in range(300)]
    phrase = "that which is said by many of them"
    texts = [f"{t} {phrase}" if i % 60 == 0 else t for i, t in enumerate(own)] + [own[1]] * 2 + ["", None]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(7)
    common = jaccard.common_shingles(docs, 3)
    n = np.zeros(8 * len(common), int)
    for t in {*texts}:
        n[(jaccard.shingles(t, 3) % np.uint64(len(n))).astype(int)] += 1
    slots = (jaccard.shingles(phrase, 3) % np.uint64(len(n))).astype(int)
    marked = np.unpackbits(common, bitorder="little").astype(bool)
    assert len(slots) == 6 and marked[slots].all() and (marked >= (n > 3)).all() and not marked[n == 0].any()
    assert not jaccard.common_shingles(none(spark), 3).any()


@pytest.mark.parametrize(("width", "percent", "n"), [(3, 90, 24_000), (5, 80, 12_000)])
def test_jaccard_links_near_copies_that_meet_in_thousands_of_tiles(spark, width, percent, n):
    random.seed(3)
    text = [str(random.getrandbits(60)) for _ in range(n)]
    docs = spark.createDataFrame([(1, " ".join(text)), (2, " ".join([*text[:-9], "another", *text[-8:]])), (3, "a few words apart")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.join(docs, width, percent).collect()} == {1: 1, 2: 1, 3: 3}


def test_jaccard_keeps_one_of_each_group(spark):
    docs = edge_docs(spark)
    kept = Counter(r.doc_id for r in jaccard.keep_one(docs).collect())
    assert kept == Counter([1, 2, 3, 4, 5, None, 6]) and jaccard.keep_one(docs).columns == docs.columns
    assert jaccard.join(none(spark), 3, 90).count() == 0


def tiles_by_brute_force(doc, item, least):
    free_d, free_i, out = [True] * len(doc), [True] * len(item), []
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and free_d[i + n] and free_i[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < least:
            return sum(x for x in out)
        free_d[i : i + n] = [False] * n
        free_i[j : j + n] = [False] * n
        out.append(n)


def test_decontamination(spark):
    random.seed(5)
    vocabulary = [f"w{i}" for i in range(9)]
    items = [(i, " ".join(random.choices(vocabulary, k=30))) for i in range(4)] + [(8, "tiny one"), (9, None), (10, "three words here")]
    docs = []
    for k in range(25):
        w = items[k % 4][1].split()
        cut = random.randint(5, 25)
        docs.append((100 + k, " ".join([*random.choices(vocabulary, k=10), *(w[cut:] + ["zz"] + w[:cut] if k % 2 else random.choices(vocabulary, k=20)), *random.choices(vocabulary, k=10)])))
    docs += [(200, "now three words here, yes"), *EDGES]
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.matches(table, bench).collect()}
    for k in range(25):
        for i, text in items[:4]:
            n = tiles_by_brute_force(docs[k][1].split(), text.split(), 5)
            assert ((100 + k, i) in got) == (n >= 15) and (n < 15 or got[100 + k, i].n_words == n)
        if k % 2:
            assert (100 + k, k % 4) in got  # a reordered passage is caught
    assert got[200, 10].n_words == 3
    # The join on seeds gives the same rows as the index, and drops the same documents.
    assert sorted(map(tuple, got.values()), key=str) == sorted(map(tuple, decontaminate.matches(table, bench, index_chars=0).collect()), key=str)
    both = [sorted(map(str, decontaminate.drop_matched(table.withColumn("row", F.lit(1)), bench, index_chars=n).collect())) for n in (0, 10**9)]
    assert both[0] == both[1] and 0 < len(both[0]) < len(docs)
    assert decontaminate.drop_matched(edge_docs(spark), bench, index_chars=0).columns == edge_docs(spark).columns
    assert decontaminate.drop_matched(edge_docs(spark), bench).count() == len(EDGES)
    assert decontaminate.matches(none(spark), bench).count() == 0
    assert decontaminate.matches(edge_docs(spark), bench.limit(0)).count() == 0 and decontaminate.drop_matched(edge_docs(spark), bench.limit(0)).count() == len(EDGES)


def tree_by_brute_force(rows, held):
    """log10 probabilities of all texts, by walking a context tree of plain dictionaries."""
    def coded(t):
        w = words(t)
        return ctw.LEAD + b"".join(x + b" " for x in w) + b"\n"

    def steps(seq):
        for i in range(ctw.DEPTH, len(seq)):
            for k in range(7, -1, -1):
                yield seq[i - ctw.DEPTH : i], (1 << 8 | seq[i]) >> (k + 1), seq[i] >> k & 1

    counts, below = defaultdict(lambda: [0, 0]), defaultdict(set)
    for i, t in rows:
        if not held(i):
            for context, so_far, bit in steps(coded(t)):
                for d in range(ctw.DEPTH + 1):
                    counts[context[ctw.DEPTH - d :], so_far][bit] += 1
                    if d:
                        below[context[ctw.DEPTH - d + 1 :], so_far].add(context[ctw.DEPTH - d :])

    def own(node):
        a, b = counts.get(node, (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    known = {}

    def weighted(node):
        if node not in known:
            if len(node[0]) == ctw.DEPTH:
                known[node] = own(node)
            else:
                x, y = own(node), sum(weighted((c, node[1])) for c in below.get(node, ()))
                known[node] = max(x, y) + math.log1p(math.exp(-abs(x - y))) - math.log(2)
        return known[node]

    for i, t in rows:
        total = 0.0
        for context, so_far, bit in steps(coded(t)):
            p = 0.5
            for d in range(ctw.DEPTH, -1, -1):
                node = (context[ctw.DEPTH - d :], so_far)
                a, b = counts.get(node, (0, 0))
                chance = (b + 0.5) / (a + b + 1)
                w = 1.0 if d == ctw.DEPTH else math.exp(own(node) - weighted(node)) / 2
                p = w * chance + (1 - w) * p
            total += math.log10(p if bit else 1 - p)
        yield total


def test_ctw(spark, monkeypatch):
    random.seed(2)
    rows = [(i, " ".join(random.choices(["the", "cat", "sat", "on", "mat", "Élan", f"x{i}"], k=12))) for i in range(20, 80)] + [e for e in EDGES if len(e[1] or "") < 1000]
    rows += [(200, " the  cat\tsat " * 40), (201, "a" * 700), (210, "the cat")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clashing = docs.select("*", *(F.lit(1).alias(c) for c in ("slot", "block", "keys", "held_out", "place", "score")))
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    assert any(held(i) for i, _ in rows)
    counts = Counter()
    for i, t in rows:
        if not held(i):
            counts.update([*words(t), None])
    total, distinct = sum(counts.values()), len(counts)
    tree = [*tree_by_brute_force(rows, held)]
    want = Counter()
    for (i, t), lp in zip(rows, tree):
        w = [*words(t), None]
        want[i, held(i), len(w), sum(counts[x] > 0 for x in w), total, round(sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w), 4), round(lp, 2)] += 1
    monkeypatch.setattr(ctw, "ASKERS", 2)
    for block_bytes in (ctw.BLOCK_BYTES, 500):
        got = ctw.score(clashing, block_bytes=block_bytes).collect()
        assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 2)) for r in got) == want
    assert ctw.score(none(spark)).count() == 0
    alone = next(i for i in range(1000) if held(i))
    r = ctw.score(spark.createDataFrame([(alone, "ab")], "doc_id long, text string")).first()
    assert (r.n_known, r.train_tokens) == (0, 0) and abs(r.score - 32 * math.log10(0.5)) < 1e-5


def test_ctw_pieces_of_long_texts():
    random.seed(3)
    text = " ".join("".join(random.choices("abé", k=random.randint(1, 9))) for _ in range(500)) + "  "
    whole = [*ctw.bodies(text)]
    cut = [*ctw.bodies(text, 40)]
    assert len(whole) == 1 and len(cut) > 20
    assert sorted(ctw.edges_of(whole).tolist()) == sorted(ctw.edges_of(cut).tolist())
    assert ctw.words_of(whole)[0].tolist() == ctw.words_of(cut)[0].tolist()
    keys = ctw.summed(*[ctw.edges_of(whole), ctw.edges_of(whole) % 7])
    assert ctw.unpacked(ctw.packed(keys[0])).tolist() == keys[0].tolist()
    assert ctw.packed(ctw.unpacked(ctw.packed(keys[1].astype("i8"), False), False), False) == ctw.packed(keys[1].astype("i8"), False)


def test_warc(spark, monkeypatch):
    fake = "x\r\n\r\nWARC/1.1\r\nContent-Length: 1\r\n\r\ny\r\n\r\nWARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    rows = [(1, "u", "<p>é</p>"), (2, "u", "<p>é</p>"), (3, None, None), (4, "a\r\nb", ""), (None, "u", "<p>é</p>"), (5, "u", fake), (1, "u", "<p>é</p>"), (6, "u", "z" * 400_000), (7, "u", "WARC/1.1\r\n"), (None, "u", "only"), (None, "u", "only"), (8, "u", "WARC/1.1\r\n\r\n\r\nWARC/1.1\r\n" * 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("first", F.lit(1))
    want = Counter()
    named = set()
    for i, _, h in rows:
        b = (h or "").encode()
        first = min((x[0] for x in rows if (x[2] or "") == (h or "") and x[0] is not None), default=None)
        to = None if first is None or (i == first and first not in named) else first
        named.add(i)
        want[i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if to is None else "revisit", to] += 1
    answers = lambda got: Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got)
    for compression, size in (("gzip", "128m"), ("none", "128m"), ("none", "100000b"), ("none", "700b")):
        path = new_path(spark, "warc")
        warc.write_archives(pages, path, records_a_file=3 if size == "128m" else 100, compression=compression)
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            got = warc.read_archives(spark, path).collect()
            assert answers(got) == want and answers(warc.read_archives(spark, path, payloads=False).collect()) == want
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert all(bytes(r.payload) == next((x[2] or "") for x in rows if x[0] == r.page_id).encode() for r in got if r.record_type == "response" and r.page_id)
    path = new_path(spark, "warc")
    warc.write_archives(pages, path, least_bytes=10**6)
    assert {r.record_type for r in warc.read_archives(spark, path).collect()} == {"response"}


def test_warc_versions(spark, tmp_path):
    def record(version, n, payload):
        head = f"WARC/{version}\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{n}>\r\nContent-Length: {len(payload)}\r\n\r\n"
        return head.encode() + payload + b"\r\n\r\n"

    payloads = [b"one", b"WARC/1.0\r\nContent-Length: 0\r\n\r\n\r\n\r\n", b"", b"on WARC/1. and WARC/1.1\r\n", b"WARC/1.0"]
    whole = b"".join(record(v, n, p) for n, (v, p) in enumerate(zip(["1.0", "1.1", "1.0", "1.2", "1.0"], payloads)))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc").write_bytes(whole)
    got = warc.read_archives(spark, str(tmp_path / "in")).collect()
    assert sorted((r.page_id, bytes(r.payload or b"")) for r in got) == [*enumerate(payloads)]
    (tmp_path / "in" / "empty.warc").write_bytes(b"")
    assert warc.read_archives(spark, str(tmp_path / "in")).count() == 5
    for bad in (b"some text", b"\r\n" + whole, b"WARC/1.0\r\nno end", b"WARC/2.0\r\nContent-Length: 0\r\n\r\n\r\n\r\n"):
        (tmp_path / "in" / "bad.warc").write_bytes(bad)
        with pytest.raises(ValueError, match="bad.warc"):
            warc.read_archives(spark, str(tmp_path / "in"))


def test_warc_jumps_and_chains():
    """Against walking from one record to the next."""
    random.seed(9)
    for _ in range(100):
        at = sorted(random.sample(range(0, 60), random.randint(1, 20)))
        after = [random.choice([x for x in at if x > i] + [70, i + 1]) for i in at]
        to = dict(zip(at, after))
        out = []
        for i in at:
            while i in to:
                i = to[i]
            out.append(i)
        assert warc.jumps(np.array(at), np.array(after)).tolist() == out
        i, seen = at[0], []
        while i in to:
            seen.append(i)
            i = to[i]
        assert np.array(at)[warc.chain(np.array(at), np.array(after), np.array([at[0], 999]))].tolist() == seen


def test_langid(spark):
    de, en = "der die das und ist nicht ein schön größer", "the and of to in is that with for"
    rows = [(i, de if i % 2 else en, "de" if i % 2 else "en") for i in range(20, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").unionByName(edge_docs(spark).select("doc_id", "text", F.lit(None).cast("string").alias("lang")))
    got = langid.predict(docs).collect()
    assert len(got) == 40 + len(EDGES) and all(0 <= r.score <= 1 for r in got)
    assert all(r.lang_pred == ("de" if r.doc_id % 2 else "en") for r in got if (r.doc_id or 0) >= 20)
    assert all(r.lang_pred == "und" for r in got if r.doc_id in (1, 2, 3))
    assert {r.lang_pred for r in langid.predict(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.predict(none(spark)).count() == 0
    for _ in range(200):
        t = "".join(random.choices("abÉß漢 .1", k=random.randint(1, 30)))
        c = Counter()
        for w in "".join(x if x.isalpha() else " " for x in t.lower()).split():
            p = f" {w} "
            c.update([*w, *(p[i : i + n] for n in (2, 3) for i in range(len(p) - n + 1))])
        assert langid.count_grams([t]) == c


def test_langid_of_long_texts(monkeypatch):
    rng = random.Random(8)
    texts = ["".join(rng.choices("abcß ΣσÀ\n\u2003-'.İ", k=rng.randint(0, 400))) for _ in range(60)]
    want = [langid.count_grams([t]) for t in texts], langid.count_grams(texts)
    profiles = {"a": {g: i for i, g in enumerate(sorted(want[0][0]))}, "b": {g: i for i, g in enumerate(sorted(want[0][1]))}}
    answers = [langid.Identifier(profiles)(t) for t in texts]
    monkeypatch.setattr(langid, "PIECE", 7)
    assert all("".join(langid.pieces(t)) == t for t in texts) and max(map(len, langid.pieces("ab " * 50))) < 11
    assert ([langid.count_grams([t]) for t in texts], langid.count_grams(texts)) == want
    assert [langid.Identifier(profiles)(t) for t in texts] == answers


def test_langid_distance_by_brute_force():
    random.seed(11)
    alphabet = "abcdéßжя漢"
    profiles = {}
    for lang in ("aa", "bb", "cc"):
        grams = sorted({"".join(random.choices(alphabet + " ", k=random.randint(1, 3))) for _ in range(60)} - {" ", "  ", "   "})
        random.shuffle(grams)
        profiles[lang] = {g: i for i, g in enumerate(grams[:40])}
    size = 40
    who = langid.Identifier(profiles, size)
    known = {g for p in profiles.values() for g in p}
    for _ in range(300):
        text = "".join(random.choices(alphabet.upper() + alphabet + "  .,1", k=random.randint(0, 60)))
        counts = Counter()
        for w in "".join(x if x.isalpha() else " " for x in text.lower()).split():
            p = f" {w} "
            counts.update([*w, *(p[i : i + n] for n in (2, 3) for i in range(len(p) - n + 1))])
        top = [g for g, _ in sorted(((g, n) for g, n in counts.items() if g in known), key=lambda x: (-x[1], x[0]))][:size]
        if not counts:
            assert who(text) == ("und", 0.0)
            continue
        distance = sorted((sum(abs(p[g] - i) if g in p else size for i, g in enumerate(top)), lang) for lang, p in profiles.items())
        want = (distance[0][1], (distance[1][0] - distance[0][0]) / distance[1][0]) if top else ("aa", 0.0)
        assert who(text) == want


def test_pii(spark):
    rows = [(20, "Frau Müller and Mr. John Smith: +1 (743) 555-3824, bob.x@gmail.com, BOB.X@gmail.com; card 4111 1111 1111 1111, 10.0.0.1"), (21, "Mr. Smith wrote to bob.x@gmail.com from 10.0.0.1"), (22, "nothing")]
    docs = edge_docs(spark).select("doc_id", "text", "source").unionByName(spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string"))
    out = pii.replace_entities(docs, "k")
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(EDGES) + 3 and got[22].text == "nothing" and got[1].text is None
    a, b = got[20], got[21]
    for secret in ("Smith", "555-3824", "bob.x", "4111 1111 1111 1111", "10.0.0.1", "Müller"):
        assert secret not in a.text and secret not in b.text
    kinds = defaultdict(list)
    for x in a.pii:
        kinds[x.kind].append(x.surrogate)
    assert kinds["email"][0] == kinds["email"][1].lower() and kinds["email"][0] in b.text and kinds["ip"][0] in b.text
    assert kinds["person"][1].split()[-1] == b.pii[0].surrogate.split()[-1]  # a surname alone is the same
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", kinds["phone"][0])
    digits = [int(x) for x in kinds["card"][0].replace(" ", "")]
    assert sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0
    many = spark.createDataFrame([(i, f"Mr. B{c} met") for i, c in enumerate("aeiouy")], "doc_id long, text string")
    names = [r.pii[0].surrogate for r in pii.replace_entities(many, "k").collect()]
    assert len({*names}) == 6 and not {*names} & {f"Mr. B{c}" for c in "aeiouy"}
    assert pii.replace_entities(none(spark), "k").count() == 0


def mail_by_rule(found, key):
    """A mail address's surrogate, restated: each letter's place, the keyed digits of it, and another letter of its row."""
    form = found.lower()
    whole = hashlib.sha256(form.encode()).hexdigest()
    local, domain = found.split("@")
    inner = "".join(x + "." for x in domain.split(".")[:-2])

    def number(of, i):
        made = hashlib.sha512("\u0001".join([key, of, whole, "0", str(i // 32)]).encode()).hexdigest()
        return int(made[i % 32 * 4 : i % 32 * 4 + 4], 16)

    def other(c, n):
        low = c.lower().translate(str.maketrans(*pii.PLAIN))
        row = next((r for r in pii.ROWS if low in r), None)
        if "0" <= c <= "9":
            return str((int(c) + 1 + n % 9) % 10)
        if row:
            new = row[(row.index(low) + 1 + n % (len(row) - 1)) % len(row)]
        elif at := next(((a, m) for script, (a, m) in pii.SCRIPTS.items() if unicodedata.name(low).startswith({"Han": "CJK"}.get(script, script.upper()))), None):
            first, many = at
            inside = first <= ord(low) < first + many
            new = chr(first + ((ord(low) - first + 1 + n % (many - 1)) % many if inside else n % many))
        elif low.isnumeric():
            new = str(n % 10)
        else:
            row = next((r for name, r in (("CYRILLIC", pii.ROWS[2]), ("GREEK", pii.ROWS[4])) if unicodedata.name(low).startswith(name)), pii.ROWS[0])
            new = row[n % len(row)]
        return new if c == c.lower() else new.upper()

    swap = lambda of, t: "".join(other(c, number(of, i)) if unicodedata.category(c)[0] in "LN" else c for i, c in enumerate(t))
    return f"{swap('local', local)}@{swap('inner', inner)}example.{domain.split('.')[-1]}"


def test_pii_of_every_script(spark):
    rng = random.Random(8)
    letters = [*"abzAZ09éÉñłžŐßøæđıķ", *"李明谢김철", *"محمدگچ", *"שלום", *"हिन्दी", *"ขอบ", *"жЖіЇ", *"λΩϊ", *"かナヺ", *"აბԱա", *"٣½", *"ሀሁ", *"._%+-", "\u0d05", "\u1e9e", "ﬁ", "𝒜"]
    mails = ["".join(rng.choices(letters, k=rng.randint(1, 40))) + rng.choice(["@firma.com", "@a1.Sub.firma.co", "@x.y"]) for _ in range(300)]
    mails += ["李明@firma.com", "محمد@firma.com", "łžő@firma.com", "x" * 100 + "@" + "ab1." * 100 + "de"]
    rows = [(i, f"to {m} now") for i, m in enumerate(mails)]
    out = {r.doc_id: r for r in pii.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    for i, m in enumerate(mails):
        (found,) = out[i].pii
        assert out[i].text == f"to {found.surrogate} now" and found.kind == "email"
        local, new = m.split("@")[0], found.surrogate.split("@")[0]
        assert len(local) == len(new) and all(a != b for a, b in zip(local, new) if a.isalnum()), (m, found)
        assert found.surrogate == mail_by_rule(m, "k") or mails.count(m) > 1 or len(local) < 4, (m, found, mail_by_rule(m, "k"))


def test_pii_of_an_address_of_a_million_labels(spark):
    """Longer than any stack: no pattern may go one deeper for each label."""
    text = "to x@" + "ab." * 1_000_000 + "com and y@" + "c-9." * 5_000 + "de"
    row = pii.replace_entities(spark.createDataFrame([(1, text), (2, "@" * 500_000), (3, "a." * 500_000 + "@"), (4, "1 " * 500_000)], "doc_id long, text string"), "k").orderBy("doc_id").collect()
    assert len(row[0].pii) == 2 and "ab." * 3 not in row[0].text and row[0].text.endswith(".example.de") and [r.text for r in row[1:3]] == ["@" * 500_000, "a." * 500_000 + "@"]


def test_pii_gives_more_addresses_than_their_shape_has_surrogates(spark, monkeypatch):
    rows = [(i, f"hr@c{i}.com") for i in range(500)]  # two consonants: 400 surrogates
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r.pii[0].surrogate for r in pii.replace_entities(docs, "k").collect()]
    assert len(got) == len({*got}) == 500 and not {*got} & {t for _, t in rows}
    assert all(re.fullmatch(r"[b-z]{2}@([b-z]+\.)?example\.com", s) for s in got)
    monkeypatch.setattr(pii, "LAST", 1)
    with pytest.raises(RuntimeError, match="email"):
        pii.replace_entities(docs, "k")


def test_pii_keeps_gender_script_and_check_digits(spark):
    rows = [
        (1, "Mr. John Smith met Mrs. Mary Smith and Mr. Smith"), (2, "г-жа Анна Иванова, г-н Иван Иванов"), (3, "κυρία Ελένη Παππά, κύριος Νίκος Παππάς"),
        (4, "pay to DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432"), (5, "saw Anna Klein there, and anna klein"), (6, "mail a@b.org and A@B.org, 555-12-3456"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.replace_entities(docs, "k").collect()}
    again = {r.doc_id: r for r in pii.replace_entities(docs, "k").collect()}
    other = {r.doc_id: r for r in pii.replace_entities(docs, "another key").collect()}
    assert {i: r.text for i, r in got.items()} == {i: r.text for i, r in again.items()} and all(got[i].text != other[i].text for i in got)
    of = lambda i: [x.surrogate for x in got[i].pii]

    def name(surrogate, script, g, title=""):
        given, last = surrogate.removeprefix(title).split(" ") if " " in surrogate.removeprefix(title) else (None, surrogate.removeprefix(title))
        assert given is None or given in pii.GIVEN[script][g]
        assert any(last == a + b for a in pii.STEMS[script] for b in pii.ENDINGS[script][g])
        return last

    his, her, alone = (name(x, "latin", g, t) for x, g, t in zip(of(1), "mfm", ("Mr. ", "Mrs. ", "Mr. ")))
    assert his == her == alone
    name(of(2)[0], "cyrillic", "f", "г-жа "), name(of(2)[1], "cyrillic", "m", "г-н ")
    name(of(3)[0], "greek", "f", "κυρία "), name(of(3)[1], "greek", "m", "κύριος ")
    name(of(5)[0], "latin", "f")
    assert got[5].text.endswith("there, and anna klein") and len(of(5)) == 1
    for old, new in zip(["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"], of(4)):
        plain = new.replace(" ", "")
        assert new != old and new[:2] == old[:2] and [*map(str.isalpha, new)] == [*map(str.isalpha, old)]
        assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    assert of(6)[0] == of(6)[1].lower() and re.fullmatch(r"\d{3}-\d{2}-\d{4}", of(6)[2]) and of(6)[2] != "555-12-3456"


def test_pii_of_many_persons_and_addresses(spark):
    """Against a plain count: as many surrogates as entities, and none that is some entity's own form."""
    rows = [(i, f"a@x{i}.com") for i in range(1500)] + [(5000 + i, f"Mr. {a}{b}{c} called") for i, (a, b, c) in enumerate((a, b, c) for a in "ABCDEFGH" for b in "aeiou" for c in "bcdfghklmn")]
    got = pii.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()
    made = [r.pii[0].surrogate for r in got]
    assert len(made) == len({x.lower() for x in made}) == len(rows)
    real = {t.split(" called")[0].lower() for _, t in rows}
    assert not real & {x.lower() for x in made} and not any(x.startswith("a@") for x in made)


def test_toxicity(spark):
    random.seed(4)
    plain = ["word", "some", "more", "text", "here", "again"]
    rows, labels = [], []
    for i in range(20, 320):
        bad = i % 5 == 0
        rows.append((i, " ".join(random.choices(plain, k=20) + (["you", f"grobal{i % 7}"] if bad else [])) + "."))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(edge_docs(spark).select("doc_id", "text"))
    marks = spark.createDataFrame([*labels, (20, 0), (None, 1), (9999, None)], "doc_id long, toxic int")
    got = toxicity.predict(docs, marks).collect()
    assert all(r.predicted == int(r.doc_id % 5 == 0) for r in got if (r.doc_id or 0) >= 20)
    assert len(got) == 300 + len(EDGES) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    m = toxicity.Model()
    plain, near, negated, said = (sum(m.clauses(t)) for t in ("such an idiot", "you are an idiot", "not an idiot", 'he said "an idiot"'))
    assert near > plain > said > 0 and plain > negated > 0 and sum(m.clauses("we will kill you")) > 0
    assert toxicity.predict(none(spark), marks).count() == 0 and toxicity.predict(docs, marks.limit(0)).count() == 300 + len(EDGES)


def plain_clauses(model, text):
    """Clause scores by looking back from each word, without states."""
    found = []
    for clause in re.split(r"[.!?;:\n]+", text.lower()):
        words = re.findall(r"[^\W\d_]+|[\"“”«»„]", clause)
        kinds = [toxicity.INSULT if w.isalpha() and model.weight(w) else toxicity.WORDS.get(w, toxicity.OTHER) for w in words]
        score, quoted, reported = 0.0, False, False
        for i, (w, kind) in enumerate(zip(words, kinds)):
            if w in "\"“”«»„":
                quoted = not quoted
                reported = False
            elif kind == toxicity.REPORT and not quoted:
                reported = True
            near = lambda what: any(k == what for k in kinds[max(0, i - toxicity.REACH) : i + 1])  # noqa: B023, E731
            factor = (1.5 if near(toxicity.TARGET) else 1.0) * (0.3 if near(toxicity.NEGATION) else 1.0) * (0.5 if quoted or reported else 1.0)
            if kind == toxicity.INSULT:
                score += factor * model.weight(w)
            elif kind == toxicity.THREAT:
                score += factor * toxicity.THREAT_WEIGHT
        if score:
            found.append(score)
    return found


def test_toxicity_grammar_by_brute_force():
    random.seed(12)
    model = toxicity.Model({"grobal": 2.5}, {"snar": 4.0})
    words = ["you", "not", "said", '"', "idiot", "kill", "the", "grobal", "snarly", "Dich", "x1", ",", ".", "!", "\n", "«", "plain", "never"]
    for _ in range(3000):
        text = " ".join(random.choices(words, k=random.randint(0, 25)))
        assert [round(x, 9) for x in model.clauses(text)] == [round(x, 9) for x in plain_clauses(model, text)], text
    assert model.score(None) == model.score("") == model.score("plain") and 0 < model.score("") < 0.5


def test_toxicity_learns_what_a_plain_count_finds(spark, monkeypatch):
    """All features of enough evidence, however few the counts that a task holds, and the same each time."""
    random.seed(13)
    rows = [(i, " ".join(random.choices(["alpha", "beta", "gamma", "delta"], k=9) + (["zorgle" + "xyz"[i % 3]] if i % 4 == 0 else []))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    marks = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    want = {}
    n = Counter(i % 4 == 0 for i, _ in rows)
    counts = defaultdict(Counter)
    for i, t in rows:
        for w in {*t.split()}:
            for f in {(w, False), *((w[:k], True) for k in toxicity.STEMS if k <= len(w))}:
                counts[f][i % 4 == 0] += 1
    for f, c in counts.items():
        a, b = c[True], c[False]
        cells = [(a, (a + b) * n[True]), (b, (a + b) * n[False]), (n[True] - a, (300 - a - b) * n[True]), (n[False] - b, (300 - a - b) * n[False])]
        odds = math.log((a + 0.5) / (n[True] + 1)) - math.log((b + 0.5) / (n[False] + 1))
        if a > b and 2 * sum(x * math.log(x * 300 / e) for x, e in cells if x and e) >= toxicity.EVIDENCE and odds > toxicity.ODDS:
            want[f] = round(odds, 9)
    assert len(want) >= 8
    for held in (toxicity.HELD, 5):
        monkeypatch.setattr(toxicity, "HELD", held)
        m = toxicity.learn(docs, marks)
        assert {(w, stem): round(x, 9) for stem, own in ((False, m.words), (True, m.stems)) for w, x in own.items()} == want


def test_toxicity_learns_from_all_labelled_rows(spark):
    """Insults that few of many labelled rows have, and a curve that is the same each time and fits all of them."""
    n, few = 60_000, [*range(7, 60_000, 5000)]
    text = F.when(F.col("id") % 5000 == 7, "you are a vorbulant").when(F.col("id") % 1000 == 3, "a vile blanstrope").otherwise(F.concat(F.lit("plain word "), F.col("id") % 9))
    docs = spark.range(n).repartition(5).select(F.col("id").alias("doc_id"), text.alias("text"))
    marks = spark.range(n).select(F.col("id").cast("int").alias("doc_id"), ((F.col("id") % 5000 == 7) | (F.col("id") % 1000 == 3)).cast("int").alias("toxic"))
    m = toxicity.learn(docs, marks)
    told = lambda a: math.log((a + 0.5) / (len(few) + 60 + 1)) - math.log(0.5 / (n - len(few) - 60 + 1))
    assert len(few) == 12 and m.words["vorbulant"] == pytest.approx(told(12)) and m.words["blanstrope"] == pytest.approx(told(60))
    assert toxicity.learn(docs, marks).curve == m.curve
    # At the best curve, what is expected is what there is, but for the shrinkage.
    p = [m.score(x) for x in ("you are a vorbulant", "a vile blanstrope", "plain word 1")]
    assert 12 * p[0] + 60 * p[1] + (n - 72) * p[2] == pytest.approx(72 - 1e-3 * m.curve[0], abs=1e-3)


def test_fingerprints(spark):
    random.seed(6)
    rows = [(i, "".join(random.choices("abcdefgh é", k=random.randint(0, 3000)))) for i in range(100, 160)] + EDGES
    rows.append((161, rows[0][1]))
    for parts in (1, 7):
        got = ctph.fingerprint_neighbours(spark.createDataFrame(rows, "doc_id long, text string").withColumn("bucket", F.lit(1)), parts).collect()
        order = sorted(((i, t or "") for i, t in rows), key=lambda r: -math.inf if r[0] is None else r[0], reverse=True)
        want = Counter()
        for k, (i, t) in enumerate(order):
            h = len(t) // 2
            want[i, len(t), hashlib.sha256((t[: len(t) - h] + order[(k + 1) % len(order)][1][:h]).encode()).hexdigest()] += 1
        assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
        by = {r.doc_id: r for r in got}
        assert by[161].fingerprint == by[100].fingerprint and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert ctph.fingerprint_neighbours(none(spark), 3).count() == 0
    # One id and null ids with many rows: they follow each other by their ties, in any number of tasks.
    many = spark.createDataFrame([(7 if i % 2 else None, f"text number {i} " * 5) for i in range(120)] + [(i, f"other {i} " * 9) for i in range(30)], "doc_id long, text string")
    ties = many.withColumn("tie", F.xxhash64(F.monotonically_increasing_id())).collect()
    order = sorted(ties, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.tie), reverse=True)
    want = {r.text: hashlib.sha256((r.text[: len(r.text) - len(r.text) // 2] + n.text[: len(r.text) // 2]).encode()).hexdigest() for r, n in zip(order, order[1:] + order[:1])}
    for parts in (1, 4, 16):
        got = ctph.fingerprint_neighbours(many, parts).collect()
        assert sorted(r.edited_sha256 for r in got) == sorted(want.values())
    bucket = ctph.Buckets([3, 7, 7, 7, 9], 2)
    rows = sorted(((i, t) for i in (1, 3, 5, 7, 8, 9, 20) for t in range(-(2**63), 2**63, 2**59)), reverse=True)
    at = bucket(pa.array([i for i, _ in rows] + [None] * 2), np.array([t for _, t in rows] + [2**62, -(2**62)]))
    assert (np.diff(at) >= 0).all() and len({x for x, (i, _) in zip(at.tolist(), rows) if i == 7}) == 3 and at[-2] != at[-1] and at[-2] > at[-3]

    def plain(a, b):
        row = [*range(len(b) + 1)]
        for i, x in enumerate(a):
            row = plain_row(row, x, b, i)
        return row[-1]

    def plain_row(row, x, b, i):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        return new

    pairs = [("".join(random.choices("ABCD", k=random.randint(1, 64))), "".join(random.choices("ABCD", k=random.randint(1, 64)))) for _ in range(100)]
    assert ctph.edit_distance(*map(list, zip(*pairs))).tolist() == [plain(a, b) for a, b in pairs]


def plain_fingerprint(text):
    data = text.encode()
    hashes = []
    for i in range(len(data)):
        h = 0
        for k in range(i - 6, i + 1):
            h = (h * 0x01000193 + (data[k] if k >= 0 else 0) + 1) % 2**32
        h ^= h >> 15
        h = h * 0x85EBCA6B % 2**32
        hashes.append(h ^ h >> 13)
    size = 1
    while size == 1 and len(data) > 63 or size > 1 and sum(h < 2**32 // size for h in hashes) > 63:
        size *= 2
    signatures = []
    for bound in (size, 2 * size, 4 * size):
        out, start = "", 0
        for i, h in enumerate(hashes):
            if bound == 1 or h < 2**32 // bound:
                out += ctph.LETTERS[zlib.crc32(data[start : i + 1]) >> 26]
                start = i + 1
        if start < len(data):
            out += ctph.LETTERS[zlib.crc32(data[start:]) >> 26]
        signatures.append(out)
    return f"{size}:{':'.join(signatures)}"


def plain_likeness(a, b):
    if a == b:
        return 1.0

    def by_size(f):
        n, *s = f.split(":")
        return {int(n) << k: x for k, x in enumerate(s)}

    def distance(x, y):
        row = [*range(len(y) + 1)]
        for i, c in enumerate(x):
            row = [i + 1, *row[1:]]
            before = i
            for j, d in enumerate(y):
                before, row[j + 1] = row[j + 1], min(before + (c != d), row[j + 1] + 1, row[j] + 1)
        return row[-1]

    best = 0.0
    for n, x in by_size(a).items():
        y = by_size(b).get(n, "")
        if any(x[i : i + ctph.RUN] in y for i in range(len(x) - ctph.RUN + 1)):
            best = max(best, 1 - distance(x, y) / max(len(x), len(y)))
    return best


def test_fingerprints_by_brute_force():
    random.seed(14)
    texts = ["", "a", "a" * 500, "ab" * 700, "é漢🙂" * 40] + ["".join(random.choices("abcdefgh é", k=random.randint(0, 900))) for _ in range(40)]
    texts += [t[: len(t) // 2] + u[len(u) // 2 :] for t, u in zip(texts, texts[1:])]
    prints = [ctph.fingerprint(t) for t in texts]
    assert prints == [plain_fingerprint(t) for t in texts]
    pairs = [(random.choice(prints), random.choice(prints)) for _ in range(300)] + [(p, prints[i + 45]) for i, p in enumerate(prints[:44])]
    got = ctph.likeness(*map(list, zip(*pairs)))
    assert [round(x, 9) for x in got] == [round(plain_likeness(a, b), 9) for a, b in pairs]


def plain_redaction(t):
    """Strong spans in brackets, what overlaps an earlier one as part of it."""
    found = [(m.start(), 0, m.end()) for m in re.finditer(secrets.ASSIGN, t) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    out, at = "", 0
    for i, k, j in sorted(found):
        if i >= at:
            out += t[at:i] + f"[{secrets.KINDS[k]}]"
        at = max(at, j)
    return out + t[at:]


def test_pipeline(spark, small):
    """Against the stages as plain functions over lists."""
    from tokenizers import Tokenizer

    cp = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r.doc_id: r for r in cp.run(spark, small).collect()}
    labels = spark.read.parquet(f"{small}/labels.parquet")
    model = toxicity.learn(toxicity.train_rows(docs), toxicity.train_rows(labels))
    rows = [r for r in docs.collect() if model.score(r.text) < toxicity.THRESHOLD]
    group = components([(r.doc_id, r.text) for r in rows], 5, 80)
    kept = {least for _, _, least in group}
    rows = [r for r in rows if r.doc_id in kept or not words(r.text)]
    index = decontaminate.Index([(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()])
    rows = [r for r in rows if next(decontaminate.contained(index, r.text, decontaminate.COVERAGE), None) is None]
    linked = {r.doc_id for r in secrets.scan(docs).where("n_linked > 0").collect()}
    t = Tokenizer.from_file(VOCABULARY)
    assert got.keys() == {r.doc_id for r in rows} and 0 < len(rows) < docs.count()
    for r in rows:
        if r.doc_id not in linked:
            assert got[r.doc_id].ids == t.encode(plain_redaction(r.text or ""), add_special_tokens=False).ids and got[r.doc_id].n_tokens == len(got[r.doc_id].ids)


def test_pipeline_stages_at_the_edges(spark, small):
    """Nulls, empty and long texts, repeated rows, empty tables and columns of clashing names, stage by stage."""
    cp = pytest.importorskip("corpus_pipeline")
    for docs in (edge_docs(spark), edge_docs(spark).limit(0)):
        n = docs.count()
        for name, stage in cp.STAGES[:-1]:
            out = stage(spark, docs, small)
            assert out.columns == docs.columns and out.count() == (n if name != "near_duplicates" or not n else n - 1), name
        last = cp.STAGES[-1][1](spark, docs, small)
        assert last.count() == n and {*last.columns} == {"doc_id", "lang", "source", "n_tokens", "ids"}
