"""Language-model scoring by context-tree weighting.

A text is a sequence of tokens: its words, then one end. It is coded as bytes: each word with a separator after it, the
end as a byte of its own. Each byte is eight binary decisions; each decision is predicted in the context of the DEPTH
bytes before it, across words and back to the text's beginning, by a tree over all depths from 0 to DEPTH: every node has
the Krichevsky-Trofimov estimate of its counts, and the tree mixes node and deeper nodes by the weights that the training
counts give, one half against the product of the children. A text's score is the log10 probability of its bytes; dividing
by their number and log10(2) gives the code length per byte.

How it is spread. What is counted are words, for the base score, and edges: DEPTH bytes of context and the next byte.
Both are 64-bit numbers (of a word its hash; two of n words share one with a chance of about n^2 / 2^65) and go through
the same steps. Tasks count them and send sorted runs, packed, to slots; a slot has all edges that share the last LOW
bytes of context, so the trees below are worked out slot by slot. What is above goes through a second, smaller grouping
by the last TOP bytes, and from there on it is at most 2^16 groups of 255 sums, on the driver. Counts and probabilities
return to the documents by blocks: documents are dealt into blocks of bounded size, each asks every slot for its own
distinct keys once, and gets the answers in the order it asked. No task needs the whole vocabulary or tree, and nothing
is broadcast but what is above.

Defined results: a null or empty text is one end; rows with equal ids are scored each, and a null id counts as the empty
text when rows are held out; without training rows every known count is 0, base scores follow from N = V = 0, and every
decision has probability one half; other columns are ignored; an empty table gives an empty table. Rows have to come in
one order each time they are read, as those of files do.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnmill.llm.common import distinct, fold, forget, gathered, materialise, mix, partitions, run_hashes, slices, tidy

DEPTH, LOW, TOP, SEPARATOR, END = 6, 4, 2, 0x20, 0x0A
LEAD = bytes(DEPTH - 1) + b" "
BLANK = re.compile(rb"[\x20\x09-\x0D]")
WORD, EDGE = 0, 1
#: Bytes of text in a block, that a task counts before it sends on, and for a slot; edges need no more slots than
#: EDGE_SLOTS, as not all of them are ever used.
BLOCK_BYTES, COUNT_BYTES, SLOT_BYTES, EDGE_SLOTS = 16_000_000, 64_000_000, 4_000_000, 4096
#: Bytes of text that are taken up at once, keys that are merged at once, blocks that ask one copy of a
#: slot, and slots of each sort for a task.
PIECE, HELD, ASKERS = 1 << 20, 1_500_000, 2000
SLOTS_A_TASK = 8


def bodies(text: str | None, most: int = PIECE) -> Iterator[tuple[bytes, bytes]]:
    """The text's bytes as coded, in pieces of whole words with the DEPTH bytes before each: bytes.lower() and
    bytes.split() go by A-Z and by space and U+0009 to U+000D alone."""
    data, lead, at = text.encode("utf-8", "surrogatepass").lower() if text else b"", LEAD, 0
    while True:
        cut = BLANK.search(data, at + most) if len(data) - at > most else None
        words = data[at : cut.start() if cut else len(data)].split()
        body = b" ".join(words) + b" " if words else b""
        if not cut:
            yield lead, body + b"\n"
            return
        if body:
            yield lead, body
            lead = (lead + body)[-DEPTH:]
        at = cut.start()


def edges_of(pieces: list[tuple[bytes, bytes]]) -> np.ndarray:
    """The edge of each byte of all bodies: the context, its latest byte in the highest place, and the byte."""
    data = b"".join([x for p in pieces for x in p])
    n = len(data) - DEPTH
    # Eight bytes from each place on, of which the first DEPTH are a context.
    ahead = np.ndarray((n,), "<u8", data + bytes(8 - DEPTH), strides=(1,))
    edge = ahead << np.uint64(8 * (8 - DEPTH))
    edge >>= np.uint64(8 * (7 - DEPTH))
    edge |= np.frombuffer(data, np.uint8)[DEPTH:]
    inside = np.ones(n, bool)
    for k in range(DEPTH):  # where the context is of the piece before
        inside[np.cumsum([len(b) + DEPTH for _, b in pieces[:-1]], dtype=np.int64) + (k - DEPTH)] = False
    return edge[inside]


def words_of(pieces: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all tokens, the end included, and where each body's begin."""
    data = np.frombuffer(b"".join([b for _, b in pieces]), np.uint8)
    last = np.flatnonzero((data == SEPARATOR) | (data == END))
    start = np.concatenate(([0], last[:-1] + 1))
    starts = np.cumsum([0, *(len(b) for _, b in pieces[:-1])])
    return run_hashes(data, start, last + (data[last] == END)), np.searchsorted(start, starts)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([len(keys) > 0], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def packed(x: np.ndarray, sorted_: bool = True) -> bytes:
    """64-bit numbers as compressed byte planes, of their differences if they are in order."""
    x = np.diff(x, prepend=x.dtype.type(0)) if sorted_ else x
    return zlib.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpacked(b: bytes, sorted_: bool = True) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(b), np.uint8).reshape(8, -1)
    x = np.ascontiguousarray(planes.T).view(np.uint64).ravel()
    return np.cumsum(x) if sorted_ else x.view(np.int64)


class Slots:
    """Which slot has a key: words first, then edges by the last LOW bytes of their context."""

    def __init__(self, text_bytes: int):
        self.words = max(8, math.ceil(text_bytes / SLOT_BYTES))
        self.edges = min(self.words, EDGE_SLOTS)

    def __call__(self, sort: int, keys: np.ndarray) -> np.ndarray:
        if sort == WORD:
            return (keys % np.uint64(self.words)).astype(np.int64)
        return self.of_low(keys >> np.uint64(8 * (DEPTH + 1 - LOW)))

    def of_low(self, low: np.ndarray) -> np.ndarray:
        return self.words + (mix(low.astype(np.uint64)) % np.uint64(self.edges)).astype(np.int64)

    def split(self, sort: int, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each slot and the places of its keys, in order."""
        slot = self(sort, keys)
        order = np.argsort(slot, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(slot[order])) + 1) if len(keys) else ():
            yield int(slot[part[0]]), part


def union(parts: list[np.ndarray]) -> np.ndarray:
    return distinct(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


class Census:
    """Distinct words and edges of texts, and how often training texts have them."""

    def __init__(self):
        self.found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {WORD: [], EDGE: []}

    def add(self, pieces: list[tuple[bytes, bytes]], weight: int) -> None:
        for sort, keys in ((WORD, words_of(pieces)[0]), (EDGE, edges_of(pieces))) if pieces else ():
            keys, n = np.unique(keys, return_counts=True)
            self.found[sort].append((keys, n * weight))
            first, *more = (len(k) for k, _ in self.found[sort])
            if sum(more) > max(HELD, first):  # what is merged already is merged again only with as many more
                self.merged(sort)

    def merged(self, sort: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.found[sort]) != 1:
            keys = union([k for k, _ in self.found[sort]])
            counts = np.zeros(len(keys), np.int64)
            for k, n in self.found[sort]:
                counts[np.searchsorted(keys, k)] += n
            self.found[sort] = [(keys, counts)]
        return self.found[sort][0]


def log_gamma(x: np.ndarray) -> np.ndarray:
    y = x + 8
    out = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    for k in range(8):
        out = out - np.log(x + k)
    return out


def estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - math.log(math.pi) - log_gamma(zeros + ones + 1)


class Level:
    """Nodes of one depth with their counts and log weighted probabilities. A node is its context and the bits of the
    next byte so far, with a leading one."""

    def __init__(self, nodes: np.ndarray, zeros: np.ndarray, ones: np.ndarray, weighted: np.ndarray):
        self.nodes, self.zeros, self.ones, self.weighted = nodes, zeros, ones, weighted

    def up(self, levels: int) -> tuple[Level, np.ndarray, np.ndarray, np.ndarray]:
        """The nodes so many levels above, the place among them of each own node, and a and b of each own node: a chance
        p that holds below becomes a + b * p when the levels above have been mixed in."""
        now, place = self, np.arange(len(self.nodes))
        a, b = np.zeros(len(self.nodes)), np.ones(len(self.nodes))
        for _ in range(levels):
            nodes, parent = np.unique((now.nodes >> 16) << 8 | now.nodes & 255, return_inverse=True)
            zeros, ones, below = (np.bincount(parent, x, len(nodes)) for x in (now.zeros, now.ones, now.weighted))
            own = estimate(zeros, ones)
            weighted = np.logaddexp(own, below) - math.log(2)
            place = parent[place]
            weight, chance = (np.exp(own - weighted) / 2)[place], ((ones + 0.5) / (zeros + ones + 1))[place]
            a, b = weight * chance + (1 - weight) * a, (1 - weight) * b
            now = Level(nodes, zeros, ones, weighted)
        return now, place, a, b


def leaves(edge: np.ndarray, count: np.ndarray) -> tuple[Level, np.ndarray, np.ndarray]:
    """The deepest nodes of some edges, and for each edge's eight decisions the node and the bit."""
    edge = edge.astype(np.int64)
    following = edge & 255
    bits = ((following[:, None] >> np.arange(7, -1, -1)) & 1).ravel()
    so_far = (following[:, None] | 256) >> np.arange(8, 0, -1)
    nodes, of_edge = np.unique(((edge >> 8 << 8)[:, None] | so_far).ravel(), return_inverse=True)
    weight = np.repeat(count.astype(float), 8)
    zeros, ones = (np.bincount(of_edge, weight * (bits == b), len(nodes)) for b in (0, 1))
    return Level(nodes, zeros, ones, estimate(zeros, ones)), of_edge, bits


def parts(edge: np.ndarray, most: int = 200_000) -> Iterator[slice]:
    """Runs of edges of about so many, none of which cuts those that share the last LOW bytes of context."""
    low = edge >> np.uint64(8 * (DEPTH + 1 - LOW))
    at = 0
    while at < len(edge):
        to = int(np.searchsorted(low, low[min(at + most, len(edge)) - 1], "right"))
        yield slice(at, to)
        at = to


def rows(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns.values()], [*columns])


def count(docs: DataFrame, slots: Slots) -> DataFrame:
    """slot, keys, counts, total, known: a row for each slot with all its keys, how often training rows have them, the
    sum of that and how many of them it is not 0 for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        census, taken = Census(), 0

        def out() -> Iterator[pa.RecordBatch]:
            for sort in (WORD, EDGE):
                keys, n = census.merged(sort)
                found = [(slot, packed(keys[at]), packed(n[at], False)) for slot, at in slots.split(sort, keys)]
                for i in range(0, len(found), 1000):
                    a, b, c = zip(*found[i : i + 1000])
                    yield rows({"slot": (a, pa.int64()), "keys": (b, pa.binary()), "counts": (c, pa.binary())})

        for whole in batches:
            for b in slices(whole, "text", PIECE):
                held = np.asarray(b.column("held_out"))
                texts = b.column("text").to_pylist()
                for weight in (0, 1):
                    pieces = [p for t, h in zip(texts, held.tolist()) if h != weight for p in bodies(t)]
                    census.add(pieces, weight)
                    taken += sum(len(p) for _, p in pieces)
                if taken > COUNT_BYTES:
                    yield from out()
                    census, taken = Census(), 0
        yield from out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def out() -> pa.RecordBatch:
            keys, n = summed(*(np.concatenate(x) for x in zip(*held)))
            return rows({"slot": ([at], pa.int64()), "keys": ([packed(keys)], pa.binary()), "counts": ([packed(n, False)], pa.binary()), "total": ([int(n.sum())], pa.int64()), "known": ([int((n > 0).sum())], pa.int64())})

        for b in batches:
            for slot, keys, n in zip(b.column("slot").to_pylist(), b.column("keys"), b.column("counts")):
                if held and slot != at:
                    yield out()
                    held = []
                at = slot
                held.append((unpacked(keys.as_py()), unpacked(n.as_py(), False)))
                if sum(len(k) for k, _ in held[1:]) > max(HELD, len(held[0][0])):
                    held = [summed(*(np.concatenate(x) for x in zip(*held)))]
        if held:
            yield out()

    sent = docs.select("held_out", "text").mapInArrow(tidy(run), "slot long, keys binary, counts binary")
    return sent.repartition(math.ceil(slots.words / SLOTS_A_TASK), "slot").sortWithinPartitions("slot").mapInArrow(tidy(merge), "slot long, keys binary, counts binary, total long, known long")


NODES = "node long, zeros double, ones double, weighted double"


def level_of(t: pa.Table) -> Level:
    return Level(*(np.asarray(t[c]) for c in ("node", "zeros", "ones", "weighted")))


def table_of(level: Level) -> dict[str, np.ndarray]:
    return {"node": level.nodes, "zeros": level.zeros, "ones": level.ones, "weighted": level.weighted}


def probabilities(counted: DataFrame, slots: Slots) -> DataFrame:
    """slot, keys, values: the log10 probability that the weighted trees give each edge, as 32-bit numbers."""
    edges = counted.where(F.col("slot") >= slots.words).select("slot", "keys", "counts")

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, n in zip(b.column("keys"), b.column("counts")):
                edge, n = unpacked(keys.as_py()), unpacked(n.as_py(), False)
                for s in parts(edge):
                    yield pa.RecordBatch.from_pydict(table_of(leaves(edge[s], n[s])[0].up(DEPTH - LOW)[0]))

    low = materialise(edges.mapInArrow(tidy(below), NODES), "low")
    # Nodes that share the last TOP bytes of context meet in one group, of which there are as many as partitions.
    grouped = low.withColumn("group", F.pmod(F.xxhash64(F.shiftright("node", 8 * (LOW - TOP) + 8)), F.lit(partitions(counted.sparkSession)))).groupBy("group")
    # At most 255 rows for each two bytes, whatever the corpus.
    top = Level(*gathered(grouped.applyInArrow(lambda t: pa.table(table_of(level_of(t).up(LOW - TOP)[0])), NODES), {"node": "i8", "zeros": "f8", "ones": "f8", "weighted": "f8"}))
    order = np.argsort(top.nodes)
    top = Level(*(x[order] for x in (top.nodes, top.zeros, top.ones, top.weighted)))
    _, _, top_a, top_b = top.up(TOP)
    names = top.nodes

    def above(t: pa.Table) -> pa.Table:
        own = level_of(t)
        level, place, a, b = own.up(LOW - TOP)
        at = np.searchsorted(names, level.nodes)[place]
        return pa.table({"slot": slots.of_low(own.nodes >> 8), "node": own.nodes, "a": top_a[at] + top_b[at] * a, "b": top_b[at] * b})

    upper = grouped.applyInArrow(tidy(above), "slot long, node long, a double, b double")

    def chances(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"slot": pa.array([], pa.int64()), "keys": pa.array([], pa.binary()), "values": pa.array([], pa.binary())})
        node, a, b = (np.asarray(right[c]) for c in ("node", "a", "b"))
        order = np.argsort(node)
        node, a, b = node[order], a[order], b[order]
        keys = left["keys"][0].as_py()
        edge, n = unpacked(keys), unpacked(left["counts"][0].as_py(), False)
        found = []
        for s in parts(edge):
            level, of_edge, bits = leaves(edge[s], n[s])
            top, place, low_a, low_b = level.up(DEPTH - LOW)
            p = low_a + low_b * (level.ones + 0.5) / (level.zeros + level.ones + 1)
            at = np.searchsorted(node, top.nodes)[place]
            p = (a[at] + b[at] * p)[of_edge]
            found.append(np.log10(np.where(bits == 1, p, 1 - p)).reshape(-1, 8).sum(axis=1).astype("f4"))
        return pa.table({"slot": pa.array([left["slot"][0].as_py()], pa.int64()), "keys": pa.array([keys], pa.binary()), "values": pa.array([np.concatenate(found).tobytes()], pa.binary())})

    return edges.groupBy("slot").cogroup(upper.groupBy("slot")).applyInArrow(tidy(chances), "slot long, keys binary, values binary")


def score(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every document."""
    docs = docs.select("doc_id", "text", (fold("doc_id", 10) == 0).alias("held_out"))
    kind, spark = docs.schema["doc_id"].dataType.simpleString(), docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    slots = Slots(size)
    counted = materialise(count(docs, slots), "counted")
    words = counted.where(F.col("slot") < slots.words)
    total, known_words = words.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("known"), F.lit(0))).first()
    known = materialise(words.select("slot", "keys", F.col("counts").alias("values")).unionByName(probabilities(counted, slots)), "known")
    forget(counted)

    n = max(1, math.ceil(size / block_bytes))
    copies = math.ceil(n / ASKERS)
    place = docs.withColumn("place", F.monotonically_increasing_id())
    dealt = place.select("doc_id", "text", "held_out", F.pmod(F.xxhash64("place"), F.lit(n)).cast("int").alias("block")).repartition(n, "block")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, found = None, {WORD: [], EDGE: []}

        def out() -> Iterator[pa.RecordBatch]:
            for sort, keys in found.items():
                keys = union(keys)
                wanted = [(slot, packed(keys[x])) for slot, x in slots.split(sort, keys)]
                for i in range(0, len(wanted), 1000):
                    a, b = zip(*wanted[i : i + 1000])
                    yield rows({"slot": (a, pa.int64()), "copy": ([at % copies] * len(a), pa.int32()), "block": ([at] * len(a), pa.int32()), "keys": (b, pa.binary())})
                found[sort] = []

        for whole in batches:
            for b in slices(whole, "text", PIECE):
                block, texts = np.asarray(b.column("block")), b.column("text").to_pylist()
                for x in np.unique(block).tolist():
                    if at is not None and x != at:
                        yield from out()
                    at = x
                    pieces = [p for t, k in zip(texts, block.tolist()) if k == x for p in bodies(t)]
                    found[WORD].append(distinct(words_of(pieces)[0]))
                    found[EDGE].append(distinct(edges_of(pieces)))
                    for sort, (first, *more) in found.items():
                        if sum(map(len, more)) > max(HELD, len(first)):
                            found[sort] = [union([first, *more])]
        if at is not None:
            yield from out()

    asked = dealt.select("text", "block").sortWithinPartitions("block").mapInArrow(tidy(ask), "slot long, copy int, block int, keys binary")
    there = known.select("slot", "keys", "values", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows:
            slot = left["slot"][0].as_py()
            keys, values = unpacked(right["keys"][0].as_py()), right["values"][0].as_py()
            values = unpacked(values, False) if slot < slots.words else np.frombuffer(values, "f4")
            for wanted in left["keys"]:
                wanted = unpacked(wanted.as_py())
                at = np.searchsorted(keys, wanted)
                if not np.array_equal(keys[np.minimum(at, len(keys) - 1)], wanted):
                    raise RuntimeError("rows came in another order than before")
                out.append(packed(values[at], False) if slot < slots.words else values[at].tobytes())
        return pa.table({"block": left["block"], "slot": left["slot"], "values": pa.array(out, pa.binary())})

    answers = asked.groupBy("slot", "copy").cogroup(there.groupBy("slot", "copy")).applyInArrow(tidy(answer), "block int, slot long, values binary")
    rest = math.log10(total + 0.1 * (known_words + 1))
    names = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]

    def back(left: pa.Table, right: pa.Table) -> pa.Table:
        # Of each slice: its rows, the row and length of each piece, where pieces' tokens begin, and its keys as places among
        # its distinct ones, which is a search in order.
        chunks = []
        for whole in left.select(["text"]).to_batches():
            for b in slices(whole, "text", PIECE):
                pieces = [(i, p) for i, t in enumerate(b.column("text").to_pylist()) for p in bodies(t)]
                own = [p for _, p in pieces]
                words, starts = words_of(own)
                found = {}
                for sort, keys in ((WORD, words), (EDGE, edges_of(own))):
                    own_keys, place = np.unique(keys, return_inverse=True)
                    found[sort] = own_keys, place.astype(np.int32)
                chunks.append((b.num_rows, np.array([i for i, _ in pieces]), np.array([len(p) for _, p in own]), starts, found))
        replies = dict(zip(right["slot"].to_pylist(), right["values"]))
        told = {}
        for sort, kind in ((WORD, np.int64), (EDGE, np.float32)):
            keys = union([found[sort][0] for *_, found in chunks])
            values = np.empty(len(keys), kind)
            for slot, at in slots.split(sort, keys):
                reply = replies[slot].as_py()
                values[at] = unpacked(reply, False) if sort == WORD else np.frombuffer(reply, "f4")
            told[sort] = keys, values
        n_tokens, n_known, base, score, n_bytes = ([] for _ in range(5))
        for n, of_doc, lengths, starts, found in chunks:
            c, lp = (told[sort][1][np.searchsorted(told[sort][0], own_keys)][place] for sort, (own_keys, place) in found.items())
            add = lambda x: np.bincount(of_doc, x, n)  # noqa: B023, E731
            n_tokens.append(add(np.diff(np.append(starts, len(c)))))
            n_known.append(add(np.add.reduceat((c > 0).astype(float), starts)))
            base.append(add(np.add.reduceat(np.log10(c + 0.1) - rest, starts)))
            score.append(add(np.add.reduceat(lp.astype(float), np.cumsum(lengths) - lengths)))
            n_bytes.append(add(lengths))
        n_tokens, n_known, base, score, n_bytes = (np.concatenate(x) if x else np.empty(0) for x in (n_tokens, n_known, base, score, n_bytes))
        found = (n_tokens.astype(np.int64), n_known.astype(np.int64), np.full(len(base), total, np.int64), base, score, -score / math.log10(2) / np.maximum(n_bytes, 1))
        return pa.table([left["doc_id"], left["held_out"], *map(pa.array, found)], ["doc_id", "held_out", *names])

    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(tidy(back), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
