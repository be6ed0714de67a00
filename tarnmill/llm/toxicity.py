"""Toxicity by a weighted finite-state pattern grammar.

Five transducers read a clause's words together: insult, threat, target, negation and reported speech. Their composition
is one table of states, and a clause scores what the table puts out over it: an insult or threat by its weight, more
near a target, less under negation or in reported speech. A document's score comes from its clauses' scores: their
highest, and their sum. What scores is the path that a clause takes through the table, so one word counts differently by
what stands around it. An insult without a target has its plain weight, as the labels mark such texts as toxic too; a
clause that no insult or threat is in scores 0.

Beside a short fixed list, the insults are learned: words and stems (beginnings of four to eight letters) that training
documents marked as toxic have and others lack, all that reach EVIDENCE and ODDS. Learning uses all labelled rows: their
texts are joined with their labels once, features are counted and the curve is fitted by sums that tasks work out.

Defined results: a null or empty text has no clause and scores as such; a score is from 0 to 1; without labels of both
kinds the intercept is 0.01 and nothing is predicted; several labels of a document count as toxic if one says so, null
labels are ignored; repeated rows stay; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnmill.llm.common import fold, forget, gathered, materialise, slices, tidy

#: The filter of rows that may have a label, which only spares the shuffle of others: its slots.
FILTER = 1 << 24
#: A feature is kept with at least this much evidence (the likelihood ratio of its counts) and log odds.
EVIDENCE, ODDS = 21.0, 2.0
#: Features that a task holds before it sends their counts on.
HELD = 1_000_000
STEMS = range(4, 9)
WORD = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[.!?;:\n]+")
NEXT = re.compile(r"[^\W\d_]+|[\"“”«»„]")
THRESHOLD = 0.7

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE = range(7)
#: Fixed word lists in the four languages of the corpus.
THREATS = "kill murder stab strangle töten umbringen ermorden erwürgen matar asesinar degollar tuer assassiner égorger".split()
TARGETS = "you your yours yourself u ur they them their dich dir dein deine euch ihr eure tú ti usted ustedes vosotros tus toi vous votre vos tes".split()
NEGATIONS = "not never no neither nor isn aren wasn don doesn nicht kein keine keinen nie niemals nunca jamás tampoco pas jamais aucun aucune".split()
REPORTS = "said says wrote writes claimed reported quoted called allegedly sagte schrieb behauptete zitierte dijo escribió afirmó citó dit écrit affirme déclare".split()
WORDS = {w: kind for kind, words in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in words}
#: Common insults, known before any label is seen.
INSULTS = "idiot idiots moron morons stupid loser losers trash scum worthless pathetic disgusting clown clowns imbecile dumb dumbass bastard bitch asshole cretin vermin dumm dummkopf idioten trottel arschloch abschaum versager widerlich ekelhaft wertlos idiota imbécil estúpido estúpida basura escoria perdedor asqueroso payaso inútil idiote imbécile stupide débile ordure minable abruti crétin connard salaud pathétique".split()
INSULT_WEIGHT = 3.0
THREAT_WEIGHT = 2.0
#: A negation or target reaches so many words on; reported speech reaches to the end of the clause or quotation.
REACH = 3

Machine = tuple[int, dict[tuple[int, int], int], dict[int, float]]


def reach_machine(trigger: int, factor: float) -> Machine:
    """In state k > 0 the trigger was k - 1 words ago; what is put out there is multiplied by factor."""
    moves = {(s, c): (1 if c == trigger else s + 1 if 0 < s <= REACH else 0) for s in range(REACH + 2) for c in range(7)}
    return REACH + 2, moves, {s: factor if s else 1.0 for s in range(REACH + 2)}


def report_machine(factor: float) -> Machine:
    """State 1: after a verb of saying; 2: inside a quotation."""
    moves = {(s, c): (2 if s != 2 and c == QUOTE else 0 if c == QUOTE else 1 if c == REPORT and not s else s) for s in range(3) for c in range(7)}
    return 3, moves, {0: 1.0, 1: factor, 2: factor}


def hit_machine(kind: int) -> Machine:
    """In state 1 the word just read is of the kind, which puts its weight out."""
    return 2, {(s, c): int(c == kind) for s in range(2) for c in range(7)}, {0: 0.0, 1: 1.0}


def compose(*machines: Machine) -> Machine:
    """The product of machines that read the same words: states in pairs, what they put out multiplied."""
    n, moves, out = machines[0]
    for m, more, then in machines[1:]:
        moves = {(s * m + t, c): moves[s, c] * m + more[t, c] for s in range(n) for t in range(m) for c in range(7)}
        out = {s * m + t: out[s] * then[t] for s in range(n) for t in range(m)}
        n *= m
    return n, moves, out


SETTING = compose(reach_machine(TARGET, 1.5), reach_machine(NEGATION, 0.3), report_machine(0.5))
GRAMMAR = {kind: compose(hit_machine(kind), SETTING) for kind in (INSULT, THREAT)}


KNOWN = dict.fromkeys(INSULTS, INSULT_WEIGHT)


@dataclass
class Model:
    """Words and stems with their weights, and the logistic curve over a document's clause scores."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    curve: tuple[float, float, float] = (math.log(0.01 / 0.99), 0.0, 0.0)

    def weight(self, word: str) -> float:
        """The insult's weight, or 0."""
        best = max(self.words.get(word, 0.0), KNOWN.get(word, 0.0))
        for n in STEMS:
            if n <= len(word):
                best = max(best, self.stems.get(word[:n], 0.0))
        return best

    def clauses(self, text: str) -> list[float]:
        """The scores above 0 of a text's clauses."""
        low = text.lower()
        hits = {w: x for w in {*WORD.findall(low)} if (x := self.weight(w)) or WORDS.get(w) == THREAT}
        if not hits:
            return []
        scores = []
        for clause in CLAUSE.split(low):
            read = NEXT.findall(clause)
            if hits.keys().isdisjoint(read):
                continue
            states, score = {kind: 0 for kind in GRAMMAR}, 0.0
            for w in read:
                c = INSULT if hits.get(w) else QUOTE if len(w) == 1 and not w.isalpha() else WORDS.get(w, OTHER)
                for kind, (_, moves, out) in GRAMMAR.items():
                    states[kind] = moves[states[kind], c]
                    if gain := out[states[kind]]:
                        score += gain * (hits[w] if kind == INSULT else THREAT_WEIGHT)
            scores.append(score)
        return scores

    def features(self, text: str | None) -> tuple[float, float]:
        scores = self.clauses(text) if text else []
        return math.log1p(max(scores, default=0.0)), math.log1p(sum(scores))

    def score(self, text: str | None) -> float:
        a, b, c = self.curve
        x, y = self.features(text)
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, a + b * x + c * y))))


def fit_curve(points: DataFrame) -> tuple[float, float, float]:
    """Logistic regression with a little shrinkage, by Newton's method, from toxic, x, y and n, the number of documents
    that are so. A step takes sums of the gradient and the curvature over all of them, which come from the tasks."""
    w = np.zeros(3)
    pull = np.diag([1e-3, 0.05, 0.05])
    for _ in range(60):

        def sums(batches: Iterator[pa.RecordBatch], w: np.ndarray = w.copy()) -> Iterator[pa.RecordBatch]:
            for b in batches:
                toxic, x, y, n = (np.asarray(b.column(c)).astype(float) for c in ("toxic", "x", "y", "n"))
                z = np.column_stack([np.ones(len(x)), x, y])
                p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
                found = np.concatenate((((z * (n * (p * (1 - p) + 1e-6))[:, None]).T @ z).ravel(), z.T @ (n * (toxic - p))))
                yield pa.RecordBatch.from_arrays([pa.array([found.tolist()], pa.list_(pa.float64()))], ["sums"])

        # Exact sums of the parts don't depend on their order.
        total = np.array([math.fsum(c) for c in zip(*(r.sums for r in points.mapInArrow(sums, "sums array<double>").collect()))])
        step = np.linalg.solve(total[:9].reshape(3, 3) + pull, total[9:] - pull @ w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def evidence(toxic: Column, clean: Column, all_toxic: int, all_clean: int) -> Column:
    """The likelihood-ratio statistic of a feature's two document counts."""
    total = float(all_toxic + all_clean)
    having = toxic + clean
    cells = ((toxic, having * all_toxic), (clean, having * all_clean), (all_toxic - toxic, (total - having) * all_toxic), (all_clean - clean, (total - having) * all_clean))
    terms = [F.when((n > 0) & (e > 0), n * F.ln(n * total / e)).otherwise(0.0) for n, e in cells]
    return (terms[0] + terms[1] + terms[2] + terms[3]) * 2


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """toxic and text of every row of docs that has a label. A filter of fixed size keeps most other texts unshuffled."""
    marked = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER)).cast("int").alias("slot")
    marks = np.zeros(FILTER, bool)
    marks[gathered(marked.select(slot).distinct(), {"slot": "i4"})[0]] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(marks, bitorder="little"))

    def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.asarray(b.column("slot"))
            yield b.filter(pa.array((shared.value[at >> 3] >> (at & 7)) & 1 == 1)).select(["doc_id", "text"])

    some = docs.select("doc_id", "text", slot).mapInArrow(may, docs.select("doc_id", "text").schema)
    return some.join(marked, "doc_id").select((F.col("toxic") != 0).cast("int").alias("toxic"), "text")


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """The model that all labelled documents give. Their texts are shuffled once, to their labels; features are counted in
    the tasks first."""
    train = materialise(labelled(docs, labels), "train")

    def rows_of(whole: pa.RecordBatch) -> Iterator[tuple[int, str]]:
        for b in slices(whole, "text"):
            for mark, text in zip(b.column("toxic").to_pylist(), b.column("text")):
                yield mark, text.as_py() or ""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())

        def out() -> Iterator[pa.RecordBatch]:
            found = [*seen[0].keys() | seen[1].keys()]
            for i in range(0, len(found), 100_000):
                part = found[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.string()), pa.array([x for _, x in part], pa.bool_()), *(pa.array([seen[m][x] for x in part], pa.int64()) for m in (1, 0))], ["feature", "stem", "toxic", "clean"])
            seen[0].clear(), seen[1].clear()

        for b in batches:
            for mark, text in rows_of(b):
                words = {*WORD.findall(text.lower())}
                seen[mark].update({(w, False) for w in words if len(w) > 2} | {(w[:n], True) for w in words for n in STEMS if n <= len(w)})
                seen[mark][("", False)] += 1
                if len(seen[0]) + len(seen[1]) > HELD:
                    yield from out()
        yield from out()

    counts = materialise(train.mapInArrow(tidy(count), "feature string, stem boolean, toxic long, clean long").groupBy("feature", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where("toxic > clean or feature = ''"), "features")
    totals = counts.where("feature = ''").first()
    if totals is None or not totals.toxic or not totals.clean:
        forget(counts)
        forget(train)
        return Model()
    odds = F.ln((F.col("toxic") + 0.5) / (totals.toxic + 1)) - F.ln((F.col("clean") + 0.5) / (totals.clean + 1))
    told = counts.where("feature <> ''").select("feature", "stem", odds.alias("odds"), evidence(F.col("toxic"), F.col("clean"), totals.toxic, totals.clean).alias("evidence"))
    kept = told.where((F.col("evidence") >= EVIDENCE) & (F.col("odds") > ODDS)).collect()
    forget(counts)
    model = Model({r.feature: r.odds for r in kept if not r.stem}, {r.feature: r.odds for r in kept if r.stem})

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(mark, *model.features(text)) for mark, text in rows_of(b)]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int32()), *(pa.array([g[k] for g in got], pa.float64()) for k in (1, 2))], ["toxic", "x", "y"])

    points = materialise(train.mapInArrow(tidy(measure), "toxic int, x double, y double").groupBy("toxic", "x", "y").agg(F.count("*").alias("n")).sortWithinPartitions("toxic", "x", "y"), "points")
    model.curve = fit_curve(points)
    forget(points)
    forget(train)
    return model


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score. No shuffle."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([*map(model.score, b.column("text").to_pylist())], pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, score double")


def train_rows(docs: DataFrame) -> DataFrame:
    return docs.where(fold("doc_id", 3) != 1)


def predict(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: learned from the labels of rows whose fold of three isn't 1."""
    model = learn(train_rows(docs), train_rows(labels))
    scored = score_documents(docs, model)
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model doesn't reject, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                yield b.filter(pa.array([model.score(t) < THRESHOLD for t in b.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
