"""Deterministic prompt rewriting, as column expressions without a shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnmill.functions.text import gsub, let, strip

#: Keywords of each domain, in the order that decides ties.
DOMAINS = {
    "cybersecurity": "security malware virus trojan ransomware phishing breach incident forensics exploit vulnerability attack defense firewall intrusion threat ioc indicator compromise anomaly suspicious".split(),
    "osint": ("osint", "open source", "intelligence", "investigate", "search", "find", "locate", "track", "monitor", "watch", "surveillance", "reconnaissance", "scout", "probe", "scan", "enumeration"),
    "business": "business company market revenue profit cost budget forecast strategy plan growth investment roi kpi metrics analytics dashboard report".split(),
    "code": "code function class method compile import module refactor debug bug fix patch git merge commit branch test lint type".split(),
    "professional": "professional report analysis research study review assessment evaluation audit compliance regulation policy procedure guideline standard".split(),
}
#: Filler, in the order in which it goes.
FILLER = [
    "i want to know", "i want", "i'd like", "i would like", "can you tell me", "can you", "could you", "i need you to", "i need", "help me with", "help me", "please", "thanks", "thank you",
    "a lot of", "kind of", "sort of", "type of", "basically", "essentially", "literally", "actually", "just", "really", "very", "quite", "pretty", "in order to", "for the purpose of", "as well as",
    "in addition to", "due to the fact that", "in spite of the fact that", "at this point in time", "at the present time", "i was wondering", "i'm wondering", "do you think", "would you be able",
    "it's important to note", "it should be noted",
]
#: Fixed patterns: fragments that become blanks, in this order.
FRAGMENTS = [r"\.{3,}", r"(?U)\b(\w+)\s+\1\b", r"(?U)\s+,", r"(?U),\s*,", r"(?U)\s+\.", r"\?{2,}", r"!{2,}"]
#: Fixed: where sentences end, and how many words each mode leaves.
SENTENCES = r"(?U)(?<=[.!?])\s+|\n+"
BUDGETS = {"aggressive": 20, "balanced": 50, "preserve": 150}
#: Fixed texts of the system prompt.
HINTS = {
    "business": "Structured. Metrics → trends → recommendation → risk. No hype.",
    "professional": "Numbered. Evidence → analysis → next step.",
    "osint": "Findings → sources (with confidence) → timeline → next lead.",
    "cybersecurity": "Threat → IOCs → mitigation → prevention.",
    "code": "Diff first, then plain explanation. Always include a verification step.",
    "general": "Plain language, no filler, lead with the answer.",
}
ENDING = "Output: lead with the answer or action. No filler. Format: tables / lists when they shorten. No code blocks unless asked. No thinking preamble."


def classify_domain(c: Column) -> Column:
    """The domain most of whose keywords occur, the first of equals; text and scores are worked out once."""

    def choose(s: Column) -> Column:
        best = F.greatest(*(s[d] for d in DOMAINS))
        out = F.when(best == 0, "general")
        for d in DOMAINS:
            out = out.when(s[d] == best, d)
        return out

    scores = lambda low: F.struct(*(reduce(lambda a, b: a + b, (low.contains(w).cast("int") for w in words)).alias(d) for d, words in DOMAINS.items()))
    return let(let(F.lower(F.coalesce(c, F.lit(""))), scores), choose)


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, SENTENCES), strip), lambda s: s != "")


def ended(c: Column) -> Column:
    return let(c, lambda x: F.when((x != "") & ~x.rlike(r"[.!?]\z"), F.concat(x, F.lit("."))).otherwise(x))


def reframe(c: Column) -> Column:
    """Without filler, fragments and repeated sentences."""
    s = c
    for phrase in FILLER:
        s = gsub(s, rf"(?iU)\b{phrase}\b")
    for pattern in FRAGMENTS:
        s = gsub(s, pattern, " ")
    # Pairs of a sentence and what decides whether two are equal; the first of equals stays.
    both = F.transform(F.split(s, SENTENCES), lambda x: F.struct(strip(x).alias("text"), strip(gsub(gsub(F.lower(x), r"[^a-z0-9 ]", " "), r"\s+", " ")).alias("key")))
    kept = F.aggregate(
        both, F.struct(F.array().cast("array<string>").alias("keys"), F.array().cast("array<string>").alias("out")),
        lambda a, x: F.when((x["key"] == "") | F.array_contains(a["keys"], x["key"]), a).otherwise(F.struct(F.array_append(a["keys"], x["key"]).alias("keys"), F.array_append(a["out"], x["text"]).alias("out"))),
        lambda a: a["out"],
    )
    out = strip(gsub(F.array_join(kept, " "), r"(?U)\s+", " "))
    return ended(let(out, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x)))))


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def shrink(c: Column, mode: str = "balanced", budget: int | None = None) -> Column:
    """The sentences that rank highest, up to the first that exceeds the budget of words, in their old order."""
    most = budget if budget and budget > 0 else BUDGETS.get(mode, 50)
    pieces = "array<struct<i:int,text:string>>"

    def choose(candidates: Column, asked: Column) -> Column:
        def ranked(s: Column, i: Column) -> Column:
            score = let(words(s), lambda w: F.size(F.filter(w, lambda x: F.array_contains(asked, x))) * 2 + F.size(w))
            return F.struct((-score).alias("score"), i.alias("i"), s.alias("text"), F.size(F.split(strip(s), r"(?U)\s+")).alias("size"))

        def take(a: Column, x: Column) -> Column:
            full = a["full"] | ((a["used"] + x["size"] > most) & (F.size(a["out"]) > 0))
            more = F.array_append(a["out"], F.struct(x["i"].alias("i"), x["text"].alias("text")))
            return F.struct((a["used"] + x["size"]).alias("used"), full.alias("full"), F.when(full, a["out"]).otherwise(more).alias("out"))

        start = F.struct(F.lit(0).alias("used"), F.lit(False).alias("full"), F.array().cast(pieces).alias("out"))
        taken = F.aggregate(F.array_sort(F.transform(candidates, ranked)), start, take, lambda a: F.array_join(F.transform(F.array_sort(a["out"]), lambda x: x["text"]), " "))
        return F.when(F.size(candidates) == 0, c).otherwise(ended(strip(taken)))

    asked = F.filter(words(c), lambda w: F.length(w) > 3)
    found = let(sentences(reframe(c)), lambda s: F.when(F.size(s) > 0, s).otherwise(sentences(c)))
    return F.when(c == "", c).otherwise(let(asked, lambda q: let(found, lambda s: choose(s, q))))


def minify_prompt(c: Column) -> Column:
    return gsub(strip(gsub(c, r"(?U)\s+", " ")), r"[,;:!?]{2,}")


def build_system(domain: Column, role: str = "generalist", style: str = "terse", rules: tuple[str, ...] = ()) -> Column:
    hint = F.coalesce(F.create_map(*(F.lit(x) for pair in HINTS.items() for x in pair))[domain], F.lit(HINTS["general"]))
    listed = [F.lit("Rules: " + "; ".join(rules[:6]))] if rules else []
    return F.concat_ws(" ", F.lit(f"Role: {role}."), F.lit(f"Style: {style}."), F.concat(F.lit("Domain ("), domain, F.lit("): "), hint), *listed, F.lit(ENDING))


def frame(c: Column, mode: str = "balanced", budget: int | None = None, system: str = "", **how) -> Column:
    """tight, system and domain of a prompt."""
    composed = lambda d: F.concat(F.lit(system + "\n\n"), build_system(d, **how)) if system else build_system(d, **how)
    tight = let(reframe(c), lambda x: minify_prompt(shrink(x, mode, budget)))
    return let(classify_domain(c), lambda d: F.struct(tight.alias("tight"), composed(d).alias("system"), d.alias("domain")))
