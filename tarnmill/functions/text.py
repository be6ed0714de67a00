"""Fence-aware text primitives, as column expressions.

A fence is a block between lines of three backticks or tildes; its bytes survive every expression here. Null stays null.
Regular expressions use Unicode classes, as the rules they state do.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A fence from its opening line to its closing line, or to the end of the text if it isn't closed.
FENCE = r"(?ms)^[ \t]*(```|~~~)(?![ \t]+\S)[^\n]*(?:\n.*?^[ \t]*\1[ \t]*$\n?|.*\z)"
SEGMENT = "array<struct<fence:boolean,text:string>>"

#: Phrases, punctuation and white space of low value, in the order in which they go.
HEDGES = "I think|I believe|I feel|In my opinion|It seems|It appears|Basically|Actually|Honestly"
LOW_VALUE = [rf"(?iu)\b(?:{HEDGES})\b", r"[!?.]{3,}", r"\n{4,}", r"(?U)^\s+|\s+\z"]
BANNER = r"^[=\-─│*_~#]+$"
SENTENCE_END = r"(?U)(?<=[.!?])\s+"


def let(c: Column, f) -> Column:
    """f of a value that is worked out once, however often f uses it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def gsub(c: Column, pattern: str, new: str = "") -> Column:
    return F.regexp_replace(c, pattern, new)


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return gsub(c, r"(?U)\A\s+|\s+\z")


def segments(c: Column) -> Column:
    """The text in order as pieces of prose and fences."""
    prose, fences = F.split(c, FENCE, -1), F.regexp_extract_all(c, F.lit(FENCE), F.lit(0))
    pairs = F.zip_with(prose, fences, lambda p, f: F.array(F.struct(F.lit(False).alias("fence"), p.alias("text")), F.struct(F.lit(True).alias("fence"), f.alias("text"))))
    return F.filter(F.flatten(pairs), lambda s: F.coalesce(s["text"], F.lit("")) != "").cast(SEGMENT)


def on_prose(c: Column, rule) -> Column:
    """The text with a rule applied to each piece of prose; texts without a fence take no detour through arrays."""
    joined = F.array_join(F.transform(segments(c), lambda s: F.when(s["fence"], s["text"]).otherwise(rule(s["text"]))), "")
    return F.when(c.contains("```") | c.contains("~~~"), joined).otherwise(rule(c))


def blank_runs(c: Column) -> Column:
    """At most one blank line in a row, no blanks at line ends."""
    return gsub(gsub(c, r"\n{3,}", "\n\n"), r"(?md)[ \t]+$")


def minify_text(c: Column) -> Column:
    return gsub(on_prose(c, blank_runs), r"\A\n+|\n+\z")


def strip_low_value(c: Column) -> Column:
    for pattern in LOW_VALUE:
        c = gsub(c, pattern)
    return strip(c)


def collapse_whitespace(c: Column) -> Column:
    return strip(gsub(gsub(c, r"\n{3,}", "\n\n"), r"[ \t]{2,}", " "))


def truncate_verbose(c: Column, most: int = 500) -> Column:
    """The first two sentences and the last of a long text of more than three, else its beginning."""
    s = F.split(c, SENTENCE_END)
    short = F.concat(F.substring(c, 1, most), F.lit("..."))
    ends = F.concat_ws(" ", F.element_at(s, 1), F.try_element_at(s, F.lit(2)), F.lit("..."), F.element_at(s, -1))
    return F.when(F.length(c) <= most, c).when(F.size(s) <= 3, short).otherwise(ends)


def drop_banners(c: Column) -> Column:
    """Of equal decoration lines in a row only the first."""
    lines = F.split(c, "\n", -1)
    return F.array_join(F.filter(lines, lambda x, i: ~(strip(x).rlike(BANNER) & (i > 0) & (x == F.try_element_at(lines, i)))), "\n")


def minify_system(c: Column) -> Column:
    return strip(on_prose(c, lambda p: drop_banners(collapse_whitespace(strip_low_value(p)))))


def cut_prose(c: Column, budget: Column) -> Column:
    """At most so many characters, up to the first sentence end at or after the 41st if there is one."""
    start = F.substring(c, F.lit(1), budget)
    cut = F.regexp_extract(start, r"(?Us)\A(.{40,}?[.!?。！？])\s", 1)
    return F.when(F.length(c) <= budget, c).when(cut != "", cut).otherwise(gsub(start, r"(?U)\s+\z"))


def distill(c: Column, most: int = 240, note: str = "[distilled from %d chars]", least: int = 360) -> Column:
    """A long text's first fence and the beginnings of its prose, which share one budget; a note has the old length."""
    start = F.struct(F.lit("").alias("out"), F.lit(most).alias("left"), F.lit(False).alias("seen"))

    def step(a: Column, s: Column) -> Column:
        chunk = F.when(a["left"] > 0, cut_prose(s["text"], a["left"])).otherwise("")
        fence = F.when(a["seen"], "").otherwise(s["text"])
        return F.struct(
            F.concat(a["out"], F.when(s["fence"], fence).otherwise(chunk)).alias("out"), F.when(s["fence"], a["left"]).otherwise(a["left"] - F.length(chunk)).alias("left"), (a["seen"] | s["fence"]).alias("seen"),
        )

    def noted(kept: Column) -> Column:
        return F.when(F.length(kept) < F.length(c), F.concat(kept, F.lit("\n\n"), F.format_string(note, F.length(c)))).otherwise(kept)

    return F.when(F.length(c) <= least, c).otherwise(let(strip(F.aggregate(segments(c), start, step, lambda a: a["out"])), noted))
