"""Lossy compressors of tool results by their shape, as column expressions; the first that fits is used.

Only JSON compaction, which has to keep keys and escapes as they are, runs in Python, over Arrow batches.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tarnmill.functions.text import gsub, let, strip

LEAST, KEPT, WIDE, LONGEST_JSON = 200, 60, 160, 4000
PREFIX = "[compressed] "
#: Fixed patterns: a line of a directory listing, a log line's time, source keywords, parts of a version-control report.
LISTED = r"(?U)^[dls-]?[rwx-]{9,10}\s+\d+\s+\S+\s+\S+\s+\d+\s+"
TIMED = r"(?U)^\s*\d{4}[-/]\d{2}[-/]\d{2}[\dT ][\d:.\-]+\s*"
KEYWORD = r"(?U)\b(def|class|function|return|if|for|import|const|var|public)\b"
HEADLINE = r"^(commit |Author:|Date:|Merge:)"
#: Lines of source that are neither blank nor comments.
CODE = r"(?U)^\s*(?:#!|#pragma|(?!//|#)\S)"
CHANGE = r"(?U)^(\+|@@|-\s|--- )"


def lines_of(c: Column) -> Column:
    """The text's lines, at every kind of line end; one at the text's end begins no line."""
    return F.split(gsub(gsub(c, r"\r\n|[\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]", "\n"), r"\n\z"), "\n", -1)


def hits(lines: Column, pattern: str) -> Column:
    return F.size(F.filter(lines, lambda x: x.rlike(pattern)))


def over_lines(c: Column, f) -> Column:
    """f of the text's lines, which are worked out once."""
    return let(lines_of(c), f)


def listing(c: Column, lines: Column) -> Column:
    """The names in a directory listing."""

    def names(some: Column) -> Column:
        of = F.transform(F.filter(some, lambda x: x.rlike(LISTED)), lambda x: F.element_at(F.split(strip(gsub(x, LISTED)), r"(?U)\s+"), -1))
        return F.filter(of, lambda x: ~x.isin("", ".", ".."))

    def told(n: Column) -> Column:
        more = F.when(F.size(n) > KEPT, F.concat(F.lit(" ... (+"), (F.size(n) - KEPT).cast("string"), F.lit(" more)"))).otherwise("")
        return F.concat(F.lit("dir listing: "), F.array_join(F.slice(n, 1, KEPT), ", "), more)

    some = F.size(F.filter(lines, lambda x: x.rlike(r"(?U)\S")))
    return F.when((some >= 8) & (hits(lines, LISTED) >= F.greatest(F.lit(6.0), some * 0.6)), let(names(lines), told))


def version_control(c: Column, lines: Column) -> Column:
    kept = F.filter(F.transform(lines, lambda x: let(strip(x), lambda s: F.when(s.rlike(HEADLINE), x).when(s.rlike(CHANGE), F.substring(s, 1, 120)))), lambda x: x.isNotNull())
    report = let(kept, lambda k: F.when(F.size(k) > 0, F.concat(F.lit("git: "), F.array_join(F.slice(k, 1, KEPT), " | "))))
    return F.when(c.contains("git ") | F.substring(c, 1, 40).contains("commit "), report)


def log(c: Column, lines: Column | None = None) -> Column:
    if lines is None:
        return over_lines(c, lambda x: log(c, x))
    n = F.size(lines)
    some = lambda a: F.array_join(F.transform(a, lambda x: F.substring(strip(x), 1, WIDE)), "\n")
    body = F.concat(F.lit("log "), n.cast("string"), F.lit(" lines:\n"), some(F.slice(lines, 1, 5)), F.lit("\n...\n"), some(F.slice(lines, F.greatest(n - 4, F.lit(1)), F.lit(5))))
    return F.when((n >= 20) & (hits(lines, TIMED) >= F.greatest(F.lit(10.0), n * 0.5)), body)


def compacted(text: str) -> str | None:
    """A long JSON list or object without white space, if that makes it smaller."""
    s = text.strip()
    if len(text) < LEAST or s[:1] not in ("[", "{"):
        return None
    try:
        compact = json.dumps(json.loads(s), separators=(",", ":"))
    except (ValueError, RecursionError):
        return None
    return "json: " + compact[:LONGEST_JSON] if len(compact) < len(s) * 0.85 else None


@F.pandas_udf(StringType())
def compact_json(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t and compacted(t))


def source(c: Column, lines: Column | None = None) -> Column:
    if lines is None:
        return over_lines(c, lambda x: source(c, x))
    n = F.size(lines)
    code = F.filter(lines, lambda x: x.rlike(CODE))
    kept = F.transform(F.slice(code, 1, KEPT), lambda x: F.substring(gsub(x, r"(?U)\s+\z"), 1, WIDE))
    return F.when((n >= 12) & ((hits(lines, r"(?U)^\s") > n * 0.3) | (hits(lines, KEYWORD) > 3)), F.concat(F.lit("source:\n"), F.array_join(kept, "\n")))


def wrap(c: Column, body: Column, prefix: str = PREFIX) -> Column:
    return F.concat(F.lit(prefix), F.octet_length(c).cast("string"), F.lit("B -> "), F.octet_length(body).cast("string"), F.lit("B; "), body)


def compress_text(c: Column, as_json: Column | None = None, prefix: str = PREFIX) -> Column:
    """The compressed text, or null if no shape fits. as_json: what compact_json() made of it, if that is wanted."""
    packed = F.lit(None).cast("string") if as_json is None else as_json
    body = over_lines(c, lambda x: F.coalesce(listing(c, x), version_control(c, x), log(c, x), packed, source(c, x)))
    return F.when(F.length(c) >= LEAST, let(body, lambda b: wrap(c, b, prefix)))
