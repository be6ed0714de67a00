"""HTML pruning, as one chain of replacements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnmill.functions.text import gsub, let, strip

#: Fixed values and patterns, those of the functions below included: elements that go with their content, attributes, parts of pages, class names, tags that become breaks.
TAGS = "circle clipPath defs line link mask meta noscript path polygon polyline rect script style svg symbol use".split()
PARTS = "nav footer header aside".split()
CLASSES = "nav menu footer header sidebar advert cookie modal overlay".split()
ATTRIBUTES = "style class id tabindex role onclick onload onerror onmouseover onmouseout".split()
BREAKS, SPACES = "div p br li h[1-6] tr section article".split(), "span a strong em b i u code".split()
ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&nbsp;": " ", "&quot;": '"'}
GATE, LONG, HEAD, TAIL = 4096, 8000, 4000, 2000
HINT = r"(?i)<(?:html|!doctype|body|div|script)\b"


def where_found(c: Column, pattern: str, rule) -> Column:
    """rule of c where a cheap pattern is found, else c as it is; c is worked out once."""
    return let(c, lambda x: F.when(x.rlike(pattern), rule(x)).otherwise(x))


def strip_element(c: Column, tag: str) -> Column:
    """Without the elements of a tag: with their content where they are closed, else their tags alone. Pages without
    a closing tag are not searched for one at each opening tag."""
    alone = rf"<{tag}[^>]*>"
    return where_found(c, rf"(?i)<{tag}", lambda x: gsub(F.when(x.rlike(rf"(?i)</{tag}>"), gsub(x, rf"(?is)<{tag}[^>]*>.*?</{tag}>")).otherwise(x), rf"(?i){alone}"))


def strip_tags(c: Column) -> Column:
    for tag in TAGS:
        c = strip_element(c, tag)
    return c


def strip_parts(c: Column) -> Column:
    for part in PARTS:
        c = where_found(c, rf"(?i)</{part}>", lambda x, part=part: gsub(x, rf"(?is)<{part}[^>]*>.*?</{part}>"))
    named = rf'class="[^"]*(?:{"|".join(CLASSES)})[^"]*"'
    return where_found(c, f"(?i){named}", lambda x: gsub(x, rf"(?is)<(\w+)[^>]*{named}[^>]*>.*?</\1>"))


def strip_attributes(c: Column) -> Column:
    return gsub(c, rf'\s+(?:(?:data|aria)-[a-zA-Z_-]+|{"|".join(ATTRIBUTES)})="[^"]*"')


def collapse(c: Column) -> Column:
    for tags, new in ((BREAKS, "\n"), (SPACES, " ")):
        c = gsub(c, rf"(?i)</?(?:{'|'.join(tags)})[^>]*>", new)
    for entity, char in ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(char))
    return strip(gsub(gsub(c, r"\n{3,}", "\n\n"), r"[ \t]{2,}", " "))


def prune(c: Column) -> Column:
    """The text of a page, its middle left out if it is long."""
    t = collapse(strip_attributes(strip_parts(strip_tags(c))))
    return F.when(F.length(t) > LONG, F.concat(F.substring(t, 1, HEAD), F.lit("\n... [truncated] ...\n"), F.substring(t, -TAIL, TAIL))).otherwise(t)


def looks_like_page(c: Column) -> Column:
    return (F.length(c) > GATE) & c.rlike(HINT)
