"""How filters act on each other, whatever the order in which they run.

Each document becomes a mask with a bit for each filter that it fails. Masks are counted by part before anything is
unpivoted, so what follows grows with parts and not with documents: every cell of a part meets every step of every order, a
running bit-or over an order's steps tells which filters a cell has failed earlier, conditional sums give a step's counts,
and a window over all steps of a filter gives its total over all orders.

Defined results: a null text is empty, a null part the empty string; a document without a label counts as neither good nor
toxic, one with several labels as whatever any of them says; of equal texts only those with the smallest id are no copies,
repeated rows of that id among them, and a null id is never a copy; rows count as often as they stand in the table; texts
are taken whole; other columns may have any names; an empty table has no parts and so no rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnmill.llm.common import WORD

LEAST_WORDS, DISTINCT_PCT, CAPITALS_PCT, MARKS = 200, 50, 2, r"[#$%&*|]"


def text_filters(text: Column) -> dict[str, Column]:
    """The filters that look at one text: whether it fails each."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < DISTINCT_PCT * n,
        "C": 100 * capitals > CAPITALS_PCT * F.length(text),
        "D": text.rlike(MARKS),
    }


def mask_of(failed: Mapping[str, Column]) -> Column:
    """The bits of the filters that fail, the first filter's the lowest."""
    return sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failed.values())), F.lit(0)).cast("int")


def masks(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: how many documents of a part fail just these filters, and how many of them are labelled
    as good or toxic. The bit after those of text_filters() is that of later copies: of a text's documents in a part, all
    but those of the least id of any part. The texts are read once and nothing is written: what a text has in a part is
    summed up on the map side, with its least id there, so a window over a text's parts holds no more rows than parts."""
    text = F.coalesce("text", F.lit(""))
    d = documents.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    failed = text_filters(F.col("text"))
    d = d.select("doc_id", "part", mask_of(failed).alias("mask"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("key"))
    d = d.groupBy("doc_id", "part", "key", "mask").agg(F.count("*").alias("n"))
    flags = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    counts = ("n", "good", "toxic")
    d = d.join(flags, "doc_id", "left").select("doc_id", "part", "key", "mask", "n", *(F.when(F.col(c), F.col("n")).otherwise(0).alias(c) for c in counts[1:]))
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", *counts)))
    without = F.struct(*(F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col(c))), F.lit(0)).alias(c) for c in counts))
    d = d.groupBy("key", "part", "mask").agg(least.alias("least"), without.alias("without"), *(F.sum(c).alias(c) for c in counts))
    d = d.withColumn("is_first", F.col("least.doc_id") == F.min("least.doc_id").over(Window.partitionBy("key")))
    first = {c: F.col(f"without.{c}") + F.when(F.col("is_first"), F.col(f"least.{c}")).otherwise(0) for c in counts}
    cell = lambda mask, n: F.struct(mask.alias("mask"), *(n[c].alias(c) for c in counts))
    cells = F.array(cell(F.col("mask"), first), cell(F.col("mask") + (1 << len(failed)), {c: F.col(c) - first[c] for c in counts}))
    d = d.select("part", F.explode(cells).alias("cell")).select("part", "cell.*").where("n > 0")
    return d.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in counts))


def interactions(cells: DataFrame, filters: Sequence[str]) -> DataFrame:
    """A row for each part, order of the filters and step, from cells as masks() gives them: what is kept after the step
    and removed at it; what fails its filter but was removed earlier; what fails no other filter; the good and toxic among
    the removed; and shapley, all that its filter removes over all orders. One exchange by part serves every window: a
    part has at most 2^filters cells of filters * filters! rows."""
    orders = F.array(*(F.lit("".join(p)) for p in permutations(filters)))
    steps = F.sequence(F.lit(1), F.lit(len(filters)))
    long = cells.repartition("part").select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(steps).alias("step"))
    long = long.withColumn("filter", F.expr("substring(filter_order, step, 1)"))
    long = long.withColumn("bit", F.call_function("shiftleft", F.lit(1), F.call_function("instr", F.lit("".join(filters)), F.col("filter")) - 1))
    fails = F.col("mask").bitwiseAND(F.col("bit"))
    order = Window.partitionBy("part", "mask", "filter_order").orderBy("step")
    seen = F.bit_or(fails).over(order.rowsBetween(Window.unboundedPreceding, 0))
    before = F.coalesce(F.bit_or(fails).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    long = long.withColumn("fails", fails != 0).withColumn("passed", seen == 0).withColumn("gone", before != 0)
    count = lambda c, n="n": F.sum(F.when(c, F.col(n)).otherwise(0)).cast("long")
    removed = F.col("fails") & ~F.col("gone")
    counts = long.groupBy("part", "filter_order", "step", "filter").agg(
        count(F.col("passed")).alias("kept"), count(removed).alias("removed"), count(F.col("fails") & F.col("gone")).alias("redundant"), count(F.col("mask") == F.col("bit")).alias("unique_fails"),
        count(removed, "good").alias("good_lost"), count(removed, "toxic").alias("toxic_lost"),
    )
    return counts.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).select("part", "filter_order", F.col("step").cast("int").alias("step"), "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The interactions of the five filters over documents (doc_id, text, source) and labels (doc_id, quality, toxic)."""
    return interactions(masks(documents, labels), "ABCDE")
