"""A manifest of a dataset as Merkle trees, one for each source and one over their roots, with a proof for every row.

Rows are sorted by range, so a leaf's place in its source follows from its place in its partition and the counts of the
partitions before it; no task holds a source. A tree is built TIER levels at a time: one grouping by block of GROUP^TIER
nodes gives all levels inside the block, and their nodes go to a written table. Proofs go down by tiers: a node that is the
base of a tier explodes the coordinates of the siblings that it needs inside its block, from its place and the number of
nodes on each level, joins the node table, orders what it finds and appends the proof of its block, so no node of the upper
levels is ever looked up by all leaves below it. The fold is an expression over the proof.

Defined results: a null field counts as '-', an empty one as length 0; texts are hashed whole; leaves of equal doc_id are in
the order of their digests and a null doc_id comes first, as does a null source, which is a source by itself; repeated rows
are leaves each; other columns may have any names; an empty table has no leaves and so no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnmill.llm.common import forget, materialise, partitions

GROUP, TIER = 3, 4
BLOCK = GROUP**TIER
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
STEP = "array<struct<left:binary,right:binary>>"


def digest(c: Column) -> Column:
    """The SHA-256 of bytes."""
    return F.unhex(F.sha2(c, 256))


def as_text(c: Column) -> Column:
    """Digests go into others as lower-case hex."""
    return F.lower(F.hex(c))


def field(c: Column) -> Column:
    text = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(text: Column | None = None) -> Column:
    """The digest of a row, or of the row with another text."""
    parts = [field(text if text is not None and name == "text" else F.col(name)) for name in FIELDS]
    return digest(F.concat(*parts).cast("binary"))


def joined(nodes: Column) -> Column:
    """Digests of an array as one text."""
    return F.array_join(F.transform(nodes, as_text), "")


def ranked(rows: DataFrame, by: str, *order: str) -> DataFrame:
    """rows with pos (the place among those of equal by, in this order) and n (how many there are) as a written table,
    without a task that holds all rows of a group: rows are sorted by range and counted by partition. by has no nulls."""
    names = [*rows.columns, "_part", "_row"]
    schema = T.StructType([*rows.schema.fields, T.StructField("_part", T.LongType()), T.StructField("_row", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part)), pa.array(np.arange(row, row + b.num_rows))], names)
            row += b.num_rows

    keys = [F.col(c).asc_nulls_first() for c in (by, *order)]
    placed = materialise(rows.repartitionByRange(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(run, schema), "ranked")
    group = Window.partitionBy(by)
    runs = placed.groupBy("_part", by).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    earlier = F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("_part", by, (earlier - F.col("_first")).alias("_shift"), F.sum("_n").over(group).alias("n"))
    found = materialise(placed.join(runs, ["_part", by]).select(*rows.columns, (F.col("_row") + F.col("_shift")).alias("pos"), "n"), "places")
    forget(placed)
    return found


def above(nodes: Column) -> Column:
    """The next level of an array of digests: each run of GROUP makes one."""
    runs = F.ceil(F.size(nodes) / GROUP).cast("int")
    return F.transform(F.sequence(F.lit(0), runs - 1), lambda i: digest(joined(F.slice(nodes, i * GROUP + 1, GROUP)).cast("binary")))


def blocks_of(base: DataFrame) -> DataFrame:
    """tree, block, n (nodes of the tree at the base) and levels (arrays of digests, from the base up) of nodes given as
    tree, pos, n, node. Where one node remains there is no level above it."""
    held = F.transform(F.array_sort(F.collect_list(F.struct("pos", "node"))), lambda x: x["node"])
    b = base.groupBy("tree", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.first("n").alias("n"), held.alias("l0"))
    for level in range(1, TIER + 1):
        last = F.col(f"l{level - 1}")
        b = b.withColumn(f"l{level}", F.when(F.col("n") > GROUP ** (level - 1), above(last)))
    return b.select("tree", "block", "n", F.filter(F.array(*(f"l{i}" for i in range(TIER + 1))), lambda x: x.isNotNull()).alias("levels"))


def next_base(blocks: DataFrame) -> DataFrame:
    """The nodes that one grouping leaves, in the form that blocks_of() takes."""
    return blocks.select("tree", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).cast("long").alias("n"), F.element_at(F.element_at("levels", -1), 1).alias("node"))


def built(base: DataFrame, label: str) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each tier, written, and tree, root."""
    tiers = []
    while True:
        tiers.append(materialise(blocks_of(base), label))
        base = next_base(tiers[-1])
        if tiers[-1].where(F.col("n") > BLOCK).isEmpty():
            return tiers, base.select("tree", F.col("node").alias("root"))


def levels_below(n: Column) -> Column:
    """The levels of a tier on which a tree of n nodes at its base has more than one node."""
    return F.filter(F.sequence(F.lit(0), F.lit(TIER - 1)), lambda i: n > width(i))


def width(level: Column) -> Column:
    """Base nodes below a node of a level."""
    return F.element_at(F.array(*(F.lit(GROUP**i).cast("long") for i in range(TIER + 1))), level + 1)


def coordinates(pos: Column, n: Column) -> Column:
    """level, at and before of all siblings that the proof of a base node needs inside its block."""

    def on(level: Column) -> Column:
        own, nodes = F.floor(pos / width(level)), F.ceil(n / width(level))
        run = F.transform(F.sequence(F.lit(0), F.lit(GROUP - 1)), lambda i: own - own % GROUP + i)
        return F.transform(F.filter(run, lambda at: (at != own) & (at < nodes)), lambda at: F.struct(level.alias("level"), at.alias("at"), (at < own).alias("before")))

    return F.flatten(F.transform(levels_below(n), on))


def nodes_of(blocks: DataFrame) -> DataFrame:
    """The node table of a tier: tree, level, at, found."""
    rows = blocks.select("tree", "block", F.posexplode("levels").alias("level", "held")).where(F.col("level") < TIER)
    return rows.select("tree", "level", (F.col("block") * F.floor(F.lit(BLOCK) / width(F.col("level")))).alias("first"), F.posexplode("held").alias("i", "found")).select("tree", "level", (F.col("first") + F.col("i")).alias("at"), "found")


def lookup(base: DataFrame, blocks: DataFrame) -> DataFrame:
    """tree, pos and found: the siblings of base nodes inside their blocks, in order; nodes without any have no row."""
    asked = base.select("tree", "pos", F.explode(coordinates(F.col("pos"), F.col("n"))).alias("w")).select("tree", "pos", "w.*")
    looked = asked.join(nodes_of(blocks), ["tree", "level", "at"])
    return looked.groupBy("tree", "pos").agg(F.array_sort(F.collect_list(F.struct("level", "at", "before", "found"))).alias("siblings"))


def steps_of(siblings: Column, n: Column) -> Column:
    """A step for each level of a tier: the texts of the digests before and after the path's node in its run."""
    side = lambda i, before: F.to_binary(joined(F.transform(F.filter(siblings, lambda x: (x["level"] == i) & (x["before"] == before)), lambda x: x["found"])), F.lit("utf-8"))
    return F.transform(levels_below(n), lambda i: F.struct(F.coalesce(side(i, True), F.lit(b"")).alias("left"), F.coalesce(side(i, False), F.lit(b"")).alias("right"))).cast(STEP)


def proofs(base: DataFrame, tiers: list[DataFrame], onward: DataFrame, label: str) -> DataFrame:
    """base (tree, pos, n and more) with steps, the proof of each row, and what onward has for its tree: onward's steps
    follow those up to the tree's root."""
    more = [c for c in onward.columns if c not in ("tree", "steps")]
    below = onward.withColumn("block", F.lit(0).cast("long"))
    for k in range(len(tiers) - 1, -1, -1):
        nodes = base if k == 0 else next_base(tiers[k - 1])
        rows = nodes.join(lookup(nodes, tiers[k]), ["tree", "pos"], "left").withColumn("own", steps_of(F.col("siblings"), F.col("n"))).withColumn("block", F.floor(F.col("pos") / BLOCK)).drop("siblings")
        rows = rows.join(below, ["tree", "block"]).withColumn("steps", F.concat("own", "steps")).drop("block", "own")
        if k:
            below = materialise(rows.select("tree", F.col("pos").alias("block"), "steps", *more), label)
    return rows


def folded(node: Column, steps: Column) -> Column:
    """The root that a node and its proof give."""
    return F.aggregate(steps, node, lambda a, s: digest(F.concat(s["left"], as_text(a).cast("binary"), s["right"])))


def proof_digest(steps: Column) -> Column:
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["left"].cast("string"), s["right"].cast("string"))), "").cast("binary"), 256)


def manifest(documents: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot (of its source's tree), root (of the tree over all sources), steps (the proof), folded (where
    the proof leads from the row as it is found) and verified, of every row of documents (FIELDS); digests are bytes.
    tampered: the text that is found, if it isn't the one that the manifest is made of."""
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))  # null comes first
    leaves = materialise(documents.select("doc_id", tree.alias("tree"), leaf().alias("node"), leaf(tampered).alias("checked")), "leaves")
    base = ranked(leaves, "tree", "doc_id", "node")
    forget(leaves)
    tiers, roots = built(base, "nodes")
    tops = ranked(roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("node")), "tree", "name")
    top_tiers, top = built(tops, "nodes")
    end = top.select("tree", "root", F.array().cast(STEP).alias("steps"))
    onward = materialise(proofs(tops, top_tiers, end, "proofs").select(F.col("name").alias("tree"), F.col("node").alias("subroot"), "root", "steps"), "proofs")
    rows = proofs(base, tiers, onward, "proofs").withColumn("folded", folded(F.col("checked"), F.col("steps")))
    return rows.select("doc_id", F.col("node").alias("leaf"), "subroot", "root", "steps", "folded", (F.col("folded") == F.col("root")).alias("verified"))


def digests(found: DataFrame) -> DataFrame:
    """manifest() with digests as lower-case hex and each proof as the digest of its siblings from the leaf up."""
    return found.select("doc_id", *(as_text(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")), proof_digest(F.col("steps")).alias("proof_sha256"), as_text(F.col("folded")).alias("folded_root"), "verified")
