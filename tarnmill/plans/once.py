"""Work that equal contents share: done once for each distinct content, joined back, and kept from run to run.

A content is one or more text columns. Its key is a digest in which lengths go before values, so that neither borders nor
nulls are mistaken. Copies collapse where they are read, before the shuffle. On the way back, contents that hold over a
thousandth of all rows, of which there are fewer than a thousand, are spread over salts, so that no task gets all copies of
one; all others are joined by their digest alone.

A store keeps results by digest under the name of their work, which covers its parameters. Each run adds the contents that
no complete run has yet; a run that broke off leaves nothing that is read, and the same content from two runs at a time
counts once. What a store gives is what the work would give: work has to depend on the contents alone.

Defined results: every row comes back once, repeated ones too; null contents are contents like any other; an empty table
gives an empty one; columns of rows besides the contents stay, whatever their names, and are replaced where work gives a
column of that name.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnmill.functions import tools
from tarnmill.plans.bodies import COUNTS, minify
from tarnmill.plans.optimize import Config
from tarnmill.sources.requests import detect_format
from tarnmill.sources.tables import complete, remove

#: A content is hot if it holds more than one of so many rows; its copies are spread over so many keys.
HOT_SHARE, SALTS = 1000, 64


def digest(*contents: str) -> Column:
    """A digest of columns that tells apart null from empty, and where one ends."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    # Never null, and told so, which spares the plan a filter by which equal exchanges would differ.
    return F.coalesce(F.sha2(F.concat(*map(part, contents)).cast("binary"), 256), F.lit(""))


def work_name(name: str, **parameters) -> str:
    """A name of some work that differs wherever its parameters do, and is the same in every session."""
    plain = lambda x: sorted(x) if isinstance(x, (set, frozenset)) else str(x)
    return f"{name}-{hashlib.sha256(json.dumps(parameters, sort_keys=True, default=plain).encode()).hexdigest()[:16]}"


class Store:
    """Results by digest in a shared folder, a folder of Parquet files for each work and run."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def runs(self, work: str) -> list[str]:
        return complete(self.spark, f"{self.path}/{work}/run-*")

    def results(self, work: str) -> DataFrame | None:
        """All kept results of some work, with their digest in _key; one that two runs added stands there twice."""
        runs = self.runs(work)
        return self.spark.read.parquet(*runs) if runs else None

    def add(self, work: str, results: DataFrame) -> None:
        results.write.parquet(f"{self.path}/{work}/run-{uuid.uuid4().hex}")

    def merge(self, work: str) -> None:
        """Make one run of all complete ones. If it breaks off, results stand there twice, and none is
        lost; jobs that read the old runs at the same time fail for want of files, and can be run again."""
        runs = self.runs(work)
        if len(runs) < 2:
            return
        self.add(work, self.spark.read.parquet(*runs).dropDuplicates(["_key"]))
        remove(self.spark, runs)


def once(rows: DataFrame, contents: list[str], work: Callable[[DataFrame], DataFrame], store: Store | None = None, name: str | None = None) -> DataFrame:
    """rows with what work makes of their contents. work gets the distinct contents, with a column _key, and returns them,
    one row each, with _key and the columns that it adds or changes, and no others; those are joined back. With a store, the contents
    that it lacks under this name are worked out and added at once, and all else is read from it."""
    if {"_key", "_copies"} & {c.lower() for c in contents}:
        raise ValueError("contents can't be named _key or _copies")
    # All of a row travels as one value, so that no name in it meets one of ours.
    whole = rows.select(digest(*contents).alias("_key"), F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("_own"))
    # Copies are counted by digest alone, so contents shuffle once.
    copies = rows.select(digest(*contents).alias("_key")).groupBy("_key").agg(F.count("*").alias("_copies"))
    distinct = rows.select(digest(*contents).alias("_key"), *contents).distinct()
    if store is None:
        done = work(distinct)
    else:
        if not name:
            raise ValueError("results are kept under a name that tells their work and its parameters")
        kept = store.results(name)
        store.add(name, work(distinct if kept is None else distinct.join(kept.select("_key"), "_key", "left_anti")))
        # Runs at the same time may have added a content twice; only what these rows need is looked at.
        done = store.results(name).join(copies.select("_key"), "_key", "left_semi").dropDuplicates(["_key"])
    added = [c for c in done.columns if c != "_key"]
    total = copies.agg(F.sum("_copies")).scalar()
    # Fewer than HOT_SHARE rows of a digest each, so this side may be broadcast, and so may not what it is joined to.
    hot = copies.where(F.col("_copies") * HOT_SHARE > total).select("_key", F.lit(SALTS).alias("_salts"))
    salted = whole.withColumn("_row", F.monotonically_increasing_id()).join(F.broadcast(hot), "_key", "left")
    salted = salted.select("_key", "_own", F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64("_row"), F.lit(SALTS))).otherwise(0).cast("int").alias("_salt"))
    results = done.select("_key", F.struct(*(F.col(f"`{c}`") for c in added)).alias("_new")).join(F.broadcast(hot), "_key", "left")
    spread = results.select("_key", "_new", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)).alias("_salt"))
    out = salted.join(spread, ["_key", "_salt"], "left")
    new = {c: F.col("_new").getField(c).alias(c) for c in added}
    return out.select(*(new.pop(c, F.col("_own").getField(c).alias(c)) for c in rows.columns), *[new[c] for c in added if c not in rows.columns])


def minify_once(requests: DataFrame, cfg: Config, store: Store | None = None) -> DataFrame:
    """minify() of requests (request_id, body and, if there is one, path): equal bodies of one format are one piece of work."""
    fmt = detect_format(F.col("path")) if "path" in requests.columns else F.lit(None).cast("string")
    name = "format_of_body"
    while name in {c.lower() for c in requests.columns}:
        name += "_"

    def work(distinct: DataFrame) -> DataFrame:
        return minify(distinct, cfg, F.col(name)).select("_key", "body", *COUNTS)

    return once(requests.withColumn(name, fmt), ["body", name], work, store, work_name("minify", **asdict(cfg))).drop(name)


def minify_tools_once(definitions: DataFrame, skip: tuple[str, ...] = (), store: Store | None = None) -> DataFrame:
    """minify_tools() of definitions (name, description, schema_json): a definition that many requests bring is slimmed once."""
    return once(definitions, ["name", "description", "schema_json"], lambda d: tools.minify_tools(d, skip).drop("name"), store, work_name("tools", skip=skip))


def count_once(rows: DataFrame, text: str, counter: Callable[[Column], Column], out: str, store: Store | None = None, name: str | None = None) -> DataFrame:
    """rows with the tokens of a text column as counter tells them, null as empty; each distinct text is counted once."""
    return once(rows, [text], lambda d: d.select("_key", counter(F.coalesce(F.col(text), F.lit(""))).alias(out)), store, name)
