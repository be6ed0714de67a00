"""Counts of runs (ts, run_id, tokens_in, tokens_out) as they come: windows of time, a ledger that replays leave alone, and
the last runs of each key.

windows() closes windows behind a watermark; rows that come later than it allows for are in no window, as Spark has it, and so
are rows without a time. The ledger has them all: each batch of a stream adds its sums in a folder of its own, named by query
and batch, and sums of batches add up in any order. A batch that runs again finds its folder complete and leaves it, or
writes an incomplete one anew. last_runs() and LastRuns keep the latest runs by (ts, run_id), whatever order they come in.

Defined results: null counts count as 0; a null time is a window of its own in the ledger and comes before all others among
the last runs; rows of equal time and id count each; an empty table has no windows and no last runs, and totals of 0.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from heapq import nlargest

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tarnmill.sources.tables import complete, remove

#: How many runs a history goes back.
LAST = 60
SUMS = ["runs", "tokens_in", "tokens_out"]


def saved_and_ratio(d: DataFrame) -> DataFrame:
    return d.withColumn("saved", F.col("tokens_in") - F.col("tokens_out")).withColumn("ratio", F.when(F.col("tokens_in") > 0, F.round(F.col("saved") / F.col("tokens_in"), 4)).otherwise(0.0))


def counted() -> list[Column]:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return [F.count("*").alias("runs"), total("tokens_in"), total("tokens_out")]


def windows(runs: DataFrame, width: str, late: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """start, keys, runs, tokens_in, tokens_out, saved and ratio of each tumbling window, of a table or of a stream; late is
    how far behind a stream's rows may come. In append mode a window comes once, after the watermark has passed it."""
    d = runs.withWatermark("ts", late) if late else runs
    return saved_and_ratio(d.groupBy(F.window("ts", width), *keys).agg(*counted()).select(F.col("window.start").alias("start"), *keys, *SUMS))


def start_of(ts: Column, seconds: int) -> Column:
    micros = F.unix_micros(ts.cast("timestamp"))
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(seconds * 1_000_000)))


def window_sums(runs: DataFrame, seconds: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """start, keys, runs, tokens_in and tokens_out of each window, rows without a time in one of their own."""
    return runs.groupBy(start_of(F.col("ts"), seconds).alias("start"), *keys).agg(*counted())


class Ledger:
    """Sums by window and key in a shared folder: one of Parquet files for each query and batch. A query is told by its
    checkpoint, so one that starts from a new checkpoint adds to the ledger and takes nothing for done."""

    def __init__(self, path: str, seconds: int = 3600, keys: tuple[str, ...] = ()):
        self.path, self.seconds, self.keys = path.rstrip("/"), seconds, keys

    def record(self, runs: DataFrame, batch: int, query: str) -> None:
        """Add a batch, unless it is there."""
        at = f"{self.path}/{query}/batch-{batch}"
        if batch > self.merged(runs.sparkSession, query) and not complete(runs.sparkSession, at):
            window_sums(runs, self.seconds, self.keys).write.mode("overwrite").parquet(at)

    def sink(self) -> Callable[[DataFrame, int], None]:
        """What foreachBatch() takes."""

        def add(runs: DataFrame, batch: int) -> None:
            query = runs.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
            if not query:
                raise RuntimeError("a batch of no known query can't be told from others")
            self.record(runs, batch, query)

        return add

    def merged(self, spark: SparkSession, query: str) -> int:
        """The last batch that a merged folder covers; it covers all before it."""
        return max((number(p) for p in complete(spark, f"{self.path}/{query}/merged-*")), default=-1)

    def folders(self, spark: SparkSession) -> list[str]:
        """The complete folders that together have each batch once."""
        by_query: dict[str, list[str]] = {}
        for p in complete(spark, f"{self.path}/*/*-*"):
            by_query.setdefault(p.rsplit("/", 2)[1], []).append(p)
        found = []
        for query, paths in by_query.items():
            upto = max((number(p) for p in paths if is_merged(p)), default=-1)
            found += [p for p in paths if (number(p) == upto if is_merged(p) else number(p) > upto)]
        return found

    def sums(self, spark: SparkSession) -> DataFrame | None:
        """start, keys, runs, tokens_in, tokens_out, saved and ratio of each window over all batches; None before the first."""
        paths = self.folders(spark)
        if not paths:
            return None
        return saved_and_ratio(spark.read.parquet(*paths).groupBy("start", *self.keys).agg(*(F.sum(c).alias(c) for c in SUMS)))

    def totals(self, spark: SparkSession) -> DataFrame:
        """One row: runs, tokens_in, tokens_out, saved and ratio of all that was ever recorded."""
        sums = self.sums(spark)
        given = spark.createDataFrame([], "runs long, tokens_in long, tokens_out long") if sums is None else sums
        return saved_and_ratio(given.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS)))

    def merge(self, spark: SparkSession) -> None:
        """Make one folder of a query's batches but its last, which may run again. The new one's name tells what it covers,
        so a merge that breaks off at any place changes no sum."""
        folders = self.folders(spark)
        for query in {p.rsplit("/", 2)[1] for p in folders}:
            paths = sorted((p for p in folders if p.rsplit("/", 2)[1] == query), key=number)[:-1]
            if len(paths) > 1:
                old = spark.read.parquet(*paths).groupBy("start", *self.keys).agg(*(F.sum(c).alias(c) for c in SUMS))
                old.write.mode("overwrite").parquet(f"{self.path}/{query}/merged-{number(paths[-1])}")
            covered = self.merged(spark, query)
            remove(spark, [p for p in complete(spark, f"{self.path}/{query}/*-*") if number(p) < covered or (number(p) == covered and not is_merged(p))])


def number(path: str) -> int:
    return int(re.search(r"-(\d+)$", path)[1])


def is_merged(path: str) -> bool:
    return path.rsplit("/", 1)[1].startswith("merged-")


def last_runs(runs: DataFrame, key: str, last: int = LAST) -> DataFrame:
    """key, runs, tokens_in, tokens_out, saved and ratio over the last runs of each key. The rank is a limit that tasks apply
    before the shuffle, so of a hot key they send as many rows as a history has."""
    latest = Window.partitionBy(key).orderBy(F.desc_nulls_last("ts"), F.desc_nulls_last("run_id"))
    kept = runs.select(key, "ts", "run_id", "tokens_in", "tokens_out").withColumn("_rank", F.row_number().over(latest)).where(F.col("_rank") <= last)
    return saved_and_ratio(kept.groupBy(key).agg(*counted()))


class LastRuns(StatefulProcessor):
    """A ring of the last runs of a key. Batches of rows pass one by one, and only the ring stays, however many come."""

    def __init__(self, last: int = LAST):
        self.last = last

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getValueState("ring", "rows string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = json.loads(self.ring.get()[0]) if self.ring.exists() else []
        for pdf in rows:
            at = pdf["ts"].astype("datetime64[us]")
            columns = (at.astype("int64").where(at.notna(), -(1 << 63)), pdf["run_id"].fillna(-(1 << 63)), pdf["tokens_in"].fillna(0), pdf["tokens_out"].fillna(0))
            kept = nlargest(self.last, [*map(tuple, kept), *zip(*(c.astype("int64").tolist() for c in columns))])
        self.ring.update((json.dumps(kept),))
        yield pd.DataFrame({"key": [str(key[0])], "runs": [len(kept)], "tokens_in": [sum(r[2] for r in kept)], "tokens_out": [sum(r[3] for r in kept)]})

    def close(self) -> None:
        pass


def follow_last_runs(runs: DataFrame, key: str, last: int = LAST) -> DataFrame:
    """The same of a streaming DataFrame: key (as text), runs, tokens_in, tokens_out, a row for each key that a batch has
    runs of; needs the RocksDB state store. All rows of a key pass one task, in bounded memory."""
    d = runs.select(F.col(key).cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), *(F.col(c).cast("long").alias(c) for c in ("run_id", "tokens_in", "tokens_out")))
    return d.groupBy("key").transformWithStateInPandas(LastRuns(last), outputStructType="key string, runs long, tokens_in long, tokens_out long", outputMode="Update", timeMode="None")
