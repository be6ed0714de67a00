"""Streams of counts: replays change nothing, sums and last runs equal those of the whole table."""

import os
import random
from collections import Counter

from pyspark.sql import functions as F

from tarnmill.plans.queries import event_runs
from tarnmill.streaming.usage import Ledger, follow_last_runs, last_runs, window_sums, windows

SUMS = ["runs", "tokens_in", "tokens_out"]


def rows_of(df, *names):
    return Counter(tuple(r) for r in df.select(*names).collect())


def shuffled_files(spark, sf_dir, path, files=5):
    """Runs in files that mix all times, so that most of them come late."""
    runs = event_runs(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("ts", F.when(F.col("run_id") % 50 != 3, F.col("ts")))
    for k in range(files):
        runs.where(F.pmod(F.xxhash64("run_id"), F.lit(files)) == k).coalesce(1).write.mode("append").parquet(path)
    return runs, spark.readStream.schema(runs.schema).option("maxFilesPerTrigger", 1).parquet(path)


def finish(query):
    try:
        assert query.awaitTermination(240)
    finally:
        query.stop()


def test_ledger_equals_the_table_whatever_runs_again(spark, small, tmp_path):
    runs, stream = shuffled_files(spark, small, str(tmp_path / "in"))
    ledger = Ledger(str(tmp_path / "ledger"), 3600, ("event_type",))
    assert tuple(ledger.totals(spark).first()) == (0, 0, 0, 0, 0.0) and ledger.sums(spark) is None
    start = lambda: finish(stream.writeStream.foreachBatch(ledger.sink()).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    start()
    names = ["start", "event_type", *SUMS]
    want = rows_of(window_sums(runs, 3600, ("event_type",)), *names)
    assert len(ledger.folders(spark)) == 5 and any(r[0] is None for r in want)
    assert rows_of(ledger.sums(spark), *names) == want
    # The last batch runs again: once with its folder complete, once with a broken one.
    query = os.listdir(tmp_path / "ledger")[0]
    for broken in (False, True):
        for name in ("4", ".4.crc"):
            (tmp_path / "cp" / "commits" / name).unlink(missing_ok=True)
        if broken:
            (tmp_path / "ledger" / query / "batch-4" / "_SUCCESS").unlink()
            assert rows_of(ledger.sums(spark), *names) != want
        start()
        assert rows_of(ledger.sums(spark), *names) == want
    ledger.merge(spark)
    assert sorted(p.rsplit("/", 1)[1] for p in ledger.folders(spark)) == ["batch-4", "merged-3"] and rows_of(ledger.sums(spark), *names) == want
    # What a merge that broke off leaves changes nothing, nor does a batch that was merged; another query adds.
    ledger.record(runs, 2, query)
    window_sums(runs, 3600, ("event_type",)).write.parquet(str(tmp_path / "ledger" / query / "batch-1"))
    assert rows_of(ledger.sums(spark), *names) == want
    ledger.merge(spark)
    assert not (tmp_path / "ledger" / query / "batch-1").exists() and rows_of(ledger.sums(spark), *names) == want
    ledger.record(runs, 0, "other")
    one, both = rows_of(window_sums(runs, 3600, ("event_type",)), *names), rows_of(ledger.sums(spark), *names)
    assert {(s, t, 2 * n, 2 * i, 2 * o) for s, t, n, i, o in one} == {*both}


def test_windows_close_behind_the_watermark(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    minutes = [[1, 5, 65], [30, 70, 200], [210], [10, 500]]
    schema = "ts timestamp, run_id long, tokens_in long, tokens_out long"
    for k, batch in enumerate(minutes):
        d = spark.createDataFrame([(m, k * 10 + i) for i, m in enumerate(batch)], "m long, run_id long")
        d.select(F.timestamp_seconds(F.col("m") * 60).alias("ts"), "run_id", F.lit(10).cast("long").alias("tokens_in"), F.lit(4).cast("long").alias("tokens_out")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    finish(windows(stream, "1 hour", "60 minutes").writeStream.format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    got = {(r.at // 3600, r.runs, r.saved, r.ratio) for r in spark.table("closed").selectExpr("unix_seconds(start) as at", "*").collect()}
    # Rows are held against the watermark of the batch before: the last one's 10 is behind 140, and in no window.
    assert got == {(0, 3, 18, 0.6), (1, 2, 12, 0.6), (3, 2, 12, 0.6)}
    whole = windows(spark.read.schema(schema).parquet(str(tmp_path / "in")), "1 hour")
    assert whole.agg(F.sum("runs")).first()[0] == 9


def test_ring_equals_the_last_runs_of_the_table(spark, small, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    runs, stream = shuffled_files(spark, small, str(tmp_path / "in"), 4)
    key = lambda d: d.withColumn("k", F.when(F.col("user_id") % 3 == 0, F.lit(-1)).otherwise(F.col("user_id") % 11))
    assert key(runs).where("k = -1").count() > 200
    out = {}

    def note(batch, _):
        out.update({r.key: (r.runs, r.tokens_in, r.tokens_out) for r in batch.collect()})

    finish(follow_last_runs(key(stream), "k").writeStream.foreachBatch(note).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    assert out == {str(r.k): (r.runs, r.tokens_in, r.tokens_out) for r in last_runs(key(runs), "k").collect()}


def test_last_runs_of_ties_nulls_and_nothing(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice([None, 1, 2, 3]), rng.choice([None, 7, 8]), rng.choice([None, 5]), 2) for _ in range(400)]
    d = spark.createDataFrame(rows, "k string, s long, run_id long, tokens_in long, tokens_out long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.k: (r.runs, r.tokens_out) for r in last_runs(d, "k", 30).collect()}
    assert got == {"a": (30, 60), "b": (30, 60)}
    assert last_runs(d.limit(0), "k").count() == 0 and "WindowGroupLimit" in last_runs(d, "k")._jdf.queryExecution().executedPlan().toString()
    assert {(r.start is None, r.runs) for r in window_sums(d, 3600).collect()} == {(True, sum(r[1] is None for r in rows)), (False, sum(r[1] is not None for r in rows))}
