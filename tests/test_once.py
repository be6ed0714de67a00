"""Work by content equals work by row, runs once for each content, and is kept from run to run."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tarnmill.functions import tokens, tools
from tarnmill.plans.bodies import COUNTS, minify
from tarnmill.plans.once import Store, count_once, minify_once, minify_tools_once, once, work_name
from tarnmill.plans.optimize import Config
from tarnmill.plans.queries import conversation_bodies


def rows_of(df):
    names = sorted(df.columns)
    return Counter(tuple(r[c] for c in names) for r in df.select(names).collect())


def counted(spark):
    """A counter of rows that the work has met, and a work of one column that tells a text's length."""
    met = spark.sparkContext.accumulator(0)

    @F.pandas_udf("long")
    def length(c):
        met.add(len(c))
        return c.map(lambda x: -1 if x is None else len(x))

    return met, lambda d: d.select("_key", length("t").alias("n"))


def test_each_content_is_worked_on_once(spark):
    texts = ["same"] * 3000 + ["", None, None, "é漢🙂", "x" * 300_000] + [f"own {k}" for k in range(400)]
    rows = spark.createDataFrame([(k, t, "was", 5) for k, t in enumerate(texts)], "id long, t string, n string, `_KEY` int").repartition(6)
    met, work = counted(spark)
    got = once(rows, ["t"], work).cache()
    assert got.columns == ["id", "t", "n", "_KEY"]
    assert {(r.id, r.t, r.n) for r in got.collect()} == {(k, t, -1 if t is None else len(t)) for k, t in enumerate(texts)} and got.count() == len(texts)
    assert met.value == len(set(texts))


def test_hot_contents_are_spread(spark):
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("t"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        got = once(rows, ["t"], lambda d: d.select("_key", F.length("t").alias("n")))
        sizes = got.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
        assert got.where("n is distinct from length(t)").count() == 0 and got.count() == 20_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"), spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(sizes) == 4 and max(s.n for s in sizes) < 7500


def test_borders_nulls_and_repeated_rows(spark):
    rows = spark.createDataFrame([("ab", "c"), ("a", "bc"), ("abc", None), ("abc", ""), (None, "abc"), ("ab", "c"), ("ab", "c")], "a string, b string")
    got = once(rows, ["a", "b"], lambda d: d.select("_key", F.concat_ws("|", F.coalesce("a", F.lit("-")), F.coalesce("b", F.lit("-"))).alias("x")))
    assert sorted(r.x for r in got.collect()) == sorted(["-|abc", "ab|c", "ab|c", "ab|c", "abc|", "abc|-", "a|bc"])
    assert once(rows.limit(0), ["a"], lambda d: d.select("_key", F.col("a").alias("x"))).count() == 0


def test_results_are_kept(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    met, work = counted(spark)
    first = spark.createDataFrame([(k, f"t{k % 50}") for k in range(500)], "id long, t string")
    second = spark.createDataFrame([(k, f"t{k % 70}") for k in range(500)], "id long, t string")
    assert rows_of(once(first, ["t"], work, store, "length")) == rows_of(first.withColumn("n", F.length("t").cast("long"))) and met.value == 50
    assert rows_of(once(first, ["t"], work, store, "length")) == rows_of(first.withColumn("n", F.length("t").cast("long"))) and met.value == 50
    assert rows_of(once(second, ["t"], work, store, "length")) == rows_of(second.withColumn("n", F.length("t").cast("long"))) and met.value == 70
    # A run that broke off isn't read; what two runs added counts once; other work has results of its own.
    (tmp_path / "length" / "run-broken").mkdir()
    (tmp_path / "length" / "run-broken" / "part-0.parquet").write_bytes(b"no file")
    store.add("length", store.results("length").limit(30).coalesce(1))
    assert rows_of(once(second, ["t"], work, store, "length")) == rows_of(second.withColumn("n", F.length("t").cast("long"))) and met.value == 70
    store.merge("length")
    assert len(store.runs("length")) == 1 and store.results("length").count() == 70
    assert rows_of(once(second, ["t"], work, store, "length")) == rows_of(second.withColumn("n", F.length("t").cast("long"))) and met.value == 70
    once(first, ["t"], work, store, "other").count()
    assert met.value == 120
    with pytest.raises(ValueError):
        once(first, ["t"], work, store)


def test_names_of_work():
    a, b = Config(), Config(stages=frozenset(["messages", "dedup", "distill", "system", "tools"]))
    assert work_name("m", **vars(a)) == work_name("m", **vars(b)) != work_name("m", **vars(Config(keep_last=3)))


def test_one_tool_list_of_many_requests(spark, monkeypatch):
    met = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def strip(c):
        met.add(len(c))
        return c.map(lambda s: s and tools.bare_schema(s))

    monkeypatch.setattr(tools, "strip_schema", strip)
    schema = '{"type":"object","title":"T","properties":{"a":{"examples":[1]}}}'
    rows = spark.range(1000).select("id", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit("Use this tool to see. " + n * 300).alias("description"), F.lit(schema).alias("schema_json")) for n in "abc"))).alias("t")).select("id", "t.*").repartition(5)
    got = rows_of(minify_tools_once(rows))
    assert met.value == 3
    assert got == rows_of(tools.minify_tools(rows)) and sum(got.values()) == 3000


def test_equal_bodies_are_one_piece_of_work(spark, small, tmp_path):
    cfg = Config(token_budget=400, keep_last=2)
    bodies = conversation_bodies(spark, small).unionByName(spark.createDataFrame([("n", None, "/v1/messages"), ("o", "no json", None), ("p", "no json", None)], "request_id string, body string, path string"))
    want = rows_of(minify(bodies, cfg))
    store = Store(spark, str(tmp_path))
    assert rows_of(minify_once(bodies, cfg, store)) == want
    name = work_name("minify", **vars(cfg))
    kept = store.results(name).count()
    assert kept == bodies.selectExpr("body", "split_part(request_id, '-', 2) as f").distinct().count() < sum(want.values())
    assert rows_of(minify_once(bodies, cfg, store)) == want and store.results(name).count() == kept
    assert {*COUNTS} < {*minify_once(bodies, cfg, store).columns}


def test_counts(spark):
    rows = spark.createDataFrame([(1, "abcdefgh"), (2, None), (3, ""), (4, "abcdefgh")], "id long, t string")
    assert {r.id: r.tokens for r in count_once(rows, "t", tokens.estimate, "tokens").collect()} == {1: 2, 2: 0, 3: 0, 4: 2}
