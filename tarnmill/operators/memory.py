"""Retrieval over memory entries and pruning of memories to a budget."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tarnmill.functions import text as T
from tarnmill.functions.tokens import estimate_at_least_one as count

#: Fields of entries that never reach a prompt.
METADATA = ["id", "tokens_in", "tokens_out", "metadata", "platform"]
TOP, WINDOW = 10, 20
#: So many queries are ranked in the tasks.
QUERIES = 5000


def vocabulary(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda w: w != ""))


def retrieve(queries: DataFrame, entries: DataFrame, top: int = TOP, most: int = QUERIES) -> DataFrame:
    """query_id, entry_id, score, rank: for each query the entries that share most words, earlier ones first among
    equals; for a query without words the first entries, with score 0. Up to so many queries go to the tasks, which rank
    their own entries and send on the best of each query alone; more are joined by their words."""
    q = queries.select("query_id", vocabulary(F.coalesce("query", F.lit(""))).alias("words"))
    e = entries.select("entry_id", vocabulary(F.coalesce("content", F.lit(""))).alias("words"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "entry_id")
    asked = q.limit(most + 1).collect()
    if len(asked) <= most:
        scored = ranked_by_task(e, [(r.query_id, r.words) for r in asked], queries.schema["query_id"].dataType.simpleString(), top)
    else:
        words = lambda d, key: d.select(key, F.explode("words").alias("word"))
        scored = words(q, "query_id").join(words(e, "entry_id"), "word").groupBy("query_id", "entry_id").agg(F.count("*").alias("score"))
        # The first entries are the same for all queries without words.
        first = e.select("entry_id").orderBy("entry_id").limit(top).agg(F.collect_list("entry_id").alias("all"))
        none = q.where(F.size("words") == 0).join(F.broadcast(first)).select("query_id", F.explode("all").alias("entry_id"), F.lit(0).cast("long").alias("score"))
        scored = scored.unionByName(none)
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def ranked_by_task(entries: DataFrame, asked: list[tuple], query_type: str, top: int) -> DataFrame:
    """query_id, entry_id, score of the best entries of each query in each task."""
    postings: dict[str, list[int]] = {}
    for i, (_, words) in enumerate(asked):
        for w in words:
            postings.setdefault(w, []).append(i)
    having = {w: np.array(x) for w, x in postings.items()}
    ids = [k for k, _ in asked]
    empty = [i for i, (_, words) in enumerate(asked) if not words]
    entry_type = entries.schema["entry_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: list[list] = [[] for _ in ids]
        for b in batches:
            for entry, words in zip(b.column("entry_id").to_pylist(), b.column("words").to_pylist()):
                hit = [having[w] for w in words if w in having]
                who, n = np.unique(np.concatenate(hit), return_counts=True) if hit else ((), ())
                for i, score in [*zip(who, n), *((i, 0) for i in empty)]:
                    row = (int(score), Last(entry))
                    if len(heaps[i]) < top:
                        heapq.heappush(heaps[i], row)
                    elif heaps[i][0] < row:
                        heapq.heapreplace(heaps[i], row)
        found = [(ids[i], row[1].value, row[0]) for i, heap in enumerate(heaps) for row in heap]
        columns = [pa.array([f[k] for f in found], t) for k, t in enumerate((query_arrow, entry_arrow, pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["query_id", "entry_id", "score"])

    schema = to_arrow_schema(entries.sparkSession.createDataFrame([], f"query_id {query_type}, entry_id {entry_type}").schema)
    query_arrow, entry_arrow = schema.field(0).type, schema.field(1).type
    return entries.mapInArrow(run, f"query_id {query_type}, entry_id {entry_type}, score long")


class Last:
    """A value that sorts the other way round: of equal scores the earlier entry is better; null is the earliest."""

    def __init__(self, value):
        self.value = value

    def __lt__(self, other: Last) -> bool:
        if self.value is None or other.value is None:
            return self.value is not None and other.value is None
        return self.value > other.value

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Last) and self.value == other.value


def summarize(entries: DataFrame, window: int = WINDOW) -> DataFrame:
    """entries (ctx_id, entry_idx, role, content) with all but the last window of a context condensed: two neighbours of
    different roles into one summary, the others one by one. Islands of alternating roles are paired from their start."""
    w = Window.partitionBy("ctx_id").orderBy("entry_idx")
    e = entries.withColumn("place", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("ctx_id")))
    e = e.withColumn("old", F.col("place") <= F.col("n") - window)
    same = F.when(F.lag("role").over(w) == F.col("role"), 1).otherwise(0)
    e = e.withColumn("same", same).withColumn("island", F.when(F.col("old"), F.sum("same").over(w)))
    pair = F.floor((F.row_number().over(Window.partitionBy("ctx_id", "old", "island").orderBy("entry_idx")) - 1) / 2)
    e = e.withColumn("pair", F.when(F.col("old"), pair).otherwise(F.col("place")))
    # New entries are groups of their own: one aggregation gives both, and no union of aligned parts is planned.
    entry = F.struct("entry_idx", "role", F.when(F.col("old"), T.truncate_verbose(F.col("content"), 200)).otherwise(F.col("content")).alias("content"))
    both = e.groupBy("ctx_id", "old", "island", "pair").agg(F.array_sort(F.collect_list(entry)).alias("x"))
    x, y = F.element_at("x", 1), F.try_element_at("x", F.lit(2))
    one = F.concat(F.lit("["), x["role"], F.lit(": "), F.substring(x["content"], 1, 150), F.lit("...]"))
    two = F.concat(F.lit("["), x["role"], F.lit(": "), F.substring(x["content"], 1, 100), F.lit("... → "), y["role"], F.lit(": "), F.substring(y["content"], 1, 100), F.lit("...]"))
    return both.select("ctx_id", x["entry_idx"].alias("entry_idx"), F.when(F.col("old"), "summary").otherwise(x["role"]).alias("role"), F.when(~F.col("old"), x["content"]).when(y.isNull(), one).otherwise(two).alias("content"))


def render_cold(cold: DataFrame) -> DataFrame:
    """ctx_id, category, entry_idx, line of entries (kv ARRAY<STRUCT<k,v>>, or value for what is no record); those that
    are left empty have a null line."""
    fields = F.filter("kv", lambda x: ~x["k"].isin(*METADATA))
    lines = F.transform(fields, lambda x: F.concat(x["k"], F.lit(": "), F.when(F.length(x["v"]) > 300, F.concat(F.substring(x["v"], 1, 300), F.lit("..."))).otherwise(x["v"])))
    raw = F.when(F.col("kv").isNotNull(), F.array_join(lines, "\n")).otherwise(F.substring("value", 1, 200))
    return cold.select("ctx_id", "category", "entry_idx", F.nullif(T.collapse_whitespace(T.strip_low_value(raw)), F.lit("")).alias("line"))


def within(lines: DataFrame, sep: str, share: Column) -> DataFrame:
    """Per context of lines (ctx_id, pos, line, share): text of all lines, of the longest prefix that fits the share
    and of at least one line; how many lines there are and are kept."""
    w = Window.partitionBy("ctx_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    kept = lines.withColumn("sum", F.sum(count(F.col("line"))).over(w)).withColumn("first", F.row_number().over(Window.partitionBy("ctx_id").orderBy("pos")) == 1)
    keep = F.col("near") & (F.col("first") | (F.col("sum") <= share))
    return kept.groupBy("ctx_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("pos", "line")))), lambda x: x["line"]), sep).alias("text"), F.count_if(keep).alias("kept"), F.count("*").alias("lines"))


def placed(lines: DataFrame, sep: str, most: int) -> DataFrame:
    """lines with stop, where each ends in its context's joined text, and near: whether a budget of so many tokens can
    reach its start (a kept line takes at most three characters beyond four for each of its tokens)."""
    w = Window.partitionBy("ctx_id").orderBy("pos")
    stop = F.sum(F.length("line") + len(sep)).over(w.rowsBetween(Window.unboundedPreceding, 0)) - len(sep)
    return lines.withColumn("stop", stop).withColumn("near", F.col("stop") - F.length("line") <= (8 + 2 * len(sep)) * (most + 1))


def prune_context(cold: DataFrame, warm: DataFrame, most: int = 2000, queries: DataFrame | None = None) -> DataFrame:
    """ctx_id, cold_text, warm_text, block, tokens_before, tokens_after and the numbers of entries. Where both texts
    exceed the budget, each gets its share and keeps a prefix of its entries. queries: ctx_id, query."""
    c = render_cold(cold)
    cw = Window.partitionBy("ctx_id").orderBy("category", "entry_idx")
    cold_lines = c.withColumn("pos", F.row_number().over(cw)).where("line is not null")
    before = warm.groupBy("ctx_id").agg(F.count("*").alias("warm_before"))
    if queries is not None:
        asked = warm.join(queries.select("ctx_id", vocabulary(F.col("query")).alias("q"), (F.col("query") == "").alias("none")), "ctx_id", "left")
        score = F.size(F.array_intersect(vocabulary(F.coalesce("content", F.lit(""))), "q"))
        rank = F.row_number().over(Window.partitionBy("ctx_id").orderBy(F.desc("score"), "entry_idx"))
        asked = asked.withColumn("score", F.when(F.col("q").isNull() | F.col("none"), F.lit(None)).otherwise(score)).where("score is null or score > 0").withColumn("rank", rank)
        warm = asked.where(F.col("score").isNull() | (F.col("rank") <= TOP)).select("ctx_id", F.when(F.col("score").isNull(), F.col("entry_idx")).otherwise(F.col("rank")).alias("entry_idx"), "role", "content")
    s = summarize(warm).withColumn("content", T.collapse_whitespace(T.strip_low_value(F.coalesce("content", F.lit(""))))).where("content <> ''")
    warm_lines = s.select("ctx_id", F.col("entry_idx").alias("pos"), F.concat(F.coalesce("role", F.lit("user")), F.lit(": "), F.col("content")).alias("line"))
    cold_lines, warm_lines = placed(cold_lines, "\n\n", most), placed(warm_lines, "\n", most)
    # Texts are only put together as far as a budget can reach; what they would be in all is known by its length.
    whole = lambda lines, sep, name: lines.groupBy("ctx_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("near"), F.struct("pos", "line")))), lambda x: x["line"]), sep).alias(name), F.max("stop").alias(f"{name}_chars"))
    contexts = cold.groupBy("ctx_id").agg(F.count("*").alias("cold_before")).join(before, "ctx_id", "full").na.fill(0)
    t = contexts.join(whole(cold_lines, "\n\n", "c"), "ctx_id", "left").join(whole(warm_lines, "\n", "w"), "ctx_id", "left").na.fill("", ["c", "w"]).na.fill(0, ["c_chars", "w_chars"])
    of_chars = lambda n: F.greatest(F.lit(1), F.floor(F.col(n) / 4)).cast("long")
    t = t.withColumn("ct", of_chars("c_chars")).withColumn("wt", of_chars("w_chars")).withColumn("tokens_before", F.col("ct") + F.col("wt")).withColumn("over", F.col("tokens_before") > most)
    t = t.withColumn("ws", F.floor(F.lit(most) * (F.col("wt") / F.col("tokens_before"))).cast("long")).withColumn("cs", F.lit(most) - F.col("ws"))
    cut_c = within(cold_lines.join(t.select("ctx_id", "cs"), "ctx_id"), "\n\n", F.col("cs")).select("ctx_id", F.col("text").alias("cc"), F.col("kept").alias("ck"))
    cut_w = within(warm_lines.join(t.select("ctx_id", "ws"), "ctx_id"), "\n", F.col("ws")).select("ctx_id", F.col("text").alias("wc"), F.col("kept").alias("wk"), F.col("lines").alias("wl"))
    t = t.join(cut_c, "ctx_id", "left").join(cut_w, "ctx_id", "left")
    more = lambda text, n: F.when(n > 0, F.concat(text, F.lit("\n... ("), n.cast("string"), F.lit(" more entries truncated)"))).otherwise(text)
    cold_text = F.when(F.col("over") & (F.col("ct") > F.col("cs")) & F.col("cc").isNotNull(), more(F.col("cc"), F.col("cold_before") - F.col("ck"))).otherwise(F.col("c"))
    warm_text = F.when(F.col("over") & (F.col("wt") > F.col("ws")) & F.col("wc").isNotNull(), more(F.col("wc"), F.col("wl") - F.col("wk"))).otherwise(F.col("w"))
    t = t.withColumn("cold_text", cold_text).withColumn("warm_text", warm_text)
    block = F.concat_ws("\n\n", F.when(F.col("cold_text") != "", F.concat(F.lit("<cold_memory>\n"), "cold_text", F.lit("\n</cold_memory>"))), F.when(F.col("warm_text") != "", F.concat(F.lit("<recent_context>\n"), "warm_text", F.lit("\n</recent_context>"))))
    return t.select("ctx_id", "cold_text", "warm_text", block.alias("block"), "cold_before", "warm_before", F.coalesce("wl", F.lit(0)).alias("warm_after"), "tokens_before", (count(F.col("cold_text")) + count(F.col("warm_text"))).alias("tokens_after"))


def read_warm(spark: SparkSession, path: str) -> DataFrame:
    """ctx_id (the file), entry_idx, role, content of JSON files that hold a list of entries, or one under messages."""
    f = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("ctx_id"), F.try_parse_json("value").alias("v"))
    listed = F.coalesce(F.try_variant_get("v", "$.messages", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))
    e = f.select("ctx_id", F.posexplode(listed).alias("entry_idx", "e"))
    return e.select("ctx_id", "entry_idx", F.try_variant_get("e", "$.role", "string").alias("role"), F.try_variant_get("e", "$.content", "string").alias("content"))


def read_cold(spark: SparkSession, path: str) -> DataFrame:
    """ctx_id (the file), category, entry_idx, kv, value of JSON files that hold lists of entries by category."""
    f = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("ctx_id"), F.from_json("value", "map<string,variant>").alias("m"))
    c = f.select("ctx_id", F.explode("m").alias("category", "v"))
    e = c.select("ctx_id", "category", F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("entry_idx", "e"))
    fields = F.try_variant_get("e", "$", "map<string,variant>")
    text = lambda v: F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))
    kv = F.transform(F.map_entries(fields), lambda x: F.struct(x["key"].alias("k"), text(x["value"]).alias("v")))
    return e.select("ctx_id", "category", "entry_idx", kv.alias("kv"), F.when(fields.isNull(), text(F.col("e"))).alias("value"))
