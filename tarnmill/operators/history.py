"""Operators over message histories. All windows partition by request_id, so that one exchange serves them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnmill.functions import text as T
from tarnmill.functions import tokens

STUB = "[identical to a later tool_result; omitted %d chars]"


def content_key(text: Column, shaped: Column) -> Column:
    """What equal results share: a string its text, any other content its JSON with keys in order."""
    return F.sha2(F.when(shaped.isNull(), F.concat(F.lit("s"), text)).otherwise(F.concat(F.lit("j"), F.to_json(F.try_parse_json(shaped)))).cast("binary"), 256)


def dedup(blocks: DataFrame, content: str = "tr_text", least: int = 200, stub: str = STUB, group: str = "request_id", only: Column | None = None) -> DataFrame:
    """blocks with equal long tool results replaced by a stub in every message before the last that holds them, and
    stubbed, which says where. Rows whose content is null are no results, nor are those that only leaves out."""
    shaped = F.col("tr_json") if "tr_json" in blocks.columns else F.lit(None).cast("string")
    long = (F.length(content) >= least) & (F.lit(True) if only is None else only)
    key = F.when(long, content_key(F.col(content), shaped))
    # Rows without a key would all meet in one partition: they get one each by their place.
    w = Window.partitionBy(group, F.coalesce(key, F.concat_ws(":", "msg_idx", "blk_idx")))
    earlier = key.isNotNull() & (F.col("msg_idx") < F.max("msg_idx").over(w))
    return blocks.withColumn("stubbed", F.coalesce(earlier, F.lit(False))).withColumn(content, F.when(F.col("stubbed"), F.format_string(stub, F.length(content))).otherwise(F.col(content)))


def dedup_documents(documents: DataFrame, text: str, order: str, *group: str, least: int = 200, stub: str = STUB) -> DataFrame:
    """The same where a group grows with the data: the last place of each content is aggregated, which one hot content or
    group can't hold up, and joined back."""
    long = F.length(text) >= least
    last = documents.where(long).groupBy(*group, F.sha2(F.col(text).cast("binary"), 256).alias("_key")).agg(F.max(order).alias("_last"), F.count("*").alias("_n")).where("_n > 1")
    d = documents.withColumn("_key", F.when(long, F.sha2(F.col(text).cast("binary"), 256))).join(last, [*group, "_key"], "left")
    stubbed = F.coalesce(F.col(order) < F.col("_last"), F.lit(False))
    return d.withColumn("stubbed", stubbed).withColumn(text, F.when(stubbed, F.format_string(stub, F.length(text))).otherwise(F.col(text))).drop("_key", "_last", "_n")


def has_tool_use(blocks: DataFrame) -> DataFrame:
    """request_id, msg_idx, has_tool_use, has_tool_result of every message."""
    return blocks.groupBy("request_id", "msg_idx").agg(F.bool_or(F.col("type") == "tool_use").alias("has_tool_use"), F.bool_or(F.col("type") == "tool_result").alias("has_tool_result"))


def distill_old(messages: DataFrame, text: str = "text", keep_last: int = 8, most: int = 240, note: str = "[distilled from %d chars]") -> DataFrame:
    """messages with long texts shortened in all but the last keep_last of a request."""
    n = F.count("*").over(Window.partitionBy("request_id"))
    place = F.row_number().over(Window.partitionBy("request_id").orderBy("msg_idx"))
    old = messages.withColumn("_n", n).withColumn("_old", place <= F.col("_n") - keep_last)
    return old.withColumn("distilled", F.col("_old") & (F.length(text) > 360)).withColumn(text, F.when(F.col("_old"), T.distill(F.col(text), most, note)).otherwise(F.col(text))).drop("_n", "_old")


def pairs(blocks: DataFrame) -> DataFrame:
    """request_id, tool_id, use_idx, res_idx: each tool result with the open use of its id just before it."""
    e = blocks.where("type in ('tool_use', 'tool_result')")
    w = Window.partitionBy("request_id", "tool_id").orderBy("msg_idx", "blk_idx")
    e = e.withColumn("_kind", F.lag("type").over(w)).withColumn("use_idx", F.lag("msg_idx").over(w))
    return e.where("type = 'tool_result' and _kind = 'tool_use'").select("request_id", "tool_id", "use_idx", F.col("msg_idx").alias("res_idx"))


def drop_points(messages: DataFrame, paired: DataFrame | None = None) -> DataFrame:
    """messages with valid: whether the history can start at this message without cutting a pair, that is, no more
    pairs were opened than closed before it."""
    if paired is None:
        return messages.withColumn("valid", F.lit(True))
    ends = paired.select("request_id", F.col("use_idx").alias("msg_idx"), F.lit(1).alias("d")).unionByName(paired.select("request_id", F.col("res_idx").alias("msg_idx"), F.lit(-1).alias("d")))
    change = ends.groupBy("request_id", "msg_idx").agg(F.sum("d").alias("_d"))
    before = Window.partitionBy("request_id").orderBy("msg_idx").rowsBetween(Window.unboundedPreceding, -1)
    joined = messages.join(change, ["request_id", "msg_idx"], "left")
    return joined.withColumn("valid", F.coalesce(F.sum(F.coalesce("_d", F.lit(0))).over(before), F.lit(0)) == 0).drop("_d")


def budget_report(messages: DataFrame, budget: int, keep_last: int = 8, paired: DataFrame | None = None, fixed: Column | int = 0) -> DataFrame:
    """request_id, n, total, dropped, tokens_after. messages has tok; fixed is what system and tools take. Dropped is
    the least valid number of leading messages that lets the rest fit, else the largest valid one."""
    m = drop_points(tokens.prefix_sums(messages), paired).withColumn("place", F.row_number().over(Window.partitionBy("request_id").orderBy("msg_idx")) - 1)
    all_tokens = F.col("total") + fixed
    may = F.col("valid") & (F.col("place") >= 1) & (F.col("place") <= F.col("n") - keep_last)
    fits = all_tokens - F.col("prefix") <= budget
    g = m.groupBy("request_id").agg(F.max("n").alias("n"), F.max(all_tokens).alias("total"), F.min(F.when(may & fits, F.struct("place", "prefix"))).alias("least"), F.max(F.when(may, F.struct("place", "prefix"))).alias("most"))
    whole = (F.col("total") <= budget) | (F.col("n") <= keep_last)
    drop = F.when(~whole, F.coalesce("least", "most"))
    if keep_last == 0:  # then all of them may go, wherever pairs lie
        drop = F.when(~whole, F.coalesce(F.col("least"), F.struct(F.col("n").cast("int").alias("place"), (F.col("total") - fixed).alias("prefix"))))
    return g.select("request_id", "n", "total", F.coalesce(drop["place"], F.lit(0)).cast("long").alias("dropped"), (F.col("total") - F.coalesce(drop["prefix"], F.lit(0))).alias("tokens_after"))


def enforce_budget(messages: DataFrame, budget: int, keep_last: int = 8, paired: DataFrame | None = None, fixed: int = 0) -> DataFrame:
    """messages without the leading ones that the report drops."""
    r = budget_report(messages, budget, keep_last, paired, fixed).select("request_id", "dropped")
    place = F.row_number().over(Window.partitionBy("request_id").orderBy("msg_idx")) - 1
    return messages.withColumn("_place", place).join(r, "request_id").where("_place >= dropped").drop("_place", "dropped")


def inspect_budget(messages: DataFrame, budget: int, keep_last: int = 8, paired: DataFrame | None = None) -> DataFrame:
    r = budget_report(messages, budget, keep_last, paired)
    return r.withColumn("headroom", F.lit(budget) - F.col("total")).withColumn("would_drop", F.col("dropped") > 0)
