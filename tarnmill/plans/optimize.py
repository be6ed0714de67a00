"""The whole reduction of requests: tools, system, messages, pages, budget and compression, in that order, with counts."""

from __future__ import annotations

import os
from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnmill.functions import compress, dom, text, tokens
from tarnmill.functions.tools import minify_tools
from tarnmill.operators import history
from tarnmill.sources.requests import flat_text


@dataclass(frozen=True)
class Config:
    """What the stages do; library() and always_on() are its two usual forms."""

    token_budget: int = 131072
    stages: frozenset[str] = frozenset({"tools", "system", "messages", "dedup", "distill"})
    tool_skip: tuple[str, ...] = ()
    keep_last: int = 8
    dedup_min_chars: int = 200
    distill_max_chars: int = 240
    tool_compress: bool = False
    minify_dom: bool = False
    note: str = "[distilled from %d chars]"
    stub: str = history.STUB

    @staticmethod
    def library() -> Config:
        return Config()

    @staticmethod
    def always_on(env: dict[str, str] | None = None) -> Config:
        """The form for services; TARNMILL_* variables override it."""
        env = dict(os.environ if env is None else env)
        number = lambda k, d: int(v) if (v := env.get(f"TARNMILL_{k}", "")).lstrip("-").isdigit() else d
        flag = lambda k, d: env[f"TARNMILL_{k}"].strip().lower() in ("1", "true", "yes", "on") if f"TARNMILL_{k}" in env else d
        if not flag("ENABLED", True):
            return Config(stages=frozenset())
        return Config(number("BUDGET", 131072), keep_last=number("KEEP_LAST", 4), dedup_min_chars=number("DEDUP_MIN", 200), distill_max_chars=number("DISTILL_MAX", 160), tool_compress=flag("COMPRESS", True), minify_dom=flag("DOM", False))


def block_tokens() -> Column:
    # A list that a stage has rewritten is one text block now.
    as_it_was = F.coalesce(F.schema_of_variant(F.try_parse_json("tr_json")).startswith("ARRAY") & F.col("tr_text").eqNullSafe(flat_text(F.col("tr_json"))), F.lit(False))
    return tokens.of_block(F.col("type"), F.col("text"), F.col("tr_text"), F.col("input_json"), F.col("raw_json"), F.when(F.col("tr_json").isNotNull() & as_it_was, F.col("tr_json")))


class Optimized(NamedTuple):
    """The blocks that are left, a row of counts for each request, and the system blocks and tools as they are now."""

    blocks: DataFrame
    stats: DataFrame
    systems: DataFrame | None
    tools: DataFrame | None


def optimize_messages(blocks: DataFrame, cfg: Config) -> DataFrame:
    """blocks after white space, distilling and stubs, with minified, distilled and stubbed for the counts, place (the
    message's number among its request's) and n (how many there are); histories of one message stay. One exchange by
    request serves all windows."""
    request = Window.partitionBy("request_id")
    is_text = F.col("type").isin("text", "str")
    b = blocks.withColumn("place", F.dense_rank().over(request.orderBy("msg_idx")) - 1)
    b = b.withColumn("n", F.max("place").over(request) + 1)
    several = F.col("n") >= 2
    changed = lambda now: F.coalesce(now != F.col("text"), F.lit(False))
    slim = F.when(is_text & several, text.minify_text(F.col("text"))).otherwise(F.col("text")) if "messages" in cfg.stages else F.col("text")
    b = b.withColumn("now", slim).withColumn("minified", changed(F.col("now"))).withColumn("text", F.col("now"))
    old = is_text & several & (F.col("place") < F.col("n") - cfg.keep_last) & (F.length("text") > 360)
    short = F.when(old, text.distill(F.col("text"), cfg.distill_max_chars, cfg.note)).otherwise(F.col("text")) if "distill" in cfg.stages else F.col("text")
    b = b.withColumn("now", short).withColumn("distilled", changed(F.col("now"))).withColumn("text", F.col("now")).drop("now")
    if "dedup" not in cfg.stages:
        return b.withColumn("stubbed", F.lit(False))
    return history.dedup(b, "tr_text", cfg.dedup_min_chars, cfg.stub, only=several)


def optimize(blocks: DataFrame, cfg: Config, systems: DataFrame | None = None, tools: DataFrame | None = None) -> Optimized:
    """What the stages make of requests given as blocks_of(), systems_of() and tools_of() tables. stats has a row for
    each request with tokens before and after and what each stage did. Everything about a request is worked out where one
    exchange put its blocks; nothing is written and no job runs."""
    request = Window.partitionBy("request_id")
    before = request.orderBy("place").rangeBetween(Window.unboundedPreceding, -1)
    b = optimize_messages(blocks.withColumn("_tok_in", block_tokens()), cfg)
    if cfg.minify_dom:
        page = F.coalesce((F.col("type") == "tool_result") & F.col("tr_json").isNull() & dom.looks_like_page(F.col("tr_text")), F.lit(False))
        b = b.withColumn("pruned", page).withColumn("tr_text", F.when(page, dom.prune(F.col("tr_text"))).otherwise(F.col("tr_text")))
    else:
        b = b.withColumn("pruned", F.lit(False))
    first = ~F.col("msg_idx").eqNullSafe(F.lag("msg_idx").over(request.orderBy("place", "blk_idx")))
    b = b.withColumn("_frame", F.when(first, tokens.MESSAGE).otherwise(0)).withColumn("_tok", block_tokens())
    slim_systems, slim_tools, fixed = fixed_parts(systems, tools, cfg)
    b = b.withColumn("fixed_out", F.lit(0).cast("long")) if fixed is None else b.join(fixed.select("request_id", "fixed_out"), "request_id", "left").withColumn("fixed_out", F.coalesce("fixed_out", F.lit(0)))
    if cfg.token_budget > 0:
        event = F.when(F.col("type").isin("tool_use", "tool_result"), F.col("tool_id"))
        same = Window.partitionBy("request_id", event).orderBy("msg_idx", "blk_idx")
        b = b.withColumn("_next", F.when(event.isNotNull(), F.lead("type").over(same))).withColumn("_last", F.when(event.isNotNull(), F.lag("type").over(same)))
        opened = F.when((F.col("type") == "tool_use") & (F.col("_next") == "tool_result"), 1).when((F.col("type") == "tool_result") & (F.col("_last") == "tool_use"), -1).otherwise(0)
        size = F.col("_tok") + F.col("_frame")
        b = b.withColumn("_open", F.coalesce(F.sum(opened).over(before), F.lit(0))).withColumn("_prefix", F.coalesce(F.sum(size).over(before), F.lit(0))).withColumn("_total", F.sum(size).over(request) + F.col("fixed_out"))
        may = (F.col("_open") == 0) & (F.col("place") >= 1) & (F.col("place") <= F.col("n") - cfg.keep_last)
        fits = F.col("_total") - F.col("_prefix") <= cfg.token_budget
        whole = (F.col("_total") <= cfg.token_budget) | (F.col("n") <= cfg.keep_last)
        furthest = F.col("n") if cfg.keep_last == 0 else F.max(F.when(may, F.col("place"))).over(request)
        b = b.withColumn("dropped", F.when(whole, 0).otherwise(F.coalesce(F.min(F.when(may & fits, F.col("place"))).over(request), furthest, F.lit(0))).cast("long"))
    else:
        b = b.withColumn("dropped", F.lit(0).cast("long"))
    b = b.withColumn("_gone", F.col("place") < F.col("dropped"))
    if cfg.tool_compress:
        # The one reducer that runs in Python gets what can be JSON of the results that are left, and nulls else.
        mine = (F.col("type") == "tool_result") & (F.col("role") == "user") & ~F.col("_gone") & (F.length("tr_text") >= compress.LEAST)
        b = b.withColumn("_result", F.when(mine, F.col("tr_text"))).withColumn("_json", compress.compact_json(F.when(F.col("_result").rlike(r"^\s*[\[{]"), F.col("_result"))))
        b = b.withColumn("_packed", F.when(F.col("_result").isNotNull(), compress.compress_text(F.col("_result"), F.col("_json"))))
    else:
        b = b.withColumn("_packed", F.lit(None).cast("string"))
    b = b.withColumn("compressed", F.col("_packed").isNotNull()).withColumn("tr_text", F.coalesce("_packed", "tr_text"))
    left = F.when(F.col("_gone"), 0).otherwise(F.when(F.col("compressed"), block_tokens()).otherwise(F.col("_tok")) + F.col("_frame"))
    messages = lambda c: F.size(F.collect_set(F.when(F.col(c), F.col("msg_idx")))).cast("long")
    did = b.groupBy("request_id").agg(
        F.sum(F.col("_tok_in") + F.col("_frame")).alias("messages_in"), F.sum(left).alias("messages_out"), messages("minified").alias("messages_minified"), F.count_if("stubbed").alias("dedup_count"), messages("distilled").alias("distill_count"),
        F.max("dropped").alias("budget_dropped"), F.count_if("compressed").alias("tool_compressed"), F.count_if("pruned").alias("dom_minified"),
    )
    if fixed is None:
        did = did.withColumns({"fixed_in": F.lit(0), "fixed_out": F.lit(0), "system_minified": F.lit(False), "tools_minified": F.lit(0).cast("long")})
    else:
        did = did.join(fixed, "request_id", "full").na.fill(0).na.fill(False)
    stats = did.select("request_id", (F.col("messages_in") + F.col("fixed_in")).alias("tokens_in"), (F.col("messages_out") + F.col("fixed_out")).alias("tokens_out"), "tools_minified", "system_minified", "messages_minified", "dedup_count", "distill_count", "budget_dropped", "tool_compressed", "dom_minified")
    kept = b.where(~F.col("_gone")).select(*blocks.columns, "minified", "distilled", "stubbed", "pruned", "compressed")
    return Optimized(kept, stats, slim_systems, slim_tools)


def fixed_parts(systems: DataFrame | None, tools: DataFrame | None, cfg: Config) -> tuple[DataFrame | None, DataFrame | None, DataFrame | None]:
    """Systems and tools after their stages, and request_id, fixed_in, fixed_out, system_minified, tools_minified."""
    counts = []
    if systems is not None:
        own = F.when(F.col("text").isNotNull(), tokens.estimate(F.col("text"))).otherwise(F.when(F.col("blk_idx") == -1, F.floor(F.length("raw_json") / 4)).otherwise(0)).cast("long")
        counts.append(systems.select("request_id", own.alias("fixed_in"), F.lit(0).cast("long").alias("fixed_out"), F.lit("system" in cfg.stages).alias("system_minified"), F.lit(0).cast("long").alias("tools_minified")))
        if "system" in cfg.stages:
            systems = systems.withColumn("text", text.minify_system(F.col("text")))
        counts.append(systems.select("request_id", F.lit(0).cast("long").alias("fixed_in"), own.alias("fixed_out"), F.lit(False).alias("system_minified"), F.lit(0).cast("long").alias("tools_minified")))
    if tools is not None:
        own = tokens.of_tool(F.col("description"), F.coalesce("schema_json", F.lit("{}")))
        counts.append(tools.select("request_id", own.alias("fixed_in"), F.lit(0).cast("long").alias("fixed_out"), F.lit(False).alias("system_minified"), F.lit(int("tools" in cfg.stages)).cast("long").alias("tools_minified")))
        if "tools" in cfg.stages:
            tools = minify_tools(tools, cfg.tool_skip)
        counts.append(tools.select("request_id", F.lit(0).cast("long").alias("fixed_in"), own.alias("fixed_out"), F.lit(False).alias("system_minified"), F.lit(0).cast("long").alias("tools_minified")))
    if not counts:
        return systems, tools, None
    fixed = reduce(DataFrame.unionByName, counts).groupBy("request_id").agg(F.sum("fixed_in").alias("fixed_in"), F.sum("fixed_out").alias("fixed_out"), F.max("system_minified").alias("system_minified"), F.sum("tools_minified").alias("tools_minified"))
    return systems, tools, fixed


def request_tokens(blocks: DataFrame, systems: DataFrame | None = None, tools: DataFrame | None = None) -> DataFrame:
    """request_id, tokens: all that a request takes, before any stage."""
    messages = blocks.groupBy("request_id").agg((F.sum(block_tokens()) + tokens.MESSAGE * F.count_distinct("msg_idx")).alias("tokens"))
    _, _, fixed = fixed_parts(systems, tools, Config(0, frozenset()))
    if fixed is None:
        return messages
    return messages.unionByName(fixed.select("request_id", F.col("fixed_in").alias("tokens"))).groupBy("request_id").agg(F.sum("tokens").alias("tokens"))


def summary(stats: DataFrame) -> DataFrame:
    """request_id and line: a report of what was saved."""
    saved = F.col("tokens_in") - F.col("tokens_out")
    pct = F.when(F.col("tokens_in") > 0, F.round(saved * 100 / F.col("tokens_in"), 0)).otherwise(0.0)
    return stats.select("request_id", F.format_string("in=%d out=%d -%d(%.0f%%) tools=%d sys=%s msgs=%d dedup=%d distill=%d dropped=%d%s", "tokens_in", "tokens_out", saved, pct, "tools_minified", F.when(F.col("system_minified"), "Y").otherwise("N"), "messages_minified", "dedup_count", "distill_count", "budget_dropped", F.when(F.col("tool_compressed") > 0, F.format_string(" compressed=%d", "tool_compressed")).otherwise("")).alias("line"))


def cumulative(runs: DataFrame) -> DataFrame:
    """One row: runs, tokens in and out, saved and the share of them, over all runs (run_id, tokens_in, tokens_out)."""
    t = runs.agg(F.count("*").alias("runs"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
    return t.withColumn("saved", F.col("tokens_in") - F.col("tokens_out")).withColumn("ratio", F.when(F.col("tokens_in") > 0, F.round(F.col("saved") / F.col("tokens_in"), 4)).otherwise(0.0))
