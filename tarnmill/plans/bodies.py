"""Whole request bodies through all stages, whatever their format: what a proxy would send on.

A body stays one row. Its content blocks are an array of structs that every stage maps over; what stages need from other
blocks (the last place of a content, neighbours of a tool call, tokens before a message) comes from sorted arrays and folds
over them. So there is no exchange, no join and no window, a body is parsed once, equal bodies are rows like any others, and
the same plan runs on a stream.

Defined results: a body that is no JSON object passes, with counts of 0, as does a null one; a body that no stage changes
comes back byte for byte, as do all of them where no stage is on; in a changed one, values that no stage touches stay the
same JSON values, keys of the body keep their order. Equal request ids don't matter. Other columns of requests stay.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnmill.functions import compress, dom, text, tokens
from tarnmill.functions.text import let
from tarnmill.functions.tools import bare_schema, slim_description
from tarnmill.operators import adapters
from tarnmill.operators.history import content_key
from tarnmill.plans.optimize import Config
from tarnmill.sources import requests as R

#: A content block with its message: first and last tell where that begins and ends, whole that it has no list of blocks;
#: shaped is a result's content if that is no string, listed whether it is a list; raw is the block, m the message.
BLOCK = "place:int,first:boolean,last:boolean,whole:boolean,role:string,type:string,text:string,tool_id:string,name:string,input:string,result:string,shaped:string,listed:boolean,raw:variant,m:variant"
CALL = "struct<id:string,name:string,arguments:string>"
COUNTS = ["tokens_in", "tokens_out", "tools_minified", "system_minified", "messages_minified", "dedup_count", "distill_count", "budget_dropped", "tool_compressed", "dom_minified"]


def passes_as_it_is(cfg: Config) -> bool:
    """Whether no stage is on, so that bodies needn't be taken apart."""
    return not cfg.stages


def is_object(c: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT"), F.lit(False))


def items(v: Column) -> Column:
    """The elements of a JSON list, null for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def long(n: int) -> Column:
    return F.lit(n).cast("long")


def made(entries: Column, new: dict[str, Column], more: Column | None = None) -> Column:
    """Key and value pairs as a JSON object, some of the values given as JSON."""
    value = lambda e: F.coalesce(*(F.when(e["key"] == k, j) for k, j in new.items()), F.to_json(e["value"]))
    fields = F.transform(entries, lambda e: F.concat(R.quoted(e["key"]), F.lit(":"), value(e)))
    return F.concat(F.lit("{"), F.array_join(fields if more is None else F.concat(fields, more), ","), F.lit("}"))


def pairs_of(v: Column) -> Column:
    return F.map_entries(F.try_variant_get(v, "$", R.FIELDS))


def block(place, first, last, whole, role, kind, **more) -> Column:
    none = F.lit(None).cast("string")
    empty = F.lit(None).cast("variant")
    given = [more.get(k, none) for k in ("text", "tool_id", "name", "input", "result", "shaped")]
    return F.struct(place, first, last, whole, role, kind, *given, more.get("listed", F.lit(False)), more.get("raw", empty), more.get("m", empty)).cast(f"struct<{BLOCK}>")


def canonical_blocks(messages: Column) -> Column:
    """The blocks of a list of messages in the canonical form."""

    def of_message(m: Column, i: Column) -> Column:
        role, content = R.string(m, "role"), R.inner(m, "content")

        def listed(parts: Column) -> Column:
            return F.transform(parts, lambda v, k: one(v, k == 0, k == F.size(parts) - 1))

        def one(v: Column, first: Column, last: Column) -> Column:
            kind = F.coalesce(R.string(v, "type"), F.lit("other"))
            result = F.when(kind == "tool_result", R.inner(v, "content"))
            flat = F.when(R.kind_of(result) == "str", R.string(v, "content")).otherwise(R.flat_text(F.to_json(result)))
            return block(
                i, first, last, F.lit(False), role, kind, text=R.string(v, "text"), tool_id=F.coalesce(R.string(v, "id"), R.string(v, "tool_use_id")), name=R.string(v, "name"), input=F.to_json(R.inner(v, "input")),
                result=flat, shaped=F.when(R.kind_of(result) != "str", F.to_json(result)), listed=F.coalesce(R.kind_of(result) == "blocks", F.lit(False)), raw=v, m=m,
            )

        words = R.string(m, "content")
        plain = F.array(block(i, F.lit(True), F.lit(True), F.lit(True), role, F.when(words.isNull(), "other").otherwise("str"), text=words, raw=m, m=m))
        return let(items(content), lambda parts: F.when(F.size(parts) > 0, listed(parts)).otherwise(plain))

    return F.flatten(F.transform(messages, of_message))


def flat_text_of(m: Column) -> Column:
    content = R.inner(m, "content")
    return F.coalesce(F.when(R.kind_of(content) == "str", R.string(m, "content")).when(R.kind_of(content) == "blocks", R.flat_text(F.to_json(content))), F.lit(""))


def flat_systems(messages: Column) -> Column:
    """The text of all system messages of the flat form, null where there is none."""
    told = F.filter(messages, lambda m: F.coalesce(R.string(m, "role") == "system", F.lit(False)))
    return F.when(F.size(told) > 0, F.array_join(F.filter(F.transform(told, flat_text_of), lambda t: t != ""), "\n\n"))


def with_flat_blocks(d: DataFrame, messages: str, out: str) -> DataFrame:
    """d with the canonical blocks of a list of messages in the flat form: system messages go, as do assistants that say and
    call nothing; neighbouring results are one message."""
    calls = lambda m: F.filter(items(R.inner(m, "tool_calls")), lambda v: F.schema_of_variant(v).startswith("OBJECT"))
    call = lambda v: F.struct(F.coalesce(R.string(v, "id"), F.lit("")), F.coalesce(F.try_variant_get(v, "$.function.name", "string"), F.lit("")), F.coalesce(F.to_json(R.inner(v, "function.arguments")), F.lit("{}"))).cast(CALL)
    said = lambda m: F.struct(F.coalesce(R.string(m, "role"), F.lit("")).alias("role"), flat_text_of(m).alias("text"), F.coalesce(F.transform(calls(m), call), F.array().cast(f"array<{CALL}>")).alias("calls"), F.coalesce(R.string(m, "tool_call_id"), F.lit("")).alias("id"), m.alias("m"))
    kept = F.filter(F.transform(messages, said), lambda s: (s["role"] != "system") & ((s["role"] != "assistant") | (s["text"] != "") | (F.size(s["calls"]) > 0)))
    d = d.withColumn(out, kept)
    starts = F.transform(out, lambda s, i: (s["role"] != "tool") | ~F.coalesce(F.get(out, i - 1)["role"] == "tool", F.lit(False)))
    d = d.withColumn("_starts", starts)
    places = F.aggregate("_starts", F.array().cast("array<int>"), lambda a, s: F.array_append(a, F.coalesce(F.get(a, F.size(a) - 1), F.lit(-1)) + s.cast("int")))
    d = d.withColumn("_places", places)
    yes, user, assistant = F.lit(True), F.lit("user"), F.lit("assistant")

    def blocks(s: Column, i: Column) -> Column:
        place, n = F.get("_places", i), F.size(s["calls"])
        spoken = F.array(block(place, yes, n == 0, F.lit(False), assistant, F.lit("text"), text=s["text"]))
        called = F.transform(s["calls"], lambda c, k: block(place, (k == 0) & (s["text"] == ""), k == n - 1, F.lit(False), assistant, F.lit("tool_use"), tool_id=c["id"], name=c["name"], input=adapters.parsed_arguments(c["arguments"])))
        ends = F.coalesce(F.get("_starts", i + 1), yes)
        result = F.array(block(place, F.get("_starts", i), ends, F.lit(False), user, F.lit("tool_result"), tool_id=s["id"], result=s["text"]))
        return (
            F.when(s["role"] == "tool", result).when(s["role"] == "assistant", F.when(s["text"] == "", called).otherwise(F.concat(spoken, called)))
            .when(s["role"] == "user", F.array(block(place, yes, yes, yes, user, F.lit("str"), text=s["text"])))
            .otherwise(F.array(block(place, yes, yes, yes, R.string(s["m"], "role"), F.lit("other"), raw=s["m"], m=s["m"])))
        )

    return d.withColumn(out, F.flatten(F.transform(out, blocks))).drop("_starts", "_places")


def tokens_of(b: Column) -> Column:
    return tokens.of_block(b["type"], b["text"], b["result"], b["input"], F.to_json(b["raw"]), F.when(b["listed"], b["shaped"]))


def ordered(name: str, value: Callable[[Column, Column], Column]) -> Column:
    """Values of an array's elements, sorted; each ends with the element's place."""
    return F.array_sort(F.transform(name, value))


def with_stubs(d: DataFrame, cfg: Config) -> DataFrame:
    """_blocks with stubbed: earlier ones of equal long results. Contents are sorted with their places; a fold from the end
    knows the last place of each."""
    long_result = lambda b: (b["type"] == "tool_result") & (F.length(b["result"]) >= cfg.dedup_min_chars) & (F.col("_n") >= 2)
    d = d.withColumn("_seen", F.when(F.exists("_blocks", long_result), ordered("_blocks", lambda b, j: F.struct(F.coalesce(F.when(long_result(b), content_key(b["result"], b["shaped"])), F.concat(F.lit(":"), j.cast("string"))).alias("key"), b["place"].alias("place"), j.alias("j")))))
    start = F.struct(F.lit("").alias("key"), F.lit(-1).alias("last"), F.array().cast("array<struct<j:int,stub:boolean>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        last = F.when(a["key"] == x["key"], a["last"]).otherwise(x["place"])
        return F.struct(x["key"].alias("key"), last.alias("last"), F.array_append(a["out"], F.struct(x["j"].alias("j"), (x["place"] < last).alias("stub"))).alias("out"))

    d = d.withColumn("_stubs", F.array_sort(F.aggregate(F.reverse("_seen"), start, step, lambda a: a["out"])))

    def stubbed(b: Column, j: Column) -> Column:
        stub = F.coalesce(F.get("_stubs", j)["stub"], F.lit(False))
        return b.withField("stubbed", stub).withField("result", F.when(stub, F.format_string(cfg.stub, F.length(b["result"]))).otherwise(b["result"]))

    return d.withColumn("_blocks", F.transform("_blocks", stubbed)).drop("_seen", "_stubs")


def with_drop_point(d: DataFrame, cfg: Config) -> DataFrame:
    """_dropped: how many leading messages go so that the rest fits the budget and no tool pair is cut."""
    fits_all = (F.col("_total") <= cfg.token_budget) | (F.col("_n") <= cfg.keep_last)
    tool = lambda b: b["type"].isin("tool_use", "tool_result") & b["tool_id"].isNotNull()
    d = d.withColumn("_events", F.when(~fits_all, ordered("_blocks", lambda b, j: F.struct(F.when(tool(b), F.concat(F.lit("t"), b["tool_id"])).otherwise(F.concat(F.lit(":"), j.cast("string"))).alias("id"), j.alias("j"), b["type"].alias("type")))))

    def opened(e: Column, i: Column) -> Column:
        after, before = F.get("_events", i + 1), F.get("_events", i - 1)
        opens = (e["type"] == "tool_use") & F.coalesce((after["id"] == e["id"]) & (after["type"] == "tool_result"), F.lit(False))
        closes = (e["type"] == "tool_result") & F.coalesce((before["id"] == e["id"]) & (before["type"] == "tool_use"), F.lit(False))
        return F.struct(e["j"].alias("j"), F.when(opens, 1).when(closes, -1).otherwise(0).alias("d"))

    d = d.withColumn("_events", F.array_sort(F.transform("_events", opened)))
    state = F.struct(long(0).alias("open"), long(0).alias("before"), F.lit(None).cast("int").alias("least"), F.lit(None).cast("int").alias("most"))

    def step(a: Column, x: Column) -> Column:
        may = x["first"] & (a["open"] == 0) & (x["place"] >= 1) & (x["place"] <= F.col("_n") - cfg.keep_last)
        least = F.coalesce(a["least"], F.when(may & (F.col("_total") - a["before"] <= cfg.token_budget), x["place"]))
        return F.struct((a["open"] + x["d"]).alias("open"), (a["before"] + x["size"]).alias("before"), least.alias("least"), F.when(may, x["place"]).otherwise(a["most"]).alias("most"))

    sizes = F.zip_with("_blocks", "_events", lambda b, e: F.struct(b["first"].alias("first"), b["place"].alias("place"), (b["tok"] + F.when(b["first"], tokens.MESSAGE).otherwise(0)).alias("size"), e["d"].alias("d")))
    furthest = (lambda a: F.col("_n")) if cfg.keep_last == 0 else (lambda a: a["most"])
    found = F.aggregate(sizes, state, step, lambda a: F.coalesce(a["least"], furthest(a), F.lit(0)))
    return d.withColumn("_dropped", F.when(fits_all, 0).otherwise(found)).drop("_events")


def each_of(one: Callable[[str], str | None]):
    """A function over lists of texts, for lists in columns: what no expression can do runs once for all of a row's."""

    @F.pandas_udf("array<string>")
    def run(lists: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else [None if t is None else one(t) for t in x] for x in lists], index=lists.index, dtype=object)

    return run


def with_compressed(d: DataFrame, cfg: Config) -> DataFrame:
    """_blocks with compressed, and long results of the messages that are left made smaller by their shape."""
    mine = lambda b: (b["type"] == "tool_result") & (b["role"] == "user") & (b["place"] >= F.col("_dropped")) & (F.length(b["result"]) >= compress.LEAST)
    json = lambda b: F.when(mine(b) & b["result"].rlike(r"^\s*[\[{]"), b["result"])
    d = d.withColumn("_json", F.transform("_blocks", json)).withColumn("_json", F.when(F.exists("_json", lambda x: x.isNotNull()), F.col("_json")))
    d = d.withColumn("_json", each_of(compress.compacted)("_json"))

    def packed(b: Column, j: Column) -> Column:
        new = F.when(mine(b), compress.compress_text(b["result"], F.get("_json", j)))
        return let(new, lambda x: b.withField("compressed", x.isNotNull()).withField("result", F.coalesce(x, b["result"])))

    return d.withColumn("_blocks", F.transform("_blocks", packed)).drop("_json")


def block_json(b: Column) -> Column:
    """A canonical block with what stages changed."""
    result = F.when(b["shaped"].isNull(), R.quoted(b["result"])).otherwise(F.to_json(F.array(F.struct(F.lit("text").alias("type"), b["result"].alias("text")))))
    return F.when(b["minified"] | b["distilled"], made(pairs_of(b["raw"]), {"text": R.quoted(b["text"])})).when(b["stubbed"] | b["pruned"] | b["compressed"], made(pairs_of(b["raw"]), {"content": result})).otherwise(F.to_json(b["raw"]))


def canonical_piece(b: Column) -> Column:
    """What a block adds to the text of a list of messages, each of which begins with a comma."""
    string = F.when(b["minified"] | b["distilled"], made(pairs_of(b["m"]), {"content": R.quoted(b["text"])})).otherwise(F.to_json(b["m"]))
    frame = F.array_join(F.transform(F.filter(pairs_of(b["m"]), lambda e: e["key"] != "content"), lambda e: F.concat(R.quoted(e["key"]), F.lit(":"), F.to_json(e["value"]), F.lit(","))), "")
    listed = F.concat(F.when(b["first"], F.concat(F.lit(",{"), frame, F.lit('"content":['))).otherwise(","), block_json(b), F.when(b["last"], "]}").otherwise(""))
    return F.when(b["whole"], F.concat(F.lit(","), string)).otherwise(listed)


def flat_piece(b: Column) -> Column:
    """The same in the flat form: results are messages each; an assistant's calls follow what it says."""
    call = F.to_json(F.struct(b["tool_id"].alias("id"), F.lit("function").alias("type"), F.struct(b["name"].alias("name"), F.coalesce(b["input"], F.lit("{}")).alias("arguments")).alias("function")))
    result = F.concat(F.lit(',{"role":"tool","tool_call_id":'), R.quoted(b["tool_id"]), F.lit(',"content":'), R.quoted(b["result"]), F.lit("}"))
    spoken = F.concat(F.lit(',{"role":"assistant","content":'), R.quoted(b["text"]), F.when(b["last"], "}").otherwise(',"tool_calls":['))
    # A call follows the text or another call of its message; the text itself ends with the list's opening.
    called = F.concat(F.when(b["first"], ',{"role":"assistant","content":null,"tool_calls":[').when(b["after_text"], "").otherwise(","), call, F.when(b["last"], "]}").otherwise(""))
    return (
        F.when(b["type"] == "tool_result", result).when(b["type"] == "tool_use", called).when(b["type"] == "text", spoken)
        .when(b["type"] == "str", F.concat(F.lit(',{"role":"user","content":'), R.quoted(b["text"]), F.lit("}"))).otherwise(F.concat(F.lit(","), F.to_json(b["m"])))
    )


def joined(pieces: Column) -> Column:
    return F.concat(F.lit("["), F.substring(F.array_join(pieces, ""), 2, 1 << 30), F.lit("]"))


def with_systems(d: DataFrame, cfg: Config) -> DataFrame:
    """_system_json (what stands for it now, null where there is none), _system_text of the flat form, and counts."""
    v = F.col("_system")
    one = lambda t: text.minify_system(t) if "system" in cfg.stages else t
    plain, parts = F.try_variant_get(v, "$", "string"), items(v)
    is_text = F.schema_of_variant(v) == "STRING"
    words = lambda p: F.when(R.string(p, "type") == "text", R.string(p, "text"))
    total = lambda c: F.aggregate(c, long(0), lambda a, x: a + x)
    own = F.when(F.col("_flat"), F.col("_told")).when(is_text, plain)
    d = d.withColumn("_own", own).withColumn("_own_now", one(F.col("_own")))
    d = d.withColumn("_parts", F.when(~F.col("_flat"), F.transform(parts, lambda p: F.struct(p.alias("v"), words(p).alias("text"), one(words(p)).alias("now")))))
    rest = F.when(v.isNull() | F.col("_flat") | F.col("_parts").isNotNull(), 0).otherwise(F.floor(F.length(F.to_json(v)) / 4))
    size = lambda own, key: F.when(F.col(own).isNotNull(), tokens.estimate(F.col(own))).otherwise(F.coalesce(total(F.transform("_parts", lambda p: tokens.estimate(p[key]))), rest)).cast("long")
    listed = F.concat(F.lit("["), F.array_join(F.transform("_parts", lambda p: F.when(p["text"].eqNullSafe(p["now"]), F.to_json(p["v"])).otherwise(made(pairs_of(p["v"]), {"text": R.quoted(p["now"])}))), ","), F.lit("]"))
    same = F.col("_own").eqNullSafe(F.col("_own_now")) & ~F.coalesce(F.exists("_parts", lambda p: ~p["text"].eqNullSafe(p["now"])), F.lit(False))
    there = (F.col("_own").isNotNull() | (F.size("_parts") > 0) | (~F.col("_flat") & v.isNotNull() & F.col("_parts").isNull()))
    d = d.withColumn("_system_in", size("_own", "text")).withColumn("_system_out", size("_own_now", "now")).withColumn("_system_same", same)
    return d.withColumn("system_minified", F.coalesce(there, F.lit(False)) & F.lit("system" in cfg.stages)).withColumn("_system_json", F.when(F.col("_own").isNotNull(), R.quoted(F.col("_own_now"))).otherwise(listed)).drop("_own", "_parts")


def with_tools(d: DataFrame, cfg: Config) -> DataFrame:
    """_tools_json (null where there is no list of tools) and counts."""
    flat = F.from_json(adapters.tools_to_canonical(F.to_json(F.col("_tools"))), "array<variant>")
    listed = F.when(F.col("_flat"), flat).otherwise(items(F.col("_tools")))
    tool = "array<struct<v:variant,name:string,description:string,schema:string>>"
    d = d.withColumn("_each", F.transform(listed, lambda v: F.struct(v.alias("v"), R.string(v, "name"), R.string(v, "description"), F.to_json(R.inner(v, "input_schema")))).cast(tool))
    size = lambda description, schema: tokens.of_tool(description, F.coalesce(schema, F.lit("{}")))
    total = lambda c: F.coalesce(F.aggregate(c, long(0), lambda a, x: a + x), long(0))
    if "tools" not in cfg.stages:
        d = d.withColumn("_tools_in", total(F.transform("_each", lambda t: size(t["description"], t["schema"]))))
        now = F.transform("_each", lambda t: F.to_json(t["v"]))
        return d.withColumn("_tools_out", F.col("_tools_in")).withColumn("tools_minified", long(0)).withColumn("_tools_same", F.lit(True)).withColumn("_tools_json", F.concat(F.lit("["), F.array_join(now, ","), F.lit("]"))).drop("_each")
    keep = lambda t: F.coalesce(t["name"].isin(*cfg.tool_skip), F.lit(False)) if cfg.tool_skip else F.lit(False)
    d = d.withColumn("_schemas", F.when(F.size("_each") > 0, F.transform("_each", lambda t: F.when(~keep(t), t["schema"]))))
    d = d.withColumn("_schemas", each_of(bare_schema)("_schemas"))
    new = lambda t, i: t.withField("new_description", F.when(keep(t), t["description"]).otherwise(slim_description(t["description"]))).withField("new_schema", F.coalesce(F.get("_schemas", i), t["schema"]))
    d = d.withColumn("_each", F.transform("_each", new))
    changed = lambda t: ~t["description"].eqNullSafe(t["new_description"]) | ~t["schema"].eqNullSafe(t["new_schema"])
    one = lambda t: F.when(changed(t), made(pairs_of(t["v"]), {"description": F.when(t["new_description"].isNotNull(), R.quoted(t["new_description"])), "input_schema": t["new_schema"]})).otherwise(F.to_json(t["v"]))
    d = d.withColumn("_tools_in", total(F.transform("_each", lambda t: size(t["description"], t["schema"])))).withColumn("_tools_out", total(F.transform("_each", lambda t: size(t["new_description"], t["new_schema"]))))
    d = d.withColumn("tools_minified", F.greatest(F.size("_each"), F.lit(0)).cast("long")).withColumn("_tools_same", ~F.coalesce(F.exists("_each", changed), F.lit(False)))
    return d.withColumn("_tools_json", F.concat(F.lit("["), F.array_join(F.transform("_each", one), ","), F.lit("]"))).drop("_each", "_schemas")


def with_texts(d: DataFrame, cfg: Config) -> DataFrame:
    """_blocks with white space, old texts and pages made smaller, and minified, distilled, pruned, which say where."""
    is_text = lambda b: b["type"].isin("text", "str") & (F.col("_n") >= 2)

    def slim(b: Column) -> Column:
        now = F.when(is_text(b), text.minify_text(b["text"])).otherwise(b["text"]) if "messages" in cfg.stages else b["text"]
        return let(now, lambda t: b.withField("minified", F.coalesce(t != b["text"], F.lit(False))).withField("text", t))

    def short(b: Column) -> Column:
        old = is_text(b) & (b["place"] < F.col("_n") - cfg.keep_last) & (F.length(b["text"]) > 360)
        now = F.when(old, text.distill(b["text"], cfg.distill_max_chars, cfg.note)).otherwise(b["text"]) if "distill" in cfg.stages else b["text"]
        return let(now, lambda t: b.withField("distilled", F.coalesce(t != b["text"], F.lit(False))).withField("text", t))

    d = d.withColumn("_blocks", F.transform("_blocks", lambda b: b.withField("tok_in", tokens_of(b))))
    d = d.withColumn("_blocks", F.transform(F.transform("_blocks", slim), short))
    if "dedup" in cfg.stages:
        d = with_stubs(d, cfg)
    else:
        d = d.withColumn("_blocks", F.transform("_blocks", lambda b: b.withField("stubbed", F.lit(False))))

    def bare(b: Column) -> Column:
        page = F.coalesce((b["type"] == "tool_result") & b["shaped"].isNull() & dom.looks_like_page(b["result"]), F.lit(False)) if cfg.minify_dom else F.lit(False)
        return b.withField("pruned", page).withField("result", F.when(page, dom.prune(b["result"])).otherwise(b["result"]) if cfg.minify_dom else b["result"])

    size = lambda b: F.when(b["stubbed"] | b["pruned"], tokens.estimate(b["result"])).when(b["minified"] | b["distilled"], tokens.estimate(b["text"])).otherwise(b["tok_in"])
    d = d.withColumn("_blocks", F.transform("_blocks", bare))
    return d.withColumn("_blocks", F.transform("_blocks", lambda b: b.withField("tok", size(b))))


def minify(requests: DataFrame, cfg: Config, fmt: Column | None = None) -> DataFrame:
    """requests (request_id, body and, if there is one, path) with body as the stages leave it and the counts of COUNTS. The
    format is fmt, or follows from path, and is the canonical one where neither tells it. The key grammar goes. Bodies of
    other formats are converted, and back at the end; without a list of messages they pass."""
    out = [c for c in requests.columns if c not in COUNTS]
    if passes_as_it_is(cfg):
        return requests.select(*out, *(F.lit(False if c == "system_minified" else 0).cast("boolean" if c == "system_minified" else "long").alias(c) for c in COUNTS))
    if fmt is None:
        fmt = R.detect_format(F.col("path")) if "path" in requests.columns else F.lit(None).cast("string")
    fields = F.map_entries(F.from_json("body", R.FIELDS))
    d = requests.select(*out, (F.coalesce(fmt, F.lit("anthropic")) != "anthropic").alias("_flat"), F.when(is_object(F.col("body")), fields).alias("_fields"))
    value = lambda k: F.get(F.filter("_fields", lambda e: e["key"] == k), F.lit(0))["value"]
    d = d.withColumn("_list", items(value("messages"))).withColumn("_flat", F.col("_flat") & F.col("_list").isNotNull())
    d = d.withColumn("_system", value("system")).withColumn("_tools", value("tools")).withColumn("_told", F.when(F.col("_flat"), flat_systems(F.col("_list"))))
    d = with_tools(with_systems(d, cfg), cfg)
    d = with_flat_blocks(d.withColumn("_other", F.when(F.col("_flat"), F.col("_list"))), "_other", "_other")
    d = d.withColumn("_blocks", F.when(F.col("_flat"), F.col("_other")).otherwise(canonical_blocks(F.col("_list")))).drop("_other")
    d = d.withColumn("_n", F.coalesce(F.get("_blocks", F.size("_blocks") - 1)["place"] + 1, F.lit(0)))
    d = with_texts(d, cfg)
    frames = lambda key: F.coalesce(F.aggregate("_blocks", long(0), lambda a, b: a + b[key] + F.when(b["first"], tokens.MESSAGE).otherwise(0)), long(0))
    d = d.withColumn("tokens_in", frames("tok_in") + F.col("_system_in") + F.col("_tools_in")).withColumn("_total", frames("tok") + F.col("_system_out") + F.col("_tools_out"))
    d = with_drop_point(d, cfg) if cfg.token_budget > 0 else d.withColumn("_dropped", F.lit(0))
    d = with_compressed(d, cfg) if cfg.tool_compress else d.withColumn("_blocks", F.transform("_blocks", lambda b: b.withField("compressed", F.lit(False))))
    left = F.filter("_blocks", lambda b: b["place"] >= F.col("_dropped"))
    size = lambda b: F.when(b["compressed"], tokens.estimate(b["result"])).otherwise(b["tok"]) + F.when(b["first"], tokens.MESSAGE).otherwise(0)
    number = lambda key: F.coalesce(F.size(F.filter("_blocks", lambda b: b[key])), F.lit(0)).cast("long")
    messages = lambda key: F.coalesce(F.size(F.array_distinct(F.transform(F.filter("_blocks", lambda b: b[key]), lambda b: b["place"]))), F.lit(0)).cast("long")
    d = d.withColumn("_left", left).withColumn("tokens_out", F.coalesce(F.aggregate("_left", long(0), lambda a, b: a + size(b)), long(0)) + F.col("_system_out") + F.col("_tools_out"))
    for name, c in {"messages_minified": messages("minified"), "distill_count": messages("distilled"), "dedup_count": number("stubbed"), "dom_minified": number("pruned"), "tool_compressed": number("compressed")}.items():
        d = d.withColumn(name, F.when(F.col("_blocks").isNull(), long(0)).otherwise(c))
    d = d.withColumn("budget_dropped", F.coalesce(F.col("_dropped"), F.lit(0)).cast("long"))
    after_text = lambda b, i: b.withField("after_text", F.coalesce((F.get("_left", i - 1)["place"] == b["place"]) & (F.get("_left", i - 1)["type"] == "text"), F.lit(False)))
    first = F.when(F.col("_own_now") != "", F.array(F.concat(F.lit(',{"role":"system","content":'), R.quoted(F.col("_own_now")), F.lit("}")))).otherwise(F.array().cast("array<string>"))
    flat = F.concat(F.coalesce(first, F.array().cast("array<string>")), F.transform(F.transform("_left", after_text), flat_piece))
    d = d.withColumn("_messages_json", joined(F.when(F.col("_flat"), flat).otherwise(F.transform("_left", canonical_piece))))
    touched = F.exists("_blocks", lambda b: b["minified"] | b["distilled"] | b["stubbed"] | b["pruned"] | b["compressed"]) | (F.col("_dropped") > 0)
    same = ~F.col("_flat") & F.col("_system_same") & F.col("_tools_same") & ~F.coalesce(touched, F.lit(False)) & value("grammar").isNull()
    gone = lambda e: (e["key"] == "grammar") | (F.col("_flat") & ((e["key"] == "system") | ((e["key"] == "tools") & F.coalesce(F.col("_tools_json") == "[]", F.lit(False)))))
    tools = F.when(F.col("_flat"), adapters.tools_from_canonical(F.col("_tools_json"))).otherwise(F.col("_tools_json"))
    whole = made(F.filter("_fields", lambda e: ~gone(e)), {"messages": F.col("_messages_json"), "system": F.col("_system_json"), "tools": tools})
    body = F.when(F.col("_fields").isNull() | same, F.col("body")).otherwise(whole)
    rows = d.withColumn("body", body)
    zero = {c: F.coalesce(F.col(c), F.lit(False) if c == "system_minified" else long(0)).alias(c) for c in COUNTS}
    return rows.select(*out, *zero.values())


def minify_bodies(requests: DataFrame, cfg: Config, fmt: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(request_id and body, request_id and counts) of requests; minify() gives both in one pass."""
    done = minify(requests, cfg, fmt)
    return done.select("request_id", "body"), done.select("request_id", *COUNTS)


def minify_events(events: DataFrame, cfg: Config) -> DataFrame:
    """event_id and event: events of a streamed request (event_id, event) whose first data line is a JSON object, with
    that replaced by what the stages make of it; all others as they are."""
    start = F.locate("data: ", F.col("event"))
    rest = F.substring(F.col("event"), start + 6, F.length("event"))
    stop = F.locate("\n", rest)
    payload = F.when((start > 0) & (stop > 0), F.substring(rest, F.lit(1), stop - 1))
    e = events.select("event_id", "event", F.substring(F.col("event"), F.lit(1), start + 5).alias("head"), F.substring(rest, stop, F.length(rest)).alias("tail"), F.trim(payload).alias("body"))
    e = e.withColumn("fine", is_object(F.col("body")))
    return minify(e, cfg).select("event_id", F.when(F.col("fine"), F.concat("head", "body", "tail")).otherwise(F.col("event")).alias("event"))
