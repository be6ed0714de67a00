"""Conversion between the canonical form of a history and the form of flat roles, as gaps and islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnmill.sources.requests import BLOCKS, flat_text, inner, quoted, string


def content_text() -> Column:
    """The text of a message's content: a string itself, a list's texts joined."""
    return F.coalesce(F.when(F.col("kind") == "blocks", flat_text(F.col("content"))).when(F.col("kind") == "str", F.col("content")), F.lit(""))


def parsed_arguments(c: Column) -> Column:
    """A call's arguments as a JSON object: one that is given as an object or as its text; text that is no JSON under
    _raw; anything else gives an empty one."""
    v = F.try_parse_json(c)
    is_text = F.schema_of_variant(v) == "STRING"
    text = F.try_variant_get(v, "$", "string")
    given = F.when(is_text, F.try_parse_json(text)).otherwise(v)
    parsed = F.when(F.schema_of_variant(given).startswith("OBJECT"), F.to_json(given))
    return F.when(is_text & given.isNull(), F.to_json(F.named_struct(F.lit("_raw"), text))).otherwise(F.when(is_text, F.to_json(given)).otherwise(F.coalesce(parsed, F.lit("{}"))))


def to_canonical(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """messages_of() of a flat form as (blocks, systems): system messages leave the history and join into one text;
    neighbouring tool messages become one user message of results, whatever system messages lie between; assistant
    messages without text and calls go. Messages are numbered anew."""
    w = Window.partitionBy("request_id").orderBy("msg_idx")
    systems = messages.where("role = 'system'").groupBy("request_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(content_text() != "", F.struct("msg_idx", content_text().alias("t"))))), lambda x: x["t"]), "\n\n").alias("system"))
    m = messages.where("role is null or role <> 'system'")
    kept = F.filter(F.from_json("tool_calls", "array<variant>"), lambda v: F.schema_of_variant(v).startswith("OBJECT"))
    call = lambda v: F.struct(F.coalesce(string(v, "id"), F.lit("")).alias("id"), F.coalesce(F.try_variant_get(v, "$.function.name", "string"), F.lit("")).alias("name"), F.coalesce(F.to_json(inner(v, "function.arguments")), F.lit("{}")).alias("arguments"))
    m = m.withColumn("flat", content_text()).withColumn("calls", F.coalesce(F.transform(kept, call), F.array().cast("array<struct<id:string,name:string,arguments:string>>")))
    m = m.where("role is null or role <> 'assistant' or flat <> '' or size(calls) > 0")
    starts = ~((F.col("role") == "tool") & F.coalesce(F.lag("role").over(w) == "tool", F.lit(False)))
    m = m.withColumn("new_idx", F.sum(F.coalesce(starts, F.lit(True)).cast("int")).over(w) - 1)
    m = m.withColumn("in_run", F.row_number().over(Window.partitionBy("request_id", "new_idx").orderBy("msg_idx")) - 1)
    block = "struct<blk_idx:int,role:string,type:string,text:string,tool_id:string,tool_name:string,input_json:string,tr_text:string,tr_json:string,raw_json:string,msg_json:string>"
    none = F.lit(None).cast("string")

    def one(idx, role, kind, text=none, tool_id=none, name=none, args=none, result=none, raw=none):
        return F.struct(idx, role, F.lit(kind), text, tool_id, name, args, result, none, raw, none).cast(block)

    user, assistant = F.lit("user"), F.lit("assistant")
    said = F.when(F.col("flat") != "", F.array(one(F.lit(0), assistant, "text", F.col("flat")))).otherwise(F.array().cast(f"array<{block}>"))
    called = F.transform("calls", lambda c, i: one(i + 1, assistant, "tool_use", none, c["id"], c["name"], parsed_arguments(c["arguments"])))
    made = F.when(F.col("role") == "tool", F.array(one(F.col("in_run"), user, "tool_result", none, F.coalesce("tool_call_id", F.lit("")), none, none, F.col("flat")))).when(F.col("role") == "assistant", F.concat(said, called)).when(F.col("role") == "user", F.array(one(F.lit(-1), user, "str", F.col("flat")))).otherwise(F.array(one(F.lit(-1), F.col("role"), "other", none, none, none, none, none, F.col("raw_json"))))
    return m.select("request_id", F.col("new_idx").cast("int").alias("msg_idx"), F.explode(made).alias("b")).select("request_id", "msg_idx", "b.*").select(BLOCKS), systems


def from_canonical(blocks: DataFrame, systems: DataFrame | None = None) -> DataFrame:
    """request_id, msg_idx, role, content, tool_calls (id, name, arguments), tool_call_id, and raw_json of messages that
    pass as they are: the flat form of blocks. Results come before the text of their message; the system text first."""
    b = blocks.withColumn("rank", F.when(F.col("type") == "tool_result", 0).otherwise(1))
    none, no_calls = F.lit(None).cast("string"), F.lit(None).cast("array<struct<id:string,name:string,arguments:string>>")
    results = b.where("rank = 0 and role = 'user'").select("request_id", "msg_idx", "rank", "blk_idx", F.lit("tool").alias("role"), F.coalesce("tr_text", F.lit("")).alias("content"), no_calls.alias("tool_calls"), F.col("tool_id").alias("tool_call_id"), none.alias("raw_json"))
    texts = F.array_sort(F.collect_list(F.when(F.col("type").isin("text", "str"), F.struct("blk_idx", "text"))))
    calls = F.array_sort(F.collect_list(F.when(F.col("type") == "tool_use", F.struct("blk_idx", F.struct(F.col("tool_id").alias("id"), F.col("tool_name").alias("name"), F.coalesce("input_json", F.lit("{}")).alias("arguments")).alias("call")))))
    rest = b.where("rank = 1").groupBy("request_id", "msg_idx", "rank", "role").agg(texts.alias("texts"), calls.alias("calls"), F.first(F.when((F.col("type") == "other") & (F.col("blk_idx") == -1), F.col("raw_json")), True).alias("raw"))
    content = F.when(F.size("texts") > 0, F.array_join(F.transform("texts", lambda x: F.coalesce(x["text"], F.lit(""))), ""))
    rest = rest.select("request_id", "msg_idx", "rank", F.lit(0).alias("blk_idx"), "role", content.alias("content"), F.when(F.size("calls") > 0, F.transform("calls", lambda x: x["call"])).alias("tool_calls"), none.alias("tool_call_id"), F.col("raw").alias("raw_json"))
    flat = results.unionByName(rest)
    if systems is not None:
        flat = flat.unionByName(systems.where("system <> ''").select("request_id", F.lit(-1).alias("msg_idx"), F.lit(0).alias("rank"), F.lit(0).alias("blk_idx"), F.lit("system").alias("role"), F.col("system").alias("content"), no_calls.alias("tool_calls"), none.alias("tool_call_id"), none.alias("raw_json")))
    place = F.row_number().over(Window.partitionBy("request_id").orderBy("msg_idx", "rank", "blk_idx")) - 1
    return flat.select("request_id", place.alias("msg_idx"), "role", "content", "tool_calls", "tool_call_id", "raw_json")


def tools_to_canonical(tools: Column) -> Column:
    """A JSON list of function tools as a list of canonical ones."""
    empty = F.parse_json(F.lit('{"type":"object","properties":{}}'))
    field = lambda v, k: F.coalesce(F.try_variant_get(v, f"$.function.{k}", "string"), F.lit(""))
    schema = lambda v: F.when(F.coalesce(F.to_json(inner(v, "function.parameters")), F.lit("{}")).isin("{}", "null", "[]", '""', "0", "false"), empty).otherwise(inner(v, "function.parameters"))
    return F.to_json(F.transform(F.from_json(tools, "array<variant>"), lambda v: F.struct(field(v, "name").alias("name"), field(v, "description").alias("description"), schema(v).alias("input_schema"))))


def tools_from_canonical(tools: Column) -> Column:
    """The inverse."""
    empty = F.parse_json(F.lit('{"type":"object","properties":{}}'))
    field = lambda v, k: F.coalesce(F.try_variant_get(v, f"$.{k}", "string"), F.lit(""))
    schema = lambda v: F.when(F.coalesce(F.to_json(inner(v, "input_schema")), F.lit("{}")).isin("{}", "null", "[]", '""', "0", "false"), empty).otherwise(inner(v, "input_schema"))
    one = lambda v: F.struct(F.lit("function").alias("type"), F.struct(field(v, "name").alias("name"), field(v, "description").alias("description"), schema(v).alias("parameters")).alias("function"))
    return F.to_json(F.transform(F.from_json(tools, "array<variant>"), one))


def flat_json(flat: DataFrame) -> DataFrame:
    """request_id, msg_idx, m: messages of from_canonical() as JSON."""
    call = lambda c: F.struct(c["id"].alias("id"), F.lit("function").alias("type"), F.struct(c["name"].alias("name"), c["arguments"].alias("arguments")).alias("function"))
    calls = F.to_json(F.transform("tool_calls", call))
    text = F.coalesce(quoted(F.col("content")), F.lit("null"))
    role = F.concat(F.lit('{"role":'), F.coalesce(quoted(F.col("role")), F.lit("null")))
    made = F.concat(role, F.when(F.col("role") == "tool", F.concat(F.lit(',"tool_call_id":'), quoted(F.coalesce("tool_call_id", F.lit(""))))).otherwise(""), F.lit(',"content":'), text, F.when(calls.isNotNull(), F.concat(F.lit(',"tool_calls":'), calls)).otherwise(""), F.lit("}"))
    return flat.select("request_id", "msg_idx", F.when(F.col("raw_json").isNotNull(), F.col("raw_json")).otherwise(made).alias("m"))
