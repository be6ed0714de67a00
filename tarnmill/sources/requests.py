"""Reading request bodies, their tables of messages, content blocks, system texts and tools, and writing them back.

A body is taken apart as VARIANT values, so whatever no stage changes comes back as it was: other keys of bodies, messages
and blocks, their order, and the kind of every value (numbers in their plainest form, keys of inner objects in order)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: tr_json is a tool result's content if it isn't a string, msg_json the message with null in place of its content.
BLOCKS = "request_id, msg_idx, blk_idx, role, type, text, tool_id, tool_name, input_json, tr_text, tr_json, raw_json, msg_json".split(", ")
FIELDS = "map<string,variant>"


def read_bodies(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """request_id and body: a body for each line, or for each file. Equal bodies have ids of their own: beside the digest of
    file and body an id has the row's number, which stays the same when a task runs again."""
    lines = spark.read.text(path, wholetext=whole_files).select(F.col("value").alias("body"), F.col("_metadata.file_path").alias("file"))
    digest = F.sha2(F.concat_ws("\u0001", "file", "body"), 256)
    return lines.select(F.concat_ws("-", digest, F.lower(F.hex(F.monotonically_increasing_id()))).alias("request_id"), "body")


def detect_format(path: Column) -> Column:
    """The format that a request's path stands for; null if it is unknown."""
    p = F.regexp_replace(F.substring_index(path, "?", 1), "/+$", "")
    return F.when(p.endswith("/v1/messages"), "anthropic").when(p.endswith("/v1/chat/completions"), "openai").when(p.endswith("/api/chat") | p.endswith("/api/generate"), "ollama")


def kind_of(v: Column) -> Column:
    """str, blocks (a list) or other."""
    schema = F.schema_of_variant(v)
    return F.when(schema == "STRING", "str").when(schema.startswith("ARRAY"), "blocks").otherwise("other")


def inner(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant")


def string(v: Column, key: str) -> Column:
    """A field that is a string, else null."""
    return F.when(F.schema_of_variant(inner(v, key)) == "STRING", F.try_variant_get(v, f"$.{key}", "string"))


def quoted(c: Column) -> Column:
    """A string as JSON."""
    listed = F.to_json(F.array(c))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def with_field(raw: Column, key: str, value: Column) -> Column:
    """The JSON object raw with another JSON value for one of its keys, in its old place, or at the end if it has none."""
    fields = F.from_json(raw, FIELDS)
    new = F.parse_json(value)
    there = F.transform_values(fields, lambda k, v: F.when(k == key, new).otherwise(v))
    return F.to_json(F.when(F.map_contains_key(fields, key), there).otherwise(F.map_concat(fields, F.create_map(F.lit(key), new))))


def flat_text(content: Column) -> Column:
    """The text of a content given as JSON: a string itself, a list's strings and texts of text blocks joined."""
    v = F.try_parse_json(content)
    parts = F.try_variant_get(v, "$", "array<variant>")
    text = lambda p: F.when(F.schema_of_variant(p) == "STRING", F.try_variant_get(p, "$", "string")).when(F.coalesce(string(p, "type"), F.lit("text")) == "text", string(p, "text"))
    joined = F.array_join(F.transform(parts, lambda p: F.coalesce(text(p), F.lit(""))), "")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).when(F.schema_of_variant(v).startswith("ARRAY"), joined)


def messages_of(requests: DataFrame) -> DataFrame:
    """request_id, msg_idx, role, kind (str, blocks, other), content (a string, or JSON), tool_calls, tool_call_id,
    raw_json of bodies that are JSON; others give no rows."""
    m = requests.select("request_id", F.posexplode(F.from_json("body", "messages array<variant>")["messages"]).alias("msg_idx", "v"))
    v = F.col("v")
    content = inner(v, "content")
    text = F.when(kind_of(content) == "str", F.try_variant_get(v, "$.content", "string")).otherwise(F.to_json(content))
    return m.select("request_id", "msg_idx", string(v, "role").alias("role"), kind_of(content).alias("kind"), text.alias("content"), F.to_json(inner(v, "tool_calls")).alias("tool_calls"), string(v, "tool_call_id").alias("tool_call_id"), F.to_json(v).alias("raw_json"))


def blocks_of(messages: DataFrame) -> DataFrame:
    """The content blocks of canonical messages; a string is one block of type str, numbered -1; what is neither a string
    nor a list with blocks is one of type other, which passes as it is."""
    none = F.lit(None).cast("string")
    is_text = F.col("kind") == "str"
    frame = with_field(F.col("raw_json"), "content", F.lit("null"))
    some = F.coalesce((F.col("kind") == "blocks") & (F.size(F.from_json("content", "array<variant>")) > 0), F.lit(False))
    plain = messages.where(~some).select(
        "request_id", "msg_idx", F.lit(-1).alias("blk_idx"), "role", F.when(is_text, "str").otherwise("other").alias("type"), F.when(is_text, F.col("content")).alias("text"), none.alias("tool_id"), none.alias("tool_name"),
        none.alias("input_json"), none.alias("tr_text"), none.alias("tr_json"), F.when(~is_text, F.col("raw_json")).alias("raw_json"), F.when(is_text, frame).alias("msg_json"),
    )
    each = messages.where(some).select("request_id", "msg_idx", "role", frame.alias("msg_json"), F.posexplode(F.from_json("content", "array<variant>")).alias("blk_idx", "v"))
    v = F.col("v")
    result = F.when(string(v, "type") == "tool_result", inner(v, "content"))
    shaped = F.when(kind_of(result) != "str", F.to_json(result))
    listed = each.select(
        "request_id", "msg_idx", "blk_idx", "role", F.coalesce(string(v, "type"), F.lit("other")).alias("type"), string(v, "text").alias("text"), F.coalesce(string(v, "id"), string(v, "tool_use_id")).alias("tool_id"), string(v, "name").alias("tool_name"),
        F.to_json(inner(v, "input")).alias("input_json"), F.when(kind_of(result) == "str", F.try_variant_get(v, "$.content", "string")).otherwise(flat_text(shaped)).alias("tr_text"), shaped.alias("tr_json"), F.to_json(v).alias("raw_json"), "msg_json",
    )
    return plain.unionByName(listed).select(BLOCKS)


def systems_of(requests: DataFrame) -> DataFrame:
    """request_id, blk_idx (-1 for a string), text (null where there is none), raw_json: the system prompt's blocks."""
    v = F.from_json("body", "system variant")["system"]
    d = requests.select("request_id", v.alias("v")).where("v is not null")
    none = F.lit(None).cast("string")
    whole = d.where(kind_of(F.col("v")) != "blocks").select("request_id", F.lit(-1).alias("blk_idx"), F.when(kind_of(F.col("v")) == "str", F.try_variant_get("v", "$", "string")).alias("text"), F.when(kind_of(F.col("v")) != "str", F.to_json("v")).alias("raw_json"))
    each = d.where(kind_of(F.col("v")) == "blocks").select("request_id", F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("blk_idx", "v"))
    v = F.col("v")
    text = F.when(F.schema_of_variant(v) == "STRING", none).when(string(v, "type") == "text", string(v, "text"))
    return whole.unionByName(each.select("request_id", "blk_idx", text.alias("text"), F.to_json(v).alias("raw_json")))


def tools_of(requests: DataFrame) -> DataFrame:
    """request_id, tool_idx, name, description, schema_json (null where they aren't there), raw_json."""
    v = F.col("v")
    d = requests.select("request_id", F.posexplode(F.from_json("body", "tools array<variant>")["tools"]).alias("tool_idx", "v"))
    return d.select("request_id", "tool_idx", string(v, "name").alias("name"), string(v, "description").alias("description"), F.to_json(inner(v, "input_schema")).alias("schema_json"), F.to_json(v).alias("raw_json"))


def differs(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def block_json() -> Column:
    """A block as JSON: as it was but for the one field that a stage changed; made from its columns if it is new."""
    raw, v = F.col("raw_json"), F.try_parse_json("raw_json")
    text = F.to_json(F.named_struct(F.lit("type"), F.lit("text"), F.lit("text"), F.col("text")))
    result = F.to_json(F.named_struct(F.lit("type"), F.lit("tool_result"), F.lit("tool_use_id"), F.col("tool_id"), F.lit("content"), F.col("tr_text")))
    use = F.concat(F.lit('{"type":"tool_use","id":'), quoted(F.col("tool_id")), F.lit(',"name":'), quoted(F.col("tool_name")), F.lit(',"input":'), F.coalesce("input_json", F.lit("{}")), F.lit("}"))
    made = F.when(F.col("type") == "text", text).when(F.col("type") == "tool_result", result).when(F.col("type") == "tool_use", use)
    new_text = (F.col("type") == "text") & differs(F.col("text"), string(v, "text"))
    old_result = F.when(F.col("tr_json").isNull(), string(v, "content")).otherwise(flat_text(F.col("tr_json")))
    new_result = (F.col("type") == "tool_result") & differs(F.col("tr_text"), old_result)
    # A result keeps its shape: a list stays a list, of one text block.
    content = F.when(F.col("tr_json").isNull(), quoted(F.col("tr_text"))).otherwise(F.to_json(F.array(F.named_struct(F.lit("type"), F.lit("text"), F.lit("text"), F.col("tr_text")))))
    return F.when(raw.isNull(), made).when(new_text, with_field(raw, "text", quoted(F.col("text")))).when(new_result, with_field(raw, "content", content)).otherwise(raw)


def message_json(blocks: DataFrame) -> DataFrame:
    """request_id, msg_idx, m: messages as JSON."""
    part = F.when(F.col("type") == "str", quoted(F.col("text"))).otherwise(block_json())
    m = blocks.withColumn("part", part).groupBy("request_id", "msg_idx").agg(F.first("role", True).alias("role"), F.first("type").alias("t"), F.min("blk_idx").alias("place"), F.first("msg_json", True).alias("frame"), F.array_sort(F.collect_list(F.struct("blk_idx", "part"))).alias("parts"))
    joined = F.array_join(F.transform("parts", lambda p: p["part"]), ",")
    content = F.when(F.col("place") == -1, joined).otherwise(F.concat(F.lit("["), joined, F.lit("]")))
    new = F.concat(F.lit('{"role":'), F.coalesce(quoted(F.col("role")), F.lit("null")), F.lit(',"content":'), content, F.lit("}"))
    whole = (F.col("t") == "other") & (F.col("place") == -1)
    return m.select("request_id", "msg_idx", F.when(whole, joined).when(F.col("frame").isNull(), new).otherwise(with_field(F.col("frame"), "content", content)).alias("m"))


def in_list(rows: DataFrame, place: str, json: Column, name: str) -> DataFrame:
    """request_id and the JSON list of its rows in order."""
    return rows.select("request_id", place, json.alias("j")).groupBy("request_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, "j"))), lambda x: x["j"]), ",").alias("js")).select("request_id", F.concat(F.lit("["), "js", F.lit("]")).alias(name))


def system_json(systems: DataFrame) -> DataFrame:
    """request_id, system: what systems_of() took apart, with the texts as they are now."""
    raw = F.col("raw_json")
    same = F.col("text").eqNullSafe(string(F.try_parse_json("raw_json"), "text"))
    one = F.when(raw.isNull(), quoted(F.col("text"))).when(F.col("text").isNull() | same, raw).otherwise(with_field(raw, "text", quoted(F.col("text"))))
    g = systems.select("request_id", "blk_idx", one.alias("j")).groupBy("request_id").agg(F.min("blk_idx").alias("place"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("blk_idx", "j"))), lambda x: x["j"]), ",").alias("js"))
    return g.select("request_id", F.when(F.col("place") == -1, F.col("js")).otherwise(F.concat(F.lit("["), "js", F.lit("]"))).alias("system"))


def tool_json() -> Column:
    """A tool definition with the description and schema that it has now."""
    raw, v = F.col("raw_json"), F.try_parse_json("raw_json")
    described = F.when(differs(F.col("description"), string(v, "description")), with_field(raw, "description", quoted(F.col("description")))).otherwise(raw)
    return F.when(differs(F.col("schema_json"), F.to_json(inner(v, "input_schema"))), with_field(described, "input_schema", F.col("schema_json"))).otherwise(described)


def body_of(requests: DataFrame, blocks: DataFrame, systems: DataFrame | None = None, tools: DataFrame | None = None) -> DataFrame:
    """request_id and body: the bodies with their messages, and systems and tools where given, rebuilt from their tables;
    all else stays. A body that is no JSON object stays as it is."""
    d = requests.select("request_id", "body").join(in_list(message_json(blocks), "msg_idx", F.col("m"), "messages"), "request_id", "left")
    parts = ["messages"]
    if systems is not None:
        d, parts = d.join(system_json(systems), "request_id", "left"), [*parts, "system"]
    if tools is not None:
        d, parts = d.join(in_list(tools, "tool_idx", tool_json(), "tools"), "request_id", "left"), [*parts, "tools"]
    fields = F.from_json("body", FIELDS)
    # A list that lost all its rows is empty; one that was none stays what it was.
    was_list = lambda k: F.schema_of_variant(F.try_element_at(fields, F.lit(k))).startswith("ARRAY")
    new = {k: F.coalesce(F.parse_json(k), F.when(was_list(k), F.parse_json(F.lit("[]"))) if k == "messages" else F.lit(None)) for k in parts}
    changed = F.transform_values(fields, lambda k, v: F.coalesce(*(F.when(k == n, x) for n, x in new.items()), v))
    return d.select("request_id", F.coalesce(F.to_json(changed), F.col("body")).alias("body"))
