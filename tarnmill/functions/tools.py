"""Slimming of tool definitions. Only the removal of noise at every depth of a schema runs in Python, over Arrow batches,
as no expression recurses."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tarnmill.functions.text import minify_text, segments, strip

#: Keys that go at every level, sentences that lead in without saying anything.
NOISE = {"$comment", "title", "examples"}
LEAD_INS = [r"(?iU)^\s*Use this(?: tool)? to\b.*?\.\s+", r"(?iU)^\s*This tool\b.*?\.\s+", r"(?iU)^\s*This (?:function|command)\b.*?\.\s+"]
LEAST = 200


def bare(x):
    if isinstance(x, dict):
        return {k: bare(v) for k, v in x.items() if k not in NOISE}
    return [bare(v) for v in x] if isinstance(x, list) else x


def bare_schema(s: str) -> str:
    """A schema's JSON without noise at any depth; what is no JSON stays."""
    try:
        return s and json.dumps(bare(json.loads(s)), ensure_ascii=False, separators=(",", ":"))
    except (ValueError, RecursionError):
        return s


@F.pandas_udf(StringType())
def strip_schema(schemas: pd.Series) -> pd.Series:
    return schemas.map(lambda s: s and bare_schema(s))


def compress_description(c: Column) -> Column:
    def line(x: Column) -> Column:
        new = strip(x)
        for pattern in LEAD_INS:
            new = F.when(new.rlike(pattern), strip(F.regexp_replace(new, pattern, ""))).otherwise(new)
        return F.when((strip(x) == "") | (new == ""), x).otherwise(new)

    cleaned = strip(F.array_join(F.transform(F.split(minify_text(c), "\n", -1), line), "\n"))
    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("seen"))
    first = F.aggregate(segments(cleaned), start, lambda a, s: F.struct(F.when(s["fence"] & a["seen"], a["out"]).otherwise(F.concat(a["out"], s["text"])).alias("out"), (a["seen"] | s["fence"]).alias("seen")), lambda a: a["out"])
    return strip(first)


def slim_description(c: Column) -> Column:
    return F.when(F.length(c) >= LEAST, compress_description(c)).otherwise(c)


def minify_tools(tools: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """tools (name, description, schema_json) made smaller, but for the names to skip."""
    keep = F.col("name").isin(*skip) if skip else F.lit(False)
    return tools.withColumn("description", F.when(keep, F.col("description")).otherwise(slim_description(F.col("description")))).withColumn("schema_json", F.when(keep, F.col("schema_json")).otherwise(strip_schema("schema_json")))
