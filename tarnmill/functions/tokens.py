"""Token accounting: a native estimate of four characters a token, and exact counts by a tokenizer's vocabulary, which run
in Python over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: What a message, an image and a tool definition add.
MESSAGE, IMAGE, TOOL = 4, 8, 8


def estimate(c: Column) -> Column:
    """Tokens of a text: none if empty or null, else a quarter of its characters, at least one."""
    n = F.coalesce(F.length(c), F.lit(0))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("long")


def estimate_at_least_one(c: Column) -> Column:
    """The memory pruner's count, one for an empty text too."""
    return F.greatest(F.lit(1), F.floor(F.coalesce(F.length(c), F.lit(0)) / 4)).cast("long")


def estimate_bytes(c: Column) -> Column:
    """The estimate by bytes; no bytes, no tokens."""
    n = F.coalesce(F.octet_length(c), F.lit(0))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("long")


@lru_cache(4)
def encoder(vocabulary: str):
    """A function from texts to their numbers of tokens; one for each Python worker."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    t.no_truncation()
    t.no_padding()
    return lambda texts: [len(x.ids) for x in t.encode_batch(texts, add_special_tokens=False)]


def exact(vocabulary: str | None) -> Callable[[Column], Column]:
    """The count by a tokenizer file, or the estimate where there is none. Texts or bytes; null and empty ones have none."""
    if vocabulary is None:
        return estimate

    @F.pandas_udf(LongType())
    def run(texts: pd.Series) -> pd.Series:
        given = [x.decode("utf-8", "replace") if isinstance(x, (bytes, bytearray)) else x or "" for x in texts]
        return pd.Series(encoder(vocabulary)(given), index=texts.index, dtype="int64")

    return run


def of_json(c: Column) -> Column:
    """Tokens of a serialised value, by its bytes."""
    return F.greatest(F.lit(1), F.floor(F.coalesce(F.octet_length(c), F.lit(0)) / 4)).cast("long")


def of_list(content: Column) -> Column:
    """Tokens of a result's list of blocks, given as JSON: texts each by itself, images, and other blocks by their JSON."""
    field = lambda v, key: F.try_variant_get(v, f"$.{key}", "string")

    def one(v: Column) -> Column:
        rough = F.floor(F.octet_length(F.to_json(v)) / 4).cast("long")
        loose = F.when(F.schema_of_variant(v) == "STRING", F.floor(F.length(F.try_variant_get(v, "$", "string")) / 4).cast("long"))
        return F.coalesce(F.when(field(v, "type") == "text", estimate(field(v, "text"))).when(field(v, "type") == "image", F.lit(IMAGE).cast("long")), loose, rough)

    return F.aggregate(F.transform(F.from_json(content, "array<variant>"), one), F.lit(0).cast("long"), lambda a, x: a + x)


def of_block(kind: Column, text: Column, result: Column, payload: Column, raw: Column, listed: Column | None = None) -> Column:
    """Tokens of a content block by its type; listed: a result's list of blocks as JSON, where that is what it has."""
    of_result = estimate(result) if listed is None else F.when(listed.isNotNull(), of_list(listed)).otherwise(estimate(result))
    return F.when(kind.isin("text", "str"), estimate(text)).when(kind == "tool_result", of_result).when(kind == "tool_use", of_json(payload)).when(kind == "image", F.lit(IMAGE).cast("long")).otherwise(F.floor(F.coalesce(F.octet_length(raw), F.lit(4)) / 4).cast("long"))


def char_threshold(budget: int) -> int:
    return int(budget * 4 * 0.85)


def per_message(messages: DataFrame, tokens: Column | None = None) -> DataFrame:
    """messages with tok, each one's tokens with its frame."""
    return messages.withColumn("tok", (estimate(F.col("text")) if tokens is None else tokens) + MESSAGE)


def prefix_sums(messages: DataFrame, *more: str) -> DataFrame:
    """messages with prefix (tokens before it), total and n of its request; one exchange by request."""
    w = Window.partitionBy("request_id")
    before = w.orderBy("msg_idx").rowsBetween(Window.unboundedPreceding, -1)
    return messages.withColumn("prefix", F.coalesce(F.sum("tok").over(before), F.lit(0))).withColumn("total", F.sum("tok").over(w)).withColumn("n", F.count("*").over(w))


def of_tool(description: Column, schema: Column) -> Column:
    return estimate(description) + of_json(schema) + TOOL
