"""Catalogues of model presets and sizing by memory, as small constant tables and joins with candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Candidate contexts and batch sizes, factors and floors of the sizing rule.
CONTEXTS, BATCHES = [16384, 32768, 65536, 100000, 131072, 200000, 262144], [1024, 512]
LOADED, FLOOR_GB, BATCH_GB = 1.05, 0.4, 0.00084


def recommend(models: DataFrame, keep_free_gb: float = 1.0) -> DataFrame:
    """models (model_id, vram_gb, size_gb, kv_bytes, native_ctx) with ctx, ub, offload, est_total_gb, margin_gb: the
    largest context that fits, then the largest batch. The candidates are a constant array, so nothing is shuffled."""
    candidates = F.array(*(F.struct(F.lit(c).alias("ctx"), F.lit(u).alias("ub")) for c in CONTEXTS for u in BATCHES))
    weights = F.col("size_gb") * LOADED
    free = F.col("vram_gb") - weights - (FLOOR_GB + keep_free_gb)
    needs = lambda x: x["ctx"].cast("double") * F.col("kv_bytes") / float(1 << 30) + x["ub"] * BATCH_GB
    fits = F.filter(candidates, lambda x: (x["ctx"] <= F.col("native_ctx")) & (needs(x) <= F.col("free")))
    best = F.coalesce(F.array_max(fits), F.struct(F.lit(16384).alias("ctx"), F.lit(512).alias("ub")))
    m = models.withColumn("weights", weights).withColumn("free", free).withColumn("best", best)
    fit = F.col("free") > 0
    total = F.col("weights") + F.lit(FLOOR_GB) + needs(F.col("best"))
    chosen = lambda yes, no: F.when(fit, yes).otherwise(no)
    return m.select(
        *models.columns, F.round("weights", 2).alias("weights_gb"), chosen(F.col("best")["ctx"], F.lit(8192)).alias("ctx"), chosen(F.col("best")["ub"], F.lit(512)).alias("ub"), fit.alias("offload"),
        chosen(F.round(total, 2), F.round("weights", 2)).alias("est_total_gb"), chosen(F.round(F.col("vram_gb") - total, 2), F.lit(0.0)).alias("margin_gb"),
    )


def effective_context(ctx: Column, reduction_pct: Column) -> Column:
    return F.floor(ctx / (1 - reduction_pct / 100)).cast("long")


def best_for_tier(sized: DataFrame) -> DataFrame:
    """The model of the largest effective context in each tier, the first by model_id among equals."""
    row = F.struct(*(F.col(c) for c in sized.columns))
    return sized.groupBy("tier_gb").agg(F.max_by(row, F.struct("effective_ctx", -F.col("model_id"))).alias("r")).select("r.*")


def models(spark: SparkSession, rows: list[tuple[int, str, float, float, int, int]]) -> DataFrame:
    return spark.createDataFrame(rows, "model_id int, name string, vram_gb double, size_gb double, kv_bytes int, native_ctx int")


def presets_by_tier(models: DataFrame) -> DataFrame:
    """tier_gb and its models in order of model_id."""
    return models.groupBy(F.col("vram_gb").alias("tier_gb")).agg(F.transform(F.array_sort(F.collect_list(F.struct("model_id", "name"))), lambda m: m["name"]).alias("names"))


def with_reduction(models: DataFrame, measured: DataFrame) -> DataFrame:
    """models with one measurement (a row tokens_in, tokens_out, reduction_pct) on each row."""
    return models.join(F.broadcast(measured.limit(1)))


def server_command(path: Column, port: int = 8080, alias: str = "tarnmill") -> Column:
    """The command line of an inference server for a sized model (ctx, ub, offload). Fixed flags and their order."""
    base = F.format_string("llama-server -m %s -c %d -ngl 999 -fa on -ctk q4_0 -ctv q4_0 -np 1 -b 2048 -ub %d --alias %s --host 127.0.0.1 --port %d --kv-unified", path, F.col("ctx"), F.col("ub"), F.lit(alias), F.lit(port))
    return F.concat(base, F.when(F.col("offload"), "").otherwise(" --no-kv-offload"))


def environment(prefix: str = "TARNMILL_") -> Column:
    """The same choice as export lines."""
    number = lambda c: F.col(c).cast("string")
    rows = {"CTX": number("ctx"), "UB": number("ub"), "NGL": F.lit("999"), "FA": F.lit("on"), "CTK": F.lit("q4_0"), "CTV": F.lit("q4_0"), "NP": F.lit("1"), "KV_OFFLOAD": F.col("offload").cast("int").cast("string")}
    return F.concat_ws("\n", *(F.concat(F.lit(f"export {prefix}{k}="), v) for k, v in rows.items()))


def report(path: Column) -> Column:
    """A sized model as lines of text."""
    gb = lambda c, sign="": F.format_string(f"%{sign}.2f GB", F.col(c))
    return F.concat_ws(
        "\n", F.lit("recommended server arguments"), F.format_string("memory:  %.1f GB", F.col("vram_gb")), F.concat(F.lit("model:   "), F.coalesce(F.nullif(path, F.lit("")), F.lit("(size only)"))), F.concat(F.lit("weights: "), gb("weights_gb")),
        F.concat(F.lit("total:   "), gb("est_total_gb"), F.lit(" (margin "), gb("margin_gb", "+"), F.lit(")")), server_command(path), environment(), F.lit("an estimate: check the memory under a real prompt"),
    )
