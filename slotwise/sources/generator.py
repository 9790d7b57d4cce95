"""Generated samples: a pattern over sample numbers, as rows or as requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.functions.patterns import raw_value
from slotwise.functions.values import JSON_TYPES, from_raw


def generate(spark: SparkSession, series_id: int, count: int = 100, pattern: str = "sine", storage: str = "float32", start_ms: int = 0, quality: int = 192, step_ms: int = 1000) -> DataFrame:
    """series_id, ts_ms, value, quality, tx, pos of ``count`` samples."""
    i = F.col("id")
    return spark.range(count).select(
        F.lit(series_id).cast("long").alias("series_id"), (F.lit(start_ms) + i * step_ms).cast("long").alias("ts_ms"), from_raw(raw_value(pattern, i), storage).alias("value"),
        F.lit(quality).alias("quality"), F.lit(0).cast("long").alias("tx"), i.cast("int").alias("pos"),
    )


def as_requests(rows: DataFrame, storage: str, size: int = 10_000) -> DataFrame:
    """Generated rows as JSON-ready requests of at most ``size`` samples."""
    tag = {name: t for t, name in JSON_TYPES.items()}[storage]
    parts = rows.groupBy("series_id", F.floor(F.col("pos") / size).alias("part")).agg(F.array_sort(F.collect_list(F.struct("ts_ms", "quality", "value"))).alias("s"))
    return parts.select(F.col("series_id").alias("series"), F.col("s.ts_ms").alias("ts"), F.col("s.quality").alias("qs"), F.lit(tag).alias("type"), F.col("s.value").alias("values"))
