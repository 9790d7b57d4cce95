"""The driver's tables as series: each event type is a series of one-minute
samples in blocks of a day, the event's property k decides its quality, and the
event id is the order of arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotwise.operators import catalog, ingest

SAMPLE_MS, BLOCK_MS, SLOTS = 60_000, 86_400_000, 1440
#: A range that starts and ends inside blocks.
LOW_MS, HIGH_MS = 1_704_500_000_000, 1_706_280_000_000
ZONES = ("America/Santiago", "Australia/Sydney", "UTC")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def numbered_types(rows: DataFrame) -> DataFrame:
    """event_type and its series id; the window runs over the distinct types."""
    return rows.select("event_type").distinct().withColumn("series_id", F.row_number().over(Window.orderBy("event_type")).cast("long"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placed samples of the events, one row an event."""
    rows = events(spark, sf_dir)
    k = F.get_json_object("props", "$.k").cast("int")
    quality = F.when(k < 5, 0).when(k < 15, 64).when(k < 20, 128).otherwise(192)
    ts = F.unix_millis(F.col("ts").cast("timestamp"))
    named = rows.join(numbered_types(rows), "event_type")
    return ingest.placed(named.select("series_id", ts.alias("ts_ms"), "value", quality.alias("quality"), F.col("event_id").alias("tx"), F.lit(0).alias("pos")), BLOCK_MS, SAMPLE_MS)


def slots(spark: SparkSession, sf_dir: str, by_block: bool = False) -> DataFrame:
    return ingest.last_writes(samples(spark, sf_dir), by_block)


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog of the five series, with labels unit, kind and zone."""
    zone = F.element_at(F.array(*(F.lit(z) for z in ZONES)), (F.col("series_id") % 3 + 1).cast("int"))
    unit = F.when(F.col("series_id") > 3, "eur").otherwise("usd")
    pairs = F.array(*(F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in (("zone", zone), ("unit", F.lit("usd")), ("kind", F.col("event_type")), ("unit", unit))))
    return numbered_types(events(spark, sf_dir)).select(
        "series_id", F.concat(F.lit("events_"), "event_type").alias("name"), F.lit("float64").alias("storage_type"), F.lit(24).cast("long").alias("block_len"), F.lit("h").alias("block_res"),
        F.lit(1).cast("long").alias("sample_len"), F.lit("min").alias("sample_res"), catalog.normalized_labels(pairs.cast(catalog.LABELS)).alias("labels"),
        unit.alias("unit"), F.when(F.col("series_id") != 2, F.col("series_id").cast("double")).alias("low"), (F.lit(60.0) - 5 * F.col("series_id")).alias("high"), F.when(F.col("series_id") > 2, "gzip").alias("codec"),
    )


#: The same in DuckDB: common table expressions that the oracles start with.
SQL_SAMPLES = """
    WITH smp AS (
        SELECT series_id, ts_ms, ts_ms // 86400000 AS block_id, CAST(ts_ms % 86400000 // 60000 AS INTEGER) AS slot, value,
               CAST(CASE WHEN k < 5 THEN 0 WHEN k < 15 THEN 64 WHEN k < 20 THEN 128 ELSE 192 END AS INTEGER) AS quality, tx, 0 AS pos
        FROM (SELECT dense_rank() OVER (ORDER BY event_type) AS series_id, epoch_us(ts) // 1000 AS ts_ms, value,
                     CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_id AS tx FROM events))
"""
SQL_SLOTS = SQL_SAMPLES + """,
    slt AS (
        SELECT series_id, block_id, slot, arg_max(value, tx) AS value, arg_max(quality, tx) AS quality, max(tx) AS tx, 0 AS pos
        FROM smp GROUP BY ALL)
""".replace("GROUP BY ALL", "GROUP BY series_id, block_id, slot")
SQL_SUMMARY = SQL_SLOTS + """,
    sm AS (
        SELECT series_id, block_id,
               count(*) FILTER (quality & 192 <> 128) AS count_non_missing, count(*) FILTER (quality & 64 = 64) AS count_valid,
               sum(value) FILTER (quality & 64 = 64) AS sum_val,
               min(value) FILTER (quality & 64 = 64) AS min_val, max(value) FILTER (quality & 64 = 64) AS max_val,
               {edges},
               CAST(bit_or(flag) | CASE WHEN count(*) < 1440 THEN 8 ELSE 0 END AS INTEGER) AS qual_acc_or,
               CAST(bit_and(flag) & CASE WHEN count(*) < 1440 THEN 8 ELSE 15 END AS INTEGER) AS qual_acc_and
        FROM (SELECT *, CASE quality & 192 WHEN 192 THEN 1 WHEN 0 THEN 2 WHEN 64 THEN 4 ELSE 8 END AS flag FROM slt)
        GROUP BY series_id, block_id)
""".replace("{edges}", ", ".join(
    f"arg_{f}({c}, slot) FILTER ({kept}) AS {name}_{short}"
    for name, f, kept in (("fst_valid", "min", "quality & 64 = 64"), ("lst_valid", "max", "quality & 64 = 64"), ("fst", "min", "quality & 192 <> 128"), ("lst", "max", "quality & 192 <> 128"))
    for c, short in (("value", "val"), ("quality", "q"), ("slot", "offset"))
))
SQL_SERIES = """
    WITH srs AS (
        SELECT series_id, 'events_' || event_type AS name, event_type,
               CASE series_id % 3 WHEN 0 THEN 'America/Santiago' WHEN 1 THEN 'Australia/Sydney' ELSE 'UTC' END AS zone,
               CASE WHEN series_id > 3 THEN 'eur' ELSE 'usd' END AS unit
        FROM (SELECT event_type, row_number() OVER (ORDER BY event_type) AS series_id FROM (SELECT DISTINCT event_type FROM events)))
"""
