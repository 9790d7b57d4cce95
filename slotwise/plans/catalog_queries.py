"""Registered queries of the grid engine and the DuckDB SQL they must equal."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.functions import grid, quality, values
from slotwise.operators import blocks, catalog, ingest, ranges
from slotwise.plans.fixtures import BLOCK_MS, HIGH_MS, LOW_MS, SAMPLE_MS, SLOTS, SQL_SAMPLES, SQL_SERIES, SQL_SLOTS, SQL_SUMMARY, samples, series, slots
from slotwise.sources import generator, store, wal
from slotwise.streaming import ingest as stream

QUERIES: dict = {}
ORACLES: dict = {}

SUMMARY = ("count_non_missing", "count_valid", "sum_val", "min_val", "max_val")
SUMMARY_SQL = "count_non_missing, count_valid, round(sum_val, 6) AS sum_val, min_val, max_val"
EDGE_FIELDS = tuple(f"{e}_{f}" for e in blocks.EDGES for f in ("val", "q", "offset"))


def _shown(rows: DataFrame) -> DataFrame:
    """Sums of floats as they are compared: the last bits of a double depend on
    the order of addition, so six decimals are shown."""
    return rows.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in ("sum_val", "avg_val", "total") if c in rows.columns})


def registered(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.summaries(slots(spark, sf_dir, by_block=True), SLOTS)


# ---- grid

@registered(SQL_SAMPLES + "SELECT tx, series_id, block_id, slot, block_id * 86400000 AS block_start_ms FROM smp")
def block_id_slot(spark, sf_dir):
    return samples(spark, sf_dir).select("tx", "series_id", "block_id", "slot", grid.block_start_ms(F.col("block_id"), BLOCK_MS).alias("block_start_ms"))


@registered(SQL_SAMPLES + "SELECT tx, block_id * 86400000 + slot * 60000 AS slot_ms, epoch_ms(make_timestamp((block_id * 86400000 + slot * 60000) * 1000)) // 3600000 AS slot_hour FROM smp")
def slot_timestamp(spark, sf_dir):
    at = grid.slot_timestamp(F.col("block_id"), F.col("slot"), BLOCK_MS, SAMPLE_MS)
    return samples(spark, sf_dir).select("tx", grid.slot_ts_ms(F.col("block_id"), F.col("slot"), BLOCK_MS, SAMPLE_MS).alias("slot_ms"), grid.whole(F.unix_millis(at), 3_600_000).alias("slot_hour"))


SAMPLE_LENGTHS = [1, 5, 10, 100, 250, 1000, 5000, 7000, 10_000, 15_000, 30_000, 60_000, 300_000, 420_000, 900_000, 3_600_000, 7_200_000]


@registered(
    "WITH d AS (SELECT unnest([" + ", ".join(map(str, SAMPLE_LENGTHS)) + "]::BIGINT[]) AS sample_ms), "
    "t AS (SELECT sample_ms, sample_ms * 1024 AS ms FROM d), "
    "u AS (SELECT *, CASE WHEN ms >= 3600000 THEN 3600000 WHEN ms >= 60000 THEN 60000 WHEN ms >= 1000 THEN 1000 ELSE 1 END AS unit FROM t), "
    "f AS (SELECT *, ms // unit * unit AS low FROM u), "
    "b AS (SELECT unnest([" + ", ".join(map(str, grid.BUCKET_MS)) + "]::BIGINT[]) AS bucket), "
    "r AS (SELECT sample_ms, coalesce((SELECT min(bucket) FROM b WHERE bucket >= low), low) AS block_ms FROM f) "
    "SELECT sample_ms, block_ms, (block_ms + sample_ms - 1) // sample_ms AS slots, block_ms % sample_ms AS rest_ms FROM r"
)
def derive_block_size(spark, sf_dir):
    rows = spark.createDataFrame([(n,) for n in SAMPLE_LENGTHS], "sample_ms long").withColumn("block_ms", grid.derived_block_ms(F.col("sample_ms")))
    return rows.select("sample_ms", "block_ms", grid.block_slots(F.col("block_ms"), F.col("sample_ms")).alias("slots"), (F.col("block_ms") % F.col("sample_ms")).alias("rest_ms"))


DURATIONS = [(1, "h"), (60, "min"), (3600, "s"), (3_600_000, "ms"), (90, "s"), (2, "min"), (1, "ms")]


@registered(
    "WITH d(length, unit) AS (VALUES " + ", ".join(f"(CAST({n} AS BIGINT), '{u}')" for n, u in DURATIONS) + "), "
    "m AS (SELECT *, length * CAST(CASE unit WHEN 'ms' THEN 1 WHEN 's' THEN 1000 WHEN 'min' THEN 60000 ELSE 3600000 END AS BIGINT) AS ms FROM d) "
    "SELECT length, unit, ms, ms = 3600000 AS is_hour, ms < 3600000 AS is_shorter FROM m"
)
def duration_units(spark, sf_dir):
    ms = grid.duration_ms(F.col("length"), F.col("unit"))
    return spark.createDataFrame(DURATIONS, "length long, unit string").select("length", "unit", ms.alias("ms"), (ms == 3_600_000).alias("is_hour"), (ms < 3_600_000).alias("is_shorter"))


# ---- quality

BYTES = "WITH b AS (SELECT CAST(range AS INTEGER) AS q FROM range(256)), c AS (SELECT q, q & 192 AS major, lpad(bin(q), 8, '0') AS bits FROM b) "


@registered(BYTES + "SELECT q, CASE major WHEN 192 THEN 'good' WHEN 64 THEN 'uncertain' WHEN 0 THEN 'bad' ELSE 'missing' END AS class, CAST(CASE major WHEN 192 THEN 1 WHEN 0 THEN 2 WHEN 64 THEN 4 ELSE 8 END AS INTEGER) AS flag, q & 64 = 64 AS valid, major <> 128 AS present FROM c")
def quality_class(spark, sf_dir):
    q = F.col("q")
    return spark.range(256).select(F.col("id").cast("int").alias("q")).select("q", quality.class_name(q).alias("class"), quality.flag(q).alias("flag"), quality.is_valid(q).alias("valid"), quality.is_present(q).alias("present"))


@registered(BYTES + ", f AS (SELECT q, major, bits[1:2] || '_' || bits[3:6] || '_' || bits[7:8] AS text FROM c) SELECT q, text AS bits, CASE major WHEN 192 THEN 'Good' WHEN 64 THEN 'Uncertain' WHEN 0 THEN 'Bad ' || text ELSE 'MISSING' END AS name, CAST(q // 4 % 16 AS INTEGER) AS sub_status, CAST(q % 4 AS INTEGER) AS limit_bits FROM f")
def quality_bits(spark, sf_dir):
    q = F.col("q")
    return spark.range(256).select(F.col("id").cast("int").alias("q")).select("q", quality.bits(q).alias("bits"), quality.debug_name(q).alias("name"), quality.sub_status(q).alias("sub_status"), quality.limit(q).alias("limit_bits"))


@registered("SELECT CAST(range AS INTEGER) AS mask, trim(regexp_replace(lpad(bin(range), 32, '0'), '(.{4})', '\\1 ', 'g')) AS bits FROM range(16)")
def mask_bits_grouped(spark, sf_dir):
    return spark.range(16).select(F.col("id").cast("int").alias("mask"), quality.grouped_bits(F.col("id")).alias("bits"))


@registered(SQL_SAMPLES + "SELECT series_id, count(*) AS samples, count(*) FILTER (quality & 64 = 64) AS valid, count(*) FILTER (quality & 192 = 0) AS bad, count(*) FILTER (quality & 192 = 128) AS missing FROM smp GROUP BY series_id")
def valid_samples(spark, sf_dir):
    q = F.col("quality")
    return samples(spark, sf_dir).groupBy("series_id").agg(F.count("*").alias("samples"), F.count_if(quality.is_valid(q)).alias("valid"), F.count_if(quality.is_class(q, quality.BAD)).alias("bad"), F.count_if(quality.is_missing(q)).alias("missing"))


# ---- write side

@registered(SQL_SLOTS + "SELECT series_id, block_id, slot, value, quality, tx FROM slt")
def lww_dedup(spark, sf_dir):
    return slots(spark, sf_dir).drop("pos")


@registered(SQL_SAMPLES + "SELECT series_id, tx // 100 AS tx, block_id, count(*) AS samples, min(ts_ms) AS first_ts_ms, max(ts_ms) AS last_ts_ms FROM smp GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY series_id, tx // 100, block_id"))
def batch_split_counts(spark, sf_dir):
    return ingest.split_counts(samples(spark, sf_dir).withColumn("tx", grid.whole(F.col("tx"), 100)))


@registered(SQL_SAMPLES + ", late AS (SELECT series_id, block_id, slot, value + 1 AS value, quality, tx + 1000000 AS tx FROM smp WHERE tx % 7 = 0), every AS (SELECT series_id, block_id, slot, value, quality, tx FROM smp UNION ALL SELECT * FROM late) SELECT series_id, block_id, slot, arg_max(value, tx) AS value, arg_max(quality, tx) AS quality, max(tx) AS tx FROM every GROUP BY series_id, block_id, slot")
def backfill_merge(spark, sf_dir):
    rows = samples(spark, sf_dir)
    late = rows.where(F.col("tx") % 7 == 0).withColumns({"value": F.col("value") + 1, "tx": F.col("tx") + 1_000_000})
    return ingest.merged(slots(spark, sf_dir), late).drop("pos")


@registered(SQL_SLOTS + ", gone AS (SELECT series_id, block_id, slot, value, CASE WHEN slot % 10 = 0 THEN 128 ELSE quality END AS quality FROM slt) SELECT series_id, block_id, count(*) FILTER (quality & 192 <> 128) AS count_non_missing, count(*) FILTER (quality & 64 = 64) AS count_valid FROM gone GROUP BY series_id, block_id")
def backfill_delete(spark, sf_dir):
    stored = slots(spark, sf_dir)
    deletes = stored.where(F.col("slot") % 10 == 0).withColumns({"quality": F.lit(quality.MISSING), "tx": F.col("tx") + 1_000_000})
    rows = ingest.merged(stored, deletes)
    return blocks.summaries(rows, SLOTS).select("series_id", "block_id", "count_non_missing", "count_valid")


@registered(SQL_SAMPLES + "SELECT series_id, block_id, slot, tx, lead(tx) OVER (PARTITION BY series_id, block_id, slot ORDER BY tx) IS NOT NULL AS is_overwritten FROM smp")
def overwritten_samples(spark, sf_dir):
    return ingest.with_overwritten(samples(spark, sf_dir)).select("series_id", "block_id", "slot", "tx", "is_overwritten")


ARRIVAL = "(tx * 7919) % 1000003 // 10"  # a mixed order of arrival, in batches of about ten


@registered(SQL_SAMPLES + f", p AS (SELECT DISTINCT series_id, {ARRIVAL} AS batch, block_id FROM smp), r AS (SELECT *, max(block_id) OVER (PARTITION BY series_id ORDER BY batch, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS live_block FROM p) SELECT series_id, batch, block_id, coalesce(live_block, -1) AS live_block, CASE WHEN live_block IS NULL THEN 'start' WHEN block_id = live_block THEN 'append' WHEN block_id > live_block THEN 'rotate' ELSE 'cold' END AS route FROM r")
def hot_cold_route(spark, sf_dir):
    parts = ingest.split_counts(samples(spark, sf_dir).withColumn("tx", grid.whole(F.col("tx") * 7919 % 1_000_003, 10)))
    routed = ingest.routed(parts.select("series_id", "tx", "block_id"))
    return routed.withColumnRenamed("tx", "batch").withColumn("live_block", F.coalesce("live_block", F.lit(-1).cast("long")))


LOG = "SELECT CASE WHEN tx % 3 = 0 THEN 'FLUSH' ELSE 'WRITE' END AS tag, CASE WHEN tx % 3 = 0 THEN tx + 1 ELSE tx END AS tx, series_id, block_id FROM smp"


def _log(spark, sf_dir):
    """Every third event is a flush mark of the next one's transaction."""
    flush = F.col("tx") % 3 == 0
    return samples(spark, sf_dir).select(F.when(flush, "FLUSH").otherwise("WRITE").alias("tag"), F.when(flush, F.col("tx") + 1).otherwise(F.col("tx")).alias("tx"), "series_id", "block_id", "slot", "value", "quality", "pos")


@registered(SQL_SAMPLES + f", log AS ({LOG}) SELECT tx, series_id, block_id FROM log WHERE tag = 'WRITE' AND tx NOT IN (SELECT tx FROM log WHERE tag = 'FLUSH')")
def wal_pending(spark, sf_dir):
    return ingest.pending(_log(spark, sf_dir)).select("tx", "series_id", "block_id")


@registered(SQL_SAMPLES + f", log AS ({LOG}), w AS (SELECT * FROM smp WHERE tx % 3 <> 0) SELECT series_id, block_id, slot, arg_max(value, tx) AS value, max(tx) AS tx FROM w GROUP BY series_id, block_id, slot")
def wal_replay(spark, sf_dir):
    log = _log(spark, sf_dir)
    writes, waiting = log.where("tag = 'WRITE'"), ingest.pending(log)
    stored = ingest.last_writes(writes.join(waiting.select("tx"), "tx", "left_anti"))
    return ingest.merged(stored, waiting).select("series_id", "block_id", "slot", "value", "tx")


# ---- summaries and blocks

@registered(SQL_SUMMARY + f"SELECT series_id, block_id, {SUMMARY_SQL} FROM sm")
def block_summary(spark, sf_dir):
    return _shown(_summaries(spark, sf_dir).select("series_id", "block_id", *SUMMARY))


@registered(SQL_SUMMARY + f"SELECT series_id, block_id, {', '.join(EDGE_FIELDS)} FROM sm")
def block_first_last(spark, sf_dir):
    return _summaries(spark, sf_dir).select("series_id", "block_id", *EDGE_FIELDS)


@registered(SQL_SUMMARY + "SELECT series_id, block_id, qual_acc_or, qual_acc_and FROM sm")
def block_quality_masks(spark, sf_dir):
    return _summaries(spark, sf_dir).select("series_id", "block_id", "qual_acc_or", "qual_acc_and")


WORSE = "CASE WHEN (series_id + ts_ms // 86400000) % 3 = 0 THEN 0 WHEN (series_id + ts_ms // 86400000) % 7 = 0 THEN 128 WHEN k < 5"


@registered(SQL_SUMMARY.replace("CASE WHEN k < 5", WORSE) + "SELECT series_id, block_id, count_valid, round(coalesce(sum_val, 0), 6) AS sum_val, coalesce(min_val, 0) AS min_val, coalesce(max_val, 0) AS max_val, coalesce(fst_valid_val, 0) AS fst_valid_val, coalesce(fst_valid_q, 128) AS fst_valid_q, coalesce(CAST(fst_valid_offset AS BIGINT), 4294967295) AS fst_valid_offset, coalesce(CAST(lst_valid_offset AS BIGINT), 0) AS lst_valid_offset FROM sm")
def block_summary_compat(spark, sf_dir):
    # all samples of some blocks are bad, and of others missing
    day = F.col("series_id") + F.col("block_id")
    worse = F.when(day % 3 == 0, quality.BAD).when(day % 7 == 0, quality.MISSING).otherwise(F.col("quality"))
    rows = ingest.last_writes(samples(spark, sf_dir).withColumn("quality", worse))
    fields = ("sum_val", "min_val", "max_val", "fst_valid_val", "fst_valid_q", "fst_valid_offset", "lst_valid_offset")
    return _shown(blocks.compat(blocks.summaries(rows, SLOTS)).select("series_id", "block_id", "count_valid", *fields))


FINE = "sum(value / 7) FILTER (quality & 64 = 64)"


@registered(SQL_SLOTS + f"SELECT series_id, block_id, round({FINE}, 6) AS sum_fine, min(value / 7) FILTER (quality & 64 = 64) AS min_fine, round(sum(value * 1e296) FILTER (quality & 64 = 64) / 1e296, 6) AS sum_large, round(sum(value / 1000) FILTER (quality & 64 = 64) * 1000, 6) AS sum_small FROM slt GROUP BY series_id, block_id")
def block_summary_scales(spark, sf_dir):
    """Sums of values with many decimals, of very large and of small ones."""
    rows = slots(spark, sf_dir, by_block=True)
    of = lambda value, name: blocks.summaries(rows.withColumn("value", value), SLOTS).select("series_id", "block_id", F.col("sum_val").alias(f"sum_{name}"), F.col("min_val").alias(f"min_{name}"))
    found = of(F.col("value") / 7, "fine").join(of(F.col("value") * 1e296, "large"), ["series_id", "block_id"]).join(of(F.col("value") / 1000, "small"), ["series_id", "block_id"])
    return found.select("series_id", "block_id", F.round("sum_fine", 6).alias("sum_fine"), "min_fine", F.round(F.col("sum_large") / 1e296, 6).alias("sum_large"), F.round(F.col("sum_small") * 1000, 6).alias("sum_small"))


@registered(SQL_SLOTS + ", b AS (SELECT DISTINCT series_id, block_id FROM slt), g AS (SELECT series_id, block_id, CAST(unnest(range(1440)) AS INTEGER) AS slot FROM b) SELECT g.series_id, g.block_id, g.slot, coalesce(value, 0) AS value, coalesce(quality, 128) AS quality FROM g LEFT JOIN slt ON g.series_id = slt.series_id AND g.block_id = slt.block_id AND g.slot = slt.slot")
def densify_block(spark, sf_dir):
    rows = slots(spark, sf_dir)
    return blocks.densified(rows, SLOTS)


BLOCK = LOW_MS // BLOCK_MS + 3


@registered(SQL_SLOTS + f", g AS (SELECT CAST(range AS INTEGER) AS slot FROM range(1440)), b AS (SELECT * FROM slt WHERE series_id = 2 AND block_id = {BLOCK}), d AS (SELECT g.slot, coalesce(value, 0) AS value, coalesce(quality, 128) AS quality FROM g LEFT JOIN b ON g.slot = b.slot) SELECT CAST(2 AS BIGINT) AS series_id, CAST({BLOCK} AS BIGINT) AS block_id, CAST(count(*) AS INTEGER) AS slots, count(*) FILTER (quality = 128) AS absent, round(sum(value), 6) AS total FROM d HAVING (SELECT count(*) FROM b) > 0")
def read_single_block(spark, sf_dir):
    dense = blocks.read_block(slots(spark, sf_dir), 2, BLOCK, SLOTS)
    absent = F.size(F.filter("qualities", lambda q: q == quality.MISSING)).cast("long")
    total = F.aggregate("values", F.lit(0.0), lambda s, v: s + v)
    return _shown(dense.select("series_id", "block_id", F.size("values").alias("slots"), absent.alias("absent"), total.alias("total")))


@registered(SQL_SUMMARY + f", g AS (SELECT CAST(range AS INTEGER) AS slot FROM range(1440)), d AS (SELECT sm.series_id, sm.block_id, count(slt.slot) FILTER (slt.quality <> 128) AS held, round(sum(coalesce(slt.value, 0)), 6) AS total FROM sm CROSS JOIN g LEFT JOIN slt ON slt.series_id = sm.series_id AND slt.block_id = sm.block_id AND slt.slot = g.slot WHERE sm.block_id = {LOW_MS // BLOCK_MS + 3} GROUP BY sm.series_id, sm.block_id) SELECT series_id, block_id, 'F64Block' AS name, count_valid, lst_offset, CAST(1440 AS INTEGER) AS n_values, 1440 - held AS absent, total FROM d JOIN sm USING (series_id, block_id)")
def block_response(spark, sf_dir):
    """The JSON response of the blocks of a day, read back."""
    rows = slots(spark, sf_dir).where(F.col("block_id") == BLOCK)
    text = blocks.block_json(blocks.summaries(rows, SLOTS), blocks.dense_arrays(rows, SLOTS), series(spark, sf_dir))
    at = lambda path: F.get_json_object("block", f"$.F64Block{path}")
    numbers, marks = F.from_json(at("[1]"), "array<double>"), F.from_json(at("[2]"), "array<int>")
    name = F.regexp_extract("block", '^\\{"([A-Z0-9a-z]+)"', 1)
    read = text.select("series_id", "block_id", name.alias("name"), at("[0].count_valid").cast("long").alias("count_valid"), at("[0].lst_offset").cast("int").alias("lst_offset"), numbers.alias("numbers"), marks.alias("marks"))
    absent = F.size(F.filter("marks", lambda q: q == quality.MISSING)).cast("long")
    return _shown(read.select("series_id", "block_id", "name", "count_valid", "lst_offset", F.size("numbers").alias("n_values"), absent.alias("absent"), F.aggregate("numbers", F.lit(0.0), lambda s, v: s + v).alias("total")))


@registered(SQL_SLOTS + "SELECT series_id, block_id // 3 AS segment, count(DISTINCT block_id) AS blocks, count(*) AS samples, min(block_id) AS first_block FROM slt GROUP BY series_id, block_id // 3")
def segment_layout(spark, sf_dir):
    """Segments of three blocks, as the store lays them out."""
    rows = store.with_segment(slots(spark, sf_dir), 3)
    return rows.groupBy("series_id", "segment").agg(F.count_distinct("block_id").alias("blocks"), F.count("*").alias("samples"), F.min("block_id").alias("first_block"))


FIRST_BLOCK, LAST_BLOCK = LOW_MS // BLOCK_MS, HIGH_MS // BLOCK_MS


@registered(SQL_SUMMARY + f"SELECT series_id, block_id, count_valid FROM sm WHERE series_id = 3 AND block_id BETWEEN {FIRST_BLOCK} AND {LAST_BLOCK} ORDER BY block_id")
def block_list_in_range(spark, sf_dir):
    return ranges.in_range(_summaries(spark, sf_dir), 3, FIRST_BLOCK, LAST_BLOCK).select("series_id", "block_id", "count_valid")


@registered(SQL_SUMMARY + f"SELECT series_id, block_id, {SUMMARY_SQL} FROM sm WHERE series_id = 4 AND block_id = {BLOCK}")
def block_meta_get(spark, sf_dir):
    return _shown(ranges.one(_summaries(spark, sf_dir), 4, BLOCK).select("series_id", "block_id", *SUMMARY))


@registered(SQL_SUMMARY + "SELECT 'data/' || series_id % 100 || '/' || series_id || '/' || block_id || '_0.blk' AS object_key FROM sm")
def object_key_project(spark, sf_dir):
    keys = slots(spark, sf_dir).select("series_id", "block_id").distinct()
    return keys.select(blocks.object_key(F.col("series_id"), F.col("block_id"), F.lit(0)).alias("object_key"))


def _versions(spark, sf_dir):
    """A version of each block for every batch of 1,000 events that wrote it."""
    rows = samples(spark, sf_dir).withColumn("version", grid.whole(F.col("tx"), 1000))
    return rows.groupBy("series_id", "block_id", "version").agg(F.count("*").alias("samples")).withColumn("object_key", blocks.object_key(F.col("series_id"), F.col("block_id"), F.col("version")))


VERSIONS = SQL_SAMPLES + ", v AS (SELECT series_id, block_id, tx // 1000 AS version, count(*) AS samples, 'data/' || series_id % 100 || '/' || series_id || '/' || block_id || '_' || tx // 1000 || '.blk' AS object_key FROM smp GROUP BY series_id, block_id, tx // 1000) "


@registered(VERSIONS + "SELECT series_id, block_id, max(version) AS version, arg_max(samples, version) AS samples, arg_max(object_key, version) AS object_key FROM v GROUP BY series_id, block_id")
def block_upsert(spark, sf_dir):
    versions = _versions(spark, sf_dir)
    return blocks.upserted(versions.where("version % 2 = 0"), versions.where("version % 2 = 1"))


@registered(VERSIONS + "SELECT series_id, block_id, version, object_key, lag(object_key) OVER w AS previous_key, lead(version) OVER w IS NULL AS is_current FROM v WINDOW w AS (PARTITION BY series_id, block_id ORDER BY version)")
def version_chain(spark, sf_dir):
    return blocks.version_chain(_versions(spark, sf_dir)).drop("samples")


@registered(SQL_SLOTS + ", h AS (SELECT * FROM slt ORDER BY series_id, block_id, slot LIMIT 10) SELECT series_id, block_id, slot, value, lpad(bin(quality), 8, '0')[1:2] || '_' || lpad(bin(quality), 8, '0')[3:6] || '_' || lpad(bin(quality), 8, '0')[7:8] AS quality_bits, CASE quality WHEN 192 THEN 'Good' WHEN 64 THEN 'Uncertain' WHEN 0 THEN 'Bad 00_0000_00' ELSE 'MISSING' END AS quality_name FROM h")
def block_head(spark, sf_dir):
    return blocks.head(slots(spark, sf_dir))


# ---- ranges

RANGE = SQL_SLOTS + f""", r AS (SELECT *, block_id * {BLOCK_MS} + slot * {SAMPLE_MS} AS tms FROM slt WHERE block_id * {BLOCK_MS} + slot * {SAMPLE_MS} >= {LOW_MS} AND block_id * {BLOCK_MS} + slot * {SAMPLE_MS} < {HIGH_MS})
    SELECT series_id, count(*) FILTER (quality & 192 <> 128) AS count_non_missing, count(*) FILTER (quality & 64 = 64) AS count_valid,
           round(sum(value) FILTER (quality & 64 = 64), 6) AS sum_val, min(value) FILTER (quality & 64 = 64) AS min_val, max(value) FILTER (quality & 64 = 64) AS max_val,
           arg_min(value, tms) FILTER (quality & 64 = 64) AS fst_valid_val, min(tms) FILTER (quality & 64 = 64) AS fst_valid_ts, arg_max(value, tms) FILTER (quality & 64 = 64) AS lst_valid_val, max(tms) FILTER (quality & 64 = 64) AS lst_valid_ts,
           arg_min(quality, tms) FILTER (quality & 192 <> 128) AS fst_q, min(tms) FILTER (quality & 192 <> 128) AS fst_ts, arg_max(quality, tms) FILTER (quality & 192 <> 128) AS lst_q, max(tms) FILTER (quality & 192 <> 128) AS lst_ts
    FROM r GROUP BY series_id"""
RANGE_FIELDS = ("series_id", *SUMMARY, "fst_valid_val", "fst_valid_ts", "lst_valid_val", "lst_valid_ts", "fst_q", "fst_ts", "lst_q", "lst_ts")


@registered(RANGE)
def range_agg_full(spark, sf_dir):
    return ranges.aggregate(slots(spark, sf_dir), LOW_MS, HIGH_MS, BLOCK_MS, SAMPLE_MS).transform(_shown).select(*RANGE_FIELDS)


@registered(RANGE)
def range_agg_from_summaries(spark, sf_dir):
    rows = slots(spark, sf_dir)
    return ranges.aggregate_from_summaries(blocks.summaries(rows, SLOTS), rows, LOW_MS, HIGH_MS, BLOCK_MS, SAMPLE_MS).transform(_shown).select(*RANGE_FIELDS)


@registered(f"WITH r AS ({RANGE}) SELECT series_id, round(sum_val / count_valid, 6) AS avg_val FROM r")
def range_avg(spark, sf_dir):
    return _shown(ranges.aggregate(slots(spark, sf_dir), LOW_MS, HIGH_MS, BLOCK_MS, SAMPLE_MS).select("series_id", "avg_val"))


ZONED = "CASE series_id % 3 WHEN 0 THEN 'America/Santiago' WHEN 1 THEN 'Australia/Sydney' ELSE 'UTC' END"


@registered(SQL_SLOTS + f", l AS (SELECT series_id, value, CAST(hour(timezone({ZONED}, timezone('UTC', make_timestamp((block_id * {BLOCK_MS} + slot * {SAMPLE_MS}) * 1000)))) AS INTEGER) AS local_hour FROM slt WHERE quality & 64 = 64) SELECT series_id, local_hour, count(*) AS samples, round(sum(value), 6) AS total, round(avg(value), 6) AS avg_val FROM l GROUP BY series_id, local_hour")
def local_hour_avg(spark, sf_dir):
    return _shown(ranges.by_local_hour(slots(spark, sf_dir), series(spark, sf_dir), BLOCK_MS, SAMPLE_MS))


@registered(SQL_SLOTS + ", v AS (SELECT * FROM slt WHERE quality & 64 = 64) SELECT a.block_id, a.slot, a.value AS left_val, b.value AS right_val FROM v a JOIN v b ON a.block_id = b.block_id AND a.slot = b.slot WHERE a.series_id = 1 AND b.series_id = 5")
def series_align_join(spark, sf_dir):
    return ranges.aligned(slots(spark, sf_dir), 1, 5)


@registered(SQL_SLOTS + ", l AS (SELECT *, CASE WHEN series_id <> 2 THEN series_id END AS low, 60 - 5 * series_id AS high, CASE WHEN series_id > 3 THEN 'eur' ELSE 'usd' END AS unit FROM slt WHERE quality & 64 = 64) SELECT series_id, block_id, slot, value, unit, CASE WHEN value < low THEN 'low' ELSE 'high' END AS breach FROM l WHERE value < low OR value > high")
def limit_breaches(spark, sf_dir):
    return ranges.limit_flags(slots(spark, sf_dir), series(spark, sf_dir)).select("series_id", "block_id", "slot", "value", "unit", "breach")


@registered(SQL_SLOTS + """, v AS (SELECT *, list(value) OVER w AS run, max(slot) OVER w AS last FROM slt WHERE series_id = 5 AND quality & 64 = 64
    WINDOW w AS (PARTITION BY series_id, block_id ORDER BY slot ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING))
    SELECT series_id, block_id, slot, round(sqrt((run[1] - 10) * (run[1] - 10) + (run[2] - 20) * (run[2] - 20)), 9) AS distance FROM v WHERE len(run) = 2 AND last - slot = 1""")
def pattern_match(spark, sf_dir):
    found = ranges.pattern_distances(slots(spark, sf_dir), 5, [10.0, 20.0], BLOCK_MS, SAMPLE_MS)
    return found.withColumn("distance", F.round("distance", 9))


BITS = "trim(regexp_replace(lpad(bin(qual_acc_or), 32, '0'), '(.{4})', '\\1 ', 'g'))"


@registered(SQL_SUMMARY + f", h AS (SELECT * FROM slt WHERE series_id = 4 AND block_id = {BLOCK} ORDER BY slot LIMIT 10) SELECT sm.series_id, sm.block_id, count_valid, {BITS} AS or_bits, slot, value, CASE quality WHEN 192 THEN 'Good' WHEN 64 THEN 'Uncertain' WHEN 0 THEN 'Bad 00_0000_00' ELSE 'MISSING' END AS quality_name FROM sm JOIN h ON sm.series_id = h.series_id AND sm.block_id = h.block_id")
def inspect_block(spark, sf_dir):
    rows = slots(spark, sf_dir)
    summary, head = blocks.inspected(blocks.summaries(rows, SLOTS), rows, 4, BLOCK)
    shown = summary.select("series_id", "block_id", "count_valid", F.col("qual_acc_or_bits").alias("or_bits"))
    return shown.join(head.drop("quality_bits"), ["series_id", "block_id"])


# ---- catalog

SERIES_TEXT = ("series_id", "name", "labels_text")


def _text(rows: DataFrame) -> DataFrame:
    return rows.withColumn("labels_text", F.array_join(F.transform("labels", lambda x: F.concat(x["name"], F.lit("="), x["value"])), ",")).select(*SERIES_TEXT)


LABELS_SQL = "'kind=' || event_type || ',unit=' || unit || ',zone=' || zone AS labels_text"


@registered(SQL_SERIES + f"SELECT series_id, name, {LABELS_SQL} FROM srs")
def series_scan(spark, sf_dir):
    return _text(catalog.scan(series(spark, sf_dir)))


@registered(SQL_SERIES + f"SELECT series_id, name, {LABELS_SQL} FROM srs WHERE series_id = 3")
def series_get(spark, sf_dir):
    return _text(catalog.get(series(spark, sf_dir), 3))


REQUESTS = [
    (1, "temp_1", "float32", 1, "s", None, None, [("b", "1"), ("a", "1"), ("a", "2")]),
    (2, "1temp", "float32", 1, "s", None, None, []),
    (3, "flow", "int64", 7, "s", 1, "h", []),
    (4, "bad_block", "int64", 1, "h", 30, "min", []),
    (5, "level", "uint32", 1, "min", 12, None, [("z", "9")]),
    (6, "temp\n", "float64", 1, "s", None, None, []),
    (7, "mode", "enumeration", 250, "ms", None, None, []),
    (8, "odd", "text", 1, "s", None, None, []),
    (9, "json_names", "UInt32", 2, "Second", 1, "Hour", [("k", "v")]),
    (10, "no_sample", "float64", 0, "s", None, None, []),
]
REQUEST_SCHEMA = f"request int, name string, storage_type string, sample_len long, sample_res string, block_len long, block_res string, labels {catalog.LABELS}"




def _sql(x) -> str:
    """A field of a request in SQL: labels as name=value, joined by commas."""
    if isinstance(x, list):
        return _sql(",".join(f"{n}={v}" for n, v in x))
    return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("\n", "' || chr(10) || '") + "'"


def _unit_sql(column: str) -> str:
    return f"CASE WHEN {column} IN ('ms', 'Millisecond') THEN 1 WHEN {column} IN ('s', 'Second') THEN 1000 WHEN {column} IN ('min', 'Minute') THEN 60000 WHEN {column} IN ('h', 'Hour') THEN 3600000 END"


STORAGE_SQL = ", ".join(f"'{n}', '{j}'" for j, n in values.JSON_STORAGE.items())
#: The requests judged by the rules in SQL: judged(request, ..., sample_ms, given_ms, reason) and texts(request, t).
JUDGED = (
    SQL_SERIES + ", req(request, name, storage_type, sample_len, sample_res, block_len, block_res, labels) AS (VALUES " + ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in REQUESTS) + "), "
    f"dur AS (SELECT *, CAST(sample_len * {_unit_sql('sample_res')} AS BIGINT) AS sample_ms, CAST(block_len * {_unit_sql('block_res')} AS BIGINT) AS given_ms FROM req), "
    f"judged AS (SELECT *, CASE WHEN NOT regexp_full_match(name, '[A-Za-z][A-Za-z0-9_]*') THEN 'bad name' WHEN storage_type NOT IN ({STORAGE_SQL}) THEN 'unknown storage type' WHEN coalesce(sample_ms, 0) <= 0 THEN 'bad sample duration' WHEN given_ms <= sample_ms THEN 'block not longer than a sample' END AS reason FROM dur), "
    "lab AS (SELECT request, unnest(string_split(labels, ',')) AS x, generate_subscripts(string_split(labels, ','), 1) AS place FROM req WHERE labels <> ''), "
    "last AS (SELECT request, split_part(x, '=', 1) AS n, arg_max(split_part(x, '=', 2), place) AS v FROM lab GROUP BY 1, 2), "
    "texts AS (SELECT request, string_agg(n || '=' || v, ',' ORDER BY n) AS t FROM last GROUP BY request) "
)


@registered(
    JUDGED + ", t AS (SELECT *, sample_ms * 1024 AS ms FROM judged WHERE reason IS NULL), "
    "u AS (SELECT *, ms // (CASE WHEN ms >= 3600000 THEN 3600000 WHEN ms >= 60000 THEN 60000 WHEN ms >= 1000 THEN 1000 ELSE 1 END) * (CASE WHEN ms >= 3600000 THEN 3600000 WHEN ms >= 60000 THEN 60000 WHEN ms >= 1000 THEN 1000 ELSE 1 END) AS low FROM t), "
    "b AS (SELECT unnest([" + ", ".join(map(str, grid.BUCKET_MS)) + "]::BIGINT[]) AS bucket) "
    "SELECT series_id, name, CAST(86400000 AS BIGINT) AS block_ms, " + LABELS_SQL + " FROM srs UNION ALL "
    "SELECT (SELECT max(series_id) FROM srs) + row_number() OVER (ORDER BY u.request), name, coalesce(given_ms, (SELECT min(bucket) FROM b WHERE bucket >= low), low), coalesce(t, '') FROM u LEFT JOIN texts ON u.request = texts.request"
)
def series_create(spark, sf_dir):
    made, _ = catalog.create(series(spark, sf_dir), spark.createDataFrame(REQUESTS, REQUEST_SCHEMA))
    ms = made.withColumn("block_ms", grid.duration_ms(F.col("block_len"), F.col("block_res")))
    return _text(made).join(ms.select("series_id", "block_ms"), "series_id").select("series_id", "name", "block_ms", "labels_text")


@registered(JUDGED + "SELECT request, reason FROM judged WHERE reason IS NOT NULL")
def geometry_validate(spark, sf_dir):
    _, refused = catalog.create(series(spark, sf_dir), spark.createDataFrame(REQUESTS, REQUEST_SCHEMA))
    return refused.select("request", "reason")


@registered(SQL_SERIES + f"SELECT series_id, CASE series_id WHEN 2 THEN 'renamed' ELSE name END AS name, CASE series_id WHEN 3 THEN 'a=2,b=1' ELSE {LABELS_SQL.removesuffix(' AS labels_text')} END AS labels_text FROM srs")
def series_update(spark, sf_dir):
    patches = spark.createDataFrame([(2, "renamed", None), (3, None, [("b", "1"), ("a", "1"), ("a", "2")])], f"series_id long, name string, labels {catalog.LABELS}")
    return _text(catalog.update(series(spark, sf_dir), patches))


@registered(SQL_SUMMARY + "SELECT series_id, count(*) AS blocks FROM sm WHERE series_id NOT IN (2, 4) GROUP BY series_id")
def series_delete(spark, sf_dir):
    ids = spark.createDataFrame([(2,), (4,), (99,)], "series_id long")
    left, owned = catalog.delete(series(spark, sf_dir), ids, _summaries(spark, sf_dir))
    return left.join(owned, "series_id").groupBy("series_id").agg(F.count("*").alias("blocks"))


@registered(SQL_SERIES + "SELECT series_id, name FROM srs WHERE zone = 'UTC' OR unit = 'eur'")
def labels_match_any(spark, sf_dir):
    return catalog.match_any(series(spark, sf_dir), [("zone", "UTC"), ("unit", "eur")]).select("series_id", "name")


@registered(SQL_SERIES + "SELECT series_id, name FROM srs WHERE zone = 'UTC' AND unit = 'usd'")
def labels_match_all(spark, sf_dir):
    return catalog.match_all(series(spark, sf_dir), [("unit", "usd"), ("zone", "UTC")]).select("series_id", "name")


@registered("WITH p AS (SELECT event_id, 'l' || event_id % 3 AS n1, 'l' || event_id % 2 AS n2, event_type AS v1, CAST(user_id AS VARCHAR) AS v2 FROM events) SELECT event_id, CASE WHEN n1 = n2 THEN n1 || '=' || v2 WHEN n1 < n2 THEN n1 || '=' || v1 || ',' || n2 || '=' || v2 ELSE n2 || '=' || v2 || ',' || n1 || '=' || v1 END AS labels FROM p")
def labels_normalize(spark, sf_dir):
    label = lambda n, v: F.struct(F.concat(F.lit("l"), (F.col("event_id") % n).cast("string")).alias("name"), F.col(v).cast("string").alias("value"))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", catalog.normalized_labels(F.array(label(3, "event_type"), label(2, "user_id"))).alias("l"))
    return rows.select("event_id", F.array_join(F.transform("l", lambda x: F.concat(x["name"], F.lit("="), x["value"])), ",").alias("labels"))


# ---- ingest

def _requests(spark, sf_dir):
    """A request for each series and fifty events; nine of ten are changed, most
    of them made wrong."""
    rows = samples(spark, sf_dir).withColumn("part", grid.whole(F.col("tx"), 50))
    r = rows.groupBy("series_id", "part").agg(F.array_sort(F.collect_list(F.struct("tx", "ts_ms", "quality", "value"))).alias("s"))
    kind, marks = F.col("part") % 10, F.col("s.quality").cast("array<short>")
    rest = F.slice(marks, 2, 1000)
    none = lambda t: F.array().cast(f"array<{t}>")
    return r.select(
        F.col("part").alias("tx"), F.when(kind == 1, F.col("series_id") + 100).otherwise(F.col("series_id")).alias("series"), F.when(kind == 2, "F32").when(kind == 8, "I32").otherwise("f64").alias("type"),
        F.when(kind == 3, F.reverse(F.col("s.ts_ms"))).when(kind == 6, none("long")).otherwise(F.col("s.ts_ms")).alias("ts"),
        F.when(kind == 4, rest).when(kind == 5, F.concat(F.array(F.lit(300).cast("short")), rest)).when(kind == 6, none("short")).otherwise(marks).alias("qs"),
        F.when(kind == 6, none("double")).when(kind != 7, F.col("s.value")).alias("values"),
    )


REQUEST_SQL = SQL_SAMPLES + """,
    p AS (SELECT series_id, tx // 50 AS part, list(ts_ms ORDER BY tx) AS ts, list(quality ORDER BY tx) AS qs, list(value ORDER BY tx) AS vals FROM smp GROUP BY 1, 2),
    q AS (SELECT part AS tx, CASE WHEN part % 10 = 1 THEN series_id + 100 ELSE series_id END AS series, CASE part % 10 WHEN 2 THEN 'F32' WHEN 8 THEN 'I32' ELSE 'f64' END AS type,
                 CASE part % 10 WHEN 3 THEN list_reverse(ts) WHEN 6 THEN ts[1:0] ELSE ts END AS ts,
                 CASE part % 10 WHEN 4 THEN qs[2:] WHEN 5 THEN list_concat([300], qs[2:]) WHEN 6 THEN qs[1:0] ELSE qs END AS qs,
                 CASE part % 10 WHEN 6 THEN vals[1:0] WHEN 7 THEN NULL ELSE vals END AS vals FROM p),
    j AS (SELECT tx, series, len(ts) AS n,
                 CASE WHEN ts IS NULL OR qs IS NULL OR vals IS NULL THEN 'missing array' WHEN len(ts) <> len(qs) OR len(ts) <> len(vals) THEN 'length mismatch' WHEN len(ts) = 0 THEN 'no timestamps'
                      WHEN len(list_filter(qs, lambda x: x < 0 OR x > 255)) > 0 OR (type = 'I32' AND len(list_filter(vals, lambda x: x <> trunc(x) OR abs(x) > 2147483647)) > 0) THEN 'bad element'
                      WHEN ts <> list_sort(ts) THEN 'timestamps not sorted' WHEN series NOT IN (SELECT series_id FROM smp) THEN 'unknown series' WHEN type <> 'f64' THEN 'type mismatch' END AS reason FROM q)
"""


@registered(REQUEST_SQL + "SELECT tx, series, reason FROM j")
def ingest_validate(spark, sf_dir):
    return ingest.validated(_requests(spark, sf_dir), series(spark, sf_dir)).select("tx", "series", "reason")


@registered(REQUEST_SQL + "SELECT series AS series_id, CAST(sum(n) AS BIGINT) AS samples, count(*) AS requests FROM j WHERE reason IS NULL GROUP BY series")
def ingest_series_lookup(spark, sf_dir):
    good = ingest.validated(_requests(spark, sf_dir), series(spark, sf_dir)).where("reason is null")
    rows = ingest.placed_by_catalog(ingest.samples(good), series(spark, sf_dir))
    return rows.groupBy("series_id").agg(F.count("*").alias("samples"), F.count_distinct("tx").alias("requests"))


@registered(REQUEST_SQL + "SELECT CAST(CASE WHEN reason IS NULL THEN 200 WHEN reason = 'unknown series' THEN 404 WHEN reason IN ('timestamps not sorted', 'no timestamps') THEN 422 ELSE 400 END AS INTEGER) AS status, count(*) AS requests FROM j GROUP BY 1")
def ingest_status(spark, sf_dir):
    judged = ingest.validated(_requests(spark, sf_dir), series(spark, sf_dir))
    return judged.groupBy(ingest.status(F.col("reason")).alias("status")).agg(F.count("*").alias("requests"))


# ---- streams and the log

def _shared(spark: SparkSession) -> str:
    """A new folder that all executors see: under spark.checkpoint.dir. Only a
    local session may do without that setting."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        shared = tempfile.mkdtemp(prefix="slotwise-")
    return f"{shared}/grid-{uuid.uuid4().hex}"


def _stored(rows: DataFrame, folder: str) -> DataFrame:
    """The catalog as a table, which ingest reads in every batch: the fixtures'
    is derived from all events."""
    store.write_table(rows, f"{folder}/catalog")
    return store.read_table(rows.sparkSession, f"{folder}/catalog")


def _block_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each series and block, its samples in order of time."""
    r = samples(spark, sf_dir).groupBy("series_id", "block_id").agg(F.array_sort(F.collect_list(F.struct("ts_ms", "tx", "quality", "value"))).alias("s"))
    return r.select("series_id", "block_id", F.col("s.tx")[0].alias("tx"), F.col("s.ts_ms").alias("ts"), F.col("s.quality").alias("qs"), F.col("s.value").alias("values"))


@registered(SQL_SUMMARY + f"SELECT series_id, block_id, {SUMMARY_SQL} FROM sm")
def stream_ingest(spark, sf_dir):
    folder = _shared(spark)
    _block_requests(spark, sf_dir).select(F.col("series_id").alias("series"), F.lit("F64").alias("type"), "ts", "qs", "values").write.json(f"{folder}/in")
    stream.start(spark, f"{folder}/in", _stored(series(spark, sf_dir), folder), f"{folder}/out", f"{folder}/checkpoint", once=True, files_per_batch=2).awaitTermination()
    return _shown(stream.current_summaries(spark, f"{folder}/out").select("series_id", "block_id", *SUMMARY))


@registered(SQL_SUMMARY + f"SELECT series_id, block_id, {SUMMARY_SQL} FROM sm")
def batch_ingest(spark, sf_dir):
    """JSON request files loaded at once, and again under the same number."""
    folder = _shared(spark)
    _block_requests(spark, sf_dir).select(F.col("series_id").alias("series"), F.lit("f64").alias("type"), "ts", "qs", "values").coalesce(4).write.json(f"{folder}/in")
    known = _stored(series(spark, sf_dir), folder)
    for _ in range(2):
        stream.load(spark, f"{folder}/in", known, f"{folder}/out", 0)
    return _shown(stream.current_summaries(spark, f"{folder}/out").select("series_id", "block_id", *SUMMARY))


WIDE = 9_007_199_254_740_993  # the first whole number that a double can't hold


@registered(SQL_SLOTS + f"SELECT series_id, block_id, CAST(sum(CAST({WIDE} + tx AS HUGEINT)) FILTER (quality & 64 = 64) AS VARCHAR) AS sum_val, CAST(min({WIDE} + tx) FILTER (quality & 64 = 64) AS BIGINT) AS min_val FROM slt GROUP BY series_id, block_id")
def stream_whole_numbers(spark, sf_dir):
    """Series of 64-bit integers beyond the reach of doubles, through JSON."""
    folder = _shared(spark)
    whole = _stored(series(spark, sf_dir).withColumn("storage_type", F.lit("int64")), folder)
    wide = samples(spark, sf_dir).withColumn("value", F.col("tx") + F.lit(WIDE))
    r = wide.groupBy("series_id", "block_id").agg(F.array_sort(F.collect_list(F.struct("ts_ms", "tx", "quality", "value"))).alias("s"))
    r.select(F.col("series_id").alias("series"), F.lit("I64").alias("type"), F.col("s.ts_ms").alias("ts"), F.col("s.quality").alias("qs"), F.col("s.value").alias("values")).write.json(f"{folder}/in")
    stream.start(spark, f"{folder}/in", whole, f"{folder}/out", f"{folder}/checkpoint", once=True).awaitTermination()
    found = stream.current_summaries(spark, f"{folder}/out", "whole")
    return found.select("series_id", "block_id", F.col("sum_val").cast("string").alias("sum_val"), F.col("min_val").cast("long").alias("min_val"))


@registered(SQL_SAMPLES + "SELECT 'WRITE' AS tag, series_id, block_id, min(tx) AS tx, CAST(count(*) AS INTEGER) AS samples FROM smp GROUP BY series_id, block_id")
def wal_frame_scan(spark, sf_dir):
    folder = _shared(spark)
    wal.write(_block_requests(spark, sf_dir).withColumn("tag", F.lit("WRITE")), f"{folder}/log", "float64").write.parquet(f"{folder}/written")
    longs = [F.col(c).cast("long").alias(c) for c in ("series_id", "block_id", "tx")]
    return wal.inspected(wal.read(spark, f"{folder}/log")).select("tag", *longs, "samples")


@registered(SQL_SAMPLES + "SELECT series_id, ts_ms, value, quality FROM smp")
def wal_samples(spark, sf_dir):
    """Every sample through the log and back."""
    folder = _shared(spark)
    wal.write(_block_requests(spark, sf_dir).withColumn("tag", F.lit("WRITE")), f"{folder}/log", "float64").write.parquet(f"{folder}/written")
    return wal.samples(wal.read(spark, f"{folder}/log"), series(spark, sf_dir)).select("series_id", "ts_ms", "value", "quality")


# ---- generator, typed sums

@registered("SELECT range * 1000 AS ts_ms, round(10 * sin(range * 0.1), 9) AS value FROM range(1000)")
def generate_sine(spark, sf_dir):
    return generator.generate(spark, 1, 1000, "sine", "float64").select("ts_ms", F.round("value", 9).alias("value"))


@registered("SELECT range * 1000 AS ts_ms, CAST(42 AS INTEGER) AS value FROM range(1000)")
def generate_constant(spark, sf_dir):
    return generator.generate(spark, 1, 1000, "constant", "int32").select("ts_ms", "value")


@registered("SELECT range * 1000 AS ts_ms, CAST(range % 255 AS SMALLINT) AS value FROM range(1000)")
def generate_ramp(spark, sf_dir):
    return generator.generate(spark, 1, 1000, "ramp", "enumeration").select("ts_ms", "value")


TYPED = {"int32": "CAST(sum(trunc(value - 20)) AS BIGINT)", "int64": "CAST(sum(CAST(trunc(value - 20) AS BIGINT)) AS BIGINT)", "uint32": "CAST(sum(trunc(abs(value - 20))) AS BIGINT)", "uint64": "CAST(sum(trunc(abs(value - 20))) AS BIGINT)", "enumeration": "CAST(sum(trunc(abs(value - 20)) % 255) AS BIGINT)"}


@registered(SQL_SLOTS + "SELECT series_id, round(sum(value), 6) AS sum_float64, " + ", ".join(f"CAST({e} AS VARCHAR) AS sum_{t}" for t, e in TYPED.items()) + " FROM slt WHERE quality & 64 = 64 GROUP BY series_id")
def typed_sums(spark, sf_dir):
    valid = slots(spark, sf_dir).where(quality.is_valid(F.col("quality")))
    raw = F.col("value") - 20
    sums = [F.round(values.exact_sum(F.col("value"), "float64"), 6).alias("sum_float64")]
    sums += [values.exact_sum(values.from_raw(raw, t), t).cast("string").alias(f"sum_{t}") for t in TYPED]
    return valid.groupBy("series_id").agg(*sums)
