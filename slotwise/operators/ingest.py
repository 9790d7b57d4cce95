"""Batch ingest: validation of requests, rows from arrays, the lookup of each
series, placement on the grid and last-write-wins.

A request is a row (tx, series, type, ts, qs, values) with parallel arrays; tx
orders the arrivals. Values are numbers, or their JSON text. Samples are rows (series_id, ts_ms, value, quality, tx,
pos); once placed they have block_id and slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.functions import grid, slices, values
from slotwise.functions.values import storage_of_tag

#: Values are read as the text that stands in the JSON, so that no digit of a 64-bit integer is lost.
REQUEST = "series long, type string, ts array<long>, qs array<short>, values array<string>"
ROUTE_ROWS = 10_000  # parts in a slice of the order of arrival, on average

#: HTTP status of each refusal, here and in the catalog.
STATUS = {
    "missing array": 400, "length mismatch": 400, "type mismatch": 400, "bad element": 400, "no timestamps": 422, "timestamps not sorted": 422, "unknown series": 404, "unknown block": 404,
    "bad name": 400, "unknown storage type": 400, "bad sample duration": 400, "block not longer than a sample": 400, "empty patch": 400,
}


def status(reason: Column) -> Column:
    """HTTP status of a refusal, 200 if there is none."""
    return F.coalesce(F.create_map(*(F.lit(x) for pair in STATUS.items() for x in pair))[reason], F.lit(200))


def sorted_ts(ts: Column) -> Column:
    """Whether timestamps never fall; equal ones may follow each other."""
    return F.forall(F.sequence(F.lit(1), F.greatest(F.size(ts), F.lit(1))), lambda i: (i >= F.size(ts)) | (F.get(ts, i) >= F.get(ts, i - 1)))


def refusal(text: bool = False) -> Column:
    """Why a request is refused, null if it isn't: lengths, times, and values
    that its type can't hold (``text``: values are JSON text)."""
    ts, qs, given = F.col("ts"), F.col("qs"), F.col("values")
    sizes = (F.size(ts) == F.size(qs)) & (F.size(ts) == F.size(given))
    storage = storage_of_tag(F.col("type"))
    bad_value = F.exists(given, lambda v: ~values.fits(v, F.coalesce(storage, F.lit("float64")), text))
    holes = F.exists(ts, lambda t: t.isNull() | (t < 0)) | F.exists(qs, lambda q: q.isNull() | (q < 0) | (q > 255)) | bad_value
    return (
        F.when(ts.isNull() | qs.isNull() | given.isNull(), "missing array")
        .when(~sizes, "length mismatch")
        .when(F.size(ts) == 0, "no timestamps")
        .when(holes, "bad element")
        .when(~sorted_ts(ts), "timestamps not sorted")
    )


def validated(requests: DataFrame, series: DataFrame) -> DataFrame:
    """The requests with ``storage_type`` of their series and ``reason``: that
    of ``refusal``, an unknown series, or values of another type than the
    series'."""
    known = series.select(F.col("series_id").alias("series"), "storage_type")
    rows = requests.join(known, "series", "left").withColumn("reason", refusal(dict(requests.dtypes)["values"] == "array<string>"))
    lookup = F.when(F.col("storage_type").isNull(), "unknown series").when(~F.coalesce(storage_of_tag(F.col("type")) == F.col("storage_type"), F.lit(False)), "type mismatch")
    return rows.withColumn("reason", F.coalesce("reason", lookup))


def samples(requests: DataFrame, kind: str | None = None) -> DataFrame:
    """One row a sample of the accepted requests. With a ``kind`` of
    ``values.KINDS``: of the series of that kind only, in its type."""
    if kind:
        requests = requests.where(values.kind_of(F.col("storage_type")) == kind)
    carried = ["storage_type"] if kind == "real" else []
    rows = requests.select("tx", F.col("series").alias("series_id"), *carried, F.posexplode(F.arrays_zip("ts", "qs", "values")).alias("pos", "s"))
    value = F.col("s.values")
    if kind:
        value = value.cast(values.KINDS[kind])
    if kind == "real":
        value = F.when(F.col("storage_type") == "float32", value.cast("float").cast("double")).otherwise(value)
    return rows.select("series_id", F.col("s.ts").alias("ts_ms"), value.alias("value"), F.col("s.qs").cast("int").alias("quality"), "tx", "pos")


def placed(rows: DataFrame, block_ms: Column | int, sample_ms: Column | int) -> DataFrame:
    ts = F.col("ts_ms")
    return rows.withColumns({"block_id": grid.block_id(ts, block_ms), "slot": grid.slot(ts, block_ms, sample_ms)})


def placed_by_catalog(rows: DataFrame, series: DataFrame) -> DataFrame:
    """Samples on the grids of their series; those of unknown series are left out."""
    geometry = series.select("series_id", grid.duration_ms(F.col("block_len"), F.col("block_res")).alias("block_ms"), grid.duration_ms(F.col("sample_len"), F.col("sample_res")).alias("sample_ms"))
    return placed(rows.join(geometry, "series_id"), F.col("block_ms"), F.col("sample_ms"))


def split_counts(rows: DataFrame) -> DataFrame:
    """The parts that a transaction is split into, one for each block."""
    return rows.groupBy("series_id", "tx", "block_id").agg(F.count("*").alias("samples"), F.min("ts_ms").alias("first_ts_ms"), F.max("ts_ms").alias("last_ts_ms"))


def last_writes(rows: DataFrame, by_block: bool = False) -> DataFrame:
    """Of each slot the write with the largest (tx, pos), value and quality
    deciding ties. Partial aggregation runs before the shuffle, so a slot
    written often costs one row a task. With ``by_block`` the rows are dealt by
    block instead, and a summary of the result needs no further shuffle; that
    is the better plan unless slots are overwritten many times."""
    rows = rows.repartition("series_id", "block_id") if by_block else rows
    last = F.max(F.struct("tx", "pos", "value", "quality"))
    return rows.groupBy("series_id", "block_id", "slot").agg(last.alias("w")).select("series_id", "block_id", "slot", "w.value", "w.quality", "w.tx", "w.pos")


def merged(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Backfill: stored and new placed samples under last-write-wins. Because
    the order lies in (tx, pos), replays and late batches give one result."""
    names = ["series_id", "block_id", "slot", "value", "quality", "tx", "pos"]
    return last_writes(stored.select(names).unionByName(new.select(names)))


def with_overwritten(rows: DataFrame) -> DataFrame:
    """All writes, marked if a later one took their slot."""
    later = Window.partitionBy("series_id", "block_id", "slot").orderBy("tx", "pos")
    return rows.withColumn("is_overwritten", F.lead("tx").over(later).isNotNull())


def routed(parts: DataFrame) -> DataFrame:
    """How each part (series_id, tx, block_id) meets the newest block of its
    series so far: start, append, rotate (newer) or cold (older). The running
    maximum is carried in two levels, within slices of the order of arrival and
    over one row a slice, so a series with very many parts isn't one task."""
    order = ("tx", "block_id")
    rows = parts.withColumn("slice", slices.slice_of(order, slices.cuts(parts, order, ROUTE_ROWS)))
    inside = Window.partitionBy("series_id", "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("series_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy("series_id", "slice").agg(F.max("block_id").alias("top"))
    carried = tops.select("series_id", "slice", F.max("top").over(earlier).alias("carried"))
    live = F.col("live_block")
    route = F.when(live.isNull(), "start").when(F.col("block_id") == live, "append").when(F.col("block_id") > live, "rotate").otherwise("cold")
    near = rows.withColumn("near", F.max("block_id").over(inside)).join(carried, ["series_id", "slice"])
    return near.withColumn("live_block", F.greatest("near", "carried")).withColumn("route", route).select(*parts.columns, "live_block", "route")


def pending(log: DataFrame) -> DataFrame:
    """Writes whose own transaction has no flush mark, whatever the order of
    the log's files."""
    return log.where("tag = 'WRITE'").join(log.where("tag = 'FLUSH'").select("tx"), "tx", "left_anti")
