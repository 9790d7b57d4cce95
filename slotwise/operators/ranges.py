"""Range queries over blocks: listing, and aggregation from summaries.

A range is answered from the summaries of the blocks that lie wholly inside it
and from the samples of the (at most two) blocks at its edges. Summaries fold:
counts and sums add, extremes take extremes, first and last go by (block,
offset), and masks combine bitwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.functions import grid, values
from slotwise.operators import blocks

FOLDED = ("count_non_missing", "count_valid", "sum_val", "min_val", "max_val")


def in_range(table: DataFrame, series_id: int, low: int, high: int) -> DataFrame:
    """Blocks of a series from low to high, both included, in order."""
    return table.where((F.col("series_id") == series_id) & F.col("block_id").between(low, high)).orderBy("block_id")


def one(table: DataFrame, series_id: int, block_id: int) -> DataFrame:
    return table.where((F.col("series_id") == series_id) & (F.col("block_id") == block_id)).limit(1)


def _edge(name: str, f) -> Column:
    ts = F.col(f"{name}_ts")
    return f(F.when(ts.isNotNull(), F.struct(F.col(f"{name}_val").alias("val"), F.col(f"{name}_q").alias("q"), ts.alias("ts"))), ts)


def folded(parts: DataFrame) -> DataFrame:
    """One row a series from partial rows: summaries, or edges of blocks."""
    total = values.total_of(dict(parts.dtypes)["sum_val"])
    rows = parts.groupBy("series_id").agg(
        F.sum("count_non_missing").alias("count_non_missing"), F.sum("count_valid").alias("count_valid"), F.sum("sum_val").cast(total).alias("sum_val"), F.min("min_val").alias("min_val"), F.max("max_val").alias("max_val"),
        _edge("fst_valid", F.min_by).alias("fst_valid"), _edge("lst_valid", F.max_by).alias("lst_valid"), _edge("fst", F.min_by).alias("fst"), _edge("lst", F.max_by).alias("lst"),
    )
    edges = [F.col(f"{e}.{f}").alias(f"{e}_{f}") for e in blocks.EDGES for f in ("val", "q", "ts")]
    return rows.select("series_id", *FOLDED, *edges, F.try_divide(F.col("sum_val").cast("double"), F.col("count_valid").cast("double")).alias("avg_val"))


def partial(slots: DataFrame, block_ms: int, sample_ms: int) -> DataFrame:
    """Partial rows from samples, one a block."""
    rows = slots.groupBy(*blocks.KEY).agg(*blocks.summary_columns(values.total_of(dict(slots.dtypes)["value"])))
    edges = [F.col(f"{e}.{f}").alias(f"{e}_{f}") for e in blocks.EDGES for f in ("val", "q", "offset")]
    return with_times(rows.select(*blocks.KEY, *FOLDED, *edges), block_ms, sample_ms)


def with_times(summary: DataFrame, block_ms: int, sample_ms: int) -> DataFrame:
    times = {f"{e}_ts": grid.slot_ts_ms(F.col("block_id"), F.col(f"{e}_offset"), block_ms, sample_ms) for e in blocks.EDGES}
    return summary.withColumns(times)


def whole_blocks(low_ms: int, high_ms: int, block_ms: int) -> tuple[int, int]:
    """First and last block inside [low_ms, high_ms); first > last if none is."""
    return -(-low_ms // block_ms), high_ms // block_ms - 1


def aggregate(slots: DataFrame, low_ms: int, high_ms: int, block_ms: int, sample_ms: int) -> DataFrame:
    """Range aggregate over [low_ms, high_ms) by scanning every slot whose time
    lies inside."""
    ts = grid.slot_ts_ms(F.col("block_id"), F.col("slot"), block_ms, sample_ms)
    inside = F.col("block_id").between(low_ms // block_ms, (high_ms - 1) // block_ms) & (ts >= low_ms) & (ts < high_ms)
    return folded(partial(slots.where(inside), block_ms, sample_ms))


def aggregate_from_summaries(summary: DataFrame, slots: DataFrame, low_ms: int, high_ms: int, block_ms: int, sample_ms: int) -> DataFrame:
    """The same result; samples are read for the blocks at the edges only."""
    first, last = whole_blocks(low_ms, high_ms, block_ms)
    edge = {b for b in (low_ms // block_ms, (high_ms - 1) // block_ms) if not first <= b <= last}
    ts = grid.slot_ts_ms(F.col("block_id"), F.col("slot"), block_ms, sample_ms)
    edges = partial(slots.where(F.col("block_id").isin(*sorted(edge)) & (ts >= low_ms) & (ts < high_ms)), block_ms, sample_ms)
    inner = with_times(summary.where(F.col("block_id").between(first, last)), block_ms, sample_ms)
    return folded(inner.select(edges.columns).unionByName(edges))


def by_local_hour(slots: DataFrame, series: DataFrame, block_ms: int, sample_ms: int) -> DataFrame:
    """Valid samples by hour of day in the time zone of their series (label
    "zone"); UTC if it has none."""
    zone = F.get(F.filter("labels", lambda x: x["name"] == "zone"), F.lit(0))["value"]
    zones = series.select("series_id", F.coalesce(zone, F.lit("UTC")).alias("zone"))
    local = F.from_utc_timestamp(grid.slot_timestamp(F.col("block_id"), F.col("slot"), block_ms, sample_ms), F.col("zone"))
    valid = slots.where(F.col("quality").bitwiseAND(F.lit(64)) == 64).join(zones, "series_id")
    total = values.total_of(dict(slots.dtypes)["value"])
    return valid.groupBy("series_id", F.hour(local).alias("local_hour")).agg(F.count("*").alias("samples"), F.sum(F.col("value").cast(total)).cast(total).alias("total")).withColumn("avg_val", F.col("total").cast("double") / F.col("samples").cast("double"))


def aligned(slots: DataFrame, left: int, right: int) -> DataFrame:
    """Valid samples of two series that share a grid, at their common slots."""
    valid = slots.where(F.col("quality").bitwiseAND(F.lit(64)) == 64)
    a = valid.where(F.col("series_id") == left).select("block_id", "slot", F.col("value").alias("left_val"))
    b = valid.where(F.col("series_id") == right).select("block_id", "slot", F.col("value").alias("right_val"))
    return a.join(b, ["block_id", "slot"])


def limit_flags(slots: DataFrame, series: DataFrame) -> DataFrame:
    """Valid samples outside the limits of their series, with its engineering
    unit; a limit that isn't set holds always."""
    valid = slots.where(F.col("quality").bitwiseAND(F.lit(64)) == 64).join(series.select("series_id", "unit", "low", "high"), "series_id")
    breach = F.when(F.col("value") < F.col("low"), "low").when(F.col("value") > F.col("high"), "high")
    return valid.withColumn("breach", breach).where("breach is not null")


def pattern_distances(slots: DataFrame, series_id: int, pattern: list[float], block_ms: int, sample_ms: int) -> DataFrame:
    """Euclidean distance of a pattern to each run of consecutive valid slots
    within one block; a run with a gap has none. Runs over a block's edge are
    not compared, so a window stays within a block's bounded slots."""
    m = len(pattern)
    run = Window.partitionBy("series_id", "block_id").orderBy("slot").rowsBetween(Window.currentRow, m - 1)
    valid = slots.where((F.col("series_id") == series_id) & (F.col("quality").bitwiseAND(F.lit(64)) == 64))
    rows = valid.withColumns({"run": F.collect_list("value").over(run), "end": F.max("slot").over(run)}).where((F.size("run") == m) & (F.col("end") - F.col("slot") == m - 1))
    wanted = F.array(*(F.lit(float(x)) for x in pattern))
    squares = F.aggregate(F.zip_with("run", wanted, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return rows.select("series_id", "block_id", "slot", F.sqrt(squares).alias("distance"))
