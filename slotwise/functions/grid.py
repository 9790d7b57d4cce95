"""The fixed time grid: durations, blocks, slots, and derived block sizes.

Timestamps are non-negative epoch milliseconds as long; blocks are aligned to
the epoch.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Milliseconds of each resolution, by catalog text and by JSON name.
UNIT_MS = {"ms": 1, "s": 1000, "min": 60_000, "h": 3_600_000}
JSON_UNITS = {"Millisecond": "ms", "Second": "s", "Minute": "min", "Hour": "h"}

#: The steps that a derived block duration is rounded up to.
BUCKETS = [(1, "s"), (5, "s"), (15, "s"), (30, "s"), (1, "min"), (5, "min"), (15, "min"), (30, "min"), (1, "h"), (2, "h"), (6, "h"), (12, "h"), (24, "h"), (36, "h"), (48, "h"), (72, "h"), (144, "h"), (288, "h"), (576, "h"), (1152, "h")]
BUCKET_MS = [n * UNIT_MS[u] for n, u in BUCKETS]

TARGET_SLOTS = 1024  # samples that a derived block is sized for before rounding


def whole(a: Column, b: Column | int) -> Column:
    """Integer division of longs."""
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def unit_name(unit: Column) -> Column:
    """The catalog text of a resolution that is given by it or by its JSON name."""
    return F.coalesce(F.create_map(*(F.lit(x) for pair in JSON_UNITS.items() for x in pair))[unit], unit)


def unit_ms(unit: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in UNIT_MS.items() for x in pair))[unit_name(unit)].cast("long")


def duration_ms(length: Column, unit: Column) -> Column:
    return length.cast("long") * unit_ms(unit)


def block_id(ts_ms: Column, block_ms: Column | int) -> Column:
    return whole(ts_ms, block_ms)


def slot(ts_ms: Column, block_ms: Column | int, sample_ms: Column | int) -> Column:
    return whole(ts_ms % block_ms, sample_ms).cast("int")


def block_start_ms(block: Column, block_ms: Column | int) -> Column:
    return block * block_ms


def block_slots(block_ms: Column | int, sample_ms: Column | int) -> Column:
    """Slots of a block; a partial slot at the end counts."""
    block_ms = F.lit(block_ms) if isinstance(block_ms, int) else block_ms
    return whole(block_ms + sample_ms - 1, sample_ms)


def slot_ts_ms(block: Column, at: Column, block_ms: Column | int, sample_ms: Column | int) -> Column:
    return block * block_ms + at.cast("long") * sample_ms


def slot_timestamp(block: Column, at: Column, block_ms: Column | int, sample_ms: Column | int) -> Column:
    return F.timestamp_millis(slot_ts_ms(block, at, block_ms, sample_ms))


def segment_blocks(block_slots: int, width: int, target_bytes: int = 128 * 2**20) -> int:
    """Blocks in a segment, so that a segment of full blocks has about the
    target size before compression (a value and a quality byte a sample)."""
    return max(1, target_bytes // (block_slots * (width + 1)))


def segment_id(block: Column, blocks_each: Column | int) -> Column:
    """Segments are runs of blocks aligned to the epoch, like blocks of samples,
    so a late block never moves another one to a different segment."""
    return whole(block, blocks_each)


def derived_block_ms(sample_ms: Column) -> Column:
    """Block duration for a sample duration: the target number of slots, in
    whole units of the largest fitting resolution, rounded up to a bucket; what
    lies over the largest bucket stays."""
    target = sample_ms * TARGET_SLOTS
    unit = F.lit(1)
    for ms in sorted(UNIT_MS.values())[1:]:
        unit = F.when(target >= ms, F.lit(ms)).otherwise(unit)
    floor = whole(target, unit.cast("long")) * unit
    return F.coalesce(F.get(F.filter(F.array(*(F.lit(b).cast("long") for b in BUCKET_MS)), lambda b: b >= floor), F.lit(0)), floor)
