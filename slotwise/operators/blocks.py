"""Block summaries and blocks.

A summary folds the slots of a block into counts, sum, extremes, first and last
values, and quality masks. It is computed from sparse rows; slots without a row
are missing, which only the masks see. Summaries merge: see ``ranges``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.functions import quality, values
from slotwise.operators.errors import RequestError

KEY = ("series_id", "block_id")
FIRST_NONE = 4294967295  # fixed value: offset of a first sample that isn't there
EDGES = ("fst_valid", "lst_valid", "fst", "lst")


def summary_columns(total: str, offset: Column | None = None) -> list[Column]:
    """Aggregates over the slots of a group. ``total`` is the type of the sum,
    see ``values.total_of``."""
    q, slot = F.col("quality").cast("int"), F.col("slot") if offset is None else offset
    present, valid = quality.is_present(q), quality.is_valid(q)
    value = F.when(valid, F.col("value"))
    sample = F.struct(F.col("value").alias("val"), q.alias("q"), slot.alias("offset"))
    edge = lambda f, kept: f(F.when(kept, sample), F.when(kept, slot))
    return [
        F.count_if(present).alias("count_non_missing"),
        F.count_if(valid).alias("count_valid"),
        F.sum(value.cast(total)).cast(total).alias("sum_val"),
        F.min(value).alias("min_val"),
        F.max(value).alias("max_val"),
        edge(F.min_by, valid).alias("fst_valid"),
        edge(F.max_by, valid).alias("lst_valid"),
        edge(F.min_by, present).alias("fst"),
        edge(F.max_by, present).alias("lst"),
        F.bit_or(quality.flag(q)).alias("or_present"),
        F.bit_and(quality.flag(q)).alias("and_present"),
        F.count("*").alias("slots_present"),
    ]


def summaries(slots: DataFrame, block_slots: Column | int) -> DataFrame:
    """One row a block from its last writes: 22 columns, NULL where nothing
    qualifies. Slots without a row count as missing in the masks. Sums are of
    the type that the values' type asks for: exact for integers, double for
    floats."""
    total = values.total_of(dict(slots.dtypes)["value"])
    whole = F.lit(block_slots) if isinstance(block_slots, int) else block_slots
    by_slot = slots.groupBy(*KEY)
    rows = by_slot.agg(*summary_columns(total), F.max(whole).alias("block_slots"))
    full = F.col("slots_present") >= F.col("block_slots")
    missing = F.lit(quality.FLAG_MISSING)
    edges = [F.col(f"{e}.{f}").alias(f"{e}_{f}") for e in EDGES for f in ("val", "q", "offset")]
    return rows.select(
        *KEY, "count_non_missing", "count_valid", "sum_val", "min_val", "max_val", *edges,
        F.when(full, F.col("or_present")).otherwise(F.col("or_present").bitwiseOR(missing)).alias("qual_acc_or"),
        F.when(full, F.col("and_present")).otherwise(F.col("and_present").bitwiseAND(missing)).alias("qual_acc_and"),
    )


def compat(rows: DataFrame) -> DataFrame:
    """Summaries with the sentinels of an empty block instead of NULL."""
    zero = {c: F.coalesce(F.col(c), F.lit(0).cast(t)) for c, t in rows.dtypes if c in ("sum_val", "min_val", "max_val") or c.endswith("_val")}
    q = {c: F.coalesce(F.col(c), F.lit(quality.MISSING)) for c in rows.columns if c.endswith("_q")}
    first = {f"{e}_offset": F.coalesce(F.col(f"{e}_offset").cast("long"), F.lit(FIRST_NONE)) for e in ("fst_valid", "fst")}
    last = {f"{e}_offset": F.coalesce(F.col(f"{e}_offset").cast("long"), F.lit(0)) for e in ("lst_valid", "lst")}
    return rows.withColumns(zero | q | first | last)


def densified(slots: DataFrame, block_slots: int, blocks: DataFrame | None = None) -> DataFrame:
    """Every slot of the blocks that hold slots, and of further given ones;
    absent slots hold 0 and quality missing. Only the sparse rows are shuffled."""
    dense = dense_arrays(slots, block_slots)
    if blocks is not None:
        kind = dict(slots.dtypes)["value"]
        bare = blocks.select(*KEY).distinct().join(dense.select(*KEY), list(KEY), "left_anti")
        nothing = [F.array_repeat(F.lit(0).cast(kind), block_slots).alias("values"), F.array_repeat(F.lit(quality.MISSING), block_slots).alias("qualities")]
        dense = dense.unionByName(bare.select(*KEY, *nothing))
    rows = dense.select(*KEY, F.posexplode(F.arrays_zip("values", "qualities")).alias("slot", "s"))
    return rows.select(*KEY, "slot", F.col("s.values").alias("value"), F.col("s.qualities").alias("quality"))


def read_block(slots: DataFrame, series_id: int, block_id: int, block_slots: int) -> DataFrame:
    """One block as one row with its dense arrays; no row if it isn't stored.
    The filters reach the scan, and prune its partitions."""
    rows = slots.where((F.col("series_id") == series_id) & (F.col("block_id") == block_id))
    return dense_arrays(rows, block_slots)


def dense_arrays(rows: DataFrame, block_slots: int) -> DataFrame:
    """A row a block with value and quality arrays over all its slots; a block
    has a fixed number of slots, so a group is bounded."""
    kind = dict(rows.dtypes)["value"]
    sample = F.struct("slot", F.col("value"), F.col("quality").cast("int").alias("quality"))
    held = rows.groupBy(*KEY).agg(F.collect_list(sample).alias("held"))
    absent = F.array_except(F.sequence(F.lit(0), F.lit(block_slots - 1)), F.col("held.slot"))
    blank = F.transform(absent, lambda i: F.struct(i.alias("slot"), F.lit(0).cast(kind).alias("value"), F.lit(quality.MISSING).alias("quality")))
    every = held.select(*KEY, F.array_sort(F.concat("held", blank)).alias("every"))
    return every.select(*KEY, F.col("every.value").alias("values"), F.col("every.quality").alias("qualities"))


#: Name of a block in a response, by storage type.
RESPONSES = {"float32": "F32Block", "float64": "F64Block", "int32": "I32Block", "int64": "I64Block", "uint32": "U32Block", "uint64": "U64Block", "enumeration": "U8Block"}


def block_json(summary: DataFrame, dense: DataFrame, series: DataFrame) -> DataFrame:
    """The block response as JSON text: under the name of the series' storage
    type, [summary, values, qualities]. Blocks of unknown series have none."""
    fields = [c for c in summary.columns if c not in KEY]
    name = F.create_map(*(F.lit(x) for pair in RESPONSES.items() for x in pair))[F.col("storage_type")]
    rows = summary.join(dense, list(KEY)).join(series.select("series_id", name.alias("response")), "series_id")
    parts = [F.to_json(F.struct(*fields)), F.to_json(F.col("values")), F.to_json(F.col("qualities"))]
    return rows.select(*KEY, F.concat(F.lit('{"'), "response", F.lit('":['), F.concat_ws(",", *parts), F.lit("]}")).alias("block"))


def wanted_block(catalog: DataFrame, series_id: int, block_id: int) -> DataFrame:
    """The catalog row of a block; an error with its status if there is none."""
    found = catalog.where((F.col("series_id") == series_id) & (F.col("block_id") == block_id))
    if found.isEmpty():
        raise RequestError(f"unknown block {block_id} of series {series_id}", 404)
    return found


def sparse(dense: DataFrame) -> DataFrame:
    """The slots of dense arrays that aren't missing."""
    rows = dense.select(*KEY, F.posexplode(F.arrays_zip("values", "qualities")).alias("slot", "s"))
    return rows.select(*KEY, "slot", F.col("s.values").alias("value"), F.col("s.qualities").alias("quality")).where(quality.is_present(F.col("quality")))


def object_key(series_id: Column, block_id: Column, version: Column) -> Column:
    """Path of a block's object: data/{series mod 100}/{series}/{block}_{version}.blk."""
    return F.concat_ws("/", F.lit("data"), (series_id % 100).cast("string"), series_id.cast("string"), F.concat(block_id.cast("string"), F.lit("_"), version.cast("string"), F.lit(".blk")))


def upserted(catalog: DataFrame, new: DataFrame) -> DataFrame:
    """The block catalog with new rows in place of those with their key; of
    several new rows the one with the largest version stays."""
    rows = catalog.unionByName(new)
    names = [c for c in rows.columns if c not in KEY]
    return rows.groupBy(*KEY).agg(F.max_by(F.struct(*names), "version").alias("r")).select(*KEY, "r.*")


def version_chain(catalog: DataFrame) -> DataFrame:
    """All versions of the blocks with the key of the one before."""
    by = Window.partitionBy(*KEY).orderBy("version")
    return catalog.withColumns({"previous_key": F.lag("object_key").over(by), "is_current": F.lead("version").over(by).isNull()})


def head(slots: DataFrame, n: int = 10) -> DataFrame:
    """The first n slots by block and slot, with readable quality, for inspection."""
    q = F.col("quality").cast("int")
    return slots.orderBy("series_id", "block_id", "slot").limit(n).select("series_id", "block_id", "slot", "value", quality.bits(q).alias("quality_bits"), quality.debug_name(q).alias("quality_name"))


def inspected(summary: DataFrame, slots: DataFrame, series_id: int, block_id: int, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """What a person wants to see of a block: its summary, with the masks in
    grouped bits, and its first n slots."""
    here = (F.col("series_id") == series_id) & (F.col("block_id") == block_id)
    masks = {f"{c}_bits": quality.grouped_bits(F.col(c)) for c in ("qual_acc_or", "qual_acc_and")}
    return summary.where(here).withColumns(masks), head(slots.where(here), n)
