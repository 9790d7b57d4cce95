"""The series catalog: creation, lookup, change, removal, labels, validation.

A catalog is a DataFrame, one row a series: series_id, name, storage_type,
block_len, block_res, sample_len, sample_res, labels (sorted by name), and,
each null if it isn't set, the engineering unit, the low and high limit, and
the codec of the stored samples. Changes return a new catalog; the caller
writes it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.functions import grid
from slotwise.functions.values import STORAGE, storage_name
from slotwise.operators.errors import RequestError

LABELS = "array<struct<name:string,value:string>>"
SCHEMA = f"series_id long, name string, storage_type string, block_len long, block_res string, sample_len long, sample_res string, labels {LABELS}, unit string, low double, high double, codec string"
NAME = r"\A[A-Za-z][A-Za-z0-9_]*\z"


class CatalogError(RequestError):
    """A request that the catalog refuses."""


def normalized_labels(labels: Column) -> Column:
    """Labels sorted by name; of a name given twice the last value stays."""
    empty = F.array().cast(LABELS)
    last = lambda all_, i, x: ~F.exists(F.slice(all_, i + 2, F.greatest(F.size(all_), F.lit(1))), lambda y: y["name"] == x["name"])
    kept = F.filter(labels, lambda x, i: last(labels, i, x))
    return F.coalesce(F.array_sort(kept), empty)


def wanted(pairs: Sequence[tuple[str, str]]) -> Column:
    """Label pairs as an array; none at all is an error, since a match of all
    of none would hold everywhere."""
    if not pairs:
        raise CatalogError("at least one label is needed")
    return F.array(*(F.struct(F.lit(n).alias("name"), F.lit(v).alias("value")) for n, v in pairs))


def match_any(series: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    return series.where(F.arrays_overlap("labels", wanted(pairs)))


def match_all(series: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    return series.where(F.forall(wanted(pairs), lambda x: F.array_contains("labels", x)))


def valid_name(name: Column) -> Column:
    return F.coalesce(name.rlike(NAME), F.lit(False))


def valid_geometry(block_ms: Column, sample_ms: Column) -> Column:
    """A given block must be longer than a sample; one that isn't given is derived."""
    return block_ms.isNull() | (block_ms > sample_ms)


def with_geometry(requests: DataFrame) -> DataFrame:
    """Sample and block durations in milliseconds. A block duration counts only
    if both its length and its resolution are given; else it is derived.
    Resolutions and storage types come by their catalog or their JSON names."""
    names = {"sample_res": grid.unit_name(F.col("sample_res")), "block_res": grid.unit_name(F.col("block_res")), "storage_type": storage_name(F.col("storage_type"))}
    requests = requests.withColumns({c: x for c, x in names.items() if c in requests.columns})
    sample = grid.duration_ms(F.col("sample_len"), F.col("sample_res"))
    given = grid.duration_ms(F.col("block_len"), F.col("block_res"))
    rows = requests.withColumns({"sample_ms": sample, "given_ms": given})
    return rows.withColumn("block_ms", F.coalesce("given_ms", grid.derived_block_ms(F.col("sample_ms"))))


def refusal(requests: DataFrame) -> Column:
    """Why a row of ``with_geometry`` is refused, null if it isn't."""
    return (
        F.when(~valid_name(F.col("name")), "bad name")
        .when(~F.coalesce(F.col("storage_type").isin(*STORAGE), F.lit(False)), "unknown storage type")
        .when(F.col("sample_ms").isNull() | (F.col("sample_ms") <= 0), "bad sample duration")
        .when(~valid_geometry(F.col("given_ms"), F.col("sample_ms")), "block not longer than a sample")
    )


def create(series: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The catalog with the accepted requests, and the refused ones with their
    reason. Ids follow the largest one, in the order of ``request``; requests
    come by the few, the window over them is small."""
    judged = with_geometry(requests)
    judged = judged.withColumn("reason", refusal(judged))
    top = series.agg(F.coalesce(F.max("series_id"), F.lit(0))).first()[0]
    largest = [(n, u) for n, u in (("h", grid.UNIT_MS["h"]), ("min", grid.UNIT_MS["min"]), ("s", grid.UNIT_MS["s"]), ("ms", 1))]
    length, unit = F.col("block_ms"), F.lit("ms")
    for name, ms in reversed(largest):
        fits = F.col("block_ms") % ms == 0
        length, unit = F.when(fits, grid.whole(F.col("block_ms"), ms)).otherwise(length), F.when(fits, name).otherwise(unit)
    given = F.col("given_ms").isNotNull()
    rank = F.row_number().over(Window.orderBy("request"))
    further = [c for c in ("unit", "low", "high", "codec") if c in requests.columns]
    made = judged.where("reason is null").withColumn("n", rank).select(
        (F.lit(top) + F.col("n")).cast("long").alias("series_id"), "name", "storage_type",
        F.when(given, F.col("block_len")).otherwise(length).cast("long").alias("block_len"), F.when(given, F.col("block_res")).otherwise(unit).alias("block_res"),
        F.col("sample_len").cast("long").alias("sample_len"), "sample_res", normalized_labels(F.col("labels")).alias("labels"), *further,
    )
    return series.unionByName(made, allowMissingColumns=True).select(series.columns), judged.where("reason is not null").select("request", "name", "reason")


def get(series: DataFrame, series_id: int) -> DataFrame:
    found = series.where(F.col("series_id") == series_id)
    return found.limit(1)


def scan(series: DataFrame) -> DataFrame:
    return series


def update(series: DataFrame, patches: DataFrame) -> DataFrame:
    """New names and labels by series_id; a null field stays, labels are
    replaced as a whole. A patch without either is refused by ``checked``."""
    new = patches.select("series_id", F.col("name").alias("new_name"), F.col("labels").alias("new_labels"))
    labels = F.when(F.col("new_labels").isNotNull(), normalized_labels(F.col("new_labels"))).otherwise(F.col("labels"))
    return series.join(new, "series_id", "left").withColumns({"name": F.coalesce("new_name", "name"), "labels": labels}).drop("new_name", "new_labels")


def checked(name: str | None, labels: Sequence | None) -> None:
    if name is None and labels is None:
        raise CatalogError("a patch needs a name or labels")


def delete(series: DataFrame, ids: DataFrame, *owned: DataFrame) -> tuple[DataFrame, ...]:
    """The catalog without the ids and, cascading, the owned tables (blocks,
    samples) without their rows."""
    gone = ids.select("series_id").distinct()
    return tuple(t.join(gone, "series_id", "left_anti") for t in (series, *owned))
