"""Storage types: the Spark type that holds each, the type that sums it
exactly, and conversion from raw doubles."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Storage(NamedTuple):
    spark: str
    total: str
    width: int
    low: str | None
    high: str | None


#: Catalog name to Spark type, sum type, bytes a sample, range.
STORAGE = {
    "float32": Storage("float", "double", 4, None, None),
    "float64": Storage("double", "double", 8, None, None),
    "int32": Storage("int", "bigint", 4, "-2147483648", "2147483647"),
    "int64": Storage("bigint", "decimal(38,0)", 8, "-9223372036854775808", "9223372036854775807"),
    "uint32": Storage("bigint", "decimal(38,0)", 4, "0", "4294967295"),
    "uint64": Storage("decimal(20,0)", "decimal(38,0)", 8, "0", "18446744073709551615"),
    "enumeration": Storage("smallint", "bigint", 1, "0", "255"),
}

#: JSON tags of a request's value array.
JSON_TYPES = {"F32": "float32", "F64": "float64", "I32": "int32", "I64": "int64", "U32": "uint32", "U64": "uint64", "Enum": "enumeration"}
JSON_TAGS = {tag: name for t, name in JSON_TYPES.items() for tag in (t, t.lower())}

#: JSON names of the storage types of a new series.
JSON_STORAGE = {"Float32": "float32", "Float64": "float64", "Int32": "int32", "Int64": "int64", "UInt32": "uint32", "UInt64": "uint64", "Enumeration": "enumeration"}

#: Stored columns hold either reals or whole numbers, so that 64-bit integers stay exact.
KINDS = {"real": "double", "whole": "decimal(20,0)"}


def kind_of(storage: Column) -> Column:
    return F.when(storage.isin("float32", "float64"), "real").when(storage.isin(*STORAGE), "whole")


def storage_name(name: Column) -> Column:
    """The catalog name of a storage type that is given by it or by its JSON name."""
    return F.coalesce(F.create_map(*(F.lit(x) for pair in JSON_STORAGE.items() for x in pair))[name], name)


def total_of(kind: str) -> str:
    """Type of a sum of values of a Spark type. Sums of integers are exact. Sums
    of floats are doubles, whose last bits depend on the order of addition: two
    runs agree within 1e-12 of the sum of the magnitudes."""
    if kind.startswith("decimal"):
        return f"decimal(38,{kind.rstrip(')').split(',')[-1]})"
    return {"float": "double", "double": "double", "bigint": "decimal(38,0)"}.get(kind, "bigint")


def storage_of_tag(tag: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in JSON_TAGS.items() for x in pair))[tag]


def width(storage: Column) -> Column:
    return F.create_map(*(F.lit(x) for name, s in STORAGE.items() for x in (name, s.width)))[storage]


def in_range(value: Column, storage: str) -> Column:
    """Whether a value fits its storage type; NaN fits none."""
    s = STORAGE[storage]
    if s.low is None:
        return value.isNotNull() & ~F.isnan(value.cast("double"))
    x = value.cast("decimal(38,0)")
    return x.isNotNull() & (x >= F.lit(s.low).cast("decimal(38,0)")) & (x <= F.lit(s.high).cast("decimal(38,0)"))


def fits(value: Column, storage: Column, text: bool) -> Column:
    """Whether a number, or its JSON text, is one of its storage type: whole and
    in range for integers; finite for floats."""
    real = value.try_cast("double")
    is_whole = value.rlike("^-?[0-9]+$") if text else F.rint(real) == real
    whole = value.try_cast("decimal(38,0)")
    bounds = {n: s for n, s in STORAGE.items() if s.low is not None}
    low, high = (F.create_map(*(x for n, s in bounds.items() for x in (F.lit(n), F.lit(getattr(s, end)).cast("decimal(38,0)"))))[storage] for end in ("low", "high"))
    infinite = F.lit(float("inf"))
    finite = ~F.isnan(real) & (F.abs(real) != infinite) & ((storage != "float32") | (F.abs(real.cast("float")) != infinite))
    return F.coalesce(F.when(kind_of(storage) == "real", finite).otherwise(is_whole & (whole >= low) & (whole <= high)), F.lit(False))


def from_raw(raw: Column, storage: str) -> Column:
    """A raw double as a stored value: signed integers are cut off towards
    zero, unsigned ones are made positive first, and an enumeration is taken
    modulo 255."""
    s = STORAGE[storage]
    if storage in ("float32", "float64", "int32", "int64"):
        return raw.cast(s.spark)
    whole = F.abs(raw).cast("bigint")
    return (whole % 255).cast(s.spark) if storage == "enumeration" else whole.cast(s.spark)


def exact_sum(value: Column, storage: str) -> Column:
    return F.sum(value.cast(STORAGE[storage].total)).cast(STORAGE[storage].total)
