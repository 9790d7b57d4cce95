"""The quality byte: two major bits decide the class, then four sub-status
bits and two limit bits. Absence is quality MISSING, not NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Major bits and summary flag of each class.
GOOD, UNCERTAIN, BAD, MISSING = 192, 64, 0, 128
FLAG_GOOD, FLAG_BAD, FLAG_UNCERTAIN, FLAG_MISSING = 1, 2, 4, 8
MAJOR = 192


def is_class(q: Column, major: int) -> Column:
    return q.bitwiseAND(F.lit(MAJOR)) == major


def is_missing(q: Column) -> Column:
    return is_class(q, MISSING)


def is_present(q: Column) -> Column:
    return ~is_missing(q)


def is_valid(q: Column) -> Column:
    """Good or uncertain."""
    return q.bitwiseAND(F.lit(UNCERTAIN)) == UNCERTAIN


def by_class(q: Column, good, uncertain, bad, missing) -> Column:
    return F.when(is_class(q, GOOD), good).when(is_class(q, UNCERTAIN), uncertain).when(is_class(q, BAD), bad).otherwise(missing)


def flag(q: Column) -> Column:
    return by_class(q, *(F.lit(x) for x in (FLAG_GOOD, FLAG_UNCERTAIN, FLAG_BAD, FLAG_MISSING)))


def class_name(q: Column) -> Column:
    return by_class(q, *(F.lit(x) for x in ("good", "uncertain", "bad", "missing")))


def debug_name(q: Column) -> Column:
    """Class for people; a bad quality is shown with its bits."""
    return by_class(q, F.lit("Good"), F.lit("Uncertain"), F.concat(F.lit("Bad "), bits(q)), F.lit("MISSING"))


def sub_status(q: Column) -> Column:
    return F.shiftright(q.cast("int"), 2).bitwiseAND(F.lit(15))


def limit(q: Column) -> Column:
    return q.cast("int").bitwiseAND(F.lit(3))


def bits(q: Column) -> Column:
    """QQ_SSSS_LL."""
    b = F.lpad(F.bin(q.cast("long")), 8, "0")
    return F.concat_ws("_", F.substring(b, 1, 2), F.substring(b, 3, 4), F.substring(b, 7, 2))


def grouped_bits(x: Column) -> Column:
    """32 binary digits in groups of four."""
    return F.rtrim(F.regexp_replace(F.lpad(F.bin(x.cast("long")), 32, "0"), "(.{4})", "$1 "))
