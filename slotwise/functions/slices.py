"""Slices of an order: bounded numbers of cut points from a sample, so that a
running value over a very long run of rows can be carried in two levels (within
slices, then over one row a slice) instead of one window over all of them."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 1024  # slices
SAMPLE = 40_000  # expected number of sampled rows that the cut points are quantiles of, at most


def cuts(rows: DataFrame, order: tuple[str, ...], rows_each: int) -> list[tuple[int, ...]]:
    """Ascending tuples of the long columns ``order`` that cut the rows into
    slices of about ``rows_each`` rows, however they are spread; at most
    ``MOST`` slices. Rows with a null among the columns don't count."""
    known = rows.select(*order).dropna()
    n = known.count()
    wanted = min(MOST, math.ceil(n / rows_each))
    if wanted < 2:
        return []
    share = min(1.0, SAMPLE / n)
    chosen = known.where(F.pmod(F.xxhash64(*order), F.lit(2**30)) < int(share * 2**30))
    seen = [tuple(r) for r in chosen.distinct().orderBy(*order).collect()]  # of bounded size
    return sorted({seen[len(seen) * i // wanted] for i in range(1, wanted)}) if seen else []


def slice_of(order: tuple[str, ...], points: list[tuple[int, ...]]) -> Column:
    """Number of the slice of a row, by binary search among the cut points."""
    if not points:
        return F.lit(0)
    fields = ", ".join(f"c{i}:bigint" for i in range(len(order)))
    table = F.from_json(F.lit(json.dumps([{f"c{i}": x for i, x in enumerate(p)} for p in points])), f"array<struct<{fields}>>")
    row = F.struct(*(F.col(c).cast("long").alias(f"c{i}") for i, c in enumerate(order)))
    steps = F.array(*(F.lit(1 << s) for s in reversed(range(len(points).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda i, s: F.when((i + s <= len(points)) & (F.get(table, i + s - 1) <= row), i + s).otherwise(i))
