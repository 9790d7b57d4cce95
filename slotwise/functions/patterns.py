"""Sample patterns of the generator, by sample number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERNS = {
    "sine": lambda i: F.lit(10.0) * F.sin(i.cast("double") * F.lit(0.1)),
    "constant": lambda i: F.lit(42.0),
    "ramp": lambda i: i.cast("double"),
}


def raw_value(pattern: str, i: Column) -> Column:
    if pattern not in PATTERNS:
        raise ValueError(f"unknown pattern {pattern!r}; one of {', '.join(PATTERNS)}")
    return PATTERNS[pattern](i)
