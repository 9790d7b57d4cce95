"""Labelled rows for the classifiers, and isotonic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000  # expected number of labelled rows that a classifier learns from, at most
BINS = 1000


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    return F.crc32(doc_id.cast("string")) % 5


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == 0, F.lit(False))


def sample(labels: DataFrame, kind: str, size: int = SAMPLE) -> DataFrame:
    """doc_id, y, fold of a bounded sample of the rows to learn from, dealt by
    hash; an id with several labels has the largest, and null ids and labels
    take no part. The bound on its size makes it fit for a broadcast."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(kind).isNotNull() & (fold(F.col("doc_id")) != 0)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(kind).cast("double").alias("y"))
    part = min(1.0, size / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(2**30)) < int(part * 2**30))
    return chosen.groupBy("doc_id").agg(F.max("y").alias("y")).withColumn("fold", fold(F.col("doc_id")))


def isotonic(n: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Rising shares of positives over ordered bins, by pooling adjacent
    violators; a share is smoothed by one observation at the mean, and empty
    bins lie between the pools beside them."""
    if n.sum() == 0:
        return np.full(len(n), 0.5)
    base = positive.sum() / n.sum()
    pools: list[list[float]] = []  # weight, positives, first bin, last bin
    for i in np.flatnonzero(n):
        pools.append([n[i], positive[i], i, i])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            w, p, _, last = pools.pop()
            pools[-1][0] += w
            pools[-1][1] += p
            pools[-1][3] = last
    share = np.maximum.accumulate([(p + base) / (w + 1) for w, p, _, _ in pools])
    ends = np.array([(a, b) for _, _, a, b in pools], float).ravel()
    return np.interp(np.arange(len(n)), ends, np.repeat(share, 2))
