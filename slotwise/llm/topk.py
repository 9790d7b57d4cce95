"""Exact top-k inner product search by MaxScore over shards.

A vector's dimensions are the query terms. In a tile of rows every dimension
has a bound on what it can add to a query's score: the query's weight times the
tile's largest or smallest component. The dimensions are taken by falling
bound; the non-essential ones are the longest tail whose bounds together cannot
lift a candidate over the query's current k-th score. Only essential postings
are traversed for all rows of a tile; the others are probed, some dimensions at
a time, for the rows that are still competitive.

Queries go in blocks of bounded size to the rows, which stay where they are:
each task is a shard that carries every query's k-th score from tile to tile,
starting from a floor that a bounded sample of rows gives. A shard's best k are
exact, so merging the shards' lists gives the exact result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotwise.llm.common import cut

QUERY_BLOCK = 8192  # queries that are broadcast at once, on average
TILE = 4096  # rows whose postings are traversed together
PROBE = 8  # dimensions probed before the survivors are counted again
SEEDS = 2048  # rows in the sample that the floors start from, on average
LONGS = 2**63 - 1


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id and the embedding as doubles, without the vectors that are null
    or hold a null or non-finite component, and without null ids."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("embedding").isNotNull() & finite, x).alias("x")).where("vec_id is not null and x is not null")


def quantized(rows: list[np.ndarray], width: int, scale: int) -> np.ndarray:
    """floor(scale * x) of every component, as integers that doubles hold
    exactly; a shorter vector counts as zero in the missing places. Python
    integers where a product leaves the range of doubles."""
    out = np.zeros((len(rows), width))
    with np.errstate(over="ignore"):
        for i, r in enumerate(rows):
            out[i, : len(r)] = np.floor(scale * r)
    if np.isinf(out).any():
        out = np.array([[math.floor(v) * scale if math.isinf(math.floor(v) * float(scale)) else math.floor(scale * v) for v in r] + [0] * (width - len(r)) for r in (r.tolist() for r in rows)], dtype=object)
    return out


def exact(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both sides in the narrowest type in which every inner product, and every
    partial sum of one, is exact: doubles, 64-bit integers, Python integers."""
    if not len(q) or not len(x):
        return q, x
    bound = max(abs(int(q.max())), abs(int(q.min()))) * max(abs(int(x.max())), abs(int(x.min()))) * q.shape[1] if q.shape[1] else 0
    kind = np.float64 if bound < 2**53 else np.int64 if bound < 2**63 else object
    if kind is object and q.dtype != object:
        return np.array([[int(v) for v in r] for r in q], object).reshape(q.shape), np.array([[int(v) for v in r] for r in x], object).reshape(x.shape)
    return q.astype(kind), x.astype(kind)


class Best:
    """The k best candidates of each query, ties to smaller ids."""

    def __init__(self, n: int, k: int, floor: list):
        self.k, self.floor = k, floor
        self.ids: list[np.ndarray] = [np.empty(0, np.int64)] * n
        self.scores: list[np.ndarray] = [np.empty(0, object)] * n

    def add(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids[q], ids]), np.concatenate([self.scores[q], scores.astype(object)])
        order = np.lexsort((ids, -scores))[: self.k] if scores.dtype != object else np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[: self.k], int)
        self.ids[q], self.scores[q] = ids[order], scores[order]
        if len(order) == self.k:
            self.floor[q] = max(self.floor[q], self.scores[q][-1])


def search_tile(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, best: Best) -> int:
    """Add a tile's rows to the queries' best, by MaxScore; a query's own id is
    no candidate. Returns the number of products that were computed."""
    q, x = exact(q, x)
    high, low = x.max(axis=0), x.min(axis=0)
    postings, n, done = np.ascontiguousarray(x.T), len(ids), 0
    for i, (q_id, w) in enumerate(zip(q_ids, q, strict=True)):
        floor = best.floor[i]
        bound = np.maximum(w * high, w * low)
        terms = np.argsort(-bound, kind="stable")
        tail = np.append(np.cumsum(bound[terms][::-1])[::-1], 0)  # what terms[i:] can add
        if len(terms) and tail[0] < floor:  # no row of the tile can enter
            continue
        # non-essential: the longest tail that stays under the floor on its own
        essential = min(max(int((tail >= floor).sum()), PROBE), len(terms)) if floor > -math.inf else len(terms)
        head = terms[:essential]
        score = w[head] @ postings[head]
        done += essential * n
        alive = np.flatnonzero((score + tail[essential] >= floor) & (ids != q_id))
        score, at = score[alive], essential
        while at < len(terms) and len(alive):
            more = terms[at : at + PROBE]
            score = score + w[more] @ postings[np.ix_(more, alive)]
            done += len(more) * len(alive)
            at += len(more)
            keep = score + tail[at] >= floor
            alive, score = alive[keep], score[keep]
        if len(alive):
            if len(alive) > 4 * best.k:  # only the best and their ties matter
                cut_at = np.sort(score)[-best.k]
                alive, score = alive[score >= cut_at], score[score >= cut_at]
            best.add(i, ids[alive], _whole(score))
    return done


def _whole(score: np.ndarray) -> np.ndarray:
    return score.astype(np.int64).astype(object) if score.dtype != object else score


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
    x = batch.column("x")
    flat, ends = x.flatten().to_numpy(zero_copy_only=False), x.offsets.to_numpy() - x.offsets[0].as_py()
    return batch.column("vec_id").to_numpy(), [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Runs of about ``TILE`` rows."""
    ids, rows, n = [], [], 0
    for batch in batches:
        if batch.num_rows:
            some, x = _arrays(batch)
            ids.append(some)
            rows += x
            n += len(x)
        if n >= TILE:
            yield np.concatenate(ids), rows
            ids, rows, n = [], [], 0
    if n:
        yield np.concatenate(ids), rows


def maxscore_topk(vectors: DataFrame, every: int, k: int, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score of the k highest integer inner products
    for each vec_id divisible by ``every``, ties to the smaller vec_id.

    Null ids and vectors, and vectors with null or non-finite components, take
    no part. Repeated rows are a candidate each; the rows with a query's id are
    the query's own, the smallest of them (by its components) asks, and none of
    them is a candidate for it. Shorter vectors count as padded by zeros;
    further columns play no part; an empty table gives no rows. Scores are
    exact; one beyond 64 bits is ranked by its true value and given as the
    nearest 64-bit integer. Queries are broadcast in blocks of a bounded size,
    one after the other, and the other side isn't moved at all.
    """
    spark = vectors.sparkSession
    rows, kinds = valid(vectors), "query_id long, vec_id long, score long, rest string"
    n, n_queries = (int(x or 0) for x in rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first())
    blocks = max(1, math.ceil(n_queries / QUERY_BLOCK))
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("x").alias("x"))
    picked = rows.where(F.pmod(F.xxhash64("vec_id", "x"), F.lit(2**30)) < int(min(1.0, SEEDS / max(n, 1)) * 2**30))
    seeds = picked.collect() if n else []  # of bounded size; equal rows are all in or out
    seed_ids, seed_rows = np.array([r["vec_id"] for r in seeds], np.int64), [np.array(r["x"], float) for r in seeds]

    def found_in(block: int) -> DataFrame:
        mine = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).collect()  # of bounded size
        q_ids, q_rows = np.array([r["vec_id"] for r in mine], np.int64), [np.array(r["x"], float) for r in mine]
        width = max([0, *map(len, q_rows), *map(len, seed_rows)])
        start = Best(len(mine), k, [-math.inf] * len(mine))
        if len(mine) and len(seeds):
            search_tile(q_ids, quantized(q_rows, width, scale), seed_ids, quantized(seed_rows, width, scale), start)
        shared = spark.sparkContext.broadcast((q_ids, q_rows, start.floor))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q_ids, q_rows, floor = shared.value
            best = Best(len(q_ids), k, list(floor))
            q, width = None, -1
            for ids, x in _tiles(batches):
                wide = max(map(len, [*q_rows, *x]), default=0)
                if wide > width:
                    q, width = quantized(q_rows, wide, scale), wide
                search_tile(q_ids, q, ids, quantized(x, width, scale), best)
            for i, q_id in enumerate(q_ids.tolist()):
                if len(best.ids[i]):
                    clipped = [max(-LONGS - 1, min(LONGS, int(s))) for s in best.scores[i]]
                    # what 64 bits can't hold decides the order among the clipped
                    rest = [str(int(s)) if abs(int(s)) > LONGS else None for s in best.scores[i]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(clipped), q_id)), pa.array(best.ids[i]), pa.array(clipped, pa.int64()), pa.array(rest, pa.string())], ["query_id", "vec_id", "score", "rest"])

        wide = F.col("rest").try_cast("decimal(38,0)")
        by = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc(F.coalesce(wide, F.col("score").cast("decimal(38,0)"))), "vec_id")
        ranked = rows.mapInArrow(run, kinds).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
        return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

    out = found_in(0)
    for b in range(1, blocks):  # each block is finished before the next one is broadcast
        out = (cut(out) if b == 1 else out).unionByName(cut(found_in(b)))
    return out
