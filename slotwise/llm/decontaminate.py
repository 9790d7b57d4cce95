"""Benchmark decontamination: CGK random-walk embedding, bit-sampling LSH and
exact edit verification over item-sized windows of words.

The CGK embedding (Chakraborty, Goldenberg, Koucky 2016) walks over a string
with a pointer that stays or advances by a random bit of (step, symbol), and
writes the symbol under it at each step; strings at a small edit distance get
embeddings at a small Hamming distance. Each repetition has its own walk and
samples a few places of the embedding. The items' samples are the keys of one
hash table a repetition; every window of a document is looked up there by its
own samples. The places lie in the first steps, which no item-sized window
ends within, so one walk from a start serves the windows of all sizes; and an
item is entered from every few of its words on, so that edits near its
beginning don't hide it. Candidates are verified by exact edit distance, counted
in words. The repetitions are as many as reach a target recall for items with
all the edits allowed, measured by simulation on the items themselves.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import cut, documents, small_batches
from slotwise.llm.words import NOT_WORD, batch_hashes, mix, runs, word_hashes

EDITS = 0.2  # allowed word edits as a share of the item's words
TARGET = 0.995  # share of items with all allowed edits that become candidates, at least
SAMPLES, STEPS, STRIDE = 5, 14, 2  # places sampled in a repetition; steps that they lie in; words between an item's entries
MOST = 32  # repetitions
TRIALS = 400  # simulated windows that the repetitions are chosen by
BLOCK_CHARS = 16 * 2**20  # benchmark text broadcast at once; more goes in several passes
_SEEDS = np.random.Generator(np.random.PCG64(41))
WALK = _SEEDS.integers(1, 2**63, MOST, dtype=np.uint64)
SPREAD = np.uint64(0xD6E8FEB86659FD93)
PLACES = (np.arange(SAMPLES) + _SEEDS.random((MOST, SAMPLES))) / SAMPLES  # as shares of the steps


def steps_of(n: int, edits: int) -> int:
    """Steps that the samples of an item of n words lie in: fewer for an item
    that is shorter, so that a walk doesn't leave it, and room for its edits."""
    return min(STEPS, n if not edits else max(3, n - 3 * edits))


def samples(words: np.ndarray, repetition: int, sizes: list[int]) -> dict[int, np.ndarray]:
    """For walks from every word on, the keys of the sampled symbols of their
    embeddings, by the number of steps that the samples lie in."""
    n = len(words)
    places = {size: set((PLACES[repetition] * size).astype(int).tolist()) for size in sizes}
    last = max(map(max, places.values()), default=0)
    padded = np.concatenate([words, np.zeros(last + 1, np.uint64)])  # what a walk reads past the end
    # bit t tells whether the walk leaves the word at step t
    bits = (mix(padded ^ WALK[repetition]) & np.uint64((1 << STEPS) - 1)).astype(np.uint16)
    keys = {size: np.full(n, size, np.uint64) for size in sizes}
    at = np.arange(n, dtype=np.int32)
    for step in range(last + 1):
        sampled = [size for size in sizes if step in places[size]]
        if sampled:
            symbol = padded[at]
            for size in sampled:
                keys[size] = keys[size] * SPREAD + symbol
        at += (bits[at] >> np.uint16(step)) & np.uint16(1)
    return {size: mix(k) for size, k in keys.items()}


class Items(NamedTuple):
    """Items by number: words and allowed edits; the sizes of their sampled
    walks; and a table a repetition: a filter on the keys' first bits, and the
    sorted keys with their (item, offset)."""

    ids: list[int]
    words: list[np.ndarray]
    edits: np.ndarray
    sizes: list[int]
    tables: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def _table(words: list[np.ndarray], size: np.ndarray, sizes: list[int], repetition: int) -> tuple[np.ndarray, ...]:
    keys, item, offset = [], [], []
    for i, w in enumerate(words):
        at = np.arange(0, len(w) - int(size[i]) + 1, STRIDE)
        keys.append(samples(w, repetition, [int(size[i])])[int(size[i])][at])
        item.append(np.full(len(at), i))
        offset.append(at)
    keys, item, offset = np.concatenate(keys), np.concatenate(item), np.concatenate(offset)
    order = np.argsort(keys, kind="stable")
    likely = np.zeros(2**20, bool)
    likely[keys >> np.uint64(44)] = True
    return likely, keys[order], item[order], offset[order]


def looked_up(own: np.ndarray, table: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, item, offset) of the entries with a start's key."""
    likely, keys, item, offset = table
    hit = np.flatnonzero(likely[own >> np.uint64(44)])
    low = np.searchsorted(keys, own[hit], "left")
    same = keys[np.minimum(low, len(keys) - 1)] == own[hit]
    hit, low = hit[same], low[same]
    many = np.searchsorted(keys, own[hit], "right") - low
    at = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return np.repeat(hit, many), item[at], offset[at]


def edited(words: np.ndarray, edits: int, r: random.Random) -> np.ndarray:
    """The words after random replacements, removals and insertions."""
    out = words.tolist()
    for _ in range(edits):
        at, how, new = r.randrange(max(len(out), 1)), r.randrange(3), r.getrandbits(64)
        out[at : at + 1] = [[new], [], [*out[at : at + 1], new]][how]
    return np.array(out, np.uint64)


def first_hits(items: Items, trials: int = TRIALS, seed: int = 6) -> np.ndarray:
    """For random items with all the edits allowed, among other words: the
    first repetition in which a window is looked up as a candidate at its
    place, or ``MOST``."""
    r, out = random.Random(seed), []
    for _ in range(trials):
        i = r.randrange(len(items.words))
        k = int(items.edits[i])
        around = [np.array([r.getrandbits(64) for _ in range(STEPS)], np.uint64) for _ in range(2)]
        text = np.concatenate([around[0], edited(items.words[i], k, r), around[1]])
        for repetition, table in enumerate(items.tables):
            hits = [looked_up(own, table) for own in samples(text, repetition, items.sizes).values()]
            if any(((item == i) & (abs(start - offset - STEPS) <= k)).any() for start, item, offset in hits):
                out.append(repetition)
                break
        else:
            out.append(MOST)
    return np.array(out)


def prepared(rows: list[tuple[int, str]], share: float = EDITS, target: float = TARGET) -> Items:
    ids, words = [], []
    for item_id, text in rows:
        w = word_hashes(text or "", NOT_WORD)[0]
        if len(w):  # an item without words matches nothing
            ids.append(item_id)
            words.append(w)
    n = np.array([len(w) for w in words], int)
    edits = np.floor(share * n).astype(int)
    size = np.array([steps_of(a, b) for a, b in zip(n.tolist(), edits.tolist(), strict=True)], int)
    sizes = sorted(set(size.tolist()))
    items = Items(ids, words, edits, sizes, [])
    while words and len(items.tables) < MOST:
        items.tables.extend(_table(words, size, sizes, r) for r in range(len(items.tables), len(items.tables) + 4))
        # a margin of two standard errors of the simulation
        if (first_hits(items) < MOST).mean() >= min(target + 2 * math.sqrt(target * (1 - target) / TRIALS), 1 - 1 / TRIALS):
            break
    return items


def distance(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Smallest word edit distance of the item to a stretch of words, and the
    first such stretch's start and end."""

    def last_row(a: np.ndarray, b: np.ndarray, free: bool) -> np.ndarray:
        step = np.arange(len(b) + 1)
        row = np.zeros(len(b) + 1, int) if free else step.copy()
        for i, x in enumerate(a):
            new = np.empty_like(row)
            new[0] = i + 1
            new[1:] = np.minimum(row[:-1] + (b != x), row[1:] + 1)
            row = np.minimum.accumulate(new - step) + step
        return row

    row = last_row(item, words, True)
    end = int(row.argmin())
    back = last_row(item[::-1], words[:end][::-1], False)
    return int(row[end]), end - int(back.argmin()), end


class Matcher:
    def __init__(self, items: Items):
        self.items = items
        self.length = np.array([len(w) for w in items.words], int)
        self.sorted = [np.sort(w) for w in items.words]

    def windows(self, words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(doc, item, start) of the candidates in documents' words, which lie
        one behind the other; a start is where the item would begin."""
        found: list[np.ndarray] = []
        for repetition, table in enumerate(self.items.tables):
            for own in samples(words, repetition, self.items.sizes).values():
                start, item, offset = looked_up(own, table)
                if len(start):
                    found.append(np.stack([doc[start], item, start - offset]))
        if not found:
            return np.empty(0, int), np.empty(0, int), np.empty(0, int)
        every = np.concatenate(found, axis=1)
        every = every[:, np.lexsort(every[::-1])]
        every = every[:, np.r_[True, (every[:, 1:] != every[:, :-1]).any(axis=0)]]
        return every[0], every[1], every[2]

    def matches(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text number, item id, edits, first word, end word) of the verified
        items, each with its best place."""
        if not self.items.words:
            return
        words, doc = batch_hashes(texts, NOT_WORD)
        begin = np.searchsorted(doc, np.arange(len(texts) + 1))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        d_, i_, s_ = (x.tolist() for x in self.windows(words, doc)) if len(words) else ([], [], [])
        a = 0
        while a < len(d_):  # neighbouring starts are one stretch
            d, i, b = d_[a], i_[a], a + 1
            n, k = int(self.length[i]), int(self.items.edits[i])
            while b < len(d_) and d_[b] == d and i_[b] == i and s_[b] - s_[b - 1] <= n:
                b += 1
            # the place where the item would begin is off by the edits, at most, and so is its end
            low, high = max(int(begin[d]), s_[a] - 2 * k), min(int(begin[d + 1]), s_[b - 1] + n + 2 * k)
            stretch = words[low:high]
            own = self.sorted[i]
            here = np.sort(stretch)
            if len(stretch) and (here[np.minimum(np.searchsorted(here, own), len(here) - 1)] == own).sum() >= n - k:
                edits, first, end = distance(self.items.words[i], stretch)
                found = (edits, first + low - int(begin[d]), end + low - int(begin[d]))
                if edits <= k and found < best.get((d, i), (n + 1, 0, 0)):
                    best[d, i] = found
            a = b
        for (d, i), (edits, first, end) in sorted(best.items()):
            yield d, self.items.ids[i], edits, first, end


def matchers(benchmark: DataFrame) -> Iterator[Matcher]:
    """Matchers for blocks of the benchmark of a bounded size; one block if the
    benchmark is small, and none if it is empty."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = rows.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, math.ceil(size / BLOCK_CHARS))
    for b in range(blocks if size else 0):
        block = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).distinct().orderBy("item_id", "text")
        yield Matcher(prepared([tuple(r) for r in block.collect()]))


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    yield from runs(t.as_py() or "" for t in batch.column("text"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, edits, first_word, end_word: one row for each document
    and benchmark item that it holds within the allowed edits, at its best
    place (fewest edits, then first), in words of letters and digits.

    Null and empty texts hold nothing, and items without words are in nothing;
    very long texts are read whole; repeated documents give repeated rows,
    repeated items one; null ids are kept; further columns, whatever their
    names, play no part. Empty tables give no rows.
    """
    context = docs.sparkSession.sparkContext
    kinds = "doc_id long, item_id long, edits int, first_word int, end_word int"

    def search(matcher) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                rows = [(ids[first + d], *x) for first, texts in _texts(batch) for d, *x in matcher.value.matches(texts)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["doc_id", "item_id", "edits", "first_word", "end_word"])

        return documents(docs).mapInArrow(run, kinds)

    found = None
    for m in matchers(benchmark):  # of several blocks each is finished before the next one is broadcast
        part = search(context.broadcast(m))
        found = part if found is None else cut(found).unionByName(cut(part))
    return docs.sparkSession.createDataFrame([], kinds) if found is None else found


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark item; nulls,
    repeated rows, very long texts and empty tables as in ``contaminated``."""
    small_batches(docs.sparkSession)
    context, out = docs.sparkSession.sparkContext, docs

    def without(rows: DataFrame, matcher) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bad = {first + d for first, texts in _texts(batch) for d, *_ in matcher.value.matches(texts)}
                yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_())) if bad else batch

        return rows.mapInArrow(run, docs.schema)

    for m in matchers(benchmark):
        out = without(out, context.broadcast(m))
    return out
