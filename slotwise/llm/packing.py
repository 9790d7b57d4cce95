"""Packing of tokenised documents into sequences by the sum-of-squares rule.

Documents are tokenised where they lie; only piece sizes are shuffled. Pieces
are dealt by hash into groups of bounded expected size and each group is packed
on its own, so no task sees the corpus. A piece goes into the open bin that
makes the sum of the squared numbers of open bins per residual gap smallest; a
new bin is opened only where no open one has room. Pieces are taken by falling
length.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import documents

CAPACITY = 2048
GROUP_PIECES = 8192  # pieces packed together, on average
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """The byte-level BPE of a public tokenizer file (JSON with model.vocab,
    model.merges and added_tokens), run by tiktoken: the same ids at a fifth of
    the CPU time. As in the file, a text is split at its added tokens first."""
    import json

    import public_tokenizers
    import tiktoken

    with open(vocabulary, encoding="utf-8") as f:
        file = json.load(f)
    added = {t["content"]: t["id"] for t in file["added_tokens"]}
    # byte-level BPE writes each byte as a printable character
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in added}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


@lru_cache(maxsize=2)
def _tokenizer(vocabulary: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


def ids_of(text: str, vocabulary: str) -> np.ndarray:
    """A document's ids, those of the tokenizer file as it stands, then 0.
    White space by the hundred thousand is more than tiktoken's regular
    expressions can hold; the tokenizers library takes over where they give up."""
    try:
        ids = encoder(vocabulary).encode_to_numpy(text, allowed_special="all")
    except ValueError:
        ids = np.array(_tokenizer(vocabulary).encode(text, add_special_tokens=False).ids)
    return np.append(ids, 0).astype("<u4")


def pieces_of(ids: np.ndarray, capacity: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, crc32) per piece; of a longer document all pieces but
    the first have ``capacity`` tokens."""
    first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
    start, end = 0, first
    while start < len(ids):
        yield start, end - start, zlib.crc32(ids[start:end].tobytes())
        start, end = end, end + capacity


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each piece, placed in the order given."""
    count = np.zeros(capacity + 1, dtype=np.int64)  # open bins per gap; gap 0 is not open
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    out, offset, opened = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i, s in enumerate(lengths.tolist()):
        # taking a bin of gap g to gap g - s changes the sum by 2 - 2 N(g) + 2 N(g - s)
        change = 2 * (count[: capacity - s] - count[s:capacity]) + 2
        if len(change):
            change[0] -= 1  # a bin that becomes full is open no longer
            change[count[s:capacity] == 0] = np.iinfo(np.int64).max
        g = s + int(change.argmin()) if len(change) else capacity
        if g < capacity and count[g]:
            b = bins[g].pop()
            count[g] -= 1
        else:
            b, g, opened = opened, capacity, opened + 1
        out[i], offset[i] = b, capacity - g
        if g > s:
            bins[g - s].append(b)
            count[g - s] += 1
    return out, offset


def tokenised(docs: DataFrame, vocabulary: str, capacity: int) -> DataFrame:
    """The pieces, and ``nth``: which of the equal pieces of its task a piece
    is. The numbers of a task's rows don't depend on their order, so a task
    that is tried again deals the same pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for k, x in enumerate(pieces_of(ids_of(text.as_py(), vocabulary), capacity)):
                    piece = (doc_id, k, *x)
                    rows.append((*piece, seen[hash(piece)]))
                    seen[hash(piece)] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "nth"])

    return docs.mapInArrow(run, PIECES + ", nth long")


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset.

    Every document ends with id 0; a null or empty text is that id alone; a
    text of whatever length is cut into pieces. Rows are packed as they come:
    repeated rows and null ids are packed once per row, and further columns,
    whatever their names, play no part. An empty table gives no rows.
    """
    groups = max(1, math.ceil(docs.count() / GROUP_PIECES))
    sizes = tokenised(documents(docs), vocabulary, capacity)
    # the checksum spreads rows that repeat an id, their number rows that repeat in full
    dealt = sizes.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "nth", F.spark_partition_id()), F.lit(groups))).drop("nth")

    def run(rows: pa.Table) -> pa.Table:
        longest_first = [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")]
        rows = rows.take(pc.sort_indices(rows, sort_keys=longest_first))
        number, offset = sum_of_squares(rows["length"].to_numpy(), capacity)
        ids = rows["part"].to_numpy().astype(np.int64) * 2**32 + number
        return rows.drop_columns(["part"]).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offset))

    return dealt.groupBy("part").applyInArrow(run, PIECES + ", sequence_id long, offset long")
