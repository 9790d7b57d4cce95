"""The write-ahead log as a Spark source and sink.

A file is a run of frames, little endian: length u32, CRC-32C u32, payload. A
payload starts with tag u8 (1 WRITE, 2 FLUSH), tx u64, series u64, block u64; a
WRITE goes on with count u32, count timestamps u64, count values of the series'
width, count quality bytes. Files are read as binary files, one task each, so
any file system that Spark reads will do; the values stay bytes until the
series catalog gives their type. Files are written under a temporary name and
renamed when they are complete; the name comes from the job and the partition,
so a task that is tried again replaces its own files.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from decimal import Decimal
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.functions import values
from slotwise.functions.values import STORAGE
from slotwise.operators import ingest

#: Tags and the largest payload.
TAGS = {1: "WRITE", 2: "FLUSH"}
LARGEST = 100 * 2**20
HEAD = struct.Struct("<BQQQ")
FRAME = struct.Struct("<II")
FRAME_BYTES = FRAME.size
#: NumPy type of each storage type in the log.
DTYPES = {"float32": "<f4", "float64": "<f8", "int32": "<i4", "int64": "<i8", "uint32": "<u4", "uint64": "<u8", "enumeration": "u1"}
SCHEMA = "file string, pos long, len long, crc long, tag string, tx decimal(20,0), series_id decimal(20,0), block_id decimal(20,0), ts array<long>, value_bytes binary, qs array<short>, error string"


class WalError(ValueError):
    """A log file that breaks the format."""


def _table() -> np.ndarray:
    """The byte table of CRC-32C, from its reflected polynomial."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = x >> np.uint32(1) ^ np.where(x & np.uint32(1), np.uint32(0x82F63B78), np.uint32(0))
    return x


_CRC = _table()


def _steps(state: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The states after each row of ``columns``, one byte a step for all."""
    for b in columns:
        state = state >> np.uint32(8) ^ _CRC[(state ^ b) & np.uint32(255)]
    return state


@lru_cache(maxsize=64)
def _past(n: int) -> list[list[int]]:
    """Tables that take a state past n zero bytes, by the bytes of the state:
    the step is linear, so it is known from the 32 single bits."""
    ones = _steps(np.uint32(1) << np.arange(32, dtype=np.uint32), np.zeros((n, 1), np.uint32))
    tables = np.zeros((4, 256), np.uint32)
    for k in range(4):
        for bit in range(8):
            tables[k] ^= np.where(np.arange(256) >> bit & 1, ones[8 * k + bit], np.uint32(0)).astype(np.uint32)
    return tables.tolist()


def crc32c(data: bytes) -> int:
    """The checksum, computed over about sqrt(n) stretches at once, whose
    states are then joined."""
    n = len(data)
    width = max(1, 1 << (n.bit_length() // 2))
    whole = n // width * width
    state = 0xFFFFFFFF
    if whole:
        columns = np.frombuffer(data, np.uint8, whole).reshape(-1, width).T.astype(np.uint32)
        a, b, c, d = _past(width)
        for part in _steps(np.zeros(whole // width, np.uint32), columns).tolist():
            state = a[state & 255] ^ b[state >> 8 & 255] ^ c[state >> 16 & 255] ^ d[state >> 24] ^ part
    for x in data[whole:]:
        state = state >> 8 ^ int(_CRC[(state ^ x) & 255])
    return state ^ 0xFFFFFFFF


def write_payload(tx: int, series: int, block: int, ts, values, qs, storage: str) -> bytes:
    parts = [HEAD.pack(1, tx, series, block), struct.pack("<I", len(ts)), np.asarray(ts, "<u8").tobytes(), np.asarray(values, DTYPES[storage]).tobytes(), np.asarray(qs, "u1").tobytes()]
    return b"".join(parts)


def flush_payload(tx: int, series: int, block: int) -> bytes:
    return HEAD.pack(2, tx, series, block)


def framed(payload: bytes) -> bytes:
    return FRAME.pack(len(payload), crc32c(payload)) + payload


def decoded(payload: bytes, arrays: bool = True) -> dict:
    """The fields of a payload; without ``arrays`` only those of its head."""
    if len(payload) < HEAD.size:
        raise WalError("payload shorter than its head")
    tag, tx, series, block = HEAD.unpack_from(payload)
    if tag not in TAGS:
        raise WalError(f"unknown tag {tag}")
    if not series:
        raise WalError("series 0")
    row = {"tag": TAGS[tag], "tx": tx, "series_id": series, "block_id": block, "ts": None, "value_bytes": None, "qs": None}
    if tag == 1 and arrays:
        (count,) = struct.unpack_from("<I", payload, HEAD.size)
        at = HEAD.size + 4
        rest = len(payload) - at - 9 * count
        if rest < 0 or count and rest % count:
            raise WalError("arrays don't fit the payload")
        ts = np.frombuffer(payload, "<i8", count, at)
        if count and ts.min() < 0:
            raise WalError("time stamp beyond 63 bits")
        row["ts"] = ts
        row["value_bytes"] = payload[at + 8 * count : len(payload) - count]
        row["qs"] = np.frombuffer(payload, "u1", count, len(payload) - count).astype(np.int16)
    return row


def frames(data: memoryview | bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """(position, length, checksum, payload). A short header is the clean end
    of a file; anything else that is short or wrong is an error."""
    at = 0
    while at + FRAME.size <= len(data):
        n, crc = FRAME.unpack_from(data, at)
        payload = bytes(data[at + FRAME.size : at + FRAME.size + n])
        if not 0 < n <= LARGEST:
            raise WalError(f"frame length {n} at {at}")
        if len(payload) < n:
            raise WalError(f"payload cut off at {at}")
        if crc32c(payload) != crc:
            raise WalError(f"bad checksum at {at}")
        yield at, n, crc, payload
        at += FRAME.size + n


def read(spark: SparkSession, path: str, mode: str = "FAILFAST", arrays: bool = True) -> DataFrame:
    """The entries of all log files under ``path``. FAILFAST ends with an error
    at the first broken frame; PERMISSIVE gives a row with ``error`` for it and
    leaves the rest of that file."""
    if mode not in ("FAILFAST", "PERMISSIVE"):
        raise ValueError(f"mode {mode!r}")
    wide = pa.decimal128(20, 0)
    types = {"file": pa.string(), "pos": pa.int64(), "len": pa.int64(), "crc": pa.int64(), "tag": pa.string(), "tx": wide, "series_id": wide, "block_id": wide, "ts": pa.list_(pa.int64()), "value_bytes": pa.binary(), "qs": pa.list_(pa.int16()), "error": pa.string()}

    def column(rows: list[dict], name: str) -> pa.Array:
        given = [r.get(name) for r in rows]
        if name in ("ts", "qs"):
            known = [x if x is not None else np.empty(0, np.int64) for x in given]
            ends = np.cumsum([0, *(len(x) for x in known)]).astype(np.int32)
            flat = pa.array(np.concatenate(known) if known else [], types[name].value_type)
            return pa.ListArray.from_arrays(pa.array(ends), flat, mask=pa.array([x is None for x in given], pa.bool_()))
        return pa.array([None if x is None else Decimal(x) for x in given] if types[name] == wide else given, types[name])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            for path, data in zip(files.column("path").to_pylist(), files.column("content"), strict=True):
                rows, size, last = [], 0, 0
                try:
                    for at, n, crc, payload in frames(memoryview(data.as_buffer())):
                        last = at
                        rows.append({"file": path, "pos": at, "len": n, "crc": crc} | decoded(payload, arrays))
                        last, size = at + FRAME_BYTES + n, size + n
                        if size > 2**24:  # a batch of bounded size
                            yield pa.RecordBatch.from_arrays([column(rows, c) for c in types], list(types))
                            rows, size = [], 0
                except WalError as e:
                    if mode == "FAILFAST":
                        raise
                    rows.append({"file": path, "pos": last, "error": str(e)})
                yield pa.RecordBatch.from_arrays([column(rows, c) for c in types], list(types))

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.log").load(path).select("path", "content").mapInArrow(run, SCHEMA)


def headers(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """The entries' heads, arrays left undecoded."""
    return read(spark, path, mode, arrays=False).select("file", "pos", "len", "crc", "tag", "tx", "series_id", "block_id", "error")


def inspected(log: DataFrame) -> DataFrame:
    """The log for people: checksums in hex, counts instead of arrays."""
    return log.select("file", "pos", "len", F.lower(F.lpad(F.hex("crc"), 8, "0")).alias("crc"), "tag", "tx", "series_id", "block_id", F.size("ts").alias("samples"), "error")


def samples(log: DataFrame, series: DataFrame, kind: str = "real") -> DataFrame:
    """One row a sample of the log's writes to the series of one kind of
    ``values.KINDS``, decoded by their storage type: series_id, block_id, ts_ms,
    value, quality, tx, pos."""
    known = series.where(values.kind_of(F.col("storage_type")) == kind).select(F.col("series_id").cast("decimal(20,0)").alias("series_id"), "storage_type")
    typed = log.where("tag = 'WRITE'").join(known, "series_id")
    longs = [F.col(c).cast("long").alias(c) for c in ("series_id", "block_id", "tx")]
    wide = pa.float64() if kind == "real" else pa.decimal128(20, 0)

    def numbers(data: bytes, storage: str) -> pa.Array:
        x = values_of(data, storage)
        if kind == "real":
            return pa.array(x.astype(np.float64))
        return pa.array([Decimal(v) for v in x.tolist()], wide) if storage == "uint64" else pa.array(x.astype(np.int64)).cast(wide)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (data, storage) in enumerate(zip(batch.column("value_bytes"), batch.column("storage_type").to_pylist(), strict=True)):
                ts, qs = batch.column("ts")[i].values, batch.column("qs")[i].values
                n = len(ts)
                same = [pa.array(np.full(n, batch.column(c)[i].as_py(), np.int64)) for c in ("series_id", "block_id", "tx")]
                yield pa.RecordBatch.from_arrays([same[0], same[1], ts, numbers(data.as_py(), storage), qs.cast(pa.int32()), same[2], pa.array(np.arange(n, dtype=np.int32))], ["series_id", "block_id", "ts_ms", "value", "quality", "tx", "pos"])

    rows = typed.select(*longs, "ts", "value_bytes", "qs", "storage_type")
    return rows.mapInArrow(run, f"series_id long, block_id long, ts_ms long, value {values.KINDS[kind]}, quality int, tx long, pos int")


def values_of(data: bytes, storage: str) -> np.ndarray:
    if len(data) % STORAGE[storage].width:
        raise WalError(f"value bytes don't fit {storage}")
    return np.frombuffer(data, DTYPES[storage])


def _files(folder: str):
    """The file system of a folder, and its path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def write(parts: DataFrame, folder: str, storage: str, rotate_bytes: int = 128 * 2**20) -> DataFrame:
    """Append log files for rows (tag, tx, series_id, block_id, ts, values, qs)
    of one storage type to a folder that all executors share (a path or a URI
    of a file system that pyarrow knows); returns (file, frames). A file is
    closed when it exceeds ``rotate_bytes``. Rows are taken in the order of tx,
    so a task that is tried again writes the same files over its first ones."""
    job = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = _files(folder)
        files.create_dir(at, recursive=True)
        task = TaskContext.get()
        done: list[tuple[str, int]] = []
        out, size, n = None, 0, 0
        hidden = f"{at}/.{job}-{task.partitionId():06d}-{task.taskAttemptId()}"

        def close() -> None:
            out.close()
            name = f"{job}-{task.partitionId():06d}-{len(done):04d}.log"
            files.move(f"{hidden}.{len(done)}", f"{at}/{name}")
            done.append((name, n))

        for batch in batches:
            for r in batch.to_pylist():
                payload = write_payload(r["tx"], r["series_id"], r["block_id"], r["ts"], r["values"], r["qs"], storage) if r["tag"] == "WRITE" else flush_payload(r["tx"], r["series_id"], r["block_id"])
                if out is None:
                    out, size, n = files.open_output_stream(f"{hidden}.{len(done)}"), 0, 0
                frame = framed(payload)
                out.write(frame)
                size, n = size + len(frame), n + 1
                if size > rotate_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in done], pa.string()), pa.array([k for _, k in done], pa.int64())], ["file", "frames"])

    ordered = parts.select("tag", "tx", "series_id", "block_id", "ts", F.col("values").alias("values"), "qs").sortWithinPartitions("tx", "series_id", "block_id", "tag")
    return ordered.mapInArrow(run, "file string, frames long")


def listed(folder: str) -> list[str]:
    """The names of the complete log files in a folder."""
    from pyarrow import fs

    files, at = _files(folder)
    return sorted(f.base_name for f in files.get_file_info(fs.FileSelector(at)) if f.base_name.endswith(".log") and not f.base_name.startswith("."))


def recovered(spark: SparkSession, folder: str, series: DataFrame, stored: DataFrame, kind: str = "real") -> tuple[DataFrame, list[str]]:
    """The stored slots of the series of one kind, merged with the log's writes
    that have no flush mark, and the names of the files that this covers: once
    the slots of every kind are written, ``cleaned`` may remove them."""
    names = listed(folder)
    waiting = samples(ingest.pending(read(spark, folder)), series, kind)
    return ingest.merged(stored, ingest.placed_by_catalog(waiting.drop("block_id"), series)), names


def cleaned(folder: str, names: list[str]) -> None:
    """Remove log files whose writes are stored: those that were listed before
    a recovery or a flush of everything began. Later files stay."""
    files, at = _files(folder)
    for name in names:
        files.delete_file(f"{at}/{name}")
