import json
import os
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from slotwise.operators import blocks, ingest
from slotwise.sources import store, wal
from slotwise.streaming import ingest as stream


def test_checksum():
    assert wal.crc32c(b"123456789") == 0xE3069283 and wal.crc32c(b"") == 0 and wal.crc32c(bytes(32)) == 0x8A9136AA
    r = random.Random(1)
    for n in (1, 2, 3, 15, 16, 17, 100, 1023, 5000):
        data, state = r.randbytes(n), 0xFFFFFFFF
        for b in data:  # bit by bit
            state ^= b
            for _ in range(8):
                state = state >> 1 ^ (0x82F63B78 if state & 1 else 0)
        assert wal.crc32c(data) == state ^ 0xFFFFFFFF


def entry(tx, series=7, block=3, values=(1.5, 2.5)):
    return wal.framed(wal.write_payload(tx, series, block, [1000 * (i + 1) for i in range(len(values))], values, [192] * len(values), "float64"))


def test_log_round_trip_and_recovery(spark, tmp_path):
    # the flush mark of 2 lies in a file that may be read before its write
    (tmp_path / "a.log").write_bytes(wal.framed(wal.flush_payload(2, 7, 3)) + entry(1))
    (tmp_path / "b.log").write_bytes(entry(2, values=(3.5, 4.5)) + b"\x01\x02")  # a short header ends a file
    log = wal.read(spark, str(tmp_path))
    assert log.count() == 3
    assert [int(r["tx"]) for r in ingest.pending(log).collect()] == [1]
    series = spark.createDataFrame([(7, "float64")], "series_id long, storage_type string")
    rows = wal.samples(log, series)
    assert sorted((r["tx"], r["ts_ms"], r["value"]) for r in rows.collect()) == [(1, 1000, 1.5), (1, 2000, 2.5), (2, 1000, 3.5), (2, 2000, 4.5)]
    placed = rows.withColumn("slot", (F.col("ts_ms") / 1000).cast("int"))
    stored = ingest.last_writes(placed)
    assert sorted(r["value"] for r in ingest.merged(stored, placed.where("tx = 1")).collect()) == [3.5, 4.5]
    heads = wal.headers(spark, str(tmp_path)).where("tag = 'FLUSH'").first()
    assert (int(heads["tx"]), heads["len"]) == (2, 25)
    assert wal.inspected(log).where("tag = 'WRITE'").first()["samples"] == 2


@pytest.mark.parametrize("data", [b"\x00" * 8, b"\xff\xff\xff\xff" + b"\x00" * 4, entry(1)[:-1], entry(1)[:-1] + b"\x00", wal.framed(b"\x09" + b"\x00" * 24), wal.framed(wal.flush_payload(1, 0, 1)), wal.framed(b"\x01")])
def test_broken_logs(spark, tmp_path, data):
    (tmp_path / "x.log").write_bytes(entry(5) + data)
    found = wal.read(spark, str(tmp_path), mode="PERMISSIVE").orderBy("pos").collect()
    assert found[0]["error"] is None and found[1]["error"]
    with pytest.raises(Exception, match="frame|payload|checksum|tag|series"):
        wal.read(spark, str(tmp_path)).collect()


def test_log_sink(spark, tmp_path):
    parts = spark.createDataFrame([("WRITE", 1, 7, 3, [1000], [2.5], [192]), ("FLUSH", 1, 7, 3, None, None, None)], "tag string, tx long, series_id long, block_id long, ts array<long>, values array<double>, qs array<int>")
    written = wal.write(parts, str(tmp_path), "float64", rotate_bytes=10).collect()
    assert sum(r["frames"] for r in written) == 2
    assert wal.read(spark, str(tmp_path)).count() == 2
    assert sorted(wal.listed(str(tmp_path))) == sorted(p.name for p in tmp_path.iterdir())


def test_log_of_whole_numbers_and_cleaning(spark, tmp_path):
    """64-bit integers come back as they were; after a recovery the files that
    were there are removed, and later ones stay."""
    folder, top = str(tmp_path / "log"), 2**64 - 1
    parts = spark.createDataFrame([("WRITE", 1, 7, 0, [1000, 2000], [Decimal(top), Decimal(5)], [192, 64])], "tag string, tx long, series_id long, block_id long, ts array<long>, values array<decimal(20,0)>, qs array<int>")
    wal.write(parts, folder, "uint64").collect()
    series = spark.createDataFrame([(7, "uint64"), (8, "float64")], "series_id long, storage_type string")
    log, names = wal.read(spark, folder), wal.listed(folder)
    rows = wal.samples(ingest.pending(log), series, "whole")
    assert sorted((int(r["value"]), r["quality"]) for r in rows.collect()) == [(5, 64), (top, 192)]
    assert wal.samples(log, series, "real").count() == 0
    geometry = spark.createDataFrame([(7, "uint64", 10, "s", 1, "s")], GEOMETRY)
    stored = spark.createDataFrame([(7, 0, 1, Decimal(3), 192, 0, 0), (7, 0, 9, Decimal(4), 192, 0, 0)], "series_id long, block_id long, slot int, value decimal(20,0), quality int, tx long, pos int")
    merged, covered = wal.recovered(spark, folder, geometry, stored, "whole")
    assert sorted((r["slot"], int(r["value"])) for r in merged.collect()) == [(1, top), (2, 5), (9, 4)] and covered == names
    (tmp_path / "log" / "later.log").write_bytes(entry(9))
    wal.cleaned(folder, names)
    assert wal.listed(folder) == ["later.log"] and [int(r["tx"]) for r in wal.read(spark, folder).collect()] == [9]


def test_segments(spark, tmp_path):
    """A segment is one file; late samples rewrite their own segments only."""
    kinds = "series_id long, block_id long, slot int, value double, quality int, tx long, pos int"
    rows = spark.createDataFrame([(s, b, i, 1.0, 192, 1, i) for s in (1, 2) for b in range(6) for i in range(3)], kinds)
    path = str(tmp_path / "segments")
    store.write_segments(rows, path, 3)
    files = lambda: {(r["bucket"], r["segment"], r["object_path"]) for r in store.with_object_path(spark.read.parquet(path)).select("bucket", "segment", "object_path").distinct().collect()}
    before = files()
    assert len(before) == 4
    late = spark.createDataFrame([(1, 4, 0, 9.0, 192, 2, 0), (1, 9, 0, 5.0, 192, 2, 0)], kinds)
    store.rewrite_segments(spark, path, late, 3)
    after = files()
    assert {x for x in before if x[:2] != (1, 1)} < after and len(after) == 5
    found = spark.read.parquet(path)
    assert found.count() == 37 and sorted(r["value"] for r in found.where("series_id = 1 and block_id = 4").collect()) == [1.0, 1.0, 9.0]


def test_codec_of_a_series(spark, tmp_path):
    rows = spark.createDataFrame([(s, 0, 0, 1.0, 192, 1, 0) for s in (1, 2, 3)], "series_id long, block_id long, slot int, value double, quality int, tx long, pos int")
    series = spark.createDataFrame([(1, "gzip"), (2, None), (3, "odd")], "series_id long, codec string")
    store.write_samples_by_codec(rows, series, str(tmp_path))
    names = {int(str(p.parent).rsplit("=", 1)[1]): p.name.split(".")[-2] for p in tmp_path.rglob("*.parquet")}
    assert names == {1: "gz", 2: "zstd", 3: "zstd"} and spark.read.parquet(str(tmp_path)).count() == 3


def test_store(spark, tmp_path):
    rows = spark.createDataFrame([(s, b, i, float(i), 192, 1, i) for s in (1, 101, 2) for b in (0, 1) for i in range(5)], "series_id long, block_id long, slot int, value double, quality int, tx long, pos int")
    path = str(tmp_path / "samples")
    store.write_samples(rows, path)
    assert store.read_samples(spark, path, 101).count() == 10
    plan = store.read_samples(spark, path, 101)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(series_id), EqualTo(series_id,101)" in plan
    store.replace_buckets(store.read_samples(spark, path, 2).drop("bucket").where("block_id = 0"), path)
    assert spark.read.parquet(path).groupBy("series_id").count().orderBy("series_id").collect() == [(1, 10), (2, 5), (101, 10)]


def test_stream_equals_batch(spark, tmp_path):
    source, folder = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    series = spark.createDataFrame([(1, "float64", 10, "s", 1, "s")], "series_id long, storage_type string, block_len long, block_res string, sample_len long, sample_res string")
    requests = [{"series": 1, "ts": [t, t + 1000], "qs": [192, 64], "type": "F64", "values": [t / 1000, 1.0]} for t in (50_000, 52_000, 1000, 30_000)] + [{"series": 9, "ts": [1], "qs": [192], "type": "F64", "values": [1.0]}, {"series": 1, "ts": [2, 1], "qs": [192, 192], "type": "F64", "values": [1.0, 1.0]}]
    for i, r in enumerate(requests):  # one file a batch: late blocks arrive after newer ones
        (source / f"{i}.json").write_text(json.dumps(r))
        query = stream.start(spark, str(source), series, str(folder), str(tmp_path / "ck"), once=True)
        query.awaitTermination()
    stored = ingest.last_writes(spark.read.parquet(f"{folder}/real/samples"))
    expected = blocks.summaries(stored, 10)
    now = stream.current_summaries(spark, str(folder)).drop("version")
    assert sorted(map(str, now.select(expected.columns).collect())) == sorted(map(str, expected.collect()))
    assert sorted(r["reason"] for r in spark.read.parquet(f"{folder}/rejects").collect()) == ["timestamps not sorted", "unknown series"]
    assert now.count() == 3


GEOMETRY = "series_id long, storage_type string, block_len long, block_res string, sample_len long, sample_res string"


def test_requests_of_one_batch_keep_their_order(spark, tmp_path):
    """Two requests in one file, and two files of one batch, that write one
    slot: the later one wins. 64-bit integers stay whole."""
    source, folder = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    series = spark.createDataFrame([(1, "float64", 10, "s", 1, "s"), (2, "uint64", 10, "s", 1, "s")], GEOMETRY)
    line = lambda s, t, kind, v: json.dumps({"series": s, "ts": [t], "qs": [192], "type": kind, "values": [v]})
    for name, when, values in (("b", 1_000_000_000, (7.0, 8.0, 3.0)), ("a", 1_000_000_060, (1.0, 9.0, 2.0))):
        path = source / f"{name}.json"
        path.write_text("\n".join([*(line(1, 1000, "F64", v) for v in values), line(2, 5000, "U64", 2**64 - 1)]))
        os.utime(path, (when, when))
    stream.start(spark, str(source), series, folder, str(tmp_path / "ck"), once=True).awaitTermination()
    assert [r["value"] for r in ingest.last_writes(spark.read.parquet(f"{folder}/real/samples")).collect()] == [2.0]
    assert int(stream.current_summaries(spark, folder, "whole").first()["max_val"]) == 2**64 - 1


def test_a_batch_tried_again_changes_nothing(spark, tmp_path):
    folder = str(tmp_path / "out")
    series = spark.createDataFrame([(1, "float64", 10, "s", 1, "s")], GEOMETRY)
    rows = [(1, "F64", [1000], [192], ["1.5"], "f1", None, 0), (1, "F64", [1000], [192], ["2.5"], "f1", None, 0), (9, "F64", [1], [192], ["1"], "f2", None, 0)]
    batch = spark.createDataFrame(rows, ingest.REQUEST + ", file_path string, file_modification_time timestamp, file_block_start long").coalesce(1)
    states = []
    for _ in range(2):
        stream.accept(batch, 5, series, folder)
        states.append((stream.current_summaries(spark, folder).collect(), spark.read.parquet(f"{folder}/rejects").collect()))
    assert states[0] == states[1] and states[0][0][0]["max_val"] == 2.5 and len(states[0][1]) == 1
    with pytest.raises(ValueError, match="files_per_batch"):
        stream.start(spark, folder, series, folder, folder, files_per_batch=0)


def test_a_batch_reads_only_the_batches_that_it_is_late_for(spark, tmp_path):
    """The samples of a batch whose block no later batch touches can't be read
    any more; late data still meets all that its own block holds."""
    folder = str(tmp_path / "out")
    series = spark.createDataFrame([(1, "float64", 10, "s", 1, "s")], GEOMETRY)
    schema = ingest.REQUEST + ", file_path string, file_modification_time timestamp, file_block_start long"
    taken = lambda i, *ts: stream.accept(spark.createDataFrame([(1, "F64", [t], [192], [f"{t}.5"], "f", None, 0) for t in ts], schema).coalesce(1), i, series, folder)
    taken(0, 1000)
    for file in (tmp_path / "out/real/samples").rglob("part-*.parquet"):
        file.write_bytes(b"unreadable")
    taken(1, 51_000, 61_000)
    taken(2, 71_000)
    taken(3, 52_000, 63_000)
    taken(4, 53_000, 51_000)
    found = stream.current_summaries(spark, folder).orderBy("block_id").select("block_id", "version", "count_valid", "min_val", "max_val").collect()
    assert [tuple(r) for r in found] == [(0, 0, 1, 1000.5, 1000.5), (5, 4, 3, 51_000.5, 53_000.5), (6, 3, 2, 61_000.5, 63_000.5), (7, 2, 1, 71_000.5, 71_000.5)]


def test_a_batch_is_kept_in_as_many_parts_as_there_are_cores(spark, tmp_path, monkeypatch):
    """However many shuffle partitions the session has."""
    kept, validated = [], ingest.validated
    monkeypatch.setattr(ingest, "validated", lambda *a: kept.append(validated(*a)) or kept[-1])
    series = spark.createDataFrame([(1, "float64", 10, "s", 1, "s")], GEOMETRY)
    schema = ingest.REQUEST + ", file_path string, file_modification_time timestamp, file_block_start long"
    monkeypatch.setattr(store, "write_samples", lambda *a: kept.append(kept[0].rdd.getNumPartitions()) or store.write_table(a[0].withColumn("bucket", F.lit(1)), a[1]))
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        stream.accept(spark.createDataFrame([(1, "F64", [1000], [192], ["1.5"], "f", None, 0)], schema), 0, series, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert kept[1] == spark.sparkContext.defaultParallelism


def test_ingest_reads_a_stored_catalog(spark, monkeypatch):
    """Not one that is derived from all events again in every batch."""
    from slotwise.plans import catalog_queries

    used = []
    for name, place in (("start", 2), ("load", 2)):
        real = getattr(stream, name)
        monkeypatch.setattr(stream, name, lambda *a, real=real, place=place, **k: used.append(a[place].inputFiles()) or real(*a, **k))
    for name in ("stream_ingest", "batch_ingest", "stream_whole_numbers"):
        catalog_queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(used) == 4 and all("/catalog/" in file for files in used for file in files) and all(used)
