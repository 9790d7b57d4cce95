import pytest
from pyspark.sql import functions as F

from slotwise.functions import grid, quality, values
from slotwise.sources import generator

S, M, H = 1000, 60_000, 3_600_000
DERIVED = [(1, S, 1000), (5, 5 * S, 1000), (10, 15 * S, 1500), (100, M, 600), (250, 5 * M, 1200), (S, 30 * M, 1800), (5 * S, H, 720), (7 * S, H, 515), (10 * S, 2 * H, 720), (15 * S, 6 * H, 1440), (30 * S, 12 * H, 1440), (M, 24 * H, 1440), (5 * M, 144 * H, 1728), (7 * M, 144 * H, 1235), (15 * M, 288 * H, 1152), (H, 1152 * H, 1152), (2 * H, 2048 * H, 1024)]


def test_derived_blocks(spark):
    rows = spark.createDataFrame([(n,) for n, _, _ in DERIVED], "sample_ms long").withColumn("block_ms", grid.derived_block_ms(F.col("sample_ms")))
    found = rows.select("sample_ms", "block_ms", grid.block_slots(F.col("block_ms"), F.col("sample_ms"))).collect()
    assert sorted(map(tuple, found)) == DERIVED


def test_block_boundaries(spark):
    block, sample = 86_400_000, 60_000
    rows = spark.createDataFrame([(5 * block - 1,), (5 * block,), (0,)], "ts long").select(grid.block_id(F.col("ts"), block), grid.slot(F.col("ts"), block, sample)).collect()
    assert [tuple(r) for r in rows] == [(4, 1439), (5, 0), (0, 0)]
    partial = spark.createDataFrame([(3599 * S,)], "ts long").select(grid.slot(F.col("ts"), H, 7 * S)).first()[0]
    assert partial == 514


def test_segments_are_aligned(spark):
    each = grid.segment_blocks(1440, 8)
    assert each == 128 * 2**20 // (1440 * 9) and grid.segment_blocks(10**9, 8) == 1
    assert [r[0] for r in spark.createDataFrame([(0,), (each - 1,), (each,)], "b long").select(grid.segment_id(F.col("b"), each)).collect()] == [0, 0, 1]


def test_quality_bits(spark):
    row = spark.createDataFrame([(203,)], "q int").select(quality.bits(F.col("q")), quality.debug_name(F.col("q")), quality.sub_status(F.col("q")), quality.limit(F.col("q"))).first()
    assert tuple(row) == ("11_0010_11", "Good", 2, 3)


@pytest.mark.parametrize(("storage", "total"), [("float64", 4950.0), ("int32", 4950), ("int64", 4950), ("uint32", 4950), ("uint64", 4950), ("enumeration", 4950)])
def test_ramp_sum(spark, storage, total):
    rows = generator.generate(spark, 1, 100, "ramp", storage)
    assert rows.select(values.exact_sum(F.col("value"), storage)).first()[0] == total
    assert rows.agg(F.min("value"), F.max("value")).first() == (0, 99)


def test_wide_sums_are_exact(spark):
    rows = spark.sql("SELECT 9223372036854775807 AS v UNION ALL SELECT 9223372036854775807")
    assert int(rows.select(values.exact_sum(F.col("v"), "int64")).first()[0]) == 2 * (2**63 - 1)
    rows = spark.sql("SELECT CAST(18446744073709551615 AS DECIMAL(20,0)) AS v UNION ALL SELECT CAST(18446744073709551615 AS DECIMAL(20,0))")
    assert int(rows.select(values.exact_sum(F.col("v"), "uint64")).first()[0]) == 2 * (2**64 - 1)


def test_ranges_and_nan(spark):
    rows = spark.createDataFrame([(255,), (256,), (-1,)], "v int").select(values.in_range(F.col("v"), "enumeration")).collect()
    assert [r[0] for r in rows] == [True, False, False]
    assert spark.sql("SELECT double('NaN') AS v").select(values.in_range(F.col("v"), "float64")).first()[0] is False


def test_casts(spark):
    rows = spark.createDataFrame([(-1.58,)], "raw double").select(*(values.from_raw(F.col("raw"), t) for t in ("int32", "uint32", "enumeration"))).first()
    assert tuple(rows) == (-1, 1, 1)


def test_unknown_pattern(spark):
    with pytest.raises(ValueError, match="unknown pattern"):
        generator.generate(spark, 1, 1, "square")


def test_requests_round_trip(spark):
    from slotwise.operators import ingest

    rows = generator.generate(spark, 7, 25, "ramp", "float64")
    requests = generator.as_requests(rows, "float64", 10).withColumn("tx", F.col("ts")[0])
    assert requests.count() == 3
    assert sorted(r["ts_ms"] for r in ingest.samples(requests).collect()) == [1000 * i for i in range(25)]
