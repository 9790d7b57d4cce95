import itertools
import random

import pytest
from pyspark.sql import functions as F

from slotwise.functions import slices
from slotwise.operators import blocks, catalog, ingest, ranges
from slotwise.operators.errors import RequestError

BLOCK, SAMPLE, SLOTS = 10_000, 1000, 10
ROW = "series_id long, ts_ms long, value double, quality int, tx long, pos int"


def placed(spark, rows):
    return ingest.placed(spark.createDataFrame(rows, ROW), BLOCK, SAMPLE)


def slots(spark, rows):
    return ingest.last_writes(placed(spark, rows))


def test_last_write_wins(spark):
    found = slots(spark, [(1, 5000, 1.0, 192, 1, 0), (1, 5000, 2.0, 192, 1, 1), (1, 5001, 3.0, 192, 1, 2), (1, 6000, 9.0, 192, 2, 0), (1, 6999, 4.0, 192, 1, 3)]).orderBy("slot").collect()
    assert [(r["slot"], r["value"]) for r in found] == [(5, 3.0), (6, 9.0)]


def test_any_order_of_arrival_gives_one_result(spark):
    rows = [(s, t * 700, float(x), q, tx, p) for x, (s, t, q, tx, p) in enumerate(itertools.product((1, 2), range(5), (192,), (1, 2), (0,)))]
    first = sorted(map(tuple, slots(spark, rows).collect()))
    random.Random(1).shuffle(rows)
    assert sorted(map(tuple, slots(spark, rows).collect())) == first
    # a replay changes nothing
    assert sorted(map(tuple, ingest.merged(slots(spark, rows), placed(spark, rows[:7])).collect())) == first


def test_backfill_and_delete(spark):
    stored = slots(spark, [(1, t, 1.0, 192, 1, t) for t in range(0, 60_000, 1000)])
    late = placed(spark, [(1, 12_000, 5.0, 192, 2, 0), (1, 13_000, 0.0, 128, 2, 1)])
    old, new = blocks.summaries(stored, SLOTS), blocks.summaries(ingest.merged(stored, late), SLOTS)
    changed = new.exceptAll(old).collect()
    assert [r["block_id"] for r in changed] == [1]
    assert (changed[0]["count_non_missing"], changed[0]["count_valid"], float(changed[0]["sum_val"])) == (9, 9, 13.0)
    assert [(r["tx"], r["is_overwritten"]) for r in ingest.with_overwritten(placed(spark, [(1, 0, 1.0, 192, 1, 0), (1, 1, 1.0, 192, 2, 0)])).orderBy("tx").collect()] == [(1, True), (2, False)]


@pytest.mark.parametrize(("ts", "qs", "values", "reason"), [
    ([1, 2], [192, 192], [1.0, 2.0], None), ([2, 2], [192, 192], [1.0, 2.0], None), ([1], [], [1.0, 2.0], "length mismatch"), ([1, 2], [192, 192], [1.0], "length mismatch"),
    ([1, 2], [192], [1.0, 2.0], "length mismatch"), ([], [], [], "no timestamps"), ([2, 1], [192, 192], [1.0, 2.0], "timestamps not sorted"), ([1], [192], [float("nan")], "bad element"),
    ([1], [300], [1.0], "bad element"), (None, [192], [1.0], "missing array"), ([None], [192], [1.0], "bad element"),
])
def test_validation(spark, ts, qs, values, reason):
    rows = spark.createDataFrame([(1, 1, "F64", ts, qs, values)], "tx long, " + ingest.REQUEST.replace("values array<string>", "values array<double>"))
    assert rows.select(ingest.refusal()).first()[0] == reason
    text = rows.withColumn("values", F.col("values").cast("array<string>"))
    assert text.select(ingest.refusal(text=True)).first()[0] == reason


@pytest.mark.parametrize(("tag", "value", "good"), [
    ("Enum", "255", True), ("Enum", "300", False), ("Enum", "-3", False), ("I32", "1.5", False), ("I32", "1000000000000", False), ("I32", "-2147483648", True), ("I64", "9223372036854775807", True),
    ("I64", "9223372036854775808", False), ("U64", "18446744073709551615", True), ("U64", "-1", False), ("U32", "4294967296", False), ("F64", "1e300", True), ("F32", "1e300", False), ("F64", "NaN", False), ("F64", "x", False),
])
def test_values_fit_their_type(spark, tag, value, good):
    rows = spark.createDataFrame([(1, 1, tag, [1], [192], [value])], "tx long, " + ingest.REQUEST)
    assert rows.select(ingest.refusal(text=True)).first()[0] == (None if good else "bad element")
    if value not in ("x", "9223372036854775808", "18446744073709551615"):
        numbers = rows.withColumn("values", F.col("values").cast("array<double>"))
        assert numbers.select(ingest.refusal()).first()[0] == (None if good or value == "9223372036854775807" else "bad element") or value == "9223372036854775807"


def test_lookup(spark):
    series = spark.createDataFrame([(1, "float64")], "series_id long, storage_type string")
    rows = spark.createDataFrame([(1, 1, "f64", [1], [192], ["1.0"]), (2, 1, "I32", [1], [192], ["1"]), (3, 9, "F64", [1], [192], ["1.0"])], "tx long, " + ingest.REQUEST)
    assert [r["reason"] for r in ingest.validated(rows, series).orderBy("tx").collect()] == [None, "type mismatch", "unknown series"]


def test_summary_edges(spark):
    bad = blocks.compat(blocks.summaries(slots(spark, [(1, 3000, 5.0, 0, 1, 0)]), SLOTS)).first()
    assert (bad["count_valid"], bad["count_non_missing"], bad["min_val"], bad["fst_offset"], bad["fst_valid_offset"], bad["qual_acc_or"]) == (0, 1, 0.0, 3, 4294967295, 2 | 8)
    gone = blocks.compat(blocks.summaries(slots(spark, [(1, 3000, 5.0, 128, 1, 0)]), SLOTS)).first()
    assert (gone["qual_acc_or"], gone["qual_acc_and"], gone["fst_offset"], gone["lst_offset"], gone["fst_q"]) == (8, 8, 4294967295, 0, 128)
    full = blocks.summaries(slots(spark, [(1, t * 1000, 1.0, 192, 1, t) for t in range(10)]), SLOTS).first()
    assert (full["qual_acc_or"], full["qual_acc_and"]) == (1, 1)


def test_densify_and_back(spark):
    rows = slots(spark, [(1, 3000, 5.0, 192, 1, 0), (1, 7000, 6.0, 64, 1, 1), (2, 1000, 1.0, 0, 1, 0)])
    dense = blocks.dense_arrays(rows, SLOTS)
    assert all(len(r["values"]) == SLOTS for r in dense.collect())
    assert sorted(map(tuple, blocks.sparse(dense).collect())) == sorted(map(tuple, rows.select("series_id", "block_id", "slot", "value", "quality").collect()))
    assert blocks.read_block(rows, 9, 0, SLOTS).count() == 0
    series = spark.createDataFrame([(1, "float64"), (2, "float64")], "series_id long, storage_type string")
    text = blocks.block_json(blocks.summaries(rows, SLOTS), dense, series).where("series_id = 2").first()["block"]
    assert text.startswith('{"F64Block":[{"count_non_missing":1') and text.endswith("[128,0,128,128,128,128,128,128,128,128]]}")
    more = blocks.densified(rows, SLOTS, spark.createDataFrame([(1, 0), (5, 5)], "series_id long, block_id long"))
    assert more.count() == 3 * SLOTS and {tuple(r) for r in more.where("series_id = 5").select("value", "quality").collect()} == {(0.0, 128)}
    with pytest.raises(RequestError) as e:
        blocks.wanted_block(rows, 9, 0)
    assert e.value.status == 404 == ingest.STATUS["unknown block"]


def test_sums_keep_their_digits(spark):
    """Small, large and 64-bit whole values: no sum is rounded to some decimals."""
    small = blocks.summaries(slots(spark, [(1, t * 1000, 0.004, 192, 1, t) for t in range(10)]), SLOTS).first()
    assert small["sum_val"] == pytest.approx(0.04, rel=1e-12)
    large = slots(spark, [(1, 0, 1e300, 192, 1, 0), (1, 1000, 1e300, 192, 1, 1)])
    assert blocks.summaries(large, SLOTS).first()["sum_val"] == 2e300
    assert ranges.aggregate(large, 0, 10_000, BLOCK, SAMPLE).first()["avg_val"] == 1e300
    whole = large.withColumn("value", F.lit(2**63 - 1).cast("long"))
    assert int(blocks.summaries(whole, SLOTS).first()["sum_val"]) == 2 * (2**63 - 1)
    wide = large.withColumn("value", F.lit(str(2**64 - 1)).cast("decimal(20,0)"))
    assert int(ranges.aggregate_from_summaries(blocks.summaries(wide, SLOTS), wide, 0, 10_000, BLOCK, SAMPLE).first()["sum_val"]) == 2 * (2**64 - 1)


@pytest.mark.parametrize(("low", "high"), [(0, 60_000), (3500, 47_200), (10_000, 20_000), (12_000, 13_000), (9_999, 10_001), (5_000, 25_000)])
def test_fold_law(spark, low, high):
    r = random.Random(low)
    rows = slots(spark, [(r.choice((1, 2)), r.randrange(60_000), round(r.random() * 9, 2), r.choice((192, 64, 0, 128)), i, 0) for i in range(80)])
    full = ranges.aggregate(rows, low, high, BLOCK, SAMPLE)
    fast = ranges.aggregate_from_summaries(blocks.summaries(rows, SLOTS), rows, low, high, BLOCK, SAMPLE)
    assert sorted(map(str, full.collect())) == sorted(map(str, fast.collect()))


def test_slices_hold_their_order(spark):
    r = random.Random(4)
    rows = spark.createDataFrame([(10**12 if i == 0 else r.randrange(50), i) for i in range(1000)], "t long, i long")
    points = slices.cuts(rows, ("t", "i"), 50)
    found = rows.withColumn("slice", slices.slice_of(("t", "i"), points)).collect()
    assert all(x["slice"] == sum(p <= (x["t"], x["i"]) for p in points) for x in found)
    sizes = [sum(x["slice"] == k for x in found) for k in range(len(points) + 1)]
    assert len(sizes) == 20 and max(sizes) <= 51
    assert slices.cuts(rows.limit(0), ("t", "i"), 50) == []


def test_routes_and_versions(spark, monkeypatch):
    parts = spark.createDataFrame([(1, 1, 5), (1, 2, 5), (1, 3, 6), (1, 4, 2)], "series_id long, tx long, block_id long")
    assert [r["route"] for r in ingest.routed(parts).orderBy("tx").collect()] == ["start", "append", "rotate", "cold"]
    r = random.Random(3)
    many = spark.createDataFrame([(r.choice((1, 1, 1, 2)), tx, r.randrange(30)) for tx in range(400)], "series_id long, tx long, block_id long")
    whole = sorted(map(tuple, ingest.routed(many).collect()))
    monkeypatch.setattr(ingest, "ROUTE_ROWS", 7)
    assert sorted(map(tuple, ingest.routed(many).collect())) == whole
    catalog_rows = spark.createDataFrame([(1, 5, 1, "a"), (1, 5, 2, "b")], "series_id long, block_id long, version long, object_key string")
    assert [(r["previous_key"], r["is_current"]) for r in blocks.version_chain(catalog_rows).orderBy("version").collect()] == [(None, False), ("a", True)]
    assert blocks.upserted(catalog_rows.where("version = 1"), catalog_rows.where("version = 2")).first()["object_key"] == "b"


def test_labels(spark):
    rows = spark.createDataFrame([([("b", "1"), ("a", "1"), ("a", "2")],), (None,), ([],)], f"labels {catalog.LABELS}")
    assert [[tuple(x) for x in r[0]] for r in rows.select(catalog.normalized_labels(F.col("labels"))).collect()] == [[("a", "2"), ("b", "1")], [], []]
    with pytest.raises(catalog.CatalogError):
        catalog.match_all(rows, [])
    with pytest.raises(catalog.CatalogError):
        catalog.checked(None, None)


def test_names(spark):
    rows = spark.createDataFrame([("temp_1",), ("1temp",), ("a-b",), ("",), ("temp\n",), (None,)], "n string")
    assert [r[0] for r in rows.select(catalog.valid_name(F.col("n"))).collect()] == [True, False, False, False, False, False]
