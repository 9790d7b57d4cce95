"""Tables in a folder of any Hadoop file system: samples, summaries, catalog.

Samples are partitioned by bucket (series_id modulo 100) and sorted by series,
block and slot inside the files, so that row-group statistics prune a read of
one block; a partition a block would be many small files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.functions import grid
from slotwise.operators import ingest
from slotwise.operators.ingest import REQUEST

BUCKETS = 100
ORIGIN = ("file_path", "file_modification_time", "file_block_start")


def with_bucket(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bucket", (F.col("series_id") % BUCKETS).cast("int"))


def write_samples(rows: DataFrame, path: str, compression: str = "zstd", mode: str = "append") -> None:
    """Append placed samples. Rows are dealt by series and block, so a hot
    series spreads over tasks and each block lies in one file."""
    dealt = with_bucket(rows).repartition("series_id", "block_id").sortWithinPartitions("bucket", "series_id", "block_id", "slot")
    dealt.write.mode(mode).option("compression", compression).partitionBy("bucket").parquet(path)


def read_samples(spark: SparkSession, path: str, series_id: int | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if series_id is None else rows.where((F.col("bucket") == series_id % BUCKETS) & (F.col("series_id") == series_id))


def replace_buckets(rows: DataFrame, path: str) -> None:
    """Overwrite the buckets that ``rows`` hold and leave the others alone.
    Readers meanwhile may see either state of a bucket."""
    dealt = with_bucket(rows).repartition("series_id", "block_id").sortWithinPartitions("bucket", "series_id", "block_id", "slot")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def write_table(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def with_object_path(rows: DataFrame) -> DataFrame:
    """Rows with the file that they come from."""
    return rows.withColumn("object_path", F.col("_metadata.file_path"))


def read_requests(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Ingest requests from JSON lines, with where they come from; with
    ``files_per_batch`` as a stream."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else spark.read
    return reader.schema(REQUEST).json(path).select("*", *(f"_metadata.{c}" for c in ORIGIN))


#: Codecs that a series may choose; without a choice it gets the first.
CODECS = ("zstd", "snappy", "gzip", "lz4", "uncompressed")


def write_samples_by_codec(rows: DataFrame, series: DataFrame, path: str) -> None:
    """Append placed samples, each series' with the codec of its catalog row."""
    codec = F.when(F.col("codec").isin(*CODECS), F.col("codec")).otherwise(CODECS[0])
    chosen = series.select("series_id", codec.alias("codec"))
    for name in [r[0] for r in chosen.select("codec").distinct().collect()]:  # a few
        mine = chosen.where(F.col("codec") == name).select("series_id")
        write_samples(rows.join(mine, "series_id", "left_semi"), path, compression=name)


# ---- segments: a file of many blocks, rewritten as a whole


def with_segment(rows: DataFrame, blocks_each: int) -> DataFrame:
    return with_bucket(rows).withColumn("segment", grid.segment_id(F.col("block_id"), blocks_each))


def write_segments(rows: DataFrame, path: str, blocks_each: int, mode: str = "append") -> None:
    """Write placed samples as segments: each series' run of ``blocks_each``
    blocks lies in one file of its bucket's and segment's folder."""
    dealt = with_segment(rows, blocks_each).repartition("series_id", "segment").sortWithinPartitions("bucket", "segment", "series_id", "block_id", "slot")
    dealt.write.mode(mode).option("compression", CODECS[0]).option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "segment").parquet(path)


def rewrite_segments(spark: SparkSession, path: str, new: DataFrame, blocks_each: int) -> None:
    """Backfill by copy on write: the segments that ``new`` touches are read,
    merged under last-write-wins and written anew; others stay as they are.
    The new content is complete, in a table of its own, before a segment is
    replaced, so that a lost executor never leaves half of one."""
    touched = with_segment(new, blocks_each).select("bucket", "segment").distinct()
    names = ["series_id", "block_id", "slot", "value", "quality", "tx", "pos"]
    stored = spark.read.parquet(path).join(touched, ["bucket", "segment"], "left_semi").select(names)
    merged = ingest.merged(stored, new)
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    merged.write.parquet(staged)
    write_segments(spark.read.parquet(staged), path, blocks_each, mode="overwrite")
