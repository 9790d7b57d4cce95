"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SALTS = 256  # parts that a block's rows are dealt to before they are added up


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH_ROWS = 1000  # rows that a Python worker holds at a time; texts may be long


def small_batches(spark: SparkSession) -> None:
    """Have rows go to Python workers ``BATCH_ROWS`` at a time, unless the
    session asks for fewer: at Spark's 10,000 whole texts fill the memory
    beside an executor's heap."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def documents(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty), and further columns by name; whatever
    else the input holds, clashing names included, stays out of the operator."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def shared_folder(spark: SparkSession) -> str:
    """The folder of long-lived intermediate results, from the session's
    spark.checkpoint.dir. A local one is made only for a local session without
    that setting, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df`` marked for a broadcast if it has at most ``most`` rows; a larger
    one is joined through a shuffle. Its rows must be of bounded size."""
    return F.broadcast(df) if df.count() <= most else df


def joined_to_key(rows: DataFrame, few: DataFrame, key: str, sizes: DataFrame, each: int = 100_000) -> DataFrame:
    """``rows`` joined to the one row that ``few`` has for their key. ``sizes``
    (key, n) tells how many rows a key has: those of a key with more than
    ``each`` are dealt to several tasks. At most one key in ``each`` rows is
    such, which bounds what is broadcast. ``rows`` should be checkpointed, so that
    a task that is tried again deals them alike."""
    hot = F.broadcast(sizes.where(F.col("n") > each).select(key, F.ceil(F.col("n") / each).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    left = rows.join(hot, key, "left").withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), parts)).drop("parts")
    right = few.join(hot, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1))).drop("parts")
    return left.join(right, [key, "salt"]).drop("salt")


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def added(per_task: DataFrame) -> dict[int, np.ndarray]:
    """The sums over all tasks of (block, values): arrays of float64 as bytes,
    of one fixed length a block. The number of blocks must be bounded. Rows are
    added as they stream by, in two steps, so that a block's rows from very
    many tasks neither meet in one group nor in one task."""
    kinds = "block int, values binary"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, values in zip(batch.column("block").to_pylist(), batch.column("values"), strict=True):
                x = np.frombuffer(values.as_buffer())
                total[block] = total[block] + x if block in total else x.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["block", "values"])

    dealt = per_task.withColumn("salt", F.spark_partition_id() % SALTS).repartition("block", "salt").select("block", "values")
    sums = dealt.mapInArrow(add, kinds).repartition("block").mapInArrow(add, kinds)
    return {row["block"]: np.frombuffer(row["values"]) for row in sums.collect()}


def blocks_of(total: np.ndarray) -> pa.RecordBatch:
    """A task's rows (block, values) for ``added``; one row of ``total`` each."""
    total = np.atleast_2d(total).astype(np.float64)
    return pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], ["block", "values"])
