"""Continuous ingest: request files in, samples and block summaries out.

Late data is never dropped, so there is no watermark: each micro-batch appends
its accepted samples, then recomputes the summaries of the blocks that it
touched from all their samples. Samples lie in a folder for each batch, and the
summaries so far tell which batches hold a block, so that a batch reads its own
samples and those of the batches that it is late for, not the whole store. The
catalog is read again in every batch and should be a stored table. Requests are ordered by arrival: by batch, by
the time and path of their file, and by their place in it. The order is the
same when a batch is tried again, so appending its samples twice changes
nothing: a slot goes to the largest (tx, pos), and a repeated write has the
same. Series of floats and of whole numbers are kept apart (``values.KINDS``),
so that 64-bit integers stay exact.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from slotwise.functions import grid, values
from slotwise.operators import blocks, ingest
from slotwise.sources import store

MOST_FILES = 1000  # in a batch
STEP = 2**30  # requests in a file, at most


def arrived(batch: DataFrame, batch_id: int) -> DataFrame:
    """The batch with ``tx``, which rises in the order of arrival. The windows
    run over the batch's files, and over the requests of one file. A batch of
    more files than ``MOST_FILES`` is refused, as their numbers would run into
    those of the next batch."""
    by_time = Window.orderBy("file_modification_time", "file_path")
    files = batch.select("file_modification_time", "file_path").distinct().withColumn("number", F.row_number().over(by_time))
    if files.limit(MOST_FILES + 1).count() > MOST_FILES:
        raise ValueError(f"a batch of more than {MOST_FILES} files")
    in_file = Window.partitionBy("file_path").orderBy("file_block_start", "place")
    rows = batch.withColumn("place", F.monotonically_increasing_id()).withColumn("row", F.row_number().over(in_file))
    tx = F.lit(batch_id).cast("long") * (1024 * STEP) + F.col("number").cast("long") * STEP + F.col("row")
    return rows.join(F.broadcast(files.select("file_path", "number")), "file_path").withColumn("tx", tx).select("tx", "series", "type", "ts", "qs", "values")


def accept(batch: DataFrame, batch_id: int, series: DataFrame, folder: str) -> None:
    """One micro-batch: rejects, samples, summaries of the touched blocks."""
    # numbering leaves a file in one task; what is kept has as many parts as there are cores or
    # input splits, as Spark keeps every shuffle partition of a cached table, however empty
    parts = max(batch.sparkSession.sparkContext.defaultParallelism, batch.rdd.getNumPartitions())
    judged = ingest.validated(arrived(batch, batch_id).repartition(parts, "tx"), series).persist()
    try:
        # a folder for each batch, so that a retry replaces its rejects
        judged.where("reason is not null").select("tx", "series", "reason").write.mode("overwrite").parquet(f"{folder}/rejects/batch={batch_id}")
        good = judged.where("reason is null")
        present = {r[0] for r in good.select(values.kind_of(F.col("storage_type"))).distinct().collect()}  # a name each of KINDS
        for kind in [k for k in values.KINDS if k in present]:
            _store(ingest.placed_by_catalog(ingest.samples(good, kind), series), batch_id, series, f"{folder}/{kind}")
    finally:
        judged.unpersist()


def _store(placed: DataFrame, batch_id: int, series: DataFrame, folder: str) -> None:
    spark = placed.sparkSession
    store.write_samples(placed.select("series_id", "block_id", "slot", "ts_ms", "value", "quality", "tx", "pos"), _of_batch(folder, batch_id))
    touched = spark.read.parquet(_of_batch(folder, batch_id)).select("bucket", *blocks.KEY).distinct()
    # what is read again is pruned by folder and by row group: at most BUCKETS numbers, two ends and a number a batch come here
    reach = touched.agg(F.collect_set("bucket").alias("buckets"), F.min("block_id").alias("low"), F.max("block_id").alias("high")).first()
    batches = {batch_id, *_batches_of(touched, folder)}
    near = F.col("bucket").isin(*sorted(reach["buckets"])) & F.col("block_id").between(reach["low"], reach["high"])
    stored = spark.read.option("basePath", f"{folder}/samples").parquet(*(_of_batch(folder, b) for b in sorted(batches)))
    held = stored.where(near).join(touched, ["bucket", *blocks.KEY], "left_semi")
    geometry = series.select("series_id", grid.block_slots(grid.duration_ms(F.col("block_len"), F.col("block_res")), grid.duration_ms(F.col("sample_len"), F.col("sample_res"))).alias("slots"))
    last = ingest.last_writes(held).join(geometry, "series_id")
    summary = blocks.summaries(last, F.col("slots")).withColumn("version", F.lit(batch_id).cast("long"))
    summary.write.mode("append").parquet(f"{folder}/summaries")


def _of_batch(folder: str, batch_id: int) -> str:
    return f"{folder}/samples/batch={batch_id}"


def _batches_of(touched: DataFrame, folder: str) -> list[int]:
    """The batches that hold samples of the touched blocks, from the versions of
    their summaries, which are written after the samples."""
    try:
        known = touched.sparkSession.read.schema("series_id long, block_id long, version long").parquet(f"{folder}/summaries")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []  # the first batch
    return [r[0] for r in known.join(touched, list(blocks.KEY), "left_semi").select("version").distinct().collect()]


def start(spark: SparkSession, source: str, series: DataFrame, folder: str, checkpoint: str, once: bool = False, files_per_batch: int = MOST_FILES) -> StreamingQuery:
    """Ingest JSON request files from ``source`` as they arrive; ``once`` takes
    what is there and ends."""
    if not 0 < files_per_batch <= MOST_FILES:
        raise ValueError(f"files_per_batch {files_per_batch}; from 1 to {MOST_FILES}")
    requests = store.read_requests(spark, source, files_per_batch)
    writer = requests.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda b, i: accept(b, i, series, folder))
    return (writer.trigger(availableNow=True) if once else writer).start()


def load(spark: SparkSession, source: str, series: DataFrame, folder: str, batch_id: int) -> None:
    """Ingest the request files of a folder at once, as batch ``batch_id``;
    loaded again under the same number they change nothing."""
    accept(store.read_requests(spark, source), batch_id, series, folder)


def current_summaries(spark: SparkSession, folder: str, kind: str = "real") -> DataFrame:
    """The newest summary of each block of the series of one kind."""
    rows = spark.read.parquet(f"{folder}/{kind}/summaries")
    names = [c for c in rows.columns if c not in blocks.KEY]
    return rows.groupBy(*blocks.KEY).agg(F.max_by(F.struct(*names), "version").alias("r")).select(*blocks.KEY, "r.*")
