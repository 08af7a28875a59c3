"""Incremental ingest of chunks and running project state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import word_windows
from ..session import written


def stream_documents(spark: SparkSession, path: str, schema: str = "doc_id LONG, source STRING, text STRING") -> DataFrame:
    """New JSON document files of a folder, as a stream."""
    return spark.readStream.schema(schema).json(path)


BUCKETS = 64  # parts of a chunk store, by the first six bits of the text's MD5


def bucket_of(text_md5: Column) -> Column:
    return F.floor(F.conv(F.substring(text_md5, 1, 2), 16, 10).cast("int") * BUCKETS / 256).cast("int")


def ingest_chunks(
    docs: DataFrame, out: str, checkpoint: str, chunker: Callable[[DataFrame], DataFrame] | None = None
) -> StreamingQuery:
    """Chunk whatever has arrived and append chunks that the store does not hold yet.

    The store lies in buckets of the texts' hashes: a batch reads the hashes of the buckets that it touches
    (`stored_hashes`), not of all. Each batch writes to a folder named by its number, so a repeated batch
    replaces its own output.
    """
    cut = chunker or (lambda df: word_windows(df, ["doc_id", "source"]))

    def merge(batch: DataFrame, batch_id: int) -> None:
        # one row per text inside the batch, aggregated by hash before the shuffle
        fresh = cut(batch).groupBy(F.md5("text").alias("text_md5")).agg(
            F.min(F.struct("doc_id", "chunk_index", "source", "chunk_hash", "text")).alias("c")
        ).select("text_md5", "c.*", bucket_of(F.col("text_md5")).alias("bucket"))
        if batch_id > 0:
            fresh = written(fresh)
            touched = [r[0] for r in fresh.select("bucket").distinct().collect()]  # BUCKETS numbers at most
            known = stored_hashes(batch.sparkSession, out, touched, batch_id)
            if known is not None:
                fresh = fresh.join(known, "text_md5", "left_anti")
        fresh.write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/batch={batch_id}")

    return (
        docs.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def stored_hashes(spark: SparkSession, out: str, buckets: list[int], before: int) -> DataFrame | None:
    """Hashes of the chunks that earlier batches wrote to these buckets; None if nothing was written yet."""
    try:
        store = spark.read.schema("text_md5 string, batch bigint, bucket int").parquet(out)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return store.filter((F.col("batch") < before) & F.col("bucket").isin(buckets)).select("text_md5")


def dedupe_stream(chunks: DataFrame, time: str = "ts", lateness: str = "1 hour") -> DataFrame:
    """Drop chunks(time, text, ...) whose text arrived already within the lateness, by its whole MD5."""
    keyed = chunks.withWatermark(time, lateness).withColumn("text_md5", F.md5("text"))
    return keyed.dropDuplicatesWithinWatermark(["text_md5"]).drop("text_md5")


def latest_scores(updates: DataFrame) -> DataFrame:
    """Stream of updates(project_id, update_no, points) -> newest score per project after each batch, in update mode.

    A project's newest update is that of the greatest number, however late others come; every row counts
    as an update. The state of a project is that number, its points and the count, kept by Spark's own aggregation: rows are
    added up before the shuffle, and no project costs a call of Python.
    """
    return updates.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_updates"), F.max_by("points", "update_no").alias("total_points"))


def follow_scores(updates: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write what `latest_scores` says after each batch to `out`, a folder per batch; `current_scores` reads it."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    states = latest_scores(updates).writeStream.outputMode("update").foreachBatch(keep)
    return states.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_scores(spark: SparkSession, out: str) -> DataFrame:
    """(project_id, n_updates, total_points): the last state of each project."""
    states = spark.read.parquet(out)
    last = F.max_by(F.struct("n_updates", "total_points"), "batch").alias("s")
    return states.groupBy("project_id").agg(last).select("project_id", "s.*")
