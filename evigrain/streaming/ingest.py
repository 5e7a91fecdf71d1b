"""Incremental ingestion: new files only, once per content, in bounded batches that can be resumed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.buckets import Catalog


def new_rows(spark: SparkSession, path: str, schema, files_per_batch: int = 100, form: str = "parquet") -> DataFrame:
    """A stream of the rows of a folder's files, each file once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(form).load(path)


def uploads(spark: SparkSession, inbox: str, files_per_batch: int = 20) -> DataFrame:
    """A stream of PDF files with paper_id, those of a known content left out.

    State holds one digest a content ever seen; it grows with the library, not with the number of scans.
    """
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("maxFilesPerTrigger", files_per_batch).schema("path string, modificationTime timestamp, length long, content binary").load(inbox)
    return files.withColumn("paper_id", F.sha2("content", 256)).dropDuplicates(["paper_id"])


def once_per_content(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose columns weren't seen before, by a digest of them."""
    return rows.withColumn("content_id", F.sha2(F.to_json(F.struct(*columns)), 256)).dropDuplicates(["content_id"])


def run_available(rows: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Work off what is there and stop; a later call goes on from the checkpoint."""
    query = rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_batches(rows: DataFrame, work, checkpoint: str) -> StreamingQuery:
    """work(batch, number) for each bounded batch, for upserts; numbers repeat after a failure, so work must be idempotent."""
    query = rows.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def once_per_content_stored(rows: DataFrame, digest: Column, known: Catalog, sink: str, checkpoint: str) -> StreamingQuery:
    """Writes to sink/batch=N the rows whose digest, content_id, is new; the stream itself keeps no state.

    What is known stands in a catalog in hash buckets (key content_id); a batch reads and rewrites only the buckets of its
    own digests. A batch that comes again after a failure finds the same rows new and replaces its folder. Of rows with one
    digest in a batch one is kept.
    """

    def work(batch: DataFrame, number: int) -> None:
        first = batch.withColumn("content_id", digest).dropDuplicates(["content_id"])
        known.fresh(first, number).write.mode("overwrite").parquet(f"{sink}/batch={number}")
        done = batch.sparkSession.read.schema("content_id string").parquet(f"{sink}/batch={number}")
        known.upsert(done, number)

    return run_batches(rows, work, checkpoint)
