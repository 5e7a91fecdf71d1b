"""Incremental registration of documents in a library catalog.

A file stream over the source folder takes the Parquet files that its checkpoint doesn't know, in batches of bounded
number. Each batch's documents are checked, identified by the SHA-256 of their text, tagged by keyword rules, counted by
content, and merged into a catalog in hash buckets, of which only those touched are rewritten. A content has one row,
however often and in however many batches it comes: its first document by id, its tags, and the number of its rows.
Rows without an id or without text are written beside the catalog with the reason. A run that was killed goes on where
it was; what it had applied of a batch isn't applied again. Without new files a run changes nothing.

Under the target: catalog/ and rejected/batch=N. Target and checkpoint belong together.

    python -m jobs.library_sync --source S --target T --checkpoint C [--config jobs/library_sync.json]
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evigrain.functions.text import latin_tokens
from evigrain.operators.catalog import keyword_hits
from evigrain.operators.shared import over_cores
from evigrain.sources.buckets import Catalog, catalog
from evigrain.streaming.ingest import run_batches

from .settings import main

LOG = logging.getLogger("library_sync")
DEFAULTS = {
    "buckets": 16,
    "files_per_batch": 50,
    "rules": [
        {"category": "topic", "value": "licence", "keywords": ["license", "licensed", "rights reserved"], "confidence": 0.9},
        {"category": "topic", "value": "secret", "keywords": ["token =", "password"], "confidence": 0.7},
    ],
}
DOCUMENTS = "doc_id long, text string, lang string, source string"
ROWS = "content_id string, first_id long, lang string, source string, n_chars long, n_terms long, tags string, n_rows long"


def library(spark: SparkSession, target: str, config: dict) -> Catalog:
    return catalog(spark, f"{target}/catalog", ROWS, "content_id", config["buckets"])


def checked(rows: DataFrame) -> DataFrame:
    """rows with `reason`, null where nothing is wrong."""
    return rows.withColumn("reason", F.when(F.col("doc_id").isNull(), "no id").when(F.col("text").isNull() | ~F.col("text").rlike(r"\S"), "no text"))


def contents(rows: DataFrame, rules: list[dict]) -> DataFrame:
    """One row a content, in the catalog's columns. What depends on the text is computed before the shuffle, which has no texts."""
    values = F.array_distinct(F.array_sort(F.transform(keyword_hits(F.col("text"), rules), lambda t: t["value"])))
    facts = F.struct(F.col("doc_id").alias("first_id"), "lang", "source", F.length("text").cast("long").alias("n_chars"), F.size(latin_tokens(F.col("text"))).cast("long").alias("n_terms"), F.array_join(values, ",").alias("tags"))
    each = rows.select(F.sha2("text", 256).alias("content_id"), facts.alias("f"))
    return each.groupBy("content_id").agg(F.min("f").alias("f"), F.count("*").alias("n_rows")).select("content_id", "f.*", "n_rows").select(*StructType.fromDDL(ROWS).names)


def apply(rows: DataFrame, batch: int, target: str, config: dict) -> dict:
    """Merge a batch; its figures. Applying it again leaves everything as it is."""
    spark = rows.sparkSession
    known = library(spark, target, config)
    held = checked(over_cores(rows)).persist()
    try:
        found = contents(held.where("reason is null"), config["rules"])
        earlier = lambda was, now, c: F.when(F.col("_new_first_id") < F.col("first_id"), now).otherwise(was)
        combine = {c: (lambda was, now, c=c: earlier(was, now, c)) for c in ("first_id", "lang", "source")} | {"n_rows": lambda was, now: was + now}
        buckets = known.upsert(found, batch, combine)
        bad = held.where("reason is not null").select("doc_id", F.length("text").alias("n_chars"), "reason", F.lit(batch).alias("batch"))
        bad.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{target}/rejected")
        n, wrong = held.agg(F.count("*"), F.count("reason")).first()
    finally:
        held.unpersist()
    figures = {"batch": batch, "rows_read": n, "rows_rejected": wrong, "buckets_written": len(buckets)}
    LOG.info("batch %(batch)d: %(rows_read)d rows read, %(rows_rejected)d rejected, %(buckets_written)d buckets written", figures)
    return figures


def run(spark: SparkSession, source: str, target: str, checkpoint: str, config: dict | None = None) -> DataFrame:
    """Register the source's new documents; the whole catalog as it stands then."""
    config = {**DEFAULTS, **(config or {})}
    files = spark.readStream.schema(DOCUMENTS).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).option("maxFilesPerTrigger", config["files_per_batch"])
    known = library(spark, target, config)
    done = []
    run_batches(files.parquet(source), lambda rows, batch: done.append(apply(rows, batch, target, config)), checkpoint)
    out = known.rows().select(*StructType.fromDDL(ROWS).names)
    LOG.info("%d batches, %d rows read from %s; %d contents in %s", len(done), sum(f["rows_read"] for f in done), source, out.count(), target)
    return out


if __name__ == "__main__":
    main(run, "library_sync", {"source": "folder of Parquet files of documents", "target": "folder of the library", "checkpoint": "folder of the stream's progress"}, DEFAULTS)
