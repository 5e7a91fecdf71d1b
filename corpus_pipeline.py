"""Corpus pipeline: five stages over the documents table, each written as Parquet and read again by the next.

In all stages null texts are treated as empty and kept as they are, rows that repeat a doc_id are rows of their own,
other columns pass through whatever they are called, very long texts are taken whole, and an empty table stays empty.
Without labels the first two stages keep everything. A null doc_id is kept by all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evigrain.llm import jaccard_join, line_dedup, packing, quality, toxicity
from evigrain.llm.common import id_filter, materialize, read_table, split_by_filter

#: SQL can express neither the fitted models nor the packing plan.
ORACLE_SQL = None


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity reaches the rejection threshold go; equal texts go or stay together."""
    return toxicity.keep(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def poor_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted to be of poor quality go; equal texts go or stay together."""
    return quality.keep(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")))


def boilerplate_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go; documents stay, some without text."""
    return line_dedup.clean(docs)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays; only rows that may go are shuffled.

    Documents without words are in no group and stay. Rows that share the smallest id of a group all stay.
    """
    parts = jaccard_join.near_components(docs)
    gone = materialize(parts.where("doc_id <> component_id").select("doc_id").distinct(), "near-copies")
    bits = id_filter(gone)
    maybe = split_by_filter(docs, "doc_id", bits, inside=True).join(gone, "doc_id", "left_anti").select(*docs.columns)
    return split_by_filter(docs, "doc_id", bits, inside=False).unionByName(maybe)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents as pieces of token sequences; one without text is its end token.

    Executors' heaps are large after four stages, so tokens are made in small batches, which changes no result.
    """
    import public_tokenizers as P

    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, str(4 << 20))
    try:
        return packing.pack(docs, P.path(packing.VOCABULARY), run_bytes=512 << 10, memory=100_000)
    finally:
        spark.conf.set(size, before)


STAGES = [
    ("toxicity", toxic_out),
    ("quality", poor_out),
    ("line_dedup", boilerplate_out),
    ("jaccard_join", near_copies_out),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents that the stages keep; the stages' tables stay until evigrain.llm.common.clear()."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


__all__ = ["ORACLE_SQL", "STAGES", "run"]
