"""Evidence for standing questions: the documents that answer them best, with excerpts, graded and written by source.

The documents are put into a stored inverted index beside the output. Questions are the first user turns of the
conversations whose id is divisible by `every`; a search reads the postings of their terms only. Each piece of evidence
has the share of the question's terms that its document holds, and a question's level is that of its best one:
strong, weak, or none, for which there is a row without a document. Each run writes the same files' contents again.

Under the target: index/ and evidence/source=S.

    python -m jobs.question_evidence --documents D --questions Q --target T [--config jobs/question_evidence.json]
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evigrain.functions.text import compact, latin_tokens
from evigrain.operators import inverted
from evigrain.operators.shared import first_of, small

from .settings import main

LOG = logging.getLogger("question_evidence")
DEFAULTS = {"every": 100, "per_question": 5, "excerpt": 160, "strong": 0.6, "weak": 0.2, "buckets": 32, "block": 128}
ROWS = "conv_id long, question_terms long, rank int, doc_id long, score double, coverage double, level string, excerpt string, source string"


def questions_of(turns: DataFrame, every: int) -> DataFrame:
    """(query_id, query): the first user turn of each conversation whose id is divisible by `every`."""
    own = turns.where((F.col("conv_id") % every == 0) & (F.col("role") == "user") & F.col("text").isNotNull())
    return first_of(own, ["conv_id"], [F.col("turn"), F.col("text")]).select(F.col("conv_id").alias("query_id"), F.col("text").alias("query"))


def graded(found: DataFrame, docs: DataFrame, asked: DataFrame, config: dict) -> DataFrame:
    """The evidence in the output's columns. Only the documents found are joined with their texts."""
    terms = asked.select("query_id", F.array_distinct(latin_tokens(F.col("query"))).alias("terms"))
    whole = docs.join(small(found.withColumnRenamed("chunk_id", "doc_id")), "doc_id").join(small(terms), "query_id")
    share = F.size(F.array_intersect("terms", latin_tokens(F.col("text")))) / F.size("terms")
    each = whole.select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"), F.round(share, 6).alias("coverage"), compact(F.col("text"), config["excerpt"]).alias("excerpt"), "source")
    best = F.max("coverage").over(Window.partitionBy("query_id"))
    level = F.when(best >= config["strong"], "strong").when(best >= config["weak"], "weak").otherwise("none")
    each = each.withColumn("level", level).where("level <> 'none'")
    out = terms.select("query_id", F.size("terms").cast("long").alias("question_terms")).join(each, "query_id", "left")
    return out.select(F.col("query_id").alias("conv_id"), "question_terms", "rank", "doc_id", "score", "coverage", F.coalesce("level", F.lit("none")).alias("level"), "excerpt", "source")


def run(spark: SparkSession, documents: str, questions: str, target: str, config: dict | None = None) -> DataFrame:
    """Index the documents, answer the questions and write the evidence; the whole evidence, read back."""
    config = {**DEFAULTS, **(config or {})}
    docs = spark.read.parquet(documents).select("doc_id", "text", "source").where("doc_id is not null")
    index = inverted.create(spark, f"{target}/index", "latin_tokens", config["buckets"], config["block"])
    n = index.add(docs, 0, key="doc_id")
    asked = questions_of(spark.read.parquet(questions), config["every"])
    found = index.search(asked, config["per_question"]).persist()  # measured before it is joined
    graded(found, docs, asked, config).write.mode("overwrite").partitionBy("source").parquet(f"{target}/evidence")
    found.unpersist()
    out = spark.read.schema(ROWS).parquet(f"{target}/evidence")
    rows, answered, asked_n = out.agg(F.count("doc_id"), F.countDistinct(F.when(F.col("level") != "none", F.col("conv_id"))), F.countDistinct("conv_id")).first()
    LOG.info("%d documents read from %s, %d questions from %s; %d pieces of evidence for %d questions written to %s", n, documents, asked_n, questions, rows, answered, target)
    return out


if __name__ == "__main__":
    main(run, "question_evidence", {"documents": "Parquet table of documents", "questions": "Parquet table of conversations", "target": "folder of the output"}, DEFAULTS)
