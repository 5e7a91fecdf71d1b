"""Searches of many queries: scored where the texts are, and in small parts."""

import pytest
from pyspark.sql import functions as F

from evigrain.functions.text import latin_tokens
from evigrain.operators import inverted, retrieval
from evigrain.operators.shared import shared_path

from .test_indexes import texts


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([*texts(300, 3), (900, None), (901, "")], "chunk_id long, text string").repartition(3).cache()


def got(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 8)) for r in df.collect())


def test_no_row_for_each_query_and_chunk_is_shuffled(spark, chunks, monkeypatch):
    queries = chunks.where("chunk_id % 7 = 0").select(F.col("chunk_id").alias("query_id"), F.col("text").alias("query"))
    found = retrieval.bm25_search(chunks, queries, 4, tokenizer=latin_tokens)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "HashAggregate" not in plan
    for name, value in (("QUERY_BLOCK", 20), ("ASKED", 5), ("HELD", 40), ("PAIRS", 64)):
        monkeypatch.setattr(retrieval, name, value)
    parts = retrieval.bm25_search(chunks, queries, 4, tokenizer=latin_tokens)
    twice = retrieval.bm25_search(chunks.union(chunks.where("chunk_id = 5")), queries, 4, tokenizer=latin_tokens)
    assert "HashAggregate" in twice._jdf.queryExecution().executedPlan().toString()  # repeated ids are added up by rows
    wanted = queries.select("query_id", F.explode(latin_tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    terms = wanted.select("term").union(spark.createDataFrame([("",)], "term string")).distinct()
    docs = chunks.select("chunk_id", latin_tokens(F.coalesce("text", F.lit(""))).alias("terms"))
    plain = got(retrieval._bm25_by_rows(docs, wanted, terms, F.broadcast, 4, 1.5, 0.75))
    assert got(found) == got(parts) == plain and plain


def test_index_shuffles_lists_and_unfolds_postings_once(spark, chunks, monkeypatch):
    monkeypatch.setattr(inverted, "SHARD", 90)
    monkeypatch.setattr(inverted, "NAMED", 2)
    path = shared_path(spark, "index")
    index = inverted.create(spark, path, "latin_tokens", buckets=4, block=8)
    index.add(chunks, 0)
    stored = spark.read.parquet(f"{path}/postings")
    assert stored.select("shard").distinct().count() > 1 and stored.agg(F.max("n")).first()[0] == 8
    assert spark.read.schema("run long").parquet(f"{path}/runs").count() == 0
    queries = chunks.where("chunk_id % 60 = 0").select(F.col("chunk_id").alias("query_id"), F.col("text").alias("query"))
    found = index.search(queries, 3)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    assert got(found) == got(retrieval.bm25_search(chunks, queries, 3, tokenizer=latin_tokens))
