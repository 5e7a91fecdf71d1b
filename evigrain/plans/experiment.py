"""Retrieval experiments: several methods over the same queries, run files, a manifest, and metrics where there are judgments."""

from __future__ import annotations

import json
import time
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluation, retrieval

SCHEMA = "retrieval_experiment_manifest_v1"
METHODS = ("dense", "bm25", "rrf", "rerank")


def digest(queries: DataFrame) -> str:
    """SHA-256 over the queries' ids and texts in order of the id; joined on the executors as digests, 64 bytes a query."""
    each = queries.select("query_id", F.sha2(F.to_json(F.struct("query_id", "query")), 256).alias("d"))
    return each.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("query_id", "d"))), lambda x: x["d"]), ""), 256)).first()[0]


def run_file(ranking: DataFrame, queries: DataFrame, method: str) -> DataFrame:
    """(query_id, method, chunk_ids, ranked_results): one row a query, also for those that found nothing."""
    ranks = F.to_json("component_ranks") if "component_ranks" in ranking.columns else F.lit(None).cast("string")
    score = "rerank_score" if "rerank_score" in ranking.columns else "score"
    packed = ranking.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("chunk_id").cast("string").alias("chunk_id"), F.round(score, 10).alias("score"), ranks.alias("component_ranks")))).alias("ranked_results"))
    rows = queries.select("query_id").join(packed, "query_id", "left")
    rows = rows.withColumn("ranked_results", F.coalesce("ranked_results", F.from_json(F.lit("[]"), packed.schema["ranked_results"].dataType)))
    return rows.select("query_id", F.lit(method).alias("method"), F.transform("ranked_results", lambda x: x["chunk_id"]).alias("chunk_ids"), "ranked_results")


def run_experiment(chunks: DataFrame, queries: DataFrame, methods, folder: str, k: int = 10, candidates: int = 50, rrf_k: int = 60, scorer=None, qrels: DataFrame | None = None, cutoffs=(5, 10), plan=None) -> dict:
    """The manifest. Each method's run is written below `folder` as JSON, and the manifest beside them.

    Each method starts from the tables, so none profits from another's work. Queries are answered together: the time is
    of the whole run, and a query's share of it is its mean.
    """
    methods = list(dict.fromkeys(methods))
    if unknown := set(methods) - set(METHODS):
        raise ValueError(f"unknown methods {sorted(unknown)}")
    if not cutoffs or min(cutoffs) <= 0 or rrf_k <= 0:
        raise ValueError("cutoffs and rrf_k must be positive")
    if "rerank" in methods and scorer is None:
        raise ValueError("rerank needs a scorer")
    spark, n = chunks.sparkSession, queries.count()
    if chunks.isEmpty():
        raise ValueError("there are no chunks")
    quality = {"status": "evaluated", "cutoffs": sorted(set(cutoffs))} if qrels is not None else {"status": "not_run", "reason": "no judgments"}
    manifest = {"schema_version": SCHEMA, "created_at": datetime.now(timezone.utc).isoformat(), "queries": n, "queries_sha256": digest(queries), "top_k": k, "candidate_k": candidates, "rrf_k": rrf_k, "quality_evaluation": quality, "methods": {}}
    for method in methods:
        began, path = time.perf_counter(), f"{folder}/{method}"
        ranking = retrieval.hybrid_search(chunks, queries, method, k, candidates, rrf_k, plan, scorer)
        run_file(ranking, queries, method).write.mode("errorifexists").json(path)
        took = 1000 * (time.perf_counter() - began)
        entry = {"run_file": method, "query_count": n, "total_ms": round(took, 3), "mean_latency_ms": round(took / max(1, n), 3)}
        if qrels is not None:
            run = spark.read.schema("query_id string, chunk_ids array<string>").json(path)
            found = evaluation.evaluate(qrels, evaluation.run_rows(run), cutoffs)
            entry["metrics"] = {str(r["cutoff"]): {m: r[m] for m in ("recall", "mrr", "ndcg")} for r in found.collect()}  # a row a cutoff
        manifest["methods"][method] = entry
    spark.createDataFrame([(json.dumps(manifest, ensure_ascii=False),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{folder}/manifest")
    return manifest
