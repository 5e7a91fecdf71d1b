"""Needs against profiles: all pairs' four scores at once, from vectors that an embedder made before.

needs: need_id, vector (of the whole need), domain_vector (null if unknown), capabilities array<struct(name, vector)>;
profiles: teacher, items / technologies / applications array<struct(name, vector)>; evidence: need_id, teacher, rows of
paper_evidence. Profiles are few against chunks, but their number is checked before they are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import MATCH_WEIGHTS, bounded, weighted
from .retrieval import grouped_search
from .shared import first_of, small

# Thresholds.
CAPABILITY_THRESHOLD = 0.55
PAPER_THRESHOLD = 0.45


def ordered_distinct(values: Column) -> Column:
    """Values without those that differ from an earlier one by case and spacing only; trimmed, none empty."""
    clean = F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != "")
    keys = F.transform(clean, lambda v: F.regexp_replace(F.lower(v), r"\s+", ""))
    return F.filter(clean, lambda v, i: F.array_position(keys, F.get(keys, i)) == i + 1)


def best_items(left: DataFrame, right: DataFrame, left_key: list[str], right_key: str) -> DataFrame:
    """(left_key, right_key, similarity, item): for each left vector `v` the most similar of each right group's, the first if equal.

    right: right_key, place, name, v. Unusable vectors match nothing.
    """
    queries = left.select(F.struct(*left_key).alias("query_id"), F.col("v").alias("embedding"))
    items = right.select(right_key, F.struct("place", "name").alias("item"), F.col("v").alias("embedding"))
    best = grouped_search(items, queries, right_key, 1, F.col("chunk_id.place"), "item")
    return best.select("query_id.*", right_key, F.col("score").alias("similarity"), F.col("chunk_id.name").alias("item"))


def _items(profiles: DataFrame, column: str) -> DataFrame:
    return profiles.select("teacher", F.posexplode(column).alias("place", "x")).select("teacher", "place", "x.name", F.col("x.vector").alias("v"))


def semantic_scores(needs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Mean of the three most similar profile items."""
    queries = needs.select(F.col("need_id").alias("query_id"), F.col("vector").alias("embedding"))
    items = _items(profiles, "items").select("teacher", "place", F.col("v").alias("embedding"))
    best = grouped_search(items, queries, "teacher", 3, F.col("chunk_id"), "place")
    return best.groupBy(F.col("query_id").alias("need_id"), "teacher").agg(F.avg("score").alias("semantic_similarity"))


def capability_matches(needs: DataFrame, profiles: DataFrame, threshold: float = CAPABILITY_THRESHOLD) -> DataFrame:
    """(need_id, teacher, capability, item, similarity, matched) of every pair; without items: unmatched at 0."""
    wanted = needs.select("need_id", F.posexplode("capabilities").alias("at", "x")).select("need_id", "at", F.col("x.name").alias("capability"), F.col("x.vector").alias("v"))
    best = best_items(wanted, _items(profiles, "technologies"), ["need_id", "at"], "teacher")
    every = wanted.select("need_id", "at", "capability").crossJoin(small(profiles.select("teacher")))
    return every.join(best, ["need_id", "at", "teacher"], "left").select("need_id", "teacher", "at", "capability", "item", F.coalesce("similarity", F.lit(0.0)).alias("similarity"), (F.coalesce("similarity", F.lit(0.0)) >= threshold).alias("matched"))


def match(needs: DataFrame, profiles: DataFrame, evidence: DataFrame, k: int = 5, threshold: float = CAPABILITY_THRESHOLD) -> DataFrame:
    """One row a need and teacher: the four parts, the score of 0 to 100 and the rank."""
    if k <= 0:
        raise ValueError("k must be positive")
    pairs = needs.select("need_id").crossJoin(small(profiles.select("teacher")))
    coverage = capability_matches(needs, profiles, threshold).groupBy("need_id", "teacher").agg(F.avg(F.col("matched").cast("int")).alias("technical_capability_coverage"), F.count_if("matched").alias("matches"), F.count_if(~F.col("matched")).alias("gaps"))
    domain = best_items(needs.where("domain_vector is not null").select("need_id", F.col("domain_vector").alias("v")), _items(profiles, "applications"), ["need_id"], "teacher")
    counted = evidence.groupBy("need_id", "teacher").agg(F.least(F.count("*") / k, F.lit(1.0)).alias("paper_evidence_count"), F.count("*").alias("evidence"))
    key = ["need_id", "teacher"]
    rows = pairs.join(semantic_scores(needs, profiles), key, "left").join(coverage, key, "left").join(domain.withColumnsRenamed({"similarity": "application_domain_match", "item": "closest_application"}), key, "left").join(counted, key, "left")
    rows = rows.fillna(0.0, list(MATCH_WEIGHTS)).fillna(0, ["matches", "gaps", "evidence"])
    rows = rows.withColumn("score", F.round(weighted({m: F.col(m) for m in MATCH_WEIGHTS}, MATCH_WEIGHTS), 2))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("need_id").orderBy(F.desc("score"), "teacher")))


def breakdown(matches: DataFrame) -> DataFrame:
    """(need_id, teacher, part, raw, weight, contribution)."""
    parts = F.array(*[F.struct(F.lit(m).alias("part"), F.round(bounded(F.col(m)), 4).alias("raw"), F.lit(w).alias("weight"), F.round(bounded(F.col(m)) * w * 100, 2).alias("contribution")) for m, w in MATCH_WEIGHTS.items()])
    return matches.select("need_id", "teacher", "score", F.explode(parts).alias("p")).select("need_id", "teacher", "score", "p.*")


def invalid(matches: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Matches whose contributions don't add up to the score."""
    return breakdown(matches).groupBy("need_id", "teacher", "score").agg(F.sum("contribution").alias("total")).where(F.abs(F.col("total") - F.col("score")) > tolerance)


def recommended(matches: DataFrame) -> DataFrame:
    return first_of(matches, ["need_id"], [F.col("rank")])
