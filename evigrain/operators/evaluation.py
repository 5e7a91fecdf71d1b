"""Retrieval quality (recall, reciprocal rank, nDCG) and latency, for all queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpoint_dir, small


def run_rows(runs: DataFrame) -> DataFrame:
    """(query_id, chunk_id, rank) of runs given as (query_id, chunk_ids); repeated ids keep their first place."""
    each = runs.select("query_id", F.posexplode(F.array_distinct("chunk_ids")).alias("at", "chunk_id"))
    return each.select("query_id", "chunk_id", (F.col("at") + 1).alias("rank"))


def evaluate(qrels: DataFrame, run: DataFrame, cutoffs=(5, 10)) -> DataFrame:
    """One row a cutoff: recall, mrr and ndcg averaged over the queries that have relevant judgments, to 6 places.

    qrels: query_id, chunk_id, relevance (repeated: the highest counts); run: query_id, chunk_id, rank. Queries
    without a run count as 0. Gain is 2^relevance - 1, discounted by log2(rank + 1); the ideal list is of all judgments.
    """
    q = qrels.groupBy("query_id", "chunk_id").agg(F.max("relevance").alias("relevance")).where("relevance > 0")
    gain = F.pow(F.lit(2.0), F.col("relevance")) - 1
    ideal = q.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "chunk_id"))).select("query_id", "rank", (gain / F.log2(F.col("rank") + 1)).alias("g"))
    hits = run.join(q, ["query_id", "chunk_id"]).select("query_id", "rank", (gain / F.log2(F.col("rank") + 1)).alias("g"))
    at = lambda k, c: F.when(F.col("rank") <= k, c)
    best = ideal.groupBy("query_id").agg(F.count("*").alias("relevant"), *[F.sum(at(k, F.col("g"))).alias(f"i{k}") for k in cutoffs])
    got = hits.groupBy("query_id").agg(
        *[F.count(at(k, F.col("g"))).alias(f"h{k}") for k in cutoffs],
        *[F.sum(at(k, F.col("g"))).alias(f"d{k}") for k in cutoffs],
        *[F.max(at(k, 1.0 / F.col("rank"))).alias(f"r{k}") for k in cutoffs],
    )
    per = best.join(got, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rows = per.select(
        F.explode(
            F.array(*[F.struct(F.lit(k).alias("cutoff"), zero(F.col(f"h{k}") / F.col("relevant")).alias("recall"), zero(F.col(f"r{k}")).alias("mrr"), zero(F.col(f"d{k}") / F.col(f"i{k}")).alias("ndcg")) for k in cutoffs])
        ).alias("e")
    ).select("e.*")
    return rows.groupBy("cutoff").agg(F.count("*").alias("queries"), *[F.round(F.avg(m), 6).alias(m) for m in ("recall", "mrr", "ndcg")])


#: Rows of a group up to which its quantiles are taken from its values in one task; larger groups are narrowed down.
GATHERED = 1_000_000
BINS = 1024


def order_statistics(rows: DataFrame, value: str, group: list[str], ranks: dict[str, Column]) -> DataFrame:
    """(group.., name, value): exact values by rank, whatever a group's size; ranks are columns of the group's count n, from 1.

    Each round counts the values that may still be it in BINS equal bins, before the shuffle, and goes on with the bin of
    the rank, as far as its values reach; a value is found when they are all equal. No group is sorted or gathered. Values
    are finite; nulls don't count.
    """
    base = rows.select(*group, F.col(value).cast("double").alias("_v")).where("_v is not null")
    checkpoint_dir(rows.sparkSession)
    size = base.groupBy(*group).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    named = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), c.cast("long").alias("rank")) for k, c in ranks.items()])).alias("t")
    open_ = size.select(*group, "lo", "hi", named).select(*group, "t.name", "t.rank", F.lit(0).cast("long").alias("below"), "lo", "hi").checkpoint()
    done, key = open_.where("lo = hi"), [*group, "name"]
    while True:
        open_ = open_.where("lo < hi")
        if open_.isEmpty():
            return done.select(*key, F.col("lo").alias("value"))
        # halved where a range is wider than any number; elsewhere that could make its ends equal
        half = F.when(F.col("hi") - F.col("lo") == float("inf"), 0.5).otherwise(1.0)
        place = F.floor((F.col("_v") * half - F.col("lo") * half) / (F.col("hi") * half - F.col("lo") * half) * BINS)
        live = base.join(small(open_), group) if group else base.crossJoin(F.broadcast(open_))
        bins = live.where("_v between lo and hi").groupBy(*key, "rank", "below", F.least(F.lit(BINS - 1), place).alias("bin")).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        so_far = F.col("below") + F.sum("n").over(Window.partitionBy(*key).orderBy("bin"))
        reached = bins.withColumn("upto", so_far).where("upto >= rank and upto - n < rank")
        open_ = reached.select(*key, "rank", (F.col("upto") - F.col("n")).alias("below"), "lo", "hi").checkpoint()
        done = done.unionByName(open_.where("lo = hi"))


def latency(rows: DataFrame, value: str, group: list[str], gathered: int = GATHERED) -> DataFrame:
    """Mean, median, nearest-rank 95th percentile and maximum, exact also where one group holds all rows."""
    stats = rows.groupBy(*group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max"))
    checkpoint_dir(rows.sparkSession)
    stats = stats.checkpoint()
    few = stats.where(F.col("n") <= gathered).select(*group)
    part = rows.join(small(few), group, "left_semi") if group else rows.where(F.lit(stats.where(F.col("n") <= gathered).count() > 0))
    own = part.groupBy(*group).agg(F.median(value).alias("p50"), F.expr(f"percentile_disc(0.95) within group (order by {value})").alias("p95"))
    if not stats.where(F.col("n") > gathered).isEmpty():
        rest = rows.join(small(few), group, "left_anti") if group else rows
        ranks = {"a": F.floor((F.col("n") + 1) / 2), "b": F.floor(F.col("n") / 2) + 1, "c": F.floor((F.col("n") * 95 + 99) / 100)}
        found = order_statistics(rest, value, group, ranks).groupBy(*group).pivot("name", list(ranks)).agg(F.first("value"))
        large = found.select(*group, ((F.col("a") + F.col("b")) / 2).alias("p50"), F.col("c").alias("p95"))
        own = own.unionByName(large) if group else large
    if not group:
        return stats.crossJoin(own).select("n", "mean", "p50", "p95", "max")
    return stats.join(own, group, "left").select(*group, "n", "mean", "p50", "p95", "max")
