"""A stored inverted index for BM25: postings in blocks with bounds, bucketed by term, added segment by segment.

Under its path: settings/ (one row), stats/segment=N (documents and their total length), docs/segment=N (chunk_id, length)
and postings/segment=N/bucket=B (term, shard, block, n, top_tf, least_ratio, ids, tfs, lengths). A block holds at most
`block` postings of a term, those of the highest impact first, so that blocks are alike inside and their bounds tight.
Bounds are the highest frequency and the least ratio of length to frequency, not a score: they stay valid when other
segments change the mean length and the document frequencies. Documents are dealt into shards of about SHARD, so the postings of a term that
all documents hold are never in one task.

A search reads the buckets of its queries' terms only. From each query's most promising blocks it takes a score that the
k-th best document reaches at least; of all blocks, those that can't lift a document to it for any query, even with the
best of all other terms, are dropped before their postings are unfolded. Results equal those of bm25_search over the same
rows. Each task of the build makes lists of its documents' postings, so that lists are shuffled, not postings.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.files import exists
from .retrieval import best_chunks
from .shared import fits, over_cores, require_none, small, top_k

TOKENIZERS: dict[str, Callable[[Column], Column]] = {"tokens": tx.tokens, "latin_tokens": tx.latin_tokens}
#: Documents of a shard of a segment, about.
SHARD = 1_000_000
#: Terms of all queries that are named in the scan's filter, so that row groups without them are passed over.
NAMED = 400
#: Blocks of each query, by their bounds, whose postings give the score to beat.
PROBE = 32
#: What names a block.
BLOCK = ["term", "segment", "shard", "block"]
#: Scores are compared after rounding; bounds get this much more.
MARGIN = 1e-6


def _impact(tf, length, mean, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))


def _bound(top_tf, least_ratio, mean, k1: float, b: float) -> Column:
    """_impact() of a block at most: it grows with the frequency and falls with the length for each occurrence."""
    return (k1 + 1) / (1 + k1 * (1 - b) / top_tf + k1 * b * least_ratio / mean)


#: Occurrences of terms that are sorted into lists at a time.
RUN = 1 << 21


def _lists(sizes_end: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], sizes_end]).astype(np.int32)), values)


def _runs(batches):
    """Of batches of (chunk_id, terms): each term's postings of about RUN occurrences in a row, and one without a term
    for all chunks there, with their lengths. `run` is a number of these chunks, by which they are dealt into shards.
    """

    def lists(held):
        ids, terms = (pa.concat_arrays([b.column(i) for b in held]) for i in range(2))
        sizes = np.asarray(pc.fill_null(pc.list_value_length(terms), 0)).astype(np.int64)
        many, words = len(sizes), terms.flatten().dictionary_encode()
        if not many:
            return
        cell, tf = np.unique(np.asarray(words.indices).astype(np.int64) * many + np.repeat(np.arange(many), sizes), return_counts=True)
        code, doc = cell // many, cell % many
        first = np.flatnonzero(np.diff(code, prepend=-1))
        run = zlib.crc32(str(ids[0].as_py()).encode())
        for term, ends, at, times in ((words.dictionary.take(pa.array(code[first])), np.r_[first[1:], len(code)] if len(code) else first, doc, tf), (pa.nulls(1, pa.string()), np.array([many]), np.arange(many), np.zeros(many))):
            values = ids.take(pa.array(at)), pa.array(times.astype(np.int32)), pa.array(sizes[at].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(term), run)), term, *(_lists(ends, v) for v in values)], ["run", "term", "ids", "tfs", "lengths"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch.column(1).flatten())
        if n >= RUN:
            yield from lists(held)
            held, n = [], 0
    if held:
        yield from lists(held)


def _packer(block: int, mean: float):
    """A function of batches of (bucket, shard, term, lists): a term's postings as blocks, the highest impact first."""

    def run(batches):
        for batch in batches:
            runs = batch.column(3)
            p = runs.flatten()
            ids, tfs, lengths = (p.field(name) for name in ("ids", "tfs", "lengths"))
            term = np.repeat(np.arange(batch.num_rows), np.asarray(pc.list_value_length(runs)))
            term = np.repeat(term, np.asarray(pc.list_value_length(ids)))
            if not len(term):
                continue
            ids, tf, length = ids.flatten(), np.asarray(tfs.flatten()), np.asarray(lengths.flatten())
            impact = tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))
            if pa.types.is_integer(ids.type):
                order = np.lexsort((np.asarray(ids), -impact, term))
            else:
                order = np.asarray(pc.sort_indices(pa.table({"t": term, "i": impact, "c": ids}), [("t", "ascending"), ("i", "descending"), ("c", "ascending")]))
            tf, length = tf[order], length[order]
            starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
            at = np.arange(len(term)) - np.repeat(starts, np.diff(np.r_[starts, len(term)]))
            first = np.flatnonzero(at % block == 0)
            ends = np.r_[first[1:], len(term)]
            own = pa.array(term[first])
            columns = [batch.column(0).take(own), batch.column(2).take(own), batch.column(1).take(own), pa.array((at[first] // block).astype(np.int32)), pa.array(ends - first)]
            columns += [pa.array(np.maximum.reduceat(tf, first)), pa.array(np.minimum.reduceat(length / tf, first))]
            columns += [_lists(ends, ids.take(pa.array(order))), _lists(ends, pa.array(tf)), _lists(ends, pa.array(length))]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "term", "shard", "block", "n", "top_tf", "least_ratio", "ids", "tfs", "lengths"])

    return run


@dataclass(frozen=True)
class InvertedIndex:
    """An index at a path; create() makes it, open_index() finds it."""

    spark: SparkSession
    path: str
    tokenizer: str
    buckets: int
    block: int

    # --- writing ---------------------------------------------------------------------------------------

    def add(self, chunks: DataFrame, segment: int, text: str = "text", key: str = "chunk_id") -> int:
        """Index the rows as a segment, and give their number. The same segment again replaces itself, so a retry is safe.

        Ids are not null, unlike each other and those of other segments, else nothing is written. Null and empty texts
        count as documents without terms.
        """
        rows = over_cores(chunks.select(F.col(key).alias("chunk_id"), F.coalesce(F.col(text), F.lit("")).alias("text")))
        ids = chunks.select(F.col(key).alias("chunk_id"))
        require_none(ids.groupBy("chunk_id").count().where("count > 1 or chunk_id is null"), "a chunk has no id, or two chunks have one")
        if exists(self.spark, f"{self.path}/docs"):
            others = self._read("docs").where(F.col("segment") != segment).select("chunk_id")
            require_none(ids.join(others, "chunk_id", "left_semi"), "a chunk is in another segment")
        kind = rows.schema["chunk_id"].dataType.simpleString()
        lists = f"ids array<{kind}>, tfs array<int>, lengths array<int>"
        terms = rows.select("chunk_id", TOKENIZERS[self.tokenizer](F.col("text")).alias("terms"))
        # texts are split once: what they give is written, read for the documents and for the postings, and emptied
        made = terms.mapInArrow(_runs, f"run long, term string, {lists}")
        self._write(made, "runs", segment)
        runs = self.spark.read.schema(made.schema).parquet(f"{self.path}/runs/segment={segment}")
        docs = runs.where("term is null").select(F.explode(F.arrays_zip("ids", "lengths")).alias("d")).select(F.col("d.ids").alias("chunk_id"), F.col("d.lengths").alias("length"))
        self._write(docs, "docs", segment)
        n, total = self._read("docs").where(F.col("segment") == segment).agg(F.count("*"), F.sum("length")).first()
        shards = max(1, -(-n // SHARD))
        runs = runs.where("term is not null").withColumn("bucket", self.bucket_of(F.col("term")))
        runs = runs.withColumn("shard", F.pmod(F.xxhash64("run"), F.lit(shards)).cast("int"))
        # (bucket, shard) deals out what the grouping needs together
        whole = runs.repartition("bucket", "shard").groupBy("bucket", "shard", "term").agg(F.collect_list(F.struct("ids", "tfs", "lengths")).alias("p"))
        mean = total / n if total else 1.0
        stored = whole.mapInArrow(_packer(self.block, mean), f"bucket int, term string, shard int, block int, n long, top_tf int, least_ratio double, {lists}")
        self._write(stored.sortWithinPartitions("bucket", "term", "block"), "postings", segment, "bucket")
        self._write(self.spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in made.schema)), "runs", segment)
        self._write(self.spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(total or 0).cast("long").alias("total")), "stats", segment)
        return n

    def _write(self, rows: DataFrame, table: str, segment: int, *by: str) -> None:
        """Replaces the segment's folder of a table, and no other."""
        writer = rows.write.mode("overwrite")
        (writer.partitionBy(*by) if by else writer).parquet(f"{self.path}/{table}/segment={segment}")

    # --- reading ---------------------------------------------------------------------------------------

    def _read(self, table: str) -> DataFrame:
        """A table of all segments; docs and stats have a file in each, postings of segments without terms have none."""
        found = self.spark.read
        if table == "postings":
            kind = self._read("docs").schema["chunk_id"].dataType.simpleString()
            found = found.schema(f"term string, shard int, block int, n long, top_tf int, least_ratio double, ids array<{kind}>, tfs array<int>, lengths array<int>, segment int, bucket int")
        return found.parquet(f"{self.path}/{table}")

    def segments(self) -> list[int]:
        """The segments there are, as the folders say."""
        return sorted(r[0] for r in self._read("stats").select("segment").distinct().collect()) if exists(self.spark, f"{self.path}/stats") else []

    def bucket_of(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def terms(self) -> DataFrame:
        """(term, documents, occurrences) of all terms."""
        counted = F.aggregate("tfs", F.lit(0).cast("long"), lambda s, x: s + x)
        return self._read("postings").select("term", "n", counted.alias("c")).groupBy("term").agg(F.sum("n").alias("documents"), F.sum("c").alias("occurrences"))

    def _mean(self) -> tuple[int, float]:
        """(documents, their mean length), 1 where there is no term."""
        n, total = self._read("stats").agg(F.sum("n"), F.sum("total")).first()
        return n or 0, total / n if n and total else 1.0

    def _asked(self, queries: DataFrame) -> tuple[DataFrame, DataFrame, int]:
        """(query_id, term, times) of the queries, the blocks of their terms, and the number of these up to NAMED + 1."""
        term = F.explode(TOKENIZERS[self.tokenizer](F.col("query"))).alias("term")
        wanted = queries.select("query_id", term).groupBy("query_id", "term").agg(F.count("*").alias("times"))
        named = wanted.select("term", self.bucket_of(F.col("term")).alias("bucket")).distinct().limit(NAMED + 1).collect()
        rows = self._read("postings")
        if len(named) <= NAMED:
            rows = rows.where(F.col("bucket").isin(sorted({r["bucket"] for r in named})) & F.col("term").isin([r["term"] for r in named]))
        else:
            used = wanted.select(self.bucket_of(F.col("term"))).distinct().collect()  # `buckets` numbers at most
            rows = rows.where(F.col("bucket").isin([r[0] for r in used]))
        return wanted, rows.join(small(wanted.select("term").distinct()), "term", "left_semi"), len(named)

    @staticmethod
    def _weighted(wanted: DataFrame, found: DataFrame, n: int) -> DataFrame:
        """(query_id, term, times, idf) of the terms that the index has."""
        idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return wanted.join(found, "term").select("query_id", "term", "times", idf.alias("idf"))

    def _bounded(self, rows: DataFrame, weights: DataFrame, mean: float, k: int, k1: float, b: float) -> DataFrame:
        """The blocks, without their postings, for each query: their bound, what the rest can add, and the score to beat."""
        few = F.broadcast if fits(weights) else lambda df: df
        weights = weights.select("query_id", "term", (F.col("times") * F.col("idf")).alias("weight"))
        blocks = rows.select(*BLOCK, "n", "top_tf", "least_ratio").join(few(weights), "term")
        blocks = blocks.withColumn("bound", F.col("weight") * _bound(F.col("top_tf"), F.col("least_ratio"), mean, k1, b))
        best = blocks.groupBy("query_id", "term").agg(F.max("bound").alias("most"))
        rest = best.withColumn("rest", F.sum("most").over(Window.partitionBy("query_id")) - F.col("most")).select("query_id", "term", "rest")
        blocks = blocks.join(few(rest), ["query_id", "term"])
        chosen = top_k(blocks, ["query_id"], [F.col("bound").desc(), *BLOCK], PROBE, "_n").select("query_id", "weight", *BLOCK)
        probed = self._scores(rows.select(*BLOCK, "ids", "tfs", "lengths").join(few(chosen), BLOCK), mean, k1, b)
        reached = top_k(probed, ["query_id"], [F.col("score").desc(), "chunk_id"], k, "_n").where(F.col("_n") == k).select("query_id", F.col("score").alias("reached"))
        # one row a query; without k documents so far there is nothing to beat
        return blocks.join(few(reached), "query_id", "left").withColumn("reached", F.coalesce("reached", F.lit(0.0)))

    @staticmethod
    def _scores(blocks: DataFrame, mean: float, k1: float, b: float) -> DataFrame:
        """(query_id, chunk_id, score): sums over the blocks' postings."""
        each = blocks.select("query_id", "weight", F.explode(F.arrays_zip("ids", "tfs", "lengths")).alias("p"))
        part = F.col("weight") * _impact(F.col("p.tfs"), F.col("p.lengths"), mean, k1, b)
        return each.groupBy("query_id", F.col("p.ids").alias("chunk_id")).agg(F.sum(part).alias("score"))

    def search(self, queries: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75) -> DataFrame:
        """(query_id, chunk_id, score, rank): each query's k best chunks of a positive score, as bm25_search gives them.

        Postings are unfolded once, whatever the number of queries, gathered by chunk, and scored by best_chunks(). Blocks
        that no query needs are dropped before, if there are NAMED terms at most; of more, some query needs nearly all.
        """
        _checked(k, k1, b)
        n, mean = self._mean()
        wanted, rows, named = self._asked(queries)
        found = rows.groupBy("term").agg(F.sum("n").alias("df")).persist()
        try:
            weights = self._weighted(wanted, found, n)
            if named <= NAMED:
                kept = self._bounded(rows, weights, mean, k, k1, b).where(F.col("bound") + F.col("rest") + MARGIN >= F.col("reached"))
                # kept for the others too: a part of a chunk's score is no more than all of it, which can't reach their best
                rows = rows.join(small(kept.select(*BLOCK).distinct()), BLOCK, "left_semi")
            each = rows.select("term", F.explode(F.arrays_zip("ids", "tfs", "lengths")).alias("p"))
            held = each.groupBy(F.col("p.ids").alias("chunk_id"), F.col("p.lengths").alias("length")).agg(F.collect_list(F.struct("term", F.col("p.tfs").alias("tf"))).alias("t"))
            scores = best_chunks(held.select("chunk_id", "length", F.col("t.term").alias("terms"), F.col("t.tf").alias("tfs")), weights, mean, k, k1, b)
        finally:
            found.unpersist()
        return top_k(scores, ["query_id"], [F.round("score", 9).desc(), F.col("chunk_id").cast("string")], k)

    def pruning(self, queries: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75) -> DataFrame:
        """(query_id, blocks, kept, postings, postings_kept): what the bounds save a search."""
        _checked(k, k1, b)
        keep = F.col("bound") + F.col("rest") + MARGIN >= F.col("reached")
        n, mean = self._mean()
        wanted, rows, _ = self._asked(queries)
        weights = self._weighted(wanted, rows.groupBy("term").agg(F.sum("n").alias("df")), n)
        found = self._bounded(rows, weights, mean, k, k1, b).groupBy("query_id")
        return found.agg(F.count("*").alias("blocks"), F.count_if(keep).alias("kept"), F.sum("n").alias("postings"), F.sum(F.when(keep, F.col("n")).otherwise(0)).alias("postings_kept"))


def _checked(k: int, k1: float, b: float) -> None:
    if k <= 0 or k1 <= 0 or not 0 <= b <= 1:
        raise ValueError("k and k1 must be positive and b within 0 and 1")


def create(spark: SparkSession, path: str, tokenizer: str = "tokens", buckets: int = 64, block: int = 128) -> InvertedIndex:
    """A new empty index, or the one at the path if its settings are these."""
    if tokenizer not in TOKENIZERS or buckets <= 0 or block <= 0:
        raise ValueError(f"the tokenizer is one of {sorted(TOKENIZERS)}, and buckets and block are positive")
    if exists(spark, f"{path}/settings"):
        found = open_index(spark, path)
        if (found.tokenizer, found.buckets, found.block) != (tokenizer, buckets, block):
            raise ValueError(f"the index at {path} has other settings")
        return found
    one = spark.range(1).select(F.lit(tokenizer).alias("tokenizer"), F.lit(buckets).alias("buckets"), F.lit(block).alias("block"))
    one.write.mode("overwrite").json(f"{path}/settings")
    return InvertedIndex(spark, path, tokenizer, buckets, block)


def open_index(spark: SparkSession, path: str) -> InvertedIndex:
    r = spark.read.schema("tokenizer string, buckets int, block int").json(f"{path}/settings").first()
    return InvertedIndex(spark, path, r["tokenizer"], r["buckets"], r["block"])


__all__ = ["InvertedIndex", "create", "open_index"]
