"""A stored vector index: inverted lists round coarse centroids, with product codes of the residuals, and exact answers.

train() fits the centroids and the codebooks on a bounded sample; add() puts every row of a segment into the list of its
nearest centroid, with its distance from it and a code of what is left. Under the path: model/, stats/segment=N (rows
and radius of each list) and lists/segment=N/list=L (the rows, other columns included).

search() looks into each query's nearest lists, ranks their rows by codes, and scores the best of these again from their
vectors. exact() gives what a scan of all rows gives: the k-th best score of search() bounds the distance of anything
better, and by the triangle inequality a list, and within a list a row, whose distance from the centroid lies too far
off can't be nearer. Filters are conditions on the stored columns and hold inside the lists, before anything is ranked.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StructField, StructType

from ..functions.vectors import cosine
from ..sources.files import exists
from .retrieval import QUERY_BLOCK, _matrix, blocks_of
from .shared import require_none, small, top_k

#: Rows that train() fits on, chosen by a hash of their vector; all other rows are only indexed.
SAMPLE = 20_000
#: Codewords of a part of the residual.
WORDS = 256
ROUNDS = 12
#: Share of the lists that a search looks into if nothing else is said: enough for vectors without any clusters.
PROBED = 0.625
#: Added to distances that decide what is left out.
SLACK = 1e-6


def unit_rows(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The number of each row's nearest centre, the first of equally near ones; in runs of bounded memory."""
    half, out = (centres * centres).sum(axis=1) / 2, np.empty(len(x), np.int64)
    for k in range(0, len(x), 4096):
        out[k : k + 4096] = (x[k : k + 4096] @ centres.T - half).argmax(axis=1)
    return out


def clusters(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's rounds from k different rows; a centre that loses all rows starts again at the row farthest from its own."""
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(ROUNDS):
        own = nearest(x, centres)
        count = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        far = iter(np.argsort(-((x - centres[own]) ** 2).sum(axis=1)))
        centres = sums / np.maximum(count, 1)[:, None]
        for j in np.flatnonzero(count == 0):
            centres[j] = x[next(far)]
    return centres


@dataclass(frozen=True)
class Model:
    centres: np.ndarray
    words: list[np.ndarray]  # of each part

    @property
    def width(self) -> int:
        return self.centres.shape[1]

    def cuts(self) -> list[slice]:
        edges = np.cumsum([0, *(w.shape[1] for w in self.words)])
        return [slice(a, b) for a, b in zip(edges[:-1], edges[1:])]

    def encode(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, distance from its centre, code) of unit rows."""
        own = nearest(v, self.centres)
        rest = v - self.centres[own]
        code = np.stack([nearest(rest[:, c], w) for c, w in zip(self.cuts(), self.words)], axis=1).astype(np.uint8)
        return own, np.linalg.norm(rest, axis=1), code


def fit_model(v: np.ndarray, lists: int, parts: int, seed: int = 0) -> Model:
    rng = np.random.default_rng(seed)
    centres = clusters(v, lists, rng)
    rest = v - centres[nearest(v, centres)]
    return Model(centres, [clusters(np.ascontiguousarray(rest[:, c]), WORDS, rng) for c in np.array_split(np.arange(v.shape[1]), parts)])


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession
    path: str
    model: Model

    def add(self, chunks: DataFrame, segment: int, key: str = "chunk_id") -> int:
        """Index the rows as a segment, with their other columns, and give the number indexed.

        The same segment again replaces itself. Ids are not null, unlike each other and those of other segments, else
        nothing is written. Vectors that are null, zero, of another width or with unusable parts match nothing and are left out.
        """
        rows = chunks.withColumnRenamed(key, "chunk_id")
        require_none(rows.where("chunk_id is null").select("chunk_id"), "a chunk has no id")
        require_none(rows.groupBy("chunk_id").count().where("count > 1"), "two chunks have one id")
        if exists(self.spark, f"{self.path}/stats"):
            others = self.rows().where(F.col("segment") != segment).select("chunk_id")
            require_none(rows.select("chunk_id").join(others, "chunk_id", "left_semi"), "a chunk is in another segment")
        model, at = self.model, rows.columns.index("embedding")
        schema = StructType([*rows.schema.fields, StructField("list", IntegerType()), StructField("distance", DoubleType()), StructField("code", BinaryType())])

        def run(batches):
            for batch in batches:
                place, v = _matrix(batch.column(at)).get(model.width, (np.zeros(0, np.int64), None))
                if not len(place):
                    continue
                own, far, code = model.encode(v)
                part = batch.take(pa.array(place))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own.astype(np.int32)), pa.array(far), pa.array([c.tobytes() for c in code], pa.binary())], [f.name for f in schema.fields])

        self._write(rows.mapInArrow(run, schema).repartition("list"), "lists", segment, "list")
        done = self.spark.read.schema("distance double, list int").parquet(f"{self.path}/lists/segment={segment}")
        self._write(done.groupBy("list").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).coalesce(1), "stats", segment)
        self._write(rows.limit(0), "columns", segment)
        return self.spark.read.parquet(f"{self.path}/stats/segment={segment}").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def _write(self, rows: DataFrame, table: str, segment: int, *by: str) -> None:
        writer = rows.write.mode("overwrite")
        (writer.partitionBy(*by) if by else writer).parquet(f"{self.path}/{table}/segment={segment}")

    def rows(self) -> DataFrame:
        """All rows indexed: their own columns, embedding, distance, code, segment and list."""
        own = self.spark.read.parquet(f"{self.path}/columns").drop("segment").schema
        added = StructType.fromDDL("distance double, code binary, segment int, list int")
        return self.spark.read.schema(StructType([*own.fields, *added.fields])).parquet(f"{self.path}/lists")

    def lists(self) -> DataFrame:
        """(list, n, radius) over all segments."""
        return self.spark.read.parquet(f"{self.path}/stats").groupBy("list").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"))

    # --- searching -------------------------------------------------------------------------------------

    def _blocks(self, queries: DataFrame):
        """The queries in blocks that a task can hold: (rows with their number, unit vectors), unusable ones left out."""
        q = queries.select("query_id", F.col("embedding").cast("array<double>").alias("q")).where("q is not null")
        blocks = max(1, -(-q.count() // QUERY_BLOCK))
        for b in range(blocks):
            part = (q if blocks == 1 else q.where(F.pmod(F.xxhash64(F.to_json(F.struct("query_id"))), F.lit(blocks)) == b)).toArrow()
            place, v = _matrix(part["q"].combine_chunks()).get(self.model.width, (np.zeros(0, np.int64), None)) if part.num_rows else (np.zeros(0, np.int64), None)
            if len(place):
                part = part.take(pa.array(place)).append_column("at", pa.array(np.arange(len(place), dtype=np.int32)))
                yield self.spark.createDataFrame(part), v

    def _probe(self, k: int, probe: int | None, again: int) -> int:
        probe = ceil(PROBED * len(self.model.centres)) if probe is None else probe
        if k <= 0 or probe <= 0 or again <= 0:
            raise ValueError("k, probe and again must be positive")
        return probe

    def search(self, queries: DataFrame, k: int = 10, probe: int | None = None, again: int = 10, where: Column | None = None) -> DataFrame:
        """(query_id, chunk_id, score, rank): of the `probe` nearest lists the best k, chosen from k * again by codes.

        Without `probe`, PROBED of the lists; vectors that lie in clusters need far fewer than that. Approximate: a near row of a list farther off, or whose code misleads, may be missing; scores given are exact.
        """
        probe = self._probe(k, probe, again)
        found = [self._search(q, v, k, probe, again, where) for q, v in self._blocks(queries)]
        return self._ranked(found, queries, k)

    def exact(self, queries: DataFrame, k: int = 10, probe: int | None = None, again: int = 10, where: Column | None = None) -> DataFrame:
        """(query_id, chunk_id, score, rank): the best k of all rows, as dense_search gives them."""
        probe = self._probe(k, probe, again)
        found = []
        for q, v in self._blocks(queries):
            first = top_k(self._search(q, v, k, probe, again, where), ["at"], [F.col("score").desc(), "chunk_id"], k, "_n")
            known = first.where(F.col("_n") == k).select("at", "score").collect()  # a number a query of the block
            least = np.full(len(v), -1.0)
            for r in known:
                least[r["at"]] = r["score"]
            found.append(self._within(q, v, least, k, where))
        return self._ranked(found, queries, k)

    def _ranked(self, found: list[DataFrame], queries: DataFrame, k: int) -> DataFrame:
        if not found:
            kind, ident = (queries.schema["query_id"].dataType.simpleString(), self.rows().schema["chunk_id"].dataType.simpleString())
            return self.spark.createDataFrame([], f"query_id {kind}, chunk_id {ident}, score double, rank int")
        whole = found[0].select("query_id", "chunk_id", "score")
        for part in found[1:]:
            whole = whole.unionByName(part.select("query_id", "chunk_id", "score"))
        return top_k(whole, ["query_id"], [F.round("score", 9).desc(), F.col("chunk_id").cast("string")], k)

    def _chosen(self, rows: DataFrame, where: Column | None, wanted: np.ndarray) -> DataFrame:
        """The rows of lists that some query wants; lists is a partition column, so others aren't read."""
        rows = rows.where(F.col("list").isin(np.flatnonzero(wanted.any(axis=0)).tolist()))
        return rows if where is None else rows.where(where)

    def _search(self, q: DataFrame, v: np.ndarray, k: int, probe: int, again: int, where: Column | None) -> DataFrame:
        model, most = self.model, k * again
        near = v @ model.centres.T
        far = np.sqrt(np.maximum(0, 1 + (model.centres**2).sum(axis=1) - 2 * near))
        some = np.argsort(far, axis=1, kind="stable")[:, : min(probe, far.shape[1])]
        wanted = np.zeros(far.shape, bool)
        np.put_along_axis(wanted, some, True, axis=1)
        rows = self._chosen(self.rows(), where, wanted).select("chunk_id", "list", "code")
        schema = StructType([StructField("at", IntegerType()), rows.schema["chunk_id"], StructField("list", IntegerType()), StructField("guess", DoubleType())])

        def run(batches):
            # what each codeword adds to each query's score
            adds = [v[:, c] @ w.T for c, w in zip(model.cuts(), model.words)]
            for batch in batches:
                own = batch.column(1).to_numpy()
                code = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(own), len(adds))
                for j in np.unique(own):
                    asking, at = np.flatnonzero(wanted[:, j]), np.flatnonzero(own == j)
                    for who in (asking[part] for part in blocks_of(len(asking), len(at))):
                        guess = np.repeat(near[who, j][:, None], len(at), axis=1)
                        for m, table in enumerate(adds):
                            guess += table[who][:, code[at, m]]
                        low = np.partition(guess, -most, axis=1)[:, -most] if len(at) > most else np.full(len(who), -np.inf)
                        a, b = np.nonzero(guess >= low[:, None])
                        yield pa.RecordBatch.from_arrays([pa.array(who[a].astype(np.int32)), batch.column(0).take(pa.array(at[b])), pa.array(np.full(len(a), j, np.int32)), pa.array(guess[a, b])], ["at", "chunk_id", "list", "guess"])

        best = top_k(rows.mapInArrow(run, schema), ["at"], [F.col("guess").desc(), "chunk_id"], most, "_n").drop("_n", "guess")
        stored = self._chosen(self.rows(), where, wanted).select("chunk_id", "list", "embedding")
        whole = stored.join(small(best), ["chunk_id", "list"]).join(small(q), "at")
        return whole.select("at", "query_id", "chunk_id", cosine(F.col("embedding"), F.col("q")).alias("score"))

    def _within(self, q: DataFrame, v: np.ndarray, least: np.ndarray, k: int, where: Column | None) -> DataFrame:
        """Scores of all rows that may score `least` of a query or more, cut to each batch's best k and ties."""
        centres = self.model.centres
        far = np.sqrt(np.maximum(0, 1 + (centres**2).sum(axis=1) - 2 * v @ centres.T))
        reach = np.sqrt(np.maximum(0, 2 - 2 * least)) + SLACK
        radius = np.full(len(centres), -1.0)
        for r in self.lists().collect():  # a row a list
            radius[r["list"]] = r["radius"]
        wanted = (radius >= 0) & (far - radius <= reach[:, None])
        rows = self._chosen(self.rows(), where, wanted).select("chunk_id", "list", "distance", "embedding")
        schema = StructType([StructField("at", IntegerType()), rows.schema["chunk_id"], StructField("score", DoubleType())])

        def run(batches):
            for batch in batches:
                own, off = batch.column(1).to_numpy(), batch.column(2).to_numpy()
                for place, x in _matrix(batch.column(3)).values():
                    for j in np.unique(own[place]):
                        asking, here = np.flatnonzero(wanted[:, j]), np.flatnonzero(own[place] == j)
                        for who in (asking[part] for part in blocks_of(len(asking), len(here))):
                            may = np.abs(far[who, j][:, None] - off[place[here]]) <= reach[who][:, None]
                            some = may.any(axis=0)
                            at, may = here[some], may[:, some]
                            score = np.where(may, v[who] @ x[at].T, -np.inf)
                            low = np.partition(score, -k, axis=1)[:, -k] if len(at) > k else np.full(len(who), -np.inf)
                            a, b = np.nonzero(may & (score >= low[:, None] - 1e-8))
                            yield pa.RecordBatch.from_arrays([pa.array(who[a].astype(np.int32)), batch.column(0).take(pa.array(place[at[b]])), pa.array(score[a, b])], ["at", "chunk_id", "score"])

        return rows.mapInArrow(run, schema).join(small(q.select("at", "query_id")), "at")


def train(spark: SparkSession, path: str, vectors: DataFrame, lists: int = 64, parts: int = 8, seed: int = 0) -> VectorIndex:
    """A new index: centroids and codebooks from at most SAMPLE of the usable rows, chosen by a hash of their vector.

    All usable vectors have the width of the sample's first; fewer rows than lists make fewer lists. Nothing is indexed yet.
    """
    if lists <= 0 or parts <= 0:
        raise ValueError("lists and parts must be positive")
    rows = vectors.select(F.col("embedding").cast("array<double>").alias("v")).where("v is not null").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).toArrow()
    usable = _matrix(rows["v"].combine_chunks()) if rows.num_rows else {}
    usable = {d: v for d, (at, v) in usable.items() if len(at)}
    if len(usable) != 1:
        raise ValueError("the sample needs usable vectors, all of one width")
    v = next(iter(usable.values()))
    model = fit_model(v, lists, min(parts, v.shape[1]), seed)
    kinds = [("centre", 0, k, c.tolist()) for k, c in enumerate(model.centres)]
    kinds += [("word", m, k, c.tolist()) for m, w in enumerate(model.words) for k, c in enumerate(w)]
    spark.createDataFrame(kinds, "kind string, part int, number int, v array<double>").coalesce(1).write.mode("errorifexists").parquet(f"{path}/model")
    return VectorIndex(spark, path, model)


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    got = spark.read.parquet(f"{path}/model").orderBy("kind", "part", "number").collect()  # its size is a parameter of train()
    of = lambda kind, part: np.array([r["v"] for r in got if (r["kind"], r["part"]) == (kind, part)])
    return VectorIndex(spark, path, Model(of("centre", 0), [of("word", m) for m in sorted({r["part"] for r in got if r["kind"] == "word"})]))


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, recall): the share of a query's true answers that were found."""
    hit = found.select("query_id", "chunk_id").distinct().withColumn("hit", F.lit(1))
    return truth.select("query_id", "chunk_id").distinct().join(hit, ["query_id", "chunk_id"], "left").groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))


__all__ = ["VectorIndex", "open_index", "recall", "train"]
