"""The stored indexes against plain searches over the same rows."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from evigrain.operators import inverted, retrieval, vector_index
from evigrain.operators.shared import shared_path

WORDS = ["alpha", "beta", "gamma", "delta", "rare", "x-ray", "v1.2"]


def texts(n=400, seed=0):
    rng = np.random.default_rng(seed)
    share = np.array([40, 30, 15, 8, 1, 4, 2]) / 100
    return [(k, " ".join(rng.choice(WORDS, int(rng.integers(0, 40)), p=share))) for k in range(n)]


def same(a, b):
    key = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 8)) for r in df.collect())
    assert key(a) == key(b) and key(a)


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [*texts(), (1000, None), (1001, ""), (1002, "rare"), (1003, "Rare 材料科学 rare")]
    return spark.createDataFrame([(*r, "other") for r in rows], "chunk_id long, text string, term string")


@pytest.fixture(scope="module")
def queries(spark):
    rows = [(1, "alpha rare"), (2, "alpha"), (3, "beta beta gamma v1.2"), (4, "nothing here"), (5, ""), (6, "材料 rare"), (7, None), (8, "alpha beta gamma delta rare x-ray v1.2")]
    return spark.createDataFrame(rows, "query_id long, query string")


@pytest.mark.parametrize(("buckets", "block", "k"), [(4, 5, 3), (64, 128, 10), (1, 1, 1), (7, 16, 500)])
def test_index_search_equals_a_scan(spark, chunks, queries, buckets, block, k):
    index = inverted.create(spark, shared_path(spark, "index"), buckets=buckets, block=block)
    assert index.segments() == [] and index.add(chunks.where("chunk_id < 100"), 0) == 100
    same(index.search(queries, k), retrieval.bm25_search(chunks.where("chunk_id < 100"), queries, k))
    index.add(chunks.where("chunk_id >= 100"), 5)
    assert index.segments() == [0, 5]
    same(index.search(queries, k), retrieval.bm25_search(chunks, queries, k))
    same(index.search(queries, k, 1.1, 0.3), retrieval.bm25_search(chunks, queries, k, 1.1, 0.3))


def test_bounds_leave_out_blocks(spark, chunks, queries):
    index = inverted.create(spark, shared_path(spark, "index"), buckets=4, block=8)
    index.add(chunks, 0)
    got = {r.query_id: r for r in index.pruning(queries.where("query_id in (1, 2)"), 3).collect()}
    assert got[1].kept < got[1].blocks and got[2].kept < got[2].blocks / 4 and got[1].postings_kept < got[1].postings


def test_a_segment_replaces_itself_and_ids_are_checked(spark, chunks, queries):
    path = shared_path(spark, "index")
    index = inverted.create(spark, path, buckets=4)
    for _ in range(2):
        index.add(chunks.where("chunk_id < 200"), 0)
    index.add(chunks.where("chunk_id >= 200"), 1)
    same(inverted.open_index(spark, path).search(queries), retrieval.bm25_search(chunks, queries))
    for bad in (chunks.where("chunk_id = 3"), chunks.limit(3).unionByName(chunks.limit(3)), chunks.limit(1).withColumn("chunk_id", F.lit(None).cast("long"))):
        with pytest.raises(ValueError, match="chunk"):
            index.add(bad, 2)
    assert index.segments() == [0, 1]
    with pytest.raises(ValueError, match="settings"):
        inverted.create(spark, path, buckets=5)
    with pytest.raises(ValueError, match="tokenizer"):
        inverted.create(spark, path, tokenizer="none")


def test_empty_segments_and_string_ids(spark, chunks, queries):
    index = inverted.create(spark, shared_path(spark, "index"), tokenizer="latin_tokens")
    named = chunks.withColumn("chunk_id", F.concat(F.lit("c"), "chunk_id"))
    index.add(named.limit(0), 0)
    assert index.search(queries).count() == 0 and index.terms().count() == 0
    index.add(named.where("text = ''"), 1)
    assert index.search(queries).count() == 0
    index.add(named.where("text <> '' or text is null"), 2)
    from evigrain.functions.text import latin_tokens

    same(index.search(queries), retrieval.bm25_search(named, queries, tokenizer=latin_tokens))
    rare = {r.term: r for r in index.terms().collect()}["rare"]
    assert rare.documents == sum("rare" in (t or "").lower().split() for t, in chunks.select("text").collect())


def test_search_reads_its_terms_buckets_only(spark, chunks, queries):
    index = inverted.create(spark, shared_path(spark, "index"), buckets=32)
    index.add(chunks, 0)
    plan = index.search(queries.where("query_id = 2"))._jdf.queryExecution().executedPlan().toString()
    bucket = spark.range(1).select(index.bucket_of(F.lit("alpha"))).first()[0]
    assert f"(bucket#" in plan and "PartitionFilters: [isnotnull(bucket" in plan and f"= {bucket})" in plan and "EqualTo(term,alpha)" in plan


# --- vectors --------------------------------------------------------------------------------------------


def vectors(n=3000, width=32, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, width))
    v = centres[rng.integers(0, 40, n)] + 0.35 * rng.normal(size=(n, width))
    return [(k, [float(x) for x in row], k % 5) for k, row in enumerate(v)]


@pytest.fixture(scope="module")
def stored(spark):
    rows = [*vectors(), (9000, None, 1), (9001, [0.0] * 32, 1), (9002, [1.0] * 5, 1), (9003, [float("nan")] * 32, 1)]
    return spark.createDataFrame(rows, "chunk_id long, embedding array<double>, label int")


@pytest.fixture(scope="module")
def asked(spark, stored):
    some = stored.where("chunk_id % 100 = 0 and chunk_id < 3000").select(F.col("chunk_id").alias("query_id"), "embedding")
    return some.unionByName(spark.createDataFrame([(-1, None), (-2, [0.0] * 32), (-3, [1.0] * 4)], some.schema))


@pytest.fixture(scope="module")
def index(spark, stored):
    made = vector_index.train(spark, shared_path(spark, "vectors"), stored.where("chunk_id < 3000"), lists=24, parts=8)
    assert made.add(stored.where("chunk_id < 1000"), 0) == 1000
    assert made.add(stored.where("chunk_id >= 1000"), 1) == 2000
    return made


def test_exact_equals_a_scan(spark, stored, asked, index):
    good = stored.where("chunk_id < 3000")
    same(index.exact(asked, 10), retrieval.dense_search(good, asked, 10))
    same(index.exact(asked, 7, probe=1, again=1), retrieval.dense_search(good, asked, 7))
    same(index.exact(asked, 10, where=F.col("label") == 2), retrieval.dense_search(good.where("label = 2"), asked, 10))
    same(index.exact(asked, 4000), retrieval.dense_search(good, asked, 4000))
    assert index.exact(asked.limit(0)).count() == 0 == index.search(asked.limit(0)).count()


def test_recall_of_the_approximate_search(spark, stored, asked, index):
    truth = retrieval.dense_search(stored.where("chunk_id < 3000"), asked, 10)
    reach = {p: vector_index.recall(index.search(asked, 10, probe=p), truth).agg(F.avg("recall")).first()[0] for p in (1, 8)}
    assert reach[8] >= 0.9 and reach[1] <= reach[8], reach
    filtered = vector_index.recall(index.search(asked, 10, where=F.col("label") == 2), retrieval.dense_search(stored.where("label = 2"), asked, 10))
    assert filtered.agg(F.avg("recall")).first()[0] >= 0.9


def test_recall_on_vectors_without_clusters(spark):
    """The embeddings table's vectors, by the settings that hold if nothing is said."""
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").withColumnRenamed("vec_id", "chunk_id")
    made = vector_index.train(spark, shared_path(spark, "vectors"), v, lists=32, parts=16)
    made.add(v, 0)
    q = v.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    assert vector_index.recall(made.search(q, 10), retrieval.dense_search(v, q, 10)).agg(F.avg("recall")).first()[0] >= 0.9
    same(made.exact(q, 10), retrieval.dense_search(v, q, 10))


def test_lists_hold_all_usable_rows_once(spark, stored, index):
    assert index.rows().count() == 3000 == index.rows().select("chunk_id").distinct().count() and index.lists().agg(F.sum("n")).first()[0] == 3000
    again = vector_index.open_index(spark, index.path)
    assert np.allclose(again.model.centres, index.model.centres) and len(again.model.words) == 8
    assert again.add(stored.where("chunk_id >= 1000"), 1) == 2000 and index.rows().count() == 3000
    with pytest.raises(ValueError, match="another segment"):
        index.add(stored.where("chunk_id = 5"), 7)
    with pytest.raises(PySparkException):
        vector_index.train(spark, index.path, stored.where("chunk_id < 100"))
    with pytest.raises(ValueError, match="width"):
        vector_index.train(spark, shared_path(spark, "vectors"), stored)


def test_products_are_bounded_however_many_queries_come(spark):
    parts = retrieval.blocks_of(4096, 10_000)
    assert [q for part in parts for q in range(4096)[part]] == list(range(4096))
    assert max(len(range(4096)[part]) for part in parts) * 10_000 <= retrieval.CELLS
    rng = np.random.default_rng(3)
    v = rng.normal(size=(3000, 4))
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "chunk_id long, embedding array<double>").coalesce(1)
    got = retrieval.dense_search(rows, rows.where("chunk_id < 1200").withColumnRenamed("chunk_id", "query_id"), 2)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = np.argsort(-(u[:1200] @ u.T), axis=1, kind="stable")[:, :2]
    assert {(r.query_id, r["rank"]): r.chunk_id for r in got.collect()} == {(q, i + 1): c for q, own in enumerate(want.tolist()) for i, c in enumerate(own)}
