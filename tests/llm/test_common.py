import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from evigrain.llm import common as c


def test_hot_keys_join_like_others(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"))
    stats = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    got = c.attach_by_key(rows, stats, "k", "n")
    assert got.count() == 3000 and got.where("k = 'hot'").agg(F.max("low"), F.count("*")).first()[:] == (0, 1000)
    assert c.attach_by_key(rows.limit(0), stats.limit(0), "k", "n").count() == 0


def test_id_filter_loses_no_row(spark):
    rows = spark.createDataFrame([(i * 7919 - 5_000_000, "x") for i in range(2000)] + [(None, "n")], "id long, t string")
    some = rows.where("id % 2 = 0").select("id")
    bits = c.id_filter(some)
    inside, outside = (c.split_by_filter(rows, "id", bits, inside=x) for x in (True, False))
    assert inside.join(some, "id", "left_semi").count() == some.count()
    assert inside.count() + outside.count() == 2001 and outside.where("id is null").count() == 1
    assert c.id_filter(some.limit(0)).sum() == 0


def test_word_hashes_are_those_of_words():
    texts = ["One two  THREE", "", " \tone\n", "é É two", "x\xa0y"]
    data, offsets = c.utf8_view(pa.array(texts))
    h, at = c.word_hashes(data, offsets)
    words = [w for t in texts for w in t.encode().lower().split()]
    assert np.diff(at).tolist() == [len(t.encode().lower().split()) for t in texts]
    by = {}
    for w, x in zip(words, h.tolist()):
        assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by)


def test_shingles_don_t_depend_on_neighbours():
    rng = np.random.default_rng(0)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 40, int(rng.integers(0, 30)))) for _ in range(50)]
    whole = list(c.shingle_sets(pa.array(texts)))
    for t, s in zip(texts, whole):
        (alone,) = c.shingle_sets(pa.array([t]))
        w = t.split()
        want = len({tuple(w[i : i + 5]) for i in range(len(w) - 4)}) if len(w) >= 5 else int(bool(w))
        assert (alone == s).all() and len(s) == want
    sliced = list(c.shingle_sets(pa.array(texts).slice(20, 10)))
    assert all((a == b).all() for a, b in zip(sliced, whole[20:30]))


def test_tables_are_written_to_the_shared_folder(spark):
    df = c.materialize(spark.range(5), "t")
    assert df._evigrain_path.startswith(c.shared_dir(spark)) and df.count() == 5
    c.discard(df)


def test_runs_cross_batches():
    b = [pa.RecordBatch.from_pydict({"k": k, "v": v}) for k, v in (([1, 1, 2], [0, 1, 2]), ([2, 2], [3, 4]), ([], []), ([3], [5]))]
    b[2] = pa.RecordBatch.from_pydict({"k": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
    assert [t["v"].to_pylist() for t in c.runs_of(b, 1)] == [[0, 1], [2, 3, 4], [5]]
