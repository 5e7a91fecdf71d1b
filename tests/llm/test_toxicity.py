from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from evigrain.llm import toxicity as t
from evigrain.llm.common import labelled_sample, read_table


def corpus(n=600, seed=0):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(400)]
    texts, y = [], []
    for i in range(n):
        ws = list(rng.choice(words, 40))
        bad = i % 4 == 0
        for _ in range(int(rng.integers(1, 8)) if bad else 0):
            ws.insert(int(rng.integers(0, 40)), str(rng.choice(["Vile!", "rotten,", "awful"])))
        texts.append(" ".join(ws))
        y.append(int(bad))
    return texts, y


def test_held_out_accuracy_and_ordered_grades():
    texts, y = corpus()
    model = t.train(texts[:400], y[:400])
    p = model.at_least(pa.array(texts[400:]))
    assert (np.diff(p, axis=1) <= 0).all() and (np.diff(model.thetas) > 0).all()
    assert ((p[:, 0] >= t.REJECT) == np.array(y[400:])).mean() > 0.99
    one, many = (model.at_least(pa.array([s])).sum() for s in ("w1 vile w2", "vile vile rotten awful awful awful awful"))
    assert many > one


def test_gradient_fit_recovers_a_known_model():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6000, 3)).astype(np.float32)
    w, theta = np.array([1.0, -2.0, 0.5]), np.array([-1.0, 0.5, 2.0])
    u = rng.uniform(size=6000)
    y = (u[:, None] > 1 / (1 + np.exp(-(theta[None, :] - (x @ w)[:, None])))).sum(axis=1)
    row, col = np.divmod(np.arange(x.size), 3)
    got, thetas = t.fit_cumulative(row, col, x.ravel(), x.shape, y, 4, penalty=0, steps=1500)
    assert np.abs(got - w).max() < 0.15 and np.abs(thetas - theta).max() < 0.15


def test_scores_against_plain_loops():
    texts, y = corpus(300)
    model = t.train(texts, y)
    weight = dict(zip(model.features.tolist(), model.weights.tolist()))
    some = texts[:40] + ["", "vile", "Rotten rotten ROTTEN awfully é", "vile" * 4000]
    for text, got in zip(some, model.at_least(pa.array(some)), strict=True):
        _, found = t.text_features(*t.utf8_view(pa.array([text])))
        z = sum(weight[f] * np.log1p(n) for f, n in Counter(found.tolist()).items() if f in weight)
        assert np.allclose(got, [1 / (1 + np.exp(theta - z)) for theta in model.thetas])


def test_grades_are_thirds_and_ties_the_lower():
    assert t.grades_of(np.arange(9.0)).tolist() == [1, 1, 1, 2, 2, 2, 3, 3, 3]
    assert t.grades_of(np.array([2.0, 2.0, 2.0])).tolist() == [1, 1, 1]


def test_scores_do_not_depend_on_neighbours():
    texts, y = corpus(200)
    model = t.train(texts, y)
    alone = np.concatenate([model.at_least(pa.array([s])) for s in texts])
    assert np.allclose(model.at_least(pa.array(texts)), alone) and np.allclose(model.at_least(pa.array(texts[::-1]))[::-1], alone)


def test_the_sample_is_bounded(spark):
    rows = [(i, "x" * (10 + i)) for i in range(60)] + [(7, "x" * 17), (7, "other"), (100, "y" * 5000), (101, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(i, i % 2) for i in range(102)], "doc_id long, y int")
    got = labelled_sample(docs, known, 20, 800, "text", "doc_id").collect()
    for c in (0, 1):
        own = [r for r in got if r.y == c]
        assert 0 < len(own) <= 20 and sum(len(r.t) for r in own) <= 800 and all(len(r.t) <= 50 for r in own)
    assert len(set(map(tuple, got))) == len(got)


def test_held_out_rows_of_the_documents(spark):
    """Recall and clean documents kept on rows that weren't trained on, at sf0.1."""
    docs, labels = (read_table(spark, "/root/testdata/sf0.1", n) for n in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = t.fit(docs, labels, where=~held)
    rows = t.score(docs.join(labels.where(held), "doc_id", "left_semi"), model).join(labels, "doc_id").collect()
    caught, kept = ([r.rejected == bool(v) for r in rows if r.toxic == v] for v in (1, 0))
    assert sum(caught) >= 0.9 * len(caught) and sum(kept) >= 0.99 * len(kept)
    severity = {v: np.mean([r.expected_severity for r in rows if r.toxic == v]) for v in (0, 1)}
    assert severity[1] > severity[0] + 1


def test_repeated_rows_and_batches(spark):
    texts, y = corpus(200)
    docs = spark.createDataFrame([(i, s) for i, s in enumerate(texts)] + [(1, texts[1])] * 3 + [(500 + k, texts[0]) for k in range(6)], "doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(y)), "doc_id long, toxic int")
    model = t.fit(docs, labels)
    got = [{(r.doc_id, r.p_toxic) for r in t.score(docs.repartition(n), model).collect()} for n in (1, 7)]
    assert got[0] == got[1] and len({p for d, p in got[0] if d == 0 or d >= 500}) == 1
    again = t.fit(docs.repartition(5), labels)
    assert np.array_equal(model.features, again.features) and np.allclose(model.weights, again.weights)


def test_edges(spark):
    texts, y = corpus(200)
    rows = [(i, s) for i, s in enumerate(texts)] + [(1000, None), (1001, ""), (1002, "vile " * 50_000)]
    docs = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, y string")
    labels = spark.createDataFrame([(i, v) for i, v in enumerate(y)] + [(None, 1), (5, None), (5000, 1)], "doc_id long, toxic int")
    model = t.fit(docs, labels)
    got = {r.doc_id: r for r in t.score(docs, model).collect()}
    assert len(got) == len(rows) and got[1002].rejected and not got[1000].rejected and got[1000][1:] == got[1001][1:]
    kept = t.keep(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if not r.rejected}
    nothing = t.fit(docs.limit(0), labels)
    assert t.score(docs, nothing).where("rejected").count() == 0 and t.score(docs.limit(0), nothing).count() == 0


def test_documents(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    got = t.op2_toxicity(spark, sf_dir)
    assert got.count() == docs.count()
    joined = got.join(read_table(spark, sf_dir, "labels"), "doc_id").select("rejected", "toxic").collect()
    clean = [r.rejected for r in joined if r.toxic == 0]
    assert sum(clean) <= 0.03 * len(clean)
