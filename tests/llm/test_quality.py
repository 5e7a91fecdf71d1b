import numpy as np
import pyarrow as pa

from evigrain.llm import quality as q
from evigrain.llm.common import read_table


def corpus(n=400, seed=0):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefghij"), int(rng.integers(2, 8)))) for _ in range(500)]
    texts, y = [], []
    for i in range(n):
        good = " ".join(rng.choice(words, int(rng.integers(20, 300)))) + "."
        if i % 3 == 0:
            bad = [" ".join(w.upper() + "!!" for w in good.split()), good.replace(" ", " | "), " ".join(w for w in good.split() for _ in range(6)), good.replace(" ", "*** ")][i // 3 % 4]
            texts.append(bad)
        else:
            texts.append(good)
        y.append(int(i % 3 != 0))
    return texts, y


def test_gradients():
    rng = np.random.default_rng(2)
    x, owner, y = rng.normal(size=(40, 6)), np.sort(rng.integers(0, 9, 40)), rng.integers(0, 2, 9).astype(float)
    owner[-1] = 8
    owner = np.unique(owner, return_inverse=True)[1]
    y = y[: owner.max() + 1]
    y[:2] = 0, 1
    model = q.fit_bags(x, owner, y, steps=300, penalty=0)
    out = model.forward(x, owner, len(y))[-1]
    assert ((out > 0.5) == y.astype(bool)).all()
    a = model.forward(x, owner, len(y))[4]
    assert np.allclose(np.bincount(owner, a), 1)


def test_gradients_against_differences():
    """One step of the fit without momentum's history moves each weight against the loss' numeric gradient."""
    rng = np.random.default_rng(4)
    x, owner, y = rng.normal(size=(30, 5)), np.sort(np.arange(30) % 7), np.array([0, 1, 1, 0, 1, 0, 1.0])
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    start, moved = (q.fit_bags(x, owner, y, steps=k, rate=1e-6, penalty=0) for k in (0, 1))

    def loss(model):
        p = model.forward(x, owner, len(y))[-1]
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()

    for k, a in start.p.items():
        flat = a.reshape(-1)
        for i in range(0, len(flat), max(1, len(flat) // 6)):
            was = flat[i]
            flat[i] = was + 1e-5
            up = loss(start)
            flat[i] = was - 1e-5
            slope = (up - loss(start)) / 2e-5
            flat[i] = was
            if abs(slope) > 1e-7:  # Adam's first step is the gradient's sign
                assert np.sign(moved.p[k].reshape(-1)[i] - was) == -np.sign(slope)


def test_all_passages_of_long_texts_are_learned_from():
    texts, y = corpus(60)
    seen = []
    was, q.fit_bags = q.fit_bags, lambda x, owner, y: seen.append((len(x), np.bincount(owner)))
    try:
        q.train(texts + ["long text " * 30_000], y + [1])
    finally:
        q.fit_bags = was
    assert seen[0][1][-1] == -(-300_000 // q.PASSAGE) and seen[0][0] == seen[0][1].sum()


def test_repeated_rows_and_batches(spark):
    texts, y = corpus(120)
    docs = spark.createDataFrame([(i, s) for i, s in enumerate(texts)] + [(1, texts[1])] * 3 + [(500 + k, texts[0]) for k in range(6)], "doc_id long, text string")
    model = q.fit(docs, spark.createDataFrame(list(enumerate(y)), "doc_id long, quality int"))
    got = [sorted({(r.doc_id, round(r.score, 9)) for r in q.score(docs.repartition(n), model).collect()}) for n in (1, 7)]
    assert got[0] == got[1] and len({s for d, s in got[0] if d == 0 or d >= 500}) == 1


def test_held_out_rows_of_the_documents(spark):
    """AUC and recall on held-out rows at sf0.1."""
    d = "/root/testdata/sf0.1"
    rows = q.op3_quality(spark, d).where("held_out").join(read_table(spark, d, "labels"), "doc_id").select("score", "predicted", "quality").collect()
    good, poor = (np.array([r.score for r in rows if r.quality == v]) for v in (1, 0))
    assert (good[:, None] > poor[None, :]).mean() > 0.99
    assert np.mean([r.predicted == 0 for r in rows if r.quality == 0]) > 0.95 and np.mean([r.predicted for r in rows if r.quality == 1]) > 0.99


def test_held_out_accuracy():
    texts, y = corpus()
    model = q.train(texts[:300], y[:300])
    s = model.score(pa.array(texts[300:]))
    assert ((s >= q.PREDICT) == np.array(y[300:], bool)).mean() > 0.97
    weights = model.attention(texts[1] + " " + texts[0])
    assert abs(sum(weights) - 1) < 1e-6


def test_edges(spark):
    texts, y = corpus(120)
    rows = [(i, s) for i, s in enumerate(texts)] + [(1000, None), (1001, ""), (1002, "Word\xa0" * 60_000), (1003, "\n\t \x0b\x0c")]
    docs = spark.createDataFrame([(a, b, 0.5) for a, b in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, v) for i, v in enumerate(y)] + [(None, 1), (7, None)], "doc_id long, quality int")
    model = q.fit(docs, labels)
    got = {r.doc_id: r for r in q.score(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert got[1000].score == got[1001].score
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.values())
    kept = q.keep(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if r.predicted}
    assert q.score(docs.limit(0), q.fit(docs.limit(0), labels)).count() == 0


def test_documents(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    got = q.op3_quality(spark, sf_dir)
    assert got.count() == docs.count()
    rows = got.join(read_table(spark, sf_dir, "labels"), "doc_id").where("held_out").select("predicted", "quality").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.8 * len(rows)


def test_scores_do_not_depend_on_neighbours():
    """All ASCII white space divides words, so no text takes the word features from others, nor from itself."""
    texts, y = corpus(120)
    model = q.train(texts, y)
    odd = ["a\x0cb\x0b\x0cc", "one\x0btwo", "\x0c"]
    alone = [float(model.score(pa.array([t]))[0]) for t in texts + odd]
    assert np.allclose(model.score(pa.array(texts + odd)), alone, atol=1e-9)
    x, owner = q.passages(*q.utf8_view(pa.array(["the the cat\x0cthe\x0bend", "the the cat the end"])))
    assert owner.tolist() == [0, 1] and np.array_equal(x[0, -4:], x[1, -4:]) and (x[0, -4:] > 0).all()
