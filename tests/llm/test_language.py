import zlib

import numpy as np
import pyarrow as pa
import pytest

from evigrain.llm import language as la
from evigrain.llm.common import read_table


def test_gradients_against_differences():
    rng = np.random.default_rng(1)
    p = la.start(3, seed=5)
    x, y = rng.integers(1, 256, (6, 20)), np.array([0, 1, 2, 0, 1, 2])
    x[:, 15:] = 0

    def loss():
        s = la.forward(p, x)[2]
        s = s - s.max(axis=1, keepdims=True)
        return -np.mean(s[np.arange(6), y] - np.log(np.exp(s).sum(axis=1)))

    g = la.gradients(p, x, y)
    for k, a in p.items():
        flat = a.reshape(-1)
        for i in range(EMBED_FROM if k == "E" else 0, len(flat), max(1, len(flat) // 9)):
            was = flat[i]
            flat[i] = was + 1e-6
            up = loss()
            flat[i] = was - 1e-6
            slope = (up - loss()) / 2e-6
            flat[i] = was
            assert abs(slope - g[k].reshape(-1)[i]) < 1e-5, k


EMBED_FROM = la.EMBED  # byte 0 is not learned


def test_pair_tables_give_the_convolution():
    p = la.start(4, seed=2)
    model, rng = la.Model(list("abcd"), p), np.random.default_rng(0)
    x = rng.integers(0, 256, (130, la.WINDOW + 3)).astype(np.uint8)
    want = np.zeros((130, la.FILTERS * 3))
    for i, w in enumerate(la.WIDTHS):
        for place in range(la.WINDOW):
            h = sum(p["E"][x[:, place + k]] @ p[f"W{w}"][k] for k in range(w))
            own = want[:, i * la.FILTERS : (i + 1) * la.FILTERS]
            own[:] = h if place == 0 else np.maximum(own, h)
    assert np.allclose(model.pooled(x), want, atol=1e-4)


def test_windows_cover_every_byte():
    texts = ["", "a", "b" * 256, "c" * 700]
    data, offsets = la.utf8_view(pa.array(texts))
    x, owner, n = la.windows(data, offsets)
    assert owner.tolist() == [0, 1, 2, 3, 3, 3] and n.tolist() == [0, 1, 256, 256, 256, 188]
    assert bytes(x[3]) == b"c" * 259 and bytes(x[5]) == b"c" * 188 + bytes(71) and not x[0].any()
    long = np.frombuffer(bytes(range(1, 252)) * 40, np.uint8)
    whole = la.windows(long, np.array([0, len(long)]))
    parts = list(la._in_turn(long, np.array([0, len(long)]), most=1024))
    assert np.array_equal(np.concatenate([x for x, _, _ in parts]), whole[0]) and np.array_equal(np.concatenate([n for _, _, n in parts]), whole[2])


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs = read_table(spark, d, "documents")
    model = la.fit(docs)
    got = la.predict(docs, model).collect()
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    right = sum(r.lang_pred == lang[r.doc_id] for r in held)
    assert len(got) == len(lang) and right >= 0.97 * len(held), (right, len(held))
    # the other columns are no inputs
    other = docs.selectExpr("doc_id", "text", "cast(null as string) lang", "'x' source")
    assert sorted(map(tuple, la.predict(other, model).collect())) == sorted(map(tuple, got))


def test_edge_cases(spark):
    words = {"en": "the of and with from which their ", "de": "der und die nicht über für großen ", "el": "και το της στην από "}
    rng = np.random.default_rng(0)
    rows = [(k, " ".join(rng.permutation(words[lang].split() * 3)), lang) for k, lang in enumerate(list(words) * 60)]
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "12 !? 34", "de"), (1003, "und nicht die", None), (1003, "und nicht die", None), (None, "της στην", "el"), (1004, "the with of which " * 150_000, "de")]
    df = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    model = la.fit(df)
    got = la.predict(df, model).collect()
    tail = got[-7:]
    assert [r.lang_pred for r in tail] == ["und", "und", "und", "de", "de", "el", "en"] and tail[3] == tail[4] and tail[5].held_out is False
    assert all(r.score == 0 for r in tail[:3])
    assert sum(r.lang_pred == lang for r, (_, _, lang) in zip(got[:-7], rows[:-7])) >= 178
    assert la.predict(df.limit(0), model).count() == 0
    none = la.fit(df.selectExpr("doc_id", "text", "cast(null as string) lang"))
    assert none.languages == [] and {r.lang_pred for r in la.predict(df, none).collect()} == {"und"}
    one = la.fit(df.where("lang = 'en'"))
    assert one.languages == ["en"] and la.predict(df, one).where("lang_pred = 'en'").count() == len(rows) - 3


@pytest.mark.parametrize("n", [1, 3, 200])
def test_neighbours_do_not_matter(n):
    model = la.Model(["a", "b", "c"], la.start(3, seed=3))
    text = "some text that is scored alone or among others"
    alone = model.predict(pa.array([text]))
    among = model.predict(pa.array(["x" * k for k in range(n)] + [text]))
    assert alone[0][0] == among[0][-1] and alone[1][0] == among[1][-1]
