"""Quality classifier: gated attention over a document's passages (attention-based multiple-instance learning).

A passage is PASSAGE bytes of a text. It is described by its bytes' classes, the pairs of classes that follow each
other, and how its words repeat, and encoded by one tanh layer, h. Attention weights are the softmax over the passages
of w.(tanh(V h) * sigmoid(U h)); the document is the weighted mean of its passages' h, scored by a logistic unit. All
layers are learned together from document labels, by Adam on the driver, over all passages of at most TRAIN labelled
documents of each class with TRAIN_BYTES of text at most, chosen by a hash of their id. Scoring takes every passage of
every text, in one pass without a shuffle.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, read_table, slices, tidy, trim, utf8_view, word_hashes

PASSAGE = 512
#: Bounds of the fit: labelled rows of each class, and bytes of their texts.
TRAIN, TRAIN_BYTES = 1200, 4 << 20
HIDDEN, GATE, STEPS = 24, 12, 250
PREDICT = 0.3
#: Bytes of texts that are described at once.
RUN = 1 << 18
#: Every FOLDS-th row by crc32 of its id is held out.
FOLDS = 5

_CLASS = np.full(256, 11, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[32] = 0, 1, 2, 3
_CLASS[9:14] = 4  # with the blank, the white space of word_hashes
_CLASS[[ord("."), ord(","), ord(";"), ord(":"), ord("'"), ord('"'), ord("-"), ord("("), ord(")")]] = 5
_CLASS[[ord("!"), ord("?")]] = 6
_CLASS[[ord("|")]] = 7
_CLASS[[ord(c) for c in "*#$%&@^~=+_<>/\\[]{}`"]] = 8
_CLASS[128:192] = 9
_CLASS[192:256] = 10
KINDS = 12
WIDE = KINDS + KINDS * KINDS + 4


def held_out(ids) -> np.ndarray:
    return np.array([zlib.crc32(str(i).encode()) % FOLDS == 0 for i in ids], bool)


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, text number) of each passage; an empty text has one, of zeros."""
    size = np.diff(offsets)
    count = np.maximum(1, -(-size // PASSAGE))
    base = np.concatenate([[0], np.cumsum(count)])
    total = int(base[-1])
    owner = np.repeat(np.arange(len(size)), count)
    x = np.zeros((total, WIDE), np.float32)
    if len(data):
        text = np.repeat(np.arange(len(size)), size)
        place = base[text] + (np.arange(len(data)) - offsets[text]) // PASSAGE
        kind = _CLASS[data]
        n = np.bincount(place, minlength=total).astype(np.float32)
        n[n == 0] = 1
        x[:, :KINDS] = np.bincount(place * KINDS + kind, minlength=total * KINDS).reshape(total, KINDS) / n[:, None]
        next_to = place[1:] == place[:-1]
        cell = place[1:] * (KINDS * KINDS) + kind[:-1] * KINDS + kind[1:]
        x[:, KINDS : KINDS + KINDS * KINDS] = np.bincount(cell[next_to], minlength=total * KINDS * KINDS).reshape(total, -1) / n[:, None]
        # words, where they begin: share that repeats the word before or is in the passage already, mean length, number
        h, _ = word_hashes(data, offsets)
        space = (kind == 3) | (kind == 4)
        start = ~space
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        start[1:] &= space[:-1] | edge[1:-1]
        first = np.flatnonzero(start)
        where = place[first]
        words = np.bincount(where, minlength=total).astype(np.float32)
        some = np.maximum(words, 1)
        again = (h[1:] == h[:-1]) & (where[1:] == where[:-1])
        x[:, -4] = np.bincount(where[1:][again], minlength=total) / some
        order = np.lexsort((h, where))
        same = (h[order][1:] == h[order][:-1]) & (where[order][1:] == where[order][:-1])
        x[:, -3] = np.bincount(where[order][1:][same], minlength=total) / some
        x[:, -2] = np.bincount(place[~space], minlength=total) / some / 16
        x[:, -1] = words / 128
    return x, owner


def softmax_by(a: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    top = np.full(n, -np.inf)
    np.maximum.at(top, owner, a)
    e = np.exp(a - top[owner])
    return e / np.bincount(owner, e, n)[owner]


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, owner: np.ndarray, n: int):
        return self.forward_scaled(np.clip((x - self.mean) / self.scale, -8, 8), owner, n)

    def forward_scaled(self, x: np.ndarray, owner: np.ndarray, n: int):
        p = self.p
        h = np.tanh(x @ p["E"] + p["e"])
        t, s = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        a = softmax_by((t * s) @ p["w"], owner, n)
        z = np.stack([np.bincount(owner, a * h[:, k], n) for k in range(h.shape[1])], 1)
        return x, h, t, s, a, z, sigmoid(z @ p["c"] + p["d"][0])

    def score(self, texts: pa.Array) -> np.ndarray:
        data, offsets = utf8_view(texts)
        out = np.zeros(len(texts))
        for a, b in slices(offsets, RUN):
            part = offsets[a : b + 1]
            x, owner = passages(data[part[0] : part[-1]], part - part[0])
            out[a:b] = self.forward(x, owner, b - a)[-1]
        return out

    def attention(self, text: str) -> list[float]:
        """The weights of a text's passages."""
        data, offsets = utf8_view(pa.array([text]))
        return self.forward(*passages(data, offsets), 1)[4].tolist()


def fit_bags(x: np.ndarray, owner: np.ndarray, y: np.ndarray, seed: int = 0, steps: int = STEPS, rate: float = 0.01, penalty: float = 1e-4) -> Model:
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-6, scale, 1).astype(np.float32)
    d = x.shape[1]
    shapes = {"E": (d, HIDDEN), "e": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,), "d": (1,)}
    p = {k: (rng.normal(size=s) * (1 / np.sqrt(s[0])) * (k not in "ed")).astype(np.float64) for k, s in shapes.items()}
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    model, n = Model(mean, scale, p), len(y)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    x = np.clip((x - mean) / scale, -8, 8)
    for step in range(1, steps + 1):
        xs, h, t, s, a, z, out = model.forward_scaled(x, owner, n)
        gz = weight * (out - y)
        g = {"c": z.T @ gz, "d": gz.sum(keepdims=True)}
        dz = gz[:, None] * p["c"][None, :]
        da = (dz[owner] * h).sum(axis=1)
        db = a * (da - np.bincount(owner, a * da, n)[owner])
        g["w"] = (t * s).T @ db
        dt, ds = db[:, None] * p["w"] * s * (1 - t * t), db[:, None] * p["w"] * t * s * (1 - s)
        g["V"], g["U"] = h.T @ dt, h.T @ ds
        dh = (dz[owner] * a[:, None] + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
        g["E"], g["e"] = xs.T @ dh, dh.sum(axis=0)
        for k in p:
            grad = g[k] + penalty * p[k]
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.999 * v[k] + 0.001 * grad * grad
            p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def train(texts: list[str], quality: list[int]) -> Model:
    """Fit on labelled texts. Without rows of both classes, everything scores as the class there is (1 without any)."""
    y = np.array(quality, np.float64)
    if not len(y) or y.min() == y.max():
        p = {"E": np.zeros((WIDE, 1)), "e": np.zeros(1), "V": np.zeros((1, 1)), "U": np.zeros((1, 1)), "w": np.zeros(1), "c": np.zeros(1)}
        return Model(np.zeros(WIDE), np.ones(WIDE), p | {"d": np.array([4.0 if not len(y) or y[0] else -4.0])})
    data, offsets = utf8_view(pa.array(texts, pa.large_string()))
    xs, owners = [], []
    for a, b in slices(offsets, RUN):
        part = offsets[a : b + 1]
        x, owner = passages(data[part[0] : part[-1]], part - part[0])
        xs.append(x)
        owners.append(owner + a)
    return fit_bags(np.concatenate(xs), np.concatenate(owners), y)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", target: str = "quality") -> Model:
    """Fit on a bounded sample of labelled rows that aren't held out; ids with two labels count as the lower."""
    known = labels.where(F.col(key).isNotNull() & F.col(target).isNotNull()).groupBy(key).agg(F.min(target).cast("int").alias("y"))
    known = known.where(F.crc32(F.col(key).cast("string")) % FOLDS != 0)
    rows = labelled_sample(docs, known, TRAIN, TRAIN_BYTES, text, key).collect()  # TRAIN and TRAIN_BYTES bound it
    rows = sorted((r[key], r["t"], r["y"]) for r in rows)
    model = train([r[1] for r in rows], [r[2] for r in rows])
    del rows
    trim()  # the driver lives on
    return model


SCORES = "doc_id long, held_out boolean, score double, predicted int"


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: whether its id is held out, its score, and whether that reaches PREDICT.

    Null texts are empty; an empty text has one passage without features, and so a score of its own. Rows are scored one
    by one: equal texts and repeated rows get equal scores whatever their neighbours; a score of PREDICT is predicted 1.
    Very long texts are scored whole. An empty table gives an empty result.
    """

    def run(batches):
        for batch in batches:
            s = model.score(batch.column(1))
            ids = batch.column(0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(held_out(ids.to_pylist())), pa.array(s), pa.array((s >= PREDICT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(key, text).mapInArrow(tidy(run), SCORES)


def keep(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows that are predicted to be good, with all their columns, whatever these are called; no shuffle."""
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(model.score(batch.column(at)) >= PREDICT))

    return docs.mapInArrow(tidy(run), docs.schema)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents, scored by a model fitted on labels that aren't held out; see score() for edge cases."""
    docs = read_table(spark, sf_dir, "documents")
    return score(docs, fit(docs, read_table(spark, sf_dir, "labels")))
