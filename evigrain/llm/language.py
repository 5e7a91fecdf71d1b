"""Language identification by a byte convolutional network.

A text's UTF-8, lower-cased, is cut into windows of WINDOW bytes; each window also sees the first bytes of the next one,
so that no sequence of bytes is cut. Bytes are embedded; filters of each width in WIDTHS slide over them, each filter's
largest response in the window is taken (bias and rectifier after it), and a linear layer scores the languages. A text's
languages are the softmax of its windows' mean scores, by their bytes. Byte 0 is the filling, embedded as zero.

All parameters are learned together by Adam in numpy on the driver, from a sample bounded by TRAIN_ROWS rows in all,
ROWS of a language, LANGUAGES languages, and SEGMENTS pieces of WINDOW characters of a row. Responses of a filter are
sums of table entries, one for each pair of bytes, so scoring takes two gathers a byte whatever the number of filters.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.shared import over_cores, top_k
from .common import read_table, slices, tidy, utf8_view

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS, EMBED = 24, 12
#: Bounds of the fit.
TRAIN_ROWS, ROWS, SEGMENTS, LANGUAGES = 4000, 600, 4, 256
STEPS, BATCH, RATE = 500, 64, 0.01
#: Rows with this remainder of their id's crc32 by FOLDS are held out.
FOLDS, HELD = 4, 2
UNKNOWN = "und"
#: Windows that are scored at once, so that their responses stay in the cache.
BLOCK = 64
_MORE = max(WIDTHS) - 1


def windows(data: np.ndarray, offsets: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows with _MORE bytes after them, text of each, bytes of each); an empty text has one of zeros."""
    sizes = np.diff(offsets)
    count = np.maximum(1, -(-sizes // size))
    owner = np.repeat(np.arange(len(sizes)), count)
    within = (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * size
    place = within[:, None] + np.arange(size + _MORE)
    inside = place < sizes[owner][:, None]
    if not len(data):
        return np.zeros(place.shape, np.uint8), owner, np.zeros(len(owner), np.int64)
    found = np.where(inside, data[np.where(inside, place + offsets[owner][:, None], 0)], 0)
    return found.astype(np.uint8), owner, np.clip(sizes[owner] - within, 0, size)


@dataclass
class Model:
    languages: list[str]
    p: dict[str, np.ndarray]

    def bytes_table(self, k: int) -> np.ndarray:
        """What a byte in the k-th place adds to the responses of the filters that are wider than k."""
        return np.concatenate([self.p["E"] @ self.p[f"W{w}"][k] for w in WIDTHS if w > k], axis=1)

    @functools.cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """What the first two and the last two bytes add, by pair of bytes."""
        a, b, c, d = (self.bytes_table(k).astype(np.float32) for k in range(4))
        second = np.repeat(c, 256, axis=0)
        second[:, FILTERS:] += np.tile(d, (256, 1))
        return np.repeat(a, 256, axis=0) + np.tile(b, (256, 1)), second

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """Each filter's largest response in each window."""
        first, second = self.pairs
        out = np.empty((len(x), first.shape[1]), np.float32)
        for k in range(0, len(x), BLOCK):
            part = x[k : k + BLOCK].astype(np.int32)
            pair = (part[:, :-1] << 8) | part[:, 1:]
            h = first[pair[:, :-2]]
            h[:, :, FILTERS:] += second[pair[:, 2:]]
            out[k : k + BLOCK] = h.max(axis=1)
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(self.pooled(x).astype(np.float64) + self.p["b"], 0)
        # not a matrix product of the library, whose last bits depend on a window's neighbours
        return np.einsum("nf,fl->nl", z, self.p["V"], optimize=False) + self.p["c"]

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of the likeliest language, its probability) of each text, whole."""
        data, offsets = utf8_view(pc.utf8_lower(texts))
        best, share = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        for a, b in slices(offsets):
            part = offsets[a : b + 1]
            mean = np.zeros((b - a, len(self.languages)))
            weight = np.zeros(b - a)
            # a long text's windows are taken in turn
            for x, owner, n in _in_turn(data[part[0] : part[-1]], part - part[0]):
                np.add.at(mean, owner, self.scores(x) * np.maximum(n, 1)[:, None])
                np.add.at(weight, owner, np.maximum(n, 1))
            mean = np.round(mean / weight[:, None], 6)
            e = np.exp(mean - mean.max(axis=1, keepdims=True))
            best[a:b], share[a:b] = mean.argmax(axis=1), e.max(axis=1) / e.sum(axis=1)
        return best, np.round(share, 6)


def _in_turn(data: np.ndarray, offsets: np.ndarray, size: int = WINDOW, most: int = 1 << 20):
    """windows() of all texts; a text of more than `most` bytes is cut at multiples of the window."""
    if len(offsets) > 2 or len(data) <= 2 * most:
        yield windows(data, offsets)
        return
    step = most // size * size
    for k in range(0, len(data), step):
        x, owner, n = windows(data[k : k + step + _MORE], np.array([0, min(step, len(data) - k)]), size)
        follow = data[k + step : k + step + _MORE]  # what the last window sees of the next part
        x[-1, size : size + len(follow)] = follow
        yield x, owner, n


def forward(p: dict[str, np.ndarray], x: np.ndarray):
    """(place of each filter's largest response, pooled, scores) of a training batch."""
    model = Model([], p)
    n, h = x.shape[1] - _MORE, None
    for k in range(max(WIDTHS)):
        part = model.bytes_table(k)[x[:, k : k + n]]
        if h is None:
            h = part
        else:
            h[:, :, h.shape[2] - part.shape[2] :] += part
    at = h.argmax(axis=1)
    z = np.maximum(np.take_along_axis(h, at[:, None], 1)[:, 0] + p["b"], 0)
    return at, z, z @ p["V"] + p["c"]


def gradients(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross-entropy; a pooled response's goes to the bytes where it was largest."""
    at, z, s = forward(p, x)
    e = np.exp(s - s.max(axis=1, keepdims=True))
    d = e / e.sum(axis=1, keepdims=True)
    d[np.arange(len(y)), y] -= 1
    d /= len(y)
    g = {"V": z.T @ d, "c": d.sum(axis=0), "E": np.zeros_like(p["E"])}
    dz = (d @ p["V"].T) * (z > 0)
    g["b"] = dz.sum(axis=0)
    rows = np.arange(len(x))[:, None]
    for i, w in enumerate(WIDTHS):
        own = slice(i * FILTERS, (i + 1) * FILTERS)
        g[f"W{w}"] = np.zeros_like(p[f"W{w}"])
        for k in range(w):
            table = np.zeros((256, FILTERS))
            np.add.at(table, (x[rows, at[:, own] + k], np.broadcast_to(np.arange(FILTERS), at[:, own].shape)), dz[:, own])
            g["E"] += table @ p[f"W{w}"][k].T
            g[f"W{w}"][k] = p["E"].T @ table
    g["E"][0] = 0
    return g


def start(languages: int, seed: int = 0) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {"E": rng.normal(size=(256, EMBED)), "b": np.zeros(FILTERS * len(WIDTHS)), "V": rng.normal(size=(FILTERS * len(WIDTHS), languages)) * 0.1, "c": np.zeros(languages)}
    p["E"][0] = 0
    return p | {f"W{w}": rng.normal(size=(w, EMBED, FILTERS)) / np.sqrt(w * EMBED) for w in WIDTHS}


def train(segments: list[tuple[str, str]], steps: int = STEPS, seed: int = 0) -> Model:
    """Fit on (language, text of at most WINDOW characters); languages are drawn alike, half of the pieces are cut short."""
    languages = sorted({lang for lang, _ in segments})
    if len(languages) < 2:
        return Model(languages, start(len(languages)))
    rng = np.random.default_rng(seed)
    _, y = np.unique([lang for lang, _ in segments], return_inverse=True)
    data, offsets = utf8_view(pc.utf8_lower(pa.array([t for _, t in segments], pa.large_string())))
    places = [np.flatnonzero(y == k) for k in range(len(languages))]
    p = start(len(languages), seed)
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        pick = np.array([places[k][rng.integers(len(places[k]))] for k in rng.integers(len(languages), size=BATCH)])
        size = np.minimum(np.diff(offsets)[pick], WINDOW)
        short = np.where(rng.random(BATCH) < 0.5, rng.integers(12, WINDOW + 1, BATCH), WINDOW)
        size = np.minimum(size, short)
        place = np.arange(WINDOW + _MORE)
        inside = place < size[:, None]
        x = np.where(inside, data[np.where(inside, offsets[pick][:, None] + place, 0)], 0) if len(data) else np.zeros(inside.shape, np.uint8)
        g = gradients(p, x, y[pick])
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.999 * v[k] + 0.001 * g[k] * g[k]
            p[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(languages, p)


def held_out(key: str):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % FOLDS == HELD, F.lit(False))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """Fit on rows with a language and an id that isn't held out, chosen by a hash of their id; pieces at places by hash."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.crc32(F.col(key).cast("string")) % FOLDS != HELD))
    counts = {r["lang"]: r["count"] for r in known.groupBy(F.col(lang).alias("lang")).count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return Model([], {})
    most = max(1, min(ROWS, TRAIN_ROWS // len(counts)))  # TRAIN_ROWS rows, or one a language
    free = F.greatest(F.lit(1), F.length(text) - WINDOW + 1)
    pieces = F.array(*[F.substring(F.col(text), (F.pmod(F.xxhash64(key, F.lit(k)), free) + 1).cast("int"), F.lit(WINDOW)) for k in range(SEGMENTS)])
    # rows with a hash that is small enough for a few times the sample; so no task sends more, however many there are
    h, few = F.pmod(F.xxhash64(key), F.lit(1 << 30)), F.create_map(*[F.lit(x) for c, n in counts.items() for x in (c, min(1 << 30, (1 << 30) * 8 * most // n + 1))])
    rows = known.where(h < F.element_at(few, F.col(lang))).select(F.col(lang).alias("lang"), h.alias("h"), F.array_distinct(pieces).alias("pieces"))
    chosen = top_k(rows, ["lang"], [F.col("h"), F.col("pieces")], most, "_n").collect()
    return train(sorted({(r["lang"], t) for r in chosen for t in r["pieces"] if t}))


RESULT = "doc_id long, held_out boolean, lang_pred string, score double"


def predict(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: whether its id is held out, the likeliest language of the whole text, and its probability.

    Texts that are null, empty or without a letter are `und` with score 0, as are all where no language was learned. Rows
    are scored one by one: equal texts get equal results. A null id isn't held out. An empty table gives an empty result.
    """
    languages = np.array([*model.languages, UNKNOWN], object)

    def run(batches):
        for batch in batches:
            some = np.flatnonzero(batch.column(3).to_numpy(zero_copy_only=False))
            pick, share = np.full(batch.num_rows, len(languages) - 1), np.zeros(batch.num_rows)
            if len(some) and model.languages:
                pick[some], share[some] = model.predict(batch.column(2).take(pa.array(some)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(languages[pick], pa.string()), pa.array(share)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), held_out(key).alias("held_out"), F.col(text).alias("text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return rows.mapInArrow(tidy(run), RESULT)


def op11_language_id(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents, by a network fitted on rows that aren't held out; see predict() for edge cases."""
    docs = over_cores(read_table(spark, sf_dir, "documents"))
    return predict(docs, fit(docs))
