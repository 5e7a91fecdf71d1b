"""Toxicity: cumulative-link (proportional odds) regression over sparse text features.

P(grade <= k) = sigmoid(theta_k - w.x): one weight vector for all grades, ordered thresholds. Features are words and
word beginnings, x = log(1 + count). Labels say toxic or not, so toxic training rows are graded 1 to GRADES by each
other: in two halves, a row's severity is the score that a model of the other half gives it, and its grade the part of
all toxic rows' severities that it falls in. Training features are made, counted and chosen on the executors; the
driver gets the chosen ones' counts in at most TRAIN labelled rows of each class, with TRAIN_BYTES of text at most,
chosen by a hash of their id. Scoring is one pass without a shuffle. A document is rejected when P(grade >= 1) reaches
REJECT.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, _LOWER, _power, labelled_sample, materialize, mix, read_table, slices, tidy, trim, utf8_view

#: Bounds of the fit: labelled rows of each class, and bytes of their texts.
TRAIN, TRAIN_BYTES = 2000, 32 << 20
GRADES = 3
REJECT = 0.5
#: A feature's least toxic rows, ratio of rates, and likelihood ratio against one that says nothing.
LEAST, LIFT, EVIDENCE = 2, 4, 8
#: What toxic training rows weigh together, clean ones being 1.
BALANCE = 0.5
PREFIXES = (4, 5, 6)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def text_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 64-bit feature) of each word and word beginning of each text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = _LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start, stop = word.copy(), word.copy()
    start[1:] &= ~word[:-1] | edge[1:-1]
    stop[:-1] &= ~word[1:] | edge[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * _power("m", len(data))[: len(data)], dtype=np.uint64, out=total[1:])
    inverse = _power("inv", len(data))
    owner = np.searchsorted(offsets, s, "right") - 1
    own, feature = [owner], [mix((total[e] - total[s]) * inverse[s] + np.uint64(1))]
    for n in PREFIXES:
        long = np.flatnonzero(e - s > n)
        own.append(owner[long])
        feature.append(mix((total[s[long] + n] - total[s[long]]) * inverse[s[long]] + np.uint64(1000 + n)))
    return np.concatenate(own), np.concatenate(feature)


def sparse_rows(texts: pa.Array):
    """(first, last, text numbers, features) of runs of texts."""
    data, offsets = utf8_view(texts)
    for a, b in slices(offsets):
        part = offsets[a : b + 1]
        yield a, b, *text_features(data[part[0] : part[-1]], part - part[0])


def cells(texts: pa.Array, known: np.ndarray | None = None):
    """(text, feature, count) of each feature of each text; with `known`, sorted, of those only and by their place there."""
    for a, _, own, feature in sparse_rows(texts):
        if known is not None:
            if not len(known):
                continue
            k = np.minimum(np.searchsorted(known, feature), len(known) - 1)
            hit = known[k] == feature
            own, feature = own[hit], k[hit]
        order = np.lexsort((feature, own))
        own, feature = own[order], feature[order]
        new = np.ones(len(own), bool)
        new[1:] = (own[1:] != own[:-1]) | (feature[1:] != feature[:-1])
        first = np.flatnonzero(new)
        yield own[first] + a, feature[first], np.diff(np.append(first, len(own)))


@dataclass
class Model:
    features: np.ndarray  # sorted
    weights: np.ndarray
    thetas: np.ndarray

    def at_least(self, texts: pa.Array) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, .. of each text."""
        score = np.zeros(len(texts))
        for own, k, n in cells(texts, self.features):
            score += np.bincount(own, np.log1p(n) * self.weights[k], len(texts))
        return 1 / (1 + np.exp(np.clip(self.thetas[None, :] - score[:, None], -50, 50)))


def fit_cumulative(row, col, value, shape, y: np.ndarray, grades: int, weight=None, penalty: float = 1e-3, steps: int = 400, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """(weights, ordered thetas) by Adam on the weighted mean negative log-likelihood; thetas are a first one and log gaps.

    x is sparse: value at (row, col), of shape (rows, features).
    """
    n, d = shape
    weight = np.full(n, 1 / n) if weight is None else weight
    share = np.array([weight[y <= k].sum() for k in range(grades - 1)]).clip(0.02, 0.98)
    first = np.log(share / (1 - share))
    p = np.concatenate([np.zeros(d), first[:1], np.log(np.maximum(np.diff(first), 0.1))]).astype(np.float64)
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1):
        gaps = np.exp(p[d + 1 :])
        theta = p[d] + np.concatenate([[0], np.cumsum(gaps)])
        z = np.bincount(row, value * p[col], n)
        bound = np.concatenate([[-np.inf], theta, [np.inf]])
        with np.errstate(over="ignore"):
            hi, lo = (1 / (1 + np.exp(-(bound[y + k] - z))) for k in (1, 0))
        prob = np.maximum(hi - lo, 1e-12)
        dh, dl = hi * (1 - hi) / prob, lo * (1 - lo) / prob
        gz = weight * (dh - dl)
        gt = np.array([-(weight * dh)[y == k].sum() + (weight * dl)[y == k + 1].sum() for k in range(grades - 1)])
        g = np.concatenate([np.bincount(col, value * gz[row], d) + penalty * p[:d], [gt.sum()], [gt[k + 1 :].sum() * gaps[k] for k in range(grades - 2)]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return p[:d], p[d] + np.concatenate([[0], np.cumsum(np.exp(p[d + 1 :]))])


def choose(bad: np.ndarray, good: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """Which features say enough, by the toxic and clean rows that have each."""
    lift = (bad + 0.05) / (toxic + 1) / ((good + 0.5) / (clean + 1))
    total, base = bad + good, toxic / (toxic + clean)
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = [np.where(k > 0, k * np.log(k / (total * q)), 0.0) for k, q in ((bad, base), (good, 1 - base))]
    return (bad >= LEAST) & (lift > LIFT) & (2 * (terms[0] + terms[1]) >= EVIDENCE)


def grades_of(severity: np.ndarray, grades: int = GRADES) -> np.ndarray:
    """1 to `grades` for parts of equal size, by severity; equal ones are graded alike, as the lower."""
    return 1 + np.searchsorted(np.quantile(severity, np.arange(1, grades) / grades), severity, "left")


def _weights(y: np.ndarray) -> np.ndarray:
    """Clean rows weigh what there are of them, toxic rows BALANCE times that together."""
    w = np.where(y > 0, BALANCE * (y == 0).sum() / max(1, (y > 0).sum()), 1.0)
    return w / w.sum()


def learn(features: np.ndarray, row, col, count, toxic: np.ndarray) -> Model:
    """The model of training rows given by the counts of chosen features."""
    if not len(features) or not len(toxic) or toxic.min() == toxic.max():
        return NOTHING
    value, n = np.log1p(count), len(toxic)
    half, severity = np.zeros(n, np.int64), np.zeros(n)
    for c in (0, 1):
        half[np.flatnonzero(toxic == c)[1::2]] = 1
    for h in (0, 1):
        own = half[row] == h
        w, _ = fit_cumulative(row[own], col[own], value[own], (n, len(features)), toxic, 2, _weights(toxic) * (half == h) * 2, steps=150)
        severity[half != h] = np.bincount(row[~own], value[~own] * w[col[~own]], n)[half != h]
    y = np.zeros(n, np.int64)
    y[toxic == 1] = grades_of(severity[toxic == 1])
    # parts may fall together where severities are equal
    known, y = np.unique(y, return_inverse=True)
    weights, thetas = fit_cumulative(row, col, value, (n, len(features)), y, len(known), _weights(y))
    return Model(features, weights, np.append(thetas, thetas[-1] + 50.0 * np.arange(1, GRADES - len(thetas) + 1)))


#: Without both classes, or features that say enough, nothing is toxic.
NOTHING = Model(np.zeros(0, np.uint64), np.zeros(0), 50.0 + np.arange(GRADES))


def train(texts: list[str], toxic: list[int]) -> Model:
    """Fit on labelled texts in this process, as fit() does on the executors."""
    texts, y = pa.array(texts, pa.large_string()), np.array(toxic, np.int64)
    names = [np.unique(f) for _, f, _ in cells(texts)]
    names = np.unique(np.concatenate(names)) if names else np.zeros(0, np.uint64)
    bad, good = np.zeros(len(names)), np.zeros(len(names))
    for own, f, _ in cells(texts):
        k = np.searchsorted(names, f)
        bad += np.bincount(k, y[own], len(names))
        good += np.bincount(k, 1 - y[own], len(names))
    features = names[choose(bad, good, int(y.sum()), int((1 - y).sum()))] if len(names) else names
    parts = list(zip(*cells(texts, features)))
    return learn(features, *map(np.concatenate, parts), y) if parts else NOTHING


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", target: str = "toxic", where=None) -> Model:
    """Fit on a bounded sample of labelled rows (common.labelled_sample), of those that meet `where`, a condition on key.

    Rows without id or label don't count; an id with two labels counts as toxic; no labelled row: nothing is toxic.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(target).isNotNull()).groupBy(key).agg(F.max(target).cast("int").alias("y"))
    known = known if where is None else known.where(where)
    sample = materialize(labelled_sample(docs, known, TRAIN, TRAIN_BYTES, text, key), "toxicity")
    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}  # two rows
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return NOTHING

    def count(batches):
        for batch in batches:
            y = batch.column(0).to_numpy().astype(np.int64)
            for own, f, _ in cells(batch.column(1)):
                names, k = np.unique(f, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), *[pa.array(np.bincount(k, part[own], len(names)).astype(np.int64)) for part in (y, 1 - y)]], ["f", "bad", "good"])

    seen = sample.select("y", "t").mapInArrow(tidy(count), "f long, bad long, good long").groupBy("f").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    # features below the floors stay on the executors
    seen = seen.where((F.col("bad") >= LEAST) & ((F.col("bad") + 0.05) / (toxic + 1) > LIFT * (F.col("good") + 0.5) / (clean + 1))).toArrow()
    names, bad, good = (seen[c].to_numpy() for c in ("f", "bad", "good"))
    features = np.sort(names.view(np.uint64)[choose(bad, good, toxic, clean)])

    def hits(batches):
        for batch in batches:
            held = [[] for _ in range(batch.num_rows)]
            for own, k, n in cells(batch.column(2), features):
                for i, j, c in zip(own.tolist(), k.tolist(), n.tolist()):
                    held[i].append((j, c))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), *[pa.array([[x[i] for x in h] for h in held], pa.list_(pa.int32())) for i in (0, 1)]], ["key", "y", "f", "n"])

    rows = sorted((tuple(r) for r in sample.select(key, "y", "t").mapInArrow(tidy(hits), "key long, y int, f array<int>, n array<int>").collect()), key=str)
    size = np.array([len(r[2]) for r in rows], np.int64)
    flat = lambda i: np.array([v for r in rows for v in r[i]], np.int64)
    model = learn(features, np.repeat(np.arange(len(rows)), size), flat(2), flat(3), np.array([r[1] for r in rows], np.int64))
    del rows
    trim()  # the driver lives on
    return model


SCORES = "doc_id long, p_toxic double, expected_severity double, grade int, rejected boolean"


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: P(grade >= 1), the expected grade, the likeliest grade, and whether it is rejected.

    Null and empty texts have no features and get the thresholds' own probabilities. Rows are scored one by one: equal
    texts and repeated rows get equal scores wherever they stand; grades of equal probability count as the lower. Very
    long texts are scored whole. An empty table gives an empty result.
    """

    def run(batches):
        for batch in batches:
            p = model.at_least(batch.column(1))
            each = -np.diff(np.concatenate([np.ones((len(p), 1)), p, np.zeros((len(p), 1))], 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(p[:, 0]), pa.array(p.sum(axis=1)), pa.array(each.argmax(axis=1).astype(np.int32)), pa.array(p[:, 0] >= REJECT)],
                ["doc_id", "p_toxic", "expected_severity", "grade", "rejected"],
            )

    return docs.select(key, text).mapInArrow(tidy(run), SCORES)


def keep(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows that aren't rejected, with all their columns, whatever these are called; no shuffle. Null texts stay."""
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(model.at_least(batch.column(at))[:, 0] < REJECT))

    return docs.mapInArrow(tidy(run), docs.schema)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents, scored by a model that is fitted on labels; see score() for nulls and the like."""
    docs = read_table(spark, sf_dir, "documents")
    return score(docs, fit(docs, read_table(spark, sf_dir, "labels")))
