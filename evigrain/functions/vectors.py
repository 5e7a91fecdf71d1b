"""Vector arithmetic in double precision, and scores made of several parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of a match's parts, and of a transfer's.
MATCH_WEIGHTS = {
    "semantic_similarity": 0.45,
    "technical_capability_coverage": 0.25,
    "application_domain_match": 0.15,
    "paper_evidence_count": 0.15,
}
TRANSFER_WEIGHTS = {
    "demand_fit": 0.35,
    "evidence_strength": 0.35,
    "engineering_maturity": 0.15,
    "landing_constraints": 0.15,
}
BANDS = [(40, "低"), (60, "中低"), (80, "中"), (None, "较高")]
UNKNOWN_BAND = "未知"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null for zero vectors and for vectors of different lengths."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n)


def strict_cosine(a: Column, b: Column) -> Column:
    """Cosine for callers who want an error, not null, for empty, zero or unequally long vectors."""
    return F.coalesce(cosine(a, b), F.raise_error(F.lit("vectors must be of one length and not zero")).cast("double"))


def bounded(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def weighted(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    """100 times the weighted sum of parts within 0 to 1."""
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + bounded(parts[name]) * w
    return total * 100


def known_mean(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean of the parts that are known; null where none is."""
    top = sum((F.coalesce(parts[k] * w, F.lit(0.0)) for k, w in weights.items()), F.lit(0.0))
    low = sum((F.when(parts[k].isNotNull(), w).otherwise(0.0) for k, w in weights.items()), F.lit(0.0))
    return F.when(low > 0, top / low)


def to_step(x: Column, step: int = 5) -> Column:
    """Nearest multiple of step, halves to even."""
    return F.bround(x / step, 0) * step


def band(x: Column) -> Column:
    out = F.when(x.isNull(), UNKNOWN_BAND)
    for top, name in BANDS[:-1]:
        out = out.when(x < top, name)
    return out.otherwise(BANDS[-1][1])
