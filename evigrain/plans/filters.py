"""The typed filter contract, compiled to a predicate and to relational division over numeric records.

A filter is {"direction": id, "section_types": [..], "metrics": [{"definition_id", "operator", "value", "upper_value",
"unit", "evidence_levels", "test_condition_contains"}]}. Unknown fields, names and operators are errors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.ontology import Ontology

# The contract's names.
SCHEMA = "retrieval_filters_v1"
OPERATORS = ("eq", "gte", "lte", "between")
EVIDENCE_LEVELS = ("measured", "reported", "inferred")
DEFAULT_LEVELS = ("measured", "reported")
SECTION_TYPES = (
    "abstract",
    "intro",
    "related_work",
    "method",
    "experiment",
    "results",
    "discussion",
    "conclusion",
    "reference",
    "ack",
    "appendix",
    "contents",
    "unknown",
)


def number(value, name: str) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        raise ValueError(f"{name} must be a finite number")
    return float(value)


def _known(found: dict, names: set[str], where: str) -> None:
    if more := sorted(set(found) - names):
        raise ValueError(f"{where} has unknown fields: {more}")


@dataclass(frozen=True)
class Constraint:
    definition_id: str
    operator: str
    target: float
    upper: float | None
    unit: str
    levels: tuple[str, ...]
    condition: str = ""

    def matches(self) -> Column:
        """Of a record with columns definition_id, canonical_unit, evidence_level, test_condition, value_type, normalized_*."""
        low = F.when(F.col("value_type") == "range", F.col("normalized_min")).otherwise(F.col("normalized_value"))
        high = F.when(F.col("value_type") == "range", F.col("normalized_max")).otherwise(F.col("normalized_value"))
        ranges = {
            "eq": (low <= self.target) & (high >= self.target),
            "gte": low >= self.target,
            "lte": high <= self.target,
            "between": (low >= self.target) & (high <= F.lit(self.upper)),
        }
        ok = (F.col("definition_id") == self.definition_id) & (F.col("canonical_unit") == self.unit) & F.col("evidence_level").isin(*self.levels)
        if self.condition:
            ok &= F.contains(F.lower(F.coalesce("test_condition", F.lit(""))), F.lit(self.condition.lower()))
        return F.coalesce(ok & ranges[self.operator], F.lit(False))


@dataclass(frozen=True)
class Filters:
    direction: str | None = None
    section_types: tuple[str, ...] = ()
    metrics: tuple[Constraint, ...] = field(default=())


def parse(raw: dict | None, ontology: Ontology, directions: set[str]) -> Filters:
    """Check a filter and bring its numbers to canonical units."""
    raw = raw or {}
    if not isinstance(raw, dict):
        raise ValueError("filters must be an object")
    _known(raw, {"direction", "section_types", "metrics"}, "the filter")
    direction = str(raw.get("direction") or "").strip()
    if direction and direction not in directions | {"unclassified"}:
        raise ValueError(f"unknown direction {direction}")
    for name in ("section_types", "metrics"):
        if not isinstance(raw.get(name, []), list):
            raise ValueError(f"{name} must be a list")
    sections = tuple(sorted({str(s).strip() for s in raw.get("section_types", [])} - {""}))
    if wrong := set(sections) - set(SECTION_TYPES):
        raise ValueError(f"unknown sections {sorted(wrong)}")
    return Filters(direction or None, sections, tuple(_constraint(m, ontology) for m in raw.get("metrics", [])))


def _constraint(m: dict, ontology: Ontology) -> Constraint:
    if not isinstance(m, dict):
        raise ValueError("a metric constraint must be an object")
    _known(m, {"definition_id", "operator", "value", "upper_value", "unit", "evidence_levels", "test_condition_contains"}, "a metric constraint")
    name, operator, unit = (str(m.get(k) or "").strip() for k in ("definition_id", "operator", "unit"))
    if name not in ontology.by_id or operator not in OPERATORS or not unit:
        raise ValueError(f"metric constraint on {name!r}: unknown metric or operator, or no unit")
    target, upper = ontology.normalize(name, number(m.get("value"), "value"), unit)[0], None
    if operator == "between":
        upper = ontology.normalize(name, number(m.get("upper_value"), "upper_value"), unit)[0]
        if upper < target:
            raise ValueError("the upper value is below the value")
    elif "upper_value" in m:
        raise ValueError("only between has an upper value")
    levels = m.get("evidence_levels", list(DEFAULT_LEVELS))
    if not isinstance(levels, list) or not levels or set(levels) - set(EVIDENCE_LEVELS):
        raise ValueError("evidence_levels must be a list of known levels")
    return Constraint(name, operator, target, upper, ontology.by_id[name]["canonical_unit"], tuple(sorted(set(levels))), " ".join(str(m.get("test_condition_contains") or "").split()))


def matching_chunks(records: DataFrame, constraints: tuple[Constraint, ...]) -> DataFrame:
    """(chunk_id) of chunks with a record for each constraint; without constraints, of all that have records."""
    if not constraints:
        return records.select("chunk_id").distinct()
    hits = F.filter(F.array(*[F.when(c.matches(), F.lit(i)) for i, c in enumerate(constraints)]), lambda x: x.isNotNull())
    each = records.select("chunk_id", F.explode(hits).alias("c")).distinct()
    return each.groupBy("chunk_id").agg(F.count("*").alias("n")).where(F.col("n") == len(constraints)).select("chunk_id")


@dataclass(frozen=True)
class Plan:
    """A filter made ready: a predicate on chunk columns, and the allowed chunks where numbers are asked for."""

    filters: Filters
    allowed: DataFrame | None = None

    def predicate(self) -> Column:
        ok = F.lit(True)
        if self.filters.direction:
            ok &= F.col("direction") == self.filters.direction
        if self.filters.section_types:
            ok &= F.col("section_type").isin(*self.filters.section_types)
        return ok

    def apply(self, chunks: DataFrame) -> DataFrame:
        rows = chunks.where(self.predicate())
        return rows if self.allowed is None else rows.join(self.allowed, "chunk_id", "left_semi")

    def is_empty(self) -> bool:
        return self.allowed is not None and self.allowed.isEmpty()


def plan(raw: dict | None, ontology: Ontology, directions: set[str], records: DataFrame | None = None) -> Plan:
    found = parse(raw, ontology, directions)
    if not found.metrics:
        return Plan(found)
    if records is None:
        raise ValueError("numeric constraints need metric records")
    return Plan(found, matching_chunks(records, found.metrics))
