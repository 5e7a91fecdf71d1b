"""Configuration read on the driver: metric ontology, direction taxonomy, tag rules. Each is checked as it is read."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import UNIT_SPELLINGS


def unit_key(unit: str) -> str:
    """The same spelling as functions.text.unit_key, for single values."""
    out = str(unit).strip().lower()
    for a, b in UNIT_SPELLINGS:
        out = out.replace(a.lower(), b)
    out = re.sub(r"\^\{([+-]?\d+)\}", r"^\1", out)
    return re.sub(r"[{}\s]+", "", out)


def _json(source) -> dict:
    if isinstance(source, dict):
        return source
    return json.loads(Path(source).read_text(encoding="utf-8"))


def _unique(values: list[str], what: str) -> None:
    if len(set(values)) != len(values) or not all(values):
        raise ValueError(f"{what} must be unique and not empty")


@dataclass
class Ontology:
    """Metrics with aliases, and units with a scale and an offset to the canonical unit."""

    metrics: list[dict]

    def __post_init__(self):
        _unique([str(m.get("metric_id", "")) for m in self.metrics], "metric ids")
        self.by_id = {m["metric_id"]: m for m in self.metrics}
        self.units: dict[tuple[str, str], tuple[float, float, str]] = {}
        for m in self.metrics:
            if not m.get("aliases") or not m.get("units") or not m.get("canonical_unit"):
                raise ValueError(f"metric {m['metric_id']} lacks aliases, units or a canonical unit")
            for u in m["units"]:
                how = (float(u["scale"]), float(u.get("offset", 0.0)), u["symbol"])
                for name in [u["symbol"], *u.get("aliases", [])]:
                    if self.units.setdefault((m["metric_id"], unit_key(name)), how)[:2] != how[:2]:
                        raise ValueError(f"unit {name} of {m['metric_id']} has two scales")
            if (m["metric_id"], unit_key(m["canonical_unit"])) not in self.units:
                raise ValueError(f"the canonical unit of {m['metric_id']} is not among its units")

    @classmethod
    def read(cls, source) -> Ontology:
        return cls(list(_json(source)["metrics"]))

    def normalize(self, metric_id: str, value: float, unit: str) -> tuple[float, str, float, float]:
        """(value in the canonical unit, symbol of the unit given, scale, offset)."""
        found = self.units.get((metric_id, unit_key(unit)))
        if found is None:
            raise ValueError(f"{metric_id} has no unit {unit!r}")
        scale, offset, symbol = found
        return value * scale + offset, symbol, scale, offset

    def for_direction(self, direction: str) -> list[dict]:
        """All metrics where nothing is known, else general ones and the direction's."""
        if direction == "unclassified":
            return list(self.metrics)
        return [m for m in self.metrics if not m.get("directions") or direction in m["directions"]]

    def unit_table(self, spark: SparkSession) -> DataFrame:
        """(metric_id, unit_key, scale, offset, canonical_unit): bounded by the configuration."""
        rows = [(m, k, s, o, self.by_id[m]["canonical_unit"]) for (m, k), (s, o, _) in self.units.items()]
        return spark.createDataFrame(rows, "metric_id string, unit_key string, scale double, offset double, canonical_unit string")


@dataclass
class Directions:
    directions: list[dict]

    def __post_init__(self):
        _unique([str(d.get("direction_id", "")) for d in self.directions], "direction ids")
        aliases = [(a.lower(), d["direction_id"]) for d in self.directions for a in {d["direction_id"], *d.get("aliases", [])}]
        self.alias = dict(aliases)
        if len({a for a, _ in aliases}) != len({(a, i) for a, i in aliases}):
            raise ValueError("an alias names two directions")

    @classmethod
    def read(cls, source) -> Directions:
        return cls(list(_json(source)["directions"]))

    @property
    def ids(self) -> set[str]:
        return {d["direction_id"] for d in self.directions}


def read_tag_rules(source) -> list[dict]:
    """[{category, value, keywords, confidence}] with unique (category, value)."""
    rules = list(_json(source)["rules"])
    _unique([f"{r.get('category')}|{r.get('value')}" for r in rules], "tag rules")
    for r in rules:
        if not r.get("keywords") or not 0 < float(r["confidence"]) <= 1:
            raise ValueError(f"tag rule {r.get('value')} lacks keywords or a confidence within 0 and 1")
    return rules
