"""Checks of structured answers, edits of needs, and extractive reports."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import compact, json_object, squeeze
from .evidence import SECTION_PLAN
from .matching import ordered_distinct
from .needs import COMPARISONS, UNKNOWN
from .shared import over_cores

# The fields of an extraction, and the comparisons an edit may use.
LIST_FIELDS = ("research_direction", "core_technologies", "materials", "methods", "equipment", "applications", "innovations", "limitations", "industry_potential")
EXTRACTION = "research_problem string, " + ", ".join(f"{f} array<string>" for f in LIST_FIELDS) + ", evidence_map array<struct<field string, claim string, source_labels array<string>>>"
EDITABLE = ("technical_problems", "required_capabilities", "constraints", "existing_foundations", "excluded_approaches", "keywords")
MOST_CLAIMS = 8


def parse_extractions(rows: DataFrame, answer: str = "answer", labels: str = "labels") -> DataFrame:
    """rows (answer, labels: the evidence labels given) with `record` and `problem`, null for valid ones.

    Texts are squeezed, repeated list values dropped. Each claim needs evidence, each evidence a claim and known labels.
    """
    raw = F.from_json(json_object(F.col(answer)), EXTRACTION)
    clean = lambda c: F.filter(F.array_distinct(F.transform(F.coalesce(c, F.array().cast("array<string>")), squeeze)), lambda v: v != "")
    rows = over_cores(rows).withColumn("_r", raw)
    lists = {f: clean(F.col(f"_r.{f}")) for f in LIST_FIELDS}
    proof = F.transform(F.coalesce("_r.evidence_map", F.array().cast("array<struct<field:string,claim:string,source_labels:array<string>>>")), lambda e: F.struct(e["field"].alias("field"), squeeze(e["claim"]).alias("claim"), F.array_distinct(e["source_labels"]).alias("source_labels")))
    record = F.struct(squeeze(F.coalesce("_r.research_problem", F.lit(""))).alias("research_problem"), *[c.alias(f) for f, c in lists.items()], proof.alias("evidence_map"))
    rows = rows.withColumn("record", F.when(F.col("_r").isNotNull(), record)).drop("_r")
    named = lambda f: F.transform(f"record.{f}", lambda v: F.struct(F.lit(f).alias("field"), v.alias("claim")))
    said = F.concat(F.when(F.col("record.research_problem") != "", F.array(F.struct(F.lit("research_problem").alias("field"), F.col("record.research_problem").alias("claim")))).otherwise(F.array().cast("array<struct<field:string,claim:string>>")), *[named(f) for f in LIST_FIELDS])
    shown = F.transform("record.evidence_map", lambda e: F.struct(e["field"].alias("field"), e["claim"].alias("claim")))
    used = F.flatten(F.transform("record.evidence_map", lambda e: e["source_labels"]))
    problem = (
        F.when(F.col("record").isNull(), "no JSON object")
        .when(F.size(F.array_except(shown, said)) > 0, "evidence for no claim")
        .when(F.size(F.array_except(said, shown)) > 0, "a claim without evidence")
        .when(F.exists("record.evidence_map", lambda e: F.coalesce(F.size(e["source_labels"]), F.lit(0)) < 1), "evidence without labels")
        .when(F.size(F.array_except(used, labels)) > 0, "an unknown label")
    )
    return rows.withColumn("problem", problem)


def _valid(rows: DataFrame) -> DataFrame:
    """The rows without a problem. Generated, the problem is computed once instead of again below every filter and field."""
    return rows.select(*[c for c in rows.columns if c != "problem"], F.explode_outer(F.array("problem")).alias("problem")).where("problem is null").drop("problem")


def resolve_sources(records: DataFrame, evidence: DataFrame, key: str = "paper_id") -> DataFrame:
    """(key, field, claim, sources): labels of valid records as chunks and pages. evidence: key, source_label, chunk_id, page_start, page_end."""
    each = _valid(records).select(key, F.explode("record.evidence_map").alias("e")).select(key, "e.field", "e.claim", F.explode("e.source_labels").alias("source_label"))
    source = F.struct("source_label", "chunk_id", "page_start", "page_end")
    return each.join(evidence, [key, "source_label"]).groupBy(key, "field", "claim").agg(F.array_sort(F.collect_list(source)).alias("sources"))


def valid_claims(claims: Column, labels: Column, most: int = MOST_CLAIMS) -> Column:
    """Of array<struct(claim, source_labels)> the first `most` with a text; one without labels, or with unknown ones, is an error."""
    cut = F.filter(F.transform(F.slice(claims, 1, most), lambda c: F.struct(squeeze(c["claim"]).alias("claim"), F.array_distinct(c["source_labels"]).alias("source_labels"))), lambda c: c["claim"] != "")
    bad = F.exists(cut, lambda c: (F.coalesce(F.size(c["source_labels"]), F.lit(0)) < 1) | (F.size(F.array_except(c["source_labels"], labels)) > 0))
    return F.when(bad, F.raise_error(F.lit("a claim without a known label"))).otherwise(cut)


CLAIM = "struct<text string, source_labels array<string>>"
CLAIMS = "array<struct<claim string, source_labels array<string>>>"
READING = (
    f"executive_summary {CLAIM}, research_problem {CLAIM}, innovations {CLAIMS}, key_findings {CLAIMS}, transfer_assets {CLAIMS}, limitations {CLAIMS}, "
    "method_steps array<struct<name string, description string, source_labels array<string>>>, figure_interpretations array<struct<asset_id string, observation string, meaning string, source_labels array<string>>>, "
    "formula_interpretations array<struct<source_id string, formula string, meaning string, conditions string, source_labels array<string>>>, uncertainties array<string>"
)
MOST_STEPS = 10
CLAIM_LISTS = ("innovations", "key_findings", "transfer_assets", "limitations")


def parse_readings(rows: DataFrame, answer: str = "answer") -> DataFrame:
    """rows (answer, evidence_labels, figure_labels, formula_labels) with `reading` and `problem`, null for valid ones.

    Texts are squeezed, repeated labels and empty entries dropped, lists cut at what a reading may have. Whatever is said
    needs labels, all known; a figure's or formula's reading must cite that figure or formula.
    """
    rows = over_cores(rows).withColumn("_r", F.from_json(json_object(F.col(answer)), READING)).withColumn("_known", F.array_distinct(F.concat("evidence_labels", "figure_labels", "formula_labels")))
    labels = lambda x: F.coalesce(F.array_distinct(F.transform(x["source_labels"], lambda v: F.trim(v))), F.array().cast("array<string>"))
    text = lambda c: squeeze(F.coalesce(c, F.lit("")))

    def clean(name: str, most: Column | int, *fields: str) -> Column:
        kept = F.transform(F.slice(F.coalesce(f"_r.{name}", F.from_json(F.lit("[]"), rows.schema["_r"].dataType[name].dataType)), F.lit(1), F.lit(most) if isinstance(most, int) else most), lambda x: F.struct(*[text(x[f]).alias(f) for f in fields], labels(x).alias("source_labels")))
        return F.filter(kept, lambda x: F.concat(*[x[f] for f in fields]) != "")

    single = lambda name: F.struct(text(F.col(f"_r.{name}.text")).alias("text"), F.coalesce(F.array_distinct(f"_r.{name}.source_labels"), F.array().cast("array<string>")).alias("source_labels"))
    parts = {n: single(n) for n in ("executive_summary", "research_problem")}
    parts |= {n: clean(n, MOST_CLAIMS, "claim") for n in CLAIM_LISTS}
    parts["method_steps"] = clean("method_steps", MOST_STEPS, "name", "description")
    parts["figure_interpretations"] = clean("figure_interpretations", F.size("figure_labels"), "asset_id", "observation", "meaning")
    parts["formula_interpretations"] = clean("formula_interpretations", F.size("formula_labels"), "source_id", "formula", "meaning", "conditions")
    said = F.filter(F.transform(F.slice(F.coalesce("_r.uncertainties", F.array().cast("array<string>")), 1, MOST_STEPS), squeeze), lambda v: v != "")
    rows = rows.withColumn("reading", F.when(F.col("_r").isNotNull(), F.struct(*[c.alias(n) for n, c in parts.items()], said.alias("uncertainties"))))
    lists = (*CLAIM_LISTS, "method_steps", "figure_interpretations", "formula_interpretations")
    every = F.concat(F.array(*[F.struct(F.col(f"reading.{n}.text").alias("t"), F.col(f"reading.{n}.source_labels").alias("l")) for n in ("executive_summary", "research_problem")]), *[F.transform(f"reading.{n}", lambda x: F.struct(F.lit("x").alias("t"), x["source_labels"].alias("l"))) for n in lists])
    foreign = lambda name, own, known: F.exists(f"reading.{name}", lambda x: ~F.array_contains(F.col(known), x[own]))
    silent = lambda name, own: F.exists(f"reading.{name}", lambda x: ~F.array_contains(x["source_labels"], x[own]))
    problem = (
        F.when(F.col("reading").isNull(), "no JSON object")
        .when(F.exists(every, lambda e: F.size(F.array_except(e["l"], F.col("_known"))) > 0), "an unknown label")
        .when(F.exists(every, lambda e: (e["t"] != "") & (F.size(e["l"]) < 1)), "a claim without labels")
        .when(foreign("figure_interpretations", "asset_id", "figure_labels"), "an unknown figure")
        .when(foreign("formula_interpretations", "source_id", "formula_labels"), "an unknown formula")
        .when(silent("figure_interpretations", "asset_id") | silent("formula_interpretations", "source_id"), "a reading that doesn't cite its object")
    )
    return rows.withColumn("problem", problem).drop("_r", "_known")


def deep_reports(readings: DataFrame) -> DataFrame:
    """(paper_id, report): valid readings (paper_id, title, reading) as Markdown, each claim with its labels."""
    cite = lambda x: F.concat(F.lit(" ["), F.array_join(x["source_labels"], ", "), F.lit("]"))
    whole = lambda n: F.when(F.col(f"reading.{n}.text") != "", F.concat(f"reading.{n}.text", cite(F.col(f"reading.{n}"))))
    many = lambda n, show: F.array_join(F.transform(f"reading.{n}", lambda x: F.concat(F.lit("- "), show(x), cite(x))), "\n")
    steps = lambda x: F.concat_ws(": ", F.nullif(x["name"], F.lit("")), F.nullif(x["description"], F.lit("")))
    parts = {"executive_summary": whole("executive_summary"), "research_problem": whole("research_problem"), "method_steps": many("method_steps", steps)} | {n: many(n, lambda x: x["claim"]) for n in CLAIM_LISTS}
    parts |= {"figure_interpretations": many("figure_interpretations", lambda x: F.concat_ws(" ", x["asset_id"], x["observation"], x["meaning"])), "formula_interpretations": many("formula_interpretations", lambda x: F.concat_ws(" ", x["source_id"], x["formula"], x["meaning"], x["conditions"]))}
    parts["uncertainties"] = F.array_join(F.transform("reading.uncertainties", lambda v: F.concat(F.lit("- "), v)), "\n")
    body = [F.concat(F.lit(f"## {n.replace('_', ' ')}\n\n"), F.coalesce(F.nullif(c, F.lit("")), F.lit("待核对"))) for n, c in parts.items()]
    return _valid(readings).select("paper_id", F.concat_ws("\n\n", F.concat(F.lit("# "), "title"), *body).alias("report"))


def reading_route(readings: DataFrame) -> DataFrame:
    """(paper_id, place, node_id, kind, label, sources) of valid readings: problem, method steps, three findings, three assets.

    Each node leads to the next; solutions.diagram() draws one paper's.
    """
    node = lambda kind, letter: lambda x, i: F.struct(F.format_string(f"{letter}%02d", i + 1).alias("node_id"), F.lit(kind).alias("kind"), x["t"].alias("label"), F.array_join(x["source_labels"], "、").alias("sources"))
    as_text = lambda n, f: F.transform(f"reading.{n}", lambda x: F.struct(f(x).alias("t"), x["source_labels"].alias("source_labels")))
    problem = F.array(F.struct(F.col("reading.research_problem.text").alias("t"), F.col("reading.research_problem.source_labels").alias("source_labels")))
    steps = as_text("method_steps", lambda x: F.concat_ws("：", F.nullif(x["name"], F.lit("")), F.nullif(x["description"], F.lit(""))))
    three = lambda n: F.slice(as_text(n, lambda x: x["claim"]), 1, 3)
    nodes = F.concat(F.transform(problem, node("goal", "P")), F.transform(steps, node("method", "M")), F.transform(three("key_findings"), node("finding", "R")), F.transform(three("transfer_assets"), node("transfer", "T")))
    return _valid(readings).select("paper_id", F.posexplode(nodes).alias("place", "n")).select("paper_id", (F.col("place") + 1).alias("place"), "n.*")


def metric_text(m: Column) -> Column:
    parts = F.transform(F.array(m["name"], m["operator"], m["value_text"], m["unit"], m["test_condition"]), lambda x: F.trim(x))
    return F.array_join(F.filter(parts, lambda x: x != ""), " ")


def apply_edits(profiles: DataFrame, edits: DataFrame, key: str = "need_id") -> DataFrame:
    """profiles with a user's edits (key, industry, product, lists, metrics array<struct(name, operator, value_text, unit, test_condition)>).

    A metric that is the original one in all five parts keeps its raw text and provenance; others are the user's. Evidence
    of unchanged values stays, new values stand for themselves. A metric without name or value, or with an unknown
    comparison, is an error.
    """
    e = edits.select(key, *[F.col(c).alias(f"_{c}") for c in ("industry", "product", *EDITABLE, "metrics")])
    rows = profiles.join(e, key)
    given = F.filter("_metrics", lambda m: (F.trim(m["name"]) != "") | (F.trim(m["value_text"]) != ""))
    bad = F.exists(given, lambda m: (F.trim(m["name"]) == "") | (F.trim(m["value_text"]) == "") | ~F.trim(m["operator"]).isin(*sorted({*COMPARISONS.values(), "=", "≈"})))
    same = lambda m: F.get(F.filter("target_metrics", lambda o: (o["name"] == m["name"]) & (o["operator"] == m["operator"]) & (o["value_text"] == m["value_text"]) & (o["unit"] == m["unit"]) & (o["test_condition"] == m["test_condition"])), F.lit(0))

    def metric(m: Column, i: Column) -> Column:
        return F.struct(F.format_string("TM%02d", i + 1).alias("metric_id"), *[F.trim(m[p]).alias(p) for p in ("name", "operator", "value_text", "unit", "test_condition")], F.coalesce(same(m)["raw_text"], metric_text(m)).alias("raw_text"), F.when(same(m).isNotNull(), "enterprise_original").otherwise("enterprise_user_edit").alias("provenance_type"))

    checked = F.when(bad, F.raise_error(F.lit("a metric needs a name, a value and a known comparison"))).otherwise(given)
    rows = rows.withColumn("_m", F.transform(checked, metric))
    rows = rows.withColumns({f"_{f}": ordered_distinct(F.col(f"_{f}")) for f in EDITABLE} | {f"_{f}": F.coalesce(F.nullif(F.trim(f"_{f}"), F.lit("")), F.lit(UNKNOWN)) for f in ("industry", "product")})
    tag = lambda f, values: F.transform(values, lambda v: F.struct(F.lit(f).alias("field"), v.alias("value"), F.array(v).alias("phrases")))
    one = lambda f: F.filter(tag(f, F.array(f"_{f}")), lambda x: x["value"] != UNKNOWN)
    new = F.concat(one("industry"), one("product"), *[tag(f, F.col(f"_{f}")) for f in EDITABLE], tag("target_metrics", F.transform("_m", lambda m: m["raw_text"])))
    kept = F.transform(new, lambda n: F.coalesce(F.get(F.filter("evidence_map", lambda o: (o["field"] == n["field"]) & (o["value"] == n["value"])), F.lit(0)), n))
    rows = rows.withColumn("evidence_map", kept).withColumn("target_metrics", F.col("_m"))
    return rows.withColumns({c: F.col(f"_{c}") for c in ("industry", "product", *EDITABLE)}).drop("_m", "_metrics", *[f"_{c}" for c in ("industry", "product", *EDITABLE)])


def reading_reports(papers: DataFrame, chosen: DataFrame, chunks: DataFrame, plan=None) -> DataFrame:
    """(paper_id, report): Markdown of quoted evidence by section, each with page and chunk. chosen: operators.evidence.reading_evidence."""
    names = [s[0] for s in (SECTION_PLAN if plan is None else plan)]
    order = F.array_position(F.array(*map(F.lit, names)), F.col("section"))
    rows = chosen.join(chunks.select("chunk_id", "text", "page_start", "page_end"), "chunk_id")
    quote = F.concat(F.lit("> "), compact(F.col("text"), 520), F.lit("\n\n第 "), "page_start", F.when(F.col("page_end") != F.col("page_start"), F.concat(F.lit("-"), "page_end")).otherwise(""), F.lit(" 页；`"), "chunk_id", F.lit("`"))
    packed = rows.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "place", quote.alias("q")))).alias("x"))
    part = lambda i, n: F.concat(F.lit(f"## {n}\n\n"), F.coalesce(F.nullif(F.array_join(F.transform(F.filter("x", lambda e: e["o"] == i), lambda e: e["q"]), "\n\n"), F.lit("")), F.lit("待人工核对。")))
    body = F.concat_ws("\n\n", F.concat(F.lit("# "), "title"), *[part(i, n) for i, n in enumerate(names, 1)])
    return papers.join(packed, "paper_id", "left").withColumn("x", F.coalesce("x", F.array())).select("paper_id", body.alias("report"))


def report_package(files: dict[str, bytes]) -> bytes:
    """One record's report files as a ZIP, with fixed times, so that equal contents give equal bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(files):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), files[name], zipfile.ZIP_DEFLATED)
    return out.getvalue()
