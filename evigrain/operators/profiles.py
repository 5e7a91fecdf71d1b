"""Profiles of people from their papers' claims: equal claims grouped, each with the papers that say it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import claim_key, fold, squeeze

# Which claims feed which profile field, and words of industries.
FIELDS = {"research_direction": "research_directions", "core_technologies": "core_capabilities", "applications": "application_domains"}
INDUSTRY_SOURCES = ("applications", "industry_potential")
INDUSTRIES = {
    "高端X射线探测与成像设备": ("x射线探测", "x 射线探测", "x-ray detection", "x-ray imaging", "x射线成像", "原理样机", "平板探测器"),
    "医疗影像与医疗器械": ("医学成像", "医疗设备", "胸透", "medical imaging"),
    "工业无损检测": ("工业无损检测", "工业检测", "无损检测", "non-destructive"),
    "公共安全与安检": ("安全检查", "安检", "security inspection"),
    "柔性电子与可穿戴设备": ("柔性", "可穿戴", "曲面成像", "wearable"),
}


def claims(records: DataFrame) -> DataFrame:
    """(teacher, title, author, field, claim, sources) of capability records; a claim without sources is an error."""
    fields = [*FIELDS, "industry_potential"]
    named = lambda f: F.transform(f, lambda c: F.struct(F.lit(f).alias("field"), c.alias("claim")))
    said = F.concat(*[named(f) for f in fields])
    each = records.select("paper.teacher", "paper.title", "paper.author", "evidence_map", F.explode(said).alias("s"))
    proof = F.filter("evidence_map", lambda e: (e["field"] == F.col("s.field")) & (e["claim"] == F.col("s.claim")))
    sources = F.when(F.size(proof) > 0, F.array_distinct(proof[0]["sources"])).otherwise(F.raise_error(F.concat(F.lit("no source for "), F.col("s.claim"))).cast("array<struct<chunk_id:string,page_start:int,page_end:int>>"))
    return each.select("teacher", "title", "author", "s.field", "s.claim", sources.alias("sources"))


def group_claims(rows: DataFrame, group: list[str], value: str = "value", alike=claim_key) -> DataFrame:
    """(group, key, value, occurrences, papers): equal claims as one, in the wording that is most frequent, then shortest.

    alike gives what makes two claims the same. Claims are folded and shuffled once, counted by wording and title; wordings and papers both come from those counts.
    """
    keyed = rows.withColumn("_v", squeeze(F.col(value))).where("_v <> ''").withColumn("key", alike(F.col("_v")))
    each = keyed.groupBy(*group, "key", "_v", "title").agg(F.count("*").alias("n"))
    words = each.groupBy(*group, "key", "_v").agg(F.sum("n").alias("n"))
    best = words.groupBy(*group, "key").agg(F.min(F.struct((-F.col("n")).alias("n"), F.length("_v").alias("l"), F.lower("_v").alias("f"), F.col("_v").alias("v"))).alias("b"))
    papers = each.groupBy(*group, "key", "title").agg(F.sum("n").alias("n")).groupBy(*group, "key").agg(F.sum("n").alias("occurrences"), F.count("title").alias("papers"))
    return best.select(*group, "key", F.col("b.v").alias("value")).join(papers, [*group, "key"])


def profile_values(records: DataFrame) -> DataFrame:
    """(teacher, profile_field, value, papers, occurrences) of all profile fields, industries by their words."""
    found = claims(records)
    name = F.create_map(*[F.lit(x) for pair in FIELDS.items() for x in pair])
    direct = found.where(F.col("field").isin(*FIELDS)).withColumn("profile_field", F.element_at(name, F.col("field"))).withColumn("value", F.col("claim"))
    folded = fold(F.col("claim"))
    hits = F.array_compact(F.array(*[F.when(F.greatest(*[F.contains(folded, F.lit(w)) for w in ws]), F.lit(i)) for i, ws in INDUSTRIES.items()]))
    industries = found.where(F.col("field").isin(*INDUSTRY_SOURCES)).withColumn("profile_field", F.lit("potential_industries")).withColumn("value", F.explode(hits))
    return group_claims(direct.unionByName(industries), ["teacher", "profile_field"])


def profiles(records: DataFrame) -> DataFrame:
    """One row a teacher: four lists of values by papers and name, and counts of papers, authors and evidence chunks."""
    values = profile_values(records)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("papers")).alias("n"), F.lower("value").alias("l"), F.col("value")))), lambda x: x["value"])
    lists = values.groupBy("teacher").pivot("profile_field", [*FIELDS.values(), "potential_industries"]).agg(ordered)
    count = records.groupBy("paper.teacher").agg(F.count("*").alias("paper_count"), F.countDistinct("paper.author").alias("author_count"))
    chunks = claims(records).select("teacher", F.explode("sources.chunk_id").alias("c")).groupBy("teacher").agg(F.countDistinct("c").alias("evidence_chunk_count"))
    empty = F.array().cast("array<string>")
    return lists.select("teacher", *[F.coalesce(c, empty).alias(c) for c in (*FIELDS.values(), "potential_industries")]).join(count, "teacher").join(chunks, "teacher", "left")


def unsupported(values: DataFrame, evidence: DataFrame) -> DataFrame:
    """(teacher, profile_field, value) without evidence, or evidence without a value."""
    key = ["teacher", "profile_field", "value"]
    return values.select(*key).exceptAll(evidence.select(*key)).union(evidence.select(*key).exceptAll(values.select(*key)))
