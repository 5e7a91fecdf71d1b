"""Choosing evidence: usable chunks, the main text's end, round-robin, by section, formula blocks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import squeeze
from .retrieval import grouped_search
from .shared import first_of, top_k

# Marks of unusable text, and the sections of a reading with their types and words.
LOW_QUALITY = [
    "致谢",
    "参考文献",
    "攻读硕士学位期间",
    "单位代码",
    "学位论文使用授权声明",
    "本人学位论文",
    "本人承诺所呈交",
    "允许论文被查阅和借阅",
    "送交论文的复印件",
    "电子文档的内容和纸质",
    "我要感谢",
    "感谢我的导师",
    "同门伙伴",
    "父母的付出",
]
REASON_LEADERS, REASON_BIBLIOGRAPHY = "目录点线", "参考文献格式"
SECTION_PLAN = [
    ("摘要与研究目标", ("abstract",), ("摘要", "研究目的", "研究目标")),
    ("研究背景与问题", ("intro", "related_work"), ("研究背景", "研究现状", "存在的问题")),
    ("方法与技术路线", ("method", "experiment"), ("本文设计", "本系统", "总体设计", "硬件设计", "实验方案", "制备流程")),
    ("结果与性能证据", ("results", "discussion"), ("实验结果", "测试结果", "结果表明", "性能参数", "误报率", "准确率")),
    ("结论、局限与展望", ("conclusion",), ("结论", "不足", "局限", "展望")),
]
SKIPPED_SECTIONS = ("contents", "reference", "ack")
USABLE_CHARACTERS = 50
EQUATION_NUMBER = r"[（(]\s*\d+(?:\.\d+)+\s*[）)]"
REFERENCES_START = r"学位论文\s+参考文献|参考文献\s*\[\s*1\s*\]"


def rejection_reason(text: Column, more=()) -> Column:
    """Why a chunk is no evidence, or null: a marker in it, dotted leaders, or the form of a bibliography.

    more: a library's own markers, such as the names that its acknowledgements thank; they are configuration.
    """
    t = squeeze(text)
    marked = F.coalesce(*[F.when(F.contains(t, F.lit(m)), F.lit(m)) for m in (*LOW_QUALITY, *more)])
    leaders = F.contains(t, F.lit("......")) | F.contains(t, F.lit("…" * 6))
    cites = F.regexp_count(t, F.lit(r"\[\s*\d+\s*\]"))
    signals = F.regexp_count(t, F.lit(r"\[J\]")) + F.regexp_count(F.lower(t), F.lit(r"et al\."))
    return F.coalesce(marked, F.when(leaders, REASON_LEADERS), F.when((cites >= 3) | (signals >= 3), REASON_BIBLIOGRAPHY))


def main_text_end(chunks: DataFrame, doc: str = "file_name") -> DataFrame:
    """(doc, end_page): the first page of references in the latter half, else the page behind the last."""
    last = chunks.groupBy(doc).agg(F.max("page_end").alias("last"))
    half = F.greatest(F.lit(10), F.floor(F.col("last") / 2))
    found = (F.col("page_start") >= half) & squeeze(F.col("text")).rlike(REFERENCES_START)
    return chunks.join(last, doc).groupBy(doc, "last").agg(F.min(F.when(found, F.col("page_end"))).alias("b")).select(doc, F.coalesce("b", F.col("last") + 1).alias("end_page"))


def round_robin(ranked: DataFrame, fields: list[str], group: list[str], per_field: int, most: int) -> DataFrame:
    """One pick a field in turn: rows (group, field, chunk_id, rank) once a chunk, with all fields that chose it, labelled S01.."""
    order = F.array_position(F.array(*map(F.lit, fields)), F.col("field"))
    rows = ranked.where(F.col("rank") <= per_field).withColumn("turn", F.struct("rank", order.alias("at")))
    w = Window.partitionBy(*group, "chunk_id")
    rows = rows.withColumn("fields", F.array_sort(F.collect_list(F.struct("turn", "field")).over(w)))
    once = top_k(first_of(rows, [*group, "chunk_id"], [F.col("turn")]), group, [F.col("turn"), F.col("chunk_id")], most, "place")
    return once.select(*[c for c in once.columns if c not in ("turn", "field", "fields", "rank")], F.transform("fields", lambda x: x["field"]).alias("matched_fields"), F.format_string("S%02d", "place").alias("source_label"))


def capability_evidence(chunks: DataFrame, fields: DataFrame, order: list[str], per_field: int = 5, most: int = 20, more=()) -> DataFrame:
    """Each paper's evidence for an extraction: (file_name, chunk_id, place, matched_fields, source_label).

    fields: (query_id, embedding) of what is looked for, in `order`. Of a paper's nearest chunks for a field those of
    the main text that nothing speaks against count, and the fields choose in turn.
    """
    if per_field <= 0 or most <= 0:
        raise ValueError("per_field and most must be positive")
    near = grouped_search(chunks, fields, "file_name", max(5 * per_field, 10)).drop("file_name")
    texts = chunks.select("chunk_id", "file_name", "text", "page_start").join(main_text_end(chunks), "file_name")
    good = near.join(texts, "chunk_id").where((F.col("page_start") <= F.col("end_page")) & rejection_reason(F.col("text"), more).isNull())
    ranked = good.select("file_name", F.col("query_id").alias("field"), "chunk_id", F.row_number().over(Window.partitionBy("file_name", "query_id").orderBy("rank")).alias("rank"))
    return round_robin(ranked, order, ["file_name"], per_field, most)


def source_problems(records: DataFrame, chunks: DataFrame, key: str = "_source_file") -> DataFrame:
    """(key, chunk_id, problem) of cited sources that no chunk bears out: unknown, of another paper, or beyond its pages.

    records: capability records; chunks: chunk_id, file_name, page_start, page_end.
    """
    cited = records.select(key, F.col("paper.file_name").alias("_paper"), F.explode("evidence_map").alias("e")).select(key, "_paper", F.explode("e.sources").alias("s"))
    cited = cited.select(key, "_paper", "s.chunk_id", F.col("s.page_start").alias("_a"), F.col("s.page_end").alias("_b"))
    rows = cited.join(chunks.select("chunk_id", "file_name", "page_start", "page_end"), "chunk_id", "left")
    inside = (F.col("page_start") <= F.col("_a")) & (F.col("_a") <= F.col("_b")) & (F.col("_b") <= F.col("page_end"))
    problem = F.when(F.col("file_name").isNull(), "unknown chunk").when(F.col("file_name") != F.col("_paper"), "chunk of another paper").when(~F.coalesce(inside, F.lit(False)), "pages outside the chunk")
    return rows.select(key, "chunk_id", problem.alias("problem")).where("problem is not null").distinct()


def usable(chunks: DataFrame) -> DataFrame:
    return chunks.where((F.length(F.regexp_replace("text", r"\s+", "")) >= USABLE_CHARACTERS) & ~F.coalesce("section_type", F.lit("")).isin(*SKIPPED_SECTIONS))


READING = "paper_id string, section string, place int, chunk_id string"


def reading_evidence(chunks: DataFrame, per_section: int = 2, plan=None) -> DataFrame:
    """(paper_id, section, place, chunk_id): each section's best chunks of a paper, none used twice, sections in order.

    Scores are made by the JVM and only chunks that suit some section are kept; a paper's choice, which depends on the
    sections before, is made in one task per paper.
    """
    plan = SECTION_PLAN if plan is None else plan
    where = F.concat_ws(" ", F.coalesce("section_path", F.lit("")), "text")
    early = (F.col("section_type") == "unknown") & (F.col("page_start") <= 3)
    scores = []
    for i, (name, types, words) in enumerate(plan):
        exact = F.col("section_type").isin(*types)
        hits = sum((F.contains(where, F.lit(x)).cast("int") for x in words), F.lit(0))
        strong = (exact | (hits > 0)) & (F.lit(i == 0) | ~early)
        scores.append(F.when(strong, F.struct(F.lit(i).alias("section"), (-exact.cast("int")).alias("exact"), (-hits).alias("hits"))))
    rows = usable(chunks).select("paper_id", "chunk_id", F.coalesce("page_start", F.lit(999999)).alias("page"), F.explode(F.array_compact(F.array(*scores))).alias("s"))
    # more than per_section * sections rows of a section can't all be used before
    rows = top_k(rows.select("paper_id", "chunk_id", "page", "s.*"), ["paper_id", "section"], [F.col("exact"), F.col("hits"), F.col("page"), F.col("chunk_id")], per_section * len(plan))

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        out, used = [], set()
        for section, part in frame.sort_values(["section", "rank"]).groupby("section"):
            free = [c for c in part["chunk_id"] if c not in used][:per_section]
            used.update(free)
            out += [(frame["paper_id"].iloc[0], plan[section][0], k + 1, c) for k, c in enumerate(free)]
        return pd.DataFrame(out, columns=["paper_id", "section", "place", "chunk_id"])

    return rows.groupBy("paper_id").applyInPandas(choose, READING)


def formula_score(text: Column) -> Column:
    """8 if numbered, 4 if on three lines, 2 with private glyphs, and up to 3 for equals signs; 0 for prose."""
    t = F.trim(text)
    equals = F.regexp_count(t, F.lit("="))
    lines = F.regexp_count(t, F.lit("\n")) >= 2
    numbered, glyph = t.rlike(EQUATION_NUMBER), t.rlike("[-]")
    value = 8 * numbered.cast("int") + 4 * lines.cast("int") + 2 * glyph.cast("int") + F.least(F.lit(3), equals)
    return F.when((equals > 0) & (F.length(t) <= 420) & (numbered | lines | glyph), value).otherwise(0)


def formula_blocks(blocks: DataFrame, most: int = 6) -> DataFrame:
    """The best formula block of each page of a document (doc_id, page, block_number, text), with up to two neighbours, first pages first."""
    w = Window.partitionBy("doc_id", "page").orderBy("block_number")
    prose = lambda n: F.when(F.lag("score", n).over(w) == 0, F.nullif(F.lag(squeeze(F.col("text")), n).over(w), F.lit("")))
    rows = blocks.withColumn("score", formula_score(F.col("text")))
    rows = rows.withColumn("context", F.array_join(F.slice(F.array_compact(F.array(prose(1), prose(-1), prose(-2))), 1, 2), " "))
    best = first_of(rows.where("score > 0"), ["doc_id", "page"], [F.desc("score"), F.col("block_number")])
    return top_k(best, ["doc_id"], [F.col("page")], most).withColumn("source_label", F.format_string("Q%02d", "rank"))


def best_per_key(rows: DataFrame, key: list[str], preferred: Column, order: list[Column]) -> DataFrame:
    """One row a key: a preferred one if there is, else the first."""
    return first_of(rows, key, [F.when(preferred, 0).otherwise(1), *order])
