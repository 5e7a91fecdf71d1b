"""Grounded answers: retrieval for questions, numbered context, prompts, a language model adapter, citation checks.

The model is a function of a DataFrame (question_id, prompt) that adds `answer`; all else runs in Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bad_citations
from ..operators.retrieval import dense_search, grouped_search
from ..operators.shared import first_of, require_none, small, top_k

# What makes a question an overview, what such a query asks for, and the prompt's lines.
OVERVIEW = r"(?:老师|导师|团队).{0,12}(?:研究什么|做什么|研究方向|主要研究|科研方向)"
OVERVIEW_FOCUS = "检索重点：研究方向、核心技术、实验方法、材料体系、器件与应用。"
PROMPT = ["请根据下列检索资料回答问题。", "回答中的每项关键判断尽量标注对应资料编号，例如 [1]。", "如果资料没有提到问题所需信息，请明确说明无法确定。", ""]


def is_overview(question: Column) -> Column:
    return F.trim(question).rlike(OVERVIEW)


def retrieval_texts(questions: DataFrame, papers: DataFrame) -> DataFrame:
    """(question_id, overview, query): overview questions are widened by the teachers and titles of the papers given.

    papers: those that a question is about, so that their titles fit in a query; plain questions never meet them.
    """
    t = papers.agg(F.array_sort(F.collect_set(F.when(F.trim("teacher") != "", F.trim("teacher")))).alias("people"), F.array_sort(F.collect_list(F.when(F.trim("title") != "", F.struct("file_name", F.trim("title").alias("t"))))).alias("titles"))
    people = F.when(F.size("people") > 0, F.concat(F.lit("教师："), F.array_join("people", "、"), F.lit("。"))).otherwise("")
    titles = F.when(F.size("titles") > 0, F.concat(F.lit("论文主题："), F.array_join(F.transform("titles", lambda x: x["t"]), "；"))).otherwise("")
    wide = F.trim(F.concat_ws(" ", F.trim("question"), F.lit(OVERVIEW_FOCUS), people, titles))
    asked = questions.withColumn("overview", is_overview(F.col("question")))
    plain = asked.where("not overview").select("question_id", "overview", F.col("question").alias("query"))
    return plain.unionByName(asked.where("overview").crossJoin(t).select("question_id", "overview", wide.alias("query")))


def retrieve(chunks: DataFrame, questions: DataFrame, k: int = 5) -> DataFrame:
    """(question_id, chunk_id, score, rank) of questions (question_id, overview, embedding).

    Plain questions get the k nearest chunks; overviews first the best chunk of each of the first k papers by file name.
    """
    q = questions.select(F.col("question_id").alias("query_id"), "embedding")
    best = dense_search(chunks, q, k).join(small(questions.select(F.col("question_id").alias("query_id"), "overview")), "query_id")
    plain = best.where("not overview").drop("overview")
    first = chunks.select("file_name").distinct().orderBy("file_name").limit(k)
    wide = questions.where("overview").select(F.col("question_id").alias("query_id"), "embedding")
    near = grouped_search(chunks.join(small(first), "file_name"), wide, "file_name", 1)
    by = [F.round("score", 9).desc(), F.col("chunk_id")]
    own = near.select("query_id", "chunk_id", "score", F.struct(F.lit(0).alias("a"), F.col("file_name").alias("b"), F.lit(0).alias("c")).alias("turn"))
    rest = best.where("overview").select("query_id", "chunk_id", "score", F.struct(F.lit(1).alias("a"), F.lit("").alias("b"), F.col("rank").alias("c")).alias("turn"))
    merged = top_k(first_of(own.unionByName(rest), ["query_id", "chunk_id"], [F.col("turn")]), ["query_id"], [F.col("turn")], k, "_n").drop("_n", "turn")
    return plain.unionByName(top_k(merged, ["query_id"], by, k)).withColumnRenamed("query_id", "question_id")


def pages(first: Column, last: Column) -> Column:
    return F.when(first == last, F.concat(F.lit("第 "), first, F.lit(" 页"))).otherwise(F.concat(F.lit("第 "), first, F.lit("-"), last, F.lit(" 页")))


def prompts(retrieved: DataFrame, chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, prompt, sources, source_count): numbered context of at most k chunks a question, and source lines."""
    rows = retrieved.join(chunks, "chunk_id")
    n = F.col("rank").cast("string")
    block = F.concat_ws(
        "\n", F.concat(F.lit("[资料 "), n, F.lit("]")), F.concat(F.lit("论文：《"), "title", F.lit("》")), F.concat(F.lit("作者："), "author"), F.concat(F.lit("导师："), "teacher"), F.concat(F.lit("年份："), F.col("year").cast("string")),
        F.concat(F.lit("页码："), "page_start", F.lit("-"), "page_end"), F.concat(F.lit("Chunk ID："), "chunk_id"), F.lit("正文："), "text",
    )
    line = F.concat(F.lit("["), n, F.lit("] 《"), "title", F.lit("》，"), pages(F.col("page_start"), F.col("page_end")), F.lit("，作者："), "author", F.lit("，Chunk："), "chunk_id")
    packed = rows.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b"), line.alias("l")))).alias("x"))
    both = packed.join(questions.select("question_id", "question"), "question_id")
    prompt = F.concat_ws("\n", *map(F.lit, PROMPT), F.concat(F.lit("问题："), F.trim("question")), F.lit(""), F.lit("检索资料："), F.array_join(F.transform("x", lambda e: e["b"]), "\n\n"))
    return both.select("question_id", prompt.alias("prompt"), F.transform("x", lambda e: e["l"]).alias("sources"), F.size("x").alias("source_count"))


def answer(asked: DataFrame, model) -> DataFrame:
    """asked with answers; an answer that cites a source that wasn't given is an error."""
    got = model(asked.select("question_id", "prompt")).select("question_id", "answer")
    rows = asked.join(got, "question_id").persist()
    require_none(rows.where(F.size(bad_citations(F.col("answer"), F.col("source_count"))) > 0).select("question_id"), "an answer cites unknown sources")
    return rows
