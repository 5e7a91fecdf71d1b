"""What a catalog service answers, as functions of its tables: plain values, no server."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import catalog

# Tags on a card, in order, and those never shown.
CARD_ORDER = ["research_direction", "material", "device", "method", "metric", "application", "custom"]
HIDDEN = ["teacher", "author", "year"]
CARD_TAGS, DETAIL_TAGS = 8, 12


def health(papers: DataFrame) -> dict:
    return {"status": "ok", "papers": papers.count()}


def stats(papers: DataFrame) -> dict:
    row = catalog.stats(papers).first().asDict()
    counts = papers.groupBy("ingestion_status").count().collect()  # one row a status
    return row | {"status_counts": {r["ingestion_status"]: r["count"] for r in counts}}


def teachers(papers: DataFrame, tags: DataFrame, query: str = "", status: str = "", limit: int = 200) -> dict:
    """Facets without the blank teacher; the total counts it."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be 1 to 500")
    rows = catalog.search(papers, tags, query=query, status=status)
    items = [r.asDict() for r in catalog.facets(rows, "teacher", limit).collect() if r["teacher"]]
    return {"items": items, "total": catalog.facet_count(rows, "teacher").first()[0]}


def paper_page(papers: DataFrame, tags: DataFrame, query: str = "", teacher: str = "", status: str = "", page: int = 1, size: int = 18) -> dict:
    if not 1 <= size <= 60:
        raise ValueError("size must be 1 to 60")
    rows = catalog.search(papers, tags, query=query, teacher=teacher, status=status, exact_teacher=bool(teacher))
    got, at = catalog.page(rows, [F.lower("teacher"), F.lower("title"), F.col("paper_id")], page, size)
    shown = catalog.visible_tags(tags.join(got.select("paper_id"), "paper_id", "left_semi"), CARD_ORDER, HIDDEN, CARD_TAGS)
    by: dict[str, list] = {}
    for t in shown.orderBy("paper_id", "place").collect():  # size times CARD_TAGS rows at most
        by.setdefault(t["paper_id"], []).append(t["value"])
    return {"items": [r.asDict() | {"tags": by.get(r["paper_id"], [])} for r in got.collect()], **at}


def paper_detail(papers: DataFrame, tags: DataFrame, paper_id: str) -> dict:
    row = papers.where(F.col("paper_id") == paper_id).limit(1).collect()
    if not row:
        raise KeyError(paper_id)
    own = catalog.visible_tags(tags.where(F.col("paper_id") == paper_id), CARD_ORDER, HIDDEN, DETAIL_TAGS).orderBy("place")
    return row[0].asDict() | {"tags": [t["value"] for t in own.collect()]}


def answers(papers: DataFrame, tags: DataFrame, page: int, paper_id, limit: int = 200) -> DataFrame:
    """(part, name, value): what health, stats, teachers, a page and a paper's detail say, as one table; nothing is collected."""
    say = lambda part, df, name, value: df.select(F.lit(part).alias("part"), name.cast("string").alias("name"), value.cast("string").alias("value"))
    rows = catalog.search(papers, tags)
    parts = [
        say("health", papers.agg(F.count("*").alias("n")), F.lit("papers"), F.col("n")),
        say("stats", papers.groupBy("ingestion_status").agg(F.count("*").alias("n")), F.col("ingestion_status"), F.col("n")),
        say("stats", catalog.stats(papers), F.lit("owners"), F.col("owners")),
        say("teachers", catalog.facets(rows, "teacher", limit).where("teacher <> ''"), F.col("teacher"), F.col("papers")),
        say("teachers", catalog.facet_count(rows, "teacher"), F.lit("(total)"), F.col("facets")),
        say("page", catalog.page(rows, [F.lower("teacher"), F.lower("title"), F.col("paper_id")], page, 18)[0], F.col("paper_id"), F.col("title")),
        say("detail", papers.where(F.col("paper_id") == paper_id), F.col("paper_id"), F.col("title")),
    ]
    return reduce(DataFrame.unionByName, parts)
