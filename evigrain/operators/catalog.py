"""The paper catalog as tables: search, facets, paging, upserts, tags, states, incremental sync.

papers: paper_id (its SHA-256), file_name, title, authors array, teacher, direction, keywords array, year,
ingestion_status, created_at, updated_at, ...; tags: tag_id, paper_id, category, value, normalized_value, source,
confidence, review_status, evidence, created_at, updated_at. Upserts rewrite by key, as plain Parquet has no MERGE.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import squeeze
from .shared import first_of, require_none, small

# The states and tag vocabularies.
STATUSES = ("discovered", "metadata_pending", "parsing", "parsed", "indexing", "indexed", "failed", "index_failed")
PARSED = ("parsed", "indexing", "indexed", "index_failed")
REVIEWS = ("suggested", "confirmed", "rejected")
SOURCES = ("local", "upload", "sample")
YEARS = (1800, 2200)
RECOVERY = {"parsing": "metadata_pending", "indexing": "parsed"}
TAG_CATEGORIES = ("research_direction", "material", "device", "method", "metric", "application", "teacher", "author", "year", "custom")
TAG_SOURCES = ("metadata", "filename_rule", "content_rule", "model", "user")


def like(c: Column, text: str) -> Column:
    """Substring match without regard to case; % and _ in the text are wildcards, as in SQL LIKE."""
    return c.ilike("%" + text.replace("\\", "\\\\") + "%")


def search(papers: DataFrame, tags: DataFrame, *, query="", teacher="", title="", direction="", status="", year=None, keyword="", tag="", exact_teacher=False) -> DataFrame:
    """Papers that meet all conditions given. `query` looks in title, file name, teacher, authors and keywords, or a tag not rejected."""
    live = tags.where(F.col("review_status") != "rejected")
    rows = papers
    if query:
        tagged = live.where(like(F.col("value"), query)).select("paper_id").distinct().withColumn("_tagged", F.lit(True))
        fields = [F.col("title"), F.col("file_name"), F.col("teacher"), F.to_json("authors"), F.to_json("keywords")]
        text = F.lit(False)
        for f in fields:
            text |= F.coalesce(like(f, query), F.lit(False))
        rows = rows.join(tagged, "paper_id", "left").where(text | F.col("_tagged").isNotNull()).drop("_tagged")
    if teacher:
        rows = rows.where(F.col("teacher") == teacher if exact_teacher else like(F.col("teacher"), teacher))
    for name, value in (("title", title), ("direction", direction)):
        if value:
            rows = rows.where(like(F.col(name), value))
    if status:
        if status not in STATUSES:
            raise ValueError(f"unknown status {status}")
        rows = rows.where(like(F.col("ingestion_status"), status))
    if year is not None:
        rows = rows.where(F.col("year") == year)
    if keyword:
        rows = rows.where(like(F.to_json("keywords"), keyword))
    if tag:
        rows = rows.join(live.where(like(F.col("value"), tag)).select("paper_id"), "paper_id", "left_semi")
    return rows


def choose_papers(papers: DataFrame, keyword: str = "") -> DataFrame:
    """Papers with a keyword in title, file name or an author, without regard to case; none at all is an error."""
    if not keyword.strip():
        return papers
    inside = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(keyword.lower()))
    found = papers.where(inside(F.col("title")) | inside(F.col("file_name")) | inside(F.array_join("authors", "\n")))
    if found.isEmpty():
        raise ValueError(f"no paper for {keyword}")
    return found


def invalid_papers(papers: DataFrame) -> DataFrame:
    """Papers that break a rule, with the first rule they break."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    low, high = YEARS
    rule = (
        F.when(blank("paper_id") | blank("sha256"), "an id is missing")
        .when(F.col("paper_id") != F.col("sha256"), "the id is not the digest")
        .when(blank("file_name") | blank("file_path") | blank("title"), "a name is missing")
        .when(~F.coalesce(F.col("ingestion_status").isin(*STATUSES), F.lit(False)), "unknown status")
        .when(~F.coalesce(F.col("source_type").isin(*SOURCES), F.lit(False)), "unknown source")
        .when(~F.col("year").between(low, high), "year out of range")
        .when((F.col("page_count") < 0) | (F.col("file_size_bytes") < 0), "a negative size")
    )
    return papers.withColumn("rule", rule).where("rule is not null")


def invalid_tags(tags: DataFrame) -> DataFrame:
    """Tags that break a rule, with the first rule they break."""
    known = lambda c, values: F.coalesce(F.col(c).isin(*values), F.lit(False))
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    rule = (
        F.when(blank("paper_id") | blank("value"), "paper or value is missing")
        .when(~known("category", TAG_CATEGORIES), "unknown category")
        .when(~known("source", TAG_SOURCES), "unknown source")
        .when(~known("review_status", REVIEWS), "unknown review status")
        .when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence out of range")
    )
    return tags.withColumn("rule", rule).where("rule is not null")


def parsed_as_papers(parsed: DataFrame, seed: DataFrame, digests: DataFrame, now: Column) -> DataFrame:
    """Catalog rows for parsed papers (file_name, total_pages, parser_version), to be upserted; a seed's metadata go first.

    seed: sources.files.metadata_seed(); digests: (file_name, paper_id, file_path) of the files. Without a seed the title
    is the file's stem and the direction unclassified. A parsed paper without its file is an error.
    """
    require_none(parsed.select("file_name").join(digests, "file_name", "left_anti"), "a parsed paper's file is unknown")
    rows = parsed.select("file_name", "total_pages", "parser_version").join(digests, "file_name").join(small(seed), "file_name", "left")
    text = lambda c, other: F.coalesce(F.nullif(F.trim(c), F.lit("")), other)
    return rows.select(
        "paper_id", F.col("paper_id").alias("sha256"), "file_name", "file_path", text("title", stem(F.col("file_name"))).alias("title"), F.coalesce("authors", F.array().cast("array<string>")).alias("authors"), text("teacher", F.lit("")).alias("teacher"), "year",
        text("direction", F.lit("unclassified")).alias("direction"), F.nullif("total_pages", F.lit(0)).alias("page_count"), F.lit("local").alias("source_type"), F.lit("parsed").alias("ingestion_status"), text("parser_version", F.lit("legacy")).alias("parser_version"),
        text("authorization_note", F.lit("")).alias("authorization_note"), now.alias("created_at"), now.alias("updated_at"),
    )


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(.)\.[^.]*$", "$1")


def with_metadata(chunks: DataFrame, papers: DataFrame) -> DataFrame:
    """Chunks with their paper's catalog metadata by file name; a chunk of an unknown file keeps nulls."""
    own = papers.select("file_name", *[c for c in ("paper_id", "title", "authors", "teacher", "year", "direction") if c in papers.columns and c not in chunks.columns])
    return chunks.join(small(first_of(own, ["file_name"], [F.col(own.columns[1])])), "file_name", "left")


def upsert_vectors(old: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks with vectors, replaced by chunk_id; vectors of several lengths, or chunks without one, are an error."""
    require_none(new.where(F.coalesce(F.size("embedding"), F.lit(0)) < 1).select("chunk_id"), "a chunk has no vector")
    sizes = [r[0] for r in old.select(F.size("embedding").alias("n")).union(new.select(F.size("embedding"))).distinct().limit(2).collect()]
    if len(sizes) > 1:
        raise ValueError(f"vectors of several lengths: {sorted(sizes)}")
    return old.join(new.select("chunk_id"), "chunk_id", "left_anti").unionByName(first_of(new, ["chunk_id"], [F.xxhash64("embedding")]))


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> tuple[DataFrame, dict]:
    """A page of rows and {total, page, pages}; numbers beyond the last give the last."""
    if size <= 0:
        raise ValueError("the page size must be positive")
    total = rows.count()
    pages = max(1, ceil(total / size))
    number = min(max(1, number), pages)
    return rows.orderBy(*order).offset((number - 1) * size).limit(size), {"total": total, "page": number, "pages": pages}


def facets(rows: DataFrame, by: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """(by, papers): counts, highest first, then by name without regard to case."""
    out = rows.groupBy(by).agg(F.count("*").alias("papers")).orderBy(F.desc("papers"), F.lower(by), by).offset(offset)
    return out if limit is None else out.limit(limit)


def facet_count(rows: DataFrame, by: str) -> DataFrame:
    return rows.agg(F.countDistinct(by).alias("facets"))


def stats(papers: DataFrame, status: str = "ingestion_status", owner: str = "teacher", parsed=PARSED) -> DataFrame:
    return papers.agg(
        F.count("*").alias("papers"), F.count_if(F.col(status).isin(*parsed)).alias("parsed"), F.countDistinct(F.when(F.trim(owner) != "", F.col(owner))).alias("owners")
    )


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep: list[str] | None = None) -> DataFrame:
    """old with new's rows in place of those of the same key; the columns in `keep` stay as they were first.

    Of several new rows of a key the latest by updated_at counts.
    """
    keep = ["created_at"] if keep is None else keep
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*key)
    first = w.orderBy("_new", "updated_at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for c in keep:
        both = both.withColumn(c, F.first(c).over(first))
    return first_of(both, key, [F.desc("_new"), F.desc("updated_at")]).drop("_new")


def latest_state(events: DataFrame, key: str, state: str, at: str, tie: str) -> DataFrame:
    """(key, state, at): the last event of each key; pre-aggregated before the shuffle."""
    last = F.max(F.struct(F.col(at), F.col(tie), F.col(state)))
    return events.groupBy(key).agg(last.alias("l")).select(key, F.col(f"l.{state}").alias(state), F.col(f"l.{at}").alias(at))


def set_status(papers: DataFrame, changes: DataFrame) -> DataFrame:
    """papers with the statuses of changes (paper_id, status, error_message, at); unknown statuses are an error."""
    c = small(changes.select("paper_id", F.col("status").alias("_s"), F.col("error_message").alias("_e"), F.col("at").alias("_t")))
    bad = F.col("_s").isNotNull() & ~F.col("_s").isin(*STATUSES)
    status = F.when(bad, F.raise_error(F.concat(F.lit("unknown status "), F.col("_s")))).otherwise(F.coalesce("_s", "ingestion_status"))
    named = {"ingestion_status": status, "error_message": F.when(F.col("_s").isNotNull(), F.coalesce("_e", F.lit(""))).otherwise(F.col("error_message")), "updated_at": F.coalesce("_t", "updated_at")}
    return papers.join(c, "paper_id", "left").withColumns(named).drop("_s", "_e", "_t")


def recover(papers: DataFrame) -> DataFrame:
    """Rows left in a working state go back to the state before."""
    out = F.col("ingestion_status")
    for busy, back in RECOVERY.items():
        out = F.when(F.col("ingestion_status") == busy, back).otherwise(out)
    return papers.withColumn("ingestion_status", out)


def candidates(papers: DataFrame, first: str, limit: int, retry_failed: bool = False, teacher: str = "", failed: str = "failed") -> DataFrame:
    """Papers to work on next: those in the first state, then failed ones if asked, up to limit."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be 1 to 100")
    turn = F.when(F.col("ingestion_status") == first, 0).when((F.col("ingestion_status") == failed) & F.lit(retry_failed), 1)
    rows = papers.where(F.col("teacher") == teacher) if teacher else papers
    return rows.withColumn("_turn", turn).where("_turn is not null").orderBy("_turn", F.lower("title"), "paper_id").limit(limit).drop("_turn")


def tag_id(paper: Column, category: Column, normalized: Column, source: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", paper, category, normalized, source), 256)


def with_tag_ids(tags: DataFrame) -> DataFrame:
    normalized = F.lower(squeeze(F.col("value")))
    return tags.withColumn("normalized_value", normalized).withColumn("tag_id", tag_id(F.col("paper_id"), F.col("category"), F.col("normalized_value"), F.col("source")))


def upsert_tags(old: DataFrame, new: DataFrame, papers: DataFrame) -> DataFrame:
    """Tags by id; those of unknown papers are refused, first timestamps stay."""
    require_none(new.join(papers.select("paper_id"), "paper_id", "left_anti"), "a tag's paper is unknown")
    return upsert(old, with_tag_ids(new), ["tag_id"])


def review_tag(tags: DataFrame, tag: str, status: str, at) -> DataFrame:
    if status not in REVIEWS:
        raise ValueError(f"unknown review status {status}")
    hit = F.col("tag_id") == tag
    return tags.withColumns({"review_status": F.when(hit, status).otherwise(F.col("review_status")), "updated_at": F.when(hit, F.lit(at)).otherwise(F.col("updated_at"))})


def visible_tags(tags: DataFrame, categories: list[str], hidden: list[str], limit: int) -> DataFrame:
    """Up to limit tags a paper: confirmed first, by category, confidence and value; one of each category and value."""
    live = tags.where((F.col("review_status") != "rejected") & ~F.col("category").isin(*hidden))
    order = [F.when(F.col("review_status") == "confirmed", 0).otherwise(1), F.coalesce(F.array_position(F.array(*map(F.lit, categories)), F.col("category")), F.lit(99)), F.desc("confidence"), F.col("value")]
    once = first_of(live, ["paper_id", "category", "normalized_value"], order)
    w = Window.partitionBy("paper_id").orderBy(*order)
    return once.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def suggested_tags(papers: DataFrame, rules: list[dict], text: str = "title", source: str = "filename_rule") -> DataFrame:
    """(paper_id, category, value, source, confidence, evidence): rules of which a keyword is in the text, and the words."""
    return _rule_hits(papers, rules, text).select("paper_id", "t.category", "t.value", F.lit(source).alias("source"), F.col("t.c").alias("confidence"), F.array_join("t.words", ", ").alias("evidence"))


def content_tags(pages: DataFrame, rules: list[dict]) -> DataFrame:
    """Tags of pages (paper_id, page, text): each rule's first page, with a confidence 0.04 higher, 0.99 at most."""
    hits = _rule_hits(pages, rules, "text", "page").groupBy("paper_id", "t.category", "t.value", "t.c").agg(F.min(F.struct("page", "t.words")).alias("first"))
    return hits.select("paper_id", "category", "value", F.lit("content_rule").alias("source"), F.least(F.lit(0.99), F.col("c") + 0.04).alias("confidence"), F.col("first.page").alias("page"), F.array_join("first.words", ", ").alias("evidence"))


def keyword_hits(text: Column, rules: list[dict]) -> Column:
    """An array of the rules that a text meets: category, value, confidence c, and the words found."""
    found, lowered = [], F.lower(F.coalesce(text, F.lit("")))
    for r in rules:
        words = F.array_compact(F.array(*[F.when(F.contains(lowered, F.lit(k.lower())), F.lit(k)) for k in r["keywords"]]))
        found.append(F.struct(F.lit(r["category"]).alias("category"), F.lit(r["value"]).alias("value"), F.lit(float(r["confidence"])).alias("c"), words.alias("words")))
    return F.filter(F.array(*found), lambda t: F.size(t["words"]) > 0)


def _rule_hits(rows: DataFrame, rules: list[dict], text: str, *more: str) -> DataFrame:
    return rows.select("paper_id", *more, F.explode(keyword_hits(F.col(text), rules)).alias("t"))


def new_files(listing: DataFrame, cache: DataFrame) -> DataFrame:
    """Files (path, length, modified) that the cache doesn't know as they are."""
    return listing.join(cache.select("path", "length", "modified"), ["path", "length", "modified"], "left_anti")


def register(files: DataFrame, now: Column | None = None) -> DataFrame:
    """Papers of binary files (path, content): id by SHA-256, one row a content, the first path."""
    rows = files.withColumn("paper_id", F.sha2("content", 256)).drop("content")
    return first_of(rows, ["paper_id"], [F.col("path")])
