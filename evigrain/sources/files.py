"""Readers and writers: PDF listings, parsed papers, JSON records and JSON lines, versions; each checked as it is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import checkpoint_dir, first_of, require_none

# Folders that are never searched, and the first bytes of a PDF.
SKIPPED = (".git", ".idea", ".venv", "venv", "__pycache__", "node_modules")
PDF_HEAD = "%PDF-"
MAX_UPLOAD = 100 * 1024 * 1024

PARSED = (
    "file_name string, source_path string, total_pages int, parser_version string, toc array<struct<level int, title string, page int>>, "
    "pages array<struct<page int, width double, height double, text string, plain_text string, blocks array<struct<block_number int, block_type string, text string, bbox array<double>, script_span_count int>>>>, "
    "diagnostics array<struct<message string, count int>>"
)
QUERY = (
    "query_id string, query string, filters struct<direction string, section_types array<string>, metrics array<struct<definition_id string, operator string, value double, upper_value double, "
    "unit string, evidence_levels array<string>, test_condition_contains string>>>"
)
QREL = "query_id string, chunk_id string, relevance int"
RUN = "query_id string, chunk_ids array<string>"
SOURCES = "array<struct<chunk_id string, page_start int, page_end int>>"
CAPABILITY = (
    "paper struct<file_name string, title string, author string, teacher string, year int>, research_problem string, research_direction array<string>, core_technologies array<string>, "
    f"applications array<string>, industry_potential array<string>, evidence_map array<struct<field string, claim string, sources {SOURCES}>>"
)
VERSION = "version_id string, need_id string, parent_version_id string, status string, saved_at string, profile_sha256 string, profile string"


def pdf_files(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """(path, length, modified[, content]) of the PDFs below a folder, without hidden and skipped folders. No bytes are read without `content`."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(root)
    rows = rows.withColumnRenamed("modificationTime", "modified").where(~F.col("path").rlike(rf"/(?:{'|'.join(s.replace('.', '[.]') for s in SKIPPED)}|\.[^/]+)/"))
    return rows if content else rows.select("path", "length", "modified")


def is_pdf(content: Column) -> Column:
    return F.substring(content, 1, len(PDF_HEAD)) == F.lit(PDF_HEAD).cast("binary")


def owner_of(path: Column, root: str) -> Column:
    """The first folder of a path below root; empty for files right there."""
    rest = F.substring_index(path, root.rstrip("/") + "/", -1)
    return F.when(F.contains(rest, F.lit("/")), F.element_at(F.split(rest, "/"), 1)).otherwise("")


def accept_uploads(files: DataFrame, known: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Files (path, length, content) with paper_id and status: too_large, not_pdf, duplicate or accepted.

    With facts, (path, status, page_count) of sources.pdf.summary, also encrypted and broken, and page_count.
    """
    rows = files.withColumn("paper_id", F.sha2("content", 256))
    first = first_of(rows.select("paper_id", "path"), ["paper_id"], [F.col("path")]).withColumn("_first", F.lit(True))
    seen = known.select("paper_id").distinct().withColumn("_seen", F.lit(True))
    rows = rows.join(first, ["paper_id", "path"], "left").join(seen, "paper_id", "left")
    status = F.when(F.col("length") > MAX_UPLOAD, "too_large").when(~is_pdf(F.col("content")), "not_pdf").when(F.col("_seen").isNotNull() | F.col("_first").isNull(), "duplicate").otherwise("accepted")
    if facts is not None:
        rows = rows.join(facts.select("path", F.col("status").alias("_said"), "page_count"), "path", "left")
        status = F.when((status == "accepted") & F.col("_said").isin("encrypted", "broken", "not_pdf"), F.col("_said")).otherwise(status)
    return rows.withColumn("status", status).drop("_seen", "_first", "_said")


def parsed_papers(spark: SparkSession, path: str) -> DataFrame:
    """Parsed papers from JSON or gzipped JSON, one a file; a file of another shape is an error."""
    rows = spark.read.schema(PARSED).option("multiLine", True).option("mode", "FAILFAST").json(path)
    kept = F.filter("toc", lambda e: (e["page"] >= 1) & (F.trim(e["title"]) != ""))
    return rows.withColumn("toc", F.transform(kept, lambda e: F.struct(F.greatest(F.lit(1), F.coalesce(e["level"], F.lit(1))).alias("level"), e["title"].alias("title"), e["page"].alias("page"))))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of a JSON-lines file; blank lines are skipped, a line that is no object is an error with its number."""
    rows = spark.read.schema(schema + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    if rows.where(F.col("_bad").isNotNull() & F.struct("*").isNotNull()).limit(1).collect():
        # numbers need whole files; only a broken one is read so
        lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "text"))
        lines = lines.where("trim(text) <> ''").select("file", (F.col("line") + 1).alias("line"), F.substring("text", 1, 200).alias("text"), F.from_json("text", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})["_bad"].alias("bad"))
        require_none(lines.where("bad is not null").orderBy("file", "line").select("file", "line", "text"), "a line is no JSON object")
    return rows.drop("_bad")


def queries(spark: SparkSession, path: str) -> DataFrame:
    rows = json_lines(spark, path, QUERY)
    require_none(rows.where("coalesce(trim(query_id), '') = '' or coalesce(trim(query), '') = ''"), "a query lacks its id or text")
    require_none(rows.groupBy("query_id").count().where("count > 1"), "a query id occurs twice")
    return rows


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a file, with _source_file."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("_source_file", F.col("_metadata.file_name"))


def capability_records(spark: SparkSession, path: str) -> DataFrame:
    rows = json_records(spark, path, CAPABILITY)
    require_none(rows.where("coalesce(paper.title, '') = '' or coalesce(paper.teacher, '') = ''").select("_source_file"), "a record lacks title or teacher")
    return rows


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, which may be a pattern, names something."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p))


def metric_records(spark: SparkSession, path: str, record: str) -> DataFrame:
    """The metrics of all extraction files as rows; record: the schema of one. No such folder: no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], record)
    rows = spark.read.schema(f"schema_version string, metrics array<struct<{record}>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    out = rows.select(F.explode("metrics").alias("m")).select("m.*")
    require_none(out.groupBy("metric_id").count().where("count > 1 or metric_id is null"), "a metric id occurs twice or is missing")
    return out


SEED = "papers array<struct<file_name string, title string, authors array<string>, teacher string, year int, direction string, authorization_note string>>"


def metadata_seed(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, title, authors, teacher, year, direction, authorization_note) of a seed file; no such file: no rows.

    File names are bare and occur once; authors are texts, of which blank ones go.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], SEED.removeprefix("papers array<struct<").removesuffix(">>"))
    rows = spark.read.schema(SEED).option("multiLine", True).option("mode", "FAILFAST").json(path)
    require_none(rows.where("papers is null"), "a seed file without papers")
    rows = rows.select(F.explode("papers").alias("p")).select("p.*").withColumn("file_name", F.trim("file_name"))
    require_none(rows.where(F.coalesce(F.col("file_name"), F.lit("")).rlike(r"^$|[/\\]")), "a seed's file name is missing or a path")
    require_none(rows.groupBy("file_name").count().where("count > 1"), "a seed's file name occurs twice")
    authors = F.filter(F.transform(F.coalesce("authors", F.array().cast("array<string>")), lambda a: F.trim(a)), lambda a: a != "")
    return rows.withColumn("authors", authors)


def versions(spark: SparkSession, path: str, need_id: str | None = None) -> DataFrame:
    """Saved versions, newest first; a profile that doesn't fit its digest is an error."""
    rows = spark.read.schema(VERSION).json(path)
    rows = rows if need_id is None else rows.where(F.col("need_id") == need_id)
    require_none(rows.where(F.sha2("profile", 256) != F.col("profile_sha256")).select("version_id"), "a version's profile was changed")
    return rows.orderBy(F.desc("saved_at"), F.desc("version_id"))


def new_versions(old: DataFrame, new: DataFrame) -> DataFrame:
    """New versions with their digests; a parent must exist, be of the same need, and confirmed ones must have one."""
    parents = old.select(F.col("version_id").alias("parent_version_id"), F.col("need_id").alias("_need"))
    joined = new.join(parents, "parent_version_id", "left")
    require_none(joined.where("parent_version_id is not null and (_need is null or _need <> need_id)").select("version_id"), "a version's parent is unknown or of another need")
    require_none(joined.where("status = 'confirmed_by_user' and parent_version_id is null").select("version_id"), "a confirmed version needs a parent")
    return joined.drop("_need").withColumn("profile_sha256", F.sha2("profile", 256)).select(*old.columns)


def version_chain(versions_: DataFrame) -> DataFrame:
    """(version_id, ancestor_id, distance) of all ancestors; a version that is its own ancestor is an error.

    Each round adds the ancestors up to twice as far, by joining the farthest pairs with all known ones, and is
    written to the checkpoint folder; it ends when no row is added.
    """
    checkpoint_dir(versions_.sparkSession)
    known = versions_.where("parent_version_id is not null").select("version_id", F.col("parent_version_id").alias("ancestor_id"), F.lit(1).alias("distance")).checkpoint()
    reach = 1
    while True:
        require_none(known.where("version_id = ancestor_id"), "a version is its own ancestor")
        last = known.where(F.col("distance") == reach).select("version_id", F.col("ancestor_id").alias("_by"))
        rest = known.select(F.col("version_id").alias("_by"), "ancestor_id", (F.col("distance") + reach).alias("distance"))
        new = last.join(rest, "_by").select("version_id", "ancestor_id", "distance").checkpoint()
        if new.isEmpty():
            return known
        known, reach = known.unionByName(new).checkpoint(), 2 * reach


def write_partitioned(rows: DataFrame, path: str, key: str, compression: str = "gzip") -> None:
    """JSON by key, under Spark's commit protocol."""
    rows.write.mode("overwrite").partitionBy(key).option("compression", compression).json(path)


def install(tables: dict[str, DataFrame]) -> None:
    """Write tables by path, once: none is written when one of the paths exists."""
    if taken := [p for p in tables if exists(next(iter(tables.values())).sparkSession, p)]:
        raise ValueError(f"there is something at {taken}")
    for path, rows in tables.items():
        rows.write.mode("errorifexists").parquet(path)
