"""PDF files as relations: objects by file, references between them resolved by joins, and from these pages and outlines.

object_table() scans each file's bytes once: the objects with their offsets, also those packed into object streams, and
the trailers. What an object says is read from its text by column expressions. Of objects with one number the last one
counts, as incremental updates append. A file without a PDF head, of which no page is reached, or whose object streams
can't be read has a status that says so; an encrypted one is neither opened nor read.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import squeeze
from ..operators.shared import checkpoint_dir, first_of

# The marks of the format.
_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b")
_STREAM = re.compile(rb">>\s*stream\r?\n")
_LENGTH = re.compile(rb"/Length\s+(\d+)(?!\s+\d+\s+R)")
_TRAILER = re.compile(rb"trailer\s*(<<.*?>>)\s*(?:startxref|$)", re.S)
_TITLE = re.compile(rb"/Title\s*(\((?:\\.|\((?:\\.|[^\\()])*\)|[^\\()])*\)|<[0-9A-Fa-f\s]*>)", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: The head may stand behind so many bytes.
HEAD = 1024
#: Page trees and outlines that are deeper are taken for broken, as those that lead back to themselves are.
DEPTH = 64


def text_string(token: bytes) -> str:
    """A string object's text: literal with escapes or hexadecimal, UTF-16 behind its mark, else Latin-1."""
    if token.startswith(b"<"):
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        one = lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1] in (b"\n", b"\r\n") else _ESCAPES.get(m[1], m[1])
        raw = re.sub(rb"\\([0-7]{1,3}|\r\n|.)", one, token[1:-1], flags=re.S)
    return raw[2:].decode("utf-16-be", "replace") if raw.startswith(b"\xfe\xff") else raw.decode("latin-1")


def _packed(head: bytes, data: bytes):
    """(number, text) of the objects in an object stream."""
    if b"/FlateDecode" in head:
        data = zlib.decompress(data)
    elif b"/Filter" in head:
        raise ValueError("an object stream in an unknown coding")
    count, first = (re.search(k + rb"\s+(\d+)", head) for k in (rb"/N", rb"/First"))
    if not count or not first:
        raise ValueError("an object stream without its sizes")
    first = int(first[1])
    numbers = list(map(int, data[:first].split()))[: 2 * int(count[1])]
    starts = numbers[1::2] + [len(data) - first]
    for k, number in enumerate(numbers[::2]):
        yield number, data[first + starts[k] : first + starts[k + 1]]


def scan(data: bytes):
    """(kind, number, offset, place, text) of a file's objects and trailers; place: within an object stream, else 0."""
    at, covered = 0, []
    while m := _OBJECT.search(data, at):
        end = data.find(b"endobj", m.end())
        end = len(data) if end < 0 else end
        s = _STREAM.search(data, m.end(), end)
        body = data[m.end() : s.start() + 2] if s else data[m.end() : end]
        if s:
            known = _LENGTH.search(body)
            stop = s.end() + int(known[1]) if known else -1
            if stop < 0 or not data[stop : stop + 16].lstrip().startswith(b"endstream"):
                stop = data.find(b"endstream", s.end())
                stop = len(data) if stop < 0 else stop
            end = data.find(b"endobj", stop)
            end = len(data) if end < 0 else end
        yield "object", int(m[1]), m.start(), 0, body
        if s and b"/ObjStm" in body:
            for k, (number, text) in enumerate(_packed(body, data[s.end() : stop]), 1):
                yield "object", number, m.start(), k, text
        covered.append((at, m.start()))
        at = end
    covered.append((at, len(data)))
    for a, b in covered:  # between objects only, as streams may hold anything
        for t in _TRAILER.finditer(data, a, b):
            yield "trailer", 0, t.start(), 0, t[1]


OBJECTS = "path string, kind string, number long, offset long, place int, body string, title string"


def object_table(files: DataFrame) -> DataFrame:
    """(path, kind, number, offset, place, body, title) of files (path, content); kind: object, trailer, or error with its text."""
    names = [c.split()[0] for c in OBJECTS.split(", ")]
    types = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[c.split()[1]] for c in OBJECTS.split(", ")]

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                content, rows = content.as_py() or b"", []
                try:
                    if b"%PDF-" not in content[:HEAD]:
                        raise ValueError("not a PDF")
                    for kind, number, offset, place, body in scan(content):
                        title = _TITLE.search(body)
                        rows.append((path, kind, number, offset, place, body.decode("latin-1"), text_string(title[1]) if title else None))
                except (ValueError, zlib.error) as e:
                    rows.append((path, "error", 0, 0, 0, str(e), None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return files.select("path", "content").mapInArrow(run, OBJECTS)


def _ref(key: str) -> Column:
    """The number of the object that a key refers to; null without."""
    found = F.regexp_extract("body", rf"/{key}\s+(\d+)\s+\d+\s+R", 1)
    return F.when(found != "", found.cast("long"))


def latest(objects: DataFrame) -> DataFrame:
    return first_of(objects.where("kind = 'object'"), ["path", "number"], [F.desc("offset"), F.desc("place")])


def roots(objects: DataFrame) -> DataFrame:
    """(path, root, encrypted, error): the catalog's number by the last trailer or cross-reference stream that names one."""
    heads = objects.where((F.col("kind") == "trailer") | F.col("body").rlike(r"/Type\s*/XRef\b"))
    of = heads.groupBy("path").agg(F.max(F.when(_ref("Root").isNotNull(), F.struct("offset", _ref("Root").alias("root")))).alias("r"), F.max(F.col("body").rlike(r"/Encrypt\b")).alias("encrypted"))
    files = objects.groupBy("path").agg(F.max(F.when(F.col("kind") == "error", F.col("body"))).alias("error"))
    return files.join(of, "path", "left").select("path", F.col("r.root").alias("root"), F.coalesce("encrypted", F.lit(False)).alias("encrypted"), "error")


def _box(c: Column) -> Column:
    """[left, bottom, right, top] of a page's or tree node's MediaBox; null without."""
    found = F.regexp_extract(c, r"/MediaBox\s*\[\s*([-+0-9.\s]+)\]", 1)
    return F.when(found != "", F.transform(F.split(F.trim(found), r"\s+"), lambda x: x.try_cast("double")))


def page_table(known: DataFrame, root: DataFrame) -> DataFrame:
    """(path, page, number, width, height): pages in the order of the tree, sizes taken over from above where they have none.

    Each round goes one level down, written to the checkpoint folder; known: latest(), root: roots().
    """
    checkpoint_dir(known.sparkSession)
    kids = F.regexp_extract_all(F.regexp_extract("body", r"(?s)/Kids\s*\[([^\]]*)\]", 1), F.lit(r"(\d+)\s+\d+\s+R"), F.lit(1))
    nodes = known.where(F.col("body").rlike(r"/Type\s*/Pages?\b|/Kids\s*\[")).select("path", "number", F.transform(kids, lambda x: x.cast("long")).alias("kids"), F.col("body").rlike(r"/Kids\s*\[").alias("inner"), _box(F.col("body")).alias("box")).checkpoint()
    tops = root.where("root is not null").select("path", F.col("root").alias("number")).join(known, ["path", "number"]).select("path", _ref("Pages").alias("number"))
    level = tops.where("number is not null").select("path", "number", F.array().cast("array<int>").alias("order"), F.lit(None).cast("array<double>").alias("above"))
    pages = None
    for _ in range(DEPTH):
        here = level.join(nodes, ["path", "number"]).withColumn("box", F.coalesce("box", "above")).checkpoint()
        leaves = here.where("not inner").select("path", "number", "order", "box")
        pages = leaves if pages is None else pages.unionByName(leaves)
        level = here.where("inner").select("path", "box", "order", F.posexplode("kids").alias("at", "number")).select("path", "number", F.array_append("order", F.col("at")).alias("order"), F.col("box").alias("above"))
        if level.isEmpty():
            break
    size = lambda a, b: F.abs(F.col("box")[b] - F.col("box")[a])
    number = F.row_number().over(Window.partitionBy("path").orderBy("order"))
    return pages.select("path", number.alias("page"), "number", size(0, 2).alias("width"), size(1, 3).alias("height"))


def outline(known: DataFrame, root: DataFrame, pages: DataFrame) -> DataFrame:
    """(path, place, level, title, page): the bookmarks in reading order that have a title and lead to a page of the file.

    Siblings are a chain from each to the next; their places in it are found by doubling jumps, so a long chain takes few
    rounds, however many files there are, and an item's place in the whole from those of its parents, a round a level.
    """
    checkpoint_dir(known.sparkSession)
    to = F.regexp_extract("body", r"/(?:Dest|D)\s*\[\s*(\d+)\s+\d+\s+R", 1)
    items = known.where("title is not null").select("path", "number", "title", _ref("Parent").alias("parent"), _ref("Next").alias("next"), F.when(to != "", to.cast("long")).alias("target")).where("parent is not null").checkpoint()
    before = items.where("next is not null").select("path", F.col("next").alias("number"), F.col("number").alias("jump"))
    ranked = items.join(first_of(before, ["path", "number"], [F.col("jump")]), ["path", "number"], "left")
    ranked = ranked.select("path", "number", "jump", F.when(F.col("jump").isNotNull(), 1).otherwise(0).alias("rank")).checkpoint()
    # a chain has at most as many items as its file
    longest = items.groupBy("path").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(longest.bit_length()):
        far = ranked.select("path", F.col("number").alias("jump"), F.col("jump").alias("_jump"), F.col("rank").alias("_rank"))
        ranked = ranked.join(far.hint("merge"), ["path", "jump"], "left").select("path", "number", F.col("_jump").alias("jump"), (F.col("rank") + F.coalesce("_rank", F.lit(0))).alias("rank")).checkpoint()
    # every chain is done in these rounds, but one that leads back to itself never ends: its items have no place
    placed = items.join(ranked.where("jump is null").select("path", "number", "rank"), ["path", "number"])
    tops = root.where("root is not null").select("path", F.col("root").alias("number")).join(known, ["path", "number"]).select("path", _ref("Outlines").alias("parent"))
    level, found = tops.where("parent is not null").withColumn("order", F.array().cast("array<int>")), None
    for _ in range(DEPTH):
        here = placed.join(level, ["path", "parent"]).select("path", "number", "title", "target", F.array_append("order", F.col("rank")).alias("order")).checkpoint()
        if here.isEmpty():
            break
        found = here if found is None else found.unionByName(here)
        level = here.select("path", F.col("number").alias("parent"), "order")
    if found is None:
        found = placed.where("false").select("path", "number", "title", "target", F.array(F.lit(0)).alias("order"))
    led = found.join(pages.select("path", F.col("number").alias("target"), "page"), ["path", "target"]).withColumn("title", squeeze(F.col("title"))).where("title <> ''")
    place = F.row_number().over(Window.partitionBy("path").orderBy("order", "number"))
    return led.select("path", place.alias("place"), F.greatest(F.lit(1), F.size("order")).alias("level"), "title", "page")


def summary(files: DataFrame) -> DataFrame:
    """(path, status, page_count, toc) of files (path, content); status: ok, not_pdf, encrypted or broken.

    toc: array of (level, title, page). Files of another status than ok have neither pages nor bookmarks. Paths are unlike.
    """
    checkpoint_dir(files.sparkSession)
    objects = object_table(files).checkpoint()
    root = roots(objects).checkpoint()
    open_ = root.where("not encrypted and error is null")
    known = latest(objects.join(open_.select("path"), "path", "left_semi")).checkpoint()
    pages = page_table(known, open_).checkpoint()
    marks = outline(known, open_, pages)
    toc = marks.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("place", "level", "title", "page"))).alias("t")).select("path", F.transform("t", lambda x: F.struct(x["level"].alias("level"), x["title"].alias("title"), x["page"].alias("page"))).alias("toc"))
    count = pages.groupBy("path").agg(F.count("*").cast("int").alias("page_count"))
    rows = files.select("path").join(root, "path", "left").join(count, "path", "left").join(toc, "path", "left")
    status = F.when(F.col("error") == "not a PDF", "not_pdf").when(F.col("encrypted"), "encrypted").when(F.coalesce("page_count", F.lit(0)) > 0, "ok").otherwise("broken")
    none = F.array().cast("array<struct<level:int,title:string,page:int>>")
    return rows.select("path", status.alias("status"), F.coalesce("page_count", F.lit(0)).alias("page_count"), F.coalesce("toc", none).alias("toc"))


__all__ = ["latest", "object_table", "outline", "page_table", "roots", "scan", "summary", "text_string"]
