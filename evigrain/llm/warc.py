"""WARC archives as chunked record tables.

An archive is a table of chunk rows (archive, seq, record, record_id, chunk, data, digest): the data of an archive's
rows, in the order of seq, is a WARC 1.1 file of about ARCHIVE bytes, a task writing as many as it needs. A payload is
written as slices of at most CHUNK bytes, each with the SHA-256 of the payload so far, and read back as a stream, so
that no more than a chunk and a header are held beside the source. Records are numbered within their archive, and read
back by (archive, record): neither a big archive nor a frequent key is one task's burden. Records whose payload was
seen before are revisits: headers only, with the digest and the record they refer to.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach_by_key, id_filter, materialize, partitions, read_table, size_of, split_by_filter, tidy

CHUNK = 1 << 16
#: Bytes behind which a task begins a new archive, and stored bytes that a task reads back.
ARCHIVE, TASK = 256 << 20, 16 << 20
#: Payloads below this size are never replaced by a revisit.
LEAST = 100
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:evigrain:page:"
CHUNKS = "archive long, seq long, record long, record_id string, chunk int, data binary, digest string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, error string"


def _header(fields: list[tuple[str, str]], first: str) -> bytes:
    return "".join([first, "\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"]).encode()


def record_chunks(page_id, url, payload: memoryview, digest: str, refers_to=None, chunk: int = CHUNK) -> Iterator[tuple[str, int, bytes, str]]:
    """(record id, chunk number, bytes, digest of the payload so far) of one record."""
    rid, revisit = f"{URN}{page_id}", refers_to is not None
    http = _header([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))], "HTTP/1.1 200 OK")
    safe = "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url or "")
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{rid}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", safe),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(http) + (0 if revisit else len(payload)))),
    ]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{URN}{refers_to}>")]
    so_far = hashlib.sha256()
    yield rid, 0, _header(fields, "WARC/1.1") + http, so_far.hexdigest()
    n = 1
    for k in range(0, 0 if revisit else len(payload), chunk):
        part = payload[k : k + chunk]
        so_far.update(part)
        yield rid, n, bytes(part), so_far.hexdigest()
        n += 1
    yield rid, n, b"\r\n\r\n", so_far.hexdigest()


class RecordReader:
    """Takes an archive's bytes in pieces of any size and gives its records; holds a header and a digest at most."""

    def __init__(self):
        self.buffer, self.state, self.fields = bytearray(), "head", {}

    @staticmethod
    def _fields(block: bytes) -> dict[str, str]:
        lines = block.decode("utf-8", "replace").split("\r\n")
        return {"": lines[0]} | {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}

    def feed(self, data: bytes) -> Iterator[dict]:
        self.buffer += data
        while True:
            if self.state in ("head", "http"):
                at = self.buffer.find(b"\r\n\r\n")
                if at < 0:
                    return
                found = self._fields(bytes(self.buffer[:at]))
                del self.buffer[: at + 4]
                if self.state == "head":
                    if not found[""].startswith("WARC/"):
                        raise ValueError(f"not a WARC record: {found['']!r:.80}")
                    self.fields, self.left, self.state = found, int(found["content-length"]), "http"
                else:
                    self.http, self.left, self.state = found, self.left - at - 4, "body"
                    self.digest, self.size = hashlib.sha256(), 0
            elif self.state == "body":
                part = self.buffer[: self.left]
                self.digest.update(part)
                self.size += len(part)
                self.left -= len(part)
                del self.buffer[: len(part)]
                if self.left:
                    return
                self.state = "tail"
            else:
                if len(self.buffer) < 4:
                    return
                if self.buffer[:4] != b"\r\n\r\n":
                    raise ValueError("a record is longer than it says")
                del self.buffer[:4]
                self.state = "head"
                yield self._record()

    def _record(self) -> dict:
        f, ident = self.fields, lambda v: (lambda x: None if x == "None" else int(x))(v.strip("<>").removeprefix(URN))
        said, kind = f["warc-payload-digest"].removeprefix("sha256:"), f["warc-type"]
        if kind == "response" and said != self.digest.hexdigest():
            raise ValueError(f"{f['warc-record-id']}: the payload read is not the payload written")
        size = self.size if kind == "response" else int(self.http["content-length"])
        refers = ident(f["warc-refers-to"]) if "warc-refers-to" in f else None
        return {"page_id": ident(f["warc-record-id"]), "payload_bytes": size, "payload_digest": said, "record_type": kind, "refers_to": refers}

    def close(self) -> None:
        if self.buffer or self.state != "head":
            raise ValueError("the archive ends within a record")


def write_archives(pages: DataFrame, payload: str = "html", url: str = "url", key: str = "page_id", least: int = LEAST, chunk: int = CHUNK, limit: int = ARCHIVE) -> DataFrame:
    """The chunk table of all pages' records, in the shared folder; each task writes archives of its own.

    Null payloads and urls are empty, a null key stays null. Rows with the same key and payload are responses each; of
    equal payloads the smallest key is the response. Other columns are left out, whatever they are called. An empty
    table gives an empty one.
    """
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), body.alias("body"))
    digests = rows.where(F.octet_length("body") >= least).select("page_id", F.sha2("body", 256).alias("digest"))
    groups = digests.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    revisits = attach_by_key(digests, groups, "digest", "n").where("page_id <> first").select("page_id", "digest", F.col("first").alias("refers_to")).distinct()
    # the digest is compared again, for keys that occur with several payloads; only rows that may be revisits move
    revisits = materialize(revisits.withColumnRenamed("digest", "same"), "revisits")
    bits = id_filter(revisits.select("page_id"))
    alone = split_by_filter(rows, "page_id", bits, inside=False).select("*", F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("string").alias("same"))
    rows = alone.unionByName(split_by_filter(rows, "page_id", bits, inside=True).join(revisits, "page_id", "left"))

    def run(batches):
        archive, seq, record, size, out, held = TaskContext.get().partitionId() << 24, 0, 0, 0, [], 0

        def flush():
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["archive", "seq", "record", "record_id", "chunk", "data", "digest"])

        for batch in batches:
            ids, urls, bodies, refers, same = (batch.column(i) for i in range(5))
            for i in range(batch.num_rows):
                view = memoryview(bodies[i].as_buffer())
                digest = hashlib.sha256(view).hexdigest()
                to = refers[i].as_py() if same[i].as_py() == digest else None
                for rid, n, data, so_far in record_chunks(ids[i].as_py(), urls[i].as_py(), view, digest, to, chunk):
                    out.append((archive, seq, record, rid, n, data, so_far))
                    seq, held, size = seq + 1, held + len(data), size + len(data)
                    if held > 4 << 20:
                        yield flush()
                        out, held = [], 0
                record += 1
                if size > limit:
                    archive, seq, record, size = archive + 1, 0, 0, 0
        if out:
            yield flush()

    return materialize(rows.select("page_id", "url", "body", "refers_to", "same").mapInArrow(tidy(run), CHUNKS), "warc", "zstd")


def read_archives(chunks: DataFrame, task: int = TASK) -> DataFrame:
    """One row per record of write_archives()' table, from the bytes alone.

    A record that is cut, or isn't what its header says, has its page_id and an error. An empty table gives an empty
    result.
    """

    def run(batches):
        now, reader, rid, found = None, None, None, []

        def fail(e) -> dict:
            ident = rid.removeprefix(URN)
            return {"page_id": None if ident == "None" else int(ident), "error": str(e)}

        def close():
            try:
                if reader:
                    reader.close()
            except ValueError as e:
                found.append(fail(e))

        for batch in batches:
            keys, data = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), batch.column(3)
            for i, key in enumerate(keys):
                if key != now:
                    close()
                    now, reader, rid = key, RecordReader(), batch.column(2)[i].as_py()
                if reader:
                    try:
                        found += reader.feed(data[i].as_buffer())
                    except (ValueError, KeyError) as e:
                        found.append(fail(e))
                        reader = None  # what follows of it is lost
            if found:
                yield pa.RecordBatch.from_pylist(found, schema=schema)
                found.clear()
        close()
        if found:
            yield pa.RecordBatch.from_pylist(found, schema=schema)

    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("error", pa.string())])
    tasks = max(partitions(chunks.sparkSession), -(-size_of(chunks) // task))
    ordered = chunks.select("archive", "record", "record_id", "data", "seq").repartition(tasks, "archive", "record").sortWithinPartitions("archive", "record", "seq")
    return ordered.select("archive", "record", "record_id", "data").mapInArrow(tidy(run), RECORDS)


def op6_warc(spark, sf_dir: str) -> DataFrame:
    """A record per row of pages, written to archives and read back; see write_archives() for nulls and repeats."""
    return read_archives(write_archives(read_table(spark, sf_dir, "pages"))).drop("error")


ORACLE_SQL = """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, octet_length(encode(h)) as n, sha256(h) as g from p),
f as (select g, min(page_id) as f from d where n >= 100 group by g)
select page_id, cast(n as bigint) as payload_bytes, d.g as payload_digest,
  case when f.f is not null and f.f <> page_id then 'revisit' else 'response' end as record_type,
  case when f.f <> page_id then f.f end as refers_to
from d left join f on d.g = f.g and d.n >= 100"""
