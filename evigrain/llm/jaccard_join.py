"""N-gram Jaccard join as a metric-space join with pivots: exact components of documents at Jaccard distance <= r.

Level 0. Almost all pairs of documents are at distance 1, so document pivots can't divide a corpus: every document
would be a boundary document of every region. The first pivots are therefore the one-shingle sets {s}: a document's
nearest are those of its own shingles, ties broken by one global order (rare first). A pair within r shares a shingle
among the first n - ceil((1 - r) n) + 1 of each, so these are the regions that a document is replicated to, and sizes
and positions give the triangle inequality's window: what stands before the first shared shingle is in one set only, so
a document meets partners of limited size there. Documents that meet in a region within the window are joined to its
first; components of these meetings are the regions of the next level, and most documents are alone.

Rarity is counted in a fixed number of buckets, so the larger the corpus, the more chance is in the order, the more
documents meet by a shared passage, and chains of such meetings hold much of the corpus. Documents of regions that are
too large for one task therefore meet again, in an order counted over them alone, until such regions shrink no more;
linked documents meet under every order.

Level 1. Each region's documents come together once. Pivots are documents, farthest first; a document goes to its
nearest pivot's region and, as a boundary document, to each region whose pivot is within 2 r of that distance. Regions
are joined again in the same way, until pivots divide no more; then only pairs inside the triangle inequality's window
whose components differ are compared. What is within r of a pivot is joined at once. A region with more shingles than
a task should hold is dealt into blocks, and each pair of blocks is joined.

Equal shingle sets are one class: they are recognised by digest, and one row of a class is sent on, or a few.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import spread
from .common import (
    attach_by_key,
    connected_components,
    discard,
    id_filter,
    materialize,
    may_hold,
    partitions,
    read_table,
    runs_of,
    shingle_sets,
    split_by_filter,
    tidy,
)

#: Two documents link when 100 * shared >= PERCENT * union.
PERCENT = 75
SHINGLE = 5
#: Shingles that a task holds of one region.
REGION = 4_000_000
PIVOTS = 48
#: The global order: documents by hash bucket of their shingles, counted over all; 16 MB as levels, whatever the input.
BUCKET_BITS = 24
PARTS = 1024
WIDTH = (1 << BUCKET_BITS) // PARTS


#: Regions of more than one block are divided again while this share of their shingles or less stays in such regions.
SHRINK = 0.8

#: Texts of a batch that are copied, or whose first shingles are sent, at a time.
PART = 256

FACTS = ["kind", "id", "n", "digest", "counts"]


def digest_of(shingles: np.ndarray) -> str:
    return hashlib.sha256(shingles.tobytes()).hexdigest()[:40]


def bucket_of(s: np.ndarray, turn: int, bits: int) -> np.ndarray:
    """Buckets of shingles, from other bits of their hashes in each turn."""
    return ((s << np.uint64(20 * (turn % 3))) >> np.uint64(64 - bits)).astype(np.int32)


def only(batches, packed: np.ndarray | None):
    """Batches of (id, text) without the rows that an id filter, packed, leaves out; those are copied, so in small parts."""
    if packed is None:
        yield from batches
        return
    bits = np.unpackbits(packed).view(bool)
    for batch in batches:
        hit = pa.array(may_hold(batch.column(0), bits))
        for at in range(0, batch.num_rows, PART):
            yield batch.slice(at, PART).filter(hit.slice(at, PART))


def profile(docs: DataFrame, size: int, turn: int = 0, bits: np.ndarray | None = None) -> DataFrame:
    """kind 0: (doc_id, number of shingles, digest of the set) of each row, in the first turn; kind 1: a task's counts of a part of the buckets."""
    packed = None if bits is None else np.packbits(bits)

    def run(batches):
        counts, held, pending = np.zeros(1 << BUCKET_BITS, np.uint8), [], 0

        def add():
            if held:
                at, n = np.unique(np.concatenate(held), return_counts=True)
                counts[at] = np.minimum(counts[at] + n, 255)
                held.clear()

        for batch in only(batches, packed):
            n, digests = [], []
            for s in shingle_sets(batch.column(1), size):
                if not turn:
                    n.append(len(s))
                    digests.append(digest_of(s) if len(s) else None)
                held.append(bucket_of(s, turn, BUCKET_BITS))
                pending += len(s)
                if pending > 1_000_000:
                    add()
                    pending = 0
            k = len(n)
            if k:
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(k, np.int32)), batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.nulls(k, pa.binary())], FACTS)
        add()
        parts = [(i, zlib.compress(c.tobytes(), 1)) for i, c in enumerate(counts.reshape(PARTS, WIDTH)) if c.any()]
        k = len(parts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ones(k, np.int32)), pa.array([i for i, _ in parts], pa.int64()), pa.array(np.zeros(k, np.int64)), pa.nulls(k, pa.string()), pa.array([c for _, c in parts], pa.binary())], FACTS
        )

    return docs.mapInArrow(tidy(run), "kind int, id long, n long, digest string, counts binary")


def bucket_levels(facts: DataFrame) -> np.ndarray:
    """A level of each bucket, higher for more documents; tasks' counts are added up part by part on the executors."""

    def run(batches):
        now, total = None, None

        def level():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.minimum(255, np.rint(8 * np.log2(1 + total))).astype(np.uint8).tobytes()], pa.binary())], ["id", "levels"])

        for batch in batches:
            for i, c in zip(batch.column(0).to_pylist(), batch.column(1)):
                if i != now:
                    if total is not None:
                        yield level()
                    now, total = i, np.zeros(WIDTH, np.int64)
                total += np.frombuffer(zlib.decompress(c.as_py()), np.uint8)
        if total is not None:
            yield level()

    parts = facts.where("kind = 1").select("id", "counts").repartition(partitions(facts.sparkSession), "id").sortWithinPartitions("id")
    got = parts.mapInArrow(tidy(run), "id long, levels binary").toArrow()
    out = np.zeros((PARTS, WIDTH), np.uint8)
    for i, c in zip(got["id"].to_pylist(), got["levels"]):
        out[i] = np.frombuffer(c.as_py(), np.uint8)
    return out.ravel()


def meetings(docs: DataFrame, rank: np.ndarray, size: int, percent: int, turn: int = 0, bits: np.ndarray | None = None) -> DataFrame:
    """(a, b): documents that meet in the region of a shingle pivot, each with the first one of its stretch there.

    Only ids that a filter's bits may hold. In turn 0 a task sends the first of equal sets; later turns send all, as the
    filter may let in an equal one that was not sent before.
    """
    packed = None if bits is None else np.packbits(bits)

    def emit(batches):
        seen = set()
        for batch in only(batches, packed):
            ids = batch.column(0).cast(pa.int64()).to_pylist()
            tokens, owner, sizes, held = [], [], [], 0

            def flush():
                count = np.array([len(t) for t in tokens], np.int64)
                place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                at = (np.repeat(np.array(sizes, np.int64), count) << 32) | place
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(np.array(owner, np.int64), count)), pa.array(at)], ["token", "id", "at"])

            for ident, s in zip(ids, shingle_sets(batch.column(1), size)):
                n = len(s)
                if not n or ident is None:
                    continue
                if not turn:
                    own = digest_of(s)
                    if own in seen:
                        continue
                    if len(seen) > 1_000_000:  # what is sent twice meets itself
                        seen.clear()
                    seen.add(own)
                first = n - (percent * n + 99) // 100 + 1
                tokens.append(s[np.argsort(rank[bucket_of(s, turn, BUCKET_BITS)], kind="stable")[:first]])
                owner.append(ident)
                sizes.append(n)
                held += first
                if held > 200_000:
                    yield flush()
                    tokens, owner, sizes, held = [], [], [], 0
            if tokens:
                yield flush()

    def meet(batches):
        last, head, smallest, top = None, 0, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            token, ident, at = (batch.column(i).to_numpy() for i in range(3))
            n, place = at >> 32, at & 0xFFFFFFFF
            # the largest partner whose first shared shingle can stand here: the sets share n - place at most
            reach = (100 + percent) * (n - place) // percent - n
            new = np.ones(len(token), bool)
            new[1:] = token[1:] != token[:-1]
            run = (np.cumsum(new) - 1) << 33
            new[0] = last is None or token[0] != last
            far = run + reach
            if not new[0]:
                far[0] = max(far[0], top)
            far = np.maximum.accumulate(far) - run
            new[0] |= n[0] > top
            new[1:] |= n[1:] > far[:-1]
            began = np.maximum.accumulate(np.where(new, np.arange(len(token)), -1))
            first, least = np.where(began >= 0, ident[began], head), np.where(began >= 0, n[began], smallest)
            pair = np.unique(np.stack([first, ident], 1)[~new & (reach >= least)], axis=0)
            pair = pair[pair[:, 0] != pair[:, 1]]
            last, head, smallest, top = token[-1], first[-1], least[-1], far[-1]
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

    found = docs.mapInArrow(tidy(emit), "token long, id long, at long")
    found = found.repartition(partitions(docs.sparkSession), "token").sortWithinPartitions("token", "at", "id")
    return found.mapInArrow(tidy(meet), "a long, b long").distinct()


def in_blocks(regions: DataFrame, sizes: DataFrame, region: int) -> tuple[DataFrame, int]:
    """regions (doc_id, region) with the number of blocks of each row's region, and the shingles in regions of several."""
    weight = regions.join(sizes, "doc_id").groupBy("region").agg(F.sum("n").alias("n"), F.count("*").alias("c"))
    blocks = F.ceil(F.col("n") * 2 / region).cast("int")
    blocks = materialize(weight.select("region", "c", "n", F.when(blocks <= 2, 1).otherwise(blocks).alias("blocks")), "blocks")
    placed = materialize(attach_by_key(regions, blocks, "region", "c").select("doc_id", "region", "blocks"), "placed")
    held = blocks.where("blocks > 1").agg(F.sum("n")).first()[0] or 0
    discard(blocks)
    return placed, held


def divided(docs: DataFrame, placed: DataFrame, size: int, percent: int, turn: int) -> DataFrame:
    """(doc_id, region) after the documents in regions of several blocks have met again, in an order of their own.

    Links are within a region and within a component of the new meetings, so a region is a pair of these, by its hash;
    regions whose hashes agree are one. Documents that meet none are alone and go.
    """
    large = placed.where("blocks > 1")
    bits = id_filter(large.select("doc_id"))
    rank = bucket_levels(profile(docs, size, turn, bits))
    met = materialize(meetings(docs, rank, size, percent, turn, bits), "meetings")
    found = connected_components(met, "regions")
    again = large.join(found.withColumnRenamed("id", "doc_id"), "doc_id").select("doc_id", F.xxhash64("region", "component").alias("region"))
    out = materialize(placed.where("blocks = 1").select("doc_id", "region").unionByName(again), "regions")
    discard(met)
    return out


class Region:
    """Exact joining of one region's documents: labels become equal where a chain of links connects documents."""

    def __init__(self, sets: list[np.ndarray], percent: int = PERCENT):
        self.n = np.array([len(s) for s in sets], np.int64)
        _, code = np.unique(np.concatenate(sets), return_inverse=True)
        self.code = code.astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.n)])
        order = np.argsort(self.code, kind="stable")
        self.owner = np.repeat(np.arange(len(sets)), self.n)[order]  # documents of each shingle
        self.first = np.searchsorted(self.code[order], np.arange(int(self.code.max()) + 2))
        self.label = np.arange(len(sets))
        self.percent, self.radius = percent, 1 - percent / 100

    def compare(self, x: int, members: np.ndarray) -> np.ndarray:
        """Distances of x from members; those linked are joined."""
        own = self.code[self.at[x] : self.at[x + 1]]
        start, size = self.first[own], self.first[own + 1] - self.first[own]
        shared = np.bincount(self.owner[spread(start, size)], minlength=len(self.n))[members]
        union = self.n[x] + self.n[members] - shared
        for other in np.unique(self.label[members[100 * shared >= self.percent * union]]).tolist():
            mine = int(self.label[x])
            if other != mine:
                self.label[self.label == max(mine, other)] = min(mine, other)
        return 1 - shared / union

    def join(self, members: np.ndarray) -> None:
        if len(members) < 2:
            return
        if len(members) <= 24:
            for k in range(len(members) - 1):
                x, rest = int(members[k]), members[k + 1 :]
                rest = rest[self.label[rest] != self.label[x]]
                if len(rest):
                    self.compare(x, rest)
            return
        pivots, far = [0], [self.compare(int(members[0]), members)]
        near = far[0].copy()
        while near.max() > 2 * self.radius and len(pivots) < min(PIVOTS, len(members)):
            pivots.append(int(near.argmax()))
            far.append(self.compare(int(members[pivots[-1]]), members))
            near = np.minimum(near, far[-1])
        far = np.array(far)
        home = far.argmin(axis=0)
        inside = home == np.arange(len(pivots))[:, None]
        window = inside | (far <= near + 2 * self.radius + 1e-12)
        # pivots divide when the regions, boundary documents included, hold little more than the documents
        divide = window.sum() <= 1.5 * len(members) and window.sum(axis=1).max() <= 0.7 * len(members)
        for r in range(len(pivots)):
            if len(np.unique(self.label[members[window[r]]])) > 1:
                if divide:
                    self.join(members[window[r]])
                else:
                    self.scan(members, inside[r], window[r], far[r])

    def scan(self, members, inside, window, d) -> None:
        """Compare pairs with one document inside, whose components differ and whose distances from the pivot allow a link."""
        most = int(members[window][np.bincount(self.label[members[window]])[self.label[members[window]]].argmax()])
        for k in np.flatnonzero(window).tolist():
            x = int(members[k])
            if self.label[x] == self.label[most]:
                continue  # pairs with others are compared from their side
            rest = members[(window if inside[k] else inside) & (np.abs(d - d[k]) <= self.radius + 1e-12)]
            rest = rest[self.label[rest] != self.label[x]]
            if len(rest):
                self.compare(x, rest)


def join_region(ids: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """The smallest id of each document's component."""
    region = Region(sets, percent)
    region.join(np.arange(len(sets)))
    roots = region.label
    low = np.full(len(sets), np.iinfo(np.int64).max)
    np.minimum.at(low, roots, ids)
    return low[roots]


def near_components(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, region: int = REGION, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row; component_id is the smallest doc_id that links reach.

    Null, empty and wordless texts have no shingles and are alone. Texts with fewer words than a shingle are one shingle.
    Rows with equal texts are linked, also where they repeat a doc_id. A doc_id with unlike texts has a row for each; their
    components may be joined, as links are between ids. Rows without doc_id are linked to equal texts only. Ties: exactly
    `percent` links. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    facts = materialize(profile(docs, size), "shingles")
    known = facts.where("kind = 0").select(F.col("id").alias("doc_id"), "n", "digest")
    # one row of each class of equal sets is sent on, and ids that stand for several classes
    firsts = known.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    kind = F.xxhash64("digest")
    several = known.where("n > 0").groupBy("doc_id").agg(F.min(kind).alias("a"), F.max(kind).alias("b")).where("a <> b").select("doc_id")
    met = materialize(meetings(docs, bucket_levels(facts), size, percent, bits=id_filter(firsts.unionByName(several))), "meetings")
    regions = materialize(connected_components(met, "regions").withColumnRenamed("id", "doc_id").withColumnRenamed("component", "region"), "regions")
    discard(met)
    sizes = known.groupBy("doc_id").agg(F.max("n").alias("n"))
    placed, held = in_blocks(regions, sizes, region)
    turn, before = 0, None
    while held and (before is None or held <= SHRINK * before):
        turn, before = turn + 1, held
        finer = divided(docs, placed, size, percent, turn)
        discard(regions)
        discard(placed)
        regions = finer
        placed, held = in_blocks(regions, sizes, region)
    bits = id_filter(placed.select("doc_id"))
    dealt = placed.withColumn("b", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("doc_id", "region", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))
    texts = split_by_filter(docs, "doc_id", bits, inside=True).join(dealt, "doc_id").select("region", "i", "j", "doc_id", "text")
    # a task's first of equal sets was sent on, so a doc_id that met another is here once, or as often as it is repeated
    keys = ["region", "i", "j"]
    gathered = texts.repartition(partitions(spark), *keys).sortWithinPartitions(*keys, "doc_id")

    def run(batches):
        for table in runs_of(batches, 3):
            ids, found = table["doc_id"].to_numpy(), list(shingle_sets(table["text"], size))
            some = [k for k, s in enumerate(found) if len(s)]
            if len(some) > 1:
                ids = ids[some]
                root = join_region(ids, [found[k] for k in some], percent)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(root)], ["a", "b"])

    links = materialize(gathered.mapInArrow(tidy(run), "a long, b long").where("a <> b"), "links")
    discard(regions)
    discard(placed)
    labels = connected_components(links, "components").withColumnRenamed("id", "doc_id").withColumnRenamed("component", "label")
    classes = known.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows"))
    named = known.join(labels, "doc_id").groupBy("digest").agg(F.min("label").alias("label"))
    classes = materialize(classes.join(named, "digest", "left"), "classes")
    low = materialize(classes.where("label is not null").groupBy("label").agg(F.min("rep").alias("component_id"), F.count("*").alias("c")), "low")
    joined = attach_by_key(classes.where("label is not null"), low, "label", "c").select("digest", "rows", "component_id")
    whole = materialize(joined.unionByName(classes.where("label is null").select("digest", "rows", F.col("rep").alias("component_id"))), "whole")
    linked = attach_by_key(known.where("n > 0"), whole, "digest", "rows").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(known.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """All documents by the Jaccard similarity of their word shingles; see near_components() for edge cases."""
    return near_components(read_table(spark, sf_dir, "documents"))


#: Every pair that shares a shingle is counted, so this is for small tables; ids are unlike and not null.
ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), runs AS (
  SELECT r, unnest(list_zip(w, w[2:], w[3:], w[4:], w[5:], true)) AS z FROM words WHERE len(w) >= 5
), shingles AS (
  SELECT DISTINCT r, concat_ws(' ', z[1], z[2], z[3], z[4], z[5]) AS g FROM runs
  UNION ALL
  SELECT r, array_to_string(w, ' ') FROM words WHERE len(w) BETWEEN 1 AND 4
), sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
shared AS (
  SELECT x.r AS a, y.r AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.g = y.g AND x.r <> y.r GROUP BY ALL
), links AS (
  SELECT DISTINCT p.doc_id AS a, q.doc_id AS b FROM shared
  JOIN sizes x ON x.r = shared.a JOIN sizes y ON y.r = shared.b JOIN words p ON p.r = shared.a JOIN words q ON q.r = shared.b
  WHERE 100 * shared.n >= 75 * (x.n + y.n - shared.n)
), reach AS (
  SELECT doc_id AS id, doc_id AS other FROM documents
  UNION
  SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.other
), low AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM words JOIN low ON low.id = doc_id LEFT JOIN sizes ON sizes.r = words.r
"""
