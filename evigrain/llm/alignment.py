"""Cross-tokenizer alignment: how often tokens of one vocabulary end together with tokens of another.

A text is encoded by both tokenizers (A, byte-level; B, with word pieces). Where an A token and a B token end at the same
byte they are linked, and the text is cut into a group. The counts of linked id pairs over the whole corpus are dense
matrices, striped by B id: stripe b mod STRIPES has a row for each of its B ids and a column for each A id, so frequent
ids spread over stripes. A batch of texts sends each stripe its cells once, with the number of links of each text.

1. encoded(): facts of each text, and the links of a batch by stripe; written once, read by the two passes below.
2. pair_counts(): np.add.at into a stripe's block; a stripe of very many cells is summed in several tasks first.
3. scored(): the links are dealt by stripe, and within a large stripe by batch, to tasks that hold the stripe's block
   and its rows' maxima; sums by text go back by batch.
"""

from __future__ import annotations

import hashlib
import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.shared import over_cores
from .common import materialize, partitions, read_table, slices, tidy, utf8_view

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: A block has (B ids / STRIPES) x (A ids) counts: 51 MB for vocabularies of 32,000 and 50,257.
STRIPES = 256
#: Bytes of texts that are aligned together, and that a tokenizer gets at once.
RUN, ENCODE = 4 << 20, 1 << 20
#: Cells, and links by text, of a stripe that one task adds up or scores; more are dealt over several tasks.
CELLS, LINKS = 64_000_000, 16_000_000
#: Cells of a row of a stripe's counts.
CHUNK = 1_000_000
_DOC = 20


def byte_letters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 ones for themselves."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(others)}


class Vocabulary:
    """Each id's bytes, as lengths and one flat array."""

    def __init__(self, entries: list[bytes]):
        self.size = len(entries)
        self.length = np.array([len(e) for e in entries], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        self.flat = np.frombuffer(b"".join(entries), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.length[ids]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.start[ids] - (ends - size), size) + np.arange(int(ends[-1]) if len(ids) else 0)]


# Fixed value: where byte-level vocabularies cut a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def plain_ranks(inner, spec: dict) -> dict[bytes, int] | None:
    """Ranks by which merging any two neighbours of the lowest rank gives the same ids as the vocabulary's merges; else None.

    That holds when ids grow with the merges and each entry, as a word, is encoded as itself: a pair that is no merge but
    spells an entry would have to arise within that entry's own encoding too, as what happens inside a span doesn't depend
    on its neighbours until it is joined to them, and would stay there.
    """
    model, cut = spec["model"], spec["pre_tokenizer"] or {}
    if spec["normalizer"] or (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex", True)) != ("ByteLevel", False, True):
        return None
    letters, added = byte_letters(), {t["content"] for t in spec.get("added_tokens", [])}
    vocabulary = {t: i for t, i in model["vocab"].items() if t not in added}
    merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if any(b <= a for a, b in zip(merged, merged[1:])) or not all(set(t) <= letters.keys() for t in vocabulary) or not letters.keys() <= vocabulary.keys():
        return None
    if any([x.id for x in inner.model.tokenize(t)] != [i] for t, i in vocabulary.items()):
        return None
    return {bytes(letters[c] for c in t): i for t, i in vocabulary.items()}


class ByteLevel:
    """Tokenizer A. Where plain_ranks() says that it may, it merges by ranks, which is four times as fast."""

    def __init__(self, path: str, ranks: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.words = None
        with open(path, encoding="utf-8") as f:
            found = plain_ranks(self.inner, json.load(f)) if ranks else None
        if found is not None:
            import tiktoken

            self.words = tiktoken.Encoding("words", pat_str=WORDS, mergeable_ranks=found, special_tokens={})
        self.inner.encode_special_tokens = True
        self.batch = getattr(self.inner, "encode_batch_fast", self.inner.encode_batch)
        letters, vocabulary = byte_letters(), self.inner.get_vocab()
        entries = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            # an added token that is no byte-level spelling is never given, as special tokens are encoded as text
            entries[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.vocabulary = Vocabulary(entries)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.words is not None:
            return [np.array(self.words.encode_ordinary(" " + t), np.int64) for t in texts]
        return [np.array(e.ids, np.int64) for e in self.batch([" " + t for t in texts], add_special_tokens=False)]


class WordPieces:
    """Tokenizer B, which puts a space before the text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.inner = sentencepiece.SentencePieceProcessor(model_file=path)
        one = lambda i: bytes([int(self.inner.id_to_piece(i)[3:5], 16)]) if self.inner.is_byte(i) else self.inner.id_to_piece(i).replace("▁", " ").encode()
        self.vocabulary = Vocabulary([one(i) for i in range(self.inner.get_piece_size())])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int64) for ids in self.inner.encode(texts, num_threads=1)]


class Aligner:
    def __init__(self, a: ByteLevel, b: WordPieces):
        self.a, self.b = a, b
        spell = [f"{i}{end}".encode() for i in range(a.vocabulary.size) for end in ",|"]
        spell += [f"{i}{end}".encode() for i in range(b.vocabulary.size) for end in ",;"]
        self.spell = np.array(spell, object)

    def align(self, texts: list[str]):
        """Per text (n_a, n_b, n_groups, groups_sha256); of all links (text, a, b) in order.

        A text that is empty, or whose tokens don't give back the text and a space before it, has no tokens.
        """
        some = [k for k, t in enumerate(texts) if t]
        ids_a, ids_b, owner = [], [], []
        size = np.array([len(texts[k].encode()) for k in some] or [0], np.int64)
        for x, y in slices(np.concatenate([[0], np.cumsum(size)])[: len(some) + 1], ENCODE):
            part = [texts[k] for k in some[x:y]]
            for k, t, a, b in zip(some[x:y], part, self.a.encode(part), self.b.encode(part)):
                want = np.frombuffer(b" " + t.encode(), np.uint8)
                if np.array_equal(self.a.vocabulary.joined(a), want) and np.array_equal(self.b.vocabulary.joined(b), want):
                    ids_a.append(a)
                    ids_b.append(b)
                    owner.append(k)
        n_a, n_b, groups, none = *(np.zeros(len(texts), np.int64) for _ in range(3)), np.zeros(0, np.int64)
        digests = [""] * len(texts)
        if not owner:
            return n_a, n_b, groups, digests, (none, none, none)
        owner = np.array(owner)
        n_a[owner], n_b[owner] = [len(a) for a in ids_a], [len(b) for b in ids_b]
        a, b = np.concatenate(ids_a), np.concatenate(ids_b)
        end_a, end_b = np.cumsum(self.a.vocabulary.length[a]), np.cumsum(self.b.vocabulary.length[b])
        mark = np.zeros(int(end_a[-1]) + 1, bool)
        mark[end_b] = True
        cut_a = mark[end_a]
        mark[:] = False
        mark[end_a] = True
        cut_b = mark[end_b]
        last_a, last_b = np.flatnonzero(cut_a) + 1, np.flatnonzero(cut_b) + 1
        # tokens in the order of groups, A's of a group before B's
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.concatenate([[0], last_b])[np.cumsum(cut_a) - cut_a]] = 2 * a + cut_a
        order[np.arange(len(b)) + last_a[np.cumsum(cut_b) - cut_b]] = 2 * (self.a.vocabulary.size + b) + cut_b
        text = np.repeat(owner, n_a[owner])[cut_a]
        groups += np.bincount(text, minlength=len(texts))
        x = 0
        for k in owner.tolist():
            y = x + int(n_a[k] + n_b[k])
            digests[k] = hashlib.sha256(b"".join(self.spell[order[x:y]].tolist())[:-1]).hexdigest()
            x = y
        return n_a, n_b, groups, digests, (text, a[cut_a], b[cut_b])


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(ByteLevel(a_path), WordPieces(b_path))


def shape_of(a_path: str, b_path: str) -> tuple[int, int]:
    """(ids of A, rows of a stripe), from the vocabulary files' sizes."""
    import sentencepiece

    with open(a_path, encoding="utf-8") as f:
        found = json.load(f)
    ids = [*found["model"]["vocab"].values(), *(t["id"] for t in found.get("added_tokens", []))]
    return max(ids) + 1, -(-sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size() // STRIPES)


FACTS = "kind int, batch long, at int, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, stripe int, n_cells long, n_links long, cells binary, runs binary, docs binary, times binary"
_NAMES = [c.split()[0] for c in FACTS.split(", ")]
_TYPES = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]] for c in FACTS.split(", ")]


def _rows(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(_NAMES, _TYPES)], _NAMES)


def _bytes(x: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    return [x[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:])]


def encoded(docs: DataFrame, a_path: str, b_path: str, run: int = RUN) -> DataFrame:
    """kind 1: facts of each text; kind 0: a batch's links in a stripe: its cells, and of each cell the texts and their links."""
    width, rows = shape_of(a_path, b_path)

    def work(batches):
        own, number = aligner(a_path, b_path), TaskContext.get().partitionId() << 32
        for batch in batches:
            _, offsets = utf8_view(batch.column(1))
            ids = batch.column(0).cast(pa.int64())
            for x, y in slices(offsets, run):
                texts = [t or "" for t in batch.column(1).slice(x, y - x).to_pylist()]
                n_a, n_b, groups, digests, (text, a, b) = own.align(texts)
                n, number = y - x, number + 1
                yield _rows(n, kind=np.ones(n, np.int32), batch=np.full(n, number), at=np.arange(n, dtype=np.int32), doc_id=ids.slice(x, n), n_a=n_a, n_b=n_b, n_groups=groups, groups_sha256=digests)
                if not len(text):
                    continue
                key = (((b % STRIPES) * rows + b // STRIPES) * width + a) << _DOC | text
                key.sort()
                first = np.flatnonzero(np.diff(key, prepend=-1))
                times = np.diff(first, append=len(key)).astype(np.uint32)
                key = key[first]
                cell, doc = key >> _DOC, (key & ((1 << _DOC) - 1)).astype(np.uint32)
                head = np.flatnonzero(np.diff(cell, prepend=-1))
                runs = np.diff(head, append=len(cell)).astype(np.uint32)
                cell = cell[head]
                stripe = cell // (rows * width)
                edge = np.flatnonzero(np.diff(stripe, prepend=-1))
                cuts, long = np.append(edge, len(cell)), np.append(head[edge], len(doc))
                local = (cell % (rows * width)).astype(np.uint32)
                k = len(edge)
                yield _rows(k, kind=np.zeros(k, np.int32), batch=np.full(k, number), stripe=stripe[edge].astype(np.int32), n_cells=np.diff(cuts), n_links=np.diff(long), cells=_bytes(local, cuts), runs=_bytes(runs, cuts), docs=_bytes(doc, long), times=_bytes(times, long))

    return docs.mapInArrow(tidy(work), FACTS)


def _numbers(column, kind) -> np.ndarray:
    return np.frombuffer(column.as_buffer(), kind)


def _summed(rows: DataFrame, cells: int) -> DataFrame:
    """(stripe, cells, counts): sums of rows (stripe, salt, cells, counts) by stripe and salt, each in a dense block."""
    dealt = rows.repartition(partitions(rows.sparkSession), "stripe", "salt").sortWithinPartitions("stripe", "salt")

    def work(batches):
        block, now = np.zeros(cells, np.int64), None

        def out():
            at = np.flatnonzero(block)
            for x in range(0, len(at), CHUNK):
                part = at[x : x + CHUNK]
                yield pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([part.astype(np.uint32).tobytes()], pa.binary()), pa.array([block[part].tobytes()], pa.binary())], ["stripe", "cells", "counts"])

        for batch in batches:
            for k in range(batch.num_rows):
                key = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                if key != now:
                    if now is not None:
                        yield from out()
                        block[:] = 0
                    now = key
                np.add.at(block, _numbers(batch.column(2)[k], np.uint32), _numbers(batch.column(3)[k], np.int64))
        if now is not None:
            yield from out()

    return dealt.select("stripe", "salt", "cells", "counts").mapInArrow(tidy(work), "stripe int, cells binary, counts binary")


def _by_stripe(numbers: dict[int, int]) -> Column:
    """A column of one number a stripe, 1 for stripes that aren't named; STRIPES numbers at most."""
    return F.element_at(F.array(*[F.lit(int(numbers.get(s, 1))) for s in range(STRIPES)]), F.col("stripe") + 1)


def pair_counts(links: DataFrame, width: int, rows: int, cells: int = CELLS) -> DataFrame:
    """(stripe, cells, counts): how many links of the corpus hold each pair; links: rows of kind 0 of encoded()."""

    def counted(batches):
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                runs, times = _numbers(batch.column(3)[k], np.uint32), _numbers(batch.column(4)[k], np.uint32)
                out.append(np.add.reduceat(times.astype(np.int64), np.cumsum(runs.astype(np.int64)) - runs).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.binary())], ["stripe", "salt", "cells", "counts"])

    sizes = {r["stripe"]: r["n"] for r in links.groupBy("stripe").agg(F.sum("n_cells").alias("n")).collect()}  # STRIPES rows at most
    salts = {s: -(-n // cells) for s, n in sizes.items() if n > cells}
    salted = links.select("stripe", F.pmod(F.xxhash64("batch"), _by_stripe(salts)).cast("int").alias("salt"), "cells", "runs", "times")
    found = _summed(salted.mapInArrow(tidy(counted), "stripe int, salt int, cells binary, counts binary"), rows * width)
    if salts:
        found = _summed(found.select("stripe", F.lit(0).alias("salt"), "cells", "counts"), rows * width)
    return found


def scored(links: DataFrame, counts: DataFrame, width: int, rows: int, most: int = LINKS) -> DataFrame:
    """(batch, docs, best, total): for texts of a batch, links that are best for their B id, and the sum of links' counts."""
    sizes = {r["stripe"]: r["n"] for r in links.groupBy("stripe").agg(F.sum("n_links").alias("n")).collect()}  # STRIPES rows at most
    shares = _by_stripe({s: -(-n // most) for s, n in sizes.items() if n > most})
    empty = lambda *names: [F.lit(None).cast("binary").alias(c) for c in names]
    blocks = counts.withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1))).select("stripe", "share", F.lit(0).alias("turn"), F.lit(0).cast("long").alias("batch"), "cells", "counts", *empty("runs", "docs", "times"))
    own = links.select("stripe", F.pmod(F.xxhash64("batch"), shares).cast("int").alias("share"), F.lit(1).alias("turn"), "batch", "cells", *empty("counts"), "runs", "docs", "times")
    dealt = blocks.unionByName(own).repartition(partitions(links.sparkSession), "stripe", "share").sortWithinPartitions("stripe", "share", "turn")
    names = dealt.columns

    def work(batches):
        block, best, now = np.zeros(rows * width, np.int64), None, None
        for batch in batches:
            column = {c: batch.column(k) for k, c in enumerate(names)}
            out = []
            for k in range(batch.num_rows):
                key = column["stripe"][k].as_py(), column["share"][k].as_py()
                if key != now:
                    block[:], best, now = 0, None, key
                cell = _numbers(column["cells"][k], np.uint32)
                if not column["turn"][k].as_py():
                    block[cell] = _numbers(column["counts"][k], np.int64)
                    continue
                if best is None:
                    best = block.reshape(rows, width).max(axis=1)
                n = block[cell]
                hit = n == best[cell // width]
                runs = _numbers(column["runs"][k], np.uint32)
                times = _numbers(column["times"][k], np.uint32).astype(np.int64)
                docs, at = np.unique(_numbers(column["docs"][k], np.uint32), return_inverse=True)
                sums = np.zeros((2, len(docs)), np.int64)
                np.add.at(sums[0], at, times * np.repeat(hit, runs))
                np.add.at(sums[1], at, times * np.repeat(n, runs))
                out.append((column["batch"][k].as_py(), docs.tobytes(), sums[0].tobytes(), sums[1].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["batch", "docs", "best", "total"])

    return dealt.mapInArrow(tidy(work), "batch long, docs binary, best binary, total binary")


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def align_table(docs: DataFrame, a_path: str, b_path: str, text: str = "text", key: str = "doc_id", run: int = RUN, cells: int = CELLS, most: int = LINKS) -> DataFrame:
    """Per row: tokens of A and B, groups, links, links that are best for their B id, the links' counts, the groups' digest.

    Null and empty texts, and texts that a tokenizer changes, have zeros and an empty digest; they count for no pair. Each
    row is a text of its own, so repeated ids and copies count as often as they occur; ties for a B id's highest count are
    all best. Very long texts are aligned whole. Other columns are not read. An empty table gives an empty result.
    """
    width, rows = shape_of(a_path, b_path)
    found = materialize(encoded(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), a_path, b_path, run), "aligned", codec="zstd")
    links = found.where("kind = 0").select("batch", "stripe", "n_cells", "n_links", "cells", "runs", "docs", "times")
    counts = materialize(pair_counts(links, width, rows, cells), "pairs", codec="zstd")
    sums = scored(links, counts, width, rows, most)
    facts = found.where("kind = 1").select("batch", F.lit(1).alias("turn"), "at", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256")
    both = facts.unionByName(sums.withColumn("turn", F.lit(0)), allowMissingColumns=True)
    dealt = both.repartition(partitions(docs.sparkSession), "batch").sortWithinPartitions("batch", "turn", "at")
    names = dealt.columns

    def work(batches):
        now, best, total = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            column = {c: batch.column(k) for k, c in enumerate(names)}
            turn, number = (np.asarray(column[c].to_numpy(zero_copy_only=False)) for c in ("turn", "batch"))
            edges = np.flatnonzero((np.diff(number, prepend=-1) != 0) | (np.diff(turn, prepend=-1) != 0))
            for x, y in zip(edges, [*edges[1:], batch.num_rows]):
                if number[x] != now:
                    now, best, total = number[x], np.zeros(1, np.int64), np.zeros(1, np.int64)
                if turn[x] == 0:
                    for k in range(x, y):
                        docs_ = _numbers(column["docs"][k], np.uint32)
                        if docs_[-1] >= len(best):
                            more = np.zeros(max(int(docs_[-1]) + 1, 2 * len(best)) - len(best), np.int64)
                            best, total = np.append(best, more), np.append(total, more)
                        best[docs_] += _numbers(column["best"][k], np.int64)
                        total[docs_] += _numbers(column["total"][k], np.int64)
                    continue
                at = column["at"].slice(x, y - x).to_numpy(zero_copy_only=False).astype(np.int64)
                room = max(0, int(at.max()) + 1 - len(best))
                b, t = np.append(best, np.zeros(room, np.int64))[at], np.append(total, np.zeros(room, np.int64))[at]
                part = lambda c: column[c].slice(x, y - x)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([part("doc_id"), part("n_a"), part("n_b"), part("n_groups"), part("n_groups"), pa.array(b), pa.array(t), part("groups_sha256")], [c.split()[0] for c in RESULT.split(", ")])

    return dealt.mapInArrow(tidy(work), RESULT)


def op12_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents, aligned between the two vocabularies; see align_table() for edge cases."""
    import public_tokenizers as P

    return align_table(over_cores(read_table(spark, sf_dir, "documents")), P.path(A_FILE), P.path(B_FILE))
