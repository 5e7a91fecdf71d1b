"""Byte-level BPE encoding and decoding.

Two tiers. A minimal perfect hash over the vocabulary's byte strings resolves a whole pre-token that is a token already:
its two 64-bit hashes pick a bucket's displacement and a slot, and the slot's string is compared, so that a foreign
string is never taken for a token. Misses are merged with a heap of candidate pairs over a doubly linked list of bytes,
in O(n log n), so that a very long pre-token does no harm. Both work on a batch's distinct pre-tokens only.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ..operators.shared import over_cores
from .common import mix, read_table, slices, tidy, utf8_view

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Remembered pre-tokens of a worker, as their ids' bytes; beyond, the memory starts anew. Results don't depend on it.
MEMORY = 500_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def string_hashes(data: np.ndarray, offsets: np.ndarray, seed: int) -> np.ndarray:
    """One 64-bit hash of each whole byte string."""
    n = len(offsets) - 1
    out = np.full(n, mix(np.array([seed], np.uint64))[0], np.uint64)
    sizes = np.diff(offsets)
    acc = np.zeros(n, np.uint64)
    for k in range(int(sizes.max()) if n else 0):
        live = np.flatnonzero(sizes > k)
        acc[live] = (acc[live] ^ (data[offsets[live] + k].astype(np.uint64) + np.uint64(1))) * np.uint64(0x100000001B3)
        acc[live] ^= acc[live] >> np.uint64(29)
    return mix(acc + out * (sizes.astype(np.uint64) + np.uint64(1)))


class PerfectHash:
    """Minimal perfect hash by displacements (hash, displace and compress): n keys fill n slots exactly."""

    DIRECT = np.uint64(1 << 63)

    def __init__(self, keys: list[bytes]):
        self.keys, n = keys, len(keys)
        self.longest = max(map(len, keys), default=0)
        data, offsets = utf8_view(pa.array(keys, pa.binary()))
        h = string_hashes(data, offsets, 1)
        self.buckets = max(1, n // 4)
        self.n = n
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, b in enumerate(bucket.tolist()):
            members[b].append(i)
        self.shift = np.zeros(self.buckets, np.uint64)
        self.slot = np.full(n, -1, np.int64)
        tries = np.arange(64, dtype=np.uint64)[None, :]
        free = None
        for b in sorted(range(self.buckets), key=lambda x: -len(members[x])):
            if not members[b]:
                break
            own = h[members[b]]
            if len(own) == 1:  # any free slot will do, named outright
                if free is None:
                    free = iter(np.flatnonzero(self.slot < 0).tolist())
                at = [next(free)]
                self.shift[b] = self.DIRECT | np.uint64(at[0])
            else:
                first = np.uint64(0)
                while True:
                    at = np.sort(self._place(own[:, None], tries + first), axis=0)
                    good = (self.slot[at] < 0).all(axis=0) & (np.diff(at, axis=0) > 0).all(axis=0)
                    if good.any():
                        break
                    first += np.uint64(64)
                self.shift[b] = first + np.uint64(int(good.argmax()))
                at = self._place(own, self.shift[b : b + 1])
            self.slot[at] = members[b]

    def _place(self, h: np.ndarray, d) -> np.ndarray:
        return (mix(h + d * np.uint64(0xD1342543DE82EF95)) % np.uint64(self.n)).astype(np.int64)

    def _slots(self, h: np.ndarray) -> np.ndarray:
        shift = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        return np.where(shift >= self.DIRECT, (shift & ~self.DIRECT).astype(np.int64), self._place(h, shift))

    def find(self, strings: pa.Array) -> np.ndarray:
        """Index of each string among the keys, else -1."""
        data, offsets = utf8_view(strings)
        sizes = np.diff(offsets)
        out = np.full(len(sizes), -1, np.int64)
        short = np.flatnonzero((sizes <= self.longest) & (sizes > 0))
        if not len(short):
            return out
        part = strings.take(pa.array(short))
        data, offsets = utf8_view(part)
        h = string_hashes(data, offsets, 1)
        guess = self.slot[self._slots(h)]
        keys = self.keys
        out[short] = [g if keys[g] == s else -1 for g, s in zip(guess.tolist(), part.cast(pa.binary()).to_pylist())]
        return out


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token by merging the pair of lowest rank, leftmost first, over linked bytes."""
    n = len(piece)
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    after = list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    dead = bytearray(n)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if dead[i]:
            continue
        j = after[i]
        if j >= n or end[j] != stop:
            continue  # one of the pair has changed since
        dead[j], end[i], k = 1, stop, after[j]
        after[i] = k
        if k < n:
            before[k] = i
            if (r := ranks.get(piece[i : end[k]])) is not None:
                heapq.heappush(heap, (r, i, end[k]))
        p = before[i]
        if p >= 0 and (r := ranks.get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = after[i]
    return out


class Coder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if lacking := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the vocabulary lacks the bytes {lacking}")
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = list(ranks)
        self.ids = np.array([ranks[t] for t in self.tokens], np.uint32)
        self.whole = PerfectHash(self.tokens)
        self.memory: dict[str, bytes] = {}
        top = int(self.ids.max()) + 1 if len(self.ids) else 0
        by_id = [b""] * top
        for t, i in ranks.items():
            by_id[i] = t
        self.length = np.array([len(t) for t in by_id], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of n + 1)."""
        found = [self.pattern.findall(t) for t in texts]
        counts = np.array([len(f) for f in found], np.int64)
        flat = pa.array([w for f in found for w in f], pa.large_string()).dictionary_encode()
        words, codes = flat.dictionary, flat.indices.to_numpy(zero_copy_only=False)
        at = self.whole.find(words)
        sizes = np.ones(len(words), np.int64)
        missed = np.flatnonzero(at < 0)
        if len(self.memory) > MEMORY:
            self.memory = {}
        memory, ranks, merged = self.memory, self.ranks, []
        for w in words.take(pa.array(missed)).to_pylist():
            ids = memory.get(w)
            if ids is None:
                ids = array("I", merge_bytes(w.encode(), ranks)).tobytes()
                if len(w) < 64:
                    memory[w] = ids
            merged.append(ids)
        sizes[missed] = np.fromiter(map(len, merged), np.int64, len(merged)) // 4
        starts = np.concatenate([[0], np.cumsum(sizes)])
        pool = np.zeros(starts[-1], np.uint32)
        hit = np.flatnonzero(at >= 0)
        pool[starts[hit]] = self.ids[at[hit]]
        pool[spread(starts[missed], sizes[missed])] = np.frombuffer(b"".join(merged), np.uint32)
        return gather(pool, starts[:-1], sizes, codes, counts)

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.length[ids]
        return self.bytes[spread(self.start[ids], size)].tobytes()


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Concatenated ranges [starts, starts + sizes)."""
    total = int(sizes.sum())
    shift = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return shift + np.arange(total)


def gather(pool, starts, sizes, codes, counts):
    """Concatenate pool[starts[c] : starts[c] + sizes[c]] over codes; offsets by text, which has counts[i] codes."""
    per = sizes[codes]
    ids = pool[spread(starts[codes], per)]
    ends = np.concatenate([[0], np.cumsum(per)])
    return ids, ends[np.concatenate([[0], np.cumsum(counts)])]


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> Coder:
    return Coder(load_ranks(path), pattern)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_table(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: number of ids, digests of the ids and of the bytes that they decode to.

    Null and empty texts have no ids. Rows are independent: copies, ties and repeated keys need no care. Texts and
    pre-tokens of any length are encoded whole. A vocabulary that lacks a byte is an error. An empty table gives an
    empty result.
    """

    def run(batches):
        c = coder(path, pattern)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            _, offsets = utf8_view(texts)
            for a, b in slices(offsets, 4 << 20):
                part = [t or "" for t in texts.slice(a, b - a).to_pylist()]
                ids, at = c.encode(part)
                n, d1, d2 = np.diff(at), [], []
                for x, y in zip(at[:-1].tolist(), at[1:].tolist()):
                    d1.append(hashlib.sha256(ids[x:y].astype("<u4").tobytes()).hexdigest())
                    d2.append(hashlib.sha256(c.decode(ids[x:y])).hexdigest())
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a).cast(pa.int64()), pa.array(n), pa.array(d1), pa.array(d2)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(key, text).mapInArrow(tidy(run), SCHEMA)


def op10_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents encoded and decoded again; see encode_table() for nulls and repeats."""
    import public_tokenizers as P

    return encode_table(over_cores(read_table(spark, sf_dir, "documents")), P.path(VOCABULARY), P.PATTERN)
