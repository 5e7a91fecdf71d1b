"""Packing by minimum bin slack.

Documents are cut into pieces of the window's length and one rest each. Only the count of each length matters to the
plan, so the driver sees at most `window` numbers, whatever the corpus. For each window the largest length left is set,
and a subset-sum dynamic program over bitsets (one bit a sum, counts split in powers of two) finds the multiset of
remaining lengths that fills the window closest to its capacity; backtracking gives its counts. The pattern found is
used as often as the counts allow. Pieces then take the plan's places by their rank among pieces of equal length.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import gather
from .common import materialize, read_table, slices, tidy, utf8_view

VOCABULARY = "word_bpe_49k.json"
WINDOW = 4096
END = 2
#: Bytes of texts that are tokenized at once.
RUN = 8 << 20
#: Remembered chunks of a worker; beyond, the memory starts anew. Results don't depend on it.
MEMORY = 600_000


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, at most counts of each, whose sum is the closest to capacity from below."""
    mask, reach, steps = (1 << (capacity + 1)) - 1, 1, []
    for size in sorted((s for s in counts if s <= capacity), reverse=True):
        left, k = min(counts[size], capacity // size), 1
        while left and not reach >> capacity:
            k = min(k, left)
            steps.append((size, k, reach))
            reach |= (reach << (k * size)) & mask
            left, k = left - k, 2 * k
        if reach >> capacity:
            break
    total, used = reach.bit_length() - 1, {}
    for size, k, before in reversed(steps):
        if not before >> total & 1:
            total -= k * size
            used[size] = used.get(size, 0) + k
    return used


def plan_windows(counts: dict[int, int], window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """[(lengths with counts of one window, windows filled so)], using every piece once."""
    left, plan = {s: n for s, n in counts.items() if n > 0}, []
    while left:
        top = max(left)
        left[top] -= 1
        rest = {s: n for s, n in left.items() if n}
        used = best_fill(rest, window - top)
        left[top] += 1
        used[top] = used.get(top, 0) + 1
        times = min(left[s] // n for s, n in used.items())
        for s, n in used.items():
            left[s] -= n * times
            if not left[s]:
                del left[s]
        plan.append((used, times))
    return plan


def places(plan, window: int = WINDOW) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, copies a window, first sequence, first offset), by rank."""
    rank, out, sequence = {}, {}, 0
    for used, times in plan:
        offset = 0
        for size in sorted(used, reverse=True):
            out.setdefault(size, []).append((rank.get(size, 0), used[size], sequence, offset))
            rank[size] = rank.get(size, 0) + used[size] * times
            offset += size * used[size]
        sequence += times
    return {s: np.array(rows, np.int64) for s, rows in out.items()}


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(48, 58), *range(97, 123)]] = True
_PLAIN_OR_SPACE = _PLAIN.copy()
_PLAIN_OR_SPACE[[32, 10]] = True


def chunks_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(chunks, number of each text's) of texts without combining marks.

    Texts are lower-cased as far as Latin-1 goes, and cut at spaces and line ends, which go, and around a full stop or
    comma between a letter or digit and one, white space or the end. Each cut is one between pre-tokens.
    """
    low = _LOWER[data]
    at = np.flatnonzero(data[:-1] == 0xC3) + 1
    capital = at[(data[at] >= 0x80) & (data[at] <= 0x9E) & (data[at] != 0x97)]
    low[capital] += 32
    letter = _PLAIN[low]
    letter[at[(low[at] != 0x97) & (low[at] != 0xB7)]] = True
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    point = (data[1:] == 46) | (data[1:] == 44)
    point &= letter[:-1] & ~edge[1:-1]
    point[:-1] &= _PLAIN_OR_SPACE[low[2:]] | edge[2:-1]
    point = np.flatnonzero(point) + 1
    space = (data == 32) | (data == 10)
    edge[1:] |= space
    edge[point] = True
    edge[point + 1] = True
    place = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~space, out=place[1:])
    ends = place[edge]
    ends = ends[np.flatnonzero(np.diff(ends, prepend=0))]
    bounds = np.concatenate([[0], ends])
    chunks = pa.Array.from_buffers(pa.large_string(), len(ends), [None, pa.py_buffer(bounds), pa.py_buffer(low[~space])])
    return chunks, np.diff(np.searchsorted(ends, place[offsets], "right"))


class ChunkTokenizer:
    """Ids of texts through the ids of their distinct chunks.

    The vocabulary's pre-tokens never reach over a cut, so a text's ids are those of its chunks in a row. Chunks of
    Latin-1 letters are one pre-token each and are encoded many at a time, as one text, which the vocabulary's word
    ends take apart again; all others, and texts with combining marks, are encoded one by one. So are texts that hold a
    special token's spelling, in any case, as the vocabulary reads those before it cuts.
    """

    def __init__(self, path: str, memory: int = MEMORY):
        self.memory = memory
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        names = [t.content.lower().encode() for t in self.inner.get_added_tokens_decoder().values()]
        self.special = re.compile(b"|".join(map(re.escape, names))) if names else None
        self.batch = getattr(self.inner, "encode_batch_fast", self.inner.encode_batch)
        vocabulary = self.inner.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.starts, self.sizes = array("I"), array("q"), array("q")

    def _learn(self, new: list[str]) -> None:
        words = [w for w in new if w.isalpha() and max(w) < "\u0100"]
        for k in range(0, len(words), 2000):
            part = words[k : k + 2000]
            ids = np.array(self.batch([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(part):
                raise ValueError("the vocabulary doesn't mark the ends of words")
            first = np.concatenate([[0], ends[:-1]])
            self.index.update(zip(part, range(len(self.index), len(self.index) + len(part))))
            self.starts.frombytes((len(self.flat) + first).astype(np.int64).tobytes())
            self.sizes.frombytes((ends - first).astype(np.int64).tobytes())
            self.flat.frombytes(ids.tobytes())
        rest = [w for w in new if w not in self.index]
        for k in range(0, len(rest), 2000):
            part = rest[k : k + 2000]
            for w, e in zip(part, self.batch(part, add_special_tokens=False)):
                self.index[w] = len(self.index)
                self.starts.append(len(self.flat))
                self.sizes.append(len(e.ids))
                self.flat.extend(e.ids)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of n + 1) of texts given as bytes and offsets."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        odd = np.flatnonzero((data == 0xCC) | (data == 0xCD))  # the first bytes of combining marks
        if self.special is not None:
            odd = np.append(odd, np.array([m.start() for m in self.special.finditer(_LOWER[data].tobytes())], np.int64))
        odd = np.unique(np.searchsorted(offsets, odd, "right") - 1)
        if not len(odd):
            return self._encode(data, offsets)
        ids, sizes, a = [], [], 0
        for k in [*odd.tolist(), len(offsets) - 1]:
            if k > a:
                own, at = self.encode(data[offsets[a] : offsets[k]], offsets[a : k + 1] - offsets[a])
                ids.append(own)
                sizes.append(np.diff(at))
            if k < len(offsets) - 1:
                own = self.inner.encode(data[offsets[k] : offsets[k + 1]].tobytes().decode(), add_special_tokens=False).ids
                ids.append(np.array(own, np.uint32))
                sizes.append(np.array([len(own)]))
            a = k + 1
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.index) > self.memory:
            self.clear()
        chunks, counts = chunks_of(data, offsets)
        chunks = chunks.dictionary_encode()
        unique, index = chunks.dictionary.to_pylist(), self.index
        new = [w for w in unique if w not in index]
        if new:
            self._learn(new)
        known = np.array([index[w] for w in unique], np.int64)
        codes = known[chunks.indices.to_numpy(zero_copy_only=False)]
        return gather(np.array(self.flat, np.uint32), np.array(self.starts, np.int64), np.array(self.sizes, np.int64), codes, counts)


@lru_cache(maxsize=1)
def tokenizer(path: str, memory: int = MEMORY) -> ChunkTokenizer:
    """One a worker, so that its memory serves all tasks there."""
    return ChunkTokenizer(path, memory)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, local long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cut_pieces(docs: DataFrame, path: str, window: int, end: int, text: str, key: str, run_bytes: int, memory: int) -> DataFrame:
    def run(batches):
        tok, part, seen = tokenizer(path, memory), TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        for batch in batches:
            keys, texts = batch.column(0).cast(pa.int64()), batch.column(1)
            data, offsets = utf8_view(texts)
            for a, b in slices(offsets, run_bytes):
                span = offsets[a : b + 1]
                ids, at = tok.encode(data[span[0] : span[-1]], span - span[0])
                rows = []
                for key_, x, y in zip(keys.slice(a, b - a).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                    own = np.append(ids[x:y], np.uint32(end)).astype("<u4")
                    n = len(own)
                    for s in range(0, n, window):
                        size = min(window, n - s)
                        rows.append((key_, s, size, zlib.crc32(own[s : s + size].tobytes()), n, part, int(seen[size])))
                        seen[size] += 1
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int32() if k == 5 else pa.int64()) for k, c in enumerate(zip(*rows))],
                        ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "local"],
                    )

    return docs.select(key, text).mapInArrow(run, PIECES)


def pack(docs: DataFrame, path: str, window: int = WINDOW, end: int = END, text: str = "text", key: str = "doc_id", run_bytes: int = RUN, memory: int = MEMORY) -> DataFrame:
    """One row per piece, with the sequence that holds it and its offset there.

    Null and empty texts are the end id alone. Repeated rows and keys are packed as often as they occur. An empty
    table gives an empty result. Of a sequence that isn't full, only its end is padding. run_bytes: texts that a worker
    tokenizes at once, and memory: chunks that it remembers; they trade its memory against its time and change no result.
    """
    pieces = materialize(cut_pieces(docs, path, window, end, text, key, run_bytes, memory), "pieces")
    # ranks among equal lengths: counted within each task above, so that one frequent length is nobody's burden
    tasks = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = tasks.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))).select("part", "length", "ahead")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # window rows at most
    table = places(plan_windows(counts, window), window)

    def run(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            size, rank = t["length"].to_numpy(), t["rank"].to_numpy()
            sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            order = np.argsort(size, kind="stable")
            values, first = np.unique(size[order], return_index=True)
            for v, i, j in zip(values.tolist(), first, [*first[1:], len(size)]):
                own = order[i:j]
                rows = table[v][np.searchsorted(table[v][:, 0], rank[own], "right") - 1]
                turn, place = np.divmod(rank[own] - rows[:, 0], rows[:, 1])
                sequence[own], offset[own] = rows[:, 2] + turn, rows[:, 3] + place * v
            t = t.drop_columns(["rank"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
            yield from t.to_batches()

    ranked = pieces.join(ahead, ["part", "length"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("ahead") + F.col("local")).alias("rank")
    )
    return ranked.mapInArrow(tidy(run), PACKED)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of at most 4096 tokens; see pack() for nulls, repeats and empty tables."""
    import public_tokenizers as P

    return pack(read_table(spark, sf_dir, "documents"), P.path(VOCABULARY))
