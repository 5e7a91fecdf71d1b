"""Shared pieces of the training-data operators: storage, keyed joins under skew, hashing, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key is hot when it has this share of all rows or more; so there are at most 1 / HOT_SHARE hot keys, whatever the input.
HOT_SHARE = 1 / 500


#: Rows and bytes of an Arrow batch: texts are long, and executors small. A single longer text is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder. Spark reads the batches' bounds when a plan runs, so they can only be set for the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    Where that is unset and the master is local (tests), a new folder; on a cluster executors would write to disks of
    their own, and results would lack rows, so there it is an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="evigrain-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


#: Folders that materialize() has made and discard() has not removed, for clear().
_made: list[str] = []


def materialize(df: DataFrame, tag: str, codec: str = "snappy") -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors, and costs one pass."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/evigrain-{tag}-{uuid.uuid4().hex}"
    _made.append(path)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._evigrain_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a table made by materialize() that nothing will read again."""
    path = getattr(df, "_evigrain_path", None)
    if path:
        _remove(df.sparkSession, path)


def clear(spark: SparkSession) -> int:
    """Remove all tables that this process has made and not removed yet, once no result is read any more; their number."""
    n = len(_made)
    for path in list(_made):
        _remove(spark, path)
    return n


def _remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    with contextlib.suppress(ValueError):
        _made.remove(path)


def size_of(df: DataFrame) -> int:
    """Bytes on disk of a table made by materialize(), 0 for others."""
    spark = df.sparkSession
    if not hasattr(df, "_evigrain_path"):
        return 0
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._evigrain_path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def labelled_sample(docs: DataFrame, known: DataFrame, rows: int, size: int, text: str, key: str) -> DataFrame:
    """(key, y, t): whole texts of labelled rows to fit on, in the order of a hash of their id.

    known: (key, y), one row an id. Of each class at most `rows` rows with at most `size` bytes of text together, without
    texts of more than size / 16 bytes; equal rows count once. So neither long texts nor repeated ids have no bound.
    """
    order = F.xxhash64(key), F.col(key)
    chosen = [known.where(F.col("y") == y).orderBy(*order).limit(rows) for y in (0, 1)]
    some = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("t")).where(F.octet_length("t") <= size // 16)
    some = some.join(F.broadcast(chosen[0].unionByName(chosen[1])), key).select(key, "y", "t").distinct()
    w = Window.partitionBy("y").orderBy(*order, "t")
    first = some.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= rows)
    so_far = F.sum(F.octet_length("t")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return first.withColumn("_b", so_far).where(F.col("_b") <= size).select(key, "y", "t")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def attach_by_key(rows: DataFrame, stats: DataFrame, key: str, count: str) -> DataFrame:
    """Inner join of rows with one stats row per key, safe for hot keys.

    stats[count] is the number of rows with that key. Keys with HOT_SHARE of all rows or more, at most
    1 / HOT_SHARE of them, are broadcast and their rows never move; all other keys are joined by a shuffle,
    in which no key has more than HOT_SHARE of the rows.
    """
    total = stats.agg(F.sum(count)).first()[0] or 0
    hot = F.broadcast(stats.where((F.col(count) >= total * HOT_SHARE) & (F.col(count) > 1)))
    cold = stats.where(~((F.col(count) >= total * HOT_SHARE) & (F.col(count) > 1)))
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


#: Bits of an id filter: 4 Mi, so half a megabyte is shipped, whatever the number of ids.
FILTER_BITS = 1 << 22


def id_filter(ids: DataFrame) -> np.ndarray:
    """Bits of the ids (the one long column of `ids`) modulo FILTER_BITS; at most FILTER_BITS / 32 rows reach the driver."""
    at = ids.select(F.pmod(F.col(ids.columns[0]), F.lit(FILTER_BITS)).cast("int").alias("at"))
    words = at.select(F.shiftright("at", 5).alias("w"), F.expr("shiftleft(1L, at & 31)").alias("b"))
    got = words.where("w is not null").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    out[got["w"].to_numpy()] = got["b"].to_numpy().astype(np.uint32)
    return np.unpackbits(out.view(np.uint8), bitorder="little")


def may_hold(ids: pa.Array, bits: np.ndarray) -> np.ndarray:
    """Which ids may be among those of an id filter; null ids can't."""
    ids = ids.cast(pa.int64())
    return bits[ids.fill_null(0).to_numpy(zero_copy_only=False) & (FILTER_BITS - 1)] & ids.is_valid().to_numpy(zero_copy_only=False)


def split_by_filter(rows: DataFrame, key: str, bits: np.ndarray, inside: bool) -> DataFrame:
    """The rows whose id may be (inside) or can't be among those of an id filter; null ids can't. No shuffle."""
    packed, at = np.packbits(bits), rows.columns.index(key)

    def run(batches):
        bits = np.unpackbits(packed).astype(bool)
        for batch in batches:
            hit = may_hold(batch.column(at), bits)
            yield batch.filter(pa.array(hit if inside else ~hit))

    return rows.mapInArrow(tidy(run), rows.schema)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def trim() -> None:
    """Give this process's unused memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run):
    """run, giving unused memory back to the system when a task ends: workers live on, and executors are small."""

    def outer(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return outer


def runs_of(batches, keys: int):
    """Tables of consecutive rows that agree in their first `keys` columns, from batches sorted by them."""
    held, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for c in range(keys):
            v = batch.column(c).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        cuts = [*np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(batch.column(c)[a].as_py() for c in range(keys))
            if key != now and held:
                yield pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


# --- components -----------------------------------------------------------------------------------------


def connected_components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """(id, component) for every node of edges (a, b: long); component is the smallest id that is reachable.

    Alternating large-star and small-star steps (Kiveris et al., 2014); each step is written to the shared folder,
    so that neither lineage nor driver memory grows. Null ends and self-loops: the self-loop keeps its node.
    """
    edges = edges.select("a", "b").where("a is not null and b is not null")
    nodes = edges.select(F.col("a").alias("id")).union(edges.select("b"))
    cur = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), tag
    )
    seal = None
    while True:
        both = cur.select("u", "v").union(cur.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        # a row for each edge at most, so repeated ones wait for the distinct of the small-star step
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        )
        nxt = materialize(small.select("e.u", "e.v").where("u <> v").distinct(), tag)
        now = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        discard(cur)
        cur = nxt
        if tuple(now) == seal:
            break
        seal = tuple(now)
    labels = cur.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    return nodes.distinct().join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


# --- hashing of words -----------------------------------------------------------------------------------

_M = np.uint64(0x9E3779B97F4A7C15)
_MINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64, endpoint=False)
_STEP = np.random.default_rng(7).integers(0, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {"m": np.ones(1, np.uint64), "inv": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        base = np.full(max(n, 1 << 20), _M if kind == "m" else _MINV, np.uint64)
        base[0] = 1
        _powers[kind] = np.cumprod(base, dtype=np.uint64)
    return _powers[kind]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8_view(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of n + 1) of a string or binary array; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 1 << 20):
    """(first, last) of runs of texts with about `most` bytes together; a longer text is a run of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = b


def word_hashes(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of each text, and the offsets of each text's words."""
    if len(data) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = ~space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | edge[1:-1]
    stop = word.copy()
    stop[:-1] &= ~word[1:] | edge[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * _power("m", len(data))[: len(data)], dtype=np.uint64, out=total[1:])
    h = mix((total[e] - total[s]) * _power("inv", len(data))[s] + (e - s).astype(np.uint64))
    return h, np.searchsorted(s, offsets).astype(np.int64)


def shingle_sets(col: pa.Array, size: int = 5):
    """Sorted distinct 64-bit hashes of each text's word shingles; of the whole sequence where words are fewer."""
    data, offsets = utf8_view(col)
    for a, b in slices(offsets):
        part = offsets[a : b + 1]
        h, at = word_hashes(data[part[0] : part[-1]], part - part[0])
        n = max(0, len(h) - size + 1)
        rolled = np.zeros(n, np.uint64)
        for k in range(size):
            rolled += h[k : k + n] * _STEP[k]
        rolled = mix(rolled)
        for i in range(b - a):
            x, y = at[i], at[i + 1]
            if y - x >= size:
                yield np.unique(rolled[x : y - size + 1])
            elif y > x:
                yield mix((h[x:y] * _STEP[: y - x]).sum(keepdims=True, dtype=np.uint64) + np.uint64(y - x))
            else:
                yield np.zeros(0, np.uint64)
