"""Media columns for GIF: encode and decode animated GIFs, and describe their frames.

The decoder unpacks LZW code streams (a whole run up to the next clear code at once, as code widths depend on the
position only), applies global and local palettes, interlacing, transparency and the disposal rules, and gives timed
frames with colour-histogram columns. The encoder stores bytes as 8-bit samples under a grey palette, 64 a row, in
frames of at most FRAME_ROWS rows, each shown for DELAY hundredths of a second.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.shared import over_cores
from .common import materialize, read_table, tidy, utf8_view

WIDTH = 64
FRAME_ROWS = 1024
DELAY = 10
CLEAR, STOP, FIRST = 256, 257, 258
#: Codes after a clear code until the table is full.
RUN = 4096 - FIRST
BINS = 16
#: Pixels of a screen or frame that is decoded (a canvas takes 4 bytes each); larger ones are rows with an error.
PIXELS = 1 << 24


def code_widths(least: int, n: int) -> np.ndarray:
    """Bits of each of the n codes that follow a clear code; least: the initial code size, of 2 to 8 bits."""
    size = np.minimum((1 << least) + 2 + np.maximum(np.arange(n) - 1, 0), 4095)
    return np.maximum(least + 1, np.floor(np.log2(size)).astype(np.int64) + 1)


_FULL = code_widths(8, RUN + 1)


def lzw_compress(data: bytes) -> bytes:
    """LZW of 8-bit samples; the table is cleared whenever it is full."""
    runs, run, table, code = [], [], {}, FIRST
    get, emit = table.get, run.append
    last = data[0]
    for c in data[1:]:
        key = last << 8 | c
        hit = get(key)
        if hit is not None:
            last = hit
            continue
        emit(last)
        last = c
        table[key] = code
        code += 1
        if code == 4096:
            runs.append(run)
            table, run, code = {}, [], FIRST
            get, emit = table.get, run.append
    emit(last)
    runs.append(run)
    codes, widths = [], []
    for run in runs:
        codes += [np.array([CLEAR]), np.array(run)]
        widths += [None, _FULL[: len(run)]]
    codes.append(np.array([STOP]))
    widths.append(None)
    fill = [np.array([9])]  # a clear code is as wide as the code that would stand there
    for k in range(1, len(runs)):
        fill.append(_FULL[len(runs[k - 1]) : len(runs[k - 1]) + 1])
    fill.append(code_widths(8, len(runs[-1]) + 1)[-1:])
    fill = iter(fill)
    codes = np.concatenate(codes).astype(np.uint16)
    widths = np.concatenate([next(fill) if w is None else w for w in widths])
    bits = (codes[:, None] >> np.arange(12, dtype=np.uint16)) & 1
    return np.packbits(bits[np.arange(12) < widths[:, None]].astype(np.uint8), bitorder="little").tobytes()


def lzw_expand(data: bytes, least: int, most: int | None = None) -> bytes:
    """The samples of a code stream; without its stop code, or with more than `most` samples, it is broken."""
    clear, held, done = 1 << least, 0, False
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    total, at, out = 8 * len(data), 0, []
    singles = [bytes([i]) for i in range(clear)] + [b"", b""]
    widths = _FULL if least == 8 else code_widths(least, RUN + 1)
    starts = np.concatenate([[0], np.cumsum(widths)])
    table, last = list(singles), None
    fresh = True
    while at + least < total and not done:
        if fresh:
            bit, size = at + starts[:-1], widths
        else:  # a full table is kept: all codes are as wide as can be
            size = np.full(4096, 12)
            bit = at + 12 * np.arange(4096)
        live = int(np.searchsorted(bit + size, total, "right"))
        if not live:
            break
        bit, size = bit[:live], size[:live]
        k = bit >> 3
        codes = (((raw[k] | raw[k + 1] << 8 | raw[k + 2] << 16) >> (bit & 7).astype(np.uint32)) & ((1 << size) - 1).astype(np.uint32)).astype(np.int64)
        special = np.flatnonzero((codes == clear) | (codes == clear + 1))
        n = int(special[0]) if len(special) else live
        for c in codes[:n].tolist():
            if last is None:
                piece = table[c]
            else:
                if c < len(table):
                    piece = table[c]
                elif c == len(table):
                    piece = last + last[:1]
                else:
                    raise ValueError("LZW code beyond the table")
                if len(table) < 4096:
                    table.append(last + piece[:1])
            out.append(piece)
            last = piece
            held += len(piece)
        if most is not None and held > most:
            raise ValueError("LZW stream of more samples than its frame has")
        at = int(bit[n - 1] + size[n - 1]) if n else at
        if len(special):
            at = int(bit[n] + size[n])
            if codes[n] == clear + 1:
                done = True
            table, last, fresh = list(singles), None, True
        else:
            fresh = False
    if not done:
        raise ValueError("LZW stream without its stop code")
    return b"".join(out)


def encode_payload(payload: bytes) -> bytes:
    """A GIF of the payload's bytes as samples; its length is a positive multiple of WIDTH."""
    rows = len(payload) // WIDTH
    palette = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, FRAME_ROWS), 0xF7, 0, 0), palette]
    for top in range(0, rows, FRAME_ROWS):
        part = payload[top * WIDTH : (top + FRAME_ROWS) * WIDTH]
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, DELAY, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0) + b"\x08")
        data = lzw_compress(part)
        whole = len(data) // 255 * 255
        blocks = np.empty((whole // 255, 256), np.uint8)
        blocks[:, 0] = 255
        blocks[:, 1:] = np.frombuffer(data, np.uint8, whole).reshape(-1, 255)
        out.append(blocks.tobytes())
        if len(data) > whole:
            out.append(bytes([len(data) - whole]) + data[whole:])
        out.append(b"\0")
    return b"".join([*out, b"\x3b"])


@dataclass
class Frame:
    left: int
    top: int
    indices: np.ndarray
    start_ms: int
    delay_ms: int
    disposal: int
    transparent: int
    palette: np.ndarray
    canvas: np.ndarray


def frames_of(data: bytes):
    """The screen's (width, height), then each frame; a frame's canvas is the RGBA screen as shown until the next is taken.

    A stream that ends too early or late for its frame, without its stop code, or with a code that can't stand there is an
    error, as are screens and frames of more than PIXELS. The canvas is painted as the format says: by the frame's palette, transparent samples left as they were, and
    between frames by the disposal of the one before (kept, cleared where it stood, or set back). One screen is held.
    """
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack("<HHBBB", data[6:13])
    if width * height > PIXELS:
        raise ValueError("a screen of more pixels than are decoded")
    yield width, height
    at, shared = 13, np.zeros((0, 3), np.uint8)

    def colours(at: int, flags: int):
        n = 2 << (flags & 7)
        return np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n

    def blocks(at: int):
        parts = []
        while data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        return b"".join(parts), at + 1

    if flags & 0x80:
        shared, at = colours(at, flags)
    canvas = np.zeros((height, width), np.uint32)  # one RGBA pixel an element
    clock, control = 0, (0, 0, -1)
    while data[at] != 0x3B:
        if data[at] == 0x21:
            body, end = blocks(at + 2)
            if data[at + 1] == 0xF9:
                kind, delay, index = struct.unpack("<BHB", body[:4])
                control = (kind >> 2 & 7, delay, index if kind & 1 else -1)
            at = end
            continue
        if data[at] != 0x2C:
            raise ValueError("unknown GIF block")
        left, top, w, h, flags = struct.unpack("<HHHHB", data[at + 1 : at + 10])
        at, palette = at + 10, shared
        if flags & 0x80:
            palette, at = colours(at, flags)
        least = data[at]
        if not 2 <= least <= 8:
            raise ValueError("LZW codes of an unknown size")
        if w * h > PIXELS:
            raise ValueError("a frame of more pixels than are decoded")
        body, at = blocks(at + 1)
        found = lzw_expand(body, least, w * h)
        if len(found) < w * h:
            raise ValueError("LZW stream of fewer samples than its frame has")
        samples = np.frombuffer(found, np.uint8).reshape(h, w)
        if flags & 0x40:
            order = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
            samples = samples[np.argsort(order)]
        disposal, delay, transparent = control
        y, x = min(height, top + h), min(width, left + w)
        part, inside = canvas[top:y, left:x], samples[: max(0, y - top), : max(0, x - left)]
        before = part.copy() if disposal == 3 else None
        colour = np.full((256, 4), 255, np.uint8)
        colour[:, :3] = 0  # samples beyond the palette are black
        colour[: len(palette), :3] = palette
        colour = colour.view(np.uint32).ravel()
        if transparent < 0:
            part[:] = colour[inside]
        else:
            np.copyto(part, colour[inside], where=inside != transparent)
        yield Frame(left, top, samples, clock, 10 * delay, disposal, transparent, palette, canvas.view(np.uint8).reshape(height, width, 4))
        if disposal == 2:
            part[:] = 0
        elif disposal == 3:
            part[:] = before
        clock, control = clock + 10 * delay, (0, 0, -1)


def decode(data: bytes) -> tuple[int, int, list[Frame]]:
    """(width, height, frames), each frame with a canvas of its own."""
    found = frames_of(data)
    width, height = next(found)
    return width, height, [replace(f, canvas=f.canvas.copy()) for f in found]


def histogram(frame: Frame) -> np.ndarray:
    """Pixels of the canvas by red, green and blue level, BINS each; transparent ones are left out."""
    opaque = frame.canvas.reshape(-1, 4)
    if not (opaque[:, 3] == 255).all():
        opaque = opaque[opaque[:, 3] > 0]
    level = opaque[:, :3] // (256 // BINS)
    if len(level) and (level[:, 0] == level[:, 1]).all() and (level[:, 0] == level[:, 2]).all():
        return np.tile(np.bincount(level[:, 0], minlength=BINS), (3, 1))
    return np.stack([np.bincount(level[:, c], minlength=BINS) for c in range(3)])


#: What a broken GIF raises.
BROKEN = (ValueError, IndexError, struct.error, MemoryError)
FRAME = "frame int, left int, top int, width int, height int, start_ms long, delay_ms long, disposal int, transparent int, red array<int>, green array<int>, blue array<int>"
_INTS = pa.list_(pa.int32())
_FRAME = pa.struct([("frame", pa.int32()), ("left", pa.int32()), ("top", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("start_ms", pa.int64()), ("delay_ms", pa.int64()), ("disposal", pa.int32()), ("transparent", pa.int32()), ("red", _INTS), ("green", _INTS), ("blue", _INTS)])


_NUMBERS = ["frame", "left", "top", "width", "height", "start_ms", "delay_ms", "disposal", "transparent"]


class Timed:
    """Timed frames, as columns."""

    def __init__(self):
        self.numbers, self.levels = [], []

    def add(self, n: int, f: Frame) -> None:
        h, w = f.indices.shape
        self.numbers.append((n, f.left, f.top, w, h, f.start_ms, f.delay_ms, f.disposal, f.transparent))
        self.levels.append(histogram(f))

    def cut(self, n: int) -> None:
        """Forget all but the first n."""
        del self.numbers[n:], self.levels[n:]

    def arrays(self) -> list[pa.Array]:
        n = len(self.numbers)
        numbers = np.array(self.numbers, np.int64).reshape(n, len(_NUMBERS))
        levels = np.array(self.levels, np.int32).reshape(n, 3, BINS)
        steps = pa.array(np.arange(n + 1, dtype=np.int32) * BINS)
        lists = [pa.ListArray.from_arrays(steps, pa.array(levels[:, c].ravel())) for c in range(3)]
        return [pa.array(numbers[:, k]).cast(_FRAME[k].type) for k in range(len(_NUMBERS))] + [x.cast(_INTS) for x in lists]


def frame_table(media: DataFrame, data: str = "media", key: str = "id") -> DataFrame:
    """(id, frame, .., histograms, error): one row per frame of each GIF.

    Null and empty media have none. A broken GIF has the frames before the break, then a row with the error only.
    """

    def run(batches):
        for batch in batches:
            timed, at, broken = Timed(), [], []
            for k, body in enumerate(batch.column(1)):
                body = body.as_py()
                try:
                    found = frames_of(body) if body else iter(())
                    next(found, None)
                    for n, f in enumerate(found):
                        timed.add(n, f)
                        at.append(k)
                except BROKEN as e:
                    broken.append((k, str(e) or type(e).__name__))
            ids = batch.column(0)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *timed.arrays(), pa.nulls(len(at), pa.string())], schema=schema)
            if broken:
                which, why = zip(*broken)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(which)), *(pa.nulls(len(which), f.type) for f in _FRAME), pa.array(why)], schema=schema)

    schema = pa.schema([("id", pa.int64()), *_FRAME, ("error", pa.string())])
    return media.select(F.col(key).cast("long"), data).mapInArrow(tidy(run), f"id long, {FRAME}, error string")


def samples_of(data: bytes, timed: Timed | None = None) -> bytes:
    """The bytes that the frames show, in red, where each stands on the canvas; the timed frames are added to `timed`."""
    found, parts = frames_of(data), []
    next(found)
    for n, f in enumerate(found):
        h, w = f.indices.shape
        parts.append(np.ascontiguousarray(f.canvas[f.top : f.top + h, f.left : f.left + w, 0]).tobytes())
        if timed is not None:
            timed.add(n, f)
    return b"".join(parts)


STORED = "doc_id long, n_bytes long, media binary"
READ = f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames array<struct<{FRAME.replace(' ', ':').replace(',:', ',')}>>, error string"


def store(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8, zero-filled to a positive multiple of 64, as a GIF.

    Null texts are empty. Rows are independent, so copies and repeated rows get equal media; very long texts become many
    frames of one GIF. An empty table gives an empty result.
    """

    def run(batches):
        for batch in batches:
            data, offsets = utf8_view(batch.column(1))
            keys, k = batch.column(0).cast(pa.int64()), 0
            while k < batch.num_rows:
                media, sizes, held, first = [], [], 0, k
                while k < batch.num_rows and held < 4 << 20:
                    body = data[offsets[k] : offsets[k + 1]].tobytes()
                    media.append(encode_payload(body.ljust(max(64, -(-len(body) // 64) * 64), b"\0")))
                    sizes.append(len(body))
                    held, k = held + len(media[-1]), k + 1
                yield pa.RecordBatch.from_arrays([keys.slice(first, k - first), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(key, text).mapInArrow(tidy(run), STORED)


def read_back(stored: DataFrame) -> DataFrame:
    """Per row of store(): digests of the stored bytes and of the payload that the canvas shows, and the timed frames.

    A null or broken GIF has null digests and an error; other rows, repeated ones too, don't suffer from it. An empty
    table gives an empty result.
    """
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("frames", pa.list_(_FRAME)), ("error", pa.string())]
    )

    def run(batches):
        for batch in batches:
            timed, ends, rows = Timed(), [0], []
            for n, media in zip(batch.column(1).to_pylist(), batch.column(2)):
                media, before = media.as_py(), len(timed.numbers)
                row = [None, None, None, None if media is None else len(media), None if media is None else hashlib.sha256(media).hexdigest(), "no media" if media is None else None]
                if media is not None:
                    try:
                        payload = samples_of(media, timed)
                        if n is not None and len(payload) < n:
                            raise ValueError("frames of fewer samples than were stored")
                        row[:3] = len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])
                    except BROKEN as e:
                        timed.cut(before)
                        row[5] = str(e) or type(e).__name__
                rows.append(row)
                ends.append(len(timed.numbers))
            if rows:
                size, sha, crc, length, stored_sha, error = zip(*rows)
                whole = pa.array([sha_ is None for sha_ in sha])
                frames = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(timed.arrays(), fields=list(_FRAME)), mask=whole)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(sha, pa.string()), pa.array(crc, pa.int64()), pa.array(length, pa.int64()), pa.array(stored_sha, pa.string()), frames.cast(schema.field("frames").type), pa.array(error, pa.string())],
                    schema=schema,
                )

    return stored.mapInArrow(tidy(run), READ)


def described(media: DataFrame) -> DataFrame:
    """read_back()'s table with `feature` for its frames: their number, their time in ms, and the sum of their red histograms."""
    last = F.element_at("frames", -1)
    counts = F.aggregate("frames", F.array_repeat(F.lit(0).cast("long"), BINS), lambda s, f: F.zip_with(s, f["red"], lambda a, b: a + b))
    feature = F.concat_ws(";", F.size("frames").cast("string"), (last["start_ms"] + last["delay_ms"]).cast("string"), F.array_join(F.transform(counts, lambda x: x.cast("string")), ","))
    return media.withColumn("feature", F.when(F.size("frames") > 0, feature)).drop("frames")


def op5_gif_media(spark, sf_dir: str) -> DataFrame:
    """Every whole text stored as a GIF; the table of its timed frames is written and the features come from that."""
    return described(materialize(read_back(materialize(store(over_cores(read_table(spark, sf_dir, "documents"))), "gif")), "frames"))
