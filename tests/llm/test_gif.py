import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evigrain.llm import gif_media as g


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=1, max_size=3000), st.integers(1, 12))
def test_lzw_round_trip(data, times):
    assert g.lzw_expand(g.lzw_compress(data * times), 8) == data * times


def test_full_tables_and_runs():
    rng = np.random.default_rng(1)
    for data in (rng.integers(0, 256, 60_000, dtype=np.uint8).tobytes(), b"ab" * 40_000, b"\0" * 70_000):
        for cut in (0, 1, 2, 3838, 3839, 3840):
            assert g.lzw_expand(g.lzw_compress(data[cut:]), 8) == data[cut:]


def test_payload_round_trip_over_frames():
    body = np.random.default_rng(2).integers(0, 256, 64 * 2500, dtype=np.uint8).tobytes()
    media = g.encode_payload(body)
    assert g.samples_of(media) == body
    w, h, frames = g.decode(media)
    assert (w, h, len(frames)) == (64, 1024, 3) and [f.start_ms for f in frames] == [0, 100, 200]


def pack(codes, width):
    bits = "".join(format(c, f"0{width}b")[::-1] for c in codes)
    return bytes(int(bits[i : i + 8].ljust(8, "0")[::-1], 2) for i in range(0, len(bits), 8))


def tiny(frames, flags=0):
    """A 2 by 2 GIF of four colours; a frame: left, top, w, h, disposal, transparent or -1, samples (at most 4)."""
    pal = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    out = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0x91, 0, 0) + pal
    for left, top, w, h, disposal, t, samples in frames:
        out += b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (t >= 0), 5, max(t, 0)) + b"\0"
        codes = [x for s in samples for x in (4, s)] + [5]
        data = pack(codes, 3)
        out += b"\x2c" + struct.pack("<HHHHB", left, top, w, h, flags) + b"\x02" + bytes([len(data)]) + data + b"\0"
    return out + b"\x3b"


def test_disposal_and_transparency():
    gif = tiny([(0, 0, 2, 2, 1, -1, [1, 1, 1, 1]), (0, 0, 1, 1, 2, -1, [2]), (1, 1, 1, 1, 3, -1, [3]), (0, 0, 2, 2, 0, 0, [0, 2, 0, 0])])
    _, _, f = g.decode(gif)
    red, green, blue, gone = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255], [0, 0, 0, 0]
    assert f[0].canvas.reshape(4, 4).tolist() == [red] * 4
    assert f[1].canvas.reshape(4, 4).tolist() == [green, red, red, red]
    assert f[2].canvas.reshape(4, 4).tolist() == [gone, red, red, blue]
    assert f[3].canvas.reshape(4, 4).tolist() == [gone, green, red, red]
    assert [x.start_ms for x in f] == [0, 50, 100, 150]


def test_interlaced_rows():
    _, _, f = g.decode(tiny([(0, 0, 1, 2, 0, -1, [1, 2])], flags=0x40))
    assert f[0].indices.ravel().tolist() == [1, 2]


def test_tables(spark):
    rows = [(1, None, 1), (2, "", 2), (3, "é" * 33, 3), (4, "x" * 70_000, 4), (5, "é" * 33, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, media int")
    media = g.read_back(g.store(df))
    got = {r.doc_id: r for r in media.collect()}
    for k, t, _ in rows:
        body = (t or "").encode()
        pad = body + b"\0" * (-len(body) % 64 or (64 if not body else 0))
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(body), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
    assert got[3][1:] == got[5][1:] and got[1][1:] == got[2][1:]
    assert all(r.error is None for r in got.values())
    frames = g.frame_table(g.store(df), key="doc_id").collect()
    assert sum(r.id == 4 for r in frames) == 2 and len(got[4].frames) == 2
    for r in frames:
        body = (rows[r.id - 1][1] or "").encode()
        shown = min(1024, -(-max(1, len(body)) // 64)) * 64
        assert sum(r.red) == sum(r.green) == sum(r.blue) == shown and r.error is None
    feature = {r.doc_id: r.feature for r in g.described(media).collect()}
    assert feature[4].startswith("2;200;") and sum(map(int, feature[4].split(";")[2].split(","))) == 2 * 1024 * 64
    assert feature[1] == "1;100;64," + ",".join(["0"] * 15)
    assert g.described(g.read_back(g.store(df.limit(0)))).count() == 0


def test_broken_media_are_rows(spark):
    body = np.random.default_rng(5).integers(0, 256, 64 * 1500, dtype=np.uint8).tobytes()
    good = g.encode_payload(body)
    loop = tiny([(0, 0, 2, 2, 1, -1, [1, 1, 1, 1]), (0, 0, 1, 1, 2, -1, [2]), (1, 1, 1, 1, 3, -1, [3]), (0, 0, 2, 2, 0, 0, [0, 2, 0, 0])])
    rows = [(1, 1, good), (2, 1, b"PNG"), (3, 1, good[:2000]), (4, 1, None), (5, 1, good[: len(good) // 2]), (6, 1, loop), (7, 1, b"GIF89a"), (6, 1, loop)]
    df = spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in g.described(g.read_back(df)).collect()}
    assert [k for k, r in sorted(got.items()) if r.error is None] == [1, 6] and got[2].error == "not a GIF" and got[4].error == "no media"
    assert got[1].payload_sha256 == hashlib.sha256(body).hexdigest() and got[3].payload_sha256 is None and got[3].feature is None
    table = [r for r in g.frame_table(df, key="doc_id").collect() if r.id == 6]
    assert [(r.frame, r.start_ms, r.delay_ms, r.disposal, r.transparent) for r in table[:4]] == [(0, 0, 50, 1, -1), (1, 50, 50, 2, -1), (2, 100, 50, 3, -1), (3, 150, 50, 0, 0)]
    at = lambda c: [(getattr(r, c)[0], getattr(r, c)[-1]) for r in table[:4]]
    assert at("red") == [(0, 4), (1, 3), (1, 2), (1, 2)] and at("green") == [(4, 0), (3, 1), (3, 0), (2, 1)] and at("blue") == [(4, 0), (4, 0), (2, 1), (3, 0)]
    with pytest.raises(Exception, match="not a GIF"):
        g.decode(b"PNG")


def without_blocks(media: bytes, drop: int) -> bytes:
    """A GIF of one frame without `drop` of its data blocks; the terminator stays."""
    at = media.index(b"\x2c", 13 + 768) + 11
    first = at
    for _ in range(drop):
        at += 1 + media[at]
    return media[:first] + media[at:]


def test_damaged_streams_and_huge_screens_are_errors(spark):
    body = np.random.default_rng(7).integers(0, 256, 64 * 160, dtype=np.uint8).tobytes()
    good = g.encode_payload(body)
    at = good.index(b"\x2c", 13 + 768) + 11
    cut = good[: at + 256 * 10] + good[at + 256 * 20 :]  # blocks from the midst
    stopped = good[: at + 256 * 5] + b"\0\x3b"  # the stream ends early, its block list well
    huge = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0, 0, 0) + b"\x3b"
    frame = good[: at - 11] + b"\x2c" + struct.pack("<HHHHB", 0, 0, 65535, 65535, 0) + good[at - 1 :]
    taller = good[: at - 11] + b"\x2c" + struct.pack("<HHHHB", 0, 0, 64, 161, 0) + good[at - 1 :]
    lower = good[: at - 11] + b"\x2c" + struct.pack("<HHHHB", 0, 0, 64, 159, 0) + good[at - 1 :]
    rows = [good, without_blocks(good, 5), cut, stopped, huge, frame, taller, lower, good]
    df = spark.createDataFrame([(k, len(body), m) for k, m in enumerate(rows)], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in g.described(g.read_back(df)).collect()}
    assert [k for k, r in sorted(got.items()) if r.error is None] == [0, 8] and got[0][1:] == got[8][1:]
    assert all(r.payload_sha256 is None and r.feature is None and r.media_bytes for r in got.values() if r.error)
    assert "stop code" in got[3].error and "screen" in got[4].error and "frame" in got[5].error and "fewer" in got[6].error and "more" in got[7].error
    # fewer frames than the payload needs
    two = g.encode_payload(bytes(64 * 1500))
    second = two.rindex(b"\x21\xf9")
    short = spark.createDataFrame([(1, 64 * 1500, two[:second] + b"\x3b")], "doc_id long, n_bytes long, media binary")
    assert "fewer" in g.read_back(short).first().error and g.read_back(short.selectExpr("doc_id", "cast(null as long) n_bytes", "media")).first().payload_bytes == 64 * 1024
    errors = [r for r in g.frame_table(df, key="doc_id").collect() if r.error]
    assert {r.id for r in errors} == {1, 2, 3, 4, 5, 6, 7}


def test_flipped_bits_lose_no_row(spark):
    body = np.random.default_rng(8).integers(0, 256, 64 * 40, dtype=np.uint8).tobytes()
    good, rng, rows = g.encode_payload(body), np.random.default_rng(9), []
    for k in range(60):
        bad = bytearray(good)
        bad[int(rng.integers(13 + 768, len(good)))] ^= 1 << int(rng.integers(8))
        rows.append((k, len(body), bytes(bad)))
    got = g.read_back(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()
    # GIF has no checksum: a flip may give other samples, but never fewer or invented ones
    assert len(got) == 60 and all(r.error or r.payload_bytes == len(body) for r in got)
    assert sum(r.error is not None for r in got) > 5
