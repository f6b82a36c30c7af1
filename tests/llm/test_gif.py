import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scorebook.llm import gif


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000) | st.integers(1, 6).map(lambda n: b"abcab" * 4000 * n))
def test_lzw_round_trip(data):
    assert gif.lzw_decode(gif.lzw_pack(gif.lzw_codes(data)), 8) == data


def test_lzw_small_codes_and_random():
    rng = np.random.default_rng(1)
    for size in (2, 3, 4, 8):
        data = rng.integers(0, 1 << size, 30_000, dtype=np.uint8).tobytes()
        assert gif.lzw_decode(gif.lzw_pack(gif.lzw_codes(data, size), size), size) == data


def test_lzw_without_end_code_or_clear():
    data = b"to be or not to be or to be or not" * 10
    packed = gif.lzw_pack(gif.lzw_codes(data))
    assert gif.lzw_decode(packed[:-1], 8).startswith(data[:100])


def test_lzw_bad_code():
    bits = "".join(format(c, "09b")[::-1] for c in (256, 65, 300))
    raw = int(bits[::-1], 2).to_bytes(4, "little")
    with pytest.raises(ValueError):
        gif.lzw_decode(raw, 8)


def hand_made(frames):
    """A 2 x 2 GIF with a global palette of black, red, green, blue."""
    out = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0x81, 0, 0) + bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    for samples, left, top, w, h, disposal, transparent, flags in frames:
        control = disposal << 2 | (transparent is not None)
        out += b"\x21\xf9\x04" + struct.pack("<BHB", control, 7, transparent or 0) + b"\0"
        out += b"\x2c" + struct.pack("<HHHHB", left, top, w, h, flags) + b"\x02" + gif._sub_blocks(gif.lzw_pack(gif.lzw_codes(bytes(samples), 2), 2))
    return out + b"\x3b"


def test_transparency_and_disposal():
    red, green, blue, black = (255, 0, 0), (0, 255, 0), (0, 0, 255), (0, 0, 0)
    media = hand_made([
        ([1, 1, 1, 1], 0, 0, 2, 2, 1, None, 0),
        ([2, 3], 0, 0, 2, 1, 3, 3, 0),  # green, transparent; then back
        ([3], 1, 1, 1, 1, 2, None, 0),  # blue; then cleared
        ([2], 0, 1, 1, 1, 0, None, 0),
    ])
    seen = [[tuple(p) for p in f.rgb.reshape(-1, 3).tolist()] for f in (lambda: ((yield from ((setattr(f, "rgb", f.rgb.copy()), f)[1] for f in gif.decode(media)))))()]
    assert seen == [[red] * 4, [green, red, red, red], [red, red, red, blue], [red, red, green, black]]


def test_interlaced_rows():
    rows = [[i % 4] * 2 for i in range(2)]
    media = hand_made([([1, 1, 2, 2], 0, 0, 2, 2, 0, None, 0x40)])
    assert next(gif.decode(media)).indices.tolist() == [[1, 1], [2, 2]] and rows


def test_damaged():
    for bad in (b"", b"GIF89a", b"PNG", hand_made([([1, 1, 1, 1], 0, 0, 2, 2, 0, None, 0)])[:30]):
        with pytest.raises(ValueError):
            list(gif.decode(bad))


def test_frames_table(spark):
    good = hand_made([([1, 2, 3, 0], 0, 0, 2, 2, 1, None, 0)] * 2)
    df = spark.createDataFrame([(1, bytearray(good), "x"), (2, None, "x"), (3, bytearray(b"GIF89abad"), "x"), (None, bytearray(good), "x")], "id long, media binary, frame string")
    got = gif.gif_frames(df).orderBy("id", "frame").collect()
    assert [(r.id, r.frame, r.start_ms, r.error is None) for r in got] == [(None, 0, 0, True), (None, 1, 70, True), (1, 0, 0, True), (1, 1, 70, True), (3, 0, 0, False)]
    assert got[0].samples == bytes([1, 2, 3, 0]) and sum(got[0].histogram) == 4


def test_query_digests(docs):
    texts = ["", None, "a" * 64, "é" * 50, "x" * 200_001, "a" * 64]
    got = {r.doc_id: r for r in gif.gif_features(gif.texts_to_gifs(docs(texts))).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        full = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
    assert got[4].n_frames == 4 and got[2].media_sha256 == got[5].media_sha256


def test_empty(docs):
    assert gif.gif_features(gif.texts_to_gifs(docs([]))).count() == 0
