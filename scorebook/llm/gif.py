"""Media columns: animated GIF decoding to timed frames with colour histograms, and an encoder for 8-bit samples.

`decode` follows GIF89a: it unpacks variable-width LZW code streams, applies local or global palettes, transparency and
disposal, and yields each frame's rectangle and the composed canvas. `gif_frames` is the DataFrame form, one row per
frame. `encode_samples` stores bytes as palette samples of a true LZW GIF, a frame for at most FRAME_BYTES of them.

Null text or media: an empty payload, or no frames. Damaged media raise ValueError in `decode`; `gif_frames` gives such
a row one line with the error. Very long payloads become several frames, so working memory is that of one row.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from scorebook.llm.common import map_rows, table

#: Payloads are rows of WIDTH samples; a frame holds FRAME_ROWS of them at most. Pause between frames in 1/100 s.
WIDTH, FRAME_ROWS, DELAY = 64, 1024, 4
UNIT = WIDTH
#: Bins of a colour histogram: the two high bits of red, green and blue.
HISTOGRAM_BINS = 64
# Fixed values of the GIF89a format.
MAX_BITS, MAX_CODES = 12, 4096


# ---------------------------------------------------------------- LZW


@lru_cache(maxsize=8)
def _widths(min_size: int) -> tuple[np.ndarray, np.ndarray]:
    """Width of the j-th code after a clear code, and the bits before it, for j up to a full table and one more."""
    j = np.arange(MAX_CODES + 2)
    first = (1 << min_size) + 1
    widths = np.clip(np.floor(np.log2(np.maximum(1, j + first))).astype(np.int64) + 1, min_size + 1, MAX_BITS)
    return widths, np.concatenate(([0], np.cumsum(widths)[:-1]))


def lzw_codes(samples: bytes, min_size: int = 8) -> list[list[int]]:
    """Code segments of `samples`; each segment starts from a cleared table and ends before the table overflows."""
    clear = 1 << min_size
    segments, codes, table, free = [], [], {}, clear + 2
    get, add = table.get, codes.append
    rest = iter(samples)
    held = next(rest, -1)
    for b in rest:
        key = held << 8 | b
        code = get(key)
        if code is not None:
            held = code
            continue
        add(held)
        table[key] = free
        free += 1
        held = b
        if free == MAX_CODES:  # the decoder's table is full as well
            segments.append(codes)
            codes, table, free = [], {}, clear + 2
            get, add = table.get, codes.append
    if held >= 0:
        add(held)
    if codes:
        segments.append(codes)
    return segments


def lzw_pack(segments: list[list[int]], min_size: int = 8) -> bytes:
    """Bits of the segments, each after a clear code, then the end code."""
    clear = 1 << min_size
    widths, _ = _widths(min_size)
    values, sizes = [np.array([clear])], [np.array([min_size + 1])]
    for n, codes in enumerate(segments):
        last = n + 1 == len(segments)
        values.append(np.array([*codes, clear + 1 if last else clear]))
        sizes.append(widths[: len(codes) + 1])
    if not segments:
        values.append(np.array([clear + 1]))
        sizes.append(widths[:1])
    value, size = np.concatenate(values).astype("<u2"), np.concatenate(sizes)
    bits = np.unpackbits(value.view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    return np.packbits(bits[np.arange(16) < size[:, None]], bitorder="little").tobytes()


def lzw_decode(data: bytes, min_size: int) -> bytes:
    """Samples of one LZW code stream; accepts deferred clear codes and a missing end code."""
    clear, stop = 1 << min_size, (1 << min_size) + 1
    widths, before = _widths(min_size)
    raw = np.frombuffer(data + b"\0\0\0\0", dtype=np.uint8).astype(np.uint32)
    total, at = len(data) * 8, 0
    base = [bytes((i,)) for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    table, previous, index = base.copy(), None, 0  # index: codes since the last clear code
    while at < total:
        # one window of codes whose widths are known from their place after the clear code
        n = min(MAX_CODES + 2 - index, 4096) if index < MAX_CODES else 4096
        bits = widths[index : index + n] if index < MAX_CODES else np.full(n, MAX_BITS)
        offset = at + (before[index : index + n] - before[index] if index < MAX_CODES else np.arange(n) * MAX_BITS)
        fits = int(np.searchsorted(offset + bits, total, side="right"))
        if not fits:
            break
        offset, bits = offset[:fits], bits[:fits]
        i = offset >> 3
        word = raw[i] | raw[i + 1] << 8 | raw[i + 2] << 16
        codes = word >> (offset & 7).astype(np.uint32) & ((1 << bits) - 1).astype(np.uint32)
        special = np.flatnonzero((codes == clear) | (codes == stop))
        end = int(special[0]) if len(special) else fits
        fresh = codes[:end].tolist()
        if previous is None and fresh:
            if fresh[0] >= clear:
                raise ValueError("an LZW stream starts with a code that isn't in the table")
            previous = base[fresh.pop(0)]
            out.append(previous)
        size, grow, add = len(table), table.append, out.append
        for code in fresh:
            if code < size:
                entry = table[code]
            elif code == size < MAX_CODES:
                entry = previous + previous[:1]
            else:
                raise ValueError("an LZW code isn't in the table")
            if size < MAX_CODES:
                grow(previous + entry[:1])
                size += 1
            add(entry)
            previous = entry
        if end == fits:
            at, index = int(offset[-1] + bits[-1]), index + fits
        elif codes[end] == stop:
            break
        else:
            at, index, table, previous = int(offset[end] + bits[end]), 0, base.copy(), None
    return b"".join(out)


# ---------------------------------------------------------------- container


@dataclass
class Frame:
    """left, top, width, height: the frame's rectangle; indices: its palette samples; rgb: the composed canvas."""

    left: int
    top: int
    width: int
    height: int
    delay: int
    disposal: int
    transparent: int | None
    indices: np.ndarray
    pixels: np.ndarray
    rgb: np.ndarray


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    """Joined data sub-blocks from `at`, and where they end."""
    parts = []
    while at < len(data) and data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    if at >= len(data):
        raise ValueError("the GIF ends within a block")
    return b"".join(parts), at + 1


def _sub_blocks(data: bytes) -> bytes:
    """`data` cut into sub-blocks of at most 255 bytes, with the end marker."""
    full = len(data) // 255
    body = np.empty((full, 256), dtype=np.uint8)
    body[:, 0] = 255
    body[:, 1:] = np.frombuffer(data[: full * 255], dtype=np.uint8).reshape(full, 255)
    rest = data[full * 255 :]
    return body.tobytes() + (bytes((len(rest),)) + rest if rest else b"") + b"\0"


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    n = 2 << (flags & 7)
    if at + 3 * n > len(data):
        raise ValueError("the GIF ends within a palette")
    return np.frombuffer(data, dtype=np.uint8, count=3 * n, offset=at).reshape(n, 3), at + 3 * n


def decode(data: bytes) -> Iterator[Frame]:
    """Frames of a GIF in order."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("no GIF")
    wide, high, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, shared = 13, None
    if flags & 0x80:
        shared, at = _palette(data, at, flags)
    canvas = np.zeros((high, wide, 3), dtype=np.uint8)
    delay, disposal, transparent = 0, 0, None
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1] if at + 1 < len(data) else 0
            body, at = _blocks(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                control, delay, index = struct.unpack_from("<BHB", body)
                disposal, transparent = control >> 2 & 7, index if control & 1 else None
        elif data[at] == 0x2C and at + 10 < len(data):
            left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            own = shared
            if flags & 0x80:
                own, at = _palette(data, at, flags)
            if own is None:
                raise ValueError("a frame has no palette")
            min_size = data[at]
            if not 2 <= min_size <= 8:
                raise ValueError("an LZW code size is out of range")
            body, at = _blocks(data, at + 1)
            flat = np.frombuffer(lzw_decode(body, min_size)[: w * h].ljust(w * h, b"\0"), dtype=np.uint8)
            indices = flat.reshape(h, w)
            if flags & 0x40:  # interlaced: rows come in four passes
                order = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
                rows = np.empty_like(indices)
                rows[order] = indices
                indices = rows
            before = canvas.copy() if disposal == 3 else None
            pixels = own[np.minimum(indices, len(own) - 1)]
            part = canvas[top : top + h, left : left + w]
            shown = slice(None) if transparent is None else (indices != transparent)[: part.shape[0], : part.shape[1]]
            part[shown] = pixels[: part.shape[0], : part.shape[1]][shown]
            yield Frame(left, top, w, h, delay, disposal, transparent, indices, pixels, canvas)
            if disposal == 2:
                part[:] = 0
            elif disposal == 3:
                canvas = before
            delay, disposal, transparent = 0, 0, None
        else:
            raise ValueError("an unknown GIF block")


def histogram(rgb: np.ndarray) -> list[int]:
    """Counts of the pixels by the two high bits of each colour."""
    c = rgb.reshape(-1, 3) >> 6
    return np.bincount(c[:, 0] << 4 | c[:, 1] << 2 | c[:, 2], minlength=HISTOGRAM_BINS).tolist()


def pad(payload: bytes, unit: int = UNIT) -> bytes:
    """`payload` with bytes 0 up to a positive multiple of `unit`."""
    return payload + bytes(-len(payload) % unit if payload else unit)


def encode_samples(payload: bytes) -> bytes:
    """An animated GIF whose samples are `payload` (a multiple of WIDTH bytes), with a grey palette.

    Each frame replaces the top rows of the canvas; a frame's colours are its samples, so nothing is lost.
    """
    rows = len(payload) // WIDTH
    grey = bytes(np.repeat(np.arange(256, dtype=np.uint8), 3))
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, FRAME_ROWS), 0xF7, 0, 0), grey]
    for at in range(0, rows, FRAME_ROWS):
        part = payload[at * WIDTH : (at + FRAME_ROWS) * WIDTH]
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, DELAY, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0) + b"\x08")
        out.append(_sub_blocks(lzw_pack(lzw_codes(part))))
    return b"".join([*out, b"\x3b"])


# ---------------------------------------------------------------- DataFrame operators


def gif_frames(df: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """One row per frame of the GIFs in `media_col`: place, timing, disposal, samples and canvas histogram.

    Columns: id, frame, start_ms, duration_ms, left, top, width, height, disposal, transparent, samples (palette
    indices), histogram, error. Null media have no rows; damaged media end in a row with `error`.
    """

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, media in rows:
            start, n = 0, 0
            try:
                for f in decode(media) if media is not None else ():
                    yield key, n, start, f.delay * 10, f.left, f.top, f.width, f.height, f.disposal, f.transparent, f.indices.tobytes(), histogram(f.rgb), None
                    start, n = start + f.delay * 10, n + 1
            except ValueError as e:
                yield key, n, start, 0, 0, 0, 0, 0, 0, None, None, None, str(e)

    kind = df.schema[id_col].dataType.simpleString()
    names = "frame int, start_ms long, duration_ms long, left int, top int, width int, height int, disposal int, transparent int, samples binary, histogram array<long>, error string"
    return map_rows(df.select(id_col, media_col), run, f"id {kind}, {names}").withColumnRenamed("id", id_col)


def texts_to_gifs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's UTF-8 bytes, padded, as a GIF."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, text in rows:
            data = (text or "").encode("utf-8", "surrogatepass")
            yield key, len(data), encode_samples(pad(data))

    kind = df.schema[id_col].dataType.simpleString()
    return map_rows(df.select(id_col, text_col), run, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def gif_features(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digests of the samples read back from (id, n_bytes, media) and features of the frames."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, n_bytes, media in rows:
            sha, size, tail, bins, n, ms = hashlib.sha256(), 0, b"", np.zeros(HISTOGRAM_BINS, dtype=np.int64), 0, 0
            for f in decode(media):
                # the grey palette makes the shown colour the sample
                part = f.rgb[f.top : f.top + f.height, f.left : f.left + f.width, 0].tobytes()
                sha.update(part)
                size, tail, n, ms = size + len(part), part[-UNIT:], n + 1, ms + f.delay * 10
                bins += histogram(f.pixels)
            feature = f"frames={n};ms={ms};hist=" + ",".join(f"{i}:{c}" for i, c in enumerate(bins.tolist()) if c)
            yield key, n_bytes, size, sha.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), feature, n, ms

    kind = df.schema[id_col].dataType.simpleString()
    names = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, duration_ms long"
    return map_rows(df.select(id_col, "n_bytes", "media"), run, f"id {kind}, {names}").withColumnRenamed("id", id_col)


def op1_gif(spark, sf_dir: str) -> DataFrame:
    """Every document as a GIF, read back and digested."""
    return gif_features(texts_to_gifs(table(spark, sf_dir, "documents")))
