"""Media columns (operator 9): GIF files to timed frames with colour histograms.

``decode`` reads any GIF87a/89a: it walks the blocks, unpacks each frame's LZW code stream, undoes
interlacing, applies the local or global palette and the transparent index, and composes frames on
the canvas under the disposal rules. ``frames`` turns a column of files into one row per frame.
``encode`` writes a payload as 8-bit samples of a grey palette, losslessly, as LZW-packed frames.

Defined cases: a null file gives no frame; a file that is cut off or broken gives the frames before
the break and a non-null ``error``; an empty payload is padded to one row of spaces; equal payloads
give equal files.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, schema, table

WIDTH = 192
#: Rows of one frame; longer payloads become more frames.
ROWS = 1024
DELAY_CS = 4
BINS = 8
#: A file whose header asks for a larger canvas or frame is an error, before any of it is allocated.
MAX_PIXELS = 1 << 26
#: 256 grey levels, so that a sample is its own colour.
GREY = bytes(v for i in range(256) for v in (i, i, i))


@dataclass
class Frame:
    index: int
    start_ms: int
    delay_ms: int
    left: int
    top: int
    width: int
    height: int
    disposal: int
    indices: np.ndarray  # palette indices of the frame's own rectangle
    canvas: np.ndarray  # composed RGBA, height x width x 4


# ---------------------------------------------------------------- LZW


@lru_cache(maxsize=16)
def _widths(min_bits: int, n: int) -> np.ndarray:
    """Bits of each of the first ``n`` codes after a clear: the table gains an entry with each code but the first."""
    size = (1 << min_bits) + 2 + np.maximum(np.arange(n), 1) - 1
    return np.minimum(np.floor(np.log2(size)).astype(np.int64) + 1, 12).clip(min_bits + 1)


def unpack_codes(data: np.ndarray, min_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """All codes of a stream, without clear and end codes, and where in them each table starts.

    Code widths depend only on the count of codes since the last clear, so a whole run of
    codes is cut out of the bits at once; a clear code found in it ends the run.
    """
    clear, end = 1 << min_bits, (1 << min_bits) + 1
    bits, total = 0, 8 * len(data)
    wide = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.uint32)
    ahead, step = _widths(min_bits, 8192), 8192
    offsets = np.concatenate([[0], np.cumsum(ahead)])
    codes, starts, have = [], [], 0
    guess = 512
    while bits < total:
        n = guess
        parts, base, done = [], 0, False
        starts.append(have)
        while True:
            if base + n > step:  # a table that is never cleared stays at its widest
                at = bits + offsets[step] + 12 * (np.arange(base, base + n) - step) if base >= step else None
                if at is None:
                    n = step - base
                    at = bits + offsets[base : base + n]
                    w = ahead[base : base + n]
                else:
                    w = np.full(n, 12)
            else:
                at, w = bits + offsets[base : base + n], ahead[base : base + n]
            fits = int(np.searchsorted(at + w, total, side="right"))
            at, w = at[:fits], w[:fits]
            byte = at >> 3
            got = (wide[byte] | wide[byte + 1] << 8 | wide[byte + 2] << 16) >> (at & 7).astype(np.uint32) & ((1 << w.astype(np.uint32)) - 1)
            stop = np.flatnonzero((got == clear) | (got == end))
            if len(stop):
                k = int(stop[0])
                parts.append(got[:k])
                bits, done = int(at[k] + w[k]), got[k] == end
                guess = max(base + k + 8, 64)
                break
            parts.append(got)
            if fits < n:
                bits, done = total, True
                break
            base, n = base + n, min(2 * n, 1 << 16)
        run = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        codes.append(run)
        have += len(run)
        if done:
            break
    return (np.concatenate(codes) if codes else np.zeros(0, np.uint32)).astype(np.int64), np.array(starts, np.int64)


def lzw_decode(data: np.ndarray, min_bits: int, size: int) -> np.ndarray:
    """Samples of an LZW stream.

    A code above the literals repeats the string of an earlier code plus one sample, so it is a
    copy of output at a known place. Lengths follow the chain of codes by pointer doubling, then
    every sample's source is followed to a literal, also by doubling: a few passes of array
    operations in place of a loop over codes.
    """
    codes, starts = unpack_codes(data, min_bits)
    n = len(codes)
    if not n:
        return np.zeros(0, np.uint8)
    table_of = np.zeros(n, np.int64)
    table_of[starts[(starts > 0) & (starts < n)]] = 1
    base = starts[starts < n]
    base = np.maximum.accumulate(np.where(table_of > 0, np.arange(n), base[0]))
    first = (1 << min_bits) + 2
    literal = codes < first
    owner = np.where(literal, np.arange(n), base + codes - first)  # the code whose string, with one more sample, is meant
    bad = np.flatnonzero(owner >= np.where(literal, n, np.arange(n)))
    if len(bad):
        raise ValueError("a code names an entry that does not exist yet")
    jump = owner.copy()
    extra = np.where(literal, 0, 1)
    while True:  # extra counts the steps to a literal
        more = extra[jump]
        if not more.any():
            break
        extra, jump = extra + more, jump[jump]
    length = 1 + extra
    off = np.concatenate([[0], np.cumsum(length)])
    if off[-1] > size:  # a stream may hold far more than its frame; what follows is not made
        n = int(np.searchsorted(off[1:], size)) + 1
        codes, literal, owner, length, off = codes[:n], literal[:n], owner[:n], length[:n], off[: n + 1]
    total = int(off[-1])
    if literal.all():
        return codes.astype(np.uint8)[:size]
    shift = np.where(literal, 0, off[:-1] - off[owner])
    src = np.arange(total, dtype=np.int32 if total < 1 << 31 else np.int64)
    src -= np.repeat(shift, length).astype(src.dtype)
    lit = np.zeros(total, np.uint8)
    lit[off[:-1][literal]] = codes[literal]
    todo = np.flatnonzero(src != np.arange(total, dtype=src.dtype))
    while len(todo):
        to = src[src[todo]]
        moved = to != src[todo]
        src[todo] = to
        todo = todo[moved]
    return lit[src][:size]


#: At place prefix << 8 | sample, the longer string's code << 8; all zero between uses.
_TRIE: list[int] = []


def lzw_encode(data: bytes) -> bytes:
    """The code stream of 8-bit samples, packed, in sub-blocks. Greedy longest match; a full table is cleared."""
    if not _TRIE:
        _TRIE.extend([0] * (4096 << 8))
    trie, used, codes, clears = _TRIE, [], [256], [0]
    add, keep = codes.append, used.append
    nxt, top = 258 << 8, 4095 << 8
    w = data[0] << 8
    for c in memoryview(data)[1:]:
        if v := trie[k := w | c]:
            w = v
            continue
        add(w >> 8)
        w = c << 8
        if nxt != top:
            trie[k] = nxt
            keep(k)
            nxt += 256
        else:
            clears.append(len(codes))
            add(256)
            for x in used:
                trie[x] = 0
            used.clear()
            nxt = 258 << 8
    for x in used:
        trie[x] = 0
    add(w >> 8)
    add(257)
    return _pack(np.array(codes, np.int64), clears)


def _pack(codes: np.ndarray, clears: list[int]) -> bytes:
    """Codes to bits; ``clears`` are the places of clear codes, the first at 0."""
    n = len(codes)
    base = np.zeros(n, np.int64)
    base[clears] = clears
    base = np.maximum.accumulate(base)
    since = np.arange(n) - base - 1  # codes since the clear; -1 for the clear code itself
    by_count = _widths(8, 4200)
    before = np.full(n, 9)
    inner = since >= 0
    before[inner] = by_count[since[inner]]
    for c in clears[1:]:  # a clear code is as wide as the next code of the old table
        before[c] = by_count[since[c - 1] + 1]
    at = np.concatenate([[0], np.cumsum(before)])
    out = np.zeros((int(at[-1]) + 7) // 8 + 4, np.uint32)
    byte, wide = at[:-1] >> 3, codes.astype(np.uint32) << (at[:-1] & 7).astype(np.uint32)
    for i in range(3):
        out += np.bincount(byte + i, weights=(wide >> np.uint32(8 * i)) & 255, minlength=len(out)).astype(np.uint32)
    raw = out[: (int(at[-1]) + 7) // 8].astype(np.uint8).tobytes()
    return b"".join(bytes([len(x)]) + x for i in range(0, len(raw), 255) if (x := raw[i : i + 255])) + b"\0"


# ---------------------------------------------------------------- files


def encode(payload: bytes) -> bytes:
    """A GIF89a whose frames, one below ``ROWS`` rows each, hold ``payload`` row by row as grey samples."""
    if not payload or len(payload) % WIDTH:
        raise ValueError("payload must be a positive multiple of the width")
    rows = len(payload) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, ROWS), 0xF7, 0, 0), GREY]
    for at in range(0, rows, ROWS):
        h = min(ROWS, rows - at)
        out += [b"\x21\xf9\x04", struct.pack("<BHBB", 2 << 2, DELAY_CS, 0, 0), b"\x2c", struct.pack("<HHHHB", 0, 0, WIDTH, h, 0), b"\x08", lzw_encode(payload[at * WIDTH : (at + h) * WIDTH])]
    return b"".join([*out, b"\x3b"])


def decode(data: bytes):
    """Yield the ``Frame``s of a file in order. A broken file raises after the frames before the break."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF file")
    buf = np.frombuffer(data, np.uint8)
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, shared = 13, None
    if flags & 0x80:
        n = 3 << (flags & 7) + 1
        shared, at = buf[at : at + n].reshape(-1, 3), at + n
    if width * height > MAX_PIXELS:
        raise ValueError("the canvas is too large")
    canvas = np.zeros((height, width, 4), np.uint8)
    disposal = delay = clock = index = 0
    clear_index = None

    def blocks(at: int) -> tuple[np.ndarray, int]:
        parts = []
        while True:
            if at >= len(data):
                raise ValueError("the file is cut off")
            n = data[at]
            if not n:
                return (np.concatenate(parts) if parts else buf[:0]), at + 1
            parts.append(buf[at + 1 : at + 1 + n])
            at += 1 + n

    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            kind = data[at + 1]
            body, at = blocks(at + 2)
            if kind == 0xF9 and len(body) >= 4:
                disposal, delay = int(body[0]) >> 2 & 7, 10 * (int(body[1]) | int(body[2]) << 8)
                clear_index = int(body[3]) if body[0] & 1 else None
            continue
        if data[at] != 0x2C:
            raise ValueError("unknown block")
        if at + 11 > len(data):
            raise ValueError("the file is cut off")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        colours = shared
        if flags & 0x80:
            n = 3 << (flags & 7) + 1
            colours, at = buf[at : at + n].reshape(-1, 3), at + n
        if colours is None:
            raise ValueError("a frame without a palette")
        min_bits = data[at]
        if not 2 <= min_bits <= 8:
            raise ValueError("bad code size")
        if w * h > MAX_PIXELS:
            raise ValueError("a frame is too large")
        stream, at = blocks(at + 1)
        samples = lzw_decode(stream, min_bits, w * h)
        if len(samples) < w * h:
            raise ValueError("a frame has too few samples")
        pixels = samples.reshape(h, w)
        if flags & 0x40:
            rows = np.concatenate([np.arange(s, h, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
            plain = np.empty_like(pixels)
            plain[rows] = pixels
            pixels = plain
        before = canvas.copy() if disposal == 3 else None
        hh, ww = max(0, min(h, height - top)), max(0, min(w, width - left))
        area = canvas[top : top + hh, left : left + ww]
        if len(colours) < 256:
            colours = np.concatenate([colours, np.zeros((256 - len(colours), 3), np.uint8)])
        rgba = np.concatenate([colours, np.full((256, 1), 255, np.uint8)], axis=1)
        seen = pixels[:hh, :ww]
        if clear_index is None:
            area[:] = rgba[seen]
        else:
            drawn = seen != clear_index
            area[drawn] = rgba[seen[drawn]]
        yield Frame(index, clock, delay, left, top, w, h, disposal, pixels, canvas.copy())
        if disposal == 2:
            area[:] = 0
        elif disposal == 3:
            canvas = before
        index, clock = index + 1, clock + delay
        disposal = delay = 0
        clear_index = None
    if at >= len(data):
        raise ValueError("the file is cut off")


def histogram(rgba: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Counts of opaque pixels by channel and equal-width bin: 3 x ``bins``."""
    seen = rgba.reshape(-1, 4)
    seen = seen if seen[:, 3].all() else seen[seen[:, 3] > 0]
    return np.stack([np.bincount(seen[:, c], minlength=256).reshape(bins, -1).sum(axis=1) for c in range(3)])


FRAME_SCHEMA = "frame int, start_ms long, delay_ms long, left int, top int, width int, height int, disposal int, rgba binary, hist_red array<long>, hist_green array<long>, hist_blue array<long>, error string"


def frames(df: DataFrame, *, id_col: str, gif_col: str) -> DataFrame:
    """One row per frame of the files in ``gif_col``: composed pixels, times and colour histograms. No shuffle."""
    import pyarrow as pa

    from .common import T, arrow_type

    out = T.StructType([df.schema[id_col], *schema(FRAME_SCHEMA).fields])
    arrow = pa.schema([(f.name, arrow_type(f.dataType)) for f in out.fields])

    def batch(row):
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, arrow.types, strict=True)], schema=arrow)

    def run(batches):
        for b in batches:
            for key, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                made = 0
                try:
                    for f in decode(data) if data is not None else ():
                        h = histogram(f.canvas).tolist()
                        yield batch((key, f.index, f.start_ms, f.delay_ms, f.left, f.top, f.width, f.height, f.disposal, f.canvas.tobytes(), *h, None))
                        made += 1
                except (ValueError, IndexError, struct.error) as e:
                    yield batch((key, made, *[None] * 11, str(e)))

    return df.select(id_col, gif_col).mapInArrow(run, out)


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 of the text, padded with spaces to a positive multiple of ``WIDTH``; its unpadded length."""
    raw = (text or "").encode()
    return raw + b" " * ((-len(raw)) % WIDTH or (0 if raw else WIDTH)), len(raw)


def store(text: str | None) -> tuple:
    """Encode a text as a GIF, read the bytes back, and digest what came back."""
    payload, n = payload_of(text)
    media = encode(payload)
    back, hist, seen, clock = [], np.zeros((3, BINS), np.int64), 0, 0
    for f in decode(media):
        own = f.canvas[: f.height, : f.width]
        back.append(own[:, :, 0].tobytes())  # of a grey colour, the red channel is the sample
        hist += histogram(own)
        seen, clock = seen + 1, clock + f.delay_ms
    got = b"".join(back)
    feature = f"frames={seen};ms={clock};hist=" + ",".join(map(str, hist[0]))
    return n, len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature


def op9_gif_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make():
        def run(texts):
            once = {t: store(t) for t in set(texts)}
            rows = [once[t] for t in texts]
            return list(zip(*rows, strict=True)) if rows else [[]] * 7

        return run

    return map_texts(table(spark, sf_dir, "documents"), ["doc_id"], "text", schema("n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"), make)
