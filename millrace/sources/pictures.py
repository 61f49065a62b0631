"""Picture files to pixels: PNG (8 bits, not interlaced) and binary PPM or PGM, without other libraries; anything else is an error."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np

from millrace.plans.registry import pieces, small_batches

CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def unfiltered(raw: bytes, h: int, w: int, c: int) -> np.ndarray:
    """Undoes the row filters of a PNG."""
    line = w * c + 1
    if len(raw) >= h * line:
        rows = np.frombuffer(raw, np.uint8, h * line).reshape(h, line)
        if not rows[:, 0].any():
            return np.ascontiguousarray(rows[:, 1:]).reshape(h, w, c)
    out = np.zeros((h, w * c), np.uint8)
    above = np.zeros(w * c, np.int64)
    for y in range(h):
        kind, row = raw[y * line], np.frombuffer(raw, np.uint8, w * c, y * line + 1).astype(np.int64)
        if kind == 1:
            row = np.cumsum(row.reshape(w, c), axis=0).ravel() % 256
        elif kind == 2:
            row = (row + above) % 256
        elif kind in (3, 4):
            for x in range(w * c):
                a, b, d = int(row[x - c]) if x >= c else 0, int(above[x]), int(above[x - c]) if x >= c else 0
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - d
                    guess = min((a, b, d), key=lambda v: abs(p - v))
                row[x] = (row[x] + guess) % 256
        elif kind:
            raise ValueError(f"row filter {kind}")
        out[y] = above = row
    return out.reshape(h, w, c)


def decoded(data: bytes | None) -> np.ndarray:
    """Height x width x channels, blue first where there are colours."""
    if data and data.startswith(b"\x89PNG\r\n\x1a\n"):
        at, body, head = 8, [], None
        while at + 8 <= len(data):
            n, kind = struct.unpack(">I4s", data[at : at + 8])
            part = data[at + 8 : at + 8 + n]
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", part)
            elif kind == b"IDAT":
                body.append(part)
            at += 12 + n
        if head is None or head[2] != 8 or head[3] not in CHANNELS or head[6]:
            raise ValueError("a kind of PNG that is not read")
        w, h, c = head[0], head[1], CHANNELS[head[3]]
        try:
            x = unfiltered(zlib.decompress(b"".join(body)), h, w, c)
        except (zlib.error, IndexError) as e:
            raise ValueError(f"broken PNG: {e}") from e
        return x[:, :, [2, 1, 0, *range(3, c)]] if c >= 3 else x
    m = re.match(rb"P([56])\s+(\d+)\s+(\d+)\s+255\s", data or b"")
    if m:
        w, h, c = int(m[2]), int(m[3]), 3 if m[1] == b"6" else 1
        if len(data) - m.end() < w * h * c:
            raise ValueError("broken picture")
        return np.frombuffer(data, np.uint8, w * h * c, m.end()).reshape(h, w, c)[:, :, ::-1]
    raise ValueError("not a picture that is read")


def encoded(x: np.ndarray) -> bytes:
    """A PNG of one or three channels."""
    h, w, c = x.shape

    def part(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    lines = np.zeros((h, w * c + 1), np.uint8)
    lines[:, 1:] = (x[:, :, ::-1] if c == 3 else x).reshape(h, w * c)
    rows = lines.tobytes()
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if c == 3 else 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def decode_table(images, key: str = "path", content: str = "image"):
    """key, height, width, channels, pixels of the images' bytes, and the error of those that cannot be read."""
    small_batches(images.sparkSession)
    src = images.select(key, content)

    def run(batches):
        import pyarrow as pa

        for b in pieces(batches):
            out = []
            for data in b.column(content).to_pylist():
                try:
                    x = decoded(data)
                    out.append((*x.shape, np.ascontiguousarray(x).tobytes(), None))
                except ValueError as e:
                    out.append((None, None, None, None, str(e)))
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string())
            cols = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(key), *cols], [key, "height", "width", "channels", "pixels", "error"])

    return src.mapInArrow(run, f"`{key}` {src.schema[key].dataType.simpleString()}, height int, width int, channels int, pixels binary, error string")


def encode_table(images, key: str = "path"):
    """key and image, the PNG of each picture; null where there is none."""
    small_batches(images.sparkSession)
    src = images.select(key, "height", "width", "channels", "pixels")

    def run(batches):
        import pyarrow as pa

        for b in pieces(batches):
            out = []
            for h, w, c, raw in zip(*(b.column(k).to_pylist() for k in ("height", "width", "channels", "pixels"))):
                out.append(None if raw is None else encoded(np.frombuffer(raw, np.uint8).reshape(h, w, c)))
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(out, pa.binary())], [key, "image"])

    return src.mapInArrow(run, f"`{key}` {src.schema[key].dataType.simpleString()}, image binary")
