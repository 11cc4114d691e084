"""PNG files as pictures."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Samples a pixel by colour type, and OpenCV's type numbers by channels, as in Spark's image struct.
_SAMPLES, MODES = {0: 1, 2: 3, 4: 2, 6: 4}, {1: 0, 3: 16, 4: 24}


def _nearest(a: int, b: int, c: int) -> int:
    """Of left, above and above left, the one nearest to a + b - c."""
    return min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]


def _unfiltered(rows: np.ndarray, step: int) -> np.ndarray:
    """Samples of rows that begin with the number of their filter."""
    out, above = rows[:, 1:].copy(), np.zeros(rows.shape[1] - 1, np.uint8)
    for kind, row in zip(rows[:, 0].tolist(), out, strict=True) if rows[:, 0].any() else ():
        if kind == 1:
            row[:] = np.cumsum(row.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            row += above
        elif kind > 2:
            line, up = [0] * step + row.tolist(), [0] * step + above.tolist()
            for x in range(step, len(line)):
                a, b, c = line[x - step], up[x], up[x - step]
                line[x] = (line[x] + ((a + b) // 2 if kind == 3 else _nearest(a, b, c))) & 255
            row[:] = line[step:]
        above = row
    return out


def decode_png(body: bytes) -> tuple[int, int, int, bytes]:
    """Height, width, channels and data (blue first) as Spark's image reader gives them; an error for what isn't a plain PNG file of
    eight bits a sample."""
    at, parts, head = 8, [], None
    while body[:8] == b"\x89PNG\r\n\x1a\n" and at < len(body):
        n, kind = struct.unpack(">I4s", body[at : at + 8])
        data, at = body[at + 8 : at + 8 + n], at + 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            parts.append(data)
        elif kind == b"tRNS":
            head = None
    if not head or head[2] != 8 or head[3] not in _SAMPLES or head[6]:
        raise ValueError("neither gray, red, green and blue nor with alpha, of eight bits and not interlaced")
    width, height, step = head[0], head[1], _SAMPLES[head[3]]
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, 1 + width * step)
    pixels = _unfiltered(rows, step).reshape(height, width, step)
    order = [0] if step < 3 else [2, 1, 0, 3][:step]
    return height, width, len(order), pixels[:, :, order].tobytes()
