"""Decoding of images into arrays as they are stored (FLT-15, EXT-15): PNG of all kinds, sequential Huffman JPEG, portable pixmaps and graymaps.

Palette images give their indices and alpha stays a channel, as image libraries give them to numpy. Whatever is damaged, cut off or of another format gives None.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_PIXELS = 1 << 28
"""Larger images are refused: what a header says can be far beyond the bytes there are."""


class Damaged(ValueError):
    pass


def decode(raw: bytes | None) -> np.ndarray | None:
    """(height, width) or (height, width, channels); None for what can't be decoded."""
    if not raw:
        return None
    try:
        if raw[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(raw)
        if raw[:2] == b"\xff\xd8":
            return _jpeg(raw)
        if raw[:2] in (b"P5", b"P6"):
            return _pixmap(raw)
    except (ValueError, IndexError, KeyError, struct.error, zlib.error):
        pass
    return None


def _pixmap(raw: bytes) -> np.ndarray:
    head = re.match(rb"P[56]\s+(?:#[^\n]*\s+)*(\d+)\s+(?:#[^\n]*\s+)*(\d+)\s+(?:#[^\n]*\s+)*(\d+)\s", raw)
    if head is None:
        raise Damaged("header")
    w, h, top = (int(x) for x in head.groups())
    shape = (h, w, 3) if raw[:2] == b"P6" else (h, w)
    kind = ">u2" if top > 255 else "u1"
    body = np.frombuffer(raw[head.end() :], kind)
    if len(body) < math.prod(shape):
        raise Damaged("cut off")
    return body[: math.prod(shape)].reshape(shape)


# -- PNG ---------------------------------------------------------------------------------------

#: Channels by colour type, and the seven passes of interlaced images as (first row, first column, row step, column step).
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1))


def _png(raw: bytes) -> np.ndarray:
    at, parts, head = 8, [], None
    while True:
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + size]
        if len(body) < size or zlib.crc32(kind + body) != struct.unpack(">I", raw[at + 8 + size : at + 12 + size])[0]:
            raise Damaged(kind)
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"IEND":
            break
    w, h, depth, colour, _, _, interlaced = head
    channels = CHANNELS[colour]
    if not 0 < w * h <= MOST_PIXELS or depth not in (1, 2, 4, 8, 16) or interlaced > 1:
        raise Damaged("IHDR")
    sizes = [(h, w)] if not interlaced else [(-(-(h - r) // rs) if h > r else 0, -(-(w - c) // cs) if w > c else 0) for r, c, rs, cs in PASSES]
    total = sum(rows * (1 + -(-cols * channels * depth // 8)) for rows, cols in sizes if rows and cols)
    data = zlib.decompressobj().decompress(b"".join(parts), total)
    if len(data) < total:
        raise Damaged("IDAT")
    out = np.zeros((h, w, channels), np.uint16 if depth == 16 else np.uint8)
    at = 0
    for i, (rows, cols) in enumerate(sizes):
        if not rows or not cols:
            continue
        width = -(-cols * channels * depth // 8)
        lines = _unfiltered(data[at : at + rows * (1 + width)], rows, width, max(1, channels * depth // 8))
        at += rows * (1 + width)
        if depth == 16:
            pixels = lines.reshape(rows, -1, 2).astype(np.uint16) @ np.array([256, 1], np.uint16)
        elif depth == 8:
            pixels = lines
        else:
            bits = np.unpackbits(lines, axis=1).reshape(rows, -1, depth)
            pixels = bits @ (1 << np.arange(depth - 1, -1, -1)).astype(np.uint8)
        pixels = pixels[:, : cols * channels].reshape(rows, cols, channels)
        if interlaced:
            r, c, rs, cs = PASSES[i]
            out[r::rs, c::cs] = pixels
        else:
            out[:] = pixels
    return out[:, :, 0] if channels == 1 else out


def _unfiltered(data: bytes, rows: int, width: int, step: int) -> np.ndarray:
    """Lines without their filters; step is the bytes of a pixel. Each line needs the one above."""
    lines = np.frombuffer(data, np.uint8).reshape(rows, 1 + width)
    out = np.zeros((rows, width), np.uint8)
    above = np.zeros(width, np.uint8)
    for y in range(rows):
        kind, line = int(lines[y, 0]), lines[y, 1:]
        if kind == 0:
            out[y] = line
        elif kind == 1:
            padded = np.zeros(-(-width // step) * step, np.uint8)
            padded[:width] = line
            out[y] = np.cumsum(padded.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[:width]
        elif kind == 2:
            out[y] = line + above
        elif kind in (3, 4):
            out[y] = np.frombuffer((_average if kind == 3 else _paeth)(line.tolist(), above.tolist(), step), np.uint8)
        else:
            raise Damaged("filter")
        above = out[y]
    return out


def _average(line: list[int], above: list[int], step: int) -> bytes:
    out = bytearray(len(line))
    for i, x in enumerate(line):
        out[i] = (x + ((out[i - step] if i >= step else 0) + above[i]) // 2) & 255
    return bytes(out)


def _paeth(line: list[int], above: list[int], step: int) -> bytes:
    """Each byte plus whichever of the left, upper and upper left ones is nearest to left + upper - upper left."""
    out = bytearray(len(line))
    for i, x in enumerate(line):
        a, b, c = (out[i - step], above[i], above[i - step]) if i >= step else (0, above[i], 0)
        p, q, r = abs(b - c), abs(a - c), abs(a + b - 2 * c)
        out[i] = (x + (a if p <= q and p <= r else b if q <= r else c)) & 255
    return bytes(out)


# -- JPEG --------------------------------------------------------------------------------------

#: Places of coefficients in the order in which they are stored.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_SCALE = np.array([[math.cos((2 * x + 1) * u * math.pi / 16) * (math.sqrt(1 / 8) if not u else 0.5) for x in range(8)] for u in range(8)])


class _Bits:
    """Bits of an entropy-coded stretch between restart markers, of which the stuffed zeros are gone; ones follow beyond the end."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def need(self, n: int) -> None:
        while self.n < n:
            some = self.data[self.at : self.at + 6]
            if len(some) < 6:
                if self.at > len(self.data) + 6:
                    raise Damaged("cut off")
                some = some + b"\xff" * (6 - len(some))
            self.held = (self.held << 48 | int.from_bytes(some, "big")) & (1 << 112) - 1
            self.at += 6
            self.n += 48

    def take(self, n: int) -> int:
        self.need(n)
        self.n -= n
        return self.held >> self.n & (1 << n) - 1

    def symbol(self, table: list) -> int:
        self.need(16)
        length, value = table[self.held >> self.n - 16 & 0xFFFF]
        if not length:
            raise Damaged("code")
        self.n -= length
        return value

    def number(self, size: int) -> int:
        if not size:
            return 0
        x = self.take(size)
        return x if x >> size - 1 else x - (1 << size) + 1


def _huffman(body: bytes) -> list:
    """For each 16 bits: the length and value of the code that they begin with."""
    counts, values, table, code, k = body[:16], body[16:], [(0, 0)] * 65536, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            low = code << 16 - length
            table[low : low + (1 << 16 - length)] = [(length, values[k])] * (1 << 16 - length)
            code, k = code + 1, k + 1
        code <<= 1
    if len(table) != 65536:
        raise Damaged("codes")
    return table


def _jpeg(raw: bytes) -> np.ndarray:
    at, tables, codes, parts, restart, adobe = 2, {}, {}, [], 0, None
    w = h = 0
    while True:
        while raw[at] == 0xFF and raw[at + 1] == 0xFF:
            at += 1
        if raw[at] != 0xFF:
            raise Damaged("marker")
        marker = raw[at + 1]
        size = struct.unpack(">H", raw[at + 2 : at + 4])[0]
        body = raw[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                own = np.frombuffer(body[1 : 1 + 64 * (1 + wide)], ">u2" if wide else "u1").astype(np.int64)
                tables[body[0] & 15] = own
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                codes[body[0]] = _huffman(body[1:n])
                body = body[n:]
        elif marker in (0xC0, 0xC1):
            depth, h, w, n = struct.unpack(">BHHB", body[:6])
            if depth != 8 or not 0 < w * h <= MOST_PIXELS or n not in (1, 3, 4):
                raise Damaged("frame")
            parts = [{"id": body[6 + 3 * i], "across": body[7 + 3 * i] >> 4, "down": body[7 + 3 * i] & 15, "table": body[8 + 3 * i]} for i in range(n)]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xEE and body[:5] == b"Adobe":
            adobe = body[11]
        elif marker == 0xDA:
            break
        elif marker in (0xD9, *range(0xC2, 0xD0)) and marker not in (0xC4, 0xC8, 0xCC):
            raise Damaged("another process")
    if not parts or body[0] != len(parts):
        raise Damaged("scan")
    for i in range(len(parts)):
        part = next(p for p in parts if p["id"] == body[1 + 2 * i])
        part["dc"], part["ac"] = codes[body[2 + 2 * i] >> 4], codes[0x10 | body[2 + 2 * i] & 15]
    end = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]", re.S).search(raw, at)
    if end is None:
        raise Damaged("cut off")
    stretches = re.split(rb"\xff+[\xd0-\xd7]", raw[at : end.start()])
    planes = _planes(parts, w, h, restart, [x.replace(b"\xff\x00", b"\xff") for x in stretches])
    across, down = max(p["across"] for p in parts), max(p["down"] for p in parts)
    full = []
    for p, (grid, own_h, own_w) in zip(parts, planes, strict=True):
        pixels = np.einsum("ux,nuv,vy->nxy", _SCALE, (grid * tables[p["table"]])[:, np.argsort(ZIGZAG)].reshape(-1, 8, 8).astype(np.float64), _SCALE, optimize=True)
        flat = pixels.reshape(own_h, own_w, 8, 8).transpose(0, 2, 1, 3).reshape(own_h * 8, own_w * 8)
        flat = np.clip(np.rint(flat + 128), 0, 255)
        if across % p["across"] or down % p["down"]:
            raise Damaged("sampling")
        full.append(flat.repeat(down // p["down"], axis=0).repeat(across // p["across"], axis=1)[:h, :w])
    if len(full) == 1:
        return full[0].astype(np.uint8)
    out = np.stack(full, axis=2)
    if (adobe != 0) if len(full) == 3 else adobe == 2:
        y, b, r = out[..., 0].copy(), out[..., 1] - 128, out[..., 2] - 128
        out[..., 0], out[..., 1], out[..., 2] = y + 1.402 * r, y - 0.344136286 * b - 0.714136286 * r, y + 1.772 * b
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def _planes(parts: list[dict], w: int, h: int, restart: int, stretches: list[bytes]) -> list[tuple[np.ndarray, int, int]]:
    """Of each component: its blocks' coefficients as stored (blocks, 64), and how many blocks stand above and beside each other."""
    across, down = max(p["across"] for p in parts), max(p["down"] for p in parts)
    alone = len(parts) == 1
    wide, high = (-(-w // 8), -(-h // 8)) if alone else (-(-w // (8 * across)), -(-h // (8 * down)))
    shapes = [(high, wide) if alone else (high * p["down"], wide * p["across"]) for p in parts]
    grids = [np.zeros((a * b, 64), np.int32) for a, b in shapes]
    if alone:
        parts[0]["across"] = parts[0]["down"] = 1
    units, each = wide * high, restart or wide * high
    if len(stretches) < -(-units // each):
        raise Damaged("cut off")
    for s in range(-(-units // each)):
        bits, last = _Bits(stretches[s]), [0] * len(parts)
        for unit in range(s * each, min(units, (s + 1) * each)):
            y, x = divmod(unit, wide)
            for i, p in enumerate(parts):
                for v in range(p["down"]):
                    for u in range(p["across"]):
                        row = grids[i][(y * p["down"] + v) * shapes[i][1] + x * p["across"] + u]
                        last[i] += bits.number(bits.symbol(p["dc"]))
                        row[0] = last[i]
                        k = 1
                        while k < 64:
                            code = bits.symbol(p["ac"])
                            if not code & 15:
                                if code != 0xF0:
                                    break
                                k += 16
                                continue
                            k += code >> 4
                            row[k] = bits.number(code & 15)
                            k += 1
    return [(g, *s) for g, s in zip(grids, shapes, strict=True)]


# -- columns -----------------------------------------------------------------------------------


def _each(f: Callable, returns: str) -> Callable[[Column], Column]:
    def run(images: pd.Series) -> pd.Series:
        return pd.Series([f(decode(x)) for x in images], dtype=object)

    return F.pandas_udf(run, returns)


def all_black(image: Column) -> Column:
    """FLT-15: whether all stored samples are 0 (of palette images the indices, with alpha where there is one); null for what can't be decoded."""
    return _each(lambda x: None if x is None else not x.any(), "boolean")(image)


def mask_box(image: Column) -> Column:
    """EXT-15: [x1, y1, x2, y2] in shares of the image around the pixels of a mask whose first channel isn't 0, the last row and column inside; zeros for an empty mask, null for what can't be decoded."""

    def box(x: np.ndarray | None) -> list[float] | None:
        if x is None:
            return None
        own = x if x.ndim == 2 else x[:, :, 0]
        rows, cols = np.flatnonzero(own.any(axis=1)), np.flatnonzero(own.any(axis=0))
        if not len(rows):
            return [0.0] * 4
        h, w = own.shape
        return [float(v) for v in (cols[0] / w, rows[0] / h, (cols[-1] + 1) / w, (rows[-1] + 1) / h)]

    return _each(box, "array<double>")(image)


def image_size(image: Column) -> Column:
    """(width, height, channels) of a decoded image; null for what can't be decoded."""

    def run(images: pd.Series) -> pd.DataFrame:
        found = [decode(x) for x in images]
        rows = [(None,) * 3 if x is None else (x.shape[1], x.shape[0], 1 if x.ndim == 2 else x.shape[2]) for x in found]
        return pd.DataFrame(rows, columns=["width", "height", "channels"], dtype="Int32")

    size = F.pandas_udf(run, "width int, height int, channels int")(image)
    return F.when(size["width"].isNotNull(), size)
