"""Media columns as progressive JPEG.

The reader accumulates spectral-selection and successive-approximation scans of any 8-bit progressive
JPEG with one or three components into coefficient arrays, inverse-transforms them in numpy, upsamples
chroma and gives full-resolution RGB. A scan whose table has a single code has a fixed stride and is
read with array operations; all other ones are read code by code.

The writer stores bytes losslessly as the format's own unit, quantised DCT coefficients: a byte b is an AC
coefficient whose eight magnitude bits are b (b itself from 128 on, b - 255 below), or a DC coefficient b.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm.shared import ids_first, small_batches, strings

UNIT = 576
FILL = 255
NOTE = b"corpusloom payload "


def zigzag() -> np.ndarray:
    """Natural position of each coefficient in scan order: along the diagonals, turning at each."""
    order = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))
    return np.array(order)


ZIGZAG = zigzag()
_U, _X = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
COSINES = np.where(_U == 0, math.sqrt(1 / 8), 0.5) * np.cos((2 * _X + 1) * _U * math.pi / 16)

# -- entropy-coded segments --------------------------------------------------------------------


def stuffed(raw: bytes) -> bytes:
    return raw.replace(b"\xff", b"\xff\x00")


class Bits:
    """Reads bits of one entropy-coded segment, stuffing already taken out."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.held, self.have = raw, 0, 0, 0

    def peek(self, n: int) -> int:
        while self.have < n:
            self.held = (self.held << 8) | (self.raw[self.at] if self.at < len(self.raw) else 255)
            self.at += 1
            self.have += 8
        return (self.held >> (self.have - n)) & ((1 << n) - 1)

    def skip(self, n: int) -> None:
        self.have -= n
        self.held &= (1 << self.have) - 1

    def read(self, n: int) -> int:
        if not n:
            return 0
        out = self.peek(n)
        self.skip(n)
        return out

    def code(self, table: dict[tuple[int, int], int]) -> int:
        value = 0
        for n in range(1, 17):
            value = value << 1 | self.read(1)
            if (found := table.get((n, value))) is not None:
                return found
        raise ValueError("no such Huffman code")


def signed(bits: int, size: int) -> int:
    return bits if size == 0 or bits >> (size - 1) else bits - (1 << size) + 1


def huffman(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    """Codes (length, value) of a canonical table."""
    out, code, at = {}, 0, 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            out[n, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


# -- reader ------------------------------------------------------------------------------------


class Component:
    def __init__(self, h: int, v: int, table: int):
        self.h, self.v, self.table = h, v, table
        self.coefficients = self.width = self.height = None


def read_coefficients(raw: bytes) -> tuple[int, int, list[Component], dict[int, np.ndarray], bytes]:
    """(width, height, components with coefficients in scan order, quantisation tables, comment)."""
    if raw[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    at, quant, dc, ac, parts, order, note, every = 2, {}, {}, {}, {}, [], b"", 0
    width = height = mx = my = 0
    while at < len(raw):
        if raw[at] != 255:
            raise ValueError("marker expected")
        marker = raw[at + 1]
        if marker == 0xD9:
            break
        size = int.from_bytes(raw[at + 2 : at + 4], "big")
        body, at = raw[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 128 if wide else 64
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], dtype=">u2" if wide else "u1").astype(np.int64)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                (ac if body[0] >> 4 else dc)[body[0] & 15] = huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC2:
            height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            if body[0] != 8 or body[5] not in (1, 3):
                raise ValueError("8-bit images with one or three components only")
            for i in range(body[5]):
                c, hv, q = body[6 + 3 * i : 9 + 3 * i]
                parts[c] = Component(hv >> 4, hv & 15, q)
                order.append(parts[c])
            mx, my = max(p.h for p in order), max(p.v for p in order)
            for p in order:
                p.width, p.height = -(-width * p.h // (8 * mx)), -(-height * p.v // (8 * my))
                p.coefficients = np.zeros((-(-height // (8 * my)) * p.v, -(-width // (8 * mx)) * p.h, 64), dtype=np.int32)
        elif marker == 0xDD:
            every = int.from_bytes(body[:2], "big")
        elif marker == 0xFE:
            note = body
        elif marker == 0xDA:
            n = body[0]
            chosen = [(parts[body[1 + 2 * i]], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n)]
            first, last, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
            to = at
            while True:  # to the next marker that is neither stuffing nor a restart
                to = raw.index(b"\xff", to)
                if raw[to + 1] and not 0xD0 <= raw[to + 1] <= 0xD7:
                    break
                to += 2
            scan(raw[at:to], chosen, (first, last, high, low), dc, ac, every)
            at = to
        elif marker in (0xC0, 0xC1, 0xC3) or 0xC5 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not a progressive JPEG")
    return width, height, order, quant, note


def units(chosen: list[tuple[Component, int, int]]) -> tuple[list[np.ndarray], int]:
    """For each component of the scan, its blocks in scan order as flat numbers; and how many units there are."""
    if len(chosen) == 1:
        c = chosen[0][0]
        row = np.arange(c.height)[:, None] * c.coefficients.shape[1] + np.arange(c.width)
        return [row.reshape(-1, 1)], row.size
    out = []
    for c, _, _ in chosen:
        down, over = c.coefficients.shape[0] // c.v, c.coefficients.shape[1] // c.h
        grid = np.arange(down * c.v * over * c.h).reshape(down, c.v, over, c.h).transpose(0, 2, 1, 3)
        out.append(grid.reshape(down * over, c.v * c.h))
    return out, len(out[0])


def scan(raw: bytes, chosen: list, params: tuple[int, int, int, int], dc: dict, ac: dict, every: int) -> None:
    """Adds one scan to the coefficients of its components."""
    first, last, high, low = params
    blocks, total = units(chosen)
    pieces, step = [raw], total
    if every:
        pieces, step, begin = [], every, 0
        spot = raw.find(b"\xff")
        while spot >= 0:
            if 0xD0 <= raw[spot + 1] <= 0xD7:
                pieces.append(raw[begin:spot])
                begin = spot + 2
            spot = raw.find(b"\xff", spot + 2)
        pieces.append(raw[begin:])
    for k, piece in enumerate(pieces):
        piece = piece.replace(b"\xff\x00", b"\xff")
        mine = [b[k * step : (k + 1) * step] for b in blocks]
        flats = [c.coefficients.reshape(-1, 64) for c, _, _ in chosen]
        if first == 0:
            order = np.concatenate([np.stack([np.full(b.shape, i), b], axis=-1) for i, b in enumerate(mine)], axis=1).reshape(-1, 2)
            (dc_refine if high else dc_first)(piece, order, flats, [dc.get(d) for _, d, _ in chosen], low)
        else:
            (ac_refine if high else ac_first)(piece, mine[0].ravel(), flats[0], ac[chosen[0][2]], first, last, low)


def dc_first(piece: bytes, order: np.ndarray, flats: list, tables: list, low: int) -> None:
    bits, before = Bits(piece), [0] * len(flats)
    values = np.zeros(len(order), dtype=np.int64)
    lookups = []
    for t in tables:  # a fixed-width window finds a code at once
        width = max(n for n, _ in t)
        found = {}
        for (n, v), s in t.items():
            for rest in range(1 << (width - n)):
                found[v << (width - n) | rest] = (n, s)
        lookups.append((width, found))
    for i, c in enumerate(order[:, 0].tolist()):
        width, found = lookups[c]
        n, size = found[bits.peek(width)]
        bits.skip(n)
        before[c] += signed(bits.read(size), size)
        values[i] = before[c]
    for c, flat in enumerate(flats):
        own = order[:, 0] == c
        flat[order[own, 1], 0] = values[own] << low


def dc_refine(piece: bytes, order: np.ndarray, flats: list, tables: list, low: int) -> None:
    bits = np.unpackbits(np.frombuffer(piece, dtype=np.uint8))[: len(order)].astype(np.int32) << low
    for c, flat in enumerate(flats):
        own = order[:, 0] == c
        flat[order[own, 1], 0] |= bits[own]


def ac_first(piece: bytes, order: np.ndarray, flat: np.ndarray, table: dict, first: int, last: int, low: int) -> None:
    band = last - first + 1
    if len(table) == 1:
        ((n, _),) = table
        (symbol,) = table.values()
        size = symbol & 15
        if symbol >> 4 == 0 and size:  # every coefficient is there, with size bits each
            if n + size == 8:
                value = np.frombuffer(piece, dtype=np.uint8)[: len(order) * band].astype(np.int32)
            else:
                bits = np.unpackbits(np.frombuffer(piece, dtype=np.uint8))[: len(order) * band * (n + size)].reshape(-1, n + size)
                value = bits[:, n:] @ (1 << np.arange(size - 1, -1, -1)).astype(np.int32)
            value &= (1 << size) - 1
            value = np.where(value >> (size - 1), value, value - (1 << size) + 1)
            flat[order, first : last + 1] = (value << low).reshape(-1, band)
            return
    bits, run = Bits(piece), 0
    for b in order.tolist():
        if run:
            run -= 1
            continue
        k = first
        while k <= last:
            symbol = bits.code(table)
            r, size = symbol >> 4, symbol & 15
            if size:
                k += r
                flat[b, k] = signed(bits.read(size), size) << low
                k += 1
            elif r == 15:
                k += 16
            else:
                run = (1 << r) - 1 + bits.read(r)
                break


def ac_refine(piece: bytes, order: np.ndarray, flat: np.ndarray, table: dict, first: int, last: int, low: int) -> None:
    band, one = last - first + 1, 1 << low
    if len(table) == 1 and (1, 0) in table and table[1, 0] == 0:
        old = flat[order, first : last + 1]
        if old.all():  # each block: the code of its end, then a bit for every coefficient
            bits = np.unpackbits(np.frombuffer(piece, dtype=np.uint8))[: len(order) * (1 + band)].reshape(-1, 1 + band)[:, 1:]
            flat[order, first : last + 1] = old + np.sign(old) * (bits.astype(np.int32) << low)
            return
    bits, run = Bits(piece), 0

    def refine(b: int, k: int) -> None:
        if bits.read(1) and not abs(int(flat[b, k])) & one:
            flat[b, k] += one if flat[b, k] > 0 else -one

    for b in order.tolist():
        k = first
        while run == 0 and k <= last:
            symbol = bits.code(table)
            r, size = symbol >> 4, symbol & 15
            value = 0
            if size:
                value = one if bits.read(1) else -one
            elif r < 15:
                run = (1 << r) + bits.read(r)
                break
            while k <= last:
                if flat[b, k]:
                    refine(b, k)
                elif r == 0:
                    break
                else:
                    r -= 1
                k += 1
            if value and k <= last:
                flat[b, k] = value
            k += 1
        if run:
            for k in range(k, last + 1):
                if flat[b, k]:
                    refine(b, k)
            run -= 1


def plane(c: Component, quant: np.ndarray) -> np.ndarray:
    """Samples of a component, from its coefficients."""
    down, over = c.coefficients.shape[:2]
    natural = np.zeros((down * over, 64))
    natural[:, ZIGZAG] = c.coefficients.reshape(-1, 64) * quant
    block = COSINES.T @ natural.reshape(-1, 8, 8) @ COSINES + 128
    return block.reshape(down, over, 8, 8).transpose(0, 2, 1, 3).reshape(down * 8, over * 8)


def to_rgb(width: int, height: int, components: list[Component], quant: dict[int, np.ndarray]) -> np.ndarray:
    """Full-resolution RGB (height, width, 3): chroma upsampled by repetition, values rounded and clipped."""
    mx, my = max(c.h for c in components), max(c.v for c in components)
    full = []
    for c in components:
        p = np.clip(np.rint(plane(c, quant[c.table])), 0, 255)
        if (c.h, c.v) != (mx, my):
            p = np.repeat(np.repeat(p, my // c.v, axis=0), mx // c.h, axis=1)
        full.append(p[:height, :width])
    if len(full) == 1:
        rgb = np.stack(full * 3, axis=-1)
    else:
        y, cb, cr = full
        cb, cr = cb - 128, cr - 128
        rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=-1)
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)


# -- writer ------------------------------------------------------------------------------------


def segment(marker: int, body: bytes) -> bytes:
    return bytes((255, marker)) + (len(body) + 2).to_bytes(2, "big") + body


DC_BITS = 4
_TABLES = (
    segment(0xDB, b"\x00" + b"\x01" * 64)
    + segment(0xC4, b"\x00" + bytes([0, 0, 0, 9] + [0] * 12) + bytes(range(9)))
    + segment(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\x07")
    + segment(0xC4, b"\x11" + bytes([1] + [0] * 15) + b"\x00")
)


def packed_codes(values: np.ndarray, lengths: np.ndarray) -> bytes:
    """Codes of up to 32 bits one after the other, the last byte filled with ones."""
    total = int(lengths.sum())
    owner = np.repeat(np.arange(len(values)), lengths)
    place = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    bits = (values[owner] >> (lengths[owner] - 1 - place)) & 1
    return np.packbits(np.append(bits, np.ones(-total % 8, dtype=np.int64)).astype(np.uint8)).tobytes()


def write_payload(payload: bytes, note: bytes) -> bytes:
    """A progressive JPEG, chroma halved both ways, whose coefficients are the payload; note is its comment."""
    n = -(-len(payload) // 384)
    over = math.isqrt(n - 1) + 1
    down = -(-n // over)
    data = np.full(over * down * 384, FILL, dtype=np.uint8)
    data[: len(payload)] = np.frombuffer(payload, dtype=np.uint8)
    mcu = data.reshape(down, over, 6, 64)
    luma = mcu[:, :, :4].reshape(down, over, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64)
    chroma = [mcu[:, :, 4].reshape(-1, 64), mcu[:, :, 5].reshape(-1, 64)]
    dc = mcu[..., 0].reshape(-1, 6).astype(np.int64)
    half = dc >> 1
    step = np.empty_like(half)
    step[:, 1:4] = half[:, 1:4] - half[:, 0:3]
    step[:, 0] = half[:, 0] - np.append(0, half[:-1, 3])
    for c in (4, 5):
        step[:, c] = half[:, c] - np.append(0, half[:-1, c])
    step = step.ravel()
    size = np.ceil(np.log2(np.abs(step) + 1)).astype(np.int64)
    extra = np.where(step < 0, step + (1 << size) - 1, step)
    out = [b"\xff\xd8", segment(0xFE, note), _TABLES, segment(0xC2, bytes((8,)) + (16 * down).to_bytes(2, "big") + (16 * over).to_bytes(2, "big") + b"\x03\x01\x22\x00\x02\x11\x00\x03\x11\x00")]
    out += [segment(0xDA, b"\x03\x01\x00\x02\x00\x03\x00\x00\x00\x01"), stuffed(packed_codes(size << size | extra, size + DC_BITS))]
    out += [segment(0xDA, b"\x03\x01\x00\x02\x00\x03\x00\x00\x00\x10"), stuffed(np.packbits(np.append(dc.ravel() & 1, np.ones(-dc.size % 8, dtype=np.int64)).astype(np.uint8)).tobytes())]
    for c, blocks, first, last in ((1, luma, 1, 5), (2, chroma[0], 1, 63), (3, chroma[1], 1, 63), (1, luma, 6, 63)):
        out += [segment(0xDA, bytes((1, c, 0, first, last, 1))), (blocks[:, first : last + 1] >> 1).tobytes()]
    for c, blocks in ((1, luma), (2, chroma[0]), (3, chroma[1])):
        odd = (blocks & 1) ^ (blocks < 128)  # the last bit of the magnitude
        odd[:, 0] = 0  # the code that ends a block
        out += [segment(0xDA, bytes((1, c, 1, 1, 63, 0x10))), stuffed(np.packbits(odd, axis=None).tobytes())]
    return b"".join([*out, b"\xff\xd9"])


def read_payload(components: list[Component], size: int) -> bytes:
    """The bytes that the coefficients stand for."""
    y, cb, cr = (c.coefficients for c in components)
    down, over = cb.shape[:2]
    both = np.concatenate([y.reshape(down, 2, over, 2, 64).transpose(0, 2, 1, 3, 4).reshape(down, over, 4, 64), cb[:, :, None], cr[:, :, None]], axis=2)
    both = both.reshape(-1, 64)
    out = np.where(both < 0, both + 255, both)
    return out.astype(np.uint8).tobytes()[:size]


def padded(text: bytes) -> bytes:
    return text + bytes((FILL,)) * (-len(text) % UNIT or (UNIT if not text else 0))


# -- operators ---------------------------------------------------------------------------------


def store(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, media binary): each text's UTF-8 bytes, filled up to a positive multiple of 576, as a progressive JPEG.

    Null text: as an empty one. A row for each row, null ids and repeated rows included; other columns are not read.
    """
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = []
            for x in strings(batch.column(1)).to_pylist():
                raw = x.encode()
                media.append(write_payload(padded(raw), NOTE + b"%d" % len(raw)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], ["doc_id", "media"])

    return ids_first(documents, id_col, text_col).mapInArrow(run, "doc_id long, media binary")


def opened(raw: bytes | None):
    """What read_coefficients says; None for null media and bytes that are no whole progressive JPEG."""
    try:
        return None if raw is None else read_coefficients(raw)
    except (ValueError, IndexError, KeyError, TypeError):
        return None


def tensors(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(doc_id, width, height, rgb binary: height x width x 3 bytes) of any progressive JPEGs. Null media and bytes that can't be read as one: nulls. Null ids and repeated rows are rows like any other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw in batch.column(1).to_pylist():
                found = opened(raw)
                if found is None or not found[0] or not found[1]:
                    rows.append((None, None, None))
                    continue
                width, height, parts, quant, _ = found
                rows.append((width, height, to_rgb(width, height, parts, quant).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary())))], ["doc_id", "width", "height", "rgb"])

    return media.select(media[id_col].cast("long").alias("doc_id"), media[media_col].cast("binary").alias("media")).mapInArrow(run, "doc_id long, width int, height int, rgb binary")


def digest(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Of store(): what is read back from the stored bytes, with features of the RGB tensor (size, channel means, mean step of green between neighbours). Media that store() didn't make, null and damaged ones included: nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw in batch.column(1).to_pylist():
                found = opened(raw)
                if found is None or not found[4].startswith(NOTE) or len(found[2]) != 3:
                    rows.append((None,) * 7)
                    continue
                width, height, parts, quant, note = found
                try:  # a foreign file can have the comment too
                    n = int(note[len(NOTE) :])
                    payload = read_payload(parts, n + (-n % UNIT or (UNIT if not n else 0)))
                    if n < 0 or len(payload) < n:
                        raise ValueError
                except (ValueError, IndexError):
                    rows.append((None,) * 7)
                    continue
                rgb = to_rgb(width, height, parts, quant)
                sums = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64)
                means = [int(x) // (width * height) for x in sums]
                steps = int(np.abs(np.diff(rgb[:, :, 1].astype(np.int16), axis=1)).sum(dtype=np.int64)) // (width * height)
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), f"{width}x{height}:{means[0]},{means[1]},{means[2]}:{steps}"))
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], ["doc_id", *names])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select(media[id_col].cast("long").alias("doc_id"), media[media_col].cast("binary").alias("media")).mapInArrow(run, schema)
