"""Decoders against the JVM's own codec, and against PNG lines written with every filter, depth, kind and interlacing."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import images


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(x, depth, colour, interlaced=False, filters=(0, 1, 2, 3, 4)):
    """A PNG whose lines take the given filters in turn."""
    h, w, channels = x.shape
    step, data = max(1, channels * depth // 8), b""
    grids = [x] if not interlaced else [x[r::rs, c::cs] for r, c, rs, cs in images.PASSES]
    for grid in grids:
        if not grid.size:
            continue
        flat = grid.reshape(grid.shape[0], -1)
        if depth == 16:
            lines = flat.astype(">u2").view(np.uint8).reshape(len(flat), -1)
        elif depth == 8:
            lines = flat.astype(np.uint8)
        else:
            bits = (flat[:, :, None] >> np.arange(depth - 1, -1, -1)) & 1
            lines = np.packbits(bits.reshape(len(flat), -1).astype(np.uint8), axis=1)
        above = [0] * lines.shape[1]
        for y, line in enumerate(lines.tolist()):
            kind, out = filters[y % len(filters)], []
            for i, v in enumerate(line):
                a, b, c = (line[i - step], above[i], above[i - step]) if i >= step else (0, above[i], 0)
                guess = a + b - c
                nearest = min((abs(guess - a), 0, a), (abs(guess - b), 1, b), (abs(guess - c), 2, c))[2]
                out.append((v - (0, a, b, (a + b) // 2, nearest)[kind]) % 256)
            data += bytes([kind, *out])
            above = line
    head = struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, int(interlaced))
    packed = zlib.compress(data)
    plte = chunk(b"PLTE", bytes(range(256)) * 3) if colour == 3 else b""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + plte + chunk(b"IDAT", packed[:7]) + chunk(b"IDAT", packed[7:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("interlaced", [False, True])
@pytest.mark.parametrize("colour, depth", [(0, 1), (0, 2), (0, 4), (0, 8), (0, 16), (2, 8), (2, 16), (3, 1), (3, 4), (3, 8), (4, 8), (6, 8), (6, 16)])
def test_png_of_every_kind(colour, depth, interlaced):
    rng = np.random.default_rng(1)
    for h, w in ((1, 1), (3, 2), (9, 13), (20, 7)):
        x = rng.integers(0, 1 << depth, (h, w, images.CHANNELS[colour]))
        got = images.decode(png(x, depth, colour, interlaced))
        assert np.array_equal(got if got.ndim == 3 else got[:, :, None], x)


def java_image(spark, x, form):
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(x.shape[1], x.shape[0], 10 if x.ndim == 2 else 5)
    for r in range(x.shape[0]):
        for c in range(x.shape[1]):
            v = [int(x[r, c])] if x.ndim == 2 else [int(k) for k in x[r, c]]
            array = spark.sparkContext._gateway.new_array(jvm.int, len(v))
            for i, k in enumerate(v):
                array[i] = k
            image.getRaster().setPixel(c, r, array)
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(image, form, out)
    raw = bytes(out.toByteArray())
    back = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(raw))
    rgb = np.array([[back.getRGB(c, r) & 0xFFFFFF for c in range(x.shape[1])] for r in range(x.shape[0])])
    return raw, np.stack([rgb >> 16, rgb >> 8 & 255, rgb & 255], axis=2)


def test_against_another_codec(spark):
    rng = np.random.default_rng(3)
    smooth = np.clip(np.add.outer(np.arange(19) * 9, np.arange(26) * 3)[:, :, None] + np.array([0, 40, 90]) + rng.integers(0, 9, (19, 26, 3)), 0, 255)
    raw, want = java_image(spark, smooth, "png")
    assert np.array_equal(images.decode(raw), want)
    raw, want = java_image(spark, smooth, "jpg")
    got = images.decode(raw).astype(int)
    assert got.shape == want.shape and np.abs(got - want).mean() < 4  # chroma is upsampled without smoothing
    raw, want = java_image(spark, smooth[:, :, 0], "jpg")
    grey = images.decode(raw).astype(int)
    assert grey.shape == (19, 26) and np.abs(grey - smooth[:, :, 0]).max() < 30
    raw, _ = java_image(spark, np.zeros((17, 9, 3), int), "jpg")
    assert not images.decode(raw).any()


def test_columns_and_damage(spark):
    x = np.zeros((4, 8, 1), int)
    black, x[1:3, 2:5] = png(x, 8, 0), 255
    mask, clear = png(x, 8, 0), png(np.zeros((2, 2, 4), int) + [0, 0, 0, 255], 8, 6)
    rng = random.Random(1)
    bad = [black[:-20], black[:30] + b"x" + black[31:], b"", None, b"GIF89a", b"\xff\xd8\xff", b"P5\n9 9\n255\n\0", mask[:20] + b"\xff" + mask[21:]]
    rows = [(i, bytearray(b) if b is not None else None) for i, b in enumerate([black, mask, clear, b"P6\n1 1\n255\n\0\0\0", *bad])]
    got = spark.createDataFrame(rows, "i int, b binary").select("i", images.all_black(F.col("b")).alias("black"), images.mask_box(F.col("b")).alias("box"), images.image_size(F.col("b")).alias("size")).orderBy("i").collect()
    assert [r["black"] for r in got] == [True, False, False, True] + [None] * len(bad)
    assert got[1]["box"] == [2 / 8, 1 / 4, 5 / 8, 3 / 4] and got[0]["box"] == [0.0] * 4 and got[-1]["box"] is None
    assert tuple(got[2]["size"]) == (2, 2, 4) and got[-1]["size"] is None
    jpeg, _ = java_image(spark, np.add.outer(np.arange(40), np.arange(40)) * 3, "jpg")
    for _ in range(150):  # nothing crashes, whatever is changed or cut off
        at = rng.randrange(2, len(jpeg))
        images.decode(jpeg[:at] + bytes([rng.randrange(256)]) + jpeg[at + 1 :])
        images.decode(jpeg[:at])
