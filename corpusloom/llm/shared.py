"""What several operators share: shared-storage tables, block-wise word hashing and blob codecs.

Every hash here is a pure function of its input, so a task that is run again after an executor is
lost makes the same rows.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.storage import drop_settled, mark_tables, release, settle

__all__ = ["Block", "blocks", "discard", "drop_settled", "ids_first", "is_empty", "mark_tables", "materialise", "mix", "powers", "release", "rolling", "settle", "small_batches", "sole", "stream", "strings", "worker_cache"]

BLOCK_BYTES = 1 << 20
"""Text bytes that one numpy block covers; a longer text is a block of its own."""

def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds the rows of one Arrow batch, so that long texts don't pile up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


materialise, discard = settle, drop_settled
"""Tables in the shared folder, by the registry that the engine's operators use too, so one release() drops both kinds."""


_CACHES: list[dict] = []


def worker_cache() -> dict:
    """A module's cache that lives as long as its Python worker, until a task of another operator calls sole()."""
    cache: dict = {}
    _CACHES.append(cache)
    return cache


def sole(mine: dict | None = None) -> None:
    """At a task's start: empties the caches of other operators, and gives free memory back to the system."""
    others = [c for c in _CACHES if c and c is not mine]
    if not others and mine:
        return  # a task of the same operator goes on with a warm cache
    for cache in others:
        cache.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def is_empty(df: DataFrame) -> bool:
    return len(df.take(1)) == 0


# -- hashing -----------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 2 + 1))


_BYTE = stream(11, 256)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POW = np.ones(1, dtype=np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SIGNS = np.ones(256, dtype=bool)
"""Bytes between words that are runs of ASCII letters and digits and of letters beyond ASCII."""
_SIGNS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def powers(n: int) -> np.ndarray:
    global _POW
    if len(_POW) < n:
        size = max(64, 1 << int(n - 1).bit_length())
        with np.errstate(over="ignore"):
            _POW = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _BASE, np.uint64)]), dtype=np.uint64)
    return _POW[:n]


def strings(column: pa.Array) -> pa.Array:
    """A string column with nulls as empty texts and 64-bit offsets."""
    return pc.fill_null(column.cast(pa.large_string()), "")


class Block:
    """Words of some consecutive rows: word hashes, and each row's range of words."""

    __slots__ = ("first", "rows", "hashes", "bounds", "starts", "ends", "data", "row_bytes")

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray, lower: bool, signs: bool = False):
        self.first, self.rows, self.data = first, len(offsets) - 1, data
        self.row_bytes = offsets
        solid = ~(_SIGNS if signs else _SPACE)[data]
        n = len(data)
        begins = solid.copy()
        if n:
            begins[1:] &= ~solid[:-1]
            at = offsets[:-1][offsets[:-1] < n]
            begins[at] = solid[at]
        starts = np.flatnonzero(begins)
        # A word ends before a space, at the next row's start, or at the end.
        lens = np.add.reduceat(solid, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
        self.starts, self.ends = starts, starts + lens
        self.bounds = np.searchsorted(starts, offsets)
        if not len(starts):
            self.hashes = np.zeros(0, np.uint64)
            return
        body = data[solid]
        if lower:
            body = _LOWER[body]
        first_of = np.concatenate([[0], np.cumsum(lens)[:-1]])
        place = np.arange(len(body)) - np.repeat(first_of, lens)
        value = _BYTE[body] * powers(int(lens.max()))[place]
        total = np.add.reduceat(value, first_of)
        self.hashes = mix(total + lens.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def blocks(texts: pa.Array, lower: bool = False, size: int = BLOCK_BYTES, signs: bool = False) -> Iterator[Block]:
    """Blocks of about size bytes of a column of strings(); words are maximal runs of other than ASCII white space."""
    texts = strings(texts)
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        to = min(n, max(to, at + 1))
        yield Block(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], lower, signs)
        at = to


def rolling(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Fingerprints of every k consecutive words, len(hashes) - k + 1 of them."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factors = stream(97 + seed, k) | np.uint64(1)
    out = hashes[:n] * factors[0]
    for i in range(1, k):
        out += mix(hashes[i : i + n] + factors[i]) if k <= 3 else hashes[i : i + n] * factors[i]
    return mix(out)


def ids_first(df: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The two columns that an operator on texts reads, and those to keep; other columns can have any names."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *keep)
