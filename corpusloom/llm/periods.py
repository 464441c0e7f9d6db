"""Periodic runs of words: every lag up to a quarter of a text is compared with the text itself, and stretches of equal places are run-length encoded.

A run of period q and length l makes l - q neighbouring places equal to the place q words on. For a block of lags the
comparison is one numpy expression over a strided view. It is made at anchors first, so close to each other that the shortest
stretch which counts holds four of them; the few lags that have four equal anchors in a row are then compared at every place.
So a text of n words costs about n log n comparisons, and no lag is left out.

Spark deals out documents; those of very many bytes as ranges of lags, whose runs meet again by document.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import blocks, ids_first, small_batches, sole, strings

MIN_EXPONENT = 4
"""A run holds its period so many times at least."""
MIN_LENGTH = 6
"""Words that a run has at least."""
LONG_BYTES = 16 << 20
"""Texts beyond so many bytes are dealt out as ranges of lags, one more for each further LONG_BYTES, MOST_RANGES at most."""
MOST_RANGES = 16
BASE_LAGS = 64
"""Periods up to this are found first by every range, so that their multiples in long runs needn't be compared."""
CELLS = 1 << 22
"""Comparisons of one block of lags."""
ANCHORS = 4


def least_equal(lag: int) -> int:
    """Equal places that a run of this period has at least."""
    return max(MIN_LENGTH - lag, (MIN_EXPONENT - 1) * lag)


def _lags_with_anchors(ids: np.ndarray, padded: np.ndarray, low: int, high: int, known: list[tuple[int, int, int]]) -> Iterator[int]:
    """Lags of low .. high - 1 (high at most 2 * low) that have ANCHORS equal anchors in a row which no known run of a divisor explains."""
    step = max(1, least_equal(low) // ANCHORS)
    at = ids[: len(ids) - low : step]
    if len(at) < ANCHORS:
        return
    width = max(1, CELLS // len(at))
    for first in range(low, high, width):
        many = min(width, high - first)
        shifted = np.ndarray((many, len(at)), padded.dtype, padded, first * padded.itemsize, (padded.itemsize, padded.itemsize * step))
        equal = shifted == at
        row = equal[:, : len(at) - ANCHORS + 1].copy()
        for i in range(1, ANCHORS):
            row &= equal[:, i : len(at) - ANCHORS + 1 + i]
        for r in np.flatnonzero(row.any(axis=1)).tolist():
            lag = first + r
            reach = (ANCHORS - 1) * step + lag
            inside = [(s, e) for s, e, q in known if lag % q == 0 and lag > q and e - s > reach]
            if inside:
                places = np.flatnonzero(row[r]) * step
                for s, e in inside:
                    places = places[(places < s) | (places + reach >= e)]
                if not len(places):
                    continue
            yield lag


def _primes(n: int) -> list[int]:
    found, p = [], 2
    while p * p <= n:
        if n % p == 0:
            found.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return found + [n] * (n > 1)


def runs(ids: np.ndarray, low: int = 1, high: int | None = None) -> np.ndarray:
    """Rows (start, length, period), ordered by start, then period: maximal runs whose smallest period is low .. high - 1.

    ids holds one number a word, equal ones for equal words. A stretch of a lag is left out where a divisor of the lag is a period of it too.
    """
    n = len(ids)
    high = min(n // MIN_EXPONENT + 1, high or n)
    padded = None
    found: list[tuple[int, int, int]] = []
    known: list[tuple[int, int, int]] = []

    def scan(first: int, last: int) -> None:
        nonlocal padded
        if padded is None:
            # Nothing equals what stands beyond the end: it differs from the word that it would be compared with.
            padded = np.concatenate([ids, np.full(3 * n + 8, _other(ids), dtype=ids.dtype)])
        while first < last:
            until = min(2 * first, last)
            for lag in _lags_with_anchors(ids, padded, first, until, known):
                equal = np.zeros(n - lag + 2, dtype=np.int8)
                equal[1:-1] = ids[:-lag] == ids[lag:]
                edge = np.flatnonzero(np.diff(equal))
                begin, end = edge[::2], edge[1::2]
                enough = end - begin >= least_equal(lag)
                for s, e in zip(begin[enough].tolist(), (end[enough] + lag).tolist(), strict=True):
                    if not any(np.array_equal(ids[s : e - lag // p], ids[s + lag // p : e]) for p in _primes(lag)):
                        found.append((s, e, lag))
            first = until

    if low < high and n >= MIN_LENGTH:
        scan(1, min(BASE_LAGS + 1, high))
        known = [x for x in found if x[1] - x[0] > 2 * BASE_LAGS]
        if low > 1:
            found = [x for x in found if x[2] >= low]
        scan(max(low, BASE_LAGS + 1), high)
    out = np.array([(s, e - s, q) for s, e, q in found if q < high], dtype=np.int64).reshape(-1, 3)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _other(ids: np.ndarray) -> int:
    """A number that no word has."""
    top, least = int(ids.max()), int(ids.min())
    if top < np.iinfo(ids.dtype).max:
        return top + 1
    return least - 1 if least > np.iinfo(ids.dtype).min else int(np.setdiff1d(np.arange(len(ids) + 1, dtype=ids.dtype), ids)[0])


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """For documents whose id's crc32 ends in 0: which original word each word becomes, the end of the text being made periodic; else None."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return at


def dropped(found: np.ndarray, n: int) -> np.ndarray:
    """Which of n words a run repeats: those after its first period."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, found[:, 0] + found[:, 2], 1)
    np.add.at(edge, found[:, 0] + found[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0


NAMES = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _answer(doc_id: int | None, words: list[bytes], order: np.ndarray | None, found: np.ndarray) -> tuple:
    """A document's row. words are those of the text, order says which of them stand where."""
    if order is not None:
        words = [words[i] for i in order.tolist()]
    best: tuple = (None,) * 4
    if len(found):
        s, length, q = found[np.lexsort((found[:, 2], found[:, 0], -found[:, 1]))[0]].tolist()
        best = (s, length, q, 1000 * length // q)
        out = dropped(found, len(words))
        words = [words[i] for i in np.flatnonzero(~out).tolist()]
    said = "".join(f"{s},{length},{q}\n" for s, length, q in found.tolist())
    return doc_id, len(found), *best, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 6 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], list(NAMES))


def _whole(batches: Iterator[pa.RecordBatch], plant: bool) -> Iterator[pa.RecordBatch]:
    """Documents with all their lags."""
    sole()
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), strings(batch.column(1))
        for b in blocks(texts):
            rows = []
            for i in range(b.rows):
                words = texts[b.first + i].as_py().encode().split()
                hashes = b.hashes[b.bounds[i] : b.bounds[i + 1]]
                doc_id = ids[b.first + i]
                order = planted(doc_id, len(words)) if plant else None
                rows.append(_answer(doc_id, words, order, runs(hashes if order is None else hashes[order])))
            yield _batch(rows)


def _ranges(batches: Iterator[pa.RecordBatch], plant: bool) -> Iterator[pa.RecordBatch]:
    """Long documents (doc_id, text, text_key, part, parts): the runs of one range of lags."""
    sole()
    for batch in batches:
        ids, keys, part, parts = (batch.column(i).to_pylist() for i in (0, 2, 3, 4))
        for i, b in enumerate(blocks(batch.column(1), size=1)):  # a text each
            order = planted(ids[i], len(b.hashes)) if plant else None
            words = b.hashes if order is None else b.hashes[order]
            top = len(words) // MIN_EXPONENT + 1
            found = runs(words, max(1, top * part[i] // parts[i]), max(1, top * (part[i] + 1) // parts[i]))
            yield pa.RecordBatch.from_arrays([pa.array([ids[i]], pa.int64()), pa.array([keys[i]], pa.int64()), pa.array([found.astype("<i8").tobytes()], pa.binary())], ["doc_id", "text_key", "found"])


def _joined(batches: Iterator[pa.RecordBatch], plant: bool) -> Iterator[pa.RecordBatch]:
    """Long documents (doc_id, text, found: the runs of each range)."""
    for batch in batches:
        for doc_id, text, found in zip(batch.column(0).to_pylist(), strings(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            words = text.as_py().encode().split()
            every = np.frombuffer(b"".join(found or []), dtype="<i8").reshape(-1, 3)
            yield _batch([_answer(doc_id, words, planted(doc_id, len(words)) if plant else None, every[np.lexsort((every[:, 2], every[:, 0]))])])


def collapse(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False, long_bytes: int = LONG_BYTES) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256), a row for each row of documents.

    Words are maximal runs of other than ASCII white space and are equal by a 64-bit fingerprint. start, length, period and
    exponent_milli are of the longest run (of equal ones the first, then that of the smallest period) and null without a run;
    runs_sha256 is of the lines `start,length,period` of all runs, collapsed_sha256 of the words that no run repeats,
    joined by one space. plant first makes ends of some texts periodic (see planted; never of rows without an id). Null and empty texts have no words and
    no runs; repeated rows are rows like any other; an empty table gives no rows; other columns are not read.
    """
    small_batches(documents.sparkSession)
    docs = ids_first(documents, id_col, text_col)
    size = F.octet_length("text")
    short = docs.where(F.coalesce(size, F.lit(0)) <= long_bytes).mapInArrow(lambda it: _whole(it, plant), SCHEMA)
    long_ = docs.where(size > long_bytes).withColumn("text_key", F.xxhash64("text"))
    parts = F.least(F.lit(MOST_RANGES), F.lit(1) + (size / long_bytes).cast("int"))
    dealt = long_.dropDuplicates(["doc_id", "text_key"]).withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    spread = dealt.select("doc_id", "text", "text_key", "part", "parts").repartition("doc_id", "text_key", "part")
    found = spread.mapInArrow(lambda it: _ranges(it, plant), "doc_id long, text_key long, found binary").groupBy("doc_id", "text_key").agg(F.collect_list("found").alias("found"))
    same = F.expr("a.doc_id <=> f.doc_id AND a.text_key = f.text_key")
    whole = long_.alias("a").join(found.alias("f"), same, "left").select("a.doc_id", "a.text", "f.found").mapInArrow(lambda it: _joined(it, plant), SCHEMA)
    return short.unionByName(whole)
