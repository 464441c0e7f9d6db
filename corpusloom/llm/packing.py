"""Best-fit packing by patterns: a non-negative least-squares fit of repeat counts to the length histogram.

The plan depends on the histogram alone (at most `capacity` lengths), so its size and the time to make
it don't grow with the corpus. Few-document length patterns that fill a sequence are enumerated,
their repeat counts fitted to the histogram and rounded down; what is left is packed best-fit
decreasing, again pattern by pattern. Rows then find their place by their rank among the pieces of
the same length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.bpe import codec
from corpusloom.llm.shared import ids_first, materialise, small_batches, strings

PART_ROWS, MOST_PARTS = 1000, 200_000
"""Pieces of one length are dealt to parts of about PART_ROWS to be ranked, or of more where that would make over MOST_PARTS parts: a frequent length is many tasks', and the driver gets one row a part."""


@dataclass
class Plan:
    """Slots: pieces number low .. high-1 of a length go to sequences first, first+1, ... at offset."""

    length: np.ndarray
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray
    offset: np.ndarray
    sequences: int


def few_document_patterns(lengths: np.ndarray, capacity: int, waste: int) -> list[tuple[int, ...]]:
    """Patterns of one to four lengths, largest first, whose sum lies within waste of the capacity.

    For each large length: the partner that fits best, and for some middle lengths the best third and
    fourth. All lengths occur in the histogram.
    """
    present = np.sort(lengths)

    def best(room: int) -> int | None:
        i = int(np.searchsorted(present, room, side="right")) - 1
        return int(present[i]) if i >= 0 else None

    found = set()
    for a in present.tolist():
        if a >= capacity - waste:
            found.add((a,))
        if (b := best(capacity - a)) is None:
            continue
        if a + b >= capacity - waste:
            found.add(tuple(sorted((a, b), reverse=True)))
        for share in (2, 3, 4):
            if (b := best((capacity - a) // share)) is None or (c := best(capacity - a - b)) is None:
                continue
            if a + b + c >= capacity - waste:
                found.add(tuple(sorted((a, b, c), reverse=True)))
            if (c := best((capacity - a - b) // 2)) is not None and (d := best(capacity - a - b - c)) is not None and a + b + c + d >= capacity - waste:
                found.add(tuple(sorted((a, b, c, d), reverse=True)))
    return sorted(found, reverse=True)


def fit_counts(patterns: list[tuple[int, ...]], lengths: np.ndarray, counts: np.ndarray, steps: int = 300) -> np.ndarray:
    """Non-negative least squares by multiplicative updates, whose matrix has at most four entries a column."""
    row = {int(x): i for i, x in enumerate(lengths)}
    col = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    at = np.array([row[x] for p in patterns for x in p], dtype=np.int64)
    h = counts.astype(float)
    aim = np.bincount(col, weights=h[at], minlength=len(patterns))
    x = np.full(len(patterns), max(1e-9, h.sum() / max(1, len(at))))
    for _ in range(steps):
        made = np.bincount(at, weights=x[col], minlength=len(lengths))
        x *= aim / np.maximum(np.bincount(col, weights=made[at], minlength=len(patterns)), 1e-12)
    return x


def plan(lengths: np.ndarray, counts: np.ndarray, capacity: int, waste: int = 0) -> Plan:
    """Places counts[i] pieces of lengths[i] (1 .. capacity, each once) in sequences."""
    left = {int(a): int(n) for a, n in zip(lengths, counts, strict=True) if n > 0}
    chosen: list[tuple[tuple[int, ...], int]] = []

    def take(pattern: tuple[int, ...], times: int) -> None:
        for a in pattern:
            left[a] -= times
        chosen.append((pattern, times))

    if left:
        sizes = np.array(sorted(left), dtype=np.int64)
        patterns = few_document_patterns(sizes, capacity, waste)
        if patterns:
            fitted = fit_counts(patterns, sizes, np.array([left[int(x)] for x in sizes]))
            for i in np.argsort(-fitted, kind="stable").tolist():
                times = min(int(fitted[i]), *(left[a] // patterns[i].count(a) for a in set(patterns[i])))
                if times > 0:
                    take(patterns[i], times)
    # The residual, best-fit decreasing: the largest piece left, then always the largest one that still fits.
    present = sorted(a for a, n in left.items() if n > 0)
    while present:
        pattern, room, used = [], capacity, {}
        top = len(present) - 1
        while top >= 0:
            a = present[top]
            if a > room:
                top = int(np.searchsorted(present[: top + 1], room, side="right")) - 1
                continue
            many = min(room // a, left[a] - used.get(a, 0))
            if many > 0:
                pattern += [a] * many
                used[a] = used.get(a, 0) + many
                room -= a * many
            top -= 1
        times = max(1, min(left[a] // n for a, n in used.items()))
        take(tuple(pattern), times)
        if any(left[a] == 0 for a in used):
            present = [a for a in present if left[a] > 0]
    rows, sequence, seen = [], 0, {}
    for pattern, times in chosen:
        offset = 0
        for a in pattern:
            low = seen.get(a, 0)
            rows.append((a, low, low + times, sequence, offset))
            seen[a] = low + times
            offset += a
        sequence += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return Plan(*(table[:, i].copy() for i in range(5)), sequences=sequence)


def pieces(documents: DataFrame, vocabulary: str, capacity: int, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", cache_size: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and end_id, cut only where longer than capacity; cache_size as in codec()."""
    small_batches(documents.sparkSession)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary, cache_size=cache_size)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            doc, piece, start, length, crc = [], [], [], [], []
            for key, parts in zip(ids, c.encode_many(strings(batch.column(1)).to_pylist()), strict=True):
                raw = b"".join(parts) + end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    cut = raw[at : at + 4 * capacity]
                    doc.append(key)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(cut) // 4)
                    crc.append(zlib.crc32(cut))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return ids_first(documents, id_col, text_col).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def assign(found: DataFrame, capacity: int) -> DataFrame:
    """found (doc_id, piece, length, ...; lengths 1 .. capacity) with sequence_id and offset added.

    A sequence is gapless from 0 and holds at most capacity tokens. found must be cheap to read again:
    it is read for its histogram, for that of the parts, and to be placed.
    """
    counts = found.groupBy("length").count().toPandas()  # at most capacity rows
    size = max(PART_ROWS, int(counts["count"].sum()) // MOST_PARTS)
    parts = [(int(a), -(-int(n) // size)) for a, n in zip(counts["length"], counts["count"], strict=True)]
    by_length = F.broadcast(found.sparkSession.createDataFrame(parts, "_length long, _parts long"))
    dealt = found.join(by_length, found["length"] == F.col("_length")).withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.col("_parts")).cast("int")).drop("_length", "_parts")
    tally = dealt.groupBy("length", "_part").count().toPandas()  # at most MOST_PARTS rows and one a length, whatever the corpus
    tally = tally.sort_values(["length", "_part"])
    totals = tally.groupby("length")["count"].sum()
    made = plan(totals.index.to_numpy(dtype=np.int64), totals.to_numpy(dtype=np.int64), capacity)
    tally["before"] = tally.groupby("length")["count"].cumsum() - tally["count"]
    base_key = tally["length"].to_numpy(dtype=np.int64) * (1 << 20) + tally["_part"].to_numpy(dtype=np.int64)
    base = tally["before"].to_numpy(dtype=np.int64)
    shift = np.int64(44)
    slot_key = (made.length << shift) + made.low
    rank = F.row_number().over(Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "start"))
    ranked = dealt.withColumn("_rank", rank.cast("long") - 1)
    names = found.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema) + ", sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, part, number = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_part", "_rank"))
            number = number + (base[np.searchsorted(base_key, (length << 20) + part)] if len(length) else 0)
            slot = np.searchsorted(slot_key, (length << shift) + number, side="right") - 1
            sequence = made.first[slot] + number - made.low[slot]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(sequence, pa.int64()), pa.array(made.offset[slot], pa.int64())], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def pack(documents: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", cache_size: int = 0) -> DataFrame:
    """Packs every document: (doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row a piece.

    Null and empty texts are one piece that holds end_id alone; repeated rows and null ids are packed like
    any other row; an empty table gives no rows; longer texts are cut into pieces of capacity tokens, the
    last one shorter. A smaller cache_size takes less memory a worker and more time. Other columns of documents are not read, whatever their names.
    """
    return assign(materialise(pieces(documents, vocabulary, capacity, end_id, id_col, text_col, cache_size), "pieces"), capacity)
