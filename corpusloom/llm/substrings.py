"""Substring dedup by recompression.

Words become 64-bit symbols. Round by round, first maximal runs of one symbol are named, then the pairs of a left-class
symbol followed by a right-class one; a symbol's class is a bit of its name. A name is a fingerprint of what it stands
for, so all tasks of Spark give equal runs and pairs equal names in every round, without a dictionary that would
have to be shuffled. The number of rounds grows with the windows' width. Which neighbours a
symbol's making depended on is carried along as an extent of words: where two documents share a passage, every symbol
whose extent lies inside it is the same in both.

Each window of words is led by one symbol inside it: of the highest round that has one, and there the one with the least
name. Equal windows are led by equal symbols, so windows are dealt out by their leader: where documents share a high symbol, their
windows meet, and are compared by the whole 64-bit fingerprint of the window. Leaders of very many windows
(found in a sample of the documents) are dealt out by the window's fingerprint as well.

Within one block of a task a window is sent once, for the least document that has it (the other ones
are settled on the spot), so that a passage that a third of all documents share is sent once a block.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import Block, blocks, ids_first, is_empty, materialise, mix, rolling, small_batches, sole, strings

TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
BLOCK = 2 << 20
PART_BYTES = 8 << 20
"""Text bytes whose windows meet in one part, so that a part's memory doesn't grow with the input."""
FAN = 4096
"""More parts than so many are dealt to in two steps, so that what a block sends to a part doesn't get too small."""
SAMPLED = 16
"""One document in so many, by a hash, is looked at for leaders of very many windows; which they are changes only where windows meet."""
HOT_LEADERS = 100_000
MARKED = 1 << 20
"""Parts of the range of hashes of ids; texts in a part without a repeat are not shuffled."""
NO_ID = np.int64(2**63 - 1)
"""Stands for rows without an id inside; see with_free_top."""


class Symbols:
    """Symbols of one level: names, the words first .. last (exclusive) they stand for, and the extent that fixed them. Extents ascend from symbol to symbol."""

    __slots__ = ("name", "first", "last", "low", "high", "row")

    def __init__(self, name, first, last, low, high, row):
        self.name, self.first, self.last, self.low, self.high, self.row = name, first, last, low, high, row


def words_as_symbols(hashes: np.ndarray, rows: np.ndarray) -> Symbols:
    at = np.arange(len(hashes))
    return Symbols(hashes, at, at + 1, at, at + 1, rows)


def name_runs(s: Symbols, level: int) -> Symbols:
    """Replaces each maximal run of one symbol. Neighbours inside the row are part of what fixed it."""
    n = len(s.name)
    if not n:
        return s
    head = np.ones(n, dtype=bool)
    head[1:] = (s.name[1:] != s.name[:-1]) | (s.row[1:] != s.row[:-1])
    begin = np.flatnonzero(head)
    end = np.append(begin[1:], n)
    many = (end - begin).astype(np.uint64)
    name = np.where(many > 1, mix(s.name[begin] + many * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(level)), s.name[begin])
    row = s.row[begin]
    low, high = s.low[begin].copy(), s.high[end - 1].copy()
    same = row[1:] == row[:-1]
    low[1:] = np.where(same, np.minimum(low[1:], s.low[begin[1:] - 1]), low[1:])
    high[:-1] = np.where(same, np.maximum(high[:-1], s.high[end[:-1]]), high[:-1])
    # At a row's edge there is no neighbour to look at, which only this row knows: the extent goes beyond it.
    edge = np.append(True, ~same)
    low = np.where(edge, low - 1, low)
    high = np.where(np.append(~same, True), high + 1, high)
    return Symbols(name, s.first[begin], s.last[end - 1], low, high, row)


def name_pairs(s: Symbols, level: int) -> Symbols:
    """Replaces each left-class symbol that a right-class one follows, with it."""
    n = len(s.name)
    if n < 2:
        return s
    right = ((s.name >> np.uint64(17 + level)) & np.uint64(1)).astype(bool)
    same = s.row[1:] == s.row[:-1]
    starts = np.append(~right[:-1] & right[1:] & same, False)
    second = np.append(False, starts[:-1])
    keep = ~second
    at = np.flatnonzero(keep)
    paired = starts[at]
    to = at + paired
    name = s.name[at].copy()
    name[paired] = mix(s.name[at[paired]] * np.uint64(0x9FB21C651E98DF25) + mix(s.name[to[paired]] + np.uint64(level + 1)))
    low, high = s.low[at].copy(), s.high[to].copy()
    # A lone right-class symbol depends on what stands before it, a lone left-class one on what follows.
    alone_right = ~paired & right[at]
    alone_left = ~paired & ~right[at]
    before = np.maximum(at - 1, 0)
    has = (at > 0) & (s.row[before] == s.row[at])
    low = np.where(alone_right, np.where(has, np.minimum(low, s.low[before]), low - 1), low)
    after = np.minimum(at + 1, n - 1)
    has = (at < n - 1) & (s.row[after] == s.row[at])
    high = np.where(alone_left, np.where(has, np.maximum(high, s.high[after]), high + 1), high)
    return Symbols(name, s.first[at], s.last[to], low, high, s.row[at])


def rounds_for(width: int) -> int:
    """Rounds after which symbols are about a third as long as the windows, so that with the neighbours that fixed them they fit inside: a round makes them 4/3 as long."""
    return max(2, round(math.log(width / 3, 4 / 3)))


def least_inside(key: np.ndarray, low: np.ndarray, high: np.ndarray, n: int, width: int) -> np.ndarray:
    """For each window start 0 .. n - 1 the least key of the symbols whose extent [low, high) lies inside the window; TOP without one.

    Extents ascend, so the symbols inside a window stand together; the least of each stretch comes from the least ones of
    stretches of powers of two.
    """
    first = np.cumsum(np.bincount(np.clip(low + 1, 0, n), minlength=n + 1))[:n]
    many = np.cumsum(np.bincount(np.clip(high - width, 0, n), minlength=n + 1))[:n] - first
    table = [key]
    while (1 << len(table)) <= max(1, int(many.max(initial=0))):
        half = 1 << (len(table) - 1)
        last = table[-1]
        table.append(np.concatenate([np.minimum(last[:-half], last[half:]), last[len(last) - half :]]) if len(last) > half else last)
    out = np.full(n, TOP)
    step = np.zeros(n, dtype=np.int64)
    some = many > 0
    step[some] = np.log2(many[some]).astype(np.int64)
    for k in range(len(table)):
        own = np.flatnonzero(some & (step == k))
        if len(own):
            out[own] = np.minimum(table[k][first[own]], table[k][first[own] + many[own] - (1 << k)])
    return out


def leaders(hashes: np.ndarray, rows: np.ndarray, bounds: np.ndarray, width: int, rounds: int | None = None) -> np.ndarray:
    """For each window start (word positions 0 .. n - width), the name of its leading symbol.

    Windows that cross a row's end get a name as well; callers leave them out.
    """
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    # Where no symbol lies inside (long runs), the middle word leads; whether that is so depends on the window alone.
    lead = mix(hashes[width // 2 : width // 2 + n] ^ np.uint64(0x5851F42D4C957F2D))
    s = words_as_symbols(hashes, rows)
    begin, end = bounds[:-1][rows], bounds[1:][rows]
    for level in range(rounds or rounds_for(width)):
        s = name_pairs(name_runs(s, level), level)
        # Of an extent beyond its row it matters only that it is; so cut, extents ascend over rows too.
        low, high = np.maximum(s.low, begin[s.first] - 1), np.minimum(s.high, end[s.first] + 1)
        here = least_inside(mix(s.name + np.uint64(level)), low, high, n, width)
        lead = np.where(here != TOP, here, lead)
    return lead


def windows(block: Block, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in the row's words, leader, fingerprint) of every window inside a row."""
    counts = np.diff(block.bounds)
    rows = np.repeat(np.arange(block.rows), counts)
    n = max(0, len(block.hashes) - width + 1)
    at = np.flatnonzero(rows[:n] == rows[width - 1 : width - 1 + n]) if n else np.zeros(0, np.int64)
    lead = leaders(block.hashes, rows, block.bounds, width)
    print_ = rolling(block.hashes, width)
    return rows[at], at - block.bounds[rows[at]], lead[at], print_[at]


# -- packets -----------------------------------------------------------------------------------

PACKET = ("ids", "keys", "places", "marks", "subs")
PACKET_SCHEMA = ", ".join(f"{c} binary" for c in PACKET)


def pack(ids: np.ndarray, keys: np.ndarray | None, r: np.ndarray, place: np.ndarray, mark: np.ndarray, sub: np.ndarray | None) -> tuple[bytes, ...]:
    """Windows (r counts rows of ids; r and place ascend) as bytes. Ids as differences; keys are left out where ids tell all rows apart, and sub, which part of a group is meant, where there is one step."""
    return (
        np.diff(ids, prepend=np.int64(0)).astype("<i8").tobytes(), b"" if keys is None else keys.astype("<i8").tobytes(), ranges_by(r, place, len(ids)), mark.astype("<u8").tobytes(),
        b"" if sub is None else sub.astype("<u2").tobytes(),
    )


def unpack(packet: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, keys (zeros where left out), row, place, fingerprint)."""
    ids = np.cumsum(np.frombuffer(packet["ids"], "<i8"))
    keys = np.frombuffer(packet["keys"], "<i8") if len(packet["keys"]) else np.zeros(len(ids), np.int64)
    row, place = _spread(packet["places"], len(ids))
    return ids, keys, row, place, np.frombuffer(packet["marks"], "<u8")


def ranges_by(r: np.ndarray, place: np.ndarray, rows: int) -> bytes:
    """The places of each row (r ascending, places ascending in a row) as ranges, with a count of them a row, in two bytes a number where that will do and else four: the first byte says."""
    if not len(r):
        return b""
    cut = np.flatnonzero((np.diff(place) != 1) | (np.diff(r) != 0)) + 1
    begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(r)]])
    x = np.concatenate([np.bincount(r[begin], minlength=rows), place[begin], end - begin])
    return b"\2" + x.astype("<u2").tobytes() if x.max() < 1 << 16 else b"\4" + x.astype("<u4").tobytes()


def _spread(raw: bytes, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The opposite of ranges_by: (row, place)."""
    raw = memoryview(raw)
    x = np.frombuffer(raw[1:], dtype="<u2" if bytes(raw[:1]) == b"\2" else "<u4").astype(np.int64)
    n = (len(x) - rows) // 2
    row = np.repeat(np.arange(rows), x[:rows])
    start, length = x[rows : rows + n], x[rows + n :]
    first = np.repeat(np.cumsum(length) - length, length)
    return np.repeat(row, length), np.repeat(start, length) + np.arange(int(length.sum())) - first


def settled_rows(row: np.ndarray, place: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> bytes:
    """Windows to remove, as one blob: number of rows, ids, text keys, then ranges."""
    if not len(row):
        return b""
    rows_, r = np.unique(row, return_inverse=True)
    return np.int64(len(rows_)).tobytes() + ids[rows_].astype("<i8").tobytes() + keys[rows_].astype("<i8").tobytes() + ranges_by(r, place, len(rows_))


def parts_of(lead: np.ndarray, mark: np.ndarray, parts: int, hot: np.ndarray) -> np.ndarray:
    """Where a window is compared: by its leader, of a hot leader by its fingerprint too."""
    if not len(hot):
        return (lead % np.uint64(parts)).astype(np.int64)
    spot = np.minimum(np.searchsorted(hot, lead), len(hot) - 1)
    return (np.where(hot[spot] == lead, mix(lead ^ mark), lead) % np.uint64(parts)).astype(np.int64)


def _split(ids, keys, row, place, mark, part, low: int, high: int, sub=None):
    """(part, packet) of each part of low .. high - 1 that has windows."""
    to = np.lexsort((place, row, part))
    edges = np.searchsorted(part[to], np.arange(low, high + 1))
    for p in np.flatnonzero(np.diff(edges)).tolist():
        mine = to[edges[p] : edges[p + 1]]
        rows_, r = np.unique(row[mine], return_inverse=True)
        yield low + p, pack(ids[rows_], None if keys is None else keys[rows_], r, place[mine], mark[mine], None if sub is None else sub[mine])


# -- stages ------------------------------------------------------------------------------------


def _ids(column: pa.Array) -> np.ndarray:
    nulls = column.is_null().to_numpy(zero_copy_only=False)
    return np.where(nulls, NO_ID, column.fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["part", *PACKET, "settled"]
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.binary() if i else pa.int32()) for i in range(len(names))], names)


def _sent(batches: Iterator[pa.RecordBatch], width: int, parts: int, groups: int, hot: np.ndarray, keyed: bool) -> Iterator[pa.RecordBatch]:
    """Per block and group of parts: the block's distinct windows; and the windows that the block itself settles, with one of the groups."""
    sole()
    size = -(-parts // groups)
    for batch in batches:
        every, text_keys = _ids(batch.column(0)), batch.column(2).to_numpy(zero_copy_only=False)
        for b in blocks(batch.column(1), size=BLOCK):
            ids, texts = every[b.first : b.first + b.rows], text_keys[b.first : b.first + b.rows]
            row, place, lead, mark = windows(b, width)
            if not len(row):
                continue
            doc = ids[row]
            order = np.lexsort((doc, mark))
            m = mark[order]
            new = np.append(True, m[1:] != m[:-1])
            least = np.empty(len(order), dtype=np.int64)
            least[order] = doc[order][new][np.cumsum(new) - 1]
            hit, keep = np.flatnonzero(doc > least), np.flatnonzero(doc == least)
            part = parts_of(lead[keep], mark[keep], parts, hot)
            out = [(p, *packet, b"") for p, packet in _split(ids, texts if keyed else None, row[keep], place[keep], mark[keep], part // size, 0, groups, part % size if size > 1 else None)]
            if len(hit):
                # Any part can pass them on; a hash of the block's first document picks one, so all parts get their share.
                to = int(mix(ids[:1].view(np.uint64))[0] % np.uint64(groups))
                out.append((to, *[b""] * len(PACKET), settled_rows(row[hit], place[hit], ids, texts if keyed else np.zeros(len(ids), np.int64))))
            yield _batch(out)


def _dealt_again(batches: Iterator[pa.RecordBatch], parts: int, groups: int, keyed: bool) -> Iterator[pa.RecordBatch]:
    """The second step: packets of a group, several blocks' at a time, dealt to its parts. Rows come sorted by group."""
    sole()
    size = -(-parts // groups)
    held: list[dict] = []

    def flush() -> pa.RecordBatch:
        low = held[0]["part"] * size
        out = [(low + zlib.crc32(x["settled"][8:16]) % size, *[b""] * len(PACKET), x["settled"]) for x in held if len(x["settled"])]
        got = [(*unpack(x), np.frombuffer(x["subs"], "<u2")) for x in held if len(x["ids"])]
        if got:
            starts = np.cumsum([0] + [len(g[0]) for g in got])
            row = np.concatenate([g[2] + s for g, s in zip(got, starts, strict=False)])
            ids, keys, place, mark, sub = (np.concatenate([g[i] for g in got]) for i in (0, 1, 3, 4, 5))
            out += [(p, *packet, b"") for p, packet in _split(ids, keys if keyed else None, row, place, mark, low + sub.astype(np.int64), low, low + size)]
        held.clear()
        return _batch(out)

    total = 0
    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["part"] != held[0]["part"] or total > BLOCK):
                yield flush()
                total = 0
            held.append(row)
            total += len(row["marks"])
    if held:
        yield flush()


def _found(table: pa.Table, buckets: int) -> pa.Table:
    """Of one part: the windows whose fingerprint a smaller document has too, as ranges, packed by bucket of documents."""
    sole()
    found = []

    def emit(ids: np.ndarray, keys: np.ndarray, row: np.ndarray, place: np.ndarray) -> None:
        """row and place ascend."""
        if len(row):
            cut = np.flatnonzero((np.diff(place) != 1) | (np.diff(row) != 0)) + 1
            begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(row)]])
            found.append((ids[row[begin]], keys[row[begin]], place[begin].astype("<i4"), (end - begin).astype("<i4")))

    sizes = [len(table.column("marks")[i].as_buffer()) // 8 for i in range(table.num_rows)]
    row, place, mark = np.empty(sum(sizes), np.int32), np.empty(sum(sizes), np.int32), np.empty(sum(sizes), np.uint64)
    docs, texts, at, start = [], [], 0, 0
    for i, n in enumerate(sizes):
        packet = {c: table.column(c)[i].as_buffer() for c in (*PACKET, "settled")}
        if len(packet["settled"]):
            raw = memoryview(packet["settled"])
            k = int(np.frombuffer(raw[:8], dtype="<i8")[0])
            both = np.frombuffer(raw[8 : 8 + 16 * k], dtype="<i8")
            emit(both[:k], both[k:], *_spread(raw[8 + 16 * k :], k))
        if n:
            ids, keys, own, own_place, mark[at : at + n] = unpack(packet)
            row[at : at + n], place[at : at + n] = own + start, own_place
            docs.append(ids)
            texts.append(keys)
            at, start = at + n, start + len(ids)
    buckets = max(1, buckets)
    del table
    if at:
        docs, texts = np.concatenate(docs), np.concatenate(texts)
        order = np.argsort(mark, kind="stable")
        mark = mark[order]
        begin = np.flatnonzero(np.append(True, mark[1:] != mark[:-1]))
        del mark
        doc = docs[row[order]]
        hit = order[doc > np.repeat(np.minimum.reduceat(doc, begin), np.diff(np.append(begin, at)))]
        del order, doc
        hit = hit[np.lexsort((place[hit], row[hit]))]
        if len(hit):
            which, r = np.unique(row[hit], return_inverse=True)
            emit(docs[which], texts[which], r, place[hit].astype(np.int64))
    cols = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 4
    to = (mix(cols[0].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    edges = np.searchsorted(to[order], np.arange(buckets + 1))
    rows = [(k, *(c[order[edges[k] : edges[k + 1]]].tobytes() for c in cols)) for k in np.flatnonzero(np.diff(edges)).tolist()]
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate((("bucket", pa.int32()), ("ids", pa.binary()), ("keys", pa.binary()), ("starts", pa.binary()), ("lengths", pa.binary())))})


def _by_document(table: pa.Table) -> pa.Table:
    """Of one bucket: all ranges of each text."""
    ids, keys, starts, lengths = (np.frombuffer(b"".join(table.column(c).to_pylist()), dtype=t) for c, t in (("ids", "<i8"), ("keys", "<i8"), ("starts", "<i4"), ("lengths", "<i4")))
    order = np.lexsort((starts, keys, ids))
    ids, keys, pair = ids[order], keys[order], np.stack([starts[order], lengths[order]], axis=1)
    begin = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]))) if len(ids) else np.zeros(0, np.int64)
    end = np.append(begin[1:], len(ids))
    return pa.table({"doc_id": pa.array([None if x == NO_ID else x for x in ids[begin].tolist()], pa.int64()), "text_key": pa.array(keys[begin], pa.int64()), "found": pa.array([pair[a:b].tobytes() for a, b in zip(begin, end, strict=True)], pa.binary())})


def covered(found: bytes, words: int, width: int) -> np.ndarray:
    """Which words the removed windows cover."""
    edge = np.zeros(words + 1, dtype=np.int32)
    x = np.frombuffer(found, dtype="<i4").reshape(-1, 2)
    np.add.at(edge, x[:, 0], 1)
    np.add.at(edge, x[:, 0] + x[:, 1] + width - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def keyed(documents: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, text_key, and a struct of the columns to keep): the key tells rows of one id and other texts apart."""
    docs = ids_first(documents.withColumn("_kept", F.struct(*keep)) if keep else documents, id_col, text_col, ("_kept",) if keep else ())
    return docs.withColumn("text_key", F.xxhash64("text"))


def hot_leaders(docs: DataFrame, width: int, parts: int) -> np.ndarray:
    """Leaders that lead over half a part's share of the windows of one document in SAMPLED, HOT_LEADERS at most; sorted."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole()
        for batch in batches:
            for b in blocks(batch.column(0), size=BLOCK):
                lead = windows(b, width)[2]
                names, n = np.unique(lead, return_counts=True)
                often = n * 8 * parts >= len(lead)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(names[often].view(np.int64), 0)), pa.array(np.append(n[often], len(lead))), pa.array(np.append(np.zeros(int(often.sum()), bool), True))], ["lead", "n", "every"])

    some = docs.where(F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(SAMPLED)) == 0).select("text")
    counts = some.mapInArrow(counted, "lead long, n long, every boolean").groupBy("lead", "every").agg(F.sum("n").alias("n"))
    most = counts.orderBy(F.desc("every"), F.desc("n")).limit(HOT_LEADERS).collect()
    total = sum(r["n"] for r in most if r["every"])
    return np.sort(np.array([r["lead"] for r in most if not r["every"] and r["n"] * 2 * parts > total], dtype=np.int64).view(np.uint64))


def part_count(docs: DataFrame) -> int:
    """Parts of about PART_BYTES of text, and some for every core."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(4 * docs.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES))


def with_free_top(docs: DataFrame) -> tuple[DataFrame, Column]:
    """docs with ids in the same order of which none is NO_ID, and the column of the old ids.

    Where the greatest 64-bit number is an id, those above a number that is none move down by one.
    """
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    doc_id = F.col("doc_id")
    if high != int(NO_ID):
        return docs, doc_id
    gap = -(2**63)
    if low == gap:
        ids = docs.select("doc_id").where("doc_id IS NOT NULL")
        above = ids.where(doc_id < int(NO_ID)).select((doc_id + 1).alias("doc_id"))
        gap = above.join(ids, "doc_id", "left_anti").agg(F.min("doc_id")).first()[0]
    moved = docs.withColumn("doc_id", F.when(doc_id > gap, doc_id - 1).otherwise(doc_id))
    return moved, F.when(doc_id >= gap, doc_id + 1).otherwise(doc_id).alias("doc_id")


def repeated(documents: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """(doc_id, text_key, found): for each text with windows that start in a smaller document too, ranges of them; text_key is 0 where ids tell all rows apart."""
    small_batches(documents.sparkSession)
    docs = keyed(documents, id_col, text_col)
    twice = not is_empty(docs.groupBy("doc_id").count().where("count > 1"))
    docs, own_id = with_free_top(docs)
    parts = parts or part_count(docs)
    hot = hot_leaders(docs, width, parts)
    groups = parts if parts <= FAN else math.ceil(math.sqrt(parts))
    schema = f"part int, {PACKET_SCHEMA}, settled binary"
    sent = docs.mapInArrow(lambda it: _sent(it, width, parts, groups, hot, twice), schema)
    if groups < parts:
        sent = sent.repartition(min(groups, 2000), "part").sortWithinPartitions("part").mapInArrow(lambda it: _dealt_again(it, parts, groups, twice), schema)
    buckets = min(parts, FAN)
    hits = sent.groupBy("part").applyInArrow(lambda t: _found(t, buckets), "bucket int, ids binary, keys binary, starts binary, lengths binary")
    out = hits.groupBy("bucket").applyInArrow(_by_document, "doc_id long, text_key long, found binary").select(own_id, "text_key", "found")
    return out if twice else out.withColumn("text_key", F.lit(0).cast("long"))


def remove(documents: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text", texts: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept, and the columns to keep as a struct _kept), a row for each row of documents.

    A word goes if a window of width words that covers it starts, word for word, in a document with a
    smaller id as well; windows are judged on the input. kept is the text as it was where nothing goes, else
    the words left joined by one space; kept_sha256 is always of the words left joined by one space. Null text: no words.
    Rows of one id are never each other's smaller document; a row without an id counts as after all others
    and takes nothing from them. An empty table gives no rows; other columns are not read.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, sha, kept = [], [], [], []
            given = batch.column(1).to_pylist()
            for old, raw, found in zip(given, strings(batch.column(1)).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = raw.encode().split()
                n.append(len(words))
                if found:
                    out = covered(found, len(words), width)
                    words = [words[i] for i in np.flatnonzero(~out).tolist()]
                    gone.append(int(out.sum()))
                    joined = b" ".join(words)
                    kept.append(joined.decode() if texts else None)
                else:
                    gone.append(0)
                    joined = b" ".join(words)
                    kept.append(old if texts else None)
                sha.append(hashlib.sha256(joined).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string()), *batch.columns[3:]], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"] + ["_kept"] * bool(keep))

    base = keyed(documents, id_col, text_col, keep)
    parts = part_count(base)
    found = materialise(repeated(documents, width, id_col, text_col, parts), "repeats")
    exact = found.agg(F.max(F.abs("text_key"))).first()[0] in (None, 0)  # ids tell all rows apart, or nothing is repeated
    rest = ["_kept"] * bool(keep)
    more = f", _kept {base.schema['_kept'].dataType.simpleString()}" if keep else ""
    same = F.expr("a.doc_id <=> f.doc_id" if exact else "a.doc_id <=> f.doc_id AND a.text_key = f.text_key")
    # Texts whose part of the range of hashes has no repeat stay where they are; the table of parts has MARKED rows at most.
    part = F.pmod(F.xxhash64("doc_id"), F.lit(MARKED))
    marked = F.broadcast(found.select(part.alias("_part")).distinct())
    dealt = base.withColumn("_part", part)
    clean = dealt.join(marked, "_part", "left_anti").select("doc_id", "text", F.lit(None).cast("binary").alias("found"), *rest)
    hit = dealt.join(marked, "_part", "left_semi").alias("a").join(found.alias("f"), same, "left").select("a.doc_id", "a.text", "f.found", *[f"a.{c}" for c in rest])
    both = clean.unionByName(hit).coalesce(parts)  # the two would make twice as many tasks and files
    return both.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string" + more)
