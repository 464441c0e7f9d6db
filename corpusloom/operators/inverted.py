"""Compressed inverted lists: coarse cells, product-quantised residuals, exact answers over the probed cells (RTR-03, RTR-04, RTR-05, JOIN-09).

A vector is kept as its cell, one byte for each of `parts` slices of its residual, and the length of what the bytes miss. A query's
inner product with it is known up to that length times the query's own, so a block of a list gives the vectors which can be among
the best, and only those are compared exactly. With all cells probed the answer is that of a full search.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.retrieval import _cell_blocks, best_products

CODES = 256
BLOCK = 4096
"""Vectors of one block of a list."""
QUERIES = 512
"""Queries of one block of those that a cell is probed by."""
SALTS = 16
"""Tasks that a cell's vectors are packed in."""


@dataclass
class Codebooks:
    """What an index is trained to: cells (c x d) and, for each slice of the dimensions, the centres of the residuals."""

    cells: np.ndarray
    slices: list[slice]
    books: list[np.ndarray]

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return _nearest(x, self.cells)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, codes, length of what they miss)."""
        own = self.nearest(x)
        rest = x - self.cells[own]
        codes = np.empty((len(x), len(self.books)), dtype=np.uint8)
        for i, (part, book) in enumerate(zip(self.slices, self.books, strict=True)):
            codes[:, i] = _nearest(rest[:, part], book)
            rest[:, part] -= book[codes[:, i]]
        return own, codes, np.sqrt((rest**2).sum(axis=1))

    def scores(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Inner products of a query with the encoded vectors of a cell, from one table a slice."""
        out = np.full(len(codes), float(q @ self.cells[cell]))
        for i, (part, book) in enumerate(zip(self.slices, self.books, strict=True)):
            out += (book @ q[part])[codes[:, i]]
        return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1)[None] - 2 * x @ centres.T, axis=1)


def _matrix(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _lloyd_sums(rows: DataFrame, vector_col: str, assign: Callable[[np.ndarray], Iterator[tuple[int, np.ndarray, np.ndarray, int]]]) -> list:
    """(part, code, sum, n) rows of one Lloyd step: tasks sum up their vectors by centre, then the centres' partial sums meet. The driver receives one row a centre."""

    def partial(batches):
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            if not len(b):
                continue
            for part, x, own, many in assign(_matrix(b[vector_col])):
                if part not in held:
                    held[part] = np.zeros((many, x.shape[1])), np.zeros(many, np.int64)
                np.add.at(held[part][0], own, x)
                held[part][1][:] += np.bincount(own, minlength=many)
        for part, (s, n) in held.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"part": part, "code": at, "s": list(s[at]), "n": n[at]})

    def total(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": frame["part"][:1], "code": frame["code"][:1], "s": [np.sum(np.stack(frame["s"].to_numpy()), axis=0)], "n": [frame["n"].sum()]})

    kind = "part int, code int, s array<double>, n long"
    return rows.mapInPandas(partial, kind).groupBy("part", "code").applyInPandas(total, kind).collect()


def train(vectors: DataFrame, cells: int, parts: int = 8, rounds: int = 8, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 42) -> Codebooks:
    """RTR-03: cells and codebooks by Lloyd steps over all vectors.

    The centres begin as the vectors (then residuals) of least seeded hash, as many as there are centres; in each step every task adds
    up its vectors by nearest centre, and only sums move. Centres without vectors stay where they are. Null vectors are
    left out; an empty table gives no cells.
    """
    own = vectors.where(F.col(vector_col).isNotNull()).select(id_col, vector_col)
    first = [r[0] for r in own.orderBy(F.xxhash64(F.lit(seed), id_col), id_col).select(vector_col).limit(max(cells, CODES)).collect()]  # bounded by the number of centres
    x = np.array(first, dtype=np.float64)
    if not len(x):
        return Codebooks(np.zeros((0, 0)), [], [])
    centres = x[:cells].copy()
    for _ in range(rounds):
        for r in _lloyd_sums(own.select(vector_col), vector_col, lambda v, c=centres.copy(): iter([(0, v, _nearest(v, c), len(c))])):
            centres[r["code"]] = np.array(r["s"]) / r["n"]
    d = x.shape[1]
    edges = np.linspace(0, d, min(parts, d) + 1).astype(int)
    slices = [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    rest = x[:CODES] - centres[_nearest(x[:CODES], centres)]
    books = [rest[:, s].copy() for s in slices]
    for _ in range(rounds):

        def assign(v: np.ndarray, c=centres.copy(), b=[x.copy() for x in books]) -> Iterator:
            rest = v - c[_nearest(v, c)]
            for i, (s, book) in enumerate(zip(slices, b, strict=True)):
                yield i, rest[:, s], _nearest(rest[:, s], book), len(book)

        for r in _lloyd_sums(own.select(vector_col), vector_col, assign):
            books[r["part"]][r["code"]] = np.array(r["s"]) / r["n"]
    return Codebooks(centres, slices, books)


LISTS = "cell int, ids binary, codes binary, errors binary"


def build(vectors: DataFrame, index: Codebooks, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """RTR-04: the inverted lists (cell, ids, codes, errors), in blocks of BLOCK vectors at most, every vector in one; a cell of very many is packed by many tasks. Null vectors are left out."""
    parts = len(index.books)

    def encode(batches):
        for b in batches:
            if len(b):
                cell, codes, error = index.encode(_matrix(b["v"]))
                yield pd.DataFrame({"id": b["id"], "cell": cell, "code": [c.tobytes() for c in codes], "error": error})

    def block(cell: int, rows: list) -> pd.DataFrame:
        return pd.DataFrame({"cell": [cell], "ids": [np.array([r[0] for r in rows], "<i8").tobytes()], "codes": [b"".join(r[1] for r in rows)], "errors": [np.array([r[2] for r in rows], "<f8").tobytes()]})

    def pack(batches):
        held, now = [], None
        for b in batches:
            for key, cell, code, error in zip(b["id"], b["cell"], b["code"], b["error"], strict=True):
                if held and (cell != now or len(held) == BLOCK):
                    yield block(now, held)
                    held = []
                now = cell
                held.append((key, code, error))
        if held:
            yield block(now, held)

    rows = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    if not parts:
        return rows.limit(0).selectExpr("cast(null as int) cell", "cast(null as binary) ids", "cast(null as binary) codes", "cast(null as binary) errors")
    coded = rows.mapInPandas(encode, "id long, cell int, code binary, error double")
    return coded.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(SALTS))).sortWithinPartitions("cell").mapInPandas(pack, LISTS)


def search(queries: DataFrame, lists: DataFrame, vectors: DataFrame, index: Codebooks, k: int, probes: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, item_id, score, rank): the k items of greatest inner product among the cells of the `probes` nearest centres, exactly; ties to the lesser id.

    queries (query_id, embedding) meet the lists in a join by cell, block by block, and are never collected. The vectors are laid beside their codes
    first; of each block those whose score can reach the k-th best lower bound of the block are compared exactly, and k a query go on.
    """
    def near(batches):
        for b in batches:
            if len(b):
                x = _matrix(b["embedding"])
                d = (index.cells**2).sum(axis=1)[None] - 2 * x @ index.cells.T
                cell = np.argsort(d, axis=1, kind="stable")[:, :probes]
                yield pd.DataFrame({"query_id": np.repeat(b["query_id"].to_numpy(), cell.shape[1]), "q": list(np.repeat(x, cell.shape[1], axis=0)), "cell": cell.ravel()})

    def single(batches):
        for b in batches:
            for cell, ids, codes, errors in zip(b["cell"], b["ids"], b["codes"], b["errors"], strict=True):
                own = np.frombuffer(ids, "<i8")
                yield pd.DataFrame({"item_id": own, "cell": cell, "code": [c.tobytes() for c in np.frombuffer(codes, np.uint8).reshape(len(own), -1)], "error": np.frombuffer(errors, "<f8")})

    def block(cell: int, rows: list) -> pd.DataFrame:
        return pd.DataFrame({"cell": [cell], "ids": [np.array([r[0] for r in rows], "<i8").tobytes()], "codes": [b"".join(r[1] for r in rows)], "errors": [np.array([r[2] for r in rows], "<f8").tobytes()], "matrix": [np.stack([r[3] for r in rows]).astype(np.float64).tobytes()]})

    def beside(batches):
        held, now = [], None
        for b in batches:
            for key, cell, code, error, v in zip(b["item_id"], b["cell"], b["code"], b["error"], b["v"], strict=True):
                if held and (cell != now or len(held) == BLOCK):
                    yield block(now, held)
                    held = []
                now = cell
                held.append((key, code, error, v))
        if held:
            yield block(now, held)

    def compared(batches):
        for b in batches:
            for q_ids, q_matrix, cell, ids, codes, errors, matrix in zip(b["q_ids"], b["q_matrix"], b["cell"], b["ids"], b["codes"], b["errors"], b["matrix"], strict=True):
                own, asking = np.frombuffer(ids, "<i8"), np.frombuffer(q_ids, np.int64)
                code, error, exact = np.frombuffer(codes, np.uint8).reshape(len(own), -1), np.frombuffer(errors, "<f8"), np.frombuffer(matrix).reshape(len(own), -1)
                out = []
                for query_id, q in zip(asking.tolist(), np.frombuffer(q_matrix).reshape(len(asking), -1), strict=True):
                    score = index.scores(q, cell, code)
                    length = float(np.sqrt(q @ q))
                    miss = error * length
                    miss = miss + 1e-9 * (np.abs(score) + miss + length)  # rounding
                    low, high = score - miss, score + miss
                    keep = np.flatnonzero(high >= (np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -np.inf))
                    _, column, scores = best_products(q[None], exact[keep], own[keep], k)
                    out.append(pd.DataFrame({"query_id": query_id, "item_id": own[keep][column], "score": scores}))
                yield pd.concat(out)

    asked = queries.where("embedding IS NOT NULL").select(F.col("query_id").cast("long").alias("query_id"), "embedding")
    none = "query_id long, item_id long, score double, rank int"
    if not len(index.cells):
        return queries.sparkSession.createDataFrame([], none)
    items = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("item_id"), F.col(vector_col).alias("v"))
    rows = lists.mapInPandas(single, "item_id long, cell int, code binary, error double").join(items, "item_id")
    laid = rows.repartition("cell", F.pmod(F.xxhash64("item_id"), F.lit(SALTS))).sortWithinPartitions("cell").select("item_id", "cell", "code", "error", "v").mapInPandas(beside, LISTS + ", matrix binary")
    probed = _cell_blocks(asked.mapInPandas(near, "query_id long, q array<double>, cell int"), ("query_id", "q"), QUERIES).select("cell", F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"))
    pairs = laid.join(probed, "cell").select("q_ids", "q_matrix", "cell", "ids", "codes", "errors", "matrix")
    found = pairs.mapInPandas(compared, "query_id long, item_id long, score double")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id"))).where(F.col("rank") <= k).select("query_id", "item_id", "score", "rank")
