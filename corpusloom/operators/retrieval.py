"""Retrieval: flat top-k search, neighbour chunks, hit curves, core-sets (RTR-02..05, RTR-08, JOIN-08, JOIN-09, AGG-34, SMP-05, TOPK-01, EXT-10)."""

from __future__ import annotations

import contextlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.storage import append_in_waves, drop_settled, settle


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _blocks(rows: DataFrame, names: tuple[str, str], size: int) -> DataFrame:
    """(n, ids, matrix): vectors by `size`, as bytes."""

    def pack(batches):
        for b in batches:
            for low in range(0, len(b), size):
                own = b[low : low + size]
                yield pd.DataFrame({"ids": [own[names[0]].to_numpy(dtype=np.int64).tobytes()], "matrix": [np.stack(own[names[1]].to_numpy()).astype(np.float64).tobytes()]})

    return rows.where(F.col(names[1]).isNotNull()).select(F.col(names[0]).cast("long").alias(names[0]), names[1]).mapInPandas(pack, "ids binary, matrix binary")


def _cell_blocks(rows: DataFrame, names: tuple[str, str], size: int, salts: int = 16) -> DataFrame:
    """(cell, ids, matrix): vectors of one cell by `size`, as bytes; a cell of very many is laid out by `salts` tasks."""

    def pack(batches):
        held, now = [], None

        def out():
            return pd.DataFrame({"cell": [now], "ids": [np.array([i for i, _ in held], np.int64).tobytes()], "matrix": [np.stack([v for _, v in held]).astype(np.float64).tobytes()]})

        for b in batches:
            for key, v, cell in zip(b[names[0]], b[names[1]], b["cell"], strict=True):
                if held and (cell != now or len(held) == size):
                    yield out()
                    held = []
                now = cell
                held.append((key, v))
        if held:
            yield out()

    dealt = rows.select(F.col(names[0]).cast("long").alias(names[0]), names[1], "cell").repartition("cell", F.pmod(F.xxhash64(names[0]), F.lit(salts)))
    return dealt.sortWithinPartitions("cell").mapInPandas(pack, "cell int, ids binary, matrix binary")


def best_products(q: np.ndarray, x: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of x, score) of each query's k greatest inner products; ties to the lesser id.

    A matrix product, whose rounding depends on a row's place, says which can be among them; these are summed up in order of the
    dimensions, so that equal vectors have equal scores. NaN comes last.
    """
    n = min(k, len(own))
    if n == 0 or not len(q):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    about = q @ x.T
    about[np.isnan(about)] = -np.inf
    slack = 2e-12 * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max()
    least = np.where(np.isfinite(slack), np.partition(about, len(own) - n, axis=1)[:, len(own) - n] - slack, -np.inf)
    row, column = np.nonzero(about >= least[:, None])
    scores = np.zeros(len(row))
    for j in range(q.shape[1]):
        scores += q[row, j] * x[column, j]
    order = np.lexsort((own[column], -scores, row))
    row, column, scores = row[order], column[order], scores[order]
    few = np.arange(len(row)) - np.searchsorted(row, row) < n
    return row[few], column[few], scores[few]


PAIRS = 8
"""Pairs of blocks that a worker is sent at once: each has two matrices, so Arrow's own limit would let a worker hold thousands."""


@contextlib.contextmanager
def _few_at_once(spark: SparkSession, rows: int = PAIRS):
    """Jobs run inside send so many rows to Python at once; the session's setting is as before afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _best_pairs(items: DataFrame, asked: DataFrame, k: int, on: str | None = None) -> DataFrame:
    """(query_id, item_id, score, rank) of blocks (ids, matrix) and of queries' blocks (q_ids, q_matrix), all of them or those with the same `on`: the k best of each query.

    Blocks are written first, for they are laid out in large batches and met in small ones; so is the result, while the small ones hold.
    """
    from pyspark.sql import Window

    spark = items.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    items = settle(items.repartition(parts, "ids"), "blocks")
    asked = settle(asked, "queries")
    pairs = items.join(asked, on) if on else items.crossJoin(asked)

    def best(batches):
        for b in batches:
            for qi, qm, ii, im in zip(b["q_ids"], b["q_matrix"], b["ids"], b["matrix"], strict=True):
                ids, own = np.frombuffer(qi, np.int64), np.frombuffer(ii, np.int64)
                row, column, scores = best_products(np.frombuffer(qm).reshape(len(ids), -1), np.frombuffer(im).reshape(len(own), -1), own, k)
                yield pd.DataFrame({"query_id": ids[row], "item_id": own[column], "score": scores})

    found = pairs.select("q_ids", "q_matrix", "ids", "matrix").mapInPandas(best, "query_id long, item_id long, score double")
    best_of_all = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id"))).where(F.col("rank") <= k)
    with _few_at_once(spark):
        out = settle(best_of_all, "nearest")
    drop_settled(items)
    drop_settled(asked)
    return out


def top_k(queries: DataFrame, items: DataFrame, k: int, block: int = 2048) -> DataFrame:
    """(query_id, item_id, score, rank): the k items of greatest inner product, ties to the lesser id.

    queries (query_id, embedding) is a stated set. Both it and (item_id, embedding) are laid out in blocks of at most `block` vectors, and each
    block of items meets each of queries as one matrix product; a pair of blocks sends on k items a query. Nothing is collected, and the items
    are read once however many queries there are. It is computed when called, and a worker holds some pairs of blocks at a time. Null vectors are left out on both sides.
    """
    asked = _blocks(queries, ("query_id", "embedding"), block).select(F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"))
    return _best_pairs(_blocks(items, ("item_id", "embedding"), block), asked, k)


def block_ranges(n: int, size: int = 100_000) -> list[tuple[int, int]]:
    """RTR-02."""
    return [(low, min(low + size, n)) for low in range(0, n, size)]


def train_cells(vectors: DataFrame, cells: int, sample: int = 50_000, rounds: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 42) -> np.ndarray:
    """RTR-03: centroids by k-means on at most `sample` vectors (in the order of a seeded hash), which is the load that training takes."""
    rows = vectors.where(F.col(vector_col).isNotNull()).orderBy(F.xxhash64(F.lit(seed), id_col), id_col).limit(sample).select(vector_col).collect()
    x = np.array([r[0] for r in rows], dtype=np.float64)
    if not len(x):
        return np.zeros((0, 0))
    centres = x[: min(cells, len(x))].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        for c in range(len(centres)):
            mine = x[own == c]
            if len(mine):
                centres[c] = mine.mean(axis=0)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1)[None] - 2 * x @ centres.T, axis=1)


def add_to_cells(vectors: DataFrame, centres: np.ndarray, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """RTR-04: (id, embedding, cell): each vector with its nearest centroid; null vectors are left out."""
    kind = vectors.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            if len(b):
                yield pd.DataFrame({id_col: b[id_col], vector_col: b[vector_col], "cell": _nearest(np.stack(b[vector_col].to_numpy()).astype(np.float64), centres)})

    return vectors.where(F.col(vector_col).isNotNull()).select(id_col, vector_col).mapInPandas(run, f"{id_col} {kind}, {vector_col} {vectors.schema[vector_col].dataType.simpleString()}, cell int")


def add_missing_blocks(vectors: DataFrame, centres: np.ndarray, folder: str, block_size: int = 100_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """EXT-10: the encoded index in a folder by block; only blocks that it lacks are encoded and appended, in several jobs."""
    spark = vectors.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    there = fs.exists(where) and any(s.getPath().getName().startswith("block_id=") for s in fs.listStatus(where))
    block = F.expr(f"`{id_col}` div {block_size}").cast("long")
    todo = vectors.withColumn("block_id", block)
    if there:
        todo = todo.join(F.broadcast(spark.read.parquet(folder).select(F.col("block_id").cast("long").alias("block_id")).distinct()), "block_id", "left_anti")
    append_in_waves(todo, "block_id", lambda part: add_to_cells(part, centres, id_col, vector_col).withColumn("block_id", block), folder)
    return spark.read.parquet(folder)


def search_cells(queries: DataFrame, index: DataFrame, centres: np.ndarray, k: int, probes: int, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 2048) -> DataFrame:
    """(query_id, item_id, score, rank): the best k by inner product among the vectors of each query's `probes` nearest cells; with all cells it is exact.

    Queries and vectors of one cell meet in blocks, as one matrix product, and a pair of blocks sends on k items a query.
    """

    def run(batches):
        for b in batches:
            if len(b):
                x = np.stack(b["embedding"].to_numpy()).astype(np.float64)
                d = (centres**2).sum(axis=1)[None] - 2 * x @ centres.T
                near = np.argsort(d, axis=1, kind="stable")[:, :probes]
                yield pd.DataFrame({"query_id": np.repeat(b["query_id"].to_numpy(), near.shape[1]), "q": list(np.repeat(x, near.shape[1], axis=0)), "cell": near.ravel()})

    asked = queries.where("embedding IS NOT NULL").select(F.col("query_id").cast("long").alias("query_id"), "embedding").mapInPandas(run, "query_id long, q array<double>, cell int")
    q_blocks = _cell_blocks(asked, ("query_id", "q"), block).select("cell", F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"))
    items = _cell_blocks(index.where(F.col(vector_col).isNotNull()), (id_col, vector_col), block)
    return _best_pairs(items, q_blocks, k, "cell")


def continuations(neighbours: DataFrame, chunks: DataFrame, more: int = 1, n: int | None = None) -> DataFrame:
    """JOIN-08: (id, rank, step, chunk_id, and the chunk): each neighbour's chunk and the `more` that follow it, chunk numbers wrapping at n (their number if not said). neighbours: (id, rank, chunk_id)."""
    n = chunks.count() if n is None else n
    if not n:
        return neighbours.select("id", "rank").withColumn("step", F.lit(0)).join(chunks).limit(0)
    steps = neighbours.select("id", "rank", F.explode(F.transform(F.sequence(F.lit(0), F.lit(more)), lambda i: F.struct(i.alias("step"), F.pmod(F.col("chunk_id") + i, F.lit(n)).alias("chunk_id")))).alias("s"))
    return steps.select("id", "rank", "s.step", "s.chunk_id").join(chunks, "chunk_id")


def attached(neighbours: DataFrame, chunks: DataFrame, tokens: str, more: int = 1) -> DataFrame:
    """RTR-08: (id, neighbours): a chunk's neighbours in order of rank, each with its continuation as one array of tokens."""
    own = continuations(neighbours, chunks, more).groupBy("id", "rank").agg(F.array_sort(F.collect_list(F.struct("step", F.col(tokens).alias("t")))).alias("_s"))
    joined = own.select("id", "rank", F.flatten(F.transform("_s", lambda x: x["t"])).alias("t"))
    return joined.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "t"))).alias("_n")).select("id", F.transform("_n", lambda x: x["t"]).alias("neighbours"))


def hit_curve(hits: DataFrame, k: int) -> DataFrame:
    """(rank, hits): of hits (query_id, rank, right), how many queries have a right item among their first rank ones."""
    first = hits.where("right").groupBy("query_id").agg(F.min("rank").alias("first"))
    by = first.select(F.explode(F.sequence(F.col("first"), F.lit(k))).alias("rank"))
    return by.groupBy("rank").agg(F.count("*").alias("hits"))


def k_center(items: DataFrame, n: int, id_col: str = "vec_id", vector_col: str = "embedding", steps: int = 64) -> list[int]:
    """Greedy core-set: from the least id on, always the item farthest from those chosen, ties to the lesser id.

    Each item carries the least distance to what was chosen so far, so a step compares it with the newest centres only; every `steps` steps these
    distances are written. A step sends one vector out and one row back. Null vectors are left out.
    """
    rows = items.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    first = rows.orderBy("id").first()
    if first is None:
        return []
    chosen, new = [first["id"]], [np.array(first["v"])]
    held = rows.withColumn("d", F.lit(float("inf")))
    written: DataFrame | None = None

    def nearer(frame: pd.DataFrame, centres: np.ndarray) -> np.ndarray:
        x = np.stack(frame["v"].to_numpy())
        return np.minimum(frame["d"].to_numpy(), np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0))

    while len(chosen) < n:
        centres = np.stack(new)

        def far(batches, centres=centres):
            for b in batches:
                if len(b):
                    d = nearer(b, centres)
                    i = np.lexsort((b["id"].to_numpy(), -d))[0]
                    yield pd.DataFrame({"id": [b["id"].iloc[i]], "d": [d[i]], "v": [b["v"].iloc[i]]})

        best = held.mapInPandas(far, "id long, d double, v array<double>").orderBy(F.desc("d"), "id").first()
        if best is None or best["d"] == 0:
            break
        chosen.append(best["id"])
        new.append(np.array(best["v"]))
        if len(new) >= steps:
            centres = np.stack(new)

            def carry(batches, centres=centres):
                for b in batches:
                    if len(b):
                        yield b.assign(d=nearer(b, centres))

            before, written = written, settle(held.mapInPandas(carry, "id long, v array<double>, d double"), "distances")
            held, new = written, [new[-1]]
            if before is not None:
                drop_settled(before)
    return chosen
