"""Embedding near-dedup by an inverted multi-index.

Independent codebooks on the two halves of the normalised vectors form a product grid of cells. Every vector is filed in
its cell, and visits cells in order of their distance, by multi-sequence traversal, until the distances
that the target recall asks for are covered: the radius is calibrated on a bounded sample so that of two linked
vectors one at least visits the other's cell. Visits are verified by exact cosines in double precision. A link that only one
end's visit finds counts for both; where both visit, each counts its own.

Equal vectors are one member with a count, so copies cost nothing. Vectors and visits of a cell meet in blocks, and
a crowded cell's blocks are dealt to many tasks; they emit sums of links and one link to each component's
representative that the block knows, never all pairs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.graph import components
from corpusloom.llm.shared import discard, is_empty, materialise, small_batches
from corpusloom.operators.storage import ranked

SAMPLE = 20_000
"""Vectors that codebooks and radius are fitted to: those of least hash of id."""
BLOCK = 512
"""Visits that meet a block of members at once."""
MEMBERS, VISITS = 2048, 16384
"""About so many members and visits of a cell meet in one task; cells with more are dealt to several."""
COPIES = 32768
"""Vectors, with their copies for other cells, that a worker packs at a time."""


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = x.shape[1] // 2
    return x[:, :d], x[:, d:]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, without overflow on the way."""
    x = x.astype(np.float64)
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def codebook(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """k-means centres."""
    rng = np.random.default_rng(seed)
    centres = x[np.sort(rng.choice(len(x), size=min(k, len(x)), replace=False))].copy()
    for _ in range(rounds):
        near = distances(x, centres).argmin(axis=1)
        for c in range(len(centres)):
            own = x[near == c]
            if len(own):
                centres[c] = own.mean(axis=0)
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1), 0)


def traverse(d1: np.ndarray, d2: np.ndarray, limit: float) -> Iterator[tuple[int, int]]:
    """Cells (i, j) in order of d1[i] + d2[j], by the multi-sequence algorithm, while that is at most limit; the first one always."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    a, b = d1[o1], d2[o2]
    heap, seen = [(a[0] + b[0], 0, 0)], {(0, 0)}
    first = True
    while heap:
        d, i, j = heapq.heappop(heap)
        if d > limit and not first:
            return
        first = False
        yield int(o1[i]), int(o2[j])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (a[x] + b[y], x, y))


class Grid:
    """Codebooks and, for the traversal, by how much a visited cell may be farther than the nearest one."""

    def __init__(self, sample: np.ndarray, cells: int, cosine: float, recall: float):
        one, two = halves(sample)
        self.one, self.two = codebook(one, cells, 1), codebook(two, cells, 2)
        d1, d2 = distances(one, self.one), distances(two, self.two)
        c1, c2 = d1.argmin(axis=1), d2.argmin(axis=1)
        own = d1.min(axis=1) + d2.min(axis=1)
        # What a link of the least cosine does to the distances: each sample vector meets a neighbour made at that cosine.
        rng = np.random.default_rng(3)
        extra = []
        rows = np.arange(len(sample))
        for _ in range(4):
            noise = rng.normal(size=sample.shape)
            noise -= (noise * sample).sum(axis=1, keepdims=True) * sample
            noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-300)
            near = cosine * sample + np.sqrt(1 - cosine**2) * noise
            n1, n2 = distances(near[:, : one.shape[1]], self.one), distances(near[:, one.shape[1] :], self.two)
            e1, e2 = n1.argmin(axis=1), n2.argmin(axis=1)
            there = n1[rows, c1] + n2[rows, c2] - n1.min(axis=1) - n2.min(axis=1)
            back = d1[rows, e1] + d2[rows, e2] - own
            extra.append(np.minimum(there, back))
        self.extra = float(np.quantile(np.concatenate(extra), recall))

    def cells(self, x: np.ndarray) -> np.ndarray:
        one, two = halves(x)
        return distances(one, self.one).argmin(axis=1) * len(self.two) + distances(two, self.two).argmin(axis=1)

    def visits(self, x: np.ndarray) -> Iterator[list[int]]:
        one, two = halves(x)
        for d1, d2 in zip(distances(one, self.one), distances(two, self.two), strict=True):
            limit = d1.min() + d2.min() + self.extra
            yield [i * len(self.two) + j for i, j in traverse(d1, d2, limit)]


def cell_count(n: int) -> int:
    """Centres of each half: about 512 members a cell, where a visit's copy costs as much as its cosines, as far as a bounded sample supports them."""
    return int(np.clip(np.sqrt(n / 512), 4, 1024))


def _placed(batches: Iterator[pd.DataFrame], grid: Grid | None, size: int, kind: str) -> Iterator[pd.DataFrame]:
    """id, n, vec (bytes of the components as they came), cell, visits (the own cell first). Vectors of another length share a cell of their own."""
    for batch in batches:
        lengths = batch["embedding"].map(len)
        for length, part in batch.groupby(lengths):
            raw = np.stack(part["embedding"].to_numpy()).astype(kind)
            if length == size and grid is not None:
                x = unit(raw)
                cell, visits = grid.cells(x), list(grid.visits(x))
            else:
                cell, visits = np.full(len(raw), -length), [[-int(length)]] * len(raw)
            yield pd.DataFrame({"id": part["id"].to_numpy(), "n": part["n"].to_numpy(), "vec": [v.tobytes() for v in raw], "cell": cell, "visits": [[int(c)] + [v for v in vs if v != c] for c, vs in zip(cell, visits, strict=True)]})


def _packed(ids: np.ndarray, counts: np.ndarray, vecs: np.ndarray, seen: np.ndarray, owner: np.ndarray, cell: np.ndarray, block: np.ndarray, share: np.ndarray, kind: int) -> pd.DataFrame:
    """One row for each cell, block and share, of the vectors (owner) that go there; seen holds, as bytes, a member's visits or a visitor's own cell."""
    order = np.lexsort((share, block, cell))
    owner, cell, block, share = owner[order], cell[order], block[order], share[order]
    cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(block) != 0) | (np.diff(share) != 0)) + 1
    first = np.concatenate([[0], cuts]).astype(np.int64)
    groups = np.split(owner, cuts)
    sizes = np.array([len(x) // 8 for x in seen], dtype=np.int32)
    return pd.DataFrame({"cell": cell[first], "block": block[first], "share": share[first], "kind": np.full(len(first), kind, np.int32), "ids": [ids[g].tobytes() for g in groups], "counts": [counts[g].tobytes() for g in groups], "vecs": [b"".join(vecs[g]) for g in groups], "seen": [b"".join(seen[g]) for g in groups], "sizes": [sizes[g].tobytes() for g in groups]})


def _copies(cell: np.ndarray, crowded: dict[int, tuple[int, int]], side: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place in a cell: parts to be dealt to, and how many parts of the other side must be met."""
    if not crowded:
        return np.ones(len(cell), np.int64), np.ones(len(cell), np.int64)
    both = np.array([crowded.get(c, (1, 1)) for c in cell.tolist()], dtype=np.int64).reshape(-1, 2)
    return both[:, side], both[:, 1 - side]


def _dealt(batches: Iterator[pd.DataFrame], crowded: dict[int, tuple[int, int]]) -> Iterator[pd.DataFrame]:
    """Members and visits by cell, block and share, packed: a crowded cell's members are dealt to blocks, its visits to shares, and each block meets each share."""
    for batch in batches:
        ids, counts = batch["id"].to_numpy(np.int64), batch["n"].to_numpy(np.int64)
        vecs = batch["vec"].to_numpy()
        homes = np.array([np.int64(c).tobytes() for c in batch["cell"]], dtype=object)
        seen = np.array([np.asarray(v, dtype=np.int64).tobytes() for v in batch["visits"]], dtype=object)
        lengths = batch["visits"].map(len).to_numpy(np.int64)
        dealt = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
        for kind in (0, 1):
            cell = batch["cell"].to_numpy(np.int64) if kind == 0 else np.concatenate(batch["visits"].to_numpy()).astype(np.int64)
            owner = np.arange(len(ids)) if kind == 0 else np.repeat(np.arange(len(ids)), lengths)
            parts, others = _copies(cell, crowded, kind)
            ends = np.cumsum(others)
            at = 0
            while at < len(owner):  # a bounded number of copies at a time
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + COPIES, side="right")))
                o = others[at:to]
                which = np.repeat(np.arange(at, to), o)
                other = np.arange(len(which)) - np.repeat(np.cumsum(o) - o, o)
                own = dealt[owner[which]] % parts[which]
                yield _packed(ids, counts, vecs, seen if kind == 0 else homes, owner[which], cell[which], *((own, other) if kind == 0 else (other, own)), kind)
                at = to


def _verified(group: pd.DataFrame, cosine: float, kind_of: str) -> pd.DataFrame:
    """(id, links, low) of every vector of the group that has a link in it: how many it counts here; and its local component's least id.

    A visitor counts its links with members; a member counts those with visitors whose own cell it does not visit itself.
    """
    sides = []
    for kind in (0, 1):
        own = group[group["kind"] == kind]
        ids = np.frombuffer(b"".join(own["ids"]), dtype=np.int64)
        x = np.frombuffer(b"".join(own["vecs"]), dtype=kind_of)
        seen, sizes = np.frombuffer(b"".join(own["seen"]), dtype=np.int64), np.frombuffer(b"".join(own["sizes"]), dtype=np.int32)
        sides.append((ids, np.frombuffer(b"".join(own["counts"]), dtype=np.int64), unit(x.reshape(len(ids), -1)) if len(ids) else None, seen, sizes))
    (ids, counts, x, seen, sizes), (q_ids, q_counts, q, homes, _) = sides
    empty = pd.DataFrame({"id": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "low": np.zeros(0, np.int64)})
    if not len(ids) or not len(q_ids):
        return empty
    known, home = np.unique(homes, return_inverse=True)
    spot = np.minimum(np.searchsorted(known, seen), len(known) - 1)
    back = np.zeros((len(known), len(ids)), dtype=bool)  # whether a member visits a home of the visitors
    there = known[spot] == seen
    back[spot[there], np.repeat(np.arange(len(ids)), sizes)[there]] = True
    links, m_links = np.zeros(len(q_ids), dtype=np.int64), np.zeros(len(ids), dtype=np.int64)
    packs, m_low, q_low = [], ids.copy(), q_ids.copy()
    for at in range(0, len(q_ids), BLOCK):
        hit = (q[at : at + BLOCK] @ x.T >= cosine) & (q_ids[at : at + BLOCK, None] != ids)
        links[at : at + BLOCK] = hit @ counts
        m_links += q_counts[at : at + BLOCK] @ (hit & ~back[home[at : at + BLOCK]])
        packs.append(np.packbits(hit, axis=1))
    while True:  # least labels go back and forth until they stay
        before = m_low.copy(), q_low.copy()
        for k, pack in enumerate(packs):
            at = k * BLOCK
            hit = np.unpackbits(pack, axis=1, count=len(ids)).astype(bool)
            if not hit.any():
                continue
            top = np.iinfo(np.int64).max
            q_low[at : at + BLOCK] = np.minimum(q_low[at : at + BLOCK], np.where(hit, m_low, top).min(axis=1))
            m_low = np.minimum(m_low, np.where(hit, q_low[at : at + BLOCK, None], top).min(axis=0))
        if np.array_equal(before[0], m_low) and np.array_equal(before[1], q_low):
            break
    out_q, out_m = links > 0, (m_low < ids) | (m_links > 0)
    return pd.DataFrame({"id": np.concatenate([q_ids[out_q], ids[out_m]]), "links": np.concatenate([links[out_q], m_links[out_m]]), "low": np.concatenate([q_low[out_q], m_low[out_m]])})


def with_class(usable: DataFrame, of_class: DataFrame) -> DataFrame:
    """usable with what its vector's class has.

    Vectors with over a thousandth of all rows are fewer than a thousand: their rows are joined by broadcast, the others by shuffle.
    """
    many = of_class.where("n > total / 1000").select("embedding", F.col("n_links").alias("h_links"), F.col("component_id").alias("h_component"))
    tagged = usable.join(F.broadcast(many), "embedding", "left")
    rest = tagged.where("h_links IS NULL").select("id", "embedding").join(of_class.where("n <= total / 1000").select("embedding", "n_links", "component_id"), "embedding")
    return tagged.where("h_links IS NOT NULL").select("id", F.col("h_links").alias("n_links"), F.col("h_component").alias("component_id")).unionByName(rest.select("id", "n_links", "component_id"))


def near_duplicates(embeddings: DataFrame, cosine: float = 0.9, recall: float = 0.999, sample: int = SAMPLE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of embeddings.

    Vectors link from cosine on, in double precision, whatever other columns say; n_links counts the other rows linked with a
    row, component_id is the least id reachable, kept says whether that is the row's own. Null, empty and zero
    vectors and those with null or non-finite components link with nothing; so do vectors of different lengths. Rows of one id are
    vectors of their own, whether they are equal or not; rows without an id have no links and are kept. An empty table gives no rows.
    """
    spark = embeddings.sparkSession
    small_batches(spark, 4000)
    kind = "float32" if dict(embeddings.dtypes)[vector_col] == "array<float>" else "float64"
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>" if kind == "float32" else "array<double>").alias("embedding"))
    bad = "embedding IS NULL OR size(embedding) = 0 OR id IS NULL OR exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = float('infinity')) OR forall(embedding, x -> x = 0)"
    rows = rows.withColumn("usable", F.expr(f"NOT coalesce({bad}, true)"))
    usable = rows.where("usable").select("id", "embedding")
    classes = materialise(usable.groupBy("embedding").agg(F.min("id").alias("id"), F.count("*").alias("n")), "vectors")
    named = None
    if not is_empty(classes.groupBy("id").count().where("count > 1")):  # different vectors of one id: classes are numbered in the order of their ids
        numbered = materialise(ranked(classes, "id", name="node"), "vectors")
        named = numbered.select(F.col("node").alias("component_id"), F.col("id").alias("lead"))
        classes = numbered.select("embedding", F.col("node").alias("id"), "n")
    lengths = classes.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    grid, size = None, 0
    if lengths is not None:
        size = lengths["d"]
        fitted = classes.where(F.size("embedding") == size).orderBy(F.xxhash64("id"), "id").limit(sample).select("embedding").toPandas()
        grid = Grid(unit(np.stack(fitted["embedding"].to_numpy())), cell_count(lengths["count"]), cosine, recall)
    placed = materialise(classes.mapInPandas(lambda it: _placed(it, grid, size, kind), "id long, n long, vec binary, cell long, visits array<long>"), "placed")
    # At most one row a cell comes to the driver, so that the codebooks bound them.
    visits = placed.select(F.explode("visits").alias("cell")).groupBy("cell").agg(F.count("*").alias("visits"))
    crowd = placed.groupBy("cell").agg(F.count("*").alias("members")).join(visits, "cell").where((F.col("members") > MEMBERS) | (F.col("visits") > VISITS)).collect()
    crowded = {r["cell"]: (-(-r["members"] // MEMBERS), -(-r["visits"] // VISITS)) for r in crowd}
    dealt = placed.mapInPandas(lambda it: _dealt(it, crowded), "cell long, block long, share long, kind int, ids binary, counts binary, vecs binary, seen binary, sizes binary")
    found = dealt.groupBy("cell", "block", "share").applyInPandas(lambda g: _verified(g, cosine, kind), "id long, links long, low long")
    found = materialise(found, "found")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    discard(placed)
    closed = components(found.where("id != low").select(F.col("id").alias("src"), F.col("low").alias("dst")).distinct())
    of_class = classes.select(F.col("id").alias("rep"), "n", "embedding")
    of_class = of_class.join(links.select(F.col("id").alias("rep"), "links"), "rep", "left").join(closed.select(F.col("id").alias("rep"), "component_id"), "rep", "left")
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    of_class = of_class.select("embedding", "n", F.lit(total).alias("total"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    if named is not None:
        of_class = of_class.join(named, "component_id").select("embedding", "n", "total", "n_links", F.col("lead").alias("component_id"))
    good = with_class(usable, of_class).select("id", "n_links", "component_id")
    rest = rows.where("NOT usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = good.unionByName(rest)
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
