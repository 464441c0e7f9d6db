"""MinHash near-dedup: universal hash minima, banding, signature verification, exact sets, large-star and small-star.

Texts with equal shingle sets form a class first; only the class's least id goes on, so a large group of
copies costs one row each. Within a band's bucket no full set of pairs is made: each member meets the
bucket's least id and its neighbour in the order of the next bands. Links found so are closed into
components, and only buckets with members of different components are looked at again: their full sets meet in
blocks, which give one link a member at most, so that no link that could still join two components is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.graph import components
from corpusloom.llm.shared import Block, blocks, discard, ids_first, is_empty, materialise, mix, rolling, small_batches, sole, stream
from corpusloom.operators.storage import ranked

ROWS = 5
CROWD = 1024
CROWD_BYTES = 32 << 20
"""Members of a bucket, and bytes of their sets, that one block holds; blocks of a larger bucket meet two by two in tasks of their own."""
HOT = 1000
"""Groups of equal sets with more than this part of all rows are joined by broadcast: there are fewer than so many."""
MARGIN = 15
"""By so many hundredths a signature's estimate may lie under the threshold: over four standard deviations."""


def row_shingles(b: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of a block, row by row, and where each row's begin (one more bound than rows).

    A row with fewer than k words, but some, has its whole sequence as one shingle; one without has none.
    """
    n = np.diff(b.bounds)
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(int(bounds[-1]), dtype=np.uint64)
    full = rolling(b.hashes, k)
    long = n >= k
    if long.any():
        at = np.arange(int(counts[long].sum()))
        first = np.repeat(np.cumsum(counts[long]) - counts[long], counts[long])
        out[np.repeat(bounds[:-1][long], counts[long]) + at - first] = full[np.repeat(b.bounds[:-1][long], counts[long]) + at - first]
    for i in np.flatnonzero((n > 0) & ~long):
        out[bounds[i]] = rolling(b.hashes[b.bounds[i] : b.bounds[i + 1]], int(n[i]), seed=int(n[i]))[0]
    return out, bounds


def _signed(batches: Iterator[pa.RecordBatch], k: int, bands: int) -> Iterator[pa.RecordBatch]:
    sole()
    m = bands * ROWS
    times, plus = stream(3, m) | np.uint64(1), stream(5, m)
    weights = (stream(7, m) | np.uint64(1)).reshape(bands, ROWS)
    salt = stream(9, bands)
    for batch in batches:
        for b in blocks(batch.column(1), lower=True):
            h, bounds = row_shingles(b, k)
            size, one, two = (np.zeros(b.rows, dtype=np.int64) for _ in range(3))
            for i in range(b.rows):
                own = np.unique(h[bounds[i] : bounds[i + 1]])
                size[i] = len(own)
                one[i], two[i] = mix(own).sum(dtype=np.uint64).view(np.int64), mix(own + np.uint64(77)).sum(dtype=np.uint64).view(np.int64)
            low = np.zeros((b.rows, m), dtype=np.uint64)
            full = np.flatnonzero(np.diff(bounds))
            starts = bounds[:-1][full]
            if len(full):
                for j in range(m):
                    low[full, j] = np.minimum.reduceat(h * times[j] + plus[j], starts)
            marks = (mix(low) >> np.uint64(48)).astype("<u2")
            keys = mix((low.reshape(-1, bands, ROWS) * weights).sum(axis=2, dtype=np.uint64) + salt).view(np.int64)
            offsets = np.arange(b.rows + 1, dtype=np.int32) * bands
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(b.first, b.rows), batch.column(2).slice(b.first, b.rows), pa.array(size), pa.array(one), pa.array(two), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys.ravel())), pa.array([x.tobytes() for x in marks], pa.binary())],
                ["doc_id", "text_key", "n_shingles", "key_a", "key_b", "bands", "marks"],
            )


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    sole()
    for batch in batches:
        for b in blocks(batch.column(1), lower=True):
            h, bounds = row_shingles(b, k)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.first, b.rows), pa.array([np.unique(h[bounds[i] : bounds[i + 1]]).tobytes() for i in range(b.rows)], pa.binary())], ["id", "shingles"])


def _alike(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Pairs (src, dst) whose signatures agree in at least the share least of their places."""
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype="<u2").reshape(batch.num_rows, -1) for i in (2, 3))
            keep = pa.array((a == b).mean(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["src", "dst"])


def _linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets have 100 * intersection >= percent * union."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            a, b = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
            both = 0
            if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                both = int((b[at] == a).sum())
            keep.append(both > 0 and 100 * both >= percent * (len(a) + len(b) - both))
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["src", "dst"])


def _between(percent: int):
    """Of a block of a bucket: the links between members of different components, as one pair (least member reached, member) each.

    Intersections are sums of products over the shingles that two members have at least, some columns at a time.
    """

    def run(table: pa.Table) -> pa.Table:
        ids, comps = table.column("id").to_numpy(), table.column("c").to_numpy()
        order = np.argsort(ids, kind="stable")
        sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in table.column("shingles").combine_chunks()] if table.num_rows else []
        size = np.array([len(sets[i]) for i in order], dtype=np.int64)
        ids, comps = ids[order], comps[order]
        _, which, count = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(ids)), size)
        shared = count[which] > 1
        column = (np.cumsum(count > 1) - 1)[which[shared]]
        owner, width = owner[shared], int((count > 1).sum())
        inter = np.zeros((len(ids), len(ids)), dtype=np.float32)
        by = np.argsort(column, kind="stable")
        column, owner = column[by], owner[by]
        for low in range(0, width, 4096):
            a, b = np.searchsorted(column, (low, low + 4096))
            x = np.zeros((len(ids), min(4096, width - low)), dtype=np.float32)
            x[owner[a:b], column[a:b] - low] = 1
            inter += x @ x.T
        hit = (100 * inter.astype(np.int64) >= percent * (size[:, None] + size - inter.astype(np.int64))) & (comps[:, None] != comps)
        low, top = ids.copy(), np.iinfo(np.int64).max
        while hit.any():
            new = np.minimum(low, np.where(hit, low, top).min(axis=1))
            if np.array_equal(new, low):
                break
            low = new
        out = low < ids
        return pa.table({"src": pa.array(low[out], pa.int64()), "dst": pa.array(ids[out], pa.int64())})

    return run


def near_duplicates(documents: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_key), a row for each row of documents.

    Links join documents whose sets of word shingles (A-Z lower-cased, words between ASCII white space) have a
    similarity of percent hundredths or more; kept is true for a component's least id. A null or empty
    text has an empty set and no link. Rows that repeat an id and a text are one document, each with its row; rows
    of one id and different texts are documents of their own (text_key, a hash of the text, tells them apart), whose
    component is named by the least id in it, and of which the one with the least text_key is kept. Rows without an
    id link with nothing and are kept, with a null component. An empty table gives no rows; other columns are not read.
    """
    spark = documents.sparkSession
    small_batches(spark)
    docs = ids_first(documents, id_col, text_col).withColumn("text_key", F.xxhash64("text"))
    signed = docs.select("doc_id", "text", "text_key").mapInArrow(lambda it: _signed(it, shingle, bands), "doc_id long, text_key long, n_shingles long, key_a long, key_b long, bands array<long>, marks binary")
    every = materialise(signed, "signatures")
    twice = not is_empty(every.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1"))
    if twice:  # nodes are then numbered in the order of (doc_id, text_key), so that the least node has the least id
        nodes = ranked(every.where("doc_id IS NOT NULL").select("doc_id", "text_key").distinct(), "doc_id", "text_key", name="node")
        nodes = materialise(nodes, "nodes")
        one = every.dropDuplicates(["doc_id", "text_key"]).join(nodes, ["doc_id", "text_key"]).drop("doc_id").withColumnRenamed("node", "doc_id")
        one = materialise(one, "signatures")
        docs = docs.join(nodes, ["doc_id", "text_key"]).select(F.col("node").alias("doc_id"), "text", "text_key")
    else:
        one = every
    whole = one.where("doc_id IS NOT NULL AND n_shingles > 0")
    same = ["key_a", "key_b", "n_shingles"]
    classes = materialise(whole.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "equal")
    # Classes with over a thousandth of all rows are fewer than a thousand: their rows need no shuffle.
    most = classes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"] // HOT
    hot = F.broadcast(classes.where(F.col("n") > most).select(*same, F.col("rep").alias("hot")))
    tagged = whole.select("doc_id", *same).join(hot, same, "left")
    member = tagged.where("hot IS NOT NULL").select("doc_id", F.col("hot").alias("rep")).unionByName(tagged.where("hot IS NULL").join(classes.where(F.col("n") <= most).select(*same, "rep"), same).select("doc_id", "rep"))
    member = materialise(member, "classes")
    reps = whole.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    filed = reps.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), F.posexplode("bands").alias("band", "key"), "bands")
    filed = filed.select("id", "n", "key", F.element_at("bands", F.col("band") % bands + 1).alias("k1"), F.element_at("bands", (F.col("band") + 1) % bands + 1).alias("k2"), F.element_at("bands", (F.col("band") + 2) % bands + 1).alias("k3"))
    full = filed.groupBy("key").agg(F.min("id").alias("center"), F.max("id").alias("last")).where("center < last").select("key", "center")
    bucket = materialise(filed.join(full, "key"), "buckets")
    ids = bucket.select("id").distinct()
    marks = materialise(reps.join(ids, reps["doc_id"] == ids["id"], "left_semi").select(F.col("doc_id").alias("id"), "text_key", "marks"), "marks")
    # No row repeats an id here but those that repeat a document, of which one is taken.
    shingles = docs.join(marks.select(F.col("id").alias("doc_id"), "text_key"), ["doc_id", "text_key"], "left_semi").select("doc_id", "text")
    shingles = shingles.dropDuplicates(["doc_id"]) if twice else shingles
    shingles = materialise(shingles.mapInArrow(lambda it: _sets(it, shingle), "id long, shingles binary"), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The pairs (src, dst) that are links: by signature first, then by the full sets."""
        near = _with_both(pairs, marks.select("id", "marks"), "marks").mapInArrow(lambda it: _alike(it, (percent - MARGIN) / 100), "src long, dst long")
        return _with_both(near, shingles, "shingles").mapInArrow(lambda it: _linked(it, percent), "src long, dst long")

    beside = F.lag("id").over(Window.partitionBy("key").orderBy("k1", "k2", "k3", "id"))
    star = bucket.groupBy("id").agg(F.min("center").alias("center")).select(F.col("center").alias("src"), F.col("id").alias("dst"))
    row = bucket.select(beside.alias("src"), F.col("id").alias("dst"))
    first = star.unionByName(row).where("src IS NOT NULL AND src != dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    links = materialise(confirmed(first), "links")
    found = materialise(components(links), "components")
    labelled = bucket.select("id", "n", "key").join(found, "id", "left").select("id", "n", "key", F.coalesce("component_id", "id").alias("c"))
    labelled = materialise(labelled, "labelled")
    open_ = labelled.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.greatest(F.ceil(F.count("*") / CROWD), F.ceil(F.sum("n") * 8 / CROWD_BYTES)).cast("int").alias("parts")).where("low < high").select("key", "parts")
    apart = labelled.join(open_, "key").select("id", "key", "c", "parts", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("mine"))
    apart = apart.join(shingles, "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    blocks_ = apart.select("id", "c", "shingles", "key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    more = materialise(blocks_.groupBy("key", "i", "j").applyInArrow(_between(percent), "src long, dst long").distinct(), "links")
    # The second closure is over what the first left: components as nodes.
    name = found.select("id", "component_id")
    lifted = more.join(name.select(F.col("id").alias("src"), F.col("component_id").alias("a")), "src", "left").join(name.select(F.col("id").alias("dst"), F.col("component_id").alias("b")), "dst", "left").select(F.coalesce("a", "src").alias("src"), F.coalesce("b", "dst").alias("dst"))
    again = components(lifted).select(F.col("id").alias("c"), F.col("component_id").alias("d"))
    final = member.join(found.select(F.col("id").alias("rep"), F.col("component_id").alias("c")), "rep", "left").withColumn("c", F.coalesce("c", "rep")).join(again, "c", "left").select("doc_id", F.coalesce("d", "c").alias("component_id"))
    for table in (bucket, marks, shingles, links, labelled, more):
        discard(table)
    if twice:
        named = final.join(nodes, final["doc_id"] == nodes["node"]).select("node", nodes["doc_id"], "text_key", "component_id")
        lead = nodes.select(F.col("node").alias("component_id"), F.col("doc_id").alias("lead"))
        named = named.join(lead, "component_id").select("doc_id", "text_key", F.col("lead").alias("component_id"), (F.col("node") == F.col("component_id")).alias("first"))
        alone = every.join(nodes, ["doc_id", "text_key"]).where("n_shingles = 0").select("doc_id", "text_key").distinct().select("*", F.col("doc_id").alias("component_id"), F.lit(True).alias("first"))
        out = every.select("doc_id", "text_key", "n_shingles").join(named.unionByName(alone), ["doc_id", "text_key"], "left")
        return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("first", F.lit(True)).alias("kept"), "text_key")
    out = every.select("doc_id", "n_shingles", "text_key").join(final, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "text_key")


def _with_both(pairs: DataFrame, things: DataFrame, name: str) -> DataFrame:
    """(src, dst, and the thing of each)."""
    a, b = things.select(F.col("id").alias("src"), F.col(name).alias("of_src")), things.select(F.col("id").alias("dst"), F.col(name).alias("of_dst"))
    return pairs.join(a, "src").join(b, "dst").select("src", "dst", "of_src", "of_dst")
