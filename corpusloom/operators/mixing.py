"""Mixing of datasets, exact splits and merges (SET-03..07, 10..14), packed samples (PCK-03..05, 07..09)."""

from __future__ import annotations

import bisect
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators.ordering import normalise_weights
from corpusloom.operators.storage import drop_settled, ranked, running, settle


# -- mixing ------------------------------------------------------------------------------------


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def _draws(spark: SparkSession, steps: int, weights: list[float], seed: int) -> DataFrame:
    """(position, dataset_index, k): the source of each step, by a hash of (seed, step), and how often it was drawn before."""
    edges, at = [], 0.0
    for w in weights[:-1]:
        at += w
        edges.append(at)
    u = F.pmod(F.xxhash64(F.lit(seed), "position"), F.lit(1 << 30)) / float(1 << 30)
    source = F.lit(len(weights) - 1)
    for i in range(len(edges) - 1, -1, -1):
        source = F.when(u < edges[i], i).otherwise(source)
    from corpusloom.operators.storage import running

    return running(spark.range(steps).withColumnRenamed("id", "position").withColumn("dataset_index", source), ["dataset_index"], ["position"], None, "k")


def interleave(datasets: list[DataFrame], order: str, weights: list[float] | None = None, seed: int = 42, stop: str = "first_exhausted") -> DataFrame:
    """(position, dataset_index, sample_index, and the rows): rows of each source in order, sources in turn or by a drawn weight.

    first_exhausted stops with the draw that takes a source's last row; all_exhausted goes on until every source has
    given each row once, shorter ones beginning again. An empty source ends the first kind at once; the second raises.
    Draws are hashes of (seed, step), another stream than the library's.
    """
    spark = datasets[0].sparkSession
    laid = [ranked(d, order, name="sample_index").withColumn("dataset_index", F.lit(i)) for i, d in enumerate(datasets)]
    sizes = [d.count() for d in datasets]
    m = len(datasets)
    over = stop == "all_exhausted"
    if over and not all(sizes):
        raise ValueError("a dataset without rows can't be drawn from over and over")
    if weights is None:
        if over:
            total = max(sizes) * m
        else:  # the source that ends first ends it: its last row is the last one
            total = min(i + m * (n - 1) + 1 for i, n in enumerate(sizes)) if all(sizes) else 0
            if not all(sizes):
                first_empty = sizes.index(0)
                total = first_empty if min((n for n in sizes[:first_empty]), default=1) else 0
        steps = spark.range(total).select(F.col("id").alias("position"), F.pmod("id", F.lit(m)).cast("int").alias("dataset_index"), F.floor(F.col("id") / m).alias("k"))
    else:
        share = normalise_weights(weights)
        guess = max(int(n / w) for n, w in zip(sizes, share, strict=True) if w > 0) if over else min(int(n / w) for n, w in zip(sizes, share, strict=True) if w > 0)
        while True:  # until the drawn steps reach the stop; the margin makes a second look rare
            guess = int(guess * 1.1) + 64 * m
            steps = settle(_draws(spark, guess, share, seed), "draws")
            ends = {r["dataset_index"]: r["e"] for r in _union([steps.where((F.col("dataset_index") == i) & (F.col("k") == n - 1)).agg(F.min("position").alias("e")).withColumn("dataset_index", F.lit(i)) for i, (n, w) in enumerate(zip(sizes, share, strict=True)) if w > 0]).collect()}
            known = [e for e in ends.values() if e is not None]
            if (over and len(known) == len(ends)) or (not over and known):
                last = max(known) if over else min(known)
                break
            if not over and not all(sizes):
                last = -1
                break
        steps = steps.where(F.col("position") <= last)
    size = F.lit(1)
    for i, n in enumerate(sizes):
        size = F.when(F.col("dataset_index") == i, max(n, 1)).otherwise(size)
    steps = steps.withColumn("sample_index", F.pmod(F.col("k"), size.cast("long"))).drop("k")
    return steps.join(_union(laid), ["dataset_index", "sample_index"])


def mix(datasets: list[DataFrame], order: str, strategy: str = "concat", weights: list[float] | None = None, seed: int = 42) -> DataFrame:
    """SET-02..04: concat (weights are not used), interleave_under, interleave_over."""
    if strategy == "concat":
        return _union(datasets)
    if strategy in ("interleave_under", "interleave_over"):
        return interleave(datasets, order, weights, seed, "first_exhausted" if strategy == "interleave_under" else "all_exhausted")
    raise ValueError(f"unknown strategy {strategy}")


def blend_steps(weights: list[float], size: int):
    """(dataset_index, sample_index) of each of size steps, a step drawing from the dataset whose share lags most, ties to the first."""
    share = normalise_weights(weights)
    drawn = [0] * len(share)
    for step in range(size):
        at = max(step, 1)
        lag = [w * at - n for w, n in zip(share, drawn, strict=True)]
        i = lag.index(max(lag))
        yield i, drawn[i]
        drawn[i] += 1


BLEND_RANGE = 1 << 20
"""Steps that one task makes of a blend."""
BLEND_BLOCK = 1 << 12
"""Steps of a block; a range's blocks are stepped through together."""


def even_counts(share: list[float], step: int) -> np.ndarray:
    """About how many rows each dataset has given before a step: its share rounded, step in all."""
    exact = np.array(share) * step
    n = np.floor(exact).astype(np.int64)
    short = step - int(n.sum())
    n[np.argsort(n - exact, kind="stable")[: max(short, 0)]] += 1
    n[int(np.argmax(n))] -= max(-short, 0)
    return n


def blend_block(share: list[float], start: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(dataset_index, sample_index, counts after it) of the steps begin .. end - 1, given the counts before them: exactly those of blend_steps.

    All blocks begin at guessed counts and are stepped through together, in numpy. Where a block's begin isn't the end of the one
    before, it is made again from there, until all fit: of two runs with other counts, the one behind in a dataset draws it
    first, so they soon are one and few blocks are made twice.
    """
    w = np.array(share)
    first = np.arange(begin, end, BLEND_BLOCK)
    size = np.minimum(BLEND_BLOCK, end - first)
    starts = np.stack([start, *[even_counts(share, int(t)) for t in first[1:]]])
    ends = np.empty_like(starts)
    which, sample = np.empty((BLEND_BLOCK, len(first)), np.int32), np.empty((BLEND_BLOCK, len(first)), np.int64)
    todo = np.arange(len(first))
    while len(todo):
        n, row = starts[todo].copy(), np.arange(len(todo))
        for t in range(int(size[todo].max())):
            at = np.maximum(first[todo] + t, 1)[:, None]
            i = np.argmax(w * at - n, axis=1)
            which[t, todo], sample[t, todo] = i, n[row, i]
            n[row, i] += 1
            if t + 1 == int(size[-1]) and todo[-1] == len(first) - 1:
                ends[-1] = n[-1]  # the last block may be shorter
        whole = todo[size[todo] == BLEND_BLOCK]
        ends[whole] = n[size[todo] == BLEND_BLOCK]
        wrong = np.flatnonzero((starts[1:] != ends[:-1]).any(axis=1)) + 1
        starts[wrong] = ends[wrong - 1]
        todo = wrong
    order = which.T.ravel()[: end - begin], sample.T.ravel()[: end - begin]
    return *order, ends[-1]


def blend_index(spark: SparkSession, weights: list[float], size: int) -> DataFrame:
    """(position, dataset_index, sample_index) of blend_steps, in ranges of BLEND_RANGE steps that tasks make side by side.

    A step needs the counts of all steps before. Each range guesses those at the begin of the range before, makes that one
    too, and so mostly arrives at the right counts; ranges that don't begin where the one before ended are made again from there
    until none is left, so the result is that of the loop whatever the guesses were. The counts stay in a table of one
    row a range.
    """
    import pandas as pd

    share = normalise_weights(weights)
    ranges = -(-size // BLEND_RANGE)

    def bounds(r: int) -> tuple[int, int]:
        return r * BLEND_RANGE, min(size, (r + 1) * BLEND_RANGE)

    def guess(frames):
        for frame in frames:
            for r in frame["id"].tolist():
                if r > 1:
                    start = blend_block(share, even_counts(share, bounds(r - 1)[0]), *bounds(r - 1))[2]
                else:
                    start = np.zeros(len(share), np.int64) if not r else blend_block(share, np.zeros(len(share), np.int64), *bounds(0))[2]
                yield pd.DataFrame({"r": [r], "start": [start], "end": [blend_block(share, start, *bounds(r))[2]]})

    def again(frames):
        for frame in frames:
            for r, start in zip(frame["r"].tolist(), frame["start"], strict=True):
                yield pd.DataFrame({"r": [r], "start": [start], "end": [blend_block(share, np.asarray(start), *bounds(r))[2]]})

    def steps(frames):
        for frame in frames:
            for r, start in zip(frame["r"].tolist(), frame["start"], strict=True):
                which, sample, _ = blend_block(share, np.asarray(start), *bounds(r))
                for at in range(0, len(which), 100_000):
                    few = slice(at, at + 100_000)
                    yield pd.DataFrame({"position": bounds(r)[0] + at + np.arange(len(which[few])), "dataset_index": which[few], "sample_index": sample[few]})

    kinds, out = "r long, start array<long>, end array<long>", "position long, dataset_index int, sample_index long"
    states = settle(spark.range(0, ranges, 1, max(1, min(ranges, 4096))).mapInPandas(guess, kinds), "blend")
    while True:
        fits = states.join(states.select((F.col("r") + 1).alias("r"), F.col("end").alias("before")), "r", "left")
        wrong = settle(fits.where("before IS NOT NULL AND before <> start").select("r", F.col("before").alias("start")), "blend")
        if not wrong.take(1):
            drop_settled(wrong)
            break
        redone = wrong.repartition(4096 if ranges > 4096 else ranges, "r").mapInPandas(again, kinds)
        now = settle(states.join(wrong, "r", "left_anti").unionByName(redone), "blend")
        drop_settled(states)
        drop_settled(wrong)
        states = now
    return states.repartitionByRange(max(1, min(ranges, 4096)), "r").mapInPandas(steps, out)


def blended_rows(datasets: list[DataFrame], index: DataFrame, order: str, sizes: list[int]) -> DataFrame:
    """SET-07: the rows of an index; IndexError where a dataset has fewer than the index takes of it."""
    for i, (d, n) in enumerate(zip(datasets, sizes, strict=True)):
        if (has := d.limit(n).count()) < n:
            raise IndexError(f"the blend takes {n} rows of dataset {i}, which has {has}")
    laid = _union([ranked(d, order, name="sample_index").withColumn("dataset_index", F.lit(i)) for i, d in enumerate(datasets)])
    return index.join(laid, ["dataset_index", "sample_index"])


def blend_exhaustive(datasets: list[DataFrame], sizes: list[int], order: str) -> DataFrame:
    """SET-06: (position, dataset_index, sample_index, and the rows): exactly sizes[i] rows of each dataset, spread evenly: the k-th of n stands at (k + 1/2) / n of the way, ties to the lesser dataset."""
    spark = datasets[0].sparkSession
    steps = _union([spark.range(n).select(F.lit(i).alias("dataset_index"), F.col("id").alias("sample_index"), ((F.col("id") + 0.5) / max(n, 1)).alias("_at")) for i, n in enumerate(sizes)])
    return blended_rows(datasets, ranked(steps, "_at", "dataset_index", name="position").drop("_at"), order, sizes)


def blend(datasets: list[DataFrame], weights: list[float], size: int, order: str) -> DataFrame:
    """SET-05: (position, dataset_index, sample_index, and the rows): size draws, each from the dataset with the greatest sampling error."""
    index = settle(blend_index(datasets[0].sparkSession, weights, size), "blend")
    taken = {r["dataset_index"]: r["n"] for r in index.groupBy("dataset_index").agg((F.max("sample_index") + 1).alias("n")).collect()}  # one row a dataset
    return blended_rows(datasets, index, order, [taken.get(i, 0) for i in range(len(datasets))])


# -- splits and merges -------------------------------------------------------------------------


def split_matrix(split: str) -> list[tuple[float, float] | None]:
    """SET-10: the shares of train, valid and test, such as '969,30,1' or '99.9/0.1', as (begin, end) of the whole; None for an empty one."""
    parts = [float(x) for x in split.replace("/", ",").split(",") if x.strip()] if isinstance(split, str) else list(split)
    parts = (parts + [0.0] * 3)[:3]
    if any(p < 0 for p in parts) or sum(parts) <= 0:
        raise ValueError("a split needs parts of 0 or more, not all 0")
    out, at = [], 0.0
    for p in parts:
        end = at + p / sum(parts)
        out.append((at, end) if p else None)
        at = end
    return out


def split_overlap(a: str, b: str) -> list[tuple[float, float] | None]:
    """Where two splits agree, part by part; None where they don't overlap."""
    out = []
    for x, y in zip(split_matrix(a), split_matrix(b), strict=True):
        low, high = (max(x[0], y[0]), min(x[1], y[1])) if x and y else (1.0, 0.0)
        out.append((low, high) if low < high else None)
    return out


def split_exact(rows: DataFrame, split: str, *order: str) -> DataFrame:
    """Adds `split`: consecutive runs in order, from round(begin * n) to round(end * n)."""
    n = rows.count()
    at = F.lit(None).cast("string")
    for name, part in zip(("train", "valid", "test"), split_matrix(split), strict=True):
        if part:
            at = F.when((F.col("_r") >= int(round(part[0] * n))) & (F.col("_r") < int(round(part[1] * n))), name).otherwise(at)
    return ranked(rows, *order, name="_r").withColumn("split", at).drop("_r")


def merge_indexed(parts: dict[str, DataFrame], doc: str) -> DataFrame:
    """SET-11: datasets by prefix in sorted order as one, document numbers continued; adds prefix. Each part's numbers are taken to begin at 0 without gaps."""
    out, offset = [], 0
    for prefix in sorted(parts):
        out.append(parts[prefix].withColumn(doc, F.col(doc) + offset).withColumn("prefix", F.lit(prefix)))
        offset += parts[prefix].agg(F.coalesce(F.max(doc) + 1, F.lit(0))).first()[0]
    return _union(out)


def merge_shards(shards: list[DataFrame], key: str) -> DataFrame:
    """SET-12: all rows; a key in more than one row is an error when the result is read."""
    every = _union(shards)
    twice = F.count("*").over(Window.partitionBy(key)) > 1
    checked = F.when(twice, F.raise_error(F.concat(F.lit(f"{key} is in more than one shard: "), F.col(key).cast("string"))).cast(every.schema[key].dataType)).otherwise(F.col(key))
    return every.withColumn(key, checked)


def common_names(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """SET-13."""
    return a.select(name).intersect(b.select(name))


def missing_columns(files: DataFrame) -> DataFrame:
    """SET-14: (file, missing) of (file, columns): what the union of all files has and a file lacks."""
    union = files.select(F.explode("columns").alias("c")).agg(F.array_sort(F.collect_set("c")).alias("_u"))  # column names only
    return files.join(F.broadcast(union)).select("file", F.array_except("_u", "columns").alias("missing")).where(F.size("missing") > 0)


# -- packing with seeds ------------------------------------------------------------------------


class Lengths:
    """How many items of each length are left, and the longest that fits: lengths of which none is left are skipped by union-find."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = {a: n for a, n in counts.items() if 0 < a <= capacity and n > 0}
        self.sorted = sorted(self.left)
        self.below = list(range(len(self.sorted) + 1))
        """For place i + 1 of sorted: the nearest place at or below it with items left; 0 is none."""

    def longest(self, room: int) -> int:
        """The longest length up to room of which items are left, 0 if none."""
        i = bisect.bisect_right(self.sorted, room)
        root = i
        while self.below[root] != root:
            root = self.below[root]
        while self.below[i] != root:
            self.below[i], i = root, self.below[i]
        return self.sorted[root - 1] if root else 0

    def box(self, seed: int, capacity: int) -> dict[int, int]:
        """A box of the seed and, always, as many as fit of the longest length that fits; nothing is taken yet."""
        used, room = {seed: 1}, capacity - seed
        top = room
        while room > 0 and (a := self.longest(min(room, top))):
            many = min(room // a, self.left[a] - used.get(a, 0))
            if many:
                used[a] = used.get(a, 0) + many
                room -= many * a
            top = a - 1
        return used

    def times(self, used: dict[int, int]) -> int:
        """How often in turn the same box would be made: as long as each length has what one box takes."""
        return min(self.left[a] // n for a, n in used.items())

    def take(self, used: dict[int, int], times: int) -> None:
        for a, n in used.items():
            self.left[a] -= n * times
            if not self.left[a]:
                i = bisect.bisect_left(self.sorted, a) + 1
                self.below[i] = i - 1

    def rest(self) -> dict[int, int]:
        return {a: n for a, n in self.left.items() if n}


Boxes = list[tuple[tuple[int, ...], int]]
"""Different boxes, each with how many of it there are."""


def _spelt(used: dict[int, int]) -> tuple[int, ...]:
    return tuple(a for a in sorted(used, reverse=True) for _ in range(used[a]))


def seeded_boxes(counts: dict[int, int], capacity: int, seeds: list[int], min_items: int, min_ratio: float) -> tuple[Boxes, dict[int, int]]:
    """PCK-03, PCK-04: boxes that begin with an item of a seed length, longest first, and are filled by best fit; kept if they have min_items and min_ratio, else their items stay.

    Equal boxes that would be made in turn are one entry with their number, and each entry uses up a length or all but a few of it: work and
    memory grow with the different lengths, not with items or boxes.
    """
    pool, boxes = Lengths(counts, capacity), []
    for s in sorted((s for s in set(seeds) if s in pool.left), reverse=True):
        while pool.left[s]:
            used = pool.box(s, capacity)
            if sum(used.values()) < min_items or sum(a * n for a, n in used.items()) < min_ratio * capacity:
                break
            many = pool.times(used)
            boxes.append((_spelt(used), many))
            pool.take(used, many)
    return boxes, pool.rest()


def seeds_half(counts: dict[int, int], half: int) -> list[int]:
    """custom_half: lengths of at least so much."""
    return [a for a in counts if a >= half]


def seeds_top(counts: dict[int, int], n: int) -> list[int]:
    """top_n: the n most frequent lengths, ties to the longer."""
    return sorted(counts, key=lambda a: (-counts[a], -a))[:n]


def simple_boxes(counts: dict[int, int], capacity: int, keys: list[int], m: int, min_ratio: float) -> tuple[Boxes, dict[int, int]]:
    """PCK-05: for each listed length up to m boxes of it and what fits beside it, kept at min_ratio."""
    pool, boxes = Lengths(counts, capacity), []
    for s in keys:
        made = 0
        while made < m and pool.left.get(s):
            used = pool.box(s, capacity)
            if sum(a * n for a, n in used.items()) < min_ratio * capacity:
                break
            many = min(m - made, pool.times(used))
            boxes.append((_spelt(used), many))
            pool.take(used, many)
            made += many
    return boxes, pool.rest()


#: Fixed values: (min_items, min_ratio) of the rounds with seeds of at least the mean length, and the bounds of what follows.
SEED_ROUNDS = ((1, 0.96), (1, 0.95), (8, 0.9), (4, 0.92), (6, 0.92), (4, 0.9))
MANY_LEFT, FEW_PACKED, TOP_SEEDS, TOP_ROUNDS, SIMPLE_LEFT = 10_000, 3_000, 20, 5, 100


def box_rounds(counts: dict[int, int], capacity: int) -> tuple[Boxes, dict[int, int]]:
    """PCK-06: full boxes first, then the seed rounds; while more than MANY_LEFT items are left, rounds with the most frequent lengths as seeds until one packs under FEW_PACKED, and the last round twice more; then simple boxes."""
    boxes, left = [], {a: n for a, n in counts.items() if 0 < a <= capacity and n > 0}

    def mean() -> int:
        return int(sum(left) / (len(left) + 1)) if left else 0

    def go(made: tuple[Boxes, dict]) -> int:
        nonlocal left
        before = sum(left.values())
        boxes.extend(made[0])
        left = made[1]
        return before - sum(left.values())

    go(seeded_boxes(left, capacity, list(left), 1, 1.0))
    for items, fill in SEED_ROUNDS:
        go(seeded_boxes(left, capacity, seeds_half(left, mean()), items, fill))
    if sum(left.values()) > MANY_LEFT:
        for _ in range(TOP_ROUNDS):
            if go(seeded_boxes(left, capacity, seeds_top(left, TOP_SEEDS), 4, 0.9)) < FEW_PACKED:
                break
    for _ in range(2):
        if sum(left.values()) > MANY_LEFT:
            go(seeded_boxes(left, capacity, seeds_half(left, mean()), 4, 0.9))
    if sum(left.values()) > SIMPLE_LEFT:
        go(simple_boxes(left, capacity, list(left)[::5][-20:], 10, 0.95))
    return boxes, left


def pack_seeded(items: DataFrame, key: str, length: str, capacity: int, plan: Callable[[dict[int, int]], Boxes] | None = None) -> DataFrame:
    """(key, length, box_id, slot) of the boxes that plan makes of the histogram of lengths (the rounds above if none is given); box_id is null for items that no box took.

    The driver receives the histogram, at most capacity rows, and plans different boxes with their numbers, so neither grows with the items.
    Items find their box and slot by their rank in their length, computed over many partitions.
    """
    counts = {r[0]: r[1] for r in items.groupBy(length).agg(F.count("*").alias("n")).where(f"`{length}` <= {capacity}").orderBy(length).collect() if r[0]}
    same: dict[tuple[int, ...], int] = {}
    for box, times in plan(counts) if plan else box_rounds(counts, capacity)[0]:
        same[box] = same.get(box, 0) + times
    rows, taken, box_id = [], {}, 0
    for box, times in same.items():
        for slot, a in enumerate(box):
            low = taken.get(a, 0)
            rows.append((a, low, low + times, box_id, slot))
            taken[a] = low + times
        box_id += times
    slots = items.sparkSession.createDataFrame(rows, "l long, low long, high long, first long, slot int")
    own = running(items, [length], [key], None, "_r")
    found = own.join(slots, (own[length] == slots["l"]) & (F.col("_r") >= F.col("low")) & (F.col("_r") < F.col("high")), "left")
    return found.select(key, length, (F.col("first") + F.col("_r") - F.col("low")).alias("box_id"), "slot")


def unpacked(items: DataFrame, packed: DataFrame, key: str) -> DataFrame:
    """PCK-07: items that no box has."""
    return items.join(packed.where("box_id IS NOT NULL").select(key), key, "left_anti")


def packed_samples(packed: DataFrame, samples: DataFrame, key: str, image: str, prompt: str, caption: str) -> DataFrame:
    """PCK-08: (box_id, images, prompts, captions) in the order of slots; a box has as many rows as its capacity allows."""
    own = packed.where("box_id IS NOT NULL").join(samples, key)
    boxes = own.groupBy("box_id").agg(F.array_sort(F.collect_list(F.struct("slot", F.col(image).alias("i"), F.col(prompt).alias("p"), F.col(caption).alias("c")))).alias("_s"))
    return boxes.select("box_id", F.transform("_s", lambda x: x["i"]).alias("images"), F.transform("_s", lambda x: x["p"]).alias("prompts"), F.transform("_s", lambda x: x["c"]).alias("captions"))


def pack_batches(items: DataFrame, key: str, length: str, capacity: int, batch: int = 10_000) -> DataFrame:
    """PCK-09: (key, length, batch, box, slot): batches of consecutive items, each packed by itself: next item, longest first, into the first box it fits in."""
    import pandas as pd

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([length, key], ascending=[False, True])
        rooms, boxes, slots, fill = [], [], [], []
        for a in frame[length]:
            i = next((i for i, r in enumerate(rooms) if r >= a), len(rooms))
            if i == len(rooms):
                rooms.append(capacity)
                fill.append(0)
            rooms[i] -= a
            boxes.append(i)
            slots.append(fill[i])
            fill[i] += 1
        return pd.DataFrame({key: frame[key], length: frame[length], "batch": frame["batch"], "box": boxes, "slot": slots})

    laid = ranked(items.select(key, length).where(F.col(length) <= capacity), key, name="_r").withColumn("batch", F.floor(F.col("_r") / batch)).drop("_r")
    kinds = {c: items.schema[c].dataType.simpleString() for c in (key, length)}
    return laid.groupBy("batch").applyInPandas(run, f"{key} {kinds[key]}, {length} {kinds[length]}, batch long, box int, slot int")
