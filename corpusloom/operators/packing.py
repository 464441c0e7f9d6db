"""Length-bucketed sequence packing (PCK-01, PCK-02, AGG-28); rounds with seeds and batches are in mixing.py (PCK-03..09)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.storage import running


def buckets(items: DataFrame, length: str) -> DataFrame:
    """(length, items): the histogram that packing works on."""
    return items.groupBy(length).agg(F.count("*").alias("items"))


def histogram(items: DataFrame, length: str, low: float, high: float, bins: int = 10) -> DataFrame:
    """Equal-width bins low..high; the greatest value falls out of the last one, as numpy's digitize counts it."""
    return items.groupBy(F.floor((F.col(length) - low) * bins / (high - low)).alias("bin")).agg(F.count("*").alias("n"))


def box_plan(counts: dict[int, int], capacity: int, min_items: int = 1, min_ratio: float = 0.0) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Boxes as (lengths, times), best fit from the largest length down, over a histogram; and what no box of min_items items and min_ratio fill could take."""
    left = {a: n for a, n in counts.items() if 0 < a <= capacity and n > 0}
    boxes, unused = [], {a: n for a, n in counts.items() if a > capacity or a <= 0}
    while left:
        room, box, used = capacity, [], {}
        for a in sorted(left, reverse=True):
            many = min(room // a, left[a])
            if many:
                box += [a] * many
                used[a] = many
                room -= many * a
        times = max(1, min(left[a] // n for a, n in used.items()))
        if len(box) >= min_items and capacity - room >= min_ratio * capacity:
            boxes.append((tuple(box), times))
            gone = {a: n * times for a, n in used.items()}
        else:  # the largest piece can't be in a box that is good enough
            top = max(left)
            gone = {top: left[top]}
            unused[top] = unused.get(top, 0) + left[top]
        for a, n in gone.items():
            left[a] -= n
            if not left[a]:
                del left[a]
    return boxes, unused


ROUNDS = ((1, 0.96), (1, 0.95), (8, 0.9), (4, 0.92), (6, 0.92), (4, 0.9))
"""Fixed values: least items and least fill of each packing round."""


def pack(items: DataFrame, key: str, length: str, capacity: int, rounds: tuple[tuple[int, float], ...] = ROUNDS) -> DataFrame:
    """(key, length, box_id, slot): rounds over what the earlier ones left; box_id is null for items that no round took.

    The plan is made from the histogram, at most `capacity` rows; items find their box by their rank in their length, computed over many partitions.
    """
    left = {r[0]: r[1] for r in buckets(items, length).where(f"`{length}` <= {capacity}").collect()}
    slots, box_id, taken = [], 0, {}
    for min_items, min_ratio in rounds:
        made, left = box_plan(left, capacity, min_items, min_ratio)
        for box, times in made:
            for slot, a in enumerate(box):
                low = taken.get(a, 0)
                slots.append((a, low, low + times, box_id, slot))
                taken[a] = low + times
            box_id += times
    plan = items.sparkSession.createDataFrame(slots, "l long, low long, high long, first long, slot int")  # bounded by the histogram, not the items
    own = running(items.select(key, length), [length], [key], None, "_r")
    joined = own.join(plan, (own[length] == plan["l"]) & (F.col("_r") >= F.col("low")) & (F.col("_r") < F.col("high")), "left")
    return joined.select(key, length, (F.col("first") + F.col("_r") - F.col("low")).alias("box_id"), "slot")


def box_totals(packed: DataFrame, length: str) -> DataFrame:
    """Of packed items: boxes, items, tokens."""
    return packed.where("box_id IS NOT NULL").agg(F.count_distinct("box_id").alias("boxes"), F.count("*").alias("items"), F.sum(length).alias("tokens"))


def cumulative_lengths(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)])
