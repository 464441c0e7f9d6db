"""Similarity, numeric, geometric and reward functions as Column expressions (SIM-*, NUM-*, GEO-*, RWD-*, DAT-01)."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def _or(value: Column, below: Column, empty: float) -> Column:
    return F.when(below == 0, F.lit(empty)).otherwise(value)


def edits(a, b) -> int | None:
    """Edit distance of two texts, in code points, or of two lists, by bit vectors over the shorter text (Myers, Hyyrö): a step of the longer one costs a few operations on one long integer."""
    if a is None or b is None:
        return None
    if len(a) < len(b):
        a, b = b, a
    m = len(b)
    if not m or a == b:
        return len(a) - m
    places: dict = {}
    for i, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << m) - 1
    up, down = full, 0
    for c in a:
        same = places.get(c, 0)
        vertical = same | down
        flat = (((same & up) + up) ^ up) | same
        plus, minus = (down | full & ~(flat | up)) << 1 | 1, (up & flat) << 1
        up, down = (minus | ~(vertical | plus)) & full, plus & vertical & full
    return len(a) + up.bit_count() - down.bit_count()  # the last column's differences, from its top on


WORDS, CODES, MASKS = 8192, 1 << 22, 1 << 22
"""What a group of pairs holds at most, unless it is one pair: 64-bit words of columns, places of texts, words of masks. A pair of more masks goes through edits()."""


def edits_of(pairs: Iterable[tuple[np.ndarray, np.ndarray] | None]) -> list[int | None]:
    """edits() of many pairs of integer arrays.

    Pairs of about one length go side by side: a pair's column is cut into words of 64 places, and a word takes at each step the text's place
    one behind that of the word before, whose horizontal difference it got the step before; so a step is one numpy expression over all words
    of all pairs. Texts are aligned at their ends; before its begin a text's words stay as they are.
    """
    found: list[int | None] = []
    todo = []
    for i, pair in enumerate(pairs):
        if pair is None:
            found.append(None)
            continue
        a, b = pair if len(pair[0]) >= len(pair[1]) else pair[::-1]
        n = len(b)
        differ = np.flatnonzero(a[:n] != b)
        low = int(differ[0]) if len(differ) else n
        back = np.flatnonzero(a[len(a) - n + low :] != b[low:])
        high = n - low - 1 - int(back[-1]) if len(back) else n - low
        a, b = a[low : len(a) - high], b[low : n - high]  # without what both begin and end with
        found.append(len(a))
        if len(b):
            todo.append((len(a), i, a, b))
    todo.sort(key=lambda x: (x[0], x[1]))
    group: list = []
    words = codes = masks = 0

    def done() -> None:
        if group:
            few = sum(len(a) * (1.2 + 0.0006 * len(b)) for _, a, b, _, _ in group) < len(group[-1][1]) * (30 + 0.012 * words)  # about the microseconds of either way
            for (i, *_), d in zip(group, [edits(a.tolist(), b.tolist()) for _, a, b, _, _ in group] if few else _side_by_side(group), strict=True):
                found[i] = d

    for n, i, a, b in todo:
        kinds, own = np.unique(b, return_inverse=True)
        size = -(-len(b) // 64)
        if (len(kinds) + 1) * size > MASKS:
            found[i] = edits(a.tolist(), b.tolist())
            continue
        if group and (words + size > WORDS or words > WORDS // 8 and 2 * n > 3 * len(group[0][1]) or (len(group) + 1) * (n + 2 * size) > CODES or masks + (len(kinds) + 1) * size > MASKS):
            done()
            group, words, codes, masks = [], 0, 0, 0
        group.append((i, a, b, kinds, own))
        words, masks = words + size, masks + (len(kinds) + 1) * size
    done()
    return found


def _side_by_side(group: list) -> np.ndarray:
    """Edit distances of (id, text, column, the column's symbols, the column as places among these)."""
    one = np.uint64(1)
    sizes = np.array([-(-len(b) // 64) for _, _, b, _, _ in group])
    most, longest = int(sizes.max()), max(len(a) for _, a, _, _, _ in group)
    text = np.zeros((longest + most, len(group)), np.int64)  # where a place's masks begin; those of the first symbol, which stands for all others, are 0
    tables, began = [], 0
    for k, (_, a, b, kinds, own) in enumerate(group):
        n = int(sizes[k])
        table = np.zeros((len(kinds) + 1, n), np.uint64)
        at = np.arange(len(b))
        np.bitwise_or.at(table, (own.ravel() + 1, at >> 6), one << (at & 63).astype(np.uint64))
        place = np.minimum(np.searchsorted(kinds, a), len(kinds) - 1)
        text[:, k] = began
        text[longest - len(a) : longest, k] += np.where(kinds[place] == a, place + 1, 0) * n
        tables.append(table.ravel())
        began += table.size
    masks = np.concatenate(tables)
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    words = int(sizes.sum())
    used = np.full(words, 64, np.int64)
    used[first + sizes - 1] = [(len(b) - 1) % 64 + 1 for _, _, b, _, _ in group]
    inside = np.uint64((1 << 64) - 1) >> (64 - used).astype(np.uint64)
    lengths = np.array([len(a) for _, a, _, _, _ in group])
    distance, starts = lengths.copy(), longest - lengths
    up, down, same, x, y, plus = np.full(words, (1 << 64) - 1, np.uint64), *(np.zeros(words, np.uint64) for _ in range(5))
    steps, shifted, given = (np.zeros((2, words), np.uint64) for _ in range(3))  # horizontal differences 1 and -1; given is what the word before gave on
    up_step, down_step, up_shifted, down_shifted, less = *steps, *shifted, given[1]
    which, before = np.arange(words) - np.repeat(first, sizes) + np.repeat(text[0], sizes), np.empty(words, np.int64)
    gone, come, top = steps[:, :-1], given[:, 1:], np.uint64(63)
    begun = np.zeros((2, len(group)), np.uint64)
    take, add, either, both, unlike, no, left, right = np.take, np.add, np.bitwise_or, np.bitwise_and, np.bitwise_xor, np.bitwise_not, np.left_shift, np.right_shift
    for step in range(longest + most - 1):
        which, before = before, which
        add(before[:-1], 1, which[1:])
        which[first] = text[step]
        take(masks, which, 0, same, "clip")
        begun[0] = starts <= step
        given[:, first] = begun
        either(same, down, x)
        either(same, less, same)
        both(same, up, y)
        add(y, up, y)
        unlike(y, up, y)
        either(y, same, y)
        either(y, up, plus)
        no(plus, plus)
        either(plus, down, up_step)
        both(y, up, down_step)
        left(steps, one, shifted)
        either(shifted, given, shifted)
        right(gone, top, come)
        both(up_shifted, x, down)
        either(up_shifted, x, up)
        no(up, up)
        either(up, down_shifted, up)
        if step >= longest - 1:
            w = step - longest + 1  # the words that have now seen their whole text
            k = np.flatnonzero(sizes > w)
            i = first[k] + w
            distance[k] += np.bitwise_count(up[i] & inside[i]).astype(np.int64) - np.bitwise_count(down[i] & inside[i]).astype(np.int64)
    return distance.tolist()


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _edit_batch(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(edits_of(None if x is None or y is None else (_points(x), _points(y)) for x, y in zip(a, b, strict=True)), dtype="Int32")


def _token_batch(a: pa.Array, b: pa.Array) -> pa.Array:
    """Words are numbered for some rows at a time and never become Python's texts."""
    found: list[int | None] = []
    for low in range(0, len(a), 512):
        x, y = a.slice(low, 512), b.slice(low, 512)
        own, other = x.flatten(), y.flatten()
        numbers = pa.concat_arrays([own, other.cast(own.type)]).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        ends, ends_other = (np.cumsum(pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False)) for v in (x, y))
        ends_other = ends_other + len(own)
        null = pc.or_(x.is_null(), y.is_null()).to_numpy(zero_copy_only=False)
        sides = [np.split(numbers[: len(own)], ends[:-1]), np.split(numbers, ends_other[:-1])]
        sides[1][0] = sides[1][0][len(own) :]
        found += edits_of(None if no else (p, q) for no, p, q in zip(null, *sides, strict=True))
    return pa.array(found, pa.int32())


def edit_distance(a: Column, b: Column) -> Column:
    """levenshtein for long texts, in Arrow batches: the native one visits every pair of characters singly."""
    return F.pandas_udf(_edit_batch, "int")(a, b)


def token_edit_distance(a: Column, b: Column) -> Column:
    """Edit distance of two arrays of words, however many different ones; null where an array is."""
    return F.arrow_udf(_token_batch, "int")(a, b)


def anls(prediction: Column, references: Column, cut: float = 0.5) -> Column:
    """The best normalised edit similarity over the references; under the cut it is 0."""
    p = F.lower(F.trim(prediction))
    def one(r: Column) -> Column:
        r = F.lower(F.trim(r))
        most = F.greatest(F.length(p), F.length(r))
        s = _or(1 - F.levenshtein(p, r) / most, most, 1.0)
        return F.when(s < cut, 0.0).otherwise(s)
    return F.array_max(F.transform(references, one))


def jaccard(a: Column, b: Column) -> Column:
    """Of sets; 1 where both are empty."""
    both, all_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return _or(both / all_, all_, 1.0)


def set_precision(predicted: Column, truth: Column) -> Column:
    n = F.size(F.array_distinct(predicted))
    return _or(F.size(F.array_intersect(predicted, truth)) / n, n, 1.0)


def set_recall(predicted: Column, truth: Column) -> Column:
    return set_precision(truth, predicted)


def set_equal(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def positional_accuracy(a: Column, b: Column) -> Column:
    """Share of equal places; 0 for unequal lengths."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(F.size(a) != F.size(b), 0.0).otherwise(_or(same / F.size(a), F.size(a), 1.0))


def common_prefix_ratio(a: Column, b: Column) -> Column:
    """Length of the longest common prefix over the truth's (b's) length."""
    differ = F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y))
    first = F.array_position(differ, True)
    n = F.when(first == 0, F.least(F.size(a), F.size(b))).otherwise(first - 1)
    return _or(n / F.size(b), F.size(b), 1.0)


def token_f1(prediction: Column, truth: Column) -> Column:
    """Multiset F1 of the normalised words."""
    def words(c: Column) -> Column:
        return F.filter(F.split(T.squad_normal(c), " "), lambda w: w != "")
    p, t = words(prediction), words(truth)
    def count(a: Column, w: Column) -> Column:
        return F.size(F.filter(a, lambda x: x == w))
    common = F.aggregate(F.array_intersect(p, t), F.lit(0), lambda s, w: s + F.least(count(p, w), count(t, w)))
    return _or(2.0 * common / (F.size(p) + F.size(t)), F.size(p) + F.size(t), 0.0)


def relaxed_correct(prediction: Column, target: Column, tolerance: float = 0.05) -> Column:
    """Numbers (a percent sign divides by 100) within a relative tolerance; else, and for a target of 0, equal texts without case."""
    def number(c: Column) -> Column:
        c = F.trim(c)
        return F.when(c.endswith("%"), F.regexp_replace(c, "%$", "").try_cast("double") / 100).otherwise(c.try_cast("double"))
    p, t = number(prediction), number(target)
    same = F.lower(prediction) == F.lower(target)
    return F.when(p.isNotNull() & t.isNotNull() & (t != 0), F.abs(p - t) / F.abs(t) <= tolerance).otherwise(same)


def mean_relative_accuracy(prediction: Column, target: Column) -> Column:
    """Mean over the ten thresholds .50 to .95 of whether the relative error is within 1 - threshold."""
    error = F.abs(prediction - target) / F.abs(target)
    return F.aggregate(F.sequence(F.lit(0), F.lit(9)), F.lit(0.0), lambda s, i: s + (error <= 0.5 - 0.05 * i).cast("double")) / 10


def vqa_soft_accuracy(prediction: Column, answers: Column) -> Column:
    return F.least(F.lit(1.0), F.size(F.filter(answers, lambda a: F.lower(F.trim(a)) == F.lower(F.trim(prediction)))) / 3.0)


def relative_difference(prediction: Column, target: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.abs((prediction - target) / target))


def _whole(value: Column, *of: Column) -> Column:
    """Null where any of the columns is, which least() and greatest() pass over."""
    known = of[0].isNotNull()
    for c in of[1:]:
        known = known & c.isNotNull()
    return F.when(known, value)


def box_iou(a: list[Column], b: list[Column]) -> Column:
    """Of boxes (x1, y1, x2, y2); 0 where the union has no area, null for a box with a null."""
    wide = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    high = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    inter = wide * high
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return _whole(F.when(union > 0, inter / union).otherwise(0.0), *a, *b)


def centre_in_box(a: list[Column], b: list[Column]) -> Column:
    x, y = (a[0] + a[2]) / 2, (a[1] + a[3]) / 2
    return x.between(b[0], b[2]) & y.between(b[1], b[3])


def span_iou(start: Column, end: Column, start2: Column, end2: Column) -> Column:
    """Overlap over the hull of both spans; null for a span with a null."""
    overlap = F.greatest(F.lit(0.0), F.least(end, end2) - F.greatest(start, start2))
    hull = F.greatest(end, end2) - F.least(start, start2)
    return _whole(F.when(hull > 0, overlap / hull).otherwise(0.0), start, end, start2, end2)


def geo_proximity(lat: Column, lon: Column, lat2: Column, lon2: Column, scale_km: float = 100.0) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat) / 2), 2) + F.cos(F.radians(lat)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon) / 2), 2)
    return F.exp(-2 * 6371.0 * F.asin(F.sqrt(a)) / scale_km)


def clock_seconds(text: Column) -> Column:
    """h:m:s or m:s as seconds; null where malformed."""
    parts = F.transform(F.split(F.trim(text), ":"), lambda x: x.try_cast("double"))
    return F.when(F.size(parts).isin(2, 3), F.aggregate(parts, F.lit(0.0), lambda s, x: s * 60 + x))


# -- rewards -----------------------------------------------------------------------------------


def reward_exact(prediction: Column, answer: Column) -> Column:
    return (F.trim(prediction) == F.trim(answer)).cast("double")


def reward_choice(prediction: Column, answer: Column) -> Column:
    def letter(c: Column) -> Column:
        return F.upper(F.substring(F.regexp_replace(F.trim(c), r"^[.()\s]+", ""), 1, 1))
    return (letter(prediction) == letter(answer)).cast("double")


def reward_boolean(prediction: Column, answer: Column) -> Column:
    def said(c: Column) -> Column:
        c = F.lower(c)
        return F.when(c.contains("yes") | c.contains("true"), True).when(c.contains("no") | c.contains("false"), False)
    return F.coalesce((said(prediction) == said(answer)).cast("double"), F.lit(0.0))


def reward_number(prediction: Column, answer: Column) -> Column:
    """Equal last runs of digits and dots; signs don't count."""
    def last(c: Column) -> Column:
        return F.try_element_at(F.regexp_extract_all(c, F.lit(r"([0-9.]+)"), F.lit(1)), F.lit(-1))
    return F.coalesce((last(prediction) == last(answer)).cast("double"), F.lit(0.0))


def reward_ocr(prediction: Column, answer: Column) -> Column:
    s = 1 - F.least(F.lit(1.0), F.levenshtein(prediction, answer) / F.greatest(F.length(answer), F.lit(1)))
    return F.when(s < 0.5, 0.0).otherwise(s)


def reward_format(response: Column) -> Column:
    """One think part, then a box that takes at most a fifth of the response."""
    fits = response.rlike(r"(?s)^<think>.*</think>.*\\boxed\{.*\}") & (F.size(F.split(response, "<think>")) == 2)
    box = F.length(F.regexp_extract(response, r"(?s)\\boxed\{(.*)\}", 1))
    return (fits & (box / F.greatest(F.length(response), F.lit(1)) <= 0.2)).cast("double")


def reward(answer_type: Column, prediction: Column, answer: Column) -> Column:
    """The reward of an answer's type; of an unknown one, exact match."""
    return (
        F.when(answer_type == "choice", reward_choice(prediction, answer)).when(answer_type == "boolean", reward_boolean(prediction, answer))
        .when(answer_type == "number", reward_number(prediction, answer)).when(answer_type == "ocr", reward_ocr(prediction, answer))
        .otherwise(reward_exact(prediction, answer))
    )


def in_band(rewards: Column, low: float, high: float) -> Column:
    """Strictly between the bounds on average; without rewards, the middle counts."""
    mean = F.aggregate(rewards, F.lit(0.0), lambda s, x: s + x) / F.size(rewards)
    value = F.coalesce(F.when(F.size(rewards) > 0, mean), F.lit((low + high) / 2))
    return (value > low) & (value < high)
