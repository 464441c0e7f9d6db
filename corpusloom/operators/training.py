"""Training samples: padding, masks, windows, pairs, sampling orders, row projections and filters.

(ARR-02..07, WIN-02, WIN-06, WIN-08, SRT-01..03, LIM-01..03, SMP-01, SMP-04, PRT-01..03, EXT-02, EXT-06, EXT-16..19, EXT-23, FLT-07, FLT-15..23, PRJ-01..09, STM-03, STM-05)
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import answers as A
from corpusloom.operators.storage import FEW, least_rows, ranked

IGNORED = -100
"""Fixed value: the label of positions that no loss is taken of."""


# -- arrays of tokens --------------------------------------------------------------------------


def padded(tokens: Column, length: int, pad: int = 0, left: bool = False) -> Column:
    """Cut to length, then filled up with pad on the right or left."""
    cut = F.slice(tokens, 1, length)
    fill = F.array_repeat(F.lit(pad), F.greatest(F.lit(length) - F.size(cut), F.lit(0)))
    return F.concat(fill, cut) if left else F.concat(cut, fill)


def rounded_up(length: Column, multiple: int) -> Column:
    return F.ceil(length / multiple) * multiple


def shifted(tokens: Column, targets: Column, length: int, eod: int, pad: int) -> Column:
    """struct(tokens, labels, loss_mask, position_ids): both cut to length - 1, closed by eod, padded, labels one place ahead; no loss on pads and ignored labels."""
    def laid(x: Column) -> Column:
        return padded(F.concat(F.slice(x, 1, length - 1), F.array(F.lit(eod))), length + 1, pad)
    own = laid(tokens)
    labels = F.slice(laid(targets), 2, length)
    mask = F.transform(labels, lambda t: F.when((t == pad) | (t == IGNORED), 0.0).otherwise(1.0))
    return F.struct(F.slice(own, 1, length).alias("tokens"), labels.alias("labels"), mask.alias("loss_mask"), F.sequence(F.lit(0), F.lit(length - 1)).alias("position_ids"))


def masked_prompt(prompt: Column, response: Column) -> tuple[Column, Column]:
    """(tokens, targets): the prompt's targets are ignored."""
    return F.concat(prompt, response), F.concat(F.transform(prompt, lambda _: F.lit(IGNORED)), response)


def vision_positions(types: Column) -> Column:
    """Position ids of an array of token types (0 language, 1 vision): a run of vision tokens shares a position but for its first and last, which count as language."""

    def one(x: np.ndarray) -> np.ndarray:
        vision = np.concatenate([[False], x == 1, [False]])
        inner = vision[:-2] & vision[1:-1] & vision[2:]
        step = np.ones(len(x), dtype=np.int64)
        step[1:] = ~(inner[1:] & inner[:-1])
        step[:1] = 0
        return np.cumsum(step)

    @F.pandas_udf("array<long>")
    def run(xs: pd.Series) -> pd.Series:
        return xs.map(lambda x: None if x is None else one(np.asarray(x)))

    return run(types)


def hashed_unit(*parts: Column | int | str) -> Column:
    """A number in [0, 1) that depends on the parts alone, so that a task that is run again draws the same."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / float(1 << 30)


def masked_lm(tokens: Column, index: Column, vocabulary_size: int, mask_id: int, probability: float = 0.15, seed: int = 1234, special: tuple[int, ...] = ()) -> Column:
    """struct(text, labels, loss_mask): a share of the tokens is to be predicted, of which 80 % become the mask, 10 % a random token and 10 % stay; other labels are -1.

    Draws are hashes of (seed + index, place).
    """
    base = index.cast("long") + seed

    def one(t: Column, i: Column) -> Column:
        may = ~t.isin(*special) if special else F.lit(True)
        picked = may & (hashed_unit(base, i, 1) < probability)
        u = hashed_unit(base, i, 2)
        put = F.when(u < 0.8, F.lit(mask_id)).when(u < 0.9, F.floor(hashed_unit(base, i, 3) * vocabulary_size).cast("int")).otherwise(t.cast("int"))
        return F.struct(F.when(picked, put).otherwise(t.cast("int")).alias("text"), F.when(picked, t.cast("int")).otherwise(-1).alias("label"), picked.cast("int").alias("m"))

    def parts(x: Column) -> Column:
        pick = lambda name: F.transform(x, lambda v: v[name])
        return F.struct(pick("text").alias("text"), pick("label").alias("labels"), pick("m").alias("loss_mask"))

    return F.transform(F.array(F.transform(tokens, one)), parts)[0]


def sentence_pair(sentences: Column, index: Column, length: int, seed: int = 1234) -> Column:
    """struct(a, b, is_random, truncated): sentences (arrays of tokens) split at a drawn pivot, the halves swapped in half of the cases, then cut to the joint length.

    The longer part loses from its end or its beginning, by a draw for the whole sample where the library draws for every token.
    """
    base = index.cast("long") + seed
    n = F.size(sentences)
    pivot = F.when(n >= 3, 1 + F.floor(hashed_unit(base, 1) * (n - 1)).cast("int")).otherwise(1)
    swap = hashed_unit(base, 2) < 0.5
    first, second = F.flatten(F.slice(sentences, F.lit(1), pivot)), F.flatten(F.slice(sentences, pivot + 1, F.greatest(n - pivot, F.lit(0))))
    halves = F.struct(F.when(swap, second).otherwise(first).alias("a"), F.when(swap, first).otherwise(second).alias("b"))

    def cut(x: Column, keep: Column) -> Column:
        front = hashed_unit(base, 3) < 0.5
        return F.when(F.size(x) <= keep, x).when(front, F.slice(x, F.size(x) - keep + 1, keep)).otherwise(F.slice(x, F.lit(1), keep))

    def done(h: Column) -> Column:
        la, lb = F.size(h["a"]), F.size(h["b"])
        small = F.least(la, lb)
        room_small = F.least(small, F.lit(length // 2))
        keep_a = F.when(la + lb <= length, la).when(la <= lb, room_small).otherwise(length - room_small)
        keep_b = F.when(la + lb <= length, lb).when(la <= lb, length - room_small).otherwise(room_small)
        return F.struct(cut(h["a"], keep_a).alias("a"), cut(h["b"], keep_b).alias("b"), swap.cast("int").alias("is_random"), (la + lb > length).cast("int").alias("truncated"))

    return F.transform(F.array(halves), done)[0]


def alpaca(rows: DataFrame, key: str, instruction: str, query: str | None = None, output: str | None = None, system: str | None = None, history: str | None = None) -> DataFrame:
    """(key, prompt, response, system, d_len): earlier (query, response) pairs, then instruction and query joined by a line break; d_len counts all characters but the system's."""
    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))
    told = F.flatten(F.transform(history, lambda h: F.array(message("user", h["query"]), message("assistant", h["response"])))) if history else None
    asked = [F.nullif(F.col(c), F.lit("")) for c in (instruction, query) if c]
    last = F.array(message("user", F.concat_ws("\n", *asked)))
    none = F.slice(last, 1, 0)
    prompt = F.concat(F.coalesce(told, none), last) if history else last
    response = F.when(F.col(output).isNotNull(), F.array(message("assistant", F.col(output)))).otherwise(none) if output else none
    size = lambda c: F.coalesce(F.length(c), F.lit(0))
    n = sum((size(c) for c in asked), F.lit(0)) + (size(F.col(output)) if output else F.lit(0))
    if history:
        n = n + F.aggregate(F.coalesce(told, none), F.lit(0), lambda s, m: s + size(m["content"]))
    return rows.select(key, prompt.alias("prompt"), response.alias("response"), (F.col(system) if system else F.lit("")).alias("system"), n.cast("long").alias("d_len"))


def preference(rows: DataFrame, key: str, prompt: str, chosen: str, rejected: str) -> DataFrame:
    """EXT-16: (key, prompt, chosen, rejected): a user turn that asks for an answer, and two answers, each closed by the end mark."""
    asked = F.concat(F.lit("<|im_start|>user\n"), F.col(prompt), F.lit("<|im_end|>\n<|im_start|>assistant\n"))
    return rows.select(key, asked.alias("prompt"), F.concat(F.col(chosen), F.lit("<|im_end|>\n")).alias("chosen"), F.concat(F.col(rejected), F.lit("<|im_end|>\n")).alias("rejected"))


def inverse_cloze(blocks: DataFrame, key: str, sentences: str, length: int, keep: float = 0.1, title: str | None = None, seed: int = 1234) -> DataFrame:
    """EXT-18: (key, query, context): a drawn sentence (array of tokens) of the block as a query, and the rest, in which it stays with probability keep; cut to length less the marks, and the title."""
    at = F.floor(hashed_unit(seed, F.col(key), 1) * F.size(sentences)).cast("int") + 1
    stays = hashed_unit(seed, F.col(key), 2) < keep
    rest = F.when(stays, F.col(sentences)).otherwise(F.concat(F.slice(sentences, F.lit(1), at - 1), F.slice(sentences, at + 1, F.size(sentences))))
    room = F.lit(length - 2) if title is None else F.greatest(F.lit(length - 3) - F.size(title), F.lit(0))
    context = F.slice(F.flatten(rest), F.lit(1), room)
    whole = blocks.where(F.size(sentences) > 0)
    return whole.select(key, F.slice(F.element_at(sentences, at), 1, length - 2).alias("query"), (F.concat(F.col(title), context) if title else context).alias("context"))


# -- windows and orders ------------------------------------------------------------------------


def eval_windows(rows: DataFrame, key: str, tokens: str, length: int, overlap: int | None = None, pad: int = 0) -> DataFrame:
    """WIN-08: (key, window, text, pad_mask): windows of length + 1 tokens every `overlap`, padded; targets that an earlier window had are masked."""
    step = max(1, overlap or length)
    targets = F.greatest(F.size(tokens) - 1 - step, F.lit(0))
    count = F.greatest(F.ceil(targets / step).cast("int") + 1, F.lit(1))
    own = rows.withColumn("window", F.explode(F.sequence(F.lit(0), count - 1))).withColumn("_t", F.slice(tokens, F.col("window") * step + 1, length + 1))
    have = F.size("_t")
    fresh = lambda i: (F.col("window") == 0) | F.lit(step == length) | (i >= length - step)
    mask = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: ((i + 1 < have) & fresh(i)).cast("int"))
    return own.select(key, "window", padded(F.col("_t"), length + 1, pad).alias("text"), mask.alias("pad_mask"))


def crops(rows: DataFrame, key: str, height: str, width: str, size: int, stride: int) -> DataFrame:
    """EXT-02: (key, y, x, height, width): squares that overlap by size - stride; the last ones are what is left of the image, to be padded. Images no greater than a crop are one."""
    steps = lambda n: F.sequence(F.lit(0), F.greatest(F.ceil((F.col(n) - size) / float(stride)), F.lit(0)).cast("int"))
    own = rows.withColumn("_y", F.explode(steps(height))).withColumn("_x", F.explode(steps(width)))
    y, x = F.col("_y") * stride, F.col("_x") * stride
    return own.select(key, y.alias("y"), x.alias("x"), F.least(F.lit(size), F.col(height) - y).alias("height"), F.least(F.lit(size), F.col(width) - x).alias("width"))


def epochs(rows: DataFrame, wanted: int, *order: str) -> DataFrame:
    """WIN-06, STM-03: as many rows as wanted: all rows, over and over in order, the last epoch cut off; adds epoch and position. No rows give none."""
    n = rows.count()
    if not n:
        return rows.withColumn("epoch", F.lit(0)).withColumn("position", F.lit(0).cast("long"))
    times = -(-wanted // n)
    again = ranked(rows, *order, name="position").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return again.withColumn("position", F.col("position") + F.col("epoch") * n).where(F.col("position") < wanted)


def sorted_by_length(rows: DataFrame, length: str, key: str) -> DataFrame:
    """SRT-01, SRT-03: a global sort; ties by key."""
    return rows.orderBy(length, key)


def pooled(rows: DataFrame, order: str, length: str, pool: int, key: str, reshuffle: bool = False, seed: int = 42) -> DataFrame:
    """SRT-02: adds pool and place: pools of as many consecutive rows, sorted by length in each; with reshuffle they are shuffled again after the sort, as the published loader does."""
    from pyspark.sql import Window

    own = ranked(rows, order, name="_r").withColumn("pool", F.floor(F.col("_r") / pool)).drop("_r")
    by = [F.xxhash64(F.lit(seed) + F.col("pool"), F.col(key))] if reshuffle else [F.col(length), F.col(key)]
    return own.withColumn("place", F.row_number().over(Window.partitionBy("pool").orderBy(*by)) - 1)


def first_rows(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """LIM-01, LIM-02: the first n in order, ties by a hash of the row: each task keeps n, or, of more than FEW, all rows are ranked."""
    if n <= FEW:
        return rows.orderBy(*order).limit(n)
    return ranked(rows, *order, name="__rank").where(F.col("__rank") < n).drop("__rank")


def first_files(files: list[str], n: int | None) -> list[str]:
    """LIM-03."""
    return sorted(files)[:n]


def random_rows(rows: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """SMP-01: the n rows of least seeded hash of the key, ties by the key; no task has to hold them."""
    return least_rows(rows, n, F.xxhash64(F.lit(seed), key), key)


def wanted_rows(amount: float, total: int) -> int:
    """SMP-04: an amount under 1 is a share, else a number."""
    return int(amount * total) if amount < 1.0 else int(amount)


def percent_rows(rows: DataFrame, percent: float, key: str, seed: int = 42) -> DataFrame:
    """SRC-09, SMP-03: exactly max(1, floor(n * percent / 100)) rows, those of least seeded hash; none of an empty table."""
    n = rows.count()
    return random_rows(rows, max(1, int(n * percent // 100)), key, seed)


def host_split(rows: DataFrame, hosts: int, *order: str) -> DataFrame:
    """PRT-01: adds host: equal consecutive runs, the last one takes what is left."""
    n = rows.count()
    step = max(1, n // hosts)
    return ranked(rows, *order, name="_r").withColumn("host", F.least(F.floor(F.col("_r") / step), F.lit(hosts - 1)).cast("int")).drop("_r")


def array_split(rows: DataFrame, parts: int, *order: str) -> DataFrame:
    """PRT-03: adds part: consecutive runs whose sizes differ by one at most, the longer ones first."""
    n = rows.count()
    small, more = divmod(n, parts)
    edge = more * (small + 1)
    r = F.col("_r")
    at = F.when(r < edge, F.floor(r / (small + 1))).otherwise(more + F.floor((r - edge) / max(small, 1)))
    return ranked(rows, *order, name="_r").withColumn("part", at.cast("int")).drop("_r")


def rank_batches(rows: DataFrame, micro: int, rank: int, world: int, consumed: int = 0, drop_last: bool = True, order: str = "doc_id") -> DataFrame:
    """PRT-02, STM-05: adds batch: the rows after `consumed` in batches of micro * world, of which a rank takes its own run; a partial last batch goes unless drop_last is off."""
    whole = micro * world
    n = rows.count()
    if consumed >= n:
        raise ValueError(f"no samples left to consume: {consumed}, {n}")
    at = F.col("_r") - consumed
    own = ranked(rows, order, name="_r").where(F.col("_r") >= consumed).withColumn("batch", F.floor(at / whole)).withColumn("_k", F.pmod(at, F.lit(whole)))
    if drop_last:
        own = own.where(F.col("batch") < (n - consumed) // whole)
    return own.where((F.col("_k") >= rank * micro) & (F.col("_k") < (rank + 1) * micro)).drop("_r", "_k")


def random_batches(rows: DataFrame, micro: int, rank: int, world: int, consumed: int = 0, sharded: bool = True, order: str = "doc_id") -> DataFrame:
    """EXT-06: adds batch: an epoch's rows in a shuffle by (epoch, place), from where `consumed` stopped. sharded: each rank shuffles a run of its own; else ranks take turns in one shuffle. The epoch is consumed div the rows of whole batches."""
    whole = micro * world
    n = rows.count()
    active = n - n % whole
    if not active or consumed % active % whole:
        raise ValueError("there must be a whole batch, and whole batches consumed")
    epoch, now = divmod(consumed, active)
    laid = ranked(rows, order, name="_r")
    if sharded:
        bucket = n // whole * micro
        own = laid.where((F.col("_r") >= rank * bucket) & (F.col("_r") < (rank + 1) * bucket)).withColumn("_h", F.xxhash64(F.lit(epoch), "_r"))
        out = ranked(own, "_h", name="_k").where(F.col("_k") >= now // world).withColumn("_k", F.col("_k") - now // world)
    else:
        full = n // micro * micro
        own = ranked(laid.where(F.col("_r") < full).withColumn("_h", F.xxhash64(F.lit(epoch), "_r")), "_h", name="_k").where(F.col("_k") >= now)
        out = own.where(F.pmod(F.col("_k") - now, F.lit(world)) == rank).withColumn("_k", F.floor((F.col("_k") - now) / world))
    left = out.count()
    return out.withColumn("batch", F.floor(F.col("_k") / micro)).where(F.col("_k") < left - left % micro).drop("_r", "_h", "_k")


def imageless_names(rows: DataFrame, order: str, images: str, prefix: str = "text_") -> DataFrame:
    """WIN-02: adds name: rows without images are numbered among themselves, from 0."""
    bare = ranked(rows.where(F.coalesce(F.size(images), F.lit(0)) <= 0), order, name="_n").withColumn("name", F.concat(F.lit(prefix), F.col("_n").cast("string"))).drop("_n")
    return bare.unionByName(rows.where(F.coalesce(F.size(images), F.lit(0)) > 0).withColumn("name", F.lit(None).cast("string")))


def audio_tokens(samples: Column, rate: int = 16_000, stride: float = 0.01, down: int = 2, window: float | None = None) -> Column:
    """EXT-17: frames of a recording of so many samples, over the encoder's down-sampling; at least 1."""
    hop = int(stride * rate)
    frames = F.ceil((samples + 1) / hop) if window is None else F.floor((samples - int(window * rate)) / hop) + 1
    return F.greatest(F.lit(1), F.ceil(frames / down)).cast("int")


# -- rows --------------------------------------------------------------------------------------

#: Columns that go before training.
DROPPED = ("reward_model", "vanilla_prompt")


def without_columns(rows: DataFrame, names: tuple[str, ...] = DROPPED) -> DataFrame:
    """PRJ-01."""
    return rows.drop(*names)


def ground_truth(literal: Column) -> Column:
    """PRJ-03: the ground_truth of a Python-literal dict (or JSON object) as text; null without one."""
    import ast

    def one(x: str) -> str | None:
        try:
            got = ast.literal_eval(x)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return None
        found = got.get("ground_truth") if isinstance(got, dict) else None
        return None if found is None or found == "" else str(found)

    plain = F.get_json_object(literal, "$.ground_truth")  # most literals are read so; Python gets the others only
    return F.coalesce(plain, A.arrow_text(one)(F.when(plain.isNull(), literal)))


def judge_rows(rows: DataFrame, prompt: str = "prompt", reward_model: str = "reward_model") -> DataFrame:
    """PRJ-02, STR-07: answer from the reward model's ground truth, problem from the first user turn, with a line break after its first <image>; the prompt is kept as vanilla_prompt; constant answer and prompt types, problem type general where there is none."""
    truth = ground_truth(F.col(reward_model))
    said = F.try_element_at(F.filter(prompt, lambda m: m["role"] == "user"), F.lit(1))["content"]
    parts = F.split(said, "<image>", 2)
    broken = F.when(F.contains(said, F.lit("<image>")) & ~said.startswith("<image>\n"), F.concat(parts[0], F.lit("<image>\n"), F.get(parts, 1))).otherwise(said)
    out = rows.withColumn("answer", F.when(truth.isNotNull(), F.array(truth)).otherwise(F.array().cast("array<string>"))).withColumn("problem", F.coalesce(broken, F.lit("")))
    kind = F.coalesce(F.col("problem_type"), F.lit("general")) if "problem_type" in rows.columns else F.lit("general")
    return out.withColumnRenamed(prompt, "vanilla_prompt").withColumn("answer_type", F.lit("judge")).withColumn("prompt_type", F.lit("long")).withColumn("problem_type", kind)


def pair_messages(rows: DataFrame, messages: str = "massages:", image: str = "path") -> DataFrame:
    """PRJ-05: (messages, images) of pairs whose key is misspelt so in the published data; content before role, the image by its base name. A missing list is empty."""
    none = F.expr("cast(array() AS array<struct<content:string,role:string>>)")
    turned = F.transform(F.col(f"`{messages}`"), lambda m: F.struct(m["content"].alias("content"), m["role"].alias("role")))
    return rows.select(F.coalesce(turned, none).alias("messages"), F.array(F.regexp_extract(image, r"([^/]*)$", 1)).alias("images"))


def sample_key(id_: Column, path: Column) -> Column:
    """PRJ-07: id, or the path without one, full stops as underscores."""
    return F.replace(F.coalesce(id_, path), F.lit("."), F.lit("_"))


def media_kind(video: Column, image: Column) -> Column:
    """PRJ-08."""
    return F.when(video.isNotNull(), "video").when(image.isNotNull(), "image").otherwise("text")


def shard_folder(name: Column) -> Column:
    """PRJ-09: a shard's name without its number and suffix; `unknown` without a number."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"([^/]*)_[^_/]*$", 1), F.lit("")), F.lit("unknown"))


def task_prompt(images: Column, text: Column) -> Column:
    """EXT-23: parts (type, text, image), the images first."""
    return F.array_append(F.transform(F.coalesce(images, F.array().cast("array<string>")), lambda i: F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"), i.alias("image"))), F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("image")))


def within_length(rows: DataFrame, length: str, most: int) -> DataFrame:
    """FLT-16, FLT-17: rows of at most so many tokens; unknown lengths go."""
    return rows.where(F.col(length) <= most)


def valid_rows(rows: DataFrame, flag: str = "__valid__") -> DataFrame:
    """FLT-18: rows that are not marked as invalid, without the mark."""
    return rows.where(F.coalesce(F.col(f"`{flag}`"), F.lit(True))).drop(flag) if flag in rows.columns else rows


def with_some_image(rows: DataFrame, wanted: str, found: str) -> DataFrame:
    """FLT-20: rows that want images but have none go; rows that want none stay."""
    return rows.where((F.coalesce(F.size(wanted), F.lit(0)) <= 0) | (F.size(found) > 0))


def without_checker(rows: DataFrame, column: str = "generated_checker") -> DataFrame:
    """FLT-21."""
    return rows.where(F.col(column).isNull())


def above_score(rows: DataFrame, score: str, least: float = 6, subset: str | None = None, dropped: str | None = None) -> DataFrame:
    """FLT-22: strictly above a score, without one subset."""
    out = rows.where(F.col(score) > least)
    return out.where(~F.col(subset).eqNullSafe(F.lit(dropped))) if subset else out


def rated(rows: DataFrame, rating: str) -> DataFrame:
    """FLT-23: rows whose rating is not -1, which stands for none."""
    return rows.where(F.col(rating) != -1)


def all_black(image: Column) -> Column:
    """FLT-15: whether a portable pixmap or graymap (P5, P6) holds zeros only; null for other formats, which need a decoder."""
    import re

    def one(raw: bytes) -> bool | None:
        head = re.match(rb"P[56]\s+(?:#[^\n]*\s+)*(\d+)\s+(\d+)\s+(\d+)\s", raw)
        return None if head is None else not any(raw[head.end() :])

    return A.arrow_text(one, "boolean")(image)


def mask_box(mask: Column, width: Column, height: Column) -> Column:
    """EXT-15: [x1, y1, x2, y2] in shares of the image around the non-zero bytes of a row-major mask; the last row and column are inside; zeros for an empty mask or wrong sizes."""
    @F.pandas_udf("array<double>")
    def run(ms: pd.Series, ws: pd.Series, hs: pd.Series) -> pd.Series:
        out = []
        for m, w, h in zip(ms, ws, hs, strict=True):
            grid = np.frombuffer(m or b"", np.uint8)
            grid = grid.reshape(int(h), int(w)) if len(grid) and len(grid) == w * h else np.zeros((0, 0), np.uint8)
            rows, cols = np.flatnonzero(grid.any(axis=1)) if grid.size else [], np.flatnonzero(grid.any(axis=0)) if grid.size else []
            box = [cols[0] / w, rows[0] / h, (cols[-1] + 1) / w, (rows[-1] + 1) / h] if len(rows) else [0.0] * 4
            out.append([float(min(max(v, 0.0), 1.0)) for v in box])
        return pd.Series(out)

    return run(mask, width, height)
