"""Tokens: the contract of a tokenizer, n-grams with a filter, groups of entities, keys of configurations, block samples (EXT-19, EXT-26, EXT-28, HSH-01)."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def config_key(config: dict) -> str:
    """md5 of a configuration's JSON, in the order of its keys: the name under which what it describes is cached."""
    return hashlib.md5(json.dumps(config, indent=4, default=str).encode()).hexdigest()


def config_keys(rows: DataFrame, *columns: str) -> Column:
    """The md5 of each row's columns as JSON."""
    return F.md5(F.to_json(F.struct(*[rows[c] for c in columns])))


class Tokenizer:
    """What a tokenizer must do: tokenize; detokenize and offsets if it can. Its description is its cache key."""

    def __init__(self, *paths: str, **options):
        self.description = json.dumps({"class": type(self).__name__, "paths": list(paths), **{k: str(v) for k, v in options.items()}}, indent=4)

    @property
    def key(self) -> str:
        return hashlib.md5(self.description.encode()).hexdigest()

    def tokenize(self, text: str) -> list[int]:
        raise NotImplementedError

    def detokenize(self, ids: list[int]) -> str:
        raise NotImplementedError(f"{type(self).__name__} has no method detokenize")

    def offsets(self, ids: list[int], text: str) -> list[int]:
        raise NotImplementedError(f"{type(self).__name__} has no method offsets")


class HashedWords(Tokenizer):
    """Words between white space, by a hash into so many ids: a tokenizer without a vocabulary."""

    def __init__(self, size: int = 50_000):
        super().__init__(size=size)
        self.size = size

    def tokenize(self, text: str) -> list[int]:
        return [int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little") % self.size for w in text.split()]

    def offsets(self, ids: list[int], text: str) -> list[int]:
        return [m.start() for m in re.finditer(r"\S+", text)][: len(ids)]


def tokenized(rows: DataFrame, text: str, tokenizer: Tokenizer) -> DataFrame:
    """Adds ids and, if the tokenizer has them, offsets; null texts have null ids."""

    @F.pandas_udf("ids array<int>, offsets array<int>")
    def run(x: pd.Series) -> pd.DataFrame:
        out = []
        for t in x:
            ids = None if t is None else tokenizer.tokenize(t)
            try:
                at = None if ids is None else tokenizer.offsets(ids, t)
            except NotImplementedError:
                at = None
            out.append((ids, at))
        return pd.DataFrame(out, columns=["ids", "offsets"])

    return rows.withColumn("_t", run(F.col(text))).withColumn("ids", F.col("_t.ids")).withColumn("offsets", F.col("_t.offsets")).drop("_t")


def grams_up_to(words: Column, n: int, skip: Callable[[Column], Column] | None = None) -> Column:
    """Texts of all runs of 1 to n words, by their beginning and then their length, but for those that skip says."""
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(1), F.size(words))).otherwise(F.array().cast("array<int>"))
    runs = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(n), F.size(words) - i + 1)), lambda k: F.slice(words, i, k))))
    kept = runs if skip is None else F.filter(runs, lambda g: ~skip(g))
    return F.transform(kept, lambda g: F.array_join(g, " "))


def entity_groups(words: Column, tags: Column, none: str = "O") -> Column:
    """array of (text, tag): consecutive words of one tag, but for the tag that stands for none; words joined by a space."""

    @F.pandas_udf("array<struct<text:string,tag:string>>")
    def run(ws: pd.Series, ts: pd.Series) -> pd.Series:
        out = []
        for w, t in zip(ws, ts, strict=True):
            groups: list[dict] = []
            before = none
            for word, tag in zip(w if w is not None else [], t if t is not None else [], strict=False):
                if tag != none:
                    if tag == before:
                        groups[-1]["text"] += " " + word
                    else:
                        groups.append({"text": word, "tag": tag})
                before = tag
            out.append(groups)
        return pd.Series(out, dtype=object)

    return run(words, tags)


def block_samples(documents: DataFrame, key: str, sizes: str, length: int, title: str | None = None, least: int = 2) -> DataFrame:
    """(key, block, first, last): consecutive sentences of a document (sizes array<int>) in blocks: one ends with the sentence by which it reaches length - 3 tokens less the title's; blocks of fewer than `least` sentences go."""

    @F.pandas_udf("array<struct<first:int,last:int>>")
    def run(every: pd.Series, room: pd.Series) -> pd.Series:
        out = []
        for x, most in zip(every, room, strict=True):
            blocks, first, total = [], 0, 0
            for i, n in enumerate(x if x is not None else []):
                total += n
                if total >= most or i == len(x) - 1:
                    if i + 1 - first >= least:
                        blocks.append({"first": first, "last": i + 1})
                    first, total = i + 1, 0
            out.append(blocks)
        return pd.Series(out, dtype=object)

    room = F.lit(length - 3) - (F.col(title) if title else F.lit(0))
    found = documents.select(key, F.posexplode(run(F.col(sizes), room)).alias("block", "b"))
    return found.select(key, "block", "b.first", "b.last")


def cached_block_samples(documents: DataFrame, folder: str, key: str, sizes: str, length: int, **options) -> DataFrame:
    """block_samples, written once below the folder under the key of what was asked for, and read from there afterwards."""
    from corpusloom.operators import judging

    name = f"blocks-{config_key({'key': key, 'sizes': sizes, 'length': length, **options})}"
    found = judging.load_cache(documents.sparkSession, folder, name)
    if found is None:
        judging.save_cache(block_samples(documents, key, sizes, length, **options), folder, name)
        found = judging.load_cache(documents.sparkSession, folder, name)
    return found
