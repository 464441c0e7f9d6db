"""Stateful streams: a shuffle buffer that outlives micro-batches and restarts, and a cache with a time to live and a greatest size (STM-02, STM-04, STM-07, SHF-03).

State is kept by lane, a hash of the key, so that lanes work side by side; each lane's state is bounded by a parameter and lives in the
query's checkpoint.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def state_store(spark: SparkSession):
    """Queries started inside keep state in the store that lists need; the session's setting is as before afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def _lanes(stream: DataFrame, key: str, lanes: int) -> DataFrame:
    return stream.withColumn("_lane", F.pmod(F.xxhash64(key), F.lit(lanes)).cast("int"))


def _rows(frames: Iterator[pd.DataFrame]) -> pd.DataFrame | None:
    held = [f for f in frames if len(f)]
    return pd.concat(held, ignore_index=True) if held else None


class _Buffer(StatefulProcessor):
    """A lane's buffer: rows as a list, and how many rows it has taken in so far, which the draws depend on."""

    def __init__(self, kind: StructType, size: int, key: str, seed: int):
        self.kind, self.size, self.key, self.seed = kind, size, key, seed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("buffer", self.kind)
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = _rows(rows)
        if new is None:
            return
        names = self.kind.fieldNames()
        new = new[names].sort_values(self.key, kind="stable")  # so that a batch that is run again draws alike
        seen = self.seen.get()[0] if self.seen.exists() else 0
        held, out = [tuple(r) for r in self.held.get()] if self.held.exists() else [], []
        draw = np.random.default_rng([self.seed, int(key[0]), seen])
        for row in new.itertuples(index=False, name=None):
            if len(held) < self.size:
                held.append(row)
                continue
            i = int(draw.integers(len(held)))
            out.append(held[i])
            held[i] = row
        self.held.put([_plain(r) for r in held])
        self.seen.update((seen + len(new),))
        if out:
            yield pd.DataFrame(out, columns=names).astype(new.dtypes.to_dict())

    def close(self) -> None:
        pass


def _plain(row: tuple) -> tuple:
    return tuple(x.item() if isinstance(x, np.generic) else x.to_pydatetime() if isinstance(x, pd.Timestamp) else None if x is pd.NaT else x for x in row)


def buffered(stream: DataFrame, key: str, size: int = 16_384, lanes: int = 8, seed: int = 42) -> DataFrame:
    """STM-02, SHF-03: the rows of a stream in a drawn order: each goes into its lane's buffer of `size` rows, and a full buffer gives a drawn row for each that comes.

    What is in the buffers stays there from one micro-batch to the next and from one start to the next; left_over() has it when a stream has ended, so every
    row comes once. Start the query inside state_store(). Columns must not be null where their type is a number, as pandas has it.
    """
    laned = _lanes(stream, key, lanes)
    return laned.groupBy("_lane").transformWithStateInPandas(_Buffer(stream.schema, size, key, seed), stream.schema, "Append", "None")


def left_over(spark: SparkSession, checkpoint: str, seed: int = 42) -> DataFrame:
    """The rows that buffered() has not given yet, from the checkpoint of a query that has stopped, in a drawn order."""
    rows = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "buffer").load()
    value = "list_element" if "list_element" in rows.columns else "list_value"
    own = rows if value == "list_element" else rows.select(F.explode("list_value").alias("list_element"))
    flat = own.select("list_element.*")
    return flat.orderBy(F.xxhash64(F.lit(seed), *flat.columns))


class _Cache(StatefulProcessor):
    """A lane's cache: keys with the times they were stored at, oldest first."""

    def __init__(self, size: int, ttl: float):
        self.size, self.ttl = size, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("cache", "key string, stored double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = _rows(rows)
        if new is None:
            return
        new = new.sort_values(["at", "n"], kind="stable")
        cache: dict[str, float] = {r[0]: r[1] for r in self.held.get()} if self.held.exists() else {}
        hits = []
        for name, at in zip(new["key"], new["at"], strict=True):
            hit = name in cache and at - cache[name] < self.ttl
            hits.append(hit)
            if not hit:
                cache.pop(name, None)
                cache[name] = at  # what was stored last is last, so the oldest is first
                if len(cache) > self.size:
                    del cache[next(iter(cache))]
        last = new["at"].iloc[-1]
        self.held.put([(k, float(v)) for k, v in cache.items() if not last - v >= self.ttl])  # expired ones can't be hit again
        yield pd.DataFrame({"n": new["n"], "key": new["key"], "hit": hits})

    def close(self) -> None:
        pass


def cached(requests: DataFrame, key: str, order: str, ts: str, ttl_seconds: float = 3600, max_size: int = 10_000, lanes: int = 1) -> DataFrame:
    """STM-07: (n, key, hit) of a stream of requests: whether the cache has the key, stored less than ttl_seconds before; if not it is stored then.

    Beyond max_size entries the one stored longest ago goes. With lanes, keys are dealt by hash to caches of max_size / lanes each. Requests of one
    micro-batch are taken by time, then order (a long, the result's n). Start the query inside state_store().
    """
    rows = requests.select(F.col(order).cast("long").alias("n"), F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").cast("double").alias("at"))
    return _lanes(rows, "key", lanes).groupBy("_lane").transformWithStateInPandas(_Cache(max(1, max_size // lanes), ttl_seconds), "n long, key string, hit boolean", "Append", "None")
