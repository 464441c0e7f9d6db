"""Streaming counterparts of iterator pipelines (STM-*); event-time windows are an extension."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scan(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 4) -> DataFrame:
    """STM-01: files as they come; where a restart goes on is in the query's checkpoint (STM-04, STM-05)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def shuffled(batch: DataFrame, epoch: int, key: str, seed: int = 42) -> DataFrame:
    """STM-02: a micro-batch in hash order."""
    return batch.sort(F.xxhash64(F.lit(seed), F.lit(epoch), key))


def pooled_sort(batch: DataFrame, order: str, length: str, key: str, pool: int) -> DataFrame:
    """STM-10: adds pool and place: pools of as many consecutive rows, sorted by length in each."""
    from corpusloom.operators.training import pooled

    return pooled(batch, order, length, pool, key)


def buffered_shuffle(batch: DataFrame, key: str, buffer: int = 16_384, seed: int = 42) -> DataFrame:
    """SHF-03, STM-02: rows come out in a drawn order, each out of a buffer of so many that a task holds; a task sees no more at a time."""
    import random

    import pandas as pd

    names = batch.columns

    def run(frames):
        held: list = []
        for f in frames:
            drawn = random.Random(f"{seed}:{f[key].iloc[0] if len(f) else ''}")
            out = []
            for row in f.itertuples(index=False):
                held.append(row)
                if len(held) > buffer:
                    i = drawn.randrange(len(held))
                    held[i], held[-1] = held[-1], held[i]
                    out.append(held.pop())
            if out:
                yield pd.DataFrame(out, columns=f.columns)
        random.Random(seed).shuffle(held)
        if held:
            yield pd.DataFrame(held, columns=names)

    return batch.mapInPandas(run, batch.schema)


def cycle(spark: SparkSession, rows: DataFrame, order: str, per_second: int = 100) -> DataFrame:
    """STM-03: an endless stream of rows, over and over in order, at a rate; adds position and epoch. The rows are a static table that each micro-batch joins by position."""
    from corpusloom.operators.storage import ranked

    laid = ranked(rows, order, name="_r")
    n = laid.count()
    if not n:
        raise ValueError("no rows to go round")
    ticks = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    at = ticks.select(F.col("value").alias("position"), F.floor(F.col("value") / n).alias("epoch"), F.pmod("value", F.lit(n)).alias("_r"))
    return at.join(laid, "_r").drop("_r")


def resumed(rows: DataFrame, consumed: int, order: str) -> DataFrame:
    """STM-05: the rows after the first `consumed` ones in order."""
    from corpusloom.operators.storage import ranked

    return ranked(rows, order, name="_r").where(F.col("_r") >= consumed).drop("_r")


def deduplicated(stream: DataFrame, key: str, ts: str, ttl: str = "1 hour") -> DataFrame:
    """STM-07: of requests of one key within the time to live, the first; state older than it is dropped by the watermark."""
    return stream.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])


def flushed(rows: DataFrame, act: Callable[[list], list], column: str, returns: str, size: int = 100) -> DataFrame:
    """STM-08: adds result: act is called with up to `size` values at a time, and once more with what is left at a task's end."""
    import pandas as pd
    from pyspark.sql.types import StructField, _parse_datatype_string

    def run(frames):
        held = None
        for f in frames:
            held = f if held is None else pd.concat([held, f], ignore_index=True)
            full = len(held) // size * size
            if full:
                head, held = held.iloc[:full], held.iloc[full:].reset_index(drop=True)
                values = head[column].tolist()
                yield head.assign(result=[r for i in range(0, full, size) for r in act(values[i : i + size])])
        if held is not None and len(held):
            yield held.assign(result=act(held[column].tolist()))

    return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField("result", _parse_datatype_string(returns))]))


def pulled(tasks: list, work: Callable, spark: SparkSession) -> DataFrame:
    """STM-09: (task, result) of a list of tasks, each a Spark task of its own: free executors pull the next, lost ones are replaced. Tasks and results are texts."""
    import pandas as pd

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(tasks)], "n int, task string").repartition(max(1, len(tasks)), "n")

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"task": f["task"], "result": [work(t) for t in f["task"]]})

    return rows.mapInPandas(run, "task string, result string")


def tumbling(events: DataFrame, minutes: int = 60, late: str = "10 minutes", ts: str = "ts", kind: str = "event_type") -> DataFrame:
    """Extension: counts and sums by tumbling window and kind, with a watermark; the same plan for a batch and a stream."""
    source = events.withWatermark(ts, late) if events.isStreaming else events
    out = source.groupBy(F.window(ts, f"{minutes} minutes").alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), kind, "n", "total")


def accept_until(out_path: str, n: int, key: str, accept: str = "true") -> Callable[[DataFrame, int], None]:
    """STM-06, LIM-02: a foreachBatch that appends accepted rows until n are there.

    Each batch is a folder of its own, batch=<id>, written over when the batch runs again, and its count lies beside it, so
    neither rows nor counts of earlier batches are read again. A key that an earlier batch had is accepted again; for
    one row a key put deduplicated() before it.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        counts = f"{out_path.rstrip('/')}-counts"
        where = spark._jvm.org.apache.hadoop.fs.Path(counts)
        fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        done = 0
        for s in fs.listStatus(where) if fs.exists(where) else []:
            at, _, many = s.getPath().getName().partition("-")
            done += int(many) if int(at) < epoch else 0
        room = n - done
        if room <= 0:
            return
        fresh = batch.where(accept).orderBy(key).limit(room)
        fresh.write.mode("overwrite").parquet(f"{out_path}/batch={epoch}")
        many = spark.read.schema(batch.schema).parquet(f"{out_path}/batch={epoch}").count()
        for s in fs.listStatus(where) if fs.exists(where) else []:
            if s.getPath().getName().partition("-")[0] == str(epoch):
                fs.delete(s.getPath(), False)
        fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{counts}/{epoch}-{many}"), True).close()

    return step
