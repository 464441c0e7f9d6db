"""Sinks (SNK-01, 02, 06, 07, 09..13); tar shards are in shards.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.storage import ranked, running
from corpusloom.sources.shards import shard_plan

__all__ = ["shard_plan"]


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", False).json(path)


def write_split(df: DataFrame, condition: str, path: str) -> None:
    """Two folders: to_filter=true holds the rows that the condition sets aside, also those where it is unknown."""
    df.withColumn("to_filter", F.coalesce(F.expr(condition), F.lit(True))).write.partitionBy("to_filter").json(path)


def write_shards(df: DataFrame, path: str, rows: int = 10_000, order: str | None = None) -> None:
    """SNK-06: files of at most so many rows. With an order, each file has consecutive rows and only the last one fewer, whatever the number of tasks."""
    if order is not None:  # a task's blocks come one after the other, the one that may be short at the end
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        df = ranked(df, order, name="_rank").withColumn("_block", F.floor(F.col("_rank") / rows)).repartition(parts, "_block").sortWithinPartitions("_rank").drop("_rank", "_block")
    df.write.option("maxRecordsPerFile", rows).parquet(path)


def write_by_split(df: DataFrame, path: str, split: str = "split") -> None:
    """SNK-07: a folder a split."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def write_token_documents(df: DataFrame, path: str, key: str, tokens: str) -> None:
    """SNK-09: (doc, tokens array<int>, length, pointer): the payload with the index that goes with it; pointer is where a document's tokens begin when all are laid end to end in order of key, in bytes of four a token."""
    sized = df.select(key, F.col(tokens).cast("array<int>").alias("tokens"), F.size(tokens).cast("long").alias("length"))
    running(sized, [], [key], "length", "_before").withColumn("pointer", F.col("_before") * 4).drop("_before").write.mode("overwrite").parquet(path)


def write_submission(df: DataFrame, path: str, order: str, most_rows: int = 1_000_000) -> None:
    """SNK-10: one JSON file of a benchmark's answers in order. Answers of one benchmark are few: more than most_rows is an error."""
    if df.limit(most_rows + 1).count() > most_rows:
        raise ValueError(f"more than {most_rows} rows for one file")
    df.orderBy(order).coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def merge_json(spark: SparkSession, paths: list[str], path: str, files: int = 1) -> None:
    """SNK-11: JSON line files as one (or as many as said, without a shuffle)."""
    spark.read.json(paths).coalesce(files).write.mode("overwrite").json(path)


def append_rollouts(df: DataFrame, path: str, version: str = "version") -> None:
    """SNK-12: appended to a folder a version."""
    df.write.mode("append").partitionBy(version).parquet(path)


def write_by_rank(df: DataFrame, path: str, rank: str = "rank") -> None:
    """SNK-13: JSON lines, a folder a rank."""
    df.write.mode("overwrite").partitionBy(rank).json(path)


def shard_index(planned: DataFrame) -> DataFrame:
    return planned.groupBy("shard").agg(F.count("*").alias("samples"))
