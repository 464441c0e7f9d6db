"""Judges and their caches (UDF-09, UDF-10, EXT-21, STM-07, STM-08, JOIN-12, RTR-06, EXT-25): a judge is any function of texts that runs offline."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import answers as A
from corpusloom.operators.storage import append_in_waves


def request_key(*parts: Column) -> Column:
    """md5 of the parts joined by ||; null parts are empty."""
    return F.md5(F.concat_ws("||", *[F.coalesce(p, F.lit("")) for p in parts]))


def judged(requests: DataFrame, key: str, prompt: str, judge: Callable[[list[str]], list[str]], batch: int = 100) -> DataFrame:
    """Adds `answer`: the judge sees up to `batch` prompts at a time; rows keep their key, so order doesn't matter. Null prompts are not sent.

    The judge runs again for a task that is run again, so it should be a pure function or look in a cache.
    """
    schema = requests.select(key, prompt)
    kind = schema.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            asked = f[f[prompt].notna()]
            said = [x for i in range(0, len(asked), batch) for x in judge(asked[prompt].iloc[i : i + batch].tolist())]
            yield pd.DataFrame({key: asked[key], "answer": said})

    return requests.join(schema.mapInPandas(run, f"{key} {kind}, answer string"), key, "left")


def evaluate_binary(rows: DataFrame, key: str, question: str, answer: str, prediction: str, judge: Callable, yes_no: bool = False) -> DataFrame:
    """Adds prompt, answer (raw) and result."""
    asked = rows.withColumn("prompt", A.judge_prompt("correctness" if yes_no else "binary", question=F.col(question), reference=F.col(answer), prediction=F.col(prediction)))
    return judged(asked, key, "prompt", judge).withColumn("result", A.judged_binary(F.col("answer"), yes_no))


def evaluate_comparative(rows: DataFrame, key: str, question: str, first: str, second: str, judge: Callable) -> DataFrame:
    asked = rows.withColumn("prompt", A.judge_prompt("comparative", question=F.col(question), first_response=F.col(first), second_response=F.col(second)))
    return judged(asked, key, "prompt", judge).withColumn("scores", A.judged_pair(F.col("answer")))


def evaluate_rubric(rows: DataFrame, key: str, question: str, prediction: str, rubric: dict[str, str], judge: Callable) -> DataFrame:
    """Adds scores: a map of the rubric's items to what the judge's JSON says of them; empty without JSON."""
    items = "\n".join(f"- {k}: {v}" for k, v in rubric.items())
    prompt = F.concat_ws("\n\n", F.lit("Score the response by each item of the rubric. Answer with one JSON object."), F.col(question), F.col(prediction), F.lit(items))
    out = judged(rows.withColumn("prompt", prompt), key, "prompt", judge)
    return out.withColumn("scores", F.coalesce(F.from_json(A.json_part(F.col("answer")), "map<string,double>"), F.expr("map()").cast("map<string,double>")))


# -- caches ------------------------------------------------------------------------------------


def cached(requests: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(hits with their value, misses) of requests against a cache (key, value, ...)."""
    known = cache.select(key, "value")
    return requests.join(known, key), requests.join(known, key, "left_anti")


def trimmed(cache: DataFrame, now: Column, ttl_seconds: int, max_size: int, order: str = "stored") -> DataFrame:
    """A cache (key, value, stored) without entries as old as ttl_seconds or beyond the max_size latest ones; of one key the latest counts.

    The latest are taken by a sort with a limit, of which each task keeps max_size rows.
    """
    fresh = cache.where(now.cast("double") - F.col(order).cast("double") < ttl_seconds)
    one = fresh.groupBy("key").agg(F.max_by(F.struct(*[c for c in fresh.columns if c != "key"]), order).alias("_e")).select("key", "_e.*")
    return one.orderBy(F.desc(order), "key").limit(max_size)


def save_cache(rows: DataFrame, folder: str, name: str) -> None:
    rows.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")


def load_cache(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """None where there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
    return spark.read.parquet(str(path)) if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else None


def delete_cache(spark: SparkSession, folder: str, prefix: str = "") -> list[str]:
    """Deletes the caches whose names begin with the prefix; says which."""
    top = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for s in fs.listStatus(top) if fs.exists(top) else []:
        name = s.getPath().getName()
        if name.startswith(prefix):
            fs.delete(s.getPath(), True)
            gone.append(name)
    return sorted(gone)


# -- embedding in blocks -----------------------------------------------------------------------


def embed_blocks(rows: DataFrame, key: str, text: str, model: Callable[[list[str]], list[list[float]]], folder: str, block_size: int = 1000, batch: int = 128) -> DataFrame:
    """(block_id, key, embedding) of all rows; only blocks that the folder doesn't have yet are embedded. They are written in several jobs, so a stopped run goes on after the last one that ended.

    Block ids are key div block_size, keys being integers of 0 or more. Texts go to the model sorted by length, so that a batch pads little.
    """
    spark = rows.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    there = fs.exists(where) and any(s.getPath().getName().startswith("block_id=") for s in fs.listStatus(where))
    blocked = rows.select(F.expr(f"`{key}` div {block_size}").cast("long").alias("block_id"), F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    if there:
        blocked = blocked.join(spark.read.parquet(folder).select(F.col("block_id").cast("long").alias("block_id")).distinct(), "block_id", "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f.iloc[f["t"].str.len().argsort(kind="stable")]
            vectors = [v for i in range(0, len(f), batch) for v in model(f["t"].iloc[i : i + batch].tolist())]
            yield pd.DataFrame({"block_id": f["block_id"], "id": f["id"], "embedding": vectors})

    append_in_waves(blocked, "block_id", lambda part: part.repartition("block_id").mapInPandas(run, "block_id long, id long, embedding array<float>"), folder)
    return spark.read.parquet(folder).select(F.col("block_id").cast("long").alias("block_id"), F.col("id").alias(key), "embedding")


def validate_blocks(rows: DataFrame, key: str, text: str, model: Callable, stored: DataFrame, block_size: int = 1000, every: int = 10) -> DataFrame:
    """RTR-07: of every `every`-th block (by hash, that being the sample), the rows whose embedding computed anew differs or is missing."""
    chosen = F.pmod(F.xxhash64(F.expr(f"`{key}` div {block_size}").cast("long")), F.lit(every)) == 0

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "again": model(f["t"].tolist()) if len(f) else []})

    again = rows.where(chosen).select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")).mapInPandas(run, "id long, again array<float>")
    both = again.join(stored.where(chosen).select(F.col(key).cast("long").alias("id"), "embedding"), "id", "full")
    return both.where(~F.col("again").eqNullSafe(F.col("embedding"))).select(F.col("id").alias(key))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
