"""Windows, hash samples, shuffles and splits (WIN-01, 03..05, 09, SMP-03, SMP-06, SHF-01, SHF-02, SET-01, SET-08..10, TOPK-01)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.storage import ranked, running


def collision_names(rows: DataFrame, name: str, order: str) -> DataFrame:
    """The first row of a name keeps it, the k-th becomes base_k.ext. A name that a third of all rows have lies in many tasks."""
    dot = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    k = F.col("_k")
    return running(rows, [name], [order], None, "_k").withColumn("unique_name", F.when(k == 0, F.col(name)).otherwise(F.concat(dot[0], F.lit("_"), k.cast("string"), dot[1]))).drop("_k")


def first_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of rows with one key, the one of least order; combined before the shuffle."""
    others = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*others), order).alias("_row")).select(*key, "_row.*")


def top_per_group(rows: DataFrame, group: str, score: str, order: str, k: int) -> DataFrame:
    """The k best rows of each group; Spark keeps k a task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def fixed_chunks(rows: DataFrame, key: str, tokens: str, size: int, pad: int | str | None = None) -> DataFrame:
    """(key, chunk, tokens): consecutive slices of size; the last one padded on the right if pad is given."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(tokens) - 1, F.lit(0)), F.lit(size))
    out = rows.where(F.size(tokens) > 0).select(key, F.posexplode(F.transform(starts, lambda s: F.slice(F.col(tokens), s + 1, size))).alias("chunk", "tokens"))
    if pad is not None:
        out = out.withColumn("tokens", F.concat("tokens", F.array_repeat(F.lit(pad), size - F.size("tokens"))))
    return out


def sample_cuts(documents: DataFrame, key: str, length: str, sequence_length: int, bucket: str | None = None) -> DataFrame:
    """([bucket,] key, first_sample, last_sample, offset): where each document's tokens fall when all documents (of a bucket) are laid end to end.

    Running sums go over many partitions, so that one bucket may hold most rows. Null lengths count 0.
    """
    by = [bucket] if bucket else []
    out = running(documents.select(*by, key, F.coalesce(F.col(length), F.lit(0)).alias("_n")), by, [key], "_n", "_b")
    return out.select(*by, key, F.expr(f"_b div {sequence_length}").alias("first_sample"), F.expr(f"greatest(_b + _n - 1, _b) div {sequence_length}").alias("last_sample"), F.expr(f"_b % {sequence_length}").alias("offset"))


def hash_order(seed: int, *key: str) -> Column:
    """A shuffle that a re-run repeats."""
    return F.xxhash64(F.lit(seed), *key)


def hash_sample(rows: DataFrame, key: str, percent: float, seed: int = 42) -> DataFrame:
    """About percent hundredths of the rows, by a hash of their key: no shuffle, the same rows whatever the partitions are."""
    return rows.where(F.pmod(hash_order(seed, key), F.lit(10_000)) < int(percent * 100))


def split_by_ratio(rows: DataFrame, key: str, split: str, seed: int = 1234) -> DataFrame:
    """Adds `split` (train, valid, test) for a ratio such as '969,30,1', by a hash of the key: disjoint, complete, without a shuffle."""
    parts = [float(x) for x in split.split(",")] + [0.0] * (3 - len(split.split(",")))
    total = sum(parts)
    u = F.pmod(hash_order(seed, key), F.lit(1_000_000)) / 1_000_000.0
    return rows.withColumn("split", F.when(u < parts[0] / total, "train").when(u < (parts[0] + parts[1]) / total, "valid").otherwise("test"))


def rank_split(rows: DataFrame, order: str, world: int, key: str, seed: int = 42) -> DataFrame:
    """Adds `worker`: round robin over a shuffle of all rows, by a hash of the key (ties by order), so that shares differ by one row at most."""
    return ranked(rows.withColumn("_h", hash_order(seed, key)), "_h", order, name="_r").withColumn("worker", F.pmod("_r", F.lit(world)).cast("int")).drop("_r", "_h")


def normalise_weights(weights: list[float]) -> list[float]:
    total = sum(weights)
    if total <= 0:
        raise ValueError("weights must have a positive sum")
    return [w / total for w in weights]


def parse_blend(arguments: list[str]) -> tuple[list[str], list[float] | None]:
    """Prefixes, and weights if there is an even number of arguments and every other one is a number."""
    if len(arguments) % 2 == 0:
        try:
            return arguments[1::2], [float(x) for x in arguments[0::2]]
        except ValueError:
            pass
    return arguments, None


def blend_counts(weights: list[float], size: int) -> list[int]:
    """How many of the first size draws each dataset gives when every step draws from the one with the greatest sampling error."""
    from corpusloom.operators.mixing import blend_steps

    drawn = [0] * len(weights)
    for i, k in blend_steps(weights, size):
        drawn[i] = k + 1
    return drawn


def blend(datasets: list[DataFrame], weights: list[float], size: int, order: str) -> DataFrame:
    """See mixing.blend."""
    from corpusloom.operators import mixing

    return mixing.blend(datasets, weights, size, order)


def concat_aligned(datasets: list[DataFrame]) -> DataFrame:
    out = datasets[0]
    for d in datasets[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out
