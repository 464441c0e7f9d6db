"""Caption metrics over n-grams: CIDEr with corpus document frequencies, GLEU (SIM-15)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.similarity import _counted, ngrams

#: Orders of n-grams, the width of the length penalty, the factor of the score.
ORDERS, SIGMA, SCALE = 4, 6.0, 10.0


def gleu(prediction: Column, references: Column, orders: int = ORDERS) -> Column:
    """Of arrays of words and an array of such: common n-grams of all orders over those of the longer side, for the reference that gives most; 0 without n-grams, null for null."""

    def run(p: pd.Series, r: pd.Series) -> pd.Series:
        def score(words, refs) -> float | None:
            if words is None or refs is None:
                return None
            own, best = [_counted(list(words), n) for n in range(1, orders + 1)], 0.0
            total = sum(c.total() for c in own)
            for ref in refs:
                theirs = [_counted(list(ref), n) for n in range(1, orders + 1)] if ref is not None else []
                most = max(total, sum(c.total() for c in theirs))
                if most:
                    best = max(best, sum((a & b).total() for a, b in zip(own, theirs, strict=False)) / most)
            return best

        return pd.Series([score(*x) for x in zip(p, r, strict=True)], dtype=object)

    return F.pandas_udf(run, "double")(prediction, references)


def _grams(rows: DataFrame, keys: list[str], words: str) -> DataFrame:
    """(keys, k, gram, tf) of arrays of words."""
    own = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(k).alias("k"), ngrams(F.col(words), k).alias("g")) for k in range(1, ORDERS + 1)])).alias("x"))
    return own.select(*keys, F.col("x.k").alias("k"), F.explode("x.g").alias("gram")).groupBy(*keys, "k", "gram").agg(F.count("*").alias("tf"))


def cider(rows: DataFrame, key: str, prediction: str, references: str) -> DataFrame:
    """(key, cider): rows of a unique key, an array of words and an array of reference arrays; 0 for what no n-gram joins, and where there is no reference.

    First come the numbers of rows in whose references an n-gram stands, counted before the shuffle; n-grams then weigh tf * log(rows / that). Of each order
    the clipped weighted products of a prediction and a reference over both lengths, times a penalty of the difference in words, are averaged
    over orders and references. An n-gram that very many rows have is one row of the frequencies, and its many rows are
    what the join can split. That join is the only one; then a row's n-grams are brought together once and summed up there.
    """
    base = rows.select(F.col(key).alias("id"), F.coalesce(prediction, F.array().cast("array<string>")).alias("p"), F.coalesce(references, F.array().cast("array<array<string>>")).alias("r"))
    refs = base.select("id", F.posexplode("r").alias("ref", "w")).where("w IS NOT NULL")
    n = base.count()
    theirs, own = _grams(refs, ["id", "ref"], "w"), _grams(base, ["id"], "p")
    often = theirs.select("id", "k", "gram").distinct().groupBy("k", "gram").agg(F.count("*").alias("df"))
    idf = F.log(F.lit(float(max(n, 1)))) - F.log(F.greatest(F.coalesce("df", F.lit(1)), F.lit(1)).cast("double"))

    both = own.withColumn("ref", F.lit(-1)).unionByName(theirs)  # reference -1: the prediction
    weighed = both.join(often.hint("merge"), ["k", "gram"], "left").select("id", "ref", "k", "gram", (F.col("tf") * idf).alias("w"))
    # Lengths go with them as order 0. All sums below are of one id, so none shuffles again.
    length = lambda c: F.greatest(F.size(c) - 1, F.lit(0)).cast("double").alias("w")
    lengths = base.select("id", F.lit(-1).alias("ref"), length("p")).unionByName(refs.select("id", "ref", length("w"))).withColumn("k", F.lit(0)).withColumn("gram", F.lit(None).cast("string"))
    x = weighed.unionByName(lengths).repartition("id")
    h, w = F.col("h"), F.col("w")
    grams = x.groupBy("id", "k", "gram").agg(F.max(F.when(F.col("ref") < 0, w)).alias("h"), F.collect_list(F.struct("ref", "w")).alias("all"))
    each = grams.select("id", "k", "h", F.explode("all").alias("x")).select("id", "k", "h", "x.ref", "x.w")
    sums = each.groupBy("id", "k", "ref").agg(F.sqrt(F.sum(w * w)).alias("norm"), F.sum(F.when(h.isNotNull(), F.least(h, w) * w)).alias("dot"), F.max("w").alias("length"))
    mine = sums.groupBy("id", "k").agg(F.max(F.when(F.col("ref") < 0, F.col("norm"))).alias("hn"), F.max(F.when(F.col("ref") < 0, F.col("length"))).alias("pl"), F.collect_list(F.when(F.col("ref") >= 0, F.struct("ref", "norm", "dot", "length"))).alias("all"))
    pairs = mine.select("id", "k", "hn", "pl", F.explode_outer("all").alias("x")).select("id", "k", "hn", "pl", "x.*")
    v = F.when((F.col("hn") > 0) & (F.col("norm") > 0), F.col("dot") / (F.col("hn") * F.col("norm"))).otherwise(F.col("dot"))
    penalty = F.exp(-F.pow(F.col("pl") - F.col("length"), F.lit(2.0)) / (2 * SIGMA**2))
    by_ref = pairs.groupBy("id", "ref").agg((F.sum(F.when(F.col("k") > 0, v)) / ORDERS).alias("v"), F.max(F.when(F.col("k") == 0, penalty)).alias("penalty"))
    scored = by_ref.groupBy("id").agg((SCALE * F.avg(F.coalesce("v", F.lit(0.0)) * F.col("penalty"))).alias("cider"))
    return scored.select(F.col("id").alias(key), F.coalesce("cider", F.lit(0.0)).alias("cider"))
