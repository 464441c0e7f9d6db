"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import discard, materialise


def _toward_minimum(pairs: DataFrame) -> DataFrame:
    """For each u of pairs (u, v): the minimum of u and its neighbours, joined back to the pairs as m.

    min() is combined before the shuffle, and the join back can be split where one u has very many
    neighbours; no neighbour list is ever gathered.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component_id) for every node of edges (src, dst), component_id being the component's least id.

    Self-loops, repeated and reversed edges and an empty table are allowed; rows with a null end are no
    edges. Each round is written to shared storage; the loop ends when a round changes nothing.
    """
    now = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst"))).distinct()
    now, seen = materialise(now, "edges"), None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _toward_minimum(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _toward_minimum(large)
        nxt = small.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        nxt = materialise(nxt, "edges")
        state = nxt.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"), F.max("v").alias("m")).first()
        discard(now)
        now = nxt
        if seen == state:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
