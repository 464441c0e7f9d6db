"""State that outlives micro-batches and restarts: every row once, drawn across batches; a cache as a plain loop has it."""

from pyspark.sql import functions as F

from corpusloom.streaming import iterate, stateful


def run(spark, stream, path, name):
    with stateful.state_store(spark):
        q = stream.writeStream.format("parquet").option("path", f"{path}/{name}").option("checkpointLocation", f"{path}/{name}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{path}/{name}")


def test_shuffle_buffer_goes_on_after_a_restart(spark, tmp_path):
    path = f"file://{tmp_path}"
    rows = spark.range(1000).select(F.col("id").alias("k"), F.concat(F.lit("r"), F.col("id")).alias("v"), F.timestamp_seconds(F.col("id")).alias("t"))
    for low in (0, 250, 500):
        rows.where(f"k >= {low} AND k < {low + 250}").coalesce(1).write.mode("append").parquet(f"{path}/in")
    kind = rows.schema
    stream = lambda: stateful.buffered(iterate.scan(spark, f"{path}/in", kind, 1), "k", size=60, lanes=2)
    first = run(spark, stream(), path, "out")
    assert first.count() == 750 - 120
    before = first.agg(F.max("k")).first()[0]
    rows.where("k >= 750").coalesce(1).write.mode("append").parquet(f"{path}/in")
    whole = run(spark, stream(), path, "out")
    left = stateful.left_over(spark, f"{path}/out-state")
    assert whole.count() == 880 and left.count() == 120 and left.columns == ["k", "v", "t"]
    every = whole.unionByName(left)
    assert every.distinct().count() == 1000 and every.exceptAll(rows).count() == 0
    later = whole.join(first, "k", "left_anti")
    assert before < 750 and later.where("k < 750").count() > 20  # rows of the first start come after the second's


def loop(requests, ttl, size):
    cache, out = {}, []
    for n, key, at in requests:
        hit = key in cache and at - cache[key] < ttl
        out.append((n, key, hit))
        if not hit:
            cache.pop(key, None)
            cache[key] = at
            if len(cache) > size:
                del cache[min(cache, key=cache.get)]
    return out


def test_cache_evicts_by_age_and_size(spark, tmp_path):
    path = f"file://{tmp_path}"
    rows = spark.range(600).select("id", F.concat(F.lit("k"), F.pmod(F.xxhash64("id"), F.lit(25))).alias("key"), F.timestamp_seconds(F.col("id") * 10).alias("ts"))
    for low in range(0, 600, 200):
        rows.where(f"id >= {low} AND id < {low + 200}").coalesce(1).write.mode("append").parquet(f"{path}/in")
    requests = [(r["id"], r["key"], r["id"] * 10.0) for r in rows.orderBy("id").collect()]
    for name, ttl, size in (("a", 200, 1000), ("b", 10_000, 10), ("c", 150, 12)):
        got = run(spark, stateful.cached(iterate.scan(spark, f"{path}/in", rows.schema, 1), "key", "id", "ts", ttl, size), path, name)
        assert sorted(map(tuple, got.collect())) == loop(requests, ttl, size)
        assert 50 < got.where("hit").count() < 550
