"""Costly work goes to as many tasks as a shuffle has, however small the files are."""

import pytest

from corpusloom.functions import symbolic
from corpusloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["rwd07_symbolic", "str32_latex_and_mojibake", "sim15_gleu", "rwd09_rewards", "stm08_flushes"])
def test_tasks(spark, name):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert catalog.QUERIES[name](spark, SF).rdd.getNumPartitions() >= n


def test_one_reading_an_expression(monkeypatch):
    """An expression is read and computed once, not once a prime."""
    read = []
    whole = symbolic.Reader.whole
    monkeypatch.setattr(symbolic.Reader, "whole", lambda self: read.append(1) or whole(self))
    assert symbolic.symbolic_equal("(x+3)^2", "x^2+6x+9")
    assert len(read) == 2


def test_each_text_once(spark):
    """A function of texts is called once for each different one of a batch."""
    import pandas as pd

    from corpusloom.functions import answers, similarity

    said = []
    one = answers.arrow_text(lambda v: said.append(v) or v.upper()).func
    assert one(pd.Series(["a", "b", None, "a"])).tolist() == ["A", "B", None, "A"] and said == ["a", "b"]
    both = []
    two = similarity.arrow_pair(lambda x, y: both.append((x, y)) or x + y, "string").func
    assert two(pd.Series(["a", None, "a"]), pd.Series(["b", "b", "b"])).tolist() == ["ab", None, "ab"] and both == [("a", "b")]
    lists = similarity.arrow_pair(lambda x, y: float(len(x) + len(y))).func
    assert lists(pd.Series([["a"], ["a"]]), pd.Series([["b"], []])).tolist() == [2.0, 1.0]


def test_pipeline_remembers_less(spark, monkeypatch):
    """The pipeline's last stage keeps fewer parts than op1, and packs the same pieces."""
    import corpus_pipeline
    from corpusloom.llm import packing
    from corpusloom.llm.bpe import Codec
    from corpusloom.llm.queries import word_vocabulary

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    asked = {}
    monkeypatch.setattr(packing, "pack", lambda *a, **k: asked.update(k) or packing.pieces(docs, word_vocabulary(), 4096, cache_size=64))
    small = corpus_pipeline.pack(spark, docs, SF)
    assert asked["cache_size"] * 4 < Codec(word_vocabulary()).cache_size
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, packing.pieces(docs, word_vocabulary(), 4096).collect()))


def test_shards_by_many_tasks(spark, tmp_path):
    """Consecutive rows a file, all files but one full, and not all written by one task."""
    from corpusloom.sources import writers

    writers.write_shards(spark.range(2050).repartition(3), str(tmp_path / "s"), 100, "id")
    files = sorted((tmp_path / "s").glob("*.parquet"))
    ids = sorted(sorted(r["id"] for r in spark.read.parquet(str(f)).collect()) for f in files)
    assert [i for x in ids for i in x] == list(range(2050)) and sorted(map(len, ids)) == [50] + [100] * 20
    assert len({f.name.split("-")[1] for f in files}) > 1


def test_tumbling_in_parts(spark, monkeypatch):
    """The replayed events are not gathered into one task."""
    frame, gathered = type(spark.range(1)), []
    once = frame.coalesce
    monkeypatch.setattr(frame, "coalesce", lambda self, n: gathered.append(n) or once(self, n))
    assert catalog.QUERIES["stm_tumbling_stream"](spark, SF).count() > 0
    assert not gathered


def test_shuffle_in_parts(spark):
    """The shuffled events are not gathered into one task."""
    plan = catalog.QUERIES["stm06_accept_until"](spark, SF)._jdf.queryExecution().toString()
    assert "MapInPandas" in plan and "Coalesce 1\n" not in plan


def test_replay_in_files(spark, monkeypatch):
    """A replay is cut into files of bounded rows, read in order; the first of a key is still the least."""
    from corpusloom.plans import stores

    parts, arriving = [], stores._arriving
    monkeypatch.setattr(stores, "MOST_ARRIVING", 300)
    monkeypatch.setattr(stores, "_arriving", lambda e, path, order, n: parts.append(n) or arriving(e, path, order, n))
    got = {r["key"]: r["event_id"] for r in catalog.QUERIES["stm07_deduplicated"](spark, SF).collect()}
    want: dict = {}
    for r in spark.read.parquet(f"{SF}/events.parquet").collect():
        k = f"{r['event_type']}{r['user_id']}"
        want[k] = min(want.get(k, r["event_id"]), r["event_id"])
    assert parts == [4] and got == want


def test_flushes_in_one_frame(spark, tmp_path):
    """act gets the same values at a time, but full groups of a batch come back as one frame, which is one batch again."""
    from corpusloom.streaming import iterate

    rows = spark.range(0, 100, 1, 1)
    out = iterate.flushed(rows, lambda v: [len(v)] * len(v), "id", "long", 7)
    assert sorted((r["id"], r["result"]) for r in out.collect()) == [(i, 7 if i < 98 else 2) for i in range(100)]


def test_edits_side_by_side(spark, monkeypatch):
    """Many pairs are counted together, with the same edits as one at a time; equal ends are left out first."""
    import random

    import numpy as np

    from corpusloom.functions import scoring

    draw = random.Random(3)
    pairs = []
    for n, m, k in [(0, 0, 2), (5, 0, 2), (64, 64, 2), (65, 63, 3), (129, 128, 26), (700, 513, 4), (900, 130, 500)] * 40:
        pairs.append(tuple(np.array([draw.randrange(k) for _ in range(x)], np.int64) for x in (n, m)))
        pairs.append((pairs[-1][0], np.delete(pairs[-1][0], slice(3, 9))))
    want = [scoring.edits(a.tolist(), b.tolist()) for a, b in pairs]
    grouped, one = [], scoring._side_by_side
    monkeypatch.setattr(scoring, "_side_by_side", lambda g: grouped.append(len(g)) or one(g))
    assert scoring.edits_of([None, *pairs]) == [None, *want] and max(grouped) > 9
    monkeypatch.setattr(scoring, "MASKS", 1)
    assert scoring.edits_of(pairs) == want


def test_token_edits_as_numbers(spark):
    """Words of a batch stay in Arrow, nulls among them too; null arrays give null."""
    from pyspark.sql import functions as F

    from corpusloom.functions import scoring

    rows = [(["a", None, "b"], ["a", "b"], 1), (None, ["a"], None), (["a"], None, None), ([], ["x", "y"], 2), (["x"], [], 1), ([None], [None], 0), ([], [], 0)] * 200
    got = spark.createDataFrame(rows, "a array<string>, b array<string>, d int").coalesce(1)
    plan = got.select("d", scoring.token_edit_distance(F.col("a"), F.col("b")).alias("e"))
    assert all(r["d"] == r["e"] for r in plan.collect()) and "ArrowEvalPython" in plan._jdf.queryExecution().toString()
    nothing = spark.createDataFrame([(None, None)], "a array<string>, b array<string>")
    assert nothing.select(scoring.token_edit_distance(F.col("a"), F.col("b"))).first()[0] is None


def test_edits_counted_once(spark):
    """Both rates of long texts come from one pass with one function of Python, and those of words and rates of one text as well."""
    for name in ("agg11_long_texts", "sim02_long_token_edits"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") == 1
        assert len(set(__import__("re").findall(r"_token_batch\([^)]*\)#\d+", plan))) <= (1 if name == "agg11_long_texts" else 2)


def test_few_pairs_at_once(spark, monkeypatch):
    """A worker gets some pairs of blocks at a time, not all of its task's; the session's setting stays, and blocks are as large as before."""
    from corpusloom.operators import retrieval

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    frame = type(spark.range(1))
    once = frame.mapInPandas
    monkeypatch.setattr(frame, "mapInPandas", lambda self, f, schema, *a, **k: once(self, (lambda it: f(_noted(it))) if "score" in str(schema) else f, schema, *a, **k))

    def _noted(batches):
        for b in batches:
            assert len(b) <= 8, len(b)
            yield b

    e = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    q = e.selectExpr("vec_id AS query_id", "embedding")
    got = retrieval.top_k(q, e.withColumnRenamed("vec_id", "item_id"), 3, block=8)
    assert got.count() == 3 * e.where("embedding IS NOT NULL").count() and spark.conf.get(name) == before


def test_many_shards_few_tasks(spark, tmp_path, monkeypatch):
    """More shards than LISTED tasks a shuffle task are read several a task, samples in frames; a sample's bytes are tarfile's."""
    from pyspark.sql import functions as F

    from corpusloom.sources import shards

    own = {"txt": b"x" * 700, "json": b"{}", "bin": b""}
    assert shards.tar_bytes(iter([("a/k", own)])).startswith(shards._sample_bytes("a/k", own) + b"\0" * 1024)
    rows = spark.range(300).select(F.format_string("%04d", "id").alias("key"), F.create_map(F.lit("txt"), F.lit(b"abc")).alias("members"))
    index = shards.write_tar_shards(rows, "key", "members", str(tmp_path / "t"), max_count=5)
    monkeypatch.setattr(shards, "LISTED", 1)
    read = shards.read_tar_samples(spark, f"{tmp_path}/t/*.tar")
    assert index.count() == 60 and read.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(r["key"].rsplit("/", 1)[-1] for r in read.collect()) == [f"{i:04d}" for i in range(300)]


def test_cache_asked_in_time(spark, tmp_path, monkeypatch):
    """A worker holds the rows of one bounded file, and requests come by time even where their numbers don't."""
    from pyspark.sql import functions as F

    from corpusloom.plans import stores

    e = spark.read.parquet(f"{SF}/events.parquet")
    most = e.agg(F.max("event_id")).first()[0] + 1
    e.unionByName(e.withColumn("event_id", F.col("event_id") + most)).write.parquet(str(tmp_path / "events.parquet"))
    parts, arriving = [], stores._arriving
    monkeypatch.setattr(stores, "MOST_ASKING", 500)
    monkeypatch.setattr(stores, "_arriving", lambda e, path, order, n: parts.append(n) or arriving(e, path, order, n))
    got = {r["n"]: r["hit"] for r in catalog.QUERIES["stm07_bounded_cache"](spark, str(tmp_path)).collect()}
    cache, want = {}, {}
    for r in spark.read.parquet(str(tmp_path / "events.parquet")).select("ts", "event_id", F.concat("event_type", F.col("user_id").cast("string")).alias("key")).orderBy("ts", "event_id").collect():
        k = r["key"]
        want[r["event_id"]] = k in cache and (r["ts"] - cache[k]).total_seconds() < 86_400
        if not want[r["event_id"]]:
            cache.pop(k, None)
            cache[k] = r["ts"]
            if len(cache) > 100:
                del cache[next(iter(cache))]
    assert parts == [-(-len(want) // 500)] and got == want


def test_groups_without_broadcast(spark, monkeypatch):
    """No table of labels goes through the driver, however small it is said to be."""
    from corpusloom.operators import dedup

    plans, once = [], dedup.settle
    monkeypatch.setattr(dedup, "settle", lambda df, *a: plans.append(df._jdf.queryExecution().executedPlan().toString()) or once(df, *a))
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(20) if i % 5], "src long, dst long, similarity double")
    got = {r["id"]: r["group_id"] for r in dedup.groups(edges).collect()}
    assert got == {i: (i - 1) // 5 * 5 + 1 for i in range(1, 21)} and len(plans) > 2 and not any("Broadcast" in p for p in plans)


def test_plain_literals_not_sent(spark, monkeypatch):
    """A literal that Spark itself reads is not sent to Python."""
    from pyspark.sql import functions as F

    from corpusloom.operators import training

    sent = []
    rows = spark.createDataFrame([("{'ground_truth': 'a-1'}",), ("{'ground_truth': ('b', 1)}",), (None,)], "g string")
    assert [r[0] for r in rows.select(training.ground_truth(F.col("g"))).collect()] == ["a-1", "('b', 1)", None]
    monkeypatch.setattr(training.A, "arrow_text", lambda f: lambda c: sent.append(c) or F.lit(None).cast("string"))
    training.ground_truth(F.col("g"))
    assert [r[0] for r in rows.select(sent[0]).collect()] == [None, "{'ground_truth': ('b', 1)}", None]
