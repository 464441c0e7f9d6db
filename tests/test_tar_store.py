"""Tar shards through Hadoop's file system: round trips, several parts a shard, long names, damage, writes that fail."""

import io
import os
import random
import tarfile

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import tar_store
from corpusloom.sources.shards import LISTED


def samples(n=40):
    rng = random.Random(1)
    sizes = [0, 1, 511, 512, 513, 1024, 70_000]
    return [(f"dir/k{i:04d}", {"json": rng.randbytes(rng.choice(sizes)), "txt": b"t" * rng.randrange(2000)}) for i in range(n)]


def table(spark, rows):
    return spark.createDataFrame([(k, {a: bytearray(b) for a, b in m.items()}) for k, m in rows], "key string, members map<string,binary>").repartition(3)


def got(spark, paths, split):
    return {r["key"]: {a: bytes(b) for a, b in r["members"].items()} for r in tar_store.read_tar(spark, paths, split).collect()}


def test_shards_are_written_and_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tar_store, "ROW_BYTES", 2000)
    rows, out = samples(), f"file://{tmp_path}/out"
    index = tar_store.write_tar(table(spark, rows), "key", "members", out, max_count=7, max_bytes=150_000).collect()
    assert sum(r["samples"] for r in index) == len(rows) and len(index) == len(list((tmp_path / "out").glob("*.tar")))
    seen = {}
    for r in index:
        path = r["path"].removeprefix("file://")
        assert os.path.getsize(path) == r["bytes"] and r["samples"] <= 7 and (r["bytes"] <= 150_000 or r["samples"] == 1)
        with tarfile.open(path) as tar:
            for m in tar:
                base, suffix = m.name.split(".", 1)
                seen.setdefault(base, {})[suffix] = tar.extractfile(m).read()
    assert seen == dict(rows)
    for split in (512 * 7, 100_000, 64 << 20):
        assert got(spark, out + "/*.tar", split) == dict(rows)
    blocks, owner = tar_store._blocks(spark, [index[0]["path"]], 512 * 7)
    assert len(owner) > 4 and blocks.where("part = 1").count() <= 8  # one shard in many parts


@pytest.mark.parametrize("form", [tarfile.GNU_FORMAT, tarfile.PAX_FORMAT, tarfile.USTAR_FORMAT])
def test_tars_of_other_writers(spark, tmp_path, form):
    """Long names, a directory, and a tar inside a tar, whose headers are data."""
    inner = io.BytesIO()
    with tarfile.open(fileobj=inner, mode="w") as t:
        info = tarfile.TarInfo("hidden.txt")
        info.size = 3
        t.addfile(info, io.BytesIO(b"abc"))
    far = "n" * 60 + "/" + "m" * 60 + "/x" if form == tarfile.USTAR_FORMAT else "d/" + "é" * 140 + "/x"
    with tarfile.open(tmp_path / "a.tar", "w", format=form) as t:
        folder = tarfile.TarInfo("d")
        folder.type = tarfile.DIRTYPE
        t.addfile(folder)
        for name, body in ((far + ".tar", inner.getvalue()), (far + ".txt", b""), ("y.txt", b"12")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    assert got(spark, f"file://{tmp_path}/a.tar", 1024) == {far: {"tar": inner.getvalue(), "txt": b""}, "y": {"txt": b"12"}}


def test_damaged_shards(spark, tmp_path):
    rows = samples(5)
    tar_store.write_tar(table(spark, rows), "key", "members", f"file://{tmp_path}/out")
    (path,) = (tmp_path / "out").glob("*.tar")
    whole = path.read_bytes()
    cases = {"cut.tar": whole[: len(whole) // 1024 * 512], "odd.tar": whole[:512] + b"\1" * 512 + whole[1024:2048] + b"x" * 512, "noise.tar": b"z" * 2048, "zero.tar": b"\0" * 1024, "none.tar": b""}
    for name, data in cases.items():
        (tmp_path / name).write_bytes(data)
    by = {}
    for r in tar_store.tar_members(spark, f"file://{tmp_path}/*.tar", 4096).collect():
        by.setdefault(os.path.basename(r["shard"]), []).append(r["name"])
    assert set(by) == {"cut.tar", "odd.tar", "noise.tar"} and all(v.count(None) == 1 for v in by.values()) and by["noise.tar"] == [None]
    with pytest.raises(Exception, match="cut off"):
        tar_store.read_tar(spark, f"file://{tmp_path}/cut.tar").collect()


def test_a_write_that_fails_leaves_nothing(spark, tmp_path):
    bad = F.when(F.col("key") == "dir/k0003", F.raise_error(F.lit("no")).cast("map<string,binary>")).otherwise(F.col("members"))
    with pytest.raises(Exception, match="no"):
        tar_store.write_tar(table(spark, samples(6)).withColumn("members", bad), "key", "members", f"file://{tmp_path}/out")
    assert not (tmp_path / "out").exists() or not list((tmp_path / "out").iterdir())
    nothing = tar_store.write_tar(table(spark, samples(1)).limit(0), "key", "members", f"file://{tmp_path}/none")
    assert nothing.count() == 0


def test_very_many_small_shards_are_one_plan(spark, tmp_path):
    out, many = tmp_path / "many", 700
    out.mkdir()
    for i in range(many):
        with tarfile.open(out / f"s{i:05d}.tar", "w", format=tarfile.USTAR_FORMAT) as tar:
            told = tarfile.TarInfo(f"k{i}.txt")
            told.size = 3
            tar.addfile(told, io.BytesIO(b"%03d" % (i % 1000)))
    files = sorted(f"file:{p}" for p in out.glob("*.tar"))
    blocks, owner = tar_store._blocks(spark, files, 64 << 10)
    assert owner == files
    assert blocks.select("part").distinct().count() == many and blocks.count() == many * 20


def test_many_parts_are_read_by_few_tasks_and_once(spark, tmp_path):
    rows, out = samples(60), f"file://{tmp_path}/out"
    tar_store.write_tar(table(spark, rows), "key", "members", out, max_count=2)
    (tmp_path / "out" / "a.tar").write_bytes(b"")  # an empty file has no part
    blocks, owner = tar_store._blocks(spark, sorted(f"file:{p}" for p in (tmp_path / "out").glob("*.tar")), 512 * 7)
    tasks = LISTED * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(owner) > 10 * tasks and blocks.rdd.getNumPartitions() == tasks
    counts = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert sorted(counts) == list(range(len(owner))) and max(counts.values()) <= 8
    per = {}
    for part, path in enumerate(owner):
        per[path] = per.get(path, 0) + 512 * counts[part]
    assert per == {f"file:{p}": p.stat().st_size for p in (tmp_path / "out").glob("pre*.tar")}
    whole = tar_store.read_tar(spark, out + "/*.tar", 512 * 7)
    assert {r["key"]: {a: bytes(b) for a, b in r["members"].items()} for r in whole.collect()} == dict(rows)
    assert whole._jdf.queryExecution().sparkPlan().toString().count("MapInArrow") == 1  # names don't read the contents again
