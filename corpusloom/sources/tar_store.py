"""Tar shards of any size in any store that Hadoop's file system reaches (SRC-11, SRC-14, SNK-03): no task opens a path.

Reading: Spark's fixed-length input splits a file into parts, runs of 512-byte blocks, so many tasks read one shard; where there are many more parts than
a shuffle has tasks, a task reads several, one after the other. Blocks whose checksum is that of a tar header are candidates; which of them are headers follows from the first on, a header saying where the next one is, over the candidates of a
shard only. The members' blocks are then cut out of pieces that meet them by (shard, piece).

Writing: a text file's rows end in a separator, here the byte 0. Every tar header ends in zeros, so a shard is cut behind headers, each
row without its last byte, and Spark's own committer writes the files into a folder beside; only when all are there do they get their names.
"""

from __future__ import annotations

import tarfile
import uuid
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators.storage import drop_settled, ranked, settle
from corpusloom.sources.readers import expand
from corpusloom.sources.shards import LISTED, MAX_BYTES, MAX_COUNT, TAR_BLOCK, shard_plan

PIECE = 128
"""Blocks of a piece of a shard, 64 KB."""
SPLIT_BYTES = 64 << 20
ROW_BYTES = 8 << 20
END = b"\0" * (2 * TAR_BLOCK)


# -- reading -----------------------------------------------------------------------------------


def _blocks(spark: SparkSession, files: list[str], split_bytes: int) -> tuple[DataFrame, list[str]]:
    """(part, block) of all files, the blocks of a part in order and side by side, and the file of each part. A task has one part or more."""
    sc, jvm = spark.sparkContext, spark._jvm
    conf = jvm.org.apache.hadoop.conf.Configuration(spark._jsc.hadoopConfiguration())
    conf.set("mapreduce.input.fileinputformat.split.maxsize", str(split_bytes // TAR_BLOCK * TAR_BLOCK))
    every = sc._jsc.sc().binaryRecords(",".join(files), TAR_BLOCK, conf)  # one RDD: a union of one a file is as deep as there are files
    owner = _owners(jvm, ",".join(files), conf, every.getNumPartitions())
    rows = spark._jsparkSession.createDataset(every, jvm.org.apache.spark.sql.Encoders.BINARY()).toDF()
    blocks = DataFrame(rows, spark).select(F.spark_partition_id().alias("part"), F.col("value").alias("block"))
    most = LISTED * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return blocks.coalesce(most) if len(owner) > most else blocks, owner  # parts are numbered below coalesce(), so they stay as they are


def _owners(jvm, paths: str, conf, parts: int) -> list[str]:
    """The file of each part, in one call for all of them: asking the RDD takes five a part."""
    job = jvm.org.apache.hadoop.mapreduce.Job.getInstance(conf)  # conf has the record's length since binaryRecords()
    jvm.org.apache.hadoop.mapreduce.lib.input.FileInputFormat.setInputPaths(job, paths)
    told = jvm.org.apache.commons.lang3.StringUtils.join(jvm.org.apache.spark.input.FixedLengthBinaryInputFormat().getSplits(job), "\n\0")  # file:start+length
    splits = [x.rpartition(":") for x in told.split("\n\0") if x]
    if len(splits) != parts:
        splits = [x for x in splits if not x[2].endswith("+0")]  # of empty files, which Spark passes over
    if len(splits) != parts:
        raise RuntimeError(f"{parts} parts, but {len(splits)} splits of the files")
    names: dict[str, str] = {}
    return [names.setdefault(x[0], x[0]) for x in splits]  # one string a file, so that the list stays small where it is sent to tasks


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.Array]]:
    """(part, blocks) of a batch's rows, in order."""
    if batch.num_rows:
        parts = batch.column(0).to_numpy()
        for begin, end in pairwise([0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]):
            yield int(parts[begin]), batch.column(1).slice(begin, end - begin)


def _array(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, TAR_BLOCK)


def _octal(field: bytes) -> int | None:
    if field[:1] in (b"\x80", b"\xff"):
        return int.from_bytes(field[1:], "big")  # the binary form, of sizes over 8 GB
    text = field.strip(b" \0")
    return int(text, 8) if text and all(48 <= c < 56 for c in text) else None


def _text(field: bytes) -> str:
    return field.split(b"\0", 1)[0].decode("utf-8", "surrogateescape").encode("utf-8", "replace").decode()


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, row, size, kind, name) of the candidates of each part, and a row of kind null: size is the number of the part's blocks, row the last one that isn't all zeros (or -1)."""
    row, part, last, out = 0, None, -1, []

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(dict(zip(("part", "row", "size", "kind", "name"), zip(*out, strict=True), strict=True)), schema=_HEADERS)

    for batch in batches:
        for p, column in _stretches(batch):
            if p != part:
                if part is not None:
                    out.append((part, last, row, None, None))
                row, part, last = 0, p, -1
            x = _array(column)
            sums = x.sum(axis=1, dtype=np.int64) - x[:, 148:156].sum(axis=1, dtype=np.int64) + 8 * 32
            told_sum = x[:, 148:156]
            octal = ((told_sum == 0) | (told_sum == 32) | ((told_sum >= 48) & (told_sum < 56))).all(axis=1) | np.isin(told_sum[:, 0], (0x80, 0xFF))
            for i in np.flatnonzero(octal & (told_sum.max(axis=1) > 32) & (x[:, 0] > 0)).tolist():
                raw = x[i].tobytes()
                size = _octal(raw[124:136])
                if _octal(raw[148:156]) == sums[i] and size is not None:
                    head = _text(raw[345:500]) if raw[257:263] == b"ustar\0" else ""
                    out.append((part, row + i, size, chr(raw[156] or 48), f"{head}/{_text(raw[:100])}" if head else _text(raw[:100])))
            some = np.flatnonzero(x.any(axis=1))
            last = row + int(some[-1]) if len(some) else last
            row += len(x)
        if out:
            yield told()
            out = []
    if part is not None:
        out = [(part, last, row, None, None)]
        yield told()


_HEADERS = pa.schema([("part", pa.int32()), ("row", pa.int64()), ("size", pa.int64()), ("kind", pa.string()), ("name", pa.string())])


def _chain(frame: pd.DataFrame) -> pd.DataFrame:
    """Of a shard's candidates: the headers, from block 0 on. Where the last one says more than there is, or something other than zeros follows, comes a row of kind '!'."""
    here = {at: (size, kind, name) for at, size, kind, name in zip(frame["at"], frame["size"], frame["kind"], frame["name"], strict=True) if kind is not None}
    shard, blocks, last = frame["shard"].iloc[0], int(frame["blocks"].iloc[0]), int(frame["last"].iloc[0])
    out, at = [], 0
    while at in here:
        size, kind, name = here[at]
        many = -(-size // TAR_BLOCK) if kind not in "12345" else 0
        out.append((shard, at, at + 1, many, size, kind, name))
        at += 1 + many
    if at > blocks or last >= at:
        out.append((shard, at, at, 0, 0, "!", "cut off"))
    return pd.DataFrame(out, columns=["shard", "at", "first", "many", "size", "kind", "name"])


def tar_members(spark: SparkSession, paths: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(shard, at, name, content): the files of all tars, at being the header's block. Long names (GNU and pax) are followed.

    A shard that is cut off has a row without a name at its end; an empty file has no rows; a file whose length is no multiple of 512 is an error.
    """
    found = _members(spark, paths, split_bytes)
    if found is None:
        return spark.createDataFrame([], "shard string, at long, name string, content binary")
    whole = _fragments(*found).groupBy("shard", "at", "name").agg(_content().alias("content"))
    return whole.withColumn("content", F.when(F.col("name").isNotNull(), F.col("content")))


def _members(spark: SparkSession, paths: str, split_bytes: int) -> tuple[DataFrame, DataFrame] | None:
    """(shard, at, name, first, many, size) of the files of all tars, known from the headers, and the pieces that their contents are cut from; None without files."""
    files = expand(spark, paths)
    if not files:
        return None
    blocks, owner = _blocks(spark, files, split_bytes)
    parts = spark.createDataFrame(list(enumerate(owner)), "part int, shard string")
    heads = settle(blocks.mapInArrow(_headers, "part int, row long, size long, kind string, name string"), "headers")
    counts = parts.join(heads.where("kind IS NULL").select("part", F.col("size").alias("n"), F.col("row").alias("end")), "part", "left")
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("blocks", F.sum("n").over(Window.partitionBy("shard")))
    base = base.withColumn("last", F.max(F.when(F.col("end") >= 0, F.col("base") + F.col("end"))).over(Window.partitionBy("shard")))
    starts = {r["part"]: r["base"] for r in base.select("part", "base").collect()}  # one number a split
    # The parts' own rows are with them, so a shard without a header is a group too.
    found = heads.join(F.broadcast(base), "part").where("last IS NOT NULL").select("shard", (F.col("base") + F.col("row")).alias("at"), "size", "kind", "name", "blocks", "last")
    chained = settle(found.groupBy("shard").applyInPandas(_chain, "shard string, at long, first long, many long, size long, kind string, name string"), "members")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out, at, part = [], [], 0, None

        def put() -> None:
            begin = at - len(held)
            out.append((owner[part], begin // PIECE, begin % PIECE * TAR_BLOCK, len(held) * TAR_BLOCK, b"".join(held)))
            held.clear()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(dict(zip(_PIECES.names, zip(*out, strict=True), strict=True)), schema=_PIECES)

        for batch in batches:
            for p, column in _stretches(batch):
                if p != part:
                    if held:
                        put()
                    at, part = starts[p], p
                values, i = column.to_pylist(), 0
                while i < len(values):
                    n = min(PIECE - at % PIECE, len(values) - i)
                    held += values[i : i + n]
                    i, at = i + n, at + n
                    if at % PIECE == 0:
                        put()
            if out:
                yield told()
                out = []
        if held:
            put()
            yield told()

    cut = blocks.mapInArrow(pieces, "shard string, piece long, skip long, length long, bytes binary")
    far = chained.where("kind IN ('L', 'x')")
    names = chained.where("kind IN ('0', '7', '!')")
    if not far.isEmpty():
        # Extended headers hold the name of the member behind them.
        text, before = F.col("content").cast("string"), Window.partitionBy("shard").orderBy("at")
        long_ = F.when(F.col("kind") == "L", F.regexp_replace(text, "\\x00+$", "")).when(F.col("kind") == "x", F.nullif(F.regexp_extract(text, r"(?:^|\n)\d+ path=([^\n]*)\n", 1), F.lit("")))
        told = _fragments(far, cut).groupBy("shard", "at", "kind").agg(_content().alias("content")).select("shard", "at", long_.alias("long"))
        order = chained.select("shard", "at", "kind").join(told, ["shard", "at"], "left").withColumn("long", F.coalesce(F.lag("long", 1).over(before), F.when(F.lag("kind", 1).over(before).isin("L", "x"), F.lag("long", 2).over(before))))
        names = names.join(order.select("shard", "at", "long"), ["shard", "at"]).withColumn("name", F.coalesce("long", "name"))
    return names.withColumn("name", F.when(F.col("kind") != "!", F.col("name"))).drop("kind", "long"), cut


_PIECES = pa.schema([("shard", pa.string()), ("piece", pa.int64()), ("skip", pa.int64()), ("length", pa.int64()), ("bytes", pa.binary())])


def _fragments(members: DataFrame, cut: DataFrame) -> DataFrame:
    """The members' own columns, and from and some: what a piece has of their contents. An empty one has one row, with no bytes."""
    own = [c for c in members.columns if c not in ("first", "many", "size")]
    some = (F.col("size") > 0) & (F.col("many") > 0)
    wanted = members.where(some).withColumn("piece", F.explode(F.sequence(F.expr(f"first div {PIECE}"), F.expr(f"(first + many - 1) div {PIECE}"))))
    # A piece is in two rows where a split ends in it; a row gives what both it and the member have.
    begin = F.greatest(F.col("first") * TAR_BLOCK, F.col("piece") * (PIECE * TAR_BLOCK) + F.col("skip"))
    end = F.least(F.col("first") * TAR_BLOCK + F.col("size"), F.col("piece") * (PIECE * TAR_BLOCK) + F.col("skip") + F.col("length"))
    met = wanted.join(cut, ["shard", "piece"]).withColumn("_b", begin).withColumn("_e", end).where("_e > _b")
    got = met.select(*own, F.col("_b").alias("from"), F.expr(f"substring(bytes, cast(_b - piece * {PIECE * TAR_BLOCK} - skip + 1 AS int), cast(_e - _b AS int))").alias("some"))
    return got.unionByName(members.where(~some).select(*own, F.lit(0).cast("long").alias("from"), F.lit(b"").alias("some")))


def _content() -> Column:
    """Of a member's fragments: the whole. A cast between binary and string leaves the bytes as they are."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("from", "some"))), lambda p: p["some"].cast("string")), "").cast("binary")


def read_tar(spark: SparkSession, paths: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(shard, key, members map<string, binary>): consecutive files of one base name are one sample, as FLT-24 expects them; a shard that is cut off is an error."""
    found = _members(spark, paths, split_bytes)
    if found is None:
        return spark.createDataFrame([], "shard string, key string, members map<string,binary>")
    members, cut = found
    name = F.when(F.col("name").isNull(), F.raise_error(F.concat(F.lit("cut off: "), F.col("shard"))).cast("string")).otherwise(F.col("name"))
    stem, suffix = F.regexp_extract("name", r"^((?:.*/)?[^./]*)", 1), F.regexp_extract("name", r"^(?:.*/)?[^./]*\.(.*)$", 1)
    own = members.withColumn("name", name).withColumn("key", stem).withColumn("suffix", suffix).drop("name")
    order = Window.partitionBy("shard").orderBy("at")
    new = own.withColumn("new", (F.coalesce(F.lag("key").over(order), F.lit("")) != F.col("key")).cast("int"))
    runs = new.withColumn("run", F.sum("new").over(order)).drop("new")
    # The contents go through two shuffles, as pieces to the members and then to their samples; both steps below are done where they are.
    parts = _fragments(runs, cut).repartition("shard", "run")
    whole = parts.groupBy("shard", "run", "key", "at", "suffix").agg(_content().alias("content"))
    one = whole.groupBy("shard", "run", "key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("suffix", "content")))).alias("members"))
    return one.select("shard", "key", "members")


# -- writing -----------------------------------------------------------------------------------


def _rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(shard, piece, content) of samples sorted by shard and key: the shard's bytes, cut behind headers, each without its last byte."""
    now, piece, held, total = None, 0, [], 0

    def row() -> pd.DataFrame:
        data = b"".join(held)
        assert data.endswith(b"\0")
        return pd.DataFrame({"shard": [now], "piece": [piece], "content": [data[:-1]]})

    for f in frames:
        for shard, key, members in zip(f["shard"], f["_key"], f["_members"], strict=True):
            if shard != now:
                if now is not None:
                    held.append(END)
                    yield row()
                now, piece, held, total = shard, 0, [], 0
            for suffix, content in sorted(dict(members).items()):
                info = tarfile.TarInfo(f"{key}.{suffix}")
                info.size = len(content)
                held.append(info.tobuf(tarfile.USTAR_FORMAT))
                total += TAR_BLOCK
                if total >= ROW_BYTES:
                    yield row()
                    piece, held, total = piece + 1, [], 0
                fill = -len(content) % TAR_BLOCK
                held += [content, b"\0" * fill]
                total += len(content) + fill
    if now is not None:
        held.append(END)
        yield row()


def write_tar(samples: DataFrame, key: str, members: str, folder: str, max_count: int = MAX_COUNT, max_bytes: int = MAX_BYTES, prefix: str = "pretrain") -> DataFrame:
    """SNK-03: writes folder/prefix-NNNNNN.tar in any store and says (shard, path, samples, bytes); max_bytes holds for whole files, closing blocks included, but for single samples above it.

    Spark writes all shards beside the folder; they are moved there when the last one is done, so a write that fails leaves none.
    Names in USTAR form: at most 255 bytes. No samples: no file.
    """
    spark = samples.sparkSession
    sized = samples.withColumn("_size", F.aggregate(F.map_values(members), F.lit(0).cast("long"), lambda s, v: s + TAR_BLOCK + F.ceil(F.octet_length(v) / TAR_BLOCK) * TAR_BLOCK))
    planned = settle(shard_plan(sized, key, "_size", max_count, max_bytes - len(END)).select("shard", F.col(key).cast("string").alias("_key"), F.col(members).alias("_members")), "shards")
    counts = settle(planned.groupBy("shard").agg(F.count("*").alias("samples")), "shards")
    numbers = ranked(counts, "shard", name="_n").select("shard", "samples", F.format_string(prefix + "-%06d", F.col("_n")).alias("name"))
    named = settle(numbers, "shards")
    own = planned.join(named.select("shard", "name"), "shard").select(F.col("name").alias("shard"), "_key", "_members")
    rows = own.repartition("shard").sortWithinPartitions("shard", "_key").mapInPandas(_rows, "shard string, piece long, content binary")
    where = folder.rstrip("/")
    beside = f"{where}/.writing-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(where).getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        text = rows.sortWithinPartitions("shard", "piece").select(F.col("content").cast("string").alias("value"), "shard")
        text.write.partitionBy("shard").option("lineSep", "\0").text(beside)
        made = []
        for folder_ in fs.listStatus(hadoop(beside)):  # one entry a shard
            name = folder_.getPath().getName().removeprefix("shard=")
            if folder_.isDirectory():
                (part,) = [s for s in fs.listStatus(folder_.getPath()) if s.getPath().getName().startswith("part-")]
                made.append((name, f"{where}/{name}.tar", part.getLen(), str(part.getPath())))
        for _, path, _, part in made:
            fs.delete(hadoop(path), False)
            if not fs.rename(hadoop(part), hadoop(path)):
                raise OSError(f"{part} could not be moved to {path}")
    finally:
        fs.delete(hadoop(beside), True)
        drop_settled(planned)  # it has all contents
    index = spark.createDataFrame([x[:3] for x in made], "name string, path string, bytes long")
    return index.join(named, "name").select(F.col("name").alias("shard"), "path", "samples", "bytes")
