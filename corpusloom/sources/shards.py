"""Tar shards: a writer that rolls at a count and a size, the index and split metadata, their merge, and checks of shards (SRC-11, SNK-03..05, 08, FLT-24..26, EXT-11, EXT-27)."""

from __future__ import annotations

import io
import json
import struct
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.storage import ranked, settle

META = ".nv-meta"
"""Fixed value: the folder of a dataset's metadata."""
MAX_COUNT, MAX_BYTES = 10_000, 3_000_000_000
TAR_BLOCK = 512
SMALL, TOO_MANY = 1024, 10_001
"""Shards of fewer bytes can't be read; counting stops after so many samples."""


# -- rolling -----------------------------------------------------------------------------------


def _rolled(sizes, max_count: int, max_bytes: int):
    """Greedy: a new shard begins when one more item would pass a limit. An item above max_bytes is a shard of its own."""
    shard, n, total = 0, 0, 0
    for s in sizes:
        if n and (n >= max_count or total + s > max_bytes):
            shard, n, total = shard + 1, 0, 0
        n, total = n + 1, total + s
        yield shard


def shard_plan(samples: DataFrame, key: str, size: str, max_count: int = MAX_COUNT, max_bytes: int = MAX_BYTES, groups: int | None = None, run: int = 200_000) -> DataFrame:
    """Adds `shard` (group-number, both zero-padded): no shard has more than max_count samples, or more than max_bytes unless it is a single sample.

    Samples are laid out in the order of a hash of their key and cut into groups of `run` (or as many groups as said); in a group a shard is
    begun when one more sample would pass a limit, which needs the one before, so a group is folded in one task;
    it reads keys and sizes only. Null sizes count 0.
    """
    kind = samples.schema[key].dataType.simpleString()
    if groups:
        run = max(1, -(-samples.count() // groups))

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_r")
        names = [f"{g:06d}-{i:06d}" for g, i in zip(frame["_g"], _rolled(frame["_s"], max_count, max_bytes), strict=True)]
        return pd.DataFrame({key: frame[key], "shard": names})

    small = samples.select(key, F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("_s"), F.xxhash64(key).alias("_h"))
    groups = ranked(small, "_h", key, name="_r").withColumn("_g", F.floor(F.col("_r") / run))
    return samples.join(groups.groupBy("_g").applyInPandas(fold, f"{key} {kind}, shard string"), key)


def rolling_parts(files: DataFrame, order: str, size: str, max_bytes: int = 5 * 1024**3) -> DataFrame:
    """EXT-11: adds part, from 1: one archive's files in order, a new part when the next would pass the limit. A greedy fold over one archive's listing, in one task."""
    kind = {c: files.schema[c].dataType.simpleString() for c in (order,)}

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order)
        part, now, out = 1, 0, []
        for s in frame["_s"]:
            if now + s > max_bytes:
                part, now = part + 1, 0
            now += s
            out.append(part)
        return pd.DataFrame({order: frame[order], "part": out})

    listing = files.select(order, F.col(size).cast("long").alias("_s"), F.lit(0).alias("_all")).groupBy("_all").applyInPandas(fold, f"{order} {kind[order]}, part int")
    return files.join(listing, order)


# -- tar ---------------------------------------------------------------------------------------


def tar_bytes(samples: Iterator[tuple[str, dict[str, bytes]]]) -> bytes:
    """An uncompressed tar of samples (key, members by suffix), with fixed times, so that equal samples give equal bytes."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as tar:
        for key, members in samples:
            for suffix in sorted(members):
                info = tarfile.TarInfo(f"{key}.{suffix}")
                info.size = len(members[suffix])
                tar.addfile(info, io.BytesIO(members[suffix]))
    return out.getvalue()


def shard_rows(planned: DataFrame, key: str, members: str, chunk: int = 8 << 20) -> DataFrame:
    """(shard, piece, content, samples): the bytes of each shard's tar in pieces, samples in the order of their key.

    planned has the shard, the key and members map<string, binary>. Rows are sorted by shard and key within a task and
    streamed: a piece is handed on when it is full, so no shard is ever whole in memory.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, piece, n, held, total = None, 0, 0, [], 0

        def rows(last: bool):
            nonlocal piece, held, total
            data = b"".join(held) + (b"\0" * (2 * TAR_BLOCK) if last else b"")
            held, total = [], 0
            out = pd.DataFrame({"shard": [now], "piece": [piece], "content": [data], "samples": [n if last else 0]})
            piece += 1
            return out

        for f in frames:
            for shard, k, own in zip(f["shard"], f["_key"], f["_members"], strict=True):
                if shard != now:
                    if now is not None:
                        yield rows(True)
                    now, piece, n = shard, 0, 0
                held.append(_sample_bytes(k, dict(own)))
                total += len(held[-1])
                n += 1
                if total >= chunk:
                    yield rows(False)
        if now is not None:
            yield rows(True)

    parts = planned.select("shard", F.col(key).cast("string").alias("_key"), F.col(members).alias("_members"))
    return parts.repartition("shard").sortWithinPartitions("shard", "_key").mapInPandas(run, "shard string, piece int, content binary, samples int")


def _sample_bytes(key: str, members: dict[str, bytes]) -> bytes:
    """A sample's members with their headers, as tar_bytes() has them before the closing blocks."""
    out = []
    for suffix in sorted(members):
        info = tarfile.TarInfo(f"{key}.{suffix}")
        info.size = len(members[suffix])
        out += [info.tobuf(tarfile.USTAR_FORMAT), members[suffix], b"\0" * (-info.size % TAR_BLOCK)]
    return b"".join(out)


def write_tar_shards(samples: DataFrame, key: str, members: str, folder: str, max_count: int = MAX_COUNT, max_bytes: int = MAX_BYTES, prefix: str = "pretrain") -> DataFrame:
    """SNK-03, EXT-27: writes prefix-NNNNNN.tar files and says (shard, path, samples, bytes).

    A sample's size is that of its members with headers, as the file has it. Shard names are continued numbers, so
    they do not depend on which task writes. Files are written by the tasks through the mounted or local form of the
    folder; another store needs a client there. A task that is run again writes the same bytes under the same name:
    each file is written beside and then renamed.
    """
    sized = samples.withColumn("_size", F.aggregate(F.map_values(members), F.lit(0).cast("long"), lambda s, v: s + TAR_BLOCK + F.ceil(F.octet_length(v) / TAR_BLOCK) * TAR_BLOCK))
    planned = settle(shard_plan(sized, key, "_size", max_count, max_bytes - 2 * TAR_BLOCK).select("shard", key, members), "shards")  # with the closing blocks
    numbers = ranked(planned.select("shard").distinct(), "shard", name="_n").select("shard", F.format_string(prefix + "-%06d", F.col("_n")).alias("_name"))
    named = planned.join(numbers, "shard").withColumn("shard", F.col("_name")).drop("_name")
    root = folder.removeprefix("file://").rstrip("/")

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.makedirs(root, exist_ok=True)
        handle, total = None, 0
        for f in frames:
            for shard, piece, content, n in zip(f["shard"], f["piece"], f["content"], f["samples"], strict=True):
                beside = f"{root}/.{shard}.{os.getpid()}"
                if piece == 0:
                    handle, total = open(beside, "wb"), 0
                handle.write(content)
                total += len(content)
                if n:
                    handle.close()
                    os.replace(beside, f"{root}/{shard}.tar")
                    yield pd.DataFrame({"shard": [shard], "path": [f"{root}/{shard}.tar"], "samples": [n], "bytes": [total]})

    made = shard_rows(named, key, members).mapInPandas(put, "shard string, path string, samples long, bytes long")
    return settle(made, "index")  # written once: reading the result again must not write the files again


def _text(path: str, spark: SparkSession) -> str | None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _put_text(path: str, text: str, spark: SparkSession) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def _yaml(value, deep: int = 0) -> str:
    """Maps, lists and JSON scalars as YAML."""
    pad = "  " * deep
    if isinstance(value, dict):
        return "".join(f"{pad}{json.dumps(k)}:" + (f"\n{_yaml(v, deep + 1)}" if v and isinstance(v, (dict, list)) else f" {json.dumps(v)}\n") for k, v in value.items())
    if isinstance(value, list):
        return "".join(f"{pad}- {json.dumps(v)}\n" for v in value)
    return f"{pad}{json.dumps(value)}\n"


def _unyaml(text: str) -> dict:
    """What _yaml writes; also plain block maps and lists of unquoted names."""

    def scalar(x: str):
        x = x.strip()
        try:
            return json.loads(x)
        except ValueError:
            return x.strip("'\"")

    root: dict = {}
    stack: list[tuple[int, dict]] = [(-1, root)]
    last: tuple[dict, str] | None = None
    for line in text.splitlines():
        if not line.strip():
            continue
        deep = len(line) - len(line.lstrip())
        body = line.strip()
        if body.startswith("- "):
            if not isinstance(last[0][last[1]], list):
                last[0][last[1]] = []
            last[0][last[1]].append(scalar(body[2:]))
            continue
        name, _, rest = body.rpartition(":") if body.endswith(":") else body.rpartition(": ")
        while stack[-1][0] >= deep:
            stack.pop()
        holder, k = stack[-1][1], scalar(name.rstrip(":"))
        if rest.strip():
            holder[k] = scalar(rest)
        else:
            holder[k] = {}
            stack.append((deep, holder[k]))
            last = (holder, k)
    return root


def write_metadata(spark: SparkSession, folder: str, index: DataFrame, parts: dict[str, float] | None = None, sample_type: str = "MultiMixQASample") -> dict:
    """SNK-04: dataset.yaml, split.yaml and .info.yaml beside the shards; returns the split and the counts. The index has a row a shard, which is what the files list.

    Shards in order of their names go to the splits by share (all to train if not said otherwise).
    """
    parts = parts or {"train": 1.0, "val": 0.0, "test": 0.0}
    counts = {r["path"].rsplit("/", 1)[-1]: r["samples"] for r in index.orderBy("path").collect()}
    names, split, at = list(counts), {}, 0.0
    for name, p in parts.items():
        low, at = at, at + p / sum(parts.values())
        split[name] = names[round(low * len(names)) : round(at * len(names))]
    top = f"{folder.rstrip('/')}/{META}"
    _put_text(f"{top}/dataset.yaml", _yaml({"sample_type": {"__module__": "dataset", "__class__": sample_type}, "part_filter": "sample_loader.py:part_filter", "sample_loader": "sample_loader.py:sample_loader"}), spark)
    _put_text(f"{top}/split.yaml", _yaml({"exclude": [], "split_parts": split}), spark)
    _put_text(f"{top}/.info.yaml", _yaml({"shard_counts": counts}), spark)
    return {"split_parts": split, "shard_counts": counts}


def merge_metadata(spark: SparkSession, base: str) -> dict:
    """SNK-05: the metadata of all `*_wds` folders under base as one, names prefixed by their folder; folders without metadata are passed over."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/*_wds")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    split: dict[str, list[str]] = {"test": [], "train": [], "val": []}
    counts: dict[str, int] = {}
    for folder in sorted(str(s.getPath()) for s in found or []):
        name = folder.rsplit("/", 1)[-1]
        own = _text(f"{folder}/{META}/split.yaml", spark)
        for part, shards in (_unyaml(own).get("split_parts", {}) if own else {}).items():
            if part in split:
                split[part] += [f"{name}/{s}" for s in shards or []]
        own = _text(f"{folder}/{META}/.info.yaml", spark)
        counts |= {f"{name}/{s}": n for s, n in (_unyaml(own).get("shard_counts", {}) if own else {}).items()}
    top = f"{base.rstrip('/')}/{META}"
    _put_text(f"{top}/split.yaml", _yaml({"exclude": [], "split_parts": split}), spark)
    _put_text(f"{top}/.info.yaml", _yaml({"shard_counts": counts}), spark)
    return {"split_parts": split, "shard_counts": counts}


# -- reading and checks ------------------------------------------------------------------------


def _members(stream, size: int) -> Iterator[tuple[str, bytes]]:
    """(name, content) of a tar's files, one at a time. Raises tarfile.ReadError where it is cut off."""
    with tarfile.open(fileobj=stream, mode="r|*") as tar:
        for m in tar:
            if m.isfile():
                body = tar.extractfile(m).read()
                if len(body) != m.size:
                    raise tarfile.ReadError("a member is cut off")
                yield m.name, body
    del size


def samples_of(stream, size: int = 0) -> Iterator[tuple[str, dict[str, bytes]]]:
    """Consecutive members of one base name are one sample."""
    now, members = None, {}
    for name, body in _members(stream, size):
        head, _, tail = name.rpartition("/")
        base, _, suffix = tail.partition(".")
        key = f"{head}/{base}" if head else base
        if key != now and members:
            yield now, members
            members = {}
        now = key
        members[suffix] = body
    if members:
        yield now, members


LISTED = 4
"""Tasks that read shards, by those of a shuffle: where there are more shards, a task reads several, one after the other."""
HELD, HELD_BYTES = 256, 4 << 20
"""Samples, and bytes of theirs, that are handed on together."""


def _listed(spark: SparkSession, paths: str) -> DataFrame:
    from corpusloom.sources.readers import expand

    rows = [(p.removeprefix("file:"),) for p in expand(spark, paths)]
    most = LISTED * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return spark.createDataFrame(rows, "path string").repartition(max(1, min(len(rows), most)))


def read_tar_samples(spark: SparkSession, paths: str) -> DataFrame:
    """(shard, key, members): one row a sample. A task reads a shard as a stream, sample by sample, whatever its size is; the folder must be mounted or local to the executors, other stores go through read_tar_shards."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path in f["path"]:
                held, total = [], 0
                with open(path, "rb") as stream:
                    for key, members in samples_of(stream):
                        held.append((path, key, members))
                        total += sum(map(len, members.values()))
                        if len(held) >= HELD or total >= HELD_BYTES:
                            yield pd.DataFrame(held, columns=["shard", "key", "members"])
                            held, total = [], 0
                if held:
                    yield pd.DataFrame(held, columns=["shard", "key", "members"])

    return _listed(spark, paths).mapInPandas(run, "shard string, key string, members map<string,binary>")


def check_shards(spark: SparkSession, paths: str) -> DataFrame:
    """FLT-25: (path, folder, bytes, samples, status): unreadable (under 1 KB), incomplete (an error while reading), empty or complete; counting stops after 10,001 samples."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os
        import zlib

        for f in frames:
            for path in f["path"]:
                size, n, status = os.path.getsize(path), 0, "complete"
                if size < SMALL:
                    status = "unreadable"
                else:
                    try:
                        with open(path, "rb") as stream:
                            for _ in samples_of(stream):
                                n += 1
                                if n >= TOO_MANY:
                                    break
                        status = "complete" if n else "empty"
                    except (tarfile.TarError, OSError, EOFError, zlib.error, struct.error):
                        status = "incomplete"
                yield pd.DataFrame({"path": [path], "bytes": [size], "samples": [n], "status": [status]})

    from corpusloom.operators.training import shard_folder

    found = _listed(spark, paths).mapInPandas(run, "path string, bytes long, samples long, status string")
    name = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]*$", "")
    return found.withColumn("folder", shard_folder(name))


def shard_report(checked: DataFrame) -> DataFrame:
    """(folder, total, complete, incomplete): incomplete are all that are not complete."""
    return checked.groupBy("folder").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "complete").alias("complete"), F.count_if(F.col("status") != "complete").alias("incomplete"))


def quarantine(checked: DataFrame, folder: str) -> list[str]:
    """FLT-26: moves the shards that are not complete into a folder; says which. The list of bad shards goes to the driver, which moves them by name."""
    spark = checked.sparkSession
    bad = [r["path"] for r in checked.where("status != 'complete'").select("path").orderBy("path").collect()]
    top = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(top)
    for path in bad:
        fs.rename(spark._jvm.org.apache.hadoop.fs.Path(path), spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{path.rsplit('/', 1)[-1]}"))
    return bad


def sample_errors(members: Column) -> Column:
    """FLT-24: what is wrong with a sample (map<string, binary> with a json member {texts, media, name}): names of broken rules, none for a sound one."""
    raw = F.try_element_at(members, F.lit("json")).cast("string")
    kind = "struct<texts:array<struct<role:string,content:string>>,media:string,name:array<string>>"
    parsed = F.from_json(raw, kind)
    has = lambda k: F.get_json_object(raw, f"$.{k}").isNotNull()
    is_list = lambda k: F.trim(F.get_json_object(raw, f"$.{k}")).startswith("[")
    texts, names = F.coalesce(parsed["texts"], F.expr("cast(array() AS array<struct<role:string,content:string>>)")), F.coalesce(parsed["name"], F.array().cast("array<string>"))
    image = parsed["media"] == "image"
    body = lambda n: F.try_element_at(members, n)
    sound = has("texts") | has("media") | has("name")
    rules = [
        ("no json", raw.isNull()),
        ("bad json", raw.isNotNull() & F.get_json_object(raw, "$").isNull()),
        *[(f"no {k}", raw.isNotNull() & F.get_json_object(raw, "$").isNotNull() & ~has(k)) for k in ("texts", "media", "name")],
        *[(f"{k} is no list", has(k) & ~is_list(k)) for k in ("texts", "name")],
        ("a text without role", F.exists(texts, lambda m: m["role"].isNull())),
        ("a text without content", F.exists(texts, lambda m: m["content"].isNull())),
        ("unknown role", F.exists(texts, lambda m: m["role"].isNotNull() & ~m["role"].isin("system", "user", "assistant"))),
        ("unknown media", has("media") & ~F.coalesce(parsed["media"].isin("image", "text", "video"), F.lit(False))),
        ("image without names", sound & image & is_list("name") & (F.size(names) == 0)),
        ("a name without a member", F.exists(names, lambda n: body(n).isNull())),
        ("an empty image", image & F.exists(names, lambda n: F.coalesce(F.octet_length(body(n)) == 0, F.lit(False)))),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), name) for name, broken in rules]))


def write_samples(rows: DataFrame, key: str, members: str, folder: str) -> None:
    """SNK-08: each member as a file key.suffix, written by the tasks; the folder must be mounted or local. For few samples: a table or shards serve better."""
    root = folder.removeprefix("file://").rstrip("/")

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.makedirs(root, exist_ok=True)
        for f in frames:
            for k, own in zip(f["k"], f["m"], strict=True):
                for suffix, body in dict(own).items():
                    with open(f"{root}/{k}.{suffix}", "wb") as out:
                        out.write(body)
        yield pd.DataFrame({"n": [0]})

    rows.select(F.col(key).cast("string").alias("k"), F.col(members).alias("m")).mapInPandas(put, "n int").write.format("noop").mode("overwrite").save()
