"""Sources (SRC-*)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.storage import least_rows
from corpusloom.sources.adapters import ADAPTERS, ROW, adapt_all, adapt_choices, adapt_counting, adapt_grounding, adapt_programs, adapt_reasoning, adapted  # noqa: F401



def parse_path(path: str) -> tuple[str, float | None]:
    """A path and its percent directive: 'data/*.parquet[25%]' gives 25.0."""
    found = re.fullmatch(r"(.*)\[([0-9.]+)%\]", path)
    return (found[1], float(found[2])) if found else (path, None)


def expand(spark: SparkSession, paths: str) -> list[str]:
    """A comma list with wildcards as sorted paths; an unmatched pattern stays as it is. Listed by Hadoop, so any store will do."""
    out = []
    for p in filter(None, map(str.strip, paths.split(","))):
        where = spark._jvm.org.apache.hadoop.fs.Path(p)
        hits = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
        out += sorted(str(h.getPath()) for h in hits) if hits else [p]
    return out


def read(spark: SparkSession, paths: str, key: str | None = None) -> DataFrame:
    """Parquet, JSON lines, CSV, TSV or text by suffix, or a catalog table (`table:name`); a [N%] directive takes max(1, floor(n * N / 100)) rows, those of least hash of key (of all columns without one)."""
    paths, percent = parse_path(paths)
    files = [] if paths.startswith("table:") else expand(spark, paths)
    name = files[0].lower().rstrip("/") if files else ""
    if not files:
        df = spark.table(paths.removeprefix("table:"))
    elif name.endswith((".jsonl", ".json")):
        df = spark.read.option("mode", "PERMISSIVE").json(files)
    elif name.endswith((".tsv", ".csv")):
        df = spark.read.option("header", True).option("sep", "\t" if name.endswith(".tsv") else ",").csv(files)
    elif name.endswith((".txt", ".urls")):
        df = spark.read.text(files)
    else:
        df = spark.read.option("recursiveFileLookup", True).parquet(*files)
    if percent is not None:
        plain = [c for c, t in df.dtypes if not t.startswith("map")]
        n = df.count()
        order = F.xxhash64(F.lit(42), key) if key else F.xxhash64(F.lit(42), *plain)
        df = least_rows(df, max(1, int(n * percent // 100)), order, *([key] if key else []))
    return df


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def read_token_info(spark: SparkSession, path: str) -> DataFrame:
    """(name, token_len) of `name:len` lines; bad lines are left out."""
    line = spark.read.text(path)
    out = line.select(F.regexp_extract("value", r"^(.*):([0-9]+)$", 1).alias("name"), F.regexp_extract("value", r"^(.*):([0-9]+)$", 2).try_cast("int").alias("token_len"))
    return out.where("token_len IS NOT NULL")


def sampled_files(files: list[str], target: int, total: int, seed: int = 42) -> list[str]:
    """max(1, files * target / total) files, in the order of a seeded hash."""
    import hashlib

    n = max(1, int(len(files) * target / total))
    return sorted(sorted(files, key=lambda f: hashlib.md5(f"{seed}:{f}".encode()).digest())[:n])


def paired_files(spark: SparkSession, directory: str, other: str = ".jpg") -> DataFrame:
    """(base, json_path, other_path, content): each .json file with its sibling of the same base name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory)
    base = F.regexp_replace("path", r"\.[^./]*$", "")
    left = files.where(F.col("path").endswith(".json")).select(base.alias("base"), F.col("path").alias("json_path"), "content")
    right = files.where(F.col("path").endswith(other)).select(base.alias("base"), F.col("path").alias("other_path"))
    return left.join(right, "base")


def read_tar_shards(spark: SparkSession, path: str) -> DataFrame:
    """(shard, key, members map<string, binary>): samples of tar shards in any store, one row each; a shard comes as one binary cell, so it must be under 2 GB. shards.read_tar_samples streams shards of any size from a mounted folder."""
    import io

    import pandas as pd

    from corpusloom.sources.shards import samples_of

    def run(batches):
        for b in batches:
            for shard, content in zip(b["path"], b["content"], strict=True):
                for key, members in samples_of(io.BytesIO(content)):
                    yield pd.DataFrame({"shard": [shard], "key": [key], "members": [members]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "shard string, key string, members map<string,binary>")


MESSAGES = "array<struct<role:string,content:string>>"


def read_messages(spark: SparkSession, paths: str) -> DataFrame:
    """SRC-13: (messages): conversations of JSON lines; malformed lines and those without messages have null, so that they can be counted."""
    return spark.read.schema(f"messages {MESSAGES}, _corrupt_record string").option("mode", "PERMISSIVE").json(expand(spark, paths)).select("messages")


def read_object_store(spark: SparkSession, prefix: str, fmt: str = "parquet", first: int | None = None) -> DataFrame:
    """SRC-14: a prefix of any store that Hadoop knows (s3a:, hdfs:, viewfs:, file:); ranges and retries are the file system's. `first` bounds the number of files, in order of their names (LIM-03)."""
    files = sorted(f for f in expand(spark, f"{prefix.rstrip('/')}/*") if not f.rsplit("/", 1)[-1].startswith(("_", ".")))[:first]
    return spark.read.format(fmt).load(files)


def read_blocks(spark: SparkSession, folder: str, fraction: float = 1.0) -> DataFrame:
    """SRC-15: block files in order of their names; of each, the first `fraction` of its rows by position in the file (max(1, ...)). Adds block."""
    rows = spark.read.parquet(*expand(spark, f"{folder.rstrip('/')}/*.parquet")).withColumn("block", F.input_file_name())
    if fraction >= 1.0:
        return rows
    sizes = rows.groupBy("block").agg(F.greatest(F.lit(1), F.floor(F.count("*") * fraction)).alias("_k"))
    return rows.withColumn("_i", F.col("_metadata.row_index")).join(F.broadcast(sizes), "block").where("_i < _k").drop("_i", "_k")


def read_pairs_tsv(spark: SparkSession, paths: str, labels: dict[str, int], columns: tuple[int, int, int, int] = (0, 8, 9, -1), header: bool = True, test_label: str = "contradiction") -> DataFrame:
    """EXT-07: (uid, text_a, text_b, label) of tab-separated lines: id, two texts and the label in the given columns; a file of fewer columns than the label's is a test file, whose rows get the default label. Texts are cleaned; unknown labels and empty texts raise when read."""
    from corpusloom.operators.cleaning import clean_text

    parts = F.split("value", "\t")
    lines = _without_header(spark.read.text(expand(spark, paths))) if header else spark.read.text(expand(spark, paths))
    uid, a, b, label = columns
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    said = F.element_at(parts, label if label < 0 else label + 1)
    at = lambda i: F.trim(clean_text(F.trim(F.get(parts, i))))
    is_test = F.size(parts) <= b + 1
    code = F.coalesce(F.try_element_at(table, F.when(is_test, test_label).otherwise(F.trim(said))), F.raise_error(F.concat(F.lit("unknown label "), said)).cast("int"))
    return lines.select(F.trim(F.get(parts, uid)).cast("long").alias("uid"), at(a).alias("text_a"), at(b).alias("text_b"), code.alias("label"))


def _without_header(lines: DataFrame) -> DataFrame:
    """Text files without their first lines. A first line is in the split that begins at 0, so only that split's lines are numbered."""
    from pyspark.sql import Window

    placed = lines.withColumn("_file", F.col("_metadata.file_path")).withColumn("_start", F.col("_metadata.file_block_start")).withColumn("_i", F.monotonically_increasing_id())
    first = placed.where("_start = 0").withColumn("_n", F.row_number().over(Window.partitionBy("_file").orderBy("_i"))).where("_n > 1")
    return first.select("value").unionByName(placed.where("_start > 0").select("value"))


def read_reading_tests(spark: SparkSession, paths: str) -> DataFrame:
    """EXT-08: (uid, article, question, option, text, label) of JSON articles with questions, options and answers: a row an option; a question with an underscore takes the option in its place, else the option follows it. uid counts questions within the file's article."""
    rows = spark.read.schema("article string, questions array<string>, options array<array<string>>, answers array<string>").json(expand(spark, paths))
    asked = rows.select("article", F.posexplode(F.arrays_zip("questions", "options", "answers")).alias("uid", "q"))
    told = asked.select("uid", "article", F.col("q.questions").alias("question"), (F.ascii(F.col("q.answers")) - 65).alias("label"), F.posexplode("q.options").alias("option", "o"))
    joined = F.when(F.contains("question", F.lit("_")), F.replace("question", F.lit("_"), F.col("o"))).otherwise(F.concat_ws(" ", "question", "o"))
    return told.select("uid", "article", "question", "option", joined.alias("text"), "label")


def first_predictions(spark: SparkSession, paths: str, key: str = "sample_id", order: str | None = None) -> DataFrame:
    """SRC-20: prediction lines of several files, one a key: that of the first file in order of names (of `order` within one)."""
    rows = spark.read.json(expand(spark, paths)).withColumn("_f", F.input_file_name())
    # A split begins at its place in the file, and a task reads it in order.
    rows = rows.withColumn("_i", F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row")) if order is None else F.col(order))
    rest = [c for c in rows.columns if c not in (key, "_f", "_i")]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("_f", "_i")).alias("_r")).select(key, "_r.*")


# -- schema audits -----------------------------------------------------------------------------


def file_columns(spark: SparkSession, files: list[str]) -> DataFrame:
    """(file, columns array<string>, types map<string, string>): each Parquet file's schema, read from its footer."""
    rows = []
    for f in files:
        fields = spark.read.parquet(f).schema.fields
        rows.append((f, [x.name for x in fields], {x.name: x.dataType.simpleString() for x in fields}))
    return spark.createDataFrame(rows, "file string, columns array<string>, types map<string,string>")


def schema_drift(schemas: DataFrame) -> DataFrame:
    """EXT-22: (file, column, kind, expected, found) against the file of least name: missing, added or of another type."""
    first = schemas.orderBy("file").limit(1).select(F.col("types").alias("_t"))
    both = schemas.join(F.broadcast(first)).select("file", "types", "_t", F.explode(F.array_union(F.map_keys("types"), F.map_keys("_t"))).alias("column"))
    now, then = F.try_element_at("types", F.col("column")), F.try_element_at("_t", F.col("column"))
    kind = F.when(now.isNull(), "missing").when(then.isNull(), "added").when(now != then, "type")
    return both.select("file", "column", kind.alias("kind"), then.alias("expected"), now.alias("found")).where("kind IS NOT NULL")


def suspicious_columns(schemas: DataFrame) -> DataFrame:
    """(file, column, type): nested columns whose types differ between files most often: structs in arrays, maps and untyped ones."""
    return schemas.select("file", F.explode("types").alias("column", "type")).where(F.col("type").rlike("array<struct|array<array|map<|void"))
