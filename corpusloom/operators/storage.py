"""Tables in shared storage, and global ranks and running sums that no single task has to hold."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
_TABLES: list[DataFrame] = []
"""Tables of settle() that nobody has dropped yet."""
_PART_BITS = 33
"""monotonically_increasing_id() holds the partition above so many bits, and the row's place in it below."""


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Only a local master, as in tests, may do without the setting."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = _LOCAL.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="corpusloom-"))
    return found.rstrip("/")


def settle(df: DataFrame, tag: str = "table") -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage is cut, and what a re-run could order otherwise is fixed.

    The table goes when drop_settled(), release() or the end of a scope() says so, and at the latest with the driver.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_folder(spark)}/corpusloom/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, where = _place(spark, path)
    fs.deleteOnExit(where)  # of a path that exists
    out = spark.read.schema(schema).parquet(path)
    out._settled_path = path
    _TABLES.append(out)
    return out


def _place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def drop_settled(df: DataFrame) -> None:
    """Deletes a table of settle() that no plan needs any more."""
    path = getattr(df, "_settled_path", None)
    if path:
        fs, where = _place(df.sparkSession, path)
        fs.delete(where, True)
        fs.cancelDeleteOnExit(where)
        _TABLES[:] = [t for t in _TABLES if t is not df]


def mark_tables() -> int:
    """What release() is to keep: the tables there are now."""
    return len(_TABLES)


def release(since: int = 0, keep: DataFrame | None = None) -> None:
    """Drops the tables made since mark_tables() said so, but for one: what callers do when the lazy results that read them have been consumed."""
    for table in [t for t in _TABLES[since:] if t is not keep]:
        drop_settled(table)


@contextlib.contextmanager
def scope():
    """with scope(): whatever operators settle inside is dropped at the end; results have to be consumed, or written, inside."""
    began = mark_tables()
    try:
        yield
    finally:
        release(began)


def _laid_out(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows sorted over all partitions and written once, with __part (partition) and __place (place in it)."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = [c for c, t in rows.dtypes if not t.startswith("map")]
    salt = F.xxhash64(*plain)  # rows of one order key can be split
    cut = rows.withColumn("__salt", salt).repartitionByRange(parts, *order, "__salt").sortWithinPartitions(*order, "__salt")
    at = F.monotonically_increasing_id()
    done = settle(cut.withColumn("__mono", at), "sorted")
    return done.withColumn("__part", F.shiftright("__mono", _PART_BITS)).withColumn("__place", F.col("__mono").bitwiseAND((1 << _PART_BITS) - 1)).drop("__mono", "__salt")


def ranked(rows: DataFrame, *order: str, name: str = "rank") -> DataFrame:
    """Adds a gapless rank from 0 in the given order, ties in the order of a hash of the row.

    The rows are sorted into partitions once and written; ranks are places in them plus the sizes of those before, of
    which there is one row a partition. An empty table gives no rows; null order values come first.
    """
    laid = _laid_out(rows, list(order))
    sizes = laid.groupBy("__part").agg(F.count("*").alias("n"))
    bases = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__base"))
    return laid.join(F.broadcast(bases), "__part").withColumn(name, F.col("__base") + F.col("__place")).drop("__part", "__place", "__base")


def running(rows: DataFrame, group: list[str], order: list[str], value: str | None, name: str) -> DataFrame:
    """Adds the sum of value over the rows of the group before this one; without a value, their number. Null values count 0.

    A group that holds a third of all rows lies in many partitions: each sums its own part, then come the parts' totals.
    """
    laid = _laid_out(rows, [*group, *order])
    own = Window.partitionBy("__part", *group).orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)
    amount = F.coalesce(F.col(value), F.lit(0)) if value else F.lit(1)
    inside = laid.withColumn("__in", F.coalesce(F.sum(amount).over(own), F.lit(0)))
    totals = laid.groupBy("__part", *group).agg(F.sum(amount).alias("__total"))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1) if group else Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.withColumn("__bases", F.coalesce(F.sum("__total").over(before), F.lit(0))).drop("__total")
    names = {c: f"__g{i}" for i, c in enumerate(group)}
    bases = bases.select(F.col("__part").alias("__of"), *[F.col(c).alias(n) for c, n in names.items()], "__bases")
    same = F.col("__part") == F.col("__of")
    for c, n in names.items():
        same = same & F.col(c).eqNullSafe(F.col(n))
    return inside.join(bases, same).withColumn(name, F.col("__in") + F.col("__bases")).drop("__part", "__place", "__in", "__bases", "__of", *names.values())


WAVES, WAVE_BLOCKS = 16, 16
"""Jobs that a long write is cut into at most, and blocks that a job has at least."""


def append_in_waves(rows: DataFrame, block: str, make, folder: str) -> None:
    """Appends make(rows) to folder, partitioned by block, in several jobs with some blocks each: a job that has ended stays, so a write that is stopped loses the present one only."""
    waves = max(1, min(WAVES, rows.select(block).distinct().count() // WAVE_BLOCKS))
    for w in range(waves):
        own = rows if waves == 1 else rows.where(F.pmod(F.xxhash64(block), F.lit(waves)) == w)
        make(own).write.mode("append").partitionBy(block).parquet(folder)


FEW = 10_000
"""Rows that one task may take in order."""


def least_rows(rows: DataFrame, n: int, order: Column, *ties: str) -> DataFrame:
    """Exactly the n rows (all, if there are no more) of least order, a 64-bit hash; rows of one hash in the order of ties.

    Counts of 2 ** 16 ranges of the hash say in which one the n-th row is, and so on inside that one, until it has FEW rows at most; the
    rows of the ranges before are a filter, and no task holds more than FEW of the rest. Rows that share one whole hash beyond that are ranked.
    """
    if n <= FEW:
        return rows.withColumn("__h", order).orderBy("__h", *ties).limit(max(n, 0)).drop("__h")
    own, inside, parts, many = rows.withColumn("__h", order), F.lit(True), [], 0
    for low in (48, 32, 16, 0):
        at = F.shiftright("__h", low)
        at = at if low == 48 else F.pmod(at, F.lit(1 << 16))
        counts = own.where(inside).groupBy(at.alias("at")).agg(F.count("*").alias("n")).orderBy("at").collect()  # 2 ** 16 rows at most
        cut = None
        for r in counts:
            if r["n"] > n:
                cut, many = r["at"], r["n"]
                break
            n -= r["n"]
        if cut is None:
            return _all_of([*parts, own.where(inside)]).drop("__h")
        parts.append(own.where(inside & (at < cut)))
        inside = inside & (at == cut)
        if many <= FEW or not n:
            break
    rest = own.where(inside)
    if n and many <= FEW:
        rest = rest.withColumn("__one", F.lit(0)).withColumn("__r", F.row_number().over(Window.partitionBy("__one").orderBy("__h", *ties)) - 1).drop("__one")
    elif n:
        rest = ranked(rest, "__h", *ties, name="__r")
    if n:
        parts.append(rest.where(F.col("__r") < n).drop("__r"))
    return _all_of(parts).drop("__h")


def _all_of(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
