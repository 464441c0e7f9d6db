"""WARC records and a Merkle fixity audit of two replicas, in DataFrame functions.

The records of one id are a leaf, and leaves stand in order of ids, so that each covers a range of offsets: leaves are
numbered by their rank among the ids of both replicas, whatever gaps the ids have. 16 nodes that follow each other make one
node of the next level, whose hash covers their numbers, hashes and lengths in order, and so the range of offsets below it.
Two replicas are compared from the roots down, and only children of nodes that differ are looked at.
Groups hold 16 rows at most at every level, and each level has a sixteenth of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.shared import materialise
from corpusloom.operators.storage import ranked

FAN_BITS = 4


def warc_record(number: Column, url: Column, body: Column) -> Column:
    """The text of one WARC/1.0 response record, lengths counted in UTF-8 bytes. Nulls count as empty."""
    body = F.coalesce(body, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(number.cast("string"), F.lit("")),
        F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """(lost, number, n_bytes, record_sha256) for each row: number is the id, or, where that is null (lost), made of the content."""
    text = warc_record(F.col(id_col), F.col(url_col), F.col(body_col))
    out = pages.select(F.col(id_col).cast("long").alias("number"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("record_sha256"))
    return out.select(F.col("number").isNull().alias("lost"), F.coalesce("number", F.xxhash64("record_sha256")).alias("number"), "n_bytes", "record_sha256")


def numbered(ours: DataFrame, theirs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with node: the rank of a record's number among those of both; numbers made of contents come last."""
    key = ["lost", "number"]
    nodes = materialise(ranked(ours.select(*key).unionByName(theirs.select(*key)).distinct(), *key, name="node"), "numbers")
    return ours.join(nodes, key), theirs.join(nodes, key)


def leaves(found: DataFrame) -> DataFrame:
    """(node, n, length, hash). Records of one node are hashed as a multiset, by sums that combine before the shuffle."""
    parts = [F.sum(F.conv(F.substring("record_sha256", 1 + 16 * i, 16), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"s{i}") for i in range(4)]
    summed = found.groupBy("node").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("length"), *parts)
    return summed.select("node", "n", "length", F.sha2(F.concat_ws(":", "n", "length", "s0", "s1", "s2", "s3"), 256).alias("hash"))


def level_above(level: DataFrame) -> DataFrame:
    child = F.struct("node", "hash", "length", "n")
    grouped = level.groupBy(F.shiftright("node", FAN_BITS).alias("node")).agg(F.sum("n").alias("n"), F.sum("length").alias("length"), F.array_sort(F.collect_list(child)).alias("c"))
    said = F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["node"].cast("string"), x["hash"], x["length"].cast("string"))), ",")
    return grouped.select("node", "n", "length", F.sha2(said, 256).alias("hash"))


def tree(found: DataFrame) -> list[DataFrame]:
    """Levels from the leaves up to one node. No records: one empty level."""
    levels = [materialise(leaves(found), "leaves")]
    high = levels[0].agg(F.max("node")).first()[0] or 0
    while high > 0:
        levels.append(materialise(level_above(levels[-1]), "nodes"))
        high >>= FAN_BITS
    return levels


def offsets(levels: list[DataFrame]) -> DataFrame:
    """(node, offset) of the leaves: where each begins if all records stand in order of their numbers."""
    order = Window.partitionBy("up").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    root = levels[-1].withColumn("up", F.lit(0))
    out = root.select("node", F.coalesce(F.sum("length").over(order), F.lit(0)).alias("offset"))
    for level in reversed(levels[:-1]):
        inside = level.withColumn("up", F.shiftright("node", FAN_BITS)).select("node", "up", F.coalesce(F.sum("length").over(order), F.lit(0)).alias("inside"))
        out = inside.join(out.select(F.col("node").alias("up"), "offset"), "up").select("node", (F.col("offset") + F.col("inside")).alias("offset"))
    return out


def mismatches(ours: list[DataFrame], theirs: list[DataFrame]) -> DataFrame:
    """(node, status) of the leaves that differ: `corrupt`, `missing` in theirs or `extra` there."""
    while len(ours) < len(theirs):
        ours = [*ours, materialise(level_above(ours[-1]), "nodes")]
    while len(theirs) < len(ours):
        theirs = [*theirs, materialise(level_above(theirs[-1]), "nodes")]
    bad = None
    for a, b in zip(reversed(ours), reversed(theirs), strict=True):
        if bad is not None:
            up = bad.select(F.col("node").alias("up"))
            a, b = (x.withColumn("up", F.shiftright("node", FAN_BITS)).join(up, "up", "left_semi") for x in (a, b))
        both = a.select("node", F.col("hash").alias("x")).join(b.select("node", F.col("hash").alias("y")), "node", "full")
        status = F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "extra").otherwise("corrupt")
        bad = materialise(both.where("NOT (x <=> y)").select("node", status.alias("status")), "differing")
    return bad


def audit(ours: DataFrame, theirs: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """(page_id, n_bytes, record_sha256, offset, status) for each of our rows, and for each of their rows that we don't have.

    offset is where the records of that id begin in our archive, in order of ids; null for rows that we
    don't have. Repeated rows are records like any other: of records of one id, all get the id's status. Rows without an
    id (null there) stand last and are told apart by their content. Nulls in other columns count as empty; other
    columns are not read; empty tables have no rows.
    """
    a, b = (materialise(records(x, id_col, url_col, body_col), "records") for x in (ours, theirs))
    a, b = numbered(a, b)
    x, y = tree(a), tree(b)
    bad = mismatches(x, y)
    mine = a.join(offsets(x), "node").join(bad, "node", "left")
    extra = b.join(bad.where("status = 'extra'"), "node").select("lost", "number", "n_bytes", "record_sha256", F.lit(None).cast("long").alias("offset"), "status")
    out = mine.select("lost", "number", "n_bytes", "record_sha256", "offset", F.coalesce("status", F.lit("ok")).alias("status")).unionByName(extra)
    return out.select(F.when(~F.col("lost"), F.col("number")).alias("page_id"), "n_bytes", "record_sha256", "offset", "status")


def read_archives(archives: DataFrame, content_col: str = "content", path_col: str = "path") -> DataFrame:
    """(path, offset, length, target_uri, body binary): the records of uncompressed WARC files, as spark.read.format("binaryFile") gives them.

    A file that ends in a header gives no row for it, one that ends in a body what is there; a header without a
    readable length has an empty body. Null contents have no records.
    """
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, rows = 0, []
                while raw and (begin := raw.find(b"WARC/", at)) >= 0:
                    end = raw.find(b"\r\n\r\n", begin)
                    if end < 0:
                        break
                    fields = dict(x.split(b": ", 1) for x in raw[begin:end].split(b"\r\n")[1:] if b": " in x)
                    told = fields.get(b"Content-Length", b"0").strip()
                    size = int(told) if told.isdigit() else 0
                    rows.append((path, begin, end + 4 + size + 4 - begin, fields.get(b"WARC-Target-URI", b"").decode("utf-8", "replace"), raw[end + 4 : end + 4 + size]))
                    at = end + 4 + size
                cols = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], ["path", "offset", "length", "target_uri", "body"])

    return archives.select(F.col(path_col).alias("path"), F.col(content_col).alias("content")).mapInArrow(run, "path string, offset long, length long, target_uri string, body binary")
