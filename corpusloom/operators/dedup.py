"""Dedup, contamination counts and grouping of pairs (DDP-01, DDP-03 to DDP-06, JOIN-02, JOIN-11, AGG-27, UDF-12)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.storage import drop_settled, settle


def pairs_to_edges(pairs: DataFrame, column: str) -> DataFrame:
    """(src, dst, similarity) of records {main: [{other: similarity}, ...]} as map<string, array<map<string, double>>>."""
    mains = pairs.select(F.explode(column).alias("src", "others")).select("src", F.explode("others").alias("o"))
    return mains.select("src", F.explode("o").alias("dst", "similarity"))


def groups(edges: DataFrame, threshold: float = 0.7, rounds: int = 100) -> DataFrame:
    """(id, group_id): connected components of edges (src, dst, similarity) of at least the threshold, by least labels that hop along edges; labels are dealt by key and never broadcast, so nothing that grows goes through the driver."""
    good = edges.where(F.col("similarity") >= threshold).select("src", "dst")
    both = settle(good.unionByName(good.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    held = label = settle(both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("g")).select(F.col("src").alias("id"), "g"))
    for _ in range(rounds):
        near = both.join(label.withColumnRenamed("id", "dst").hint("merge"), "dst").groupBy("src").agg(F.min("g").alias("n")).withColumnRenamed("src", "id")
        hop = label.join(near.hint("merge"), "id").select("id", F.least("g", "n").alias("h"), "g")
        jump = hop.join(label.select(F.col("id").alias("h"), F.col("g").alias("hh")).hint("merge"), "h", "left").select("id", F.least("h", F.coalesce("hh", "h")).alias("g"), (F.col("g") != F.least("h", F.coalesce("hh", "h"))).alias("moved"))
        jump = settle(jump)
        label = jump.select("id", "g")
        drop_settled(held)
        held = jump
        if not jump.where("moved").take(1):
            drop_settled(both)
            return label.withColumnRenamed("g", "group_id")
    raise RuntimeError("groups did not settle")


def group_statistics(grouped: DataFrame) -> DataFrame:
    """(remain, remove) of (id, group_id): groups of two or more, and the members beyond one of each."""
    sizes = grouped.groupBy("group_id").agg(F.count_distinct("id").alias("n")).where("n > 1")
    return sizes.agg(F.count("*").alias("remain"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("remove"))


def surplus(grouped: DataFrame) -> DataFrame:
    """(id) of the members to be removed: all but the group's least, where the reference keeps an arbitrary one."""
    return grouped.where("id != group_id").select("id")


def removal_counters(rows: DataFrame, listed: DataFrame, key: str, text: str) -> DataFrame:
    """(written, removed, removed_chars) when the rows with a listed key are removed."""
    marked = rows.join(listed.select(key, F.lit(True).alias("_out")).distinct(), key, "left").select(F.coalesce("_out", F.lit(False)).alias("out"), F.length(text).alias("n"))
    return marked.agg(F.count_if(~F.col("out")).alias("written"), F.count_if("out").alias("removed"), F.coalesce(F.sum(F.when(F.col("out"), F.col("n"))), F.lit(0)).alias("removed_chars"))


def remove_listed(rows: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    return rows.join(listed.select(key).distinct(), key, "left_anti")


def words_of(text: Column) -> Column:
    """Runs of ASCII letters and digits, lower-cased."""
    return F.transform(F.filter(F.split(text, r"[^a-zA-Z0-9]+"), lambda w: w != ""), lambda w: F.lower(w))


def _bound(value: Column, use) -> Column:
    """use(value), the value being computed once and not again for every element of a lambda."""
    return F.transform(F.array(value), use)[0]


def _windows(words: Column, n: int, of) -> Column:
    """of(window) for every n consecutive words."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: of(F.slice(words, i, n)))


def shingles(words: Column, n: int) -> Column:
    """Texts of every n consecutive words."""
    return _bound(words, lambda w: _windows(w, n, lambda x: F.array_join(x, " ")))


def gram_hashes(words: Column, n: int) -> Column:
    return _bound(words, lambda w: _windows(w, n, lambda x: F.xxhash64(x)))


def _keyed(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, _key): the key, of id and text, is never null, so rows that lack an id or share one can be joined too."""
    return rows.select(id_col, text_col).withColumn("_key", F.xxhash64(id_col, text_col))


def _shared(keyed: DataFrame, benchmark: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(id, _key, gram) of rows with a _key."""
    theirs = benchmark.select(F.explode(shingles(words_of(F.col("text")), n)).alias("gram")).distinct()
    keys = theirs.select(F.xxhash64(F.split("gram", " ")).alias("h")).distinct()
    ours = keyed.select("_key", F.explode(F.array_distinct(gram_hashes(words_of(F.col(text_col)), n))).alias("h"))
    hits = ours.join(keys, "h", "left_semi").select("_key").distinct()
    again = keyed.join(hits, "_key", "left_semi")
    grams = again.select(id_col, "_key", F.explode(F.array_distinct(shingles(words_of(F.col(text_col)), n))).alias("gram"))
    return grams.join(theirs, "gram", "left_semi").select(id_col, "_key", "gram").distinct()


def shared_grams(documents: DataFrame, benchmark: DataFrame, n: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, gram): the different n-grams of words that a document shares with the benchmark; rows of one id, or of none, are taken together.

    Documents are dealt by 64-bit hashes of their n-grams; only those with a hit have theirs compared as texts.
    """
    return _shared(_keyed(documents, id_col, text_col), benchmark, n, id_col, text_col).select(id_col, "gram").distinct()


def contaminated(documents: DataFrame, benchmark: DataFrame, n: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shared): documents with n-grams of words that the benchmark has, and how many different ones."""
    return shared_grams(documents, benchmark, n, id_col, text_col).groupBy(id_col).agg(F.count("*").alias("n_shared"))


def _pieces(text: str, grams: set[str], n: int, around: int) -> list[tuple[int, int]]:
    """What is left of a text, as spans, when each listed n-gram goes with `around` characters on both sides."""
    found = list(re.finditer(r"[a-zA-Z0-9]+", text))
    words = [m.group().lower() for m in found]
    out, at = [], 0
    for i in range(len(words) - n + 1):
        if " ".join(words[i : i + n]) in grams:
            low, high = max(0, found[i].start() - around), min(len(text), found[i + n - 1].end() + around)
            if low > at:
                out.append((at, low))
            at = max(at, high)
    return [*out, (at, len(text))] if at < len(text) else out


def decontaminate(documents: DataFrame, benchmark: DataFrame, n: int = 13, around: int = 200, least: int = 200, most_splits: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, text): documents without benchmark passages.

    Each shared n-gram of words goes with `around` characters on both sides; pieces under `least` characters go;
    a document that falls into more than most_splits + 1 pieces goes as a whole. Documents without a hit stay as they
    are, one piece 0, whatever their length; null texts too. Rows without an id, or with that of another, are cut like any other.
    Only documents with a hit pass through Python.
    """
    docs = _keyed(documents, id_col, text_col)
    grams = settle(_shared(docs, benchmark, n, id_col, text_col), "grams")
    hit = grams.groupBy("_key").agg(F.collect_list("gram").alias("_grams"))
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches):
        for b in batches:
            rows = []
            for key, text, own in zip(b[id_col], b[text_col], b["_grams"], strict=True):
                spans = _pieces(text, set(own), n, around)
                if len(spans) <= most_splits + 1:
                    rows += [(key, i, text[x:y]) for i, (x, y) in enumerate((x, y) for x, y in spans if y - x >= least)]
            yield pd.DataFrame(rows, columns=[id_col, "piece", "text"])

    whole = docs.join(grams, "_key", "left_anti").select(id_col, F.lit(0).alias("piece"), F.col(text_col).alias("text"))
    return whole.unionByName(docs.join(hit, "_key").select(id_col, text_col, "_grams").mapInPandas(cut, f"{id_col} {kind}, piece int, text string"))
