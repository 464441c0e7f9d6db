"""Quality rules with cross-document line frequency, in DataFrame and SQL functions only.

Per document: counts of words, signs, repeated lines and repeated windows of three words. Across documents: normalised lines
are hashed, the documents of each host that have a line are counted, lines above the limits are removed, and documents that
lose most of their words so are rejected.

A text's arrays stay in its row: windows become numbers with the hash above and the place below, which are sorted, so equal windows stand side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import materialise

LEAST_WORDS = 50
MOST_REPEATED = 50
"""Per cent of words in repeated windows."""
LINE_DOCUMENTS = 10
LINE_SHARE = 0.001
"""A line goes where more than LINE_DOCUMENTS documents of its host have it, and more than this share of them."""
LEAST_LEFT = 50
"""Per cent of its words that a document must keep."""
BROADCAST_LINES = 1 << 18
"""Up to so many frequent lines (16 bytes each) are broadcast; more are joined by a shuffle."""
SYMBOLS = "#*$%&|<>"
IGNORED = " .,;:!?"
"""Signs that normalised lines are without."""


def _without(text: str, signs: str) -> str:
    for sign in signs:
        text = f"replace({text}, '{sign}', '')"
    return text


def _spaced(text: str) -> str:
    """White space but for line ends as spaces: replace() finds bytes, without a regex."""
    for code in (9, 11, 12, 13):
        text = f"replace({text}, chr({code}), ' ')"
    return text


def _words(line: str) -> str:
    return f"array_remove(split({line}, ' '), '')"


#: SQL over _h, hashes of a text's words: a hash for each window of three.
WINDOWS = "transform(slice(_h, 1, greatest(size(_h) - 2, 0)), (x, i) -> xxhash64(x, _h[i + 1], _h[i + 2]))"
#: SQL: those hashes with the window's place in the lowest _bits bits, and the place in such a number.
KEYS = "transform(_g, (x, i) -> shiftleft(shiftright(x, _bits), _bits) + i)"
PLACE = "cast({0} & (shiftleft(1L, _bits) - 1) AS int)"


def _equal(other: str) -> str:
    """SQL: whether the window of number x is that of the other number (null: no): first the hashes, then the words."""
    p, q = PLACE.format("x"), PLACE.format(other)
    words = " AND ".join(f"_w[{p} + {k}] = _w[{q} + {k}]" for k in range(3))
    return f"CASE WHEN shiftright(x ^ {other}, _bits) = 0 THEN {words} ELSE false END"


def measured(documents: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines): lines holds (hash, words) of each line of which normalising leaves something."""
    df = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"))
    df = df.withColumn("_u", F.expr(_spaced("_t")))
    df = df.select(
        "doc_id", "host",
        F.expr(f"transform(split(_u, '\\n'), l -> {_words('l')})").alias("_l"),
        F.expr(f"split(lower({_without('_u', IGNORED)}), '\\n')").alias("_n"),
        F.expr("filter(split(_t, '\\n'), l -> l RLIKE '[^ \\\\x09-\\\\x0D]')").alias("_r"),
        F.expr("cast(length(_u) - octet_length(_u) + octet_length(replace(replace(_u, ' ', ''), '\\n', '')) AS long)").alias("word_chars"),
        F.expr(f"CASE WHEN _t RLIKE '[{SYMBOLS}]' THEN cast(octet_length(_t) - octet_length({_without('_t', SYMBOLS)}) AS long) ELSE 0L END").alias("n_symbols"),
    )
    df = df.select(
        "doc_id", "host", "word_chars", "n_symbols",
        F.expr("cast(size(_r) - size(array_distinct(_r)) AS long)").alias("n_dup_lines"),
        F.expr("filter(zip_with(_n, _l, (n, l) -> named_struct('hash', CASE WHEN n <> '' THEN xxhash64(n) END, 'words', size(l))), x -> x.hash IS NOT NULL)").alias("lines"),
        F.flatten("_l").alias("_w"),
    )
    df = df.withColumn("_h", F.expr("transform(_w, w -> xxhash64(w))"))
    df = df.withColumn("_bits", F.expr("greatest(length(bin(size(_h))), 1)"))
    df = df.withColumn("_g", F.expr(WINDOWS))
    # Most texts have no window twice; the others' windows are sorted, so equal ones are neighbours.
    df = df.withColumn("_s", F.expr(f"CASE WHEN size(array_distinct(_g)) = size(_g) THEN cast(array() AS array<bigint>) ELSE sort_array({KEYS}) END"))
    df = df.withColumn("_p", F.expr(f"sort_array(transform(filter(_s, (x, i) -> {_equal('get(_s, i - 1)')} OR {_equal('get(_s, i + 1)')}), x -> {PLACE.format('x')}))"))
    repeated = "cast(aggregate(transform(_p, (p, i) -> least(3, coalesce(get(_p, i + 1), p + 3) - p)), 0L, (s, x) -> s + x) AS long)"
    return df.select("doc_id", "host", F.expr("cast(size(_w) AS long)").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.expr(repeated).alias("n_repeat_words"), "lines")


def frequent_lines(found: DataFrame, least: int = LINE_DOCUMENTS, share: float = LINE_SHARE) -> DataFrame:
    """(host, hash) of the lines above the limits, from rows of measured().

    A document counts once for a line; counts are combined before the shuffle, so a host with a third of all documents and a
    line that all have are spread.
    """
    hosts = found.groupBy("host").agg(F.count("*").alias("documents"))
    counts = found.select("host", F.explode(F.expr("array_distinct(transform(lines, x -> x.hash))")).alias("hash")).groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") > least)
    return counts.join(hosts, "host").where(F.col("n") > F.col("documents") * share).select("host", "hash")


def judge(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", least: int = LINE_DOCUMENTS, share: float = LINE_SHARE) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_removed), a row for each row of documents.

    Words are maximal runs of other than ASCII white space. n_dup_lines counts lines with a word that equal an earlier one,
    n_repeat_words the words in windows of three that are found twice or more. Lines are normalised to lower case without
    spaces and IGNORED signs; n_removed counts the words of a document's lines that more than `least` documents of its host, and more
    than `share` of them, have. kept is false for base_failed (fewer than LEAST_WORDS words, or over MOST_REPEATED per cent of
    them repeated) and where less than LEAST_LEFT per cent of the words are left. Null text is an empty one; null hosts
    are one host; rows that repeat an id, or have none, are documents of their own; an empty table gives no rows; other columns are not read.
    """
    found = materialise(measured(documents, id_col, text_col, host_col), "lines")
    many = materialise(frequent_lines(found, least, share), "frequent")
    if many.count() <= BROADCAST_LINES:
        many = F.broadcast(many)
    row: Column = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    keyed = found.withColumn("_row", row)
    hit = keyed.select("_row", "host", F.explode("lines").alias("x")).select("_row", "host", F.col("x.hash").alias("hash"), F.col("x.words").alias("words"))
    lost = hit.join(many, ["host", "hash"]).groupBy("_row").agg(F.sum("words").alias("n_removed"))
    every = keyed.drop("lines", "host").join(lost, "_row", "left").withColumn("n_removed", F.coalesce("n_removed", F.lit(0)).cast("long"))
    failed = F.expr(f"n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words")
    kept = F.expr(f"NOT base_failed AND 100 * (n_words - n_removed) >= {LEAST_LEFT} * n_words")
    out = every.withColumn("base_failed", failed).withColumn("kept", kept)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed")
