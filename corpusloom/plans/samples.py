"""Queries of training samples, orders, mixing, splits and packing (ARR-*, WIN-*, SRT-*, LIM-*, SMP-*, PRT-*, SET-*, PCK-*, FLT-15..23, PRJ-*, EXT-*, RTR-*)."""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import functions as F

from corpusloom.functions import images
from corpusloom.operators import dedup, inverted, mixing, ordering, packing, retrieval, training
from corpusloom.operators.storage import settle
from corpusloom.plans.register import query, t

_TOKENS = "SELECT doc_id, list_transform(string_split(text, ' '), lambda w: length(w) % 50 + 2) a FROM documents WHERE text IS NOT NULL"


def tokens(spark, d):
    """(doc_id, a): a number a word."""
    return t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.transform(F.split("text", " ", -1), lambda w: F.length(w) % 50 + 2).alias("a"))


def joined(c):
    return F.md5(F.array_join(F.transform(c, lambda x: x.cast("string")), ","))


def _md5(x: str) -> str:
    return f"md5(array_to_string({x}, ','))"


@query(f"""WITH d AS ({_TOKENS}), c AS (SELECT doc_id, a, a[1:64] h FROM d), s AS (SELECT doc_id, a, h, list_concat(a[1:63], [1]) e FROM c), p AS (SELECT doc_id, a, h, list_concat(e, list_transform(range(65 - len(e)), lambda i: 0)) x FROM s)
SELECT doc_id, {_md5('list_concat(h, list_transform(range(64 - len(h)), lambda i: 0))')} AS "right", {_md5('list_concat(list_transform(range(64 - len(h)), lambda i: 9), h)')} AS "left", {_md5('x[1:64]')} AS tokens, {_md5('x[2:65]')} AS labels,
 {_md5('list_transform(x[2:65], lambda v: CASE WHEN v = 0 THEN 0 ELSE 1 END)')} AS loss_mask, CAST(ceil(len(a) / 8) * 8 AS BIGINT) AS rounded FROM p""")
def arr02_padding_and_shift(spark, d):
    x = tokens(spark, d).withColumn("s", training.shifted(F.col("a"), F.col("a"), 64, 1, 0))
    return x.select("doc_id", joined(training.padded(F.col("a"), 64)).alias("right"), joined(training.padded(F.col("a"), 64, 9, left=True)).alias("left"), joined("s.tokens").alias("tokens"), joined("s.labels").alias("labels"), joined(F.transform("s.loss_mask", lambda v: v.cast("int"))).alias("loss_mask"), training.rounded_up(F.size("a"), 8).alias("rounded"))


@query(f"""WITH d AS ({_TOKENS}), v AS (SELECT doc_id, list_transform(a, lambda x: CASE WHEN x % 3 > 0 THEN 1 ELSE 0 END) v FROM d), u AS (SELECT doc_id, unnest(v) v, generate_subscripts(v, 1) i, len(v) n FROM v),
w AS (SELECT *, CASE WHEN v = 1 AND i > 1 AND i < n AND lag(v) OVER o = 1 AND lead(v) OVER o = 1 THEN 1 ELSE 0 END t FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT *, CASE WHEN i = 1 THEN 0 WHEN t = 0 THEN 1 WHEN lag(t) OVER o = 0 THEN 1 ELSE 0 END s FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)), c AS (SELECT doc_id, i, sum(s) OVER (PARTITION BY doc_id ORDER BY i) p FROM s)
SELECT doc_id, md5(string_agg(p::VARCHAR, ',' ORDER BY i)) AS positions FROM c GROUP BY doc_id""")
def arr04_vision_positions(spark, d):
    x = tokens(spark, d).select("doc_id", F.transform("a", lambda v: F.when(v % 3 > 0, 1).otherwise(0)).alias("v"))
    return x.select("doc_id", joined(training.vision_positions(F.col("v"))).alias("positions"))


@query("""WITH h AS (SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) p FROM conversations GROUP BY 1)
SELECT conv_id, CAST(2 * len(p) + 1 AS INT) AS n_prompt, p[1].content AS first, 'assistant' AS second_role, 'do' || chr(10) || 'it ' || conv_id AS asked, 'yes' AS response, CAST(length('do') + length('it ' || conv_id) + 3 + list_sum(list_transform(p, lambda m: length(m.content) + length(m.role))) AS BIGINT) AS d_len FROM h""")
def arr07_alpaca(spark, d):
    from corpusloom.operators import conversations

    x = conversations.gather(t(spark, d, "conversations"))
    rows = x.select("conv_id", F.transform("messages", lambda m: F.struct(m["content"].alias("query"), m["role"].alias("response"))).alias("h"), F.lit("do").alias("i"), F.concat(F.lit("it "), F.col("conv_id").cast("string")).alias("q"), F.lit("yes").alias("o"))
    out = training.alpaca(rows, "conv_id", "i", "q", "o", history="h")
    return out.select("conv_id", F.size("prompt").alias("n_prompt"), F.col("prompt")[0]["content"].alias("first"), F.col("prompt")[1]["role"].alias("second_role"), F.element_at("prompt", -1)["content"].alias("asked"), F.col("response")[0]["content"].alias("response"), "d_len")


@query("""WITH n AS (SELECT doc_id, len(string_split(text, ' ')) n FROM documents WHERE text IS NOT NULL) SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens, 0 AS unmasked_changed, 0 AS wrong_labels, true AS share, true AS masks, true AS randoms, true AS again FROM n""")
def arr05_masked_lm(spark, d):
    x = tokens(spark, d).withColumn("m", training.masked_lm(F.col("a"), F.col("doc_id"), 1000, 5000))
    y = x.select("doc_id", "a", "m", training.masked_lm(F.col("a"), F.col("doc_id"), 1000, 5000).alias("m2"))
    z = y.select("doc_id", (F.col("m") == F.col("m2")).alias("same"), F.explode(F.arrays_zip("a", F.col("m.text").alias("text"), F.col("m.labels").alias("labels"), F.col("m.loss_mask").alias("k"))).alias("v")).select("doc_id", "same", "v.*")
    picked = F.sum("k")
    out = z.agg(F.count_distinct("doc_id").alias("docs"), F.count("*").alias("tokens"), F.count_if((F.col("k") == 0) & (F.col("a") != F.col("text"))).cast("int").alias("unmasked_changed"), F.count_if(F.col("labels") != F.when(F.col("k") == 1, F.col("a")).otherwise(-1)).cast("int").alias("wrong_labels"),
        (picked / F.count("*")).between(0.13, 0.17).alias("share"), (F.count_if(F.col("text") == 5000) / picked).between(0.76, 0.84).alias("masks"), (F.count_if((F.col("k") == 1) & (F.col("text") != 5000) & (F.col("text") != F.col("a"))) / picked).between(0.07, 0.13).alias("randoms"), F.bool_and("same").alias("again"))
    return out


@query("""WITH d AS (SELECT doc_id, string_split(text, '. ') s FROM documents WHERE text IS NOT NULL), q AS (SELECT doc_id, len(s) n, list_sum(list_transform(s, lambda x: len(string_split(x, ' ')))) k FROM d WHERE len(s) >= 2)
SELECT doc_id, CAST(least(k, 128) AS INT) AS tokens, CAST(k > 128 AS INT) AS truncated, true AS fits FROM q""")
def arr06_sentence_pairs(spark, d):
    s = F.transform(F.split("text", r"\. ", -1), lambda x: F.split(x, " ", -1))
    x = t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", s.alias("s")).where(F.size("s") >= 2)
    y = x.select("doc_id", "s", training.sentence_pair(F.col("s"), F.col("doc_id"), 128).alias("p"))
    n = F.size("p.a") + F.size("p.b")
    return y.select("doc_id", n.alias("tokens"), F.col("p.truncated").alias("truncated"), (F.size(F.array_except(F.concat("p.a", "p.b"), F.flatten("s"))) == 0).alias("fits"))


@query("""WITH d AS (SELECT doc_id, string_split(text, '. ') s FROM documents WHERE text IS NOT NULL) SELECT count(*) AS blocks, 0 AS strange_queries, 0 AS strange_contexts, true AS kept FROM d""")
def ext18_inverse_cloze(spark, d):
    s = F.transform(F.split("text", r"\. ", -1), lambda x: F.split(x, " ", -1))
    x = t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", s.alias("s"))
    y = training.inverse_cloze(x, "doc_id", "s", 100_000, keep=0.5).join(x, "doc_id")
    words = F.flatten("s")
    stays = F.size("context") == F.size(words)
    return y.agg(F.count("*").alias("blocks"), F.count_if(~F.array_contains(F.transform("s", lambda v: F.array_join(v, " ")), F.array_join("query", " "))).cast("int").alias("strange_queries"), F.count_if(~stays & (F.size("context") + F.size("query") != F.size(words))).cast("int").alias("strange_contexts"), F.avg(stays.cast("int")).between(0.35, 0.65).alias("kept"))


@query(f"""WITH d AS ({_TOKENS}), n AS (SELECT doc_id, a, greatest(CAST(ceil(greatest(len(a) - 1 - 32, 0) / 32) AS INT) + 1, 1) n FROM d), w AS (SELECT doc_id, unnest(range(n)) w, a FROM n), x AS (SELECT doc_id, w, a[w * 32 + 1:w * 32 + 65] t FROM w)
SELECT doc_id, CAST(w AS INT) AS "window", {_md5('list_concat(t, list_transform(range(65 - len(t)), lambda i: 0))')} AS text, {_md5('list_transform(range(64), lambda i: CASE WHEN i + 1 < len(t) AND (w = 0 OR i >= 32) THEN 1 ELSE 0 END)')} AS pad_mask FROM x""")
def win08_eval_windows(spark, d):
    return training.eval_windows(tokens(spark, d), "doc_id", "a", 64, 32).select("doc_id", "window", joined("text").alias("text"), joined("pad_mask").alias("pad_mask"))


@query("""WITH r AS (SELECT p_partkey, CAST(p_size * 20 + 300 AS INT) h, CAST(p_size * 10 + 200 AS INT) w FROM part), s AS (SELECT p_partkey, h, w, unnest(range(greatest(CAST(ceil((h - 256) / 128.0) AS INT), 0) + 1)) y FROM r), c AS (SELECT *, unnest(range(greatest(CAST(ceil((w - 256) / 128.0) AS INT), 0) + 1)) x FROM s)
SELECT p_partkey, CAST(y * 128 AS INT) AS y, CAST(x * 128 AS INT) AS x, CAST(least(256, h - y * 128) AS INT) AS height, CAST(least(256, w - x * 128) AS INT) AS width FROM c""")
def ext02_crops(spark, d):
    x = t(spark, d, "part").select("p_partkey", (F.col("p_size") * 20 + 300).cast("int").alias("h"), (F.col("p_size") * 10 + 200).cast("int").alias("w"))
    return training.crops(x, "p_partkey", "h", "w", 256, 128)


@query("""WITH n AS (SELECT count(*) n FROM customer), c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 r FROM customer) SELECT c_custkey, CAST(e AS INT) AS epoch, CAST(r + e * n AS BIGINT) AS position FROM c, n, range(3) x(e) WHERE r + e * n < n * 5 // 2""")
def win06_epochs(spark, d):
    x = t(spark, d, "customer").select("c_custkey")
    return training.epochs(x, x.count() * 5 // 2, "c_custkey").select("c_custkey", "epoch", "position")


@query("""WITH r AS (SELECT doc_id, n_chars, (row_number() OVER (ORDER BY doc_id) - 1) // 100 pool FROM documents) SELECT doc_id, pool, CAST(row_number() OVER (PARTITION BY pool ORDER BY n_chars, doc_id) - 1 AS INT) AS place, true AS shuffled FROM r""")
def srt02_pools(spark, d):
    x = t(spark, d, "documents").select("doc_id", "n_chars")
    one = training.pooled(x, "doc_id", "n_chars", 100, "doc_id")
    two = training.pooled(x, "doc_id", "n_chars", 100, "doc_id", reshuffle=True).select("doc_id", F.col("pool").alias("p2"), F.col("place").alias("q"))
    return one.join(two, "doc_id").select("doc_id", "pool", "place", ((F.col("pool") == F.col("p2")) & F.col("q").between(0, 99)).alias("shuffled"))


@query("""SELECT 'sorted' AS kind, doc_id FROM (SELECT doc_id FROM documents ORDER BY n_chars, doc_id LIMIT 50) UNION ALL SELECT 'first', doc_id FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 30)""")
def srt01_lim01_first_rows(spark, d):
    x = t(spark, d, "documents").select("doc_id", "n_chars")
    one = training.sorted_by_length(x, "n_chars", "doc_id").limit(50).select(F.lit("sorted").alias("kind"), "doc_id")
    return one.unionByName(training.first_rows(x, 30, "doc_id").select(F.lit("first").alias("kind"), "doc_id"))


@query("""SELECT 'percent' AS kind, greatest(1, count(*) * 25 // 100) AS n, true AS known FROM documents UNION ALL SELECT 'random', 40, true UNION ALL SELECT 'share', CAST(floor(count(*) * 0.1::DOUBLE) AS BIGINT), true FROM documents""")
def smp03_samples(spark, d):
    x = t(spark, d, "documents").select("doc_id")
    n = x.count()
    kinds = (("percent", training.percent_rows(x, 25, "doc_id")), ("random", training.random_rows(x, 40, "doc_id")), ("share", training.random_rows(x, training.wanted_rows(0.1, n), "doc_id")))
    out = None
    for name, rows in kinds:
        part = rows.distinct().join(x, "doc_id", "left_semi").agg(F.lit(name).alias("kind"), F.count("*").alias("n"), (F.count("*") == rows.count()).alias("known"))
        out = part if out is None else out.unionByName(part)
    return out


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 r, count(*) OVER () n FROM documents) SELECT doc_id, CAST(least(r // (n // 7), 6) AS INT) AS host, CAST(CASE WHEN r < (n % 7) * (n // 7 + 1) THEN r // (n // 7 + 1) ELSE n % 7 + (r - (n % 7) * (n // 7 + 1)) // (n // 7) END AS INT) AS part FROM r""")
def prt01_splits(spark, d):
    x = t(spark, d, "documents").select("doc_id")
    return training.host_split(x, 7, "doc_id").join(training.array_split(x, 7, "doc_id"), "doc_id").select("doc_id", "host", "part")


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 - 24 r, count(*) OVER () n FROM documents) SELECT doc_id, r // 24 AS batch FROM r WHERE r >= 0 AND r // 24 < (n - 24) // 24 AND r % 24 BETWEEN 8 AND 15""")
def prt02_rank_batches(spark, d):
    return training.rank_batches(t(spark, d, "documents").select("doc_id"), 8, 1, 3, consumed=24).select("doc_id", "batch")


@query("""WITH n AS (SELECT count(*) n FROM documents), b AS (SELECT n // 24 * 8 b FROM n) SELECT 'sharded' AS kind, b // 8 * 8 - 8 AS rows, (b - 8) // 8 AS batches, true AS own FROM b UNION ALL SELECT 'strided', ((n // 8 * 8 - 24 + 1) // 3) // 8 * 8, ((n // 8 * 8 - 24 + 1) // 3) // 8, true FROM n""")
def ext06_random_batches(spark, d):
    x = t(spark, d, "documents").select("doc_id")
    out = None
    for kind in ("sharded", "strided"):
        y = training.random_batches(x, 8, 1, 3, consumed=24, sharded=kind == "sharded")
        part = y.agg(F.lit(kind).alias("kind"), F.count("*").alias("rows"), F.count_distinct("batch").alias("batches"), (F.count("*") == F.count_distinct("doc_id")).alias("own"))
        out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_quantity > 25 THEN NULL ELSE row_number() OVER (PARTITION BY l_quantity > 25 ORDER BY l_orderkey * 10 + l_linenumber, l_partkey, l_suppkey) - 1 END AS VARCHAR) IS NULL AS has_image, greatest(1, CAST(ceil(ceil((l_partkey * 100 + 1) / 160) / 2) AS INT)) AS audio,
 CASE WHEN l_linenumber % 2 = 0 THEN 3 ELSE 2 END AS parts FROM lineitem""")
def win02_ext17_media(spark, d):
    x = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_quantity") > 25, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>")).alias("i"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"))
    named = training.imageless_names(x, "o", "i")
    prompt = training.task_prompt(F.when(F.col("l_linenumber") % 2 == 0, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array(F.lit("x"))), F.lit("q"))
    return named.select("l_orderkey", "l_linenumber", F.col("name").isNull().alias("has_image"), training.audio_tokens(F.col("l_partkey") * 100).alias("audio"), F.size(prompt).alias("parts"))


@query("""SELECT conv_id, md5('<|im_start|>user' || chr(10) || a || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)) AS prompt, md5(b || '<|im_end|>' || chr(10)) AS chosen, md5('no<|im_end|>' || chr(10)) AS rejected FROM (SELECT conv_id, max(CASE WHEN turn = 0 THEN text END) a, max(CASE WHEN turn = 1 THEN text END) b FROM conversations GROUP BY 1)""")
def ext16_preferences(spark, d):
    x = t(spark, d, "conversations").groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("a"), F.max(F.when(F.col("turn") == 1, F.col("text"))).alias("b"), F.lit("no").alias("c"))
    y = training.preference(x, "conv_id", "a", "b", "c")
    return y.select("conv_id", *[F.md5(c).alias(c) for c in ("prompt", "chosen", "rejected")])


@query("""SELECT 'length' AS kind, count(*) AS n FROM documents WHERE n_chars <= 500 UNION ALL SELECT 'valid', count(*) FROM documents WHERE lang IS NULL OR lang <> 'fr' UNION ALL SELECT 'images', count(*) FROM documents WHERE n_chars % 3 = 0 OR n_chars % 2 = 0
UNION ALL SELECT 'checker', count(*) FROM documents WHERE n_chars % 2 = 0 UNION ALL SELECT 'score', count(*) FROM documents WHERE n_chars > 600 AND lang IS DISTINCT FROM 'de' UNION ALL SELECT 'rated', count(*) FROM documents WHERE n_chars % 4 <> 0 UNION ALL SELECT 'band', count(*) FROM documents WHERE n_chars % 5 IN (0, 2, 3)""")
def flt16_row_filters(spark, d):
    from corpusloom.functions import scoring

    x, n = t(spark, d, "documents"), F.col("n_chars")
    none = F.array().cast("array<string>")
    rewards = F.when(n % 5 == 0, F.array().cast("array<double>")).when(n % 5 == 1, F.array(F.lit(1.0), F.lit(1.0))).when(n % 5 == 4, F.array(F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))
    kinds = {
        "length": training.within_length(x, "n_chars", 500), "valid": training.valid_rows(x.withColumn("__valid__", F.col("lang") != "fr")),
        "images": training.with_some_image(x.withColumn("w", F.when(n % 3 != 0, F.array(F.lit("i")))).withColumn("f", F.when(n % 2 == 0, F.array(F.lit("i"))).otherwise(none)), "w", "f"),
        "checker": training.without_checker(x.withColumn("generated_checker", F.when(n % 2 != 0, "c"))), "score": training.above_score(x, "n_chars", 600, "lang", "de"), "rated": training.rated(x.withColumn("r", F.when(n % 4 == 0, -1).otherwise(3)), "r"),
        "band": x.where(scoring.in_band(rewards, 0.2, 0.8)),
    }
    out = None
    for name, rows in kinds.items():
        part = rows.agg(F.lit(name).alias("kind"), F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT p_partkey, p_partkey % 2 = 0 AS black, CAST(NULL AS BOOLEAN) AS unknown, [CASE WHEN p_partkey % 3 = 0 THEN 0.0::DOUBLE ELSE (p_partkey % 4) / 4 END, CASE WHEN p_partkey % 3 = 0 THEN 0.0 ELSE 0.5 END, CASE WHEN p_partkey % 3 = 0 THEN 0.0 ELSE (p_partkey % 4 + 1) / 4 END, CASE WHEN p_partkey % 3 = 0 THEN 0.0 ELSE 1.0 END] AS box FROM part""")
def flt15_images(spark, d):
    k = F.col("p_partkey")
    header = F.lit(b"P5\n2 2\n255\n")
    body = F.when(k % 2 == 0, F.unhex(F.lit("00000000"))).otherwise(F.unhex(F.lit("00000001")))
    mask = F.when(k % 3 == 0, F.unhex(F.lit("0000000000000000"))).otherwise(F.unhex(F.concat(F.lit("00000000"), F.when(k % 4 == 0, "01000000").when(k % 4 == 1, "00010000").when(k % 4 == 2, "00000100").otherwise("00000001"))))
    return t(spark, d, "part").select("p_partkey", training.all_black(F.concat(header, body)).alias("black"), training.all_black(F.lit(b"GIF89a")).alias("unknown"), training.mask_box(mask, F.lit(4), F.lit(2)).alias("box"))


@query("""SELECT p_partkey, p_partkey % 2 = 0 AS black, CASE WHEN p_partkey % 2 = 0 THEN [0.0::DOUBLE, 0.0, 0.0, 0.0] ELSE [(p_partkey % 7) / 8, (p_partkey % 3) / 4, (p_partkey % 7 + 1) / 8, (p_partkey % 3 + 1) / 4] END AS box, 8 AS width, 4 AS height, true AS damaged FROM part""")
def flt15_decoded_images(spark, d):
    """A PNG of 8 by 4 for each part, black or with one white pixel; and without its last bytes."""
    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    def drawn(keys: pd.Series) -> pd.Series:
        out = []
        for k in keys:
            lines = [bytearray(9) for _ in range(4)]
            if k % 2:
                lines[k % 3][1 + k % 7] = 255
            out.append(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 8, 4, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b""))
        return pd.Series(out)

    x = t(spark, d, "part").select("p_partkey", F.pandas_udf(drawn, "binary")("p_partkey").alias("png"))
    cut = F.expr("substring(png, 1, octet_length(png) - 14)")
    size = images.image_size(F.col("png"))
    return x.select("p_partkey", images.all_black(F.col("png")).alias("black"), images.mask_box(F.col("png")).alias("box"), size["width"].alias("width"), size["height"].alias("height"), images.all_black(cut).isNull().alias("damaged"))


# -- mixing, splits ----------------------------------------------------------------------------

_LANGS = "d AS (SELECT doc_id, CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END AS dataset_index, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 k, count(*) OVER (PARTITION BY lang) n FROM documents WHERE lang IN ('en', 'fr', 'de')), m AS (SELECT dataset_index, max(n) n FROM d GROUP BY 1)"


def languages(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "lang")
    return [docs.where(F.col("lang") == x).select("doc_id") for x in ("en", "fr", "de")]


@query(f"""WITH {_LANGS}, e AS (SELECT min(dataset_index + 3 * (n - 1) + 1) e FROM m) SELECT k * 3 + dataset_index AS position, dataset_index, k AS sample_index, doc_id FROM d, e WHERE k * 3 + dataset_index < e""")
def set03_interleave_under(spark, d):
    return mixing.mix(languages(spark, d), "doc_id", "interleave_under").select("position", "dataset_index", "sample_index", "doc_id")


@query(f"""WITH {_LANGS}, s AS (SELECT p AS position, CAST(p % 3 AS INT) AS dataset_index, p // 3 AS k FROM range((SELECT max(n) * 3 FROM m)) r(p)) SELECT position, s.dataset_index, s.k % m.n AS sample_index, doc_id FROM s JOIN m ON m.dataset_index = s.dataset_index JOIN d ON d.dataset_index = s.dataset_index AND d.k = s.k % m.n""")
def set04_interleave_over(spark, d):
    return mixing.mix(languages(spark, d), "doc_id", "interleave_over").select("position", "dataset_index", "sample_index", "doc_id")


@query(f"""WITH {_LANGS} SELECT dataset_index, true AS in_order, true AS some, true AS no_more FROM m""")
def set03_interleave_weighted(spark, d):
    data = languages(spark, d)
    sizes = [x.count() for x in data]
    y = settle(mixing.mix(data, "doc_id", "interleave_under", [0.5, 0.3, 0.2]).select("position", "dataset_index", "sample_index", "doc_id"), "mixed")
    own = y.groupBy("dataset_index").agg(F.count("*").alias("n"), F.max("sample_index").alias("m"), F.count_distinct("sample_index").alias("u"))
    size = F.element_at(F.array(*map(F.lit, sizes)), F.col("dataset_index") + 1)
    return own.select("dataset_index", (F.col("n") == F.col("u")).alias("in_order"), (F.col("n") > 0).alias("some"), (F.col("m") < size).alias("no_more"))


@query(f"""WITH {_LANGS}, w AS (SELECT dataset_index, CASE dataset_index WHEN 0 THEN 9 WHEN 1 THEN 5 ELSE 3 END s FROM m), p AS (SELECT doc_id, d.dataset_index, k AS sample_index, row_number() OVER (ORDER BY (k + 0.5::DOUBLE) / s, d.dataset_index) - 1 AS position FROM d JOIN w USING (dataset_index) WHERE k < s)
SELECT position, dataset_index, sample_index, doc_id FROM p""")
def set06_exhaustive(spark, d):
    return mixing.blend_exhaustive(languages(spark, d), [9, 5, 3], "doc_id").select("position", "dataset_index", "sample_index", "doc_id")


@query("""SELECT c_custkey + CASE WHEN c_mktsegment IS NULL THEN 0 ELSE 0 END AS key, 'a' AS prefix FROM customer UNION ALL SELECT s_suppkey + (SELECT max(c_custkey) + 1 FROM customer), 'b' FROM supplier""")
def set11_merge_indexed(spark, d):
    return mixing.merge_indexed({"b": t(spark, d, "supplier").select(F.col("s_suppkey").alias("key")), "a": t(spark, d, "customer").select(F.col("c_custkey").alias("key"))}, "key")


@query("""SELECT 'shards' AS kind, doc_id AS id FROM documents UNION ALL SELECT 'common', l_partkey FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_linenumber = 1 INTERSECT SELECT DISTINCT l_partkey FROM lineitem WHERE l_linenumber = 7)""")
def set12_merges(spark, d):
    docs, x = t(spark, d, "documents").select("doc_id"), t(spark, d, "lineitem")
    one = mixing.merge_shards([docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")], "doc_id").select(F.lit("shards").alias("kind"), F.col("doc_id").alias("id"))
    return one.unionByName(mixing.common_names(x.where("l_linenumber = 1"), x.where("l_linenumber = 7"), "l_partkey").select(F.lit("common").alias("kind"), F.col("l_partkey").alias("id")))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS file, list_sort(list_filter(u.u, lambda x: NOT list_contains(string_split(p_name, ' '), x))) AS missing FROM part, (SELECT list_sort(list_distinct(flatten(list(string_split(p_name, ' '))))) u FROM part) u""")
def set14_missing_columns(spark, d):
    x = t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("file"), F.split("p_name", " ").alias("columns"))
    return mixing.missing_columns(x).select("file", F.array_sort("missing").alias("missing"))


# -- packing -----------------------------------------------------------------------------------


@query("""SELECT len(regexp_split_to_array(text, '\\s+')) AS length, count(*) AS items FROM documents WHERE text IS NOT NULL GROUP BY 1""")
def pck01_buckets(spark, d):
    x = t(spark, d, "documents").where("text IS NOT NULL").select(F.size(F.split("text", r"\s+")).cast("long").alias("length"))
    return packing.buckets(x, "length")


def _items(spark, d):
    return t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.size(F.split("text", r"\s+")).cast("long").alias("length"))


@query("""SELECT count(*) AS items, 0 AS overfull, 0 AS sparse, 0 AS twice, true AS some, 0 AS gaps, 0 AS unpacked_in_boxes FROM documents WHERE text IS NOT NULL""")
def pck03_seeded_rounds(spark, d):
    items = _items(spark, d)
    packed = settle(mixing.pack_seeded(items, "doc_id", "length", 4096), "packed")
    boxes = packed.where("box_id IS NOT NULL").groupBy("box_id").agg(F.sum("length").alias("n"), F.count("*").alias("k"), F.max("slot").alias("s"))
    rest = mixing.unpacked(items, packed, "doc_id")
    return (
        packed.agg(F.count("*").alias("items"), (F.count("*") - F.count_distinct("doc_id")).cast("int").alias("twice"), (F.count("box_id") > 0).alias("some"))
        .join(F.broadcast(boxes.agg(F.count_if(F.col("n") > 4096).cast("int").alias("overfull"), F.count_if(F.col("n") < 0.9 * 4096).cast("int").alias("sparse"), F.count_if(F.col("s") + 1 != F.col("k")).cast("int").alias("gaps"))))
        .join(F.broadcast(rest.join(packed.where("box_id IS NOT NULL"), "doc_id", "left_semi").agg(F.count("*").cast("int").alias("unpacked_in_boxes"))))
    )


#: SQL of one round of boxes, an item at a time: c counts what is left of each length, i is the seed's place, box the box so far, done a box that was kept.
BOXES_SQL = """
WITH RECURSIVE n AS (SELECT len(regexp_split_to_array(text, '\\s+')) AS l, count(*) AS k FROM documents WHERE text IS NOT NULL GROUP BY 1),
h AS (SELECT list(l ORDER BY l) AS ls, list(k ORDER BY l) AS ks FROM n WHERE l <= 4096),
z AS ({seeds}),
s AS (
  SELECT ks AS c, 1 AS i, CAST([] AS BIGINT[]) AS box, CAST(NULL AS BIGINT[]) AS done FROM h
  UNION ALL
  SELECT
    CASE WHEN a IS NOT NULL THEN list_transform(c, lambda x, j: x - (ls[j] = a)::INT)
      WHEN box <> [] AND NOT good THEN list_transform(c, lambda x, j: x + len(list_filter(box, lambda y: y = ls[j]))) ELSE c END,
    CASE WHEN a IS NULL AND NOT (box <> [] AND good) THEN i + 1 ELSE i END,
    CASE WHEN a IS NOT NULL THEN list_append(box, a) ELSE [] END,
    CASE WHEN a IS NULL AND box <> [] AND good THEN list_reverse_sort(box) END
  FROM (
    SELECT c, i, box, ls, len(box) >= {items} AND list_sum(box) >= {ratio} * 4096 AS good,
      CASE WHEN box = [] THEN CASE WHEN c[list_position(ls, zs[i])] > 0 THEN zs[i] END
        ELSE list_max(list_filter(ls, lambda x, j: c[j] > 0 AND x <= 4096 - coalesce(list_sum(box), 0))) END AS a
    FROM s, h, z WHERE i <= len(zs)))
SELECT array_to_string(done, '+') AS box, count(*) AS boxes FROM s WHERE done IS NOT NULL GROUP BY 1
"""


def _boxes(spark, d, seeds, min_items, min_ratio):
    """(box, boxes): the lengths of the boxes that documents are packed into, and how many boxes have them."""
    packed = mixing.pack_seeded(_items(spark, d), "doc_id", "length", 4096, lambda counts: mixing.seeded_boxes(counts, 4096, seeds(counts), min_items, min_ratio)[0])
    boxes = packed.where("box_id IS NOT NULL").groupBy("box_id").agg(F.reverse(F.array_sort(F.collect_list("length"))).alias("box"))  # a box has capacity rows at most
    return boxes.groupBy(F.array_join(F.col("box").cast("array<string>"), "+").alias("box")).agg(F.count("*").alias("boxes"))


@query(BOXES_SQL.format(seeds="SELECT list(l ORDER BY l DESC) AS zs FROM n WHERE l BETWEEN 300 AND 4096", items=2, ratio=0.95))
def pck03_half_boxes(spark, d):
    return _boxes(spark, d, lambda counts: mixing.seeds_half(counts, 300), 2, 0.95)


@query(BOXES_SQL.format(seeds="SELECT list(l ORDER BY l DESC) AS zs FROM (SELECT l FROM n WHERE l <= 4096 ORDER BY k DESC, l DESC LIMIT 20)", items=4, ratio=0.9))
def pck04_top_boxes(spark, d):
    return _boxes(spark, d, lambda counts: mixing.seeds_top(counts, 20), 4, 0.9)


@query("""WITH r AS (SELECT doc_id, len(regexp_split_to_array(text, '\\s+')) l, (row_number() OVER (ORDER BY doc_id) - 1) // 100 b FROM documents WHERE text IS NOT NULL AND len(regexp_split_to_array(text, '\\s+')) <= 4096) SELECT b AS batch, count(*) AS items, CAST(sum(l) AS BIGINT) AS tokens, 0 AS overfull, true AS near FROM r GROUP BY 1""")
def pck09_batches(spark, d):
    y = settle(mixing.pack_batches(_items(spark, d), "doc_id", "length", 4096, 100), "batches")
    boxes = y.groupBy("batch", "box").agg(F.sum("length").alias("n"), F.count("*").alias("k"))
    return boxes.groupBy("batch").agg(F.sum("k").alias("items"), F.sum("n").alias("tokens"), F.count_if(F.col("n") > 4096).cast("int").alias("overfull"), (F.count("*") <= 2 * F.ceil(F.sum("n") / 4096)).alias("near"))


@query("""SELECT l_orderkey AS box_id, list('i' || l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS images, list('p' ORDER BY l_linenumber) AS prompts, list(l_suppkey::VARCHAR ORDER BY l_linenumber, l_partkey, l_suppkey) AS captions FROM lineitem GROUP BY 1""")
def pck08_packed_samples(spark, d):
    from pyspark.sql import Window

    x = t(spark, d, "lineitem")
    slot = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    rows = x.select(F.col("l_orderkey").alias("box_id"), slot.alias("slot"), "l_partkey", "l_suppkey").withColumn("k", F.struct("box_id", "slot"))
    samples = rows.select("k", F.concat(F.lit("i"), F.col("l_partkey").cast("string")).alias("i"), F.lit("p").alias("p"), F.col("l_suppkey").cast("string").alias("c"))
    return mixing.packed_samples(rows.select("box_id", "slot", "k"), samples, "k", "i", "p", "c")


# -- retrieval ---------------------------------------------------------------------------------


@query(f"""WITH d AS ({_TOKENS}), c AS (SELECT doc_id, unnest(range(0, len(a), 64)) s, a FROM d) SELECT doc_id, CAST(s // 64 AS INT) AS chunk, {_md5('list_concat(a[s + 1:s + 64], list_transform(range(64 - len(a[s + 1:s + 64])), lambda i: 0))')} AS tokens FROM c""")
def rtr01_padded_chunks(spark, d):
    return ordering.fixed_chunks(tokens(spark, d), "doc_id", "a", 64, 0).select("doc_id", "chunk", joined("tokens").alias("tokens"))


@query("""SELECT low, least(low + 100, n) AS high FROM (SELECT count(*) n FROM embeddings) c, range(0, 100000000, 100) r(low) WHERE low < n""")
def rtr02_block_ranges(spark, d):
    n = t(spark, d, "embeddings").count()
    return spark.createDataFrame(retrieval.block_ranges(n, 100), "low long, high long")


_TOP = """(SELECT q.vec_id AS query_id, i.vec_id AS item_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[])) DESC, i.vec_id) AS rank FROM embeddings q, embeddings i WHERE q.vec_id % 20 = 0)"""


@query(f"SELECT query_id, item_id, CAST(rank AS INT) AS rank FROM {_TOP} WHERE rank <= 5")
def rtr03_cells(spark, d):
    """All cells are probed here, so that the search is exact."""
    e = t(spark, d, "embeddings")
    centres = retrieval.train_cells(e, 8)
    index = retrieval.add_to_cells(e, centres)
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.search_cells(q, index, centres, 5, len(centres)).select("query_id", "item_id", "rank")


@query(f"SELECT query_id, item_id, CAST(rank AS INT) AS rank FROM {_TOP} WHERE rank <= 5")
def rtr04_compressed_lists(spark, d):
    """All cells are probed, so the compressed lists and their bounds have to give what a full search gives."""
    e = t(spark, d, "embeddings")
    index = inverted.train(e, 8, parts=4, rounds=3)
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return inverted.search(q, inverted.build(e, index), e, index, 5, len(index.cells)).select("query_id", "item_id", "rank")


@query(f"""WITH t AS (SELECT query_id AS id, item_id, rank FROM {_TOP} WHERE rank <= 2), c AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 k, count(*) OVER () n FROM embeddings), k AS (SELECT id, rank, c.k, c.n FROM t JOIN c ON t.item_id = c.vec_id)
SELECT id, list(['v' || k, 'v' || (k + 1) % n] ORDER BY rank) AS neighbours FROM k GROUP BY id""")
def rtr08_neighbours(spark, d):
    from corpusloom.operators.storage import ranked

    e = t(spark, d, "embeddings")
    found = retrieval.top_k(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("item_id"), "embedding"), 2)
    numbers = ranked(e.select("vec_id"), "vec_id", name="chunk_id")
    near = found.join(numbers, found["item_id"] == numbers["vec_id"]).select(F.col("query_id").alias("id"), "rank", "chunk_id")
    chunks = numbers.select("chunk_id", F.array(F.concat(F.lit("v"), F.col("chunk_id").cast("string"))).alias("tokens"))
    return retrieval.attached(near, chunks, "tokens", 1)


@query(r"""WITH b AS (SELECT list_transform(list_filter(regexp_split_to_array(text, '[^a-zA-Z0-9]+'), lambda x: x <> ''), lambda x: lower(x)) a FROM benchmark),
g AS (SELECT DISTINCT array_to_string(a[i:i+12], ' ') g FROM (SELECT a, unnest(range(1, greatest(len(a) - 11, 1))) i FROM b)),
d AS (SELECT doc_id, text, regexp_extract_all(text, '[a-zA-Z0-9]+') w, regexp_split_to_array(text, '[a-zA-Z0-9]+') p FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, i, lower(w[i]) w, length(p[i]) gap, length(w[i]) len FROM (SELECT doc_id, w, p, unnest(range(1, len(w) + 1)) i FROM d)),
s AS (SELECT doc_id, i, w, len, sum(gap + len) OVER (PARTITION BY doc_id ORDER BY i) - len AS start FROM u),
k AS (SELECT doc_id, i, start, lead(start + len, 12) OVER o AS stop, array_to_string([w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o, lead(w, 5) OVER o, lead(w, 6) OVER o, lead(w, 7) OVER o, lead(w, 8) OVER o, lead(w, 9) OVER o, lead(w, 10) OVER o, lead(w, 11) OVER o, lead(w, 12) OVER o], ' ') g
  FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
h AS (SELECT doc_id, greatest(0, start - 200) lo, least(length(text), stop + 200) hi, length(text) n FROM k SEMI JOIN g USING (g) JOIN documents USING (doc_id) WHERE stop IS NOT NULL),
m AS (SELECT doc_id, lo, hi, n, max(hi) OVER (PARTITION BY doc_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) before FROM h),
r AS (SELECT doc_id, coalesce(before, 0) AS x, lo AS y FROM m WHERE lo > coalesce(before, 0) UNION ALL SELECT doc_id, max(hi), max(n) FROM m GROUP BY doc_id HAVING max(hi) < max(n)),
c AS (SELECT doc_id, x, y, count(*) OVER (PARTITION BY doc_id) pieces FROM r),
z AS (SELECT c.doc_id, row_number() OVER (PARTITION BY c.doc_id ORDER BY x) - 1 AS piece, text[x + 1:y] AS text FROM c JOIN documents USING (doc_id) WHERE pieces <= 11 AND y - x >= 200)
SELECT doc_id, CAST(piece AS INT) AS piece, md5(text) AS digest FROM z UNION ALL SELECT doc_id, 0, md5(text) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM h)""")
def ddp06_decontaminate(spark, d):
    out = dedup.decontaminate(t(spark, d, "documents"), t(spark, d, "benchmark"))
    return out.select("doc_id", "piece", F.md5("text").alias("digest"))
