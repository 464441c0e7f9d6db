"""Queries over the driver's tables, one for each operator family, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import scoring as S
from corpusloom.functions import text as T
from corpusloom.operators import cleaning, conversations, dedup, grouping, mixing, ordering, packing, retrieval
from corpusloom.operators.cleaning import REFUSALS, SECOND_LABELS, SKIPPED_SUFFIXES, WELL_FORMED
from corpusloom.operators.storage import settle
from corpusloom.plans.register import ORACLES, QUERIES, query, t
from corpusloom.streaming import iterate

__all__ = ["ORACLES", "QUERIES"]


def listed(values) -> str:
    """Texts as a SQL list."""
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# -- scans, filters, projections ---------------------------------------------------------------


BLOCKED = ("blocked", "spam", "site1")


def url_reasons(pages: str) -> str:
    """SQL of the reason of each row of `pages`, a query that gives page_id and url."""
    return f"""WITH p AS ({pages}),
h AS (SELECT page_id, url, list_reverse(string_split(lower(regexp_extract(url, '^[a-zA-Z]+://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '.')) a, lower(string_split(url, '?')[1]) path FROM p),
q AS (SELECT *, coalesce(a[CASE WHEN len(a) > 2 AND length(a[1]) = 2 AND a[2] IN ({listed(SECOND_LABELS)}) THEN 3 ELSE 2 END], '') lab FROM h),
m AS (SELECT page_id, url, CASE WHEN lab IN ({listed(BLOCKED)}) THEN 'domain' WHEN len(list_filter([{listed(SKIPPED_SUFFIXES)}], lambda s: ends_with(path, s))) > 0 THEN 'extension'
  WHEN length(url) <= 8 THEN 'short' WHEN NOT regexp_matches(url, '{WELL_FORMED}') THEN 'malformed' END f FROM q)
SELECT page_id, coalesce(f, CASE WHEN row_number() OVER (PARTITION BY url, f IS NULL ORDER BY page_id) > 1 THEN 'duplicate' END, 'keep') AS reason FROM m"""


#: SQL: hosts under suffixes of one and two labels, of a wildcard and an exception, of no rule; and an address.
_HOSTS = """SELECT page_id, page_id % 7 AS k, 'site' || page_id AS s FROM pages"""


@query(f"""SELECT page_id, CASE k WHEN 0 THEN s WHEN 1 THEN s WHEN 2 THEN s WHEN 3 THEN 'city' WHEN 4 THEN 'www' WHEN 5 THEN 'zzz' ELSE '10.0.0.7' END AS label,
  CASE k WHEN 0 THEN 'com' WHEN 1 THEN 'co.uk' WHEN 2 THEN 'any.kawasaki.jp' WHEN 3 THEN 'kawasaki.jp' WHEN 4 THEN 'ck' ELSE '' END AS suffix, k = 1 AS british FROM ({_HOSTS})""")
def flt01_public_suffixes(spark, d):
    site = F.concat(F.lit("site"), F.col("page_id").cast("string"))
    k = F.col("page_id") % 7
    name = F.when(k == 0, F.concat(F.lit("a.b."), site, F.lit(".com"))).when(k == 1, F.concat(F.lit("www."), site, F.lit(".co.uk"))).when(k == 2, F.concat(site, F.lit(".any.kawasaki.jp")))
    name = name.when(k == 3, F.concat(site, F.lit(".city.kawasaki.jp"))).when(k == 4, F.concat(site, F.lit(".www.ck"))).when(k == 5, F.concat(site, F.lit(".zzz"))).otherwise("10.0.0.7")
    x = t(spark, d, "pages").select("page_id", F.concat(F.lit("https://"), name, F.lit("/p")).alias("url"))
    said = cleaning.registered_domain(F.col("url"))
    return x.select("page_id", said["label"].alias("label"), said["suffix"].alias("suffix"), (said["suffix"] == "co.uk").alias("british"))


@query(url_reasons("SELECT page_id, coalesce(url, '') url FROM pages"))
def flt05_classify_urls(spark, d):
    return cleaning.classify_urls(t(spark, d, "pages"), list(BLOCKED)).select("page_id", "reason")


SOME_SUFFIXES = (*SKIPPED_SUFFIXES, "", "/", ".html", ".7z", ".ai", ".tif")
SOME_SCHEMES = ("http://", "https://", "ftp://", "HTTPS://", "http:/")
SOME_HOSTS = ("www.example.com", "localhost", "10.2.3.4:8080", "blocked.co.uk", "shop.blocked.com", "a-.com", "x.y")


@query(url_reasons(f"""SELECT o_orderkey AS page_id, [{listed(SOME_SCHEMES)}][1 + CAST(o_custkey % {len(SOME_SCHEMES)} AS INT)] || [{listed(SOME_HOSTS)}][1 + CAST(o_orderkey % {len(SOME_HOSTS)} AS INT)] || '/f'
 || [{listed(SOME_SUFFIXES)}][1 + CAST(o_orderkey % {len(SOME_SUFFIXES)} AS INT)] || CASE WHEN o_orderkey % 3 = 0 THEN '?q=.pdf' ELSE '' END AS url FROM orders"""))
def flt02_suffixes_and_forms(spark, d):
    """Every listed suffix, well-formed or not, on hosts of many forms."""

    def pick(values, c):
        return F.element_at(F.array(*map(F.lit, values)), (c % len(values)).cast("int") + 1)

    url = F.concat(pick(SOME_SCHEMES, F.col("o_custkey")), pick(SOME_HOSTS, F.col("o_orderkey")), F.lit("/f"), pick(SOME_SUFFIXES, F.col("o_orderkey")), F.when(F.col("o_orderkey") % 3 == 0, "?q=.pdf").otherwise(""))
    rows = t(spark, d, "orders").select(F.col("o_orderkey").alias("page_id"), url.alias("url"))
    return cleaning.classify_urls(rows, list(BLOCKED)).select("page_id", "reason")


@query("""SELECT doc_id, length(text) < 1024 AND len(regexp_split_to_array(trim(text), '\\s+')) < 128 AS too_short,
CASE WHEN text IS NULL THEN 'error' WHEN length(text) < 512 THEN 'remove_512' WHEN length(text) < 256 AND lower(text) LIKE '%javascript%' THEN 'remove_256_javascript'
 WHEN length(text) < 512 AND lang IS DISTINCT FROM 'en' THEN 'remove_512_non_english' ELSE 'ftfy_fix_text' END AS task,
CASE WHEN text IS NULL THEN 'error' WHEN length(text) < 256 AND lower(text) LIKE '%javascript%' THEN 'remove_256_javascript' ELSE 'general_cleaning' END AS second,
CASE WHEN text IS NULL THEN 'error' WHEN length(text) < 512 AND lang IS DISTINCT FROM 'en' THEN 'remove_512_non_english' END AS third, lang IS DISTINCT FROM 'en' AS foreign FROM documents""")
def flt06_length_filters(spark, d):
    text, lang = F.col("text"), F.col("lang")
    return t(spark, d, "documents").select("doc_id", cleaning.too_short(text).alias("too_short"), cleaning.removal_task(text, lang).alias("task"),
        cleaning.removal_task(text, lang, ("remove_256_javascript", "general_cleaning")).alias("second"), cleaning.removal_task(text, lang, ("remove_512_non_english",)).alias("third"), cleaning.wrong_language(lang).alias("foreign"))


@query("""SELECT doc_id, md5(regexp_replace(text, '  +|([\\pL\\pN_])\\n+ |([\\pL\\pN_])\\n+', '\\1\\2 ', 'g')) AS cleaned,
md5(replace(replace(replace(regexp_replace(replace(text, chr(10), ' '), ' +', ' ', 'g'), ' . ', '. '), ' . ', '. '), ' . ', '. ')) AS clean2 FROM documents""")
def str01_general_cleaning(spark, d):
    return t(spark, d, "documents").select("doc_id", F.md5(cleaning.general_cleaning(F.col("text"))).alias("cleaned"), F.md5(cleaning.clean_text(F.col("text"))).alias("clean2"))


_CAPTIONS = f"""WITH x AS (SELECT text FROM conversations UNION ALL SELECT CASE WHEN l_quantity < 10 THEN repeat('word ', CAST(l_quantity AS INT)) || 'end of a caption that is long enough to be kept' ELSE 'I''m Sorry, no caption' END FROM lineitem),
c AS (SELECT row_number() OVER () k, text, list_filter(regexp_split_to_array(lower(trim(text)), '\\s+'), lambda x: x <> '') a FROM x),
w AS (SELECT k, unnest(a) w, generate_subscripts(a, 1) i FROM c),
g AS (SELECT k, w, i - row_number() OVER (PARTITION BY k, w ORDER BY i) g FROM w),
r AS (SELECT k, max(n) n FROM (SELECT k, w, g, count(*) n FROM g GROUP BY ALL) GROUP BY ALL)
SELECT coalesce(CASE WHEN len(list_filter([{listed(REFUSALS)}], lambda p: starts_with(lower(trim(text)), p))) > 0 THEN 'refusal' WHEN r.n >= 8 THEN 'repeat' WHEN length(text) NOT BETWEEN 50 AND 3500 THEN 'length' END, 'keep') AS problem, CAST(count(*) AS BIGINT) AS n
FROM c LEFT JOIN r USING (k) GROUP BY 1"""


@query(_CAPTIONS)
def flt12_caption_problems(spark, d):
    made = t(spark, d, "lineitem").select(F.when(F.col("l_quantity") < 10, F.concat(F.expr("repeat('word ', cast(l_quantity AS int))"), F.lit("end of a caption that is long enough to be kept"))).otherwise("I'm Sorry, no caption").alias("text"))
    x = t(spark, d, "conversations").select("text").unionByName(made)
    return x.select(F.coalesce(cleaning.caption_problem(F.col("text")), F.lit("keep")).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


@query("SELECT doc_id, format('doc-{:010d}', row_number() OVER (ORDER BY doc_id)) AS serial_id FROM documents")
def prj06_serial_ids(spark, d):
    return cleaning.serial_ids(t(spark, d, "documents").select("doc_id"), "doc", "doc_id").select("doc_id", "serial_id")


@query("""SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def scan_pushdown_aggregate(spark, d):
    x = t(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


# -- joins, dedup ------------------------------------------------------------------------------


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def join02_anti(spark, d):
    return dedup.remove_listed(t(spark, d, "documents"), t(spark, d, "labels").where("quality = 0"), "doc_id").select("doc_id", "source")


@query("""SELECT c_custkey, o_orderkey, o_totalprice, n_name, r_name FROM customer LEFT JOIN orders ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def join03_chained(spark, d):
    c, o, n, r = (t(spark, d, x) for x in ("customer", "orders", "nation", "region"))
    return c.join(o, c.c_custkey == o.o_custkey, "left").join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("c_custkey", "o_orderkey", "o_totalprice", "n_name", "r_name")


@query("""WITH c AS (SELECT vec_id, count(*) OVER () n FROM embeddings)
SELECT a.vec_id AS id, k.i AS step, (a.vec_id + k.i) % a.n AS continuation FROM c a, (VALUES (0), (1)) k(i) WHERE (a.vec_id + k.i) % a.n IN (SELECT vec_id FROM c)""")
def join08_continuations(spark, d):
    e = t(spark, d, "embeddings").select("vec_id")
    n = e.count()
    x = e.select(F.col("vec_id").alias("id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("step")).withColumn("continuation", F.pmod(F.col("id") + F.col("step"), F.lit(n)))
    return x.join(e, x["continuation"] == e["vec_id"], "left_semi")


@query("""WITH w AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(text, '[^a-zA-Z0-9]+'), lambda x: x <> ''), lambda x: lower(x)) a FROM documents),
b AS (SELECT list_transform(list_filter(regexp_split_to_array(text, '[^a-zA-Z0-9]+'), lambda x: x <> ''), lambda x: lower(x)) a FROM benchmark),
g AS (SELECT DISTINCT array_to_string(a[i:i+12], ' ') g FROM (SELECT a, unnest(range(1, greatest(len(a) - 11, 1))) i FROM b)),
o AS (SELECT DISTINCT doc_id, array_to_string(a[i:i+12], ' ') g FROM (SELECT doc_id, a, unnest(range(1, greatest(len(a) - 11, 1))) i FROM w))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_shared FROM o SEMI JOIN g USING (g) GROUP BY doc_id""")
def join11_decontamination(spark, d):
    return dedup.contaminated(t(spark, d, "documents"), t(spark, d, "benchmark"))


@query("SELECT min(doc_id) AS doc_id, text_md5, CAST(count(*) AS BIGINT) AS copies FROM (SELECT doc_id, md5(text) text_md5 FROM documents) GROUP BY text_md5")
def ddp01_exact_dedup(spark, d):
    return t(spark, d, "documents").groupBy(F.md5("text").alias("text_md5")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "text_md5", "copies")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_partkey a, -1 - l_suppkey b FROM lineitem),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
c(id, g) AS (SELECT a, a FROM s UNION SELECT s.b, c.g FROM c JOIN s ON s.a = c.id)
SELECT id, min(g) AS group_id FROM c GROUP BY id""")
def ddp03_group_pairs(spark, d):
    x = t(spark, d, "lineitem")  # suppliers are below 0, so that no part has their number; both count from 0
    return dedup.groups(x.select(F.col("l_partkey").alias("src"), (-1 - F.col("l_suppkey")).alias("dst"), F.lit(1.0).alias("similarity")))


def copies(docs: DataFrame) -> DataFrame:
    """Groups of documents with one text."""
    least = docs.groupBy("text").agg(F.min("doc_id").alias("dst"), F.count("*").alias("n")).where("n > 1")
    return dedup.groups(docs.join(least, "text").select(F.col("doc_id").alias("src"), "dst", F.lit(1.0).alias("similarity")))


@query("""SELECT CAST(count(*) AS BIGINT) AS remain, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS remove FROM (SELECT count(*) n FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1)""")
def ddp04_group_statistics(spark, d):
    return dedup.group_statistics(copies(t(spark, d, "documents").select("doc_id", "text")))


@query("""SELECT doc_id, source FROM (SELECT doc_id, source, text, min(doc_id) OVER (PARTITION BY text) least FROM documents) WHERE text IS NULL OR doc_id = least""")
def ddp05_one_per_group(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "source", "text")
    return dedup.remove_listed(docs, dedup.surplus(copies(docs)).withColumnRenamed("id", "doc_id"), "doc_id").select("doc_id", "source")


@query("""SELECT CAST(count(*) FILTER (NOT o) AS BIGINT) AS written, CAST(count(*) FILTER (o) AS BIGINT) AS removed, CAST(coalesce(sum(length(text)) FILTER (o), 0) AS BIGINT) AS removed_chars
FROM (SELECT text, text IS NOT NULL AND doc_id > min(doc_id) OVER (PARTITION BY text) o FROM documents)""")
def agg27_removal_counters(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "text")
    return dedup.removal_counters(docs, dedup.surplus(copies(docs)).withColumnRenamed("id", "doc_id"), "doc_id", "text")


@query("SELECT DISTINCT ON (source, lang) source, lang, doc_id, n_chars FROM documents ORDER BY source, lang, doc_id")
def win03_first_wins(spark, d):
    return ordering.first_wins(t(spark, d, "documents").select("source", "lang", "doc_id", "n_chars"), ["source", "lang"], "doc_id").select("source", "lang", "doc_id", "n_chars")


# -- aggregations ------------------------------------------------------------------------------


@query("SELECT round(avg(m), 9) AS macro_mean FROM (SELECT lang, avg(n_chars) m FROM documents GROUP BY lang)")
def agg04_macro_mean(spark, d):
    return grouping.macro_mean(t(spark, d, "documents"), "lang", "n_chars").select(F.round("macro_mean", 9).alias("macro_mean"))


@query("SELECT o_orderpriority, round(sum(m * n) / sum(n), 6) AS group_mean FROM (SELECT o_orderpriority, o_orderstatus, avg(o_totalprice) m, count(*) n FROM orders GROUP BY 1, 2) GROUP BY 1")
def agg03_group_mean(spark, d):
    x = t(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.avg("o_totalprice").alias("m"), F.count("*").alias("n"))
    return grouping.group_mean(x, ["o_orderpriority"], "m", "n").withColumn("group_mean", F.round("group_mean", 6))


@query("""WITH p AS (SELECT l_returnflag c, l_orderkey q, count(*) n, avg(CAST(l_quantity > 20 AS INT)) a, min(CAST(l_quantity > 20 AS INT)) m FROM lineitem GROUP BY 1, 2)
SELECT c AS l_returnflag, round(avg(a) * 100, 6) AS acc, round(avg(m) * 100, 6) AS acc_plus, round(avg(a) * 100 + avg(m) * 100, 6) AS total FROM p WHERE n = 2 GROUP BY c""")
def agg05_paired_accuracy(spark, d):
    x = t(spark, d, "lineitem").withColumn("s", (F.col("l_quantity") > 20).cast("int"))
    return grouping.paired_accuracy(x, "l_returnflag", "l_orderkey", "s").select("l_returnflag", *[F.round(c, 6).alias(c) for c in ("acc", "acc_plus", "total")])


_BINARY = """WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) tp, count(*) FILTER (quality <> 1 AND toxic = 1) fp,
count(*) FILTER (quality = 1 AND toxic <> 1) fn, count(*) FILTER (quality <> 1 AND toxic <> 1) tn FROM labels),
r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) p, coalesce(tp / nullif(tp + fn, 0), 0) r FROM c)
SELECT round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy, round(p, 9) AS "precision", round(r, 9) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 9) AS f1, round((tp + fn) / (tp + fp + fn + tn), 9) AS yes_ratio FROM r"""


@query(_BINARY)
def agg06_binary_metrics(spark, d):
    x = grouping.binary_metrics(t(spark, d, "labels"), "quality", "toxic")
    return x.select(*[F.round(c, 9).alias(c) for c in x.columns])


@query("""WITH g AS (SELECT l_orderkey, sum(CAST(l_quantity > 5 AS INT)) k, count(*) n FROM lineitem GROUP BY 1)
SELECT round(sum(k) / sum(n), 9) AS row_accuracy, round(avg(CAST(k = n AS INT)), 9) AS group_accuracy FROM g""")
def agg21_all_right(spark, d):
    x = grouping.all_right(t(spark, d, "lineitem").withColumn("ok", F.col("l_quantity") > 5), "l_orderkey", "ok")
    return x.select(*[F.round(c, 9).alias(c) for c in x.columns])


@query("""WITH c AS (SELECT user_id, event_type, count(*) n, min(event_id) s FROM events GROUP BY 1, 2)
SELECT DISTINCT ON (user_id) user_id, event_type AS majority FROM c ORDER BY user_id, n DESC, s""")
def agg18_majority(spark, d):
    return grouping.majority(t(spark, d, "events"), "user_id", "event_type", "event_id")


@query("""WITH r AS (SELECT user_id, value > 60 ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id) i FROM events),
f AS (SELECT user_id, min(CASE WHEN ok THEN i END) f FROM r GROUP BY 1)
SELECT round(avg(CAST(coalesce(f <= 1, false) AS INT)), 9) AS cov_1, round(avg(CAST(coalesce(f <= 2, false) AS INT)), 9) AS cov_2, round(avg(CAST(coalesce(f <= 4, false) AS INT)), 9) AS cov_4, round(avg(CAST(coalesce(f <= 8, false) AS INT)), 9) AS cov_8 FROM f""")
def agg17_coverage(spark, d):
    x = grouping.coverage_at(t(spark, d, "events").withColumn("ok", F.col("value") > 60), "user_id", "ok", "event_id", [1, 2, 4, 8])
    return x.select(*[F.round(c, 9).alias(c) for c in x.columns])


@query("""SELECT 'l_returnflag' AS facet, l_returnflag AS "value", round(avg(CAST(l_quantity > 25 AS INT)), 9) AS accuracy, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY l_returnflag
UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR), round(avg(CAST(l_quantity > 25 AS INT)), 9), CAST(count(*) AS BIGINT) FROM lineitem GROUP BY l_linenumber""")
def agg13_facets(spark, d):
    return grouping.facets(t(spark, d, "lineitem").withColumn("ok", F.col("l_quantity") > 25), ["l_returnflag", "l_linenumber"], "ok").withColumn("accuracy", F.round("accuracy", 9))


@query("""SELECT event_type, round(sum(CASE WHEN s >= 0 THEN s * w END) / sum(CASE WHEN s >= 0 THEN w END), 6) AS weighted_mean, coalesce(min(CASE WHEN s >= 0 THEN s END), -1) AS least
FROM (SELECT event_type, value - 20 s, 1 + user_id % 3 w FROM events) GROUP BY 1""")
def agg15_weighted_known_mean(spark, d):
    x = t(spark, d, "events").select("event_type", (F.col("value") - 20).alias("s"), (1 + F.col("user_id") % 3).alias("w"))
    return grouping.weighted_known_mean(x, ["event_type"], "s", "w").withColumn("weighted_mean", F.round("weighted_mean", 6))


@query("""SELECT round(sum(DISTINCT n_chars) / (count(DISTINCT n_chars) + 1), 6) AS mean, min(n_chars) AS least, max(n_chars) AS most, CAST(count(*) AS BIGINT) AS n FROM documents""")
def agg25_length_statistics(spark, d):
    return grouping.length_statistics(t(spark, d, "documents"), "n_chars").withColumn("mean", F.round("mean", 6))


@query("""WITH c AS (SELECT quality, toxic, count(*) n FROM labels GROUP BY 1, 2), k AS (SELECT DISTINCT quality c FROM c UNION SELECT DISTINCT toxic FROM c)
SELECT k.c AS "class", round(coalesce((SELECT sum(n) FROM c WHERE quality = k.c AND toxic = k.c), 0) / ((SELECT coalesce(sum(n), 0) FROM c WHERE quality = k.c) + (SELECT coalesce(sum(n), 0) FROM c WHERE toxic = k.c) - coalesce((SELECT sum(n) FROM c WHERE quality = k.c AND toxic = k.c), 0)), 9) AS iou,
round(coalesce((SELECT sum(n) FROM c WHERE quality = k.c AND toxic = k.c), 0) / (SELECT sum(n) FROM c WHERE quality = k.c), 9) AS recall FROM k""")
def ext01_confusion(spark, d):
    x = grouping.confusion(t(spark, d, "labels"), "quality", "toxic")
    return x.select("class", F.round("iou", 9).alias("iou"), F.round("recall", 9).alias("recall"))


@query()
def agg12_bootstrap(spark, d):
    return grouping.bootstrap(t(spark, d, "labels"), "quality", "doc_id")


@query("SELECT source, lang, CAST(count(*) AS BIGINT) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ROLLUP (source, lang)")
def agg22_rollup(spark, d):
    return t(spark, d, "documents").rollup("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


# -- windows, sampling, mixing -----------------------------------------------------------------


@query("""SELECT doc_id, CASE WHEN k = 0 THEN source || '.txt' ELSE source || '_' || k || '.txt' END AS unique_name FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 k FROM documents)""")
def win01_collisions(spark, d):
    x = t(spark, d, "documents").select("doc_id", F.concat("source", F.lit(".txt")).alias("name"))
    return ordering.collision_names(x, "name", "doc_id").select("doc_id", "unique_name")


@query("""WITH b AS (SELECT source, doc_id, n_chars n, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) b FROM documents)
SELECT source, doc_id, CAST(b // 4096 AS BIGINT) AS first_sample, CAST(greatest(b + n - 1, b) // 4096 AS BIGINT) AS last_sample, CAST(b % 4096 AS BIGINT) AS "offset" FROM b""")
def win05_sample_cuts(spark, d):
    return ordering.sample_cuts(t(spark, d, "documents"), "doc_id", "n_chars", 4096, "source")


@query("""WITH w AS (SELECT doc_id, string_split(text, ' ') a FROM documents)
SELECT doc_id, CAST(i // 64 AS INT) AS chunk, len(a[i + 1:i + 64]) AS n, md5(array_to_string(a[i + 1:i + 64], ' ')) AS digest FROM w, range(0, 40000, 64) r(i) WHERE i < len(a)""")
def win09_chunks(spark, d):
    x = t(spark, d, "documents").select("doc_id", F.split("text", " ", -1).alias("words"))
    return ordering.fixed_chunks(x, "doc_id", "words", 64).select("doc_id", "chunk", F.size("tokens").cast("long").alias("n"), F.md5(F.array_join("tokens", " ")).alias("digest"))


@query("""SELECT source, doc_id, n_chars, CAST(rank AS INT) AS rank FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) rank FROM documents) WHERE rank <= 5""")
def win04_top_per_group(spark, d):
    return ordering.top_per_group(t(spark, d, "documents").select("source", "doc_id", "n_chars"), "source", "n_chars", "doc_id", 5)


@query()
def smp03_hash_sample(spark, d):
    return ordering.hash_sample(t(spark, d, "documents").select("doc_id", "source"), "doc_id", 25)


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 r, count(*) OVER () n FROM documents)
SELECT doc_id, CASE WHEN r < round_even(0.80 * n, 0) THEN 'train' WHEN r < round_even(0.95 * n, 0) THEN 'valid' ELSE 'test' END AS split FROM r""")
def set10_split(spark, d):
    return mixing.split_exact(t(spark, d, "documents").select("doc_id"), "80,15,5", "doc_id")


@query("SELECT CAST(w AS INT) AS worker, CAST((SELECT count(*) FROM documents) // 4 + CASE WHEN w < (SELECT count(*) FROM documents) % 4 THEN 1 ELSE 0 END AS BIGINT) AS n FROM range(4) r(w)")
def shf02_rank_split(spark, d):
    return ordering.rank_split(t(spark, d, "documents").select("doc_id"), "doc_id", 4, "doc_id").groupBy("worker").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def set01_concat(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return ordering.concat_aligned([c, s])


@query("""WITH RECURSIVE b(step, pick, n0, n1, n2) AS (SELECT -1, -1, 0, 0, 0 UNION ALL
 SELECT step + 1, pick, n0 + (pick = 0)::INT, n1 + (pick = 1)::INT, n2 + (pick = 2)::INT FROM (SELECT step, n0, n1, n2, CASE WHEN e0 >= e1 AND e0 >= e2 THEN 0 WHEN e1 >= e2 THEN 1 ELSE 2 END pick FROM
  (SELECT *, CAST(0.5 AS DOUBLE) * greatest(step + 1, 1) - n0 e0, CAST(0.3 AS DOUBLE) * greatest(step + 1, 1) - n1 e1, CAST(0.2 AS DOUBLE) * greatest(step + 1, 1) - n2 e2 FROM b WHERE step < 99))),
i AS (SELECT step AS position, pick AS dataset_index, CASE pick WHEN 0 THEN n0 WHEN 1 THEN n1 ELSE n2 END - 1 AS sample_index FROM b WHERE step >= 0),
d AS (SELECT doc_id, lang, CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END AS dataset_index, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS sample_index FROM documents WHERE lang IN ('en', 'fr', 'de'))
SELECT CAST(position AS BIGINT) AS position, dataset_index, CAST(sample_index AS BIGINT) AS sample_index, doc_id, lang FROM i JOIN d USING (dataset_index, sample_index)""")
def set05_blend(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "lang")
    return mixing.blend([docs.where(F.col("lang") == x) for x in ("en", "fr", "de")], [0.5, 0.3, 0.2], 100, "doc_id")


# -- conversations, packing, retrieval ---------------------------------------------------------


@query("""WITH m AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) i, count(*) OVER (PARTITION BY conv_id) n, first(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'system' s FROM conversations),
c AS (SELECT conv_id, max(CASE WHEN s AND i = 1 THEN text END) AS system, bool_and(CASE WHEN s AND i = 1 THEN true ELSE role = CASE WHEN (i - CAST(s AS INT)) % 2 = 1 THEN 'user' ELSE 'assistant' END END) ok, max(n - CAST(s AS INT)) k, max(CASE WHEN i = n THEN text END) last FROM m GROUP BY 1)
SELECT conv_id, system, CAST(CASE WHEN ok AND k > 0 AND k % 2 = 0 THEN k - 1 ELSE 0 END AS INT) AS n_prompt, CASE WHEN ok AND k > 0 AND k % 2 = 0 THEN last END AS response, ok AND k > 0 AND k % 2 = 0 AS valid FROM c""")
def arr08_unified(spark, d):
    x = conversations.unified(conversations.gather(t(spark, d, "conversations")))
    return x.select("conv_id", "system", F.size("prompt").alias("n_prompt"), F.try_element_at("response", F.lit(1))["content"].alias("response"), "valid")


@query("SELECT DISTINCT ON (conv_id) conv_id, text AS question FROM conversations WHERE role = 'user' ORDER BY conv_id, turn")
def prj04_first_user(spark, d):
    x = conversations.gather(t(spark, d, "conversations"))
    return x.select("conv_id", conversations.first_user(F.col("messages")).alias("question")).where("question IS NOT NULL")


@query("""SELECT conv_id, array_to_string(list_filter([CASE WHEN bool_or(role IS NULL OR role NOT IN ('system', 'user', 'assistant')) THEN 'unknown role' END, CASE WHEN bool_or(coalesce(length(text), 0) = 0) THEN 'empty content' END, CASE WHEN NOT bool_or(coalesce(role, '') = 'assistant') THEN 'no answer' END], lambda x: x IS NOT NULL), ';') AS errors FROM conversations GROUP BY conv_id""")
def flt24_contract(spark, d):
    x = conversations.gather(t(spark, d, "conversations"))
    return x.select("conv_id", F.array_join(conversations.contract_errors(F.col("messages")), ";").alias("errors"))


@query("""SELECT count(*) AS items, 0 AS overfull, 0 AS sparse, 0 AS twice, true AS some, CAST(sum(CASE WHEN n <= 4096 THEN n END) AS BIGINT) >= 0 AS known FROM (SELECT len(regexp_split_to_array(text, '\\s+')) n FROM documents WHERE text IS NOT NULL)""")
def pck06_rounds(spark, d):
    x = t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.size(F.split("text", r"\s+")).cast("long").alias("length"))
    y = settle(packing.pack(x, "doc_id", "length", 4096), "packed")
    boxes = y.where("box_id IS NOT NULL").groupBy("box_id").agg(F.sum("length").alias("n"))
    totals = boxes.agg(F.count_if(F.col("n") > 4096).cast("int").alias("overfull"), F.count_if(F.col("n") < 0.9 * 4096).cast("int").alias("sparse"))
    whole = packing.box_totals(y, "length").select((F.col("tokens") >= 0).alias("known"))
    return y.agg(F.count("*").alias("items"), (F.count("*") - F.count_distinct("doc_id")).cast("int").alias("twice"), (F.count("box_id") > 0).alias("some")).join(F.broadcast(totals)).join(F.broadcast(whole))  # one row each


@query("""SELECT q.vec_id AS query_id, i.vec_id AS item_id, round(s, 6) AS score, CAST(r AS INT) AS rank FROM (SELECT q.vec_id qv, i.vec_id iv, s, row_number() OVER (PARTITION BY q.vec_id ORDER BY s DESC, i.vec_id) r
 FROM (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q, embeddings i, LATERAL (SELECT list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[])) s)) x JOIN embeddings q ON q.vec_id = qv JOIN embeddings i ON i.vec_id = iv WHERE r <= 10""")
def rtr05_top_k(spark, d):
    e = t(spark, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = retrieval.top_k(q, e.select(F.col("vec_id").alias("item_id"), "embedding"), 10)
    return found.withColumn("score", F.round("score", 6))


@query()
def smp05_k_center(spark, d):
    chosen = retrieval.k_center(t(spark, d, "embeddings"), 8)
    return spark.createDataFrame([(i, x) for i, x in enumerate(chosen)], "step int, vec_id long")


# -- functions ---------------------------------------------------------------------------------


@query()
def str13_normalise(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", T.yes_no(F.col("text")).alias("said"), F.md5(T.squad_normal(F.col("text"))).alias("normal"))


@query()
def sim01_levenshtein(spark, d):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))  # given, for the work grows faster than the bytes by which tasks are joined
    x = t(spark, d, "documents").select("doc_id", F.col("text").alias("a"))
    y = x.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    return x.repartition(n, "doc_id").join(y.repartition(n, "doc_id"), "doc_id").select("doc_id", F.round(1 - S.edit_distance(F.col("a"), F.col("b")) / F.greatest(F.length("a"), F.length("b"), F.lit(1)), 9).alias("similarity"))


@query("""WITH w AS (SELECT doc_id, list_distinct(string_split(lower(text), ' ')) a FROM documents)
SELECT x.doc_id, round(len(list_intersect(x.a, y.a)) / len(list_distinct(list_concat(x.a, y.a))), 9) AS jaccard, round(len(list_intersect(x.a, y.a)) / len(x.a), 9) AS prec FROM w x JOIN w y ON y.doc_id = x.doc_id + 1""")
def sim06_sets(spark, d):
    x = t(spark, d, "documents").select("doc_id", F.array_distinct(F.split(F.lower("text"), " ", -1)).alias("a"))
    y = x.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    return x.join(y, "doc_id").select("doc_id", F.round(S.jaccard(F.col("a"), F.col("b")), 9).alias("jaccard"), F.round(S.set_precision(F.col("a"), F.col("b")), 9).alias("prec"))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_discount * 100 x1, l_tax * 100 y1, l_discount * 100 + l_quantity x2, l_tax * 100 + 20 y2 FROM lineitem),
i AS (SELECT *, greatest(0.0, least(x2, 25.0) - greatest(x1, 5.0)) * greatest(0.0, least(y2, 20.0) - greatest(y1, 2.0)) it FROM b)
SELECT l_orderkey, l_linenumber, round(it / ((x2 - x1) * (y2 - y1) + 20.0 * 18.0 - it), 6) AS iou, (x1 + x2) / 2 BETWEEN 5 AND 25 AND (y1 + y2) / 2 BETWEEN 2 AND 20 AS centre FROM i""")
def geo01_boxes(spark, d):
    a = [F.col("l_discount") * 100, F.col("l_tax") * 100, F.col("l_discount") * 100 + F.col("l_quantity"), F.col("l_tax") * 100 + 20]
    b = [F.lit(5.0), F.lit(2.0), F.lit(25.0), F.lit(20.0)]
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.box_iou(a, b), 6).alias("iou"), S.centre_in_box(a, b).alias("centre"))


@query("""SELECT l_orderkey, l_linenumber, abs(l_extendedprice - 1000 * l_quantity) / abs(1000 * l_quantity) <= 0.05 AS relaxed,
round(greatest(0.0, 1 - abs((l_extendedprice - 1000 * l_quantity) / (1000 * l_quantity))), 9) AS difference FROM lineitem""")
def num01_numbers(spark, d):
    p, q = F.col("l_extendedprice"), 1000 * F.col("l_quantity")
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.relaxed_correct(p.cast("string"), q.cast("string")).alias("relaxed"), F.round(S.relative_difference(p, q), 9).alias("difference"))


@query("""SELECT event_id, md5(concat_ws('||', event_type, CAST(user_id AS VARCHAR), props)) AS request_key, CAST(json_extract(props, '$.k') AS INT) AS k FROM events""")
def hsh02_request_keys(spark, d):
    return t(spark, d, "events").select("event_id", F.md5(F.concat_ws("||", "event_type", F.col("user_id").cast("string"), "props")).alias("request_key"), F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("""SELECT time_bucket(INTERVAL 60 MINUTE, ts) AS window_start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2""")
def ext_tumbling_window(spark, d):
    return iterate.tumbling(t(spark, d, "events")).withColumn("total", F.round("total", 6))


@query("""SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS running, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events""")
def win11_running_sums(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return t(spark, d, "events").select("user_id", "event_id", F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 6).alias("running"), F.lag("event_type").over(w).alias("before"))


# The other catalogs register their queries when they are imported.
from corpusloom.plans import evaluate, samples, scores, stores, texts  # noqa: E402, F401
