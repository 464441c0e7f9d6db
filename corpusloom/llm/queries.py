"""Queries opN_<name> of the subpackage, over whole tables; __spark_entry__ adds them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import baskets, bpe, jpeg, language, licenses, minhash, packing, periods, personal, quality, substrings, vectors, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_vocabulary() -> str:
    """Where the installed package of public tokenizers has its word-final BPE vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def piece_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), word_vocabulary(), 4096)


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), word_vocabulary(), keep=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), 3, 85).select("doc_id", "n_shingles", "component_id", "kept")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return language.predict(documents, language.train(documents, piece_vocabulary()))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.digest(personal.detect(table(spark, sf_dir, "documents")))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), 0.9)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove(table(spark, sf_dir, "documents"), 13, texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.digest(jpeg.store(table(spark, sf_dir, "documents")))


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    said = F.expr("array_join(transform(matches, x -> concat_ws(':', x.license, x.start, x.end, concat(x.matched, '/', x.words))), ',')")
    return found.select("doc_id", F.size("matches").cast("long").alias("n_licenses"), said.alias("licenses"))


def second_replica(pages: DataFrame) -> DataFrame:
    """A replica with planted faults: in some records the first byte is another one, some are lost."""
    damaged = F.when(F.col("page_id") % 97 == 13, F.concat(F.lit("#"), F.substring(F.coalesce("html", F.lit("")), 2, 1 << 30))).otherwise(F.col("html"))
    return pages.where("page_id IS NULL OR page_id % 389 != 7").withColumn("html", damaged)


def op10_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return warc.audit(pages, second_replica(pages))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.collapse(table(spark, sf_dir, "documents"), plant=True)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op13_basket_itemsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "sale_lines").where(~F.col("flag").eqNullSafe("returned"))
    return baskets.frequent_sets(lines)


OP10_SQL = r"""
WITH r AS (SELECT page_id, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
    || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
    || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS t
  FROM pages)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS n_bytes, sha256(t) AS record_sha256,
  CAST(sum(strlen(t)) OVER (ORDER BY page_id) - strlen(t) AS BIGINT) AS "offset",
  CASE WHEN page_id % 389 = 7 THEN 'missing' WHEN page_id % 97 = 13 THEN 'corrupt' ELSE 'ok' END AS status
FROM r"""


#: SQL of components: the least id that each of `nodes` (id) reaches over `links` (a, b), both ways.
REACHED = """up AS (SELECT id, id AS r FROM nodes UNION SELECT links.a, up.r FROM up JOIN links ON links.b = up.id), least AS (SELECT id, min(r) AS component_id FROM up GROUP BY id)"""

OP3_SQL = (
    r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
nodes AS (SELECT doc_id AS id FROM documents), """
    + REACHED
    + """
SELECT id AS doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, id = component_id AS kept FROM least LEFT JOIN n ON n.doc_id = id
"""
)

OP6_SQL = (
    """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM v WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(v, v) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.vec_id <> y.vec_id AND list_dot_product(x.v, y.v) >= 0.9),
nodes AS (SELECT vec_id AS id FROM embeddings), """
    + REACHED
    + """
SELECT id AS vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, id = component_id AS kept FROM least LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) ON a = id
"""
)

OP7_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS g FROM w WHERE len(w) > 12),
m AS (SELECT g, min(doc_id) AS d FROM g GROUP BY g),
c AS (SELECT DISTINCT doc_id, i + k AS i FROM g JOIN m USING (g), (SELECT unnest(range(0, 13)) AS k) WHERE d < doc_id),
x AS (SELECT doc_id, unnest(w) AS v, unnest(range(1, len(w) + 1)) AS i FROM w),
k AS (SELECT doc_id, string_agg(v, ' ' ORDER BY i) AS kept, count(*) AS n FROM x ANTI JOIN c USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""

#: crc32 bit by bit: each byte of the id comes in at every eighth step.
OP11_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: list_concat([ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT], [0, 0, 0, 0, 0, 0, 0]::BIGINT[])))),
      lambda c, e: CASE WHEN xor(c, e) & 1 = 1 THEN xor(xor(c, e) >> 1, 3988292384) ELSE xor(c, e) >> 1 END), 4294967295) AS h FROM documents),
e AS (SELECT doc_id, w, len(w) AS n, h, h // 10 AS g FROM d),
p AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM e),
t AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) ELSE w END AS w FROM p),
x AS (SELECT doc_id, n, unnest(w) AS w, unnest(range(0, n)) AS i FROM t),
y AS (SELECT a.doc_id, b.i - a.i AS q, a.i FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.w = b.w AND b.i > a.i AND b.i <= a.i + a.n // 4),
z AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM y),
l AS (SELECT doc_id, min(i) AS s, max(i) + 1 + q AS e, q FROM z GROUP BY doc_id, q, k HAVING count(*) >= greatest(6 - q, 3 * q)),
r AS (SELECT doc_id, s, e, min(q) AS q FROM l GROUP BY doc_id, s, e),
b AS (SELECT doc_id, count(*) AS m, min(struct_pack(l := s - e, s := s, q := q)) AS best, string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' ORDER BY s, q) AS said, list(struct_pack(f := s + q, e := e)) AS gone FROM r GROUP BY doc_id)
SELECT t.doc_id, CAST(coalesce(m, 0) AS BIGINT) AS n_runs, CAST(best.s AS BIGINT) AS "start", CAST(-best.l AS BIGINT) AS length, CAST(best.q AS BIGINT) AS period, CAST(1000 * -best.l // best.q AS BIGINT) AS exponent_milli, sha256(coalesce(said, '')) AS runs_sha256,
  sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda v, j: len(list_filter(gone, lambda x: j > x.f AND j <= x.e)) = 0) END, ' '), '')) AS collapsed_sha256
FROM t LEFT JOIN b ON b.doc_id = t.doc_id
"""

OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) > 2),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g), (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY doc_id),
l AS (SELECT doc_id, host, unnest(string_split(t, chr(10))) AS l FROM d),
m AS (SELECT doc_id, host, lower(regexp_replace(l, '[\x20\x09\x0B-\x0D.,;:!?]', '', 'g')) AS l, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS k FROM l),
h AS (SELECT host, count(*) AS n FROM d GROUP BY host),
f AS (SELECT m.host, l FROM m JOIN h USING (host) WHERE l <> '' GROUP BY m.host, l, h.n HAVING count(DISTINCT doc_id) > 10 AND count(DISTINCT doc_id) > h.n * 0.001),
v AS (SELECT doc_id, sum(k) AS n FROM m JOIN f USING (host, l) GROUP BY doc_id),
o AS (SELECT d.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w.w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(v.n, 0) AS BIGINT) AS n_removed
  FROM d JOIN w USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN v USING (doc_id)),
q AS (SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_removed FROM o)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * (n_words - n_removed) >= 50 * n_words AS kept, n_removed FROM q
"""

OP13_SQL = r"""
WITH RECURSIVE b AS (SELECT DISTINCT sale_id, item_id FROM sale_lines WHERE flag IS DISTINCT FROM 'returned' AND sale_id IS NOT NULL AND item_id IS NOT NULL),
k AS (SELECT count(DISTINCT sale_id) AS n FROM b),
f AS (SELECT item_id, count(*) AS s FROM b GROUP BY item_id HAVING count(*) >= 12 AND count(*) * 10000 >= (SELECT n FROM k)),
r AS (SELECT b.sale_id, b.item_id FROM b JOIN f USING (item_id)),
g AS (
  SELECT [item_id] AS x, item_id AS last, sale_id FROM r
  UNION ALL
  SELECT x, last, sale_id FROM (
    SELECT list_append(g.x, r.item_id) AS x, r.item_id AS last, g.sale_id, count(*) OVER (PARTITION BY list_append(g.x, r.item_id)) AS n
    FROM g JOIN r ON r.sale_id = g.sale_id AND r.item_id > g.last) WHERE n >= 12 AND n * 10000 >= (SELECT n FROM k)),
sets AS (SELECT x, count(*) AS s FROM g GROUP BY x),
taken AS (SELECT x AS y, s, unnest(x) AS c FROM sets),
less AS (SELECT list_filter(y, lambda e: e <> c) AS x, c, y, s FROM taken WHERE len(y) > 1),
closed AS (SELECT x, s FROM sets WHERE NOT EXISTS (SELECT 1 FROM less WHERE less.x = sets.x AND less.s = sets.s)),
rule AS (SELECT less.y, less.c, a.s AS a, f.s FROM less JOIN sets a ON a.x = less.x JOIN f ON f.item_id = less.c
  WHERE 100 * less.s >= 30 * a.s AND CAST(less.s AS HUGEINT) * (SELECT n FROM k) > CAST(a.s AS HUGEINT) * f.s)
SELECT array_to_string(closed.x, ',') AS items, CAST(len(closed.x) AS BIGINT) AS n_items, CAST(any_value(closed.s) AS BIGINT) AS support, CAST(count(c) AS BIGINT) AS n_rules,
  min_by(c, (a, c)) AS best_item, sha256(coalesce(string_agg(c || ':' || a || ':' || rule.s, ';' ORDER BY c), '')) AS rules_sha256
FROM closed LEFT JOIN rule ON rule.y = closed.x GROUP BY closed.x
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op3_minhash_near_dedup": OP3_SQL, "op6_embedding_near_dedup": OP6_SQL, "op7_substring_dedup": OP7_SQL, "op10_warc_audit": OP10_SQL, "op11_periodic_runs": OP11_SQL, "op12_quality_rules": OP12_SQL, "op13_basket_itemsets": OP13_SQL}
