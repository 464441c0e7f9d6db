"""Queries of similarities, numbers, geometry and rewards (SIM-*, NUM-*, GEO-*, RWD-*, DAT-01, ARR-01, UDF-05)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import captions
from corpusloom.functions import scoring as S
from corpusloom.functions import similarity as M
from corpusloom.functions import text as T
from corpusloom.functions.symbolic import equal_answers
from corpusloom.plans.register import query, spread, t


@query("""SELECT p_partkey, 1 AS tokens, round(1.0 / (len(string_split(p_name, ' ')) + 1), 9) AS rate, 2 AS swapped, 0 AS equal FROM part""")
def sim02_token_edits(spark, d):
    w = F.split("p_name", " ", -1)
    more, other = F.concat(F.array(F.lit("new")), w), F.concat(w, F.array(F.lit("x"), F.lit("y")))
    back = F.concat(w, F.array(F.lit("y"), F.lit("x")))
    return t(spark, d, "part").select("p_partkey", S.token_edit_distance(w, more).alias("tokens"), F.round(M.mixed_error_rate(w, more), 9).alias("rate"), S.token_edit_distance(other, back).alias("swapped"), S.token_edit_distance(w, w).alias("equal"))


@query("""SELECT doc_id, CAST(n // 7 AS INT) AS edits, CAST(n AS INT) AS removed, round(CASE WHEN n = 0 THEN 0 ELSE (n // 7) / n END, 9) AS rate FROM (SELECT doc_id, len(string_split(coalesce(text, ''), ' ')) AS n FROM documents)""")
def sim02_long_token_edits(spark, d):
    """Whole texts against themselves with every seventh word replaced by one that is in no text, and against nothing."""
    x = t(spark, d, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), " ").alias("w"))
    other = F.transform("w", lambda v, i: F.when(i % 7 == 6, F.concat(F.lit("\x01"), i.cast("string"))).otherwise(v))
    y = x.select("doc_id", "w", other.alias("o"), F.array().cast("array<string>").alias("none"))
    edits = S.token_edit_distance(F.col("w"), F.col("o"))
    return y.select("doc_id", edits.alias("edits"), S.token_edit_distance(F.col("w"), F.col("none")).alias("removed"), F.round(M.mixed_error_rate(F.col("w"), F.col("o"), edits), 9).alias("rate"))


_PAIR = "p_name a, reverse(p_name) b, substr(p_name, 2) || 's' c"


@query(f"""WITH r AS (SELECT p_partkey, {_PAIR} FROM part), s AS (SELECT p_partkey, a, b, c, 1 - levenshtein(a, b) / greatest(length(a), length(b)) sb, 1 - levenshtein(a, c) / greatest(length(a), length(c)) sc FROM r)
SELECT p_partkey, round(greatest(CASE WHEN sb < 0.5 THEN 0.0 ELSE sb END, CASE WHEN sc < 0.5 THEN 0.0 ELSE sc END), 9) AS anls, round(CASE WHEN 1 - least(1.0, levenshtein(a, c) / length(c)) < 0.5 THEN 0.0 ELSE 1 - least(1.0, levenshtein(a, c) / length(c)) END, 9) AS ocr,
 round(1 - damerau_levenshtein(a, b) / greatest(length(a), length(b)), 9) AS swaps, round(CASE WHEN 1 - damerau_levenshtein(lower(a), lower(c)) / greatest(length(a), length(c)) < 0.9 THEN 0.0 ELSE 1 - damerau_levenshtein(lower(a), lower(c)) / greatest(length(a), length(c)) END, 9) AS near,
 round(CASE WHEN len(string_split(a, ' ')) < 5 THEN CAST(contains('the ' || a || ' is', a) AS INT) ELSE CASE WHEN 1 - levenshtein('the ' || a || ' is', a) / (length(a) + 7) >= 0.5 THEN 1 - levenshtein('the ' || a || ' is', a) / (length(a) + 7) ELSE 0 END END, 9) AS vqa FROM s""")
def sim03_edit_similarities(spark, d):
    a, b, c = F.col("p_name"), F.reverse("p_name"), F.concat(F.expr("substr(p_name, 2)"), F.lit("s"))
    wide = F.concat(F.lit("The "), a, F.lit(" is"))
    return t(spark, d, "part").select("p_partkey", F.round(S.anls(a, F.array(b, c)), 9).alias("anls"), F.round(S.reward_ocr(a, c), 9).alias("ocr"), F.round(M.damerau_similarity(a, b), 9).alias("swaps"), F.round(M.near_match(F.concat(F.lit("the "), a), c), 9).alias("near"), F.round(M.short_or_anls(wide, F.array(a)), 9).alias("vqa"))


_SETS = """WITH r AS (SELECT p_partkey, string_split(p_name, ' ') a, string_split(upper(p_brand || ' ' || p_name), ' ') b FROM part),
l AS (SELECT p_partkey, list_distinct(list_transform(a, lambda x: lower(x))) a, list_distinct(list_transform(b, lambda x: lower(x))) b FROM r)"""


@query(f"""{_SETS} SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 9) AS plain, round(len(list_intersect(a, b)) / len(b), 9) AS recall, 0.5::DOUBLE AS tuples, true AS nocase, true AS lines, true AS commas, false AS exact FROM l""")
def sim07_sets(spark, d):
    a, b = F.split("p_name", " ", -1), F.split(F.upper(F.concat("p_brand", F.lit(" "), "p_name")), " ", -1)
    low = F.transform(b, F.lower)
    pair = F.array(F.array(F.lit("A-b"), F.col("p_name")), F.array(F.lit("x"), F.lit("y")))
    other = F.array(F.array(F.lit("a b"), F.upper("p_name")), F.array(F.lit("x"), F.lit("y")), F.array(F.lit("z"), F.lit("y")), F.array(F.lit("q"), F.lit("q")))
    return t(spark, d, "part").select(
        "p_partkey", F.round(M.jaccard_plain(a, b), 9).alias("plain"), F.round(S.set_recall(a, low), 9).alias("recall"), F.round(M.tuple_jaccard(pair, other), 9).alias("tuples"), M.same_set(a, F.transform(F.reverse(a), F.upper), "nocase").alias("nocase"),
        M.same_set(F.concat("p_name", F.lit("\\nX")), F.concat(F.lit("x\n"), F.upper("p_name")), "lines").alias("lines"), M.same_set(F.concat(F.lit("["), "p_brand", F.lit(", b]")), F.concat(F.lit("B,"), F.lower("p_brand")), "commas").alias("commas"),
        M.same_set(F.array("p_name"), F.array(F.upper("p_name"))).alias("exact"),
    )


@query("""SELECT o_orderkey, o_custkey % 2 = 0 AS equal, CASE WHEN o_custkey % 2 = 0 THEN 1.0::DOUBLE ELSE 0.5 END AS prec, round(CASE WHEN o_custkey % 2 = 0 THEN 1.0::DOUBLE ELSE (0.5 + 0.0 + 0.0) / 3 END, 9) AS jaccard, CASE WHEN o_custkey % 2 = 0 THEN 1.0::DOUBLE ELSE 0.5 END AS places,
 CASE WHEN o_custkey % 2 = 0 THEN 1.0::DOUBLE ELSE 0.5 END AS prefix, o_custkey % 2 = 0 AS ordered FROM orders""")
def sim08_maps_and_sequences(spark, d):
    even = F.col("o_custkey") % 2 == 0
    truth = F.create_map(F.lit("a"), F.col("o_orderstatus"), F.lit("b"), F.lit("x"))
    said = F.create_map(F.lit("b"), F.lit("x"), F.when(even, "a").otherwise("c"), F.col("o_orderstatus"))
    one = F.create_map(F.lit("a"), F.array(F.lit("p"), F.lit("q")), F.lit("b"), F.array(F.lit("r")))
    two = F.create_map(F.lit("a"), F.when(even, F.array(F.lit("q"), F.lit("p"))).otherwise(F.array(F.lit("p"))), F.when(even, "b").otherwise("c"), F.array(F.lit("r")))
    left, right = F.array(F.lit(1), F.lit(2)), F.array(F.lit(1), F.when(even, 2).otherwise(3))
    return t(spark, d, "orders").select("o_orderkey", M.map_equal(truth, said).alias("equal"), M.map_precision(said, truth).alias("prec"), F.round(M.map_jaccard(one, two), 9).alias("jaccard"), S.positional_accuracy(left, right).alias("places"), S.common_prefix_ratio(left, right).alias("prefix"), (left == right).alias("ordered"))


@query("""SELECT p_partkey, 1.0::DOUBLE AS similarity, p_name AS found, 1.0::DOUBLE AS f1, true AS exact, 0.0::DOUBLE AS nothing FROM part""")
def sim13_best_ngram(spark, d):
    x = t(spark, d, "part").select("p_partkey", "p_name", M.masked_text_scores(F.concat(F.lit("it says: "), "p_name", F.lit(" here.")), F.col("p_name")).alias("s"), M.masked_text_scores(F.lit("?"), F.col("p_name")).alias("n"))
    return x.select("p_partkey", "s.similarity", "s.found", "s.f1", "s.exact", F.col("n.f1").alias("nothing"))


_GRAMS = """WITH x AS (SELECT conv_id, turn, text || ' a b' a, text || ' a b so text ' || turn || ' a' b FROM conversations),
r AS (SELECT conv_id, turn, list_filter(regexp_split_to_array({a}, '[ \\t\\n\\r]+'), lambda x: x <> '') p, list_filter(regexp_split_to_array({b}, '[ \\t\\n\\r]+'), lambda x: x <> '') t FROM x),
g AS (SELECT conv_id, turn, k, list_transform(range(1, greatest(len(p) - k + 2, 1)), lambda i: array_to_string(p[i:i + k - 1], ' ')) p, list_transform(range(1, greatest(len(t) - k + 2, 1)), lambda i: array_to_string(t[i:i + k - 1], ' ')) t FROM r, (VALUES (1), (2), (3), (4)) v(k)),
a AS (SELECT conv_id, turn, k, g, count(*) n FROM (SELECT conv_id, turn, k, unnest(p) g FROM g) GROUP BY ALL), b AS (SELECT conv_id, turn, k, g, count(*) n FROM (SELECT conv_id, turn, k, unnest(t) g FROM g) GROUP BY ALL),
c AS (SELECT conv_id, turn, k, sum(least(a.n, b.n)) m FROM a JOIN b USING (conv_id, turn, k, g) GROUP BY ALL),
s AS (SELECT g.conv_id, g.turn, g.k, coalesce(m, 0) m, len(p) lp, len(t) lt FROM g LEFT JOIN c USING (conv_id, turn, k))"""


def _texts(spark, d):
    said = F.concat("text", F.lit(" a b"))
    return t(spark, d, "conversations").select("conv_id", "turn", said.alias("p"), F.concat(said, F.lit(" so text "), F.col("turn").cast("string"), F.lit(" a")).alias("r"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, string_split('x' || l_quantity % 5 || ' y' || l_linenumber % 3 || ' x' || l_partkey % 5 || ' z', ' ') p, string_split('x' || l_quantity % 4 || ' x' || l_suppkey % 5 || ' y1', ' ') t FROM lineitem),
g AS (SELECT l_orderkey, l_linenumber, row_number() OVER () r, list_transform(p, lambda w: replace(w, '.', '')) p, list_transform(t, lambda w: replace(w, '.', '')) t FROM x),
u AS (SELECT r, g, count(*) n FROM (SELECT r, unnest(p) g FROM g) GROUP BY ALL), v AS (SELECT r, g, count(*) n FROM (SELECT r, unnest(t) g FROM g) GROUP BY ALL), m AS (SELECT r, sum(least(u.n, v.n)) m FROM u JOIN v USING (r, g) GROUP BY 1)
SELECT l_orderkey, l_linenumber, round(coalesce(2 * m / (len(p) + len(t)), 0), 9) AS one FROM g LEFT JOIN m USING (r)""")
def sim14_ngram_f1(spark, d):
    def word(a, c, n):
        return F.concat(F.lit(a), (F.col(c) % n).cast("string"))
    p = F.concat_ws(" ", word("x", "l_quantity", 5), word("Y", "l_linenumber", 3), word("x", "l_partkey", 5), F.lit("the z!"))
    r = F.concat_ws(" ", word("x", "l_quantity", 4), word("X", "l_suppkey", 5), F.lit("y1,"))
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(M.ngram_f1(p, r, 1), 9).alias("one"))


@query(_GRAMS.format(a="lower(a)", b="lower(b)") + """ SELECT round(exp(avg(ln(m / l))) * CASE WHEN max(c) >= max(r) THEN 1.0::DOUBLE ELSE exp(1 - max(r) / max(c)) END, 9) AS bleu
FROM (SELECT k, sum(m) m, sum(lp) l, max(sum(lp)) OVER () c, max(sum(lt)) OVER () r FROM s GROUP BY k)""")
def sim15_bleu(spark, d):
    return M.bleu(_texts(spark, d), "p", "r").withColumn("bleu", F.round("bleu", 9))


@query("""SELECT p_partkey, round(2 * len(string_split(p_name, ' ')) / (2 * len(string_split(p_name, ' ')) + 2), 9) AS rouge, 0.0::DOUBLE AS nothing FROM part""")
def sim15_rouge(spark, d):
    return t(spark, d, "part").select("p_partkey", F.round(M.rouge_l(F.concat(F.lit("Zz "), F.upper("p_name")), F.concat("p_name", F.lit(" end"))), 9).alias("rouge"), M.rouge_l(F.lit("zz"), F.col("p_name")).alias("nothing"))


@query(r"""SELECT p_partkey, p_partkey % 3 > 0 AS square, true AS quarter, p_partkey % 5 > 0 AS root, p_partkey % 2 = 0 AS pair, CAST(p_partkey % 3 > 0 AS DOUBLE) AS reward FROM part""")
def rwd07_symbolic(spark, d):
    """Expressions of each part's number in two notations, some of which differ by one."""
    k = F.col("p_partkey").cast("long")
    off = lambda n: F.when(k % n == 0, F.lit(1)).otherwise(F.lit(0))
    square = F.format_string("(x+%d)^2", k), F.format_string("x^{2} + %d x + \\frac{%d}{1}", 2 * k, k * k + off(3))
    quarter = F.format_string("\\frac{%d}{4}", k), F.format_string("%s", (k.cast("decimal(20,2)") / 4).cast("decimal(20,2)"))
    root = F.format_string("\\sqrt{%d}", 2 * k * k), F.format_string("%d\\sqrt{2}", k + off(5))
    pair = F.format_string("\\left(%d, y\\right)", k), F.when(k % 2 == 0, F.format_string("(\\frac{%d}{2}, y)", 2 * k)).otherwise(F.format_string("(y, %d)", k))
    said = M.reward_math(F.concat(F.lit("<answer>\\boxed{"), square[0], F.lit("}</answer>")), square[1])
    return spread(t(spark, d, "part").select("p_partkey"), "p_partkey").select("p_partkey", *[equal_answers(*p).alias(n) for p, n in ((square, "square"), (quarter, "quarter"), (root, "root"), (pair, "pair"))], said.alias("reward"))


#: SQL: captions of parts: the name with its last word replaced now and then; references are the name and the name without its first word.
_CAPTIONS = """WITH p AS (SELECT p_partkey AS id, string_split(p_name, ' ') AS a FROM part),
r AS (SELECT id, CASE WHEN id % 3 = 0 THEN list_append(a[:-2], 'zz') WHEN id % 3 = 1 THEN list_concat(a, a[1:2]) ELSE a END AS p, [a, a[2:]] AS refs FROM p)"""
_ORDERS = "(SELECT unnest([1, 2, 3, 4]) AS k)"


def _captions(spark, d):
    a = F.split("p_name", " ")
    p = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.lit("zz")))).when(F.col("p_partkey") % 3 == 1, F.concat(a, F.slice(a, 1, 2))).otherwise(a)
    return t(spark, d, "part").select("p_partkey", p.alias("p"), F.array(a, F.slice(a, 2, 1000)).alias("refs"))


@query(_CAPTIONS + f""", h AS (SELECT id, k, unnest(list_transform(range(1, len(p) - k + 2), lambda i: array_to_string(p[i:i + k - 1], ' '))) AS g FROM r, {_ORDERS}),
q AS (SELECT id, j, refs[j] AS w FROM r, range(1, 3) x(j)), t AS (SELECT id, j, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM q, {_ORDERS}),
hc AS (SELECT id, k, g, count(*) AS tf FROM h GROUP BY ALL), tc AS (SELECT id, j, k, g, count(*) AS tf FROM t GROUP BY ALL),
df AS (SELECT k, g, count(DISTINCT id) AS df FROM t GROUP BY ALL), n AS (SELECT ln(count(*)) AS n FROM r),
hw AS (SELECT hc.id, hc.k, hc.g, tf * ((SELECT n FROM n) - ln(coalesce(df, 1))) AS h FROM hc LEFT JOIN df USING (k, g)), tw AS (SELECT tc.id, j, tc.k, tc.g, tf * ((SELECT n FROM n) - ln(df)) AS w FROM tc JOIN df USING (k, g)),
hn AS (SELECT id, k, sqrt(sum(h * h)) AS hn FROM hw GROUP BY ALL), tn AS (SELECT id, j, k, sqrt(sum(w * w)) AS tn FROM tw GROUP BY ALL),
dot AS (SELECT tw.id, j, tw.k, sum(least(h, w) * w) AS dot FROM tw JOIN hw ON tw.id = hw.id AND tw.k = hw.k AND tw.g = hw.g GROUP BY ALL),
v AS (SELECT id, j, sum(CASE WHEN hn > 0 AND tn > 0 THEN dot / (hn * tn) ELSE dot END) / 4 AS v FROM dot JOIN hn USING (id, k) JOIN tn USING (id, j, k) GROUP BY ALL)
SELECT q.id AS p_partkey, round(10 * avg(coalesce(v, 0) * exp(-power(greatest(len(p) - 1, 0) - greatest(len(w) - 1, 0), 2) / 72)), 6) AS cider FROM q JOIN r ON r.id = q.id LEFT JOIN v ON v.id = q.id AND v.j = q.j GROUP BY q.id""")
def sim15_cider(spark, d):
    return captions.cider(_captions(spark, d), "p_partkey", "p", "refs").withColumn("cider", F.round("cider", 6))


@query(_CAPTIONS + f""", h AS (SELECT id, k, unnest(list_transform(range(1, len(p) - k + 2), lambda i: array_to_string(p[i:i + k - 1], ' '))) AS g FROM r, {_ORDERS}),
q AS (SELECT id, j, refs[j] AS w FROM r, range(1, 3) x(j)), t AS (SELECT id, j, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM q, {_ORDERS}),
hc AS (SELECT id, k, g, count(*) AS c FROM h GROUP BY ALL), tc AS (SELECT id, j, k, g, count(*) AS c FROM t GROUP BY ALL),
m AS (SELECT tc.id, j, sum(least(tc.c, hc.c)) AS m FROM tc JOIN hc ON tc.id = hc.id AND tc.k = hc.k AND tc.g = hc.g GROUP BY ALL), ht AS (SELECT id, sum(c) AS a FROM hc GROUP BY ALL), tt AS (SELECT id, j, sum(c) AS b FROM tc GROUP BY ALL)
SELECT q.id AS p_partkey, round(max(coalesce(m, 0) / greatest(a, coalesce(b, 0))), 9) AS gleu FROM q JOIN ht ON ht.id = q.id LEFT JOIN tt ON tt.id = q.id AND tt.j = q.j LEFT JOIN m ON m.id = q.id AND m.j = q.j GROUP BY q.id""")
def sim15_gleu(spark, d):
    return spread(_captions(spark, d), "p_partkey").select("p_partkey", F.round(captions.gleu(F.col("p"), F.col("refs")), 9).alias("gleu"))


def _overlap(pattern: str, group: int, a: str, b: str) -> str:
    x, y = (f"list_distinct(regexp_extract_all(lower({c}), '{pattern}', {group}))" for c in (a, b))
    return f"CASE WHEN len({y}) = 0 THEN 0 ELSE len(list_intersect({x}, {y})) / len(list_distinct(list_concat({x}, {y}))) END"


@query(f"""WITH r AS (SELECT page_id, trim(coalesce(html, ''), ' ') b, '<html>' || coalesce(url, '') || '<p id="' || page_id || '">x</p></html>' a FROM pages)
SELECT page_id, 1.0::DOUBLE AS same, round(0.6 * ({_overlap('[\\pL\\pN_]+|[<>=/"]', 0, 'a', 'b')}) + 0.4 * ({_overlap('<(/?[\\pL\\pN_]+)', 1, 'a', 'b')}), 9) AS partial, 0.0::DOUBLE AS no_svg,
 round(0.25 * ({_overlap('[\\pL\\pN_]+|[<>=/"]|#[0-9a-fA-F]+', 0, "('<svg><g id=1/></svg>')", "('<svg><g/><h/></svg>')")} + {_overlap('<([a-zA-Z]+)[^>]*>', 1, "('<svg><g id=1/></svg>')", "('<svg><g/><h/></svg>')")}) + 0.25, 9) AS svg FROM r""")
def sim16_code_rewards(spark, d):
    h = F.coalesce("html", F.lit(""))
    made = F.concat(F.lit("<html>"), F.coalesce("url", F.lit("")), F.lit('<p id="'), F.col("page_id").cast("string"), F.lit('">x</p></html>'))
    return t(spark, d, "pages").select("page_id", M.reward_html(F.concat(F.lit("<answer>"), F.replace(h, F.lit('"'), F.lit("'")), F.lit(" <!-- x --></answer>")), h).alias("same"), F.round(M.reward_html(made, h), 9).alias("partial"), M.reward_svg(F.lit("no"), h).alias("no_svg"), F.round(M.reward_svg(F.lit("<answer><svg><g id=1/></svg></answer>"), F.lit("<svg><g/><h/></svg>"), F.lit(0.5)), 9).alias("svg"))


@query("""SELECT l_orderkey, l_linenumber, (SELECT sum(CAST(abs(l_quantity - 25) / 25 <= CAST(0.5 AS DOUBLE) - CAST(0.05 AS DOUBLE) * i AS INT)) / 10 FROM range(10) r(i)) AS mra, l_quantity = 7 AS last, round(((l_quantity - 25) * (l_quantity - 25) + 4) / 2, 6) AS mse,
 round(1 - least(sqrt(l_discount * l_discount), CAST(0.1 AS DOUBLE)) / CAST(0.1 AS DOUBLE), 6) AS rmse, 0.0::DOUBLE AS lengths, abs(l_quantity - 25) <= 0.25::DOUBLE AS number, 1.0::DOUBLE AS listed, 1.0::DOUBLE AS pi FROM lineitem""")
def num02_numbers(spark, d):
    q = F.col("l_quantity").cast("double")
    return t(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", S.mean_relative_accuracy(q, F.lit(25.0)).alias("mra"), (S.reward_number(F.concat(F.lit("12 or -"), q.cast("int").cast("string")), F.lit("7")) == 1).alias("last"),
        F.round(M.mean_square(F.array(q, F.lit(1.0)), F.array(F.lit(25.0), F.lit(3.0))), 6).alias("mse"), F.round(M.root_score(F.array(F.col("l_discount").cast("double")), F.array(F.lit(0.0))), 6).alias("rmse"), M.root_score(F.array(q, q), F.array(q)).alias("lengths"),
        (M.general_number_match(F.concat(F.lit("x = "), q.cast("string"), F.lit(" + 5*5 - 25")), F.lit("25")) == 1).alias("number"), M.general_number_match(F.lit("[3, 1.005, 2]"), F.lit("[1, 2, 3]")).alias("listed"), M.general_number_match(F.lit("2\\pi"), F.lit("6.28")).alias("pi"),
    )


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity q FROM lineitem)
SELECT l_orderkey, l_linenumber, round((CASE WHEN q < 10 THEN (10 - q) / (10 + q) ELSE 0 END + 1) / 2, 6) AS boxes, 0.0::DOUBLE AS none, round(greatest(0, least(q, 20) - 5) / (greatest(q, 20) - 0), 6) AS span, round(q, 6) AS distance, round((1 + exp(-10 * (q / 50) / sqrt(2))) / 2, 6) AS points, round(exp(-2 * 6371.0 * asin(sqrt(pow(sin(radians(q) / 2), 2))) / 100), 9) AS geo,
 round(q / 100, 6) AS x1, round((q + 50) / 100, 6) AS x2, round(least(1.0, sqrt(1000.0 / (q * 100))), 6) AS factor, CASE WHEN q < 30 THEN 3600 + q * 60 + 5.0::DOUBLE ELSE 9.0 END AS seconds, least(q * 60 + 5, 70) AS first FROM b""")
def geo02_geometry(spark, d):
    q = F.col("l_quantity").cast("double")
    boxes = F.array(F.array(q, F.lit(0.0), 10 + q, F.lit(1.0)), F.array(F.lit(100.0), F.lit(0.0), F.lit(101.0), F.lit(1.0)))
    truth = F.array(F.array(F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(1.0)), F.array(F.lit(100.0), F.lit(0.0), F.lit(101.0), F.lit(1.0)))
    number = F.format_string("%02d", q.cast("int"))
    corners = M.corners(q, F.lit(0.0), F.lit(50.0), F.lit(1.0), F.lit(100.0), F.lit(1.0))
    points = F.array(F.array(F.lit(0.0), F.lit(0.0)), F.array(q / 50, F.lit(0.0))), F.array(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))
    return t(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(M.best_box_iou(boxes, truth), 6).alias("boxes"), M.best_box_iou(F.slice(boxes, 1, 0), truth).alias("none"), F.round(S.span_iou(F.lit(0.0), q, F.lit(5.0), F.lit(20.0)), 6).alias("span"), F.round(M.point_distance(q, F.lit(0.0), F.lit(0.0), F.lit(0.0)), 6).alias("distance"),
        F.round(M.keypoint_score(*points), 6).alias("points"), F.round(S.geo_proximity(F.lit(0.0), F.lit(0.0), q, F.lit(0.0)), 9).alias("geo"), F.round(corners[0], 6).alias("x1"), F.round(corners[2], 6).alias("x2"), F.round(M.resize_factor(q, F.lit(100.0), 1000), 6).alias("factor"),
        F.when(q < 30, S.clock_seconds(F.concat(F.lit("1:"), number, F.lit(":05")))).otherwise(S.clock_seconds(F.lit("0:09"))).alias("seconds"), M.clock_span(F.concat(F.lit("from "), number, F.lit(":05 to 1:10 or 9:99")))[0].alias("first"),
    )


@query("""SELECT o_orderkey, 1.0::DOUBLE AS exact, CAST(o_orderkey % 2 = 0 AS INT) * 1.0::DOUBLE::DOUBLE AS choice, CAST(o_orderkey % 2 = 0 AS INT) * 1.0::DOUBLE::DOUBLE AS boolean, 1.0::DOUBLE AS format, 0.0::DOUBLE AS no_format, CAST(o_orderkey % 2 = 0 AS INT) * 1.0::DOUBLE::DOUBLE AS box, CAST(o_orderkey % 2 = 0 AS INT) * 1.0::DOUBLE::DOUBLE AS answer_format, 1.0::DOUBLE AS math, 0.7::DOUBLE AS judged,
 CASE WHEN o_orderkey % 2 = 0 THEN 1.5::DOUBLE ELSE 0.0 END AS spatial, 'a, b' AS joined, ['1', '2'] AS items, ['1', '2'] AS distinct_items, [[1.0::DOUBLE, 2.0, 3.0, 4.0]] AS boxes FROM orders""")
def rwd09_rewards(spark, d):
    even = F.col("o_orderkey") % 2 == 0
    key = F.col("o_orderkey").cast("string")
    long = F.concat(F.lit("<think>"), F.repeat(F.lit("because "), F.lit(20)), F.lit("</think>\n\\boxed{7}"))
    return spread(t(spark, d, "orders").select("o_orderkey"), "o_orderkey").select(
        "o_orderkey", S.reward_exact(F.concat(F.lit(" "), key), key).alias("exact"), S.reward_choice(F.when(even, "(B) x").otherwise("A"), F.lit("b")).alias("choice"), S.reward_boolean(F.when(even, "Yes, true").otherwise("never"), F.lit("true")).alias("boolean"),
        S.reward_format(long).alias("format"), S.reward_format(F.lit("\\boxed{7}")).alias("no_format"), M.box_in_thought(F.when(even, "<think>at [1, 2.5,3 , -4]</think>").otherwise("[1,2,3,4]<think>x</think>")).alias("box"),
        M.think_answer_format(F.when(even, "<think>a</think>\n<answer>b</answer>").otherwise("x <think>a</think><answer>b</answer>")).alias("answer_format"), M.reward_math(F.concat(F.lit("<answer>\\boxed{"), key, F.lit("/2}</answer>")), F.concat(F.lit("0.5*"), key)).alias("math"),
        M.typed_reward(F.lit("judge"), F.lit("x"), F.array(F.lit("y")), F.lit(0.7)).alias("judged"), M.typed_reward(F.lit("multiple_choice"), F.when(even, "B <think>[0,0,1,1]</think>").otherwise("C"), F.array(F.lit("B")), problem_type=F.lit("spatial_reasoning")).alias("spatial"),
        M.joined_answers(F.array(F.lit("a"), F.lit("b"))).alias("joined"), M.literal_items(F.lit("[1, 2]")).alias("items"), M.literal_items(F.lit("(1, 2, 2, 1)"), "set").alias("distinct_items"), M.literal_boxes(F.lit("[[1, 2, 3, 4], [1, 2]]")).alias("boxes"),
    )


@query("""SELECT conv_id, turn, unnest(['length', 'user', 'words']) AS metric, unnest([CAST(length(text) AS DOUBLE), CAST(role = 'user' AS INT)::DOUBLE, CAST(len(string_split(text, ' ')) AS DOUBLE)]) AS score FROM conversations""")
def udf05_many_metrics(spark, d):
    x = t(spark, d, "conversations").withColumn("k", F.struct("conv_id", "turn"))
    out = M.rewards_exploded(x, "k", {"length": F.length("text"), "user": F.col("role") == "user", "words": F.size(F.split("text", " ", -1))})
    return out.select("k.conv_id", "k.turn", "metric", "score")


@query("""SELECT conv_id, turn, text = '' OR text IS NOT NULL AS known, least(1.0::DOUBLE, CAST(role = 'user' AS INT) * 2 / 3.0::DOUBLE) AS votes FROM conversations""")
def agg39_soft_accuracy(spark, d):
    said = F.array(F.lit("User "), F.lit("user"), F.lit("no"))
    return t(spark, d, "conversations").select("conv_id", "turn", (F.length(T.squeeze(F.col("text"))) >= 0).alias("known"), S.vqa_soft_accuracy(F.col("role"), said).alias("votes"))
