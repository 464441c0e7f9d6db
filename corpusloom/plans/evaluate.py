"""Queries of the task-level aggregations and of scored tasks (AGG-*, EXT-*, UDF-01..06, SRC-17, SRC-18, JOIN-05..07)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import evaluation as E
from corpusloom.operators import grouping, judging, registry, retrieval
from corpusloom.plans.register import query, t


def rounded(df, places: int = 6):
    """Floating columns rounded, so that orders of summation don't show."""
    return df.select(*[F.round(c, places).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


@query("SELECT source, list(n_chars ORDER BY doc_id) AS scores FROM documents GROUP BY source")
def agg02_bypass(spark, d):
    return E.bypassed(t(spark, d, "documents"), ["source"], "n_chars", "doc_id")


@query("""SELECT round(avg(CAST(lower(trim(l_returnflag)) = lower(trim(' n ')) AS INT)), 6) AS accuracy, count(*) AS n FROM lineitem""")
def agg07_micro_accuracy(spark, d):
    return rounded(E.micro_accuracy(t(spark, d, "lineitem").select("l_returnflag", F.lit(" n ").alias("said")), "l_returnflag", "said"))


@query("""WITH r AS (SELECT event_id // 4 q, event_id % 4 i, CAST((CASE WHEN event_id % 4 IN (0, 3) THEN 1 ELSE 0 END) = (CASE WHEN value > 40 THEN 1 ELSE 0 END) AS INT) ok FROM events),
g AS (SELECT q, max(CASE WHEN i = 0 THEN ok END) a, max(CASE WHEN i = 1 THEN ok END) b, max(CASE WHEN i = 2 THEN ok END) c, max(CASE WHEN i = 3 THEN ok END) d FROM r GROUP BY q HAVING count(*) = 4)
SELECT round(avg(a * b + c * d) / 2, 6) AS question, round(avg(a * c + b * d) / 2, 6) AS image, round(avg(a + b + c + d) / 4, 6) AS "binary", round(avg(a * b * c * d), 6) AS "group" FROM g""")
def agg08_quads(spark, d):
    return rounded(E.quad_accuracy(t(spark, d, "events").withColumn("said", (F.col("value") > 40).cast("int")), "event_id", "said"))


@query("""WITH m AS (SELECT event_type, avg(value) v FROM events GROUP BY 1), c AS (SELECT CASE WHEN event_type IN (SELECT event_type FROM m ORDER BY 1 LIMIT 2) THEN 'both' ELSE event_type END AS kind, v FROM m), t AS (SELECT kind, avg(v) AS value FROM c GROUP BY 1)
SELECT kind, round(value, 6) AS value FROM t UNION ALL SELECT 'overall', round(avg(value), 6) FROM t""")
def agg09_composite(spark, d):
    x = t(spark, d, "events")
    two = [r[0] for r in x.select("event_type").distinct().orderBy("event_type").limit(2).collect()]
    return rounded(E.composite_table(x, "event_type", "value", {"both": two}))


@query("""SELECT round(100.0 * sum(1 + p_partkey % 2) / sum(2 * len(string_split(p_name, ' '))), 6) AS wer FROM part WHERE len(string_split(p_name, ' ')) = 2""")
def agg10_word_errors(spark, d):
    x = t(spark, d, "part").where(F.size(F.split("p_name", " ")) == 2)
    ref = F.concat_ws(" ", "p_name", "p_name")
    hyp = F.concat_ws(" ", F.lit("zz"), "p_name", F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.concat(F.split("p_name", " ")[0], F.lit(" qq"))))
    return rounded(grouping.word_error_rate(x.select(ref.alias("r"), hyp.alias("h")), "r", "h"))


@query("""WITH r AS (SELECT len(string_split(coalesce(text, ''), ' ')) AS n FROM documents) SELECT round(100 * sum(n // 5) / sum(n), 6) AS wer, round(avg((n // 5) / n), 6) AS mer FROM r""")
def agg11_long_texts(spark, d):
    """Whole texts, most with more than 255 different words, against themselves with every fifth word replaced."""
    words = F.split(F.coalesce("text", F.lit("")), " ")
    other = F.array_join(F.transform(words, lambda v, i: F.when(i % 5 == 4, F.concat(F.lit("\x01"), i.cast("string"))).otherwise(v)), " ")
    x = t(spark, d, "documents").select(F.coalesce("text", F.lit("")).alias("r"), other.alias("h"))
    return rounded(E.error_rates(x, "r", "h"))


@query("""SELECT round(avg(1.0 / (len(string_split(p_name, ' ')) + 1)), 6) AS mer FROM part""")
def agg11_mixed_errors(spark, d):
    return rounded(E.mean_error_rate(t(spark, d, "part").select("p_name", F.concat(F.lit("zz "), "p_name").alias("h")), "p_name", "h"))


_FACETS = """SELECT '{0}' AS facet, CAST({0} AS VARCHAR) AS value, round(avg(ok) * 100, 2) AS accuracy, sum(ok) AS correct, count(*) AS total FROM r GROUP BY 2"""


@query(f"""WITH r AS (SELECT l_returnflag, l_linenumber, CAST(l_quantity > 25 AS INT) ok, [CASE WHEN l_partkey % 2 = 0 THEN 'even' ELSE 'odd' END, CASE WHEN l_partkey % 3 = 0 THEN 'three' ELSE 'odd' END] skills FROM lineitem),
a AS (SELECT 'average' AS facet, 'all' AS value, round(avg(ok) * 100, 2) AS accuracy, sum(ok) AS correct, count(*) AS total FROM r UNION ALL {_FACETS.format('l_returnflag')} UNION ALL {_FACETS.format('l_linenumber')}
 UNION ALL SELECT 'skills', s, round(avg(ok) * 100, 2), sum(ok), count(*) FROM (SELECT ok, unnest(list_distinct(skills)) s FROM r) GROUP BY 2)
SELECT facet, value, accuracy, CAST(correct AS BIGINT) AS correct, total, CAST(row_number() OVER (PARTITION BY facet ORDER BY accuracy DESC, value) AS INT) AS rank, CASE WHEN facet = 'l_returnflag' THEN round(accuracy - 50, 2) END AS gain FROM a""")
def agg13_facet_table(spark, d):
    p = F.col("l_partkey")
    x = t(spark, d, "lineitem").withColumn("ok", F.col("l_quantity") > 25).withColumn("skills", F.array(F.when(p % 2 == 0, "even").otherwise("odd"), F.when(p % 3 == 0, "three").otherwise("odd")))
    base = t(spark, d, "lineitem").select(F.lit("l_returnflag").alias("facet"), F.col("l_returnflag").alias("value"), F.lit(50.0).alias("accuracy")).distinct()
    return E.facet_table(x, ["l_returnflag", "l_linenumber"], ["skills"], "ok", base)


_STEPS = "s1 AND s2 AND s3"


@query(f"""WITH r AS (SELECT o_orderkey % 2 = 0 s1, o_custkey % 3 <> 0 s2, o_totalprice > 100000 s3, o_orderstatus = 'F' w FROM orders),
c AS (SELECT count(*) AS total, count(*) FILTER (({_STEPS}) AND NOT w) AS generalisation, count(*) FILTER (NOT ({_STEPS}) AND NOT w) AS knowledge, count(*) FILTER ((s1 OR s2 OR s3) AND w) AS mastery_loose, count(*) FILTER (({_STEPS}) AND w) AS mastery_strict,
 count(*) FILTER (NOT (s1 OR s2 OR s3) AND w) AS rote_loose, count(*) FILTER (NOT ({_STEPS}) AND w) AS rote_strict FROM r)
SELECT *, round(generalisation / total, 6) AS generalisation_rate, round(knowledge / total, 6) AS knowledge_rate, round(mastery_loose / total, 6) AS mastery_loose_rate, round(mastery_strict / total, 6) AS mastery_strict_rate,
 round(rote_loose / (rote_loose + mastery_loose), 6) AS rote_loose_rate, round(rote_strict / (rote_strict + mastery_strict), 6) AS rote_strict_rate FROM c""")
def agg14_step_errors(spark, d):
    x = t(spark, d, "orders").select((F.col("o_orderkey") % 2 == 0).alias("s1"), (F.col("o_custkey") % 3 != 0).alias("s2"), (F.col("o_totalprice") > 100000).alias("s3"), (F.col("o_orderstatus") == "F").alias("w"))
    return rounded(E.step_errors(x, ["s1", "s2", "s3"], "w"))


@query("""WITH r AS (SELECT user_id, event_type a, row_number() OVER (PARTITION BY user_id ORDER BY event_id) i FROM events), t AS (SELECT user_id, min(event_type) t FROM events GROUP BY 1),
c AS (SELECT user_id, n, a, count(*) c, min(i) f FROM r, (VALUES (2), (4), (8)) v(n) WHERE i <= n GROUP BY ALL), w AS (SELECT user_id, n, first(a ORDER BY c DESC, f) a FROM c GROUP BY ALL),
k AS (SELECT user_id, n, w.a = t.t m, EXISTS (SELECT 1 FROM c WHERE c.user_id = w.user_id AND c.n = w.n AND c.a = t.t) v FROM w JOIN t USING (user_id))
SELECT round(avg(CASE WHEN n = 2 THEN v::INT END), 6) AS cov_2, round(avg(CASE WHEN n = 4 THEN v::INT END), 6) AS cov_4, round(avg(CASE WHEN n = 8 THEN v::INT END), 6) AS cov_8,
 round(avg(CASE WHEN n = 2 THEN m::INT END), 6) AS maj_2, round(avg(CASE WHEN n = 4 THEN m::INT END), 6) AS maj_4, round(avg(CASE WHEN n = 8 THEN m::INT END), 6) AS maj_8 FROM k""")
def agg17_first_n(spark, d):
    e = t(spark, d, "events")
    truth = e.groupBy("user_id").agg(F.min("event_type").alias("truth"))
    return rounded(E.first_n_scores(e.join(truth, "user_id"), "user_id", "event_type", "truth", "event_id", [2, 4, 8]))


@query("""WITH r AS (SELECT CASE WHEN l_linenumber = 3 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(l_quantity + 10, 40) - greatest(l_quantity, 20)) / (greatest(l_quantity + 10, 40) - least(l_quantity, 20)) END i FROM lineitem)
SELECT round(avg(i), 6) AS mean_iou, round(avg(CAST(i >= 0.3 AS INT)), 6) AS recall_0_3, round(avg(CAST(i >= 0.5 AS INT)), 6) AS recall_0_5, round(avg(CAST(i >= 0.7 AS INT)), 6) AS recall_0_7 FROM r""")
def agg19_span_recall(spark, d):
    q = F.col("l_quantity").cast("double")
    x = t(spark, d, "lineitem").select(q.alias("s"), (q + 10).alias("e"), F.when(F.col("l_linenumber") != 3, F.array(F.lit(20.0), F.lit(40.0))).alias("p"))
    return rounded(E.span_recall(x, "s", "e", "p"))


@query("""WITH b AS (SELECT l_returnflag, l_linestatus, greatest(0, least(l_quantity + 10, 40) - greatest(l_quantity, 20)) * 1.0 w, l_quantity q FROM lineitem), r AS (SELECT l_returnflag, l_linestatus, w / (30 - w) i, q + 5 BETWEEN 20 AND 40 c FROM b)
SELECT l_returnflag, l_linestatus, round(avg(i), 6) AS iou, round(avg((i >= 0.1)::INT), 6) AS acc_0_1, round(avg((i >= 0.3)::INT), 6) AS acc_0_3, round(avg((i >= 0.5)::INT), 6) AS acc_0_5, round(avg((i >= 0.7)::INT), 6) AS acc_0_7, round(avg((i >= 0.9)::INT), 6) AS acc_0_9, round(avg(c::INT), 6) AS centre, count(*) AS n
FROM r GROUP BY CUBE (l_returnflag, l_linestatus)""")
def agg20_box_accuracy(spark, d):
    q = F.col("l_quantity").cast("double")
    x = t(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.array(q, F.lit(0.0), q + 10, F.lit(1.0)).alias("p"), F.array(F.lit(20.0), F.lit(0.0), F.lit(40.0), F.lit(1.0)).alias("g"))
    return rounded(E.box_accuracy(x, "p", "g", ["l_returnflag", "l_linestatus"]))


@query("""SELECT * FROM (SELECT l_returnflag, l_partkey, count(DISTINCT l_suppkey) AS shards, CAST(row_number() OVER (PARTITION BY l_returnflag ORDER BY count(DISTINCT l_suppkey) DESC, l_partkey) AS INT) AS rank FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_suppkey) > 1) WHERE rank <= 10""")
def agg23_shard_duplicates(spark, d):
    return E.shard_duplicates(t(spark, d, "lineitem"), "l_returnflag", "l_partkey", "l_suppkey")


@query("""WITH f AS (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) c FROM part) SELECT unnest(c) AS "column", count(*) AS files FROM f GROUP BY 1""")
def agg24_column_frequency(spark, d):
    return E.column_frequency(t(spark, d, "part").select(F.split("p_name", " ").alias("columns")))


@query("""WITH b AS (SELECT min(o_totalprice) l, max(o_totalprice) h FROM orders) SELECT CAST(floor((o_totalprice - l) * 10 / (h - l)) AS INT) AS bin, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS weight FROM orders, b GROUP BY 1""")
def agg26_weighted_histogram(spark, d):
    return E.weighted_histogram(t(spark, d, "orders"), "o_totalprice", "o_orderkey")


@query("""WITH a AS (SELECT l_returnflag, l_orderkey, list(CAST(l_quantity AS DOUBLE) ORDER BY l_linenumber, l_partkey, l_suppkey) v FROM lineitem GROUP BY 1, 2), p AS (SELECT l_returnflag, sum(list_sum(list_transform(v, lambda x: abs(x - floor(x / 3) * 3)))) d, sum(list_sum(v)) t FROM a GROUP BY 1)
SELECT l_returnflag, round(d / t, 3) AS ratio, round(d, 4) AS delta, round(t, 4) AS total FROM p""")
def agg29_difference_ratio(spark, d):
    one = t(spark, d, "lineitem").groupBy("l_returnflag", "l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("double").alias("q")))), lambda x: x["q"]).alias("a"))
    two = one.select("l_returnflag", "l_orderkey", F.transform("a", lambda x: F.floor(x / 3) * 3.0).alias("b"))
    out = E.difference_ratio(one.join(two, ["l_returnflag", "l_orderkey"]), ["l_returnflag"], "a", "b")
    return out.select("l_returnflag", "ratio", F.round("delta", 4).alias("delta"), F.round("total", 4).alias("total"))


@query("""WITH s AS (SELECT l_orderkey, exp(avg(CASE WHEN l_linenumber <> 2 THEN l_discount END)) r, avg(CASE WHEN l_linenumber <> 2 THEN l_tax END) a FROM lineitem GROUP BY 1),
x AS (SELECT l.l_orderkey, l_linenumber, l_linenumber <> 2 m, CASE WHEN l_linenumber <> 2 THEN r ELSE 0 END r, CASE WHEN l_linenumber <> 2 THEN a ELSE 0 END - 0.04 a, l_discount - 0.05 k FROM lineitem l JOIN s USING (l_orderkey)),
y AS (SELECT *, greatest(-a * r, -a * least(1.05, greatest(0.98, r))) l, sign(a) * 3.0 * a d, exp(k) w FROM x)
SELECT l_orderkey, l_linenumber, round(r, 6) AS ratio, round(sum(least(l, d) * CASE WHEN m AND w <= 1.03 THEN w ELSE 0 END), 6) AS loss, CAST(sum((m AND -a * r < -a * least(1.05, greatest(0.98, r)))::INT) AS BIGINT) AS clipped, CAST(sum((m AND d < l)::INT) AS BIGINT) AS dual, CAST(sum((m AND w <= 1.03)::INT) AS BIGINT) AS kept FROM y GROUP BY l_orderkey, l_linenumber, round(r, 6)""")
def agg31_clipped_loss(spark, d):
    x = t(spark, d, "lineitem").withColumn("m", F.col("l_linenumber") != 2).withColumn("lr", F.col("l_discount").cast("double")).withColumn("adv", F.col("l_tax").cast("double"))
    x = E.sequence_ratio(x, "l_orderkey", "lr", "adv", "m").withColumn("a", F.col("mean_advantage") - 0.04).withColumn("kl", F.col("lr") - 0.05)
    y = E.clipped_loss(x, "ratio", "a", "m", "kl", clip=0.02, clip_higher=0.05, dual=3.0, cap=1.03)
    out = y.groupBy("l_orderkey", "l_linenumber", F.round("ratio", 6).alias("ratio")).agg(F.round(F.sum("loss"), 6).alias("loss"), F.sum(F.col("clip_mask").cast("int")).alias("clipped"), F.sum(F.col("dual_clip_mask").cast("int")).alias("dual"), F.sum(F.col("behave_mask").cast("int")).alias("kept"))
    return out


@query("""SELECT count(*) AS n_seqs, CAST(sum(l_partkey) AS BIGINT) AS n_tokens, CAST(sum(l_suppkey) AS BIGINT) AS n_valid_tokens, count(*) FILTER (l_quantity > 25) AS correct_n_seqs, count(*) FILTER (l_quantity <= 25) AS incorrect_n_seqs,
 round(avg(CASE WHEN l_quantity > 25 THEN l_partkey END), 6) AS correct_seq_len, round(avg(CASE WHEN l_quantity <= 25 THEN l_partkey END), 6) AS incorrect_seq_len, round(avg(l_linenumber), 6) AS prompt_len, round(avg(l_quantity - 25), 6) AS task_reward FROM lineitem""")
def agg32_rollout_statistics(spark, d):
    x = t(spark, d, "lineitem").withColumn("reward", F.col("l_quantity").cast("double") - 25)
    return rounded(E.rollout_statistics(x, "reward", "l_partkey", "l_suppkey", "l_linenumber"))


@query("SELECT l_returnflag, round(avg(l_quantity), 6) AS reward, count(*) AS n FROM lineitem GROUP BY 1")
def agg33_reward_by_type(spark, d):
    return rounded(E.reward_by(t(spark, d, "lineitem").withColumn("r", F.col("l_quantity").cast("double")), "l_returnflag", "r").withColumnRenamed("reward", "reward"))


_RANKED = """WITH q AS (SELECT vec_id, label, embedding FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT q.vec_id a, q.label la, i.vec_id b, i.label lb, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[])) DESC, i.vec_id) r FROM q, embeddings i WHERE i.vec_id <> q.vec_id),
f AS (SELECT a, min(r) f FROM s WHERE la = lb AND r <= 20 GROUP BY 1)"""


def _hits(spark, d):
    e = t(spark, d, "embeddings")
    found = retrieval.top_k(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("item_id"), "embedding"), 21)
    labels = e.select("vec_id", "label")
    both = found.where("query_id != item_id").join(labels.withColumnRenamed("label", "q_label"), F.col("query_id") == F.col("vec_id")).drop("vec_id").join(labels, F.col("item_id") == F.col("vec_id"))
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy("rank")
    return both.withColumn("rank", F.row_number().over(order)).where("rank <= 20").select("query_id", "rank", (F.col("q_label") == F.col("label")).alias("right"))


@query(_RANKED + " SELECT CAST(k AS INT) AS rank, (SELECT count(*) FROM f WHERE f.f <= k) AS hits FROM range(1, 21) r(k) WHERE (SELECT count(*) FROM f WHERE f.f <= k) > 0")
def agg34_hit_curve(spark, d):
    return retrieval.hit_curve(_hits(spark, d), 20)


@query(_RANKED + " SELECT k, round(100.0 * (SELECT count(*) FROM f WHERE f.f <= k) / (SELECT count(*) FROM q), 6) AS accuracy FROM (VALUES (1), (5), (20)) v(k)")
def ext03_retrieval_report(spark, d):
    queries = t(spark, d, "embeddings").where("vec_id % 20 = 0").count()
    return rounded(E.retrieval_report(_hits(spark, d), queries, (1, 5, 20)))


@query("""WITH s AS (SELECT c.c_custkey % 40 q, n_nationkey i, sum(c.c_custkey * 7919 % 101) + CASE WHEN c.c_custkey % 40 = n_nationkey THEN 60 ELSE 0 END s FROM customer c, nation GROUP BY 1, 2), o AS (SELECT q, s FROM s WHERE q = i),
r AS (SELECT o.q, count(*) FILTER (s.s > o.s OR (s.s = o.s AND s.i < o.q)) r FROM o JOIN s USING (q) GROUP BY 1)
SELECT round(100 * avg((r < 1)::INT), 6) AS top1_acc, round(100 * avg((r < 5)::INT), 6) AS top5_acc, round(100 * avg((r < 20)::INT), 6) AS top20_acc, round(avg(r), 6) AS mean_rank, count(*) AS queries FROM r""".replace("sum(c.c_custkey * 7919 % 101)", "sum((c.c_custkey + n_nationkey) * 7919 % 101)"))
def agg35_rank_accuracy(spark, d):
    c, n = t(spark, d, "customer"), t(spark, d, "nation").select(F.col("n_nationkey").alias("i"))
    pairs = c.select("c_custkey", (F.col("c_custkey") % 40).alias("q")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(24)))).join(n, "i")
    s = pairs.groupBy("q", "i").agg(F.sum((F.col("c_custkey") + F.col("i")) * 7919 % 101).alias("s")).withColumn("s", F.col("s") + F.when(F.col("q") == F.col("i"), 60).otherwise(0))
    return rounded(E.rank_accuracy(s, "q", "i", "s"))


@query("""WITH s AS (SELECT sum(o_totalprice / 100000) l, sum(o_custkey) t, sum(o_custkey + o_orderkey % 3) o FROM orders) SELECT round(l / (t - 1), 6) AS mean_loss, round(exp(least(20, l / (t - 1))), 6) AS ppl, round((t - 1) / (o - 1), 6) AS token_ratio, round(exp(least(20, l / (t - 1) * ((t - 1) / (o - 1)))), 6) AS adjusted_ppl FROM s""")
def agg36_perplexity(spark, d):
    x = t(spark, d, "orders").select((F.col("o_totalprice").cast("double") / 100000).alias("l"), "o_custkey", (F.col("o_custkey") + F.col("o_orderkey") % 3).alias("o"))
    return rounded(E.perplexity(x, "l", "o_custkey", "o"))


@query("""WITH p AS (SELECT CAST(l_quantity AS INT) % 100 b, l_linenumber + l_quantity > 28 y FROM lineitem), k AS (SELECT i, avg(((b >= i) = y)::INT) a FROM p, range(100) r(i) GROUP BY i)
SELECT round(first(i / 100.0 ORDER BY a DESC, i), 6)::DOUBLE AS threshold, round(max(a), 6) AS accuracy FROM k""")
def agg37_best_threshold(spark, d):
    x = t(spark, d, "lineitem").select((F.col("l_quantity").cast("int") % 100 / 100.0).alias("p"), (F.col("l_linenumber") + F.col("l_quantity") > 28).alias("y"))
    return rounded(E.best_threshold(x, "p", "y"))


@query("""WITH r AS (SELECT o_orderkey, (o_totalprice % 7 + o_orderkey % 5) / 2 a, (o_custkey % 7 + o_custkey % 3) / 2.0 b, (o_orderkey % 7 + 3) / 2.0 c FROM orders) SELECT o_orderkey, round(a, 6) AS first, CASE WHEN a >= b AND a >= c THEN 'x' WHEN b >= c THEN 'y' ELSE 'z' END AS label FROM r""")
def ext24_ensemble(spark, d):
    o = t(spark, d, "orders")
    d_ = lambda c: c.cast("double")
    one = o.select("o_orderkey", F.array(d_(F.col("o_totalprice")) % 7, d_(F.col("o_custkey") % 7), d_(F.col("o_orderkey") % 7)).alias("s"))
    two = o.select("o_orderkey", F.array(d_(F.col("o_orderkey") % 5), d_(F.col("o_custkey") % 3), F.lit(3.0)).alias("s"))
    return E.ensemble([one, two], "o_orderkey", "s", ["x", "y", "z"]).select("o_orderkey", F.round(F.col("scores")[0], 6).alias("first"), "label")


@query("""WITH r AS (SELECT r_name, n_name, 'I see ' || n_name || ' ' || n_nationkey p FROM nation JOIN region ON n_regionkey = r_regionkey), c AS (SELECT r_name AS category, CAST(sum(1 + contains(lower(p), '1')::INT) AS BIGINT) AS score FROM r GROUP BY 1)
SELECT category, score FROM c UNION ALL SELECT 'recognition', 0 UNION ALL SELECT 'final', sum(score)::BIGINT FROM c""")
def agg40_category_counters(spark, d):
    x = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = x.select("r_name", F.when(F.col("n_regionkey") == 0, "HME100k").otherwise("other").alias("set"), F.concat(F.lit("I see "), "n_name", F.lit(" "), F.col("n_nationkey").cast("string")).alias("p"), F.array(F.concat(F.lit(" "), F.when(F.col("n_regionkey") == 0, F.col("n_name")).otherwise(F.lower("n_name"))), F.lit("1")).alias("a"))
    return E.ocr_counters(rows, "r_name", "set", "p", "a")


@query("""SELECT coalesce(l_returnflag, 'total') AS kind, round(100 * avg((l_quantity > 20)::INT), 6) AS accuracy, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag)""")
def agg41_class_accuracies(spark, d):
    return rounded(E.class_accuracies(t(spark, d, "lineitem").withColumn("ok", F.col("l_quantity") > 20), "l_returnflag", "ok"))


@query("""SELECT source AS subset, count(*) AS n, round(avg(count(*)) OVER (), 6) AS mean_n FROM documents GROUP BY source""")
def agg42_subset_sizes(spark, d):
    return rounded(E.subset_sizes(t(spark, d, "documents"), "source"))


@query("""WITH r AS (SELECT CAST(o_totalprice AS DOUBLE) e, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice / 4 ELSE o_totalprice * 0.1 END f, o_custkey % 5 + 1 n FROM orders), p AS (SELECT f, n, CASE WHEN n > 1 THEN (e - f) / (n - 1) ELSE e END t FROM r)
SELECT round(avg(f), 6) AS ttft, round(avg(t), 6) AS tpot, round(avg(CASE WHEN n > 1 AND t > 0 THEN 1 / t ELSE 0 END), 9) AS speed, CAST(sum(n) AS BIGINT) AS tokens FROM p""")
def agg43_throughput(spark, d):
    e = F.col("o_totalprice").cast("double")
    x = t(spark, d, "orders").select(e.alias("e"), F.when(F.col("o_orderkey") % 2 == 0, e / 4).alias("f"), (F.col("o_custkey") % 5 + 1).alias("n"))
    out = E.throughput(x, "e", "f", "n")
    return out.select(F.round("ttft", 6).alias("ttft"), F.round("tpot", 6).alias("tpot"), F.round("speed", 9).alias("speed"), "tokens")


@query("""WITH r AS (SELECT CAST(l_linenumber AS INT) - 1 t, CAST(l_partkey % 5 AS INT) p FROM lineitem WHERE l_linenumber - 1 BETWEEN 0 AND 3), k AS (SELECT c, (SELECT count(*) FROM r WHERE t = c) a, (SELECT count(*) FROM r WHERE p = c) s, (SELECT count(*) FROM r WHERE t = c AND p = c) m FROM range(4) q(c))
SELECT round(avg(CASE WHEN a + s - m > 0 THEN m / (a + s - m) END), 6) AS mean_iou, round(avg(CASE WHEN a > 0 THEN m / a END), 6) AS mean_accuracy, round(sum(m) / sum(a), 6) AS accuracy FROM k""")
def ext01_segmentation(spark, d):
    x = t(spark, d, "lineitem").select((F.col("l_linenumber").cast("int") - 1).alias("t"), (F.col("l_partkey") % 5).cast("int").alias("p"))
    return rounded(E.segmentation_scores(x, "t", "p", 4))


@query("""SELECT round(avg(CASE WHEN p_partkey % 3 = 0 THEN 0.0 ELSE 2.0 * len(string_split(p_name, ' ')) / (2 * len(string_split(p_name, ' ')) + 1) END), 6) AS f1, count(*) AS n FROM part WHERE p_partkey % 5 <> 0""")
def ext04_dialogue_f1(spark, d):
    k = F.col("p_partkey")
    x = t(spark, d, "part").select(F.when(k % 3 == 0, "no_passages_used").otherwise(F.concat("p_name", F.lit(" extra <|endoftext|>"))).alias("g"), F.when(k % 5 != 0, F.upper("p_name")).alias("a"))
    return rounded(E.dialogue_f1(x, "g", "a"))


@query("SELECT round(avg((n_nationkey % 2 = 0)::INT), 6) AS accuracy, count(*) AS n FROM nation")
def ext05_exact_of_many(spark, d):
    x = t(spark, d, "nation").select(F.concat(F.lit("The "), "n_name", F.lit("!")).alias("p"), F.array(F.lit("zz"), F.when(F.col("n_nationkey") % 2 == 0, F.lower("n_name")).otherwise("x")).alias("a"))
    return rounded(E.exact_of_many(x, "p", "a"))


@query("""SELECT coalesce(r_name, 'total') AS kind, round(100 * avg((n_nationkey % 3 > 0)::INT), 6) AS accuracy, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name)""")
def ext12_subclass_accuracy(spark, d):
    x = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rounded(E.class_accuracies(x.withColumn("ok", E.same_plain(F.concat("n_name", F.lit(".")), F.when(F.col("n_nationkey") % 3 > 0, F.lower("n_name")).otherwise("x"))), "r_name", "ok"))


@query("""SELECT n_nationkey, n_nationkey % 3 <> 1 AS correct FROM nation""")
def ext13_mixed_forms(spark, d):
    k = F.col("n_nationkey")
    kind = F.when(k % 2 == 0, "multi_choice").otherwise("free_form")
    said = F.when(k % 2 == 0, F.when(k % 3 == 0, "B").when(k % 3 == 2, F.col("n_name")).otherwise("A")).otherwise(F.when(k % 3 != 1, F.concat(F.lit("the "), F.lower("n_name"))).otherwise("x"))
    truth = F.when(k % 2 == 0, "B").otherwise(F.col("n_name"))
    return t(spark, d, "nation").select("n_nationkey", E.mixed_form_right(kind, said, truth, F.array(F.lit("zz"), F.col("n_name"))).alias("correct"))


@query("""WITH r AS (SELECT l_orderkey i, l_linenumber % 2 = 0 v, l_quantity > 25 p, l_extendedprice > 20000 ok FROM lineitem),
g AS (SELECT i, coalesce(max(CASE WHEN NOT v AND p THEN ok::INT END), 0) * coalesce(max(CASE WHEN NOT v AND NOT p THEN ok::INT END), 0) a, coalesce(max(CASE WHEN v AND p THEN ok::INT END), 0) * coalesce(max(CASE WHEN v AND NOT p THEN ok::INT END), 0) b FROM r GROUP BY 1)
SELECT round(100 * avg(a), 6) AS text, round(100 * avg(b), 6) AS video, round(100 * avg(a * b), 6) AS "group" FROM g""")
def agg_paired_consistency(spark, d):
    x = t(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") % 2 == 0, "video").otherwise("text").alias("kind"), (F.col("l_quantity") > 25).alias("p"), (F.col("l_extendedprice") > 20000).alias("ok"))
    return rounded(E.paired_consistency(x, "l_orderkey", "kind", "p", "ok"))


@query("""WITH g AS (SELECT l_returnflag s, l_orderkey, sum((l_quantity > 5)::INT) k, count(*) n FROM lineitem GROUP BY 1, 2) SELECT coalesce(s, 'total') AS dataset, round(sum(k) / sum(n), 6) AS accuracy, round(avg((k = n)::INT), 6) AS multiple FROM g GROUP BY ROLLUP (s)""")
def agg_binary_and_multiple(spark, d):
    return rounded(E.binary_and_multiple(t(spark, d, "lineitem").withColumn("ok", F.col("l_quantity") > 5), "l_orderkey", "l_returnflag", "ok"))


@query("""WITH r AS (SELECT n_nationkey k, n_regionkey % 4 t FROM nation) SELECT CASE t WHEN 0 THEN 'ChartQA' WHEN 1 THEN 'VQAv2' WHEN 2 THEN 'SPDocVQA' ELSE 'AI2D' END AS task,
 round(avg(CASE t WHEN 0 THEN (k % 2 = 0)::INT WHEN 1 THEN 2 / 3.0 WHEN 2 THEN 1.0 ELSE (k % 2 = 0)::INT END), 6) AS accuracy, count(*) AS n FROM r GROUP BY t""")
def agg39_vqa_table(spark, d):
    k, r = F.col("n_nationkey"), F.col("n_regionkey") % 4
    task = F.when(r == 0, "ChartQA").when(r == 1, "VQAv2").when(r == 2, "SPDocVQA").otherwise("AI2D")
    said = F.when(r == 0, F.when(k % 2 == 0, "102%").otherwise("200")).when(r == 3, F.when(k % 2 == 0, F.concat(F.lit("the "), "n_name")).otherwise("x")).otherwise(F.col("n_name"))
    truth = F.when(r == 0, F.array(F.lit("100"))).otherwise(F.array(F.lower("n_name"), F.concat("n_name", F.lit("?")), F.lit("zz")))
    return rounded(E.vqa_table(t(spark, d, "nation").select(task.alias("t"), said.alias("p"), truth.alias("a")), "t", "p", "a"))


CHOICES = registry.TaskSpec("nations", "nation", "n_nationkey", "concat('Where is ', n_name, '?')", lambda: F.col("n_regionkey").cast("string"), "n_nationkey >= 2", filters=(("plain", (("remove_whitespace", {}), ("take_first", {}))), ("vote", (("remove_whitespace", {}), ("majority_vote", {})))), metrics=(("acc", None), ("exact_match", "sum")), group_by=("n_regionkey",))
if "nations" not in registry.TASKS.known:
    registry.register_task(CHOICES, "places")


@query("""WITH r AS (SELECT n_nationkey k, n_regionkey, (n_nationkey % 2 = 0 OR n_nationkey % 5 = 0) p, n_nationkey % 5 = 0 v FROM nation WHERE n_nationkey >= 2), s AS (SELECT n_regionkey, f AS filter, CASE f WHEN 'plain' THEN p WHEN 'vote' THEN v END ok FROM r, (VALUES ('plain'), ('vote')) x(f))
SELECT n_regionkey, filter, m AS metric, round(CASE m WHEN 'acc' THEN avg(ok::INT) ELSE sum(ok::INT) END, 6) AS value, count(*) AS n, 'nations' AS task FROM s, (VALUES ('acc'), ('exact_match')) y(m) GROUP BY n_regionkey, filter, m""")
def udf02_scored_task(spark, d):
    k, right = F.col("n_nationkey"), F.col("n_regionkey").cast("string")
    said = F.when(k % 5 == 0, F.array(F.concat(F.lit(" "), right), right)).when(k % 2 == 0, F.array(right, F.lit("x"), F.lit("x"))).otherwise(F.array(F.lit("y")))
    logged = t(spark, d, "nation").select("n_nationkey", said.alias("resps"))
    return rounded(registry.evaluate(spark, "nations", d, logged))


@query("""SELECT metric, round(value, 6) AS value, n, "group", filter FROM (SELECT 'acc' AS metric, avg((n_nationkey % 2 = 0)::INT) AS value, count(*) AS n, 'places' AS "group", f AS filter FROM nation, (VALUES ('plain'), ('vote')) x(f) WHERE n_nationkey >= 2 GROUP BY f)""")
def udf06_group_mean(spark, d):
    logged = t(spark, d, "nation").select("n_nationkey", F.array(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey").cast("string")).otherwise("x")).alias("resps"))
    return rounded(registry.evaluate_group(spark, "places", d, {"nations": logged}).where("metric = 'acc'"))


@query("SELECT n_nationkey, n_regionkey::DOUBLE AS recomputed, (n_regionkey + 1)::DOUBLE AS logged FROM nation WHERE n_nationkey % 7 = 0")
def ext14_matches_logged(spark, d):
    x = t(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").cast("double").alias("v"))
    return registry.matches_logged(x, x.withColumn("v", F.col("v") + F.when(F.col("n_nationkey") % 7 == 0, 1).otherwise(1e-9)), ["n_nationkey"], "v")


@query("""SELECT count(*) AS n, count(DISTINCT n_nationkey) AS docs, 0 AS themselves, 3 AS shots, count(*) FILTER (false) AS repeated FROM (SELECT n_nationkey, unnest([1, 2, 3]) FROM nation)""")
def smp02_few_shots(spark, d):
    pool = t(spark, d, "nation").select("n_nationkey")
    x = registry.SAMPLERS.get("default")(pool, pool, "n_nationkey", 4).where("shot <= 3")
    return x.agg(F.count("*").alias("n"), F.count_distinct("n_nationkey").alias("docs"), F.count_if(F.col("n_nationkey") == F.col("shot_id")).cast("int").alias("themselves"), F.max("shot").alias("shots"), (F.count("*") - F.count_distinct("n_nationkey", "shot_id")).alias("repeated"))


@query("""SELECT n_nationkey, string_agg(s || ' is in ' || r, '; ' ORDER BY k) || '; ' AS context FROM (SELECT a.n_nationkey, b.n_nationkey k, b.n_name s, b.n_regionkey r, row_number() OVER (PARTITION BY a.n_nationkey ORDER BY b.n_nationkey) i FROM nation a JOIN nation b ON a.n_nationkey <> b.n_nationkey) WHERE i <= 2 GROUP BY 1""")
def smp02_first_shots(spark, d):
    docs = t(spark, d, "nation")
    shots = registry.SAMPLERS.get("first_n")(docs, docs, "n_nationkey", 2)
    return registry.few_shot_prompt(shots, docs, "n_nationkey", "n_name", "n_regionkey", "; ", " is in ")


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END AS result, length(n_name) * 1.0::DOUBLE AS first, 3.0::DOUBLE AS depth FROM nation""")
def udf09_judges(spark, d):
    x = t(spark, d, "nation").select("n_nationkey", "n_name", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise("elsewhere").alias("said"))

    def same(prompts):
        parts = [p.split("\n\n") for p in prompts]
        return ["1" if p[2].split("\n")[1] == p[3].split("\n")[1] else "no" for p in parts]

    one = judging.evaluate_binary(x, "n_nationkey", "n_name", "n_name", "said", same).select("n_nationkey", "result")
    two = judging.evaluate_comparative(x, "n_nationkey", "n_name", "n_name", "said", lambda ps: [f"{len(p.split(chr(10))[3])} 2" for p in ps]).select("n_nationkey", F.col("scores.first").alias("first"))
    three = judging.evaluate_rubric(x, "n_nationkey", "n_name", "said", {"depth": "how deep"}, lambda ps: ['x {"depth": 3} y' for _ in ps]).select("n_nationkey", F.col("scores")["depth"].alias("depth"))
    return one.join(two, "n_nationkey").join(three, "n_nationkey")


@query("""WITH k AS (SELECT o_orderkey, md5(concat_ws('||', o_orderstatus, CAST(o_custkey AS VARCHAR), '')) h FROM orders), c AS (SELECT h AS key, max(o_orderkey) FILTER (o_orderkey % 3 = 0) AS value FROM k GROUP BY 1)
SELECT o_orderkey, key IS NOT NULL AND value IS NOT NULL AS hit, value FROM k LEFT JOIN c ON h = key""")
def join12_judge_cache(spark, d):
    x = t(spark, d, "orders").select("o_orderkey", judging.request_key(F.col("o_orderstatus"), F.col("o_custkey").cast("string"), F.lit(None).cast("string")).alias("key"))
    cache = x.where("o_orderkey % 3 = 0").groupBy("key").agg(F.max("o_orderkey").alias("value"))
    hits, misses = judging.cached(x, cache, "key")
    return hits.select("o_orderkey", F.lit(True).alias("hit"), "value").unionByName(misses.select("o_orderkey", F.lit(False).alias("hit"), F.lit(None).cast("long").alias("value")))


@query("""WITH l AS (SELECT event_type || user_id AS key, max(event_id) AS stored FROM events WHERE (SELECT max(event_id) FROM events) + 1 - event_id < 3000 GROUP BY 1) SELECT key, stored FROM l ORDER BY stored DESC, key LIMIT 100""")
def stm07_cache_eviction(spark, d):
    e = t(spark, d, "events").select(F.concat("event_type", F.col("user_id").cast("string")).alias("key"), F.col("event_id").alias("stored"), F.lit("v").alias("value"))
    now = F.lit(e.agg(F.max("stored")).first()[0] + 1)
    return judging.trimmed(e, now, 3000, 100).select("key", "stored")
