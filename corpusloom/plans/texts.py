"""Queries of the text functions: answers out of responses, normalisers, filters, prompts (STR-*, ARR-09, MAP-01, JSN-01, UDF-04)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import answers as A
from corpusloom.functions import text as T
from corpusloom.operators import conversations, registry, training
from corpusloom.plans.register import query, spread, t


@query("""SELECT conv_id, turn, regexp_replace('a' || chr(10) || '<image>' || chr(10) || text || '<image>', '\\n?<image>\\n?', '<|v|><|i|></v>', 'g') AS said FROM conversations""")
def str03_media_tokens(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", T.media_tokens(F.concat(F.lit("a\n<image>\n"), "text", F.lit("<image>")), "<image>", "<|v|><|i|></v>").alias("said"))


@query("""SELECT conv_id, md5('<|im_start|>system' || chr(10) || 'You help.<|im_end|>' || chr(10) || string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) || '<|im_start|>assistant' || chr(10)) AS prompt
FROM conversations GROUP BY conv_id""")
def str04_chat_prompt(spark, d):
    return conversations.gather(t(spark, d, "conversations")).select("conv_id", F.md5(T.chat_prompt(F.lit("You help."), F.col("messages"))).alias("prompt"))


@query("""SELECT conv_id, turn, concat_ws(chr(10), text, CASE WHEN role = 'assistant' THEN 'As a number.' WHEN role = 'user' THEN 'As a letter.' END, CASE WHEN turn % 2 = 0 THEN 'Think first.' END) AS prompt FROM conversations""")
def str05_typed_prompt(spark, d):
    kind = F.when(F.col("turn") % 2 == 0, "long").otherwise("normal")
    x = t(spark, d, "conversations")
    return x.select("conv_id", "turn", A.typed_prompt(F.col("text"), kind, F.col("role"), {"long": "Think first."}, {"assistant": "As a number.", "user": "As a letter."}).alias("prompt"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity % 4 AS INT) marks, CAST(l_partkey % 4 AS INT) n FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN marks > n THEN 'q0' || array_to_string(list_transform(range(1, n + 1), lambda i: '<image>q' || i), '') ELSE 'q0' || array_to_string(list_transform(range(1, marks + 1), lambda i: '<image>q' || i), '') END AS problem,
 least(marks, n) AS images, repeat('<image>', greatest(n - marks, 0)) || 'q0' || array_to_string(list_transform(range(1, marks + 1), lambda i: '<image>q' || i), '') AS prepended, CASE WHEN l_linenumber = 1 THEN '<image>' || chr(10) || 'x' ELSE 'x<image>' END AS broken FROM r""")
def str06_reconcile_images(spark, d):
    x = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") % 4).cast("int").alias("marks"), (F.col("l_partkey") % 4).cast("int").alias("n"))
    numbers = F.filter(F.sequence(F.lit(0), F.lit(3)), lambda i: i >= 0)
    problem = F.array_join(F.transform(F.filter(numbers, lambda i: i <= F.col("marks")), lambda i: F.concat(F.lit("q"), i.cast("string"))), "<image>")
    images = F.transform(F.filter(numbers, lambda i: i < F.col("n")), lambda i: i.cast("string"))
    cut, left = conversations.reconcile_images(F.col("p"), F.col("i"))
    rows = x.select("*", problem.alias("p"), images.alias("i"))
    lead = A.newline_after_image(F.when(F.col("l_linenumber") == 1, "<image>x").otherwise("x<image>"))
    return rows.select("l_orderkey", "l_linenumber", cut.alias("problem"), F.size(left).alias("images"), conversations.prepend_marks(F.col("p"), F.col("i")).alias("prepended"), lead.alias("broken"))


@query("""SELECT conv_id, turn, CAST(turn AS VARCHAR) || chr(10) || role AS tagged, role AS boxed, CASE WHEN turn % 2 = 0 THEN role ELSE 'no mark' END AS either FROM conversations""")
def str08_tagged_answers(spark, d):
    x = t(spark, d, "conversations")
    tagged = F.concat(F.lit("<answer>first</answer> then <answer>"), F.col("turn").cast("string"), F.lit("\n"), "role", F.lit("</answer> end"))
    boxed = F.concat(F.lit("so \\boxed{"), "role", F.lit("} it is"))
    return x.select("conv_id", "turn", T.tagged_answer(tagged).alias("tagged"), T.boxed(boxed).alias("boxed"), T.answer_or_text(F.when(F.col("turn") % 2 == 0, boxed).otherwise("no mark")).alias("either"))


@query("""WITH r AS (SELECT page_id, coalesce(html, '') h FROM pages), e AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'x <answer> ' || h || ' </answer>' WHEN page_id % 3 = 1 THEN h ELSE 'Here: ```html' || chr(10) || 'body' || page_id || chr(10) || '```' END h FROM r),
c AS (SELECT page_id, regexp_replace(coalesce(regexp_extract_all(h, '(?s)<answer>(.*?)</answer>', 1)[-1], regexp_extract_all(h, '(?si)((?:<!DOCTYPE html>|<html>).*?(?:</html>|$))', 1)[-1], regexp_extract_all(h, '(?s)```(?:html)?\\s*(.*?)```', 1)[-1], h), '^\\s+|\\s+$', '', 'g') c FROM e)
SELECT page_id, md5(c) AS code, md5(lower(trim(regexp_replace(replace(regexp_replace(c, '\\s+', ' ', 'g'), '"', ''''), '(?s)<!--.*?-->', '', 'g'), ' '))) AS normal FROM c""")
def str09_html_code(spark, d):
    h = F.coalesce("html", F.lit(""))
    kind = F.col("page_id") % 3
    told = F.when(kind == 0, F.concat(F.lit("x <answer> "), h, F.lit(" </answer>"))).when(kind == 1, h).otherwise(F.concat(F.lit("Here: ```html\nbody"), F.col("page_id").cast("string"), F.lit("\n```")))
    code = t(spark, d, "pages").select("page_id", A.html_code(told).alias("c"))
    return code.select("page_id", F.md5("c").alias("code"), F.md5(A.html_normal(F.col("c"))).alias("normal"))


@query("""SELECT s_suppkey, s_name || '{' || s_suppkey || '{}}' AS boxed, 'f' || s_suppkey AS fbox, 'x ' AS spaced, CAST(NULL AS VARCHAR) AS open FROM supplier""")
def str11_balanced_box(spark, d):
    x = t(spark, d, "supplier")
    inner = F.concat("s_name", F.lit("{"), F.col("s_suppkey").cast("string"), F.lit("{}}"))
    box = F.concat(F.lit("\\boxed{no} and \\boxed{"), inner, F.lit("} done }"))
    return x.select("s_suppkey", A.boxed_content(box).alias("boxed"), A.boxed_content(F.concat(F.lit("\\fbox{f"), F.col("s_suppkey").cast("string"), F.lit("}"))).alias("fbox"), A.boxed_content(F.lit("\\boxed x $ y")).alias("spaced"), A.boxed_content(F.lit("\\boxed{a{b}")).alias("open"))


@query("""SELECT c_custkey, lower(replace(c_name, '#', ' # ')) || ' 2 don''t ' || c_custkey AS normal FROM customer""")
def str12_vqa_normalise(spark, d):
    text = F.concat(F.lit("The "), F.replace("c_name", F.lit("#"), F.lit(" # ")), F.lit(" two dont, "), F.col("c_custkey").cast("string"), F.lit("."))
    return t(spark, d, "customer").select("c_custkey", A.vqa_normalise(text).alias("normal"))


_ASR = "regexp_replace(regexp_replace(text || ' <|en|> done .', '<\\|.*?\\|>', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')"


@query(f"""SELECT conv_id, turn, md5(ltrim(regexp_replace({_ASR}, ' ?([!,.?;:])', '\\1', 'g'), ' ')) AS english, md5(regexp_replace(ltrim(regexp_replace({_ASR}, ' ?([!,.?;:])', '\\1', 'g'), ' '), ' +', '', 'g')) AS chinese,
md5(array_to_string(list_filter(string_split(text || ' ... a!', ' '), lambda w: regexp_matches(w, '[^\\pP]')), ' ')) AS words FROM conversations""")
def str14_asr_clean(spark, d):
    said = F.concat("text", F.lit(" <|en|> done ."))
    return t(spark, d, "conversations").select("conv_id", "turn", F.md5(A.asr_clean(said)).alias("english"), F.md5(A.asr_clean(said, "zh")).alias("chinese"), F.md5(A.without_punctuation_words(F.concat("text", F.lit(" ... a!")))).alias("words"))


@query("""WITH r AS (SELECT conv_id, turn, [' ' || role, 'Answer: ' || turn || ', or ' || conv_id, role] a FROM conversations)
SELECT conv_id, turn, list_transform(a, lambda x: CASE WHEN x[1] = ' ' THEN x[2:] ELSE x END) AS stripped, list_transform(a, lambda x: upper(x)) AS upper, list_transform(a, lambda x: lower(x)) AS lower,
list_transform(a, lambda x: CASE x WHEN 'user' THEN 'U' WHEN 'assistant' THEN 'A' ELSE '?' END) AS mapped, a[1:2] AS two, a[1] AS first, [CASE WHEN role = 'user' THEN ' user' ELSE ' assistant' END] AS majority,
list_transform(a, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN regexp_extract_all(x, '([0-9]+)', 1)[-1] ELSE '[invalid]' END) AS last_number,
list_transform(a, lambda x: CASE WHEN regexp_matches(x, '(or (\\d+))|(us(er))') THEN trim(regexp_extract(x, 'or \\d+|user')) ELSE 'none' END) AS grouped
FROM (SELECT r.*, role FROM r JOIN (SELECT conv_id, turn, role FROM conversations WHERE role IN ('user', 'assistant')) c USING (conv_id, turn))""")
def str20_response_filters(spark, d):
    x = t(spark, d, "conversations").where(F.col("role").isin("user", "assistant"))
    x = x.withColumn("a", F.array(F.concat(F.lit(" "), "role"), F.concat(F.lit("Answer: "), F.col("turn").cast("string"), F.lit(", or "), F.col("conv_id").cast("string")), F.col("role")))
    a = F.col("a")
    return x.select("conv_id", "turn", A.strip_leading_space(a).alias("stripped"), A.upper_all(a).alias("upper"), A.lower_all(a).alias("lower"), A.map_all(a, {"user": "U", "assistant": "A"}, "?").alias("mapped"),
        A.take_first_k(a, 2).alias("two"), T.take_first(a).alias("first"), A.majority_vote(a).alias("majority"), A.regex_groups(a, r"([0-9]+)", -1).alias("last_number"), A.regex_groups(a, r"(or (?:\d+))|(us(?:er))", 0, "none").alias("grouped"))


@query("""SELECT n_nationkey, [CASE WHEN n_nationkey % 3 = 2 THEN '(' || chr(65 + (n_nationkey % 5)::INT) || ')' WHEN n_nationkey % 3 = 1 THEN '7' ELSE '(' || chr(65 + n_regionkey::INT) || ')' END, '[invalid]'] AS chosen, chr(65 + n_regionkey::INT) AS simple,
 r_name AS choice, chr(65 + n_regionkey::INT) AS letter FROM nation JOIN region ON n_regionkey = r_regionkey""")
def str18_multi_choice(spark, d):
    regions = t(spark, d, "region").agg(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("r")).select(F.transform("r", lambda x: x["r_name"]).alias("choices"))
    x = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).join(F.broadcast(regions))  # five regions
    letter = F.chr(F.lit(65) + F.col("n_nationkey") % 5)
    said = F.when(F.col("n_nationkey") % 3 == 2, F.concat(F.lit("the answer: "), letter)).when(F.col("n_nationkey") % 3 == 1, "well, #### 7").otherwise(F.concat(F.lit("It lies in "), F.lower("r_name"), F.lit("!")))
    listed = F.array_join(F.transform("choices", lambda c, i: F.concat(F.chr(i + 65), F.lit(". "), c)), "\n")
    rows = x.select("n_nationkey", "r_name", "choices", "n_regionkey", F.array(said, F.lit("no idea")).alias("resps"), F.array(F.concat(F.lit("It is "), "r_name", F.lit("."))).alias("plain"), F.concat(F.lit("Where?\n"), listed).alias("question"))
    chosen = A.multi_choice(F.col("resps"), F.col("choices"), ignore_case=True, ignore_punctuation=True)
    return rows.select("n_nationkey", chosen.alias("chosen"), A.simple_choice(F.col("plain"), F.col("question")).alias("simple"), A.choice_text(F.chr(F.col("n_regionkey") + 65), F.col("choices")).alias("choice"), A.choice_letter(F.col("r_name"), F.col("choices")).alias("letter"))


@query("""WITH r AS (SELECT c_custkey, ['Yes, no doubt', 'No. yes', 'nothing', 'it is B, not A', 'a', 'yesterday no'][1 + CAST(c_custkey % 6 AS INT)] s FROM customer)
SELECT c_custkey, CASE s WHEN 'Yes, no doubt' THEN 1 WHEN 'No. yes' THEN 0 WHEN 'yesterday no' THEN 0 ELSE -1 END AS yes_no, CASE s WHEN 'it is B, not A' THEN 0 WHEN 'a' THEN 1 ELSE -1 END AS a_or_b,
 CASE WHEN s IN ('Yes, no doubt', 'yesterday no') THEN 'yes' WHEN s IN ('No. yes', 'nothing') THEN 'no' ELSE 'other' END AS parsed, CASE s WHEN 'a' THEN 'a' END AS letter FROM r""")
def str23_first_position(spark, d):
    s = F.element_at(F.array(*map(F.lit, ("Yes, no doubt", "No. yes", "nothing", "it is B, not A", "a", "yesterday no"))), (F.col("c_custkey") % 6 + 1).cast("int"))
    return t(spark, d, "customer").select("c_custkey", s.alias("s")).select("c_custkey", A.first_position(F.col("s")).alias("yes_no"), A.first_position(F.col("s"), "A", "B").alias("a_or_b"), T.yes_no(F.col("s")).alias("parsed"), T.option_letter(F.col("s")).alias("letter"))


@query("""SELECT o_orderkey, '{' || o_orderkey || '}' AS braced, '{' || o_custkey || '}' AS bare, 'none' AS none, CAST(o_totalprice AS DOUBLE) AS first, 0.0::DOUBLE AS absent,
 'C' || o_orderkey || '.O' AS smiles, 'CC' || o_custkey AS last_word, 'H2' AS formula FROM orders""")
def str25_numbers_and_tags(spark, d):
    o, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    return t(spark, d, "orders").select(
        "o_orderkey", A.braced_number(F.concat(F.lit("x 5 {"), o, F.lit("} {6}"))).alias("braced"), A.braced_number(F.concat(F.lit("about "), c, F.lit(" of 9"))).alias("bare"), A.braced_number(F.lit(" none ")).alias("none"),
        T.first_number(F.concat(F.lit("costs "), F.col("o_totalprice").cast("decimal(20,2)").cast("string"), F.lit(" or 3"))).alias("first"), T.first_number(F.lit("nothing")).alias("absent"),
        A.smiles(F.concat(F.lit("It is <smiles> C"), o, F.lit(";O </SMILES> x"))).alias("smiles"), A.smiles(F.concat(F.lit("the answer is CC"), c, F.lit("."))).alias("last_word"), A.tag_content(F.lit("a <MOLFORMULA> H2"), ("MOLFORMULA", "FORMULA")).alias("formula"),
    )


@query("""SELECT l_orderkey, l_linenumber, CAST(l_quantity AS VARCHAR) LIKE '%1%' AS said_one, l_linenumber % 2 = 0 AS said_yes, least(10.0::DOUBLE, greatest(1.0, l_quantity)) AS score, 1.0::DOUBLE AS unknown,
 CAST(l_linenumber AS DOUBLE) AS one, CAST(l_suppkey AS DOUBLE) AS two, -1.0::DOUBLE AS none, l_linenumber AS parsed FROM lineitem""")
def str28_judge_parsers(spark, d):
    number = F.col("l_quantity").cast("string")
    pair = A.judged_pair(F.concat(F.lit("\n"), F.col("l_linenumber").cast("string"), F.lit(";"), F.col("l_suppkey").cast("string"), F.lit(" 99\n7 8")))
    told = F.concat(F.lit('Sure: ```json\n{"score": '), F.col("l_linenumber").cast("string"), F.lit(', "why": "a {b}"}\n``` ok'))
    return t(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (A.judged_binary(F.concat(F.lit("it is "), number)) == 1).alias("said_one"), (A.judged_binary(F.when(F.col("l_linenumber") % 2 == 0, " YES, fine").otherwise("no"), True) == 1).alias("said_yes"),
        A.judged_score(F.concat(F.lit("score: "), number, F.lit(" of 100")), 1, 10).alias("score"), A.judged_score(F.lit("who knows"), 1, 10).alias("unknown"),
        pair["first"].alias("one"), pair["second"].alias("two"), A.judged_pair(F.lit("only 3"))["first"].alias("none"), F.get_json_object(A.json_part(told), "$.score").cast("int").alias("parsed"),
    )


@query("""SELECT n_nationkey, 'Decide whether the prediction agrees with the reference answer. Say 1 if it does and 0 if it does not.' || chr(10) || chr(10) || '[Question]' || chr(10) || 'Where is ' || n_name || '?' || chr(10) || chr(10) || '[Reference]' || chr(10) || r_name || chr(10) || chr(10) || '[Prediction]' || chr(10) || 'there' AS prompt,
 'Question: a Short answer: b' || chr(10) || 'Question: Where is ' || n_name || '? Short answer:' AS flat, 'Where is ' || n_name || '?' AS base FROM nation JOIN region ON n_regionkey = r_regionkey""")
def str29_prompts(spark, d):
    x = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    asked = F.concat(F.lit("Where is "), "n_name", F.lit("?"))
    history = F.array(F.struct(F.lit("a").alias("query"), F.lit("b").alias("response")))
    return x.select("n_nationkey", A.judge_prompt("binary", question=asked, reference=F.col("r_name"), prediction=F.lit("there")).alias("prompt"), A.history_prompt(history, asked, "vqa").alias("flat"), A.history_prompt(history, asked, "base").alias("base"))


_PTB = "x"
for _a, _b in ((" ''", "''"), (" ' || chr(10) || '", "' || chr(10) || '"), ("' || chr(10) || ' ", "' || chr(10) || '"), (" n''t", "n''t"), (" N ", "1 "), ("$ 1", "$1"), ("# 1", "#1")):
    _PTB = f"replace({_PTB}, '{_a}', '{_b}')"
_WIKI = "replace(x, 's ''', 's''')"
for _a, _b in ((" @-@ ", "-"), (" @,@ ", ","), (" @.@ ", "."), (" : ", ": "), (" ; ", "; "), (" . ", ". "), (" ! ", "! "), (" ? ", "? "), (" , ", ", ")):
    _WIKI = f"replace({_WIKI}, '{_a}', '{_b}')"
for _a, _b in ("()", "[]", "{}", '""'):
    _WIKI = f"regexp_replace({_WIKI}, '\\{_a}\\s*([^\\{_b}]*?)\\s*\\{_b}', '{_a}\\1{_b}', 'g')"
_WIKI = f"regexp_replace({_WIKI}, '''\\s*([^'']*?)\\s*''', '''\\1''', 'g')"
for _a, _b in (("= = = =", "===="), ("= = =", "==="), ("= =", "=="), (" ° ", "°"), (" ' || chr(10) || '", "' || chr(10) || '"), ("' || chr(10) || ' ", "' || chr(10) || '"), (" N ", " 1 "), (" ''s", "''s")):
    _WIKI = f"replace({_WIKI}, '{_a}', '{_b}')"
_SPACED = "text || ' do n''t , it ''s ( a b ) = = h = = 3 @.@ 5 $ 1 N x ; \" q \" '"


@query(f"SELECT conv_id, turn, md5({_PTB}) AS ptb, md5({_WIKI}) AS wiki FROM (SELECT conv_id, turn, {_SPACED} x FROM conversations)")
def str30_detokenise(spark, d):
    x = t(spark, d, "conversations").select("conv_id", "turn", F.concat("text", F.lit(" do n't , it 's ( a b ) = = h = = 3 @.@ 5 $ 1 N x ; \" q \" ")).alias("x"))
    return x.select("conv_id", "turn", F.md5(A.detokenise(F.col("x"), "ptb")).alias("ptb"), F.md5(A.detokenise(F.col("x"), "wikitext")).alias("wiki"))


@query("""SELECT n_nationkey, true AS holds, n_name LIKE '%AN%' AS pattern, n_regionkey = 0 AS other, true AS words FROM nation""")
def str31_has_answer(spark, d):
    text = F.concat(F.lit("The Café of "), "n_name", F.lit(", land of "), F.when(F.col("n_regionkey") == 0, "lions").otherwise("bears"))
    return t(spark, d, "nation").select("n_nationkey", A.has_answer(text, F.array(F.lit("nowhere"), F.lower("n_name"))).alias("holds"), A.has_answer(F.col("n_name"), F.array(F.lit("[bad"), F.lit("an")), regex=True).alias("pattern"), A.has_answer(text, F.array(F.lit("lion"), F.lit("LIONS"))).alias("other"), T.contains_words(text, F.col("n_name")).alias("words"))


@query("""SELECT p_partkey, '\\alpha  + \\Omega ' || p_size AS greek, '\\overline{a}' || p_size AS macron, 'x' || p_size AS plain, '\\overline{b_1}' AS joined, 'café ' || p_size || ' "it''s"' AS fixed FROM part""")
def str32_latex_and_mojibake(spark, d):
    n = F.col("p_size").cast("string")
    return spread(t(spark, d, "part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", A.latex_normal(F.concat(F.lit("α + Ω"), n)).alias("greek"), A.latex_normal(F.concat(F.lit("ā"), n)).alias("macron"), A.latex_normal(F.concat(F.lit("\\begin{align}\\[x"), n, F.lit("\\]\\end{align}"))).alias("plain"),
        A.latex_normal(F.lit("\\bar{b}_1")).alias("joined"), A.fix_mojibake(F.concat(F.lit("cafÃ© "), n, F.lit(" “it’s”"))).alias("fixed"))


@query("""WITH r AS (SELECT conv_id, turn, [role, CASE role WHEN 'user' THEN 'human' ELSE 'gpt' END, 'tool'] a FROM conversations)
SELECT conv_id, turn, CASE role WHEN 'user' THEN 'user' ELSE 'assistant' END AS second, 'tool' AS third, role AS first FROM conversations""")
def str34_roles(spark, d):
    x = t(spark, d, "conversations")
    roles = F.array(F.col("role"), F.when(F.col("role") == "user", "human").otherwise("gpt"), F.lit("tool"))
    named = conversations.renamed_roles(F.transform(roles, lambda r: F.struct(r.alias("role"), F.lit("x").alias("content"))))
    return x.select("conv_id", "turn", named[1]["role"].alias("second"), named[2]["role"].alias("third"), named[0]["role"].alias("first"))


@query("""SELECT l_orderkey, l_linenumber, CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber AS truth, 'a_' || l_linenumber AS key, CASE WHEN l_linenumber = 1 THEN 'video' WHEN l_linenumber = 2 THEN 'image' ELSE 'text' END AS media,
 CASE WHEN l_linenumber = 1 THEN 'unknown' ELSE 'set_' || l_linenumber END AS folder, 'c' || l_linenumber || '.jpg' AS image FROM lineitem""")
def prj07_projections(spark, d):
    k, n = F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")
    literal = F.concat(F.lit("{'style': 'rule', 'ground_truth': '"), k, F.lit("-"), n, F.lit("'}"))
    shard = F.when(F.col("l_linenumber") == 1, "noshard").otherwise(F.concat(F.lit("/d/set_"), n, F.lit("_000001")))
    video, image = F.when(F.col("l_linenumber") == 1, "v"), F.when(F.col("l_linenumber") <= 2, "i")
    none = F.expr("cast(array() AS array<struct<content:string,role:string>>)")
    x = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", literal.alias("g"), F.concat(F.lit("/a/b/c"), n, F.lit(".jpg")).alias("path"), n.alias("n"), shard.alias("s"), video.alias("v"), image.alias("i"), none.alias("massages:"))
    pairs = F.regexp_extract("path", r"([^/]*)$", 1)
    return x.select("l_orderkey", "l_linenumber", training.ground_truth(F.col("g")).alias("truth"), training.sample_key(F.concat(F.lit("a."), "n"), F.col("path")).alias("key"), training.media_kind(F.col("v"), F.col("i")).alias("media"), training.shard_folder(F.col("s")).alias("folder"), pairs.alias("image"))


@query("""WITH r AS (SELECT conv_id, min(CASE WHEN role = 'user' THEN turn END) u FROM conversations GROUP BY 1)
SELECT conv_id, ['t' || conv_id] AS answer, coalesce(CASE WHEN text LIKE '%<image>%' AND NOT starts_with(text, '<image>' || chr(10)) THEN text[:instr(text, '<image>') + 6] || chr(10) || text[instr(text, '<image>') + 7:] ELSE text END, '') AS problem, 'judge' AS answer_type, 'long' AS prompt_type, 'general' AS problem_type
FROM r LEFT JOIN (SELECT conv_id, turn, '<image>' || text AS text FROM conversations) c USING (conv_id) WHERE c.turn = u OR (u IS NULL AND c.turn = 0)""".replace("coalesce(CASE", "coalesce(CASE WHEN u IS NULL THEN '' ELSE CASE").replace("ELSE text END, '')", "ELSE text END END, '')"))
def prj02_judge_rows(spark, d):
    x = conversations.gather(t(spark, d, "conversations").withColumn("text", F.concat(F.lit("<image>"), "text")))
    rows = x.select("conv_id", F.col("messages").alias("prompt"), F.concat(F.lit('{"ground_truth": "t'), F.col("conv_id").cast("string"), F.lit('"}')).alias("reward_model"))
    out = training.without_columns(training.judge_rows(rows))
    return out.select("conv_id", "answer", "problem", "answer_type", "prompt_type", "problem_type")


@query("""SELECT conv_id, turn, ['#### ' || turn] AS flexible, [role] AS strict, role AS scored FROM conversations""")
def udf04_filter_pipelines(spark, d):
    x = t(spark, d, "conversations").withColumn("resps", F.array(F.concat(F.lit(" "), F.upper("role")), F.concat(F.lit("#### "), F.col("turn").cast("string"))))
    x = registry.apply_filters(x, "strict", [("remove_whitespace", {}), ("lowercase", {}), ("take_first", {})])
    x = registry.apply_filters(x, "flexible", [(lambda: lambda r, row: F.slice(r, 2, 1), {})])
    return x.select("conv_id", "turn", F.col("filtered_resps")["flexible"].alias("flexible"), F.col("filtered_resps")["strict"].alias("strict"), F.col("filtered_resps")["strict"][0].alias("scored"))
