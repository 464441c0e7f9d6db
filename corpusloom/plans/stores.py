"""Queries that write to the shared folder and read back: sources, sinks, shards, caches, streams (SRC-*, SNK-*, FLT-24..26, UDF-07, UDF-10, STM-*, EXT-07, EXT-08, EXT-10, EXT-11, EXT-22, RTR-06, RTR-07).

What a query writes lies in a folder of its own below the shared one, as its result reads it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.operators import judging, retrieval
from corpusloom.operators.storage import ranked, settle, shared_folder
from corpusloom.plans.register import query, spread, t
from corpusloom.sources import adapters, readers, shards, tar_store, writers
from corpusloom.streaming import iterate, stateful


def folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/corpusloom-{name}-{uuid.uuid4().hex}"


@query("SELECT conv_id, turn, role, text FROM conversations")
def src01_json_lines(spark, d):
    path = folder(spark, "lines") + ".jsonl"
    writers.write_jsonl(t(spark, d, "conversations").select("conv_id", "turn", "role", "text"), path)
    return readers.read(spark, path).select("conv_id", "turn", "role", "text")


@query("SELECT n_nationkey, n_name FROM nation")
def src02_json_array(spark, d):
    path = folder(spark, "array") + ".json"
    rows = t(spark, d, "nation").select("n_nationkey", "n_name").agg(F.to_json(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name")))).alias("value"))  # 25 rows
    rows.coalesce(1).write.text(path)
    return readers.read_json_array(spark, path).select("n_nationkey", "n_name")


@query("SELECT url FROM pages WHERE url IS NOT NULL")
def src03_url_lists(spark, d):
    path = folder(spark, "urls") + ".txt"
    t(spark, d, "pages").where("url IS NOT NULL").select("url").write.text(path)
    return readers.read(spark, path).withColumnRenamed("value", "url")


@query("""SELECT 'tsv' AS kind, CAST(s_suppkey AS VARCHAR) AS k, s_name AS v FROM supplier UNION ALL SELECT 'parts', CAST(s_suppkey AS VARCHAR), s_name FROM supplier UNION ALL SELECT 'prefix', CAST(s_suppkey AS VARCHAR), s_name FROM supplier UNION ALL SELECT 'percent', 'n', CAST(greatest(1, count(*) * 25 // 100) AS VARCHAR) FROM supplier
UNION ALL SELECT 'blocks', 'n', CAST(count(*) // 2 AS VARCHAR) FROM supplier""")
def src16_file_forms(spark, d):
    x = t(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("k"), F.col("s_name").alias("v"))
    tsv, nested = folder(spark, "tab") + ".tsv", folder(spark, "nested")
    x.write.option("header", True).option("sep", "\t").csv(tsv)
    x.where("k % 2 = 0").coalesce(1).write.parquet(f"{nested}/a/b")
    x.where("k % 2 = 1").coalesce(1).write.parquet(f"{nested}/c")
    flat = folder(spark, "flat")
    x.coalesce(1).write.parquet(flat)
    named = lambda df, kind: df.select(F.lit(kind).alias("kind"), "k", "v")
    counted = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.lit("n").alias("k"), F.count("*").cast("string").alias("v"))
    out = named(readers.read(spark, tsv), "tsv").unionByName(named(readers.read(spark, nested), "parts")).unionByName(named(readers.read_object_store(spark, flat), "prefix"))
    return out.unionByName(counted(readers.read(spark, f"{flat}[25%]", "k"), "percent")).unionByName(counted(readers.read_blocks(spark, flat, 0.5), "blocks"))


@query("""SELECT p_name || '_' || p_partkey AS name, CAST(p_size AS INT) AS token_len FROM part""")
def src12_token_info(spark, d):
    path = folder(spark, "info")
    x = t(spark, d, "part").select(F.concat("p_name", F.lit("_"), F.col("p_partkey").cast("string"), F.lit(":"), F.col("p_size").cast("string")).alias("value"))
    x.unionByName(x.limit(1).select(F.lit("no number").alias("value"))).write.text(path)
    return readers.read_token_info(spark, path)


@query("""SELECT conv_id, CAST(count(*) AS INT) AS n FROM conversations GROUP BY 1 UNION ALL SELECT -1, NULL""")
def src13_messages(spark, d):
    from corpusloom.operators import conversations

    path = folder(spark, "messages")
    x = conversations.gather(t(spark, d, "conversations").withColumn("text", F.when(F.col("turn") == 0, F.col("conv_id").cast("string")).otherwise("x")))
    lines = x.select(F.to_json(F.struct("messages")).alias("value"))
    lines.unionByName(lines.limit(1).select(F.lit("{broken").alias("value"))).write.text(path)
    return readers.read_messages(spark, path).select(F.coalesce(F.col("messages")[0]["content"].cast("long"), F.lit(-1)).alias("conv_id"), F.when(F.col("messages").isNotNull(), F.size("messages")).alias("n"))


@query("""SELECT n_nationkey AS sample_id, CASE WHEN n_nationkey % 2 = 0 THEN 'first' ELSE 'second' END AS answer FROM nation""")
def src20_first_predictions(spark, d):
    path = folder(spark, "predictions")
    x = t(spark, d, "nation").select(F.col("n_nationkey").alias("sample_id"))
    x.where("sample_id % 2 = 0").withColumn("answer", F.lit("first")).coalesce(1).write.json(f"{path}/a")
    x.withColumn("answer", F.lit("second")).coalesce(1).write.json(f"{path}/b")
    return readers.first_predictions(spark, f"{path}/a,{path}/b").select("sample_id", "answer")


@query("""SELECT 'reasoning' AS source, n_name AS image, CASE n_nationkey % 3 WHEN 0 THEN 'q <image>' WHEN 1 THEN ' <image>' || chr(10) || 'q' ELSE 'q<image>r' END AS problem, CASE WHEN n_nationkey % 2 = 0 THEN 'C' ELSE n_name END AS answer, CASE WHEN n_nationkey % 2 = 0 THEN 'multiple-choice' ELSE 'math-expressions' END AS answer_type, CASE WHEN n_regionkey = 0 THEN 'spatial-reasoning' ELSE 'stem' END AS problem_type FROM nation
UNION ALL SELECT 'counting', n_name, '<image>' || chr(10) || 'How many suns are there?', CAST(n_regionkey AS VARCHAR), 'number', 'counting' FROM nation UNION ALL SELECT 'choices', n_name, '<image>' || chr(10) || 'which', 'A', 'multiple-choice', 'general' FROM nation""")
def src19_adapters(spark, d):
    n = t(spark, d, "nation")
    k = F.col("n_nationkey")
    reason = n.select(F.array("n_name").alias("image"), F.when(k % 3 == 0, "q <image>").when(k % 3 == 1, "q").otherwise("q<image>r<image>s").alias("question"), F.when(k % 2 == 0, " c").otherwise(F.concat(F.lit("\\boxed{"), "n_name", F.lit("}"))).alias("answer"), F.when(F.col("n_regionkey") == 0, "Spatial Reasoning").otherwise("x").alias("category"))
    count = n.select(F.col("n_name").alias("image"), F.lit("suns").alias("label"), F.col("n_regionkey").alias("count"))
    pick = n.select(F.col("n_name").alias("image"), F.lit("which").alias("question"), F.lit("A").alias("answer"))
    out = readers.adapt_all({"reasoning": ("reasoning", reason), "counting": ("counting", count), "choices": ("choices", pick)})
    return out.select("source", F.col("images")[0].alias("image"), "problem", F.col("answer")[0].alias("answer"), "answer_type", "problem_type")


@query("""SELECT 'diagrams' AS source, 'i' || n_nationkey AS image, '<image>' || chr(10) || 'Which ' || n_name || '?' AS problem, CASE WHEN n_nationkey % 2 = 0 THEN 'B' ELSE n_name END AS answer, CASE WHEN n_nationkey % 2 = 0 THEN 'multiple-choice' ELSE 'any' END AS answer_type, 'normal' AS prompt_type FROM nation
UNION ALL SELECT 'documents', 'i' || n_nationkey, '<image>' || chr(10) || n_name, n_name || '|x', 'ocrtext', 'long' FROM nation
UNION ALL SELECT 'problems', 'i' || n_nationkey, '<image>' || chr(10) || n_name || CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE chr(10) || 'Options:' || chr(10) || 'A. one' || chr(10) || 'B. ' || n_name || chr(10) END, 'B', CASE WHEN n_nationkey % 3 = 0 THEN 'math-expressions' ELSE 'multiple-choice' END, 'long' FROM nation
UNION ALL SELECT 'spatial', 'i' || n_nationkey, '<image>' || chr(10) || n_name, n_nationkey || '', 'number', 'long' FROM nation""")
def src19_more_adapters(spark, d):
    n = t(spark, d, "nation").withColumn("image", F.concat(F.lit("i"), F.col("n_nationkey").cast("string")))
    k = F.col("n_nationkey")
    diagrams = n.select(F.array("image").alias("images"), F.array(F.struct(F.concat(F.lit(" Which "), "n_name", F.lit("?\nAnswer with the letter.")).alias("user"), F.when(k % 2 == 0, "Answer: B").otherwise(F.concat(F.lit("Answer: "), "n_name")).alias("assistant"))).alias("texts"))
    diagrams = diagrams.withColumn("texts", F.transform("texts", lambda x: F.struct(F.replace(x["user"], F.lit("\n"), F.lit("")).alias("user"), x["assistant"].alias("assistant"))))
    documents = n.select("image", F.col("n_name").alias("question"), F.array("n_name", F.lit("x")).alias("answers"))
    problems = n.select(F.col("image").alias("decoded_image"), F.col("n_name").alias("question"), F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("one"), F.col("n_name"))).alias("options"), F.lit("B").alias("answer"))
    spatial = n.select(F.array("image").alias("image_paths"), F.concat(F.lit("Question: "), "n_name", F.lit(" Answer Choices:\nA. none\nB. "), k.cast("string")).alias("problem"), k.cast("string").alias("answer"))
    out = adapters.adapt_all({"diagrams": ("diagrams", diagrams), "documents": ("documents", documents), "problems": ("problems", problems), "spatial": ("spatial", spatial)})
    # Half of the spatial ones ask for the letter, whichever a hash says; put back into the other form here.
    listed = (F.col("source") == "spatial") & (F.col("answer_type") == "multiple-choice")
    lines = F.split("problem", "\n")
    return out.select(
        "source", F.col("images")[0].alias("image"), F.when(listed, F.concat_ws("\n", lines[0], lines[1])).otherwise(F.col("problem")).alias("problem"),
        F.when(listed & (F.col("answer")[0] == "B"), F.substring(lines[4], 5, 100)).otherwise(F.array_join("answer", "|")).alias("answer"), F.when(listed, "number").otherwise(F.col("answer_type")).alias("answer_type"), "prompt_type",
    )


@query("""SELECT p_partkey, '[' || CAST(p_size AS DOUBLE) / 100 || ', 0.0, ' || CAST(p_size + 50 AS DOUBLE) / 100 || ', 1.0]' AS answer, 'bbox' AS kind FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, '{"tests":"t' || p_partkey || '"}', 'general-code' FROM part WHERE p_partkey % 3 = 0""")
def flt21_adapters(spark, d):
    p = t(spark, d, "part")
    size = F.col("p_size").cast("double")
    boxes = p.where("p_size % 2 = 0").select(F.col("p_partkey").cast("string").alias("file_name"), F.lit("A Thing").alias("caption"), F.array(size, F.lit(0.0), F.lit(50.0), F.lit(1.0)).alias("bbox"), F.lit(100.0).alias("width"), F.lit(1.0).alias("height"))
    programs = p.select(F.col("p_partkey").cast("string").alias("description"), F.lit("i").alias("input_format"), F.lit("o").alias("output_format"), F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("official_tests"), F.when(F.col("p_partkey") % 3 != 0, "c").alias("generated_checker"))
    one = readers.adapt_grounding(boxes).select(F.col("images")[0].cast("long").alias("p_partkey"), F.col("answer")[0].alias("answer"), F.col("answer_type").alias("kind"))
    two = readers.adapt_programs(programs).select(F.substring_index("problem", "\n", 1).cast("long").alias("p_partkey"), F.col("answer")[0].alias("answer"), F.col("answer_type").alias("kind"))
    return one.unionByName(two)


@query("""SELECT CAST(n_nationkey AS BIGINT) AS uid, trim(regexp_replace(n_name, ' +', ' ', 'g')) AS text_a, 'b. c' AS text_b, CAST(n_nationkey % 3 AS INT) AS label FROM nation""")
def ext07_pairs(spark, d):
    path = folder(spark, "pairs")
    k = F.col("n_nationkey")
    columns = [k.cast("string"), *[F.lit("x")] * 7, "n_name", F.lit("b . c"), F.lit("y"), F.when(k % 3 == 0, "contradiction").when(k % 3 == 1, "entailment").otherwise("neutral")]
    rows = t(spark, d, "nation").select(F.concat_ws("\t", *columns).alias("value"), F.lit(1).alias("o"))
    head = t(spark, d, "region").limit(1).select(F.lit("index\tx\tx\tx\tx\tx\tx\tx\ta\tb\ty\tgold").alias("value"), F.lit(0).alias("o"))
    head.unionByName(rows).coalesce(1).sortWithinPartitions("o").select("value").write.text(path)
    return readers.read_pairs_tsv(spark, path, {"contradiction": 0, "entailment": 1, "neutral": 2})


@query("""SELECT CAST(q AS INT) AS uid, n_name AS article, CAST(o AS INT) AS option, CASE WHEN q = 0 THEN 'is ' || ['a', 'b', 'c', 'd'][o + 1] || ' so' ELSE 'why? ' || ['a', 'b', 'c', 'd'][o + 1] END AS text, CAST(CASE q WHEN 0 THEN n_regionkey % 4 ELSE 2 END AS INT) AS label FROM nation, range(2) x(q), range(4) y(o)""")
def ext08_reading_tests(spark, d):
    path = folder(spark, "tests")
    options = F.array(*[F.array(*map(F.lit, "abcd"))] * 2)
    t(spark, d, "nation").select(F.col("n_name").alias("article"), F.array(F.lit("is _ so"), F.lit("why?")).alias("questions"), options.alias("options"), F.array(F.chr(F.col("n_regionkey") % 4 + 65), F.lit("C")).alias("answers")).write.json(path)
    return readers.read_reading_tests(spark, path).select("uid", "article", "option", "text", "label")


@query("""SELECT 'missing' AS kind, 'b' AS "column", 'string' AS expected, NULL AS found UNION ALL SELECT 'added', 'c', NULL, 'bigint' UNION ALL SELECT 'type', 'a', 'bigint', 'int'""")
def ext22_schema_audit(spark, d):
    path = folder(spark, "audit")
    n = t(spark, d, "nation")
    n.select(F.col("n_nationkey").cast("long").alias("a"), F.col("n_name").alias("b")).coalesce(1).write.parquet(f"{path}/1")
    n.select(F.col("n_nationkey").cast("int").alias("a"), F.col("n_nationkey").cast("long").alias("c")).coalesce(1).write.parquet(f"{path}/2")
    return readers.schema_drift(readers.file_columns(spark, [f"{path}/1", f"{path}/2"])).select("kind", "column", "expected", "found")


# -- sinks -------------------------------------------------------------------------------------


@query("""SELECT 'true' AS to_filter, count(*) AS n FROM documents WHERE lang IS NULL OR lang <> 'en' UNION ALL SELECT 'false', count(*) FROM documents WHERE lang = 'en' UNION ALL SELECT 'split ' || CASE WHEN doc_id % 2 = 0 THEN 'train' ELSE 'test' END, count(*) FROM documents GROUP BY 1
UNION ALL SELECT 'version ' || v, CASE WHEN v = 1 THEN 2 * (SELECT count(*) FROM region) ELSE (SELECT count(*) FROM region) END FROM (VALUES (1), (2)) x(v) UNION ALL SELECT 'rank ' || n_regionkey, count(*) FROM nation GROUP BY 1 UNION ALL SELECT 'merged', 2 * count(*) FROM region UNION ALL SELECT 'submitted', count(*) FROM nation""")
def snk02_folders(spark, d):
    base = folder(spark, "sinks")
    docs, region, nation = (t(spark, d, x) for x in ("documents", "region", "nation"))
    writers.write_split(docs.select("doc_id", "lang"), "lang <> 'en'", f"{base}/split")
    writers.write_by_split(docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "train").otherwise("test").alias("split")), f"{base}/by")
    for v in (1, 1, 2):
        writers.append_rollouts(region.withColumn("version", F.lit(v)), f"{base}/rollouts")
    writers.write_by_rank(nation.withColumn("rank", F.col("n_regionkey")), f"{base}/ranks")
    writers.write_jsonl(region, f"{base}/r1")
    writers.merge_json(spark, [f"{base}/r1", f"{base}/r1"], f"{base}/merged")
    writers.write_submission(nation, f"{base}/answers", "n_nationkey")
    count = lambda df, c, head: df.groupBy(F.concat(F.lit(head), F.col(c).cast("string")).alias("to_filter")).agg(F.count("*").alias("n"))
    every = lambda df, name: df.agg(F.lit(name).alias("to_filter"), F.count("*").alias("n"))
    out = count(spark.read.json(f"{base}/split"), "to_filter", "").unionByName(count(spark.read.parquet(f"{base}/by"), "split", "split ")).unionByName(count(spark.read.parquet(f"{base}/rollouts"), "version", "version "))
    return out.unionByName(count(spark.read.json(f"{base}/ranks"), "rank", "rank ")).unionByName(every(spark.read.json(f"{base}/merged"), "merged")).unionByName(every(spark.read.json(f"{base}/answers"), "submitted"))


@query("""WITH d AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda w: length(w)) a FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(a) AS length, CAST(coalesce(sum(len(a)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 4 AS BIGINT) AS pointer, md5(array_to_string(a, ',')) AS digest FROM d""")
def snk09_token_documents(spark, d):
    path = folder(spark, "tokens")
    x = t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.transform(F.split("text", " ", -1), lambda w: F.length(w)).alias("a"))
    writers.write_token_documents(x, path, "doc_id", "a")
    return spark.read.parquet(path).select("doc_id", "length", "pointer", F.md5(F.array_join(F.transform("tokens", lambda v: v.cast("string")), ",")).alias("digest"))


@query("""SELECT 'files' AS kind, CAST(sum(c) AS BIGINT) AS n FROM (SELECT ceil(count(*) / 100.0) c FROM documents) UNION ALL SELECT 'rows', count(*) FROM documents""")
def snk06_record_shards(spark, d):
    path = folder(spark, "records")
    writers.write_shards(t(spark, d, "documents").select("doc_id", "text"), path, 100, "doc_id")
    x = spark.read.parquet(path)
    files = x.select(F.input_file_name().alias("f")).distinct()
    return files.agg(F.lit("files").alias("kind"), F.count("*").alias("n")).unionByName(x.agg(F.lit("rows").alias("kind"), F.count("*").alias("n")))


def _samples(spark, d):
    """(doc_id as text, members) of every document: a JSON member and its text."""
    told = F.to_json(F.struct(F.array(F.struct(F.lit("user").alias("role"), F.coalesce("source", F.lit("s")).alias("content"))).alias("texts"), F.when(F.col("doc_id") % 5 == 0, "sound").otherwise("text").alias("media"), F.array(F.when(F.col("doc_id") % 7 == 0, "no.jpg").otherwise("txt")).alias("name")))
    return t(spark, d, "documents").select(F.format_string("%08d", F.col("doc_id")).alias("key"), F.create_map(F.lit("json"), told.cast("binary"), F.lit("txt"), F.coalesce("text", F.lit("")).cast("binary")).alias("members"))


@query("""SELECT doc_id, md5(coalesce(text, '')) AS digest, array_to_string(list_filter([CASE WHEN doc_id % 5 = 0 THEN 'unknown media' END, CASE WHEN doc_id % 7 = 0 THEN 'a name without a member' END], lambda x: x IS NOT NULL), ';') AS errors, true AS within, true AS counted, true AS complete, true AS listed FROM documents""")
def snk03_tar_shards(spark, d):
    path = folder(spark, "tars")
    index = shards.write_tar_shards(_samples(spark, d), "key", "members", path, max_count=100, max_bytes=400_000)
    said = shards.write_metadata(spark, path, index)
    within = index.agg((F.max("samples") <= 100).alias("within")).first()[0]
    counted = sum(said["shard_counts"].values()) == t(spark, d, "documents").count()
    checked = shards.check_shards(spark, f"{path}/*.tar")
    complete = shards.shard_report(checked).agg((F.sum("incomplete") == 0).alias("c")).first()[0]
    listed = shards._unyaml(shards._text(f"{path}/{shards.META}/.info.yaml", spark))["shard_counts"] == said["shard_counts"]
    x = shards.read_tar_samples(spark, f"{path}/*.tar")
    errors = shards.sample_errors(F.col("members"))
    return x.select(F.element_at(F.split("key", "/"), -1).cast("long").alias("doc_id"), F.md5(F.col("members")["txt"]).alias("digest"), F.array_join(errors, ";").alias("errors"), F.lit(within).alias("within"), F.lit(counted).alias("counted"), F.lit(complete).alias("complete"), F.lit(listed).alias("listed"))


@query("""SELECT doc_id, md5(coalesce(text, '')) AS digest, CAST(2 AS INT) AS members, true AS within, CAST((SELECT count(*) FROM documents) AS BIGINT) AS counted FROM documents""")
def snk03_tar_store(spark, d):
    """Shards written by Spark's committer, read in several parts each."""
    path = folder(spark, "store")
    index = tar_store.write_tar(_samples(spark, d), "key", "members", path, max_count=100, max_bytes=400_000)
    said = index.agg(F.bool_and((F.col("samples") <= 100) & ((F.col("bytes") <= 400_000) | (F.col("samples") == 1))).alias("within"), F.sum("samples").alias("counted"))
    x = tar_store.read_tar(spark, f"{path}/*.tar", split_bytes=64 << 10)
    return x.select(F.col("key").cast("long").alias("doc_id"), F.md5(F.col("members")["txt"]).alias("digest"), F.size("members").alias("members")).join(F.broadcast(said))


@query("""WITH r AS (SELECT p_partkey, (p_size * 1000)::BIGINT s FROM part) SELECT count(*) AS files, true AS fits, true AS full FROM r""")
def ext11_rolling_parts(spark, d):
    x = t(spark, d, "part").select("p_partkey", (F.col("p_size") * 1000).alias("s"))
    y = shards.rolling_parts(x, "p_partkey", "s", 100_000)
    sums = y.groupBy("part").agg(F.sum("s").alias("s"), F.count("*").alias("n"))
    return sums.agg(F.sum("n").alias("files"), (F.max("s") <= 100_000).alias("fits"), (F.max("part") <= F.ceil(2 * F.sum("s") / 100_000)).alias("full"))


# -- caches and blocks -------------------------------------------------------------------------


@query("""SELECT doc_id, doc_id // 100 AS block_id, [length(text)::DOUBLE, (doc_id % 7)::DOUBLE] AS embedding FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)""")
def rtr06_embed_blocks(spark, d):
    path = folder(spark, "embedded")

    def model(texts):
        return [[float(len(x.split("|", 1)[1])), float(int(x.split("|", 1)[0]) % 7)] for x in texts]

    x = t(spark, d, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("|"), F.coalesce("text", F.lit(""))).alias("t"))
    judging.embed_blocks(x.where("doc_id < 200"), "doc_id", "t", model, path, 100)
    y = judging.embed_blocks(x, "doc_id", "t", model, path, 100)  # goes on with the blocks that aren't there
    return y.select("doc_id", "block_id", F.transform("embedding", lambda v: v.cast("double")).alias("embedding"))


@query("SELECT vec_id FROM embeddings WHERE vec_id % 50 = 3")
def rtr07_validate_blocks(spark, d):
    x = t(spark, d, "embeddings").select("vec_id", F.array_join(F.transform("embedding", lambda v: v.cast("string")), " ").alias("t"), "embedding")

    def model(texts):
        return [[float(v) for v in s.split()] for s in texts]

    stored = x.select("vec_id", F.when(F.col("vec_id") % 50 == 3, F.slice("embedding", 1, 1)).otherwise(F.col("embedding")).alias("embedding"))
    return judging.validate_blocks(x, "vec_id", "t", model, stored, 100, every=1)


@query("SELECT count(*) AS n, count(DISTINCT vec_id) AS ids, count(DISTINCT vec_id // 100) AS blocks, true AS again FROM embeddings")
def ext10_missing_blocks(spark, d):
    path = folder(spark, "cells")
    e = t(spark, d, "embeddings")
    centres = retrieval.train_cells(e, 8)
    retrieval.add_missing_blocks(e.where("vec_id < 200"), centres, path, 100)
    y = retrieval.add_missing_blocks(e, centres, path, 100)
    n = y.count()
    again = retrieval.add_missing_blocks(e, centres, path, 100).count() == n
    return y.agg(F.count("*").alias("n"), F.count_distinct("vec_id").alias("ids"), F.count_distinct("block_id").alias("blocks"), F.lit(again).alias("again"))


@query("""SELECT 'loaded' AS kind, count(*) AS n FROM region UNION ALL SELECT 'deleted', 2 UNION ALL SELECT 'left', 1""")
def udf10_saved_caches(spark, d):
    base = folder(spark, "caches")
    for name in ("a1", "a2", "b"):
        judging.save_cache(t(spark, d, "region"), base, name)
    loaded = judging.load_cache(spark, base, "b").count()
    gone = judging.delete_cache(spark, base, "a")
    left = sum(judging.load_cache(spark, base, n) is not None for n in ("a1", "a2", "b"))
    return spark.createDataFrame([("loaded", loaded), ("deleted", len(gone)), ("left", left)], "kind string, n long")


# -- streams -----------------------------------------------------------------------------------


def _streamed(stream, path: str, name: str):
    """Runs a stream over what is there, to the end; a restart goes on from the checkpoint."""
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/{name}-state").option("path", f"{path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/{name}")


@query("SELECT event_id, user_id, event_type FROM events")
def stm01_scan(spark, d):
    path = folder(spark, "scan")
    e = t(spark, d, "events").select("event_id", "user_id", "event_type")
    e.where("event_id % 2 = 0").write.parquet(f"{path}/in")
    stream = iterate.scan(spark, f"{path}/in", e.schema)
    _streamed(stream, path, "out")
    e.where("event_id % 2 = 1").write.mode("append").parquet(f"{path}/in")  # what came since is read once more, the rest is not
    return _streamed(iterate.scan(spark, f"{path}/in", e.schema), path, "out")


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS ids, true AS moved FROM events UNION ALL SELECT least(700, count(*)), least(700, count(*)), true FROM events WHERE value > 40")
def stm06_accept_until(spark, d):
    path = folder(spark, "accept")
    e = t(spark, d, "events").select("event_id", "value")
    e.repartition(6, "event_id").write.parquet(f"{path}/in")
    stream = iterate.scan(spark, f"{path}/in", e.schema, 1)
    q = stream.writeStream.foreachBatch(iterate.accept_until(f"{path}/kept", 700, "event_id", "value > 40")).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    kept = spark.read.parquet(f"{path}/kept").select("event_id", "value")
    one = kept.agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"), (F.min("value") > 40).alias("moved"))
    laid = e.withColumn("at", F.monotonically_increasing_id())  # partition and place before, and i after
    shuffled = iterate.buffered_shuffle(laid, "event_id", 100).withColumn("i", F.monotonically_increasing_id())
    return shuffled.agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"), (F.count_if(F.col("i") != F.col("at")) > 10).alias("moved")).unionByName(one)


@query("""SELECT time_bucket(INTERVAL 60 MINUTE, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events WHERE ts < (SELECT time_bucket(INTERVAL 60 MINUTE, max(ts) - INTERVAL 10 MINUTE) FROM events) GROUP BY 1, 2""")
def stm_tumbling_stream(spark, d):
    path = folder(spark, "tumbling")
    e = t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(f"{path}/in")
    stream = iterate.scan(spark, f"{path}/in", e.schema, 1 << 30)  # all files in one micro-batch: none of its rows is late
    out = _streamed(iterate.tumbling(stream), path, "out")
    return out.withColumn("total", F.round("total", 6)).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""SELECT c_custkey, upper(c_name) AS result FROM customer UNION ALL SELECT -1 - r_regionkey, r_name || '!' FROM region""")
def stm08_flushes(spark, d):
    x = spread(t(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey")
    one = iterate.flushed(x, lambda names: [n.upper() for n in names], "c_name", "string", 7).select("c_custkey", "result")
    names = {r["r_name"]: r["r_regionkey"] for r in t(spark, d, "region").collect()}
    tasks = iterate.pulled(sorted(names), lambda n: n + "!", spark)
    key = F.lit(None).cast("long")
    for n, k in names.items():
        key = F.when(F.col("task") == n, F.lit(-1 - k)).otherwise(key)
    return one.unionByName(tasks.select(key.alias("c_custkey"), "result"))


@query("SELECT doc_id, pool, CAST(row_number() OVER (PARTITION BY pool ORDER BY n_chars, doc_id) - 1 AS INT) AS place FROM (SELECT doc_id, n_chars, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS pool FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100))")
def stm10_pools_after_resume(spark, d):
    x = iterate.resumed(t(spark, d, "documents").select("doc_id", "n_chars"), 100, "doc_id")
    return iterate.pooled_sort(x, "doc_id", "n_chars", "doc_id", 64).select("doc_id", "pool", "place")


@query("SELECT key, min(event_id) AS event_id FROM (SELECT event_type || user_id AS key, event_id FROM events) GROUP BY 1")
def stm07_deduplicated(spark, d):
    path = folder(spark, "once")
    e = t(spark, d, "events").select(F.concat("event_type", F.col("user_id").cast("string")).alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    _arriving(e, path, "event_id", max(1, -(-e.count() // MOST_ARRIVING)))
    stream = iterate.deduplicated(iterate.scan(spark, f"{path}/in", e.schema, 1), "key", "ts", "1000 days")
    out = _streamed(stream, path, "out")
    return out.groupBy("key").agg(F.min("event_id").alias("event_id"))


MOST_ARRIVING = 1 << 22
"""Rows that a file of a replay holds, so that what one task sorts doesn't grow with the table."""


MOST_ASKING = 1 << 20
"""The same where a Python worker holds the rows of a file."""


def _arriving(rows, path, order, parts=3):
    """Written as some files in order, one after the other."""
    n = rows.agg(F.max(order)).first()[0] + 1
    for i in range(parts):
        rows.where((F.col(order) >= n * i // parts) & (F.col(order) < n * (i + 1) // parts)).coalesce(1).sortWithinPartitions(order).write.mode("append").parquet(f"{path}/in")


@query("SELECT event_id, event_type, true AS across FROM events")
def stm02_savable_buffer(spark, d):
    """A buffer of 64 rows in each of 2 lanes, stopped after two micro-batches and started again for the third: every row once, and rows of the first start come in the second."""
    path = folder(spark, "buffer")
    e = t(spark, d, "events").select("event_id", "event_type")
    n = e.agg(F.max("event_id")).first()[0] + 1
    _arriving(e.where(F.col("event_id") < n * 2 // 3), path, "event_id", 2)
    with stateful.state_store(spark):
        first = settle(_streamed(stateful.buffered(iterate.scan(spark, f"{path}/in", e.schema, 1), "event_id", 64, 2), path, "out"), "first")
        e.where(F.col("event_id") >= n * 2 // 3).coalesce(1).write.mode("append").parquet(f"{path}/in")
        out = _streamed(stateful.buffered(iterate.scan(spark, f"{path}/in", e.schema, 1), "event_id", 64, 2), path, "out")
    across = out.join(first, "event_id", "left_anti").agg((F.min("event_id") < n * 2 // 3).alias("across"))
    return out.unionByName(stateful.left_over(spark, f"{path}/out-state")).join(F.broadcast(across))


@query("""WITH RECURSIVE e AS (SELECT row_number() OVER (ORDER BY ts, event_id) AS i, event_id, event_type || user_id AS key, epoch(ts) AS at FROM events),
c AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS ks, CAST([] AS DOUBLE[]) AS st, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS key, CAST(NULL AS BOOLEAN) AS hit
  UNION ALL
  SELECT i, CASE WHEN hit THEN ks WHEN len(fk) > 100 THEN fk[2:] ELSE fk END, CASE WHEN hit THEN st WHEN len(fk) > 100 THEN fs[2:] ELSE fs END, event_id, key, hit
  FROM (SELECT e.i, c.ks, c.st, e.event_id, e.key, coalesce(e.at - c.st[list_position(c.ks, e.key)] < 86400, false) AS hit,
      list_append(list_filter(c.ks, lambda x: x <> e.key), e.key) AS fk,
      list_append(list_filter(c.st, lambda x, j: c.ks[j] <> e.key), e.at) AS fs
    FROM c JOIN e ON e.i = c.i + 1))
SELECT event_id AS n, key, hit FROM c WHERE i > 0""")
def stm07_bounded_cache(spark, d):
    """Replayed events ask a cache of 100 entries that live a day."""
    path = folder(spark, "bounded")
    e = t(spark, d, "events").select("event_id", F.concat("event_type", F.col("user_id").cast("string")).alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    timed = settle(ranked(e.withColumn("late", F.col("ts").isNull()), "late", "ts", "event_id", name="at"), "timed")  # what comes first is asked first, whatever its number
    _arriving(timed, path, "at", max(3, -(-e.count() // MOST_ASKING)))
    e = timed
    with stateful.state_store(spark):
        return _streamed(stateful.cached(iterate.scan(spark, f"{path}/in", e.schema, 1), "key", "event_id", "ts", 86_400, 100), path, "out")


@query("""SELECT n_nationkey, upper(n_name) AS caption, n_regionkey = 0 AS first FROM nation WHERE n_nationkey % 3 <> 2""")
def src10_paired_files(spark, d):
    """JOIN-01: files with a sibling of another suffix and the same base name."""
    path = folder(spark, "pairs")
    n = t(spark, d, "nation")
    told = F.to_json(F.struct(F.upper("n_name").alias("caption"), (F.col("n_regionkey") == 0).alias("first"))).cast("binary")
    members = F.when(F.col("n_nationkey") % 3 == 2, F.create_map(F.lit("json"), told)).otherwise(F.create_map(F.lit("json"), told, F.lit("jpg"), F.lit(b"x")))
    shards.write_samples(n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("k"), members.alias("m")), "k", "m", path)
    x = readers.paired_files(spark, path)
    key = F.regexp_extract("base", r"n([0-9]+)$", 1).cast("long")
    text = F.col("content").cast("string")
    return x.select(key.alias("n_nationkey"), F.get_json_object(text, "$.caption").alias("caption"), (F.get_json_object(text, "$.first") == "true").alias("first"))


@query("""WITH d AS (SELECT doc_id, list_transform(string_split(text, '. '), lambda s: len(string_split(s, ' '))) s FROM documents WHERE text IS NOT NULL) SELECT count(*) AS docs, CAST(sum(len(s)) AS BIGINT) AS sentences, 0 AS gaps, 0 AS single, 0 AS long, true AS cached FROM d""")
def ext19_block_samples(spark, d):
    from corpusloom.functions import tokens

    sizes = F.transform(F.split("text", r"\. ", -1), lambda s: F.size(F.split(s, " ", -1)))
    x = t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", sizes.alias("s"))
    path = folder(spark, "blocks")
    one = tokens.cached_block_samples(x, path, "doc_id", "s", 64)
    cached = tokens.cached_block_samples(x.limit(0), path, "doc_id", "s", 64).count() == one.count()
    both = one.join(x, "doc_id")
    before = F.aggregate(F.slice("s", F.col("first") + 1, F.col("last") - F.col("first") - 1), F.lit(0), lambda a, v: a + v)
    told = both.agg(F.count_if(F.col("last") <= F.col("first")).cast("int").alias("gaps"), F.count_if(F.col("last") - F.col("first") < 2).cast("int").alias("single"), F.count_if(before >= 61).cast("int").alias("long"))
    return x.agg(F.count("*").alias("docs"), F.sum(F.size("s")).alias("sentences"), F.lit(cached).alias("cached")).join(F.broadcast(told))  # one row


@query("""SELECT p_partkey, list_filter([w[1], w[1] || ' ' || w[2], w[2]], lambda g: g IS NOT NULL AND g <> 'red') AS grams, w[1] AS entity, [0, CAST(length(w[1]) + 1 AS INT)] AS offsets, true AS same, md5('{"p_partkey":' || p_partkey || '}') AS key FROM (SELECT p_partkey, string_split(p_name, ' ') w FROM part WHERE len(string_split(p_name, ' ')) = 2)""")
def ext26_token_grams(spark, d):
    from corpusloom.functions import tokens

    x = t(spark, d, "part").where(F.size(F.split("p_name", " ")) == 2)
    words = F.split("p_name", " ")
    y = tokens.tokenized(x.withColumn("key", tokens.config_keys(x, "p_partkey")), "p_name", tokens.HashedWords(1000))
    groups = tokens.entity_groups(words, F.array(F.lit("X"), F.lit("O")))
    return y.select("p_partkey", tokens.grams_up_to(words, 2, lambda g: (F.size(g) == 1) & (g[0] == "red")).alias("grams"), groups[0]["text"].alias("entity"), "offsets", (F.size("ids") == 2).alias("same"), "key")


@query("""SELECT n_nationkey, n_name AS answer, upper(r_name) AS truth, 'n' || n_nationkey || '.jpg' AS image, n_name AS said FROM nation JOIN region ON n_regionkey = r_regionkey""")
def join07_prediction_truth(spark, d):
    from corpusloom.operators import registry, training

    n = t(spark, d, "nation")
    pairs = n.select("n_nationkey", "n_name", F.col("n_regionkey"), F.array(F.struct(F.lit("user").alias("role"), F.col("n_name").alias("content"))).alias("massages:"), F.concat(F.lit("/d/n"), F.col("n_nationkey").cast("string"), F.lit(".jpg")).alias("path"))
    told = training.pair_messages(pairs).select(F.col("images")[0].alias("image"), F.col("messages")[0]["content"].alias("said"))
    predictions = n.select("n_regionkey", "n_nationkey", F.col("n_name").alias("answer"))
    truth = t(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.upper("r_name").alias("truth"))
    both = registry.prediction_truth(predictions, truth, "n_regionkey").select("n_nationkey", "answer", "truth")
    return both.join(told, both["answer"] == told["said"])
