"""Edge cases of the reference-facing operators: quirks, ties, empty and null rows."""

import collections
import hashlib
import math
import random
import re
import string
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import answers as A
from corpusloom.functions import scoring as S
from corpusloom.functions import similarity as M
from corpusloom.functions import text as T
from corpusloom.operators import cleaning, conversations, dedup, grouping, mixing, ordering, packing, registry, retrieval, storage
from corpusloom.plans import catalog
from corpusloom.sources import readers, shards, writers
from corpusloom.streaming import iterate


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()[0]


def test_text_functions(spark):
    assert one(spark, T.tagged_answer(F.col("a")), a="<answer>1</answer> no <answer>2\n3</answer>") == "2\n3"
    assert one(spark, T.answer_or_text(F.col("a")), a=r"so \boxed{7}") == "7"
    assert one(spark, T.first_number(F.col("a")), a="none") == 0.0
    assert one(spark, T.option_letter(F.col("a")), a="The answer is B.") == "b"
    assert one(spark, T.judge_score(F.col("a"), 0, 10), a="score: 12") == 10.0
    assert one(spark, T.contains_words(F.col("a"), F.col("b")), a="The Eiffel Tower!", b="eiffel tower") is True
    assert one(spark, T.regex_filter(F.array(F.col("a")), r"#### (\d+)"), a="x") == ["[invalid]"]


def test_scoring_functions(spark):
    assert one(spark, S.relaxed_correct(F.col("a"), F.col("b")), a="5%", b="0.051") is True
    assert one(spark, S.relaxed_correct(F.col("a"), F.col("b")), a="0.0", b="0") is False  # a target of 0 compares as text
    assert one(spark, S.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 1.0
    assert one(spark, S.clock_seconds(F.col("a")), a="1:02:03") == 3723.0
    assert one(spark, S.span_iou(F.lit(0.0), F.lit(2.0), F.lit(4.0), F.lit(6.0))) == 0.0
    assert one(spark, S.anls(F.col("a"), F.array(F.lit("hallo"), F.lit("x"))), a="hello") == 0.8
    assert one(spark, S.token_f1(F.col("a"), F.col("b")), a="the cat sat", b="cat sat down") == 0.8
    assert one(spark, S.reward(F.lit("number"), F.col("a"), F.col("b")), a="it is -4", b="4") == 1.0  # the sign is lost
    assert one(spark, S.reward_choice(F.col("a"), F.col("b")), a="(B) x", b="b") == 1.0
    assert one(spark, S.in_band(F.array().cast("array<double>"), 0.2, 0.8)) is True
    assert one(spark, S.mean_relative_accuracy(F.lit(9.2), F.lit(10.0))) == 0.9


def test_similarity_of_whole_texts(spark, tmp_path):
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            nxt = [i]
            for j, y in enumerate(b, 1):
                nxt.append(min(row[j] + 1, nxt[-1] + 1, row[j - 1] + (x != y)))
            row = nxt
        return row[-1]

    draw = random.Random(4)
    long = "".join(draw.choice("abc dé😀") for _ in range(300))
    texts = [long, long[:60] + long[100:], long.replace("é", "e"), long[:45] + "x" * 200, "", "", "é", "e", "😀é", long[::-1], None, long, long]
    texts += ["".join(draw.choice("abéü") for _ in range(draw.randrange(90))) for _ in range(30)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["similarity"] for r in catalog.QUERIES["sim01_levenshtein"](spark, str(tmp_path)).collect()}
    want = {i: None if a is None or b is None else round(1 - edits(a, b) / max(len(a), len(b), 1), 9) for i, (a, b) in enumerate(zip(texts, texts[1:]))}
    assert got.keys() == want.keys() and all(got[i] == want[i] or abs(got[i] - want[i]) < 1e-8 for i in want)


def test_normal_text_keeps_accents(spark, tmp_path):
    def plain(text):  # word boundaries are those of Unicode
        text = "".join(c for c in text.lower() if c not in string.punctuation)
        return " ".join(re.sub(r"\b(a|an|the)\b", " ", text).split())

    def said(text):
        text = text.replace(".", "").strip(" ").lower()
        return next((w for w in ("yes", "no") if text in (w, w[0]) or w in text[:4]), "other")

    assert plain("L'Été, à la mer") == "lété à la mer" and plain("anéç The é") == "anéç é"
    rows = [(1, 0, "L'Été, à la mer"), (1, 1, "LEt  la mer"), (1, 2, "anéç The é"), (1, 3, "é yes"), (1, 4, "ééyes"), (1, 5, "N.")]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    for folder in (str(tmp_path), "/root/testdata/sf0.01"):
        texts = {(r["conv_id"], r["turn"]): r["text"] for r in spark.read.parquet(f"{folder}/conversations.parquet").collect()}
        got = {(r["conv_id"], r["turn"]): (r["said"], r["normal"]) for r in catalog.QUERIES["str13_normalise"](spark, folder).collect()}
        assert got == {k: (None, None) if t is None else (said(t), hashlib.md5(plain(t).encode()).hexdigest()) for k, t in texts.items()}


def test_cleaning(spark):
    words = "a " * 8
    assert one(spark, cleaning.caption_problem(F.col("a")), a=words + "b" * 60) == "repeat"
    assert one(spark, cleaning.caption_problem(F.col("a")), a="I'm sorry, no") == "refusal"
    urls = spark.createDataFrame([(1, "http://a.blocked.com/x"), (2, "http://b.org/x.PDF?q"), (3, "h://x"), (4, None), (5, "http://ok.org/1"), (6, "http://ok.org/1")], "page_id long, url string")
    got = {r["page_id"]: r["reason"] for r in cleaning.classify_urls(urls, ["blocked"]).collect()}
    assert got == {1: "domain", 2: "extension", 3: "short", 4: "short", 5: "keep", 6: "duplicate"}


def test_grouping(spark):
    pairs = spark.createDataFrame([("the cat sat", "the cat sit"), ("a b", "a b c")], "r string, h string")
    assert grouping.word_error_rate(pairs, "r", "h").first()["wer"] == 40.0
    none = spark.createDataFrame([], "t int, p int")
    assert grouping.binary_metrics(none, "t", "p").first()["f1"] == 0.0


def test_bootstrap_takes_a_thousand_draws(spark, tmp_path):
    rows = [(i, i * i % 7 % 2) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    hashed = spark.range(60).withColumnRenamed("id", "doc_id").crossJoin(spark.range(1, 1001).select(F.col("id").cast("int").alias("draw"))).select("doc_id", "draw", F.xxhash64("doc_id", "draw")).collect()
    steps = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(6)])
    score, sums = dict(rows), np.zeros((1000, 2))
    for key, draw, h in hashed:
        k = int((h % 1_000_000 / 1_000_000 >= steps).sum())
        sums[draw - 1] += (k * score[key], k)
    means = sums[:, 0] / sums[:, 1]
    want = (*np.percentile(means, [2.5, 97.5]), np.std(means))
    got = catalog.QUERIES["agg12_bootstrap"](spark, str(tmp_path)).first()
    assert np.allclose((got["low"], got["high"], got["deviation"]), want, rtol=0, atol=1e-12)


def test_conversations(spark):
    rows = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "a"), (2, 0, "user", "q"), (3, 0, "assistant", "x"), (3, 1, "user", None)], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in conversations.unified(conversations.gather(rows)).collect()}
    assert got[1]["valid"] and got[1]["system"] == "s" and got[1]["response"][0]["content"] == "a"
    assert not got[2]["valid"] and not got[3]["valid"] and got[3]["prompt"] == []
    errors = {r[0]: r[1] for r in conversations.gather(rows).select("conv_id", conversations.contract_errors(F.col("messages"))).collect()}
    assert errors[1] == [] and errors[2] == ["no answer"] and errors[3] == ["empty content"]


def test_groups_and_packing(spark):
    edges = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.8), ("d", "e", 0.5), ("x", "y", 0.7)], "src string, dst string, similarity double")
    assert {r["id"]: r["group_id"] for r in dedup.groups(edges).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    items = spark.createDataFrame([(i, n) for i, n in enumerate([60, 40, 40, 30, 30, 100, 7, 200])], "id long, n long")
    packed = packing.pack(items, "id", "n", 100, ((1, 0.96),)).collect()
    boxes = {}
    for r in packed:
        if r["box_id"] is not None:
            boxes.setdefault(r["box_id"], []).append(r["n"])
    assert sorted(map(sum, boxes.values())) == [100, 100, 100] and {r["n"] for r in packed if r["box_id"] is None} == {7, 200}


def test_group_pairs_reads_every_order(spark, tmp_path):
    draw = random.Random(3)
    edges = [(0, 1), (2, 0)] + [(draw.randrange(3, 900), draw.randrange(2, 500)) for _ in range(450)]
    rows = [(i + 1, part, supplier) for i, (part, supplier) in enumerate(edges)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for part, supplier in edges:
        a, b = find(part), find(-1 - supplier)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for x in list(root)}
    assert 10 < len(set(want.values())) < len(want) / 2
    got = catalog.QUERIES["ddp03_group_pairs"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {r["id"]: r["group_id"] for r in got} == want


def test_mixing():
    assert ordering.parse_blend(["0.3", "a", "0.7", "b"]) == (["a", "b"], [0.3, 0.7])
    assert ordering.parse_blend(["a", "b"]) == (["a", "b"], None)
    assert ordering.blend_counts([0.5, 0.3, 0.2], 10) == [5, 3, 2]


def test_blend_takes_the_drawn_counts_or_fails(spark):
    three = [spark.range(40).withColumnRenamed("id", "k") for _ in range(3)]
    got = ordering.blend(three, [1 / 3] * 3, 100, "k").groupBy("dataset_index").count().collect()
    assert {r["dataset_index"]: r["count"] for r in got} == {0: 34, 1: 33, 2: 33}
    with pytest.raises(IndexError):
        ordering.blend([three[0], three[1].limit(32), three[2]], [1 / 3] * 3, 100, "k")


def test_group_statistics_and_removal(spark):
    edges = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.8), ("x", "y", 0.7), ("d", "d", 1.0)], "src string, dst string, similarity double")
    grouped = dedup.groups(edges)
    assert tuple(dedup.group_statistics(grouped).first()) == (2, 3)
    out = dedup.surplus(grouped)
    assert {r["id"] for r in out.collect()} == {"b", "c", "y"}
    rows = spark.createDataFrame([("a", "é1"), ("b", "éé3"), ("c", None), ("d", "4"), (None, "55")], "id string, text string")
    assert tuple(dedup.removal_counters(rows, out, "id", "text").first()) == (3, 2, 3)


def test_splits_are_disjoint_and_complete(spark):
    rows = spark.range(1000).withColumnRenamed("id", "k")
    got = ordering.split_by_ratio(rows, "k", "80,15,5").groupBy("split").count().collect()
    assert sum(r["count"] for r in got) == 1000 and {r["split"] for r in got} == {"train", "valid", "test"}
    assert ordering.split_by_ratio(rows, "k", "80,15,5").collect() == ordering.split_by_ratio(rows.repartition(3), "k", "80,15,5").orderBy("k").collect()


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "t.txt").write_text("a:3\nbad\nb:c:12\n")
    assert sorted(map(tuple, readers.read_token_info(spark, str(tmp_path / "t.txt")).collect())) == [("a", 3), ("b:c", 12)]
    assert readers.parse_path("x/*.parquet[25%]") == ("x/*.parquet", 25.0)
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    writers.write_jsonl(df, str(tmp_path / "j.jsonl"))
    assert readers.read(spark, str(tmp_path / "j.jsonl")).count() == 2
    writers.write_split(df, "v IS NULL", str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).where("to_filter = 'true'").count() == 1
    plan = writers.shard_plan(spark.range(50).withColumn("b", F.lit(10)), "id", "b", max_count=5, groups=2)
    assert plan.groupBy("shard").count().agg(F.max("count")).first()[0] <= 5


def test_shard_plan_keeps_both_limits(spark):
    sizes = [1] * 10 + [10] * 4 + [50] + [7] * 20
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "id long, b long")
    for count, most in ((5, 10), (3, 20), (100, 25)):
        got = collections.defaultdict(list)
        for r in writers.shard_plan(rows, "id", "b", count, most).collect():
            got[r["shard"]].append(r["b"])
        assert sum(map(len, got.values())) == len(sizes)
        assert all(len(x) <= count and (sum(x) <= most or len(x) == 1) for x in got.values())


def test_serial_ids_over_many_files(spark, tmp_path):
    n = 1_000_000
    spark.range(n).select((F.col("id") * 7919 % n).alias("k")).repartition(40).write.parquet(str(tmp_path / "rows"))
    got = cleaning.serial_ids(spark.read.parquet(str(tmp_path / "rows")), "doc", "k")
    wrong = got.where(F.col("serial_id") != F.format_string("doc-%010d", F.col("k") + 1)).count()
    assert got.count() == n and wrong == 0
    same = spark.createDataFrame([(1, "x")] * 7 + [(0, "y"), (None, "z")], "k int, v string")  # ties and a null
    assert sorted(r["serial_id"] for r in cleaning.serial_ids(same, "d", "k").collect()) == [f"d-{i:010d}" for i in range(1, 10)]
    assert cleaning.serial_ids(same.limit(0), "d", "k").collect() == []


def test_running_sums_of_a_hot_group(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else str(i % 50), i % 11) for i in range(3000)], "i long, g string, v long")
    got = {r["i"]: r["before"] for r in storage.running(rows, ["g"], ["i"], "v", "before").collect()}
    sums = collections.Counter()
    for i in range(3000):
        g = "hot" if i % 3 else str(i % 50)
        assert got[i] == sums[g]
        sums[g] += i % 11


def test_reconcile_images(spark):
    def both(problem, images):
        p, i = conversations.reconcile_images(F.col("p"), F.col("i"))
        return tuple(spark.createDataFrame([(problem, images)], "p string, i array<string>").select(p, i).first())

    assert both("<image>a<image>b<image>c", ["x"]) == ("<image>a", ["x"])  # what follows surplus marks goes
    assert both("<image>a", ["x", "y"]) == ("<image>a", ["x"])  # surplus images go
    assert both("a", None) == ("a", []) and both("a<image>", []) == ("a", [])


def test_decontamination_cuts(spark):
    rng = random.Random(9)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    item = words(30)
    texts = [words(200) + ". " + item.upper() + "! " + words(200), words(20) + " " + item, words(100), "", None, " ".join(words(80) + " " + item for _ in range(14)), item]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(0, item), (1, None), (2, "too short")], "item_id long, text string")
    got = collections.defaultdict(list)
    for r in dedup.decontaminate(docs, bench).orderBy("doc_id", "piece").collect():
        got[r["doc_id"]].append(r["text"])

    def cut(text):
        spans = [(m.start(), m.end(), m.group().lower()) for m in re.finditer("[A-Za-z0-9]+", text)]
        grams = {tuple(item.split()[i : i + 13]) for i in range(18)}
        gone = [False] * len(text)
        for i in range(len(spans) - 12):
            if tuple(s[2] for s in spans[i : i + 13]) in grams:
                for k in range(max(0, spans[i][0] - 200), min(len(text), spans[i + 12][1] + 200)):
                    gone[k] = True
        pieces = "".join("\0" if g else c for c, g in zip(text, gone)).split("\0")
        pieces = [p for p in pieces if p]
        return [p for p in pieces if len(p) >= 200] if len(pieces) <= 11 else []

    assert got[0] == cut(texts[0]) and len(got[0]) == 2 and got[1] == cut(texts[1])
    assert got[2] == [texts[2]] and got[3] == [""] and got[4] == [None] and got[5] == [] and got[6] == []


def test_removal_tasks_one_by_one(spark):
    x = spark.createDataFrame([("a" * 600, "en"), ("javascript", "en"), ("kurz", "de"), ("kurz", "en"), (None, "en")], "t string, l string")
    def told(*tasks):
        return [r[0] for r in x.select(cleaning.removal_task(F.col("t"), F.col("l"), tasks)).collect()]
    assert told("remove_256_javascript") == [None, "remove_256_javascript", None, None, "error"]
    assert told("remove_512_non_english", "general_cleaning") == ["general_cleaning", "general_cleaning", "remove_512_non_english", "general_cleaning", "error"]
    assert told("remove_512", "ftfy_fix_text") == ["ftfy_fix_text", "remove_512", "remove_512", "remove_512", "error"]


def test_k_center_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 4)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    chosen = [0]
    while len(chosen) < 7:
        far = ((x[:, None].astype(float) - x[chosen][None]) ** 2).sum(axis=2).min(axis=1)
        chosen.append(int(far.argmax()))
    assert retrieval.k_center(rows, 7) == chosen and retrieval.k_center(rows.limit(0), 3) == []


def test_top_k_in_blocks_of_queries(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(50, 4))
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "item_id long, embedding array<double>")
    queries = items.withColumnRenamed("item_id", "query_id")
    want = {(q, int(i), r + 1) for q in range(50) for r, i in enumerate(np.lexsort((np.arange(50), -(x @ x[q])))[:3])}
    for block in (7, 1000):
        got = {(r["query_id"], r["item_id"], r["rank"]) for r in retrieval.top_k(queries, items, 3, block=block).collect()}
        assert got == want


def test_registry_refuses_and_resolves():
    r = registry.Registry("thing")
    r.add("a", "b")(len)
    assert r.get("b") is len and r.get(min) is min and r.get("math:sqrt")(4) == 2
    with pytest.raises(KeyError):
        r.get("c")
    with pytest.raises(ValueError):
        r.add("a")(min)


def test_splits_and_metadata(spark, tmp_path):
    assert mixing.split_matrix("99/1") == [(0.0, 0.99), (0.99, 1.0), None]
    assert mixing.split_overlap("1,1,0", "1,0,1") == [(0.0, 0.5), None, None]
    with pytest.raises(ValueError):
        mixing.split_matrix("0,0")
    for name, n in (("a_wds", 3), ("b_wds", 250)):
        rows = spark.range(n).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.create_map(F.lit("txt"), F.lit(b"abc")).alias("members"))
        index = shards.write_tar_shards(rows, "key", "members", str(tmp_path / name), max_count=100)
        shards.write_metadata(spark, str(tmp_path / name), index, {"train": 0.5, "val": 0.5, "test": 0.0})
    (tmp_path / "c_wds").mkdir()  # without metadata
    merged = shards.merge_metadata(spark, str(tmp_path))
    assert sum(merged["shard_counts"].values()) == 253 and all(k.startswith(("a_wds/", "b_wds/")) for k in merged["shard_counts"])
    assert sorted(x for v in merged["split_parts"].values() for x in v) == sorted(merged["shard_counts"]) and len(merged["split_parts"]["train"]) == 2
    broken = next((tmp_path / "b_wds").glob("*.tar"))
    broken.write_bytes(broken.read_bytes()[:3000])
    (tmp_path / "b_wds" / "tiny_000001.tar").write_bytes(b"x")
    checked = shards.check_shards(spark, f"{tmp_path}/b_wds/*.tar")
    assert sorted(r["status"] for r in checked.collect()) == ["complete", "complete", "incomplete", "unreadable"]
    gone = shards.quarantine(checked, str(tmp_path / "bad"))
    assert len(gone) == 2 and len(list((tmp_path / "bad").glob("*.tar"))) == 2
    with pytest.raises(Exception, match="more than one shard"):
        mixing.merge_shards([spark.range(3), spark.range(2, 4)], "id").collect()


def test_boxes_need_whole_numbers(spark):
    one_box = F.array(*[F.lit(x) for x in (0.0, 0.0, 1.0, 1.0)])
    none = F.lit(None).cast("array<double>")
    assert one(spark, S.box_iou([none[i] for i in range(4)], [one_box[i] for i in range(4)])) is None
    assert one(spark, M.best_box_iou(F.array(one_box), F.array(one_box))) == 1.0
    assert one(spark, S.span_iou(F.lit(None).cast("double"), F.lit(1.0), F.lit(0.0), F.lit(1.0))) is None


def test_evaluated_expressions_are_arithmetic_only():
    assert M.evaluated("2 + 3*4") == 14 and M.evaluated(r"x = \frac{1}{4}") == 0.25 and M.evaluated("50%") == 0.5 and M.evaluated("[1, 2]") == [1, 2]
    assert M.evaluated("__import__('os').system('x')") is None and M.evaluated("9**9**9") is None and M.evaluated("a+1") is None
    assert M.numeric_match("1,000", "1000") == 0.0 and M.numeric_match("1.005", "1") == 1.0 and M.numeric_match("A b", "ab") == 1.0


def test_vqa_answers():
    assert A.vqa_normal("The  Two dogs, isnt") == "2 dogs isn't"
    assert A.vqa_normal("1,000.5 x-b") == "1000.5 x b" and A.vqa_normal("x - y.") == "x y" and A.vqa_normal("none") == "0"
    assert A.unboxed(r"a \boxed{1} and \boxed{x{y}z}") == "x{y}z" and A.unboxed(r"\fbox{q}") == "q" and A.unboxed(r"\boxed{x") is None


def boxes_one_by_one(counts, capacity, seeds, min_items, min_ratio):
    """An item at a time, as the packing is defined."""
    left, boxes = {a: n for a, n in counts.items() if 0 < a <= capacity}, []
    for s in sorted((s for s in set(seeds) if s in left), reverse=True):
        while left[s]:
            box, room = [s], capacity - s
            left[s] -= 1
            while fits := [a for a in left if left[a] and a <= room]:
                box.append(max(fits))
                left[box[-1]] -= 1
                room -= box[-1]
            if len(box) >= min_items and sum(box) >= min_ratio * capacity:
                boxes.append(tuple(sorted(box, reverse=True)))
                continue
            for a in box:
                left[a] += 1
            break
    return collections.Counter(boxes), {a: n for a, n in left.items() if n}


def test_flexible_seed_boxes():
    import random

    counts = {10: 7, 30: 3, 50: 2, 96: 1}
    assert mixing.seeds_half(counts, 30) == [30, 50, 96] and mixing.seeds_top(counts, 2) == [10, 30]
    rng = random.Random(7)
    for trial in range(300):
        capacity = rng.randrange(5, 120)
        counts = {rng.randrange(1, capacity + 10): rng.randrange(0, 40) for _ in range(rng.randrange(1, 30))}
        seeds = mixing.seeds_top(counts, 5) if trial % 2 else mixing.seeds_half(counts, capacity // 3)
        args = counts, capacity, seeds, rng.choice([1, 2, 4]), rng.choice([0.0, 0.9, 1.0])
        boxes, left = mixing.seeded_boxes(*args)
        got = collections.Counter()
        for box, times in boxes:
            got[box] += times
        assert (got, left) == boxes_one_by_one(*args)
        assert len(boxes) <= 2 * len(counts) + 1
    rounds, rest = mixing.box_rounds({7: 100, 13: 50, 100: 4}, 100)
    used = collections.Counter({a: n for a, n in rest.items()})
    for box, times in rounds:
        for a in box:
            used[a] += times
    assert ((100,), 4) in rounds and used == collections.Counter({7: 100, 13: 50, 100: 4})
    simple, left = mixing.simple_boxes({90: 30, 10: 12}, 100, [90], 10, 0.95)
    assert simple == [((90, 10), 10)] and left == {90: 20, 10: 2}


def test_plans_follow_lengths_and_not_items():
    import random
    import time

    rng = random.Random(3)
    began = time.time()
    few, left = mixing.box_rounds({a: 20_000 + rng.randrange(2000) for a in range(1, 4097)}, 4096)  # 86 million items
    assert time.time() - began < 30 and len(few) < 60_000
    assert sum(len(b) * n for b, n in few) + sum(left.values()) > 80_000_000


def test_word_edits_of_many_words(spark):
    words = [f"w{i}" for i in range(70_000)]
    long_ = spark.createDataFrame([(words, words[:10] + ["x"] + words[11:69_000])], "a array<string>, b array<string>")
    assert long_.select(S.token_edit_distance(F.col("a"), F.col("b")).alias("d")).first()[0] == 1001
    rows = spark.createDataFrame([(" ".join(words[:400]), " ".join(words[:256] + ["w999"] + words[257:399] + ["w1000"])), ("a b", None)], "r string, h string")
    assert grouping.word_error_rate(rows, "r", "h").first()[0] == 0.5
    none = spark.createDataFrame([(None, ["a"]), ([], []), ([None, "a"], ["a"])], "a array<string>, b array<string>")
    assert [r[0] for r in none.select(S.token_edit_distance(F.col("a"), F.col("b")).alias("d")).collect()] == [None, 0, 1]


def test_ngrams_are_counted(spark):
    rng = random.Random(1)
    for _ in range(40):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(12))] for _ in range(2))
        for n in (1, 2, 3):
            x, y = ([tuple(w[i : i + n]) for i in range(len(w) - n + 1)] for w in (a, b))
            assert M.clipped_matches(a, b, n) == sum(min(x.count(g), y.count(g)) for g in set(x))
    many = " ".join(f"w{i % 7000}" for i in range(20_000))
    assert one(spark, M.ngram_f1(F.col("p"), F.col("t"), 2), p=many, t=many) == 1.0


def test_decontamination_of_rows_without_ids(spark):
    passage = " ".join(f"word{i}" for i in range(20))
    clean, other = "nothing here " * 30, " ".join(f"other{i}" for i in range(100))
    docs = spark.createDataFrame([(None, f"{clean}{passage} {clean}"), (None, clean), (7, f"{other} {passage} {other}"), (7, clean), (8, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = collections.defaultdict(list)
    for r in dedup.decontaminate(docs, bench).collect():
        got[r["doc_id"]].append(r["text"])
    assert not any("word5" in (x or "") for v in got.values() for x in v)
    assert sorted(got, key=str) == [7, 8, None] and clean in got[None] and clean in got[7] and len(got[7]) == 3 and got[8] == [None]
    assert {(r["doc_id"], r["n_shared"]) for r in dedup.contaminated(docs, bench).collect()} == {(None, 8), (7, 8)}


def test_compressed_lists(spark, monkeypatch):
    """Every cell probed: the exact answer, ties, nulls and repeated vectors included. Few: recall against it, on the test table."""
    from corpusloom.operators import inverted

    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 10)).round(1)
    x[100:120] = x[5]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "vec_id long, embedding array<double>").repartition(4)
    queries = spark.createDataFrame([(i, rng.normal(size=10).tolist()) for i in range(25)] + [(99, None)], "query_id long, embedding array<double>")
    monkeypatch.setattr(inverted, "BLOCK", 7)
    monkeypatch.setattr(inverted, "CODES", 5)
    index = inverted.train(rows, 6, parts=3, rounds=2)
    lists = inverted.build(rows, index)
    assert sum(len(r["ids"]) // 8 for r in lists.collect()) == 300
    for k in (1, 5, 400):
        got = inverted.search(queries, lists, rows, index, k, 6)
        want = []
        for r in queries.where("embedding IS NOT NULL").collect():
            scores = [sum((a * float(b) for a, b in zip(r["embedding"], v, strict=True)), 0.0) for v in x]
            order = sorted(range(len(x)), key=lambda i: (-scores[i], i))[:k]
            want += [(r["query_id"], i, n + 1) for n, i in enumerate(order)]
        assert sorted(map(tuple, got.select("query_id", "item_id", "rank").collect())) == sorted(want)
        flat = retrieval.top_k(queries, rows.select(F.col("vec_id").alias("item_id"), "embedding"), k, block=9)
        assert flat.count() == len(want)
    none = inverted.train(rows.limit(0), 3)
    assert inverted.search(queries, inverted.build(rows.limit(0), none), rows, none, 3, 3).count() == 0
    monkeypatch.undo()
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    index = inverted.train(e, 64, parts=8, rounds=5)  # these vectors hardly cluster: a quarter of the cells gives 0.73
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    every = {(r["query_id"], r["item_id"]) for r in retrieval.top_k(asked, e.select(F.col("vec_id").alias("item_id"), "embedding"), 10).collect()}
    some = {(r["query_id"], r["item_id"]) for r in inverted.search(asked, inverted.build(e, index), e, index, 10, 32).collect()}
    assert len(every & some) / len(every) >= 0.88, len(every & some) / len(every)


def test_exact_samples_of_any_size(spark, monkeypatch):
    from corpusloom.operators import training

    rows = spark.range(5000).select(F.col("id").alias("k"), F.pmod("id", F.lit(3)).alias("v")).unionByName(spark.range(900).select(F.lit(7).cast("long").alias("k"), F.col("id").alias("v")))
    h = F.xxhash64(F.lit(42), "k")
    want = [(r["k"], r["v"]) for r in rows.orderBy(h, "k").select("k", "v").collect()]
    for few in (10, 200, 2000):
        monkeypatch.setattr(storage, "FEW", few)
        for n in (0, 1, 500, 2950, 5899, 5900, 9000):
            got = collections.Counter(r["k"] for r in storage.least_rows(rows, n, h, "k").collect())
            assert got == collections.Counter(k for k, _ in want[:n]), (few, n)
    half = training.percent_rows(rows, 50, "k")
    assert half.count() == 2950 and "TakeOrdered" not in half._jdf.queryExecution().toString()
    monkeypatch.setattr(training, "FEW", 10)
    assert sorted(r["k"] for r in training.first_rows(rows, 1000, "k").collect()) == sorted(k for k, _ in want)[:1000]
    assert storage.least_rows(rows.limit(0), 100, h, "k").count() == 0


def test_places_in_files_of_many_splits(spark, tmp_path):
    lines = [f"{i}\ta{i}\tb{i}\tentailment" for i in range(3000)]
    for name in ("x", "y"):
        (tmp_path / f"{name}.tsv").write_text("\n".join(["id\tp\th\tlabel", *lines]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        got = readers.read_pairs_tsv(spark, str(tmp_path / "*.tsv"), {"entailment": 0, "contradiction": 1}, (0, 1, 2, 3))
        assert sorted(r["uid"] for r in got.collect()) == sorted([*range(3000)] * 2)
        (tmp_path / "p.jsonl").write_text("".join('{"sample_id": %d, "answer": "%s"}\n' % (i % 1500, "first" if i < 1500 else "again") for i in range(3000)))
        assert {r["answer"] for r in readers.first_predictions(spark, str(tmp_path / "p.jsonl")).collect()} == {"first"}
        spark.range(100).coalesce(1).write.parquet(str(tmp_path / "blocks"))
        assert sorted(r["id"] for r in readers.read_blocks(spark, str(tmp_path / "blocks"), 0.25).collect()) == [*range(25)]
        assert readers.read_object_store(spark, str(tmp_path / "blocks"), first=1).count() == 100 and training_files(["b", "a"], 1) == ["a"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def training_files(files, n):
    from corpusloom.operators.training import first_files

    return first_files(files, n)


def test_public_suffixes(spark, tmp_path):
    tree = cleaning._rule_tree(cleaning.SOME_RULES)
    cases = {"a.b.co.uk": ("b", "co.uk"), "co.uk": ("", "co.uk"), "b.uk": ("b", "uk"), "x.foo.kawasaki.jp": ("x", "foo.kawasaki.jp"), "foo.kawasaki.jp": ("", "foo.kawasaki.jp"), "kawasaki.jp": ("kawasaki", "jp")}
    cases |= {"a.city.kawasaki.jp": ("city", "kawasaki.jp"), "www.ck": ("www", "ck"), "a.b.ck": ("a", "b.ck"), "localhost": ("localhost", ""), "a.unknown": ("unknown", ""), "1.2.3.4": ("1.2.3.4", ""), "a.com.": ("a", "com")}
    assert {k: cleaning.split_host(k, tree) for k in cases} == cases
    (tmp_path / "list.dat").write_text("// comment\n\ncom\n*.ck // more\n!www.ck\n// ===BEGIN PRIVATE DOMAINS===\nblogspot.com\n")
    assert cleaning.suffix_rules(spark, str(tmp_path / "list.dat")) == ["com", "*.ck", "!www.ck"]
    urls = spark.createDataFrame([(1, "http://bad.co.uk/x/y"), (2, "http://bad.good.co.uk/x/y"), (3, None)], "page_id long, url string")
    got = {r["page_id"]: r["reason"] for r in cleaning.classify_urls(urls, ["bad"], rules=cleaning.SOME_RULES).collect()}
    assert got[1] == "domain" and got[2] == "keep"


def test_stopped_block_writes_go_on(spark, tmp_path, monkeypatch):
    from corpusloom.operators import judging

    monkeypatch.setattr(storage, "WAVE_BLOCKS", 4)
    folder = f"file://{tmp_path}/blocks"
    rows = spark.range(200).select(F.col("id").alias("k"), F.when(F.col("id") == 77, "bad").otherwise("t").alias("t"))

    def model(texts):
        if "bad" in texts:
            raise ValueError("stopped")
        return [[float(len(x))] for x in texts]

    with pytest.raises(Exception, match="stopped"):
        judging.embed_blocks(rows, "k", "t", model, folder, 10)
    done = spark.read.parquet(folder).select("block_id").distinct().count()
    assert 0 < done < 20
    whole = judging.embed_blocks(rows.withColumn("t", F.lit("t")), "k", "t", model, folder, 10)
    assert whole.count() == 200 and whole.select("k").distinct().count() == 200


def test_sampled_files():
    files = [f"f{i:03d}" for i in range(200)]
    some = readers.sampled_files(files, 30, 600)
    assert len(some) == 10 and some == sorted(set(some)) and set(some) <= set(files) and some == readers.sampled_files(files[::-1], 30, 600)
    assert readers.sampled_files(files, 1, 10**9) != [] and readers.sampled_files(files, 600, 600) == files and readers.sampled_files(files, 30, 600, seed=1) != some


def test_blend_is_the_loop_whatever_the_guesses(spark, monkeypatch):
    import random

    monkeypatch.setattr(mixing, "BLEND_RANGE", 400)
    monkeypatch.setattr(mixing, "BLEND_BLOCK", 64)
    rng = random.Random(4)
    for weights in ([1.0], [0.3, 0.7], [0.0, 1.0, 2.0], [0.9985, 0.001, 0.0005], [rng.random() for _ in range(7)], [rng.random() ** 6 for _ in range(5)]):
        want = list(mixing.blend_steps(weights, 3210))
        share = mixing.normalise_weights(weights)
        which, sample, end = mixing.blend_block(share, np.zeros(len(share), np.int64), 0, 3210)
        assert list(zip(which.tolist(), sample.tolist(), strict=True)) == want and end.sum() == 3210
    got = mixing.blend_index(spark, weights, 3210).orderBy("position").collect()
    assert [(r["dataset_index"], r["sample_index"]) for r in got] == want and [r["position"] for r in got] == list(range(3210))


def test_cycles_and_streams(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"r{i}") for i in range(5)], "k long, v string")
    q = iterate.cycle(spark, rows, "k", 200).writeStream.format("memory").queryName("cycled").start()
    try:
        deadline = time.time() + 40
        while time.time() < deadline and spark.table("cycled").count() < 12:
            time.sleep(0.5)
    finally:
        q.stop()
    got = spark.table("cycled").collect()
    assert len(got) >= 12 and all(r["k"] == r["position"] % 5 and r["epoch"] == r["position"] // 5 for r in got)


def test_cider_joins_only_the_frequencies(spark):
    from corpusloom.functions import captions

    rows = spark.createDataFrame([(1, ["a", "b"], [["a", "b"], None, ["c"]]), (2, [], [["x"]]), (3, None, None), (4, ["a"], [])], "id int, p array<string>, r array<array<string>>")
    got = captions.cider(rows, "id", "p", "r")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "strategy=broadcast" not in plan  # no table that grows with the rows is sent to the driver
    assert {r["id"]: round(r["cider"], 6) for r in got.collect()} == {1: 2.5, 2: 0.0, 3: 0.0, 4: 0.0}


def test_cells_and_lists_send_on_k_a_block_only(spark):
    import numpy as np

    from corpusloom.operators import inverted, retrieval, storage

    rng = np.random.default_rng(3)
    x = rng.integers(-3, 4, (90, 4)).astype(float)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)], "vec_id long, embedding array<double>").repartition(3)
    queries = rows.where("vec_id % 5 = 0").withColumnRenamed("vec_id", "query_id")
    s = x @ x.T
    true = {(q, i, n + 1) for q in range(0, 90, 5) for n, i in enumerate(sorted(range(90), key=lambda i: (-s[q, i], i))[:4])}
    centres = retrieval.train_cells(rows, 3)
    found = retrieval.search_cells(queries, retrieval.add_to_cells(rows, centres), centres, 4, 3, block=7)
    assert "aggregate(" not in found._jdf.queryExecution().optimizedPlan().toString()  # no product pair by pair
    assert {(r["query_id"], r["item_id"], r["rank"]) for r in found.collect()} == true
    index = inverted.train(rows, 3, parts=2, rounds=2)
    tables = storage.mark_tables()
    found = inverted.search(queries, inverted.build(rows, index), rows, index, 4, 3)
    assert storage.mark_tables() == tables  # no candidates are written
    assert {(r["query_id"], r["item_id"], r["rank"]) for r in found.collect()} == true
    row, column, scores = retrieval.best_products(np.array([[1.0]]), np.array([[1.0], [np.nan], [1.0], [2.0]]), np.array([9, 1, 3, 4]), 3)
    assert row.tolist() == [0, 0, 0] and column.tolist() == [3, 2, 0] and scores.tolist() == [2.0, 1.0, 1.0]
