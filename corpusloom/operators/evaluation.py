"""Task-level aggregations (AGG-02, 07..09, 11..14, 17, 19, 20, 23, 24, 26, 29..33, 35..37, 40..43, EXT-01, 03..05, 12, 13, 24, JOIN-05, paired consistency)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import answers as A
from corpusloom.functions import scoring as S
from corpusloom.functions import similarity as M
from corpusloom.functions import text as T
from corpusloom.operators.grouping import ratio


def share(condition: Column) -> Column:
    """Mean of a condition; null counts as false."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def bypassed(rows: DataFrame, by: list[str], score: str, order: str) -> DataFrame:
    """AGG-02: each group's scores as they are, in order."""
    own = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, score))).alias("_s"))
    return own.select(*by, F.transform("_s", lambda x: x[score]).alias("scores"))


def micro_accuracy(rows: DataFrame, truth: str, prediction: str) -> DataFrame:
    """AGG-07: share of equal answers, trimmed, any case."""
    same = F.lower(F.trim(F.col(truth))) == F.lower(F.trim(F.col(prediction)))
    return rows.agg(share(same).alias("accuracy"), F.count("*").alias("n"))


def quad_accuracy(rows: DataFrame, id_col: str, answer: str) -> DataFrame:
    """AGG-08: rows 4k .. 4k + 3 are two questions on two images, expected 1, 0, 0, 1 (answers 1, 0 or -1).

    question: both images of a question right; image: both questions of an image right; binary: single rows; group: all
    four. Groups without exactly four rows don't count.
    """
    right = (F.when((F.col(id_col) % 4).isin(0, 3), 1).otherwise(0) == F.col(answer)).cast("int")
    at = [F.max(F.when(F.col(id_col) % 4 == i, right)).alias(f"r{i}") for i in range(4)]
    quads = rows.groupBy(F.floor(F.col(id_col) / 4).alias("q")).agg(*at, F.count("*").alias("n")).where("n = 4")
    pair = lambda a, b: F.col(f"r{a}") * F.col(f"r{b}")
    return quads.agg(
        (F.avg(pair(0, 1) + pair(2, 3)) / 2).alias("question"), (F.avg(pair(0, 2) + pair(1, 3)) / 2).alias("image"),
        (F.avg(F.col("r0") + F.col("r1") + F.col("r2") + F.col("r3")) / 4).alias("binary"), F.avg(pair(0, 1) * pair(2, 3)).alias("group"),
    )


def composite_table(rows: DataFrame, kind: str, score: str, merged: dict[str, list[str]]) -> DataFrame:
    """AGG-09: (kind, value): mean by kind, the kinds of a composite being replaced by the mean of theirs; `overall` is the mean of these lines."""
    means = rows.groupBy(F.col(kind).alias("kind")).agg(F.avg(score).alias("value"))
    to = F.col("kind")
    for name, parts in merged.items():
        to = F.when(F.col("kind").isin(*parts), name).otherwise(to)
    table = means.groupBy(to.alias("kind")).agg(F.avg("value").alias("value"))
    return table.unionByName(table.agg(F.avg("value").alias("value")).withColumn("kind", F.lit("overall")))


def mean_error_rate(rows: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """AGG-11: mean over rows of edits over the longer one's words."""
    return rows.agg(F.avg(M.mixed_error_rate(F.split(reference, " "), F.split(hypothesis, " "))).alias("mer"))


def error_rates(rows: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """AGG-10, AGG-11: (wer, mer), word_error_rate() and mean_error_rate() in one pass, so that a row's edits are counted once."""
    words = rows.select(F.split(reference, " ").alias("r"), F.split(hypothesis, " ").alias("h"))
    found = words.withColumn("d", S.token_edit_distance(F.col("r"), F.col("h"))).select(F.size("r").alias("n"), "d", M.mixed_error_rate(F.col("r"), F.col("h"), F.col("d")).alias("m"))
    known = F.col("d").isNotNull()
    return found.agg((100 * F.sum("d") / F.sum(F.when(known, F.col("n")))).alias("wer"), F.avg("m").alias("mer"))


def facet_table(rows: DataFrame, columns: list[str], arrays: list[str], right: str, baseline: DataFrame | None = None) -> DataFrame:
    """AGG-13: (facet, value, accuracy, correct, total, rank, gain): percentages rounded to 2 by each value of each facet, array facets by element, and `average` for all.

    rank orders a facet's values by accuracy, ties by value; gain is against a baseline (facet, value, accuracy), null without.
    """
    def parts(c: str) -> Column:
        return F.transform(F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<string>"))), lambda v: F.struct(F.lit(c).alias("facet"), v.cast("string").alias("value")))

    plain = [F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns]
    every = F.concat(F.array(F.struct(F.lit("average").alias("facet"), F.lit("all").alias("value")), *plain), *map(parts, arrays))
    long = rows.select(F.col(right).cast("int").alias("r"), F.explode(every).alias("f"))
    table = long.groupBy("f.facet", "f.value").agg(F.round(F.avg("r") * 100, 2).alias("accuracy"), F.sum("r").alias("correct"), F.count("*").alias("total"))
    table = table.withColumn("rank", F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("accuracy"), "value")))
    if baseline is None:
        return table.withColumn("gain", F.lit(None).cast("double"))
    base = baseline.select("facet", "value", F.col("accuracy").alias("_base"))
    return table.join(base, ["facet", "value"], "left").withColumn("gain", F.round(F.col("accuracy") - F.col("_base"), 2)).drop("_base")


def step_errors(joined: DataFrame, steps: list[str], whole: str) -> DataFrame:
    """AGG-14: classes of problems by whether their steps and the whole are right, as counts and rates.

    generalisation: all steps right, the whole wrong; knowledge: a step and the whole wrong; mastery: the whole and
    any step (loose) or all steps (strict) right; rote: the whole right, and all steps (loose) or any step (strict)
    wrong. Rote rates are of rote and mastery together.
    """
    every, some = F.lit(True), F.lit(False)
    for s in steps:
        ok = F.coalesce(F.col(s), F.lit(False))
        every, some = every & ok, some | ok
    done = F.coalesce(F.col(whole), F.lit(False))
    n = {
        "generalisation": every & ~done, "knowledge": ~every & ~done, "mastery_loose": some & done, "mastery_strict": every & done,
        "rote_loose": ~some & done, "rote_strict": ~every & done,
    }
    out = joined.agg(F.count("*").alias("total"), *[F.sum(c.cast("long")).alias(k) for k, c in n.items()])
    rates = [ratio(F.col(k), F.col("total")).alias(f"{k}_rate") for k in ("generalisation", "knowledge", "mastery_loose", "mastery_strict")]
    rates += [ratio(F.col(f"rote_{k}"), F.col(f"rote_{k}") + F.col(f"mastery_{k}")).alias(f"rote_{k}_rate") for k in ("loose", "strict")]
    return out.select("*", *rates)


def first_n_scores(rows: DataFrame, key: str, answer: str, truth: str, order: str, sizes: list[int]) -> DataFrame:
    """AGG-17, WIN-10: means over keys of cov@n (a right answer among the first n) and maj@n (the first n's most frequent answer, ties to the first seen, is right)."""
    own = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, F.col(answer).alias("a")))).alias("_s"), F.min(truth).alias("_t"))
    own = own.select("_t", F.transform("_s", lambda x: x["a"]).alias("_a"))
    cov = [share(F.exists(F.slice("_a", 1, n), lambda a: a == F.col("_t"))).alias(f"cov_{n}") for n in sizes]
    maj = [share(A.majority_vote(F.slice("_a", 1, n))[0] == F.col("_t")).alias(f"maj_{n}") for n in sizes]
    return own.agg(*cov, *maj)


def span_recall(rows: DataFrame, start: str, end: str, predicted: str, thresholds: tuple[float, ...] = (0.3, 0.5, 0.7)) -> DataFrame:
    """AGG-19: mean overlap of predicted spans [start, end] and shares of at least each threshold; a null prediction overlaps nothing."""
    iou = F.coalesce(S.span_iou(F.col(start).cast("double"), F.col(end).cast("double"), F.col(predicted)[0], F.col(predicted)[1]), F.lit(0.0))
    return rows.select(iou.alias("i")).agg(F.avg("i").alias("mean_iou"), *[share(F.col("i") >= t).alias(f"recall_{str(t).replace('.', '_')}") for t in thresholds])


def box_accuracy(rows: DataFrame, predicted: str, truth: str, by: list[str] | None = None, thresholds: tuple[float, ...] = (0.1, 0.3, 0.5, 0.7, 0.9)) -> DataFrame:
    """AGG-20: mean overlap of boxes (arrays of four), shares of at least each threshold, and of centres inside, for all rows and every combination of the columns."""
    p, t = [F.col(predicted)[i] for i in range(4)], [F.col(truth)[i] for i in range(4)]
    scored = rows.select(*(by or []), F.coalesce(S.box_iou(p, t), F.lit(0.0)).alias("i"), F.coalesce(S.centre_in_box(p, t), F.lit(False)).alias("c"))
    sums = [F.avg("i").alias("iou"), *[share(F.col("i") >= x).alias(f"acc_{str(x).replace('.', '_')}") for x in thresholds], share(F.col("c")).alias("centre"), F.count("*").alias("n")]
    return scored.cube(*by).agg(*sums) if by else scored.agg(*sums)


def shard_duplicates(rows: DataFrame, folder: str, key: str, shard: str, top: int = 10) -> DataFrame:
    """AGG-23: (folder, key, shards, rank): keys that lie in more than one shard of a folder, the ten in most shards of each."""
    many = rows.groupBy(folder, key).agg(F.count_distinct(shard).alias("shards")).where("shards > 1")
    return many.withColumn("rank", F.row_number().over(Window.partitionBy(folder).orderBy(F.desc("shards"), key))).where(F.col("rank") <= top)


def column_frequency(files: DataFrame) -> DataFrame:
    """AGG-24: (column, files) of rows (file, columns array<string>)."""
    return files.select(F.explode(F.array_distinct("columns")).alias("column")).groupBy("column").agg(F.count("*").alias("files"))


def weighted_histogram(rows: DataFrame, value: str, weight: str | None = None, bins: int = 10) -> DataFrame:
    """AGG-26: (bin, n, weight) in equal widths from the least to the greatest value; the greatest one falls into bin `bins`, after the last."""
    low_high = rows.agg(F.min(value).cast("double").alias("_l"), F.max(value).cast("double").alias("_h"))
    both = rows.join(F.broadcast(low_high)).where(F.col(value).isNotNull())
    at = F.when(F.col("_h") > F.col("_l"), F.floor((F.col(value) - F.col("_l")) * bins / (F.col("_h") - F.col("_l")))).otherwise(0)
    return both.groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.sum(F.col(weight) if weight else F.lit(1)).alias("weight"))


def difference_ratio(joined: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """AGG-29, JOIN-05: (ratio, delta, total) of arrays a and b: sum |a - b| over sum |a|, sums being what is merged; ratio rounded to 3, 0 for a total of 0."""
    delta = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + F.coalesce(x.cast("double"), F.lit(0.0)))
    total = F.aggregate(F.col(a), F.lit(0.0), lambda s, x: s + F.abs(x).cast("double"))
    sums = joined.groupBy(*by).agg(F.sum(delta).alias("delta"), F.sum(total).alias("total"))
    return sums.select(*by, F.round(ratio(F.col("delta"), F.col("total")), 3).alias("ratio"), "delta", "total")


def sequence_ratio(tokens: DataFrame, sequence: str, log_ratio: str, advantage: str, mask: str) -> DataFrame:
    """AGG-30: adds ratio and mean_advantage: of each sequence's unmasked tokens the exponent of the mean log ratio and the mean advantage, on its unmasked tokens; 0 on the others.

    Sequences are combined before the shuffle and joined back, so that a very long one is not one window's.
    """
    means = tokens.where(mask).groupBy(F.col(sequence).alias("_q")).agg(F.exp(F.avg(log_ratio)).alias("_r"), F.avg(advantage).alias("_a"))
    both = tokens.join(means, F.col(sequence).eqNullSafe(F.col("_q")), "left")
    on = F.coalesce(F.col(mask), F.lit(False))
    return both.withColumn("ratio", F.when(on, F.col("_r")).otherwise(0.0)).withColumn("mean_advantage", F.when(on, F.col("_a")).otherwise(0.0)).drop("_q", "_r", "_a")


def clipped_loss(tokens: DataFrame, ratio_col: str, advantage: str, mask: str, behaviour_kl: str, clip: float = 0.2, clip_higher: float | None = None, dual: float | None = None, cap: float | None = None) -> DataFrame:
    """AGG-31: adds loss, clip_mask, dual_clip_mask, behave_weight and behave_mask of the clipped objective.

    loss = max(-A r, -A clip(r)); with dual, at most sign(A) * dual * A; times the behaviour weight exp(kl) where that is within the cap.
    """
    r, a, on = F.col(ratio_col), F.col(advantage), F.coalesce(F.col(mask), F.lit(False))
    high = 1 + (clip if clip_higher is None else clip_higher)
    first, second = -a * r, -a * F.greatest(F.lit(1.0 - clip), F.least(F.lit(high), r))
    loss = F.greatest(first, second)
    third = F.signum(a) * F.lit(float(dual or 0)) * a
    weight = F.exp(behaviour_kl)
    kept = on & (weight <= cap) if cap is not None else on
    out = tokens.withColumn("clip_mask", on & (first < second)).withColumn("dual_clip_mask", (on & (third < loss)) if dual is not None else F.lit(False))
    least = F.least(loss, third) if dual is not None else loss
    return out.withColumn("behave_mask", kept).withColumn("behave_weight", F.when(kept, weight).otherwise(0.0)).withColumn("loss", least * F.when(kept, weight).otherwise(0.0))


def masked_mean(tokens: DataFrame, value: str, mask: str) -> DataFrame:
    return tokens.agg(ratio(F.sum(F.when(F.col(mask), F.col(value)).otherwise(0.0)), F.sum(F.col(mask).cast("int"))).alias("mean"))


def rollout_statistics(sequences: DataFrame, reward: str, length: str, valid: str, prompt: str) -> DataFrame:
    """AGG-32: numbers of sequences, tokens and valid tokens, and mean lengths of those with a reward above 0 and of the others; 0 where there are none."""
    good = F.col(reward) > 0
    mean = lambda c, on: F.coalesce(F.avg(F.when(on, F.col(c))), F.lit(0.0))
    return sequences.agg(
        F.count("*").alias("n_seqs"), F.sum(length).alias("n_tokens"), F.sum(valid).alias("n_valid_tokens"), F.count_if(good).alias("correct_n_seqs"), F.count_if(~good).alias("incorrect_n_seqs"),
        mean(length, good).alias("correct_seq_len"), mean(length, ~good).alias("incorrect_seq_len"), F.avg(prompt).alias("prompt_len"), F.avg(reward).alias("task_reward"),
    )


def reward_by(rows: DataFrame, kind: str, reward: str) -> DataFrame:
    """AGG-33."""
    return rows.groupBy(kind).agg(F.avg(reward).alias("reward"), F.count("*").alias("n"))


def rank_accuracy(scores: DataFrame, query: str, item: str, score: str, sizes: tuple[int, ...] = (1, 5, 20)) -> DataFrame:
    """AGG-35: of (query, item, score) where a query's own item has its name: shares of queries whose item is among the first k, in percent, and its mean rank from 0; ties to the lesser item."""
    own = scores.where(F.col(query) == F.col(item)).select(F.col(query).alias("_q"), F.col(score).alias("_s"))
    better = scores.join(own, F.col(query) == F.col("_q")).where((F.col(score) > F.col("_s")) | ((F.col(score) == F.col("_s")) & (F.col(item) < F.col("_q"))))
    ranks = own.join(better.groupBy("_q").agg(F.count("*").alias("_n")), "_q", "left").select(F.coalesce("_n", F.lit(0)).alias("rank"))
    return ranks.agg(*[(100 * share(F.col("rank") < k)).alias(f"top{k}_acc") for k in sizes], F.avg("rank").alias("mean_rank"), F.count("*").alias("queries"))


def perplexity(rows: DataFrame, loss: str, tokens: str, original: str) -> DataFrame:
    """AGG-36: of summed losses and token counts a row: mean loss over all tokens but one, its perplexity, and that adjusted to the original tokens."""
    s = rows.agg(F.sum(loss).alias("l"), F.sum(tokens).alias("t"), F.sum(original).alias("o"))
    mean, per = F.col("l") / (F.col("t") - 1), (F.col("t") - 1) / (F.col("o") - 1)
    return s.select(mean.alias("mean_loss"), F.exp(F.least(F.lit(20.0), mean)).alias("ppl"), per.alias("token_ratio"), F.exp(F.least(F.lit(20.0), mean * per)).alias("adjusted_ppl"))


def best_threshold(rows: DataFrame, probability: str, label: str, steps: int = 100) -> DataFrame:
    """AGG-37: (threshold, accuracy): of i / steps, the least one for which probability >= threshold agrees most often with the label.

    One histogram of `steps` bins: what a threshold gets right follows from sums over the bins.
    """
    at = F.least(F.floor(F.col(probability) * steps + F.lit(1e-9)), F.lit(steps - 1)).cast("int")
    bins = rows.groupBy(at.alias("b")).agg(F.sum(F.col(label).cast("long")).alias("yes"), F.count("*").alias("n"))
    total = bins.agg(F.array_sort(F.collect_list(F.struct("b", "yes", "n"))).alias("h"))  # at most `steps` rows
    good = lambda t: F.aggregate("h", F.lit(0).cast("long"), lambda s, x: s + F.when(x["b"] >= t, x["yes"]).otherwise(x["n"] - x["yes"]))
    count = F.aggregate("h", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    tried = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda t: F.struct((good(t) / count).alias("accuracy"), (-t).alias("t")))
    best = total.select(F.array_max(tried).alias("b"))
    return best.select((-F.col("b.t") / float(steps)).alias("threshold"), F.col("b.accuracy").alias("accuracy"))


def ensemble(predictions: list[DataFrame], key: str, scores: str, labels: list[str]) -> DataFrame:
    """EXT-24: (key, scores, label): the models' class scores averaged by class, and the label of the greatest, ties to the first. Keys that a model lacks are averaged over the others."""
    every = predictions[0].select(key, scores)
    for p in predictions[1:]:
        every = every.unionByName(p.select(key, scores))
    means = every.groupBy(key).agg(*[F.avg(F.col(scores)[i]).alias(f"_c{i}") for i in range(len(labels))])
    mean = F.array(*[f"_c{i}" for i in range(len(labels))])
    return means.select(key, mean.alias("scores"), F.element_at(F.array(*map(F.lit, labels)), F.array_position(mean, F.array_max(mean)).cast("int")).alias("label"))


#: How categories of the OCR benchmark add up to its text recognition score.
OCR_RECOGNITION = ("Regular Text Recognition", "Irregular Text Recognition", "Artistic Text Recognition", "Handwriting Recognition", "Digit String Recognition", "Non-Semantic Text Recognition")


def ocr_counters(rows: DataFrame, category: str, dataset: str, prediction: str, answers: str, spaceless: str = "HME100k") -> DataFrame:
    """AGG-40: (category, score): points a category, one for each answer that the prediction holds; one data set is compared without spaces and with case. With the lines `recognition` and `final`."""

    def plain(c: Column) -> Column:
        flat = F.replace(F.trim(c), F.lit("\n"), F.lit(" "))
        return F.when(F.col(dataset) == spaceless, F.replace(flat, F.lit(" "), F.lit(""))).otherwise(F.lower(flat))

    points = F.size(F.filter(answers, lambda a: F.contains(plain(F.col(prediction)), plain(a))))
    table = rows.groupBy(F.col(category).alias("category")).agg(F.sum(points).alias("score"))
    total = table.agg(F.coalesce(F.sum(F.when(F.col("category").isin(*OCR_RECOGNITION), F.col("score"))), F.lit(0)).alias("recognition"), F.coalesce(F.sum("score"), F.lit(0)).alias("final"))
    return table.unionByName(total.select(F.expr("stack(2, 'recognition', recognition, 'final', final) AS (category, score)")))


def class_accuracies(rows: DataFrame, kind: str, right: str) -> DataFrame:
    """AGG-41, EXT-12: (kind, accuracy, n) in percent; the line `total` is over all rows."""
    table = rows.select(F.coalesce(F.col(kind).cast("string"), F.lit("")).alias("kind"), F.coalesce(F.col(right), F.lit(False)).alias("r")).rollup("kind").agg((100 * share(F.col("r"))).alias("accuracy"), F.count("*").alias("n"))
    return table.withColumn("kind", F.coalesce("kind", F.lit("total")))


def same_plain(a: Column, b: Column) -> Column:
    """Equal without full stops and case."""
    return F.replace(F.lower(a), F.lit("."), F.lit("")) == F.replace(F.lower(b), F.lit("."), F.lit(""))


def mixed_form_right(kind: Column, prediction: Column, answer: Column, choices: Column) -> Column:
    """EXT-13: multi_choice rows compare the option letter that the prediction begins with or whose text it is; others compare normalised answers."""
    said = F.coalesce(F.upper(T.option_letter(prediction)), A.choice_letter(F.trim(prediction), choices), F.trim(prediction))
    return F.when(kind == "multi_choice", said == answer).otherwise(A.vqa_normalise(prediction) == A.vqa_normalise(answer))


def subset_sizes(rows: DataFrame, subset: str) -> DataFrame:
    """AGG-42: (subset, n, mean_n): counts, beside the mean count."""
    counts = rows.groupBy(F.col(subset).alias("subset")).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(counts.agg(F.avg("n").alias("mean_n"))))


def throughput(rows: DataFrame, latency: str, first_token: str, tokens: str) -> DataFrame:
    """AGG-43: means of time to the first token (a tenth of the latency where unknown), time a token (E2E - TTFT) / (n - 1), the whole latency for one token, and speed (0 for one)."""
    first = F.coalesce(F.col(first_token), F.col(latency) * 0.1)
    per = F.when(F.col(tokens) > 1, (F.col(latency) - first) / (F.col(tokens) - 1)).otherwise(F.col(latency))
    speed = F.when((F.col(tokens) > 1) & (per > 0), 1 / per).otherwise(0.0)
    return rows.agg(F.avg(first).alias("ttft"), F.avg(per).alias("tpot"), F.avg(speed).alias("speed"), F.sum(tokens).alias("tokens"))


def segmentation_scores(rows: DataFrame, truth: str, prediction: str, classes: int) -> DataFrame:
    """EXT-01: (mean_iou, mean_accuracy, accuracy) over classes 0 .. classes - 1; rows whose truth is outside count nowhere, classes without rows in no mean."""
    cells = rows.where(F.col(truth).between(0, classes - 1)).groupBy(F.col(truth).alias("t"), F.col(prediction).alias("p")).agg(F.count("*").alias("n"))
    own = cells.groupBy(F.col("t").alias("c")).agg(F.sum("n").alias("a"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("r"))
    said = cells.groupBy(F.col("p").alias("c")).agg(F.sum("n").alias("s"))
    both = own.join(said, "c", "full").where(F.col("c").between(0, classes - 1)).fillna(0)
    union = F.col("a") + F.col("s") - F.col("r")
    return both.agg(F.avg(F.when(union > 0, F.col("r") / union)).alias("mean_iou"), F.avg(F.when(F.col("a") > 0, F.col("r") / F.col("a"))).alias("mean_accuracy"), ratio(F.sum("r"), F.sum("a")).alias("accuracy"))


def retrieval_report(hits: DataFrame, queries: int, sizes: tuple[int, ...] = (1, 5, 20, 100)) -> DataFrame:
    """EXT-03: (k, accuracy): percent of the queries with a right item among their first k, of hits (query_id, rank, right)."""
    first = hits.where("right").groupBy("query_id").agg(F.min("rank").alias("first"))
    wide = first.agg(*[(100.0 * F.count_if(F.col("first") <= k) / queries).alias(str(k)) for k in sizes])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.coalesce(F.col(str(k)), F.lit(0.0)).alias("accuracy")) for k in sizes])).alias("x")).select("x.*")


def dialogue_f1(rows: DataFrame, guess: str, answer: str) -> DataFrame:
    """EXT-04, AGG-38: (f1, n): mean token F1 after the end mark is cut off; guesses `no_passages_used` are empty; rows with an empty answer don't count."""
    plain = lambda c: F.trim(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("<|endoftext|>"), F.lit("")))
    g = F.when(plain(guess) == "no_passages_used", "").otherwise(plain(guess))
    kept = rows.select(g.alias("g"), plain(answer).alias("a")).where(T.squad_normal(F.col("a")) != "")
    return kept.agg(F.avg(M.ngram_f1(F.col("g"), F.col("a"), 1)).alias("f1"), F.count("*").alias("n"))


def exact_of_many(rows: DataFrame, prediction: str, answers: str) -> DataFrame:
    """EXT-05: (accuracy, n): normalised prediction equal to any of the normalised answers."""
    return rows.agg(share(F.exists(answers, lambda a: T.squad_normal(a) == T.squad_normal(F.col(prediction)))).alias("accuracy"), F.count("*").alias("n"))


def paired_consistency(rows: DataFrame, item: str, kind: str, positive: str, right: str, category: str | None = None) -> DataFrame:
    """(text, video, group) in percent over items: both text rows right, both video rows right, all four; by category if given."""
    ok = F.col(right).cast("int")
    cell = lambda k, p: F.coalesce(F.max(F.when((F.col(kind) == k) & (F.col(positive) == p), ok)), F.lit(0))
    by = [category] if category else []
    items = rows.groupBy(item, *by).agg((cell("text", True) * cell("text", False)).alias("t"), (cell("video", True) * cell("video", False)).alias("v"))
    return items.groupBy(*by).agg((100 * F.avg("t")).alias("text"), (100 * F.avg("v")).alias("video"), (100 * F.avg(F.col("t") * F.col("v"))).alias("group"))


def binary_and_multiple(rows: DataFrame, group: str, dataset: str, right: str) -> DataFrame:
    """(dataset, accuracy, multiple): row accuracy, and the share of groups with every row right; `total` for all."""
    ok = F.coalesce(F.col(right), F.lit(False))
    groups = rows.groupBy(F.col(dataset).cast("string").alias("dataset"), group).agg(F.sum(ok.cast("int")).alias("k"), F.count("*").alias("n"))
    out = groups.rollup("dataset").agg((F.sum("k") / F.sum("n")).alias("accuracy"), share(F.col("k") == F.col("n")).alias("multiple"))
    return out.withColumn("dataset", F.coalesce("dataset", F.lit("total")))


def vqa_table(rows: DataFrame, task: str, prediction: str, answers: str) -> DataFrame:
    """AGG-39: (task, accuracy, n): ChartQA within five hundredths, VQAv2 and TextVQA matches over three, document tasks by edit similarity, others equal to the first answer; answers normalised."""
    p = A.vqa_normalise(F.col(prediction))

    @F.pandas_udf("array<string>")
    def each(x):
        return x.map(lambda a: None if a is None else [A.vqa_normal(v) for v in a])

    base = rows.select(F.col(task).alias("task"), p.alias("p"), each(F.col(answers)).alias("a"))
    plain = lambda c: F.regexp_replace(c, "%+$", "")
    a0 = F.try_element_at("a", F.lit(1))
    x, y = plain(F.col("p")).try_cast("double"), plain(a0).try_cast("double")
    chart = F.when(x.isNotNull() & y.isNotNull(), (x >= y * 0.95) & (x <= y * 1.05)).otherwise(plain(F.col("p")) == plain(a0)).cast("double")
    votes = F.least(F.lit(1.0), F.size(F.filter("a", lambda v: v == F.col("p"))) / 3.0)
    score = F.when(F.col("task") == "ChartQA", chart).when(F.col("task").isin("VQAv2", "TextVQA"), votes).when(F.col("task").isin("SPDocVQA", "InfoVQA"), S.anls(F.col("p"), F.col("a"))).otherwise((F.col("p") == a0).cast("double"))
    return base.groupBy("task").agg(F.avg(F.coalesce(score, F.lit(0.0))).alias("accuracy"), F.count("*").alias("n"))
