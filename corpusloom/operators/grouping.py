"""Aggregations (AGG-01, 03..06, 10, 12, 13, 15..18, 21, 25, EXT-01); those of whole tasks are in evaluation.py."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import scoring as S


def ratio(above: Column, below: Column) -> Column:
    """above / below; 0 where below is 0."""
    return F.coalesce(F.try_divide(above.cast("double"), below.cast("double")), F.lit(0.0))


def group_mean(results: DataFrame, by: list[str], mean_col: str, size_col: str, weight_by_size: bool = True) -> DataFrame:
    value = F.sum(F.col(mean_col) * F.col(size_col)) / F.sum(size_col) if weight_by_size else F.avg(mean_col)
    return results.groupBy(*by).agg(value.alias("group_mean"))


def macro_mean(rows: DataFrame, category: str, score: str) -> DataFrame:
    """The unweighted mean of the categories' means."""
    return rows.groupBy(category).agg(F.avg(score).alias("m")).agg(F.avg("m").alias("macro_mean"))


def paired_accuracy(rows: DataFrame, category: str, question: str, score: str) -> DataFrame:
    """Per category, over questions with exactly two scores: acc (mean) and acc_plus (both right), in percent, and their sum."""
    pairs = rows.groupBy(category, question).agg(F.count("*").alias("n"), F.avg(score).alias("mean"), F.min(score).alias("least")).where("n = 2")
    out = pairs.groupBy(category).agg((F.avg("mean") * 100).alias("acc"), (F.avg((F.col("least") >= 1).cast("int")) * 100).alias("acc_plus"))
    return out.withColumn("total", F.col("acc") + F.col("acc_plus"))


def binary_metrics(rows: DataFrame, truth: str, prediction: str, by: list[str] | None = None) -> DataFrame:
    """accuracy, precision, recall, f1 and the yes-ratio of the truth; a zero denominator gives 0. One pass of conditional sums."""
    t, p = F.col(truth) == 1, F.col(prediction) == 1
    sums = rows.groupBy(*(by or [])).agg(
        F.sum((t & p).cast("int")).alias("tp"), F.sum((~t & p).cast("int")).alias("fp"),
        F.sum((t & ~p).cast("int")).alias("fn"), F.sum((~t & ~p).cast("int")).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return sums.select(*(by or []), ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), precision.alias("precision"), recall.alias("recall"), ratio(2 * precision * recall, precision + recall).alias("f1"), ratio(tp + fn, tp + fp + fn + tn).alias("yes_ratio"))


def confusion(rows: DataFrame, truth: str, prediction: str) -> DataFrame:
    """Per class: intersection over union, recall, and their macro means by a window over the few classes."""
    cells = rows.groupBy(truth, prediction).agg(F.count("*").alias("n"))
    actual = cells.groupBy(F.col(truth).alias("class")).agg(F.sum("n").alias("actual"))
    said = cells.groupBy(F.col(prediction).alias("class")).agg(F.sum("n").alias("said"))
    right = cells.where(F.col(truth) == F.col(prediction)).select(F.col(truth).alias("class"), F.col("n").alias("right"))
    out = actual.join(said, "class", "full").join(right, "class", "left").fillna(0)
    return out.select("class", ratio(F.col("right"), F.col("actual") + F.col("said") - F.col("right")).alias("iou"), ratio(F.col("right"), F.col("actual")).alias("recall"))


def weighted_known_mean(rows: DataFrame, by: list[str], score: str, weight: str) -> DataFrame:
    """sum(w * s) / sum(w) over scores of 0 or more; -1 where a group has none."""
    known = F.col(score) >= 0
    return rows.groupBy(*by).agg(F.coalesce(F.try_divide(F.sum(F.when(known, F.col(score) * F.col(weight))), F.sum(F.when(known, F.col(weight)))), F.lit(-1.0)).alias("weighted_mean"), F.coalesce(F.min(F.when(known, F.col(score))), F.lit(-1.0)).alias("least"))


def all_right(rows: DataFrame, group: str, right: str) -> DataFrame:
    """Row accuracy, and the share of groups of which every row is right."""
    groups = rows.groupBy(group).agg(F.sum(F.col(right).cast("int")).alias("k"), F.count("*").alias("n"))
    return groups.agg((F.sum("k") / F.sum("n")).alias("row_accuracy"), F.avg((F.col("k") == F.col("n")).cast("int")).alias("group_accuracy"))


def majority(rows: DataFrame, group: str, answer: str, order: str) -> DataFrame:
    """Each group's most frequent answer; of ties, the one seen first."""
    counted = rows.groupBy(group, answer).agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    return counted.groupBy(group).agg(F.max_by(answer, F.struct("n", -F.col("seen"))).alias("majority"))


def coverage_at(rows: DataFrame, group: str, right: str, order: str, sizes: list[int]) -> DataFrame:
    """Share of groups with a right row among their first n, for each n."""
    ranked = rows.withColumn("_i", F.row_number().over(Window.partitionBy(group).orderBy(order)))
    first = ranked.groupBy(group).agg(F.min(F.when(F.col(right), F.col("_i"))).alias("first"))
    return first.agg(*[F.avg(F.coalesce(F.col("first") <= n, F.lit(False)).cast("int")).alias(f"cov_{n}") for n in sizes])


def facets(rows: DataFrame, columns: list[str], right: str) -> DataFrame:
    """Accuracy by each value of each facet column, in one pass."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value"), F.col(right).cast("int").alias("right")) for c in columns])).alias("f")).select("f.*")
    return long.groupBy("facet", "value").agg(F.avg("right").alias("accuracy"), F.count("*").alias("n"))


def bootstrap(rows: DataFrame, score: str, key: str, draws: int = 1000, low: float = 0.025) -> DataFrame:
    """Percentile interval and deviation of the mean, by Poisson resampling: each row counts k times in a draw, k by a hash of (key, draw).

    One pass of partial sums; rows are never gathered. Poisson weights approximate draws with replacement.
    """
    u = F.pmod(F.xxhash64(key, "draw"), F.lit(1_000_000)) / 1_000_000.0
    # The cumulative Poisson(1) distribution.
    k = sum((u >= p).cast("int") for p in (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582))
    drawn = rows.select(score, key, F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).withColumn("k", k)
    means = drawn.groupBy("draw").agg((F.sum(F.col(score) * F.col("k")) / F.sum("k")).alias("m"))
    return means.agg(F.percentile("m", F.lit(low)).alias("low"), F.percentile("m", F.lit(1 - low)).alias("high"), F.stddev_pop("m").alias("deviation"))


def word_error_rate(pairs: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """100 * edits / reference words over the corpus. Rows where either text is null count for nothing."""
    words = pairs.select(F.split(reference, " ").alias("r"), F.split(hypothesis, " ").alias("h"))
    found = words.select(F.size("r").alias("n"), S.token_edit_distance(F.col("r"), F.col("h")).alias("d")).where("d IS NOT NULL")
    return found.agg((100 * F.sum("d") / F.sum("n")).alias("wer"))


def length_statistics(rows: DataFrame, length: str) -> DataFrame:
    """Statistics of a length histogram as packing reports them: the mean is of distinct lengths over their number and one."""
    return rows.agg((F.sum_distinct(length) / (F.count_distinct(length) + 1)).alias("mean"), F.min(length).alias("least"), F.max(length).alias("most"), F.count("*").alias("n"))
