"""Registries of metrics, aggregations, filters, samplers and tasks; filter pipelines; scored tasks as plans (UDF-01..08, UDF-11, SRC-17, SRC-18, JOIN-06, JOIN-07)."""

from __future__ import annotations

import dataclasses
import importlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import answers as A
from corpusloom.functions import text as T


class Registry:
    """Names and what they stand for; a name is given once."""

    def __init__(self, kind: str):
        self.kind, self.known = kind, {}

    def add(self, *names: str) -> Callable:
        def keep(thing):
            for name in names:
                if name in self.known:
                    raise ValueError(f"{self.kind} {name} is registered already")
                self.known[name] = thing
            return thing

        return keep

    def get(self, name: str | Callable) -> Callable:
        """What a name stands for; a function stands for itself, and `module:function` for that function of the module."""
        if callable(name):
            return name
        if name in self.known:
            return self.known[name]
        if ":" in name:
            module, _, function = name.partition(":")
            return getattr(importlib.import_module(module), function)
        raise KeyError(f"no {self.kind} {name}; there are: {', '.join(sorted(self.known))}")


METRICS, AGGREGATIONS, FILTERS, SAMPLERS, TASKS, GROUPS, MODELS = (Registry(k) for k in ("metric", "aggregation", "filter", "sampler", "task", "group", "model"))
HIGHER_IS_BETTER: dict[str, bool] = {}
METRIC_AGGREGATION: dict[str, str] = {}
#: The metrics of a task that names none, by what its model gives.
DEFAULT_METRICS = {"loglikelihood": ["perplexity", "acc"], "multiple_choice": ["acc", "acc_norm"], "generate_until": ["exact_match"], "generate_until_multi_round": ["exact_match"]}


def register_metric(name: str, higher_is_better: bool = True, aggregation: str = "mean") -> Callable:
    """A metric is a function (prediction, target) of Columns to a Column."""

    def keep(f):
        METRICS.add(name)(f)
        HIGHER_IS_BETTER[name], METRIC_AGGREGATION[name] = higher_is_better, aggregation
        return f

    return keep


# -- metrics and aggregations ------------------------------------------------------------------


@register_metric("exact_match")
def exact_match(prediction: Column, target: Column) -> Column:
    return (prediction == target).cast("double")


@register_metric("acc")
def accuracy(prediction: Column, target: Column) -> Column:
    return (F.lower(F.trim(prediction)) == F.lower(F.trim(target))).cast("double")


@register_metric("acc_norm")
def normalised_accuracy(prediction: Column, target: Column) -> Column:
    return (T.squad_normal(prediction) == T.squad_normal(target)).cast("double")


@register_metric("perplexity", higher_is_better=False, aggregation="perplexity")
def loss(prediction: Column, target: Column) -> Column:
    return prediction.try_cast("double")


AGGREGATIONS.add("mean")(lambda score: F.avg(score))
AGGREGATIONS.add("sum")(lambda score: F.sum(score))
AGGREGATIONS.add("median")(lambda score: F.percentile(score, F.lit(0.5)))
AGGREGATIONS.add("perplexity")(lambda score: F.exp(F.least(F.lit(20.0), F.avg(score))))
AGGREGATIONS.add("bypass")(lambda score: F.count(score).cast("double"))


# -- filters -----------------------------------------------------------------------------------
# A filter is made of its arguments and then maps (responses, row) to responses, row giving columns by name.

FILTERS.add("none")(lambda: lambda r, row: r)
FILTERS.add("take_first")(lambda: lambda r, row: F.array(T.take_first(r)))
FILTERS.add("take_first_k")(lambda k: lambda r, row: A.take_first_k(r, k))
FILTERS.add("majority_vote")(lambda: lambda r, row: A.majority_vote(r))
FILTERS.add("lowercase")(lambda: lambda r, row: A.lower_all(r))
FILTERS.add("uppercase")(lambda: lambda r, row: A.upper_all(r))
FILTERS.add("remove_whitespace")(lambda: lambda r, row: A.strip_leading_space(r))
FILTERS.add("map")(lambda mapping_dict, default_value=None: lambda r, row: A.map_all(r, mapping_dict, default_value))
FILTERS.add("regex")(lambda regex_pattern=r"#### (\-?[0-9\.\,]+)", group_select=0, fallback="[invalid]": lambda r, row: A.regex_groups(r, regex_pattern, group_select, fallback))
FILTERS.add("multi_choice_regex")(lambda choices="choices", **options: lambda r, row: A.multi_choice(r, row[choices], **options))
FILTERS.add("simple_multi_choice_regex")(lambda question="question": lambda r, row: F.array(A.simple_choice(r, row[question])))


class _Row:
    """Columns by name, for filters that read the document."""

    def __getitem__(self, name: str) -> Column:
        return F.col(name)


def apply_filters(rows: DataFrame, name: str, steps: list[tuple[str, dict]], responses: str = "resps", filtered: str = "filtered_resps") -> DataFrame:
    """Puts what an ordered pipeline of filters makes of the responses under its name into the map `filtered`.

    steps holds (filter, arguments). A pipeline of another name that ran before is kept. It is one expression: no join by position.
    """
    out = F.col(responses)
    for step, arguments in steps:
        out = FILTERS.get(step)(**arguments)(out, _Row())
    own = F.create_map(F.lit(name), out)
    if filtered in rows.columns:
        own = F.map_concat(F.map_filter(filtered, lambda k, v: k != name), own)
    return rows.withColumn(filtered, own)


# -- tasks -------------------------------------------------------------------------------------


@dataclasses.dataclass(frozen=True)
class TaskSpec:
    """A task: a table and its split, how a document becomes a question, a target and predictions, and what is measured.

    doc_to_text and doc_to_target are SQL expressions or functions of no argument that give a Column; filters are
    pipelines by name; metrics name a metric, a `module:function` or a function, each with an optional aggregation.
    """

    name: str
    table: str
    id_col: str
    doc_to_text: str | Callable[[], Column]
    doc_to_target: str | Callable[[], Column]
    split: str | None = None
    output_type: str = "generate_until"
    filters: tuple[tuple[str, tuple[tuple[str, dict], ...]], ...] = ()
    metrics: tuple[tuple[str | Callable, str | None], ...] = ()
    group_by: tuple[str, ...] = ()


def register_task(spec: TaskSpec, *groups: str) -> TaskSpec:
    TASKS.add(spec.name)(spec)
    for g in groups:
        GROUPS.known.setdefault(g, []).append(spec.name)
    return spec


def task_docs(spark: SparkSession, spec: TaskSpec, tables: dict[str, DataFrame] | str) -> DataFrame:
    """The task's documents with `question` and `target`, from a table by name or a folder of Parquet tables; its split is a condition."""
    docs = tables[spec.table] if isinstance(tables, dict) else spark.read.parquet(f"{tables}/{spec.table}.parquet")
    if spec.split:
        docs = docs.where(spec.split)

    def column(x: str | Callable[[], Column]) -> Column:
        return F.expr(x) if isinstance(x, str) else x()

    return docs.select("*", column(spec.doc_to_text).cast("string").alias("question"), column(spec.doc_to_target).cast("string").alias("target"))


def with_responses(docs: DataFrame, logged: DataFrame, id_col: str) -> DataFrame:
    """SRC-18, JOIN-06: logged responses (id, resps array<string>) by id, never by place; documents without any get an empty array."""
    return docs.join(logged.select(id_col, "resps"), id_col, "left").withColumn("resps", F.coalesce("resps", F.array().cast("array<string>")))


def scored(docs: DataFrame, spec: TaskSpec) -> DataFrame:
    """(id, group columns, filter, metric, score): every document, filter pipeline and metric as a row of its own."""
    pipelines = spec.filters or (("none", (("take_first", {}),)),)
    for name, steps in pipelines:
        docs = apply_filters(docs, name, list(steps))
    metrics = spec.metrics or tuple((m, None) for m in DEFAULT_METRICS[spec.output_type])
    prediction = F.coalesce(F.try_element_at(F.col("_f")["value"], F.lit(1)), F.lit(""))
    keep = [spec.id_col, *spec.group_by]
    long = docs.select(*keep, "target", F.explode(F.map_entries("filtered_resps")).alias("_f"))
    scores = [F.struct(F.lit(m if isinstance(m, str) else m.__name__).alias("metric"), METRICS.get(m)(prediction, F.col("target")).cast("double").alias("score")) for m, _ in metrics]
    out = long.select(*keep, F.col("_f.key").alias("filter"), F.explode(F.array(*scores)).alias("m"))
    return out.select(*keep, "filter", "m.metric", "m.score")


def aggregated(scores: DataFrame, spec: TaskSpec) -> DataFrame:
    """(task, group columns, filter, metric, value, n) by each metric's aggregation, in one pass."""
    metrics = spec.metrics or tuple((m, None) for m in DEFAULT_METRICS[spec.output_type])
    value = F.lit(None).cast("double")
    for m, how in metrics:
        name = m if isinstance(m, str) else m.__name__
        f = AGGREGATIONS.get(how or METRIC_AGGREGATION.get(name, "mean"))
        value = F.when(F.col("metric") == name, f(F.when(F.col("metric") == name, F.col("score")))).otherwise(value)
    return scores.groupBy(*spec.group_by, "filter", "metric").agg(value.alias("value"), F.count("*").alias("n")).withColumn("task", F.lit(spec.name))


def evaluate(spark: SparkSession, name: str, tables: dict[str, DataFrame] | str, logged: DataFrame) -> DataFrame:
    """A registered task's results from logged responses."""
    spec = TASKS.get(name)
    return aggregated(scored(with_responses(task_docs(spark, spec, tables), logged, spec.id_col), spec), spec)


def evaluate_group(spark: SparkSession, group: str, tables: dict[str, DataFrame] | str, logged: dict[str, DataFrame], weight_by_size: bool = True) -> DataFrame:
    """(group, filter, metric, value, n): the tasks' means, weighted by their sizes or not."""
    parts = [evaluate(spark, t, tables, logged[t]) for t in GROUPS.known[group]]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p, allowMissingColumns=True)
    value = F.sum(F.col("value") * F.col("n")) / F.sum("n") if weight_by_size else F.avg("value")
    return every.groupBy("filter", "metric").agg(value.alias("value"), F.sum("n").alias("n")).withColumn("group", F.lit(group))


def prediction_truth(predictions: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """JOIN-07: predictions with their truth by key; predictions without one are left out."""
    return predictions.join(truth, key)


def matches_logged(results: DataFrame, logged: DataFrame, keys: list[str], value: str, eps: float = 1e-6) -> DataFrame:
    """EXT-14: rows of results that a log contradicts or lacks; an empty result means that all agree."""
    both = results.select(*keys, F.col(value).alias("_now")).join(logged.select(*keys, F.col(value).alias("_logged")), keys, "full")
    return both.where(F.col("_now").isNull() | F.col("_logged").isNull() | (F.abs(F.col("_now") - F.col("_logged")) > eps)).select(*keys, F.col("_now").alias("recomputed"), F.col("_logged").alias("logged"))


# -- samplers ----------------------------------------------------------------------------------


@SAMPLERS.add("default")
def random_shots(docs: DataFrame, pool: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """(key, shot, shot_id): n examples a document, never itself, drawn by a hash of (seed, document).

    The pool is ranked once in hash order; a document takes the ranks that follow a hashed start, cyclically, so no
    pair of document and pool row is made beyond those that are taken.
    """
    from corpusloom.operators.storage import ranked

    shuffled = pool.select(F.col(key).alias("shot_id"), F.xxhash64(F.lit(seed), key).alias("_h"))
    deck = ranked(shuffled, "_h", name="_rank").select("shot_id", "_rank")
    size = deck.agg(F.count("*").alias("_size"))
    asks = docs.select(key).join(F.broadcast(size)).where("_size > 0").withColumn("_start", F.pmod(F.xxhash64(F.lit(seed + 1), key), F.col("_size")))
    asks = asks.withColumn("_k", F.explode(F.sequence(F.lit(0), F.least(F.lit(n), F.col("_size").cast("int") - 1))))
    got = asks.withColumn("_rank", F.pmod(F.col("_start") + F.col("_k"), F.col("_size"))).join(deck, "_rank").where(F.col(key) != F.col("shot_id"))
    from pyspark.sql import Window

    return got.withColumn("shot", F.row_number().over(Window.partitionBy(key).orderBy("_k"))).where(F.col("shot") <= n).select(key, "shot", "shot_id")


@SAMPLERS.add("first_n")
def first_shots(docs: DataFrame, pool: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """(key, shot, shot_id): the first n of the pool but for the document itself, in its order. n + 1 rows go to every task."""
    from pyspark.sql import Window

    head = pool.select(F.col(key).alias("shot_id")).orderBy("shot_id").limit(n + 1).agg(F.array_sort(F.collect_list("shot_id")).alias("_head"))
    both = docs.select(key).join(F.broadcast(head)).select(key, F.slice(F.filter("_head", lambda s: s != F.col(key)), 1, n).alias("_s"))
    return both.select(key, F.posexplode("_s").alias("shot", "shot_id")).withColumn("shot", F.col("shot") + 1)


def few_shot_prompt(shots: DataFrame, texts: DataFrame, key: str, text: str, target: str, between: str = "\n\n", delimiter: str = " ") -> DataFrame:
    """(key, context): a document's examples, each text and target, in order."""
    said = texts.select(F.col(key).alias("shot_id"), F.concat(F.col(text), F.lit(delimiter), F.col(target).cast("string")).alias("_t"))
    own = shots.join(said, "shot_id").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("shot", "_t"))).alias("_e"))
    return own.select(key, F.concat(F.array_join(F.transform("_e", lambda e: e["_t"]), between), F.lit(between)).alias("context"))


#: Kept for callers that build rewards by answer type.
def reward_of(answer_type: Column, response: Column, answers: Column, **options) -> Column:
    from corpusloom.functions.similarity import typed_reward

    return typed_reward(answer_type, response, answers, **options)
