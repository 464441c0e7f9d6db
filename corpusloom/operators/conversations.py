"""Instruction-data normalisation and sample checks (ARR-08, PRJ-04, FLT-24 for conversations, STR-06, STR-34, WIN-07)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gather(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """(key, messages): a conversation's turns in order, as (role, content)."""
    grouped = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "role", F.col("text").alias("content")))).alias("t"))
    return grouped.select(key, F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def renamed_roles(messages: Column) -> Column:
    """human and gpt become user and assistant; other roles stay."""
    return F.transform(messages, lambda m: F.struct(F.when(m["role"] == "human", "user").when(m["role"] == "gpt", "assistant").otherwise(m["role"]).alias("role"), m["content"].alias("content")))


def unified(conversations: DataFrame, key: str = "conv_id", messages: str = "messages") -> DataFrame:
    """(key, system, prompt, response, valid): the turns before the last one, and that one.

    A leading system message is taken out. The rest must alternate user and assistant and end with assistant; else prompt and response are empty.
    """
    first = F.try_element_at(F.col(messages), F.lit(1))
    has = F.coalesce(first["role"] == "system", F.lit(False))
    rest = F.when(has, F.slice(F.col(messages), F.lit(2), F.greatest(F.size(messages) - 1, F.lit(0)))).otherwise(F.col(messages))
    out = conversations.select(key, F.when(has, first["content"]).alias("system"), rest.alias("_r"))
    right = F.forall(F.transform("_r", lambda m, i: m["role"] == F.when(i % 2 == 0, "user").otherwise("assistant")), lambda x: x)
    valid = (F.size("_r") > 0) & (F.size("_r") % 2 == 0) & right
    none = F.slice("_r", 1, 0)
    return out.select(key, "system", F.when(valid, F.slice("_r", F.lit(1), F.size("_r") - 1)).otherwise(none).alias("prompt"), F.when(valid, F.slice("_r", -1, 1)).otherwise(none).alias("response"), valid.alias("valid"))


def first_user(messages: Column) -> Column:
    return F.try_element_at(F.filter(messages, lambda m: m["role"] == "user"), F.lit(1))["content"]


def contract_errors(messages: Column) -> Column:
    """Names of the rules that a conversation breaks."""
    return F.array_compact(
        F.array(
            F.when(messages.isNull() | (F.size(messages) == 0), "no messages"),
            F.when(F.exists(messages, lambda m: ~F.coalesce(m["role"].isin("system", "user", "assistant"), F.lit(False))), "unknown role"),
            F.when(F.exists(messages, lambda m: F.coalesce(F.length(m["content"]), F.lit(0)) == 0), "empty content"),
            F.when(~F.exists(messages, lambda m: m["role"] == "assistant"), "no answer"),
        )
    )


def reconcile_images(problem: Column, images: Column) -> tuple[Column, Column]:
    """As many <image> marks as images: of surplus marks, the problem is cut before the first; surplus images go. A null list is empty."""
    images = F.coalesce(images, F.array().cast("array<string>"))
    parts = F.split(F.coalesce(problem, F.lit("")), "<image>", -1)
    marks, n = F.size(parts) - 1, F.size(images)
    return F.when(marks > n, F.array_join(F.slice(parts, F.lit(1), n + 1), "<image>")).otherwise(F.coalesce(problem, F.lit(""))), F.slice(images, F.lit(1), marks)


def prepend_marks(problem: Column, images: Column) -> Column:
    """The problem with the <image> marks that it lacks put in front."""
    missing = F.size(F.coalesce(images, F.array().cast("array<string>"))) - (F.size(F.split(problem, "<image>", -1)) - 1)
    return F.concat(F.repeat(F.lit("<image>"), F.greatest(missing, F.lit(0))), problem)
