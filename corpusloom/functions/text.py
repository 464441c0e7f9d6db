"""Text functions as Column expressions (STR-*)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ARTICLES = r"\b(?:a|an|the)\b"
PUNCTUATION = r"[!-/:-@\[-`{-~]"


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def squad_normal(text: Column) -> Column:
    """Lower case, no punctuation, no articles, single spaces."""
    return squeeze(F.regexp_replace(F.regexp_replace(F.lower(text), PUNCTUATION, ""), ARTICLES, " "))


def tagged_answer(text: Column) -> Column:
    """What the last <answer> tag holds; null if there is none."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(r"(?s)<answer>(.*?)</answer>"), F.lit(1)), F.lit(-1))


def boxed(text: Column) -> Column:
    """The first brace-free \\boxed{...}; null if there is none."""
    return F.nullif(F.regexp_extract(text, r"\\boxed\{([^{}]*)\}", 1), F.lit(""))


def answer_or_text(text: Column) -> Column:
    return F.coalesce(F.nullif(tagged_answer(text), F.lit("")), boxed(text), text)


def yes_no(text: Column) -> Column:
    """yes, no or other: the whole answer, a single letter, or within its first four characters."""
    t = F.lower(F.trim(F.regexp_replace(text, r"\.", "")))
    head = F.substring(t, 1, 4)
    return F.when(t.isin("yes", "y") | head.contains("yes"), "yes").when(t.isin("no", "n") | head.contains("no"), "no").otherwise("other")


def first_number(text: Column) -> Column:
    """The first number; 0 where there is none."""
    return F.coalesce(F.regexp_extract(text, r"-?[0-9]+(?:\.[0-9]+)?", 0).try_cast("double"), F.lit(0.0))


def option_letter(text: Column) -> Column:
    """The option that an answer's beginning names: `b`, `(b`, `option b`, `the answer is b`; null if none."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(text)), r"^(?:the answer is |option |\()?\s*\(?([a-z])(?:[).:,\s]|$)", 1), F.lit(""))


def regex_filter(responses: Column, pattern: str, select: int = 0, fallback: str = "[invalid]") -> Column:
    """Of each response, the chosen match of the pattern's first group."""
    at = F.lit(select + 1 if select >= 0 else select)
    return F.transform(responses, lambda r: F.coalesce(F.nullif(F.trim(F.try_element_at(F.regexp_extract_all(r, F.lit(pattern), F.lit(1)), at)), F.lit("")), F.lit(fallback)))


def take_first(responses: Column) -> Column:
    return F.coalesce(F.try_element_at(responses, F.lit(1)), F.lit(""))


def media_tokens(text: Column, tag: str, tokens: str) -> Column:
    """A placeholder and the newlines beside it become the model's tokens."""
    return F.regexp_replace(text, rf"\n?{tag}\n?", tokens)


def chat_prompt(system: Column, turns: Column) -> Column:
    """The rendered conversation (array of (role, content)) with the marker that asks for an answer."""
    said = F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|im_start|>"), t["role"], F.lit("\n"), t["content"], F.lit("<|im_end|>\n"))), "")
    head = F.when(system.isNotNull(), F.concat(F.lit("<|im_start|>system\n"), system, F.lit("<|im_end|>\n"))).otherwise("")
    return F.concat(head, said, F.lit("<|im_start|>assistant\n"))


def undo_ptb(text: Column) -> Column:
    """Undoes Penn-Treebank spacing."""
    # What is replaced, in this order.
    for a, b in ((" '", "'"), (" \n", "\n"), ("\n ", "\n"), (" n't", "n't"), (" N ", "1 "), ("$ 1", "$1"), ("# 1", "#1")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def contains_words(text: Column, answer: Column) -> Column:
    """Whether the answer's words stand in the text, as words, one after the other."""
    def words(c: Column) -> Column:
        return F.concat(F.lit(" "), squeeze(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    return F.contains(words(text), words(answer))


def judge_score(text: Column, low: float, high: float) -> Column:
    """The first number of a judge's answer within [low, high]; null without one."""
    found = F.regexp_extract(text, r"-?[0-9]+(?:\.[0-9]+)?", 0).try_cast("double")
    return F.when(found.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), found)))
