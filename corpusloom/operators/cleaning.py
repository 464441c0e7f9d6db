"""Corpus cleaning: URL classification, length and quality filters, text repair (FLT-01..14, STR-01, EXT-09, PRJ-06)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.storage import ranked

#: Suffixes that a crawl skips, in the order of the published list, whose missing comma fuses two of them into '.7z.ai'.
SKIPPED_SUFFIXES = (
    ".3gp", ".7z.ai", ".aif", ".apk", ".app", ".avi", ".bin", ".bmp", ".bz2", ".css", ".csv", ".dat", ".deb", ".dmg", ".doc", ".docx", ".exe", ".gif", ".gifv", ".gz", ".iso", ".jar",
    ".jpeg", ".jpg", ".js", ".log", ".mid", ".midi", ".mkv", ".mov", ".mp3", ".mp4", ".mpeg", ".mpg", ".ogg", ".ogv", ".otf", ".pdf", ".pkg", ".png", ".pps", ".ppt", ".pptx", ".psd",
    ".py", ".qt", ".ram", ".rar", ".sql", ".svg", ".swf", ".tar.gz", ".tar", ".tgz", ".tiff", ".ttf", ".txt", ".wav", ".webm", ".wma", ".wmv", ".xls", ".xlsx", ".xml", ".xz", ".zip",
)
#: How a refusal to caption begins.
REFUSALS = ("i'm sorry", "i am sorry", "i cannot", "i can't")
#: Fixed value: the widely published pattern of a well-formed http or https URL.
WELL_FORMED = (
    r"(?i)^(?:http)s?://"
    r"(?:(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+(?:[A-Z]{2,6}\.?|[A-Z0-9-]{2,}\.?)|"
    r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})"
    r"(?::\d+)?"
    r"(?:/?|[/?]\S+)$"
)
#: Second labels that, before a two-letter country, belong to the public suffix (co.uk, com.au, ac.jp).
SECOND_LABELS = ("ac", "co", "com", "edu", "gob", "gov", "ltd", "ne", "net", "nom", "or", "org", "plc", "sch")
TASKS = ("remove_512", "remove_256_javascript", "remove_512_non_english", "ftfy_fix_text", "general_cleaning")
"""Cleaning tasks in the order in which the first enabled one that applies decides; the last two keep the row."""


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def registered_label(url: Column) -> Column:
    """The label before the public suffix, which is the last label, or the last two as in co.uk."""

    def label(parts: Column) -> Column:
        two = (F.size(parts) > 2) & (F.length(parts[0]) == 2) & parts[1].isin(*SECOND_LABELS)
        return F.coalesce(F.try_element_at(parts, F.when(two, F.lit(3)).otherwise(2)), F.lit(""))

    return F.transform(F.array(F.reverse(F.split(host(url), r"\."))), label)[0]


#: Rules in the form of the public suffix list, as an example; the whole list is a file that suffix_rules() reads.
SOME_RULES = ("com", "org", "net", "io", "de", "fr", "uk", "co.uk", "ac.uk", "jp", "co.jp", "*.kawasaki.jp", "!city.kawasaki.jp", "ck", "*.ck", "!www.ck", "au", "com.au")


def suffix_rules(spark, path: str) -> list[str]:
    """The rules of a file in the form of the public suffix list, up to its private part; comments and empty lines are left out. Such a list has some ten thousand rules."""
    lines = [r["value"].strip() for r in spark.read.option("wholetext", True).text(path).select(F.explode(F.split("value", "\n")).alias("value")).collect()]
    icann = lines[: next((i for i, x in enumerate(lines) if "BEGIN PRIVATE" in x), len(lines))]
    return [x.split()[0] for x in icann if x and not x.startswith("//")]


def _rule_tree(rules) -> dict:
    tree: dict = {}
    for rule in rules:
        node, exception = tree, rule.startswith("!")
        labels = rule.lower().removeprefix("!").split(".")
        for label in reversed(labels):
            node = node.setdefault(label, {})
        node["" if not exception else "!"] = {}
    return tree


def split_host(name: str, tree: dict) -> tuple[str, str]:
    """(registered label, public suffix) of a host: the longest rule that fits, a `*` standing for one label and an exception for one label less. No rule: the last label and no suffix; an address is its own label."""
    labels = name.strip(".").split(".")
    if len(labels) == 4 and all(x.isdigit() for x in labels):
        return name, ""
    node, suffix = tree, 0
    for n, label in enumerate(reversed(labels), 1):
        own = node.get(label)
        if own is not None and "!" in own:
            suffix = n - 1
            break
        node = own if own is not None else node.get("*")
        if node is None:
            break
        if "" in node:
            suffix = n
    cut = len(labels) - suffix
    return (labels[cut - 1] if cut else ""), ".".join(labels[cut:])


def registered_domain(url: Column, rules=SOME_RULES) -> Column:
    """FLT-01: (label, suffix) of a URL's host by rules of the public suffix list, which go to the tasks as a tree; null for null."""
    tree = _rule_tree(rules)

    def run(hosts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if x is None else split_host(x, tree) for x in hosts], columns=["label", "suffix"])

    return F.pandas_udf(run, "label string, suffix string")(host(url))


def bad_suffix(url: Column) -> Column:
    path = F.lower(F.split(url, r"\?")[0])
    return F.exists(F.array(*map(F.lit, SKIPPED_SUFFIXES)), lambda s: path.endswith(s))


def classify_urls(urls: DataFrame, blocked_labels: list[str], url_col: str = "url", order_col: str = "page_id", rules=None) -> DataFrame:
    """With rules of the public suffix list the label is found by them. Adds `reason`: the first of domain, extension, short, malformed and duplicate that holds, else keep. Null URLs are malformed.

    A URL is a duplicate if a row of lesser order has it and was not set aside for another reason.
    """
    url = F.coalesce(F.col(url_col), F.lit(""))
    first = (
        F.when((registered_label(url) if rules is None else registered_domain(url, rules)["label"]).isin(blocked_labels), "domain")
        .when(bad_suffix(url), "extension")
        .when(F.length(url) <= 8, "short")
        .when(~url.rlike(WELL_FORMED), "malformed")
    )
    marked = urls.withColumn("_first", first)
    least = marked.where("_first IS NULL").groupBy(url_col).agg(F.min(order_col).alias("_least"))
    return marked.join(least, url_col, "left").withColumn("reason", F.coalesce("_first", F.when(F.col(order_col) > F.col("_least"), "duplicate"), F.lit("keep"))).drop("_first", "_least")


def too_short(text: Column) -> Column:
    """Under 8 * 128 characters and under 128 words."""
    return (F.length(text) < 1024) & (F.size(F.split(F.trim(text), r"\s+")) < 128)


def general_cleaning(text: Column) -> Column:
    """Runs of spaces, and line breaks right after a word character, become one space."""
    return F.regexp_replace(text, r"  +|(?<=[\p{L}\p{N}_])\n+ |(?<=[\p{L}\p{N}_])\n+", " ")


def clean_text(text: Column) -> Column:
    """Newlines to spaces, spaces squeezed, then ' . ' to '. ' three times."""
    out = F.regexp_replace(F.regexp_replace(text, r"\n", " "), r" +", " ")
    for _ in range(3):
        out = F.replace(out, F.lit(" . "), F.lit(". "))
    return out


def removal_task(text: Column, lang: Column, tasks: tuple[str, ...] = TASKS) -> Column:
    """The first enabled task that applies to the text; null if none does. A null text is set aside as `error`."""
    rules = {
        "remove_512": F.length(text) < 512,
        "remove_256_javascript": (F.length(text) < 256) & F.contains(F.lower(text), F.lit("javascript")),
        "remove_512_non_english": (F.length(text) < 512) & ~lang.eqNullSafe(F.lit("en")),
        "ftfy_fix_text": F.lit(True),
        "general_cleaning": F.lit(True),
    }
    out = F.when(text.isNull(), "error")
    for name in TASKS:
        if name in tasks:
            out = out.when(rules[name], name)
    return out


def cleaned(rows: DataFrame, text: str, lang: str, tasks: tuple[str, ...] = TASKS) -> DataFrame:
    """Adds task, to_filter and the text as the task leaves it: fixed, cleaned, or as it was."""
    from corpusloom.functions.text import fix_mojibake

    task = removal_task(F.col(text), F.col(lang), tasks)
    out = rows.withColumn("task", task).withColumn("to_filter", F.coalesce(F.col("task").startswith("remove") | (F.col("task") == "error"), F.lit(False)))
    fixed = F.when(F.col("task") == "general_cleaning", general_cleaning(F.col(text)))
    if "ftfy_fix_text" in tasks:
        fixed = fixed.when(F.col("task") == "ftfy_fix_text", fix_mojibake(F.col(text)))
    return out.withColumn(text, fixed.otherwise(F.col(text)))


def wrong_language(lang: Column, wanted: str = "en") -> Column:
    """Whether a row is dropped by its language; an unknown one is not the wanted one."""
    return ~lang.eqNullSafe(F.lit(wanted))


def caption_problem(caption: Column) -> Column:
    """refusal, repeat (eight equal words in a row) or length (not 50 to 3500 characters); else null."""
    low = F.lower(F.trim(caption))

    def repeats(words: Column) -> Column:
        """One pass: how often the last word has been repeated, and the longest such run."""
        start = F.struct(F.lit("").alias("w"), F.lit(0).alias("n"), F.lit(0).alias("most"))

        def step(s: Column, w: Column) -> Column:
            n = F.when(s["w"] == w, s["n"] + 1).otherwise(1)
            return F.struct(w.alias("w"), n.alias("n"), F.greatest(s["most"], n).alias("most"))

        return F.aggregate(F.filter(words, lambda w: w != ""), start, step, lambda s: s["most"]) >= 8

    refused = low.startswith(REFUSALS[0])
    for p in REFUSALS[1:]:
        refused = refused | low.startswith(p)
    return F.when(refused, "refusal").when(repeats(F.split(low, r"\s+")), "repeat").when(~F.length(caption).between(50, 3500), "length")


def serial_ids(rows: DataFrame, prefix: str, order_col: str) -> DataFrame:
    """Adds serial_id `prefix-%010d`, gapless from 1 in the given order (ties by a hash of the row)."""
    return ranked(rows, order_col, name="_n").withColumn("serial_id", F.format_string(prefix + "-%010d", F.col("_n") + 1)).drop("_n")
