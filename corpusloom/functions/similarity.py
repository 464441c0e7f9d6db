"""Similarities, geometry and rewards beyond scoring.py (SIM-02, 04, 07..09, 12..17, NUM-04, 05, GEO-02, 05..07, RWD-05, 07..09, DAT-01, ARR-01, JOIN-10)."""

from __future__ import annotations

import ast
import collections
import difflib
import math
import operator
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import answers as A
from corpusloom.functions import scoring as S
from corpusloom.functions import text as T
from corpusloom.functions.symbolic import symbolic_equal


def arrow_pair(f, returns: str = "double"):
    """A function of two values as an Arrow-batched Column function, called once for each different pair of texts of a batch; null if either is."""

    @F.pandas_udf(returns)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        made, out = {}, []
        for x, y in zip(a, b, strict=True):
            if x is None or y is None:
                out.append(None)
            elif type(x) is str and type(y) is str:
                if (x, y) not in made:
                    made[x, y] = f(x, y)
                out.append(made[x, y])
            else:
                out.append(f(x, y))
        return pd.Series(out, dtype=object)

    return run


# -- edits -------------------------------------------------------------------------------------


def mixed_error_rate(a: Column, b: Column, edits: Column | None = None) -> Column:
    """Edits over the longer one's words; 0 where both are empty. edits: their token_edit_distance, where it is there already."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most == 0, 0.0).otherwise((S.token_edit_distance(a, b) if edits is None else edits) / most)


def damerau(a: str, b: str) -> int:
    """Edits with swaps of neighbours, unrestricted: letters between swapped ones may come and go."""
    last: dict[str, int] = {}
    far = len(a) + len(b)
    d = [[far] * (len(b) + 2)] + [[far] + list(range(len(b) + 1))] + [[far, i] + [0] * len(b) for i in range(1, len(a) + 1)]
    for i, x in enumerate(a, 1):
        seen = 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), seen
            if x == y:
                seen = j
            d[i + 1][j + 1] = min(d[i][j] + (x != y), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
        last[x] = i
    return d[-1][-1]


def damerau_similarity(a: Column, b: Column, cut: float = 0.0) -> Column:
    """1 - edits / longer length; below the cut 0; two empty texts are equal."""

    def one(x: str, y: str) -> float:
        most = max(len(x), len(y))
        s = 1.0 if not most else 1 - damerau(x, y) / most
        return s if s >= cut else 0.0

    return arrow_pair(one)(a, b)


def near_match(a: Column, b: Column, cut: float = 0.9) -> Column:
    """Similarity of both without the articles a and the, without accents and case; 0 below the cut."""

    def plain(c: Column) -> Column:
        kept = F.array_join(F.filter(F.split(c, " ", -1), lambda w: ~F.lower(w).isin("the", "a")), " ")
        return F.lower(_unaccented(kept))

    return damerau_similarity(plain(a), plain(b), cut)


def _unaccented(text: Column) -> Column:
    import unicodedata

    return A.arrow_text(lambda x: "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))(text)


def short_or_anls(prediction: Column, answers: Column, case: bool = False, spaces: bool = True, short: int = 5) -> Column:
    """1 if the prediction holds an answer of under `short` words (without spaces: of under four comma parts); for longer ones the best edit similarity of 0.5 or more; else 0."""

    def plain(c: Column) -> Column:
        c = F.replace(F.trim(c if case else F.lower(c)), F.lit("\n"), F.lit(" "))
        return c if spaces else F.replace(c, F.lit(" "), F.lit(""))

    p = plain(prediction)

    def one(answer: Column) -> Column:
        a = plain(answer)
        few = (F.size(F.filter(F.split(a, r"\s+"), lambda w: w != "")) < short) if spaces else (F.size(F.split(a, ",", -1)) < 4)
        s = 1 - F.levenshtein(p, a) / F.greatest(F.length(p), F.length(a), F.lit(1))
        return F.when(few, F.contains(p, a).cast("double")).otherwise(F.when(s >= 0.5, s).otherwise(0.0))

    return F.coalesce(F.array_max(F.transform(answers, one)), F.lit(0.0))


# -- sets and maps -----------------------------------------------------------------------------


def jaccard_plain(a: Column, b: Column) -> Column:
    """Of sets of texts without case."""
    return S.jaccard(F.transform(a, F.lower), F.transform(b, F.lower))


def tuple_jaccard(a: Column, b: Column) -> Column:
    """Of sets of arrays of texts, each without case, white space, hyphens, underscores and full stops."""

    def plain(x: Column) -> Column:
        return F.transform(x, lambda t: F.array_join(F.transform(t, lambda w: F.regexp_replace(F.lower(w), r"[ \-\n\t_.]", "")), "\u0001"))

    return S.jaccard(plain(a), plain(b))


def same_set(a: Column, b: Column, kind: str = "exact") -> Column:
    """Whether two sets are equal. exact, nocase: of arrays; lines, commas: of texts that are split, without case."""

    def parts(c: Column) -> Column:
        if kind == "lines":
            c = F.split(F.replace(c, F.lit("\\n"), F.lit("\n")), "\n", -1)
        elif kind == "commas":
            bare = F.regexp_replace(F.trim(c), r"^[\[({](.*)[\])}]$", "$1")
            c = F.transform(F.split(bare, ",", -1), lambda x: F.trim(x))
        return c if kind == "exact" else F.transform(c, F.lower)

    return F.array_sort(F.array_distinct(parts(a))) == F.array_sort(F.array_distinct(parts(b)))


def map_equal(a: Column, b: Column) -> Column:
    """Equal keys with equal values, in any order."""
    def entries(m: Column) -> Column:
        return F.array_sort(F.map_entries(m))
    return entries(a) == entries(b)


def map_precision(predicted: Column, truth: Column) -> Column:
    """Share of the predicted keys whose value the truth has; 0 for an empty prediction."""
    right = F.size(F.filter(F.map_keys(predicted), lambda k: F.coalesce(F.try_element_at(truth, k) == F.try_element_at(predicted, k), F.lit(False))))
    return F.when(F.size(predicted) == 0, 0.0).otherwise(right / F.size(predicted))


def map_jaccard(a: Column, b: Column) -> Column:
    """Of maps to sets: the mean over all keys of the sets' Jaccard index, a missing key being an empty set."""
    keys = F.array_union(F.map_keys(a), F.map_keys(b))
    empty = F.array().cast("array<string>")
    total = F.aggregate(keys, F.lit(0.0), lambda s, k: s + S.jaccard(F.coalesce(F.try_element_at(a, k), empty), F.coalesce(F.try_element_at(b, k), empty)).cast("double"))
    return total / F.size(keys)


# -- n-grams -----------------------------------------------------------------------------------


def ngrams(words: Column, n: int) -> Column:
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))


def _counted(words: list, n: int) -> collections.Counter:
    return collections.Counter(zip(*(words[i:] for i in range(n)), strict=False))


def clipped_matches(a, b, n: int) -> int:
    """N-grams of a that b has too, each as often as in the one that has it less often."""
    return (_counted(list(a), n) & _counted(list(b), n)).total()


def ngram_f1(prediction: Column, truth: Column, n: int = 1) -> Column:
    """Multiset F1 of the n-grams of normalised words; 0 without a common one. N-grams are counted, so the work grows with the texts."""

    def words(c: Column) -> Column:
        return F.filter(F.split(T.squad_normal(c), " "), lambda w: w != "")

    def score(a, b) -> float:
        common, total = clipped_matches(a, b, n), max(len(a) - n + 1, 0) + max(len(b) - n + 1, 0)
        return 2.0 * common / total if common else 0.0

    return arrow_pair(score)(words(prediction), words(truth))


def best_ngram(result: str, wanted: str, joint: str = " ") -> dict:
    """The n-gram of the result that is most like the wanted text, n being its words, and how well it agrees; words are runs of letters and digits or single marks."""
    words, target = re.findall(r"\w+|[^\w\s]", result), re.findall(r"\w+|[^\w\s]", wanted)
    n, goal = len(target), set(target)
    best, gram = 0.0, ()
    for g in dict.fromkeys(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if n else ():
        if goal.isdisjoint(g):
            continue
        s = difflib.SequenceMatcher(None, joint.join(g), wanted).ratio()
        if s > best:
            best, gram = s, g
    right = len(goal & set(gram))
    p, r = (right / len(set(gram)), right / len(goal)) if gram else (0.0, 0.0)
    return {"similarity": best, "found": joint.join(gram), "precision": p, "recall": r, "f1": 2 * p * r / (p + r) if p + r else 0.0, "jaccard": right / len(goal | set(gram)) if gram else 0.0, "exact": list(gram) == target and n > 0}


def masked_text_scores(result: Column, wanted: Column) -> Column:
    @F.pandas_udf("similarity double, found string, precision double, recall double, f1 double, jaccard double, exact boolean")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([best_ngram(x or "", y or "") for x, y in zip(a, b, strict=True)], columns=["similarity", "found", "precision", "recall", "f1", "jaccard", "exact"])

    return run(result, wanted)


def bleu(rows, prediction: str, reference: str, n: int = 4):
    """(bleu): corpus BLEU of one reference a row, over words between spaces: clipped n-gram precisions, geometric mean, brevity penalty.

    All counts are sums over rows, combined before the shuffle. 0 where an order has no match.
    """
    words = [F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "") for c in (prediction, reference)]
    base = rows.select(words[0].alias("p"), words[1].alias("r"))

    @F.pandas_udf("array<int>")
    def clipped(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else [clipped_matches(x, y, k) for k in range(1, n + 1)] for x, y in zip(a, b, strict=True)])

    base = base.withColumn("_m", clipped("p", "r"))
    sums = base.agg(*[F.sum(F.col("_m")[k - 1]).alias(f"m{k}") for k in range(1, n + 1)], *[F.sum(F.greatest(F.size("p") - (k - 1), F.lit(0))).alias(f"t{k}") for k in range(1, n + 1)], F.sum(F.size("p")).alias("c"), F.sum(F.size("r")).alias("l"))
    mean = sum(F.log(F.col(f"m{k}") / F.col(f"t{k}")) for k in range(1, n + 1)) / n
    none = F.lit(False)
    for k in range(1, n + 1):
        none = none | (F.coalesce(F.col(f"m{k}"), F.lit(0)) == 0)
    brevity = F.when(F.col("c") >= F.col("l"), 1.0).otherwise(F.exp(1 - F.col("l") / F.col("c")))
    return sums.select(F.when(none, 0.0).otherwise(brevity * F.exp(mean)).alias("bleu"))


def rouge_l(prediction: Column, reference: Column) -> Column:
    """F1 of the longest common subsequence of the lower-cased words."""

    def one(a: str, b: str) -> float:
        x, y = a.lower().split(), b.lower().split()
        if not x or not y:
            return 0.0
        places: dict[str, int] = collections.defaultdict(int)
        for i, w in enumerate(y):
            places[w] |= 1 << i
        row = 0
        for w in x:  # bit-parallel: a set bit is a step of the longest common subsequence
            both = row | places[w]
            row = both & ~(both - ((row << 1) | 1))
        common = row.bit_count()
        return 2.0 * common / (len(x) + len(y))

    return arrow_pair(one)(prediction, reference)


# -- code --------------------------------------------------------------------------------------


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(group)))


def _overlap(a: Column, b: Column) -> Column:
    """Jaccard index; 0 where the reference has nothing."""
    return F.when(F.size(b) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def reward_html(response: Column, answer: Column) -> Column:
    """1 for equal normalised code, else 0.6 of the tokens' and 0.4 of the tags' Jaccard index."""
    code, truth = A.html_code(response), F.trim(answer)
    tokens, tags = r'[\p{L}\p{N}_]+|[<>=/"]', r"<(/?[\p{L}\p{N}_]+)"
    partial = 0.6 * _overlap(_found(code, tokens), _found(truth, tokens)) + 0.4 * _overlap(_found(code, tags, 1), _found(truth, tags, 1))
    return F.when(A.html_normal(code) == A.html_normal(truth), 1.0).otherwise(partial)


def reward_svg(response: Column, answer: Column, image: Column | None = None) -> Column:
    """1 for equal normalised code, else half of the images' similarity (a column; 0 without one) and a quarter each of the tokens' and elements' Jaccard index; 0 without an <svg."""
    code = F.coalesce(T.tagged_answer(response), F.nullif(F.regexp_extract(response, r"(?si)(<svg.*?</svg>)", 1), F.lit("")), response)
    truth = F.trim(answer)
    tokens, tags = r'[\p{L}\p{N}_]+|[<>=/"]|#[0-9a-fA-F]+', r"<([a-zA-Z]+)[^>]*>"
    partial = 0.5 * (image if image is not None else F.lit(0.0)) + 0.25 * (_overlap(_found(code, tokens), _found(truth, tokens)) + _overlap(_found(code, tags, 1), _found(truth, tags, 1)))
    return F.when(~F.contains(F.lower(code), F.lit("<svg")), 0.0).when(A.html_normal(code) == A.html_normal(truth), 1.0).otherwise(partial)


# -- numbers -----------------------------------------------------------------------------------


def mean_square(a: Column, b: Column) -> Column:
    """Of two arrays of numbers; null for unequal lengths."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x.cast("double"))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), total / F.size(a))


def root_score(a: Column, b: Column, worst: float = 0.1) -> Column:
    """1 - root mean square / worst, between 0 and 1; 0 where it can't be computed."""
    return F.coalesce(1 - F.least(F.sqrt(mean_square(a, b)), F.lit(worst)) / worst, F.lit(0.0))


_OPERATIONS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Pow: operator.pow, ast.USub: operator.neg, ast.UAdd: operator.pos}


def evaluated(text: str) -> float | list[float] | None:
    """The value of an arithmetic expression of numbers (or of a list of them); nothing else is ever evaluated. Powers beyond 64 are refused instead of timed out."""

    def value(node):
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
            return node.value
        if isinstance(node, ast.UnaryOp) and type(node.op) in _OPERATIONS:
            return _OPERATIONS[type(node.op)](value(node.operand))
        if isinstance(node, ast.BinOp) and type(node.op) in _OPERATIONS:
            left, right = value(node.left), value(node.right)
            if isinstance(node.op, ast.Pow) and (abs(right) > 64 or abs(left) > 1e6):
                raise ValueError("too great a power")
            return _OPERATIONS[type(node.op)](left, right)
        if isinstance(node, (ast.List, ast.Tuple)):
            return [value(x) for x in node.elts]
        raise ValueError("not arithmetic")

    x = re.search(r"(?:=|≈|\\approx)\s*(.+)", text)
    x = x[1] if x else text
    x = re.sub(r"\\[()\[\]]", "", x).replace("\\pi", "π")
    x = re.sub(r"(?<=[\d}])\\?π", "*3.14", x).replace("{π}", "3.14").replace("π", "3.14").replace("**3.14", "*3.14")
    for unit, put in (("%", "/100"), ("$", ""), ("¥", ""), ("°C", ""), (" C", ""), ("°", "")):
        x = x.replace(unit, put)
    x = re.sub(r"\\frac\{([^{}]*)\}\{([^{}]*)\}", r"((\1)/(\2))", x).replace("\\times", "*").replace("\\cdot", "*").replace("^", "**")
    try:
        return value(ast.parse(x.strip(), mode="eval").body)
    except (SyntaxError, ValueError, ZeroDivisionError, OverflowError, RecursionError, MemoryError, TypeError):
        return None


def simple_equal(a: str, b: str) -> float:
    """Equal without white space, hyphens, full stops and case."""
    return float(re.sub(r"[ \-\n\t.]", "", a).lower() == re.sub(r"[ \-\n\t.]", "", b).lower())


def numeric_match(prediction: str, target: str) -> float:
    """Values within one hundredth of the target's, lists in any order; else equal texts."""
    p, t = evaluated(prediction), evaluated(target)

    def near(x, y) -> bool:
        return not isinstance(x, list) and not isinstance(y, list) and not math.isnan(x) and abs(x - y) <= abs(y) * 0.01

    if p is None or t is None:
        return simple_equal(prediction, target)
    if isinstance(p, list) and isinstance(t, list):
        if len(p) != len(t) or any(isinstance(x, list) for x in p + t):
            return 0.0
        return float(all(near(x, y) for x, y in zip(sorted(p), sorted(t), strict=True)))
    return float(near(p, t))


def general_number_match(prediction: Column, target: Column) -> Column:
    return arrow_pair(numeric_match)(prediction, target)


def literal_items(text: Column, kind: str = "list") -> Column:
    """ARR-01: a literal list, tuple, set or bare comma list as an array of texts; kind=set drops repetitions. Null and unbalanced brackets give an empty array."""

    def items(x: str) -> list[str]:
        x = x.strip()
        close = {"(": ")", "[": "]", "{": "}"}.get(x[:1])
        if not x or (close and not x.endswith(close)):
            return []
        try:
            got = ast.literal_eval(x)
            found = [] if got is None else [str(got)] if isinstance(got, (int, float, str)) else list(map(str, got))
        except (SyntaxError, ValueError, TypeError, RecursionError, MemoryError):
            found = [p.strip() for p in (x[1:-1] if close else x).split(",")]
        return list(dict.fromkeys(found)) if kind == "set" else found

    return F.coalesce(A.arrow_text(items, "array<string>")(text), F.array().cast("array<string>"))


def literal_boxes(text: Column, size: int = 4) -> Column:
    """Literal boxes (x1, y1, x2, y2), or points with size 2, as arrays; a single one counts as a list; malformed ones are left out."""

    def boxes(x: str) -> list[list[float]]:
        try:
            got = ast.literal_eval(x.strip())
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return []
        if not isinstance(got, (list, tuple)):
            return []
        got = [got] if len(got) == size and all(isinstance(v, (int, float)) for v in got) else got
        return [list(map(float, b)) for b in got if isinstance(b, (list, tuple)) and len(b) == size and all(isinstance(v, (int, float)) for v in b)]

    return F.coalesce(A.arrow_text(boxes, "array<array<double>>")(text), F.array().cast("array<array<double>>"))


# -- boxes, points, times ----------------------------------------------------------------------


def best_box_iou(predicted: Column, truth: Column) -> Column:
    """Mean over the predicted boxes (arrays of four) of the best intersection over union with a true one; 0 without boxes."""

    def one(p: Column) -> Column:
        best = F.array_max(F.transform(truth, lambda t: S.box_iou([p[i] for i in range(4)], [t[i] for i in range(4)])))
        return F.coalesce(best, F.lit(0.0))

    return F.when(F.size(predicted) > 0, F.aggregate(predicted, F.lit(0.0), lambda s, p: s + one(p)) / F.size(predicted)).otherwise(0.0)


def point_distance(x: Column, y: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x - x2) * (x - x2) + (y - y2) * (y - y2))


def keypoint_score(predicted: Column, truth: Column, k: float = 10.0) -> Column:
    """Mean of exp(-k * distance / sqrt 2) over points in order; 0 for unequal numbers."""
    each = F.zip_with(predicted, truth, lambda p, t: F.exp(-k * point_distance(p[0], p[1], t[0], t[1]) / math.sqrt(2)))
    return F.when((F.size(predicted) == F.size(truth)) & (F.size(truth) > 0), F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / F.size(truth)).otherwise(0.0)


def corners(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """(x, y, width, height) in pixels as [x1, y1, x2, y2] in shares of the image."""
    return F.array(x / width, y / height, (x + w) / width, (y + h) / height)


def resize_factor(width: Column, height: Column, most_pixels: int) -> Column:
    """By what an image's sides are multiplied to have at most so many pixels; never above 1."""
    return F.least(F.lit(1.0), F.sqrt(F.lit(float(most_pixels)) / (width * height)))


def first_span(times: Column) -> Column:
    """[start, end] of the first two of an array of seconds, the lesser first; null with fewer."""
    a, b = F.try_element_at(times, F.lit(1)), F.try_element_at(times, F.lit(2))
    return F.when(a.isNotNull() & b.isNotNull(), F.array(F.least(a, b), F.greatest(a, b)))


def clock_span(text: Column) -> Column:
    """The first two times h:m:s or m:s of a text as a span in seconds."""
    return first_span(F.transform(F.regexp_extract_all(text, F.lit(r"\b([0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?)\b"), F.lit(1)), S.clock_seconds))


# -- rewards -----------------------------------------------------------------------------------

NUMBER = r"-?[0-9]+(?:\.[0-9]+)?"
BOX = r"\[\s*" + r"\s*,\s*".join([NUMBER] * 4) + r"\s*\]"


def box_in_thought(response: Column) -> Column:
    """1 if a think part holds a box [x1, y1, x2, y2]."""
    thoughts = F.regexp_extract_all(response, F.lit(r"(?s)<think>(.*?)</think>"), F.lit(1))
    return F.exists(thoughts, lambda t: t.rlike(BOX)).cast("double")


def think_answer_format(response: Column) -> Column:
    """1 if the response begins with a think part on one line, then an answer part."""
    return response.rlike(r"^<think>.*?</think>\s*<answer>.*?</answer>").cast("double")


def reward_math(response: Column, answer: Column) -> Column:
    """1 for boxed, tagged or whole answers that are equal as expressions, in value or as texts."""

    def one(r: str, a: str) -> float:
        def core(x: str) -> str:
            tag = re.search(r"<answer>(.*?)</answer>", x)
            x = tag[1] if tag else x
            return (A.unboxed(x) or x).strip()

        x, y = core(r), core(a)
        if x == y:
            return 1.0
        if symbolic_equal(x, y):
            return 1.0
        p, t = evaluated(x), evaluated(y)
        return float(p is not None and t is not None and (p == t or (not isinstance(p, list) and not isinstance(t, list) and math.isclose(p, t, rel_tol=1e-6))))

    return arrow_pair(one)(response, answer)


def joined_answers(answers: Column) -> Column:
    """A list answer as one text; an empty list is an empty text."""
    return F.array_join(answers, ", ")


RULES = {
    "number": S.reward_number, "math_expressions": reward_math, "html_code": reward_html, "svg_code": reward_svg, "boolean": S.reward_boolean, "multiple_choice": S.reward_choice,
    "ocrtext": S.reward_ocr, "critic": S.reward_exact, "any": S.reward_exact,
}
"""Rewards by answer type; general code is left out, since it would run untrusted programs."""


def typed_reward(answer_type: Column, response: Column, answers: Column, judge: Column | None = None, mode: str = "TYPE_BASED_JUDGE", problem_type: Column | None = None) -> Column:
    """The reward of an answer type, list answers being joined first; judge holds a judge's score.

    ALL_JUDGE takes the judge's for every row; TYPE_BASED_JUDGE for `judge` and unknown types; TYPE_BASED_RULE compares
    unknown types as texts. Spatial problems get half a point for a box in a think part. Names of types may have hyphens, as adapted rows have them, or
    underscores.
    """
    answer_type = F.replace(answer_type, F.lit("-"), F.lit("_"))
    problem_type = None if problem_type is None else F.replace(problem_type, F.lit("-"), F.lit("_"))
    answer = joined_answers(answers)
    judged = judge if judge is not None else F.lit(None).cast("double")
    if mode == "ALL_JUDGE":
        out = judged
    else:
        out = F.when(answer_type == "judge", judged)
        for name, rule in RULES.items():
            out = out.when(answer_type == name, rule(response, answer))
        out = out.otherwise(judged if mode == "TYPE_BASED_JUDGE" else S.reward_exact(response, answer))
    if problem_type is not None:
        out = out + F.when(problem_type == "spatial_reasoning", 0.5 * box_in_thought(response)).otherwise(0.0)
    return out


def rewards_exploded(rows, key: str, columns: dict[str, Column]):
    """(key, metric, score): one row a document and metric (UDF-05)."""
    return rows.select(key, F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), c.cast("double").alias("score")) for n, c in columns.items()])).alias("m")).select(key, "m.metric", "m.score")
