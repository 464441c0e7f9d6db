"""Answers out of responses, answer normalisers and prompts (STR-02, 05, 07, 09..12, 14..16, 18..20, 23, 25, 27..33, ARR-09, MAP-01, JSN-01)."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import squeeze

#: The contractions, number words, articles and punctuation of the public VQA evaluation.
CONTRACTIONS = {
    "aint": "ain't", "arent": "aren't", "cant": "can't", "couldve": "could've", "couldnt": "couldn't", "couldn'tve": "couldn't've", "couldnt've": "couldn't've", "didnt": "didn't",
    "doesnt": "doesn't", "dont": "don't", "hadnt": "hadn't", "hadnt've": "hadn't've", "hadn'tve": "hadn't've", "hasnt": "hasn't", "havent": "haven't", "hed": "he'd", "hed've": "he'd've",
    "he'dve": "he'd've", "hes": "he's", "howd": "how'd", "howll": "how'll", "hows": "how's", "Id've": "I'd've", "I'dve": "I'd've", "Im": "I'm", "Ive": "I've", "isnt": "isn't",
    "itd": "it'd", "itd've": "it'd've", "it'dve": "it'd've", "itll": "it'll", "let's": "let's", "maam": "ma'am", "mightnt": "mightn't", "mightnt've": "mightn't've",
    "mightn'tve": "mightn't've", "mightve": "might've", "mustnt": "mustn't", "mustve": "must've", "neednt": "needn't", "notve": "not've", "oclock": "o'clock", "oughtnt": "oughtn't",
    "ow's'at": "'ow's'at", "'ows'at": "'ow's'at", "'ow'sat": "'ow's'at", "shant": "shan't", "shed've": "she'd've", "she'dve": "she'd've", "she's": "she's", "shouldve": "should've",
    "shouldnt": "shouldn't", "shouldnt've": "shouldn't've", "shouldn'tve": "shouldn't've", "somebody'd": "somebodyd", "somebodyd've": "somebody'd've", "somebody'dve": "somebody'd've",
    "somebodyll": "somebody'll", "somebodys": "somebody's", "someoned": "someone'd", "someoned've": "someone'd've", "someone'dve": "someone'd've", "someonell": "someone'll",
    "someones": "someone's", "somethingd": "something'd", "somethingd've": "something'd've", "something'dve": "something'd've", "somethingll": "something'll", "thats": "that's",
    "thered": "there'd", "thered've": "there'd've", "there'dve": "there'd've", "therere": "there're", "theres": "there's", "theyd": "they'd", "theyd've": "they'd've",
    "they'dve": "they'd've", "theyll": "they'll", "theyre": "they're", "theyve": "they've", "twas": "'twas", "wasnt": "wasn't", "wed've": "we'd've", "we'dve": "we'd've", "weve": "we've",
    "werent": "weren't", "whatll": "what'll", "whatre": "what're", "whats": "what's", "whatve": "what've", "whens": "when's", "whered": "where'd", "wheres": "where's",
    "whereve": "where've", "whod": "who'd", "whod've": "who'd've", "who'dve": "who'd've", "wholl": "who'll", "whos": "who's", "whove": "who've", "whyll": "why'll", "whyre": "why're",
    "whys": "why's", "wont": "won't", "wouldve": "would've", "wouldnt": "wouldn't", "wouldnt've": "wouldn't've", "wouldn'tve": "wouldn't've", "yall": "y'all", "yall'll": "y'all'll",
    "y'allll": "y'all'll", "yall'd've": "y'all'd've", "y'alld've": "y'all'd've", "y'all'dve": "y'all'd've", "youd": "you'd", "youd've": "you'd've", "you'dve": "you'd've",
    "youll": "you'll", "youre": "you're", "youve": "you've",
}
NUMBER_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
ARTICLES = ("a", "an", "the")
VQA_MARKS = (";", "/", "[", "]", '"', "{", "}", "(", ")", "=", "+", "\\", "_", "-", ">", "<", "@", "`", ",", "?", "!")
GREEK = "αβγδεζηθικλμνξοπρστυφχψω"
GREEK_NAMES = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
ASR_MARKS = "!,.?;:"


def arrow_text(f, returns: str = "string"):
    """A function of one text as an Arrow-batched Column function, called once for each different text of a batch; null stays null."""

    @F.pandas_udf(returns)
    def run(x: pd.Series) -> pd.Series:
        made = {None: None}
        for v in x:
            if v not in made:
                made[v] = f(v)
        return pd.Series([made[v] for v in x], dtype=object)

    return run


def _replaced(text: Column, pairs) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


# -- what a response holds ---------------------------------------------------------------------


def last_boxed(text: str) -> str | None:
    r"""The last \boxed{...} (or \fbox{...}) with its braces balanced; null if there is none or it never closes. After `\boxed ` with a space, what stands before the next dollar sign."""
    if "\\boxed " in text:
        return "\\boxed " + text.rsplit("\\boxed ", 1)[1].split("$")[0]
    at = max(text.rfind("\\boxed"), -1)
    at = at if at >= 0 else text.rfind("\\fbox")
    if at < 0:
        return None
    deep = 0
    for m in re.finditer(r"[{}]", text[at:]):
        deep += 1 if m.group() == "{" else -1
        if deep == 0 and m.group() == "}":
            return text[at : at + m.end()]
    return None


def unboxed(text: str) -> str | None:
    """What the last box holds."""
    box = last_boxed(text)
    if box is None:
        return None
    found = re.fullmatch(r"(?s)\\(?:boxed|fbox)(?: (.*)|\{(.*)\})", box)
    return None if found is None else found[1] if found[1] is not None else found[2]


def boxed_content(text: Column) -> Column:
    return arrow_text(unboxed)(text)


def html_code(text: Column) -> Column:
    """The last answer tag's content, else the last HTML document, else the last code fence, else the text; trimmed."""

    def last(pattern: str) -> Column:
        return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(-1))

    found = F.coalesce(last(r"(?s)<answer>(.*?)</answer>"), last(r"(?si)((?:<!DOCTYPE html>|<html>).*?(?:</html>|$))"), last(r"(?s)```(?:html)?\s*(.*?)```"), text)
    return F.regexp_replace(found, r"^\s+|\s+$", "")


def html_normal(html: Column) -> Column:
    """One space for white space, single quotes, no comments, lower case."""
    out = F.replace(F.regexp_replace(html, r"\s+", " "), F.lit('"'), F.lit("'"))
    return F.lower(F.trim(F.regexp_replace(out, r"(?s)<!--.*?-->", "")))


def first_position(text: Column, yes: str = "yes", no: str = "no") -> Column:
    """1 if the word yes stands first, 0 if no does, -1 without either; whole words, any case."""

    def place(word: str) -> Column:
        head = F.regexp_extract(text, rf"(?si)^(.*?)\b{word}\b", 1)
        return F.when(text.rlike(rf"(?i)\b{word}\b"), F.length(head))

    a, b = place(yes), place(no)
    return F.when(a.isNull() & b.isNull(), -1).when(b.isNull() | (a < b), 1).otherwise(0)


def braced_number(text: Column) -> Column:
    """`{n}`: the first number in braces, else the first bare one; else the trimmed text."""
    inside, bare = F.regexp_extract(text, r"\{([0-9]+)\}", 1), F.regexp_extract(text, r"\b([0-9]+)\b", 1)
    braces = lambda c: F.concat(F.lit("{"), c, F.lit("}"))
    return F.when(inside != "", braces(inside)).when(bare != "", braces(bare)).otherwise(F.trim(text))


def tag_content(text: Column, tags: tuple[str, ...]) -> Column:
    """What follows the first of the tags (any case) up to the next `</` or the end; null without the tag."""
    names = "|".join(map(re.escape, tags))
    return F.when(text.rlike(f"(?i)<(?:{names})>"), F.trim(F.regexp_extract(text, rf"(?si)<(?:{names})>(.*?)(?:</|$)", 1)))


def smiles(text: Column) -> Column:
    """A molecule: the tag's content, or the last word of the text; tags go, `;` becomes `.`."""
    word = F.element_at(F.split(F.trim(text), r"\s+"), -1)
    word = F.when(word.endswith(".") & ~word.rlike(r"\.[a-zA-Z0-9]"), F.regexp_replace(word, r"\.+$", "")).otherwise(word)
    bare = F.when(F.contains(text, F.lit(" ")) & (F.length(word) > 1), word).otherwise(F.trim(text))
    found = F.coalesce(F.nullif(tag_content(text, ("SMILES", "SMILE")), F.lit("")), bare)
    return F.replace(F.trim(F.regexp_replace(found, "<[^>]+>", "")), F.lit(";"), F.lit("."))


def json_part(text: Column) -> Column:
    """The text from the first `{` to the last `}` if it is JSON; else null. Code fences are thereby left out."""
    found = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
    return F.when(F.get_json_object(found, "$").isNotNull(), found)


# -- filters over arrays of responses ----------------------------------------------------------


def strip_leading_space(responses: Column) -> Column:
    return F.transform(responses, lambda r: F.when(r.startswith(" "), F.substr(r, F.lit(2))).otherwise(r))


def lower_all(responses: Column) -> Column:
    return F.transform(responses, lambda r: F.lower(r))


def upper_all(responses: Column) -> Column:
    return F.transform(responses, lambda r: F.upper(r))


def map_all(responses: Column, mapping: dict[str, str], default: str | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]) if mapping else F.expr("map()").cast("map<string,string>")
    return F.transform(responses, lambda r: F.coalesce(F.try_element_at(table, r), F.lit(default)))


def take_first_k(responses: Column, k: int) -> Column:
    """The first k; a shorter list is an error."""
    return F.when(F.size(responses) >= k, F.slice(responses, 1, k)).otherwise(F.raise_error(F.lit(f"at least {k} responses are needed")).cast("array<string>"))


def majority_vote(responses: Column) -> Column:
    """[the most frequent response]; of ties, the one that comes first."""
    counted = F.transform(F.array_distinct(responses), lambda v: F.struct(F.size(F.filter(responses, lambda r: r == v)).alias("n"), (-F.array_position(responses, v)).alias("first"), v.alias("v")))
    return F.array(F.array_max(counted)["v"])


def regex_groups(responses: Column, pattern: str, select: int = 0, fallback: str = "[invalid]") -> Column:
    """Of each response, the selected match: its first group that is not empty, or the whole match of a pattern without groups."""
    groups = re.compile(pattern).groups
    at = F.lit(select + 1 if select >= 0 else select)

    def one(r: Column) -> Column:
        every = [F.regexp_extract_all(r, F.lit(pattern), F.lit(g)) for g in (range(1, groups + 1) if groups else [0])]
        found = F.coalesce(*[F.nullif(F.try_element_at(e, at), F.lit("")) for e in every], F.lit(""))
        return F.when(F.size(every[0]) >= (select + 1 if select >= 0 else -select), F.trim(found)).otherwise(F.lit(fallback))

    return F.transform(responses, one)


def _plain(text: str, ignore_case: bool, ignore_punctuation: bool, ignore: tuple[str, ...]) -> str:
    for p in ignore:
        text = re.sub(p, "", text)
    text = text.lower() if ignore_case else text
    return "".join(c for c in text if not unicodedata.category(c).startswith("P")) if ignore_punctuation else text


def _option(response: str, choices: list[str], pattern, select: int, fallback: str, plain) -> str:
    letters = [f"({chr(65 + i)})" for i in range(len(choices))]

    def picked(found: list) -> str:
        if not found:
            return ""
        hit = found[select]
        return (next((g for g in hit if g), "") if isinstance(hit, tuple) else hit).strip()

    if hit := picked(pattern.findall(response)):
        return hit
    by_text = dict(zip((plain(c.strip()) for c in choices), letters, strict=True))
    if by_text and (hit := picked(re.findall("|".join(map(re.escape, by_text)), plain(response)))):
        return by_text.get(hit, hit)
    if letters and (hit := picked(re.findall(r":\s*([" + "".join(x[1] for x in letters) + "])", response))):
        return f"({hit})"
    return fallback


def multi_choice(responses: Column, choices: Column, pattern: str = r"#### (\-?[0-9\.\,]+)", select: int = 0, fallback: str = "[invalid]", ignore_case: bool = False, ignore_punctuation: bool = False, ignore: tuple[str, ...] = ()) -> Column:
    """Of each response: the pattern's match; else `(A)` for a choice whose text it holds; else the letter after a colon; else the fallback."""
    compiled = re.compile(pattern)

    def plain(x: str) -> str:
        return _plain(x, ignore_case, ignore_punctuation, ignore)

    @F.pandas_udf("array<string>")
    def run(rs: pd.Series, cs: pd.Series) -> pd.Series:
        return pd.Series([None if r is None or c is None else [_option(x, list(c), compiled, select, fallback, plain) for x in r] for r, c in zip(rs, cs, strict=True)], dtype=object)

    return run(responses, choices)


def simple_choice(responses: Column, question: Column) -> Column:
    """The first response without punctuation, as the letter (in order from A) of the question's `X. text` line that it holds; else as it is."""

    def one(response: str, question: str) -> str:
        options = [m[1].strip() for m in re.findall(r"\b([A-Z])\.\s+([^\n]*)", question)]
        said = re.sub(r"[^\w\s]", "", response).strip()
        hit = re.search("|".join(map(re.escape, options)), said)
        letters = {o: chr(65 + i) for i, o in enumerate(options)}
        return letters.get(hit.group(), said) if hit else said

    @F.pandas_udf("string")
    def run(rs: pd.Series, qs: pd.Series) -> pd.Series:
        return pd.Series([None if r is None or q is None or not len(r) else one(r[0], q) for r, q in zip(rs, qs, strict=True)], dtype=object)

    return run(responses, question)


def choice_text(letter: Column, choices: Column) -> Column:
    """The text of option A, B, ...; null beyond the last."""
    return F.try_element_at(choices, (F.ascii(F.upper(letter)) - 64).cast("int"))


def choice_letter(text: Column, choices: Column) -> Column:
    at = F.array_position(choices, text)
    return F.when(at > 0, F.chr(at + 64))


# -- normalisers -------------------------------------------------------------------------------


def fix_mojibake(text: Column) -> Column:
    """Runs of characters beyond ASCII that are UTF-8 read as Latin-1 or Windows-1252, decoded (twice where it was done twice); then straight quotes, \\n line ends, no control characters and NFC."""

    def decoded(run: re.Match) -> str:
        for code in ("cp1252", "latin-1"):
            try:
                return run.group().encode(code).decode("utf-8")
            except UnicodeError:
                continue
        return run.group()

    def fix(x: str) -> str:
        for _ in range(2):
            x = re.sub("[^\x00-\x7f]+", decoded, x)
        for a, b in (("\u2018", "'"), ("\u2019", "'"), ("\u201c", '"'), ("\u201d", '"'), ("\r\n", "\n"), ("\r", "\n")):
            x = x.replace(a, b)
        return unicodedata.normalize("NFC", re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", x))

    return arrow_text(fix)(text)


def vqa_normal(answer: str) -> str:
    """An answer as the VQA evaluation compares it.

    Marks become nothing where one stands beside a space anywhere in the answer, or digits are grouped by commas, else a
    space; the first 32 full stops that no digit follows go (the public code passes a flag as the count); number words
    become digits, articles go, contractions get their apostrophes.
    """
    text = answer.lower().replace(",", "").replace("?", "").replace("'s", " 's").strip().replace("\n", " ").replace("\t", " ").strip()
    grouped = re.search(r"(?<=\d),+(?=\d)", text) is not None
    out = text
    for mark in VQA_MARKS:
        beside = f"{mark} " in text or f" {mark}" in text
        out = out.replace(mark, "" if beside or grouped else " ")
    out = re.sub(r"\.(?!\d)", "", out, count=32)
    numbers = {"none": "0"} | {w: str(i) for i, w in enumerate(NUMBER_WORDS)}
    words = [numbers.get(w, w) for w in out.lower().split()]
    return " ".join(CONTRACTIONS.get(w, w) for w in words if w not in ARTICLES)


def vqa_normalise(text: Column) -> Column:
    return arrow_text(vqa_normal)(text)


def asr_clean(text: Column, language: str = "en") -> Column:
    """Tags <|...|> to spaces, spaces squeezed, none before punctuation or at the start; for Chinese, none at all."""
    out = F.regexp_replace(F.regexp_replace(text, r"<\|.*?\|>", " "), r"\s+", " ")
    out = F.ltrim(F.regexp_replace(out, f" ?([{ASR_MARKS}])", "$1"))
    return F.regexp_replace(out, r"\s+", "") if language == "zh" else out


def without_punctuation_words(text: Column) -> Column:
    """Words between single spaces that are all punctuation go, empty ones too."""
    return F.array_join(F.filter(F.split(text, " ", -1), lambda w: w.rlike(r"[^\p{P}]")), " ")


def undo_wikitext(text: Column) -> Column:
    """Undoes the spacing of tokenised wiki text."""
    out = F.replace(text, F.lit("s '"), F.lit("s'"))
    # Separators and marks, in the order in which they are put right.
    out = _replaced(out, ((" @-@ ", "-"), (" @,@ ", ","), (" @.@ ", "."), (" : ", ": "), (" ; ", "; "), (" . ", ". "), (" ! ", "! "), (" ? ", "? "), (" , ", ", ")))
    for a, b in ("()", "[]", "{}", '""', "''"):
        out = F.regexp_replace(out, rf"\{a}\s*([^\{b}]*?)\s*\{b}", rf"\{a}$1\{b}")
    return _replaced(out, (("= = = =", "===="), ("= = =", "==="), ("= =", "=="), (" \u00b0 ", "\u00b0"), (" \n", "\n"), ("\n ", "\n"), (" N ", " 1 "), (" 's", "'s")))


def detokenise(text: Column, dataset: str) -> Column:
    """By the name in a dataset's path: ptb, wiki; other texts stay."""
    from corpusloom.functions.text import undo_ptb

    return undo_ptb(text) if "ptb" in dataset else undo_wikitext(text) if "wiki" in dataset else text


def latex_normal(text: Column) -> Column:
    r"""Macrons become \overline, Greek letters their names, math delimiters and environments go, \bar is \overline."""
    names = dict(zip(GREEK, GREEK_NAMES, strict=True)) | {g.upper(): n.capitalize() for g, n in zip(GREEK, GREEK_NAMES, strict=True)}

    def run(x: str) -> str:
        x = unicodedata.normalize("NFC", re.sub("(.)\u0304", r"\\overline{\1}", unicodedata.normalize("NFD", x)))
        x = x.replace("\\bar", "\\overline")
        x = re.sub(r"\\overline\{([^}]*)\}_([^{}\\ ]*)", r"\\overline{\1_\2}", x)
        x = "".join(f"\\{names[c]} " if c in names else c for c in x)
        return re.sub(r"\\(?:begin|end)\{.*?\}(?:\[[^\[\]]*\])?|\\[()\[\]]", "", x)

    return arrow_text(run)(text)


def has_answer(text: Column, answers: Column, regex: bool = False) -> Column:
    """Whether any answer's words stand in the text one after the other, both NFD-normalised and lower-cased; or, as patterns, match it anywhere."""

    def words(x: str) -> str:
        return " " + " ".join(re.findall(r"[\w]+|[^\w\s]", x)) + " "

    def run(x: str, every) -> bool:
        x = unicodedata.normalize("NFD", x)
        for a in every:
            a = unicodedata.normalize("NFD", a)
            if regex:
                try:
                    if re.search(a, x, re.IGNORECASE | re.UNICODE | re.MULTILINE):
                        return True
                except re.error:
                    continue
            elif words(a.lower()) in words(x.lower()):
                return True
        return False

    @F.pandas_udf("boolean")
    def out(xs: pd.Series, every: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or a is None else run(x, a) for x, a in zip(xs, every, strict=True)], dtype=object)

    return out(text, answers)


# -- prompts -----------------------------------------------------------------------------------


def typed_prompt(problem: Column, prompt_type: Column, answer_type: Column, suffixes: dict[str, str], formats: dict[str, str]) -> Column:
    """The problem, the guidance for its answer type, and the suffix of its prompt type, each on a line of its own where there is one."""

    def chosen(key: Column, table: dict[str, str]) -> Column:
        out = F.lit(None).cast("string")
        for k, v in table.items():
            out = F.when(key == k, v).otherwise(out)
        return out

    return F.concat_ws("\n", problem, chosen(answer_type, formats), chosen(prompt_type, suffixes))


def newline_after_image(text: Column) -> Column:
    """A line break after a leading <image>; only the first mark."""
    return F.regexp_replace(text, r"^<image>\n?", "<image>\n")


def history_prompt(history: Column, query: Column, kind: str = "chat") -> Column:
    """Earlier (query, response) pairs and the query as one prompt; base: the query alone."""
    if kind == "base":
        return query
    asks = {"vqa": "Short answer:", "chat": "Answer:"}[kind]
    told = F.array_join(F.transform(history, lambda h: F.concat(F.lit("Question: "), h["query"], F.lit(f" {asks} "), h["response"], F.lit("\n"))), "")
    return F.concat(F.coalesce(told, F.lit("")), F.lit("Question: "), query, F.lit(f" {asks}"))


def judge_prompt(kind: str, **columns: Column) -> Column:
    """A judge's prompt, in this engine's own words: binary, comparative or correctness; answers are parsed by judged_*."""
    heads = {
        "binary": "Decide whether the prediction agrees with the reference answer. Say 1 if it does and 0 if it does not.",
        "comparative": "Score both responses from 1 to 10. Give the two numbers on the first line.",
        "correctness": "Decide whether the prediction is right. Say Yes or No.",
    }
    parts = [F.lit(heads[kind])] + [F.concat(F.lit(f"[{k.replace('_', ' ').capitalize()}]\n"), v) for k, v in columns.items()]
    return F.concat_ws("\n\n", *parts)


def judged_binary(text: Column, yes_no: bool = False) -> Column:
    """0/1: whether there is a 1 anywhere; yes/no: whether the answer begins with yes."""
    t = F.lower(F.trim(text))
    return t.startswith("yes").cast("int") if yes_no else F.contains(t, F.lit("1")).cast("int")


def judged_score(text: Column, low: float | None = None, high: float | None = None) -> Column:
    """The first number, within the bounds; without one the lower bound, or 0."""
    found = F.nullif(F.regexp_extract(text, r"(-?[0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).cast("double")
    if low is not None and high is not None:
        found = F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), found)) + F.when(found.isNull(), F.lit(None)).otherwise(F.lit(0.0))
    return F.coalesce(found, F.lit(float(low or 0.0)))


def judged_pair(text: Column) -> Column:
    """(first, second): the first two numbers of the first line; -1 and -1 if there are not two."""
    line = F.translate(F.element_at(F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), "\n"), 1), ",;", "  ")
    found = F.transform(F.regexp_extract_all(line, F.lit(r"(-?[0-9]+(?:\.[0-9]+)?)"), F.lit(1)), lambda x: x.cast("double"))
    none = F.lit(-1.0)
    two = F.size(found) >= 2
    return F.struct(F.when(two, F.try_element_at(found, F.lit(1))).otherwise(none).alias("first"), F.when(two, F.try_element_at(found, F.lit(2))).otherwise(none).alias("second"))


def squeezed(text: Column) -> Column:
    return squeeze(text)
