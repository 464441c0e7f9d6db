"""Personal data by weak supervision, in DataFrame and SQL functions only.

Wide patterns propose candidate spans. Labelers vote on each (format and checksum, gazetteer, context words,
boundaries: yes, no or abstain); expectation-maximisation over the histogram of vote patterns estimates how
reliable each labeler is; the posteriors train a naive-Bayes span classifier on shape features. Spans
that the plain base patterns find stay whatever the classifier says; it decides on the others.

Patterns are written so that no repetition holds a group: a group's repetition recurses in the
regex engine, which a very long run of characters would overflow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import discard, ids_first, materialise

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "secret", "ssn")
LABELERS = 4
ROUNDS = 20

#: Patterns of candidates by kind. `%` stands for dots, and `x` for separators, that can't be inside a match.
PATTERN = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9][0-9 -]+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])[0-9a-f]{32,128}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: Texts without these hold no candidate of the kind.
HINT = {
    "email": r"@[A-Za-z0-9-]",
    "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    "card": r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]",
    "phone": r"\+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11}",
    "secret": r"[0-9a-f]{32}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
#: Words that speak for a kind where they stand shortly before a span.
CONTEXT = {
    "email": "mail|contact|kontakt|courriel|correo|write|from|to:",
    "ip": "ip|host|server|address|adresse|login|from",
    "card": "card|visa|mastercard|amex|carte|karte|tarjeta|payment|paid",
    "phone": "phone|tel|call|mobile|fax|appel|anruf|numero",
    "iban": "iban|account|konto|compte|cuenta|bank",
    "secret": "token|secret|key|password|passwd|auth|api",
    "ssn": "ssn|social|security|insurance",
}
#: Public gazetteers. Top-level domains, calling codes, card issuer prefixes, IBAN countries.
GAZETTEER = {
    "email": r"\.(?:com|org|net|edu|gov|io|info|biz|de|fr|es|uk|eu|us|ch|at|it|nl|be)$",
    "ip": r"^(?!0+\.|127\.|255\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "phone": r"^\+(?:1|7|2[0-9]|3[0-46-9]|4[0-9]|5[1-8]|6[0-6]|8[1-6]|9[0-58])",
    "iban": r"^(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|GR|IE|IT|LU|NL|NO|PL|PT|SE)",
    "secret": r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9a-f]{128})$",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
}


def _spelt(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _prepared(kind: str, text: str) -> str:
    """The text with as many characters in which the kind's pattern needs no group repetition."""
    if kind == "email":  # dots that don't stand between label characters
        return f"regexp_replace({text}, {_spelt(r'(?<![A-Za-z0-9-])\.|\.(?![A-Za-z0-9-])')}, '%')"
    if kind == "card":  # separators that don't stand alone between digits
        return f"regexp_replace({text}, {_spelt(r'(?<![0-9])[ -]|[ -](?![0-9])')}, 'x')"
    return text


CHUNK = 64
"""Items of an array that grows one by one; full ones go to an array of such, so that long texts with very many matches are not copied again for each."""


def _gathered(items: str, more: str, start: str, item: str, when: str, after: str, kind: str) -> str:
    """SQL: a struct (at, all) of a pass over items x that carries at (from start, after x as `after` says) and keeps an item of each x for which `when` holds."""
    empty, nothing = f"cast(array() as array<{kind}>)", f"cast(array() as array<array<{kind}>>)"
    return (
        f"aggregate({items}, named_struct('at', {start}, 'cur', {empty}, 'out', {nothing}), (s, x) -> named_struct('at', {after}, "
        f"'cur', CASE WHEN NOT ({when}) THEN s.cur WHEN size(s.cur) >= {CHUNK} THEN array({item}) ELSE array_append(s.cur, {item}) END, "
        f"'out', CASE WHEN ({when}) AND size(s.cur) >= {CHUNK} THEN array_append(s.out, s.cur) ELSE s.out END), s -> {more})"
    )


def _matches(kind: str, text: str) -> str:
    """SQL: the kind's matches as structs (kind, start, end), by the lengths of the matches and of the gaps between them."""
    ready, pattern = _prepared(kind, text), _spelt(PATTERN[kind])
    found = f"zip_with(split({ready}, {pattern}, -1), regexp_extract_all({ready}, {pattern}, 0), (g, m) -> named_struct('g', length(g), 'm', length(m)))"
    item = f"named_struct('kind', '{kind}', 'start', s.at + x.g, 'end', s.at + x.g + x.m)"
    every = _gathered(found, "flatten(array_append(s.out, s.cur))", "0", item, "x.m IS NOT NULL", "s.at + x.g + coalesce(x.m, 0)", "struct<kind:string,start:int,end:int>")
    return f"CASE WHEN {text} RLIKE {_spelt(HINT[kind])} THEN {every} ELSE cast(array() as array<struct<kind:string,start:int,end:int>>) END"


DIGITS = "regexp_replace(x.value, '[^0-9]', '')"
LUHN = (
    f"aggregate(sequence(1, length({DIGITS})), 0L, (s, i) -> s + CASE WHEN i % 2 = 1 THEN cast(substr({DIGITS}, -i, 1) AS int) "
    f"ELSE (2 * cast(substr({DIGITS}, -i, 1) AS int)) % 10 + (2 * cast(substr({DIGITS}, -i, 1) AS int)) div 10 END) % 10 = 0"
)
OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: SQL: whether the format is right, checksums and ranges included.
VALID = f"""CASE x.kind WHEN 'ip' THEN x.value RLIKE {_spelt("^" + r"\.".join([OCTET] * 4) + "$")}
 WHEN 'card' THEN CASE WHEN length({DIGITS}) BETWEEN 13 AND 19 THEN {LUHN} ELSE false END
 WHEN 'phone' THEN length({DIGITS}) BETWEEN 9 AND 15
 WHEN 'secret' THEN x.value RLIKE '[0-9]' AND x.value RLIKE '[a-f]' ELSE true END"""


def _by_kind(values: dict[str, str]) -> str:
    return "CASE x.kind " + " ".join(f"WHEN '{k}' THEN {_spelt(v)}" for k, v in values.items()) + " END"


def candidates(documents: DataFrame) -> DataFrame:
    """documents (doc_id, text) with spans: array of (kind, start, end, base, key), key holding votes and features."""
    text = "coalesce(text, '')"
    every = f"concat({', '.join(_matches(k, text) for k in BASE + ADDED)})"
    df = documents.withColumn("_found", F.expr(every))
    seen = f"transform(_found, x -> named_struct('kind', x.kind, 'start', x.start, 'end', x.end, 'value', substr({text}, x.start + 1, x.end - x.start), 'before', substr({text}, greatest(x.start - 23, 1), least(x.start, 24)), 'after', substr({text}, x.end + 1, 1)))"
    df = df.withColumn("_seen", F.expr(f"CASE WHEN size(_found) = 0 THEN NULL ELSE {seen} END"))
    df = df.withColumn("_seen", F.expr(f"transform(_seen, x -> named_struct('kind', x.kind, 'start', x.start, 'end', x.end, 'value', x.value, 'before', x.before, 'after', x.after, 'valid', {VALID}))"))
    base = f"x.kind IN ({', '.join(map(repr, BASE))}) AND x.valid"
    bounded = "NOT (right(x.before, 1) RLIKE '[A-Za-z0-9]' OR x.after RLIKE '[A-Za-z0-9]')"
    votes = (
        "concat(CASE WHEN x.valid THEN '2' ELSE '1' END, "
        f"CASE WHEN regexp_replace(x.value, '[ -]', '') RLIKE {_by_kind(GAZETTEER)} OR x.value RLIKE {_by_kind(GAZETTEER)} THEN '2' ELSE '1' END, "
        f"CASE WHEN lower(x.before) RLIKE {_by_kind(CONTEXT)} THEN '2' ELSE '0' END, "
        f"CASE WHEN {bounded} THEN '2' ELSE '1' END)"
    )
    shape = (
        "concat_ws('|', x.kind, "
        "cast(least(length(x.value) div 4, 9) AS string), "
        f"cast(length({DIGITS}) * 4 div length(x.value) AS string), "
        "CASE WHEN right(x.before, 1) = '' THEN 'start' WHEN right(x.before, 1) RLIKE '\\\\s' THEN 'space' WHEN right(x.before, 1) RLIKE '[A-Za-z0-9]' THEN 'word' ELSE 'sign' END, "
        "CASE WHEN x.after = '' THEN 'end' WHEN x.after RLIKE '\\\\s' THEN 'space' WHEN x.after RLIKE '[A-Za-z0-9]' THEN 'word' ELSE 'sign' END)"
    )
    struct = f"named_struct('kind', x.kind, 'start', x.start, 'end', x.end, 'base', {base}, 'key', concat({votes}, '|', {shape}))"
    return df.withColumn("spans", F.expr(f"coalesce(transform(_seen, x -> {struct}), cast(array() AS array<struct<kind:string,start:int,end:int,base:boolean,key:string>>))")).drop("_found", "_seen")


def reliabilities(histogram: DataFrame) -> DataFrame:
    """One row `model`: labeler reliabilities and priors by expectation-maximisation over (votes, kind, n).

    Each labeler j votes yes with probability a[j] on personal data and 1 - b[j] on other spans, given
    that it votes; kinds have priors of their own. All sums run over the histogram, which has at
    most 3 ** LABELERS rows a kind.
    """
    packed = histogram.groupBy("votes", "kind").agg(F.sum("n").cast("double").alias("n")).agg(F.collect_list(F.struct("votes", "kind", "n")).alias("h"))
    vote = "substr(x.votes, j, 1)"
    yes = f"aggregate(sequence(1, {LABELERS}), 1D, (p, j) -> p * CASE {vote} WHEN '2' THEN s.a[j - 1] WHEN '1' THEN 1 - s.a[j - 1] ELSE 1D END)"
    no = f"aggregate(sequence(1, {LABELERS}), 1D, (p, j) -> p * CASE {vote} WHEN '2' THEN 1 - s.b[j - 1] WHEN '1' THEN s.b[j - 1] ELSE 1D END)"
    expect = f"transform(h, x -> named_struct('votes', x.votes, 'kind', x.kind, 'n', x.n, 'p', coalesce(element_at(s.pi, x.kind), 0.5D) * {yes} / (coalesce(element_at(s.pi, x.kind), 0.5D) * {yes} + (1 - coalesce(element_at(s.pi, x.kind), 0.5D)) * {no})))"

    def share(above: str, below: str) -> str:
        return f"(1 + aggregate(e, 0D, (t, x) -> t + {above})) / (2 + aggregate(e, 0D, (t, x) -> t + {below}))"

    a = f"transform(sequence(1, {LABELERS}), j -> {share(f'''CASE WHEN {vote} = '2' THEN x.n * x.p ELSE 0D END''', f'''CASE WHEN {vote} != '0' THEN x.n * x.p ELSE 0D END''')})"
    b = f"transform(sequence(1, {LABELERS}), j -> {share(f'''CASE WHEN {vote} = '1' THEN x.n * (1 - x.p) ELSE 0D END''', f'''CASE WHEN {vote} != '0' THEN x.n * (1 - x.p) ELSE 0D END''')})"
    prior = f"map_from_entries(transform(array_distinct(transform(e, x -> x.kind)), k -> named_struct('k', k, 'v', {share('CASE WHEN x.kind = k THEN x.n * x.p ELSE 0D END', 'CASE WHEN x.kind = k THEN x.n ELSE 0D END')})))"
    step = f"transform(array({expect}), e -> named_struct('a', {a}, 'b', {b}, 'pi', {prior}))[0]"
    start = f"named_struct('a', array_repeat(0.8D, {LABELERS}), 'b', array_repeat(0.8D, {LABELERS}), 'pi', map_from_entries(transform(array_distinct(transform(h, x -> x.kind)), k -> named_struct('k', k, 'v', 0.5D))))"
    done = packed.select("h", F.expr(f"aggregate(sequence(1, {ROUNDS}), {start}, (s, r) -> {step})").alias("s"))
    return done.select(F.expr(f"inline({expect})")).select("votes", "kind", "p")


def weights(found: DataFrame) -> dict[str, float]:
    """The trained classifier of the added kinds, as log odds by `kind|votes` and `kind|feature|value`.

    Naive Bayes over the shape features, trained on the posteriors as soft labels, with the
    posterior of the votes themselves as one more feature. Votes and features are buckets: at most
    3 ** LABELERS + 23 weights a kind, whatever the corpus is, which is what the driver receives.
    """
    keys = found.select(F.explode("spans").alias("x")).groupBy("x.key").agg(F.count("*").alias("n"))
    parts = F.split("key", r"\|")
    keys = materialise(keys.select("n", parts[0].alias("votes"), parts[1].alias("kind"), F.slice(parts, 3, 4).alias("shape")), "votes")
    labelled = materialise(keys.join(reliabilities(keys), ["votes", "kind"]).where(F.col("kind").isin(*ADDED)), "labelled")
    p = F.greatest(F.least("p", F.lit(1 - 1e-9)), F.lit(1e-9))
    odds = F.log((F.sum(F.col("n") * F.col("p")) + 1) / (F.sum(F.col("n") * (1 - F.col("p"))) + 1))
    seen = labelled.select("kind", "n", "p", F.posexplode(F.concat(F.array(F.lit("")), "shape")).alias("i", "value"))
    shapes = seen.groupBy("kind", "i", "value").agg(odds.alias("w"))
    votes = labelled.groupBy("kind", "votes").agg(F.max(F.log(p / (1 - p))).alias("w")).select("kind", F.lit(-1).alias("i"), F.col("votes").alias("value"), "w")
    rows = shapes.unionByName(votes).collect()
    discard(keys)
    discard(labelled)
    prior = {r["kind"]: r["w"] for r in rows if r["i"] == 0}
    # Each shape weight holds the prior once; what a feature adds is its weight less the prior.
    out = {f"{r['kind']}|{r['value']}": r["w"] for r in rows if r["i"] == -1}
    return out | {f"{r['kind']}|{r['i']}|{r['value']}": (r["w"] - prior[r["kind"]]) * 0.25 for r in rows if r["i"] > 0}


def _chosen() -> Column:
    """Base spans, and accepted others that overlap no base span, by kind as listed and start."""
    score = "element_at(_model, concat(p[1], '|', p[0])) + " + " + ".join(f"element_at(_model, concat(p[1], '|{i}|', p[{i + 1}]))" for i in range(1, 5))
    accepted = f"transform(array(split(x.key, '[|]')), p -> {score})[0] > 0"
    added = f"filter(spans, x -> NOT x.base AND x.kind IN ({', '.join(map(repr, ADDED))}) AND {accepted} AND NOT exists(spans, y -> y.base AND y.start < x.end AND x.start < y.end))"
    order = {k: i for i, k in enumerate(BASE + ADDED)}
    rank = "CASE x.kind " + " ".join(f"WHEN '{k}' THEN {i}" for k, i in order.items()) + " END"
    both = f"concat(filter(spans, x -> x.base), {added})"
    return F.expr(f"transform(array_sort(transform({both}, x -> named_struct('rank', {rank}, 'start', x.start, 'end', x.end, 'kind', x.kind))), x -> named_struct('kind', x.kind, 'start', x.start, 'end', x.end))")


def detect(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, base: array of (kind, start, end), spans: likewise with those that the method adds), a row for each row.

    Starts and ends count code points, ends exclusive; both arrays are ordered by kind (email, ip, card, phone,
    iban, secret, ssn), then start. Null and empty texts have no spans; repeated rows and null ids are rows like any
    other; an empty table gives no rows; other columns are not read. keep_text adds the text, keep
    other columns, whose names are none of these.
    """
    docs = ids_first(documents, id_col, text_col, keep)
    found = candidates(docs)
    found = materialise(found if keep_text else found.drop("text"), "spans")
    model = weights(found)
    names, values = (F.lit(list(x)) for x in (model.keys(), model.values())) if model else (F.expr("cast(array() AS array<string>)"), F.expr("cast(array() AS array<double>)"))
    chosen = found.withColumn("_model", F.map_from_arrays(names, values)).withColumn("chosen", _chosen())
    base = F.expr(f"filter(chosen, x -> x.kind IN ({', '.join(map(repr, BASE))}))")
    return chosen.select("doc_id", *["text"] * keep_text, *keep, base.alias("base"), F.col("chosen").alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): spans as text, kind:start:end joined by commas."""

    def said(name: str) -> str:
        return f"array_join(transform({name}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"

    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) AS long)").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(F.expr(said("base")), 256).alias("base_sha256"), F.expr(said("spans")).alias("spans"))


def redact(found: DataFrame) -> Column:
    """Of detect(keep_text=True): the text with each span replaced by its kind in angle brackets; overlaps are one replacement."""
    ordered = "array_sort(transform(spans, x -> named_struct('start', x.start, 'end', x.end, 'kind', x.kind)))"
    item = "named_struct('from', s.at, 'to', x.start, 'kind', x.kind)"
    parts = _gathered(ordered, "named_struct('at', s.at, 'p', flatten(array_append(s.out, s.cur)))", "0", item, "x.start >= s.at", "greatest(s.at, x.end)", "struct<from:int,to:int,kind:string>")
    said = "concat(array_join(transform(r.p, p -> concat(substr(text, p.from + 1, p.to - p.from), '<', upper(p.kind), '>')), ''), substr(text, r.at + 1))"
    return F.expr(f"CASE WHEN size(spans) = 0 THEN text ELSE transform(array({parts}), r -> {said})[0] END")
