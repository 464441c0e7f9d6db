"""Language ID by segmentation-marginalised unigrams.

Each language has probabilities of the pieces of a fixed public vocabulary. A word's probability in a language is the
sum over all its segmentations into pieces, by the forward algorithm; expectation-maximisation
with forward and backward sums fits the pieces to the labelled words. Words are scored together in
numpy, once for each part of a text between white space that a task meets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.lookup import Slots, by_length, coded, keys_of, powers, prefixes
from corpusloom.llm.shared import materialise, small_batches, sole, strings, worker_cache

LETTERS = regex.compile(r"\p{L}+")
PLAIN = 24
"""Words of more letters are summed with their sums scaled on the way, since products of so many probabilities get too small."""
LANGUAGES = 1000
"""More languages are refused: the model and what is broadcast for the sample grow with their number."""
BUCKETS = 1024
"""Parts of the range of hashes in which the sample's cut is looked for; a power of two."""
EVIDENCE = 30.0
"""Words whose evidence a score counts at most, so that it doesn't saturate with a text's length."""
UNKNOWN = "UNKNOWN"
SAMPLE = 500
"""Labelled texts of each language that the pieces are fitted to: those of least hash of id. The only bound of training."""


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def vocabulary_pieces(path: str) -> dict[str, int]:
    """Lower-case pieces of letters of a sentencepiece model, with and without the mark of a word's beginning."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i).lower()
        body = piece.removeprefix("▁")
        if body and body.isalpha() and piece not in found:
            found[piece] = len(found)
    return found


class Pieces:
    """The pieces, by hashes of their letters. That a substring which is none has a piece's hash is a chance of 2 ** -64 for each."""

    def __init__(self, known: dict[str, int]):
        """known numbers the pieces from 0."""
        self.count = len(known)
        self.longest = max((len(p.removeprefix("▁")) for p in known), default=1)
        self.powers, self.slots = powers(self.longest + 1), Slots(keys_of(list(known)))

    def ids(self, codes: np.ndarray, begins: bool = True) -> np.ndarray:
        """ids[word, begin, length - 1] of pieces; count stands for an unknown letter, -1 for none. A word's beginning takes the pieces that are marked as such."""
        count, n = codes.shape
        m = min(n, self.longest)
        out = np.full((count, n, m), -1, dtype=np.int32)
        before = prefixes(codes)
        mark = ord("▁") + 1
        for k in range(1, m + 1):
            part = before[:, k:] - before[:, : n + 1 - k] * self.powers[k]
            out[:, : n + 1 - k, k - 1] = self.slots.find(part)
            if begins:
                first = self.slots.find(part[:, 0] + np.uint64(mark * int(self.powers[k]) & 0xFFFFFFFFFFFFFFFF))
                out[:, 0, k - 1] = np.where((k == 1) & (first < 0), out[:, 0, 0], first)
        out[:, :, 0] = np.where(out[:, :, 0] < 0, self.count, out[:, :, 0])
        return out


def lattices(words: list[str], pieces: Pieces | dict[str, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words by length: (their places, their ids)."""
    pieces = Pieces(pieces) if isinstance(pieces, dict) else pieces
    for n, places in by_length(words):
        yield places, pieces.ids(coded([words[i] for i in places], n))


def forward(ids: np.ndarray, table: np.ndarray) -> np.ndarray:
    """alpha[j, word, language]: the summed probability of all segmentations of the first j letters. The table's last row is for -1 and zero."""
    count, n, m = ids.shape
    alpha = np.zeros((n + 1, count, table.shape[1]))
    alpha[0] = 1
    for a in range(n):
        for k in range(min(m, n - a)):
            alpha[a + k + 1] += alpha[a] * table[ids[:, a, k]]
    return alpha


def log_forward(words: list[str], n: int, pieces: Pieces, table: np.ndarray) -> np.ndarray:
    """log of the summed probability of all segmentations of words of n letters, by language, for any n.

    Letters are gone through in stretches, each read with the letters that the longest piece needs; only the sums of
    as many last letters are kept, and scaled after each letter.
    """
    step = 4096
    m = min(n, pieces.longest)
    window = np.zeros((m + 1, len(words), table.shape[1]))  # window[k]: the sum at k letters after the present one
    window[0] = 1
    scale = np.zeros((len(words), table.shape[1]))
    for low in range(0, n, step):
        ids = pieces.ids(coded([w[low : low + step + m - 1] for w in words], min(step + m - 1, n - low)), begins=low == 0)
        for a in range(min(step, n - low)):
            for k in range(min(m, n - low - a)):
                window[k + 1] += window[0] * table[ids[:, a, k]]
            window[:-1] = window[1:]
            window[-1] = 0
            top = window.max(axis=0)
            top = np.where(top > 0, top, 1.0)
            window /= top
            scale += np.log(top)
    return np.log(np.maximum(window[0], 1e-300)) + scale


def log_words(words: list[str], pieces: Pieces, table: np.ndarray) -> np.ndarray:
    """log of each word's summed probability, by language."""
    out = np.zeros((len(words), table.shape[1]))
    for n, places in by_length(words):
        size = 4096 if n <= PLAIN else max(1, 65536 // n)
        for at in range(0, len(places), size):
            some = places[at : at + size]
            own = [words[i] for i in some]
            out[some] = np.log(np.maximum(forward(pieces.ids(coded(own, n)), table)[n], 1e-300)) if n <= PLAIN else log_forward(own, n, pieces, table)
    return out


def expected_counts(ids: np.ndarray, weight: np.ndarray, table: np.ndarray) -> np.ndarray:
    """How often each piece is used in the words, over all their segmentations, by their probabilities: forward and backward sums, in logs for long words."""
    count, n, m = ids.shape
    size = len(table)
    expected = np.zeros(size)
    if n <= PLAIN:
        alpha = forward(ids, table)[:, :, 0]
        beta = np.zeros((n + 1, count))
        beta[n] = 1
        for a in range(n - 1, -1, -1):
            for k in range(min(m, n - a)):
                beta[a] += table[ids[:, a, k], 0] * beta[a + k + 1]
        scale = weight / np.maximum(alpha[n], 1e-300)
        for a in range(n):
            for k in range(min(m, n - a)):
                expected += np.bincount(ids[:, a, k] % size, weights=alpha[a] * table[ids[:, a, k], 0] * beta[a + k + 1] * scale, minlength=size)
        return expected
    with np.errstate(divide="ignore"):
        logs = np.log(table[:, 0])
    # Beyond the word's end nothing is added: those places hold the zero row's id.
    alpha, beta = np.full((n + m + 1, count), -np.inf), np.full((n + m + 1, count), -np.inf)
    alpha[0], beta[n] = 0, 0
    inside = np.arange(n)[:, None] + np.arange(m)[None] < n
    for a in range(n):
        step = np.where(inside[a], logs[ids[:, a]], -np.inf).T
        alpha[a + 1 : a + m + 1] = np.logaddexp(alpha[a + 1 : a + m + 1], alpha[a] + step)
    for a in range(n - 1, -1, -1):
        step = np.where(inside[a], logs[ids[:, a]], -np.inf).T
        beta[a] = np.logaddexp.reduce(step + beta[a + 1 : a + m + 1], axis=0)
    for k in range(min(m, n)):
        gain = np.exp(alpha[: n - k] + logs[ids[:, : n - k, k]].T + beta[k + 1 : n + 1] - alpha[n]) * weight
        expected += np.bincount((ids[:, : n - k, k] % size).T.ravel(), weights=gain.ravel(), minlength=size)
    return expected


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray
    """Probability of each piece, an unknown letter, and zero, by language."""
    path: str


def fit(counts: list[tuple[str, str, int]], path: str, rounds: int = 3) -> Model:
    """From (language, word, count) rows of the bounded sample."""
    pieces = Pieces(vocabulary_pieces(path))
    languages = sorted({c[0] for c in counts})
    size = pieces.count + 2
    columns = []
    for language in languages:
        words = [c[1] for c in counts if c[0] == language]
        weight = np.array([c[2] for c in counts if c[0] == language], dtype=float)
        grids = list(lattices(words, pieces))
        table = np.full((size, 1), 1.0 / size)
        for _ in range(rounds):
            table[-1] = 0
            expected = np.zeros(size)
            for places, ids in grids:
                expected += expected_counts(ids, weight[places], table)
            expected[-1] = 0
            expected[:-1] += 0.01
            table = (expected / expected.sum()).reshape(-1, 1)
        table[-1] = 0
        columns.append(table)
    return Model(languages, np.concatenate(columns, axis=1) if columns else np.zeros((size, 0)), path)


class Scorer:
    """Log-probabilities by language of the parts of texts, the recent ones kept."""

    def __init__(self, model: Model, cache_size: int = 250_000):
        self.model, self.pieces, self.cache_size = model, Pieces(vocabulary_pieces(model.path)), cache_size
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, len(model.languages) + 1))
        self.used = 0

    def learn(self, parts: set[str]) -> None:
        new = [p for p in parts if p not in self.known]
        if not new:
            return
        if len(self.known) + len(new) > self.cache_size:
            self.known, self.used = {}, 0
            new = list(parts)
        split = [[p] if p.isalpha() else LETTERS.findall(p) for p in new]
        words = list({w for ws in split for w in ws})
        logs = np.zeros((len(words), len(self.model.languages) + 1))
        logs[:, :-1] = log_words(words, self.pieces, self.model.table)
        logs[:, -1] = 1  # words of letters
        where = {w: i for i, w in enumerate(words)}
        need = self.used + len(new)
        if need > len(self.rows):
            grown = np.zeros((max(need, 2 * len(self.rows)), self.rows.shape[1]))
            grown[: self.used] = self.rows[: self.used]
            self.rows = grown
        owner = np.repeat(np.arange(len(new)), [len(ws) for ws in split])
        flat = np.array([where[w] for ws in split for w in ws], dtype=np.int64)
        block = self.rows[self.used : need]
        block[:] = 0
        np.add.at(block, owner, logs[flat])
        self.known.update(zip(new, range(self.used, need), strict=True))
        self.used = need

    def score(self, texts: list[str]) -> tuple[list[str], list[float]]:
        labels, scores = [], []
        for at in range(0, len(texts), 200):
            some = [t.lower().split() for t in texts[at : at + 200]]
            self.learn({p for x in some for p in x})
            get = self.known.__getitem__
            for x in some:
                total = self.rows[np.fromiter(map(get, x), dtype=np.int64, count=len(x))].sum(axis=0)
                n, sums = total[-1], total[:-1]
                if n == 0 or not len(sums):
                    labels.append("und")
                    scores.append(0.0)
                    continue
                best = int(np.argmax(sums))
                odds = np.exp((sums - sums[best]) * min(1.0, EVIDENCE / n))
                labels.append(self.model.languages[best])
                scores.append(float(1 / odds.sum()))
        return labels, scores


_SCORERS: dict[int, Scorer] = worker_cache()


def scorer(model: Model) -> Scorer:
    """This process's scorer for a model."""
    sole(_SCORERS)
    held = _SCORERS.get(0)
    if held is None or held.model.path != model.path or held.model.languages != model.languages or not np.array_equal(held.model.table, model.table):
        held = _SCORERS[0] = Scorer(model)
    return held


def sampled(usable: DataFrame, sample: int) -> DataFrame:
    """(doc_id, lang) of the `sample` rows of least hash of id in each language (ties by id).

    Counts by language and part of the range of hashes say below which part the sample lies; only rows there are
    ranked, so that no task sees a language's rows, however many it has.
    """
    keyed = usable.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).withColumn("part", F.shiftright("h", 64 - (BUCKETS - 1).bit_length()))
    parts = keyed.groupBy("lang", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("part")) - F.col("n")
    cut = parts.withColumn("before", before).where(F.col("before") < sample).groupBy("lang").agg(F.max("part").alias("cut"))
    cut = materialise(cut, "cuts")
    if cut.count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    near = keyed.join(F.broadcast(cut), "lang").where("part <= cut")  # one row a language, LANGUAGES at most
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    return near.withColumn("r", rank).where(F.col("r") <= sample).select("doc_id", "lang").distinct()


def training_words(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(lang, word, n) of the sampled labelled texts: those of least hash of id in each language. Words are runs of letters, of any length."""
    usable = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out(), F.lit(False)))
    words = usable.join(F.broadcast(sampled(usable, sample)), ["doc_id", "lang"], "left_semi")  # at most sample rows a language, of which there are LANGUAGES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple[str, str], int] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w in LETTERS.findall(text.lower()):
                    counts[lang, w] = counts.get((lang, w), 0) + 1
            rows = [(a, b, n) for (a, b), n in counts.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])

    return words.select("lang", "text").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(documents: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = training_words(docs, sample)
    return fit([(r["lang"], r["word"], r["n"]) for r in counts.toLocalIterator()], vocabulary)


def predict(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) and the columns to keep, a row for each row of documents.

    score is the posterior under even priors, of evidence scaled down to that of 30 words; `und` with score 0 where
    the text is null or has no letter, or nothing was learnt. Ties go to the first language in order.
    A null id counts as not held out. Repeated rows are rows like any other; an empty table gives none.
    """
    small_batches(documents.sparkSession)
    names = [f"_kept{i}" for i in range(len(keep))]
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), *(F.col(k).alias(n) for k, n in zip(keep, names, strict=True)))
    kinds = dict(documents.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = scorer(model)
        for batch in batches:
            labels, scores = held.score(strings(batch.column(1)).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(labels, pa.string()), pa.array(scores, pa.float64()), *batch.columns[3:]], ["doc_id", "held_out", "lang_pred", "score", *names])

    schema = "doc_id long, held_out boolean, lang_pred string, score double" + "".join(f", {n} {kinds[k]}" for k, n in zip(keep, names, strict=True))
    out = docs.mapInArrow(run, schema)
    return out
