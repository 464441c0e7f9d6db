"""License scans: winnowed template fingerprints pick candidates, banded alignment reports coverage and spans.

Templates are a bounded parameter: their inverted index goes to every task. Every k-gram of a text is looked up in it. How
long a template's grams are and over how many the least is kept follows from its words: an alignment with the
share COVERAGE of n words leaves a run of at least (n - e) / (e + 1) words without an error, e being the errors allowed,
and up to LONG words of a template every such run holds a kept gram. Longer templates are winnowed wider: they need a run of
LONG_GRAM + LONG_WINDOW - 1 words somewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm.license_texts import templates as known_templates
from corpusloom.llm.shared import blocks, ids_first, rolling, small_batches

BAND = 8
COVERAGE = 0.8
GRAM = 3
"""Grams have so many words, or fewer where a template is so short that a run may be shorter."""
LONG, LONG_GRAM, LONG_WINDOW = 60, 4, 4
TEMPLATES = known_templates()


def gram_and_window(words: int, coverage: float) -> tuple[int, int]:
    errors = words - int(np.ceil(coverage * words - 1e-9))
    run = (words - errors) // (errors + 1)
    if words > LONG:
        return LONG_GRAM, LONG_WINDOW
    gram = max(1, min(GRAM, run, words))
    return gram, max(1, run - gram + 1) if run >= gram else 1


class Index:
    """Templates' words, and by the size of grams where each winnowed fingerprint stands in them."""

    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE):
        self.names = sorted(templates)
        self.words, entries = [], {}
        for i, name in enumerate(self.names):
            own = [b.hashes for b in blocks(pa.array([templates[name]]), lower=True, size=1 << 40, signs=True)]
            words = own[0] if own else np.zeros(0, np.uint64)
            if not len(words):
                raise ValueError(f"template {name} has no words")
            self.words.append(words)
            gram, window = gram_and_window(len(words), coverage)
            grams = rolling(words, gram)
            kept = {int(a + np.argmin(grams[a : a + window])) for a in range(max(1, len(grams) - window + 1))}
            entries.setdefault(gram, []).extend((grams[a], i, a) for a in sorted(kept))
        self.counts = [np.unique(w, return_counts=True) for w in self.words]
        self.tables = {}
        for gram, rows in sorted(entries.items()):
            marks = np.array([r[0] for r in rows], dtype=np.uint64)
            order = np.argsort(marks, kind="stable")
            self.tables[gram] = marks[order], np.array([r[1] for r in rows])[order], np.array([r[2] for r in rows])[order]

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the words, template, place in the template) of every gram that the index has."""
        out = [(np.zeros(0, np.int64),) * 3]
        for gram, (marks, owner, place) in self.tables.items():
            grams = rolling(words, gram)
            low, high = np.searchsorted(marks, grams), np.searchsorted(marks, grams, side="right")
            many = high - low
            at = np.repeat(np.arange(len(grams)), many)
            entry = np.repeat(low, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            out.append((at, owner[entry], place[entry]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def rows_hit(self, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Rows of a block that have a gram of the index."""
        rows = [np.searchsorted(bounds, np.flatnonzero(np.isin(rolling(hashes, gram), t[0])), side="right") - 1 for gram, t in self.tables.items()]
        return np.unique(np.concatenate(rows)) if rows else np.zeros(0, np.int64)


_FIRST, _MATCHED = 22, 21
"""Bits of a cell for the first matched word and for the matched ones; the score stands above them."""


def align(template: np.ndarray, text: np.ndarray, band: int) -> tuple[int, int, int]:
    """(matched words, first, last + 1) of the best alignment of the whole template within text.

    Cells lie at most band beside the diagonal that starts at text[band]; a match is worth 1, a skipped or replaced word costs
    1 on the template's side and on the text's side; text before and after the first and last match is free, and so are the
    template's words after the last match. Of the cells of one template word all are computed at once: a cell is one number, of
    score, matched words and where the first match was, so that the greatest is the best; skipped text words are a running maximum.
    """
    n, m = len(template), len(text)
    width = 2 * band + 1
    one, match = 1 << (_FIRST + _MATCHED), 1 << _FIRST
    d = np.arange(width)
    low = -(n + m + 2) * one
    top = (1 << _FIRST) - 1  # the first place is kept as top - place, so that of equal cells the earliest is the greatest
    row = np.full(width, 0, dtype=np.int64)
    row[d > m] = low
    fresh = np.ones(width, dtype=bool)  # no match yet
    padded = np.concatenate([text, np.zeros(width + 1, dtype=text.dtype)])
    best, best_end = low, 0
    for i in range(n):
        here = padded[i : i + width] if i + width <= len(padded) else np.concatenate([padded[i:], np.zeros(width, text.dtype)])[:width]
        inside = i + d < m
        hit = inside & (here == template[i])
        replaced = np.where(hit, row + one + match + np.where(fresh, top - (i + d), 0), row - one)
        replaced = np.where(inside, replaced, low)
        skipped = np.append(row[1:] - one, low)  # a template word without a text word
        nxt = np.maximum(replaced, skipped)
        began = np.where(replaced >= skipped, fresh & ~hit, np.append(fresh[1:], True))
        # A text word without a template word costs one more for each place that the value comes from further left; nothing is gained before the first match.
        moved = np.maximum.accumulate(np.where(began, low, nxt) + d * one) - d * one
        use = moved > nxt
        row, fresh = np.where(use, moved, nxt), np.where(use, False, began)
        ends = np.where(hit & (replaced >= nxt), replaced, low)
        k = int(ends.argmax())
        if ends[k] > best:
            best, best_end = int(ends[k]), i + k + 1
    if best <= low:
        return 0, 0, 0
    matched = (best >> _FIRST) & ((1 << _MATCHED) - 1)
    return matched, top - (best & top), best_end


def spans_of(row: np.ndarray, index: Index, band: int, coverage: float) -> list[tuple[str, int, int, int, int]]:
    """(template, first word, last word + 1, matched, template's words) of one text's word hashes, by place."""
    at, owner, place = index.hits(row)
    out = []
    for t in np.unique(owner).tolist():
        template = index.words[t]
        need = coverage * len(template) - 1e-9
        wide = max(band, int(len(template) - need))  # so far an alignment may leave its diagonal by missing words alone
        starts = np.unique((at - place)[owner == t])  # diagonals; nearby ones are one candidate
        last_end = -1
        group_from = None
        for i, s in enumerate(starts.tolist()):
            group_from = s if group_from is None else group_from
            if i + 1 < len(starts) and starts[i + 1] - group_from <= wide:
                continue
            begin = max(0, group_from - wide)
            pad = group_from - wide - begin  # before the text's first word there is nothing to align with
            window = row[begin : max(0, group_from + len(template) + 2 * wide)]
            group_from = None
            names, many = np.unique(window, return_counts=True)
            _, x, y = np.intersect1d(index.counts[t][0], names, assume_unique=True, return_indices=True)
            if np.minimum(index.counts[t][1][x], many[y]).sum() < need:
                continue  # fewer words in common than an alignment needs
            matched, first, end = align(template, window if pad >= 0 else np.concatenate([np.zeros(-pad, np.uint64), window]), wide)
            first, end = first + begin + min(pad, 0), end + begin + min(pad, 0)
            if matched >= need and first >= last_end:
                out.append((index.names[t], first, end, matched, len(template)))
                last_end = end
    best: list[tuple[str, int, int, int, int]] = []
    for x in sorted(out, key=lambda x: (x[4] - 2 * x[3], x[1], x[0])):
        if all(x[2] <= y[1] or y[2] <= x[1] for y in best):
            best.append(x)
    return sorted(best, key=lambda x: (x[1], x[2], x[0]))


def scan(documents: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, band: int = BAND, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, matches: array of (license, start, end, matched, words)), a row for each row of documents.

    Words are runs of ASCII letters and digits and of letters beyond ASCII, A-Z lower-cased. start and end count code
    points of the text. A template matches where at least the share coverage of its words is aligned in order; of
    matches that overlap, the one counts whose matched words exceed its missing ones by most, then the first. Null and empty texts have none; repeated
    rows and null ids are rows like any other; an empty table gives no rows; other columns are not read.
    """
    small_batches(documents.sparkSession)
    index = Index(TEMPLATES if templates is None else templates, coverage)
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("matched", pa.int32()), ("words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(batch.num_rows)]
            for b in blocks(batch.column(1), lower=True, signs=True):
                for r in index.rows_hit(b.hashes, b.bounds).tolist():
                    low, high = b.bounds[r], b.bounds[r + 1]
                    head = b.data[b.row_bytes[r] : b.row_bytes[r + 1]]
                    points = np.concatenate([[0], np.cumsum((head & 0xC0) != 0x80)])  # code points before each byte
                    for name, first, end, matched, words in spans_of(b.hashes[low:high], index, band, coverage):
                        start, stop = b.starts[low + first] - b.row_bytes[r], b.ends[low + end - 1] - b.row_bytes[r]
                        out[b.first + r].append({"license": name, "start": int(points[start]), "end": int(points[stop]), "matched": matched, "words": words})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["doc_id", "matches"])

    return ids_first(documents, id_col, text_col).mapInArrow(run, "doc_id long, matches array<struct<license:string,start:long,end:long,matched:int,words:int>>")
