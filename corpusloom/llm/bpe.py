"""BPE encoding by speculate and verify.

Greedy longest match proposes each word's tokens. A token sequence is what merging in rank order
gives exactly when every token encodes to itself and every adjacent pair is compatible: no merge
across the boundary would have been applied before the pieces that face each other there were made.
The pairs of all new words of a batch are tested together in numpy by unwinding the two facing
spines of the merge trees; only the words with a failing pair are merged exactly.

Tokenizer files are never copied or trained; their path is a parameter and each executor opens it.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from corpusloom.llm.lookup import Slots, by_length, keys_of, powers, prefixes
from corpusloom.llm.shared import ids_first, small_batches, sole, strings, worker_cache

END = "</w>"
LONG = 256
"""Words of more bytes are merged exactly, by a heap."""
PAIRS = 20
"""Bits of the number of pairs whose test is remembered."""
ROUNDS = 8
"""Turns a byte that a word may take before it is merged exactly."""
PROVEN = 0x20000
"""Code points below are tested one by one against the library; a text with one that differs, or beyond, is split by the library itself."""
_ODD_SPACES = re.compile("[\x1c-\x1f]")
#: White space of the vocabulary's pattern language: fixed values of Unicode's White_Space property.
_SPLIT = re.compile("[\t-\r \x85\xa0  -     　]+")
#: The published pre-tokenisation pattern of this vocabulary, white space already being gone.
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+")


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def normal(text: str) -> str:
    """NFC, then lower case letter by letter (no final-sigma rule)."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def pieces_of(text: str) -> list[str]:
    """The parts between white space."""
    if _ODD_SPACES.search(text):
        return [x for x in _SPLIT.split(text) if x]
    return text.split()


class Codec:
    """With text, speculates and verifies; else only ids are wanted, which packing takes from the library's merges. Encodes as a word-final BPE vocabulary file does; keeps at most cache_size recent parts."""

    def __init__(self, path: str, text: bool = False, cache_size: int = 0):
        self.path, self._library, self._odd = path, None, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != END:
            raise ValueError("a BPE vocabulary with word ends is needed")
        self.vocab: dict[str, int] = model["vocab"]
        size = max([*self.vocab.values(), *(x["id"] for x in spec["added_tokens"])]) + 1
        self.names: list[str] = [""] * size
        for k, v in self.vocab.items():
            self.names[v] = k
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self._special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.left, self.right = np.arange(size), np.arange(size)
        self.rank: dict[tuple[int, int], int] = {}
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            made = self.vocab[a + b]
            self.left[made], self.right[made] = self.vocab[a], self.vocab[b]
            self.rank[self.vocab[a], self.vocab[b]] = made
        keys = np.array([a << 20 | b for a, b in self.rank], dtype=np.int64)
        made = np.array(list(self.rank.values()), dtype=np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_made = keys[order], made[order]
        if np.any(made < np.maximum(self.left[made], self.right[made])):
            raise ValueError("token ids must follow the order of the merges")
        self.inner = {k: v for k, v in self.vocab.items() if not k.endswith(END)}
        self.final = {k.removesuffix(END): v for k, v in self.vocab.items() if k.endswith(END)}
        self.letters = byte_letters()
        self.byte_of = {c: i for i, c in enumerate(self.letters)}
        self.longest = max(len(k) for k in (*self.inner, *self.final))
        self.powers = powers(self.longest + 1)
        self.seen_keys, self.seen_good = np.full(1 << PAIRS, -1, np.int64), np.zeros(1 << PAIRS, bool)
        if text:
            (self.inner_slots, self.inner_ids), (self.final_slots, self.final_ids) = self._index(self.inner, ""), self._index(self.final, END)
        self.cache_size = cache_size or (400_000 if text else 750_000)
        self.known: dict = {}
        self.render = self.as_text if text else self.as_bytes
        for k, v in self.special.items():
            self.names[v] = k
        self.decimals = list(map(str, range(size)))
        self.speculated = self.merged = 0

    # -- one word ------------------------------------------------------------------------------

    def _index(self, known: dict[str, int], end: str) -> tuple[Slots, np.ndarray]:
        """The tokens that encode to themselves, by the bytes they stand for; the last id is for none."""
        sound = [k for k, v in known.items() if self._merge([self.inner[c] for c in k[:-1]] + [(self.final if end else self.inner)[k[-1]]]) == [v]]
        keys = keys_of([bytes(map(self.byte_of.__getitem__, k)) for k in sound])
        return Slots(keys), np.array([known[k] for k in sound] + [-1], dtype=np.int32)

    def exact(self, word: str) -> list[int]:
        """Merges the pair of least rank, the leftmost first, until none is left."""
        ids = [self.inner[c] for c in word[:-1]] + [self.final[word[-1]]]
        return self._merge(ids)

    def _merge(self, ids: list[int]) -> list[int]:
        rank = self.rank
        if len(ids) > 200:
            return self._merge_long(ids)
        while len(ids) > 1:
            best, at = 1 << 62, -1
            for i in range(len(ids) - 1):
                r = rank.get((ids[i], ids[i + 1]))
                if r is not None and r < best:
                    best, at = r, i
            if at < 0:
                break
            ids[at : at + 2] = [best]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and links, for words of any length."""
        import heapq

        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.rank.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = r, False, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (q := self.rank.get((r, ids[after[i]]))) is not None:
                    heapq.heappush(heap, (q, i, r, ids[after[i]]))
            if (h := before[i]) >= 0 and (q := self.rank.get((ids[h], r))) is not None:
                heapq.heappush(heap, (q, h, ids[h], r))
        return [x for x, live in zip(ids, alive, strict=True) if live]

    # -- many words ----------------------------------------------------------------------------

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the boundary of each adjacent pair (a, b) survives merging in rank order."""
        good = np.ones(len(a), dtype=bool)
        live = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), 1 << 40, dtype=np.int64)
        while len(live):
            key = a << 20 | b
            spot = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            clash = (self.pair_keys[spot] == key) & (self.pair_made[spot] < limit)
            good[live[clash]] = False
            down_a, down_b = self.right[a], self.left[b]
            can_a, can_b = down_a != a, down_b != b
            use_a = np.where(a > b, can_a, can_a & ~can_b)  # the later merge is undone first
            use_b = ~use_a & can_b
            limit = np.where(use_a, a, np.where(use_b, b + 1, limit))
            a, b = np.where(use_a, down_a, a), np.where(use_b, down_b, b)
            stay = (use_a | use_b) & ~clash
            live, a, b, limit = live[stay], a[stay], b[stay], limit[stay]
        return good

    def pairs_hold(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """compatible(), remembering recent pairs: a slot for each of many hashes, in which a new pair replaces the old one."""
        key = a.astype(np.int64) << 20 | b.astype(np.int64)
        slot = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIRS)).astype(np.int64)
        out = self.seen_good[slot]
        new = np.flatnonzero(self.seen_keys[slot] != key)
        if len(new):
            some, which = np.unique(key[new], return_inverse=True)
            good = self.compatible(some >> 20, some & 0xFFFFF)[which]
            out[new] = good
            self.seen_keys[slot[new]] = key[new]
            # Of pairs that share a slot the last one written must hold it with its own answer.
            last = self.seen_keys[slot[new]] == key[new]
            self.seen_good[slot[new[last]]] = good[last]
        return out

    def matches(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of words as rows of n bytes: tokens[word, begin, length] that match there (a word's last one must end words), and the longest length of one up to each length; 0 for none."""
        count, n = codes.shape
        m = min(n, self.longest)
        tokens = np.full((count, n, m + 1), -1, dtype=np.int32)
        before = prefixes(codes)
        for k in range(1, m + 1):
            part = before[:, k:] - before[:, : n + 1 - k] * self.powers[k]
            found = self.inner_ids[self.inner_slots.find(part[:, : n - k])] if n > k else None
            if found is not None:
                tokens[:, : n - k, k] = found
            tokens[:, n - k, k] = self.final_ids[self.final_slots.find(part[:, n - k])]
        lengths = np.where(tokens >= 0, np.arange(m + 1), 0).astype(np.int16)
        return tokens, np.maximum.accumulate(lengths, axis=2)

    def propose(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tokens[word, step], how many steps, settled) of words as rows of n bytes.

        Every word in its turn takes the longest token that matches where it is and is compatible with the one before;
        all words take their steps at once. Where none fits, the word goes back a step and takes a shorter
        token; a place that it had to leave is not entered again, since a prefix has one encoding only. Where every
        adjacent pair is compatible and every token encodes to itself, the tokens are those of merging in rank order.
        Words that take more than ROUNDS turns a byte are not settled.
        """
        count, n = codes.shape
        tokens, longest = self.matches(codes)
        m = longest.shape[2] - 1
        room = np.minimum(n - np.arange(n + 1), m)
        out, lengths = np.full((count, n), -1, dtype=np.int32), np.zeros((count, n), dtype=np.int16)
        dead = np.zeros((count, n + 1), dtype=bool)
        at, steps = np.zeros(count, np.int64), np.zeros(count, np.int64)
        k = longest[:, 0, room[0]].astype(np.int64)
        live = np.arange(count)
        for _ in range(ROUNDS * n):
            if not len(live):
                break
            stuck = k[live] == 0
            if stuck.any():  # back one step
                w = live[stuck]
                w = w[steps[w] > 0]
                dead[w, at[w]] = True
                steps[w] -= 1
                was = lengths[w, steps[w]].astype(np.int64)
                at[w] -= was
                k[w] = longest[w, at[w], was - 1]
                live = live[~stuck | (steps[live] > 0) | (k[live] > 0)]
            w = live[k[live] > 0]
            own, to = k[w], at[w] + k[w]
            token = tokens[w, at[w], own]
            fits = ~dead[w, to]
            ask = np.flatnonzero(fits & (steps[w] > 0))
            if len(ask):
                fits[ask] = self.pairs_hold(out[w[ask], steps[w[ask]] - 1], token[ask])
            no = w[~fits]
            k[no] = longest[no, at[no], k[no] - 1]
            w, token, own, to = w[fits], token[fits], own[fits], to[fits]
            out[w, steps[w]], lengths[w, steps[w]] = token, own
            at[w] = to
            steps[w] += 1
            k[w] = np.where(to < n, longest[w, np.minimum(to, n - 1), room[to]], 0)
            live = live[at[live] < n]
        return out, steps, at == n

    def encode_spelt(self, spelt: list[str]) -> list[list[int]]:
        """Ids of each non-empty word, spelt with a letter a byte."""
        raw = [w.encode("latin-1") if w.isascii() else bytes(map(self.byte_of.__getitem__, w)) for w in spelt]
        out: list = [None] * len(raw)
        failing: list[int] = []
        for n, places in by_length(raw):
            if n > LONG:
                failing += places.tolist()
                continue
            size = max(1, (1 << 21) // (n * min(n, self.longest)))
            for low in range(0, len(places), size):
                some = places[low : low + size]
                codes = np.frombuffer(b"".join([raw[i] for i in some]), np.uint8).reshape(len(some), n).astype(np.uint64)
                tokens, steps, settled = self.propose(codes)
                for i, row, k, ok in zip(some.tolist(), tokens.tolist(), steps.tolist(), settled.tolist(), strict=True):
                    if ok:
                        out[i] = row[:k]
                    else:
                        failing.append(i)
        self.speculated += len(out)
        self.merged += len(failing)
        for i in failing:
            out[i] = self.exact(spelt[i])
        return out

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each non-empty word, a word being a match of the pre-tokenisation pattern."""
        return self.encode_spelt(self.spell(words))

    def merge_words(self, spelt: list[str]) -> Iterator[list[int]]:
        """Exact merging, by the merge loop of the library's model, which takes one spelt word at a time."""
        merge = self.library().model.tokenize
        return ([t.id for t in merge(s)] for s in spelt)

    def spell(self, words: list[str]) -> list[str]:
        letters = self.letters
        return [w if w.isalpha() and w.isascii() else "".join([letters[c] for c in w.encode("utf-8", "replace")]) for w in words]

    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
            self._library.no_truncation()
            self._library.no_padding()
        return self._library

    def odd(self) -> np.ndarray:
        """Of each code point, whether the library may normalise or split it in another way than normal() and pieces_of() do."""
        if self._odd is None:
            points = [p for p in range(128, PROVEN) if not 0xD800 <= p < 0xE000]
            bad: list[int] = [p for p in points if unicodedata.category(chr(p)) == "Cn"]
            known = set(bad)
            points = [p for p in points if p not in known]
            probes = ["a{}b", "a{}\u0323", "a{}\u0301"]

            def differ(some: list[int]) -> bool:
                text = " ".join(form.format(chr(p)) for p in some for form in (probes if unicodedata.combining(chr(p)) else probes[:1]))
                return self.split_here(text) != self.split_there(text)

            for at in range(0, len(points), 64):
                some = points[at : at + 64]
                if differ(some):
                    bad += [p for p in some if differ([p])]
            self._odd = np.zeros(0x110000, dtype=bool)
            self._odd[bad] = True
            self._odd[0xD800:0xE000] = True
            self._odd[PROVEN:] = True
        return self._odd

    def is_odd(self, text: str) -> bool:
        return not text.isascii() and bool(self.odd()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")].any())

    def split_here(self, text: str) -> list[str]:
        """Spelt words of a text without special tokens."""
        return self.spell([w for p in pieces_of(normal(text)) for w in ([p] if p.isalpha() else _WORD.findall(p))])

    def split_there(self, text: str) -> list[str]:
        """The same by the library."""
        lib = self.library()
        return [p for p, _ in lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(text))]

    def learn(self, parts: Iterable[str]) -> None:
        """Makes every part's encoding known."""
        known = self.known
        parts = set(parts)
        new = [p for p in parts if p not in known]
        if not new:
            return
        if len(known) + len(new) > self.cache_size:
            known.clear()
            new = list(parts)
        render = self.render
        if render == self.as_bytes:  # most parts are single words, which need no table of their words
            single, other = [], []
            for p in new:
                (single if p.isalpha() else other).append(p)
            known.update(zip(single, map(self.as_bytes, self.merge_words(self.spell(single))), strict=True))
            split = list(map(_WORD.findall, other))
            words = list({w for ws in split for w in ws})
            raw = dict(zip(words, map(self.as_bytes, self.merge_words(self.spell(words))), strict=True))
            known.update((p, b"".join([raw[w] for w in ws])) for p, ws in zip(other, split, strict=True))
            return
        split = [p if p.isalpha() else _WORD.findall(p) for p in new]
        words = list({*(w for w in split if type(w) is str), *(w for ws in split if type(ws) is list for w in ws)})
        ids = dict(zip(words, self.encode_words(words), strict=True))
        for p, ws in zip(new, split, strict=True):
            known[p] = render(ids[ws] if type(ws) is str else [x for w in ws for x in ids[w]])

    def as_bytes(self, ids: list[int]) -> bytes:
        return array("I", ids).tobytes()

    def as_text(self, ids: list[int]) -> tuple[int, str, str]:
        decimals, names = self.decimals, self.names
        return len(ids), " ".join([decimals[x] for x in ids]), " ".join([names[x] for x in ids])

    def encode_many(self, texts: list[str]) -> Iterator[list]:
        """For each text, its parts in order, each as render() makes it of the part's ids."""
        step = 256
        for at in range(0, len(texts), step):
            own = texts[at : at + step]
            odd = self.is_odd("".join(own))
            some = [self._parts(x, odd and self.is_odd(x)) for x in own]
            if sum(map(len, some)) > self.cache_size:  # very long texts: one at a time, in slices
                for x in some:
                    out: list = []
                    for k in range(0, len(x), self.cache_size // 2):
                        out += self._looked_up(x[k : k + self.cache_size // 2])
                    yield out
                continue
            self.learn(y for x in some for y in x if type(y) is str)
            get = self.known.__getitem__
            for x in some:
                yield list(map(get, x)) if type(x) is Plain else [get(y) if type(y) is str else self.render([y]) if type(y) is int else y for y in x]

    def _looked_up(self, x: list) -> list:
        self.learn(y for y in x if type(y) is str)
        return [self.known[y] if type(y) is str else self.render([y]) if type(y) is int else y for y in x]

    def _parts(self, text: str, odd: bool) -> list:
        """The text's parts; special tokens stand among them as their ids, and what the library had to split as it is rendered."""
        if not odd and (self._special is None or "<|" not in text or not self._special.search(text)):
            return Plain(pieces_of(normal(text)))
        out: list = []
        for x in self._special.split(text) if self._special else [text]:
            if x in self.special:
                out.append(self.special[x])
            elif odd:
                spelt = self.split_there(x)
                ids = self.merge_words(spelt) if self.render == self.as_bytes else self.encode_spelt(spelt)
                out.append(self.render([t for own in ids for t in own]))
            else:
                out += pieces_of(normal(x))
        return out


class Plain(list):
    """Parts without special tokens."""


_CODECS: dict[tuple[str, bool, int], Codec] = worker_cache()


def codec(path: str, text: bool = False, cache_size: int = 0) -> Codec:
    """This process's codec for a vocabulary file, with a cache of so many parts (0: the usual number)."""
    sole(_CODECS)
    if (path, text, cache_size) not in _CODECS:
        _CODECS.clear()
        _CODECS[path, text, cache_size] = Codec(path, text, cache_size)
    return _CODECS[path, text, cache_size]


def encode(documents: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, token_ids array, decoded), a row for each row of documents.

    decoded joins the token names by one space, as the library's decode does for a vocabulary without a
    decoder. Null text: as an empty one, with no tokens. Repeated rows are each encoded; a null id is kept.
    keep=False leaves out the two large columns.
    """
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary, True)
        for batch in batches:
            n, ids, sha, names, sha_names = [], [], [], [], []
            for parts in c.encode_many(strings(batch.column(1)).to_pylist()):
                n.append(sum([p[0] for p in parts]))
                decimals, text = " ".join([p[1] for p in parts]), " ".join([p[2] for p in parts])
                sha.append(hashlib.sha256(decimals.encode()).hexdigest())
                sha_names.append(hashlib.sha256(text.encode()).hexdigest())
                if keep:
                    ids.append(list(map(int, decimals.split())))
                    names.append(text)
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(sha_names, pa.string())]
            labels = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep:
                cols += [pa.array(ids, pa.list_(pa.int32())), pa.array(names, pa.string())]
                labels += ["token_ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, labels)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>, decoded string" * keep
    return ids_first(documents, id_col, text_col).mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """(doc_id, text): token names joined by one space, special tokens included. Ids that are no token's are passed over, as the library does; null ids: an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = codec(vocabulary, True).names
        for batch in batches:
            out = [" ".join([names[x] for x in ids or [] if x is not None and 0 <= x < len(names)]) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return encoded.select(encoded[id_col].cast("long").alias("doc_id"), encoded[ids_col].cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
