"""The ten operators and the pipeline on small tables with nulls, empty texts, copies and clashing columns, against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import bpe, graph, jpeg, language, licenses, minhash, packing, personal, substrings, vectors, warc
from corpusloom.llm.queries import piece_vocabulary, second_replica, word_vocabulary

random.seed(5)
WORDS = ["the", "tion", "Éléa", "dann", "über", "que", "ofand", "ingthe", "x1", "Foo.", "b,", "déjà"]


def sentence(n):
    return " ".join(random.choice(WORDS) + random.choice(["", "", "s", "er"]) for _ in range(n))


BASE = sentence(120)
TEXTS = [
    None, "", " \n\t", "one", "one two", BASE, BASE, BASE + " tail", "head " + BASE, sentence(40) + " " + " ".join(BASE.split()[20:90]) + " " + sentence(30),
    "a " * 60, "a " * 80, "mail bob.x@mail7.example.com or +1 (017) 555-7713 now", "ip 10.2.3.4 1.2.3.999 card 4111 1111 1111 1111 4111 1111 1111 1112", "..a@b.c%d@e.f a@b x@y.z. 1.2.3.4.5.6.7.8",
    'token = "' + "ab12" * 10 + '" end', "Text.\nReleased under the MIT License.\nmore", "<|endoftext|> is special <|x|>", "x" * 3000, sentence(5000), "😀 ÀÉ \x1c\x85 ok",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, found int, _kept int, key int, spans int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "fr" if i % 2 else "en", "s", 1, 1, 1, 1, 1) for i, t in enumerate(TEXTS)], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids_of(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_vocabulary()).encode(text or "", add_special_tokens=False).ids


def test_packing(docs, empty):
    rows = packing.pack(docs, word_vocabulary(), 512).collect()
    by, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append(r)
    total = 0
    for i, text in enumerate(TEXTS):
        ids = [*ids_of(text), 1]
        total += len(ids)
        parts = sorted(by[i], key=lambda r: r["piece"])
        assert [r["start"] for r in parts] == list(range(0, len(ids), 512))
        for r in parts:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes())
    for rs in bins.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 512
    assert len(bins) <= 1.1 * -(-total // 512)
    assert packing.pack(empty, word_vocabulary(), 512).count() == 0


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(1)
    n = np.bincount(rng.integers(1, 4097, 20_000), minlength=4097)
    lengths = np.flatnonzero(n)
    plan = packing.plan(lengths, n[lengths], 4096)
    assert (plan.high - plan.low).sum() == 20_000
    assert plan.sequences <= 1.03 * (lengths * n[lengths]).sum() / 4096


def test_codec(docs, empty):
    got = {r["doc_id"]: r for r in bpe.encode(docs, word_vocabulary()).collect()}
    for i, text in enumerate(TEXTS):
        ids = ids_of(text)
        assert got[i]["token_ids"] == ids and got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(docs, word_vocabulary()), word_vocabulary()).collect()}
    assert all(back[i] == got[i]["decoded"] for i in got)
    assert bpe.encode(empty, word_vocabulary()).count() == 0


def test_speculation_agrees_with_exact_merging(monkeypatch):
    words = ["".join(random.choice("aeinrst") for _ in range(random.randint(1, 14))) for _ in range(3000)] + ["x" * 300, "é" * 90, "ab" * 60]
    for rounds in (8, 1):  # with few turns some words stay unsettled and are merged
        monkeypatch.setattr(bpe, "ROUNDS", rounds)
        c = bpe.Codec(word_vocabulary(), text=True)
        assert c.encode_words(words) == [c.exact(w) for w in c.spell(words)]
        assert c.speculated == len(words) and (c.merged <= 2 if rounds == 8 else 100 < c.merged < len(words))
    monkeypatch.setattr(bpe, "PAIRS", 3)  # pairs push each other out of the memory
    c = bpe.Codec(word_vocabulary(), text=True)
    assert c.encode_words(words) == [c.exact(w) for w in c.spell(words)]


def test_every_code_point_as_the_library():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(word_vocabulary())
    points = [p for p in range(0x30000) if not 0xD800 <= p < 0xE000] + list(range(0xE0000, 0xE0200)) + [0x10FFFF]
    texts = [" ".join(f"a{chr(p)}b {chr(p)}1" for p in points[i : i + 16]) for i in range(0, len(points), 16)]
    texts += [f"e{chr(p)}\u0323\u0301x" for p in range(0x300, 0x370)] + ["ΑΣ ΣΑΣ.", "İstanbul ǅ ﬁ ß ẞ", "\u1100\u1161\u11a8", "한국어 日本語 ไทย हिन्दी", "a\u200db\ufeffc\x1c\x85d"]
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    for text in (True, False):
        c = bpe.Codec(word_vocabulary(), text=text)
        for t, parts, ids in zip(texts, c.encode_many(texts), want, strict=True):
            got = " ".join(p[1] for p in parts) if text else b"".join(parts)
            assert got == (" ".join(map(str, ids)) if text else np.array(ids, "<u4").tobytes()), t


def test_decoding_as_the_library(docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(word_vocabulary())
    for r in bpe.encode(docs, word_vocabulary()).collect():
        assert r["decoded"] == lib.decode(r["token_ids"], skip_special_tokens=False)
        assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_minhash(spark, docs, empty, k, percent):
    base = sentence(60).split()
    texts = TEXTS + [" ".join(w if random.random() > 0.02 * (i % 8) else "q%d" % random.randrange(99) for w in base) for i in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)) + [(0, None), (None, "no id")], "doc_id long, text string")
    sets = [shingle_set(t, k) for t in texts]
    label = list(range(len(texts)))
    moved = True
    while moved:
        moved = False
        for a in range(len(texts)):
            for b in range(a):
                both = len(sets[a] & sets[b])
                if both and 100 * both >= percent * len(sets[a] | sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    moved = True
    got = minhash.near_duplicates(rows, k, percent, bands=32).collect()
    assert len(got) == len(texts) + 2  # a row for each row
    for r in got:
        if r["doc_id"] is None:
            assert r["kept"] and r["component_id"] is None
        else:
            i = r["doc_id"]
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), label[i], label[i] == i)
    assert minhash.near_duplicates(empty).count() == 0


def test_minhash_with_repeated_ids_and_null_ids(spark):
    a, b, c = sentence(50), sentence(50), sentence(50)
    rows = [(3, a), (5, a), (5, b), (5, c), (7, b), (9, a + " z"), (9, a + " z"), (None, a), (None, a), (2, None), (2, ""), (4, None)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert len(got) == len(rows)
    told = collections.defaultdict(set)
    for r in got:
        told[r["doc_id"], r["text_key"]].add((r["component_id"], r["kept"], r["n_shingles"] > 0))
    key = lambda x: spark.range(1).select(F.xxhash64(F.lit(x))).first()[0]
    assert told[3, key(a)] == {(3, True, True)} and told[5, key(a)] == {(3, False, True)} and told[9, key(a + " z")] == {(3, False, True)}
    assert told[5, key(b)] == {(5, True, True)} and told[7, key(b)] == {(5, False, True)}  # this text is no copy of document 3's
    assert told[5, key(c)] == {(5, True, True)} and told[None, key(a)] == {(None, True, True)}
    assert all(kept and c == i for (i, _), v in told.items() if i in (2, 4) for c, kept, _ in v)


def test_minhash_of_a_crowded_bucket(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CROWD", 8)  # blocks of a bucket meet two by two
    base = sentence(60).split()
    texts = [" ".join(w if random.random() > 0.03 * (i % 6) else "q%d" % random.randrange(30) for w in base) for i in range(80)]
    sets = [shingle_set(t, 3) for t in texts]
    label = list(range(80))
    for _ in range(80):
        for i in range(80):
            for j in range(80):
                if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, 85).collect()}
    assert got == dict(enumerate(label)) and 1 < len(set(label)) < 80


def test_components(spark):
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(200)] + [(5, 5), (None, 3)]
    got = {r["id"]: r["component_id"] for r in graph.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    label = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            if a in label and b in label and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                moved = True
    assert got == label


def test_language(docs, empty):
    train = docs.unionByName(docs.selectExpr("doc_id + 100 AS doc_id", "text", "lang", "source", "n_chars", "found", "_kept", "key", "spans"))
    model = language.train(train, piece_vocabulary())
    rows = language.predict(docs, model).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        letters = any(c.isalpha() for c in TEXTS[r["doc_id"]] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    assert language.predict(empty, model).count() == 0
    assert {r["lang_pred"] for r in language.predict(docs, language.fit([], piece_vocabulary())).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    pieces = {"a": 0, "b": 1, "ab": 2, "▁a": 3, "▁ab": 4}
    table = np.array([[0.1], [0.2], [0.3], [0.15], [0.05], [0.2], [0.0]])
    ((_, ids),) = language.lattices(["aba"], pieces)
    expect = 0.15 * 0.2 * 0.1 + 0.05 * 0.1
    assert language.forward(ids, table)[3, 0, 0] == pytest.approx(expect)


def test_pieces_find_what_the_vocabulary_has():
    known = language.vocabulary_pieces(piece_vocabulary())
    pieces, get = language.Pieces(known), known.get
    words = sorted({w for t in TEXTS if t for w in language.LETTERS.findall(t.lower())} | {"straßenbahnhaltestellenverwaltung", "x" * 40, "日本語", "a"})
    for places, ids in language.lattices(words, pieces):
        for i, own in zip(places, ids, strict=True):
            w = words[i]
            for a in range(len(w)):
                for k in range(1, min(len(w), pieces.longest) + 1):
                    want = -1 if a + k > len(w) else get("▁" + w[a : a + k], -1) if a == 0 else get(w[a : a + k], -1)
                    if want < 0 and k == 1:
                        want = get(w[0], len(known)) if a == 0 else len(known)
                    assert own[a, k - 1] == want


def brute_log_sum(word, known, table):
    """log of the sum over all segmentations, by language, letter by letter in exact fractions of floats."""
    from fractions import Fraction

    longest = max(len(p.removeprefix("▁")) for p in known)
    out = []
    for column in range(table.shape[1]):
        sums = [Fraction(1)] + [Fraction(0)] * len(word)
        for a in range(len(word)):
            for k in range(1, min(longest, len(word) - a) + 1):
                i = known.get(("▁" if a == 0 else "") + word[a : a + k])
                if i is None and k == 1:
                    i = known.get(word[0], len(known)) if a == 0 else len(known)
                if i is not None:
                    sums[a + k] += sums[a] * Fraction(float(table[i, column]))
        x = sums[-1]
        shift = x.denominator.bit_length() - x.numerator.bit_length()
        out.append(np.log(float(x * 2**shift)) - shift * np.log(2))
    return np.array(out)


def test_labels_and_sums_against_brute_force(spark, monkeypatch):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(80)
    model = language.train(rows, piece_vocabulary())
    known = language.vocabulary_pieces(piece_vocabulary())
    pieces = language.Pieces(known)
    words = ["straßenbahnhaltestellenverwaltungsgesetz", "ab" * 30, "the", "x" * 700, "日本" * 20]
    want = np.array([brute_log_sum(w, known, model.table) for w in words])
    assert np.allclose(language.log_words(words, pieces, model.table), want, rtol=1e-9, atol=1e-9)
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    texts |= {10_000: " ".join(["donaudampfschifffahrtsgesellschaftskapitän"] * 3), 10_001: "1 2 3", 10_002: None}
    got = {r["doc_id"]: r for r in language.predict(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), model).collect()}
    sums = {}
    for i, text in texts.items():
        own = [w for x in (text or "").lower().split() for w in ([x] if x.isalpha() else language.LETTERS.findall(x))][:400]
        if len((text or "").split()) > 400:
            continue
        for w in own:
            if w not in sums:
                sums[w] = brute_log_sum(w, known, model.table)
        if not own:
            assert got[i]["lang_pred"] == "und" and got[i]["score"] == 0
            continue
        total = sum(sums[w] for w in own)
        odds = np.exp((total - total.max()) * min(1.0, language.EVIDENCE / len(own)))
        assert got[i]["lang_pred"] == model.languages[int(total.argmax())] and got[i]["score"] == pytest.approx(1 / odds.sum(), rel=1e-6)


def test_expectation_agrees_for_short_and_long_words(monkeypatch):
    known = {"a": 0, "b": 1, "ab": 2, "▁a": 3, "▁ab": 4, "bab": 5}
    table = np.array([0.1, 0.2, 0.3, 0.15, 0.05, 0.1, 0.1, 0.0]).reshape(-1, 1)
    ids = next(language.lattices(["abababab", "aabbabab"], known))[1]
    plain = language.expected_counts(ids, np.array([2.0, 3.0]), table)
    monkeypatch.setattr(language, "PLAIN", 2)
    assert np.allclose(plain, language.expected_counts(ids, np.array([2.0, 3.0]), table))


def test_held_out_accuracy(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.predict(rows, language.train(rows, piece_vocabulary())).where("held_out").join(rows.select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL")
    n = got.count()
    assert n > 100 and got.where("lang = lang_pred").count() >= 0.99 * n


def test_sample_is_the_least_hashes(spark):
    rows = spark.createDataFrame([(i, "t", "ab"[i % 3 == 0]) for i in range(9000)] + [(None, "t", "a"), (7, "t", None)], "doc_id long, text string, lang string")
    hashed = rows.where("lang IS NOT NULL").select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).collect()
    for n in (1, 50, 20_000):
        got = {(r["doc_id"], r["lang"]) for r in language.sampled(rows.where("lang IS NOT NULL"), n).collect()}
        want = {(r["doc_id"], r["lang"]) for x in "ab" for r in sorted((r for r in hashed if r["lang"] == x), key=lambda r: (r["h"], r["doc_id"] or -1))[:n]}
        assert got == want


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.group().split(".")), "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_personal_data_of_texts_with_very_many_matches(spark):
    text = " ".join(f"x{i}@mail{i}.example.com, 10.2.{i % 250}.{i % 99}" for i in range(700))
    found = personal.detect(spark.createDataFrame([(1, text)], "doc_id long, text string"), keep_text=True)
    (r,) = personal.digest(found).collect()
    assert (r["n_email"], r["n_ip"]) == (700, 700) and r["base_sha256"] == hashlib.sha256(",".join(base_spans(text)).encode()).hexdigest()
    (t,) = found.select(personal.redact(found).alias("t")).collect()
    assert t["t"] == " ".join(["<EMAIL>, <IP>"] * 700)


def test_personal(spark, docs, empty):
    odd = ["".join(random.choice("a1.@-% +0(2") for _ in range(random.randint(0, 60))) for _ in range(300)] + ["1" * 50_000, "a.b@" + "c.d" * 20_000, "é+12 345 678 9 é@é a@b.c"]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    texts = dict(enumerate(TEXTS)) | {1000 + i: t for i, t in enumerate(odd)}
    got = personal.digest(personal.detect(rows)).collect()
    assert len(got) == len(texts)
    for r in got:
        spans = base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(filter(None, r["spans"].split(",")))
    assert personal.detect(empty).count() == 0
    found = personal.detect(docs, keep_text=True)
    text = {r["doc_id"]: r["t"] for r in found.select("doc_id", personal.redact(found).alias("t")).collect()}
    assert text[12] == "mail <EMAIL> or <PHONE> now"


def linked(vecs, least=0.9):
    """Links and components by brute force, over rows (id, vector)."""
    x = np.array([v for _, v in vecs], dtype=np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= least
    np.fill_diagonal(link, False)
    label = np.array([i for i, _ in vecs])
    while True:
        new = np.minimum(label, np.where(link, label[None], np.iinfo(np.int64).max).min(axis=1))
        if np.array_equal(new, label):
            return link.sum(axis=1), label
        label = new


@pytest.mark.parametrize("crowded", [False, True])
def test_vectors(spark, monkeypatch, crowded):
    if crowded:  # cells are then dealt to many blocks and shares
        monkeypatch.setattr(vectors, "MEMBERS", 16)
        monkeypatch.setattr(vectors, "VISITS", 40)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16))
    x = (centres[rng.integers(0, 30, 600)] + rng.normal(size=(600, 16)) * rng.choice([0.05, 0.6], size=(600, 1))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(600 + k, x[0].tolist()) for k in range(5)]
    odd = [(701, None), (702, [0.0] * 16), (703, [float("nan")] * 16), (704, [1.0, 0.0]), (705, [2.0, 0.0]), (706, []), (None, x[1].tolist()), (707, [1.0] * 15 + [None])]
    table = spark.createDataFrame([(*r, 1, 1, 1, 1) for r in rows + odd], "vec_id long, embedding array<float>, id int, n int, cell int, usable int")
    got = vectors.near_duplicates(table).collect()
    assert len(got) == len(rows) + len(odd)
    n, component = {r["vec_id"]: r["n_links"] for r in got}, {r["vec_id"]: r["component_id"] for r in got}
    links, label = linked(rows)
    assert all(n[i] <= links[k] for k, (i, _) in enumerate(rows)) and sum(n[i] for i, _ in rows) >= 0.995 * links.sum()
    right = sum(component[i] == label[k] for k, (i, _) in enumerate(rows))
    assert right >= 0.99 * len(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got if r["vec_id"] is not None)
    assert n[701] == n[702] == n[703] == n[706] == n[707] == n[None] == 0 and n[704] == n[705] == 1 and component[705] == 704
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_vectors_of_one_id_and_few_rows(spark):
    a, b, far = [1.0, 0.1, 0.0, 0.0], [1.0, 0.2, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0]
    rows = [(1, a), (1, b), (1, a), (2, far), (0, far), (5, b), (9, [-1.0, 0.0, 0.0, 0.0])]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert got == [(0, 1, 0, True), (1, 3, 1, True), (1, 3, 1, True), (1, 3, 1, True), (2, 1, 0, False), (5, 3, 1, False), (9, 0, 9, True)]
    one = vectors.near_duplicates(spark.createDataFrame([(4, [3.0])], "vec_id long, embedding array<double>")).collect()
    assert [tuple(r) for r in one] == [(4, 0, 4, True)]


def test_vectors_of_a_test_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()]
    links, label = linked(rows)
    got = {r["vec_id"]: r for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert sum(got[i]["n_links"] for i, _ in rows) >= 0.99 * links.sum() and sum(got[i]["component_id"] == label[k] for k, (i, _) in enumerate(rows)) >= 0.99 * len(rows)


def without_repeats(texts, width):
    """(id, words, removed, kept) by brute force for rows (id or None, text)."""
    first, out = {}, []
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in texts]
    for (i, _), w in zip(texts, split):
        for a in range(len(w) - width + 1):
            key = tuple(w[a : a + width])
            first[key] = min(first.get(key, 10**12), 10**12 if i is None else i)
    for (i, _), w in zip(texts, split):
        gone = set()
        for a in range(len(w) - width + 1):
            if first[tuple(w[a : a + width])] < (10**12 if i is None else i):
                gone.update(range(a, a + width))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for a, x in enumerate(w) if a not in gone).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("width", "fan", "marked"), [(5, 4096, 1 << 20), (13, 4096, 2), (13, 2, 1 << 20), (50, 4096, 1 << 20)])
def test_substrings(spark, docs, empty, monkeypatch, width, fan, marked):
    monkeypatch.setattr(substrings, "FAN", fan)  # with a small one, windows are dealt in two steps
    monkeypatch.setattr(substrings, "MARKED", marked)  # with a few, all texts are shuffled
    rows = list(enumerate(TEXTS)) + [(None, BASE), (None, BASE), (7, BASE + " and more " + sentence(40)), (7, sentence(60)), (100, "a " * 70_000), (101, "b " + "a " * 300 + "c " + BASE)]
    table = docs.sparkSession.createDataFrame([(i, t, 1, 1, 1) for i, t in rows], "doc_id long, text string, _part int, found int, text_key int").repartition(5)
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.remove(table, width).collect()), key=repr)
    assert got == without_repeats(rows, width)
    assert substrings.remove(empty).count() == 0


def test_substrings_of_a_test_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = substrings.remove(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), 13, texts=False).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=repr) == without_repeats(rows, 13)


def test_hot_leaders_change_nothing(spark, monkeypatch):
    common = " ".join(["the of and"] * 30)
    rows = [(i, f"{sentence(5)} {common} {sentence(12 + i % 3)}") for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(substrings, "SAMPLED", 1)
    hot = substrings.hot_leaders(substrings.keyed(table, "doc_id", "text"), 13, 64)
    assert len(hot)
    want = without_repeats(rows, 13)
    for choose in (substrings.hot_leaders, lambda docs, width, parts: np.zeros(0, np.uint64)):
        monkeypatch.setattr(substrings, "hot_leaders", choose)
        got = substrings.remove(table, 13).collect()
        assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=repr) == want


def test_leading_symbols_get_longer_with_the_rounds():
    rng = np.random.default_rng(4)
    words = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    s = substrings.words_as_symbols(words, np.zeros(4000, np.int64))
    sizes = []
    for level in range(substrings.rounds_for(50)):
        s = substrings.name_pairs(substrings.name_runs(s, level), level)
        sizes.append((s.last - s.first).mean())
        assert (np.diff(s.low) >= 0).all() and (np.diff(s.high) >= 0).all() and (s.last[:-1] == s.first[1:]).all()
    assert all(b > 1.2 * a for a, b in zip(sizes, sizes[1:])) and sizes[-1] > 50 / 4


def test_least_key_inside_windows():
    rng = np.random.default_rng(7)
    low = np.sort(rng.integers(-1, 60, 40))
    high = np.maximum.accumulate(low + rng.integers(1, 9, 40))
    key = rng.integers(1, 2**40, 40).astype(np.uint64)
    for width in (3, 13):
        got = substrings.least_inside(key, low, high, 50, width)
        for w in range(50):
            inside = [int(k) for k, a, b in zip(key, low, high) if a >= w and b <= w + width]
            assert int(got[w]) == (min(inside) if inside else int(substrings.TOP))


def test_equal_windows_have_equal_leaders():
    for alphabet in (1, 2, 5, 30):
        base = [str(random.randrange(alphabet)) for _ in range(50)]
        texts = [" ".join([str(random.randrange(alphabet)) for _ in range(random.randrange(9))] + base[random.randrange(20) :]) for _ in range(60)]
        seen = {}
        for b in substrings.blocks(pa.array(texts)):
            for r, p, lead, mark in zip(*(x.tolist() for x in substrings.windows(b, 13)), strict=True):
                key = tuple(texts[b.first + r].split()[p : p + 13])
                assert seen.setdefault(key, (lead, mark)) == (lead, mark)


def test_jpeg(docs, empty):
    media = jpeg.store(docs)
    for r in jpeg.digest(media).collect():
        raw = (TEXTS[r["doc_id"]] or "").encode()
        p = raw + b"\xff" * (-len(raw) % 576 or (576 if not raw else 0))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    size = {r["doc_id"]: r for r in jpeg.tensors(media).collect()}
    assert all(len(r["rgb"]) == r["width"] * r["height"] * 3 for r in size.values())
    assert jpeg.digest(jpeg.store(empty)).count() == 0


def java_jpeg(spark, rgb, subsampled=True):
    """(progressive JPEG of an image, the RGB that the JVM's own decoder reads from it)."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    height, width = rgb.shape[:2]
    image = jvm.java.awt.image.BufferedImage(width, height, jvm.java.awt.image.BufferedImage.TYPE_INT_RGB)
    flat = gateway.new_array(jvm.int, width * height)
    values = (rgb[..., 0].astype(int) << 16 | rgb[..., 1].astype(int) << 8 | rgb[..., 2]).ravel()
    for i, v in enumerate(values.tolist()):
        flat[i] = v
    image.setRGB(0, 0, width, height, flat, 0, width)
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    params = writer.getDefaultWriteParam()
    params.setProgressiveMode(jvm.javax.imageio.ImageWriteParam.MODE_DEFAULT)
    out = jvm.java.io.ByteArrayOutputStream()
    writer.setOutput(jvm.javax.imageio.ImageIO.createImageOutputStream(out))
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), params)
    writer.getOutput().flush()
    raw = bytes(out.toByteArray())
    back = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(raw))
    told = back.getRGB(0, 0, width, height, None, 0, width)
    got = np.array([told[i] & 0xFFFFFF for i in range(width * height)]).reshape(height, width)
    return raw, np.stack([got >> 16, got >> 8 & 255, got & 255], axis=-1)


def test_jpeg_of_another_writer(spark):
    """Progressive files of the JVM's encoder: several scans, subsampled chroma, runs of blocks without coefficients, sizes that fill no block."""
    rng = np.random.default_rng(2)
    for height, width in ((16, 16), (61, 45), (40, 72)):
        y, x = np.mgrid[:height, :width]
        rgb = np.stack([x * 255 // width, y * 255 // height, (x + y) * 255 // (height + width)], axis=-1)
        rgb[: height // 3, : width // 3] = rng.integers(0, 256, (height // 3, width // 3, 3))  # flat elsewhere: runs of empty blocks
        raw, want = java_jpeg(spark, rgb)
        assert raw.count(b"\xff\xda") > 3
        w, h, parts, quant, _ = jpeg.read_coefficients(raw)
        assert (w, h) == (width, height)
        got = jpeg.to_rgb(w, h, parts, quant).astype(int)
        if all((c.h, c.v) == (parts[0].h, parts[0].v) for c in parts):
            assert np.abs(got - want).max() <= 3
        else:  # decoders differ in how they smooth chroma between samples
            assert np.abs(got - want).mean() < 6 and np.abs(got.mean(axis=-1) - want.mean(axis=-1)).mean() < 3
        (row,) = jpeg.tensors(spark.createDataFrame([(1, bytearray(raw))], "doc_id long, media binary")).collect()
        assert (row["width"], row["height"]) == (width, height) and np.array_equal(np.frombuffer(bytes(row["rgb"]), np.uint8).reshape(height, width, 3), got)


def direct_samples(coefficients, quant):
    """A block's samples by the definition of the inverse transform."""
    natural = np.zeros(64)
    natural[jpeg.ZIGZAG] = coefficients * quant
    s = natural.reshape(8, 8)
    out = np.zeros((8, 8))
    for y in range(8):
        for x in range(8):
            for v in range(8):
                for u in range(8):
                    cu, cv = (np.sqrt(0.5) if u == 0 else 1), (np.sqrt(0.5) if v == 0 else 1)
                    out[y, x] += cu * cv / 4 * s[v, u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16)
    return out + 128


def test_jpeg_samples_chroma_and_feature(spark):
    rng = np.random.default_rng(6)
    luma, chroma = jpeg.Component(2, 2, 0), jpeg.Component(1, 1, 1)
    quant = {0: rng.integers(1, 20, 64), 1: rng.integers(1, 20, 64)}
    luma.coefficients, chroma.coefficients = rng.integers(-9, 9, (2, 2, 64)), rng.integers(-9, 9, (1, 1, 64))
    for c in (luma, chroma):
        got = jpeg.plane(c, quant[c.table])
        for i in range(c.coefficients.shape[0]):
            for j in range(c.coefficients.shape[1]):
                assert np.allclose(got[8 * i : 8 * i + 8, 8 * j : 8 * j + 8], direct_samples(c.coefficients[i, j], quant[c.table]))
    rgb = jpeg.to_rgb(13, 11, [luma, chroma, chroma], quant)
    y, b = (np.clip(np.rint(jpeg.plane(c, quant[c.table])), 0, 255) for c in (luma, chroma))
    for row, col in ((0, 0), (10, 12), (5, 8)):
        cb = b[row // 2, col // 2] - 128
        want = [y[row, col] + 1.402 * cb, y[row, col] - 0.344136 * cb - 0.714136 * cb, y[row, col] + 1.772 * cb]
        assert rgb[row, col].tolist() == np.clip(np.rint(want), 0, 255).astype(int).tolist()
    texts = ["", "abc", "é" * 900, "abc", None]
    media = jpeg.store(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).cache()
    tensors = {r["doc_id"]: r for r in jpeg.tensors(media).collect()}
    told = {r["doc_id"]: r for r in jpeg.digest(media).collect()}
    for i, r in told.items():
        t = tensors[i]
        x = np.frombuffer(bytes(t["rgb"]), np.uint8).reshape(t["height"], t["width"], 3).astype(int)
        n = t["width"] * t["height"]
        means = [int(x[..., k].sum()) // n for k in range(3)]
        assert r["feature"] == f"{t['width']}x{t['height']}:{means[0]},{means[1]},{means[2]}:{int(np.abs(np.diff(x[..., 1], axis=1)).sum()) // n}"
    assert told[1]["feature"] == told[3]["feature"] and told[0]["media_sha256"] == told[4]["media_sha256"]


def test_damaged_and_foreign_media(spark):
    whole = jpeg.write_payload(jpeg.padded(b"x" * 2000), jpeg.NOTE + b"2000")
    rows = [(1, None), (2, b""), (3, b"GIF89a"), (4, whole[: len(whole) // 3]), (5, whole), (None, whole), (6, b"\xff\xd8\xff\xc2")]
    table = spark.createDataFrame([(i, None if x is None else bytearray(x), 1) for i, x in rows], "doc_id long, media binary, width int")
    got = {r["doc_id"]: r for r in jpeg.tensors(table).collect()}
    assert len(got) == len(rows) and got[5]["rgb"] is not None and got[None]["rgb"] == got[5]["rgb"] and all(got[i]["rgb"] is None for i in (1, 2, 3, 6))
    told = {r["doc_id"]: r for r in jpeg.digest(table).collect()}
    assert told[5]["n_bytes"] == 2000 and all(told[i]["n_bytes"] is None for i in (1, 2, 3, 6))


def test_jpeg_fixed_stride_and_code_by_code_agree(monkeypatch):
    payload = random.randbytes(576 * 4)
    raw = jpeg.write_payload(payload, b"")
    fast = [c.coefficients for c in jpeg.read_coefficients(raw)[2]]
    slow_table = jpeg.huffman

    def more(counts, symbols):  # a code that never comes keeps a table from being a single code's
        return slow_table(counts, symbols) | {(16, 0xFFFE): 0x11}

    monkeypatch.setattr(jpeg, "huffman", more)
    slow = [c.coefficients for c in jpeg.read_coefficients(raw)[2]]
    assert all((a == b).all() for a, b in zip(fast, slow, strict=True))


def test_licenses(docs, empty):
    got = {r["doc_id"]: r["matches"] for r in licenses.scan(docs).collect()}
    assert len(got) == len(TEXTS)
    (m,) = got[16]
    assert (m["license"], TEXTS[16][m["start"] : m["end"]], m["matched"], m["words"]) == ("MIT", "Released under the MIT License", 5, 5)
    assert all(not v for k, v in got.items() if k != 16)
    assert licenses.scan(empty).count() == 0


def test_license_alignment(spark):
    long = licenses.TEMPLATES["MIT-text"]
    words = long.split()
    changed = "é " + " ".join(w for i, w in enumerate(words) if i % 17 != 5) + " end"
    (r,) = licenses.scan(spark.createDataFrame([(1, changed)], "doc_id long, text string")).collect()
    (m,) = r["matches"]
    assert m["license"] == "MIT-text" and changed[m["start"] : m["end"]].startswith("Permission") and 0.85 * m["words"] < m["matched"] < m["words"]


def full_alignment(template, text):
    """(score, matched words) of the best alignment by a full dynamic programme over pairs of matches."""
    best, cell = (-(10**9), 0), {}
    for i in range(len(template)):
        for j in range(len(text)):
            if template[i] == text[j]:
                cell[i, j] = max([(1 - i, 1)] + [(s + 1 - max(i - a - 1, j - b - 1), k + 1) for (a, b), (s, k) in cell.items() if a < i and b < j])
                best = max(best, cell[i, j])
    return best


def test_alignment_against_a_full_programme():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n, m = rng.integers(1, 9), rng.integers(1, 12)
        template, text = rng.integers(1, 5, n).astype(np.uint64), rng.integers(1, 5, m).astype(np.uint64)
        band = int(n + m)
        matched, first, end = licenses.align(template, np.concatenate([np.zeros(band, np.uint64), text]), band)
        score, most = full_alignment(template.tolist(), text.tolist())
        assert matched == (most if score > -(10**9) else 0), (template, text)
        assert not matched or (text[first - band] in template and text[end - 1 - band] in template)


def test_every_template_is_found_whole_and_damaged(spark):
    assert len(licenses.TEMPLATES) >= 50 and sum(k.endswith("-text") for k in licenses.TEMPLATES) >= 25
    rng = random.Random(8)
    rows, names = [], sorted(licenses.TEMPLATES)
    for i, name in enumerate(names):
        words = licenses.TEMPLATES[name].split()
        rows.append((2 * i, "é lead " + licenses.TEMPLATES[name] + " tail words"))
        keep = [w for w in words if rng.random() > 0.08] if len(words) > 20 else words
        rows.append((2 * i + 1, "x y " + " ".join(keep)))
    got = {r["doc_id"]: r["matches"] for r in licenses.scan(spark.createDataFrame([*rows, (None, "All rights reserved"), (None, None)], "doc_id long, text string").repartition(6)).collect() if r["doc_id"] is not None}
    alike = {"BSD-3-Clause-UC-text": {"BSD-3-Clause-text"}, "MPL-2.0": {"MPL-2.0-header"}}
    for i, name in enumerate(names):
        for k in (2 * i, 2 * i + 1):
            found = {m["license"] for m in got[k]}
            assert name in found or found & alike.get(name, set()), (name, k % 2, found)
        whole = next((m for m in got[2 * i] if m["license"] == name), None)
        assert whole is None or whole["matched"] == whole["words"]


@pytest.mark.parametrize("text", ["Released under MIT License", "released under the mit licence", "Licensed under CC BY SA 4 0", "Redistribution, use in source and binary forms, with or without modification, are permitted provided that the conditions are met"])
def test_short_notices_with_an_error(spark, text):
    """Every alignment with the share COVERAGE of a short template's words is a candidate."""
    own = re.findall("[a-z0-9]+", text.lower())
    want = {n for n, t in licenses.TEMPLATES.items() if len(w := re.findall("[a-z0-9]+", t.lower())) <= 24 and full_alignment(w, own)[1] >= licenses.COVERAGE * len(w)}
    (r,) = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert want and {m["license"] for m in r["matches"]} <= want and r["matches"]


def test_near_relatives_are_told_apart(spark):
    rows = [(i, licenses.TEMPLATES[n]) for i, n in enumerate(("LGPL-3.0-header", "AGPL-3.0-header", "GPL-2.0-header", "GPL-3.0-header", "BSD-2-Clause-text", "MIT-0-text", "LGPL-2.1-header"))]
    got = {r["doc_id"]: [m["license"] for m in r["matches"]] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i][0] for i in range(7)] == ["LGPL-3.0-header", "AGPL-3.0-header", "GPL-2.0-header", "GPL-3.0-header", "BSD-2-Clause-text", "MIT-0-text", "LGPL-2.1-header"]


def test_warc(spark):
    rows = [(i, f"http://x/{i}", "body é" * (i % 7)) for i in range(500) if i % 11] + [(3, "http://x/3", "again"), (None, None, None), (None, "u", "v")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    theirs = second_replica(pages).unionByName(spark.createDataFrame([(9999, "u", "extra")], "page_id long, url string, html string"))
    got = warc.audit(pages, theirs).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        i = r["page_id"]
        want = "extra" if i == 9999 else "ok" if i is None else "missing" if i % 389 == 7 else "corrupt" if i % 97 == 13 else "ok"
        assert r["status"] == want
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.audit(none, none).count() == 0
    assert {r["status"] for r in warc.audit(pages, none).collect()} == {"missing"} and {r["status"] for r in warc.audit(none, pages).collect()} == {"extra"}
    raw = "".join(r[0] for r in pages.where("page_id IS NOT NULL").orderBy("page_id").select(warc.warc_record(pages["page_id"], pages["url"], pages["html"])).collect()).encode()
    assert warc.read_archives(spark.createDataFrame([("a", raw)], "path string, content binary")).count() == len(rows) - 2


def test_warc_of_scattered_ids_and_clashing_columns(spark):
    draw = random.Random(4)
    ids = [draw.randrange(-(2**62), 2**62) for _ in range(300)] + [-5, 0, 7]
    rows = [(i, f"u{i}", "é" * (k % 5), k, k) for k, i in enumerate(ids)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, node long, status long")
    hurt = {ids[10]: "x", ids[200]: None}
    theirs = spark.createDataFrame([(i, u, hurt.get(i, h)) for i, u, h, *_ in rows if i != ids[50]], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.audit(pages, theirs).collect()}
    size = {i: len((f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: {u}\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Type: text/html\r\nContent-Length: {len(h.encode())}\r\n\r\n{h}\r\n\r\n").encode()) for i, u, h, *_ in rows}
    at = 0
    for i in sorted(ids):
        want = "missing" if i == ids[50] else "corrupt" if i in hurt and (hurt[i] or "") != dict((r[0], r[2]) for r in rows)[i] else "ok"
        assert (got[i]["offset"], got[i]["n_bytes"], got[i]["status"]) == (at, size[i], want)
        at += size[i]
    a, _ = warc.numbered(warc.records(pages), warc.records(theirs))
    assert len(warc.tree(a)) == 4  # 303 leaves, 19 nodes, 2, 1: whatever gaps the ids have


def test_archives_that_are_cut_off(spark):
    whole = b"WARC/1.0\r\nContent-Length: 3\r\nWARC-Target-URI: u\r\n\r\nabc\r\n\r\n"
    rows = [("a", whole), ("b", whole + whole[:20]), ("c", whole[:-5]), ("d", b""), ("e", None), ("f", whole.replace(b"3", b"x")), ("g", b"no archive")]
    got = warc.read_archives(spark.createDataFrame([(p, None if c is None else bytearray(c)) for p, c in rows], "path string, content binary")).collect()
    assert sorted((r["path"], bytes(r["body"])) for r in got) == [("a", b"abc"), ("b", b"abc"), ("c", b"ab"), ("f", b"")]


def test_null_ids_are_rows_like_any_other(spark):
    text = "mail a@b.cd " + sentence(30)
    table = spark.createDataFrame([(None, text), (None, text), (None, None), (1, text)], "doc_id long, text string")
    packed = packing.pack(table, word_vocabulary(), 64).collect()
    assert collections.Counter(r["doc_id"] for r in packed if r["piece"] == 0) == {None: 3, 1: 1}
    assert sum(r["length"] for r in packed) == 3 * (len(ids_of(text)) + 1) + 1
    encoded = bpe.encode(table, word_vocabulary()).collect()
    assert collections.Counter(r["doc_id"] for r in encoded) == {None: 3, 1: 1} and {r["n_tokens"] for r in encoded} == {0, len(ids_of(text))}
    found = personal.digest(personal.detect(table)).collect()
    assert sorted((r["doc_id"] or 0, r["n_email"]) for r in found) == [(0, 0), (0, 1), (0, 1), (1, 1)]
    assert jpeg.digest(jpeg.store(table)).count() == 4 and licenses.scan(table).count() == 4
    predicted = language.predict(table, language.train(table.withColumn("lang", F.lit("en")), piece_vocabulary())).collect()
    assert len(predicted) == 4 and not any(r["held_out"] for r in predicted if r["doc_id"] is None)


def test_pipeline(spark, docs):
    import corpus_pipeline as p

    given = docs.select("doc_id", "text", "lang", "source", "n_chars")
    stages = dict(p.STAGES)
    assert len(stages) == 5
    kept = stages["language ID"](spark, given, "")
    assert {r["doc_id"] for r in kept.collect()} >= {3, 4, 5, 12} and not {r["doc_id"] for r in kept.collect()} & {0, 1, 2}
    one = stages["MinHash near-dedup"](spark, kept, "")
    assert {5} <= {r["doc_id"] for r in one.collect()} and not {r["doc_id"] for r in one.collect()} & {6, 7, 8}
    cut = {r["doc_id"]: r for r in stages["substring dedup"](spark, one, "").collect()}
    assert len(cut[9]["text"].split()) == 70 and cut[9]["n_chars"] == len(cut[9]["text"])
    red = {r["doc_id"]: r["text"] for r in stages["personal data"](spark, one, "").collect()}
    assert "<EMAIL>" in red[12] and red[5] == BASE
    assert stages["best-fit packing"](spark, one, "").count() >= len(red)
