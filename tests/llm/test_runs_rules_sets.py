"""Periodic runs, quality rules and basket itemsets on small tables with nulls, ties, repeated rows and clashing columns, against brute force."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import baskets, periods, quality, queries, substrings
from corpusloom.llm.queries import OP13_SQL, op13_basket_itemsets

SF = "/root/testdata/sf0.01"
WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, source string, found int, part int, lines int, words int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            if i + q - s >= max(6, 4 * q):
                found.setdefault((s, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def brute_row(doc_id, text, plant=True):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *head, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_of_random_words():
    rng = random.Random(1)
    for _ in range(400):
        n, kinds = rng.randrange(200), rng.choice([1, 2, 3, 20])
        w = [rng.randrange(kinds) for _ in range(n)]
        for _ in range(rng.randrange(3) if n else 0):
            a = rng.randrange(n)
            p = rng.randrange(1, max(2, (n - a) // 3 + 1))
            for i in range(a, rng.randrange(a, n) + 1):
                w[i] = w[a + (i - a) % p]
        x = np.array(w, dtype=np.uint64)
        assert list(map(tuple, periods.runs(x).tolist())) == brute_runs(w)
        cut = rng.randrange(1, n // 4 + 2)
        assert sorted(map(tuple, [*periods.runs(x, 1, cut).tolist(), *periods.runs(x, cut).tolist()])) == brute_runs(w)
    long_ = np.array([rng.randrange(3) for _ in range(700)] + [5] * 900 + list(range(100)) * 9 + [7] * 3, dtype=np.uint64)
    assert list(map(tuple, periods.runs(long_).tolist())) == brute_runs(long_.tolist())


TEXTS = [None, "", " \n\t", "a", "a a a a a", "a a a a a a", "x a b a b a b a b a y", "a b a b a b a b", "ä " * 40, "one two three " * 30 + "tail", "é x y\x0bz", "q " + "w " * 7 + "e " * 9, "the cat sat " * 3]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    texts = TEXTS + [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(400))) for _ in range(60)]
    rows = [(i, t, "s", 1, 1, 1, 1) for i, t in enumerate(texts)] + [(None, "z " * 20, None, 1, 1, 1, 1), (5, TEXTS[5], "s", 1, 1, 1, 1), (5, "k " * 9, "s", 1, 1, 1, 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def test_collapsed_runs(spark, docs):
    want = sorted((brute_row(r.doc_id, r.text) for r in docs.collect()), key=str)
    assert sorted(map(tuple, periods.collapse(docs, plant=True).collect()), key=str) == want
    assert sorted(map(tuple, periods.collapse(docs, plant=True, long_bytes=100).collect()), key=str) == want  # lags dealt out
    assert sorted(map(tuple, periods.collapse(docs).collect()), key=str) == sorted((brute_row(r.doc_id, r.text, plant=False) for r in docs.collect()), key=str)
    assert periods.collapse(spark.createDataFrame([], SCHEMA), plant=True).count() == 0


def brute_counts(text):
    t = text or ""
    words = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    seen = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    twice = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(twice)


def test_quality_counts(spark, docs):
    extra = spark.createDataFrame([(900 + i, t, "s", 1, 1, 1, 1) for i, t in enumerate(["#a|b <c>\r\n\x0b#a|b <c>\r\n", "x\n x\nx\n\n\n", "😀 é é\n😀 é é", "a b c a b c a b c d", "x y z\x0cx y z"])], SCHEMA)
    every = docs.unionByName(extra)
    got = sorted((r.doc_id, *tuple(r)[1:6]) for r in quality.judge(every).collect() if r.doc_id is not None)
    assert got == sorted((r.doc_id, *brute_counts(r.text)) for r in every.collect() if r.doc_id is not None)
    assert quality.judge(spark.createDataFrame([], SCHEMA)).count() == 0


def test_frequent_lines_are_removed(spark):
    rng = random.Random(3)

    def body(n):
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))

    rows = []
    for i in range(60):
        host = "h" if i < 40 else None if i < 50 else "k"
        boiler = "Share this: Page!" if i % 2 else "share  THIS page"  # equal once normalised
        rows.append((i, f"{boiler}\n{body(60)}\n{boiler}", host, 1, 1, 1, 1))
    shared = body(70)
    rows += [(100 + i, f"{shared}\n{body(3)}", "h", 1, 1, 1, 1) for i in range(12)]  # little is left of these
    rows += [(200 + i, f"{shared}\n{body(3)}", "far", 1, 1, 1, 1) for i in range(5)]  # not above the limit there
    rows.append((300, "a b c " * 40, "h", 1, 1, 1, 1))
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i in range(60):
        assert got[i].kept and got[i].n_removed == (6 if i < 40 else 0)
    assert all(not got[100 + i].kept and got[100 + i].n_removed == 70 and not got[100 + i].base_failed for i in range(12))
    assert all(got[200 + i].kept for i in range(5)) and got[300].base_failed and not got[300].kept
    by_shuffle, quality.BROADCAST_LINES = quality.BROADCAST_LINES, -1
    try:
        assert {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()} == got
    finally:
        quality.BROADCAST_LINES = by_shuffle


def test_quality_runs_no_python(docs):
    plan = quality.judge(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def brute_sets(lines, least=12, share=10_000, confidence=30):
    by = collections.defaultdict(set)
    for s, i in lines:
        if s is not None and i is not None:
            by[s].add(i)
    bound, tids = max(least, -(-len(by) // share)), collections.defaultdict(set)
    for s, x in by.items():
        for i in x:
            tids[i].add(s)
    level = {(i,): t for i, t in tids.items() if len(t) >= bound}
    names, every = sorted(i for (i,) in level), {}
    while level:
        every |= level
        level = {x + (i,): u for x, t in level.items() for i in names if i > x[-1] and len(u := t & tids[i]) >= bound}
    out = []
    for x, t in every.items():
        if any(i not in x and t <= tids[i] for i in names):
            continue
        rules = [(c, a, s) for c in x if len(x) > 1 for a, s in [(len(every[tuple(y for y in x if y != c)]), len(tids[c]))] if 100 * len(t) >= confidence * a and len(t) * len(by) > a * s]
        best = min(rules, key=lambda r: (r[1], r[0]))[0] if rules else None
        out.append((",".join(map(str, x)), len(x), len(t), len(rules), best, sha(";".join("%d:%d:%d" % r for r in rules))))
    return sorted(out)


def random_lines(seed):
    rng = random.Random(seed)
    lines = [(s, 100 + i * 5 % 14) for s in range(80) for i in range(14) if rng.random() < (i + 1) / 20]
    lines += [(s, 100 + i) for s in range(80, 90) for i in (1, 3, 5, 7)]
    return lines + [(None, 5), (3, None), (91, 4)] + lines[:20]


@pytest.mark.parametrize("limits", [{}, {"WIDE": 4, "ROOTS": 3}, {"CLASS_ROWS": 10}, {"CLASS_ROWS": 3, "WIDE": 3, "ROOTS": 2, "BROADCAST_BYTES": 0, "BROADCAST_ITEMS": 0}])
def test_closed_sets_and_rules(spark, monkeypatch, limits):
    """Also with wide baskets counted in matrices, classes split, and tables not broadcast."""
    for name, value in limits.items():
        monkeypatch.setattr(baskets, name, value)
    lines = random_lines(4)
    got = baskets.frequent_sets(spark.createDataFrame([(*x, 1, 1, "q") for x in lines], "sale_id long, item_id long, k int, w int, items string"), least=8)
    want = brute_sets(lines, least=8)
    assert len(want) > 50 and sorted(map(tuple, got.collect())) == want


def test_sets_of_nothing(spark):
    none = spark.createDataFrame([(None, 1), (1, None)], "sale_id long, item_id long")
    assert baskets.frequent_sets(none).count() == 0
    single = spark.createDataFrame([(i, 7) for i in range(20)], "sale_id long, item_id long")
    assert [tuple(r) for r in baskets.frequent_sets(single).collect()] == [("7", 1, 20, 0, None, sha(""))]


def test_sets_of_the_table(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW sale_lines AS SELECT * FROM '{SF}/sale_lines.parquet'")
    want = sorted(con.execute(OP13_SQL).fetchall())
    assert sorted(map(tuple, op13_basket_itemsets(spark, SF).select("items", "n_items", "support", "n_rules", "best_item", "rules_sha256").collect())) == want
    rows = con.execute("SELECT sale_id, item_id FROM sale_lines WHERE flag IS DISTINCT FROM 'returned'").fetchall()
    assert want == brute_sets(rows)


@pytest.mark.parametrize("name", ["op3_minhash_near_dedup", "op6_embedding_near_dedup", "op7_substring_dedup", "op11_periodic_runs", "op12_quality_rules"])
def test_rows_of_the_tables(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in found.description]
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(found.fetchall())


def test_repeats_of_the_greatest_id(spark):
    """The greatest 64-bit number is an id like any other; rows without one come after it."""
    text = " ".join(f"w{i}" for i in range(20))
    top, low = 2**63 - 1, -(2**63)
    for ids in ([1, top], [low, top, None], [low, 5, None], [top, None]):
        rows = spark.createDataFrame([(i, text) for i in ids], "doc_id long, text string")
        got = {r.doc_id: r.n_removed for r in substrings.remove(rows).collect()}
        assert got == {i: 0 if i == ids[0] else 20 for i in ids}


def test_settled_ranges_are_dealt_out(spark):
    rng = random.Random(5)
    same = " ".join(rng.choice("abcdefghijkl") * 3 for _ in range(60))
    table = [(i, same + " " + " ".join(f"{i}-{k}" for k in range(40))) for i in range(3000)]
    batch = spark.createDataFrame(table, "doc_id long, text string").repartition(16)
    sent = substrings.keyed(batch, "doc_id", "text").mapInArrow(lambda it: substrings._sent(it, 13, 64, 64, np.zeros(0, np.uint64), False), f"part int, {substrings.PACKET_SCHEMA}, settled binary")
    parts = sent.where(F.octet_length("settled") > 0).groupBy("part").count().collect()
    assert len(parts) >= 8 and max(r["count"] for r in parts) <= 5
