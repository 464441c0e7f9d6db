"""Closed frequent itemsets of baskets, and rules from them.

Items are ranked by support, rare ones first. The class of a prefix (at first of one item, the class's root) holds what is left of the
baskets with it: the items that are often with it, equal remainders as one row with a weight. Classes are mined apart, each in one
task, with a packed bitmap an item: a generator, a closed set and one later item, is rejected where an earlier item (of
the pre-set) covers all its baskets, as another branch then finds its closure; else the later items (of the post-set) that cover them
join it. So no result is ever looked up or kept for it.

A frequent item is late in the order and has few items after it, so hot items make small classes. A class of more rows than
one task should hold is split by Spark into those of longer prefixes, in the way in which the first classes were made.
Supports are counted from pairs of items for narrow baskets; wide ones are never unfolded into pairs but sent whole to groups of
roots, where a matrix counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import is_empty, mark_tables, materialise, release, sole
from corpusloom.operators.storage import ranked

LEAST = 12
SHARE = 10_000
"""A frequent itemset is in LEAST baskets and in one of SHARE baskets at least."""
CONFIDENCE = 30
"""Per cent of the baskets with a rule's premise that have its conclusion at least."""
WIDE = 64
"""Baskets of more frequent items are not unfolded into pairs."""
ROOTS = 64
"""Roots of a group that a wide basket is sent to."""
CLASS_ROWS = 1 << 17
CLASS_CELLS = 1 << 21
"""Rows, and items in them, beyond which a class is split."""
BROADCAST_ITEMS = 1 << 18
BROADCAST_BYTES = 8 << 20
"""Tables are broadcast up to so many items and bytes. There are SHARE times the mean size of a basket frequent items at most, however many baskets there are."""


# -- counting ----------------------------------------------------------------------------------


def _of_groups(batches: Iterator[pa.RecordBatch], begin: Callable, pairs: Callable, wide: Callable, end: Callable) -> Iterator[pa.RecordBatch]:
    """Calls for each group of rows (k, g, kind, items, w) sorted by (k, g, kind): begin(k, g), pairs(e, j, w) for pairs of kind 0, wide(items, w) for a basket of kind 1, end()."""
    sole()
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column("k").dictionary_encode()
        names, code = k.dictionary.to_pylist(), k.indices.to_numpy()
        g, kind, w = (batch.column(c).to_numpy() for c in ("g", "kind", "w"))
        lists = batch.column("items")
        at, flat = np.asarray(lists.offsets), lists.values.to_numpy()
        cut = np.flatnonzero((np.diff(code) != 0) | (np.diff(g) != 0) | (np.diff(kind) != 0)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
            mine = (names[code[a]], int(g[a]))
            if mine != now:
                if now is not None:
                    yield from end()
                begin(*mine)
                now = mine
            if kind[a]:
                for i in range(a, b):
                    yield from wide(flat[at[i] : at[i + 1]], int(w[i])) or ()
            else:
                pairs(*flat[at[a] : at[b]].reshape(-1, 2).T, w[a:b])
    if now is not None:
        yield from end()


def _last(k: str) -> int:
    return int(k.rpartition(",")[2]) if k else -1


def _counted(batches: Iterator[pa.RecordBatch], items: int, groups: int, least: int) -> Iterator[pa.RecordBatch]:
    """(k, e, j, n): pairs of a root e and another item j with their support, counted in a matrix of a group's roots."""
    state: dict = {}

    def begin(k: str, g: int) -> None:
        state.update(k=k, g=g, last=_last(k), n=np.zeros((-(-items // groups), items), dtype=np.int64))

    def pairs(e: np.ndarray, j: np.ndarray, w: np.ndarray) -> None:
        np.add.at(state["n"], (e // groups, j), w)

    def wide(basket: np.ndarray, w: int) -> None:
        roots = basket[(basket % groups == state["g"]) & (basket > state["last"])]
        state["n"][np.ix_(roots // groups, basket)] += w

    def end() -> Iterator[pa.RecordBatch]:
        n = state["n"]
        row, j = np.nonzero(n >= least)
        e = row * groups + state["g"]
        row, j, e = row[e != j], j[e != j], e[e != j]
        yield pa.RecordBatch.from_arrays([pa.array([state["k"]] * len(e), pa.string()), pa.array(e, pa.int32()), pa.array(j, pa.int32()), pa.array(n[row, j], pa.int64())], ["k", "e", "j", "n"])

    return _of_groups(batches, begin, pairs, wide, end)


def _restricted(batches: Iterator[pa.RecordBatch], items: int, groups: int) -> Iterator[pa.RecordBatch]:
    """(k, items, w): of wide baskets, for each root of the group that is often with a later item of the basket, the items that are often with it."""
    state: dict = {}

    def begin(k: str, g: int) -> None:
        state.update(k=k, g=g, last=_last(k), often=np.zeros((-(-items // groups), items), dtype=bool))

    def pairs(e: np.ndarray, j: np.ndarray, w: np.ndarray) -> None:
        state["often"][e // groups, j] = True

    def wide(basket: np.ndarray, w: int) -> Iterator[pa.RecordBatch]:
        names, left = [], []
        for e in basket[(basket % groups == state["g"]) & (basket > state["last"])].tolist():
            kept = basket[state["often"][e // groups, basket]]
            if len(kept) and kept[-1] > e:
                names.append(f"{state['k']},{e}" if state["k"] else str(e))
                left.append(kept)
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(left, pa.list_(pa.int32())), pa.array([w] * len(names), pa.int64())], ["k", "items", "w"])

    return _of_groups(batches, begin, pairs, wide, lambda: iter(()))


# -- mining ------------------------------------------------------------------------------------


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    width = -(-bits.shape[-1] // 64) * 64
    full = np.zeros((*bits.shape[:-1], width), dtype=np.uint8)
    full[..., : bits.shape[-1]] = bits
    return np.packbits(full, axis=-1).view(np.uint64)


class Bitmaps:
    """Weighted rows of a class as one packed bitmap an item; codes are the items, in order."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, weights: np.ndarray):
        self.codes, at = np.unique(flat, return_inverse=True)
        bits = np.zeros((len(self.codes), len(sizes)), dtype=np.uint8)
        bits[at, np.repeat(np.arange(len(sizes)), sizes)] = 1
        self.rows = _packed(bits)
        self.every = _packed(np.ones(len(sizes), dtype=np.uint8))
        self.slices = [_packed(((weights >> b) & 1).astype(np.uint8)) for b in range(int(weights.max(initial=0)).bit_length())]

    def support(self, maps: np.ndarray) -> np.ndarray:
        """The weight of each bitmap's rows, from the binary digits of weights."""
        return sum((np.bitwise_count(maps & s).sum(axis=-1, dtype=np.int64) << b for b, s in enumerate(self.slices)), np.zeros(maps.shape[:-1], np.int64))


def closed_sets(maps: Bitmaps, have: list[int], last: int, least: int) -> Iterator[tuple[list[int], int]]:
    """Closed sets of a class beyond its prefix's closure (have), with supports; last is the prefix's last item."""
    codes = maps.codes
    free = ~np.isin(codes, have)
    stack = [(maps.every, have, free, np.flatnonzero(free & (codes > last)))]
    while stack:
        tids, have, free, post = stack.pop()
        n = maps.support(maps.rows[post] & tids)
        post, n = post[n >= least], n[n >= least]
        for e, support in zip(post.tolist(), n.tolist(), strict=True):
            mine = tids & maps.rows[e]
            covers = free & ~(mine & ~maps.rows).any(axis=-1)
            if covers[:e].any():  # an item of the pre-set: this closure is another branch's
                continue
            more = [*have, *codes[covers].tolist()]
            yield more, support
            rest = free & ~covers
            left = post[(post > e) & rest[post]]
            if len(left):
                stack.append((mine, more, rest, left))


def _bitmaps(table: pa.Table) -> Bitmaps:
    lists = table.column("items").combine_chunks()
    return Bitmaps(lists.flatten().to_numpy(), np.asarray(lists.value_lengths()), table.column("w").to_numpy())


SETS = "items array<int>, n long"


def _mined(table: pa.Table, least: int) -> pa.Table:
    """The closed sets of one class, whose rows are (k, have, items, w)."""
    sole()
    found = list(closed_sets(_bitmaps(table), table.column("have")[0].as_py(), _last(table.column("k")[0].as_py()), least))
    return pa.table({"items": pa.array([sorted(x) for x, _ in found], pa.list_(pa.int32())), "n": pa.array([n for _, n in found], pa.int64())})


def _answered(asked: pa.Table, rows: pa.Table) -> pa.Table:
    """Supports of itemsets that start with the class's prefix, of which the first `depth` items are."""
    sole()
    if not asked.num_rows or not rows.num_rows:
        return pa.table({"items": pa.array([], pa.list_(pa.int32())), "n": pa.array([], pa.int64())})
    maps = _bitmaps(rows)
    depth = asked.column("k")[0].as_py().count(",") + 1
    out = []
    for items in asked.column("items").to_pylist():
        at = np.searchsorted(maps.codes, items[depth:])
        out.append(int(maps.support(np.bitwise_and.reduce(maps.rows[at], axis=0))))
    return pa.table({"items": asked.column("items").cast(pa.list_(pa.int32())), "n": pa.array(out, pa.int64())})


# -- classes -----------------------------------------------------------------------------------

LATER = "cast(substring_index(k, ',', -1) AS int)"


def _child(k: str = "k", e: str = "e") -> str:
    return f"CASE WHEN {k} = '' THEN cast({e} AS string) ELSE concat({k}, ',', {e}) END"


def _in_groups(rows: DataFrame, pairs: DataFrame, groups: int) -> DataFrame:
    """Pairs (k, e, j, n) and wide rows (k, items, w) by group of roots, roots dealt out in turn."""
    later = f"filter(items, e -> k = '' OR e > {LATER})"
    wide = rows.where(f"size(items) > {WIDE}").selectExpr("k", f"explode(array_distinct(transform({later}, e -> e % {groups}))) AS g", "1 AS kind", "items", "w")
    both = pairs.selectExpr("k", f"e % {groups} AS g", "0 AS kind", "array(e, j) AS items", "n AS w").unionByName(wide)
    return both.repartition("k", "g").sortWithinPartitions("k", "g", "kind")


class Level:
    """The classes of prefixes one item longer than those of rows (k: the prefix's items joined by commas; items; w).

    supports has (k, e, s) of all items e that may follow a prefix, heads (k, have) of the prefixes that are mined themselves.
    links are pairs (k, e, j, n): an item that may follow, another one of the class, and the support of the prefix with both.
    """

    def __init__(self, rows: DataFrame, supports: DataFrame, heads: DataFrame, items: int, least: int):
        groups = max(1, -(-items // ROOTS))
        narrow, wide = rows.where(f"size(items) <= {WIDE}"), not is_empty(rows.where(f"size(items) > {WIDE}"))
        rooted = narrow.selectExpr("k", "w", "items", f"explode(filter(items, e -> k = '' OR e > {LATER})) AS e")
        pairs = rooted.selectExpr("k", "w", "e", "explode(array_remove(items, e)) AS j").groupBy("k", "e", "j").agg(F.sum("w").alias("n"))
        if wide:
            links = _in_groups(rows, pairs, groups).mapInArrow(lambda it: _counted(it, items, groups, least), "k string, e int, j int, n long")
        else:
            links = pairs.where(F.col("n") >= least)
        self.links = links = materialise(links, "links")

        same = links.join(supports, ["k", "e"]).where("n = s").join(heads, "k", "left").where("NOT coalesce(array_contains(have, j), false)")
        flags = same.groupBy("k", "e").agg(F.expr("bool_or(j < e)").alias("double"), F.expr("collect_set(CASE WHEN j > e THEN j END)").alias("covered"))
        found = supports.join(heads, "k").join(flags, ["k", "e"], "left").where("NOT array_contains(have, e) AND NOT coalesce(double, false)")
        more = "array_sort(array_union(array_union(have, array(e)), coalesce(covered, cast(array() AS array<int>))))"
        self.found = materialise(found.selectExpr("k AS parent", "e", f"{_child()} AS k", f"{more} AS have", "s AS n"), "found")
        self.heads = self.found.select("k", "have")

        roots = links.groupBy("k", "e").agg(F.max("j").alias("top")).where("top > e").select("k", "e")
        blocks = links.join(roots, ["k", "e"], "left_semi").groupBy("k", "e", F.expr("j div 64").cast("int").alias("b")).agg(F.expr("bit_or(shiftleft(1L, j % 64))").alias("bits"))
        words = blocks.groupBy("k", "e").agg(F.map_from_entries(F.collect_list(F.struct("b", "bits"))).alias("m")).selectExpr("k", "e", f"transform(sequence(0, {items // 64}), b -> coalesce(try_element_at(m, b), 0L)) AS often")
        if roots.count() * (items // 64 + 4) * 8 <= BROADCAST_BYTES:
            words = F.broadcast(words)
        kept = rooted.join(words, ["k", "e"]).selectExpr(f"{_child()} AS k", "filter(items, j -> (shiftright(often[cast(j div 64 AS int)], j % 64) & 1L) = 1L) AS items", "w", "e").where("size(items) > 0 AND element_at(items, -1) > e").select("k", "items", "w")
        if wide:
            chosen = links.join(roots, ["k", "e"], "left_semi")
            kept = kept.unionByName(_in_groups(rows, chosen, groups).mapInArrow(lambda it: _restricted(it, items, groups), "k string, items array<int>, w long"))
        self.rows = materialise(kept.groupBy("k", "items").agg(F.sum("w").alias("w")), "classes")
        sizes = self.rows.groupBy("k").agg(F.count("*").alias("many"), F.sum(F.size("items")).alias("cells"))
        self.large = materialise(sizes.where((F.col("many") > CLASS_ROWS) | (F.col("cells") > CLASS_CELLS)).select("k"), "large")
        self.any_large = not is_empty(self.large)
        self.small = self.rows.join(self.large, "k", "left_anti") if self.any_large else self.rows

    def dealt(self, rows: DataFrame) -> DataFrame:
        """rows by class, in a stated number of tasks: classes are few bytes and much work, so they must not be put together by their bytes."""
        spark = rows.sparkSession
        return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "k")

    def mined(self, least: int) -> DataFrame:
        return self.dealt(self.small.join(self.heads, "k")).groupBy("k").applyInArrow(lambda t: _mined(t, least), SETS)

    def split(self, items: int, least: int) -> Level:
        """The next level, of the classes that are too large."""
        supports = self.links.selectExpr(f"{_child()} AS k", "e AS root", "j AS e", "n AS s").where("e > root").join(self.large, "k", "left_semi").select("k", "e", "s")
        return Level(self.rows.join(self.large, "k", "left_semi"), supports, self.heads.join(self.large, "k", "left_semi"), items, least)


def _prefix(depth: int) -> str:
    return f"array_join(slice(items, 1, {depth}), ',')"


def rules(sets: DataFrame, supports: DataFrame, codes: DataFrame, baskets: int, confidence: int) -> DataFrame:
    """(items, n_items, support, n_rules, best_item, rules_sha256) of sets (items as ranks, n), with the supports of their premises."""
    taken = sets.withColumn("c", F.explode("items")).withColumn("rest", F.expr("array_remove(items, c)"))
    asked = taken.join(supports.select(F.col("items").alias("rest"), F.col("n").alias("a")), "rest", "left").join(codes.selectExpr("e AS c", "item", "s"), "c")
    wide = "decimal(38,0)"
    holds = F.expr(f"a IS NOT NULL AND cast(100 AS {wide}) * n >= cast({confidence} AS {wide}) * a AND cast(n AS {wide}) * {baskets} > cast(a AS {wide}) * s")
    rule = F.when(holds, F.struct("item", "a", "s"))
    one = asked.groupBy("items", "n").agg(F.sort_array(F.collect_list("item")).alias("ids"), F.sort_array(F.collect_list(rule)).alias("rules"))
    said = "array_join(transform(rules, r -> concat_ws(':', r.item, r.a, r.s)), ';')"
    best = "array_min(transform(rules, r -> named_struct('a', r.a, 'item', r.item))).item"
    return one.selectExpr("array_join(ids, ',') AS items", "cast(size(ids) AS long) AS n_items", "n AS support", "cast(size(rules) AS long) AS n_rules", f"{best} AS best_item", f"sha2({said}, 256) AS rules_sha256")


def frequent_sets(lines: DataFrame, basket_col: str = "sale_id", item_col: str = "item_id", least: int = LEAST, share: int = SHARE, confidence: int = CONFIDENCE) -> DataFrame:
    """(items, n_items, support, n_rules, best_item, rules_sha256): the closed frequent itemsets of lines' baskets, with their rules.

    A basket is the distinct items of the rows of one basket_col; rows where either is null are none. Frequent sets are in
    `least` baskets and in one of `share` baskets at least; closed ones lose baskets with any further item. Taking item c from a set is
    a rule where `confidence` per cent of the baskets with the rest have c, and more than of all baskets. Items are
    listed in ascending order, joined by commas; best_item is the conclusion of the rule with the rarest premise, then the
    least one. Repeated rows count once; other columns are not read; an empty table gives no rows.
    """
    began = mark_tables()
    given = lines.select(F.col(basket_col).cast("long").alias("basket"), F.col(item_col).cast("long").alias("item")).where("basket IS NOT NULL AND item IS NOT NULL")
    pairs = materialise(given.distinct(), "pairs")
    baskets = given.select("basket").distinct().count()
    bound = max(least, -(-baskets // share))
    often = pairs.groupBy("item").agg(F.count("*").alias("s")).where(F.col("s") >= bound)
    codes = materialise(ranked(often, "s", "item", name="e").selectExpr("cast(e AS int) AS e", "item", "s"), "items")
    items = codes.count()
    known = F.broadcast(codes) if items <= BROADCAST_ITEMS else codes
    listed = pairs.join(known.select("item", "e"), "item").groupBy("basket").agg(F.sort_array(F.collect_list("e")).alias("items")).where("size(items) > 1")
    rows = materialise(listed.groupBy("items").agg(F.count("*").alias("w")).select(F.lit("").alias("k"), "items", "w"), "baskets")
    spark = lines.sparkSession
    top = spark.createDataFrame([("", [])], "k string, have array<int>")
    levels = [Level(rows, codes.select(F.lit("").alias("k"), "e", "s"), top, items, bound)]
    while levels[-1].any_large:
        levels.append(levels[-1].split(items, bound))
    sets = None
    for level in levels:
        for part in (level.found.select(F.col("have").alias("items"), "n"), materialise(level.mined(bound), "sets")):
            sets = part if sets is None else sets.unionByName(part)
    sets = materialise(sets, "sets")

    supports = codes.selectExpr("array(e) AS items", "s AS n")
    asked = materialise(sets.where("size(items) > 2").select(F.explode(F.expr("transform(items, c -> array_remove(items, c))")).alias("items")).distinct(), "asked")
    for depth, level in enumerate(levels, 1):
        pair = level.links.where("j > e").selectExpr(f"cast(transform(split({_child(_child(), 'j')}, ','), x -> cast(x AS int)) AS array<int>) AS items", "n")
        supports = supports.unionByName(pair)
        own = asked.where(f"size(items) > {depth + 1}").withColumn("k", F.expr(_prefix(depth)))
        needed = level.small.join(own.select("k").distinct(), "k", "left_semi")
        found = level.dealt(own).groupBy("k").cogroup(level.dealt(needed).groupBy("k")).applyInArrow(_answered, SETS)
        supports = supports.unionByName(materialise(found, "answers"))
    out = materialise(rules(sets, supports, codes, baskets, confidence), "rules")
    release(began, keep=out)
    return out
