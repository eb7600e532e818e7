"""Binary tries of fingerprints, one for each unit of work, walked in pairs of nodes.

Rows of a unit are sorted by fingerprint, so a node of its trie is a run of rows. Pairs of nodes go down together from
the pairs of roots; differing bits are added up, and a pair is dropped as soon as they exceed the budget or all its rows
are in one component already. The tries of many units are walked at once, level by level, in whole-array steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT_ROWS = 2048  # a bucket with more rows is dealt into blocks
TASK_ROWS = 100_000  # units are taken together until they have so many rows
CHUNK = 400_000
LEAF_PAIRS = 64


class Forest:
    """Union-find over local indices with whole-array steps; keeps the links that joined two components."""

    def __init__(self, labels: np.ndarray):
        """Rows of equal labels are one component from the start."""
        _, first, inverse = np.unique(labels, return_index=True, return_inverse=True)
        self.root = first[inverse]
        self.version, self.links = 0, []

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            apart = np.flatnonzero(x != y)
            if not len(apart):
                return
            self.version += 1
            # one link for each greater root, so that the links taken have no cycle
            high, at = np.unique(np.maximum(x, y)[apart], return_index=True)
            took = apart[at]
            self.links.append((a[took], b[took]))
            self.root[high] = np.minimum(x, y)[took]
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


class Tries:
    """Levels of the tries of some rows (indices, sorted by unit and value): where each node starts, its first child and how many it has."""

    def __init__(self, rows: np.ndarray, units: np.ndarray, values: np.ndarray):
        self.rows, self.values = rows, values[rows]
        own = units[rows]
        self.breaks = own[1:] != own[:-1]
        start = np.concatenate([[0], np.flatnonzero(self.breaks) + 1])
        self.units = own[start]
        self.starts, self.first, self.two, self.bit, self._same = [start], [], [], [], {}

    def level(self, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the nodes at depth d: index of the first child at d + 1, whether there are two, the first child's bit."""
        while len(self.first) <= d:
            k = len(self.first)
            prefix = self.values >> np.uint64(63 - k)
            start = np.concatenate([[0], np.flatnonzero(self.breaks | (prefix[1:] != prefix[:-1])) + 1])
            first = np.searchsorted(start, self.starts[k])
            self.first.append(first)
            self.two.append(np.diff(np.append(first, len(start))) == 2)
            self.bit.append((prefix[start[first]] & np.uint64(1)).astype(np.int8))
            self.starts.append(start)
        return self.first[d], self.two[d], self.bit[d]

    def sizes(self, d: int) -> np.ndarray:
        return np.diff(np.append(self.starts[d], len(self.values)))

    def component(self, d: int, forest: Forest) -> np.ndarray:
        """The component of each node at depth d, or -1 if it has several."""
        version, got = self._same.get(d, (-1, None))
        if version != forest.version:
            own = forest.root[self.rows]
            low, high = np.minimum.reduceat(own, self.starts[d]), np.maximum.reduceat(own, self.starts[d])
            got = np.where(low == high, low, -1)
            self._same[d] = (forest.version, got)
        return got


def _crossed(one: Tries, two: Tries, d: int, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of the pairs of nodes, a bounded number at once."""
    na, nb = one.sizes(d)[a], two.sizes(d)[b]
    width = np.maximum(1, CHUNK // nb)  # a node with very many rows is taken in parts
    parts = -(-na // width)
    which = np.repeat(np.arange(len(a)), parts)
    low = (np.arange(len(which)) - np.repeat(parts.cumsum() - parts, parts)) * width[which]
    rows = np.minimum(width[which], na[which] - low)
    reach = rows * nb[which]
    group = (reach.cumsum() - reach) // CHUNK
    for cut in np.split(np.arange(len(which)), np.flatnonzero(np.diff(group)) + 1):
        w, n = which[cut], reach[cut]
        at = np.repeat(np.arange(len(cut)), n)
        k = np.arange(len(at)) - np.repeat(n.cumsum() - n, n)
        wide = nb[w][at]
        yield one.starts[d][a[w]][at] + low[cut][at] + k // wide, two.starts[d][b[w]][at] + k % wide


def walk(one: Tries, two: Tries, budget: int, forest: Forest) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (of one, of two) of a unit within so many bits, in different components, bit by bit. two may be one."""
    same = two is one
    if same:
        a = b = np.arange(len(one.units))
    else:
        _, a, b = np.intersect1d(one.units, two.units, assume_unique=True, return_indices=True)
    stack = [(0, a, b, np.zeros(len(a), np.int8))]
    while stack:
        d, a, b, off = stack.pop()
        if len(a) > CHUNK:
            stack += [(d, a[k : k + CHUNK], b[k : k + CHUNK], off[k : k + CHUNK]) for k in range(0, len(a), CHUNK)]
            continue
        ca = one.component(d, forest)[a]
        go = (ca < 0) | (ca != two.component(d, forest)[b])
        a, b, off = a[go], b[go], off[go]
        small = (one.sizes(d)[a] * two.sizes(d)[b] <= LEAF_PAIRS) | (d == 64)
        if small.any():
            for i, j in _crossed(one, two, d, a[small], b[small]):
                ok = np.bitwise_count(one.values[i] ^ two.values[j]) <= budget
                if same:
                    ok &= i < j
                i, j = one.rows[i[ok]], two.rows[j[ok]]
                ok = forest.root[i] != forest.root[j]
                if ok.any():
                    yield i[ok], j[ok]
            a, b, off = a[~small], b[~small], off[~small]
        if not len(a):
            continue
        (fa, ta, ba), (fb, tb, bb) = one.level(d), two.level(d)
        parts = []
        for u in (0, 1):
            for v in (0, 1):
                ok = np.ones(len(a), bool)
                if u:
                    ok &= ta[a]
                if v:
                    ok &= tb[b]
                if u and not v and same:
                    ok &= a != b
                x, y = a[ok], b[ok]
                more = off[ok] + ((ba[x] + u) ^ (bb[y] + v))
                fits = more <= budget
                parts.append((fa[x[fits]] + u, fb[y[fits]] + v, more[fits].astype(np.int8)))
        stack.append((d + 1, *(np.concatenate(p) for p in zip(*parts))))


Passes = list[tuple[int, Callable[[np.ndarray, np.ndarray], np.ndarray] | None]]


def joined(values: np.ndarray, units: np.ndarray, side: np.ndarray, alone: np.ndarray, labels: np.ndarray, passes: Passes, every: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a unit with different labels: those of a spanning forest, or every one as it is found.

    Rows of a unit that are alone are joined with themselves, of the others one side with the other. passes: budgets of
    bits, each with which pairs may count besides, the strictest first; a forest takes its links in that order, every
    pair is one of the last pass.
    """
    forest = Forest(labels)
    order = np.lexsort((values, units))
    own, left, right = (order[m[order]] for m in (alone, ~alone & ~side, ~alone & side))

    works = []
    if len(own):
        tries = Tries(own, units, values)
        works.append((tries, tries))
    if len(left) and len(right):
        works.append((Tries(left, units, values), Tries(right, units, values)))
    for budget, alike in passes[-1:] if every else passes:
        for one, two in works:
            for i, j in walk(one, two, budget, forest):
                if alike is not None:
                    ok = alike(i, j)
                    i, j = i[ok], j[ok]
                if every:
                    yield i, j
                else:
                    forest.link(i, j)
    yield from forest.links


def one_block_units(entries: DataFrame, keys: list[str], sizes: DataFrame, how: str) -> DataFrame:
    """entries with unit, side and alone, where each bucket (keys) is dealt into blocks of about UNIT_ROWS and each block is a unit.

    sizes: keys and n, the rows of the buckets; buckets that it lacks are dropped (how inner) or are one block (left).
    """
    blocks = F.coalesce(F.ceil(F.col("n") / UNIT_ROWS), F.lit(1))
    block = F.pmod(F.xxhash64("node"), blocks)
    return entries.join(sizes, keys, how).withColumn("unit", F.xxhash64(*keys, block)).withColumn("side", F.lit(False)).withColumn("alone", F.lit(True)).drop("n", *keys)


def cross_units(entries: DataFrame, keys: list[str]) -> DataFrame:
    """entries (with a label) with unit, side and alone, so that any two rows of a bucket with different labels meet in a unit.

    A bucket's most frequent label is its main one. Its other rows are dealt into blocks, and if the bucket is large its
    main rows into further ones; each block of others meets every block. So a large component costs a row each, whatever
    its size, where few rows are outside it. Buckets of one label have no unit.
    """
    by_label = entries.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"))
    by_bucket = by_label.groupBy(*keys).agg(F.sum("n").alias("n"), F.max("n").alias("n_main"), F.max_by("label", F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    small = F.col("n") <= UNIT_ROWS
    at = entries.join(by_bucket, keys)
    at = at.withColumn("others", F.when(small, F.lit(1)).otherwise(F.ceil((F.col("n") - F.col("n_main")) / UNIT_ROWS)).cast("int"))
    at = at.withColumn("mains", F.when(small, F.lit(0)).otherwise(F.ceil(F.col("n_main") / UNIT_ROWS)).cast("int"))
    is_main = ~small & (F.col("label") == F.col("main"))
    at = at.withColumn("block", F.when(is_main, F.col("others") + F.pmod(F.xxhash64("node"), F.greatest("mains", F.lit(1)))).otherwise(F.pmod(F.xxhash64("node"), F.col("others"))).cast("int"))
    # a main block meets the blocks of others alone
    last = F.when(is_main, F.col("others") - 1).otherwise(F.col("others") + F.col("mains") - 1)
    at = at.withColumn("meets", F.explode(F.sequence(F.lit(0), last)))
    unit = F.xxhash64(*keys, F.least("block", "meets"), F.greatest("block", "meets"))
    return at.withColumn("unit", unit).withColumn("side", F.col("block") > F.col("meets")).withColumn("alone", F.col("block") == F.col("meets")).drop(*keys, "n", "n_main", "main", "labels", "others", "mains", "block", "meets")


def unit_pairs(dealt: DataFrame, passes: Callable[[pd.DataFrame], Passes], every: bool = False) -> DataFrame:
    """Pairs (a, b), a < b, of nodes that the units of dealt (node, fp, label, unit, side, alone and what passes reads) give."""

    def work(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        node, label = rows["node"].to_numpy(), rows["label"].to_numpy()
        for i, j in joined(rows["fp"].to_numpy().view(np.uint64), rows["unit"].to_numpy(), rows["side"].to_numpy(), rows["alone"].to_numpy(), label, passes(rows), every):
            yield pd.DataFrame({"a": np.minimum(node[i], node[j]), "b": np.maximum(node[i], node[j])})

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n < TASK_ROWS:
                continue
            rows = pd.concat(held, ignore_index=True)
            units = rows["unit"].to_numpy()
            cut = int(np.flatnonzero(units != units[-1])[-1]) + 1 if units[0] != units[-1] else 0
            if cut:
                yield from work(rows[:cut])
            held, n = [rows[cut:]], len(rows) - cut
        if n:
            yield from work(pd.concat(held, ignore_index=True))

    return dealt.repartition("unit").sortWithinPartitions("unit").mapInPandas(each, "a long, b long").distinct()
