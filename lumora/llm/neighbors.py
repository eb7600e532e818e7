"""Near-duplicate embeddings by p-stable hashing: quantised random projections in several tables, then exact cosines.

Vectors of a label are compared. Equal vectors are merged first, so copies cost one row. A normalised vector v has in each
table a bucket, named by label and floor((a . v + b) / WIDTH) of several Gaussian directions a. At a cosine of 0.93 two
vectors are 0.374 apart and agree in one direction with a probability of 0.851, at a right angle with one of 0.486. So a
bucket takes as many directions as leave STRAY strangers of the largest label on average, and there are as many tables as
lose a pair at the least cosine with a probability of LOSS or less (closer pairs are lost less often). Directions, vectors
and offsets are rounded to integers whose sums are exact in floating point, so that a vector has the same buckets in
every task. Tables are made TABLES_AT_ONCE at a time, which bounds the disk that they take.

Buckets of one vector end there. The others are units of work; a bucket of more than UNIT_ROWS is dealt into blocks, and a
unit is a pair of blocks. A unit gives no pairs: it gives for each vector how many others it is linked with, of the pairs
whose first common table is the unit's own (so that each is counted once), and a spanning forest of the links. Components
come from joins over the forests. No step has a cap on partners or candidates.

Edge cases: vectors that are null, empty, zero or hold a null or non-finite component, and those without a label, link with
nothing; vectors of different lengths never link; rows with one vec_id are vectors of their own, equal rows are linked;
a null vec_id never names a component that has another; kept is true where both are null; an empty table gives no rows;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial
from math import ceil, erf, exp, log, pi, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import discard, written
from ._graph import components
from ._tries import Forest

COSINE = 0.93
WIDTH = 2.0
STRAY = 1 / 16
LOSS = 1e-3
TABLES_AT_ONCE = 32
UNIT_ROWS = 1024
SMALL_ROWS = 24  # units of so many rows at most are taken together
TASK_ROWS = 20_000
_UNIT = 1 << 20  # integers for one, in vectors
_STEP = 1 << 10  # the same in directions
_MIX = np.uint64(0x9E3779B97F4A7C15)


def agreement(distance: float, width: float = WIDTH) -> float:
    """The probability that one quantised projection is equal for two vectors so far apart."""
    t = width / distance
    return erf(t / sqrt(2)) - 2 / (sqrt(2 * pi) * t) * (1 - exp(-t * t / 2))


def tables_for(n: int, cosine: float = COSINE, loss: float = LOSS) -> tuple[int, int]:
    """Directions a table and number of tables for n vectors of a label."""
    directions = max(4, ceil(log(max(n, 1) / STRAY) / -log(agreement(sqrt(2)))))
    return directions, ceil(log(loss) / log(1 - agreement(sqrt(2 - 2 * cosine)) ** directions))


@cache
def _directions(dimensions: int, directions: int, table: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([dimensions, table])
    a = np.rint(rng.standard_normal((dimensions, directions)) * _STEP)
    b = np.rint(rng.random(directions) * WIDTH * _UNIT * _STEP)
    return a, b, rng.integers(1 << 62, 1 << 63, directions + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def normalised(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; the largest component is scaled to one first, so that no square overflows."""
    v = vectors / np.abs(vectors).max(1, keepdims=True)
    return v / np.sqrt(np.square(v).sum(1, keepdims=True))


def bucket_names(unit_vectors: np.ndarray, labels: np.ndarray, directions: int, table: int) -> np.ndarray:
    """A 64-bit name of each vector's bucket in that table."""
    a, b, mix = _directions(unit_vectors.shape[1], directions, table)
    cells = np.floor((np.rint(unit_vectors * _UNIT) @ a + b) / (WIDTH * _UNIT * _STEP)).astype(np.int64).view(np.uint64)
    name = (cells * mix[1:]).sum(1, dtype=np.uint64) + (labels.astype(np.int64).view(np.uint64) + np.uint64(unit_vectors.shape[1])) * mix[0]
    name = (name ^ (name >> np.uint64(32))) * _MIX
    return name ^ (name >> np.uint64(29))


def _by_length(vectors: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: which rows have it, and their vectors, normalised in double precision."""
    lengths = vectors.map(len).to_numpy()
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, normalised(np.stack(vectors.iloc[at].to_numpy()).astype(np.float64))


def names_column(vector: str, label: str, directions: int, tables: range) -> Column:
    """The names of a vector's buckets in those tables."""

    def each(vectors: pd.Series, labels: pd.Series) -> pd.Series:
        out = np.zeros((len(vectors), len(tables)), np.int64)
        for at, v in _by_length(vectors):
            for k, table in enumerate(tables):
                out[at, k] = bucket_names(v, labels.to_numpy()[at], directions, table).view(np.int64)
        return pd.Series(list(out))

    return F.pandas_udf(each, "array<long>")(vector, label)


def _pairs(v: np.ndarray, group: np.ndarray, side: np.ndarray, alone: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a group (rows are in order of groups) with that cosine or more: of those that are alone any two, else one of each side."""

    def close(i: np.ndarray, j: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = c >= cosine - 1e-9
        i, j = i[ok], j[ok]
        exact = (v[i] * v[j]).sum(1)
        return i[exact >= cosine], j[exact >= cosine]

    start = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(start, len(group)))
    small = np.repeat((size <= SMALL_ROWS) & alone[start], size)
    for step in range(1, min(SMALL_ROWS, len(group))):
        i = np.flatnonzero((group[step:] == group[:-step]) & small[:-step])
        if not len(i):
            break
        yield close(i, i + step, np.einsum("ij,ij->i", v[i], v[i + step]))
    for s, n in zip(start[~small[start]], size[~small[start]]):
        rows = np.arange(s, s + n)
        left, right = (rows, rows) if alone[s] else (rows[~side[s : s + n]], rows[side[s : s + n]])
        for k in range(0, len(left), 256):
            c = v[left[k : k + 256]] @ v[right].T
            i, j = np.nonzero(c >= cosine - 1e-9)
            i, j, c = left[k : k + 256][i], right[j], c[i, j]
            ok = i < j if alone[s] else slice(None)
            yield close(i[ok], j[ok], c[ok])


def _linked(rows: pd.DataFrame, directions: int, cosine: float) -> pd.DataFrame:
    """(a, b, n) of units: b null and n the partners (with copies) of a, or a link of the forest between a and b."""
    rows = rows.reset_index(drop=True)
    node, copies, counts, links = rows["node"].to_numpy(), rows["copies"].to_numpy(), np.zeros(len(rows), np.int64), []
    for at, v in _by_length(rows["v"]):
        own = rows.iloc[at]
        keys = own[["bucket", "low", "high"]].to_numpy()
        group = np.append(0, (keys[1:] != keys[:-1]).any(1).cumsum())
        labels, table = own["label"].to_numpy(), own["place"].to_numpy()
        forest = Forest(np.arange(len(own)))
        for i, j in _pairs(v, group, own["side"].to_numpy(), own["alone"].to_numpy(), cosine):
            # only pairs that share no earlier table
            involved, where = np.unique(np.concatenate([i, j]), return_inverse=True)
            x, y = where[: len(i)], where[len(i) :]
            fresh = (labels[i] == labels[j]) & (table[i] == table[j])
            for t in range(int(table[i].max(initial=-1)) + 1):
                due = np.flatnonzero(fresh & (table[i] >= t))
                if not len(due):
                    break
                name = bucket_names(v[involved], labels[involved], directions, t)
                same = name[x[due]] == name[y[due]]
                fresh[due] = np.where(table[i[due]] == t, same, ~same)
            i, j = i[fresh], j[fresh]
            counts += np.bincount(at[i], copies[at[j]], len(rows)).astype(np.int64) + np.bincount(at[j], copies[at[i]], len(rows)).astype(np.int64)
            forest.link(i, j)
        links += [(node[at[i]], node[at[j]]) for i, j in forest.links]
    has = counts > 0
    a, b = (np.concatenate([x[k] for x in links]) if links else np.zeros(0, np.int64) for k in (0, 1))
    return pd.DataFrame({"a": np.concatenate([node[has], a]), "b": pd.array([None] * int(has.sum()), "Int64").tolist() + b.tolist(), "n": np.concatenate([counts[has], np.zeros(len(a), np.int64)])}).astype({"b": "Int64"})


def _units(batches: Iterator[pd.DataFrame], directions: int, cosine: float) -> Iterator[pd.DataFrame]:
    """Units are taken together until they have TASK_ROWS rows; rows come in order of units."""
    held, n = [], 0
    for batch in batches:
        for k in range(0, len(batch), TASK_ROWS):
            part = batch.iloc[k : k + TASK_ROWS]
            held.append(part)
            n += len(part)
            if n < TASK_ROWS:
                continue
            rows = pd.concat(held, ignore_index=True)
            keys = rows[["bucket", "low", "high"]].to_numpy()
            other = np.flatnonzero((keys != keys[-1]).any(1))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield _linked(rows[:cut], directions, cosine)
            held, n = [rows[cut:]], len(rows) - cut
    if n:
        yield _linked(pd.concat(held, ignore_index=True), directions, cosine)


def _of_tables(distinct: DataFrame, directions: int, tables: range, cosine: float) -> DataFrame:
    """What _linked gives for all buckets of those tables."""
    named = distinct.select("node", F.posexplode(names_column("v", "label", directions, tables)).alias("place", "bucket"))
    named = written(named.withColumn("place", (F.col("place") + tables.start).cast("int")), "neighbors-named")
    shared = written(named.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "neighbors-shared")
    blocks = F.ceil(F.col("size") / UNIT_ROWS).cast("int")
    dealt = named.join(shared, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("meets", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("node", "place", "bucket", F.least("block", "meets").alias("low"), F.greatest("block", "meets").alias("high"), (F.col("block") > F.col("meets")).alias("side"), (F.col("block") == F.col("meets")).alias("alone"))
    # a block meets itself and each other block; the rows of a unit of two blocks are on two sides
    keys = ["bucket", "low", "high"]
    found = dealt.join(distinct.select("node", "v", "label", "copies"), "node").repartition(*keys).sortWithinPartitions(*keys)
    found = written(found.mapInPandas(partial(_units, directions=directions, cosine=cosine), "a long, b long, n long"), "neighbors-found")
    discard(named, shared)
    return found


def near_neighbors(vectors: DataFrame, cosine: float = COSINE, loss: float = LOSS) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, embedding, label)."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.col("label").isNotNull() & F.coalesce((F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = vectors.select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").alias("v"))
    of = rows.where(usable).groupBy("label", "v").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
    distinct = written(of.withColumn("node", F.monotonically_increasing_id()), "neighbors-distinct")
    n = distinct.groupBy("label", F.size("v")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    directions, tables = tables_for(n, cosine, loss)
    found = [_of_tables(distinct, directions, range(k, min(k + TABLES_AT_ONCE, tables)), cosine) for k in range(0, tables, TABLES_AT_ONCE)] if n > 1 else []
    every = distinct.sparkSession.createDataFrame([], "a long, b long, n long")
    for part in found:
        every = every.union(part)
    partners = every.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("partners"))
    labels = components(every.where("b IS NOT NULL").select("a", "b"), "neighbors") if found else distinct.sparkSession.createDataFrame([], "node long, label long")
    labelled = distinct.drop("label").join(labels, "node", "left").join(partners, "node", "left")
    labelled = written(labelled.select("node", "least", "copies", F.coalesce("label", "node").alias("group"), F.coalesce("partners", F.lit(0)).alias("partners")), "neighbors-labelled")
    names = labelled.groupBy("group").agg(F.min("least").alias("component_id"))
    result = labelled.join(names, "group").select("node", (F.col("copies") - 1 + F.col("partners")).alias("n_links"), "component_id")
    result = distinct.select("node", F.col("label").alias("own_label"), F.col("v").alias("own_v")).join(result, "node").drop("node")
    linked = rows.where(usable).join(result, (F.col("label") == F.col("own_label")) & (F.col("v") == F.col("own_v")))
    out = written(linked.select("vec_id", "n_links", "component_id").union(rows.where(~usable).select("vec_id", F.lit(0).cast("long"), "vec_id")), "neighbors-rows")
    discard(labelled, distinct, *found)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op12_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_neighbors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All pairs of a label, and components by a recursion over the links.
SQL = f"""WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, CASE WHEN len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN embedding::DOUBLE[] END AS e FROM embeddings
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}
), reach AS (
  SELECT vec_id AS node, vec_id AS found FROM v UNION SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.found
)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN (SELECT node AS vec_id, min(found) AS component_id FROM reach GROUP BY node) USING (vec_id) LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) USING (vec_id)"""
