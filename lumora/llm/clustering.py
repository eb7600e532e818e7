"""Centroid clustering: Lloyd's rounds by two trees, one over vectors and one over centroids.

Vectors are dealt into blocks of BLOCK_ROWS where they are read, without a shuffle. Each block has a cover tree, made once:
the children of a node of radius r have centres more than r / 2 apart, and each of its vectors is within r / 2 of one of
them, its nearest. Blocks with their trees are a written table that each round scans. A round makes a cover tree over the
centroids and walks both trees together: a pair of nodes is dropped when the least distance that their radii allow exceeds
what the vector node's nearest known centroid allows at most; a vector node with one centroid left takes it whole; pairs
of leaves are compared exactly, in integers. Tasks give sums per cluster and component, so a round sends k * DIMENSIONS
sums to the driver, which depends on no table.

Components are floor(1024 * x); an x beyond +-LIMIT counts as that bound, so that any squared distance fits a long.

Edge cases: vectors that are null, have another length than DIMENSIONS or a null or non-finite component are left out; a
null vec_id is a row like others, but starts a centroid only when too few rows have an id; rows with one vec_id are told
apart by their components, equal rows count each; with fewer vectors than k there are as many centroids as vectors; an
inertia beyond a long is null; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import written

DIMENSIONS = 64
LIMIT = 131_072.0
BLOCK_ROWS = 1024
LEAF_ROWS = 8
SLACK = 1e-9  # relative; bounds are floating point, comparisons of leaves are not
CLUSTERS = 8
ROUNDS = 10
SALT = "3:"


def integer_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """vec_id and v, the integers of each vector that is kept."""
    e = F.col("embedding").cast("array<double>")
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    ints = F.transform("e", lambda x: F.floor(1024 * F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), x))).cast("int"))
    return vectors.select("vec_id", e.alias("e")).where((F.size("e") == dimensions) & F.coalesce(finite, F.lit(False))).select("vec_id", ints.alias("v"))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.square(x - y).sum(-1))


class CoverTree:
    """Nodes in order of depth. A node's points are order[start:stop]; its children are nodes first to first + count."""

    def __init__(self, order: np.ndarray, start: np.ndarray, stop: np.ndarray, center: np.ndarray, radius: np.ndarray, first: np.ndarray, count: np.ndarray):
        self.order, self.start, self.stop, self.center, self.radius, self.first, self.count = order, start, stop, center, radius, first, count

    @classmethod
    def over(cls, points: np.ndarray, leaf_rows: int = LEAF_ROWS) -> CoverTree:
        x = points.astype(np.float64)
        square = np.square(x).sum(1)
        order, nodes, k = np.arange(len(x)), [[0, len(x), 0]], 0
        radius, first, count = [], [], []
        while k < len(nodes):
            start, stop, center = nodes[k]
            own = order[start:stop]
            near = _distances(x[own], x[center])
            radius.append(float(near.max()) * (1 + SLACK))
            first.append(len(nodes))
            if stop - start > leaf_rows and radius[k] > 0:
                centers, at = [center], np.zeros(len(own), np.int64)
                while near.max() > radius[k] / 2:  # the farthest is a centre of its own
                    far = int(near.argmax())
                    far_row = own[far]
                    d = np.sqrt(np.maximum(square[own] + square[far_row] - 2 * (x[own] @ x[far_row]), 0))
                    d[far] = 0
                    closer = d < near
                    at[closer], near[closer] = len(centers), d[closer]
                    centers.append(int(far_row))
                if len(centers) > 1:
                    order[start:stop] = own[np.argsort(at, kind="stable")]
                    sizes = np.bincount(at, minlength=len(centers))
                    ends = start + sizes.cumsum()
                    nodes += [[int(end - size), int(end), c] for end, size, c in zip(ends, sizes, centers) if size]
            count.append(len(nodes) - first[k])
            k += 1
        start, stop, center = np.array(nodes, np.int64).T
        return cls(order, start, stop, center, np.array(radius), np.array(first), np.array(count))


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs (first, count): which run each member is of, and the members."""
    which = np.repeat(np.arange(len(first)), count)
    return which, np.arange(len(which)) - np.repeat(count.cumsum() - count, count) + first[which]


def nearest(points: np.ndarray, tree: CoverTree, centroids: np.ndarray, over: CoverTree) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each point (ties: the smaller number) and its squared distance, both exact. over: a tree with leaves of one centroid or equal ones."""
    x, y = points.astype(np.float64), centroids.astype(np.float64)
    chosen = np.zeros(len(points), np.int64)
    known = np.full(len(tree.start), np.inf)  # no point of the node is farther from its nearest centroid

    def close(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = _distances(x[tree.center[v]], y[over.center[c]])
        np.minimum.at(known, v, (d + tree.radius[v]) * (1 + SLACK))
        ok = (d - tree.radius[v] - over.radius[c]) <= known[v] * (1 + SLACK) + SLACK * d
        return v[ok], c[ok]

    v, c = close(np.zeros(1, np.int64), np.zeros(1, np.int64))
    while len(v):
        while True:  # the larger node of a pair opens, at a leaf of vectors the centroid node
            wide = (over.count[c] > 0) & ((over.radius[c] >= tree.radius[v]) | (tree.count[v] == 0))
            if not wide.any():
                break
            which, inner = _spread(over.first[c[wide]], over.count[c[wide]])
            v, c = close(np.concatenate([v[~wide], v[wide][which]]), np.concatenate([c[~wide], inner]))
        order = np.argsort(v, kind="stable")
        v, c = v[order], c[order]
        one = np.bincount(v, minlength=len(tree.start))[v] == 1
        alone = one & (over.stop[c] - over.start[c] == 1)
        which, at = _spread(tree.start[v[alone]], (tree.stop - tree.start)[v[alone]])
        chosen[tree.order[at]] = over.order[over.start[c[alone]]][which]
        v, c = v[~alone], c[~alone]
        leaf = tree.count[v] == 0
        if leaf.any():
            # a pair for each point and each centroid of the two leaves
            which, at = _spread(tree.start[v[leaf]], (tree.stop - tree.start)[v[leaf]])
            node = c[leaf][which]
            again, number = _spread(over.start[node], (over.stop - over.start)[node])
            row, number = tree.order[at[again]], over.order[number]
            d = np.square(points[row] - centroids[number]).sum(1)
            best = np.lexsort((number, d, row))
            best = best[np.append(True, row[best][1:] != row[best][:-1])]
            chosen[row[best]] = number[best]
            v, c = v[~leaf], c[~leaf]
        inner_known = known[v]
        which, inner = _spread(tree.first[v], tree.count[v])
        np.minimum.at(known, inner, inner_known[which])
        v, c = close(inner, c[which]) if len(inner) else (inner, inner)
    return chosen, np.square(points - centroids[chosen]).sum(1)


_BLOCK = "ids array<long>, id_null array<boolean>, v binary, rows array<int>, start array<int>, stop array<int>, center array<int>, first array<int>, count array<int>, radius array<double>"


def blocks_of(vectors: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """A row for each block: ids, components (row by row, 32-bit integers) and the cover tree. Blocks are dealt where rows are read."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k in range(0, len(batch), BLOCK_ROWS):
                part = batch.iloc[k : k + BLOCK_ROWS]
                v = np.stack(part["v"].to_numpy()).astype(np.int32)
                t = CoverTree.over(v)
                out.append((part["id"].to_numpy(), part["id_null"].to_numpy(), v.tobytes(), t.order, t.start, t.stop, t.center, t.first, t.count, t.radius))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _BLOCK.split(", ")])

    ids = vectors.select(F.coalesce("vec_id", F.lit(0).cast("long")).alias("id"), F.col("vec_id").isNull().alias("id_null"), "v")
    return ids.mapInPandas(each, _BLOCK)


def _walked(rows: pd.DataFrame, centroids: list[list[int]]) -> Iterator[tuple[object, np.ndarray, np.ndarray, np.ndarray]]:
    c = np.array(centroids, np.int64)
    over = CoverTree.over(c, 1)
    for r in rows.itertuples():
        points = np.frombuffer(r.v, np.int32).reshape(-1, c.shape[1]).astype(np.int64)
        tree = CoverTree(*(np.asarray(x) for x in (r.rows, r.start, r.stop, r.center, r.radius, r.first, r.count)))
        yield r, points, *nearest(points, tree, c, over)


def _sums(batches: Iterator[pd.DataFrame], centroids: list[list[int]]) -> Iterator[pd.DataFrame]:
    """Sums over the task's blocks: a row for each cluster and component."""
    k, d = len(centroids), len(centroids[0])
    total, n = np.zeros((k, d), np.int64), np.zeros(k, np.int64)
    for rows in batches:
        for _, points, chosen, _ in _walked(rows, centroids):
            np.add.at(total, chosen, points)
            n += np.bincount(chosen, minlength=k)
    yield pd.DataFrame({"cluster": np.repeat(np.arange(k), d), "component": np.tile(np.arange(d), k), "n": np.repeat(n, d), "total": total.ravel()})


def _assigned(batches: Iterator[pd.DataFrame], centroids: list[list[int]]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        for r, _, chosen, distance in _walked(rows, centroids):
            yield pd.DataFrame({"vec_id": pd.array(r.ids, "Int64").copy(), "cluster": chosen, "distance": distance}).assign(vec_id=lambda x, null=np.asarray(r.id_null, bool): x["vec_id"].mask(null))


def first_centroids(vectors: DataFrame, k: int = CLUSTERS, salt: str = SALT) -> list[list[int]]:
    """The k vectors whose ids have the least salted hashes: k rows on the driver."""
    by = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    return [r["v"] for r in vectors.select("v", by.alias("by")).orderBy(F.asc_nulls_last("by"), "v").limit(k).collect()]


def lloyd(blocks: DataFrame, centroids: list[list[int]], rounds: int = ROUNDS) -> list[list[int]]:
    """The centroids after so many rounds; an empty cluster keeps its own."""
    for _ in range(rounds):
        sums = blocks.mapInPandas(partial(_sums, centroids=centroids), "cluster int, component int, n long, total long")
        got = sums.groupBy("cluster", "component").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).where("n > 0").collect()
        centroids = [list(c) for c in centroids]
        for r in got:
            centroids[r["cluster"]][r["component"]] = r["total"] // r["n"]
    return centroids


def clustered(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, salt: str = SALT, dimensions: int = DIMENSIONS) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 and centroid of every vector that is kept."""
    spark = vectors.sparkSession
    kept = integer_vectors(vectors, dimensions)
    start = first_centroids(kept, k, salt)
    summary = "cluster int, centroid_sha256 string, centroid array<int>"
    if not start:
        none = spark.createDataFrame([], f"vec_id long, distance long, cluster_inertia long, inertia long, {summary}")
        return none.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")
    blocks = written(blocks_of(kept, dimensions), "clustering-blocks")
    centroids = lloyd(blocks, start, rounds)
    assigned = written(blocks.mapInPandas(partial(_assigned, centroids=centroids), "vec_id long, cluster int, distance long"), "clustering-assigned")
    names = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest(), c) for i, c in enumerate(centroids)]
    by = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    by = by.withColumn("every", F.sum("own").over(Window.partitionBy(F.lit(0)))).join(F.broadcast(spark.createDataFrame(names, summary)), "cluster")  # k rows
    by = by.select("cluster", F.col("own").try_cast("long").alias("cluster_inertia"), F.col("every").try_cast("long").alias("inertia"), "centroid_sha256", "centroid")
    return assigned.join(F.broadcast(by), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("centroid")


def _sql() -> str:
    kept = f"""WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * greatest(-{LIMIT}, least({LIMIT}, x::DOUBLE)))::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS}
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{SALT}' || vec_id)) - 1 AS cluster, v AS c FROM kept QUALIFY cluster < {CLUSTERS}
)"""
    parts = [kept]
    for i in range(ROUNDS + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT vec_id, any_value(v) AS v, min({{'distance': d, 'cluster': cluster}}) AS best FROM (
    SELECT vec_id, v, cluster, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept CROSS JOIN c{i}) GROUP BY vec_id
)""")
        if i < ROUNDS:
            parts.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c{i}.cluster, coalesce(m.c, c{i}.c) AS c FROM c{i} LEFT JOIN (
    SELECT cluster, list(((total - ((total % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM (
      SELECT best.cluster AS cluster, i, sum(v[i])::BIGINT AS total, count(*) AS n FROM a{i}, range(1, {DIMENSIONS + 1}) t(i) GROUP BY ALL) GROUP BY cluster) m USING (cluster)
)""")
    return ", ".join(parts) + f"""
SELECT vec_id, best.cluster::INTEGER AS cluster, best.distance AS distance, (sum(best.distance) OVER (PARTITION BY best.cluster))::BIGINT AS cluster_inertia,
  (sum(best.distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} ON c{ROUNDS}.cluster = best.cluster"""


SQL = _sql()
