"""The conversation trie, embedding near-dedup and centroid clustering against plain versions, on odd and on empty tables."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lumora.llm import clustering, neighbors, prefixes

TURNS = "conv_id long, turn long, role string, text string"
VECTORS = "vec_id long, embedding array<float>, label int"


def clashing(df):
    """Extra columns with names that the operators use themselves."""
    from pyspark.sql import functions as F

    for name in ("conv", "pos", "d", "t", "pid", "upto", "rep", "node", "v", "bucket", "copies", "label_", "cluster", "id", "a", "b", "n"):
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture
def spread(spark):
    """Small tables keep their partitions, as large ones do."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# 11


def plain_trie(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in by.items()}
    ids, parent, last, depth, members, ends = {}, {}, {}, {0: 0}, defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        at = 0
        members[0].append(c)
        for turn in own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:]:
            new = ids.setdefault((at, turn), len(ids) + 1)
            parent[new], last[new], depth[new], at = at, turn, depth[at] + 1, new
            members[new].append(c)
        ends[at].append(c)
    if not members:
        return set()
    kids, leaves, saved = Counter(parent.values()), Counter(), Counter()
    for n in sorted(depth, key=depth.get, reverse=True):
        leaves[n] += not kids[n]
        if n:
            saved[n] += (len(members[n]) - 1) * len(last[n][1].encode())
            leaves[parent[n]] += leaves[n]
            saved[parent[n]] += saved[n]
    sha = lambda n: hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest()
    return {(members[n][0], depth[n], members[parent[n]][0] if n else None, len(members[n]), kids[n], leaves[n], saved[n], sha(n)) for n in depth}


def odd_turns():
    rows = [(c, t, "user" if t % 2 else None, f"turn {t % 3} of {c % 2}") for c in range(-12, 40) for t in range(abs(c) % 7)]
    rows += [(50, t, "user", "the same") for t in range(700)] + [(55, t, "user", "the same" if t < 600 else "another") for t in range(700)]  # deep, one a prefix of the other for long
    rows += [(60, None, "user", "no turn"), (60, 0, "user", "é" * 40_000), (60, 1, "user", ""), (61, 5, None, None), (None, 0, "user", "no id"), (2**62, 0, "user", "x")]
    rows += [(65, 3, "a", "equal")] * 4 + [(66, 3, "b", "tie"), (66, 3, "a", "tie"), (66, 3, "a", "second")]
    return rows


@pytest.mark.parametrize("bits", [64, 3])
def test_trie(spread, bits):
    """Three bits make most turns collide: the rows stay."""
    rows = odd_turns()
    got = prefixes.prefix_trie(clashing(spread.createDataFrame(rows, TURNS).repartition(5)), bits).collect()
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == plain_trie(rows)


def test_collisions_are_split(spark):
    turns = prefixes.ordered_turns(spark.createDataFrame(odd_turns(), TURNS), 3)
    _, entries = prefixes.rebuilt(turns)
    placed = prefixes.candidate_groups(entries)
    fresh = prefixes.split_collisions(placed, turns, 1)
    assert fresh is not None and fresh.count() == placed.count()
    assert placed.where("conv = rep").count() < len(plain_trie(odd_turns())) - 1


def test_trie_of_given_table_and_of_none(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    got = prefixes.op11_conversations(spark, sf_dir).collect()
    assert set(map(tuple, got)) == plain_trie([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])
    none = prefixes.prefix_trie(spark.createDataFrame([], TURNS))
    assert none.count() == 0 and none.dtypes == prefixes.op11_conversations(spark, sf_dir).dtypes


def test_long_conversation_is_spread(spread):
    """Half of all turns in one conversation: several partitions number it."""
    rows = [(1, t, "user", f"turn {t}") for t in range(4000)] + [(c, 0, "user", "x") for c in range(5, 4005)]
    table = prefixes.ordered_turns(spread.createDataFrame(rows, TURNS))
    written = spread.read.parquet(table.lumora_path)
    sizes = written.where("conv = 1").groupBy("pid").count().toPandas()["count"]
    assert len(sizes) > 1 and sizes.max() < 3000
    assert sorted(r["pos"] for r in table.where("conv = 1").collect()) == list(range(4000))


def test_powers():
    d = np.array([0, 1, 2, 63, 1000], np.int64)
    assert prefixes.powers(prefixes.BASE, d).tolist() == [pow(prefixes.BASE, int(k), 1 << 64) for k in d]
    assert prefixes.BASE * prefixes.INVERSE % (1 << 64) == 1


# 12


def plain_neighbors(rows):
    """(vec_id, n_links, component_id, kept) of each row."""
    usable = lambda r: r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])
    vectors = [np.asarray(r[1], np.float32).astype(float) if usable(r) else None for r in rows]
    n, root, links = len(rows), list(range(len(rows))), Counter()

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            a, b = vectors[i], vectors[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= 0.93:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return Counter((r[0], links[i], least.get(find(i)), r[0] == least.get(find(i))) for i, r in enumerate(rows))


def odd_vectors(d=64):
    rng = np.random.default_rng(3)
    rows = [(k, rng.standard_normal(d).tolist(), k % 3) for k in range(60)]
    for k in range(6):  # chains and groups about the least cosine
        v = np.array(rows[k][1])
        rows += [(100 + 20 * k + i, (v + rng.standard_normal(d) * np.linalg.norm(v) / 8 * s).tolist(), k % 3) for i, s in enumerate((0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5))]
    rows += [(300, rows[0][1], 0), (300, rows[0][1], 0), (None, rows[0][1], 0), (301, [2 * x for x in rows[0][1]], 0), (302, rows[0][1], 1), (303, rows[0][1], None), (303, rows[0][1], None)]
    rows += [(310, None, 0), (311, [], 0), (312, [0.0] * d, 0), (313, [0.0] * d, 0), (314, [float("nan")] + [1.0] * (d - 1), 0), (315, [float("inf")] + [1.0] * (d - 1), 0), (316, [None] + [1.0] * (d - 1), 0)]
    return rows + [(320, [1.0, 0.0], 0), (321, [1.0, 0.1], 0), (322, [3e38] * d, 2), (323, [1e-30] * d, 2), (None, [5.0, 5.0, 5.0], 1), (None, [5.0, 5.0, 5.0], 1)]


def test_neighbors(spark):
    rows = odd_vectors()
    got = neighbors.near_neighbors(clashing(spark.createDataFrame(rows, VECTORS).repartition(4)))
    assert Counter(map(tuple, got.collect())) == plain_neighbors(rows)


def test_neighbors_in_blocks(spark, monkeypatch):
    """Buckets dealt into blocks, units cut anywhere, tables a few at a time: the same rows."""
    monkeypatch.setattr(neighbors, "UNIT_ROWS", 4)
    monkeypatch.setattr(neighbors, "SMALL_ROWS", 3)
    monkeypatch.setattr(neighbors, "TABLES_AT_ONCE", 9)
    rng = np.random.default_rng(5)
    center = rng.standard_normal(64)
    rows = odd_vectors() + [(1000 + k, (center + rng.standard_normal(64) * 0.02).tolist(), 1) for k in range(60)]
    got = neighbors.near_neighbors(spark.createDataFrame(rows, VECTORS))
    assert Counter(map(tuple, got.collect())) == plain_neighbors(rows)


def test_units_count_once_without_pairs():
    import pandas as pd

    rng = np.random.default_rng(7)
    center = rng.standard_normal(64)
    v = neighbors.normalised(center + rng.standard_normal((50, 64)) * 0.01)
    seen = Counter()
    for table in range(3):
        names = neighbors.bucket_names(v, np.zeros(50, np.int64), 4, table).view(np.int64)
        rows = pd.DataFrame({"node": np.arange(50), "place": table, "bucket": names, "low": 0, "high": 0, "side": False, "alone": True, "v": list(v), "label": 0, "copies": 1}).sort_values("bucket")
        got = neighbors._linked(rows, 4, 0.93)
        assert len(got) <= 2 * len(rows)
        for a, n in zip(got["a"], got["n"]):
            seen[a] += n
    shared = np.zeros((50, 50), bool)
    for table in range(3):
        names = neighbors.bucket_names(v, np.zeros(50, np.int64), 4, table)
        shared |= names[:, None] == names
    assert [seen[k] for k in range(50)] == (shared.sum(1) - 1).tolist()


def test_agreement_and_names():
    rng = np.random.default_rng(11)
    a = neighbors.normalised(rng.standard_normal((4000, 64)))
    step = neighbors.normalised(rng.standard_normal((4000, 64)))
    b = neighbors.normalised(a + 0.374 * neighbors.normalised(step - (step * a).sum(1, keepdims=True) * a))
    same = np.mean([np.mean(neighbors.bucket_names(a, np.zeros(4000), 1, t) == neighbors.bucket_names(b, np.zeros(4000), 1, t)) for t in range(20)])
    distance = np.sqrt(np.square(a - b).sum(1)).mean()
    assert abs(same - neighbors.agreement(distance)) < 0.02
    one = neighbors.bucket_names(a, np.zeros(4000), 9, 5)
    assert all((neighbors.bucket_names(a[k : k + 7], np.zeros(7), 9, 5) == one[k : k + 7]).all() for k in (0, 100, 3990))
    directions, tables = neighbors.tables_for(5000)
    assert (1 - neighbors.agreement(math.sqrt(0.14)) ** directions) ** tables <= neighbors.LOSS


def test_neighbors_of_given_table_and_of_none(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert Counter(map(tuple, neighbors.op12_embeddings(spark, sf_dir).collect())) == plain_neighbors(rows)
    assert neighbors.near_neighbors(spark.createDataFrame([], VECTORS)).count() == 0


# 13


def plain_lloyd(rows, k=8, rounds=10):
    """vec_id, cluster and distance of each kept row, and the centroids, in Python integers."""
    kept = []
    for i, e, _ in rows:
        if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e):
            kept.append((i, [math.floor(1024 * min(131072.0, max(-131072.0, float(np.float32(x))))) for x in e]))
    centers = [v for _, _, v in sorted((i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest() if i is not None else "", v) for i, v in kept)][:k]
    assign = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, c)), j) for j, c in enumerate(centers))
    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in kept:
            members[assign(v)[1]].append(v)
        centers = [[sum(col) // len(members[j]) for col in zip(*members[j])] if members[j] else c for j, c in enumerate(centers)]
    return Counter((i, assign(v)[1], assign(v)[0]) for i, v in kept), centers


def checked(df, rows):
    want, centers = plain_lloyd(rows)
    got = df.collect()
    assert Counter((r["vec_id"], r["cluster"], r["distance"]) for r in got) == want
    inertia = Counter()
    for (_, c, d), n in want.items():
        inertia[c] += d * n
    for r in got:
        assert r["cluster_inertia"] == inertia[r["cluster"]] and r["inertia"] == sum(inertia.values())
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centers[r["cluster"]])).encode()).hexdigest()


def test_clusters(spark, monkeypatch):
    monkeypatch.setattr(clustering, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(2)
    rows = odd_vectors() + [(400 + k, (rng.standard_normal(64) * 0.01 + k % 11).tolist(), 0) for k in range(120)] + [(600, [0.5] * 64, 0)] * 40
    checked(clustering.clustered(clashing(spark.createDataFrame(rows, VECTORS).repartition(4))), rows)


def test_few_vectors_ties_and_none(spark, sf_dir):
    e = lambda *x: [float(v) for v in x] + [0.0] * (64 - len(x))
    rows = [(1, e(1), 0), (2, e(1), 0), (3, e(-1), 0), (3, e(0), 0), (None, e(0.5), 0)]
    checked(clustering.clustered(spark.createDataFrame(rows, VECTORS)), rows)
    assert clustering.clustered(spark.createDataFrame([(1, [1.0], 0)], VECTORS)).count() == 0
    given = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    checked(clustering.op13_centroids(spark, sf_dir), given)


@pytest.mark.parametrize("clusters", [1, 3, 40])
def test_dual_tree(clusters):
    """Walks against all distances, with copies, near copies and equal centroids."""
    rng = np.random.default_rng(clusters)
    points = np.concatenate([rng.integers(-9, 9, (300, 6)), rng.integers(-2, 2, (200, 6)) + 500, np.tile(rng.integers(-900, 900, 6), (50, 1)), rng.integers(-10**8, 10**8, (30, 6))])
    centers = np.concatenate([points[rng.choice(len(points), clusters)], points[:1], points[:1]])
    tree, over = clustering.CoverTree.over(points), clustering.CoverTree.over(centers, 1)
    chosen, distance = clustering.nearest(points, tree, centers, over)
    every = np.square(points[:, None] - centers).sum(2)
    assert (chosen == every.argmin(1)).all() and (distance == every.min(1)).all()
    # the cover tree's own promises
    for k in range(len(tree.start)):
        own = points[tree.order[tree.start[k] : tree.stop[k]]]
        assert (np.sqrt(np.square(own - points[tree.center[k]]).sum(1)) <= tree.radius[k]).all()
        kids = points[tree.center[tree.first[k] : tree.first[k] + tree.count[k]]]
        if len(kids) > 1:
            apart = np.sqrt(np.square(kids[:, None] - kids).sum(2))[~np.eye(len(kids), dtype=bool)]
            assert apart.min() > tree.radius[k] / 2 * 0.999
    assert sorted(tree.order.tolist()) == list(range(len(points)))
