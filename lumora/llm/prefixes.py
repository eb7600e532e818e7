"""Prefix trie of conversations by rolling fingerprints, verified turn by turn, with rollups over subtrees.

Turns are put in order by a range sort, so that a conversation of any length is spread over tasks: each task numbers the
turns of its part, and one row a task says where the next task goes on. A rebuilt conversation's fingerprint at depth d is
the sum of hash(turn i) * BASE ** (d - i) over its first d turns, modulo 2 ** 64. In a task that is a numpy scan: prefix
sums of hash(turn i) * BASE ** -i, times BASE ** d; what the tasks before have of the conversation is added likewise.

Prefixes of one depth and fingerprint are a candidate group, whose representative is its least conversation. Each member's
last turn is compared with the representative's, role and text, and so is the fingerprint one turn before; with the same
comparisons at all lesser depths that is a comparison of whole prefixes. Where members differ, their turn gets a hash of
its own and fingerprints are made again, until no member differs, so collisions are split exactly. Texts are fetched only
where two rows of the table are compared, each pair once however many conversations share it, and equal texts of a
representative's group are merged before they meet it.

A node is its least member and its depth. Sums over subtrees take a join for each power of two up to the greatest depth: at
step s a node adds what nodes s levels below it have gathered, and the ancestor s levels up is looked up as the prefix of
the node's own conversation. Lists of members are hashed from pieces of ids that are joined where rows are sorted, so the
task that hashes a long list reads a row a piece.

Edge cases: rows without conv_id are left out; a null role or text is empty; equal turns of a conversation go by the first
characters of role and text, then by a hash of both; equal rows are turns of their own; c - c % 5 and c % 5 are as in SQL
(signs too); a conversation without turns after the rebuilding is a member of the root alone; an empty table gives no rows,
not even a root; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import discard, written

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
FAMILY = 5
LEADS = 9
PIECE_IDS = 4096
_ONE = np.uint64(1)


def powers(base: int, exponents: np.ndarray) -> np.ndarray:
    """base ** exponents modulo 2 ** 64."""
    left, square, out = exponents.astype(np.uint64), np.uint64(base), np.ones(len(exponents), np.uint64)
    while left.any():
        out[(left & _ONE).astype(bool)] *= square
        square = np.multiply(square, square, dtype=np.uint64)
        left >>= _ONE
    return out


def turn_terms(turn: np.ndarray, depth: np.ndarray) -> np.ndarray:
    return turn.view(np.uint64) * powers(INVERSE, depth)


def scanned(df: DataFrame, key: str, amounts: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """df, whose partitions are ranges in order of key, with pid and upto: the sum (modulo 2 ** 64) of amounts of the key's rows in this partition up to the row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, last, total = TaskContext.get().partitionId(), None, np.uint64(0)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, own = batch.column(key).to_numpy(), amounts(batch)
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            sums = own.cumsum(dtype=np.uint64)
            upto = sums - np.repeat(sums[first] - own[first], np.diff(np.append(first, len(keys))))
            if keys[0] == last:
                upto[: first[1] if len(first) > 1 else len(keys)] += total
            last, total = keys[-1], upto[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(keys), pid, np.int32)), pa.array(upto.view(np.int64))], [*batch.schema.names, "pid", "upto"])

    return df.mapInArrow(each, T.StructType([*df.schema.fields, T.StructField("pid", T.IntegerType()), T.StructField("upto", T.LongType())]))


def carried(table: DataFrame, key: str, order: Column) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """What the partitions before have of a row's key, from (pid, key). One row of each partition comes to the driver; order: the last row of a key has the greatest."""
    ends = table.groupBy("pid").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.max_by("upto", F.struct(key, order)).alias("total")).orderBy("pid").collect()
    pids, firsts, sums, last, total = [], [], [], None, 0
    for r in ends:
        if r["first"] == last:
            pids.append(r["pid"])
            firsts.append(r["first"])
            sums.append(total % (1 << 64))
        total = r["total"] + (total if r["last"] == last else 0)
        last = r["last"]
    pids, firsts, sums = np.array(pids, np.int64), np.array(firsts, np.int64), np.array(sums, np.uint64)

    def of(pid: np.ndarray, keys: np.ndarray) -> np.ndarray:
        if not len(pids):
            return np.zeros(len(pid), np.uint64)
        at = np.minimum(np.searchsorted(pids, pid), len(pids) - 1)
        return np.where((pids[at] == pid) & (firsts[at] == keys), sums[at], np.uint64(0))

    return of


def ordered_turns(conversations: DataFrame, turn_bits: int = 64) -> DataFrame:
    """conv, pos (from 0, in order of turn, null first), role, text, t (turn_bits bits of the turn's hash) and bytes of every turn."""
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("t", F.xxhash64("role", "text")).withColumn("uid", F.monotonically_increasing_id())
    order = ["conv", F.asc_nulls_first("turn"), F.substring("role", 1, 32), F.substring("text", 1, 64), "t", "uid"]
    table = scanned(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("turn", "uid"), "conv", lambda batch: np.ones(batch.num_rows, np.uint64))
    table = written(table, "prefixes-turns")
    before = carried(table, "conv", F.col("upto"))

    def position(pid: pd.Series, conv: pd.Series, upto: pd.Series) -> pd.Series:
        return upto + before(pid.to_numpy(), conv.to_numpy()).view(np.int64) - 1

    t = F.col("t") if turn_bits == 64 else F.col("t").bitwiseAND(F.lit((1 << turn_bits) - 1).cast("long"))
    out = table.select("conv", F.pandas_udf(position, "long")("pid", "conv", "upto").alias("pos"), "role", "text", t.alias("t"), F.octet_length("text").cast("long").alias("bytes"))
    out.lumora_path = table.lumora_path
    return out


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations: conv and length; turns: conv, d from 1, t, bytes and the row (sc, sp) that a turn comes from).

    A conversation takes the first h turns of the first of its family of FAMILY, then its own turns after its first h.
    """
    sizes = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    head = (F.crc32(F.col("conv").cast("string")) % LEADS).alias("h")
    own = sizes.select("conv", "n", head, (F.col("conv") - F.col("conv") % FAMILY).alias("donor"))
    own = own.join(sizes.select(F.col("conv").alias("donor"), F.col("n").alias("given")), "donor", "left")
    own = own.select("conv", "h", "donor", F.least("h", F.coalesce("given", F.lit(0))).alias("m"), "n")
    own = written(own.withColumn("length", F.col("m") + F.greatest(F.lit(0), F.col("n") - F.col("h"))), "prefixes-conversations")
    mine = turns.select("conv", "pos", "t", "bytes")
    leads = mine.where(F.col("pos") < LEADS).withColumnRenamed("conv", "donor")
    # at most LEADS turns of a donor, and as many takers as its family has
    lead = own.select("conv", "donor", "m").join(leads, "donor").where("pos < m").select("conv", (F.col("pos") + 1).alias("d"), "t", "bytes", F.col("donor").alias("sc"), F.col("pos").alias("sp"))
    rest = mine.join(own.select("conv", "h", "m"), "conv").where("pos >= h").select("conv", (F.col("m") + F.col("pos") - F.col("h") + 1).alias("d"), "t", "bytes", F.col("conv").alias("sc"), F.col("pos").alias("sp"))
    return own, lead.union(rest)


def candidate_groups(entries: DataFrame) -> DataFrame:
    """entries with rep, n (the least conversation and the size of the group of equal depth and fingerprint), prev, and the representative's rsc, rsp, rprev."""
    ranged = entries.repartitionByRange("conv", "d").sortWithinPartitions("conv", "d")
    table = scanned(ranged, "conv", lambda batch: turn_terms(batch.column("t").to_numpy(), batch.column("d").to_numpy()))
    table = written(table, "prefixes-scanned")
    before = carried(table, "conv", F.col("d"))

    def fingerprints(conv: pd.Series, d: pd.Series, t: pd.Series, pid: pd.Series, upto: pd.Series) -> pd.DataFrame:
        depth = d.to_numpy()
        fp = powers(BASE, depth) * (upto.to_numpy().view(np.uint64) + before(pid.to_numpy(), conv.to_numpy()))
        prev = (fp - t.to_numpy().view(np.uint64)) * np.uint64(INVERSE)
        return pd.DataFrame({"fp": fp.view(np.int64), "prev": prev.view(np.int64)})

    made = table.select("conv", "d", "t", "bytes", "sc", "sp", F.pandas_udf(fingerprints, "fp long, prev long")("conv", "d", "t", "pid", "upto").alias("f"))
    made = written(made.select("conv", "d", "t", "bytes", "sc", "sp", "f.*"), "prefixes-fingerprints")
    several = made.groupBy("d", "fp").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("conv", "sc", "sp", "prev")).alias("r")).where("n > 1")
    placed = made.join(several, ["d", "fp"], "left")
    mine = {"rep": "conv", "rsc": "sc", "rsp": "sp", "rprev": "prev"}
    out = placed.select("conv", "d", "t", "bytes", "sc", "sp", "prev", F.coalesce("n", F.lit(1)).alias("n"), *[F.coalesce(f"r.{c}", c).alias(name) for name, c in mine.items()])
    out = written(out, "prefixes-groups")
    discard(table, made)
    return out


def split_collisions(placed: DataFrame, turns: DataFrame, seed: int) -> DataFrame | None:
    """The entries of placed with hashes of their own where a member differs from its representative; None if none does."""
    pairs = placed.where("sc <> rsc OR sp <> rsp").select("sc", "sp", "rsc", "rsp").distinct()
    of = lambda c, p, role, text: turns.select(F.col("conv").alias(c), F.col("pos").alias(p), F.col("role").alias(role), F.col("text").alias(text))
    told = written(pairs.join(of("sc", "sp", "role", "text"), ["sc", "sp"]), "prefixes-pairs")
    kinds = told.groupBy("rsc", "rsp", "role", "text").agg(F.count(F.lit(1)).alias("pairs"))
    wrong = kinds.join(of("rsc", "rsp", "own_role", "own_text"), ["rsc", "rsp"]).where("role <> own_role OR text <> own_text").select("rsc", "rsp", "role", "text")
    wrong = written(wrong, "prefixes-wrong")
    parted = F.col("prev") != F.col("rprev")
    try:
        if wrong.isEmpty() and placed.where(parted).isEmpty():
            return None
        fresh = told.join(wrong, ["rsc", "rsp", "role", "text"]).select("sc", "sp", "rsc", "rsp", F.xxhash64(F.lit(seed), "role", "text").alias("fresh"))
        marked = placed.join(fresh, ["sc", "sp", "rsc", "rsp"], "left")
        t = F.coalesce("fresh", F.when(parted, F.xxhash64(F.lit(seed), "t", "prev")), "t")
        return written(marked.select("conv", "d", t.alias("t"), "bytes", "sc", "sp"), "prefixes-entries")
    finally:
        discard(told, wrong)


def member_hashes(ends: DataFrame) -> DataFrame:
    """rep, d and ends_sha256: the hash of the comma-joined conv of each (rep, d), ascending."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            node = batch[["rep", "d"]].to_numpy()
            cuts = np.flatnonzero(np.append(True, (node[1:] != node[:-1]).any(1)))
            cuts = np.unique(np.concatenate([cuts, np.arange(0, len(batch), PIECE_IDS)]))
            ids = batch["conv"].tolist()
            text = [",".join(map(str, ids[a:b])) for a, b in zip(cuts, [*cuts[1:], len(ids)])]
            yield pd.DataFrame({"rep": node[cuts, 0], "d": node[cuts, 1], "least": batch["conv"].to_numpy()[cuts], "piece": text})

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, state = None, None
        for batch in batches:
            done = []
            for rep, d, piece in zip(batch["rep"].tolist(), batch["d"].tolist(), batch["piece"]):
                if (rep, d) == node:
                    state.update(b"," + piece.encode())
                    continue
                if node:
                    done.append((*node, state.hexdigest()))
                node, state = (rep, d), hashlib.sha256(piece.encode())
            yield pd.DataFrame(done, columns=["rep", "d", "ends_sha256"])
        if node:
            yield pd.DataFrame([(*node, state.hexdigest())], columns=["rep", "d", "ends_sha256"])

    keys = ["rep", "d", "conv"]
    made = ends.select(keys).repartitionByRange(*keys).sortWithinPartitions(*keys).mapInPandas(pieces, "rep long, d long, least long, piece string")
    return made.repartition("rep", "d").sortWithinPartitions("rep", "d", "least").mapInPandas(hashed, "rep long, d long, ends_sha256 string")


def rolled_up(nodes: DataFrame, paths: DataFrame, root: int) -> DataFrame:
    """nodes (conv, d, parent, leaves, saved) with leaves and saved summed over subtrees. paths: (conv, d, rep) of every prefix."""
    deepest, step, sums = nodes.agg(F.max("d")).first()[0], 1, nodes
    while step <= deepest:
        low = sums.where(F.col("d") >= step)
        if step == 1:
            up = low.withColumn("above", F.col("parent"))
        else:
            lookup = paths.select("conv", (F.col("d") + step).alias("d"), F.col("rep").alias("above"))
            up = low.where(F.col("d") > step).join(lookup, ["conv", "d"]).unionByName(low.where(F.col("d") == step).withColumn("above", F.lit(root).cast("long")))
        more = up.groupBy(F.col("above").alias("conv"), (F.col("d") - step).alias("d")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        added = [(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")]
        following = written(sums.join(more, ["conv", "d"], "left").select("conv", "d", "parent", *added), "prefixes-sums")
        discard(sums)
        sums, step = following, step * 2
    return sums


_RESULT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def prefix_trie(conversations: DataFrame, turn_bits: int = 64) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations. turn_bits under 64 makes turns collide, which changes no row."""
    spark = conversations.sparkSession
    turns = ordered_turns(conversations, turn_bits)
    own, entries = rebuilt(turns)
    least = own.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n")).first()
    if not least["n"]:
        return spark.createDataFrame([], _RESULT)
    root, seed, earlier = least["conv"], 0, []
    while True:
        placed = candidate_groups(entries)
        seed += 1
        entries = split_collisions(placed, turns, seed)
        discard(*earlier)
        if entries is None:
            break
        earlier = [placed, entries]
    discard(turns)
    at_root = F.lit(root).cast("long")
    paths = written(placed.select("conv", "d", "rep", "n", "bytes"), "prefixes-paths")
    discard(placed)
    own_nodes = paths.where("conv = rep").select("conv", "d", "n", ((F.col("n") - 1) * F.col("bytes")).alias("saved"))
    above = paths.select("conv", (F.col("d") + 1).alias("d"), F.col("rep").alias("found"))
    own_nodes = own_nodes.join(above, ["conv", "d"], "left").withColumn("parent", F.coalesce("found", at_root)).drop("found")
    top = spark.createDataFrame([(root, 0, least["n"], 0, None)], "conv long, d long, n long, saved long, parent long")
    nodes = own_nodes.unionByName(top)
    children = own_nodes.groupBy(F.col("parent").alias("conv"), (F.col("d") - 1).alias("d")).agg(F.count(F.lit(1)).alias("children"))
    nodes = written(nodes.join(children, ["conv", "d"], "left").withColumn("children", F.coalesce("children", F.lit(0))), "prefixes-nodes")
    start = nodes.select("conv", "d", "parent", (F.col("children") == 0).cast("long").alias("leaves"), "saved")
    sums = rolled_up(start, paths, root)
    last = own.select("conv", F.col("length").alias("d"))
    ends = last.where("d > 0").join(paths.select("conv", "d", "rep"), ["conv", "d"]).unionByName(last.where("d = 0").withColumn("rep", at_root))
    hashes = member_hashes(ends).withColumnRenamed("rep", "conv")
    out = nodes.drop("saved", "parent").join(sums, ["conv", "d"]).join(hashes, ["conv", "d"], "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select(
        F.col("conv").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: Nodes are prefixes of lists of turns; subtrees come from each conversation's own prefixes.
SQL = f"""WITH own AS MATERIALIZED (
  SELECT conv_id AS c, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role, text) AS turns,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, bit: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) % {LEADS} AS h
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), made AS MATERIALIZED (
  SELECT own.c, list_concat(coalesce(donor.turns[1:own.h], []), own.turns[own.h + 1:]) AS turns FROM own LEFT JOIN own donor ON donor.c = own.c - own.c % {FAMILY}
), prefixes AS MATERIALIZED (
  SELECT c, d, turns[1:d] AS prefix, len(turns) = d AS ends FROM (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM made)
), nodes AS MATERIALIZED (
  SELECT d, prefix, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '') AS members,
    (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE octet_length(encode(prefix[d].text)) END AS saved FROM prefixes GROUP BY d, prefix
), paths AS MATERIALIZED (SELECT p.c, p.d, n.conv_id FROM prefixes p JOIN nodes n ON n.d = p.d AND n.prefix = p.prefix),
children AS MATERIALIZED (
  SELECT p.conv_id, p.d, count(*) AS n_children FROM nodes n JOIN paths p ON p.c = n.conv_id AND p.d = n.d - 1 GROUP BY p.conv_id, p.d
), subtrees AS (
  SELECT p.conv_id, p.d, sum(n.saved) AS saved_tokens, count(*) FILTER (k.conv_id IS NULL) AS n_leaves
  FROM nodes n JOIN paths p ON p.c = n.conv_id AND p.d <= n.d LEFT JOIN children k ON k.conv_id = n.conv_id AND k.d = n.d GROUP BY p.conv_id, p.d
)
SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(n.members) AS ends_sha256
FROM nodes n JOIN subtrees s ON s.conv_id = n.conv_id AND s.d = n.d LEFT JOIN children k ON k.conv_id = n.conv_id AND k.d = n.d LEFT JOIN paths p ON p.c = n.conv_id AND p.d = n.d - 1"""
