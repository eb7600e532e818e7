"""Near copies: SimHash tries propose, the exact Jaccard similarity of the shingle sets decides.

At a similarity of 0.8 two 64-bit fingerprints differ in 9.7 bits on average and 18 at most but for 2 pairs in 1,000. At
such a budget one trie of all fingerprints would prune nothing until its nodes are single texts, so the trie self-join
runs inside buckets: a text (one for each shingle set) goes to BANDS of them, each named by the least values of BAND_ROWS
hash functions over its shingles; two texts at 0.8 share none with a probability of 0.0017. Pairs within the budget
whose set sizes and least values (SKETCH_PASSES) allow the similarity are verified on the sets.

First each bucket, in blocks if it is large, proposes a spanning forest of its candidate pairs, the most alike first, so a dense
group costs a pair a text. Then every candidate pair of a bucket whose texts are still in two components is verified;
the rows outside a bucket's largest component meet all its blocks, so no pair of two components is missed. No step has a
cap on partners or candidates.

Edge cases: null texts and texts without words have one empty set and are linked; a text shorter than a shingle is one
shingle; texts are read whole, however long; ids may repeat or be null, a null doc_id never names a component that has
another; an empty table gives no rows; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _tries
from ._common import discard, written
from ._graph import components
from .simhash import folded, shingle_hashes

BITS = 18
BANDS = 16
BAND_ROWS = 5
SKETCH = 256  # least values of a text; the first of them name its bands
#: Of a pair's least values those that are equal: 205 on average at 0.8, under 184 for 1 pair in 2,000.
SKETCH_PASSES = (244, 231, 218, 210, 202, 194, 184)
_FACTORS = np.random.default_rng(17).integers(1 << 62, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def least_values(own: np.ndarray) -> np.ndarray:
    """The least value of each hash function (an odd factor each) over distinct shingle hashes."""
    out = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(own), 1024):
        np.minimum(out, (own[k : k + 1024, None] * _FACTORS).min(0), out=out)
    return out


def bands(least: np.ndarray) -> np.ndarray:
    """A 64-bit name for each band."""
    rows = least[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(BAND_ROWS):
        out = (out ^ rows[:, k]) * _MIX
        out ^= out >> np.uint64(31)
    return out


def shingled_column(text: str, words_per_shingle: int) -> Column:
    """key (hash of the shingle set), fp (fingerprint), size, sketch (a byte of each least value), bands and the set, as 32 bits of each hash."""

    def each(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            hashes = shingle_hashes(t, words_per_shingle)
            own = np.unique(hashes)
            least = least_values(own)
            rows.append((xxhash.xxh3_64_intdigest(own.tobytes()), folded(hashes), len(own), (least >> np.uint64(8)).astype(np.uint8).tobytes(), bands(least).view(np.int64), np.unique((own >> np.uint64(32)).astype(np.uint32)).view(np.int32)))
        keys, fps, sizes, sketches, names, sets = zip(*rows) if rows else ((),) * 6
        signed = lambda x: np.array(x, np.uint64).view(np.int64)
        return pd.DataFrame({"key": signed(keys), "fp": signed(fps), "size": np.array(sizes, np.int32), "sketch": list(sketches), "bands": list(names), "shingles": list(sets)})

    return F.pandas_udf(each, "key long, fp long, size int, sketch binary, bands array<long>, shingles array<int>")(text)


def _passes(similarity: float, bits: int) -> Callable[[pd.DataFrame], list]:
    """Those that are surely alike come first, so that few links of a spanning forest fail on the sets."""

    def of(rows: pd.DataFrame) -> list:
        size = rows["size"].to_numpy()
        sketch = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(len(rows), -1)

        def alike(i: np.ndarray, j: np.ndarray, least: int) -> np.ndarray:
            ok = np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j])
            at = np.flatnonzero(ok)
            for k in range(0, len(at), 100_000):
                part = at[k : k + 100_000]
                ok[part] = (sketch[i[part]] == sketch[j[part]]).sum(1) >= least
            return ok

        def first_common(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            """The last pass, of pairs whose first common bucket is the unit's own, so that every pair comes once."""
            ok = alike(i, j, SKETCH_PASSES[-1])
            at = np.flatnonzero(ok)
            for k in range(0, len(at), 100_000):
                part = at[k : k + 100_000]
                x, y = named[i[part]], named[j[part]]
                ok[part] = x[np.arange(len(part)), (x == y).argmax(1)] == home[i[part]]
            return ok

        if "bands" not in rows:
            return [(bits, partial(alike, least=n)) for n in SKETCH_PASSES]
        named, home = np.stack(rows["bands"].to_numpy()), rows["home"].to_numpy()
        return [(bits, first_common)]

    return of


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose shingle sets (key, shingles) have that Jaccard similarity or more."""
    of = lambda end, name: sets.select(F.col("key").alias(end), F.col("shingles").alias(name))
    both = pairs.join(of("a", "x"), "a").join(of("b", "y"), "b")
    same = F.size(F.array_intersect("x", "y"))
    return both.withColumn("same", same).where(F.col("same") >= similarity * (F.size("x") + F.size("y") - F.col("same"))).select("a", "b")


def near_copies(docs: DataFrame, words_per_shingle: int, similarity: float, bits: int = BITS) -> DataFrame:
    """doc_id, key and component_id, the least doc_id that is reachable over links of that similarity, itself included."""
    made = docs.select("doc_id", shingled_column("text", words_per_shingle).alias("s"))
    rows = written(made.select("doc_id", "s.*"), "nearcopies-rows")
    # what is no id is a function of the key, but for fp, where texts differ in repeats alone
    once = written(rows.groupBy("key").agg(F.min("doc_id").alias("least_doc"), F.first("bands").alias("bands")), "nearcopies-once")
    named = once.select(F.col("key").alias("node"), F.explode("bands").alias("band"))
    shared = written(named.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "nearcopies-bands")
    inside = written(named.join(shared.select("band"), "band", "left_semi"), "nearcopies-inside")
    # the texts that share no bucket, most of them, end here; as a table of its own the planner knows how small the rest is, and where it is small no set is shuffled to find it
    nodes = written(inside.select(F.col("node").alias("key")).distinct(), "nearcopies-nodes")
    sets = rows.where("size > 0").select("key", "fp", "size", "sketch", "bands", "shingles").join(nodes, "key", "left_semi")
    sets = sets.groupBy("key").agg(F.min("fp").alias("fp"), *[F.first(c).alias(c) for c in ("size", "sketch", "bands", "shingles")])
    sets = written(sets, "nearcopies-sets")
    discard(nodes)
    sketches = sets.select(F.col("key").alias("node"), "fp", "size", "sketch", "bands")
    passes = _passes(similarity, bits)
    dealt = _tries.one_block_units(inside.withColumn("home", F.col("band")), ["band"], shared, "inner")
    dealt = dealt.join(sketches.drop("bands"), "node").withColumn("label", F.col("node"))
    first = written(_tries.unit_pairs(dealt, passes), "nearcopies-pairs")
    links = written(verified(first, sets, similarity), "nearcopies-links")
    labels = components(links, "nearcopies")
    at = written(inside.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "nearcopies-labelled")
    dealt = _tries.cross_units(at.withColumn("home", F.col("band")), ["band"]).join(sketches, "node")
    rest = written(_tries.unit_pairs(dealt, passes, every=True).join(first, ["a", "b"], "left_anti"), "nearcopies-pairs")
    discard(shared, inside, first, at)
    more = written(verified(rest, sets, similarity), "nearcopies-links")
    if not more.isEmpty():
        labels = components(links.union(more), "nearcopies")
    discard(rest, links, more, sets)
    labelled = once.select("key", "least_doc").join(labels.withColumnRenamed("node", "key"), "key", "left").select("key", "least_doc", F.coalesce("label", "key").alias("label"))
    names = labelled.groupBy("label").agg(F.min("least_doc").alias("component_id"))
    named = written(labelled.join(names, "label").select("key", "component_id"), "nearcopies-named")
    found = written(rows.select("doc_id", "key").join(named, "key").select("doc_id", "key", "component_id"), "nearcopies-found")
    discard(once, named, rows)
    return found


def deduplicated(docs: DataFrame, words_per_shingle: int, similarity: float, bits: int = BITS) -> DataFrame:
    """The rows of docs that name their group: one document of each. Columns stay as they are.

    Where ids repeat (null ids count as one), rows are told apart by their text too: of those that share the id of the
    group and its shingle set, the one with the least text stays, once.
    """
    found = near_copies(docs, words_per_shingle, similarity, bits)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept_id"), F.col("key").alias("kept_key"))
    if found.groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").alias("kept_id"), shingled_column("text", words_per_shingle)["key"].alias("kept_key"))
    once = kept.distinct()
    one = whole.join(once, whole["kept_id"].eqNullSafe(once["kept_id"]) & (whole["kept_key"] == once["kept_key"]), "left_semi")
    rank = F.struct(F.col("row.text"), F.xxhash64("row"))
    return one.groupBy("kept_id", "kept_key").agg(F.min_by("row", rank).alias("row")).select("row.*")
