"""SimHash near-duplicates by a self-join of binary tries of fingerprints.

A fingerprint has a bit set where over half of the text's shingle hashes have it. Equal fingerprints are merged
first, so copies cost one row. Two fingerprints within the budget of b bits agree on m - b of any m blocks of their 64
bits at least: each fingerprint goes to the C(m, b) buckets of its values on m - b blocks, so that all links are inside
buckets, and m is the least for which a bucket has BUCKET_ROWS rows on average or fewer (5 copies up to 4 million
distinct fingerprints, 15 up to 2 thousand million). A bucket's fingerprints form a binary trie that is joined with
itself: pairs of its nodes are walked down together, differing bits are added up, and a pair is dropped as soon as
they exceed the budget.

A bucket that is too large for a unit of work is split by the same rule once more: its fingerprints agree on the bucket's
bits, so two within the budget agree on one of budget + 1 blocks of the others at least, and go to a bucket for each. What is still too large
is dealt into blocks. First each block is joined with itself; then the rows outside the bucket's largest component meet every block. What a unit gives is a spanning forest of its links,
never all pairs, nearest first, so dense groups close early; components then come from joins over the forests.

Edge cases: null texts and texts without words have the fingerprint zero and are linked like any other; texts are
read whole, however long; rows with one doc_id and one text count as copies; a null doc_id never names a component
that has another; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _tries
from ._common import discard, documents, written
from ._graph import components

BITS = 4
SHINGLE = 4
SEED = 42
BUCKET_ROWS = 1024
MOST_COPIES = 100


def shingle_hashes(text: str | None, words_per_shingle: int = SHINGLE) -> np.ndarray:
    """Hash of each shingle of the whole text; a text shorter than a shingle is one, a text without words has none."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    n = max(1, len(words) - words_per_shingle + 1)
    ends = np.fromiter(map(len, words), np.int64, len(words)).cumsum() + np.arange(len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, n)


def folded(hashes: np.ndarray) -> int:
    """Unsigned 64-bit fingerprint of shingle hashes; zero if there are none."""
    n = len(hashes)
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        counts += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n).view(np.uint64)[0])


def fingerprint(text: str | None, words_per_shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of the whole text."""
    return folded(shingle_hashes(text, words_per_shingle))


def fingerprint_column(text: str = "text", words_per_shingle: int = SHINGLE) -> Column:
    """The fingerprint as a signed long."""

    def each(texts: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((fingerprint(t, words_per_shingle) for t in texts), np.uint64, len(texts)).view(np.int64))

    return F.pandas_udf(each, "long")(text)


def block_masks(n: int, bits: int = BITS) -> list[int]:
    """Masks of 64 bits; two fingerprints within the budget agree on one of them at least. More and longer ones for larger n."""
    m = bits + 1
    while n > BUCKET_ROWS << 64 * (m - bits) // m and comb(m + 1, bits) <= MOST_COPIES:
        m += 1
    ends = [64 * k // m for k in range(m + 1)]
    blocks = [(1 << 64 - a) - (1 << 64 - b) for a, b in zip(ends, ends[1:])]
    return [sum(kept) for kept in combinations(blocks, m - bits)]


def further_masks(mask: int, bits: int = BITS) -> list[int]:
    """Masks of the bits that a mask leaves; two fingerprints within the budget that agree on the mask agree on one of them too."""
    left = [k for k in range(64) if not mask >> k & 1]
    ends = [len(left) * k // (bits + 1) for k in range(bits + 2)]
    return [sum(1 << k for k in left[a:b]) for a, b in zip(ends, ends[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _passes(bits: int) -> list[tuple[int, None]]:
    return [(b, None) for b in (1, 2, 4, 8) if b < bits] + [(bits, None)]


def bucket_entries(distinct: DataFrame, n: int, bits: int = BITS) -> DataFrame:
    """node, fp and the bucket (mask, part, more, rest) of each entry of n distinct fingerprints; a bucket of more than UNIT_ROWS is split by further bits."""
    masks = block_masks(n, bits)
    signed = lambda values: F.array(*[F.lit(_signed(x)).cast("long") for x in values])
    entries = distinct.select("fp", F.posexplode(signed(masks)).alias("mask", "bits")).select(F.col("fp").alias("node"), "fp", "mask", F.col("fp").bitwiseAND(F.col("bits")).alias("part"))
    large = written(entries.groupBy("mask", "part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > _tries.UNIT_ROWS).select("mask", "part"), "simhash-large")
    whole = [F.lit(-1).alias("more"), F.lit(0).cast("long").alias("rest")]
    if large.isEmpty():
        discard(large)
        return entries.select("node", "fp", "mask", "part", *whole)
    further = F.element_at(F.array(*[signed(further_masks(m, bits)) for m in masks]), F.col("mask") + 1)
    split = entries.join(large, ["mask", "part"], "left_semi").select("node", "fp", "mask", "part", F.posexplode(further).alias("more", "bits")).withColumn("rest", F.col("fp").bitwiseAND(F.col("bits"))).drop("bits")
    return entries.join(large, ["mask", "part"], "left_anti").select("node", "fp", "mask", "part", *whole).unionByName(split)


def fingerprint_components(distinct: DataFrame, n: int, bits: int = BITS) -> DataFrame:
    """(node, label) of each of n distinct fingerprints (column fp) that has a link: label is the least of its component."""
    entries = bucket_entries(distinct, n, bits)
    keys = ["mask", "part", "more", "rest"]
    large = written(entries.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > _tries.UNIT_ROWS), "simhash-large")
    links = written(_tries.unit_pairs(_tries.one_block_units(entries.withColumn("label", F.col("node")), keys, large, "left"), lambda _: _passes(bits)), "simhash-links")
    labels = components(links, "simhash")
    if large.isEmpty():
        discard(links, large)
        return labels
    inside = entries.join(large.select(keys), keys, "left_semi")
    at = written(inside.join(labels, "node", "left").select("node", "fp", *keys, F.coalesce("label", "node").alias("label")), "simhash-inside")
    more = written(_tries.unit_pairs(_tries.cross_units(at, keys), lambda _: _passes(bits)), "simhash-links")
    out = components(links.union(more), "simhash")
    discard(links, at, more, labels, large)
    return out


def near_duplicates(docs: DataFrame, bits: int = BITS, words_per_shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (signed long) and component_id, the least doc_id that is reachable over links, itself included."""
    rows = written(docs.select("doc_id", fingerprint_column("text", words_per_shingle).alias("fp")), "simhash-rows")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least_doc")), "simhash-distinct")
    labels = fingerprint_components(distinct.select("fp"), distinct.count(), bits)
    labelled = written(distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least_doc", F.coalesce("label", "fp").alias("label")), "simhash-labelled")
    names = written(labelled.groupBy("label").agg(F.min("least_doc").alias("component_id")), "simhash-names")
    named = written(labelled.join(names, "label").select("fp", "component_id"), "simhash-named")
    discard(distinct, labels, labelled, names)
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
