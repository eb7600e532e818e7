"""Benchmark decontamination by the q-gram lemma, in overlapping diagonal bands, verified by banded alignment.

Texts are compared as lower-case letters and digits with single spaces. A benchmark item is one pattern, or, if it
is long, overlapping windows, so that a passage of an item is found too: one of WINDOW + STRIDE - 1 normalised characters
is sure to hold a window; of an item that is one pattern (up to WINDOW + STRIDE / 2) the whole is looked for. A pattern of
m characters that matches a region with at most e edits shares at least m - q + 1 - q * e of its q-grams with it, all on
neighbouring diagonals (position in the text less position in the pattern). Shared q-grams are therefore counted in
diagonal bands, each overlapping the next by half; bands that reach the bound are verified by an alignment within the band.

A task lays its rows end to end with gaps that no band and no alignment can cross, so a row's regions do not depend on
its neighbours. The benchmark is the stated query set. It is dealt into blocks of about BLOCK_BYTES, which tasks index, each
once, as files in the shared folder. A task that scans documents normalises and hashes HELD_CHARS of texts once and then
loads one block's index after the other, so neither tasks nor the driver hold more than a block, no index is made twice,
and all documents are scanned once whatever the number of blocks.

Edge cases: null and empty texts, and items with fewer than q characters after normalising, match nothing; an
item of null text is skipped; items with the same text are all reported; repeated documents each have their rows;
texts are matched whole, however long; of equally good regions of an item the first counts; an empty table on either
side gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, filesystem, fresh_path, ids_of, rows_frame, split_id

Q = 8
EDIT_RATE = 0.08
WINDOW = 60
STRIDE = 20
BLOCK_BYTES = 1 << 20
HELD_CHARS = 4 << 20  # texts that meet all blocks together
CHUNK_CHARS = 1 << 18
FILTER_BITS = 22
SCHEMA = "doc_id long, item_id long, start long, end long, edits int, pattern_chars int, shared int"

_MULT = np.uint64(0x9E3779B97F4A7C15)
_CASE = np.array([0] + [ord(chr(c).lower()) if len(chr(c).lower()) == 1 and chr(c).lower().isalnum() else 32 for c in range(1, 0x10000)], np.uint32)
#: Rows further apart than this share no band and no alignment, whatever the patterns: the longest is one that is looked for whole.
_LONGEST = WINDOW + STRIDE // 2
ROW_GAP = _LONGEST + 5 * (int(_LONGEST * EDIT_RATE) + 1)
GAP = "\0"  # stays as it is when a text is normalised; such characters of a text or item become spaces first


def normalised(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-case letters and digits with single spaces, and each one's place in the text; gap characters stay."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.where(raw < 0x10000, _CASE[np.minimum(raw, 0xFFFF)], raw)
    keep = low != 32
    keep[1:] |= keep[:-1]  # the first of a run of separators stays as a space
    if len(keep) and low[0] == 32:
        keep[0] = False
    at = np.flatnonzero(keep)
    low = low[at]
    if len(low) and low[-1] == 32:
        low, at = low[:-1], at[:-1]
    return low, at


def grams(points: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 8 characters from each position on, by doubling the length three times."""
    h, step = points.astype(np.uint64) * _MULT, _MULT
    h ^= h >> np.uint64(29)
    for k in (1, 2, 4):
        if len(h) <= k:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            h = h[:-k] * step + h[k:]
            step = step * step
    return h


class Patterns:
    """The q-gram index of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, str | None]], window: int = WINDOW, stride: int = STRIDE, rate: float = EDIT_RATE):
        self.points, self.item = [], []
        for item, text in items:
            p, _ = normalised((text or "").replace(GAP, " "))
            if len(p) < Q:
                continue
            starts = [0] if len(p) <= window + stride // 2 else sorted({*range(0, len(p) - window + 1, stride), len(p) - window})
            for s in starts:
                self.points.append(p if len(starts) == 1 else p[s : s + window])
                self.item.append(item)
        m = np.array([len(p) for p in self.points], np.int64)
        # no more edits than leave a bound of one shared q-gram at least
        self.edits = np.minimum((m * rate).astype(np.int64), np.maximum((m - Q) // Q, 0)) if len(m) else m
        self.least = m - Q + 1 - Q * self.edits
        self.m = m
        self.padded = np.zeros((len(m), int(m.max()) if len(m) else 0), np.uint32)
        for k, p in enumerate(self.points):
            self.padded[k, : len(p)] = p
        hashes = [grams(p) for p in self.points]
        owner = np.repeat(np.arange(len(m)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.zeros(0, np.int64)
        every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.hash, self.first, self.n = np.unique(every[order], return_index=True, return_counts=True)
        self.owner, self.place = owner[order].astype(np.int32), place[order].astype(np.int32)
        if len(m) and int(m.max() + 5 * (self.edits.max() + 1)) > ROW_GAP:
            raise ValueError("patterns are longer than the gaps between rows allow")
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.hash >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    _ARRAYS = ("m", "edits", "least", "padded", "hash", "first", "n", "owner", "place")

    def saved(self) -> bytes:
        """The index as a file's bytes."""
        out = io.BytesIO()
        ids = np.array([i if i is not None else 0 for i in self.item], np.int64)
        np.savez(out, **{a: getattr(self, a) for a in self._ARRAYS}, filter=np.packbits(self.filter), item=ids, item_null=np.array([i is None for i in self.item], bool))
        return out.getvalue()

    @classmethod
    def loaded(cls, data: bytes) -> Patterns:
        own = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as file:
            for a in cls._ARRAYS:
                setattr(own, a, file[a])
            own.filter = np.unpackbits(file["filter"]).view(bool)
            own.item = [None if null else i for i, null in zip(file["item"].tolist(), file["item_null"].tolist())]
        return own


def aligned(patterns: np.ndarray, lengths: np.ndarray, text: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each row of patterns (padded; its length) against text on the diagonals from its start on, and the text end (exclusive)."""
    off, longest = np.arange(width, dtype=np.int32), patterns.shape[1]
    pad = width + longest + 1
    padded = np.concatenate([np.zeros(pad, np.uint32), text, np.zeros(pad, np.uint32)])
    view = np.lib.stride_tricks.sliding_window_view(padded, width + longest)[np.clip(starts + pad, 0, len(padded) - width - longest)]
    cost = np.zeros((len(starts), width), np.int32)  # any diagonal may begin
    for i in range(longest):
        step = cost + (view[:, i : i + width] != patterns[:, i : i + 1])
        np.minimum(step[:, :-1], cost[:, 1:] + 1, out=step[:, :-1])  # a pattern character without partner
        step -= off
        np.minimum.accumulate(step, axis=1, out=step)  # text characters without partner
        step += off
        cost = step if i < lengths.min() else np.where((lengths > i)[:, None], step, cost)
    best = cost.argmin(1)
    return cost[np.arange(len(starts)), best], starts + best + lengths


def matches(points: np.ndarray, begins: np.ndarray, pats: Patterns, h: np.ndarray) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(row, pattern, start, end, edits, shared) of verified regions in the points (with their grams h) of rows that begin at begins."""
    if not len(h) or not len(pats.hash):
        return
    hit = np.flatnonzero(pats.filter[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
    k = np.minimum(np.searchsorted(pats.hash, h[hit]), len(pats.hash) - 1)
    true = pats.hash[k] == h[hit]
    hit, k = hit[true], k[true]
    # every region has at least the bound of hits within its length: others need no further look
    span, least = int((pats.m + pats.edits).max()), int(pats.least.min())
    before = np.zeros(len(points) + span + 1, np.int32)
    before[hit + 1] = 1
    before = before.cumsum()
    full = np.zeros(len(points) + span + 1, np.int32)
    dense = np.flatnonzero(before[span:] - before[: len(before) - span] >= least)
    full[dense] += 1
    full[dense + span] -= 1
    near = full.cumsum()[hit] > 0
    hit, k = hit[near], k[near]
    if not len(hit):
        return
    n = pats.n[k]
    rows = np.repeat(np.arange(len(hit)), n)
    entry = pats.first[k][rows] + np.arange(len(rows)) - np.repeat(n.cumsum() - n, n)
    owner, row = pats.owner[entry].astype(np.int64), np.searchsorted(begins, hit[rows], side="right") - 1
    half = int(pats.edits.max()) + 1
    # a region lies in one band of two halves: the one that it begins or the one before; bands are counted from the row's begin
    band = (hit[rows] - pats.place[entry] - begins[row] + span) // half
    wide = int(band.max()) + 2
    keys, counts = np.unique((row * len(pats.m) + owner) * wide + band, return_counts=True)
    nxt = np.searchsorted(keys, keys + 1)
    follow = np.where((nxt < len(keys)) & (keys[np.minimum(nxt, len(keys) - 1)] == keys + 1), counts[np.minimum(nxt, len(keys) - 1)], 0)
    both = counts + follow
    good = both >= pats.least[keys // wide % len(pats.m)]
    keys, both = keys[good], both[good]
    row, owner = keys // wide // len(pats.m), keys // wide % len(pats.m)
    low = keys % wide * half - span + begins[row]
    for k in range(0, len(owner), 4096):
        p = owner[k : k + 4096]
        m, e = pats.m[p], pats.edits[p]
        edits, ends = aligned(pats.padded[p], m, points, low[k : k + 4096] - half, 4 * half)
        for x in np.flatnonzero(edits <= e).tolist():
            yield int(row[k + x]), int(p[x]), max(0, int(ends[x] - m[x])), min(int(ends[x]), len(points)), int(edits[x]), int(both[k + x])


@dataclass
class Laid:
    """Some rows end to end: which they are, where each begins in the text and among the points, the points with their places, and their grams."""

    rows: np.ndarray
    starts: np.ndarray
    begins: np.ndarray
    points: np.ndarray
    place: np.ndarray
    grams: np.ndarray


def laid_out(texts: list[str | None]) -> Iterator[Laid]:
    """The rows in runs of some length, whatever the rows, with gaps in between."""

    def laid() -> Iterator[Laid]:
        points, place = normalised((GAP * ROW_GAP).join(parts))
        if len(points):
            begins = np.searchsorted(place, starts)
            begins += points[np.minimum(begins, len(points) - 1)] == 32
            yield Laid(np.array(rows), np.array(starts), begins, points, place, grams(points))

    rows, starts, parts, total = [], [], [], 0
    for row, text in enumerate(texts):
        if text:
            rows.append(row)
            starts.append(total)
            parts.append(text.replace(GAP, " "))
            total += len(text) + ROW_GAP
            if total >= CHUNK_CHARS:
                yield from laid()
                rows, starts, parts, total = [], [], [], 0
    if rows:
        yield from laid()


def _add_regions(out: dict, texts: list[str | None], laid: Iterable[Laid], pats: Patterns) -> None:
    """Keeps the best region of each row and item: (rank, (start, end, edits, pattern characters, shared)); places in the text."""
    for run in laid:
        for k, p, start, end, edits, shared in matches(run.points, run.begins, pats, run.grams):
            first, row = int(run.starts[k]), int(run.rows[k])
            low, high = max(int(run.place[start]) - first, 0), min(int(run.place[max(end - 1, start)]) + 1 - first, len(texts[row]))
            best = (edits / pats.m[p], -int(pats.m[p]), low, high)
            if (row, pats.item[p]) not in out or best < out[row, pats.item[p]][0]:
                out[row, pats.item[p]] = (best, (low, high, edits, int(pats.m[p]), shared))


def regions(texts: list[str | None], pats: Patterns) -> dict[tuple[int, int | None], tuple]:
    """The best region of each row and item."""
    out: dict[tuple[int, int | None], tuple] = {}
    _add_regions(out, texts, laid_out(texts), pats)
    return out


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[str]:
    """Indexes the items in blocks of about block_bytes of text each; the addresses of the indexes. An item longer than a block makes its block longer.

    A task writes under a name of its own, and only the addresses that Spark returns count.
    """
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    folder = fresh_path(benchmark.sparkSession, "decontam-index")

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = [(None if null else i, t) for batch in batches for i, null, t in zip(batch["id"].tolist(), batch["id_null"].tolist(), batch["text"])]
        if own:
            address = f"{folder}/{uuid.uuid4().hex}.npz"
            fs, path = filesystem(address)
            fs.create_dir(path.rpartition("/")[0], recursive=True)
            with fs.open_output_stream(path) as out:
                out.write(Patterns(sorted(own, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))).saved())
            yield pd.DataFrame({"address": [address]})

    ids = [F.coalesce("item_id", F.lit(0).cast("long")).alias("id"), F.col("item_id").isNull().alias("id_null"), F.col("text")]
    blocks = items.repartition(max(1, -(-size // block_bytes)), "item_id", "text").select(*ids).mapInPandas(index, "address string")
    return sorted(r["address"] for r in blocks.collect())  # a row a block


@lru_cache(maxsize=1)
def _block(address: str) -> Patterns:
    """One block's index; a Python worker that has a single block to look at keeps it."""
    fs, path = filesystem(address)
    with fs.open_input_file(path) as file:
        return Patterns.loaded(file.read())


def all_regions(texts: list[str | None], addresses: list[str]) -> list[tuple[int, int | None, int, int, int, int, int]]:
    """(row, item, start, end, edits, pattern characters, shared): the best region of each row and item over all blocks."""
    out: dict[tuple[int, int | None], tuple] = {}  # an id may repeat in another block
    laid = laid_out(texts)
    if len(addresses) > 1:
        laid = list(laid)
    for address in addresses:
        _add_regions(out, texts, laid, _block(address))
    return [(row, item, *region) for (row, item), (_, region) in out.items()]


def contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The verified regions: one row for each document and item, with its best region (places in the document's text)."""
    addresses = item_blocks(benchmark, block_bytes)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, texts, chars = [], [], 0
        for batch in batches:
            ids += ids_of(batch)
            texts += batch["text"].tolist()
            chars += int(batch["text"].str.len().sum())
            if chars >= HELD_CHARS:
                yield rows_frame([(ids[f[0]], *f[1:]) for f in all_regions(texts, addresses)], SCHEMA)
                ids, texts, chars = [], [], 0
        yield rows_frame([(ids[f[0]], *f[1:]) for f in all_regions(texts, addresses)], SCHEMA)

    return docs.select(split_id("text")).mapInPandas(scan, SCHEMA)


def is_contaminated(benchmark: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> Column:
    """Whether the text holds a region of any item, as a column; a null text holds none."""
    addresses = item_blocks(benchmark, block_bytes)

    def each(texts: pd.Series) -> pd.Series:
        rows = {f[0] for f in all_regions(texts.tolist(), addresses)}
        return pd.Series([k in rows for k in range(len(texts))], dtype=bool)

    return F.pandas_udf(each, "boolean")(text)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
