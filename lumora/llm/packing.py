"""Order-preserving packing of token streams by dynamic programming.

Documents in id order make one stream of tokens; it is cut into windows of at most SEQUENCE tokens. A cut may stand
after a document (free), after a sentence (SENTENCE_COST) or, where neither is near, at a grid of places inside a long
run (HARD_COST). The cost of a window is its padding and that of its cut; the least total is

    best[j] = cost[j] + SEQUENCE - at[j] + min over i within reach (best[i] + at[i]),

and the minimum over the sliding reach is kept in a monotone queue, so the work is linear in the number of cuts. The
stream is ranged by id over partitions; a partition is packed in blocks, and the last windows of a block are packed
anew with the next, so memory is bounded by a block and the longest document.

Each partition begins a sequence, so where windows are cut depends on how many partitions the ranging makes; which ids a
document has, and that each lies in one piece, does not.

Edge cases: a null text has the end id alone; null ids come first; documents with equal ids follow each other in the
order of a hash of their texts, over several partitions if they are many; equal rows are packed each; any document is cut as
often as it needs; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from ._common import documents, ids_of, ranged_by_id, rows_frame, split_id
from ._tokens import END_ID, shared_words, tokenizer_path

SEQUENCE = 2048
SENTENCE_COST = 16
HARD_COST = 64
GRID = 128
BLOCK = 256 * SEQUENCE
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cut_places(ids: np.ndarray, doc_ends: np.ndarray, enders: np.ndarray, grid: int = GRID) -> tuple[np.ndarray, np.ndarray]:
    """Places where the stream may be cut (0 and its end included) and what each cut costs."""
    n = len(ids)
    cost = np.full(n + 1, -1, np.int32)
    cost[1:][np.isin(ids, enders)] = SENTENCE_COST
    cost[doc_ends] = 0
    cost[0] = cost[n] = 0
    at = np.flatnonzero(cost >= 0)
    gaps = np.flatnonzero(np.diff(at) > 2 * grid)
    for a, b in zip(at[gaps].tolist(), at[gaps + 1].tolist()):
        inner = np.arange(a + grid, b, grid)
        cost[inner] = HARD_COST
    at = np.flatnonzero(cost >= 0)
    return at, cost[at]


def best_cuts(at: np.ndarray, cost: np.ndarray, most: int = SEQUENCE) -> list[int]:
    """The places of the cuts of least total cost; neighbouring places are at most `most` apart."""
    places, costs = at.tolist(), cost.tolist()
    keys, best, came = [0] * len(places), [0] * len(places), [0] * len(places)
    keys[0] = places[0]
    queue = deque([0])
    for j in range(1, len(places)):
        p = places[j]
        while places[queue[0]] < p - most:
            queue.popleft()
        i = queue[0]
        came[j] = i
        best[j] = costs[j] + most - p + keys[i]
        key = keys[j] = best[j] + p
        while queue and keys[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    out, j = [], len(places) - 1
    while j:
        out.append(places[j])
        j = came[j]
    return out[::-1]


class Packer:
    """Packs a stream of documents that comes bit by bit."""

    def __init__(self, enders: np.ndarray, first_sequence: int, block: int = BLOCK, most: int = SEQUENCE):
        self.enders, self.sequence, self.block, self.most = enders, first_sequence, block, most
        self.docs: list[tuple[int | None, int, int, bytes]] = []  # id, start of what is left, whole tokens, the ids left
        self.waiting = 0

    def add(self, doc_id: int | None, ids: bytes) -> list[tuple]:
        self.docs.append((doc_id, 0, len(ids) // 4, ids))
        self.waiting += len(ids) // 4
        return self.pack(False) if self.waiting >= self.block else []

    def pack(self, last: bool) -> list[tuple]:
        """Pieces of the windows that are settled: all if last, else all but those near the end, which later documents may still shift."""
        if not self.docs:
            return []
        ids = np.frombuffer(b"".join(d[3] for d in self.docs), "<u4")
        ends = np.cumsum([len(d[3]) // 4 for d in self.docs])
        cuts = best_cuts(*cut_places(ids, ends, self.enders), self.most)
        if not last:
            cuts = cuts[: max(1, len(cuts) - 2)]
        rows, raw, k, start = [], memoryview(ids).cast("B"), 0, 0
        begins = ends - np.array([len(d[3]) // 4 for d in self.docs])
        for cut in cuts:
            at = start
            while at < cut:
                doc_id, first, whole, _ = self.docs[k]
                stop = min(cut, int(ends[k]))
                rows.append((doc_id, first + at - int(begins[k]), stop - at, zlib.crc32(raw[4 * at : 4 * stop]), whole, self.sequence, at - start))
                at = stop
                k += stop == ends[k]
            self.sequence += 1
            start = cut
        rest = []
        for j in range(k, len(self.docs)):
            doc_id, first, whole, left = self.docs[j]
            gone = max(0, start - int(begins[j]))
            rest.append((doc_id, first + gone, whole, left[4 * gone :]))
        self.docs, self.waiting = rest, len(ids) - start
        return rows


def packed(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE) -> DataFrame:
    """A row for each piece of a document in a sequence."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = shared_words(tokenizer)
        enders = np.unique(np.frombuffer(b"".join(words.encode([".", "!", "?", "a.", "...", "!!", "??", "!!!"])), "<u4"))
        enders = np.setdiff1d(enders, np.frombuffer(words.encode(["a"])[0], "<u4"))
        packer, end, rows = Packer(enders, TaskContext.get().partitionId() << 32, most=sequence), np.array([END_ID], "<u4").tobytes(), []
        for batch in batches:
            for doc_id, tokens in zip(ids_of(batch), words.encode(batch["text"].tolist())):
                rows += packer.add(doc_id, tokens + end)
            if rows:
                yield rows_frame(rows, SCHEMA)
                rows = []
        yield rows_frame(packer.pack(True), SCHEMA)

    return ranged_by_id(docs).select(split_id("text")).mapInPandas(pack, SCHEMA)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir), tokenizer_path())
