"""Substring dedup by sliding sentence spans.

A text is cut into sentences (a full stop, question or exclamation mark before white space, or a line end). A
sentence of LONG_WORDS or more is cut further after words whose hash says so, so that the same words are cut at the
same places wherever they stand; where no word says so for WINDOW words, the cut is after the one of least hash, the
last of equals. From each sentence on, and back from each, the shortest run of MIN_SENTENCES or more with MIN_WORDS or
more is hashed, over lower-case words; a text too short for a run of that many words is one run if it has MIN_WORDS.
A run's first place is the least (doc_id, sentence); every sentence that any other run with that hash covers is removed.

The hashes of repeated runs are found by a map-side combined count, written, and joined back to the runs; first
places are sought among the repeated ones only. Both sides of each join are shuffled as they are, so a run that very
many documents share can be split.

Edge cases: null texts stay null and have no sentences; empty texts stay empty; texts without a long enough run
are unchanged; documents that repeat a doc_id and a text in full count as one document; of an exact copy all that
a run covers is removed; texts are read whole, however long; of runs that tie on doc_id and sentence, in rows of one
doc_id, the least text hash is first; a null doc_id comes before any other; an empty table gives no rows; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import discard, documents, split_id, written

MIN_SENTENCES = 2
MIN_WORDS = 20
LONG_WORDS = 24
ANCHOR = 8
WINDOW = 24

SENTENCE = re.compile(r"[^\n]*?(?:[.!?]+(?=\s)|(?=\n)|\Z)", re.S)
WORD = re.compile(r"\S+")


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, lower-case words) of each sentence with a word."""
    out = []
    at, n = 0, len(text)
    while at < n:
        end = SENTENCE.match(text, at).end()
        if end == at:
            at += 1
            continue
        words = text[at:end].lower().split()
        if len(words) >= LONG_WORDS:
            part, first = [], at
            for m in WORD.finditer(text, at, end):
                w = m.group().lower()
                part.append((w, m.end(), crc32(w.encode())))
                if part[-1][2] % ANCHOR == 0:
                    cut = len(part)
                elif len(part) == WINDOW:
                    cut = min(range(1, WINDOW + 1), key=lambda k: (part[k - 1][2], -k))
                else:
                    continue
                out.append((first, part[cut - 1][1], [x for x, _, _ in part[:cut]]))
                first, part = part[cut - 1][1], part[cut:]
            if part:
                out.append((first, end, [x for x, _, _ in part]))
        elif words:
            out.append((at, end, words))
        at = end
    return out


def runs(text: str | None, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(hash, first sentence, number of sentences) of each run."""
    parts = sentences(text or "")
    units = [" ".join(w) for _, _, w in parts]
    counts = np.cumsum([0, *(len(w) for _, _, w in parts)])
    n = len(units)
    places = np.arange(n)
    ends = np.maximum(np.searchsorted(counts, counts[:-1] + min_words), places + min_sentences).tolist()
    starts = np.minimum(np.searchsorted(counts, counts[1:] - min_words, "right") - 1, places + 1 - min_sentences).tolist()
    found = {(i, e) for i, e in enumerate(ends) if e <= n} | {(s, i + 1) for i, s in enumerate(starts) if s >= 0}
    if not found and counts[-1] >= min_words:
        found = {(0, n)}
    return [(xxhash.xxh3_64_intdigest(" ".join(units[i:e])), i, e - i) for i, e in sorted(found)]


def span_table(docs: DataFrame) -> DataFrame:
    """A row for each run of each document."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [runs(t) for t in batch["text"]]
            n = np.array([len(f) for f in found], np.int64)
            flat = [x for f in found for x in f]
            rows = np.repeat(np.arange(len(n)), n)
            ids = pd.array(batch["doc_id"].to_numpy()[rows], "Int64")
            ids[batch["id_null"].to_numpy()[rows]] = pd.NA
            yield pd.DataFrame({
                "doc_id": ids,
                "text_hash": batch["text_hash"].to_numpy()[rows],
                "span": np.array([x[0] for x in flat], np.uint64).view(np.int64),
                "first": np.array([x[1] for x in flat], np.int32),
                "length": np.array([x[2] for x in flat], np.int32),
            })

    return docs.select(*split_id("text"), F.xxhash64("text").alias("text_hash")).mapInPandas(each, "doc_id long, text_hash long, span long, first int, length int")


def repeated_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and the non-first repeated runs, each as its first sentence and length in one long."""
    spans = written(span_table(docs), "spans-all")
    repeated = written(spans.groupBy("span").count().where("count > 1").select("span"), "spans-repeated")
    again = written(spans.join(repeated, "span", "left_semi"), "spans-again")
    discard(spans)
    firsts = again.groupBy("span").agg(F.min(F.struct("doc_id", "text_hash", "first")).alias("at"))
    firsts = written(firsts.select("span", F.col("at.doc_id").alias("d"), F.col("at.text_hash").alias("t"), F.col("at.first").alias("f")), "spans-firsts")
    later = again.join(firsts, "span").where(~(F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")) & (F.col("first") == F.col("f"))))
    run = F.shiftleft(F.col("first").cast("long"), 32).bitwiseOR(F.col("length").cast("long"))
    # a document has two runs a sentence at most, so the group is no longer than its text
    found = written(later.groupBy("doc_id", "text_hash").agg(F.collect_set(run).alias("runs")), "spans-found")
    discard(repeated, again, firsts)
    return found


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, text without the removed sentences, n_removed, removed_chars and removed (sentence numbers from 0)."""
    found = repeated_runs(docs).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "runs")
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("t0"))
    both = keyed.join(found, keyed["doc_id"].eqNullSafe(found["d"]) & (keyed["t0"] == found["t"]), "left")
    schema = "text string, n_removed long, removed_chars long, removed string"

    def cut(texts: pd.Series, runs_of: pd.Series) -> pd.DataFrame:
        rows = []
        for text, packed in zip(texts, runs_of):
            gone, chars = [], 0
            if packed is not None:
                parts = sentences(text or "")
                first, length = np.asarray(packed) >> 32, np.asarray(packed) & 0xFFFFFFFF
                depth = np.zeros(len(parts) + 1, np.int64)
                np.add.at(depth, first, 1)
                np.add.at(depth, first + length, -1)
                gone = np.flatnonzero(depth.cumsum()[:-1] > 0).tolist()
                keep, at = [], 0
                for k in gone:
                    s, e, _ = parts[k]
                    keep.append(text[at:s])
                    chars += e - s
                    at = e
                text = "".join(keep) + text[at:]
            rows.append((text, len(gone), chars, ",".join(map(str, gone))))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return both.select("doc_id", F.pandas_udf(cut, schema)("text", "runs").alias("c")).select("doc_id", "c.*")


def op4_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(documents(spark, sf_dir))
