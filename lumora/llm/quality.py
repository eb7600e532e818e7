"""Repetition coverage: the share of a text's characters inside duplicated n-grams and lines.

Word n-grams of several lengths are hashed by one rolling polynomial, H(n+1)[i] = H(n)[i] * B + h[i+n] modulo
2^64, over random 64-bit word codes, so each longer length costs one multiply-add over the array. For short
lengths the share of the most frequent n-gram counts; for longer ones the share of characters inside any
n-gram that occurs twice or more. If no n-gram of one length repeats, none of a greater length can.

Edge cases: null and empty texts have zeros everywhere and fail (fewer than 20 words); any length of text is
scored whole; repeated rows are scored alike, each with its row; of equally frequent n-grams the longest in characters
counts; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents

# The largest allowed share of characters, by n-gram length, and for duplicated lines. A short text may repeat one line.
MAX_TOP_SHARE = {2: 0.20, 3: 0.18, 4: 0.16}
MAX_DUP_SHARE = {5: 0.33, 6: 0.32, 7: 0.31, 8: 0.30, 9: 0.29, 10: 0.28}
MAX_DUP_LINE_SHARE = 0.30
MAX_DUP_LINE_CHAR_SHARE = 0.30
BASE_WINDOW = 8
MIN_WORDS = 20

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
ROLL = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, top_share double, dup_share double, dup_line_char_share double, base_failed boolean, kept boolean"
_CODES = np.random.default_rng(42).integers(0, 2**64, 1 << 16, dtype=np.uint64)


def _codes(n: int) -> np.ndarray:
    global _CODES
    if n > len(_CODES):
        _CODES = np.concatenate([_CODES, np.random.default_rng(43 + len(_CODES)).integers(0, 2**64, n, dtype=np.uint64)])
    return _CODES


def _covered(repeated: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in one of the repeated windows of n words; repeated: by window start."""
    edge = np.zeros(len(repeated) + n, np.int32)
    edge[: len(repeated)] += repeated
    edge[n:] -= repeated
    return edge[:-1].cumsum() > 0


def coverage(text: str | None) -> tuple:
    """The columns of SCHEMA for one text."""
    raw = (text or "").encode()
    words = raw.split()  # bytes split at ASCII white space only
    n = len(words)
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    word_chars = len(text or "") - (len(raw) - len(raw.translate(None, SPACES)))
    dup_lines, dup_line_chars, n_lines = 0, 0, 0
    if b"\n" in raw:
        seen = set()
        for line in text.split("\n"):
            if line.strip(" \t\n\r\x0b\x0c"):
                n_lines += 1
                if line in seen:
                    dup_lines += 1
                    dup_line_chars += len(line)
                seen.add(line)
    top = dup = 0.0
    over, repeat_words = False, 0
    if n > 1:
        ids: dict[bytes, int] = {}
        order = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
        lens = np.fromiter((len(w.decode()) for w in ids) if len(raw) != len(text) else map(len, ids), np.int64, len(ids))[order]
        chars = max(word_chars, 1)
        codes = _codes(len(ids))[order]
        h, ends = codes, np.concatenate([[0], lens.cumsum()])
        for k in range(2, max(MAX_DUP_SHARE) + 1):
            if k > n:
                break
            h = h[:-1] * ROLL + codes[k - 1 :]
            s = np.sort(h)
            same = s[1:] == s[:-1]
            if not same.any():
                break
            if k in MAX_TOP_SHARE:
                values, first, counts = np.unique(h, return_index=True, return_counts=True)
                most = counts.max()
                at = first[counts == most]
                share = most * int((ends[at + k] - ends[at]).max()) / chars
                top = max(top, share)
                over |= share > MAX_TOP_SHARE[k]
            if k >= min(MAX_DUP_SHARE):
                inside = _covered(np.isin(h, s[1:][same]), k)
                share = int(lens[inside].sum()) / chars
                dup = max(dup, share)
                over |= share > MAX_DUP_SHARE[k]
                if k == BASE_WINDOW:
                    repeat_words = int(inside.sum())
    line_share = dup_line_chars / max(len(text or ""), 1)
    over |= bool(n_lines) and dup_lines > MAX_DUP_LINE_SHARE * n_lines or line_share > MAX_DUP_LINE_CHAR_SHARE
    failed = n < MIN_WORDS or 100 * repeat_words > 30 * n
    return n, word_chars, n_symbols, dup_lines, repeat_words, top, dup, line_share, failed, not failed and not over


def coverage_batch(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([coverage(t) for t in texts], columns=[c.split()[0] for c in SCHEMA.split(", ")])


def repetition_quality(docs: DataFrame) -> DataFrame:
    """doc_id and the repetition columns of every document; kept is the verdict."""
    return docs.select("doc_id", F.pandas_udf(coverage_batch, SCHEMA)("text").alias("c")).select("doc_id", "c.*")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_quality(documents(spark, sf_dir))
