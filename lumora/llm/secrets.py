"""Secret scans: fixed patterns, and two character Markov models compared by log-likelihood ratio.

Both models are first-order over letters, digits and a few marks, with add-one counts. The labelled samples are
random strings (drawn by a seeded generator from the usual alphabets of keys) and ordinary identifiers: the words
of the whole texts of all documents, joined as code would join them, plus a fixed list. The documents are unlabelled, so
what letters their own secrets hold are counted as ordinary too; they are few beside the words. Transitions are counted
where the rows are; the driver gets their sums alone, a row for each pair of characters at most. A token of MIN_TOKEN or
more characters that holds letters and digits is a span if random is likelier by MIN_RATIO nats in all and MIN_RATE a
character. A token that lies within a span found by a pattern is not repeated; one that only touches it is a span too.

Edge cases: null and empty texts have no spans; texts are scanned whole, however long; repeated rows are alike; spans
that start together are in the order of KINDS; with no documents the identifier model has the fixed list alone, and no
rows come out; other columns, whatever their names, stay or are not read.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run of 24 or more is one match, as leftmost longest runs are
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
KINDS = {"assign": 0, "access": 1, "hex": 2, "markov": 3}

MIN_TOKEN = 20
MIN_RATIO = 15.0
MIN_RATE = 0.6
SAMPLE_CHARS = 1 << 19  # texts whose words are held at once
CHARACTERS = 65  # letters, digits, two marks, and all others as one

# Ordinary identifiers.
IDENTIFIERS = """getUserName set_value max_connections is_enabled HTTPServer2 parse_json_v2 index_of_first utf8_decode base64_encode
sha256_digest request_id session_timeout_ms createdAt updated_at user_profile_2024 page_number_10 error_code_404 config_file_path
default_timeout_seconds retry_count_max api_version_v1 log_level_debug build_number_1234 release_candidate_3 test_case_0001
image_width_1920 image_height_1080 font_size_12px color_ff0000 thread_pool_size_16 cache_ttl_3600 batch_size_256 epoch_100
learning_rate_001 part_00001 section_2_1_3 figure_10 chapter_07 item_list_view container_id_prefix node_modules_cache""".split()
ALPHABETS = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"]

_CLASS = np.full(128, 64, np.int64)
for _i, _c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"):
    _CLASS[ord(_c)] = _i


def transitions(strings: Iterable[str]) -> np.ndarray:
    """Counts of character pairs; the last row is the start."""
    raw = np.frombuffer("\n".join(["", *strings, ""]).encode("ascii", "replace"), np.uint8)
    c = np.where(raw == 10, CHARACTERS, _CLASS[raw & 127])
    real = c[1:] < CHARACTERS
    cells = (CHARACTERS + 1) * CHARACTERS
    return np.bincount(c[:-1][real] * CHARACTERS + c[1:][real], minlength=cells).reshape(-1, CHARACTERS)


def log_chain(counts: np.ndarray) -> np.ndarray:
    """Log transition probabilities of add-one counts."""
    return np.log((counts + 1) / (counts + 1).sum(1, keepdims=True))


def random_samples(n: int = 4000, seed: int = 7) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABETS[k % len(ALPHABETS)], k=rng.randint(16, 48))) for k in range(n)]


def identifier_samples(texts: Iterable[str | None]) -> list[str]:
    """Words and joined words of the whole texts, as code would write them; what is drawn from a text depends on that text alone."""
    out: list[str] = []
    for text in texts:
        words = re.findall(r"[A-Za-z]{2,}", text or "")
        out += words
        rng = random.Random(zlib.crc32((text or "").encode()))
        for _ in range(len(words) // 12):
            part = rng.choices(words, k=rng.randint(2, 4))
            style, tail = rng.randrange(4), rng.choice(["", "", str(rng.randint(0, 99)), f"v{rng.randint(1, 9)}", f"_{rng.randint(1, 2030)}"])
            out.append(("_".join(part).lower() if style == 0 else "-".join(part).lower() if style == 1 else "".join(p.title() for p in part) if style == 2 else "/".join(part).lower()) + tail)
    return out


def ratio_of(identifiers: np.ndarray) -> np.ndarray:
    """log P(random) - log P(identifier) of each transition, from the counts of identifiers in a sample."""
    return log_chain(transitions(random_samples())) - log_chain(identifiers + transitions(IDENTIFIERS * 20))


def trained_ratio(texts: Iterable[str | None]) -> np.ndarray:
    return ratio_of(transitions(identifier_samples(texts)))


def base_spans(text: str) -> list[tuple[int, str, int]]:
    low = text.lower()
    spans = []
    if any(h in low for h in ASSIGN_HINTS):
        spans += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return spans


def markov_spans(text: str, ratio: np.ndarray, taken: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    out = []
    for m in TOKEN.finditer(text):
        s, e = m.span()
        token = m.group()
        if not re.search("[0-9]", token) or not re.search("[A-Za-z]", token) or any(a <= s and e <= b for a, _, b in taken):
            continue
        c = _CLASS[np.frombuffer(token.encode(), np.uint8)]
        score = ratio[np.concatenate([[65], c[:-1]]), c].sum()
        if score >= MIN_RATIO and score >= MIN_RATE * len(token):
            out.append((s, "markov", e))
    return out


def all_spans(text: str | None, ratio: np.ndarray) -> tuple[list, list]:
    base = sorted(base_spans(text or ""), key=lambda x: (x[0], KINDS[x[1]]))
    return base, sorted(base + markov_spans(text or "", ratio, base), key=lambda x: (x[0], KINDS[x[1]]))


def trained_on(docs: DataFrame) -> np.ndarray:
    """The ratio from all documents: pairs of characters are counted where the rows are."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found, part, chars = np.zeros(counts.size, np.int64), [], 0
            for text in [*batch["text"], None]:
                part.append(text)
                chars += len(text or "")
                if text is None or chars >= SAMPLE_CHARS:
                    found += transitions(identifier_samples(part)).ravel()
                    part, chars = [], 0
            cell = np.flatnonzero(found)
            yield pd.DataFrame({"cell": cell, "n": found[cell]})

    counts = np.zeros((CHARACTERS + 1, CHARACTERS), np.int64)
    sums = docs.select("text").mapInPandas(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    for r in sums.collect():  # at most one row for each pair of characters
        counts.flat[r["cell"]] = r["n"]
    return ratio_of(counts)


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def scan_column(ratio: np.ndarray, text: str = "text") -> Column:
    schema = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long"

    @F.pandas_udf(schema)
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            base, every = all_spans(t, ratio)
            kinds = [k for _, k, _ in every]
            rows.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), kinds.count("markov")))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return scan(text)


def redacted_column(ratio: np.ndarray, text: str = "text", mark: str = "[secret]") -> Column:
    """The text with every span replaced; texts without spans, nulls included, stay as they are."""

    @F.pandas_udf("string")
    def redact(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            spans = all_spans(t, ratio)[1] if t else []
            if spans:
                parts, at = [], 0
                for s, _, e in spans:
                    if s >= at:
                        parts += [t[at:s], mark]
                    at = max(at, e)
                t = "".join(parts) + t[at:]
            out.append(t)
        return pd.Series(out, dtype=object)

    return redact(text)


def secret_scan(docs: DataFrame, ratio: np.ndarray | None = None) -> DataFrame:
    """doc_id, counts by kind, the digest of the pattern spans, and all spans."""
    ratio = trained_on(docs) if ratio is None else ratio
    return docs.select("doc_id", scan_column(ratio).alias("s")).select("doc_id", "s.*")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(documents(spark, sf_dir))
