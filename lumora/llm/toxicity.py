"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Words are tokens; a chain is a run of at most CHAIN words of a text. A word's features are its lower-case form, its
first three to six letters, its last three, and the words before and after. Token labels come from labelled documents:
a word of a toxic document is toxic if one of its features is in several toxic documents and hardly in clean ones;
near copies among the labelled documents count once. The field is trained by gradient steps on its exact likelihood.
Forward-backward gives each token's marginal; a document's score is a logistic function of the greatest marginal and
of the expected number of toxic tokens.

The labelled sample is bounded: SAMPLE_TOXIC and SAMPLE_CLEAN documents of the training part, those with the lowest
hash of their id. Of their chains the field sees all that have a toxic token, and as many others (2,000 at least),
drawn by a seeded generator. The model has a fixed size. Scoring covers every whole text, row by row; words whose
marginal is SPAN_LEAST or more are its offending spans.

Edge cases: null and empty texts have no tokens, no spans and the score of a text without toxic tokens; documents with
several labels count as toxic if any says so, null labels are skipped; where a labelled id has several texts the least
one trains; without a toxic or a clean label every score is 0; texts are read whole, however long; equal texts have equal
scores; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents
from .simhash import fingerprint

SAMPLE_TOXIC = 800
SAMPLE_CLEAN = 2400
CHAIN = 64
HASH_BITS = 18
MIN_DOCS = 3  # or one in a hundred of the toxic documents
MIN_ODDS = 30.0
COPY_BITS = 8
THRESHOLD = 0.7
SPAN_LEAST = 0.5  # the marginal from which a word is reported
STEPS = 30
CACHE_WORDS = 200_000
GROUP_CHARS = 1 << 20
WORD = re.compile(r"\S+")
EDGE = "".join(chr(c) for c in range(33, 128) if not chr(c).isalnum())


def word_features(word: str) -> list[int]:
    """Hashed features of a word alone; the first also stands for it in its neighbours' features."""
    low = word.strip(EDGE).lower()
    mask = (1 << HASH_BITS) - 1
    return [zlib.crc32(low[:k].encode(), k) & mask if k > 0 else zlib.crc32(low[k:].encode(), 90 - k) & mask for k in (40, 3, 4, 5, 6, -3)]


def neighbour_features(word: str) -> tuple[int, int]:
    low, mask = word.strip(EDGE).lower().encode(), (1 << HASH_BITS) - 1
    return zlib.crc32(low, 101) & mask, zlib.crc32(low, 102) & mask


def chains(lengths: np.ndarray, size: int = CHAIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts laid end to end: chain of each token, its place there, and the text of each chain."""
    total = int(lengths.sum())
    text = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(total) - np.repeat(lengths.cumsum() - lengths, lengths)
    per_text = -(-lengths // size)
    first = per_text.cumsum() - per_text
    return first[text] + place // size, place % size, np.repeat(np.arange(len(lengths)), per_text)


def marginals(unary: np.ndarray, mask: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of chains (rows; unary: score of toxic against not): marginal of toxic for each token, forward and backward log ratios, and each step's inner logit."""
    t = np.exp(trans)
    n, width = unary.shape
    ahead, back = np.zeros((n, width)), np.zeros((n, width))
    ahead[:, 0] = unary[:, 0]
    for k in range(1, width):
        e = np.exp(ahead[:, k - 1])
        ahead[:, k] = unary[:, k] + np.log((t[0, 1] + e * t[1, 1]) / (t[0, 0] + e * t[1, 0]))
    for k in range(width - 2, -1, -1):
        e = np.exp(np.clip(unary[:, k + 1] + back[:, k + 1], -60, 60))
        back[:, k] = np.where(mask[:, k + 1], np.log((t[1, 0] + e * t[1, 1]) / (t[0, 0] + e * t[0, 1])), 0)
    p = 1 / (1 + np.exp(-np.clip(ahead + back, -60, 60)))
    return np.where(mask, p, 0), ahead, back, t


class Field:
    """Weights of the field and of the document score."""

    def __init__(self) -> None:
        self.weights = np.zeros(1 << HASH_BITS, np.float32)
        self.bias = -4.0
        self.trans = np.zeros((2, 2))
        self.logistic = np.array([-60.0, 0.0, 0.0])
        self._cache: dict[str, int] = {}
        self._table = np.zeros((1024, 3))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._cache, self._table = {}, np.zeros((1024, 3))

    def _ids(self, words: list[list[str]]) -> np.ndarray:
        """Rows of the table of (own, to the next, to the one before) scores, for all words end to end."""
        cache = self._cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        new = list(set().union(*words).difference(cache)) if words else []
        if new:
            need = len(cache) + len(new)
            if need > len(self._table):
                self._table = np.concatenate([self._table, np.zeros((need, 3))])
            own = np.array([word_features(w) for w in new])
            near = np.array([neighbour_features(w) for w in new])
            at = len(cache)
            self._table[at:need, 0] = self.bias + self.weights[own].sum(1)
            self._table[at:need, 1:] = self.weights[near]
            cache.update(zip(new, range(at, need)))
        return np.fromiter((i for w in words for i in map(cache.__getitem__, w)), np.int64, sum(map(len, words)))

    def tag(self, words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Marginal of each token (texts end to end), and the lengths."""
        lengths = np.array([len(w) for w in words], np.int64)
        if not lengths.sum():
            return np.zeros(0), lengths
        ids = self._ids(words)
        chain, place, _ = chains(lengths)
        unary, mask = np.full((chain[-1] + 1, CHAIN), -9.0), np.zeros((chain[-1] + 1, CHAIN), bool)
        score = self._table[ids, 0]
        score[1:] += np.where(place[1:] > 0, self._table[ids[:-1], 1], 0)
        score[:-1] += np.where(place[1:] > 0, self._table[ids[1:], 2], 0)
        unary[chain, place], mask[chain, place] = score, True
        return marginals(unary, mask, self.trans)[0][chain, place], lengths

    def _features(self, p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Per text: one, the greatest marginal, and the logarithm of one more than the expected number of toxic tokens."""
        text = np.repeat(np.arange(len(lengths)), lengths)
        most = np.zeros(len(lengths))
        np.maximum.at(most, text, p)
        p = np.where(p > 0.05, p, 0)  # many tokens with next to nothing do not add up
        return np.stack([np.ones(len(lengths)), most, np.log1p(np.bincount(text, p, len(lengths)))], 1)

    def features(self, words: list[list[str]]) -> np.ndarray:
        return self._features(*self.tag(words))

    def scored(self, texts: Iterable[str | None]) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
        """Score of each text, and its toxic words as (start, end, marginal)."""
        texts, out, spans, k = list(texts), [], [], 0
        while k < len(texts):
            j, chars = k, 0
            while j < len(texts) and chars < GROUP_CHARS:
                chars += len(texts[j] or "")
                j += 1
            p, lengths = self.tag([(t or "").split() for t in texts[k:j]])
            out.append(1 / (1 + np.exp(-np.clip(self._features(p, lengths) @ self.logistic, -60, 60))))
            own, first = [[] for _ in range(k, j)], lengths.cumsum() - lengths
            hits = np.flatnonzero(p >= SPAN_LEAST)
            at = np.searchsorted(first, hits, side="right") - 1  # of texts without words, which share a first, the last has the words
            for row in np.unique(at).tolist():
                wanted = dict(zip((hits[at == row] - first[row]).tolist(), p[hits[at == row]].tolist()))
                own[row] = [(*m.span(), wanted[n]) for n, m in enumerate(WORD.finditer(texts[k + row])) if n in wanted]
            spans += own
            k = j
        return np.concatenate(out) if out else np.zeros(0), spans


def distinct_texts(texts: list[str], toxic: list[int]) -> tuple[list[str], list[int]]:
    """Without the near copies of an earlier text."""
    prints, keep = np.array([fingerprint(t) for t in texts], np.uint64), []
    for k in range(len(texts)):
        if not keep or (np.bitwise_count(prints[keep] ^ prints[k]) > COPY_BITS).all():
            keep.append(k)
    return [texts[k] for k in keep], [toxic[k] for k in keep]


def token_labels(words: list[list[str]], toxic: list[int]) -> list[np.ndarray]:
    """Which words of each text are toxic."""
    features = {w: word_features(w) for ws in words for w in set(ws)}
    bad, good = Counter(), Counter()
    for ws, y in zip(words, toxic):
        (bad if y else good).update({f for w in set(ws) for f in features[w]})
    n_bad, n_good = max(1, sum(toxic)), max(1, len(toxic) - sum(toxic))
    least = max(MIN_DOCS, n_bad / 100)
    marked = {f for f, n in bad.items() if n >= least and (n / n_bad) / ((good[f] + 0.5) / n_good) >= MIN_ODDS}
    is_bad = {w: not marked.isdisjoint(fs) for w, fs in features.items()}
    return [np.array([bool(y) and is_bad[w] for w in ws], bool) for ws, y in zip(words, toxic)]


def trained(texts: list[str], toxic: list[int], steps: int = STEPS, seed: int = 3) -> Field:
    """A field and its document score, from labelled texts."""
    field = Field()
    texts, toxic = distinct_texts(texts, toxic)
    if not 0 < sum(toxic) < len(toxic):
        return field
    words = [t.split() for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    y = np.concatenate(token_labels(words, toxic))
    chain, place, _ = chains(lengths)
    # all chains with a toxic token, and about as many others
    rng = np.random.default_rng(seed)
    has = np.zeros(chain[-1] + 1, bool)
    has[chain[y]] = True
    other = np.flatnonzero(~has)
    has[rng.choice(other, min(len(other), max(2000, int(has.sum()))), replace=False)] = True
    row, use = has.cumsum() - 1, has[chain]
    every = np.array([w for ws in words for w in ws], dtype=object)[use]
    vocab: dict[str, int] = {}
    ids = np.fromiter((vocab.setdefault(w, len(vocab)) for w in every), np.int64, len(every))
    own = np.array([word_features(w) for w in vocab])
    near = np.array([neighbour_features(w) for w in vocab])
    n = int(has.sum())
    grid, gold, mask = np.zeros((n, CHAIN), np.int64), np.zeros((n, CHAIN), bool), np.zeros((n, CHAIN), bool)
    at = row[chain[use]], place[use]
    grid[at], gold[at], mask[at] = ids, y[use], True
    size = 1 << HASH_BITS
    w, bias, trans = np.zeros(size), -4.0, np.zeros((2, 2))
    g2, b2, t2 = np.full(size, 1e-3), 1e-3, np.full((2, 2), 1e-3)
    pair = mask[:, 1:]
    for _ in range(steps):
        unary = bias + w[own].sum(1)[grid]
        unary[:, 1:] += w[near[:, 0]][grid[:, :-1]]
        unary[:, :-1] += np.where(pair, w[near[:, 1]][grid[:, 1:]], 0)
        p, ahead, back, t = marginals(np.where(mask, unary, -9.0), mask, trans)
        d = np.where(mask, p - gold, 0)
        each = np.bincount(grid.ravel(), d.ravel(), len(vocab))
        before = np.bincount(grid[:, :-1].ravel(), d[:, 1:].ravel(), len(vocab))
        after = np.bincount(grid[:, 1:].ravel(), np.where(pair, d[:, :-1], 0).ravel(), len(vocab))
        grad = np.zeros(size)
        for c in range(own.shape[1]):
            grad += np.bincount(own[:, c], each, size)
        grad += np.bincount(near[:, 0], before, size) + np.bincount(near[:, 1], after, size) + 0.02 * w
        # expected less observed transitions, from the joint of neighbouring tokens
        a, b = np.clip(ahead[:, :-1], -60, 60), np.clip(unary[:, 1:] + back[:, 1:], -60, 60)
        joint = np.stack([np.stack([np.full_like(a, t[0, 0]), t[0, 1] * np.exp(b)]), np.stack([t[1, 0] * np.exp(a), t[1, 1] * np.exp(np.clip(a + b, -80, 80))])])
        joint /= joint.sum((0, 1))
        g_t = np.array([[(joint[i, j][pair]).sum() - ((gold[:, :-1] == i) & (gold[:, 1:] == j) & pair).sum() for j in (0, 1)] for i in (0, 1)]) + 0.02 * trans
        g2 += grad * grad
        b2 += d.sum() ** 2
        t2 += g_t * g_t
        w -= 0.5 * grad / np.sqrt(g2)
        bias -= 0.2 * d.sum() / np.sqrt(b2)
        trans -= 0.2 * g_t / np.sqrt(t2)
    field.weights, field.bias, field.trans = w.astype(np.float32), float(bias), trans
    x, target = np.concatenate([field.features(words[k : k + 500]) for k in range(0, len(words), 500)]), np.array(toxic, float)
    ridge = np.array([1e-3, 0.5, 0.5])

    def loss(beta: np.ndarray) -> float:
        z = np.clip(x @ beta, -60, 60)
        return float((np.log1p(np.exp(z)) - target * z).sum() + (ridge * beta * beta).sum() / 2)

    beta = np.array([-3.0, 3.0, 1.0])
    for _ in range(50):  # damped Newton steps
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -60, 60)))
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + np.diag(ridge), x.T @ (q - target) + ridge * beta)
        size, now = 1.0, loss(beta)
        while size > 1e-4 and loss(beta - size * step) > now:
            size /= 2
        beta = beta - size * step
    field.logistic = beta
    return field


def held_out(doc_id: str = "doc_id") -> Column:
    """The rows that training never sees; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def trained_on(docs: DataFrame, labels: DataFrame, sample_toxic: int = SAMPLE_TOXIC, sample_clean: int = SAMPLE_CLEAN) -> Field:
    """A field from a bounded sample of the labelled documents of the training part."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = marked.where("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_toxic).unionAll(marked.where("toxic = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_clean)).collect()
    of = {r["doc_id"]: int(r["toxic"]) for r in picked}
    chosen = docs.sparkSession.createDataFrame([(k,) for k in of], "doc_id long")  # at most the two bounds together
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")).collect()
    rows = sorted((r["doc_id"], r["text"] or "") for r in rows)
    return trained([t for _, t in rows], [of[i] for i, _ in rows])


def scored_column(docs: DataFrame, field: Field, text: str = "text") -> Column:
    """score, and spans: start:end of each toxic word (code points, end exclusive), comma-joined."""
    shared = docs.sparkSession.sparkContext.broadcast(field)  # fixed size

    def score(texts: pd.Series) -> pd.DataFrame:
        scores, spans = shared.value.scored(texts)
        return pd.DataFrame({"score": scores, "spans": [",".join(f"{s}:{e}" for s, e, _ in x) for x in spans]})

    return F.pandas_udf(score, "score double, spans string")(text)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, the offending offsets and predicted for every document."""
    scored = docs.select("doc_id", held_out().alias("held_out"), scored_column(docs, trained_on(docs, labels)).alias("s"))
    return scored.select("doc_id", "held_out", "s.score", (F.col("s.score") >= THRESHOLD).cast("int").alias("predicted"), "s.spans")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
