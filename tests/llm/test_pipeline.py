"""Stages of the corpus pipeline against plain versions."""

import random

import corpus_pipeline


def plain_near(docs, words=5, similarity=0.8):
    """The least doc_id of each component of links at that Jaccard similarity."""
    sets = {}
    for i, t in docs:
        w = (t or "").lower().split()
        sets[i] = {" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))}
    ids, root = sorted(sets), {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i for i in ids if top(i) == i}


def test_near_copies_at_their_similarity(spark, sf_dir):
    rng = random.Random(3)
    docs = [(900, None), (901, ""), (902, "two words"), (903, "Two  words")]
    for k in range(25):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        docs.append((10 * k, " ".join(words)))
        for m, edits in enumerate((1, 3, 4, 7, 9), 1):  # five edited shingles each: similarity 0.95 to 0.63
            changed = list(words)
            for e in range(edits):
                changed[7 + e * 20] = f"edit{m}x{e}"
            docs.append((10 * k + m, " ".join(changed)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"] for r in corpus_pipeline.without_near_copies(spark, df, sf_dir).collect()}
    assert got == plain_near(docs)


def test_near_copies_edge_rows(odd, empty, spark, sf_dir):
    got = corpus_pipeline.without_near_copies(spark, odd, sf_dir)
    assert got.columns == odd.columns
    ids = sorted((r["doc_id"] for r in got.collect()), key=lambda i: (i is None, i or 0))
    assert ids == [-5, 1, 2, 4, 5, 7, 8, 9, 2**62, None]
    assert corpus_pipeline.without_near_copies(spark, empty, sf_dir).count() == 0
