"""Each stage of the corpus pipeline, and run(), on one small folder with odd rows, against plain versions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumora.llm import decontam, packing, secrets, toxicity
from lumora.llm._common import written
from lumora.llm._tokens import shared_words, tokenizer_path

from .test_operators import plain_leaks, plain_score
from .test_pipeline import plain_near


@pytest.fixture(scope="module")
def folder(spark, sf_dir, odd, tmp_path_factory):
    """The smallest tables with odd rows and, in documents, columns that operators use as names themselves."""
    path = str(tmp_path_factory.mktemp("sf"))
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").limit(4)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumns({c: F.lit("x") for c in ("spans", "key", "label", "score", "kept_id")})
    item = bench.first()["text"]
    more = spark.createDataFrame([(9_001, f"Some words before. {item} And after."), (9_002, "password=abc123xyz and more words here"), (9_002, "password=abc123xyz and more words here")], "doc_id long, text string")
    extra = odd.select("doc_id", "text").unionByName(more)
    docs.unionByName(extra, allowMissingColumns=True).repartition(3).write.parquet(f"{path}/documents.parquet")
    bench.select(F.col("item_id").cast("long").alias("item_id"), "text").unionAll(spark.createDataFrame([(10**6, None)], "item_id long, text string")).write.parquet(f"{path}/benchmark.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


def table(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=str)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    outs = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, folder), "stage")
        assert out.columns == docs.columns, name
        outs.append((docs, out))
        docs = out
    (before, out), *_ = outs
    field = toxicity.trained_on(before, spark.read.parquet(f"{folder}/labels.parquet"))
    want = [(i, t) for i, t in table(before) if plain_score(field, t or "")[0] < toxicity.THRESHOLD]
    assert table(out) == want and len(want) < before.count()

    before, out = outs[1]
    rows, near = table(before), {}
    for i, t in set(rows):
        near[(i is not None, i or 0, t or "")] = t
    kept = {i for i in plain_near([(k, t) for k, t in near.items()])}
    got = table(out)
    assert {(i is not None, i or 0) for i, _ in got} == {k[:2] for k in kept} and len(got) == len(set(got)) < len(rows)

    before, out = outs[2]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    pats = decontam.Patterns([x for x in items if x[1]])
    rows_before = table(before)
    leaks = {t: least_edits_within(t, pats) for t in {t for _, t in rows_before}}
    short = sorted((t for t in leaks if len(t or "") < 800), key=lambda t: len(t or ""))[-25:]
    assert all(leaks[t] == bool(plain_leaks(t, pats)) for t in short)
    want = [(i, t) for i, t in rows_before if not leaks[t]]
    assert table(out) == want and 9_001 not in {i for i, _ in want} and len(want) < len(rows_before)

    before, out = outs[3]
    ratio = secrets.trained_on(before)
    want = []
    for i, t in table(before):
        marks = np.zeros(len(t or "") + 1, bool)
        for s, _, e in secrets.all_spans(t, ratio)[1]:
            marks[s:e] = True
        plain = "".join("[secret]" if marks[k] and (k == 0 or not marks[k - 1]) else "" if marks[k] else c for k, c in enumerate(t or ""))
        want.append((i, None if t is None else plain))
    assert table(out) == sorted(want, key=str) and "[secret]" in dict(want)[9_002]
    assert out.where("text IS NOT NULL AND n_chars <> length(text)").isEmpty()

    got = pd.DataFrame([r.asDict() for r in corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()])
    ids = [len(x) // 4 + 1 for x in shared_words(tokenizer_path()).encode([t for _, t in table(docs)])]
    assert got["length"].sum() == sum(ids) and (got.groupby("sequence_id")["length"].sum() <= packing.SEQUENCE).all()
    last = got.sort_values(["sequence_id", "offset"])
    assert (last.groupby("sequence_id")["length"].cumsum() - last["length"] == last["offset"]).all()
    whole = pd.DataFrame([r.asDict() for r in corpus_pipeline.run(spark, folder).collect()])
    assert sorted(whole["length"]) and whole["length"].sum() == got["length"].sum() and set(whole["doc_id"].dropna()) == set(got["doc_id"].dropna())


def least_edits_within(text, pats):
    """Whether any pattern is somewhere in the whole text within its edits: each column of the table of edit distances in the bits of one word for each pattern, all patterns at once; those of more than 64 characters by the plain table."""
    t = decontam.normalised((text or "").replace("\0", " "))[0].tolist()
    words = [k for k, p in enumerate(pats.points) if len(p) <= 64]
    if not t or not words:
        return bool(plain_leaks(text, pats))
    at = {}
    for n, k in enumerate(words):
        for i, c in enumerate(pats.points[k].tolist()):
            at.setdefault(c, np.zeros(len(words), np.uint64))[n] |= np.uint64(1 << i)
    none, one = np.zeros(len(words), np.uint64), np.uint64(1)
    length = np.array([len(pats.points[k]) for k in words], np.int64)
    high, most = (length - 1).astype(np.uint64), pats.edits[words]
    plus, minus, score = ~none, none.copy(), length.copy()
    for c in t:
        eq = at.get(c, none)
        vertical = eq | minus
        across = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | ~(across | plus), plus & across
        score += ((up >> high) & one).astype(np.int64) - ((down >> high) & one).astype(np.int64)
        if (score <= most).any():
            return True
        up, down = up << one, down << one
        plus, minus = down | ~(vertical | up), up & vertical
    rest = [k for k, p in enumerate(pats.points) if len(p) > 64]
    few = decontam.Patterns([])
    few.points, few.item, few.edits, few.m = [pats.points[k] for k in rest], [pats.item[k] for k in rest], pats.edits[rest], pats.m[rest]
    return bool(rest) and bool(plain_leaks(text, few))


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
