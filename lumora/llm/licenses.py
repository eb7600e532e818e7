"""Licence detection by a positional rare-token index (DataFrame functions only).

Each template is a short word sequence with its words' positions. A word's IDF is its inverse document
frequency over all documents. The index holds each template's rarest words, half of them and TEMPLATE_WORDS at least.
Those of them that a text has are looked up: every occurrence at word i of a posting (template, position p) votes for the
template starting at word i - p. Starts that get MIN_WEIGHT of the IDF weight of the template's words in the index are
kept if the template's mandatory key phrase stands word for word at its relative position. What is found at a place
depends on no other place, so a text that joins several has the labels of all.

Edge cases: a null text is empty (no words, no labels, score 0); texts are read whole, however long; rows are
independent, so repeated rows and ties get equal results; on an empty table no IDF is needed and no rows come out; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import ascii_lower, documents

# Phrases that alone decide a label.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Label, template words, mandatory key phrase (part of the template).
TEMPLATES = [
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("apache", "you may not use this file except in compliance with the license", "except in compliance with the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license", "under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
]

TEMPLATE_WORDS = 4
MIN_WEIGHT = 0.5
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str = "text") -> Column:
    return F.filter(F.split(ascii_lower(text), SEPARATORS), lambda w: w != "")


def template_words() -> list[str]:
    return sorted({w for _, t, _ in TEMPLATES for w in t.split()})


def idf(words: DataFrame) -> dict[str, float]:
    """IDF of each template word over all rows of words (a column "words"); as many entries as the templates have words."""
    vocab = F.array(*map(F.lit, template_words()))
    found = words.select(F.explode(F.array_append(F.array_intersect("words", vocab), F.lit(""))).alias("word")).groupBy("word").count()
    df = {r["word"]: r["count"] for r in found.collect()}
    n = df.pop("", 0)
    return {w: math.log((1 + n) / (1 + df.get(w, 0))) + 1e-3 for w in template_words()}


def _phrase_at(words: Column, start: Column, phrase: list[str]) -> Column:
    """Whether the phrase stands at that 0-based word; a start before the text or too near its end is no match."""
    return (start >= 0) & (F.slice(words, F.greatest(start, F.lit(0)) + 1, len(phrase)) == F.array(*map(F.lit, phrase)))


def _base(words: Column) -> tuple[Column, dict[str, Column]]:
    """Places (word index) of all base phrases, and per label whether it has one."""
    indexed = F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    heads = F.filter(indexed, lambda x: x["w"].isin([p.split()[0] for p in BASE_PHRASES]))

    def places(phrase: list[str]) -> Column:
        return F.transform(F.filter(heads, lambda x: _phrase_at(words, x["i"], phrase)), lambda x: x["i"])

    each = {label: places(phrase.split()) for phrase, label in BASE_PHRASES.items()}
    return F.concat(*each.values()), {label: F.size(at) > 0 for label, at in each.items()}


def _verified(scan: DataFrame, weights: dict[str, float]) -> DataFrame:
    """scan (with cand, the words of texts that may have a label) and own: an array of (label, score).

    Each step is a column of its own that later steps read, so that none is computed again for every element.
    """
    bodies = [body.split() for _, body, _ in TEMPLATES]
    rarest = [sorted(set(b), key=lambda w: (-weights[w], w))[: max(TEMPLATE_WORDS, len(set(b)) // 2)] for b in bodies]
    postings: dict[str, list[tuple[int, int]]] = {}
    for t, body in enumerate(bodies):
        for p, w in enumerate(body):
            if w in rarest[t]:
                postings.setdefault(w, []).append((t, p))
    total = [sum(weights[w] for w in body if w in rarest[t]) for t, body in enumerate(bodies)]
    lists = [{"w": w, "at": [{"t": t, "p": p, "v": weights[w]} for t, p in ps]} for w, ps in postings.items()]
    entries = F.from_json(F.lit(json.dumps(lists)), "array<struct<w:string,at:array<struct<t:int,p:int,v:double>>>>")
    scan = scan.withColumn("rare", F.array_intersect(F.array(*map(F.lit, postings)), "cand"))
    scan = scan.withColumn("lists", F.filter(entries, lambda e: F.array_contains("rare", e["w"])))
    scan = scan.withColumn("hits", F.filter(F.transform("cand", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.array_contains("rare", x["w"])))
    vote = lambda h, p: F.struct(p["t"].alias("t"), (h["i"] - p["p"]).alias("at"), p["v"].alias("v"))
    scan = scan.withColumn("votes", F.array_sort(F.flatten(F.transform("hits", lambda h: F.flatten(F.transform(F.filter("lists", lambda e: e["w"] == h["w"]), lambda e: F.transform(e["at"], lambda p: vote(h, p))))))))
    # votes for one template start are neighbours now: the first of each run gets the sum of the run
    scan = scan.withColumn("ends", F.filter(F.transform("votes", lambda x, i: F.struct(x["t"].alias("t"), x["at"].alias("at"), i.alias("i"))), lambda x: (x["i"] == 0) | ~(F.get("votes", x["i"] - 1)["t"].eqNullSafe(x["t"]) & F.get("votes", x["i"] - 1)["at"].eqNullSafe(x["at"]))))
    longest = max(len(body.split()) for _, body, _ in TEMPLATES)
    summed = lambda x: F.aggregate(F.filter(F.slice("votes", x["i"] + 1, longest), lambda y: (y["t"] == x["t"]) & (y["at"] == x["at"])), F.lit(0.0), lambda a, y: a + y["v"])
    scan = scan.withColumn("runs", F.transform("ends", lambda x: F.struct(x["t"].alias("t"), x["at"].alias("at"), summed(x).alias("v"))))

    def best(t: int, seq: list[str], key: list[str]) -> Column:
        offset = next(i for i in range(len(seq)) if seq[i : i + len(key)] == key)
        weight = F.lit(total[t])
        ok = F.filter("runs", lambda r: (r["t"] == t) & (r["v"] >= MIN_WEIGHT * weight) & _phrase_at(F.col("cand"), r["at"] + offset, key))
        most = F.array_max(F.transform(ok, lambda r: r["v"])) / weight
        return F.when(most.isNotNull(), F.least(most, F.lit(1.0)))

    found = [F.struct(F.lit(label).alias("label"), best(t, body.split(), phrase.split()).alias("score")) for t, (label, body, phrase) in enumerate(TEMPLATES)]
    return scan.withColumn("own", F.filter(F.array(*found), lambda x: x["score"].isNotNull()))


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, the base phrase counts and places, base and all labels, score and the method's own labels."""
    words = docs.select("doc_id", "text", words_of().alias("words"))
    weights = idf(words)
    # A label needs a whole key phrase, so a text without the longest word of any phrase has none.
    anchors = {max(p.split(), key=len) for p in [*BASE_PHRASES, *(t[2] for t in TEMPLATES)]} - {"nc"}
    lower = ascii_lower("text")
    may = F.lit(False)
    for a in sorted(anchors):
        may = may | F.contains(lower, F.lit(a))
    empty = F.array().cast("array<string>")
    scan = words.select("doc_id", F.size("words").cast("long").alias("n_words"), F.when(may, F.col("words")).otherwise(empty).alias("cand"))
    places, has = _base(F.col("cand"))
    scan = _verified(scan, weights).select("doc_id", "n_words", "own", places.alias("places"), *[x.alias(f"has_{k}") for k, x in has.items()])
    base = F.array_compact(F.array(*[F.when(F.col(f"has_{label}"), F.lit(label)) for label in BASE_PHRASES.values()]))
    own = F.coalesce(F.transform("own", lambda x: x["label"]), empty)
    score = F.coalesce(F.when(F.size("places") > 0, F.lit(1.0)), F.array_max(F.transform("own", lambda x: x["score"])), F.lit(0.0))
    return scan.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, own))), ",").alias("labels"),
        score.alias("score"), F.array_join(F.array_sort(F.array_distinct(own)), ",").alias("index_labels"),
    )


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))
