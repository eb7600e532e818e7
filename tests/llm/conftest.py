import pytest

LONG = " ".join(f"word{k % 977} and token{k}." for k in range(20_000))
PASSAGE = "This first sentence has some nine plain words here. The second sentence also has quite a few plain words. A third one follows it with even more plain words. At last the fourth sentence ends the shared passage."
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs far away from the big bad wolf today."),
    (2, None),
    (3, ""),
    (4, LONG),
    (5, "Same text, twice over. Same text, twice over."),
    (6, "Same text, twice over. Same text, twice over."),
    (7, "Repeated row."),
    (7, "Repeated row."),
    (None, "A row without an id."),
    (8, "Opening words that are only here. " + PASSAGE + " A closing of its own."),
    (9, "Another opening entirely. " + PASSAGE + " Some other closing."),
    (-5, "Negative id, with ünïcode ÀÉ and tabs\tand\nlines\n\n\x00 end"),
    (2**62, "A very large id."),
]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns that operators use as names themselves."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(ROWS, SCHEMA)
    for name in ("shard", "slot", "size", "words", "span", "spans", "fp", "label", "labels", "score", "unit", "side", "virtual_slot", "places", "d", "t", "removed", "kept_id", "n_words"):
        docs = docs.withColumn(name, F.lit("x"))
    return docs.repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
