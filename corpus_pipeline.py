"""A corpus pipeline: toxic documents go, one of each near-duplicate group stays, benchmark leaks go, secrets are
replaced, and what is left is packed into sequences. Each stage is written as Parquet and read again by the next; the
table before it is deleted then.

Edge cases, for all stages: null ids and null texts stay rows (a null text is empty to every judgement and stays null);
rows with one id are judged by their own texts, and of equal ones near-dedup keeps one; texts are read whole; ties of a
group go to the least id, then the least text; extra columns stay, whatever their names; with no documents, labels or
benchmark a stage gives what it has, down to no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.llm import decontam, nearcopies, packing, secrets, toxicity
from lumora.llm._common import discard, documents, written
from lumora.llm._tokens import tokenizer_path

#: Near copies here: five-word shingle sets with this Jaccard similarity or more.
NEAR_WORDS = 5
NEAR_SIMILARITY = 0.8


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    field = toxicity.trained_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.scored_column(docs, field)["score"] < toxicity.THRESHOLD)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearcopies.deduplicated(docs, NEAR_WORDS, NEAR_SIMILARITY)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return docs.where(~decontam.is_contaminated(spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced, the documents stay; n_chars follows the text."""
    clean = docs.withColumn("text", secrets.redacted_column(secrets.trained_on(docs)))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, tokenizer_path())


STAGES = [
    ("toxicity", without_toxic),
    ("simhash near-dedup", without_near_copies),
    ("benchmark decontamination", without_leaks),
    ("secret scans", without_secrets),
    ("packing", into_sequences),
]

#: SQL has no form of these stages; tests/llm/test_pipeline*.py compares each with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
