"""Readers and writers of the model's files. A source that cannot be read is an error, never an empty table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAME = "record STRING, stream_id STRING, frame_index BIGINT, pts_ms BIGINT, end_ms BIGINT, signature ARRAY<INT>, text_signature ARRAY<INT>, decision STRING, selection STRING, window_id STRING, skip_reason STRING"
OBSERVATION = "observation_id STRING, modality STRING, stream_id STRING, start_ms BIGINT, end_ms BIGINT, payload STRING, confidence DOUBLE, quality_state STRING"
KNOWN_RECORDS = ("frame", "window")


class SourceUnavailable(RuntimeError):
    """The source is not there; its text is a stable code."""


def table(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise SourceUnavailable("source_unavailable") from e
        raise


def probed(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and whole-file digest of each file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("digest"))


def frame_ledger(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """A line-per-record ledger, at once or as it grows. Unknown record kinds raise when they are read."""
    reader = spark.readStream if stream else spark.read
    rows = reader.schema(FRAME).json(path)
    known = F.when(F.col("record").isin(*KNOWN_RECORDS), F.col("record")).otherwise(F.raise_error(F.lit("ledger_record_unknown")))
    return rows.withColumn("record", known)


def report(spark: SparkSession, path: str, schema: str = OBSERVATION) -> DataFrame:
    """A JSON report with exactly these fields; anything malformed fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def complete(ledger: DataFrame, frames: int, windows: int) -> DataFrame:
    """One row: whether the ledger has as many frames and windows as its report says."""
    return ledger.agg((F.count_if(F.col("record") == "frame") == frames).alias("frames_complete"), (F.count_if(F.col("record") == "window") == windows).alias("windows_complete"))


def exported(spans: DataFrame) -> DataFrame:
    """One JSON line for each span."""
    return spans.select(F.to_json(F.struct(*spans.columns)).alias("value"))


def write_outbox(outbox: DataFrame, path: str) -> None:
    """Partitioned by the month of creation, so old months are pruned."""
    outbox.withColumn("month", F.date_format(F.timestamp_millis("created_ms"), "yyyy-MM")).write.partitionBy("month").mode("append").parquet(path)
