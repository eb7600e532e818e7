"""Shared helpers of the corpus operators: the shared folder, written intermediates, word rules."""

from __future__ import annotations

import re
import tempfile
import uuid

import pandas as pd
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets a temporary one; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is unset: set it to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lumora-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lumora/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and a lost executor costs a re-read."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.lumora_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that no later step and no returned DataFrame reads; others are left alone."""
    for df in tables:
        path = df.__dict__.get("lumora_path")
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(text: str | Column) -> Column:
    """A-Z to a-z and nothing else; a null text is empty."""
    return F.translate(F.coalesce(text, F.lit("")), ASCII_UPPER, ASCII_LOWER)


def ranged_by_id(docs: DataFrame) -> DataFrame:
    """doc_id and text, ranged over partitions and sorted by doc_id, null first. Rows of one id go by a hash of their text and equal rows by their place, so that no id, null included, falls to one task."""
    rows = docs.select("doc_id", "text").withColumn("_hash", F.xxhash64("text")).withColumn("_place", F.monotonically_increasing_id())
    order = ["doc_id", "_hash", "_place"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_hash", "_place")


def filesystem(address: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of an address as Spark writes it, and the path in it. Schemes that only Spark's connectors know are named as pyarrow does; credentials are those that the machine gives pyarrow."""
    return pyarrow.fs.FileSystem.from_uri(arrow_address(address))


def arrow_address(address: str) -> str:
    """s3a and s3n are s3, a blob store's wasb(s) is its abfs(s), a mounted dbfs is a folder; file, hdfs, gs and others stay."""
    scheme, _, rest = address.partition(":")
    if scheme in ("s3a", "s3n"):
        return f"s3:{rest}"
    if scheme in ("wasb", "wasbs"):
        return f"abfs{scheme[4:]}:{rest.replace('.blob.', '.dfs.', 1)}"
    if scheme == "dbfs":
        return "file:///dbfs/" + rest.lstrip("/")
    return address


def split_id(*columns: str) -> list[Column]:
    """For Python: the id without nulls, which pandas would turn into floating point, and a mark for them, then the columns."""
    return [F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"), F.col("doc_id").isNull().alias("id_null"), *map(F.col, columns)]


def ids_of(batch: pd.DataFrame) -> list[int | None]:
    return [None if null else i for i, null in zip(batch["doc_id"].tolist(), batch["id_null"].tolist())]


def rows_frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    """Rows as a batch of that schema, whose first column is the doc_id; longs may be null."""
    names = [c.split() for c in schema.split(", ")]
    return pd.DataFrame({n: pd.array([r[k] for r in rows], "Int64") if kind == "long" else [r[k] for r in rows] for k, (n, kind) in enumerate(names)})
