"""A durable consumer: each delivery is stored once, failures are delivered again up to a limit, and a ledger says what counts.

A micro-batch writes its rows to a folder of its own and then one row to the ledger: query, batch, least and greatest
key, counts, greatest event time. That row is the commit. A batch that is run again after its commit does nothing; one
that was lost before it overwrites its own folders, so nothing is there twice. To find deliveries that came before, a
batch compares its keys with the ledger's ranges and reads the keys of those earlier batches alone whose range meets its
own; with growing keys that is none, whatever the sink holds.

Rows that the handler gives a reason go to the pending table, with how often they were delivered, and come again with
the next batch. A row that failed max_deliver times goes to the dead letters and stops the query before its batch is
committed: nothing is dropped, and a restart with a handler that takes the row goes on. Rows behind the watermark go to
a table of their own with their reason and are never lost silently.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

Handler = Callable[[DataFrame], DataFrame]


class ConsumerStopped(RuntimeError):
    """The consumer cannot go on; its text begins with a stable code."""


@dataclass(frozen=True)
class Consumer:
    """What a consumer's restarts must agree on. event_time: a column of milliseconds; late_ms: how far behind the greatest one a row may be."""

    path: str
    keys: tuple[str, ...]
    name: str = "consumer"
    max_deliver: int = 5
    event_time: str | None = None
    late_ms: int = 0

    def contract(self) -> dict[str, object]:
        return {"name": self.name, "keys": list(self.keys), "max_deliver": self.max_deliver, "event_time": self.event_time, "late_ms": self.late_ms}


def _there(spark: SparkSession, path: str, **options: str) -> DataFrame | None:
    """The table at a path, or None where nothing is yet."""
    try:
        return spark.read.options(**options).parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def require_contract(spark: SparkSession, consumer: Consumer) -> None:
    """Stores the contract at the first start; at a later one any difference is an error, and nothing is overwritten."""
    own = consumer.contract()
    stored = _there(spark, f"{consumer.path}/_contract")
    if stored is None:
        spark.createDataFrame([(json.dumps(own, sort_keys=True),)], "contract string").coalesce(1).write.parquet(f"{consumer.path}/_contract")
        return
    there = json.loads(stored.first()["contract"])
    differs = [f"{k}={there.get(k)}!={own[k]}" for k in sorted(own) if there.get(k) != own[k]]
    if differs:
        raise ConsumerStopped("event_consumer_contract_mismatch: " + ";".join(differs))


def ledger(spark: SparkSession, path: str) -> DataFrame | None:
    return _there(spark, f"{path}/_ledger", recursiveFileLookup="true")


def _folder(path: str, kind: str, query: str, batch: int) -> str:
    return f"{path}{kind}/query={query}/batch={batch}"


def committed(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of committed batches, with query and batch; None before the first commit."""
    done = ledger(spark, path)
    rows = None if done is None else _there(spark, path)
    return None if rows is None else rows.join(F.broadcast(done.select("query", "batch")), ["query", "batch"], "left_semi")  # a row a batch


def of_kind(spark: SparkSession, path: str, kind: str) -> DataFrame | None:
    """late, dead or pending rows of all batches."""
    return _there(spark, f"{path}/_{kind}")


def _seen_before(spark: SparkSession, consumer: Consumer, done: DataFrame, bounds) -> DataFrame | None:
    """The keys of earlier batches whose range meets these bounds."""
    edge = lambda end: F.struct(*[F.lit(bounds[end][k]).cast(done.schema[end].dataType[k].dataType).alias(k) for k in consumer.keys])
    near = done.where((F.col("rows") > 0) & (F.col("first") <= edge("last")) & (F.col("last") >= edge("first")))
    folders = [_folder(consumer.path, "", r["query"], r["batch"]) for r in near.select("query", "batch").collect()]  # batches, not rows
    return spark.read.parquet(*folders).select(*consumer.keys) if folders else None


def consume_batch(batch: DataFrame, number: int, query: str, consumer: Consumer, handle: Handler) -> None:
    """One micro-batch: new rows and those that failed before. handle adds reason_code, null where a row is taken."""
    spark, keys = batch.sparkSession, list(consumer.keys)
    done = ledger(spark, consumer.path)
    mine = done.where(F.col("query") == query) if done is not None else None
    if mine is not None and not mine.where(F.col("batch") == number).isEmpty():
        return
    before = mine.agg(F.max("batch").alias("batch"), F.max("greatest_ms").alias("greatest_ms")).first() if mine is not None else None
    columns = batch.columns
    batch = batch.withColumn("deliveries", F.lit(0)).withColumn("again", F.lit(False)).persist()
    try:
        waiting = _there(spark, _folder(consumer.path, "/_pending", query, before["batch"])) if before and before["batch"] is not None else None
        rows = batch if waiting is None else batch.unionByName(waiting.select(*columns, "deliveries", F.lit(True).alias("again")))
        nameless = F.lit(False)
        for k in keys:
            nameless = nameless | F.col(k).isNull()
        # of equal keys the one that has been delivered most often stays
        named = rows.where(~nameless).groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), "deliveries").alias("r")).select(*keys, "r.*")
        once = named.unionByName(rows.where(nameless))
        time = F.max(consumer.event_time) if consumer.event_time else F.lit(None).cast("long")
        bounds = batch.agg(F.min(F.struct(*keys)).alias("first"), F.max(F.struct(*keys)).alias("last"), time.alias("greatest_ms"), F.count(F.lit(1)).alias("received")).first()
        if done is not None and bounds["received"]:
            seen = _seen_before(spark, consumer, done, bounds)
            if seen is not None:
                once = once.join(seen.distinct(), keys, "left_anti")
        greatest = before["greatest_ms"] if before else None
        behind = F.lit(False)
        if consumer.event_time and greatest is not None:
            behind = F.coalesce((F.col(consumer.event_time) < greatest - consumer.late_ms) & ~F.col("again"), F.lit(False))
        handled = handle(once.where(~nameless & ~behind)).select(*columns, "deliveries", "reason_code")
        lost = once.where(nameless).select(*columns, "deliveries", F.lit("event_message_id_missing").alias("reason_code"))
        judged = handled.unionByName(lost).withColumn("deliveries", F.col("deliveries") + 1).persist()
        try:
            out = {
                "": judged.where("reason_code IS NULL").select(*columns),
                "/_pending": judged.where((F.col("reason_code").isNotNull()) & (F.col("deliveries") < consumer.max_deliver)),
                "/_dead": judged.where((F.col("reason_code").isNotNull()) & (F.col("deliveries") >= consumer.max_deliver)),
                "/_late": once.where(behind).select(*columns, F.lit("behind_watermark").alias("reason_code")),
            }
            for kind, table in out.items():
                table.write.mode("overwrite").parquet(_folder(consumer.path, kind, query, number))
            dead = out["/_dead"].first()
            if dead is not None:
                raise ConsumerStopped(f"event_retry_exhausted: {dead['reason_code']}")
            n = judged.agg(F.count_if(F.col("reason_code").isNull()).alias("rows"), F.count_if(F.col("reason_code").isNotNull()).alias("failed")).first()
            _commit(out[""], number, query, consumer, bounds, n["rows"], n["failed"], out["/_late"].count(), greatest)
        finally:
            judged.unpersist()
    finally:
        batch.unpersist()


def _commit(rows: DataFrame, number: int, query: str, consumer: Consumer, bounds, n: int, failed: int, late: int, greatest: int | None) -> None:
    """The ledger's row; its keys' range is that of the rows that were stored."""
    time = max((t for t in (greatest, bounds["greatest_ms"]) if t is not None), default=None)
    row = rows.agg(F.min(F.struct(*consumer.keys)).alias("first"), F.max(F.struct(*consumer.keys)).alias("last"))
    row = row.select(
        F.lit(query).alias("query"), F.lit(number).cast("long").alias("batch"), "first", "last", F.lit(bounds["received"]).cast("long").alias("received"), F.lit(n).cast("long").alias("rows"),
        F.lit(failed).cast("long").alias("failed"), F.lit(late).cast("long").alias("late"), F.lit(time).cast("long").alias("greatest_ms"),
    )
    row.coalesce(1).write.mode("overwrite").parquet(f"{consumer.path}/_ledger/{query}-{number}")


def consume(stream: DataFrame, consumer: Consumer, handle: Handler, checkpoint: str) -> DataStreamWriter:
    """The stream's writer. The query is named by its checkpoint, so that a second checkpoint over one sink is another query."""
    require_contract(stream.sparkSession, consumer)

    def write(batch: DataFrame, number: int) -> None:
        query = json.loads(batch.sparkSession.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        consume_batch(batch, number, query, consumer, handle)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def taken(rows: DataFrame) -> DataFrame:
    """A handler that takes every row."""
    return rows.withColumn("reason_code", F.lit(None).cast("string"))
