"""The durable consumer: nothing twice, nothing lost, failures counted, the sink left unread."""

import shutil
from pathlib import Path

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from lumora.streaming import consumer as c

SCHEMA = "id long, at_ms long, v string"


def files(spark, path, *parts):
    """One file for each micro-batch, in order."""
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/{n}")
        for f in sorted(Path(f"{path}/{n}").glob("*.parquet")):
            f.rename(f"{path}/{n:04d}.parquet")
        shutil.rmtree(f"{path}/{n}")


def run(spark, path, consumer, handle=c.taken, checkpoint="ck"):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    c.consume(stream, consumer, handle, f"{path}/{checkpoint}").start().awaitTermination()


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_once_and_only_the_ledger_is_read(spark, tmp_path):
    own = c.Consumer(f"{tmp_path}/out", ("id",))
    (tmp_path / "in").mkdir()
    files(spark, f"{tmp_path}/in", [(k, k, "a") for k in range(100)], [(k, k, "b") for k in range(90, 200)])
    run(spark, tmp_path, own)
    assert ids(c.committed(spark, own.path)) == list(range(200))
    done = sorted(c.ledger(spark, own.path).collect(), key=lambda r: r["batch"])
    assert [(r["first"]["id"], r["last"]["id"], r["received"], r["rows"]) for r in done] == [(0, 99, 100, 100), (100, 199, 110, 100)]
    # a batch of greater keys needs nothing of what is stored: it may be gone
    for folder in (tmp_path / "out").glob("query=*"):
        shutil.rmtree(folder)
    spark.createDataFrame([(k, k, "c") for k in range(500, 510)], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/more")
    next(Path(f"{tmp_path}/more").glob("*.parquet")).rename(f"{tmp_path}/in/9.parquet")
    run(spark, tmp_path, own)
    assert ids(c.committed(spark, own.path)) == list(range(500, 510))
    # one that meets them needs their keys
    spark.createDataFrame([(150, 0, "d")], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/again")
    next(Path(f"{tmp_path}/again").glob("*.parquet")).rename(f"{tmp_path}/in/99.parquet")
    with pytest.raises(StreamingQueryException, match="PATH_NOT_FOUND"):
        run(spark, tmp_path, own)


def test_a_lost_batch_adds_nothing_twice(spark, tmp_path, monkeypatch):
    own = c.Consumer(f"{tmp_path}/out", ("id",))
    (tmp_path / "in").mkdir()
    files(spark, f"{tmp_path}/in", [(1, 1, "a"), (2, 2, "a")], [(2, 2, "b"), (3, 3, "b")])
    commit, lost = c._commit, []

    def killed(*a, **k):
        if not lost and a[1] == 1:
            lost.append(a)
            raise RuntimeError("killed")
        return commit(*a, **k)

    monkeypatch.setattr(c, "_commit", killed)
    with pytest.raises(StreamingQueryException, match="killed"):
        run(spark, tmp_path, own)
    assert ids(c.committed(spark, own.path)) == [1, 2]  # what was written is not committed
    run(spark, tmp_path, own)
    assert ids(c.committed(spark, own.path)) == [1, 2, 3]
    run(spark, tmp_path, own, checkpoint="another")
    assert ids(c.committed(spark, own.path)) == [1, 2, 3]
    # a batch whose commit is there does nothing
    query = c.ledger(spark, own.path).where("batch = 1 AND rows = 1").first()["query"]
    c.consume_batch(spark.createDataFrame([(77, 0, "x")], SCHEMA), 1, query, own, c.taken)
    assert ids(c.committed(spark, own.path)) == [1, 2, 3]


def test_failures_come_again_and_stop_at_the_limit(spark, tmp_path):
    own = c.Consumer(f"{tmp_path}/out", ("id",), max_deliver=3)
    (tmp_path / "in").mkdir()
    files(spark, f"{tmp_path}/in", [(1, 0, "a"), (2, 0, "bad"), (None, 0, "a")], [(3, 0, "a")], [(4, 0, "a")], [(5, 0, "a")])
    bad = lambda rows: rows.withColumn("reason_code", F.when(F.col("v") == "bad", "payload_invalid"))
    with pytest.raises(StreamingQueryException, match="event_retry_exhausted"):
        run(spark, tmp_path, own, bad)
    assert ids(c.committed(spark, own.path)) == [1, 3]
    dead = {(r["id"], r["reason_code"], r["deliveries"]) for r in c.of_kind(spark, own.path, "dead").collect()}
    assert dead == {(2, "payload_invalid", 3), (None, "event_message_id_missing", 3)}
    # another handler takes the row; the one without an id stops it again
    with pytest.raises(StreamingQueryException, match="event_message_id_missing"):
        run(spark, tmp_path, own)
    with pytest.raises(c.ConsumerStopped, match="max_deliver=3!=4"):
        run(spark, tmp_path, c.Consumer(own.path, ("id",), max_deliver=4))


def test_a_mended_handler_goes_on(spark, tmp_path):
    own = c.Consumer(f"{tmp_path}/out", ("id",), max_deliver=2)
    (tmp_path / "in").mkdir()
    files(spark, f"{tmp_path}/in", [(1, 0, "a"), (2, 0, "bad")], [(3, 0, "a")], [(4, 0, "a")])
    with pytest.raises(StreamingQueryException, match="payload_invalid"):
        run(spark, tmp_path, own, lambda rows: rows.withColumn("reason_code", F.when(F.col("v") == "bad", "payload_invalid")))
    run(spark, tmp_path, own)
    assert ids(c.committed(spark, own.path)) == [1, 2, 3, 4]


def test_late_rows_have_a_table(spark, tmp_path):
    own = c.Consumer(f"{tmp_path}/out", ("id",), event_time="at_ms", late_ms=100)
    (tmp_path / "in").mkdir()
    files(spark, f"{tmp_path}/in", [(1, 1000, "a"), (2, 10, "a")], [(3, 899, "late"), (4, 900, "in time"), (5, 2000, "a")], [(6, 1899, "late"), (7, None, "no time")])
    run(spark, tmp_path, own)
    assert ids(c.committed(spark, own.path)) == [1, 2, 4, 5, 7]
    assert ids(c.of_kind(spark, own.path, "late").where("reason_code = 'behind_watermark'")) == [3, 6]
    assert sum(r["late"] for r in c.ledger(spark, own.path).collect()) == 2
