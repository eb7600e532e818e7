"""Streams give what batches give, sinks add nothing twice, and sources fail loudly."""

import pytest
from pyspark.sql import functions as F

from lumora.operators import kernels as k
from lumora.plans.fixtures import view
from lumora.sources import readers
from lumora.streaming import jobs

FRAME = "stream_id long, frame_index long, pts_ms long, signature array<long>"


def frames(spark, sf_dir):
    return view(spark, sf_dir, "point").where("stream_id < 12").select("stream_id", F.col("decode_index").alias("frame_index"), "pts_ms", F.array("luma", "luma").alias("signature"))


def test_streamed_sampler_equals_batch(spark, sf_dir, tmp_path):
    rows = frames(spark, sf_dir)
    rows.repartition(1).sortWithinPartitions("frame_index").write.parquet(f"{tmp_path}/in")
    policy = {"min_interval": 7_200_000, "static_hold": 28_800_000, "threshold": 30}
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = jobs.sampled(stream, **policy).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(spark.read.parquet(f"{tmp_path}/out").collect()) == sorted(k.sample(rows, **policy).collect())


def test_sink_is_idempotent(spark, tmp_path):
    spark.range(5).withColumn("v", F.lit("a")).write.parquet(f"{tmp_path}/in")
    for n in range(2):
        stream = spark.readStream.schema("id long, v string").parquet(f"{tmp_path}/in")
        jobs.append_once(stream, f"{tmp_path}/out", ["id"], f"{tmp_path}/ck{n}").start().awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5


def test_sources(spark, tmp_path):
    with pytest.raises(readers.SourceUnavailable, match="source_unavailable"):
        readers.table(spark, f"{tmp_path}/nowhere")
    (tmp_path / "a.jsonl").write_text('{"record":"frame","frame_index":1}\n{"record":"window","window_id":"w"}\n')
    assert readers.complete(readers.frame_ledger(spark, f"{tmp_path}/a.jsonl"), 1, 1).first() == (True, True)
    (tmp_path / "b.jsonl").write_text('{"record":"other"}\n')
    with pytest.raises(Exception, match="ledger_record_unknown"):
        readers.frame_ledger(spark, f"{tmp_path}/b.jsonl").collect()
    (tmp_path / "c.json").write_text('{"observation_id": "x", "start_ms": "bad"}\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.report(spark, f"{tmp_path}/c.json").collect()
    assert readers.probed(spark, f"{tmp_path}/a.jsonl").first()["digest"].startswith("sha256:")


def test_an_idle_stream_gives_its_last_segment(spark, tmp_path):
    import time

    chunk = "stream_id long, pts_ms long, duration_ms long, sample_rate long, channels long, sample_format string, n_bytes long"
    rows = spark.createDataFrame([(s, 100 * k, 100, 1000, 1, "F32LE", 400) for s in (1, 2) for k in range(13)], chunk)
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(chunk).parquet(f"{tmp_path}/in")
    q = jobs.segmented(stream, idle_ms=500, segment_ms=1000).writeStream.format("memory").queryName("idle_segments").option("checkpointLocation", f"{tmp_path}/ck").start()
    try:
        until = time.time() + 60
        while time.time() < until and spark.table("idle_segments").count() < 4:
            time.sleep(0.5)
    finally:
        q.stop()
    want = k.segment_audio(rows, segment_ms=1000)
    assert sorted(spark.table("idle_segments").collect()) == sorted(want.collect()) and want.count() == 4


def test_rows_without_a_stream_are_one_group(spark):
    big = 2**60 + 1
    rows = spark.createDataFrame([(s, n, n * 10_000, [n]) for s in (None, big) for n in range(3)], FRAME)
    got = k.sample(rows, min_interval=1, static_hold=10**9, threshold=10**6).collect()
    assert sorted(r["reason"] for r in got if r["stream_id"] is None) == ["first_frame", "no_change_yet", "no_change_yet"]
    assert {r["stream_id"] for r in got} == {None, big}
