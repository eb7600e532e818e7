"""The stateful kernels on small hand-made inputs, and their accounting."""

import pytest

from lumora.operators.kernels import Evidence, Retention, Sampler, Segmenter, StreamError


def sampled(frames, **policy):
    s = Sampler(**policy)
    return [s.decide(*f)[:2] for f in frames]


def sig(v):
    return [v] * 64


def test_static_frames_have_heartbeats():
    got = sampled([(k * 1000, sig(10)) for k in range(11)])
    assert [k for k, (keep, _) in enumerate(got) if keep] == [0, 5, 10] and [r for _, r in got].count("static_heartbeat") == 2


def test_sampler_order_of_rules():
    assert sampled([(0, sig(10)), (40, sig(10)), (600, sig(10)), (1200, sig(200))], min_interval=500) == [(True, "first_frame"), (False, "rate_limited"), (False, "no_change_yet"), (True, "content_change")]
    assert sampled([(1000, sig(1)), (1040, None), (1000, sig(1))]) == [(True, "first_frame"), (False, "missing_signature"), (False, "non_monotonic_pts")]
    assert sampled([(0, sig(10), 4000), (2000, sig(200), 4000), (3000, sig(200))]) == [(True, "first_frame"), (False, "backpressure_throttled"), (True, "content_change")]
    assert sampled([(0, sig(10)), (1500, sig(200), 500)])[1] == (True, "content_change")


def evidence(frames, **policy):
    e = Evidence(**policy)
    rows = [r for k, f in enumerate(frames) for r in e.observe(k, *f)]
    return sorted([*rows, *map(list, e.finish())])


def test_static_evidence_covers_the_gap():
    rows = evidence([(k * 33, sig(10)) for k in range(120)])
    chosen = [r[1] for r in rows if r[3] != "not_selected"]
    assert len(rows) == 120 and not any(r[4] for r in rows) and max(b - a for a, b in zip(chosen, chosen[1:])) <= 1033


def test_change_opens_one_window():
    rows = evidence([(k * 33, sig(10)) for k in range(10)] + [(330 + k * 33, sig(200)) for k in range(3)])
    got = [r[3] for r in rows if r[4] == "win-00000001"]
    assert got == ["event_pre_context"] * 2 + ["event_anchor"] + ["event_post_context"] * 2


def test_text_change_and_rate_limit():
    rows = evidence([(0, sig(128), sig(0)), (200, sig(128), sig(90)), (210, sig(10), sig(90))])
    assert rows[1][2:4] == ["text_change", "event_anchor"] and rows[2][5] == "event_rate_limited"


def test_sampler_keep_becomes_an_anchor():
    e = Evidence()
    assert [r[3] for k, keep in enumerate([False, True]) for r in e.observe(k, k * 10, sig(5), None, keep)] == ["baseline_anchor", "baseline_anchor"]


def segments(chunks, **policy):
    s = Segmenter(**policy)
    out = [x for pts, n in chunks for x in s.chunk(100_000, 1, "F32LE", pts, 10, n)[0]]
    return [x[:3] for x in [*out, *s.finish()]]


def test_segments():
    line = [(k * 10, 4000) for k in range(40)]
    assert segments(line[:25], segment_ms=200) == [(0, 200, False), (200, 250, True)]
    assert segments(line, segment_ms=200, overlap_ms=50) == [(0, 200, False), (150, 350, False), (300, 400, True)]
    assert segments([(0, 4000), (10, 4000), (5000, 4000)], segment_ms=200) == [(0, 20, True), (5000, 5010, True)]


def test_segment_drops_and_errors():
    s = Segmenter()
    assert s.chunk(8000, 1, "S16LE", 0, 10, 4)[1] == "audio_unsupported_sample_format"
    assert s.chunk(8000, 1, "F32LE", 0, 10, 3)[1] == "audio_bytes_not_frame_aligned" and s.chunk(8000, 1, "F32LE", -1, 10, 4)[1] == "audio_timing_unavailable"
    with pytest.raises(StreamError, match="audio_format_changed_mid_stream"):
        s.chunk(9000, 1, "F32LE", 0, 10, 4)
    with pytest.raises(StreamError, match="audio_segment_format_unknown"):
        s.chunk(0, 1, "F32LE", 0, 10, 4)


def test_retention_accounts_for_every_offer():
    r = Retention(limit=4, arena_bytes=100)
    got = [r.offer(1, "a", 10), r.offer(1, "a", 10), r.offer(2, "a", 10), r.offer(3, "a", 10), r.offer(4, "b", 90), r.offer(5, "b", 10), r.release(1), r.release(1), r.offer(6, "a", 10)]
    assert got == ["retained", "duplicate_buffer", "retained", "kind_quota", "arena_full", "retained", "released", "unknown_buffer", "retained"]
    assert r.bytes == 30 and len(r.held) == 3


def test_as_of_finds_a_long_interval_behind_a_short_one(spark):
    from lumora.operators.timeline import as_of

    obs = spark.createDataFrame([(1, 10, 0, 1000), (1, 11, 400, 410), (1, 12, 3000, 3010), (2, 13, 0, 5)], "stream_id long, observation_id long, start_ms long, end_ms long")
    reads = spark.createDataFrame([(1, 1, 500), (1, 2, 405), (1, 3, 2500), (1, 4, 1700), (2, 5, 5), (3, 6, 1)], "stream_id long, read_id long, at_ms long")
    got = {r["read_id"]: (r["observation_id"], r["covering"], r["offset_ms"]) for r in as_of(reads, obs, ["stream_id"], 300).collect()}
    assert got == {1: (10, True, -500), 2: (11, True, -5), 3: (12, False, 500), 4: (11, False, -1300), 5: (13, False, -5), 6: (None, False, None)}


def test_schedule_against_all_pairs(spark):
    from lumora.operators.orchestration import schedule

    nodes = [(k, k % 3, k % 2, (k * 37) % 50, (k * 7) % 100) for k in range(60)]
    tasks = [(k, k % 4, k % 2, (k * 13) % 60) for k in range(80)]
    got = {r["task_id"]: r["node_id"] for r in schedule(spark.createDataFrame(tasks, "task_id long, cell long, kind long, memory long"), spark.createDataFrame(nodes, "node_id long, node_cell long, kind long, free_memory long, heartbeat_age_s long")).collect()}
    for i, cell, kind, memory in tasks:
        fit = sorted((c != cell, n) for n, c, k, free, age in nodes if k == kind and free >= memory and age <= 90)
        assert got[i] == (fit[0][1] if fit else None)
