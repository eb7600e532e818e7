"""Leases, buffers and the growing ledger: kernels against plain replays, streams against batches."""

import random

import pytest
from lumora.operators import kernels as k
from lumora.streaming import stateful

FRAME = "stream_id long, frame_index long, pts_ms long, signature array<long>"
POLICY = {"gap": 900, "before": 2, "after": 2, "threshold": 40, "event_interval": 150}


def frames():
    rng, rows = random.Random(4), []
    for s in range(6):
        value, pts = 100, 0
        for n in range(90):
            value = rng.randrange(256) if rng.random() < 0.08 else value
            pts += rng.choice([33, 40, 66])
            rows.append((s, n * 2 + s, pts, [value] * 4))
    return rows


@pytest.fixture(scope="module")
def store(spark):
    stateful.state_store(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_ledger_is_in_order_and_windows_come_after_their_frames():
    ledger = k.EvidenceLedger(**POLICY)
    row = lambda n, pts, v: type("Row", (), {"frame_index": n * 10, "pts_ms": pts, "signature": [v]})()
    out, at = [], []
    for n in range(60):
        got = ledger.push(row(n, n * 40, 200 if n in (20, 21, 40) else 10))
        out += got
        at += [n] * len(got)
    tail = ledger.finish()
    shown = [r for r in out + tail if r[0] == "frame"]
    assert [r[1] for r in shown] == [n * 10 for n in range(60)]
    written = set()
    for r in out + tail:
        if r[0] == "frame":
            written.add(r[1])
        else:
            assert set(range(r[7], r[8] + 10, 10)) <= written and r[9] == sum(f[5] == r[5] for f in shown)
    windows = [r for r in out + tail if r[0] == "window"]
    assert [w[5] for w in windows] == [f"win-{n:08d}" for n in range(1, len(windows) + 1)] and len(windows) >= 2
    first = next(n for n, r in zip(at, out) if r[0] == "window")
    assert first < 30  # shown while frames still come


@pytest.mark.parametrize("files", [1, 4, 11])
def test_streamed_ledger_equals_batch(store, tmp_path, files):
    spark, rows = store, frames()
    clock = [(99, 0, 10**7, [1])]  # its time ends the other streams
    batch = spark.createDataFrame(rows, FRAME)
    for n in range(files):
        part = sorted(rows, key=lambda r: r[2])[len(rows) * n // files : len(rows) * (n + 1) // files]
        spark.createDataFrame(part, FRAME).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.createDataFrame(clock, FRAME).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(FRAME).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = stateful.growing_ledger(stream, "1 second", 5000, **POLICY).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    got = [tuple(r) for r in spark.read.schema(k.LEDGER_SCHEMA).parquet(f"{tmp_path}/out").collect() if r["stream_id"] != 99]
    want = [tuple(r) for r in k.evidence_ledger(batch, **POLICY).collect()]
    order = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=order) == sorted(want, key=order)
    assert sum(r[1] == "window" for r in want) >= 6


LEASE = "stream_id long, event_id long, at_ms long, action string, lease_id string, ttl_ms long"


def lease_events():
    rng, rows, n = random.Random(9), [], 0
    for s in range(4):
        for j in range(25):
            at, ttl, lease = rng.randrange(20_000), rng.randrange(50, 9000), f"lease-{j:016x}"
            rows.append((s, n, at, "acquire", lease, ttl))
            if rng.random() < 0.6:
                rows.append((s, n + 1, at + rng.randrange(12_000), "release", lease, None))
            n += 2
    return rows


def plain_ends(rows):
    out = {}
    for s, n, at, action, lease, ttl in rows:
        if action == "acquire":
            ends = [t for s2, n2, t, a, x, _ in rows if (s2, a, x) == (s, "release", lease) and (t, n2) > (at, n) and t < at + ttl]
            out[s, lease] = (at, min(ends), "released") if ends else (at, at + ttl, "expired")
    return {(*key, *v) for key, v in out.items()}


def test_streamed_leases_equal_batch(store, tmp_path):
    spark, rows = store, sorted(lease_events(), key=lambda r: (r[2], r[1]))
    for n in range(5):
        spark.createDataFrame(rows[len(rows) * n // 5 : len(rows) * (n + 1) // 5], LEASE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.createDataFrame([(99, 10**6, 10**7, "release", "none", None)], LEASE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(LEASE).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = stateful.ended_leases(stream, "0 seconds").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {tuple(r) for r in spark.read.schema(stateful.LEASE_SCHEMA).parquet(f"{tmp_path}/out").collect()}
    batch = {tuple(r) for r in stateful.lease_ends(spark.createDataFrame(rows, LEASE), 10**7).collect()}
    assert batch == plain_ends(rows) == got
    early = {tuple(r) for r in stateful.lease_ends(spark.createDataFrame(rows, LEASE), 5000).collect()}
    assert early == {r if r[3] <= 5000 else (*r[:3], None, "outstanding") for r in plain_ends(rows)}


EVENT = "stream_id long, event_id long, at_ms long, action string, buffer_id long, kind string, n_bytes long, offset long, length long, ttl_ms long, lease_id string, claimed_ms long, read_only boolean"


def buffer_events(rng, n):
    rows = []
    for e in range(n):
        action = rng.choice(["retain"] * 3 + ["acquire"] * 4 + ["validate", "release", "release", "expire"])
        window = rng.random() < 0.5
        rows.append((1, e, e * rng.choice([0, 20, 37]) if rng.random() < 0.1 else e * 37, action, rng.randrange(9), rng.choice(["audio", "video"]), rng.choice([0, 50, 300, 900]), rng.randrange(-1, 400) if window else None, rng.randrange(0, 500) if window else None, rng.choice([10, 60, 200, 900, 70_000]), f"lease-{max(1, e // 17 + rng.randrange(-2, 3)):016x}", None if rng.random() < 0.7 else e * 37 + 200, rng.random() < 0.9))
    return rows


def plain_handoff(rows, limit, arena):
    """A replay over plain lists, one rule after the other."""
    held, leases, issued, out = [], [], 0, []  # [id, kind, bytes, lease], [lease, until, buffer]
    gone = lambda buffer: held.remove(next(h for h in held if h[0] == buffer))
    for _, e, now, action, buffer, kind, n, offset, length, ttl, lease, claimed, read_only in rows:
        grant, lost = (None,) * 4, 0

        def expire():
            over = [x for x in leases if x[1] <= now]
            for x in over:
                leases.remove(x)
                gone(x[2])
            return len(over)

        mine = [x for x in leases if x[0] == lease]
        if action == "retain":
            result = next((code for bad, code in [
                (n == 0, "empty_buffer_payload"), (len(held) >= limit, "handoff_backlog_full"), (sum(h[1] == kind for h in held) >= limit // 2, "handoff_kind_quota_full"),
                (any(h[0] == buffer for h in held), "duplicate_buffer_id"), (sum(h[2] for h in held) + n > arena, "arena_capacity_exceeded")] if bad), "retained")
            if result == "retained":
                held.append([buffer, kind, n, None])
        elif action == "acquire":
            if not 50 <= ttl <= 60_000:
                result = "invalid_lease_ttl"
            else:
                lost = expire()
                own = [h for h in held if h[0] == buffer]
                if not own:
                    result = "unknown_buffer"
                else:
                    o, m = (offset or 0, length) if length is not None else (0, own[0][2])
                    if m <= 0 or o < 0 or o + m > own[0][2]:
                        result = "mapping_out_of_range"
                    elif own[0][3]:
                        result = "buffer_already_leased"
                    else:
                        issued += 1
                        grant, result = (f"lease-{issued:016x}", o, m, now + ttl), "granted"
                        own[0][3] = grant[0]
                        leases.append([grant[0], now + ttl, buffer])
        elif action == "validate":
            result = "unknown_or_released_lease" if not mine else "lease_expiry_mismatch" if claimed is not None and claimed != mine[0][1] else "lease_is_read_only" if not read_only else "invalid_or_expired_lease" if mine[0][1] <= now else "valid"
        elif action == "release":
            result = "released" if mine else "unknown_or_released_lease"
            if mine:
                leases.remove(mine[0])
                gone(mine[0][2])
        else:
            lost, result = expire(), "expired"
        out.append((1, e, result, *grant, lost, len(held), len(leases), sum(h[2] for h in held)))
    return out


def test_handoff_replay(spark):
    seen = set()
    for seed in range(4):
        rows = buffer_events(random.Random(seed), 900)
        got = [tuple(r) for r in k.hand_off(spark.createDataFrame(rows, EVENT), limit=6, arena_bytes=2500).orderBy("event_id").collect()]
        want = plain_handoff(rows, 6, 2500)
        assert got == want
        seen |= {r[2] for r in want}
    assert {"granted", "buffer_already_leased", "mapping_out_of_range", "unknown_buffer", "released", "valid", "invalid_lease_ttl"} <= seen
