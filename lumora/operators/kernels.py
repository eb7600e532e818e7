"""Order-dependent folds over one stream's rows: sampler, evidence selector, audio segmenter, retention.

Each is a small step object; the same object runs in batch over sorted partitions and in streaming per group. A fold
reads its rows in order and holds a bounded state, so a partition streams through whatever its length.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def fold(df: DataFrame, key: str, order: list[str], make: Callable[[], object], schema: str) -> DataFrame:
    """Runs make().push(row) over each key's rows in order, and make().finish() after the last; both give lists of rows.

    Rows without a key are one group. Keys go to Python as text, so that a null among them costs no digits.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    whole = {c.split()[0] for c in schema.split(", ") if c.split()[1] in ("long", "int")}

    def table(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({n: pd.array([r[k] for r in rows], "Int64") if n in whole else pd.Series([r[k] for r in rows], dtype=object) for k, n in enumerate(names)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, rows = object(), None, []
        for batch in batches:
            for row in batch.itertuples(index=False):
                k = getattr(row, key)
                k = None if k is None else int(k)
                if k != now:
                    if state is not None:
                        rows += [(now, *r) for r in state.finish()]
                    now, state = k, make()
                rows += [(now, *r) for r in state.push(row)]
            yield table(rows)
            rows = []
        if state is not None:
            yield table([(now, *r) for r in state.finish()])

    return df.withColumn(key, df[key].cast("string")).repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def mean_delta(a, b) -> int:
    """Mean absolute difference of two signatures, in whole units."""
    return sum(abs(int(x) - int(y)) for x, y in zip(a, b)) // max(1, len(a))


class Sampler:
    """Keeps a frame when it is the first, when its content changed since the last kept one, or when nothing was kept for long."""

    def __init__(self, min_interval: int = 1000, static_hold: int = 5000, threshold: int = 8):
        self.min_interval, self.static_hold, self.threshold = min_interval, static_hold, threshold
        self.last = self.kept = self.signature = None

    def decide(self, pts: int, signature, throttle: int = 0) -> tuple[bool, str, int]:
        if self.last is not None and pts <= self.last:
            return False, "non_monotonic_pts", 0
        self.last = pts
        if signature is None:
            return False, "missing_signature", 0
        delta = 0 if self.signature is None else mean_delta(signature, self.signature)
        since = None if self.kept is None else pts - self.kept
        if since is None:
            reason, keep = "first_frame", True
        elif since < self.min_interval:
            reason, keep = "rate_limited", False
        elif since < max(self.min_interval, throttle):
            reason, keep = "backpressure_throttled", False
        elif delta >= self.threshold:
            reason, keep = "content_change", True
        elif since >= self.static_hold:
            reason, keep = "static_heartbeat", True
        else:
            reason, keep = "no_change_yet", False
        if keep:
            self.kept, self.signature = pts, signature
        return keep, reason, delta

    def push(self, row) -> list[tuple]:
        return [(int(row.frame_index), int(row.pts_ms), *self.decide(int(row.pts_ms), row.signature, int(getattr(row, "throttle_ms", 0) or 0)))]

    def finish(self) -> list[tuple]:
        return []


class Evidence:
    """Event windows with context before and after, and anchors where nothing was selected for long.

    A frame's row comes out once nothing can change it any more: when it leaves the ring of context candidates, when
    it is selected, or at the end.
    """

    def __init__(self, gap: int = 1000, before: int = 2, after: int = 2, threshold: int = 8, text_threshold: int = 12, event_interval: int = 100, max_windows: int = 200_000):
        self.gap, self.before, self.after, self.threshold, self.text_threshold, self.event_interval, self.max_windows = gap, before, after, threshold, text_threshold, event_interval, max_windows
        self.last = self.signature = self.text = self.selected = self.event = None
        self.ring: deque[list] = deque()
        self.windows, self.closed, self.post, self.window = 0, 0, 0, ""

    def observe(self, index: int, pts: int, signature, text=None, sampler_keeps: bool = False) -> list[list]:
        """Settled rows: index, pts, decision, selection, window, skip reason."""
        if self.last is not None and pts < self.last:
            return [[index, pts, "no_change", "not_selected", "", "non_monotonic_pts"]]
        if signature is None:
            self.last = pts
            return [[index, pts, "no_change", "not_selected", "", "missing_signature"]]
        first = self.last is None
        delta = 0 if self.signature is None else mean_delta(signature, self.signature)
        text_delta = 0 if self.text is None or text is None else mean_delta(text, self.text)
        content, words = not first and delta >= self.threshold, not first and text_delta >= self.text_threshold
        self.signature, self.last = signature, pts
        self.text = text if text is not None else self.text
        due = self.selected is None or pts - self.selected >= self.gap
        decision = "first_frame" if first else "content_change" if content else "text_change" if words else "static_heartbeat" if due else "no_change"
        if content or words:
            if self.closed >= self.max_windows:
                return self._skip(index, pts, decision, "event_budget_exhausted", sampler_keeps)
            if self.event is not None and pts - self.event < self.event_interval:
                return self._skip(index, pts, decision, "event_rate_limited", sampler_keeps)
            if self.window:
                self.closed += 1
            self.windows += 1
            self.window = f"win-{self.windows:08d}"
            out = [[*r[:3], "event_pre_context", self.window, ""] for r in self.ring]
            self.ring.clear()
            self.event = self.selected = pts
            self.post = self.after
            return [*out, [index, pts, decision, "event_anchor", self.window, ""]]
        if self.window and self.post > 0:
            self.post -= 1
            self.selected = pts
            row = [index, pts, decision, "event_post_context", self.window, ""]
            if not self.post:
                self.closed += 1
                self.window = ""
            return [row]
        if due:
            out = list(self.ring)
            self.ring.clear()
            self.selected = pts
            return [*out, [index, pts, decision, "baseline_anchor", "", ""]]
        return self._skip(index, pts, decision, "no_change_yet", sampler_keeps)

    def _skip(self, index, pts, decision, reason, sampler_keeps) -> list[list]:
        if sampler_keeps:  # it was handed over all the same: an anchor, and no candidate for context
            self.selected = pts
            return [[index, pts, decision, "baseline_anchor", "", ""]]
        row = [index, pts, decision, "not_selected", "", reason]
        if not self.before:
            return [row]
        self.ring.append(row)
        return [self.ring.popleft()] if len(self.ring) > self.before else []

    def push(self, row) -> list[tuple]:
        return [tuple(r) for r in self.observe(int(row.frame_index), int(row.pts_ms), row.signature, getattr(row, "text_signature", None), bool(getattr(row, "sampler_keeps", False)))]

    def finish(self) -> list[tuple]:
        out, self.ring = [tuple(r) for r in self.ring], deque()
        return out


class StreamError(ValueError):
    """A rule whose breach ends the whole run."""


class Segmenter:
    """Audio segments by length, gap and overlap. If one chunk ends the segment before a gap and fills the next, both come out."""

    GAP_MS = 250

    def __init__(self, segment_ms: int = 5000, overlap_ms: int = 0):
        self.segment_ms, self.overlap_ms = segment_ms, overlap_ms
        self.rate = self.channels = 0
        self.start = self.cursor = None
        self.end = self.n_bytes = 0
        self.fresh = False

    def chunk(self, rate: int, channels: int, kind: str, pts: int, duration: int, n_bytes: int) -> tuple[list[tuple], str | None]:
        """(start, end, partial, bytes) of finished segments, and the reason if the chunk is dropped."""
        if not rate or not channels:
            raise StreamError("audio_segment_format_unknown")
        if kind != "F32LE":
            return [], "audio_unsupported_sample_format"
        if (self.rate, self.channels) == (0, 0):
            self.rate, self.channels = rate, channels
        elif (self.rate, self.channels) != (rate, channels):
            raise StreamError("audio_format_changed_mid_stream")
        frame = 4 * channels
        if not n_bytes:
            return [], None
        if n_bytes % frame:
            return [], "audio_bytes_not_frame_aligned"
        if pts < 0 or duration <= 0:
            return [], "audio_timing_unavailable"
        out, reason = [], None
        if self.cursor is not None and abs(pts - self.cursor) > self.GAP_MS:
            reason = "audio_timeline_discontinuity"
            if self.start is not None:
                out += self._take(False)
        if self.start is None:
            self.start = pts
        self.n_bytes += n_bytes
        self.fresh = True
        self.end = self.cursor = pts + duration
        if self.n_bytes > 2 * self.segment_ms * rate * frame // 1000 + 2 * frame:
            raise StreamError("audio_segment_overflow")
        if self.end - self.start >= self.segment_ms:
            out += self._take(True)
        return out, reason

    def _take(self, keep_overlap: bool) -> list[tuple]:
        start, n, fresh = self.start, self.n_bytes, self.fresh
        self.start, self.n_bytes, self.fresh = None, 0, False
        if not n or not fresh:
            return []
        frame = 4 * self.channels
        if keep_overlap and self.overlap_ms:
            frames = min(n // frame, -(-self.overlap_ms * self.rate // 1000))
            if frames:
                self.n_bytes, self.start = frames * frame, self.end - -(-frames * 1000 // self.rate)
        return [(start, self.end, self.end - start < self.segment_ms, n)]

    def push(self, row) -> list[tuple]:
        return self.chunk(int(row.sample_rate), int(row.channels), row.sample_format, int(row.pts_ms), int(row.duration_ms), int(row.n_bytes))[0]

    def finish(self) -> list[tuple]:
        return self._take(False) if self.start is not None else []


class Retention:
    """Bounded admission of buffers: a table limit, a quota for each kind, bytes in all, no id twice; releases free their room."""

    def __init__(self, limit: int = 64, arena_bytes: int = 1 << 20):
        self.limit, self.quota, self.arena = limit, max(1, limit // 2), arena_bytes
        self.held: dict[object, tuple[str, int]] = {}
        self.bytes, self.kinds = 0, {}

    def offer(self, buffer_id, kind: str, n_bytes: int) -> str:
        if buffer_id in self.held:
            return "duplicate_buffer"
        if len(self.held) >= self.limit:
            return "table_full"
        if self.kinds.get(kind, 0) >= self.quota:
            return "kind_quota"
        if self.bytes + n_bytes > self.arena:
            return "arena_full"
        self.held[buffer_id] = (kind, n_bytes)
        self.bytes += n_bytes
        self.kinds[kind] = self.kinds.get(kind, 0) + 1
        return "retained"

    def release(self, buffer_id) -> str:
        if buffer_id not in self.held:
            return "unknown_buffer"
        kind, n = self.held.pop(buffer_id)
        self.bytes -= n
        self.kinds[kind] -= 1
        return "released"

    def push(self, row) -> list[tuple]:
        outcome = self.offer(row.buffer_id, row.kind, int(row.n_bytes)) if row.action == "offer" else self.release(row.buffer_id)
        return [(int(row.event_id), outcome, len(self.held), self.bytes)]

    def finish(self) -> list[tuple]:
        return []


class Handoff:
    """Retained buffers and their leases: one lease a buffer, a window inside the buffer, a bounded time; what is released or expired is gone.

    Retaining asks the table's limit, then a kind's quota (half of it), then the id, then the bytes in all. A lease is over
    when it is released, or when it has expired and the next acquire or expire finds it so.
    """

    MOST_LEASES = 4096
    TTL_MS = (50, 60_000)

    def __init__(self, limit: int = 64, arena_bytes: int = 64 << 20):
        self.limit, self.quota, self.arena = limit, max(1, limit // 2), arena_bytes
        self.held: dict[object, tuple[str, int, str | None]] = {}  # kind, bytes, lease
        self.leases: dict[str, tuple[int, object]] = {}  # expiry, buffer
        self.issued = self.bytes = 0

    def retain(self, buffer_id, kind: str, n_bytes: int) -> str:
        if n_bytes <= 0:
            return "empty_buffer_payload"
        if buffer_id is None or not kind:
            return "missing_buffer_identity"
        if len(self.held) >= self.limit:
            return "handoff_backlog_full"
        if sum(k == kind for k, _, _ in self.held.values()) >= self.quota:
            return "handoff_kind_quota_full"
        if buffer_id in self.held:
            return "duplicate_buffer_id"
        if self.bytes + n_bytes > self.arena:
            return "arena_capacity_exceeded"
        self.held[buffer_id] = (kind, n_bytes, None)
        self.bytes += n_bytes
        return "retained"

    def _drop(self, buffer_id) -> None:
        self.bytes -= self.held.pop(buffer_id)[1]

    def expire(self, now_ms: int) -> int:
        over = [lease for lease, (until, _) in self.leases.items() if until <= now_ms]
        for lease in over:
            self._drop(self.leases.pop(lease)[1])
        return len(over)

    def acquire(self, buffer_id, offset: int | None, length: int | None, ttl_ms: int, now_ms: int) -> tuple[str, tuple[str, int, int, int] | None]:
        """The outcome and, if granted, lease, offset, length and expiry; without a window the buffer is taken whole."""
        if not self.TTL_MS[0] <= ttl_ms <= self.TTL_MS[1]:
            return "invalid_lease_ttl", None
        self.expire(now_ms)
        if buffer_id not in self.held:
            return "unknown_buffer", None
        kind, n, lease = self.held[buffer_id]
        offset, length = (0, n) if length is None else (offset or 0, length)
        if length <= 0 or offset < 0 or offset + length > n:
            return "mapping_out_of_range", None
        if lease is not None:
            return "buffer_already_leased", None
        if len(self.leases) >= self.MOST_LEASES:
            return "lease_capacity_exhausted", None
        self.issued += 1
        lease = f"lease-{self.issued:016x}"
        self.leases[lease] = (now_ms + ttl_ms, buffer_id)
        self.held[buffer_id] = (kind, n, lease)
        return "granted", (lease, offset, length, now_ms + ttl_ms)

    def validate(self, lease: str, claimed_ms: int | None, read_only: bool, now_ms: int) -> str:
        if lease not in self.leases:
            return "unknown_or_released_lease"
        until = self.leases[lease][0]
        if claimed_ms is not None and claimed_ms != until:
            return "lease_expiry_mismatch"
        if not read_only:
            return "lease_is_read_only"
        return "invalid_or_expired_lease" if until <= now_ms else "valid"

    def release(self, lease: str) -> str:
        if lease not in self.leases:
            return "unknown_or_released_lease"
        self._drop(self.leases.pop(lease)[1])
        return "released"

    def push(self, row) -> list[tuple]:
        """Rows have event_id, at_ms, action (retain, acquire, validate, release, expire) and what the action reads; absent numbers are null."""
        number = lambda x: None if x is None or x != x else int(x)
        grant, now, before = None, int(row.at_ms), len(self.leases)
        if row.action == "retain":
            outcome = self.retain(row.buffer_id, row.kind, number(row.n_bytes) or 0)
        elif row.action == "acquire":
            outcome, grant = self.acquire(row.buffer_id, number(row.offset), number(row.length), number(row.ttl_ms) or 0, now)
        elif row.action == "validate":
            outcome = self.validate(row.lease_id, number(row.claimed_ms), bool(row.read_only), now)
        elif row.action == "release":
            outcome = self.release(row.lease_id)
        else:
            self.expire(now)
            outcome = "expired"
        gone = before + (grant is not None) - len(self.leases) - (outcome == "released")
        return [(int(row.event_id), outcome, *(grant or (None,) * 4), gone, len(self.held), len(self.leases), self.bytes)]

    def finish(self) -> list[tuple]:
        return []


class EvidenceLedger:
    """The evidence selector's ledger as it may be read while it grows: frames in their order once they are settled, a window once its last frame is written.

    Frames are numbered as they come. A frame's row waits until all before it are settled; a window, closed by its last
    context frame, the next event or the end, waits until its greatest frame is among those written.
    """

    def __init__(self, **policy):
        self.select = Evidence(**policy)
        self.seen = self.written = 0
        self.frames: dict[int, int] = {}  # of frames that are not settled: the index of each number
        self.ready: dict[int, tuple] = {}
        self.windows: dict[str, list] = {}  # first and last number, first and last index, frames; in the order of their events
        self.closed: set[str] = set()

    def _settle(self, rows) -> None:
        for number, pts, decision, selection, window, skip in rows:
            index = self.frames.pop(number)
            self.ready[number] = (index, pts, decision, selection, window, skip)
            if window:
                w = self.windows.setdefault(window, [number, number, index, index, 0])
                self.windows[window] = [min(w[0], number), max(w[1], number), min(w[2], index), max(w[3], index), w[4] + 1]
        self.closed |= {w for w in self.windows if w != self.select.window}

    def _drain(self) -> list[tuple]:
        out = []
        while self.written in self.ready:
            out.append(("frame", *self.ready.pop(self.written), None, None, None))
            self.written += 1
        for name, (_, last, first_index, last_index, n) in list(self.windows.items()):
            if name not in self.closed or last >= self.written:
                break
            out.append(("window", None, None, None, None, name, None, first_index, last_index, n))
            del self.windows[name]
            self.closed.discard(name)
        return out

    def push(self, row) -> list[tuple]:
        number, self.seen = self.seen, self.seen + 1
        self.frames[number] = int(row.frame_index)
        self._settle(self.select.observe(number, int(row.pts_ms), row.signature, getattr(row, "text_signature", None), bool(getattr(row, "sampler_keeps", False))))
        return self._drain()

    def finish(self) -> list[tuple]:
        self._settle(self.select.finish())
        self.closed |= set(self.windows)
        return self._drain()


SAMPLER_SCHEMA = "stream_id long, frame_index long, pts_ms long, keep boolean, reason string, delta int"
EVIDENCE_SCHEMA = "stream_id long, frame_index long, pts_ms long, decision string, selection string, window_id string, skip_reason string"
SEGMENT_SCHEMA = "stream_id long, start_ms long, end_ms long, partial boolean, n_bytes long"
RETENTION_SCHEMA = "stream_id long, event_id long, outcome string, held int, held_bytes long"
HANDOFF_SCHEMA = "stream_id long, event_id long, outcome string, lease_id string, offset long, length long, expires_ms long, reclaimed int, held int, leased int, held_bytes long"
LEDGER_SCHEMA = "stream_id long, record string, frame_index long, pts_ms long, decision string, selection string, window_id string, skip_reason string, first_frame long, last_frame long, frames long"


def sample(frames: DataFrame, **policy) -> DataFrame:
    return fold(frames, "stream_id", ["frame_index"], lambda: Sampler(**policy), SAMPLER_SCHEMA)


def select_evidence(frames: DataFrame, **policy) -> DataFrame:
    return fold(frames, "stream_id", ["frame_index"], lambda: Evidence(**policy), EVIDENCE_SCHEMA)


def segment_audio(chunks: DataFrame, **policy) -> DataFrame:
    return fold(chunks, "stream_id", ["pts_ms"], lambda: Segmenter(**policy), SEGMENT_SCHEMA)


def retain(events: DataFrame, **policy) -> DataFrame:
    return fold(events, "stream_id", ["event_id"], lambda: Retention(**policy), RETENTION_SCHEMA)


def hand_off(events: DataFrame, **policy) -> DataFrame:
    return fold(events, "stream_id", ["event_id"], lambda: Handoff(**policy), HANDOFF_SCHEMA)


def evidence_ledger(frames: DataFrame, **policy) -> DataFrame:
    return fold(frames, "stream_id", ["frame_index"], lambda: EvidenceLedger(**policy), LEDGER_SCHEMA)
