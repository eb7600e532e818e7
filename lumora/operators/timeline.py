"""Interval operators on half-open milliseconds: construction, grids, fusion, coverage, as-of reads, stalls, pressure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .helpers import first_failure, overlap_join


def intervals(points: DataFrame, duration_ms: Column, gap_ms: int = 1000) -> DataFrame:
    """[pts, next pts) per stream, the last closed by the duration; drops and gaps are marked, not removed."""
    w = Window.partitionBy("stream_id").orderBy("pts_ms", "decode_index")
    at = points.withColumn("next_ms", F.lead("pts_ms").over(w)).withColumn("last", F.col("next_ms").isNull())
    end = F.coalesce("next_ms", duration_ms)
    reason = first_failure([(F.col("last") & (end <= F.col("pts_ms")), "duration_unknown_last_frame_interval"), (end <= F.col("pts_ms"), "collapsed_interval")])
    return at.withColumn("end_ms", end).withColumn("drop_reason", reason).withColumn("is_gap", ~F.col("last") & (F.col("next_ms") - F.col("pts_ms") > gap_ms)).withColumn("anchor", F.format_string("frame-%08d", F.row_number().over(w) - 1))


def reordered(points: DataFrame) -> DataFrame:
    """How many points come with an earlier time than the one decoded before them."""
    w = Window.partitionBy("stream_id").orderBy("decode_index")
    return points.withColumn("_back", F.col("pts_ms") < F.lag("pts_ms").over(w)).groupBy("stream_id").agg(F.count_if("_back").alias("reordered"))


def truncated(points: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """The first rows of each key, and whether any were cut off."""
    w = Window.partitionBy(key)
    return points.withColumn("_n", F.row_number().over(w.orderBy(order))).withColumn("truncated", F.count(F.lit(1)).over(w) > most).where(F.col("_n") <= most).drop("_n")


def grid(streams: DataFrame, window_ms: int) -> DataFrame:
    """Cells of each stream's duration; the last may be short."""
    cells = streams.select("stream_id", "duration_ms", F.explode(F.sequence(F.lit(0).cast("long"), F.col("duration_ms") - 1, F.lit(window_ms).cast("long"))).alias("start_ms"))
    return cells.select("stream_id", "start_ms", F.least(F.col("start_ms") + window_ms, F.col("duration_ms")).alias("end_ms"))


def missing_cells(expected: DataFrame, existing: DataFrame) -> DataFrame:
    return expected.join(existing, ["stream_id", "start_ms", "end_ms"], "left_anti")


def grid_differences(expected: DataFrame, given: DataFrame) -> DataFrame:
    """Cells on one side only."""
    cols = ["stream_id", "start_ms", "end_ms"]
    both = expected.select(*cols, F.lit(1).alias("n")).unionAll(given.select(*cols, F.lit(-1).alias("n")))
    left = both.groupBy(*cols).agg(F.sum("n").cast("int").alias("n")).where("n <> 0")
    return left.select(*cols, F.explode(F.array_repeat(F.when(F.col("n") > 0, "missing").otherwise("extra"), F.abs("n"))).alias("side"))


def windowed(observation: DataFrame, window_ms: int) -> DataFrame:
    """Each observation with its tumbling window, and whether it lies in it whole."""
    start = F.floor(F.col("start_ms") / window_ms) * window_ms
    return observation.withColumn("window_start", start).withColumn("fits", F.col("end_ms") <= start + window_ms)


READY = ("accepted", "final")


def fuse(observation: DataFrame, window_ms: int, required: list[str], enrichment: list[str], most: int | None = None) -> DataFrame:
    """One material for each stream and window, with counters and pending modalities.

    Status, first that holds: conflict, low_confidence, failed (nothing usable), partial (a required modality is not
    ready), enriched (enrichment asked for and none missing), fast_ready. Order of arrival does not matter. Sets hold
    modalities, which are few, so nothing in a group grows with its rows. An id that came twice with one content counts
    once (duplicates counts the rest); with different contents (columns beyond those used here are compared by a 64-bit hash) it refuses the window (reason_code), as do more than `most`
    observations: the window's row stays, its status is null.
    """
    first = ["start_ms", "end_ms", "modality", "confidence", "quality_state"]
    payload = [c for c in observation.columns if c not in (*first, "stream_id", "observation_id")]
    content = F.struct(*first, F.xxhash64(F.lit(0), *payload).alias("_payload"))
    once = windowed(observation, window_ms).where("fits").groupBy("stream_id", "window_start", "observation_id").agg(F.min(content).alias("_o"), (~F.min(content).eqNullSafe(F.max(content))).alias("_differs"), F.count(F.lit(1)).alias("_n"))
    rows = once.select("stream_id", "window_start", "_o.*", "_differs", "_n")
    q = F.col("quality_state")
    both = [*required, *enrichment]
    out = rows.groupBy("stream_id", F.col("window_start").alias("start_ms")).agg(
        F.count(F.lit(1)).alias("received"), F.count_if(q == "partial").alias("n_partial"), F.count_if(q == "rejected").alias("n_rejected"), F.count_if(q == "failed").alias("n_failed"),
        F.count_if(F.col("confidence").isNull()).alias("unknown_confidence"), F.bool_or(q == "conflict").alias("_conflict"), F.bool_or(q == "low_confidence").alias("_low"),
        (F.sum("_n") - F.count(F.lit(1))).alias("duplicates"), F.bool_or("_differs").alias("_differs"),
        F.bool_or(~q.isin("failed", "rejected")).alias("_usable"), F.collect_set(F.when(q.isin(*READY), F.col("modality"))).alias("_ready"),
    )
    missing = lambda names: F.array_except(F.array(*map(F.lit, names)).cast("array<string>"), "_ready")
    status = F.when(F.col("_conflict"), "conflict").when(F.col("_low"), "low_confidence").when(~F.col("_usable"), "failed").when(F.size(missing(required)) > 0, "partial")
    status = status.when(F.lit(bool(enrichment)) & (F.size(missing(enrichment)) == 0), "enriched").otherwise("fast_ready")
    refused = first_failure([(F.col("_differs"), "immutable_observation_conflict"), (F.lit(most is not None) & (F.col("received") > (most or 0)), "fusion_observation_limit_exceeded")])
    out = out.withColumn("reason_code", refused).withColumn("status", F.when(refused.isNull(), status)).withColumn("pending", F.array_join(F.array_sort(missing(both)), ",")).withColumn("end_ms", F.col("start_ms") + window_ms)
    return out.drop("_conflict", "_low", "_usable", "_ready", "_differs")


def fused_again(previous: DataFrame, fused: DataFrame, created_ms: int) -> DataFrame:
    """The revision of each refused or changed material: an equal one keeps its own, a changed one gets the next.

    A revision must be younger than the one before it (fusion_revision_time_not_increasing).
    """
    p = previous.select("stream_id", "start_ms", F.struct("received", "status", "pending").alias("_p"), F.col("revision").alias("_rev"), F.col("created_ms").alias("_at"))
    at = fused.join(p, ["stream_id", "start_ms"], "left").withColumn("changed", ~F.col("_p").eqNullSafe(F.struct("received", "status", "pending")))
    late = F.col("changed") & (F.col("_at") >= created_ms)
    code = F.coalesce("reason_code", F.when(late, "fusion_revision_time_not_increasing"))
    revision = F.when(code.isNotNull() | ~F.col("changed"), F.col("_rev")).otherwise(F.coalesce(F.col("_rev") + 1, F.lit(1)))
    return at.withColumn("revision", revision).withColumn("reason_code", code).drop("_p", "_rev", "_at")


def coverage(windows: DataFrame, observation: DataFrame, refresh: DataFrame, rejected: DataFrame, modality: str, applicable: Column, failed: Column, planned: Column, default: str, grid_ms: int) -> DataFrame:
    """State and reason of one modality in each window, the first that holds.

    observed; not_applicable; failed; not_observed (selected there without an observation, or rejected there);
    covered_without_model_refresh (a plan exists); the default.
    """
    keys = ["stream_id", "start_ms", "end_ms"]

    def touched(other: DataFrame, name: str) -> DataFrame:
        o = other.select("stream_id", F.col("start_ms").alias("other_start_ms"), F.col("end_ms").alias("other_end_ms"))
        return overlap_join(windows.select(keys), o, ["stream_id"], grid_ms).select(keys).distinct().withColumn(name, F.lit(True))

    at = windows
    for other, name in ((observation.where(F.col("modality") == modality), "_seen"), (refresh, "_refresh"), (rejected, "_rejected")):
        at = at.join(touched(other, name), keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    state = F.when(F.col("_seen"), "observed").when(~applicable, "not_applicable").when(failed, "failed").when(F.col("_refresh"), "not_observed").when(planned, "covered_without_model_refresh").otherwise(default)
    reason = F.when(F.col("_seen"), None).when(~applicable, "no_track").when(failed, "task_failed").when(F.col("_refresh") & F.col("_rejected"), "data_plane_retention_rejected").when(F.col("_refresh"), "selected_without_observation").when(planned, "semantic_coverage")
    return at.withColumn("state", state).withColumn("reason_code", reason).drop("_seen", "_refresh", "_rejected")


def advanced(states: DataFrame, tasks: DataFrame, grid_ms: int) -> DataFrame:
    """New state rows (state_revision + 1) of the windows that a finished task overlaps."""
    return overlap_join(states, tasks, ["stream_id"], grid_ms).groupBy("stream_id", "start_ms", "end_ms").agg((F.max("state_revision") + 1).alias("state_revision"), F.count(F.lit(1)).alias("results"))


def stabbed(items: DataFrame, units: DataFrame, grid_ms: int) -> DataFrame:
    """The least unit whose interval holds each item's time, or a derived id."""
    at = items.withColumn("point_end", F.col("at_ms") + 1)
    u = units.select("stream_id", F.col("unit_id"), F.col("start_ms").alias("other_start_ms"), F.col("end_ms").alias("other_end_ms"))
    hit = overlap_join(at, u, ["stream_id"], grid_ms, ("at_ms", "point_end")).groupBy("item_id").agg(F.min("unit_id").alias("unit_id"))
    return items.join(hit, "item_id", "left").withColumn("unit", F.coalesce(F.concat(F.lit("unit_"), F.col("unit_id").cast("string")), F.concat(F.lit("derived_"), F.col("item_id").cast("string"))))


def as_of(reads: DataFrame, observation: DataFrame, keys: list[str], grid_ms: int) -> DataFrame:
    """For each read the observation that covers its time (of several the latest start, then the least id), else the nearest start, the earlier of two as near.

    What covers is an overlap join on grid cells, so that a long interval is found behind shorter later ones. For the
    nearest start both sides are put in one order per key: the start before and the one after are window values.
    """
    spans = observation.select(*keys, F.col("start_ms").alias("other_start_ms"), F.col("end_ms").alias("other_end_ms"), "observation_id")
    at = reads.select(*keys, "read_id", "at_ms", (F.col("at_ms") + 1).alias("_end"))
    hit = overlap_join(at, spans, keys, grid_ms, ("at_ms", "_end")).groupBy("read_id").agg(F.min(F.struct((-F.col("other_start_ms")).alias("back"), "observation_id")).alias("hit"))
    o = observation.select(*keys, F.col("start_ms").alias("t"), "start_ms", "observation_id", F.lit(None).cast("long").alias("read_id"), F.lit(0).alias("kind"))
    r = reads.select(*keys, F.col("at_ms").alias("t"), F.lit(None).cast("long").alias("start_ms"), F.lit(None).cast("long").alias("observation_id"), "read_id", F.lit(1).alias("kind"))
    w = Window.partitionBy(*keys)
    upto, after = w.orderBy("t", "kind", F.col("observation_id").desc()).rowsBetween(Window.unboundedPreceding, 0), w.orderBy(F.desc("t"), F.desc("kind"), F.col("observation_id").desc()).rowsBetween(Window.unboundedPreceding, 0)
    row = F.when(F.col("kind") == 0, F.struct("start_ms", "observation_id"))
    both = o.unionAll(r).withColumn("before", F.last(row, True).over(upto)).withColumn("next", F.last(row, True).over(after))
    both = both.where("kind = 1").withColumnRenamed("t", "at_ms").join(hit, "read_id", "left")
    near = F.when(F.col("next").isNull() | (F.col("before").isNotNull() & (F.col("at_ms") - F.col("before.start_ms") <= F.col("next.start_ms") - F.col("at_ms"))), F.col("before")).otherwise(F.col("next"))
    covering = F.struct((-F.col("hit.back")).alias("start_ms"), F.col("hit.observation_id").alias("observation_id"))
    both = both.withColumn("pick", F.when(F.col("hit").isNotNull(), covering).otherwise(near))
    return both.select(*keys, "read_id", "at_ms", F.col("pick.observation_id").alias("observation_id"), F.col("hit").isNotNull().alias("covering"), (F.col("pick.start_ms") - F.col("at_ms")).alias("offset_ms"))


def stalls(progress: DataFrame, threshold_ms: int, window_end_ms: int) -> DataFrame:
    """Gaps between progress times of at least the threshold; one that is open at the end of the window is marked."""
    w = Window.partitionBy("stream_id").orderBy("at_ms", "event_id")
    at = progress.withColumn("next_ms", F.lead("at_ms").over(w)).withColumn("next_pts", F.lead("pts_ms").over(w))
    gap = F.coalesce("next_ms", F.lit(window_end_ms)) - F.col("at_ms")
    return at.withColumn("gap_ms", gap).where(F.col("gap_ms") >= threshold_ms).select(
        "stream_id", F.col("at_ms").alias("start_ms"), "gap_ms", F.coalesce(F.col("next_pts") - F.col("pts_ms"), F.lit(-1)).alias("pts_jump_ms"), F.when(F.col("next_ms").isNull(), "stream_gap_at_window_end").otherwise("recovered").alias("reason")
    )


def pressure_level(depth: Column, capacity: Column) -> Column:
    return F.when((capacity <= 0) | (depth >= capacity), "saturated").when(2 * depth >= capacity, "degraded").otherwise("ok")


def throttle_ms(base: Column, factor: int = 4, cap: int = 10_000) -> Column:
    return F.greatest(base, F.least(base * factor, F.lit(cap)))


def level_entries(series: DataFrame) -> DataFrame:
    """How often each level is entered, per stream."""
    w = Window.partitionBy("stream_id").orderBy("event_id")
    entered = F.coalesce(F.col("level") != F.lag("level").over(w), F.lit(True))
    return series.withColumn("_in", entered).groupBy("stream_id").agg(F.count_if(F.col("_in") & (F.col("level") == "degraded")).alias("degraded"), F.count_if(F.col("_in") & (F.col("level") == "saturated")).alias("saturated"))


def derived_durations(samples: DataFrame) -> DataFrame:
    """A missing duration from the next sample's time, or why there is none."""
    w = Window.partitionBy("stream_id").orderBy("decode_index")
    delta = F.lead("pts_ms").over(w) - F.col("pts_ms")
    at = samples.withColumn("_delta", delta)
    reason = F.when(F.col("duration_ms").isNotNull(), None).when(F.col("_delta").isNull(), "duration_unavailable").when(F.col("_delta") <= 0, "duration_delta_nonpositive").when(F.col("_delta") > 5000, "duration_delta_out_of_range")
    return at.withColumn("reason_code", reason).withColumn("derived", F.col("duration_ms").isNull() & reason.isNull()).withColumn("duration_ms", F.when(F.col("derived"), F.col("_delta")).otherwise(F.col("duration_ms"))).drop("_delta")


def frame_rate_mode(points: DataFrame, declared: float) -> DataFrame:
    """Measured rate per stream, and whether it is constant within the tolerance of the declared one."""
    rate = F.when(F.max("pts_ms") > F.min("pts_ms"), (F.count(F.lit(1)) - 1) * 1000 / (F.max("pts_ms") - F.min("pts_ms")))
    out = points.groupBy("stream_id").agg(F.count(F.lit(1)).alias("frames"), rate.alias("rate"))
    return out.withColumn("mode", F.when(F.col("rate").isNull(), "unknown").when(F.abs(F.col("rate") - declared) <= max(0.02 * declared, 0.05), "constant").otherwise("variable"))


def stride(cells: DataFrame, interval_ms: int, cell_ms: int) -> DataFrame:
    """Greedy choice on a grid: every cell that starts a whole number of rounded-up intervals from zero."""
    step = -(-interval_ms // cell_ms) * cell_ms
    return cells.where(F.col("start_ms") % step == 0)


def signature_delta(frames: DataFrame) -> DataFrame:
    """Difference of each frame's signature from that of the latest frame before it that had one."""
    w = Window.partitionBy("stream_id").orderBy("frame_index").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last("signature", True).over(w)
    total = F.aggregate(F.zip_with("signature", "before", lambda a, b: F.abs(a - b)), F.lit(0).cast("long"), lambda s, x: s + x)
    return frames.withColumn("before", before).withColumn("delta", F.coalesce(F.floor(total / F.size("signature")), F.lit(0)).cast("long")).drop("before")


def enriched(material: DataFrame, results: DataFrame, grid_ms: int) -> DataFrame:
    """The next revision of each material that late results overlap.

    A result's modality leaves pending (an array); with none left the status is enriched if any result has observed
    something, else no_observations; while some are pending it is partial.
    """
    r = results.select("stream_id", F.col("start_ms").alias("other_start_ms"), F.col("end_ms").alias("other_end_ms"), F.col("modality").alias("late"), "observed")
    hit = overlap_join(material, r, ["stream_id"], grid_ms).groupBy("unit_id", "revision").agg(F.first("pending").alias("pending"), F.collect_set("late").alias("_late"), F.count(F.lit(1)).alias("results"), F.bool_or("observed").alias("_any"))
    left = hit.withColumn("pending", F.array_sort(F.array_except("pending", "_late")))
    status = F.when(F.size("pending") > 0, "partial").when(F.col("_any"), "enriched").otherwise("no_observations")
    return left.withColumn("revision", F.col("revision") + 1).withColumn("status", status).drop("_any", "_late")


def counted_decisions(decided: DataFrame, column: str) -> DataFrame:
    return decided.groupBy("stream_id", F.col(column).alias("decision")).agg(F.count(F.lit(1)).alias("n"))


def join_policy(left: DataFrame, right: DataFrame, policy: str, window_ms: int = 1000) -> DataFrame:
    """The three declared ways to join two nodes' outputs: the same item, the same stream window, or containment."""
    if policy == "same_item":
        return left.join(right, ["stream_id", "item_id"])
    if policy == "same_stream_window":
        cell = lambda df, c: df.withColumn("window", F.floor(F.col(c) / window_ms))
        return cell(left, "start_ms").join(cell(right, "other_start_ms"), ["stream_id", "window"])
    if policy == "window_contains":
        return overlap_join(left, right, ["stream_id"], window_ms).where("start_ms <= other_start_ms AND other_end_ms <= end_ms")
    raise ValueError("join_policy_unknown")


def observation_order(observation: DataFrame, window_ms: int) -> DataFrame:
    """Each observation's place in its material: by start, end, modality, id."""
    w = Window.partitionBy("stream_id", "window_start").orderBy("start_ms", "end_ms", "modality", "observation_id")
    return windowed(observation, window_ms).where("fits").withColumn("place", F.row_number().over(w))


def listed(rows: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """The first rows of each key, and with each how many more were left out."""
    w = Window.partitionBy(key)
    at = rows.withColumn("place", F.row_number().over(w.orderBy(*order))).withColumn("omitted", F.greatest(F.count(F.lit(1)).over(w) - most, F.lit(0)))
    return at.where(F.col("place") <= most)


def sampling_report(decided: DataFrame) -> DataFrame:
    """Counters of a sampler's decisions per stream: kept and skipped by reason, the longest frame interval and kept gap."""
    w = Window.partitionBy("stream_id").orderBy("frame_index").rowsBetween(Window.unboundedPreceding, -1)
    kept = F.when(F.col("keep"), F.col("pts_ms"))
    at = decided.withColumn("_step", F.col("pts_ms") - F.max("pts_ms").over(w)).withColumn("_gap", kept - F.last(kept, True).over(w))
    counts = {"kept_first_frame": "first_frame", "kept_content_change": "content_change", "kept_static_heartbeat": "static_heartbeat", "skipped_rate_limited": "rate_limited",
              "skipped_no_change": "no_change_yet", "skipped_non_monotonic": "non_monotonic", "skipped_missing_signature": "missing_signature", "skipped_backpressure_throttled": "backpressure_throttled"}
    return at.groupBy("stream_id").agg(
        F.count(F.lit(1)).alias("observed"), F.count_if("keep").alias("kept"), *[F.count_if(F.col("reason") == r).alias(n) for n, r in counts.items()],
        F.greatest(F.max("_step"), F.lit(0)).alias("max_frame_interval_ms"), F.greatest(F.max("_gap"), F.lit(0)).alias("max_gap_ms"),
    )


def handoff_report(events: DataFrame, capacity: int) -> DataFrame:
    """Depth of each stream's retained table (now and at its peak), rejections, timeouts and residency.

    Actions: retain, release (with residency_ms), expire, reject. No residency sample leaves an average of 0.
    """
    step = F.when(F.col("action") == "retain", 1).when(F.col("action").isin("release", "expire"), -1).otherwise(0)
    w = Window.partitionBy("stream_id").orderBy("event_id")
    at = events.withColumn("_step", step).withColumn("_depth", F.sum(step).over(w)).withColumn("_stay", F.when(F.col("action") == "release", F.col("residency_ms")))
    return at.groupBy("stream_id").agg(
        F.lit(capacity).alias("capacity"), F.sum("_step").alias("current"), F.greatest(F.max("_depth"), F.lit(0)).alias("peak"), F.count_if(F.col("action") == "reject").alias("dropped_total"),
        F.count_if(F.col("action") == "expire").alias("timeouts_total"), F.count("_stay").alias("residency_samples"), F.coalesce(F.max("_stay"), F.lit(0)).alias("residency_max_ms"),
        F.coalesce(F.floor(F.try_divide(F.sum("_stay"), F.count("_stay"))), F.lit(0)).alias("residency_avg_ms"),
    )


def handoff_drops(events: DataFrame) -> DataFrame:
    return events.where("action = 'reject'").groupBy("stream_id", "kind", "reason").agg(F.count(F.lit(1)).alias("n"))


def segment_report(segments: DataFrame) -> DataFrame:
    """Segments per stream: count, partial ones, bytes, and the ids of the first and the last."""
    name = lambda n: F.concat_ws("-", F.lit("seg"), "stream_id", F.lpad(n.cast("string"), 8, "0"))
    out = segments.groupBy("stream_id").agg(F.count(F.lit(1)).alias("segments"), F.count_if("partial").alias("partial"), F.sum("n_bytes").alias("n_bytes"))
    return out.withColumn("first_id", name(F.lit(1))).withColumn("last_id", name(F.col("segments")))


def accepted_samples(samples: DataFrame) -> DataFrame:
    """Each decoded sample with the first reason to drop it, and whether its track's origin changes among accepted ones."""
    video, audio = F.col("kind") == "video", F.col("kind") == "audio"
    reason = first_failure([
        (F.coalesce(F.col("pts_ms") < 0, F.lit(True)), "pts_unavailable"), (F.coalesce(F.col("duration_ms") <= 0, F.lit(True)), "duration_unavailable"), (F.coalesce(F.col("n_bytes") == 0, F.lit(True)), "empty_payload"),
        (video & ((F.col("width") == 0) | (F.col("height") == 0)), "missing_frame_size"), (video & (F.coalesce("pixel_format", F.lit("")) == ""), "missing_pixel_format"),
        (audio & ((F.col("sample_rate") == 0) | (F.col("channels") == 0)), "missing_audio_layout"),
    ])
    track = Window.partitionBy("stream_id", "kind")
    origin = F.when(reason.isNull(), F.col("origin_ms"))
    return samples.withColumn("reason_code", reason).withColumn("origin_changed", F.coalesce(F.min(origin).over(track) != F.max(origin).over(track), F.lit(False)))


def combined_keep(sampled: DataFrame, evidence: DataFrame) -> DataFrame:
    """What becomes of each frame: sampler, evidence_only, or dropped with the sampler's reason."""
    e = evidence.select("stream_id", "frame_index", F.col("retain").alias("_retain"))
    at = sampled.join(e, ["stream_id", "frame_index"], "left")
    return at.withColumn("outcome", F.when(F.col("keep"), "sampler").when(F.col("_retain"), "evidence_only").otherwise(F.coalesce("reason", F.lit("no_change_yet")))).drop("_retain")


def input_units(frames: DataFrame) -> DataFrame:
    """Units that executors take from the evidence ledger: anchors one by one and windows whole.

    Frames have stream_id, frame_index, selection, window_id and buffer_id (null: refused by the data plane). An anchor without
    a buffer is refused; so is a window whose event anchor has none, its other buffers going back. A vision-language
    model takes the windows and the baseline anchors, text recognition takes the anchors.
    """
    baseline, event, held = F.col("selection") == "baseline_anchor", F.col("selection") == "event_anchor", F.col("buffer_id").isNotNull()
    a = frames.where(baseline | event)
    label = F.when(held, F.col("buffer_id").cast("string")).otherwise(F.concat(F.lit("anchor-"), F.lpad(F.col("frame_index").cast("string"), 8, "0")))
    anchors = a.select("stream_id", F.lit("anchor").alias("kind"), label.alias("label"), held.alias("admitted"), F.when(held, 1).otherwise(0).cast("long").alias("n_buffers"), (held & baseline).alias("for_vlm"), held.alias("for_ocr"))
    whole = frames.where(F.col("window_id").isNotNull()).groupBy("stream_id", "window_id").agg(F.count("buffer_id").alias("n_buffers"), F.bool_or(event & held).alias("admitted"))
    return anchors.unionAll(whole.select("stream_id", F.lit("window").alias("kind"), F.col("window_id").alias("label"), "admitted", "n_buffers", F.col("admitted").alias("for_vlm"), F.lit(False).alias("for_ocr")))


def stall_statistics(events: DataFrame, most: int = 16) -> DataFrame:
    """Per stream of the rows that stalls() gives: how many, their time in all and at most, the media time that was lost, whether the last one is over, and the first events in order.

    A jump of unknown or negative media time counts as none. The list has a stated length; the counts are of all.
    """
    w = Window.partitionBy("stream_id").orderBy("start_ms")
    text = F.concat_ws(":", F.col("start_ms").cast("string"), F.col("gap_ms").cast("string"), F.col("pts_jump_ms").cast("string"), "reason")
    at = events.withColumn("_n", F.row_number().over(w)).withColumn("_text", F.when(F.col("_n") <= most, text))
    return at.groupBy("stream_id").agg(
        F.count(F.lit(1)).alias("stalls"), F.sum("gap_ms").alias("stalled_ms"), F.max("gap_ms").alias("max_stall_ms"), F.sum(F.greatest("pts_jump_ms", F.lit(0))).alias("pts_gap_total_ms"),
        (F.max_by("reason", "_n") == "recovered").alias("recovered"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_text").isNotNull(), F.struct("_n", "_text")))), lambda x: x["_text"]), ",").alias("events"),
    )


def declared_coverage(windows: DataFrame, observation: DataFrame, receipts: DataFrame, modalities: list[str], enrichment: list[str], grid_ms: int) -> DataFrame:
    """State and reason of each declared modality in each window, by observations and by the receipts of calls that produce it.

    receipts: stream_id, start_ms, end_ms, receipt_id, produces (array), outcome_reason. observed; else not_observed where a call that produces
    the modality touched the window, with the reason of the first such call that gives one; else not_sampled_by_policy. What an
    enrichment will bring is queued. sampling_state: whether any call touched the window.
    """
    keys = ["stream_id", "start_ms", "end_ms"]
    spans = lambda df, *more: df.select("stream_id", F.col("start_ms").alias("other_start_ms"), F.col("end_ms").alias("other_end_ms"), *more)
    w = windows.select(keys)
    seen = overlap_join(w, spans(observation.where(F.col("modality").isin(modalities)), "modality"), ["stream_id"], grid_ms).select(*keys, "modality").distinct().withColumn("_seen", F.lit(True))
    calls = overlap_join(w, spans(receipts, "receipt_id", "produces", "outcome_reason"), ["stream_id"], grid_ms)
    touched = calls.groupBy(*keys).agg(F.count(F.lit(1)).alias("calls"))
    by = calls.select(*keys, "receipt_id", "outcome_reason", F.explode("produces").alias("modality"))
    said = by.groupBy(*keys, "modality").agg(F.min(F.when(F.coalesce("outcome_reason", F.lit("")) != "", F.struct("receipt_id", "outcome_reason"))).alias("_said"), F.lit(True).alias("_called"))
    at = w.withColumn("modality", F.explode(F.array(*map(F.lit, [*modalities, *enrichment])))).join(seen, [*keys, "modality"], "left").join(said, [*keys, "modality"], "left").join(touched, keys, "left")
    late, observed = F.col("modality").isin(enrichment), F.coalesce("_seen", F.lit(False))
    state = F.when(late, "queued").when(observed, "observed").when(F.col("_called"), "not_observed").otherwise("not_sampled_by_policy")
    reason = F.when(~late & ~observed & F.col("_called"), F.coalesce("_said.outcome_reason", F.lit("processed_without_observation")))
    return at.select(*keys, "modality", state.alias("state"), reason.alias("reason_code"), F.when(F.col("calls") > 0, "sampled").otherwise("not_sampled_by_policy").alias("sampling_state"))


def sampling_states(windows: DataFrame, observation: DataFrame, refresh: DataFrame, tracks: DataFrame, grid_ms: int) -> DataFrame:
    """How each window was sampled, and what triggered the refreshes in it (distinct, in order).

    refresh: stream_id, start_ms, end_ms, trigger. tracks: stream_id, kind. sampled with any observation; not_applicable without an audio or video track; then
    a refresh without one; covered where the stream has a plan at all; else not_sampled_by_policy.
    """
    keys = ["stream_id", "start_ms", "end_ms"]
    w = windows.select(keys)
    spans = lambda df, *more: df.select("stream_id", F.col("start_ms").alias("other_start_ms"), F.col("end_ms").alias("other_end_ms"), *more)
    seen = overlap_join(w, spans(observation), ["stream_id"], grid_ms).select(keys).distinct().withColumn("_seen", F.lit(True))
    hit = overlap_join(w, spans(refresh, "trigger"), ["stream_id"], grid_ms).groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("trigger")), ",").alias("triggers"))
    planned = refresh.select("stream_id").distinct().withColumn("_planned", F.lit(True))
    playable = tracks.where(F.col("kind").isin("audio", "video")).select("stream_id").distinct().withColumn("_playable", F.lit(True))
    at = w.join(seen, keys, "left").join(hit, keys, "left").join(planned, "stream_id", "left").join(playable, "stream_id", "left")
    state = F.when(F.col("_seen"), "sampled").when(F.col("_playable").isNull(), "not_applicable").when(F.col("triggers").isNotNull(), "semantic_refresh_without_observation").when(F.col("_planned"), "covered_without_model_refresh")
    return at.select(*keys, state.otherwise("not_sampled_by_policy").alias("sampling_state"), F.coalesce("triggers", F.lit("")).alias("triggers"))
