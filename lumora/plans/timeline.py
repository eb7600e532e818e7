"""Queries over timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import kernels as k
from ..operators import timeline as t
from ..operators.helpers import overlap_join
from .fixtures import view
from .registry import query

HOUR = 3_600_000


def _shifted(df, **names):
    return df.select(*[F.col(v).alias(n) for n, v in names.items()])


@query("""WITH x AS (SELECT *, lead(pts_ms) OVER (PARTITION BY stream_id ORDER BY pts_ms, decode_index) AS nxt FROM point)
    SELECT stream_id, decode_index, pts_ms, coalesce(nxt, 2592000000) AS end_ms, CASE WHEN nxt IS NULL AND 2592000000 <= pts_ms THEN 'duration_unknown_last_frame_interval' WHEN coalesce(nxt, 2592000000) <= pts_ms THEN 'collapsed_interval' END AS drop_reason,
    nxt IS NOT NULL AND nxt - pts_ms > 7200000 AS is_gap FROM x""")
def w3_w6_intervals(spark, d):
    return t.intervals(view(spark, d, "point"), F.lit(2_592_000_000), 2 * HOUR).select("stream_id", "decode_index", "pts_ms", "end_ms", "drop_reason", F.coalesce("is_gap", F.lit(False)).alias("is_gap"))


@query("""WITH x AS (SELECT stream_id, pts_ms - (decode_index % 3) * 20000000 AS p, decode_index FROM point), y AS (SELECT *, p < lag(p) OVER (PARTITION BY stream_id ORDER BY decode_index) AS back FROM x)
    SELECT stream_id, count_if(back) AS reordered FROM y GROUP BY 1""")
def w4_reordered(spark, d):
    return t.reordered(view(spark, d, "point").withColumn("pts_ms", F.expr("pts_ms - (decode_index % 3) * 20000000")))


@query("SELECT stream_id, decode_index, 'frame-' || lpad(CAST(row_number() OVER (PARTITION BY stream_id ORDER BY pts_ms, decode_index) - 1 AS VARCHAR), 8, '0') AS anchor FROM point")
def w5_anchor_labels(spark, d):
    return t.intervals(view(spark, d, "point"), F.lit(2_592_000_000)).select("stream_id", "decode_index", "anchor")


@query("SELECT stream_id, decode_index, count(*) OVER (PARTITION BY stream_id) > 40 AS truncated FROM point QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY decode_index) <= 40")
def s5_truncated_tracks(spark, d):
    return t.truncated(view(spark, d, "point"), "stream_id", "decode_index", 40).select("stream_id", "decode_index", "truncated")


GRID = "s AS (SELECT stream_id, 86400000 + stream_id * 7777 AS duration_ms FROM stream), g AS (SELECT stream_id, start_ms, least(start_ms + 3600000, duration_ms) AS end_ms FROM (SELECT stream_id, duration_ms, unnest(range(0, duration_ms, 3600000)) AS start_ms FROM s))"


def _grid(spark, d):
    return t.grid(view(spark, d, "stream").select("stream_id", (86_400_000 + F.col("stream_id") * 7777).alias("duration_ms")), HOUR)


@query(f"WITH {GRID} SELECT * FROM g")
def t6_grid(spark, d):
    return _grid(spark, d)


@query(f"WITH {GRID} SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM obs WHERE obs.stream_id = g.stream_id AND obs.start_ms // 3600000 = g.start_ms // 3600000)")
def t7_gap_fill(spark, d):
    have = view(spark, d, "obs").select("stream_id", (F.floor(F.col("start_ms") / HOUR) * HOUR).alias("start_ms")).distinct()
    cells = _grid(spark, d)
    return t.missing_cells(cells, cells.join(have, ["stream_id", "start_ms"], "left_semi"))


@query(f"WITH {GRID} SELECT stream_id, start_ms, end_ms, 'missing' AS side FROM g WHERE start_ms % 10800000 = 0 UNION ALL SELECT stream_id, start_ms + 1, end_ms, 'extra' FROM g WHERE start_ms % 10800000 = 0")
def t10_grid_validation(spark, d):
    cells = _grid(spark, d)
    given = cells.withColumn("start_ms", F.expr("start_ms + CASE WHEN start_ms % 10800000 = 0 THEN 1 ELSE 0 END"))
    return t.grid_differences(cells, given)


@query(f"WITH {GRID} SELECT stream_id, start_ms FROM g WHERE start_ms % 7200000 = 0")
def w12_stride(spark, d):
    return t.stride(_grid(spark, d), 5_000_000, HOUR).select("stream_id", "start_ms")


@query("SELECT observation_id, start_ms // 300000 * 300000 AS window_start, end_ms <= start_ms // 300000 * 300000 + 300000 AS fits FROM obs")
def j7_window_assignment(spark, d):
    return t.windowed(view(spark, d, "obs"), 300_000).select("observation_id", "window_start", "fits")


@query("""WITH x AS (SELECT *, start_ms // 300000 * 300000 AS ws FROM obs WHERE end_ms <= start_ms // 300000 * 300000 + 300000),
    g AS (SELECT stream_id, ws AS start_ms, ws + 300000 AS end_ms, count(*) AS received, count_if(quality_state = 'partial') AS n_partial, count_if(quality_state = 'rejected') AS n_rejected, count_if(quality_state = 'failed') AS n_failed, count_if(confidence IS NULL) AS unknown_confidence,
    bool_or(quality_state = 'conflict') AS c, bool_or(quality_state = 'low_confidence') AS l, bool_or(quality_state NOT IN ('failed', 'rejected')) AS u, bool_or(modality = 'view' AND quality_state IN ('accepted', 'final')) AS v, bool_or(modality = 'click' AND quality_state IN ('accepted', 'final')) AS k FROM x GROUP BY stream_id, ws)
    SELECT stream_id, start_ms, end_ms, received, n_partial, n_rejected, n_failed, unknown_confidence, CASE WHEN c THEN 'conflict' WHEN l THEN 'low_confidence' WHEN NOT u THEN 'failed' WHEN NOT v THEN 'partial' WHEN k THEN 'enriched' ELSE 'fast_ready' END AS status,
    concat_ws(',', CASE WHEN NOT k THEN 'click' END, CASE WHEN NOT v THEN 'view' END) AS pending FROM g""")
def a1_a4_t5_fusion(spark, d):
    return t.fuse(view(spark, d, "obs"), 300_000, ["view"], ["click"]).select("stream_id", "start_ms", "end_ms", "received", "n_partial", "n_rejected", "n_failed", "unknown_confidence", "status", "pending")


@query("SELECT count(DISTINCT stream_id * 100000000 + start_ms // 300000) AS windows, count_if(end_ms <= start_ms // 300000 * 300000 + 300000) AS accepted, count_if(end_ms > start_ms // 300000 * 300000 + 300000) AS rejected FROM obs")
def a26_materialisation_counters(spark, d):
    return t.windowed(view(spark, d, "obs"), 300_000).agg(F.count_distinct("stream_id", "window_start").alias("windows"), F.count_if("fits").alias("accepted"), F.count_if(~F.col("fits")).alias("rejected"))


@query("SELECT a.observation_id AS a_id, b.observation_id AS b_id FROM obs a JOIN obs b ON a.stream_id = b.stream_id AND a.start_ms < b.end_ms AND a.end_ms > b.start_ms AND a.modality = 'view' AND b.modality = 'error'")
def j8_overlap_join(spark, d):
    obs = view(spark, d, "obs")
    a = _shifted(obs.where("modality = 'view'"), stream_id="stream_id", a_id="observation_id", start_ms="start_ms", end_ms="end_ms")
    b = _shifted(obs.where("modality = 'error'"), stream_id="stream_id", b_id="observation_id", other_start_ms="start_ms", other_end_ms="end_ms")
    return overlap_join(a, b, ["stream_id"], 300_000).select("a_id", "b_id")


@query("SELECT a.observation_id AS a_id, count(*) AS inside FROM obs a JOIN obs b ON a.stream_id = b.stream_id AND a.start_ms <= b.start_ms AND b.end_ms <= a.end_ms AND a.modality = 'view' AND b.modality = 'error' GROUP BY 1")
def j9_j22_window_contains(spark, d):
    obs = view(spark, d, "obs")
    a = _shifted(obs.where("modality = 'view'"), stream_id="stream_id", a_id="observation_id", start_ms="start_ms", end_ms="end_ms")
    b = _shifted(obs.where("modality = 'error'"), stream_id="stream_id", b_id="observation_id", other_start_ms="start_ms", other_end_ms="end_ms")
    return t.join_policy(a, b, "window_contains", 300_000).groupBy("a_id").agg(F.count("*").alias("inside"))


@query("""WITH hit AS (SELECT p.decode_index AS item_id, min(o.observation_id) AS u FROM point p JOIN obs o ON o.stream_id = p.stream_id AND o.modality = 'view' AND o.start_ms <= p.pts_ms AND p.pts_ms < o.end_ms GROUP BY 1)
    SELECT decode_index AS item_id, coalesce('unit_' || u, 'derived_' || decode_index) AS unit FROM point LEFT JOIN hit ON item_id = decode_index""")
def j11_point_in_interval(spark, d):
    items = _shifted(view(spark, d, "point"), stream_id="stream_id", item_id="decode_index", at_ms="pts_ms")
    units = view(spark, d, "obs").where("modality = 'view'").withColumnRenamed("observation_id", "unit_id")
    return t.stabbed(items, units, 300_000).select("item_id", "unit")


@query("""WITH r AS (SELECT event_id AS read_id, user_id AS stream_id, MILLIS(ts) - 1704067200000 + 90000 AS at_ms FROM events WHERE event_type = 'click'), o AS (SELECT * FROM obs WHERE modality = 'view'),
    c AS (SELECT read_id, at_ms, observation_id, start_ms, coalesce(o.start_ms <= at_ms AND at_ms < o.end_ms, false) AS covering FROM r LEFT JOIN o ON o.stream_id = r.stream_id)
    SELECT read_id, covering, observation_id, start_ms - at_ms AS offset_ms FROM c
    QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY covering DESC, CASE WHEN covering THEN -start_ms ELSE abs(start_ms - at_ms) END, start_ms, observation_id) = 1""")
def j12_as_of(spark, d):
    obs = view(spark, d, "obs")
    reads = obs.where("modality = 'click'").select("stream_id", F.col("observation_id").alias("read_id"), (F.col("start_ms") + 90_000).alias("at_ms"))
    return t.as_of(reads, obs.where("modality = 'view'"), ["stream_id"], 300_000).select("read_id", "covering", "observation_id", "offset_ms")


@query(f"""WITH {GRID}, x AS (SELECT g.*, EXISTS (SELECT 1 FROM obs o WHERE o.stream_id = g.stream_id AND o.modality = 'view' AND o.start_ms < g.end_ms AND o.end_ms > g.start_ms) AS seen,
    EXISTS (SELECT 1 FROM obs o WHERE o.stream_id = g.stream_id AND o.modality = 'click' AND o.start_ms < g.end_ms AND o.end_ms > g.start_ms) AS refresh, EXISTS (SELECT 1 FROM obs o WHERE o.stream_id = g.stream_id AND o.modality = 'error' AND o.start_ms < g.end_ms AND o.end_ms > g.start_ms) AS rej FROM g)
    SELECT stream_id, start_ms, CASE WHEN seen THEN 'observed' WHEN stream_id % 10 = 0 THEN 'not_applicable' WHEN stream_id % 10 = 1 THEN 'failed' WHEN refresh THEN 'not_observed' WHEN stream_id % 2 = 0 THEN 'covered_without_model_refresh' ELSE 'not_sampled_by_policy' END AS state,
    CASE WHEN seen THEN NULL WHEN stream_id % 10 = 0 THEN 'no_track' WHEN stream_id % 10 = 1 THEN 'task_failed' WHEN refresh AND rej THEN 'data_plane_retention_rejected' WHEN refresh THEN 'selected_without_observation' WHEN stream_id % 2 = 0 THEN 'semantic_coverage' END AS reason_code FROM x""")
def t8_t9_coverage(spark, d):
    obs = view(spark, d, "obs")
    s = F.col("stream_id")
    out = t.coverage(_grid(spark, d), obs, obs.where("modality = 'click'"), obs.where("modality = 'error'"), "view", s % 10 != 0, s % 10 == 1, s % 2 == 0, "not_sampled_by_policy", HOUR)
    return out.select("stream_id", "start_ms", "state", "reason_code")


@query(f"WITH {GRID} SELECT g.stream_id, g.start_ms, g.end_ms, 2 AS state_revision, count(*) AS results FROM g JOIN obs o ON o.stream_id = g.stream_id AND o.modality = 'error' AND o.start_ms < g.end_ms AND o.end_ms > g.start_ms GROUP BY ALL")
def t11_coverage_advance(spark, d):
    tasks = _shifted(view(spark, d, "obs").where("modality = 'error'"), stream_id="stream_id", other_start_ms="start_ms", other_end_ms="end_ms")
    return t.advanced(_grid(spark, d).withColumn("state_revision", F.lit(1)), tasks, HOUR)


@query("""WITH m AS (SELECT unit_id, revision, stream_id, start_ms, end_ms FROM material QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY revision DESC) = 1), r AS (SELECT stream_id, start_ms // 1000 AS s, start_ms // 1000 + 2500 AS e, event_id % 3 > 0 AS observed FROM (SELECT *, observation_id AS event_id FROM obs) WHERE modality = 'view')
    SELECT m.unit_id, m.revision + 1 AS revision, count(*) AS results, CASE WHEN m.unit_id % 2 = 0 THEN 'ocr' ELSE '' END AS pending, CASE WHEN m.unit_id % 2 = 0 THEN 'partial' WHEN bool_or(observed) THEN 'enriched' ELSE 'no_observations' END AS status FROM m JOIN r ON r.stream_id = m.stream_id AND s < end_ms AND e > start_ms GROUP BY m.unit_id, m.revision""")
def t12_j10_late_enrichment(spark, d):
    from ..operators.materials import latest_revision

    late = view(spark, d, "obs").where("modality = 'view'").selectExpr("stream_id", "start_ms div 1000 AS start_ms", "start_ms div 1000 + 2500 AS end_ms", "modality", "observation_id % 3 > 0 AS observed")
    units = latest_revision(view(spark, d, "material")).withColumn("pending", F.expr("CASE WHEN unit_id % 2 = 0 THEN array('view', 'ocr') ELSE array('view') END"))
    return t.enriched(units, late, 10_000).withColumn("pending", F.array_join("pending", ","))


@query("""WITH x AS (SELECT stream_id, pts_ms AS start_ms, coalesce(lead(pts_ms) OVER w, 2592000000) - pts_ms AS gap_ms, coalesce(lead(pts_ms * 2) OVER w - pts_ms * 2, -1) AS pts_jump_ms, CASE WHEN lead(pts_ms) OVER w IS NULL THEN 'stream_gap_at_window_end' ELSE 'recovered' END AS reason
    FROM point WINDOW w AS (PARTITION BY stream_id ORDER BY pts_ms, decode_index)) SELECT * FROM x WHERE gap_ms >= 36000000""")
def t14_a19_stalls(spark, d):
    progress = view(spark, d, "point").selectExpr("stream_id", "pts_ms AS at_ms", "pts_ms * 2 AS pts_ms", "decode_index AS event_id")
    return t.stalls(progress, 36_000_000, 2_592_000_000)


@query("""WITH x AS (SELECT stream_id, decode_index, CASE WHEN luma >= 64 THEN 'saturated' WHEN 2 * luma >= 64 THEN 'degraded' ELSE 'ok' END AS level FROM point), y AS (SELECT *, coalesce(level <> lag(level) OVER (PARTITION BY stream_id ORDER BY decode_index), true) AS i FROM x)
    SELECT stream_id, count_if(i AND level = 'degraded') AS degraded, count_if(i AND level = 'saturated') AS saturated FROM y GROUP BY 1""")
def t15_w11_pressure(spark, d):
    series = view(spark, d, "point").select("stream_id", F.col("decode_index").alias("event_id"), t.pressure_level(F.col("luma"), F.lit(64)).alias("level"))
    return t.level_entries(series)


@query("SELECT decode_index, greatest(luma * 100, least(luma * 400, 10000)) AS throttle_ms FROM point")
def scalar_throttle(spark, d):
    return view(spark, d, "point").select("decode_index", t.throttle_ms(F.col("luma") * 100).alias("throttle_ms"))


@query("""WITH x AS (SELECT stream_id, decode_index, CASE WHEN decode_index % 3 = 0 THEN NULL ELSE 40 END AS dur, lead(pts_ms) OVER (PARTITION BY stream_id ORDER BY decode_index) - pts_ms AS delta FROM point)
    SELECT decode_index, CASE WHEN dur IS NOT NULL THEN NULL WHEN delta IS NULL THEN 'duration_unavailable' WHEN delta <= 0 THEN 'duration_delta_nonpositive' WHEN delta > 5000 THEN 'duration_delta_out_of_range' END AS reason_code, coalesce(dur IS NULL AND delta > 0 AND delta <= 5000, false) AS derived FROM x""")
def t37_derived_durations(spark, d):
    samples = view(spark, d, "point").withColumn("duration_ms", F.expr("CASE WHEN decode_index % 3 = 0 THEN NULL ELSE 40 END"))
    return t.derived_durations(samples).select("decode_index", "reason_code", F.coalesce("derived", F.lit(False)).alias("derived"))


@query("""WITH x AS (SELECT stream_id, count(*) AS frames, CASE WHEN max(pts_ms) > min(pts_ms) THEN (count(*) - 1) * 1000 / (max(pts_ms) - min(pts_ms)) END AS rate FROM point GROUP BY 1)
    SELECT stream_id, frames, CASE WHEN rate IS NULL THEN 'unknown' WHEN abs(rate - 0.00003) <= 0.05 THEN 'constant' ELSE 'variable' END AS mode FROM x""")
def a24_frame_rate_mode(spark, d):
    return t.frame_rate_mode(view(spark, d, "point"), 0.00003).select("stream_id", "frames", "mode")


@query("""WITH x AS (SELECT stream_id, decode_index, CASE WHEN decode_index % 5 > 0 THEN luma END AS l FROM point), y AS (SELECT *, last_value(l IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY decode_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM x)
    SELECT decode_index, coalesce(abs(l - b), 0) AS delta FROM y""")
def w7_signature_delta(spark, d):
    frames = view(spark, d, "point").withColumn("frame_index", F.col("decode_index")).withColumn("signature", F.expr("CASE WHEN decode_index % 5 > 0 THEN array(luma, luma) END"))
    return t.signature_delta(frames).select("decode_index", "delta")


@query("SELECT stream_id, count(*) AS samples, min(pts_ms) AS first_pts, count_if(overlap) AS overlapping FROM (SELECT stream_id, pts_ms, pts_ms < lag(pts_ms + 600000) OVER (PARTITION BY stream_id ORDER BY decode_index) AS overlap FROM point) GROUP BY 1")
def a32_track_statistics(spark, d):
    from pyspark.sql import Window

    before = F.lag(F.col("pts_ms") + 600_000).over(Window.partitionBy("stream_id").orderBy("decode_index"))
    return view(spark, d, "point").withColumn("overlap", F.col("pts_ms") < before).groupBy("stream_id").agg(F.count("*").alias("samples"), F.min("pts_ms").alias("first_pts"), F.count_if("overlap").alias("overlapping"))


@query("SELECT modality, quality_state, count(*) AS n, count_if(confidence IS NULL) AS unknown FROM obs GROUP BY ALL")
def a2_report_counters(spark, d):
    return view(spark, d, "obs").groupBy("modality", "quality_state").agg(F.count("*").alias("n"), F.count_if(F.col("confidence").isNull()).alias("unknown"))


def _frames(spark, d):
    return view(spark, d, "point").select("stream_id", F.col("decode_index").alias("frame_index"), "pts_ms", F.array(*["luma"] * 4).alias("signature"))


@query("""WITH RECURSIVE f AS (SELECT stream_id, decode_index, pts_ms, luma, row_number() OVER (PARTITION BY stream_id ORDER BY decode_index) AS n FROM point),
    r AS (SELECT stream_id, decode_index, n, pts_ms AS kept, luma AS sig, true AS keep, 'first_frame' AS reason FROM f WHERE n = 1
    UNION ALL SELECT f.stream_id, f.decode_index, f.n, CASE WHEN f.pts_ms - kept >= 7200000 AND (abs(f.luma - sig) >= 30 OR f.pts_ms - kept >= 28800000) THEN f.pts_ms ELSE kept END, CASE WHEN f.pts_ms - kept >= 7200000 AND (abs(f.luma - sig) >= 30 OR f.pts_ms - kept >= 28800000) THEN f.luma ELSE sig END,
        f.pts_ms - kept >= 7200000 AND (abs(f.luma - sig) >= 30 OR f.pts_ms - kept >= 28800000), CASE WHEN f.pts_ms - kept < 7200000 THEN 'rate_limited' WHEN abs(f.luma - sig) >= 30 THEN 'content_change' WHEN f.pts_ms - kept >= 28800000 THEN 'static_heartbeat' ELSE 'no_change_yet' END
        FROM r JOIN f ON f.stream_id = r.stream_id AND f.n = r.n + 1) SELECT stream_id, decode_index AS frame_index, keep, reason FROM r""")
def t1_w8_sampler(spark, d):
    return k.sample(_frames(spark, d), min_interval=2 * HOUR, static_hold=8 * HOUR, threshold=30).select("stream_id", "frame_index", "keep", "reason")


#: The evidence selector as a recursion over each stream's frames; KEEPS is whether the sampler keeps the frame. r1 and r2 are the frames that a window may still take before its event.
EVIDENCE = """ev AS (SELECT stream_id, n, decode_index, pts_ms, pts_ms AS last, luma AS sig, pts_ms AS selected, NULL::BIGINT AS event, 0 AS windows, 0 AS post, '' AS win, NULL::BIGINT AS r1, NULL::BIGINT AS r2, 'due' AS act, 'first_frame' AS decision, '' AS wid, NULL::BIGINT AS p1, NULL::BIGINT AS p2 FROM fr WHERE n = 1
    UNION ALL SELECT stream_id, n, decode_index, pts_ms, CASE WHEN act = 'late' THEN last ELSE pts_ms END, CASE WHEN act = 'late' THEN sig ELSE luma END, CASE WHEN act IN ('event', 'post', 'due', 'kept') THEN pts_ms ELSE selected END, CASE WHEN act = 'event' THEN pts_ms ELSE event END,
        windows + CASE WHEN act = 'event' THEN 1 ELSE 0 END, CASE WHEN act = 'event' THEN 2 WHEN act = 'post' THEN post - 1 ELSE post END, CASE WHEN act = 'event' THEN printf('win-%08d', windows + 1) WHEN act = 'post' AND post = 1 THEN '' ELSE win END,
        CASE WHEN act IN ('event', 'due') THEN NULL WHEN act IN ('skip', 'limited') AND r1 IS NULL THEN n WHEN act IN ('skip', 'limited') AND r2 IS NOT NULL THEN r2 ELSE r1 END, CASE WHEN act IN ('event', 'due') THEN NULL WHEN act IN ('skip', 'limited') AND r1 IS NOT NULL THEN n ELSE r2 END,
        act, decision, CASE WHEN act = 'event' THEN printf('win-%08d', windows + 1) WHEN act = 'post' THEN win ELSE '' END, CASE WHEN act = 'event' THEN r1 END, CASE WHEN act = 'event' THEN r2 END
        FROM (SELECT *, CASE WHEN first_act IN ('skip', 'limited') AND keeps THEN 'kept' ELSE first_act END AS act FROM (SELECT f.stream_id, f.n, f.decode_index, f.pts_ms, f.luma, f.keeps, last, sig, selected, event, windows, post, win, r1, r2,
            CASE WHEN f.pts_ms < last THEN 'late' WHEN abs(f.luma - sig) >= 60 AND event IS NOT NULL AND f.pts_ms - event < 3600000 THEN 'limited' WHEN abs(f.luma - sig) >= 60 THEN 'event' WHEN win <> '' AND post > 0 THEN 'post' WHEN f.pts_ms - selected >= 21600000 THEN 'due' ELSE 'skip' END AS first_act,
            CASE WHEN f.pts_ms < last THEN 'no_change' WHEN abs(f.luma - sig) >= 60 THEN 'content_change' WHEN f.pts_ms - selected >= 21600000 THEN 'static_heartbeat' ELSE 'no_change' END AS decision FROM ev JOIN fr f ON f.stream_id = ev.stream_id AND f.n = ev.n + 1))),
    pre AS (SELECT stream_id, unnest([p1, p2]) AS n, wid FROM ev WHERE act = 'event'),
    evidence AS (SELECT ev.stream_id, ev.n, decode_index AS frame_index, pts_ms, decision, CASE WHEN pre.n IS NOT NULL THEN 'event_pre_context' WHEN act = 'event' THEN 'event_anchor' WHEN act = 'post' THEN 'event_post_context' WHEN act IN ('due', 'kept') THEN 'baseline_anchor' ELSE 'not_selected' END AS selection,
        coalesce(pre.wid, ev.wid) AS window_id, CASE WHEN pre.n IS NOT NULL THEN '' WHEN act = 'late' THEN 'non_monotonic_pts' WHEN act = 'limited' THEN 'event_rate_limited' WHEN act = 'skip' THEN 'no_change_yet' ELSE '' END AS skip_reason FROM ev LEFT JOIN pre ON pre.stream_id = ev.stream_id AND pre.n = ev.n)"""
FRAMES = "fr AS (SELECT stream_id, decode_index, pts_ms, luma, row_number() OVER (PARTITION BY stream_id ORDER BY decode_index) AS n, false AS keeps FROM point)"
KEPT = """f AS (SELECT stream_id, decode_index, pts_ms, luma, row_number() OVER (PARTITION BY stream_id ORDER BY decode_index) AS n FROM point),
    sampled AS (SELECT stream_id, decode_index, n, luma, pts_ms, pts_ms AS kept, luma AS base, true AS keeps FROM f WHERE n = 1
    UNION ALL SELECT stream_id, decode_index, n, luma, pts_ms, CASE WHEN take THEN pts_ms ELSE kept END, CASE WHEN take THEN luma ELSE base END, take FROM (SELECT f.*, kept, base, f.pts_ms - kept >= 7200000 AND (abs(f.luma - base) >= 30 OR f.pts_ms - kept >= 28800000) AS take FROM sampled s JOIN f ON f.stream_id = s.stream_id AND f.n = s.n + 1)),
    fr AS (SELECT stream_id, decode_index, pts_ms, luma, n, keeps FROM sampled)"""


@query(f"WITH RECURSIVE {KEPT}, {EVIDENCE} SELECT stream_id, frame_index, pts_ms, decision, selection, window_id, skip_reason FROM evidence")
def t2_t33_evidence(spark, d):
    frames = _frames(spark, d).join(k.sample(_frames(spark, d), min_interval=2 * HOUR, static_hold=8 * HOUR, threshold=30).select("stream_id", "frame_index", F.col("keep").alias("sampler_keeps")), ["stream_id", "frame_index"])
    return k.select_evidence(frames, gap=6 * HOUR, threshold=60, event_interval=HOUR)


@query(f"WITH RECURSIVE {FRAMES}, {EVIDENCE} SELECT stream_id, selection AS decision, count(*) AS n FROM evidence GROUP BY ALL")
def a18_evidence_histogram(spark, d):
    return t.counted_decisions(k.select_evidence(_frames(spark, d), gap=6 * HOUR, threshold=60, event_interval=HOUR), "selection")


@query(f"""WITH RECURSIVE {FRAMES}, {EVIDENCE} SELECT stream_id, 'frame' AS record, frame_index, pts_ms, decision, selection, window_id, skip_reason, NULL::BIGINT AS first_frame, NULL::BIGINT AS last_frame, NULL::BIGINT AS frames FROM evidence
    UNION ALL SELECT stream_id, 'window', NULL, NULL, NULL, NULL, window_id, NULL, min(frame_index), max(frame_index), count(*) FROM evidence WHERE window_id <> '' GROUP BY stream_id, window_id""")
def t3_evidence_ledger(spark, d):
    return k.evidence_ledger(_frames(spark, d), gap=6 * HOUR, threshold=60, event_interval=HOUR)


@query("""WITH RECURSIVE c AS (SELECT stream_id, pts_ms, row_number() OVER (PARTITION BY stream_id ORDER BY pts_ms, decode_index) AS n FROM point) SELECT stream_id, count(*) * 4000 AS n_bytes FROM c GROUP BY 1""")
def t4_t31_segments(spark, d):
    chunks = view(spark, d, "point").selectExpr("stream_id", "pts_ms", "10 AS duration_ms", "100000 AS sample_rate", "1 AS channels", "'F32LE' AS sample_format", "4000 AS n_bytes")
    return k.segment_audio(chunks, segment_ms=200).groupBy("stream_id").agg(F.sum("n_bytes").alias("n_bytes"))


@query("""WITH RECURSIVE e AS (SELECT stream_id, decode_index AS event_id, luma % 3 = 0 AS gives, luma AS buffer, CASE WHEN luma % 2 = 0 THEN 'audio' ELSE 'video' END AS kind, luma * 10 AS n_bytes, row_number() OVER (PARTITION BY stream_id ORDER BY decode_index) AS n FROM point),
    r AS (SELECT DISTINCT stream_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, '' AS outcome, []::STRUCT(b BIGINT, k VARCHAR, n BIGINT)[] AS held FROM e
    UNION ALL SELECT stream_id, n, event_id, outcome, CASE outcome WHEN 'retained' THEN list_append(held, {'b': buffer, 'k': kind, 'n': n_bytes}) WHEN 'released' THEN list_filter(held, lambda x: x.b <> buffer) ELSE held END FROM (
        SELECT e.*, held, CASE WHEN gives AND NOT there THEN 'unknown_buffer' WHEN gives THEN 'released' WHEN there THEN 'duplicate_buffer' WHEN len(held) >= 16 THEN 'table_full' WHEN len(list_filter(held, lambda x: x.k = kind)) >= 8 THEN 'kind_quota'
            WHEN coalesce(list_sum(list_transform(held, lambda x: x.n)), 0) + n_bytes > 8000 THEN 'arena_full' ELSE 'retained' END AS outcome
        FROM (SELECT e.*, held, list_contains(list_transform(held, lambda x: x.b), buffer) AS there FROM r JOIN e ON e.stream_id = r.stream_id AND e.n = r.n + 1) e))
    SELECT stream_id, event_id, outcome, len(held)::INTEGER AS held, coalesce(list_sum(list_transform(held, lambda x: x.n)), 0)::BIGINT AS held_bytes FROM r WHERE n > 0""")
def t16_t17_retention(spark, d):
    events = view(spark, d, "point").selectExpr("stream_id", "decode_index AS event_id", "CASE WHEN luma % 3 = 0 THEN 'release' ELSE 'offer' END AS action", "luma AS buffer_id", "CASE WHEN luma % 2 = 0 THEN 'audio' ELSE 'video' END AS kind", "luma * 10 AS n_bytes")
    return k.retain(events, limit=16, arena_bytes=8000)


HANDED = """SELECT stream_id, decode_index AS event_id, DIV(pts_ms, 1000) AS at_ms, CASE WHEN luma % 10 < 4 THEN 'retain' WHEN luma % 10 < 7 THEN 'acquire' WHEN luma % 10 = 7 THEN 'validate' WHEN luma % 10 = 8 THEN 'release' ELSE 'expire' END AS action,
    DIV(luma, 10) % 4 AS buffer_id, CASE WHEN DIV(luma, 10) % 2 = 0 THEN 'audio' ELSE 'video' END AS kind, (decode_index % 7) * 100 AS n_bytes, CASE WHEN decode_index % 3 = 0 THEN (luma % 5) * 50 - 50 END AS win_offset, CASE WHEN decode_index % 3 = 0 THEN (luma % 6) * 60 END AS win_length,
    CASE decode_index % 9 WHEN 0 THEN 10 WHEN 1 THEN 70000 ELSE 12000 + (decode_index % 5) * 12000 END AS ttl_ms, 1 + decode_index % 6 AS lease, CASE WHEN decode_index % 4 = 0 THEN DIV(pts_ms, 1000) + 1000 END AS claimed_ms, decode_index % 8 > 0 AS read_only FROM point"""


@query(f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY event_id) AS n FROM ({HANDED})),
    r AS (SELECT DISTINCT stream_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, '' AS outcome, NULL::BIGINT AS g, NULL::BIGINT AS off, NULL::BIGINT AS length, NULL::BIGINT AS expires_ms, 0 AS reclaimed, []::STRUCT(b BIGINT, k VARCHAR, n BIGINT, l BIGINT, u BIGINT)[] AS held, 0::BIGINT AS issued FROM e
    UNION ALL SELECT stream_id, n, event_id, outcome, CASE WHEN outcome = 'granted' THEN issued + 1 END, CASE WHEN outcome = 'granted' THEN o END, CASE WHEN outcome = 'granted' THEN m END, CASE WHEN outcome = 'granted' THEN at_ms + ttl_ms END, (len(before) - len(held))::INTEGER,
        CASE outcome WHEN 'retained' THEN list_append(held, {{'b': buffer_id, 'k': kind, 'n': n_bytes, 'l': NULL, 'u': NULL}}) WHEN 'granted' THEN list_append(list_filter(held, lambda x: x.b <> buffer_id), {{'b': buffer_id, 'k': own.k, 'n': own.n, 'l': issued + 1, 'u': at_ms + ttl_ms}})
            WHEN 'released' THEN list_filter(held, lambda x: x.l IS DISTINCT FROM lease) ELSE held END, issued + CASE WHEN outcome = 'granted' THEN 1 ELSE 0 END
        FROM (SELECT *, CASE action WHEN 'retain' THEN CASE WHEN n_bytes = 0 THEN 'empty_buffer_payload' WHEN len(held) >= 3 THEN 'handoff_backlog_full' WHEN len(list_filter(held, lambda x: x.k = kind)) >= 1 THEN 'handoff_kind_quota_full' WHEN own IS NOT NULL THEN 'duplicate_buffer_id'
                WHEN coalesce(list_sum(list_transform(held, lambda x: x.n)), 0) + n_bytes > 900 THEN 'arena_capacity_exceeded' ELSE 'retained' END
            WHEN 'acquire' THEN CASE WHEN ttl_ms NOT BETWEEN 50 AND 60000 THEN 'invalid_lease_ttl' WHEN own IS NULL THEN 'unknown_buffer' WHEN m <= 0 OR o < 0 OR o + m > own.n THEN 'mapping_out_of_range' WHEN own.l IS NOT NULL THEN 'buffer_already_leased' ELSE 'granted' END
            WHEN 'validate' THEN CASE WHEN mine IS NULL THEN 'unknown_or_released_lease' WHEN claimed_ms <> mine.u THEN 'lease_expiry_mismatch' WHEN NOT read_only THEN 'lease_is_read_only' WHEN mine.u <= at_ms THEN 'invalid_or_expired_lease' ELSE 'valid' END
            WHEN 'release' THEN CASE WHEN mine IS NULL THEN 'unknown_or_released_lease' ELSE 'released' END ELSE 'expired' END AS outcome
        FROM (SELECT *, list_filter(held, lambda x: x.b = buffer_id)[1] AS own, list_filter(held, lambda x: x.l = lease)[1] AS mine, coalesce(win_offset, 0) AS o, coalesce(win_length, list_filter(held, lambda x: x.b = buffer_id)[1].n) AS m
        FROM (SELECT e.*, r.held AS before, r.issued, CASE WHEN action = 'expire' OR (action = 'acquire' AND ttl_ms BETWEEN 50 AND 60000) THEN list_filter(r.held, lambda x: x.u IS NULL OR x.u > at_ms) ELSE r.held END AS held FROM r JOIN e ON e.stream_id = r.stream_id AND e.n = r.n + 1))))
    SELECT stream_id, event_id, outcome, CASE WHEN g IS NOT NULL THEN printf('lease-%016x', g) END AS lease_id, off AS "offset", length, expires_ms, reclaimed, len(held)::INTEGER AS held, len(list_filter(held, lambda x: x.l IS NOT NULL))::INTEGER AS leased, coalesce(list_sum(list_transform(held, lambda x: x.n)), 0)::BIGINT AS held_bytes FROM r WHERE n > 0""")
def t36_handoff(spark, d):
    events = spark.sql(HANDED.replace("DIV(pts_ms, 1000)", "(pts_ms div 1000)").replace("DIV(luma, 10)", "(luma div 10)").replace("FROM point", "FROM {point}"), point=view(spark, d, "point"))
    events = events.withColumn("lease_id", F.format_string("lease-%016x", F.col("lease").cast("long"))).withColumnsRenamed({"win_offset": "offset", "win_length": "length"})
    return k.hand_off(events, limit=3, arena_bytes=900)


@query("""WITH g AS (SELECT stream_id, observation_id, start_ms AS granted_ms, start_ms + 50 + (observation_id % 7) * 9000 AS until, CASE WHEN observation_id % 3 = 0 THEN start_ms + (observation_id % 11) * 5000 END AS given FROM obs WHERE modality = 'view'),
    x AS (SELECT *, CASE WHEN given < until THEN given END AS released FROM g)
    SELECT stream_id, printf('lease-%016x', observation_id) AS lease_id, granted_ms, CASE WHEN least(coalesce(released, until), until) <= 1296000000 THEN coalesce(released, until) END AS ended_ms,
    CASE WHEN released <= 1296000000 THEN 'released' WHEN until <= 1296000000 THEN 'expired' ELSE 'outstanding' END AS ending FROM x""")
def t17_lease_ends(spark, d):
    from ..streaming.stateful import lease_ends

    o = view(spark, d, "obs").where("modality = 'view'").withColumn("lease_id", F.format_string("lease-%016x", "observation_id"))
    taken = o.selectExpr("stream_id", "observation_id * 2 AS event_id", "start_ms AS at_ms", "'acquire' AS action", "lease_id", "50 + (observation_id % 7) * 9000 AS ttl_ms")
    given = o.where("observation_id % 3 = 0").selectExpr("stream_id", "observation_id * 2 + 1 AS event_id", "start_ms + (observation_id % 11) * 5000 AS at_ms", "'release' AS action", "lease_id", "CAST(NULL AS BIGINT) AS ttl_ms")
    return lease_ends(taken.unionByName(given), 1_296_000_000)


STALLS = """x AS (SELECT stream_id, pts_ms AS start_ms, coalesce(lead(pts_ms) OVER w, 2592000000) - pts_ms AS gap_ms, coalesce(lead(pts_ms * 2 - (decode_index % 4) * 90000000) OVER w - (pts_ms * 2 - (decode_index % 4) * 90000000), -1) AS pts_jump_ms, CASE WHEN lead(pts_ms) OVER w IS NULL THEN 'stream_gap_at_window_end' ELSE 'recovered' END AS reason
    FROM point WINDOW w AS (PARTITION BY stream_id ORDER BY pts_ms, decode_index)), y AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY start_ms) AS n FROM x WHERE gap_ms >= 7200000)"""


@query(f"""WITH {STALLS} SELECT stream_id, count(*) AS stalls, sum(gap_ms)::BIGINT AS stalled_ms, max(gap_ms) AS max_stall_ms, sum(greatest(pts_jump_ms, 0))::BIGINT AS pts_gap_total_ms, max_by(reason, n) = 'recovered' AS recovered,
    string_agg(concat_ws(':', start_ms, gap_ms, pts_jump_ms, reason), ',' ORDER BY n) FILTER (n <= 16) AS events FROM y GROUP BY stream_id""")
def a19_stall_statistics(spark, d):
    progress = view(spark, d, "point").selectExpr("stream_id", "pts_ms AS at_ms", "pts_ms * 2 - (decode_index % 4) * 90000000 AS pts_ms", "decode_index AS event_id")
    return t.stall_statistics(t.stalls(progress, 7_200_000, 2_592_000_000))


@query(f"""WITH {GRID}, m AS (SELECT unnest(['view', 'click', 'summary']) AS modality), o AS (SELECT stream_id, modality, start_ms AS s, end_ms AS e FROM obs WHERE observation_id % 4 = 0),
    c AS (SELECT stream_id, observation_id AS receipt_id, start_ms AS s, end_ms AS e, CASE WHEN observation_id % 3 = 0 THEN ['view', 'click'] ELSE [modality] END AS produces, CASE WHEN observation_id % 5 = 0 THEN 'model_busy' WHEN observation_id % 7 = 0 THEN '' END AS why FROM obs WHERE observation_id % 2 = 0),
    j AS (SELECT g.stream_id, g.start_ms, g.end_ms, m.modality, EXISTS (SELECT 1 FROM o WHERE o.stream_id = g.stream_id AND o.modality = m.modality AND s < g.end_ms AND e > g.start_ms) AS seen, EXISTS (SELECT 1 FROM c WHERE c.stream_id = g.stream_id AND list_contains(produces, m.modality) AND s < g.end_ms AND e > g.start_ms) AS called,
        (SELECT min_by(why, receipt_id) FROM c WHERE c.stream_id = g.stream_id AND list_contains(produces, m.modality) AND s < g.end_ms AND e > g.start_ms AND why <> '') AS why, EXISTS (SELECT 1 FROM c WHERE c.stream_id = g.stream_id AND s < g.end_ms AND e > g.start_ms) AS any_call FROM g, m)
    SELECT stream_id, start_ms, end_ms, modality, CASE WHEN modality = 'summary' THEN 'queued' WHEN seen THEN 'observed' WHEN called THEN 'not_observed' ELSE 'not_sampled_by_policy' END AS state, CASE WHEN modality <> 'summary' AND NOT seen AND called THEN coalesce(why, 'processed_without_observation') END AS reason_code,
    CASE WHEN any_call THEN 'sampled' ELSE 'not_sampled_by_policy' END AS sampling_state FROM j""")
def t9_declared_coverage(spark, d):
    obs = view(spark, d, "obs")
    receipts = obs.where("observation_id % 2 = 0").selectExpr("stream_id", "start_ms", "end_ms", "observation_id AS receipt_id", "CASE WHEN observation_id % 3 = 0 THEN array('view', 'click') ELSE array(modality) END AS produces", "CASE WHEN observation_id % 5 = 0 THEN 'model_busy' WHEN observation_id % 7 = 0 THEN '' END AS outcome_reason")
    return t.declared_coverage(_grid(spark, d), obs.where("observation_id % 4 = 0"), receipts, ["view", "click"], ["summary"], HOUR)


@query(f"""WITH {GRID}, o AS (SELECT stream_id, start_ms AS s, end_ms AS e FROM obs WHERE modality = 'view'), r AS (SELECT stream_id, start_ms AS s, end_ms AS e, modality AS trigger FROM obs WHERE modality IN ('click', 'error') AND stream_id % 5 > 0),
    j AS (SELECT g.*, EXISTS (SELECT 1 FROM o WHERE o.stream_id = g.stream_id AND s < end_ms AND e > start_ms) AS seen, (SELECT string_agg(DISTINCT trigger, ',' ORDER BY trigger) FROM r WHERE r.stream_id = g.stream_id AND s < end_ms AND e > start_ms) AS triggers, EXISTS (SELECT 1 FROM r WHERE r.stream_id = g.stream_id) AS planned FROM g)
    SELECT stream_id, start_ms, end_ms, CASE WHEN seen THEN 'sampled' WHEN stream_id % 6 = 0 THEN 'not_applicable' WHEN triggers IS NOT NULL THEN 'semantic_refresh_without_observation' WHEN planned THEN 'covered_without_model_refresh' ELSE 'not_sampled_by_policy' END AS sampling_state, coalesce(triggers, '') AS triggers FROM j""")
def t8_sampling_states(spark, d):
    obs = view(spark, d, "obs")
    refresh = obs.where("modality IN ('click', 'error') AND stream_id % 5 > 0").withColumnRenamed("modality", "trigger")
    tracks = view(spark, d, "stream").selectExpr("stream_id", "CASE WHEN stream_id % 6 = 0 THEN 'subtitle' WHEN stream_id % 2 = 0 THEN 'video' ELSE 'audio' END AS kind")
    return t.sampling_states(_grid(spark, d), obs.where("modality = 'view'"), refresh, tracks, HOUR)
