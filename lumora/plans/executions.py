"""Queries over executions, their windows, tasks and receipts, and reports over decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import executions as e
from ..operators import kernels as k
from ..operators import ledger as g
from ..operators import timeline as t
from .fixtures import view
from .registry import query
from .timeline import GRID, HOUR, _frames, _grid

BRIDGE = "bridge AS (SELECT event_id % 2000 AS unit_id, CAST(1 + event_id % 3 AS INT) AS revision FROM events)"


def _material(spark, d):
    return view(spark, d, "material").withColumn("execution_id", F.col("supplier_id") % 40)


@query(f"""WITH {BRIDGE}, w AS (SELECT * FROM window_state QUALIFY row_number() OVER (PARTITION BY execution_id, stream_id, start_ms, end_ms ORDER BY state_revision DESC) = 1),
    m AS (SELECT *, supplier_id % 40 AS execution_id FROM material QUALIFY row_number() OVER (PARTITION BY supplier_id % 40, unit_id ORDER BY revision DESC) = 1)
    SELECT execution_id, 'window' AS kind, stream_id, start_ms, end_ms, NULL AS unit_id, state_revision AS revision, state, 0 AS observations FROM w
    UNION ALL SELECT execution_id, 'material', stream_id, start_ms, end_ms, unit_id, revision, status, (SELECT count(*) FROM bridge b WHERE b.unit_id = m.unit_id AND b.revision = m.revision) FROM m""")
def q5_execution_timeline(spark, d):
    bridge = view(spark, d, "obs").selectExpr("observation_id % 2000 AS unit_id", "CAST(1 + observation_id % 3 AS INT) AS revision")
    m = _material(spark, d).select("execution_id", "unit_id", "revision", "stream_id", "start_ms", "end_ms", "status")
    return e.execution_timeline(view(spark, d, "window_state"), m, bridge)


@query("""WITH m AS (SELECT * FROM material WHERE supplier_id % 40 = 7 QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY revision DESC) = 1)
    SELECT unit_id, revision, stream_id, start_ms FROM m ORDER BY stream_id, start_ms, unit_id LIMIT 100 OFFSET 20""")
def q6_execution_materials(spark, d):
    m = _material(spark, d).select("execution_id", "unit_id", "revision", "stream_id", "start_ms")
    return e.execution_page(m, 7, 100, 20).select("unit_id", "revision", "stream_id", "start_ms")


@query("""WITH x AS (SELECT * FROM execution QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY created_ms DESC, execution_id DESC) = 1), r AS (SELECT task_id, count(*) AS n, max(attempt) AS last_attempt FROM receipt GROUP BY 1)
    SELECT job_id, execution_id, x.run_id, t.task_id, t.state, t.attempt, coalesce(n, 0) AS receipts, last_attempt FROM x LEFT JOIN task t ON t.run_id = x.run_id LEFT JOIN r ON r.task_id = t.task_id""")
def q7_job_execution(spark, d):
    return e.job_details(view(spark, d, "execution"), view(spark, d, "task"), view(spark, d, "receipt")).select("job_id", "execution_id", "run_id", "task_id", "state", "attempt", "receipts", "last_attempt")


@query("""WITH x AS (SELECT t.task_id, t.attempt, r.attempt AS a, completed_ms, receipt_id, row_number() OVER (PARTITION BY t.task_id ORDER BY CASE WHEN r.attempt = t.attempt THEN 0 ELSE 1 END,
        CASE WHEN r.attempt = t.attempt THEN -completed_ms ELSE completed_ms END, CASE WHEN r.attempt = t.attempt THEN -receipt_id ELSE receipt_id END) AS n FROM task t LEFT JOIN receipt r ON r.task_id = t.task_id)
    SELECT task_id, attempt, a IS NOT NULL AND a = attempt AS exact, completed_ms, receipt_id FROM x WHERE n = 1""")
def j20_receipt_preference(spark, d):
    out = e.chosen_receipts(view(spark, d, "task").select("task_id", "attempt"), view(spark, d, "receipt"), ["completed_ms", "receipt_id"])
    return out.select("task_id", "attempt", "exact", "receipt.completed_ms", "receipt.receipt_id")


PLAY = """asset AS (SELECT p_partkey AS asset_id, p_partkey % 150 AS stream_id, CASE WHEN p_partkey % 11 = 0 THEN 'rtmp' ELSE 'file' END AS source_type,
        CASE WHEN p_partkey % 13 = 0 THEN 's3://' ELSE 'upload://' END || 'asset_' || lpad(CAST(p_partkey AS VARCHAR), 32, '0') AS object_uri, p_partkey % 5 AS sha256, CASE WHEN p_partkey % 17 = 0 THEN 0 ELSE 1000000 END AS duration_ms FROM part),
    ref AS (SELECT unit_id, part_id AS asset_id, CASE WHEN unit_id % 7 = 0 THEN 9 ELSE part_id % 5 END AS content_hash, start_ms, end_ms FROM material WHERE unit_id % 19 > 0),
    upload AS (SELECT 'asset_' || lpad(CAST(p_partkey AS VARCHAR), 32, '0') AS upload_id, CASE WHEN p_partkey % 6 = 0 THEN 8 ELSE p_partkey % 5 END AS sha256, CASE WHEN p_partkey % 4 = 0 THEN 'writing' ELSE 'awaiting_admission' END AS state FROM part WHERE p_partkey % 9 > 0)"""


@query(f"""WITH {PLAY}, req AS (SELECT DISTINCT l_orderkey AS unit_id, l_partkey AS asset_id FROM lineitem), m AS (SELECT DISTINCT unit_id, stream_id FROM material WHERE unit_id % 23 > 0),
    j AS (SELECT r.unit_id, r.asset_id, m.stream_id, CASE WHEN r.asset_id % 3 = 0 THEN a.stream_id ELSE m.stream_id END AS s, a.source_type, a.object_uri, a.sha256, a.duration_ms,
        (SELECT count(*) FROM ref f WHERE f.unit_id = r.unit_id AND f.asset_id = r.asset_id) AS refs, EXISTS (SELECT 1 FROM ref f WHERE f.unit_id = r.unit_id AND f.asset_id = r.asset_id AND f.content_hash <> a.sha256) AS differs,
        EXISTS (SELECT 1 FROM ref f WHERE f.unit_id = r.unit_id AND f.asset_id = r.asset_id AND (f.start_ms < 0 OR f.end_ms <= f.start_ms OR f.end_ms > a.duration_ms)) AS outside, u.sha256 AS usha, u.state AS ustate
        FROM req r LEFT JOIN m ON m.unit_id = r.unit_id LEFT JOIN asset a ON a.asset_id = r.asset_id LEFT JOIN upload u ON 'upload://' || u.upload_id = a.object_uri),
    c AS (SELECT unit_id, asset_id, object_uri, CASE WHEN stream_id IS NULL THEN 'material_not_found' WHEN refs = 0 THEN 'material_source_not_found' WHEN s <> stream_id OR differs THEN 'material_source_mismatch'
        WHEN source_type <> 'file' OR object_uri NOT LIKE 'upload://%' THEN 'material_source_unmapped' WHEN duration_ms <= 0 OR outside THEN 'material_source_time_invalid' WHEN ustate IS NULL THEN 'material_source_not_found'
        WHEN usha <> sha256 THEN 'material_source_mismatch' WHEN ustate <> 'awaiting_admission' THEN 'upload_incomplete' END AS reason_code FROM j)
    SELECT unit_id, asset_id, reason_code, CASE WHEN reason_code IS NULL THEN substr(object_uri, 10) END AS upload_id FROM c""")
def q8_playback_sources(spark, d):
    """An asset whose id divides by three keeps its own stream, others take that of the material that asks (one row a pair)."""
    part = spark.read.parquet(f"{d}/part.parquet").select("p_partkey")
    m = view(spark, d, "material")
    units = m.where("unit_id % 23 > 0").select("unit_id", "stream_id").distinct().withColumn("revision", F.lit(1)).withColumn("owner", F.lit("o"))
    req = m.select("unit_id", F.col("part_id").alias("asset_id"), F.lit(1).alias("revision"), F.lit("o").alias("owner"))
    streams = m.select(F.col("part_id").alias("p_partkey"), "stream_id").distinct()
    owned = part.join(streams, "p_partkey").where("p_partkey % 3 > 0 OR p_partkey % 150 = stream_id")
    asset = owned.selectExpr("p_partkey AS asset_id", "stream_id", "CASE WHEN p_partkey % 11 = 0 THEN 'rtmp' ELSE 'file' END AS source_type", "concat(CASE WHEN p_partkey % 13 = 0 THEN 's3://' ELSE 'upload://' END, 'asset_', lpad(p_partkey, 32, '0')) AS object_uri", "p_partkey % 5 AS sha256", "CASE WHEN p_partkey % 17 = 0 THEN 0 ELSE 1000000 END AS duration_ms", "'o' AS owner")
    ref = m.where("unit_id % 19 > 0").selectExpr("unit_id", "1 AS revision", "part_id AS asset_id", "CASE WHEN unit_id % 7 = 0 THEN 9 ELSE part_id % 5 END AS content_hash", "start_ms", "end_ms")
    upload = part.where("p_partkey % 9 > 0").selectExpr("concat('asset_', lpad(p_partkey, 32, '0')) AS upload_id", "'o' AS owner", "CASE WHEN p_partkey % 6 = 0 THEN 8 ELSE p_partkey % 5 END AS sha256", "CASE WHEN p_partkey % 4 = 0 THEN 'writing' ELSE 'awaiting_admission' END AS state")
    return e.playback_sources(req, units, ref, asset, upload).select("unit_id", "asset_id", "reason_code", "upload_id")


@query("""WITH r AS (SELECT event_id AS seq, event_id % 900 AS task_id, CASE WHEN event_id % 1800 < 900 THEN 'a' ELSE 'b' END AS digest, event_id % 4 > 0 AS success, event_id % 8 = 0 AS retryable, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'timeout' END AS reason_code FROM events),
    s AS (SELECT range AS task_id, CASE range % 5 WHEN 0 THEN 'succeeded' ELSE 'queued' END AS state FROM range(850)), h AS (SELECT range AS task_id, 'a' AS digest FROM range(850) WHERE range % 10 = 0),
    x AS (SELECT r.*, s.state, h.digest AS old, min(CASE WHEN s.state = 'queued' AND h.digest IS NULL AND (success OR NOT retryable) THEN seq END) OVER (PARTITION BY r.task_id) AS first FROM r LEFT JOIN s ON s.task_id = r.task_id LEFT JOIN h ON h.task_id = r.task_id),
    y AS (SELECT x.*, coalesce(old, CASE WHEN x.seq > first THEN w.digest END) AS known FROM x LEFT JOIN (SELECT seq AS wseq, digest FROM r) w ON w.wseq = first),
    z AS (SELECT task_id, seq, reason_code, CASE WHEN state IS NULL THEN 'vlm_result_task_not_found' WHEN known = digest THEN 'replayed' WHEN known IS NOT NULL THEN 'vlm_result_conflict' WHEN state = 'succeeded' THEN 'vlm_result_terminal_without_receipt'
        WHEN success THEN 'succeeded' WHEN retryable THEN 'vlm_result_retryable_must_not_be_published' ELSE 'failed' END AS outcome FROM y)
    SELECT task_id, seq, outcome, CASE WHEN outcome = 'failed' THEN CASE WHEN reason_code = '' THEN 'vlm_result_failed' ELSE reason_code END END AS failure FROM z""")
def t13_apply_results(spark, d):
    r = view(spark, d, "obs").selectExpr("observation_id AS seq", "observation_id % 900 AS task_id", "CASE WHEN observation_id % 1800 < 900 THEN 'a' ELSE 'b' END AS digest", "observation_id % 4 > 0 AS success", "observation_id % 8 = 0 AS retryable", "CASE WHEN observation_id % 3 = 0 THEN '' ELSE 'timeout' END AS reason_code")
    tasks = spark.range(850).selectExpr("id AS task_id", "CASE WHEN id % 5 = 0 THEN 'succeeded' ELSE 'queued' END AS state")
    stored = spark.range(850).where("id % 10 = 0").selectExpr("id AS task_id", "'a' AS digest")
    return e.applied_results(tasks, stored, r)


@query(f"""WITH {GRID}, c AS (SELECT * FROM g WHERE start_ms % 7200000 = 0 AND NOT EXISTS (SELECT 1 FROM obs o WHERE o.stream_id = g.stream_id AND o.modality = 'error' AND o.start_ms // 3600000 = g.start_ms // 3600000))
    SELECT c.stream_id, 'frame-' || c.stream_id || '-' || c.start_ms AS item_id, c.start_ms, c.end_ms, coalesce('unit_' || (SELECT min(observation_id) FROM obs o WHERE o.stream_id = c.stream_id AND o.modality = 'view' AND o.start_ms <= c.start_ms AND c.start_ms < o.end_ms),
    'derived_frame-' || c.stream_id || '-' || c.start_ms) AS unit FROM c""")
def t26_enqueue_tasks(spark, d):
    obs = view(spark, d, "obs")
    return e.enqueued(_grid(spark, d), obs.where("modality = 'error'"), obs.where("modality = 'view'").withColumnRenamed("observation_id", "unit_id"), 5_000_000, HOUR)


@query("""WITH w AS (SELECT * FROM window_state QUALIFY row_number() OVER (PARTITION BY execution_id, stream_id, start_ms, end_ms ORDER BY state_revision DESC) = 1)
    SELECT execution_id, count(*) AS windows, count_if(state = 'observed') AS described, count_if(state IN ('queued', 'running')) AS queued, count_if(state = 'failed') AS failed, max(end_ms) AS duration_ms FROM w GROUP BY 1""")
def a15_coverage_summary(spark, d):
    w = e._greatest(view(spark, d, "window_state"), ["execution_id", "stream_id", "start_ms", "end_ms"], ["state_revision"])
    return e.coverage_summary(w, "execution_id", F.col("state"))


@query(f"""WITH {GRID}, x AS (SELECT g.stream_id, g.start_ms, g.end_ms, modality, observation_id, CASE observation_id % 3 WHEN 0 THEN 'succeeded' WHEN 1 THEN CASE WHEN observation_id % 5 = 0 THEN 'queued' ELSE 'succeeded' END ELSE CASE WHEN observation_id % 7 = 0 THEN 'failed' ELSE 'succeeded' END END AS state
        FROM g JOIN obs o ON o.stream_id = g.stream_id AND o.start_ms < g.end_ms AND o.end_ms > g.start_ms),
    y AS (SELECT stream_id, start_ms, end_ms, modality, min(CASE WHEN state = 'failed' THEN observation_id END) AS f, bool_or(state = 'queued') AS q, bool_or(state = 'succeeded' AND observation_id % 2 = 0) AS o FROM x GROUP BY ALL)
    SELECT stream_id, start_ms, end_ms, modality, CASE WHEN f IS NOT NULL THEN 'failed' WHEN q THEN 'queued' WHEN o THEN 'observed' ELSE 'not_observed' END AS state, CASE WHEN f IS NOT NULL THEN 'r' || (f % 4) WHEN NOT q AND NOT o THEN 'enrichment_no_observations' END AS reason_code FROM y""")
def a16_window_states(spark, d):
    tasks = view(spark, d, "obs").selectExpr("stream_id", "observation_id AS task_id", "modality", "start_ms", "end_ms", "observation_id % 2 = 0 AS observed", "concat('r', observation_id % 4) AS reason_code",
        "CASE observation_id % 3 WHEN 0 THEN 'succeeded' WHEN 1 THEN CASE WHEN observation_id % 5 = 0 THEN 'queued' ELSE 'succeeded' END ELSE CASE WHEN observation_id % 7 = 0 THEN 'failed' ELSE 'succeeded' END END AS state")
    return e.window_states(_grid(spark, d), tasks, HOUR)


@query("""WITH r AS (SELECT o_orderkey AS request_id, o_custkey % 100 AS input_ref, 1 + o_orderkey % 3 AS revision FROM orders), u AS (SELECT o_custkey % 100 AS input_ref, 1 + o_orderkey % 3 AS revision, min(o_orderkey) AS run_id FROM orders WHERE o_orderkey % 97 = 0 AND o_orderkey % 4 <> 3 GROUP BY 1, 2)
    SELECT request_id, run_id, run_id IS NOT NULL AS existing FROM r LEFT JOIN u ON u.input_ref = r.input_ref AND u.revision = r.revision""")
def o6_idempotent_submit(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey", "o_custkey % 100 AS input_ref", "1 + o_orderkey % 3 AS revision")
    runs = orders.where("o_orderkey % 97 = 0").selectExpr("o_orderkey AS run_id", "input_ref", "revision", "element_at(array('accepted', 'queued', 'running', 'failed'), CAST(1 + o_orderkey % 4 AS INT)) AS state")
    return e.submitted(orders.withColumnRenamed("o_orderkey", "request_id"), runs, ["input_ref", "revision"]).select("request_id", "run_id", "existing")


RECEIPTS = "SELECT receipt_id * 10 + part AS receipt_id, task_id, DIV(task_id, 10) + CASE WHEN receipt_id % 31 = 0 THEN 1 ELSE 0 END AS run_id, attempt, input_count - 5 AS input_count, CASE WHEN receipt_id % 17 = 0 THEN NULL ELSE 1 END AS output_count, CASE WHEN receipt_id % 29 = 0 THEN 600 ELSE 10 END AS reason_length, CASE WHEN receipt_id % 37 = 0 THEN 'x' ELSE 'p' END AS plugin_id FROM receipt"


@query(f"""WITH r AS ({RECEIPTS}) SELECT CASE WHEN t.task_id IS NULL OR r.run_id <> t.run_id OR r.attempt <> t.attempt THEN 'task_execution_receipt_identity_mismatch' WHEN input_count < 0 OR output_count IS NULL THEN 'task_execution_receipt_invalid'
    WHEN reason_length > 160 THEN 'task_execution_receipt_limits_exceeded' WHEN plugin_id <> 'p' OR r.task_id % 8 = 0 THEN 'task_receipt_plugin_identity_mismatch' ELSE 'valid' END AS problem, count(*) AS n, sum(receipt_id) AS ids FROM r LEFT JOIN task t ON t.task_id = r.task_id GROUP BY 1""")
def o14_receipt_validation(spark, d):
    r = view(spark, d, "receipt").selectExpr("receipt_id * 10 + part AS receipt_id", "task_id", "task_id div 10 + CASE WHEN receipt_id % 31 = 0 THEN 1 ELSE 0 END AS run_id", "attempt", "'a' AS assignment_id", "input_count - 5 AS input_count", "CASE WHEN receipt_id % 17 > 0 THEN 1 END AS output_count",
        "'m' AS result_manifest_ref", "repeat('r', CASE WHEN receipt_id % 29 = 0 THEN 600 ELSE 10 END) AS reason_code", "CASE WHEN receipt_id % 37 = 0 THEN 'x' ELSE 'p' END AS plugin_id", "'c' AS config_hash", "1 AS started_ms", "2 AS completed_ms")
    tasks = view(spark, d, "task").selectExpr("task_id", "run_id", "attempt", "'a' AS assignment_id", "'p' AS plugin_id", "CASE WHEN task_id % 8 = 0 THEN '' ELSE 'c' END AS config_hash")
    return e.receipt_problems(r, tasks).groupBy(F.coalesce("problem", F.lit("valid")).alias("problem")).agg(F.count("*").alias("n"), F.sum("receipt_id").alias("ids"))


@query("SELECT task_id, CASE WHEN task_id % 3 = 0 THEN 'ready' ELSE state END AS state FROM task")
def o17_retry_release(spark, d):
    return e.released_retries(view(spark, d, "task").withColumn("state", F.expr("CASE WHEN task_id % 3 = 0 THEN 'retry_wait' ELSE state END"))).select("task_id", "state")


@query("""WITH live AS (SELECT o_orderkey AS p FROM orders WHERE o_orderkey % 4 > 0 OR o_orderkey % 12 = 0 OR o_orderkey % 20 = 0), n AS (SELECT 'rel' || (p % 700) AS release_id, 'cfg' || (p % 3) AS config_hash FROM live UNION SELECT 'rel' || (p % 900), 'late' FROM live WHERE p % 5 = 0)
    SELECT c_custkey AS runtime_id, EXISTS (SELECT 1 FROM n WHERE n.release_id = 'rel' || (c_custkey % 1000) AND n.config_hash = CASE c_custkey % 4 WHEN 3 THEN 'late' ELSE 'cfg' || (c_custkey % 4) END) AS pinned FROM customer""")
def f17_o18_pinned_runtimes(spark, d):
    """Every fourth definition is retired; runs of every third are running, those of every fifth have queued tasks."""
    p = spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey AS pipeline_id", "1 AS revision")
    late = F.when(F.col("pipeline_id") % 5 == 0, F.array(F.struct(F.concat(F.lit("rel"), F.col("pipeline_id") % 900).alias("release_id"), F.lit("late").alias("config_hash"))))
    node = F.struct(F.concat(F.lit("rel"), F.col("pipeline_id") % 700).alias("release_id"), F.concat(F.lit("cfg"), F.col("pipeline_id") % 3).alias("config_hash"), late.alias("delayed_enrichments"))
    runs = p.selectExpr("pipeline_id", "revision", "pipeline_id AS run_id", "CASE WHEN pipeline_id % 3 = 0 THEN 'running' ELSE 'succeeded' END AS state")
    runtime = spark.read.parquet(f"{d}/customer.parquet").selectExpr("c_custkey AS runtime_id", "concat('rel', c_custkey % 1000) AS release_id", "CASE WHEN c_custkey % 4 = 3 THEN 'late' ELSE concat('cfg', c_custkey % 4) END AS config_hash")
    return e.pinned_runtimes(runtime, p.withColumn("nodes", F.to_json(F.array(node))), p.where("pipeline_id % 4 = 0"), runs, runs.where("run_id % 5 = 0")).select("runtime_id", "pinned")


@query("SELECT observation_id, row_number() OVER (PARTITION BY stream_id, start_ms // 300000 ORDER BY start_ms, end_ms, modality, observation_id) AS place FROM obs WHERE end_ms <= start_ms // 300000 * 300000 + 300000")
def l4_observation_order(spark, d):
    return t.observation_order(view(spark, d, "obs"), 300_000).select("observation_id", "place")


@query("""WITH u AS (SELECT unit_id, revision, status, max(revision) OVER (PARTITION BY unit_id) AS newest FROM material),
    x AS (SELECT e.embedding_id, updated_ms, CASE WHEN state <> 'tombstoned' AND status IS NULL THEN 'orphaned' WHEN state <> 'tombstoned' AND status = 'failed' THEN 'material_failed'
    WHEN state <> 'tombstoned' AND e.revision < newest THEN 'superseded' WHEN state = 'tombstoned' AND vector_ref IS NOT NULL THEN 'pending_vector_purge'
    WHEN state = 'pending' AND updated_ms < 300000 THEN 'stale' END AS reason FROM embedding e LEFT JOIN u ON u.unit_id = e.unit_id AND u.revision = e.revision)
    SELECT embedding_id, reason FROM x WHERE reason IS NOT NULL ORDER BY updated_ms, embedding_id LIMIT 100""")
def l7_reconciliation_candidates(spark, d):
    todo = g.reconcile(view(spark, d, "embedding"), view(spark, d, "material"), 400_000, 100_000)
    return todo.orderBy("updated_ms", "embedding_id").limit(100).select("embedding_id", "reason")


@query("SELECT stream_id, decode_index, greatest(count(*) OVER (PARTITION BY stream_id) - 16, 0) AS omitted FROM point QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY pts_ms, decode_index) <= 16")
def l8_bounded_listing(spark, d):
    return t.listed(view(spark, d, "point"), "stream_id", ["pts_ms", "decode_index"], 16).select("stream_id", "decode_index", "omitted")


SAMPLED = """f AS (SELECT stream_id, decode_index, pts_ms, luma, row_number() OVER (PARTITION BY stream_id ORDER BY decode_index) AS n FROM point),
    r AS (SELECT stream_id, decode_index, n, pts_ms, pts_ms AS kept, luma AS sig, true AS keep, 'first_frame' AS reason FROM f WHERE n = 1
    UNION ALL SELECT f.stream_id, f.decode_index, f.n, f.pts_ms, CASE WHEN f.pts_ms - kept >= 7200000 AND (abs(f.luma - sig) >= 30 OR f.pts_ms - kept >= 28800000) THEN f.pts_ms ELSE kept END, CASE WHEN f.pts_ms - kept >= 7200000 AND (abs(f.luma - sig) >= 30 OR f.pts_ms - kept >= 28800000) THEN f.luma ELSE sig END,
        f.pts_ms - kept >= 7200000 AND (abs(f.luma - sig) >= 30 OR f.pts_ms - kept >= 28800000), CASE WHEN f.pts_ms - kept < 7200000 THEN 'rate_limited' WHEN abs(f.luma - sig) >= 30 THEN 'content_change' WHEN f.pts_ms - kept >= 28800000 THEN 'static_heartbeat' ELSE 'no_change_yet' END
        FROM r JOIN f ON f.stream_id = r.stream_id AND f.n = r.n + 1)"""


def _sampled(spark, d):
    return k.sample(_frames(spark, d), min_interval=2 * HOUR, static_hold=8 * HOUR, threshold=30)


@query(f"""WITH RECURSIVE {SAMPLED}, s AS (SELECT *, pts_ms - lag(pts_ms) OVER (PARTITION BY stream_id ORDER BY n) AS step FROM r), g AS (SELECT stream_id, max(gap) AS gap FROM (SELECT stream_id, pts_ms - lag(pts_ms) OVER (PARTITION BY stream_id ORDER BY n) AS gap FROM r WHERE keep) GROUP BY 1)
    SELECT s.stream_id, count(*) AS observed, count_if(keep) AS kept, count_if(reason = 'first_frame') AS kept_first_frame, count_if(reason = 'content_change') AS kept_content_change, count_if(reason = 'static_heartbeat') AS kept_static_heartbeat, count_if(reason = 'rate_limited') AS skipped_rate_limited,
    count_if(reason = 'no_change_yet') AS skipped_no_change, 0 AS skipped_non_monotonic, 0 AS skipped_missing_signature, 0 AS skipped_backpressure_throttled, coalesce(max(step), 0) AS max_frame_interval_ms, coalesce(any_value(gap), 0) AS max_gap_ms FROM s JOIN g ON g.stream_id = s.stream_id GROUP BY 1""")
def a17_a33_sampling_report(spark, d):
    return t.sampling_report(_sampled(spark, d))


@query(f"WITH RECURSIVE {SAMPLED} SELECT stream_id, decode_index AS frame_index, CASE WHEN keep THEN 'sampler' WHEN decode_index % 5 = 0 THEN 'evidence_only' ELSE reason END AS outcome FROM r")
def t39_combined_keep(spark, d):
    evidence = _frames(spark, d).selectExpr("stream_id", "frame_index", "frame_index % 5 = 0 AS retain")
    return t.combined_keep(_sampled(spark, d), evidence).select("stream_id", "frame_index", "outcome")


HANDOFF = "CASE decode_index % 7 WHEN 0 THEN 'retain' WHEN 1 THEN 'retain' WHEN 2 THEN 'retain' WHEN 3 THEN 'release' WHEN 4 THEN 'expire' WHEN 5 THEN 'reject' ELSE 'retain' END"


@query(f"""WITH x AS (SELECT stream_id, decode_index, {HANDOFF} AS action, luma FROM point), y AS (SELECT *, sum(CASE action WHEN 'retain' THEN 1 WHEN 'reject' THEN 0 ELSE -1 END) OVER (PARTITION BY stream_id ORDER BY decode_index) AS depth FROM x)
    SELECT stream_id, 64 AS capacity, sum(CASE action WHEN 'retain' THEN 1 WHEN 'reject' THEN 0 ELSE -1 END) AS current, greatest(max(depth), 0) AS peak, count_if(action = 'reject') AS dropped_total, count_if(action = 'expire') AS timeouts_total, count_if(action = 'release') AS residency_samples,
    coalesce(max(CASE WHEN action = 'release' THEN luma END), 0) AS residency_max_ms, coalesce(sum(CASE WHEN action = 'release' THEN luma END) // nullif(count_if(action = 'release'), 0), 0) AS residency_avg_ms FROM y GROUP BY 1""")
def a20_handoff_report(spark, d):
    events = view(spark, d, "point").selectExpr("stream_id", "decode_index AS event_id", f"{HANDOFF} AS action", "luma AS residency_ms")
    return t.handoff_report(events, 64)


@query("SELECT stream_id, CASE WHEN decode_index % 2 = 0 THEN 'audio' ELSE 'video' END AS kind, CASE WHEN luma > 100 THEN 'table_full' ELSE 'kind_quota' END AS reason, count(*) AS n FROM point WHERE decode_index % 7 = 5 GROUP BY ALL")
def a20_handoff_drops(spark, d):
    return t.handoff_drops(view(spark, d, "point").selectExpr("stream_id", f"{HANDOFF} AS action", "CASE WHEN decode_index % 2 = 0 THEN 'audio' ELSE 'video' END AS kind", "CASE WHEN luma > 100 THEN 'table_full' ELSE 'kind_quota' END AS reason"))


@query("""WITH s AS (SELECT decode_index, stream_id, decode_index % 2 AS kind, CASE WHEN decode_index % 11 = 0 THEN NULL WHEN decode_index % 13 = 0 THEN -1 ELSE pts_ms END AS pts, decode_index % 17 AS dur, luma AS n_bytes, decode_index % 19 AS w, decode_index % 23 AS rate, CASE WHEN stream_id % 3 = 0 AND decode_index % 50 = 0 THEN 7 ELSE 5 END AS origin FROM point),
    c AS (SELECT *, CASE WHEN pts IS NULL OR pts < 0 THEN 'pts_unavailable' WHEN dur = 0 THEN 'duration_unavailable' WHEN n_bytes = 0 THEN 'empty_payload' WHEN kind = 0 AND w = 0 THEN 'missing_frame_size' WHEN kind = 0 AND w = 1 THEN 'missing_pixel_format' WHEN kind = 1 AND rate = 0 THEN 'missing_audio_layout' END AS reason_code FROM s)
    SELECT decode_index, reason_code, coalesce((SELECT count(DISTINCT origin) FROM c b WHERE b.stream_id = c.stream_id AND b.kind = c.kind AND b.reason_code IS NULL) > 1, false) AS origin_changed FROM c""")
def t38_sample_acceptance(spark, d):
    samples = view(spark, d, "point").selectExpr("decode_index", "stream_id", "CASE WHEN decode_index % 2 = 0 THEN 'video' ELSE 'audio' END AS kind", "CASE WHEN decode_index % 11 = 0 THEN NULL WHEN decode_index % 13 = 0 THEN -1 ELSE pts_ms END AS pts_ms", "decode_index % 17 AS duration_ms", "luma AS n_bytes",
        "decode_index % 19 AS width", "9 AS height", "CASE WHEN decode_index % 19 > 1 THEN 'RGBA' ELSE '' END AS pixel_format", "decode_index % 23 AS sample_rate", "1 AS channels", "CASE WHEN stream_id % 3 = 0 AND decode_index % 50 = 0 THEN 7 ELSE 5 END AS origin_ms")
    return t.accepted_samples(samples).select("decode_index", "reason_code", "origin_changed")


LEDGERED = "CASE decode_index % 6 WHEN 0 THEN 'baseline_anchor' WHEN 1 THEN 'event_anchor' WHEN 2 THEN 'context' WHEN 3 THEN 'context' ELSE 'not_selected' END"


@query(f"""WITH f AS (SELECT stream_id, decode_index, {LEDGERED} AS selection, CASE WHEN decode_index % 6 IN (1, 2, 3) THEN 'w' || (decode_index // 18) END AS window_id, CASE WHEN luma % 5 > 0 AND decode_index % 6 < 4 THEN decode_index END AS buffer_id FROM point)
    SELECT stream_id, 'anchor' AS kind, CASE WHEN buffer_id IS NULL THEN 'anchor-' || lpad(CAST(decode_index AS VARCHAR), 8, '0') ELSE CAST(buffer_id AS VARCHAR) END AS label, buffer_id IS NOT NULL AS admitted, CASE WHEN buffer_id IS NULL THEN 0 ELSE 1 END AS n_buffers, buffer_id IS NOT NULL AND selection = 'baseline_anchor' AS for_vlm, buffer_id IS NOT NULL AS for_ocr FROM f WHERE selection LIKE '%_anchor'
    UNION ALL SELECT stream_id, 'window', window_id, bool_or(selection = 'event_anchor' AND buffer_id IS NOT NULL), count(buffer_id), bool_or(selection = 'event_anchor' AND buffer_id IS NOT NULL), false FROM f WHERE window_id IS NOT NULL GROUP BY stream_id, window_id""")
def t34_input_units(spark, d):
    frames = view(spark, d, "point").selectExpr("stream_id", "decode_index AS frame_index", f"{LEDGERED} AS selection", "CASE WHEN decode_index % 6 IN (1, 2, 3) THEN concat('w', decode_index div 18) END AS window_id", "CASE WHEN luma % 5 > 0 AND decode_index % 6 < 4 THEN decode_index END AS buffer_id")
    return t.input_units(frames)


#: Chunks of 100 ms in a dense row per stream, each 30th after a pause of a second.
CHUNKS = "c AS (SELECT stream_id, n, n * 100 + DIV(n, 30) * 1000 AS pts FROM (SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY pts_ms, decode_index) - 1 AS n FROM point))"


def _segments(spark, d, **policy):
    from pyspark.sql import Window

    n = (F.row_number().over(Window.partitionBy("stream_id").orderBy("pts_ms", "decode_index")) - 1).cast("long")
    chunks = view(spark, d, "point").withColumn("n", n).selectExpr("stream_id", "n * 100 + (n div 30) * 1000 AS pts_ms", "100 AS duration_ms", "1000 AS sample_rate", "1 AS channels", "'F32LE' AS sample_format", "400 AS n_bytes")
    return k.segment_audio(chunks, **policy)


#: A run of chunks without a pause fills segments of a second; the last of a run may be short.
RUNS = "s AS (SELECT stream_id, DIV(n, 30) AS run, DIV(n % 30, 10) AS part, min(pts) AS start_ms, max(pts) + 100 AS end_ms, count(*) < 10 AS partial, count(*) * 400 AS n_bytes FROM c GROUP BY 1, 2, 3)"


@query(f"WITH {CHUNKS}, {RUNS} SELECT stream_id, start_ms, end_ms, partial, n_bytes FROM s")
def t4_audio_segments(spark, d):
    return _segments(spark, d, segment_ms=1000)


#: With 300 ms of overlap each further segment of a run starts 300 ms before the end of the one before; it must bring new audio.
OVERLAPPED = """l AS (SELECT stream_id, DIV(n, 30) AS run, min(pts) AS base, max(pts) + 100 AS stop FROM c GROUP BY 1, 2), h AS (SELECT stream_id, base + 700 * k AS start_ms, stop, k FROM l, (SELECT unnest(range(5)) AS k)),
    s AS (SELECT stream_id, start_ms, least(start_ms + 1000, stop) AS end_ms FROM h WHERE k = 0 OR start_ms + 300 < stop)"""


@query(f"WITH {CHUNKS}, {OVERLAPPED} SELECT stream_id, start_ms, end_ms, end_ms - start_ms < 1000 AS partial, (end_ms - start_ms) * 4 AS n_bytes FROM s")
def t31_overlapped_segments(spark, d):
    return _segments(spark, d, segment_ms=1000, overlap_ms=300)


@query(f"""WITH {CHUNKS}, {RUNS} SELECT stream_id, count(*) AS segments, count_if(partial) AS partial, sum(n_bytes) AS n_bytes, 'seg-' || stream_id || '-00000001' AS first_id, 'seg-' || stream_id || '-' || lpad(CAST(count(*) AS VARCHAR), 8, '0') AS last_id FROM s GROUP BY stream_id""")
def a34_segment_report(spark, d):
    return t.segment_report(_segments(spark, d, segment_ms=1000))


#: Every seventh observation comes twice, every 49th of them with another state the second time.
AGAIN = "o AS (SELECT observation_id, stream_id, start_ms, end_ms, modality, confidence, quality_state FROM obs UNION ALL SELECT observation_id, stream_id, start_ms, end_ms, modality, confidence, CASE WHEN observation_id % 49 = 0 THEN 'revised' ELSE quality_state END FROM obs WHERE observation_id % 7 = 0)"


@query(f"""WITH {AGAIN}, x AS (SELECT stream_id, start_ms // 300000 * 300000 AS ws, observation_id, count(*) - 1 AS again, count(DISTINCT quality_state) > 1 AS differs FROM o WHERE end_ms <= start_ms // 300000 * 300000 + 300000 GROUP BY 1, 2, 3)
    SELECT stream_id, ws AS start_ms, count(*) AS received, sum(again) AS duplicates, CASE WHEN bool_or(differs) THEN 'immutable_observation_conflict' WHEN count(*) > 1 THEN 'fusion_observation_limit_exceeded' END AS reason_code FROM x GROUP BY 1, 2""")
def a1_fusion_conflicts(spark, d):
    obs = view(spark, d, "obs").select("observation_id", "stream_id", "start_ms", "end_ms", "modality", "confidence", "quality_state")
    again = obs.where("observation_id % 7 = 0").withColumn("quality_state", F.expr("CASE WHEN observation_id % 49 = 0 THEN 'revised' ELSE quality_state END"))
    return t.fuse(obs.unionAll(again), 300_000, ["view"], ["click"], most=1).select("stream_id", "start_ms", "received", "duplicates", "reason_code")


@query("""WITH n AS (SELECT stream_id, start_ms // 3600000 * 3600000 AS start_ms, count(*) AS received FROM obs WHERE end_ms <= start_ms // 3600000 * 3600000 + 3600000 GROUP BY 1, 2),
    p AS (SELECT stream_id, start_ms // 3600000 * 3600000 AS start_ms, count(*) AS before FROM obs WHERE end_ms <= start_ms // 3600000 * 3600000 + 3600000 AND observation_id % 3 > 0 GROUP BY 1, 2)
    SELECT n.stream_id, n.start_ms, before IS NULL OR before <> received AS changed, CASE WHEN before IS NULL THEN 1 WHEN before = received OR n.stream_id % 5 = 0 THEN 4 ELSE 5 END AS revision, CASE WHEN before <> received AND n.stream_id % 5 = 0 THEN 'fusion_revision_time_not_increasing' END AS reason_code FROM n LEFT JOIN p ON p.stream_id = n.stream_id AND p.start_ms = n.start_ms""")
def a1_fusion_revisions(spark, d):
    """The same windows first without every third observation, at revision 4; that of every fifth stream is too young."""
    obs = view(spark, d, "obs")
    before = t.fuse(obs.where("observation_id % 3 > 0"), HOUR, ["view"], ["click"]).withColumn("revision", F.lit(4)).withColumn("created_ms", F.when(F.col("stream_id") % 5 == 0, 1000).otherwise(10))
    return t.fused_again(before, t.fuse(obs, HOUR, ["view"], ["click"]), 1000).select("stream_id", "start_ms", "changed", "revision", "reason_code")
