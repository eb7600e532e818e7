"""Queries over task graphs, leases and measurements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import observability as b
from ..operators import orchestration as o
from .fixtures import view
from .registry import query


def _graph(spark, d):
    return view(spark, d, "task"), view(spark, d, "edge")


@query("""SELECT DISTINCT run_id, reason FROM (SELECT run_id, 'unknown_child_id' AS reason FROM edge WHERE child_id % 10 = 9 UNION ALL SELECT run_id, 'unknown_parent_id' FROM edge WHERE parent_id % 10 = 9
    UNION ALL SELECT run_id, 'self_edge' FROM edge WHERE parent_id = child_id)""")
def o1_graph_errors(spark, d):
    task, edge = _graph(spark, d)
    return o.graph_errors(task.where("task_id % 10 <> 9"), edge)


@query("""WITH RECURSIVE walk AS (SELECT run_id, task_id, 0 AS level FROM task t WHERE NOT EXISTS (SELECT 1 FROM edge WHERE child_id = t.task_id)
    UNION ALL SELECT w.run_id, e.child_id, w.level + 1 FROM walk w JOIN edge e ON e.parent_id = w.task_id) SELECT run_id, task_id, max(level) AS level FROM walk GROUP BY ALL""")
def o2_topological_levels(spark, d):
    return o.walked(*_graph(spark, d)).select("run_id", "task_id", "level")


@query("""SELECT run_id, child_id AS task_id FROM edge WHERE parent_id % 10 = 0 AND child_id % 10 = 3 AND run_id % 2 = 0 UNION SELECT run_id, parent_id FROM edge WHERE parent_id % 10 = 0 AND child_id % 10 = 3 AND run_id % 2 = 0
    UNION SELECT run_id, task_id FROM task WHERE run_id % 2 = 0 AND task_id % 10 IN (1, 2)""")
def o3_cycle_detection(spark, d):
    task, edge = _graph(spark, d)
    back = edge.where("parent_id % 10 = 0 AND child_id % 10 = 3 AND run_id % 2 = 0").select("run_id", F.col("child_id").alias("parent_id"), F.col("parent_id").alias("child_id"), "required")
    return o.walked(task, edge.unionByName(back)).where("cycle").select("run_id", "task_id")


@query("SELECT t.run_id, t.task_id, count(e.required) AS needs, CASE WHEN count(e.required) = 0 THEN 'ready' ELSE 'pending' END AS initial_state FROM task t LEFT JOIN edge e ON e.child_id = t.task_id AND e.required GROUP BY ALL")
def o5_initial_states(spark, d):
    return o.initial_states(*_graph(spark, d))


@query("SELECT run_id, task_id FROM task t WHERE state = 'pending' AND NOT EXISTS (SELECT 1 FROM edge e JOIN task p ON p.task_id = e.parent_id WHERE e.child_id = t.task_id AND e.required AND p.state <> 'succeeded')")
def o7_j14_unlocked(spark, d):
    return o.unlocked(*_graph(spark, d))


@query("""WITH RECURSIVE below AS (SELECT e.run_id, e.child_id AS task_id FROM task t JOIN edge e ON e.parent_id = t.task_id WHERE t.state = 'failed' AND e.required
    UNION SELECT e.run_id, e.child_id FROM below b JOIN edge e ON e.parent_id = b.task_id WHERE e.required)
    SELECT t.run_id, t.task_id, 'upstream_failed' AS reason_code FROM task t WHERE state IN ('pending', 'ready') AND task_id IN (SELECT task_id FROM below)""")
def o8_u1_cascade_block(spark, d):
    return o.blocked(*_graph(spark, d))


@query("""SELECT run_id, CASE WHEN bool_or(state = 'failed') THEN 'failed' WHEN bool_and(state = 'succeeded') THEN 'succeeded' WHEN bool_or(state = 'running') THEN 'running' ELSE 'pending' END AS run_state,
    count(*) AS tasks, count_if(state = 'succeeded') AS succeeded FROM task GROUP BY run_id""")
def o13_a8_run_state(spark, d):
    return o.run_state(view(spark, d, "task"))


@query("SELECT run_id, state, count(*) AS n FROM task GROUP BY ALL")
def a6_a7_state_histogram(spark, d):
    return view(spark, d, "task").groupBy("run_id", "state").agg(F.count("*").alias("n"))


@query("""SELECT task_id, CASE WHEN task_id % 4 = 0 THEN 'succeeded' WHEN attempt < max_attempts THEN 'ready' ELSE 'failed' END AS next_state FROM task LEFT JOIN nation n ON n.n_nationkey = cell AND cell % 3 > 0
    WHERE state = 'running' AND (memory <= 3000 OR n_nationkey IS NULL)""")
def o11_j15_lease_recovery(spark, d):
    node = spark.read.parquet(f"{d}/nation.parquet").where("n_nationkey % 3 > 0").select(F.col("n_nationkey").alias("cell"), F.lit(True).alias("node_ok"))
    tasks = view(spark, d, "task").join(node, "cell", "left").withColumn("lease_until", F.col("memory")).withColumn("has_output", F.expr("task_id % 4 = 0"))
    return o.lease_recovery(tasks, 3000).select("task_id", "next_state")


@query("""WITH node AS (SELECT c_custkey AS node_id, c_nationkey AS node_cell, c_custkey % 5 AS kind, c_acctbal AS free_memory, c_custkey % 120 AS age FROM customer), ready AS (SELECT task_id, cell, task_id % 5 AS kind, memory FROM task WHERE state <> 'failed'),
    fit AS (SELECT task_id, node_id, row_number() OVER (PARTITION BY task_id ORDER BY (cell = node_cell) DESC, node_id) AS rn FROM ready JOIN node USING (kind) WHERE free_memory >= memory AND age <= 90)
    SELECT r.task_id, f.node_id, CASE WHEN f.node_id IS NULL THEN 'no_eligible_node' END AS reason_code FROM ready r LEFT JOIN fit f ON f.task_id = r.task_id AND rn = 1""")
def o9_j16_l6_schedule(spark, d):
    node = spark.read.parquet(f"{d}/customer.parquet").selectExpr("c_custkey AS node_id", "c_nationkey AS node_cell", "c_custkey % 5 AS kind", "c_acctbal AS free_memory", "c_custkey % 120 AS heartbeat_age_s")
    ready = view(spark, d, "task").where("state <> 'failed'").selectExpr("task_id", "cell", "task_id % 5 AS kind", "memory")
    return o.schedule(ready, node)


@query("""SELECT task_id, CASE WHEN task_id % 3 <> attempt THEN 'stale_attempt' WHEN task_id % 7 = 0 THEN 'cancelled' WHEN task_id % 2 = 0 THEN 'succeeded' WHEN attempt < max_attempts THEN 'ready' ELSE 'failed' END AS next_state FROM task""")
def o10_o12_reconcile(spark, d):
    tasks = view(spark, d, "task").withColumn("state", F.when(F.expr("task_id % 7 = 0"), "cancelled").otherwise(F.col("state")))
    results = tasks.selectExpr("task_id", "task_id % 3 AS reported_attempt", "task_id % 2 = 0 AS ok")
    return o.reconciled(tasks, results).select("task_id", "next_state")


REPORT = """rep AS (SELECT unit_id * 100 + revision AS report_id, created_ms AS at_ms, unit_id AS intent_id, CASE WHEN part_id % 31 = 0 THEN -1 ELSE unit_id % 7 END AS node_id, CASE WHEN part_id % 37 = 0 THEN -1 ELSE unit_id END AS operation_id,
        CASE WHEN supplier_id % 29 = 0 THEN 0 ELSE 3 END AS generation, CASE WHEN part_id % 41 = 0 THEN 'old' ELSE '' END AS release_id, CASE WHEN part_id % 43 = 0 THEN 'r0' ELSE 'r1' END AS runtime_id FROM material),
    op AS (SELECT o_orderkey AS operation_id, o_orderkey % 7 AS node_id, CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE MILLIS(o_orderdate) + 5184000000 END AS deadline_ms, CASE WHEN o_orderkey % 13 = 0 THEN 'stop' ELSE 'stage_release' END AS action,
        MILLIS(o_orderdate) + (o_orderkey % 90) * 86400000::BIGINT AS closes_ms, CASE o_orderkey % 3 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'cancelled' ELSE 'staging' END AS last_stage FROM orders WHERE o_orderkey % 17 > 0)"""


@query(f"""WITH {REPORT}, j AS (SELECT r.*, o.operation_id AS op_id, CASE WHEN o.operation_id IS NULL THEN 'deployment_operation_missing' END AS first_code,
        CASE WHEN last_stage <> 'staging' AND closes_ms <= at_ms AND NOT (action = 'stop' AND last_stage = 'cancelled') THEN 'plugin_deployment_operation_already_closed' WHEN r.node_id <> o.node_id THEN 'deployment_report_node_mismatch'
        WHEN r.operation_id <> r.intent_id THEN 'stale_deployment_report' WHEN generation <> 3 THEN 'fencing_token_mismatch' WHEN release_id <> '' OR runtime_id <> 'r1' THEN 'stale_deployment_report' WHEN at_ms > deadline_ms THEN 'operation_deadline_exceeded' ELSE 'accepted' END AS own
        FROM rep r LEFT JOIN op o ON o.operation_id = r.intent_id)
    SELECT report_id, coalesce(first_code, CASE WHEN EXISTS (SELECT 1 FROM j b WHERE b.intent_id = j.intent_id AND b.own IN ('accepted', 'operation_deadline_exceeded') AND (b.at_ms < j.at_ms OR (b.at_ms = j.at_ms AND b.report_id < j.report_id))) THEN 'duplicate_deployment_report' END, own) AS reason_code FROM j""")
def o20_report_fence(spark, d):
    reports = view(spark, d, "material").selectExpr(
        "unit_id * 100 + revision AS report_id", "created_ms AS at_ms", "unit_id AS intent_id", "CASE WHEN part_id % 31 = 0 THEN -1 ELSE unit_id % 7 END AS node_id", "CASE WHEN part_id % 37 = 0 THEN -1 ELSE unit_id END AS operation_id",
        "CASE WHEN supplier_id % 29 = 0 THEN 0 ELSE 3 END AS generation", "CASE WHEN part_id % 41 = 0 THEN 'old' ELSE NULL END AS release_id", "CASE WHEN part_id % 43 = 0 THEN 'r0' ELSE 'r1' END AS runtime_id",
    )
    orders = spark.read.parquet(f"{d}/orders.parquet").withColumn("ms", F.expr("unix_millis(CAST(o_orderdate AS TIMESTAMP))"))
    intents = orders.selectExpr("o_orderkey AS intent_id", "o_orderkey AS operation_id", "3 AS generation", "CAST(NULL AS STRING) AS release_id", "'r1' AS runtime_id", "CASE WHEN o_orderkey % 13 = 0 THEN 'stop' ELSE 'stage_release' END AS action")
    kept = orders.where("o_orderkey % 17 > 0")
    operations = kept.selectExpr("o_orderkey AS operation_id", "o_orderkey % 7 AS node_id", "CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE ms + 60 * 86400000L END AS deadline_ms")
    begun = kept.selectExpr("o_orderkey AS operation_id", "ms - 1 AS at_ms", "'staging' AS stage")
    ended = kept.where("o_orderkey % 3 < 2").selectExpr("o_orderkey AS operation_id", "ms + (o_orderkey % 90) * 86400000L AS at_ms", "CASE o_orderkey % 3 WHEN 0 THEN 'succeeded' ELSE 'cancelled' END AS stage")
    return o.report_fence(reports, intents, operations, begun.unionByName(ended)).select("report_id", "reason_code")


@query("""SELECT task_id, attempt = 1 AND cell IS DISTINCT FROM node_id AS swapped, CASE WHEN NOT (attempt = 1 AND cell IS DISTINCT FROM node_id) THEN 'unchanged' WHEN cell % 4 = 0 THEN 'active' ELSE 'draining' END AS old_state FROM task""")
def o23_cut_over(spark, d):
    runtimes = view(spark, d, "task").selectExpr("task_id", "attempt AS generation", "1 AS expected_generation", "cell AS active_id", "node_id AS candidate_id")
    pinned = view(spark, d, "task").where("cell % 4 = 0").select(F.col("cell").alias("runtime_id"))
    return o.cut_over(runtimes, pinned).select("task_id", "swapped", "old_state")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('MACHINERY', 'HOUSEHOLD') AND c_custkey <> 7")
def o21_stale_nodes(spark, d):
    return spark.read.parquet(f"{d}/customer.parquet").where(F.col("c_mktsegment").isin("MACHINERY", "HOUSEHOLD") & (F.col("c_custkey") != 7)).select("c_custkey")


@query("""SELECT stream_id AS run_id, observation_id AS task_id, start_ms - min(start_ms) OVER w AS offset_ms, greatest(1, end_ms - start_ms) AS duration_ms, greatest(500, max(end_ms) OVER w - min(start_ms) OVER w) AS span_ms FROM obs WINDOW w AS (PARTITION BY stream_id)""")
def a29_gantt(spark, d):
    return o.gantt(view(spark, d, "obs").selectExpr("stream_id AS run_id", "observation_id AS task_id", "start_ms", "end_ms"))


@query("""SELECT modality, le, sum(CASE WHEN value / 100 <= bound THEN 1 ELSE 0 END) AS n, count(*) AS count, round(sum(value / 100), 4) AS sum FROM obs, (VALUES ('0.005', 0.005), ('0.01', 0.01), ('0.025', 0.025), ('0.05', 0.05), ('0.1', 0.1), ('0.25', 0.25), ('0.5', 0.5), ('1.0', 1.0), ('2.5', 2.5), ('5.0', 5.0), ('10.0', 10.0), ('+Inf', 1e300)) AS t(le, bound) GROUP BY ALL""")
def a21_histogram(spark, d):
    return b.histogram(view(spark, d, "obs").selectExpr("modality", "value / 100 AS seconds"), ["modality"], "seconds").withColumn("sum", F.round("sum", 4))


@query("SELECT event_type, round(sum(value), 2) AS counter, arg_max(value, event_id) AS gauge FROM events GROUP BY 1")
def a22_counter_gauge(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").groupBy("event_type").agg(F.round(F.sum("value"), 2).alias("counter"), F.max_by("value", "event_id").alias("gauge"))


@query("""SELECT stream_id AS trace_id, observation_id AS span_id, start_ms - min(start_ms) OVER w AS offset_ms, round(100.0 * (end_ms - start_ms) / nullif(max(end_ms) OVER w - min(start_ms) OVER w, 0), 6) AS percent,
    row_number() OVER (PARTITION BY stream_id ORDER BY end_ms - start_ms DESC, start_ms, observation_id) = 1 AS bottleneck FROM obs WINDOW w AS (PARTITION BY stream_id)""")
def a23_w13_waterfall(spark, d):
    return b.waterfall(view(spark, d, "obs").selectExpr("stream_id AS trace_id", "observation_id AS span_id", "start_ms", "end_ms")).withColumn("percent", F.round("percent", 6))


RUNS = """r AS (SELECT o_orderkey AS run_id, CASE o_orderkey % 10 WHEN 0 THEN 'cancelled' WHEN 1 THEN 'failed' WHEN 2 THEN 'expired' WHEN 3 THEN 'succeeded' ELSE 'running' END AS state FROM orders),
    t AS (SELECT unit_id AS run_id, revision AS task_id, CASE WHEN unit_id % 4 = 0 THEN 'succeeded' WHEN part_id % 7 = 0 THEN 'running' WHEN part_id % 11 = 0 THEN 'failed' WHEN part_id % 13 = 0 THEN 'blocked' ELSE 'succeeded' END AS state, revision % 3 > 0 AS required FROM material),
    e AS (SELECT unit_id AS run_id, revision AS n, CASE WHEN revision % 2 = 0 THEN 'vision' ELSE 'generic' END AS kind, CASE part_id % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'failed' WHEN 2 THEN 'running' ELSE 'succeeded' END AS state FROM material WHERE supplier_id % 3 = 0)"""


def _runs(spark, d):
    m = view(spark, d, "material")
    runs = spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey AS run_id", "CASE o_orderkey % 10 WHEN 0 THEN 'cancelled' WHEN 1 THEN 'failed' WHEN 2 THEN 'expired' WHEN 3 THEN 'succeeded' ELSE 'running' END AS state")
    state = "CASE WHEN unit_id % 4 = 0 THEN 'succeeded' WHEN part_id % 7 = 0 THEN 'running' WHEN part_id % 11 = 0 THEN 'failed' WHEN part_id % 13 = 0 THEN 'blocked' ELSE 'succeeded' END AS state"
    tasks = m.selectExpr("unit_id AS run_id", "revision AS task_id", state, "revision % 3 > 0 AS required")
    enrichments = m.where("supplier_id % 3 = 0").selectExpr("unit_id AS run_id", "revision AS enrichment_id", "CASE WHEN revision % 2 = 0 THEN 'vision' ELSE 'generic' END AS kind", "CASE part_id % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'failed' WHEN 2 THEN 'running' ELSE 'succeeded' END AS state")
    return runs, tasks, enrichments


@query(f"""WITH {RUNS}, f AS (SELECT r.run_id, r.state, NOT EXISTS (SELECT 1 FROM t WHERE t.run_id = r.run_id AND t.state = 'running') AND NOT EXISTS (SELECT 1 FROM t WHERE t.run_id = r.run_id AND required AND t.state <> 'succeeded') AS done,
        EXISTS (SELECT 1 FROM t WHERE t.run_id = r.run_id AND NOT required AND t.state <> 'succeeded') OR EXISTS (SELECT 1 FROM e WHERE e.run_id = r.run_id AND e.state = 'failed') AS partly,
        EXISTS (SELECT 1 FROM e WHERE e.run_id = r.run_id AND (e.state = 'queued' OR (kind = 'vision' AND e.state = 'running'))) AS waits, (SELECT count(*) FROM t WHERE t.run_id = r.run_id) AS tasks, (SELECT count(*) FROM t WHERE t.run_id = r.run_id AND t.state = 'succeeded') AS succeeded,
        (SELECT count(*) FROM e WHERE e.run_id = r.run_id) AS enrichments FROM r),
    s AS (SELECT *, CASE WHEN state = 'cancelled' THEN 'cancelled' WHEN state IN ('failed', 'expired') THEN 'failed' WHEN done AND waits THEN 'ready_for_review' WHEN done AND partly THEN 'succeeded_with_partial_enrichment' WHEN done THEN 'succeeded' ELSE 'running' END AS execution_state FROM f)
    SELECT run_id, execution_state, execution_state NOT IN ('ready_for_review', 'running') AS completed, tasks, succeeded, enrichments FROM s""")
def o13_execution_states(spark, d):
    return o.execution_states(*_runs(spark, d))


@query(f"""WITH {RUNS}, hit AS (SELECT run_id FROM r WHERE run_id % 6 < 4 AND (state = 'running' OR (state = 'succeeded' AND EXISTS (SELECT 1 FROM e WHERE e.run_id = r.run_id AND e.state = 'queued'))))
    SELECT 'run' AS kind, CAST(run_id AS VARCHAR) AS id, run_id, 'cancelled' AS state, 'user' AS reason_code FROM hit UNION ALL SELECT 'task', CAST(task_id AS VARCHAR), run_id, 'cancelled', 'run_cancelled' FROM t JOIN hit USING (run_id) WHERE state = 'running'
    UNION ALL SELECT 'assignment', CAST(task_id AS VARCHAR), run_id, 'cancelled', 'run_cancelled' FROM t JOIN hit USING (run_id) WHERE state <> 'succeeded' UNION ALL SELECT 'enrichment', CAST(n AS VARCHAR), run_id, 'cancelled', 'run_cancelled' FROM e JOIN hit USING (run_id) WHERE state = 'queued'""")
def o12_cancelled(spark, d):
    runs, tasks, enrichments = _runs(spark, d)
    requests = runs.where("run_id % 6 < 4").select("run_id", F.lit("user").alias("reason"))
    assignments = tasks.select("run_id", F.col("task_id").alias("assignment_id"), F.when(F.col("state") != "succeeded", "assigned").otherwise("done").alias("decision"))
    return o.cancelled(requests.unionAll(requests), runs, tasks, assignments, enrichments)


@query("""WITH n AS (SELECT c_custkey AS node_id, c_custkey % 50 = 7 AS near, c_custkey % 4 > 0 AND (c_custkey % 9 = 0 OR c_custkey % 100 < 90) AS live, c_custkey % 6 > 1 AS listed, c_nationkey AS plugin FROM customer),
    k AS (SELECT p_partkey AS task_id, p_partkey % 40 AS plugin, p_partkey % 3 > 0 AS local FROM part),
    f AS (SELECT k.task_id, k.local, (SELECT min_by(n.node_id, CASE WHEN near THEN 0 ELSE 1000000000 END + n.node_id) FROM n WHERE live AND (near OR NOT k.local) AND (NOT listed OR n.plugin = k.plugin)) AS node_id FROM k)
    SELECT task_id, f.node_id, CASE WHEN f.node_id IS NOT NULL THEN 'assigned' ELSE 'rejected' END AS decision, CASE WHEN f.node_id IS NOT NULL THEN '' WHEN local THEN 'data_locality_violation' ELSE 'no_eligible_node' END AS reason_code,
    CASE WHEN near THEN 'local-data-plane' WHEN f.node_id IS NOT NULL THEN 'remote' END AS data_plane FROM f LEFT JOIN n ON n.node_id = f.node_id""")
def o9_placed(spark, d):
    nodes = spark.read.parquet(f"{d}/customer.parquet").selectExpr("c_custkey AS node_id", "c_custkey % 50 = 7 AS is_co_located", "CASE WHEN c_custkey % 4 > 0 THEN 'ready' ELSE 'offline' END AS status", "CASE WHEN c_custkey % 9 > 0 THEN c_custkey % 100 END AS heartbeat_age_s")
    plugins = spark.read.parquet(f"{d}/customer.parquet").where("c_custkey % 6 > 1").selectExpr("c_custkey AS node_id", "c_nationkey AS plugin_id", "'ready' AS state")
    tasks = spark.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey AS task_id", "CAST(p_partkey % 40 AS INT) AS plugin_id", "CASE WHEN p_partkey % 3 > 0 THEN 'data_plane_local' ELSE 'object_ref_allowed' END AS placement")
    return o.placed(tasks, nodes, plugins)


@query("""WITH RECURSIVE a AS (SELECT stream_id, modality AS op, start_ms, end_ms, quality_state IN ('final', 'accepted') AS ok, quality_state NOT IN ('rejected', 'conflict') AS can, quality_state AS reason, row_number() OVER (PARTITION BY stream_id, modality ORDER BY start_ms, end_ms) AS n, lead(start_ms) OVER (PARTITION BY stream_id, modality ORDER BY start_ms, end_ms) IS NOT NULL AS followed FROM obs),
    c AS (SELECT *, 1 AS try, ok OR NOT can OR NOT followed AS ends FROM a WHERE n = 1 UNION ALL SELECT a.*, CASE WHEN c.ends THEN 1 ELSE c.try + 1 END, a.ok OR NOT a.can OR NOT a.followed OR (CASE WHEN c.ends THEN 1 ELSE c.try + 1 END) = 3 FROM c JOIN a ON a.stream_id = c.stream_id AND a.op = c.op AND a.n = c.n + 1),
    p AS (SELECT stream_id, start_ms AS t, 1 AS d FROM obs UNION ALL SELECT stream_id, end_ms, -1 FROM obs), w AS (SELECT stream_id, max(open) AS peak FROM (SELECT stream_id, sum(d) OVER (PARTITION BY stream_id ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS open FROM p) GROUP BY 1),
    h AS (SELECT stream_id, string_agg(reason || '=' || n, ',' ORDER BY reason || '=' || n) AS told FROM (SELECT stream_id, reason, count(*) AS n FROM c WHERE NOT ends GROUP BY ALL) GROUP BY 1)
    SELECT c.stream_id, count_if(ends)::BIGINT AS submitted, count(*) AS attempts, count_if(NOT ends)::BIGINT AS retries, count_if(ends AND ok)::BIGINT AS completed, count_if(ends AND NOT ok)::BIGINT AS failed, count_if(ends AND NOT ok AND can AND try = 3)::BIGINT AS exhausted,
    coalesce(any_value(told), '') AS throttle_events, any_value(peak)::BIGINT AS peak_in_flight FROM c JOIN w USING (stream_id) LEFT JOIN h ON h.stream_id = c.stream_id GROUP BY c.stream_id""")
def a31_in_flight(spark, d):
    q = F.col("quality_state")
    attempts = view(spark, d, "obs").select("stream_id", F.col("modality").alias("operation_id"), "start_ms", "end_ms", q.isin("final", "accepted").alias("ok"), (~q.isin("rejected", "conflict")).alias("retryable"), q.alias("reason_code"))
    return b.in_flight_report(attempts, ["stream_id"], 3)


@query("""WITH p AS (SELECT stream_id, start_ms AS t, 1 AS d FROM obs UNION ALL SELECT stream_id, end_ms, -1 FROM obs), r AS (SELECT stream_id, sum(d) OVER (PARTITION BY stream_id ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS open FROM p)
    SELECT stream_id, CAST(max(open) AS BIGINT) AS peak FROM r GROUP BY 1""")
def a31_peak_concurrency(spark, d):
    return b.peak_concurrency(view(spark, d, "obs"), ["stream_id"])


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS price_sum, max(o_totalprice) AS price_max, sum(o_custkey) AS cust_sum, max(o_custkey) AS cust_max FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY ALL""")
def a9_deployment_metrics(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").where("o_orderdate >= TIMESTAMP '1995-01-01'").withColumnsRenamed({"o_totalprice": "price", "o_custkey": "cust"})
    return b.phase_metrics(rows, ["o_orderstatus", "o_orderpriority"], ["price", "cust"]).withColumn("price_sum", F.round("price_sum", 2))


@query("SELECT modality, count(*) AS total, count_if(quality_state IN ('final', 'accepted')) / count(*) AS success_rate, count_if(quality_state = 'failed') AS failed, count_if(quality_state = 'rejected') AS rejected FROM obs GROUP BY 1")
def a10_dashboard(spark, d):
    q = F.col("quality_state")
    return view(spark, d, "obs").groupBy("modality").agg(F.count("*").alias("total"), (F.count_if(q.isin("final", "accepted")) / F.count("*")).alias("success_rate"), F.count_if(q == "failed").alias("failed"), F.count_if(q == "rejected").alias("rejected"))


@query("SELECT observation_id, count(*) OVER w AS in_window, count(*) OVER w > 2 AS blocked FROM obs WHERE modality = 'error' WINDOW w AS (PARTITION BY stream_id ORDER BY start_ms RANGE BETWEEN 599999 PRECEDING AND CURRENT ROW)")
def a30_login_windows(spark, d):
    rows = view(spark, d, "obs").where("modality = 'error'").withColumn("at_ms", F.col("start_ms"))
    return b.failure_windows(rows, ["stream_id"], 600_000, 2).select("observation_id", "in_window", "blocked")


@query("SELECT run_id, sum(CASE WHEN node_id <> 3 THEN memory ELSE 0 END) AS declared FROM task GROUP BY 1")
def a25_j17_declared_memory(spark, d):
    return view(spark, d, "task").groupBy("run_id").agg(F.sum(F.when(F.col("node_id") != 3, F.col("memory")).otherwise(0)).alias("declared"))


@query("SELECT 'events_total{type=\"' || event_type || '\"} ' || count(*) AS line, event_type AS label, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY event_type")
def s16_prometheus_text(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").groupBy(F.col("event_type").alias("type")).agg(F.count("*").alias("n"))
    lines = rows.select(b.prometheus(rows, "events_total", ["type"], "n").alias("line"))
    p = b.parsed_prometheus("line")
    return lines.select("line", p["label"].alias("label"), p["value"].alias("value"))
