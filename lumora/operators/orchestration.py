"""Orchestration as analysis: graphs of tasks, readiness, cascades, leases and scheduling decisions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .helpers import first_failure

MAX_NODES = 128  # of one graph; bounds every walk over it
# States that end a task, a run, an operation.
CLOSED_TASKS = ("succeeded", "failed", "cancelled", "blocked")
CLOSED_RUNS = ("failed", "cancelled", "expired")
CLOSED_STAGES = ("succeeded", "failed", "cancelled")


def graph_errors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(run_id, reason) of each broken rule: duplicate node, unknown end, self edge, duplicate edge."""
    ids = nodes.select("run_id", "task_id")
    twice = ids.groupBy("run_id", "task_id").count().where("count > 1").select("run_id", F.lit("duplicate_node").alias("reason"))
    out = twice
    for end in ("parent_id", "child_id"):
        known = ids.withColumnRenamed("task_id", end)
        out = out.unionAll(edges.join(known, ["run_id", end], "left_anti").select("run_id", F.lit("unknown_" + end).alias("reason")))
    out = out.unionAll(edges.where("parent_id = child_id").select("run_id", F.lit("self_edge").alias("reason")))
    return out.unionAll(edges.groupBy("run_id", "parent_id", "child_id").count().where("count > 1").select("run_id", F.lit("duplicate_edge").alias("reason"))).distinct()


def walked(nodes: DataFrame, edges: DataFrame, max_nodes: int = MAX_NODES) -> DataFrame:
    """run_id, task_id, level (longest path from a root; null on or below a cycle), cycle (on one), below_failed (over required edges), reason_code.

    A valid graph has at most max_nodes tasks, so each is one small group. A larger one is not walked, whatever its size: its
    tasks have a reason and nulls, and the other graphs their results.
    """
    over = nodes.groupBy("run_id").agg((F.count(F.lit(1)) > max_nodes).alias("_over"))
    sized = nodes.select("run_id", "task_id", "state").join(over, "run_id")
    refused = sized.where("_over").select("run_id", "task_id", F.lit(None).cast("int").alias("level"), F.lit(None).cast("boolean").alias("cycle"), F.lit(None).cast("boolean").alias("below_failed"), F.lit("invalid_orchestration_node_count").alias("reason_code"))
    nodes = sized.where("NOT _over").drop("_over")
    edges = edges.join(over.where("_over"), "run_id", "left_anti")

    def walk(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        ids = nodes["task_id"].tolist()
        children: dict[int, list[tuple[int, bool]]] = {i: [] for i in ids}
        waits = dict.fromkeys(ids, 0)
        for parent, child, required in zip(edges["parent_id"].tolist(), edges["child_id"].tolist(), edges["required"].tolist()):
            if parent in waits and child in waits:
                children[parent].append((child, required))
                waits[child] += 1
        level = {i: 0 for i in ids if not waits[i]}
        queue, below = sorted(level), set()
        for i in queue:
            for child, _ in children[i]:
                level[child] = max(level.get(child, 0), level[i] + 1)
                waits[child] -= 1
                if not waits[child]:
                    queue.append(child)
        done = set(queue)

        def reach(start: list[int], required: bool) -> set[int]:
            seen, front = set(), list(start)
            while front:
                for child, need in children[front.pop()]:
                    if child not in seen and (need or not required):
                        seen.add(child)
                        front.append(child)
            return seen

        below = reach(nodes.loc[nodes["state"] == "failed", "task_id"].tolist(), True)
        return pd.DataFrame({"run_id": nodes["run_id"], "task_id": ids, "level": pd.array([level[i] if i in done else None for i in ids], "Int32"), "cycle": [i not in done and i in reach([i], False) for i in ids], "below_failed": [i in below for i in ids]})

    walked = nodes.groupBy("run_id").cogroup(edges.select("run_id", "parent_id", "child_id", "required").groupBy("run_id")).applyInPandas(walk, "run_id long, task_id long, level int, cycle boolean, below_failed boolean")
    return walked.withColumn("reason_code", F.lit(None).cast("string")).unionByName(refused)


def initial_states(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """ready without a required parent, else pending."""
    need = edges.where("required").groupBy("run_id", F.col("child_id").alias("task_id")).agg(F.count(F.lit(1)).alias("needs"))
    return nodes.join(need, ["run_id", "task_id"], "left").select("run_id", "task_id", F.coalesce("needs", F.lit(0)).alias("needs"), F.when(F.coalesce("needs", F.lit(0)) == 0, "ready").otherwise("pending").alias("initial_state"))


def unlocked(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """Pending tasks whose required parents have all succeeded."""
    parents = tasks.select("run_id", F.col("task_id").alias("parent_id"), F.col("state").alias("parent_state"))
    unmet = edges.where("required").join(parents, ["run_id", "parent_id"]).groupBy("run_id", F.col("child_id").alias("task_id")).agg(F.count_if(F.col("parent_state") != "succeeded").alias("unmet"))
    return tasks.where("state = 'pending'").join(unmet, ["run_id", "task_id"], "left").where("coalesce(unmet, 0) = 0").select("run_id", "task_id")


def blocked(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """Pending or ready tasks below a failed one, over required edges: blocked, upstream_failed."""
    below = walked(tasks, edges).where("below_failed").select("run_id", "task_id")
    return tasks.join(below, ["run_id", "task_id"], "left_semi").where("state IN ('pending', 'ready')").select("run_id", "task_id", F.lit("upstream_failed").alias("reason_code"))


def run_state(tasks: DataFrame) -> DataFrame:
    """One state for each run, from all its tasks, and a histogram of theirs."""
    s = F.col("state")
    return tasks.groupBy("run_id").agg(
        F.when(F.bool_or(s == "failed"), "failed").when(F.bool_and(s == "succeeded"), "succeeded").when(F.bool_or(s == "running"), "running").otherwise("pending").alias("run_state"),
        F.count(F.lit(1)).alias("tasks"), F.count_if(s == "succeeded").alias("succeeded"),
    )


def lease_recovery(tasks: DataFrame, as_of: int) -> DataFrame:
    """What becomes of running tasks whose lease is over or whose node is lost: output there, another attempt, or the end."""
    lost = (F.col("lease_until") <= as_of) | ~F.coalesce("node_ok", F.lit(False))
    return tasks.where((F.col("state") == "running") & lost).withColumn("next_state", F.when(F.col("has_output"), "succeeded").when(F.col("attempt") < F.col("max_attempts"), "ready").otherwise("failed"))


def _staircase(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """The nodes with more free memory than every node of a smaller id: whatever a task needs, the first node that has it is one of them."""
    before = F.max("free_memory").over(Window.partitionBy(*keys).orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1))
    return nodes.withColumn("_top", before).where("_top IS NULL OR free_memory > _top").select(*keys, "node_id", "free_memory")


def schedule(tasks: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each ready task the eligible node: with its cell first, then by id; a reason if there is none.

    A task is looked up in the staircase of its kind and cell and in that of its kind, so it never meets all nodes.
    """
    live = nodes.where("heartbeat_age_s <= 90").withColumnRenamed("node_cell", "cell")

    def first(keys: list[str], name: str) -> DataFrame:
        return tasks.join(_staircase(live, keys), keys).where("free_memory >= memory").groupBy("task_id").agg(F.min("node_id").alias(name))

    found = tasks.select("task_id").join(first(["kind", "cell"], "_near"), "task_id", "left").join(first(["kind"], "_far"), "task_id", "left")
    return found.select("task_id", F.coalesce("_near", "_far").alias("node_id")).withColumn("reason_code", F.when(F.col("node_id").isNull(), "no_eligible_node"))


def reconciled(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """The next state of each reported task: stale attempts first, then cancelled ones, then success, retry or exhaustion."""
    both = results.join(tasks, "task_id")
    return both.withColumn("next_state", F.when(F.col("reported_attempt") != F.col("attempt"), "stale_attempt").when(F.col("state") == "cancelled", "cancelled").when(F.col("ok"), "succeeded").when(F.col("attempt") < F.col("max_attempts"), "ready").otherwise("failed"))


def report_fence(reports: DataFrame, intents: DataFrame, operations: DataFrame, stages: DataFrame) -> DataFrame:
    """Each deployment report with why it is refused, or accepted, by the ledgers as they stood when it came.

    reports: report_id, at_ms, intent_id, node_id, operation_id, generation, release_id, runtime_id. intents: intent_id, operation_id,
    generation, release_id, runtime_id, action. operations, one row each: operation_id, node_id, deadline_ms. stages: operation_id, at_ms, stage.
    An intent takes one report: the first that passes the other checks, or the first that comes past the deadline, which ends
    it too; later ones are duplicates. The stage is the latest before the report; a stop may still end a
    cancelled operation.
    """
    own = reports.join(intents.select("intent_id", F.col("operation_id").alias("_operation"), F.col("generation").alias("_generation"), F.col("release_id").alias("_release"), F.col("runtime_id").alias("_runtime"), "action"), "intent_id")
    # as-of: an operation, its stages and the reports on it are one order of time, a stage before a report of its time; whole rows go along, so nothing is joined back
    every = Window.partitionBy("_operation")
    w = every.orderBy("at_ms", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    begun = operations.select(F.col("operation_id").alias("_operation"), F.col("node_id").alias("_node"), "deadline_ms", F.lit(0).alias("_kind"))
    told = stages.select(F.col("operation_id").alias("_operation"), "at_ms", F.lit(0).alias("_kind"), F.col("stage").alias("_stage"))
    rows = own.withColumn("_kind", F.lit(1)).unionByName(told, allowMissingColumns=True).unionByName(begun, allowMissingColumns=True)
    rows = rows.withColumns({"_stage": F.last("_stage", True).over(w), "_node": F.max("_node").over(every), "deadline_ms": F.max("deadline_ms").over(every)})
    own = rows.where("_kind = 1").drop("_kind")
    cleanup = (F.col("action") == "stop") & (F.col("_stage") == "cancelled")
    blank = lambda c: F.coalesce(c, F.lit(""))
    before = first_failure([(F.col("_node").isNull(), "deployment_operation_missing")])
    after = first_failure([
        (F.col("_stage").isin(*CLOSED_STAGES) & ~cleanup, "plugin_deployment_operation_already_closed"), (F.col("_node") != F.col("node_id"), "deployment_report_node_mismatch"),
        (F.col("operation_id") != F.col("_operation"), "stale_deployment_report"), (F.col("generation") != F.col("_generation"), "fencing_token_mismatch"),
        ((blank(F.col("release_id")) != blank(F.col("_release"))) | (blank(F.col("runtime_id")) != blank(F.col("_runtime"))), "stale_deployment_report"), (F.col("at_ms") > F.col("deadline_ms"), "operation_deadline_exceeded"),
    ])
    judged = own.withColumn("_own", F.coalesce(before, after, F.lit("accepted")))
    order = F.struct("at_ms", "report_id")
    ended = F.min(F.when(F.col("_own").isin("accepted", "operation_deadline_exceeded"), order)).over(Window.partitionBy("intent_id"))
    reason = F.when(before.isNotNull(), before).when(order > ended, "duplicate_deployment_report").otherwise(F.col("_own"))
    return judged.withColumn("_ended", ended).withColumn("reason_code", reason).drop("_operation", "_generation", "_release", "_runtime", "_node", "_stage", "_own", "_ended")


def cut_over(runtimes: DataFrame, pinned: DataFrame) -> DataFrame:
    """Compare-and-set on the generation: the swap is done where it holds and the candidate differs; an old runtime that is pinned stays active, others drain."""
    swaps = (F.col("generation") == F.col("expected_generation")) & ~F.col("active_id").eqNullSafe(F.col("candidate_id"))
    marked = runtimes.join(pinned.select(F.col("runtime_id").alias("active_id"), F.lit(True).alias("pinned")).distinct(), "active_id", "left")
    return marked.withColumn("swapped", swaps).withColumn("old_state", F.when(~F.col("swapped"), "unchanged").when(F.col("pinned"), "active").otherwise("draining"))


def gantt(tasks: DataFrame) -> DataFrame:
    """Per run: extent, and per task its offset and duration of one at least."""
    w = Window.partitionBy("run_id")
    start = F.min("start_ms").over(w)
    return tasks.select("run_id", "task_id", (F.col("start_ms") - start).alias("offset_ms"), F.greatest(F.lit(1), F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), F.greatest(F.lit(500), F.max("end_ms").over(w) - start).alias("span_ms"))


def execution_states(runs: DataFrame, tasks: DataFrame, enrichments: DataFrame) -> DataFrame:
    """The state that a run's execution shows, with the facts that it rests on.

    runs: run_id, state. tasks: run_id, state, required. enrichments: run_id, kind (vision or generic), state. cancelled and failed runs first;
    then all tasks ended and the required ones succeeded: waiting for enrichments is ready_for_review, else it
    succeeded, with partial enrichment if an optional task or an enrichment did not; anything else runs. A run without tasks has
    ended all of them. Vision enrichments wait until they succeeded or failed, generic ones while they are queued.
    """
    s = F.col("state")
    t = tasks.groupBy("run_id").agg(
        F.bool_and(s.isin(*CLOSED_TASKS)).alias("_ended"), F.coalesce(F.bool_and(F.when(F.col("required"), s == "succeeded")), F.lit(True)).alias("_required"),
        F.bool_or(~F.col("required") & (s != "succeeded")).alias("_optional"), F.count(F.lit(1)).alias("tasks"), F.count_if(s == "succeeded").alias("succeeded"),
    )
    waits = F.when(F.col("kind") == "vision", ~s.isin("succeeded", "failed")).otherwise(s == "queued")
    e = enrichments.groupBy("run_id").agg(F.bool_or(waits).alias("_waits"), F.bool_or(s == "failed").alias("_lost"), F.count(F.lit(1)).alias("enrichments"))
    at = runs.select("run_id", F.col("state").alias("_run")).join(t, "run_id", "left").join(e, "run_id", "left")
    at = at.na.fill({"_ended": True, "_required": True, "_optional": False, "_waits": False, "_lost": False, "tasks": 0, "succeeded": 0, "enrichments": 0})
    done = F.col("_ended") & F.col("_required")
    state = F.when(F.col("_run") == "cancelled", "cancelled").when(F.col("_run").isin("failed", "expired"), "failed").when(done & F.col("_waits"), "ready_for_review")
    state = state.when(done & (F.col("_optional") | F.col("_lost")), "succeeded_with_partial_enrichment").when(done, "succeeded").otherwise("running")
    out = at.withColumn("execution_state", state)
    return out.select("run_id", "execution_state", F.col("execution_state").isin("succeeded", "succeeded_with_partial_enrichment", "failed", "cancelled").alias("completed"), "tasks", "succeeded", "enrichments")


def cancelled(requests: DataFrame, runs: DataFrame, tasks: DataFrame, assignments: DataFrame, enrichments: DataFrame) -> DataFrame:
    """What a cancellation changes: kind, id, run_id, state and reason_code of each run, task, assignment and enrichment.

    requests: run_id, reason. A run that has failed, is cancelled or has expired stays as it is; so does one that succeeded unless an
    enrichment of it is still queued. Of the others open tasks, assignments that hold and queued enrichments are cancelled.
    """
    queued = enrichments.where("state = 'queued'").select("run_id").distinct().withColumn("_queued", F.lit(True))
    open_run = ~F.col("state").isin(*CLOSED_RUNS) & ((F.col("state") != "succeeded") | F.coalesce("_queued", F.lit(False)))
    hit = runs.join(requests.groupBy("run_id").agg(F.min("reason").alias("reason")), "run_id").join(queued, "run_id", "left").where(open_run)
    now = lambda rows, kind, id_column, where: rows.where(where).join(hit.select("run_id"), "run_id", "left_semi").select(F.lit(kind).alias("kind"), F.col(id_column).cast("string").alias("id"), "run_id", F.lit("cancelled").alias("state"), F.lit("run_cancelled").alias("reason_code"))
    run_rows = hit.select(F.lit("run").alias("kind"), F.col("run_id").cast("string").alias("id"), "run_id", F.lit("cancelled").alias("state"), F.col("reason").alias("reason_code"))
    closed = ", ".join(f"'{x}'" for x in CLOSED_TASKS)
    return run_rows.unionByName(now(tasks, "task", "task_id", f"state NOT IN ({closed})")).unionByName(now(assignments, "assignment", "assignment_id", "decision = 'assigned'")).unionByName(now(enrichments, "enrichment", "enrichment_id", "state = 'queued'"))


def placed(tasks: DataFrame, nodes: DataFrame, plugins: DataFrame) -> DataFrame:
    """Each ready task's node, or why it has none: node_id, decision (assigned, rejected, blocked), reason_code and where its data plane is.

    tasks: task_id, plugin_id, placement. nodes: node_id, is_co_located, status, heartbeat_age_s (null: none yet). plugins: node_id, plugin_id, state. Nodes
    that are ready and heard of within 90 s are candidates, co-located ones first, then by id. A node that lists ready plugins
    must have the task's; one that lists none takes any. data_plane_local asks for a co-located node; where there is none at
    all such a task is blocked. For each kind of node, those with lists are found by plugin and those without by their first id, so no
    task meets all nodes.
    """
    live = nodes.where((F.col("status") == "ready") & F.coalesce(F.col("heartbeat_age_s") < 90, F.lit(True))).select("node_id", "is_co_located")
    has = plugins.where("state = 'ready'").select("node_id", "plugin_id").distinct()
    first = F.min(F.struct((~F.col("is_co_located")).alias("far"), "node_id"))
    near = F.min(F.when(F.col("is_co_located"), F.col("node_id")))
    by_plugin = live.join(has, "node_id").groupBy("plugin_id").agg(first.alias("_listed"), near.alias("_listed_near"))
    # one row each on the driver: the first nodes without a list, and whether any node is co-located
    free = live.join(has.select("node_id").distinct(), "node_id", "left_anti").agg(first.alias("first"), near.alias("near")).first()
    any_near = bool(live.agg(F.bool_or("is_co_located")).first()[0])
    of = live.schema["node_id"].dataType
    without = F.struct(F.lit(free["first"]["far"]).alias("far"), F.lit(free["first"]["node_id"]).cast(of).alias("node_id")) if free["first"] else F.lit(None)
    at = tasks.join(by_plugin, "plugin_id", "left")
    local = F.coalesce("placement", F.lit("data_plane_local")) == "data_plane_local"
    best = F.least("_listed", without) if free["first"] else F.col("_listed")
    node = F.when(local, F.least(F.col("_listed_near"), F.lit(free["near"]).cast(of))).otherwise(best["node_id"])
    co_located = F.when(local, True).otherwise(~best["far"])
    at = at.withColumn("node_id", node).withColumn("_near", co_located)
    reason = F.when(F.col("node_id").isNotNull(), "").when(local, "data_locality_violation").otherwise("no_eligible_node")
    decision = F.when(F.col("node_id").isNotNull(), "assigned").when(local & ~F.lit(any_near), "blocked").otherwise("rejected")
    return at.select("task_id", "node_id", decision.alias("decision"), reason.alias("reason_code"), F.when(F.col("node_id").isNotNull(), F.when(F.col("_near"), "local-data-plane").otherwise("remote")).alias("data_plane"))
