"""Queries over the outbox, deliveries, embeddings and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger as g
from ..operators import vectors as v
from .fixtures import view
from .registry import query

AS_OF = 1_706_000_000_000


@query("SELECT event_id, created_ms FROM outbox WHERE published_ms IS NULL ORDER BY created_ms, event_id LIMIT 50")
def s9_l5_claim(spark, d):
    return g.claim(view(spark, d, "outbox"), 50).select("event_id", "created_ms")


@query(f"SELECT event_id, CAST({AS_OF + 30000} AS BIGINT) AS claim_until_ms FROM outbox WHERE published_ms IS NULL AND (event_id % 3 = 0 OR created_ms + 60000 * (event_id % 100) <= {AS_OF}) ORDER BY created_ms, event_id LIMIT 40")
def t29_claim_with_lease(spark, d):
    rows = view(spark, d, "outbox").withColumn("claim_until_ms", F.expr("CASE WHEN event_id % 3 = 0 THEN NULL ELSE created_ms + 60000 * (event_id % 100) END"))
    return g.claim_with_lease(rows, AS_OF, 30_000, 40).select("event_id", F.col("claim_until_ms").cast("long").alias("claim_until_ms"))


@query("""WITH x AS (SELECT *, CASE WHEN length(event_type) > 160 THEN 'event_type_too_long' WHEN NOT regexp_matches(event_type, '^[a-z][a-z0-9_.]*$') THEN 'event_type_invalid'
    WHEN envelope_id <> event_id THEN 'envelope_id_mismatch' WHEN attempt >= 3 THEN 'attempts_exhausted' END AS reason_code FROM outbox)
    SELECT coalesce(reason_code, 'none') AS reason_code, CASE WHEN reason_code IS NULL THEN 'publish' ELSE 'reject' END AS action, count(*) AS n FROM x GROUP BY ALL""")
def t20_f15_f16_relay_split(spark, d):
    return g.relay_split(view(spark, d, "outbox")).groupBy(F.coalesce("reason_code", F.lit("none")).alias("reason_code"), "action").agg(F.count("*").alias("n"))


@query(f"SELECT event_id, CASE WHEN published_ms IS NOT NULL AND published_ms < {AS_OF} - 7 * 86400000 THEN 'archived' ELSE 'kept' END AS side FROM outbox")
def s15_archive_split(spark, d):
    kept, archived = g.archive_split(view(spark, d, "outbox"), AS_OF, 7)
    return kept.select("event_id", F.lit("kept").alias("side")).unionAll(archived.select("event_id", F.lit("archived").alias("side")))


@query(f"SELECT count(*) AS pending, ({AS_OF} - min(created_ms)) / 1000 AS oldest_age_s, max(attempt) AS max_attempt FROM outbox WHERE published_ms IS NULL")
def a11_pending_stats(spark, d):
    return g.pending_stats(view(spark, d, "outbox"), AS_OF)


@query("SELECT DISTINCT event_id % 6000 AS event_id FROM outbox WHERE event_id % 6000 NOT IN (SELECT event_id FROM outbox WHERE event_id % 2 = 0)")
def t19_event_dedup(spark, d):
    rows = view(spark, d, "outbox")
    consumed = rows.where("event_id % 2 = 0").select("event_id", F.lit("index").alias("consumer")).unionAll(rows.select("event_id", F.lit("other").alias("consumer")))
    return g.unseen(rows.select((F.col("event_id") % 6000).alias("event_id")), consumed, "index")


@query("""WITH u AS (SELECT unit_id, revision, status, max(revision) OVER (PARTITION BY unit_id) AS newest FROM material),
    x AS (SELECT e.embedding_id, CASE WHEN state <> 'tombstoned' AND status IS NULL THEN 'orphaned' WHEN state <> 'tombstoned' AND status = 'failed' THEN 'material_failed'
    WHEN state <> 'tombstoned' AND e.revision < newest THEN 'superseded' WHEN state = 'tombstoned' AND vector_ref IS NOT NULL THEN 'pending_vector_purge'
    WHEN state = 'pending' AND updated_ms < 300000 THEN 'stale' END AS reason FROM embedding e LEFT JOIN u ON u.unit_id = e.unit_id AND u.revision = e.revision)
    SELECT * FROM x WHERE reason IS NOT NULL""")
def t23_j4_reconcile(spark, d):
    return g.reconcile(view(spark, d, "embedding"), view(spark, d, "material"), 400_000, 100_000).select("embedding_id", "reason")


@query("SELECT embedding_id, CASE WHEN unit_id % 9 = 0 AND state <> 'tombstoned' THEN 'tombstoned' ELSE state END AS state, CASE WHEN unit_id % 9 = 0 AND state <> 'tombstoned' THEN 777 ELSE updated_ms END AS updated_ms FROM embedding")
def t24_tombstone(spark, d):
    rows = view(spark, d, "embedding")
    return g.tombstoned(rows, rows.where("unit_id % 9 = 0"), 777).select("embedding_id", "state", F.col("updated_ms").cast("long").alias("updated_ms"))


@query("SELECT vec_id % 300 AS embedding_id, max(vec_id) AS version, count(*) - 1 AS overwritten FROM embeddings GROUP BY 1")
def s12_s13_vector_upsert(spark, d):
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select((F.col("vec_id") % 300).alias("embedding_id"), F.col("vec_id").alias("version"))
    last = g.upserted(rows.where("version < 300"), rows.where("version >= 300"), "embedding_id", [F.desc("version")])
    n = rows.groupBy("embedding_id").agg((F.count("*") - 1).alias("overwritten"))
    return last.join(n, "embedding_id")


@query("""SELECT embedding_id, e.unit_id, e.revision < newest AS superseded FROM embedding e JOIN (SELECT *, max(revision) OVER (PARTITION BY unit_id) AS newest FROM material) m ON m.unit_id = e.unit_id AND m.revision = e.revision
    JOIN stream USING (stream_id) JOIN source USING (source_id) WHERE state = 'ready' AND status <> 'failed' AND owner = 'ASIA'""")
def j5_ready_resolve(spark, d):
    return g.ready_embeddings(view(spark, d, "embedding"), view(spark, d, "material"), view(spark, d, "stream"), view(spark, d, "source"), "ASIA").select("embedding_id", "unit_id", "superseded")


@query("SELECT DISTINCT release FROM embedding WHERE state = 'ready' ORDER BY release LIMIT 2")
def a12_release_guard(spark, d):
    return g.homogeneous(view(spark, d, "embedding"))


@query("SELECT unit_id, CASE WHEN bool_and(state = 'ready') THEN 'ready' WHEN bool_or(state = 'failed') THEN 'failed' ELSE 'pending' END AS status, count(*) AS rows FROM embedding WHERE state <> 'tombstoned' GROUP BY unit_id")
def t25_index_status(spark, d):
    return g.index_status(view(spark, d, "embedding"))


@query(f"""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'done' WHEN created_ms + 3600000 < {AS_OF} THEN 'expired' WHEN attempt >= 3 THEN 'exhausted' ELSE 'waiting' END AS next_state FROM outbox""")
def t28_expire_tasks(spark, d):
    tasks = view(spark, d, "outbox").select("event_id", F.expr("event_id % 3 <> 0").alias("open"), F.when(F.expr("event_id % 3 = 0"), "done").otherwise("waiting").alias("state"), (F.col("created_ms") + 3_600_000).alias("deadline_ms"), "attempt", F.lit(3).alias("max_attempts"))
    return g.expired(tasks, AS_OF).select("event_id", "next_state")


@query("SELECT event_id, least(0.5 * pow(2, least(attempt * 3, 6)), 30.0) AS wait_s FROM outbox")
def scalar_backoff(spark, d):
    return view(spark, d, "outbox").select("event_id", g.backoff_seconds(F.lit(0.5), F.col("attempt") * 3).alias("wait_s"))


def _query_vector(spark, d):
    return [float(x) for x in spark.read.parquet(f"{d}/embeddings.parquet").where("vec_id = 7").first()["embedding"]]


TOP = "WITH q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 7), s AS (SELECT vec_id, round(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(qv AS DOUBLE[])), 6) AS similarity FROM embeddings, q), top AS (SELECT * FROM s ORDER BY similarity DESC, vec_id LIMIT 20) "


@query(TOP + "SELECT * FROM top")
def l3_vector_top_k(spark, d):
    return v.top_k(spark.read.parquet(f"{d}/embeddings.parquet"), _query_vector(spark, d), 20).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query(TOP.replace("WITH q", "WITH q") + ", ok AS (SELECT embedding_id FROM embedding WHERE state = 'ready') SELECT vec_id, similarity, 1 - similarity AS distance, vec_id IN (SELECT embedding_id FROM ok) AS indexed FROM top")
def q4_semantic_search(spark, d):
    ready = view(spark, d, "embedding").where("state = 'ready'").select(F.col("embedding_id").alias("vec_id"))
    hits = v.semantic_search(spark.read.parquet(f"{d}/embeddings.parquet"), ready, _query_vector(spark, d), 20)
    return hits.select("vec_id", F.round("similarity", 6).alias("similarity"), F.round(1 - F.round("similarity", 6), 6).alias("distance"), "indexed")


@query("""SELECT vec_id AS embedding_id, CASE WHEN vec_id % 5 = 0 OR vec_id % 7 = 0 THEN 'failed' WHEN vec_id % 3 = 0 THEN 'pending' WHEN vec_id % 11 = 0 THEN 'failed' ELSE 'ready' END AS state,
    CASE WHEN vec_id % 5 = 0 THEN 'declared_index_mismatch' WHEN vec_id % 7 = 0 THEN 'vector_dimension_mismatch' WHEN vec_id % 3 > 0 AND vec_id % 11 = 0 THEN 'vector_not_confirmed' END AS reason_code FROM embeddings""")
def t21_embedding_sink(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    vector = F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding"))
    requests = e.select(F.col("vec_id").alias("embedding_id"), vector.alias("vector"), F.when(F.col("vec_id") % 5 == 0, 32).otherwise(64).alias("index_dimension"))
    text = F.array_join(F.transform("vector", lambda x: x.cast("string")), ",")
    stored = requests.where("embedding_id % 3 > 0").select("embedding_id", F.sha2(F.when(F.col("embedding_id") % 11 == 0, F.lit("another")).otherwise(text), 256).alias("vector_digest"))
    return g.sunk(requests, stored, 64)


@query("""WITH e AS (SELECT event_id, event_id % 13 = 0 AS other, event_id % 17 = 0 AS badref, event_id % 5 = 0 AS before, event_id % 2500 AS unit_id, CAST(1 + event_id % 3 AS INT) AS revision FROM events),
    o AS (SELECT event_id % 2000 AS unit_id, CAST(1 + event_id % 3 AS INT) AS revision, event_type IN ('view', 'click') AS wanted, CASE WHEN event_id % 10 = 0 THEN 0 WHEN event_id % 17 = 0 THEN 5000 ELSE 9 END AS n FROM events),
    c AS (SELECT unit_id, revision, count(*) AS observations, count_if(NOT wanted) AS skipped_modality, count_if(wanted AND n = 0) AS empty_text, count_if(wanted AND n > 4096) AS over_bound, count_if(wanted AND n BETWEEN 1 AND 4096) AS embedded FROM o GROUP BY ALL),
    j AS (SELECT e.*, CASE WHEN other THEN 'unsupported_event_type' WHEN badref THEN 'invalid_payload_ref' WHEN before THEN 'duplicate' WHEN NOT EXISTS (SELECT 1 FROM material m WHERE m.unit_id = e.unit_id AND m.revision = e.revision) THEN 'event_missing_facts' ELSE 'consumed' END AS outcome FROM e)
    SELECT event_id, outcome, CASE WHEN outcome = 'consumed' THEN coalesce(observations, 0) ELSE 0 END::BIGINT AS observations, CASE WHEN outcome = 'consumed' THEN coalesce(skipped_modality, 0) ELSE 0 END::BIGINT AS skipped_modality, CASE WHEN outcome = 'consumed' THEN coalesce(empty_text, 0) ELSE 0 END::BIGINT AS empty_text,
    CASE WHEN outcome = 'consumed' THEN coalesce(over_bound, 0) ELSE 0 END::BIGINT AS over_bound, CASE WHEN outcome = 'consumed' THEN coalesce(embedded, 0) ELSE 0 END::BIGINT AS embedded FROM j LEFT JOIN c USING (unit_id, revision)""")
def t22_index_consumer(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    ref = "'material:' || (event_id % 2500) || ':' || CASE WHEN event_id % 17 = 0 THEN 0 ELSE 1 + event_id % 3 END"
    events = e.selectExpr("event_id", "CASE WHEN event_id % 13 = 0 THEN 'material.deleted' ELSE 'material.upserted' END AS event_type", f"{ref} AS payload_ref")
    observation = e.selectExpr("event_id % 2000 AS unit_id", "CAST(1 + event_id % 3 AS INT) AS revision", "event_type AS modality", "CASE WHEN event_id % 10 = 0 THEN ' \n' WHEN event_id % 17 = 0 THEN repeat('x', 5000) ELSE 'some text' END AS text")
    consumed = e.where("event_id % 5 = 0").selectExpr("event_id", "'index' AS consumer").unionAll(e.selectExpr("event_id", "'other' AS consumer"))
    return g.indexed(events, view(spark, d, "material"), observation, consumed, "index", ["view", "click"])
