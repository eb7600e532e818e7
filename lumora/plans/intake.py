"""Queries over what an ingest run lets in, and over payloads and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import payloads as p
from ..functions import scalars as s
from ..operators import intake as i
from ..operators.vectors import normalised
from .fixtures import view
from .registry import query

WINDOW = 300_000
SPAN = 864_000_000
MONTH = 30 * 86_400_000

#: Observations as a report has them; each rule is broken by the ids that some prime divides.
RAW = """SELECT event_id AS observation_id, user_id AS run_id, CASE WHEN event_id % 97 = 0 THEN -1 ELSE user_id END AS stream_id, CASE WHEN event_id % 89 = 0 THEN -1 ELSE user_id % 25 END AS source_id, event_id AS item_id,
    CASE WHEN event_id % 67 = 0 THEN '' ELSE event_type END AS modality, 'container' AS timing_source, start_ms, CASE WHEN event_id % 61 = 0 THEN start_ms ELSE end_ms END AS end_ms,
    CASE WHEN event_id % 59 = 0 THEN 'sha256:zz' ELSE digest END AS content_hash, CASE WHEN event_id % 53 = 0 THEN 1.5 WHEN event_id % 7 > 0 THEN 0.5 END AS confidence, CAST(0.25 AS DOUBLE) AS timing_confidence,
    CASE WHEN event_id % 14 > 0 THEN 'model_gave_none' ELSE '' END AS confidence_unavailable_reason, CASE WHEN event_id % 47 = 0 THEN 0 ELSE 1704067200000 + start_ms END AS created_ms,
    CASE WHEN event_id % 43 = 0 THEN 'odd' ELSE 'final' END AS quality_state, CASE WHEN event_id % 41 = 0 THEN NULL ELSE 'ocr' END AS plugin, '1' AS plugin_version, CASE WHEN event_id % 37 = 0 THEN '' ELSE 'cpu' END AS execution_backend,
    CASE WHEN event_id % 31 = 0 THEN 'sha1:0' ELSE digest END AS artifact_digest, CASE WHEN event_id % 109 = 0 THEN 'ODD' WHEN event_id % 29 = 0 THEN 'MODEL_APPLICABILITY_NOT_APPLICABLE' ELSE 'MODEL_APPLICABILITY_MODEL_BASED' END AS applicability,
    CASE WHEN event_id % 58 = 0 THEN '' ELSE 'p1' END AS processor_release_id, CASE WHEN event_id % 29 = 0 THEN '' ELSE 'm1' END AS model_release_id, CASE WHEN event_id % 29 = 0 THEN '' ELSE 'm' END AS model_id,
    CASE WHEN event_id % 29 = 0 OR event_id % 23 = 0 THEN '' ELSE '2' END AS model_version, CASE WHEN event_id % 29 = 0 THEN '' ELSE digest END AS model_artifact_digest, CASE WHEN event_id % 19 = 0 THEN '' ELSE digest END AS config_hash,
    CASE WHEN event_id % 17 = 0 THEN 's' ELSE '' END AS schema_id, CASE WHEN event_id % 34 = 0 THEN '1' ELSE '' END AS schema_version, CASE WHEN event_id % 17 = 0 THEN digest ELSE '' END AS schema_digest,
    CASE WHEN event_id % 73 = 0 THEN '{"n": [1e999]}' WHEN event_id % 71 = 0 THEN '{"a": ' || repeat('[', 40) || repeat(']', 40) || '}' WHEN event_id % 113 = 0 THEN '[1]' ELSE props END AS payload,
    CASE WHEN event_id % 13 = 0 THEN 70000 ELSE 700 END AS n_bytes
    FROM (SELECT *, MILLIS(ts) - 1704067200000 AS start_ms, MILLIS(ts) - 1704067200000 + 1 + (event_id % 5) * 60000 AS end_ms, 'sha256:' || DIGEST AS digest FROM events)"""

JUDGED = """SELECT observation_id, coalesce(CASE WHEN observation_id % 97 = 0 THEN 'observation_stream_mismatch' WHEN observation_id % 89 = 0 THEN 'observation_source_mismatch' WHEN observation_id % 83 = 0 THEN 'observation_without_descriptor_ledger'
    WHEN observation_id % 3 = 0 AND observation_id % 79 = 0 THEN 'observation_ledger_observation_mismatch' WHEN observation_id % 73 = 0 THEN 'observation_payload_unsupported' WHEN observation_id % 71 = 0 THEN 'observation_payload_limit_exceeded'
    WHEN observation_id % 113 = 0 THEN 'observation_payload_unsupported' WHEN observation_id % 109 = 0 THEN 'model_applicability_invalid' END,
    'observation_contract_invalid: ' || CASE WHEN observation_id % 67 = 0 THEN 'missing_observation_identity' WHEN observation_id % 61 = 0 THEN 'invalid_half_open_time_range' WHEN observation_id % 59 = 0 THEN 'invalid_sha256_digest' WHEN observation_id % 53 = 0 THEN 'invalid_confidence'
    WHEN observation_id % 14 = 0 THEN 'missing_confidence_reason' WHEN observation_id % 47 = 0 THEN 'missing_creation_time' WHEN observation_id % 43 = 0 THEN 'invalid_quality_state' WHEN observation_id % 41 = 0 THEN 'missing_provenance' WHEN observation_id % 37 = 0 THEN 'incomplete_provenance'
    WHEN observation_id % 31 = 0 THEN 'invalid_sha256_digest' WHEN observation_id % 29 = 0 AND observation_id % 58 = 0 THEN 'non_model_provenance_invalid' WHEN observation_id % 29 > 0 AND observation_id % 23 = 0 THEN 'incomplete_provenance' WHEN observation_id % 19 = 0 THEN 'invalid_sha256_digest'
    WHEN observation_id % 17 = 0 AND observation_id % 34 > 0 THEN 'incomplete_payload_schema' END,
    CASE WHEN observation_id % 13 = 0 THEN 'observation_too_large' WHEN observation_id % 11 = 0 THEN 'observation_ledger_range_mismatch' WHEN end_ms > least(start_ms // 300000 * 300000 + 300000, 2592000000) THEN 'observation_crosses_window' END) AS reason_code FROM obs"""


def _judged(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    raw = spark.sql(RAW.replace("{", "{{").replace("}", "}}").replace("MILLIS(ts)", "unix_millis(CAST(ts AS TIMESTAMP))").replace("DIGEST AS", "sha2('x', 256) AS").replace("FROM events", "FROM {events}"), events=events)
    text = ("observation_id", "stream_id", "source_id", "item_id")
    obs = raw.withColumn("payload", F.try_parse_json("payload"))
    identities = events.selectExpr("user_id AS run_id", "user_id AS stream_id", "user_id % 25 AS source_id", f"{MONTH}L AS duration_ms").distinct()
    ledger = raw.where("item_id % 83 <> 0").selectExpr("run_id", "item_id", "start_ms AS item_start", "CASE WHEN item_id % 11 = 0 THEN end_ms + 1 ELSE end_ms END AS item_end")
    declared = raw.where("item_id % 3 = 0").selectExpr("run_id", "item_id", "CASE WHEN item_id % 79 = 0 THEN -1 ELSE item_id END AS observation_id")
    as_text = lambda df: df.withColumns({c: F.col(c).cast("string") for c in text if c in df.columns})
    return i.admitted(as_text(obs), as_text(identities), as_text(ledger), as_text(declared), WINDOW)


@query(JUDGED)
def f13_ordered_admission(spark, d):
    return _judged(spark, d).select(F.col("observation_id").cast("long").alias("observation_id"), "reason_code")


@query(f"SELECT coalesce(reason_code, 'accepted') AS reason, count(*) AS n FROM ({JUDGED}) GROUP BY 1")
def f13_a27_admission(spark, d):
    return i.rejection_counts(_judged(spark, d))


COVER = f"""o AS (SELECT *, DIV(start_ms, {SPAN}) * {SPAN} AS ws, start_ms + (1 + observation_id % 9) * 3600000 AS e FROM obs WHERE start_ms + (1 + observation_id % 9) * 3600000 <= DIV(start_ms, {SPAN}) * {SPAN} + {SPAN}),
    r AS (SELECT stream_id, ws, CASE WHEN observation_id % 401 = 0 THEN '' ELSE modality END AS asset_id, modality || CASE WHEN observation_id % 307 = 0 THEN 'x' ELSE '' END AS content, greatest(ws, start_ms - (observation_id % 7) * 1800000) AS s,
        CASE WHEN observation_id % 503 = 0 THEN ws + {SPAN} + 5 ELSE least(ws + {SPAN}, e + CASE WHEN observation_id % 101 = 0 THEN -900000 ELSE (observation_id % 3) * 900000 END) END AS e FROM o WHERE observation_id % 97 <> 4)"""


@query(f"""WITH {COVER}, w AS (SELECT DISTINCT stream_id, ws FROM o), v AS (SELECT DISTINCT stream_id, ws, asset_id, s, e FROM r WHERE asset_id <> '' AND e > s AND e <= ws + {SPAN}),
    points AS (SELECT stream_id, ws, s AS p FROM v UNION SELECT stream_id, ws, e FROM v UNION SELECT stream_id, ws, ws FROM w UNION SELECT stream_id, ws, ws + {SPAN} FROM w),
    parts AS (SELECT *, lead(p) OVER (PARTITION BY stream_id, ws ORDER BY p) AS q FROM points),
    cells AS (SELECT *, EXISTS (SELECT 1 FROM v WHERE v.stream_id = parts.stream_id AND v.ws = parts.ws AND v.s <= p AND q <= v.e) AS full_cell FROM parts WHERE q IS NOT NULL),
    runs AS (SELECT *, coalesce(lag(full_cell) OVER (PARTITION BY stream_id, ws ORDER BY p) <> full_cell, true) AS fresh FROM cells),
    spans AS (SELECT stream_id, ws, sum(CASE WHEN full_cell THEN q - p ELSE 0 END) AS covered_ms, count_if(full_cell AND fresh) AS islands, count_if(NOT full_cell AND fresh) AS gaps FROM runs GROUP BY ALL),
    bare AS (SELECT stream_id, ws, count(*) AS n FROM o WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.stream_id = o.stream_id AND v.ws = o.ws AND v.s <= o.start_ms AND o.e <= v.e) GROUP BY ALL),
    facts AS (SELECT w.stream_id, w.ws, (SELECT count(*) FROM o WHERE o.stream_id = w.stream_id AND o.ws = w.ws) AS observations, (SELECT count(*) FROM v WHERE v.stream_id = w.stream_id AND v.ws = w.ws) AS n_refs,
        EXISTS (SELECT 1 FROM r WHERE r.stream_id = w.stream_id AND r.ws = w.ws AND asset_id = '') AS nameless, EXISTS (SELECT 1 FROM r WHERE r.stream_id = w.stream_id AND r.ws = w.ws AND e <= s) AS empty_range,
        EXISTS (SELECT 1 FROM r WHERE r.stream_id = w.stream_id AND r.ws = w.ws AND e > ws + {SPAN}) AS outside,
        EXISTS (SELECT 1 FROM r a JOIN r b ON a.stream_id = b.stream_id AND a.ws = b.ws AND a.asset_id = b.asset_id AND a.content <> b.content WHERE a.asset_id <> '' AND a.e > a.s AND a.e <= a.ws + {SPAN} AND b.e > b.s AND b.e <= b.ws + {SPAN} AND a.stream_id = w.stream_id AND a.ws = w.ws) AS differs,
        (SELECT max(CASE WHEN observation_id % 211 = 0 THEN 70000 ELSE 700 END) FROM o WHERE o.stream_id = w.stream_id AND o.ws = w.ws) AS largest FROM w)
    SELECT stream_id, ws AS window_start, observations, n_refs AS references, coalesce(bare.n, 0) AS uncovered, covered_ms::BIGINT AS covered_ms, islands::BIGINT AS islands, gaps::BIGINT AS gaps,
    CASE WHEN nameless THEN 'missing_asset_id' WHEN empty_range THEN 'invalid_half_open_time_range' WHEN outside THEN 'source_reference_outside_material' WHEN differs THEN 'fusion_asset_digest_conflict' WHEN bare.n > 0 THEN 'fusion_observation_source_uncovered'
        WHEN largest > 65536 THEN 'fusion_observation_bytes_exceeded' END AS reason_code FROM facts JOIN spans USING (stream_id, ws) LEFT JOIN bare USING (stream_id, ws)""")
def a1_source_coverage(spark, d):
    end = F.col("start_ms") + (1 + F.col("observation_id") % 9) * 3_600_000
    o = view(spark, d, "obs").withColumn("window_start", F.floor(F.col("start_ms") / SPAN) * SPAN).withColumn("end_ms", end).where(F.col("end_ms") <= F.col("window_start") + SPAN)
    o = o.withColumn("n_bytes", F.expr("CASE WHEN observation_id % 211 = 0 THEN 70000 ELSE 700 END"))
    w = o.select("stream_id", "window_start", (F.col("window_start") + SPAN).alias("window_end")).distinct()
    r = o.where("observation_id % 97 <> 4").selectExpr(
        "stream_id", "window_start", "CASE WHEN observation_id % 401 = 0 THEN '' ELSE modality END AS asset_id", "'sha256:' || sha2(modality || CASE WHEN observation_id % 307 = 0 THEN 'x' ELSE '' END, 256) AS content_hash",
        "greatest(window_start, start_ms - (observation_id % 7) * 1800000) AS start_ms",
        f"CASE WHEN observation_id % 503 = 0 THEN window_start + {SPAN} + 5 ELSE least(window_start + {SPAN}, end_ms + CASE WHEN observation_id % 101 = 0 THEN -900000 ELSE (observation_id % 3) * 900000 END) END AS end_ms",
    )
    return i.source_coverage(w, o, r, SPAN).drop("window_end")


CONFIG_SCHEMA = [
    (1, "/mode", "string", True, '"fast"'), (1, "/limits", "object", False, "{}"), (1, "/limits/rate", "integer", False, "10"), (1, "/limits/burst", "number", False, "2.50"), (1, "/flag", "boolean", False, "true"),
    (2, "/mode", "string", True, None), (2, "/limits", "object", False, None), (2, "/limits/rate", "integer", True, None), (2, "/limits/burst", "number", False, "3.0"), (2, "/flag", "boolean", False, None),
]


@query("""WITH c AS (SELECT c_custkey AS id, CASE WHEN c_nationkey = 24 THEN 3 ELSE 1 + c_nationkey % 2 END AS s, c_custkey % 3 > 0 AS m, c_custkey % 2 = 0 OR c_custkey % 5 = 0 AS l, c_custkey % 5 = 0 AS r, c_custkey % 35 = 0 AS big, c_custkey % 11 = 0 AS nul, c_mktsegment FROM customer),
    f AS (SELECT id, s, big AND r AS precise, CASE WHEN m THEN '"' || c_mktsegment || '"' WHEN s = 1 THEN '"fast"' END AS mode, CASE WHEN l OR s = 1 THEN '{}' END AS limits,
        CASE WHEN r THEN CAST(id % 100 AS VARCHAR) WHEN s = 1 THEN '10' END AS rate, CASE WHEN s = 1 THEN '2.50' WHEN l THEN '3' END AS burst, CASE WHEN nul THEN 'null' WHEN s = 1 THEN 'true' END AS flag FROM c),
    j AS (SELECT *, CASE WHEN s = 3 THEN 'schema_invalid' WHEN precise THEN 'config_integer_precision_rejected' WHEN mode IS NULL OR flag = 'null' OR (limits IS NOT NULL AND rate IS NULL) THEN 'plugin_config_invalid' END AS reason_code FROM f)
    SELECT id AS config_id, reason_code, CASE WHEN reason_code IS NULL THEN mode END AS mode, CASE WHEN reason_code IS NULL THEN limits END AS limits, CASE WHEN reason_code IS NULL THEN rate END AS rate, CASE WHEN reason_code IS NULL THEN burst END AS burst, CASE WHEN reason_code IS NULL THEN flag END AS flag FROM j""")
def f22_configured(spark, d):
    values = """map_filter(map('', '{}', '/mode', CASE WHEN c_custkey % 3 > 0 THEN '"' || c_mktsegment || '"' END, '/limits', CASE WHEN c_custkey % 2 = 0 OR c_custkey % 5 = 0 THEN '{}' END,
        '/limits/rate', CASE WHEN c_custkey % 35 = 0 THEN '9007199254740993.0' WHEN c_custkey % 5 = 0 THEN (c_custkey % 100) || '.0' END, '/flag', CASE WHEN c_custkey % 11 = 0 THEN 'null' END), (k, v) -> v IS NOT NULL) AS values"""
    configs = spark.read.parquet(f"{d}/customer.parquet").selectExpr("c_custkey AS config_id", "CASE WHEN c_nationkey = 24 THEN 3 ELSE 1 + c_nationkey % 2 END AS schema_id", values)
    schemas = spark.createDataFrame(CONFIG_SCHEMA, "schema_id int, path string, type string, required boolean, default string")
    out = i.configured(configs, schemas)
    return out.select("config_id", "reason_code", *[F.try_element_at("values", F.lit(path)).alias(n) for n, path in (("mode", "/mode"), ("limits", "/limits"), ("rate", "/limits/rate"), ("burst", "/limits/burst"), ("flag", "/flag"))])


def _payloads(spark, d):
    """A nested payload for each event."""
    # the table is small against the work on its rows, so a split of the file is not the unit of work
    e = spark.read.parquet(f"{d}/events.parquet").repartition("event_id")
    text = F.to_json(F.struct(
        F.struct(F.concat(F.lit(" "), F.col("event_type"), F.lit(" ")).alias("x/y"), F.array(F.concat(F.lit("u"), F.col("user_id")), F.lit(""), F.lit("last")).alias("0")).alias("b~c"),
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("caption "), F.col("event_id"))).alias("caption"), F.col("value").alias("n"), F.array(F.struct(F.lit("tail").alias("text"), F.lit("never shown").alias("other"))).alias("z"),
    ))
    return e.select("event_id", "user_id", "event_type", "value", "props", F.when(F.col("event_id") % 9 > 0, F.parse_json(text)).alias("payload"))


@query("""SELECT event_id, CASE WHEN event_id % 9 > 0 THEN 'u' || user_id || chr(10) || 'last' || chr(10) || event_type ELSE '' END || CASE WHEN event_id % 9 > 0 AND event_id % 4 = 0 THEN chr(10) || 'caption ' || event_id ELSE '' END
    || CASE WHEN event_id % 9 > 0 THEN chr(10) || 'never shown' || chr(10) || 'tail' ELSE '' END AS text FROM events""")
def fn2_payload_text(spark, d):
    return _payloads(spark, d).select("event_id", p.payload_text(F.col("payload")).alias("text"))


@query("""SELECT event_id, CASE WHEN event_id % 9 > 0 THEN event_type || chr(10) || 'last' || chr(10) || 'tail' ELSE '' END AS text, CASE WHEN event_id % 9 > 0 AND event_id % 4 = 0 AND 18 + length(CAST(event_id AS VARCHAR)) > 20 THEN 'index_text_size_rejected' END AS short_reason FROM events""")
def fn3_declared_text(spark, d):
    v = F.col("payload")
    return _payloads(spark, d).select("event_id", p.declared_text(v, ["/b~0c/x~1y", "/b~0c/0/2", "/n", "/z/0/text", "/z/7", "/caption/0"])["text"].alias("text"), p.declared_text(v, ["/caption", "/b~0c/0/2", "/z/0/text"], 20)["reason_code"].alias("short_reason"))


@query("""WITH t AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN '' WHEN event_id % 4 = 0 THEN 'caption ' || event_id ELSE 'u' || user_id || chr(10) || '' || chr(10) || 'last' || chr(10) || ' ' || event_type || ' ' || chr(10) || 'tail' END AS whole,
    CASE WHEN event_id % 9 = 0 THEN 0 WHEN event_id % 4 = 0 THEN 8 + length(CAST(event_id AS VARCHAR)) ELSE 7 + length(event_type) + length(CAST(user_id AS VARCHAR)) END AS n FROM events)
    SELECT event_id, whole AS text, CASE WHEN event_id % 9 > 0 AND event_id % 4 = 0 THEN left(whole, 9) || CASE WHEN n >= 9 THEN '…' ELSE '' END END AS cut FROM t""")
def fn6_caption_text(spark, d):
    v = F.col("payload")
    return _payloads(spark, d).select("event_id", p.caption_text(v).alias("text"), F.when((F.col("event_id") % 9 > 0) & (F.col("event_id") % 4 == 0), p.caption_text(v, 9)).alias("cut"))


@query("""SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'observation_payload_unsupported' END AS whole, CASE WHEN event_id % 9 = 0 THEN 'observation_payload_unsupported' ELSE 'observation_payload_limit_exceeded' END AS shallow,
    CASE WHEN event_id % 9 = 0 THEN 'observation_payload_unsupported' WHEN event_id % 4 = 0 THEN 'observation_payload_limit_exceeded' END AS few FROM events""")
def f12_payload_bounds(spark, d):
    v = F.col("payload")
    return _payloads(spark, d).select("event_id", p.payload_limits(v).alias("whole"), p.payload_limits(v, 2).alias("shallow"), p.payload_limits(v, 32, 11).alias("few"))


@query("""SELECT event_id, sha256(concat_ws('|', user_id, event_type, event_id)) AS full_digest, 'emb_' || substr(sha256(concat_ws('|', user_id, event_type, event_id)), 1, 32) AS derived, 'asset-' || substr(sha256(event_type), 1, 12) AS asset,
    user_id % 3 > 0 AS digest_ok, sha256('{"a":' || user_id || ',"b":["' || event_type || '"]}') AS canonical, 'idx_' || event_type AS prefix, CAST(64 * (user_id % 5 + 1) AS INT) AS dimension, CAST(event_id % 7 AS INT) AS version FROM events""")
def fn11_fn13_fn14_ids(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    parts = [F.col("user_id"), F.col("event_type"), F.col("event_id")]
    given = F.when(F.col("user_id") % 3 > 0, s.digest(F.col("event_type"))).otherwise(F.upper(s.digest(F.col("event_type"))))
    key = s.index_key(F.expr("concat('idx_', event_type, '_d', 64 * (user_id % 5 + 1), '_v', event_id % 7)"))
    text = F.expr("""'{"b": [ "' || event_type || '" ], "a": ' || user_id || '}'""")
    return e.select("event_id", F.substring(s.digest(F.concat_ws("|", *[c.cast("string") for c in parts])), 8, 64).alias("full_digest"), s.derived_id("emb_", *parts).alias("derived"), s.asset_id(s.digest(F.col("event_type"))).alias("asset"), s.is_digest(given).alias("digest_ok"), s.canonical_digest(text).alias("canonical"), key["prefix"].alias("prefix"), key["dimension"].alias("dimension"), key["version"].alias("version"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type || chr(10) || user_id ELSE event_type END AS blocks, CASE WHEN event_id % 5 > 0 THEN event_type END AS model_text, event_id * 10 - 7200000 AS two_hours_before,
    CASE event_id % 4 WHEN 0 THEN event_id WHEN 1 THEN -event_id END AS tolerant, floor(2 * 30 / (1 + event_id % 10))::BIGINT + 1 AS most_keeps, CASE WHEN user_id % 2 = 0 THEN 'observed,queued' ELSE 'queued,queued' END AS states, 'k2' AS reasons_left FROM events""")
def fn4_fn5_fn28_texts(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    blocks = F.array(F.concat(F.lit(" "), F.col("event_type")), F.when(F.col("event_id") % 3 == 0, F.col("user_id").cast("string")).otherwise(F.lit("  ")))
    model = F.when(F.col("event_id") % 5 > 0, F.concat(F.lit("\n "), F.col("event_type"), F.lit(" "))).otherwise(F.when(F.col("event_id") % 2 == 0, F.lit(" \n")).otherwise(F.repeat(F.lit("x"), 4097)))
    value = F.parse_json(F.expr("CASE event_id % 4 WHEN 0 THEN '' || event_id WHEN 1 THEN '\"-' || event_id || '\"' WHEN 2 THEN '1.5' ELSE '\"1x\"' END"))
    states = F.create_map(F.lit("a"), F.lit("queued"), F.lit("b"), F.lit("queued"))
    merged = s.merged_states(states, F.when(F.col("user_id") % 2 == 0, F.create_map(F.lit("a"), F.lit("observed"))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))
    left = s.without_keys(F.create_map(F.lit("k1"), F.lit("x"), F.lit("k2"), F.lit("y")), F.array(F.lit("k1")))
    return e.select(
        "event_id", s.block_text(blocks).alias("blocks"), s.model_text(model).alias("model_text"), s.hours_before(F.col("event_id") * 10, F.lit(2)).alias("two_hours_before"), p.tolerant_long(value).alias("tolerant"),
        s.most_keeps(F.lit(60_000), (1 + F.col("event_id") % 10) * 1000).alias("most_keeps"), F.concat_ws(",", merged["a"], merged["b"]).alias("states"), F.array_join(F.map_keys(left), ",").alias("reasons_left"),
    )


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) / list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 6) AS norm, round((3 + vec_id % 7) / 640.0, 6) AS x, round((5 + vec_id % 11) / 480.0, 6) AS y FROM embeddings")
def fn25_fn27_vectors_and_boxes(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    unit = normalised(F.col("embedding").cast("array<double>"))
    box = s.normalised_box(F.array(F.struct((3 + F.col("vec_id") % 7).alias("x"), (5 + F.col("vec_id") % 11).alias("y"))), F.lit(640.0), F.lit(480.0))
    return e.select("vec_id", F.round(F.aggregate(unit, F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm"), box[0]["x"].alias("x"), box[0]["y"].alias("y"))
