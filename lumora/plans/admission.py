"""Queries over admission: media formats, target nodes, submitted graphs, enrichment tasks; texts of numbers and references."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import admission as a
from .fixtures import view
from .registry import query

DAY = 86_400_000

COLOURS = r"""named(name, p, t, m) AS (VALUES ('bt601', 4, 16, 4), ('bt709', 1, 5, 3), ('smpte240m', 5, 6, 5), ('bt2020', 7, 11, 6), ('bt2020-10', 7, 13, 6), ('bt2100-pq', 7, 14, 6), ('bt2100-hlg', 7, 15, 6)),
    low AS (SELECT *, lower(trim(colorimetry)) AS low, regexp_full_match(lower(trim(colorimetry)), '( *\+?\d+ *)(: *\+?\d+ *){3}') AS four FROM track),
    colour AS (SELECT low.*, coalesce(p, CASE WHEN four THEN CAST(trim(split_part(low, ':', 4)) AS BIGINT) END) AS primaries, coalesce(t, CASE WHEN four THEN CAST(trim(split_part(low, ':', 3)) AS BIGINT) END) AS transfer,
        coalesce(m, CASE WHEN four THEN CAST(trim(split_part(low, ':', 2)) AS BIGINT) END) AS matrix FROM low LEFT JOIN named ON name = low),
    judged AS (SELECT *, CASE WHEN transfer = 14 OR contains(low, 'smpte2084') OR contains(low, 'bt2100-pq') THEN 'unsupported_transfer_characteristics_pq'
        WHEN transfer = 15 OR contains(low, 'arib-std-b67') OR contains(low, 'hlg') THEN 'unsupported_transfer_characteristics_hlg'
        WHEN primaries = 7 OR contains(low, 'bt2020') OR contains(low, 'bt2100') THEN 'unsupported_color_primaries_bt2020' END AS colour_code FROM colour)"""


@query(f"WITH {COLOURS} SELECT track_id, primaries, transfer, matrix, colour_code AS reason_code FROM judged")
def f21_colorimetry(spark, d):
    text = F.col("colorimetry")
    return view(spark, d, "track").select("track_id", a.colorimetry(text).alias("c"), a.colorimetry_rejection(text).alias("reason_code")).select("track_id", "c.*", "reason_code")


@query(rf"""WITH {COLOURS}, bits AS (SELECT *, coalesce(bit_depth, CASE codec WHEN 'video/x-vp8' THEN 8 WHEN 'video/x-vp9' THEN CASE WHEN profile IN ('0', '1') THEN 8 WHEN profile IN ('2', '3') THEN 10 END
        WHEN 'video/x-h265' THEN CASE WHEN list_contains(string_split(lower(profile), '-'), '10') THEN 10 WHEN list_contains(string_split(lower(profile), '-'), '12') THEN 12 WHEN starts_with(lower(profile), 'main') AND NOT contains(profile, '4:4:4') THEN 8 END
        WHEN 'video/x-h264' THEN CASE WHEN list_contains(string_split(lower(profile), '-'), '10') THEN 10 WHEN list_contains(string_split(lower(profile), '-'), '12') THEN 12 WHEN lower(profile) IN ('baseline', 'constrained-baseline', 'main', 'high', 'progressive-high') THEN 8 END END) AS bits FROM judged)
    SELECT track_id, CASE WHEN container IS NULL THEN 'unknown_source_container' WHEN container IN ('video/quicktime', 'video/webm') THEN
        CASE WHEN codec IS NULL THEN 'unknown_source_codec' WHEN kind = 'video' THEN
            CASE WHEN codec = 'video/x-prores' THEN 'unsupported_codec_prores' WHEN codec = 'video/X-New' THEN 'unsupported_codec_video_x_new' WHEN bits IS NULL THEN 'unknown_source_bit_depth'
                WHEN bits > 8 THEN 'unsupported_bit_depth_' || bits || 'bit' WHEN colour_code IS NOT NULL THEN colour_code WHEN chroma IS NULL AND codec <> 'video/x-vp8' THEN 'unknown_source_chroma_format' WHEN chroma <> '4:2:0' THEN 'unsupported_chroma_format_4_2_2' END
        ELSE CASE WHEN codec = 'audio/x-ac3' THEN 'unsupported_codec_ac3' WHEN codec = 'audio/mpeg' AND mpegversion IS NULL THEN 'unknown_source_codec_mpegversion' WHEN codec = 'audio/mpeg' AND mpegversion <> 4 THEN 'unsupported_codec_mp3'
                WHEN codec = 'audio/mpeg' AND profile IS NULL THEN 'unknown_source_codec_profile' WHEN codec = 'audio/mpeg' AND profile <> 'LC' THEN 'unsupported_codec_aac_he_aac_v2'
                WHEN coalesce(channels, 0) = 0 THEN 'unknown_channel_layout' WHEN channels > 2 THEN 'unsupported_channel_layout_multichannel' END END
        WHEN container IN ('video/x-h264', 'video/x-mpeg') THEN 'unsupported_container_raw_es' WHEN container = 'video/x-flv' THEN 'unsupported_container_flv' WHEN container = '//' THEN 'unsupported_container_unknown' ELSE 'unsupported_container_video_odd_thing' END AS reason_code FROM bits""")
def f14_format_admission(spark, d):
    return a.track_admission(view(spark, d, "track")).select("track_id", "reason_code")


@query("""SELECT deployment_id, CASE WHEN node_id IS NULL THEN 'node_not_found' WHEN status = 'revoked' THEN 'node_revoked' WHEN status = 'offline' THEN 'node_offline' WHEN status = 'draining' THEN 'node_draining'
    WHEN status IS NULL OR status NOT IN ('ready', 'candidate', 'enrolling') THEN 'node_not_ready' WHEN heartbeat_age_s > 60 THEN 'node_heartbeat_stale'
    WHEN contains(memory_kinds, 'cuda_ipc') AND NOT co_located AND node_id <> data_plane_node_id THEN 'data_locality_violation'
    WHEN form = 'container' AND NOT contains(artifacts, 'container') THEN 'container_runtime_unsupported' WHEN coalesce(form, 'local_native') = 'local_native' AND NOT contains(artifacts, 'local_native') THEN 'native_runtime_unsupported'
    WHEN plugin_id LIKE '%MLX' AND platform = 'linux' THEN 'unsupported_platform' WHEN provider = 'cuda' OR provider = 'CoreML' AND NOT contains(accelerators, 'coreml') THEN 'accelerator_not_available'
    WHEN cpu_cores < CASE cpu WHEN '4' THEN 4 ELSE 1 END THEN 'insufficient_cpu'
    WHEN memory_bytes > 0 AND memory_bytes < CASE memory WHEN '1Gi' THEN 1073741824 WHEN '1.5g' THEN 1500000000 WHEN '400M' THEN 400000000 ELSE 536870912 END THEN 'insufficient_memory'
    WHEN digest_kind < 2 THEN 'digest_mismatch' END AS reason_code FROM deployment""")
def o16_preflight(spark, d):
    pairs = view(spark, d, "deployment").withColumns({c: F.split(c, ",") for c in ("artifacts", "accelerators", "memory_kinds")})
    digest = F.when(F.col("digest_kind") == 1, F.lit("sha256:00")).when(F.col("digest_kind") > 1, F.concat(F.lit("sha256:"), F.sha2("plugin_id", 256)))
    return a.node_admission(pairs.withColumn("digest", digest)).select("deployment_id", "reason_code")


@query("""WITH n AS (SELECT *, trim(node_id) AS id, CASE WHEN trim(node_id) = '' OR plugin_id IS NULL THEN 'invalid_orchestration_node' WHEN deadline_ms <= 0 THEN 'invalid_orchestration_node_deadline' WHEN max_attempts > 16 THEN 'invalid_orchestration_attempt_budget'
        WHEN placement = 'anywhere' THEN 'invalid_orchestration_placement' WHEN second_input = 'frame' THEN 'duplicate_orchestration_modality' END AS own FROM graph_node),
    j AS (SELECT *, CASE WHEN own = 'invalid_orchestration_node' THEN own WHEN EXISTS (SELECT 1 FROM n b WHERE b.run_id = n.run_id AND b.id = n.id AND b.position < n.position AND b.own IS NULL) THEN 'duplicate_orchestration_node_id' ELSE own END AS reason FROM n),
    good AS (SELECT run_id FROM j GROUP BY run_id HAVING count(reason) = 0),
    e AS (SELECT g.*, CASE WHEN f.id IS NULL THEN 'orchestration_edge_from_not_found' WHEN t.id IS NULL THEN 'orchestration_edge_to_not_found' WHEN from_id = to_id OR modality = '' THEN 'invalid_orchestration_edge' WHEN modality = 'sound' THEN 'orchestration_edge_modality_not_produced'
        WHEN modality = 'vector' THEN 'orchestration_edge_modality_not_consumed' WHEN join_policy = 'any' THEN 'invalid_orchestration_join_policy' WHEN coalesce(join_policy, 'same_item') = 'same_item' AND (f.placement = 'OBJECT_ref_allowed' OR t.placement = 'OBJECT_ref_allowed') THEN 'same_item_requires_data_plane_local' END AS own
        FROM graph_edge g JOIN good USING (run_id) LEFT JOIN j f ON f.run_id = g.run_id AND f.id = from_id LEFT JOIN j t ON t.run_id = g.run_id AND t.id = to_id),
    r AS (SELECT *, coalesce(own, CASE WHEN row_number() OVER (PARTITION BY run_id, from_id, to_id, modality, coalesce(join_policy, 'same_item'), own ORDER BY position) > 1 THEN 'duplicate_orchestration_edge' END) AS reason FROM e)
    SELECT run_id, reason, count(*) AS n FROM (SELECT run_id, reason FROM j UNION ALL SELECT run_id, reason FROM r) WHERE reason IS NOT NULL GROUP BY run_id, reason""")
def o1_graph_rules(spark, d):
    nodes = view(spark, d, "graph_node").withColumn("consumes", F.array(F.lit("frame"), "second_input")).withColumn("produces", F.array(F.lit("frame"), F.lit("vector")))
    return a.graph_rule_failures(nodes, view(spark, d, "graph_edge"))


@query("""WITH k AS (SELECT unit_id, count(*) AS k FROM material GROUP BY 1), n AS (SELECT unit_id AS run_id, revision FROM material),
    x AS (SELECT run_id, 'invalid_orchestration_plugin_identity' AS reason FROM n WHERE run_id % 11 = 0 AND revision = 2 UNION ALL SELECT run_id, 'invalid_orchestration_payload_contract' FROM n WHERE run_id % 13 = 0 AND revision = 1
        UNION ALL SELECT run_id, 'invalid_orchestration_payload_contract' FROM n WHERE run_id % 17 = 0 AND revision = 1 UNION ALL SELECT run_id, 'invalid_orchestration_execution_policy' FROM n WHERE run_id % 19 = 0 AND revision = 1
        UNION ALL SELECT run_id, 'invalid_orchestration_delayed_enrichment' FROM n WHERE run_id % 19 > 0 AND revision = 1 AND (run_id % 25 = 0 OR run_id % 35 = 0 OR (run_id % 5 > 0 AND run_id % 46 = 0)) UNION ALL SELECT run_id, 'invalid_orchestration_delayed_enrichment' FROM n WHERE run_id % 29 = 0 AND revision = 2),
    c AS (SELECT unit_id AS run_id, 'orchestration_cycle_detected' AS reason FROM k WHERE unit_id % 7 = 0 AND k > 1 AND unit_id NOT IN (SELECT run_id FROM x))
    SELECT run_id, reason, count(*) AS n FROM (SELECT * FROM x UNION ALL SELECT * FROM c) GROUP BY ALL""")
def o1_graph_extensions(spark, d):
    m = view(spark, d, "material").select("unit_id", "revision")
    released = """'[{"id": "x", "plugin_id": "p", "plugin_version": "1", "artifact_digest": "d", "config_id": "c", "config_hash": "h", "consumes": ["frame"], "produces": ["text"], "release_id": "r", "execution_mode": "async_enrichment", "max_attempts": 3, "deadline_ms": ' || (CASE WHEN unit_id % 25 = 0 THEN 0 ELSE 5000 END) || ', "required": ' || (CASE WHEN unit_id % 35 = 0 THEN 'true' ELSE 'false' END) || '}]'"""
    own = """'[{"id": "describe", "plugin_id": "' || (CASE WHEN unit_id % 46 = 0 THEN 'other' ELSE 'p' END) || '", "plugin_version": "1", "artifact_digest": "d", "config_id": "c", "config_hash": "h", "consumes": ["frame"], "produces": ["text"], "max_attempts": 3, "deadline_ms": 5000}]'"""
    delayed = f"CASE WHEN revision = 1 AND unit_id % 5 = 0 THEN {released} WHEN revision = 1 AND unit_id % 23 = 0 THEN {own} WHEN revision = 2 AND unit_id % 29 = 0 THEN '[]' END"
    nodes = m.selectExpr(
        "unit_id AS run_id", "revision AS position", "CASE WHEN revision = 1 THEN 'timeline_fusion' ELSE 'n' || revision END AS node_id", "'p' AS plugin_id", "1000 AS deadline_ms", "2 AS max_attempts", "'data_plane_local' AS placement", "array('frame') AS consumes", "array('frame') AS produces",
        "CASE WHEN unit_id % 11 = 0 AND revision = 2 THEN ' ' WHEN revision % 2 = 0 THEN '1.0' END AS plugin_version", "parse_json(CASE WHEN unit_id % 13 = 0 AND revision = 1 THEN '{}' WHEN revision = 3 THEN '[]' END) AS input_contracts",
        "parse_json(CASE WHEN unit_id % 17 = 0 AND revision = 1 THEN '[' || repeat('1,', 32) || '1]' ELSE '[' || repeat('1,', 31) || '1]' END) AS output_contracts",
        "parse_json(CASE WHEN unit_id % 19 = 0 AND revision = 1 THEN 'null' WHEN revision < 3 THEN '{}' END) AS execution_policy", f"parse_json({delayed}) AS delayed_enrichments",
    )
    name = "CASE WHEN {0} = 1 THEN 'timeline_fusion' ELSE 'n' || ({0}) END"
    chain = m.where("revision > 1").selectExpr("unit_id AS run_id", "revision AS position", name.format("revision - 1") + " AS from_id", name.format("revision") + " AS to_id")
    back = m.where("unit_id % 7 = 0").groupBy("unit_id").agg(F.max("revision").alias("k")).where("k > 1").selectExpr("unit_id AS run_id", "1 AS position", name.format("k") + " AS from_id", "'timeline_fusion' AS to_id")
    edges = chain.unionByName(back).withColumn("modality", F.lit("frame")).withColumn("join_policy", F.lit("same_stream_window"))
    return a.graph_rule_failures(nodes, edges, {"id": "describe", "plugin_id": "p", "consumes": ["frame"], "produces": ["text"]})


@query("""WITH unit AS (SELECT stream_id, min(state_revision) AS unit_id, start_ms, end_ms FROM window_state WHERE stream_id % 10 = 1 OR state_revision % 3 <> 0 GROUP BY stream_id, start_ms, end_ms),
    wanted AS (SELECT 'enr_' || substr(sha256(concat_ws('|', stream_id, modality, observation_id, o.start_ms, o.end_ms)), 1, 32) AS task_id, stream_id AS execution_id, observation_id,
        (SELECT unit_id FROM unit u WHERE u.stream_id = o.stream_id AND u.start_ms <= o.start_ms AND o.start_ms < u.end_ms) AS unit_id FROM obs o),
    j AS (SELECT *, CASE WHEN unit_id IS NULL THEN 'enrichment_input_range_unmapped' WHEN observation_id % 640 = 0 THEN 'enrichment_task_identity_conflict' END AS reason FROM wanted)
    SELECT task_id, execution_id, unit_id, coalesce(reason, CASE WHEN observation_id % 4 = 0 THEN 'existing' ELSE 'created' END) AS outcome, count(reason) OVER (PARTITION BY execution_id) > 0 AS refused FROM j""")
def t27_enqueue_enrichments(spark, d):
    units = view(spark, d, "window_state").where("stream_id % 10 = 1 OR state_revision % 3 <> 0").groupBy("stream_id", "start_ms", "end_ms").agg(F.min("state_revision").alias("unit_id")).withColumnRenamed("stream_id", "execution_id")
    inputs = view(spark, d, "obs").selectExpr("stream_id AS execution_id", "modality AS node_id", "observation_id AS ref", "start_ms", "end_ms")
    none = units.limit(0)
    first = a.enqueued_enrichments(inputs.where("ref % 4 = 0"), units, none.selectExpr("'' AS task_id", "unit_id"), DAY)
    # tasks of an earlier call; of some the unit has changed since
    ids = inputs.select("ref", a.derived_id("enr_", *map(F.col, ("execution_id", "node_id", "ref", "start_ms", "end_ms"))).alias("task_id"))
    existing = first.join(ids, "task_id").select("task_id", F.when(F.col("ref") % 640 == 0, -1).otherwise(F.col("unit_id")).alias("unit_id"))
    return a.enqueued_enrichments(inputs, units, existing, DAY)


@query("""SELECT event_id, printf('%02d:%02d:%02d.%03d', DIV(ms, 3600000), DIV(ms, 60000) % 60, DIV(ms, 1000) % 60, ms % 1000) AS clock, CASE WHEN event_id % 3 = 0 THEN CAST(s AS BIGINT) * 1000 + 250 WHEN event_id % 3 = 1 THEN CAST(s AS BIGINT) * 1000 END AS parsed_ms,
    CASE event_id % 6 WHEN 0 THEN 1024 * (event_id % 100) WHEN 1 THEN 1000 * (event_id % 100) WHEN 2 THEN 1048576 * (event_id % 100) + 524288 WHEN 3 THEN event_id % 100 ELSE 0 END AS memory_bytes,
    CASE WHEN event_id % 5 > 0 THEN 'u:' || user_id END AS unit, CASE WHEN event_id % 5 > 0 THEN event_id % 5 END AS revision, list_aggregate(list_distinct([event_type, CAST(event_id % 2 AS VARCHAR), '0']), 'count') AS n_tags
    FROM (SELECT *, MILLIS(ts) % 400000000 AS ms, CAST(user_id AS VARCHAR) AS s FROM events)""")
def scalar_texts(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("ms", F.expr("unix_millis(CAST(ts AS TIMESTAMP)) % 400000000")).withColumn("s", F.col("user_id").cast("string"))
    seconds = F.expr("s || CASE event_id % 3 WHEN 0 THEN '.25' WHEN 1 THEN '' ELSE '.1234' END")
    size = F.expr("(event_id % 100) || CASE event_id % 6 WHEN 0 THEN 'Ki' WHEN 1 THEN 'k' WHEN 2 THEN '.5Mi' WHEN 3 THEN '' ELSE 'q' END")
    unit, revision = s.payload_ref(F.expr("'material:u:' || user_id || ':' || (event_id % 5)"))
    tags = F.expr("event_type || ' ,， 0,' || (event_id % 2)")
    return e.select("event_id", s.ms_to_clock(F.col("ms")).alias("clock"), s.seconds_to_ms(seconds).alias("parsed_ms"), s.memory_bytes(size).alias("memory_bytes"), F.when(revision > 0, unit).alias("unit"), revision.alias("revision"), F.size(s.comma_list(tags)).alias("n_tags"))
