"""Views that map the given tables onto the timeline model, in the dialects of Spark and of the checking engine."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: DIV(a, b) is integer division and MILLIS(ts) the whole milliseconds of a timestamp.
VIEWS = {
    "obs": """SELECT event_id AS observation_id, user_id AS stream_id, event_type AS modality, MILLIS(ts) - 1704067200000 AS start_ms,
        MILLIS(ts) - 1704067200000 + 1 + (event_id % 5) * 60000 AS end_ms,
        CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(value / 500.0 AS DOUBLE) END AS confidence,
        CASE event_id % 11 WHEN 0 THEN 'failed' WHEN 1 THEN 'rejected' WHEN 2 THEN 'low_confidence' WHEN 3 THEN 'conflict'
            WHEN 4 THEN 'partial' WHEN 5 THEN 'accepted' ELSE 'final' END AS quality_state, value, props FROM events""",
    "stream": "SELECT DISTINCT user_id AS stream_id, CAST(user_id % 25 AS INT) AS source_id FROM events",
    "source": "SELECT n_nationkey AS source_id, r_name AS owner, n_name AS source_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "material": """SELECT l_orderkey AS unit_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS revision,
        l_orderkey % 150 AS stream_id, (l_orderkey % 1000) * 1000 AS start_ms, (l_orderkey % 1000) * 1000 + 1000 * CAST(l_quantity AS BIGINT) AS end_ms,
        CASE WHEN l_suppkey % 13 = 0 THEN 'failed' WHEN l_returnflag = 'A' THEN 'partial' WHEN l_returnflag = 'R' THEN 'enriched' ELSE 'fast_ready' END AS status,
        p_type AS tag_type, p_brand AS tag_brand, p_name AS search_text, l_partkey AS part_id, l_suppkey AS supplier_id,
        CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE 1 - l_discount * 5 END AS confidence,
        CASE l_linenumber % 3 WHEN 0 THEN 'ocr' WHEN 1 THEN 'asr' ELSE 'vlm' END AS modality,
        MILLIS(l_shipdate) AS created_ms
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "embedding": """SELECT vec_id AS embedding_id, vec_id % 200 AS unit_id, CAST(1 + vec_id % 3 AS INT) AS revision, label AS release,
        CASE vec_id % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' WHEN 2 THEN 'tombstoned' ELSE 'ready' END AS state,
        CASE WHEN vec_id % 6 = 2 AND vec_id % 4 = 2 THEN 'v' WHEN vec_id % 6 = 2 THEN NULL ELSE 'v' END AS vector_ref, vec_id * 1000 AS updated_ms FROM embeddings""",
    "outbox": """SELECT event_id, event_type, user_id, MILLIS(ts) AS created_ms, CASE WHEN event_id % 5 = 0 THEN NULL ELSE MILLIS(ts) + 1000 END AS published_ms,
        CAST(event_id % 4 AS INT) AS attempt, CASE WHEN event_id % 17 = 0 THEN event_id + 1 ELSE event_id END AS envelope_id FROM events""",
    "task": """SELECT s_suppkey AS task_id, DIV(s_suppkey, 10) AS run_id, s_suppkey % 10 AS node_id,
        CASE s_nationkey % 5 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'succeeded' WHEN 2 THEN 'running' WHEN 3 THEN 'pending' ELSE 'failed' END AS state,
        s_nationkey % 4 AS attempt, 3 AS max_attempts, s_acctbal AS memory, s_nationkey AS cell FROM supplier""",
    "edge": """SELECT p.run_id, p.task_id AS parent_id, c.task_id AS child_id, (p.node_id + c.node_id) % 3 <> 0 AS required
        FROM task p JOIN task c ON p.run_id = c.run_id AND (c.node_id = p.node_id + 1 OR c.node_id = p.node_id + 3)""",
    "execution": "SELECT o_orderkey AS execution_id, o_custkey AS job_id, MILLIS(o_orderdate) AS created_ms, o_orderkey % 10 AS run_id, o_orderstatus AS status FROM orders",
    "receipt": """SELECT l_suppkey AS task_id, CAST(l_linenumber % 4 AS INT) AS attempt, MILLIS(l_shipdate) AS completed_ms, l_orderkey AS receipt_id, l_linenumber AS part, l_partkey AS input_count FROM lineitem""",
    "window_state": """SELECT user_id % 40 AS execution_id, user_id AS stream_id, DIV(MILLIS(ts) - 1704067200000, 86400000) * 86400000 AS start_ms, DIV(MILLIS(ts) - 1704067200000, 86400000) * 86400000 + 86400000 AS end_ms,
        event_id AS state_revision, CASE event_id % 6 WHEN 0 THEN 'observed' WHEN 1 THEN 'queued' WHEN 2 THEN 'running' WHEN 3 THEN 'failed' WHEN 4 THEN 'observed' ELSE 'not_observed' END AS state FROM events""",
    "point": "SELECT user_id AS stream_id, event_id AS decode_index, MILLIS(ts) - 1704067200000 AS pts_ms, CAST(floor(value) AS BIGINT) % 256 AS luma, value FROM events",
    "track": """SELECT event_id AS track_id, CASE WHEN event_id % 2 = 0 THEN 'video' ELSE 'audio' END AS kind,
        CASE DIV(event_id, 2) % 29 WHEN 0 THEN NULL WHEN 1 THEN 'video/x-h264' WHEN 2 THEN 'video/x-flv' WHEN 3 THEN 'video/Odd--Thing.' WHEN 4 THEN '//' WHEN 5 THEN 'video/webm' WHEN 6 THEN 'video/x-mpeg' ELSE 'video/quicktime' END AS container,
        CASE WHEN event_id % 31 = 0 THEN NULL WHEN event_id % 2 = 0 THEN CASE DIV(event_id, 2) % 7 WHEN 0 THEN 'video/x-vp8' WHEN 1 THEN 'video/x-vp9' WHEN 2 THEN 'video/x-prores' WHEN 3 THEN 'video/x-h264' WHEN 4 THEN 'video/X-New' ELSE 'video/x-h265' END
            ELSE CASE DIV(event_id, 2) % 7 WHEN 0 THEN 'audio/x-opus' WHEN 1 THEN 'audio/x-raw' WHEN 2 THEN 'audio/x-ac3' ELSE 'audio/mpeg' END END AS codec,
        CASE WHEN event_id % 2 = 1 THEN CASE DIV(event_id, 2) % 5 WHEN 0 THEN NULL WHEN 1 THEN 'HE-AAC v2' ELSE 'LC' END
            ELSE CASE DIV(event_id, 2) % 11 WHEN 0 THEN NULL WHEN 1 THEN 'main-10' WHEN 2 THEN 'high-4:2:2-12' WHEN 3 THEN 'main-4:4:4' WHEN 4 THEN 'high' WHEN 5 THEN '1' WHEN 6 THEN '2' ELSE 'Main' END END AS profile,
        CASE DIV(event_id, 2) % 3 WHEN 0 THEN 8 WHEN 1 THEN NULL ELSE 8 + 2 * DIV(event_id % 13, 12) END AS bit_depth,
        CASE DIV(event_id, 2) % 13 WHEN 0 THEN NULL WHEN 1 THEN '4:2:2' ELSE '4:2:0' END AS chroma,
        CASE DIV(event_id, 2) % 17 WHEN 0 THEN NULL WHEN 1 THEN ' BT2020 ' WHEN 2 THEN '2:6:14:1' WHEN 3 THEN '2:6:15:7' WHEN 4 THEN '1:4:0:7' WHEN 5 THEN 'bt2100-pq' WHEN 6 THEN 'arib-std-b67' WHEN 7 THEN '2:3:5' WHEN 8 THEN '2:3: 5 :1' WHEN 9 THEN 'bt2020-10' WHEN 10 THEN '2:3:x:7' ELSE 'bt709' END AS colorimetry,
        CASE DIV(event_id, 2) % 9 WHEN 0 THEN NULL WHEN 1 THEN 1 ELSE 4 END AS mpegversion, CASE DIV(event_id, 2) % 19 WHEN 0 THEN 0 WHEN 1 THEN 6 WHEN 2 THEN NULL ELSE 2 END AS channels FROM events""",
    "deployment": """SELECT event_id AS deployment_id, CASE WHEN event_id % 53 = 0 THEN NULL ELSE event_id % 97 END AS node_id,
        CASE event_id % 41 WHEN 0 THEN 'revoked' WHEN 1 THEN 'offline' WHEN 2 THEN 'draining' WHEN 3 THEN 'lost' WHEN 4 THEN NULL WHEN 5 THEN 'enrolling' ELSE 'ready' END AS status,
        event_id % 64 AS heartbeat_age_s, event_id % 3 > 0 AS co_located, event_id % 89 AS data_plane_node_id,
        CASE event_id % 11 WHEN 0 THEN 'container' WHEN 1 THEN '' ELSE 'local_native,container' END AS artifacts,
        CASE WHEN event_id % 7 = 0 THEN 'linux' ELSE 'macOS' END AS platform, 'aarch64' AS arch, CASE event_id % 5 WHEN 0 THEN '' ELSE 'metal,coreml' END AS accelerators,
        1 + event_id % 8 AS cpu_cores, (event_id % 9) * 300000000 AS memory_bytes, CASE event_id % 6 WHEN 0 THEN 'org.demo.whisper-MLX' ELSE 'org.demo.ocr' END AS plugin_id,
        CASE event_id % 4 WHEN 0 THEN 'container' WHEN 1 THEN NULL ELSE 'local_native' END AS form, CASE event_id % 10 WHEN 0 THEN 'cpu,cuda_ipc' ELSE 'cpu' END AS memory_kinds,
        CASE event_id % 12 WHEN 0 THEN 'CoreML' WHEN 1 THEN 'cuda' WHEN 2 THEN 'cpu' END AS provider, CASE event_id % 14 WHEN 0 THEN '4' WHEN 1 THEN 'many' END AS cpu,
        CASE event_id % 15 WHEN 0 THEN '1Gi' WHEN 1 THEN '1.5g' WHEN 2 THEN '400M' END AS memory, event_id % 43 AS digest_kind FROM events""",
    "graph_node": """SELECT unit_id AS run_id, revision AS position, CASE WHEN part_id % 41 = 0 THEN ' ' WHEN part_id % 43 = 0 THEN ' n1' ELSE 'n' || revision END AS node_id, CASE WHEN supplier_id % 47 = 0 THEN NULL ELSE 'p' END AS plugin_id,
        CASE WHEN part_id % 53 = 0 THEN 0 ELSE 1000 END AS deadline_ms, CASE WHEN supplier_id % 59 = 0 THEN 17 ELSE 3 END AS max_attempts,
        CASE WHEN part_id % 61 = 0 THEN 'anywhere' WHEN part_id % 5 = 0 THEN 'OBJECT_ref_allowed' WHEN part_id % 3 = 0 THEN NULL ELSE 'data_plane_local' END AS placement,
        CASE WHEN part_id % 67 = 0 THEN 'frame' ELSE 'text' END AS second_input FROM material""",
    "graph_edge": """SELECT unit_id AS run_id, revision AS position, 'n' || CASE WHEN part_id % 17 = 0 THEN revision WHEN part_id % 19 = 0 THEN 1 ELSE revision - 1 END AS from_id, 'n' || CASE WHEN part_id % 19 = 0 THEN 2 WHEN part_id % 23 = 0 THEN 90 ELSE revision END AS to_id,
        CASE WHEN supplier_id % 11 = 0 THEN '' WHEN supplier_id % 13 = 0 THEN 'sound' WHEN supplier_id % 7 = 0 THEN 'vector' ELSE 'frame' END AS modality,
        CASE WHEN part_id % 29 = 0 THEN 'any' WHEN part_id % 2 = 0 THEN 'window_contains' WHEN part_id % 7 = 0 THEN NULL ELSE 'same_item' END AS join_policy FROM material""",
}


def needed(sql: str) -> list[str]:
    """The views that the text names, each after those that it names itself."""
    out: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b(FROM|JOIN)\s+{name}\b", text, re.I) and name not in out:
                visit(VIEWS[name])
                out.append(name)

    visit(sql)
    return out


def _calls(sql: str, name: str, form) -> str:
    """Every NAME(...) call, brackets matched, in another form; form gets the arguments."""
    while (at := sql.find(name + "(")) >= 0:
        depth, args, start = 0, [], at + len(name) + 1
        for k in range(start, len(sql)):
            c = sql[k]
            depth += c == "("
            if c == "," and not depth or c == ")" and not depth:
                args.append(sql[start:k].strip())
                start = k + 1
            if c == ")":
                if not depth:
                    break
                depth -= 1
        sql = sql[:at] + form(*args) + sql[k + 1 :]
    return sql


def for_duckdb(sql: str) -> str:
    """The query with the views it names in front."""
    ctes = [f"{v} AS ({VIEWS[v]})" for v in needed(sql)]
    if ctes and re.match(r"\s*WITH RECURSIVE\b", sql):
        sql = "WITH RECURSIVE " + ", ".join(ctes) + "," + re.sub(r"^\s*WITH RECURSIVE\b", "", sql)
    elif ctes and re.match(r"\s*WITH\b", sql):
        sql = "WITH " + ", ".join(ctes) + "," + re.sub(r"^\s*WITH\b", "", sql)
    elif ctes:
        sql = "WITH " + ", ".join(ctes) + " " + sql
    return _calls(_calls(sql, "DIV", lambda a, b: f"(({a}) // ({b}))"), "MILLIS", lambda t: f"(epoch_us({t}) // 1000)")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view as a DataFrame."""
    sql = _calls(_calls(VIEWS[name], "DIV", lambda a, b: f"(({a}) div ({b}))"), "MILLIS", lambda t: f"unix_millis(CAST({t} AS TIMESTAMP))")
    frames = {}
    for other in [*TABLES, *VIEWS]:
        if re.search(rf"\b(FROM|JOIN)\s+{other}\b", sql):
            frames[other] = spark.read.parquet(f"{sf_dir}/{other}.parquet") if other in TABLES else view(spark, sf_dir, other)
            sql = re.sub(rf"\b(FROM|JOIN)\s+{other}\b", rf"\1 {{{other}}}", sql)
    return spark.sql(sql, **frames)
