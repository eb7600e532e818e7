"""Queries over material units."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import materials as m
from ..operators.helpers import latest_by
from .fixtures import view
from .registry import query

LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY revision DESC) AS rn FROM material) WHERE rn = 1"


def _tagged(spark, d):
    return view(spark, d, "material").withColumn("tags", F.array("tag_type", "tag_brand"))


@query(f"""WITH latest AS ({LATEST}) SELECT unit_id, revision, start_ms, end_ms, status FROM latest JOIN stream USING (stream_id) JOIN source USING (source_id)
    WHERE owner = 'ASIA' AND status <> 'failed' AND strpos(lower(search_text), 'ring') > 0 AND end_ms > 100000 AND start_ms < 900000 AND tag_type = 'ECONOMY'
    AND EXISTS (SELECT 1 FROM material o WHERE o.unit_id = latest.unit_id AND o.revision = latest.revision AND o.modality IN ('ocr', 'asr') AND o.confidence >= 0.6)
    ORDER BY start_ms DESC, unit_id LIMIT 20""")
def q1_keyword_search(spark, d):
    material = _tagged(spark, d)
    observation = material.select("unit_id", "revision", "modality", "confidence")
    request = m.SearchRequest(owner="ASIA", query="Ring", start_ms=100_000, end_ms=900_000, tags=["ECONOMY"], modalities=["ocr", "asr"], min_confidence=0.6)
    return m.keyword_search(material, observation, view(spark, d, "stream"), view(spark, d, "source"), request).select("unit_id", "revision", "start_ms", "end_ms", "status")


@query("SELECT unit_id, CAST(revision AS BIGINT) AS revision, status, revision < max(revision) OVER (PARTITION BY unit_id) AS superseded FROM material WHERE unit_id = 37 QUALIFY revision = max(revision) OVER (PARTITION BY unit_id)")
def q2_get_material(spark, d):
    return m.get_material(view(spark, d, "material"), 37).select("unit_id", F.col("revision").cast("long").alias("revision"), "status", "superseded")


@query("SELECT unit_id, revision, lag(revision) OVER (PARTITION BY unit_id ORDER BY revision) AS prev_revision, revision < max(revision) OVER (PARTITION BY unit_id) AS superseded FROM material")
def q3_lineage(spark, d):
    return m.lineage(view(spark, d, "material")).select("unit_id", "revision", "prev_revision", "superseded")


@query(f"SELECT unit_id, revision, status FROM ({LATEST})")
def f2_latest_revision(spark, d):
    return m.latest_revision(view(spark, d, "material")).select("unit_id", "revision", "status")


@query("SELECT unit_id, revision, supplier_id % 10 AS execution_id FROM material QUALIFY row_number() OVER (PARTITION BY unit_id, supplier_id % 10 ORDER BY revision DESC) = 1")
def f3_latest_within_execution(spark, d):
    rows = view(spark, d, "material").withColumn("execution_id", F.col("supplier_id") % 10)
    return m.latest_revision(rows, ["unit_id", "execution_id"]).select("unit_id", "revision", "execution_id")


@query("SELECT doc_id FROM documents WHERE strpos(lower(text), '100%') > 0 OR strpos(lower(text), 'a_b') > 0 OR strpos(lower(text), 'license') > 0")
def f4_literal_substring(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.where(m.literal_text("text", "100%") | m.literal_text("text", "A_b") | m.literal_text("text", "License")).select("doc_id")


@query("SELECT count(*) AS n FROM obs WHERE end_ms > 86400000 AND start_ms < 172800000")
def f5_half_open_overlap(spark, d):
    return view(spark, d, "obs").where("end_ms > 86400000 AND start_ms < 172800000").agg(F.count("*").alias("n"))


@query("SELECT unit_id, revision FROM material WHERE tag_type = 'ECONOMY' AND tag_brand = 'Brand#2'")
def f6_tag_containment(spark, d):
    return _tagged(spark, d).where(m.has_tags("tags", ["Brand#2", "ECONOMY"])).select("unit_id", "revision")


@query("SELECT DISTINCT unit_id FROM material WHERE modality = 'ocr' AND confidence >= 0")
def f7_confidence_exists(spark, d):
    rows = view(spark, d, "material")
    fits = rows.where("modality = 'ocr' AND confidence >= 0")
    return rows.select("unit_id").distinct().join(fits, "unit_id", "left_semi")


@query(f"SELECT status, count(*) AS n FROM ({LATEST}) WHERE status <> 'failed' GROUP BY status")
def f8_failed_latest_hides(spark, d):
    return m.latest_revision(view(spark, d, "material")).where("status <> 'failed'").groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT owner, source_name, count(*) AS n, count(DISTINCT unit_id) AS units FROM material JOIN stream USING (stream_id) JOIN source USING (source_id) GROUP BY ALL")
def j1_material_stream_source(spark, d):
    return view(spark, d, "material").join(view(spark, d, "stream"), "stream_id").join(view(spark, d, "source"), "source_id").groupBy("owner", "source_name").agg(F.count("*").alias("n"), F.count_distinct("unit_id").alias("units"))


@query("SELECT a.unit_id, a.revision FROM material a WHERE NOT EXISTS (SELECT 1 FROM material b WHERE b.unit_id = a.unit_id AND b.revision > a.revision)")
def j3_not_exists_newer(spark, d):
    a, b = view(spark, d, "material").alias("a"), view(spark, d, "material").alias("b")
    return a.join(b, F.expr("a.unit_id = b.unit_id AND b.revision > a.revision"), "left_anti").select("unit_id", "revision")


@query("""WITH hit AS (SELECT vec_id AS rank, vec_id % 40 * 7 AS unit_id, CAST(1 + vec_id % 8 AS INT) AS revision FROM embeddings)
    SELECT rank, hit.unit_id, m.status, m.unit_id IS NOT NULL AS resolved FROM hit LEFT JOIN material m ON m.unit_id = hit.unit_id AND m.revision = hit.revision""")
def j6_hydrate_hits(spark, d):
    hits = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("rank"), (F.col("vec_id") % 40 * 7).alias("unit_id"), (1 + F.col("vec_id") % 8).cast("int").alias("revision"))
    return m.hydrate(hits, view(spark, d, "material").select("unit_id", "revision", "status"), ["unit_id", "revision"]).select("rank", "unit_id", "status", "resolved")


@query("SELECT o_orderkey AS job_id, l.revision, l.status FROM orders LEFT JOIN LATERAL (SELECT revision, status FROM material m WHERE m.unit_id = o_orderkey ORDER BY revision DESC LIMIT 1) l ON true")
def j13_latest_child(spark, d):
    latest = m.latest_revision(view(spark, d, "material")).select(F.col("unit_id").alias("job_id"), "revision", "status")
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("job_id")).join(latest, "job_id", "left").select("job_id", "revision", "status")


@query("""WITH base AS (SELECT p_partkey AS id, p_name AS name FROM part), over AS (SELECT s_suppkey * 3 AS id, s_name AS name FROM supplier)
    SELECT id, name FROM over UNION ALL SELECT id, name FROM base WHERE id NOT IN (SELECT id FROM over)""")
def j18_u3_catalog_union(spark, d):
    base = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    over = spark.read.parquet(f"{d}/supplier.parquet").select((F.col("s_suppkey") * 3).alias("id"), F.col("s_name").alias("name"))
    return m.catalog_union(base, over, "id").select("id", "name")


@query("""WITH x AS (SELECT *, CASE WHEN revision % 3 = 0 THEN status || '!' ELSE status END AS now_status FROM material)
    SELECT unit_id, revision, CASE WHEN revision > 5 THEN 'inserted' WHEN now_status = status THEN 'replayed' ELSE 'conflict' END AS outcome FROM x""")
def s11_append_revisions(spark, d):
    rows = view(spark, d, "material").withColumn("content_hash", F.sha2("status", 256))
    incoming = rows.withColumn("content_hash", F.sha2(F.when(F.col("revision") % 3 == 0, F.concat("status", F.lit("!"))).otherwise(F.col("status")), 256))
    return m.append_revisions(rows.where("revision <= 5"), incoming).select("unit_id", "revision", "outcome")


@query("SELECT o_orderkey, coalesce(n, 0) AS n FROM orders LEFT JOIN (SELECT unit_id, count(*) AS n FROM material WHERE status = 'partial' GROUP BY unit_id) ON unit_id = o_orderkey")
def a5_child_count(spark, d):
    n = view(spark, d, "material").where("status = 'partial'").groupBy("unit_id").count().select(F.col("unit_id").alias("o_orderkey"), F.col("count").alias("n"))
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey").join(n, "o_orderkey", "left").na.fill(0, ["n"])


@query("""SELECT stream_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(DISTINCT unit_id) AS n_units,
    array_to_string(list_sort(list_distinct(list(tag_brand))), ',') AS tags, array_to_string(list_sort(list_distinct(list(modality))), ',') AS modalities FROM material GROUP BY stream_id""")
def a14_video_groups(spark, d):
    return m.video_groups(view(spark, d, "material"))


@query("SELECT stream_id, coalesce(max(revision), 0) + 1 AS next_revision FROM material GROUP BY stream_id")
def a28_next_revision(spark, d):
    return m.next_revision(view(spark, d, "material"), ["stream_id"])


@query(f"WITH latest AS ({LATEST}) SELECT unit_id, start_ms, (SELECT count(*) FROM latest) AS total FROM latest ORDER BY start_ms DESC, unit_id LIMIT 25 OFFSET 50")
def l2_page(spark, d):
    return m.page(m.latest_revision(view(spark, d, "material")).select("unit_id", "start_ms"), [F.desc("start_ms"), F.col("unit_id")], 25, 50)


@query("SELECT DISTINCT tag_type FROM material ORDER BY tag_type LIMIT 32")
def a13_distinct_routes(spark, d):
    return view(spark, d, "material").select("tag_type").distinct().orderBy("tag_type").limit(32)


@query("""WITH x AS (SELECT observation_id % 4000 AS observation_id, CASE WHEN observation_id % 97 = 0 THEN 'changed' ELSE 'same' END AS content FROM obs)
    SELECT observation_id, count(*) AS received, min(content) <> max(content) AS conflict FROM x GROUP BY 1""")
def u4_merge_observations(spark, d):
    rows = view(spark, d, "obs").select((F.col("observation_id") % 4000).alias("observation_id"), F.sha2(F.when(F.col("observation_id") % 97 == 0, "changed").otherwise("same"), 256).alias("content_hash"))
    return m.merge_observations(rows).select("observation_id", "received", "conflict")


@query("""WITH r AS (SELECT stream_id, part_id % 50 AS asset_id, start_ms, end_ms, CASE WHEN unit_id % 97 = 0 AND part_id % 2 = 0 THEN 'other' ELSE 'same' END AS digest FROM material)
    SELECT stream_id, count(DISTINCT (asset_id, start_ms, end_ms)) AS references, count(DISTINCT asset_id) AS assets, CASE WHEN EXISTS (SELECT 1 FROM r b WHERE b.stream_id = r.stream_id GROUP BY b.asset_id HAVING count(DISTINCT digest) > 1) THEN 'fusion_asset_digest_conflict'
    WHEN count(DISTINCT (asset_id, start_ms, end_ms)) > 60 THEN 'fusion_source_limit_exceeded' END AS reason_code FROM r GROUP BY stream_id""")
def u5_source_references(spark, d):
    refs = view(spark, d, "material").select("stream_id", (F.col("part_id") % 50).alias("asset_id"), "start_ms", "end_ms", F.expr("CASE WHEN unit_id % 97 = 0 AND part_id % 2 = 0 THEN 'other' ELSE 'same' END AS content_hash"))
    return m.merged_references(refs, ["stream_id"], 60)


@query(f"""SELECT unit_id, revision, CASE WHEN unit_id % 89 = 0 THEN 'missing_material_identity' WHEN unit_id % 1000 < 3 AND unit_id % 7 = 0 OR unit_id % 83 = 0 THEN 'invalid_half_open_time_range' WHEN part_id % 31 = 0 THEN 'invalid_sha256_digest'
    WHEN supplier_id % 7 > 0 AND confidence * 1.25 > 1 THEN 'invalid_confidence' WHEN part_id % 29 = 0 THEN 'invalid_material_status' WHEN supplier_id % 41 = 0 THEN 'invalid_revision' END AS reason_code FROM ({LATEST})""")
def f11_validators(spark, d):
    latest = m.latest_revision(view(spark, d, "material"))
    units = latest.selectExpr(
        "unit_id AS id", "revision AS rev", "CASE WHEN unit_id % 89 = 0 THEN '  ' ELSE '' || unit_id END AS unit_id", "CASE WHEN unit_id % 1000 < 3 AND unit_id % 7 = 0 THEN -1 ELSE start_ms END AS start_ms", "CASE WHEN unit_id % 83 = 0 THEN start_ms ELSE end_ms END AS end_ms",
        "CASE WHEN part_id % 31 = 0 THEN 'md5:0' ELSE 'sha256:' || sha2('' || part_id, 256) END AS content_hash", "CAST(confidence AS DOUBLE) * 1.25 AS confidence", "CASE WHEN part_id % 29 = 0 THEN 'odd' ELSE status END AS status", "CASE WHEN supplier_id % 41 = 0 THEN 0 ELSE revision END AS revision",
    )
    return m.validated(units).select(F.col("id").alias("unit_id"), F.col("rev").alias("revision"), "reason_code")


@query("SELECT unit_id, count(*) AS revisions, sum(CASE WHEN status = 'partial' THEN 1 ELSE 0 END) AS partial FROM material WHERE (unit_id, stream_id) IN (SELECT o_orderkey, o_orderkey % 150 FROM orders WHERE o_orderstatus = 'P') GROUP BY unit_id")
def f18_row_value_semi(spark, d):
    keys = spark.read.parquet(f"{d}/orders.parquet").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("unit_id"), (F.col("o_orderkey") % 150).alias("stream_id"))
    return view(spark, d, "material").join(keys, ["unit_id", "stream_id"], "left_semi").groupBy("unit_id").agg(F.count("*").alias("revisions"), F.count_if(F.col("status") == "partial").alias("partial"))


@query("SELECT unit_id, supplier_id, revision, part_id FROM material QUALIFY row_number() OVER (PARTITION BY unit_id, supplier_id ORDER BY revision DESC, part_id) = 1")
def j21_pinned_lookup(spark, d):
    return latest_by(view(spark, d, "material"), ["unit_id", "supplier_id"], [F.desc("revision"), F.col("part_id")]).select("unit_id", "supplier_id", "revision", "part_id")


@query(f"""WITH latest AS ({LATEST}), expected AS (SELECT o_orderkey AS unit_id, o_orderpriority AS priority, o_custkey AS cust FROM orders), stored AS (SELECT unit_id, stream_id, status FROM latest WHERE status <> 'partial')
    SELECT e.unit_id, array_to_string(list_sort(list_filter([CASE WHEN s.unit_id IS NULL THEN 'source_missing' END, CASE WHEN s.status = 'failed' THEN 'status_conflict' END, CASE WHEN s.stream_id <> e.cust % 150 THEN 'stream_conflict' END], lambda x: x IS NOT NULL)), ',') AS conflicts
    FROM expected e LEFT JOIN stored s USING (unit_id)""")
def f20_identity_drift(spark, d):
    expected = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("unit_id"), F.col("o_custkey").alias("cust"))
    stored = m.latest_revision(view(spark, d, "material")).where("status <> 'partial'").select("unit_id", "stream_id", "status", F.lit(True).alias("there"))
    codes = [F.when(F.col("there").isNull(), "source_missing"), F.when(F.col("status") == "failed", "status_conflict"), F.when(F.col("stream_id") != F.col("cust") % 150, "stream_conflict")]
    return expected.join(stored, "unit_id", "left").select("unit_id", F.array_join(F.array_sort(F.array_compact(F.array(*codes))), ",").alias("conflicts"))
