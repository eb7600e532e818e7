import hashlib

import pytest
from pyspark.sql import functions as F

from lumora.functions import scalars as s
from lumora.operators import materials as m
from lumora.operators.vectors import distance, dot, normalised


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_ids_and_digests(spark):
    want = hashlib.sha256(b"a|b|3").hexdigest()[:32]
    assert one(spark, s.derived_id("emb_", F.lit("a"), F.lit("b"), F.lit(3))) == "emb_" + want
    d = "sha256:" + hashlib.sha256(b"x").hexdigest()
    assert one(spark, s.digest(F.lit("x"))) == d and one(spark, s.is_digest(F.lit(d))) and not one(spark, s.is_digest(F.lit(d.upper())))
    assert one(spark, s.asset_id(F.lit(d))) == "asset-" + d[7:19]
    assert one(spark, s.canonical_digest(F.lit('{"b": 1, "a": "ü"}'))) == hashlib.sha256('{"a":"ü","b":1}'.encode()).hexdigest() and one(spark, s.canonical_digest(F.lit("{"))) is None


def test_text_functions(spark):
    assert [one(spark, s.seconds_to_ms(F.lit(x))) for x in ("1.5", "12", "1.2345", "-1")] == [1500, 12000, None, None]
    assert one(spark, s.ms_to_clock(F.lit(3_723_004))) == "01:02:03.004"
    assert one(spark, s.comma_list(F.lit(" a，b, ,a,c "))) == ["a", "b", "c"]
    unit, revision = s.payload_ref(F.lit("material:a:b:12"))
    assert (one(spark, unit), one(spark, revision)) == ("a:b", 12) and one(spark, s.payload_ref(F.lit("material:a:0"))[1]) is None
    assert [one(spark, s.memory_bytes(F.lit(x))) for x in ("1Gi", "1.5Gi", "512 Mi", "1g", "64k", "7", "1.5", "x", "2q", "gi")] == [1 << 30, 3 << 29, 512 << 20, 10**9, 64_000, 7, 0, 0, 0, 0]
    assert one(spark, s.block_text(F.array(F.lit(" a "), F.lit(" "), F.lit("b")))) == "a\nb"
    key = s.index_key(F.lit("material_text_bge_small_zh_v1_5_d512_v1"))
    assert (one(spark, key["dimension"]), one(spark, key["version"])) == (512, 1)
    assert one(spark, s.payload_text(F.lit('{"b": ["y", {"z": " "}], "a": "x", "n": 1}'))) == "x\ny"
    assert [one(spark, s.payload_bounds(F.lit(x), 3, 4)) for x in ("[1]", "[[[[1]]]]", "[1,2,3,4,5]", "[NaN]", "[")] == [None, "payload_too_deep", "payload_too_large", "payload_number_invalid", "payload_invalid"]


def test_maps_and_vectors(spark):
    a, b = F.create_map(F.lit("x"), F.lit("1"), F.lit("y"), F.lit("2")), F.create_map(F.lit("y"), F.lit("3"))
    assert one(spark, s.merged_states(a, b)) == {"x": "1", "y": "3"} and one(spark, s.without_keys(a, F.array(F.lit("x")))) == {"y": "2"}
    v = lambda *x: F.array(*[F.lit(float(y)) for y in x])
    assert one(spark, dot(v(1, 2), v(3, 4))) == 11 and one(spark, distance(v(1), v(1, 2))) == 1.0
    assert one(spark, normalised(v(3, 4))) == [0.6, 0.8]
    with pytest.raises(Exception, match="embedding_norm_invalid"):
        one(spark, normalised(v(0, 0)))


@pytest.mark.parametrize(("change", "code"), [({"limit": 101}, "search_limit_invalid"), ({"start_ms": -1}, "search_range_invalid"), ({"end_ms": 0}, "search_range_invalid"), ({"min_confidence": 2.0}, "search_confidence_invalid"), ({"mode": "semantic", "query": "x", "tags": ["a"]}, "semantic_filters_unsupported")])
def test_requests(change, code):
    with pytest.raises(m.RequestError, match=code):
        m.SearchRequest(**({"owner": "o"} | change)).check()


def test_search_boundaries(spark):
    unit = spark.createDataFrame([(1, 1, 7, 100, 200, "partial", ["t"], "text with 100% in it")], "unit_id long, revision int, stream_id long, start_ms long, end_ms long, status string, tags array<string>, search_text string")
    obs = spark.createDataFrame([(1, 1, "ocr", 0.9)], "unit_id long, revision int, modality string, confidence double")
    unknown = obs.withColumn("confidence", F.lit(None).cast("double"))
    stream, source = spark.createDataFrame([(7, 1)], "stream_id long, source_id int"), spark.createDataFrame([(1, "me")], "source_id int, owner string")
    n = lambda o=obs, **x: m.keyword_search(unit, o, stream, source, m.SearchRequest(**({"owner": "me"} | x))).count()
    assert n(query="100%", start_ms=199, end_ms=201, tags=["t"], modalities=["ocr"], min_confidence=0.8) == 1
    assert [n(start_ms=200), n(end_ms=100), n(query="_"), n(modalities=["asr"]), n(min_confidence=0.99), n(owner="you"), n(unknown, min_confidence=0.0)] == [0] * 7
