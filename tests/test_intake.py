"""Intake rules and payload walks against plain computations."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lumora.functions import payloads as p
from lumora.functions import scalars as s
from lumora.operators import intake as i


def column(spark, texts, make):
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string").withColumn("v", F.try_parse_json("t"))
    return [r["x"] for r in rows.select("n", make(F.col("v")).alias("x")).orderBy("n").collect()]


def plain_caption(value, most=4000):
    parts, count, length = [], 0, 0

    def visit(x, depth):
        nonlocal count, length
        if depth > 12:
            return
        count += 1
        if count > 501 or length >= most:
            return
        if isinstance(x, str):
            parts.append(x[: most - length])
            length += len(x)
        elif isinstance(x, list):
            for y in x:
                visit(y, depth + 1)
        elif isinstance(x, dict):
            main = next((k for k in ("text", "caption", "description", "transcript") if isinstance(x.get(k), str) and x[k]), None)
            for y in [x[main]] if main else [x[k] for k in sorted(x)]:
                visit(y, depth + 1)

    visit(value, 0)
    return "\n".join(parts) + ("…" if length >= most or count > 500 else "")


def random_value(rng, depth=0):
    kind = rng.random()
    if depth > 14 or kind < 0.3:
        return rng.choice(["", "  ", "some text", "é" * rng.randrange(5), rng.randrange(100), None, True, 1.5])
    if kind < 0.6:
        return [random_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["text", "caption", "a", "b", "c/d", "é", "transcript"]): random_value(rng, depth + 1) for _ in range(rng.randrange(4))}


def test_caption_text(spark):
    rng = random.Random(3)
    values = [{"a": random_value(rng), "b": random_value(rng)} for _ in range(150)]
    values += [{"text": "x" * 4000}, {"text": "x" * 3999, "a": "never"}, {"a": ["y" * 2500, "z" * 2500, "w"]}, {"a": ["s"] * 600}, {"a": ["s"] * 498}, {"a": ["s"] * 499}, {"a": ["s"] * 500}]
    deep = "end"
    for _ in range(11):
        deep = [deep]
    values += [{"a": deep}, {"a": [deep]}]
    assert column(spark, map(json.dumps, values), p.caption_text) == [plain_caption(v) for v in values]


def test_payload_text(spark):
    rng = random.Random(5)
    values = [{"a": random_value(rng), "b": random_value(rng)} for _ in range(80)]

    def strings(x):
        if isinstance(x, str):
            return [x.strip()] if x.strip() else []
        return [t for y in ([x[k] for k in sorted(x)] if isinstance(x, dict) else x if isinstance(x, list) else []) for t in strings(y)]

    assert column(spark, map(json.dumps, values), p.payload_text) == ["\n".join(strings(v)) for v in values]


def plain_limits(text, depth, values):
    try:
        root = json.loads(text)
    except ValueError:
        return "observation_payload_unsupported"
    if not isinstance(root, dict):
        return "observation_payload_unsupported"
    n, front, level = 0, [root], 0
    while front:
        front = [y for x in front for y in (x.values() if isinstance(x, dict) else x if isinstance(x, list) else ())]
        n, level = n + len(front), level + 1
        if front and level > depth:
            return "observation_payload_limit_exceeded"
    return "observation_payload_limit_exceeded" if n > values else None


def test_payload_limits(spark):
    rng = random.Random(8)
    texts = [json.dumps({"a": random_value(rng)}) for _ in range(120)] + ["{}", "[]", "nope", '"x"', json.dumps({"a": list(range(19))}), json.dumps({"a": list(range(20))})]
    for depth, values in ((3, 20), (32, 4096), (5, 4)):
        assert column(spark, texts, lambda v: p.payload_limits(v, depth, values)) == [plain_limits(t, depth, values) for t in texts]
    assert column(spark, ['{"a": [{"b": 1e999}]}', '{"a": -1e999}'], p.payload_limits) == ["observation_payload_unsupported"] * 2


def test_pointers(spark):
    text = json.dumps({"a/b": " x ", "m~n": {"0": "key", "1": ["y", "z"]}, "l": ["p", {"q": "r"}], "n": 5, "it's": "quoted"})
    pointers = ["/a~1b", "/m~0n/0", "/m~0n/1/1", "/l/0", "/l/1/q", "/l/9", "/n", "/none", "/it's"]
    assert column(spark, [text, "nope"], lambda v: p.declared_text(v, pointers)["text"]) == ["x\nkey\nz\np\nr\nquoted", ""]
    assert column(spark, [text], lambda v: p.declared_text(v, ["/a~1b"] * 40, 62)) == [(None, "index_text_size_rejected")]
    with pytest.raises(ValueError, match="text_field_pointer_invalid"):
        p.declared_text(F.lit(None), ["no slash"])


def test_small_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert [one(s.model_text_reason(F.lit(x))) for x in (None, " \n", "x" * 4097, " ok ")] == ["input_payload_missing_text", "input_text_empty", "input_text_exceeds_bound", None]
    assert [one(s.model_text(F.lit(x))) for x in (" \n", "x" * 4097, " ok\n")] == [None, None, "ok"]
    assert [one(s.most_keeps(F.lit(x), F.lit(1000))) for x in (-5, 0, 999, 1000, 10_500)] == [1, 1, 1, 2, 11]
    texts = ["12", '"-7"', '"9223372036854775807"', '"9223372036854775808"', '"1.0"', "1.5", "true", "null"]
    assert column(spark, texts, p.tolerant_long) == [12, -7, 2**63 - 1, None, None, None, None, None]


def test_islands_and_cover(spark):
    rng = random.Random(1)
    refs = [(k, a, a + rng.randrange(1, 30)) for k in range(30) for a in [rng.randrange(200) for _ in range(rng.randrange(12))]]
    obs = [(k, n, a, a + rng.randrange(1, 20)) for k in range(30) for n, a in enumerate(rng.randrange(200) for _ in range(15))]
    r = spark.createDataFrame(refs, "k long, start_ms long, end_ms long")
    o = spark.createDataFrame(obs, "k long, observation_id long, start_ms long, end_ms long")
    got = {}
    for row in i.islands(r, ["k"]).collect():
        got.setdefault(row["k"], []).append((row["start_ms"], row["end_ms"]))
    for k in range(30):
        cells = sorted({m for kk, a, b in refs if kk == k for m in range(a, b)})
        runs = []
        for m in cells:
            if runs and runs[-1][1] == m:
                runs[-1][1] = m + 1
            else:
                runs.append([m, m + 1])
        assert sorted(got.get(k, [])) == [tuple(x) for x in runs]
    bare = {(x["k"], x["observation_id"]) for x in i.uncovered(o, r, ["k"]).collect()}
    assert bare == {(k, n) for k, n, a, b in obs if not any(kk == k and s0 <= a and b <= e0 for kk, s0, e0 in refs)}


def test_defaults_in_defaults(spark):
    schema = [(1, "/a", "object", True, "{}"), (1, "/a/b", "object", False, "{}"), (1, "/a/b/c", "integer", True, "3"), (1, "/n", "number", False, None)]
    rows = [(1, 1, {"": "{}"}), (2, 1, {"": "{}", "/a": "{}", "/a/b": "{}", "/a/b/c": "7.0", "/n": "1.5"}), (3, 1, {"": "{}", "/a": "null"}), (4, 1, {"": "{}", "/n": "9007199254740992.0"}), (5, 1, {"": "{}", "/n": "9007199254740994.0"}), (6, 1, {"": "{}", "/n": "9007199254740994"}), (7, 2, {"": "{}"})]
    out = i.configured(spark.createDataFrame(rows, "config_id int, schema_id int, values map<string,string>"), spark.createDataFrame(schema, "schema_id int, path string, type string, required boolean, default string"))
    got = {r["config_id"]: (r["values"], r["reason_code"]) for r in out.collect()}
    full = {"": "{}", "/a": "{}", "/a/b": "{}", "/a/b/c": "3"}
    assert got[1] == (full, None) and got[2] == (full | {"/a/b/c": "7", "/n": "1.5"}, None) and got[3] == (None, "plugin_config_invalid")
    assert got[4] == (full | {"/n": "9007199254740992"}, None) and got[5] == (None, "config_integer_precision_rejected") and got[6][1] is None and got[7] == (None, "schema_invalid")


def test_walks_are_native(spark):
    rows = spark.createDataFrame([('{"a": 1}',)], "t string").select(F.try_parse_json("t").alias("v"))
    plan = rows.select(p.caption_text(F.col("v")), p.payload_text(F.col("v")), p.payload_limits(F.col("v")), p.declared_text(F.col("v"), ["/a"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_payload_walks_are_folds_that_run_once(spark):
    """A fold that is named by several fields is worked out for each of them, and a kind of every node spells out what lies below it."""
    v = F.col("v")
    rows = spark.range(1).select(F.try_parse_json(F.lit('{"a": ["x"]}')).alias("v"))
    for walk, kinds in ((p.payload_limits(v), 1), (p.payload_text(v), 1)):
        plan = rows.select(walk.alias("x"))._jdf.queryExecution().analyzed().toString()
        assert plan.count("aggregate(") == 1 and plan.count("schema_of_variant(") <= kinds
    shallow = spark.range(1).select(p.payload_limits(F.parse_json(F.lit('{"a": 1}')), 10_000_000).alias("x"))  # no steps for levels that are not there
    assert shallow.first()["x"] is None
