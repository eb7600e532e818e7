"""Every query that has SQL, against the checking engine on the smallest tables; and what plans must not hold."""

import math
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

from lumora.plans import catalog
from lumora.plans.fixtures import TABLES, view

from .conftest import ROOT

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(df):
    def value(x):
        if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and math.isnan(x):
            return "-"
        x = x.item() if hasattr(x, "item") else x
        return str(int(x)) if isinstance(x, float) and x == int(x) else f"{x:.6g}" if isinstance(x, float) else str(x)

    return sorted(tuple(map(value, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(name, spark, sf_dir, db):
    got, want = catalog.queries()[name](spark, sf_dir).toPandas(), db.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_query_without_sql(name, spark, sf_dir):
    assert catalog.queries()[name](spark, sf_dir).count() > 0


@pytest.mark.parametrize("name", ["j8_overlap_join", "j11_point_in_interval", "t8_t9_coverage", "j12_as_of"])
def test_interval_joins_have_no_nested_loop(name, spark, sf_dir):
    plan = catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize(("name", "scans", "exchanges"), [("o1_graph_extensions", 6, 5), ("o1_graph_rules", 4, 3), ("o20_report_fence", 6, 3), ("t10_grid_validation", 2, 3)])
def test_steps_are_planned_once(name, scans, exchanges, spark, sf_dir):
    """A table that several branches name is planned, and mostly run, once for each of them."""
    plan = catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= scans and plan.count("Exchange hashpartitioning") <= exchanges


@pytest.mark.parametrize(("name", "sorts"), [("o1_graph_rules", 3)])
def test_rows_are_sorted_once(name, sorts, spark, sf_dir):
    """Every sort of a task holds all its rows in memory at once."""
    plan = catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") <= sorts


def test_graph_rules_of_odd_graphs(spark):
    from lumora.operators.admission import graph_rule_failures

    node = lambda run, k, name, most=1: (run, k, name, "p", 1, most, None, ["frame"], ["frame"])
    edge = lambda run, a, b, policy="window_contains": (run, 1, a, b, "frame", policy)
    nodes = [node(run, k, f"n{k}") for run in (1, 2, 3, 4) for k in (1, 2)] + [node(5, k, f"n{k}") for k in range(129)] + [node(6, 1, "a"), node(6, 2, " a"), node(6, 3, "b", 17), node(None, 1, "a", 17)]
    edges = [edge(1, "n1", "n2")] * 3 + [edge(1, "n1", "n2", None), edge(2, "n1", "n2"), edge(2, "n2", "n1"), edge(3, "n1", "n2"), edge(6, "x", "y"), edge(7, "n1", "n2"), edge(None, "a", "b")] + [edge(4, "n1", "n2")] * 1025
    nodes = spark.createDataFrame(nodes, "run_id long, position int, node_id string, plugin_id string, deadline_ms int, max_attempts int, placement string, consumes array<string>, produces array<string>")
    edges = spark.createDataFrame(edges, "run_id long, position int, from_id string, to_id string, modality string, join_policy string")
    want = {(1, "duplicate_orchestration_edge", 2), (2, "orchestration_cycle_detected", 1), (4, "invalid_orchestration_edge_count", 1), (6, "duplicate_orchestration_node_id", 1), (6, "invalid_orchestration_attempt_budget", 1)}
    want |= {(run, "invalid_orchestration_node_count", 1) for run in (5, 7, None)}
    assert {tuple(r) for r in graph_rule_failures(nodes, edges).collect()} == want


def test_playback_joins_narrow_rows(spark, sf_dir):
    """Texts of a group are aggregated by a sort of whole rows; and a null upload would put all assets without one in a single task."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = catalog.queries()["q8_playback_sources"](spark, sf_dir)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan
        [by_upload] = [line for line in plan.splitlines() if "SortMergeJoin [upload_id" in line]
        assert "LeftOuter" in by_upload and plan.index(by_upload) > plan.index("SortMergeJoin [asset_id")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_playback_of_odd_sources(spark):
    from lumora.operators.executions import playback_sources

    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    ids = ["asset_" + f"{k:032x}" for k in range(9)]
    requests = [("u", 1, k, "o") for k in range(9)] * 2 + [("u", 1, 0, None), ("v", 1, 0, "o")]
    references = [("u", 1, k, "h", 0, 10) for k in range(9) if k != 1] + [("u", 1, 2, "other", 0, 10), ("u", 1, 3, None, 0, 10), ("u", 1, 4, "h", 0, 99), (None, 1, 0, "x", 0, 10)]
    assets = [(k, 7, "o", "rtmp" if k == 5 else "file", None if k == 6 else "upload://" + ids[k], "h", 50) for k in range(8)]
    uploads = [(ids[k], "o", "h", "awaiting_admission") for k in range(7)] + [("6", "o", "h", "awaiting_admission")]
    got = playback_sources(
        frame(requests, "unit_id string, revision int, asset_id long, owner string"), frame([("u", 1, 7, "o")], "unit_id string, revision int, stream_id long, owner string"),
        frame(references, "unit_id string, revision int, asset_id long, content_hash string, start_ms long, end_ms long"),
        frame(assets, "asset_id long, stream_id long, owner string, source_type string, object_uri string, sha256 string, duration_ms long"), frame(uploads, "upload_id string, owner string, sha256 string, state string"),
    ).collect()
    lost, wrong = "material_source_not_found", "material_source_mismatch"
    codes = [None, lost, wrong, None, "material_source_time_invalid", "material_source_unmapped", "material_source_unmapped", lost, wrong]
    want = [("u", 1, k, "o", code, None if code else ids[k]) for k, code in enumerate(codes)] + [("u", 1, 0, None, "material_not_found", None), ("v", 1, 0, "o", "material_not_found", None)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_filters_reach_the_scan(spark, sf_dir):
    plan = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey < 200").select("c_custkey")._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(c_custkey,200)" in plan and "c_mktsegment" not in plan


def test_fusion_ignores_order_and_repeats(spark, sf_dir):
    from lumora.operators.timeline import fuse

    obs = view(spark, sf_dir, "obs")
    one = fuse(obs, 300_000, ["view"], ["click"])
    twice = fuse(obs.unionAll(obs).orderBy("value"), 300_000, ["view"], ["click"])
    assert plain(one.drop("duplicates").toPandas()) == plain(twice.drop("duplicates").toPandas())
    assert twice.where("duplicates <> received OR reason_code IS NOT NULL").count() == 0


def test_corpus_subpackage_is_optional():
    code = "import sys, importlib.util as u; real = u.find_spec\nu.find_spec = lambda n, *a: None if n in ('lumora.llm', 'corpus_pipeline') else real(n, *a)\nimport __spark_entry__ as e; q = e.queries(); assert 'q1_keyword_search' in q and 'pipeline' not in q and not [x for x in q if x.startswith('op1_')]; assert set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=False).returncode == 0
