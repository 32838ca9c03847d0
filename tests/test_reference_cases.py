"""The six behaviours the original tool's own tests pin down, restated on
DataFrames."""

import os

from pyspark.sql import functions as F

from lakeward import sources
from lakeward.operators import lineage, outcomes as oc, search, stats, tables


def _csv_lines(path):
    lines = []
    for name in sorted(os.listdir(path)):
        if name.endswith(".csv"):
            with open(os.path.join(path, name), encoding="utf-8") as fh:
                lines += fh.read().splitlines()[1:]  # drop each file's header
    return sorted(lines)


def test_task_chain_results(spark, scratch):
    tasks = spark.createDataFrame([("CHAIN_A", "SP"), ("CHAIN_B", "SP")], "entity string, space string")
    runs = spark.createDataFrame([("CHAIN_A", "SP", 1, True, 65432), ("CHAIN_B", "SP", 2, False, None)],
                                 "entity string, space string, seq int, success boolean, run_time_ms bigint")
    rep = oc.report_task_chains(tasks, runs, ["seq"])
    out = os.path.join(scratch, "chains")
    sources.append_results(rep.repartition(1), out, "TASK_CHAIN_RUN_RESULT")
    assert _csv_lines(out) == ["CHAIN_A,SP,True,65", "CHAIN_B,SP,False,"]


def test_persist_prefills_and_updates(spark, scratch):
    tasks = spark.createDataFrame([("VIEW_A", "SP")], "entity string, space string")
    none = spark.createDataFrame([], "entity string, space string, seq int, success boolean, run_time_ms bigint")
    pre = oc.report_persist(tasks, none, ["seq"], timer=True)
    assert [tuple(r) for r in pre.collect()] == [("VIEW_A", "SP", False, None)]
    runs = spark.createDataFrame([("VIEW_A", "SP", 1, True, 12000)],
                                 "entity string, space string, seq int, success boolean, run_time_ms bigint")
    rep = oc.report_persist(tasks, runs, ["seq"], timer=True)
    out = os.path.join(scratch, "persist")
    sources.append_results(rep.repartition(1), out, "VIEW_PERSIST_RESULT")
    assert _csv_lines(out) == ["VIEW_A,SP,True,12"]


def test_view_analytics_keeps_score_10_only(spark):
    stats_df = spark.createDataFrame([
        ("v1", 0, "VIEW_A", "SP", "View A", False, 10),
        ("v1", 1, "OTHER", None, None, None, 5),
        ("v2", 0, "VIEW_B", None, None, None, 3),
    ], "view_id string, position int, entity string, space string, businessName string, "
       "isPersisted boolean, persistencyCandidateScore int")
    got = search.best_persistence_candidates(stats_df, ["view_id"], ["position"])
    assert [tuple(r) for r in got.select(*search.CANDIDATE_COLUMNS).collect()] == [("VIEW_A", "SP", "View A", False)]
    # the same through the list form
    lists = stats_df.groupBy("view_id").agg(F.sort_array(F.collect_list(F.struct(
        "position", "entity", "space", "businessName", "isPersisted", "persistencyCandidateScore"))).alias("stats"))
    got2 = search.best_candidate_from_list(lists)
    assert [tuple(r) for r in got2.select(*search.CANDIDATE_COLUMNS).collect()] == [("VIEW_A", "SP", "View A", False)]


def test_statistics_decision_matrix(spark):
    cat = spark.createDataFrame([
        ("NEW", True, None), ("OTHER_TYPE", True, "SIMPLE"),
        ("SAME_TYPE", True, "HISTOGRAM"), ("UNSUPPORTED", False, None),
    ], "table_name string, statistics_supported boolean, statistics_type string")
    got = {r["table_name"]: r["action"] for r in stats.plan_statistics(cat, "HISTOGRAM").collect()}
    assert got == {"NEW": "create", "OTHER_TYPE": "update", "SAME_TYPE": "skip", "UNSUPPORTED": "skip"}


def test_lock_skips_views_without_partitions(spark):
    tasks = spark.createDataFrame([("WITH", "SP"), ("WITHOUT", "SP")], "entity string, space string")
    runs = spark.createDataFrame([("WITH", "SP", 1, "locked"), ("WITHOUT", "SP", 2, "no_partitions")],
                                 "entity string, space string, seq int, outcome string")
    got = [tuple(r) for r in oc.report_lock(tasks, runs, ["seq"]).collect()]
    assert got == [("WITH", "SP", True)]
    ranges = tables.lock_partitions(tables.year_ranges(spark, 2021, 2025), 2023)
    assert {r["partition"]: r["locked"] for r in ranges.collect()} == {
        "2021": True, "2022": True, "2023": True, "2024": False}


def test_model_export_resolved_and_unresolved(spark, scratch):
    models = spark.createDataFrame([("m1", "Model1", "SP", 0)], "model_id string, name string, space_name string, position int")
    edges = spark.createDataFrame([("m1", "v1", "View1"), ("m1", "v2", "View2")],
                                  "model_id string, view_id string, view_name string")
    views = spark.createDataFrame([("v1", "SP_V", 0)], "view_id string, space_name string, position int")
    nested = lineage.nested_export(lineage.model_edges(models, edges, views))
    row = nested.collect()[0]
    assert row["model_id"] == "m1" and row["name"] == "Model1"
    deps = {k: (v["space"], v["name"]) for k, v in row["dependencies"].items()}
    assert deps == {"v1": ("SP_V", "View1"), "v2": (None, "View2")}
    out = os.path.join(scratch, "export")
    sources.write_model_export(nested, out)
    back = spark.read.json(out).collect()[0]
    assert back["dependencies"]["v1"]["space"] == "SP_V"
