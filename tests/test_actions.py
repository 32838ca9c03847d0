"""The end-to-end flows, driven from task files on disk."""

import os

from lakeward import actions, sources

RUNS = "entity string, space string, seq int, success boolean, run_time_ms bigint, outcome string"


def _task_file(path, header, rows):
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(header + "\n" + "".join(",".join(r) + "\n" for r in rows))
    return path


def _lines(path):
    out = []
    for name in sorted(os.listdir(path)):
        if name.endswith(".csv"):
            with open(os.path.join(path, name), encoding="utf-8") as fh:
                out += fh.read().splitlines()[1:]
    return sorted(out)


def test_run_task_chains_action(spark, scratch):
    tasks = _task_file(os.path.join(scratch, "t.csv"), "entity,space", [("CHAIN_A", "SP"), ("CHAIN_B", "SP")])
    runs = spark.createDataFrame([("CHAIN_A", "SP", 1, True, 65432, None), ("CHAIN_B", "SP", 1, False, None, None)], RUNS)
    out = os.path.join(scratch, "res")
    actions.run_task_chains(spark, tasks, runs, ["seq"], out)
    assert _lines(out) == ["CHAIN_A,SP,True,65", "CHAIN_B,SP,False,"]
    back = sorted(tuple(r) for r in sources.read_results(spark, out, "TASK_CHAIN_RUN_RESULT").collect())
    assert back == [("CHAIN_A", "SP", True, 65), ("CHAIN_B", "SP", False, None)]


def test_lock_and_partition_actions(spark, scratch):
    lock_tasks = _task_file(os.path.join(scratch, "l.csv"), "entity,space", [("WITH", "SP"), ("WITHOUT", "SP")])
    runs = spark.createDataFrame([("WITH", "SP", 1, None, None, "locked"),
                                  ("WITHOUT", "SP", 1, None, None, "no_partitions")], RUNS)
    out = os.path.join(scratch, "lock")
    actions.lock_partitions_until_year(spark, lock_tasks, runs, ["seq"], out)
    assert _lines(out) == ["WITH,SP,True"]
    create_tasks = _task_file(os.path.join(scratch, "c.csv"), "entity,space,attribute",
                              [("WITH", "SP", "YEAR"), ("WITHOUT", "SP", "YEAR")])
    runs2 = spark.createDataFrame([("WITH", "SP", 1, None, None, "exists"),
                                   ("WITHOUT", "SP", 1, None, None, "failed")], RUNS)
    out2 = os.path.join(scratch, "create")
    actions.create_partitioning_for_views(spark, create_tasks, runs2, ["seq"], out2)
    assert _lines(out2) == ["WITH,SP,YEAR,True", "WITHOUT,SP,YEAR,False"]


def test_export_models_in_space_action(spark, scratch):
    models = spark.createDataFrame([("m1", "Model1", "SP", 0), ("m2", "Model2", "OTHER", 1)],
                                   "model_id string, name string, space_name string, position int")
    edges = spark.createDataFrame([("m1", "v1", "View1"), ("m2", "v2", "View2")],
                                  "model_id string, view_id string, view_name string")
    views = spark.createDataFrame([("v1", "SP_V", 0)], "view_id string, space_name string, position int")
    out = os.path.join(scratch, "export")
    actions.export_models(models, edges, views, out, space="SP", parts=1)
    assert [n for n in os.listdir(out) if not n.startswith(("_", "."))] == ["space_name=SP"]
    rec = spark.read.json(out).first()
    assert rec["model_id"] == "m1" and rec["dependencies"]["v1"]["space"] == "SP_V"
