"""Task lists run on Spark tables, and their reports."""

import json
import os

from pyspark.sql import functions as F

from lakeward import actions, schemas, sources
from lakeward.operators import lineage, runs, tables

REF = "entity string, space string"


def _view(spark, rows=40):
    return spark.range(rows).select("id", F.concat(F.lit("200"), (F.col("id") % 4).cast("string")).alias("year"))


def _by_year(df):
    return {r["year"]: r["count"] for r in df.groupBy("year").count().collect()}


def test_failed_tasks_keep_their_cause(spark, scratch):
    store = os.path.join(scratch, "s")
    tasks = spark.createDataFrame([("V", "SP"), ("V", "SP"), ("NONE", "SP")], REF)
    out = {r["entity"]: r for r in runs.persisting({("V", "SP"): _view(spark)}, store)(tasks).collect()}
    assert len(out) == 2 and out["V"]["success"] and out["V"]["error"] is None and out["V"]["run_time_ms"] >= 0
    assert not out["NONE"]["success"] and out["NONE"]["outcome"] == "failed" and "NONE" in out["NONE"]["error"]
    assert tables.read_view(spark, "V", "SP", store).count() == 40


def test_no_tasks_no_outcomes(spark, scratch):
    store = os.path.join(scratch, "s")
    assert runs.unlocking(store)(spark.createDataFrame([], REF)).count() == 0


def test_second_attribute_finds_the_partitioning_there(spark, scratch):
    store = os.path.join(scratch, "s")
    tasks = spark.createDataFrame([("V", "SP", "year"), ("V", "SP", "zzz")], REF + ", attribute string")
    views = {("V", "SP"): _view(spark)}
    got = {r["attribute"]: r["outcome"] for r in runs.partitioning(views, store, 2000, 2003)(tasks).collect()}
    assert got == {"year": "created", "zzz": "exists"}
    again = runs.partitioning(views, store, 2000, 2003, overwrite=True)(tasks.filter("attribute = 'zzz'")).first()
    assert again["outcome"] == "failed" and "zzz" in again["error"]
    assert _by_year(tables.read_view(spark, "V", "SP", store)) == {"2000": 10, "2001": 10, "2002": 10, "2003": 10}


def test_locks_add_up_until_unlocked_or_partitioned_anew(spark, scratch):
    store = os.path.join(scratch, "s")
    tasks = spark.createDataFrame([("V", "SP", "year")], REF + ", attribute string")
    views = {("V", "SP"): _view(spark)}
    runs.partitioning(views, store, 2000, 2003)(tasks)
    for until in (2001, 2000):
        assert runs.locking(store, until)(tasks).first()["outcome"] == "locked"
    assert runs.layouts(spark, store).first()["locked_until"] == 2001
    runs.persisting({("V", "SP"): _view(spark, 4)}, store)(tasks)
    assert _by_year(tables.read_view(spark, "V", "SP", store)) == {"2000": 10, "2001": 10, "2002": 1, "2003": 1}
    assert runs.partitioning(views, store, 2000, 2003, overwrite=True)(tasks).first()["outcome"] == "created"
    assert runs.layouts(spark, store).first()["locked_until"] is None


def test_a_failed_persist_leaves_the_partitions(spark, scratch):
    store = os.path.join(scratch, "s")
    tasks = spark.createDataFrame([("V", "SP", "year")], REF + ", attribute string")
    runs.partitioning({("V", "SP"): _view(spark)}, store, 2000, 2003)(tasks)
    broken = _view(spark).withColumn("id", F.when(F.col("id") < 35, F.col("id")).otherwise(F.raise_error(F.lit("cut off")).cast("bigint")))
    out = runs.persisting({("V", "SP"): broken}, store)(tasks).first()
    assert not out["success"] and "cut off" in out["error"]
    assert _by_year(tables.read_view(spark, "V", "SP", store)) == {"2000": 10, "2001": 10, "2002": 10, "2003": 10}


def test_removing_partitions_keeps_the_rows(spark, scratch):
    store = os.path.join(scratch, "s")
    tasks = spark.createDataFrame([("V", "SP", "year"), ("W", "SP", "year")], REF + ", attribute string")
    runs.partitioning({("V", "SP"): _view(spark)}, store, 2000, 2002)(tasks)
    got = {r["entity"]: r["outcome"] for r in runs.unpartitioning(store)(tasks).collect()}
    assert got == {"V": "removed", "W": "no_partitions"}
    back = tables.read_view(spark, "V", "SP", store)
    assert back.columns == ["id", "year"] and back.count() == 40 and runs.layouts(spark, store).count() == 0


def test_positions_follow_the_files_not_their_sizes(spark, scratch):
    path = os.path.join(scratch, "views")
    os.makedirs(path)
    for i, rows in enumerate((1, 50, 5, 400)):  # Spark reads large files first
        with open(os.path.join(path, f"part-{i}.json"), "w", encoding="utf-8") as fh:
            for k in range(rows):
                fh.write(json.dumps({"id": "v", "name": f"{i}-{k:03d}", "space_name": f"{i}-{k:03d}"}) + "\n")
    v = sources.scan_catalog(spark, path, "views", fmt="json")
    names = [r["name"] for r in v.orderBy("position").collect()]
    assert names == sorted(names) and len(names) == 456
    edges = spark.createDataFrame([("m", "v", "V")], "model_id string, view_id string, view_name string")
    assert lineage.map_views_to_spaces(edges, v).first()["view_space"] == "0-000"


def test_stored_position_decides(spark, scratch):
    path = os.path.join(scratch, "models")
    spark.createDataFrame([("m1", "A", "S", 7), ("m1", "B", "S", 2)], "id string, name string, space_name string, position long").write.json(path)
    m = sources.scan_catalog(spark, path, "models", fmt="json", stored_position=True)
    assert lineage.unique_models(m).first()["name"] == "B"


def test_reset_all_keeps_task_files(spark, scratch):
    task = os.path.join(scratch, "tasks", "views_to_persist.csv")
    os.makedirs(os.path.dirname(task))
    with open(task, "w", encoding="utf-8") as fh:
        fh.write("entity,space\nV,SP\n")
    sources.reset_all(spark, scratch)
    assert sources.scan_tasks(spark, task, "VIEW_PERSIST").count() == 1
    for kind, (folder, name, cols) in schemas.DATASETS.items():
        if cols is not None and kind != "VIEW_PERSIST":
            assert spark.read.option("header", True).csv(os.path.join(scratch, folder, name)).columns == cols


def test_models_not_found_are_written(spark, scratch):
    path = os.path.join(scratch, "t.csv")
    with open(path, "w", encoding="utf-8") as fh:
        fh.write("modelname,space\nM,SP\nGONE,SP\n")
    models = spark.createDataFrame([("m1", "M", "SP", 0)], "model_id string, name string, space_name string, position int")
    edges = spark.createDataFrame([("m1", "v1", "V")], "model_id string, view_id string, view_name string")
    views = spark.createDataFrame([("v1", "SP", 0)], "view_id string, space_name string, position int")
    none = spark.createDataFrame([], "name string, space string, seq int, success boolean, run_time_ms bigint")
    out, gone = os.path.join(scratch, "out"), os.path.join(scratch, "gone")
    actions.check_model_runtimes(spark, path, models, edges, views, none.select("name", "space"), none, none, ["seq"], out, not_found=gone, parts=1)
    assert [r["modelname"] for r in spark.read.json(gone).collect()] == ["GONE"]
    assert json.loads(spark.read.text(out).first()[0])["dependencies"]["v1"]["runtime"] is None


def test_superseded_snapshots_go_and_the_registry_is_compacted(spark, scratch):
    store = os.path.join(scratch, "s")
    for n in (3, 4, 5):
        tables.persist(_view(spark, n), "V", "SP", store)
    tables.persist(_view(spark, 2), "W", "SP", store)
    tables.unpersist(spark, "W", "SP", store)
    assert tables.remove_superseded(spark, store) == 0  # too young
    assert tables.remove_superseded(spark, store, older_than_s=0) == 3  # two of V, one of W
    assert tables.read_registry(spark, store).count() == 2
    assert tables.read_view(spark, "V", "SP", store).count() == 5 and tables.read_view(spark, "W", "SP", store) is None


def test_approximate_profile_scans_once_and_a_staged_one_agrees(spark, scratch):
    from lakeward.operators import stats
    path = os.path.join(scratch, "t")
    _view(spark).write.parquet(path)
    df = spark.read.parquet(path)
    plan = stats.profile_simple(df, approx=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    rows = lambda x: sorted(tuple(r) for r in x.collect())
    assert rows(stats.profile_simple(df, staged=True)) == rows(stats.profile_simple(df))
