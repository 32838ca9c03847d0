"""Runs that are cut off: resumed task lists, measured models, atomic commits
of yearly tables; and task lists decided by one join."""

import os

import pytest
from pyspark.sql import functions as F

from lakeward import actions, sources
from lakeward.operators import outcomes as oc
from lakeward.operators import runs, tables

REF = "entity string, space string"


class Killed(BaseException):
    """Ends the driver's loop as a signal would; not an error of a task."""


def _view(spark, rows=40):
    return spark.range(rows).select("id", F.concat(F.lit("200"), (F.col("id") % 4).cast("string")).alias("year"))


def _file(path, header, rows):
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(header + "\n" + "".join(",".join(r) + "\n" for r in rows))
    return path


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_a_killed_run_keeps_its_outcomes_and_resumes(spark, scratch, monkeypatch):
    monkeypatch.setattr(runs, "WINDOW", 2)
    store, out = os.path.join(scratch, "s"), os.path.join(scratch, "out")
    names = [f"V{i}" for i in range(6)]
    path = _file(os.path.join(scratch, "t.csv"), "entity,space", [(n, "SP") for n in names])
    asked, dies = [], [True]

    def views(entity, space):
        if dies[0] and len(asked) == 3:  # in the second window
            raise Killed
        asked.append(entity)
        return None if entity == "V5" else _view(spark)

    with pytest.raises(Killed):
        actions.persist_views(spark, path, runs.persisting(views, store, 1, run="r/1"), ["seq"], out)
    # the report has a row per task from the start; the log holds the first window
    assert _rows(sources.read_results(spark, out, "VIEW_PERSIST_RESULT").select("entity", "isPersisted")) == [(n, False) for n in names]
    logged = {r["entity"] for r in runs.outcomes_of(spark, store, "r/1").collect()}
    assert len(logged) == 2
    now = actions.current_report(spark, "VIEW_PERSIST", path, store, "r/1", out)
    assert {r["entity"] for r in now.collect() if r["isPersisted"]} == logged - {"V5"}

    dies[0], before = False, list(asked)
    actions.persist_views(spark, path, runs.persisting(views, store, 1, run="r/1"), ["seq"], out)
    assert not set(asked[len(before):]) & logged and len(asked) == len(before) + 4
    done = sources.read_results(spark, out, "VIEW_PERSIST_RESULT")
    assert {r["entity"]: r["isPersisted"] for r in done.collect()} == {n: n != "V5" for n in names}
    actions.persist_views(spark, path, runs.persisting(views, store, 1, run="r/1"), ["seq"], out)
    assert len(asked) == len(before) + 4  # nothing left to do


def _models(spark):
    models = spark.createDataFrame([("m1", "M1", "SP", 0), ("m2", "M2", "SP", 1)], "model_id string, name string, space_name string, position int")
    edges = spark.createDataFrame([("m1", "v1", "A"), ("m1", "v2", "B"), ("m2", "v1", "A"), ("m2", "v3", "C"), ("m2", "v4", "LOST"), ("m1", "v5", "GONE")],
                                  "model_id string, view_id string, view_name string")
    views = spark.createDataFrame([("v1", "SP", 0), ("v2", "SP", 1), ("v3", "SP", 2), ("v5", "SP", 3)], "view_id string, space_name string, position int")
    return models, edges, views


def test_model_runtimes_survive_a_kill(spark, scratch, monkeypatch):
    monkeypatch.setattr(runs, "WINDOW", 1)
    store, out, gone = (os.path.join(scratch, n) for n in ("s", "out", "gone"))
    path = _file(os.path.join(scratch, "t.csv"), "modelname,space", [("M1", "SP"), ("M2", "SP"), ("M9", "SP")])
    tables.persist(_view(spark, 3), "B", "SP", store)
    asked, dies = [], [True]

    def views(entity, space):
        if dies[0] and len(asked) == 2:
            raise Killed
        asked.append(entity)
        return None if entity == "GONE" else _view(spark)

    def measure():
        return actions.measure_model_runtimes(spark, path, *_models(spark), views, store, out, run="run", parallelism=1, not_found=gone)

    with pytest.raises(Killed):
        measure()
    assert spark.read.json(out).count() == 6  # the defaults
    dies[0] = False
    rep = {(r["model_id"], r["view_id"]): (r["alreadyPersisted"], r["removedPersistence"]) for r in measure().collect()}
    assert rep == {("m1", "v1"): (False, True), ("m1", "v2"): (True, False), ("m1", "v5"): (False, False),
                   ("m2", "v1"): (False, True), ("m2", "v3"): (False, True), ("m2", "v4"): (False, False)}
    # shared views are run once, those that were logged are not run again, one without a space never
    assert sorted(asked) == ["A", "B", "C", "GONE"]
    assert _rows(tables.persisted_views(spark, store).select("entity")) == [("B",)]
    assert tables.read_view(spark, "B", "SP", store).count() == 40
    outcome = {r["entity"]: (r["outcome"], r["run_time_ms"] is not None) for r in runs.outcomes_of(spark, store, "run").collect()}
    assert outcome == {"A": ("removed", True), "B": ("kept", True), "C": ("removed", True), "GONE": ("failed", False)}
    assert [r["modelname"] for r in spark.read.json(gone).collect()] == ["M9"]
    assert {r["view_id"] for r in spark.read.json(out).filter("removedPersistence").collect()} == {"v1", "v3"}


def _jobs(spark, name, work):
    spark.sparkContext.setJobGroup(name, name)
    try:
        got = work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return got, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_set_runners_take_as_many_jobs_for_any_number_of_tasks(spark, scratch):
    store = os.path.join(scratch, "s")
    views = {("V", "SP"): _view(spark), ("W", "SP"): _view(spark)}
    part = spark.createDataFrame([("V", "SP", "year")], REF + ", attribute string")
    runs.partitioning(views, store, 2000, 2003)(part)
    runs.persisting({("W", "SP"): _view(spark)}, store)(spark.createDataFrame([("W", "SP")], REF))
    few = spark.createDataFrame([("V", "SP"), ("V", "SP"), ("X", "SP"), (None, "SP")], REF)
    many = few.union(spark.range(3000).selectExpr("concat('N', id)", "'SP'"))
    for name, runner in (("lock", lambda: runs.locking(store, 2001)), ("unlock", lambda: runs.unlocking(store)), ("unpersist", lambda: runs.unpersisting(store))):
        _, a = _jobs(spark, name + "-few", lambda: runner()(few))
        out, b = _jobs(spark, name + "-many", lambda: runner()(many))
        assert b <= a + 1, name
        assert out.count() == 3003
    assert runs.layouts(spark, store).first()["locked_until"] is None


def test_decided_runs_are_resumed_between_outcomes_and_log(spark, scratch):
    store = os.path.join(scratch, "s")
    runs.persisting({("V", "SP"): _view(spark)}, store)(spark.createDataFrame([("V", "SP")], REF))
    tasks = spark.createDataFrame([("V", "SP"), ("X", "SP")], REF)
    first = _rows(runs.unpersisting(store, run="u")(tasks))
    assert [(r[0], r[4], r[6]) for r in first] == [("V", True, "removed"), ("X", False, "failed")]
    assert "X" in first[1][7] and tables.read_view(spark, "V", "SP", store) is None
    # cut off after the outcomes: the registry rows are missing and are written again
    tables.delete(spark, f"{store}/_registry/u")
    assert tables.read_view(spark, "V", "SP", store) is not None
    assert _rows(runs.unpersisting(store, run="u")(tasks)) == first
    assert tables.read_view(spark, "V", "SP", store) is None
    assert _rows(oc.report_unpersist(tasks, runs.outcomes_of(spark, store, "u"), ["seq"])) == [("V", "SP", True), ("X", "SP", False)]


def _by_year(df):
    return {r["year"]: r["count"] for r in df.groupBy("year").count().collect()}


@pytest.mark.parametrize("broken", ["_write_partitioned", "_commit", "append_log"])
def test_a_repersist_that_is_cut_off_loses_no_year(spark, scratch, monkeypatch, broken):
    path = os.path.join(scratch, "t")
    tables.partition_by_year(_view(spark), "year", 2000, 2004, path)
    before = tables.read_partitioned(spark, path)
    whole = getattr(tables, broken)

    def dies(*args):
        if broken == "_write_partitioned":
            whole(*args)  # everything is written, nothing is committed
        raise Killed

    with monkeypatch.context() as m:
        m.setattr(tables, broken, dies)
        with pytest.raises(Killed):
            tables.repersist(_view(spark, 8), path, "year", 2000, 2004, ["2000"])
    full = {"2000": 10, "2001": 10, "2002": 10, "2003": 10}
    assert _by_year(tables.read_partitioned(spark, path)) == full
    assert tables.repersist(_view(spark, 8), path, "year", 2000, 2004, ["2000"]) == ["2001", "2002", "2003"]
    assert _by_year(tables.read_partitioned(spark, path)) == {"2000": 10, "2001": 2, "2002": 2, "2003": 2}
    assert _by_year(before) == full  # readers at work keep their files
    assert tables.remove_old_versions(spark, path) == 0  # too young
    assert tables.remove_old_versions(spark, path, older_than_s=0) >= 3
    assert _by_year(tables.read_partitioned(spark, path)) == {"2000": 10, "2001": 2, "2002": 2, "2003": 2}
    assert tables.remove_old_versions(spark, path, older_than_s=0) == 0


def test_yearly_table_without_rows_and_with_new_columns(spark, scratch):
    path = os.path.join(scratch, "t")
    assert tables.partition_by_year(_view(spark).filter("false"), "year", 2000, 2003, path) == "created"
    assert tables.partition_by_year(_view(spark), "year", 2000, 2003, path) == "exists"
    assert tables.read_partitioned(spark, path).count() == 0 and tables.stored_partitions(spark, path) == []
    tables.repersist(_view(spark), path, "year", 2000, 2003, [])
    tables.repersist(_view(spark).withColumn("more", F.lit(1)), path, "year", 2000, 2003, ["2001"])
    got = {r["partition"]: r["n"] for r in tables.read_partitioned(spark, path).groupBy("partition").agg(F.count("more").alias("n")).collect()}
    assert got == {"2000": 10, "2001": 0, "2002": 10, "rest": 10}


def test_names_do_not_leave_the_store_or_collide(spark, scratch):
    store = os.path.join(scratch, "in", "s")
    names = [("a/b", "c"), ("b", "c/a"), ("..", ".."), ("x y%", "{z}*"), ("a%2Fb", "c")]
    for n, (entity, space) in enumerate(names):
        tables.persist(_view(spark, n + 1), entity, space, store)
        runs.partitioning({(entity, "p" + space): _view(spark, n + 1)}, store, 2000, 2004)(
            spark.createDataFrame([(entity, "p" + space, "year")], REF + ", attribute string"))
    for n, (entity, space) in enumerate(names):
        assert tables.read_view(spark, entity, space, store).count() == n + 1
        assert tables.read_view(spark, entity, "p" + space, store).count() == n + 1
    assert os.listdir(scratch) == ["in"] and os.listdir(os.path.join(scratch, "in")) == ["s"]


def test_removed_layout_stays_for_readers_until_cleaned(spark, scratch):
    store = os.path.join(scratch, "s")
    tasks = spark.createDataFrame([("V", "SP", "year")], REF + ", attribute string")
    runs.partitioning({("V", "SP"): _view(spark)}, store, 2000, 2004)(tasks)
    reader = tables.read_view(spark, "V", "SP", store)
    runs.unpartitioning(store)(tasks)
    assert reader.count() == 40 and tables.read_view(spark, "V", "SP", store).count() == 40
    assert tables.remove_superseded(spark, store, older_than_s=0) == 1
    assert not os.path.exists(runs.layout_path(store, "V", "SP"))
    assert runs.partitioning({("V", "SP"): _view(spark)}, store, 2000, 2004)(tasks).first()["outcome"] == "created"
    assert tables.remove_superseded(spark, store, older_than_s=0) == 1  # the plain snapshot; the layout is in use again
    assert _by_year(tables.read_view(spark, "V", "SP", store))["2003"] == 10


def test_long_export_spreads_a_hot_model(spark, scratch):
    models = spark.createDataFrame([("hot", "H", "SP", 0), ("none", "N", "SP", 1)], "model_id string, name string, space_name string, position int")
    edges = spark.range(2000).selectExpr("'hot' AS model_id", "concat('v', id) AS view_id", "concat('V', id) AS view_name")
    views = spark.createDataFrame([("v1", "SP", 0)], "view_id string, space_name string, position int")
    out = os.path.join(scratch, "out")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        actions.export_models(models, edges, views, out)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    back = spark.read.json(out)
    assert back.count() == 2001 and back.filter("view_id is null").first()["model_id"] == "none"
    per_file = back.filter("model_id = 'hot'").groupBy(F.input_file_name()).count().collect()
    assert len(per_file) > 2 and max(r["count"] for r in per_file) < 1000


def test_row_index_gives_the_order_inside_a_split_file(spark, scratch):
    path = os.path.join(scratch, "views")
    rows = spark.range(5000).select(F.lit("v").alias("id"), F.format_string("%05d", "id").alias("name"), F.format_string("%05d", "id").alias("space_name"),
                                    F.lit("b").alias("business_name"))
    rows.coalesce(1).write.option("parquet.block.size", 4096).parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 3000)
    try:
        v = sources.scan_catalog(spark, path, "views")
        assert v.rdd.getNumPartitions() > 1
        names = [r["name"] for r in v.orderBy("position").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert names == sorted(names) and len(names) == 5000
