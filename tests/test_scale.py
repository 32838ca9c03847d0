"""Plan-shape checks for the scale rules: a key may hold a third of all rows."""

import re

from pyspark.sql import functions as F

from lakeward import sources
from lakeward.functions import keyed
from lakeward.functions.keyed import first_per_key, last_per_key
from lakeward.operators import lineage, outcomes as oc
from lakeward.session import BASE_CONF


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _hot_log(spark, n=3000):
    # one key holds a third of all runs
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("entity"),
        F.lit("S").alias("space"), F.col("id").alias("seq"), (F.col("id") % 2 == 0).alias("success"),
        (F.col("id") * 10).alias("run_time_ms"))


def test_first_and_last_are_partial_aggregates(spark):
    log = _hot_log(spark)
    for df in (first_per_key(log, ["entity"], ["seq"], ["success"]), last_per_key(log, ["entity"], ["seq"], ["success"])):
        plan = _plan(df)
        assert "partial_m" in plan and "Window" not in plan


def test_hot_key_report_is_exact(spark):
    log = _hot_log(spark)
    tasks = log.select("entity", "space").distinct()
    rep = oc.report_task_chains(tasks, log, ["seq"])
    hot = rep.filter(F.col("entity") == "HOT").first()
    assert hot["isCompleted"] is False and hot["runtime"] is None  # last HOT run: seq 2997 (odd -> failed)
    assert rep.count() == 2001
    assert "Window" not in _plan(rep)


def test_large_models_are_split_into_bounded_records(spark):
    models = spark.createDataFrame([("big", "B", "S", 0), ("small", "s", "S", 1)],
                                   "model_id string, name string, space_name string, position int")
    edges = spark.range(950).select(F.lit("big").alias("model_id"), F.col("id").cast("string").alias("view_id"),
                                    F.concat(F.lit("v"), F.col("id").cast("string")).alias("view_name")) \
        .unionByName(spark.createDataFrame([("small", "x", "vx")], "model_id string, view_id string, view_name string"))
    views = spark.createDataFrame([], "view_id string, space_name string, position int")
    nested = lineage.nested_export(lineage.model_edges(models, edges, views), parts=10)
    sizes = {(r["model_id"], r["part"]): len(r["dependencies"]) for r in nested.collect()}
    big = [v for (m, _), v in sizes.items() if m == "big"]
    assert sum(big) == 950 and len(big) == 10 and max(big) < 200
    assert [v for (m, _), v in sizes.items() if m == "small"] == [1]  # the same rule for a model of any size


def test_session_enables_adaptive_skew_handling():
    for k in ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled",
              "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled"):
        assert BASE_CONF[k] == "true"


_SKEW_CONF = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
              "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
              "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
              "spark.sql.adaptive.coalescePartitions.enabled": "false",
              "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}


def test_hot_view_is_split_in_space_resolution(spark):
    """J1 with one view held by a third of all model edges."""
    old = {k: spark.conf.get(k, None) for k in _SKEW_CONF}
    try:
        for k, v in _SKEW_CONF.items():
            spark.conf.set(k, v)
        n = 60000
        edges = spark.range(0, n, 1, 8).select(
            F.col("id").cast("string").alias("model_id"),
            F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.col("id").cast("string")).alias("view_id"),
            F.sha2(F.col("id").cast("string"), 256).alias("view_name"))
        views = spark.range(0, 3000, 1, 4).select(
            F.when(F.col("id") == 0, F.lit("HOT")).otherwise(F.col("id").cast("string")).alias("view_id"),
            F.lit("SP").alias("space_name"), F.col("id").alias("position"))
        j = lineage.map_views_to_spaces(edges, views)
        rows = j.collect()
        assert len(rows) == n and sum(1 for r in rows if r["view_id"] == "HOT" and r["view_space"] == "SP") == n // 3
        assert "skew=true" in j._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_skewed_key_is_split_by_adaptive_join(spark):
    """Result rows where one key holds a third of all rows, joined null-safely
    (sort-merge, broadcast disabled) to the latest outcome per key: AQE
    splits the hot partition instead of running it as one task."""
    from lakeward.functions.keyed import null_safe_join
    from lakeward.operators.outcomes import latest_outcomes
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.enabled",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor")
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "64k")
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "2")
        n = 60000
        results = spark.range(0, n, 1, 8).select(
            F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("entity"),
            F.lit("S").alias("space"), F.sha2(F.col("id").cast("string"), 256).alias("payload"))
        latest = latest_outcomes(_hot_log(spark, 3000), ["seq"], ["success"])
        j = null_safe_join(results, latest, ["entity", "space"], "left")
        assert len(j.collect()) == n
        final = j._jdf.queryExecution().executedPlan().toString()
        assert "isFinalPlan=true" in final and "skew=true" in final
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_hot_model_is_split_in_model_export(spark):
    """A1 long form with one model holding a third of all edges."""
    old = {k: spark.conf.get(k, None) for k in _SKEW_CONF}
    try:
        for k, v in _SKEW_CONF.items():
            spark.conf.set(k, v)
        n = 60000
        edges = spark.range(0, n, 1, 8).select(
            F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("m"), (F.col("id") % 5000).cast("string"))).alias("model_id"),
            F.col("id").cast("string").alias("view_id"), F.sha2(F.col("id").cast("string"), 256).alias("view_name"))
        models = spark.range(0, 5000, 1, 4).select(
            F.when(F.col("id") == 0, F.lit("HOT")).otherwise(F.concat(F.lit("m"), F.col("id").cast("string"))).alias("model_id"),
            F.lit("M").alias("name"), F.lit("S").alias("space_name"), F.col("id").alias("position"))
        views = spark.createDataFrame([], "view_id string, space_name string, position int")
        lf = lineage.model_edges(models, edges, views)
        rows = lf.collect()
        assert sum(1 for r in rows if r["model_id"] == "HOT") == n // 3
        assert "skew=true" in lf._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _filed(spark, scratch, n=400):
    """Models, edges (every row twice) and views read from files."""
    models = spark.range(7).selectExpr("id AS model_id", "concat('m', id) AS name", "concat('s', id % 2) AS space_name", "id AS position")
    edges = spark.range(2 * n).selectExpr("id % 5 AS model_id", f"id % {n} AS view_id", f"concat('v', id % {n}) AS view_name")
    views = spark.range(n // 2).selectExpr("id AS view_id", "concat('p', id % 3) AS space_name", "id AS position")
    frames = []
    for k, df in enumerate((models, edges, views)):
        df.write.parquet(f"{scratch}/t{k}")
        frames.append(spark.read.parquet(f"{scratch}/t{k}"))
    return frames


def _dealt(df, *keys):
    """Tasks of the shuffles by ``keys`` whose number the library sets."""
    columns = ", ".join(k + r"#\d+L?" for k in keys)
    return [int(x) for x in re.findall(rf"(?:hash|range)partitioning\({columns}, (\d+)\), REPARTITION_BY_NUM", _plan(df))]


def test_tasks_grow_with_the_files(spark, tmp_path, monkeypatch):
    models, edges, _ = _filed(spark, str(tmp_path))
    least = spark.sparkContext.defaultParallelism
    assert keyed.task_count(edges) == least and keyed.task_count(spark.range(3)) is None
    size = sum(f.stat().st_size for f in tmp_path.glob("t1/*.parquet"))
    monkeypatch.setattr(keyed, "BYTES_PER_TASK", 1000)
    assert keyed.task_count(edges) == max(least, -(-size // 1000))
    assert keyed.task_count(models.join(edges, "model_id")) > keyed.task_count(edges)


def test_distinct_edges_are_dealt_by_input_size(spark, tmp_path, monkeypatch):
    models, edges, views = _filed(spark, str(tmp_path))
    monkeypatch.setattr(keyed, "BYTES_PER_TASK", 1000)
    n = keyed.task_count(edges)
    lf = lineage.model_edges(models, edges, views)
    assert n in _dealt(lf, "model_id", "view_id")
    # two of the seven models hold no view
    assert lf.filter("view_id IS NOT NULL").count() == edges.distinct().count() and lf.filter("view_id IS NULL").count() == 2


def test_range_files_are_dealt_by_input_size(spark, tmp_path, monkeypatch):
    models, edges, views = _filed(spark, str(tmp_path))
    monkeypatch.setattr(keyed, "BYTES_PER_TASK", 1000)
    rows = lineage.model_edges(models, edges, views).withColumnRenamed("model_space", "space_name")
    n = keyed.task_count(rows)
    sources.write_model_rows(rows, f"{tmp_path}/out")
    back = spark.read.json(f"{tmp_path}/out")
    assert back.count() == rows.count() and back.select("model_id", "view_id").distinct().count() == rows.count()
    files = back.select(F.input_file_name()).distinct().count()
    assert files > 8 and files > n // 2


def test_nested_records_are_dealt_by_input_size(spark, tmp_path, monkeypatch):
    models, edges, views = _filed(spark, str(tmp_path))
    monkeypatch.setattr(keyed, "BYTES_PER_TASK", 1000)
    lf = lineage.model_edges(models, edges, views)
    nested = lineage.nested_export(lf, 4)
    assert keyed.task_count(lf) in _dealt(nested, "model_id", "part")
    assert nested.select("model_id", "part").distinct().count() == nested.count() == 5 * 4 + 2
    assert nested.agg(F.sum(F.size("dependencies"))).first()[0] == edges.distinct().count()


def test_first_models_are_dealt_by_input_size(spark, tmp_path, monkeypatch):
    models, edges, views = _filed(spark, str(tmp_path))
    edges = edges.unionByName(edges.withColumn("model_id", F.col("model_id") + 1))  # two models for each view
    monkeypatch.setattr(keyed, "BYTES_PER_TASK", 1000)
    firsts = lineage.first_model_per_view(edges, models)
    assert _dealt(firsts, "view_id", "_part") and _dealt(firsts, "view_id")
    assert {(r["view_id"], r["model_id"]) for r in firsts.collect()} == {(v, v % 5) for v in range(400)}
    assert firsts.count() == 400


def test_requested_edges_are_dealt_by_input_size(spark, tmp_path, monkeypatch):
    models, edges, views = _filed(spark, str(tmp_path))
    requests = models.selectExpr("name AS modelname", "space_name AS space").filter("modelname < 'm3'")
    monkeypatch.setattr(keyed, "BYTES_PER_TASK", 1000)
    work = lineage.requested_model_edges(requests, models, edges, views)
    assert keyed.task_count(edges) in _dealt(work, "model_id", "view_id")
    assert work.count() == work.distinct().count() == edges.distinct().filter("model_id < 3").count()
