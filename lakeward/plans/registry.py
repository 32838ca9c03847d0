"""Registry of named queries: name -> callable(spark, sf_dir) -> DataFrame.

Each query reads the whole synthetic tables (through the roles in
``fixtures``) and runs one toolkit operator on them.  The matching DuckDB
oracle for each lives in ``oracles``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeward import actions, sources
from lakeward.operators import lineage, outcomes as oc, runs, search, stats, tables
from lakeward.plans import fixtures as fx
from lakeward.session import scratch_path
from lakeward.streaming import upsert as st

Query = Callable[[SparkSession, str], DataFrame]


# --- lineage ------------------------------------------------------------------

def export_models_long(spark, d):
    return lineage.model_edges(fx.models(spark, d), fx.edges(spark, d), fx.views(spark, d))


def export_models_dedup(spark, d):
    return lineage.first_model_per_view(fx.edges(spark, d), fx.models(spark, d))


def export_models_dedup_all(spark, d):
    lf = lineage.model_edges(fx.models(spark, d), fx.edges(spark, d), fx.views(spark, d), skip_duplicates=True)
    return lf.groupBy("model_id", "model_name", "model_space").agg(
        F.count("view_id").alias("n_views"), F.count("view_space").alias("n_resolved"))


def export_models_nested(spark, d):
    lf = lineage.model_edges(fx.models(spark, d), fx.edges(spark, d), fx.views(spark, d))
    return _flat_models(lineage.nested_export(lf, NESTED_PARTS))


NESTED_PARTS = 16  # records per model


def _flat_models(nested):
    """A nested export as rows, so that SQL can be held against it."""
    e = nested.select("model_id", F.col("name").alias("model_name"), F.col("space_name").alias("model_space"), F.explode_outer("dependencies"))
    return e.select("model_id", "model_name", "model_space", F.col("key").cast("bigint").alias("view_id"),
                    F.col("value.name").alias("view_name"), F.col("value.space").alias("view_space"))


def models_in_space(spark, d):
    return lineage.model_edges(fx.models(spark, d), fx.edges(spark, d), fx.views(spark, d),
                               skip_duplicates=True, space=fx.MODEL_SPACE)


def resolve_models(spark, d):
    return lineage.resolve_models(fx.requests(spark, d), fx.models(spark, d))


def unresolved_models(spark, d):
    return lineage.unresolved_models(fx.requests(spark, d), fx.models(spark, d))


def persist_worklist(spark, d):
    e = lineage.requested_model_edges(fx.requests(spark, d), fx.models(spark, d),
                                      fx.edges(spark, d), fx.views(spark, d))
    return lineage.persist_worklist(e, unique=True)


# --- search -----------------------------------------------------------------------

def best_candidates(spark, d):
    return search.best_persistence_candidates(fx.analyser_stats(spark, d), ["view_id"], fx.ANALYSER_ORDER)


def attributes_containing(spark, d):
    return search.attributes_containing(fx.attribute_views(spark, d), fx.SEARCH_WORD)


# --- outcome reports --------------------------------------------------------------

def report_persist(spark, d):
    return oc.report_persist(fx.tasks(spark, d), fx.run_log(spark, d), fx.RUN_ORDER, timer=True)


def report_unpersist(spark, d):
    return oc.report_unpersist(fx.tasks(spark, d), fx.run_log(spark, d), fx.RUN_ORDER)


def report_task_chains(spark, d):
    return oc.report_task_chains(fx.tasks(spark, d), fx.run_log(spark, d), fx.RUN_ORDER)


def report_partition_create(spark, d):
    return oc.report_partition_create(fx.partition_tasks(spark, d), fx.partition_outcomes(spark, d, "create"),
                                      fx.RUN_ORDER)


def report_partition_delete(spark, d):
    return oc.report_partition_delete(fx.tasks(spark, d), fx.run_log(spark, d), fx.RUN_ORDER)


def report_lock(spark, d):
    return oc.report_lock(fx.tasks(spark, d), fx.partition_outcomes(spark, d, "lock"), fx.RUN_ORDER)


def report_unlock(spark, d):
    return oc.report_unlock(fx.tasks(spark, d), fx.partition_outcomes(spark, d, "unlock"), fx.RUN_ORDER)


def upsert_results(spark, d):
    """Task-chain results filled from the early runs, then the later runs
    merged in (last wins; runs of keys without a result row are ignored; the
    extra ``k`` column is not a result column and is dropped)."""
    results = oc.report_task_chains(fx.result_tasks(spark, d), fx.early_runs(spark, d), fx.RUN_ORDER)
    return oc.upsert_results(results, fx.later_runs(spark, d), fx.RUN_ORDER)


def runtime_report(spark, d):
    return oc.runtime_report(fx.requests(spark, d), fx.models(spark, d), fx.edges(spark, d), fx.views(spark, d),
                             fx.persisted_views(spark, d), fx.persist_outcomes(spark, d),
                             fx.unpersist_outcomes(spark, d), fx.PART_RUN_ORDER)


def runtime_report_nested(spark, d):
    e = oc.runtime_report_nested(runtime_report(spark, d), NESTED_PARTS).select("model_id", F.col("name").alias("model_name"), F.explode("dependencies"))
    return e.select("model_id", "model_name", F.col("key").cast("bigint").alias("view_id"), F.col("value.space").alias("view_space"),
                    F.col("value.name").alias("view_name"), "value.runtime", "value.alreadyPersisted", "value.removedPersistence")


# --- statistics -------------------------------------------------------------------

HISTOGRAM_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
HISTOGRAM_BINS = 10


def plan_statistics(spark, d):
    return stats.plan_statistics(fx.statistics_catalog(spark, d), fx.STATISTICS_REQUEST)


def plan_refresh(spark, d):
    return stats.plan_refresh(fx.statistics_catalog(spark, d))


def profile_record_count(spark, d):
    out = None
    for name in fx.PROFILED_TABLES:
        one = stats.profile_record_count(fx.table(spark, d, name)).select(
            F.lit(name).alias("table_name"), "record_count")
        out = one if out is None else out.unionByName(one)
    return out


def profile_simple(spark, d):
    return stats.profile_simple(fx.table(spark, d, "lineitem"))


def profile_histogram(spark, d):
    return stats.profile_histogram(fx.table(spark, d, "lineitem"), HISTOGRAM_COLUMNS, HISTOGRAM_BINS)


def refresh_profiles(spark, d):
    """Refresh the SIMPLE profiles of the profiled tables and read the store back."""
    catalog = spark.createDataFrame([(t, True, "SIMPLE") for t in fx.PROFILED_TABLES],
                                    "table_name string, statistics_supported boolean, statistics_type string")
    store = scratch_path(spark, "profiles")
    stats.refresh_profiles(spark, catalog, {t: fx.table(spark, d, t) for t in fx.PROFILED_TABLES}, store)
    return stats.read_profiles(spark, store, "SIMPLE")


def create_statistics(spark, d):
    """Create RECORD_COUNT statistics for the profiled tables -- lineitem has
    none yet (create), orders has SIMPLE (update), customer does not support
    statistics (skip) -- and report each outcome with the stored count."""
    catalog = spark.createDataFrame(
        [("lineitem", True, None), ("orders", True, "SIMPLE"), ("customer", False, None)],
        "table_name string, statistics_supported boolean, statistics_type string")
    store = scratch_path(spark, "profiles")
    out = stats.create_statistics(spark, catalog, "RECORD_COUNT",
                                  {t: fx.table(spark, d, t) for t in fx.PROFILED_TABLES}, store)
    counts = stats.read_profiles(spark, store, "RECORD_COUNT")
    return out.join(counts, "table_name", "left").select("table_name", "action", "status", "record_count")


# --- yearly partitions and persistence -------------------------------------------------

PARTITION_START, PARTITION_END, LOCK_UNTIL = 1993, 2002, 1997


def _ship_years(spark, d):
    return fx.table(spark, d, "lineitem").withColumn("ship_year", F.year("l_shipdate").cast("string"))


def _year_totals(df, by):
    return df.groupBy(F.col(by).alias("partition")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("l_quantity").alias("sum_qty"))


def year_ranges(spark, d):
    return tables.data_year_ranges(fx.table(spark, d, "lineitem"), "l_shipdate")


def partition_summary(spark, d):
    return tables.partition_summary(_ship_years(spark, d), "ship_year", PARTITION_START, PARTITION_END)


def lock_partitions(spark, d):
    return tables.lock_partitions(year_ranges(spark, d), LOCK_UNTIL)


def unlock_partitions(spark, d):
    return tables.unlock_partitions(lock_partitions(spark, d))


def partition_by_year(spark, d):
    path = scratch_path(spark, "by_year")
    tables.partition_by_year(_ship_years(spark, d), "ship_year", PARTITION_START, PARTITION_END, path)
    return _year_totals(tables.read_partitioned(spark, path), tables.PARTITION_COL)


def unpartition(spark, d):
    path, out = scratch_path(spark, "by_year"), scratch_path(spark, "flat")
    tables.partition_by_year(_ship_years(spark, d), "ship_year", PARTITION_START, PARTITION_END, path)
    tables.unpartition(spark, path, out)
    return _year_totals(spark.read.parquet(out), "ship_year")


def repersist(spark, d):
    """Persist lineitem by ship year, lock the years up to 1997, then persist
    the open lines only: locked years keep every line, the others now hold
    open lines only."""
    path = scratch_path(spark, "by_year")
    src = _ship_years(spark, d)
    tables.partition_by_year(src, "ship_year", PARTITION_START, PARTITION_END, path)
    ranges = tables.lock_partitions(tables.year_ranges(spark, PARTITION_START, PARTITION_END), LOCK_UNTIL)
    # Ranges come from the (parameter-sized) bounds, not from data rows.
    locked = [r["partition"] for r in ranges.filter("locked").select("partition").collect()]
    tables.repersist(src.filter(F.col("l_linestatus") == "O"), path, "ship_year",
                     PARTITION_START, PARTITION_END, locked)
    return _year_totals(tables.read_partitioned(spark, path), tables.PARTITION_COL)


def persist_view(spark, d):
    """Materialise a view over orders, register it and read it back through
    the registry."""
    store = scratch_path(spark, "store")
    view = fx.table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(
        F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total_price"))
    tables.persist(view, "orders_by_status", "SALES", store)
    return tables.read_view(spark, "orders_by_status", "SALES", store)


# --- sources, sinks and streaming ------------------------------------------------------

def scan_tasks(spark, d):
    path = scratch_path(spark, "tasks")
    sources.append_results(fx.tasks(spark, d), path, "VIEW_PERSIST")
    return sources.scan_tasks(spark, path, "VIEW_PERSIST")


def results_roundtrip(spark, d):
    path = scratch_path(spark, "results")
    sources.reset_results(spark, path, "VIEW_PERSIST_RESULT")
    sources.append_results(report_persist(spark, d), path, "VIEW_PERSIST_RESULT")
    return sources.read_results(spark, path, "VIEW_PERSIST_RESULT")


def export_roundtrip(spark, d):
    """Nested model export written as JSON Lines and flattened again."""
    path = scratch_path(spark, "export")
    lf = lineage.model_edges(fx.models(spark, d), fx.edges(spark, d), fx.views(spark, d))
    sources.write_model_export(lineage.nested_export(lf, NESTED_PARTS), path)
    back = spark.read.schema("model_id bigint, name string, part int, "
                             "dependencies map<string, struct<space: string, name: string>>").json(path)
    return back.select("model_id", F.col("name").alias("model_name"), F.explode("dependencies")) \
        .select("model_id", "model_name", F.col("key").cast("bigint").alias("view_id"),
                F.col("value.name").alias("view_name"), F.col("value.space").alias("view_space"))


def export_by_space_roundtrip(spark, d):
    """Space-scoped nested export (one folder per space, skip_duplicates on)
    flattened again, with the space taken from the folder name."""
    path = scratch_path(spark, "export_by_space")
    lf = lineage.model_edges(fx.models(spark, d), fx.edges(spark, d), fx.views(spark, d), skip_duplicates=True)
    sources.write_model_export(lineage.nested_export(lf, NESTED_PARTS), path, by_space=True)
    back = spark.read.schema("model_id bigint, name string, part int, space_name string, "
                             "dependencies map<string, struct<space: string, name: string>>").json(path)
    return back.select("model_id", "space_name", F.explode("dependencies")).select(
        "model_id", F.col("space_name").alias("model_space"), F.col("key").cast("bigint").alias("view_id"),
        F.col("value.name").alias("view_name"), F.col("value.space").alias("view_space"))


def _model_rows(spark, path):
    schema = "model_id bigint, model_name string, view_id bigint, view_name string, view_space string, space_name string"
    return spark.read.schema(schema).json(path).withColumnRenamed("space_name", "model_space")


def export_rows_roundtrip(spark, d):
    """The export action in its long form, one line per model and view, read back."""
    path = scratch_path(spark, "export_rows")
    actions.export_models(fx.models(spark, d), fx.edges(spark, d), fx.views(spark, d), path)
    return _model_rows(spark, path)


def export_space_rows_roundtrip(spark, d):
    """The same for one space, whose name is the folder's."""
    path = scratch_path(spark, "export_space_rows")
    actions.export_models(fx.models(spark, d), fx.edges(spark, d), fx.views(spark, d), path, skip_duplicates=True, space=fx.MODEL_SPACE)
    return _model_rows(spark, path)


def persisted_flag(spark, d):
    """Persist one view per order status of ``fx.PERSISTED_STATUSES``,
    unpersist the one for ``fx.UNPERSISTED_STATUS``, then flag every
    per-status view of the orders table from the registry state."""
    store = scratch_path(spark, "store")
    orders = fx.table(spark, d, "orders")
    for stt in fx.PERSISTED_STATUSES:
        tables.persist(orders.filter(F.col("o_orderstatus") == stt), f"orders_{stt}", "SALES", store)
    tables.unpersist(spark, f"orders_{fx.UNPERSISTED_STATUS}", "SALES", store)
    views = orders.select(F.concat(F.lit("orders_"), F.col("o_orderstatus")).alias("entity"),
                          F.lit("SALES").alias("space")).distinct()
    return tables.with_persisted_flag(views, spark, store)


def catalog_edges_roundtrip(spark, d):
    """Model-to-view edges written in the source's nested answer format and
    scanned back (S2)."""
    path = scratch_path(spark, "edges_json")
    sources.write_edges_catalog(fx.edges(spark, d), path)
    e = sources.scan_catalog(spark, path, "edges")
    return e.select(F.col("model_id").cast("bigint").alias("model_id"),
                    F.col("view_id").cast("bigint").alias("view_id"), "view_name")


def _streamed(spark, d, **options):
    results = oc.report_task_chains(fx.result_tasks(spark, d), fx.early_runs(spark, d), fx.RUN_ORDER)
    src, res, ckpt = scratch_path(spark, "runs"), scratch_path(spark, "results"), scratch_path(spark, "ckpt")
    later = fx.later_runs(spark, d)
    later.repartition(4).write.parquet(src)
    st.init_results(results, res, "entity string, space string, ts timestamp_ntz, event_id bigint, k int, "
                                  "isCompleted boolean, runtime bigint")
    stream = spark.readStream.schema(later.schema).option("maxFilesPerTrigger", 1).parquet(src)
    st.stream_upsert(stream, res, ckpt, **options).awaitTermination()
    return res


def stream_upsert(spark, d):
    """The ``upsert_results`` merge run as a stream: later runs arrive as
    parquet files, micro-batch by micro-batch, in the store's log."""
    return st.current_results(spark, _streamed(spark, d), fx.RUN_ORDER)


def stream_upsert_folded(spark, d):
    """The same; every third batch folds the log, the last one is read as it
    came."""
    return st.current_results(spark, _streamed(spark, d, fold_every=3, order=fx.RUN_ORDER), fx.RUN_ORDER)


# --- actions: task files that order work, the work, and its report -----------------------

ACTION_LOCK_UNTIL = 1997


def _order_views(spark, d, urgent_only=False):
    """One view per order status, with the year of the order."""
    orders = fx.table(spark, d, "orders").withColumn("order_year", F.year("o_orderdate").cast("string"))
    if urgent_only:
        orders = orders.filter(F.col("o_orderpriority") == "1-URGENT")
    return {(f"orders_{s}", "SALES"): orders.filter(F.col("o_orderstatus") == s) for s in fx.PERSISTED_STATUSES}


def _task_file(spark, kind, statuses):
    path = scratch_path(spark, "tasks")
    rows = [(f"orders_{s}", "SALES", "order_year") for s in statuses]
    sources.append_results(spark.createDataFrame(rows, "entity string, space string, attribute string"), path, kind)
    return path


def _with_rows(spark, report, store):
    """The report, and how many rows each view of the store now has by year."""
    seen = None
    for s in fx.PERSISTED_STATUSES:
        df = tables.read_view(spark, f"orders_{s}", "SALES", store)
        if df is not None:
            one = df.groupBy(F.lit(f"orders_{s}").alias("entity"), "order_year").agg(F.count(F.lit(1)).alias("n_rows"))
            seen = one if seen is None else seen.unionByName(one)
    empty = spark.createDataFrame([], "entity string, order_year string, n_rows bigint")
    return report.join(empty if seen is None else seen, "entity", "left")


def _create_partitions(spark, views, store, statuses):
    res = scratch_path(spark, "results")
    actions.create_partitioning_for_views(spark, _task_file(spark, "VIEW_PARTITIONING_CREATE", statuses),
                                          runs.partitioning(views, store, PARTITION_START, PARTITION_END), ["seq"], res)
    return sources.read_results(spark, res, "VIEW_PARTITIONING_CREATE_RESULT")


ALL_TASKS = [*fx.PERSISTED_STATUSES, "missing"]


def action_persist_views(spark, d):
    """Persist every status's view; the task of a view that does not exist fails."""
    store, res = scratch_path(spark, "store"), scratch_path(spark, "results")
    actions.persist_views(spark, _task_file(spark, "VIEW_PERSIST", ALL_TASKS), runs.persisting(_order_views(spark, d), store), ["seq"], res)
    report = sources.read_results(spark, res, "VIEW_PERSIST_RESULT").drop("runtime")
    return _with_rows(spark, report, store)


def action_unpersist_views(spark, d):
    """Two views are persisted, all are ordered to be unpersisted."""
    store, res = scratch_path(spark, "store"), scratch_path(spark, "results")
    runs.persisting(_order_views(spark, d), store)(sources.scan_tasks(spark, _task_file(spark, "VIEW_PERSIST", ["O", "F"]), "VIEW_PERSIST"))
    actions.unpersist_views(spark, _task_file(spark, "VIEW_UNPERSIST", ALL_TASKS), runs.unpersisting(store), ["seq"], res)
    orders = fx.table(spark, d, "orders").groupBy(F.concat(F.lit("orders_"), "o_orderstatus").alias("entity")).agg(F.count(F.lit(1)).alias("n_rows"))
    report = sources.read_results(spark, res, "VIEW_UNPERSIST_RESULT").join(orders, "entity", "left")
    return tables.with_persisted_flag(report, spark, store)


def action_create_partitioning(spark, d):
    """Partition every status's view by order year."""
    store = scratch_path(spark, "store")
    return _with_rows(spark, _create_partitions(spark, _order_views(spark, d), store, ALL_TASKS), store)


def action_remove_partitioning(spark, d):
    """Two views are partitioned, all are ordered to lose their partitions."""
    store, res = scratch_path(spark, "store"), scratch_path(spark, "results")
    _create_partitions(spark, _order_views(spark, d), store, ["O", "F"])
    actions.remove_partitioning_for_views(spark, _task_file(spark, "VIEW_PARTITIONING_DELETE", ALL_TASKS), runs.unpartitioning(store), ["seq"], res)
    return _with_rows(spark, sources.read_results(spark, res, "VIEW_PARTITIONING_DELETE_RESULT"), store)


def _locked_store(spark, d, res):
    store = scratch_path(spark, "store")
    _create_partitions(spark, _order_views(spark, d), store, ["O", "F"])
    actions.lock_partitions_until_year(spark, _task_file(spark, "VIEW_PARTITION_LOCK", ALL_TASKS),
                                       runs.locking(store, ACTION_LOCK_UNTIL), ["seq"], res)
    return store


def _persist_urgent(spark, d, store):
    out = scratch_path(spark, "results")
    actions.persist_views(spark, _task_file(spark, "VIEW_PERSIST", ["O", "F"]), runs.persisting(_order_views(spark, d, True), store), ["seq"], out)


def action_lock_partitions(spark, d):
    """Lock two views up to a year (the others have no partitions: no row),
    then persist their urgent orders only: locked years keep every order."""
    res = scratch_path(spark, "results")
    store = _locked_store(spark, d, res)
    _persist_urgent(spark, d, store)
    return _with_rows(spark, sources.read_results(spark, res, "VIEW_PARTITION_LOCK_RESULT"), store)


def action_unlock_partitions(spark, d):
    """As ``action_lock_partitions``, but unlocked before persisting again:
    every year holds the urgent orders only."""
    store, res = _locked_store(spark, d, scratch_path(spark, "results")), scratch_path(spark, "results")
    actions.unlock_all_partitions(spark, _task_file(spark, "VIEW_PARTITION_UNLOCK", ALL_TASKS), runs.unlocking(store), ["seq"], res)
    _persist_urgent(spark, d, store)
    return _with_rows(spark, sources.read_results(spark, res, "VIEW_PARTITION_UNLOCK_RESULT"), store)


def _status_models(spark, d):
    """Regions as models; the order statuses of their customers as views, of
    which the catalogue lacks the last."""
    nation = fx.table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("model_id"))
    customer = fx.table(spark, d, "customer").select("c_custkey", "c_nationkey")
    orders = fx.table(spark, d, "orders")
    status = F.col("o_orderstatus")
    edges = (orders.select("o_custkey", status.alias("view_id"), F.concat(F.lit("orders_"), status).alias("view_name"))
             .join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
             .select("model_id", "view_id", "view_name").distinct())
    models = fx.table(spark, d, "region").select(F.col("r_regionkey").alias("model_id"), F.col("r_name").alias("name"),
                                                 F.lit("REGIONS").alias("space_name"), F.col("r_regionkey").alias("position"))
    views = orders.select(status.alias("view_id")).distinct().filter(F.col("view_id") != fx.PERSISTED_STATUSES[-1]) \
        .select("view_id", F.lit("SALES").alias("space_name"), F.lit(0).alias("position"))
    return models, edges, views


def action_check_runtimes(spark, d):
    """Measure the views of all models: a view that all regions share is
    persisted once, one that was persisted before stays, one without a space
    is not run.  With the report: how often the view was run, the rows it was
    measured with, and whether it is persisted now."""
    store, out, tasks, run = (scratch_path(spark, n) for n in ("store", "report", "tasks", "run"))
    models, edges, views = _status_models(spark, d)
    asked = models.select(F.col("name").alias("modelname"), F.col("space_name").alias("space"))
    asked = asked.unionByName(spark.createDataFrame([("nowhere", "REGIONS")], asked.schema))
    sources.append_results(asked, tasks, "ANALYTICAL_MODELS_ALL_VIEWS_PERSISTENCE_TIME")
    definitions = _order_views(spark, d)
    tables.persist(definitions["orders_F", "SALES"], "orders_F", "SALES", store)
    actions.measure_model_runtimes(spark, tasks, models, edges, views, definitions, store, out, run=run)
    rep = spark.read.schema("model_id bigint, model_name string, view_id string, view_name string, view_space string, "
                            "alreadyPersisted boolean, removedPersistence boolean").json(out)
    runs_of = runs.outcomes_of(spark, store, run).groupBy("entity", "space").agg(F.count(F.lit(1)).alias("n_runs"))
    last = tables.read_registry(spark, store).filter("action = 'persist'").groupBy("entity").agg(F.max(F.struct("seq", "path")).alias("l"))
    rows = None
    for r in last.select("entity", "l.path").collect():  # the two views that were run
        one = spark.read.parquet(r["path"]).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(r["entity"]).alias("entity"), "n_rows")
        rows = one if rows is None else rows.unionByName(one)
    told = runs_of.join(rows, "entity").withColumnRenamed("space", "_s")
    joined = rep.join(told, (rep["view_name"] == told["entity"]) & (rep["view_space"] == told["_s"]), "left").drop("entity", "_s")
    return tables.with_persisted_flag(joined, spark, store, "view_name", "view_space")


# --- catalogue scans (S2) ------------------------------------------------------------------

def catalog_models(spark, d):
    path = scratch_path(spark, "catalog")
    fx.models(spark, d).withColumnRenamed("model_id", "id").write.json(path)
    return sources.scan_catalog(spark, path, "models", "json", stored_position=True)


def catalog_views(spark, d):
    path = scratch_path(spark, "catalog")
    fx.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("space_name"),
                                      F.col("p_type").alias("business_name"), F.col("p_partkey").cast("bigint").alias("position")).write.parquet(path)
    return sources.scan_catalog(spark, path, "views", stored_position=True)


def catalog_view_attributes(spark, d):
    path = scratch_path(spark, "catalog")
    v = fx.attribute_views(spark, d)
    v.select(F.col("entity").alias("id"), F.col("entity").alias("name"), F.col("space").alias("space_name"), F.col("businessName").alias("business_name"),
             "attributes", F.col("entity").cast("bigint").alias("position")).write.option("ignoreNullFields", False).json(path)
    back = sources.scan_catalog(spark, path, "view_attributes", "json", stored_position=True)
    return back.withColumn("attributes", F.array_join("attributes", " "))


def catalog_analyser_stats(spark, d):
    path = scratch_path(spark, "catalog")
    fx.analyser_stats(spark, d).select(F.col("view_id").cast("string").alias("view_id"), F.col("l_linenumber").cast("bigint").alias("position"), "entity", "space",
                                       "businessName", "isPersisted", F.col("persistencyCandidateScore").cast("int").alias("persistencyCandidateScore")).write.parquet(path)
    return sources.scan_catalog(spark, path, "analyser_stats")


def catalog_positions(spark, d):
    """Views catalogued in files of very different sizes, without a stored
    position: the first file that lists a view, and its first line there,
    give the view's space."""
    path = scratch_path(spark, "catalog")
    part = fx.table(spark, d, "part")
    named = part.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("space_name"),
                        F.col("p_type").alias("business_name"))
    few = named.filter(F.col("id").endswith("00"))
    both = named.select("id", "name", F.explode(F.array(F.lit("FIRST"), F.lit("SECOND"))).alias("space_name"), "business_name")
    for folder, rows, files in (("f0", few, 1), ("f1", both, 3), ("f2", named.withColumn("space_name", F.lit("LAST")), 2)):
        rows.repartitionByRange(files, "id").sortWithinPartitions("id", "space_name").write.parquet(f"{path}/{folder}")
    return lineage.first_space_per_view(sources.scan_catalog(spark, f"{path}/f*", "views"))


def catalog_tables(spark, d):
    path = scratch_path(spark, "catalog")
    fx.statistics_catalog(spark, d).write.json(path)
    return sources.scan_catalog(spark, path, "tables", "json")


QUERIES: dict[str, Query] = {
    "export_models_long": export_models_long,
    "export_models_dedup": export_models_dedup,
    "export_models_dedup_all": export_models_dedup_all,
    "export_models_nested": export_models_nested,
    "models_in_space": models_in_space,
    "resolve_models": resolve_models,
    "unresolved_models": unresolved_models,
    "persist_worklist": persist_worklist,
    "best_candidates": best_candidates,
    "attributes_containing": attributes_containing,
    "report_persist": report_persist,
    "report_unpersist": report_unpersist,
    "report_task_chains": report_task_chains,
    "report_partition_create": report_partition_create,
    "report_partition_delete": report_partition_delete,
    "report_lock": report_lock,
    "report_unlock": report_unlock,
    "upsert_results": upsert_results,
    "runtime_report": runtime_report,
    "runtime_report_nested": runtime_report_nested,
    "plan_statistics": plan_statistics,
    "plan_refresh": plan_refresh,
    "profile_record_count": profile_record_count,
    "profile_simple": profile_simple,
    "profile_histogram": profile_histogram,
    "refresh_profiles": refresh_profiles,
    "create_statistics": create_statistics,
    "year_ranges": year_ranges,
    "partition_summary": partition_summary,
    "lock_partitions": lock_partitions,
    "unlock_partitions": unlock_partitions,
    "partition_by_year": partition_by_year,
    "unpartition": unpartition,
    "repersist": repersist,
    "persist_view": persist_view,
    "scan_tasks": scan_tasks,
    "results_roundtrip": results_roundtrip,
    "export_roundtrip": export_roundtrip,
    "stream_upsert": stream_upsert,
    "stream_upsert_folded": stream_upsert_folded,
    "export_by_space_roundtrip": export_by_space_roundtrip,
    "export_rows_roundtrip": export_rows_roundtrip,
    "export_space_rows_roundtrip": export_space_rows_roundtrip,
    "persisted_flag": persisted_flag,
    "catalog_edges_roundtrip": catalog_edges_roundtrip,
    "action_persist_views": action_persist_views,
    "action_unpersist_views": action_unpersist_views,
    "action_create_partitioning": action_create_partitioning,
    "action_remove_partitioning": action_remove_partitioning,
    "action_lock_partitions": action_lock_partitions,
    "action_unlock_partitions": action_unlock_partitions,
    "action_check_runtimes": action_check_runtimes,
    "catalog_models": catalog_models,
    "catalog_views": catalog_views,
    "catalog_view_attributes": catalog_view_attributes,
    "catalog_analyser_stats": catalog_analyser_stats,
    "catalog_positions": catalog_positions,
    "catalog_tables": catalog_tables,
}
