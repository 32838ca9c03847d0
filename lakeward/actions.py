"""End-to-end flows, one per action of the original tool: read the task
file, run the operator on Spark, write the result/export in the registered
layout.

The actions on views either do the work or report work done elsewhere:
``outcomes`` is a runner (``lakeward.operators.runs``: ``persisting``,
``unpersisting``, ``partitioning``, ``unpartitioning``, ``locking``,
``unlocking``), which is handed the tasks, or a DataFrame ``(entity, space,
<order cols>, success, run_time_ms, outcome)`` from a run log or a stream
(``lakeward.streaming``).  Runner outcomes are ordered by ``seq``.  Task
chains run nothing on Spark tables, so they are reported only.

A runner logs its outcomes as it goes.  Reports with a row per task are
written with their defaults before it starts and again when it is done;
``current_report`` writes one from the outcomes logged so far, and the same
action with a runner of the same run id goes on where a lost one stopped.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeward import sources
from lakeward.operators import lineage, outcomes as oc, runs, search, stats
from lakeward.operators.runs import Runner, Views


def _write(spark: SparkSession, df: DataFrame, out: str, kind: str) -> DataFrame:
    sources.reset_results(spark, out, kind)
    sources.append_results(df, out, kind)
    return df


REPORTS = {
    "VIEW_PERSIST": (oc.report_persist, True), "VIEW_UNPERSIST": (oc.report_unpersist, True),
    "VIEW_PARTITIONING_CREATE": (oc.report_partition_create, False), "VIEW_PARTITIONING_DELETE": (oc.report_partition_delete, False),
    "VIEW_PARTITION_LOCK": (oc.report_lock, False), "VIEW_PARTITION_UNLOCK": (oc.report_unlock, False),
}  # per kind of task: its report, and whether that has a row for tasks without an outcome


def _report(spark: SparkSession, kind: str, tasks_path: str, outcomes: DataFrame | Runner, order: Sequence[str], out: str, **options) -> DataFrame:
    """Run the tasks of a file, if ``outcomes`` is a runner, and write their report."""
    tasks = sources.scan_tasks(spark, tasks_path, kind)
    report, prefilled = REPORTS[kind]
    if not isinstance(outcomes, DataFrame):
        if prefilled:
            _write(spark, report(tasks, spark.createDataFrame([], runs.OUTCOMES), order, **options), out, f"{kind}_RESULT")
        outcomes = outcomes(tasks)
    return _write(spark, report(tasks, outcomes, order, **options), out, f"{kind}_RESULT")


def current_report(spark: SparkSession, kind: str, tasks_path: str, store: str, run: str, out: str, **options) -> DataFrame:
    """The report of a run, at work or lost, from what it has logged so far."""
    return _report(spark, kind, tasks_path, runs.outcomes_of(spark, store, run), ["seq"], out, **options)


def _export(spark: SparkSession, rows: DataFrame, nested, out: str, by_space: bool, parts: int | None) -> None:
    if parts is None:
        sources.write_model_rows(rows, out, by_space)
    else:
        sources.write_model_export(nested(rows, parts), out, by_space)


def export_models(models: DataFrame, edges: DataFrame, views: DataFrame, out: str,
                  skip_duplicates: bool = False, space: str | None = None, parts: int | None = None) -> DataFrame:
    """All models (or those of one space) with their views, as JSON Lines, one
    folder per space when ``space`` is given.  A line holds one model and view;
    with ``parts``, one of so many parts of a model with a map of its views."""
    rows = lineage.model_edges(models, edges, views, skip_duplicates, space)
    _export(models.sparkSession, rows.withColumnRenamed("model_space", "space_name"),
            lambda r, n: lineage.nested_export(r.withColumnRenamed("space_name", "model_space"), n), out, space is not None, parts)
    return rows


def _not_found(requests: DataFrame, models: DataFrame, path: str | None) -> None:
    if path is not None:
        lineage.unresolved_models(requests, models).write.mode("overwrite").json(path)


def check_model_runtimes(spark: SparkSession, tasks_path: str, models: DataFrame, edges: DataFrame,
                         views: DataFrame, persisted: DataFrame, persist_outcomes: DataFrame,
                         unpersist_outcomes: DataFrame, order: Sequence[str], out: str,
                         not_found: str | None = None, parts: int | None = None) -> DataFrame:
    """Runtime report, from ready outcomes, for the models named in the task
    file; JSON Lines as in ``export_models``.  Requested models that do not
    exist go to ``not_found``, JSON as well."""
    requests = sources.scan_tasks(spark, tasks_path, "ANALYTICAL_MODELS_ALL_VIEWS_PERSISTENCE_TIME")
    rep = oc.runtime_report(requests, models, edges, views, persisted, persist_outcomes, unpersist_outcomes, order)
    _export(spark, rep, oc.runtime_report_nested, out, False, parts)
    _not_found(requests, models, not_found)
    return rep


def measure_model_runtimes(spark: SparkSession, tasks_path: str, models: DataFrame, edges: DataFrame, views: DataFrame,
                           definitions: Views, store: str, out: str, run: str | None = None, parallelism: int = 5,
                           not_found: str | None = None, parts: int | None = None) -> DataFrame:
    """R8 for real: every view of the models named in the task file is
    persisted once, however many models share it, timed, and unpersisted
    unless it was persisted before.  Views without a space are reported but not
    run.  The report is written with its defaults first and with the outcomes
    when the run is done; ``model_runtimes_of`` gives it in between, and the
    same ``run`` resumes a lost one."""
    run = run or runs.new_run()
    requests = sources.scan_tasks(spark, tasks_path, "ANALYTICAL_MODELS_ALL_VIEWS_PERSISTENCE_TIME")
    _not_found(requests, models, not_found)
    before = model_runtimes_of(requests, models, edges, views, store, run)
    _export(spark, before, oc.runtime_report_nested, out, False, parts)
    todo = before.filter("view_space is not null").select(F.col("view_name").alias("entity"), F.col("view_space").alias("space"))
    runs.measuring(definitions, store, parallelism, run)(todo.distinct())
    rep = model_runtimes_of(requests, models, edges, views, store, run)
    _export(spark, rep, oc.runtime_report_nested, out, False, parts)
    return rep


def model_runtimes_of(requests: DataFrame, models: DataFrame, edges: DataFrame, views: DataFrame, store: str, run: str) -> DataFrame:
    """The runtime report of a run from what it has logged so far."""
    spark = models.sparkSession
    done = runs.outcomes_of(spark, store, run).select(F.col("entity").alias("name"), "space", "seq", "success", "run_time_ms", "outcome")
    unpersisted = done.filter(F.col("outcome").isin("removed", "not_removed")).withColumn("success", F.col("outcome") == "removed")
    before = runs.persisted_before(spark, store, run).withColumnRenamed("entity", "name")
    return oc.runtime_report(requests, models, edges, views, before, done, unpersisted, ["seq"])


def create_view_analytics(spark: SparkSession, stats_df: DataFrame, key: Sequence[str], order: Sequence[str],
                          out: str) -> DataFrame:
    return _write(spark, search.best_persistence_candidates(stats_df, key, order), out, "VIEW_ANALYSE")


def find_views_with_attribute(spark: SparkSession, views: DataFrame, word: str, out: str, **cols) -> DataFrame:
    return _write(spark, search.attributes_containing(views, word, **cols), out, "VIEW_ATTRIBUTE")


def create_partitioning_for_views(spark: SparkSession, tasks_path: str, outcomes: DataFrame | Runner, order: Sequence[str], out: str) -> DataFrame:
    return _report(spark, "VIEW_PARTITIONING_CREATE", tasks_path, outcomes, order, out)


def remove_partitioning_for_views(spark: SparkSession, tasks_path: str, outcomes: DataFrame | Runner, order: Sequence[str], out: str) -> DataFrame:
    return _report(spark, "VIEW_PARTITIONING_DELETE", tasks_path, outcomes, order, out)


def persist_views(spark: SparkSession, tasks_path: str, outcomes: DataFrame | Runner, order: Sequence[str], out: str, timer: bool = True) -> DataFrame:
    return _report(spark, "VIEW_PERSIST", tasks_path, outcomes, order, out, timer=timer)


def unpersist_views(spark: SparkSession, tasks_path: str, outcomes: DataFrame | Runner, order: Sequence[str], out: str) -> DataFrame:
    return _report(spark, "VIEW_UNPERSIST", tasks_path, outcomes, order, out)


def lock_partitions_until_year(spark: SparkSession, tasks_path: str, outcomes: DataFrame | Runner, order: Sequence[str], out: str) -> DataFrame:
    return _report(spark, "VIEW_PARTITION_LOCK", tasks_path, outcomes, order, out)


def unlock_all_partitions(spark: SparkSession, tasks_path: str, outcomes: DataFrame | Runner, order: Sequence[str], out: str) -> DataFrame:
    return _report(spark, "VIEW_PARTITION_UNLOCK", tasks_path, outcomes, order, out)


def run_task_chains(spark: SparkSession, tasks_path: str, outcomes: DataFrame, order: Sequence[str],
                    out: str) -> DataFrame:
    tasks = sources.scan_tasks(spark, tasks_path, "TASK_CHAIN_RUN")
    return _write(spark, oc.report_task_chains(tasks, outcomes, order), out, "TASK_CHAIN_RUN_RESULT")


def create_statistics(spark: SparkSession, catalog: DataFrame, statistics_type: str,
                      tables: Mapping[str, DataFrame], store: str, parallelism: int = 5) -> DataFrame:
    return stats.create_statistics(spark, catalog, statistics_type, tables, store, parallelism=parallelism)


def refresh_statistics(spark: SparkSession, catalog: DataFrame, tables: Mapping[str, DataFrame], store: str,
                       parallelism: int = 5) -> DataFrame:
    return stats.refresh_profiles(spark, catalog, tables, store, parallelism=parallelism)
