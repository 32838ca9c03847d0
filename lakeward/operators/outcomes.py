"""Task/outcome reports with last-wins upsert.

Inputs
------
tasks    : entity, space[, attribute]  -- one row per task (duplicates kept)
outcomes : entity, space, <order cols>, success / run_time_ms / outcome
           -- a run log; ``order`` columns sort repeated runs of one key, the
           last run wins.

Every report is "latest outcome per key" (a partial aggregate, so a key run a
billion times shrinks map-side) joined to the task list.  Keys are compared
null-safely: an empty key field matches an empty key field.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeward.functions.keyed import last_per_key, null_safe_join, packed_join, spread
from lakeward.functions.scalars import NO_PARTITIONS, outcome_flag, runtime_rule
from lakeward.operators.lineage import requested_model_edges

KEYS = ["entity", "space"]


def latest_outcomes(outcomes: DataFrame, order: Sequence[str], values: Sequence[str],
                    keys: Sequence[str] = KEYS) -> DataFrame:
    """The last run per key (by ``order``).

    Grouped on the key columns, so the null-safe join re-shuffles this side
    (one row per key) on the packed key: both join inputs are then plain
    shuffle reads, the shape in which AQE's skew-join rule can split a key
    that holds a third of the task or result rows.  (Grouping on the packed
    key saves that small shuffle but rules the split out.)"""
    return last_per_key(outcomes, list(keys), list(order), list(values))


def upsert_results(results: DataFrame, outcomes: DataFrame, order: Sequence[str],
                   keys: Sequence[str] = KEYS) -> DataFrame:
    """Merge outcomes into result rows by key.

    Every result row with a matching key changes (duplicates included), only
    the result's own columns change (unknown outcome columns are dropped),
    outcomes without a result row are ignored, and the last outcome per key
    wins.  A matched value replaces the old one even when it is null."""
    keys = list(keys)
    cols = [c for c in results.columns if c not in keys and c in outcomes.columns and c not in order]
    if not cols:
        return results
    latest = latest_outcomes(outcomes, order, cols, keys)
    latest = latest.select(*keys, *[F.col(c).alias("_new_" + c) for c in cols], F.lit(True).alias("_hit"))
    joined = null_safe_join(results, latest, keys, "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    return joined.select(*[
        (F.when(hit, F.col("_new_" + c)).otherwise(F.col(c)).cast(results.schema[c].dataType).alias(c)
         if c in cols else F.col(c))
        for c in results.columns])


def _prefilled(tasks: DataFrame, outcomes: DataFrame, order: Sequence[str], values: Sequence[str]) -> DataFrame:
    latest = latest_outcomes(outcomes, order, values)
    return null_safe_join(tasks.select(*KEYS), latest, KEYS, "left")


def report_persist(tasks: DataFrame, outcomes: DataFrame, order: Sequence[str], timer: bool = True) -> DataFrame:
    """One row per task; ``isPersisted`` False and ``runtime`` null until
    an outcome arrives; runtime in seconds only with the timer on, a
    successful run and more than 0 seconds."""
    j = _prefilled(tasks, outcomes, order, ["success", "run_time_ms"])
    return j.select(*KEYS, F.coalesce(F.col("success"), F.lit(False)).alias("isPersisted"),
                    runtime_rule("persist", "success", "run_time_ms", timer).alias("runtime"))


def report_unpersist(tasks: DataFrame, outcomes: DataFrame, order: Sequence[str]) -> DataFrame:
    """R2: one row per task, ``isRemoved`` False until a successful outcome."""
    j = _prefilled(tasks, outcomes, order, ["success"])
    return j.select(*KEYS, F.coalesce(F.col("success"), F.lit(False)).alias("isRemoved"))


def report_task_chains(tasks: DataFrame, outcomes: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row per task chain; runtime in seconds whenever the run
    succeeded (0 kept, a missing run time counts as 0), else null."""
    j = _prefilled(tasks, outcomes, order, ["success", "run_time_ms"])
    return j.select(*KEYS, F.coalesce(F.col("success"), F.lit(False)).alias("isCompleted"),
                    runtime_rule("task_chain", "success", "run_time_ms").alias("runtime"))


def _processed(tasks: DataFrame, outcomes: DataFrame, order: Sequence[str], values: Sequence[str],
               task_cols: Sequence[str]) -> DataFrame:
    latest = latest_outcomes(outcomes, order, values)
    return null_safe_join(tasks.select(*task_cols), latest, KEYS, "inner")


def report_partition_create(tasks: DataFrame, outcomes: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row per processed task; ``created`` and ``exists`` both count
    as a created partitioning.  Outcomes that name their attribute count for
    that task only; a log without attributes counts for the whole view."""
    if "attribute" in outcomes.columns:
        keys = KEYS + ["attribute"]
        j = null_safe_join(tasks.select(*keys), latest_outcomes(outcomes, order, ["outcome"], keys), keys, "inner")
    else:
        j = _processed(tasks, outcomes, order, ["outcome"], KEYS + ["attribute"])
    return j.select(*KEYS, "attribute", outcome_flag("partition_create", "outcome").alias("createdPartition"))


def report_partition_delete(tasks: DataFrame, outcomes: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row per processed task with the success of the removal."""
    j = _processed(tasks, outcomes, order, ["success"], KEYS)
    return j.select(*KEYS, F.coalesce(F.col("success"), F.lit(False)).alias("removedPartition"))


def _lock_like(tasks, outcomes, order, kind, out_col):
    j = _processed(tasks, outcomes, order, ["outcome"], KEYS)
    # A view without partitions gives no row; a null outcome is not that case.
    j = j.filter(~F.col("outcome").eqNullSafe(F.lit(NO_PARTITIONS)))
    return j.select(*KEYS, outcome_flag(kind, "outcome").alias(out_col))


def report_lock(tasks: DataFrame, outcomes: DataFrame, order: Sequence[str]) -> DataFrame:
    """Lock report; ``no_partitions`` gives no row, anything but
    ``locked`` is False."""
    return _lock_like(tasks, outcomes, order, "partition_lock", "lockedPartitions")


def report_unlock(tasks: DataFrame, outcomes: DataFrame, order: Sequence[str]) -> DataFrame:
    """Unlock report, same rule with ``unlocked``."""
    return _lock_like(tasks, outcomes, order, "partition_unlock", "unlockedPartitions")


def view_run_state(persisted: DataFrame, persist_outcomes: DataFrame, unpersist_outcomes: DataFrame,
                   order: Sequence[str]) -> DataFrame:
    """Per view (name, space): was it persisted before the run, its last
    persist run and its last unpersist run -- one union and one partial
    aggregate instead of three separate joins against the work list."""
    order = list(order)
    a = persisted.select("name", "space", F.lit(True).alias("_already"))
    b = persist_outcomes.select("name", "space", F.struct(*[F.col(c) for c in order],
                                F.col("success").alias("success"),
                                F.col("run_time_ms").cast("bigint").alias("run_time_ms")).alias("_p"))
    c = unpersist_outcomes.select("name", "space", F.struct(*[F.col(c) for c in order],
                                  F.col("success").alias("success")).alias("_u"))
    u = a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)
    return u.groupBy("name", "space").agg(
        F.coalesce(F.max("_already"), F.lit(False)).alias("already"),
        F.max("_p").alias("p"), F.max("_u").alias("u"))


def runtime_report(requests: DataFrame, models: DataFrame, edges: DataFrame, views: DataFrame,
                   persisted: DataFrame, persist_outcomes: DataFrame, unpersist_outcomes: DataFrame,
                   order: Sequence[str]) -> DataFrame:
    """R8 (long form): per requested model and view, the persist runtime and
    the two flags.

    * ``alreadyPersisted``: the view was persisted before the run;
    * ``runtime``: seconds of the last persist run when it succeeded and took
      more than 0 s (a missing run time counts as -1000 ms), else null;
    * ``removedPersistence``: the persist run succeeded, the view was not
      persisted before, and the unpersist run succeeded.

    A view shared by several models is measured once (state per view) and
    fanned out to every model by the join.  Unresolved views (space null)
    never match a run.  Columns: model_id, model_name, view_id, view_space,
    view_name, runtime, alreadyPersisted, removedPersistence."""
    work = requested_model_edges(requests, models, edges, views)  # already one row per (model, view, name)
    state = view_run_state(persisted, persist_outcomes, unpersist_outcomes, order)
    # Plain equality: an unresolved view (space null) never matches a run.
    j = packed_join(work, state, ["view_name", "view_space"], ["name", "space"], "left")
    ok = F.coalesce(F.col("p.success"), F.lit(False))
    already = F.coalesce(F.col("already"), F.lit(False))
    return j.select(
        "model_id", "model_name", "view_id", "view_space", "view_name",
        runtime_rule("model_runtime", F.col("p.success"), F.col("p.run_time_ms")).alias("runtime"),
        already.alias("alreadyPersisted"),
        (ok & ~already & F.coalesce(F.col("u.success"), F.lit(False))).alias("removedPersistence"))


def runtime_report_nested(report: DataFrame, parts: int = 1) -> DataFrame:
    """R8 nested form: ``dependencies: map<view_id, struct<space, name,
    runtime, alreadyPersisted, removedPersistence>>`` per model, dealt over
    ``parts`` records by a hash of the view id, the same for every model."""
    keyed = report.withColumn("part", F.pmod(F.xxhash64("view_id"), F.lit(int(parts))).cast("int"))
    entry = F.struct(F.col("view_id").cast("string").alias("key"),
                     F.struct(F.col("view_space").alias("space"), F.col("view_name").alias("name"),
                              "runtime", "alreadyPersisted", "removedPersistence").alias("value"))
    return spread(keyed, "model_id", "part").groupBy("model_id", "model_name", "part").agg(
        F.map_from_entries(F.collect_list(entry)).alias("dependencies")
    ).select("model_id", F.col("model_name").alias("name"), "part", "dependencies")
