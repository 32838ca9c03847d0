"""Task lists run on Spark tables: what the actions order, done.

A runner takes a task list (entity, space[, attribute]) and returns one
outcome row per task, in the shape the reports (R1-R7) read, ordered by
``seq``.  Outcomes are rows of a log below the store, in a folder named by the
run, and can be read at any time (``outcomes_of``).  A run that was cut off is
resumed by the same run id: tasks that have an outcome are not done again.

* Locks, unlocks and unpersists change metadata only: one join of the tasks
  with the state of the store decides them all, however many they are.
* Tasks that write a view's rows are one Spark job each.  Views run side by
  side, at most ``parallelism`` at once; the driver holds a window of them
  and logs its outcomes before it goes on.  A task that fails is an outcome
  with the text of its error.

The yearly layout of a view and its locks are rows of an append-only log; the
last row per view counts.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from itertools import islice

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lakeward.functions.keyed import last_per_key, null_safe_join
from lakeward.functions.scalars import NO_PARTITIONS, year_bounds
from lakeward.operators import tables

OUTCOMES = ("entity string, space string, attribute string, seq bigint, success boolean, run_time_ms bigint, "
            "outcome string, error string")
OUTCOME_COLUMNS = [c.split()[0] for c in OUTCOMES.split(", ")]
LAYOUTS = "entity string, space string, attribute string, first int, last int, locked_until int, seq bigint"
WINDOW = 100  # views whose outcomes the driver holds at once, and which a resumed run may do again
KEYS = ["entity", "space"]

Views = Mapping[tuple[str, str], DataFrame] | Callable[[str, str], DataFrame | None]
Runner = Callable[[DataFrame], DataFrame]


# --- runs and their outcomes ----------------------------------------------------------

def new_run() -> str:
    return f"{time.time_ns()}-{uuid.uuid4().hex[:8]}"


def _run_path(store: str, run: str, name: str) -> str:
    return f"{store.rstrip('/')}/{name}/{tables.folder_name(run)}"


def outcomes_of(spark: SparkSession, store: str, run: str) -> DataFrame:
    """The outcomes that a run has logged so far."""
    return tables.read_log(spark, _run_path(store, run, "_outcomes"), OUTCOMES)


def once(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``, written by ``make`` unless an earlier attempt
    of the run has committed it."""
    if not tables.path_exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def run_tasks(tasks: DataFrame, store: str, work: Callable[[Row, str | None], str | tuple[str, int]], parallelism: int = 5,
              run: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Run ``work(view, attribute)`` once per distinct task that has no
    outcome under ``run``; it returns the outcome word, or the word and the
    milliseconds that count, or raises.  ``view`` holds entity, space and the
    columns ``keep``, which depend on these two."""
    spark, run = tasks.sparkSession, run or new_run()
    log = _run_path(store, run, "_outcomes")
    attribute = F.col("attribute") if "attribute" in tasks.columns else F.lit(None).cast("string")
    left = tasks.select(*KEYS, *keep, attribute.alias("attribute"))
    if tables.path_exists(spark, log):
        left = null_safe_join(left, outcomes_of(spark, store, run).select(*KEYS, "attribute"), [*KEYS, "attribute"], "left_anti")
    # a struct keeps a null attribute, which collect_set alone would leave out
    todo = left.groupBy(*KEYS, *keep).agg(F.sort_array(F.collect_set(F.struct("attribute"))).alias("attributes")).toLocalIterator()

    def one(view: Row) -> list[tuple]:
        rows = []
        for attribute in (a["attribute"] for a in view["attributes"]):
            t0, error, ms = time.time(), None, None
            try:
                outcome = work(view, attribute)
                outcome, ms = outcome if isinstance(outcome, tuple) else (outcome, int(round((time.time() - t0) * 1000)))
            except Exception as e:  # noqa: BLE001 -- a failed task is an outcome; its cause is kept
                outcome, error = "failed", f"{type(e).__name__}: {e}"
            ok = outcome not in ("failed", NO_PARTITIONS)
            rows.append((view["entity"], view["space"], attribute, time.time_ns(), ok, ms if ok else None, outcome, error))
        return rows

    with ThreadPoolExecutor(max_workers=max(1, int(parallelism))) as pool:
        while views := list(islice(todo, WINDOW)):
            rows = [r for done in pool.map(one, views) for r in done]
            spark.createDataFrame(rows, OUTCOMES).coalesce(1).write.mode("append").parquet(log)
    return outcomes_of(spark, store, run)


def decide_tasks(tasks: DataFrame, state: DataFrame, store: str, run: str | None, outcome: Column, error: Column,
                 log: str, log_columns: dict[str, Column]) -> DataFrame:
    """Decide all tasks at once: a join with ``state`` (one row per view, its
    columns and ``known``) gives each its outcome word, and the row that
    ``log`` gets for it if it succeeds.  The decisions are the outcome log; the
    rows of the state's log are written from them, to a folder named by the
    run.  A run that was cut off in between writes the same rows again."""
    spark, run = tasks.sparkSession, run or new_run()

    def decided() -> DataFrame:
        attribute = F.col("attribute") if "attribute" in tasks.columns else F.lit(None).cast("string")
        asked = tasks.select(*KEYS, attribute.alias("_attribute")).distinct()
        known = state.withColumn("known", F.lit(True))
        met = null_safe_join(asked, known, KEYS, "left").withColumn("known", F.coalesce("known", F.lit(False))).withColumn("outcome", outcome)
        ok = ~F.col("outcome").isin("failed", NO_PARTITIONS)
        return met.select(*KEYS, F.col("_attribute").alias("attribute"), F.lit(time.time_ns()).alias("seq"), ok.alias("success"),
                          F.lit(None).cast("bigint").alias("run_time_ms"), "outcome", F.when(~ok, error).alias("error"),
                          F.when(ok, F.struct(*[c.alias(n) for n, c in log_columns.items()])).alias("row"))

    rows = once(spark, _run_path(store, run, "_outcomes"), decided)
    new = rows.filter("success").select(*KEYS, "seq", "row.*").distinct()
    new.write.mode("overwrite").parquet(_run_path(store, run, log))
    return rows.select(*OUTCOME_COLUMNS)


def _definition(views: Views, entity: str, space: str) -> DataFrame:
    """``views`` holds the definitions, or gives one for (entity, space)."""
    df = views(entity, space) if callable(views) else views.get((entity, space))
    if df is None:
        raise LookupError(f"no view {entity!r} in space {space!r}")
    return df


# --- yearly layouts of views ------------------------------------------------------

def layout_path(store: str, entity: str, space: str) -> str:
    return f"{store.rstrip('/')}/ranges/{tables.folder_name(space)}/{tables.folder_name(entity)}"


def layouts(spark: SparkSession, store: str) -> DataFrame:
    """Views that are partitioned now: attribute, first and last year, and
    the year up to which ranges are locked (null: none)."""
    log = tables.read_log(spark, f"{store.rstrip('/')}/_layouts", LAYOUTS)
    return last_per_key(log, ["entity", "space"], ["seq"], ["attribute", "first", "last", "locked_until"]).filter("attribute IS NOT NULL")


def _layout(spark: SparkSession, store: str, entity: str, space: str) -> Row | None:
    return layouts(spark, store).filter(F.col("entity").eqNullSafe(F.lit(entity)) & F.col("space").eqNullSafe(F.lit(space))).first()


def _set_layout(spark: SparkSession, store: str, entity: str, space: str, attribute: str | None,
                first: int | None = None, last: int | None = None, until: int | None = None) -> None:
    tables.append_log(spark, f"{store.rstrip('/')}/_layouts", [(entity, space, attribute, first, last, until, time.time_ns())], LAYOUTS)


def _locked(layout: Row) -> list[str]:
    until = layout["locked_until"]
    return [] if until is None else [y for y in year_bounds(layout["first"], layout["last"])[:-1] if int(y) <= until]


# --- runners ------------------------------------------------------------------------

def persisting(views: Views, store: str, parallelism: int = 5, run: str | None = None) -> Runner:
    """T7 (T5 for a partitioned view: its locked ranges keep what is stored)."""
    def runner(tasks: DataFrame) -> DataFrame:
        spark = tasks.sparkSession

        def work(view, _):
            entity, space = view["entity"], view["space"]
            df, layout = _definition(views, entity, space), _layout(spark, store, entity, space)
            if layout is None:
                return "persisted", tables.materialise(df, entity, space, store)
            path = layout_path(store, entity, space)
            tables.repersist(df, path, layout["attribute"], layout["first"], layout["last"], _locked(layout))
            tables.register(spark, store, entity, space, path)
            return "persisted"

        return run_tasks(tasks, store, work, parallelism, run)
    return runner


def persisted_before(spark: SparkSession, store: str, run: str) -> DataFrame:
    """(entity, space) of the views that were persisted when a run began;
    noted once, so that a resumed run does not take its own for them."""
    return once(spark, _run_path(store, run, "_before"), lambda: tables.persisted_views(spark, store).select(*KEYS))


def measuring(views: Views, store: str, parallelism: int = 5, run: str | None = None) -> Runner:
    """Persist every view once, take its time, and unpersist it unless it
    was persisted before the run.  Outcomes: ``kept`` (was persisted before),
    ``removed``, ``not_removed`` (persisted, but still there) or ``failed``."""
    run = run or new_run()

    def runner(tasks: DataFrame) -> DataFrame:
        spark = tasks.sparkSession
        before = persisted_before(spark, store, run).withColumn("already", F.lit(True))
        known = null_safe_join(tasks.select(*KEYS).distinct(), before, KEYS, "left").withColumn("already", F.coalesce("already", F.lit(False)))

        def work(view, _):
            entity, space = view["entity"], view["space"]
            ms = tables.materialise(_definition(views, entity, space), entity, space, store)
            if view["already"]:
                return "kept", ms
            try:
                tables.register(spark, store, entity, space, None)
            except Exception:  # noqa: BLE001 -- the view was measured; that it is still persisted is the outcome
                return "not_removed", ms
            return "removed", ms

        return run_tasks(known, store, work, parallelism, run, keep=("already",))
    return runner


def unpersisting(store: str, run: str | None = None) -> Runner:
    """T8; a view that is not persisted fails.  One join, one append."""
    def runner(tasks: DataFrame) -> DataFrame:
        missing = F.concat(F.lit("LookupError: view '"), F.coalesce("entity", F.lit("")), F.lit("' in space '"),
                           F.coalesce("space", F.lit("")), F.lit("' is not persisted"))
        return decide_tasks(tasks, tables.persisted_views(tasks.sparkSession, store), store, run,
                            F.when(F.col("known"), "removed").otherwise("failed"), missing, "_registry",
                            {"action": F.lit("unpersist"), "path": F.lit(None).cast("string"), "run_time_ms": F.lit(None).cast("bigint")})
    return runner


def partitioning(views: Views, store: str, first: int, last: int, overwrite: bool = False, parallelism: int = 5,
                 run: str | None = None) -> Runner:
    """T2 over the yearly bounds ``first..last``; the view is persisted in
    the new layout.  An existing partitioning is kept (``exists``) unless
    ``overwrite``, which also drops its locks."""
    def runner(tasks: DataFrame) -> DataFrame:
        spark = tasks.sparkSession

        def work(view, attribute):
            entity, space = view["entity"], view["space"]
            df = _definition(views, entity, space)
            if _layout(spark, store, entity, space) is not None and not overwrite:
                return "exists"
            if len(year_bounds(first, last)) < 2:
                raise ValueError(f"no yearly range from {first} to {last}")
            path = layout_path(store, entity, space)
            # data without a log row are left over from a run that was cut off, or from a removed layout
            outcome = tables.partition_by_year(df, attribute, first, last, path, overwrite=True)
            _set_layout(spark, store, entity, space, attribute, first, last)
            tables.register(spark, store, entity, space, path)
            return outcome

        return run_tasks(tasks, store, work, parallelism, run)
    return runner


def unpartitioning(store: str, parallelism: int = 5, run: str | None = None) -> Runner:
    """T4: the stored rows move to a plain snapshot, which the view reads
    from then on; a view without partitions fails.  The old layout stays for
    readers at work until ``tables.remove_superseded``."""
    def runner(tasks: DataFrame) -> DataFrame:
        spark = tasks.sparkSession

        def work(view, _):
            entity, space = view["entity"], view["space"]
            if _layout(spark, store, entity, space) is None:
                return NO_PARTITIONS
            rows = tables.read_partitioned(spark, layout_path(store, entity, space)).drop(tables.PARTITION_COL)
            tables.materialise(rows, entity, space, store)
            _set_layout(spark, store, entity, space, None)
            return "removed"

        return run_tasks(tasks, store, work, parallelism, run)
    return runner


def _relock(tasks: DataFrame, store: str, run: str | None, word: str, until: Column) -> DataFrame:
    same = {c: F.col(c) for c in ("attribute", "first", "last")}
    return decide_tasks(tasks, layouts(tasks.sparkSession, store), store, run, F.when(F.col("known"), word).otherwise(NO_PARTITIONS),
                        F.lit(None).cast("string"), "_layouts", {**same, "locked_until": until})


def locking(store: str, until_year: int, run: str | None = None) -> Runner:
    """T5: lock the ranges up to and including ``until_year``; ranges locked
    before stay locked.  One join, one append."""
    return lambda tasks: _relock(tasks, store, run, "locked", F.greatest(F.lit(int(until_year)), F.col("locked_until")))


def unlocking(store: str, run: str | None = None) -> Runner:
    """Unlock every range.  One join, one append."""
    return lambda tasks: _relock(tasks, store, run, "unlocked", F.lit(None).cast("int"))
