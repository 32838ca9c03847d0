"""ST1: merge a stream of outcomes into a result table, last outcome per key
wins, safe to restart.

The prefilled result rows are written once.  Every micro-batch appends its
outcomes to a log, partitioned by the stream's id and the batch's number, and
the current results are ``upsert_results`` (J5) over the two.  So

* a batch replayed after a failure overwrites its own folder and nothing else;
* the id belongs to the checkpoint: a new checkpoint, or a second stream on
  the same store, writes folders of its own;
* the ordering columns decide which outcome is the last, whatever the order
  of arrival, so the end state equals the batch ``upsert_results``.

``fold`` reduces the log to the last outcome per key, as a table that names
per stream the last batch it covers.  Reads take the newest fold and the
batches after it, so they cost as much as there are keys.  A covered batch that
is replayed writes a folder that nobody reads.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lakeward.functions.keyed import last_per_key
from lakeward.operators import tables
from lakeward.operators.outcomes import KEYS, upsert_results

RUN, BATCH = "_run", "_batch"
NO_RUN = "none"  # an empty batch that holds the columns of the log


def _p(path: str, sub: str) -> str:
    return f"{path.rstrip('/')}/{sub}"


def init_results(results: DataFrame, path: str, outcome_schema: str) -> None:
    """Write the prefilled result rows, and an empty log of outcomes with the
    columns ``outcome_schema`` names (keys, ordering columns, values).  What
    the store held before is replaced."""
    spark = results.sparkSession
    results.write.mode("overwrite").parquet(_p(path, "results"))
    spark.createDataFrame([], f"{outcome_schema}, {RUN} string, {BATCH} bigint").write.mode("overwrite") \
        .option("partitionOverwriteMode", "static").partitionBy(RUN, BATCH).parquet(_p(path, "log"))
    append_batch(spark.createDataFrame([], outcome_schema), path, NO_RUN, 0)


def _folder(path: str, run: str, batch_id: int) -> str:
    return _p(path, f"log/{RUN}={run}/{BATCH}={int(batch_id)}")


def append_batch(batch: DataFrame, path: str, run: str, batch_id: int) -> None:
    """Log one micro-batch; the same ``run`` and ``batch_id`` again replace
    what they wrote before."""
    batch.write.mode("overwrite").parquet(_folder(path, run, batch_id))


def _last_fold(spark: SparkSession, path: str) -> tuple[str | None, dict[str, int]]:
    """The newest fold that is whole, and per stream the last batch in it."""
    root = _p(path, "folds")
    folds = sorted(tables.children(spark, root), reverse=True) if tables.path_exists(spark, root) else []
    for folder in folds:
        if tables.path_exists(spark, f"{folder}/covered/_SUCCESS"):
            rows = spark.read.schema(f"{RUN} string, {BATCH} bigint").parquet(f"{folder}/covered").collect()  # one row per stream
            return folder, {r[RUN]: r[BATCH] for r in rows}
    return None, {}


def _batches(spark: SparkSession, path: str) -> list[tuple[str, int, str]]:
    """(run, batch, folder) of the batches that are written whole."""
    out = []
    for run_folder in tables.children(spark, _p(path, "log"), hidden=True):
        if f"/{RUN}=" not in run_folder:
            continue
        run = run_folder.rsplit("=", 1)[1]
        for folder in tables.children(spark, run_folder, hidden=True):
            if run != NO_RUN and f"/{BATCH}=" in folder and tables.path_exists(spark, f"{folder}/_SUCCESS"):
                out.append((run, int(folder.rsplit("=", 1)[1]), folder))
    return out


def outcome_log(spark: SparkSession, path: str) -> DataFrame:
    """Every outcome logged so far, those of folded batches as the last per key."""
    columns = spark.read.parquet(_folder(path, NO_RUN, 0)).schema
    folder, covered = _last_fold(spark, path)
    if folder is None:
        return spark.read.schema(columns).parquet(_p(path, "log"))
    rows = spark.read.schema(columns).parquet(f"{folder}/rows")
    fresh = [f for run, batch, f in _batches(spark, path) if batch > covered.get(run, -1)]
    return rows.unionByName(spark.read.schema(columns).parquet(*fresh)) if fresh else rows


def fold(spark: SparkSession, path: str, order: Sequence[str], keys: Sequence[str] = KEYS, older_than_s: float = 86400.0) -> None:
    """Fold the last fold and the batches after it into one row per key, in
    a new folder; which batches that covers is written last and makes it count.
    Batch folders that it covers, and the folds before it, are deleted by the
    first fold that finds it older than ``older_than_s`` seconds, when nobody
    reads them any more.  Streams may write, and fold, at the same time."""
    columns = spark.read.parquet(_folder(path, NO_RUN, 0)).schema
    folder, covered = _last_fold(spark, path)
    batches = _batches(spark, path)
    if folder is not None and int(folder.rsplit("/", 1)[1].split("-")[0]) <= time.time_ns() - older_than_s * 1e9:
        for run, batch, f in batches:
            if batch <= covered.get(run, -1):
                tables.delete(spark, f)
        for f in tables.children(spark, _p(path, "folds")):
            if f.rsplit("/", 1)[1] < folder.rsplit("/", 1)[1]:
                tables.delete(spark, f)
    fresh = [(run, batch, f) for run, batch, f in batches if batch > covered.get(run, -1)]
    if not fresh:
        return
    rows = spark.read.schema(columns).parquet(*([f"{folder}/rows"] if folder else []), *[f for _, _, f in fresh])
    # ties of the order fall as in ``upsert_results``: by the results' own columns first
    own = [c for c in spark.read.parquet(_p(path, "results")).columns if c in rows.columns and c not in keys and c not in order]
    rest = [c for c in rows.columns if c not in own and c not in keys and c not in order]
    last = last_per_key(rows, list(keys), list(order), [*order, *own, *rest]).select(*rows.columns)
    new = _p(path, f"folds/{time.time_ns()}-{uuid.uuid4().hex[:8]}")
    last.write.parquet(f"{new}/rows")
    for run, batch, _ in fresh:
        covered[run] = max(batch, covered.get(run, -1))
    spark.createDataFrame(sorted(covered.items()), f"{RUN} string, {BATCH} bigint").coalesce(1).write.parquet(f"{new}/covered")


def current_results(spark: SparkSession, path: str, order: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """The result rows with the last outcome per key, by ``order``."""
    return upsert_results(spark.read.parquet(_p(path, "results")), outcome_log(spark, path), order, keys)


def stream_upsert(outcomes: DataFrame, path: str, checkpoint: str, available_now: bool = True,
                  processing_time: str | None = None, fold_every: int | None = None,
                  order: Sequence[str] = (), keys: Sequence[str] = KEYS) -> StreamingQuery:
    """Start the streaming merge of ``outcomes`` (a streaming DataFrame) into
    the store at ``path`` (created by ``init_results``); with ``fold_every``,
    every so many batches the log is folded by ``order``."""
    if fold_every and not order:
        raise ValueError("folding needs the ordering columns")

    def log(batch: DataFrame, batch_id: int) -> None:
        # set by Spark for the thread of the query; kept by the checkpoint over restarts
        run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not run:
            raise RuntimeError("the batch does not know the id of its stream")
        append_batch(batch, path, run, batch_id)
        if fold_every and (batch_id + 1) % fold_every == 0:
            fold(batch.sparkSession, path, order, keys)

    w = outcomes.writeStream.foreachBatch(log).option("checkpointLocation", checkpoint)
    if processing_time:
        w = w.trigger(processingTime=processing_time)
    elif available_now:
        w = w.trigger(availableNow=True)
    return w.start()
