"""Yearly partitions, partition locks and view persistence on Spark tables
(T1-T9).

A "yearly range" is the half-open string range ``>= y AND < y+1`` over a
4-character year column; N+1 bounds ``start..end`` give N ranges.  Rows
outside every range go to one ``rest`` partition.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable
from urllib.parse import quote

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeward.functions.keyed import last_per_key
from lakeward.functions.scalars import year_bounds, year_partition

# --- fixed values ------------------------------------------------------------
PARTITION_COL = "partition"
REST = "rest"
# --- end of fixed values -------------------------------------------------------


def year_ranges(spark: SparkSession, start: int, end: int) -> DataFrame:
    """The N ranges described by the inclusive bounds ``start..end``
    (columns partition, lower, upper, all strings).  A reversed or one-bound
    input gives none."""
    b = year_bounds(start, end)
    rows = [(lo, lo, hi) for lo, hi in zip(b[:-1], b[1:])]
    return spark.createDataFrame(rows, "partition string, lower string, upper string")


def data_year_ranges(df: DataFrame, ts_col: str) -> DataFrame:
    """T1 over data: one yearly range per year from the earliest to the
    latest year of ``ts_col`` -- computed by Spark (min/max aggregate, then
    ``sequence`` + ``explode``), no driver round trip."""
    mm = df.agg(F.min(F.year(ts_col)).alias("lo"), F.max(F.year(ts_col)).alias("hi"))
    ys = mm.filter(F.col("lo") <= F.col("hi")).select(F.explode(F.sequence("lo", "hi")).alias("y"))
    return ys.select(F.col("y").cast("string").alias("partition"), F.col("y").cast("string").alias("lower"),
                     (F.col("y") + 1).cast("string").alias("upper"))


def with_partition(df: DataFrame, attribute: str, start: int, end: int) -> DataFrame:
    if PARTITION_COL in (c.lower() for c in df.columns):
        raise ValueError(f"the table has a column {PARTITION_COL!r} of its own, which its layout would replace")
    return df.withColumn(PARTITION_COL, year_partition(F.col(attribute), start, end, rest=REST))


def partition_summary(df: DataFrame, attribute: str, start: int, end: int) -> DataFrame:
    """Rows per yearly range that partitioning would create, empty ranges
    included, plus the ``rest`` row.  Columns: partition, lower, upper,
    row_count.  One scan and a partial aggregate (at most N+1 rows per map
    task cross the shuffle)."""
    spark = df.sparkSession
    counts = with_partition(df.select(attribute), attribute, start, end) \
        .groupBy(PARTITION_COL).agg(F.count(F.lit(1)).alias("row_count"))
    ranges = year_ranges(spark, start, end).unionByName(
        spark.createDataFrame([(REST, None, None)], "partition string, lower string, upper string"))
    return ranges.join(counts, PARTITION_COL, "left") \
        .select(PARTITION_COL, "lower", "upper", F.coalesce("row_count", F.lit(0)).cast("bigint").alias("row_count"))


def lock_partitions(ranges: DataFrame, until_year: int) -> DataFrame:
    """T5 (bounds): lock every yearly range up to and including
    ``until_year``; ``rest`` and non-year partitions stay unlocked."""
    y = F.expr(f"try_cast({PARTITION_COL} AS INT)")
    return ranges.withColumn("locked", F.coalesce(y <= F.lit(int(until_year)), F.lit(False)))


def unlock_partitions(ranges: DataFrame) -> DataFrame:
    """Unlock every range."""
    return ranges.withColumn("locked", F.lit(False))


# --- storage helpers (Hadoop FileSystem of the target path) --------------------

def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


# A yearly table keeps every write in a folder of its own (``v-...``).  A commit
# is one row per partition (partition, folder, schema) of an append-only log, all
# in one file: the last commit is the table.  A partition without folder stands
# for a table without rows.
LAYOUT_LOG = "_layout"
LAYOUT_SCHEMA = "partition string, folder string, schema string, seq bigint"


def folder_name(name: str | None) -> str:
    """A name as one folder: no separators, no dots that lead elsewhere."""
    return "%00" if name is None else quote(name, safe="").replace(".", "%2E") or "%"


def _commits(spark: SparkSession, path: str) -> DataFrame:
    return read_log(spark, f"{path.rstrip('/')}/{LAYOUT_LOG}", LAYOUT_SCHEMA)


def _current(spark: SparkSession, path: str) -> list[Row]:
    """Rows of the last commit, one per partition; none without a table."""
    commits = _commits(spark, path)
    last = commits.agg(F.max("seq")).first()[0]
    return [] if last is None else commits.filter(F.col("seq") == last).collect()


def stored_partitions(spark: SparkSession, path: str) -> list[str]:
    """Partition values of the table at ``path``."""
    return sorted(r["partition"] for r in _current(spark, path) if r["folder"])


def _write_partitioned(df: DataFrame, folder: str) -> list[str]:
    """Write one version of a yearly table; the partitions it has."""
    # REBALANCE on the partition column: one writer per partition value in
    # general, but AQE splits a hot year over several tasks and merges tiny
    # ones, so neither one huge task nor a flood of small files.
    df.hint("rebalance", PARTITION_COL).write.partitionBy(PARTITION_COL).parquet(folder)
    fs, p = _fs(df.sparkSession, folder)
    prefix = PARTITION_COL + "="
    return sorted(s.getPath().getName()[len(prefix):] for s in fs.listStatus(p)
                  if s.isDirectory() and s.getPath().getName().startswith(prefix))


def partition_by_year(df: DataFrame, attribute: str, start: int, end: int, path: str,
                      overwrite: bool = False) -> str:
    """Store ``df`` partitioned by the yearly range of ``attribute``.

    If ``path`` already holds a table and ``overwrite`` is off, nothing is
    written and the outcome is ``exists`` (which still counts as created);
    otherwise the whole layout is replaced and the outcome is ``created``.
    A failed job leaves the previous table as it was."""
    if not overwrite and _current(df.sparkSession, path):
        return "exists"
    if not year_bounds(start, end)[1:]:
        return "failed"
    repersist(df, path, attribute, start, end, locked=[])
    return "created"


def read_partitioned(spark: SparkSession, path: str) -> DataFrame:
    """Read a yearly table; the partition value stays text whatever the
    session's partition type inference says.  Locked partitions may come from
    older versions: columns they lack are null."""
    rows = _current(spark, path)
    if not rows:
        raise LookupError(f"no yearly table at {path}")
    root = path.rstrip("/")
    versions: dict[str, list[Row]] = {}
    for r in rows:
        versions.setdefault(r["folder"] or "", []).append(r)
    out = None
    for folder, parts in sorted(versions.items()):
        schema = T.StructType.fromJson(json.loads(parts[0]["schema"]))
        base = f"{root}/{folder}"
        df = (spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/{PARTITION_COL}={r['partition']}" for r in parts])
              if folder else spark.createDataFrame([], schema))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def unpartition(spark: SparkSession, path: str, out: str) -> bool:
    """T4: remove the partitioning of a stored table -- rows unchanged,
    written to a new path without the partition layout."""
    if not _current(spark, path):
        return False
    read_partitioned(spark, path).drop(PARTITION_COL).hint("rebalance").write.mode("overwrite").parquet(out)
    return True


def repersist(df: DataFrame, path: str, attribute: str, start: int, end: int,
              locked: Iterable[str]) -> list[str]:
    """T5 (effect): persist ``df`` again by yearly range while every locked
    range keeps exactly what is stored.

    Locked partitions are filtered out of the new data; the rest is written
    to a folder of its own.  Then one commit switches readers to the new
    partitions and the locked ones where they are; nothing is moved or deleted,
    so a job or a driver that is lost at any point leaves the table as it was
    before the commit, or as it is after it, and readers at work keep their
    files.  ``remove_old_versions`` deletes what no recent commit names.  One
    writer per table at a time.  Returns the partitions written."""
    spark = df.sparkSession
    locked = sorted({str(x) for x in locked})
    new = with_partition(df, attribute, start, end)
    if locked:
        new = new.filter(~F.col(PARTITION_COL).isin(*locked))
    path = path.rstrip("/")
    kept = [(r["partition"], r["folder"], r["schema"]) for r in _current(spark, path) if r["folder"] and r["partition"] in locked]
    folder = f"v-{time.time_ns()}-{uuid.uuid4().hex[:8]}"
    written = _write_partitioned(new, f"{path}/{folder}")
    schema = new.schema.json()
    rows = kept + [(value, folder, schema) for value in written]
    _commit(spark, path, rows or [(None, None, schema)])
    return written


def _commit(spark: SparkSession, path: str, rows: list[tuple]) -> None:
    seq = time.time_ns()
    append_log(spark, f"{path}/{LAYOUT_LOG}", [(*r, seq) for r in rows], LAYOUT_SCHEMA)


def remove_old_versions(spark: SparkSession, path: str, older_than_s: float = 86400.0) -> int:
    """Delete the partitions of a yearly table that no commit names which was
    current within the last ``older_than_s`` seconds, and writes of that age
    which were never committed; the number of folders deleted."""
    before = time.time_ns() - int(older_than_s * 1e9)
    path = path.rstrip("/")
    if not path_exists(spark, path):
        return 0
    commits = _commits(spark, path)
    seqs = [r["seq"] for r in commits.select("seq").distinct().orderBy("seq").collect()]  # one per write of this table since the last clean-up
    recent = [s for s, until in zip(seqs, [*seqs[1:], None]) if until is None or until >= before]
    named = {(r["folder"], r["partition"]) for r in commits.filter(F.col("seq").isin(recent)).collect() if r["folder"]}
    n = 0
    for version in children(spark, path):
        folder = version.rsplit("/", 1)[-1]
        if not folder.startswith("v-") or int(folder.split("-")[1]) >= before and not any(f == folder for f, _ in named):
            continue
        parts = [c for c in children(spark, version)]
        stale = [c for c in parts if (folder, c.rsplit(PARTITION_COL + "=", 1)[-1]) not in named]
        for c in [version] if len(stale) == len(parts) else stale:
            delete(spark, c)
            n += 1
    if len(recent) < len(seqs):
        for c in children(spark, f"{path}/{LAYOUT_LOG}"):
            if int(c.rsplit("/", 1)[-1].split("-")[0]) < min(recent):  # a commit is older than its folder
                delete(spark, c)
    return n


# --- persistence registry (T7-T9) ---------------------------------------------
# The registry is an append-only log (entity, space, action, path, seq): the
# latest action per view decides whether it is persisted.  Appends never
# rewrite earlier rows, so a retried append is harmless (seq repeats the
# same state).

REGISTRY_SCHEMA = "entity string, space string, action string, path string, seq bigint, run_time_ms bigint"


def append_log(spark: SparkSession, path: str, rows, schema: str) -> None:
    """Append ``rows`` to a log in a folder of their own, so that writers at
    work side by side don't clean up each other's files."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{time.time_ns()}-{uuid.uuid4().hex[:8]}")


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)


def _registry_path(store: str) -> str:
    return f"{store.rstrip('/')}/_registry"


def register(spark: SparkSession, store: str, entity: str, space: str, path: str | None, ms: int | None = None) -> None:
    """The view now reads from ``path`` (None: from its definition again)."""
    action = "unpersist" if path is None else "persist"
    append_log(spark, _registry_path(store), [(entity, space, action, path, time.time_ns(), ms)], REGISTRY_SCHEMA)


def read_registry(spark: SparkSession, store: str) -> DataFrame:
    return read_log(spark, _registry_path(store), REGISTRY_SCHEMA)


def children(spark: SparkSession, path: str, hidden: bool = False) -> list[str]:
    """What a folder holds; ``hidden``, also names that readers skip."""
    fs, p = _fs(spark, path)
    return [s.getPath().toString() for s in fs.listStatus(p) if hidden or not s.getPath().getName().startswith((".", "_"))]


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def _with_next(log: DataFrame) -> DataFrame:
    # a compaction that was cut off leaves rows twice
    return log.distinct().withColumn("_next", F.lead("seq").over(Window.partitionBy("entity", "space").orderBy("seq")))


def compact_log(spark: SparkSession, path: str, schema: str, before: int) -> None:
    """Drop the rows of a log that a later row of their view superseded
    before ``before``.  Rows appended meanwhile stay; the old folders go only
    after the new one is written."""
    old = children(spark, path) if path_exists(spark, path) else []
    if not old:
        return
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*old)
    kept = _with_next(rows).filter(F.col("_next").isNull() | (F.col("_next") >= F.lit(before))).drop("_next")
    kept.hint("rebalance").write.parquet(f"{path}/{time.time_ns()}-{uuid.uuid4().hex[:8]}")
    for folder in old:
        delete(spark, folder)


def remove_superseded(spark: SparkSession, store: str, older_than_s: float = 86400.0) -> int:
    """Delete snapshots and yearly tables that were superseded more than
    ``older_than_s`` seconds ago, so that nobody still reads them, old
    versions of the yearly tables in use, and compact the registry; the number
    of folders deleted."""
    before = time.time_ns() - int(older_than_s * 1e9)
    log, root = _with_next(read_registry(spark, store)), store.rstrip("/")
    ours = F.col("path").startswith(f"{root}/views/") | F.col("path").startswith(f"{root}/ranges/")
    gone = log.filter(ours).groupBy("path").agg(F.max(F.coalesce("_next", F.lit(2**63 - 1))).alias("_until")).filter(F.col("_until") < F.lit(before))
    n = 0
    for row in gone.select("path").toLocalIterator():
        delete(spark, row["path"])
        n += 1
    for row in persisted_views(spark, store).filter(F.col("path").startswith(f"{root}/ranges/")).select("path").toLocalIterator():
        n += remove_old_versions(spark, row["path"], older_than_s)
    compact_log(spark, _registry_path(store), REGISTRY_SCHEMA, before)
    return n


def materialise(df: DataFrame, entity: str, space: str, store: str) -> int:
    """Write a view to a new snapshot and register it; the milliseconds taken."""
    path = f"{store.rstrip('/')}/views/{folder_name(space)}/{folder_name(entity)}/{time.time_ns()}"
    t0 = time.time()
    df.hint("rebalance").write.mode("overwrite").parquet(path)
    ms = int(round((time.time() - t0) * 1000))
    register(df.sparkSession, store, entity, space, path, ms)
    return ms


def persist(df: DataFrame, entity: str, space: str, store: str) -> DataFrame:
    """Materialise a view, time it and register it.  Returns the outcome
    row (entity, space, success, run_time_ms, error); a failed run is an
    outcome that keeps its cause."""
    ms, error = None, None
    try:
        ms = materialise(df, entity, space, store)
    except Exception as e:  # noqa: BLE001 -- reported in the row
        error = f"{type(e).__name__}: {e}"
    return df.sparkSession.createDataFrame([(entity, space, error is None, ms, error)],
                                           "entity string, space string, success boolean, run_time_ms bigint, error string")


def unpersist(spark: SparkSession, entity: str, space: str, store: str) -> DataFrame:
    """Drop the view's registry entry, so it reads from its definition
    again.  Fails (success False) when the view is not persisted."""
    current = persisted_views(spark, store).filter((F.col("entity") == entity) & (F.col("space") == space))
    ok = current.limit(1).count() > 0
    if ok:
        register(spark, store, entity, space, None)
    return spark.createDataFrame([(entity, space, ok)], "entity string, space string, success boolean")


def persisted_views(spark: SparkSession, store: str) -> DataFrame:
    """Views persisted now: latest registry action per view is ``persist``."""
    last = last_per_key(read_registry(spark, store), ["entity", "space"], ["seq"], ["action", "path"])
    return last.filter(F.col("action") == "persist").select("entity", "space", "path")


def with_persisted_flag(views: DataFrame, spark: SparkSession, store: str,
                        entity: str = "entity", space: str = "space") -> DataFrame:
    """Add ``isPersisted`` to a view list by a left join on the key."""
    cur = persisted_views(spark, store).select(F.col("entity").alias("_pe"), F.col("space").alias("_ps"),
                                               F.lit(True).alias("_p"))
    j = views.join(cur, (views[entity] == cur["_pe"]) & (views[space] == cur["_ps"]), "left")
    return j.select(*[views[c] for c in views.columns], F.coalesce(F.col("_p"), F.lit(False)).alias("isPersisted"))


def read_view(spark: SparkSession, entity: str, space: str, store: str) -> DataFrame | None:
    """The persisted data of a view, or None when it is not persisted."""
    rows = persisted_views(spark, store).filter((F.col("entity") == entity) & (F.col("space") == space)) \
        .limit(1).collect()  # the registry holds one current row per view
    if not rows:
        return None
    path = rows[0]["path"]
    if path.startswith(f"{store.rstrip('/')}/ranges/"):  # a yearly layout, whose column is not the view's
        return read_partitioned(spark, path).drop(PARTITION_COL)
    return spark.read.parquet(path)
