"""Table statistics: decision matrix, refresh plan and the profiles
themselves (F4, F5, A3-A6).

Catalogue columns: table_name, statistics_supported (bool), statistics_type
(string, null when the table has no statistics yet).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import islice

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeward.operators.runs import new_run
from lakeward.operators.tables import folder_name, path_exists, read_log
from lakeward.session import materialize

# --- fixed values: statistics types ------------------------------------------
STATISTICS_TYPES = ("RECORD_COUNT", "SIMPLE", "HISTOGRAM")
# --- end of fixed values -------------------------------------------------------

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_FLOATING = (T.FloatType, T.DoubleType)


def _check_type(statistics_type: str) -> str:
    if statistics_type not in STATISTICS_TYPES:
        raise ValueError(f"statistics type must be one of {STATISTICS_TYPES}, got {statistics_type!r}")
    return statistics_type


def plan_statistics(catalog: DataFrame, statistics_type: str) -> DataFrame:
    """what creating statistics of ``statistics_type`` does per table:
    unsupported -> skip; already this type -> skip; no statistics -> create;
    another type -> update."""
    t = _check_type(statistics_type)
    supported = F.coalesce(F.col("statistics_supported"), F.lit(False))
    current = F.col("statistics_type")
    action = (F.when(~supported, "skip").when(current.eqNullSafe(F.lit(t)), "skip")
              .when(current.isNull(), "create").otherwise("update"))
    return catalog.select("table_name", "statistics_supported", "statistics_type", action.alias("action"))


def plan_refresh(catalog: DataFrame) -> DataFrame:
    """tables to refresh -- supported and already holding statistics."""
    supported = F.coalesce(F.col("statistics_supported"), F.lit(False))
    return catalog.filter(supported & F.col("statistics_type").isNotNull()) \
        .select("table_name", "statistics_type")


def profile_record_count(df: DataFrame) -> DataFrame:
    """A3: ``RECORD_COUNT`` -- one row with the number of records."""
    return df.agg(F.count(F.lit(1)).alias("record_count"))


def _as_text(c: str, dtype: T.DataType):
    col = F.col(c)
    if isinstance(dtype, _FLOATING):
        col = col + F.lit(0.0)  # -0.0 and 0.0 are one value; render it as 0.0
    return col.cast("string")


def _identity(c: str, dtype: T.DataType) -> tuple[str, Column] | None:
    """A type that columns of its kind share, and a value of it that two values
    of the column share if and only if they are equal; long texts by their
    SHA-256.  None for nested types."""
    col = F.col(c)
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        return "bigint", col.cast("bigint")
    if isinstance(dtype, T.DateType):
        return "bigint", F.unix_date(col).cast("bigint")
    if isinstance(dtype, T.TimestampType):
        return "bigint", F.unix_micros(col)
    if isinstance(dtype, _FLOATING):
        return "double", col.cast("double")  # Spark groups -0.0 with 0.0, and NaN with NaN
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return None
    text = F.hex(c) if isinstance(dtype, T.BinaryType) else col.cast("string")
    return "string", F.when(F.length(text) > 64, F.sha2(text, 256)).otherwise(text)


def _distinct_counts(data: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column_name, distinct_count) of all columns in one scan per kind of
    value (whole numbers and times, floating numbers, texts): rows become
    (column, value) pairs, which are made distinct map-side before they are
    shuffled, and then counted per column.  Columns of nested types are
    counted on their own."""
    kinds: dict[str, list[tuple[str, Column]]] = {}
    out = []
    for f in data.schema.fields:
        known = _identity(f.name, f.dataType) if f.name in cols else None
        if known is not None:
            kinds.setdefault(known[0], []).append((f.name, known[1]))
        elif f.name in cols:
            out.append(data.agg(F.count_distinct(F.col(f.name)).alias("distinct_count")).select(F.lit(f.name).alias("column_name"), "distinct_count"))
    for pairs in kinds.values():
        stacked = F.stack(F.lit(len(pairs)), *[x for i, (_, v) in enumerate(pairs) for x in (F.lit(i), v)]).alias("i", "v")
        seen = data.select(stacked).filter("v is not null").distinct()
        names = F.array(*[F.lit(c) for c, _ in pairs])
        out.append(seen.groupBy("i").agg(F.count(F.lit(1)).alias("distinct_count")).select(F.get(names, F.col("i")).alias("column_name"), "distinct_count"))
    return reduce(DataFrame.unionByName, out)


def profile_simple(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False,
                   staged: bool = False) -> DataFrame:
    """A4: ``SIMPLE`` -- per column: non-null count, null count, distinct
    count, min and max (as text), in long form.

    At most four scans, whatever the number of columns: one global aggregate
    for counts/min/max (one row per task crosses the shuffle) and one of
    distinct (column, value) pairs per kind of value for the exact distinct
    counts.  The long forms are merged by a union and a group-by on the column
    name.

    ``approx=True`` puts HyperLogLog++ sketches (``approx_count_distinct``)
    into the global aggregate: one scan and no shuffle of values -- the choice
    for very wide or very large tables where exact distinct counts are not
    required.

    ``staged=True`` writes ``df`` once to the shared folder and profiles that:
    for a view whose plan is more than a scan, which would otherwise run
    once per scan."""
    cols = list(columns) if columns else list(df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    data = df.select(*cols)
    if staged:
        data = materialize(data, "profiled")
    basic_aggs = []
    for i, c in enumerate(cols):
        basic_aggs += [F.count(c).alias(f"n{i}"), F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}")]
        if approx:
            basic_aggs.append(F.approx_count_distinct(c).alias(f"d{i}"))
    basic = data.agg(F.count(F.lit(1)).alias("_rows"), *basic_aggs)
    basic_long = basic.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("row_count"),
                 (F.col("_rows") - F.col(f"n{i}")).alias("null_count"),
                 (F.col(f"d{i}") if approx else F.lit(0)).cast("bigint").alias("distinct_count"),
                 _as_text(f"lo{i}", types[c]).alias("min_value"), _as_text(f"hi{i}", types[c]).alias("max_value"))
        for i, c in enumerate(cols)])))
    if approx:
        return basic_long
    counts = _distinct_counts(data, cols).select(
        "column_name", F.lit(None).cast("bigint").alias("row_count"), F.lit(None).cast("bigint").alias("null_count"),
        F.col("distinct_count").cast("bigint").alias("distinct_count"), F.lit(None).cast("string").alias("min_value"), F.lit(None).cast("string").alias("max_value"))
    return basic_long.unionByName(counts).groupBy("column_name").agg(
        *[F.max(c).alias(c) for c in ("row_count", "null_count", "distinct_count", "min_value", "max_value")])


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC)]


def profile_histogram(df: DataFrame, columns: Sequence[str] | None = None, bins: int = 10) -> DataFrame:
    """A5: ``HISTOGRAM`` -- equal-width bins per numeric column.

    bin = least(bins - 1, floor((x - min) / (max - min) * bins)); a column
    whose min equals its max puts every value in bin 0; nulls, NaN and
    infinities are not counted; empty bins are reported with 0.  Columns: column_name, bin,
    lower, upper, row_count.

    The per-column min/max is one tiny aggregate (one row to the driver);
    the binning is one scan that unpivots (column, bin) pairs and one
    partial aggregate, so the shuffle carries at most bins x columns rows per
    map task."""
    spark = df.sparkSession
    bins = int(bins)
    if bins < 1:
        raise ValueError("bins must be >= 1")
    cols = list(columns) if columns else numeric_columns(df)
    bad = [c for c in cols if c not in numeric_columns(df)]
    if bad:
        raise ValueError(f"histogram needs numeric columns, got {bad}")
    def finite(c):
        v = F.col(c).cast("double")
        return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)

    mm = df.agg(*[F.min(finite(c)).alias(f"lo{i}") for i, c in enumerate(cols)],
                *[F.max(finite(c)).alias(f"hi{i}") for i, c in enumerate(cols)]).first()
    bounds = {c: (mm[f"lo{i}"], mm[f"hi{i}"]) for i, c in enumerate(cols)}
    pairs = []
    for c in cols:
        lo, hi = bounds[c]
        if lo is None:  # no values at all
            continue
        x = finite(c)
        if hi == lo:
            b = F.lit(0)
        else:
            b = F.least(F.lit(bins - 1), F.floor((x - F.lit(lo)) / (F.lit(hi) - F.lit(lo)) * F.lit(bins)).cast("int"))
        pairs.append(F.struct(F.lit(c).alias("column_name"), F.when(x.isNotNull(), b).alias("bin")))
    schema = "column_name string, bin int, lower double, upper double"
    grid_rows = []
    for c in cols:
        lo, hi = bounds[c]
        if lo is None:
            continue
        for b in range(bins):
            grid_rows.append((c, b, lo, hi))
    grid = spark.createDataFrame(grid_rows, "column_name string, bin int, lo double, hi double") \
        if grid_rows else spark.createDataFrame([], "column_name string, bin int, lo double, hi double")
    grid = grid.select("column_name", "bin",
                       (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("bin") / F.lit(float(bins))).alias("lower"),
                       (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("bin") + 1) / F.lit(float(bins))).alias("upper"))
    if not pairs:
        return spark.createDataFrame([], schema + ", row_count bigint")
    counts = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*") \
        .filter(F.col("bin").isNotNull()).groupBy("column_name", "bin").agg(F.count(F.lit(1)).alias("row_count"))
    return grid.join(counts, ["column_name", "bin"], "left") \
        .select("column_name", "bin", "lower", "upper", F.coalesce("row_count", F.lit(0)).cast("bigint").alias("row_count"))


def profile(df: DataFrame, statistics_type: str, bins: int = 10, approx: bool = False) -> DataFrame:
    t = _check_type(statistics_type)
    if t == "RECORD_COUNT":
        return profile_record_count(df)
    if t == "SIMPLE":
        return profile_simple(df, approx=approx)
    return profile_histogram(df, bins=bins)


# --- profiles of many tables ------------------------------------------------------

OUTCOMES = "table_name string, statistics_type string, action string, status string, error string"
WINDOW = 100  # tables whose outcomes the driver holds at once, and whose records are counted in one plan

Tables = Mapping[str, DataFrame] | Callable[[str], DataFrame | None]


def _store_profiles(prof: DataFrame, stype: str, store: str) -> None:
    (prof.repartition(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("table_name").parquet(f"{store.rstrip('/')}/{stype.lower()}"))


def _run_profiles(spark: SparkSession, todo: DataFrame, tables: Tables, store: str, bins: int, approx: bool,
                  parallelism: int, run: str | None) -> DataFrame:
    """Profile the tables of ``todo`` (table_name, statistics_type, action)
    that have no outcome under ``run`` and log one outcome each.

    The plan is read window by window, never whole.  Record counts of a window
    are one union, written at once; other profiles are a job per table,
    ``parallelism`` side by side.  A failed table is an outcome."""
    log = f"{store.rstrip('/')}/_outcomes/{folder_name(run or new_run())}"
    if path_exists(spark, log):
        todo = todo.join(read_log(spark, log, OUTCOMES).select("table_name"), "table_name", "left_anti")

    def find(name: str) -> DataFrame | None:
        return tables(name) if callable(tables) else tables.get(name)

    def one(row: Row) -> tuple:
        name, stype = row["table_name"], row["statistics_type"]
        try:
            df = find(name)
            if df is None or stype not in STATISTICS_TYPES:
                raise LookupError(f"no table {name!r} or no statistics type {stype!r}")
            _store_profiles(profile(df, stype, bins=bins, approx=approx).withColumn("table_name", F.lit(name)), stype, store)
        except Exception as e:  # noqa: BLE001 -- one failed table is an outcome, not a crash
            return name, stype, row["action"], "failed", f"{type(e).__name__}: {e}"
        return name, stype, row["action"], _DONE[row["action"]], None

    def count_all(rows: list[Row]) -> list[tuple]:
        """Outcomes of the record counts of a window; none if the one plan fails."""
        try:
            counted = [profile_record_count(find(r["table_name"])).withColumn("table_name", F.lit(r["table_name"])) for r in rows]
            _store_profiles(reduce(DataFrame.unionByName, counted), "RECORD_COUNT", store)
        except Exception:  # noqa: BLE001 -- then each table is profiled for itself and has its own cause
            return []
        return [(r["table_name"], r["statistics_type"], r["action"], _DONE[r["action"]], None) for r in rows]

    plan = todo.select("table_name", "statistics_type", "action").toLocalIterator()
    with ThreadPoolExecutor(max_workers=max(1, int(parallelism))) as pool:
        while window := list(islice(plan, WINDOW)):
            counts = [r for r in window if r["statistics_type"] == "RECORD_COUNT"]
            out = count_all(counts) if len(counts) > 1 else []
            left = [r for r in window if not out or r["statistics_type"] != "RECORD_COUNT"]
            out += pool.map(one, left)
            spark.createDataFrame(out, OUTCOMES).coalesce(1).write.mode("append").parquet(log)
    return read_log(spark, log, OUTCOMES)


_DONE = {"create": "created", "update": "updated", "refresh": "refreshed"}


def refresh_profiles(spark: SparkSession, catalog: DataFrame, tables: Tables, store: str,
                     bins: int = 10, approx: bool = False, parallelism: int = 4, run: str | None = None) -> DataFrame:
    """Recompute the profile of every table that F5 selects, at the type
    it already has, and replace that table's stored profile.

    The store holds one folder per statistics type, partitioned by
    ``table_name``; dynamic partition overwrite replaces just the refreshed
    tables' partitions.  ``tables`` holds the tables by name, or gives one for a
    name.  Returns one row per table: table_name, statistics_type, status
    (refreshed / failed), error.  The same ``run`` resumes a lost one."""
    todo = plan_refresh(catalog).select("table_name", "statistics_type", F.lit("refresh").alias("action"))
    return _run_profiles(spark, todo, tables, store, bins, approx, parallelism, run).drop("action")


def create_statistics(spark: SparkSession, catalog: DataFrame, statistics_type: str,
                      tables: Tables, store: str, bins: int = 10, approx: bool = False,
                      parallelism: int = 4, run: str | None = None) -> DataFrame:
    """Create statistics of ``statistics_type`` for every catalogue table:
    F4 decides (create / update / skip), the profile is computed and stored
    for create and update, and one outcome per table is returned:
    table_name, action, status (created / updated / skipped / failed), error.
    A table the catalogue names but ``tables`` does not provide fails.  The
    same ``run`` resumes a lost one."""
    t = _check_type(statistics_type)
    plan = plan_statistics(catalog, t)
    todo = plan.filter("action <> 'skip'").select("table_name", F.lit(t).alias("statistics_type"), "action")
    done = _run_profiles(spark, todo, tables, store, bins, approx, parallelism, run).drop("statistics_type")
    skipped = plan.filter("action = 'skip'").select("table_name", "action", F.lit("skipped").alias("status"),
                                                    F.lit(None).cast("string").alias("error"))
    return done.unionByName(skipped)


def read_profiles(spark: SparkSession, store: str, statistics_type: str) -> DataFrame:
    """Stored profiles of one statistics type (table_name as a string column)."""
    df = spark.read.parquet(f"{store.rstrip('/')}/{_check_type(statistics_type).lower()}")
    return df.withColumn("table_name", F.col("table_name").cast("string"))
