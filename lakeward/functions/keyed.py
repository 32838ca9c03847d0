"""Keyed "first" / "last" selection and null-safe joins.

"The first catalogue match wins" and "the last outcome wins" are written as
aggregates of ``min``/``max`` over a struct that leads with the ordering
columns.  An aggregate (unlike a ``row_number`` window) is computed partially
on the map side, so a key holding a third of all rows is reduced to one row
per map task before the shuffle instead of landing whole in one task.

Null-safe keys are packed into one struct column (``_key``): struct equality
treats null fields as equal, so a plain equi-join on the packed key matches
an empty key with an empty key, and a "last per key" grouped on the same
packed key is already partitioned the way the join needs it -- no second
shuffle of the aggregated side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = "_key"
BYTES_PER_TASK = 8 << 20  # of input files; a few 100,000 rows


def task_count(df: DataFrame) -> int | None:
    """Tasks for ``df`` by the size of the files it is read from: one per
    ``BYTES_PER_TASK``, at least one per core.  None if it is read from none."""
    spark, files = df.sparkSession, df.inputFiles()
    if not files:
        return None
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)) for f in files]
    size = sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)
    return max(spark.sparkContext.defaultParallelism, -(-size // BYTES_PER_TASK))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over ``task_count`` tasks.

    A shuffle that Spark plans has as many tasks as the session says, fewer
    where AQE finds the rows small once compressed, and the hash maps and
    sorts of a task hold all its rows.  Here their number grows with the
    input, so what a task holds does not.  Choose keys of which none has many
    rows: a shuffle of given size is not split.  Rows that are read from no
    files are left as they lie."""
    n = task_count(df)
    return df if n is None else df.repartition(n, *keys)


def pack_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the packed key struct ``_key`` of ``keys``."""
    return df.withColumn(KEY, F.struct(*[F.col(k) for k in keys]))


def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], agg,
          packed: bool) -> DataFrame:
    keys, order, values = list(keys), list(order), list(values)
    fields = order + [v for v in values if v not in order]
    packed_vals = F.struct(*[F.col(c).alias(f"f{i}") for i, c in enumerate(fields)])
    group = [KEY] if packed else keys
    src = pack_key(df, keys) if packed else df
    picked = src.groupBy(*group).agg(agg(packed_vals).alias("_pick"))
    return picked.select(*group, *[F.col(f"_pick.f{fields.index(v)}").alias(v) for v in values])


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str],
                  packed: bool = False) -> DataFrame:
    """One row per key holding ``values`` of the row that sorts first by
    ``order`` (ties broken by ``values``).  ``packed=True`` groups on the
    packed key ``_key`` (null-safe join input) instead of the key columns."""
    return _pick(df, keys, order, values, F.min, packed)


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str],
                 packed: bool = False) -> DataFrame:
    """One row per key holding ``values`` of the row that sorts last by
    ``order`` (ties broken by ``values``); see ``first_per_key``."""
    return _pick(df, keys, order, values, F.max, packed)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on ``keys`` with null-safe equality (a null key matches a null
    key, as two empty CSV fields compare equal), keeping the left key
    columns.  ``right`` may already carry the packed key ``_key`` (e.g. from
    ``last_per_key(..., packed=True)``); its own key columns are dropped."""
    keys = list(keys)
    lft = pack_key(left, keys)
    r = right if KEY in right.columns else pack_key(right, keys)
    r = r.drop(*[k for k in keys if k in r.columns])
    return lft.join(r, KEY, how).drop(KEY)


def packed_join(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str],
                how: str = "left", null_safe: bool = False) -> DataFrame:
    """Equi-join on keys packed into one struct per side.

    Used where one side is an aggregate already partitioned by its key
    columns: joining on the packed key makes Spark re-shuffle that side (one
    row per key) so both join inputs are plain shuffle reads -- the shape in
    which AQE's skew-join rule can split a hot key of the other side.
    ``null_safe=False`` keeps plain equality: a key with a null field never
    matches.  The right side's key columns are dropped."""
    def pack(df, keys, name):
        s = F.struct(*[F.col(k) for k in keys])
        if not null_safe:
            any_null = None
            for k in keys:
                c = F.col(k).isNull()
                any_null = c if any_null is None else (any_null | c)
            s = F.when(~any_null, s)
        return df.withColumn(name, s)

    lft = pack(left, left_keys, KEY)
    r = pack(right, right_keys, KEY).drop(*right_keys)
    return lft.join(r, KEY, how).drop(KEY)
