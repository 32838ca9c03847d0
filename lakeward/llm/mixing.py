"""Mixing sources to target weights (native): capped water-filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeward.llm.common import checkpointed, free_name

MAX_BROADCAST_SOURCES = 10_000


def source_targets(sizes: DataFrame, source_col: str = "source", size_col: str = "size",
                   weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """Source, source_size and target per source.

    Sources in code-point order, null last, take ``weights`` in turn and
    share the total size.  No target exceeds ``max_epochs`` times its source;
    what is above it is shared again by weight until none is above.  Filling
    sources in order of capacity per weight reaches that fixed point at once:
    a source is full exactly when the share left for it, given that all
    before it are full, is above its capacity.  The windows run over one row
    per source.  Without any rows the result is empty; when all sizes are 0
    all targets are 0."""
    per = sizes.groupBy(source_col).agg(F.sum(size_col).cast("long").alias("source_size"))
    order = Window.orderBy(F.col(source_col).asc_nulls_last())
    nth = F.row_number().over(order)
    ranked = per.withColumn("_w", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]),
                                               (F.pmod(nth - 1, F.lit(len(weights))) + 1).cast("int")))
    fill = Window.orderBy((F.col("source_size") / F.col("_w")).asc(), F.col(source_col).asc_nulls_last())
    before, everything = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cap = (F.col("source_size") * max_epochs).alias("_cap")
    ranked = (ranked.withColumn("_cap", cap)
              .withColumn("_left", F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
              .withColumn("_left_w", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0))))
    # the first source that is not full fixes the level for all after it
    ranked = ranked.withColumn("_open", 
                               F.col("_left").cast("decimal(25,0)") * F.col("_w") <= F.col("_cap").cast("decimal(25,0)") * F.col("_left_w"))
    level = F.first(F.when(F.col("_open"), F.struct("_left", "_left_w")), ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("_level", level).select(
        source_col, "source_size",
        F.when(F.col("_level").isNull(), F.col("_cap").cast("double"))
        .otherwise((F.col("_level._left") * F.col("_w")).cast("double") / F.col("_level._left_w").cast("double")).alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size",
                weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 7, buckets: int = 4096) -> DataFrame:
    """``docs`` with source_size, target and repetitions (0 to ``max_epochs``).

    Every document repeats floor(target / source_size) times.  The fraction
    left is sampled: a seeded hash of the id puts the source's documents in
    one fixed random order, cut into ``buckets``; whole buckets go one more
    time while they fit, and within the bucket that crosses the line a second
    seeded draw keeps the share that fits.  So a source misses its target by
    part of one bucket, and a rerun agrees.  A null size counts as 0, a null
    source is a source, rows that repeat an id share its draw, an empty table
    stays empty.  Columns so named are replaced.

    Sizes are summed per source and bucket before any shuffle.  The table
    joined back has one row per source and is broadcast when it has at most
    MAX_BROADCAST_SOURCES rows; beyond that a plain join is left to skew
    handling."""
    b, draw = free_name(docs.columns, "_bucket"), free_name(docs.columns, "_draw")
    rows = (docs.drop("source_size", "target", "repetitions")
            .withColumn(b, F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(buckets)).cast("int"))
            .withColumn(draw, F.pmod(F.xxhash64(F.lit(seed + 1), F.col(id_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))))
    size = F.coalesce(F.col(size_col), F.lit(0)).cast("long")
    cells = checkpointed(rows.groupBy(F.col(source_col).alias("_s"), F.col(b).alias("_b")).agg(F.sum(size).alias("_size")))
    targets = source_targets(cells, "_s", "_size", weights, max_epochs)
    whole = F.floor(F.col("target") / F.col("source_size"))
    targets = (targets.withColumn("_whole", F.when(F.col("source_size") > 0, whole).otherwise(F.lit(0)).cast("int"))
               .withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size")))
    # per source: the bucket in which the running size passes what is left over
    run = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    running = cells.withColumn("_before", F.coalesce(F.sum("_size").over(run), F.lit(0)))
    t = targets.withColumnRenamed("_s", "_ts")
    line = (running.join(t, running["_s"].eqNullSafe(t["_ts"]))
            .filter((F.col("_before") <= F.col("_rest")) & (F.col("_before") + F.col("_size") > F.col("_rest")))
            .groupBy("_s").agg(F.min(F.struct("_b", ((F.col("_rest") - F.col("_before")) / F.col("_size")).alias("_share"))).alias("_line")))
    plan = (t.join(line, t["_ts"].eqNullSafe(line["_s"]), "left")
            .select("_ts", "source_size", "target", "_whole", F.col("_line._b").alias("_cut"), F.col("_line._share").alias("_share")))
    few = plan.limit(MAX_BROADCAST_SOURCES + 1).count() <= MAX_BROADCAST_SOURCES
    out = rows.join(F.broadcast(plan) if few else plan, F.col(source_col).eqNullSafe(F.col("_ts")), "left")
    extra = (F.col(b) < F.col("_cut")) | ((F.col(b) == F.col("_cut")) & (F.col(draw) < F.col("_share")))
    reps = F.least(F.col("_whole") + F.coalesce(extra, F.lit(False)).cast("int"), F.lit(max_epochs))
    return out.withColumn("repetitions", reps).drop(b, draw, "_ts", "_whole", "_cut", "_share")
