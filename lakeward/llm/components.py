"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeward.functions.keyed import packed_join
from lakeward.llm.common import Rounds, checkpointed

ROWS_PER_TASK = 100_000  # few edges need few tasks, whatever the session's shuffle partitions are


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; component is the
    smallest node reachable.  Edges with a null end are left out; direction,
    repeats and loops do not matter; without edges the result is empty.

    Each step is a partial aggregate (the smallest neighbour per node) and a
    join that re-shuffles the aggregated side, so a node linked to a third of
    all others is split by skew handling.  Steps are written to the shared folder; the
    edges never reach the driver, which sees two sums per round."""
    rounds = Rounds(edges.sparkSession)
    loops = checkpointed(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null"))
    nodes = loops.select("u").union(loops.select("v")).distinct()
    cur = rounds.next(loops.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(cur)
    tasks = 2 + state[0] // ROWS_PER_TASK
    while state[0]:
        both = cur.union(cur.select("v", "u"))
        large = _to_least(both, both.filter("v > u"), tasks)
        small = _to_least(large, large, tasks)
        cur = rounds.next(small.filter("u <> v").distinct().coalesce(tasks))
        new = _state(cur)
        if new == state:
            break
        state = new
    # at the fixed point every edge leads from a node to its component
    return (nodes.join(cur.hint("merge"), "u", "left")
            .select(F.col("u").alias("node"), F.coalesce("v", "u").alias("component")))


def _to_least(edges: DataFrame, moved: DataFrame, tasks: int) -> DataFrame:
    """Edges from every node that ``moved`` leads to, and from u itself, to
    the smallest of u and its neighbours in ``edges``."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).coalesce(tasks)
    met = packed_join(moved, least.hint("merge"), ["u"], ["u"], "inner").coalesce(tasks)
    return met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v")


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]
