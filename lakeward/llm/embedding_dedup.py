"""Embedding near-dedup by an epsilon grid order join.

Unit vectors with cosine >= c are at most epsilon = sqrt(2 - 2c) apart, and
so are their projections on any orthonormal directions.  Vectors are sorted
by the epsilon-wide grid cells of their leading principal coordinates and cut
into intervals of that sequence.  Two intervals whose boxes are farther apart
than epsilon are never joined; a joined pair is halved recursively, again
skipping provably distant halves, down to small blocks, whose leading
coordinates are multiplied; what these do not rule out is multiplied whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeward.llm.common import checkpointed
from lakeward.llm.components import connected_components
from lakeward.llm.union import Union

LEAD = 6  # principal coordinates that make the grid
ROWS_PER_INTERVAL = 4096  # at least
INTERVAL_BYTES = 16 << 20  # of vectors, at most, unless ROWS_PER_INTERVAL vectors are more
MAX_INTERVALS = 2048  # bounds the intervals that meet each other
SMALL = 512  # rows of a block that is multiplied whole
SURE = 3.5  # standard deviations that unrelated vectors are below the threshold
SURE_PAIRS = 1 << 14  # pairs compared in double precision at once
COARSE = 1e-4  # more than single precision can be off
MARGIN = 1e-9
PLACED = "rep long, weight long, code long, x binary, block long"


def _boxes_apart(lo1, hi1, lo2, hi2) -> np.ndarray:
    gap = np.maximum(0, np.maximum(lo1 - hi2, lo2 - hi1))
    return (gap * gap).sum(axis=-1)


def filter_width(energy: np.ndarray, least: float) -> int:
    """Leading principal coordinates on which a pair is bounded first: as many
    as rule out pairs of vectors that have nothing to do with each other,
    given the mean squares ``energy`` of all coordinates."""
    share, spread = np.cumsum(energy), np.sqrt(np.cumsum(energy * energy))
    enough = np.flatnonzero(share - (1 - least) >= SURE * spread)
    return max(min(LEAD, len(energy)), int(enough[0]) + 1 if len(enough) else len(energy))


def _projected(x: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leading coordinates of unit vectors; all coordinates on ``axes`` with
    the length of what they leave, whose products are no less than the cosine."""
    p = x @ axes
    rest = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", p, p)))
    return p[:, :LEAD], np.concatenate((p, rest[:, None]), axis=1).astype(np.float32)


def join_sequences(x: np.ndarray, y: np.ndarray, axes: np.ndarray, least: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) with cosine >= ``least``, i < j when both sequences
    are the same; recursion over halves, distant intervals skipped."""
    eps2 = 2 - 2 * least + MARGIN
    px, fx = _projected(x, axes)
    py, fy = (px, fx) if same else _projected(y, axes)
    sides, boxes = (px, py), {}

    def box(side, a, b):
        if (side, a, b) not in boxes:
            p = sides[side][a:b]
            boxes[side, a, b] = p.min(0), p.max(0)
        return boxes[side, a, b]

    products, close = np.empty(SMALL * SMALL, np.float32), np.empty(SMALL * SMALL + 8, bool)
    stack = [(0, len(x), 0, len(y))]
    while stack:
        a, b, c, d = stack.pop()
        if b <= a or d <= c or (same and d <= a):
            continue
        if _boxes_apart(*box(0, a, b), *box(1, c, d)) > eps2:
            continue
        if b - a <= SMALL and d - c <= SMALL:
            size = (b - a) * (d - c)
            np.matmul(fx[a:b], fy[c:d].T, out=products[:size].reshape(b - a, d - c))
            np.greater_equal(products[:size], np.float32(least - COARSE), out=close[:size])
            close[size:size + 8] = False
            eights = close[:-(-size // 8) * 8].reshape(-1, 8)
            some = np.flatnonzero(eights.view(np.uint64) != 0)
            k, at = np.nonzero(eights[some])
            i, j = np.divmod(some[k] * 8 + at, d - c)
            i, j = i + a, j + c
            if same:
                up = i < j
                i, j = i[up], j[up]
            for k in range(0, len(i), SURE_PAIRS):
                u, v = i[k:k + SURE_PAIRS], j[k:k + SURE_PAIRS]
                sure = np.einsum("ij,ij->i", x[u], y[v]) >= least  # in double precision
                if sure.any():
                    yield u[sure], v[sure]
        elif b - a >= d - c:
            m = (a + b) // 2
            stack += [(a, m, c, d), (m, b, c, d)]
        else:
            m = (c + d) // 2
            stack += [(a, b, c, m), (a, b, m, d)]


def _single(vectors: DataFrame, vector_col: str) -> bool:
    return isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType)


def distinct_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows: _id, _key; classes: _key, rep, weight, _v).  Vectors that are
    null, zero or hold null or non-finite components have a null key.  Single
    precision is kept as it is; other numbers become double."""
    v = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    kept = F.col(vector_col) if _single(vectors, vector_col) else v
    good = (F.size(v) > 0) & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(v, lambda c: c != 0)
    rows = vectors.select(F.col(id_col).alias("_id"), F.when(F.coalesce(good, F.lit(False)), kept).alias("_v"))
    w = F.transform("_v", lambda c: c.cast("double"))
    key = F.struct(F.xxhash64(w).alias("h"), F.hash(w).alias("g"), F.size(w).alias("d"))
    rows = rows.withColumn("_key", F.when(F.col("_v").isNotNull() & F.col("_id").isNotNull(), key))
    classes = (rows.filter("_key is not null").groupBy("_key")
               .agg(F.min("_id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.min("_v").alias("_v")))
    return rows.select("_id", "_key"), classes


def link_embeddings(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9) -> DataFrame:
    """One row per vector: ``id_col``, n_links, component_id, kept.

    n_links counts the other rows with cosine >= ``least`` in double
    precision; component_id is the smallest id reachable by links.  Vectors
    that are null, zero or hold null or non-finite components, and rows with
    a null id, link with nothing; their component is their own id.  Vectors
    of different length never link.  Equal vectors are one class, counted
    with its rows, so a vector held by a third of the table costs one row.
    An empty table gives an empty result; other columns are not read.

    All rows are joined, exactly: skipped blocks and pairs are provably
    distant.  A task reads the intervals it joins from the shared folder, so
    nothing is written per pair of intervals, and returns a count per vector
    and a spanning forest of the links, never the pairs."""
    spark = vectors.sparkSession
    rows, classes = distinct_vectors(vectors, id_col, vector_col)
    rows, classes = checkpointed(rows), checkpointed(classes)
    dims = [r["d"] for r in classes.select(F.size("_v").alias("d")).groupBy("d").count().select("d").collect()]
    found = None
    for d in sorted(dims):  # one join per vector length; tables have one length as a rule
        part = _join_classes(spark, classes.filter(F.size("_v") == d), d, least, np.dtype("<f4" if _single(vectors, vector_col) else "<f8"))
        found = part if found is None else found.union(part)
    if found is None:
        found = spark.createDataFrame([], "rep long, root long, n long")
    found = checkpointed(found)
    near = found.groupBy("rep").agg(F.sum("n").alias("n"))
    comp = connected_components(found.select("rep", "root").filter("rep <> root"), "rep", "root")
    classes = (classes.select("_key", "rep", "weight").join(near, "rep", "left").join(comp, F.col("node") == F.col("rep"), "left")
               .select("_key", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    out = rows.join(classes, "_key", "left")
    return out.select(F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("component_id", "_id").cast("long").alias("component_id"),
                      F.coalesce(F.col("_id") == F.coalesce("component_id", "_id"), F.lit(False)).alias("kept"))


SUMMED = "part long, m binary, n long"
SUM_BYTES = 64 << 20  # of matrices that one task adds up


def _second_moments(vectors: DataFrame, dim: int) -> tuple[int, np.ndarray]:
    """Number of unit vectors and the sum of their outer products.  Each
    partition has one matrix; as many as SUM_BYTES hold are added per task,
    round by round, and the driver receives one."""
    def moments(frames):
        total, n = np.zeros((dim, dim)), 0
        for f in frames:
            x = _rows(f["_v"])
            total += x.T @ x
            n += len(x)
        yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "m": [total.tobytes()], "n": [n]})

    def add(f):
        total = np.zeros(dim * dim)
        for m in f.sort_values("part")["m"]:
            total += np.frombuffer(m)
        return pd.DataFrame({"part": [int(f["part"].iloc[0]) // fan], "m": [total.tobytes()], "n": [int(f["n"].sum())]})

    fan = max(2, SUM_BYTES // (8 * dim * dim))
    parts = vectors.mapInPandas(moments, SUMMED)
    left = vectors.rdd.getNumPartitions()
    while True:
        parts = checkpointed(parts.groupBy(F.floor(F.col("part") / fan).alias("g")).applyInPandas(add, SUMMED))
        left = -(-left // fan)
        if left <= 1:
            break
    rows = parts.collect()  # one, or none without vectors
    return sum(r["n"] for r in rows), sum((np.frombuffer(bytes(r["m"])).reshape(dim, dim) for r in rows), np.zeros((dim, dim)))


def _interval_rows(count: int, row_bytes: int, cores: int) -> int:
    """Vectors of an interval: so many that the pairs of intervals keep all
    cores busy, and that a task can hold two."""
    return max(ROWS_PER_INTERVAL, min(INTERVAL_BYTES // row_bytes, math.ceil(count / math.ceil(math.sqrt(8 * cores)))))


def _join_classes(spark, classes: DataFrame, dim: int, least: float, kind: np.dtype) -> DataFrame:
    count, second = _second_moments(classes.select("_v"), dim)
    energy, axes = (a[..., ::-1] for a in np.linalg.eigh(second / max(count, 1)))
    axes = np.ascontiguousarray(axes[:, :filter_width(energy, least)])
    lead = min(LEAD, dim)
    leading = np.ascontiguousarray(axes[:, :lead])
    eps = float(np.sqrt(2 - 2 * least))

    def codes(f):
        p = _rows(f["_v"]) @ leading
        cells = np.clip(np.floor(p / eps) + 128, 0, 255).astype(np.int64)
        code = np.zeros(len(f), np.int64)
        for k in range(lead):
            code = code * 256 + cells[:, k]
        # within a cell, sequence by the first coordinates themselves
        fine = np.clip((p[:, 0] / eps - np.floor(p[:, 0] / eps)) * 4096, 0, 4095).astype(np.int64)
        return code * 4096 + fine

    def place(frames):
        for f in frames:
            yield pd.DataFrame({"code": codes(f)})

    n = max(1, min(MAX_INTERVALS, -(-count // _interval_rows(count, kind.itemsize * dim, spark.sparkContext.defaultParallelism))))
    cuts = sorted(classes.select("_v").mapInPandas(place, "code long")
                  .agg(F.percentile_approx("code", [k / n for k in range(1, n)], 100 * n)).first()[0]) if n > 1 else []
    # a code that fills several intervals is spread over them by a hash of the id
    lower, upper = np.searchsorted(cuts, np.unique(cuts), "left"), np.searchsorted(cuts, np.unique(cuts), "right")
    spread = {int(c): (int(a), int(b)) for c, a, b in zip(np.unique(cuts), lower, upper)} if len(cuts) else {}
    edges = np.array(cuts, np.int64)

    def interval(frames):
        for f in frames:
            code = codes(f)
            at = np.searchsorted(edges, code, "right")
            for k in np.flatnonzero(np.isin(code, list(spread))):
                a, b = spread[int(code[k])]
                at[k] = a + int(f["rep"].iloc[k]) % (b - a + 1)
            yield pd.DataFrame({"rep": f["rep"], "weight": f["weight"], "code": code, "x": [np.asarray(v, kind).tobytes() for v in f["_v"]],
                                "block": at.astype(np.int64)})

    def pack(f):
        f = f.sort_values(["code", "rep"])
        x = b"".join(f["x"])
        p = _unit(np.frombuffer(x, kind).reshape(-1, dim)) @ leading
        return pd.DataFrame({"block": [int(f["block"].iloc[0])], "reps": [f["rep"].to_numpy(np.int64).tobytes()],
                             "weights": [f["weight"].to_numpy(np.int64).tobytes()], "x": [x], "lo": [p.min(0)], "hi": [p.max(0)]})

    packed = checkpointed(classes.select("rep", "weight", "_v").mapInPandas(interval, PLACED).groupBy("block")
                          .applyInPandas(pack, "block long, reps binary, weights binary, x binary, lo array<double>, hi array<double>").coalesce(n))
    left, right = (packed.select([F.col(c).alias(f"{c}{side}") for c in packed.columns]) for side in (1, 2))
    gap = F.zip_with(F.zip_with("lo1", "hi2", lambda a, b: a - b), F.zip_with("lo2", "hi1", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    near = F.aggregate(gap, F.lit(0.0), lambda total, g: total + g * g) <= eps * eps + MARGIN
    # each task reads two partitions of intervals where they were written: no copy is made for a pair
    work = left.hint("shuffle_replicate_nl").join(right, (F.col("block1") <= F.col("block2")) & near)

    def joined(frames):
        for f in frames:
            for r in f.itertuples(index=False):
                same = r.block1 == r.block2
                reps, weights = np.frombuffer(r.reps1, np.int64), np.frombuffer(r.weights1, np.int64)
                x = y = _unit(np.frombuffer(r.x1, kind).reshape(-1, dim))
                if not same:
                    reps, weights = np.concatenate([reps, np.frombuffer(r.reps2, np.int64)]), np.concatenate([weights, np.frombuffer(r.weights2, np.int64)])
                    y = _unit(np.frombuffer(r.x2, kind).reshape(-1, dim))
                shift = 0 if same else len(x)
                links, forest = np.zeros(len(reps), np.int64), Union(len(reps))
                for i, j in join_sequences(x, y, axes, least, same):
                    j = j + shift
                    np.add.at(links, i, weights[j])
                    np.add.at(links, j, weights[i])
                    for u, v in zip(i.tolist(), j.tolist()):
                        forest.link(u, v)
                at = np.flatnonzero(links)
                yield pd.DataFrame({"rep": reps[at], "root": reps[forest.roots(at)], "n": links[at]})

    return work.select("block1", "block2", "reps1", "weights1", "x1", "reps2", "weights2", "x2").mapInPandas(joined, "rep long, root long, n long")


def _rows(v) -> np.ndarray:
    return _unit(np.stack([np.asarray(a, np.float64) for a in v]) if len(v) else np.zeros((0, 1)))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    scale = np.abs(x).max(axis=1, keepdims=True) if len(x) else 1
    x = x / scale  # no overflow or underflow of squares
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
