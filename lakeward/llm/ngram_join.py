"""N-gram Jaccard join with a count-vector R-tree.

A document's word shingles are hashed; its set's hashes fall into groups and
the counts per group are its point.  No two sets share more than the summed
coordinate-wise minima of their points, and no two members of two boxes more
than the summed minima of the boxes' upper corners, so an R-tree over points
skips node pairs that cannot reach the threshold.  Pairs that survive are
verified on the sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeward.functions.keyed import packed_join
from lakeward.llm.common import checkpointed, mix64, row_slices, text_buffers, word_hashes
from lakeward.llm.components import connected_components
from lakeward.llm.union import Union

PER_GROUP = 4  # shingles per coordinate of a point, at most
LEAST_GROUPS = 256  # coordinates of a point, at least: with few, small sets that share little reach the threshold
COARSE = 64  # coordinates on which blocks of pairs are compared before their points
LEAF, FAN = 64, 8
HUGE = 1 << 20  # stands for a count that one byte cannot hold
CHUNK = 1024  # entries of one key, or members of one class, joined in one task
MISS = 1e-12  # chance that a linked pair shares none of its smallest hashes

_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                  0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingle_sets(data: np.ndarray, offs: np.ndarray, words: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes per row: a row with fewer words has its
    whole sequence as one shingle, a row without words none."""
    step = np.array([int(_STEP[k % 8]) + 2 * (k // 8) for k in range(words)], np.uint64)
    for a, b in row_slices(offs):
        h, wo = word_hashes(data, offs, a, b)
        n = len(h)
        rolled = np.zeros(max(0, n - words + 1), np.uint64)
        for k in range(words):
            rolled += h[k:n - words + 1 + k] * step[k]
        rolled = mix64(rolled)
        for i in range(b - a):
            lo, hi = int(wo[i]), int(wo[i + 1])
            if hi - lo >= words:
                yield np.unique(rolled[lo:hi - words + 1])
            elif hi > lo:
                yield mix64((h[lo:hi] * step[:hi - lo]).sum(keepdims=True) + np.uint64(hi - lo))
            else:
                yield np.zeros(0, np.uint64)


def sketch_size(percent: int) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - percent / 100)) if percent < 100 else 1


def groups_for(n):
    """Coordinates of a point for sets of n: a power of two, so that a finer
    point folds into a coarser one.  Sets that link differ little in size, so their points are seldom folded."""
    return np.maximum(LEAST_GROUPS, 1 << np.maximum(0, np.ceil(np.log2(np.maximum(np.asarray(n), 1) / PER_GROUP))).astype(np.int64))


def point(s: np.ndarray, groups: int) -> np.ndarray:
    return np.bincount((s & np.uint64(groups - 1)).astype(np.intp), minlength=groups)


def fold(p: np.ndarray, groups: int) -> np.ndarray:
    return p.reshape(-1, groups).sum(axis=0)


def common_bound(points: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Most members that sets ``x`` and ``y`` can share, pair by pair."""
    out, step = np.empty(len(x), np.int64), max(1, (1 << 20) // points.shape[1])
    for k in range(0, len(x), step):
        out[k:k + step] = np.minimum(points[x[k:k + step]], points[y[k:k + step]]).sum(axis=1)
    return out


_LANES, _ADD = np.uint64(0x00FF00FF00FF00FF), np.uint64(0x0001000100010001)


def block_bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Summed minima of every row of ``a`` with every row of ``b``; COARSE
    counts of one byte each are added eight at a time."""
    low = np.minimum(a[:, None], b[None])
    if low.dtype != np.uint8:
        return low.sum(axis=2)
    low = low.view(np.uint64)
    return (((low & _LANES) + ((low >> np.uint64(8)) & _LANES)).sum(axis=2) * _ADD >> np.uint64(48)).astype(np.int64)


class PointTree:
    """Packed R-tree over count points folded to COARSE coordinates, in the
    order of set size; the points themselves bound the pairs it leaves."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, percent: int):
        self.percent = percent
        coarse = points.reshape(len(points), -1, COARSE).sum(axis=1)
        self.order = np.lexsort((coarse[:, 1], coarse[:, 0], sizes))
        self.fine, self.points, self.sizes = points, coarse[self.order], sizes[self.order]
        n, self.levels = len(sizes), []
        starts = np.arange(0, n, LEAF)
        top, low = np.maximum.reduceat(self.points, starts), np.minimum.reduceat(self.sizes, starts)
        self.levels.append((top, low))
        while len(top) > 1:
            starts = np.arange(0, len(top), FAN)
            top, low = np.maximum.reduceat(top, starts), np.minimum.reduceat(low, starts)
            self.levels.append((top, low))
        if self.points.max(initial=0) < 256:
            self.points = self.points.astype(np.uint8)

    def reaches(self, common: np.ndarray, both: np.ndarray) -> np.ndarray:
        return (100 + self.percent) * common >= self.percent * both

    def join(self, visit: Callable[[np.ndarray, np.ndarray], None], skip: Callable[[np.ndarray], bool]) -> None:
        """``visit`` gets the positions of pairs whose bound reaches the
        threshold, block by block; ``skip`` may rule out a block of positions."""
        n = len(self.sizes)
        stack = [(len(self.levels) - 1, 0, 0)]
        while stack:
            level, a, b = stack.pop()
            top, low = self.levels[level]
            if a != b and not self.reaches(np.minimum(top[a], top[b]).sum(), low[a] + low[b]):
                continue
            if level:
                size = len(self.levels[level - 1][0])
                for x in range(a * FAN, min((a + 1) * FAN, size)):
                    for y in range(x if a == b else b * FAN, min((b + 1) * FAN, size)):
                        stack.append((level - 1, x, y))
                continue
            i, j = np.arange(a * LEAF, min((a + 1) * LEAF, n)), np.arange(b * LEAF, min((b + 1) * LEAF, n))
            ok = self.reaches(block_bound(self.points[i], self.points[j]), self.sizes[i][:, None] + self.sizes[j][None])
            if a == b:
                ok = np.triu(ok, 1)
            x, y = np.nonzero(ok)
            if not len(x) or skip(self.order[i if a == b else np.concatenate((i, j))]):
                continue
            x, y = i[x], j[y]
            near = self.reaches(common_bound(self.fine, self.order[x], self.order[y]), self.sizes[x] + self.sizes[y])
            x, y = x[near], y[near]
            if len(x):
                visit(self.order[x], self.order[y])


# --- candidate classes ----------------------------------------------------------

def signatures(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, exact: bool = False) -> DataFrame:
    """doc, n, digest, keys (smallest hashes) and point per row."""
    most = HUGE if exact else sketch_size(percent)

    def run(batches):
        for batch in batches:
            sets = list(shingle_sets(*text_buffers(batch.column(1)), words))
            keys = [s[:min(most, len(s) - -(-percent * len(s) // 100) + 1)].view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets]
            offs = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                 pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))),
                 pa.array([np.minimum(point(s, int(groups_for(len(s)))), 255).astype(np.uint8).tobytes() for s in sets], pa.binary())],
                names=["doc", "n", "digest", "keys", "point"])

    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("t")).mapInArrow(
        run, "doc long, n long, digest binary, keys array<long>, point binary")


def _layers(sizes: np.ndarray, raw: list[bytes], percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(groups, members, points): sets whose own points have ``groups``
    coordinates, and those a linked set may have, folded to as many."""
    own = np.array([len(r) for r in raw])
    reach = 100 / percent if percent else np.inf
    for g in np.unique(own):
        most = sizes[own == g].max() * reach
        members = np.flatnonzero((own >= g) & (sizes <= most))
        points = np.empty((len(members), g), np.int32)
        for k, i in enumerate(members):
            p = np.frombuffer(raw[i], np.uint8).astype(np.int32)
            p[p == 255] = HUGE
            points[k] = fold(p, int(g)) if len(p) > g else p
        yield int(g), members, points


def _candidate_forest(percent: int):
    """Per slot: a spanning forest of the pairs that share a key and whose
    points' bound reaches the threshold."""
    def run(f: pd.DataFrame) -> pd.DataFrame:
        docs, at = np.unique(f["rep"].to_numpy(), return_inverse=True)
        first = np.zeros(len(docs), np.intp)
        first[at] = np.arange(len(f))
        sizes, raw = f["n"].to_numpy()[first], f["point"].iloc[first].tolist()
        own = np.array([len(r) for r in raw])
        forest = Union(len(docs))
        group = f.groupby(["key", "lo", "hi"], sort=False).ngroup().to_numpy()
        o = np.argsort(group, kind="stable")
        g, m = group[o], at[o]
        starts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        lengths = np.diff(np.concatenate((starts, [len(g)])))

        def link(x, y):
            for u, v in zip(x.tolist(), y.tolist()):
                forest.link(u, v)

        pairs = []
        for length in np.unique(lengths[(lengths > 1) & (lengths <= 32)]):
            members = m[starts[lengths == length][:, None] + np.arange(length)]
            i, j = np.triu_indices(length, 1)
            x, y = members[:, i].ravel(), members[:, j].ravel()
            close = 100 * np.minimum(sizes[x], sizes[y]) >= percent * np.maximum(sizes[x], sizes[y])
            pairs.append(np.unique(np.stack((x[close], y[close]), 1), axis=0))
        pairs = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.intp)
        coarser = np.minimum(own[pairs[:, 0]], own[pairs[:, 1]])
        for groups, members, points in _layers(sizes, raw, percent):
            place = np.full(len(docs), -1)
            place[members] = np.arange(len(members))
            mine = pairs[coarser == groups]
            x, y = mine.T
            ok = (100 + percent) * common_bound(points, place[x], place[y]) >= percent * (sizes[x] + sizes[y])
            link(x[ok], y[ok])
            for s, length in zip(starts[lengths > 32], lengths[lengths > 32]):
                here = np.unique(m[s:s + length])
                here = here[place[here] >= 0]
                if len(here) > 1 and (own[here] == groups).any():
                    PointTree(points[place[here]], sizes[here], percent).join(
                        lambda x, y, here=here: link(here[x], here[y]),
                        lambda p, here=here: len(np.unique(forest.roots(here[p]))) == 1)
        roots = forest.roots(np.arange(len(docs)))
        apart = np.flatnonzero(roots != np.arange(len(docs)))
        return pd.DataFrame({"a": docs[apart], "b": docs[roots[apart]]})

    return run


def _step(percent: int):
    """Set sizes on a scale on which sets that can link are at most one step apart."""
    return F.floor(F.log("n") / (math.log(100 / percent) * 1.0001 + 1e-9)).cast("int") if percent else F.lit(0)


def _entries(classes: DataFrame, percent: int) -> DataFrame:
    """(key, rep, step, m, steps): the sets of every key that two have, how
    many have it, and, of a key of more than CHUNK, the chunks of each step."""
    keys = classes.select("rep", _step(percent).alias("step"), F.explode("keys").alias("key"))
    counted = keys.groupBy("key", "step").agg(F.count(F.lit(1)).alias("c"))
    shared = counted.groupBy(F.col("key").alias("k")).agg(F.sum("c").alias("m"), F.collect_list(F.struct("step", F.ceil(F.col("c") / CHUNK).alias("p"))).alias("steps"))
    shared = shared.filter("m > 1").withColumn("steps", F.when(F.col("m") > CHUNK, F.col("steps")))
    return packed_join(keys, shared, ["key"], ["k"], "inner")


def _dealt(entries: DataFrame) -> DataFrame:
    """(key, rep, lo, hi): the tasks of each entry.  A key of at most CHUNK
    sets is one task.  The sets of a larger one are dealt in chunks by their
    size; only chunks of one step and of neighbouring steps meet."""
    one = F.lit(0).cast("long")

    def chunks(by: int):
        return F.coalesce(F.get(F.filter("steps", lambda s: s["step"] == F.col("step") + by), F.lit(0))["p"], one)

    def chunk(by: int, at):
        return F.shiftleft((F.col("step") + by).cast("long"), 32) + at

    def tasks(by: int, make):
        return F.transform(F.filter(F.sequence(F.lit(-1).cast("long"), chunks(by) - 1), lambda o: o >= 0), make)

    def pair(lo, hi):
        return F.struct(lo.alias("lo"), hi.alias("hi"))

    own = F.pmod(F.xxhash64("rep"), F.greatest(chunks(0), F.lit(1)))
    dealt = entries.withColumn("c", own)
    met = F.concat(tasks(0, lambda o: pair(chunk(0, F.least("c", o)), chunk(0, F.greatest("c", o)))),
                   tasks(1, lambda o: pair(chunk(0, F.col("c")), chunk(1, o))), tasks(-1, lambda o: pair(chunk(-1, o), chunk(0, F.col("c")))))
    return dealt.select("key", "rep", F.inline(F.when(F.col("m") <= CHUNK, F.array(pair(one, one))).otherwise(met)))


def candidate_classes(classes: DataFrame, percent: int) -> DataFrame:
    """(node, component): sets that may be linked, directly or through others."""
    spark = classes.sparkSession
    entries = checkpointed(_entries(classes, percent))
    slots = max(spark.sparkContext.defaultParallelism, -(-entries.count() // 20_000))
    dealt = _dealt(entries).withColumn("slot", F.pmod(F.xxhash64("key", "lo", "hi"), F.lit(slots)))
    full = dealt.join(classes.select("rep", "n", "point"), "rep")
    edges = full.groupBy("slot").applyInPandas(_candidate_forest(percent), "a long, b long")
    return connected_components(edges)


# --- verification ----------------------------------------------------------------

def _verified_forest(words: int, percent: int):
    """Per slot: links found between the sets of each (component, part, guest);
    rows of side 1 (residents) meet rows of side 2 (visitors) only, rows of
    side 0 meet each other, and rows of one label are known to be connected."""
    def run(f: pd.DataFrame) -> pd.DataFrame:
        out_a, out_b = [], []
        for _, g in f.groupby(["component", "part", "guest"], sort=False):
            sets = list(shingle_sets(*text_buffers(pa.array(g["t"], pa.large_string())), words))
            full = np.array([len(s) > 0 for s in sets])
            sets, g = [s for s in sets if len(s)], g[full]
            if len(sets) < 2:
                continue
            docs, sizes, side = g["doc"].to_numpy(), np.array([len(s) for s in sets]), g["side"].to_numpy()
            forest = Union(len(sets))
            known = {}
            for i, label in enumerate(g["label"].to_numpy()):  # one vertex per id, and per known label
                for name in (("d", docs[i]), ("l", label)):
                    if name in known:
                        forest.link(known[name], i)
                    known.setdefault(name, i)

            def check(x, y):
                wanted = (side[x] != side[y]) | (side[x] == 0)
                for u, v in zip(x[wanted].tolist(), y[wanted].tolist()):
                    if forest.find(u) != forest.find(v):
                        common = len(np.intersect1d(sets[u], sets[v], assume_unique=True))
                        if (100 + percent) * common >= percent * (sizes[u] + sizes[v]):
                            forest.link(u, v)

            groups = min(1024, int(groups_for(sizes.min())))
            PointTree(np.stack([point(s, groups) for s in sets]).astype(np.int32), sizes, percent).join(
                check, lambda p: len(np.unique(forest.roots(p))) == 1)
            roots = forest.roots(np.arange(len(sets)))
            apart = np.flatnonzero(docs[roots] != docs)
            out_a.append(docs[apart])
            out_b.append(docs[roots[apart]])
        none = [np.zeros(0, np.int64)]
        return pd.DataFrame({"a": np.concatenate(out_a or none), "b": np.concatenate(out_b or none)})

    return run


def verified_links(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) that connect the same sets as all links do, from rows
    (doc, component, t) of candidate classes.

    A class of at most CHUNK rows is joined in one task.  A larger one is
    dealt in chunks, each joined with one common leader; sets that this does
    not connect to the class's main body then visit every chunk.  So a tight
    class of any size costs its rows once, and only stragglers are sent
    round."""
    spark = texts.sparkSession
    sizes = texts.groupBy("component").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct(F.xxhash64("doc"), "doc")).alias("_l"))
    sizes = checkpointed(sizes.select(F.col("component").alias("_c"), "m", F.col("_l.doc").alias("leader")))
    texts = packed_join(texts, sizes, ["component"], ["_c"], "inner")
    parts = F.ceil(F.col("m") / CHUNK)
    stats = sizes.agg(F.sum("m").alias("rows"), F.max("m").alias("most")).first()
    slots = max(spark.sparkContext.defaultParallelism, -(-(stats["rows"] or 0) // 500))
    run, out = _verified_forest(words, percent), "a long, b long"

    def solve(rows):
        rows = rows.withColumn("slot", F.pmod(F.xxhash64("component", "part", "guest"), F.lit(slots)))
        return checkpointed(rows.select("slot", "component", "part", "guest", "doc", "t", "label", "side")
                            .groupBy("slot").applyInPandas(run, out))

    dealt = texts.withColumn("own", F.pmod(F.xxhash64("doc"), parts))
    everywhere = F.sequence(F.lit(0).cast("long"), parts - 1)
    seats = F.when(F.col("doc") == F.col("leader"), everywhere).otherwise(F.array("own"))
    first = solve(dealt.withColumn("part", F.explode(seats)).withColumn("guest", F.lit(0).cast("long"))
                  .withColumn("label", F.col("doc")).withColumn("side", F.lit(0)))
    if (stats["most"] or 0) <= CHUNK:
        return first

    large = dealt.filter(F.col("m") > CHUNK)
    names = connected_components(first).withColumnRenamed("component", "label")
    rows = large.join(names, F.col("doc") == F.col("node"), "left").withColumn("label", F.coalesce("label", "doc")).drop("node")
    main = (rows.groupBy("component", "label").agg(F.count(F.lit(1)).alias("k"))
            .groupBy("component").agg(F.max(F.struct("k", "label")).alias("_m"), F.sum("k").alias("_all")))
    main = checkpointed(main.select(F.col("component").alias("_c"), F.col("_m.label").alias("main"), (F.col("_all") - F.col("_m.k")).alias("strays")))
    rows = packed_join(rows, main.filter("strays > 0"), ["component"], ["_c"], "inner")
    guests = F.ceil(F.col("strays") / CHUNK)
    residents = rows.withColumn("part", F.col("own")).withColumn("guest", F.explode(F.sequence(F.lit(0).cast("long"), guests - 1))).withColumn("side", F.lit(1))
    visitors = (rows.filter(F.col("label") != F.col("main")).withColumn("guest", F.pmod(F.xxhash64("doc", F.lit(1)), guests))
                .withColumn("part", F.explode(everywhere)).filter(F.col("part") != F.col("own")).withColumn("side", F.lit(2)))
    cols = ["component", "part", "guest", "doc", "t", "label", "side"]
    return first.union(solve(residents.select(*cols).union(visitors.select(*cols))))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75, exact: bool = False) -> DataFrame:
    """One row per input row: ``id_col``, n_shingles, component_id.

    Words are runs outside [\\x20\\x09-\\x0D], A-Z lower-cased; a set holds the
    distinct shingles of ``words`` words (fewer words: the whole sequence).
    Two rows link when 100 * intersection >= ``percent`` * union;
    component_id is the smallest id reachable.  A null or empty text, or one
    without words, has an empty set and links with nothing; a row with a null
    id links with nothing and keeps a null component.  Rows that repeat an id
    are one vertex.  Other columns are not read; an empty table gives an
    empty result.

    Equal sets are one class.  Classes meet over shared hashes among the
    smallest of their sets: a prefix as long as the threshold demands, or,
    unless ``exact``, as many as make a missed pair less likely than MISS.
    Chunks of a common key, dealt by set size, and of a large class are joined
    apart, and only spanning links leave a task, so no group of copies is
    expanded into pairs."""
    sig = checkpointed(signatures(docs, id_col, text_col, words, percent, exact))
    best = F.min(F.struct("doc", "n", "keys", "point"))
    classes = sig.filter("n > 0 and doc is not null").groupBy("digest").agg(best.alias("s"))
    classes = checkpointed(classes.select("digest", F.col("s.doc").alias("rep"), "s.n", "s.keys", "s.point"))
    members = candidate_classes(classes, percent)
    texts = (docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("t"))
             .join(members.hint("merge"), F.col("doc") == F.col("node")).select("doc", "component", "t"))
    links = verified_links(checkpointed(texts), words, percent)  # both passes read the candidates' texts, not all texts again
    found = connected_components(links)
    named = classes.select("digest", "rep").join(found, F.col("rep") == F.col("node"), "left").select(
        F.col("digest").alias("_d"), F.coalesce("component", "rep").alias("component_id"))
    rows = sig.select("doc", "n", F.when(F.col("n") > 0, F.col("digest")).alias("digest"))
    out = packed_join(rows, named, ["digest"], ["_d"])
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"),
                      F.when(F.col("doc").isNotNull(), F.coalesce("component_id", "doc")).alias("component_id"))
