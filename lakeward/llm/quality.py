"""Quality classifier: histogram gradient-boosted trees over document
statistics, flattened into arrays for vectorised numpy traversal."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeward.llm.common import row_slices, text_buffers, word_hashes
from lakeward.llm.language_id import sample_threshold

# byte classes: letters a-z, A-Z, digits, space and tab, newline, sentence marks, other ASCII marks, beyond ASCII, control
_CLASS = np.full(256, 6, np.intp)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[32, 9]], _CLASS[[10, 13]] = 3, 4
_CLASS[[ord(c) for c in ".,;:!?'\""]] = 5
_CLASS[128:], _CLASS[[c for c in range(32) if c not in (9, 10, 13)] + [127]] = 7, 8
_MARKS = "|#$%&*<>{}[]\\=+-_/@()~^`"
NAMES = (["log_chars", "log_words", "log_lines", "word_length", "line_words", "distinct_words", "top_word", "top3_words",
          "distinct_lines", "long_words", "repeat_next", "entropy", "distinct_pairs"]
         + [f"class_{k}" for k in range(9)] + [f"mark_{k}" for k in range(len(_MARKS))])


def _one(data: np.ndarray, words: np.ndarray) -> list[float]:
    n, m = len(data), len(words)
    by = np.bincount(data, minlength=256)
    share = by / max(n, 1)
    classes = np.bincount(_CLASS, by, minlength=9) / max(n, 1)
    lines = int(by[10]) + 1
    marks = [share[ord(c)] for c in _MARKS]
    some = share[share > 0]
    entropy = float(-(some * np.log2(some)).sum()) if n else 0.0
    letters = n - by[32] - by[9:14].sum()
    if m:
        _, c = np.unique(words, return_counts=True)
        top = np.sort(c)[::-1][:3]
        pairs = len(np.unique(words[:-1] * np.uint64(3) + words[1:])) / (m - 1) if m > 1 else 1.0
        w = [len(c) / m, top[0] / m, top.sum() / m, float((words[1:] == words[:-1]).mean()) if m > 1 else 0.0, pairs]
    else:
        w = [0.0] * 5
    return [np.log1p(n), np.log1p(m), np.log(lines), letters / max(m, 1), m / lines, w[0], w[1], w[2]], entropy, w[3], w[4], classes, marks


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of NAMES per text, over whole texts."""
    out = np.zeros((len(offs) - 1, len(NAMES)), np.float32)
    for a, b in row_slices(offs):
        h, wo = word_hashes(data, offs, a, b)
        for i in range(a, b):
            raw = data[offs[i]:offs[i + 1]]
            head, entropy, rep, pairs, classes, marks = _one(raw, h[wo[i - a]:wo[i - a + 1]])
            cuts = np.flatnonzero(raw == 10)
            ends = np.diff(np.concatenate(([-1], cuts, [len(raw)]))) - 1
            # a line is told from another by its length and byte sum
            sums = np.add.reduceat(np.concatenate((raw.astype(np.int64), [0])), np.concatenate(([0], cuts + 1)))
            keys = sums * 4096 + ends
            distinct = len(np.unique(keys)) / len(keys)
            seen = np.diff(np.flatnonzero(np.concatenate(([True], (raw == 32) | (raw == 10), [True])))) - 1
            long = float((seen > 14).sum()) / max(1, int((seen > 0).sum()))
            out[i] = [*head, distinct, long, rep, entropy, pairs, *classes, *marks]
    return out


@dataclass
class Forest:
    """Complete binary trees of one depth, flattened: node k has the children 2k+1 and 2k+2."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), np.intp)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += leaf[at - inner]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def train_forest(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 48,
                 l2: float = 2.0, min_rows: int = 8) -> Forest:
    """Logistic loss, Newton leaves, splits by histogram.  Without rows every
    score is 0.5; with one label alone it is that label's smoothed share."""
    inner, leaves = 2 ** depth - 1, 2 ** depth
    p0 = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(p0 / (1 - p0)))
    empty = Forest(np.zeros((0, inner), np.intp), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    if len(y) == 0 or y.min() == y.max():
        return empty
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])).astype(np.float32) for f in range(x.shape[1])]
    code = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)  # x > cut k means code > k
    margin = np.full(len(y), base)
    fs, ts, ls = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.intp), np.full(inner, np.inf, np.float32)
        at = np.zeros(len(y), np.intp)
        for d in range(depth):
            first, nodes = 2 ** d - 1, 2 ** d
            local = at - first
            best = np.full(nodes, 1e-6)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                w = len(c) + 1
                key = local * w + code[:, f]
                gs, hs, ns = (np.bincount(key, v, minlength=nodes * w).reshape(nodes, w).cumsum(axis=1) for v in (g, h, np.ones(len(g))))
                gl, hl, nl = gs[:, :-1], hs[:, :-1], ns[:, :-1]
                gr, hr, nr = gs[:, -1:] - gl, hs[:, -1:] - hl, ns[:, -1:] - nl
                gain = gl ** 2 / (hl + l2) + gr ** 2 / (hr + l2) - gs[:, -1:] ** 2 / (hs[:, -1:] + l2)
                gain[(nl < min_rows) | (nr < min_rows)] = 0
                k = gain.argmax(axis=1)
                top = gain[np.arange(nodes), k]
                better = np.flatnonzero(top > best)
                best[better] = top[better]
                feature[first + better], threshold[first + better] = f, c[k[better]]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > threshold[at])
        leaf = -rate * np.bincount(at - inner, g, minlength=leaves) / (np.bincount(at - inner, h, minlength=leaves) + l2)
        margin += leaf[at - inner]
        fs.append(feature), ts.append(threshold), ls.append(leaf)
    return Forest(np.array(fs), np.array(ts), np.array(ls), base)


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and features (packed 32-bit floats, in the order of NAMES).

    A null text counts as empty; repeated rows get a row each."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("features", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(*text_buffers(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=schema.names)

    return docs.select(id_col, docs[text_col].alias("_stat_text")).mapInArrow(run, schema)


def _matrix(features) -> np.ndarray:
    return np.frombuffer(b"".join(features), np.float32).reshape(-1, len(NAMES))


def train(features: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", label_col: str = "quality",
          max_rows: int = 20_000, seed: int = 13) -> Forest:
    """Fit on at most about ``max_rows`` labelled rows where ``learn`` holds:
    those with the smallest seeded hash of the id.  A row without label or
    statistics is not used; rows that repeat an id count one by one."""
    own = labels.filter(learn & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(id_col, F.col(label_col).cast("int").alias("_y"))
    key = F.xxhash64(F.lit(seed), F.col(id_col))
    limit = sample_threshold(own, key, max_rows)
    rows = features.join(own.filter(key <= limit), id_col).select("features", "_y").collect() if limit is not None else []
    rows.sort(key=lambda r: (r["_y"], bytes(r["features"])))  # arrival order must not matter
    return train_forest(_matrix([bytes(r["features"]) for r in rows]), np.array([r["_y"] for r in rows], float))


def score_documents(features: DataFrame, forest: Forest, id_col: str = "doc_id") -> DataFrame:
    """``id_col`` and score (0 to 1) per row; the model is a fixed-size broadcast."""
    shared = features.sparkSession.sparkContext.broadcast(forest)
    schema = T.StructType([features.schema[id_col], T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(x), pa.float64())], names=schema.names)

    return features.select(id_col, "features").mapInArrow(run, schema)
