"""Language ID: sparse multinomial logistic regression on TF-IDF character
n-grams, trained by follow-the-regularised-leader with elastic net, followed
by temperature calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeward.llm.common import row_slices, text_buffers

BUCKETS = 1 << 16
PIECE = 1 << 20  # code points handled at once
_K = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
UNDETERMINED = "und"


def _grams(codes: np.ndarray) -> list[np.ndarray]:
    """Buckets of the 1-, 2- and 3-grams that start at each code point but the last two."""
    c = codes.astype(np.uint32)
    one = c[:-2] * _K[0]
    two = one + c[1:-1] * _K[1]
    three = two + c[2:] * _K[2]
    return [((g ^ (g >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * k) >> np.uint32(16)).astype(np.intp) for k, g in enumerate((one, two, three))]


def _codes(text: str) -> np.ndarray:
    """Lower-cased code points, white space runs folded, framed by blanks."""
    return np.frombuffer((" " + " ".join(text.lower().split()) + "  ").encode("utf-32-le", "surrogatepass"), np.uint32)


def _pieces(text: str) -> Iterator[str]:
    for a in range(0, len(text), PIECE):
        yield text[a:a + PIECE]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def counts(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Buckets, their counts and the number of n-grams of a whole text."""
    total = np.zeros(BUCKETS, np.int64)
    for p in _pieces(text):
        for g in _grams(_codes(p)):
            total += np.bincount(g, minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at, total[at], int(total.sum())


def frequent(at: np.ndarray, count: np.ndarray, total: int, bound: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The ``bound`` most frequent buckets, in their order."""
    top = np.sort(np.argsort(-count, kind="stable")[:bound])
    return at[top], count[top], total


@dataclass
class LanguageModel:
    labels: list[str]
    table: np.ndarray  # classes x buckets: weight times idf times scale
    bias: np.ndarray
    temperature: float

    def logits(self, texts: list[str]) -> np.ndarray:
        """Summed n-gram weights over the number of n-grams, whole texts, each
        text by itself: a score does not depend on its neighbours."""
        out = np.zeros((len(texts), len(self.labels)))
        for i, text in enumerate(texts):
            n = 0
            for p in _pieces(text):
                grams = _grams(_codes(p))
                n += sum(map(len, grams))
                ids = np.concatenate(grams)
                out[i] += [np.take(row, ids).sum(dtype=np.float64) for row in self.table]
            out[i] /= max(n, 1)
        return out + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        ok = [bool(t) and has_letter(t) for t in texts]
        z = self.logits([t if good else "" for t, good in zip(texts, ok)]) / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return ([self.labels[b] if good else UNDETERMINED for b, good in zip(best, ok)],
                [float(p[i, b]) if good else 0.0 for i, (b, good) in enumerate(zip(best, ok))])


SCALE = 20.0


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int, str]], epochs: int = 4, alpha: float = 0.3, beta: float = 1.0,
               l1: float = 1e-3, l2: float = 1e-2, seed: int = 5, held: int = 5) -> LanguageModel:
    """FTRL-proximal per coordinate over (buckets, counts, total, label) rows;
    every ``held``-th row fits the temperature only.  One label alone is
    predicted with certainty."""
    labels = sorted({r[3] for r in rows})
    if not labels:
        return LanguageModel([UNDETERMINED], np.zeros((1, BUCKETS), np.float32), np.zeros(1), 1.0)
    df = np.zeros(BUCKETS)
    for at, _, _, _ in rows:
        df[at] += 1
    idf = (np.log((1 + len(rows)) / (1 + df)) + 1) * SCALE
    k = len(labels)
    z, n, w = np.zeros((k, BUCKETS + 1)), np.zeros((k, BUCKETS + 1)), np.zeros((k, BUCKETS + 1))
    order = np.random.default_rng(seed).permutation(len(rows))
    fit = [i for j, i in enumerate(order) if j % held or len(rows) < 2 * held]
    check = [i for j, i in enumerate(order) if not j % held] if len(rows) >= 2 * held else fit

    def example(i):  # made when it is needed: the driver holds the counts only
        at, c, total, y = rows[i]
        return np.append(at.astype(np.intp), BUCKETS), np.append(c / total * idf[at], 1.0), labels.index(y)

    def weights(at):
        zz, nn = z[:, at], n[:, at]
        return np.where(np.abs(zz) <= l1, 0.0, (np.sign(zz) * l1 - zz) / ((beta + np.sqrt(nn)) / alpha + l2))

    for _ in range(epochs):
        for i in fit:
            at, x, y = example(i)
            cur = weights(at)
            s = cur @ x
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = p[:, None] * x
            g2 = g * g
            z[:, at] += g - (np.sqrt(n[:, at] + g2) - np.sqrt(n[:, at])) / alpha * cur
            n[:, at] += g2
    w = weights(np.arange(BUCKETS + 1))
    held_out = [(w[:, at] @ x, y) for at, x, y in map(example, check)]
    s, y = np.array([z for z, _ in held_out]), np.array([y for _, y in held_out])

    def loss(log_t):
        q = s / np.exp(log_t)
        q = q - q.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(q).sum(axis=1)) - q[np.arange(len(y)), y]))

    lo, hi, ratio = -3.0, 3.0, (5 ** 0.5 - 1) / 2  # golden section on the log of the temperature
    for _ in range(40):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return LanguageModel(labels, (w[:, :BUCKETS] * idf).astype(np.float32), w[:, BUCKETS], float(np.exp((lo + hi) / 2)))


def sample_threshold(rows: DataFrame, key: Column, bound: int):
    """The ``bound``-th smallest ``key`` of ``rows``: a bounded sample is the rows up to it."""
    top = rows.select(key.alias("k")).orderBy("k").limit(bound).agg(F.max("k").alias("k")).first()
    return top["k"]


def _flat(column: pa.Array) -> np.ndarray:
    """All integers of a column of packed ones, without a copy."""
    if not len(column):
        return np.zeros(0, "<i4")
    column = column.cast(pa.large_binary())
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offs[0]:offs[-1]].view("<i4") if offs[-1] > offs[0] else np.zeros(0, "<i4")


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          max_rows: int = 4000, seed: int = 11, max_grams: int = 4096) -> LanguageModel:
    """Fit on at most about ``max_rows`` rows (ties of the hash may add some)
    where ``learn`` holds and label and text are not null: those with the
    smallest seeded hash of the id.  Their n-grams are counted on the
    executors, whole texts; of a row's distinct n-grams the ``max_grams`` most
    frequent take part (ties: the smaller bucket), so the driver receives at
    most 8 bytes times ``max_rows`` times ``max_grams``, 131 MB."""
    own = docs.filter(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    key = F.xxhash64(F.lit(seed), F.col(id_col).cast("string"))
    limit = sample_threshold(own, key, max_rows)
    if limit is None:
        return train_ftrl([])

    def featurise(batches):
        for batch in batches:
            got = [(y, *frequent(*counts(t), max_grams)) for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if has_letter(t)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([g[0] for g in got], pa.string()), pa.array([g[1].astype("<i4").tobytes() for g in got], pa.binary()),
                 pa.array([g[2].astype("<i4").tobytes() for g in got], pa.binary()), pa.array([g[3] for g in got], pa.int64()),
                 pa.array([len(g[1]) for g in got], pa.int64())],
                names=["y", "at", "c", "total", "n"])

    # sorted, for arrival order must not matter; flat buffers instead of an object per row
    rows = (own.filter(key <= limit).select(F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"))
            .mapInArrow(featurise, "y string, at binary, c binary, total long, n long").orderBy("y", "total", "at", "c").toArrow().combine_chunks())
    flat = [_flat(rows[c].combine_chunks()) for c in ("at", "c")]
    ends = np.concatenate(([0], np.cumsum(rows["n"].to_numpy(), dtype=np.int64)))
    model = train_ftrl([(flat[0][a:b], flat[1][a:b], total, y)
                        for a, b, total, y in zip(ends[:-1], ends[1:], rows["total"].to_pylist(), rows["y"].to_pylist())])
    del rows, flat
    pa.default_memory_pool().release_unused()  # the driver goes on for long after this
    return model


def predict_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "lang_score") -> DataFrame:
    """``docs`` with the predicted label and its calibrated probability.

    A text that is null or has no letter gets ``und`` and score 0.  Whole
    texts are scored, each by itself; other columns pass through (columns
    named like the two results are replaced); repeated rows agree; an empty
    table stays empty.  One narrow pass; the model is a fixed-size broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.drop(lang_out, score_out)
    schema = T.StructType(src.schema.fields + [T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])
    at = src.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for a, b in row_slices(text_buffers(batch.column(at))[1], 4 << 20):
                part = batch.slice(a, b - a)
                langs, scores = shared.value.predict(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return src.mapInArrow(run, schema)
