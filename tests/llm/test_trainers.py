"""Trainers against plain versions; stages of the pipeline on odd tables."""

import math
import random

import numpy as np
import pytest

import corpus_pipeline as cp
from lakeward.llm import language_id as lid
from lakeward.llm import quality as ql
from tests.llm.helpers import frame


def plain_ftrl(rows, order, epochs, alpha, beta, l1, l2, held):
    """One coordinate at a time, in dictionaries."""
    labels = sorted({r[3] for r in rows})
    df = {}
    for at, *_ in rows:
        for b in at:
            df[b] = df.get(b, 0) + 1
    idf = {b: (math.log((1 + len(rows)) / (1 + d)) + 1) * lid.SCALE for b, d in df.items()}
    z, n = {}, {}

    def weight(k, b):
        zz, nn = z.get((k, b), 0.0), n.get((k, b), 0.0)
        return 0.0 if abs(zz) <= l1 else (math.copysign(l1, zz) - zz) / ((beta + math.sqrt(nn)) / alpha + l2)

    def values(i):
        at, c, total, y = rows[i]
        return [(int(b), float(x) / total * idf[b]) for b, x in zip(at, c)] + [("bias", 1.0)], y

    fit = [i for j, i in enumerate(order) if j % held]
    for _ in range(epochs):
        for i in fit:
            x, y = values(i)
            now = {(k, b): weight(k, b) for k in range(len(labels)) for b, _ in x}
            s = [sum(now[k, b] * v for b, v in x) for k in range(len(labels))]
            e = [math.exp(v - max(s)) for v in s]
            for k, label in enumerate(labels):
                wrong = e[k] / sum(e) - (label == y)
                for b, v in x:
                    g, old = wrong * v, n.get((k, b), 0.0)
                    z[k, b] = z.get((k, b), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * now[k, b]
                    n[k, b] = old + g * g
    return labels, {(k, b): weight(k, b) * (1 if b == "bias" else idf[b]) for k in range(len(labels)) for b in [*df, "bias"]}, values, [i for j, i in enumerate(order) if not j % held], weight


def test_ftrl_against_one_coordinate_at_a_time():
    rng = random.Random(4)
    words = {"en": ["the", "and", "of"], "de": ["der", "und", "mit"], "fr": ["les", "et", "à"]}
    rows = [(*lid.counts(" ".join(rng.choice(words[y] + ["x", "y"]) for _ in range(rng.randint(1, 6)))), y) for y in words for _ in range(8)]
    args = {"epochs": 2, "alpha": 0.3, "beta": 1.0, "l1": 1e-3, "l2": 1e-2, "held": 5}
    model = lid.train_ftrl(rows, seed=5, **args)
    order = np.random.default_rng(5).permutation(len(rows))
    labels, want, values, check, weight = plain_ftrl(rows, order, **args)
    assert model.labels == labels
    for (k, b), w in want.items():
        got = model.bias[k] if b == "bias" else model.table[k, b]
        assert got == pytest.approx(w, rel=1e-4, abs=1e-6)
    assert np.count_nonzero(model.table) <= len(want)

    def loss(t):
        total = 0
        for i in check:
            x, y = values(i)
            s = [sum(weight(k, b) * v for b, v in x) / t for k in range(len(labels))]
            total += math.log(sum(math.exp(v - max(s)) for v in s)) + max(s) - s[labels.index(y)]
        return total

    assert all(loss(model.temperature) <= loss(math.exp(-3 + k / 20)) + 1e-6 for k in range(121))


def test_frequent_grams_are_the_bounded_ones():
    at, count = np.array([3, 5, 8, 9]), np.array([2, 7, 7, 1])
    assert [x.tolist() for x in lid.frequent(at, count, 17, 2)[:2]] == [[5, 8], [7, 7]]
    assert [x.tolist() for x in lid.frequent(at, count, 17, 1)[:2]] == [[5], [7]]
    assert lid.frequent(at, count, 17, 9)[0].tolist() == at.tolist() and lid.frequent(at, count, 17, 2)[2] == 17


def plain_boost(x, y, trees, depth, rate, bins, l2, least):
    """Every cut of every feature tried for every node, row by row."""
    p0 = (sum(y) + 1) / (len(y) + 2)
    margin = [math.log(p0 / (1 - p0))] * len(y)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])).astype(np.float32) for f in range(x.shape[1])]
    for _ in range(trees):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g, h = [a - b for a, b in zip(p, y)], [a * (1 - a) for a in p]
        nodes = [list(range(len(y)))]
        for _ in range(depth):
            below = []
            for rows in nodes:
                best, split = 1e-6, None
                whole = sum(g[i] for i in rows) ** 2 / (sum(h[i] for i in rows) + l2)
                for f, cs in enumerate(cuts):
                    for c in cs:
                        left, right = [i for i in rows if x[i, f] <= c], [i for i in rows if x[i, f] > c]
                        if len(left) >= least and len(right) >= least:
                            gain = sum(sum(g[i] for i in s) ** 2 / (sum(h[i] for i in s) + l2) for s in (left, right)) - whole
                            if gain > best + 1e-12:
                                best, split = gain, (left, right)
                below += split or (rows, [])
            nodes = below
        for rows in nodes:
            step = -rate * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + l2)
            for i in rows:
                margin[i] += step
    return margin


def test_boosted_trees_against_row_by_row_search():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 4)).astype(np.float32)
    y = (x[:, 0] * x[:, 1] + 0.3 * x[:, 2] > 0).astype(float)
    forest = ql.train_forest(x, y, trees=3, depth=3, rate=0.3, bins=8, l2=1.0, min_rows=4)
    assert forest.margin(x) == pytest.approx(plain_boost(x, y, 3, 3, 0.3, 8, 1.0, 4), rel=1e-6, abs=1e-9)


@pytest.mark.parametrize("name,stage", cp.STAGES)
def test_stages_on_empty_tables(spark, name, stage):
    out = stage(spark, frame(spark, [], extra=False), "")
    assert out.count() == 0 and (name == "bpe_encoding" or out.columns == cp.COLUMNS)


def test_stages_on_null_ids_and_repeated_rows(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(None, text, None, None, None), (None, "other words of some length here", "en", None, 3), (1, text, "en", "s", 1), (1, text, "en", "s", 1),
            (2, "One two three four five six seven eight nine TEN", "en", "s", 1), (3, "", "en", "s", 0), (4, None, "en", "s", None), (5, "é" * 50_000, "fr", "t", 9)]
    docs = frame(spark, rows)
    told = cp.language_stage(spark, docs, "")
    assert sorted(str(r.doc_id) for r in told.collect()) == ["1", "1", "2", "5", "None", "None"]
    whole = cp.exact_stage(spark, docs, "")
    assert sorted(str(r.doc_id) for r in whole.collect()) == ["2", "4", "5", "None"]
    near = cp.near_stage(spark, docs, "")
    assert near.filter("doc_id is null").count() == 2  # a row without an id links with nothing
    assert {r.doc_id for r in near.collect() if r.doc_id is not None} == {1, 3, 4, 5}
    mixed = cp.mixing_stage(spark, docs, "")
    assert mixed.columns == cp.COLUMNS
    out = cp.encoding_stage(spark, docs, "").collect()
    assert len(out) == len(rows) and {r.n_tokens for r in out if r.doc_id in (3, 4)} == {0}
