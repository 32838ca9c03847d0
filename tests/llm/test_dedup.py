"""Exact dedup, line dedup and the n-gram Jaccard join against brute force."""

import hashlib
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lakeward.llm import ngram_join as nj
from lakeward.llm.components import connected_components
from lakeward.llm.exact_dedup import exact_dedup, exact_groups
from lakeward.llm.line_dedup import line_dedup
from tests.llm.helpers import SMALL, SPACE, closure, fold, frame, near_truth

ODD = [(1, "Same text"), (2, "sAME TEXT"), (5, None), (6, ""), (7, "É"), (8, "é"), (9, "x" * 200_000), (11, "X" * 200_000), (12, " "), (13, "Same  text")]


def test_exact_groups_odd_rows(spark):
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_groups(frame(spark, ODD)).collect()}
    assert got == {1: (2, 2, False), 2: (2, 2, True), 5: (6, 2, False), 6: (6, 2, True), 7: (7, 1, True), 8: (8, 1, True),
                   9: (11, 2, False), 11: (11, 2, True), 12: (12, 1, True), 13: (13, 1, True)}


@pytest.mark.parametrize("keep,ids", [("largest", [3, 9]), ("smallest", [1, 9])])
def test_exact_dedup_repeated_rows_and_null_ids(spark, keep, ids):
    docs = frame(spark, [(1, "a"), (3, "A"), (3, "a"), (3, "a"), (None, "a"), (9, "b"), (9, "b")])
    out = exact_dedup(docs, keep=keep)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == ids
    assert exact_groups(docs, keep=keep).count() == 7


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert exact_groups(empty).count() == 0
    assert line_dedup(empty).count() == 0
    assert nj.near_duplicates(empty).count() == 0


def lines_truth(rows, least):
    seen = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            seen.setdefault(fold(line).strip(SPACE), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key := fold(x).strip(SPACE)) or len(seen[key]) < least]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(4)
    pool = ["Home", " home\t", "", "  ", "About us", "É", "é", "a\rb", "\x0bEnd\x0c", "lone " * 3]
    rows = [(i, "\n".join(rng.choice([*pool, f"own {i} {k}"]) for k in range(rng.randint(1, 9)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n"), (103, "Home\n" * 3000 + "tail"), (103, "home"), (None, "HOME\nx")]
    rows += [(200, "twelve rows\nof one id")] * 12 + [(201, f"own {k}\ntwelve rows") for k in range(12)] + [(None, "HOME\nx")] * 3
    got = line_dedup(frame(spark, rows), min_documents=10).select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, lines_truth(rows, 10)))


def test_line_dedup_of_many_common_lines(spark):
    """Time in proportion to the lines: 100,000 common ones in a text."""
    body = "\n".join(f"line {k}" for k in range(100_000))
    rows = [(i, f"first {i}\n{body}\nlast {i}") for i in range(10)]
    got = line_dedup(frame(spark, rows), min_documents=10).select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert sorted(map(tuple, got)) == [(i, 100_002, 100_000, f"first {i}\nlast {i}") for i in range(10)]


def test_components_random(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(400, 400 + i) for i in range(500)] + [(None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [e for e in edges if None not in e]
    assert got == closure({x for e in real for x in e}, real)


def family(rng, start, count, size, edits):
    base = [f"w{rng.randrange(5000)}" for _ in range(size)]
    for i in range(count):
        ws = list(base)
        for _ in range(rng.randint(0, edits)):
            ws[rng.randrange(len(ws))] = f"n{rng.randrange(10**6)}"
        yield start + i, " ".join(ws)


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    rows = [*family(rng, 0, 60, 120, 4), *family(rng, 200, 40, 60, 3), *family(rng, 300, 30, 9, 1), *family(rng, 400, 5, 4000, 200)]
    shared = " ".join(f"b{k}" for k in range(60))
    rows += [(600 + i, shared + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.choice([5, 18, 60])))) for i in range(60)]
    rows += [(700, None), (701, ""), (702, " \t"), (703, "one two"), (704, "ONE  two"), (705, "one two three"), (706, "a b c d e"), (707, "A b c d e")]
    truth = near_truth(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.near_duplicates(frame(spark, rows)).collect()}
    assert got == truth
    monkeypatch.setattr(nj, "CHUNK", 16)  # chunks, leaders and visitors
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.near_duplicates(frame(spark, rows)).collect()}
    assert got == truth


def test_near_duplicates_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "p q r s t u"), (6, "p q r s t u")]
    got = sorted(map(str, (tuple(r) for r in nj.near_duplicates(frame(spark, rows)).collect())))
    assert got == sorted(map(str, [(None, 2, None), (4, 2, 4), (4, 2, 4), (6, 2, 4)]))


def test_bound_never_below_overlap():
    rng = np.random.default_rng(1)
    for n in (3, 40, 300):
        a, b = (np.unique(rng.integers(0, 4 * n, n).astype(np.uint64)) for _ in range(2))
        g = int(nj.groups_for(n))
        assert np.minimum(nj.point(a, g), nj.point(b, g)).sum() >= len(np.intersect1d(a, b))
        assert (nj.fold(nj.point(a, 2 * g), g) == nj.point(a, g)).all()


def test_shingle_counts_of_table_texts():
    import pyarrow as pa
    from lakeward.llm.common import text_buffers
    from tests.llm.helpers import shingles
    texts = pq.read_table(f"{SMALL}/documents.parquet")["text"].to_pylist() + ["", None, "a", "x " * 700_000 + "end", "A\x0bb\x1cc\u00a0d"]
    got = [len(s) for s in nj.shingle_sets(*text_buffers(pa.array(texts)))]
    assert got == [len(shingles(t)) for t in texts]


def test_digest_is_sha256(spark):
    r = exact_groups(frame(spark, [(1, "Ab\n")])).first()
    assert r.text_sha256 == hashlib.sha256(b"ab\n").hexdigest()
    assert spark.range(1).select(F.lit(1)).count() == 1


@pytest.mark.parametrize("exact", [False, True])
def test_hot_key_dealt_by_size_against_brute_force(spark, monkeypatch, exact):
    monkeypatch.setattr(nj, "CHUNK", 6)
    rng = random.Random(12)
    common, docs = "one two three four five", []
    for i in range(90):  # families of near copies of many sizes, all with one shingle
        size = rng.choice([6, 8, 12, 20, 33, 60])
        base = [f"b{i // 3}x{k}" for k in range(size)]
        base[rng.randrange(size)] = f"e{i}"
        docs.append((i, f"{common} {' '.join(base)}"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.near_duplicates(frame(spark, docs), exact=exact).collect()}
    assert got == near_truth(docs)


def test_rows_of_a_hot_key_follow_the_documents_when_sizes_differ(spark, monkeypatch):
    monkeypatch.setattr(nj, "CHUNK", 8)

    def tasks(n):  # ten sets of every size, sizes a third apart
        classes = spark.createDataFrame([(i, round(4 * 1.34 ** (i // 10)), [7]) for i in range(n)], "rep long, n long, keys array<long>")
        return nj._dealt(nj._entries(classes, 75)).count()

    few, many = tasks(160), tasks(640)
    assert many <= 4.5 * few and few <= 160 * 6


def test_sets_that_share_a_passage_only_are_no_candidates(spark):
    rng = random.Random(21)
    common, docs = " ".join(f"c{k}" for k in range(16)), []
    for i in range(600):  # a quarter of each text is common to all
        docs.append((i, f"{common} {' '.join(f'u{rng.randrange(10**9)}' for _ in range(rng.randint(40, 60)))}"))
    docs += [(600 + i, docs[i][1]) for i in range(20)] + [(700 + i, docs[i][1] + " end") for i in range(20)]
    sig = nj.signatures(frame(spark, docs), "doc_id", "text", 5, 75)
    classes = sig.selectExpr("doc as rep", "n", "keys", "point").filter("rep < 600 or rep >= 700")
    got = {r.node for r in nj.candidate_classes(classes, 75).collect()}
    assert {*range(20), *range(700, 720)} <= got and len(got) <= 60
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in nj.near_duplicates(frame(spark, docs)).collect()} == near_truth(docs)


def test_block_bound_adds_all_minima():
    rng = np.random.default_rng(3)
    for most in (4, 256, 1000):
        a, b = (rng.integers(0, most, (k, nj.COARSE)) for k in (9, 5))
        a[0], b[0] = most - 1, most - 1
        want = np.minimum(a[:, None], b[None]).sum(axis=2)
        kind = np.uint8 if most <= 256 else np.int32
        assert (nj.block_bound(a.astype(kind), b.astype(kind)) == want).all()
