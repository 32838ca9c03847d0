"""Brute-force versions and small tables shared by the tests of this folder."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = " \t\n\x0b\x0c\r"
SMALL = "/root/testdata/sf0.001"


def fold(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def closure(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def shingles(text, words=5):
    ws = WORD.findall(fold(text))
    if not ws:
        return set()
    return {tuple(ws[i:i + words]) for i in range(len(ws) - words + 1)} if len(ws) >= words else {tuple(ws)}


def near_truth(docs, percent=75):
    sets = {i: shingles(t) for i, t in docs}
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1:] if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in closure(ids, links).items()}


def frame(spark, rows, extra=True):
    """A documents table with columns whose names clash with inner ones."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    full = [(i, t, "en", "s", len(t or "")) for i, t in rows] if rows and len(rows[0]) == 2 else rows
    df = spark.createDataFrame(full, schema)
    if not extra:
        return df
    from pyspark.sql import functions as F
    for name in ("_row_at", "_digest", "n", "_n", "_run", "rep", "component", "_bucket", "_draw", "size", "key", "t"):
        df = df.withColumn(name, F.lit(1))
    return df
