"""Decontamination, spelling variants and conversation repair against brute force."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest
from pyspark.sql import functions as F

from lakeward.llm import conversations as cv
from lakeward.llm import decontaminate as dc
from lakeward.llm import spelling as sp
from tests.llm.helpers import fold, frame

TERM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


# --- op11 -----------------------------------------------------------------------

def leaks(rows, items, width):
    windows = {}
    for item, text in items:
        ws = TERM.findall(fold(text))
        size = min(len(ws), width)
        for s in range(len(ws) - size + 1 if ws else 0):
            windows.setdefault(tuple(ws[s:s + size]), set()).add(item)
    out = []
    for doc, text in rows:
        ws, hit, names = TERM.findall(fold(text)), set(), set()
        for size in {len(w) for w in windows}:
            for s in range(len(ws) - size + 1):
                if (found := windows.get(tuple(ws[s:s + size]))) is not None:
                    hit.update(range(s, s + size))
                    names |= found
        out.append((doc, len(ws), len(hit), sorted({str(n) for n in names if n is not None})))
    return sorted(out, key=str)


def items_frame(spark, items):
    return spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1)).withColumn("_seq", F.lit("x"))


def found(out):
    return sorted([(r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in out.collect()], key=str)


@pytest.mark.parametrize("width,rarest", [(3, 1), (3, 2), (4, 9), (1, 2)])
def test_decontaminate_against_brute_force(spark, width, rarest):
    rng = random.Random(width)
    words = ["the", "The", "of", "a", "é", "É", "x1", "42", "日本"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    items = [(i, text(rng.randint(1, 7))) for i in range(25)] + [(10, "the of"), (11, None), (12, " .. "), (None, "x1 x1 42"), (3, "A a. É")]
    rows = [(i, text(rng.randint(0, 40))) for i in range(60)] + [(100, None), (101, ""), (7, "x1 x1 42"), (7, "x1 x1 42"), (None, "the of a"), (102, "the of a " * 3000)]
    docs, bench = frame(spark, rows), items_frame(spark, items)
    assert found(dc.decontaminate(docs, bench, width=width)) == leaks(rows, items, width)
    passages, _ = dc.find_passages(docs, bench, width=width, rarest=rarest)
    covered = [(r.doc_id, len({p for s in r.exact for p in range(s.start, s.start + s.length)})) for r in passages.collect()]
    assert sorted(covered, key=str) == sorted([(d, n) for d, _, n, _ in leaks(rows, items, width)], key=str)


def test_decontaminate_empty_tables(spark):
    assert dc.decontaminate(frame(spark, []), items_frame(spark, [(1, "a b")])).count() == 0
    for items in ([], [(1, None)], [(1, "not in there")]):
        assert found(dc.decontaminate(frame(spark, [(1, "some words")]), items_frame(spark, items))) == [(1, 2, 0, [])]


@pytest.mark.parametrize("slop", [1, 2])
def test_proximity_matches(spark, slop):
    rng = random.Random(slop)
    rows = [(i, " ".join(rng.choice("abcdef") for _ in range(30))) for i in range(40)]
    items = [(i, " ".join(rng.choice("abcdefg") for _ in range(6))) for i in range(12)]
    passages, items_of = dc.find_passages(frame(spark, rows), items_frame(spark, items), width=4, slop=slop)
    names = {}
    for r in items_of.collect():
        names.setdefault(r._seq, set()).add(r._item)
    got = {(r.doc_id, item, s.start) for r in passages.collect() for s in r.near for item in names[s.seq]}
    want = set()
    for doc, text in rows:
        ws = text.split()
        for item, t in items:
            seq = t.split()
            for a, p in product(range(3), range(len(ws) - 3)):
                win = seq[a:a + 4]
                if ws[p:p + 4] != win and all(w in ws[max(p + i - slop, 0):p + i + slop + 1] for i, w in enumerate(win)):
                    want.add((doc, item, p))
    assert got == want and want


def test_common_passage_makes_rows_in_proportion(spark):
    """A passage that every document holds: one candidate record per document."""
    passage = " ".join(f"w{i}" for i in range(40))
    docs = frame(spark, [(i, f"own{i} {passage} end{i}") for i in range(300)])
    out = dc.decontaminate(docs, items_frame(spark, [(i, passage) for i in range(50)])).collect()
    assert {(r.n_words, r.n_hit, r.n_items) for r in out} == {(42, 40, 50)} and len(out) == 300


# --- op12 -----------------------------------------------------------------------

def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def variants(counts):
    near = {a: [b for b in counts if one_edit(a, b)] for a in counts}
    form = {}
    for a, found in near.items():
        best = min(found, key=lambda b: (-counts[b], b), default=None)
        form[a] = best if best is not None and counts[best] >= 2 * counts[a] else None
    out = set()
    for a in counts:
        root = a
        while form[root]:
            root = form[root]
        out.add((a, form[a], root, counts[a], len(near[a]), counts[form[a]] if form[a] else None))
    return out


def variant_rows(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("letters,size", [("ab", 6), ("abcé", 5), ("abcdefghÿ÷", 8)])
def test_variants_against_brute_force(spark, letters, size):
    rng = random.Random(size)
    counts = {}
    for _ in range(150):
        word = "".join(rng.choice(letters) for _ in range(rng.randint(4, size)))
        counts[word] = rng.choice([1, 2, 3, 5, 10, 40])
        cut = rng.randrange(len(word))
        counts.setdefault(word[:cut] + rng.choice(letters) + word[cut:], rng.choice([1, 4, 20]))
    counts |= {"aaaaa": 3, "aaaaaa": 7, "aaaaaaa": 20, "x" * 3000: 2, "x" * 3001: 9}
    words = spark.createDataFrame(sorted(counts.items()), "word string, n long").repartition(3).withColumn("root", F.lit(0))
    assert variant_rows(sp.group_variants(words)) == variants(counts)


def test_pivots_are_disjoint_and_cheapest():
    rng = random.Random(3)
    for _ in range(300):
        places = sorted(rng.sample(range(9), rng.randint(3, 6)))
        weights = [rng.randint(0, 9) for _ in places]
        cheapest = min(weights[i] + weights[j] for i in range(len(places)) for j in range(i) if places[i] - places[j] >= 2)
        i, j = sp.choose_pivots(places, weights)
        assert places[j] - places[i] >= 2 and weights[i] + weights[j] == cheapest


def test_counted_words_of_odd_texts(spark):
    rng = random.Random(5)
    pool = ["Maison", "maison", "École", "école", "abcd", "x÷y×zz", "naïveté", "don't", "a1bcdefg"]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for i in range(120)] + [(None, "maison maison"), (5, None), (6, ""), (7, "zz" * 50_000)]
    want = {}
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = fold(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 7 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 5:
                want[run] = want.get(run, 0) + 1
    got = {r.word: r.n for r in sp.count_words(frame(spark, rows), damage_every=7).collect()}
    assert got == {w: n for w, n in want.items() if n >= 3}


def test_variants_of_nothing(spark):
    words = sp.count_words(frame(spark, []), damage_every=97)
    assert sp.group_variants(words).count() == 0


# --- op13 -----------------------------------------------------------------------

def cheapest(turns):
    """Plain search over every target length, without a band."""
    best = (4 * len(turns), "D" * len(turns))
    for size in range(2, 2 * len(turns) + 3):
        target = "s" * (size & 1) + "ua" * (size // 2)
        at = {(len(turns), len(target)): (0, "")}
        for i in range(len(turns), -1, -1):
            for k in range(len(target), -1, -1):
                ways = [at[i, k]] if (i, k) in at else []
                if i < len(turns) and at.get((i + 1, k)):
                    ways.append((at[i + 1, k][0] + 4, "D" + at[i + 1, k][1]))
                if k < len(target) and target[k] != "s" and at.get((i, k + 1)):
                    ways.append((at[i, k + 1][0] + 3, "I" + at[i, k + 1][1]))
                if i < len(turns) and k < len(target) and turns[i] != "x" and at.get((i + 1, k + 1)):
                    same = turns[i].lower() == target[k]
                    if same or target[k] != "s":
                        cost, rest = at[i + 1, k + 1]
                        ways.append((cost + 3 * (not same) + 3 * turns[i].isupper(), ("K" if same else "R") + rest))
                if ways:
                    at[i, k] = min(ways)
        if at.get((0, 0)):
            best = min(best, at[0, 0])
    return best


def test_repair_of_every_short_conversation():
    for n in range(4):
        for turns in product("suaoSUAx", repeat=n):
            assert cv.repair("".join(turns)) == cheapest("".join(turns))


def test_repair_of_longer_conversations():
    rng = random.Random(9)
    for _ in range(60):
        turns = "".join(rng.choice("suaoSUAOxx") for _ in range(rng.randint(4, 14)))
        assert cv.repair(turns) == cheapest(turns)


@pytest.mark.parametrize("piece", [1, 2, 5])
def test_composed_pieces_equal_the_whole(piece):
    rng = random.Random(piece)
    for _ in range(150):
        turns = "".join(rng.choice("suaoSUAOxua") for _ in range(rng.randint(1, 12)))
        parts = [cv.transitions(turns[i:i + piece]) for i in range(0, len(turns), piece)]
        while len(parts) > 1:
            parts = [cv.compose(*parts[i:i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        assert cv.accepted(parts[0]) == cv.repair(turns)


def repaired_truth(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, role, text))
    out = {}
    for conv, turns in by.items():
        none = lambda v, low: low if v is None else v
        turns.sort(key=lambda r: (none(r[0], float("-inf")), (r[1] is not None, r[1] or ""), (r[2] is not None, hashlib.sha256((r[2] or "").encode()).digest())))
        seen, marks, count = set(), "", {"b": 0, "d": 0, "t": 0}
        for _, role, text in turns:
            body = (text or "").rstrip(" \t\n\x0b\x0c\r")
            kind = "b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            if kind:
                count[kind] += 1
            letter = (role or "")[:1] if (role or "")[:1] in ("s", "u", "a") else "o"
            marks += "x" if kind in ("b", "d") else letter.upper() if kind == "t" else letter
        initials = [(r or "")[:1] for _, r, _ in turns]
        numbers = [t for t, _, _ in turns if t is not None]
        cost, audit = cheapest(marks)
        odd, place, at, lines = len(audit.replace("D", "")) % 2, 0, 0, []
        for edit in audit:
            _, role, text = turns[at] if edit != "I" else (None, None, "")
            if edit != "D":
                to = role if edit == "K" else ("user", "assistant")[(place - odd) % 2]
                lines.append(f"{to}:{text}")
                place += 1
            at += edit != "I"
        out[conv] = (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, count["b"], count["d"], count["t"],
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def repaired_rows(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("piece,parts", [(128, 3), (2, 7), (1, 40)])
def test_repair_conversations_against_brute_force(spark, piece, parts):
    rng = random.Random(piece)
    texts = ["Hi.", "Yes", "No!", "  ", "", None, "A?  \n", "ok", "É.", "one.", "two.", "three."]
    rows = [(c, rng.choice([t, t, t, None, t + 2]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "User", None]), rng.choice(texts))
            for c in [*range(25), None] for t in range(rng.choice([1, 2, 3, 6, 16]))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(1)).withColumn("seq", F.lit(1)).withColumn("digest", F.lit("x"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert repaired_rows(cv.repair_conversations(df, piece_turns=piece)) == repaired_truth(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_one_conversation_over_many_tasks(spark):
    """A conversation of 20,000 turns is aligned in pieces by several tasks."""
    rng = random.Random(1)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"turn {t}" + rng.choice([".", ".", ""])) for t in range(20_000)] + [(2, 0, "user", "x" * 300_000 + "."), (2, 1, "assistant", "Yes.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    got = repaired_rows(cv.repair_conversations(df))
    audit = got[1][6]
    assert sum(audit.count(c) for c in "DKR") == 20_000 and got[1][0] == 0
    # one state per role: the same price by a plain scan over states
    user, other = 0, 10**9  # price when user, or assistant, is next
    for _, _, role, text in rows[:20_000]:
        cut = 0 if text.endswith(".") else 3
        u, o = min(user, other + 3), min(other, user + 3)
        user, other = min(u + 4, o + cut + 3 * (role != "assistant")), min(o + 4, u + cut + 3 * (role != "user"))
    assert got[1][5] == min(user, other + 3)
    assert got[2][5:7] == (0, "KK")


def test_damage_and_empty(spark):
    told = spark.createDataFrame([(c, t, r, x) for c in range(40) for t, r, x in ((0, "user", "A."), (1, "assistant", "B!"), (None, None, None))],
                                 "conv_id long, turn long, role string, text string")
    want = []
    for c, t, r, x in [tuple(r) for r in told.collect()]:
        k = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        row = (c, t, "user" if k == 4 else r, "" if k == 1 else x.translate({46: None, 33: None}) if k == 2 and x else x)
        want += [] if k == 0 else [row] * (1 + (k == 3))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in cv.damage(told).collect())
    gone = cv.damage(told).filter("false")
    out = repaired_rows(cv.repaired_or_empty(told, cv.repair_conversations(gone)))
    assert len(out) == 40 and set(out.values()) == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


# --- op1: the template tree -------------------------------------------------------

def segments(path):
    out = []
    for s in path.split("/"):
        if s:
            s = re.sub("[0-9a-f]{8}[0-9a-f-]*", "{hex}", s.lower())
            out.append(re.sub("[0-9]+", "{n}", s))
    return out


def templates(paths, least=5, variable=8):
    """Level by level within the urls of one host."""
    form = lambda s: "*" if re.fullmatch(r"(\{n\}|\{hex\}|[._-])+", s) else s

    def grow(group, left):
        out = {}
        if len(group) < least:
            return {i: ["*"] * len(s) for i, s in group}
        runs = {}
        for i, s in group:
            depth = 0
            while depth < len(s) and sum(t[:depth + 1] == s[:depth + 1] for _, t in group) >= least:
                depth += 1
            runs[i] = depth
        after = {}
        for i, s in group:
            out[i] = [form(x) for x in s[:runs[i]]]
            if runs[i] < len(s):
                if left:
                    after.setdefault(tuple(out[i]), []).append((i, s[runs[i] + 1:]))
                else:
                    out[i] += ["*"] * (len(s) - runs[i])
        for head, more in after.items():
            open_ = [(i, s) for i, s in more if s]
            for i, s in more:
                out[i] = [*head, "*"]
            for i, tail in (grow(open_, left - 1) if open_ else {}).items():
                out[i] += tail
        return out

    return {i: "".join("/" + p for p in t) for i, t in grow([(i, segments(p)) for i, p in paths.items()], variable).items()}


@pytest.mark.parametrize("variable", [1, 8])
def test_templates_against_brute_force(spark, variable):
    from lakeward.llm.url_filter import path_templates
    rng = random.Random(variable)
    paths = {}
    for i in range(300):
        parts = [rng.choice(["news", "shop", "u"]), rng.choice(["a", "b", f"x{chr(97 + i % 26)}{chr(97 + i // 26)}", str(i)]), rng.choice(["p", "q", f"r{chr(97 + i % 26)}z", "2024"]), rng.choice(["end", "", "fin"])]
        paths[i] = "/" + "/".join(parts[:rng.randint(0, 4)])
    df = spark.createDataFrame([(i, "h.org", p) for i, p in paths.items()], "id long, host string, path string").withColumn("_n", F.lit(1))
    got = {r.id: r.template for r in path_templates(df, "host", "path", "template", max_variable=variable).collect()}
    assert got == templates(paths, variable=variable)


def test_trap_of_depth_200_and_a_host_of_many_sections(spark):
    from lakeward.llm.url_filter import Rule, judge_urls
    rows = [(1000 * d + k, "http://trap.org" + "/a" * d + f"/leaf{chr(97 + k)}") for d in range(200) for k in range(6)]
    rows += [(10**6 + i, f"http://big.org/section-{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}/{['x', 'y'][i % 2]}/{i}") for i in range(15_000)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: r.template for r in judge_urls(df, [Rule("net/", "block")]).collect()}
    assert len(got) == len(rows)
    assert got[0] == "/*" and got[199_000] == "/a" * 199 + "/*"
    assert {got[10**6 + i] for i in range(15_000)} <= {f"/{s}/{x}/*" for s in {f"section-{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(15_000)} | {"*"} for x in "xy*"}


def purities(rows, z=1.96, prior=0.5, strength=2.0):
    """Pooled smoothed shares of one host's (template, bad) rows."""
    own, shapes = {}, {}
    for t, bad in rows:
        add = (1, int(bad is not None), int(bool(bad)))
        own[t] = tuple(a + b for a, b in zip(own.get(t, (0, 0, 0)), add))
        parts = [p for p in t.split("/") if p]
        for i, seg in enumerate(parts):
            below = shapes.setdefault((i, tuple(parts[:i]), seg), {})
            key = tuple(parts[i + 1:])
            below[key] = tuple(a + b for a, b in zip(below.get(key, (0, 0, 0)), add))
    groups = {}
    for (i, node, seg), below in shapes.items():
        groups.setdefault((i, node, frozenset(below)), []).append(seg)
    merged = {}
    for (i, node, kind), segs in groups.items():
        pooled = {b: [sum(shapes[i, node, s][b][x] for s in segs) for x in range(3)] for b in kind}
        all_n, all_k, all_b = (sum(v[x] for v in pooled.values()) for x in range(3))
        p = all_b / all_k if all_k else None
        for s in segs:
            n, k, b = (sum(v[x] for v in shapes[i, node, s].values()) for x in range(3))
            chi = sum(shapes[i, node, s][x][0] ** 2 / pooled[x][0] for x in kind) * all_n / n - n
            free = len(kind) - 1
            if chi <= free + z * (2 * free) ** 0.5 + 1e-6 and (not k or abs(b / k - p) <= z * (p * (1 - p) / k) ** 0.5 + 1e-12):
                merged[i, node, s] = kind
    pool, keys = {}, {}
    for t, (_, k, b) in own.items():
        parts = [p for p in t.split("/") if p]
        keys[t] = tuple(merged.get((i, tuple(parts[:i]), s), s) for i, s in enumerate(parts))
        mk, mb = pool.get(keys[t], (0, 0))
        pool[keys[t]] = mk + k, mb + b
    return {t: (pool[key][1] + prior * strength) / (pool[key][0] + strength) for t, key in keys.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_merged_purity_against_brute_force(spark, seed):
    from lakeward.llm.url_filter import template_purity
    rng = random.Random(seed)
    rows = []
    for _ in range(600):
        a, b, c = rng.choice("abcdef"), rng.choice("xy*"), rng.choice(["p", "q", "*"][:rng.choice([2, 3])])
        t = "".join("/" + s for s in (a, b, c)[:rng.choice([0, 1, 2, 3, 3, 3])])
        bad = {"a": True, "b": rng.random() < 0.9, "c": None, "d": False}.get(a, rng.choice([None, True, False]))
        rows.append((t, bad))
    df = spark.createDataFrame([("h", t, b) for t, b in rows], "host string, template string, bad boolean")
    got = {r._t: r.purity for r in template_purity(df, "host", "template", "bad").collect()}
    want = purities(rows)
    assert got.keys() == want.keys()
    assert all(got[t] == pytest.approx(want[t], abs=1e-9) for t in want)
    assert len(set(want.values())) < len(want)  # some are merged
