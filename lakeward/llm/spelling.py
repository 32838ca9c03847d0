"""Spelling variants: words one edit apart, found by pivotal grams.

The bigrams of all words have one order, the rarest first.  A word's prefix is
its three rarest bigrams (one edit destroys two at most); two disjoint ones of
the prefix, chosen by dynamic programming for the least total frequency, are
its pivots.  One edit cannot destroy both.  So of two words one edit apart, the
one whose prefix ends first has a pivot in the other's prefix, moved by at
most the difference the edit makes; such pairs are verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeward.llm.common import Rounds, fold_case
from lakeward.session import materialize

# Fixed value of the contract: letters of a word.
LETTERS = r"[A-Za-zÀ-ÿ]+"

EDITS, GRAM = 1, 2
PREFIX, PIVOTS = GRAM * EDITS + 1, EDITS + 1
BUCKETS = 1 << 16  # bigrams are counted by a hash, so their order has this many entries for any alphabet

ENTRY = "gram int, pos int, size int, last int, mask bigint, word string, n bigint, pivot boolean"
# position and length of the other word's gram, against the pivot's: same length, one letter more, one letter less
MOVES = ((0, 0), (0, 1), (1, 1), (0, -1), (-1, -1))


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage_every: int | None = None,
                min_length: int = 5, min_count: int = 3) -> DataFrame:
    """(word, n): the runs of letters of all texts, A-Z lower-cased, of at
    least ``min_length`` code points and ``min_count`` occurrences.  With
    ``damage_every``, a run whose crc32 with its document's id (a null id is
    empty) is divisible by it loses one letter.  Null texts hold none."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"),
                       F.explode(F.regexp_extract_all(fold_case(F.col(text_col)), F.lit(LETTERS), F.lit(0))).alias("_run"))
    runs = runs.filter(F.char_length("_run") >= min_length)
    word = F.col("_run")
    if damage_every:
        runs = runs.withColumn("_h", F.crc32(F.concat("_id", F.lit(":"), "_run").cast("binary")))
        at = F.pmod("_h", F.char_length("_run")).cast("int")
        cut = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.char_length("_run")))
        word = F.when(F.col("_h") % damage_every == 0, cut).otherwise(word)
    return (runs.select(word.alias("word")).filter(F.char_length("word") >= min_length)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count))


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bigram buckets of all words, the words' bounds in them, and a mask of
    each word's letters."""
    size = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    ends = np.cumsum(size)
    inner = np.ones(len(points), bool)
    inner[ends - 1] = False  # a word's last letter starts no bigram
    at = np.flatnonzero(inner)
    grams = (points[at] * 31_337 + points[at + 1] * 7_919) % BUCKETS if len(at) else np.zeros(0, np.int64)
    masks = np.bitwise_or.reduceat(np.int64(1) << (points % 63), ends - size) if len(words) else np.zeros(0, np.int64)
    return grams, np.concatenate(([0], np.cumsum(size - 1))), masks


def _words_of(batch: pa.RecordBatch) -> list[str]:
    return batch.column(0).to_pylist()


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        total += np.bincount(_grams(_words_of(batch))[0], minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["gram", "n"])


def gram_order(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rank (rarest first) and frequency of every bucket; the driver sees at
    most BUCKETS sums."""
    rows = words.select("word").mapInArrow(_gram_counts, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(BUCKETS, np.int64)
    for r in rows:
        counts[r["gram"]] = r["n"]
    rank = np.empty(BUCKETS, np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(BUCKETS)
    return rank, counts


def choose_pivots(places: list[int], weights: list[int], count: int = PIVOTS) -> list[int]:
    """``count`` disjoint bigrams of the least total weight, as indices into
    ``places`` (ascending): best[m] is the cheapest choice of m among those
    that end before the place at hand."""
    best: list[list[tuple[int, tuple[int, ...]]]] = [[(0, ())]]
    for j, place in enumerate(places):
        fits = next((i for i in range(j, 0, -1) if places[i - 1] + GRAM <= place), 0)  # bigrams before it that don't overlap
        row = list(best[j])
        for m, (cost, chosen) in enumerate(best[fits]):
            if m < count:
                option = (cost + weights[j], (*chosen, j))
                if m + 1 == len(row):
                    row.append(option)
                elif option < row[m + 1]:
                    row[m + 1] = option
        best.append(row)
    return list(best[-1][count][1])


def _entries(rank: np.ndarray, counts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = _words_of(batch), batch.column(1).to_pylist()
            grams, bounds, masks = _grams(words)
            ranks = rank[grams]
            weights = counts[grams].tolist()
            out: list[tuple] = []
            for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                own = ranks[a:b]
                last = int(np.partition(own, PREFIX - 1)[PREFIX - 1])
                places = np.flatnonzero(own <= last).tolist()  # every place of the last bigram belongs to the prefix
                pivots = set(choose_pivots(places, [weights[a + p] for p in places]))
                out += [(int(grams[a + p]), p, b - a + 1, last, int(masks[k]), words[k], n[k], i in pivots) for i, p in enumerate(places)]
            cols = list(zip(*out)) if out else [()] * 8
            types = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                             names=["gram", "pos", "size", "last", "mask", "word", "n", "pivot"])
    return run


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b), a < b: words exactly one inserted, deleted or
    replaced code point apart.  ``words`` (word, n) are distinct, not null and
    of at least four code points."""
    rank, counts = gram_order(words)
    entries = materialize(words.select("word", "n").mapInArrow(_entries(rank, counts), ENTRY), "grams")
    moves = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(s).alias("s")) for p, s in MOVES]))
    pivots = (entries.filter("pivot").withColumn("move", moves)
              .select("gram", (F.col("pos") + F.col("move.p")).alias("pos"), (F.col("size") + F.col("move.s")).alias("size"),
                      F.col("last").alias("last_s"), F.col("mask").alias("mask_s"), F.col("word").alias("s"), F.col("n").alias("n_s")))
    met = pivots.join(entries.drop("pivot"), ["gram", "pos", "size"])
    left = met.filter((F.col("last_s") <= F.col("last")) & (F.bit_count(F.col("mask_s").bitwiseXOR(F.col("mask"))) <= 2))
    true = left.filter((F.col("s") != F.col("word")) & (F.levenshtein("s", "word", 1) == 1))
    first = F.col("s") < F.col("word")

    def of(x, y) -> Column:
        return F.when(first, F.col(x)).otherwise(F.col(y))

    return true.select(of("s", "word").alias("a"), of("word", "s").alias("b"), of("n_s", "n").alias("n_a"), of("n", "n_s").alias("n_b")).distinct()


def _follow(forms: DataFrame) -> DataFrame:
    """(word, root): forms followed to the last by pointer jumping.  A form's
    n at least doubles, so there are no cycles and few rounds."""
    rounds = Rounds(forms.sparkSession)
    cur = rounds.next(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = cur.select(F.col("word").alias("_w"), F.col("root").alias("_next"))
        step = rounds.next(cur.join(onward, cur["root"] == onward["_w"], "left")
                           .select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        cur = step.select("word", "root")
        if not step.filter("moved").limit(1).count():
            return cur


def group_variants(words: DataFrame) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n.

    A word's form is its near word of largest n (ties: the smallest in
    code-point order) if that is at least twice the word's n, else null; its
    root is where the forms lead, itself without one.  ``words`` (word, n) are
    distinct and not null, of at least four code points; an empty table gives
    an empty result.

    Candidates meet on (bigram, position, length), so a bigram that very many
    words hold is dealt over the places it stands at; keys are joined, never
    gathered, and skew handling splits a hot one.  Counts and forms are
    partial aggregates of pairs."""
    words = materialize(words.select("word", "n"), "words")
    pairs = materialize(near_pairs(words), "pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("_to"), F.col("n_b").alias("_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("_to"), F.col("n_a").alias("_n")))
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("_n")).alias("m"), F.col("_to").alias("w"))).alias("_best"))
    strong = -F.col("_best.m") >= 2 * F.col("n")
    formed = materialize(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, F.col("_best.w")).alias("form"), F.when(strong, -F.col("_best.m")).alias("form_n")), "formed")
    roots = _follow(formed.filter("form is not null"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
