"""Benchmark decontamination (native): a positional inverted index of the
training text, read from the rarest benchmark terms.

A window is ``width`` consecutive words of an item, or the whole of a shorter
item.  The corpus is counted for the benchmark's terms; the postings (text,
position) of each window's rarest terms are stored, those of the very rarest
with the words around them.  A window's lists are intersected after their
positions are moved by the terms' offsets, which all windows of an item that
lie on one diagonal share.  The longer lists of the other, commoner terms are
read only where the rarest one has a posting: in the words stored with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeward.functions.keyed import packed_join
from lakeward.llm.common import fold_case, free_name
from lakeward.session import materialize

# Fixed value of the contract: what stands between two words once A-Z are folded.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

TERMS_PER_PASS = 1_000_000  # hashes of terms that one pass over the texts broadcasts: 16 MB at most


def words_of(text: Column) -> Column:
    """Lower-cased words of a text; null has none."""
    return F.array_remove(F.split(fold_case(F.coalesce(text, F.lit(""))), BREAK, -1), "")


def item_sequences(items: DataFrame, item_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The distinct word sequences of the items (_seq, _words), and the items
    of each (_seq, _item); items without a word have no sequence."""
    split = items.select(F.col(item_col).alias("_item"), words_of(F.col(text_col)).alias("_words")).filter(F.size("_words") > 0)
    sequences = materialize(split.select("_words").distinct().withColumn("_seq", F.monotonically_increasing_id()), "sequences")
    return sequences, packed_join(split, sequences.withColumnRenamed("_words", "_w"), ["_words"], ["_w"], "inner").select("_seq", "_item").distinct()


def term_counts(texts: DataFrame, sequences: DataFrame) -> DataFrame:
    """How often each benchmark term occurs in the corpus (_term, _n).  The
    semi join moves below the partial count when the terms are few enough to
    be broadcast; otherwise the counted terms are joined."""
    vocabulary = materialize(sequences.select(F.explode("_words").alias("_term")).distinct(), "vocabulary")
    tokens = texts.select(F.explode(words_of(F.col("_text"))).alias("_term"))
    return tokens.groupBy("_term").agg(F.count(F.lit(1)).alias("_n")).join(vocabulary, "_term", "left_semi")


def rarest_terms(sequences: DataFrame, counts: DataFrame, width: int, rarest: int) -> DataFrame:
    """Per sequence: its words, its window length and, for every window whose
    terms all occur in the corpus, the start and the offsets of its rarest
    terms, the rarest first (_windows)."""
    size = F.least(F.size("_words"), F.lit(width))
    placed = sequences.select("_seq", F.size("_words").alias("_len"), F.posexplode("_words").alias("_off", "_term"), size.alias("_size"))
    first = F.greatest(F.col("_off") - F.col("_size") + 1, F.lit(0))
    last = F.least(F.col("_off"), F.col("_len") - F.col("_size"))
    inside = placed.select("_seq", "_size", "_off", "_term", F.explode(F.sequence(first, last)).alias("_start"))
    counted = packed_join(inside, counts.withColumnRenamed("_term", "_t"), ["_term"], ["_t"], "inner")
    ranked = F.slice(F.array_sort(F.collect_list(F.struct("_n", "_term", "_off"))), 1, rarest)
    windows = (counted.groupBy("_seq", "_start").agg(ranked.alias("_rare"), F.count(F.lit(1)).alias("_found"), F.first("_size").alias("_size"))
               .filter(F.col("_found") == F.col("_size")))
    per_seq = windows.groupBy("_seq").agg(F.sort_array(F.collect_list(F.struct(
        F.col("_start").alias("start"), F.transform("_rare", lambda r: r["_off"]).alias("offs")))).alias("_windows"))
    return materialize(sequences.join(per_seq, "_seq").select("_seq", "_words", size.alias("_size"), "_windows"), "windows")


def anchors_of(windows: DataFrame) -> DataFrame:
    """(_seq, _off, _term, _main): the places of the windows' rarest terms;
    _term is a hash, _main says that a window has no rarer one."""
    main = F.array_distinct(F.transform("_windows", lambda w: w["offs"][0]))
    places = windows.select("_seq", "_words", main.alias("_mains"), F.explode(F.array_distinct(F.flatten(
        F.transform("_windows", lambda w: w["offs"])))).alias("_off"))
    return materialize(places.select("_seq", "_off", F.xxhash64(F.get("_words", F.col("_off"))).alias("_term"),
                                     F.array_contains("_mains", F.col("_off")).alias("_main")), "anchors")


def store_postings(texts: DataFrame, anchors: DataFrame, reach: int) -> DataFrame:
    """The stored index: (_row, _pos, _term, _around) of every place in the
    corpus where a term of ``anchors`` stands; a main one has the words up to
    ``reach`` places away.  Texts are read once per TERMS_PER_PASS terms and
    never shuffled: the words around are cut out where the text is."""
    terms = materialize(anchors.groupBy("_term").agg(F.max("_main").alias("_main")), "terms")
    passes = max(1, -(-terms.count() // TERMS_PER_PASS))
    tokens = (texts.select("_row", words_of(F.col("_text")).alias("_all"))
              .select("_row", "_all", F.posexplode("_all").alias("_pos", "_word")).withColumn("_term", F.xxhash64("_word")))
    around = F.slice("_all", F.greatest(F.col("_pos") - reach, F.lit(0)) + 1, 2 * reach + 1 + F.least(F.col("_pos") - reach, F.lit(0)))
    found = [tokens.join(F.broadcast(terms.filter(F.pmod("_term", F.lit(passes)) == k)), "_term")
             .select("_row", "_pos", "_term", F.when(F.col("_main"), around).alias("_around")) for k in range(passes)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return materialize(out, "postings")


def intersect(postings: DataFrame, anchors: DataFrame, windows: DataFrame, slop: int, reach: int) -> DataFrame:
    """Per text (_row) the spans (seq, start, length) of exact and near
    windows.  On each diagonal of a text and a sequence, the windows whose
    rarest terms all stand on it, within ``slop`` places, are compared with
    the words around the rarest one."""
    met = packed_join(postings, anchors.drop("_main").withColumnRenamed("_term", "_t"), ["_term"], ["_t"], "inner")
    at = F.col("_pos") - F.col("_off")
    diagonals = F.explode(F.sequence(at - slop, at + slop)) if slop else at
    met = met.select("_row", "_seq", "_off", diagonals.alias("_diag"),
                     F.when(F.col("_around").isNotNull(), F.struct(F.col("_off").alias("off"), F.greatest(F.col("_pos") - reach, F.lit(0)).alias("first"),
                                                                   F.col("_around").alias("words"))).alias("_near"))
    lists = met.groupBy("_row", "_seq", "_diag").agg(F.collect_set("_off").alias("_offs"), F.collect_set("_near").alias("_nears"))
    joined = packed_join(lists, windows.withColumnRenamed("_seq", "_s"), ["_seq"], ["_s"], "inner")
    whole = F.filter("_windows", lambda w: (F.col("_diag") + w["start"] >= 0) & (F.size(F.array_except(w["offs"], F.col("_offs"))) == 0))
    placed = F.transform(whole, lambda w: F.struct(
        w["start"].alias("start"), F.get(F.filter("_nears", lambda x: x["off"] == w["offs"][0]), F.lit(0)).alias("text")))
    left = joined.select("_row", "_seq", "_words", "_size", "_diag", placed.alias("_placed")).filter(F.size("_placed") > 0)

    def exact(w: Column) -> Column:
        return F.slice(w["text"]["words"], F.col("_diag") + w["start"] - w["text"]["first"] + 1, F.col("_size")) == F.slice("_words", w["start"] + 1, F.col("_size"))

    def near(w: Column) -> Column:
        begin, first = F.col("_diag") + w["start"], w["text"]["first"]

        def close(i: Column) -> Column:
            low = F.greatest(begin + i - slop, F.lit(0))
            return F.array_contains(F.slice(w["text"]["words"], low - first + 1, begin + i + slop + 1 - low), F.get("_words", w["start"] + i))
        inside = begin + F.col("_size") <= first + F.size(w["text"]["words"])
        return inside & ~exact(w) & F.forall(F.sequence(F.lit(0), F.col("_size") - 1), close)

    def spans(keep) -> Column:
        return F.transform(F.filter("_placed", keep), lambda w: F.struct(
            F.col("_seq").alias("seq"), (F.col("_diag") + w["start"]).alias("start"), F.col("_size").alias("length")))

    told = left.select("_row", spans(exact).alias("exact"), (spans(near) if slop else F.array().cast(SPANS)).alias("near"))
    told = told.filter((F.size("exact") > 0) | (F.size("near") > 0))
    return materialize(told.groupBy("_row").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("exact", "near")]), "spans")


SPANS = "array<struct<seq:bigint,start:int,length:int>>"


def find_passages(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", width: int = 10, slop: int = 0, rarest: int = 2) -> tuple[DataFrame, DataFrame]:
    """Where windows of the items occur in the documents.

    Returns the passages, one row per row of ``docs`` (``id_col``, n_words,
    exact, near), and the items of every sequence (_seq, _item).  ``exact``
    lists the distinct (seq, start, length) at which a window stands word for
    word, ``near`` those at which every word of a window stands within
    ``slop`` places of its own (none for slop 0).

    Null or empty texts have no words; items without a word match nothing;
    repeated rows are judged each, repeated items share a sequence; empty
    tables give empty results; other columns of both tables don't matter.
    ``width`` and ``rarest`` are at least 1.  Texts are known by their
    SHA-256, so copies share postings, which partial aggregates fold.  Only
    hashes of terms are broadcast, TERMS_PER_PASS at most; all else is joins and
    aggregates of postings, at most one row per posting and sequence that holds
    it, whose hot keys skew handling splits.  Texts are not shuffled."""
    if width < 1 or rarest < 1 or slop < 0:
        raise ValueError("width and rarest must be at least 1, slop at least 0")
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias(id_col), text.alias("_text"), F.unhex(F.sha2(text, 256)).alias("_row"))
    sequences, items_of = item_sequences(items, item_col, item_text_col)
    windows = rarest_terms(sequences, term_counts(texts, sequences), width, rarest)
    anchors, reach = anchors_of(windows), width - 1 + 2 * slop
    found = intersect(store_postings(texts, anchors, reach), anchors, windows, slop, reach)
    counted = texts.select(id_col, "_row", F.size(words_of(F.col("_text"))).cast("long").alias("n_words"))
    met = packed_join(counted, found.withColumnRenamed("_row", "_r"), ["_row"], ["_r"], "left")
    return met.select(id_col, "n_words", *[F.coalesce(c, F.array().cast(SPANS)).alias(c) for c in ("exact", "near")]), items_of


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", width: int = 10) -> DataFrame:
    """Per row of ``docs``: ``id_col``, n_words, n_hit (words inside an exact
    occurrence), n_items and item_ids (sorted as strings) of the items with
    an occurring window, contaminated.  A null item id hits words but is not
    listed.  See ``find_passages`` for odd rows and scale."""
    passages, items_of = find_passages(docs, items, id_col, text_col, item_col, item_text_col, width)
    covered = F.flatten(F.transform("exact", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1)))
    at = free_name([id_col], "_at")
    rows = materialize(passages.select(F.col(id_col), F.monotonically_increasing_id().alias(at), "n_words",
                                       F.size(F.array_distinct(covered)).cast("long").alias("n_hit"),
                                       F.array_distinct(F.transform("exact", lambda s: s["seq"])).alias("_seqs")), "passages")
    named = packed_join(rows.select(at, F.explode("_seqs").alias("_seq")), items_of.withColumnRenamed("_seq", "_s"), ["_seq"], ["_s"], "inner")
    listed = named.groupBy(at).agg(F.sort_array(F.collect_set(F.col("_item").cast("string"))).alias("item_ids"))
    out = rows.join(listed, at, "left")
    return out.select(id_col, "n_words", "n_hit", F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
                      F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), (F.col("n_hit") > 0).alias("contaminated"))
