"""Line dedup (native): lines found in many documents go from all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeward.functions.keyed import packed_join
from lakeward.llm.common import SPACE_CHARS, fold_case, free_name
from lakeward.session import materialize


def line_key(line: Column) -> Column:
    """A line stripped of white space at both ends; the caller folds case."""
    return F.btrim(line, F.lit(SPACE_CHARS))


def line_dedup(docs: DataFrame, text_col: str = "text", min_documents: int = 10, min_length: int = 1, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with lines whose key occurs in at least ``min_documents``
    documents removed from ``text_col``; adds n_lines (before) and n_dropped.

    A document is a value of ``id_col``: rows that repeat an id count once, and
    so do rows without one.  A null or empty text is one empty line and comes
    back empty.  Keys shorter than ``min_length`` code points stay.  Other
    columns pass through; n_lines and n_dropped replace columns so named.

    Lines are exploded with their position as 128-bit digests.  A line held by
    a third of all rows is counted partially before its count is shuffled; the
    join that finds the rows of common lines reads plain shuffles that skew
    handling can split, and only the lines found there are counted by
    document.  A row is known by two 64-bit hashes of its id and text, so
    reads need not agree on an order, and equal rows share what they lose.
    Lines are reassembled by position, in time linear in their number; only
    the texts travel, once."""
    h1, h2, drop, parts = (free_name(docs.columns, n) for n in ("_row_h1", "_row_h2", "_lost", "_parts"))
    text, name = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col).cast("string")
    known = docs.withColumn(h1, F.xxhash64(name, text)).withColumn(h2, F.xxhash64(F.lit(1), text, name))

    keys = F.transform(F.split(fold_case(text), "\n", -1), line_key)
    lines = (known.select(F.col(h1).alias("_h1"), F.col(h2).alias("_h2"), name.alias("_id"), F.posexplode(keys).alias("_pos", "_key"))
             .filter(F.char_length("_key") >= max(min_length, 1))
             .select("_h1", "_h2", "_id", "_pos", F.unhex(F.md5("_key")).alias("_digest")))
    often = lines.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_documents).drop("_n")
    met = materialize(packed_join(lines, often, ["_digest"], ["_digest"], "left_semi"), "lines")
    common = met.select("_digest", "_id").distinct().groupBy("_digest").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_documents).drop("_n")
    lost = (packed_join(met, common, ["_digest"], ["_digest"], "left_semi")
            .groupBy("_h1", "_h2").agg(F.collect_set("_pos").alias(drop)))  # at most one document's lines

    joined = packed_join(known, lost.hint("merge"), [h1, h2], ["_h1", "_h2"], "left").withColumn(parts, F.split(text, "\n", -1))
    gone, size = F.coalesce(F.size(drop), F.lit(0)), F.size(parts)
    left = F.array_except(F.sequence(F.lit(0), size - 1), F.col(drop))
    return (joined.withColumn("n_lines", size.cast("long")).withColumn("n_dropped", gone.cast("long"))
            .withColumn(text_col, F.when(gone == 0, text).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col(parts), i)), "\n")))
            .drop(h1, h2, drop, parts))
