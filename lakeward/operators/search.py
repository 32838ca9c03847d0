"""Persistence-candidate selection and attribute search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeward.functions.keyed import first_per_key
from lakeward.functions.scalars import contains_ci, validate_word

CANDIDATE_COLUMNS = ["entity", "space", "businessName", "isPersisted"]


def best_persistence_candidates(stats: DataFrame, key: Sequence[str], order: Sequence[str],
                                score_col: str = "persistencyCandidateScore", score: int = 10) -> DataFrame:
    """F2 (long form): per analysed view (``key``), the first candidate in list
    order (``order``) whose score is exactly ``score``; a missing score counts
    as 0.  Views without such a candidate give no row.  The same entity may
    appear once per analysed view.

    The filter runs before the shuffle and "first" is a partial aggregate, so
    only one candidate per key and map task crosses the network."""
    # coalesce(score, 0) = s, written so the scan can use it: for s != 0 a
    # missing score never matches; for s = 0 it always does.
    sc = F.col(score_col)
    cond = (sc == F.lit(score)) if score != 0 else ((sc == F.lit(0)) | sc.isNull())
    hits = stats.filter(cond)
    return first_per_key(hits, list(key), list(order), CANDIDATE_COLUMNS)


def best_candidate_from_list(views: DataFrame, list_col: str = "stats",
                             score_field: str = "persistencyCandidateScore", score: int = 10) -> DataFrame:
    """F2 (array form): ``list_col`` holds the analyser's candidate list per
    view as array<struct>; keep the first element scoring ``score``.  Pure
    higher-order functions, evaluated row by row without any shuffle."""
    best = F.get(F.filter(F.col(list_col), lambda s: F.coalesce(s[score_field], F.lit(0)) == F.lit(score)), 0)
    out = views.withColumn("_best", best).filter(F.col("_best").isNotNull())
    others = [c for c in views.columns if c != list_col]
    return out.select(*others, *[F.col("_best")[c].alias(c) for c in CANDIDATE_COLUMNS])


def attributes_containing(views: DataFrame, word: str, attributes_col: str = "attributes",
                          entity: str = "entity", space: str = "space",
                          business_name: str = "businessName") -> DataFrame:
    """one row per view attribute that contains ``word`` -- a literal,
    case-insensitive substring test (``_`` and ``%`` are not wildcards).

    ``attributes_col`` is an array<string> per view.  Everything runs inside
    the scan's stage: no shuffle, each view's list is handled on its own."""
    w = validate_word(word)
    # Filter each list first, then explode only the matches: non-matching
    # attributes never become rows (no copy of the view columns per word).
    hits = F.filter(F.col(attributes_col), lambda a: contains_ci(a, w))
    return views.select(F.col(entity).alias("entity"), F.col(space).alias("space"),
                        F.col(business_name).alias("businessName"), F.explode(hits).alias("attribute"))
