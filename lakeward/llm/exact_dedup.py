"""Exact dedup: tree-merge of sorted digest runs (native)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeward.functions.keyed import packed_join
from lakeward.llm.common import checkpointed, fold_case, free_name

_KEY = ["_digest", "_length", "_witness"]


def digest_columns(text):
    """Digest of the normalised text with two independent witnesses."""
    norm = fold_case(F.coalesce(text, F.lit("")))
    return [F.sha2(norm, 256).alias("_digest"), F.octet_length(norm).alias("_length"),
            F.xxhash64(norm).alias("_witness")]


def merge_runs(rows: DataFrame, keep: str = "largest", runs: int = 64, fan_in: int = 4) -> DataFrame:
    """One row per text with its size and the identifier that stays.

    Every scan partition is a run; each run is reduced to one entry per
    digest.  Then ``fan_in`` neighbouring runs are merged per round until one
    is left, each merge retaining count and identifier.  An entry only merges
    with one whose digest, length and second hash agree, so the identifiers
    are verified at every level.  A hot text is spread over all runs and
    shrinks by ``fan_in`` a round; no task sees more than its run's entries."""
    pick = F.max if keep == "largest" else F.min
    level = (rows.withColumn("_run", F.pmod(F.spark_partition_id(), F.lit(runs)))
             .groupBy(*_KEY, "_run").agg(pick("_id").alias("_id"), F.count(F.lit(1)).alias("_n")))
    left = runs
    while left > 1:
        left = -(-left // fan_in)
        level = (level.withColumn("_run", F.floor(F.col("_run") / fan_in).cast("int"))
                 .groupBy(*_KEY, "_run").agg(pick("_id").alias("_id"), F.sum("_n").alias("_n")))
    return level.drop("_run")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after A-Z are lower-cased; a null text is
    empty.  The row with the largest (or ``keep='smallest'``) id stays; a
    null id loses to any other.  Of rows that repeat both id and text the
    first in scan order stays.  An empty table gives an empty result; other
    columns of ``docs`` are not read."""
    sign = -1 if keep == "largest" else 1
    at = F.col("_at") * sign
    rank = F.col("_doc").isNull() if keep != "largest" else F.col("_doc").isNotNull()
    rows = checkpointed(docs.select(F.col(id_col).alias("_doc"), F.monotonically_increasing_id().alias("_at"),
                                    *digest_columns(F.col(text_col))))
    entry = F.struct(rank.alias("r"), F.col("_doc").alias("doc"), at.alias("at"))
    groups = merge_runs(rows.withColumn("_id", entry), keep).filter("_n > 1")
    out = packed_join(rows, groups, _KEY, _KEY)
    alone = F.col("_n").isNull()
    return out.select(
        F.col("_doc").alias(id_col),
        F.when(alone, F.col("_doc")).otherwise(F.col("_id.doc")).alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("_id.at") == at)).alias("kept"),
        F.col("_digest").alias("text_sha256"), F.col("_at"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns (rules: exact_groups).

    ``docs`` must give the same rows in the same order on every read, as a
    stored table does."""
    at = free_name(docs.columns, "_row_at")
    dropped = exact_groups(docs, id_col, text_col, keep).filter(~F.col("kept")).select(F.col("_at").alias(at))
    return docs.withColumn(at, F.monotonically_increasing_id()).join(dropped, at, "left_anti").drop(at)
