"""Scalar column functions (X1-X5, F6).  All are built-in Spark expressions,
so they stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: outcome words reported by a run and the words that count
# as success for each kind of run ------------------------------------------
OUTCOME_TRUE_WORDS = {
    "partition_create": ("created", "exists"),
    "partition_lock": ("locked",),
    "partition_unlock": ("unlocked",),
    "statistics": ("created", "updated"),
}
NO_PARTITIONS = "no_partitions"
STATISTICS_OUTCOMES = ("created", "updated", "refreshed", "already_exists", "skipped", "failed")
# Missing run times, in milliseconds, per report kind.
MISSING_RUNTIME_MS = {"persist": 0, "task_chain": 0, "model_runtime": -1000}
# --- end of fixed values ------------------------------------------------------


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ms_to_seconds(ms) -> Column:
    """Milliseconds to whole seconds, rounding half to even (500 -> 0,
    1500 -> 2, 2500 -> 2).  ``round`` would round half up and be wrong."""
    return F.bround(_col(ms) / F.lit(1000.0), 0).cast("bigint")


def runtime_rule(kind: str, success, run_time_ms, timer: bool = True) -> Column:
    """The three reference rules that turn a run into a reported runtime.

    * ``persist``: seconds when the timer is on, the run succeeded and the
      seconds are > 0, else null; a missing run time counts as 0 ms.
    * ``task_chain``: seconds whenever the run succeeded (0 kept), else null;
      missing counts as 0 ms.
    * ``model_runtime``: seconds when the run succeeded and seconds > 0,
      else null; missing counts as -1000 ms.
    """
    ok = F.coalesce(_col(success), F.lit(False))
    secs = ms_to_seconds(F.coalesce(_col(run_time_ms).cast("bigint"), F.lit(MISSING_RUNTIME_MS[kind]).cast("bigint")))
    if kind == "persist":
        cond = ok & (secs > 0) if timer else F.lit(False)
    elif kind == "task_chain":
        cond = ok
    elif kind == "model_runtime":
        cond = ok & (secs > 0)
    else:
        raise ValueError(f"unknown runtime rule {kind!r}")
    return F.when(cond, secs).otherwise(F.lit(None).cast("bigint"))


def contains_ci(text, word: str) -> Column:
    """Literal, case-insensitive substring test (``_`` and ``%`` are literal)."""
    w = validate_word(word)
    return F.lower(_col(text)).contains(F.lower(F.lit(w)))


def validate_word(word: str) -> str:
    if word is None:
        raise ValueError("search word must not be empty")
    w = str(word).strip()
    if not w:
        raise ValueError("search word must not be empty")
    return w


def outcome_flag(kind: str, outcome) -> Column:
    """Map an outcome word to the boolean a result row records."""
    words = OUTCOME_TRUE_WORDS[kind]
    return F.coalesce(_col(outcome).isin(*words), F.lit(False))


def year_bounds(start: int, end: int) -> list[str]:
    """Inclusive list of yearly bounds ``start..end`` as 4-character strings;
    N+1 bounds describe N half-open ranges.  A reversed range gives none."""
    start, end = int(start), int(end)
    if end < start:
        return []
    return [str(y) for y in range(start, end + 1)]


def year_partition(value, start: int, end: int, rest: str | None = None) -> Column:
    """The yearly range a string value falls in: the lower bound ``y`` with
    ``y <= value < y+1`` (string order, as the range predicates are defined),
    or ``rest`` (null by default) when it lies outside ``[start, end)``.

    Bounds are a short, parameter-sized list, so this is a plain CASE
    expression evaluated inside codegen: no join against a range table.
    """
    bounds = year_bounds(start, end)
    v = _col(value).cast("string")
    rest_col = F.lit(rest).cast("string")
    if len(bounds) < 2:
        return rest_col
    expr = F.when(v.isNull() | (v < F.lit(bounds[0])) | (v >= F.lit(bounds[-1])), rest_col)
    for lo in reversed(bounds[:-1]):
        expr = expr.when(v >= F.lit(lo), F.lit(lo))
    return expr.otherwise(rest_col)
