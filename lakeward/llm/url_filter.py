"""URL filters (native): rules, then a path-template tree per host."""

from __future__ import annotations

from dataclasses import dataclass
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeward.functions.keyed import packed_join
from lakeward.llm.common import Rounds, checkpointed, free_name


@dataclass(frozen=True)
class Rule:
    """``rule`` is host/path: it fits the host and its subdomains when the
    url's path starts with the rule's path."""

    rule: str
    verdict: str

    def fits(self, host: Column, path: Column) -> Column:
        name, _, rest = self.rule.partition("/")
        return ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)


def host_of(url: Column) -> Column:
    rest = _after_scheme(url)
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest fitting rule as (rule, verdict), or null.  The rules are a
    small hand-kept list and become one expression."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.rule), r.rule)):
        out = F.when(r.fits(host, path), F.struct(F.lit(r.rule).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _segment(seg: Column) -> Column:
    """A segment with long hex runs and numbers generalised."""
    seg = F.regexp_replace(F.lower(seg), r"[0-9a-f]{8}[0-9a-f-]*", "{hex}")
    return F.regexp_replace(seg, r"[0-9]+", "{n}")


def _forms(segs: Column) -> Column:
    """Literal parts of a template; segments of numbers or hex runs only are wildcards."""
    variable = F.transform(segs, lambda s: F.when(s.rlike(r"^(\{n\}|\{hex\}|[._-])+$"), "/*").otherwise(F.concat(F.lit("/"), s)))
    return F.array_join(variable, "")


def path_templates(pages: DataFrame, host: str, path: str, out: str, min_pages: int = 5, max_variable: int = 8) -> DataFrame:
    """Adds ``out``: the url's template in its host's tree, one part per segment.

    Below every node a segment stays literal when at least ``min_pages`` urls
    have it there, however many urls the node has; rarer ones become one
    wildcard, below which the tree goes on with the urls of them all, and those
    that hold numbers or hex runs only are written as wildcards.  Below a node
    of fewer urls, and below the ``max_variable``-th wildcard of rare segments
    on a path, all that is left is wildcards.

    The tree is built from the distinct generalised paths and their counts.
    A round takes each path's whole run of literal segments, found by counting
    all prefixes at once, and the wildcard after it; so there are at most
    ``max_variable`` rounds, however deep the paths are, and the pages are
    read twice."""
    rest, shape = "_rest", ["_host", "_shape"]
    segs = F.transform(F.filter(F.split(F.col(path), "/"), lambda s: s != ""), _segment)
    keyed = pages.withColumn("_shape", F.array_join(segs, "/"))
    rounds = Rounds(pages.sparkSession)
    shapes = (keyed.groupBy(F.col(host).alias("_host"), "_shape").agg(F.count(F.lit(1)).alias("_n"))
              .withColumn(rest, F.when(F.col("_shape") == "", F.array().cast("array<string>")).otherwise(F.split("_shape", "/", -1))))
    cur = rounds.next(shapes.select(F.monotonically_increasing_id().alias("_id"), *shape, "_n", rest, F.lit("").alias("_out")))
    for left in range(max_variable, -1, -1):
        at = cur.filter(F.size(rest) > 0).select("_id", "_n", F.explode(F.transform(
            F.sequence(F.lit(0), F.size(rest)), lambda i: F.xxhash64("_host", "_out", F.slice(rest, F.lit(1), i)))).alias("_prefix"))
        often = at.groupBy("_prefix").agg(F.sum("_n").alias("_pages")).filter(F.col("_pages") >= min_pages)
        # a prefix has at least as many pages as those that start with it: the number of frequent ones is their depth
        run = packed_join(at, often, ["_prefix"], ["_prefix"], "left_semi").groupBy("_id").agg((F.count(F.lit(1)) - 1).cast("int").alias("_run"))
        met = packed_join(cur, run.withColumnRenamed("_id", "_i"), ["_id"], ["_i"], "left")
        ends = F.col("_run").isNull() if left else F.lit(True)  # too few urls, or no wildcard left
        literal = F.coalesce("_run", F.lit(0))
        tail = F.slice(rest, literal + 1, F.greatest(F.size(rest), F.lit(1)))
        told = F.concat("_out", _forms(F.slice(rest, F.lit(1), literal)))
        cur = rounds.next(met.select(
            "_id", *shape, "_n", F.when(ends, F.array().cast("array<string>")).otherwise(F.slice(tail, F.lit(2), F.greatest(F.size(tail), F.lit(1)))).alias(rest),
            F.when(ends, F.concat(told, F.repeat(F.lit("/*"), F.size(tail)))).otherwise(F.concat(told, F.when(F.size(tail) > 0, "/*").otherwise(""))).alias("_out")))
        if cur.filter(F.size(rest) > 0).isEmpty():
            break
    return packed_join(keyed, cur.select(F.col("_host").alias("_h"), F.col("_shape").alias("_s"), F.col("_out").alias(out)),
                       [host, "_shape"], ["_h", "_s"], "inner").drop("_shape")


def template_purity(placed: DataFrame, host: str, template: str, bad: str, z: float = 1.96, prior: float = 0.5, strength: float = 2.0) -> DataFrame:
    """(host, template, purity): smoothed share of bad urls per template, for
    labelled and unlabelled templates alike.

    Siblings are the branches below one node, at every level, that have the
    same parts below them.  A branch is merged with its siblings when two
    tests hold: the distribution of all its urls over those parts fits that of
    its siblings (chi-square within ``z`` standard deviations of its mean), and its bad share is within
    ``z`` standard errors of theirs or it has no labelled url.  Templates that
    differ in merged branches only are judged by their pooled counts; without
    any label they keep the prior."""
    own = checkpointed(placed.groupBy(F.col(host).alias("_h"), F.col(template).alias("_t")).agg(
        F.count(F.lit(1)).cast("double").alias("_n"), F.count(bad).cast("double").alias("_k"), F.coalesce(F.sum(F.col(bad).cast("double")), F.lit(0.0)).alias("_b")))
    parts = F.filter(F.split("_t", "/"), lambda p: p != "")
    at = own.withColumn("_p", parts).select("*", F.posexplode("_p").alias("_i", "_seg"))
    place = F.md5(F.concat_ws("/", F.slice("_p", F.lit(1), F.col("_i"))))
    below = F.md5(F.concat_ws("/", F.slice("_p", F.col("_i") + 2, F.size("_p"))))
    at = checkpointed(at.select("_h", "_t", "_i", "_seg", place.alias("_node"), below.alias("_below"), "_n", "_k", "_b"))

    node = ["_h", "_i", "_node"]
    shapes = checkpointed(at.groupBy(*node, "_seg", "_below").agg(*[F.sum(c).alias(c) for c in ("_n", "_k", "_b")]))
    kinds = shapes.groupBy(*node, "_seg").agg(F.concat_ws(":", F.count(F.lit(1)), F.expr("bit_xor(xxhash64(_below))")).alias("_kind"))
    shapes, node = packed_join(shapes, kinds, [*node, "_seg"], [*node, "_seg"], "inner"), [*node, "_kind"]
    pooled = shapes.groupBy(*node, "_below").agg(F.sum("_n").alias("_pn"), F.sum("_k").alias("_pk"), F.sum("_b").alias("_pb"))
    total = pooled.groupBy(*node).agg(F.sum("_pn").alias("_all"), F.sum("_pk").alias("_ak"), F.sum("_pb").alias("_ab"), F.count(F.lit(1)).alias("_kinds"))
    fit = (packed_join(shapes, pooled, [*node, "_below"], [*node, "_below"], "inner").groupBy(*node, "_seg")
           .agg(F.sum("_n").alias("_n"), F.sum("_k").alias("_k"), F.sum("_b").alias("_b"), F.sum(F.col("_n") * F.col("_n") / F.col("_pn")).alias("_sq")))
    fit = packed_join(fit, total.select(*[F.col(c).alias(f"{c}2") for c in node], "_all", "_ak", "_ab", "_kinds"), node, [f"{c}2" for c in node], "inner")
    chi, free = F.col("_sq") * F.col("_all") / F.col("_n") - F.col("_n"), F.col("_kinds") - 1
    alike = chi <= free + z * F.sqrt(2 * free) + 1e-6
    p = F.when(F.col("_ak") > 0, F.col("_ab") / F.col("_ak"))
    share = F.when(F.col("_k") > 0, F.abs(F.col("_b") / F.greatest("_k", F.lit(1.0)) - p) <= z * F.sqrt(p * (1 - p) / F.greatest("_k", F.lit(1.0))) + 1e-12).otherwise(True)
    merged = fit.filter(alike & share).select(*node[:3], "_seg", F.concat(F.lit("/"), "_kind").alias("_name"))  # no segment holds a slash

    named = packed_join(at, merged, [*node[:3], "_seg"], [*node[:3], "_seg"], "left").select("_h", "_t", F.struct("_i", F.coalesce("_name", "_seg").alias("s")).alias("_x"))
    keys = named.groupBy("_h", "_t").agg(F.array_sort(F.collect_list("_x")).alias("_xs"))  # at most one template's segments
    keys = keys.select("_h", "_t", F.concat(F.lit("/"), F.concat_ws("/", F.col("_xs.s"))).alias("_pooled"))
    judged = checkpointed(own.join(keys, ["_h", "_t"], "left").withColumn("_pooled", F.coalesce("_pooled", F.lit(""))))
    pool = judged.groupBy("_h", "_pooled").agg(F.sum("_k").alias("_mk"), F.sum("_b").alias("_mb"))
    both = packed_join(judged, pool.withColumnRenamed("_h", "_h2").withColumnRenamed("_pooled", "_p2"), ["_h", "_pooled"], ["_h2", "_p2"], "inner")
    return both.select("_h", "_t", ((F.col("_mb") + prior * strength) / (F.col("_mk") + strength)).alias("purity"))


def judge_urls(pages: DataFrame, rules: list[Rule], url_col: str = "url", bad: Column | None = None, reject_at: float = 0.9) -> DataFrame:
    """``pages`` with host, path, rule, verdict, template and purity.

    The longest fitting rule decides.  Other urls are blocked when their
    template's smoothed share of bad urls is at least ``reject_at``, else
    allowed; the labels are the rules' own verdicts, and ``bad`` (a boolean
    column, null when unknown) where no rule fits.  A null url, or one
    without ://, has an empty host and path.  Repeated rows are judged alike
    and count one by one; result names replace columns so named; an empty
    table stays empty.  The trees are aggregates with map-side partial sums;
    joins back to the pages can be split when one host holds most rows."""
    names = ["host", "path", "rule", "verdict", "template", "purity"]
    src = pages.drop(*[n for n in names if n != url_col])
    found, label = free_name(src.columns, "_found"), free_name(src.columns, "_bad")
    src = (src.withColumn("host", host_of(F.col(url_col))).withColumn("path", path_of(F.col(url_col))))
    src = src.withColumn(found, rule_of(F.col("host"), F.col("path"), rules))
    known = F.when(F.col(f"{found}.verdict").isNotNull(), F.col(f"{found}.verdict") == "block")
    src = src.withColumn(label, F.coalesce(known, bad) if bad is not None else known)
    placed = checkpointed(path_templates(src, "host", "path", "template"))
    purity = template_purity(placed, "host", "template", label)
    out = packed_join(placed, purity, ["host", "template"], ["_h", "_t"])
    verdict = F.coalesce(F.col(f"{found}.verdict"), F.when(F.col("purity") >= reject_at, "block").otherwise("allow"))
    return out.withColumn("rule", F.col(f"{found}.rule")).withColumn("verdict", verdict).drop(found, label)
