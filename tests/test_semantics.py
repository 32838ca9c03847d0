"""Edge cases and seeded random comparisons against naive restatements of
the original loops."""

import random

import pytest
from pyspark.sql import functions as F

from lakeward.functions import scalars
from lakeward.operators import lineage, outcomes as oc, search


def test_ms_to_seconds_rounds_half_to_even(spark):
    df = spark.createDataFrame([(500,), (1500,), (2500,), (65432,), (0,), (-1000,), (499,)], "ms bigint")
    got = [r[0] for r in df.select(scalars.ms_to_seconds("ms")).collect()]
    assert got == [round(x / 1000) for x in (500, 1500, 2500, 65432, 0, -1000, 499)]


@pytest.mark.parametrize("kind,success,ms,timer,expected", [
    ("persist", True, 12000, True, 12), ("persist", True, 12000, False, None),
    ("persist", True, 400, True, None), ("persist", True, None, True, None), ("persist", False, 9000, True, None),
    ("task_chain", True, 400, True, 0), ("task_chain", True, None, True, 0), ("task_chain", False, 9000, True, None),
    ("model_runtime", True, None, True, None), ("model_runtime", True, 1500, True, 2),
    ("model_runtime", True, 500, True, None), ("model_runtime", None, 5000, True, None),
])
def test_runtime_rules(spark, kind, success, ms, timer, expected):
    df = spark.createDataFrame([(success, ms)], "success boolean, ms bigint")
    assert df.select(scalars.runtime_rule(kind, "success", "ms", timer)).first()[0] == expected


def test_contains_is_literal_and_case_insensitive(spark):
    views = spark.createDataFrame([("v", "S", "B", ["FISCAL_YEAR", "year", "YEAR%", "yeXr", "a_b"])],
                                  "entity string, space string, businessName string, attributes array<string>")
    got = sorted(r["attribute"] for r in search.attributes_containing(views, " Year ").collect())
    assert got == ["FISCAL_YEAR", "YEAR%", "year"]
    assert [r["attribute"] for r in search.attributes_containing(views, "_").collect()] == ["FISCAL_YEAR", "a_b"]
    assert search.attributes_containing(views, "%").count() == 1
    with pytest.raises(ValueError):
        search.attributes_containing(views, "   ")


def test_year_bounds_and_partition_expression(spark):
    assert scalars.year_bounds(2000, 2003) == ["2000", "2001", "2002", "2003"]
    assert scalars.year_bounds(2003, 2000) == []
    vals = ["1999", "2000", "2000a", "2001", "2002", "2003", "200", None, "20015"]
    df = spark.createDataFrame([(v,) for v in vals], "y string")
    got = [r[0] for r in df.select(scalars.year_partition("y", 2000, 2003, "rest")).collect()]
    # Half-open string ranges >= y AND < y+1, everything else in 'rest'.
    assert got == ["rest", "2000", "2000", "2001", "2002", "rest", "rest", "rest", "2001"]


def _naive_skip_duplicates(models, edges):
    """The original loop: per model in order, drop views an earlier model holds."""
    collected = {}
    for mid in models:
        deps = dict(edges.get(mid, {}))
        for v in list(deps):
            for saved in collected:
                if v in collected[saved]:
                    deps.pop(v)
                    break
        collected[mid] = deps
    return {(m, v, n) for m, deps in collected.items() for v, n in deps.items()}


def test_first_model_per_view_matches_loop(spark):
    rng = random.Random(7)
    m_rows, e_rows, expected = [], [], set()
    for case in range(120):
        n_models, n_views = rng.randint(1, 6), rng.randint(1, 8)
        order = [f"{case}:m{i}" for i in range(n_models)]
        rng.shuffle(order)
        edges = {}
        for pos, mid in enumerate(order):
            m_rows.append((mid, mid, "S", case * 100 + pos))
            vs = rng.sample(range(n_views), rng.randint(0, n_views))
            edges[mid] = {f"{case}:v{v}": f"name{v}-{mid}" for v in vs}
            e_rows += [(mid, v, n) for v, n in edges[mid].items()]
        expected |= _naive_skip_duplicates(order, edges)
    models = spark.createDataFrame(m_rows, "model_id string, name string, space_name string, position int")
    edges_df = spark.createDataFrame(e_rows, "model_id string, view_id string, view_name string")
    got = {tuple(r) for r in lineage.first_model_per_view(edges_df, models).collect()}
    assert got == expected
    # Models emptied by the de-duplication stay in the export with no view.
    lf = lineage.model_edges(models, edges_df, spark.createDataFrame([], "view_id string, space_name string, position int"),
                             skip_duplicates=True)
    assert lf.select("model_id").distinct().count() == len(m_rows)


def test_view_space_first_catalogue_match(spark):
    edges = spark.createDataFrame([("m", "v1", "n1"), ("m", "v2", "n2")], "model_id string, view_id string, view_name string")
    views = spark.createDataFrame([("v1", "B", 5), ("v1", "A", 9), ("v1", "C", 7)], "view_id string, space_name string, position int")
    got = {r["view_id"]: r["view_space"] for r in lineage.map_views_to_spaces(edges, views).collect()}
    assert got == {"v1": "B", "v2": None}


def test_repeated_model_ids_count_with_their_last_row(spark):
    models = spark.createDataFrame([("m1", "A", "S", 0), ("m1", "B", "S", 1), ("m2", "A", "S", 2)],
                                   "model_id string, name string, space_name string, position int")
    req = spark.createDataFrame([("A", "S"), ("A", "S"), ("Z", "S")], "modelname string, space string")
    assert [tuple(r) for r in lineage.resolve_models(req, models).collect()] == [("m2", "A", "S")]
    assert [tuple(r) for r in lineage.unresolved_models(req, models).collect()] == [("Z", "S", 1)]


def _naive_upsert(results, outcomes, cols):
    rows = [dict(r) for r in results]
    for o in outcomes:  # in arrival order
        for row in rows:
            if row["entity"] == o["entity"] and row["space"] == o["space"]:
                for k, v in o.items():
                    if k in cols:
                        row[k] = v
    return sorted(tuple(r[c] for c in ["entity", "space", *cols]) for r in rows)


def test_upsert_matches_loop(spark):
    rng = random.Random(11)
    keys = [(f"e{i}", rng.choice(["S", "T", None])) for i in range(30)]
    results = [{"entity": e, "space": s, "isPersisted": False, "runtime": None}
               for e, s in keys for _ in range(rng.randint(1, 2))]
    outcomes = []
    for seq in range(200):
        e, s = rng.choice(keys + [("ghost", "S")])
        outcomes.append({"entity": e, "space": s, "seq": seq, "isPersisted": rng.random() < 0.5,
                         "runtime": rng.choice([None, rng.randint(0, 99)]), "extra": "x"})
    res_df = spark.createDataFrame([(r["entity"], r["space"], r["isPersisted"], r["runtime"]) for r in results],
                                   "entity string, space string, isPersisted boolean, runtime bigint")
    out_df = spark.createDataFrame([(o["entity"], o["space"], o["seq"], o["isPersisted"], o["runtime"], o["extra"])
                                    for o in outcomes],
                                   "entity string, space string, seq int, isPersisted boolean, runtime bigint, extra string")
    got = oc.upsert_results(res_df, out_df, ["seq"])
    assert got.columns == ["entity", "space", "isPersisted", "runtime"]
    cols = ["isPersisted", "runtime"]
    assert sorted(tuple(r) for r in got.collect()) == _naive_upsert(results, outcomes, cols)


def test_reports_keep_duplicate_tasks_and_null_keys(spark):
    tasks = spark.createDataFrame([("A", None), ("A", None), ("B", "S")], "entity string, space string")
    runs = spark.createDataFrame([("A", None, 1, True, 3000), ("A", None, 2, False, 100)],
                                 "entity string, space string, seq int, success boolean, run_time_ms bigint")
    got = sorted((r[0], r[1], r[2], r[3]) for r in oc.report_persist(tasks, runs, ["seq"]).collect()
                 if r[0] is not None)
    assert got == [("A", None, False, None), ("A", None, False, None), ("B", "S", False, None)]


def test_lock_with_null_outcome_is_kept_false(spark):
    tasks = spark.createDataFrame([("A", "S"), ("B", "S")], "entity string, space string")
    runs = spark.createDataFrame([("A", "S", 1, None), ("B", "S", 1, "unlocked")],
                                 "entity string, space string, seq int, outcome string")
    assert sorted(tuple(r) for r in oc.report_lock(tasks, runs, ["seq"]).collect()) == [("A", "S", False), ("B", "S", False)]
    assert sorted(tuple(r) for r in oc.report_unlock(tasks, runs, ["seq"]).collect()) == [("A", "S", False), ("B", "S", True)]


def test_partition_create_counts_exists_as_created(spark):
    tasks = spark.createDataFrame([("A", "S", "YEAR"), ("B", "S", "YEAR"), ("C", "S", "YEAR"), ("D", "S", "YEAR")],
                                  "entity string, space string, attribute string")
    runs = spark.createDataFrame([("A", "S", 1, "created"), ("B", "S", 1, "exists"), ("C", "S", 1, "failed")],
                                 "entity string, space string, seq int, outcome string")
    got = sorted(tuple(r) for r in oc.report_partition_create(tasks, runs, ["seq"]).collect())
    assert got == [("A", "S", "YEAR", True), ("B", "S", "YEAR", True), ("C", "S", "YEAR", False)]


def test_runtime_report_rules(spark):
    models = spark.createDataFrame([("m1", "M1", "SP", 0), ("m2", "M2", "SP", 1)],
                                   "model_id string, name string, space_name string, position int")
    edges = spark.createDataFrame([("m1", "v1", "V1"), ("m1", "v2", "V2"), ("m2", "v1", "V1"), ("m1", "v3", "V3")],
                                  "model_id string, view_id string, view_name string")
    views = spark.createDataFrame([("v1", "S", 0), ("v2", "S", 1)], "view_id string, space_name string, position int")
    req = spark.createDataFrame([("M1", "SP"), ("M2", "SP"), ("nope", "SP")], "modelname string, space string")
    persisted = spark.createDataFrame([("V2", "S")], "name string, space string")
    p_runs = spark.createDataFrame([("V1", "S", 1, False, 7000), ("V1", "S", 2, True, 65432), ("V2", "S", 1, True, 400),
                                    ("V3", None, 1, True, 9000)],
                                   "name string, space string, seq int, success boolean, run_time_ms bigint")
    u_runs = spark.createDataFrame([("V1", "S", 3, True)], "name string, space string, seq int, success boolean")
    rep = oc.runtime_report(req, models, edges, views, persisted, p_runs, u_runs, ["seq"])
    got = {(r["model_id"], r["view_id"]): (r["view_space"], r["runtime"], r["alreadyPersisted"], r["removedPersistence"])
           for r in rep.collect()}
    assert got == {
        ("m1", "v1"): ("S", 65, False, True),
        ("m2", "v1"): ("S", 65, False, True),   # one measurement fanned out to both models
        ("m1", "v2"): ("S", None, True, False),  # 0 s is reported as null; was persisted before
        ("m1", "v3"): (None, None, False, False),  # unresolved view never matches a run
    }
    nested = oc.runtime_report_nested(rep).filter(F.col("model_id") == "m1").first()
    assert nested["dependencies"]["v1"]["runtime"] == 65


def test_create_statistics_outcomes(spark, scratch):
    from lakeward.operators import stats
    cat = spark.createDataFrame([("A", True, None), ("B", True, "SIMPLE"), ("C", True, "RECORD_COUNT"),
                                 ("D", False, None), ("GONE", True, None)],
                                "table_name string, statistics_supported boolean, statistics_type string")
    t = {n: spark.range(5) for n in "ABCD"}
    got = {r["table_name"]: (r["action"], r["status"])
           for r in stats.create_statistics(spark, cat, "RECORD_COUNT", t, scratch).collect()}
    assert got == {"A": ("create", "created"), "B": ("update", "updated"), "C": ("skip", "skipped"),
                   "D": ("skip", "skipped"), "GONE": ("create", "failed")}
    stored = {r["table_name"]: r["record_count"] for r in stats.read_profiles(spark, scratch, "RECORD_COUNT").collect()}
    assert stored == {"A": 5, "B": 5}


def test_histogram_constant_column_and_nulls(spark):
    from lakeward.operators import stats
    df = spark.createDataFrame([(1.0, None), (1.0, 2.0), (None, 4.0), (1.0, 3.0)], "a double, b double")
    got = {(r["column_name"], r["bin"]): r["row_count"] for r in stats.profile_histogram(df, ["a", "b"], 2).collect()}
    assert got == {("a", 0): 3, ("a", 1): 0, ("b", 0): 1, ("b", 1): 2}


def test_model_without_views_gets_empty_map(spark):
    models = spark.createDataFrame([("m1", "M", "S", 0)], "model_id string, name string, space_name string, position int")
    edges = spark.createDataFrame([], "model_id string, view_id string, view_name string")
    views = spark.createDataFrame([], "view_id string, space_name string, position int")
    row = lineage.nested_export(lineage.model_edges(models, edges, views)).first()
    assert row["dependencies"] == {}


def test_missing_score_counts_as_zero(spark):
    stats_df = spark.createDataFrame([("v", 0, "A", None), ("v", 1, "B", 0), ("w", 0, "C", None), ("x", 0, "D", 4)],
                                     "view_id string, position int, entity string, persistencyCandidateScore int") \
        .withColumn("space", F.lit("S")).withColumn("businessName", F.lit("b")).withColumn("isPersisted", F.lit(False))
    got = {r["view_id"]: r["entity"] for r in
           search.best_persistence_candidates(stats_df, ["view_id"], ["position"], score=0).collect()}
    assert got == {"v": "A", "w": "C"}


def test_profile_simple_exact_and_approx(spark):
    from lakeward.operators import stats
    df = spark.range(0, 20000).select((F.col("id") % 1000).alias("a"), F.when(F.col("id") % 4 == 0, None)
                                      .otherwise(F.col("id").cast("string")).alias("b"))
    exact = {r["column_name"]: r for r in stats.profile_simple(df).collect()}
    assert (exact["a"]["row_count"], exact["a"]["null_count"], exact["a"]["distinct_count"]) == (20000, 0, 1000)
    assert (exact["b"]["null_count"], exact["b"]["distinct_count"]) == (5000, 15000)
    assert (exact["a"]["min_value"], exact["a"]["max_value"]) == ("0", "999")
    approx = {r["column_name"]: r["distinct_count"] for r in stats.profile_simple(df, approx=True).collect()}
    # HyperLogLog++ default relative standard deviation is 5%: allow 3 sigma
    assert abs(approx["a"] - 1000) <= 150 and abs(approx["b"] - 15000) <= 2250
