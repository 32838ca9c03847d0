"""Folded streaming logs, exact profiles in two scans, statistics of many tables."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from lakeward.operators import outcomes as oc
from lakeward.operators import stats
from lakeward.streaming import upsert as st

SCHEMA = "entity string, space string, seq int, isCompleted boolean, runtime bigint, extra string"


def _results(spark, n=6):
    return spark.createDataFrame([(f"e{i}", "S", False, None) for i in range(n)] + [(None, None, False, None)],
                                 "entity string, space string, isCompleted boolean, runtime bigint")


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _batch(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _files(path):
    return sum(len([n for n in names if n.endswith(".parquet")]) for _, _, names in os.walk(path))


def test_folds_equal_the_whole_log(spark, scratch):
    rng = random.Random(3)
    res, rows = os.path.join(scratch, "res"), []
    st.init_results(_results(spark), res, SCHEMA)
    for bid in range(9):
        chunk = [(rng.choice([f"e{i}" for i in range(6)] + [None]), rng.choice(["S", "S", None]), rng.randint(0, 9), rng.random() < 0.5,
                  rng.choice([None, rng.randint(0, 3)]), rng.choice("xyz")) for _ in range(20)]  # with ties of the order
        rows += chunk
        st.append_batch(_batch(spark, chunk), res, "a" if bid % 2 else "b", bid // 2)
        if bid in (3, 4, 7):
            st.fold(spark, res, ["seq"])
        if bid == 5:  # replays: a covered batch, whatever it holds, counts once
            st.append_batch(_batch(spark, chunk), res, "a", bid // 2)
        assert _rows(st.current_results(spark, res, ["seq"])) == _rows(oc.upsert_results(_results(spark), _batch(spark, rows), ["seq"]))
    assert st.outcome_log(spark, res).count() < len(rows)


def test_replay_of_a_covered_batch_is_harmless(spark, scratch):
    res = os.path.join(scratch, "res")
    st.init_results(_results(spark), res, SCHEMA)
    rows = [("e3", "S", 1, True, 4, "x")]
    for batch in range(3):
        st.append_batch(_batch(spark, rows), res, "r", batch)
    st.fold(spark, res, ["seq"])
    st.append_batch(_batch(spark, rows), res, "r", 2)
    st.fold(spark, res, ["seq"], older_than_s=0)  # nothing fresh; covered folders go
    st.append_batch(_batch(spark, rows), res, "r", 2)
    assert st.outcome_log(spark, res).count() == 1
    st.append_batch(_batch(spark, [("e3", "S", 2, False, None, "x")]), res, "r", 3)
    cur = {r["entity"]: r["isCompleted"] for r in st.current_results(spark, res, ["seq"]).collect()}
    assert cur["e3"] is False and st.outcome_log(spark, res).count() == 2


def test_a_fold_that_is_cut_off_does_not_count(spark, scratch):
    res = os.path.join(scratch, "res")
    st.init_results(_results(spark), res, SCHEMA)
    st.append_batch(_batch(spark, [("e1", "S", 1, True, 4, "x")]), res, "r", 0)
    st.fold(spark, res, ["seq"])
    (folder,) = os.listdir(os.path.join(res, "folds"))
    os.remove(os.path.join(res, "folds", folder, "covered", "_SUCCESS"))  # as if the driver had died before
    assert st.outcome_log(spark, res).count() == 1
    st.fold(spark, res, ["seq"])
    assert st.outcome_log(spark, res).count() == 1 and len(os.listdir(os.path.join(res, "folds"))) == 2


def test_reads_are_bounded_by_keys(spark, scratch):
    res = os.path.join(scratch, "res")
    st.init_results(_results(spark), res, SCHEMA)
    for bid in range(12):
        st.append_batch(_batch(spark, [("e1", "S", bid, bid % 2 == 0, bid, "x")]), res, "r", bid)
        if bid % 4 == 3:
            st.fold(spark, res, ["seq"], older_than_s=0)
    st.fold(spark, res, ["seq"], older_than_s=0)
    assert st.outcome_log(spark, res).count() == 1
    assert _files(os.path.join(res, "log")) <= 1 and len(os.listdir(os.path.join(res, "folds"))) == 1  # beside the log's columns
    row = st.current_results(spark, res, ["seq"]).filter("entity = 'e1'").first()
    assert (row["isCompleted"], row["runtime"]) == (False, 11)


def test_two_streams_fold_one_store(spark, scratch):
    res = os.path.join(scratch, "res")
    st.init_results(_results(spark), res, SCHEMA)
    rows = {"a": [("e0", "S", 4, True, 1, "x"), ("e3", "S", 1, True, 1, "x")], "b": [("e0", "S", 3, False, None, "x"), ("e3", "S", 2, False, None, "x")]}
    queries = []
    for name, one in rows.items():
        src = os.path.join(scratch, name)
        _batch(spark, one).repartition(2).write.parquet(src)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
        queries.append(st.stream_upsert(stream, res, os.path.join(scratch, "c" + name), fold_every=1, order=["seq"]))
    for q in queries:
        q.awaitTermination()
    assert _rows(st.current_results(spark, res, ["seq"])) == _rows(oc.upsert_results(_results(spark), _batch(spark, rows["a"] + rows["b"]), ["seq"]))
    with pytest.raises(ValueError):
        st.stream_upsert(stream, res, os.path.join(scratch, "d"), fold_every=1)


# --- profiles -------------------------------------------------------------------

def test_exact_profile_takes_as_many_scans_for_any_number_of_columns(spark, scratch):
    path = os.path.join(scratch, "t")
    spark.range(100).select(*[(F.col("id") % (i + 2)).alias(f"c{i}") for i in range(12)]).write.parquet(path)
    df = spark.read.parquet(path)
    for cols in (["c0"], df.columns):
        plan = stats.profile_simple(df, cols)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") == 2
    got = {r["column_name"]: r["distinct_count"] for r in stats.profile_simple(df).collect()}
    assert got == {f"c{i}": i + 2 for i in range(12)}
    mixed = df.select("*", *[F.col(c).cast(t).alias(f"{c}_{t}") for c in df.columns for t in ("string", "double", "boolean", "int")])
    plan = stats.profile_simple(mixed)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 4


def test_distinct_counts_of_odd_values(spark):
    day = dt.datetime(2024, 10, 27, 0, 30)
    rows = [(0.0, b"\xff", "a" * 100, True, day, [1], None), (-0.0, b"\xfe", "a" * 100, None, day, [1], None), (float("nan"), None, "a" * 99 + "b", False, None, [2], None),
            (float("nan"), b"\xff", "", True, day + dt.timedelta(hours=1), None, None), (float("inf"), b"", None, True, day + dt.timedelta(microseconds=1), [1, 2], None)]
    df = spark.createDataFrame(rows, "d double, b binary, s string, t boolean, ts timestamp, a array<int>, n int")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")  # 00:30 and 01:30 UTC are both 02:30 there
    try:
        got = {r["column_name"]: (r["row_count"], r["null_count"], r["distinct_count"]) for r in stats.profile_simple(df).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == {"d": (5, 0, 3), "b": (4, 1, 3), "s": (4, 1, 3), "t": (4, 1, 2), "ts": (4, 1, 3), "a": (4, 1, 3), "n": (0, 5, 0)}
    empty = {r["column_name"]: r["distinct_count"] for r in stats.profile_simple(df.filter("false")).collect()}
    assert set(empty.values()) == {0}


class Killed(BaseException):
    pass


def test_statistics_of_many_tables_are_windowed_and_resumed(spark, scratch, monkeypatch):
    monkeypatch.setattr(stats, "WINDOW", 4)
    store = os.path.join(scratch, "s")
    names = [f"T{i}" for i in range(10)]
    catalog = spark.createDataFrame([(n, True, "RECORD_COUNT") for n in names] + [("S1", True, "SIMPLE"), ("NONE", True, "SIMPLE"), ("OFF", False, "SIMPLE"), ("NEW", True, None)],
                                    "table_name string, statistics_supported boolean, statistics_type string")
    asked, dies = [], [True]

    def tables(name):
        if dies[0] and len(set(asked)) == 6:
            raise Killed
        asked.append(name)
        return None if name in ("T7", "NONE") else spark.range(5)

    with pytest.raises(Killed):
        stats.refresh_profiles(spark, catalog, tables, store, parallelism=1, run="r")
    dies[0], logged = False, set(asked[:4])
    seen = len(asked)
    out = {r["table_name"]: (r["statistics_type"], r["status"]) for r in stats.refresh_profiles(spark, catalog, tables, store, parallelism=1, run="r").collect()}
    assert not set(asked[seen:]) & logged
    want = {n: ("RECORD_COUNT", "failed" if n == "T7" else "refreshed") for n in names} | {"S1": ("SIMPLE", "refreshed"), "NONE": ("SIMPLE", "failed")}
    assert out == want
    stored = {r["table_name"]: r["record_count"] for r in stats.read_profiles(spark, store, "RECORD_COUNT").collect()}
    assert stored == {n: 5 for n in names if n != "T7"}
    again = stats.refresh_profiles(spark, catalog, {n: spark.range(8) for n in names}, store)
    assert again.filter("status = 'refreshed'").count() == 10
    assert {r["record_count"] for r in stats.read_profiles(spark, store, "RECORD_COUNT").collect()} == {8}
