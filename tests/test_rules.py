"""One id rule for J2 and J3, R4 per attribute, CSV dialect, nulls in exports, finite histograms."""

import csv
import os

import pytest

from lakeward import session, sources
from lakeward.operators import lineage, outcomes as oc, stats


def test_every_request_is_resolved_or_not(spark):
    models = spark.createDataFrame([("1", "A", "S", 0), ("1", "B", "S", 1), ("2", "C", "S", 2), ("3", "C", "S", 3)],
                                   "model_id string, name string, space_name string, position int")
    req = spark.createDataFrame([("A", "S"), ("B", "S"), ("C", "S"), ("D", "S")], "modelname string, space string")
    got = sorted((r.model_id, r.name) for r in lineage.resolve_models(req, models).collect())
    lost = sorted(r.modelname for r in lineage.unresolved_models(req, models).collect())
    assert got == [("1", "B"), ("2", "C")] and lost == ["A", "D"]


def test_partition_outcomes_per_attribute(spark):
    tasks = spark.createDataFrame([("V", "S", "a"), ("V", "S", "b")], "entity string, space string, attribute string")
    runs = spark.createDataFrame([("V", "S", "a", "failed", 2), ("V", "S", "b", "created", 1)],
                                 "entity string, space string, attribute string, outcome string, ts int")
    got = {r.attribute: r.createdPartition for r in oc.report_partition_create(tasks, runs, ["ts"]).collect()}
    assert got == {"a": False, "b": True}


ROWS = [(" lead", "trail "), ('q"u', "a,b"), ("two\nlines", "back\\slash"), ("", '""')]


def test_csv_is_read_by_python_and_back(spark, scratch):
    path = os.path.join(scratch, "out")
    df = spark.createDataFrame(ROWS, "entity string, space string").coalesce(1)
    sources.append_results(df, path, "VIEW_PERSIST")
    part = next(f for f in os.listdir(path) if f.startswith("part-"))
    with open(os.path.join(path, part), newline="", encoding="utf-8") as fh:
        assert [tuple(r) for r in csv.reader(fh)][1:] == ROWS
    task = os.path.join(scratch, "in.csv")
    with open(task, "w", newline="", encoding="utf-8") as fh:
        csv.writer(fh, lineterminator="\n").writerows([("entity", "space"), *ROWS])
    assert sorted(tuple(r) for r in sources.scan_tasks(spark, task, "VIEW_PERSIST").collect()) == sorted(ROWS)


def test_nested_export_keeps_nulls_and_one_name(spark, scratch):
    long_form = spark.createDataFrame([("m", "M", "S", "v", "y", None), ("m", "M", "S", "v", "x", None)],
                                      "model_id string, model_name string, model_space string, view_id string, view_name string, view_space string")
    nested = lineage.nested_export(long_form)
    assert nested.first()["dependencies"]["v"]["name"] == "x"
    path = os.path.join(scratch, "nested")
    sources.write_model_export(nested, path)
    assert '"space":null' in "".join(r.value for r in spark.read.text(path).collect())


def test_histogram_counts_finite_values(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)] + [(float("nan"),), (float("inf"),), (float("-inf"),), (None,)], "x double")
    got = stats.profile_histogram(df, bins=2).collect()
    assert sorted((r.bin, r.lower, r.upper, r.row_count) for r in got) == [(0, 0.0, 4.5, 5), (1, 4.5, 9.0, 5)]


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())
