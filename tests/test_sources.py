import json
import os

from lakeward import sources


def test_scan_tasks_binds_by_position_and_drops_first_line(spark, scratch):
    p = os.path.join(scratch, "tasks.csv")
    with open(p, "w", encoding="utf-8") as fh:
        fh.write("whatever,header,extra\nV1,SP,cut\nV2\n\nV3,\n")
    got = [tuple(r) for r in sources.scan_tasks(spark, p, "VIEW_PERSIST").collect()]
    assert got == [("V1", "SP"), ("V2", ""), ("V3", "")]


def test_append_reset_and_read_results(spark, scratch):
    p = os.path.join(scratch, "res")
    sources.reset_results(spark, p, "VIEW_PERSIST_RESULT")
    assert sources.read_results(spark, p, "VIEW_PERSIST_RESULT").count() == 0
    rows = spark.createDataFrame([("V1", "SP", True, 12, "dropped"), ("V2", "SP", False, None, "x")],
                                 "entity string, space string, isPersisted boolean, runtime bigint, other string")
    sources.append_results(rows, p, "VIEW_PERSIST_RESULT")
    sources.append_results(rows.limit(1), p, "VIEW_PERSIST_RESULT")
    back = sorted(tuple(r) for r in sources.read_results(spark, p, "VIEW_PERSIST_RESULT").collect())
    assert back == [("V1", "SP", True, 12), ("V1", "SP", True, 12), ("V2", "SP", False, None)]


def test_scan_catalog_edges(spark, scratch):
    p = os.path.join(scratch, "edges.jsonl")
    with open(p, "w", encoding="utf-8") as fh:
        fh.write(json.dumps({"m1": {"v1": "View1", "v2": "View2"}}) + "\n")
        fh.write(json.dumps({"m2": {}}) + "\n")
    got = sorted(tuple(r) for r in sources.scan_catalog(spark, p, "edges").collect())
    assert got == [("m1", "v1", "View1"), ("m1", "v2", "View2")]


def test_catalog_kinds_feed_the_operators(spark, scratch):
    from lakeward.operators import search, stats
    views = os.path.join(scratch, "views.jsonl")
    with open(views, "w", encoding="utf-8") as fh:
        fh.write(json.dumps({"id": "v1", "name": "Sales", "space_name": "SP", "business_name": "Sales view",
                             "attributes": ["FISCAL_YEAR", "AMOUNT"]}) + "\n")
    v = sources.scan_catalog(spark, views, "view_attributes", fmt="json")
    got = search.attributes_containing(v, "year", entity="name", space="space_name",
                                       business_name="business_name").collect()
    assert [tuple(r) for r in got] == [("Sales", "SP", "Sales view", "FISCAL_YEAR")]
    tabs = os.path.join(scratch, "tables.jsonl")
    with open(tabs, "w", encoding="utf-8") as fh:
        fh.write(json.dumps({"table_name": "T1", "statistics_supported": True, "statistics_type": None}) + "\n")
    t = sources.scan_catalog(spark, tabs, "tables", fmt="json")
    assert stats.plan_statistics(t, "SIMPLE").first()["action"] == "create"


def test_edges_catalog_roundtrip_splits_big_models(spark, scratch):
    edges = spark.range(250).selectExpr("'m1' AS model_id", "CAST(id AS STRING) AS view_id",
                                        "concat('v', CAST(id AS STRING)) AS view_name")
    p = os.path.join(scratch, "edges")
    sources.write_edges_catalog(edges, p, parts=4)
    with open([os.path.join(p, f) for f in os.listdir(p) if f.startswith("part-") and
               os.path.getsize(os.path.join(p, f)) > 0][0], encoding="utf-8") as fh:
        assert all(len(json.loads(line)["m1"]) < 250 for line in fh)
    back = sources.scan_catalog(spark, p, "edges")
    assert back.count() == 250 and back.select("view_id").distinct().count() == 250


def test_catalog_models_and_views_feed_the_export(spark, scratch):
    from lakeward.operators import lineage
    mp, vp, ep = (os.path.join(scratch, n) for n in ("models.jsonl", "views.jsonl", "edges.jsonl"))
    with open(mp, "w", encoding="utf-8") as fh:
        fh.write(json.dumps({"id": "m1", "name": "Model1", "space_name": "SP"}) + "\n")
        fh.write(json.dumps({"id": "m2", "name": "Model2", "space_name": "SP"}) + "\n")
    with open(vp, "w", encoding="utf-8") as fh:
        fh.write(json.dumps({"id": "v1", "name": "View1", "space_name": "FIRST", "business_name": "b"}) + "\n")
        fh.write(json.dumps({"id": "v1", "name": "View1", "space_name": "SECOND", "business_name": "b"}) + "\n")
    with open(ep, "w", encoding="utf-8") as fh:
        fh.write(json.dumps({"m2": {"v1": "View1"}}) + "\n")
        fh.write(json.dumps({"m1": {"v1": "View1", "v2": "View2"}}) + "\n")
    models = sources.scan_catalog(spark, mp, "models", fmt="json")
    views = sources.scan_catalog(spark, vp, "views", fmt="json")
    edges = sources.scan_catalog(spark, ep, "edges")
    got = sorted((r["model_id"], r["view_id"], r["view_space"])
                 for r in lineage.model_edges(models, edges, views, skip_duplicates=True).collect())
    # m1 comes first in the catalogue, so it keeps v1; the first catalogue row of v1 gives its space
    assert got == [("m1", "v1", "FIRST"), ("m1", "v2", None), ("m2", None, None)]
