import os

import pytest
from pyspark.sql import functions as F

from lakeward.operators import tables


def _years(spark):
    rows = [(i, str(1998 + i % 5)) for i in range(50)] + [(100, "1990"), (101, None)]
    return spark.createDataFrame(rows, "id int, year string")


def test_partition_summary_counts_empty_ranges_and_rest(spark):
    got = {r["partition"]: r["row_count"] for r in tables.partition_summary(_years(spark), "year", 1997, 2001).collect()}
    assert got == {"1997": 0, "1998": 10, "1999": 10, "2000": 10, "rest": 22}


def test_partition_by_year_exists_and_overwrite(spark, scratch):
    path = os.path.join(scratch, "t")
    df = _years(spark)
    assert tables.partition_by_year(df, "year", 1998, 2001, path) == "created"
    assert tables.stored_partitions(spark, path) == ["1998", "1999", "2000", "rest"]
    assert tables.partition_by_year(df.filter("id < 3"), "year", 1998, 2001, path) == "exists"
    assert tables.read_partitioned(spark, path).count() == 52
    assert tables.partition_by_year(df.filter("id < 3"), "year", 1998, 2001, path, overwrite=True) == "created"
    assert tables.read_partitioned(spark, path).count() == 3


def test_unpartition_keeps_rows(spark, scratch):
    path, out = os.path.join(scratch, "t"), os.path.join(scratch, "flat")
    df = _years(spark)
    tables.partition_by_year(df, "year", 1998, 2003, path)
    assert tables.unpartition(spark, path, out)
    back = spark.read.parquet(out)
    assert sorted(back.columns) == ["id", "year"]
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in df.collect())
    assert not tables.unpartition(spark, os.path.join(scratch, "missing"), out)


def test_repersist_keeps_locked_years(spark, scratch):
    path = os.path.join(scratch, "t")
    df = _years(spark)
    tables.partition_by_year(df, "year", 1998, 2003, path)
    locked = [r["partition"] for r in tables.lock_partitions(tables.year_ranges(spark, 1998, 2003), 1999)
              .filter("locked").collect()]
    assert locked == ["1998", "1999"]
    new = df.filter(F.col("year").isin("1998", "2000")).withColumn("id", F.col("id") + 1000)
    written = tables.repersist(new, path, "year", 1998, 2003, locked)
    assert written == ["2000"]
    back = tables.read_partitioned(spark, path)
    by = {r["partition"]: sorted(x["id"] for x in back.filter(F.col("partition") == r["partition"]).collect())
          for r in back.select("partition").distinct().collect()}
    assert set(by) == {"1998", "1999", "2000"}  # 2001, 2002 and rest vanished and were not locked
    assert all(i < 1000 for i in by["1998"] + by["1999"])  # locked: untouched
    assert all(i >= 1000 for i in by["2000"])


def test_persist_unpersist_and_flag(spark, scratch):
    store = os.path.join(scratch, "store")
    v = spark.range(10).withColumn("x", F.col("id") * 2)
    out = tables.persist(v, "V1", "SP", store).first()
    assert out["success"] and out["run_time_ms"] >= 0
    tables.persist(v, "V2", "SP", store)
    assert tables.read_view(spark, "V1", "SP", store).count() == 10
    assert tables.unpersist(spark, "V1", "SP", store).first()["success"]
    assert not tables.unpersist(spark, "V1", "SP", store).first()["success"]
    views = spark.createDataFrame([("V1", "SP"), ("V2", "SP"), ("V3", "SP")], "entity string, space string")
    got = {r["entity"]: r["isPersisted"] for r in tables.with_persisted_flag(views, spark, store).collect()}
    assert got == {"V1": False, "V2": True, "V3": False}
    assert tables.read_view(spark, "V1", "SP", store) is None


def test_empty_or_uncommitted_folder_is_no_partitioning(spark, scratch):
    path = os.path.join(scratch, "t")
    os.makedirs(os.path.join(path, "_temporary", "0"))
    assert tables.partition_by_year(_years(spark), "year", 1998, 2001, path) == "created"
    assert tables.partition_by_year(_years(spark), "year", 1998, 2001, path) == "exists"


def test_column_named_partition_is_refused(spark, scratch):
    df = _years(spark).withColumn("Partition", F.lit("mine"))
    with pytest.raises(ValueError):
        tables.partition_by_year(df, "year", 1998, 2001, os.path.join(scratch, "t"))
