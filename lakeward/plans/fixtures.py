"""Metadata roles derived from the synthetic warehouse tables.

The synthetic tables hold no warehouse metadata, so each role the toolkit
works on is *derived* from them with Spark, and grows with the data:

models     supplier x nation: model_id s_suppkey, name s_name, space n_name
edges      distinct (l_suppkey, l_partkey) of lineitem, view name p_name
views      part with p_size <= 40: view_id p_partkey, space p_brand
requests   every (s_name, n_name); again for suppliers with s_acctbal > 5000
           (repeated requests); every (s_name, r_name) (a space that is not
           the model's, so never found)
stats      per l_orderkey (the analysed view) its lines in full-row order;
           score l_quantity
attributes words of documents.text split on a space; entity doc_id, space
           lang, business name source
run log    events: entity user_id, space event_type, order (ts, event_id),
           success k >= 20 of props, run time round(value * 1000) ms
tasks      every customer with every event type: customers without a run
           keep their defaults; the outcomes of a report are all runs
results    (J5, ST1) the tasks of RESULT_TYPES, filled from the runs before
           RUN_WINDOW_END; the other runs are merged in, and those of the
           remaining type have no result row
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeward.functions.keyed import spread

# --- fixed values: fixture parameters --------------------------------------
RUN_WINDOW_END = "2024-01-08 00:00:00"
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
RESULT_TYPES = ["click", "purchase", "signup", "view"]
VIEW_MAX_SIZE = 40
REPEAT_REQUEST_MIN_ACCTBAL = 5000.0
ANALYSER_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
                  "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
RUN_ORDER = ["ts", "event_id"]
PART_RUN_ORDER = ["p_partkey"]
PARTITION_ATTRIBUTE = "ts"
SEARCH_WORD = "the"
MODEL_SPACE = "NATION_1"
STATISTICS_REQUEST = "HISTOGRAM"
PROFILED_TABLES = ["lineitem", "orders", "customer"]
PERSISTED_STATUSES = ["O", "F", "P"]
UNPERSISTED_STATUS = "F"
# --- end of fixed values -----------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def models(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(
        F.col("s_suppkey").alias("model_id"), F.col("s_name").alias("name"),
        F.col("n_name").alias("space_name"), F.col("s_suppkey").alias("position"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    li = spread(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("model_id"), F.col("l_partkey").alias("view_id")),
                "model_id", "view_id").distinct()
    p = table(spark, d, "part").select(F.col("p_partkey").alias("view_id"), F.col("p_name").alias("view_name"))
    return li.join(p, "view_id").select("model_id", "view_id", "view_name")


def views(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").filter(F.col("p_size") <= VIEW_MAX_SIZE).select(
        F.col("p_partkey").alias("view_id"), F.col("p_brand").alias("space_name"),
        F.col("p_partkey").alias("position"))


def requests(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_name", "s_nationkey", "s_acctbal")
    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, d, "region").select("r_regionkey", "r_name")
    sn = s.join(n, s.s_nationkey == n.n_nationkey)
    found = sn.select(F.col("s_name").alias("modelname"), F.col("n_name").alias("space"))
    again = sn.filter(F.col("s_acctbal") > REPEAT_REQUEST_MIN_ACCTBAL) \
        .select(F.col("s_name").alias("modelname"), F.col("n_name").alias("space"))
    wrong = sn.join(r, sn.n_regionkey == r.r_regionkey) \
        .select(F.col("s_name").alias("modelname"), F.col("r_name").alias("space"))
    return found.unionByName(again).unionByName(wrong)


def analyser_stats(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("view_id"), *ANALYSER_ORDER,
        F.col("l_partkey").cast("string").alias("entity"),
        F.col("l_suppkey").cast("string").alias("space"),
        F.concat(F.col("l_returnflag"), F.col("l_linestatus")).alias("businessName"),
        (F.col("l_linestatus") == F.lit("F")).alias("isPersisted"),
        F.col("l_quantity").alias("persistencyCandidateScore"))


def attribute_views(spark: SparkSession, d: str) -> DataFrame:
    doc = table(spark, d, "documents")
    return doc.select(F.col("doc_id").cast("string").alias("entity"), F.col("lang").alias("space"),
                      F.col("source").alias("businessName"), F.split(F.col("text"), " ").alias("attributes"))


def run_log(spark: SparkSession, d: str) -> DataFrame:
    """Every event as a run: key, order, success, run time and the k value
    the outcome words below are derived from."""
    ev = table(spark, d, "events")
    k = F.get_json_object(F.col("props"), "$.k").cast("int")
    return ev.select(F.col("user_id").cast("string").alias("entity"), F.col("event_type").alias("space"),
                     "ts", "event_id", (k >= 20).alias("success"),
                     F.round(F.col("value") * 1000).cast("bigint").alias("run_time_ms"), k.alias("k"))


def early_runs(spark: SparkSession, d: str) -> DataFrame:
    return run_log(spark, d).filter(F.col("ts") < F.lit(RUN_WINDOW_END).cast("timestamp_ntz"))


def later_runs(spark: SparkSession, d: str) -> DataFrame:
    """The other runs, as outcomes of task chains."""
    log = run_log(spark, d).filter(F.col("ts") >= F.lit(RUN_WINDOW_END).cast("timestamp_ntz"))
    return log.select("entity", "space", "ts", "event_id", "k", F.col("success").alias("isCompleted"),
                      F.when(F.col("success"), F.bround(F.col("run_time_ms") / 1000.0, 0).cast("bigint")).alias("runtime"))


def tasks(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("entity"))
    return c.select("entity", F.explode(F.array(*[F.lit(t) for t in EVENT_TYPES])).alias("space"))


def result_tasks(spark: SparkSession, d: str) -> DataFrame:
    return tasks(spark, d).filter(F.col("space").isin(*RESULT_TYPES))


def partition_tasks(spark: SparkSession, d: str) -> DataFrame:
    return tasks(spark, d).withColumn("attribute", F.lit(PARTITION_ATTRIBUTE))


def partition_outcomes(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """Outcome words per run, from the k value of the event."""
    k = F.col("k")
    if kind == "create":
        word = F.when(k < 30, "created").when(k < 60, "exists").otherwise("failed")
    elif kind == "lock":
        word = F.when(k < 40, "locked").when(k < 70, "no_partitions").otherwise("error")
    elif kind == "unlock":
        word = F.when(k < 40, "unlocked").when(k < 70, "no_partitions").otherwise("error")
    else:
        raise ValueError(kind)
    return run_log(spark, d).withColumn("outcome", word)


def part_runs(spark: SparkSession, d: str) -> DataFrame:
    """Persist / unpersist runs of views keyed by (name, space), one per part."""
    p = table(spark, d, "part")
    return p.select(F.col("p_name").alias("name"), F.col("p_brand").alias("space"), "p_partkey",
                    (F.col("p_type") != F.lit("SMALL")).alias("success"),
                    F.when(F.col("p_type") == F.lit("PROMO"), F.lit(None).cast("bigint"))
                    .otherwise(((F.col("p_size") - 10) * 100).cast("bigint")).alias("run_time_ms"),
                    (F.col("p_size") <= 45).alias("unpersist_success"), "p_type")


def persisted_views(spark: SparkSession, d: str) -> DataFrame:
    return part_runs(spark, d).filter(F.col("p_type") == F.lit("ECONOMY")).select("name", "space")


def persist_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return part_runs(spark, d).select("name", "space", "p_partkey", "success", "run_time_ms")


def unpersist_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return part_runs(spark, d).select("name", "space", "p_partkey", F.col("unpersist_success").alias("success"))


def statistics_catalog(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    t = F.col("p_type")
    stype = (F.when(t.isin("ECONOMY", "STANDARD"), F.lit(None).cast("string"))
             .when(t == "SMALL", "SIMPLE").when(t == "LARGE", "RECORD_COUNT").otherwise("HISTOGRAM"))
    return p.select(F.concat(F.lit("T"), F.col("p_partkey").cast("string")).alias("table_name"),
                    (F.col("p_size") <= 45).alias("statistics_supported"), stype.alias("statistics_type"))
