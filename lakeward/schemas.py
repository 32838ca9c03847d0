"""Registry of task, result and export datasets.

Fixed values: dataset keys, file names and column lists must stay exactly as
below so files written by this toolkit are interchangeable with the ones the
original tool reads and writes.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
TASKS = "tasks"
RESULTS = "results"
EXPORTS = "exports"

DATASETS = {
    "TASK_CHAIN_RUN": (TASKS, "task_chains_to_run.csv", ["entity", "space"]),
    "TASK_CHAIN_RUN_RESULT": (RESULTS, "task_chains_completed.csv", ["entity", "space", "isCompleted", "runtime"]),
    "VIEW_ANALYSE": (EXPORTS, "best_views_to_persist.csv", ["entity", "space", "businessName", "isPersisted"]),
    "VIEW_ATTRIBUTE": (EXPORTS, "view_attributes.csv", ["entity", "space", "businessName", "attribute"]),
    "VIEW_PARTITIONING_CREATE": (TASKS, "views_to_create_partitions.csv", ["entity", "space", "attribute"]),
    "VIEW_PARTITIONING_CREATE_RESULT": (RESULTS, "views_partitions_created.csv", ["entity", "space", "attribute", "createdPartition"]),
    "VIEW_PARTITIONING_DELETE": (TASKS, "views_to_delete_partitions.csv", ["entity", "space"]),
    "VIEW_PARTITIONING_DELETE_RESULT": (RESULTS, "views_partitions_deleted.csv", ["entity", "space", "removedPartition"]),
    "VIEW_PERSIST": (TASKS, "views_to_persist.csv", ["entity", "space"]),
    "VIEW_PERSIST_RESULT": (RESULTS, "views_persisted.csv", ["entity", "space", "isPersisted", "runtime"]),
    "VIEW_UNPERSIST": (TASKS, "views_to_unpersist.csv", ["entity", "space"]),
    "VIEW_UNPERSIST_RESULT": (RESULTS, "views_unpersisted.csv", ["entity", "space", "isRemoved"]),
    "VIEW_PARTITION_LOCK": (TASKS, "views_to_lock_partitions.csv", ["entity", "space"]),
    "VIEW_PARTITION_LOCK_RESULT": (RESULTS, "views_partitions_locked.csv", ["entity", "space", "lockedPartitions"]),
    "VIEW_PARTITION_UNLOCK": (TASKS, "views_to_unlock_partitions.csv", ["entity", "space"]),
    "VIEW_PARTITION_UNLOCK_RESULT": (RESULTS, "views_partitions_unlocked.csv", ["entity", "space", "unlockedPartitions"]),
    "ANALYTICAL_MODELS_ALL_VIEWS": (EXPORTS, "analytical_models_with_all_views.json", None),
    "ANALYTICAL_MODELS_ALL_VIEWS_IN_SPACE": (EXPORTS, "analytical_models_with_all_views_in_space.json", None),
    "ANALYTICAL_MODELS_ALL_VIEWS_PERSISTENCE_TIME": (TASKS, "analytical_models_to_check_view_persistence_time.csv", ["modelname", "space"]),
    "ANALYTICAL_MODELS_ALL_VIEWS_PERSISTENCE_TIME_RESULT": (EXPORTS, "analytical_models_with_all_views_and_persistence_time.json", None),
}

# Typed columns (everything else in a registered CSV is a string).
BOOLEAN_COLUMNS = {"isCompleted", "isPersisted", "createdPartition", "removedPartition",
                   "isRemoved", "lockedPartitions", "unlockedPartitions"}
LONG_COLUMNS = {"runtime"}
# --- end of fixed values -----------------------------------------------------


def columns(kind: str) -> list[str]:
    cols = DATASETS[kind][2]
    if cols is None:
        raise ValueError(f"{kind} is a nested JSON export and has no column list")
    return list(cols)


def file_name(kind: str) -> str:
    return DATASETS[kind][1]


def folder(kind: str) -> str:
    return DATASETS[kind][0]


def spark_type(col: str) -> T.DataType:
    if col in BOOLEAN_COLUMNS:
        return T.BooleanType()
    if col in LONG_COLUMNS:
        return T.LongType()
    return T.StringType()


def schema(kind: str, typed: bool = True) -> T.StructType:
    """Spark schema of a registered CSV dataset.

    ``typed=False`` gives the all-string layout the CSV files carry on disk.
    """
    return T.StructType([
        T.StructField(c, spark_type(c) if typed else T.StringType(), True) for c in columns(kind)
    ])


# Nested export layouts.
DEPENDENCY = T.StructType([
    T.StructField("space", T.StringType(), True),
    T.StructField("name", T.StringType(), True),
])

RUNTIME_DEPENDENCY = T.StructType([
    T.StructField("space", T.StringType(), True),
    T.StructField("name", T.StringType(), True),
    T.StructField("runtime", T.LongType(), True),
    T.StructField("alreadyPersisted", T.BooleanType(), False),
    T.StructField("removedPersistence", T.BooleanType(), False),
])
