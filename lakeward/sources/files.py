"""Task/result files and metadata catalogues.

Registered CSV datasets bind columns by position with a fixed schema; the
first line of each file is a header and is dropped whatever its text.
Values stay typed inside Spark and are turned into text only by the CSV
sink: booleans as ``True``/``False``, null as an empty field -- the layout
the original tool writes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeward import schemas
from lakeward.functions.keyed import task_count
from lakeward.operators.tables import path_exists

# --- fixed values: catalogue layouts ---------------------------------------------
CATALOG_SCHEMAS = {
    "models": "id string, name string, space_name string",
    "views": "id string, name string, space_name string, business_name string",
    "view_attributes": "id string, name string, space_name string, business_name string, attributes array<string>",
    "analyser_stats": ("view_id string, position bigint, entity string, space string, businessName string, "
                       "isPersisted boolean, persistencyCandidateScore int"),
    "tables": "table_name string, statistics_supported boolean, statistics_type string",
}
EDGES_JSON_TYPE = "map<string, map<string, string>>"
# quotes are doubled, blanks and line breaks inside a field are kept
DIALECT = {"quote": '"', "escape": '"', "multiLine": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
# --- end of fixed values -----------------------------------------------------------


def scan_tasks(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Read a task CSV of a registered kind.  Columns bind by position
    (the header text is ignored), extra columns are cut, short rows padded;
    empty fields read as empty strings, as the original reader gives them."""
    cols = schemas.columns(kind)
    df = (spark.read.schema(schemas.schema(kind, typed=False)).option("header", True)
          .option("enforceSchema", True).option("mode", "PERMISSIVE").options(**DIALECT).csv(path))
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in cols])


def _to_text(df: DataFrame, kind: str) -> DataFrame:
    out = []
    for c in schemas.columns(kind):
        if c not in df.columns:
            out.append(F.lit(None).cast("string").alias(c))
            continue
        dt = df.schema[c].dataType
        if isinstance(dt, T.BooleanType):
            out.append(F.when(F.col(c), "True").when(~F.col(c), "False").alias(c))
        else:
            out.append(F.col(c).cast("string").alias(c))
    return df.select(*out)


def append_results(df: DataFrame, path: str, kind: str) -> None:
    """S3: append rows to a result/export dataset, writing only its
    registered columns (others dropped, missing ones empty)."""
    _to_text(df, kind).write.mode("append").option("header", True).options(**DIALECT).csv(path)


def reset_results(spark: SparkSession, path: str, kind: str) -> None:
    """Empty a result dataset, keeping its header."""
    (spark.createDataFrame([], schemas.schema(kind, typed=False)).repartition(1)
     .write.mode("overwrite").option("header", True).options(**DIALECT).csv(path))


def read_results(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Read a result dataset back into typed columns."""
    raw = (spark.read.schema(schemas.schema(kind, typed=False)).option("header", True)
           .option("enforceSchema", True).options(**DIALECT).csv(path))
    out = []
    for c in schemas.columns(kind):
        t = schemas.spark_type(c)
        if isinstance(t, T.BooleanType):
            out.append(F.when(F.col(c) == "True", True).when(F.col(c) == "False", False).alias(c))
        elif isinstance(t, T.LongType):
            out.append(F.expr(f"try_cast(`{c}` AS BIGINT)").alias(c))
        else:
            out.append(F.coalesce(F.col(c), F.lit("")).alias(c))
    return raw.select(*out)


def reset_all(spark: SparkSession, root: str) -> None:
    """Set up every registered dataset below ``root``, one folder per kind of
    dataset: task files that exist are kept, results and CSV exports are
    emptied, nested exports get their folder when they are first written."""
    for kind in schemas.DATASETS:
        path = f"{root.rstrip('/')}/{schemas.folder(kind)}/{schemas.file_name(kind)}"
        if schemas.DATASETS[kind][2] is None:
            continue
        if schemas.folder(kind) != schemas.TASKS or not path_exists(spark, path):
            reset_results(spark, path, kind)


def scan_catalog(spark: SparkSession, path: str, kind: str, fmt: str = "parquet", stored_position: bool = False) -> DataFrame:
    """Read a metadata catalogue with a fixed layout.

    Models and views come back in the operators' contract: ``model_id`` /
    ``view_id`` and a ``position`` in catalogue order, which decides "first
    match wins".  ``stored_position=True`` reads it from a column of that
    name, which keeps the order when the files are rewritten.  Otherwise it is
    the row's place: file path and row, which parquet files know by
    themselves; of other formats the start of the file's split and the row
    in the split.

    ``kind="edges"`` reads the model-to-view answer (JSON Lines, one object
    ``{model_id: {view_id: view_name}}`` per line) and flattens it to
    (model_id, view_id, view_name) with two map explodes."""
    if kind == "edges":
        txt = spark.read.text(path)
        m = txt.select(F.explode(F.from_json("value", EDGES_JSON_TYPE)).alias("model_id", "views"))
        return m.select("model_id", F.explode("views").alias("view_id", "view_name"))
    if kind not in CATALOG_SCHEMAS:
        raise ValueError(f"unknown catalogue kind {kind!r}")
    ordered = kind in ("models", "views", "view_attributes")
    reader = spark.read.schema(CATALOG_SCHEMAS[kind] + (", position bigint" if ordered and stored_position else ""))
    df = reader.json(path) if fmt == "json" else reader.format(fmt).load(path)
    if ordered and not stored_position:
        file = F.col("_metadata.file_path").alias("file")
        if fmt == "parquet":
            place = F.struct(file, F.col("_metadata.row_index").alias("row"))
        else:  # ids grow along a split, whichever task reads it
            place = F.struct(file, F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
        df = df.select("*", place.alias("position"))
    return df.withColumnRenamed("id", "model_id" if kind == "models" else "view_id") if ordered else df


def write_edges_catalog(edges: DataFrame, path: str, parts: int = 16) -> None:
    """Write model-to-view edges (model_id, view_id, view_name) in the
    source's answer format: JSON Lines ``{model_id: {view_id: view_name}}``.
    Every model is dealt over ``parts`` lines by a hash of the view id, so a
    hot model is split whatever its size; ``scan_catalog`` reads all lines.
    A (model, view) named twice keeps the smallest name."""
    edges = edges.groupBy("model_id", "view_id").agg(F.min("view_name").alias("view_name"))
    keyed = edges.withColumn("_part", F.pmod(F.xxhash64("view_id"), F.lit(int(parts))))
    lines = keyed.groupBy("model_id", "_part").agg(F.map_from_entries(F.collect_list(
        F.struct(F.col("view_id").cast("string"), F.col("view_name").cast("string")))).alias("views"))
    lines.select(F.to_json(F.create_map(F.col("model_id").cast("string"), F.col("views"))).alias("value")) \
        .write.mode("overwrite").text(path)


def write_model_export(df: DataFrame, path: str, by_space: bool = False) -> None:
    """Write the nested model export as JSON Lines (one record per
    model, or per model part), optionally one folder per space."""
    # nulls are written, and only the spaces in ``df`` are replaced, whatever the session is set to
    w = df.write.mode("overwrite").option("ignoreNullFields", False)
    if by_space:
        w = w.partitionBy("space_name").option("partitionOverwriteMode", "dynamic")
    w.json(path)


def write_model_rows(df: DataFrame, path: str, by_space: bool = False) -> None:
    """S4/S5, long form: one JSON line per model and view, sorted by model and
    view within files that hold ranges of them, so a model of any size is dealt
    over as many files as it needs and nothing is gathered per model.
    Optionally one folder per space (``space_name``)."""
    order = ["model_id", "view_id"]
    n = task_count(df)
    rows = df.repartitionByRange(*order) if n is None else df.repartitionByRange(n, *order)
    w = rows.sortWithinPartitions(*(["space_name"] if by_space else []), *order).write.mode("overwrite").option("ignoreNullFields", False)
    if by_space:
        w = w.partitionBy("space_name").option("partitionOverwriteMode", "dynamic")
    w.json(path)
