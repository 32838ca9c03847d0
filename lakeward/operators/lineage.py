"""Model-to-view lineage: space resolution, first-occurrence de-duplication,
model resolution and the model export (F1, J1-J4, A1, A2).

Column contract
---------------
models : model_id, name, space_name, position   (position = catalogue order)
edges  : model_id, view_id, view_name            (one row per model and view)
views  : view_id, space_name, position           (view catalogue)
requests: modelname, space                       (task rows)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeward.functions.keyed import first_per_key, packed_join, spread


def models_in_space(models: DataFrame, space: str) -> DataFrame:
    """models of one space.  A plain filter, so Catalyst pushes it into
    the scan (parquet row-group skipping, partition pruning)."""
    if space is None or not str(space).strip():
        raise ValueError("space must not be empty")
    return models.filter(F.col("space_name") == F.lit(str(space).strip()))


def unique_models(models: DataFrame) -> DataFrame:
    """Drop repeated model ids, keeping the first in catalogue order.

    The original loop lets a repeated id overwrite its own entry with an
    empty view list; that is an artefact of keying a dict by id, so a
    repeated id is resolved to its first catalogue row instead."""
    return first_per_key(models, ["model_id"], ["position"], ["name", "space_name", "position"])


def first_space_per_view(views: DataFrame) -> DataFrame:
    """One catalogue row per view id: the first by catalogue position."""
    return first_per_key(views, ["view_id"], ["position"], ["space_name"]) \
        .withColumnRenamed("space_name", "view_space")


def map_views_to_spaces(edges: DataFrame, views: DataFrame) -> DataFrame:
    """Attach each view's space (first catalogue match wins).  Views that
    are not in the catalogue keep ``view_space = null`` (unresolved).

    A left equi-join on the packed view id (null-safe, like the original
    comparison); AQE broadcasts the catalogue side only when its measured
    size is under the broadcast threshold, otherwise it stays a sort-merge
    join, and a view shared by very many models is split by the skew-join
    rule."""
    return packed_join(edges, first_space_per_view(views), ["view_id"], ["view_id"], "left", null_safe=True)


MODEL_PARTS = 8  # a view's models are compared in so many parts first


def first_model_per_view(edges: DataFrame, models: DataFrame) -> DataFrame:
    """Keep a view only in the first model (catalogue order) that holds it.

    Returns the kept edges: model_id, view_id, view_name.  Equivalent to the
    original "drop the view if an earlier model already holds it" loop, but
    two aggregates instead of a scan over all earlier models: the first of each
    part of a view's models, then the first of these."""
    return _first_model_per_view(edges, unique_models(models).select("model_id", "position"))


def _first_model_per_view(edges: DataFrame, positions: DataFrame) -> DataFrame:
    ordered = packed_join(edges, positions.withColumnRenamed("model_id", "_m"), ["model_id"], ["_m"], "inner")
    ordered = ordered.withColumn("_part", F.pmod(F.xxhash64("model_id"), F.lit(MODEL_PARTS)))
    order, values = ["position", "model_id"], ["position", "model_id", "view_name"]
    firsts = first_per_key(spread(ordered, "view_id", "_part"), ["view_id", "_part"], order, values)
    return first_per_key(spread(firsts, "view_id"), ["view_id"], order, values).select("model_id", "view_id", "view_name")


def model_edges(models: DataFrame, edges: DataFrame, views: DataFrame,
                skip_duplicates: bool = False, space: str | None = None) -> DataFrame:
    """A1 long form: one row per model and view with the view's space.

    Models (optionally those of one space) with no views -- including models
    emptied by ``skip_duplicates`` -- keep one row with null view columns.
    Columns: model_id, model_name, model_space, view_id, view_name, view_space.
    """
    # The space filter runs on the catalogue rows themselves (as the source
    # filters), so Catalyst pushes it into the scan.
    m = unique_models(models_in_space(models, space) if space is not None else models)
    m = m.select("model_id", F.col("name").alias("model_name"),
                 F.col("space_name").alias("model_space"), "position")
    # Exact repeats of an edge row are dropped, in tasks whose number grows
    # with the edges; one name per (model, view) is the input contract, as the source answers with a map.  Only
    # edges of the selected models take part: a space-filtered export cuts
    # the edges by a semi join before anything else shuffles them.
    e = edges.select("model_id", "view_id", "view_name")
    if space is not None:
        e = packed_join(e, m.select(F.col("model_id").alias("_m")), ["model_id"], ["_m"], "left_semi")
    e = spread(e, "model_id", "view_id").distinct()
    if skip_duplicates:
        e = _first_model_per_view(e, m.select("model_id", "position"))
    resolved = map_views_to_spaces(e, views)
    cols = ["model_id", "model_name", "model_space", "view_id", "view_name", "view_space"]
    # Edges inner-join their model (the edge side can be split by AQE when a
    # model holds a third of all edges); models without any edge are added
    # by an anti join against the distinct model ids of the edges.  A left
    # join from the models would put the hot side on the non-preserved side,
    # which can be neither split nor streamed.
    with_model = packed_join(resolved, m.select(F.col("model_id").alias("_m"), "model_name", "model_space"),
                             ["model_id"], ["_m"], "inner")
    empty = m.join(e.select("model_id").distinct(), "model_id", "left_anti").select(
        "model_id", "model_name", "model_space", F.lit(None).cast(e.schema["view_id"].dataType).alias("view_id"),
        F.lit(None).cast("string").alias("view_name"), F.lit(None).cast("string").alias("view_space"))
    return with_model.select(*cols).unionByName(empty.select(*cols))


def nested_export(long_form: DataFrame, parts: int = 1) -> DataFrame:
    """A1 nested form: ``dependencies: map<view_id, struct<space, name>>``
    (space null when the view is unresolved); a model without views gets one
    record with an empty map.

    Every model is dealt over ``parts`` records (``part``) by a hash of the
    view id, whatever its size; choose ``parts`` so that the largest model's
    views over ``parts`` fit in a record.  Parts without views are left out.
    The long form is the scale path.  A (model, view) named twice keeps the
    smallest name, as a map holds one entry per key."""
    # Rows are dealt by record, so that both aggregates do without another shuffle.
    dealt = spread(long_form.withColumn("part", F.when(F.col("view_id").isNull(), F.lit(0))
                                        .otherwise(F.pmod(F.xxhash64("view_id"), F.lit(int(parts)))).cast("int")), "model_id", "part")
    keyed = dealt.groupBy("model_id", "model_name", "model_space", "part", "view_id").agg(
        F.min(F.struct(F.col("view_name").cast("string").alias("name"), F.col("view_space").cast("string").alias("space"))).alias("_v"))
    entry = F.when(F.col("view_id").isNotNull(),
                   F.struct(F.col("view_id").cast("string").alias("key"),
                            F.struct(F.col("_v.space").alias("space"), F.col("_v.name").alias("name")).alias("value")))
    return keyed.groupBy("model_id", "model_name", "model_space", "part").agg(
        F.map_from_entries(F.collect_list(entry)).alias("dependencies")
    ).select(F.col("model_id"), F.col("model_name").alias("name"), F.col("model_space").alias("space_name"),
             "part", "dependencies")


def last_rows(models: DataFrame) -> DataFrame:
    """One row per model id: name and space of its last catalogue row, at the
    position of its first.  J2 and J3 both look requests up here, so every
    request is either resolved or unresolved."""
    picked = models.groupBy("model_id").agg(F.min("position").alias("position"),
                                            F.max(F.struct("position", "name", "space_name")).alias("_last"))
    return picked.select("model_id", "position", F.col("_last.name").alias("name"), F.col("_last.space_name").alias("space_name"))


def resolve_models(requests: DataFrame, models: DataFrame) -> DataFrame:
    """Requested (modelname, space) pairs resolved to catalogue models.
    A repeated id counts with its last row; the
    first id that matches wins; repeated requests collapse to one model.
    Columns: model_id, name, space_name."""
    firsts = first_per_key(last_rows(models), ["name", "space_name"], ["position"], ["model_id"])
    req = requests.select(F.col("modelname").alias("name"), F.col("space").alias("space_name")).distinct()
    return firsts.join(req, ["name", "space_name"], "left_semi").select("model_id", "name", "space_name")


def unresolved_models(requests: DataFrame, models: DataFrame) -> DataFrame:
    """Requested models that do not exist, with how often each was asked for."""
    cat = last_rows(models).select(F.col("name").alias("modelname"), F.col("space_name").alias("space"))
    return requests.join(cat, ["modelname", "space"], "left_anti") \
        .groupBy("modelname", "space").agg(F.count(F.lit(1)).alias("n_requests"))


def persist_worklist(resolved_edges: DataFrame, unique: bool = False) -> DataFrame:
    """A2: distinct work list (model, view, space, name).  ``unique`` says
    that the rows are distinct already, as ``requested_model_edges`` gives
    them, and saves a shuffle of them all."""
    work = resolved_edges.select("model_id", "view_id", "view_space", "view_name")
    return work if unique else work.distinct()


def requested_model_edges(requests: DataFrame, models: DataFrame, edges: DataFrame, views: DataFrame) -> DataFrame:
    """J2 + J1: the views of every requested model with their spaces, one
    row per (model, view, name).
    Columns: model_id, model_name, view_id, view_name, view_space."""
    resolved = resolve_models(requests, models).select("model_id", F.col("name").alias("model_name"))
    # Distinct edges make the result unique per (model, view): resolved
    # models are unique per id and J1 gives one space per view.
    e = packed_join(spread(edges.select("model_id", "view_id", "view_name"), "model_id", "view_id").distinct(),
                    resolved.withColumnRenamed("model_id", "_m"), ["model_id"], ["_m"], "inner")
    return map_views_to_spaces(e, views).select("model_id", "model_name", "view_id", "view_name", "view_space")
