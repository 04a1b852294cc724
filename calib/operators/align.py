"""From sampled and reference curves to training tables.

Curves are long: (sample_id, system_index, qoi, label, bin, value); the
reference has the same columns without ``sample_id``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calib.operators.ordering import attach, number_rows

CELL = ["qoi", "system_index", "label", "bin"]


def qualify_labels(curves: DataFrame) -> DataFrame:
    """``window-000:label`` where a QoI has more than one system block."""
    blocks = curves.groupBy("qoi").agg(F.count_distinct("system_index").alias("__blocks"))
    named = F.format_string("window-%03d:%s", F.col("system_index"), F.col("label"))
    return attach(curves, blocks, ["qoi"]).withColumn(
        "label", F.when(F.col("__blocks") > 1, named).otherwise(F.col("label"))).drop("__blocks")


def with_position(curves: DataFrame, reference: DataFrame) -> DataFrame:
    """Add ``pos``: place in the vector of all systems, then labels, then bins.

    The layout (systems and labels in sorted order, bins per label) is the reference's.
    """
    dims = reference.groupBy("qoi").agg(
        F.count_distinct("label").alias("__labels"), (F.max("bin") + 1).alias("__bins"))
    systems = number_rows(reference.select("qoi", "system_index").distinct(), ["qoi"],
                          ["system_index"], "__s")
    labels = number_rows(reference.select("qoi", "label").distinct(), ["qoi"], ["label"], "__l")
    rows = attach(attach(attach(curves, dims, ["qoi"]), systems, ["qoi", "system_index"]),
                  labels, ["qoi", "label"])
    pos = (((F.col("__s") - 1) * F.col("__labels") + F.col("__l") - 1) * F.col("__bins")
           + F.col("bin"))
    return rows.withColumn("pos", pos.cast("long")).drop("__labels", "__bins", "__s", "__l")


def stack_vectors(curves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One vector per key and QoI, ordered by ``pos``; vectors are of curve length."""
    cells = F.array_sort(F.collect_list(F.struct("pos", "value")))
    return curves.groupBy(*keys, "qoi").agg(cells.alias("c")).select(
        *keys, "qoi", F.col("c.value").alias("values"))


def align(samples: DataFrame, reference: DataFrame) -> DataFrame:
    """Sample values next to reference values.

    QoIs and systems without a reference are not used; a cell that the reference lacks in one
    that it has is an error.  ``schema_mismatches`` lists what samples lack.
    """
    block = ["qoi", "system_index"]
    used = attach(samples, reference.select(*block).distinct(), block, "inner")
    ref = reference.select(*CELL, F.col("value").alias("reference"), F.lit(True).alias("__met"))
    lost = F.raise_error(F.concat_ws(" ", F.lit("no reference for"), *[F.col(c).cast("string") for c in CELL]))
    met = F.when(F.col("__met"), F.col("reference")).otherwise(lost.cast("double"))
    return attach(used, ref, CELL).withColumn("reference", met).drop("__met")


def schema_mismatches(samples: DataFrame, reference: DataFrame) -> DataFrame:
    """Samples whose blocks differ from the reference's: missing or extra cells.

    Only systems and QoIs of the reference are looked at.
    """
    blocks = reference.select("qoi", "system_index").distinct()
    wanted = reference.groupBy("qoi").agg(F.count(F.lit(1)).alias("expected"))
    ref = reference.select(*CELL, F.lit(1).alias("__known"))
    used = samples.join(blocks, ["qoi", "system_index"], "left_semi")
    seen = attach(used, ref, CELL).groupBy("sample_id", "qoi").agg(
        F.count("__known").alias("matched"),
        F.count_if(F.col("__known").isNull()).alias("extra"))
    rows = attach(seen, wanted, ["qoi"])
    return rows.where((F.col("matched") != F.col("expected")) | (F.col("extra") > 0)).select(
        "sample_id", "qoi", "expected", "matched", "extra")


def label_orders(curves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Labels of each key joined in order, to compare block schemas as text."""
    first = curves.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"))
    return first.groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_list(
            F.concat("label", F.lit(":"), F.col("n").cast("string")))), ",").alias("layout"))


def training_table(params: DataFrame, train_y: DataFrame, key: str = "sample_id") -> DataFrame:
    """Parameters joined to outputs by sample."""
    return train_y.join(params, key)


def models_to_fit(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """QoIs without a stored model; a stored one of another size is an error."""
    sized = wanted.join(stored.select("qoi", F.col("size").alias("__stored")), "qoi", "left")
    clash = F.col("__stored").isNotNull() & (F.col("__stored") != F.col("size"))
    keep = F.when(clash, F.raise_error(F.concat(
        F.lit("stored model does not match the reference size: "), "qoi")).cast("boolean")
    ).otherwise(F.col("__stored").isNull())
    return sized.where(keep).drop("__stored")


def reused_models(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    return stored.join(wanted.select("qoi", "size"), ["qoi", "size"], "left_semi")


def shape_violations(qoi: DataFrame, params: DataFrame, reference: DataFrame) -> DataFrame:
    """(qoi, sample_id, issue): size against the reference, missing inputs or outputs."""
    widths = reference.groupBy("qoi").agg(F.count(F.lit(1)).alias("__width"))
    sizes = qoi.groupBy("qoi", "sample_id").agg(
        F.count(F.lit(1)).alias("__size"), F.count_distinct("label").alias("__labels"))
    judged = attach(sizes, widths, ["qoi"])
    issue = (F.when(F.col("__width").isNull(), "no reference")
             .when(F.col("__size") != F.col("__width"), "width differs from the reference")
             .when(F.pmod("__size", "__labels") != 0, "size is not labels times values"))
    shapes = judged.withColumn("issue", issue).where(F.col("issue").isNotNull()).select(
        "qoi", "sample_id", "issue")
    no_input = sizes.join(params.select("sample_id"), "sample_id", "left_anti").select(
        "qoi", "sample_id", F.lit("no parameters").alias("issue"))
    no_output = params.join(sizes, "sample_id", "left_anti").select(
        F.lit(None).cast("string").alias("qoi"), "sample_id", F.lit("no outputs").alias("issue"))
    return shapes.unionByName(no_input).unionByName(no_output)


def learning_violations(models: DataFrame, n_params: int) -> DataFrame:
    """Models that cannot be learned together: (qoi, issue).

    ``models``: qoi, n_inputs, size, n_curves.
    """
    issue = (F.when(F.col("n_inputs") != n_params, "number of inputs differs")
             .when(F.col("n_curves") < 1, "no curves")
             .when(F.pmod("size", "n_curves") != 0, "size is not a multiple of the curves"))
    return models.withColumn("issue", issue).where(F.col("issue").isNotNull()).select(
        "qoi", "issue")


def require_models(models: DataFrame, n_params: int) -> DataFrame:
    """``models`` unchanged, or an error naming the first problems."""
    if models.isEmpty():
        raise ValueError("at least one model is needed")
    problems = learning_violations(models, n_params).limit(20).collect()
    if problems:
        raise ValueError("; ".join(f"{r['qoi']}: {r['issue']}" for r in problems))
    return models


def shared_settings(settings: DataFrame) -> DataFrame:
    """One settings text per QoI when all blocks agree, else all of them by block.

    ``settings``: qoi, system_index, settings (JSON text).
    """
    distinct = settings.groupBy("qoi").agg(
        F.count_distinct("settings").alias("__kinds"),
        F.min("settings").alias("__one"),
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(
            F.format_string("%03d", "system_index"), "settings"))))).alias("__all"))
    same = F.col("__kinds") == 1
    return distinct.select("qoi", same.alias("shared"),
                           F.when(same, F.col("__one")).alias("settings"),
                           F.when(~same, F.col("__all")).alias("settings_by_block"))
