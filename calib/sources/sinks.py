"""Writers for frames, datasets, summaries, draws and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calib.functions.expr import fixed4, general


def extxyz_text(frames: DataFrame, keep: Sequence[str] = ("path",)) -> DataFrame:
    """(keep..., value): each frame as extended XYZ text."""
    forced = F.exists("atoms", lambda a: a["fx"].isNotNull())
    number = lambda c: general(c, 12)

    def line(a: Column) -> Column:
        xyz = F.concat_ws(" ", a["symbol"], *[number(a[k]) for k in ("x", "y", "z")])
        return F.when(F.col("__forced"), F.concat_ws(
            " ", xyz, *[number(a[k]) for k in ("fx", "fy", "fz")])).otherwise(xyz)

    cell = F.concat(F.lit('Lattice="'), F.array_join(F.transform("lattice", fixed4), " "),
                    F.lit('" pbc="'), F.coalesce("pbc", F.lit("T T T")), F.lit('"'))
    head = F.concat_ws(
        " ", F.when(F.col("lattice").isNotNull(), cell),
        F.when(F.col("__forced"), "Properties=species:S:1:pos:R:3:forces:R:3").otherwise(
            "Properties=species:S:1:pos:R:3"),
        F.when(F.col("energy").isNotNull(), F.concat(F.lit("energy="), general(F.col("energy"), 16))),
        F.when(F.col("source").isNotNull(), F.concat(F.lit('source="'), "source", F.lit('"'))))
    text = F.concat_ws("\n", F.size("atoms").cast("string"), head,
                       F.array_join(F.transform("atoms", line), "\n"))
    return frames.withColumn("__forced", forced).select(*keep, text.alias("value"))


def write_extxyz(frames: DataFrame, path: str, mode: str = "errorifexists") -> None:
    extxyz_text(frames, ()).write.mode(mode).text(path)


def write_trajectories(frames: DataFrame, path: str, by: str, order: str, parts: int | None = None,
                       mode: str = "errorifexists") -> None:
    """Frames as extended XYZ files in one folder per value of ``by``, in the order of ``order``."""
    write_texts(extxyz_text(frames, [by, order]), path, by, order, parts, mode)


PART_ROWS = 200_000


def write_texts(texts: DataFrame, path: str, by: str, order: str, parts: int | None = None,
                mode: str = "errorifexists") -> None:
    """Texts (``by``, ``order``, value) in one folder per value of ``by``, in the order of ``order``.

    Texts are range partitioned, so a long folder has several files; read by name, they
    follow one another (``lines.folder_lines``).  A task orders about ``PART_ROWS`` texts,
    however many there are.  Files appear when their task, and the folder when the job, is
    committed; a failed write leaves none.
    """
    keys = [F.col(by), F.col(order)]
    if parts is None:
        # A given number is kept; partitions joined by their compressed size would be too large.
        parts = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                    -(-texts.select(*keys).count() // PART_ROWS))
    texts.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select(
        by, "value").write.mode(mode).partitionBy(by).text(path)


MAX_DATASET_VALUES = 20_000_000


def _vector(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Values per key in position order; a vector has the length of one QoI."""
    cells = F.array_sort(F.collect_list(F.struct("pos", "value")))
    return df.groupBy(*keys).agg(cells.alias("v")).select(*keys, F.col("v.value").alias("v"))


def write_dataset(params: DataFrame, values: DataFrame, reference: DataFrame, layout: DataFrame,
                  path: str, mode: str = "errorifexists") -> None:
    """Datasets as JSON rows: one per QoI and sample, and one per QoI for its reference.

    ``params``: sample_id, params; ``values``: sample_id, qoi, pos, value; ``reference``: qoi,
    pos, value; ``layout``: qoi, labels, values_per_label, nuisance.
    """
    rows = _vector(values, ["qoi", "sample_id"]).withColumnRenamed("v", "outputs").join(
        params, "sample_id")
    rows.write.mode(mode).partitionBy("qoi").json(f"{path}/samples")
    ref = _vector(reference, ["qoi"]).withColumnRenamed("v", "outputs_ref").join(layout, "qoi")
    ref.write.mode(mode).json(f"{path}/reference")


def dataset_objects(params: DataFrame, values: DataFrame, reference: DataFrame,
                    layout: DataFrame) -> DataFrame:
    """One whole dataset object per QoI, for tools that read a dataset as one document.

    An object is one row, so the number of values per QoI is checked first; use
    ``write_dataset`` beyond the limit.
    """
    top = values.groupBy("qoi").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if top > MAX_DATASET_VALUES:
        raise ValueError(f"{top} values are too many for one object; use write_dataset")
    rows = _vector(values, ["qoi", "sample_id"]).join(params, "sample_id")
    packed = rows.groupBy("qoi").agg(F.array_sort(F.collect_list(
        F.struct("sample_id", "params", "v"))).alias("r"))
    ref = _vector(reference, ["qoi"]).withColumnRenamed("v", "outputs_ref")
    return packed.join(ref, "qoi").join(layout, "qoi").select(
        F.col("qoi").alias("name"), F.col("r.params").alias("inputs"), F.col("r.v").alias("outputs"),
        "outputs_ref", "labels", "values_per_label", "nuisance")


def write_objects(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.withColumn("qoi", F.col("name")).write.mode(mode).partitionBy("qoi").json(path)


def write_raw(curves: DataFrame, path: str, decimals: int | None = None,
              mode: str = "errorifexists") -> None:
    """Curves as JSON rows; values are rounded only when ``decimals`` is given."""
    if decimals is not None:
        curves = curves.withColumn("value", F.round("value", decimals))
    curves.write.mode(mode).json(path)


def write_summary(summary: DataFrame, path: str, mode: str = "errorifexists") -> None:
    summary.write.mode(mode).json(path)


def append_draws(draws: DataFrame, path: str) -> None:
    draws.write.mode("append").partitionBy("run_id").parquet(path)


def write_split(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Rows with a ``split`` column, one folder per side."""
    rows.write.mode(mode).partitionBy("split").parquet(path)


def write_atom_energies(energies: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object keyed by atomic number (at most 118 entries)."""
    entry = F.struct(F.col("number").cast("string").alias("k"), F.col("energy_ev").alias("v"))
    keyed = energies.agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("energies"))
    keyed.select(F.to_json("energies").alias("value")).write.mode(mode).text(path)
