"""Extension points: named analysis routines and functions passed in by users.

A routine takes position frames (and keyword options) and returns QoI rows with the
columns of ``QOI_COLUMNS``.  Transforms, predicates and likelihoods are plain functions
from DataFrame to DataFrame or Column, given where they are used.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calib.session import materialize

QOI_COLUMNS = ("qoi", "label", "bin", "value")
Routine = Callable[..., DataFrame]
_ROUTINES: dict[str, Routine] = {}


def register_qoi(name: str, fn: Routine) -> None:
    if not callable(fn):
        raise TypeError(f"routine {name!r} is not callable")
    _ROUTINES[name] = fn


def routine(name: str | Routine) -> Routine:
    """A registered routine by name; callables pass through."""
    if callable(name):
        return name
    if name not in _ROUTINES:
        raise ValueError(f"unknown routine {name!r}; known: {', '.join(sorted(_ROUTINES))}")
    return _ROUTINES[name]


def run_routines(frames: DataFrame, routines: Mapping[str | Routine, Mapping[str, Any]] | Sequence,
                 ) -> DataFrame:
    """QoI rows of several routines as one table.

    ``routines`` lists (routine, options); options are flat.  Two routines may not
    produce the same QoI name.
    """
    items = list(routines.items()) if isinstance(routines, Mapping) else list(routines)
    if not items:
        raise ValueError("at least one routine is needed")
    parts = []
    for i, (name, options) in enumerate(items):
        if "kwargs" in options:
            raise ValueError("routine options are flat; 'kwargs' is not allowed")
        rows = routine(name)(frames, **options)
        missing = [c for c in QOI_COLUMNS if c not in rows.columns]
        if missing:
            raise ValueError(f"routine {name!r} lacks columns: {', '.join(missing)}")
        parts.append(rows.withColumn("__routine", F.lit(i)))
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if len(parts) > 1:
        # Curves are small; stored once, they are not computed again after the check.
        merged = materialize(merged, "qoi")
        shared = merged.groupBy("qoi").agg(
            F.count_distinct("__routine").alias("n")).where("n > 1").limit(20).collect()
        if shared:
            names = ", ".join(sorted(r["qoi"] for r in shared))
            raise ValueError(f"several routines produce: {names}")
    return merged.drop("__routine")


def rdf_routine(frames: DataFrame, solute: str, solvent: str, keys: Sequence[str] = ("frame",),
                group: Sequence[str] = (), **options) -> DataFrame:
    """Pair profiles per solute atom type as QoI ``rdf``."""
    from calib.operators.curves import type_profiles

    rows = type_profiles(frames, keys, solute, solvent, group, **options)
    return rows.select(*group, F.lit("rdf").alias("qoi"), F.col("type").alias("label"), "bin", "value")


def hb_routine(frames: DataFrame, bonds: DataFrame, solute: str, solvent: str,
               keys: Sequence[str] = ("frame",), group: Sequence[str] = (), **options) -> DataFrame:
    """Bond rates per donor and acceptor label as QoI ``hb``."""
    from calib.operators.curves import event_rates

    rows = event_rates(frames, bonds, keys, solute, solvent, group, **options)
    return rows.select(*group, F.lit("hb").alias("qoi"), "label", F.lit(0).alias("bin"), "value")


register_qoi("rdf", rdf_routine)
register_qoi("hb", hb_routine)
