"""Periodic boxes of any angles: reduced lattices, cells and nearest images.

The three cell vectors are exchanged for the shortest ones of the same lattice.  In that
basis the nearest image of a difference is among the 27 neighbours of its rounded image, and
slabs between opposite faces are as thick as they can be, so few cells are crossed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calib.functions.expr import cell_vectors
from calib.operators.ordering import attach

BOX = ("bx", "by", "bz", "alpha", "beta", "gamma")
LATTICE = ("lattice", "inverse")


def reduced_cell(cell: np.ndarray) -> np.ndarray:
    """The shortest basis of the lattice of three rows, each shorter than any change by the others."""
    v = np.array(cell, float)
    while True:
        v = v[np.argsort((v * v).sum(1), kind="stable")]
        for i in (1, 2):
            for j in range(i):
                v[i] -= np.rint(v[i] @ v[j] / (v[j] @ v[j])) * v[j]
        changed = False
        for i in range(3):
            j, k = (m for m in range(3) if m != i)
            options = [v[i] + s * v[j] + t * v[k] for s, t in product((-1, 0, 1), repeat=2)]
            best = min(options, key=lambda x: x @ x)
            if best @ best < (v[i] @ v[i]) * (1 - 1e-12):
                v[i], changed = best, True
        if not changed:
            return v[np.argsort((v * v).sum(1), kind="stable")]


def with_lattice(atoms: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``lattice`` and ``inverse`` (nine numbers each) and ``heights`` (three) of each frame's box.

    ``atoms`` has the box columns bx, by, bz, alpha, beta, gamma; a frame has one box.  Open or
    flat boxes are an error.
    """
    keys = list(keys)
    boxes = atoms.groupBy(*keys).agg(F.min(F.struct(*BOX)).alias("b"), F.max(F.struct(*BOX)).alias("c"))
    one = F.when(F.col("b") == F.col("c"), cell_vectors(*[F.col(f"b.{x}").cast("double") for x in BOX])).otherwise(
        F.raise_error(F.lit("a frame has two boxes")).cast("array<double>"))

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for flat in batch["cell"]:
                cell = np.array([np.nan if x is None else x for x in flat], float).reshape(3, 3)
                volume = abs(np.linalg.det(cell))
                if not np.isfinite(volume) or volume < 1e-9:
                    raise ValueError("a box needs three lengths and angles that span a volume")
                v = reduced_cell(cell)
                inverse = np.linalg.inv(v)
                rows.append((v.ravel().tolist(), inverse.ravel().tolist(),
                             (1 / np.linalg.norm(inverse, axis=0)).tolist()))
            found = pd.DataFrame(rows, columns=["lattice", "inverse", "heights"], index=batch.index)
            yield pd.concat([batch[keys], found], axis=1)

    kept = ", ".join(f"`{k}` {atoms.schema[k].dataType.simpleString()}" for k in keys)
    found = boxes.select(*keys, one.alias("cell")).mapInPandas(
        reduce, f"{kept}, lattice array<double>, inverse array<double>, heights array<double>")
    return attach(atoms, found, keys)


def _times(v: Sequence[Column], matrix: Column) -> list[Column]:
    """Row vector times a matrix of nine numbers."""
    return [v[0] * matrix[i] + v[1] * matrix[3 + i] + v[2] * matrix[6 + i] for i in range(3)]


def lattice_cells(cutoff: float) -> tuple[list[Column], list[Column]]:
    """Number of cells and cell index per direction; slabs are at least ``cutoff`` thick."""
    counts, index = [], []
    for i, f in enumerate(_times([F.col(x) for x in "xyz"], F.col("inverse"))):
        n = F.greatest(F.lit(1), F.floor(F.col("heights")[i] / cutoff).cast("int"))
        counts.append(n)
        index.append(F.least(F.floor(F.pmod(f, F.lit(1.0)) * n).cast("int"), n - 1))
    return counts, index


def nearest_image(delta: Sequence[Column], lattice: Column, inverse: Column) -> Column:
    """The shortest image of a difference: a struct of d2 and x, y, z."""
    turns = F.array(*[F.struct(*[F.lit(float(s)).alias(c) for c, s in zip("ijk", t)])
                      for t in product((-1, 0, 1), repeat=3)])
    parts = [f - F.rint(f) for f in _times(delta, inverse)]
    base = F.struct(*[p.alias(c) for c, p in zip("ijk", parts)], lattice.alias("v"))

    def image(b: Column, t: Column) -> Column:
        x, y, z = _times([b[c] + t[c] for c in "ijk"], b["v"])
        return F.struct((x * x + y * y + z * z).alias("d2"), x.alias("x"), y.alias("y"), z.alias("z"))

    # One element, so that the rounded image is computed once for its 27 neighbours.
    return F.transform(F.array(base), lambda b: F.array_min(F.transform(turns, lambda t: image(b, t))))[0]
