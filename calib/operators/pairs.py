"""Frame slices, selections and periodic pair joins on positions.

Positions carry the frame keys, ``atom_id``, x, y, z and box lengths bx, by, bz
(NULL lengths mean an open axis).  Boxes are orthorhombic, unless ``lattice.with_lattice`` has
added the reduced lattice of a box with other angles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calib.functions.expr import angle, min_image, norm3
from calib.operators.lattice import LATTICE, lattice_cells, nearest_image
from calib.operators.ordering import attach

AXES = ("x", "y", "z")
LENGTHS = ("bx", "by", "bz")
HOT_CELL_ROWS = 20_000


def slice_frames(df: DataFrame, start: int | None = None, stop: int | None = None,
                 step: int = 1, keys: Sequence[str] = (), frame: str = "frame") -> DataFrame:
    """Python slice of 0-based frames; NULL bounds are open, negative ones count from the end."""
    if step < 1:
        raise ValueError("step must be positive")
    keys = list(keys)
    out, size = df, None
    if (start or 0) < 0 or (stop is not None and stop < 0):
        sizes = df.groupBy(*keys).agg((F.max(frame) + 1).alias("__frames"))
        out, size = attach(df, sizes, keys), F.col("__frames")

    def bound(v: int) -> Column:
        return F.lit(v) if v >= 0 else F.greatest(size + v, F.lit(0))

    first = bound(start or 0)
    keep = (F.col(frame) >= first) & (F.pmod(F.col(frame) - first, F.lit(step)) == 0)
    if stop is not None:
        keep = keep & (F.col(frame) < bound(stop))
    return out.where(keep).drop("__frames")


def select_atoms(df: DataFrame, predicate: str | Column) -> DataFrame:
    """Atoms that satisfy a Spark SQL predicate, e.g. ``resname = 'SOL' AND name LIKE 'O%'``."""
    return df.where(F.expr(predicate) if isinstance(predicate, str) else predicate)


def require_orthorhombic(frames: DataFrame) -> DataFrame:
    """Raise at run time for boxes whose angles (alpha, beta, gamma) are not 90 degrees."""
    square = F.lit(True)
    for a in ("alpha", "beta", "gamma"):
        square = square & (F.coalesce(F.abs(F.col(a) - 90.0), F.lit(0.0)) < 1e-6)
    return frames.where(
        F.when(square, True).otherwise(
            F.raise_error(F.lit("only orthorhombic boxes are supported")).cast("boolean")))


def _cells(cutoff: float) -> tuple[list[Column], list[Column]]:
    """Number of cells and cell index per axis; cells are at least ``cutoff`` wide."""
    counts, index = [], []
    for axis, length in zip(AXES, LENGTHS):
        x, L = F.col(axis), F.col(length)
        n = F.greatest(F.lit(1), F.floor(L / cutoff).cast("int"))
        inside = F.floor(F.pmod(x, L) / L * n).cast("int")
        counts.append(n)
        index.append(F.when(L.isNull(), F.floor(x / cutoff).cast("int")).otherwise(
            F.least(inside, n - 1)))
    return counts, index


def _around(n: Column, i: Column) -> Column:
    """Cells i - 1 to i + 1 of a periodic axis of ``n`` cells."""
    return F.array_distinct(F.transform(F.array(i - 1, i, i + 1), lambda v: F.pmod(v, n)))


def _neighbours(n: Column, i: Column, length: str) -> Column:
    return F.when(F.col(length).isNull(), F.array(i - 1, i, i + 1)).otherwise(_around(n, i))


def pair_join(a: DataFrame, b: DataFrame, keys: Sequence[str], max_distance: float,
              min_distance: float | None = None, keep_a: Sequence[str] = (),
              keep_b: Sequence[str] = (), hot_cell_rows: int = HOT_CELL_ROWS) -> DataFrame:
    """Pairs of one frame with min_distance < d <= max_distance (d >= 0 without a minimum).

    Positions are put into cells no narrower than the cutoff; ``a`` is copied to the
    27 neighbouring cells and joined with ``b`` on (frame, cell), so the join is an
    equality join that spreads inside a frame.  Cells with many points of either side are
    cut further by a hash of the atom.  With ``max_distance`` of at least half the
    box diagonal every pair of the frame comes out.
    """
    keys = list(keys)
    skewed = "lattice" in a.columns
    counts, index = lattice_cells(max_distance) if skewed else _cells(max_distance)
    box = LATTICE if skewed else LENGTHS
    around = [_around(n, i) if skewed else _neighbours(n, i, L) for n, i, L in zip(counts, index, LENGTHS)]
    right = b.select(
        *keys, *[i.alias(f"__c{k}") for k, i in enumerate(index)],
        F.col("atom_id").alias("atom_b"), *[F.col(c).alias(f"{c}_b") for c in (*AXES, *keep_b)])
    left = a.select(
        *keys, F.col("atom_id").alias("atom_a"), *box,
        *[F.col(c).alias(f"{c}_a") for c in (*AXES, *keep_a)],
        *[n.alias(f"__n{k}") for k, n in enumerate(around)])
    for k in range(3):
        left = left.withColumn(f"__c{k}", F.explode_outer(f"__n{k}")).drop(f"__n{k}")
    cell = [*keys, "__c0", "__c1", "__c2"]
    on = list(cell)
    for side, name in ((right, "b"), (left, "a")):
        crowded = side.groupBy(*cell).agg(F.count(F.lit(1)).alias("__m")).where(F.col("__m") > hot_cell_rows)
        if crowded.isEmpty():
            continue
        crowded = crowded.select(*cell, F.ceil(F.col("__m") / hot_cell_rows).alias("__parts"))
        parts, salt = F.coalesce("__parts", F.lit(1)), f"__salt_{name}"
        one, all_ = F.pmod(F.xxhash64(f"atom_{name}"), parts), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))
        right = attach(right, crowded, cell).withColumn(salt, one if name == "b" else all_).drop("__parts")
        left = attach(left, crowded, cell).withColumn(salt, one if name == "a" else all_).drop("__parts")
        on.append(salt)

    pairs = left.join(right, on).drop(*[c for c in on if c not in keys])
    pairs = pairs.withColumn("distance", _image_length([F.col(f"{x}_a") - F.col(f"{x}_b") for x in AXES], skewed))
    keep = F.col("distance") <= max_distance
    if min_distance is not None:
        keep = keep & (F.col("distance") > min_distance)
    return pairs.where(keep)


def _image(delta: Sequence[Column], skewed: bool) -> list[Column]:
    """The components of the shortest image of a difference, by the box columns of its row."""
    if skewed:
        near = nearest_image(delta, F.col("lattice"), F.col("inverse"))
        return [near[x] for x in AXES]
    return [min_image(d, F.col(L)) for d, L in zip(delta, LENGTHS)]


def _image_length(delta: Sequence[Column], skewed: bool) -> Column:
    if skewed:
        return F.sqrt(nearest_image(delta, F.col("lattice"), F.col("inverse"))["d2"])
    return norm3(*_image(delta, False))


def pair_counts(a: DataFrame, b: DataFrame, keys: Sequence[str], label: Sequence[str] = (),
                ) -> DataFrame:
    """Number of all pairs per frame (and label of ``a``), without forming them."""
    keys, label = list(keys), list(label)
    na = a.groupBy(*keys, *label).agg(F.count(F.lit(1)).alias("__na"))
    nb = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("__nb"))
    return na.join(nb, keys).select(
        *keys, *label, (F.col("__na") * F.col("__nb")).alias("n_pairs"))


def clash_pairs(atoms: DataFrame, keys: Sequence[str], min_dist: float) -> DataFrame:
    """Pairs of different atoms closer than ``min_dist``, each once."""
    pairs = pair_join(atoms, atoms, keys, min_dist)
    return pairs.where((F.col("atom_a") < F.col("atom_b")) & (F.col("distance") < min_dist)
                       ).select(*keys, "atom_a", "atom_b", "distance")


def donor_hydrogens(atoms: DataFrame, bonds: DataFrame, system: Sequence[str] = (),
                    elements: Sequence[str] = ("O", "N", "S")) -> DataFrame:
    """(hydrogen, donor): the first bonded atom of each hydrogen, if it is a donor element."""
    system = list(system)
    both = bonds.select(*system, F.col("a").alias("hydrogen"), F.col("b").alias("donor")
                        ).unionByName(bonds.select(*system, F.col("b").alias("hydrogen"),
                                                   F.col("a").alias("donor")))
    hydrogens = atoms.where(F.col("element") == "H").select(
        *system, F.col("atom_id").alias("hydrogen"))
    first = both.join(hydrogens, [*system, "hydrogen"], "left_semi").groupBy(
        *system, "hydrogen").agg(F.min("donor").alias("donor"))
    donors = atoms.where(F.col("element").isin(*elements)).select(
        *system, F.col("atom_id").alias("donor"))
    return first.join(donors, [*system, "donor"], "left_semi")


def bonded_triples(donors: DataFrame, hydrogens: DataFrame, acceptors: DataFrame,
                   pairs: DataFrame, keys: Sequence[str], system: Sequence[str] = (),
                   distance_cutoff: float = 3.5, angle_cutoff: float = 150.0,
                   keep_d: Sequence[str] = (), keep_a: Sequence[str] = ()) -> DataFrame:
    """Donor-hydrogen-acceptor triples: 1 < D-A <= cutoff and angle D-H-A above the cutoff.

    ``pairs`` is the (hydrogen, donor) table; positions of the three groups are per frame.
    """
    keys, system = list(keys), list(system)
    h = hydrogens.select(*keys, F.col("atom_id").alias("hydrogen"),
                         *[F.col(x).alias(f"h{x}") for x in AXES])
    dh = (donors.withColumnRenamed("atom_id", "donor").join(pairs, [*system, "donor"])
          .join(h, [*keys, "hydrogen"]).withColumnRenamed("donor", "atom_id"))
    near = pair_join(dh, acceptors, keys, distance_cutoff, 1.0,
                     keep_a=["hydrogen", "hx", "hy", "hz", *keep_d], keep_b=keep_a)

    skewed = "lattice" in near.columns
    for side in "ab":
        delta = _image([F.col(f"{x}_{side}") - F.col(f"h{x}_a") for x in AXES], skewed)
        near = near.withColumn(f"__{side}", F.struct(*[d.alias(x) for d, x in zip(delta, AXES)]))
    to_h = lambda side: [F.col(f"__{side}.{x}") for x in AXES]
    near = near.withColumn("angle", angle(to_h("a"), to_h("b")))
    bonded = near.where(F.col("angle") > F.radians(F.lit(float(angle_cutoff))))
    return bonded.select(
        *keys, F.col("atom_a").alias("donor"), F.col("hydrogen_a").alias("hydrogen"),
        F.col("atom_b").alias("acceptor"), "distance", F.degrees("angle").alias("angle"),
        *[F.col(f"{c}_a").alias(f"donor_{c}") for c in keep_d],
        *[F.col(f"{c}_b").alias(f"acceptor_{c}") for c in keep_a])


def nearest_element(masses: DataFrame, elements: DataFrame, key: Sequence[str],
                    tolerance: float = 1e-2) -> DataFrame:
    """Element whose mass is nearest and within the tolerance, else NULL.

    Both sides meet on mass buckets as wide as twice the tolerance, so there is
    no comparison of every atom with every element.
    """
    width = 2 * tolerance
    spread = elements.select(
        "element", F.col("mass").alias("__em"),
        F.explode(F.array_distinct(F.array(
            F.floor((F.col("mass") - tolerance) / width),
            F.floor((F.col("mass") + tolerance) / width)))).alias("__b"))
    rows = attach(masses.withColumn("__b", F.floor(F.col("mass") / width)), spread, ["__b"])
    gap = F.abs(F.col("mass") - F.col("__em"))
    best = F.min_by("element", F.when(gap <= tolerance, F.struct(gap, "element")))
    found = F.min(gap) <= tolerance
    return rows.groupBy(*key, "mass").agg(F.when(found, best).alias("element"))
