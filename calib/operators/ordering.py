"""Positions, running totals and exact quantiles inside groups of any size.

A plain window puts a whole group into one task.  These operators use it only
after a count shows that every group is small; otherwise the rows are range
partitioned on (keys, order), numbered inside each partition, and shifted by the
totals of the earlier partitions of the same group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calib.functions.expr import col, hash_order
from calib.session import materialize

WINDOW_ROWS = 1_000_000
BLOCK = 65_536
LOCAL_ROWS = 10_000

Order = Sequence[str | Column]


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.max("n")).first()[0] or 0


def local_if_small(df: DataFrame, rows: int = LOCAL_ROWS) -> DataFrame:
    """``df`` as a broadcast table when it has at most ``rows`` rows, else unchanged.

    The planner does not know the size of an aggregate before it runs and would shuffle
    the large side of a join with it; counting first avoids that.
    """
    head = df.limit(rows + 1).toArrow()
    if head.num_rows > rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(head, df.schema))


def attach(df: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join per-group values to rows; NULL keys match each other.

    A small table is broadcast after its rows have been counted; a large one is joined
    as Spark sees fit.  Without keys ``small`` is one row of totals, added as literals.
    """
    if not keys:
        totals = small.first()
        return df.withColumns({
            f.name: F.lit(None if totals is None else totals[f.name]).cast(f.dataType)
            for f in small.schema.fields})
    renamed = local_if_small(small.select(*[
        F.col(k).alias(f"__{k}") if k in keys else F.col(k) for k in small.columns]))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return df.join(renamed, on, how).drop(*[f"__{k}" for k in keys])


def _spread(df: DataFrame, keys: Sequence[str], order: Order) -> DataFrame:
    """Range partition on (keys, order); record partition and place of each row."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    by = [*[F.col(k) for k in keys], *[col(o) for o in order]]
    ranged = (
        df.repartitionByRange(parts, *by)
        .sortWithinPartitions(*by)
        .withColumn("__part", F.spark_partition_id())
        .withColumn("__place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    return materialize(ranged, "ranged")


def _earlier(table: DataFrame, keys: Sequence[str], total: Column) -> DataFrame:
    """Per (group, partition): first place, and the total of earlier partitions."""
    spans = table.groupBy(*keys, "__part").agg(
        total.alias("__total"), F.min("__place").alias("__first"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(
        Window.unboundedPreceding, -1)
    return spans.select(
        *keys, "__part", "__first",
        F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__before"))


def number_rows(df: DataFrame, keys: Sequence[str], order: Order, name: str = "row_number",
                window_rows: int = WINDOW_ROWS, stored: bool = False) -> DataFrame:
    """1-based position of each row inside its group under a total order.

    ``stored`` rows can be read several times without being ordered again; ranged rows
    always can, as they lie in a table.
    """
    keys = list(keys)
    if largest_group(df, keys) <= window_rows:
        w = Window.partitionBy(*keys).orderBy(*[col(o) for o in order])
        numbered = df.withColumn(name, F.row_number().over(w).cast("long"))
        return materialize(numbered, "numbered") if stored else numbered
    table = _spread(df, keys, order)
    joined = attach(table, _earlier(table, keys, F.count(F.lit(1))), [*keys, "__part"])
    place = F.col("__before") + F.col("__place") - F.col("__first") + 1
    return joined.withColumn(name, place.cast("long")).select(*df.columns, name)


def _window_total(df: DataFrame, keys: Sequence[str], order: Order, value: str, name: str
                  ) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[col(o) for o in order]).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.sum(value).over(w))


def running_total(df: DataFrame, keys: Sequence[str], order: Order, value: str,
                  name: str = "running", window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Inclusive cumulative sum of ``value`` inside each group under a total order."""
    keys = list(keys)
    if largest_group(df, keys) <= window_rows:
        return _window_total(df, keys, order, value, name)
    table = _spread(df, keys, order)
    local = Window.partitionBy(*keys, "__part").orderBy("__place").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    joined = attach(table.withColumn("__local", F.sum(value).over(local)),
                    _earlier(table, keys, F.sum(value)), [*keys, "__part"])
    return joined.withColumn(name, F.col("__local") + F.col("__before")).select(
        *df.columns, name)


SKETCH = 10_000


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
              names: Sequence[str] | None = None, interpolate: bool = True,
              window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Exact quantiles per group, one column per probability.

    Linear interpolation between order statistics, or the lower one when
    ``interpolate`` is false.  Equal values are merged before any ordering.  Large
    groups are first narrowed with mergeable sketches to the values around the wanted
    ranks, so neither a full sort nor a shuffle of all rows is needed.
    """
    keys = list(keys)
    names = list(names or [f"q{p:g}" for p in probs])
    if not keys:
        one = df.withColumn("__all", F.lit(0))
        return quantiles(one, ["__all"], value, probs, names, interpolate, window_rows).drop("__all")
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    wanted = F.array(*[F.struct(F.lit(i).alias("__i"), F.lit(float(p)).alias("__p"))
                       for i, p in enumerate(probs)])
    targets = sizes.select(*keys, F.inline(wanted), "__n")
    place = (F.col("__n") - 1) * F.col("__p")
    low = F.floor(place)
    targets = targets.select(*keys, "__i", low.alias("__low"),
                             F.least(low + 1, F.col("__n") - 1).alias("__high"),
                             (place - low).alias("__t"))
    if largest_group(rows, keys) <= window_rows:
        ties = rows.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__c"))
        ranked = _window_total(ties, keys, ["__v"], "__c", "__upto")
        picked = _picked(ranked, targets, keys, len(probs))
    else:
        picked = _narrowed(rows, targets, keys, probs, window_rows)
    lo, hi, t = F.col("__lo"), F.col("__hi"), F.col("__t")
    result = F.when(lo == hi, lo).otherwise(lo + (hi - lo) * t) if interpolate else lo
    return picked.groupBy(*keys).agg(*[
        F.max(F.when(F.col("__i") == i, result)).alias(n) for i, n in enumerate(names)])


def _holds(rank: Column) -> Column:
    """Whether a run of equal values (count __c, ending at __upto) covers a 0-based rank."""
    return (F.col("__upto") > rank) & (F.col("__upto") - F.col("__c") <= rank)


def _picked(ranked: DataFrame, targets: DataFrame, keys: Sequence[str], n_probs: int
            ) -> DataFrame:
    """(keys, __i, __lo, __hi, __t) from ranked distinct values."""
    packed = targets.groupBy(*keys).agg(F.array_sort(F.collect_list(
        F.struct("__i", "__low", "__high", "__t"))).alias("__targets"))
    rows = attach(ranked, packed, keys)
    picks = []
    for i in range(n_probs):
        goal = F.get("__targets", F.lit(i))
        picks.append(F.struct(
            F.lit(i).alias("__i"),
            F.max(F.when(_holds(goal["__low"]), F.col("__v"))).alias("__lo"),
            F.max(F.when(_holds(goal["__high"]), F.col("__v"))).alias("__hi"),
            F.max(goal["__t"]).alias("__t")))
    return rows.groupBy(*keys).agg(F.array(*picks).alias("__a")).select(*keys, F.inline("__a"))


def _narrowed(rows: DataFrame, targets: DataFrame, keys: Sequence[str],
              probs: Sequence[float], window_rows: int) -> DataFrame:
    """Order statistics of large groups from the values near each wanted rank.

    A sketch brackets every rank; rows below the bracket are counted, rows inside it
    are kept.  The bracket is checked against the exact counts, and the groups for
    which it failed or stayed too wide are ordered in full.
    """
    eps = 1.0 / SKETCH
    edges = [min(max(p + d * 3 * eps, 0.0), 1.0) for p in probs for d in (-1, 1)]
    sketch = rows.groupBy(*keys).agg(
        F.percentile_approx("__v", edges, SKETCH).alias("__e"),
        F.min("__v").alias("__min"), F.max("__v").alias("__max"))
    brackets = []
    for i, p in enumerate(probs):
        left = F.col("__min") if p - 3 * eps <= 0 else F.get("__e", F.lit(2 * i))
        right = F.col("__max") if p + 3 * eps >= 1 else F.get("__e", F.lit(2 * i + 1))
        brackets.append(F.struct(F.lit(i).alias("__i"), left.alias("__left"),
                                 right.alias("__right")))
    sketch = materialize(sketch.select(*keys, F.array(*brackets).alias("__b")), "brackets")
    marked = attach(rows, sketch, keys)
    below = marked.groupBy(*keys).agg(F.array(*[F.struct(
        F.lit(i).alias("__i"),
        F.count_if(F.col("__v") < F.get("__b", F.lit(i))["__left"]).alias("__below"))
        for i in range(len(probs))]).alias("__a")).select(*keys, F.inline("__a"))
    inside = F.filter("__b", lambda b: (F.col("__v") >= b["__left"]) & (F.col("__v") <= b["__right"]))
    near = marked.select(*keys, "__v", F.explode_outer(F.transform(
        inside, lambda b: b["__i"])).alias("__i")).where(F.col("__i").isNotNull())
    near = materialize(near.groupBy(*keys, "__i", "__v").agg(F.count(F.lit(1)).alias("__c")), "near")
    by = [*keys, "__i"]
    local = running_total(near, by, ["__v"], "__c", "__in", window_rows)
    ranked = attach(attach(local, below, by), targets, by).withColumn(
        "__upto", F.col("__below") + F.col("__in"))
    picked = materialize(ranked.groupBy(*by).agg(
        F.max(F.when(_holds(F.col("__low")), F.col("__v"))).alias("__lo"),
        F.max(F.when(_holds(F.col("__high")), F.col("__v"))).alias("__hi"),
        F.max("__t").alias("__t")), "picked")
    failed = targets.select(*by).exceptAll(
        picked.where(F.col("__lo").isNotNull() & F.col("__hi").isNotNull()).select(*by))
    failed = materialize(failed.select(*keys).distinct(), "failed")
    if failed.isEmpty():
        return picked
    # NULL-safe semi join keeps groups whose key is NULL.
    again = attach(
        rows, failed.withColumn("__again", F.lit(True)), keys).where("__again").drop("__again")
    ties = again.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__c"))
    ranked = running_total(ties, keys, ["__v"], "__c", "__upto", window_rows)
    redone = _picked(ranked, targets, keys, len(probs))
    kept = attach(picked, failed.withColumn("__again", F.lit(True)), keys).where(
        F.col("__again").isNull()).drop("__again")
    redone = attach(redone, failed.withColumn("__again", F.lit(True)), keys).where(
        "__again").drop("__again")
    return kept.unionByName(redone)


def with_previous(df: DataFrame, keys: Sequence[str], step: str, values: Sequence[str],
                  block: int = BLOCK) -> DataFrame:
    """Add ``prev_<value>`` from the row at ``step - 1`` of the same group.

    Steps must be whole and gap-free.  Groups are cut into blocks of steps; the
    last row of a block is copied to the next, so no task holds a whole group.
    """
    blocks = F.floor(F.col(step) / block).cast("long")
    last = F.pmod(F.col(step), F.lit(block)) == block - 1
    copied = df.withColumn(
        "__b", F.explode(F.when(last, F.array(blocks, blocks + 1)).otherwise(F.array(blocks))))
    w = Window.partitionBy(*keys, "__b").orderBy(step)
    out = copied
    for v in values:
        out = out.withColumn(f"prev_{v}", F.lag(v).over(w))
    return out.where(F.col("__b") == blocks).drop("__b")


def hash_numbered(df: DataFrame, key: Sequence[str], seed: int, by: Sequence[str] = (),
                  name: str = "shuffled") -> DataFrame:
    """Position in a pseudo-random order fixed by (seed, key)."""
    hashed = df.withColumn("__h", hash_order(F.lit(str(seed)), *[F.col(k) for k in key]))
    return number_rows(hashed, list(by), ["__h", *key], name).drop("__h")


def seeded_split(df: DataFrame, key: Sequence[str], train_fraction: float, seed: int,
                 by: Sequence[str] = ()) -> DataFrame:
    """Add ``split`` = train/test; train size is the half-even round of n * fraction.

    At least one row goes to each side, and a single row goes to train.
    """
    if not 0.0 < train_fraction < 1.0:
        raise ValueError("train_fraction must be between 0 and 1")
    by = list(by)
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    numbered = attach(hash_numbered(df, key, seed, by, "__pos"), sizes, by)
    wanted = F.rint(F.col("__n") * train_fraction)
    n_train = F.when(F.col("__n") == 1, F.lit(1.0)).otherwise(
        F.greatest(F.lit(1.0), F.least(wanted, F.col("__n") - 1.0)))
    return numbered.withColumn(
        "split", F.when(F.col("__pos") <= n_train, "train").otherwise("test")
    ).drop("__pos", "__n")


def holdout_split(df: DataFrame, key: Sequence[str], test_fraction: float, seed: int,
                  by: Sequence[str] = ()) -> DataFrame:
    """Add ``split``; the first floor(n * fraction) rows of the order are the test side."""
    if not 0.0 < test_fraction < 1.0:
        raise ValueError("test_fraction must be between 0 and 1")
    by = list(by)
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    numbered = attach(hash_numbered(df, key, seed, by, "__pos"), sizes, by)
    n_test = F.when(
        F.col("__n") < 2, F.raise_error(F.lit("a split needs at least 2 rows")).cast("long")
    ).otherwise(F.floor(F.col("__n") * test_fraction))
    return numbered.withColumn(
        "split", F.when(F.col("__pos") <= n_test, "test").otherwise("train")
    ).drop("__pos", "__n")


def first_rows(df: DataFrame, key: Sequence[str], n: int, seed: int,
               by: Sequence[str] = ()) -> DataFrame:
    """The first min(n, size) rows of the seeded order of each group."""
    return hash_numbered(df, key, seed, by, "__pos").where(F.col("__pos") <= n).drop("__pos")


def every_nth(df: DataFrame, keys: Sequence[str], order: Order, stride: int,
              name: str = "row_number") -> DataFrame:
    """Rows number stride, 2*stride, ... and the last one of each group."""
    keys = list(keys)
    numbered = number_rows(df, keys, order, name)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    marked = attach(numbered, sizes, keys)
    keep = (F.pmod(F.col(name), F.lit(stride)) == 0) | (F.col(name) == F.col("__n"))
    return marked.where(keep).drop("__n")


def evenly_spaced(df: DataFrame, keys: Sequence[str], order: Order, k: int) -> DataFrame:
    """Rows at the whole parts of min(k, n) equally spaced positions from 0 to n-1."""
    if k < 1:
        raise ValueError("k must be positive")
    keys = list(keys)
    numbered = number_rows(df, keys, order, "__pos")
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    rows = attach(numbered, sizes, keys).withColumn("__p", F.col("__pos") - 1)
    n, p = F.col("__n"), F.col("__p")
    picks = F.least(F.lit(k).cast("long"), n)
    step = F.try_divide((n - 1).cast("double"), (picks - 1).cast("double"))
    # Positions are floor(i * step); test the few i that can land on p.
    guess = F.floor(F.try_divide(p.cast("double"), step))
    lands = F.lit(False)
    for d in (-1, 0, 1, 2):
        i = guess + d
        lands = lands | ((i >= 0) & (i < picks - 1) & (F.floor(i * step) == p))
    keep = F.when(picks == 1, p == 0).otherwise((p == n - 1) | F.coalesce(lands, F.lit(False)))
    return rows.where(keep).drop("__pos", "__n", "__p")
