"""Mixing sources to target weights along a time-varying curriculum.

Targets share all words among the sources by weight; a source gives at most ``most``
times its size, and what is above goes to the others by weight.  Each source has a
schedule: its weight as a piecewise linear function of training time from 0 to 1, of mean
1 after scaling.  Its integral, times the target, is the source's cumulative demand of
words.  The documents of a source, in an order drawn from a seed, lie one after another
on the axis of words, once per epoch.  The copies that end before the target are taken,
and up to FILLS more, each the one whose size is nearest to what is then missing.  A copy's training
position is the time at which the demand reaches its middle; sorting all copies by
position gives the training order.

A document far longer than the others may lie across the target and shut out all behind
it.  A source that ends farther from its target than FILLS documents of mean size is
therefore filled in rounds: each takes, in order, the copies that fit what is missing,
until none fits, and one nearest copy closes.  Its copies then lie one after another
without those skipped.

Only DataFrame functions run on rows.  Prefix sums within a source and over the sources
use range partitioning for large groups, so a source with a third of all rows is spread
over tasks; only ids and sizes are shuffled until copies are made.

Defined cases: NULL and empty texts have size 0, are taken 0 words, and have 0 copies
(``keep_empty`` of ``mixed`` keeps one); sources without words have target 0; the NULL
source is a source, last in order; rows that repeat a doc_id are counted each; no rows
give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calib.llm.blocks import WORD
from calib.operators.ordering import attach, number_rows, running_total
from calib.session import materialize

WEIGHTS = (5, 2, 1)
MOST = 3
FILLS = 3
SEED = 7
#: Per place in WEIGHTS, (time, relative weight): heavy sources fade, light ones rise.
SCHEDULES = (
    ((0.0, 1.3), (0.5, 1.1), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.4), (0.5, 0.8), (1.0, 2.0)),
)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST
                   ) -> DataFrame:
    """(source, place, source_size, target) from documents (source, size).

    Sharing the excess again until none is left fills sources in the order of cap per
    weight: those below a common level take their cap, the others level times weight.
    """
    totals = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    # NULL sorts last: rows are ordered by (is null, source), strings by code point.
    ranked = _ranked(totals, len(weights))
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("place"))
    rows = ranked.withColumns({"weight": weight, "cap": F.col("source_size") * F.lit(float(most)),
                               "__one": F.lit(0)})
    rows = rows.withColumn("ratio", F.col("cap") / F.col("weight"))
    order = ["ratio", "__last", "__name"]
    summed = running_total(running_total(rows, ["__one"], order, "cap", "caps"),
                           ["__one"], order, "weight", "weights")
    summed = materialize(summed, "ranked")
    whole = summed.agg(F.sum("source_size").alias("t"), F.sum("weight").alias("w")).first()
    total, all_weights = float(whole["t"] or 0), float(whole["w"] or 0)
    # A source takes its cap when the level that would fit all from it on is not below it.
    before_caps = F.col("caps") - F.col("cap")
    rest = F.lit(all_weights) - F.col("weights") + F.col("weight")
    level = (F.lit(total) - before_caps) / rest
    summed = materialize(summed.withColumn("full", F.col("ratio") <= level), "levels")
    capped = summed.where("full").agg(F.sum("cap").alias("c"), F.sum("weight").alias("w")).first()
    left = total - float(capped["c"] or 0)
    share = all_weights - float(capped["w"] or 0)
    level = left / share if share > 0 else 0.0
    return summed.select("source", "place", "source_size", F.when(
        F.col("full"), F.col("cap")).otherwise(F.col("weight") * F.lit(level)).alias("target"))


def _ranked(totals: DataFrame, cycle: int) -> DataFrame:
    rows = totals.withColumns({"__one": F.lit(0), "__last": F.col("source").isNull(),
                               "__name": F.coalesce("source", F.lit(""))})
    rows = number_rows(rows, ["__one"], ["__last", "__name"], "__n")
    return rows.withColumn("place", ((F.col("__n") - 1) % cycle).cast("int")).drop("__n", "__one")


def schedule_segments(schedules: Sequence[Sequence[tuple[float, float]]]) -> Column:
    """Per schedule an array of segments: t0, t1, weight at both, integral before, scaled."""
    out = []
    for knots in schedules:
        area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
        done = 0.0
        segments = []
        for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
            w0, w1 = w0 / area, w1 / area
            segments.append(F.struct(*[F.lit(float(v)).alias(n) for n, v in (
                ("t0", t0), ("t1", t1), ("w0", w0), ("w1", w1), ("done", done))]))
            done += (t1 - t0) * (w0 + w1) / 2
        out.append(F.array(*segments))
    return F.array(*out)


def time_of(share: Column, segments: Column) -> Column:
    """The time at which a schedule's integral reaches ``share`` of its whole."""
    s = F.element_at(F.filter(segments, lambda g: g["done"] <= share), -1)
    rest = share - s["done"]
    slope = (s["w1"] - s["w0"]) / (s["t1"] - s["t0"])
    # Root of slope/2 x^2 + w0 x = rest in the form that also holds for slope 0.
    root = F.sqrt(F.greatest(s["w0"] * s["w0"] + slope * rest * 2, F.lit(0.0)))
    return F.least(s["t0"] + F.when(rest <= 0, F.lit(0.0)).otherwise(
        rest * 2 / (s["w0"] + root)), s["t1"])


def _filled(rows: DataFrame, most: int) -> DataFrame:
    """Per source one further copy: the one whose size is nearest to what is missing."""
    gaps = rows.groupBy("source").agg(
        F.max("target").alias("t"), F.sum(F.col("copies") * F.col("size")).alias("w")).select(
        F.col("source").alias("s"), (F.col("t") - F.col("w")).alias("gap"))
    near = F.abs(F.col("size") - F.col("gap"))
    last = rows.where((F.col("copies") < most) & (F.col("size") > 0)).join(
        gaps, F.col("source").eqNullSafe(F.col("s"))).where(near < F.col("gap")).groupBy("s").agg(
        F.min(F.struct(near.alias("d"), "__end"))["__end"].alias("last"))
    chosen = (F.col("size") > 0) & F.coalesce(F.col("__end") == F.col("last"), F.lit(False))
    return rows.join(last, F.col("source").eqNullSafe(F.col("s")), "left").withColumn(
        "copies", F.col("copies") + chosen.cast("int")).drop("s", "last")


def _missed(rows: DataFrame) -> DataFrame:
    """(source) of those farther from their target than FILLS documents of mean size."""
    sums = rows.groupBy("source").agg(
        F.max("target").alias("t"), F.sum(F.col("copies") * F.col("size")).alias("w"),
        F.sum("size").alias("all"), F.count_if(F.col("size") > 0).alias("n"))
    return sums.where(F.abs(F.col("t") - F.col("w")) * F.col("n") > F.col("all") * FILLS).select("source")


def _in_rounds(rows: DataFrame, most: int) -> DataFrame:
    """``copies`` taken anew: what does not fit is skipped, not the end of the source."""
    columns = rows.columns
    while True:
        gaps = rows.groupBy("source").agg((F.max("target") - F.sum(
            F.col("copies") * F.col("size"))).alias("__gap"))
        fits = (F.col("copies") < most) & (F.col("size") > 0) & (F.col("size") <= F.col("__gap"))
        known = materialize(attach(rows, gaps, ["source"]).withColumn("__fits", fits), "fits")
        if known.where("__fits").isEmpty():
            return materialize(_filled(rows, most), "copies")
        next_end = F.col("copies") * F.col("source_size") + F.col("__end")
        run = running_total(known.where("__fits").withColumn("__next", next_end), ["source"], ["__next"],
                            "size", "__sum")
        run = run.withColumn("copies", F.col("copies") + (F.col("__sum") <= F.col("__gap")).cast("int"))
        rows = materialize(run.select(*columns).unionByName(
            known.where("NOT __fits").select(*columns)), "copies")


def _middles_of_taken(rows: DataFrame) -> DataFrame:
    """``__middles`` on the axis of the copies taken, in the order of their ends."""
    taken = rows.where("copies > 0").select(
        "source", "source_size", "size", "__end", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("k"))
    taken = materialize(taken.withColumn("__axis", F.col("k") * F.col("source_size") + F.col("__end")), "taken")
    upto = running_total(taken, ["source"], ["__axis"], "size", "__upto")
    found = upto.groupBy("source", "__end").agg(F.array_sort(F.collect_list(
        F.col("__upto") - F.col("size") / 2)).alias("__middles"))
    left, right = rows.alias("d"), found.alias("m")
    # Rows without words share the end of the row before; they have no copies.
    same = F.col("d.source").eqNullSafe(F.col("m.source")) & (F.col("d.__end") == F.col("m.__end")) & (
        F.col("d.size") > 0)
    return left.join(right, same, "left").select(
        "d.*", F.coalesce("m.__middles", F.array().cast("array<double>")).alias("__middles"))


def mix_plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST,
             schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES, seed: int = SEED,
             key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, copies, taken, positions."""
    sized = materialize(docs.select(
        F.col(f"`{key}`").cast("long").alias("doc_id"),
        F.col(f"`{source}`").cast("string").alias("source"),
        word_count(F.col(f"`{text}`").cast("string")).alias("size")), "sizes")
    targets = materialize(source_targets(sized, weights, most), "targets")
    digest = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(
        F.col("doc_id").cast("string"), F.lit(""))).cast("binary")), 1, 15)
    drawn = sized.withColumn("__draw", F.conv(digest, 16, 10).cast("long"))
    run = running_total(drawn, ["source"], ["__draw", "doc_id", "size"], "size", "__end")
    rows = run.alias("d").join(targets.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select(
        "d.doc_id", "d.source", "d.size", "d.__end", "s.place", "s.source_size", "s.target")
    epochs = F.array(*[F.lit(k) for k in range(most)])
    ends = F.transform(epochs, lambda k: k * F.col("source_size") + F.col("__end"))
    whole = F.size(F.filter(ends, lambda e: (e <= F.col("target")) & (F.col("size") > 0)))
    rows = materialize(rows.withColumns({"copies": whole, "__whole": whole}), "copies")
    for _ in range(FILLS):
        rows = materialize(_filled(rows, most), "copies")
    middles = F.transform(F.slice(epochs, F.lit(1), F.col("copies")),
                          lambda k: k * F.col("source_size") + F.col("__end") - F.col("size") / 2)
    missed = materialize(_missed(rows), "missed")
    if missed.isEmpty():
        rows = rows.withColumn("__middles", middles)
    else:
        marked = attach(rows, missed.withColumn("__missed", F.lit(True)), ["source"])
        again = materialize(marked.where("__missed").drop("__missed").withColumn(
            "copies", F.col("__whole")), "missed")
        rows = marked.where("__missed IS NULL").drop("__missed").withColumn(
            "__middles", middles).unionByName(_middles_of_taken(_in_rounds(again, most)))
    segments = F.get(schedule_segments(schedules), F.col("place"))
    return rows.withColumn("__segments", segments).select(
        "doc_id", "source", "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"),
        F.transform("__middles", lambda m: time_of(F.least(m / F.col("target"), F.lit(1.0)), F.col("__segments"))).alias(
            "positions"))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options
          ) -> DataFrame:
    """``docs`` in training order: each row once per copy taken, range-sorted by position.

    Rows that repeat a key are told apart by their size, source and place among equals.
    """
    plan = mix_plan(docs, key=key, text=text, source=source, **options)
    names = {c: f"__{k}" for k, c in enumerate(docs.columns)}
    on = ["__key", "__source", "__size"]
    rows = docs.select(
        *[F.col(f"`{c}`").alias(n) for c, n in names.items()],
        F.col(f"`{key}`").cast("long").alias("__key"), F.col(f"`{source}`").cast("string").alias("__source"),
        word_count(F.col(f"`{text}`").cast("string")).alias("__size"))
    plan = materialize(plan.select(F.col("doc_id").alias("__key"), F.col("source").alias("__source"),
                                   F.col("size").alias("__size"), "positions"), "plan")
    twins = materialize(plan.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*on), "twins")

    def joined(left: DataFrame, right: DataFrame, cols: Sequence[str], how: str = "inner") -> DataFrame:
        met = left.alias("d").join(right.alias("p"), [F.col(f"d.{c}").eqNullSafe(F.col(f"p.{c}")) for c in cols], how)
        return met if how.startswith("left") else met.select("d.*", *[
            F.col(f"p.{c}") for c in right.columns if c not in cols])

    # Texts are shuffled once to meet their positions; only twins are numbered among themselves.
    if twins.isEmpty():
        met = joined(rows, plan, on)
    else:
        by = Window.partitionBy(*on)
        number = lambda df, order: df.withColumn("__twin", F.row_number().over(by.orderBy(order)))
        again = joined(number(joined(rows, twins, on, "left_semi"), "__size"),
                       number(joined(plan, twins, on, "left_semi"), "positions"), [*on, "__twin"]).drop("__twin")
        met = joined(rows, joined(plan, twins, on, "left_anti"), on).unionByName(again)
    copies = met.where("size(positions) > 0").withColumn("__at", F.explode("positions"))
    return copies.orderBy("__at", "__key").select(*[F.col(n).alias(c) for c, n in names.items()])
