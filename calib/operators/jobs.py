"""Job states, campaign results and completeness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calib.operators.ordering import attach

# Queue states.
PENDING = ("PD", "CF", "CONFIGURING")
RUNNING = ("R", "CG", "COMPLETING", "S", "ST", "STOPPED")


def state_class(state: Column) -> Column:
    return F.when(state.isin(*PENDING), "pending").when(state.isin(*RUNNING), "running").otherwise(
        "unknown")


def latest_states(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Last state per job; ``events``: job_id, state, ts."""
    return events.groupBy(*keys, "job_id").agg(F.max_by("state", "ts").alias("state"))


def job_state_counts(submitted: DataFrame, queue: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Submitted, pending, running, finished, active and unknown counts.

    ``submitted``: job_id; ``queue``: raw_id, state.  Array tasks ``12_3`` belong to job 12;
    an id that is not a number counts as unknown.
    """
    keys = list(keys)
    rows = queue.withColumn(
        "job_id", F.expr("try_cast(trim(element_at(split(raw_id, '_'), 1)) AS BIGINT)"))
    known = rows.join(submitted.select(*keys, "job_id").distinct(), [*keys, "job_id"], "left_semi")
    broken = rows.where(F.col("job_id").isNull())
    kind = F.when(F.col("job_id").isNull(), "unknown").otherwise(state_class(F.trim("state")))
    states = known.unionByName(broken).withColumn("__k", kind).groupBy(*keys).agg(
        *[F.count_if(F.col("__k") == k).alias(k) for k in ("pending", "running", "unknown")],
        F.count_distinct("job_id").alias("__seen"))
    totals = submitted.groupBy(*keys).agg(F.count(F.lit(1)).alias("submitted"),
                                          F.count_distinct("job_id").alias("__ids"))
    rows = attach(totals, states, keys)
    n = {k: F.coalesce(k, F.lit(0)) for k in ("pending", "running", "unknown", "__seen")}
    return rows.select(
        *keys, "submitted", n["pending"].alias("pending"), n["running"].alias("running"),
        F.greatest(F.col("__ids") - n["__seen"], F.lit(0)).alias("finished"),
        (n["pending"] + n["running"] + n["unknown"]).alias("active"), n["unknown"].alias("unknown"))


def merge_results(samples: DataFrame, results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sample records with the result's status and outputs where it has them.

    Status falls back to the sample's, then to ``failed``.
    """
    r = results.select(*keys, F.col("status").alias("__status"), F.col("outputs").alias("__outputs"))
    return samples.join(r, list(keys), "left").withColumns({
        "status": F.coalesce("__status", "status", F.lit("failed")),
        "outputs": F.coalesce("__outputs", "outputs")}).drop("__status", "__outputs")


def completeness(samples: DataFrame, systems: DataFrame, outputs: DataFrame,
                 keys: Sequence[str] = ("campaign",)) -> DataFrame:
    """Per sample: expected and found outputs, missing systems, and whether it is complete.

    ``systems``: keys, system_id; ``outputs``: keys, sample_id, system_id, trajectory.
    """
    keys = list(keys)
    wanted = systems.groupBy(*keys).agg(F.array_sort(F.collect_set("system_id")).alias("__wanted"))
    found = outputs.groupBy(*keys, "sample_id").agg(
        F.count(F.lit(1)).alias("__n"), F.count("trajectory").alias("__files"),
        F.collect_set(F.when(F.col("trajectory").isNotNull(), F.col("system_id"))).alias("__have"))
    rows = attach(attach(samples.select(*keys, "sample_id"), wanted, keys), found,
                  [*keys, "sample_id"])
    have = F.coalesce("__have", F.array().cast("array<string>"))
    expected = F.size("__wanted")
    return rows.select(
        *keys, "sample_id", expected.cast("long").alias("expected"),
        F.coalesce("__n", F.lit(0)).alias("found"),
        F.array_join(F.array_except("__wanted", have), ",").alias("missing"),
        ((F.coalesce("__n", F.lit(0)) == expected) & (F.coalesce("__files", F.lit(0)) == expected)
         ).alias("complete"))


def completed_runs(frames: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs with at least max(1, n_steps // stride + 1) frames; unknown stride is not complete.

    ``frames``: keys, frame; ``targets``: keys, n_steps, stride.
    """
    counted = frames.groupBy(*keys).agg(F.count_distinct("frame").alias("n_frames"))
    rows = attach(targets, counted, list(keys))
    need = F.greatest(F.lit(1), F.floor(F.try_divide("n_steps", "stride")) + 1)
    usable = F.coalesce(F.col("stride") > 0, F.lit(False)) & F.col("n_steps").isNotNull()
    have = F.coalesce("n_frames", F.lit(0))
    return rows.select(*keys, have.alias("n_frames"),
                       (usable & F.coalesce(have >= need, F.lit(False))).alias("complete"))


def throughput(marks: DataFrame, keys: Sequence[str], seconds: int, total: int | None = None
               ) -> DataFrame:
    """Steps per second in each time window; with ``total``, also the time left.

    ``marks``: keys, ts; one row per step.  The time left at the end of a window follows
    from the mean pace since the first step: elapsed / done * (total - done), 0 when done.
    """
    keys = list(keys)
    rows = marks.groupBy(*keys, F.window("ts", f"{seconds} seconds").alias("w")).agg(
        F.count(F.lit(1)).alias("steps"), F.min("ts").alias("__first"), F.max("ts").alias("__last"))
    rate = (F.col("steps") / float(seconds)).alias("rate")
    if total is None:
        return rows.select(*keys, F.col("w.start").alias("window_start"), "steps", rate)
    so_far = Window.partitionBy(*keys).orderBy("w").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"done": F.sum("steps").over(so_far), "__begin": F.min("__first").over(so_far)})
    elapsed = F.unix_micros(F.col("__last").cast("timestamp")) - F.unix_micros(
        F.col("__begin").cast("timestamp"))
    left = F.greatest(F.lit(total) - F.col("done"), F.lit(0))
    return rows.select(*keys, F.col("w.start").alias("window_start"), "steps", rate, "done",
                       (elapsed / 1e6 / F.col("done") * left).alias("eta_seconds"))
