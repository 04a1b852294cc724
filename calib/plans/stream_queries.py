"""Streaming reports run to the end of the given tables, and the routine registry."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from calib import registry
from calib.operators.ordering import attach
from calib.plans.base import EVENT_DRAWS, SQL, atoms, event_draws, query, r, rounded, table
from calib.plans.chain_queries import RANK_RHAT, _tau_ctes
from calib.plans.collect_queries import (
    JOB_COUNTS, STATE_OF, STATES_SQL, energy_logs, job_events, log_id, write_logs,
)
from calib.plans.curve_queries import BONDS, TRIPLES, _profile_ctes, _smooth_sql, bonds
from calib.session import materialize, scratch_dir
from calib.sources.text import HARTREE_TO_EV
from calib.streaming import reports, state


def event_stream(spark, sf_dir):
    return reports.stream_parquet(spark, sf_dir, "events.parquet")


@query("r1_collected_outputs", f"""
SELECT o_orderkey::VARCHAR AS path,
       {r(f'CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE -o_totalprice END * {HARTREE_TO_EV!r}::DOUBLE', 4)} AS energy_ev,
       NULL::VARCHAR AS issue FROM orders""")
def r1_collected_outputs(spark, sf_dir):
    path = f"{scratch_dir(spark)}/logs-{uuid.uuid4().hex}"
    energy_logs(spark, sf_dir).select("path", "value").write.parquet(path)
    return rounded(reports.drain(reports.collected_energies(reports.stream_parquet(spark, path))), 4)


@query("r1_streamed_files", SQL["s6_split_log_energies"].replace("AS energy_ev", "AS energy_ev, NULL::VARCHAR AS issue"))
def r1_streamed_files(spark, sf_dir):
    """The files of sixteen logs as they appear, a quarter a batch."""
    path = write_logs(spark, energy_logs(spark, sf_dir), "o_orderkey")
    files = len(spark.read.text(path).inputFiles())
    stream = reports.stream_files(spark, path, "*.txt", files=max(4, -(-files // 4)))
    return rounded(log_id(reports.first_energies(reports.drain(reports.collected_energies(stream)))), 4)


@query("r2_running_moments", f"""
SELECT event_type, 'a' AS param_i, 'b' AS param_j, count(*) AS n, {r('covar_samp(value, hour(ts))', 5)} AS cov FROM events GROUP BY event_type
UNION ALL SELECT event_type, 'b', 'a', count(*), {r('covar_samp(value, hour(ts))', 5)} FROM events GROUP BY event_type
UNION ALL SELECT event_type, 'a', 'a', count(*), {r('var_samp(value)', 5)} FROM events GROUP BY event_type
UNION ALL SELECT event_type, 'b', 'b', count(*), {r('var_samp(hour(ts))', 5)} FROM events GROUP BY event_type""")
def r2_running_moments(spark, sf_dir):
    draws = event_stream(spark, sf_dir).select(
        "event_type", F.col("value").alias("a"), F.hour("ts").cast("double").alias("b"))
    moments = reports.drain(reports.running_moments(draws, ["event_type"], ["a", "b"]), "complete")
    return rounded(reports.moments_covariance(moments, ["event_type"], ["a", "b"]), 5)


@query("r3_convergence_stream", f"""
WITH {EVENT_DRAWS}, {RANK_RHAT}, {_tau_ctes('ranked')}
SELECT 'r1' AS run_id, param, (SELECT max(step) + 1 FROM draws) AS n_steps, (SELECT count(*) FROM draws) AS n_draws,
       {r('greatest(a.rhat, b.rhat)')} AS rhat, {r('(SELECT avg(tau) FROM tau)')} AS tau,
       {r('(SELECT count(*) FROM draws) / (SELECT avg(tau) FROM tau)', 4)} AS ess,
       {r('greatest(a.rhat, b.rhat)')} AS max_rhat, {r('(SELECT count(*) FROM draws) / (SELECT avg(tau) FROM tau)', 4)} AS min_ess,
       (SELECT max(step) + 1 FROM draws) >= 20 AND greatest(a.rhat, b.rhat) < 1.02
         AND (SELECT count(*) FROM draws) / (SELECT avg(tau) FROM tau) > 100 AS converged
FROM rhat_a a JOIN rhat_b b USING (param)""")
def r3_convergence_stream(spark, sf_dir):
    base = f"{scratch_dir(spark)}/convergence-{uuid.uuid4().hex}"
    draws = event_draws(spark, sf_dir).withColumn("run_id", F.lit("r1"))
    steps = draws.agg(F.max("step") + 1).first()[0]
    for k in range(3):
        draws.where(F.floor(F.col("step") * 3 / steps) == k).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = reports.stream_parquet(spark, f"{base}/in", files=1)
    reports.convergence_stream(
        stream, f"{base}/draws", f"{base}/reports", f"{base}/cp", rhat_max=1.02).awaitTermination()
    rows = reports.latest_reports(spark, f"{base}/reports")
    return rounded(rounded(rows, 6, ["rhat", "tau", "max_rhat"]), 4, ["ess", "min_ess"])


@query("r4_job_state_stream", f"WITH {JOB_COUNTS}")
def r4_job_state_stream(spark, sf_dir):
    state = F.create_map(*[F.lit(v) for kv in STATE_OF.items() for v in kv])
    events = event_stream(spark, sf_dir).select(
        F.col("user_id").alias("job_id"), F.try_element_at(state, F.col("event_type")).alias("state"), "ts")
    return reports.job_report(reports.drain(reports.latest_state_stream(events), "complete"))


def in_order(spark, rows, closing=None):
    """Rows (ts, ...) as three parquet files, one after another in time, and one of ``closing`` rows."""
    path = f"{scratch_dir(spark)}/in-order-{uuid.uuid4().hex}"
    first, last = rows.agg(F.min("ts"), F.max("ts")).first()
    third = (last - first) / 3
    place = F.when(F.col("ts") < F.lit(first + third), 0).when(F.col("ts") < F.lit(first + 2 * third), 1).otherwise(2)
    for k in range(3):
        rows.where(place == k).coalesce(1).write.mode("append").parquet(path)
    if closing is not None:
        closing.coalesce(1).write.mode("append").parquet(path)
    return reports.stream_parquet(spark, path, files=1)


WAIT_DAYS = 5


@query("r4_expiring_jobs", f"""
WITH e AS (SELECT user_id AS job_id, arg_max_null({STATES_SQL}, ts) AS state, max(ts) AS ts FROM events GROUP BY user_id),
c AS (SELECT count(*) FILTER (state IS NOT NULL AND ts + INTERVAL {WAIT_DAYS} DAY > (SELECT max(ts) FROM events)) AS waiting,
             count(*) FILTER (state IS NOT NULL AND ts + INTERVAL {WAIT_DAYS} DAY <= (SELECT max(ts) FROM events)) AS expired FROM e),
r AS (WITH {JOB_COUNTS})
SELECT * FROM r, c""")
def r4_expiring_jobs(spark, sf_dir):
    """Job counts over three batches, with the jobs still in the state and those that were dropped."""
    changes = reports.drain(state.job_changes(in_order(spark, job_events(spark, sf_dir)), WAIT_DAYS * 86_400), "update")
    latest = materialize(state.latest_changes(changes), "latest")
    held = latest.where("state IS NOT NULL").agg(
        F.count_if(~F.col("expired")).alias("waiting"), F.count_if("expired").alias("expired"))
    return attach(reports.job_report(latest), held, [])


@query("r5_missing_outputs", """
WITH e AS (SELECT user_id, ts FROM events WHERE event_type = 'click'),
a AS (SELECT user_id, ts FROM events WHERE event_type = 'purchase')
SELECT user_id, ts AS expected_at FROM e
WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.user_id = e.user_id AND a.ts BETWEEN e.ts AND e.ts + INTERVAL 3 DAY)
  AND ts + INTERVAL 3 DAY < (SELECT least((SELECT max(ts) FROM e), (SELECT max(ts) FROM a)))""")
def r5_missing_outputs(spark, sf_dir):
    e = event_stream(spark, sf_dir).where("event_type = 'click'").select("user_id", "ts")
    a = event_stream(spark, sf_dir).where("event_type = 'purchase'").select("user_id", "ts")
    rows = reports.drain(reports.missing_outputs(e, a, ["user_id"], "3 DAYS"))
    return rows.withColumn("expected_at", F.col("expected_at").cast("timestamp_ntz"))


@query("r6_throughput_stream", f"""
SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS steps,
       {r('count(*) / 86400.0::DOUBLE', 8)} AS rate FROM events GROUP BY ALL""")
def r6_throughput_stream(spark, sf_dir):
    marks = event_stream(spark, sf_dir).select("event_type", "ts")
    rows = reports.drain(reports.throughput_stream(marks, ["event_type"], 86400), "complete")
    return rounded(rows.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")), 8)


@query("r6_time_left_stream", SQL["w13_time_left"])
def r6_time_left_stream(spark, sf_dir):
    """Closed windows over three batches; a later mark of no run closes the last ones."""
    marks = table(spark, sf_dir, "events").select("event_type", "ts")
    end = marks.agg((F.max("ts") + F.expr("INTERVAL 3 DAYS")).alias("ts")).select(F.lit("~").alias("event_type"), "ts")
    rows = reports.drain(state.time_left_stream(in_order(spark, marks, end), ["event_type"], 86400, 5000))
    rows = rows.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
    return rounded(rounded(rows, 8, ["rate"]), 3, ["eta_seconds"])


@query("x1_named_routine", f"""
WITH {_profile_ctes(60, 6.0, "mass > 0.5", "resname = 'SOL' AND element = 'O'")},
{_smooth_sql('profile', 'label', 60)}
SELECT 'rdf' AS qoi, label, bin, {r('value')} AS value FROM smooth""")
def x1_named_routine(spark, sf_dir):
    return rounded(registry.run_routines(atoms(spark, sf_dir), [
        ("rdf", dict(solute="resname = 'MOL'", solvent="resname = 'SOL' AND element = 'O'",
                     r_range=(0.0, 6.0), n_bins=60))]))


@query("x2_routine_merge", f"""
WITH {_profile_ctes(60, 6.0, "mass > 0.5", "resname = 'SOL' AND element = 'O'")},
{_smooth_sql('profile', 'label', 60)}, {BONDS}, {TRIPLES},
hits AS (SELECT dres || '(' || dtyp || ') to ' || ares || '(' || atyp || ')' AS label, count(*) AS c
         FROM triples WHERE angle > 150 AND hres <> ares GROUP BY ALL),
labels AS (
  SELECT DISTINCT d.resname || '(' || d.type || ') to ' || a.resname || '(' || a.type || ')' AS label
  FROM (SELECT DISTINCT d.resname, d.type, h.resname AS side FROM atoms d
        JOIN bonds ON b = d.atom_id JOIN atoms h ON h.atom_id = bonds.a) d,
       (SELECT DISTINCT resname, type FROM atoms WHERE element = 'O') a WHERE a.resname <> d.side)
SELECT 'rdf' AS qoi, label, bin, {r('value')} AS value FROM smooth
UNION ALL SELECT 'hb', label, 0, {r('coalesce(c, 0) / (SELECT count(DISTINCT frame) FROM atoms)')}
FROM labels LEFT JOIN hits USING (label)""")
def x2_routine_merge(spark, sf_dir):
    rows = registry.run_routines(atoms(spark, sf_dir), [
        ("rdf", dict(solute="resname = 'MOL'", solvent="resname = 'SOL' AND element = 'O'",
                     r_range=(0.0, 6.0), n_bins=60)),
        ("hb", dict(bonds=bonds(spark, sf_dir), solute="resname = 'MOL'", solvent="resname = 'SOL'"))])
    return rounded(rows)
