"""Stateful streams over several batches, and what is left in their state."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from calib.operators import groups, jobs
from calib.streaming import reports, state

START = dt.datetime(2024, 1, 1)


def files(spark, path, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return reports.stream_parquet(spark, path, files=1)


def at(minute):
    return START + dt.timedelta(minutes=minute)


def test_jobs_expire(spark, tmp_path):
    batches = [[(1, "PD", at(0)), (2, "R", at(1)), (3, "R", at(2))],
               [(1, "R", at(10)), (3, None, at(12)), (4, "PD", at(13)), (4, "R", at(14)), (9, "R", at(15))],
               [(1, "CG", at(30)), (5, "R", at(31))],
               [(5, "R", at(45))]]
    stream = files(spark, f"{tmp_path}/in", batches, "job_id long, state string, ts timestamp")
    checkpoint = f"{tmp_path}/cp"
    changes = reports.drain(state.job_changes(stream, 600), "update", checkpoint).collect()
    seen = {(r["job_id"], r["state"], r["expired"]) for r in changes}
    # 2 was silent for ten minutes, 4 and 9 as well; 3 left by itself; 1 expired at minute 40.
    assert {j for j, _, gone in seen if gone} == {1, 2, 4, 9}
    assert (3, None, False) in seen and (1, "CG", True) in seen
    held = spark.read.format("statestore").option("stateVarName", "latest").load(checkpoint)
    assert [r["key"]["job_id"] for r in held.collect()] == [5]


def test_counts_equal_the_batch_report(spark, tmp_path):
    rows = [(k % 7, ["PD", "R", "F", None, "CG"][(k * k) % 5], at(k)) for k in range(60)]
    schema = "job_id long, state string, ts timestamp"
    stream = files(spark, f"{tmp_path}/in", [rows[:20], rows[20:40], rows[40:]], schema)
    latest = state.latest_changes(reports.drain(state.job_changes(stream, 3600), "update"))
    got = reports.job_report(latest).collect()
    want = reports.job_report(jobs.latest_states(spark.createDataFrame(rows, schema))).collect()
    assert got == want


def test_late_rows_do_not_replace_newer_ones(spark, tmp_path):
    batches = [[(1, "R", at(5))], [(1, "PD", at(1)), (2, "PD", at(6))]]
    stream = files(spark, f"{tmp_path}/in", batches, "job_id long, state string, ts timestamp")
    latest = state.latest_changes(reports.drain(state.job_changes(stream, 3600, "1 hour"), "update"))
    assert {(r["job_id"], r["state"]) for r in latest.collect()} == {(1, "R"), (2, "PD")}


@pytest.mark.parametrize("cuts", [(20, 40), (7, 8), (59, 60)])
def test_time_left_over_batches(spark, tmp_path, cuts):
    rows = [(f"r{k % 3}", at(k * 7)) for k in range(90)]
    a, b = cuts
    batches = [c for c in (rows[:a], rows[a:b], rows[b:], [("end", at(90 * 7 + 500))]) if c]
    stream = files(spark, f"{tmp_path}/in", batches, "run string, ts timestamp")
    got = reports.drain(state.time_left_stream(stream, ["run"], 3600, 25, "10 minutes"))
    want = jobs.throughput(spark.createDataFrame(rows, "run string, ts timestamp"), ["run"], 3600, total=25)
    key = lambda df: sorted((r["run"], r["window_start"], r["steps"], r["done"], round(r["eta_seconds"], 6))
                            for r in df.collect())
    assert key(got) == key(want)


# -- hierarchy of selections ---------------------------------------------------

def relations(spark, members):
    rows = [(s, c, a) for (s, c), atoms in members.items() for a in atoms]
    return groups.overlap_classes(spark.createDataFrame(rows, "system string, cid int, atom_id int"), ["system"])


def test_direct_parents(spark):
    found = relations(spark, {("s", 1): range(12), ("s", 2): range(6), ("s", 3): range(3), ("s", 4): range(8, 10),
                              ("s", 5): range(20, 22), ("t", 3): range(2), ("t", 6): range(1)})
    got = {(r["cid"], r["parent"], r["depth"]) for r in groups.hierarchy(found).collect()}
    # 6 meets 3 only in t, and lies inside 2 and 1 by way of it.
    assert got == {(1, None, 0), (2, 1, 1), (3, 2, 2), (4, 1, 1), (5, None, 0), (6, 3, 3)}
    assert groups.hierarchy_contradictions(found).count() == 0


def test_contradictions_through_other_selections(spark):
    found = relations(spark, {("s", 1): range(9), ("s", 2): range(4), ("t", 2): range(4), ("t", 3): range(2),
                              ("u", 1): range(5), ("u", 3): range(5, 7), ("v", 3): range(6), ("v", 4): range(2),
                              ("w", 4): range(5), ("w", 2): range(3)})
    got = {(r["child"], r["parent"], r["relation"]) for r in groups.hierarchy_contradictions(found).collect()}
    # 3 in 2 in 1, but apart in u; 2 in 4 in 3 in 2 is a circle.
    assert (3, 1, "disjoint") in got
    assert {c for c, p, r in got if r == "inside itself"} == {2, 3, 4}
