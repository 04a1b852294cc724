"""Text formats, records, jobs, sinks, streams and the registry on literal examples."""

import json
import math

import pytest
from pyspark.sql import functions as F

from calib import registry
from calib.operators import align, chains, groups, jobs
from calib.sources import sinks, tables, text
from calib.streaming import reports


def files(spark, **named):
    return spark.createDataFrame(list(named.items()), "path string, value string")


ENERGY = " ENERGY| Total FORCE_EVAL ( QS ) energy [a.u.]:                -3.250000\n"


def test_energy(spark):
    got = text.energies(files(spark, a=f"x\n{ENERGY}tail\n", b="nothing")).orderBy("path").collect()
    assert math.isclose(got[0]["energy_ev"], -3.25 * 27.211386245988) and got[1]["energy_ev"] is None


def test_piped_and_table_forces(spark):
    unit = 27.211386245988 / 0.529177210903
    piped = " FORCES| Atom x y z\n FORCES| 1 0.4 -0.7 0.9 1.2\n"
    table = lambda v: (f" ATOMIC FORCES in [a.u.]\n\n # Atom Kind Element X Y Z\n      1      1      H   {v}   0.0   0.0\n"  # noqa: E731
                       f" SUM OF ATOMIC FORCES   {v} 0.0 0.0 {v}\n")
    got = {r["path"]: r for r in text.forces(files(
        spark, p=piped, t=table(0.1) + table(0.2), e=table(0.3) + " ATOMIC FORCES\n SUM OF ATOMIC FORCES\n")).collect()}
    assert math.isclose(got["p"]["fz"], 0.9 * unit)
    assert math.isclose(got["t"]["fx"], 0.2 * unit)
    assert math.isclose(got["e"]["fx"], 0.3 * unit)


FRAME = '2\nLattice="9 0 0 0 9 0 0 0 9" pbc="T T F" energy=-1.5e2 source="md"\nO 0 0 0 1 2 3\nH 1 0 0 {}\n'


def test_frames_and_forces_rule(spark):
    got = {r["path"]: r for r in text.extxyz_frames(files(
        spark, full=FRAME.format("4 5 6"), bare=FRAME.format(""), plain="1\n\nHe 1 2 3")).collect()}
    assert got["full"]["atoms"][1]["fz"] == 6.0 and got["full"]["energy"] == -150.0
    assert got["bare"]["atoms"][0]["fx"] is None and got["full"]["pbc"] == "T T F"
    assert got["plain"]["lattice"] is None and got["plain"]["energy"] is None
    with pytest.raises(Exception, match="9 values"):
        text.extxyz_frames(files(spark, a='1\nLattice="1 2"\nO 0 0 0')).collect()
    with pytest.raises(Exception, match="invalid atom line"):
        text.extxyz_frames(files(spark, a="1\n\nO 0 0")).collect()


def test_last_frame_and_compound(spark):
    trj = "1\ni = 0\nH 0 0 0\n1\ni = 1\nH 0.1 0.2 0.3\n"
    run = lambda v: spark.createDataFrame([("r", v)], "run string, value string")
    log = ENERGY + " FORCES| 1 0.4 -0.7 0.9 1.2\n"
    got = text.compound_frames(run('1\nLattice="5 0 0 0 5 0 0 0 5"\nH 0 0 0\n'), run(trj), run(log)).first()
    a = got["atoms"][0]
    assert (a["x"], a["y"], a["z"]) == (0.1, 0.2, 0.3) and got["source"] == "sp" and got["issue"] is None
    two = text.compound_frames(run("1\n\nH 0 0 0\n"), run(trj), run(log + " FORCES| 2 1 1 1 1\n")).first()
    assert two["issue"] == "forces do not match the atoms" and two["atoms"] is None
    good, bad = text.quarantine(text.compound_frames(run("1\n\nH 0 0 0\n"), run(trj), run("none")))
    assert good.count() == 0 and bad.first()["issue"] == "no energy"
    with pytest.raises(Exception, match="complete frame"):
        text.last_frame(files(spark, a="3\n\nH 0 0 0\n")).collect()


def test_extxyz_round_trip(spark, tmp_path):
    frames = text.extxyz_frames(files(spark, a=FRAME.format("4 5 -6.25e-7")))
    out = sinks.extxyz_text(frames)
    assert out.first()["value"].split("\n")[1] == (
        'Lattice="9.0000 0.0000 0.0000 0.0000 9.0000 0.0000 0.0000 0.0000 9.0000" pbc="T T F" '
        'Properties=species:S:1:pos:R:3:forces:R:3 energy=-150 source="md"')
    assert out.first()["value"].split("\n")[3] == "H 1 0 0 4 5 -6.25e-07"
    assert text.extxyz_frames(out).first()["atoms"] == frames.first()["atoms"]
    sinks.write_extxyz(frames, str(tmp_path / "f"))
    assert text.read_files(spark, str(tmp_path / "f"), "*.txt").count() == 1


@pytest.mark.parametrize("x", [0.1, -2.5, 1e-5, 123456789012345.0, 1 / 3, 0.0, 1e20, 100.0, 0.000123456789012345])
def test_general_number_text(spark, x):
    from calib.functions.expr import general
    assert spark.range(1).select(general(F.lit(x), 12)).first()[0] == f"{x:.12g}"


def test_atom_energies(spark):
    snap = spark.createDataFrame([("1", "1\n\nH 0 0 0"), ("2", "1\n\nCa 0 0 0")], "run string, value string")
    log = spark.createDataFrame([("1", ENERGY), ("2", ENERGY.replace("-3.25", "-6.5"))], "run string, value string")
    got = {r["number"]: r["energy_ev"] for r in text.atom_energies(snap, log).collect()}
    assert set(got) == {1, 20} and math.isclose(got[1], -3.25 * text.HARTREE_TO_EV)
    with pytest.raises(Exception, match="unsupported element"):
        text.atom_energies(snap.withColumn("value", F.lit("1\n\nXx 0 0 0")), log).collect()


def test_energies_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, -0.5), (20, -1.25)], "number int, energy_ev double")
    sinks.write_atom_energies(df, str(tmp_path / "e"))
    assert json.loads(spark.read.text(str(tmp_path / "e")).first()[0]) == {"1": -0.5, "20": -1.25}


def test_settings(spark):
    got = text.frame_targets(files(
        spark, a="; c\nnsteps = 5000\nnstxout-compressed=50\n\n", b="nstxout-compressed = 50\n")).orderBy("path")
    assert [tuple(r) for r in got.collect()] == [("a", 100, 50), ("b", None, None)]


def test_number_table(spark):
    lines = spark.createDataFrame([("# a b",), (" 997.0  44.0 2.30 # x",), ("",), ("4.0 0.25\t0.07",)], "value string")
    assert [tuple(r) for r in text.number_table(lines, ["a", "b", "c"]).collect()] == [
        (997.0, 44.0, 2.3), (4.0, 0.25, 0.07)]


def test_record_issues_and_missing_files(spark):
    doc = {"systems": [{}, {}], "samples": {
        "s1": {"status": "completed", "params": [1.0], "outputs": [
            {"system_id": "b", "trajectory": "t2"}, {"system_id": "a", "trajectory": "t1"}]},
        "s2": {"status": "completed", "params": [1.0], "outputs": [
            {"system_id": "b", "trajectory": "t2"}, {"system_id": "a", "trajectory": "gone"}]},
        "s3": "text", "s4": {"status": "running"}}}
    df = spark.createDataFrame([("c", json.dumps(doc))], "campaign string, json string")
    there = spark.createDataFrame([("c", "t1"), ("c", "t2")], "campaign string, trajectory string")
    judged = tables.judge_records(tables.campaign_records(df), there)
    got = {r["sample_id"]: r for r in judged.collect()}
    assert got["s1"]["issue"] is None and [o["system_id"] for o in got["s1"]["outputs"]] == ["a", "b"]
    assert got["s2"]["issue"] == "trajectories not found: gone" and "s4" not in got
    assert got["s3"]["issue"] == "the record is no map"
    with pytest.raises(ValueError, match="trajectories not found"):
        tables.require_clean(judged)


def test_dataset_issues(spark, tmp_path):
    rows = [{"name": n, "inputs": i, "outputs": o, "outputs_ref": r, "labels": lab, "values_per_label": v}
            for n, i, o, r, lab, v in (
        ("good", [[1.0]] * 2, [[1.0] * 4] * 2, [1.0] * 4, ["a", "b"], 2),
        ("rows", [[1.0]] * 2, [[1.0] * 4] * 3, [1.0] * 4, ["a", "b"], 2),
        ("width", [[1.0]], [[1.0] * 2], [1.0], ["a"], 1),
        ("labels", [[1.0]], [[1.0] * 3], [1.0] * 3, ["a"], 2),
        ("vpl", [[1.0]], [[1.0] * 3], [1.0] * 3, ["a"], 0))]
    path = tmp_path / "d.json"
    path.write_text("\n".join(map(json.dumps, rows)))
    data = tables.read_datasets(spark, str(path))
    assert {r["qoi"] for r in tables.dataset_issues(data).collect()} == {"rows", "width", "labels", "vpl"}
    assert tables.dataset_params(data.where("name = 'good'")).count() == 2


def test_job_counts(spark):
    ids = lambda *v: spark.createDataFrame([(i,) for i in v], "job_id long")
    queue = lambda *v: spark.createDataFrame(list(v), "raw_id string, state string")
    got = jobs.job_state_counts(ids(7001, 7002, 7003, 7004), queue(("7001", "PD"), ("7002", "R"), ("7003", "CG"))).first()
    assert got.asDict() == dict(submitted=4, pending=1, running=2, finished=1, active=3, unknown=0)
    got = jobs.job_state_counts(ids(7001, 7002), queue(("7001_1", "R"), ("7002", "R"))).first()
    assert (got["active"], got["finished"]) == (2, 0)
    got = jobs.job_state_counts(ids(1), queue(("x", "R"), ("1", "ODD"), ("99", "R"))).first()
    assert (got["unknown"], got["running"]) == (2, 0)


@pytest.mark.parametrize("frames,want", [(101, True), (100, False)])
def test_completion(spark, frames, want):
    f = spark.range(frames).select(F.lit("r").alias("run"), F.col("id").alias("frame"))
    t = spark.createDataFrame([("r", 50_000, 500), ("q", 10, None)], "run string, n_steps long, stride long")
    got = {r["run"]: r["complete"] for r in jobs.completed_runs(f, t, ["run"]).collect()}
    assert got == {"r": want, "q": False}


def test_learning_inputs(spark):
    m = spark.createDataFrame([("a", 2, 4, 2), ("b", 3, 4, 2), ("c", 2, 5, 2)],
                              "qoi string, n_inputs int, size int, n_curves int")
    assert {r["qoi"] for r in align.learning_violations(m, 2).collect()} == {"b", "c"}
    with pytest.raises(ValueError, match="b: number of inputs differs"):
        align.require_models(m, 2)
    with pytest.raises(ValueError, match="at least one"):
        align.require_models(m.limit(0), 2)
    with pytest.raises(Exception, match="does not match the reference size"):
        align.models_to_fit(m.select("qoi", "size"), spark.createDataFrame([("a", 9)], "qoi string, size int")).collect()


def test_set_differences_skip_dummies(spark):
    a = spark.createDataFrame([("X", 1.0), ("D", 0.1)], "type string, mass double")
    b = spark.createDataFrame([("X", 1.0), ("Y", 2.0)], "type string, mass double")
    got = groups.set_differences(a, b, ["type"]).collect()
    assert [(r["value"], r["side"]) for r in got] == [("Y", "right")]


# -- streams ---------------------------------------------------------------

def test_files_as_they_appear(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    (tmp_path / "in" / "r1").mkdir(parents=True)
    (tmp_path / "in" / "r1" / "sp.out").write_text(ENERGY)

    def run():
        q = reports.collected_energies(reports.stream_files(spark, src, "*.out")).writeStream.option(
            "checkpointLocation", cp).format("parquet").option("path", out).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.parquet(out)

    assert run().count() == 1
    (tmp_path / "in" / "r2").mkdir()
    (tmp_path / "in" / "r2" / "sp.out").write_text("nothing")
    got = run()
    assert got.count() == 2 and got.where("issue = 'no energy'").count() == 1


def test_convergence_stream_over_batches(spark, tmp_path):
    rows = spark.range(240).select(
        F.lit("r").alias("run_id"), (F.col("id") % 4).alias("chain"), F.floor(F.col("id") / 4).alias("step"),
        F.lit("p").alias("param"), F.sin(F.col("id") * 12.9898).alias("value"))
    base = str(tmp_path)
    for part in (rows.where("step < 30"), rows.where("step >= 30")):
        part.write.mode("append").parquet(f"{base}/in")
        reports.convergence_stream(reports.stream_parquet(spark, f"{base}/in"), f"{base}/d", f"{base}/r",
                                   f"{base}/cp").awaitTermination()
    got = reports.latest_reports(spark, f"{base}/r").first()
    want = chains.convergence_report(rows, ["run_id"]).first()
    assert got["n_steps"] == 60 and math.isclose(got["rhat"], want["rhat"]) and math.isclose(got["ess"], want["ess"])


def test_missing_outputs_agree_with_batch(spark, tmp_path):
    ts = lambda s: F.timestamp_seconds(F.lit(1_700_000_000) + s)
    e = spark.range(50).select(F.col("id").alias("k"), ts(F.col("id") * 60).alias("ts"))
    a = spark.range(50).where("id % 3 <> 0").select(
        F.col("id").alias("k"), ts(F.col("id") * 60 + F.when(F.col("id") % 5 == 0, 900).otherwise(30)).alias("ts"))
    e.write.parquet(f"{tmp_path}/e")
    a.write.parquet(f"{tmp_path}/a")
    got = reports.drain(reports.missing_outputs(
        reports.stream_parquet(spark, f"{tmp_path}/e"), reports.stream_parquet(spark, f"{tmp_path}/a"), ["k"], "5 MINUTES"))
    want = reports.missing_outputs_batch(e, a, ["k"], "5 MINUTES")
    assert sorted(got.collect()) == sorted(want.collect()) and want.count() > 5


# -- registry --------------------------------------------------------------

def test_registry(spark):
    make = lambda name: lambda df, **kw: df.select(
        F.lit(name).alias("qoi"), F.lit("l").alias("label"), F.lit(0).alias("bin"), F.lit(1.0).alias("value"))
    registry.register_qoi("one", make("one"))
    df = spark.range(1)
    assert registry.run_routines(df, [("one", {}), (make("two"), {"x": 1})]).count() == 2
    with pytest.raises(ValueError, match="unknown routine 'none'; known: hb, one, rdf"):
        registry.run_routines(df, [("none", {})])
    with pytest.raises(TypeError):
        registry.register_qoi("bad", 3)
    with pytest.raises(ValueError, match="several routines produce: one"):
        registry.run_routines(df, [("one", {}), (make("one"), {})])
    with pytest.raises(ValueError, match="flat"):
        registry.run_routines(df, [("one", {"kwargs": {}})])
    with pytest.raises(ValueError, match="lacks columns"):
        registry.run_routines(df, [(lambda d: d, {})])


def test_yaml_documents_are_dealt_out_and_read_as_by_the_library(spark):
    """one file of documents is read by several tasks, with the library's results."""
    import yaml

    odd = ["a: &x [1, 2]\nb: *x\nc: {<<: {k: 1}, z: 2}\n", "1: a\ntrue: b\nnull: c\n1.5: d\n", "", "- a\n- {b: 1, b: 2}\n",
           "x: 2001-01-01\ny: 0x1F\nz: 1_000\nw: .inf\nv: yes\nu: ~\nt: ''\ns: !!str 5\nr: !!int '7'\n",
           "a: !!binary aGVsbG8=\n", "x: 08\ny: 1:30\nz: '08'\nk: 08\n", "a: [1, '1', 1.0, \"1\"]\n"] * 9
    files = spark.createDataFrame([(str(i), v) for i, v in enumerate(odd)], "path string, value string").coalesce(1)
    rows = tables.yaml_to_json(files)
    assert {r["path"]: r["json"] for r in rows.collect()} == {
        str(i): json.dumps(yaml.safe_load(v), default=str) for i, v in enumerate(odd)}
    assert rows.rdd.getNumPartitions() > 1
