"""Bounds, constraints and designs on literal examples."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from calib.operators import design, groups

A, B, C, S = "charge A", "charge B", "charge C", "sigma C"


def test_sorted_names_and_crossed_bounds():
    assert design.Specs({"z": (0, 1), "a": (-1, 1)}).names == ["a", "z"]
    with pytest.raises(ValueError, match="exceeds"):
        design.Specs({"a": (2, 1)})


def simple():
    return design.Specs({A: (-1, 1), B: (-0.5, 0.5), S: (0.1, 2)},
                        [design.Constraint("all", 0.0, B, {A: 1, B: 1})])


def test_simple_reconstruction_and_validity(spark):
    df = spark.createDataFrame([(0.2, 1.0), (0.8, 1.0)], f"`{A}` double, `{S}` double")
    full = design.with_implicit(df, simple()).orderBy(A).collect()
    assert full[0].asDict() == {A: 0.2, B: -0.2, S: 1.0}
    assert design.valid_rows(df, simple()).count() == 1


def test_nested_order(spark):
    specs = design.Specs(
        {A: (-1, 1), B: (-1, 1), C: (-2, 2)},
        [design.Constraint("all", 1.0, C, {A: 1, B: 1, C: 1}),
         design.Constraint("ab", 0.0, B, {A: 1, B: 1})])
    assert specs.order == (1, 0)
    row = design.with_implicit(spark.createDataFrame([(0.2,)], f"`{A}` double"), specs).first()
    assert np.allclose([row[A], row[B], row[C]], [0.2, -0.2, 1.0])


def test_multi_atom_and_molecule(spark):
    bc = "charge B C"
    specs = design.Specs({A: (-1, 1), bc: (-1, 1)},
                         [design.Constraint("all", 0.0, bc, {A: 1, bc: 2})])
    row = design.with_implicit(spark.createDataFrame([(0.6,)], f"`{A}` double"), specs).first()
    assert math.isclose(row[bc], -0.3)
    mol = design.Specs(
        {"charge C1": (-1, 1), "charge C2": (0, 1), "charge H1 H2 H3": (0, 1), "charge O1 O2": (-1, 0)},
        [design.Constraint("mol", -0.8, "charge C2", {
            "charge C1": 1, "charge C2": 1, "charge H1 H2 H3": 3, "charge O1 O2": 2})])
    df = spark.createDataFrame([(-0.37, 0.09, -0.76)],
                               "`charge C1` double, `charge H1 H2 H3` double, `charge O1 O2` double")
    assert math.isclose(design.with_implicit(df, mol).first()["charge C2"], 0.82)


@pytest.mark.parametrize("bounds,constraints,match", [
    ({A: (0, 1), B: (0, 1)}, [design.Constraint("x", 3.0, B, {A: 1, B: 1})], "out of reach"),
    ({A: (0, 1), B: (0, 1)}, [design.Constraint("x", 1.0, B, {A: 1, B: 1}),
                              design.Constraint("y", 1.0, B, {A: 1, B: 1})], "own implicit"),
    ({A: (0, 1)}, [design.Constraint("x", 1.0, B, {A: 1, B: 1})], "not in bounds"),
    ({A: (0, 1), B: (0, 1)}, [design.Constraint("x", 1.0, B, {A: 1})], "is zero"),
    ({A: (-9, 9), B: (-9, 9)}, [design.Constraint("x", 1.0, B, {A: 1, B: 1}),
                                design.Constraint("y", 1.0, A, {A: 1, B: 2})], "cycle"),
    ({"m": (0, 1), A: (0, 1)}, [design.Constraint("x", 1.0, A, {A: 1, "m": 1})], "not charge"),
])
def test_bad_specs(bounds, constraints, match):
    with pytest.raises(ValueError, match=match):
        design.Specs(bounds, constraints)


def test_fully_constrained_design(spark):
    specs = design.Specs({A: (-1, 1)}, [design.Constraint("x", 0.0, A, {A: 1})])
    got = design.constrained_design(spark, specs, 3, 1)
    assert [r[A] for r in got.collect()] == [0.0] * 3
    assert specs.explicit == []


def test_design_sizes_strata_and_seed(spark):
    box = {"x": (-1.0, 1.0), "y": (2.0, 3.0)}
    assert design.design(spark, box, 0, 1).count() == 0
    with pytest.raises(ValueError):
        design.design(spark, box, -1, 1)
    rows = design.design(spark, box, 20, 7).collect()
    for name, (lo, hi) in box.items():
        strata = sorted(int((r[name] - lo) / (hi - lo) * 20) for r in rows)
        assert strata == list(range(20))
    assert sorted(rows) == sorted(design.design(spark, box, 20, 7).collect())
    assert sorted(rows) != sorted(design.design(spark, box, 20, 8).collect())


def test_constrained_design_with_predicate(spark):
    specs = design.Specs({"x": (-1.0, 1.0), "y": (2.0, 3.0)})
    got = design.constrained_design(spark, specs, 5, 3, F.col("x") > 0).collect()
    assert len(got) == 5 and all(0 < r["x"] <= 1 and 2 <= r["y"] <= 3 for r in got)
    assert sorted(r["row_id"] for r in got) == list(range(5))
    with pytest.raises(ValueError, match="no valid row"):
        design.constrained_design(spark, specs, 2, 3, F.col("x") > 5, max_rounds=2)


def test_first_valid_prior_draws(spark):
    got = design.first_valid_prior_draws(
        spark, 40, [("a", "normal", 0.0, 1.0), ("b", "uniform", 0.0, 1.0)], 1,
        lambda df: df.where("a > 0"))
    assert got.count() == 40 and got.where("a <= 0 OR b < 0 OR b >= 1").count() == 0


def test_priors(spark):
    bounds = spark.createDataFrame([("p", -1.0, 1.0)], "param string, lower double, upper double")
    assert design.priors_from_bounds(bounds, "uniform").first()[1:] == ("uniform", -1.0, 1.0)
    assert design.priors_from_bounds(bounds).first()[2:] == (0.0, 0.4)
    with pytest.raises(ValueError):
        design.priors_from_bounds(bounds, "gamma")
    bad = spark.createDataFrame([("a", "gamma", 0.0, 1.0), ("b", "normal", 0.0, 0.0),
                                 ("c", "uniform", 1.0, 1.0), ("d", "normal", 0.0, 1.0)],
                                "param string, kind string, a double, b double")
    assert [r["param"] for r in design.invalid_priors(bad).orderBy("param").collect()] == ["a", "b", "c"]


def members(spark, sets, system="s"):
    return spark.createDataFrame([(system, c, a) for c, atoms in sets.items() for a in atoms],
                                 "system string, cid int, atom_id int")


def test_overlap_and_hierarchy(spark):
    m = members(spark, {0: [1, 2], 1: [2, 3], 2: [1, 2, 3, 4], 3: [9], 4: [9]})
    rel = groups.overlap_classes(m, ["system"])
    kinds = {(r["first"], r["second"]): r["relation"] for r in rel.collect()}
    assert kinds[(0, 1)] == "partial" and kinds[(0, 2)] == "first-child"
    assert kinds[(0, 3)] == "disjoint" and kinds[(3, 4)] == "equal"
    constraints = spark.createDataFrame([(i, f"p{i}") for i in range(5)], "cid int, implicit string")
    terms = spark.createDataFrame([(0, "p0"), (0, "p2"), (1, "p1")], "cid int, param string")
    issues = {(r["first"], r["second"]): r["issue"]
              for r in groups.hierarchy_issues(rel, constraints, terms).collect()}
    assert issues == {(0, 1): "selections partially overlap", (3, 4): "selections are equal",
                      (0, 2): "implicit parameter of the parent in its child"}


def test_label_duplicates(spark):
    got = groups.parse_labels(spark.createDataFrame([("charge C1 C1",), ("charge",)], "label string"))
    assert [r["issue"] for r in got.collect()] == ["duplicate token", "no tokens"]


def test_compiled_constraint(spark):
    m = spark.createDataFrame(
        [("s", 0, g, a, q) for g in ("1", "2") for a, q in ((1, 0.5), (2, -0.1), (3, 0.3))],
        "system string, cid int, grp string, atom_id int, charge double")
    match = spark.createDataFrame([("s", "charge A", 1), ("s", "charge B", 2)],
                                  "system string, param string, atom_id int")
    con = spark.createDataFrame([(0, 1.0, "charge A")], "cid int, target double, implicit string")
    got = groups.compile_constraints(m, match, con, ["system"]).orderBy("param").collect()
    assert [(r["param"], r["coefficient"], round(r["fixed"], 6), r["consistent"]) for r in got] == [
        ("charge A", 1.0, 0.3, True), ("charge B", 1.0, 0.3, True)]


def test_compiled_constraints_read_members_once(spark, tmp_path):
    """The result comes from stored equations, not from the members again."""
    path = str(tmp_path / "members")
    spark.createDataFrame([(0, 1, "a", i, 0.25) for i in range(6)],
                          "system int, cid int, grp string, atom_id int, charge double").write.parquet(path)
    m = spark.read.parquet(path)
    match = spark.createDataFrame([(0, "p", 0), (0, "p", 1), (0, "q", 2)], "system int, param string, atom_id int")
    con = m.select("cid").distinct().withColumns({"implicit": F.lit("p"), "target": F.lit(1.0)})
    got = groups.compile_constraints(m, match, con, ["system"])
    assert not [f for f in got.inputFiles() if "/members/" in f]
    assert sorted(tuple(r) for r in got.collect()) == [(1, "p", 2.0, 0.75, 1, True), (1, "q", 1.0, 0.75, 1, True)]
