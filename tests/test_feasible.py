"""Joint feasibility against vertex enumeration."""

import random
from fractions import Fraction
from itertools import combinations, product

import pytest
from pyspark.sql import functions as F

from calib.operators import design, feasible
from calib.operators.feasible import exact, settle


def solve(rows, rhs):
    """The unique solution of a square system of fractions, or None."""
    m = [[*r, v] for r, v in zip(rows, rhs)]
    n = len(m)
    for c in range(n):
        p = next((i for i in range(c, n) if m[i][c]), None)
        if p is None:
            return None
        m[c], m[p] = m[p], m[c]
        m[c] = [v / m[c][c] for v in m[c]]
        for i in range(n):
            if i != c and m[i][c]:
                m[i] = [v - m[i][c] * w for v, w in zip(m[i], m[c])]
    return [r[n] for r in m]


def brute(bounds, constraints, terms):
    """Smallest first value over all vertices (m basic variables, others at a bound), or None."""
    names = sorted(p for p, _, _ in bounds)
    limits = {p: (exact(lo), exact(hi)) for p, lo, hi in bounds}
    a = [[sum((exact(v) for c, q, v in terms if c == cid and q == p), Fraction(0)) for p in names]
         for cid, _, _ in constraints]
    goal = [exact(t) - exact(f) for _, t, f in constraints]
    best = None
    for k in range(min(len(constraints), len(names)) + 1):
        for free in combinations(range(len(names)), k):
            fixed = [j for j in range(len(names)) if j not in free]
            for ends in product((0, 1), repeat=len(fixed)):
                x = [None] * len(names)
                for j, e in zip(fixed, ends):
                    x[j] = limits[names[j]][e]
                left = [g - sum(r[j] * x[j] for j in fixed) for r, g in zip(a, goal)]
                for rows in combinations(range(len(constraints)), k):
                    got = solve([[a[i][j] for j in free] for i in rows], [left[i] for i in rows])
                    if got is None:
                        continue
                    y = list(x)
                    for j, v in zip(free, got):
                        y[j] = v
                    if all(limits[p][0] <= v <= limits[p][1] for p, v in zip(names, y)) and all(
                            sum(c * v for c, v in zip(r, y)) == g for r, g in zip(a, goal)):
                        best = y[0] if best is None else min(best, y[0])
    return best


@pytest.mark.parametrize("seed", range(60))
def test_against_vertices(seed):
    rng = random.Random(seed)
    names = [f"charge {c}" for c in "ABCD"[:rng.randint(2, 4)]]
    bounds = [(p, *sorted(rng.choices([-1.0, -0.5, 0.0, 0.3, 0.5, 1.0], k=2))) for p in names]
    cids = list(range(rng.randint(1, 3)))
    terms = [(c, p, rng.choice([1.0, 0.5, -1.0, 2.0])) for c in cids for p in names if rng.random() < 0.7]
    constraints = [(c, rng.choice([0.0, 0.1, 0.4, 1.0, -0.7]), rng.choice([0.0, 0.1])) for c in cids]
    want = brute(bounds, constraints, terms)
    ok, conflict, witness = settle(bounds, constraints, terms)
    assert ok == (want is not None)
    if ok:
        assert witness[names[0]] == pytest.approx(float(want), abs=1e-7)
        assert not conflict
    else:
        # The conflict alone is infeasible as well.
        assert conflict
        kept = set(conflict)
        assert brute(bounds, [c for c in constraints if c[0] in kept], [t for t in terms if t[0] in kept]) is None


BOX = [(f"charge {c}", 0.0, 1.0) for c in "ABC"]
PAIRS = [(0, "charge A", 1.0), (0, "charge B", 1.0), (1, "charge B", 1.0), (1, "charge C", 1.0),
         (2, "charge A", 1.0), (2, "charge C", 1.0)]


def test_three_constraints_that_only_fail_together():
    # A + B = 1, B + C = 1, A + C = 1.6 holds; 0.2, 0.2 and 1.6 need a negative B.
    assert settle(BOX, [(0, 1.0, 0.0), (1, 1.0, 0.0), (2, 1.6, 0.0)], PAIRS)[0]
    ok, conflict, witness = settle(BOX, [(0, 0.2, 0.0), (1, 0.2, 0.0), (2, 1.6, 0.0)], PAIRS)
    assert not ok and sorted(conflict) == [0, 1, 2] and witness == {}


def test_decimal_spelling():
    # 0.1 * 3 is not 0.3 in doubles; the same constraint twice must not become a conflict.
    terms = [(0, "charge A", 1.0), (1, "charge A", 0.1)]
    assert settle(BOX, [(0, 0.3, 0.0), (1, 0.03, 0.0)], terms)[0]


def test_defined_cases():
    assert settle([], [], []) == (True, [], {})
    assert settle(BOX, [], [])[2] == {"charge A": 0.0, "charge B": 0.0, "charge C": 0.0}
    assert settle([("charge A", 1.0, 0.0)], [], [])[0] is False
    assert settle(BOX, [(0, 1.0, 0.0)], [(0, "charge Z", 1.0)])[0] is None
    assert settle(BOX, [(0, None, 0.0)], [(0, "charge A", 1.0)])[0] is None
    assert settle(BOX, [(7, 1.0, 0.0)], []) == (False, [7], {})
    assert settle(BOX, [(7, 1.0, 1.0)], [])[0]


def test_joint_feasibility_of_tables(spark):
    systems = {"a": (1.0, 1.0, 1.6), "b": (0.2, 0.2, 1.6), "c": (0.5, 0.5, 0.5)}
    key = [(k,) for k in systems]
    bounds = spark.createDataFrame([(*k, *b) for k in key for b in BOX], "campaign string, param string, lower double, upper double")
    constraints = spark.createDataFrame(
        [(k, c, t, 0.0) for k, ts in systems.items() for c, t in enumerate(ts)],
        "campaign string, cid int, target double, fixed double")
    terms = spark.createDataFrame([(*k, *t) for k in key for t in PAIRS], "campaign string, cid int, param string, coef double")
    found = feasible.joint_feasibility(bounds, constraints, terms, ["campaign"])
    rows = {r["campaign"]: r for r in found.collect()}
    assert [rows[k]["feasible"] for k in "abc"] == [True, False, True]
    assert sorted(rows["b"]["conflict"]) == [0, 1, 2]
    interval = design.feasibility(bounds, constraints, terms, ["campaign"]).where("NOT feasible")
    assert interval.count() == 0  # each constraint alone can be met
    misses = feasible.witness_misses(found, bounds, constraints, terms, ["campaign"]).collect()
    assert {r["campaign"]: r["misses"] for r in misses} == {"a": 0, "c": 0}
    moved = found.withColumn("witness", F.transform_values("witness", lambda k, v: v + 0.5))
    assert all(r["misses"] >= 3 for r in feasible.witness_misses(
        moved, bounds, constraints, terms, ["campaign"]).collect())
