"""Exact joint feasibility of linear constraints within bounds, campaign by campaign.

Numbers are read by their decimal spelling and computed as fractions, so a verdict never
depends on rounding.  A constraint may miss its target by the tolerance of the interval test.
One campaign is a small document; many campaigns spread over the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calib.operators.ordering import attach

TOLERANCE = Fraction(1, 10**9)


class Simplex:
    """Bounded-variable simplex over fractions: A x = b with 0 <= x <= upper, by Bland's rule.

    Every row has an artificial variable; the first phase drives their sum to its minimum.
    """

    def __init__(self, a: list[list[Fraction]], b: list[Fraction], upper: list[Fraction | None]):
        self.rows, self.n = len(b), len(upper)
        self.sign = [-1 if v < 0 else 1 for v in b]
        self.t = [[self.sign[i] * v for v in row] + [Fraction(int(i == k)) for k in range(self.rows)]
                  for i, row in enumerate(a)]
        self.value = [abs(v) for v in b]
        self.upper: list[Fraction | None] = [*upper, *[None] * self.rows]
        self.basis = [self.n + i for i in range(self.rows)]
        self.high = [False] * len(self.upper)  # nonbasic variables that sit at their upper bound

    def reduced(self, cost: list[Fraction]) -> list[Fraction]:
        held = [(i, cost[j]) for i, j in enumerate(self.basis) if cost[j]]
        return [c - sum(k * self.t[i][j] for i, k in held) for j, c in enumerate(cost)]

    def minimize(self, cost: list[Fraction]) -> list[Fraction]:
        """Move to a vertex of least cost; the reduced costs there."""
        while True:
            d = self.reduced(cost)
            basic = set(self.basis)
            j = next((j for j, v in enumerate(d) if j not in basic and self.upper[j] != 0
                      and (v > 0 if self.high[j] else v < 0)), None)
            if j is None:
                return d
            self.enter(j)

    def enter(self, j: int) -> None:
        way = -1 if self.high[j] else 1
        # (step, variable that stops it, its row or -1 for the variable itself, at its upper bound?)
        stops = [] if self.upper[j] is None else [(self.upper[j], j, -1, not self.high[j])]
        for i, row in enumerate(self.t):
            rate, k = way * row[j], self.basis[i]
            if rate > 0:
                stops.append((self.value[i] / rate, k, i, False))
            elif rate < 0 and self.upper[k] is not None:
                stops.append(((self.upper[k] - self.value[i]) / -rate, k, i, True))
        step, _, at, high = min(stops)
        for i, row in enumerate(self.t):
            self.value[i] -= way * step * row[j]
        if at < 0:
            self.high[j] = high
            return
        self.high[self.basis[at]] = high
        self.value[at] = self.upper[j] - step if self.high[j] else step
        self.high[j] = False
        self.basis[at] = j
        pivot = self.t[at][j]
        self.t[at] = [v / pivot for v in self.t[at]]
        for i, row in enumerate(self.t):
            if i != at and row[j]:
                f = row[j]
                self.t[i] = [v - f * p if p else v for v, p in zip(row, self.t[at])]

    def point(self) -> list[Fraction]:
        x = [self.upper[j] if high else Fraction(0) for j, high in enumerate(self.high)]
        for i, j in enumerate(self.basis):
            x[j] = self.value[i]
        return x[:self.n]

    def feasible(self) -> tuple[bool, list[int]]:
        """Whether there is a point, and if not, rows whose combination no point can meet."""
        cost = [Fraction(int(j >= self.n)) for j in range(len(self.upper))]
        d = self.minimize(cost)
        if sum((v for v, j in zip(self.value, self.basis) if j >= self.n), Fraction(0)) > 0:
            return False, [i for i in range(self.rows) if d[self.n + i] != 1]
        for j in range(self.n, len(self.upper)):
            self.upper[j] = Fraction(0)
        return True, []


def exact(x: float) -> Fraction:
    return Fraction(repr(float(x)))


def settle(bounds: list[tuple[str, float, float]], constraints: list[tuple[int, float, float]],
           terms: list[tuple[int, str, float]]) -> tuple[bool | None, list[int], dict[str, float]]:
    """(feasible, cids in conflict, witness) of one campaign.

    The witness has the smallest value that the first parameter by name can take.  None if a
    constraint uses a parameter without bounds, or a number is missing.
    """
    limits = {p: (lo, hi) for p, lo, hi in bounds}
    if any(v is None or v != v for row in (*limits.values(), *(c[1:] for c in constraints), *(t[2:] for t in terms))
           for v in row) or any(p not in limits for _, p, _ in terms):
        return None, [], {}
    names = sorted(limits)
    low = {p: exact(limits[p][0]) for p in names}
    width = [exact(limits[p][1]) - low[p] for p in names]
    if any(w < 0 for w in width):
        return False, [], {}
    constraints = sorted(constraints)
    place = {c[0]: i for i, c in enumerate(constraints)}
    column = {p: j for j, p in enumerate(names)}
    a = [[Fraction(0)] * (len(names) + len(constraints)) for _ in constraints]
    goal = [exact(target) - exact(fixed) for _, target, fixed in constraints]
    for cid, p, coef in terms:
        if cid in place:
            a[place[cid]][column[p]] += exact(coef)
            goal[place[cid]] -= exact(coef) * low[p]
    slack = [TOLERANCE * (1 + abs(exact(target))) for _, target, _ in constraints]
    for i, s in enumerate(slack):
        a[i][len(names) + i] = Fraction(1)
        goal[i] += s
    solver = Simplex(a, goal, [*width, *[2 * s for s in slack]])
    ok, conflict = solver.feasible()
    if not ok:
        return False, [constraints[i][0] for i in conflict], {}
    if names:
        solver.minimize([Fraction(int(j == 0)) for j in range(len(solver.upper))])
    return True, [], {p: float(low[p] + v) for p, v in zip(names, solver.point())}


def joint_feasibility(bounds: DataFrame, constraints: DataFrame, terms: DataFrame,
                      keys: Sequence[str]) -> DataFrame:
    """(keys, feasible, conflict, witness) of every campaign with bounds or constraints.

    ``conflict`` lists constraints that cannot hold together within the bounds; ``witness``
    maps each parameter to its value at a point that meets all constraints.
    """
    keys = list(keys)

    def listed(df: DataFrame, name: str, *cols: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.collect_list(F.struct(*cols)).alias(name))

    tables = listed(bounds, "b", "param", "lower", "upper").join(
        listed(constraints, "c", "cid", "target", "fixed"), keys, "full").join(
        listed(terms, "t", "cid", "param", "coef"), keys, "full")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lists = [[[tuple(r.values()) for r in v] if v is not None else [] for v in batch[c]] for c in "bct"]
            found = [settle(*x) for x in zip(*lists)]
            yield batch[keys].assign(feasible=pd.Series([f[0] for f in found], dtype="boolean", index=batch.index),
                                     conflict=[f[1] for f in found], witness=[f[2] for f in found])

    kept = ", ".join(f"`{k}` {tables.schema[k].dataType.simpleString()}" for k in keys)
    return tables.mapInPandas(
        solve, f"{kept}, feasible boolean, conflict array<long>, witness map<string,double>")


def witness_misses(found: DataFrame, bounds: DataFrame, constraints: DataFrame, terms: DataFrame,
                   keys: Sequence[str]) -> DataFrame:
    """(keys, misses): how many bounds and constraints each witness does not meet."""
    keys = list(keys)
    points = found.where("feasible").select(*keys, F.explode("witness").alias("param", "value"))
    wide = 1e-9 * (1 + F.greatest(F.abs("lower"), F.abs("upper")))
    outside = bounds.join(points, [*keys, "param"]).select(*keys, (
        ~F.col("value").between(F.col("lower") - wide, F.col("upper") + wide)).cast("long").alias("miss"))
    left = terms.join(points, [*keys, "param"]).groupBy(*keys, "cid").agg(
        F.sum(F.col("coef") * F.col("value")).alias("left"))
    missed = attach(constraints, left, [*keys, "cid"]).join(
        found.where("feasible").select(*keys), keys, "left_semi").select(*keys, (
            F.abs(F.coalesce("left", F.lit(0.0)) + F.col("fixed") - F.col("target"))
            > 2e-9 * (1 + F.abs("target"))).cast("long").alias("miss"))
    return outside.unionByName(missed).groupBy(*keys).agg(F.sum("miss").alias("misses"))
