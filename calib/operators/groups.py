"""Atom groups, parameter ownership and constraint compilation, as set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calib.operators.ordering import attach
from calib.session import materialize


def parse_labels(labels: DataFrame, label: str = "label") -> DataFrame:
    """Kind and parts of parameter labels.

    ``charge A B`` -> tokens, ``define X`` -> tokens, ``dihedraltype9_<mult>_<phase> ...`` ->
    multiplicity and phase as well.  A repeated token is an issue.
    """
    words = F.split(F.trim(label), r"\s+")
    rows = labels.withColumn("__w", words).withColumn("__head", F.get("__w", F.lit(0))).withColumn(
        "tokens", F.slice("__w", 2, F.greatest(F.size("__w") - 1, F.lit(0))))
    dihedral = r"^dihedraltype9_([^_]+)_([^_]+)$"
    part = lambda k: F.regexp_extract("__head", dihedral, k)
    is_dihedral = F.col("__head").rlike(dihedral)
    kind = F.when(is_dihedral, "dihedraltype9").otherwise(F.col("__head"))
    issue = (F.when(F.size("tokens") < 1, "no tokens")
             .when(F.size(F.array_distinct("tokens")) < F.size("tokens"), "duplicate token"))
    return rows.select(
        *labels.columns, kind.alias("kind"), "tokens",
        F.when(is_dihedral, part(1)).alias("multiplicity"),
        F.when(is_dihedral, part(2)).alias("phase"), issue.alias("issue"))


def match_tokens(tokens: DataFrame, atoms: DataFrame, system: Sequence[str]) -> DataFrame:
    """(system, param, token, atom_id): atoms by name; by type where no atom has the name.

    ``tokens``: param, token; ``atoms``: system, atom_id, name, type.
    """
    system = list(system)
    words = tokens.select("param", "token")
    by_name = words.join(atoms.select(*system, "atom_id", F.col("name").alias("token")), "token")
    taken = by_name.select(*system, "token").distinct()
    by_type = words.join(atoms.select(*system, "atom_id", F.col("type").alias("token")), "token"
                         ).join(taken, [*system, "token"], "left_anti")
    cols = [*system, "param", "token", "atom_id"]
    return by_name.select(*cols).unionByName(by_type.select(*cols))


def missing_tokens(tokens: DataFrame, matches: DataFrame) -> DataFrame:
    """Tokens that matched no atom in any system."""
    return tokens.select("param", "token").join(
        matches.select("param", "token").distinct(), ["param", "token"], "left_anti")


def ownership_conflicts(matches: DataFrame, system: Sequence[str]) -> DataFrame:
    """Atoms controlled by more than one parameter."""
    return matches.groupBy(*system, "atom_id").agg(
        F.count_distinct("param").alias("n_params"), F.min("param").alias("first_param"),
        F.max("param").alias("last_param")).where(F.col("n_params") > 1)


def controlled_atoms(members: DataFrame, matches: DataFrame, system: Sequence[str]) -> DataFrame:
    return members.join(matches.select(*system, "atom_id").distinct(), [*system, "atom_id"],
                        "left_semi")


def uncontrolled_atoms(members: DataFrame, matches: DataFrame, system: Sequence[str]) -> DataFrame:
    return members.join(matches.select(*system, "atom_id").distinct(), [*system, "atom_id"],
                        "left_anti")


def residue_groups(members: DataFrame, scope: str, residue: str = "resid") -> DataFrame:
    """Add ``grp``: one group per system, or one per residue."""
    if scope not in ("system", "residue"):
        raise ValueError(f"unknown scope {scope!r}")
    return members.withColumn("grp", F.lit("all") if scope == "system"
                              else F.col(residue).cast("string"))


def group_totals(members: DataFrame, keys: Sequence[str], value: str, target: float,
                 atol: float = 1e-8, rtol: float = 1e-5) -> DataFrame:
    """Sum per group and whether it meets the target (atol + rtol * |target|)."""
    return members.groupBy(*keys).agg(F.sum(value).alias("total")).withColumn(
        "ok", F.abs(F.col("total") - target) <= atol + rtol * abs(target))


def compile_constraints(members: DataFrame, matches: DataFrame, constraints: DataFrame,
                        system: Sequence[str], tolerance: float = 1e-8) -> DataFrame:
    """Coefficients per constraint and parameter, with a consistency flag.

    ``members``: system, cid, grp, atom_id, charge; ``matches``: system, param, atom_id;
    ``constraints``: cid, target, implicit.  Every (system, grp) gives one equation:
    coefficient = number of controlled atoms, fixed = charge of the others; all must agree
    after division by the implicit coefficient.
    """
    system = list(system)
    eq = [*system, "cid", "grp"]
    owned = members.join(matches.select(*system, "param", "atom_id").distinct(),
                         [*system, "atom_id"], "left")
    parts = owned.groupBy(*eq, "param").agg(
        F.count(F.lit(1)).cast("double").alias("coef"), F.sum("charge").alias("charge"))
    # Constraints and equations are stored: members are joined and counted once.
    implicit = materialize(constraints.select("cid", "implicit", "target"), "constraints")
    owner = F.col("param") == F.col("implicit")
    equations = materialize(attach(parts, implicit, ["cid"], "inner").groupBy(*eq).agg(
        F.first("target").alias("target"),
        F.sum(F.when(owner, F.col("coef"))).alias("divisor"),
        F.sum(F.when(F.col("param").isNull(), F.col("charge")).otherwise(F.lit(0.0))).alias("fixed"),
        F.collect_list(F.when(F.col("param").isNotNull(), F.struct("param", "coef"))).alias("terms")), "equations")
    scaled = equations.select(*eq, "divisor", F.inline("terms")).withColumn(
        "scaled", F.try_divide("coef", "divisor"))
    per_param = scaled.groupBy("cid", "param").agg(
        F.count(F.lit(1)).alias("seen"), F.min("scaled").alias("lo"), F.max("scaled").alias("hi"),
        F.min_by("coef", F.struct(*system, "grp")).alias("coefficient"))
    goals = equations.withColumn("goal", F.try_divide(F.col("target") - F.col("fixed"), "divisor"))
    per_cid = goals.groupBy("cid").agg(
        F.count(F.lit(1)).alias("equations"), F.count("divisor").alias("solvable"),
        F.min("goal").alias("glo"), F.max("goal").alias("ghi"),
        F.min_by("fixed", F.struct(*system, "grp")).alias("fixed"))
    both = per_param.join(per_cid, "cid")
    low = F.when(F.col("seen") < F.col("equations"), F.least("lo", F.lit(0.0))).otherwise(F.col("lo"))
    same = ((F.col("hi") - low <= tolerance) & (F.col("ghi") - F.col("glo") <= tolerance)
            & (F.col("solvable") == F.col("equations")))
    return both.select("cid", "param", "coefficient", "fixed", "equations",
                       F.coalesce(same, F.lit(False)).alias("consistent"))


def overlap_classes(members: DataFrame, system: Sequence[str]) -> DataFrame:
    """Relation of every two selections of a system: disjoint, equal, first-child,
    second-child or partial.

    ``members``: system, cid, atom_id.  Atoms are first counted by the set of selections
    they are in, so only those few distinct sets are paired.
    """
    system = list(system)
    sets = members.groupBy(*system, "atom_id").agg(
        F.array_sort(F.collect_set("cid")).alias("cids"))
    patterns = sets.groupBy(*system, "cids").agg(F.count(F.lit(1)).alias("n"))

    def pairs(df: DataFrame, extra: Sequence[str]) -> DataFrame:
        first = df.select(*system, *extra, "cids", F.posexplode("cids").alias("p", "first"))
        rest = F.slice("cids", F.col("p") + 2, F.size("cids"))
        return first.select(*system, *extra, "first", F.explode(rest).alias("second"))

    sizes = patterns.select(*system, "n", F.explode("cids").alias("cid")).groupBy(
        *system, "cid").agg(F.sum("n").alias("size"))
    present = sizes.groupBy(*system).agg(F.array_sort(F.collect_list("cid")).alias("cids"))
    shared = pairs(patterns, ["n"]).groupBy(*system, "first", "second").agg(
        F.sum("n").alias("shared"))
    rows = attach(pairs(present, []), shared, [*system, "first", "second"])
    for side in ("first", "second"):
        rows = attach(rows, sizes.select(*system, F.col("cid").alias(side),
                                         F.col("size").alias(f"n_{side}")), [*system, side])
    s, a, b = F.coalesce("shared", F.lit(0)), F.col("n_first"), F.col("n_second")
    relation = (F.when(s == 0, "disjoint").when((s == a) & (s == b), "equal")
                .when(s == a, "first-child").when(s == b, "second-child").otherwise("partial"))
    return rows.select(*system, "first", "second", "n_first", "n_second",
                       s.cast("long").alias("shared"), relation.alias("relation"))


def hierarchy_issues(relations: DataFrame, constraints: DataFrame, terms: DataFrame) -> DataFrame:
    """(first, second, issue): equal or partly overlapping selections, relations that differ
    between systems, and a parent's implicit parameter inside its child.

    ``constraints``: cid, implicit; ``terms``: cid, param.
    """
    kinds = relations.groupBy("first", "second").agg(
        F.array_sort(F.collect_set("relation")).alias("kinds"))
    child = F.when(F.get("kinds", F.lit(0)) == "first-child", F.col("first")).when(
        F.get("kinds", F.lit(0)) == "second-child", F.col("second"))
    parent = F.when(child == F.col("first"), F.col("second")).otherwise(F.col("first"))
    rows = kinds.withColumn("child", F.when(F.size("kinds") == 1, child)).withColumn(
        "parent", F.when(F.col("child").isNotNull(), parent))
    owner = constraints.select(F.col("cid").alias("parent"), F.col("implicit").alias("param"))
    inside = terms.select(F.col("cid").alias("child"), "param", F.lit(True).alias("inside"))
    rows = rows.join(owner, "parent", "left").join(inside, ["child", "param"], "left")
    issue = (F.when(F.array_contains("kinds", "equal"), "selections are equal")
             .when(F.array_contains("kinds", "partial"), "selections partially overlap")
             .when(F.size("kinds") > 1, "relation changes between systems")
             .when(F.col("inside"), "implicit parameter of the parent in its child"))
    return rows.select("first", "second", issue.alias("issue")).where(F.col("issue").isNotNull())


def _consistent(relations: DataFrame) -> DataFrame:
    """(child, parent) of the pairs that are nested the same way in all their systems."""
    kinds = relations.groupBy("first", "second").agg(F.collect_set("relation").alias("kinds")).where(
        "size(kinds) = 1").withColumn("kind", F.get("kinds", F.lit(0)))
    first, second = F.col("first"), F.col("second")
    return kinds.where("kind IN ('first-child', 'second-child')").select(
        F.when(F.col("kind") == "first-child", first).otherwise(second).alias("child"),
        F.when(F.col("kind") == "first-child", second).otherwise(first).alias("parent"))


def containment(relations: DataFrame) -> DataFrame:
    """(child, parent): all pairs in which one selection lies inside another, also through others.

    Selections that share no system are related by what lies between them.  Each round joins
    the pairs with themselves, so a chain of n selections takes about log n rounds.
    """
    reach = materialize(_consistent(relations), "inside")
    size = reach.count()
    while True:
        hop = reach.select("child", F.col("parent").alias("mid")).join(
            reach.select(F.col("child").alias("mid"), "parent"), "mid").select("child", "parent")
        reach = materialize(reach.unionByName(hop).distinct(), "inside")
        now = reach.count()
        if now == size:
            return reach
        size = now


def hierarchy(relations: DataFrame, reach: DataFrame | None = None) -> DataFrame:
    """(cid, parent, depth): each selection's direct parent and its number of ancestors.

    A direct parent has no other selection between; a selection inside none has a NULL parent.
    """
    reach = containment(relations) if reach is None else reach
    between = reach.select("child", F.col("parent").alias("mid")).join(
        reach.select(F.col("child").alias("mid"), "parent"), "mid").where(
        "mid <> child AND mid <> parent").select("child", "parent").distinct()
    direct = reach.where("child <> parent").join(between, ["child", "parent"], "left_anti")
    depth = reach.where("child <> parent").groupBy("child").agg(F.count(F.lit(1)).alias("depth"))
    all_ = relations.select(F.col("first").alias("child")).union(relations.select("second")).distinct()
    rows = all_.join(direct, "child", "left").join(depth, "child", "left")
    return rows.select(F.col("child").alias("cid"), "parent", F.coalesce("depth", F.lit(0)).alias("depth"))


def hierarchy_contradictions(relations: DataFrame, reach: DataFrame | None = None) -> DataFrame:
    """(child, parent, relation): selections that lie inside others by way of third ones, while
    some system has them in another relation; ``inside itself`` closes a circle of systems."""
    reach = containment(relations) if reach is None else reach
    low, high = F.least("child", "parent"), F.greatest("child", "parent")
    met = reach.where("child <> parent").withColumns({"first": low, "second": high}).join(
        relations.select("first", "second", "relation").distinct(), ["first", "second"])
    want = F.when(F.col("child") == F.col("first"), "first-child").otherwise("second-child")
    return met.where(F.col("relation") != want).select("child", "parent", "relation").unionByName(
        reach.where("child = parent").withColumn("relation", F.lit("inside itself")))


def set_differences(left: DataFrame, right: DataFrame, columns: Sequence[str],
                    keys: Sequence[str] = (), min_mass: float = 0.5) -> DataFrame:
    """(keys, column, value, side): distinct values found on one side only, dummies excluded."""
    out = None
    for c in columns:
        a, b = (df.where(F.col("mass") > min_mass).select(*keys, F.col(c).cast("string").alias(
            "value")).distinct() for df in (left, right))
        for side, one, other in (("left", a, b), ("right", b, a)):
            diff = one.exceptAll(other).select(
                *keys, F.lit(c).alias("column"), "value", F.lit(side).alias("side"))
            out = diff if out is None else out.unionByName(diff)
    return out


def duplicate_outputs(outputs: DataFrame) -> DataFrame:
    """QoI names that more than one routine produces; ``outputs``: routine, qoi."""
    return outputs.groupBy("qoi").agg(F.count_distinct("routine").alias("n_routines")).where(
        F.col("n_routines") > 1)
