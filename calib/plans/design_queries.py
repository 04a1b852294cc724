"""Bounds, constraints, designs, splits and scalar functions on part and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from calib.functions import expr
from calib.functions.expr import normal_quantile_sql
from calib.operators import design, feasible, ordering, posterior
from calib.plans.base import LINE_KEY, query, r, rounded, table
from calib.session import materialize

KEYS = "l_orderkey, l_linenumber, l_partkey"
ID = ["l_orderkey", "l_linenumber", "l_partkey"]


def u_sql(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def parameter_rows(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        *ID, F.col("l_discount").alias("charge A"), F.col("l_tax").alias("charge B"))


SPECS = design.Specs(
    {"charge A": (0.0, 0.08), "charge B": (0.01, 0.07), "charge C": (-0.05, 0.1),
     "charge D": (0.0, 0.5)},
    [design.Constraint("C D", 0.2, "charge D", {"charge C": 1.0, "charge D": 1.0}, fixed=0.05),
     design.Constraint("A B C", 0.1, "charge C",
                       {"charge A": 1.0, "charge B": 2.0, "charge C": 1.0})])
COMPLETED = f"""
full_ AS (
  SELECT {KEYS}, l_discount AS a, l_tax AS b, 0.1::DOUBLE - l_discount - 2 * l_tax AS c,
         0.2::DOUBLE - 0.05::DOUBLE - (0.1::DOUBLE - l_discount - 2 * l_tax) AS d
  FROM lineitem)"""


@query("p3_in_domain", f"""
SELECT {KEYS}, l_discount, l_tax FROM lineitem
WHERE l_discount BETWEEN 0.02 AND 0.08 AND l_tax BETWEEN 0.01 AND 0.07""")
def p3_in_domain(spark, sf_dir):
    keep = design.within_bounds({"l_discount": (0.02, 0.08), "l_tax": (0.01, 0.07)})
    return table(spark, sf_dir, "lineitem").where(keep).select(*ID, "l_discount", "l_tax")


@query("p3_in_domain_long", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
WHERE l_discount BETWEEN 0.02 AND 0.08 AND l_tax BETWEEN 0.01 AND 0.07""")
def p3_in_domain_long(spark, sf_dir):
    bounds = spark.createDataFrame(
        [("l_discount", 0.02, 0.08), ("l_tax", 0.01, 0.07)],
        "param string, lower double, upper double")
    pairs = F.array(*[F.struct(F.lit(p).alias("param"), F.col(p).alias("value"))
                      for p in ("l_discount", "l_tax")])
    long = table(spark, sf_dir, "lineitem").select(*LINE_KEY, F.inline(pairs))
    return design.within_bounds_long(long, bounds, LINE_KEY).drop("l_shipdate")


@query("p4_implicit_parameters", f"""
WITH {COMPLETED}
SELECT {KEYS}, {r('a')} AS "charge A", {r('b')} AS "charge B", {r('c')} AS "charge C",
       {r('d')} AS "charge D" FROM full_""")
def p4_implicit_parameters(spark, sf_dir):
    return rounded(design.with_implicit(parameter_rows(spark, sf_dir), SPECS))


@query("x5_valid_rows", f"""
WITH {COMPLETED}
SELECT {KEYS}, {r('d')} AS "charge D" FROM full_
WHERE a BETWEEN 0 AND 0.08 AND b BETWEEN 0.01 AND 0.07 AND c BETWEEN -0.05 AND 0.1
  AND d BETWEEN 0 AND 0.5 AND a + b < 0.1""")
def x5_valid_rows(spark, sf_dir):
    extra = F.col("`charge A`") + F.col("`charge B`") < 0.1
    return rounded(design.valid_rows(parameter_rows(spark, sf_dir), SPECS, extra).select(
        *ID, "`charge D`"))


@query("p14_explicit_projection", f"""
SELECT {KEYS}, l_discount AS "charge A", l_tax AS "charge B", l_tax AS mapped,
       2::INTEGER AS n_names FROM lineitem""")
def p14_explicit_projection(spark, sf_dir):
    full = design.with_implicit(parameter_rows(spark, sf_dir), SPECS)
    named = design.parameter_map(SPECS, explicit_only=True)
    return design.explicit_columns(
        full.withColumn("m", named), SPECS, [*ID, "m"]).withColumns(
        {"mapped": F.col("m")["charge B"], "n_names": F.size("m")}).drop("m")


LHS_BOUNDS = {"a": (-1.0, 1.0), "b": (2.0, 3.0), "c": (0.0, 10.0)}


def _lhs_sql(source: str, key: str, n: str, bounds: dict, seed: str) -> str:
    sides = " UNION ALL ".join(
        f"SELECT '{p}' AS param, {lo}::DOUBLE AS lower, {hi}::DOUBLE AS upper"
        for p, (lo, hi) in bounds.items())
    wide = ", ".join(f"max(CASE WHEN param = '{p}' THEN v END) AS \"{p}\"" for p in bounds)
    return f"""
sides AS ({sides}),
lhs AS (
  SELECT {key}, {wide} FROM (
    SELECT {key}, param, lower + (upper - lower) * ((row_number() OVER (
        PARTITION BY param ORDER BY md5(concat_ws('|', '{seed}', 'order', param, {key})), {key})
        - 1 + {u_sql(f"'{seed}'", "'jitter'", 'param', key)}) / {n}) AS v
    FROM {source}, sides)
  GROUP BY {key})"""


@query("n1_latin_hypercube", f"""
WITH {_lhs_sql('part', 'p_partkey', '(SELECT count(*) FROM part)', LHS_BOUNDS, '7')}
SELECT p_partkey, {r('a')} AS a, {r('b')} AS b, {r('c')} AS c FROM lhs""")
def n1_latin_hypercube(spark, sf_dir):
    return rounded(design.latin_hypercube(
        table(spark, sf_dir, "part"), "p_partkey", LHS_BOUNDS, 7))


N2_SPECS = design.Specs(
    {"charge A": (0.0, 1.0), "charge B": (0.0, 1.0), "charge C": (-1.5, 0.2)},
    [design.Constraint("all", 0.0, "charge C",
                       {"charge A": 1.0, "charge B": 1.0, "charge C": 1.0})])


@query("n2_constrained_design", f"""
WITH cand AS (SELECT range AS row_id FROM range((SELECT 2 * count(*) FROM part))),
{_lhs_sql('cand', 'row_id', '(SELECT count(*) FROM cand)',
          {'charge A': (0.0, 1.0), 'charge B': (0.0, 1.0)}, '11:0')},
good AS (
  SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS i FROM (
    SELECT row_id, "charge A" AS a, "charge B" AS b, 0.0::DOUBLE - "charge A" - "charge B" AS c FROM lhs)
  WHERE c BETWEEN -1.5 AND 0.2)
SELECT i AS row_id, {r('a')} AS "charge A", {r('b')} AS "charge B", {r('c')} AS "charge C"
FROM good WHERE i < (SELECT count(*) FROM part)""")
def n2_constrained_design(spark, sf_dir):
    n = table(spark, sf_dir, "part").count()
    return rounded(design.constrained_design(spark, N2_SPECS, n, 11))


PRIORS = [("p", "normal", 0.5, 0.2), ("q", "uniform", -1.0, 2.0)]


@query("n3_prior_draws", f"""
WITH u AS (SELECT l_orderkey, {u_sql("'3'", "'p'", 'l_orderkey')} AS u,
                  {u_sql("'3'", "'q'", 'l_orderkey')} AS v
           FROM (SELECT o_orderkey AS l_orderkey FROM orders)),
d AS (SELECT l_orderkey AS o_orderkey, 0.5e0 + 0.2e0 * ({normal_quantile_sql('u')}) AS p,
             -1e0 + 3e0 * v AS q
      FROM (SELECT l_orderkey, greatest(u, pow(2e0, -33)) AS u, v FROM u))
SELECT o_orderkey, {r('p')} AS p, {r('q')} AS q FROM d WHERE p BETWEEN 0 AND 1""")
def n3_prior_draws(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey")
    keep = lambda df: df.where(design.within_bounds({"p": (0.0, 1.0)}))
    return rounded(design.prior_draws(rows, "o_orderkey", PRIORS, 3, keep))


def part_bounds(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_partkey").cast("string").alias("param")).agg(
        F.min("l_discount").alias("lower"), (F.max("l_discount") + 0.01).alias("upper"))


@query("p17_priors_from_bounds", f"""
WITH b AS (SELECT l_partkey::VARCHAR AS param, min(l_discount) AS lower,
                  max(l_discount) + 0.01::DOUBLE AS upper FROM lineitem GROUP BY l_partkey)
SELECT param, 'normal' AS kind, {r('(lower + upper) / 2')} AS a, {r('(upper - lower) * 0.2')} AS b
FROM b UNION ALL SELECT 'log_sigma_rdf', 'normal', -2.0::DOUBLE, 2.0::DOUBLE""")
def p17_priors_from_bounds(spark, sf_dir):
    return rounded(design.priors_from_bounds(part_bounds(spark, sf_dir), nuisances=["rdf"]))


# -- campaigns of constraints: eight parts each ----------------------------

def campaign_tables(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(
        F.floor(F.col("p_partkey") / 8).cast("long").alias("campaign"),
        F.pmod("p_partkey", F.lit(8)).cast("int").alias("cid"), "p_size")
    name = lambda c: F.concat(F.lit("charge "), c.cast("string"))
    bounds = part.select("campaign", name(F.col("cid")).alias("param"),
                         (-F.col("p_size") / 50.0).alias("lower"),
                         (F.col("p_size") / 50.0).alias("upper"))
    constraints = part.select(
        "campaign", "cid", name(F.col("cid")).alias("implicit"),
        ((F.col("p_size") - 25) / 20.0).alias("target"), F.lit(0.1).alias("fixed"), "p_size")
    own = part.select("campaign", "cid", name(F.col("cid")).alias("param"), F.lit(1.0).alias("coef"))
    parent = part.where("cid > 0").select(
        "campaign", "cid", name(F.floor(F.col("cid") / 2)).alias("param"), F.lit(0.5).alias("coef"))
    return bounds, constraints, own.unionByName(parent)


CAMPAIGNS = """
parts AS (SELECT p_partkey // 8 AS campaign, (p_partkey % 8)::INTEGER AS cid, p_size FROM part)"""


@query("t4_constraint_levels", f"""
WITH RECURSIVE {CAMPAIGNS}, lv(campaign, cid, level) AS (
  SELECT campaign, cid, 1::INTEGER FROM parts WHERE cid = 0
  UNION ALL
  SELECT p.campaign, p.cid, level + 1 FROM parts p JOIN lv
  ON p.campaign = lv.campaign AND p.cid > 0 AND p.cid // 2 = lv.cid)
SELECT campaign, cid, level FROM lv""")
def t4_constraint_levels(spark, sf_dir):
    _, constraints, terms = campaign_tables(spark, sf_dir)
    return design.constraint_levels(constraints, terms, ["campaign"])


@query("q4_specs_violations", f"""
WITH {CAMPAIGNS},
c AS (SELECT campaign, cid, CASE WHEN p_size % 10 = 0 THEN 'mass ' || cid
                                 WHEN p_size % 10 = 1 THEN 'charge 0'
                                 ELSE 'charge ' || cid END AS implicit FROM parts),
b AS (SELECT campaign, 'charge ' || cid AS param FROM parts WHERE p_size % 10 <> 2),
t AS (SELECT campaign, cid, 'charge ' || cid AS param, CASE WHEN p_size % 10 = 3 THEN 0 ELSE 1 END AS coef FROM parts
      UNION ALL SELECT campaign, cid, 'charge ' || cid // 2, 0.5 FROM parts WHERE cid > 0)
SELECT campaign, min(cid)::BIGINT AS cid, 'implicit parameter owned twice' AS issue, implicit AS subject
FROM c GROUP BY campaign, implicit HAVING count(*) > 1
UNION ALL SELECT campaign, cid, 'implicit parameter not in bounds', implicit FROM c
WHERE (campaign, implicit) NOT IN (SELECT (campaign, param) FROM b)
UNION ALL SELECT campaign, cid, 'implicit parameter is not a charge', implicit FROM c WHERE implicit NOT LIKE 'charge %'
UNION ALL SELECT campaign, cid, 'unknown parameter', param FROM t
WHERE (campaign, param) NOT IN (SELECT (campaign, param) FROM b)
UNION ALL SELECT c.campaign, c.cid, 'implicit parameter has no coefficient', c.implicit
FROM c LEFT JOIN t ON t.campaign = c.campaign AND t.cid = c.cid AND t.param = c.implicit
WHERE coalesce(coef, 0) = 0""")
def q4_specs_violations(spark, sf_dir):
    bounds, constraints, terms = campaign_tables(spark, sf_dir)
    part = constraints.select("campaign", "cid", F.pmod("p_size", F.lit(10)).alias("m"))
    mark = F.col("m")
    text = F.col("cid").cast("string")
    constraints = part.select("campaign", "cid", F.when(mark == 0, F.concat(F.lit("mass "), text))
                              .when(mark == 1, F.lit("charge 0"))
                              .otherwise(F.concat(F.lit("charge "), text)).alias("implicit"))
    gone = part.where(mark == 2).select("campaign", F.concat(F.lit("charge "), text).alias("param"))
    zero = part.where(mark == 3).select("campaign", "cid", F.concat(F.lit("charge "), text).alias(
        "param"), F.lit(True).alias("z"))
    terms = terms.join(zero, ["campaign", "cid", "param"], "left").select(
        "campaign", "cid", "param",
        F.when(F.col("z") & (F.col("coef") == 1.0), F.lit(0.0)).otherwise(F.col("coef")).alias("coef"))
    return design.specs_violations(
        bounds.join(gone, ["campaign", "param"], "left_anti"), constraints, terms, ["campaign"])


@query("q5_feasibility", f"""
WITH {CAMPAIGNS},
t AS (SELECT campaign, cid, cid AS p, 1.0::DOUBLE AS coef FROM parts
      UNION ALL SELECT campaign, cid, cid // 2, 0.5 FROM parts WHERE cid > 0),
e AS (SELECT t.campaign, t.cid, sum(-coef * p_size / 50.0) AS low, sum(coef * p_size / 50.0) AS high
      FROM t JOIN parts ON parts.campaign = t.campaign AND parts.cid = t.p GROUP BY ALL)
SELECT campaign, cid, {r('low')} AS low, {r('high')} AS high,
       {r('(p_size - 25) / 20.0::DOUBLE - 0.1::DOUBLE')} AS goal,
       (p_size - 25) / 20.0::DOUBLE - 0.1::DOUBLE BETWEEN low - 1e-9 * (1 + abs((p_size - 25) / 20.0))
         AND high + 1e-9 * (1 + abs((p_size - 25) / 20.0)) AS feasible
FROM parts JOIN e USING (campaign, cid)""")
def q5_feasibility(spark, sf_dir):
    bounds, constraints, terms = campaign_tables(spark, sf_dir)
    return rounded(design.feasibility(bounds, constraints, terms, ["campaign"]))


# Without the first constraint, x_k = g_k - x_(k // 2) / 2 leaves one free value, x_0: each bound
# of x_k is one of x_0.  In whole numbers: g in hundredths, b = (-2)^-depth.
@query("q5_joint_feasibility", f"""
WITH RECURSIVE {CAMPAIGNS},
e AS (SELECT a.campaign, bool_and(abs(5 * a.p_size - 135) <= 2 * a.p_size + coalesce(b.p_size, 0)) AS interval_ok
      FROM parts a LEFT JOIN parts b ON b.campaign = a.campaign AND b.cid = a.cid // 2
      WHERE a.cid > 0 AND b.cid IS NOT NULL GROUP BY a.campaign),
x(campaign, cid, p_size, c, s) AS (  -- x_k = c / 800 + s * x_0 / 8
  SELECT campaign, cid, p_size, 0::BIGINT, 8::BIGINT FROM parts WHERE cid = 0
  UNION ALL
  SELECT p.campaign, p.cid, p.p_size, 8 * (5 * p.p_size - 135) - x.c // 2, -x.s // 2
  FROM parts p JOIN x ON p.campaign = x.campaign AND p.cid > 0 AND p.cid // 2 = x.cid),
f AS (SELECT campaign, max(CASE WHEN s > 0 THEN (-16 * p_size - c)::DOUBLE / (100 * s) ELSE (16 * p_size - c)::DOUBLE / (100 * s) END) AS lo,
             min(CASE WHEN s > 0 THEN (16 * p_size - c)::DOUBLE / (100 * s) ELSE (-16 * p_size - c)::DOUBLE / (100 * s) END) AS hi
      FROM x GROUP BY campaign)
SELECT e.campaign, interval_ok, lo <= hi + 1e-7 AS feasible, CASE WHEN lo <= hi + 1e-7 THEN {r('lo')} END AS first_value,
       CASE WHEN lo <= hi + 1e-7 THEN 0::BIGINT END AS misses
FROM e JOIN f USING (campaign)""")
def q5_joint_feasibility(spark, sf_dir):
    bounds, constraints, terms = campaign_tables(spark, sf_dir)
    # Campaigns whose first part is missing have other unknowns; all others lose constraint 0.
    whole = constraints.where("cid = 0").select("campaign")
    bounds, constraints, terms = (t.join(whole, "campaign", "left_semi") for t in (
        bounds, constraints.where("cid > 0"), terms.where("cid > 0")))
    found = materialize(feasible.joint_feasibility(bounds, constraints, terms, ["campaign"]), "joint")
    each = design.feasibility(bounds, constraints, terms, ["campaign"]).groupBy("campaign").agg(
        F.bool_and("feasible").alias("interval_ok"))
    misses = feasible.witness_misses(found, bounds, constraints, terms, ["campaign"])
    return rounded(found.join(each, "campaign").join(misses, "campaign", "left").select(
        "campaign", "interval_ok", "feasible", F.col("witness")["charge 0"].alias("first_value"), "misses"))


@query("q7_invalid_priors", """
WITH p AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'normal' WHEN 1 THEN 'uniform' ELSE 'gamma' END AS kind,
                  p_size / 10.0::DOUBLE AS a, (p_size - 10) / 10.0::DOUBLE AS b FROM part)
SELECT *, CASE WHEN kind = 'gamma' THEN 'unknown kind'
               WHEN kind = 'normal' AND NOT b > 0 THEN 'scale must be positive'
               WHEN kind = 'uniform' AND NOT a < b THEN 'lower must be below upper' END AS issue
FROM p WHERE issue IS NOT NULL""")
def q7_invalid_priors(spark, sf_dir):
    m = F.pmod("p_size", F.lit(3))
    priors = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(m == 0, "normal").when(m == 1, "uniform").otherwise("gamma").alias("kind"),
        (F.col("p_size") / 10.0).alias("a"), ((F.col("p_size") - 10) / 10.0).alias("b"))
    return design.invalid_priors(priors)


# -- order and splits ------------------------------------------------------

@query("t1_canonical_order", """
SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_type ORDER BY p_name, p_partkey) AS ord
FROM part""")
def t1_canonical_order(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    return ordering.number_rows(part, ["p_type"], ["p_name", "p_partkey"], "ord").drop("p_type")


@query("t2_seeded_split", """
WITH n AS (SELECT o_orderkey, o_orderpriority, count(*) OVER (PARTITION BY o_orderpriority) AS n,
  row_number() OVER (PARTITION BY o_orderpriority
    ORDER BY md5(concat_ws('|', '5', o_orderkey)), o_orderkey) AS pos FROM orders)
SELECT o_orderkey, o_orderpriority,
       CASE WHEN pos <= greatest(1, least(round_even(n * 0.8::DOUBLE, 0), n - 1)) THEN 'train' ELSE 'test' END
         AS split FROM n""")
def t2_seeded_split(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return ordering.seeded_split(orders, ["o_orderkey"], 0.8, 5, ["o_orderpriority"])


@query("t2_holdout_split", """
WITH n AS (SELECT o_orderkey, count(*) OVER () AS n,
  row_number() OVER (ORDER BY md5(concat_ws('|', '6', o_orderkey)), o_orderkey) AS pos FROM orders)
SELECT o_orderkey, CASE WHEN pos <= floor(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM n""")
def t2_holdout_split(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return ordering.holdout_split(orders, ["o_orderkey"], 0.2, 6)


@query("t3_best_row", """
SELECT event_type, arg_max(event_id, (value, -event_id)) AS event_id, max(value) AS value
FROM events GROUP BY event_type""")
def t3_best_row(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", "event_id", "value")
    return posterior.best_row(events, "value", ["event_id"], ["event_type"])


@query("t3_first_stable", """
SELECT user_id, min(event_id) AS event_id, arg_min(value, event_id) AS value
FROM events WHERE value > 30 GROUP BY user_id""")
def t3_first_stable(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return posterior.first_stable(events, "value", ["event_id"], 30.0, ["user_id"])


@query("t5_row_cap", """
SELECT p_type, p_partkey FROM part
QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY md5(concat_ws('|', '9', p_partkey)), p_partkey) <= 200""")
def t5_row_cap(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_type", "p_partkey")
    return ordering.first_rows(part, ["p_partkey"], 200, 9, ["p_type"])


# -- scalar functions ------------------------------------------------------

@query("f1_rbf_kernel", f"""
SELECT {KEYS}, {r('4 * exp(-0.5 * (pow((l_discount - 0.03) / 0.02, 2) + pow((l_tax - 0.04) / 0.05, 2)))')} AS k
FROM lineitem""")
def f1_rbf_kernel(spark, sf_dir):
    x = F.array("l_discount", "l_tax")
    k = expr.rbf_kernel(x, expr.vec([0.03, 0.04]), expr.vec([0.02, 0.05]), F.lit(2.0))
    return rounded(table(spark, sf_dir, "lineitem").select(*ID, k.alias("k")))


@query("f2_sigmoid_mean", f"""
SELECT {KEYS}, {r('1 / (1 + exp(-5 * (0.05::DOUBLE * (l_quantity + 0.5) - 1)))')} AS mean
FROM lineitem""")
def f2_sigmoid_mean(spark, sf_dir):
    x = expr.bin_centre("l_quantity", 0.0, 10.0, 200)
    return rounded(table(spark, sf_dir, "lineitem").select(
        *ID, expr.sigmoid_mean(x, centre=1.0).alias("mean")))


@query("f3_mie_mean", f"""
WITH p AS (SELECT {KEYS}, 12 + l_tax * 50 AS n, 2 + l_discount * 10 AS s, 2 + l_quantity / 10 AS d FROM lineitem)
SELECT {KEYS}, {r('exp(-(n / (n - 6) * pow(n / 6, 6 / (n - 6)) * 0.07 * (pow(s / d, n) - pow(s / d, 6))) / 0.0834)')} AS mean
FROM p""")
def f3_mie_mean(spark, sf_dir):
    d = F.lit(2.0) + F.col("l_quantity") / 10
    g = expr.mie_mean(d, 0.07, F.col("l_discount") * 10 + 2, F.col("l_tax") * 50 + 12, kt=0.0834)
    return rounded(table(spark, sf_dir, "lineitem").select(*ID, g.alias("mean")))


@query("f4_log_densities", f"""
SELECT {KEYS}, {r('-0.5 * pow((l_discount - 0.05) / 0.02, 2) - ln(0.02) - 0.5 * ln(2 * pi())')} AS normal,
  CASE WHEN l_tax BETWEEN 0.01 AND 0.06 THEN {r('-ln(0.05)')} ELSE '-inf'::DOUBLE END AS uniform,
  {r('CASE WHEN l_quantity > 25 THEN 0.05 ELSE 0.035 END::DOUBLE')} AS mean,
  {r('CASE WHEN l_quantity > 25 THEN 0.02 ELSE 0.05 / sqrt(12) END')} AS scale
FROM lineitem""")
def f4_log_densities(spark, sf_dir):
    kind = F.when(F.col("l_quantity") > 25, "normal").otherwise("uniform")
    a = F.when(F.col("l_quantity") > 25, F.lit(0.05)).otherwise(F.lit(0.01))
    b = F.when(F.col("l_quantity") > 25, F.lit(0.02)).otherwise(F.lit(0.06))
    rows = table(spark, sf_dir, "lineitem").select(
        *ID, expr.normal_logpdf(F.col("l_discount"), F.lit(0.05), F.lit(0.02)).alias("normal"),
        expr.uniform_logpdf(F.col("l_tax"), F.lit(0.01), F.lit(0.06)).alias("uniform"),
        expr.prior_mean(kind, a, b).alias("mean"), expr.prior_scale(kind, a, b).alias("scale"))
    shown = rounded(rows, 6, ["normal", "mean", "scale"])
    return shown.withColumn("uniform", F.when(F.col("uniform") < -1e9, F.col("uniform")).otherwise(
        F.round("uniform", 6)))


@query("f5_normal_quantile", f"""
WITH u AS (SELECT o_orderkey, (1 + {u_sql("'q'", 'o_orderkey')}) / 2.0001 AS u FROM orders)
SELECT o_orderkey, {r(normal_quantile_sql('u'))} AS z FROM u""")
def f5_normal_quantile(spark, sf_dir):
    u = (F.lit(1.0) + expr.hash_uniform(F.lit("q"), F.col("o_orderkey"))) / 2.0001
    rows = table(spark, sf_dir, "orders").select("o_orderkey", u.alias("u"))
    return rounded(expr.with_normal_quantile(rows, "u", "z").drop("u"))


@query("f9_number_text", """
SELECT event_id, printf('%.4f', value / 7) AS fixed4 FROM events""")
def f9_number_text(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", expr.fixed4(F.col("value") / 7).alias("fixed4"))


@query("f10_duration_text", """
WITH s AS (SELECT o_orderkey, floor(o_totalprice / 10)::BIGINT AS s FROM orders)
SELECT o_orderkey, CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s // 60 % 60) || 'm ' || (s % 60) || 's'
  WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS duration FROM s""")
def f10_duration_text(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", expr.duration_text(F.col("o_totalprice") / 10).alias("duration"))


@query("f12_system_ids", """
SELECT p_partkey, CASE WHEN p_partkey < 1000 THEN lpad(p_partkey::VARCHAR, 3, '0')
                       ELSE p_partkey::VARCHAR END AS system_id FROM part""")
def f12_system_ids(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", expr.pad_id("p_partkey").alias("system_id"))


@query("p18_sanitize", """
SELECT event_id, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN '-inf'::DOUBLE ELSE value END AS score
FROM events""")
def p18_sanitize(spark, sf_dir):
    i = F.col("event_id")
    score = (F.when(F.pmod(i, F.lit(5)) == 0, F.lit(float("nan")))
             .when(F.pmod(i, F.lit(7)) == 0, F.lit(float("inf"))).otherwise(F.col("value")))
    return posterior.sanitize(table(spark, sf_dir, "events").select(
        "event_id", score.alias("score")), "score")
