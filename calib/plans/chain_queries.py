"""Chain diagnostics and posterior summaries on the draws views."""

from __future__ import annotations

from pyspark.sql import functions as F

from calib.functions.expr import normal_quantile_sql
from calib.operators import chains, ordering, summary
from calib.plans.base import (
    EVENT_DRAWS, LINE_DRAWS, LINE_DRAWS_WIDE, LINE_PARAMS, event_draws, line_draws,
    line_draws_wide, query, r, rounded, table,
)

Z = normal_quantile_sql("u")


def _rank_cte(name: str, source: str, value: str) -> str:
    return f"""
{name} AS (
  SELECT param, chain, step, {Z} AS value FROM (
    SELECT param, chain, step,
      greatest(1e-12, least(1 - 1e-12,
        (row_number() OVER (PARTITION BY param ORDER BY {value}, step, chain) - 0.375e0)
        / (count(*) OVER (PARTITION BY param) + 0.25e0))) AS u
    FROM {source}))"""


def _rhat_cte(name: str, source: str) -> str:
    return f"""
{name} AS (
  SELECT param, sqrt(((max(n) - 1.0::DOUBLE) / max(n) * avg(v) + var_samp(m)) / avg(v)) AS rhat
  FROM (
    SELECT param, chain, half, count(*) AS n, avg(value) AS m, var_samp(value) AS v
    FROM (
      SELECT *, CASE WHEN step < h THEN 0 WHEN step >= steps - h THEN 1 END AS half
      FROM (SELECT s.*, (t.steps // 2) AS h, t.steps FROM {source} s
            JOIN (SELECT param, max(step) + 1 AS steps FROM {source} GROUP BY param) t
            USING (param)))
    WHERE half IS NOT NULL GROUP BY ALL)
  GROUP BY param)"""


FOLDED = """
folded AS (
  SELECT param, chain, step, abs(value - med) AS value
  FROM draws JOIN (SELECT param, quantile_disc(value, 0.5) AS med FROM draws GROUP BY param)
  USING (param))"""

RANK_RHAT = f"""{_rank_cte('ranked', 'draws', 'value')}, {FOLDED},
{_rank_cte('ranked_folded', 'folded', 'value')},
{_rhat_cte('rhat_a', 'ranked')}, {_rhat_cte('rhat_b', 'ranked_folded')}"""


def _tau_ctes(source: str) -> str:
    return f"""
centred AS (
  SELECT param, chain, step, value - avg(value) OVER (PARTITION BY param, chain) AS x,
         count(*) OVER (PARTITION BY param, chain) AS n
  FROM {source}),
acov AS (
  SELECT param, chain, lag, sum(p) / (max(n) - lag) AS c
  FROM (SELECT a.param, a.chain, (b.step - a.step)::INTEGER AS lag, a.x * b.x AS p, a.n
        FROM centred a JOIN centred b
        ON a.param = b.param AND a.chain = b.chain AND b.step >= a.step)
  GROUP BY param, chain, lag),
rho AS (
  SELECT param, chain, lag, CASE WHEN v > 0 THEN c / v ELSE 0.0::DOUBLE END AS rho
  FROM (SELECT *, max(CASE WHEN lag = 0 THEN c END) OVER (PARTITION BY param, chain) AS v
        FROM acov)),
tau AS (
  SELECT param, chain, greatest(1.0::DOUBLE,
    1 + 2 * coalesce(sum(rho) FILTER (lag > 0 AND lag < coalesce(cut, 1000000000)), 0)) AS tau
  FROM (SELECT *, min(CASE WHEN lag > 0 AND rho <= 0 THEN lag END)
                    OVER (PARTITION BY param, chain) AS cut FROM rho)
  GROUP BY param, chain)"""


@query("w1_rank_normalize", f"""
WITH {LINE_DRAWS}, {_rank_cte('ranked', 'draws', 'value')}
SELECT param, chain, step, {r('value')} AS z FROM ranked""")
def w1_rank_normalize(spark, sf_dir):
    return rounded(chains.rank_normalize(line_draws(spark, sf_dir)).select(
        "param", "chain", "step", "z"))


@query("w2_fold", f"""
WITH {LINE_DRAWS}, {FOLDED}
SELECT param, chain, step, {r('value')} AS folded FROM folded""")
def w2_fold(spark, sf_dir):
    return rounded(chains.fold(line_draws(spark, sf_dir)).select(
        "param", "chain", "step", "folded"))


@query("w3_split_halves", f"""
WITH {EVENT_DRAWS}, t AS (SELECT max(step) + 1 AS n FROM draws)
SELECT param, chain, CASE WHEN step < n // 2 THEN 0 ELSE 1 END::INTEGER AS half,
       count(*) AS n, min(step) AS first_step, max(step) AS last_step
FROM draws, t WHERE step < n // 2 OR step >= n - n // 2 GROUP BY ALL""")
def w3_split_halves(spark, sf_dir):
    return chains.split_halves(event_draws(spark, sf_dir)).groupBy("param", "chain", "half").agg(
        F.count(F.lit(1)).alias("n"), F.min("step").alias("first_step"),
        F.max("step").alias("last_step"))


@query("w4_split_rhat", f"""
WITH {LINE_DRAWS}, {_rhat_cte('rhat_a', 'draws')}
SELECT param, {r('rhat', 8)} AS rhat FROM rhat_a""")
def w4_split_rhat(spark, sf_dir):
    return rounded(chains.split_rhat(line_draws(spark, sf_dir)), 8)


@query("w4_rank_split_rhat", f"""
WITH {LINE_DRAWS}, {RANK_RHAT}
SELECT param, {r('a.rhat', 8)} AS rhat_rank, {r('b.rhat', 8)} AS rhat_folded,
       {r('greatest(a.rhat, b.rhat)', 8)} AS rhat
FROM rhat_a a JOIN rhat_b b USING (param)""")
def w4_rank_split_rhat(spark, sf_dir):
    return rounded(chains.rank_split_rhat(line_draws(spark, sf_dir)), 8)


@query("w5_autocorrelation", f"""
WITH {EVENT_DRAWS}, {_tau_ctes('draws')}
SELECT param, chain, lag, {r('rho')} AS rho FROM rho""")
def w5_autocorrelation(spark, sf_dir):
    rho = chains.autocorrelation(event_draws(spark, sf_dir))
    return rounded(rho.select("param", "chain", "lag", "rho"))


@query("w6_autocorr_time", f"""
WITH {EVENT_DRAWS}, {_tau_ctes('draws')}
SELECT param, chain, {r('tau')} AS tau FROM tau""")
def w6_autocorr_time(spark, sf_dir):
    return rounded(chains.autocorr_time(event_draws(spark, sf_dir)))


@query("w7_convergence", f"""
WITH {EVENT_DRAWS}, {RANK_RHAT}, {_tau_ctes('ranked')},
rows_ AS (
  SELECT param, greatest(a.rhat, b.rhat) AS rhat,
         (SELECT max(step) + 1 FROM draws) AS n_steps,
         (SELECT count(*) FROM draws) AS n_draws,
         (SELECT avg(tau) FROM tau) AS tau
  FROM rhat_a a JOIN rhat_b b USING (param))
SELECT param, n_steps, n_draws, {r('rhat')} AS rhat, {r('tau')} AS tau,
       {r('n_draws / tau', 4)} AS ess, {r('rhat')} AS max_rhat,
       {r('n_draws / tau', 4)} AS min_ess,
       (n_steps >= 20 AND rhat < 1.05 AND n_draws / tau > 100) AS converged
FROM rows_""")
def w7_convergence(spark, sf_dir):
    report = chains.convergence_report(event_draws(spark, sf_dir), rhat_max=1.05)
    return rounded(rounded(report, 6, ["rhat", "tau", "max_rhat"]), 4, ["ess", "min_ess"])


@query("p6_burn_in_thinning", f"""
WITH {EVENT_DRAWS}
SELECT chain, step, param, value FROM draws WHERE step >= 10 AND (step - 10) % 3 = 0""")
def p6_burn_in_thinning(spark, sf_dir):
    return chains.thin(event_draws(spark, sf_dir), 10, 3)


@query("p6_default_thinning", f"""
WITH {EVENT_DRAWS}, {_tau_ctes('draws')},
c AS (SELECT floor(2 * max(tau))::BIGINT AS d,
             greatest(1, floor(0.5 * min(tau))::BIGINT) AS t FROM tau)
SELECT chain, count(*) AS n, min(step) AS first_step, {r('sum(value)', 4)} AS total
FROM draws, c WHERE step >= d AND (step - d) % t = 0 GROUP BY chain""")
def p6_default_thinning(spark, sf_dir):
    draws = event_draws(spark, sf_dir)
    discard, stride = chains.default_thinning(chains.autocorr_time(draws))
    kept = chains.thin(draws, discard, stride)
    return rounded(kept.groupBy("chain").agg(
        F.count(F.lit(1)).alias("n"), F.min("step").alias("first_step"),
        F.sum("value").alias("total")), 4)


@query("a12_covariance", f"""
WITH {LINE_DRAWS_WIDE}
SELECT i AS param_i, j AS param_j, n, {r('cov', 4)} AS cov,
       {r('cov * 2.38e0 * 2.38e0 / 3', 4)} AS proposal_cov
FROM (
""" + " UNION ALL ".join(
    f"SELECT '{a}' AS i, '{b}' AS j, count(*) AS n, covar_samp({a}, {b}) AS cov FROM wide"
    for a in LINE_PARAMS for b in LINE_PARAMS) + ")")
def a12_covariance(spark, sf_dir):
    return rounded(chains.covariance(line_draws_wide(spark, sf_dir), [], LINE_PARAMS), 4)


@query("a16_acceptance_rate", f"""
WITH {LINE_DRAWS_WIDE}, l AS (
  SELECT *, lag(l_quantity) OVER w AS q, lag(l_discount) OVER w AS d
  FROM wide WINDOW w AS (PARTITION BY chain ORDER BY step))
SELECT count(*) AS n_moves,
       {r('avg((q <> l_quantity OR d <> l_discount)::INTEGER::DOUBLE)', 8)} AS acceptance_rate
FROM l WHERE q IS NOT NULL""")
def a16_acceptance_rate(spark, sf_dir):
    return rounded(chains.acceptance_rate(
        line_draws_wide(spark, sf_dir), [], ["l_quantity", "l_discount"]), 8)


@query("q6_incomplete_steps", f"""
WITH d AS (
  SELECT user_id AS chain, value,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step FROM events)
SELECT step, count(*) AS n_values, count(*) AS n_cells,
       (SELECT count(DISTINCT chain) FROM d) AS expected
FROM d GROUP BY step HAVING count(*) <> (SELECT count(DISTINCT chain) FROM d)""")
def q6_incomplete_steps(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("chain"), "ts", "event_id", F.lit("value").alias("param"), "value")
    rows = ordering.number_rows(events, ["chain"], ["ts", "event_id"], "step")
    return chains.incomplete_steps(rows.withColumn("step", F.col("step") - 1))


# -- summaries -------------------------------------------------------------

PREPARED_PARAMS = ("l_quantity", "l_extendedprice")
STRIPPED = f"""{LINE_DRAWS_WIDE},
kept AS (SELECT * FROM wide WHERE step >= 20 AND (step - 20) % 2 = 0),
edges AS (SELECT quantile_cont(l_quantity, 0.005) AS q0, quantile_cont(l_quantity, 0.995) AS q1,
                 quantile_cont(l_extendedprice, 0.005) AS e0,
                 quantile_cont(l_extendedprice, 0.995) AS e1 FROM kept),
prepared AS (SELECT kept.* FROM kept, edges
             WHERE l_quantity BETWEEN q0 AND q1 AND l_extendedprice BETWEEN e0 AND e1)"""


def prepared(spark, sf_dir):
    wide = line_draws_wide(spark, sf_dir).select("chain", "step", *PREPARED_PARAMS)
    return summary.prepare_samples(wide, PREPARED_PARAMS, 20, 2)


@query("p7_strip_outliers", f"""
WITH {LINE_DRAWS_WIDE}, edges AS (
  SELECT quantile_cont(l_quantity, 0.005) AS q0, quantile_cont(l_quantity, 0.995) AS q1,
         quantile_cont(l_extendedprice, 0.005) AS e0, quantile_cont(l_extendedprice, 0.995) AS e1
  FROM wide)
SELECT chain, step, l_quantity, l_extendedprice FROM wide, edges
WHERE l_quantity BETWEEN q0 AND q1 AND l_extendedprice BETWEEN e0 AND e1""")
def p7_strip_outliers(spark, sf_dir):
    wide = line_draws_wide(spark, sf_dir).select("chain", "step", *PREPARED_PARAMS)
    return summary.strip_outliers(wide, PREPARED_PARAMS)


@query("p8_nuisance_transform", f"""
SELECT l_orderkey, l_linenumber, l_partkey, {r('exp(l_discount - 1)', 8)} AS sigma_q
FROM lineitem""")
def p8_nuisance_transform(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        (F.col("l_discount") - 1).alias("log_sigma_q"))
    once = summary.exp_nuisances(lines)
    return rounded(summary.exp_nuisances(summary.log_nuisances(once)), 8)


@query("g15_prepared_samples", f"""
WITH {STRIPPED}
SELECT chain, step, l_quantity, l_extendedprice FROM prepared""")
def g15_prepared_samples(spark, sf_dir):
    return prepared(spark, sf_dir)


@query("a13_summary_with_times", f"""
WITH {STRIPPED},
raw_draws AS (SELECT chain, step, 'l_quantity' AS param, l_quantity AS value FROM wide
         UNION ALL SELECT chain, step, 'l_extendedprice', l_extendedprice FROM wide), {_tau_ctes('raw_draws')},
t AS (SELECT param, avg(tau) AS autocorr_time FROM tau GROUP BY param),
m AS (SELECT 'l_quantity' AS param, avg(l_quantity) AS mean, stddev_pop(l_quantity) AS std FROM prepared
      UNION ALL SELECT 'l_extendedprice', avg(l_extendedprice), stddev_pop(l_extendedprice) FROM prepared)
SELECT param, {r('mean')} AS mean, {r('std')} AS std, {r('autocorr_time')} AS autocorr_time FROM m JOIN t USING (param)""")
def a13_summary_with_times(spark, sf_dir):
    return rounded(summary.posterior_summary(prepared(spark, sf_dir), PREPARED_PARAMS, line_draws(spark, sf_dir)))


@query("a13_posterior_summary", f"""
WITH {STRIPPED}
SELECT 'l_quantity' AS param, {r('avg(l_quantity)')} AS mean,
       {r('stddev_pop(l_quantity)')} AS std FROM prepared
UNION ALL SELECT 'l_extendedprice', {r('avg(l_extendedprice)', 6)},
       {r('stddev_pop(l_extendedprice)')} FROM prepared""")
def a13_posterior_summary(spark, sf_dir):
    return rounded(summary.posterior_summary(prepared(spark, sf_dir), PREPARED_PARAMS))


@query("x4_sample_transform", f"""
WITH {LINE_DRAWS_WIDE},
kept AS (SELECT chain, step, ln(l_extendedprice) AS log_price FROM wide WHERE step >= 20 AND (step - 20) % 2 = 0),
edges AS (SELECT quantile_cont(log_price, 0.005) AS a, quantile_cont(log_price, 0.995) AS b FROM kept)
SELECT chain, step, {r('log_price')} AS log_price FROM kept, edges WHERE log_price BETWEEN a AND b""")
def x4_sample_transform(spark, sf_dir):
    wide = line_draws_wide(spark, sf_dir).select("chain", "step", "l_extendedprice")
    to_log = lambda df: df.select(
        "chain", "step", F.log("l_extendedprice").alias("log_price"))
    return rounded(summary.prepare_samples(wide, ["l_extendedprice"], 20, 2, transform=to_log))


@query("a14_robust_standardize", f"""
SELECT event_id, {r('(value - q2) / CASE WHEN q3 - q1 > 1e-12 THEN q3 - q1 WHEN sd > 1e-12 THEN sd ELSE 1 END')} AS score
FROM events JOIN (
  SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2,
         quantile_cont(value, 0.75) AS q3, stddev_pop(value) AS sd
  FROM events GROUP BY event_type) USING (event_type)""")
def a14_robust_standardize(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return rounded(summary.robust_standardize(events, ["event_type"], "value").select(
        "event_id", "score"))


@query("a15_credible_interval", f"""
WITH {LINE_DRAWS}, q AS (
  SELECT param, quantile_cont(value, 0.16) AS a, quantile_cont(value, 0.5) AS b,
         quantile_cont(value, 0.84) AS c FROM draws GROUP BY param)
SELECT param, {r('b')} AS median, {r('c - b')} AS upper, {r('b - a')} AS lower FROM q""")
def a15_credible_interval(spark, sf_dir):
    return rounded(summary.credible_intervals(line_draws_wide(spark, sf_dir), LINE_PARAMS))


@query("flagship_posterior_report", f"""
WITH {STRIPPED}, {LINE_DRAWS.split(LINE_DRAWS_WIDE)[1].lstrip().lstrip(',')},
{RANK_RHAT},
s AS (SELECT 'l_quantity' AS param, avg(l_quantity) AS mean, stddev_pop(l_quantity) AS std,
             quantile_cont(l_quantity, 0.16) AS a, quantile_cont(l_quantity, 0.5) AS b,
             quantile_cont(l_quantity, 0.84) AS c FROM prepared
      UNION ALL SELECT 'l_extendedprice', avg(l_extendedprice), stddev_pop(l_extendedprice),
             quantile_cont(l_extendedprice, 0.16), quantile_cont(l_extendedprice, 0.5),
             quantile_cont(l_extendedprice, 0.84) FROM prepared)
SELECT param, {r('mean')} AS mean, {r('std')} AS std, {r('b')} AS median, {r('c - b')} AS upper,
       {r('b - a')} AS lower, {r('greatest(x.rhat, y.rhat)')} AS rhat
FROM s JOIN rhat_a x USING (param) JOIN rhat_b y USING (param)""")
def flagship_posterior_report(spark, sf_dir):
    wide = line_draws_wide(spark, sf_dir)
    rows = summary.prepare_samples(
        wide.select("chain", "step", *PREPARED_PARAMS), PREPARED_PARAMS, 20, 2)
    draws = summary.to_long(wide, PREPARED_PARAMS, ["chain", "step"])
    report = (summary.posterior_summary(rows, PREPARED_PARAMS)
              .join(summary.credible_intervals(rows, PREPARED_PARAMS), "param")
              .join(chains.rank_split_rhat(draws).select("param", "rhat"), "param"))
    return rounded(report)


def _kde_ctes(n_points: int) -> str:
    return f"""
src AS (SELECT value AS x FROM events),
st AS (SELECT count(*) AS n, min(x) AS lo, max(x) AS hi,
              stddev_samp(x) * pow(count(*), -0.2) AS h FROM src),
grid AS (SELECT i::INTEGER AS point, lo + i * (hi - lo) / {n_points - 1} AS g
         FROM st, range({n_points}) t(i)),
dens AS (
  SELECT point, g AS x,
         sum(c * exp(-0.5 * pow((v.x - g) / h, 2))) / max(n * h * sqrt(2 * pi())) AS density
  FROM grid, st, (SELECT x, count(*) AS c FROM src GROUP BY x) v GROUP BY ALL)"""


@query("a19_kde", f"""
WITH {_kde_ctes(400)}
SELECT point, {r('x')} AS x, {r('density', 8)} AS density FROM dens""")
def a19_kde(spark, sf_dir):
    return rounded(rounded(summary.kde(table(spark, sf_dir, "events"), "value", 400),
                           6, ["x"]), 8, ["density"])


@query("a19_kde_2d", f"""
WITH src AS (SELECT l_quantity AS x, l_discount AS y FROM lineitem),
st AS (SELECT count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1,
              var_samp(x) * f AS vx, var_samp(y) * f AS vy, covar_samp(x, y) * f AS vxy
       FROM src, (SELECT pow(count(*), -1.0 / 3) AS f FROM src) GROUP BY f),
grid AS (SELECT i::INTEGER AS point_x, j::INTEGER AS point_y,
                x0 + i * (x1 - x0) / 39 AS gx, y0 + j * (y1 - y0) / 39 AS gy
         FROM st, range(40) a(i), range(40) b(j)),
dens AS (
  SELECT point_x, point_y, gx, gy,
         sum(c * exp(-0.5 * (vy * (x - gx) * (x - gx) - 2 * vxy * (x - gx) * (y - gy)
                             + vx * (y - gy) * (y - gy)) / (vx * vy - vxy * vxy)))
         / max(n * 2 * pi() * sqrt(vx * vy - vxy * vxy)) AS density
  FROM grid, st, (SELECT x, y, count(*) AS c FROM src GROUP BY x, y) GROUP BY ALL)
SELECT point_x, point_y, {r('gx')} AS x, {r('gy')} AS y, {r('density', 8)} AS density FROM dens""")
def a19_kde_2d(spark, sf_dir):
    d = summary.kde_2d(table(spark, sf_dir, "lineitem"), "l_quantity", "l_discount", 40)
    return rounded(rounded(d, 6, ["x", "y"]), 8, ["density"])


@query("a20_posterior_mode", f"""
WITH {_kde_ctes(1000)}
SELECT 'value' AS param, {r('x')} AS mode, {r('density', 8)} AS density
FROM dens ORDER BY dens.density DESC, dens.point LIMIT 1""")
def a20_posterior_mode(spark, sf_dir):
    m = summary.posterior_modes(table(spark, sf_dir, "events"), ["value"], 1000)
    return rounded(rounded(m, 6, ["mode"]), 8, ["density"])


@query("a21_responsibilities", f"""
WITH {_kde_ctes(100)},
sd AS (SELECT greatest(pow(count(*), -0.2) * stddev_pop(value),
                       (max(value) - min(value)) / 100, 1e-8) AS b FROM events),
sc AS (SELECT value AS x, hour(ts) / 23.0::DOUBLE AS s1, ln(1 + value) / 5 AS s2 FROM events),
loc AS (
  SELECT point, g, sum(k * s1) / greatest(sum(k), 1e-12) AS l1,
         sum(k * s2) / greatest(sum(k), 1e-12) AS l2
  FROM (SELECT point, g, s1, s2, exp(-0.5 * pow((sc.x - g) / b, 2)) AS k FROM grid, sd, sc)
  GROUP BY point, g),
base AS (SELECT sum(l1 * density) / sum(density) AS b1, sum(l2 * density) / sum(density) AS b2
         FROM loc JOIN dens USING (point)),
e AS (SELECT point, g, exp((l1 - b1) / 0.7) AS e1, exp((l2 - b2) / 0.7) AS e2 FROM loc, base)
SELECT point, {r('g')} AS x, 's1' AS qoi, {r('e1 / (e1 + e2)', 8)} AS responsibility FROM e
UNION ALL SELECT point, {r('g')}, 's2', {r('e2 / (e1 + e2)', 8)} FROM e""")
def a21_responsibilities(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.col("value").alias("x"), (F.hour("ts") / 23.0).alias("s1"),
        (F.log(F.col("value") + 1) / 5).alias("s2"))
    shares = summary.responsibilities(rows, "x", ["s1", "s2"], 100)
    return rounded(rounded(shares, 6, ["x"]), 8, ["responsibility"])


@query("f7_softmax", f"""
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity / 50 AS a,
                  l_discount * 10 AS b, l_tax * 10 AS c FROM lineitem),
e AS (SELECT *, exp(a / 0.7) AS ea, exp(b / 0.7) AS eb, exp(c / 0.7) AS ec FROM s)
SELECT l_orderkey, l_linenumber, l_partkey, {r('ea / (ea + eb + ec)')} AS share_a,
       {r('eb / (ea + eb + ec)')} AS share_b, {r('ec / (ea + eb + ec)')} AS share_c FROM e""")
def f7_softmax(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") / 50).alias("a"),
        (F.col("l_discount") * 10).alias("b"), (F.col("l_tax") * 10).alias("c"))
    a, b, c = summary.softmax_columns(["a", "b", "c"], 0.7)
    return rounded(rows.select("l_orderkey", "l_linenumber", "l_partkey", a.alias("share_a"),
                               b.alias("share_b"), c.alias("share_c")))


@query("w11_progress_marks", """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS mark,
                  count(*) OVER (PARTITION BY user_id) AS c FROM events)
SELECT user_id, event_id, mark FROM n WHERE mark % 10 = 0 OR mark = c""")
def w11_progress_marks(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return ordering.every_nth(events, ["user_id"], ["ts", "event_id"], 10, "mark").drop("ts")
