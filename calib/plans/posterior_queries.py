"""Surrogates trained on nation aggregates, posterior scores and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from calib.operators import curves, ordering, posterior, surrogate, tiles
from calib.plans.base import LINE_KEY, query, r, rounded, table
from calib.plans.design_queries import ID
from calib.session import materialize

QOIS = ("F", "O", "P")
HYPER = [(q, 0, [0.8, 1.2], 1.0, 0.05) for q in QOIS] + [(q, 1, [1.5, 0.6], 0.8, 0.1) for q in QOIS]
N_EFF = {"F": 6.0, "O": 8.0, "P": 4.0}
PRIORS = [("x1", "normal", 0.0, 0.5), ("x2", "uniform", -1.0, 1.0), ("log_sigma_O", "normal", -2.0, 2.0)]
SIGMA = {"F": 0.3, "P": 0.5}


def training(spark, sf_dir):
    """(train_x, train_y): one training row per nation; monthly order totals by status.

    The few totals are stored, so orders and customers are joined once for each, however
    often the training rows are read.
    """
    joined = table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "customer").select(
            F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("train_id"),
            "c_acctbal"), "o_custkey")
    sizes = materialize(joined.groupBy("train_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("c_acctbal").alias("b")), "sizes")
    total = sizes.agg((F.sum("n") / F.count(F.lit(1))).alias("mean_n")).first()[0]
    train_x = sizes.select("train_id", F.array(
        F.col("b") / 500.0 - 9.0, F.col("n") / F.lit(float(total)) * 10.0 - 10.0).alias("params"))
    sums = materialize(joined.groupBy(
        "train_id", F.col("o_orderstatus").alias("qoi"),
        (F.month("o_orderdate") - 1).cast("int").alias("bin")).agg(F.sum("o_totalprice").alias("value")), "sums")
    filled = curves.fill_bins(sums, ["train_id", "qoi"], 12, "value")
    train_y = filled.join(sizes, "train_id").select(
        "train_id", "qoi", F.col("bin").alias("pos"),
        (F.col("value") * 36.0 / (F.col("n") * 1e5)).alias("value"))
    return train_x, train_y


def hyper(spark):
    return spark.createDataFrame(
        HYPER, "qoi string, member int, lengths array<double>, width double, noise double")


TRAINING = """
joined AS (SELECT o.*, c_nationkey::BIGINT AS train_id, c_acctbal FROM orders o JOIN customer ON c_custkey = o_custkey),
sizes AS (SELECT train_id, count(*) AS n, avg(c_acctbal) AS b FROM joined GROUP BY train_id),
tx AS (SELECT train_id, b / 500 - 9 AS x1, n / (SELECT sum(n) / count(*) FROM sizes)::DOUBLE * 10 - 10 AS x2 FROM sizes),
ty AS (
  SELECT train_id, qoi, pos, coalesce(v, 0) * 36 / (n * 1e5::DOUBLE) AS value
  FROM (SELECT DISTINCT train_id, o_orderstatus AS qoi, i::INTEGER AS pos FROM joined, range(12) t(i))
  LEFT JOIN (SELECT train_id, o_orderstatus AS qoi, (month(o_orderdate) - 1)::INTEGER AS pos,
                    sum(o_totalprice) AS v FROM joined GROUP BY ALL) USING (train_id, qoi, pos)
  JOIN sizes USING (train_id)),
hyper(qoi, member, l1, l2, width, noise) AS (VALUES """ + ", ".join(
    f"('{q}', {m}::INTEGER, {a[0]}::DOUBLE, {a[1]}::DOUBLE, {w}::DOUBLE, {s}::DOUBLE)"
    for q, m, a, w, s in HYPER) + """),
mean AS (SELECT qoi, avg(value) AS mean FROM ty GROUP BY qoi)"""


def _gp_sql(tx: str = "tx", ty: str = "ty") -> str:
    """Kernel table and weights by Gauss-Jordan elimination over lists."""
    return f"""
km AS (SELECT qoi, member, a.train_id AS i, b.train_id AS j,
              width * width * exp(-0.5 * (pow((a.x1 - b.x1) / l1, 2) + pow((a.x2 - b.x2) / l2, 2)))
              + CASE WHEN a.train_id = b.train_id THEN noise ELSE 0 END AS k
       FROM hyper, {tx} a, {tx} b),
krow AS (SELECT qoi, member, i, list(k ORDER BY j) AS kr FROM km GROUP BY ALL),
yrow AS (SELECT qoi, train_id AS i, list(value - mean ORDER BY pos) AS yr FROM {ty} JOIN mean USING (qoi) GROUP BY ALL),
aug AS (SELECT qoi, member, list(list_concat(kr, yr) ORDER BY i) AS m, count(*) AS n, list(i ORDER BY i) AS ids
        FROM krow JOIN yrow USING (qoi, i) GROUP BY qoi, member),
gj(qoi, member, ids, n, k, m) AS (
  SELECT qoi, member, ids, n, 0, m FROM aug
  UNION ALL
  SELECT qoi, member, ids, n, k + 1,
    list_transform(m, lambda row, i: CASE WHEN i = k + 1
      THEN list_transform(row, lambda v: v / row[k + 1])
      ELSE list_transform(row, lambda v, c: v - row[k + 1] * m[k + 1][c] / m[k + 1][k + 1]) END)
  FROM gj WHERE k < n),
weights AS (
  SELECT qoi, member, ids[i] AS train_id, (p - 1)::INTEGER AS pos, m[i][n + p] AS alpha
  FROM gj, range(1, 13) t(p), range(1, (SELECT max(n) + 1 FROM aug)) u(i) WHERE k = n AND i <= n)"""


def _predict_sql(queries: str, key: str, tx: str = "tx") -> str:
    return f"""
pred AS (
  SELECT {key}, qoi, pos, avg(value) AS value FROM (
    SELECT {key}, q.qoi, q.member, pos, any_value(mean) + sum(k * alpha) AS value FROM (
      SELECT {key}, qoi, member, train_id,
             width * width * exp(-0.5 * (pow((t.x1 - q.x1) / l1, 2) + pow((t.x2 - q.x2) / l2, 2))) AS k
      FROM {queries} q, hyper, {tx} t) q
    JOIN weights USING (qoi, member, train_id) JOIN mean ON mean.qoi = q.qoi GROUP BY ALL)
  GROUP BY ALL)"""


def fitted(spark, sf_dir):
    train_x, train_y = training(spark, sf_dir)
    sets = surrogate.training_sets(train_x, train_y)
    mean = curves.mean_outputs(train_y).select("qoi", F.array("value").alias("mean"))
    return surrogate.solve_weights(sets, hyper(spark), mean)


@query("g1_mean_centring", f"""
WITH {TRAINING}
SELECT train_id, qoi, pos, {r('value - mean')} AS value FROM ty JOIN mean USING (qoi)""")
def g1_mean_centring(spark, sf_dir):
    _, train_y = training(spark, sf_dir)
    return rounded(surrogate.centre(train_y, curves.mean_outputs(train_y)).select(
        "train_id", "qoi", "pos", "value"))


@query("g2_kernel_table", f"""
WITH RECURSIVE {TRAINING}, {_gp_sql()}
SELECT qoi, member, i, j, {r('k')} AS k FROM km""")
def g2_kernel_table(spark, sf_dir):
    sets = surrogate.training_sets(*training(spark, sf_dir))
    return rounded(surrogate.kernel_table(sets, hyper(spark)))


@query("g3_weight_solve", f"""
WITH RECURSIVE {TRAINING}, {_gp_sql()}
SELECT qoi, member, train_id, pos, {r('alpha')} AS alpha FROM weights""")
def g3_weight_solve(spark, sf_dir):
    return rounded(surrogate.weight_table(fitted(spark, sf_dir)))


@query("g3_tiled_weights", f"""
WITH RECURSIVE {TRAINING}, {_gp_sql()}
SELECT qoi, member, train_id, pos, {r('alpha')} AS alpha FROM weights""")
def g3_tiled_weights(spark, sf_dir):
    """The same weights from tiles of eight training rows."""
    train_x, train_y = training(spark, sf_dir)
    mean = curves.mean_outputs(train_y).select("qoi", F.array("value").alias("mean"))
    return rounded(tiles.tile_weights(train_x, train_y, hyper(spark), mean, 8))


def customer_queries(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.array(
        F.col("c_acctbal") / 5000 - 1, F.pmod("c_custkey", F.lit(17)) / 8.0 - 1).alias("params"))


CUSTOMERS = "qs AS (SELECT c_custkey, c_acctbal / 5000 - 1 AS x1, c_custkey % 17 / 8.0::DOUBLE - 1 AS x2 FROM customer)"


@query("g4_predict_committee", f"""
WITH RECURSIVE {TRAINING}, {_gp_sql()}, {CUSTOMERS}, {_predict_sql('qs', 'c_custkey')}
SELECT c_custkey, qoi, pos, {r('value')} AS value FROM pred""")
def g4_predict_committee(spark, sf_dir):
    models = surrogate.collect_models(fitted(spark, sf_dir))
    return rounded(surrogate.predict(customer_queries(spark, sf_dir), "c_custkey", models))


@query("g5_stochastic_member", f"""
WITH RECURSIVE {TRAINING}, {_gp_sql()},
qs AS (SELECT c_custkey, c_acctbal / 5000 - 1 AS x1, c_custkey % 17 / 8.0::DOUBLE - 1 AS x2,
              floor(2 * (('0x' || substr(md5(concat_ws('|', '4', c_custkey)), 1, 8))::BIGINT / 4294967296.0::DOUBLE))::INTEGER AS pick
       FROM customer)
SELECT c_custkey, q.qoi, pos, {r('any_value(mean) + sum(k * alpha)')} AS value FROM (
  SELECT c_custkey, qoi, member, train_id,
         width * width * exp(-0.5 * (pow((t.x1 - q.x1) / l1, 2) + pow((t.x2 - q.x2) / l2, 2))) AS k
  FROM qs q JOIN hyper ON member = pick, tx t) q
JOIN weights USING (qoi, member, train_id) JOIN mean ON mean.qoi = q.qoi GROUP BY ALL""")
def g5_stochastic_member(spark, sf_dir):
    models = surrogate.collect_models(fitted(spark, sf_dir))
    return rounded(surrogate.predict(customer_queries(spark, sf_dir), "c_custkey", models, 4))


@query("g6_holdout_error", f"""
WITH RECURSIVE {TRAINING.replace('mean AS (SELECT qoi, avg(value) AS mean FROM ty GROUP BY qoi)', '')}
split AS (SELECT train_id, row_number() OVER (ORDER BY md5(concat_ws('|', '8', train_id)), train_id) AS pos,
                 count(*) OVER () AS n FROM tx),
side AS (SELECT train_id, pos <= greatest(1, least(round_even(n * 0.8::DOUBLE, 0), n - 1)) AS train FROM split),
mean AS (SELECT qoi, avg(value) AS mean FROM ty GROUP BY qoi),
txa AS (SELECT tx.* FROM tx JOIN side USING (train_id) WHERE train),
tya AS (SELECT ty.* FROM ty JOIN side USING (train_id) WHERE train),
qs AS (SELECT tx.train_id AS query_id, x1, x2 FROM tx JOIN side USING (train_id) WHERE NOT train),
{_gp_sql('txa', 'tya')}, {_predict_sql('qs', 'query_id', 'txa')},
e AS (SELECT qoi, query_id, sum(abs(ty.value - pred.value)) / (sum(abs(ty.value)) + sum(abs(pred.value))) AS e
      FROM pred JOIN ty USING (qoi, pos) WHERE ty.train_id = query_id GROUP BY ALL)
SELECT qoi, {r('avg(e) * 100')} AS smape FROM e GROUP BY qoi""")
def g6_holdout_error(spark, sf_dir):
    train_x, train_y = training(spark, sf_dir)
    split = ordering.seeded_split(train_x.select("train_id"), ["train_id"], 0.8, 8)
    mean = curves.mean_outputs(train_y).select("qoi", F.array("value").alias("mean"))
    return rounded(surrogate.holdout_error(train_x, train_y, hyper(spark), split, mean))


def candidates(spark, sf_dir):
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        F.explode(F.array(*[F.lit(q) for q in QOIS])).alias("qoi"), n.cast("long").alias("cand_id"),
        F.array(n * 0.05 - 0.5, n * -0.04 + 0.3, n * 0.02 - 0.2, n * 0.05 - 2.5).alias("log_hyper"))


LOO = f"""
cand AS (SELECT q AS qoi, n_nationkey::BIGINT AS cand_id, exp(n_nationkey * 0.05 - 0.5) AS l1,
                exp(n_nationkey * -0.04 + 0.3) AS l2, exp(n_nationkey * 0.02 - 0.2) AS w,
                exp(n_nationkey * 0.05 - 2.5) AS s
         FROM nation, (VALUES ('F'), ('O'), ('P')) v(q)),
ckm AS (SELECT qoi, cand_id, a.train_id AS i, list(
          w * w * exp(-0.5 * (pow((a.x1 - b.x1) / l1, 2) + pow((a.x2 - b.x2) / l2, 2)))
          + CASE WHEN a.train_id = b.train_id THEN s ELSE 0 END ORDER BY b.train_id) AS kr,
          list(CASE WHEN a.train_id = b.train_id THEN 1.0::DOUBLE ELSE 0 END ORDER BY b.train_id) AS er
        FROM cand, tx a, tx b GROUP BY ALL),
cy AS (SELECT qoi, train_id AS i, list(value ORDER BY pos) AS yr FROM ty GROUP BY ALL),
caug AS (SELECT qoi, cand_id, list(list_concat(list_concat(kr, er), yr) ORDER BY i) AS m, count(*) AS n
         FROM ckm JOIN cy USING (qoi, i) GROUP BY qoi, cand_id),
cgj(qoi, cand_id, n, k, m) AS (
  SELECT qoi, cand_id, n, 0, m FROM caug
  UNION ALL
  SELECT qoi, cand_id, n, k + 1,
    list_transform(m, lambda row, i: CASE WHEN i = k + 1
      THEN list_transform(row, lambda v: v / row[k + 1])
      ELSE list_transform(row, lambda v, c: v - row[k + 1] * m[k + 1][c] / m[k + 1][k + 1]) END)
  FROM cgj WHERE k < n),
parts AS (
  SELECT qoi, cand_id, n, m[i][n + i] AS d,
         list_sum(list_transform(m[i][2 * n + 1:], lambda v: v * v)) AS s2, len(m[i]) - 2 * n AS ny
  FROM cgj, range(1, (SELECT max(n) + 1 FROM caug)) u(i) WHERE k = n AND i <= n),
loo AS (
  SELECT qoi, cand_id, -(sum(s2 / d) / (2 * any_value(n)) - any_value(ny) / (2.0 * any_value(n)) * sum(ln(d))
         + any_value(ny) / 2.0 * ln(2 * pi())) AS loo
  FROM parts GROUP BY qoi, cand_id)"""


@query("g7_leave_one_out", f"""
WITH RECURSIVE {TRAINING}, {LOO}
SELECT qoi, cand_id, {r('loo', 5)} AS loo FROM loo""")
def g7_leave_one_out(spark, sf_dir):
    sets = surrogate.training_sets(*training(spark, sf_dir))
    return rounded(surrogate.score_candidates(candidates(spark, sf_dir), sets).select(
        "qoi", "cand_id", "loo"), 5)


@query("g8_hyperparameter_search")
def g8_hyperparameter_search(spark, sf_dir):
    train_x, train_y = training(spark, sf_dir)
    sets = surrogate.training_sets(
        train_x, surrogate.centre(train_y, curves.mean_outputs(train_y)))
    found = surrogate.search_hyperparameters(sets, 2, n_candidates=64, rounds=3)
    return rounded(found.where("best").select("qoi", "cand_id", "loo", "score"))


@query("g9_committee_draw", f"""
WITH RECURSIVE {TRAINING}, {LOO},
w AS (SELECT qoi, cand_id, exp(loo / 5 - max(loo / 5) OVER (PARTITION BY qoi)) AS w FROM loo),
c AS (SELECT *, sum(w) OVER (PARTITION BY qoi ORDER BY cand_id) AS hi, sum(w) OVER (PARTITION BY qoi) AS t FROM w)
SELECT qoi, i::INTEGER AS member, cand_id FROM c, range(8) u(i)
WHERE (i + 0.5) / 8 * t > hi - w AND (i + 0.5) / 8 * t <= hi""")
def g9_committee_draw(spark, sf_dir):
    sets = surrogate.training_sets(*training(spark, sf_dir))
    scored = surrogate.score_candidates(candidates(spark, sf_dir), sets).withColumn(
        "score", F.col("loo") / 5)
    weights = posterior.importance_weights(scored, "score", keys=["qoi"])
    drawn = posterior.systematic_resample(weights, ["cand_id"], 8, keys=["qoi"])
    return drawn.select("qoi", F.col("draw").cast("int").alias("member"), "cand_id")


def theta(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        *ID, (F.col("l_discount") * 20 - 1).alias("x1"), (F.col("l_tax") * 30 - 1).alias("x2"),
        (F.col("l_quantity") / 50 - 1).alias("log_sigma_O"))


LOG_PRIOR = """(-0.5 * pow(x1 / 0.5, 2) - ln(0.5) - 0.5 * ln(2 * pi())
  + CASE WHEN x2 BETWEEN -1 AND 1 THEN -ln(2) ELSE '-inf'::DOUBLE END
  - 0.5 * pow((ls + 2) / 2, 2) - ln(2) - 0.5 * ln(2 * pi()))"""


@query("a11_log_prior", f"""
WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount * 20 - 1 AS x1,
                  l_tax * 30 - 1 AS x2, l_quantity / 50 - 1 AS ls FROM lineitem),
p AS (SELECT *, {LOG_PRIOR} AS lp FROM t)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CASE WHEN isinf(lp) THEN lp ELSE {r('lp')} END AS log_prior FROM p""")
def a11_log_prior(spark, sf_dir):
    wide = table(spark, sf_dir, "lineitem").select(
        *LINE_KEY, (F.col("l_discount") * 20 - 1).alias("x1"), (F.col("l_tax") * 30 - 1).alias("x2"),
        (F.col("l_quantity") / 50 - 1).alias("log_sigma_O"))
    pairs = F.array(*[F.struct(F.lit(p).alias("param"), F.col(p).alias("value"))
                      for p in ("x1", "x2", "log_sigma_O")])
    priors = spark.createDataFrame(PRIORS, "param string, kind string, a double, b double")
    lp = posterior.log_prior(wide.select(*LINE_KEY, F.inline(pairs)), priors, LINE_KEY)
    return _rounded_inf(lp.drop("l_shipdate"), ["log_prior"])


def _rounded_inf(df, cols):
    return df.withColumns({c: F.when(F.abs(c) == float("inf"), F.col(c)).otherwise(
        F.round(c, 6) + F.lit(0.0)) for c in cols})


def _ll(q: str, sigma: str) -> str:
    return f"(-0.5 * {N_EFF[q]}::DOUBLE * max(CASE WHEN qoi = '{q}' THEN mse END) / pow({sigma}, 2) - {N_EFF[q]}::DOUBLE * ln({sigma}))"


@query("g10_posterior_scores", f"""
WITH RECURSIVE {TRAINING}, {_gp_sql()},
qs AS (SELECT DISTINCT l_discount * 20 - 1 AS x1, l_tax * 30 - 1 AS x2, l_discount, l_tax FROM lineitem),
{_predict_sql('qs', 'l_discount, l_tax')},
target AS (SELECT qoi, pos, avg(value) AS y FROM ty GROUP BY ALL),
mse AS (SELECT l_discount, l_tax, qoi, avg(pow(value - y, 2)) AS mse FROM pred JOIN target USING (qoi, pos) GROUP BY ALL),
t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_discount, l_tax, l_discount * 20 - 1 AS x1,
             l_tax * 30 - 1 AS x2, l_quantity / 50 - 1 AS ls,
             row_number() OVER () AS rn FROM lineitem),
s AS (SELECT rn, l_orderkey, l_linenumber, l_partkey, {LOG_PRIOR} AS lp, {_ll('F', '0.3::DOUBLE')} AS lf,
             {_ll('O', 'exp(ls)')} AS lo, {_ll('P', '0.5::DOUBLE')} AS lq
      FROM t JOIN mse USING (l_discount, l_tax) GROUP BY rn, l_orderkey, l_linenumber, l_partkey, x1, x2, ls)
SELECT l_orderkey, l_linenumber, l_partkey, {r('lf', 4)} AS "ll_F", {r('lo', 4)} AS "ll_O", {r('lq', 4)} AS "ll_P",
       CASE WHEN isinf(lp) THEN lp ELSE {r('lp + lf + lo + lq', 4)} END AS log_posterior FROM s""")
def g10_posterior_scores(spark, sf_dir):
    _, train_y = training(spark, sf_dir)
    target = {}
    for row in train_y.groupBy("qoi", "pos").agg(F.avg("value").alias("y")).orderBy("qoi", "pos").collect():
        target.setdefault(row["qoi"], []).append(row["y"])
    models = surrogate.collect_models(fitted(spark, sf_dir))
    scores = posterior.score_posterior(theta(spark, sf_dir), ["x1", "x2"], models, target, N_EFF,
                                       PRIORS, SIGMA)
    out = rounded(scores, 4, ["ll_F", "ll_O", "ll_P"]).withColumn(
        "log_posterior", F.when(F.abs("log_posterior") == float("inf"), F.col("log_posterior"))
        .otherwise(F.round("log_posterior", 4) + F.lit(0.0)))
    return out.select(*ID, "ll_F", "ll_O", "ll_P", "log_posterior")


def scored_events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", "event_type", "value", (-F.pow(F.col("value") - 20, 2) / 200).alias("log_posterior"))


WEIGHTS = """
w AS (SELECT event_id, event_type, value, exp(-pow(value - 20, 2) / 200) AS e FROM events),
weights AS (SELECT event_id, event_type, value, e / sum(e) OVER (PARTITION BY event_type) AS weight FROM w)"""


@query("g11_importance_weights", f"""
WITH {WEIGHTS} SELECT event_id, event_type, {r('weight', 10)} AS weight FROM weights""")
def g11_importance_weights(spark, sf_dir):
    w = posterior.importance_weights(scored_events(spark, sf_dir), keys=["event_type"])
    return rounded(w.select("event_id", "event_type", "weight"), 10)


@query("g11_weight_ess", f"""
WITH {WEIGHTS}
SELECT event_type, count(*) AS n, {r('pow(sum(weight), 2) / sum(weight * weight)', 4)} AS ess
FROM weights GROUP BY event_type""")
def g11_weight_ess(spark, sf_dir):
    w = posterior.importance_weights(scored_events(spark, sf_dir), keys=["event_type"])
    return rounded(posterior.weight_ess(w, ["event_type"]), 4)


@query("g12_systematic_resample", f"""
WITH {WEIGHTS},
c AS (SELECT event_type, event_id, weight, sum(weight) OVER (PARTITION BY event_type ORDER BY event_id) AS hi
      FROM weights)
SELECT event_type, i AS draw, event_id FROM c, range(500) t(i)
WHERE (i + 0.5::DOUBLE) / 500 > hi - weight AND (i + 0.5::DOUBLE) / 500 <= hi""")
def g12_systematic_resample(spark, sf_dir):
    w = posterior.importance_weights(scored_events(spark, sf_dir), keys=["event_type"])
    return posterior.systematic_resample(w, ["event_id"], 500, keys=["event_type"]).select(
        "event_type", "draw", "event_id")


@query("g13_posterior_predictive", f"""
WITH RECURSIVE {TRAINING}, {_gp_sql()},
qs AS (SELECT 'mean' AS id, avg(l_discount * 20 - 1) AS x1, avg(l_tax * 30 - 1) AS x2 FROM lineitem),
{_predict_sql('qs', 'id')}
SELECT id, qoi, pos, {r('value')} AS value FROM pred""")
def g13_posterior_predictive(spark, sf_dir):
    centre = theta(spark, sf_dir).agg(F.array(F.avg("x1"), F.avg("x2")).alias("params")).select(
        F.lit("mean").alias("id"), "params")
    models = surrogate.collect_models(fitted(spark, sf_dir))
    return rounded(surrogate.predict(centre, "id", models))


@query("g14_export_rows", """
WITH s AS (SELECT o_totalprice, o_custkey, row_number() OVER (
             ORDER BY md5(concat_ws('|', '2', o_orderkey)), o_orderkey) - 1 AS pos FROM orders)
SELECT pos::INTEGER AS pos, o_totalprice, o_custkey FROM s WHERE pos < 40""")
def g14_export_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    wide = posterior.export_rows(orders, ["o_orderkey"], ["o_totalprice", "o_custkey"], 40, 2)
    return wide.select(F.posexplode(F.arrays_zip("o_totalprice", "o_custkey")).alias("pos", "c")).select(
        "pos", "c.o_totalprice", "c.o_custkey")


@query("x3_callable_mean", f"""
WITH RECURSIVE {TRAINING.replace('mean AS (SELECT qoi, avg(value) AS mean FROM ty GROUP BY qoi)', '')}
left_over AS (SELECT train_id, qoi, pos, value - 0.1 * x1 AS value FROM ty JOIN tx USING (train_id)),
mean AS (SELECT DISTINCT qoi, 0.0::DOUBLE AS mean FROM ty),
{_gp_sql('tx', 'left_over')}, {CUSTOMERS}, {_predict_sql('qs', 'c_custkey')}
SELECT c_custkey, qoi, pos, {r('value + 0.1 * x1')} AS value FROM pred JOIN qs USING (c_custkey)""")
def x3_callable_mean(spark, sf_dir):
    train_x, train_y = training(spark, sf_dir)
    means = {q: lambda x: 0.1 * x[:, :1] for q in QOIS}
    solved = surrogate.solve_weights(
        surrogate.training_sets(train_x, train_y), hyper(spark), means=means)
    models = surrogate.collect_models(solved, means)
    return rounded(surrogate.predict(customer_queries(spark, sf_dir), "c_custkey", models))


@query("x6_custom_likelihood", f"""
WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_discount * 20 - 1 AS x1, l_tax * 30 - 1 AS x2,
                  l_quantity / 50 - 1 AS ls FROM lineitem),
p AS (SELECT *, {LOG_PRIOR} AS lp FROM t)
SELECT l_orderkey, l_linenumber, l_partkey,
       CASE WHEN isinf(lp) THEN lp ELSE {r('lp - x1 * x1')} END AS log_posterior FROM p""")
def x6_custom_likelihood(spark, sf_dir):
    scores = posterior.score_posterior(
        theta(spark, sf_dir), ["x1", "x2"], {}, {}, {}, PRIORS,
        likelihood=lambda df: -F.col("x1") * F.col("x1"))
    return _rounded_inf(scores.select(*ID, "log_posterior"), ["log_posterior"])
