"""Alignment of sampled and reference curves, and checks of training inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from calib.operators import align, curves, posterior, surrogate
from calib.plans.base import DAYS, query, r, rounded, table

SAMPLE_KEYS = ["sample_id", "qoi", "system_index", "label"]


def raw_blocks(spark, sf_dir):
    """Daily sums per sample, QoI (event type), system and half of the day; empty days absent."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(
        F.pmod("user_id", F.lit(10)).cast("long").alias("sample_id"),
        F.col("event_type").alias("qoi"),
        F.pmod("event_id", F.lit(2)).cast("int").alias("system_index"),
        F.when(F.hour("ts") < 12, "AM").otherwise("PM").alias("label"),
        F.datediff("ts", F.lit("2024-01-01").cast("date")).cast("int").alias("bin"),
    ).agg(F.sum("value").alias("value"))


def blocks(spark, sf_dir):
    return curves.fill_bins(raw_blocks(spark, sf_dir), SAMPLE_KEYS, DAYS, "value")


def reference(spark, sf_dir):
    return blocks(spark, sf_dir).where("qoi <> 'error'").groupBy(
        "qoi", "system_index", "label", "bin").agg((F.sum("value") / 10.0).alias("value"))


BLOCKS = """
raw AS (
  SELECT user_id % 10 AS sample_id, event_type AS qoi, (event_id % 2)::INTEGER AS system_index,
         CASE WHEN hour(ts) < 12 THEN 'AM' ELSE 'PM' END AS label,
         date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))::INTEGER AS bin, sum(value) AS value
  FROM events GROUP BY ALL),
blocks AS (
  SELECT sample_id, qoi, system_index, label, bin, coalesce(value, 0.0::DOUBLE) AS value
  FROM (SELECT DISTINCT sample_id, qoi, system_index, label, i::INTEGER AS bin FROM raw, range(30) t(i))
  LEFT JOIN raw USING (sample_id, qoi, system_index, label, bin)),
ref AS (SELECT qoi, system_index, label, bin, sum(value) / 10.0 AS value FROM blocks
        WHERE qoi <> 'error' GROUP BY ALL)"""


@query("j9_align_curves", f"""
WITH {BLOCKS}
SELECT b.sample_id, qoi, system_index, label, bin, {r('b.value')} AS value, {r('ref.value')} AS reference
FROM blocks b JOIN ref USING (qoi, system_index, label, bin)""")
def j9_align_curves(spark, sf_dir):
    rows = align.align(blocks(spark, sf_dir), reference(spark, sf_dir))
    return rounded(rows.select("sample_id", *align.CELL, "value", "reference"))


@query("q2_schema_mismatches", f"""
WITH {BLOCKS},
m AS (SELECT raw.sample_id, qoi, count(*) AS matched FROM raw JOIN ref USING (qoi, system_index, label, bin)
      GROUP BY ALL)
SELECT sample_id, qoi, expected, matched, 0::BIGINT AS extra
FROM m JOIN (SELECT qoi, count(*) AS expected FROM ref GROUP BY qoi) USING (qoi)
WHERE matched <> expected""")
def q2_schema_mismatches(spark, sf_dir):
    return align.schema_mismatches(raw_blocks(spark, sf_dir), reference(spark, sf_dir))


@query("q2_label_orders", f"""
WITH {BLOCKS}, n AS (SELECT sample_id, qoi, label, count(*) AS n FROM raw GROUP BY ALL)
SELECT sample_id, qoi, string_agg(label || ':' || n, ',' ORDER BY label || ':' || n) AS layout
FROM n GROUP BY ALL""")
def q2_label_orders(spark, sf_dir):
    return align.label_orders(raw_blocks(spark, sf_dir), ["sample_id", "qoi"])


@query("p10_label_qualification", f"""
WITH {BLOCKS},
b AS (SELECT * FROM blocks WHERE NOT (qoi = 'click' AND system_index = 1)),
n AS (SELECT qoi, count(DISTINCT system_index) AS n FROM b GROUP BY qoi)
SELECT DISTINCT qoi, system_index,
       CASE WHEN n > 1 THEN printf('window-%03d:', system_index) || label ELSE label END AS label
FROM b JOIN n USING (qoi)""")
def p10_label_qualification(spark, sf_dir):
    rows = blocks(spark, sf_dir).where("NOT (qoi = 'click' AND system_index = 1)")
    return align.qualify_labels(rows).select("qoi", "system_index", "label").distinct()


@query("p13_stacked_position", f"""
WITH {BLOCKS}
SELECT sample_id, qoi, system_index, label, bin,
       ((system_index * 2 + CASE label WHEN 'AM' THEN 0 ELSE 1 END) * 30 + bin)::BIGINT AS pos
FROM blocks WHERE qoi <> 'error'""")
def p13_stacked_position(spark, sf_dir):
    rows = align.with_position(blocks(spark, sf_dir).where("qoi <> 'error'"),
                               reference(spark, sf_dir))
    return rows.select(*SAMPLE_KEYS, "bin", "pos")


@query("p13_stacked_vectors", f"""
WITH {BLOCKS},
p AS (SELECT *, row_number() OVER (PARTITION BY sample_id, qoi ORDER BY system_index, label, bin) AS place
      FROM blocks WHERE qoi <> 'error')
SELECT sample_id, qoi, count(*)::INTEGER AS n, {r('sum(value * place)', 4)} AS weighted FROM p GROUP BY ALL""")
def p13_stacked_vectors(spark, sf_dir):
    rows = align.with_position(blocks(spark, sf_dir).where("qoi <> 'error'"),
                               reference(spark, sf_dir))
    vectors = align.stack_vectors(rows, ["sample_id"])
    weighted = F.aggregate(F.transform("values", lambda v, i: v * (i + 1)), F.lit(0.0),
                           lambda acc, v: acc + v)
    return rounded(vectors.select("sample_id", "qoi", F.size("values").alias("n"),
                                  weighted.alias("weighted")), 4)


def sample_params(spark, sf_dir):
    """One parameter row per sample from its users; samples 8 and 9 have none."""
    e = table(spark, sf_dir, "events").where(F.pmod("user_id", F.lit(10)) < 8)
    return e.groupBy(F.pmod("user_id", F.lit(10)).cast("long").alias("sample_id")).agg(
        F.array(F.avg("value") / 100, F.max("value") / 100).alias("params"))


@query("j10_training_table", f"""
WITH {BLOCKS},
p AS (SELECT user_id % 10 AS sample_id, avg(value) / 100 AS p0, max(value) / 100 AS p1 FROM events
      WHERE user_id % 10 < 8 GROUP BY ALL)
SELECT sample_id, qoi, system_index, label, bin, {r('value')} AS value, {r('p0')} AS p0, {r('p1')} AS p1
FROM blocks JOIN p USING (sample_id)""")
def j10_training_table(spark, sf_dir):
    rows = align.training_table(sample_params(spark, sf_dir), blocks(spark, sf_dir))
    return rounded(rows.withColumns({"p0": F.col("params")[0], "p1": F.col("params")[1]}).drop(
        "params"))


@query("q1_shape_violations", f"""
WITH {BLOCKS},
s AS (SELECT qoi, sample_id, count(*) AS size, count(DISTINCT label) AS labels FROM raw GROUP BY ALL),
w AS (SELECT qoi, count(*) AS width FROM ref GROUP BY qoi)
SELECT qoi, sample_id, CASE WHEN width IS NULL THEN 'no reference'
    WHEN size <> width THEN 'width differs from the reference'
    WHEN size % labels <> 0 THEN 'size is not labels times values' END AS issue
FROM s LEFT JOIN w USING (qoi) WHERE issue IS NOT NULL
UNION ALL SELECT qoi, sample_id, 'no parameters' FROM s WHERE sample_id >= 8""")
def q1_shape_violations(spark, sf_dir):
    return align.shape_violations(raw_blocks(spark, sf_dir), sample_params(spark, sf_dir),
                                  reference(spark, sf_dir))


@query("q3_learning_violations", f"""
WITH {BLOCKS}
SELECT qoi, 'size is not a multiple of the curves' AS issue FROM raw GROUP BY qoi
HAVING count(*) % 7 <> 0""")
def q3_learning_violations(spark, sf_dir):
    models = raw_blocks(spark, sf_dir).groupBy("qoi").agg(
        F.count(F.lit(1)).alias("size")).withColumns(
        {"n_inputs": F.lit(2), "n_curves": F.lit(7)})
    return align.learning_violations(models, 2)


@query("q9_shared_settings", """
WITH s AS (SELECT DISTINCT event_type AS qoi, (user_id % 3)::INTEGER AS system_index,
  CASE WHEN event_type < 'e' THEN '{"n_bins":30}' ELSE '{"n_bins":' || (30 + user_id % 3) || '}' END AS settings
  FROM events)
SELECT qoi, count(DISTINCT settings) = 1 AS shared,
       CASE WHEN count(DISTINCT settings) = 1 THEN min(settings) END AS settings,
       CASE WHEN count(DISTINCT settings) > 1 THEN '{' || string_agg('"' || printf('%03d', system_index) || '":"'
         || replace(settings, '"', '\\"') || '"', ',' ORDER BY system_index) || '}' END AS settings_by_block
FROM s GROUP BY qoi""")
def q9_shared_settings(spark, sf_dir):
    k = F.pmod("user_id", F.lit(3)).cast("int")
    text = F.when(F.col("event_type") < "e", F.lit('{"n_bins":30}')).otherwise(
        F.concat(F.lit('{"n_bins":'), (k + 30).cast("string"), F.lit("}")))
    rows = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("qoi"), k.alias("system_index"), text.alias("settings")).distinct()
    return align.shared_settings(rows)


def wanted_models(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("qoi")).agg(
        F.count(F.lit(1)).alias("size"))


@query("j11_models_to_fit", """
SELECT p_brand AS qoi, count(*) AS size FROM part GROUP BY p_brand
HAVING p_brand NOT IN (SELECT p_brand FROM part WHERE p_size > 45)
    OR right(p_brand, 1) <> '1'""")
def j11_models_to_fit(spark, sf_dir):
    wanted = wanted_models(spark, sf_dir)
    big = table(spark, sf_dir, "part").where("p_size > 45").select(F.col("p_brand").alias("qoi"))
    stored = wanted.where("right(qoi, 1) = '1'").join(big, "qoi", "left_semi")
    return align.models_to_fit(wanted, stored)


@query("j11_reused_models", """
SELECT p_brand AS qoi, count(*) AS size FROM part GROUP BY p_brand HAVING right(p_brand, 1) = '1'""")
def j11_reused_models(spark, sf_dir):
    wanted = wanted_models(spark, sf_dir)
    return align.reused_models(wanted, wanted.where("right(qoi, 1) = '1'"))


@query("a9_smape", f"""
WITH {BLOCKS},
p AS (SELECT qoi, b.sample_id, sum(abs(b.value - ref.value)) / (sum(abs(b.value)) + sum(abs(ref.value))) AS e
      FROM blocks b JOIN ref USING (qoi, system_index, label, bin) GROUP BY ALL)
SELECT qoi, {r('avg(e) * 100')} AS smape FROM p GROUP BY qoi""")
def a9_smape(spark, sf_dir):
    rows = align.align(blocks(spark, sf_dir), reference(spark, sf_dir))
    return rounded(surrogate.smape(rows, ["sample_id"], "reference", "value", ["qoi"]))


@query("a10_log_likelihood", f"""
WITH {BLOCKS},
m AS (SELECT b.sample_id AS theta_id, qoi, CASE WHEN count(*) = any_value(w.n) THEN avg(pow(b.value - ref.value, 2)) END AS mse
      FROM blocks b JOIN ref USING (qoi, system_index, label, bin) JOIN (SELECT qoi, count(*) AS n FROM ref GROUP BY qoi) w USING (qoi) GROUP BY ALL)
SELECT theta_id, qoi, {r('-0.5 * 12 * mse / pow(20 + theta_id, 2) - 12 * ln(20 + theta_id)')} AS log_likelihood
FROM m""")
def a10_log_likelihood(spark, sf_dir):
    return rounded(_scores(spark, sf_dir))


def _scores(spark, sf_dir):
    ref = reference(spark, sf_dir)
    pred = align.with_position(blocks(spark, sf_dir).where("qoi <> 'error'"), ref).select(
        F.col("sample_id").alias("theta_id"), "qoi", "pos", "value")
    ref_pos = align.with_position(ref, ref).select("qoi", "pos", "value")
    n_eff = ref.select("qoi").distinct().withColumn("n_eff", F.lit(12.0))
    sigma = pred.select("theta_id", "qoi").distinct().withColumn(
        "sigma", (F.col("theta_id") + 20).cast("double"))
    return posterior.log_likelihood(pred, ref_pos, n_eff, sigma)


@query("a10_total_log_likelihood", f"""
WITH {BLOCKS},
m AS (SELECT b.sample_id AS theta_id, qoi, CASE WHEN count(*) = any_value(w.n) THEN avg(pow(b.value - ref.value, 2)) END AS mse
      FROM blocks b JOIN ref USING (qoi, system_index, label, bin) JOIN (SELECT qoi, count(*) AS n FROM ref GROUP BY qoi) w USING (qoi) GROUP BY ALL)
SELECT theta_id, CASE WHEN count(mse) = count(*) THEN {r('sum(-0.5 * 12 * mse / pow(20 + theta_id, 2) - 12 * ln(20 + theta_id))')} END AS log_likelihood
FROM m GROUP BY theta_id""")
def a10_total_log_likelihood(spark, sf_dir):
    return rounded(posterior.total_log_likelihood(_scores(spark, sf_dir)))
