"""Pair joins, profiles, rates and curve features on the atom and curve views."""

from __future__ import annotations

from pyspark.sql import functions as F

from calib.functions import expr
from calib.functions.expr import gaussian_weights, savgol_matrix
from calib.operators import curves, lattice, ordering, pairs
from calib.plans.base import (
    ATOMS, BOX, DAYS, EVENT_CURVES, LINE_DRAWS_WIDE, LINE_PARAMS, REFERENCE_CURVES, WRAPPED_ATOMS,
    atoms, event_curves, line_draws_wide, query, r, reference_curves, rounded, table,
)

PLACE = ["frame", "atom_id", "x", "y", "z", "bx", "by", "bz"]


def _delta(axis: str, a: str = "a", b: str = "b") -> str:
    d = f"({a}.{axis} - {b}.{axis})"
    return f"({d} - round_even({d} / 12.0::DOUBLE, 0) * 12.0::DOUBLE)"


DISTANCE = "sqrt(" + " + ".join(f"{_delta(x)} * {_delta(x)}" for x in "xyz") + ")"


def _pairs_cte(a: str, b: str, cond: str) -> str:
    return f"""
pairs AS (
  SELECT * FROM (
    SELECT a.frame, a.atom_id AS atom_a, b.atom_id AS atom_b, a.type AS label,
           {DISTANCE} AS distance
    FROM (SELECT * FROM atoms WHERE {a}) a JOIN (SELECT * FROM atoms WHERE {b}) b
    ON a.frame = b.frame)
  WHERE {cond})"""


@query("j1_pair_distances", f"""
WITH {ATOMS}, {_pairs_cte("resname = 'MOL'", "resname = 'SOL'", "true")}
SELECT frame, atom_a, atom_b, {r('distance')} AS distance FROM pairs""")
def j1_pair_distances(spark, sf_dir):
    a = atoms(spark, sf_dir).select(*PLACE, "resname")
    # Half the box diagonal: no minimum-image distance is longer.
    reach = BOX * 0.8661
    d = pairs.pair_join(a.where("resname = 'MOL'"), a.where("resname = 'SOL'"), ["frame"], reach)
    return rounded(d.select("frame", "atom_a", "atom_b", "distance"))


@query("j2_capped_pairs", f"""
WITH {ATOMS}, {_pairs_cte("element = 'O'", "element = 'O'", "distance > 1 AND distance <= 2.5")}
SELECT frame, atom_a, atom_b, {r('distance')} AS distance FROM pairs""")
def j2_capped_pairs(spark, sf_dir):
    a = pairs.select_atoms(atoms(spark, sf_dir), "element = 'O'")
    d = pairs.pair_join(a, a, ["frame"], 2.5, 1.0)
    return rounded(d.select("frame", "atom_a", "atom_b", "distance"))


# Boxes with angles from 60 to 120 degrees, another one for each frame.
ANGLES = {"alpha": "65 + frame % 5 * 5", "beta": "75 + frame % 4 * 10", "gamma": "60 + frame % 7 * 10"}
SKEWED = f"""
angles AS (SELECT DISTINCT frame, {', '.join(f'cos(radians(({e})::DOUBLE)) AS c{n[0]}' for n, e in ANGLES.items())},
                  sin(radians(({ANGLES['gamma']})::DOUBLE)) AS sg FROM atoms),
cells AS (SELECT frame, 12.0::DOUBLE * cg AS ux, 12.0::DOUBLE * sg AS uy, 12.0::DOUBLE * cb AS cx,
                 12.0::DOUBLE * (ca - cb * cg) / sg AS cy,
                 12.0::DOUBLE * sqrt(1 - cb * cb - pow((ca - cb * cg) / sg, 2)) AS cz FROM angles),
turns AS (SELECT frame, i * 12.0::DOUBLE + j * ux + k * cx AS tx, j * uy + k * cy AS ty, k * cz AS tz
          FROM cells, range(-3, 4) a(i), range(-3, 4) b(j), range(-3, 4) c(k))"""


def _skewed_sql(a: str, b: str, cond: str) -> str:
    """(frame, a, b, x, y, z): shortest of the images in a wide block of cells."""
    return f"""
  SELECT frame, atom_a, atom_b, arg_min(v, d2) AS v, sqrt(min(d2)) AS distance FROM (
    SELECT a.frame, a.atom_id AS atom_a, b.atom_id AS atom_b,
           [a.x - b.x + tx, a.y - b.y + ty, a.z - b.z + tz] AS v,
           pow(a.x - b.x + tx, 2) + pow(a.y - b.y + ty, 2) + pow(a.z - b.z + tz, 2) AS d2
    FROM (SELECT * FROM atoms WHERE {a}) a JOIN (SELECT * FROM atoms WHERE {b}) b ON a.frame = b.frame AND {cond}
    JOIN turns ON turns.frame = a.frame)
  GROUP BY ALL"""


def skewed_atoms(spark, sf_dir):
    rows = atoms(spark, sf_dir).withColumns({n: F.expr(f"CAST({e} AS DOUBLE)") for n, e in ANGLES.items()})
    return lattice.with_lattice(rows, ["frame"])


@query("j2_skewed_pairs", f"""
WITH {ATOMS}, {SKEWED}, near AS ({_skewed_sql("element = 'O'", "element = 'O'", 'true')})
SELECT frame, atom_a, atom_b, {r('distance')} AS distance FROM near WHERE distance > 1 AND distance <= 4.5""")
def j2_skewed_pairs(spark, sf_dir):
    a = pairs.select_atoms(skewed_atoms(spark, sf_dir), "element = 'O'")
    return rounded(pairs.pair_join(a, a, ["frame"], 4.5, 1.0).select("frame", "atom_a", "atom_b", "distance"))


@query("j15_clash_pairs", f"""
WITH {ATOMS}, {_pairs_cte("true", "true", "atom_a < atom_b AND distance < 0.8")}
SELECT frame, atom_a, atom_b, {r('distance')} AS distance FROM pairs""")
def j15_clash_pairs(spark, sf_dir):
    return rounded(pairs.clash_pairs(atoms(spark, sf_dir), ["frame"], 0.8))


BONDS = "bonds AS (SELECT vec_id AS a, vec_id - 1 AS b FROM embeddings WHERE vec_id % 3 = 1)"


def bonds(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("vec_id % 3 = 1").select(
        F.col("vec_id").alias("a"), (F.col("vec_id") - 1).alias("b"))


@query("j3_donor_hydrogens", f"""
WITH {ATOMS}, {BONDS}
SELECT a AS hydrogen, b AS donor FROM bonds
JOIN atoms h ON h.atom_id = a JOIN atoms d ON d.atom_id = b
WHERE h.element = 'H' AND d.element IN ('O', 'N', 'S')""")
def j3_donor_hydrogens(spark, sf_dir):
    return pairs.donor_hydrogens(atoms(spark, sf_dir), bonds(spark, sf_dir)).select(
        "hydrogen", "donor")


def _dot(p: str, q: str) -> str:
    return "(" + " + ".join(f"{p}{x} * {q}{x}" for x in "xyz") + ")"


TRIPLES = f"""
geo AS (
  SELECT d.frame, d.atom_id AS donor, h.atom_id AS hydrogen, a.atom_id AS acceptor,
         {DISTANCE.replace('(a.', '(d.').replace('- b.', '- a.')} AS distance,
         {', '.join(f"{_delta(x, 'd', 'h')} AS u{x}, {_delta(x, 'a', 'h')} AS v{x}" for x in 'xyz')},
         d.resname AS dres, d.type AS dtyp, a.resname AS ares, a.type AS atyp,
         h.resname AS hres
  FROM atoms d JOIN bonds ON bonds.b = d.atom_id JOIN atoms h ON h.atom_id = bonds.a
  JOIN atoms a ON a.frame = d.frame AND a.element = 'O'),
triples AS (
  SELECT *, degrees(acos(greatest(-1, least(1,
      {_dot('u', 'v')} / nullif(sqrt({_dot('u', 'u')}) * sqrt({_dot('v', 'v')}), 0))))) AS angle
  FROM geo WHERE distance > 1 AND distance <= 3.5)"""


@query("j4_bonded_triples", f"""
WITH {ATOMS}, {BONDS}, {TRIPLES}
SELECT frame, donor, hydrogen, acceptor, {r('distance')} AS distance, {r('angle', 4)} AS angle
FROM triples WHERE angle > 150""")
def j4_bonded_triples(spark, sf_dir):
    a = atoms(spark, sf_dir)
    links = pairs.donor_hydrogens(a, bonds(spark, sf_dir))
    found = pairs.bonded_triples(
        a.select(*PLACE), a.where("element = 'H'"), a.where("element = 'O'").select(*PLACE),
        links, ["frame"])
    return rounded(rounded(found, 6, ["distance"]), 4, ["angle"])


SKEWED_TRIPLES = f"""
da AS ({_skewed_sql('true', "element = 'O'", 'true')}),
dh AS ({_skewed_sql('true', "element = 'H'", 'true')}),
ah AS ({_skewed_sql("element = 'O'", "element = 'H'", 'true')}),
triples AS (
  SELECT da.frame, da.atom_a AS donor, dh.atom_b AS hydrogen, da.atom_b AS acceptor, da.distance,
         degrees(acos(greatest(-1, least(1, list_dot_product(dh.v, ah.v) / nullif(dh.distance * ah.distance, 0))))) AS angle
  FROM da JOIN bonds ON bonds.b = da.atom_a
  JOIN dh ON dh.frame = da.frame AND dh.atom_a = da.atom_a AND dh.atom_b = bonds.a
  JOIN ah ON ah.frame = da.frame AND ah.atom_a = da.atom_b AND ah.atom_b = bonds.a
  WHERE da.distance > 1 AND da.distance <= 3.5)"""


@query("j4_skewed_triples", f"""
WITH {WRAPPED_ATOMS}, {BONDS}, {SKEWED}, {SKEWED_TRIPLES}
SELECT frame, donor, hydrogen, acceptor, {r('distance')} AS distance, {r('angle', 4)} AS angle
FROM triples WHERE angle > 150""")
def j4_skewed_triples(spark, sf_dir):
    a = skewed_atoms(spark, sf_dir)
    found = pairs.bonded_triples(a, a.where("element = 'H'"), a.where("element = 'O'"),
                                 pairs.donor_hydrogens(a, bonds(spark, sf_dir)), ["frame"])
    return rounded(rounded(found, 6, ["distance"]), 4, ["angle"])


@query("a4_skewed_rates", f"""
WITH {ATOMS}, {BONDS}, {SKEWED}, {SKEWED_TRIPLES},
named AS (SELECT DISTINCT atom_id, resname, resname || '(' || type || ')' AS site, element FROM atoms),
hits AS (
  SELECT d.site || ' to ' || a.site AS label, count(*) AS c FROM triples
  JOIN named d ON d.atom_id = donor JOIN named a ON a.atom_id = acceptor JOIN named h ON h.atom_id = hydrogen
  WHERE angle > 150 AND h.resname <> a.resname GROUP BY ALL),
labels AS (
  SELECT DISTINCT d.site || ' to ' || a.site AS label
  FROM (SELECT DISTINCT d.site, h.resname AS side FROM named d JOIN bonds ON b = d.atom_id JOIN named h ON h.atom_id = bonds.a) d,
       (SELECT DISTINCT resname, site FROM named WHERE element = 'O') a WHERE a.resname <> d.side)
SELECT label, {r('coalesce(c, 0) / (SELECT count(DISTINCT frame) FROM atoms)')} AS value
FROM labels LEFT JOIN hits USING (label)""")
def a4_skewed_rates(spark, sf_dir):
    return rounded(curves.event_rates(
        skewed_atoms(spark, sf_dir), bonds(spark, sf_dir), ["frame"], "resname = 'MOL'", "resname = 'SOL'"))


@query("a4_event_rates", f"""
WITH {ATOMS}, {BONDS}, {TRIPLES},
hits AS (
  SELECT dres || '(' || dtyp || ') to ' || ares || '(' || atyp || ')' AS label, count(*) AS c
  FROM triples WHERE angle > 150 AND hres <> ares GROUP BY ALL),
labels AS (
  SELECT DISTINCT d.resname || '(' || d.type || ') to ' || a.resname || '(' || a.type || ')'
    AS label
  FROM (SELECT DISTINCT d.resname, d.type, h.resname AS side FROM atoms d
        JOIN bonds ON b = d.atom_id JOIN atoms h ON h.atom_id = bonds.a) d,
       (SELECT DISTINCT resname, type FROM atoms WHERE element = 'O') a
  WHERE a.resname <> d.side)
SELECT label, {r('coalesce(c, 0) / (SELECT count(DISTINCT frame) FROM atoms)')} AS value
FROM labels LEFT JOIN hits USING (label)""")
def a4_event_rates(spark, sf_dir):
    return rounded(curves.event_rates(
        atoms(spark, sf_dir), bonds(spark, sf_dir), ["frame"], "resname = 'MOL'",
        "resname = 'SOL'"))


@query("u1_label_union", f"""
WITH {ATOMS}, {BONDS},
d AS (SELECT DISTINCT a.resname, a.type, h.resname AS side FROM atoms a
      JOIN bonds ON b = a.atom_id JOIN atoms h ON h.atom_id = bonds.a),
t AS (SELECT DISTINCT resname, type FROM atoms WHERE element = 'O')
SELECT DISTINCT d.resname || '(' || d.type || ') to ' || t.resname || '(' || t.type || ')' AS label
FROM d, t WHERE t.resname <> d.side""")
def u1_label_union(spark, sf_dir):
    return curves.event_rates(
        atoms(spark, sf_dir), bonds(spark, sf_dir), ["frame"], "resname = 'MOL'",
        "resname = 'SOL'").select("label")


def _bin_sql(v: str, lo: float, hi: float, n: int) -> str:
    step = (hi - lo) / n
    i = f"least(floor(({v} - {lo}) / ({hi} - {lo}) * {n}), {n - 1})"
    return (f"CASE WHEN {v} >= {lo} AND {v} <= {hi} THEN CASE "
            f"WHEN {v} < {lo} + {i} * {step!r}::DOUBLE THEN {i} - 1 "
            f"WHEN {v} >= {lo} + ({i} + 1) * {step!r}::DOUBLE AND {i} <> {n - 1} THEN {i} + 1 "
            f"ELSE {i} END END::INTEGER")


@query("a1_histogram", f"""
WITH b AS (SELECT l_returnflag, {_bin_sql('l_discount', 0.0, 0.08, 8)} AS bin FROM lineitem)
SELECT l_returnflag, i::INTEGER AS bin, count(*) FILTER (b.bin = i) AS count
FROM b CROSS JOIN range(8) t(i) GROUP BY ALL""")
def a1_histogram(spark, sf_dir):
    return curves.histogram(table(spark, sf_dir, "lineitem"), "l_discount", ["l_returnflag"],
                            (0.0, 0.08), 8)


def _profile_ctes(n: int, top: float, where_ref: str, where_sel: str) -> str:
    return f"""{ATOMS}, {_pairs_cte(where_ref, where_sel, 'true')},
counts AS (SELECT label, {_bin_sql('distance', 0.0, top, n)} AS bin, count(*) AS c
           FROM pairs GROUP BY ALL),
totals AS (SELECT label, sum(c)::BIGINT AS total FROM counts GROUP BY label),
profile AS (
  SELECT totals.label, i::INTEGER AS bin,
         coalesce(c, 0) / (total / 1728.0::DOUBLE * 4 / 3 * pi()
           * (pow((i + 1) * {top / n!r}::DOUBLE, 3) - pow(i * {top / n!r}::DOUBLE, 3))) AS value
  FROM totals CROSS JOIN range({n}) t(i) LEFT JOIN counts
  ON counts.label = totals.label AND counts.bin = i)"""


def _smooth_sql(source: str, keys: str, n: int) -> str:
    w = gaussian_weights(3.0)
    rows = ", ".join(f"({k - 12}, {float(v)!r}::DOUBLE)" for k, v in enumerate(w))
    m = f"((y.bin + k) % {2 * n} + {2 * n}) % {2 * n}"
    return f"""
taps(k, w) AS (VALUES {rows}),
smooth AS (
  SELECT {keys}, y.bin, sum(w * z.value) AS value
  FROM {source} y CROSS JOIN taps JOIN {source} z USING ({keys})
  WHERE z.bin = CASE WHEN {m} >= {n} THEN {2 * n - 1} - {m} ELSE {m} END
  GROUP BY {keys}, y.bin)"""


@query("a2_pair_profile", f"""
WITH {_profile_ctes(60, 6.0, "resname = 'MOL'", "resname = 'SOL' AND element = 'O'")}
SELECT label, bin, {r('value')} AS value FROM profile""")
def a2_pair_profile(spark, sf_dir):
    a = atoms(spark, sf_dir)
    g = curves.pair_profile(
        a.where("resname = 'MOL'"), a.where("resname = 'SOL' AND element = 'O'"), ["frame"],
        label=["type"], r_range=(0.0, 6.0), n_bins=60, smooth=False)
    return rounded(g.withColumnRenamed("type", "label"))


@query("a3_type_profiles", f"""
WITH {_profile_ctes(60, 6.0, "mass > 0.5", "resname = 'SOL' AND element = 'O'")},
{_smooth_sql('profile', 'label', 60)}
SELECT label, bin, {r('value')} AS value FROM smooth""")
def a3_type_profiles(spark, sf_dir):
    g = curves.type_profiles(
        atoms(spark, sf_dir), ["frame"], "resname = 'MOL'", "resname = 'SOL' AND element = 'O'",
        r_range=(0.0, 6.0), n_bins=60)
    return rounded(g.withColumnRenamed("type", "label"))


@query("a5_distance_distribution", f"""
WITH {ATOMS}, {_pairs_cte("resname = 'MOL'", "resname = 'SOL'", "distance <= 5")},
counts AS (SELECT label, {_bin_sql('distance', 1.0, 5.0, 40)} AS bin, count(*) AS c
           FROM pairs GROUP BY ALL)
SELECT t.label, i::INTEGER AS bin, {r('coalesce(c, 0) / t.total')} AS value
FROM (SELECT label, sum(c) FILTER (bin IS NOT NULL)::DOUBLE AS total FROM counts GROUP BY label) t
CROSS JOIN range(40) g(i) LEFT JOIN counts ON counts.label = t.label AND counts.bin = i""")
def a5_distance_distribution(spark, sf_dir):
    a = atoms(spark, sf_dir)
    d = curves.distance_distribution(a.where("resname = 'MOL'"), a.where("resname = 'SOL'"),
                                     ["frame"], [], ["type"], (1.0, 5.0), 40)
    return rounded(d.withColumnRenamed("type", "label"))


def _mean_4(c):
    return f"round_even(sum({c}::DECIMAL(12,2))::DOUBLE / count({c}) * 10000.0::DOUBLE, 0) / 10000.0::DOUBLE AS {c}"


@query("a6_mean_box", f"""
WITH {LINE_DRAWS_WIDE}
SELECT chain, {_mean_4('l_quantity')}, {_mean_4('l_discount')}, {_mean_4('l_extendedprice')}
FROM wide WHERE step >= floor((SELECT max(step) + 1 FROM wide) * 0.2) GROUP BY chain""")
def a6_mean_box(spark, sf_dir):
    # Two decimals each, so that the sums are exact in any order.
    frames = line_draws_wide(spark, sf_dir).withColumnRenamed("step", "frame").withColumns(
        {c: F.col(c).cast("decimal(12,2)") for c in LINE_PARAMS})
    return curves.mean_box(frames, ["chain"], LINE_PARAMS)


@query("p1_frame_slice", f"""
WITH {LINE_DRAWS_WIDE}, n AS (SELECT max(step) + 1 AS n FROM wide)
SELECT chain, step AS frame, l_quantity FROM wide, n
WHERE step >= 1 AND step < n - 1 AND (step - 1) % 4 = 0""")
def p1_frame_slice(spark, sf_dir):
    frames = line_draws_wide(spark, sf_dir).select(
        "chain", F.col("step").alias("frame"), "l_quantity")
    return pairs.slice_frames(frames, 1, -1, 4, ["chain"])


@query("p2_atom_selection", f"""
WITH {ATOMS}
SELECT frame, atom_id, type FROM atoms
WHERE resname IN ('SOL', 'WAT') AND type LIKE 'O%' AND mass BETWEEN 10 AND 20
  AND NOT element = 'H'""")
def p2_atom_selection(spark, sf_dir):
    return pairs.select_atoms(
        atoms(spark, sf_dir),
        "resname IN ('SOL', 'WAT') AND type LIKE 'O%' AND mass BETWEEN 10 AND 20 "
        "AND NOT element = 'H'").select("frame", "atom_id", "type")


@query("p9_evenly_spaced", """
WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)
                  - 1 AS p, count(*) OVER (PARTITION BY user_id) AS n FROM events),
picks AS (SELECT DISTINCT user_id,
            CASE WHEN i = least(23, n) - 1 THEN n - 1
                 ELSE floor(i * ((n - 1)::DOUBLE / (least(23, n) - 1)::DOUBLE))::BIGINT END AS p
          FROM (SELECT DISTINCT user_id, n FROM n), range(23) t(i) WHERE i < least(23, n))
SELECT user_id, event_id FROM n JOIN picks USING (user_id, p)""")
def p9_evenly_spaced(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return ordering.evenly_spaced(events, ["user_id"], ["ts", "event_id"], 23).drop("ts")


@query("p15_usable_box", """
SELECT event_id, CASE WHEN value > 5 AND value < 60 THEN value ELSE 7.5::DOUBLE END AS bx
FROM events""")
def p15_usable_box(spark, sf_dir):
    v = F.col("value")
    own = F.when(v < 60, F.array(F.when(v > 5, v).otherwise(v * 0.0), F.lit(10.0), F.lit(10.0)))
    system = F.array(F.lit(float("nan")), F.lit(1.0), F.lit(1.0))
    default = F.array(F.lit(7.5), F.lit(7.5), F.lit(7.5))
    return table(spark, sf_dir, "events").select(
        "event_id", expr.usable_box(own, system, default)[0].alias("bx"))


@query("p16_cell_vectors", f"""
WITH c AS (
  SELECT event_id, value + 1 AS a, value + 2 AS b, value + 3 AS c,
         cos(radians(80.0::DOUBLE + event_id % 7)) AS ca, cos(radians(85.0::DOUBLE)) AS cb,
         cos(radians(95.0::DOUBLE)) AS cg, sin(radians(95.0::DOUBLE)) AS sg FROM events)
SELECT event_id, {r('b * cg')} AS v3, {r('b * sg')} AS v4, {r('c * cb')} AS v6,
       {r('c * (ca - cb * cg) / sg')} AS v7,
       {r('sqrt(greatest(c * c - pow(c * cb, 2) - pow(c * (ca - cb * cg) / sg, 2), 0))')} AS v8
FROM c""")
def p16_cell_vectors(spark, sf_dir):
    v = F.col("value")
    cell = expr.cell_vectors(v + 1, v + 2, v + 3, F.lit(80.0) + F.pmod("event_id", F.lit(7)),
                             F.lit(85.0), F.lit(95.0))
    rows = table(spark, sf_dir, "events").select("event_id", cell.alias("cell"))
    return rounded(rows.select("event_id", *[F.col("cell")[i].alias(f"v{i}")
                                             for i in (3, 4, 6, 7, 8)]))


@query("f6_min_image", f"""
WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity - 25.5 AS d FROM lineitem)
SELECT *, d - round_even(d / 10.0::DOUBLE, 0) * 10 AS shortest FROM d""")
def f6_min_image(spark, sf_dir):
    d = (F.col("l_quantity") - 25.5).alias("d")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", d)
    return rows.withColumn("shortest", expr.min_image(F.col("d"), F.lit(10.0)))


ELEMENTS = {"H": 1.008, "C": 12.011, "N": 14.007, "O": 15.999, "Na": 22.990, "S": 32.060,
            "Cl": 35.450}


@query("j6_nearest_element", """
WITH e(element, mass) AS (VALUES """ + ", ".join(
    f"('{k}', {v}::DOUBLE)" for k, v in ELEMENTS.items()) + """),
m AS (SELECT p_partkey, p_size + 0.005::DOUBLE * (p_partkey % 5) AS mass FROM part)
SELECT p_partkey, round(m.mass, 6) AS mass,
       CASE WHEN min(abs(m.mass - e.mass)) <= 0.01 THEN arg_min(element, abs(m.mass - e.mass)) END
         AS element
FROM m, e GROUP BY p_partkey, m.mass""")
def j6_nearest_element(spark, sf_dir):
    masses = table(spark, sf_dir, "part").select(
        "p_partkey", (F.col("p_size") + F.lit(0.005) * F.pmod("p_partkey", F.lit(5))).alias("mass"))
    dim = spark.createDataFrame(list(ELEMENTS.items()), "element string, mass double")
    return rounded(pairs.nearest_element(masses, dim, ["p_partkey"]))


# -- curves ----------------------------------------------------------------

def _savgol_sql(source: str, keys: str, n: int) -> str:
    window = min(15, n if n % 2 else n - 1)
    rows = ", ".join(f"({i}, {j}, {float(v)!r}::DOUBLE)"
                     for i, row in enumerate(savgol_matrix(window)) for j, v in enumerate(row))
    start = f"greatest(0, least(y.bin - {window // 2}, {n - window}))"
    return f"""
sg(i, j, c) AS (VALUES {rows}),
fitted AS (
  SELECT {keys}, y.bin, y.value AS raw, sum(c * z.value) AS value
  FROM {source} y JOIN sg ON i = y.bin - {start}
  JOIN {source} z USING ({keys}) WHERE z.bin = {start} + j
  GROUP BY {keys}, y.bin, y.value)"""


def _peaks_sql(source: str, keys: str, name: str) -> str:
    on = " AND ".join(f"j.{k.strip()} = p.{k.strip()}" for k in keys.split(","))
    on_k = on.replace("j.", "k.")
    return f"""
{name} AS (
  SELECT p.*, p.value - greatest(
    (SELECT min(j.value) FROM {source} j WHERE {on} AND j.bin <= p.bin AND j.bin > p.wall_l),
    (SELECT min(j.value) FROM {source} j WHERE {on} AND j.bin >= p.bin AND j.bin < p.wall_r)
    ) AS prominence
  FROM (
    SELECT p.*,
      coalesce((SELECT max(k.bin) FROM {source} k WHERE {on_k} AND k.bin < p.bin
                AND k.value > p.value), -1) AS wall_l,
      coalesce((SELECT min(k.bin) FROM {source} k WHERE {on_k} AND k.bin > p.bin
                AND k.value > p.value), 1000000) AS wall_r
    FROM (SELECT {keys}, bin, value, lag(value) OVER w AS before, lead(value) OVER w AS after
          FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY bin)) p
    WHERE before < value AND after < value) p)"""


@query("w8_savgol", f"""
WITH {EVENT_CURVES}, {_savgol_sql('curves', 'sample_id, label', DAYS)}
SELECT sample_id, label, bin, {r('value')} AS value FROM fitted""")
def w8_savgol(spark, sf_dir):
    return rounded(curves.smooth_savgol(event_curves(spark, sf_dir), ["sample_id", "label"], DAYS))


@query("w9_peaks", f"""
WITH {REFERENCE_CURVES}, {_peaks_sql('ref', 'label', 'peaks')}
SELECT label, bin, {r('value')} AS height, {r('prominence')} AS prominence FROM peaks""")
def w9_peaks(spark, sf_dir):
    return rounded(curves.curve_peaks(reference_curves(spark, sf_dir), ["label"]))


@query("w10_gaussian_smooth", f"""
WITH {EVENT_CURVES}, {_smooth_sql('curves', 'sample_id, label', DAYS)}
SELECT sample_id, label, bin, {r('value')} AS value FROM smooth""")
def w10_gaussian_smooth(spark, sf_dir):
    return rounded(curves.smooth_gaussian(event_curves(spark, sf_dir), ["sample_id", "label"]))


@query("w12_baseline_shift", f"""
WITH {EVENT_CURVES}
SELECT sample_id, label, bin,
       {r('value - min(value) OVER (PARTITION BY sample_id, label)')} AS value FROM curves""")
def w12_baseline_shift(spark, sf_dir):
    return rounded(curves.baseline_shift(event_curves(spark, sf_dir), ["sample_id", "label"]))


N_EFF_CTES = f"""
{_savgol_sql('curves', 'sample_id, label', DAYS)},
up AS (SELECT sample_id, label, bin, value FROM fitted),
down AS (SELECT sample_id, label, bin, -value AS value FROM fitted),
{_peaks_sql('up', 'sample_id, label', 'tops')}, {_peaks_sql('down', 'sample_id, label', 'dips')},
noise AS (SELECT sample_id, label, greatest(5 * median(abs(raw - value)), 2.220446049250313e-16)
            AS floor_ FROM fitted GROUP BY ALL),
n_eff AS (
  SELECT sample_id, label, greatest(1.0::DOUBLE, coalesce(sum(greatest(1, ln(prominence / 0.5)))
      FILTER (prominence >= floor_), 0)) AS n_eff
  FROM noise LEFT JOIN (SELECT sample_id, label, prominence FROM tops
                        UNION ALL SELECT sample_id, label, prominence FROM dips)
  USING (sample_id, label) GROUP BY ALL)"""


@query("a22_effective_observations", f"""
WITH {EVENT_CURVES}, {N_EFF_CTES}
SELECT sample_id, label, {r('n_eff')} AS n_eff FROM n_eff""")
def a22_effective_observations(spark, sf_dir):
    return rounded(curves.effective_observations(
        event_curves(spark, sf_dir), ["sample_id", "label"], 0.5, DAYS))


@query("a23_resolve_n_eff", f"""
WITH {EVENT_CURVES}, {N_EFF_CTES},
s AS (SELECT label, sum(n_eff) AS total FROM n_eff GROUP BY label)
SELECT label AS qoi, CASE label WHEN 'click' THEN 4.0::DOUBLE WHEN 'view' THEN 300.0::DOUBLE
                     ELSE {r('total')} END AS n_eff FROM s""")
def a23_resolve_n_eff(spark, sf_dir):
    data = event_curves(spark, sf_dir)
    n_eff = curves.effective_observations(data, ["sample_id", "label"], 0.5, DAYS
                                          ).withColumnRenamed("label", "qoi")
    models = data.groupBy(F.col("label").alias("qoi")).agg(
        F.count(F.lit(1)).alias("size")).select(
        "qoi", "size", F.when(F.col("qoi") == "click", F.lit(4.0)).alias("n_eff"),
        (F.col("qoi") == "view").alias("independent"))
    return rounded(curves.resolve_n_eff(models, n_eff))


@query("a25_curve_dimensions", f"""
WITH {EVENT_CURVES}
SELECT sample_id, count(DISTINCT label) AS n_curves,
       count(*) // count(DISTINCT label) AS curve_length FROM curves GROUP BY sample_id""")
def a25_curve_dimensions(spark, sf_dir):
    return curves.curve_dimensions(event_curves(spark, sf_dir), ["sample_id"])


@query("a26_mean_outputs", f"""
WITH {EVENT_CURVES} SELECT label, {r('avg(value)')} AS value FROM curves GROUP BY label""")
def a26_mean_outputs(spark, sf_dir):
    return rounded(curves.mean_outputs(event_curves(spark, sf_dir), ["label"]))


GRID = [-1.0 + i * 32.0 / 72 for i in range(73)]


@query("j14_interpolate", f"""
WITH {REFERENCE_CURVES},
g AS (SELECT label, i::INTEGER AS bin, -1.0::DOUBLE + i * 32.0::DOUBLE / 72 AS x
      FROM (SELECT DISTINCT label FROM ref), range(73) t(i))
SELECT g.label, g.bin, {r('g.x')} AS x,
       {r('CASE WHEN lo.bin IS NULL THEN hi.value WHEN hi.bin IS NULL THEN lo.value ELSE lo.value + (hi.value - lo.value) * (g.x - lo.bin) END')} AS value
FROM g LEFT JOIN ref lo ON lo.label = g.label AND lo.bin = CASE WHEN g.x >= 0 THEN least(floor(g.x), 29) END
LEFT JOIN ref hi ON hi.label = g.label
  AND hi.bin = CASE WHEN g.x < 0 THEN 0 WHEN floor(g.x) + 1 <= 29 THEN floor(g.x) + 1 END""")
def j14_interpolate(spark, sf_dir):
    points = reference_curves(spark, sf_dir).withColumn("x", F.col("bin").cast("double")).drop(
        "bin")
    return rounded(curves.interpolate(points, ["label"], GRID))


@query("a18_first_appearance", """
SELECT p_type, min(p_partkey) AS first, row_number() OVER (ORDER BY min(p_partkey), p_type) AS ord
FROM part GROUP BY p_type""")
def a18_first_appearance(spark, sf_dir):
    return curves.first_appearance(table(spark, sf_dir, "part"), "p_type", "p_partkey")
