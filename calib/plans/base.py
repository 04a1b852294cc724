"""Query registry and the calibration views of the given tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calib.operators.curves import fill_bins
from calib.operators.ordering import number_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# One lineitem row is named by these five columns.
LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")


def query(name: str, sql: str | None = None):
    """Register a query and, where it has one, its SQL twin."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, cols: Sequence[str] | None = None) -> DataFrame:
    """Round double columns; adding zero turns -0.0 into 0.0."""
    cols = cols or [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in cols})


def r(sql: str, digits: int = 6) -> str:
    return f"(round({sql}, {digits}) + 0.0::DOUBLE)"


# -- draws: rows in order, dealt to chains of one length ---------------------

CHAINS = 64


def dealt(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """All rows as (chain, step, ...): dealt in turn to as many chains as divide their number.

    Stored, as draws are.
    """
    n = rows.count()
    chains = max(k for k in range(1, CHAINS + 1) if n % k == 0)
    place = F.col("__place") - 1
    return number_rows(rows, [], order, "__place", stored=True).withColumns({
        "chain": place % chains, "step": F.floor(place / chains)}).drop("__place")


def event_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chain, step, param, value) of all events."""
    events = table(spark, sf_dir, "events").select(
        "ts", "event_id", F.lit("value").alias("param"), "value")
    return dealt(events, ["ts", "event_id"]).select("chain", "step", "param", "value")


def _dealt_sql(source: str, columns: str, order: str) -> str:
    return f"""
  SELECT p % k AS chain, p // k AS step, {columns} FROM (
    SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS p FROM {source}),
    (SELECT max(d) AS k FROM range(1, {CHAINS + 1}) t(d), (SELECT count(*) AS n FROM {source}) WHERE n % d = 0)"""


EVENT_DRAWS = f"""
draws AS ({_dealt_sql('events', "'value' AS param, value", 'ts, event_id')})
"""


# -- draws: line items with three parameters, many ties ----------------------

LINE_PARAMS = ("l_quantity", "l_discount", "l_extendedprice")


def line_draws_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chain, step, l_quantity, l_discount, l_extendedprice) of all line items."""
    lines = table(spark, sf_dir, "lineitem").select(*LINE_KEY, *LINE_PARAMS)
    return dealt(lines, LINE_KEY).select("chain", "step", *LINE_PARAMS)


def line_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = [F.struct(F.lit(p).alias("param"), F.col(p).alias("value")) for p in LINE_PARAMS]
    return line_draws_wide(spark, sf_dir).select("chain", "step", F.inline(F.array(*pairs)))


LINE_DRAWS_WIDE = f"""
wide AS ({_dealt_sql('lineitem', ', '.join(LINE_PARAMS), ', '.join(LINE_KEY))})
"""

LINE_DRAWS = LINE_DRAWS_WIDE + """,
draws AS (
  SELECT chain, step, 'l_quantity' AS param, l_quantity AS value FROM wide
  UNION ALL SELECT chain, step, 'l_discount', l_discount FROM wide
  UNION ALL SELECT chain, step, 'l_extendedprice', l_extendedprice FROM wide)
"""


# -- curves: daily sums of event values -------------------------------------

DAYS = 30


def event_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, label, bin, value): ten samples, one label per event type, 30 days."""
    events = table(spark, sf_dir, "events")
    bin_ = F.datediff(F.col("ts"), F.lit("2024-01-01").cast("date"))
    sums = events.groupBy(
        F.pmod("user_id", F.lit(10)).cast("long").alias("sample_id"),
        F.col("event_type").alias("label"), bin_.cast("int").alias("bin"),
    ).agg(F.sum("value").alias("value"))
    return fill_bins(sums, ["sample_id", "label"], DAYS, "value")


EVENT_CURVES = """
sums AS (
  SELECT user_id % 10 AS sample_id, event_type AS label,
         date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))::INTEGER AS bin,
         sum(value) AS value
  FROM events GROUP BY ALL),
curves AS (
  SELECT sample_id, label, bin, coalesce(value, 0.0::DOUBLE) AS value
  FROM (SELECT DISTINCT sample_id, label, i::INTEGER AS bin FROM sums, range(30) t(i))
  LEFT JOIN sums USING (sample_id, label, bin))
"""


def reference_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, bin, value): a tenth of the sum over all users, as one reference curve."""
    return event_curves(spark, sf_dir).groupBy("label", "bin").agg(
        (F.sum("value") / 10.0).alias("value"))


REFERENCE_CURVES = EVENT_CURVES + """,
ref AS (SELECT label, bin, sum(value) / 10.0 AS value FROM curves GROUP BY ALL)
"""


# -- atoms: embeddings as periodic frames of 48 points ----------------------

FRAME_SIZE = 48
BOX = 12.0


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, atom_id, place, resname, type, element, mass, x, y, z, bx, by, bz)."""
    e = table(spark, sf_dir, "embeddings")
    place = F.pmod("vec_id", F.lit(FRAME_SIZE)).cast("int")
    coord = lambda i: F.pmod(
        (F.col("embedding")[i].cast("double") + 0.5) * F.lit(BOX), F.lit(BOX))
    kind = F.pmod("vec_id", F.lit(3))
    return e.select(
        F.floor(F.col("vec_id") / FRAME_SIZE).cast("long").alias("frame"),
        F.col("vec_id").alias("atom_id"), place.alias("place"),
        F.when(place < 12, "MOL").otherwise("SOL").alias("resname"),
        F.when(kind == 1, "HW").otherwise(F.concat(F.lit("O"), kind.cast("string"))).alias("type"),
        F.when(kind == 1, "H").otherwise("O").alias("element"),
        F.when(kind == 1, F.lit(0.4)).otherwise(F.lit(16.0)).alias("mass"),
        coord(0).alias("x"), coord(1).alias("y"), coord(2).alias("z"),
        F.lit(BOX).alias("bx"), F.lit(BOX).alias("by"), F.lit(BOX).alias("bz"))


ATOMS = f"""
atoms AS (
  SELECT vec_id // {FRAME_SIZE} AS frame, vec_id AS atom_id,
         (vec_id % {FRAME_SIZE})::INTEGER AS place,
         CASE WHEN vec_id % {FRAME_SIZE} < 12 THEN 'MOL' ELSE 'SOL' END AS resname,
         CASE WHEN vec_id % 3 = 1 THEN 'HW' ELSE 'O' || (vec_id % 3) END AS type,
         CASE WHEN vec_id % 3 = 1 THEN 'H' ELSE 'O' END AS element,
         CASE WHEN vec_id % 3 = 1 THEN 0.4::DOUBLE ELSE 16::DOUBLE END AS mass,
         (embedding[1]::DOUBLE + 0.5) * 12.0::DOUBLE AS x,
         (embedding[2]::DOUBLE + 0.5) * 12.0::DOUBLE AS y,
         (embedding[3]::DOUBLE + 0.5) * 12.0::DOUBLE AS z
  FROM embeddings)
"""


def _wrapped(axis: str) -> str:
    return (f"CASE WHEN {axis} % {BOX}::DOUBLE < 0 THEN ({axis} % {BOX}::DOUBLE + {BOX}::DOUBLE) % {BOX}::DOUBLE "
            f"ELSE {axis} % {BOX}::DOUBLE END AS {axis}")


# The same atoms with coordinates inside the box, as ``atoms`` gives them.
WRAPPED_ATOMS = ATOMS.replace("atoms AS", "free AS", 1) + f""",
atoms AS (SELECT * REPLACE ({', '.join(_wrapped(x) for x in 'xyz')}) FROM free)
"""
