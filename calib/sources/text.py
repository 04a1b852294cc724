"""Simulator text as tables.

``files`` DataFrames have one row per file: (path, value), value being its whole text.
Parsing is done with JVM string functions; records that cannot be used are split
off by ``quarantine`` rather than dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calib.operators.ordering import attach

# CODATA 2018 conversion factors.
HARTREE_TO_EV = 27.211386245988
BOHR_TO_ANGSTROM = 0.529177210903
FORCE_UNIT = HARTREE_TO_EV / BOHR_TO_ANGSTROM

# Element symbols by atomic number.
SYMBOLS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se "
    "Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb "
    "Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm "
    "Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og").split()


def read_files(spark: SparkSession, paths: str | Sequence[str], pattern: str | None = None
               ) -> DataFrame:
    """Whole text files under ``paths``, also in sub-folders."""
    found = spark.read.text(paths, wholetext=True, recursiveFileLookup=True,
                            pathGlobFilter=pattern)
    return found.select(F.col("_metadata.file_path").alias("path"), "value")


def file_lines(files: DataFrame) -> DataFrame:
    """(path, line_no, line) from whole files."""
    return files.select(
        "path", F.posexplode_outer(_lines(F.col("value"))).alias("line_no", "line")).where(
        F.col("line_no").isNotNull())


def _lines(text: Column) -> Column:
    """Lines of a text without the empty piece after a final line break."""
    return F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n")


def _lines_with(text: Column, mark: str) -> Column:
    """The lines of a text that hold ``mark``; other lines are not cut out."""
    return F.regexp_extract_all(text, F.lit(r"(?m)^.*\Q" + mark + r"\E.*$"), F.lit(0))


def words_of(line: Column) -> Column:
    return F.split(F.trim(line), r"\s+")


def number_of(word: Column) -> Column:
    """A word as a number, or NULL; words such as NaN are no numbers."""
    return F.when(word.rlike("[0-9]"), word.try_cast("double"))


def field(head: Column, name: str) -> Column:
    """The value of ``name=value`` in a header line; quotes around a value are taken off."""
    pair = r'([^\s="]+)=("[^"]*"|\S+)'
    keys = F.regexp_extract_all(head, F.lit(pair), F.lit(1))
    values = F.regexp_extract_all(head, F.lit(pair), F.lit(2))
    value = F.get(values, (F.array_position(keys, name) - 1).cast("int"))
    return _nonempty(F.regexp_replace(value, '"', ""))


def number_table(lines: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Numeric columns from whitespace-separated lines; blank and ``#`` lines are skipped.

    ``lines`` has a column ``value`` with one line per row, as read by ``spark.read.text``.
    """
    text = F.trim(F.regexp_replace("value", r"#.*$", ""))
    words = lines.where(F.length(text) > 0).select(*keep, F.split(text, r"\s+").alias("w"))
    return words.select(*keep, *[F.get("w", F.lit(i)).cast("double").alias(n)
                                 for i, n in enumerate(names)])


def curve_csv(spark: SparkSession, path: str, x: str = "r", y: str = "g") -> DataFrame:
    """Two-column curve with a header line."""
    return spark.read.csv(path, header=True, schema=f"`{x}` double, `{y}` double",
                          ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True,
                          enforceSchema=True)


# -- XYZ frames ------------------------------------------------------------

def _nonempty(text: Column) -> Column:
    return F.when(text != "", text)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``; a value bound by a lambda is found once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _atom(line: Column) -> Column:
    """An atom line as a struct; ``bad`` if it has no symbol and three numbers."""
    def parsed(v: Column) -> Column:
        w, number = v["w"], lambda k: F.get(v["numbers"], F.lit(k - 2))
        forced = F.size(w) >= 7
        bad = number(2).isNull() | number(3).isNull() | number(4).isNull()
        for k in (5, 6, 7):
            bad = bad | (forced & number(k).isNull())
        return F.struct(
            w[0].alias("symbol"), number(2).alias("x"), number(3).alias("y"), number(4).alias("z"),
            *[F.when(forced, number(k)).alias(n) for k, n in ((5, "fx"), (6, "fy"), (7, "fz"))],
            forced.alias("has_force"), bad.alias("bad"), line.alias("line"))

    return _once(words_of(line), lambda w: _once(F.struct(w.alias("w"), F.transform(
        F.slice(w, 2, 6), lambda x: x.try_cast("double")).alias("numbers")), parsed))


def frame_of_lines(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Frames from their ``lines``: (keys..., n, atoms, energy, lattice, pbc, source, issue).

    One atom line without forces leaves the whole frame without forces.  A frame shorter
    than its own count, with more lines that are not blank, with an atom line or a cell
    that cannot be read has an ``issue`` and no atoms.
    """
    head = F.get("lines", F.lit(1))
    cell = field(head, "Lattice")
    lattice = F.transform(words_of(cell), lambda v: v.try_cast("double"))
    found = rows.withColumns({
        "n": F.trim(F.get("lines", F.lit(0))).try_cast("int"), "energy": number_of(field(head, "energy")),
        "lattice": F.when(cell.isNotNull(), lattice), "pbc": field(head, "pbc"), "source": field(head, "source"),
        "size": F.size("lines") - 2})
    n = F.greatest("n", F.lit(0))
    found = found.withColumns({
        "raw": F.transform(F.slice("lines", 3, n), _atom),
        "more": F.exists(F.slice("lines", n + 3, F.greatest(F.col("size") - n, F.lit(0))), lambda x: F.trim(x) != "")})
    found = found.withColumn("wrong", F.get(F.filter("raw", lambda a: a["bad"]), F.lit(0))["line"])
    nine = (F.size("lattice") == 9) & F.forall("lattice", lambda v: v.isNotNull())
    issue = (F.when(F.col("n").isNull(), "no atom count")
             .when(F.col("size") < F.col("n"), F.concat_ws(" ", F.greatest("size", F.lit(0)), F.lit("of"), "n",
                                                            F.lit("atom lines")))
             .when(F.col("wrong").isNotNull(), F.concat(F.lit("invalid atom line: "), "wrong"))
             .when(F.col("more"), F.concat(F.lit("lines after the last of "), "n", F.lit(" atoms")))
             .when(F.col("lattice").isNotNull() & ~nine, "a Lattice field needs 9 values"))
    found = found.withColumn("issue", issue)
    # A column used inside a lambda would be found again for every atom once the planner merges the two.
    atoms = _once(F.col("raw"), lambda raw: _once(F.forall(raw, lambda a: a["has_force"]), lambda forced: F.transform(
        raw, lambda a: F.struct(*[a[k].alias(k) for k in ("symbol", "x", "y", "z")],
                                *[F.when(forced, a[k]).alias(k) for k in ("fx", "fy", "fz")]))))
    return found.select(*keys, "n", F.when(F.col("issue").isNull(), atoms).alias("atoms"), "energy", "lattice",
                        "pbc", "source", "issue")


def _or_raise(column: str, *prefix: str) -> Column:
    """``column``, or an error where its row has an issue."""
    text = F.concat(*[F.col(p) for p in prefix], F.lit(": ") if prefix else F.lit(""), F.col("issue"))
    return F.when(F.col("issue").isNull(), F.col(column)).otherwise(F.raise_error(text))


def extxyz_frames(files: DataFrame) -> DataFrame:
    """First frame of each file: path, n, atoms, energy, lattice, pbc, source.

    A frame that cannot be read is an error; ``lines.trajectory_frames`` sets it aside.
    """
    rows = files.select("path", _lines(F.col("value")).alias("lines"))
    n = F.greatest(F.coalesce(F.trim(F.get("lines", F.lit(0))).try_cast("int"), F.lit(0)), F.lit(0))
    frames = frame_of_lines(rows.withColumn("lines", F.slice("lines", 1, n + 2)), ["path"])
    return frames.withColumn("atoms", _or_raise("atoms")).drop("issue")


def frame_atoms(frames: DataFrame) -> DataFrame:
    """One row per atom: (path, atom, symbol, x, y, z, fx, fy, fz).

    The outer generator keeps the optimiser from adding a filter that would parse
    the text a second time; empty frames are removed afterwards.
    """
    return frames.select("path", F.posexplode_outer("atoms").alias("atom", "a")).where(
        F.col("atom").isNotNull()).select("path", "atom", "a.*")


def last_frame(files: DataFrame) -> DataFrame:
    """Last frame of each XYZ trajectory: path, n, atoms (symbol, x, y, z)."""
    rows = files.select("path", _lines(F.col("value")).alias("lines")).withColumn(
        "n", F.trim(F.get("lines", F.lit(0))).cast("int"))
    short = F.size("lines") < F.col("n") + 2
    tail = F.when(short, F.raise_error(F.concat(F.col("path"), F.lit(
        " does not contain a complete frame"))).cast("array<string>")).otherwise(
        F.slice("lines", F.size("lines") - F.col("n") + 1, F.col("n")))
    rows = rows.select("path", "n", F.transform(tail, _atom).alias("raw")).withColumn("issue", F.get(F.transform(
        F.filter("raw", lambda a: a["bad"]), lambda a: F.concat(F.lit("invalid atom line: "), a["line"])), F.lit(0)))
    atoms = F.transform("raw", lambda a: F.struct(*[a[k].alias(k) for k in ("symbol", "x", "y", "z")]))
    return rows.withColumn("atoms", atoms).select("path", "n", _or_raise("atoms", "path").alias("atoms"))


def extxyz_comment(files: DataFrame) -> DataFrame:
    return files.select("path", F.trim(F.get(_lines(F.col("value")), F.lit(1))).alias("comment"))


# -- energies and forces ---------------------------------------------------

def energies(files: DataFrame) -> DataFrame:
    """(path, energy_ev): first total energy of each log; NULL when there is none."""
    totals = F.filter(_lines_with(F.col("value"), "ENERGY|"), lambda x: F.trim(x).startswith("ENERGY|")
                      & F.contains(x, F.lit("Total FORCE_EVAL")))
    found = F.filter(F.transform(totals, lambda x: number_of(F.element_at(words_of(x), -1))),
                     lambda v: v.isNotNull())
    return files.select("path", (F.get(found, F.lit(0)) * F.lit(HARTREE_TO_EV)).alias("energy_ev"))


def force_row(words: Column, usable: Column, at: int) -> Column:
    """The forces of a line of six ``words``, its components from place ``at``; NULL if it has none."""
    parts = [number_of(F.get(words, F.lit(at + k))) for k in range(3)]
    ok = (F.size(words) == 6) & usable
    for p in parts:
        ok = ok & p.isNotNull()
    return F.when(ok, F.struct(*[(p * F.lit(FORCE_UNIT)).alias(f"f{n}") for p, n in zip(parts, "xyz")]))


def _force_rows(lines: Column, usable: Callable[[Column], Column], at: int) -> Column:
    """The forces of all lines that have them; each line is cut into words once."""
    return F.filter(F.transform(F.transform(lines, words_of), lambda w: force_row(w, usable(w), at)),
                    lambda f: f.isNotNull())


def whole_number(word: Column) -> Column:
    return word.rlike("^[0-9]+$")


def force_arrays(files: DataFrame) -> DataFrame:
    """(path, forces ARRAY<STRUCT>): piped rows, else the last non-empty force table."""
    piped = _force_rows(_lines_with(F.col("value"), "FORCES|"), lambda w: (F.get(w, F.lit(0)) == "FORCES|") & whole_number(w[1])
                        & number_of(w[5]).isNotNull(), 2)
    blocks = F.split("value", r"(?m)^\s*ATOMIC FORCES\b")
    blocks = F.transform(F.slice(blocks, 2, F.greatest(F.size(blocks) - 1, F.lit(0))),
                         lambda b: F.split(b, r"(?m)^\s*SUM OF ATOMIC FORCES\b")[0])
    tables = F.filter(F.transform(blocks, lambda b: _force_rows(
        _lines(b), lambda w: whole_number(w[0]) & whole_number(w[1]), 3)), lambda t: F.size(t) > 0)
    rows = files.select("path", piped.alias("piped"), tables.alias("tables"))
    best = F.when(F.size("piped") > 0, F.col("piped")).otherwise(
        F.try_element_at("tables", F.lit(-1)))
    return rows.select("path", best.alias("forces"))


def forces(files: DataFrame) -> DataFrame:
    """(path, atom, fx, fy, fz), atoms numbered from 0."""
    return force_arrays(files).select(
        "path", F.posexplode_outer("forces").alias("atom", "f")).where(
        F.col("atom").isNotNull()).select("path", "atom", "f.*")


def compound_frames(snapshots: DataFrame, trajectories: DataFrame, logs: DataFrame) -> DataFrame:
    """One frame per run from its snapshot, trajectory and log, with an ``issue`` column.

    All three have (run, value).  Positions are the trajectory's last frame, the cell is
    the snapshot's, energy and forces are the log's; the source is ``sp``.
    """
    named = lambda df: df.select(F.col("run").alias("path"), "value")
    cell = extxyz_frames(named(snapshots)).select(
        F.col("path").alias("run"), "lattice", F.coalesce("pbc", F.lit("T T T")).alias("pbc"))
    moved = last_frame(named(trajectories)).select(
        F.col("path").alias("run"), "n", F.col("atoms").alias("moved"))
    log = energies(named(logs)).join(force_arrays(named(logs)), "path").select(
        F.col("path").alias("run"), F.col("energy_ev").alias("energy"), "forces")
    rows = cell.join(moved, "run", "full").join(log, "run", "full")
    issue = (F.when(F.col("moved").isNull(), "no trajectory")
             .when(F.col("energy").isNull(), "no energy")
             .when(F.col("forces").isNull(), "no forces")
             .when(F.size("forces") != F.size("moved"), "forces do not match the atoms"))
    atoms = F.zip_with("moved", "forces", lambda a, f: F.struct(
        *[a[k].alias(k) for k in ("symbol", "x", "y", "z")],
        *[f[k].alias(k) for k in ("fx", "fy", "fz")]))
    return rows.withColumn("issue", issue).select(
        F.col("run").alias("path"), "n", F.when(F.col("issue").isNull(), atoms).alias("atoms"),
        "energy", "lattice", "pbc", F.lit("sp").alias("source"), "issue")


def quarantine(rows: DataFrame, issue: str = "issue") -> tuple[DataFrame, DataFrame]:
    """(usable rows, rows with an issue)."""
    return rows.where(F.col(issue).isNull()).drop(issue), rows.where(F.col(issue).isNotNull())


def usable_report(rows: DataFrame, issue: str = "issue") -> DataFrame:
    """Usable and total counts, and the number of rows per issue."""
    return rows.groupBy(F.coalesce(issue, F.lit("usable")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("n"))


def atomic_numbers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(s.lower(), i + 1) for i, s in enumerate(SYMBOLS)], "symbol string, number int")


def atom_energies(snapshots: DataFrame, logs: DataFrame) -> DataFrame:
    """(number, energy_ev) of isolated atoms; the last run in order wins per element.

    ``snapshots`` and ``logs``: (run, value); an unknown element or a log without an
    energy is an error.
    """
    symbol = F.lower(words_of(F.get(_lines(F.col("value")), F.lit(2)))[0])
    runs = snapshots.select("run", symbol.alias("symbol"))
    e = energies(logs.select(F.col("run").alias("path"), "value")).withColumnRenamed("path", "run")
    rows = attach(runs.join(e, "run"), atomic_numbers(snapshots.sparkSession), ["symbol"])
    checked = rows.select(
        "run",
        F.coalesce("number", F.raise_error(F.concat(
            F.lit("unsupported element: "), "symbol")).cast("int")).alias("number"),
        F.coalesce("energy_ev", F.raise_error(F.concat(
            F.lit("no energy in "), "run")).cast("double")).alias("energy_ev"))
    return checked.groupBy("number").agg(F.max_by("energy_ev", "run").alias("energy_ev"))


# -- key = value settings --------------------------------------------------

def settings(files: DataFrame) -> DataFrame:
    """(path, key, value) of ``key = value`` lines; ``;`` comments and blanks are skipped.

    The last of several equal keys holds.
    """
    rows = file_lines(files).where(~F.col("line").startswith(";") & (F.trim("line") != ""))
    pair = F.split("line", "=", 2)
    return rows.groupBy("path", F.trim(pair[0]).alias("key")).agg(
        F.max_by(F.trim(F.get(pair, F.lit(1))), "line_no").alias("value"))


def frame_targets(files: DataFrame) -> DataFrame:
    """(path, n_frames, stride): nsteps // stride; both NULL unless nsteps is positive."""
    wide = settings(files).where(F.col("key").isin("nsteps", "nstxout-compressed")).groupBy(
        "path").pivot("key", ["nsteps", "nstxout-compressed"]).agg(F.first("value"))
    rows = files.select("path").join(wide, "path", "left")
    steps = F.coalesce(F.col("nsteps").cast("long"), F.lit(0).cast("long"))
    stride = F.col("`nstxout-compressed`").cast("long")
    ok = steps > 0
    return rows.select("path", F.when(ok, F.floor(F.try_divide(steps, stride))).alias("n_frames"),
                       F.when(ok, stride).alias("stride"))
