"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

_SCRATCH_KEY = "calib.scratch.dir"
BATCH_BYTES = 16 << 20
_made: list[str] = []


def get_session(master: str | None = None, **conf: str) -> SparkSession:
    """Build a session with the settings the operators are tested under."""
    builder = SparkSession.builder.appName("calib")
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def bounded_batches(spark: SparkSession) -> None:
    """Limit Arrow batches by bytes, so that a batch of long arrays stays small."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or now.startswith("-") or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def scratch_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's shared checkpoint folder.

    A temporary folder is made only in local mode, where every task sees it.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        shared = spark.sparkContext.getCheckpointDir()
    if shared is None:
        shared = spark.conf.get(_SCRATCH_KEY, None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set(_SCRATCH_KEY, shared)
    return f"{shared.rstrip('/')}/calib-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as a table in the scratch folder and read it back.

    The result no longer depends on how ``df`` was computed, so it survives the
    loss of executors and gives the same rows to every later job.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def tables_made() -> list[str]:
    """Paths of the tables that ``materialize`` has written and nothing has dropped."""
    return list(_made)


def drop_tables(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete scratch tables that nothing reads any more."""
    gone = set(paths)
    for path in gone:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _made[:] = [p for p in _made if p not in gone]


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
