"""The text pipeline: stages over ``documents``, each written as Parquet and read again.

Language identification drops documents without a language, line dedup cuts repeated
lines, the Jaccard join keeps one document of each group of near copies, mixing repeats
and orders documents by the curriculum, and encoding adds piece ids.  All stages but the
last return the columns of ``documents``.  NULL texts count as empty in every stage, and
empty tables pass through.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calib.llm import blocks, curriculum, jaccard, language, line_dedup, pieces
from calib.llm.queries import document_evidence, piece_model
from calib.operators.ordering import local_if_small
from calib.session import drop_tables, materialize, scratch_dir, tables_made

WORDS, PERCENT = 5, 80

#: Scratch tables of the stage before; its result has been written when the next one starts.
_earlier: list[str] = []


def stage(fn):
    """A stage that drops the scratch tables of the stage before it."""

    @functools.wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_tables(spark, _earlier)
        before = set(tables_made())
        out = fn(spark, docs, sf_dir)
        _earlier[:] = [p for p in tables_made() if p not in before]
        return out

    return run_stage


@stage
def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language, ``lang`` set to it.

    A doc_id goes when all its rows are rejected.
    """
    model = language.fit(blocks.keyed_text(docs, "doc_id", "text", "lang"))
    found = language.identify(document_evidence(docs), model, "doc_id")
    best = found.groupBy("doc_id").agg(F.max(F.struct("accepted", "posterior", "lang")).alias("b")).where(
        "b.accepted").select(F.col("doc_id").alias("id"), F.col("b.lang").alias("found"))
    met = docs.join(best, F.col("doc_id").eqNullSafe(F.col("id")))
    return met.withColumn("lang", F.col("found")).select(*docs.columns)


@stage
def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier line repeats."""
    cut = line_dedup.dedup_lines(docs, lines="__lines", dropped="__gone")
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(
        *docs.columns)


@stage
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies, once; rows without doc_id stay."""
    groups = materialize(jaccard.jaccard_groups(docs, WORDS, PERCENT), "groups")
    copies = groups.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(local_if_small(materialize(copies, "copies"), jaccard.NODES_SENT), "doc_id", "left_anti")
    repeated = materialize(groups.where("doc_id IS NOT NULL").groupBy("doc_id").count().where(
        "count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept
    again = Window.partitionBy("doc_id").orderBy("n_chars", "source")
    one = kept.join(repeated, "doc_id", "left_semi").withColumn("__n", F.row_number().over(again)).where(
        "__n = 1").select(*docs.columns)
    return kept.join(repeated, "doc_id", "left_anti").unionByName(one)


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often and in the order that the curriculum takes them."""
    return curriculum.mixed(docs)


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text and the text decoded from them."""
    return pieces.round_trip(docs, piece_model())


STAGES = [
    ("language_id", identify),
    ("line_dedup", cut_lines),
    ("ngram_jaccard", one_of_each_group),
    ("curriculum", mix),
    ("pieces", encode),
]

#: Language models, edit distances and encoders are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, apply) in enumerate(STAGES):
        apply(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if k:
            drop_tables(spark, [f"{folder}/{k - 1}-{STAGES[k - 1][0]}"])
    return docs
