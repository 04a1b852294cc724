"""Queries of the text operators, one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calib.llm import (
    balltree, bitslice, blocks, collision, curriculum, divergence, jaccard, language, line_dedup, pieces,
    ppm, secrets, strata, toxicity, twins,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
POSITION_DIGITS = 6
SQL: dict[str, str] = {
    "op7_secrets": twins.secrets_sql(), "op8_ball_tree": twins.BALL_TREE,
    "op9_ngram_jaccard": twins.JACCARD, "op10_curriculum": twins.curriculum_sql(POSITION_DIGITS),
    "op12_strata_search": twins.STRATA, "op13_source_divergence": twins.DIVERGENCE,
}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> str:
    """The public model file; pass another path to the operator for another vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query
def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = blocks.keyed_text(table(spark, sf_dir, "documents"))
    coded = pieces.round_trip(docs, piece_model())
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(table(spark, sf_dir, "documents"), width=4, percent=85)


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select(
        "doc_id", F.col("n_lines").cast("long").alias("n_lines"),
        F.col("n_dropped").cast("long").alias("n_dropped"), F.sha2("text", 256).alias("text_sha256"))


@query
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = (*secrets.BASE, *secrets.MORE)
    found = secrets.secret_spans(table(spark, sf_dir, "documents"), rules)
    counts = [secrets.count_of("spans", k).alias(f"n_{r.kind}") for k, r in enumerate(secrets.BASE)]
    base = F.filter("spans", lambda s: s["kind"] < len(secrets.BASE))
    return found.select("doc_id", *counts, F.sha2(secrets.spelled(base, rules), 256).alias("base_sha256"),
                        secrets.spelled(F.col("spans"), rules).alias("spans"))


@query
def op10_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = curriculum.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", F.transform(
        "positions", lambda p: F.round(p, POSITION_DIGITS)).alias("positions"))


@query
def op6_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = blocks.keyed_text(table(spark, sf_dir, "documents")).withColumn(
        "held_out", blocks.bucket("doc_id", 7) == 2)
    trained = ppm.train(docs.where("NOT held_out"))
    return ppm.log_scores(docs, trained, "doc_id", "held_out").withColumn(
        "train_tokens", F.lit(trained.n).cast("long"))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = blocks.keyed_text(table(spark, sf_dir, "documents"))
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").alias("label")).where(
        "label IS NOT NULL")
    net = toxicity.fit(docs.where(blocks.bucket("doc_id", 5) != 0), labels)
    scored = toxicity.toxicity_scores(docs, net)
    return scored.select(
        "doc_id", (blocks.bucket("doc_id", 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op3_collision_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return collision.nearest_neighbours(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


@query
def op8_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return balltree.top_products(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def document_evidence(docs: DataFrame) -> DataFrame:
    """Documents as language evidence: ``lang`` is declared, the source is the host."""
    return docs.withColumns({
        "text": F.coalesce(F.col("text").cast("string"), F.lit("")),
        "declared": F.col("lang").cast("string"), "host": F.col("source").cast("string")})


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages; a row has a doc_id or a page_id."""
    docs = table(spark, sf_dir, "documents")
    model = language.fit(blocks.keyed_text(docs, "doc_id", "text", "lang"))
    of_docs = language.identify(document_evidence(docs), model, "doc_id", "declared")
    of_pages = language.identify(
        language.page_evidence(table(spark, sf_dir, "pages")), model, "page_id", "declared")
    return of_docs.unionByName(of_pages, allowMissingColumns=True)


@query
def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitslice.simhash_groups(table(spark, sf_dir, "documents"), radius=2)


@query
def op12_strata_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strata.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


@query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"), least=10, top=10)
