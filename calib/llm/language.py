"""Language of texts by fusing several kinds of evidence with Bayes' rule.

* Text: naive Bayes over hashed byte trigrams of the lower-cased words.  Neighbouring
  trigrams overlap, so their summed log-likelihood is divided by three.
* Declared language: the table P(declared | language), estimated from the text
  posteriors by grouped aggregation.
* Address suffix and host: a prior over languages per host, smoothed towards its domain,
  the domain towards its suffix, the suffix towards all rows, and those towards equal
  shares.  The counts are sums of text posteriors, one aggregation per level, and a
  row's own share is taken out of its own prior.

The posterior adds the logs.  A text is rejected when it holds no letters, or when the
best language has a posterior below ``least``.

The text model is fitted on about ``sample`` labelled rows per language, twice as many in
all at most, drawn by hash from those of at most ``longest`` characters, for the LANGUAGES
most frequent languages; all other counts cover all rows.

Defined cases: NULL and empty texts are decided by the other evidence and rejected;
NULL or unknown declared languages give no evidence; rows without host have the prior of
all rows without one; repeated rows count each.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calib.llm.blocks import as_bytes, bounded_batches, list_array, slices
from calib.session import materialize

SLOTS = 1 << 16
SAMPLE, LONGEST = 500, 20_000
LANGUAGES = 256
SEED = 3
OVERLAP = 3.0
LEAST = 0.6
STRENGTH = 10.0      # rows that a level's parent counts for
LEVELS = ("host", "domain", "suffix")


def trigram_slots(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the byte trigrams of the words of each text, and the count per text.

    Words are joined by one space and framed by spaces; ASCII is lower-cased, as are the
    two-byte Latin capitals.
    """
    plain = [b" " + b" ".join(t.lower().split()) + b" " for t in texts]
    sizes = np.array([max(len(p) - 2, 0) for p in plain], np.int64)
    data = np.frombuffer(b"".join(plain), np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.zeros(0, np.int64), sizes * 0
    # Upper-case letters U+00C0-DE follow the byte C3 as 80-9E; lower case is 32 higher.
    capital = (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[:-1] == 0xC3)
    data[1:][capital] += 32
    code = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    whole = np.array([len(p) for p in plain], np.int64)
    starts = np.cumsum(whole) - whole
    edge = np.zeros(len(code) + 3, np.int64)
    edge[starts] += 1
    np.add.at(edge, starts + sizes, -1)
    code = code[np.cumsum(edge[:len(code)]) > 0]
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64), sizes


@dataclass
class TextModel:
    languages: list[str]
    table: np.ndarray  # (SLOTS, languages) log-likelihoods, float32

    def log_likelihood(self, texts: list[bytes]) -> np.ndarray:
        """Per text and language, 0 for texts without trigrams."""
        slots, sizes = trigram_slots(texts)
        out = np.zeros((len(texts), len(self.languages)))
        has = np.flatnonzero(sizes > 0)
        if len(has):
            starts = (np.cumsum(sizes) - sizes)[has]
            for k in range(len(self.languages)):
                out[has, k] = np.add.reduceat(self.table[slots, k].astype(np.float64), starts)
        return out / OVERLAP


def fit(labelled: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> TextModel:
    """A text model from rows (doc_id, text, lang); without any, no text is accepted."""
    known = labelled.where((F.length("text") <= longest) & F.col("lang").isNotNull())
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(
        F.desc("count"), "lang").limit(LANGUAGES).collect()}
    languages = sorted(counts)
    table = np.zeros((SLOTS, len(languages)))
    if languages:
        # Each language keeps about ``sample`` of its rows, by the hash of their ids.
        share = F.create_map(*[x for lang in languages for x in (
            F.lit(lang), F.lit(sample / counts[lang]))])
        draw = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)
        rows = known.where(draw < F.try_element_at(share, F.col("lang"))).select("lang", "text").limit(
            2 * sample * len(languages)).toArrow()
        of_row = np.array([languages.index(x) for x in rows.column("lang").to_pylist()], np.int64)
        slots, sizes = trigram_slots(as_bytes(rows.column("text").combine_chunks())) if len(of_row) else (
            np.zeros(0, np.int64), of_row)
        np.add.at(table, (slots, np.repeat(of_row, sizes)), 1)
    # Smoothed towards the trigrams of all languages, so that rare ones decide little.
    common = (table.sum(1) + 0.5) / (table.sum() + 0.5 * SLOTS)
    table = (table + 50.0 * common[:, None] * 20) / (table.sum(0) + 1000.0)
    return TextModel(languages, np.log(table).astype(np.float32))


def with_likelihood(rows: DataFrame, model: TextModel, *keep: str) -> DataFrame:
    """``keep`` columns of rows (text, ...), the log-likelihoods ``ll``, whether letters occur."""
    bounded_batches(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    source = rows.select(*keep, "text", F.col("text").rlike(r"\p{L}").alias("letters"))
    schema = source.select(*keep, "letters", F.array(F.lit(0.0)).alias("ll")).schema

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ll = shared.value.log_likelihood(as_bytes(batch.column("text")))
            n = np.full(len(ll), ll.shape[1], np.int64)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], batch.column("letters"),
                 list_array(ll.ravel(), n, pa.float64())], [*keep, "letters", "ll"])

    return source.mapInArrow(emit, schema)


def softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    raised = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raised, lambda x: x / total)


def _sums(rows: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """Per group the sum of ``post``, element by element."""
    return rows.groupBy(*keys).agg(F.array(*[
        F.sum(F.get("post", F.lit(k))) for k in range(size)]).alias("mass"))


def _smoothed(own: Column, parent: Column, size: int, strength: float) -> Column:
    """Shares of a level: its own counts and ``strength`` rows of its parent's shares."""
    total = F.aggregate(own, F.lit(0.0), lambda a, x: a + x)
    return F.array(*[
        (F.greatest(F.get(own, F.lit(k)), F.lit(0.0)) + F.get(parent, F.lit(k)) * strength)
        / (F.greatest(total, F.lit(0.0)) + strength) for k in range(size)])


def host_levels(host: Column) -> tuple[Column, Column, Column]:
    """Host, its last two labels, and its last label."""
    labels = F.split(F.lower(host), r"\.")
    return (F.lower(host), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."),
            F.element_at(labels, -1))


def identify(rows: DataFrame, model: TextModel, *keep: str, least: float = LEAST,
             strength: float = STRENGTH) -> DataFrame:
    """``keep`` columns of rows (text, declared, host), lang, posterior and accepted.

    Text and declared language are read once; only likelihoods and keys are shuffled.
    """
    size = len(model.languages)
    if not size:
        return rows.select(*[F.col(f"`{c}`") for c in keep], F.lit(None).cast("string").alias("lang"),
                           F.lit(0.0).alias("posterior"), F.lit(False).alias("accepted"))
    names = F.array(*[F.lit(x) for x in model.languages])
    keys = ["k_host", "k_domain", "k_suffix"]
    inner = [f"__{k}" for k in range(len(keep))]
    rows = rows.select(
        *[F.col(f"`{c}`").alias(n) for c, n in zip(keep, inner)], "text",
        *[c.alias(k) for k, c in zip(keys, host_levels(F.coalesce(F.col("host"), F.lit(""))))],
        F.lower(F.substring_index(F.coalesce("declared", F.lit("")), "-", 1)).alias("k_declared"))
    own = with_likelihood(rows, model, *inner, *keys, "k_declared").withColumn("post", softmax(F.col("ll")))
    own = materialize(own, "likelihoods")
    sums = materialize(_sums(own, [*keys, "k_declared"], size), "sums").withColumnRenamed("mass", "post")
    whole = sums.agg(*[F.sum(F.get("post", F.lit(k))).alias(f"m{k}") for k in range(size)]).first()
    total = np.array([whole[k] or 0.0 for k in range(size)])
    base = (total + 1.0 / size) / (total.sum() + 1.0)
    fused = own
    for k in range(len(keys), 0, -1):
        # A host belongs to one domain and one suffix, so the levels' keys nest.
        group = keys[k - 1:]
        level = _sums(sums, group, size).withColumnsRenamed(
            {"mass": f"mass{k}", **{c: f"{c}_{k}" for c in group}})
        fused = fused.join(level, [F.col(c) == F.col(f"{c}_{k}") for c in group], "left").drop(
            *[f"{c}_{k}" for c in group])
    less = {k: F.array(*[F.get(f"mass{k}", F.lit(j)) - F.get("post", F.lit(j)) for j in range(size)])
            for k in (1, 2, 3)}
    prior = F.array(*[F.lit(float(b)) for b in base])
    for k in (3, 2, 1):
        fused = fused.withColumn(f"prior{k}", _smoothed(less[k], prior, size, strength))
        prior = F.col(f"prior{k}")
    # P(declared | language): a row of counts per declared value, over the language totals.
    said = _sums(sums, ["k_declared"], size).select(
        F.col("k_declared").alias("d"), F.col("mass").alias("said"))
    fused = fused.join(said, F.col("k_declared") == F.col("d"), "left")
    floor = strength / size
    declared = [F.when((F.col("k_declared") == "") | ~F.array_contains(names, F.col("k_declared")), 0.0)
                .otherwise(F.log((F.greatest(F.get("said", F.lit(k)) - F.get("post", F.lit(k)), F.lit(0.0))
                                  + floor) / (float(total[k]) + strength))) for k in range(size)]
    logs = F.array(*[F.get("ll", F.lit(k)) + F.log(F.get("prior1", F.lit(k))) + declared[k]
                     for k in range(size)])
    done = fused.withColumn("__p", softmax(logs)).withColumn("posterior", F.array_max("__p"))
    return done.select(
        *[F.col(n).alias(c) for c, n in zip(keep, inner)],
        F.get(names, F.array_position("__p", F.col("posterior")).cast("int") - 1).alias("lang"),
        "posterior", (F.col("letters") & (F.col("posterior") >= least)).alias("accepted"))


def visible_text(html: Column) -> Column:
    """The text of a page: scripts, styles, comments and tags become spaces."""
    cut = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(cut, r"<[^>]*>", " "), r"&[a-zA-Z0-9#]{1,10};", " ")


def page_evidence(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) as rows (page_id, text, declared, host)."""
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        visible_text(F.coalesce("html", F.lit(""))).alias("text"),
        F.nullif(F.regexp_extract("html", r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-zA-Z-]+)""", 1),
                 F.lit("")).alias("declared"),
        F.nullif(F.regexp_extract("url", r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1),
                 F.lit("")).alias("host"))
