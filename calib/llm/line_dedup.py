"""Lines repeated across documents, exactly or within one edited word; the earliest stays.

Deletion-neighbourhood join: a line emits itself and every variant with one word deleted
as hashed keys.  Two lines are within one edit when they lack the same word position and
are equal otherwise (a word replaced), or when one equals a variant of the other (a word
inserted).  Lines that share a key this way are joined, the variants' words are compared
themselves, and a line with an earlier partner is dropped.  The edit unit is the word, so
any change inside one word is one edit.

Equal lines (the same words) are one class before anything is joined, so a line found in
a third of all documents is one row.  A class meets its partners through the smallest
line of each key, computed by aggregation, never through all pairs of a key.  Variants
are emitted only for classes that can have a partner: an edit leaves the first or the
last half of the words as they are, so a class whose halves occur nowhere else has none.

Defined cases: a line ends at a newline; lines without words are kept and never compared;
lines of fewer than ``min_words`` words (both of a pair) have only exact duplicates; NULL
texts stay NULL and count as empty; a line is known by doc_id and place, so repeated rows
of a document lose the same lines; rows without doc_id come first in order; other columns
are kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calib.llm.blocks import as_bytes, keyed_text, list_array, slices
from calib.operators.ordering import number_rows
from calib.session import materialize

MIN_WORDS = 5
WHOLE = -1
_PLACE = "doc_id long, line int, hi long, lo long"


def _class_of(words: list[bytes]) -> tuple[int, int]:
    digest = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words)), np.int64)
    return int(digest[0]), int(digest[1])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _halves(words: list[bytes]) -> list[int]:
    """Keys of the halves that an edit may leave: of this length and of one word less."""
    keys = []
    n = len(words)
    for h in {n // 2, (n - 1) // 2}:
        keys.append(_signed(xxhash.xxh3_64_intdigest(b" ".join(words[:h]), seed=2 * h)))
        keys.append(_signed(xxhash.xxh3_64_intdigest(b" ".join(words[n - h:]), seed=2 * h + 1)))
    return keys


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """One row per line with words: its place, its class, and the keys of its halves."""

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, line, marks, keys, lengths = [], [], [], [], []
            for row, text in enumerate(as_bytes(batch.column("text"))):
                for at, raw in enumerate(text.split(b"\n")):
                    words = raw.split()
                    if not words:
                        continue
                    own = _halves(words) if len(words) >= min_words - 1 else []
                    rows.append(row)
                    line.append(at)
                    marks.append(xxhash.xxh3_128_digest(b" ".join(words)))
                    keys.extend(own)
                    lengths.append(len(own))
            pairs = np.frombuffer(b"".join(marks), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(line, pa.int32()),
                 pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()),
                 list_array(np.array(keys, np.int64), np.array(lengths, np.int64), pa.int64())],
                ["doc_id", "line", "hi", "lo", "halves"])

    return docs.mapInArrow(emit, f"{_PLACE}, halves array<long>")


def _variants(docs: DataFrame, wanted: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, line, hi, lo, words, whole, dels) of the wanted lines (doc_id, line, hi, lo)."""
    asked = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("line", "hi", "lo")).alias("asked"))
    left, right = docs.alias("d"), asked.alias("w")
    source = left.join(right, F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))).select(
        "d.doc_id", "d.text", "w.asked")

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, line, hi, lo, words_of, whole, dels = [], [], [], [], [], [], []
            asked_of = batch.column("asked").to_pylist()
            doc_ids = batch.column("doc_id").to_pylist()
            for doc, text, asked in zip(doc_ids, as_bytes(batch.column("text")), asked_of):
                lines = text.split(b"\n")
                for a in asked:
                    if a["line"] >= len(lines):
                        continue
                    words = lines[a["line"]].split()
                    if _class_of(words) != (a["hi"], a["lo"]):
                        continue  # another text under the same doc_id
                    ids.append(doc)
                    line.append(a["line"])
                    hi.append(a["hi"])
                    lo.append(a["lo"])
                    words_of.append([w.decode() for w in words])
                    whole.append(_signed(xxhash.xxh3_64_intdigest(b" ".join(words))))
                    dels.append(_deletions(words) if len(words) >= min_words else [])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(line, pa.int32()), pa.array(hi, pa.int64()),
                 pa.array(lo, pa.int64()), pa.array(words_of, pa.list_(pa.string())),
                 pa.array(whole, pa.int64()), pa.array(dels, pa.list_(pa.int64()))],
                ["doc_id", "line", "hi", "lo", "words", "whole", "dels"])

    return source.mapInArrow(
        emit, f"{_PLACE}, words array<string>, whole long, dels array<long>")


def _deletions(words: list[bytes]) -> list[int]:
    text = b" ".join(words)
    keys = []
    at = 0
    last = len(words) - 1
    for k, word in enumerate(words):
        end = at + len(word)
        rest = text[:at] + text[end + 1:] if k < last else text[:max(at - 1, 0)]
        keys.append(_signed(xxhash.xxh3_64_intdigest(rest)))
        at = end + 1
    return keys


def _without(words: str, place: str) -> Column:
    """The words of a variant; ``place`` -1 is the whole line."""
    w, at = F.col(words), F.col(place)
    return F.when(at == WHOLE, w).otherwise(
        F.concat(F.slice(w, F.lit(1), F.greatest(at, F.lit(0))),
                 F.slice(w, F.greatest(at + 2, F.lit(1)), F.size(w))))


def _dropped(table: DataFrame) -> DataFrame:
    """``rank`` of the lines with an earlier line within one edit.

    ``table`` holds (rank, words, whole, dels); a smaller rank is earlier.
    """
    variants = table.select(F.col("whole").alias("key"), F.lit(WHOLE).alias("place"), "rank").unionByName(
        table.select(F.posexplode("dels").alias("place", "key"), "rank"))
    joint = variants.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    variants = materialize(variants.join(joint, "key", "left_semi"), "variants")
    firsts = materialize(variants.groupBy("key", "place").agg(F.min("rank").alias("rank")), "firsts")
    is_whole = F.col("place") == WHOLE
    other = [F.col("rank").alias("other"), F.col("place").alias("place2")]
    whole = firsts.where(is_whole).select("key", *other)
    same = firsts.where(~is_whole).select("key", "place", *other)
    cut = firsts.where(~is_whole).groupBy("key").agg(F.min(F.struct("rank", "place")).alias("c")).select(
        "key", F.col("c.rank").alias("other"), F.col("c.place").alias("place2"))
    names = ["rank", "place", "other", "place2"]
    pairs = variants.where(~is_whole).join(same, ["key", "place"]).select(*names).unionByName(
        variants.where(~is_whole).join(whole, "key").select(*names)).unionByName(
        variants.where(is_whole).join(cut, "key").select(*names)).where("other < rank")
    for end in ("rank", "other"):
        pairs = pairs.join(table.select(
            F.col("rank").alias(end), F.col("words").alias(f"words_{end}")), end)
    same_words = _without("words_rank", "place") == _without("words_other", "place2")
    return pairs.where(same_words).select("rank").distinct()


def kept_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, kept): places of the lines with words that stay, for documents (doc_id, text)."""
    lines = _lines(docs, min_words)
    classes = materialize(lines.groupBy("hi", "lo").agg(
        F.min(F.struct("doc_id", "line", "halves")).alias("f")).select("hi", "lo", "f.*"), "classes")
    halves = classes.select(F.explode("halves").alias("half"), "lo")
    shared = halves.groupBy("half").agg(F.min("lo").alias("a"), F.max("lo").alias("b")).where(
        "a <> b").select("half")
    able = halves.join(shared, "half", "left_semi").select("lo").distinct()
    wanted = classes.select("doc_id", "line", "hi", "lo").join(able, "lo", "left_semi")
    table = materialize(_variants(docs, wanted, min_words).dropDuplicates(["hi", "lo"]), "table")
    ranked = number_rows(table.select("doc_id", "line", "hi", "lo"), [], ["doc_id", "line", "hi", "lo"],
                         "rank", window_rows=0)
    table = materialize(table.join(ranked.select("hi", "lo", "rank"), ["hi", "lo"]), "ranked")
    gone = table.join(_dropped(table.select("rank", "words", "whole", "dels")), "rank", "left_semi")
    return classes.select("doc_id", "line", "hi", "lo").join(
        gone.select("hi", "lo"), ["hi", "lo"], "left_anti").groupBy("doc_id").agg(
        F.collect_list("line").alias("kept"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text",
                min_words: int = MIN_WORDS, lines: str = "n_lines", dropped: str = "n_dropped"
                ) -> DataFrame:
    """``docs`` with the repeated lines cut from ``text``, and the counts of lines."""
    kept = kept_lines(keyed_text(docs, key, text), min_words)
    columns = [c for c in docs.columns if c not in (lines, dropped)]
    inner = [f"__{k}" for k in range(len(columns))]
    place = columns.index(text)
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(columns, inner)],
                       F.col(f"`{key}`").cast("long").alias("__key"))
    joined = rows.alias("d").join(
        kept.alias("k"), F.col("d.__key").eqNullSafe(F.col("k.doc_id")), "left").select(
        *[f"d.{n}" for n in inner],
        F.coalesce(F.col(f"d.{inner[place]}").cast("string"), F.lit("")).alias("__text"), "k.kept")
    schema = docs.select(*[
        (F.col(f"`{c}`").cast("string") if c == text else F.col(f"`{c}`")).alias(n)
        for c, n in zip(columns, inner)], F.lit(0).alias("__lines"), F.lit(0).alias("__gone")).schema

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            nulls = batch.column(place).is_null().to_pylist()
            texts, total, gone = [], [], []
            for raw, places, null in zip(as_bytes(batch.column("__text")),
                                         batch.column("kept").to_pylist(), nulls):
                stay = set(places or ())
                rows = raw.split(b"\n")
                left = [r for k, r in enumerate(rows) if k in stay or not r.split()]
                texts.append(None if null else b"\n".join(left).decode())
                total.append(0 if null else len(rows))
                gone.append(len(rows) - len(left))
            cols = [batch.column(n) for n in inner]
            cols[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(total, pa.int32()), pa.array(gone, pa.int32())],
                [*inner, "__lines", "__gone"])

    return joined.mapInArrow(cut, schema).toDF(*columns, lines, dropped)
