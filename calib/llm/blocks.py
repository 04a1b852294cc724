"""Shared pieces of the text operators: words, bounded slices of Arrow batches, hashes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20
BATCH_BYTES = 16 << 20
#: Words end at the bytes 09-0D and 20; ``bytes.split()`` cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"

MIX_1 = np.uint64(0x9E3779B97F4A7C15)
MIX_2 = np.uint64(0xBF58476D1CE4E5B9)
MIX_3 = np.uint64(0x94D049BB133111EB)


def bounded_batches(spark: SparkSession) -> None:
    """Limit Arrow batches by bytes, so that a batch of very long texts stays small."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or now.startswith("-") or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def keyed_text(docs: DataFrame, key: str = "doc_id", text: str = "text", *more: str) -> DataFrame:
    """The columns an operator needs, under its own names; NULL texts become empty."""
    bounded_batches(docs.sparkSession)
    return docs.select(
        F.col(f"`{key}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
        *[F.col(f"`{c}`") for c in more])


def bucket(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``: a stable deal of rows into folds."""
    return F.crc32(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))) % parts


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES
           ) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each slice have about ``limit`` bytes, or are one text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def as_bytes(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


class WordHash(dict):
    """Word to 64-bit hash, with a bounded memory of recent words."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def word_hashes(texts: Sequence[bytes], known: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words, one text after another, and each text's word count."""
    counts = np.zeros(len(texts), np.int64)
    parts = []
    for i, text in enumerate(texts):
        words = text.lower().split()
        counts[i] = len(words)
        parts.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), counts


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that their order looks random."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * MIX_2
        x = (x ^ (x >> np.uint64(27))) * MIX_3
        return x ^ (x >> np.uint64(31))


def ranges(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each length, one after another."""
    total = int(lengths.sum())
    starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
    return np.arange(total) - starts


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
