"""Ranked lexical search over a length-stratified index.

A document's score for an item sums w * ((1000000000 * tf) div (1000 * tf + 12 * m)) over the
item's terms, where m is the document's normaliser.  All documents of one m form a stratum:
within it the value of a term depends on tf alone.  The index has one row per stratum (a
large stratum has several), with postings in runs of one term and one tf, so the value is
computed once per run; the run of the largest tf gives a term's bound in the stratum.

Documents are range partitioned by m, so a task holds few strata.  For each item it visits
them by falling bound and stops below the item's k-th score.  A first round over one stratum
row in ``PROBE`` gives the k-th scores from which the second round, over all others, starts.

Items are asked in blocks of about ``BLOCK_TERMS`` terms; a block's terms and their weights
are broadcast, and each block reads the documents once.

Defined cases: NULL and empty texts have no terms; documents without terms do not count;
rows that repeat a doc_id are documents of their own, as are rows without doc_id, which come
last among equal scores; the texts of rows that share an item_id (or have none) are read as
one item; an item without terms, or whose terms no document holds, has no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calib.llm.blocks import as_bytes, keyed_text, list_array, ranges, slices
from calib.llm.chunks import NOT_ALNUM, chunks, folded
from calib.session import materialize

BLOCK_TERMS = 400_000
STRATUM_ROWS = 4096
SHARD_ROWS = 32_768
PROBE = 16
SCALE = 1_000_000_000
#: Sums of doubles are exact up to here.
EXACT = 1 << 53
LAST = np.iinfo(np.int64).max
FOLDED = folded(NOT_ALNUM)
INDEX = ("m long, doc array<long>, known array<boolean>, term array<int>, tf array<long>, "
         "start array<int>, place array<int>")


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of bounded size."""
    for piece in chunks(text, NOT_ALNUM):
        yield piece.translate(FOLDED).split()


# -- items -------------------------------------------------------------------

def item_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """(item, term, times) of all items."""
    rows = items.select(F.col(f"`{item}`").alias("item"),
                        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["item"].dataType.simpleString()

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            place, term, times = [], [], []
            for i, raw in enumerate(as_bytes(batch.column("text"))):
                counts = Counter(t for part in terms_of(raw) for t in part)
                place.extend([i] * len(counts))
                term.extend(t.decode() for t in counts)
                times.extend(counts.values())
            yield pa.RecordBatch.from_arrays(
                [batch.column("item").take(pa.array(place, pa.int64())), pa.array(term, pa.string()),
                 pa.array(times, pa.int64())], ["item", "term", "times"])

    found = rows.mapInArrow(emit, f"item {kind}, term string, times long")
    return found.groupBy("item", "term").agg(F.sum("times").alias("times"))


class Asked:
    """A block of items: its terms, and each item's terms with repeats."""

    def __init__(self, table: pa.Table) -> None:
        column = table.column("item").combine_chunks()
        ids = column.dictionary_encode(null_encoding="encode")
        self.items = ids.dictionary
        codes = ids.indices.to_numpy(zero_copy_only=False)
        names = table.column("term").combine_chunks().dictionary_encode()
        order = np.argsort(codes, kind="stable")
        self.vocabulary = {t.encode(): k for k, t in enumerate(names.dictionary.to_pylist())}
        self.terms = names.indices.to_numpy(zero_copy_only=False)[order]
        self.times = table.column("times").to_numpy()[order]
        self.edges = np.searchsorted(codes[order], np.arange(len(self.items) + 1))


# -- documents ---------------------------------------------------------------

def counted_terms(docs: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """(doc_id, n, term, tf): all terms of a text, and those of the vocabulary with their counts."""

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = vocabulary.value.get
        for batch in slices(batches):
            n = np.zeros(batch.num_rows, np.int64)
            held = np.zeros(batch.num_rows, np.int64)
            term, tf = [], []
            for i, raw in enumerate(as_bytes(batch.column("text"))):
                counts: Counter = Counter()
                for part in terms_of(raw):
                    n[i] += len(part)
                    counts.update(map(look, part))
                counts.pop(None, None)
                held[i] = len(counts)
                term.extend(counts.keys())
                tf.extend(counts.values())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), list_array(np.array(term, np.int32), held, pa.int32()),
                 list_array(np.array(tf, np.int64), held, pa.int64())], ["doc_id", "n", "term", "tf"])

    return docs.mapInArrow(emit, "doc_id long, n long, term array<int>, tf array<long>")


def stratified(rows: DataFrame, shards: int) -> DataFrame:
    """The index: strata of the rows (doc_id, m, term, tf), as described by ``INDEX``."""

    def stratum(m: int, ids: pa.Array, counts: np.ndarray, term: np.ndarray, tf: np.ndarray) -> list:
        place = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        order = np.lexsort((place, tf, term))
        place, term, tf = place[order], term[order], tf[order]
        new = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (tf[1:] != tf[:-1])]))
        return [m, ids.fill_null(LAST).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False),
                term[new], tf[new], np.concatenate([new, [len(term)]]), place]

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # no more than STRATUM_ROWS rows each, by m
            if not batch.num_rows:
                continue
            m = batch.column("m").to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1], [True]]))
            for a, b in zip(edges[:-1], edges[1:]):
                part = batch.slice(a, b - a)
                row = stratum(m[a], part.column("doc_id"), part.column("term").value_lengths().to_numpy(),
                              part.column("term").flatten().to_numpy(), part.column("tf").flatten().to_numpy())
                kinds = (pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row[0]], pa.int64())] + [
                        pa.ListArray.from_arrays([0, len(v)], pa.array(v, k)) for v, k in zip(row[1:], kinds)],
                    ["m", "doc", "known", "term", "tf", "start", "place"])

    dealt = rows.withColumn("__h", F.xxhash64("doc_id", "n", "term")).repartitionByRange(
        shards, "m", "__h").sortWithinPartitions("m")
    return dealt.select("doc_id", "m", "term", "tf").mapInArrow(emit, INDEX)


# -- search ------------------------------------------------------------------

class Best:
    """The k best (score, doc) of one item met so far."""

    def __init__(self, k: int, floor: int) -> None:
        self.k, self.floor = k, floor
        self.score, self.doc, self.known = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, score: np.ndarray, doc: np.ndarray, known: np.ndarray) -> None:
        stay = score >= self.floor
        score = np.concatenate([self.score, score[stay]])
        doc = np.concatenate([self.doc, doc[stay]])
        known = np.concatenate([self.known, known[stay]])
        order = np.lexsort((doc, ~known, -score))[:self.k]
        self.score, self.doc, self.known = score[order], doc[order], known[order]
        if len(order) == self.k:
            self.floor = max(self.floor, int(self.score[-1]))


class Stratum:
    """One index row with its impacts."""

    def __init__(self, batch: pa.RecordBatch, i: int, weights: np.ndarray) -> None:
        col = lambda c: batch.column(c)[i].values
        m = batch.column("m")[i].as_py()
        self.doc = col("doc").to_numpy()
        self.known = col("known").to_numpy(zero_copy_only=False)
        term, tf = col("term").to_numpy(), col("tf").to_numpy()
        self.start, self.place = col("start").to_numpy(), col("place").to_numpy()
        self.impact = weights[term] * ((SCALE * tf) // (1000 * tf + 12 * m))
        self.first = np.searchsorted(term, np.arange(len(weights) + 1))
        # Runs of one term rise in tf, so the last one bounds the term.
        self.top = np.zeros(len(weights), np.int64)
        held = np.flatnonzero(self.first[1:] > self.first[:-1])
        self.top[held] = self.impact[self.first[held + 1] - 1]

    def scores(self, terms: np.ndarray, times: np.ndarray) -> np.ndarray:
        runs_of = self.first[terms + 1] - self.first[terms]
        runs = np.repeat(self.first[terms], runs_of) + ranges(runs_of)
        value = np.repeat(times, runs_of) * self.impact[runs]
        size = self.start[runs + 1] - self.start[runs]
        place = self.place[np.repeat(self.start[runs], size) + ranges(size)]
        value = np.repeat(value, size)
        if int(times.sum()) * int(self.top.max(initial=0)) < EXACT:
            return np.bincount(place, value, len(self.doc)).astype(np.int64)
        out = np.zeros(len(self.doc), np.int64)
        np.add.at(out, place, value)
        return out


def visited(index: DataFrame, asked: Broadcast, weights: Broadcast, floors: dict[int, int], k: int) -> DataFrame:
    """(item place, doc_id, score): each task's best rows of the index, at or above the floors."""

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, w = asked.value, weights.value
        best = [Best(k, floors.get(i, 1)) for i in range(len(block.items))]
        for batch in batches:
            strata = [Stratum(batch, i, w) for i in range(batch.num_rows)]
            if not strata:
                continue
            bounds = np.stack([np.add.reduceat(block.times * s.top[block.terms], block.edges[:-1])
                               for s in strata])
            for i, found in enumerate(best):
                mine = slice(block.edges[i], block.edges[i + 1])
                for s in np.argsort(-bounds[:, i], kind="stable"):
                    if bounds[s, i] < found.floor:
                        break
                    scores = strata[s].scores(block.terms[mine], block.times[mine])
                    hit = np.flatnonzero(scores >= found.floor)
                    found.add(scores[hit], strata[s].doc[hit], strata[s].known[hit])
        places = np.repeat(np.arange(len(best)), [len(b.score) for b in best])
        if len(places):
            ids = pa.array(np.concatenate([b.doc for b in best]), mask=~np.concatenate([b.known for b in best]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(places), ids, pa.array(np.concatenate([b.score for b in best]))],
                ["place", "doc_id", "score"])

    return index.mapInArrow(emit, "place long, doc_id long, score long")


def _ranked(found: DataFrame, key: str, k: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(docs: DataFrame, table: pa.Table, k: int, item_type: str) -> DataFrame:
    spark = docs.sparkSession
    sc = spark.sparkContext
    asked = Asked(table)
    counted = materialize(counted_terms(docs, sc.broadcast(asked.vocabulary)).where("n > 0"), "counted")
    total = counted.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    df = counted.select(F.explode("term").alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).alias("df")).toArrow()  # one row per term of the block
    weights = np.zeros(len(asked.vocabulary), np.int64)
    for term, count in zip(df.column("term").to_pylist(), df.column("df").to_pylist()):
        weights[term] = math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * count + 1)))
    m = F.expr(f"75L + (25L * n * {total['docs']}L) div {max(total['terms'], 1)}L")
    rows = counted.where("size(term) > 0").withColumn("m", m)
    index = materialize(stratified(rows, max(1, -(-total["docs"] // SHARD_ROWS))).withColumn(
        "probe", F.pmod(F.xxhash64("m", "doc"), F.lit(PROBE)) == 0), "index")
    sent, values = sc.broadcast(asked), sc.broadcast(weights)
    first = materialize(visited(index.where("probe").drop("probe"), sent, values, {}, k), "probed")
    kth = _ranked(first, "place", k).where(F.col("rank") == k).select("place", "score").toArrow()
    floors = dict(zip(kth.column("place").to_pylist(), kth.column("score").to_pylist()))
    rest = visited(index.where("NOT probe").drop("probe"), sent, values, floors, k)
    best = _ranked(first.unionByName(rest), "place", k)

    def named(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value.items
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [items.take(batch.column("place")), *[batch.column(c) for c in ("rank", "doc_id", "score")]],
                ["item_id", "rank", "doc_id", "score"])

    return best.select("place", "rank", "doc_id", "score").mapInArrow(
        named, f"item_id {item_type}, rank int, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text",
                  item: str = "item_id", item_text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item."""
    spark = docs.sparkSession
    docs = keyed_text(docs, key, text)
    terms = materialize(item_terms(items, item, item_text), "items")
    kind = terms.schema["item"].dataType.simpleString()
    blocks = max(1, -(-terms.count() // block_terms))
    dealt = F.pmod(F.xxhash64("item"), F.lit(blocks))
    now = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    out: DataFrame | None = None
    if int(now) > STRATUM_ROWS or int(now) <= 0:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(STRATUM_ROWS))
    for b in range(blocks):
        table = terms.where(dealt == b).toArrow()
        if not table.num_rows:
            continue
        found = _search_block(docs, table, k, kind)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return out
