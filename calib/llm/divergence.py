"""How far the sources of each language differ in their words.

Duplicate texts are collapsed first: identical texts of a language are one row with a list of
(source, copies), split into terms once for all copies, and its counts and document frequencies
are added with those multiplicities.  Every language keeps the terms of ``least`` documents or
more.  A group is a (lang, source); its share of a term is p = 1 + floor(10^9 (count + 2) /
(N + 2 V)), and two shares differ by floor((p - q)^2 / (p + q)).

Two bitmaps of fixed size spare shuffles and decide nothing.  The first marks the hashes of
texts that occur twice or more: a text it does not hold has no copy and is read where it is;
the others are shuffled and collapsed.  The second marks the hashes of terms whose documents,
counted by hash, are ``least`` or more: other terms are kept nowhere and not counted by source.
Where a bitmap fills up, more rows are shuffled, and the result is the same.

Pairs of sources are evaluated sparsely.  Terms that neither source has differ by one value
per pair, so a task only visits the terms that one of them has: sources are dealt to blocks of
about ``SIDE``, terms to parts of about ``PART``, and a task takes two blocks and one part.  All
numbers are whole numbers.

Defined cases: NULL text, lang and source are ''; texts without terms count for their group
only; a language that keeps no term has pairs of value 0 and no term rows; rows that repeat
an id are documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calib.llm.blocks import as_bytes, bounded_batches, slices
from calib.llm.chunks import NOT_ALPHA, chunks, folded
from calib.operators.ordering import number_rows
from calib.session import materialize

LEAST = 10
TOP_TERMS = 10
UNIT = 1_000_000_000
#: Sources listed with one copy of a text, sources of a block, terms of a part.
LISTED = 4096
SIDE = 64
PART = 4096
#: Entries gathered before they are added up, and sums held before they are sent.
GATHERED = 1 << 20
HELD = 1 << 20
#: Bits of the two bitmaps, 8 MB each.
FILTER_BITS = 1 << 26
RANGE = 1 << 16
FOLDED = folded(NOT_ALPHA)
READ = ["lang", "text", "sources", "bit"]


# -- bitmaps -----------------------------------------------------------------

def bitmap(bits: DataFrame) -> np.ndarray:
    """The set bits (``bit``, below FILTER_BITS) as words of 64; at most FILTER_BITS / 64 rows are fetched."""
    words = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def is_set(words: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return (words[bits >> 6] >> (bits & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


# -- texts -------------------------------------------------------------------

def marked(docs: DataFrame) -> DataFrame:
    """(lang, source, text, mark, bit): a 128-bit hash of each text, and its bit with the language."""
    return docs.withColumn("mark", F.unhex(F.md5("text"))).withColumn(
        "bit", F.pmod(F.xxhash64("lang", "mark"), F.lit(FILTER_BITS)).cast("long"))


def collapsed(docs: DataFrame, listed: int = LISTED) -> tuple[DataFrame, Broadcast]:
    """(lang, text, sources, bit) of all texts, and the bitmap of repeated ones.

    A row with a bit is a text where it lies: it counts only if the bitmap does not hold it.
    A row without is a distinct text with its (source, copies); copies are added up before
    texts move, so a text with very many copies is sent at most once by each task.  A text of
    more than about ``listed`` sources has several rows.
    """
    rows = marked(docs)
    copies = materialize(rows.groupBy("lang", "mark", "bit", "source").agg(
        F.count(F.lit(1)).alias("copies")), "copies")
    repeated = bitmap(copies.groupBy("lang", "mark", "bit").agg(F.sum("copies").alias("n")).where(
        "n > 1").select("bit"))
    held = docs.sparkSession.sparkContext.broadcast(repeated)

    def again(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(is_set(held.value, batch.column("bit").to_numpy())))

    schema = "lang string, mark binary, text string, bit long"
    texts = rows.select("lang", "mark", "text", "bit").mapInArrow(again, schema).groupBy(
        "lang", "mark").agg(F.first("text").alias("text"))
    most = copies.groupBy("lang").agg(F.approx_count_distinct("source").alias("n")).agg(F.max("n")).first()[0]
    lists = copies.select("lang", "mark", "bit", "source", "copies").mapInArrow(
        again, "lang string, mark binary, bit long, source string, copies long").groupBy(
        "lang", "mark", F.pmod(F.xxhash64("source"), F.lit(-(-(most or 1) // listed))).alias("part")).agg(
        F.collect_list(F.struct("source", "copies")).alias("sources"))
    distinct = materialize(texts.join(lists, ["lang", "mark"]).select(
        "lang", "text", "sources", F.lit(None).cast("long").alias("bit")), "distinct")
    one = F.array(F.struct("source", F.lit(1).cast("long").alias("copies")))
    return rows.select("lang", "text", one.alias("sources"), "bit").unionByName(distinct), held


def read_once(batches: Iterable[pa.RecordBatch], held: Broadcast) -> Iterator[tuple[str, bytes, list[dict]]]:
    """(lang, text, sources) of the rows of ``collapsed`` that count."""
    for batch in slices(batches):
        bits = batch.column("bit")
        lies = bits.is_valid().to_numpy(zero_copy_only=False)
        counts = ~lies | ~is_set(held.value, bits.fill_null(0).to_numpy())
        batch = batch.filter(pa.array(counts))
        yield from zip(batch.column("lang").to_pylist(), as_bytes(batch.column("text")),
                       batch.column("sources").to_pylist())


class Codes(dict):
    """Term to code; a new term gets the next one, and its place in ``terms``."""

    def __init__(self) -> None:
        self.terms: list[bytes] = []

    def __missing__(self, term: bytes) -> int:
        code = self[term] = len(self.terms)
        self.terms.append(term)
        return code


def term_codes(text: bytes, code: Codes) -> np.ndarray:
    """The code of every term of a text."""
    ids = [np.fromiter(map(code.__getitem__, piece.translate(FOLDED).split()), np.int64)
           for piece in chunks(text, NOT_ALPHA)]
    return np.concatenate(ids) if ids else np.zeros(0, np.int64)


def term_bits(lang: str, terms: Iterable[bytes], size: int) -> np.ndarray:
    """The bit of each term of a language, in a bitmap of ``size`` bits."""
    seed = xxhash.xxh32_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(t, seed) % size for t in terms), np.int64)


def frequent_terms(texts: DataFrame, held: Broadcast, least: int) -> np.ndarray:
    """The bitmap of the terms that may have ``least`` documents, by hash with the language.

    A task sends its counts, no higher than ``least``, as three bytes each.
    """
    top, size, width = min(least, 255), FILTER_BITS, RANGE

    def packed(counts: dict[str, list[np.ndarray]], codes: dict[str, Codes]) -> Iterator[pa.RecordBatch]:
        bits, docs = [], []
        for lang, parts in counts.items():
            code, times = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            bits.append(term_bits(lang, codes[lang].terms, size)[code])
            docs.append(np.minimum(np.bincount(times, np.concatenate([p[1] for p in parts])), top))
        if not bits:
            return
        bit, at = np.unique(np.concatenate(bits), return_inverse=True)
        docs = np.minimum(np.bincount(at, np.concatenate(docs)), top).astype(np.uint8)
        edges = np.searchsorted(bit, np.arange(0, size + width, width))
        used = np.flatnonzero(edges[1:] > edges[:-1])
        place = (bit % width).astype("<u2")
        yield pa.RecordBatch.from_arrays([
            pa.array(used.astype(np.int32)),
            pa.array([place[edges[r]:edges[r + 1]].tobytes() for r in used], pa.binary()),
            pa.array([docs[edges[r]:edges[r + 1]].tobytes() for r in used], pa.binary())], ["range", "place", "docs"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[np.ndarray]] = {}
        codes: dict[str, Codes] = {}
        gathered = 0
        for lang, text, sources in read_once(batches, held):
            code = codes.setdefault(lang, Codes())
            term = np.unique(term_codes(text, code))
            if not len(term):
                continue
            copies = min(sum(s["copies"] for s in sources), top)
            counts.setdefault(lang, []).append((term, np.full(len(term), copies)))
            gathered += len(term)
            if gathered > 2 * GATHERED:
                yield from packed(counts, codes)
                counts, codes, gathered = {}, {}, 0
        yield from packed(counts, codes)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(width, np.int64)

        def found() -> pa.RecordBatch:
            bits = np.flatnonzero(total >= top) + now * width
            return pa.RecordBatch.from_arrays([pa.array(bits.astype(np.int64))], ["bit"])

        for batch in batches:
            for r, place, docs in zip(*[batch.column(c).to_pylist() for c in ("range", "place", "docs")]):
                if r != now:
                    if now is not None:
                        yield found()
                    now, total = r, np.zeros(width, np.int64)
                total[np.frombuffer(place, "<u2")] += np.frombuffer(docs, np.uint8)
        if now is not None:
            yield found()

    parts = texts.select(*READ).mapInArrow(count, "range int, place binary, docs binary")
    return bitmap(parts.repartition("range").sortWithinPartitions("range").mapInArrow(add, "bit long"))


# -- counts ------------------------------------------------------------------

class Sums:
    """Counts and document frequencies by (group, term), added up in sorted arrays."""

    def __init__(self, wanted: np.ndarray) -> None:
        self.wanted = wanted
        self.groups: dict[tuple[str, str], int] = {}
        self.codes: dict[str, Codes] = {}
        self.keep: dict[str, tuple[int, np.ndarray]] = {}
        self.keys, self.counts, self.docs = (np.zeros(0, np.int64) for _ in range(3))
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.gathered = self.known = 0

    def wanted_terms(self, lang: str, code: Codes) -> np.ndarray:
        """Which codes of a language may be kept terms; the array grows by doubling."""
        known, keep = self.keep.get(lang, (0, np.zeros(1024, bool)))
        now = len(code.terms)
        if now > known:
            if now > len(keep):
                keep = np.concatenate([keep, np.zeros(max(now, len(keep)), bool)])
            keep[known:now] = is_set(self.wanted, term_bits(lang, code.terms[known:now], 64 * len(self.wanted)))
            self.keep[lang] = now, keep
        return keep

    def add(self, lang: str, text: bytes, sources: list[dict]) -> None:
        code = self.codes.setdefault(lang, Codes())
        before = len(code)
        term = term_codes(text, code)
        self.known += len(code) - before
        term, times = np.unique(term[self.wanted_terms(lang, code)[term]], return_counts=True)
        if not len(term):
            return
        for s in sources:
            group = self.groups.setdefault((lang, s["source"]), len(self.groups))
            self.waiting.append((term | group << 32, times * s["copies"], np.full(len(term), s["copies"])))
            self.gathered += len(term)
            if self.gathered > GATHERED:
                self.settle()

    def settle(self) -> None:
        keys, counts, docs = (np.concatenate([mine, *new]) for mine, new in zip(
            (self.keys, self.counts, self.docs), zip(*self.waiting) if self.waiting else ((), (), ())))
        self.waiting, self.gathered = [], 0
        order = np.argsort(keys, kind="stable")
        keys, counts, docs = keys[order], counts[order], docs[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else []
        if len(starts):
            self.keys, self.counts, self.docs = keys[starts], np.add.reduceat(counts, starts), np.add.reduceat(
                docs, starts)

    def full(self) -> bool:
        return len(self.keys) > HELD or self.known > HELD

    def batches(self) -> Iterator[pa.RecordBatch]:
        self.settle()
        names = {lang: code.terms for lang, code in self.codes.items()}
        edges = np.searchsorted(self.keys >> 32, np.arange(len(self.groups) + 1))
        for (lang, source), g in self.groups.items():
            mine = slice(edges[g], edges[g + 1])
            terms = [names[lang][t].decode() for t in (self.keys[mine] & 0xFFFFFFFF).tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()),
                 pa.array(terms, pa.string()), pa.array(self.counts[mine]), pa.array(self.docs[mine])],
                ["lang", "source", "term", "n", "docs"])


def term_counts(texts: DataFrame, held: Broadcast, wanted: np.ndarray) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each wanted term."""
    sent = texts.sparkSession.sparkContext.broadcast(wanted)

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(sent.value)
        for lang, text, sources in read_once(batches, held):
            sums.add(lang, text, sources)
            if sums.full():
                yield from sums.batches()
                sums = Sums(sent.value)
        yield from sums.batches()

    parts = texts.select(*READ).mapInArrow(emit, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


# -- shares ------------------------------------------------------------------

def share(count: Column, size: Column) -> Column:
    """1 + floor(10^9 (count + 2) / size), where ``size`` is N + 2 V."""
    wide = (count + 2).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.call_function("div", wide, size.cast("decimal(20,0)")) + 1


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of two shares."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def pair_sums(counts: DataFrame, groups: DataFrame, side: int = SIDE, part: int = PART) -> DataFrame:
    """(a, b, value, met): sums over the terms that a or b has, and how many those are, by part.

    ``counts`` holds (lang, gid, term, p), ``groups`` (lang, gid, v, p0).  Every pair of groups of a
    language has a row at least, with a < b.
    """
    blocks = groups.groupBy("lang").agg(
        F.ceil(F.count(F.lit(1)) / side).cast("int").alias("blocks"),
        F.greatest(F.ceil(F.max("v") / part).cast("int"), F.lit(1)).alias("parts"))
    dealt = groups.join(blocks, "lang").select(
        "lang", "gid", "p0", "blocks", "parts", F.pmod(F.xxhash64("gid"), F.col("blocks")).cast("int").alias("own"))
    # Each group is in every part without a term, so that groups without terms there meet too.
    rows = counts.join(dealt, ["lang", "gid"]).select(
        "lang", "gid", "p0", "blocks", "own", F.pmod(F.xxhash64("term"), F.col("parts")).cast("int").alias("part"),
        "term", "p").unionByName(dealt.select(
            "lang", "gid", "p0", "blocks", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("string").alias("term"),
            F.lit(None).cast("long").alias("p")))
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "lang", "part", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
        (F.col("own") > F.col("other")).alias("second"), "gid", "p0", "term", "p")

    def compare(table: pa.Table) -> pa.Table:
        gid, p0 = table.column("gid").to_numpy(), table.column("p0").to_numpy()
        ids, first = np.unique(gid, return_index=True)
        absent, second = p0[first], table.column("second").to_numpy()[first]
        has = table.column("term").is_valid().to_numpy()
        names = table.column("term").combine_chunks().filter(pa.array(has)).dictionary_encode()
        term = names.indices.to_numpy(zero_copy_only=False)
        group = np.searchsorted(ids, gid[has])
        p = table.column("p").filter(pa.array(has)).to_numpy()
        order = np.argsort(group, kind="stable")
        term, group, p = term[order], group[order], p[order]
        edges = np.searchsorted(group, np.arange(len(ids) + 1))
        two = table.column("lo")[0] != table.column("hi")[0]
        right = np.flatnonzero(second) if two else np.arange(len(ids))
        column = np.full(len(ids), -1)
        column[right] = np.arange(len(right))
        dense = np.tile(absent[right], (len(names.dictionary), 1)) if len(term) else np.zeros((0, len(right)), np.int64)
        mine = column[group] >= 0
        r_term, r_col, r_p = term[mine], column[group][mine], p[mine]
        dense[r_term, r_col] = r_p
        out: list[tuple] = []
        for a in np.flatnonzero(~second):
            t, pa_ = term[edges[a]:edges[a + 1]], p[edges[a]:edges[a + 1], None]
            b = dense[t]
            value = ((pa_ - b) ** 2 // (pa_ + b)).sum(axis=0)
            held = np.zeros(len(dense), bool)
            held[t] = True
            alone = ~held[r_term]
            c, q = r_col[alone], r_p[alone]
            # Below PART values of at most 10^9 each, sums of doubles are exact.
            more = np.bincount(c, (absent[a] - q) ** 2 // (absent[a] + q), len(right)).astype(np.int64)
            met_now = len(t) + np.bincount(c, minlength=len(right))
            stay = right != a if two else right > a
            low, high = np.minimum(ids[a], ids[right]), np.maximum(ids[a], ids[right])
            out.append((low[stay], high[stay], (value + more)[stay], met_now[stay]))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 4
        return pa.table([pa.array(c.astype(np.int64)) for c in cols], names=["a", "b", "value", "met"])

    return met.groupBy("lang", "part", "lo", "hi").applyInArrow(compare, "a long, b long, value long, met long")


def source_divergence(docs: DataFrame, least: int = LEAST, top: int = TOP_TERMS, text: str = "text",
                      lang: str = "lang", source: str = "source", side: int = SIDE, part: int = PART
                      ) -> DataFrame:
    """(lang, source, part, item, value, rank): the other sources by distance, and the telling terms."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n)
                         for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    texts, held = collapsed(docs)
    sums = materialize(term_counts(texts, held, frequent_terms(texts, held, least)), "sums")
    kept = materialize(sums.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("total")).where(F.col("docs") >= least), "kept")
    counts = materialize(sums.where("n > 0").join(kept.select("lang", "term", "total"), ["lang", "term"]).select(
        "lang", "source", "term", "n", "total"), "counts")
    of_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("n_lang"))
    of_group = counts.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    occurring = number_rows(docs.select("lang", "source").distinct(), [], ["lang", "source"], "gid")
    none = F.lit(0).cast("long")
    groups = occurring.join(of_lang, "lang", "left").join(of_group, ["lang", "source"], "left").select(
        "lang", "source", F.col("gid").cast("long").alias("gid"), F.coalesce("v", none).alias("v"),
        F.coalesce("n_lang", none).alias("n_lang"), F.coalesce("n_group", none).alias("n_group"))
    size = F.col("n_group") + 2 * F.col("v")
    groups = materialize(groups.withColumns({
        "size": size, "p0": F.when(F.col("v") > 0, share(none, size)).otherwise(none)}), "groups")

    shares = counts.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("size")))
    q = share(F.col("total"), F.col("n_lang") + 2 * F.col("v"))
    telling = shares.withColumn("q", q).where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
        apart(F.col("p"), F.col("q")).alias("value"))

    summed = pair_sums(shares.select("lang", "gid", "term", "p"), groups.select("lang", "gid", "v", "p0"),
                       side, part).groupBy("a", "b").agg(F.sum("value").alias("value"), F.sum("met").alias("met"))
    for end, more in (("a", ["lang", "v"]), ("b", [])):
        summed = summed.join(groups.select(F.col("gid").alias(end), F.col("source").alias(f"source_{end}"),
                                           F.col("p0").alias(f"p0_{end}"), *more), end)
    rest = F.when(F.col("v") > 0, (F.col("v") - F.col("met")) * apart(F.col("p0_a"), F.col("p0_b"))).otherwise(none)
    pairs = summed.withColumn("value", F.col("value") + rest).select("lang", "value", F.inline(F.array(*[
        F.struct(F.col(f"source_{x}").alias("source"), F.col(f"source_{y}").alias("item"))
        for x, y in ("ab", "ba")]))).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(telling).where(F.col("rank") <= top))
