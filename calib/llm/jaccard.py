"""Documents linked by the Jaccard similarity of their word shingles, and their groups.

Multiple-global-order filtering: under any total order of all shingles, two sets whose
similarity reaches the threshold share l of the first n - ceil(t n) + l shingles of each,
for every l.  Three orders are used, each a random one in which shingles that are frequent
in a sample of documents come last, and l grows slowly with n, so that a shared passage
alone makes no candidate.  Candidates must share their l prefix shingles under every one
of the orders, and only those that do are verified on the whole sets.

A bitmap of 512 bits goes with every bucket entry: bit b tells whether an odd number of the
set's shingles hash to b.  Two bitmaps never differ in more bits than the sets differ in
shingles, and linked sets differ in few, so pairs that only share a passage are mostly told
apart inside the join that forms them, and no linked pair is.

Exact copies of a set are one class.  The first order removes the classes that share too
little with all others together; whole sets are kept only for the rest.  The second and
third remove more, and filter the pairs that the first one gives.  Of its shared prefix
shingles a class leaves out the l - 1 most frequent ones before pairs are formed.

Groups of near copies are never expanded into all pairs.  In each round a bucket (the
classes that share a prefix shingle) pairs one leader, later LEADERS, with all its members
of other groups; a leader has then met the whole bucket and leaves it.  Verified links merge
groups, and a bucket with one group left is settled.  Few remaining pairs of a bucket
are tested at once, and up to AT_ONCE of them once most pairs that pass the bitmaps are no
links; in larger buckets the leaders double each round.  The rounds end when all buckets are
settled, so no link between different groups is missed.  Of buckets that hold the same
classes one is kept, and a round reads the sets of the classes in its pairs only.

Defined cases: NULL and empty texts have no shingles and link with nothing; texts of
fewer words than a shingle are one shingle; rows that repeat a doc_id are one document
that has the links of any of them; rows without doc_id keep NULL as component.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calib.llm.blocks import (
    MIX_1, WordHash, as_bytes, keyed_text, list_array, mixed, slices, word_hashes,
)
from calib.llm.links import components
from calib.operators.ordering import local_if_small
from calib.session import materialize

SAMPLE_DOCS = 16_384
FREQUENT = 200_000
LEADERS = 32
PAIRS_AT_ONCE = 32
AT_ONCE = 1 << 22
ORDERS = 3
SHARE = 8  # one more prefix shingle must be shared for every so many of a set
NODES_SENT = 500_000
TOP = np.uint64(1 << 63)
WORDS = [f"w{k}" for k in range(8)]  # of the parity bitmap


def shingles(texts: list[bytes], known: WordHash, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, counts = word_hashes(texts, known)
    ends = np.cumsum(counts)
    out = []
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(len(hashes) - width + 1, 0), np.uint64)
        for k in range(width):
            rolled = rolled * MIX_1 + hashes[k:k + len(rolled)]
        rolled = mixed(rolled)
    for end, n in zip(ends, counts):
        start = end - n
        if n >= width:
            out.append(np.unique(rolled[start:end - width + 1]))
        elif n:
            out.append(np.array([xxhash.xxh64_intdigest(hashes[start:end].tobytes(), seed=int(n))],
                                np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def prefix(values: np.ndarray, percent: int, order: int, frequent: np.ndarray) -> np.ndarray:
    """The first shingles of a set under one of the orders."""
    n = len(values)
    if not n:
        return values
    with np.errstate(over="ignore"):
        rank = mixed(values + np.uint64(order + 1) * MIX_1) >> np.uint64(1)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, values), len(frequent) - 1)
        rank = np.where(frequent[at] == values, rank | TOP, rank)
    size = n - -(-percent * n // 100) + 1 + n // SHARE
    return values[np.argsort(rank, kind="stable")[:size]]


def parity(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, 8): the parity bitmaps of sets of shingle hashes, as words of 64 bits."""
    out = np.zeros((len(sets), 8 * 64), np.uint8)
    with np.errstate(over="ignore"):
        for row, s in zip(out, sets):
            bits = (mixed(s + MIX_1) >> np.uint64(55)).astype(np.int64)
            row[:] = np.bincount(bits, minlength=512) & 1
    return np.packbits(out, axis=1, bitorder="little").view("<i8").reshape(len(sets), 8)


def signed(values: list[np.ndarray]) -> np.ndarray:
    return (np.concatenate(values) if values else np.zeros(0, np.uint64)).view(np.int64)


def sizes(values: list[np.ndarray]) -> np.ndarray:
    return np.array([len(v) for v in values], np.int64)


def frequent_shingles(docs: DataFrame, width: int) -> Broadcast:
    """Shingles in two or more of a sample of about SAMPLE_DOCS documents, FREQUENT at most.

    They only shape the orders: any choice gives the same links.
    """
    every = max(1, -(-docs.count() // SAMPLE_DOCS))
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(shingles(as_bytes(batch.column("text")), known, width)))], ["s"])

    counts = sample.mapInArrow(emit, "s long").groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.where("n > 1").orderBy(F.desc("n"), "s").limit(FREQUENT).select("s").toArrow()
    values = np.sort(rows.column("s").to_numpy().view(np.uint64))
    return docs.sparkSession.sparkContext.broadcast(values)


def _described(docs: DataFrame, width: int, percent: int, frequent: Broadcast) -> DataFrame:
    """(doc_id, n, hi, lo, head): set size, its 128-bit hash, and its first-order prefix."""

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last = WordHash(), frequent.value
        for batch in slices(batches):
            sets = shingles(as_bytes(batch.column("text")), known, width)
            marks = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets),
                                  np.int64).reshape(-1, 2)
            heads = [prefix(s, percent, 0, last) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes(sets)), pa.array(marks[:, 0].copy()),
                 pa.array(marks[:, 1].copy()),
                 list_array(signed(heads), sizes(heads), pa.int64())],
                ["doc_id", "n", "hi", "lo", "head"])

    return docs.mapInArrow(emit, "doc_id long, n long, hi long, lo long, head array<long>")


def _whole(docs: DataFrame, width: int, percent: int, frequent: Broadcast) -> DataFrame:
    """(node, shingles, prefix2, prefix3, parity words) of the documents left."""
    names = [f"prefix{k + 1}" for k in range(1, ORDERS)]

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last = WordHash(), frequent.value
        for batch in slices(batches):
            sets = shingles(as_bytes(batch.column("text")), known, width)
            cols = [list_array(signed(sets), sizes(sets), pa.int64())]
            for k in range(1, ORDERS):
                heads = [prefix(s, percent, k, last) for s in sets]
                cols.append(list_array(signed(heads), sizes(heads), pa.int64()))
            words = parity(sets)
            cols += [pa.array(words[:, k].copy()) for k in range(8)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *cols], ["node", "shingles", *names, *WORDS])

    return docs.mapInArrow(emit, "node long, shingles array<long>, " + ", ".join(
        [f"{n} array<long>" for n in names] + [f"{w} long" for w in WORDS]))


def _shared(postings: DataFrame) -> DataFrame:
    """The postings (token, node) whose shingle occurs at two nodes or more, and at how many.

    Frequent shingles come last in every order, so the groups are small; a window shuffles
    the postings once, and its groups need no memory.
    """
    by = Window.partitionBy("token")
    return postings.withColumns({
        "__lo": F.min("node").over(by), "__hi": F.max("node").over(by),
        "times": F.count(F.lit(1)).over(by)}).where("__lo <> __hi").select("token", "node", "times")


def _asked(percent: int) -> Column:
    """How many prefix shingles the smallest partner of a set of ``n`` asks to share."""
    return 1 + F.floor(F.ceil(F.col("n") * percent / 100) / SHARE)


def _rarest(shared: DataFrame, sizes_of: DataFrame, percent: int) -> DataFrame:
    """Postings (token, node, n) without each node's most frequent ones.

    Partners share ``l`` prefix shingles or more, so the rarest one they share is not
    among the l - 1 most frequent of either; leaving those out loses no pair.
    """
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("times"), "token"))
    rows = shared.join(sizes_of, "node").withColumn("__place", place).where(
        F.col("__place") >= _asked(percent))
    return _unlike(_shared(rows.select("token", "node"))).join(sizes_of, "node")


def _unlike(shared: DataFrame) -> DataFrame:
    """Postings (token, node) of the first of all buckets that hold the same nodes.

    Near copies share most of their shingles, so most buckets repeat others.  Nodes are told
    by three sums of 32-bit hashes and their count; a sum, unlike xor, also tells repeats.
    """
    by = Window.partitionBy("token")
    marks = [F.sum(F.shiftrightunsigned(F.xxhash64("node", F.lit(k)), 32)).over(by).alias(f"mark{k}")
             for k in range(3)]
    rows = materialize(shared.select("token", "node", "times", *marks), "marked")
    firsts = rows.groupBy("times", "mark0", "mark1", "mark2").agg(F.min("token").alias("token"))
    return rows.join(firsts.select("token"), "token", "left_semi").select("token", "node")


def _able(shared: DataFrame, sizes_of: DataFrame, percent: int) -> DataFrame:
    """Nodes that share as many prefix shingles as their smallest partner would ask for."""
    return shared.groupBy("node").agg(F.count(F.lit(1)).alias("c")).join(sizes_of, "node").where(
        F.col("c") >= _asked(percent)).select("node")


def _may_link(percent: int) -> Column:
    """Whether bucket entries l and r are near enough in size and in their bitmaps.

    Linked sets differ in (1 - t) / (1 + t) of the sum of their sizes or less.
    """
    n, m = F.col("l.n"), F.col("r.n")
    differ = F.bit_count(F.col("l.w0").bitwiseXOR(F.col("r.w0")))
    for w in WORDS[1:]:
        differ = differ + F.bit_count(F.col(f"l.{w}").bitwiseXOR(F.col(f"r.{w}")))
    return (n * 100 >= m * percent) & (m * 100 >= n * percent) & (
        differ * (100 + percent) <= (n + m) * (100 - percent))


def _settle(buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, root) over the verified links inside the buckets (token, node, n, parity words)."""
    entry = ["token", "node", "n", *WORDS]
    buckets = materialize(buckets, "buckets")
    labels = buckets.select("node").distinct().withColumn("root", F.col("node"))
    labels = materialize(labels, "labels")
    leaders, most = 1, 0
    found: DataFrame | None = None
    while True:
        marked = buckets.join(labels, "node")
        inside = marked.groupBy("token", "root").agg(F.count(F.lit(1)).alias("c"))
        state = inside.groupBy("token").agg(
            F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("squares"),
            F.count(F.lit(1)).alias("groups"), F.max(F.struct("c", "root"))["root"].alias("big"))
        state = state.where("groups > 1")
        rest = (F.col("m") * F.col("m") - F.col("squares")) / 2
        # The first round only pairs every bucket with one leader, which merges most copies.
        at_once = F.lit(False) if leaders == 1 else rest <= F.greatest(
            PAIRS_AT_ONCE * F.col("m"), F.lit(most))
        active = materialize(marked.join(
            state.select("token", "big", at_once.alias("at_once")), "token"), "active")
        if active.isEmpty():
            return labels if found is None else labels.select("node").join(
                components(found), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        # Near copies share many buckets with the same members.  A large bucket waits until
        # it is the first of some member; most are settled by then.
        waiting = active.where("NOT at_once")
        turn = waiting.groupBy("node").agg(F.min("token").alias("token")).select("token").distinct()
        waiting = waiting.select(*entry).join(turn, "token", "left_anti")
        active = materialize(active.where("at_once").unionByName(
            active.where("NOT at_once").join(turn, "token", "left_semi")), "turn")
        chosen = active.where("NOT at_once" if leaders == 1 else "NOT at_once AND root <> big").groupBy(
            "token", F.pmod(F.xxhash64("node"), F.lit(leaders)).alias("slot")).agg(
            F.min(F.struct("node", "n", "root", *WORDS)).alias("lead")).select("token", "lead.*")
        chosen = materialize(chosen, "leaders")
        left = chosen.unionByName(active.where("at_once").select(*entry, "root")).alias("l")
        other = active.select(*entry, "root", "at_once").alias("r")
        pairs = left.join(other, (F.col("l.token") == F.col("r.token")) & F.expr(
            "l.root <> r.root AND (NOT r.at_once OR l.node < r.node)") & _may_link(percent))
        pairs = pairs.select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")).distinct()
        pairs = materialize(pairs, "pairs")
        links = materialize(_verified(pairs, _of_pairs(sets, pairs), percent), "found")
        found = links if found is None else found.unionByName(links)
        labels = materialize(_merged(labels, links), "labels")
        buckets = materialize(active.where("NOT at_once").select(*entry).join(
            chosen.select("token", "node"), ["token", "node"], "left_anti").unionByName(waiting), "buckets")
        leaders = LEADERS if leaders == 1 else 2 * leaders
        most = AT_ONCE if 2 * links.count() <= pairs.count() else 0


def _of_pairs(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The sets of the nodes in ``pairs``."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    return sets.join(local_if_small(materialize(ends, "ends"), NODES_SENT), "node", "left_semi")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after one hop along the links (a, b) between groups.

    Equal labels mean linked nodes; groups that one hop leaves apart stay so until a later
    round, and the links of all rounds decide in the end.
    """
    near = links.join(labels.withColumnsRenamed({"node": "a", "root": "ra"}), "a").join(
        labels.withColumnsRenamed({"node": "b", "root": "rb"}), "b").where("ra <> rb")
    hops = near.select(F.greatest("ra", "rb").alias("root"), F.least("ra", "rb").alias("to"))
    hops = hops.groupBy("root").agg(F.min("to").alias("to"))
    return labels.join(hops, "root", "left").select("node", F.coalesce("to", "root").alias("root"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that pass the other orders' filters and reach the threshold."""
    names = [f"prefix{k + 1}" for k in range(1, ORDERS)]
    heads = sets.select("node", F.size("shingles").alias("n"), *names)
    for end in ("a", "b"):
        pairs = pairs.join(heads.select(F.col("node").alias(end), *[
            F.col(c).alias(f"{c}_{end}") for c in ("n", *names)]), end)
    asked = 1 + F.floor(F.least("n_a", "n_b") / SHARE)
    for n in names:
        pairs = pairs.where(F.size(F.array_intersect(f"{n}_a", f"{n}_b")) >= asked)
    pairs = pairs.select("a", "b")
    for end in ("a", "b"):
        pairs = pairs.join(sets.select(
            F.col("node").alias(end), F.col("shingles").alias(f"set_{end}")), end)
    both = F.size(F.array_intersect("set_a", "set_b"))
    either = F.size("set_a") + F.size("set_b") - both
    return pairs.where(both * 100 >= either * percent).select("a", "b")


def jaccard_groups(docs: DataFrame, width: int = 4, percent: int = 85, key: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``."""
    docs = keyed_text(docs, key, text)
    frequent = frequent_shingles(docs, width)
    table = materialize(_described(docs, width, percent, frequent), "described")
    known = table.where("n > 0 AND doc_id IS NOT NULL")
    firsts = known.groupBy("hi", "lo").agg(F.min(F.struct("doc_id", "n", "head")).alias("r"))
    postings = firsts.select(F.explode("r.head").alias("token"), F.col("r.doc_id").alias("node"))
    shared = materialize(_shared(postings), "postings")
    classes = materialize(known.groupBy("hi", "lo").agg(
        F.min(F.struct("doc_id", "n")).alias("r")).select(
        "hi", "lo", F.col("r.doc_id").alias("node"), "r.n"), "classes")
    # Rows that repeat a doc_id may hold several sets; the smallest asks for the least.
    sizes_of = classes.groupBy("node").agg(F.min("n").alias("n"))
    nodes = materialize(_able(shared, sizes_of, percent), "nodes")
    left = local_if_small(nodes.withColumnRenamed("node", "doc_id"), NODES_SENT)
    sets = materialize(_whole(docs.join(left, "doc_id", "left_semi"), width, percent, frequent), "sets")
    for k in range(1, ORDERS):
        others = sets.select("node", F.explode(f"prefix{k + 1}").alias("token"))
        if k > 1:
            others = others.join(nodes, "node", "left_semi")
        nodes = materialize(_able(_shared(others), sizes_of, percent), "nodes")
    common = _shared(shared.select("token", "node").join(nodes, "node", "left_semi"))
    buckets = _rarest(common, sizes_of, percent).join(sets.select("node", *WORDS), "node")
    labels = _settle(buckets, sets, percent)
    roots = classes.select("hi", "lo", "node").join(labels, "node", "left").select(
        "hi", "lo", F.coalesce("root", "node").alias("root"))
    rows = known.select("doc_id", "n", "hi", "lo").join(roots, ["hi", "lo"]).select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("root").alias("component_id"))
    alone = table.where("n = 0 OR doc_id IS NULL").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return rows.unionByName(alone)
