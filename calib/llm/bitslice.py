"""SimHash fingerprints of documents, linked by bit-sliced comparison, and their groups.

A fingerprint has 64 bits: each is set if it is set in over half the hashes of a text's
three-word shingles.  Documents with one fingerprint are one class, and only classes are
compared.  Fingerprints at ``radius`` differing bits or fewer agree in all but ``radius``
of radius + 2 bands, so they share one bucket (a choice of two bands, and what they hold).

A bucket is compared in a task by bit slices: its fingerprints are the lanes, bit j of all
lanes is one plane, and a plane word holds bit j of 64 of them.  One XOR of a plane word with
a query's bit, and a carry-save counter of a few words, moves 64 distances at once.  A word
whose distances all exceed the radius is abandoned; the bands that make the bucket are equal
and are not compared.  Buckets above ``BLOCK`` fingerprints are dealt to blocks, every pair of
blocks is compared, and what a comparison gives is a spanning forest of its links, never all
of its pairs.

Defined cases: texts without words, empty and NULL ones have fingerprint zero and link like
any other; texts of one or two words are one shingle; a row without doc_id takes part and
gets the smallest doc_id it reaches, NULL if there is none; rows that repeat a doc_id keep
their own fingerprints, and their components are one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calib.llm.blocks import as_bytes, keyed_text, ranges, slices
from calib.llm.chunks import SPACE, chunks
from calib.llm.links import components
from calib.session import materialize

WIDTH = 3
SEED = 42
BITS = 64
RADIUS = 2
BLOCK = 4096
#: Cells (a query against one word of lanes) compared at once.
CELLS = 65_536
#: Planes between two looks at which words are alive.
STRIDE = 8
FLUSH = 1 << 19
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
BYTE_LANES = np.uint64(0x0101010101010101)
GROUP = ["combo", "part", "lo", "hi"]


# -- fingerprints ------------------------------------------------------------

def shingle_hashes(words: list[bytes], width: int = WIDTH, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of ``width`` words, space-joined; of all words if there are fewer."""
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        return np.array([digest(joined, seed)] if words else [], np.uint64)
    after = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)).tolist()
    return np.fromiter((digest(joined[a:b - 1], seed) for a, b in zip([0, *after], after[width - 1:])),
                       np.uint64, len(words) - width + 1)


def set_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(texts, 64): in how many of each text's hashes each bit is set.

    Eight byte counters ride in one word, so runs of 255 hashes are added per word first.
    """
    out = np.zeros((len(counts), BITS), np.int64)
    runs = -(-counts // 255)
    if not len(hashes):
        return out
    starts = np.repeat(np.cumsum(counts) - counts, runs) + 255 * ranges(runs)
    owner = np.repeat(np.arange(len(counts)), runs)
    for k in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(k)) & BYTE_LANES, starts)
        np.add.at(out[:, k::8], owner, sums.astype("<u8").view(np.uint8).reshape(-1, 8))
    return out


def text_prints(texts: list[bytes], width: int = WIDTH, seed: int = SEED) -> np.ndarray:
    """The fingerprint of each text, read in pieces of bounded size."""
    votes = np.zeros((len(texts), BITS), np.int64)
    totals = np.zeros(len(texts), np.int64)
    parts: list[np.ndarray] = []
    owners: list[int] = []

    def flush() -> None:
        counts = np.array([len(p) for p in parts], np.int64)
        np.add.at(votes, owners, set_bits(np.concatenate(parts), counts))
        np.add.at(totals, owners, counts)
        parts.clear()
        owners.clear()

    waiting = 0
    for i, text in enumerate(texts):
        last: list[bytes] = []
        seen = 0
        for piece in chunks(text, SPACE):
            new = piece.lower().split()
            seen += len(new)
            words = last + new
            # A short piece waits for the next one; only a whole short text is one shingle.
            if len(words) >= width:
                parts.append(shingle_hashes(words, width, seed))
                owners.append(i)
                waiting += len(parts[-1])
                words = words[len(words) - width + 1:]
            last = words
            if waiting > FLUSH:
                flush()
                waiting = 0
        if 0 < seen < width:
            parts.append(shingle_hashes(last, width, seed))
            owners.append(i)
    if parts:
        flush()
    bits = (2 * votes > totals[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH,
                 seed: int = SEED) -> DataFrame:
    """(doc_id, print) of every row; ``print`` is the fingerprint as a signed long."""

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = text_prints(as_bytes(batch.column("text")), width, seed)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "print"])

    return keyed_text(docs, key, text).mapInArrow(emit, "doc_id long, print long")


# -- comparison by bit slices ------------------------------------------------

def planes_of(prints: np.ndarray) -> np.ndarray:
    """(64, words): bit j of every lane, 64 lanes in a word."""
    lanes = -(-len(prints) // 64) * 64
    bits = np.zeros((lanes, BITS), np.uint8)
    bits[:len(prints)] = np.unpackbits(
        prints.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def beyond(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is above ``radius``."""
    above, equal = np.zeros_like(counters[0]), np.full_like(counters[0], ALL)
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal = equal & counters[k]
        else:
            above = above | (equal & counters[k])
            equal = equal & ~counters[k]
    return above


def close_lanes(prints: np.ndarray, planes: np.ndarray, compared: list[int], first: np.ndarray,
                stop: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query lane, lane): lane in [first, stop) of its query, at ``radius`` bits or fewer.

    ``compared`` lists the bit planes in which a query and its lanes can differ.
    """
    asking = np.flatnonzero(stop > first)
    spans = (stop[asking] - 1) // 64 - first[asking] // 64 + 1
    done = np.concatenate([[0], np.cumsum(spans)])
    at = 0
    while at < len(asking):
        end = max(at + 1, int(np.searchsorted(done, done[at] + CELLS, side="right")) - 1)
        q = np.repeat(asking[at:end], spans[at:end])
        w = first[q] // 64 + ranges(spans[at:end])
        at = end
        low = np.maximum(first[q] - 64 * w, 0).astype(np.uint64)
        high = np.minimum(stop[q] - 64 * w, 64).astype(np.uint64)
        over = ~((ALL << low) & (ALL >> (np.uint64(64) - high)))
        counters = [np.zeros(len(q), np.uint64) for _ in range(radius.bit_length())]
        for turn, j in enumerate(compared, 1):
            carry = planes[j][w] ^ (np.uint64(0) - (prints[q] >> np.uint64(j) & np.uint64(1)))
            for k, counter in enumerate(counters):
                counters[k], carry = counter ^ carry, counter & carry
            over |= carry
            if turn % STRIDE == 0 or turn == len(compared):
                over |= beyond(counters, radius)
                alive = over != ALL
                if not alive.all():
                    q, w, over = q[alive], w[alive], over[alive]
                    counters = [c[alive] for c in counters]
                if not len(q):
                    break
        if len(q):
            near = np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1,
                                 bitorder="little")
            cell, bit = np.nonzero(near)
            yield q[cell], 64 * w[cell] + bit


def join_roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` after joining the lanes ``a`` with the lanes ``b``; roots are the smallest lanes."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def forest(prints: np.ndarray, group: np.ndarray, side: np.ndarray, compared: list[int],
           radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (lane, root) that span the close lanes of each group.

    ``group`` ascends; within a group, lanes of side 1 follow those of side 0, and if there
    are any, only lanes of different sides are compared.
    """
    n = len(prints)
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.concatenate([starts, [n]]))
    ends = np.repeat(starts + sizes, sizes)
    ones = np.add.reduceat(side, starts)
    split = np.repeat(starts + sizes - ones, sizes)
    two = np.repeat(ones > 0, sizes)
    first = np.where(two, split, np.arange(n) + 1)
    stop = np.where(two & (side == 1), first, ends)
    root = np.arange(n)
    for a, b in close_lanes(prints, planes_of(prints), compared, first, stop, radius):
        root = join_roots(root, a, b)
    lanes = np.flatnonzero(root != np.arange(n))
    return lanes, root[lanes]


# -- buckets -----------------------------------------------------------------

def band_masks(radius: int) -> list[int]:
    """Masks of two bands each, of radius + 2 bands: close fingerprints agree under one of them."""
    bands = radius + 2
    edges = [BITS * k // bands for k in range(bands + 1)]
    bits = [(1 << edges[k + 1]) - (1 << edges[k]) for k in range(bands)]
    return [bits[i] | bits[j] for i, j in combinations(range(bands), 2)]


def print_links(nodes: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(a, b): links that join the same fingerprints as all links within ``radius`` do.

    ``nodes`` holds distinct fingerprints in ``print``.
    """
    masks = band_masks(radius)
    compared = [[j for j in range(BITS) if not m >> j & 1] for m in masks]
    parts = [F.struct(F.lit(k).alias("combo"), F.col("print").bitwiseAND(
        F.lit(m - (1 << 64) if m >> 63 else m)).alias("part")) for k, m in enumerate(masks)]
    posts = nodes.select("print", F.inline(F.array(*parts)))
    sizes = posts.groupBy("combo", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("print"), blocks).cast("int")
    met = posts.join(sizes, ["combo", "part"]).select(
        "combo", "part", "print", own.alias("own"),
        F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    met = met.select("combo", "part", F.least("own", "other").alias("lo"),
                     F.greatest("own", "other").alias("hi"),
                     (F.col("own") > F.col("other")).cast("int").alias("side"), "print")
    names = [*GROUP, "side", "print"]

    def settled(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Compare whole groups, as many at once as fill a block of lanes."""
        changes = (rows[:4, 1:] != rows[:4, :-1]).any(axis=0)
        group = np.concatenate([[0], np.cumsum(changes)])
        starts = np.concatenate([[0], np.flatnonzero(changes) + 1, [rows.shape[1]]])
        at = 0
        while at < len(starts) - 1:
            same = int(np.searchsorted(rows[0], rows[0, starts[at]], side="right"))
            end = int(np.searchsorted(starts, min(starts[at] + block, same), side="right")) - 1
            end = max(at + 1, end)
            lane = slice(starts[at], starts[end])
            prints = rows[5, lane].copy().view(np.uint64)
            a, b = forest(prints, group[lane], rows[4, lane], compared[rows[0, starts[at]]], radius)
            if len(a):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(prints[a].view(np.int64)), pa.array(prints[b].view(np.int64))], ["a", "b"])
            at = end

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((6, 0), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            held = np.concatenate([held, np.stack([
                batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names])], axis=1)
            last = int(np.flatnonzero(np.concatenate([[True], (held[:4, 1:] != held[:4, :-1]).any(axis=0)]))[-1])
            if last:
                yield from settled(held[:, :last])
                held = held[:, last:]
        if held.shape[1]:
            yield from settled(held)

    return met.select(*names).repartition(*GROUP).sortWithinPartitions(*names).mapInArrow(
        emit, "a long, b long")


def simhash_groups(docs: DataFrame, radius: int = RADIUS, key: str = "doc_id", text: str = "text",
                   width: int = WIDTH, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``."""
    prints = materialize(fingerprints(docs, key, text, width, seed), "prints")
    nodes = materialize(prints.groupBy("print").agg(F.min("doc_id").alias("first")), "nodes")
    several = prints.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min("print").alias("b"), F.max("print").alias("last")).where("b <> last")
    same_id = prints.join(several, "doc_id").select(F.col("print").alias("a"), "b").where("a <> b")
    labels = components(print_links(nodes, radius, block).unionByName(same_id))
    linked = nodes.join(labels.withColumnRenamed("node", "print"), "print")
    smallest = linked.groupBy("root").agg(F.min("first").alias("reached"))
    linked = linked.join(smallest, "root").select("print", "reached")
    of_print = nodes.join(linked, "print", "left").select(
        "print", F.coalesce("reached", "first").alias("component_id"))
    return prints.join(of_print, "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
