"""Language-model scores of texts by prediction by partial matching over bytes.

The model reads a text as its lower-cased words, one space between them, and an end
symbol.  Training counts, by grouped aggregation over all training texts, how often each
byte follows each context of the longest order; the shorter contexts are sums of those
counts, and together they form the trie.  A byte is coded in the longest context that has
been seen.  Each different byte of a context gives half a count to the escape, which a
byte not seen there costs; the next shorter context is then used with the bytes of the
longer one excluded.  Below the empty context all bytes left are equally likely.

The trie's lower levels go to the tasks as a broadcast, as many as have at most ``NODES``
nodes; order 2 always fits, as it has at most 256^3.  Longer contexts, if any are left,
stay stored tables: the most frequent ones are broadcast too, and the different codes of
all others meet their counts in joins.  Every text is scored with the same model, whole,
and the order is the same at any size.

The base score is a smoothed unigram model of words.  Its counts are a table of any
length: the most frequent words, TOP_WORDS at most, go to the tasks, and the others meet
their counts in a join.

Defined cases: NULL and empty texts are the end symbol alone; without training texts
every byte is equally likely and every word unknown; repeated rows are scored each.
"""

from __future__ import annotations

import copy
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calib.llm.blocks import as_bytes, bounded_batches, slices
from calib.session import materialize

ORDER = 5
LEAST_ORDER = 2
NODES = 6_000_000
TOP_WORDS = 300_000
HELD = 300_000
SCORED_BYTES = 2 << 20
START, END = 0xFE, 0xFF  # bytes that UTF-8 never uses
SYMBOLS = 256


def grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of (context, byte) at every place of the texts, and the count per text.

    A code holds the ``order`` bytes before in its upper part and the byte in its lowest.
    """
    pad = bytes([START]) * order
    plain = [b" ".join(t.lower().split()) for t in texts]
    joined = np.frombuffer(pad + b"".join(p + bytes([END]) + pad for p in plain), np.uint8)
    sizes = np.array([len(p) + 1 for p in plain], np.int64)
    codes = np.zeros(max(len(joined) - order, 0), np.uint64)
    for k in range(order + 1):
        codes = (codes << np.uint64(8)) | joined[k:k + len(codes)].astype(np.uint64)
    # Codes that predict the padding between two texts are left out.
    starts = np.concatenate([[0], np.cumsum(sizes + order)[:-1]]) if len(sizes) else sizes
    keep = np.zeros(len(codes) + 1, np.int64)
    keep[starts] += 1
    np.add.at(keep, starts + sizes, -1)
    return codes[np.cumsum(keep[:-1]) > 0], sizes


@dataclass
class Level:
    """Nodes of one order: (context, byte) codes with counts, and contexts with totals."""

    codes: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    totals: np.ndarray
    kinds: np.ndarray
    below: np.ndarray  # count, in the next shorter context, of the bytes seen in this one


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(codes):
        return codes, counts
    by = np.argsort(codes, kind="stable")
    codes, counts = codes[by], counts[by]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.add.reduceat(counts, first)


def _mask(n_bytes: int) -> np.uint64:
    return np.uint64((1 << 8 * n_bytes) - 1)


class ByteModel:
    """The trie of one corpus: ``levels[k]`` holds the contexts of k bytes."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, order: int):
        self.order = order
        self.levels: list[Level] = []
        for k in range(order + 1):
            own, n = _summed(codes & _mask(k + 1), counts)
            contexts = own >> np.uint64(8)
            first = np.flatnonzero(np.concatenate([[True], contexts[1:] != contexts[:-1]])) if len(
                own) else np.zeros(0, np.int64)
            below = np.zeros(len(own), np.int64)
            if k:
                at, _ = _find(self.levels[-1].codes, own & _mask(k))
                below = self.levels[-1].counts[at] if len(own) else below
            add = (lambda x, f=first: np.add.reduceat(x, f) if len(f) else np.zeros(0, np.int64))
            self.levels.append(Level(own, n, contexts[first], add(n), np.diff(
                np.concatenate([first, [len(own)]])), add(below)))

    def log10(self, codes: np.ndarray, state: tuple[np.ndarray, ...] | None = None) -> np.ndarray:
        """log10 probability of the byte of each code after its context.

        ``state`` is what contexts longer than this model's have left: the sum so far,
        whether the byte is still open, and the counts and kinds they exclude.
        """
        if state is None:
            state = (np.zeros(len(codes)), np.ones(len(codes), bool),
                     np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64))
        out, open_, gone, gone_kinds = state
        for k in range(self.order, -1, -1):
            level = self.levels[k]
            node, seen = _find(level.codes, codes & _mask(k + 1))
            ctx, known = _find(level.contexts, (codes & _mask(k + 1)) >> np.uint64(8))
            if not len(level.codes):
                continue
            new = np.where(known, level.kinds[ctx] - gone_kinds, 0)
            whole = np.where(known, level.totals[ctx] - gone, 0)
            use = open_ & (new > 0)
            hit = use & seen
            miss = use & ~seen
            out[hit] += np.log10((level.counts[node[hit]] - 0.5) / whole[hit])
            out[miss] += np.log10(0.5 * new[miss] / whole[miss])
            open_ &= ~hit
            gone = np.where(known, level.below[ctx], 0)
            gone_kinds = np.where(known, level.kinds[ctx], 0)
        out[open_] -= np.log10(SYMBOLS - gone_kinds[open_])
        return out

    def with_longer(self, levels: list[Level]) -> ByteModel:
        """This model with levels of longer contexts added."""
        more = copy.copy(self)
        more.order, more.levels = self.order + len(levels), [*self.levels, *levels]
        return more

    def score_known(self, texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Per text the log10 sum of codes whose longest context is here; other codes, counts."""
        codes, sizes = grams(texts, self.order)
        own, back = np.unique(codes, return_inverse=True)
        _, here = _find(self.levels[-1].contexts, own >> np.uint64(8))
        logs = np.zeros(len(own))
        logs[here] = self.log10(own[here])
        ends = np.cumsum(sizes)
        rest = [np.unique(c[~here[b]], return_counts=True) for c, b in (
            (codes[e - n:e], back[e - n:e]) for e, n in zip(ends, sizes))]
        sums = np.add.reduceat(logs[back], ends - sizes) if len(sizes) else np.zeros(0)
        return sums, [c.astype(np.int64) for c, _ in rest], [n for _, n in rest]

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text."""
        codes, sizes = grams(texts, self.order)
        own, back = np.unique(codes, return_inverse=True)
        starts = np.cumsum(sizes) - sizes
        return np.add.reduceat(self.log10(own)[back], starts) if len(sizes) else np.zeros(0)


@dataclass
class Trained:
    model: ByteModel
    words: DataFrame  # (word, c); the empty word is the end
    n: int            # training tokens
    v: int            # different training tokens
    longer: list[tuple[DataFrame, DataFrame]] = field(default_factory=list)
    hot: list[Level] = field(default_factory=list)  # the most frequent contexts of ``longer``


def _cut(code: Column, n_bytes: int) -> Column:
    return code.bitwiseAND(F.lit(int(_mask(n_bytes))))


def _longer(own: DataFrame, low: DataFrame, least: int, order: int) -> list[tuple[DataFrame, DataFrame]]:
    """Per order above ``least`` its nodes (node, c) and contexts (context, total, kinds, below)."""
    out = []
    shorter = low.select(F.col("code").alias("short"), F.col("n").alias("under"))
    for k in range(least + 1, order + 1):
        nodes = materialize(own.groupBy(_cut(F.col("code"), k + 1).alias("node")).agg(
            F.sum("n").alias("c")), "nodes")
        met = nodes.withColumn("short", _cut(F.col("node"), k)).join(shorter, "short")
        contexts = met.groupBy(F.shiftright("node", 8).alias("context")).agg(
            F.sum("c").alias("total"), F.count(F.lit(1)).alias("kinds"), F.sum("under").alias("below"))
        out.append((nodes, materialize(contexts, "contexts")))
        shorter = nodes.select(F.col("node").alias("short"), F.col("c").alias("under"))
    return out


def _hot(longer: list[tuple[DataFrame, DataFrame]], most: int) -> list[Level]:
    """Levels of the contexts seen most often, with at most ``most`` nodes in all.

    One bound on the total holds for all orders, so with a context its shorter ones are in.
    """
    level = F.floor(F.log2("total") * 8)
    table = reduce(DataFrame.unionByName, [c for _, c in longer]).groupBy(level.alias("level")).agg(
        F.sum("kinds").alias("n")).orderBy(F.desc("level")).collect()
    held, least = 0, None
    for row in table:
        held += row["n"]
        if held > most:
            break
        least = row["level"]
    out = []
    for nodes, contexts in longer:
        kept = contexts.where(level >= least if least is not None else F.lit(False))
        c = kept.orderBy("context").toArrow()
        n = nodes.withColumn("context", F.shiftright("node", 8)).join(
            kept, "context", "left_semi").orderBy("node").toArrow()
        column = (lambda t, name: t.column(name).to_numpy().astype(np.int64))
        out.append(Level(column(n, "node").astype(np.uint64), column(n, "c"), column(c, "context").astype(
            np.uint64), column(c, "total"), column(c, "kinds"), column(c, "below")))
    return out


def _joined_logs(codes: DataFrame, trained: Trained) -> DataFrame:
    """(code, log) of different codes: longer contexts by joins, the others by the broadcast."""
    model = codes.sparkSession.sparkContext.broadcast(trained.model)
    order = trained.model.order + len(trained.longer)
    rows = codes.select("code", F.lit(0.0).alias("out"), F.lit(True).alias("open"),
                        F.lit(0).cast("long").alias("gone"), F.lit(0).cast("long").alias("gone_kinds"))
    for k, (nodes, contexts) in zip(range(order, trained.model.order, -1), reversed(trained.longer)):
        rows = rows.withColumn("node", _cut(F.col("code"), k + 1)).withColumn(
            "context", F.shiftright("node", 8)).join(nodes, "node", "left").join(contexts, "context", "left")
        new = F.coalesce(F.col("kinds") - F.col("gone_kinds"), F.lit(0))
        whole = F.col("total") - F.col("gone")
        use = F.col("open") & (new > 0)
        hit = use & F.col("c").isNotNull()
        add = F.when(hit, F.log10((F.col("c") - 0.5) / whole)).when(
            use, F.log10(new * 0.5 / whole)).otherwise(0.0)
        rows = rows.select("code", (F.col("out") + add).alias("out"), (F.col("open") & ~hit).alias("open"),
                           F.coalesce("below", F.lit(0)).alias("gone"),
                           F.coalesce("kinds", F.lit(0)).alias("gone_kinds"))

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = model.value
        for batch in batches:
            state = tuple(np.array(batch.column(c).to_numpy(zero_copy_only=False)) for c in (
                "out", "open", "gone", "gone_kinds"))
            own = batch.column("code").to_numpy().astype(np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("code"), pa.array(trie.log10(own, state))], ["code", "log"])

    return materialize(rows.mapInArrow(finish, "code long, log double"), "logs")


def train(docs: DataFrame, order: int = ORDER, nodes: int = NODES) -> Trained:
    """Count words and contexts of documents (text), in one pass."""
    bounded_batches(docs.sparkSession)

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def word_rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(words), pa.binary()), pa.nulls(len(words), pa.int64()),
                 pa.array(list(words.values()), pa.int64())], ["word", "code", "n"])
            words.clear()
            return out

        def code_rows() -> pa.RecordBatch:
            own, n = _summed(*(np.concatenate(x) for x in zip(*held)))
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.nulls(len(own), pa.binary()), pa.array(own.astype(np.int64)), pa.array(n)],
                ["word", "code", "n"])

        for batch in slices(batches):
            texts = as_bytes(batch.column("text"))
            for t in texts:
                words.update(t.lower().split())
            words[b""] += len(texts)
            codes, _ = grams(texts, order)
            held.append(np.unique(codes, return_counts=True))
            if len(words) > HELD:
                yield word_rows()
            if sum(len(c) for c, _ in held) > 4 * HELD:
                yield code_rows()
        if words:
            yield word_rows()
        if held:
            yield code_rows()

    raw = docs.select("text").mapInArrow(emit, "word binary, code long, n long")
    counts = materialize(raw.groupBy("word", "code").agg(F.sum("n").alias("n")), "counts")
    words = counts.where("word IS NOT NULL").select("word", F.col("n").alias("c"))
    size = words.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    own = counts.where("code IS NOT NULL").select("code", "n")
    low, least = own, order
    while least > LEAST_ORDER and low.count() > nodes:
        least -= 1
        low = materialize(low.groupBy(_cut(F.col("code"), least + 1).alias("code")).agg(
            F.sum("n").alias("n")), "grams")
    arrow = low.toArrow()
    model = ByteModel(arrow.column("code").to_numpy().astype(np.uint64),
                      arrow.column("n").to_numpy().astype(np.int64), least)
    trained = Trained(model, words, int(size["n"] or 0), int(size["v"] or 0))
    if least < order:
        trained.longer = _longer(own, low, least, order)
        trained.hot = _hot(trained.longer, nodes // 2)
    return trained


def _top_words(words: DataFrame, most: int) -> dict[bytes, int]:
    """The most frequent words, at most ``most``; counts are cut at an eighth of an octave."""
    level = F.floor(F.log2("c") * 8)
    table = words.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("level")).collect()
    total, least = 0, None
    for row in table:
        total += row["n"]
        if total > most:
            break
        least = row["level"]
    if least is None:
        return {}
    arrow = words.where(level >= least).toArrow()
    return dict(zip(arrow.column("word").to_pylist(), arrow.column("c").to_pylist()))


def log_scores(docs: DataFrame, trained: Trained, *more: str) -> DataFrame:
    """Documents (text, more) with n_tokens, n_known, base_score and score; text is dropped."""
    spark = docs.sparkSession
    bounded_batches(spark)
    whole = trained.n + 1 * (trained.v + 1)
    top = spark.sparkContext.broadcast({
        w: float(np.log10((c + 1) / whole)) for w, c in _top_words(trained.words, TOP_WORDS).items()})
    stored = bool(trained.longer)
    model = spark.sparkContext.broadcast(trained.model.with_longer(trained.hot))
    kept = [f"__{k}" for k in range(len(more))]

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, trie = top.value, model.value
        for batch in slices(batches, limit=SCORED_BYTES):
            texts = as_bytes(batch.column("text"))
            tokens, known, base, rare, times = [], [], [], [], []
            for t in texts:
                words = t.lower().split()
                words.append(b"")
                found = list(filter(None, map(logs.get, words)))
                rest = Counter(w for w in words if w not in logs) if len(found) < len(words) else {}
                tokens.append(len(words))
                known.append(len(found))
                base.append(sum(found))
                rare.append(list(rest))
                times.append(list(rest.values()))
            scores, codes, code_times = trie.score_known(texts) if stored else (
                trie.score(texts), [[]] * len(texts), [[]] * len(texts))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(tokens, pa.int64()),
                 pa.array(known, pa.int64()), pa.array(base, pa.float64()),
                 pa.array(scores, pa.float64()), pa.array(rare, pa.list_(pa.binary())),
                 pa.array(times, pa.list_(pa.int64())), pa.array(codes, pa.list_(pa.int64())),
                 pa.array(code_times, pa.list_(pa.int64()))],
                [*kept, "n_tokens", "known", "base", "score", "rare", "times", "codes", "code_times"])

    source = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(more, kept)], "text")
    fields = source.select(*kept, *[F.lit(v).cast(t).alias(n) for n, v, t in (
        ("n_tokens", 0, "long"), ("known", 0, "long"), ("base", 0, "double"),
        ("score", 0, "double"), ("rare", None, "array<binary>"), ("times", None, "array<long>"),
        ("codes", None, "array<long>"), ("code_times", None, "array<long>"))])
    rows = materialize(source.mapInArrow(emit, fields.schema).withColumn(
        "__row", F.monotonically_increasing_id()), "scored")
    asked = rows.select("__row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select(
        "__row", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    met = asked.join(trained.words, "word", "left").groupBy("__row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more"),
        F.sum(F.col("times") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(whole)))).alias(
            "rest"))
    if stored:
        places = rows.select("__row", F.explode(F.arrays_zip("codes", "code_times")).alias("r")).select(
            "__row", F.col("r.codes").alias("code"), F.col("r.code_times").alias("times"))
        logs = _joined_logs(places.select("code").distinct(), trained)
        deep = places.join(logs, "code").groupBy("__row").agg(F.sum(F.col("times") * F.col("log")).alias("deep"))
        rows = rows.join(deep, "__row", "left").withColumn(
            "score", F.col("score") + F.coalesce("deep", F.lit(0.0)))
    return rows.join(met, "__row", "left").select(
        *[F.col(k).alias(c) for c, k in zip(more, kept)], "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), "score")

