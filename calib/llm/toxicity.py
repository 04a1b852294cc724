"""Toxicity scores by a bidirectional gated recurrent network with attention pooling.

A word enters the network as two inputs: an embedding of the word itself and the mean
embedding of its character n-grams, both looked up by hash.  Two recurrent passes read a
window of words from either end, attention pools their states, and a logistic unit gives
the window's score.  Windows overlap by half and cover the whole text; a document has the
score of its highest window.

Training is numpy on the driver over a bounded sample: at most ``sample`` labelled texts
per class, drawn by hash from those of at most ``longest`` characters.  Only documents
carry labels, so the window that stands for a toxic document is found by word and n-gram
log-odds first and by the network itself afterwards; clean documents give their highest
window and others drawn at random.  Everything is a function of the seed.

Scoring is map-only.  The inputs of both passes depend on the word alone and are
remembered for recent words, so a window costs only the recurrent part.

Defined cases: NULL and empty texts are one window of padding; repeated rows get the same
score; without labels of both classes every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calib.llm.blocks import as_bytes, bounded_batches, mixed, ranges, slices

WINDOW, STRIDE = 32, 16
WORDS, GRAMS = 1 << 13, 1 << 14
WORD_DIM, GRAM_DIM, HIDDEN = 8, 12, 8
SAMPLE, LONGEST = 2500, 20_000
GRAM_SIZES = (3, 4)
RECENT = 200_000
LEAST_STEPS, MOST_EPOCHS = 150, 60


def gram_ids(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of words with marked ends, and the count per word."""
    marked = [b"<" + w + b">" for w in words]
    data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    sizes = np.array([len(m) for m in marked], np.int64)
    ends = np.repeat(np.cumsum(sizes), sizes)
    place = np.arange(len(data))
    found = []
    owner = np.repeat(np.arange(len(words)), sizes)
    for n in GRAM_SIZES:
        fits = np.flatnonzero(place + n <= ends)
        code = np.full(len(fits), n, np.uint64)
        for k in range(n):
            code = (code << np.uint64(8)) | data[fits + k]
        found.append((owner[fits], mixed(code) % np.uint64(GRAMS)))
    owners = np.concatenate([f[0] for f in found])
    ids = np.concatenate([f[1] for f in found]).astype(np.int64)
    by = np.argsort(owners, kind="stable")
    return ids[by], np.bincount(owners, minlength=len(words))


def word_ids(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) % WORDS for w in words], np.int64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def window_starts(n: int) -> np.ndarray:
    """First words of the windows over n words."""
    return np.arange(0, max(n - WINDOW + STRIDE, 1), STRIDE)


@dataclass
class Network:
    """Parameters by name; all float32."""

    p: dict[str, np.ndarray]

    @staticmethod
    def new(seed: int) -> Network:
        rng = np.random.default_rng(seed)
        dim = WORD_DIM + GRAM_DIM
        p = {"word": rng.normal(0, 0.1, (WORDS, WORD_DIM)),
             "gram": rng.normal(0, 0.1, (GRAMS, GRAM_DIM)),
             "att": rng.normal(0, 0.3, 2 * HIDDEN), "out": rng.normal(0, 0.3, 2 * HIDDEN),
             "bias": np.array([-2.0])}
        for d in "fb":
            p[f"wx_{d}"] = rng.normal(0, dim ** -0.5, (dim, 3 * HIDDEN))
            p[f"wh_{d}"] = rng.normal(0, HIDDEN ** -0.5, (HIDDEN, 3 * HIDDEN))
            p[f"b_{d}"] = np.zeros(3 * HIDDEN)
        return Network({k: v.astype(np.float32) for k, v in p.items()})

    def inputs(self, words: list[bytes]) -> np.ndarray:
        """Word and character inputs, one row per word."""
        ids, sizes = gram_ids(words)
        starts = np.cumsum(sizes) - sizes
        mean = np.add.reduceat(self.p["gram"][ids], starts) / sizes[:, None]
        return np.concatenate([self.p["word"][word_ids(words)], mean], 1).astype(np.float32)

    def gates(self, x: np.ndarray) -> np.ndarray:
        """Input parts of the gates of both directions, last axis (f: z r n, b: z r n)."""
        return np.concatenate(
            [x @ self.p["wx_f"] + self.p["b_f"], x @ self.p["wx_b"] + self.p["b_b"]], -1)

    def states(self, gates: np.ndarray, ids: np.ndarray, keep: bool = False):
        """Hidden states (n, WINDOW, 2 HIDDEN); ``ids`` (n, WINDOW) are rows of ``gates``."""
        n, t = ids.shape
        out = np.empty((n, t, 2 * HIDDEN), np.float32)
        trace = []
        for side, d in enumerate("fb"):
            h = np.zeros((n, HIDDEN), np.float32)
            wh = self.p[f"wh_{d}"]
            zr_w, n_w = np.ascontiguousarray(wh[:, :2 * HIDDEN]), np.ascontiguousarray(
                wh[:, 2 * HIDDEN:])
            own = np.ascontiguousarray(gates[:, side * 3 * HIDDEN:(side + 1) * 3 * HIDDEN])
            for k in (range(t) if d == "f" else range(t - 1, -1, -1)):
                g = own[ids[:, k]]
                zr = g[:, :2 * HIDDEN] + h @ zr_w
                np.tanh(zr * np.float32(0.5), out=zr)
                zr *= np.float32(0.5)
                zr += np.float32(0.5)
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                rh = r * h
                new = np.tanh(g[:, 2 * HIDDEN:] + rh @ n_w)
                if keep:
                    trace.append((side, k, h, zr, rh, new))
                h = h + z * (new - h)
                out[:, k, side * HIDDEN:(side + 1) * HIDDEN] = h
        return (out, trace) if keep else out

    def pooled(self, states: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Attention weights over the real words, and the pooled states."""
        a = states @ self.p["att"]
        a = np.where(real, a, -1e9)
        a = np.exp(a - a.max(1, keepdims=True))
        a /= a.sum(1, keepdims=True)
        return a, np.einsum("nt,nth->nh", a, states)

    def windows(self, gates: np.ndarray, ids: np.ndarray, block: int = 2048) -> np.ndarray:
        """Scores of windows; ``ids`` 0 is padding."""
        out = []
        for k in range(0, len(ids), block):
            part = ids[k:k + block]
            real = part > 0
            real[:, 0] = True
            _, pool = self.pooled(self.states(gates, part), real)
            out.append(sigmoid(pool @ self.p["out"] + self.p["bias"][0]))
        return np.concatenate(out) if out else np.zeros(0, np.float32)


class Reader:
    """Rows of gate inputs for words; row 0 is padding."""

    def __init__(self, net: Network):
        self.net = net
        self.clear()

    def clear(self) -> None:
        self.row: dict[bytes, int] = {}
        self.gates = np.zeros((1, 6 * HIDDEN), np.float32)
        self.gates[0] = self.net.gates(np.zeros((1, WORD_DIM + GRAM_DIM), np.float32))[0]

    def ids(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        if len(self.row) > RECENT:
            self.clear()
        row = self.row
        new = list({w for words in texts for w in words if w not in row})
        for k, w in enumerate(new):
            row[w] = len(self.gates) + k
        for k in range(0, len(new), 50_000):
            part = self.net.gates(self.net.inputs(new[k:k + 50_000]))
            self.gates = np.concatenate([self.gates, part])
        return [np.fromiter(map(row.__getitem__, words), np.int64, len(words)) for words in texts]


def cut(ids: np.ndarray) -> np.ndarray:
    """All windows (n, WINDOW) of one text, padded with 0."""
    starts = window_starts(len(ids))
    padded = np.zeros(starts[-1] + WINDOW, np.int64)
    padded[:len(ids)] = ids
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[starts]


def score_texts(net: Network, reader: Reader, texts: list[bytes]) -> np.ndarray:
    """The highest window score of each text."""
    all_ids = reader.ids([t.lower().split() for t in texts])
    parts = [cut(i) for i in all_ids]
    sizes = np.array([len(p) for p in parts])
    scores = net.windows(reader.gates, np.concatenate(parts))
    return np.maximum.reduceat(scores, np.cumsum(sizes) - sizes)


def _backward(net: Network, x: np.ndarray, ids: np.ndarray, y: np.ndarray
              ) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of the mean log loss over windows, and with respect to the inputs ``x``."""
    p = net.p
    gates = net.gates(x)
    states, trace = net.states(gates, ids, keep=True)
    real = ids > 0
    real[:, 0] = True
    a, pool = net.pooled(states, real)
    d_logit = ((sigmoid(pool @ p["out"] + p["bias"][0]) - y) / len(y)).astype(np.float32)
    grad = {"out": pool.T @ d_logit, "bias": np.array([d_logit.sum()], np.float32)}
    d_pool = d_logit[:, None] * p["out"]
    d_a = np.einsum("nh,nth->nt", d_pool, states)
    d_s = a * (d_a - (a * d_a).sum(1, keepdims=True))
    grad["att"] = np.einsum("nt,nth->h", d_s, states)
    d_states = a[:, :, None] * d_pool[:, None, :] + d_s[:, :, None] * p["att"]
    d_gates = np.zeros((*ids.shape, 6 * HIDDEN), np.float32)
    for side, d in enumerate("fb"):
        wh = p[f"wh_{d}"]
        d_wh = np.zeros_like(wh)
        carry = np.zeros((len(ids), HIDDEN), np.float32)
        for s, k, h, zr, rh, new in reversed(trace):
            if s != side:
                continue
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            d_h = d_states[:, k, side * HIDDEN:(side + 1) * HIDDEN] + carry
            d_new = d_h * z * (1 - new * new)
            d_rh = d_new @ wh[:, 2 * HIDDEN:].T
            d_zr = np.concatenate([d_h * (new - h), d_rh * h], 1) * zr * (1 - zr)
            d_wh[:, :2 * HIDDEN] += h.T @ d_zr
            d_wh[:, 2 * HIDDEN:] += rh.T @ d_new
            carry = d_h * (1 - z) + d_rh * r + d_zr @ wh[:, :2 * HIDDEN].T
            base = side * 3 * HIDDEN
            d_gates[:, k, base:base + 2 * HIDDEN] = d_zr
            d_gates[:, k, base + 2 * HIDDEN:base + 3 * HIDDEN] = d_new
        grad[f"wh_{d}"] = d_wh
    flat = np.zeros((len(x), 6 * HIDDEN), np.float32)
    np.add.at(flat, ids.ravel(), d_gates.reshape(-1, 6 * HIDDEN))
    d_x = np.zeros_like(x)
    for side, d in enumerate("fb"):
        own = flat[:, side * 3 * HIDDEN:(side + 1) * 3 * HIDDEN]
        grad[f"wx_{d}"], grad[f"b_{d}"] = x.T @ own, own.sum(0)
        d_x += own @ p[f"wx_{d}"].T
    d_x[0] = 0
    return grad, d_x


class Words:
    """The different words of the training texts with their hashed inputs, from row 1 on."""

    def __init__(self, texts: list[bytes]):
        row: dict[bytes, int] = {}
        self.texts = [np.array([row.setdefault(w, len(row) + 1) for w in t.lower().split()], np.int64)
                      for t in texts]
        self.words = list(row)
        self.ids = word_ids(self.words)
        self.grams, self.sizes = gram_ids(self.words) if self.words else (
            np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def inputs(self, net: Network, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs of word rows (1-based), with the n-grams used and their owners."""
        k = rows - 1
        n = self.sizes[k]
        owner = np.repeat(np.arange(len(k)), n)
        grams = self.grams[np.repeat(self.starts[k], n) + ranges(n)]
        total = np.zeros((len(k), GRAM_DIM), np.float32)
        for j in range(GRAM_DIM):
            total[:, j] = np.bincount(owner, net.p["gram"][grams, j], len(k))
        x = np.concatenate([net.p["word"][self.ids[k]], total / n[:, None]], 1)
        return x.astype(np.float32), grams, owner

    def odds(self, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log-odds to occur in toxic texts, by word bucket, by n-gram bucket, and per row."""
        def logs(ids_of: Iterable[np.ndarray], size: int) -> np.ndarray:
            hit = np.full((2, size), 0.5)
            for ids, y in zip(ids_of, labels):
                hit[int(y)][np.unique(ids)] += 1
            share = hit / (np.bincount(labels.astype(int), minlength=2)[:, None] + 1)
            # A rare input proves little: the odds shrink with the texts that hold it.
            return np.log(share[1] / share[0]) * np.minimum(1, hit.sum(0) / 20)
        by_word = logs((self.ids[t - 1] for t in self.texts), WORDS)
        grams_of = (self.grams[np.repeat(self.starts[t - 1], self.sizes[t - 1]) + ranges(
            self.sizes[t - 1])] for t in self.texts)
        by_gram = logs(grams_of, GRAMS)
        most = np.maximum.reduceat(by_gram[self.grams], self.starts) if len(self.words) else np.zeros(0)
        return by_word, by_gram, np.concatenate([[0.0], by_word[self.ids] + most])


def train(texts: list[bytes], labels: np.ndarray, seed: int = 1, epochs: int = 8, batch: int = 256,
          rate: float = 0.01) -> Network:
    """A network from labelled texts."""
    net = Network.new(seed)
    rng = np.random.default_rng(seed)
    data = Words(texts)
    windows = [cut(t) for t in data.texts]
    sizes = np.array([len(w) for w in windows])
    stacked = np.concatenate(windows)
    starts = np.cumsum(sizes) - sizes
    by_word, by_gram, odds = data.odds(labels)
    # One dimension of each embedding starts at the log-odds, so that few labels suffice.
    net.p["word"][:, 0] = by_word
    net.p["gram"][:, 0] = by_gram
    guess = np.sort(odds[stacked], 1)[:, -3:].sum(1)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    # Small samples are read more often, so that the network sees enough batches.
    again = -(-LEAST_STEPS * batch // max(len(texts), 1))
    for epoch in range(max(epochs, min(again, MOST_EPOCHS))):
        if epoch >= 2 and epoch % 2 == 0:
            rows = np.arange(1, len(data.words) + 1)
            gates = np.concatenate([net.gates(np.zeros((1, WORD_DIM + GRAM_DIM), np.float32))] + [
                net.gates(data.inputs(net, rows[k:k + 50_000])[0])
                for k in range(0, len(rows), 50_000)])
            guess = net.windows(gates, stacked)
        chosen, truth = [], []
        for s, n, y in zip(starts, sizes, labels):
            best = s + int(np.argmax(guess[s:s + n]))
            chosen.append(best)
            truth.append(y)
            if not y and n > 1:
                chosen.append(s + int(rng.integers(n)))
                truth.append(0)
        chosen, truth = np.array(chosen), np.array(truth, np.float32)
        order = rng.permutation(len(chosen))
        for k in range(0, len(order), batch):
            part = order[k:k + batch]
            rows, ids = np.unique(stacked[chosen[part]], return_inverse=True)
            ids = ids.reshape(len(part), WINDOW)
            if rows[0] == 0:
                rows = rows[1:]
            else:
                ids = ids + 1
            own, grams, owner = data.inputs(net, rows) if len(rows) else (
                np.zeros((0, WORD_DIM + GRAM_DIM), np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64))
            x = np.concatenate([np.zeros((1, WORD_DIM + GRAM_DIM), np.float32), own])
            grad, d_x = _backward(net, x, ids, truth[part])
            d_own = d_x[1:]
            grad["word"] = np.zeros_like(net.p["word"])
            np.add.at(grad["word"], data.ids[rows - 1], d_own[:, :WORD_DIM])
            share = d_own[:, WORD_DIM:] / np.maximum(data.sizes[rows - 1], 1)[:, None]
            grad["gram"] = np.stack([np.bincount(grams, share[owner, j], GRAMS)
                                     for j in range(GRAM_DIM)], 1).astype(np.float32)
            step += 1
            for name, g in grad.items():
                m, v = moments[name]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                fix = rate * np.sqrt(1 - 0.99 ** step) / (1 - 0.9 ** step)
                net.p[name] -= (fix * m / (np.sqrt(v) + 1e-7)).astype(np.float32)
    return net


def training_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, longest: int = LONGEST
                    ) -> tuple[list[bytes], np.ndarray]:
    """Texts and labels of at most ``sample`` documents per class.

    ``docs`` holds (doc_id, text), ``labels`` (doc_id, label).  The ids are drawn from the
    lengths alone; their texts are then read with a join to at most 2 * sample ids.
    """
    short = F.length("text") <= longest
    sized = docs.where(short).select("doc_id").join(labels, "doc_id").dropDuplicates(["doc_id"])
    drawn = [sized.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
             for y in (0, 1)]
    ids = [(r["doc_id"], int(r["label"])) for d in drawn for r in d.collect()]
    wanted = docs.sparkSession.createDataFrame(ids, "doc_id long, label int")
    rows = docs.where(short).join(F.broadcast(wanted), "doc_id").select("label", "text").toArrow()
    pairs = sorted(zip(rows.column("label").to_pylist(),
                       as_bytes(rows.column("text").combine_chunks()))) if rows.num_rows else []
    return [t for _, t in pairs], np.array([y for y, _ in pairs], np.int64)


def toxicity_scores(docs: DataFrame, net: Network | None) -> DataFrame:
    """Documents (doc_id, text) to (doc_id, score) in double precision."""
    bounded_batches(docs.sparkSession)
    if net is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in slices(batches):
            scores = score_texts(shared.value, reader, as_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores.astype(np.float64))], ["doc_id", "score"])

    return docs.mapInArrow(emit, "doc_id long, score double")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, longest: int = LONGEST,
        seed: int = 1) -> Network | None:
    """A network from labelled documents, or None where a class is missing."""
    texts, truth = training_sample(docs, labels, sample, longest)
    if len(set(truth.tolist())) < 2:
        return None
    return train(texts, truth, seed)
