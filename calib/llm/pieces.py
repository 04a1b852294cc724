"""SentencePiece encoding of the merge type by backtracking, and decoding.

A segment is encoded without a merge queue.  An Aho-Corasick automaton over the
reachable pieces gives the longest piece that starts at each place.  Going left to
right, a piece is taken when it is compatible with the one before, that is, when
merging the text of the two anew gives the same two pieces.  Otherwise the next
shorter piece that starts there is tried; when none is left, the place is marked in a
bitfield as failed and the piece before is taken back.  A sequence in which all
neighbours are compatible is the one that merging the whole text would give.

Merging two pieces anew is followed backwards: of the two neighbours at the border the one
merged last is taken apart, and at no point may the two then at the border merge earlier.

Pieces hold the space sign only at their start, so a text falls into segments, a run of
spaces and what follows it, that never share a piece; characters outside all pieces
stand alone as byte pieces.  Recent segments are remembered in each worker.

Defined cases: NULL and empty texts have no pieces but the end id; texts of any length
are taken whole; repeated rows give repeated results; other columns are kept as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calib.llm.blocks import as_bytes, bounded_batches, list_array, slices

SPACE = "▁"
MEMORY = 250_000
LONGEST_KEPT = 64
LAST = float("inf")
NONE = -1


class Vocabulary:
    """What the codec needs of a model file: pieces, scores, byte pieces, end id."""

    def __init__(self, model: str):
        import sentencepiece

        with open(model, "rb") as f:
            sp = sentencepiece.SentencePieceProcessor(model_proto=f.read())
        n = sp.vocab_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.scores = [sp.get_score(i) for i in range(n)]
        self.hidden = [sp.is_control(i) or sp.is_unknown(i) for i in range(n)]
        self.bytes = {i: int(p[3:5], 16) for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.end = sp.eos_id()
        if len(self.bytes) != 256 or any(sp.is_unused(i) for i in range(n)):
            raise ValueError("the model needs byte fallback and no unused pieces")
        if sp.encode(" a", out_type=str) and sp.decode(sp.encode("  a ")) != "  a ":
            raise ValueError("the model must keep white space as it is")
        if any(SPACE in p.lstrip(SPACE) for p in self.pieces):
            raise ValueError("pieces must hold spaces only at their start")


class Codec:
    """Encoder and decoder over one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = v = vocabulary
        self.rank = {p: (-v.scores[i], i) for i, p in enumerate(v.pieces)
                     if not v.hidden[i] and i not in v.bytes}
        self.id_of = {p: i for p, (_, i) in self.rank.items()}
        self.order = {p: r for p, (r, _) in self.rank.items()}
        letters = set("".join(self.rank))
        if missing := [c for c in letters if c not in self.rank]:
            raise ValueError(f"{len(missing)} characters are no pieces of their own")
        self.byte_ids = [0] * 256
        for i, b in v.bytes.items():
            self.byte_ids[b] = i
        self.length = [len(p) for p in v.pieces]
        # Pieces that merging cannot reach never occur and stay out of the automaton.
        cuts = {p: cut for p in self.rank for parts, cut in [self.merged(p)] if parts == [p]}
        reachable = list(cuts)
        self.automaton = ahocorasick.Automaton()
        for p in reachable:
            self.automaton.add_word(p, (self.id_of[p], len(p)))
        self.automaton.make_automaton()
        known = set(reachable)
        self.shorter = [NONE] * len(v.pieces)
        for p in reachable:
            for k in range(len(p) - 1, 0, -1):
                if p[:k] in known:
                    self.shorter[self.id_of[p]] = self.id_of[p[:k]]
                    break
        # The two parts a piece is merged from; single characters have none and come first.
        self.left, self.right = [NONE] * len(v.pieces), [NONE] * len(v.pieces)
        self.time = [-LAST] * len(v.pieces)
        # Whether all parts of a piece are merged before it, so that merges go by rank.
        self.in_turn = [False] * len(v.pieces)
        for p in sorted(reachable, key=len):
            i, cut = self.id_of[p], cuts[p]
            if len(p) == 1:
                self.in_turn[i] = True
            elif p[:cut] in known and p[cut:] in known:
                a, b = self.id_of[p[:cut]], self.id_of[p[cut:]]
                self.left[i], self.right[i], self.time[i] = a, b, self.order[p]
                self.in_turn[i] = self.in_turn[a] and self.in_turn[b] and max(
                    self.time[a], self.time[b]) < self.time[i]
        inside = "".join(re.escape(c) for c in sorted(letters - {SPACE}))
        self.segments = re.compile(f"{SPACE}+[{inside}]*|[{inside}]+|[^{inside}{SPACE}]").findall
        self.letters = letters
        self.pairs = Pairs(self)
        self.recent = Recent(self)

    def merged(self, text: str) -> tuple[list[str], int]:
        """Repeated merging of the best neighbours, leftmost first; for short texts.

        Also the length of the left part of the last merge.
        """
        parts, cut = list(text), 0
        order = self.order.get
        ranks = [order(a + b, LAST) for a, b in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) != LAST:
            k = ranks.index(best)
            cut = len(parts[k])
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k]
            # Only the pairs beside the merged part have changed.
            if k:
                ranks[k - 1] = order(parts[k - 1] + parts[k], LAST)
            if k < len(ranks):
                ranks[k] = order(parts[k] + parts[k + 1], LAST)
        return parts, cut

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the text of two pieces anew gives the two."""
        pieces = self.vocabulary.pieces
        if not (self.in_turn[a] and self.in_turn[b]):
            return self.merged(pieces[a] + pieces[b])[0] == [pieces[a], pieces[b]]
        time, order = self.time, self.order.get
        limit, also = LAST, False
        while True:
            met = order(pieces[a] + pieces[b], LAST)
            # Of merges of one rank, also of pieces with equal scores, the left one comes first.
            if met < limit or also and met == limit:
                return False
            if time[a] > time[b]:
                limit, also, a = time[a], False, self.right[a]
            elif (limit := time[b]) == -LAST:
                return True
            else:
                also, b = True, self.left[b]

    def backtrack(self, text: str) -> list[int]:
        """Ids of a segment all of whose characters are pieces."""
        n = len(text)
        longest_from, longest = self.automaton.iter_long, []
        if n > LONGEST_KEPT:  # every look-up copies the text
            longest = [NONE] * n
            for end, (piece, length) in self.automaton.iter(text):
                longest[end - length + 1] = piece
        lengths, shorter, compatible = self.length, self.shorter, self.pairs
        failed, some_failed = bytearray(n // 8 + 1), False
        taken: list[int] = []
        at, piece, before = 0, longest[0] if longest else next(longest_from(text))[1][0], NONE
        while True:
            end = at + lengths[piece]
            if not (some_failed and failed[end >> 3] >> (end & 7) & 1) and (
                    before == NONE or compatible[before, piece]):
                taken.append(piece)
                if end == n:
                    return taken
                at, before = end, piece
                piece = longest[end] if longest else next(longest_from(text, end))[1][0]
                continue
            piece = shorter[piece]
            if piece == NONE:
                failed[at >> 3] |= 1 << (at & 7)
                some_failed = True
                piece = taken.pop()
                at -= lengths[piece]
                before = taken[-1] if taken else NONE

    def segment(self, text: str) -> tuple[tuple[int, ...], str]:
        """Ids of a segment and what they decode to."""
        if text[0] in self.letters:
            ids = tuple(self.backtrack(text))
            # No byte pieces and no hidden ones among them; together they spell the segment.
            return ids, text.replace(SPACE, " ")
        ids = tuple(self.byte_ids[b] for b in text.encode())
        return ids, self.spell(ids)

    def parts(self, text: str) -> list[tuple[tuple[int, ...], str]]:
        """(ids, spelling) of each segment of a text."""
        if not text:
            return []
        return list(map(self.recent.__getitem__, self.segments(SPACE + text.replace(" ", SPACE))))

    def encode(self, text: str) -> list[int]:
        return [i for ids, _ in self.parts(text) for i in ids]

    def spell(self, ids: Iterable[int]) -> str:
        """The text of ids, with every space sign as a space; bad bytes give U+FFFD each."""
        out: list[str] = []
        held = bytearray()
        pieces, of_byte, hidden = (
            self.vocabulary.pieces, self.vocabulary.bytes, self.vocabulary.hidden)
        for i in ids:
            b = of_byte.get(i)
            if b is not None:
                held.append(b)
                continue
            if held:
                out.append(spell_bytes(bytes(held)))
                held.clear()
            if not hidden[i]:
                out.append(pieces[i].replace(SPACE, " "))
        if held:
            out.append(spell_bytes(bytes(held)))
        return "".join(out)

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; the space that encoding puts before a text is taken off."""
        ids = list(ids)
        text = self.spell(ids)
        while ids and self.vocabulary.hidden[ids[0]]:
            ids.pop(0)
        return text[1:] if ids and self.vocabulary.pieces[ids[0]].startswith(SPACE) else text


class Pairs(dict):
    """(left, right) to whether merging their text anew gives the two.

    Its size is bounded: when it is full, its entries become the older generation, from which
    those asked for again come back.
    """

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec
        self.older: dict[tuple[int, int], bool] = {}

    def __missing__(self, key: tuple[int, int]) -> bool:
        known = self.older.get(key)
        if known is None:
            known = self.codec.compatible(*key)
        if len(self) >= MEMORY // 2:
            self.older = self.copy()
            self.clear()
        self[key] = known
        return known


class Recent(dict):
    """Segment to (ids, spelling), for recent short segments; bounded as ``Pairs`` is."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec
        self.older: dict[str, tuple[tuple[int, ...], str]] = {}

    def __missing__(self, text: str) -> tuple[tuple[int, ...], str]:
        part = self.older.get(text) or self.codec.segment(text)
        if len(text) <= LONGEST_KEPT:
            if len(self) >= MEMORY // 2:
                self.older = self.copy()
                self.clear()
            self[text] = part
        return part


def spell_bytes(data: bytes) -> str:
    """UTF-8 text of byte pieces; every byte outside a whole character gives U+FFFD."""
    out = []
    k = 0
    while k < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[k:k + n].decode())
                k += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            k += 1
    return "".join(out)


@lru_cache(maxsize=2)
def _codec(key: str, holder) -> Codec:
    return Codec(holder.value)


def round_trip(docs: DataFrame, model: str, text: str = "text", ids: str = "ids",
               decoded: str = "decoded") -> DataFrame:
    """``docs`` with the ids of each text, the end id last, and the text decoded from them.

    The vocabulary goes to the tasks as one broadcast; its size is that of the model file.
    The work is map-only: nothing is shuffled.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    vocabulary = Vocabulary(model)
    holder = spark.sparkContext.broadcast(vocabulary)
    kept = [c for c in docs.columns if c not in (ids, decoded)]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(
        F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text"))
    schema = docs.select(*[F.col(f"`{c}`") for c in kept], F.array(F.lit(0)).alias(ids),
                         F.lit("").alias(decoded)).schema
    end = vocabulary.end

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model, holder)
        for batch in slices(batches, "__text"):
            all_ids, lengths, texts = [], [], []
            for raw in as_bytes(batch.column("__text")):
                parts = codec.parts(raw.decode())
                own = list(chain.from_iterable(map(itemgetter(0), parts)))
                own.append(end)
                all_ids.append(np.array(own, np.int32))
                lengths.append(len(own))
                texts.append("".join(map(itemgetter(1), parts)).removeprefix(" "))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept],
                 list_array(np.concatenate(all_ids), np.array(lengths), pa.int32()),
                 pa.array(texts, pa.string())], [*kept, ids, decoded])

    return source.mapInArrow(encode, schema)
