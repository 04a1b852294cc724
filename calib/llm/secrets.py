"""Secrets in texts by rules, through an inverted index of trigrams.

From each rule's regular expression a Boolean query over trigrams is derived: every part
of the expression with a few possible strings must occur as one of them, and a string
occurs only where all its trigrams do.  The index holds, for each trigram that some query
names, the documents that contain it.  Intersecting the postings of a clause, and uniting
clauses, gives the candidates of a rule, and only these are searched with the expression.
A rule without mandatory trigrams searches all documents.

Everything that runs on rows is DataFrame functions.  Positions are code points; matches
are leftmost and do not overlap within a rule; matches shorter than the rule asks are
dropped after matching.

Defined cases: NULL and empty texts have no spans; rows without doc_id cannot be looked
up in the index and are searched with all rules; rows that repeat a doc_id share its
candidates and are each searched; spans of different rules may overlap.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most strings that one part of an expression may expand into.
STRINGS = 64
MARK, STAND_IN = "￿", "￾"


@dataclass(frozen=True)
class Rule:
    """``least`` is the length asked of group ``group`` (0: the whole match)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
         r"([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
MORE = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge_token", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)


def _strings(item) -> set[str] | None:
    """All strings one parsed item can match, or None when they are many."""
    op, arg = item
    if op is C.LITERAL:
        return {chr(arg)}
    if op is C.IN:
        found: set[str] = set()
        for kind, value in arg:
            if kind is C.LITERAL:
                found.add(chr(value))
            elif kind is C.RANGE and value[1] - value[0] < STRINGS:
                found |= {chr(k) for k in range(value[0], value[1] + 1)}
            else:
                return None
        return found if len(found) <= STRINGS else None
    if op is C.SUBPATTERN:
        return _sequence(arg[3])
    if op is C.BRANCH:
        parts = [_sequence(b) for b in arg[1]]
        return None if None in parts else set().union(*parts)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        low, high, inner = arg
        one = _sequence(inner)
        if one is None or high > 4:
            return None
        return {"".join(p) for n in range(low, high + 1) for p in product(one, repeat=n)}
    return None


def _sequence(items) -> set[str] | None:
    whole = {""}
    for item in items:
        own = _strings(item)
        if own is None or len(whole) * len(own) > STRINGS:
            return None
        whole = {a + b for a in whole for b in own}
    return whole


def _parts(items) -> list[set[str]]:
    """Sets of strings, one of each of which every match contains, in order."""
    runs: list[set[str]] = []
    run = {""}
    for item in items:
        op, arg = item
        if op is C.SUBPATTERN and _strings(item) is None:
            runs += [run, *_parts(arg[3])]
            run = {""}
            continue
        own = _strings(item)
        if own is None:
            if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0]:
                runs += [run, *_parts(arg[2])]
            else:
                runs.append(run)
            run = {""}
        elif len(run) * len(own) > STRINGS:
            runs.append(run)
            run = own
        else:
            run = {a + b for a in run for b in own}
    return [*runs, run]


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Clauses of lower-case trigrams; a match needs all of some clause.  Empty: no need.

    The best part is used: the one whose weakest string has the most trigrams.
    """
    best: list[frozenset[str]] = []
    weight = 0
    for part in _parts(_parser.parse(pattern)):
        clauses = [frozenset(s.lower()[k:k + 3] for k in range(len(s) - 2)) for s in part]
        least = min((len(c) for c in clauses), default=0)
        if least > weight:
            best, weight = clauses, least
    # A clause that asks for more than another one adds nothing.
    return sorted({c for c in best if not any(o < c for o in best)}, key=sorted)


def postings(docs: DataFrame, trigrams: Sequence[str]) -> DataFrame:
    """(trigram, doc_id): the inverted index of documents (doc_id, text) over ``trigrams``."""
    lower = F.lower("text")
    present = F.filter(F.array(*[F.lit(t) for t in trigrams]), lambda t: F.contains("__low", t))
    return docs.where("doc_id IS NOT NULL").select("doc_id", lower.alias("__low")).select(
        "doc_id", F.explode(present).alias("trigram"))


def candidates(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(doc_id, rules): places in ``rules`` of those whose trigram query a document meets."""
    clauses = [(r, k, t, len(c)) for r, rule in enumerate(rules)
               for k, c in enumerate(trigram_query(rule.pattern)) for t in sorted(c)]
    spark = docs.sparkSession
    if not clauses:
        return spark.createDataFrame([], "doc_id long, rules array<int>")
    table = spark.createDataFrame(clauses, "rule int, clause int, trigram string, size int")
    index = postings(docs, sorted({c[2] for c in clauses}))
    # The clauses come from the rules alone, a few dozen rows.
    met = index.join(F.broadcast(table), "trigram").groupBy("doc_id", "rule", "clause").agg(
        F.size(F.collect_set("trigram")).alias("n"), F.first("size").alias("size"))
    return met.where("n = size").groupBy("doc_id").agg(F.collect_set("rule").alias("rules"))


def _found(rule: Rule, place: int) -> Column:
    """Spans (start, kind, end) of a rule in ``__text``; kind is the rule's place."""
    pieces = F.split(F.regexp_replace("__text", rule.pattern, f"{MARK}$0{MARK}"), MARK)
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def step(state: Column, piece: Column) -> Column:
        end = state["at"] + F.length(piece)
        size = F.length(F.regexp_extract(piece, rule.pattern, rule.group))
        span = F.struct(state["at"].alias("start"), F.lit(place).alias("kind"), end.alias("end"))
        return F.struct(
            end.alias("at"), (~state["inside"]).alias("inside"),
            F.when(state["inside"] & (size >= rule.least),
                   F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), none.alias("spans"))
    return F.aggregate(pieces, start, step, lambda state: state["spans"])


def secret_spans(docs: DataFrame, rules: Sequence[Rule] = (*BASE, *MORE), key: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """(doc_id, spans): per row the spans (start, kind, end) of all rules, in that order."""
    source = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(
        F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    free = [r for r, rule in enumerate(rules) if not trigram_query(rule.pattern)]
    joined = source.join(candidates(source, rules), "doc_id", "left")
    # Matches are cut out with a mark; a text's own marks give way to a like character.
    marked = joined.select("doc_id", "rules", F.when(
        F.contains("text", F.lit(MARK)), F.translate("text", MARK, STAND_IN)).otherwise(
        F.col("text")).alias("__text"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    parts = []
    for place, rule in enumerate(rules):
        spans = _found(rule, place)
        if place not in free:
            asked = F.col("doc_id").isNull() | F.coalesce(
                F.array_contains("rules", place), F.lit(False))
            spans = F.when(asked, spans).otherwise(none)
        parts.append(spans)
    return marked.select("doc_id", F.array_sort(F.concat(*parts)).alias("spans"))


def count_of(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def spelled(spans: Column, rules: Sequence[Rule]) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
