"""Fingerprint links, stratified search and source divergence against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from calib.llm import bitslice, divergence, strata
from calib.llm.chunks import NOT_ALNUM, SPACE, chunks
from conftest import words

SF_DIR = "/root/testdata/sf0.001"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# -- fingerprints ------------------------------------------------------------

def brute_print(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    runs = [" ".join(found[i:i + 3]) for i in range(max(len(found) - 2, 1))] if found else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def brute_components(rows, radius):
    """(doc_id, fingerprint, smallest reachable doc_id) of (doc_id, print) rows."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (a, x) in enumerate(rows):
        for j, (b, y) in enumerate(rows[:i]):
            if (x ^ y).bit_count() <= radius or (a is not None and a == b):
                root[find(i)] = find(j)
    reach = defaultdict(list)
    for i, (a, _) in enumerate(rows):
        if a is not None:
            reach[find(i)].append(a)
    return [(a, f"{x:016x}", min(reach[find(i)], default=None)) for i, (a, x) in enumerate(rows)]


def order(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def collected(df):
    return order(tuple(r) for r in df.collect())


def test_prints(spark, odd_rows):
    texts = [r[1] or "" for r in odd_rows] + ["A b", "a  B\nc", "É b c D"]
    got = bitslice.text_prints([t.encode() for t in texts])
    assert [int(x) for x in got] == [brute_print(t) for t in texts]


def test_shingle_hash_is_sparks(spark):
    text = "é one two"
    mine = bitslice.shingle_hashes(text.encode().split()).view(np.int64)[0]
    assert spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] == mine


def test_pieces_of_long_texts(monkeypatch):
    rng = random.Random(1)
    text = " ".join(words(rng, 3000))
    whole = bitslice.text_prints([text.encode(), b"", b"one two"])
    monkeypatch.setattr(bitslice, "FLUSH", 50)
    monkeypatch.setattr(bitslice, "chunks", lambda t, e: chunks(t, e, 7))
    assert (bitslice.text_prints([text.encode(), b"", b"one two"]) == whole).all()
    assert b"".join(chunks(text.encode(), SPACE, 5)) == text.encode()


def near(rng, count, flips):
    base = [rng.getrandbits(64) for _ in range(count // 8)]
    out = set()
    while len(out) < count:
        x = rng.choice(base)
        for _ in range(rng.randint(0, flips)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("radius,block", [(2, 4096), (2, 16), (1, 16), (3, 8), (0, 8)])
def test_print_links(spark, radius, block):
    prints = near(random.Random(radius), 400, 5)
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in prints], "print long")
    links = bitslice.print_links(nodes, radius, block).collect()
    for r in links:
        assert r["a"] != r["b"]
    index = {x: i for i, x in enumerate(prints)}
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in links:
        root[find(index[r["a"] % (1 << 64)])] = find(index[r["b"] % (1 << 64)])
    got = {x: prints[min(j for j in range(len(prints)) if find(j) == find(i))] for x, i in index.items()}
    want = brute_components(list(enumerate(prints)), radius)
    assert {x: got[x] for x in prints} == {int(p, 16): prints[c] for _, p, c in want}


def test_dense_bucket_gives_a_forest(spark):
    prints = [1 << i | 1 << j for i in range(40) for j in range(i)]  # any two are four bits apart or fewer
    nodes = spark.createDataFrame([(x,) for x in prints], "print long")
    assert bitslice.print_links(nodes, 2).count() <= 6 * len(prints)


def test_beyond():
    for radius in range(8):
        counters = [np.array([0xAA], np.uint64), np.array([0xCC], np.uint64), np.array([0xF0], np.uint64)]
        above = int(bitslice.beyond(counters, radius)[0])
        assert above & 0xFF == sum(1 << v for v in range(8) if v > radius)


def test_simhash_odd(spark, odd, odd_rows, empty):
    rows = [(r[0], brute_print(r[1])) for r in odd_rows]
    got = bitslice.simhash_groups(odd)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert collected(got) == order(brute_components(rows, 2))
    assert bitslice.simhash_groups(empty).count() == 0
    assert {r["fingerprint"] for r in got.where("doc_id IN (4, 5, 6)").collect()} == {"0" * 16}


def test_simhash_repeated_ids(spark):
    rng = random.Random(4)
    long = words(rng, 300)
    rows = [(5, " ".join(words(rng, 40))), (5, " ".join(long)), (7, " ".join(long[:299] + ["x"])), (None, "p q"),
            (None, " ".join(long)), (9, None)]
    got = bitslice.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert collected(got) == order(brute_components([(i, brute_print(t)) for i, t in rows], 2))


def test_simhash_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [(r["doc_id"], brute_print(r["text"])) for r in docs.collect()]
    assert collected(bitslice.simhash_groups(docs)) == order(brute_components(rows, 2))


# -- ranked search -----------------------------------------------------------

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(docs, items, k):
    tf = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs]
    tf = [(i, c) for i, c in tf if c]
    n, total = len(tf), sum(sum(c.values()) for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    pooled = defaultdict(Counter)
    for item, text in items:
        pooled[item].update(TERM.findall(lower(text)))
    out = []
    for item, asked in pooled.items():
        found = []
        for i, c in tf:
            m = 75 + 25 * sum(c.values()) * n // total
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                        * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, times in asked.items() if t in c)
            if score > 0:
                found.append((score, i))
        found.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(item, r, i, s) for r, (s, i) in enumerate(found[:k], 1)]
    return out


def test_search_odd(spark, odd, odd_rows, empty, monkeypatch):
    items = [(1, odd_rows[0][1]), (2, "line FIVE words one one"), (2, "two"), (3, None), (4, "!!"), (None, "三 中国 x"),
             (7, "nosuchterm"), (8, odd_rows[8][1]), (9, "é ﬁ ÉÀſK")]
    asked = spark.createDataFrame([(*i, "r") for i in items], "item_id long, text string, rank string")
    docs = [(r[0], r[1]) for r in odd_rows]
    want = order(brute_search(docs, items, 5))
    assert collected(strata.ranked_search(odd, asked, 5)) == want
    assert collected(strata.ranked_search(odd, asked, 5, block_terms=20)) == want
    monkeypatch.setattr(strata, "EXACT", 0)
    assert collected(strata.ranked_search(odd, asked, 5)) == want
    assert strata.ranked_search(empty, asked).count() == 0
    assert strata.ranked_search(odd, asked.limit(0)).count() == 0
    named = spark.createDataFrame([("a", "line one"), ("b", "two")], "item_id string, text string")
    assert collected(strata.ranked_search(odd, named, 5)) == order(brute_search(docs, [("a", "line one"), ("b", "two")], 5))


def test_search_ties_and_strata(spark, monkeypatch):
    rng = random.Random(6)
    vocabulary = words(rng, 40)
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 3, 3, 9, 40])))) for i in range(600)]
    items = [(i, " ".join(rng.choices(vocabulary, k=6))) for i in range(9)]
    monkeypatch.setattr(strata, "SHARD_ROWS", 100)
    got = strata.ranked_search(spark.createDataFrame(docs, "doc_id long, text string").repartition(5),
                               spark.createDataFrame(items, "item_id long, text string"), 20)
    assert collected(got) == order(brute_search(docs, items, 20))


def test_terms_do_not_run_over_pieces():
    text = "ab1 cdé, F\x7fg".encode()
    assert [t.translate(strata.FOLDED).split() for t in chunks(text, NOT_ALNUM, 1)] != []
    assert [w for t in chunks(text, NOT_ALNUM, 1) for w in t.translate(strata.FOLDED).split()] == [
        b"ab1", "cdé".encode(), b"f", b"g"]


# -- divergence --------------------------------------------------------------

ALPHA = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute_divergence(rows, least, top):
    rows = [(t or "", l or "", s or "") for t, l, s in rows]
    out = []
    apart = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in {r[1] for r in rows}:
        docs = [(s, Counter(ALPHA.findall(lower(t)))) for t, l, s in rows if l == lang]
        df = Counter(t for _, c in docs for t in c)
        kept = sorted(t for t in df if df[t] >= least)
        counts = defaultdict(Counter)
        for s, c in docs:
            counts[s].update({t: c[t] for t in c if df[t] >= least})
        total = sum(counts.values(), Counter())

        def shares(c):
            return {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}

        p = {s: shares(c) for s, c in counts.items()}
        q = shares(total)
        for s in counts:
            pair = sorted((-sum(apart(p[s][t], p[o][t]) for t in kept), o) for o in counts if o != s)
            term = sorted((-apart(p[s][t], q[t]), t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, "pair", o, -v, r) for r, (v, o) in enumerate(pair, 1)]
            out += [(lang, s, "term", t.decode(), -v, r) for r, (v, t) in enumerate(term, 1)]
    return out


@pytest.mark.parametrize("side,part", [(64, 4096), (2, 3)])
def test_divergence_odd(odd, odd_rows, side, part):
    rows = [(r[1], r[2], r[3]) for r in odd_rows]
    for least in (1, 3, 1000):
        got = divergence.source_divergence(odd, least, 4, side=side, part=part)
        assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert collected(got) == order(brute_divergence(rows, least, 4))


def test_divergence_of_copies(spark, empty, monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(words(rng, rng.randint(0, 30))) for _ in range(30)]
    rows = [(rng.choice(texts), rng.choice(["en", "de"]), f"s{min(rng.randrange(9), rng.randrange(9))}") for _ in range(400)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(7)
    want = order(brute_divergence(rows, 10, 10))
    assert collected(divergence.source_divergence(docs, side=2, part=5)) == want
    monkeypatch.setattr(divergence, "GATHERED", 40)
    monkeypatch.setattr(divergence, "HELD", 60)
    monkeypatch.setattr(divergence, "LISTED", 2)
    assert collected(divergence.source_divergence(docs)) == want
    assert divergence.source_divergence(empty).count() == 0


def test_texts_are_collapsed(spark, monkeypatch):
    rows = [("same", "en", f"s{k % 2}") for k in range(50)] + [("same", "de", "s0"), ("other", "en", "s0")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")

    def once():
        texts, held = divergence.collapsed(docs)
        found = texts.mapInArrow(lambda it: (pa.RecordBatch.from_pydict(
            {"lang": [lang], "text": [text.decode()], "s": [str(sorted((s["source"], s["copies"]) for s in sources))]})
            for lang, text, sources in divergence.read_once(it, held)), "lang string, text string, s string")
        return texts, collected(found)

    want = order([("en", "same", "[('s0', 25), ('s1', 25)]"), ("de", "same", "[('s0', 1)]"), ("en", "other", "[('s0', 1)]")])
    texts, got = once()
    assert got == want
    assert texts.where("bit IS NULL").count() == 1  # only the repeated text was shuffled
    monkeypatch.setattr(divergence, "FILTER_BITS", 64)
    monkeypatch.setattr(divergence, "RANGE", 16)
    docs = spark.createDataFrame(rows + [(f"t{k}", "en", "s0") for k in range(300)] * 2, docs.schema)
    texts, got = once()
    assert len(got) == len(want) + 300  # a full bitmap sends all texts, and loses none


def test_divergence_with_full_bitmaps(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(" ".join(words(rng, 12)), rng.choice(["en", "de"]), f"s{rng.randrange(4)}") for _ in range(150)] * 2
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    want = order(brute_divergence(rows, 3, 10))
    assert collected(divergence.source_divergence(docs, 3)) == want
    monkeypatch.setattr(divergence, "FILTER_BITS", 64)
    monkeypatch.setattr(divergence, "RANGE", 16)
    assert collected(divergence.source_divergence(docs, 3)) == want


def test_rare_terms_are_left_out_early(spark):
    docs = spark.createDataFrame([(f"common rare{'x' * k}", "en", "s") for k in range(20)],
                                 "text string, lang string, source string")
    texts, held = divergence.collapsed(docs)
    wanted = divergence.frequent_terms(texts, held, 10)
    assert int(np.bitwise_count(wanted).sum()) == 1
    assert [r["term"] for r in divergence.term_counts(texts, held, wanted).collect()] == ["common"]
