"""Vector searches against brute force."""

import numpy as np
import pytest

from calib.llm import balltree, collision, search

SCHEMA = "vec_id long, embedding array<double>, label int, rank int"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16))
    rows = [(i, (centres[i % 20] + 0.4 * rng.normal(size=16)).tolist(), 0, 1) for i in range(900)]
    same = rng.normal(size=16).tolist()
    rows += [(1000 + i, same, 0, 1) for i in range(200)]
    rows += [(2000, None, 0, 1), (2001, [1.0, None] + [0.0] * 14, 0, 1), (2002, [float("nan")] * 16, 0, 1),
             (2003, [float("inf")] * 16, 0, 1), (2004, [0.0] * 16, 0, 1), (2005, [], 0, 1),
             (2006, [1.0, 2.0], 0, 1), (2007, [1.5, 2.0], 0, 1), (None, same, 0, 1)]
    return rows


def usable(rows, zero):
    return [(i, np.array(v, float)) for i, v, *_ in rows
            if i is not None and v and None not in v and np.isfinite(v).all() and (zero or any(v))]


def brute(rows, queries, k, score, zero):
    ok = usable(rows, zero)
    out = []
    for q, a in [x for x in ok if queries(x[0])]:
        found = sorted((score(a, b), i) for i, b in ok if i != q and len(a) == len(b))[:k]
        out += [(q, n + 1, i, s) for n, (s, i) in enumerate(found)]
    return out


@pytest.fixture(params=[8192, 150])
def shards(request, monkeypatch):
    monkeypatch.setattr(search, "SHARD_ROWS", request.param)
    monkeypatch.setattr(search, "BLOCK_ROWS", 64)


def test_ball_tree_is_exact(spark, vectors, shards):
    df = spark.createDataFrame(vectors, SCHEMA)
    got = balltree.top_products(df, df.where("vec_id % 10 = 0 OR vec_id > 1999"), 20).collect()
    want = brute(vectors, lambda i: i % 10 == 0 or i > 1999, 20,
                 lambda a, b: -int(np.floor(64 * a) @ np.floor(64 * b)), True)
    assert sorted(map(tuple, got)) == sorted((q, n, i, -s) for q, n, i, s in want)


@pytest.mark.parametrize("tasks", [3, 40])
def test_rows_and_queries_pass_by_the_driver(spark, vectors, monkeypatch, tasks):
    """tasks of several shards, or several groups of queries; nothing is broadcast."""
    for name, value in (("SHARD_ROWS", 100), ("BLOCK_ROWS", 20), ("TASK_SHARDS", 2), ("TASKS", tasks)):
        monkeypatch.setattr(search, name, value, raising=False)
    df = spark.createDataFrame(vectors, SCHEMA)
    asked = df.where("vec_id % 10 = 0 OR vec_id > 1999")
    products, near = balltree.top_products(df, asked, 20), collision.nearest_neighbours(df, asked, 10)
    for found in (products, near):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    want = brute(vectors, lambda i: i % 10 == 0 or i > 1999, 20,
                 lambda a, b: -int(np.floor(64 * a) @ np.floor(64 * b)), True)
    assert sorted(map(tuple, products.collect())) == sorted((q, n, i, -s) for q, n, i, s in want)
    want = brute(vectors, lambda i: i % 10 == 0 or i > 1999, 10,
                 lambda a, b: float(np.sqrt(((a - b) ** 2).sum())), False)
    got = near.collect()
    hits = {(q, i) for q, _, i, _ in want} & {(r["query_id"], r["vec_id"]) for r in got}
    assert len(got) == len(want) and len(hits) >= 0.97 * len(want)


def test_large_components(spark):
    rows = [(i, [float(10 ** 14 + i), 3.0 * i], 0, 0) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = balltree.top_products(df, df.where("vec_id = 3"), 5).collect()
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] == [29, 28, 27, 26, 25]


def test_neighbours_recall(spark, vectors, shards):
    df = spark.createDataFrame(vectors, SCHEMA)
    asked = df.where("vec_id % 10 = 0 OR vec_id > 1999")
    got = collision.nearest_neighbours(df, asked, 10).collect()
    want = brute(vectors, lambda i: i % 10 == 0 or i > 1999, 10,
                 lambda a, b: float(np.sqrt(((a - b) ** 2).sum())), False)
    exact = {(q, i): s for q, _, i, s in want}
    hits = sum((r["query_id"], r["vec_id"]) in exact for r in got)
    assert len(got) == len(want) and hits >= 0.97 * len(want)
    by = dict(usable(vectors, False))
    for r in got:
        assert abs(r["score"] - np.sqrt(((by[r["query_id"]] - by[r["vec_id"]]) ** 2).sum())) < 1e-12
    twins = sorted(r["vec_id"] for r in got if r["query_id"] == 1100)
    assert twins == list(range(1000, 1010))


def test_recall_on_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = collision.nearest_neighbours(df, df.where("vec_id % 100 = 0"), 10).collect()
    want = brute(rows, lambda i: i % 100 == 0, 10, lambda a, b: float(np.sqrt(((a - b) ** 2).sum())), False)
    exact = {(q, i) for q, _, i, _ in want}
    assert sum((r["query_id"], r["vec_id"]) in exact for r in got) >= 0.9 * len(want)


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert balltree.top_products(df, df, 5).count() == 0
    assert collision.nearest_neighbours(df, df, 5).count() == 0
