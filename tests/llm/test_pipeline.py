"""The pipeline's stages on odd rows, empty tables, and the smallest documents."""

from collections import Counter

import corpus_pipeline
from calib.llm import curriculum, jaccard
from calib.session import tables_made
from test_text_operators import brute_groups, brute_lines

SF_DIR = "/root/testdata/sf0.001"


def run_stages(spark, docs, folder):
    out = [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF_DIR).write.parquet(f"{folder}/{k}-{name}")
        out.append(spark.read.parquet(f"{folder}/{k}-{name}"))
    return out


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    raw, known, cut, single, mixed, coded = run_stages(spark, docs, str(tmp_path))
    for df in (known, cut, single, mixed):
        assert df.columns == docs.columns and df.dtypes == docs.dtypes
    rows = {r["doc_id"]: r for r in raw.collect()}
    assert known.count() == len(rows)  # every document is in one of the four languages
    assert {r["doc_id"]: r["text"] for r in known.collect()} == {i: r["text"] for i, r in rows.items()}

    texts = [(r["doc_id"], r["text"]) for r in known.collect()]
    kept = brute_lines(texts)
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k in kept[i] or not x.encode().split())
            for i, t in texts}
    got = {r["doc_id"]: r for r in cut.collect()}
    assert {i: r["text"] for i, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())

    groups = brute_groups([(i, r["text"]) for i, r in got.items()], corpus_pipeline.WORDS,
                          corpus_pipeline.PERCENT)
    first = {i for i, _, root in groups if i == root}
    assert {r["doc_id"] for r in single.collect()} == first and single.count() == len(first)

    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert set(copies) <= first and max(copies.values()) <= 3
    assert Counter(r["doc_id"] for r in coded.collect()) == copies
    assert all(r["decoded"] == r["text"] for r in coded.collect())
    assert coded.columns == [*docs.columns, "ids", "decoded"]


def test_odd_rows(spark, odd, tmp_path):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars", "rank", "key")
    raw, known, cut, single, mixed, coded = run_stages(spark, docs, str(tmp_path))
    assert known.columns == docs.columns
    assert {r["doc_id"] for r in known.collect()} >= {1, 3, 7, 9, 10, 11}
    assert cut.count() == known.count()
    roots = {r["doc_id"] for r in jaccard.jaccard_groups(
        cut, corpus_pipeline.WORDS, corpus_pipeline.PERCENT).where("doc_id = component_id").collect()}
    assert sorted(r["doc_id"] for r in single.where("doc_id IS NOT NULL").collect()) == sorted(roots)
    assert coded.count() == mixed.count() > 0


def test_scratch_of_earlier_stages_is_dropped(spark, odd, tmp_path):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    before = set(tables_made())
    run_stages(spark, docs, str(tmp_path))
    left = set(tables_made()) - before
    # Encoding makes no tables, so those of mixing went when it started.
    assert not left and not corpus_pipeline._earlier


def test_twins_are_mixed_once_each(spark):
    rows = [(None, "a b c", "en", "s", k) for k in range(40)] + [(1, "d e f", "en", "s", 99), (2, "g h", "en", "s", 98)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    taken = Counter(r["n_chars"] for r in curriculum.mixed(docs).collect())
    plan = curriculum.mix_plan(docs).collect()
    assert sum(taken.values()) == sum(r["copies"] for r in plan)
    assert Counter(taken.values()) == Counter(r["copies"] for r in plan if r["copies"])


def test_empty(spark, empty, tmp_path):
    docs = empty.select("doc_id", "text", "lang", "source", "n_chars")
    for df in run_stages(spark, docs, str(tmp_path)):
        assert df.count() == 0


def test_registered():
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert sum(n.startswith("op") for n in entry.queries()) == 13
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "line_dedup", "ngram_jaccard", "curriculum", "pieces"]
