"""The pipeline: each stage against the operator that it calls, and the whole against a brute-force version."""

from collections import Counter

import pytest

import corpus_pipeline
from sparkfolio.llm import mixing
from tests.llm.test_operators import borderline_family, brute_groups, brute_near

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs.cache())
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return out


def test_stages_in_order(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "bpe"]
    for x in steps[:-1]:
        assert x.columns == steps[0].columns and x.dtypes == steps[0].dtypes


def test_toxic_documents_go_and_clean_ones_stay(spark, steps):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = ({r["doc_id"] for r in x.collect()} for x in steps[:2])
    assert after < before
    right = sum((d in after) == (labels[d] == 0) for d in before if d in labels)
    assert right / sum(d in labels for d in before) > 0.95


def test_copies_go(steps):
    rows = [[r.asDict() for r in x.collect()] for x in steps]
    equal = {d for d, keep, _, kept, _ in brute_groups(rows[1]) if kept}
    assert {r["doc_id"] for r in rows[2]} == equal and len(rows[2]) == len(equal)
    near = {d for d, _, _, kept in brute_near(rows[2], 5) if kept}
    assert {r["doc_id"] for r in rows[3]} == near and len(rows[3]) == len(near)


def test_mix_and_tokens(spark, steps):
    report = {r["doc_id"]: r["taken"] for r in mixing.mix_report(steps[3]).collect()}
    words = Counter()
    for r in steps[4].collect():
        words[r["doc_id"]] += len(r["text"].split())
    assert words == Counter({d: n for d, n in report.items() if n})
    assert steps[5].count() == steps[4].count()
    assert corpus_pipeline.run(spark, SF).count() == steps[5].count()


def test_no_documents(spark):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        got = stage(spark, empty, SF)
        assert got.count() == 0


def test_near_copies_in_a_large_family_of_borderline_similarity_go(spark):
    rows, want = borderline_family(5)
    rows = [(k, "en", "web", t, len(t)) for k, t in rows]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id bigint, lang string, source string, text string, n_chars bigint"), SF).collect()
    assert sorted(tuple(r) for r in got) == sorted(r for r in rows if want[r[0]] == r[0])


def test_stages_on_odd_rows(spark):
    """Nulls in any column, empty and long texts, repeated rows, and columns whose names the operators use themselves."""
    texts = [None, "", " \n", "word", "a b c d e f g h", "a b c d e f g h", "A  b c d e f g h i", "long words " * 20_000, "x" * 30_000]
    rows = [(k if k % 4 else None, None if k % 3 else "en", None if k % 2 else "web", t, None if k % 2 else 5, 0.5, 1, "o", k, "p", 3, None, True) for k, t in enumerate([*texts, texts[4]])]
    rows += [rows[5]] * 2
    kinds = "doc_id bigint, lang string, source string, text string, n_chars bigint, score double, predicted int, own string, row_no bigint, pieces string, shard int, digest binary, single boolean"
    docs = spark.createDataFrame(rows, kinds)
    left = [docs]
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, left[-1], SF)
        assert name == "bpe" or (got.columns == docs.columns and got.dtypes == docs.dtypes)
        left.append(got)
    told = [[r.asDict() for r in x.collect()] for x in left]
    assert len(told[1]) == len(rows)  # none of them is toxic
    squeezed = lambda t: "".join((t or "").split())
    assert Counter(squeezed(r["text"]) for r in told[2]) == Counter({squeezed(t) for t in texts})  # one of each text
    near = Counter({(d, n): k for (d, n, _, kept), k in brute_near(told[2], 5).items() if kept})
    assert Counter(r["doc_id"] for r in told[3]) == Counter(d for d, _ in near.elements()) and len(told[3]) == len(told[2]) - 1  # two share 4 of 5 shingles
    assert {r["own"] for r in told[4]} == {"o"} and all(r["text"].strip() for r in told[4]) and len(told[5]) == len(told[4])
    assert all(r["n_tokens"] == len(r["ids"]) for r in told[5])
