import re

import corpus_pipeline as cp
import pytest
from test_minhash import brute

from taproot.llm import secrets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in cp.STAGES:
        out.append(cp.written(stage(spark, out[-1], SF)))
    return out


def test_columns_and_order(steps):
    assert [n for n, _ in cp.STAGES] == ["language", "near_duplicates", "secrets", "mixture", "encoding"]
    assert all(s.columns == steps[0].columns and s.schema == steps[0].schema for s in steps[1:-1])


def test_language_keeps_clean_documents(steps):
    assert steps[1].count() >= 0.99 * steps[0].count()


def test_near_duplicates_against_brute_force(steps):
    rows = [(r.doc_id, r.text) for r in steps[1].collect()]
    want = {i for i, _, _, kept in brute(rows, 5, 80) if kept}
    assert {r.doc_id for r in steps[2].collect()} == want and steps[2].count() == len(want)


def test_secrets_are_gone(steps):
    before = {r.doc_id: r for r in steps[2].collect()}
    after = {r.doc_id: r for r in steps[3].collect()}
    assert before.keys() == after.keys()
    assert secrets.findings(steps[3]).where("n_assign + n_access + n_hex > 0").count() == 0
    for i, r in after.items():
        assert r.n_chars == len(r.text)
        assert r == before[i] or "[SECRET]" in r.text
        assert re.sub("[0-9a-zA-Z]", "", before[i].text)[:20] == re.sub("[0-9a-zA-Z]", "", r.text)[:20] or "[SECRET]" in r.text


def test_mixture_keeps_labelled_clean_documents(spark, steps):
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 and toxic = 0")
    clean = {r.doc_id for r in steps[3].join(labels, "doc_id").collect()}
    assert len(clean & {r.doc_id for r in steps[4].collect()}) >= 0.95 * len(clean)


def test_encoding_has_a_row_per_row(steps):
    assert steps[5].count() == steps[4].count()
    assert steps[5].columns == ["doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_hard_rows_and_empty_table(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    good = "these are plain words of a clean document that stays in the corpus as it is " * 3
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, good, None, None, None), (3, good, None, None, None), (4, good, "en", "s", 5), (None, good + "x", "en", "s", 5), (5, "w " * 90000, "en", "s", 5)]
    docs = spark.createDataFrame(rows, schema)
    for df, most in ((docs, 8), (docs.limit(0), 0)):
        for _, stage in cp.STAGES:
            df = cp.written(stage(spark, df, SF))
        assert df.count() <= most
    assert most == 0


def test_run(spark, steps):
    assert cp.run(spark, SF).count() == steps[-1].count()


def test_run_yields_the_token_ids(spark, steps):
    got = cp.run(spark, SF).selectExpr("n_tokens", "ids").collect()
    assert len(got) == steps[-1].count() and all(r.ids is not None and len(r.ids) == r.n_tokens for r in got) and any(r.ids for r in got)
