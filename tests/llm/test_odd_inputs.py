"""Nulls, empty and long texts, repeats, clashing names and empty tables, for every operator and stage."""

import pytest

import corpus_pipeline
import public_tokenizers
from lakeweave.llm import bpe, html_text, language_id, licenses, mixing, multiset_hash, quality_model, quality_rules, secrets, simhash


def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0, "x") for i in range(10)] + [(None, 1, 0, "x"), (3, None, 0, "x")], "doc_id long, quality int, toxic int, note string")


def byte_bpe(df, **more):
    return bpe.bpe_round_trip(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, **more)


PER_ROW = {
    "op1": lambda spark, df: simhash.near_duplicates(df),
    "op2": lambda spark, df: quality_model.score_quality(df, labels(spark)),
    "op3": lambda spark, df: quality_rules.quality_rules(df),
    "op4": lambda spark, df: language_id.identify(df),
    "op5": lambda spark, df: byte_bpe(df),
    "op7": lambda spark, df: secrets.scan_secrets(df),
    "op9": lambda spark, df: multiset_hash.document_fingerprints(df),
    "op10": lambda spark, df: mixing.mix_sources(df),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_each(spark, odd, name):
    rows = PER_ROW[name](spark, odd).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in odd.collect())


@pytest.mark.parametrize("name", PER_ROW)
def test_empty_table(spark, none, name):
    assert PER_ROW[name](spark, none).collect() == []


@pytest.mark.parametrize("name", ["op1", "op3", "op5", "op7"])
def test_equal_rows_give_equal_results(spark, odd, name):
    rows = [tuple(r)[1:] for r in PER_ROW[name](spark, odd).collect() if r["doc_id"] == 1]
    assert len(rows) == 2 and rows[0] == rows[1]


def test_licences_group_rows_by_id(spark, odd, none):
    rows = licenses.scan_licenses(odd).collect()
    assert len(rows) == 10 and all(r["n_notices"] == 0 and r["families"] == "" for r in rows)
    assert licenses.scan_licenses(none).collect() == []


def test_stated_results(spark, odd):
    by = lambda df: {r["doc_id"]: r for r in df.collect()}
    rules = by(quality_rules.quality_rules(odd))
    assert all(rules[i]["n_words"] == 0 and rules[i]["base_failed"] and not rules[i]["kept"] for i in (3, 4, 5))
    assert rules[6]["n_words"] == 60_000
    lang = by(language_id.identify(odd))
    assert all(lang[i]["lang_pred"] == "und" and lang[i]["score"] == 0 and not lang[i]["ambiguous"] for i in (3, 4, 5, 7))
    assert lang[8]["lang_pred"] != "und"
    tokens = by(byte_bpe(odd, with_ids=True))
    assert tokens[3]["n_tokens"] == tokens[4]["n_tokens"] == 0 and tokens[3]["ids"] == []
    assert tokens[8]["decoded"] == "😀 é ß \u0000 x"
    found = by(secrets.scan_secrets(odd))
    assert (found[9]["n_assign"], found[9]["n_access"], found[9]["n_hex"]) == (1, 1, 1)
    assert found[3]["spans"] == "" and found[3]["base_sha256"].startswith("e3b0c442")
    near = by(simhash.near_duplicates(odd))
    assert near[2]["component_id"] == 1 and near[4]["component_id"] == near[5]["component_id"] == 3
    assert near[3]["fingerprint"] == "0" * 16
    prints = by(multiset_hash.document_fingerprints(odd))
    assert set(prints[4]["fingerprint"]) == {"0"} and prints[4]["n_chars"] == 0
    assert prints[1]["fingerprint"] == prints[2]["fingerprint"]
    places = by(mixing.mix_sources(odd))
    assert places[3]["source"] is None and places[4]["source"] == "b"


def test_pages(spark):
    rows = [(1, "u", "<p>A<br>b &amp; c</p>", 1), (2, None, None, 2), (None, "u", "", 3), (3, "u", "<article><p>" + "long " * 50_000 + "</article>", 4), (3, "u", "no <b>tags", 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n int").toDF("page_id", "url", "html", "HTML")
    out = html_text.extract_text(pages).collect()
    assert len(out) == 5
    by = {(r["page_id"], r["url"]): r for r in out if r["page_id"] != 3}
    assert by[2, None]["text"] == "" and by[None, "u"]["n_chars"] == 0
    assert sum(r["n_chars"] for r in out if r["page_id"] == 3) >= 249_999
    assert html_text.extract_text(pages.where("false")).collect() == []


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_take_odd_documents(spark, odd, none, small, k):
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, odd, small)
    if k < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == odd.columns and out.dtypes == odd.dtypes
    n = {"language ID": 7, "SimHash near-dedup": 7}.get(name, 11)
    assert out.count() == n, name
    assert stage(spark, none, small).count() == 0
